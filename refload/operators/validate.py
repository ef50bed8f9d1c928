"""Checks of a stage table before its rows are promoted."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refload.session import local_rows


@dataclass(frozen=True)
class Rule:
    """A check; ``bad`` rules count rows for which the predicate holds."""

    issue_id: int
    detail: str
    bad: Column | None = None
    unique: tuple[str, ...] = ()
    foreign: tuple[str, DataFrame, str] | None = None


def not_null(issue_id: int, column: str) -> Rule:
    return Rule(issue_id, f"{column} must not be empty", F.col(column).isNull())


def in_domain(issue_id: int, column: str, values: list) -> Rule:
    return Rule(issue_id, f"{column} holds a value outside its domain", ~F.col(column).isin(values))


def max_length(issue_id: int, column: str, limit: int) -> Rule:
    return Rule(issue_id, f"{column} is longer than {limit}", F.length(F.col(column)) > limit)


def matches(issue_id: int, column: str, pattern: str) -> Rule:
    return Rule(issue_id, f"{column} does not match {pattern}", ~F.col(column).rlike(pattern))


def predicate(issue_id: int, detail: str, bad: Column) -> Rule:
    return Rule(issue_id, detail, bad)


def unique_key(issue_id: int, *columns: str) -> Rule:
    return Rule(issue_id, f"{', '.join(columns)} must be unique", unique=columns)


def foreign_key(issue_id: int, column: str, parent: DataFrame, key: str) -> Rule:
    return Rule(issue_id, f"{column} has no parent", foreign=(column, parent, key))


def _row_issues(stage: DataFrame, rules: list[Rule]) -> DataFrame:
    """All row rules in one pass: one counter each, then one row per rule."""
    counted = stage.agg(*[F.count_if(rule.bad).alias(f"_{i}") for i, rule in enumerate(rules)])
    entries = [
        F.struct(
            F.lit(rule.issue_id).alias("issue_id"), F.lit(rule.detail).alias("issue_detail"), F.col(f"_{i}").alias("rows")
        )
        for i, rule in enumerate(rules)
    ]
    return counted.select(F.inline(F.array(*entries)))


def _unique_issue(stage: DataFrame, rule: Rule) -> DataFrame:
    """Rows beyond the first of each key; counts are combined before the shuffle."""
    groups = stage.groupBy(*rule.unique).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows"))


def _foreign_issue(stage: DataFrame, rule: Rule) -> DataFrame:
    """Rows without a parent. Equal keys are counted first, so a hot key joins as one row."""
    column, parent, key = rule.foreign  # type: ignore[misc]
    keys = stage.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_k")).agg(F.count("*").alias("n"))
    orphans = keys.join(parent.select(F.col(key).alias("_k")), "_k", "left_anti")
    return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def validate_stage(stage: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule with the number of rows that break it."""
    parts = []
    rowwise = [r for r in rules if r.bad is not None]
    if rowwise:
        parts.append(_row_issues(stage, rowwise))
    for rule in rules:
        if rule.unique or rule.foreign:
            found = _unique_issue(stage, rule) if rule.unique else _foreign_issue(stage, rule)
            parts.append(
                found.select(
                    F.lit(rule.issue_id).alias("issue_id"), F.lit(rule.detail).alias("issue_detail"), F.col("rows")
                )
            )
    if not parts:
        return local_rows(stage.sparkSession, [], "issue_id int, issue_detail string, rows bigint")
    return reduce(DataFrame.unionByName, parts)


def validation_json(issues: DataFrame) -> DataFrame:
    """The result document: how many rules are broken, and which. As many entries as rules."""
    broken = issues.where(F.col("rows") > 0)
    listed = broken.agg(
        F.count("*").cast("int").alias("validation_result"),
        F.array_sort(F.collect_list(F.struct("issue_id", "issue_detail"))).alias("validation_issue_list"),
    )
    return listed.select(F.to_json(F.struct("validation_result", "validation_issue_list")).alias("validation"))
