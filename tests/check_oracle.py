"""Run queries against their SQL: ``python -m tests.check_oracle [name ...]`` (``CHECK_SF_DIR`` names the tables)."""

from __future__ import annotations

import os
import sys
import time
import traceback

from refload.session import build_session
from tests.oracle import connect, difference


def main() -> int:
    sf = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    import importlib

    modules = os.environ.get("CHECK_MODULES")
    if modules:
        for m in modules.split(","):
            importlib.import_module(f"refload.plans.queries.{m}")
    else:
        importlib.import_module("refload.plans.queries").load_all()
    from refload.plans.catalogue import ORACLE_SQL, QUERIES

    spark = build_session()
    con = connect(sf)
    names = sys.argv[1:] or list(QUERIES)
    bad = 0
    for name in names:
        started = time.perf_counter()
        try:
            got = QUERIES[name](spark, sf).toPandas()
            took = time.perf_counter() - started
            if name in ORACLE_SQL:
                issue = difference(got, con.sql(ORACLE_SQL[name]).df())
                verdict = "ok" if issue is None else f"DIFFERS {issue[:1500]}"
            else:
                verdict = "rows only"
        except Exception as problem:
            took = time.perf_counter() - started
            got, verdict = [], "FAILED " + (str(problem)[:1200] or traceback.format_exc()[-800:])
            if os.environ.get("CHECK_TRACE"):
                traceback.print_exc()
        bad += verdict.startswith(("DIFFERS", "FAILED"))
        print(f"{name:28} {took:6.1f}s {len(got):8} {verdict}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
