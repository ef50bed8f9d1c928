"""DataFrame in, DataFrame out: loads, versions, schemas, checks, registries, workflows, reports."""
