from tracewell.plans import captures, catalog, coverage, evidence, fields, graphs, ledgers, machines, verdicts  # noqa: F401  all register their queries
