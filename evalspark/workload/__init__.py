"""Registered queries over the given tables, each with its SQL counterpart."""

from evalspark.workload import case_queries, curation_queries, report_queries, score_queries, source_queries, stream_queries, text_queries

MODULES = (text_queries, case_queries, score_queries, curation_queries, source_queries, report_queries, stream_queries)


def all_queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def all_oracles() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
