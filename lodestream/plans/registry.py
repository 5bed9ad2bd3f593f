"""All queries of the core library by name, and their SQL."""

from __future__ import annotations

from lodestream.plans import activity_queries, embedding_queries, finding_queries, graph_queries, landing_queries, mesh_queries, pipeline_queries, problems, rule_queries, sequence_queries, source_queries, state_queries, stream_queries, text_queries, upkeep_queries, vector_queries

_MODULES = (problems, pipeline_queries, text_queries, graph_queries, vector_queries, activity_queries, stream_queries, source_queries, sequence_queries, finding_queries, rule_queries, landing_queries, mesh_queries, embedding_queries, state_queries, upkeep_queries)


def queries():
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in getattr(m, "SQL", {}).items()}


def flagship(spark, sf_dir):
    return pipeline_queries.surfaced_output(spark, sf_dir)
