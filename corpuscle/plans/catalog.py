"""The registered queries and their SQL, from the modules of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuscle.operators import admin, embedding, enrich, graph, library, mutations, organise, records, relational, search, segments, service, values, vectors
from corpuscle.streaming import streams

FLAGSHIP = "sch_hybrid"
MODULES = (relational, search, segments, graph, vectors, embedding, service, records, enrich, values, mutations, admin, library, organise, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
