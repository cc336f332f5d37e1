"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrafold.plans import cloud_queries, frame_queries, graph_queries, more_queries, rule_queries, stream_queries

FLAGSHIP = "voxel_mean"
_PARTS = [m.catalog for m in (cloud_queries, graph_queries, more_queries, stream_queries, frame_queries, rule_queries)]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for c in _PARTS for k, f in c.queries.items()}
ORACLE_SQL: dict[str, str] = {k: s for c in _PARTS for k, s in c.sql.items()}
