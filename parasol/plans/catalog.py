"""All registered queries of the shade analytics, and their forms for the oracle."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from parasol.plans import audits, composites, frames, naming, scoring, spatial, texts
from parasol.plans.dialect import oracle

#: The oracle's texts of the queries in ``frames``.
TEXTS: dict[str, str] = {**scoring.QUERIES, **audits.QUERIES, **texts.QUERIES}


#: Columns that the oracle would give as narrower integers than Spark's queries do.
_WIDE = {
    "request_validate": "status",
    "query_normalise": "status",
    "blend_weights": "corner",
    "real_park_filter": "park_id",
    "first_matching_box": "park_id",
    "pip_parks": "first_park",
    "borough_bucketing": "borough",
    "confusion_shares": "policy",
    "score_lookup": "key",
    "edge_dedupe_best": "key",
    "parallel_edge_key": "l_linenumber",
    "running_length": "l_linenumber",
    "longest_part": "part",
}


def _widened(frame: DataFrame) -> DataFrame:
    """All integers as 64-bit, as the oracle has them."""
    return frame.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in frame.dtypes))


def _run(query: Callable[[SparkSession, str], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return _widened(query(spark, sf_dir))


def _oracle(name: str, text: str) -> str:
    wide, text = _WIDE.get(name), oracle(text)
    return f"select * replace (cast({wide} as bigint) as {wide}) from ({text}) q" if wide else text


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: partial(_run, query) for name, query in (frames.QUERIES | composites.QUERIES | naming.QUERIES).items()}
QUERIES |= spatial.QUERIES
ORACLE_SQL: dict[str, str] = {name: _oracle(name, text) for name, text in (TEXTS | spatial.ORACLE_TEXTS | composites.ORACLE_TEXTS | naming.ORACLE_TEXTS).items()}
