"""One query text for Spark and for the oracle: only the spellings that differ are marked."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: mark: (Spark, oracle). GEN a, b END yields one row per integer from a to b.
SPELLINGS = {
    "DIV": ("div", "//"),
    "GEN": ("explode(sequence(", "unnest(generate_series("),
    "END": ("))", "))"),
    "ROW": ("struct", "row"),
    "PCT": ("percentile", "quantile_cont"),
    "STRING": ("string", "varchar"),
    "US": ("unix_micros(cast(", "epoch_us("),
    "SU": (" as timestamp))", ")"),
    "SPLIT": ("split", "string_split"),
    "JSON": ("get_json_object", "json_extract_string"),
    "INITCAP": ("initcap", "initcap"),
}
_MARK = re.compile(r"\b(" + "|".join(SPELLINGS) + r")\b")
_TABLE = re.compile(r"@(\w+)")


def oracle(text: str) -> str:
    return _TABLE.sub(lambda m: m[1], _MARK.sub(lambda m: SPELLINGS[m[1]][1], text))


def spark_text(text: str, sf_dir: str) -> str:
    text = _MARK.sub(lambda m: SPELLINGS[m[1]][0], text)
    return _TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text)


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(spark_text(text, sf_dir))
