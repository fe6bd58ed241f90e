"""Stages that turn raw documents into training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of docs (doc_id, text,
lang, source, n_chars) and returns a DataFrame; all but the last return the
columns of docs. ``run`` writes each stage's result to the shared folder and
reads it back for the next one, so a lost executor costs one stage at most. What
else a stage wrote is deleted when the next one begins, as its result must have
been written by then.

The first three stages name a row by its id and 128 bits of hash of its text, and
drop all rows of a name, or, of equal rows of which one stays, all but one; rows
with one id but other texts don't stand or fall together. Null ids, texts and
sources pass through as the operators say; an empty table gives empty results;
other columns, of any name, are carried along.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from parasol.llm.common import attach, bounded, key_filter, marked, without, word_count
from parasol.llm.exact_dedup import exact_dedup
from parasol.llm.jaccard import jaccard_join
from parasol.llm.mixing import mix
from parasol.llm.packing import pack
from parasol.llm.queries import SEQUENCE_LIMITS, TOKENIZER
from parasol.llm.toxicity import THRESHOLD, toxicity
from parasol.session import clear_up, save_table, written


#: The columns that name a row: its id and two hashes of its text.
NAME = ["name_id", "name_a", "name_b"]


def _fresh(docs: DataFrame, prefix: str) -> str:
    """``prefix``, lengthened until no column of ``docs`` begins with it."""
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def _named(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as structs doc, whose columns meet no others, and their names."""
    name = F.col("doc_id").cast("long"), F.xxhash64("text"), F.xxhash64(F.reverse("text"), F.lit(1))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *(c.alias(n) for c, n in zip(name, NAME, strict=True)))


def _texts(named: DataFrame) -> DataFrame:
    return named.select("doc.doc_id", "doc.text", *NAME)


def _keep(named: DataFrame, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows whose names are not ``gone``, and one of each name in ``repeated``; both written tables of names."""
    left = without(named, gone, NAME)
    n = repeated.count()
    if not n:
        return left.select("doc.*")
    others = without(left, repeated, NAME)
    same = [F.col(k).eqNullSafe(F.col(f"again_{k}")) for k in NAME]
    several = left.join(bounded(repeated.select(*(F.col(k).alias(f"again_{k}") for k in NAME)), n), same, "left_semi")
    return others.select("doc.*").unionByName(several.dropDuplicates(NAME).select("doc.*"))


#: The tables that the stage before wrote, besides its result.
_before: list[str] = []


def _stage(of: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first clears up after the one before."""

    @wraps(of)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear_up(spark, _before)
        there = written()
        out = of(spark, docs, sf_dir)
        _before[:] = [path for path in written() if path not in there]
        return out

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the toxicity classifier rejects; it learns from the labels beside them."""
    named = _named(docs)
    scored = toxicity(_texts(named), spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=tuple(NAME))
    rejected = save_table(scored.where(F.col("score") >= THRESHOLD).select(*NAME).distinct(), "pipeline-toxic")
    return without(named, rejected, NAME).select("doc.*")


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of equal texts, the row that the exact dedup operator keeps."""
    named = _named(docs)
    found = exact_dedup(_texts(named), carry=tuple(NAME)).where("group_size > 1")
    names = save_table(found.groupBy(*NAME).agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "pipeline-copies")
    gone = save_table(names.where("not kept").select(*NAME), "pipeline-gone")
    return _keep(named, gone, save_table(names.where("kept and n > 1").select(*NAME), "pipeline-repeated"))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of the Jaccard join, that with the smallest doc_id, and of one id the least name.

    Rows with a null id come last, so they stay only where no other does.
    """
    named = _named(docs)
    found = save_table(jaccard_join(_texts(named), carry=tuple(NAME)).where("group is not null").select("group", *NAME), "pipeline-near")
    name = F.struct(F.col(NAME[0]).isNull().alias("none"), *NAME)
    groups = save_table(found.groupBy("group").agg(F.min(name).alias("first"), F.count("*").alias("m")).where("m > 1"), "pipeline-groups")
    members = attach(found, groups, ["group"], "m", found.count(), "inner").where("m is not null")
    names = save_table(members.groupBy(*NAME).agg(F.max(name == F.col("first")).alias("kept"), F.count("*").alias("n")), "pipeline-names")
    gone = save_table(names.where("not kept").select(*NAME), "pipeline-gone")
    return _keep(named, gone, save_table(names.where("kept and n > 1").select(*NAME), "pipeline-repeated"))


def _usual(plan: DataFrame, source: str, copies: str, rows: str, p: str) -> DataFrame:
    """How often most rows of a source are taken that are alone in their key: columns from and usual, after ``p``."""
    counts = plan.groupBy(source, copies).agg(F.count(F.when(F.col(rows) == 1, 1)).alias("n"))
    most = F.max_by(F.when(F.col("n") > 0, F.col(copies)), F.struct("n", copies))
    return counts.groupBy(F.col(source).alias(f"{p}from")).agg(most.alias(f"{p}usual"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats every document as often as the mix takes it; those that it takes zero times go."""
    p = _fresh(docs, "__mix")
    key = [f"{p}id", f"{p}source", f"{p}size"]
    plan = mix(docs).groupBy(F.col("doc_id").alias(key[0]), F.col("source").alias(key[1]), F.col("size").alias(key[2]))
    plan = save_table(plan.agg(F.sum("copies").alias(f"{p}copies"), F.count("*").alias(f"{p}rows")), "mix-plan")
    named = F.col("doc_id").cast("long"), F.col("source"), word_count(F.col("text"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *(c.alias(k) for c, k in zip(named, key, strict=True)))
    # Most documents of a source are taken equally often. Those that aren't, or are like others in all of the key, are
    # told by a filter; only they, and what it lets through besides, are sent to meet their plan.
    usual = save_table(_usual(plan, key[1], f"{p}copies", f"{p}rows", p), "mix-usual")
    odd = plan.join(usual, plan[key[1]].eqNullSafe(usual[f"{p}from"]))
    odd = odd.where((F.col(f"{p}rows") > 1) | F.col(f"{p}usual").isNull() | (F.col(f"{p}usual") != F.col(f"{p}copies")))
    odd = save_table(odd.select(F.xxhash64(*key).alias("__k")), "mix-odd")
    n = odd.count()
    told = marked(rows.withColumn("__k", F.xxhash64(*key)), save_table(key_filter(odd, "__k", n), "mix-filter"), "__k", n, "left")
    others = told.where("not __hit").join(usual, F.col(key[1]).eqNullSafe(usual[f"{p}from"])).select("doc", F.col(f"{p}usual").alias(f"{p}copies"))
    told = told.where("__hit").select("doc", *key)
    joined = told.join(bounded(plan, plan.count()), [told[k].eqNullSafe(plan[k]) for k in key]).select("doc", *(plan[k] for k in key), f"{p}copies", f"{p}rows")
    one = joined.where(f"{p}rows = 1").select("doc", f"{p}copies").unionByName(others)
    # Rows alike in id, source and size share their copies, one more for the first of them.
    if not plan.where(f"{p}rows > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy(*key).orderBy("doc.text"))
        share = F.floor(F.col(f"{p}copies") / F.col(f"{p}rows")) + F.when(nth <= F.col(f"{p}copies") % F.col(f"{p}rows"), 1).otherwise(0)
        one = one.unionByName(joined.where(f"{p}rows > 1").withColumn(f"{p}copies", share.cast("long")).select("doc", f"{p}copies"))
    times = one.where(f"{p}copies > 0").withColumn(f"{p}n", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{p}copies"))))
    return times.select("doc.*")


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences; one row per piece."""
    return pack(docs, public_tokenizers.path(TOKENIZER), end_id=1, **SEQUENCE_LIMITS)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A learned stage decides what goes, so SQL can't express the rows of ``run``.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in order to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last: list[str] = []
    for name, stage in STAGES:
        docs = save_table(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        clear_up(spark, last)
        last = [docs.table_path]
    return docs
