"""The pipeline's stages against plain versions of what each decides."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parasol.llm.jaccard import jaccard_join
from parasol.llm.toxicity import toxicity
from tests.llm.helpers import DOCS, awkward, clashing, docs
from tests.llm.test_dedup import near_copies, norm
from tests.llm.test_models import LABELS, label_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows, labels = label_rows(spark)
    rows = [(d, t, "xyz"[i % 3]) for i, (d, t) in enumerate(rows)] + [(1000 + (d or 0), t, s) for d, t, s in awkward(n=30)]
    rows += near_copies(random.Random(1), [f"v{i}" for i in range(90)], 12, 3000)
    docs(spark, rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_do_what_their_operators_say(spark, folder):
    read = spark.read.parquet(f"{folder}/documents.parquet")
    columns = [f.name for f in DOCS]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram jaccard join", "mixing", "packing"]

    clean = corpus_pipeline.drop_toxic(spark, read, folder)
    bad = {(str(r.doc_id), r.said) for r in toxicity(read.withColumn("said", F.col("text")), spark.read.parquet(f"{folder}/labels.parquet"), carry=("said",)).where("predicted = 1").collect()}
    assert clean.columns == columns and bad
    assert sorted((str(r.doc_id), str(r.text)) for r in clean.collect()) == sorted((str(r.doc_id), str(r.text)) for r in read.collect() if (str(r.doc_id), r.text) not in bad)
    clean.write.parquet(f"{folder}/1")
    clean = spark.read.parquet(f"{folder}/1")

    unique = corpus_pipeline.drop_copies(spark, clean, folder)
    assert sorted(norm(r.text) for r in unique.collect()) == sorted({norm(r.text) for r in clean.collect()})
    unique.write.parquet(f"{folder}/2")
    unique = spark.read.parquet(f"{folder}/2")

    apart = corpus_pipeline.drop_near_copies(spark, unique, folder)
    groups = {}
    for r in jaccard_join(unique).collect():
        groups.setdefault(("alone", r.doc_id) if r.group is None else r.group, []).append((r.doc_id is None, r.doc_id or 0))
    want = sorted(str(None if min(g)[0] else min(g)[1]) for g in groups.values())
    assert apart.columns == columns and sorted(str(r.doc_id) for r in apart.collect()) == want
    apart.write.parquet(f"{folder}/3")
    apart = spark.read.parquet(f"{folder}/3")

    mixed = corpus_pipeline.mix_sources(spark, apart, folder)
    from parasol.llm.mixing import mix

    times = {}
    for r in mixed.collect():
        times[str(r.doc_id)] = times.get(str(r.doc_id), 0) + 1
    want = {}
    for r in mix(apart).collect():
        want[str(r.doc_id)] = want.get(str(r.doc_id), 0) + r.copies
    assert mixed.columns == columns and times == {d: c for d, c in want.items() if c}


def test_stages_take_extra_columns_ties_and_repeated_rows(spark, folder):
    """Columns with the stages' own names, one id with several texts, and equal rows, of which one stays."""
    rows = [(1, "same words in a row here", "a")] * 3 + [(1, "quite another text under one id", "a"), (None, None, "b"), (None, None, "b"), (None, "", None), (2, "same words in a  row here", "b"), (3, "x " * 3000, "c"), (3, "x " * 3000, "c")]
    frame = clashing(docs(spark, rows))
    for name in ("__nameid", "__id", "__n", "__mixid", "__copies", "__hit", "__k", "group", "first"):
        frame = frame.withColumn(name, F.lit("x"))
    frame.write.parquet(f"{folder}/extra")
    frame = spark.read.parquet(f"{folder}/extra")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.mix_sources):
        out = stage(spark, frame, folder)
        assert out.columns == frame.columns and out.count() >= 0
    once = corpus_pipeline.drop_copies(spark, frame, folder)
    assert once.columns == frame.columns
    assert sorted((str(r.doc_id), norm(r.text)) for r in once.collect()) == sorted([("None", ""), ("2", norm(rows[0][1])), ("1", norm(rows[3][1])), ("3", "x" * 3000)])
    near = corpus_pipeline.drop_near_copies(spark, frame, folder)
    assert sorted((str(r.doc_id), norm(r.text)) for r in near.collect()) == sorted([("None", "")] * 3 + [("1", norm(rows[0][1])), ("1", norm(rows[3][1])), ("3", "x" * 3000)])
    assert corpus_pipeline.pack_sequences(spark, frame, folder).count() >= len(rows)


def test_mixing_sends_only_texts_that_are_not_taken_as_usual(spark, tmp_path):
    """Before, all texts were shuffled to meet their plan once that was too large to broadcast."""
    rows = [(i, "w " * (3 + i % 5), "abc"[i % 3]) for i in range(600)] + [(600, "same size", None), (600, "same count", None), (None, "no id", "a")]
    docs(spark, rows).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    from parasol.llm.mixing import mix

    want = {}
    for r in mix(frame).collect():
        want[str(r.doc_id)] = want.get(str(r.doc_id), 0) + r.copies
    mixed = corpus_pipeline.mix_sources(spark, frame, str(tmp_path))
    got = {}
    for r in mixed.collect():
        got[str(r.doc_id)] = got.get(str(r.doc_id), 0) + 1
    assert got == {d: c for d, c in want.items() if c}
    assert "__hit" in mixed._jdf.queryExecution().analyzed().toString()
    plan = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("a", 2, 1), ("b", 2, 5), (None, 3, 1)], "s string, c long, r long")
    assert sorted(corpus_pipeline._usual(plan, "s", "c", "r", "p").collect(), key=str) == sorted([("a", 1), ("b", None), (None, 3)], key=str)


def test_run_packs_what_is_left(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    sums = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert out.count() > 0 and sums.where("n > 2048").count() == 0


def test_stages_take_an_empty_table(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names_and_plans_that_may_be_many_are_not_broadcast(spark, monkeypatch):
    """The optimizer would broadcast these small files; beyond SMALL rows they are shuffled, with the same rows."""
    import parasol.llm.common as C
    from corpus_pipeline import NAME, _keep, _named, mix_sources
    from parasol.session import save_table

    frame = save_table(docs(spark, [(i, f"text {'of words ' * (i % 5)}{i}", "ab"[i % 2]) for i in range(8)] * 2), "twice")
    named = _named(frame)
    names = named.select(*NAME).distinct()
    gone, again = (save_table(names.where(w), "names") for w in ("name_id < 4", "name_id >= 4"))
    few = sorted(r.doc_id for r in mix_sources(spark, frame, "").collect())
    monkeypatch.setattr(C, "SMALL", 1)
    kept = _keep(named, gone, again)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("SortMergeJoin" in line for line in semi)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7]
    assert sorted(r.doc_id for r in mix_sources(spark, frame, "").collect()) == few
