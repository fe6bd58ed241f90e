"""Exact dedup, near-duplicate embeddings and the Jaccard join against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from parasol.llm.common import Trees, attach, components, key_filter, linked, may_match, meeting, tiles, without
from parasol.llm.embedding_dedup import code, embedding_dedup, join_near, words_for
from parasol.llm.exact_dedup import compact, exact_dedup, flush, hits, merge, write_log
from parasol.llm.jaccard import SKETCH, CountTree, Shingler, first_groups, folded, jaccard_join, needed, point, resolution, spanning
from parasol.session import save_table
from tests.llm.helpers import awkward, clashing, docs


class Forest:
    """Union-find over 0..n-1 that keeps the smallest member as root."""

    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


@pytest.mark.parametrize("digest,memtable", [(F.xxhash64, 1 << 20), (F.xxhash64, 2), (lambda n: F.length(n) % 5, 8)], ids=["good", "small tables", "weak"])
def test_exact_dedup_of_awkward_rows(spark, digest, memtable):
    rows = awkward() + [(i, "hot text", "a") for i in range(1000, 1060)]
    got = exact_dedup(clashing(docs(spark, rows)), digest, memtable=memtable).collect()
    assert len(got) == len(rows)
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d or 0))
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): sorted(v) for k, v in groups.items()}
    for r in got:
        g = by_sha[r.text_sha256]
        keep = None if g[0][1] else g[0][2]
        assert (r.keep_id, r.group_size) == (keep, len(g))
    for sha, g in by_sha.items():
        kept = [r for r in got if r.text_sha256 == sha and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == (None if g[0][1] else g[0][2])
    assert exact_dedup(docs(spark, []), digest).count() == 0


def test_exact_dedup_breaks_ties_by_id_and_then_row(spark):
    rows = [(9, "a b", "s"), (4, "a\tb", "s"), (4, "a b", "s"), (None, "b a", "s"), (None, "b a", "s"), (2, "ab", "s")]
    got = exact_dedup(docs(spark, rows).withColumn("nr", F.monotonically_increasing_id()), carry=("nr",)).collect()
    assert len({r.nr for r in got}) == 6 and [r.kept for r in got].count(True) == 2
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {4, None} and {r.group_size for r in got if r.doc_id == 2} == {4}


def entries(index):
    return {(r.digest, r.best.d, r.group_size) for r in index.collect()}


def test_runs_merge_level_by_level_to_one_index(spark):
    rows = awkward() * 2
    log = write_log(docs(spark, rows).repartition(3))
    want = entries(log.groupBy("digest").agg(F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row").alias("r"))).alias("best"), F.count("*").alias("group_size")).where("group_size > 1"))
    runs = flush(log, 4)
    assert runs.select("run").distinct().count() > 20
    few = compact(runs, 3)
    assert few.select("run").distinct().count() <= 3
    assert entries(hits(few)) == want
    # Batches that are indexed apart and put together are one index.
    low, high = (flush(log.where(F.pmod("row", F.lit(2)) == k), 4) for k in (0, 1))
    assert entries(hits(compact(merge(low, high.withColumn("run", F.col("run") + (1 << 40))), 3))) == want


def test_dedup_needs_its_filters(spark, monkeypatch):
    """With the runs' filters emptied, copies in different runs stay apart: what meets is decided by them."""
    import parasol.llm.exact_dedup as E

    log = write_log(docs(spark, [(i, "same", "s") for i in range(6)]).repartition(1))
    runs = compact(flush(log, 2), 8)
    assert hits(runs).count() == 1 and hits(runs).first().group_size == 6
    monkeypatch.setattr(E, "key_filter", lambda rows, key, n, *by: key_filter(rows.where("false"), key, n, *by))
    assert all(r.group_size == 2 for r in runs.collect()) and hits(runs.where("run = 0").withColumn("group_size", F.lit(1).cast("long"))).count() == 0


def test_filters_keep_what_they_hold(spark):
    keys = save_table(spark.range(0, 3000, 3).select((F.col("id") * 7919 - 5000).alias("k")), "keys")
    rows = spark.range(3000).select((F.col("id") * 7919 - 5000).alias("k"), F.lit("x").alias("word"))
    found = may_match(rows, key_filter(keys, "k", 1000), "k", 1000)
    assert found.join(keys, "k").count() == 1000 and found.count() < 1400
    assert {r.k for r in without(rows, keys, ["k"]).collect()} == {i * 7919 - 5000 for i in range(3000) if i % 3}
    assert without(rows.union(spark.sql("select cast(null as long), 'y'")), keys, ["k"]).where("k is null").count() == 1
    met = meeting(save_table(spark.range(100).select(F.pmod("id", F.lit(60)).alias("a"), "id"), "met"), ["a"], "m")
    assert met.count() == 80 and met.where("m <> 2").count() == 0


def test_linked_joins_what_hangs_together(spark):
    """Large keys: a group that all links, two that don't link, and members that link to one other member only."""
    import pandas as pd

    like = {("one", i): 0 for i in range(90)} | {("two", i): i % 2 for i in range(100, 160)} | {("odd", i): i // 2 if i < 210 else 7 for i in range(200, 260)} | {("few", i): i % 3 for i in range(300, 306)}
    number = {k: i for i, k in enumerate(("one", "two", "odd", "few"))}
    sizes = {k: sum(x[0] == k for x in like) for k in number}
    members = save_table(spark.createDataFrame([(number[k], i, sizes[k]) for k, i in like], "key long, cid long, m long").withColumn("label", F.col("cid")), "members")

    def edges(rows):
        def run(g):
            out, t = [], g.to_dict("records")
            assert len(t) <= 40
            for x in t:
                for y in t:
                    if x["cid"] < y["cid"] and value[x["cid"]] == value[y["cid"]]:
                        out.append((x["cid"], y["cid"]))
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        value = {i: (k, v) for (k, i), v in like.items()}
        return rows.groupBy("key", "ti", "tj").applyInPandas(run, "a long, b long")

    forest = Forest(400)
    for r in linked(members, 8, 2, edges).collect():
        forest.join(r.a, r.b)
    for (k, i), v in like.items():
        for (k2, j), v2 in like.items():
            assert (forest.root(i) == forest.root(j)) == (k == k2 and v == v2), (k, i, j)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(40)] + [(7, 7)]
    forest = Forest(300)
    for a, b in pairs:
        forest.join(a, b)
    got = {r.id: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: forest.root(x) for p in pairs for x in p if p[0] != p[1] or any(x in q and q[0] != q[1] for q in pairs)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_attach_hot_and_cold_keys(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)], "k long, v long")
    classes = rows.groupBy("k").count().withColumn("c", F.col("k") * 2)
    got = attach(rows, classes, ["k"], "count", 3000)
    assert got.count() == 3000 and got.where("c <> 2 * k or c is null").count() == 0


def test_what_may_be_large_is_not_broadcast(spark, monkeypatch):
    """The optimizer would broadcast these small files; at 6 GB such sides hold millions of rows and filled the driver."""
    import parasol.llm.common as C

    rows = save_table(spark.range(3000).select(F.when(F.col("id") % 3 != 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")), "attach-rows")
    classes = save_table(rows.groupBy("k").count().withColumn("c", F.col("k") * 2), "attach-classes")
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    few = attach(rows, classes, ["k"], "count", 3000)
    assert "SortMergeJoin" not in plan(few) and plan(few).count("BroadcastHashJoin") == 1
    monkeypatch.setattr(C, "SMALL", 100)
    many = attach(rows, classes, ["k"], "count", 3000)
    assert plan(many).count("SortMergeJoin") == 1 and plan(many).count("BroadcastHashJoin") == 2  # of the hot keys, in both branches
    assert sorted(many.collect()) == sorted(few.collect()) and many.count() == 3000
    gone = save_table(rows.where("v < 1000").select("v"), "gone-rows")
    left = without(rows, gone, ["v"])
    assert "SortMergeJoin" in plan(left) and {r.v for r in left.collect()} == set(range(1000, 3000))


def test_large_filters_are_broadcast_in_blocks(spark):
    """A row a word made a filter of 4 MB some 50 MB on the driver."""
    keys = save_table(spark.range(300_000).select((F.col("id") * 7919 * 104729 - 5000).alias("k")), "many-keys")
    rows = spark.range(600_000).select((F.col("id") * 7919 * 104729 - 5000).alias("k"), F.lit("x").alias("word"))
    filters = save_table(key_filter(keys, "k", 300_000), "many-filter")
    found = may_match(rows, filters, "k", 300_000)
    assert found.join(keys, "k").count() == 300_000 and found.count() < 400_000 and found.columns == rows.columns
    sizes = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__words" in sizes
    assert without(rows, keys, ["k"]).count() == 300_000


def test_tiles_let_every_pair_meet(spark):
    members = spark.createDataFrame([("big", i, 50) for i in range(50)] + [("small", i, 3) for i in range(3)], "key string, member long, m long")
    dealt = tiles(members, "m", "member", 8).collect()
    seen, sizes = {}, {}
    for r in dealt:
        seen.setdefault((r.key, r.ti, r.tj), []).append(r.member)
    for key, n in (("big", 50), ("small", 3)):
        met = {(a, b) for (k, _, _), v in seen.items() if k == key for a in v for b in v}
        assert len(met) == n * n
    assert max(map(len, seen.values())) < 40, sizes


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute_vectors(rows, threshold=0.93):
    good = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], dtype=np.float32).astype(float) for i in good}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links, forest = [0] * len(rows), Forest(len(rows))
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                forest.join(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[forest.root(i)] = min(least.get(forest.root(i), r[0]), r[0])
    return sorted((str(r[0]), links[i], str(least.get(forest.root(i)))) for i, r in enumerate(rows))


def test_embedding_dedup_of_awkward_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16).tolist(), int(i % 3)) for i in range(60)]
    base = rng.standard_normal(16)
    rows += [(100 + i, (base + 0.12 * rng.standard_normal(16)).tolist(), 1) for i in range(40)]
    rows += [(200 + i, base.tolist(), 1) for i in range(5)] + [(200, base.tolist(), 1), (300, (2 * base).tolist(), 1), (301, base.tolist(), 2), (302, base.tolist(), None)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [float("inf")] + [1.0] * 15, 1), (404, [None] + [1.0] * 15, 1), (405, [], 1), (406, [1.0, 2.0], 1), (407, [1.0, 2.0], 1), (None, base.tolist(), 1), (408, [3.0], 1), (409, [3.0], 1), (410, [1e-30] * 16, 1)]
    got = embedding_dedup(clashing(spark.createDataFrame(rows, VECTORS))).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute_vectors([(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b], c) for a, b, c in rows])
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert embedding_dedup(spark.createDataFrame([], VECTORS)).count() == 0


def lists_of(unit, words):
    i, f = code(unit.shape[1], words).decode(unit)
    return [set(x.tolist()) for x in np.split(f, np.searchsorted(i, np.arange(1, len(unit))))]


@pytest.mark.parametrize("n", [2_000, 50_000, 2_000_000])
def test_filters_find_pairs_at_the_threshold(n):
    """Recall of one pair, without the help of a third vector, at cosines from 0.93 on, with the code for n vectors."""
    rng, dim = np.random.default_rng(4), 64
    x = rng.standard_normal((600, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for cosine, least in ((0.93, 0.94), (0.95, 0.97), (0.98, 0.99)):
        side = rng.standard_normal(x.shape)
        side -= (side * x).sum(axis=1, keepdims=True) * x
        y = cosine * x + (1 - cosine**2) ** 0.5 * side / np.linalg.norm(side, axis=1, keepdims=True)
        mine, others = lists_of(x, words_for(n)), lists_of(y, words_for(n))
        found = np.mean([bool(a & b) for a, b in zip(mine, others, strict=True)])
        assert found >= least, (cosine, found)
        assert 8 <= np.mean([len(s) for s in mine])


def test_comparisons_a_vector_do_not_grow_with_the_table():
    """Vectors that share a filter with one of random ones, at 16 times the table."""
    rng, met = np.random.default_rng(5), []
    for n in (5_000, 80_000):
        x = rng.standard_normal((n, 64))
        _, f = code(64, words_for(n)).decode(x / np.linalg.norm(x, axis=1, keepdims=True))
        sizes = np.unique(f, return_counts=True)[1]
        met.append(float((sizes * (sizes - 1)).sum() / n))
    assert met[1] < 3 * met[0], met  # with a fixed code it is 11 times as many


def test_join_near():
    m = np.eye(6, dtype=bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        m[a, b] = m[b, a] = True
    trees = Trees(np.array([0, 1, 2, 3, 4, 5, 4]))
    join_near(trees, np.arange(6), m)
    assert trees.roots.tolist() == [0, 1, 1, 0, 4, 0, 4] and len(trees.links) == 3


def shingles(text, width=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_jaccard(rows, width=5):
    sets, forest = [shingles(t, width) for _, t, _ in rows], Forest(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                forest.join(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[forest.root(i)] = min(least.get(forest.root(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(least.get(forest.root(i)))) for i, r in enumerate(rows))


def near_copies(rng, base, n, first):
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append((first + i, " ".join(w), "s"))
    return out


def test_jaccard_join_of_awkward_rows(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = awkward(n=40) + near_copies(rng, base, 40, 500) + near_copies(rng, base[:30], 15, 600) + near_copies(rng, base[20:40], 15, 700)
    passage = " ".join(base[:60])
    rows += [(800 + i, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60)), "s") for i in range(20)]
    rows += [(900, "one two three", "s"), (901, "One  TWO three", "s"), (902, "one two", "s"), (903, "É x", "s"), (904, "é x", "s")]
    got = jaccard_join(clashing(docs(spark, rows))).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_jaccard(rows)
    assert jaccard_join(docs(spark, [])).count() == 0
    assert jaccard_join(docs(spark, [(1, None), (2, " ")])).count() == 2


def test_jaccard_join_in_blocks(spark, monkeypatch):
    import parasol.llm.jaccard as J

    monkeypatch.setattr(J, "BLOCK", 7)
    rng = random.Random(6)
    rows = near_copies(rng, [f"w{i}" for i in range(80)], 60, 0) + near_copies(rng, [f"w{i}" for i in range(30, 110)], 30, 100)
    got = jaccard_join(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_jaccard(rows)


@pytest.mark.parametrize("groups", [(128,), (64, 128, 256)])
def test_tree_drops_nothing_that_passes_the_bound(groups):
    """Every pair of one resolution, or of neighbouring ones at the lower of them, that passes is joined."""
    rng = np.random.default_rng(7)
    points = []
    for g in groups:
        base = rng.integers(0, 12, (6, g))
        points += list(np.concatenate([np.maximum(base + rng.integers(-1, 2, base.shape), 0) for _ in range(30)]).astype("u1"))
    forest, sizes = Forest(len(points)), [int(p.sum()) for p in points]
    for i in range(len(points)):
        for j in range(i):
            g = min(len(points[i]), len(points[j]))
            if max(len(points[i]), len(points[j])) <= 2 * g and np.minimum(folded(points[i], g), folded(points[j], g)).sum() >= needed(sizes[i] + sizes[j]):
                forest.join(i, j)
    got = spanning(points)
    assert got.roots.tolist() == [forest.root(i) for i in range(len(points))]
    assert len(CountTree(np.stack(points[:180] if len(groups) == 1 else points[:180])).nodes) > 3
    joined = Trees(np.arange(len(points)) % 6)
    assert len(set(joined.roots.tolist())) == 6 and spanning(points, np.zeros(len(points))).links == []


def test_points_of_unlike_resolution(spark):
    assert [resolution(n) for n in (1, 64, 65, 300, 1024, 1025)] == [64, 64, 128, 512, 1024, 2048]
    s = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2))
    fine = point(s)
    assert fine.sum() == len(s) and len(fine) == 512 and folded(fine, 256).sum() == len(s)
    want = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256)
    assert folded(fine, 256).tolist() == want.tolist()


def test_similar_sets_share_a_first_group():
    """Whatever the ranks are; this is what makes the forest complete."""
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 4, 7, 40, 333):
        ranks = rng.integers(0, 9, SKETCH).astype(np.uint8)
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for _ in range(20):
            drop = rng.integers(0, n // 4 + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, rng.integers(0, n // 4 + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                assert np.intersect1d(first_groups(a, ranks), first_groups(b, ranks)).size


def test_jaccard_join_needs_its_trees(spark, monkeypatch):
    rows = near_copies(random.Random(9), [f"w{i}" for i in range(80)], 6, 0)
    frame = docs(spark, rows)
    assert len({r.component_id for r in jaccard_join(frame).collect()}) < len({shingle_key(t) for _, t, _ in rows})
    import parasol.llm.jaccard as J

    monkeypatch.setattr(J, "spanning", lambda points, *_: Trees(len(points)))
    assert len({r.component_id for r in jaccard_join(frame).collect()}) == len({shingle_key(t) for _, t, _ in rows})


def shingle_key(text):
    return frozenset(shingles(text))


def test_overlap_bound_and_threshold():
    assert needed(200) == 86 and 100 * 86 >= 75 * (200 - 86) and 100 * 85 < 75 * (200 - 85)
    s = Shingler(5).shingles(b"a b c d e f g h")
    assert len(s) == 4 and point(s).sum() == 4


def test_written_tables_leave_no_shuffle_files(spark):
    """Before, they stayed until the driver's garbage was collected, and the next shuffle came on top."""
    import time

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    setting, before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None), shuffles()
    table = save_table(spark.range(5000).repartition(3, "id"), "shuffled")
    end = time.time() + 10
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before and table.count() == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting


def test_copies_send_no_points(spark):
    """Rows of equal sets go by one of them; points of the others are dropped before they are sent."""
    from parasol.llm.jaccard import _again

    rows = spark.createDataFrame([(i, bytes([i % 7]), 9) for i in range(40)], "cid long, digest binary, n long")
    classes = rows.groupBy("digest", "n").agg(F.count("*").alias("copies"), F.min("cid").alias("cid"))
    assert sorted(r.cid for r in _again(rows, classes, 40).collect()) == list(range(7, 40))
    assert _again(rows.where("cid < 7"), classes.where("false"), 7).count() == 0
    plain = spark.createDataFrame([(i, f"one two three four five six seven {i % 3}") for i in range(9)] + [(9, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join(plain).collect()) == [(i, i % 3) for i in range(9)] + [(9, 9)]
