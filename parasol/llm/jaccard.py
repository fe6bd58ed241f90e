"""Jaccard join of documents on word n-grams, with R-trees of count vectors.

Shingles are hashed to groups, and a document is a point: how many of its
shingles fall to each group. Two documents share at most the sum of the
coordinates' minima, and a box of points shares at most what its upper corner
allows, so a tree drops boxes and points whose bound is below the overlap that
the threshold asks for. What is left is verified on the shingles themselves.

A document has about as many groups as shingles, a power of two of them, so that
unlike documents of any length share few. Groups are the first bits of a hash:
to compare documents of unlike resolution, the finer point's groups are added up.
Sets that differ more than twofold never link, so neighbouring ones are enough.

One tree over all documents would not prune: in the dozens of dimensions that
the bound needs, boxes of unlike documents overlap. The index is therefore a
forest, split by finer groups, one for each shingle hash: put a document's
groups in one order, the same for all; of two sets that share three quarters,
the first quarters (and one) share a group. So a document lies in the trees of
the first quarter of its groups, and every pair that may link meets in one. The
order puts groups first that few documents have, by a sketch of all documents'
counts: a passage of many documents comes last and makes no large tree. Nothing
is left to chance: the sketch only decides how large trees are.

Copies (equal shingle sets) are one point. Trees of few points whose points are
the same are one. A tree only says which points hang together, by a spanning
forest, so a group of near copies costs a row each. Before the trees of first
groups, a few trees of points with an equal minimum hash join most near copies;
a group whose points are then all joined needs no tree. The components of those
forests bound the true ones; their texts are read again, and links are verified
exactly within each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from parasol.llm.bpe import Cache
from parasol.llm.common import TILE, Trees, attach, bounded, components, groups, key_filter, linked, marked, may_match, meeting, together, without
from parasol.session import save_table, small_batches

#: Words of a shingle, and the links' least similarity as a fraction.
WORDS = 5
SIMILAR = (75, 100)
#: Coordinates of a point at least.
GROUPS = 64
#: Points of a leaf, points of a tree at most, and points of trees that are compared with each other.
LEAF, BLOCK, FEW = 32, 1000, 64
#: Minimum hashes that join near copies beforehand.
MINIMA = 3
#: Counters of the sketch, and those that travel in one row.
SKETCH, CHUNK = 1 << 20, 1 << 16
CACHE_ENTRIES = 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Turns texts into sorted arrays of the 64-bit hashes of their distinct shingles."""

    def __init__(self, words: int) -> None:
        self.width, self.words = words, Cache(xxhash.xxh3_64_intdigest)

    def shingles(self, text: bytes | None) -> np.ndarray:
        """A text of fewer words than a shingle is one shingle, one without words has none."""
        found = (text or b"").lower().split()  # bytes: ASCII letters and white space only
        if len(self.words) > CACHE_ENTRIES:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, found), dtype=np.uint64, count=len(found))
        if not len(h):
            return h
        width = min(self.width, len(h))
        gram = h[: len(h) - width + 1] + np.uint64(width)
        for i in range(1, width):
            gram = (gram ^ (gram >> np.uint64(29))) * _MIX + h[i : len(h) - width + 1 + i]
        gram = (gram ^ (gram >> np.uint64(32))) * _MIX
        return np.unique(gram ^ (gram >> np.uint64(29)))


def resolution(n: int) -> int:
    """The number of groups of a document of ``n`` shingles."""
    return max(GROUPS, 1 << (n - 1).bit_length())


def point(shingles: np.ndarray) -> np.ndarray:
    """The count vector: the shingles by the top bits of their hashes; of one byte a group if that is enough."""
    groups = resolution(len(shingles))
    counts = np.bincount((shingles >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)
    return counts.astype("u1" if counts.max() < 256 else "<u4")


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """A point at a lower resolution."""
    return p if len(p) == groups else p.reshape(groups, -1).sum(axis=1)


def counter_of(shingles: np.ndarray) -> np.ndarray:
    """The sketch's counter of each shingle."""
    return ((shingles * _MIX) >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)


def first_groups(shingles: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The groups (int64) of which a set that is similar to this one has one among its own: the first of all by rank and hash."""
    s, whole = SIMILAR
    n = len(shingles) - -(-s * len(shingles) // whole) + 1
    order = np.argsort(ranks[counter_of(shingles)], kind="stable")  # the hashes ascend, so they break ties
    return shingles[order[:n]].view(np.int64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least shingles by MINIMA hashes, as int64."""
    return np.array([int((shingles * (_MIX + np.uint64(2 * k + 2))).min()) for k in range(MINIMA)], dtype=np.uint64).view(np.int64)


def needed(total):
    """The overlap that two sets of ``total`` elements together need: s / (1 + s) of it, rounded up."""
    s, whole = SIMILAR
    return -((-s * total) // (s + whole))


class CountTree:
    """An R-tree over count vectors, bulk loaded by halving along the widest coordinate."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.sizes = points.sum(axis=1, dtype=np.int64)
        self.order = np.arange(len(points))  # the members of a node are a slice of it
        self.nodes: list[tuple] = []  # upper corner, least size, largest size, slice, children
        self.root = self._build(0, len(points))

    def _build(self, lo: int, hi: int) -> int:
        members = self.order[lo:hi]
        box, sizes = self.points[members], self.sizes[members]
        below = ()
        if hi - lo > LEAF:
            spread = np.append((box.max(axis=0) - box.min(axis=0)).astype(np.int64), sizes.max() - sizes.min())
            axis, half = int(spread.argmax()), (lo + hi) // 2
            self.order[lo:hi] = members[np.argsort(sizes if axis == box.shape[1] else box[:, axis], kind="stable")]
            below = (self._build(lo, half), self._build(half, hi))
        self.nodes.append((box.max(axis=0), int(sizes.min()), int(sizes.max()), lo, hi, below))
        return len(self.nodes) - 1

    def near(self, i: int, trees: Trees, names: np.ndarray):
        """Members j that may be similar to i and are not joined to it in ``trees``, where members go by ``names``."""
        q, n, stack = self.points[i], int(self.sizes[i]), [self.root]
        s, whole = SIMILAR
        while stack:
            upper, least, most, lo, hi, below = self.nodes[stack.pop()]
            if whole * most < s * n or s * least > whole * n or np.minimum(q, upper).sum(dtype=np.int64) < needed(n + least):
                continue
            members = self.order[lo:hi]
            rest = members[trees.roots[names[members]] != trees.roots[names[i]]]
            if not len(rest):
                continue
            if below:
                stack += below
                continue
            shared = np.minimum(self.points[rest], q).sum(axis=1, dtype=np.int64)
            yield from rest[shared >= needed(n + self.sizes[rest])].tolist()


def spanning(points: list[np.ndarray], labels: np.ndarray | None = None, similar=None) -> Trees:
    """Trees that the pairs join that pass the bound and, if given, ``similar(i, j)``.

    One R-tree for each resolution, of its points and of those of the next finer
    one; the former ask it.
    """
    trees = Trees(len(points) if labels is None else labels)
    groups_of = np.array([len(p) for p in points], dtype=np.int64)
    for groups in np.unique(groups_of).tolist():
        own, finer = np.flatnonzero(groups_of == groups), np.flatnonzero(groups_of == 2 * groups)
        members = np.concatenate([own, finer])
        if len(members) < 2 or len(np.unique(trees.roots[members])) < 2:
            continue
        index = CountTree(np.stack([folded(points[m], groups) for m in members]))
        for i in range(len(own)):
            mine = members[i]
            for j in index.near(i, trees, members):
                other = members[j]
                if trees.roots[mine] != trees.roots[other] and (similar is None or similar(mine, other)):
                    trees.join(mine, other)
    return trees


def _edges(batches, trees_of):
    """Runs ``trees_of`` on each tile and yields the links that it made as rows a, b of ids."""
    for t in groups(batches, TILE):
        ids, links = t.column("cid").to_numpy(), trees_of(t).links
        if links:
            a, b = np.array(links, dtype=np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], ["a", "b"])


def pressed(p: np.ndarray) -> bytes:
    """A point's bytes, which are mostly zeros and ones in no order, by Huffman codes for the way."""
    pack = zlib.compressobj(9, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return pack.compress(p.tobytes()) + pack.flush()


def points_of(counts: pa.ChunkedArray, n: pa.ChunkedArray) -> list[np.ndarray]:
    """The count vectors of documents with ``n`` shingles."""
    raw = [(zlib.decompress(c, -15), resolution(k)) for c, k in zip(counts.to_pylist(), n.to_pylist(), strict=True)]
    return [np.frombuffer(c, "u1" if len(c) == groups else "<u4") for c, groups in raw]


def group_ranks(texts: DataFrame, words: int) -> np.ndarray:
    """How many documents have the shingles of each counter, as a rank of one byte; ``texts``: one binary column.

    Every task counts in a sketch of fixed size; the driver gets SKETCH bytes.
    """
    def count(batches):
        shingles, n = Shingler(words).shingles, np.zeros(SKETCH, dtype="<u4")
        for b in batches:
            for text in b.column(0).to_pylist():
                n[counter_of(shingles(text))] += 1  # a document counts once for each counter
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [(k, pack(n[k * CHUNK : (k + 1) * CHUNK].tobytes())) for k in range(SKETCH // CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["chunk", "n"])

    def add(batches):
        sums, unpack = {}, zstandard.ZstdDecompressor().decompress
        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(unpack(n), "<u4").astype(np.int64)
        ranks = [np.floor(4 * np.log2(n + 1.0)).astype(np.uint8).tobytes() for n in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array(ranks, pa.binary())], ["chunk", "ranks"])

    counted = texts.mapInArrow(count, "chunk int, n binary").repartition("chunk").mapInArrow(add, "chunk int, ranks binary")
    out = np.zeros(SKETCH, dtype=np.uint8)
    for k, r in counted.collect():
        out[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(r, np.uint8)
    return out


def _once(met: DataFrame) -> DataFrame:
    """Keys (key, cid, label, m), written; of keys with at most FEW rows that have the same ones, one stays."""
    few = met.where(F.col("m") <= FEW).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("cid", "label"))).alias("rows"))
    few = few.groupBy("rows").agg(F.min("key").alias("key")).select("key", F.explode("rows").alias("r"), F.size("rows").cast("long").alias("m"))
    few = few.select("key", "r.cid", "r.label", "m")
    return save_table(few.unionByName(met.where(F.col("m") > FEW).select("key", "cid", "label", "m")), "jaccard-forest")


def _again(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """The cid of every row but the one that its class (digest, n) goes by, written."""
    several = classes.where("copies > 1").select("digest", "n", "copies", F.col("cid").alias("by"))
    n = several.count()
    filters = save_table(key_filter(several.select(F.xxhash64("digest").alias("__k")), "__k", n), "jaccard-copies-filter")
    likely = may_match(rows.select("cid", "digest", "n", F.xxhash64("digest").alias("__k")), filters, "__k", n).drop("__k")
    return save_table(attach(likely, several, ["digest", "n"], "copies", total, "inner").where("cid <> by").select("cid"), "jaccard-again")


def jaccard_join(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, group, and the columns of ``carry``.

    A document's set is its distinct shingles of ``words`` words (ASCII letters
    in lower case), by 64-bit hashes; with fewer words it is the whole sequence.
    Documents link when the Jaccard similarity of their sets is at least 0.75;
    component_id is the smallest id reachable by links. Null and wordless texts
    have 0 shingles and link with nothing, so their component is their own id.
    Null ids pass through: they link like others, and a component with null ids
    only has a null id. Repeated rows and ids are documents of their own. group
    numbers components, also those that share their smallest id with another; it
    is null for sets that are empty. Other columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("th"), *carry)
    ranks = spark.sparkContext.broadcast(group_ranks(texts.select("text"), words))

    def describe(batches):
        shingles = Shingler(words).shingles
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                s = shingles(text)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), pressed(point(s)), first_groups(s, ranks.value), minima(s)) if len(s) else (0, b"", b"", [], []))
            n, digest, counts, first, least = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *b.columns[2:], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(counts, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (first, least))],
                ["doc_id", "th", *carry, "n", "digest", "counts", "first", "least"],
            )

    carried = "".join(f"`{c}` {t}, " for c, t in texts.dtypes if c in carry)
    described = texts.mapInArrow(describe, f"doc_id long, th long, {carried}n long, digest binary, counts binary, first array<long>, least array<long>")
    rows = save_table(described.withColumn("cid", F.monotonically_increasing_id()), "jaccard-rows")
    total = rows.count()
    own = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    # A class goes by one of its rows, whose points are the class's; only copies are told apart from that row, so points of others aren't sent.
    classes = rows.where("n > 0").groupBy("digest", "n").agg(own.alias("own"), F.count("*").alias("copies"), F.min("cid").alias("cid"))
    classes = save_table(classes, "jaccard-classes")
    described = rows.where("n > 0").select("cid", "n", "counts", "first", "least")
    points = save_table(without(described, _again(rows.where("n > 0"), classes, total), ["cid"]), "jaccard-points")

    def bound(batches):
        yield from _edges(batches, lambda t: spanning(points_of(t.column("counts"), t.column("n")), t.column("label").to_numpy()))

    def by_points(placed: DataFrame) -> DataFrame:
        return together(placed.join(bounded(points.select("cid", "n", "counts"), total), "cid").select(*TILE, "cid", "label", "n", "counts"), TILE).mapInArrow(bound, "a long, b long")

    # Near copies beforehand: classes with an equal minimum hash.
    alike = save_table(points.select("cid", F.explode("least").alias("key")), "jaccard-minima")
    near = save_table(meeting(alike, ["key"], "m").withColumn("label", F.col("cid")), "jaccard-near")
    near_links = linked(_once(near), BLOCK, 1, by_points)
    joined = save_table(components(near_links).select(F.col("id").alias("cid"), F.col("comp").alias("label")), "jaccard-joined")

    # The forest: classes that share one of their first groups, if they are not all joined. Groups of one class are dropped before points are sent.
    n = joined.count()
    split = marked(points.select("cid", "first"), save_table(key_filter(joined, "cid", n), "jaccard-joined-filter"), "cid", n, "left").select("cid", "first", "__hit")
    named = split.where("__hit").drop("__hit").join(bounded(joined, n), "cid", "left").unionByName(split.where("not __hit").drop("__hit").withColumn("label", F.lit(None).cast("long")))
    keyed = named.select("cid", F.coalesce("label", "cid").alias("label"), F.explode("first").alias("key"))
    met = save_table(meeting(keyed, ["key"], "m", "label"), "jaccard-met")
    links = near_links.unionByName(linked(_once(met), BLOCK, 0, by_points))
    maybe = save_table(components(links).select(F.col("id").alias("cid"), F.col("comp").alias("key")), "jaccard-maybe")

    # The texts of one document of each class of these components, verified within them.
    members = save_table(attach(maybe, maybe.groupBy("key").agg(F.count("*").alias("m")), ["key"], "m", maybe.count()).select("key", "cid", F.col("cid").alias("label"), "m"), "jaccard-members")
    wanted = save_table(members.join(bounded(classes.select("cid", "own", "digest"), total), "cid").select("cid", F.col("own.doc_id").alias("want"), F.col("own.th").alias("th"), "digest"), "jaccard-wanted")
    # Most texts are in no such component; a filter drops them before they are sent.
    n = wanted.count()
    likely = may_match(texts, save_table(key_filter(wanted, "th", n), "jaccard-filter"), "th", n)
    found = likely.join(bounded(wanted, n), (likely["th"] == wanted["th"]) & likely["doc_id"].eqNullSafe(wanted["want"])).select("cid", "text", "digest")
    found = save_table(found.dropDuplicates(["cid"]), "jaccard-texts")  # repeated rows

    def verify(batches):
        shingles = Shingler(words).shingles
        whole = SIMILAR[0] + SIMILAR[1]

        def trees(t: pa.Table) -> Trees:
            sets = [shingles(x.as_py()) for x in t.column("text")]
            # A 64-bit text hash and an id name the text; the digest of the set proves it.
            for s, d in zip(sets, t.column("digest").to_pylist(), strict=True):
                if xxhash.xxh3_128_digest(s.tobytes()) != d:
                    raise ValueError("a text is not the one that its class was made from")

            def similar(i: int, j: int) -> bool:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                return whole * shared >= SIMILAR[0] * (len(sets[i]) + len(sets[j]))

            return spanning([point(s) for s in sets], t.column("label").to_numpy(), similar)

        yield from _edges(batches, trees)

    def by_texts(placed: DataFrame) -> DataFrame:
        return together(placed.join(bounded(found, n), "cid").select(*TILE, "cid", "label", "text", "digest"), TILE).mapInArrow(verify, "a long, b long")

    links = components(linked(members, BLOCK, 2, by_texts))
    named = classes.select("cid", "digest", "n", "copies", F.col("own.doc_id").alias("first_id")).join(bounded(links.withColumnRenamed("id", "cid"), n), "cid", "left")
    named = save_table(named, "jaccard-named")
    least = named.where("comp is not null").groupBy("comp").agg(F.min("first_id").alias("least_id"), F.count("*").alias("m"))
    in_tree = attach(named.where("comp is not null"), least, ["comp"], "m", total).select("digest", "n", "copies", F.coalesce("least_id", "first_id").alias("component_id"), F.col("comp").alias("group"))
    every = in_tree.unionByName(named.where("comp is null").select("digest", "n", "copies", F.col("first_id").alias("component_id"), F.col("cid").alias("group")))
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"), *carry)
    done = attach(rows.where("n > 0").select("doc_id", "digest", "n", *carry), every, ["digest", "n"], "copies", total)
    return done.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "group", *carry).unionByName(alone)
