"""Near-duplicate embeddings by spherical-cap filters from a structured random product code.

A filter is a unit vector whose halves are two code words, each out of W random
ones, after a random rotation, so W**2 directions need 2 * W inner products. A
vector is list-decoded to all directions that it exceeds a cap's height with:
the halves' products are bounded by the other half's best, and only promising
code words are combined. Vectors at a small angle exceed some filter together;
those that share one are compared in double precision.

W grows with the root of the number of vectors, so a filter has about as many
members in a table of any size, and the height is set so that a pair at the
threshold shares a filter with probability RECALL.

Filters only have to connect: each tile of vectors that share a filter says
which of them hang together by verified links. All links of a vector lie in its
component, so they are counted there, by matrix products between blocks, and no
pair is written out. Exact copies are one point with a weight.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from parasol.llm.common import TILE, Trees, attach, components, groups, linked, meeting, tiles, together
from parasol.session import save_table, small_batches

#: Code words of each half at least, and filters (W**2 of them) for each vector of one label.
LEAST_WORDS, FILTERS = 32, 16
#: Share of pairs at the threshold that must share a filter, and filters that any vector gets at least.
RECALL, LEAST_LIST = 0.97, 8
THRESHOLD = 0.93
#: Members of a block; a tile holds about one.
BLOCK = 1000


def words_for(n: int) -> int:
    """Code words of each half for ``n`` vectors."""
    return max(LEAST_WORDS, ceil((n * FILTERS) ** 0.5))


class ProductCode:
    """The filters for vectors of ``dim`` components; the same in every task."""

    #: Pairs that the height is set by, and code words of each half that are tried for them.
    PAIRS, TRIED = 400, 128

    def __init__(self, dim: int, words: int, threshold: float = THRESHOLD) -> None:
        rng = np.random.default_rng(dim)
        self.dim, self.half, self.n = dim, (dim + 1) // 2, words
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        drawn = rng.standard_normal((2, words, self.half))
        self.words = drawn / np.linalg.norm(drawn, axis=2, keepdims=True)
        x, side = rng.standard_normal((2, self.PAIRS, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        side -= (side * x).sum(axis=1, keepdims=True) * x
        length = np.linalg.norm(side, axis=1, keepdims=True)
        y = threshold * x + (1 - threshold**2) ** 0.5 * side / np.where(length > 1e-9, length, 1.0)
        # The filter that both exceed by most; those with small sums are left out, which can only lower the height.
        pairs, t, best = list(zip(*self._sums(x), *self._sums(y), strict=True)), min(self.TRIED, words), []
        for ax, bx, ay, by in pairs:
            i, j = np.argpartition(ax + ay, words - t)[-t:], np.argpartition(bx + by, words - t)[-t:]
            best.append(np.minimum(ax[i][:, None] + bx[j], ay[i][:, None] + by[j]).max())
        self.height = float(np.quantile(best, 1 - RECALL))

    def _sums(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = np.zeros((len(unit), 2 * self.half))
        turned[:, : self.dim] = unit @ self.rotation
        return turned[:, : self.half] @ self.words[0].T, turned[:, self.half :] @ self.words[1].T

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) for every filter that a vector exceeds ``height`` with, and at least its LEAST_LIST best."""
        step, parts = max(1, (1 << 20) // self.n), []  # bounds the products that are held at a time
        for at in range(0, len(unit), step):
            a, b = self._sums(unit[at : at + step])
            k = min(LEAST_LIST, self.n)
            tops = np.partition(a, self.n - k, axis=1)[:, -k:, None] + np.partition(b, self.n - k, axis=1)[:, None, -k:]
            best = np.partition(tops.reshape(len(a), -1), k * k - k, axis=1)[:, -k]
            floor = np.minimum(best, self.height) - 1e-12
            v, i = np.nonzero(a + b.max(axis=1, keepdims=True) >= floor[:, None])
            for some in np.array_split(np.arange(len(v)), max(1, len(v) * self.n >> 22)):
                w, j = np.nonzero(a[v[some], i[some]][:, None] + b[v[some]] >= floor[v[some]][:, None])
                parts.append((v[some][w] + at, i[some][w] * self.n + j))
        return tuple(np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in (0, 1))


@lru_cache(maxsize=8)
def code(dim: int, words: int, threshold: float = THRESHOLD) -> ProductCode:
    return ProductCode(dim, words, threshold)


def unit_rows(column, dtype: str) -> np.ndarray:
    """The vectors of a binary column, in double precision, at length 1."""
    x = np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1).astype(np.float64)
    return x / scaled_norm(x)


def scaled_norm(x: np.ndarray) -> np.ndarray:
    """Row norms that neither overflow nor vanish."""
    top = np.abs(x).max(axis=1, keepdims=True)
    return top * np.linalg.norm(x / top, axis=1, keepdims=True)


def join_near(trees: Trees, at: np.ndarray, near: np.ndarray) -> None:
    """Joins the members ``at`` by a symmetric boolean matrix of them."""
    for i, row in zip(at, near, strict=True):
        for j in at[row & (trees.roots[at] != trees.roots[i])]:
            trees.join(i, j)


def embedding_dedup(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors of equal labels and lengths link when their cosine is at least
    ``threshold``. A null label, and a vector that is null, empty, zero or holds
    a null, NaN or infinity, links with nothing: 0 links, its own id. n_links
    counts other rows, repeated rows and ids among them. component_id is the
    smallest id that links reach; kept says that it is the row's own (false for
    a null id). Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(vectors.sparkSession)
    element = vectors.schema[vector_col].dataType.elementType.typeName()
    dtype = "<f4" if element == "float" else "<f8"
    column, label = F.col(vector_col), F.col(label_col)
    good = F.coalesce(
        label.isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(column, lambda x: x != 0), F.lit(False)
    )
    chosen = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.when(good, column).alias("v"))

    def describe(batches):
        for b in batches:
            raw = [None if v is None else (np.array(v, dtype=dtype) + 0.0).tobytes() for v in b.column(2).to_pylist()]
            digest = [None if r is None else xxhash.xxh3_128_digest(r) for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "label", "digest", "vec"])

    label_type = vectors.schema[label_col].dataType.simpleString()
    rows = save_table(chosen.mapInArrow(describe, f"vec_id long, label {label_type}, digest binary, vec binary"), "vector-rows")
    total = rows.count()
    alike = ["label", "digest"]
    classes = rows.where("vec is not null").groupBy(*alike).agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = save_table(classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.length("vec")), "vector-classes")

    kind = ["label", "dim"]
    most = classes.groupBy(*kind).count().agg(F.max("count")).first()[0] or 0
    n_words = words_for(most)

    def decode(batches):
        width = np.dtype(dtype).itemsize
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                v, f = code(int(dim) // width, n_words, threshold).decode(unit_rows(part.column(2), dtype))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(v)), part.column(3).take(pa.array(v)), pa.array(f)], ["cid", "kind", "f"])

    described = classes.select("cid", "dim", "vec", F.xxhash64(*kind).alias("kind"))
    keyed = save_table(described.mapInArrow(decode, "cid long, kind long, f long").select("cid", F.xxhash64("kind", "f").alias("key")), "vector-filters")
    met = save_table(meeting(keyed, ["key"], "m").select("key", "cid", F.col("cid").alias("label"), "m"), "vector-met")

    def compare(batches):
        for t in groups(batches, TILE):
            ids, trees = t.column("cid").to_numpy(), Trees(t.column("label").to_numpy())
            # Hashed keys may bring several labels or lengths together, which never link.
            kinds = np.unique([f"{k.as_py()}" for k in t.column("own")], return_inverse=True)[1]
            for k in np.unique(kinds):
                at = np.flatnonzero(kinds == k)
                x = unit_rows(t.column("vec").take(pa.array(at)), dtype)
                join_near(trees, at, x @ x.T >= threshold)
            if trees.links:
                a, b = np.array(trees.links, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    own = F.to_json(F.struct(*kind)).alias("own")

    def by_vectors(placed: DataFrame) -> DataFrame:
        return together(placed.join(classes.select("cid", own, "vec"), "cid").select(*TILE, "cid", "label", "own", "vec"), TILE).mapInArrow(compare, "a long, b long")

    found = save_table(components(linked(met, BLOCK, 1, by_vectors)), "vector-links")
    sizes = found.groupBy("comp").agg(F.count("*").alias("m"))
    found = save_table(attach(found, sizes, ["comp"], "m", found.count()).select(F.col("id").alias("cid"), "comp", "m"), "vector-components")

    # All links lie within components: count them block by block.
    tile2 = ["comp", "ti", "tj"]
    inside = tiles(found, "m", "cid", BLOCK).join(classes.select("cid", "vec", "copies"), "cid").select(*tile2, "block", "cid", "vec", "copies")

    def count(batches):
        for t in groups(batches, tile2):
            x, copies, block = unit_rows(t.column("vec"), dtype), t.column("copies").to_numpy(), t.column("block").to_numpy()
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if t.column("ti")[0] != t.column("tj")[0]:
                near &= block[:, None] != block[None, :]
            yield pa.RecordBatch.from_arrays([t.column("cid").combine_chunks(), pa.array(near @ copies)], ["cid", "n"])

    counts = together(inside, tile2).mapInArrow(count, "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n"))
    full = save_table(classes.drop("vec").join(found.select("cid", "comp"), "cid", "left").join(counts, "cid", "left"), "vector-full")
    least = full.where("comp is not null").groupBy("comp").agg(F.min("first_id").alias("least_id"), F.count("*").alias("m"))
    in_tree = attach(full.where("comp is not null"), least, ["comp"], "m", total).drop("m")
    full = in_tree.unionByName(full.where("comp is null").withColumn("least_id", F.lit(None).cast("long")))
    result = full.select(*alike, "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least_id", "first_id").alias("component_id"))
    done = attach(rows.where("vec is not null").select("vec_id", *alike), result, alike, "copies", total).select("vec_id", "n_links", "component_id")
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
