"""Which points shadows reach at many positions of the sun, tile by tile.

A task streams tiles: first a tile's heights and towers, then its points in
batches. So hops and slots are loops over arrays and never become rows, and a
tile with many points is several blocks, each with the tile's heights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parasol.functions.geometry import cell
from parasol.operators.skew import shuffled

#: Cells of a tile's side, points of a block and of one pass over the slots, and metres by which a tower's shadow is grown before the exact test.
TILE, BLOCK, PASS, SLACK_M = 64, 5000, 1000, 1e-3
_ROW = ("tx", "ty", "block", "kind", "id", "edge_id", "a", "b", "c", "d")
SCHEMA = "point_id long, edge_id long, px double, py double, slot long, tower long"


def _tiles(low: Column, high: Column, side: float) -> Column:
    return F.explode(F.sequence(F.floor(low / side), F.floor(high / side)))


def reached(points: DataFrame, grid: DataFrame, towers: DataFrame, slots: list, size: float, step: float, reach: float, most: float) -> DataFrame:
    """Rows (SCHEMA) of points (point_id, edge_id, px, py) and slots: in the march's shadow (tower is null), else perhaps in that of a tower.

    grid: cx, cy, height; towers: tower, mx, my, r, height, whose shadows of up to
    ``most`` metres lie within r of their axes; slots: rows of slot, t (the tangent
    of the elevation), sx, sy (towards the sun).
    """
    pad = int(reach // size) + 2
    at = points.where("px is not null and py is not null").withColumns({"tx": F.floor(cell(F.col("px"), size) / TILE), "ty": F.floor(cell(F.col("py"), size) / TILE)})
    blocks = at.groupBy("tx", "ty").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    none, every = F.lit(None), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(shuffled(blocks), ["tx", "ty"])

    cells = grid.withColumn("tx", _tiles(F.col("cx") - pad, F.col("cx") + pad, TILE)).withColumn("ty", _tiles(F.col("cy") - pad, F.col("cy") + pad, TILE))
    far, side = F.col("r") + most + 1, TILE * size
    near = towers.withColumn("tx", _tiles(F.col("mx") - far, F.col("mx") + far, side)).withColumn("ty", _tiles(F.col("my") - far, F.col("my") + far, side))
    parts = (
        placed(cells).select("tx", "ty", every.alias("block"), F.lit(0), none, none, F.col("cx").cast("double"), F.col("cy").cast("double"), F.col("height").cast("double"), none),
        placed(near).select("tx", "ty", every.alias("block"), F.lit(1), "tower", none, "mx", "my", "r", F.col("height").cast("double")),
        placed(at).select("tx", "ty", F.pmod(F.xxhash64("point_id"), F.col("blocks")).alias("block"), F.lit(2), "point_id", "edge_id", "px", "py", none, none),
    )
    rows = parts[0].toDF(*_ROW).unionByName(parts[1].toDF(*_ROW)).unionByName(parts[2].toDF(*_ROW))
    hops = np.arange(1, int(reach // step) + 1) * step
    sun = [(int(s.slot), float(s.t), float(s.sx), float(s.sy)) for s in slots]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heights, tall = None, [], []
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            ends = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for low, high in zip(ends, ends[1:], strict=False):
                if low == high:
                    continue
                tile, kind, part = tuple(key[:3, low]), key[3, low], batch.slice(low, high - low)
                if tile != now:
                    now, heights, tall = tile, [], []
                if kind < 2:
                    (heights, tall)[kind].append(part)
                    continue
                if not isinstance(heights, np.ndarray):
                    heights, tall = _raster(heights, tile, pad), _columns(tall, "id", "a", "b", "c", "d")
                for i in range(0, part.num_rows, PASS):
                    yield from _lit(part.slice(i, PASS), heights, tall, tile, pad, sun, hops, size, most)

    dealt = rows.repartition("tx", "ty", "block").sortWithinPartitions("tx", "ty", "block", "kind")
    return dealt.mapInArrow(run, SCHEMA)


def _columns(parts: list[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    return [np.concatenate([p.column(n).to_numpy(zero_copy_only=False) for p in parts] or [np.empty(0)]) for n in names]


def _raster(parts: list[pa.RecordBatch], tile: tuple, pad: int) -> np.ndarray:
    """Heights of a tile's cells and those about it, minus infinity where there is none."""
    out = np.full((TILE + 2 * pad, TILE + 2 * pad), -np.inf)
    cx, cy, height = _columns(parts, "a", "b", "c")
    out[cx.astype(int) - int(tile[0]) * TILE + pad, cy.astype(int) - int(tile[1]) * TILE + pad] = height
    return out


def _lit(points: pa.RecordBatch, heights: np.ndarray, tall: list[np.ndarray], tile: tuple, pad: int, sun: list[tuple], hops: np.ndarray, size: float, most: float) -> Iterator[pa.RecordBatch]:
    """The points' rows of SCHEMA, slot by slot."""
    px, py = (points.column(c).to_numpy(zero_copy_only=False) for c in "ab")
    top, (tower, mx, my, r, height) = heights.max(), tall
    dx, dy = px[:, None] - mx, py[:, None] - my
    found: list[tuple] = []
    for slot, t, sx, sy in sun:
        far = hops[hops * t <= top]
        cx = np.floor((px[:, None] + far * sx) / size).astype(int) - int(tile[0]) * TILE + pad
        cy = np.floor((py[:, None] + far * sy) / size).astype(int) - int(tile[1]) * TILE + pad
        hit = (heights[cx, cy] >= far * t).any(axis=1)
        found.append((np.flatnonzero(hit), slot, None))
        if len(tower):
            along, aside = -(dx * sx + dy * sy), np.abs(dx * sy - dy * sx)
            maybe = (along >= -r - SLACK_M) & (along <= np.minimum(height / t, most) + r + SLACK_M) & (aside <= r + SLACK_M) & ~hit[:, None]
            i, j = np.nonzero(maybe)
            found.append((i, slot, tower[j]))
    for towers in (False, True):
        mine = [f for f in found if (f[2] is not None) == towers and len(f[0])]
        if mine:
            at = pa.array(np.concatenate([f[0] for f in mine]))
            slots = pa.array(np.concatenate([np.full(len(f[0]), f[1]) for f in mine]), pa.int64())
            by = pa.array(np.concatenate([f[2] for f in mine]).astype(np.int64)) if towers else pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([*(points.column(c).take(at) for c in ("id", "edge_id", "a", "b")), slots, by], ["point_id", "edge_id", "px", "py", "slot", "tower"])
