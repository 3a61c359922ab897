"""Passes over points in a given order, tile by tile, for rules by which earlier points close by decide about later ones.

Points fall into grid cells as tall and wide as the reach of the rule; a tile is a set of cells, the largest of
a pyramid of squares that holds at most TILE_POINTS points, or one cell. In a round every tile goes through
its own undecided points in order, and through the points of other tiles' cells beside it: it decides all
whose earlier neighbours are decided. Further rounds carry decisions over the borders of tiles, so their
number grows with the tiles that a chain of close points crosses, not with its links. The first undecided
point of all is decided in every round, so they end.

A tile is streamed: a task holds what later points may depend on (leaders, markers, undecided points), no
matter how many points share a cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import cut
from .spatial import DEGREE_M, grid_column, grid_columns

#: Points of a tile of more than one cell, at most.
TILE_POINTS = 4096
#: Points that are taken at a time in a tile.
BLOCK = 256


def cells_beside(cells: DataFrame, tall: float) -> DataFrame:
    """cells (cy, cx and more) once for every cell (ny, nx) that may hold a point in reach of theirs, themselves among them."""
    rows = cells.withColumn("ny", F.explode(F.array(F.col("cy") - 1, F.col("cy"), F.col("cy") + 1)))
    n, other = grid_columns(F.col("cy"), tall), grid_columns(F.col("ny"), tall)
    # A cell's stretch of longitudes covers these columns of the rows beside it, and one more on either side.
    first, last = F.floor(F.col("cx") * other / n) - 1, F.floor((F.col("cx") + 1) * other / n) + 1
    return rows.withColumn("nx", F.explode(F.array_distinct(F.transform(F.sequence(first, F.least(last, first + other)), lambda x: F.pmod(x, other)))))


def tiled(points: DataFrame, reach_m: float) -> tuple[DataFrame, DataFrame]:
    """points (part, lat, lon and more) with cy, cx and tile, and the borders: part, cy, cx, to (another tile whose points may be in reach)."""
    tall = reach_m / DEGREE_M
    placed = points.withColumn("cy", F.floor(F.col("lat") / tall)).withColumn("cx", grid_column("lon", grid_columns(F.col("cy"), tall)))
    cells = cut(placed.groupBy("part", "cy", "cx").agg(F.count("*").alias("n")))
    wide = 360.0 / grid_columns(F.col("cy"), tall)
    levels = 1
    while tall * 4**levels < 360:
        levels += 1
    lat, lon = (F.col("cy") + 0.5) * tall, (F.col("cx") + 0.5) * wide - 180
    squares = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.floor(lat / (tall * 4**k)).alias("ky"), F.floor(lon / (tall * 4**k)).alias("kx")) for k in range(1, levels + 1))))
    squares = cells.select("part", "cy", "cx", "n", squares.alias("s")).select("part", "cy", "cx", "n", "s.*")
    small = squares.groupBy("part", "level", "ky", "kx").agg(F.sum("n").alias("n")).where(F.col("n") <= TILE_POINTS).drop("n")
    best = squares.drop("n").join(small, ["part", "level", "ky", "kx"]).groupBy("part", "cy", "cx").agg(F.max(F.struct("level", "ky", "kx")).alias("s"))
    # Two sets of cells that share a number are one tile, which is no harm.
    of = F.when(F.col("s").isNull(), F.xxhash64(F.lit(0), "cy", "cx")).otherwise(F.xxhash64("s.level", "s.ky", "s.kx"))
    cells = cut(cells.join(best, ["part", "cy", "cx"], "left").select("part", "cy", "cx", of.alias("tile")))

    beside = cells_beside(cells, tall)
    to = cells.select("part", F.col("cy").alias("ny"), F.col("cx").alias("nx"), F.col("tile").alias("to"))
    borders = beside.join(to, ["part", "ny", "nx"]).where("to <> tile").select("part", "cy", "cx", "to").distinct()
    return placed.join(cells, ["part", "cy", "cx"]), cut(borders)


class _Tile:
    """One tile's pass; step() takes its points in order, block by block."""

    def step(self, lat: np.ndarray, lon: np.ndarray, block: dict[str, np.ndarray]) -> Iterator[tuple[int, object]]:
        raise NotImplementedError


def _streamed(make: Callable[[], _Tile], fields: tuple[str, ...], kind: pa.DataType, name: str):
    """For mapInArrow: rows sorted by part, tile and order; gives key and what the tile's pass decides for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, None
        for batch in batches:
            part, number = batch["part"].to_numpy(), batch["tile"].to_numpy()
            edges = np.flatnonzero((np.diff(part) != 0) | (np.diff(number) != 0)) + 1 if batch.num_rows else []
            decided: list[tuple[int, object]] = []
            columns = {c: np.asarray(batch[c].to_numpy(zero_copy_only=False)) for c in ("lat", "lon", *fields)}
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a < b and (int(part[a]), int(number[a])) != now:
                    now, tile = (int(part[a]), int(number[a])), make()
                for i in range(a, b, BLOCK):
                    block = {c: v[i : min(b, i + BLOCK)] for c, v in columns.items()}
                    decided += tile.step(block.pop("lat"), block.pop("lon"), block)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in decided], pa.int64()), pa.array([v for _, v in decided], kind)], names=["key", name])

    return run


class _Grown:
    """Coordinates to which more are added one by one."""

    def __init__(self):
        self.n, self.xy = 0, np.zeros((64, 2))

    def add(self, lat: float, lon: float) -> int:
        if self.n == len(self.xy):
            self.xy = np.concatenate([self.xy, np.zeros_like(self.xy)])
        self.xy[self.n] = lat, lon
        self.n += 1
        return self.n - 1

    def seen(self) -> tuple[np.ndarray, np.ndarray]:
        return self.xy[: self.n, 0], self.xy[: self.n, 1]


class LeaderPass(_Tile):
    """A point in reach of an earlier leader is a member; one with an undecided point in reach waits; any other leads."""

    def __init__(self, near: Callable):
        self.near, self.heads, self.waiting = near, _Grown(), _Grown()

    def _any(self, lat: np.ndarray, lon: np.ndarray, of: _Grown) -> np.ndarray:
        out = np.zeros(len(lat), bool)
        y, x = of.seen()
        for i in range(0, of.n, 2048):
            out |= self.near(lat[:, None], lon[:, None], y[None, i : i + 2048], x[None, i : i + 2048]).any(axis=1)
        return out

    def step(self, lat, lon, block):
        key, own, leads = block["key"], block["own"], block["leads"]
        covered, waits, at = self._any(lat, lon, self.heads), self._any(lat, lon, self.waiting), 0
        while at < len(lat):
            free = np.flatnonzero(~covered[at:] | leads[at:])
            if not len(free):
                break
            i = at + int(free[0])
            at = i + 1
            later = self.near(lat[i], lon[i], lat[at:], lon[at:])
            if leads[i] or (own[i] and not waits[i]):
                self.heads.add(lat[i], lon[i])
                covered[at:] |= later
                if not leads[i]:
                    yield int(key[i]), True
            else:
                self.waiting.add(lat[i], lon[i])
                waits[at:] |= later
        for i in np.flatnonzero(covered & own & ~leads):
            yield int(key[i]), False


class MarkerPass(_Tile):
    """A point joins the nearest marker in reach that goes its way, or becomes one; with an undecided point in twice the reach it waits."""

    def __init__(self, metres: Callable, radius: float):
        self.metres, self.radius = metres, radius
        self.heads, self.waiting = _Grown(), _Grown()
        self.keys: list[int] = []
        self.ways: list[str | None] = []
        self.alone: list[bool] = []
        self.place: dict[int, int] = {}

    def _far(self, lat, lon, of: _Grown) -> np.ndarray:
        y, x = of.seen()
        return self.metres(lat[:, None], lon[:, None], y[None, :], x[None, :])

    def _joined(self, k: int, way: str | None, alone: bool) -> None:
        self.ways[k] = self.ways[k] or way
        self.alone[k] = self.alone[k] or alone

    def step(self, lat, lon, block):
        key, own, marker = block["key"], block["own"], block["marker"]
        found = self._far(lat, lon, self.heads)
        row, column = np.nonzero(found <= self.radius)
        starts = np.searchsorted(row, np.arange(len(lat) + 1))
        waits = (self._far(lat, lon, self.waiting) <= 2 * self.radius).any(axis=1)
        fresh: list[int] = []  # markers that this block has made
        for i in range(len(lat)):
            way = block["direction"][i] if isinstance(block["direction"][i], str) else None
            alone, known = bool(block["exclusive"][i]), marker[i] == marker[i]  # not a number: undecided
            if not known and (waits[i] or not own[i]):
                self.waiting.add(lat[i], lon[i])
                waits[i:] |= self.metres(lat[i], lon[i], lat[i:], lon[i:]) <= 2 * self.radius
                continue
            if known:
                k = self.place.get(int(marker[i])) if int(marker[i]) != key[i] else -1
                if k is None:  # too far away for the tile's own points
                    continue
            else:
                near = [(found[i, k], k) for k in column[starts[i] : starts[i + 1]].tolist()]
                if fresh:
                    y, x = self.heads.seen()
                    near += [(m, k) for m, k in zip(self.metres(lat[i], lon[i], y[fresh], x[fresh]).tolist(), fresh, strict=True) if m <= self.radius]
                fits = [c for c in near if (way is None or self.ways[c[1]] is None or self.ways[c[1]] == way) and not (alone and self.alone[c[1]])]
                k = min(fits)[1] if fits else -1
                yield int(key[i]), int(key[i]) if k < 0 else self.keys[k]
            if k < 0:
                self.place[int(key[i])] = k = self.heads.add(lat[i], lon[i])
                fresh.append(k)
                self.keys.append(int(key[i]))
                self.ways.append(way)
                self.alone.append(alone)
            else:
                self._joined(k, way, alone)


def _sent(rows: DataFrame, borders: DataFrame, tiles: DataFrame) -> DataFrame:
    """rows for their own tile and, as not own, for the tiles at whose borders they are; only tiles in which a point is undecided."""
    beyond = rows.join(borders, ["part", "cy", "cx"]).withColumn("tile", F.col("to")).drop("to").withColumn("own", F.lit(False))
    return rows.withColumn("own", F.lit(True)).unionByName(beyond).join(tiles, ["part", "tile"], "left_semi")


def settle_leaders(points: DataFrame, reach_m: float, near: Callable) -> tuple[DataFrame, int]:
    """The points (key, part, o, lat, lon; o orders them) that lead, and the rounds it took. near tells in numpy who is in reach of whom."""
    placed, borders = tiled(points, reach_m)
    open_, leaders, rounds = cut(placed), [], 0
    while not open_.isEmpty():
        rounds += 1
        rows = open_.withColumn("leads", F.lit(False))
        for found in leaders:
            rows = rows.unionByName(found.withColumn("leads", F.lit(True)))
        sent = _sent(rows, borders, open_.select("part", "tile").distinct()).repartition("part", "tile").sortWithinPartitions("part", "tile", "o")
        sent = sent.select("part", "tile", "key", "own", "leads", "lat", "lon")
        decided = cut(sent.mapInArrow(_streamed(lambda: LeaderPass(near), ("key", "own", "leads"), pa.bool_(), "leads"), "key long, leads boolean"))
        leaders.append(cut(open_.join(decided.where("leads").select("key"), "key", "left_semi").select(*placed.columns)))
        open_ = cut(open_.join(decided, "key", "left_anti"))
    return reduce(DataFrame.unionByName, leaders) if leaders else placed.limit(0), rounds


def settle_markers(points: DataFrame, radius_m: float, metres: Callable) -> tuple[DataFrame, int]:
    """key, marker of the points (key, part, o, lat, lon, direction, exclusive), and the rounds it took."""
    placed, borders = tiled(points, 2 * radius_m)
    rows, done, rounds = cut(placed.withColumn("marker", F.lit(None).cast("long"))), [], 0
    while True:
        tiles = cut(rows.where("marker IS NULL").select("part", "tile").distinct())
        if tiles.isEmpty():
            break
        rounds += 1
        sent = _sent(rows, borders, tiles).repartition("part", "tile").sortWithinPartitions("part", "tile", "o")
        # As doubles an undecided point's marker is not a number; keys are small enough to be exact.
        sent = sent.select("part", "tile", "key", "own", F.col("marker").cast("double").alias("marker"), "direction", "exclusive", "lat", "lon")
        fields = ("key", "own", "marker", "direction", "exclusive")
        decided = cut(sent.mapInArrow(_streamed(lambda: MarkerPass(metres, radius_m), fields, pa.int64(), "marker"), "key long, marker long"))
        done.append(decided)
        rows = rows.join(decided.withColumnRenamed("marker", "_now"), "key", "left").withColumn("marker", F.coalesce("marker", "_now")).drop("_now")
        # Rows that no undecided tile needs have done their part.
        left = cut(rows)
        open_ = left.where("marker IS NULL").select("part", "tile").distinct()
        beside = borders.join(open_.withColumnRenamed("tile", "to"), ["part", "to"], "left_semi").select("part", "cy", "cx").distinct()
        own = left.join(open_, ["part", "tile"], "left_semi")
        rows = cut(own.unionByName(left.join(open_, ["part", "tile"], "left_anti").join(beside, ["part", "cy", "cx"], "left_semi").select(*own.columns)))
    return reduce(DataFrame.unionByName, done) if done else points.select("key", F.col("key").alias("marker")).limit(0), rounds
