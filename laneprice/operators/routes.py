"""Shortest ways by nested cells: distances between a cell's borders are found once, for all trips."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .durable import cut

#: Edges of a smallest cell, and edges that the lines between cells are chosen from; every edge is then dealt by them.
CELL_EDGES, PLANE_EDGES = 256, 100_000
#: Nodes that the largest cell may hold as hubs and borders (the square of that is a task's memory), and ends of trips a task takes.
MOST_NODES, TASK_ENDS = 4_000, 8_192
#: From this cell on (depth 6) the cells are so small that 16 of them go through a task together: a group has a price of its own.
BUNCHED_FROM = 4**6

_ARC = "cell long, a long, b long, miles double, ha int, hb int, below long, leg double"
_LABEL = "v long, cell long, hubs array<double>, up long, nodes array<long>, dist array<double>"
_HOP = "cell long, p long, q long, i int, `from` long, `to` long, below long, leg double"


def _planes(ends: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and place of the line that halves each cell of a binary tree, in heap order: of all near the middle the one that fewest edges (y1, x1, y2, x2) cross, for each on its smaller side."""
    axis, at = np.zeros(2**levels, dtype=int), np.full(2**levels, np.inf)
    held = {0: ends}
    for k in range(2**levels - 1):
        e, best = held.pop(k), None
        for x in (0, 1):
            low, high = np.sort(np.minimum(e[:, x], e[:, x + 2])), np.sort(np.maximum(e[:, x], e[:, x + 2]))
            s = np.sort(np.concatenate([low, high]))
            c = np.unique(s[int(len(s) * 0.3) : int(len(s) * 0.7) + 1])
            left, right = np.searchsorted(high, c, side="right"), len(e) - np.searchsorted(low, c, side="right")
            fair = np.minimum(left, right) * 5 >= len(e)
            c, left, right = c[fair], left[fair], right[fair]
            if len(c):
                share, apart = (len(e) - left - right) / np.minimum(left, right), np.abs(left - right)
                i = np.lexsort((apart, share))[0]
                best = min(best or (math.inf,), (share[i], apart[i], x, c[i]))
        if best:
            axis[k], at[k] = best[2:]
        x, c = axis[k], at[k]
        held[2 * k + 1], held[2 * k + 2] = e[np.maximum(e[:, x], e[:, x + 2]) <= c], e[np.minimum(e[:, x], e[:, x + 2]) > c]
    return axis, at


def _dealt(places: DataFrame, axis: np.ndarray, at: np.ndarray, levels: int) -> DataFrame:
    """places with code: their cell, a bit for every line."""

    def code(lat: pd.Series, lon: pd.Series) -> pd.Series:
        k, xy = np.zeros(len(lat), dtype=np.int64), np.array([lat, lon])
        for _ in range(levels):
            k = 2 * k + 1 + (xy[axis[k], np.arange(len(k))] > at[k])
        return pd.Series(k - (2**levels - 1))

    return places.withColumn("code", F.pandas_udf(code, "long")("lat", "lon"))


def _cell(code: Column, home: Column, depth: int) -> Column:
    """The number of the cell at a depth: of a cell k those below are 4 * k to 4 * k + 3, the whole is 1."""
    down = (2 * home).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), down) + F.call_function("shiftright", code, (2 * depth - down).cast("int"))


def _least(miles: np.ndarray) -> None:
    """Fills a symmetric matrix of arcs with the least miles between all: nodes are taken out in order, each leaving arcs between its neighbours, and put back in reverse order over those it had left. The work grows with the neighbours, few where arcs are short, not with the cube of the nodes."""
    left = []
    for k in range(len(miles)):
        near = k + 1 + np.flatnonzero(np.isfinite(miles[k, k + 1 :]))
        step, pairs = miles[k, near], np.ix_(near, near)
        miles[pairs] = np.minimum(miles[pairs], step[:, None] + step)
        left.append((near, step))
    for k in range(len(miles) - 1, -1, -1):
        near, step = left[k]
        if len(near):
            miles[k, k + 1 :] = miles[k + 1 :, k] = (step[:, None] + miles[near, k + 1 :]).min(axis=0)


def _solved(arcs: pd.DataFrame, hops: bool = False):
    """Nodes, their homes, the least miles between all of them over arcs, and with hops the next node on the way, the cell below that each arc runs in and the leg of each edge."""
    nodes, first = np.unique(np.concatenate([arcs["a"], arcs["b"]]), return_index=True)
    home = np.concatenate([arcs["ha"], arcs["hb"]])[first]
    arcs = arcs.sort_values("miles", ascending=False, kind="stable")
    i, j, n = np.searchsorted(nodes, arcs["a"]), np.searchsorted(nodes, arcs["b"]), len(nodes)
    miles = np.full((n, n), np.inf)
    miles[i, j] = miles[j, i] = arcs["miles"]
    np.fill_diagonal(miles, 0.0)
    if not hops:
        _least(miles)
        return nodes, home, miles
    below, leg, ahead = np.full((n, n), -1), np.zeros((n, n)), np.tile(np.arange(n), (n, 1))
    below[i, j] = below[j, i] = arcs["below"]
    leg[i, j] = leg[j, i] = arcs["leg"]
    for k in range(n):
        over = miles[:, k, None] + miles[k]
        better = over < miles
        miles[better] = over[better]
        ahead = np.where(better, ahead[:, k, None], ahead)
    return nodes, home, miles, ahead, below, leg


def _borders(arcs: pd.DataFrame) -> pd.DataFrame:
    """Arcs for the cell above: between the borders of this one, but those that lead over a third; each border has one to itself."""
    cell = int(arcs["cell"].iloc[0])
    nodes, home, miles = _solved(arcs)
    out = np.flatnonzero(home < (cell.bit_length() - 1) // 2)
    nodes, home, miles = nodes[out], home[out], miles[np.ix_(out, out)]
    apart = np.where(miles > 0, miles, np.inf)
    needed = np.isfinite(miles)
    for k in range(len(out)):
        needed &= ~(apart[:, k, None] + apart[k] <= miles)
    np.fill_diagonal(needed, True)
    i, j = np.nonzero(np.triu(needed))
    return pd.DataFrame({"cell": cell >> 2, "a": nodes[i], "b": nodes[j], "miles": miles[i, j], "ha": home[i], "hb": home[j], "below": cell, "leg": 0.0})


def _labels(arcs: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """The miles of each end to the hubs of its cell, and to the borders for the cell above."""
    rows = []
    if len(arcs) and len(ends):
        cell = int(arcs["cell"].iloc[0])
        nodes, home, miles = _solved(arcs)
        own = home >= (cell.bit_length() - 1) // 2
        for v, at, dist in zip(ends["v"], ends["nodes"], ends["dist"]):
            here = miles[np.searchsorted(nodes, v)] if at is None else (dist[:, None] + miles[np.searchsorted(nodes, at)]).min(axis=0) if len(at) else np.full(len(nodes), np.inf)
            out = ~own & np.isfinite(here)
            rows.append((v, cell, here[own], cell >> 2, nodes[out], here[out]))
    return pd.DataFrame(rows, columns=["v", "cell", "hubs", "up", "nodes", "dist"])


def _hops(arcs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The hops of each way from p to q through a cell: edges (below -1), ways through cells below and, where p is an end in one of those, the way out of it."""
    rows = []
    if len(arcs) and len(asked):
        cell = int(arcs["cell"].iloc[0])
        nodes, _, miles, ahead, below, leg = _solved(arcs, hops=True)
        for p, q, inner, at, dist in zip(asked["p"], asked["q"], asked["inner"], asked["nodes"], asked["dist"]):
            j, i = np.searchsorted(nodes, q), 0
            if at is None:
                k = np.searchsorted(nodes, p)
            else:
                of = np.searchsorted(nodes, at)
                k = of[(dist + miles[of, j]).argmin()]
                rows.append((cell, p, q, 0, p, nodes[k], int(inner), 0.0))
                i = 1
            while k != j:
                to = ahead[k, j]
                rows.append((cell, p, q, i, nodes[k], nodes[to], below[k, to], leg[k, to]))
                k, i = to, i + 1
                if i > len(nodes) + 1:
                    raise RuntimeError(f"no way out of cell {cell} from {p} to {q}")
    return pd.DataFrame(rows, columns=["cell", "p", "q", "i", "from", "to", "below", "leg"])


def _legs(arcs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The hops of each way through cells below, and one row (i -1) for its edges: their legs in all."""
    hops = _hops(arcs, asked)
    edges = hops[hops["below"] < 0].groupby(["cell", "p", "q"], as_index=False)["leg"].sum()
    if not len(edges):
        return hops
    edges = edges.assign(**{"i": -1, "from": edges["p"], "to": edges["q"], "below": -1})[hops.columns]
    return pd.concat([edges, hops[hops["below"] >= 0]], ignore_index=True)


def _bunch(cell: str = "cell") -> Column:
    return F.when(F.col(cell) >= BUNCHED_FROM, F.shiftright(cell, 4)).otherwise(F.col(cell)).alias("bunch")


def _by_cell(run):
    """run, which takes the rows of one cell from each table, over those of several cells."""

    def several(*tables: pd.DataFrame) -> pd.DataFrame:
        cells = [dict(iter(t.groupby("cell"))) for t in tables]
        made = [run(*(of.get(cell, t.iloc[:0]) for of, t in zip(cells, tables))) for cell in cells[-1]]
        full = [m for m in made if len(m)]
        return pd.concat(full, ignore_index=True) if full else made[0] if made else run(*(t.iloc[:0] for t in tables))

    return several


def _met(arcs: DataFrame, rows: DataFrame, key: str, run, kind: str, tasks: int) -> DataFrame:
    """run over the arcs and rows of each cell; the rows of a cell are dealt by key to as many groups as their number needs, each with all its arcs; small cells share groups."""
    rows = cut(rows)
    parts = rows.groupBy("cell").agg(F.floor(F.count("*") / TASK_ENDS + 1).alias("parts"))
    a = arcs.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    b = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts"))).drop("parts")
    a, b = (df.select("*", _bunch()).repartition(tasks, "bunch", "part").groupBy("bunch", "part") for df in (a, b))
    return cut(a.cogroup(b).applyInPandas(lambda a, b: _by_cell(run)(a, b), kind))


def nested_ways(pairs: DataFrame, edges: DataFrame, places: DataFrame, paths: bool = False, walked: bool = False) -> DataFrame | None:
    """a, b, miles: the shortest way of each pair (a, b) over edges (a, b, miles) between places (node, lat, lon); with paths also nodes, array<struct<lat, lon>> from a to b. Pairs without a way are left out.

    walked: instead of the nodes, the miles from place to place along them. A piece of a way is measured once for all pairs that share it, so what is
    kept grows with the pairs and the depth of the cells; nodes take the length of every pair's way.

    Straight lines that few edges cross cut the places into four, and each part again; of an edge between two parts one
    end becomes a hub of the cell they lie in. A way between two nodes passes a hub of a cell that holds both, or stays in a smallest cell,
    whose nodes are all hubs. From the smallest cells up, the miles between a cell's borders (hubs of larger ones) are
    found from its own edges and the cells below; then those of the ends to the hubs of all cells around them, and the
    best hub of each pair. So the work grows with the edges and with the pairs, not with what lies between a pair. Ways are read back cell by cell, each
    piece once for all pairs. None if a cell would be too large for that (MOST_NODES), as in graphs without geography.
    """
    tasks = max(32, 2 * edges.sparkSession.sparkContext.defaultParallelism)
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "miles"))
    n = edges.count()
    depth = max(0, math.ceil(math.log(max(n, 1) / CELL_EDGES, 4)))
    levels = 2 * depth
    own = lambda k, s: places.select(F.col("node").alias(k), F.col("lat").alias(f"y{s}"), F.col("lon").alias(f"x{s}"))
    sample = edges.where(F.pmod(F.xxhash64("a", "b"), F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, PLANE_EDGES / max(n, 1))))
    sample = sample.join(own("a", 1), "a").join(own("b", 2), "b").select("y1", "x1", "y2", "x2").orderBy("y1", "x1", "y2", "x2").toPandas().to_numpy(dtype=float)
    joined = places.join(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    coded = cut(_dealt(joined.select("node", "lat", "lon"), *_planes(sample, levels), levels))

    code = lambda k: coded.select(F.col("node").alias(k), F.col("code").alias(f"c{k}"), F.col("lat").alias(f"y{k}"), F.col("lon").alias(f"x{k}"))
    leg = geo.miles("ya", "xa", "yb", "xb") if walked else F.lit(0.0)
    told = cut(edges.join(code("a"), "a").join(code("b"), "b").select("a", "b", "miles", "ca", "cb", leg.alias("leg")))
    common = reduce(lambda x, d: x + (F.shiftright("ca", 2 * (depth - d)) == F.shiftright("cb", 2 * (depth - d))).cast("int"), range(1, depth + 1), F.lit(0))
    hubs = told.where("ca <> cb").groupBy(F.when(F.col("ca") < F.col("cb"), F.col("a")).otherwise(F.col("b")).alias("node")).agg(F.min(common).alias("home"))
    homes = cut(coded.join(hubs, "node", "left").withColumn("home", F.coalesce("home", F.lit(depth))).withColumn("cell", _cell(F.col("code"), F.col("home"), depth)))
    home = lambda k: homes.select(F.col("node").alias(k), F.col("home").alias(f"h{k}"), F.col("cell").alias(f"l{k}"))
    arcs = cut(told.join(home("a"), "a").join(home("b"), "b").select(F.greatest("la", "lb").alias("cell"), "a", "b", "miles", "ha", "hb", F.lit(-1).cast("long").alias("below"), "leg"))

    # A cell holds its hubs and its borders: the nearer to the whole end of an edge, in the cells from the other end up.
    above, under = F.when(F.col("ha") < F.col("hb"), F.col("a")).otherwise(F.col("b")), F.greatest("ha", "hb") - F.least("ha", "hb")
    borders = arcs.where("ha <> hb").select(above.alias("node"), F.explode(F.transform(F.sequence(F.lit(0), under - 1), lambda d: (F.col("cell") / F.pow(F.lit(4.0), d)).cast("long"))).alias("cell"))
    held = borders.unionByName(homes.select("node", "cell")).distinct().groupBy("cell").agg(F.count("*").alias("n"))
    if (held.agg(F.max("n")).first()[0] or 0) > MOST_NODES:
        return None

    of_depth, up = {}, None
    for d in range(depth, -1, -1):
        here = arcs.where(F.col("cell").between(4**d, 2 * 4**d - 1))
        of_depth[d] = here if up is None else here.unionByName(up)
        if d:
            up = cut(of_depth[d].select("*", _bunch()).repartition(tasks, "bunch").groupBy("bunch").applyInPandas(lambda rows: _by_cell(_borders)(rows), _ARC))

    pairs = cut(pairs.select("a", "b").distinct())
    asked = cut(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(homes.select(F.col("node").alias("v"), "cell", "home"), "v"))
    labels, last = {}, None
    for d in range(depth, -1, -1):
        ends = asked.where(F.col("home") == d).select("v", "cell", F.lit(None).cast("array<long>").alias("nodes"), F.lit(None).cast("array<double>").alias("dist"))
        if last is not None:
            ends = ends.unionByName(last.where("size(nodes) > 0").select("v", F.col("up").alias("cell"), "nodes", "dist"))
        labels[d] = last = _met(of_depth[d], ends, "v", _labels, _LABEL, tasks)
    all_labels = reduce(DataFrame.unionByName, labels.values())
    side = lambda k: all_labels.select(F.col("v").alias(k), "cell", F.col("hubs").alias(f"h{k}"))
    met = pairs.where("a <> b").join(side("a").hint("merge"), "a").join(side("b").hint("merge"), ["b", "cell"]).withColumn("sums", F.zip_with("ha", "hb", lambda x, y: x + y))
    met = met.select("a", "b", "cell", F.array_min("sums").alias("miles"), F.array_position("sums", F.array_min("sums")).alias("hub")).where("miles < double('inf')")
    best = cut(met.groupBy("a", "b").agg(F.min(F.struct("miles", "cell", "hub")).alias("m")).select("a", "b", "m.*"))
    same = pairs.where("a = b").select("a", "b", F.lit(0.0).alias("miles"))
    found = best.select("a", "b", "miles").unionByName(same)
    if not paths and not walked:
        return found

    named = []
    for d, rows in of_depth.items():
        nodes = rows.select("cell", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ha").alias("h")), F.struct(F.col("b").alias("node"), F.col("hb").alias("h")))).alias("n"))
        named.append(nodes.where(F.col("n.h") == d).groupBy("cell").agg(F.array_sort(F.collect_set("n.node")).alias("hubs")))
    best = cut(best.join(reduce(DataFrame.unionByName, named), "cell").select("a", "b", "miles", "cell", F.element_at("hubs", F.col("hub").cast("int")).alias("q")))
    wanted = cut(best.select("cell", F.explode(F.array("a", "b")).alias("p"), "q").distinct())
    hops, more = {}, None
    for d in range(depth + 1):
        ways = wanted.where(F.col("cell").between(4**d, 2 * 4**d - 1))
        ways = ways if more is None else ways.unionByName(more)
        ways = ways.where("p <> q").distinct()
        inner = labels[d + 1].select(F.col("v").alias("p"), F.col("up").alias("cell"), F.col("cell").alias("inner"), "nodes", "dist") if d < depth else None
        ways = ways.join(inner, ["p", "cell"], "left") if inner is not None else ways.select("*", F.lit(None).cast("long").alias("inner"), F.lit(None).cast("array<long>").alias("nodes"), F.lit(None).cast("array<double>").alias("dist"))
        hops[d] = _met(of_depth[d], ways, "p", _legs if walked else _hops, _HOP, tasks)
        more = hops[d].where("below > 0").select(F.col("below").alias("cell"), F.col("from").alias("p"), F.col("to").alias("q"))
    if walked:
        done, down = [], None
        for d in range(depth, -1, -1):
            steps = hops[d]
            if down is not None:
                steps = steps.join(down.select(F.col("cell").alias("below"), F.col("p").alias("from"), F.col("q").alias("to"), "walked"), ["below", "from", "to"], "left")
                steps = steps.withColumn("leg", F.when(F.col("below") < 0, F.col("leg")).otherwise(F.col("walked")))
            legs = F.transform(F.array_sort(F.collect_list(F.struct("i", "leg"))), lambda s: s["leg"])
            down = cut(steps.groupBy("cell", "p", "q").agg(F.aggregate(legs, F.lit(0.0), lambda s, x: s + x).alias("walked")))
            done.append(down)
        done, out = reduce(DataFrame.unionByName, done), best
        for k in "ab":
            out = out.join(done.select("cell", F.col("p").alias(k), "q", F.col("walked").alias(f"w{k}")).hint("merge"), ["cell", k, "q"], "left")
        way = lambda k: F.when(F.col(k) == F.col("q"), 0.0).otherwise(F.col(f"w{k}"))
        return out.select("a", "b", "miles", (way("a") + way("b")).alias("walked")).unionByName(same.select("a", "b", "miles", F.lit(0.0).alias("walked")))
    point = F.struct("lat", "lon")
    spots = places.select("node", point.alias("at"))
    done, down = [], None
    for d in range(depth, -1, -1):
        steps = hops[d].join(spots.withColumnRenamed("node", "to"), "to").withColumn("at", F.array("at"))
        if down is not None:
            steps = steps.join(down.select(F.col("cell").alias("below"), F.col("p").alias("from"), F.col("q").alias("to"), "way"), ["below", "from", "to"], "left")
            steps = steps.withColumn("at", F.when(F.col("below") < 0, F.col("at")).otherwise(F.col("way")))
        made = steps.groupBy("cell", "p", "q").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "at"))), lambda s: s["at"])).alias("way"))
        down = cut(made)
        done.append(down)
    done = reduce(DataFrame.unionByName, done)
    none = F.array().cast(done.schema["way"].dataType)
    out = best
    for k in "ab":
        out = out.join(done.select("cell", F.col("p").alias(k), "q", F.col("way").alias(f"w{k}")).hint("merge"), ["cell", k, "q"], "left").join(spots.toDF(k, f"s{k}"), k)
        out = out.withColumn(f"w{k}", F.coalesce(f"w{k}", none))
    # From a to the hub, and from the hub, the last of b's way, back to b.
    back = F.reverse(F.concat(F.array("sb"), F.slice("wb", F.lit(1), F.greatest(F.size("wb") - 1, F.lit(0)))))
    back = F.when(F.col("b") == F.col("q"), none).otherwise(back)
    out = out.select("a", "b", "miles", F.concat(F.array("sa"), "wa", back).alias("nodes"))
    return out.unionByName(same.join(spots.toDF("a", "s"), "a").select("a", "b", "miles", F.array("s").alias("nodes")))
