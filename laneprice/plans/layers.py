"""Map layers out of elements, features, segments and places, with their funnels, and the coverage report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags
from ..operators import borders, clusters, lines, outlines, roads, spatial
from ..operators.durable import cut
from ..sources.elements import TYPE_ORDER

# Metres that stations and weigh stations are folded within, kilometres to the coast and to a road that is named.
CLUSTER_M, DEDUPE_M, COAST_KM, NEAR_ROAD_KM = 300.0, 600.0, 1.0, 2.0
#: Brands whose network isn't mapped well enough to be shown.
DROPPED_BRANDS = ("ambest",)


def coverage_report(official: DataFrame, ours: DataFrame, listed: DataFrame, radius_m: float) -> DataFrame:
    """part, key, official, matched, ours, share: how much of official points (id, lat, lon, key) our points (the same columns) hold.

    Of a key in listed (key), whose points can be compared, share is matched over official, a match being one of
    ours of any key within radius_m; of others ours over official. Null without official points. The last
    row, of part all, is over the listed keys.
    """
    hit = spatial.points_near(official, ours, radius_m).select("id").distinct().withColumn("hit", F.lit(1))
    counts = official.join(hit.hint("merge"), "id", "left").groupBy("key").agg(F.count("*").alias("official"), F.count("hit").alias("found"))
    known = listed.select("key").distinct().withColumn("listed", F.lit(True))
    rows = counts.join(ours.groupBy("key").agg(F.count("*").alias("ours")), "key", "full").join(known, "key", "left")
    rows = cut(rows.select("key", "official", F.when(F.col("listed"), F.col("found")).alias("matched"), F.coalesce("ours", F.lit(0).cast("long")).alias("ours")))
    share = F.round(F.try_divide(F.coalesce("matched", "ours"), F.col("official")), 3)
    whole = rows.where("matched IS NOT NULL").agg(F.sum("official").alias("official"), F.sum("matched").alias("matched"))
    total = whole.select(F.lit("all").alias("part"), F.lit(None).cast("string").alias("key"), "official", "matched", F.lit(None).cast("long").alias("ours"), F.round(F.try_divide("matched", "official"), 3).alias("share"))
    return rows.select(F.lit("chain").alias("part"), "key", "official", "matched", "ours", share.alias("share")).unionByName(total)


def _referenced(elements: DataFrame) -> DataFrame:
    """elements (precedence, type, id, lat, lon, tags) once each, of the first precedence, with rank and ref."""
    first = Window.partitionBy("type", "id").orderBy("precedence")
    once = elements.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    rank = F.array_position(F.array(*(F.lit(t) for t in TYPE_ORDER)), F.col("type"))
    return once.select(F.struct(rank.alias("rank"), "id").alias("id"), F.concat(F.substring("type", 1, 1), F.col("id").cast("string")).alias("ref"), "lat", "lon", "tags", F.nullif(F.trim(F.try_element_at("tags", F.lit("name"))), F.lit("")).alias("name"))


def _folded(rows: DataFrame, radius_m: float, by: tuple[str, ...], order: list[str], mean: bool, flags: tuple[str, ...] = ()) -> DataFrame:
    """Sites of rows: by, lat, lon, name, refs and flags; at the mean of their members or at the first one, rounded half even to 5 decimals."""
    rows = cut(rows)
    led = rows.join(clusters.leaders_in_order(rows, radius_m, by, order), "id")
    turn = F.struct(*order, "id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), turn))
    at = lambda c: F.bround(F.avg(c) if mean else F.min_by(c, turn), 5).alias(c)
    refs = F.transform(F.array_sort(F.collect_list(F.struct(turn.alias("o"), "ref"))), lambda m: m["ref"])
    return led.groupBy("leader", *by).agg(at("lat"), at("lon"), first("name").alias("name"), refs.alias("refs"), *(F.bool_or(f).alias(f) for f in flags)).drop("leader")


def _placed(sites: DataFrame, edges: DataFrame, tolerance_km: float | None) -> DataFrame:
    """sites with state; those in none are left out."""
    rows = sites.withColumn("id", F.element_at("refs", 1))
    found = spatial.locate(rows, edges) if tolerance_km is None else spatial.locate_near(rows, edges, tolerance_km)
    return rows.join(found.withColumnRenamed("code", "state"), "id").drop("id")


def stations_layer(elements: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """brand, lat, lon, name, refs, state of stations out of elements (precedence, type, id, lat, lon, tags), and the funnel (reason, n)."""
    rows = cut(_referenced(elements).withColumn("brand", tags.brand_of()))
    kept = rows.where(F.col("brand").isNotNull() & ~F.col("brand").isin(*DROPPED_BRANDS))
    sites = cut(_folded(kept, CLUSTER_M, ("brand",), ["lat", "lon"], mean=True))
    placed = cut(_placed(sites, edges, None))
    reason = F.when(F.col("brand").isNull(), "unbranded").when(F.col("brand").isin(*DROPPED_BRANDS), "dropped brand").otherwise("kept")
    funnel = rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    for name, df in (("sites", sites), ("in a state", placed)):
        funnel = funnel.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("reason"), "n"))
    return placed.select("brand", "lat", "lon", F.coalesce("name", "brand").alias("name"), "refs", "state"), funnel


def weigh_layer(elements: DataFrame, state_names: list[str], edges: DataFrame, outline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lat, lon, name, via, gov, refs, state of weigh stations out of elements (as stations_layer), and the funnel (reason, n).

    Elements are classified, folded within DEDUPE_M in order of weigh tag, public operator, name, type and id; posts at the
    border go, and sites that are in no state and not within COAST_KM of one.
    """
    rows = cut(_referenced(elements).withColumn("why", tags.classify_element(state_names)).withColumn("tagged", tags.has_weigh_tag()).withColumn("gov", tags.is_government()))
    kept = rows.where(F.col("why").isin("tag", "name")).withColumn("all", F.lit(1))
    ranked = kept.withColumn("r1", ~F.col("tagged")).withColumn("r2", ~F.col("gov")).withColumn("r3", F.col("name").isNull())
    sites = cut(_folded(ranked, DEDUPE_M, ("all",), ["r1", "r2", "r3"], mean=False, flags=("tagged", "gov")).withColumn("id", F.element_at("refs", 1)))
    inland = cut(borders.away_from_border(sites, outline))
    placed = cut(_placed(inland.drop("id"), edges, COAST_KM))
    funnel = rows.groupBy(F.when(F.col("why").isin("tag", "name"), "kept").otherwise(F.col("why")).alias("reason")).agg(F.count("*").alias("n"))
    for name, df in (("sites", sites), ("away from the border", inland), ("in a state", placed)):
        funnel = funnel.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("reason"), "n"))
    return placed.select("lat", "lon", "name", F.when(F.col("tagged"), "tag").otherwise("name").alias("via"), "gov", "refs", "state"), funnel


def public_weigh_layer(rows: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows of flatten_feature_rows() without rejects, with state: that of their place, else the given one; and those in no state."""
    good = rows.where("reject IS NULL").withColumn("id", F.struct("response", "id"))
    found = good.withColumnRenamed("state", "given").join(spatial.locate(good, edges).withColumnRenamed("code", "state"), "id", "left")
    found = found.withColumn("state", F.coalesce(F.col("state").cast("string"), "given")).withColumn("id", F.col("id.id"))
    return found.where("state IS NOT NULL"), found.where("state IS NULL")


def roads_layer(segments: DataFrame, edges: DataFrame, tolerance: float, decimals: int) -> tuple[DataFrame, DataFrame]:
    """sign, line, points of segments (id, sign, code, state, points) in the states, chained, thinned and put on a grid; and the funnel (reason, n)."""
    inside = cut(roads.segments_in_states(segments, edges))
    chained = cut(roads.chain_segments(inside))
    done = cut(clusters.quantize_lines(chained.select("sign", F.col("id").alias("line"), "points"), tolerance, decimals))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("reason"), "n") for name, df in (("segments", segments), ("in the states", inside), ("lines", chained), ("kept", done))]
    return done, counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def states_layer(shapes: DataFrame, tolerance: float, decimals: int, least_area: float) -> DataFrame:
    """code, polygons and box of outlines, thinned with their shared borders."""
    from ..operators.exports import polygon_columns

    thin = outlines.simplify_shared_borders(shapes, tolerance, least_area)
    rings = F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"])
    return polygon_columns(thin.groupBy("code", "poly").agg(rings.alias("rings")), decimals)


def fleet_layer(rows: DataFrame, edges: DataFrame, radius_m: float = 25.0) -> tuple[DataFrame, DataFrame]:
    """category, direction, lat, lon, rows, state of pins out of a point list (row, name, lat, lon), and the drops (row, reason).

    Pins are named and classified; those of one category at one place to 5 decimals fold, their direction staying
    where all agree; then each joins the latest kept pin of its category and direction within radius_m.
    """
    from ..functions import text

    named = rows.withColumn("n", text.normalize_name(F.col("name")))
    normal = F.col("n")
    why = F.when(F.col("lat").isNull() | F.col("lon").isNull(), "bad coordinates").otherwise(text.drop_reason(normal))
    ways = text.directions(normal)
    read = cut(named.select("row", "lat", "lon", why.alias("reason"), text.category(normal).alias("category"), F.when(F.size(ways) == 1, ways[0]).alias("way")))
    place = (F.bround("lat", 5).alias("lat"), F.bround("lon", 5).alias("lon"))
    pins = read.where("reason IS NULL").groupBy("category", *place).agg(F.min("way").alias("low"), F.max("way").alias("high"), F.count("way").alias("told"), F.count("*").alias("all"), F.array_sort(F.collect_list("row")).alias("rows"))
    agree = (F.col("told") == F.col("all")) & (F.col("low") == F.col("high")) & F.col("category").isin(*text.DIRECTED)
    pins = cut(pins.select("category", F.coalesce(F.when(agree, F.col("low")), F.lit("")).alias("direction"), "lat", "lon", "rows").withColumn("id", F.element_at("rows", 1)))
    led = pins.join(clusters.leaders_in_order(pins, radius_m, ("category", "direction"), ["lat", "lon"], latest=True), "id")
    turn = F.struct("lat", "lon", "id")
    sites = led.groupBy("leader", "category", "direction").agg(F.min_by("lat", turn).alias("lat"), F.min_by("lon", turn).alias("lon"), F.array_sort(F.flatten(F.collect_list("rows"))).alias("rows")).withColumnRenamed("leader", "id")
    found = sites.join(spatial.locate_near(sites, edges, COAST_KM).withColumnRenamed("code", "state"), "id")
    return found.select("category", F.nullif("direction", F.lit("")).alias("direction"), "lat", "lon", "rows", "state"), read.where("reason IS NOT NULL").select("row", "reason")


def map_points(stations: DataFrame, services: DataFrame, weigh: DataFrame, road_lines: DataFrame, edges: DataFrame) -> DataFrame:
    """id, kind, key, name, state, sources, direction, road, lat, lon, n (of the kind) of all points of the map, in order of state (none last), name, lat and lon.

    stations and services have id, name, key, lat, lon and state; weigh has id, name, route, direction, lat, lon, state,
    rank and source, and its points are merged; those of source f stay apart. road_lines (line, lat1, lon1, lat2, lon2, sign, code) name
    the road of weigh stations within NEAR_ROAD_KM that have none.
    """
    parts = tags.weigh_parts(F.col("name"), F.col("route"), F.col("direction"))
    named = cut(weigh.select("id", "lat", "lon", "state", "rank", "source", *(parts[c].alias(c) for c in ("base", "road", "dir", "named"))))
    markers = clusters.merge_sources(named.select("id", "rank", F.col("dir").alias("direction"), (F.col("source") == "f").alias("exclusive"), "lat", "lon"), DEDUPE_M)
    merged = cut(clusters.marker_summary(named.select("id", "rank", "source", "lat", "lon", F.col("dir").alias("direction"), "road", F.col("base").alias("name"), "named", "state"), markers).withColumnRenamed("marker", "id"))
    _, long = tags.route_name(tags.sign_of(F.col("sign"), F.col("lon1")), tags.is_interstate(F.col("sign"), F.col("code")))
    near = lines.nearest_line(merged.select("id", "lat", "lon"), road_lines, NEAR_ROAD_KM).join(road_lines.select("line", long.alias("near_road")), "line").select("id", "near_road")
    joined = tags.join_weigh({"base": F.col("name"), "road": F.coalesce("road", F.lit("")), "dir": F.col("direction")})
    stops = merged.join(near, "id", "left").select("id", F.lit("w").alias("kind"), F.lit("w").alias("key"), joined.alias("name"), "state", "sources", "direction", F.coalesce("near_road", "road").alias("road"), "lat", "lon")
    told = lambda df, kind: df.select("id", F.lit(kind).alias("kind"), "key", "name", "state", "lat", "lon")
    points = cut(stops.unionByName(told(stations, "s"), allowMissingColumns=True).unionByName(told(services, "v"), allowMissingColumns=True))
    found = spatial.locate(points.where("state IS NULL"), edges).withColumnRenamed("code", "found")
    placed = points.join(found, "id", "left").withColumn("state", F.coalesce("state", "found")).drop("found")
    counts = points.groupBy("kind").agg(F.count("*").alias("n"))  # three rows
    return placed.join(F.broadcast(counts), "kind").orderBy(F.col("state").asc_nulls_last(), "name", "lat", "lon", "id")
