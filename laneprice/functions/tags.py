"""Rules on the tags of mapped objects, on weigh station names and on route signs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Brand by brand identifier.
BRAND_IDS = {"Q1872496": "loves", "Q64128179": "pilot", "Q64130592": "flyingj", "Q7835892": "ta", "Q64051305": "petro", "Q7339377": "roadranger"}
# Patterns over names, operators and brands; all without regard to case.
CAT_SCALE, CAT_SCALE_ID = r"cat scale", "Q111631907"
BORDER = r"\bborder\b|customs|\bCBP\b|immigration|\bU\.?S\.? (port of entry|inspection station)|\bUS port\b|international|pedestrian|passenger vehicle|commercial cargo|\bcrossing\b|(?<!new )mexico\b|baja california|\bcanada\b|ontario|british columbia"
AGRICULTURAL = r"agricultur|\bag\b|\bUSDA\b|department of agriculture|plant (inspection|protection)|produce|growers?\b|livestock|brand inspection|bug station"
VEHICLE_INSPECTION = r"emission|emmision|smog|safety inspection|vehicular inspection|vehicle inspection|oil change|auto repair|\btire|state inspection|\bDMV\b|\bMVA\b|\bMVC\b|\bVIN\b|department of motor vehicles|motor vehicle inspection|importing"
ENFORCEMENT = r"weigh|scale|motor carrier|\bCMV\b|commercial vehicle|port of entry|\bPOE\b"
CLOSED = r"\b(closed|abandoned|former|old|demolished|proposed|future)\b"
PRIVATE = r"landfill|transfer station|waste|recycl|scrap|salvage|quarry|\bmine\b|mining|grain|elevator|\bfeed\b|\bmill\b|lumber|gravel|\bsand\b|cement|asphalt|concrete|co-?op\b|farm|dairy|sugar|cotton|threshermen|tractor pull|\bfair\b|brewery|historic|museum|public scales?|truck ?stop|travel center|plaza|\bauto\b|['’]s\b|& service|railroad|railhead|rail yard|marine|harbor|terminal|sheet mill"
GOVERNMENT = r"\bDOT\b|\bD\.O\.T\.?\b|department of transport|transportation cabinet|highway patrol|state patrol|state police|state trooper|public safety|\bDPS\b|motor carrier|\bCHP\b|\bKYTC\b|\b[A-Z]{1,3}DOT\b|\bITD\b|\bMDT\b|\bOSHP\b|\bNSP\b|\bstate of\b|commonwealth of|department of revenue|department of motor vehicles|\bDMV\b|highway administration|\bpolice\b|\bpatrol\b"
STATION_NAME = r"weigh[ -]?station|weight station|weigh[ -]?scales?|weigh[ -]in[ -]motion|\bWIM\b|state scale|port of entry|\bPOE\b|motor carrier|\bCMV\b|commercial vehicle"
INSPECTION_NAME = r"inspection (station|facility|building)"
TRUCK_WORDS = r"\btruck|weigh|scale|\bCMV\b|commercial|\bDOT\b|patrol|police|\bDPS\b"
SCALE_NAME = r"scale house|truck scales?|\bDOT scale|\bscales?\b"
HIGHWAY_WORDS = r"\bI-? ?\d+\b|interstate|\bhighway\b|\bUS-? ?\d+\b|\bSR-? ?\d+\b|northbound|southbound|eastbound|westbound|\b[NSEW]B\b"
ROAD_NAME = r"\b(road|rd|lane|ln|drive|dr|street|st|way|access|exit|ramp)\.?$"
BORDER_NAME = r"port of entry|\bPOE\b|inspection (station|facility)|crossing"
# Keys and values of tags.
CLOSED_KEYS = ("disused", "abandoned", "demolished", "was:", "removed", "end_date")
NOT_A_STATION_KEYS = ("railway", "public_transport", "traffic_sign", "shop", "craft", "tourism", "leisure", "natural", "place", "military", "healthcare", "route", "end_date")
WEIGH_AMENITY = ("weighbridge", "weigh_station", "weight_station")
STATION_AMENITY = ("weighbridge", "weigh_station", "weight_station", "vehicle_inspection", "police", "parking", "public_building", "townhall")
NOT_PUBLIC = ("private", "customers", "permit", "no")
# Words of weigh station names and kinds of routes.
WEIGH_TYPE = "Weigh station"
DIRECTION_OF = {"N": "northbound", "S": "southbound", "E": "eastbound", "W": "westbound"}
BOUND_WORD = r"(?i)[\s,(]*\b(north|south|east|west)\s*bound\b\)?"
GENERIC_NAME = r"(?i)^(truck\s+)?(weigh|weight)(t)?\s*(station|scale|scales|stations)?(\s+complex)?(,?\s*no facilities)?$"
ROUTE_KINDS = {"I": ("I", "I"), "U": ("US", "US"), "S": ("SR", "State route"), "C": ("CR", "County road")}


def _tag(name: str, tags: str = "tags") -> Column:
    return F.try_element_at(F.col(tags), F.lit(name))


def _text(*names: str) -> Column:
    return F.concat_ws(" ", *(F.coalesce(_tag(n), F.lit("")) for n in names))


def says(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?i){pattern}")


def object_text() -> Column:
    """Name, operator and brand of a tagged object."""
    return _text("name", "operator", "operator:short", "brand")


def is_station_tag() -> Column:
    return F.coalesce(_tag("service") == "weigh_station", F.lit(False)) | F.coalesce(_tag("man_made") == "weigh_station", F.lit(False))


def has_weigh_tag() -> Column:
    return F.coalesce(_tag("amenity").isin(*WEIGH_AMENITY), F.lit(False)) | is_station_tag()


def is_government() -> Column:
    return says(object_text(), GOVERNMENT)


def brand_of() -> Column:
    """Brand key of a tagged object: its brand's identifier, the exact brand names of ONE9, the network's name anywhere; else null."""
    ids = F.create_map(*(F.lit(x) for kv in BRAND_IDS.items() for x in kv))
    network = [says(F.coalesce(_tag(k), F.lit("")), "ambest") for k in ("name", "brand", "operator", "network")]
    named = F.when(_tag("brand").isin("ONE9", "One9"), "one9").when(network[0] | network[1] | network[2] | network[3], "ambest")
    return F.coalesce(F.try_element_at(ids, _tag("brand:wikidata")), named)


def classify_element(state_names: list[str]) -> Column:
    """Why a tagged object is a weigh station candidate (tag or name), or the first rule that drops it.

    state_names is a bounded list; names with quotes or other marks are taken literally.
    """
    import re

    name, text = F.coalesce(_tag("name"), F.lit("")), object_text()
    has = lambda key: F.map_contains_key("tags", F.lit(key))
    tagged, station, public = has_weigh_tag(), is_station_tag(), is_government()
    closed_key = F.exists(F.map_keys("tags"), lambda k: F.greatest(*(k.startswith(p) for p in CLOSED_KEYS)))
    other_key = F.exists(F.map_keys("tags"), lambda k: k.isin(*NOT_A_STATION_KEYS))
    highway = F.coalesce(_tag("highway"), F.lit(""))
    of_state = says(name, r"\b(" + "|".join(map(re.escape, state_names)) + r")\b") if state_names else F.lit(False)
    shut = F.coalesce(_tag("access").isin(*NOT_PUBLIC), F.lit(False)) & ~station
    dropped = [
        ("cat_scale", says(text, CAT_SCALE) | F.coalesce(_tag("brand:wikidata") == CAT_SCALE_ID, F.lit(False))),
        ("border", F.coalesce(_tag("barrier") == "border_control", F.lit(False)) | says(text, BORDER)),
        ("agricultural", says(text, AGRICULTURAL)),
        ("vehicle_inspection", says(text, VEHICLE_INSPECTION) & ~says(text, ENFORCEMENT)),
        ("closed", says(name, CLOSED) | closed_key),
        ("road", ~tagged & ((~highway.isin("", "rest_area", "services")) | says(name, ROAD_NAME))),
        ("not_a_station", other_key | F.coalesce(_tag("type") == "route", F.lit(False)) | (has("amenity") & ~_tag("amenity").isin(*STATION_AMENITY))),
        ("private", ~public & (says(text, PRIVATE) | shut)),
        ("private_scale", tagged & (_tag("amenity") == "weighbridge") & ~station & ~public & ~says(name, STATION_NAME)),
    ]
    by_name = says(name, STATION_NAME) | (says(name, INSPECTION_NAME) & (public | says(text, TRUCK_WORDS) | of_state)) | (says(name, SCALE_NAME) & (public | says(name, HIGHWAY_WORDS)))
    found = F.coalesce(*(F.when(rule, reason) for reason, rule in dropped))
    return F.coalesce(found, F.when(tagged, "tag").when(by_name, "name").otherwise("weak"))


def clean_name(name: Column) -> Column:
    """A name whose dashes between words are commas, with single spaces and nothing hanging at its ends."""
    commas = F.regexp_replace(name, r"\s+[-–—]+\s+|\s*[–—]\s*", ", ")
    return F.trim(F.regexp_replace(F.regexp_replace(commas, r"\s+", " "), r"^[,\s-]+|[,\s-]+$", ""))


def route_direction(route: Column) -> tuple[Column, Column]:
    """The road of a route and the way it faces: the letter at its end, split off.

    Routes of two ways keep theirs; so do I-35 and I-69 E and W, which are roads; other routes need NB, SB, EB or WB.
    """
    r = F.trim(route)
    both = r.rlike(r"(?i)[NSEW]B?\s*/\s*[NSEW]B")
    interstate, other = r"(?i)^(I[-\s]?(\d+))\s*/?\s*([NSEW])B?$", r"(?i)^(.+?\d)\s*/?\s*([NSEW])B$"
    found = [(r.rlike(p), F.regexp_extract(r, p, 1), F.upper(F.regexp_extract(r, p, g))) for p, g in ((interstate, 3), (other, 2))]
    named = found[0][0] & F.regexp_extract(r, interstate, 2).isin("35", "69") & found[0][2].isin("E", "W") & ~r.rlike("(?i)B$")
    whole = both | named | ~(found[0][0] | found[1][0])
    ways = F.create_map(*(F.lit(x) for kv in DIRECTION_OF.items() for x in kv))
    road = F.when(whole, r).when(found[0][0], found[0][1]).otherwise(found[1][1])
    return road, F.when(~whole, F.try_element_at(ways, F.when(found[0][0], found[0][2]).otherwise(found[1][2])))


def weigh_parts(name: Column, route: Column, direction: Column) -> dict[str, Column]:
    """base, road, dir and named of a weigh station: a direction in the name or on the route is lifted out; generic names give WEIGH_TYPE."""
    road, way = route_direction(route)
    codes = F.create_map(*(F.lit(x) for k, v in DIRECTION_OF.items() for x in (f"{k}B", v)))
    given = F.when(direction != "", F.coalesce(F.try_element_at(codes, direction), F.lower(direction)))
    base = clean_name(F.coalesce(name, F.lit("")))
    word = F.nullif(F.regexp_extract(base, BOUND_WORD, 1), F.lit(""))
    rest = F.when(word.isNotNull(), clean_name(_without_first(base))).otherwise(base)
    named = (rest != "") & ~rest.rlike(GENERIC_NAME)
    return {
        "base": F.when(named, rest).otherwise(WEIGH_TYPE),
        "road": F.coalesce(clean_name(road), F.lit("")),
        "dir": F.coalesce(given, way, F.concat(F.lower(word), F.lit("bound"))),
        "named": named,
    }


def _without_first(base: Column) -> Column:
    """base without its first direction word."""
    found = F.regexp_substr(base, F.lit(BOUND_WORD))
    at = F.instr(base, found)
    return F.concat(F.substring(base, F.lit(1), at - 1), F.substring(base, at + F.length(found), F.length(base)))


def join_weigh(parts: dict[str, Column]) -> Column:
    """The parts put together; the road is left out where the name says it already."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[-\s]", "")
    road = F.when((parts["road"] != "") & ~F.contains(plain(parts["base"]), plain(parts["road"])), parts["road"])
    tail = F.concat_ws(" ", road, parts["dir"])
    return F.when(tail == "", parts["base"]).otherwise(F.concat(parts["base"], F.lit(", "), tail))


def sign_of(sign: Column, first_lon: Column) -> Column:
    """A sign in capitals without blanks and dashes; I1 to I9 west of 129 W are Alaska's, with their A. Null for none."""
    s = F.upper(F.regexp_replace(sign, r"[\s-]+", ""))
    alaska = s.rlike(r"^I\d$") & (first_lon < -129)
    return F.when(F.trim(sign) != "", F.when(F.coalesce(alaska, F.lit(False)), F.concat(F.lit("IA"), F.substring(s, 2, 9))).otherwise(s))


def is_interstate(sign: Column, code: Column) -> Column:
    return F.coalesce(F.trim(sign).rlike(r"(?i)^I[- ]?[AH]?[- ]?\d"), F.lit(False)) | F.coalesce(code.cast("string") == "2", F.lit(False))


def route_name(sign: Column, interstate: Column) -> tuple[Column, Column]:
    """Short and long name of a sign, null where it can't be read; only interstates have the letters A and H."""
    shape = r"^([IUSC])([AH]?)(\d+[A-Z]*)$"
    kind, letter, number = (F.regexp_extract(sign, shape, g) for g in (1, 2, 3))
    good = sign.rlike(shape) & ((letter == "") | (kind == "I"))
    table = lambda k: F.create_map(*(F.lit(x) for c, v in ROUTE_KINDS.items() for x in (c, v[k])))
    told = F.when(interstate, "interstate").otherwise("not an interstate")
    own = lambda k: F.when(letter != "", F.concat(letter, number)).otherwise(F.concat(F.try_element_at(table(k), kind), F.lit(" "), number))
    return F.when(good, own(0)), F.when(good, F.concat(own(1), F.lit(", "), told))
