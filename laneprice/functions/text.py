"""Names, words and classes of text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories with their patterns, in the order in which they are tried on a normalized name.
CATEGORIES = (
    ("port_of_entry", r"port of entry|port entry|\bpoe\b"),
    ("inspection", r"inspection|\bdot ins"),
    ("weigh", r"weigh|weight|check ?point"),
    ("ta", r"^ta( |$)"),
    ("petro", r"^(petro|perto)\b"),
    ("loves_shop", r"^love'?s shop\b"),
    ("speedco", r"\bspeedco\b"),
    ("lubezone", r"\blube ?zone\b"),
    ("profleet", r"\bpro ?fleet\b"),
)
# Names that are never kept, whatever else they say.
REFUSED = (
    ("empty name", r"^$"),
    ("cyrillic text in name", r"[\x{0400}-\x{04ff}]"),
    ("price in name", r"\$|\b\d+\s*(usd|dollars?|bucks)\b|\bprice\b"),
    ("phone style number in name", r"\d{3}[\s.\-]\d{3,4}\b|\d{7,}"),
)
# Reasons for the names that no category takes, in order.
DROPPED = (
    ("tarp", r"\btarps?\b"),
    ("yard", r"\byard\b"),
    ("toll road note", r"\btoll\b"),
    ("driver note", r"\bdrivers?\b|need to check|might be|prohibit|will come"),
    ("towing", r"\btow(ing)?\b|recovery"),
    ("glass shop", r"\bglass\b"),
    ("parking", r"\bparking\b"),
    ("repair or tire shop", r"tire|tyre|repair|diesel|trailer|\btrucks?\b|service|parts|welding|retread|mechan|mechin|mehanic|body shop|\bsemi\b|fleet|lube|oil change|wheel|alignment"),
    ("company name", r"\bcarriers?\b|\btrucking\b|\binc\b|\bllc\b"),
)
# Printed labels and direction words.
LABELS = {"weigh": "Weigh station", "inspection": "Inspection station", "port_of_entry": "Port of entry", "ta": "TA", "petro": "Petro", "loves_shop": "Love's shop", "speedco": "Speedco", "lubezone": "LubeZone", "profleet": "ProFleet lube"}
DIRECTION_WORDS = {"EB": "eastbound", "WB": "westbound", "NB": "northbound", "SB": "southbound"}
DIRECTED = ("weigh", "inspection", "port_of_entry")


def _first(rules, name: Column) -> Column:
    return F.coalesce(*(F.when(name.rlike(pattern), value) for value, pattern in rules))


def normalize_name(name: Column) -> Column:
    """Lower case, plain apostrophes, single spaces; null becomes empty."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "’", "'"), r"\s+", " ")))


def category(normal: Column) -> Column:
    """The category of a normalized name, null if it is dropped. A scale counts as weigh unless tires are near."""
    scale = F.when(normal.rlike("scale") & ~normal.rlike("tire|tyre"), "weigh")
    found = F.coalesce(_first(CATEGORIES[:3], normal), scale, _first(CATEGORIES[3:], normal))
    return F.when(_first(REFUSED, normal).isNull(), found)


def drop_reason(normal: Column) -> Column:
    """Why a normalized name is dropped; null if it is kept."""
    return F.when(category(normal).isNull(), F.coalesce(_first(REFUSED, normal), _first(DROPPED, normal), F.lit("no rule matched")))


def directions(normal: Column) -> Column:
    """EB, WB, NB and SB as a normalized name gives them, in order, once each."""
    found = F.regexp_extract_all(normal, F.lit(r"\b((?:[ewns]b|(?:east|west|north|south)bound))\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("B"))))


def label_for(kind: Column, direction: Column) -> Column:
    """The printed label of a category; nothing of the name gets into it."""
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    words = F.concat(F.lit(", "), F.element_at(table(DIRECTION_WORDS), direction))
    return F.concat(F.element_at(table(LABELS), kind), F.coalesce(words, F.lit("")))


def state_hints(text: Column, codes: Column) -> Column:
    """Known codes that stand before a five-digit ZIP."""
    return F.array_distinct(F.array_intersect(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z]{2}) \d{5}\b"), F.lit(1)), codes))


def fold(text: Column) -> Column:
    """A typed place name: lower case without dots and apostrophes, one space after commas, Saint, Fort and Mount short."""
    t = F.regexp_replace(F.lower(text), r"[.'’‘ʼʻ]", "")
    for pattern, to in ((r"-", " "), (r"\s*,\s*", ", "), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, to)
    t = F.regexp_replace(F.trim(t), r",$", "")
    for long, short in (("saint", "st"), ("fort", "ft"), ("mount", "mt")):
        t = F.regexp_replace(t, rf"\b{long}\b", short)
    return t


def clean_null(text: Column) -> Column:
    """Null for the words that mean no value."""
    return F.when(~F.upper(F.trim(text)).isin("", "NA", "N/A", "NULL", "NONE"), F.trim(text))


def squash(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def parse_number(text: Column, low: float, high: float, decimals: int | None = None) -> Column:
    """A typed number within its range, one comma allowed as its point; null for anything else."""
    t = F.regexp_replace(F.trim(text), ",", ".")
    shape = r"^\d+(\.\d*)?$|^\.\d+$" if decimals is None else rf"^\d+(\.\d{{0,{decimals}}})?$|^\.\d{{1,{decimals}}}$"
    n = F.when(t.rlike(shape), t.try_cast("double"))
    return F.when(n.between(low, high), n)
