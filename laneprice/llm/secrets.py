"""Secret scans with corpus-wide ownership frequency, with DataFrame functions alone.

Candidates are found by patterns; their values, hashed, are counted over the corpus by distinct
repositories and owners. A value that many owners have is an example that is copied widely; one that few
have is specific to its owner and looks live. Long mixed tokens outside the base spans become secrets
only if they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, unused, written

#: (kind, pattern, group of the value, least length of the value), in the order of spans that start together.
#: A run of one class begins where no such character stands before it: the look-behinds only save attempts.
KINDS = (
    ("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
    ("owned", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
BASE = 3
#: Words that a text with an assignment has, in lower case.
ASSIGNED = ("passw", "secret", "token", "api")
#: A value that so many owners have at most looks live.
MAX_OWNERS = 2
MASK = "[REDACTED]"
#: Distinct values (about 100 bytes each) whose frequency may be broadcast; more are joined in salted parts.
BROADCAST_VALUES, SALTS = 200_000, 32


def _scanned(docs: DataFrame, id_col: str, text_col: str, repository: Column, owner: Column) -> DataFrame:
    """Per row and kind: the matches, their values, and the lengths of the texts between them; nulls without a match."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = F.lower(text)
    has = {"assign": F.greatest(*(F.contains(small, F.lit(x)) for x in ASSIGNED)), "access": F.contains(text, F.lit("AKIA"))}

    def found(kind: str, pattern: str, group: int) -> Column:
        match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else match
        each = F.struct(match.alias("match"), value.alias("value"), F.transform(F.split(text, pattern, -1), F.length).alias("between"))
        return F.when(has.get(kind, text.rlike(pattern)), each).alias(kind)

    kept = [F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash")]
    rows = docs.select(*kept, repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), *(found(k, p, g) for k, p, g, _ in KINDS))
    return written(rows, "secrets")


def _candidates(rows: DataFrame) -> DataFrame:
    """row, repository, owner, kind, start, end, hash of every match that passes its kind's length."""
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), F.arrays_zip(F.col(f"{k}.match"), F.col(f"{k}.value"), F.slice(F.col(f"{k}.between"), 1, F.size(f"{k}.match")).alias("between")).alias("found")) for i, (k, *_) in enumerate(KINDS)))
    each = rows.select("row", "repository", "owner", F.explode(kinds).alias("x")).select("row", "repository", "owner", "x.kind", F.posexplode("x.found").alias("i", "m"))
    sofar = Window.partitionBy("row", "kind").orderBy("i")
    placed = each.withColumn("end", F.sum(F.col("m.between") + F.length("m.match")).over(sofar)).withColumn("start", F.col("end") - F.length("m.match"))
    least = F.element_at(F.array(*(F.lit(n) for *_, n in KINDS)), F.col("kind") + 1)
    mixed = F.col("m.value").rlike("[0-9]") & F.col("m.value").rlike("[a-z]") & F.col("m.value").rlike("[A-Z]")
    fit = placed.where((F.length("m.value") >= least) & ((F.col("kind") < BASE) | mixed))
    return fit.select("row", "repository", "owner", "kind", "start", "end", F.sha2("m.value", 256).alias("hash"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per document: id_col, text_hash and secrets, an array of (start, kind, end, live).

    Positions are code points, end exclusive; kind counts in the order of KINDS; spans are ordered by
    start, then kind. Base kinds are always listed; live tells whether at most max_owners owners, and as
    many repositories, have the value. Null texts are empty, null owners and repositories one of their own. Rows that
    repeat are scanned one by one. Other columns are ignored.
    """
    nothing = F.lit(None).cast("string")
    rows = _scanned(docs, id_col, text_col, nothing if repository is None else repository, nothing if owner is None else owner)
    candidates = written(_candidates(rows), "candidates")
    # A value that many rows have is one row for each owner, repository and task before it is shuffled.
    owners = candidates.select("hash", F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repository", F.lit("\0")).alias("repository")).distinct()
    frequency = owners.groupBy("hash").agg((F.greatest(F.count_distinct("owner"), F.count_distinct("repository")) <= max_owners).alias("live"))
    frequency = cut(frequency)
    if frequency.count() <= BROADCAST_VALUES:
        judged = candidates.join(F.broadcast(frequency), "hash")
    else:
        salts = frequency.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = candidates.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salts, ["hash", "salt"])
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("all"))
    base = F.filter("all", lambda s: s["kind"] < BASE)
    extra = F.filter("all", lambda s: (s["kind"] >= BASE) & s["live"] & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    spans = spans.select("row", F.array_sort(F.concat(base, extra)).alias("secrets"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean>>")
    joined = rows.select("row", "id", "text_hash").join(spans, "row", "left")
    return joined.select(F.col("id").alias(id_col), "text_hash", F.coalesce("secrets", empty).alias("secrets"))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*(F.lit(k) for k, *_ in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, mask: str = MASK) -> DataFrame:
    """docs with every span of find_secrets() replaced by mask; spans that overlap become one.

    No row is lost, and null texts stay null. Other columns pass through, whatever their names.
    """
    found = find_secrets(docs, id_col, text_col, repository, owner).where(F.size("secrets") > 0)
    found = found.groupBy(F.col(id_col), "text_hash").agg(F.max("secrets").alias("secrets"))
    names = dict(zip(("id", "hash", "own", "spans"), unused(docs.columns, "found_id", "found_hash", "own_hash", "spans"), strict=True))
    found = found.select(F.col(id_col).alias(names["id"]), F.col("text_hash").alias(names["hash"]), F.col("secrets").alias(names["spans"]))
    hashed = docs.withColumn(names["own"], F.xxhash64(text_col))
    joined = hashed.join(found, (F.col(names["hash"]) == F.col(names["own"])) & F.col(names["id"]).eqNullSafe(F.col(id_col)), "left")
    text, spans = F.col(text_col), F.col(names["spans"])

    def step(done: Column, s: Column) -> Column:
        before = F.when(s["start"] >= done["at"], F.concat(F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")), F.lit(mask))).otherwise("")
        return F.struct(F.concat(done["out"], before).alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    clean = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step, lambda done: F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return joined.withColumn(text_col, F.when(spans.isNull(), text).otherwise(clean)).select(*(F.col(f"`{c}`") for c in docs.columns))
