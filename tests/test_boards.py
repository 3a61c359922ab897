"""Notes beside boards, past years, towns, rings, release dates and run logs on small hand-made rows."""

import datetime as dt

import pytest

from laneprice.operators import boards, lines, relations
from laneprice.plans import reports
from laneprice.sources import documents
from pyspark.sql import functions as F


def day(s):
    return dt.date.fromisoformat(s)


def moved(spark, rows):
    return spark.createDataFrame(rows, "g int, name string, change long")


def test_notes_name_up_to_three_and_count_more(spark):
    rows = [(1, n, 304) for n in "dcba"] + [(1, "e", 20), (2, "x", 491), (2, "y", 212), (2, "z", 212), (3, "m", 304), (3, "c", -25), (3, "f", 4), (4, "q", 3), (4, "r", None), (5, "s", -10), (6, "t", -30), (6, "u", -30), (6, "v", -30)]
    note = {r.g: (r.head, r.text) for r in boards.biggest_note(moved(spark, rows), ["g"], "change", "name", 10).collect()}
    assert note == {
        1: ("Biggest rise.", "4 tied, +30.4¢. Smallest, e, +2.0¢."),
        2: ("Biggest rise.", "x, +49.1¢. Smallest, y and z, +21.2¢."),
        3: ("Biggest rise.", "m, +30.4¢. Biggest fall. c, −2.5¢."),
        5: ("Biggest fall.", "s, −1.0¢."),
        6: ("Biggest fall.", "t, u and v, −3.0¢."),
    }
    places = [(r.place, r.name) for r in boards.movers(moved(spark, rows), ["g"], "change", "name", 10).where("g = 1").orderBy("place").collect()]
    assert places == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]


def test_key_lines(spark):
    rows = [(1, "a", 212), (1, "b", 491), (2, "a", 30), (2, "b", 40), (2, "DC", 20), (2, "c", -30), (2, "d", 2), (3, "DC", -30), (4, "a", 1), (4, "b", 0), (5, "a", -30), (5, "b", -30), (6, "a", None), (7, "a", 5)]
    line = {r.g: r.line for r in boards.key_line(moved(spark, rows), ["g"], "change", "state", 10, F.col("name") == "DC").collect()}
    assert line == {
        1: "All 2 states rose, 21.2¢ to 49.1¢.",
        2: "2 states and DC rose, 1 fell and 1 was about the same.",
        3: "DC fell 3.0¢.",
        4: "All 2 states were about the same.",
        5: "All 2 states fell 3.0¢.",
        7: "The one state was about the same.",
    }


def test_record_notes(spark):
    rows = [(g, f"r{k}", "record" if k < n else "52week") for g, n in enumerate((0, 1, 2, 4, 5)) for k in range(5)]
    found = boards.record_note(spark.createDataFrame(rows, "g int, name string, kind string"), ["g"], "kind", "name", "region", "June 2022")
    tail = "in our records, which start June 2022."
    assert {r.g: r.note for r in found.collect()} == {0: None, 1: f"r0 is at its highest price {tail}", 2: f"r0 and r1 are at their highest prices {tail}", 3: f"4 of the 5 regions are at their highest prices {tail}", 4: f"Every region is at its highest price {tail}"}


def test_largest_region_is_the_first_on_ties(spark):
    rows = spark.createDataFrame([("b", "AA"), ("b", "DC"), ("a", "BB"), ("a", "CC"), ("c", "DC"), (None, "EE")], "region string, code string")
    found = {r.region: (r.members, r.covers, r.largest) for r in boards.region_members(rows, "region", "code", F.col("code") == "DC").collect()}
    assert found == {"a": ("BB,CC", "2 states", True), "b": ("AA,DC", "1 state and DC", False), "c": ("DC", "DC", False)}


def test_a_past_year_is_daily_where_it_reaches_back(spark):
    states = spark.createDataFrame([(1, "long", "R"), (2, "short", "R"), (3, "alone", None), (4, "empty", None)], "code int, name string, series string")
    end = day("2026-01-05")
    ago = lambda n: end - dt.timedelta(days=n)
    daily = [(1, ago(n), 30000 + n) for n in range(0, 380)] + [(2, end, 31000), (2, ago(3), 30500), (3, ago(1), 29000), (3, end, 29900)]
    weekly = [("R", ago(7 * k), 3000 + 10 * k) for k in range(60)]
    found = reports.past_year(states, spark.createDataFrame(daily, "code int, as_of date, units long"), spark.createDataFrame(weekly, "series string, period date, mills long"))
    got = {r.code: (r.price, r.change_4w, r.change_52w, r.high, r.low, r.basis_4w, r.basis, r.label) for r in found.collect()}
    assert got == {
        1: (30000, -28, -364, 30363, 30000, "daily", "daily", "past year"),
        2: (31000, -400, -5200, 35100, 30000, "weekly", "weekly", "past year"),
        3: (29900, None, None, 29900, 29000, None, "daily", f"since {ago(1)}"),
        4: (None, None, None, None, None, None, None, None),
    }


def test_places_need_a_capital_in_every_state(spark):
    rows = [(1, " Big ", "PPL", "US", "A", "1", "2", "900"), (2, "Cap", "PPLA", "US", "A", "1", "2", "5"), (3, "Mid", "PPL", "US", "B", "1", "2", "100"), (4, "No", "PPL", "US", "A", "x", "2", "999"), (5, "Zero", "PPLA", "US", "B", "1", "2", "0"), (6, "Else", "PPL", "CA", "A", "1", "2", "999"), (7, "Park", "PRK", "US", "A", "1", "2", "999"), (8, "Small", "PPL", "US", "B", "1", "2", None)]
    rows = spark.createDataFrame(rows, "id int, name string, code string, country string, state string, lat string, lon string, population string")
    args = (1, ("PPL", "PPLA"), ("PPLA",))
    only_a = spark.createDataFrame([("A",)], "state string")
    assert [(r.place, r.name, r.capital) for r in boards.places(rows, only_a, *args).orderBy("place").collect()] == [(1, "Big", False), (2, "Cap", True)]
    both = spark.createDataFrame([("A",), ("B",)], "state string")
    with pytest.raises(Exception, match="no capital for B"):
        boards.places(rows, both, *args).collect()
    assert boards.place_funnel(rows, both, *args).first().asDict() == {"us_rows": 7, "eligible": 3, "top": 1, "places": 2, "capitals_added": 1, "capitals": 1}


def test_release_dates_of_an_empty_store(spark):
    weeks, meta = "k string, period date, v long", "source string, release date, next_release date"
    none, nothing = spark.createDataFrame([], weeks), spark.createDataFrame([], meta)
    new = spark.createDataFrame([("a", day("2026-01-05"), 1)], weeks)
    told = lambda *a: boards.release_dates(*a, ["k"], "period", "v").first().asDict()
    assert told(none, nothing, none, nothing, new) == {"newest": day("2026-01-05"), "source": "fallback", "release": None, "next_release": None, "warning": None}
    assert told(none, nothing, none, nothing, none) == {"newest": None, "source": None, "release": None, "next_release": None, "warning": None}


def test_a_ring_is_closed_and_turns_back(spark):
    band = spark.createDataFrame([(1, 0, 1.0, 0.0, -1.0, 0.0), (1, 1, 1.0, 5.0, -1.0, 5.0)], "trip_id int, n long, left_lat double, left_lon double, right_lat double, right_lon double")
    assert [(r.lat, r.lon) for r in lines.band_ring(band).orderBy("place").collect()] == [(1.0, 0.0), (1.0, 5.0), (-1.0, 5.0), (-1.0, 0.0), (1.0, 0.0)]


def test_pins_gather_their_hints(spark):
    pins = spark.createDataFrame([(1, "e", 7, ["B", "A"]), (1, "e", 5, ["A"]), (1, "e", 6, None), (2, None, 8, None)], "k int, d string, id int, h array<string>")
    assert {r.k: (r.direction, r.rows, r.hints) for r in relations.fold_pins(pins, ["k"], "d", "id", "h").collect()} == {1: ("e", [5, 6, 7], ["A", "B"]), 2: (None, [8], [])}


def test_checks_of_hints_count_rows_that_have_some(spark):
    rows = spark.createDataFrame([(1, ["a"], "a"), (1, ["a", "b"], "c"), (1, [], "a"), (1, None, "a"), (1, ["a"], None)], "g int, h array<string>, code string")
    assert boards.hint_check(rows, ["g"], "h", "code").first().asDict() == {"g": 1, "checkable": 3, "mismatches": 2}


def test_geojson_takes_the_first_vertex_else_properties(spark):
    rows = [
        (1, '{"type":"Point","coordinates":[-90.5,30]}', {}), (2, '{"type":"MultiLineString","coordinates":[[[-1e1,2.5,0],[0,0]]]}', {"Lat": "9"}), (3, '{"type":"Point","coordinates":[]}', {"LATITUDE": "31.5", "X_LONG": "-91"}),
        (4, None, {"Lat": "n/a", "lat": "31", "Lon": "-91"}), (5, None, {"lat": "31"}), (6, None, None), (7, '{"type":"MultiPoint","coordinates":[[ -5 , 6 ],[0,0]]}', {"Kind": "closed SCALE"}),
    ]
    features = spark.createDataFrame(rows, "id int, geometry string, props map<string,string>")
    assert {r.id: (r.lat, r.lon) for r in documents.geojson_points(features).collect()} == {1: (30.0, -90.5), 2: (2.5, -10.0), 3: (31.5, -91.0), 7: (6.0, -5.0)}
    ids = lambda *t: sorted(r.id for r in documents.geojson_points(features, documents.property_test(*t)).collect())
    assert (ids("Kind", "equals", "Closed Scale"), ids("Kind", "excludes", "scale"), ids("Kind", "startswith", "CLOSED"), ids("Kind", "contains", "d s")) == ([7], [1, 2, 3], [7], [7])
    with pytest.raises(ValueError, match="no such test"):
        documents.property_test("Kind", "like", "x")


def test_notes_that_lost_their_source(spark):
    notes = spark.createDataFrame([("A", "on  DIESEL", "2026", True), ("B", "none", "2026", False), ("C", "x", "2025", True), ("D", "x", None, False)], "k string, anchor string, period string, out_of_date boolean")
    feet = spark.createDataFrame([("A", "tax on\n diesel"), ("A", "other"), ("C", "an X"), ("D", None)], "k string, text string")
    rates = spark.createDataFrame([("A", True), ("B", True), ("C", False)], "k string, out_of_date boolean")
    found = sorted((r.k, r.problem) for r in boards.notes_check(notes, feet, rates, "k", "2026").collect())
    assert found == [("B", "lost"), ("B", "out of date"), ("C", "out of date"), ("C", "period"), ("D", "lost"), ("D", "period")]
