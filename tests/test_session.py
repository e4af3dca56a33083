"""Requests, aggregates and series over the lending library, against plain loops."""

import pytest
from lending import AUTHORS, BOOKS, LOANS, MEMBERS, VISITS, author, filled, ids, land, of
from pyspark.sql import functions as F

from marlstone import QueryError, StoreError, connect


@pytest.mark.parametrize(
    "text, test, residual",
    [
        ('genre == "verse"', lambda b: b["genre"] == "verse", False),
        ("price != 7.25", lambda b: b["price"] not in (None, 7.25), False),
        ("not (price == 7.25)", lambda b: b["price"] not in (None, 7.25), False),
        ("null == price", lambda b: b["price"] is None, False),
        ("price != null and pages >= 100", lambda b: b["price"] is not None and b["pages"] >= 100, False),
        ('isbn like "978-00%"', lambda b: b["isbn"].startswith("978-00"), False),
        ('author.land == "jp"', lambda b: land(b) == "jp", True),
        ('author.land != "jp"', lambda b: land(b) != "jp", True),  # two-valued behind a reference
        ('not (author.land == "jp")', lambda b: land(b) != "jp", True),
        ("author.land == null", lambda b: land(b) is None, True),
        ('author.land == "ng" and genre == "verse"', lambda b: land(b) == "ng" and b["genre"] == "verse", True),
        ('author.land == "se" or pages < 90', lambda b: land(b) == "se" or b["pages"] < 90, True),
    ],
)
def test_filters(library, text, test, residual):
    got = library["Book"].fetch(text)
    want = [b for b in BOOKS if test(b)]
    assert 0 < len(want) < len(BOOKS) and sorted(ids(got)) == sorted(ids(want)) and got.report.residual_filter == residual
    best = sorted(want, key=lambda b: (-b["pages"], b["id"]))
    assert ids(library["Book"].fetch(text, order=["-pages", "id"], limit=2, offset=1)) == ids(best)[1:3]
    if not residual:
        assert library["Book"].count(text) == len(want)


def test_what_a_filter_reads(library):
    got = library["Book"].fetch('genre == "essay"')
    assert any("EqualTo(genre,essay)" in x for x in got.pushed_filters())
    # the reference that the filter needs is joined even if it isn't included, and isn't in the result
    got = library["Book"].fetch('author.land == "jp"', order="-pages", limit=2)
    assert "author" not in got.to_dicts()[0] and got.report.joined == ["Book.author"] and not got.report.limit_below_joins
    got = library["Book"].fetch(include=["author"], order="-id", limit=3)
    assert ids(got) == sorted(ids(BOOKS))[:-4:-1] and got.report.limit_below_joins and got.report.order_below_joins


def test_includes(library):
    assert {a["id"]: ids(a["books"]) for a in library["Author"].fetch(include=["books"])} == {a["id"]: sorted(ids(of(BOOKS, authorId=a["id"]))) for a in AUTHORS}
    for b in library["Book"].fetch(include=["author", "loans.member"]):
        assert b["author"] == author(b) and ids(b["loans"]) == ids(of(LOANS, bookId=b["id"]))
        assert all(x["member"] == next(iter(of(MEMBERS, id=x["memberId"])), None) for x in b["loans"])
    one = library["Author"].get(1, include=["books.loans"])
    assert {b["id"]: len(b["loans"]) for b in one["books"]} == {b["id"]: len(of(LOANS, bookId=b["id"])) for b in of(BOOKS, authorId=1)}
    assert library["Author"].get(99) is None


def test_children_of_some_fields(library):
    got = library["Author"].fetch(include=["books.loans"], columns=["name", "books.pages", "books.loans.days"], order="id")
    first = got.to_dicts()[0]
    assert set(first) == {"id", "name", "books"} and set(first["books"][0]) == {"id", "authorId", "pages", "loans"}
    assert [[x["days"] for x in b["loans"]] for b in first["books"]] == [[x["days"] for x in of(LOANS, bookId=b["id"])] for b in sorted(of(BOOKS, authorId=1), key=lambda b: b["id"])]
    assert "ISBN_13" not in got.explain()
    for bad in (["books.nope"], ["loans.days"], ["books.loans.x.y"]):
        with pytest.raises(QueryError):
            library["Author"].fetch(include=["books.loans"], columns=bad)


def test_series_below_rows(library):
    lo, hi = 100, 250
    want = [{"ts": t, "value": v} for t, v in VISITS[100] if lo <= t <= hi]
    got = library["Loan"].fetch("memberId == 100", include=["member.visits"], window=(lo, hi), order="id").to_dicts()
    assert len(got) == len(of(LOANS, memberId=100)) and all(x["member"]["visits"] == want for x in got)
    assert library["Member"].get(101, include=["visits"])["visits"] == []
    e = library.model["Member"]
    cut = [VISITS[100][k : k + 30] for k in range(0, 110, 30)]
    assert library.series.segments().count() == len(cut)
    assert library.series.overlapping(e, e["visits"], lo, hi).count() == sum(c[0][0] <= hi and c[-1][0] >= lo for c in cut)
    assert [tuple(r) for r in library["Member"].series("visits", 103).collect()] == VISITS[103]


def test_order_of_nulls(library):
    up = sorted(BOOKS, key=lambda b: (b["price"] is not None, b["price"] or 0, b["id"]))
    down = sorted(BOOKS, key=lambda b: (b["price"] is None, -(b["price"] or 0), b["id"]))
    assert ids(library["Book"].fetch(order=["price", "id"])) == ids(up)
    assert ids(library["Book"].fetch(order=[("price", "desc"), "id"], limit=9)) == ids(down)[:9]
    assert len(ids(library["Book"].fetch(order="id", offset=2))) == len(BOOKS)  # an offset needs a limit
    assert library["Book"].fetch(columns=["genre"], order="-price", limit=1).df.columns == ["id", "genre"]
    one = library["Book"].fetch_one('genre == "essay"', order="pages")
    assert one["pages"] == min(b["pages"] for b in of(BOOKS, genre="essay")) and library["Book"].fetch_one("pages > 9000") is None


def test_reports(library):
    got = library["Book"].fetch('genre == "novel" and author.land == "jp"', observe=True)
    novels = of(BOOKS, genre="novel")
    want = [b for b in novels if land(b) == "jp"]
    assert len(got.to_dicts()) == len(want) == got.count() and got.report.counts() == {"root": len(novels), "result": len(want)}
    assert "Filter" in got.explain()
    library.reset_counters()
    library["Author"].fetch(include=["books.loans"]).to_dicts()
    assert library.counters == {"requests": 1, "scans": 3, "rows_returned": len(AUTHORS)} and library.last_report.entity == "Author"


def test_evaluate(library):
    got = library["Book"].evaluate(["genre"], {"n": "count()", "pages": "SUM(pages)", "mean": "avg(price)", "lo": "min(price)", "hi": "max(price)", "who": "countDistinct(authorId)"}, order="genre").to_dicts()
    want = []
    for g in ("essay", "novel", "verse"):
        bs = of(BOOKS, genre=g)
        p = [b["price"] for b in bs if b["price"] is not None]
        want.append({"genre": g, "n": len(bs), "pages": sum(b["pages"] for b in bs), "mean": pytest.approx(sum(p) / len(p)), "lo": min(p), "hi": max(p), "who": len({b["authorId"] for b in bs} - {None})})
    assert got == want
    assert library["Book"].evaluate(metrics={"n": "count()", "x": "sum(price)"}, filter="pages > 9000").to_dicts() == [{"n": 0, "x": None}]
    assert {r["city"]: r["n"] for r in library["Member"].evaluate(["city"], {"n": "count()"})} == {c: len(of(MEMBERS, city=c)) for c in ("Oslo", "Accra", None)}
    first = library["Loan"].evaluate(["bookId"], {"d": "sum(days)"}, order=["-d", "bookId"], limit=1).to_dicts()
    assert first == [max(({"bookId": k, "d": sum(x["days"] for x in of(LOANS, bookId=k))} for k in {x["bookId"] for x in LOANS}), key=lambda r: (r["d"], -r["bookId"]))]


@pytest.mark.parametrize(
    "call",
    [
        lambda b: b.fetch("colour == 1"), lambda b: b.fetch("genre"), lambda b: b.fetch("isbn > 5"), lambda b: b.fetch("genre == true"), lambda b: b.fetch("2 == 2"), lambda b: b.fetch("genre in [true]"),
        lambda b: b.fetch('"q" in ["q"]'), lambda b: b.fetch("genre > null"), lambda b: b.fetch('genre == "q" z'), lambda b: b.fetch("genre == 'q"), lambda b: b.fetch("loans.days == 4"),
        lambda b: b.fetch("author == 1"), lambda b: b.fetch("genre like 5"), lambda b: b.fetch("isbn == price"),
        lambda b: b.fetch(include=["colour"]), lambda b: b.fetch(include=["genre"]), lambda b: b.fetch(include=["author.colour"]), lambda b: b.fetch(order="author.land"), lambda b: b.fetch(order=[("id", "up")]), lambda b: b.fetch(limit=-1), lambda b: b.fetch(columns=["author"]),
        lambda b: b.count('author.land == "jp"'), lambda b: b.evaluate(["author"], {"n": "count()"}), lambda b: b.evaluate(["genre"], {}), lambda b: b.evaluate(metrics={"n": "count(id)"}), lambda b: b.evaluate(metrics={"n": "sum()"}),
        lambda b: b.evaluate(metrics={"n": "sum(author)"}), lambda b: b.evaluate(metrics={"n": "median(price)"}), lambda b: b.evaluate(metrics={"n": "sum(isbn)"}), lambda b: b.evaluate(metrics={"n": "count"}), lambda b: b.evaluate(["genre"], {"n": "count()"}, order="q"),
        lambda b: b.evaluate(["genre"], {"genre": "count()"}), lambda b: b.append_series("author", 10, [(1, 1.0)]), lambda b: b.series("colour"), lambda b: b.create({"id": 1, "colour": 1}),
    ],
)
def test_refused(library, call):
    with pytest.raises(QueryError):
        call(library["Book"])


def test_unknown_and_abstract_types(spark, library):
    with pytest.raises(QueryError):
        library["Shelf"]
    ses = connect(spark, "abstract entity type Thing { id: string } entity type Lamp extends Thing { watts: int }")
    with pytest.raises(QueryError):
        ses["Thing"]
    assert ses["Lamp"].fetch().to_dicts() == []


def test_series(spark, tmp_path):
    ses = filled(spark, tmp_path, segment_points=7)
    M = ses["Member"]
    first = [(33 + 9 * k, k / 4) for k in range(16)]
    M.append_series("visits", 100, first)
    M.append_series("visits", rows=[(102, 8, 0.25), (100, 168, -0.0), (102, 8, 0.75)])
    for bad in ([(160, 1.0)], [(200, 1.0), (198, 1.0)]):
        with pytest.raises(StoreError):
            M.append_series("visits", 100, bad)
    assert [tuple(r) for r in M.series("visits", 102).collect()] == [(8, 0.25), (8, 0.75)]
    assert ses.stats()["series"]["points"] == 19 and ses.stats()["series"]["segments"] == 0
    ses.flush()
    ses.flush()
    assert ses.series.open_points().count() == 0 and ses.stats()["series"]["series"] == 2
    M.append_series("visits", 100, [(168, 6.5), (169, 7.5)])
    assert [tuple(r) for r in M.series("visits", 100, 159, 168).collect()] == [(159, 3.5), (168, 3.75), (168, -0.0), (168, 6.5)]
    with pytest.raises(StoreError):
        M.append_series("visits", 100, [(167, 1.0)])
    again = connect(spark, ses.model, f"file://{tmp_path}")
    assert again["Member"].series("visits").count() == 21 and again["Book"].count() == len(BOOKS)


def test_order_of_arrival_across_blocks(spark, tmp_path, monkeypatch):
    from marlstone.operators import series

    monkeypatch.setattr(series, "BLOCK_BITS", 1)
    ses = filled(spark, tmp_path)
    M = ses["Member"]
    for bad in ([2, 4, 6, 8, 10, 9], [15, 16, 3, 4, 5], [7, 7, 8, 20, 19, 21]):
        with pytest.raises(StoreError):
            M.append_series("visits", 104, [(t, 1.0) for t in bad])
    with pytest.raises(StoreError):
        M.append_series("visits", rows=spark.createDataFrame([(104, 1, None)], "k int, t bigint, v double"))
    good = [6, 6, 9, 11, 11, 11, 30]
    M.append_series("visits", 104, [(t, float(t)) for t in good])
    assert [r.ts for r in M.series("visits", 104).collect()] == good


def test_equal_times_across_a_segment_border(spark, tmp_path):
    ses = filled(spark, tmp_path, segment_points=3)
    ses["Member"].append_series("visits", 101, [(4, 1.0), (5, 2.0), (6, 3.0), (6, 4.0), (7, 5.0)])
    ses.flush()
    assert [r.value for r in ses["Member"].series("visits", 101, 6, 6).collect()] == [3.0, 4.0]


@pytest.mark.parametrize("bits", [17, 3])
def test_segments_are_full_whatever_the_partitions(spark, tmp_path, monkeypatch, bits):
    from marlstone.operators import series

    monkeypatch.setattr(series, "RUN_BITS", bits, raising=False)
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    own.conf.set("spark.sql.shuffle.partitions", "11")
    ses = filled(own, tmp_path, segment_points=4)
    # three batches; the first member has most points, times repeat
    rows = [(100 if k % 5 else 101 + k % 3, k // 3, k / 8) for k in range(150)]
    for batch in (rows[:70], rows[70:75], rows[75:]):
        ses["Member"].append_series("visits", rows=batch)
    told = {m: [(t, v) for key, t, v in rows if key == m] for m in {r[0] for r in rows}}
    ses.flush()
    want = [(str(m), ps[k][0], ps[k : k + 4][-1][0], len(ps[k : k + 4])) for m, ps in told.items() for k in range(0, len(ps), 4)]
    assert sorted(tuple(r) for r in ses.series.segments().select("key", "min_ts", "max_ts", "n").collect()) == sorted(want)
    e = ses.model["Member"]
    for m, ps in told.items():
        assert [(r.ts, r.value) for r in ses.series.points(e, e["visits"], key=m).orderBy("ts", "seq").collect()] == ps
    if bits == 3:  # one key is the work of many tasks
        points = own.createDataFrame([("Member", "visits", "7", k, 0.5, k) for k in range(90)], series.POINTS)
        assert series.encode_segments(points, 4).select(F.spark_partition_id()).distinct().count() > 3


def test_a_dropped_series_starts_empty(spark, tmp_path):
    ses = filled(spark, tmp_path, segment_points=3)
    points = [(k, 0.5 * k) for k in range(5)]
    ses["Member"].append_series("visits", 101, points)
    ses.flush()
    ses["Member"].append_series("visits", 101, [(9, 9.0)])
    whole = ses.model
    ses.evolve("entity type Author { id: int, name: string, land: string }", allow_destructive=True)
    ses.evolve(whole)
    assert ses["Member"].count() == 0 and ses["Member"].series("visits").count() == 0 and ses.stats()["series"]["points"] == 0
    ses["Member"].append_series("visits", 101, [(1, 1.5)])
    ses.flush()
    assert [tuple(r) for r in ses["Member"].series("visits", 101).collect()] == [(1, 1.5)]


def test_a_datetime_column_of_timestamps(spark):
    import datetime

    from marlstone import Binding

    rows = [(k + 1, datetime.datetime(1970, 1, 1, 0, 0, k)) for k in range(5)]
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(rows, f"id int, at {kind}")
        ses = connect(spark, "entity type E { id: int, at: datetime }", bindings={"E": Binding(df)})
        assert ids(ses["E"].fetch("at >= 2 and at < 4", order="id")) == [3, 4]
        assert ses["E"].fetch("at in [0, 1]", order="id").to_dicts() == [{"id": 1, "at": 0}, {"id": 2, "at": 1}]
        with pytest.raises(StoreError):
            ses["E"].remove([1])


def test_polymorphic(spark, tmp_path):
    text = """
    entity type Plant { id: string, units: [Unit](plantId, id), main: Unit(mainId), mainId: string }
    abstract entity type Unit { id: string, plantId: string, plant: Plant(plantId) }
    entity type Boiler extends Unit { pressure: double }
    entity type Motor extends Unit { rpm: int, parts: [Part](motorId, id) }
    entity type Part { id: string, motorId: string }
    """
    ses = connect(spark, text, f"file://{tmp_path}")
    ses["Plant"].create([{"id": "p", "mainId": "x"}, {"id": "q"}])
    ses["Boiler"].create([{"id": "b", "plantId": "p", "pressure": 1.5}, {"id": "x", "plantId": "p", "pressure": 2.0}])
    ses["Motor"].create([{"id": "m", "plantId": "p", "rpm": 9}, {"id": "x", "plantId": "q", "rpm": 7}, {"id": "b", "plantId": "p", "rpm": 1}])
    p = ses["Plant"].get("p", include=["units.plant", "main"])
    # a collection keeps each child, even where types share an id
    assert [(u["id"], u["_type"]) for u in p["units"]] == [("b", "Boiler"), ("b", "Motor"), ("m", "Motor"), ("x", "Boiler")]
    assert "rpm" not in p["units"][0] and p["units"][0]["plant"]["id"] == "p"
    assert [(u["id"], u["_type"]) for u in ses["Plant"].fetch('mainId == null', include=["units"]).to_dicts()[0]["units"]] == [("x", "Motor")]
    assert p["main"]["_type"] == "Motor"  # a reference finds the last type by name
    assert ids(ses["Plant"].fetch('main.plantId == "q"')) == ["p"]
    with pytest.raises(QueryError):
        ses["Plant"].fetch(include=["units.parts"])
    with pytest.raises(QueryError):
        ses["Plant"].fetch("main.rpm == 7")


def test_a_type_that_refers_to_itself(spark, tmp_path):
    ses = connect(spark, "entity type Node { id: int, upId: int, kind: string, up: Node(upId), downs: [Node](upId, id) }", f"file://{tmp_path}")
    ses["Node"].create([{"id": k, "upId": k // 2 or None, "kind": "odd" if k % 2 else "even"} for k in range(1, 8)])
    got = {r["id"]: r for r in ses["Node"].fetch(include=["up.up", "downs.downs"])}
    assert got[7]["up"]["up"]["id"] == 1 and got[1]["up"] is None and [d["id"] for d in got[1]["downs"]] == [2, 3]
    assert [x["id"] for d in got[1]["downs"] for x in d["downs"]] == [4, 5, 6, 7]
    assert sorted(ids(ses["Node"].fetch('up.kind == "even" and up.up.id == 1', include=["up"]))) == [4, 5]
    assert [(r["id"], len(r["downs"])) for r in ses["Node"].fetch('kind == "even"', include=["downs"], order="id")] == [(2, 2), (4, 0), (6, 0)]
