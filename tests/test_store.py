"""Writes as all-or-nothing batches of few files, and changes of model over stored rows."""

import pytest
from lending import AUTHORS, BOOKS, TEXT, filled

from marlstone import EvolutionError, StoreError, connect, load
from marlstone.operators.evolve import diff

A1, A2 = AUTHORS[0], AUTHORS[1]


def rows(ses, name):
    return {r["id"]: r for r in ses[name].fetch()}


def test_create_is_all_or_nothing(spark, tmp_path):
    ses = filled(spark, tmp_path)
    for bad in ([{"id": 8}, {"id": 1}], [{"id": 8}, {"id": 8}], [{"id": 8}, {"id": None}], [{"id": 8}, {"name": "x"}], [{"id": 2**31}], [{"id": True}], [{"id": 8, "name": 5}]):
        with pytest.raises(StoreError):
            ses["Author"].create(bad)
    with pytest.raises(StoreError):
        ses["Book"].create([{"id": 90, "isbn": "free"}, {"id": 91, "isbn": BOOKS[3]["isbn"]}])
    assert len(rows(ses, "Author")) == len(AUTHORS) and len(rows(ses, "Book")) == len(BOOKS)
    ses["Book"].create([{"id": 90}, {"id": 91}])  # null keys don't clash
    assert rows(ses, "Book")[91] == {"id": 91, "isbn": None, "authorId": None, "genre": "unsorted", "price": None, "pages": 1}


def test_upsert(spark, tmp_path):
    ses = filled(spark, tmp_path)
    ses["Author"].upsert([{"id": 1, "name": "Early"}, {"id": 1, "name": "Late", "land": None}, {"id": 6, "name": None}])
    got = rows(ses, "Author")
    assert got[1] == {"id": 1, "name": "Late", "land": None} and got[6] == {"id": 6, "name": None, "land": None} and got[2] == A2
    ses["Book"].upsert({"id": 11, "pages": None})
    assert rows(ses, "Book")[11] == {"id": 11, "isbn": None, "authorId": None, "genre": "unsorted", "price": None, "pages": None}
    with pytest.raises(StoreError):
        ses["Book"].upsert({"id": 12, "isbn": BOOKS[5]["isbn"]})
    assert rows(ses, "Book")[12] == BOOKS[2]
    # an index key may move from one row of the batch to another
    ses["Book"].upsert([{**BOOKS[2], "isbn": BOOKS[5]["isbn"]}, {**BOOKS[5], "isbn": BOOKS[2]["isbn"]}])
    assert rows(ses, "Book")[12]["isbn"] == BOOKS[5]["isbn"] and len(rows(ses, "Book")) == len(BOOKS)


def test_merge(spark, tmp_path):
    ses = filled(spark, tmp_path)
    ses["Author"].merge([{"id": 1, "name": None, "land": "fr"}, {"id": 3, "name": "A", "land": "it"}, {"id": 3, "name": "B", "land": None}, {"id": 50}])
    got = rows(ses, "Author")
    assert got[1] == {**A1, "land": "fr"} and got[3] == {"id": 3, "name": "B", "land": "it"} and got[50] == {"id": 50, "name": None, "land": None} and len(got) == len(AUTHORS) + 1
    ses["Book"].merge([{"id": 70}, {"id": 71, "pages": None}])
    assert rows(ses, "Book")[70]["pages"] == 1 and rows(ses, "Book")[71]["pages"] is None
    with pytest.raises(StoreError):
        ses["Book"].merge({"id": 12, "isbn": BOOKS[5]["isbn"]})


def test_remove_and_frames(spark, tmp_path):
    ses = filled(spark, tmp_path)
    ses["Author"].remove([1, 99])
    ses["Author"].remove(2)
    assert sorted(rows(ses, "Author")) == [3, 4]
    ses["Author"].create(spark.createDataFrame([(1, "X"), (9, "Y")], "id int, name string"))  # a removed id may come again
    assert rows(ses, "Author")[1] == {"id": 1, "name": "X", "land": None}
    with pytest.raises(StoreError):
        ses["Author"].create(spark.createDataFrame([(None, "X")], "id int, name string"))
    ses["Author"].remove(spark.createDataFrame([(9,)], "id int"))
    ses["Author"].remove([])
    assert set(rows(connect(spark, TEXT, f"file://{tmp_path}"), "Author")) == {1, 3, 4}
    ses.store.compact(ses.model["Author"])
    assert len(ses.store.vacuum("author")) >= 4 and ses.store.vacuum("author") == []
    assert set(rows(connect(spark, TEXT, f"file://{tmp_path}"), "Author")) == {1, 3, 4}


def test_a_write_adds_few_files_and_no_old_rows(spark, tmp_path):
    ses = filled(spark, tmp_path)
    e = ses.model["Book"]
    log = ses.store.log(e.table)
    first = log.read(log.version())
    ses["Book"].create({"id": 90, "isbn": "n"})
    ses["Book"].merge({"id": 10, "pages": 5})
    told = log.read(log.version())
    new = [f for f, _ in told["adds"][1:]]
    assert told["adds"][0] == first["adds"][0] and [spark.read.parquet(f"file://{tmp_path}/{e.table}/{f}").count() for f in new] == [1, 1] and len(told["gone"]) == 1
    assert not [n for n in ses.store.files.names(f"file://{tmp_path}/{e.table}") if n.startswith("batch")]
    assert any("GreaterThan(pages,300)" in x for x in ses["Book"].fetch("pages > 300").pushed_filters())
    assert ses["Book"].get(10)["pages"] == 5 and ses["Book"].count() == len(BOOKS) + 1


def test_folders_are_put_together(spark, tmp_path, monkeypatch):
    from marlstone.sources import store

    monkeypatch.setattr(store, "FOLDERS", 3)
    ses = filled(spark, tmp_path)
    for k in range(60, 64):
        ses["Author"].upsert([{"id": k}, {"id": 1, "name": str(k)}])
    log = ses.store.log("author")
    told = log.read(log.version())
    assert len(told["adds"]) + len(told["gone"]) <= 3 and len(rows(ses, "Author")) == len(AUTHORS) + 4 and rows(ses, "Author")[1]["name"] == "63"


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    one = filled(spark, tmp_path)
    two = connect(spark, TEXT, f"file://{tmp_path}")
    e = one.model["Author"]
    version = one.store.writable(e)
    two["Author"].create({"id": 70})
    with pytest.raises(StoreError):
        one.store.commit(e, version, one.store.rows(e, version), None, whole=True)
    one["Author"].create({"id": 71})
    assert {70, 71} <= set(rows(one, "Author"))
    manifest = one.series._manifest()
    two["Member"].append_series("visits", 100, [(1, 1.0)])
    with pytest.raises(StoreError):
        one.series._commit(manifest)


BASE = "entity type Shelf { id: string, label: string, room: string }"


@pytest.mark.parametrize(
    "text, kinds, safe",
    [
        (BASE, [], True),
        (BASE + " entity type T { id: string }", ["create_type"], True),
        ("entity type Shelf { id: string, label: string, room: string, metres: double = 2.5 }", ["add_column"], True),
        ("entity type Shelf { id: string, label: string }", ["drop_column"], False),
        ("entity type Other { id: string }", ["create_type", "drop_type"], False),
        ('entity type Shelf schema name "SHELVES" { id: string, label: string, room: string }', ["rename_table"], False),
        ('@db(index="label") entity type Shelf { id: string, label: string, room: string }', ["add_index"], True),
        ('entity type Shelf { id: string, tag: string schema name "label", room: string }', [], True),
        ('entity type Shelf { id: string, label: string schema name "l2", room: string }', ["add_column", "drop_column"], False),
        ("entity type Shelf { id: string, label: string, room: string = \"x\" }", [], True),
    ],
)
def test_diff(text, kinds, safe):
    plan = diff(load(BASE), load(text))
    assert [c.kind for c in plan] == kinds and plan.is_safe == safe and plan.is_empty == (not kinds) and len(plan.summary()) == len(kinds)


def test_diff_of_types_and_indexes():
    one = lambda t, mark="": load(f"{mark} entity type E {{ id: string, v: {t} }}")
    for a, b in (("int", "long"), ("int", "double"), ("long", "double"), ("boolean", "int"), ("datetime", "long")):
        assert [c.kind for c in diff(one(a), one(b))] == ["widen_column"]
        assert [c.kind for c in diff(one(b), one(a))] == ["narrow_column"]
    ix, ux = '@db(index="v")', '@db(unique="v")'
    assert [c.kind for c in diff(one("int", ix), one("int"))] == ["drop_index"]
    assert [(c.kind, c.safe) for c in diff(one("int", ix), one("int", ux))] == [("rebuild_index", True)]


def test_evolve(spark, tmp_path):
    ses = connect(spark, "entity type E { id: string, n: double, old: int } entity type Gone { id: string }", f"file://{tmp_path}")
    ses["E"].create([{"id": "a", "n": 1.5, "old": 7}, {"id": "b", "n": 1e300}, {"id": "c", "n": 3.0}])
    ses["Gone"].create({"id": "g"})
    with pytest.raises(EvolutionError):
        ses.evolve("entity type E { id: string, n: int, kw: double = 0.5 }")
    assert ses["E"].get("a") == {"id": "a", "n": 1.5, "old": 7}
    plan = ses.evolve('entity type E schema name "renamed" { id: string, n: int, kw: double = 0.5 } entity type New { id: string }', allow_destructive=True)
    assert {c.kind for c in plan} == {"create_type", "drop_type", "rename_table", "add_column", "drop_column", "narrow_column"}
    assert rows(ses, "E") == {"a": {"id": "a", "n": 1, "kw": 0.5}, "b": {"id": "b", "n": None, "kw": 0.5}, "c": {"id": "c", "n": 3, "kw": 0.5}}
    ses["New"].create({"id": "x"})
    ses.evolve('entity type E schema name "renamed" { id: string, n: long, kw: double } entity type New { id: string }')
    assert ses["E"].get("a")["n"] == 1 and ses["E"].fetch().df.schema["n"].dataType.simpleString() == "bigint"
    assert ses.evolve(ses.model).is_empty
    ses["E"].merge({"id": "a", "kw": 2.0})
    assert ses["E"].get("a") == {"id": "a", "n": 1, "kw": 2.0} and len(rows(ses, "E")) == 3
