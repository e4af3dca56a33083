"""The modelling language: tokens, grammar, flattening and what is refused."""

import pytest

from marlstone import GrammarError, ModelError, ScanError, load
from marlstone.schema.text import parse, scan

P = "mixin type P { id: string } "


def test_tokens_and_places():
    got = scan('a : // c\n  "q\\"\\n" /* x\ny */ -1.5 -2 true')
    assert [(t.kind, t.value, t.line) for t in got[:-1]] == [("name", "a", 1), ("sign", ":", 1), ("string", 'q"\n', 2), ("number", -1.5, 3), ("number", -2, 3), ("word", "true", 3)]
    assert (got[2].line, got[2].col) == (2, 3) and got[-1].kind == "end"
    for bad in ("a $ b", '"open', '"\\q"', "/* open"):
        with pytest.raises(ScanError):
            scan(bad)
    with pytest.raises(ScanError) as e:
        scan("a\n  $")
    assert (e.value.line, e.value.col) == (2, 3)


def test_grammar():
    one, two = parse('@db(index="a") @db(index="b", unique="c") @note @empty() abstract entity type T extends S mixes M, N schema name "X" { name: string = "a", r: R(k) c: [C](x, y); }'.replace(";", "") + " mixin type M { s: timeseries<int>(k) f: double schema name \"F\" = 1.5 }")
    assert (one.name, one.abstract, one.extends, one.mixes, one.table) == ("T", True, "S", ["M", "N"], "X")
    assert one.marks == {"db": {"index": "b", "unique": "c"}, "note": {}, "empty": {}}
    assert [(f.name, f.kind, f.type, f.keys) for f in one.fields] == [("name", "primitive", "string", ()), ("r", "reference", "R", ("k",)), ("c", "collection", "C", ("x", "y"))]
    assert two.mixin and two.fields[0].kind == "timeseries" and (two.fields[1].column, two.fields[1].default) == ("F", 1.5)
    assert parse("") == []
    for bad in ("entity T {}", "type T {}", "entity type T { a }", "entity type T { a: }", "entity type T { a: [B](x) }", "entity type T { a: timeseries(x) }", "entity type T { a: int = }", "entity type T { a: int schema \"x\" }", "entity type T {", "entity type type { }", "abstract mixin type M {}", "@db(index) entity type T {}", "entity type T { a: int = b }"):
        with pytest.raises(GrammarError):
            parse(bad)


def test_flattening():
    m = load(
        """
        mixin type A { a: int = 1 } mixin type B { id: string, b: int = 2 }
        abstract entity type Base mixes A, B { c: int }
        @db(unique="a,own", index="c")
        entity type LeafType extends Base mixes A { own: int schema name "OWN", c: int schema name "C2" = 9 }
        entity type Sub extends LeafType { d: boolean }
        """
    )
    leaf = m["LeafType"]
    assert list(leaf.fields) == ["id", "a", "b", "c", "own"] and leaf.table == "leaf_type"
    assert leaf["c"].column == "C2" and not leaf["c"].has_default
    assert leaf.indexes() == {"ux_leaf_type_a_OWN": (True, ("a", "OWN")), "ix_leaf_type_C2": (False, ("C2",))}
    assert m["Sub"].indexes() == {} and m["Sub"].isa("Base") and m["Sub"].isa("A") and not m["Base"].isa("Sub")
    assert [e.name for e in m.concrete_of("Base")] == ["LeafType", "Sub"] and [e.name for e in m.concrete_of("LeafType")] == ["LeafType"]
    assert leaf.schema.simpleString() == "struct<id:string,a:int,b:int,c:int,own:int>" and "`OWN` INT" in leaf.ddl()
    assert m.names == ["Base", "LeafType", "Sub"] and "A" not in m


def test_fingerprint():
    base = load(P + "entity type E mixes P { a: int }").fingerprint()
    assert base == load(P + "entity type E mixes P { a: int = 3, r: E(a) }").fingerprint()
    assert base != load(P + "entity type E mixes P { a: long }").fingerprint()
    assert base != load(P + '@db(index="a") entity type E mixes P { a: int }').fingerprint()


@pytest.mark.parametrize(
    "text",
    [
        "entity type A extends B { id: int } entity type B extends A { id: int }", "entity type A extends Gone { id: int }", "entity type A { id: int } entity type A { id: int }", P + "entity type A extends P { }", "entity type A mixes Gone { id: int }",
        "entity type B { id: int } entity type A mixes B { id: int }", P + "entity type A mixes P { id: int }", 'entity type A schema name "t" { id: int } entity type B schema name "t" { id: int }', "entity type A { a: int }", "entity type A { id: A(id) }",
        "entity type A { id: int, a: money }", 'entity type A { id: int, a: int schema name "id" }', "entity type A { id: int, r: Gone(id) }", "entity type A { id: int, r: A(gone) }", "entity type A { id: int, r: A(s), s: A(id) }",
        "entity type A { id: int, c: [Gone](id, id) }", "entity type A { id: int, c: [A](gone, id) }", "entity type A { id: int, c: [A](c, id) }", "entity type A { id: int, c: [A](id, gone) }", "entity type A { id: int, s: timeseries<string>(id) }",
        "entity type A { id: int, s: timeseries<int>(gone) }", '@db(index="gone") entity type A { id: int }', '@db(index="r") entity type A { id: int, r: A(id) }', "abstract entity type A { a: int }",
    ],
)
def test_refused(text):
    with pytest.raises(ModelError):
        load(text)
