"""Line templates against a brute-force version."""

import inspect
import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.llm import line_templates as lt


def templates(line):
    w = re.sub("[0-9]+", "0", line).split()
    n, m = len(w), len(w) - lt.LEADING
    if n >= 11:
        f = [tuple(w[lt.LEADING + m * k // lt.FIELDS : lt.LEADING + m * (k + 1) // lt.FIELDS]) for k in range(lt.FIELDS)]
        return [(n, tuple(w[: lt.LEADING]), tuple(None if j == k else f[j] for j in range(lt.FIELDS))) for k in (-1, *range(lt.FIELDS))]
    out = [tuple(w)] if w else []
    if n >= 5:
        out += [(*w[:k], None, *w[k + 1 :]) for k in range(1, n)]
    names = [k for k in range(1, n) if w[k][0].isupper()]
    if names and n - len(names) >= 2:
        out.append(("N", *(None if k in names else x for k, x in enumerate(w) if k not in names or k - 1 not in names)))
    return out


def slow(rows, min_docs):
    where = {}
    for k, (i, t) in enumerate(rows):
        if t is not None:
            for x in {x for line in t.split("\n") for x in templates(line)}:
                where.setdefault(x, []).append(i)
    first = {x: min((i for i in ids if i is not None), default=None) for x, ids in where.items() if len(ids) >= min_docs}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        stay = [x for x in lines if not any(first.get(p) is not None and (i is None or i > first[p]) for p in templates(x))]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs", [1, 2, 3])
def test_against_brute_force(spark, min_docs):
    rng = random.Random(min_docs)
    long = [" ".join(rng.choices("abcdefgh", k=rng.randint(10, 30))) for _ in range(6)]
    pool = [*long, "All rights reserved.", "page 12 of 30", "page 7 of 9", "", "two words", "same  blanks here", "x", "Share this page with Anna Lee now", "by Bob", "Posted by Ed on Monday", "tabs\tand\u00a0more of them here"]
    rows = [(1, None), (2, ""), (None, "All rights reserved."), (3, "\n\n"), (3, "\n\n"), (4, "\n".join(pool * 2))]
    for i in range(5, 60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(pool).split(" ")
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] = f"edit{rng.randint(0, 3)}"
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += rows[10:14]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, digest string, pos int")
    out = lt.without_templates(docs, min_docs=min_docs, counts=True)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=str)
    assert got == slow(rows, min_docs)
    assert lt.without_templates(docs).columns == docs.columns
    assert lt.without_templates(docs.limit(0)).count() == 0


def test_main_path_has_no_python():
    source = inspect.getsource(lt)
    assert not re.search(r"udf|pandas|mapInArrow|mapInPandas|\.rdd|import pyarrow", source)


def test_very_long_documents(spark):
    text = "\n".join(f"line of words number {chr(97 + k % 26)} here" for k in range(20_000))
    docs = spark.createDataFrame([(i, text) for i in range(4)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in lt.without_templates(docs).collect()}
    assert got == {0: text, 1: "", 2: "", 3: ""}


def test_every_line(spark):
    """Lines of one or two tokens, and of words parted by other white space than blanks, are boilerplate too."""
    lines = ["Menu", "Read more", "全ての権利は留保されています", "one\ttwo\tthree", "four\u00a0five\u3000six"]
    rows = [(i, "\n".join([*lines, "", " \t", f"own {chr(97 + i)}"])) for i in range(4)]
    docs = spark.createDataFrame([*rows, (9, "one two  three\nfour five six\nread More"), (10, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in lt.without_templates(docs).collect()}
    assert got == {0: rows[0][1], **{i: f"\n \t\nown {chr(97 + i)}" for i in (1, 2, 3)}, 9: "read More", 10: None}
    assert next(f for name, f in __import__("corpus_pipeline").STAGES if name == "lines")(spark, docs, "").where("doc_id = 1").first().text == got[1]


def test_short_boilerplate_with_variable_fields(spark):
    people = ["Anna", "Bob Lee", "Émile de Q", "Xi"]
    rows = [(i, f"Share this story with {p.split()[0]}\nPosted by {p} on {d} 12\nthe price of {x} rose again today\nI saw {x}\nown {x}") for i, (p, d, x) in enumerate(zip(people, ["Monday", "Friday", "Sunday", "Monday"], ["oil", "tea", "rye", "tin"]))]
    got = {r.doc_id: r.text for r in lt.without_templates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0] == rows[0][1] and got[1] == "I saw tea\nown tea" and got[3] == "I saw tin\nown tin"
    # "Émile de Q" has a word between its names: a template of its own
    assert got[2] == "Posted by Émile de Q on Sunday 12\nI saw rye\nown rye"


def test_no_template_for_nothing(spark):
    """The line itself is no template where another is there; fewer templates are hashed, written and shuffled."""
    lines = ["", " \t", "one", "one two three four", "one two Anna four", "a b c d e", "a b Bob d e", "a b c d e f g h i j", " ".join("abcdefghijk"), " ".join("abcdefghij" * 9)]
    docs = spark.createDataFrame([("\n".join(lines),)], "text string")
    got = docs.select(F.transform(lt._templates(F.col("text")), lambda t: F.size(t)).alias("n")).first().n
    assert got == [0, 0, 1, 1, 2, 4, 5, 9, lt.FIELDS, lt.FIELDS]


def test_once(spark):
    rows = [([[(1, 2), (1, 3)], [], [(2, 2)]],), ([[(1, 2), (1, 3)], [(1, 2), (0, 9)], [(1, 3), (1, 2)]],), ([],), ([[]],)]
    docs = spark.createDataFrame(rows, "t array<array<struct<h: bigint, g: bigint>>>")
    got = [sorted(map(tuple, r.t)) for r in docs.coalesce(1).select(lt._once(F.col("t")).alias("t")).collect()]
    assert got == [[(1, 2), (1, 3), (2, 2)], [(0, 9), (1, 2), (1, 3)], [], []]


def test_many_lines_of_one_document(spark):
    """Work grows with the lines, not with their pairs: 40,000 lines, all unlike but for two that have a template in common."""
    word = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    text = "\n".join([*(f"{word(k)} {word(k * 7)} {word(k * 11)} {word(k * 13)} own here" for k in range(40_000)), "so says he who knows", "so says she who knows"])
    docs = spark.createDataFrame([(i, text) for i in range(2)] + [(2, "so says it who knows")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in lt.without_templates(docs).collect()}
    assert got == {0: text, 1: text.rsplit("\n", 2)[0], 2: ""}


@pytest.mark.parametrize("blank", [chr(k) for k in (9, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
def test_blanks(spark, blank):
    rows = [(1, "one two three\na b c d e f g h i j k l"), (2, f"{blank}one{blank} two {blank}three{blank}\na b c d e f g h i{blank}j k {blank}l"), (3, f" one two{blank}{blank}three \na b c d{blank}e f g h i  j k l ")]
    got = {r.doc_id: r.text for r in lt.without_templates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: rows[0][1], 2: "", 3: ""}


def test_hashes_are_of_strings_with_their_places(spark):
    """Fields or tokens that change places, and a token that is the sign for variable ones."""
    rows = [(1, "x a b c d"), (2, "x b a c d"), (3, "x c b a d"), (4, "y a b \x01 d e"), (5, "y a c f d e"), (6, "y a \x01 g d e"), (7, " ".join("abcddeeffgg")), (8, " ".join("abcffeeddgg")), (9, " ".join("abcggeeffdd"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in lt.without_templates(docs, min_docs=2).collect()}
    assert got == dict(rows) | {6: ""}
