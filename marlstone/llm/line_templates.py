"""Line dedup by a log-template tree, in DataFrame functions only (operator 10).

The tree has a fixed depth: a line's number of tokens, its leading tokens, then its template. Runs of digits are
variable always. Each line that has a token has the template of itself (which is left out where one of the others is there:
that one stands in all rows in which the line does); besides it,

- from LONG tokens on, the tokens after the leading ones are cut into fields, and each field in turn may be variable;
- in shorter lines, each token after the first may be, if four others are left (Drain's rule that most of a line is fixed), and
  so may be all names at once: runs of capitalised tokens after the first, if two tokens are left.

A template that stands in `min_docs` documents or more is boilerplate: its lines are dropped from all documents but the first (least
doc_id), which keeps one copy of what is said, even where whole documents are copies of each other.

Tokens stand between runs of any white space. A row counts as a document;
repeats within a row count once. Rows of equal doc_id and text have equal results. A null doc_id is never first; a
template seen under null ids alone is kept. Lines without a token stay. Null text stays null, a document may become empty, and no row goes.
Only hashes are shuffled for the counts (two of 64 bits for each template), never lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LEADING, FIELDS, MIN_DOCS = 3, 4, 3
#: Tokens from which on a line is cut into fields; others that must be left beside a variable token, and beside names.
LONG, BESIDE, NAMED = LEADING + 2 * FIELDS, 4, 2

# Unicode's white space (without the line feed, at which lines end), and a run of capitalised tokens.
BLANK = r"[\x{9}\x{B}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
# White space other than the plain blank; what comes before && spares nearly all characters the long list (a third of the time).
OTHER = rf"[\x{{9}}-\x{{D}}\x{{85}}-\x{{3000}}&&{BLANK[:-1]}]"
NAME = r"^\p{Lu}"
NAMES = r"( \p{Lu}[^ ]*)+"
#: Stands for what is variable.
ANY = "\x01"


def _templates(text: Column) -> Column:
    """For each line, hashes (h, g) of its templates.

    Every step is a transform of its own, so that what it gives is computed once and not once for each use. Lines are cut as
    strings (a token is what stands between two blanks), as most of the work would be an object for each token. A template is
    the line's hash without that of the variable part: hashes of parts know their places and are put together by xor.
    """
    plain = F.when(text.rlike(f"[0-9{OTHER}]"), F.regexp_replace(F.regexp_replace(text, "[0-9]+", "0"), OTHER, " ")).otherwise(text)
    lines = F.transform(F.split(plain, "\n"), lambda line: F.trim(F.when(line.contains("  "), F.regexp_replace(line, "  +", " ")).otherwise(line)))

    def pair(x: Column, y: Column) -> Column:
        return F.struct(F.xxhash64(x, y).alias("h"), F.xxhash64(y, x).alias("g"))

    def xor(x: Column, y: Column) -> Column:
        return F.struct(x["h"].bitwiseXOR(y["h"]).alias("h"), x["g"].bitwiseXOR(y["g"]).alias("g"))

    def part(w: Column, k: Column) -> Column:
        """A token that is the sign itself counts as variable, as it does in the SQL."""
        return F.when(w == ANY, F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("g"))).otherwise(pair(k, w))

    def sized(s: Column) -> Column:
        n = F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit(""))) + 1
        return F.struct(s.alias("s"), F.when(s == "", 0).otherwise(n).alias("n"))

    def bounded(x: Column) -> Column:
        ends = [(LEADING + F.floor((x["n"] - LEADING) * k / FIELDS)).cast("int") for k in range(1, FIELDS)]
        return F.struct(x["s"].alias("s"), x["n"].alias("n"), F.when(x["n"] >= LONG, F.array(F.lit(LEADING), *ends, x["n"])).alias("b"))

    def parted(x: Column) -> Column:
        """What is fixed at the line's start, and its parts after that: fields, or tokens if it is short."""
        s, n, b = x["s"], x["n"], x["b"]
        fields = [_part(_part(s, b[k + 1]) if k < FIELDS - 1 else s, b[k] - b[k + 1]) for k in range(FIELDS)]
        parts = F.when(n >= LONG, F.array(*fields)).otherwise(F.slice(F.split(s, " "), 2, LONG))
        return F.struct(s.alias("s"), n.alias("n"), _part(s, F.when(n >= LONG, LEADING).otherwise(1)).alias("top"), parts.alias("parts"))

    def hashed(x: Column) -> Column:
        n, parts = x["n"], x["parts"]
        names = F.when(n < LONG, F.size(F.filter(parts, lambda w: w.rlike(NAME)))).otherwise(0)
        return F.struct(x["s"].alias("s"), n.alias("n"), names.alias("names"), pair(n, x["top"]).alias("top"), F.transform(parts, part).alias("parts"))

    def whole(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("s", "n", "names", "parts")], F.aggregate(x["parts"], x["top"], xor).alias("line"))

    def templates(x: Column) -> Column:
        n, line = x["n"], x["line"]
        each = F.transform(x["parts"], lambda y: xor(line, y))
        none = F.slice(F.array(line), 1, 0)
        named = F.array(pair(F.lit("N"), F.regexp_replace(x["s"], NAMES, " " + ANY)))
        # the line itself stands for nothing more where another template is there, which is in all rows in which the line is
        short = F.concat(F.when(n > BESIDE, each).otherwise(F.array(line)), F.when((x["names"] > 0) & (n - x["names"] >= NAMED), named).otherwise(none))
        return F.when(n >= LONG, each).when(n == 0, none).otherwise(short)

    for step in (sized, bounded, parted, hashed, whole, templates):
        lines = F.transform(lines, step)
    return lines


def _part(s: Column, k: Column) -> Column:
    """The first k tokens, the last -k if k is negative."""
    return F.call_function("substring_index", s, F.lit(" "), k)


def _once(t: Column) -> Column:
    """Each template of a row once, in time that grows with their number (array_distinct compares each two structs)."""
    every = F.flatten(t)

    def unlike(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1)))

    # most rows repeat none, which their first hashes tell
    return F.when(F.size(F.array_distinct(every["h"])) == F.size(every), every).otherwise(F.flatten(F.transform(F.array(F.sort_array(every)), unlike)))


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """id, digest (of the text) and the positions of the lines to drop, for documents that have any."""
    rows = docs.where(F.col(f"`{text}`").isNotNull())
    told = written(rows.select(F.col(f"`{key}`").alias("id"), F.xxhash64(f"`{text}`").alias("digest"), _templates(F.col(f"`{text}`")).alias("t")), "templates")
    seen = told.select("id", F.explode(_once(F.col("t"))).alias("t")).select("id", "t.*")
    common = seen.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") >= min_docs).select("h", "g", "first")
    places = told.select("id", "digest", F.posexplode("t").alias("pos", "t")).select("id", "digest", "pos", F.explode("t").alias("t")).select("id", "digest", "pos", "t.*")
    later = places.join(common, ["h", "g"]).where("first is not null and (id is null or id > first)")
    return later.groupBy("id", "digest").agg(F.collect_set("pos").alias("drop"))


def without_templates(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, counts: bool = False) -> DataFrame:
    """The documents without the dropped lines; with counts, also n_lines and n_dropped."""
    lost = dropped_lines(docs, key, text, min_docs)
    d, x = docs.alias("d"), lost.alias("x")
    both = d.join(x, F.col(f"d.`{key}`").eqNullSafe(F.col("x.id")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("x.digest")), "left")
    lines = F.split(F.col(f"d.`{text}`"), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("x.drop"))
    rest = F.transform(F.array(lines), lambda x: F.transform(stay, lambda k: F.get(x, k)))  # else the text is split for each line that stays
    left = F.when(F.col("x.drop").isNull(), F.col(f"d.`{text}`")).otherwise(F.array_join(F.flatten(rest), "\n"))
    out = [left.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns]
    if counts:
        out += [F.when(F.col(f"d.`{text}`").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.coalesce(F.array_size("x.drop"), F.lit(0)).alias("n_dropped")]
    return both.select(out)


#: The same over DuckDB's `documents`, with templates as strings.
SQL = f"""
WITH told AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, text, pos, list_filter(regexp_split_to_array(regexp_replace(line, '[0-9]+', '0', 'g'), '{BLANK}'), lambda x: x <> '') AS w FROM told),
field AS (SELECT doc_id, text, pos, w, len(w) AS n, list_slice(w, 1, {LEADING}) AS lead, len(list_filter(w[2:], lambda x: regexp_matches(x, '{NAME}'))) AS names,
  [list_slice(w, ({LEADING} + (len(w) - {LEADING}) * k // {FIELDS} + 1)::BIGINT, ({LEADING} + (len(w) - {LEADING}) * (k + 1) // {FIELDS})::BIGINT) FOR k IN range({FIELDS})] AS f FROM cut WHERE len(w) >= 1),
template AS (SELECT doc_id, text, pos, unnest(CASE
  WHEN n >= {LONG} THEN list_concat([to_json([n::VARCHAR, lead::VARCHAR, f::VARCHAR])], [to_json([n::VARCHAR, lead::VARCHAR, k::VARCHAR, [CASE WHEN j - 1 = k THEN NULL ELSE f[j] END FOR j IN range(1, {FIELDS} + 1)]::VARCHAR]) FOR k IN range({FIELDS})])
  ELSE list_concat([to_json(['=', w::VARCHAR])],
    CASE WHEN n > {BESIDE} THEN [to_json(['*', list_concat(w[1:i - 1], [chr(1)], w[i + 1:])::VARCHAR]) FOR i IN range(2, n + 1)] ELSE [] END,
    CASE WHEN names > 0 AND n - names >= {NAMED} THEN [to_json(['N', regexp_replace(array_to_string(w, ' '), '{NAMES}', ' ' || chr(1), 'g')])] ELSE [] END) END) AS t FROM field),
common AS (SELECT t, min(doc_id) AS first FROM (SELECT DISTINCT doc_id, text, t FROM template) GROUP BY t HAVING count(*) >= {MIN_DOCS}),
lost AS (SELECT DISTINCT doc_id, text, pos FROM template JOIN common USING (t) WHERE doc_id > first),
kept AS (SELECT t.doc_id, t.text, count(*) AS n_lines, count(l.pos) AS n_dropped, coalesce(string_agg(t.line, chr(10) ORDER BY t.pos) FILTER (WHERE l.pos IS NULL), '') AS left_text
  FROM told t LEFT JOIN lost l ON t.doc_id = l.doc_id AND t.text = l.text AND t.pos = l.pos GROUP BY ALL)
SELECT d.doc_id, k.left_text AS text, coalesce(k.n_lines, 0)::INTEGER AS n_lines, coalesce(k.n_dropped, 0)::INTEGER AS n_dropped FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text
"""
