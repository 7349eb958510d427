"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings (operator 2)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import inside, joined, with_drawers, with_places

#: The base kinds, in the order of the report, with the shortest accepted length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24


@dataclass(frozen=True)
class EntropyClass:
    """Candidates drawn from one character class, and the entropy in bits per character that a window of them must reach."""

    name: str
    alphabet: str
    window: int
    least_bits: float
    folded: bool = False

    @property
    def symbols(self) -> str:
        return "".join(dict.fromkeys(self.alphabet.lower())) if self.folded else self.alphabet

    @property
    def pattern(self) -> str:
        return f"[{self.alphabet.replace('-', chr(92) + '-')}]{{{self.window},}}"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A random window of 24 hex digits of either case has about 3.4 bits a character, one of 24 base-32 characters about 4.0, one of 24 base-64 characters about
#: 4.3; words and repeats have less. Hex digits are counted without regard to case.
CLASSES = (EntropyClass("entropy_hex", "0123456789ABCDEFabcdef", 24, 3.0, True), EntropyClass("entropy_base32", _UPPER + "234567", 24, 3.7),
           EntropyClass("entropy_base64", _UPPER + _LOWER + "0123456789+/_-", 24, 3.9))
#: Candidates that are no secrets as a whole: identifiers of a public format.
ALLOWED_WHOLE = (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",)
#: Placeholders and counting strings: a window that touches one is no secret, the rest of its candidate may be.
ALLOWED_WORDS = ("example", "sample", "placeholder", "changeme", "dummy", "xxxx", "test_key", "testkey", "0123456789", "abcdefghij", "deadbeef")
KINDS = ("assign", "access", "hex", *(c.name for c in CLASSES))
_SCALE = 1 << 20
#: Counts of up to 31 that a 64-bit integer holds.
_PACKED = 12


def _weight(n: int) -> int:
    return round(_SCALE * n * math.log2(n)) if n else 0


def _windows(c: EntropyClass, text: Column) -> Column:
    """Start of the first and end of the last window of ``text`` with enough entropy; both null if there is none.

    A window's entropy is log2(W) - sum(n * log2(n)) / W over the counts n of its characters. One pass keeps the counts and
    that sum: each step adds the entering character and takes the leaving one out, which changes one or two of a few integers that hold twelve counts each.
    Sums are fixed-point, hence exact. A window with a character outside the class (a blanked word) is none.
    """
    w, symbols = c.window, c.symbols
    fields = [f"n{k}" for k in range(-(-len(symbols) // _PACKED))]
    most = int(w * (math.log2(w) - c.least_bits) * _SCALE)
    weights = F.array(*(F.lit(_weight(n)).cast("long") for n in range(w + 2)))
    at = lambda n: F.element_at(weights, n + 1)
    coded = F.split(text, "")
    code = lambda i: F.when(i >= 1, F.position(F.element_at(coded, F.greatest(i, F.lit(1))), F.lit(symbols))).otherwise(0)
    shift = lambda k: ((k - 1) % _PACKED * 5).cast("int")

    def count(acc, k):
        held = F.element_at(F.array(*(acc[f] for f in fields)), F.greatest(F.ceil(k / _PACKED).cast("int"), F.lit(1)))
        return F.call_function("shiftright", held, shift(k)).bitwiseAND(F.lit(31)).cast("int")

    def step(acc, x):
        enter, leave, i = x["enter"], x["leave"], x["i"]
        n_in, n_out = count(acc, F.greatest(enter, F.lit(1))), F.when(leave > 0, count(acc, F.greatest(leave, F.lit(1)))).otherwise(1)
        same = enter == leave
        rise = F.when((enter > 0) & ~same, at(n_in + 1) - at(n_in)).otherwise(0)
        fall = F.when((leave > 0) & ~same, at(n_out - 1) - at(n_out)).otherwise(0)
        one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), shift(F.greatest(k, F.lit(1))))
        part = lambda k, f: F.when(F.ceil(k / _PACKED) == f + 1, one(k)).otherwise(F.lit(0).cast("long"))
        total = acc["total"] + rise + fall
        bad = F.when(enter == 0, i).otherwise(acc["bad"])
        good = (i - bad >= w) & (total <= most)
        return F.struct(*((acc[f] + part(enter, j) - part(leave, j)).alias(f) for j, f in enumerate(fields)), total.alias("total"), bad.alias("bad"),
                        F.when(good & acc["first"].isNull(), i - w).otherwise(acc["first"]).alias("first"), F.when(good, i).otherwise(acc["past"]).alias("past"))

    start = F.struct(*(F.lit(0).cast("long").alias(f) for f in fields), F.lit(0).cast("long").alias("total"), F.lit(0).alias("bad"),
                     F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("past"))
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.struct(code(i).alias("enter"), code(i - w).alias("leave"), i.alias("i")))
    return F.aggregate(codes, start, step, lambda acc: F.struct(acc["first"], acc["past"]))


def _base(name: str, kind: int, least: int) -> Column:
    size = (lambda m: F.length(F.regexp_extract(m, ASSIGN, 2))) if name == "assign" else F.length
    ok = F.filter(F.col(name), lambda p: size(p["match"]) >= least)
    return F.transform(ok, lambda p: _span(p["first"], F.lit(kind), p["past"]))


def _span(first: Column, kind: Column, past: Column) -> Column:
    return F.struct(first.alias("first"), kind.alias("kind"), past.alias("past"))


def _blanked(c: EntropyClass, match: Column) -> Column:
    """A candidate as its class counts it, allowed words replaced by as many blanks."""
    text = F.lower(match) if c.folded else match
    for word in ALLOWED_WORDS:
        text = F.regexp_replace(text, f"(?i){word}", " " * len(word))
    return text


def _entropic(c: EntropyClass, kind: int) -> Column:
    """Spans of the windows with enough entropy in candidates of the class that mix digits and letters and are not allowed."""
    def wanted(p):
        ok = p["match"].rlike("[0-9]") & p["match"].rlike("[A-Za-z]")
        for a in ALLOWED_WHOLE:
            ok = ok & ~p["match"].rlike(a)
        return ok

    read = F.transform(F.filter(F.col(c.name), wanted), lambda p: F.struct(p["first"].alias("at"), _blanked(c, p["match"]).alias("text")))
    tested = F.transform(read, lambda p: F.struct(p["at"].alias("at"), _windows(c, p["text"]).alias("w")))
    return F.transform(F.filter(tested, lambda t: t["w"]["first"].isNotNull()),
                       lambda t: _span(t["at"] + t["w"]["first"], F.lit(kind), t["at"] + t["w"]["past"]))


def secret_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``base`` and ``spans``: arrays of (first, kind index into ``KINDS``, past), sorted.

    Base spans always stay; an entropy span is added unless a base span covers it. A null text is empty and has no spans; rows are
    scanned one by one and never shuffled, so repeated rows give equal results and an empty table an empty one. Very long texts are scanned whole: the work
    is linear in a candidate, and spans are compared within drawers of positions. Column expressions only.
    """
    base = {"assign": (ASSIGN, ASSIGN_LEAST), "access": (ACCESS, ACCESS_LEAST), "hex": (HEX, HEX_LEAST)}
    # a run that is long enough is the same run under the longer lower bound, and short runs are never listed
    patterns = {"assign": ASSIGN, "access": f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", "hex": f"[0-9a-f]{{{HEX_LEAST},}}", **{c.name: c.pattern for c in CLASSES}}
    df = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = with_places(df, "text", patterns).drop("text")
    df = df.select("row", *(c.name for c in CLASSES),
                   F.sort_array(F.concat(*(_base(k, i, base[k][1]) for i, k in enumerate(base)))).alias("base"))
    df = with_drawers(df, "base")
    df = df.select("row", "base", "drawers", F.concat(*(_entropic(c, len(base) + i) for i, c in enumerate(CLASSES))).alias("more"))
    extra = F.filter("more", lambda s: ~inside(s, F.col("drawers")))
    return df.select("row.*", "base", F.sort_array(F.concat("base", extra)).alias("spans"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id``, the number of base matches of each kind, the digest of the base spans, and all spans as text."""
    df = secret_spans(docs, ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return df.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
                     F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))


def _sql_places(kind: int, pattern: str, ok: str) -> str:
    return f"""
  SELECT doc_id, row_no, {kind} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
      'first': list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0), 'match': m[i]}})) AS s
  FROM (SELECT doc_id, row_no, regexp_extract_all(text, {pattern}) AS m, string_split_regex(text, {pattern}) AS p FROM d)
  WHERE len(m) > 0"""


def oracle_sql() -> str:
    """DuckDB SQL for ``scan_secrets``; every window's entropy is counted anew, in the same fixed-point units."""
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    weights = "[" + ", ".join(str(_weight(n)) for n in range(max(c.window for c in CLASSES) + 1)) + "]"
    parts = [_sql_places(0, lit(ASSIGN), ""), _sql_places(1, lit(ACCESS), ""), _sql_places(2, lit(HEX), "")]
    cands, tests = [], []
    allowed = " AND ".join(f"NOT regexp_matches(s.match, {lit(a)})" for a in ALLOWED_WHOLE)
    for i, c in enumerate(CLASSES):
        most = int(c.window * (math.log2(c.window) - c.least_bits) * _SCALE)
        text = "lower(s.match)" if c.folded else "s.match"
        for word in ALLOWED_WORDS:
            text = f"regexp_replace({text}, {lit(word)}, {lit(' ' * len(word))}, 'gi')"
        cands.append(_sql_places(3 + i, lit(c.pattern), ""))
        tests.append(f"""
  SELECT doc_id, row_no, kind, s.first + list_min(good) - 1 AS first, s.first + list_max(good) - 1 + {c.window} AS past
  FROM (SELECT *, list_filter(range(1, length(s.match) - {c.window} + 2), lambda i: NOT contains(substr(t, CAST(i AS BIGINT), {c.window}), ' ') AND list_sum(list_transform(
          map_values(list_histogram(string_split(substr(t, CAST(i AS BIGINT), {c.window}), ''))), lambda n: w[CAST(n AS BIGINT) + 1])) <= {most}) AS good
        FROM (SELECT *, {text} AS t FROM cand), (SELECT {weights} AS w)
        WHERE kind = {3 + i} AND regexp_matches(s.match, '[0-9]') AND regexp_matches(s.match, '[A-Za-z]') AND {allowed})
  WHERE len(good) > 0""")
    names = "[" + ", ".join(lit(k) for k in KINDS) + "]"
    text = f"string_agg(concat({names}[kind + 1], ':', first, ':', past), ',' ORDER BY first, kind)"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_no FROM documents),
found AS MATERIALIZED ({" UNION ALL ".join(parts)}),
base AS MATERIALIZED (SELECT doc_id, row_no, kind, CAST(s.first AS BIGINT) AS first, CAST(s.first + length(s.match) AS BIGINT) AS past FROM found
  WHERE CASE kind WHEN 0 THEN length(regexp_extract(s.match, {lit(ASSIGN)}, 2)) >= {ASSIGN_LEAST}
        WHEN 1 THEN length(s.match) >= {ACCESS_LEAST} ELSE length(s.match) >= {HEX_LEAST} END),
cand AS MATERIALIZED ({" UNION ALL ".join(cands)}),
extra AS ({" UNION ALL ".join(tests)}),
spans AS (SELECT * FROM base UNION ALL
  SELECT doc_id, row_no, kind, CAST(first AS BIGINT), CAST(past AS BIGINT) FROM extra e
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row_no = e.row_no AND b.first <= e.first AND b.past >= e.past)),
b AS (SELECT row_no, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {text} AS t FROM base GROUP BY row_no),
a AS (SELECT row_no, {text} AS t FROM spans GROUP BY row_no)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b.t, '')) AS base_sha256, coalesce(a.t, '') AS spans
FROM d LEFT JOIN b USING (row_no) LEFT JOIN a USING (row_no)"""
