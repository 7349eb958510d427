"""Places of pattern matches in texts, as column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches of a text whose offsets are summed together.
BLOCK = 128

PLACE = "array<struct<first: int, past: int, match: string, before: string, after: string>>"


def with_places(df: DataFrame, text: str, patterns: dict[str, str], groups: dict[str, str] | None = None) -> DataFrame:
    """Adds a column per pattern: its leftmost, non-overlapping matches in order, with their code point offsets (end exclusive)
    and the text between a match and its neighbours. Patterns must not match the empty string.

    The text is cut at the matches only where there are any; offsets are running sums of the lengths of cuts and matches.
    """
    kept = df.columns
    df = df.select(*kept, *(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_m_{k}") for k, p in patterns.items()))
    df = df.select(*kept, *(f"_m_{k}" for k in patterns), *(
        F.when(F.size(f"_m_{k}") > 0, F.split(text, p, -1)).alias(f"_p_{k}") for k, p in patterns.items()))
    # a column of its own, as it is looked at several times below
    df = df.select(*kept, *(_between(F.col(f"_m_{k}"), F.col(f"_p_{k}")).alias(f"_r_{k}") for k in patterns))
    return df.select(*kept, *(_places(F.col(f"_r_{k}")).alias(k) for k in patterns))


def _between(m: Column, pieces: Column) -> Column:
    n = F.size(m)
    ends = F.zip_with(F.slice(pieces, 1, n), F.slice(pieces, 2, n), lambda a, b: F.struct(a.alias("before"), b.alias("after")))
    return F.when(n > 0, F.zip_with(m, ends, lambda x, e: F.struct(x.alias("match"), e["before"].alias("before"), e["after"].alias("after"))))


def _places(rows: Column) -> Column:
    """Offsets as running sums: in blocks of matches, then of blocks, so that the arrays copied stay short however many matches there are."""
    n = F.coalesce(F.size(rows), F.lit(0))
    none = F.array().cast(PLACE)

    def step(acc, r):
        first = acc["at"] + F.length(r["before"])
        past = first + F.length(r["match"])
        place = F.struct(first.alias("first"), past.alias("past"), r["match"].alias("match"), r["before"].alias("before"), r["after"].alias("after"))
        return F.struct(past.alias("at"), F.concat(acc["out"], F.array(place)).alias("out"))

    def placed(block, at):
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: F.slice(rows, k * BLOCK + 1, F.lit(BLOCK)))
    sized = F.transform(blocks, lambda b: F.struct(b.alias("block"), F.aggregate(b, F.lit(0), lambda acc, r: acc + F.length(r["before"]) + F.length(r["match"])).alias("size")))
    starts = F.aggregate(sized, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, b: F.struct(
        (acc["at"] + b["size"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    many = F.flatten(F.zip_with(sized, starts, lambda b, at: placed(b["block"], at)))
    return F.when(n > BLOCK, many).when(n > 0, placed(rows, F.lit(0))).otherwise(none)


def with_drawers(df: DataFrame, spans: str) -> DataFrame:
    """Adds ``drawers``: the spans dealt by position to about as many arrays as the square root of their number. A span is in every one it touches.

    A test against one drawer looks at few spans, see ``inside``, ``overlapping`` and ``equal``.
    """
    number = F.ceil(F.sqrt(F.greatest(F.size(spans), F.lit(1)))).cast("int")
    reach = F.aggregate(spans, F.lit(1), lambda acc, s: F.greatest(acc, s["past"]))
    df = df.select("*", number.alias("_number"), F.ceil(reach / number).cast("int").alias("_width"))
    dealt = F.transform(F.sequence(F.lit(0), F.col("_number") - 1), lambda k: F.filter(
        spans, lambda s: (s["first"] < (k + 1) * F.col("_width")) & (s["past"] > k * F.col("_width"))))
    return df.select("*", F.struct(F.col("_width").alias("width"), dealt.alias("dealt")).alias("drawers")).drop("_number", "_width")


def _any(span: Column, index: Column, test) -> Column:
    """Whether the test holds for a span in one of the drawers that ``span`` touches."""
    last = F.size(index["dealt"]) - 1
    first = F.least(F.floor(span["first"] / index["width"]).cast("int"), last)
    past = F.least(F.floor((F.greatest(span["past"], span["first"] + 1) - 1) / index["width"]).cast("int"), last)
    look = lambda k: F.exists(F.element_at(index["dealt"], k + 1), test)
    return F.when(first == past, look(first)).otherwise(F.exists(F.sequence(first, past), look))


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the spans (structs with ``kind``, an index, ``first`` and ``past``) in the given order, comma-joined."""
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["first"].cast("string"), s["past"].cast("string"))), ",")


def inside(span: Column, index: Column) -> Column:
    """Whether a span of the drawers covers this one."""
    return _any(span, index, lambda o: (o["first"] <= span["first"]) & (o["past"] >= span["past"]))


def overlapping(span: Column, index: Column) -> Column:
    """Whether a span of the drawers shares a character with this one."""
    return _any(span, index, lambda o: (o["first"] < span["past"]) & (o["past"] > span["first"]))


def equal(span: Column, index: Column) -> Column:
    """Whether the drawers hold a span of the same kind and ends."""
    return _any(span, index, lambda o: (o["kind"] == span["kind"]) & (o["first"] == span["first"]) & (o["past"] == span["past"]))
