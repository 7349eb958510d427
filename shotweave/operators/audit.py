"""Would readers of an exported timeline land on the intended frames? And are the tables sound?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shotweave.functions import expr as X
from shotweave.operators.joins import bracket_pts
from shotweave.operators.ordered import keyed
from shotweave.operators.timeline import TL, duration, is_gap

# ---- fixed values ------------------------------------------------------------------------
READER_RATE = 23.976023976023979


def _floor(c: Column) -> Column:
    return F.floor(c).cast("long")


def _trunc(c: Column) -> Column:
    return c.cast("long")


def _flag(rules: dict[str, Column], intended: Column) -> Column:
    """Comma-joined names of the rules that predict another frame; null predictions do not apply."""
    return F.concat_ws(",", *[F.when(p != intended, F.lit(n)) for n, p in rules.items()])


def audit_rational(rows: DataFrame) -> DataFrame:
    """Reading rules for rational start times (intended_frame, num, den, source_fps, rate_num, rate_den)."""
    fps, ntsc = F.col("source_fps"), X.is_ntsc("source_fps")
    zero = F.col("num") == 0
    t = F.col("num") / F.col("den")
    t24 = F.rint(t * 24) / 24.0
    decl = F.col("rate_den") / F.col("rate_num")

    def at(c, only_ntsc=False):
        v = F.when(zero, F.lit(0).cast("long")).otherwise(c)
        return F.when(ntsc & ~zero, v) if only_ntsc else v

    rules = {
        "floor": at(_floor(t * fps)), "round": at(X.rounded(t * fps)), "trunc": at(_trunc(t * fps)),
        "tick_floor": at(_floor(t24 * fps), True), "tick_round": at(X.rounded(t24 * fps), True), "declared_floor": at(_floor(t * decl), True)}
    return rows.withColumns({f"p_{n}": p for n, p in rules.items()}).withColumn(
        "disagreeing", _flag({n: F.col(f"p_{n}") for n in rules}, F.col("intended_frame")))


def audit_fractional(rows: DataFrame) -> DataFrame:
    """Reading rules for fractional start values (intended_frame, value, rate, source_fps)."""
    fps, ntsc = F.col("source_fps"), X.is_ntsc("source_fps")
    t = F.col("value") / F.col("rate")
    r = F.lit(READER_RATE)
    rules = {
        "floor": _floor(t * fps), "round": X.rounded(t * fps), "trunc": _trunc(t * fps),
        "reader_floor": F.when(ntsc, _floor(t * r)), "reader_round": F.when(ntsc, X.rounded(t * r)), "reader_trunc": F.when(ntsc, _trunc(t * r))}
    return rows.withColumns({f"p_{n}": p for n, p in rules.items()}).withColumn(
        "disagreeing", _flag({n: F.col(f"p_{n}") for n in rules}, F.col("intended_frame")))


def audit_roundtrip(rows: DataFrame) -> DataFrame:
    """Undo the writers' nudges: recovered frames of both forms and whether they equal the intended one."""
    rational = F.when(F.col("num") == 0, F.lit(0).cast("long")).otherwise(
        X.div(F.col("num") - X.div("rate_num", 2), "rate_num"))
    fractional = X.rounded(F.col("value") - 0.25)
    return rows.withColumns({"recovered_rational": rational, "recovered_fractional": fractional}).withColumn(
        "intact", (F.col("recovered_rational") == F.col("intended_frame")) & (F.col("recovered_fractional") == F.col("intended_frame")))


def audit_pts(rows: DataFrame, packets: DataFrame, width: float = 64.0) -> DataFrame:
    """Distance between the packet a seek brackets and the intended frame (source_id, seek, start_time,
    intended_frame); sources without packets are neutral."""
    out = bracket_pts(rows, packets, width=width)
    delta = F.when(F.col("pts_k") >= 0, F.col("pts_k") - F.col("intended_frame")).otherwise(F.lit(0))
    return out.withColumn("pts_delta", delta.cast("long")).withColumn("pts_off", F.col("pts_delta") != 0)


def audit_interchange(children: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Invariants of parsed interchange documents, counted per document.

    ``children`` (from ``read_otio``): doc_id, kind, schema names, start_value, duration_value, avail_start,
    avail_duration, source_id. ``sources`` adds the available-range check against total_frames; if it has timelines, a
    document meets those of the timeline that its doc_id names.
    """
    c = children
    if sources is not None:
        own = {"__s": F.col("source_id"), **({"__d": F.col(TL).cast("string")} if TL in sources.columns else {})}
        lengths = sources.select(*(v.alias(k) for k, v in own.items()), F.col("total_frames").alias("__n"))
        same = F.col("source_id") == F.col("__s")
        c = c.join(lengths, same & (F.col("doc_id").cast("string") == F.col("__d")) if "__d" in own else same, "left")
    else:
        c = c.withColumn("__n", F.lit(None).cast("long"))
    gap, clip = F.col("kind") == "gap", F.col("kind") == "clip"
    whole = F.col("duration_value") == F.floor("duration_value")
    return c.groupBy("doc_id").agg(
        F.count_if(clip).alias("n_clips"), F.count_if(gap).alias("n_gaps"),
        F.count_if(F.col("kind") == "other").alias("bad_schema"),
        F.count_if(gap & ((F.col("start_value") != 0) | ~whole)).alias("bad_gaps"),
        F.count_if(clip & (F.col("avail_start") != 0)).alias("bad_avail_start"),
        F.count_if(clip & F.col("__n").isNotNull() & (F.col("avail_duration") != F.col("__n"))).alias("bad_avail_duration"))


def audit_timelines(items: DataFrame, sources: DataFrame | None = None, groups: DataFrame | None = None,
                    keyframes: DataFrame | None = None) -> DataFrame:
    """Violations per rule and key (rule, key, n): repeated clip ids, negative lengths, repeated positions,
    references to unknown sources or tags, repeated keys. No rows means sound tables."""
    def report(rule, df, key):
        return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.col("n").cast("long").alias("n"))

    parts = []
    for rule, cols in (("clip_id_repeats", [TL, "clip_id"]), ("position_repeats", [TL, "item_ix"])):
        dup = items.groupBy(*cols).agg(F.count(F.lit(1)).alias("c")).where("c > 1").groupBy(TL).agg(F.count(F.lit(1)).alias("n"))
        parts.append(report(rule, dup, TL))
    parts.append(report("length_not_positive", items.where(duration() <= 0).groupBy(TL).agg(F.count(F.lit(1)).alias("n")), TL))
    if sources is not None:
        own = keyed("source_id", items, sources)
        lost = items.where(~is_gap()).join(sources.select(*own), own, "left_anti")
        parts.append(report("unknown_source", lost.groupBy(TL).agg(F.count(F.lit(1)).alias("n")), TL))
    if groups is not None:
        keys = [c for c in (TL, "group_id") if c in groups.columns]
        tags = items.select(TL, F.explode("group_ids").alias("group_id"))
        parts.append(report("unknown_tag", tags.join(groups.select(*keys), keys, "left_anti").groupBy(TL).agg(F.count(F.lit(1)).alias("n")), TL))
    if keyframes is not None:
        crop = keyed("crop_id", keyframes)
        dup = keyframes.groupBy(*crop, "axis", "source_frame").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        parts.append(report("key_repeats", dup.groupBy(*crop).agg(F.count(F.lit(1)).alias("n")), "crop_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
