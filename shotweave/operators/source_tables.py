"""Operators on the table of media sources: descriptions, import checks, relinking, removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shotweave.functions import expr as X
from shotweave.operators.ordered import keyed
from shotweave.operators.timeline import TL, duration, is_gap

# ---- fixed values ---------------------------------------------------------------------
FPS_TOLERANCE = 0.02
FRAME_TOLERANCE = 0.01


def with_source_descriptors(sources: DataFrame) -> DataFrame:
    return sources.withColumns({
        "duration_seconds": X.duration_seconds("total_frames", "fps"),
        "has_audio": F.coalesce(F.col("audio_channels") > 0, F.lit(False)),
        "time_base_text": X.time_base_text("time_base_num", "time_base_den"),
        "audio_text": X.audio_text("audio_codec", "audio_channels", "audio_sample_rate"),
    })


def unsafe_sources(sources: DataFrame) -> DataFrame:
    return sources.where(~X.is_seek_safe("time_base_num", "time_base_den", "fps"))


def timebase_fix_plan(sources: DataFrame, files: DataFrame) -> DataFrame:
    """What to remux for each seek-unsafe source; an .mkv beside the file is preferred as the input.

    ``files`` is an inventory with a ``path`` column.
    """
    bad = unsafe_sources(sources).withColumn("__base", X.drop_extension("file_path"))
    bad = bad.withColumn("__sib", F.concat("__base", F.lit(".mkv")))
    known = files.select(F.col("path").alias("__sib"), F.lit(True).alias("__there")).distinct()
    out = bad.join(known, "__sib", "left")
    use = F.coalesce(F.col("__there"), F.lit(False)) & ~F.lower("file_path").endswith(".mkv")
    return out.select(
        "source_id", F.when(use, F.col("__sib")).otherwise(F.col("file_path")).alias("input_path"),
        F.concat("__base", F.lit("_fixed.mov")).alias("output_path"),
        X.frame_duration("fps")["den"].alias("target_ticks"), use.alias("used_sibling"),
        X.duration_seconds("total_frames", "fps").alias("seconds"))


def validate_batch(probes: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Mark every file of an import batch (batch_id, file_ix, width, height, fps).

    The reference shape is the batch's row in ``reference`` (ref_width, ref_height, ref_fps) or else
    the batch's first file. A single mismatch rejects the whole batch.
    """
    first = probes.groupBy("batch_id").agg(F.min_by(F.struct("width", "height", "fps"), "file_ix").alias("__f"))
    if reference is not None:
        first = first.join(reference, "batch_id", "left")
        given = F.coalesce(F.col("ref_width"), F.lit(0)) != 0
        pick = F.when(given, F.struct(F.col("ref_width").alias("width"), F.col("ref_height").alias("height"),
                                      F.col("ref_fps").alias("fps"))).otherwise(F.col("__f"))
    else:
        pick = F.col("__f")
    ref = first.select("batch_id", pick.alias("__r"))
    rows = probes.join(ref, "batch_id").withColumn(
        "conforms", (F.col("width") == F.col("__r.width")) & (F.col("height") == F.col("__r.height"))
        & (F.abs(F.col("fps") - F.col("__r.fps")) <= FPS_TOLERANCE)).drop("__r")
    verdict = rows.groupBy("batch_id").agg(F.bool_and("conforms").alias("accepted"))
    return rows.join(verdict, "batch_id")


def metadata_matches(o_width, o_height, o_fps, o_frames, c_width, c_height, c_fps, c_frames, strict: bool = True):
    o_frames, c_frames = X._long(o_frames), X._long(c_frames)
    tol = F.greatest(F.lit(1).cast("long"), (o_frames * F.lit(FRAME_TOLERANCE)).cast("long"))
    frames_ok = F.when(o_frames > 0, F.abs(c_frames - o_frames) <= tol).otherwise(
        (c_frames > 0) if strict else F.lit(True))
    return ((X._c(c_width) == X._c(o_width)) & (X._c(c_height) == X._c(o_height))
            & (F.abs(X._c(c_fps) - X._c(o_fps)) <= FPS_TOLERANCE) & frames_ok)


def _length_bin(n):
    """Bins of one frame up to 200 frames and of about 2% beyond: a ±1% window meets only a few."""
    return F.when(n < 200, F.floor(n)).otherwise(200 + F.floor(F.log(F.greatest(n, F.lit(200)) / 200.0) / 0.02)).cast("long")


def relink(missing: DataFrame, candidates: DataFrame, strict: bool = True) -> DataFrame:
    """One replacement file per missing source: same lowercase file name, conforming metadata.

    Popular names give huge groups on both sides. A match depends only on name and shape, so both sides
    are first reduced to distinct shapes, and the two tolerances (rate, length) become bins of an
    equi-join instead of a scan of everything with that name. The winner is the least path.
    """
    name = X.basename_ci("file_path")
    shape = ["__n", "width", "height", "fps", "total_frames"]
    cand = candidates.withColumn("__n", name).groupBy(*shape).agg(F.min("file_path").alias("new_path"))
    cand = cand.select("__n", "width", "height", F.col("fps").alias("c_fps"), F.col("total_frames").alias("c_frames"), "new_path")
    m = missing.withColumn("__n", name).where(F.col("__n") != "")
    shapes = m.groupBy(*shape).agg(F.count(F.lit(1)).alias("__k")).drop("__k")

    fps_bin = lambda c: F.floor(F.col(c) / FPS_TOLERANCE).cast("long")
    near_rates = F.explode(F.sequence(fps_bin("fps") - 1, fps_bin("fps") + 1)).alias("__fb")
    rule = metadata_matches("width", "height", "fps", "total_frames", "width", "height", "c_fps", "c_frames", strict)
    equi = ["__n", "width", "height", "__fb"]

    tol = F.greatest(F.lit(1).cast("long"), (F.col("total_frames") * F.lit(FRAME_TOLERANCE)).cast("long"))
    sized = (shapes.where("total_frames > 0").select("*", near_rates)
             .withColumn("__lb", F.explode(F.sequence(_length_bin(F.col("total_frames") - tol), _length_bin(F.col("total_frames") + tol)))))
    c_sized = cand.withColumns({"__fb": fps_bin("c_fps"), "__lb": _length_bin(F.col("c_frames"))})
    hit = sized.join(c_sized, [*equi, "__lb"]).where(rule).select(*shape, "new_path")

    # unknown original length: the candidate's length hardly matters, so it is aggregated away first
    unsized = shapes.where("total_frames is null or total_frames <= 0").select("*", near_rates)
    c_any = (cand.where(F.col("c_frames") > 0) if strict else cand).groupBy("__n", "width", "height", "c_fps").agg(
        F.min("new_path").alias("new_path")).withColumn("__fb", fps_bin("c_fps"))
    hit2 = unsized.join(c_any, equi).where(F.abs(F.col("c_fps") - F.col("fps")) <= FPS_TOLERANCE).select(*shape, "new_path")

    best = hit.unionByName(hit2).groupBy(*shape).agg(F.min("new_path").alias("new_path"))
    return m.join(best, shape).select("source_id", "file_path", "new_path")


def apply_relink(sources: DataFrame, items: DataFrame, resolved: DataFrame, skip_negative: bool = False):
    """Take over the path and metadata of relinked files and pull in items past a shorter end.

    ``resolved``: source_id plus the full set of new source columns. Returns (sources, items with a
    ``touched`` flag). ``skip_negative`` leaves items alone when the new file has no frames.
    """
    meta = [c for c in resolved.columns if c != "source_id" and c in sources.columns]
    source = keyed("source_id", sources, resolved)
    new = resolved.select(*source, *[F.col(c).alias(f"__new_{c}") for c in meta if c not in source], F.lit(True).alias("__hit"))
    meta = [c for c in meta if c not in source]
    joined = sources.join(new, source, "left")
    out_sources = joined.select(*[
        F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in meta else F.col(c)
        for c in sources.columns])
    shrunk = joined.where(F.col("__hit") & (F.col("__new_total_frames") < F.col("total_frames")))
    used = keyed("source_id", sources, items)
    limits = shrunk.select(*used, (F.col("__new_total_frames") - 1).alias("__max"))
    rows = items.join(limits, used, "left")
    usable = F.col("__max").isNotNull() & ((F.col("__max") >= 0) if skip_negative else F.lit(True))
    over_in = usable & (F.col("source_in") > F.col("__max"))
    over_out = usable & (F.col("source_out") > F.col("__max"))
    rows = rows.withColumns({
        "touched": F.coalesce(over_in | over_out, F.lit(False)),
        "source_in": F.when(over_in, F.col("__max")).otherwise(F.col("source_in")),
        "source_out": F.when(over_out, F.col("__max")).otherwise(F.col("source_out"))})
    return out_sources, rows.select(*items.columns, "touched")


def revive_orphans(imports: DataFrame, orphans: DataFrame, live: DataFrame) -> DataFrame:
    """Imported files take the id an earlier removal left behind for their path, unless it is live.

    An id is given once: of several imports of a path the one with the least own id takes it. ``remaining_orphans`` gives what is left.
    """
    path = keyed("file_path", imports, orphans)
    alive = keyed("source_id", orphans, live)
    free = orphans.join(live.select(*alive).distinct(), alive, "left_anti").select(*path, F.col("source_id").alias("__old"))
    first = imports.where("file_path is not null").groupBy(*path).agg(F.min("source_id").alias("source_id"))
    given = free.join(first, path)
    return imports.join(given, [*path, "source_id"], "left").withColumn(
        "revived", F.col("__old").isNotNull()).withColumn(
        "source_id", F.coalesce("__old", "source_id")).drop("__old")


def remaining_orphans(orphans: DataFrame, revived: DataFrame) -> DataFrame:
    """Orphan entries whose id no import has taken."""
    own = [*keyed("file_path", orphans, revived), "source_id"]
    return orphans.join(revived.where("revived").select(*own), own, "left_anti").select(*orphans.columns)


def remove_sources(sources: DataFrame, items: DataFrame, orphans: DataFrame, removed: DataFrame, keep_clips: bool):
    """Drop sources; their items become gaps, or stay while path → id goes to the orphan table."""
    from shotweave.operators.edits import remove_source

    own = keyed("source_id", sources, removed)
    left = sources.join(removed.select(*own), own, "left_anti").select(*sources.columns)
    if not keep_clips:
        return left, remove_source(items, removed), orphans
    path = keyed("file_path", sources, orphans)
    gone = (sources.join(removed.select(*own), own, "left_semi")
            .where(F.coalesce("file_path", F.lit("")) != "").select(*path, "source_id"))
    kept = orphans.join(gone.select(*path), path, "left_anti").select(*path, "source_id")
    return left, items, kept.unionByName(gone)
