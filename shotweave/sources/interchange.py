"""Timeline interchange documents: a JSON form and an XML form, written line by line and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shotweave import schema as S
from shotweave.functions import expr as X
from shotweave.operators.ordered import chunk_of, keyed, ordered_scan, row_index
from shotweave.operators.timeline import TL, is_gap
from shotweave.session import few_listing_tasks, materialize
from shotweave.sources.documents import element_lines, elements, file_path, fixed_lines, number_lines, read_lines, read_texts, whole_files, write_lines


def sequence_rates(plan: DataFrame) -> DataFrame:
    """Sequence rate per timeline: its first exported source's rate."""
    return plan.where(~is_gap()).groupBy(TL).agg(F.min_by("fps", "item_ix").alias("seq_fps"))


def _title(title: Column | None) -> Column:
    return F.col(TL).cast("string") if title is None else title


# ---- JSON form ------------------------------------------------------------------------------

def _rational(value: Column) -> Column:
    return F.struct(F.lit("RationalTime.1").alias("OTIO_SCHEMA"), F.col("seq_fps").alias("rate"), value.cast("double").alias("value"))


def _range(start: Column, length: Column) -> Column:
    return F.struct(F.lit("TimeRange.1").alias("OTIO_SCHEMA"), _rational(length).alias("duration"), _rational(start).alias("start_time"))


def otio_parts(plan: DataFrame, sources: DataFrame, rates: DataFrame | None = None, title: Column | None = None,
               metadata_key: str = "shotweave") -> DataFrame:
    """Lines, not yet in order, of one JSON document per timeline of a plan; timelines with nothing to write have none."""
    rates = sequence_rates(plan) if rates is None else rates
    own = keyed("source_id", plan, sources)
    p = plan.join(rates, TL).join(sources.select(*own, "total_frames"), own, "left")
    empty = F.array().cast("array<string>")
    no_map = F.create_map().cast("map<string,string>")
    meta = F.struct(F.struct(F.col("source_id").cast("string").alias("source_id"), F.col("clip_id").cast("string").alias("clip_id"),
                             "color_index", "label").alias(metadata_key))
    ref = F.struct(F.lit("ExternalReference.1").alias("OTIO_SCHEMA"), no_map.alias("metadata"), X.stem("file_path").alias("name"),
                   _range(F.lit(0), F.col("total_frames")).alias("available_range"), F.lit(None).cast("string").alias("available_image_bounds"),
                   X.file_uri("file_path").alias("target_url"))
    clip = F.to_json(F.struct(
        F.lit("Clip.2").alias("OTIO_SCHEMA"), meta.alias("metadata"), X.stem("file_path").alias("name"),
        _range(X.otio_start("src_in"), F.col("frame_count")).alias("source_range"), empty.alias("effects"), empty.alias("markers"),
        F.lit(True).alias("enabled"), F.struct(ref.alias("DEFAULT_MEDIA")).alias("media_references"),
        F.lit("DEFAULT_MEDIA").alias("active_media_reference_key")), {"ignoreNullFields": "false"})
    gap = F.to_json(F.struct(
        F.lit("Gap.1").alias("OTIO_SCHEMA"), no_map.alias("metadata"), F.lit("").alias("name"),
        _range(F.lit(0), F.col("frame_count")).alias("source_range"), empty.alias("effects"), empty.alias("markers"), F.lit(True).alias("enabled")))
    kids = element_lines(p, 1, F.col("item_ix"), F.when(is_gap(), gap).otherwise(clip))
    t = p.select(TL).distinct()
    name = F.regexp_replace(F.to_json(F.struct(_title(title).alias("v"))), r'^\{"v":|\}$', "")
    head = F.concat(
        F.lit('{"OTIO_SCHEMA": "Timeline.1", "metadata": {}, "name": '), name,
        F.lit(', "global_start_time": null, "tracks": {"OTIO_SCHEMA": "Stack.1", "metadata": {}, "name": "tracks", "source_range": null, '
              '"effects": [], "markers": [], "enabled": true, "children": [{"OTIO_SCHEMA": "Track.1", "metadata": {}, "name": "Video", '
              '"source_range": null, "effects": [], "markers": [], "enabled": true, "kind": "Video", "children": ['))
    return kids.unionByName(fixed_lines(t, [(0, head), (2, F.lit("]}]}}"))]))


def otio_lines(plan: DataFrame, sources: DataFrame, **kw) -> DataFrame:
    """The lines of ``otio_parts`` in order."""
    return number_lines(materialize(otio_parts(plan, sources, **kw)))


def write_otio(plan: DataFrame, sources: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none", **kw) -> None:
    write_lines(lambda: otio_parts(plan, sources, **kw), path, mode, compression)


def read_otio(spark: SparkSession, path: str) -> DataFrame:
    """Children of each document's first track, in order: kind (clip, gap, other), start, duration, rate,
    available range. Documents with another schema name give one row of kind "other".

    Documents that ``write_otio`` made are read line by line, so one of any length never is a row; a file of another origin is one value and one row.
    """
    files = whole_files(spark, path)
    d = read_texts(spark, path, written=False, files=files).select("doc_id", F.from_json("text", S.OTIO_DOC).alias("d"))
    kids = F.get(F.col("d.tracks.children"), F.lit(0))["children"]
    good = F.coalesce(F.col("d.OTIO_SCHEMA") == "Timeline.1", F.lit(False))
    c = d.select("doc_id", good.alias("good"), F.posexplode_outer(F.when(good, kids)).alias("child_ix", "c"))
    c = c.where(~F.col("good") | F.col("c").isNotNull()).select("doc_id", "good", F.col("child_ix").cast("long").alias("child_ix"), "c")
    lines = materialize(read_lines(spark, path, lambda line: F.when(line.startswith('{"OTIO_SCHEMA": "Timeline.1"'), "children").when(line == "]}]}}", "end"), files))
    inside = elements(lines, S.OTIO_CHILD, "children").select("doc_id", (~F.col("bad")).alias("good"), "ix", F.col("e").alias("c"))
    # a document without its first line is none of this kind
    lost = lines.where(F.col("section").isNull()).select("doc_id").distinct().select("doc_id", F.lit(False), F.lit(None).cast("long"), F.lit(None).cast(c.schema["c"].dataType))
    c = c.union(inside).union(lost)
    kind = (F.when(~F.col("good"), "other").when(F.col("c.OTIO_SCHEMA").startswith("Clip"), "clip")
            .when(F.col("c.OTIO_SCHEMA").startswith("Gap"), "gap").otherwise("other"))
    ref = F.col("c.media_references.DEFAULT_MEDIA")
    return c.select(
        "doc_id", "child_ix", kind.alias("kind"), F.col("c.name").alias("name"),
        F.col("c.source_range.start_time.value").alias("start_value"), F.col("c.source_range.start_time.rate").alias("rate"),
        F.col("c.source_range.duration.value").alias("duration_value"), ref["target_url"].alias("target_url"),
        ref["available_range"]["start_time"]["value"].alias("avail_start"), ref["available_range"]["duration"]["value"].alias("avail_duration"))


# ---- XML form -------------------------------------------------------------------------------

def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _filled(text: str, *values: Column) -> Column:
    """``text`` with a value for each ``%s``, null as the word: ``format_string`` without its parsing of every row."""
    first, *rest = text.split("%s")
    pieces = [F.lit(first)]
    for value, after in zip(values, rest, strict=True):
        pieces += [F.coalesce(value.cast("string"), F.lit("null")), F.lit(after)]
    return F.concat(*pieces)


def fcpxml_parts(plan: DataFrame, sources: DataFrame, seq_frames: DataFrame, include_gaps: bool = False,
                 rates: DataFrame | None = None, title: Column | None = None) -> DataFrame:
    """Lines, not yet in order, of one XML document per timeline: format, assets in order of first use from r2, spine.

    ``seq_frames`` (timeline_id, seq_frames) is the sequence length; ``export_extent`` gives it.
    """
    rates = sequence_rates(plan) if rates is None else rates
    rate = X.frame_duration("seq_fps")
    base = plan.join(rates, TL).withColumn("__d", rate).withColumns({"rn": F.col("__d.num"), "rd": F.col("__d.den")}).drop("__d")
    base = materialize(base)
    first = base.where(~is_gap()).groupBy(TL, "source_id").agg(F.min("item_ix").alias("first_ix"), F.first("rn").alias("rn"), F.first("rd").alias("rd"), F.first("seq_fps").alias("seq_fps"))
    assets = ordered_scan(materialize(first), [TL], ["first_ix"], chunk_of("first_ix"), index="use_ix")
    own = keyed("source_id", plan, sources)
    # names are made once per source, not once per use
    named = sources.select(*own, xml_escape(X.stem("file_path")).alias("asset_name"), X.file_uri("file_path").alias("uri"), "total_frames", "width", "height", "audio_channels", "audio_sample_rate")
    assets = materialize(assets.join(named, own))
    rid = F.concat(F.lit("r"), F.col("use_ix") + 2)

    heads = assets.where("use_ix = 0").join(seq_frames, TL)
    q = _filled
    t = xml_escape(_title(title))
    # lines that always follow each other are one row, an array
    fixed = fixed_lines(heads, [
        (0, F.array(F.lit('<?xml version="1.0" encoding="UTF-8"?>'), F.lit("<!DOCTYPE fcpxml>"), F.lit('<fcpxml version="1.9">'), F.lit("  <resources>"), q(
            '    <format id="r1" name="FFVideoFormat%s" frameDuration="%s/%ss" width="%s" height="%s" colorSpace="1-1-1 (Rec. 709)"/>',
            X.fps_suffix("seq_fps"), F.col("rn"), F.col("rd"), F.col("width"), F.col("height")))),
        (6, F.array(F.lit("  </resources>"), F.lit("  <library>"), q('    <event name="%s">', t), q('      <project name="%s">', t), q(
            '        <sequence format="r1" duration="%s" tcStart="0s" tcFormat="NDF" audioLayout="stereo" audioRate="48k">', X.time_str("seq_frames", "rn", "rd")),
            F.lit("          <spine>"))),
        (13, F.array(*[F.lit(x) for x in ("          </spine>", "        </sequence>", "      </project>", "    </event>", "  </library>", "</fcpxml>")]))])
    loud = F.when(F.col("audio_channels") > 0, q(
        ' hasAudio="1" audioSources="1" audioChannels="%s" audioRate="%s"', F.col("audio_channels"),
        F.when(F.coalesce("audio_sample_rate", F.lit(0)) == 0, F.lit(48000)).otherwise(F.col("audio_sample_rate")))).otherwise(F.lit(""))
    a0 = q('    <asset id="%s" name="%s" start="0s" duration="%s" hasVideo="1" format="r1" videoSources="1"%s>', rid,
           F.col("asset_name"), X.time_str("total_frames", "rn", "rd"), loud)
    a1 = q('      <media-rep kind="original-media" src="%s"/>', F.col("uri"))
    parts = fixed.unionByName(element_lines(assets, 5, F.col("use_ix"), F.array(a0, a1, F.lit("    </asset>")), element=False))
    offset = F.col("offset_in_range") if include_gaps else F.col("offset_packed")
    spine = base.join(assets.select(TL, "source_id", "use_ix"), [TL, "source_id"], "left").join(heads.select(TL), TL, "left_semi")
    off, dur = X.time_str(offset, "rn", "rd"), X.time_str("frame_count", "rn", "rd")
    gap = q('            <gap name="Gap" offset="%s" start="0s" duration="%s"/>', off, dur)
    clip = q('            <asset-clip ref="%s" name="%s" offset="%s" start="%s" duration="%s" format="r1" tcFormat="NDF"/>', rid,
             xml_escape(X.stem("file_path")), off, X.src_seek_str("src_in", "rn", "rd"), dur)
    parts = parts.unionByName(element_lines(spine, 12, F.col("item_ix"), F.array(F.when(is_gap(), gap).otherwise(clip)), element=False))
    return parts


def fcpxml_lines(plan: DataFrame, sources: DataFrame, seq_frames: DataFrame, **kw) -> DataFrame:
    """The lines of ``fcpxml_parts`` in order."""
    return number_lines(materialize(fcpxml_parts(plan, sources, seq_frames, **kw)))


def write_fcpxml(plan: DataFrame, sources: DataFrame, seq_frames: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none", **kw) -> None:
    write_lines(lambda: fcpxml_parts(plan, sources, seq_frames, **kw), path, mode, compression)


def read_fcpxml(spark: SparkSession, path: str) -> DataFrame:
    """Spine clips of XML documents in spine order, with parsed rational start, duration and offset."""
    with few_listing_tasks(spark):
        raw = (spark.read.format("xml").option("rowTag", "asset-clip").option("recursiveFileLookup", "true")
               .schema("_ref string, _name string, _start string, _duration string, _offset string").load(path))
    written = F.regexp_extract(file_path(), rf"/{TL}=([^/]+)/", 1)
    name = F.regexp_extract(file_path(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    zero = F.lit("0s")
    rows = raw.select(
        F.when(written != "", F.url_decode(written)).otherwise(name).alias("doc_id"), F.col("_ref").alias("ref"), F.col("_name").alias("name"),
        F.coalesce("_start", zero).alias("start_text"), X.parse_fraction(F.coalesce("_start", zero)).alias("s"),
        X.parse_fraction(F.coalesce("_duration", zero)).alias("d"), X.parse_fraction(F.coalesce("_offset", zero)).alias("o"))
    rows = rows.select("doc_id", "ref", "name", "start_text", F.col("s.num").alias("start_num"), F.col("s.den").alias("start_den"),
                       F.col("d.num").alias("duration_num"), F.col("d.den").alias("duration_den"), F.col("o.num").alias("offset_num"), F.col("s.error").alias("error"))
    # offsets strictly increase along a spine, so they carry its order
    return row_index(materialize(rows), ["doc_id"], ["offset_num"], chunk_of(F.col("offset_num"), 1 << 32), "clip_ix")
