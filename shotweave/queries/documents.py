"""Probe parsing, document lines and nested forms over the driver's tables."""

from pyspark.sql import functions as F

from shotweave import fixtures as fx
from shotweave.fixtures import CROPS_SQL, ITEMS_SQL, SEGMENTS_SQL, SOURCES_SQL, with_sql
from shotweave.operators import keyframes as kf
from shotweave.plans import export as ex
from shotweave.queries import query
from shotweave.queries.layout import BASE_PLAN, _DEN_SQL, _DUR_SQL
from shotweave.sources import interchange as ic, probe as pr, projects as pj

PROBE_SQL = """WITH x AS (SELECT p_partkey AS id, p_size AS z, p_partkey % 4 AS k FROM part),
r AS (SELECT *, CASE WHEN k = 0 THEN 24000.0::DOUBLE / 1001 WHEN k = 1 THEN 25.0 WHEN k = 2 THEN 24.0 ELSE 24.0 END::DOUBLE AS fps FROM x)
SELECT id, k < 3 OR z % 5 > 0 AS probed, """


def probes(spark, d):
    return fx.table(spark, d, "part").selectExpr("p_partkey as id", """concat('{"streams": [{"codec_type": "audio", "codec_name": "aac", "sample_rate": "48000", "channels": 2}',
      case when p_partkey % 4 < 3 or p_size % 5 > 0 then concat(', {"codec_type": "video", "codec_name": "h264", "width": ', 100 + p_size, ', "height": 720, "time_base": "', case when p_size % 3 = 0 then 'x/y' else '1/90000' end,
       '", "r_frame_rate": "', case p_partkey % 4 when 0 then '24000/1001' when 1 then '25/1' when 2 then '0/0' else 'bad' end, '"',
       case when p_size % 2 = 0 then concat(', "nb_frames": "', p_partkey, '"') else ', "nb_frames": "N/A"' end,
       case when p_size % 4 = 1 then ', "duration": "12.5"' else '' end,
       case when p_size % 7 = 0 then ', "color_transfer": "smpte2084", "color_primaries": "bt2020"' else '' end, '}') else '' end,
      '], "format": {"duration": "', p_size, '.25"}}') as probe""")


@query("a3_parse_probe", PROBE_SQL + """CASE WHEN probed THEN (100 + z)::INTEGER END AS width, CASE WHEN probed THEN round(fps, 6) END AS fps, CASE WHEN probed THEN
  CASE WHEN z % 2 = 0 AND id <> 0 THEN id ELSE trunc(CASE WHEN z % 4 = 1 THEN 12.5 ELSE z + 0.25 END * fps)::BIGINT END END AS total_frames,
 CASE WHEN probed THEN CASE WHEN z % 3 = 0 THEN 0 ELSE 90000 END::BIGINT END AS time_base_den, CASE WHEN probed THEN 2 END::INTEGER AS audio_channels FROM r""")
def a3(spark, d):
    return pr.parse_probe(probes(spark, d)).select("id", "probed", "width", F.round("fps", 6).alias("fps"), "total_frames", "time_base_den", "audio_channels")


@query("a4_classify_hdr", PROBE_SQL + "(k < 3 OR z % 5 > 0) AND z % 7 = 0 AS hdr FROM r")
def a4(spark, d):
    return pr.parse_probe(probes(spark, d)).select("id", "probed", "hdr")


@query("a10_fcpxml_spine", BASE_PLAN + """, sr AS (SELECT timeline_id, arg_min(fps, item_ix) AS sfps FROM plan GROUP BY timeline_id),
u AS (SELECT timeline_id, source_id, row_number() OVER (PARTITION BY timeline_id ORDER BY min(item_ix)) + 1 AS rid FROM plan GROUP BY timeline_id, source_id),
r AS (SELECT p.*, rid, """ + _DUR_SQL.replace("fps", "sfps") + " AS rn, " + _DEN_SQL.replace("fps", "sfps") + """ AS rd FROM plan p JOIN sr USING (timeline_id) JOIN u USING (timeline_id, source_id))
SELECT timeline_id, '            <asset-clip ref="r' || rid || '" name="' || source_id || '" offset="' || CASE WHEN offset_packed = 0 THEN '0s' ELSE (offset_packed * rn) || '/' || rd || 's' END ||
 '" start="' || CASE WHEN src_in <= 0 THEN '0s' ELSE (src_in * rn + rn // 2) || '/' || rd || 's' END || '" duration="' || (frame_count * rn) || '/' || rd || 's" format="r1" tcFormat="NDF"/>' AS line FROM r""")
def a10(spark, d):
    it, s, t = fx.items(spark, d), fx.sources(spark, d), fx.timelines(spark, d)
    plan = ex.export_plan(it, s, t)
    seq = ex.export_extent(it, t).selectExpr("timeline_id", "n_frames as seq_frames")
    return ic.fcpxml_lines(plan, s, seq).where("line like '%<asset-clip %'").select("timeline_id", "line")


@query("a8_otio_children", BASE_PLAN + """SELECT timeline_id, item_ix - min(item_ix) OVER (PARTITION BY timeline_id) * 0 AS item_ix, 'Clip.2' AS kind, source_id::VARCHAR AS name, src_in + 0.25::DOUBLE AS start_value, frame_count::DOUBLE AS duration_value,
 round(arg_min(fps, item_ix) OVER (PARTITION BY timeline_id), 6) AS rate FROM plan""")
def a8(spark, d):
    it, s, t = fx.items(spark, d), fx.sources(spark, d), fx.timelines(spark, d)
    lines = ic.otio_lines(ex.export_plan(it, s, t), s)
    # parse the element lines back; the clip id in the metadata ends in the item's number
    from shotweave import schema as S
    doc = F.regexp_replace("line", "^,", "")
    kid = F.from_json(doc, S.OTIO_CHILD)
    # each line is parsed once: fields taken from the call itself would each parse it for themselves
    rows = lines.where("line like '%\"Clip.2\"%'").select("timeline_id", F.regexp_extract("line", r'"clip_id":"\d+-(\d+)"', 1).cast("long").alias("item_ix"), kid.alias("kid"))
    kid = F.col("kid")
    return rows.select(
        "timeline_id", "item_ix", kid["OTIO_SCHEMA"].alias("kind"), kid["name"].alias("name"),
        kid["source_range"]["start_time"]["value"].alias("start_value"), kid["source_range"]["duration"]["value"].alias("duration_value"),
        F.round(kid["source_range"]["duration"]["rate"], 6).alias("rate"))


@query("j6_nest_and_flatten", with_sql(ITEMS_SQL, CROPS_SQL, SEGMENTS_SQL) + """SELECT crop_id, segment_ix, segment_id, anchor_frame, s.active, c.x, c.aspect_ratio, coalesce(c.group_id::VARCHAR, '-') AS tag
 FROM segments s JOIN crops c USING (crop_id)""")
def j6(spark, d):
    c = fx.crops(spark, d).withColumn("group_id", F.col("group_id").cast("string"))
    keys = c.selectExpr("crop_id", "'x' as axis", "source_in as source_frame", "cast(x as double) as value", "'step' as interp", "0D as in_dx", "0D as in_dy", "0D as out_dx", "0D as out_dy")
    nested = kf.nest_crops(c, fx.segments(c), keys)
    per_clip = nested.groupBy("timeline_id", "clip_id").agg(F.collect_list("crop").alias("crop_regions"))
    flat = kf.flatten_crops(per_clip)
    return flat["segments"].join(flat["crops"].drop("active"), "crop_id").select(
        "crop_id", "segment_ix", "segment_id", "anchor_frame", "active", "x", "aspect_ratio", F.coalesce("group_id", F.lit("-")).alias("tag"))


@query("a2_project_clip_lines", with_sql(ITEMS_SQL, CROPS_SQL) + """SELECT timeline_id, clip_id, source_in, source_out, coalesce(n, 0) AS n_crops FROM items i
 LEFT JOIN (SELECT clip_id AS cid, count(*) AS n FROM crops GROUP BY clip_id) ON cid = clip_id WHERE timeline_id IN (SELECT o_orderkey FROM orders)""")
def a2(spark, d):
    it = fx.items(spark, d)
    c = fx.crops(spark, d, it)
    t = fx.timelines(spark, d)
    src = it.where("source_id is not null").select("timeline_id", "source_id").distinct().join(fx.sources(spark, d), "source_id").withColumn("source_ix", F.col("source_id"))
    none = fx.keyframes(spark, d).where("crop_id is null").withColumn("crop_id", F.col("crop_id").cast("string"))
    tables = {"timelines": t, "sources": src, "items": it.join(t.select("timeline_id"), "timeline_id", "left_semi"), "crops": c, "segments": fx.segments(c), "keyframes": none,
              "groups": src.selectExpr("timeline_id", "cast(null as string) as group_id", "'' as name", "'' as color", "0 as digit", "0L as group_ix").where("false"),
              "orphans": src.selectExpr("timeline_id", "file_path", "cast(source_id as string) as source_id").where("source_ix < 0")}
    lines = pj.project_lines(tables)
    from shotweave import schema as S
    clip = F.from_json(F.regexp_replace("line", "^,", ""), S.CLIP_DOC)
    # each line is parsed once, see above
    rows = lines.where("line like '%\"crop_regions\"%'").select("timeline_id", clip.alias("clip"))
    return rows.select("timeline_id", "clip.id", "clip.source_in", "clip.source_out", F.size("clip.crop_regions").cast("long").alias("n_crops")).withColumnRenamed("id", "clip_id")
