"""Scalar functions over the driver's tables."""

from pyspark.sql import functions as F

from shotweave import fixtures as fx
from shotweave.fixtures import CROPS_SQL, ITEMS_SQL, SOURCES_SQL, TIMELINES_SQL, with_sql
from shotweave.functions import expr as X
from shotweave.queries import query
from shotweave.queries.layout import AUDIO_SQL, _DEN_SQL, _DUR_SQL

SRC = with_sql(SOURCES_SQL)
SRC_RATE = SRC + f", rated AS (SELECT *, {_DUR_SQL} AS rate_num, {_DEN_SQL} AS rate_den FROM sources)\n"
# a rate column with odd and non-positive values besides the standard ones
ODD_FPS = "CASE WHEN p_size % 11 = 0 THEN -1.0::DOUBLE WHEN p_size % 11 = 1 THEN p_size / 3.0::DOUBLE WHEN p_size % 11 = 2 THEN 23.98::DOUBLE WHEN p_size % 11 = 3 THEN p_size + 0.0004::DOUBLE ELSE p_size::DOUBLE END"
REQ_SQL = "CASE WHEN fps <= 0 THEN 81 ELSE ceil(81 * fps / 16) END::BIGINT"
ITEM_SRC_SQL = with_sql(ITEMS_SQL, SOURCES_SQL) + f", x AS (SELECT i.*, s.fps, {REQ_SQL} AS req FROM items i JOIN sources s USING (source_id))\n"


def odd_fps(spark, d):
    return fx.table(spark, d, "part").selectExpr(
        "p_partkey", "case when p_size % 11 = 0 then -1.0D when p_size % 11 = 1 then p_size / 3.0D when p_size % 11 = 2 then 23.98D "
        "when p_size % 11 = 3 then p_size + 0.0004D else cast(p_size as double) end as fps")


def items_sources(spark, d):
    return fx.items(spark, d).join(fx.sources(spark, d), "source_id")


@query("b2_frame_duration", f"""WITH o AS (SELECT p_partkey, {ODD_FPS} AS fps FROM part)
SELECT p_partkey, CASE WHEN fps <= 0 THEN 100 ELSE {_DUR_SQL} END::BIGINT AS num,
 CASE WHEN fps <= 0 THEN 2400 ELSE {_DEN_SQL} END::BIGINT AS den FROM o""")
def b2(spark, d):
    return odd_fps(spark, d).select("p_partkey", X.frame_duration("fps").alias("r")).select("p_partkey", "r.num", "r.den")


@query("b3_is_seek_safe", SRC_RATE + """SELECT source_id, CASE WHEN time_base_num <= 0 OR time_base_den <= 0 THEN true
 ELSE (rate_num * time_base_den) % (rate_den * time_base_num) = 0 END AS safe FROM rated""")
def b3(spark, d):
    return fx.sources(spark, d).select("source_id", X.is_seek_safe("time_base_num", "time_base_den", "fps").alias("safe"))


@query("b4_source_descriptors", SRC + f"""SELECT source_id, round(total_frames / fps, 6) AS seconds, audio_channels > 0 AS has_audio,
 CASE WHEN time_base_num <= 0 OR time_base_den <= 0 THEN '' ELSE time_base_num || '/' || time_base_den END AS time_base,
 {AUDIO_SQL} AS audio FROM sources""")
def b4(spark, d):
    from shotweave.operators.source_tables import with_source_descriptors
    return with_source_descriptors(fx.sources(spark, d)).select(
        "source_id", F.round("duration_seconds", 6).alias("seconds"), "has_audio", F.col("time_base_text").alias("time_base"),
        F.col("audio_text").alias("audio"))


@query("b5_seek_ts", ITEM_SRC_SQL + """SELECT timeline_id, item_ix, round(CASE WHEN source_in <= 0 OR fps <= 0 THEN 0 ELSE (source_in - 0.5::DOUBLE) / fps END, 9) AS ts FROM x""")
def b5(spark, d):
    return items_sources(spark, d).select("timeline_id", "item_ix", F.round(X.seek_ts("source_in", "fps"), 9).alias("ts"))


EXACT_SQL = """CASE WHEN {n} <= 0 OR fps <= 0 THEN 0
 WHEN abs(fps - 24000.0::DOUBLE/1001) < 0.001 THEN {n} * 48000 * 1001 // 24000
 WHEN abs(fps - 30000.0::DOUBLE/1001) < 0.001 THEN {n} * 48000 * 1001 // 30000
 WHEN abs(fps - 60000.0::DOUBLE/1001) < 0.001 THEN {n} * 48000 * 1001 // 60000
 ELSE round_even({n} * 48000 / fps, 0) END::BIGINT"""


@query("b7_exact_samples", ITEM_SRC_SQL + f"SELECT timeline_id, item_ix, {EXACT_SQL.format(n='dur')} AS samples FROM x")
def b7(spark, d):
    return items_sources(spark, d).select("timeline_id", "item_ix", X.exact_samples("dur", "fps").alias("samples"))


@query("b8_window_samples", SRC + "SELECT source_id, (81 * audio_sample_rate // 16)::BIGINT AS samples FROM sources")
def b8(spark, d):
    return fx.sources(spark, d).select("source_id", X.window_samples(F.col("audio_sample_rate")).alias("samples"))


@query("b9_required_frames", f"WITH o AS (SELECT p_partkey, {ODD_FPS} AS fps FROM part) SELECT p_partkey, {REQ_SQL} AS frames FROM o")
def b9(spark, d):
    return odd_fps(spark, d).select("p_partkey", X.required_frames("fps").alias("frames"))


@query("b10_host_and_clamp", ITEM_SRC_SQL + """, y AS (SELECT *, source_out + 4 * dur AS so, source_in - 20 + l_suppkey * 3 AS anchor FROM x)
SELECT timeline_id, item_ix, so - source_in + 1 >= req AS hosts,
 CASE WHEN so - req + 1 < source_in THEN anchor ELSE least(greatest(anchor, source_in), so - req + 1) END AS anchor FROM y""")
def b10(spark, d):
    y = items_sources(spark, d).selectExpr("*", "source_out + 4 * dur as so", "source_in - 20 + l_suppkey * 3 as a0")
    return y.select("timeline_id", "item_ix", X.can_host("source_id", "source_in", "so", "fps").alias("hosts"),
                    X.clamp_anchor("a0", "source_id", "source_in", "so", "fps").alias("anchor"))


ASPECT_NUM = "CASE aspect_ratio WHEN '1:1' THEN 1 WHEN '4:3' THEN 4 WHEN '16:9' THEN 16 WHEN '9:16' THEN 9 WHEN '3:4' THEN 3 WHEN 'custom' THEN custom_ratio_w END::BIGINT"
ASPECT_DEN = "CASE aspect_ratio WHEN '1:1' THEN 1 WHEN '4:3' THEN 3 WHEN '16:9' THEN 9 WHEN '9:16' THEN 16 WHEN '3:4' THEN 4 WHEN 'custom' THEN custom_ratio_h END::BIGINT"
CROP = with_sql(ITEMS_SQL, CROPS_SQL)


@query("b11_resolve_aspect", CROP + f"SELECT crop_id, {ASPECT_NUM} AS num, {ASPECT_DEN} AS den FROM crops")
def b11(spark, d):
    return fx.crops(spark, d).select("crop_id", X.resolve_aspect("aspect_ratio", "custom_ratio_w", "custom_ratio_h").alias("a")).select(
        "crop_id", "a.num", "a.den")


def even_sql(v):
    return f"greatest(2, round_even({v} / 2.0::DOUBLE, 0)::BIGINT * 2)"


@query("b12_crop_output_dims", CROP + f"SELECT crop_id, {even_sql('(500 + x)')} AS out_w, {even_sql('((500 + x) * h / w::DOUBLE)')} AS out_h FROM crops")
def b12(spark, d):
    return fx.crops(spark, d).select("crop_id", X.crop_output_dims("w", "h", "w", "h", F.col("x") + 500).alias("o")).select("crop_id", "o.out_w", "o.out_h")


@query("b13_time_texts", with_sql(ITEMS_SQL, SOURCES_SQL) + f""", x AS (SELECT i.*, {_DUR_SQL} AS rn, {_DEN_SQL} AS rd FROM items i JOIN sources USING (source_id))
SELECT timeline_id, item_ix, CASE WHEN source_in - 7 = 0 THEN '0s' ELSE ((source_in - 7) * rn) || '/' || rd || 's' END AS t,
 CASE WHEN source_in - 7 <= 0 THEN '0s' ELSE ((source_in - 7) * rn + rn // 2) || '/' || rd || 's' END AS seek,
 source_in + 0.25::DOUBLE AS nudged FROM x""")
def b13(spark, d):
    x = items_sources(spark, d).withColumn("r", X.frame_duration("fps")).withColumn("f", F.col("source_in") - 7)
    return x.select("timeline_id", "item_ix", X.time_str("f", "r.num", "r.den").alias("t"),
                    X.src_seek_str("f", "r.num", "r.den").alias("seek"), X.otio_start("source_in").alias("nudged"))


@query("b14_parse_fraction", """WITH t AS (SELECT o_orderkey, o_custkey AS k, CASE o_orderkey % 5 WHEN 0 THEN '0s' WHEN 1 THEN o_custkey || '/24000s'
  WHEN 2 THEN o_custkey || 's' WHEN 3 THEN o_custkey || '/24000' ELSE 'x/1s' END AS s FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN k WHEN 2 THEN k END::BIGINT AS num,
 CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 24000 WHEN 2 THEN 1 END::BIGINT AS den, o_orderkey % 5 >= 3 AS failed FROM t""")
def b14(spark, d):
    t = fx.table(spark, d, "orders").selectExpr(
        "o_orderkey", "case o_orderkey % 5 when 0 then '0s' when 1 then concat(o_custkey, '/24000s') when 2 then concat(o_custkey, 's') "
        "when 3 then concat(o_custkey, '/24000') else 'x/1s' end as s")
    return t.select("o_orderkey", X.parse_fraction("s").alias("p")).select(
        "o_orderkey", "p.num", "p.den", F.col("p.error").isNotNull().alias("failed"))


@query("b15_fps_suffix", f"""WITH o AS (SELECT p_partkey, {ODD_FPS} AS fps FROM part)
SELECT p_partkey, CASE WHEN abs(fps - 24000.0::DOUBLE/1001) < 0.01 THEN '2398' WHEN abs(fps - 24) < 0.01 THEN '24'
 WHEN abs(fps - 25) < 0.01 THEN '25' WHEN abs(fps - 30000.0::DOUBLE/1001) < 0.01 THEN '2997' WHEN abs(fps - 30) < 0.01 THEN '30'
 WHEN abs(fps - 50) < 0.01 THEN '50' WHEN abs(fps - 60000.0::DOUBLE/1001) < 0.01 THEN '5994' WHEN abs(fps - 60) < 0.01 THEN '60'
 ELSE round_even(fps, 0)::BIGINT::VARCHAR END AS suffix FROM o""")
def b15(spark, d):
    return odd_fps(spark, d).select("p_partkey", X.fps_suffix("fps").alias("suffix"))


@query("b16_names", """WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_name || ' / ' || p_brand ELSE ' ' || upper(p_name) || '#' || p_size || '  x' END AS n,
  CASE p_partkey % 3 WHEN 0 THEN '/m/' || p_name || '.' || p_size || '.MOV' WHEN 1 THEN 'C:\\m\\' || p_name ELSE '' END AS p FROM part)
SELECT p_partkey, CASE WHEN regexp_replace(trim(regexp_replace(n, '[^A-Za-z0-9 _-]+', '_', 'g')), '\\s+', '_', 'g') = '' THEN '_untagged'
  ELSE regexp_replace(trim(regexp_replace(n, '[^A-Za-z0-9 _-]+', '_', 'g')), '\\s+', '_', 'g') END AS folder,
 left(regexp_replace(regexp_replace(lower(trim(n)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) AS label,
 CASE p_partkey % 3 WHEN 0 THEN string_split(p, '/')[-1] WHEN 1 THEN string_split(p, '\\')[-1] ELSE '' END.lower() AS base,
 CASE p_partkey % 3 WHEN 0 THEN regexp_replace(string_split(p, '/')[-1], '\\.MOV$', '') WHEN 1 THEN string_split(p, '\\')[-1] ELSE 'source' END AS stem
FROM t""")
def b16(spark, d):
    t = fx.table(spark, d, "part").select(
        "p_partkey",
        F.expr("case p_partkey % 4 when 0 then '' when 1 then concat(p_name, ' / ', p_brand) else concat(' ', upper(p_name), '#', p_size, '  x') end").alias("n"),
        F.expr(r"case p_partkey % 3 when 0 then concat('/m/', p_name, '.', p_size, '.MOV') when 1 then concat(r'C:\m\', p_name) else '' end").alias("p"))
    return t.select("p_partkey", X.folder_slug("n").alias("folder"), X.label_slug("n").alias("label"),
                    X.basename_ci("p").alias("base"), X.stem("p").alias("stem"))


@query("b16_file_uri", """WITH t AS (SELECT p_partkey, '/m/' || p_name || '+~' || p_brand || '.mov' AS p FROM part)
SELECT p_partkey, 'file://' || replace(replace(replace(p, ' ', '%20'), '+', '%2B'), '#', '%23') AS uri FROM t""")
def b16_uri(spark, d):
    t = fx.table(spark, d, "part").selectExpr("p_partkey", "concat('/m/', p_name, '+~', p_brand, '.mov') as p")
    return t.select("p_partkey", X.file_uri("p").alias("uri"))


@query("b17_crop_job_name", CROP + """SELECT crop_id, 'clip_f' || source_in || '_' || w || 'x' || h || '_' || left(crop_id, 6) || '_' || left('seg' || x, 4) AS name FROM crops""")
def b17(spark, d):
    return fx.crops(spark, d).select("crop_id", X.crop_job_name(F.lit("clip"), "source_in", "w", "h", "crop_id", F.concat(F.lit("seg"), F.col("x"))).alias("name"))


@query("b18_pts_to_frame", SRC_RATE + """, x AS (SELECT *, CASE WHEN source_id % 10 > 0 THEN total_frames * 3000037 END AS pts FROM rated)
SELECT source_id, CASE WHEN pts IS NULL THEN -1 ELSE ((10::HUGEINT * pts * rate_den + 90000::HUGEINT * rate_num) // (10::HUGEINT * 90000 * rate_num)) END::BIGINT AS frame FROM x""")
def b18(spark, d):
    x = fx.sources(spark, d).withColumn("r", X.frame_duration("fps")).withColumn(
        "pts", F.when(F.col("source_id") % 10 > 0, F.col("total_frames") * 3000037))
    return x.select("source_id", X.pts_to_frame("pts", F.lit(1), F.lit(90000), "r.den", "r.num").alias("frame"))


@query("b18_rational_rate", SRC_RATE + """SELECT source_id, CASE WHEN rate_num = 1001 THEN rate_den ELSE rate_den // 100 END::BIGINT AS num,
 CASE WHEN rate_num = 1001 THEN 1001 ELSE 1 END::BIGINT AS den FROM rated""")
def b18r(spark, d):
    return fx.sources(spark, d).select("source_id", X.rational_rate("fps").alias("r")).select("source_id", "r.num", "r.den")


@query("b19_media_class", SRC + """SELECT source_id, CASE WHEN codec <> 'h264' OR width >= 3000 OR height >= 1800 OR source_id % 7 = 0 THEN 'heavy' ELSE 'light' END AS media_class FROM sources""")
def b19(spark, d):
    return fx.sources(spark, d).select("source_id", X.media_class("codec", "width", "height", F.col("source_id") % 7 == 0).alias("media_class"))


@query("b20_estimate_bytes", SRC + """, x AS (SELECT *, CASE source_id % 5 WHEN 0 THEN 0.09 WHEN 1 THEN 0.21 WHEN 2 THEN 0.30 WHEN 3 THEN 0.44 ELSE 0.30 END::DOUBLE AS f FROM sources)
SELECT source_id, round(total_frames * (width * height / 1000000.0::DOUBLE) * f * 1048576.0::DOUBLE + total_frames * 2000 * 4, 2) AS export_bytes,
 (total_frames * 2000 * 4)::DOUBLE AS audio_bytes FROM x""")
def b20(spark, d):
    x = fx.sources(spark, d).withColumn("key", F.expr(
        "case source_id % 5 when 0 then 'prores_proxy' when 1 then 'prores_lt' when 2 then 'prores_standard' when 3 then 'prores_hq' else 'other' end"))
    return x.select("source_id", X.estimate_bytes("key", "total_frames", "width", "height", F.col("total_frames") * 2000).alias("b")).select(
        "source_id", F.round("b.export_bytes", 2).alias("export_bytes"), "b.audio_bytes")


@query("b23_parse_version_name", """WITH t AS (SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS stamp, ts, event_id % 5 AS k FROM events)
SELECT event_id, k <> 4 AS matched, CASE WHEN k <> 4 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts,
 CASE k WHEN 0 THEN 'pre_detect_cuts' WHEN 1 THEN 'manual' WHEN 2 THEN 'manual' WHEN 3 THEN 'autosave' END AS trigger FROM t""")
def b23(spark, d):
    t = fx.table(spark, d, "events").selectExpr(
        "event_id", "concat(date_format(ts, 'yyyy-MM-dd_HH-mm-ss'), case event_id % 5 when 0 then '_pre-detect-cuts.project' when 1 then '.project' "
        "when 2 then '_whatever.project' when 3 then '_autosave.PROJECT' else '.txt' end) as name")
    return t.select("event_id", X.parse_version_name("name").alias("v")).select(
        "event_id", "v.matched", F.date_format("v.ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "v.trigger")


@query("b25_clamp_rect", CROP + """, r AS (SELECT *, x * 20 - 100 AS cx, y * 11 - 50 AS cy, 1280 AS fw, 720 AS fh FROM crops),
m AS (SELECT crop_id, 'move' AS mode, greatest(0, least(fw - w, cx)) AS x, greatest(0, least(fh - h, cy)) AS y, w, h FROM r),
dr AS (SELECT crop_id, w, h, fw, fh, greatest(0, least(fw - 8, cx)) AS x, greatest(0, least(fh - 8, cy)) AS y FROM r),
re AS (SELECT crop_id, w, h, fw, fh, greatest(0, least(fw - 2, cx)) AS x, greatest(0, least(fh - 2, cy)) AS y FROM r)
SELECT * FROM m UNION ALL SELECT crop_id, 'draw', x, y, greatest(8, least(fw - x, w)), greatest(8, least(fh - y, h)) FROM dr
UNION ALL SELECT crop_id, 'render', x, y, greatest(2, least(fw - x, w)), greatest(2, least(fh - y, h)) FROM re""")
def b25(spark, d):
    r = fx.crops(spark, d).selectExpr("crop_id", "x * 20 - 100 as x", "y * 11 - 50 as y", "w", "h")
    modes = [F.struct(F.lit(m).alias("mode"), X.clamp_rect(m, "x", "y", "w", "h", F.lit(1280), F.lit(720)).alias("r")) for m in ("move", "draw", "render")]
    return r.select("crop_id", F.explode(F.array(*modes)).alias("m")).select("crop_id", "m.mode", "m.r.*")


@query("b25_default_rect", SRC + """SELECT source_id, (width - greatest(16, width // 2)) // 2 AS x, (height - greatest(16, height // 2)) // 2 AS y,
 greatest(16, width // 2) AS w, greatest(16, height // 2) AS h FROM (SELECT source_id, width::BIGINT AS width, height::BIGINT AS height FROM sources)""")
def b25d(spark, d):
    return fx.sources(spark, d).select("source_id", X.default_rect("width", "height").alias("r")).select("source_id", "r.*")


@query("b27_is_media_path", """SELECT p_partkey, p_partkey % 4 IN (0, 1) AS media FROM part""")
def b27(spark, d):
    t = fx.table(spark, d, "part").selectExpr(
        "p_partkey", "concat('/a.mov/', p_name, case p_partkey % 4 when 0 then '.MKV' when 1 then '.x.mp4' when 2 then '.txt' else '' end) as p")
    return t.select("p_partkey", X.is_media_path("p").alias("media"))


@query("b24_timebase_fix_plan", SRC_RATE + """, bad AS (SELECT * FROM rated WHERE time_base_num > 0 AND time_base_den > 0
  AND (rate_num * time_base_den) % (rate_den * time_base_num) <> 0)
SELECT source_id, CASE WHEN source_id % 2 = 0 THEN regexp_replace(file_path, '\\.mov$', '.mkv') ELSE file_path END AS input_path,
 regexp_replace(file_path, '\\.mov$', '_fixed.mov') AS output_path, rate_den AS target_ticks, source_id % 2 = 0 AS used_sibling,
 round(total_frames / fps, 6) AS seconds FROM bad""")
def b24(spark, d):
    from shotweave.operators.source_tables import timebase_fix_plan
    s = fx.sources(spark, d)
    files = s.where("source_id % 2 = 0").select(F.regexp_replace("file_path", r"\.mov$", ".mkv").alias("path"))
    return timebase_fix_plan(s, files).withColumn("seconds", F.round("seconds", 6))


@query("c10_unsafe_sources", SRC_RATE + """SELECT source_id FROM rated WHERE time_base_num > 0 AND time_base_den > 0
  AND (rate_num * time_base_den) % (rate_den * time_base_num) <> 0""")
def c10(spark, d):
    from shotweave.operators.source_tables import unsafe_sources
    return unsafe_sources(fx.sources(spark, d)).select("source_id")
