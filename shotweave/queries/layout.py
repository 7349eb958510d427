"""Placement, ranges, filters, islands and export plans."""

from pyspark.sql import functions as F

from shotweave import fixtures as fx
from shotweave.fixtures import GROUPS_SQL, ITEMS_SQL, SOURCES_SQL, TIMELINES_SQL, with_sql
from shotweave.operators import timeline as tl
from shotweave.plans import export as ex
from shotweave.queries import query

TAGS = [0, 1]
OPTS_TAGGED = ex.ExportOptions(include_gaps=True, group_ids=TAGS, include_untagged=True)
TAG_SQL = "(CASE WHEN group_id IS NULL THEN true ELSE group_id IN (0, 1) END)"

PLACED_SQL = """placed AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY timeline_id ORDER BY item_ix
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tl_start,
 (sum(dur) OVER (PARTITION BY timeline_id))::BIGINT AS tl_total FROM items)"""
RANGED_SQL = PLACED_SQL + """, ranged0 AS (SELECT p.*, tl_start + dur - 1 AS tl_end,
  least(coalesce(in_point, 0), tl_total - 1) AS range_start,
  least(coalesce(out_point, tl_total - 1), tl_total - 1) AS range_end
  FROM placed p LEFT JOIN timelines t USING (timeline_id)),
ranged AS (SELECT *, greatest(tl_start, range_start) AS eff_start, least(tl_end, range_end) AS eff_end,
  least(tl_end, range_end) - greatest(tl_start, range_start) + 1 AS frame_count,
  CASE WHEN source_id IS NULL THEN 0 ELSE source_in + greatest(tl_start, range_start) - tl_start END AS src_in
  FROM ranged0 WHERE tl_end >= range_start AND tl_start <= range_end)"""
BASE = with_sql(ITEMS_SQL, TIMELINES_SQL, SOURCES_SQL, RANGED_SQL)
PLAN_SQL = """plan AS (SELECT timeline_id, item_ix, clip_id, source_id, file_path, label, color_index, src_in, frame_count, fps,
  eff_start - range_start AS offset_in_range,
  coalesce(sum(frame_count) OVER (PARTITION BY timeline_id ORDER BY item_ix
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_packed
  FROM ranged JOIN sources USING (source_id))"""
BASE_PLAN = BASE + ", " + PLAN_SQL + "\n"


def tables(spark, d):
    return fx.items(spark, d), fx.timelines(spark, d), fx.sources(spark, d)


@query("k1_export_plan", BASE_PLAN + """SELECT timeline_id, item_ix, clip_id, source_id, src_in, frame_count,
 round(fps, 6) AS fps, offset_packed, offset_in_range FROM plan""")
def k1(spark, d):
    it, t, s = tables(spark, d)
    return ex.export_plan(it, s, t).select(
        "timeline_id", "item_ix", "clip_id", "source_id", "src_in", "frame_count",
        F.round("fps", 6).alias("fps"), "offset_packed", "offset_in_range")


@query("k1_export_plan_tagged_with_gaps", BASE + """, kept AS (SELECT r.*, s.fps AS sfps FROM ranged r
  LEFT JOIN sources s USING (source_id)
  WHERE source_id IS NULL OR (s.fps IS NOT NULL AND """ + TAG_SQL + """))
SELECT timeline_id, item_ix, clip_id, source_id, src_in, frame_count,
 round(CASE WHEN source_id IS NULL THEN 24.0 ELSE sfps END, 6) AS fps,
 eff_start - range_start AS offset_in_range,
 coalesce(sum(CASE WHEN source_id IS NULL THEN 0 ELSE frame_count END) OVER (PARTITION BY timeline_id ORDER BY item_ix
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_packed FROM kept""")
def k1_tagged(spark, d):
    it, t, s = tables(spark, d)
    return ex.export_plan(it, s, t, OPTS_TAGGED).select(
        "timeline_id", "item_ix", "clip_id", "source_id", "src_in", "frame_count",
        F.round("fps", 6).alias("fps"), "offset_in_range", "offset_packed")


_DUR_SQL = """CASE WHEN abs(fps - 24000.0/1001) < 0.01 OR abs(fps - 30000.0/1001) < 0.01 OR abs(fps - 60000.0/1001) < 0.01 THEN 1001
  WHEN abs(fps - round_even(fps, 0)) < 0.001 THEN 100 ELSE 1000 END::BIGINT"""
_DEN_SQL = """CASE WHEN abs(fps - 24000.0/1001) < 0.01 THEN 24000 WHEN abs(fps - 30000.0/1001) < 0.01 THEN 30000
  WHEN abs(fps - 60000.0/1001) < 0.01 THEN 60000 WHEN abs(fps - round_even(fps, 0)) < 0.001 THEN round_even(fps, 0) * 100
  ELSE round_even(fps * 1000, 0) END::BIGINT"""


@query("k2_interchange_rows", BASE_PLAN + f""", r AS (SELECT *, {_DUR_SQL} AS rate_num, {_DEN_SQL} AS rate_den FROM plan)
SELECT timeline_id, item_ix, rate_num, rate_den,
 CASE WHEN src_in <= 0 THEN '0s' ELSE (src_in * rate_num + rate_num // 2) || '/' || rate_den || 's' END AS start_text,
 CASE WHEN frame_count = 0 THEN '0s' ELSE (frame_count * rate_num) || '/' || rate_den || 's' END AS duration_text,
 CASE WHEN offset_packed = 0 THEN '0s' ELSE (offset_packed * rate_num) || '/' || rate_den || 's' END AS offset_packed_text,
 CASE WHEN offset_in_range = 0 THEN '0s' ELSE (offset_in_range * rate_num) || '/' || rate_den || 's' END AS offset_range_text,
 src_in + 0.25::DOUBLE AS start_value FROM r""")
def k2(spark, d):
    it, t, s = tables(spark, d)
    return ex.interchange_rows(ex.export_plan(it, s, t)).select(
        "timeline_id", "item_ix", "rate_num", "rate_den", "start_text", "duration_text",
        "offset_packed_text", "offset_range_text", "start_value")


@query("f1_place_items", with_sql(ITEMS_SQL, PLACED_SQL) +
       "SELECT timeline_id, item_ix, tl_start, tl_start + dur - 1 AS tl_end, tl_total FROM placed")
def f1(spark, d):
    return tl.place_items(fx.items(spark, d)).select("timeline_id", "item_ix", "tl_start", "tl_end", "tl_total")


@query("b1_item_basics", with_sql(ITEMS_SQL) + """SELECT timeline_id, item_ix, dur AS duration_frames,
 source_id IS NULL AS is_gap FROM items""")
def b1(spark, d):
    return tl.with_item_basics(fx.items(spark, d)).select("timeline_id", "item_ix", "duration_frames", "is_gap")


@query("c1_filter_by_groups", with_sql(ITEMS_SQL) + "SELECT timeline_id, item_ix, group_id AS tag FROM items WHERE " + TAG_SQL)
def c1(spark, d):
    return tl.filter_by_groups(fx.items(spark, d), TAGS, True).select("timeline_id", "item_ix", F.try_element_at("group_ids", F.lit(1)).alias("tag"))


@query("c1_filter_tagged_only", with_sql(ITEMS_SQL) + "SELECT timeline_id, item_ix FROM items WHERE group_id IN (0, 1)")
def c1b(spark, d):
    return tl.filter_by_groups(fx.items(spark, d), TAGS, False).select("timeline_id", "item_ix")


@query("c3_clip_to_range", BASE + "SELECT timeline_id, item_ix, eff_start, eff_end, frame_count, src_in FROM ranged")
def c3(spark, d):
    it, t, _ = tables(spark, d)
    return tl.clip_to_range(tl.place_items(it), tl.render_range(t, it)).select(
        "timeline_id", "item_ix", "eff_start", "eff_end", "frame_count", "src_in")


@query("c5_items_in_ranges", with_sql(ITEMS_SQL, PLACED_SQL) + """, q AS (SELECT o_orderkey AS timeline_id, k AS range_id, lo + 40 * k AS lo, lo + 40 * k + len AS hi FROM
  (SELECT o_orderkey, o_custkey % 100 AS lo, o_custkey % 37 AS len, unnest([0, 1]) AS k FROM orders))
SELECT p.timeline_id, item_ix, range_id::BIGINT AS range_id FROM placed p JOIN q USING (timeline_id)
 WHERE source_id IS NOT NULL AND dur >= 5 AND tl_start <= hi AND tl_start + dur - 1 >= lo""")
def c5(spark, d):
    q = fx.table(spark, d, "orders").selectExpr(
        "o_orderkey as timeline_id", "o_custkey % 100 as lo0", "o_custkey % 37 as len",
        "explode(array(0L, 1L)) as range_id").selectExpr(
        "timeline_id", "range_id", "lo0 + 40 * range_id as lo", "lo0 + 40 * range_id + len as hi")
    return tl.items_in_ranges(fx.items(spark, d), q, 5, width=64).select("timeline_id", "item_ix", "range_id")


@query("c8_clip_runs", with_sql(ITEMS_SQL) + """SELECT timeline_id, item_ix, run_id FROM (SELECT *,
  coalesce(sum((source_id IS NULL)::INT) OVER (PARTITION BY timeline_id ORDER BY item_ix
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run_id FROM items) WHERE source_id IS NOT NULL""")
def c8(spark, d):
    return tl.clip_runs(fx.items(spark, d)).select("timeline_id", "item_ix", "run_id")


@query("e1_timeline_stats", with_sql(ITEMS_SQL) + """SELECT timeline_id, count(*) AS n_items,
 count(source_id) AS n_real, sum(dur)::BIGINT AS total_frames, round(sum(dur) / 24.0::DOUBLE, 6) AS seconds
 FROM items GROUP BY timeline_id""")
def e1(spark, d):
    return tl.timeline_stats(fx.items(spark, d)).withColumn("seconds", F.round("seconds", 6))


@query("e2_counts_by_source", with_sql(ITEMS_SQL, SOURCES_SQL) + """SELECT s.source_id, count(i.source_id) AS n_items
 FROM sources s LEFT JOIN items i ON i.source_id = s.source_id GROUP BY s.source_id""")
def e2(spark, d):
    return tl.counts_by_source(fx.items(spark, d), fx.sources(spark, d))


@query("e2_counts_by_group", with_sql(ITEMS_SQL, GROUPS_SQL) + """SELECT g.group_id, name, count(i.clip_id) AS n_items
 FROM groups g LEFT JOIN items i ON i.group_id = g.group_id AND i.source_id IS NOT NULL GROUP BY g.group_id, name""")
def e2b(spark, d):
    return tl.counts_by_group(fx.items(spark, d), fx.groups(spark, d))


@query("e3_export_extent", BASE + """SELECT timeline_id, count(source_id) AS n_clips, sum(frame_count)::BIGINT AS n_frames
 FROM ranged WHERE source_id IS NULL OR """ + TAG_SQL + " GROUP BY timeline_id")
def e3(spark, d):
    it, t, _ = tables(spark, d)
    return ex.export_extent(it, t, OPTS_TAGGED)


@query("e4_used_sources", BASE + """SELECT timeline_id, source_id, first_ix,
 row_number() OVER (PARTITION BY timeline_id ORDER BY first_ix) - 1 AS use_ix FROM
 (SELECT timeline_id, source_id, min(item_ix) AS first_ix FROM ranged WHERE source_id IS NOT NULL GROUP BY ALL)""")
def e4(spark, d):
    it, t, _ = tables(spark, d)
    return ex.used_sources(it, t)


AUDIO_SQL = """CASE WHEN audio_channels <= 0 THEN 'none' ELSE concat_ws(', ', CASE WHEN audio_codec <> '' THEN audio_codec END,
 audio_channels || ' ch', CASE WHEN audio_sample_rate > 0 THEN regexp_replace(printf('%.3f', audio_sample_rate / 1000.0::DOUBLE), '\\.?0+$', '') || ' kHz' END) END"""


@query("e5_audio_summary", BASE + f""", u AS (SELECT DISTINCT timeline_id, {AUDIO_SQL} AS d FROM ranged JOIN sources USING (source_id)),
a AS (SELECT timeline_id, count(*) AS n, max(CASE WHEN d <> 'none' THEN d END) AS loud, bool_or(d = 'none') AS silent FROM u GROUP BY timeline_id)
SELECT timeline_id, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN coalesce(loud, 'none')
 WHEN n = 2 AND silent THEN 'mixed (' || loud || ' and silent)' ELSE 'mixed' END AS audio
 FROM (SELECT DISTINCT timeline_id FROM items) LEFT JOIN a USING (timeline_id)""")
def e5(spark, d):
    it, t, s = tables(spark, d)
    return ex.audio_summary(it, t, s)


@query("e6_render_range", with_sql(ITEMS_SQL, TIMELINES_SQL) + """, tot AS (SELECT timeline_id, sum(dur)::BIGINT AS n FROM items GROUP BY timeline_id)
SELECT timeline_id, coalesce(n, 0) AS tl_total,
 CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE least(coalesce(in_point, 0), n - 1) END AS range_start,
 CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE least(coalesce(out_point, n - 1), n - 1) END AS range_end
 FROM timelines LEFT JOIN tot USING (timeline_id)""")
def e6(spark, d):
    return tl.render_range(fx.timelines(spark, d), fx.items(spark, d))


@query("f2_merge_gaps", with_sql(ITEMS_SQL) + """, m AS (SELECT *, coalesce(sum((source_id IS NOT NULL)::INT) OVER (PARTITION BY timeline_id ORDER BY item_ix
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM items)
SELECT timeline_id, item_ix, clip_id, source_id, source_in, source_out FROM m WHERE source_id IS NOT NULL
UNION ALL SELECT timeline_id, min(item_ix), arg_min(clip_id, item_ix), NULL, 0, (sum(dur) - 1)::BIGINT FROM m
 WHERE source_id IS NULL GROUP BY timeline_id, run""")
def f2(spark, d):
    return tl.merge_gaps(fx.items(spark, d)).select("timeline_id", "item_ix", "clip_id", "source_id", "source_in", "source_out")


@query("f9_layout_offsets", BASE_PLAN + "SELECT timeline_id, item_ix, offset_packed, offset_in_range FROM plan")
def f9(spark, d):
    it, t, s = tables(spark, d)
    return ex.export_plan(it, s, t).select("timeline_id", "item_ix", "offset_packed", "offset_in_range")


@query("f10_coalesce_ranges", with_sql(ITEMS_SQL) + """, p AS (SELECT timeline_id % 10 AS timeline_id, source_id % 50 AS source_id, source_in AS src_in, least(dur, 7) AS frame_count,
  timeline_id * 1000 + item_ix AS ord FROM items WHERE source_id IS NOT NULL),
f AS (SELECT *, CASE WHEN src_in = lag(src_in + frame_count) OVER w THEN 0 ELSE 1 END AS nw FROM p
  WINDOW w AS (PARTITION BY timeline_id, source_id ORDER BY src_in, ord)),
i AS (SELECT *, sum(nw) OVER (PARTITION BY timeline_id, source_id ORDER BY src_in, ord) AS island FROM f)
SELECT timeline_id, source_id, min(src_in) AS src_in, sum(frame_count)::BIGINT AS frame_count, count(*) AS n_items
 FROM i GROUP BY timeline_id, source_id, island""")
def f10(spark, d):
    p = fx.items(spark, d).where("source_id is not null").selectExpr(
        "timeline_id % 10 as timeline_id", "source_id % 50 as source_id", "timeline_id * 1000 + item_ix as item_ix",
        "source_in as src_in", "least(dur, 7L) as frame_count")
    return tl.coalesce_ranges(p)


@query("f13_assign_colors", with_sql(ITEMS_SQL) + """SELECT timeline_id, item_ix, CASE WHEN source_id IS NULL THEN 0 ELSE
 (coalesce(sum((source_id IS NOT NULL)::INT) OVER (PARTITION BY timeline_id ORDER BY item_ix
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 3) % 8 END::INTEGER AS color_index FROM items""")
def f13(spark, d):
    return tl.assign_colors(fx.items(spark, d), 3).select("timeline_id", "item_ix", "color_index")


@query("f15_contiguous_flags", with_sql(ITEMS_SQL) + """, x AS (SELECT l_suppkey % 50 AS timeline_id, timeline_id * 1000 + item_ix AS item_ix,
  CASE WHEN source_id IS NOT NULL THEN source_id % 3 END AS source_id, source_in, source_out FROM items)
SELECT timeline_id, item_ix, coalesce(source_id = lag(source_id) OVER w AND source_in = lag(source_out) OVER w + 1, false) AS contiguous
 FROM x WINDOW w AS (PARTITION BY timeline_id ORDER BY item_ix)""")
def f15(spark, d):
    it = fx.items(spark, d).selectExpr(
        "l_suppkey % 50 as timeline_id", "timeline_id * 1000 + item_ix as item_ix",
        "case when source_id is not null then source_id % 3 end as source_id", "source_in", "source_out")
    return tl.contiguous_flags(it, fx.sources(spark, d)).select("timeline_id", "item_ix", "contiguous")


@query("h4_frame_export_order", BASE + """, kept AS (SELECT r.* FROM ranged r LEFT JOIN sources s USING (source_id)
  WHERE source_id IS NULL OR s.fps IS NOT NULL)
SELECT timeline_id, 0 AS phase, min(item_ix) OVER (PARTITION BY timeline_id, source_id) AS source_order, source_id, src_in, frame_count, item_ix
 FROM kept WHERE source_id IS NOT NULL
UNION ALL SELECT timeline_id, 1, NULL, NULL, 0, frame_count, item_ix FROM kept WHERE source_id IS NULL""")
def h4(spark, d):
    it, t, s = tables(spark, d)
    return ex.frame_export_order(ex.export_plan(it, s, t, ex.ExportOptions(include_gaps=True)))


@query("k7_frame_map", with_sql(ITEMS_SQL, PLACED_SQL) + """SELECT timeline_id, tl_frame, item_ix, source_id,
 CASE WHEN source_id IS NOT NULL THEN source_in + tl_frame - tl_start END AS source_frame
 FROM (SELECT *, unnest(range(tl_start, tl_start + dur)) AS tl_frame FROM placed)""")
def k7(spark, d):
    return tl.frame_map(fx.items(spark, d)).select("timeline_id", "tl_frame", "item_ix", "source_id", "source_frame")


@query("e22_crop_count", with_sql(ITEMS_SQL, fx.CROPS_SQL) + "SELECT timeline_id, count(*) AS n_crops FROM crops GROUP BY timeline_id")
def e22(spark, d):
    it = fx.items(spark, d)
    return tl.crop_count(it, fx.crops(spark, d, it))


@query("c6_heal_references", with_sql(ITEMS_SQL) + """SELECT timeline_id, item_ix, CASE WHEN group_id < 3 THEN group_id::VARCHAR ELSE '' END AS tags FROM items""")
def c6(spark, d):
    it = fx.items(spark, d)
    healed, _ = tl.heal_references(it, fx.crops(spark, d, it), fx.groups(spark, d).where("group_id < 3"))
    return healed.select("timeline_id", "item_ix", F.array_join("group_ids", ",").alias("tags"))


@query("c6_heal_crop_groups", with_sql(ITEMS_SQL, fx.CROPS_SQL) + """SELECT crop_id, CASE WHEN group_id < 25 THEN group_id END AS group_id FROM crops""")
def c6b(spark, d):
    it = fx.items(spark, d)
    _, crops = tl.heal_references(it, fx.crops(spark, d, it), fx.groups(spark, d))
    return crops.select("crop_id", "group_id")
