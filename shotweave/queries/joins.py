"""Lookups, reconciliation, relinking and retention."""

from pyspark.sql import functions as F

from shotweave import fixtures as fx
from shotweave.fixtures import (CROPS_SQL, FRAMES_SQL, ITEMS_SQL, KEYFRAMES_SQL, PACKETS_SQL, SEGMENTS_SQL, SOURCES_SQL,
                                VERSIONS_SQL, with_sql)
from shotweave.operators import joins as j, source_tables as st, timeline as tl, versions as vs
from shotweave.queries import query
from shotweave.queries.layout import PLACED_SQL
from shotweave.queries.scalars import REQ_SQL


@query("d1_items_with_source", with_sql(ITEMS_SQL, SOURCES_SQL) + """SELECT timeline_id, item_ix, i.source_id, file_path, total_frames FROM items i
 JOIN sources s ON s.source_id = i.source_id WHERE s.source_id % 3 > 0""")
def d1(spark, d):
    s = fx.sources(spark, d).where("source_id % 3 > 0")
    return fx.items(spark, d).join(s, "source_id").select("timeline_id", "item_ix", "source_id", "file_path", "total_frames")


@query("d2_item_groups", with_sql(ITEMS_SQL, fx.GROUPS_SQL) + "SELECT timeline_id, item_ix, group_id, name FROM items JOIN groups USING (group_id) WHERE group_id <> 4")
def d2(spark, d):
    return tl.item_groups(fx.items(spark, d), fx.groups(spark, d).where("group_id <> 4")).select("timeline_id", "item_ix", "group_id", "name")


POINTS_SQL = "pts AS (SELECT o_orderkey AS timeline_id, unnest([o_custkey % 97, o_custkey % 211, 10]) AS tl_frame, unnest([0, 1, 2]) AS k FROM orders)"


def points(spark, d):
    return fx.table(spark, d, "orders").selectExpr(
        "o_orderkey as timeline_id", "posexplode(array(o_custkey % 97, o_custkey % 211, 10L)) as (k, tl_frame)")


@query("d3_locate_frames", with_sql(ITEMS_SQL, PLACED_SQL, POINTS_SQL) + """SELECT q.timeline_id, k, q.tl_frame, item_ix, tl_frame - tl_start AS "offset",
 CASE WHEN source_id IS NOT NULL THEN source_in + tl_frame - tl_start END AS source_frame
 FROM pts q LEFT JOIN placed p ON p.timeline_id = q.timeline_id AND tl_start <= tl_frame AND tl_frame < tl_start + dur""")
def d3(spark, d):
    return j.locate_frames(fx.items(spark, d), points(spark, d)).select("timeline_id", "k", "tl_frame", "item_ix", "offset", "source_frame")


@query("c8_run_to_gap", with_sql(ITEMS_SQL, PLACED_SQL, POINTS_SQL) + """, r AS (SELECT *, coalesce(sum((source_id IS NULL)::INT) OVER (PARTITION BY timeline_id ORDER BY item_ix
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM placed),
hit AS (SELECT DISTINCT q.timeline_id, tl_frame, CASE WHEN source_id IS NULL THEN item_ix - 1 ELSE item_ix END AS e
 FROM pts q JOIN placed p ON p.timeline_id = q.timeline_id AND tl_start <= tl_frame AND tl_frame < tl_start + dur)
SELECT h.timeline_id, tl_frame, r.item_ix FROM hit h JOIN r e ON e.timeline_id = h.timeline_id AND e.item_ix = h.e AND e.source_id IS NOT NULL
 JOIN r ON r.timeline_id = h.timeline_id AND r.run = e.run AND r.item_ix <= h.e AND r.source_id IS NOT NULL""")
def c8b(spark, d):
    return j.run_to_gap(fx.items(spark, d), points(spark, d)).select("timeline_id", "tl_frame", "item_ix")


@query("d4_segment_overlaps", with_sql(ITEMS_SQL, SOURCES_SQL, CROPS_SQL) + f""", seg AS (SELECT crop_id, unnest([0, 1, 2]) AS ix, source_in + unnest([0, 5, 9]) * (1 + x % 20) AS a, source_id FROM crops),
sg AS (SELECT seg.*, {REQ_SQL} AS n FROM seg JOIN sources USING (source_id))
SELECT l.crop_id, l.ix AS ix_a, r.ix AS ix_b, greatest(l.a, r.a) AS shared_lo, least(l.a, r.a) + l.n AS shared_hi
 FROM sg l JOIN sg r ON l.crop_id = r.crop_id AND l.ix < r.ix WHERE least(l.a, r.a) + l.n > greatest(l.a, r.a)""")
def d4(spark, d):
    from shotweave.functions import expr as X
    seg = fx.crops(spark, d).selectExpr("crop_id", "source_id", "source_in", "x", "posexplode(array(0, 5, 9)) as (segment_ix, m)").selectExpr(
        "crop_id", "source_id", "segment_ix", "source_in + m * (1 + x % 20) as anchor")
    seg = seg.join(fx.sources(spark, d).select("source_id", "fps"), "source_id").withColumn("window_frames", X.required_frames("fps"))
    return j.segment_overlaps(seg)


SEEKS_SQL = "seeks AS (SELECT o_custkey % ((SELECT count(DISTINCT user_id) FROM events) + 10) AS source_id, o_orderkey AS seek_id, (1704067200 + o_totalprice * 5)::DOUBLE AS seek, (o_custkey % 3)::DOUBLE AS start_time FROM orders)"


def seeks(spark, d):
    return fx.table(spark, d, "orders").selectExpr(
        f"o_custkey % {fx.users(spark, d) + 10} as source_id", "o_orderkey as seek_id", "1704067200D + o_totalprice * 5 as seek", "cast(o_custkey % 3 as double) as start_time")


@query("d5_bracket_pts", with_sql(PACKETS_SQL, SEEKS_SQL) + """, have AS (SELECT DISTINCT source_id FROM packets)
SELECT s.seek_id, s.source_id, CASE WHEN h.source_id IS NULL THEN -1 ELSE coalesce(p.pts_ix, 0) END AS pts_k
 FROM seeks s LEFT JOIN have h ON h.source_id = s.source_id
 ASOF LEFT JOIN packets p ON p.source_id = s.source_id AND s.seek - s.start_time >= p.pts_time""")
def d5(spark, d):
    return j.bracket_pts(seeks(spark, d), fx.packets(spark, d), width=3600.0).select("seek_id", "source_id", "pts_k")


KEYPOINTS_SQL = "kp AS (SELECT o_orderkey, o_custkey % (SELECT count(DISTINCT user_id) FROM events) AS crop_id, CASE o_orderkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'y' WHEN 2 THEN 'w' ELSE 'h' END AS axis, o_orderkey % 720 AS frame FROM orders)"


def keypoints(spark, d):
    return fx.table(spark, d, "orders").selectExpr(
        "o_orderkey", f"o_custkey % {fx.users(spark, d)} as crop_id", "case o_orderkey % 4 when 0 then 'x' when 1 then 'y' when 2 then 'w' else 'h' end as axis",
        "o_orderkey % 720 as frame")


@query("d6_neighbour_keys", with_sql(KEYFRAMES_SQL, KEYPOINTS_SQL) + """SELECT o_orderkey, max(CASE WHEN source_frame < frame THEN source_frame END) AS prev_key,
 min(CASE WHEN source_frame > frame THEN source_frame END) AS next_key
 FROM kp LEFT JOIN keyframes k ON k.crop_id = kp.crop_id AND k.axis = kp.axis GROUP BY o_orderkey""")
def d6(spark, d):
    return j.neighbour_keys(keypoints(spark, d), fx.keyframes(spark, d)).select("o_orderkey", "prev_key", "next_key")


@query("d7_reconcile_versions", """WITH m AS (SELECT user_id, 'v' || event_id AS x, event_id, event_type, ts FROM events WHERE event_id % 3 > 0),
f AS (SELECT event_id, event_id % 1000 AS sz, ts FROM events WHERE event_id % 4 > 0)
SELECT coalesce(m.event_id, f.event_id) AS event_id, CASE WHEN m.event_id IS NOT NULL THEN m.event_type WHEN f.event_id % 2 = 0 THEN 'autosave' ELSE 'manual' END AS trigger,
 CASE WHEN m.event_id IS NOT NULL THEN 7 ELSE f.sz END::BIGINT AS size_bytes, m.event_id IS NULL AS derived
 FROM f LEFT JOIN m ON m.event_id = f.event_id WHERE m.event_id IS NOT NULL OR f.event_id % 5 > 0""")
def d7(spark, d):
    ev = fx.table(spark, d, "events").withColumn("filename", F.expr(
        "concat(date_format(ts, 'yyyy-MM-dd_HH-mm-ss'), case when event_id % 2 = 0 then '_autosave' else '' end, "
        "case when event_id % 5 > 0 then '.project' else '.bak' end)"))
    # names carry a one-second stamp: the event id keeps the reconciliation key unique
    m = ev.where("event_id % 3 > 0").selectExpr(
        "event_id", "filename", "'2024-01-01T00:00:00' as timestamp", "event_type as trigger", "cast(null as string) as label",
        "1L as clip_count", "1L as source_count", "7L as size_bytes")
    f = ev.where("event_id % 4 > 0").selectExpr("event_id", "filename", "event_id % 1000 as size_bytes")
    return vs.reconcile_versions(m, f, ["event_id"]).select("event_id", "trigger", "size_bytes", "derived")


@query("d8_skip_cached", """SELECT o_custkey % 50 AS source_id, o_orderkey AS frame FROM orders WHERE NOT EXISTS
 (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey % 50 = o_custkey % 50)""")
def d8(spark, d):
    t = fx.table(spark, d, "orders").selectExpr("o_custkey % 50 as source_id", "o_orderkey as frame")
    return j.skip_cached(t, fx.table(spark, d, "lineitem").selectExpr("l_partkey % 50 as source_id", "l_orderkey as frame"))


@query("d9_selected", with_sql(ITEMS_SQL) + "SELECT timeline_id, item_ix FROM items WHERE timeline_id % 7 = 0 AND item_ix % 2 = 0")
def d9(spark, d):
    it = fx.items(spark, d)
    ids = it.where("timeline_id % 7 = 0 and item_ix % 2 = 0").select("timeline_id", "clip_id")
    return j.selected(it, ids).select("timeline_id", "item_ix")


# popular names, three shapes, lengths that sit on both sides of the 1% line
RELINK_SQL = """mis AS (SELECT p_partkey AS source_id, upper(p_name) AS n, p_size % 3 AS wh, (CASE p_size % 2 WHEN 0 THEN 24.0 ELSE 25.0 END)::DOUBLE AS fps,
  CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE 2000 + p_partkey % 500 END AS fr FROM part WHERE p_partkey % 10 = 0),
cand AS (SELECT p_partkey AS cid, lower(p_name) AS n, p_size % 3 AS wh, (CASE p_size % 2 WHEN 0 THEN 24.0 ELSE 25.0 END + CASE WHEN p_partkey % 3 = 0 THEN 0.01 ELSE 0.03 END)::DOUBLE AS fps,
  CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 2000 + p_partkey % 2500 END AS fr FROM part)
"""


@query("d10_relink", "WITH " + RELINK_SQL + """SELECT m.source_id, min('/new/' || lpad(cid::VARCHAR, 12, '0') || '/' || c.n) AS new_path FROM mis m JOIN cand c ON lower(m.n) = c.n AND m.wh = c.wh
 AND abs(m.fps - c.fps) <= 0.02 AND CASE WHEN m.fr > 0 THEN abs(c.fr - m.fr) <= greatest(1, trunc(m.fr * 0.01)) ELSE c.fr > 0 END GROUP BY m.source_id""")
def d10(spark, d):
    part = fx.table(spark, d, "part")
    rate = "cast(case p_size % 2 when 0 then 24.0 else 25.0 end as double)"
    m = part.where("p_partkey % 10 = 0").selectExpr(
        "p_partkey as source_id", "concat('/old/', upper(p_name)) as file_path", "p_size % 3 as width", "1 as height", f"{rate} as fps",
        "case when p_partkey % 50 = 0 then 0L else 2000 + p_partkey % 500 end as total_frames")
    c = part.selectExpr(
        "concat('/new/', lpad(p_partkey, 12, '0'), '/', lower(p_name)) as file_path", "p_size % 3 as width", "1 as height",
        "cast(case p_size % 2 when 0 then 24.0 else 25.0 end + case when p_partkey % 3 = 0 then 0.01 else 0.03 end as double) as fps",
        "case when p_partkey % 4 = 0 then 0L else 2000 + p_partkey % 2500 end as total_frames")
    return st.relink(m, c).select("source_id", "new_path")


@query("d11_revive_orphans", with_sql(SOURCES_SQL) + """SELECT file_path, CASE WHEN source_id % 3 = 0 AND source_id % 2 = 1 THEN source_id + 1000000 ELSE source_id + 500 END AS source_id,
 source_id % 3 = 0 AND source_id % 2 = 1 AS revived FROM sources""")
def d11(spark, d):
    s = fx.sources(spark, d)
    orphans = s.where("source_id % 3 = 0").selectExpr("file_path", "source_id + 1000000 as source_id")
    live = s.where("source_id % 2 = 0").selectExpr("source_id + 1000000 as source_id")
    return st.revive_orphans(s.selectExpr("file_path", "source_id + 500 as source_id"), orphans, live).select("file_path", "source_id", "revived")


@query("d12_first_at_or_after", with_sql(FRAMES_SQL) + f""", t AS (SELECT o_custkey % (SELECT count(DISTINCT user_id) FROM events) AS source_id, o_orderkey, o_orderkey % (2 * {fx.LONGEST_SQL} + 5) AS target FROM orders),
f AS (SELECT source_id, frame_ix * 2 AS pts FROM frames WHERE frame_ix % 3 > 0)
SELECT o_orderkey, t.source_id, min(pts) AS pts FROM t JOIN f ON f.source_id = t.source_id AND pts >= target GROUP BY ALL""")
def d12(spark, d):
    t = fx.table(spark, d, "orders").selectExpr(f"o_custkey % {fx.users(spark, d)} as source_id", "o_orderkey", f"o_orderkey % {2 * fx.longest(spark, d) + 5} as target")
    f = fx.frames(spark, d).where("frame_ix % 3 > 0").selectExpr("source_id", "frame_ix * 2 as pts")
    return j.first_frame_at_or_after(t, f, "target", "pts", 4096).select("o_orderkey", "source_id", "pts")


@query("d13_nearest_frame", with_sql(FRAMES_SQL) + f""", t AS (SELECT o_custkey % (SELECT count(DISTINCT user_id) FROM events) AS source_id, o_orderkey, o_orderkey % (5 * {fx.LONGEST_SQL} + 5) AS frame FROM orders),
f AS (SELECT source_id, frame_ix * 5 AS c FROM frames)
SELECT o_orderkey, t.source_id, arg_min(c, abs(c - frame) * 100000 + c) AS nearest FROM t JOIN f ON f.source_id = t.source_id AND abs(c - frame) <= 2 GROUP BY ALL""")
def d13(spark, d):
    t = fx.table(spark, d, "orders").selectExpr(f"o_custkey % {fx.users(spark, d)} as source_id", "o_orderkey", f"o_orderkey % {5 * fx.longest(spark, d) + 5} as frame")
    f = fx.frames(spark, d).selectExpr("source_id", "frame_ix * 5 as frame_ix")
    return j.nearest_frame(t, f, tolerance=2).select("o_orderkey", "source_id", "nearest")


@query("d14_pair_by_ordinal", with_sql(FRAMES_SQL) + """, a AS (SELECT source_id, frame_ix AS ordinal, feature FROM frames),
b AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY frame_ix) - 1 AS ordinal, feature FROM frames WHERE source_id % 2 = 0 OR frame_ix % 5 > 0),
m AS (SELECT source_id, (SELECT count(*) FROM a x WHERE x.source_id = s.source_id) <> (SELECT count(*) FROM b x WHERE x.source_id = s.source_id) AS mismatch FROM (SELECT DISTINCT source_id FROM a) s)
SELECT source_id, ordinal, a.feature AS l_feature, b.feature AS r_feature, mismatch AS count_mismatch FROM a FULL JOIN b USING (source_id, ordinal) JOIN m USING (source_id)""")
def d14(spark, d):
    from shotweave.operators.ordered import chunk_of
    a = fx.frames(spark, d).select("source_id", "frame_ix", "feature")
    b = a.where("source_id % 2 = 0 or frame_ix % 5 > 0")
    return j.pair_by_ordinal(a, b, ["source_id"], ["frame_ix"], ["frame_ix"], chunk_of("frame_ix"), chunk_of("frame_ix")).select(
        "source_id", "ordinal", "l_feature", "r_feature", "count_mismatch")


@query("d15_apply_relink_items", with_sql(ITEMS_SQL) + """, lim AS (SELECT p_partkey AS source_id, p_partkey % 700 AS nf, p_partkey % 4 > 0 AS hit FROM part),
x AS (SELECT i.*, CASE WHEN hit AND nf < 2000 + i.source_id % 5000 THEN nf - 1 END AS mx FROM items i LEFT JOIN lim USING (source_id))
SELECT timeline_id, item_ix, CASE WHEN source_in > mx THEN mx ELSE source_in END AS source_in,
 CASE WHEN source_in > mx OR source_out > mx THEN mx ELSE source_out END AS source_out, coalesce(source_in > mx OR source_out > mx, false) AS touched FROM x""")
def d15(spark, d):
    s = fx.sources(spark, d)
    new = s.where("source_id % 4 > 0").selectExpr("source_id", "concat('/new', file_path) as file_path", "source_id % 700 as total_frames")
    _, items = st.apply_relink(s, fx.items(spark, d), new)
    return items.select("timeline_id", "item_ix", "source_in", "source_out", "touched")


@query("d15_apply_relink_sources", with_sql(SOURCES_SQL) + """SELECT source_id, CASE WHEN source_id % 4 > 0 THEN '/new' || file_path ELSE file_path END AS file_path,
 CASE WHEN source_id % 4 > 0 THEN source_id % 700 ELSE total_frames END AS total_frames FROM sources""")
def d15s(spark, d):
    s = fx.sources(spark, d)
    new = s.where("source_id % 4 > 0").selectExpr("source_id", "concat('/new', file_path) as file_path", "source_id % 700 as total_frames")
    return st.apply_relink(s, fx.items(spark, d), new)[0].select("source_id", "file_path", "total_frames")


@query("d16_route_crops", with_sql(ITEMS_SQL, CROPS_SQL) + """SELECT crop_id, CASE WHEN group_id IS NULL THEN '/out/none' ELSE '/out/' || group_id END AS folder FROM crops
 WHERE group_id IS NULL OR (group_id < 25 AND group_id % 2 = 0)""")
def d16(spark, d):
    folders = fx.groups(spark, d).selectExpr("group_id", "case when group_id % 2 = 0 then concat('/out/', group_id) end as folder")
    extra = (fx.table(spark, d, "region").where("r_regionkey = 0").selectExpr("cast(null as bigint) as group_id", "'/out/none' as folder"))
    return j.route_crops(fx.crops(spark, d), folders.unionByName(extra)).select("crop_id", "folder")


@query("c7_validate_batch", """WITH f AS (SELECT p_size AS batch_id, p_partkey AS file_ix, 1920 AS width, 1080 AS height,
  CASE WHEN p_partkey % 41 = 0 THEN 25.0 WHEN p_partkey % 3 = 0 THEN 23.98 ELSE 23.976 END::DOUBLE AS fps FROM part),
r AS (SELECT *, first_value(fps) OVER (PARTITION BY batch_id ORDER BY file_ix) AS rf FROM f)
SELECT batch_id, file_ix, abs(fps - rf) <= 0.02 AS conforms, bool_and(abs(fps - rf) <= 0.02) OVER (PARTITION BY batch_id) AS accepted FROM r""")
def c7(spark, d):
    f = fx.table(spark, d, "part").selectExpr(
        "p_size as batch_id", "p_partkey as file_ix", "1920 as width", "1080 as height",
        "cast(case when p_partkey % 41 = 0 then 25.0 when p_partkey % 3 = 0 then 23.98 else 23.976 end as double) as fps")
    return st.validate_batch(f).select("batch_id", "file_ix", "conforms", "accepted")


NOW_SQL = "(SELECT max(ts) FROM events)"


def _now(spark, d):
    # a fixed clock for reproducible results: the newest event, as a scalar subquery
    return fx.table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp_ntz")).alias("now"))


@query("f12_retain_versions", with_sql(VERSIONS_SQL) + f""", r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, filename DESC) AS rk, {NOW_SQL} AS now FROM versions),
b AS (SELECT *, CASE WHEN rk <= 50 THEN 'newest' WHEN ts >= now - INTERVAL 1 DAY THEN 'h' || strftime(ts, '%Y-%m-%d_%H')
  WHEN ts >= now - INTERVAL 7 DAY THEN 'd' || strftime(ts, '%Y-%m-%d') ELSE 'w' || strftime(ts, '%G-%V') END AS reason FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY project_id, reason ORDER BY rk) AS br FROM b)
SELECT project_id, filename, reason FROM k WHERE reason = 'newest' OR br = 1""")
def f12(spark, d):
    kept = vs.retain_versions(fx.versions(spark, d), _now(spark, d).scalar())
    return kept.select("project_id", "filename", "reason")


@query("g1_newest_versions", with_sql(VERSIONS_SQL) + """SELECT project_id, filename, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, filename DESC)::INTEGER AS rank FROM versions) WHERE rank <= 50""")
def g1(spark, d):
    return vs.newest_versions(fx.versions(spark, d)).select("project_id", "filename", "rank")
