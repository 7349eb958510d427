"""Shot detection and thumbnail planning."""

from pyspark.sql import functions as F

from shotweave import fixtures as fx
from shotweave.fixtures import FRAMES_SQL, ITEMS_SQL, SCORES_SQL, SOURCES_SQL, TIMELINES_SQL, VECTORS_SQL, with_sql
from shotweave.operators import detect as dt
from shotweave.plans import detection as pd_, thumbs as th
from shotweave.queries import query
from shotweave.session import materialize
from shotweave.queries.layout import BASE, RANGED_SQL

DIFF_SQL = FRAMES_SQL + """, diffs AS (SELECT source_id, frame_ix, abs(feature - lag(feature) OVER w) AS diff, lag(frame_ix) OVER w AS prev_ix FROM frames
 WINDOW w AS (PARTITION BY source_id ORDER BY frame_ix))"""


@query("f3_detect_cuts_diff", with_sql(DIFF_SQL) + "SELECT source_id, frame_ix, round(diff, 6) AS diff FROM diffs WHERE diff > 100")
def f3(spark, d):
    return dt.detect_cuts_diff(fx.frames(spark, d), 100.0).select("source_id", "frame_ix", F.round("diff", 6).alias("diff"))


@query("f3_detect_cuts_vectors", with_sql(VECTORS_SQL) + """, p AS (SELECT *, lag(feature) OVER (PARTITION BY source_id ORDER BY frame_ix) AS pf FROM frame_vectors),
e AS (SELECT source_id, frame_ix, unnest(feature)::DOUBLE AS a, unnest(pf)::DOUBLE AS b FROM p WHERE pf IS NOT NULL)
SELECT source_id, frame_ix FROM e GROUP BY ALL HAVING avg(abs(a - b)) > 0.14""")
def f3v(spark, d):
    return dt.detect_cuts_diff(fx.frame_vectors(spark, d), 0.14, kind="vector").select("source_id", "frame_ix")


@query("f5_detect_cuts_score", with_sql(SCORES_SQL) + "SELECT source_id, frame_ix, round(score, 6) AS score FROM frame_scores WHERE score > 0.5")
def f5(spark, d):
    return dt.detect_cuts_score(fx.frame_scores(spark, d)).withColumn("score", F.round("score", 6))


# overlapping segments over the whole length of each source, cut by the scalar feature
SEGS_SQL = "segs AS (SELECT source_id % 7 AS timeline_id, source_id || '/' || k AS clip_id, source_id, 20 * k AS source_in, 20 * k + 29 + source_id % 9 AS source_out FROM (SELECT source_id, unnest(range(0, max(frame_ix) // 20 + 1)) AS k FROM frames GROUP BY source_id))"


def segs(frames):
    return frames.groupBy("source_id").agg(F.max("frame_ix").alias("mx")).selectExpr("source_id", "explode(sequence(0L, mx div 20)) as k").selectExpr(
        "source_id % 7 as timeline_id", "concat(source_id, '/', k) as clip_id", "source_id", "20 * k as source_in", "20 * k + 29 + source_id % 9 as source_out")


SHOTS_SQL = """bounds AS (SELECT timeline_id, clip_id, source_id, source_in, source_out, source_in AS b FROM segs
 UNION SELECT s.timeline_id, s.clip_id, s.source_id, source_in, source_out, cut + {shift} FROM segs s JOIN cuts c ON c.clip_id = s.clip_id
  WHERE cut + {shift} > source_in AND cut + {shift} <= source_out)
SELECT timeline_id, clip_id, source_id, row_number() OVER w - 1 AS sub_ix, b AS source_in, coalesce(lead(b) OVER w - 1, source_out) AS source_out
 FROM bounds WINDOW w AS (PARTITION BY timeline_id, clip_id ORDER BY b)"""
CUTS_SQL = "cuts AS (SELECT clip_id, frame_ix AS cut FROM diffs d JOIN segs s ON s.source_id = d.source_id AND frame_ix <= source_out AND prev_ix >= source_in WHERE diff > 100)"


def _shots(spark, d, convention):
    f = fx.frames(spark, d)
    s = segs(f)
    return dt.cuts_to_shots(dt.cuts_in_segments(dt.detect_cuts_diff(f, 100.0), s, width=16), s, convention)


@query("f4_cuts_to_shots", with_sql(DIFF_SQL, SEGS_SQL, CUTS_SQL, SHOTS_SQL.format(shift=1)))
def f4(spark, d):
    return _shots(spark, d, "last")


@query("f4_cuts_to_shots_first_frame", with_sql(DIFF_SQL, SEGS_SQL, CUTS_SQL, SHOTS_SQL.format(shift=0)))
def f4b(spark, d):
    return _shots(spark, d, "first")


@query("f6_score_windows", with_sql(FRAMES_SQL, SEGS_SQL.replace("20 * k + 29 + source_id % 9", "20 * k + 70 + source_id % 300")) + """,
n AS (SELECT source_id, max(frame_ix) AS mx FROM frames GROUP BY source_id),
s2 AS (SELECT timeline_id, clip_id, source_id, source_in, least(source_out, mx) AS source_out FROM segs JOIN n USING (source_id) WHERE source_in <= mx)
SELECT s.timeline_id, s.clip_id, f.frame_ix, round(coalesce(abs(g.feature - f.feature), 0) / 255.0::DOUBLE, 6) AS score
 FROM s2 s JOIN frames f ON f.source_id = s.source_id AND f.frame_ix BETWEEN source_in AND source_out
 LEFT JOIN frames g ON g.source_id = s.source_id AND g.frame_ix = least(f.frame_ix + 1, source_out)""")
def f6(spark, d):
    f = fx.frames(spark, d)
    s = f.groupBy("source_id").agg(F.max("frame_ix").alias("mx")).selectExpr("source_id", "mx", "explode(sequence(0L, mx div 20)) as k").selectExpr(
        "source_id % 7 as timeline_id", "concat(source_id, '/', k) as clip_id", "source_id", "20 * k as source_in",
        "least(20 * k + 70 + source_id % 300, mx) as source_out").where("source_in <= source_out")
    return dt.score_windows(f, s).select("timeline_id", "clip_id", "frame_ix", F.round("score", 6).alias("score"))


RANGES_SQL = "r AS (SELECT l_orderkey AS clip_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS range_ix, (l_quantity * l_linenumber)::BIGINT AS end_ix, l_suppkey % 4 AS label, 200 AS total_frames FROM lineitem)"


def ranges(spark, d):
    return fx.items(spark, d).selectExpr("timeline_id as clip_id", "item_ix - 1 as range_ix", "dur * l_linenumber as end_ix", "l_suppkey % 4 as label", "200 as total_frames")


@query("f7_ranges_to_cuts_hard", "WITH " + RANGES_SQL + """, n AS (SELECT *, lead(label) OVER (PARTITION BY clip_id ORDER BY range_ix) AS nl FROM r)
SELECT clip_id, end_ix - 1 AS cut FROM n WHERE nl = 1 AND end_ix - 1 >= 0 AND end_ix - 1 < total_frames - 1""")
def f7(spark, d):
    return dt.ranges_to_cuts(ranges(spark, d), ["clip_id"], True)


@query("f7_ranges_to_cuts_all", "WITH " + RANGES_SQL + """, n AS (SELECT *, lead(label) OVER (PARTITION BY clip_id ORDER BY range_ix) AS nl FROM r)
SELECT clip_id, end_ix - 1 AS cut FROM n WHERE nl IS NOT NULL AND end_ix - 1 >= 0 AND end_ix - 1 < total_frames - 1""")
def f7b(spark, d):
    return dt.ranges_to_cuts(ranges(spark, d), ["clip_id"], False)


@query("f8_scan_ranges", "WITH " + RANGES_SQL + """, m AS (SELECT *, coalesce(max(end_ix) OVER (PARTITION BY clip_id ORDER BY range_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ix FROM r)
SELECT clip_id, range_ix AS query_ix, start_ix, end_ix FROM m WHERE end_ix > start_ix AND start_ix < 60""")
def f8(spark, d):
    p = ranges(spark, d).selectExpr("clip_id", "range_ix as query_ix", "end_ix", "60 as usable")
    return dt.scan_ranges(p, ["clip_id"]).select("clip_id", "query_ix", "start_ix", "end_ix")


SEGMENTS_K4 = """k4 AS (SELECT timeline_id, item_ix, clip_id, source_id, source_in, source_out, source_in + eff_start - tl_start AS seg_in, source_in + eff_end - tl_start AS seg_out FROM ranged WHERE source_id IS NOT NULL)"""


@query("k4_detect_segments", BASE + ", " + SEGMENTS_K4 + """
SELECT timeline_id, item_ix, source_id, seg_in, seg_out, CASE WHEN seg_in > source_in THEN source_in END AS prefix_in, CASE WHEN seg_in > source_in THEN seg_in - 1 END AS prefix_out,
 CASE WHEN seg_out < source_out THEN seg_out + 1 END AS suffix_in, CASE WHEN seg_out < source_out THEN source_out END AS suffix_out FROM k4""")
def k4(spark, d):
    return pd_.detect_segments(fx.items(spark, d), fx.timelines(spark, d)).drop("clip_id")


@query("e10_detect_summary", BASE + ", " + SEGMENTS_K4 + "SELECT count(DISTINCT source_id) AS n_sources, count(*) AS n_segments, sum(seg_out - seg_in + 1)::BIGINT AS n_frames FROM k4")
def e10(spark, d):
    return dt.detect_summary(pd_.as_segments(pd_.detect_segments(fx.items(spark, d), fx.timelines(spark, d))))


# items whose sources are the event users, so that their frames exist
K5_ITEMS = ITEMS_SQL.replace("THEN l_partkey END AS source_id", "THEN l_partkey % (SELECT count(DISTINCT user_id) FROM events) END AS source_id").replace("THEN 7 * l_suppkey ELSE", "THEN l_suppkey % 40 ELSE")
K5_SQL = with_sql(K5_ITEMS, TIMELINES_SQL, RANGED_SQL, "{frames}", SEGMENTS_K4) + """, hits AS (SELECT k4.timeline_id, k4.item_ix, seg_in, seg_out, {cut} + 1 AS b FROM k4 JOIN {table} c ON c.source_id = k4.source_id AND c.frame_ix <= seg_out AND {inside}),
piece AS (SELECT timeline_id, item_ix, source_id, seg_in AS b, seg_out AS e FROM k4
 UNION SELECT timeline_id, item_ix, source_id, b, seg_out FROM hits JOIN (SELECT timeline_id, item_ix, source_id FROM k4) USING (timeline_id, item_ix) WHERE b > seg_in AND b <= seg_out),
shots AS (SELECT timeline_id, item_ix, source_id, b AS source_in, coalesce(lead(b) OVER (PARTITION BY timeline_id, item_ix ORDER BY b) - 1, e) AS source_out FROM piece),
parts AS (SELECT * FROM shots UNION ALL SELECT timeline_id, item_ix, source_id, source_in, seg_in - 1 FROM k4 WHERE seg_in > source_in
 UNION ALL SELECT timeline_id, item_ix, source_id, seg_out + 1, source_out FROM k4 WHERE seg_out < source_out),
u AS (SELECT *, true AS new FROM parts UNION ALL SELECT timeline_id, item_ix, source_id, source_in, source_out, false FROM items i WHERE NOT EXISTS (SELECT 1 FROM k4 WHERE k4.timeline_id = i.timeline_id AND k4.item_ix = i.item_ix))
SELECT timeline_id, row_number() OVER w AS item_ix, source_id, source_in, source_out,
 CASE WHEN new THEN (coalesce(sum(new::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 8 ELSE 0 END::INTEGER AS color_index FROM u
 WINDOW w AS (PARTITION BY timeline_id ORDER BY item_ix, source_in)"""


def k5_items(spark, d):
    it = fx.items(spark, d)
    return materialize(it.selectExpr("timeline_id", "item_ix", "clip_id", f"source_id % {fx.users(spark, d)} as source_id", "case when source_id is null then 0 else l_suppkey % 40 end as source_in",
                         "case when source_id is null then 0 else l_suppkey % 40 end + dur - 1 as source_out", "label", "color_index", "group_ids"))


@query("k5_detect_shots_diff", K5_SQL.format(frames=DIFF_SQL, cut="c.frame_ix", table="diffs", inside="prev_ix >= seg_in AND diff > 100"))
def k5(spark, d):
    return pd_.detect_shots(k5_items(spark, d), fx.timelines(spark, d), fx.frames(spark, d), threshold=100.0).select(
        "timeline_id", "item_ix", "source_id", "source_in", "source_out", "color_index")


@query("k5_detect_shots_score", K5_SQL.format(frames=SCORES_SQL, cut="c.frame_ix", table="frame_scores", inside="c.frame_ix >= seg_in AND score > 0.5"))
def k5s(spark, d):
    return pd_.detect_shots(k5_items(spark, d), fx.timelines(spark, d), fx.frame_scores(spark, d), "score").select(
        "timeline_id", "item_ix", "source_id", "source_in", "source_out", "color_index")


@query("h6_reattach_partials", BASE + ", " + SEGMENTS_K4 + """SELECT timeline_id, clip_id, -1::BIGINT AS sub_ix, source_in, seg_in - 1 AS source_out FROM k4 WHERE seg_in > source_in
 UNION ALL SELECT timeline_id, clip_id, 0, seg_in, seg_out FROM k4 UNION ALL SELECT timeline_id, clip_id, 1099511627776, seg_out + 1, source_out FROM k4 WHERE seg_out < source_out""")
def h6(spark, d):
    s = pd_.detect_segments(fx.items(spark, d), fx.timelines(spark, d))
    whole = pd_.as_segments(s).withColumn("sub_ix", F.lit(0).cast("long"))
    return pd_.reattach_partials(whole, s).select("timeline_id", "clip_id", "sub_ix", "source_in", "source_out")


@query("h1_inspection_frames", with_sql(SCORES_SQL) + """, t AS (SELECT source_id, max(frame_ix) + 1 AS n FROM frames GROUP BY source_id), c AS (SELECT * FROM frame_scores WHERE score > 0.5)
SELECT source_id, frame FROM (SELECT source_id, n, frame_ix + unnest([-2, -1, 0, 1, 2]) AS frame FROM c JOIN t USING (source_id)) WHERE frame >= 0 AND frame < n
UNION SELECT source_id, 0 FROM t UNION SELECT source_id, n - 1 FROM t""")
def h1(spark, d):
    s = fx.frame_scores(spark, d)
    totals = s.groupBy("source_id").agg((F.max("frame_ix") + 1).alias("total_frames"))
    return dt.inspection_frames(dt.detect_cuts_score(s), totals)


TARGETS_SQL = BASE + """, cached AS (SELECT DISTINCT l_partkey AS source_id, 7 * l_suppkey AS frame FROM lineitem WHERE l_linenumber = 3),
tg AS (SELECT source_id, source_in AS frame FROM ranged WHERE source_id IS NOT NULL UNION SELECT source_id, source_out FROM ranged WHERE source_id IS NOT NULL)"""


def cached(spark, d):
    return fx.table(spark, d, "lineitem").where("l_linenumber = 3").selectExpr("l_partkey as source_id", "7 * l_suppkey as frame")


@query("h2_thumbnail_targets", TARGETS_SQL + "SELECT * FROM tg ANTI JOIN cached USING (source_id, frame)")
def h2(spark, d):
    return th.thumbnail_targets(fx.items(spark, d), fx.timelines(spark, d), cached(spark, d))


RUNS_SQL = """f0 AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY source_id ORDER BY frame) <= 400 THEN 0 ELSE 1 END AS nw FROM {t}),
f1 AS (SELECT *, (sum(nw) OVER (PARTITION BY source_id ORDER BY frame))::BIGINT - 1 AS run_id FROM f0),
f2 AS (SELECT *, (row_number() OVER (PARTITION BY source_id, run_id ORDER BY frame) - 1) // 16 AS chunk_id FROM f1)"""


@query("f11_frame_runs", with_sql("tg AS (SELECT DISTINCT l_suppkey % 10 AS source_id, (l_orderkey * 37) % 60000 * 11 AS frame FROM lineitem)", RUNS_SQL.format(t="tg")) + "SELECT source_id, frame, run_id, chunk_id FROM f2")
def f11(spark, d):
    t = fx.table(spark, d, "lineitem").selectExpr("l_suppkey % 10 as source_id", "(l_orderkey * 37) % 60000 * 11 as frame").distinct()
    return th.frame_runs(t)


@query("k6_thumbnail_plan", TARGETS_SQL + """, want AS (SELECT t.source_id, frame, CASE WHEN codec = 'h264' AND width < 3000 AND height < 1800 THEN 'light' ELSE 'heavy' END AS media_class
  FROM (SELECT * FROM tg ANTI JOIN cached USING (source_id, frame)) t JOIN sources USING (source_id)),
light AS (SELECT * FROM want WHERE media_class = 'light'), """ + RUNS_SQL.format(t="light") + """
SELECT source_id, media_class, NULL::BIGINT AS run_id, NULL::BIGINT AS chunk_id, frame AS first_frame, frame AS last_frame, 1::BIGINT AS n_frames FROM want WHERE media_class = 'heavy'
UNION ALL SELECT source_id, media_class, run_id, chunk_id, min(frame), max(frame), count(*) FROM f2 GROUP BY ALL""")
def k6(spark, d):
    return th.thumbnail_plan(fx.items(spark, d), fx.sources(spark, d), fx.timelines(spark, d), cached(spark, d))
