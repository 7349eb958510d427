"""Measurements on packets, frames, files and exports."""

from pyspark.sql import functions as F

from shotweave import fixtures as fx
from shotweave.fixtures import FRAMES_SQL, PACKETS_SQL, VECTORS_SQL, with_sql
from shotweave.operators import quality as ql
from shotweave.plans import export as ex
from shotweave.queries import query
from shotweave.queries.layout import BASE_PLAN
from shotweave.queries.scalars import EXACT_SQL

SRC_SQL = "src AS (SELECT DISTINCT user_id AS source_id, 24.0 + user_id % 3 AS fps, user_id % 90 AS total_frames, CASE WHEN user_id % 4 > 0 THEN user_id % 91 END AS nb_frames, (user_id % 2)::DOUBLE AS start_time FROM events)"


def src(spark, d):
    return fx.table(spark, d, "events").select("user_id").distinct().selectExpr(
        "user_id as source_id", "24.0D + user_id % 3 as fps", "user_id % 90 as total_frames",
        "case when user_id % 4 > 0 then user_id % 91 end as nb_frames", "cast(user_id % 2 as double) as start_time")


@query("e11_pts_jitter", with_sql(PACKETS_SQL, SRC_SQL) + """, g AS (SELECT source_id, pts_time - lag(pts_time) OVER (PARTITION BY source_id ORDER BY pts_ix) AS gap FROM packets)
SELECT source_id, count(*) AS n_packets, round(min(gap), 5) AS min_gap, round(max(gap), 5) AS max_gap, coalesce(max(gap) > 1.5 / any_value(fps), false) AS irregular,
 coalesce(any_value(nb_frames <> 0 AND nb_frames <> total_frames), false) AS count_mismatch, any_value(start_time > 0.000001) AS late_start FROM g JOIN src USING (source_id) GROUP BY source_id""")
def e11(spark, d):
    return ql.pts_jitter(fx.packets(spark, d), src(spark, d)).drop("nominal_gap").withColumns(
        {"min_gap": F.round("min_gap", 5), "max_gap": F.round("max_gap", 5)})


@query("e12_gop_stats", with_sql(PACKETS_SQL) + """, g AS (SELECT source_id, pts_time - lag(pts_time) OVER (PARTITION BY source_id ORDER BY pts_ix) AS gap FROM packets WHERE pict_type = 'I')
SELECT source_id, count(*) AS i_frames, round(avg(gap), 4) AS avg_sec, round(avg(gap) * 24.0, 3) AS avg_frames, round(max(gap), 5) AS max_sec FROM g GROUP BY source_id HAVING count(*) > 1""")
def e12(spark, d):
    return ql.gop_stats(fx.packets(spark, d)).select(
        "source_id", "i_frames", F.round("avg_sec", 4).alias("avg_sec"), F.round("avg_frames", 3).alias("avg_frames"), F.round("max_sec", 5).alias("max_sec"))


@query("e13_cache_inventory", "SELECT source AS category, count(*) AS n_files, sum(n_chars)::BIGINT AS n_bytes FROM documents GROUP BY ROLLUP (source)")
def e13(spark, d):
    return ql.cache_inventory(fx.table(spark, d, "documents").selectExpr("source as category", "n_chars as size_bytes"))


DUP_SQL = FRAMES_SQL + """, h AS (SELECT source_id, frame_ix, md5(props) AS hash, lag(md5(props)) OVER (PARTITION BY source_id ORDER BY frame_ix) AS p FROM frames)"""


def _dups(spark, d):
    return ql.duplicate_summary(fx.frames(spark, d), "props")


@query("e14_duplicate_summary", with_sql(DUP_SQL) + """SELECT source_id, count(*) AS n_frames, count(DISTINCT hash) AS n_unique, arg_min(hash, frame_ix) AS first_hash,
 count(*) FILTER (hash = p) AS n_repeats FROM h GROUP BY source_id""")
def e14(spark, d):
    return _dups(spark, d)[0]


@query("e14_duplicate_frames", with_sql(DUP_SQL) + "SELECT source_id, frame_ix, hash FROM h WHERE hash = p")
def e14f(spark, d):
    return _dups(spark, d)[1]


@query("e14_same_first_frame", with_sql(DUP_SQL) + """, f AS (SELECT source_id, arg_min(hash, frame_ix) AS first_hash FROM h GROUP BY source_id)
SELECT source_id, first_hash, count(*) OVER (PARTITION BY first_hash) AS n_outputs FROM f""")
def e14s(spark, d):
    return ql.same_first_frame(_dups(spark, d)[0])


@query("e15_cfr_check", with_sql(PACKETS_SQL) + """SELECT source_id, count(DISTINCT duration) AS n_durations, arg_min(duration, pts_ix)::BIGINT AS first_duration, arg_max(duration, pts_ix)::BIGINT AS last_duration,
 CASE WHEN count(DISTINCT duration) = 1 THEN 'pass' WHEN count(DISTINCT duration) = 2 AND arg_min(duration, pts_ix) <> arg_max(duration, pts_ix) THEN 'warn' ELSE 'fail' END AS verdict,
 abs((24.0 + source_id % 3 * 0.01) - 24.0)::DOUBLE / (24.0 + source_id % 3 * 0.01) < 0.001 AS rates_agree FROM packets GROUP BY source_id""")
def e15(spark, d):
    rates = src(spark, d).selectExpr("source_id", "24.0D + source_id % 3 * 0.01D as r_rate", "24.0D as avg_rate")
    return ql.cfr_check(fx.packets(spark, d), rates).select(
        "source_id", "n_durations", F.col("first_duration").cast("long").alias("first_duration"), F.col("last_duration").cast("long").alias("last_duration"), "verdict", "rates_agree")


@query("e16_audio_drift", BASE_PLAN + f""", e AS (SELECT timeline_id, count(*) AS n_segments, sum(frame_count)::BIGINT AS ef, sum({EXACT_SQL.format(n='frame_count')})::BIGINT AS expected_samples FROM plan GROUP BY timeline_id),
a AS (SELECT *, o_custkey % 100 - 40 AS dr FROM e JOIN orders ON o_orderkey = timeline_id)
SELECT timeline_id, n_segments, expected_samples, dr AS drift_samples, round(dr / 48.0, 6)::DOUBLE AS drift_ms, o_custkey % 3 AS frame_drift, abs(dr / 48.0) < 1 AS passed FROM a""")
def e16(spark, d):
    plan = ex.export_plan(fx.items(spark, d), fx.sources(spark, d), fx.timelines(spark, d))
    # actual = expected plus a known error, so that both branches of the verdict occur
    from shotweave.functions import expr as X
    exp = plan.groupBy("timeline_id").agg(F.sum("frame_count").alias("f"), F.sum(X.exact_samples("frame_count", "fps")).alias("s"))
    o = fx.table(spark, d, "orders").selectExpr("o_orderkey as timeline_id", "o_custkey")
    actual = exp.join(o, "timeline_id").selectExpr("timeline_id", "s + o_custkey % 100 - 40 as samples", "f + o_custkey % 3 as video_frames")
    return ql.audio_drift(plan, actual).drop("ms_per_segment").withColumn("drift_ms", F.round("drift_ms", 6))


@query("e17_brightness_check", with_sql(FRAMES_SQL) + """, b AS (SELECT source_id, frame_ix, feature / 2 AS a, CASE WHEN source_id % 2 = 0 THEN feature / 2 + 29.25 + source_id % 4 ELSE feature / 2 + (source_id + frame_ix) % (6 + source_id % 4) - 2.25 END AS b, source_id % 2 = 0 AS hdr FROM frames WHERE frame_ix % 3 > 0)
SELECT source_id AS output_id, count(*) AS n_frames, round(avg(b - a), 6) AS mean_delta, round(max(abs(b - a)), 6) AS max_abs_delta,
 CASE WHEN any_value(hdr) THEN round(avg(b) - avg(a), 6) > 30 ELSE round(max(abs(b - a)), 6) < 5 END AS passed FROM b GROUP BY source_id""")
def e17(spark, d):
    f = fx.frames(spark, d)
    before = f.selectExpr("source_id as output_id", "frame_ix", "feature / 2 as luma", "source_id % 2 = 0 as is_hdr")
    after = f.where("frame_ix % 3 > 0").selectExpr(
        "source_id as output_id", "frame_ix", "case when source_id % 2 = 0 then feature / 2 + 29.25D + source_id % 4 else feature / 2 + (source_id + frame_ix) % (6 + source_id % 4) - 2.25D end as luma")
    out = ql.brightness_check(before, after)
    return out.select("output_id", "n_frames", F.round("mean_delta", 6).alias("mean_delta"), F.round("max_abs_delta", 6).alias("max_abs_delta"), "passed")


@query("e18_alignment_offset", with_sql(FRAMES_SQL) + """, o AS (SELECT source_id, frame_ix, lead(feature, (frame_ix % 3)::INT) OVER (PARTITION BY source_id ORDER BY frame_ix) AS feature FROM frames),
p AS (SELECT source_id, frame_ix, feature, unnest([0, -1, 1, 2]) AS off, unnest([0, 1, 2, 3]) AS rk FROM o WHERE feature IS NOT NULL),
m AS (SELECT p.*, abs(p.feature - f.feature) AS diff FROM p JOIN frames f ON f.source_id = p.source_id AND f.frame_ix = p.frame_ix + off)
SELECT source_id, frame_ix, off AS best_offset, round(diff, 6) AS best_diff, off = 0 AS aligned FROM (SELECT *, row_number() OVER (PARTITION BY source_id, frame_ix ORDER BY diff, rk) AS rn FROM m) WHERE rn = 1""")
def e18(spark, d):
    f = fx.frames(spark, d).select("source_id", "frame_ix", "feature")
    # an output frame shows the source 0, 1 or 2 frames later
    shown = f.selectExpr("source_id", "frame_ix as shown", "feature", "explode(array(0, 1, 2)) as late").selectExpr("source_id", "shown - late as frame_ix", "late", "feature")
    out = shown.where("frame_ix >= 0 and frame_ix % 3 = late").selectExpr("concat(source_id, '/', frame_ix) as output_id", "source_id", "frame_ix", "feature")
    return ql.alignment_offset(out, f).select("source_id", "frame_ix", "best_offset", F.round("best_diff", 6).alias("best_diff"), "aligned")


@query("e18_alignment_vectors", with_sql(VECTORS_SQL) + """, e AS (SELECT source_id, frame_ix, generate_subscripts(feature, 1) AS i, unnest(feature)::DOUBLE AS v FROM frame_vectors),
m AS (SELECT a.source_id, a.frame_ix, o.off, o.rk, avg(abs(a.v - b.v)) AS diff FROM e a, (SELECT unnest([0, -1, 1, 2]) AS off, unnest([0, 1, 2, 3]) AS rk) o, e b WHERE b.source_id = a.source_id AND b.i = a.i AND b.frame_ix = a.frame_ix + o.off GROUP BY ALL)
SELECT source_id, frame_ix, arg_min(off, diff * 1000000 + rk) AS best_offset FROM m GROUP BY ALL""")
def e18v(spark, d):
    v = fx.frame_vectors(spark, d)
    out = v.selectExpr("concat(source_id, '/', frame_ix) as output_id", "source_id", "frame_ix", "feature")
    return ql.alignment_offset(out, v, "vector").select("source_id", "frame_ix", "best_offset")


@query("g4_first_mismatches", with_sql(DUP_SQL) + """, m AS (SELECT source_id % 5 AS grp, source_id, frame_ix FROM h WHERE hash = p)
SELECT grp, source_id, frame_ix, rank, greatest(n - 10, 0) AS n_more FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY source_id, frame_ix)::INTEGER AS rank, count(*) OVER (PARTITION BY grp) AS n FROM m) WHERE rank <= 10""")
def g4(spark, d):
    m = _dups(spark, d)[1].selectExpr("source_id % 5 as grp", "source_id", "frame_ix")
    return ql.first_mismatches(m, ["grp"], ["source_id", "frame_ix"])
