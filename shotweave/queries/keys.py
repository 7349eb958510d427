"""Keyframe sampling and key edits."""

from pyspark.sql import functions as F

from shotweave import fixtures as fx
from shotweave.fixtures import KEYFRAMES_SQL, with_sql
from shotweave.operators import keyframes as kf
from shotweave.queries import query

# no bezier keys: its inversion is iterative, so the twin covers the other rules
PLAIN_SQL = KEYFRAMES_SQL.replace("THEN 'bezier' ELSE", "THEN 'linear' ELSE")


def plain(spark, d):
    return fx.keyframes(spark, d).withColumn("interp", F.when(F.col("interp") == "bezier", "linear").otherwise(F.col("interp")))


POINTS_SQL = "pts AS (SELECT DISTINCT o_custkey % ((SELECT count(DISTINCT user_id) FROM events) + 10) AS crop_id, (o_orderkey * 7) % 800 - 20 AS frame FROM orders)"


def points(spark, d):
    return fx.table(spark, d, "orders").selectExpr(f"o_custkey % {fx.users(spark, d) + 10} as crop_id", "(o_orderkey * 7) % 800 - 20 as frame").distinct()


SAMPLE_SQL = """kk AS (SELECT *, lead(source_frame) OVER w AS nf, lead(value) OVER w AS nv, lead(interp) OVER w AS ni FROM keyframes WINDOW w AS (PARTITION BY crop_id, axis ORDER BY source_frame)),
ext AS (SELECT crop_id, axis, min(source_frame) AS f0, max(source_frame) AS f1, arg_min(value, source_frame) AS v0, arg_max(value, source_frame) AS v1 FROM keyframes GROUP BY crop_id, axis),
samp AS (SELECT p.crop_id, e.axis, p.frame, CASE WHEN frame <= f0 THEN v0 WHEN frame >= f1 THEN v1 WHEN k.interp = 'step' THEN k.value
   ELSE k.value + (k.nv - k.value) * ((frame - k.source_frame)::DOUBLE / (k.nf - k.source_frame)) END AS value
 FROM pts p JOIN ext e ON e.crop_id = p.crop_id LEFT JOIN kk k ON k.crop_id = e.crop_id AND k.axis = e.axis AND k.source_frame < p.frame AND p.frame <= k.nf)"""


@query("f16_key_pairs", with_sql(KEYFRAMES_SQL) + """SELECT crop_id, axis, source_frame, lead(source_frame) OVER w AS next_frame, lead(value) OVER w AS next_value
 FROM keyframes WINDOW w AS (PARTITION BY crop_id, axis ORDER BY source_frame)""")
def f16(spark, d):
    return kf.key_pairs(fx.keyframes(spark, d)).select("crop_id", "axis", "source_frame", F.col("next_key.source_frame").alias("next_frame"), F.col("next_key.value").alias("next_value"))


@query("j1_sample_tracks", with_sql(PLAIN_SQL, POINTS_SQL, SAMPLE_SQL) + "SELECT crop_id, axis, frame, round(value, 6) AS value FROM samp")
def j1(spark, d):
    return kf.sample_tracks(plain(spark, d), points(spark, d)).withColumn("value", F.round("value", 6))


def _cubic(a: str, b: str, c: str, d: str) -> str:
    return f"((1 - u) * (1 - u) * (1 - u) * {a} + 3.0::DOUBLE * (1 - u) * (1 - u) * u * {b} + 3.0::DOUBLE * (1 - u) * u * u * {c} + u * u * u * {d})"


# eight chained Newton steps, as common table expressions
BEZIER_SQL = SAMPLE_SQL[:SAMPLE_SQL.index("samp AS")] + """s0 AS (SELECT *, (t - ax) / greatest(1e-9::DOUBLE, dx - ax) AS u, false AS flat FROM (
 SELECT p.crop_id, e.axis, p.frame, CASE WHEN p.frame <= f0 THEN v0 WHEN p.frame >= f1 THEN v1 WHEN k.interp = 'step' THEN k.value
   WHEN k.interp <> 'bezier' AND k.ni <> 'bezier' THEN k.value + (k.nv - k.value) * ((p.frame - k.source_frame)::DOUBLE / (k.nf - k.source_frame)) END AS plain,
  k.source_frame::DOUBLE AS ax, k.source_frame::DOUBLE + 0.6::DOUBLE AS bx, k.nf::DOUBLE + -0.4::DOUBLE AS cx, k.nf::DOUBLE AS dx,
  k.value AS ay, k.value + -5.0::DOUBLE AS by_, k.nv + 3.0::DOUBLE AS cy, k.nv AS dy, p.frame::DOUBLE AS t
 FROM pts p JOIN ext e ON e.crop_id = p.crop_id LEFT JOIN kk k ON k.crop_id = e.crop_id AND k.axis = e.axis AND k.source_frame < p.frame AND p.frame <= k.nf))""" + "".join(f""",
s{k} AS (SELECT * EXCLUDE (u, flat, slope), CASE WHEN flat OR abs(slope) < 1e-6 THEN u ELSE least(greatest(u - ({_cubic("ax", "bx", "cx", "dx")} - t) / slope, 0), 1) END AS u,
  flat OR abs(slope) < 1e-6 AS flat
 FROM (SELECT *, 3.0::DOUBLE * (1 - u) * (1 - u) * (bx - ax) + 6.0::DOUBLE * (1 - u) * u * (cx - bx) + 3.0::DOUBLE * u * u * (dx - cx) AS slope FROM s{k - 1}))""" for k in range(1, kf.NEWTON_STEPS + 1))


@query("j2_sample_bezier", with_sql(KEYFRAMES_SQL, POINTS_SQL, BEZIER_SQL) + f"""SELECT crop_id, axis, frame, round(coalesce(plain, {_cubic("ay", "by_", "cy", "dy")}), 6) AS value
 FROM (SELECT * REPLACE (CASE WHEN t <= ax THEN 0 WHEN t >= dx THEN 1 ELSE u END AS u) FROM s{kf.NEWTON_STEPS})""")
def j2(spark, d):
    k = fx.keyframes(spark, d).withColumns({"in_dx": F.lit(-0.4), "in_dy": F.lit(3.0), "out_dx": F.lit(0.6), "out_dy": F.lit(-5.0)})
    return kf.sample_tracks(k, points(spark, d)).withColumn("value", F.round("value", 6))


BASE_SQL = """base AS (SELECT s_suppkey AS crop_id, s_suppkey AS x, s_suppkey + 1 AS y, 200 + s_suppkey AS w, 100 + s_suppkey AS h,
 CASE s_suppkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN '16:9' ELSE '3:4' END AS ar FROM supplier)"""


def base(spark, d):
    return fx.table(spark, d, "supplier").selectExpr(
        "s_suppkey as crop_id", "s_suppkey as x", "s_suppkey + 1 as y", "200 + s_suppkey as w", "100 + s_suppkey as h",
        "case s_suppkey % 3 when 0 then 'free' when 1 then '16:9' else '3:4' end as aspect_ratio", "0L as custom_ratio_w", "0L as custom_ratio_h")


def some_keys(k):
    return k.where("crop_id % 4 > 0 and (axis <> 'h' or crop_id % 5 > 0)")


@query("j3_sample_crops", with_sql(PLAIN_SQL.replace("FROM events)) WHERE rn = 1", "FROM events)) WHERE rn = 1 AND crop_id % 4 > 0 AND (axis <> 'h' OR crop_id % 5 > 0)"), POINTS_SQL, SAMPLE_SQL, BASE_SQL) + """,
pv AS (SELECT crop_id, frame, max(CASE WHEN axis = 'x' THEN value END) AS sx, max(CASE WHEN axis = 'y' THEN value END) AS sy, max(CASE WHEN axis = 'w' THEN value END) AS sw, max(CASE WHEN axis = 'h' THEN value END) AS sh FROM samp GROUP BY ALL)
SELECT b.crop_id, p.frame, round_even(coalesce(sx, x), 0)::BIGINT AS x, round_even(coalesce(sy, y), 0)::BIGINT AS y, round_even(coalesce(sw, w), 0)::BIGINT AS w,
 round_even(CASE ar WHEN 'free' THEN coalesce(sh, h) WHEN '16:9' THEN coalesce(sw, w) * 9 / 16 ELSE coalesce(sw, w) * 4 / 3 END, 0)::BIGINT AS h
 FROM pts p JOIN base b USING (crop_id) LEFT JOIN pv ON pv.crop_id = p.crop_id AND pv.frame = p.frame""")
def j3(spark, d):
    return kf.sample_crops(base(spark, d), some_keys(plain(spark, d)), points(spark, d))


@query("j7_is_animated", with_sql(KEYFRAMES_SQL, BASE_SQL) + "SELECT crop_id, crop_id IN (SELECT crop_id FROM keyframes WHERE crop_id % 4 > 0) AS animated FROM base")
def j7(spark, d):
    return kf.is_animated(base(spark, d), some_keys(fx.keyframes(spark, d))).select("crop_id", "animated")


@query("h5_keys_in_windows", with_sql(KEYFRAMES_SQL) + """, w AS (SELECT o_custkey % ((SELECT count(DISTINCT user_id) FROM events) + 10) AS crop_id, o_orderkey AS window_id, o_orderkey % 700 AS lo, o_orderkey % 700 + o_custkey % 40 AS hi FROM orders)
SELECT DISTINCT w.crop_id, window_id, source_frame AS key_frame FROM w JOIN keyframes k ON k.crop_id = w.crop_id AND source_frame >= lo AND source_frame < hi""")
def h5(spark, d):
    w = fx.table(spark, d, "orders").selectExpr(f"o_custkey % {fx.users(spark, d) + 10} as crop_id", "o_orderkey as window_id", "o_orderkey % 700 as lo", "o_orderkey % 700 + o_custkey % 40 as hi")
    return kf.keys_in_windows(fx.keyframes(spark, d), w, width=64).select("crop_id", "window_id", "key_frame")


# edits: several per slot, the highest order key wins
SETS_SQL = """sets AS (SELECT o_custkey % (SELECT count(DISTINCT user_id) FROM events) AS crop_id, CASE o_orderkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'y' WHEN 2 THEN 'w' ELSE 'h' END AS axis, o_orderkey % 720 AS source_frame,
 (o_custkey % 90)::DOUBLE AS nv, CASE WHEN o_custkey % 2 = 0 THEN 'linear' ELSE 'step' END AS ni, o_orderkey AS seq FROM orders)"""


def sets(spark, d):
    return fx.table(spark, d, "orders").selectExpr(
        f"o_custkey % {fx.users(spark, d)} as crop_id", "case o_orderkey % 4 when 0 then 'x' when 1 then 'y' when 2 then 'w' else 'h' end as axis", "o_orderkey % 720 as source_frame",
        "cast(o_custkey % 90 as double) as value", "case when o_custkey % 2 = 0 then 'linear' else 'step' end as interp", "o_orderkey as edit_seq")


def handled(spark, d):
    return fx.keyframes(spark, d).withColumns({"in_dx": F.lit(-1.0), "in_dy": F.lit(2.0), "out_dx": F.lit(1.0), "out_dy": F.lit(3.0)})


@query("i14_upsert_keys", with_sql(KEYFRAMES_SQL, SETS_SQL) + """, s AS (SELECT crop_id, axis, source_frame, arg_max(nv, seq) AS nv, arg_max(ni, seq) AS ni, min(ni) AS lo, max(ni) AS hi FROM sets GROUP BY ALL)
SELECT crop_id, axis, source_frame, coalesce(nv, value) AS value, coalesce(ni, interp) AS interp,
 CASE WHEN value IS NULL THEN 0.0 WHEN nv IS NULL OR (lo = interp AND hi = interp) THEN -1.0 ELSE 0.0 END::DOUBLE AS in_dx
 FROM keyframes FULL JOIN s USING (crop_id, axis, source_frame)""")
def i14(spark, d):
    return kf.upsert_keys(handled(spark, d), sets(spark, d)).select("crop_id", "axis", "source_frame", "value", "interp", "in_dx")


@query("i14_delete_keys", with_sql(KEYFRAMES_SQL, SETS_SQL) + "SELECT crop_id, axis, source_frame, value FROM keyframes ANTI JOIN sets USING (crop_id, axis, source_frame)")
def i14d(spark, d):
    return kf.delete_keys(fx.keyframes(spark, d), sets(spark, d)).select("crop_id", "axis", "source_frame", "value")


@query("i14_move_keys", with_sql(KEYFRAMES_SQL) + """, mv AS (SELECT *, source_frame + 1 + source_frame % 5 AS nf, crop_id * 1000 + source_frame AS seq FROM keyframes WHERE source_frame % 3 = 0),
la AS (SELECT crop_id, axis, nf AS source_frame, arg_max(value + 1, seq) AS value, arg_max(interp, seq) AS interp FROM mv GROUP BY ALL)
SELECT * FROM la UNION ALL SELECT crop_id, axis, source_frame, value, interp FROM keyframes WHERE source_frame % 3 <> 0 AND (crop_id, axis, source_frame) NOT IN (SELECT (crop_id, axis, source_frame) FROM la)""")
def i14m(spark, d):
    k = fx.keyframes(spark, d)
    moves = k.where("source_frame % 3 = 0").selectExpr(
        "crop_id", "axis", "source_frame as old_frame", "source_frame + 1 + source_frame % 5 as new_frame", "value + 1 as new_value", "crop_id * 1000 + source_frame as edit_seq")
    return kf.move_keys(k, moves).select("crop_id", "axis", "source_frame", "value", "interp")


@query("i14_shape_keys", with_sql(KEYFRAMES_SQL) + """SELECT crop_id, axis, source_frame, CASE WHEN source_frame % 3 = 0 THEN 'bezier' ELSE interp END AS interp,
 CASE WHEN source_frame % 3 = 0 THEN 4.0 WHEN source_frame % 3 = 1 THEN 9.0 ELSE -1.0 END::DOUBLE AS in_dx, CASE WHEN source_frame % 3 = 0 THEN 0.0 ELSE 2.0 END::DOUBLE AS in_dy FROM keyframes""")
def i14s(spark, d):
    k = handled(spark, d)
    e = k.where("source_frame % 3 < 2").selectExpr(
        "crop_id", "axis", "source_frame", "case when source_frame % 3 = 0 then 'bezier' end as interp",
        "case when source_frame % 3 = 0 then 4.0D else 9.0D end as in_dx", "cast(null as double) as in_dy", "cast(null as double) as out_dx", "cast(null as double) as out_dy", "1 as edit_seq")
    return kf.shape_keys(k, e).select("crop_id", "axis", "source_frame", "interp", "in_dx", "in_dy")


@query("i14_pair_interp", with_sql(KEYFRAMES_SQL) + """SELECT crop_id, axis, source_frame, CASE WHEN source_frame % 2 = 0 AND axis IN ('w', 'h') AND crop_id % 3 = 0 THEN 'bezier' ELSE interp END AS interp FROM keyframes""")
def i14p(spark, d):
    k = fx.keyframes(spark, d)
    e = k.where("source_frame % 2 = 0 and crop_id % 3 = 0").select("crop_id", "source_frame").distinct().selectExpr(
        "crop_id", "'size' as pair", "source_frame", "'bezier' as interp", "1 as edit_seq")
    return kf.pair_interp(k, e).select("crop_id", "axis", "source_frame", "interp")


# per key, by its frame: a set, handles and a set again; a delete and a set; a move away, a new key in its place and, for half, a toggle of what was moved; a shape and a pair; nothing
@query("i14_edit_sequences", with_sql(KEYFRAMES_SQL) + """, h AS (SELECT crop_id, axis, source_frame AS f, value AS v, interp AS i FROM keyframes)
SELECT crop_id, axis, f AS source_frame, v + 2 AS value, 'bezier' AS interp, 7::DOUBLE AS in_dx, 0::DOUBLE AS out_dy FROM h WHERE f % 5 = 0 AND i <> 'bezier'
UNION ALL SELECT crop_id, axis, f, v + 2, 'bezier', 7, 3 FROM h WHERE f % 5 = 0 AND i = 'bezier'
UNION ALL SELECT crop_id, axis, f, 5, 'linear', 0, 0 FROM h WHERE f % 5 = 1
UNION ALL SELECT crop_id, axis, f, 1, 'step', 0, 0 FROM h WHERE f % 5 = 2
UNION ALL SELECT crop_id, axis, f + 1000000, v + 10, i, -1, 3 FROM h WHERE f % 5 = 2 AND f % 2 = 1
UNION ALL SELECT crop_id, axis, f, v, CASE WHEN axis IN ('x', 'y') THEN 'linear' ELSE 'step' END, 3, 0 FROM h WHERE f % 5 = 3
UNION ALL SELECT crop_id, axis, f, v, i, -1, 3 FROM h WHERE f % 5 = 4""")
def i14_log(spark, d):
    k = handled(spark, d)
    edits = k.where("source_frame % 5 < 4").selectExpr(
        "crop_id", "case when source_frame % 5 = 3 then 'position' end as pair", "axis", "source_frame", """inline(case source_frame % 5
         when 0 then array(named_struct('kind', 'set', 'at', source_frame, 'new_frame', 0L, 'val', value + 1, 'how', 'bezier', 'dx', cast(null as double), 'edit_seq', 1),
           named_struct('kind', 'handles', 'at', source_frame, 'new_frame', 0L, 'val', 0D, 'how', '', 'dx', 7D, 'edit_seq', 2),
           named_struct('kind', 'set', 'at', source_frame, 'new_frame', 0L, 'val', value + 2, 'how', 'bezier', 'dx', cast(null as double), 'edit_seq', 3))
         when 1 then array(named_struct('kind', 'delete', 'at', source_frame, 'new_frame', 0L, 'val', 0D, 'how', '', 'dx', cast(null as double), 'edit_seq', 1),
           named_struct('kind', 'set', 'at', source_frame, 'new_frame', 0L, 'val', 5D, 'how', cast(null as string), 'dx', cast(null as double), 'edit_seq', 2))
         when 2 then array(named_struct('kind', 'move', 'at', source_frame, 'new_frame', source_frame + 1000000, 'val', value + 10, 'how', '', 'dx', cast(null as double), 'edit_seq', 1),
           named_struct('kind', 'set', 'at', source_frame, 'new_frame', 0L, 'val', 1D, 'how', 'step', 'dx', cast(null as double), 'edit_seq', 2),
           named_struct('kind', 'toggle', 'at', source_frame + 1000000 + source_frame % 2 * 1000000, 'new_frame', 0L, 'val', 9D, 'how', 'step', 'dx', cast(null as double), 'edit_seq', 3),
           named_struct('kind', 'delete', 'at', source_frame + 2000000, 'new_frame', 0L, 'val', 9D, 'how', 'step', 'dx', cast(null as double), 'edit_seq', 4))
         else array(named_struct('kind', 'shape', 'at', source_frame, 'new_frame', 0L, 'val', 0D, 'how', 'step', 'dx', 3D, 'edit_seq', 1),
           named_struct('kind', 'pair', 'at', source_frame, 'new_frame', 0L, 'val', 0D, 'how', 'linear', 'dx', cast(null as double), 'edit_seq', 2)) end)""")
    edits = edits.selectExpr("crop_id", "pair", "axis", "kind", "at as source_frame", "case when kind = 'move' then new_frame end as new_frame", "val as value", "how as interp", "dx as in_dx", "edit_seq")
    return kf.edit_keys(k, edits).select("crop_id", "axis", "source_frame", "value", "interp", "in_dx", "out_dy")
