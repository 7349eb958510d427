"""Seek audits and table invariants."""

from pyspark.sql import functions as F

from shotweave import fixtures as fx
from shotweave.fixtures import FRAMES_SQL, ITEMS_SQL, PACKETS_SQL, SOURCES_SQL, with_sql
from shotweave.operators import audit as au
from shotweave.plans import export as ex
from shotweave.queries import query
from shotweave.queries.layout import BASE_PLAN, _DEN_SQL, _DUR_SQL

# one sequence rate (24000/1001) for all sources, as an export with a fixed rate has; source rates differ
SEQ = 24000 / 1001
ROWS_SQL = """, rows AS (SELECT timeline_id, item_ix, source_id, src_in AS intended_frame, fps AS source_fps, 1001::BIGINT AS rate_num, 24000::BIGINT AS rate_den,
  CASE WHEN src_in <= 0 THEN 0 ELSE src_in * 1001 + 500 END AS num, CASE WHEN src_in <= 0 THEN 1 ELSE 24000 END AS den, src_in + 0.25::DOUBLE AS value, 24000.0::DOUBLE / 1001 AS rate FROM plan)"""
NTSC = "(abs(source_fps - 24000.0::DOUBLE/1001) < 0.01 OR abs(source_fps - 30000.0::DOUBLE/1001) < 0.01 OR abs(source_fps - 60000.0::DOUBLE/1001) < 0.01)"


def rows(spark, d):
    plan = ex.export_plan(fx.items(spark, d), fx.sources(spark, d), fx.timelines(spark, d))
    r = ex.interchange_rows(plan, SEQ)
    from shotweave.functions import expr as X
    parsed = X.parse_fraction("start_text")
    return r.select("timeline_id", "item_ix", "source_id", F.col("src_in").alias("intended_frame"), F.col("fps").alias("source_fps"),
                    "rate_num", "rate_den", parsed["num"].alias("num"), parsed["den"].alias("den"), F.col("start_value").alias("value"), F.lit(SEQ).alias("rate"))


@query("l1_audit_rational", BASE_PLAN + ROWS_SQL + f""", t AS (SELECT *, num / den::DOUBLE AS t FROM rows), p AS (SELECT timeline_id, item_ix, intended_frame AS n, CASE WHEN num = 0 THEN 0 ELSE floor(t * source_fps)::BIGINT END AS a,
 CASE WHEN num = 0 THEN 0 ELSE round_even(t * source_fps, 0)::BIGINT END AS b, CASE WHEN num = 0 THEN 0 ELSE trunc(t * source_fps)::BIGINT END AS c,
 CASE WHEN {NTSC} AND num <> 0 THEN floor(round_even(t * 24, 0) / 24.0::DOUBLE * source_fps)::BIGINT END AS e, CASE WHEN {NTSC} AND num <> 0 THEN round_even(round_even(t * 24, 0) / 24.0::DOUBLE * source_fps, 0)::BIGINT END AS f,
 CASE WHEN {NTSC} AND num <> 0 THEN floor(t * (24000.0::DOUBLE / 1001))::BIGINT END AS g FROM t)
SELECT timeline_id, item_ix, a AS p_floor, b AS p_round, e AS p_tick_floor, g AS p_declared_floor, concat_ws(',', CASE WHEN a <> n THEN 'floor' END, CASE WHEN b <> n THEN 'round' END, CASE WHEN c <> n THEN 'trunc' END,
 CASE WHEN e <> n THEN 'tick_floor' END, CASE WHEN f <> n THEN 'tick_round' END, CASE WHEN g <> n THEN 'declared_floor' END) AS disagreeing FROM p""")
def l1(spark, d):
    return au.audit_rational(rows(spark, d)).select("timeline_id", "item_ix", "p_floor", "p_round", "p_tick_floor", "p_declared_floor", "disagreeing")


@query("l2_audit_fractional", BASE_PLAN + ROWS_SQL + f""", t AS (SELECT *, value / rate AS t, 23.976023976023979::DOUBLE AS rr FROM rows), p AS (SELECT timeline_id, item_ix, intended_frame AS n, floor(t * source_fps)::BIGINT AS a,
 round_even(t * source_fps, 0)::BIGINT AS b, trunc(t * source_fps)::BIGINT AS c, CASE WHEN {NTSC} THEN floor(t * rr)::BIGINT END AS e, CASE WHEN {NTSC} THEN round_even(t * rr, 0)::BIGINT END AS f,
 CASE WHEN {NTSC} THEN trunc(t * rr)::BIGINT END AS g FROM t)
SELECT timeline_id, item_ix, a AS p_floor, e AS p_reader_floor, concat_ws(',', CASE WHEN a <> n THEN 'floor' END, CASE WHEN b <> n THEN 'round' END, CASE WHEN c <> n THEN 'trunc' END,
 CASE WHEN e <> n THEN 'reader_floor' END, CASE WHEN f <> n THEN 'reader_round' END, CASE WHEN g <> n THEN 'reader_trunc' END) AS disagreeing FROM p""")
def l2(spark, d):
    return au.audit_fractional(rows(spark, d)).select("timeline_id", "item_ix", "p_floor", "p_reader_floor", "disagreeing")


@query("l3_audit_roundtrip", BASE_PLAN + ROWS_SQL + """SELECT timeline_id, item_ix, CASE WHEN num = 0 THEN 0 ELSE (num - 500) // 1001 END AS recovered_rational, round_even(value - 0.25, 0)::BIGINT AS recovered_fractional,
 (CASE WHEN num = 0 THEN 0 ELSE (num - 500) // 1001 END) = intended_frame AS intact FROM rows""")
def l3(spark, d):
    return au.audit_roundtrip(rows(spark, d)).select("timeline_id", "item_ix", "recovered_rational", "recovered_fractional", "intact")


# regular packets: one per frame at the source's rate for even sources, one missing every 50 for odd ones
@query("l4_audit_pts", with_sql(FRAMES_SQL) + f""", pk AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY frame_ix) - 1 AS pts_ix, frame_ix / 24.0::DOUBLE AS pts_time FROM frames WHERE source_id % 2 = 0 OR frame_ix % 20 <> 7),
sk AS (SELECT o_orderkey AS seek_id, o_custkey % ((SELECT count(DISTINCT user_id) FROM events) + 10) AS source_id, o_orderkey % ({fx.LONGEST_SQL} + 5) AS intended_frame, (o_orderkey % ({fx.LONGEST_SQL} + 5) + 0.5::DOUBLE) / 24.0::DOUBLE AS seek FROM orders), hv AS (SELECT DISTINCT source_id FROM pk)
SELECT seek_id, CASE WHEN h.source_id IS NULL THEN -1 ELSE coalesce(pts_ix, 0) END AS pts_k, CASE WHEN h.source_id IS NULL THEN 0 ELSE coalesce(pts_ix, 0) - intended_frame END AS pts_delta
 FROM sk LEFT JOIN hv h ON h.source_id = sk.source_id ASOF LEFT JOIN pk ON pk.source_id = sk.source_id AND sk.seek >= pk.pts_time""")
def l4(spark, d):
    from shotweave.sources.packets import index_packets
    pk = index_packets(fx.frames(spark, d).where("source_id % 2 = 0 or frame_ix % 20 <> 7").selectExpr("source_id", "frame_ix / 24.0D as pts_time"))
    sk = fx.table(spark, d, "orders").selectExpr(
        "o_orderkey as seek_id", f"o_custkey % {fx.users(spark, d) + 10} as source_id", f"o_orderkey % {fx.longest(spark, d) + 5} as intended_frame", f"(o_orderkey % {fx.longest(spark, d) + 5} + 0.5D) / 24.0D as seek", "0.0D as start_time")
    return au.audit_pts(sk, pk).select("seek_id", "pts_k", "pts_delta")


@query("l6_audit_timelines", with_sql(ITEMS_SQL) + """, x AS (SELECT timeline_id, CASE WHEN l_suppkey % 50 = 0 THEN 'same' ELSE clip_id END AS clip_id, item_ix, source_id, CASE WHEN l_suppkey % 60 = 1 THEN source_in - 1 ELSE source_out END AS source_out, source_in, group_id FROM items),
a AS (SELECT timeline_id, clip_id, count(*) AS c FROM x GROUP BY ALL HAVING count(*) > 1)
SELECT 'clip_id_repeats' AS rule, timeline_id::VARCHAR AS key, count(*) AS n FROM a GROUP BY ALL
UNION ALL SELECT 'length_not_positive', timeline_id::VARCHAR, count(*) FROM x WHERE source_out < source_in GROUP BY ALL
UNION ALL SELECT 'unknown_source', timeline_id::VARCHAR, count(*) FROM x WHERE source_id % 9 = 0 GROUP BY ALL
UNION ALL SELECT 'unknown_tag', timeline_id::VARCHAR, count(*) FROM x WHERE group_id = 4 GROUP BY ALL""")
def l6(spark, d):
    x = fx.items(spark, d).selectExpr(
        "timeline_id", "case when l_suppkey % 50 = 0 then 'same' else clip_id end as clip_id", "item_ix", "source_id", "source_in",
        "case when l_suppkey % 60 = 1 then source_in - 1 else source_out end as source_out", "group_ids")
    return au.audit_timelines(x, fx.sources(spark, d).where("source_id % 9 <> 0"), fx.groups(spark, d).where("group_id <> 4"), fx.keyframes(spark, d))
