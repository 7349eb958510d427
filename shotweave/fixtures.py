"""The driver's tables mapped to the library's tables (see FIXTURES.md), and the same mapping as SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from shotweave.operators.ordered import row_index
from shotweave.session import materialize

# ---- fixed values of the mapping ----------------------------------------------------
FPS_BY_SIZE = ["24000.0/1001", "24.0", "25.0", "30000.0/1001", "30.0", "50.0", "60000.0/1001", "60.0"]
# microseconds since 1970 read off the wall clock, whatever the session time zone is
MICROS = ("(unix_date(cast(ts as date)) * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L"
          " + cast(extract(second from ts) * 1000000 as bigint))")
EPOCH_2024 = 1704067200000000
ASPECTS = ["free", "1:1", "4:3", "16:9", "9:16", "3:4", "custom"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(fn):
    """Write a derived input table once per application and data set, then read it like any stored table."""
    @functools.wraps(fn)
    def wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, fn.__name__)
        if key not in _STORED:
            _STORED[key] = materialize(fn(spark, sf_dir))
        return _STORED[key]
    return wrapper


#: Number of event users, the sources that have frames, keys and packets; user ids run from 0.
USERS_SQL = "(SELECT count(DISTINCT user_id) FROM events)"
#: Frames of the longest source, the bound of what lookups ask for.
LONGEST_SQL = "(SELECT max(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id))"


@functools.cache
def _users(application: str, spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "events").agg(F.countDistinct("user_id")).first()[0]


@functools.cache
def _longest(app: str, spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "events").groupBy("user_id").count().agg(F.max("count")).first()[0]


def longest(spark: SparkSession, sf_dir: str) -> int:
    return _longest(spark.sparkContext.applicationId, spark, sf_dir)


def users(spark: SparkSession, sf_dir: str) -> int:
    return _users(spark.sparkContext.applicationId, spark, sf_dir)


def sources(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as source_id",
        "concat('/media/', replace(p_name, ' ', '_'), '/', p_partkey, '.mov') as file_path",
        "2000 + p_partkey % 5000 as total_frames",
        "case p_size % 8 " + " ".join(
            f"when {i} then cast({r.split('/')[0]} as double){'/1001' if '/' in r else ''}"
            for i, r in enumerate(FPS_BY_SIZE)) + " end as fps",
        "case p_size % 3 when 0 then 1280 when 1 then 1920 else 3840 end as width",
        "case p_size % 3 when 0 then 720 when 1 then 1080 else 2160 end as height",
        "case when p_type in ('ECONOMY', 'STANDARD') then 'h264' else 'hevc' end as codec",
        "case p_size % 3 when 0 then '' when 1 then 'aac' else 'pcm_s16le' end as audio_codec",
        "case p_size % 3 when 0 then 0 when 1 then 48000 else 44100 end as audio_sample_rate",
        "case p_size % 3 when 0 then 0 when 1 then 2 else 6 end as audio_channels",
        "cast(case when p_partkey % 4 = 3 then 0 else 1 end as bigint) as time_base_num",
        "cast(case p_partkey % 4 when 0 then 16000 when 1 then 24000 when 2 then 90000 else 0 end as bigint) as time_base_den",
    )


_FPS_SQL = "case p_size % 8 " + " ".join(
    f"when {i} then cast({r.split('/')[0]} as double){'/1001' if '/' in r else ''}" for i, r in enumerate(FPS_BY_SIZE)) + " end"

SOURCES_SQL = f"""sources AS (SELECT p_partkey AS source_id,
 '/media/' || replace(p_name, ' ', '_') || '/' || p_partkey || '.mov' AS file_path,
 2000 + p_partkey % 5000 AS total_frames, {_FPS_SQL} AS fps,
 CASE p_size % 3 WHEN 0 THEN 1280 WHEN 1 THEN 1920 ELSE 3840 END AS width,
 CASE p_size % 3 WHEN 0 THEN 720 WHEN 1 THEN 1080 ELSE 2160 END AS height,
 CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'h264' ELSE 'hevc' END AS codec,
 CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'aac' ELSE 'pcm_s16le' END AS audio_codec,
 CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 48000 ELSE 44100 END AS audio_sample_rate,
 CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 6 END AS audio_channels,
 CASE WHEN p_partkey % 4 = 3 THEN 0::BIGINT ELSE 1::BIGINT END AS time_base_num,
 CASE p_partkey % 4 WHEN 0 THEN 16000::BIGINT WHEN 1 THEN 24000::BIGINT WHEN 2 THEN 90000::BIGINT ELSE 0::BIGINT END AS time_base_den
 FROM part)"""


@stored
def items(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as timeline_id", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "cast(l_quantity as bigint) as dur", "l_returnflag", "l_linestatus")
    ordered = row_index(
        li, ["timeline_id"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
        F.expr("shiftleft(cast(l_linenumber as bigint), 40) + shiftright(l_partkey, 16)"), "ix0")
    return ordered.selectExpr(
        "timeline_id", "ix0 + 1 as item_ix", "concat(timeline_id, '-', ix0 + 1) as clip_id",
        "case when l_returnflag <> 'R' then l_partkey end as source_id",
        "case when l_returnflag <> 'R' then 7 * l_suppkey else 0 end as source_in",
        "case when l_returnflag <> 'R' then 7 * l_suppkey else 0 end + dur - 1 as source_out",
        "concat('line ', l_linenumber) as label", "0 as color_index",
        "case when l_linestatus = 'O' then array(l_suppkey % 5) else cast(array() as array<bigint>) end as group_ids",
        "l_linenumber", "l_suppkey", "dur",
    )


ITEMS_SQL = """items0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ix FROM lineitem),
items AS (SELECT l_orderkey AS timeline_id, ix AS item_ix, l_orderkey || '-' || ix AS clip_id,
 CASE WHEN l_returnflag <> 'R' THEN l_partkey END AS source_id,
 CASE WHEN l_returnflag <> 'R' THEN 7 * l_suppkey ELSE 0 END AS source_in,
 CASE WHEN l_returnflag <> 'R' THEN 7 * l_suppkey ELSE 0 END + CAST(l_quantity AS BIGINT) - 1 AS source_out,
 'line ' || l_linenumber AS label, 0 AS color_index,
 CASE WHEN l_linestatus = 'O' THEN l_suppkey % 5 END AS group_id,
 l_linenumber, l_suppkey, CAST(l_quantity AS BIGINT) AS dur FROM items0)"""


def timelines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as timeline_id",
        "cast(case when o_orderstatus = 'P' then 10 end as bigint) as in_point",
        "cast(case when o_orderstatus in ('P', 'F') then 60 end as bigint) as out_point")


TIMELINES_SQL = """timelines AS (SELECT o_orderkey AS timeline_id,
 CASE WHEN o_orderstatus = 'P' THEN 10::BIGINT END AS in_point,
 CASE WHEN o_orderstatus IN ('P', 'F') THEN 60::BIGINT END AS out_point FROM orders)"""


def groups(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey as bigint) as group_id", "n_name as name", "'#888888' as color",
        "case when n_nationkey < 10 then n_nationkey end as digit", "cast(n_nationkey as bigint) as group_ix")


GROUPS_SQL = """groups AS (SELECT n_nationkey::BIGINT AS group_id, n_name AS name, '#888888' AS color,
 CASE WHEN n_nationkey < 10 THEN n_nationkey END AS digit, n_nationkey::BIGINT AS group_ix FROM nation)"""


@stored
def frames(spark, sf_dir) -> DataFrame:
    """Scalar frame features; minutes bound how many rows of one source meet in a chunk."""
    ev = table(spark, sf_dir, "events")
    ev = ev.select("user_id", "ts", "event_id", "value", "props", "event_type")
    minute = F.floor(F.expr(MICROS) / 60e6).cast("long")
    return row_index(ev, ["user_id"], ["ts", "event_id"], minute, "frame_ix").selectExpr(
        "user_id as source_id", "frame_ix", "value as feature", "props", "event_type", "ts", "event_id")


FRAMES_SQL = """frames AS (SELECT user_id AS source_id,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_ix,
 value AS feature, props, event_type, ts, event_id FROM events)"""


@stored
def frame_vectors(spark, sf_dir) -> DataFrame:
    em = table(spark, sf_dir, "embeddings")
    return row_index(em, ["label"], ["vec_id"], F.floor(F.col("vec_id") / 65536.0).cast("long"), "frame_ix").selectExpr(
        "cast(label as bigint) as source_id", "frame_ix", "embedding as feature")


VECTORS_SQL = """frame_vectors AS (SELECT label::BIGINT AS source_id,
 row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_ix, embedding AS feature FROM embeddings)"""


def frame_scores(spark, sf_dir) -> DataFrame:
    return frames(spark, sf_dir).selectExpr("source_id", "frame_ix", "feature / 250 as score")


SCORES_SQL = FRAMES_SQL + """, frame_scores AS (SELECT source_id, frame_ix, feature / 250 AS score FROM frames)"""


def packets_raw(spark, sf_dir) -> DataFrame:
    """Packet rows before ordering: pts in seconds, duration in ticks."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as source_id", f"{MICROS} / 1000000.0D as pts_time",
        "case when event_type = 'signup' then 'I' else 'P' end as pict_type",
        "case when user_id % 3 = 0 then 1001 when user_id % 3 = 1 and event_id % 500 = 0 then 500 "
        "when user_id % 3 = 1 then 1001 else 1000 + event_id % 2 end as duration",
        "event_id")


PACKETS_RAW_SQL = """packets0 AS (SELECT user_id AS source_id, epoch_us(ts) / 1000000.0::DOUBLE AS pts_time,
 CASE WHEN event_type = 'signup' THEN 'I' ELSE 'P' END AS pict_type,
 CASE WHEN user_id % 3 = 0 THEN 1001 WHEN user_id % 3 = 1 AND event_id % 500 = 0 THEN 500
  WHEN user_id % 3 = 1 THEN 1001 ELSE 1000 + event_id % 2 END AS duration, event_id FROM events)"""


@stored
def packets(spark, sf_dir) -> DataFrame:
    from shotweave.sources.packets import index_packets
    return index_packets(packets_raw(spark, sf_dir), tie=["event_id"])


PACKETS_SQL = PACKETS_RAW_SQL + """, packets AS (SELECT source_id,
 row_number() OVER (PARTITION BY source_id ORDER BY pts_time, event_id) - 1 AS pts_ix,
 pts_time, duration, pict_type FROM packets0)"""


def crops(spark, sf_dir, item_table: DataFrame | None = None) -> DataFrame:
    it = item_table if item_table is not None else items(spark, sf_dir)
    cases = " ".join(f"when {i} then '{a}'" for i, a in enumerate(ASPECTS))
    return it.where("source_id is not null and l_linenumber % 2 = 0").selectExpr(
        "timeline_id", "clip_id", "cast(1 as bigint) as crop_ix", "concat('k', clip_id) as crop_id",
        "l_suppkey % 100 as x", "(l_suppkey + 3) % 100 as y", "20 + 8 * dur as w", "10 + 9 * dur as h",
        f"case l_suppkey % 7 {cases} end as aspect_ratio",
        "cast(21 as bigint) as custom_ratio_w", "cast(9 as bigint) as custom_ratio_h",
        "case when l_suppkey % 3 > 0 then l_suppkey % 30 end as group_id",
        "l_suppkey % 11 <> 0 as active", "case when l_suppkey % 4 = 0 then '' else label end as label",
        "source_id", "source_in", "source_out")


_ASPECT_SQL = " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ASPECTS))
CROPS_SQL = f"""crops AS (SELECT timeline_id, clip_id, 1::BIGINT AS crop_ix, 'k' || clip_id AS crop_id,
 l_suppkey % 100 AS x, (l_suppkey + 3) % 100 AS y, 20 + 8 * dur AS w, 10 + 9 * dur AS h,
 CASE l_suppkey % 7 {_ASPECT_SQL} END AS aspect_ratio,
 21::BIGINT AS custom_ratio_w, 9::BIGINT AS custom_ratio_h,
 CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 30 END AS group_id,
 l_suppkey % 11 <> 0 AS active, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE label END AS label,
 source_id, source_in, source_out FROM items WHERE source_id IS NOT NULL AND l_linenumber % 2 = 0)"""


def segments(crop_table: DataFrame) -> DataFrame:
    return crop_table.selectExpr(
        "crop_id", "source_id", "source_in", "source_out",
        "inline(array(struct(cast(0 as bigint) as segment_ix, concat('s0', crop_id) as segment_id, source_in as anchor_frame, true as active),"
        " struct(cast(1 as bigint) as segment_ix, concat('s1', crop_id) as segment_id, source_in + 5 as anchor_frame, source_in % 4 <> 0 as active)))"
    ).select("crop_id", "segment_ix", "segment_id", "anchor_frame", "active")


SEGMENTS_SQL = """segments AS (SELECT crop_id, 0::BIGINT AS segment_ix, 's0' || crop_id AS segment_id, source_in AS anchor_frame, true AS active FROM crops
 UNION ALL SELECT crop_id, 1::BIGINT, 's1' || crop_id, source_in + 5, source_in % 4 <> 0 FROM crops)"""


def keyframes(spark, sf_dir) -> DataFrame:
    """One key per (crop, axis, hour): the highest event id wins."""
    ev = table(spark, sf_dir, "events").selectExpr(
        "user_id as crop_id",
        "case event_id % 4 when 0 then 'x' when 1 then 'y' when 2 then 'w' else 'h' end as axis",
        f"cast(floor(({MICROS} - {EPOCH_2024}L) / 3600000000.0D) as bigint) as source_frame",
        "event_id", "round(value) as value",
        "case when event_type in ('click', 'view') then 'linear' when event_type = 'purchase' then 'bezier' else 'step' end as interp")
    best = ev.groupBy("crop_id", "axis", "source_frame").agg(
        F.max_by(F.struct("value", "interp"), "event_id").alias("k"))
    zero = F.lit(0.0)
    return best.select(
        "crop_id", "axis", "source_frame", "k.value", "k.interp",
        zero.alias("in_dx"), zero.alias("in_dy"), zero.alias("out_dx"), zero.alias("out_dy"))


KEYFRAMES_SQL = """keyframes AS (SELECT crop_id, axis, source_frame, value, interp,
  0.0::DOUBLE AS in_dx, 0.0::DOUBLE AS in_dy, 0.0::DOUBLE AS out_dx, 0.0::DOUBLE AS out_dy FROM (
 SELECT *, row_number() OVER (PARTITION BY crop_id, axis, source_frame ORDER BY event_id DESC) AS rn FROM (
 SELECT user_id AS crop_id,
  CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'y' WHEN 2 THEN 'w' ELSE 'h' END AS axis,
  CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3600000000.0::DOUBLE) AS BIGINT) AS source_frame,
  event_id, round(value, 0) AS value,
  CASE WHEN event_type IN ('click', 'view') THEN 'linear' WHEN event_type = 'purchase' THEN 'bezier' ELSE 'step' END AS interp
 FROM events)) WHERE rn = 1)"""


def versions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id % 2 as project_id", "concat('v', event_id) as filename",
        "cast(ts as timestamp_ntz) as ts", "event_type as trigger", "event_id")


VERSIONS_SQL = """versions AS (SELECT user_id % 2 AS project_id, 'v' || event_id AS filename, ts,
 event_type AS trigger, event_id FROM events)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
