"""Frame stores, colour features and interchange audits over the driver's tables."""

import uuid

from pyspark.sql import functions as F

from shotweave import fixtures as fx
from shotweave.fixtures import FRAMES_SQL, ITEMS_SQL, LONGEST_SQL, SOURCES_SQL, USERS_SQL, with_sql
from shotweave.operators import audit as au, detect as dt
from shotweave.queries import query
from shotweave.session import shared_dir
from shotweave.sources import stores


@query("a6_get_frames", with_sql(FRAMES_SQL) + f""", w AS (SELECT o_orderkey, o_custkey % {USERS_SQL} AS source_id, o_orderkey % ({LONGEST_SQL} + 5) AS frame_ix FROM orders)
SELECT o_orderkey, w.source_id, w.frame_ix, md5(props) AS content FROM w LEFT JOIN frames f ON f.source_id = w.source_id AND f.frame_ix = w.frame_ix""")
def a6(spark, d):
    path = f"{shared_dir(spark).rstrip('/')}/shotweave/frames-{uuid.uuid4().hex}"
    stores.write_frame_store(fx.frames(spark, d).select("source_id", "frame_ix", F.encode("props", "UTF-8").alias("pixels")), path)
    wanted = fx.table(spark, d, "orders").selectExpr("o_orderkey", f"o_custkey % {fx.users(spark, d)} as source_id", f"o_orderkey % {fx.longest(spark, d) + 5} as frame_ix")
    return stores.get_frames(spark.read.parquet(path), wanted).select("o_orderkey", "source_id", "frame_ix", F.md5("pixels").alias("content"))


# two by two pixels from the digest of each event's properties
@query("n2_hsv_features", with_sql(FRAMES_SQL) + """, b AS (SELECT source_id, frame_ix, md5(props) AS h, unnest([0, 1, 2, 3]) AS pixel FROM frames),
c AS (SELECT source_id, frame_ix, pixel, ('0x' || substr(h, 6 * pixel + 1, 2))::INTEGER AS r, ('0x' || substr(h, 6 * pixel + 3, 2))::INTEGER AS g, ('0x' || substr(h, 6 * pixel + 5, 2))::INTEGER AS b FROM b),
s AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS span FROM c),
u AS (SELECT *, CASE WHEN span = 0 THEN 0 WHEN v = r THEN 60::DOUBLE * (g - b) / span WHEN v = g THEN 120 + 60::DOUBLE * (b - r) / span ELSE 240 + 60::DOUBLE * (r - g) / span END AS hue FROM s)
SELECT source_id, frame_ix, pixel::BIGINT AS pixel, (round_even(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END / 2, 0) % 180)::BIGINT AS hue,
 round_even(255::DOUBLE * span / CASE WHEN v = 0 THEN 1 ELSE v END, 0)::BIGINT AS saturation, v::BIGINT AS lightness FROM u""")
def n2(spark, d):
    raw = fx.frames(spark, d).select("source_id", "frame_ix", F.substring(F.unhex(F.md5("props")), 1, 12).alias("pixels"))
    rows = raw.select("source_id", "frame_ix", dt.hsv_features(2, 2)("pixels").alias("f"))
    rows = rows.select("source_id", "frame_ix", "f", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("pixel"))
    at = lambda k: F.element_at("f", (3 * F.col("pixel") + k).cast("int")).cast("long")
    return rows.select("source_id", "frame_ix", "pixel", at(1).alias("hue"), at(2).alias("saturation"), at(3).alias("lightness"))


@query("l5_audit_interchange", with_sql(ITEMS_SQL, SOURCES_SQL) + """SELECT timeline_id AS doc_id, count(*) FILTER (i.source_id IS NOT NULL AND item_ix % 9 > 0) AS n_clips, count(*) FILTER (i.source_id IS NULL AND item_ix % 9 > 0) AS n_gaps,
 count(*) FILTER (item_ix % 9 = 0) AS bad_schema, count(*) FILTER (i.source_id IS NULL AND item_ix % 9 > 0 AND (dur % 5 = 0 OR dur % 7 = 0)) AS bad_gaps,
 count(*) FILTER (i.source_id IS NOT NULL AND item_ix % 9 > 0 AND dur % 11 = 0) AS bad_avail_start, count(*) FILTER (i.source_id IS NOT NULL AND item_ix % 9 > 0 AND s.source_id IS NOT NULL AND dur % 3 = 0) AS bad_avail_duration
 FROM items i LEFT JOIN sources s ON s.source_id = i.source_id GROUP BY timeline_id""")
def l5(spark, d):
    src = fx.sources(spark, d)
    children = fx.items(spark, d).join(src.select("source_id", "total_frames"), "source_id", "left").selectExpr(
        "timeline_id as doc_id", "case when item_ix % 9 = 0 then 'other' when source_id is null then 'gap' else 'clip' end as kind",
        "cast(case when source_id is null then (case when dur % 5 = 0 then 1 else 0 end) else source_in + 0.25 end as double) as start_value",
        "cast(dur + (case when source_id is null and dur % 7 = 0 then 0.5 else 0 end) as double) as duration_value",
        "cast(case when dur % 11 = 0 then 1 else 0 end as double) as avail_start", "cast(total_frames + (case when dur % 3 = 0 then 1 else 0 end) as double) as avail_duration", "source_id")
    return au.audit_interchange(children, src)
