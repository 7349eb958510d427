"""Timeline edits."""

from pyspark.sql import functions as F

from shotweave import fixtures as fx
from shotweave.fixtures import CROPS_SQL, ITEMS_SQL, SEGMENTS_SQL, SOURCES_SQL, TIMELINES_SQL, with_sql
from shotweave.operators import edits as ed, source_tables as st
from shotweave.operators import timeline as tl
from shotweave.queries import query
from shotweave.queries.layout import PLACED_SQL

COLS = ["timeline_id", "item_ix", "source_id", "source_in", "source_out"]

# items after an edit (table e with ord) → merged gaps, renumbered
MERGE_SQL = """, m AS (SELECT *, coalesce(sum((source_id IS NOT NULL)::INT) OVER (PARTITION BY timeline_id ORDER BY ord
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e),
g AS (SELECT timeline_id, ord, source_id, source_in, source_out FROM m WHERE source_id IS NOT NULL
 UNION ALL SELECT timeline_id, min(ord), NULL, 0, (sum(source_out - source_in + 1) - 1)::BIGINT FROM m WHERE source_id IS NULL GROUP BY timeline_id, run)
SELECT timeline_id, row_number() OVER (PARTITION BY timeline_id ORDER BY ord) AS item_ix, source_id, source_in, source_out FROM g"""
PICK = "(timeline_id + item_ix) % 3 = 0"


def picked(it):
    return it.where(PICK).select("timeline_id", "clip_id")


@query("i1_remove_items", with_sql(ITEMS_SQL) + f""", e AS (SELECT timeline_id, item_ix AS ord, CASE WHEN {PICK} THEN NULL ELSE source_id END AS source_id,
 CASE WHEN {PICK} THEN 0 ELSE source_in END AS source_in, CASE WHEN {PICK} THEN dur - 1 ELSE source_out END AS source_out
 FROM items WHERE NOT ({PICK} AND source_id IS NULL))""" + MERGE_SQL)
def i1(spark, d):
    it = fx.items(spark, d)
    return ed.remove_items(it, picked(it)).select(*COLS)


@query("i2_ripple_delete", with_sql(ITEMS_SQL) + f", e AS (SELECT *, item_ix AS ord FROM items WHERE NOT {PICK})" + MERGE_SQL)
def i2(spark, d):
    it = fx.items(spark, d)
    return ed.ripple_delete(it, picked(it)).select(*COLS)


@query("i3_remove_source", with_sql(ITEMS_SQL) + """, e AS (SELECT timeline_id, item_ix AS ord, CASE WHEN source_id % 4 = 0 THEN NULL ELSE source_id END AS source_id,
 CASE WHEN source_id % 4 = 0 THEN 0 ELSE source_in END AS source_in, CASE WHEN source_id % 4 = 0 THEN dur - 1 ELSE source_out END AS source_out FROM items)""" + MERGE_SQL)
def i3(spark, d):
    return ed.remove_source(fx.items(spark, d), fx.sources(spark, d).where("source_id % 4 = 0")).select(*COLS)


@query("i3_ripple_source", with_sql(ITEMS_SQL) + ", e AS (SELECT *, item_ix AS ord FROM items WHERE source_id IS NULL OR source_id % 4 <> 0)" + MERGE_SQL)
def i3r(spark, d):
    return ed.ripple_source(fx.items(spark, d), fx.sources(spark, d).where("source_id % 4 = 0")).select(*COLS)


# three clips per order: two at one inner frame, one at another frame
INS_SQL = """ins AS (SELECT o_orderkey AS timeline_id, unnest([o_custkey % 300 - 5, o_custkey % 300 - 5, 25]) AS tl_frame, unnest([0, 1, 2]) AS k, o_custkey AS src FROM orders)"""


def inserts(spark, d):
    t = fx.table(spark, d, "orders").selectExpr(
        "o_orderkey as timeline_id", "o_custkey", "posexplode(array(o_custkey % 300 - 5, o_custkey % 300 - 5, 25L)) as (ins_ix, tl_frame)")
    return t.selectExpr("timeline_id", "tl_frame", "ins_ix", "concat('n', timeline_id, '-', ins_ix) as clip_id", "o_custkey as source_id",
                        "cast(100 * ins_ix as bigint) as source_in", "100L * ins_ix + 9 as source_out", "'' as label", "0 as color_index",
                        "cast(array() as array<bigint>) as group_ids", "0 as l_linenumber", "0L as l_suppkey", "10L as dur")


PIECES_SQL = """ st AS (SELECT p.timeline_id, tl_start, tl_start + dur - 1 AS tl_end, item_ix, source_id, source_in, tl_start AS ps FROM placed p
 UNION SELECT p.timeline_id, tl_start, tl_start + dur - 1, item_ix, source_id, source_in, cut FROM placed p JOIN cuts c ON c.timeline_id = p.timeline_id AND cut > tl_start AND cut < tl_start + dur),
pc AS (SELECT *, coalesce(lead(ps) OVER (PARTITION BY timeline_id ORDER BY ps) - 1, tl_end) AS pe FROM st)"""


@query("i4_insert_items", with_sql(ITEMS_SQL, PLACED_SQL, INS_SQL) + """, tot AS (SELECT timeline_id, max(tl_total) AS n FROM placed GROUP BY timeline_id),
ip AS (SELECT i.*, least(greatest(tl_frame, 0), coalesce(n, 0)) AS pos FROM ins i LEFT JOIN tot USING (timeline_id)),
cuts AS (SELECT DISTINCT timeline_id, pos AS cut FROM ip), """ + PIECES_SQL + """,
u AS (SELECT timeline_id, ps AS pos, 1 AS kind, 0 AS k, source_id, CASE WHEN source_id IS NULL THEN 0 ELSE source_in + ps - tl_start END AS source_in,
  CASE WHEN source_id IS NULL THEN pe - ps ELSE source_in + pe - tl_start END AS source_out FROM pc
 UNION ALL SELECT timeline_id, pos, 0, k, src, 100 * k, 100 * k + 9 FROM ip)
SELECT timeline_id, row_number() OVER (PARTITION BY timeline_id ORDER BY pos, kind, k) AS item_ix, source_id, source_in, source_out FROM u""")
def i4(spark, d):
    return ed.insert_items(fx.items(spark, d), inserts(spark, d)).select(*COLS)


@query("i5_split_items", with_sql(ITEMS_SQL, PLACED_SQL) + """, want AS (SELECT o_orderkey AS timeline_id, unnest([o_custkey % 120, 30, 31, 77]) AS cut FROM orders),
cuts AS (SELECT DISTINCT w.timeline_id, cut FROM want w JOIN placed p ON p.timeline_id = w.timeline_id AND source_id IS NOT NULL AND cut > tl_start AND cut < tl_start + dur - 1), """ + PIECES_SQL + """
SELECT timeline_id, row_number() OVER (PARTITION BY timeline_id ORDER BY ps) AS item_ix, source_id,
 CASE WHEN source_id IS NULL THEN 0 ELSE source_in + ps - tl_start END AS source_in,
 CASE WHEN source_id IS NULL THEN pe - ps ELSE source_in + pe - tl_start END AS source_out FROM pc""")
def i5(spark, d):
    cuts = fx.table(spark, d, "orders").selectExpr("o_orderkey as timeline_id", "explode(array(o_custkey % 120, 30L, 31L, 77L)) as tl_frame")
    return ed.split_items(fx.items(spark, d), cuts).select(*COLS)


SPLIT_SQL = "sp AS (SELECT crop_id, source_in + x % 8 AS f FROM crops WHERE x % 3 > 0)"


def _split_inputs(spark, d):
    c = fx.crops(spark, d)
    segs = fx.segments(c.where("x % 5 > 0"))
    splits = c.where("x % 3 > 0").selectExpr("clip_id", "source_in + x % 8 as split_frame", "concat(clip_id, 'L') as left_id", "concat(clip_id, 'R') as right_id")
    return ed.partition_crops(c, segs, splits)


@query("i6_partition_crops", with_sql(ITEMS_SQL, CROPS_SQL, SPLIT_SQL, SEGMENTS_SQL.replace("FROM crops", "FROM crops WHERE x % 5 > 0")) + """,
side AS (SELECT DISTINCT crop_id, CASE WHEN anchor_frame < f THEN 'L' ELSE 'R' END AS side FROM segments JOIN sp USING (crop_id))
SELECT c.timeline_id, CASE WHEN sp.f IS NULL THEN clip_id ELSE clip_id || coalesce(side, 'L') END AS clip_id,
 CASE WHEN sp.f IS NULL THEN c.crop_id ELSE left(sha256(c.crop_id || ':' || coalesce(side, 'L')), 32) END AS crop_id
 FROM crops c LEFT JOIN sp ON sp.crop_id = c.crop_id LEFT JOIN side ON side.crop_id = sp.crop_id""")
def i6(spark, d):
    return _split_inputs(spark, d)[0].select("timeline_id", "clip_id", "crop_id")


@query("i6_partition_segments", with_sql(ITEMS_SQL, CROPS_SQL, SPLIT_SQL, SEGMENTS_SQL.replace("FROM crops", "FROM crops WHERE x % 5 > 0")) + """
SELECT anchor_frame, CASE WHEN f IS NULL THEN segment_id ELSE left(sha256(segment_id || ':' || CASE WHEN anchor_frame < f THEN 'L' ELSE 'R' END), 32) END AS segment_id,
 CASE WHEN f IS NULL THEN s.crop_id ELSE left(sha256(s.crop_id || ':' || CASE WHEN anchor_frame < f THEN 'L' ELSE 'R' END), 32) END AS crop_id
 FROM segments s LEFT JOIN sp USING (crop_id)""")
def i6s(spark, d):
    return _split_inputs(spark, d)[1].select("anchor_frame", "segment_id", "crop_id")


# every long clip is cut twice; each crop has a segment in the first and one in the middle piece, and one key
THIRDS_SQL = """th AS (SELECT timeline_id, clip_id, dur, source_in, left(sha256(clip_id || ':' || 0), 32) AS p0, left(sha256(clip_id || ':' || dur // 3), 32) AS p1 FROM items WHERE source_id IS NOT NULL AND dur > 20),
cp AS (SELECT c.timeline_id, c.clip_id, c.crop_id, c.source_in, h.p0, h.p1, i.dur FROM crops c JOIN items i USING (timeline_id, clip_id) LEFT JOIN th h USING (timeline_id, clip_id)),
two AS (SELECT *, 0 AS k, p0 AS p FROM cp UNION ALL SELECT *, 1, p1 FROM cp)"""


def _thirds(spark, d):
    it = fx.items(spark, d)
    cuts = tl.place_items(it).where("source_id is not null and dur > 20").selectExpr("timeline_id", "clip_id", "explode(array(tl_start + dur div 3, tl_start + 2 * dur div 3)) as tl_frame")
    return _handed(spark, d, it, ed.split_items(it, cuts, parents=True))


def _handed(spark, d, it, pieces):
    """Crops, segments and keys after the cutting of clips into pieces."""
    c = fx.crops(spark, d, it)
    segs = c.withColumn("dur", F.col("source_out") - F.col("source_in") + 1).selectExpr(
        "timeline_id", "crop_id", "inline(array(struct(0L as segment_ix, concat('s0', crop_id) as segment_id, source_in as anchor_frame, true as active),"
        " struct(1L as segment_ix, concat('s1', crop_id) as segment_id, source_in + dur div 2 as anchor_frame, true as active)))")
    keys = c.selectExpr("timeline_id", "crop_id", "'x' as axis", "source_in as source_frame", "cast(x as double) as value", "'step' as interp", "0D as in_dx", "0D as in_dy", "0D as out_dx", "0D as out_dy")
    return ed.partition_by_pieces(c, segs, keys, pieces)


@query("i5_split_with_crops", with_sql(ITEMS_SQL, CROPS_SQL, THIRDS_SQL) + """SELECT DISTINCT timeline_id, CASE WHEN p IS NULL THEN clip_id ELSE p END AS clip_id,
 CASE WHEN p IS NULL THEN crop_id ELSE left(sha256(crop_id || ':' || p), 32) END AS crop_id FROM two""")
def i5_crops(spark, d):
    return _thirds(spark, d)[0].select("timeline_id", "clip_id", "crop_id")


@query("i6_partition_many", with_sql(ITEMS_SQL, CROPS_SQL, THIRDS_SQL) + """SELECT timeline_id, CASE WHEN p IS NULL THEN crop_id ELSE left(sha256(crop_id || ':' || p), 32) END AS crop_id,
 CASE WHEN p IS NULL THEN 's' || k || crop_id ELSE left(sha256('s' || k || crop_id || ':' || p), 32) END AS segment_id, source_in + CASE k WHEN 0 THEN 0 ELSE dur // 2 END AS anchor_frame FROM two""")
def i6_many(spark, d):
    return _thirds(spark, d)[1].select("timeline_id", "crop_id", "segment_id", "anchor_frame")


@query("i6_partition_keyframes", with_sql(ITEMS_SQL, CROPS_SQL, THIRDS_SQL) + """SELECT DISTINCT timeline_id, CASE WHEN p IS NULL THEN crop_id ELSE left(sha256(crop_id || ':' || p), 32) END AS crop_id,
 'x' AS axis, source_in AS source_frame FROM two""")
def i6_keys(spark, d):
    return _thirds(spark, d)[2].select("timeline_id", "crop_id", "axis", "source_frame")


# a clip inserted a third into every long clip: the left piece keeps the clip's id, segments and keys follow their frame, colours go round
INSIDE_SQL = THIRDS_SQL.replace("left(sha256(clip_id || ':' || 0), 32) AS p0", "clip_id AS p0")


def _inside(spark, d):
    it = fx.items(spark, d)
    places = tl.place_items(it).where("source_id is not null and dur > 20")
    new = places.selectExpr("timeline_id", "tl_start + dur div 3 as tl_frame", "0L as ins_ix", "concat('n', clip_id) as clip_id", "source_id", "0L as source_in", "4L as source_out", "'' as label", "0 as color_index",
                            "cast(array() as array<bigint>) as group_ids", "0 as l_linenumber", "0L as l_suppkey", "5L as dur")
    return it, ed.insert_items(it, new, parents=True, color_start=3)


@query("i4_insert_with_crops", with_sql(ITEMS_SQL, CROPS_SQL, INSIDE_SQL) + """SELECT DISTINCT timeline_id, CASE WHEN p IS NULL THEN clip_id ELSE p END AS clip_id,
 CASE WHEN p IS NULL THEN crop_id ELSE left(sha256(crop_id || ':' || p), 32) END AS crop_id FROM two""")
def i4_crops(spark, d):
    it, pieces = _inside(spark, d)
    return _handed(spark, d, it, pieces)[0].select("timeline_id", "clip_id", "crop_id")


@query("i4_insert_keyframes", with_sql(ITEMS_SQL, CROPS_SQL, INSIDE_SQL) + """SELECT DISTINCT timeline_id, CASE WHEN p IS NULL THEN crop_id ELSE left(sha256(crop_id || ':' || p), 32) END AS crop_id,
 'x' AS axis, source_in AS source_frame FROM two""")
def i4_keys(spark, d):
    it, pieces = _inside(spark, d)
    return _handed(spark, d, it, pieces)[2].select("timeline_id", "crop_id", "axis", "source_frame")


@query("i4_insert_colors", with_sql(ITEMS_SQL) + """SELECT timeline_id, 'n' || clip_id AS clip_id, ((row_number() OVER (PARTITION BY timeline_id ORDER BY item_ix) + 2) % 8)::INTEGER AS color_index,
 (item_ix + 2 * row_number() OVER (PARTITION BY timeline_id ORDER BY item_ix) - 1)::BIGINT AS item_ix FROM items WHERE source_id IS NOT NULL AND dur > 20""")
def i4_colors(spark, d):
    return _inside(spark, d)[1].where("clip_id like 'n%' and parent_id = clip_id and dur = 5").select("timeline_id", "clip_id", "color_index", "item_ix")


@query("i7_replace_items", with_sql(ITEMS_SQL) + """, r AS (SELECT timeline_id, item_ix, source_id, source_in, source_in + dur // 2 - 1 AS source_out, 0 AS sub FROM items WHERE source_id IS NOT NULL AND dur > 20
 UNION ALL SELECT timeline_id, item_ix, source_id, source_in + dur // 2, source_out, 1 FROM items WHERE source_id IS NOT NULL AND dur > 20),
u AS (SELECT timeline_id, item_ix, source_id, source_in, source_out, 0 AS sub, false AS new FROM items WHERE source_id IS NULL OR dur <= 20 UNION ALL SELECT *, true FROM r)
SELECT timeline_id, row_number() OVER w AS item_ix, source_id, source_in, source_out,
 CASE WHEN new THEN (coalesce(sum(new::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 2) % 8 ELSE 0 END::INTEGER AS color_index
 FROM u WINDOW w AS (PARTITION BY timeline_id ORDER BY item_ix, sub)""")
def i7(spark, d):
    it = fx.items(spark, d)
    long = it.where("source_id is not null and dur > 20")
    repl = long.selectExpr(
        "timeline_id", "clip_id", "source_id",
        "inline(array(struct(0L as sub_ix, source_in as source_in, source_in + dur div 2 - 1 as source_out, concat(clip_id, 'a') as new_clip_id),"
        " struct(1L as sub_ix, source_in + dur div 2 as source_in, source_out as source_out, concat(clip_id, 'b') as new_clip_id)))")
    return ed.replace_items(it, repl, color_start=2).select(*COLS, "color_index")


@query("i8_toggle_group", with_sql(ITEMS_SQL) + """, t AS (SELECT *, group_id = 2 AS has FROM items WHERE source_id IS NOT NULL AND item_ix <= 2),
v AS (SELECT timeline_id, bool_and(coalesce(has, false)) AS all_have FROM t GROUP BY timeline_id)
SELECT i.timeline_id, i.item_ix, CASE WHEN t.item_ix IS NULL THEN coalesce(i.group_id::VARCHAR, '')
 WHEN all_have THEN '' WHEN t.has THEN '2' ELSE concat_ws(',', i.group_id, 2) END AS tags
 FROM items i LEFT JOIN t ON t.timeline_id = i.timeline_id AND t.item_ix = i.item_ix LEFT JOIN v ON v.timeline_id = t.timeline_id""")
def i8(spark, d):
    it = fx.items(spark, d)
    targets = it.where("item_ix <= 2").selectExpr("timeline_id", "clip_id", "2L as group_id")
    return ed.toggle_group(it, targets, fx.groups(spark, d)).select("timeline_id", "item_ix", F.array_join("group_ids", ",").alias("tags"))


@query("i9_delete_groups", with_sql(ITEMS_SQL) + "SELECT timeline_id, item_ix, CASE WHEN group_id IN (1, 3) THEN '' ELSE coalesce(group_id::VARCHAR, '') END AS tags FROM items")
def i9(spark, d):
    it, g = fx.items(spark, d), fx.groups(spark, d)
    return ed.delete_groups(it, fx.crops(spark, d, it), g, g.where("group_id in (1, 3)"))[0].select(
        "timeline_id", "item_ix", F.array_join("group_ids", ",").alias("tags"))


@query("i9_delete_groups_crops", with_sql(ITEMS_SQL, CROPS_SQL) + "SELECT crop_id, CASE WHEN group_id IN (1, 4) THEN NULL ELSE group_id END AS group_id FROM crops")
def i9c(spark, d):
    it, g = fx.items(spark, d), fx.groups(spark, d)
    return ed.delete_groups(it, fx.crops(spark, d, it), g, g.where("group_id in (1, 4)"))[1].select("crop_id", "group_id")


# a registry per region; edits claim digits that may be taken, or be claimed twice
GRP_SQL = """g AS (SELECT n_regionkey::BIGINT AS timeline_id, n_nationkey::BIGINT AS group_id, n_name AS name, '#888888' AS color, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey % 10 END AS digit FROM nation),
g2 AS (SELECT timeline_id, min(group_id) AS group_id, arg_min(name, group_id) AS name, digit FROM g WHERE digit IS NOT NULL GROUP BY timeline_id, digit),
ed AS (SELECT (s_nationkey % 5)::BIGINT AS timeline_id, s_suppkey AS edit_ix, s_suppkey AS group_id, s_name AS name, s_suppkey % 13 AS digit FROM supplier),
cl AS (SELECT * FROM ed WHERE digit < 10), f AS (SELECT timeline_id, digit, min(edit_ix) AS fi, arg_min(name, edit_ix) AS fname FROM cl GROUP BY ALL)"""


@query("i10_upsert_groups_conflicts", "WITH " + GRP_SQL + """ SELECT c.timeline_id, edit_ix, c.digit, coalesce(h.name, f.fname) AS holder FROM cl c
 LEFT JOIN g2 h ON h.timeline_id = c.timeline_id AND h.digit = c.digit LEFT JOIN f ON f.timeline_id = c.timeline_id AND f.digit = c.digit
 WHERE (h.group_id IS NOT NULL AND h.group_id <> c.group_id) OR f.fi < edit_ix""")
def i10(spark, d):
    return _upserts(spark, d)[1].select("timeline_id", "edit_ix", "digit", "holder")


def _upserts(spark, d):
    g = fx.table(spark, d, "nation").selectExpr(
        "cast(n_regionkey as bigint) as timeline_id", "cast(n_nationkey as bigint) as group_id", "n_name as name", "'#888888' as color",
        "case when n_nationkey % 2 = 0 then cast(n_nationkey % 10 as bigint) end as digit")
    g = g.where("digit is not null").groupBy("timeline_id", "digit").agg(
        F.min("group_id").alias("group_id"), F.min_by("name", "group_id").alias("name"), F.min_by("color", "group_id").alias("color"))
    e = fx.table(spark, d, "supplier").selectExpr(
        "cast(s_nationkey % 5 as bigint) as timeline_id", "s_suppkey as edit_ix", "s_suppkey as group_id", "s_name as name", "cast(null as string) as color",
        "case when s_suppkey % 13 < 10 then s_suppkey % 13 end as digit", "s_suppkey % 13 < 10 as set_digit")
    return ed.upsert_groups(g, e)


@query("i10_upsert_groups", "WITH " + GRP_SQL + """, bad AS (SELECT c.timeline_id, edit_ix FROM cl c LEFT JOIN g2 h ON h.timeline_id = c.timeline_id AND h.digit = c.digit
  LEFT JOIN f ON f.timeline_id = c.timeline_id AND f.digit = c.digit WHERE (h.group_id IS NOT NULL AND h.group_id <> c.group_id) OR f.fi < edit_ix),
ok AS (SELECT * FROM ed ANTI JOIN bad USING (timeline_id, edit_ix))
SELECT coalesce(o.timeline_id, h.timeline_id)::BIGINT AS timeline_id, coalesce(o.group_id, h.group_id) AS group_id, coalesce(o.name, h.name) AS name,
 CASE WHEN o.group_id IS NOT NULL AND o.digit < 10 THEN o.digit ELSE h.digit END::BIGINT AS digit
 FROM g2 h FULL JOIN ok o ON o.timeline_id = h.timeline_id AND o.group_id = h.group_id""")
def i10b(spark, d):
    return _upserts(spark, d)[0].select("timeline_id", "group_id", "name", "digit")


@query("i11_apply_marks", with_sql(ITEMS_SQL, TIMELINES_SQL) + """, tot AS (SELECT timeline_id, sum(dur)::BIGINT AS n FROM items GROUP BY timeline_id),
t AS (SELECT timeline_id, in_point, out_point, coalesce(n, 0) - 1 AS last, o_custkey % 3 > 0 AS si, CASE WHEN o_custkey % 10 > 0 THEN 5 * (o_custkey % 14) + o_custkey % 2 END AS im,
  o_custkey % 4 > 0 AS so, CASE WHEN o_custkey % 9 > 0 THEN 5 * (o_custkey % 17) END AS om FROM timelines LEFT JOIN tot USING (timeline_id) JOIN orders ON o_orderkey = timeline_id),
a AS (SELECT *, si AND im IS NOT NULL AND out_point IS NOT NULL AS b, im IN (out_point, out_point + 1) AS hit FROM t),
a2 AS (SELECT *, b AND CASE WHEN hit THEN im >= last ELSE im > out_point END AS rej FROM a),
a3 AS (SELECT *, CASE WHEN si AND NOT rej THEN im ELSE in_point END AS in1, CASE WHEN si AND NOT rej AND b AND hit THEN im + 1 ELSE out_point END AS out1 FROM a2),
a4 AS (SELECT *, so AND om IS NOT NULL AND in1 IS NOT NULL AS b2 FROM a3),
a5 AS (SELECT *, b2 AND CASE WHEN om = in1 THEN in1 <= 0 ELSE om < in1 END AS rej2 FROM a4)
SELECT timeline_id, CASE WHEN so AND NOT rej2 AND b2 AND om = in1 THEN in1 - 1 ELSE in1 END AS in_point, CASE WHEN so AND NOT rej2 THEN om ELSE out1 END AS out_point,
 rej AS in_rejected, rej2 AS out_rejected FROM a5""")
def i11(spark, d):
    tot = fx.items(spark, d).groupBy("timeline_id").agg(F.sum("dur").alias("tl_total"))
    marks = fx.table(spark, d, "orders").selectExpr(
        "o_orderkey as timeline_id", "o_custkey % 3 > 0 as set_in", "case when o_custkey % 10 > 0 then 5 * (o_custkey % 14) + o_custkey % 2 end as in_mark",
        "o_custkey % 4 > 0 as set_out", "case when o_custkey % 9 > 0 then 5 * (o_custkey % 17) end as out_mark")
    return ed.apply_marks(fx.timelines(spark, d), tot, marks)


@query("i18_remove_sources_keep_clips", with_sql(SOURCES_SQL) + """SELECT file_path, source_id FROM sources WHERE source_id % 5 = 0
 UNION ALL SELECT file_path, source_id + 7000000 FROM sources WHERE source_id % 3 = 0 AND source_id % 5 <> 0""")
def i18(spark, d):
    s = fx.sources(spark, d)
    old = s.where("source_id % 3 = 0").selectExpr("file_path", "source_id + 7000000 as source_id")
    return st.remove_sources(s, fx.items(spark, d), old, s.where("source_id % 5 = 0"), keep_clips=True)[2]
