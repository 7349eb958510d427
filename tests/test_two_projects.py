"""Two projects that use the same ids: every operator keeps them apart."""

import pytest
from pyspark.sql import functions as F

from shotweave.operators import audit as au, edits as ed, joins as j, source_tables as st
from shotweave.plans import export as ex, thumbs as th
from shotweave.sources import interchange as ic
from test_timeline import ITEM, SRC

A, B = "a", "b"


@pytest.fixture(scope="module")
def items(spark):
    rows = [(t, k, f"c{k}", "s1", 10 * k, 10 * k + 9, "", 0, []) for t in (A, B) for k in (1, 2)]
    rows += [(A, 3, "c3", "only_a", 0, 9, "", 0, []), (B, 3, "c3", "s2", 0, 9, "", 0, [])]
    return spark.createDataFrame(rows, ITEM)


@pytest.fixture(scope="module")
def sources(spark):
    one = ("s1", "/a/light.mov", 100, 24.0, 1920, 1080, "h264", "aac", 48000, 2, 1, 24000)
    two = ("s1", "/b/heavy.mov", 700, 25.0, 3840, 2160, "prores", "aac", 48000, 2, 1, 25000)
    rows = [(A, *one), (B, *two), (A, "only_a", "/a/x.mov", *one[2:]), (B, "s2", "/b/y.mov", *two[2:])]
    return spark.createDataFrame(rows, "timeline_id string, " + SRC)


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(A, None, None), (B, None, None)], "timeline_id string, in_point long, out_point long")


@pytest.fixture(scope="module")
def plan(spark, items, sources, marks):
    return ex.export_plan(items, sources, marks, ex.ExportOptions())


def test_documents(spark, plan, sources, tmp_path):
    ic.write_otio(plan, sources, str(tmp_path / "j"))
    kids = ic.read_otio(spark, str(tmp_path / "j"))
    found = {(r["doc_id"], r["target_url"], r["avail_duration"]) for r in kids.collect()}
    assert kids.count() == 6 and len(found) == 4
    assert {x[2] for x in found if x[0] == A} == {100.0} and {x[2] for x in found if x[0] == B} == {700.0}
    named = kids.withColumn("source_id", F.when(F.col("target_url").contains("/light") | F.col("target_url").contains("/heavy"), "s1").when(F.col("target_url").contains("/x"), "only_a").otherwise("s2"))
    for r in au.audit_interchange(named, sources).collect():
        assert (r["n_clips"], r["bad_avail_duration"], r["bad_avail_start"]) == (3, 0, 0)
    frames = plan.groupBy("timeline_id").agg(F.sum("frame_count").alias("seq_frames"))
    lines = [r for r in ic.fcpxml_lines(plan, sources, frames).collect()]
    assert sum("<asset " in r["line"] for r in lines) == 4 and sum("<asset-clip " in r["line"] for r in lines) == 6


def test_audit(spark, items, sources):
    keys = spark.createDataFrame([(t, "k", "x", 5) for t in (A, B)], "timeline_id string, crop_id string, axis string, source_frame long")
    assert au.audit_timelines(items, sources, keyframes=keys).collect() == []
    lost = sources.where("not (timeline_id = 'a' and source_id = 'only_a')")
    lost = lost.union(sources.where("source_id = 'only_a'").withColumn("timeline_id", F.lit(B)))
    assert [(r["rule"], r["key"], r["n"]) for r in au.audit_timelines(items, lost).collect()] == [("unknown_source", A, 1)]
    twice = keys.union(keys.where("timeline_id = 'b'"))
    assert [(r["rule"], r["n"]) for r in au.audit_timelines(items, sources, keyframes=twice).collect()] == [("key_repeats", 1)]


def test_removal_and_revival(spark, items, sources):
    none = spark.createDataFrame([], "timeline_id string, file_path string, source_id string")
    removed = spark.createDataFrame([(A, "s1")], "timeline_id string, source_id string")
    left, _, orphans = st.remove_sources(sources, items, none, removed, keep_clips=True)
    assert {(r["timeline_id"], r["source_id"]) for r in left.collect()} == {(A, "only_a"), (B, "s1"), (B, "s2")}
    assert [tuple(r) for r in orphans.select("timeline_id", "file_path", "source_id").collect()] == [(A, "/a/light.mov", "s1")]
    _, kept, _ = st.remove_sources(sources, items, none, removed, keep_clips=False)
    assert {r["timeline_id"] for r in kept.where("source_id = 's1'").collect()} == {B}
    imports = spark.createDataFrame([(A, "/a/light.mov", "new"), (B, "/a/light.mov", "new")], "timeline_id string, file_path string, source_id string")
    got = st.revive_orphans(imports, orphans, left)
    assert {(r["timeline_id"], r["source_id"], r["revived"]) for r in got.collect()} == {(A, "s1", True), (B, "new", False)}
    assert st.remaining_orphans(orphans, got).collect() == []


def test_lookups(spark):
    keys = spark.createDataFrame([(A, "k", "x", 5), (A, "k", "x", 50), (B, "k", "x", 20)], "timeline_id string, crop_id string, axis string, source_frame long")
    points = spark.createDataFrame([(A, "k", "x", 30), (B, "k", "x", 30)], "timeline_id string, crop_id string, axis string, frame long")
    assert {tuple(r) for r in j.neighbour_keys(points, keys).select("timeline_id", "prev_key", "next_key").collect()} == {(A, 5, 50), (B, 20, None)}
    segs = spark.createDataFrame([(A, "k", 0, 0, 10), (A, "k", 1, 8, 10), (B, "k", 0, 5, 10)], "timeline_id string, crop_id string, segment_ix long, anchor long, window_frames long")
    assert [tuple(r) for r in j.segment_overlaps(segs).select("timeline_id", "ix_a", "ix_b", "shared_lo", "shared_hi").collect()] == [(A, 0, 1, 8, 10)]
    crops = spark.createDataFrame([(A, "k", "g"), (B, "k", "g"), (B, "m", None)], "timeline_id string, crop_id string, group_id string")
    folders = spark.createDataFrame([(A, "g", "/a"), (B, "g", "/b"), (B, None, "/none"), (A, None, "")], "timeline_id string, group_id string, folder string")
    assert {tuple(r) for r in j.route_crops(crops, folders).select("timeline_id", "crop_id", "folder").collect()} == {(A, "k", "/a"), (B, "k", "/b"), (B, "m", "/none")}
    packets = spark.createDataFrame([(A, "s", 0.0, 0), (A, "s", 1.0, 1), (B, "s", 0.5, 0)], "timeline_id string, source_id string, pts_time double, pts_ix long")
    seeks = spark.createDataFrame([(1, A, "s", 1.2, None), (2, B, "s", 1.2, 0.0), (3, A, "s", 1.2, 0.0), (4, "c", "s", 1.2, 0.0)], "n long, timeline_id string, source_id string, seek double, start_time double")
    assert {r["n"]: r["pts_k"] for r in j.bracket_pts(seeks, packets).collect()} == {1: 1, 2: 0, 3: 1, 4: -1}


def test_thumbnails(items, sources, marks):
    got = th.thumbnail_plan(items, sources, marks).where("source_id = 's1'").collect()
    assert {(r["timeline_id"], r["media_class"]) for r in got} == {(A, "light"), (B, "heavy")}
    assert sum(r["n_frames"] for r in got if r["timeline_id"] == A) == sum(r["n_frames"] for r in got if r["timeline_id"] == B) == 4


def test_partition(spark):
    crops = spark.createDataFrame([(t, "c", "k") for t in (A, B)], "timeline_id string, clip_id string, crop_id string")
    segs = spark.createDataFrame([(t, "k", f"{t}{a}", a) for t in (A, B) for a in (1, 9)], "timeline_id string, crop_id string, segment_id string, anchor_frame long")
    splits = spark.createDataFrame([(A, "c", 5, "cL", "cR")], "timeline_id string, clip_id string, split_frame long, left_id string, right_id string")
    new, moved = ed.partition_crops(crops, segs, splits)
    assert sorted((r["timeline_id"], r["clip_id"]) for r in new.collect()) == [(A, "cL"), (A, "cR"), (B, "c")]
    assert {r["crop_id"] for r in moved.where("timeline_id = 'b'").collect()} == {"k"} and moved.count() == 4
