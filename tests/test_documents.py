"""Round trips of documents and stores."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from shotweave.operators import audit as au
from shotweave.plans import export as ex
from shotweave.sources import documents, interchange as ic, packets as pk, projects as pj, stores
from test_timeline import BASIC, STRESS, make_items, marks, sources


def folder():
    return tempfile.mkdtemp(prefix="spark-")


DOC = {
    "version": 1, "in_point": 10, "out_point": 200,
    "sources": [{"id": "s1", "file_path": "C:\\m\\a.mov", "total_frames": 900, "fps": 24.0, "width": 1920, "height": 1080, "codec": "h264"}],
    "groups": [{"id": "g1", "name": "Ann", "color": "#112233", "digit": 3}, {"id": "g2"}],
    "clips": [
        {"id": "c1", "source_id": "s1", "source_in": 0, "source_out": 99, "label": "x", "color_index": 2, "group_ids": ["g2", "gone", "g1"],
         "crop_regions": [
             {"id": "k1", "x": 1, "y": 2, "w": 30, "h": 40, "group_id": "gone", "anchor_frame": 7,
              "x_track": {"keys": [{"source_frame": 9, "value": 2.0, "interp": "odd"}, {"source_frame": 3, "value": 1.0, "interp": "bezier", "out_handle": [1.5, -2.0]}]}},
             {"id": "k2", "segments": [{"id": "z1", "anchor_frame": 4}, {"id": "z2", "anchor_frame": 8, "active": False}], "group_id": "g1", "active": False, "label": "lab"}]},
        {"id": "c2", "source_id": None, "source_in": 0, "source_out": 9},
        {"id": "c3", "source_id": "s1", "source_in": 200, "source_out": 260, "group_ids": []}],
    "orphan_paths": {"C:\\old \"q\".mov": "s9"},
}


def _rows(t, name, *order):
    return [tuple(r) for r in t[name].drop("version").orderBy(*order).collect()]


def _snapshot(t):
    return {n: _rows(t, n, *o) for n, o in {
        "sources": ["timeline_id", "source_ix"], "timelines": ["timeline_id"], "items": ["timeline_id", "item_ix"], "groups": ["timeline_id", "group_ix"],
        "crops": ["timeline_id", "crop_id"], "segments": ["timeline_id", "crop_id", "segment_ix"], "keyframes": ["timeline_id", "crop_id", "axis", "source_frame"], "orphans": ["timeline_id", "file_path"]}.items()}


def test_project_read_defaults_and_round_trip(spark, tiny_chunks, monkeypatch):
    src = folder()
    for name in ("p1", "p2"):
        with open(os.path.join(src, name + ".json"), "w") as f:
            json.dump(DOC, f, indent=2)
    t = pj.read_projects(spark, src)
    one = {n: d.where("timeline_id = 'p1'") if "timeline_id" in d.columns else d for n, d in t.items()}
    items = one["items"].orderBy("item_ix").collect()
    assert [i.clip_id for i in items] == ["c1", "c2", "c3"] and items[0].group_ids == ["g2", "g1"] and items[1].source_id is None
    crops = {c.crop_id: c for c in one["crops"].collect()}
    assert crops["k1"].group_id is None and crops["k2"].group_id == "g1" and crops["k1"].aspect_ratio == "free"
    assert [(s.anchor_frame, s.active) for s in one["segments"].where("crop_id = 'k1'").collect()] == [(7, True)]
    keys = one["keyframes"].orderBy("source_frame").distinct().orderBy("source_frame").collect()
    assert [(k.source_frame, k.interp, k.out_dx) for k in keys] == [(3, "bezier", 1.5), (9, "linear", 0.0)]
    assert one["groups"].where("group_id = 'g2'").first().color == "#888888"

    # both copies share all their ids
    out = os.path.join(folder(), "out")
    monkeypatch.setattr(documents, "BLOCK_LINES", 4)  # several blocks per document
    pj.write_projects(t, out)
    assert _snapshot(pj.read_projects(spark, out)) == _snapshot(t)
    assert one["segments"].count() * 2 == t["segments"].count() and one["keyframes"].count() * 2 == t["keyframes"].count()
    plan = ex.export_plan(t["items"], t["sources"], t["timelines"].select("timeline_id", "in_point", "out_point"))
    assert plan.count() == 2 * plan.where("timeline_id = 'p1'").count() > 0
    counts = pj.peek_counts(spark, out).first()
    assert (counts.clip_count, counts.source_count) == (3, 1)


def test_otio_round_trip(spark, tiny_chunks):
    out = os.path.join(folder(), "o")
    plan = ex.export_plan(make_items(spark, BASIC), sources(spark), marks(spark), ex.ExportOptions(include_gaps=True))
    ic.write_otio(plan, sources(spark), out)
    kids = ic.read_otio(spark, out)
    rows = kids.orderBy("child_ix").collect()
    assert [(r.kind, r.start_value, r.duration_value) for r in rows] == [
        ("clip", 100.25, 100), ("gap", 0, 50), ("clip", 300.25, 100), ("clip", 500.25, 50)]
    assert rows[0].avail_duration == 20000 and rows[0].target_url == "file:///m/movie.mov"
    a = au.audit_interchange(kids.withColumn("source_id", F.lit("s")), sources(spark)).first()
    assert (a.n_clips, a.n_gaps, a.bad_schema, a.bad_gaps, a.bad_avail_start, a.bad_avail_duration) == (3, 1, 0, 0, 0, 0)
    text = documents.read_texts(spark, out).first().text
    doc = json.loads(text)
    assert doc["OTIO_SCHEMA"] == "Timeline.1" and len(doc["tracks"]["children"][0]["children"]) == 4


def test_fcpxml_round_trip(spark, tiny_chunks):
    import xml.etree.ElementTree as ET

    out = os.path.join(folder(), "x")
    it, s, m = make_items(spark, STRESS), sources(spark), marks(spark, 35, 220)
    plan = ex.export_plan(it, s, m)
    seq = ex.export_extent(it, m).selectExpr("timeline_id", "n_frames as seq_frames")
    ic.write_fcpxml(plan, s, seq, out)
    rows = ic.read_fcpxml(spark, out).orderBy("clip_ix").collect()
    assert [(r.start_num, r.start_den, r.duration_num, r.offset_num) for r in rows] == [
        (n * 1001 + 500, 24000, d * 1001, o * 1001) for n, d, o in ((85, 35, 0), (4444, 40, 35), (211, 91, 75))]
    root = ET.fromstring(documents.read_texts(spark, out).first().text.split("<!DOCTYPE fcpxml>")[1])
    assert root.get("version") == "1.9" and len(root.findall("resources/asset")) == 1
    assert root.find("library/event/project/sequence").get("duration") == f"{166 * 1001}/24000s"
    assert root.find("resources/asset/media-rep").get("src") == "file:///m/movie.mov"


def test_frame_store(spark):
    d = folder()
    with open(os.path.join(d, "src1.bin"), "wb") as f:
        f.write(bytes(range(10)) + b"xx")
    off = spark.createDataFrame([("src1", 100)], "source_id string, frame_offset long")
    store = stores.read_frame_store(spark, d, off, frame_bytes=5)
    assert [(r.frame_ix, bytes(r.pixels)) for r in store.orderBy("frame_ix").collect()] == [(100, bytes(range(5))), (101, bytes(range(5, 10)))]
    out = os.path.join(folder(), "s")
    stores.write_frame_store(store, out)
    back = spark.read.parquet(out)
    assert back.count() == 2
    want = spark.createDataFrame([("src1", 101), ("src1", 102)], "source_id string, frame_ix long")
    assert [r.pixels is None for r in stores.get_frames(back, want).orderBy("frame_ix").collect()] == [False, True]


def test_packets_text(spark, tiny_chunks):
    d = folder()
    with open(os.path.join(d, "clip.csv"), "w") as f:
        f.write("0.5,\n\nN/A\n0.25\nbad\n0.75\n")
    rows = pk.read_packets(spark, d).orderBy("pts_ix").collect()
    assert [(r.source_id, r.pts_ix, r.pts_time) for r in rows] == [("clip", 0, 0.25), ("clip", 1, 0.5), ("clip", 2, 0.75)]


def test_versions_folder(spark):
    d = folder()
    names = ["2026-05-10_14-23-45_autosave.project", "2026-05-11_10-00-00_pre-detect-cuts.project", "notes.project"]
    for n in names:
        with open(os.path.join(d, n), "w") as f:
            json.dump({"clips": [{"id": "a"}, {"id": "b"}], "sources": [{"id": "s"}]}, f)
    with open(os.path.join(d, "index.json"), "w") as f:
        json.dump({"versions": [
            {"filename": names[0], "timestamp": "2026-05-10T14:23:45", "trigger": "autosave", "clip_count": 9},
            {"filename": "lost.project", "timestamp": "2026-01-01T00:00:00"}]}, f)
    rows = {r.filename: r for r in stores.read_versions(spark, d).collect()}
    assert set(rows) == set(names[:2])
    assert rows[names[0]].clip_count == 9 and not rows[names[0]].derived
    o = rows[names[1]]
    assert (o.derived, o.trigger, o.clip_count, o.source_count, o.timestamp) == (True, "pre_detect_cuts", 2, 1, "2026-05-11T10:00:00")
    os.remove(os.path.join(d, "index.json"))
    rows = stores.read_versions(spark, d).collect()
    assert {r.filename for r in rows} == set(names[:2]) and all(r.derived for r in rows)
    empty = folder()
    with open(os.path.join(empty, "readme.txt"), "w") as f:
        f.write("x")
    assert stores.read_versions(spark, empty).collect() == []


def test_broken_projects_are_rejected(spark):
    src = folder()
    for name, text in (("good", json.dumps(DOC)), ("cut", json.dumps(DOC)[:90]), ("empty", "")):
        with open(os.path.join(src, name + ".json"), "w") as f:
            f.write(text)
    t = pj.read_projects(spark, src)
    assert {r.timeline_id for r in t["timelines"].collect()} == {"good"}
    assert "cut" in {r.timeline_id for r in t["rejects"].collect()}
    assert {r.timeline_id for r in t["items"].collect()} == {"good"}


def test_crop_manifest(spark):
    out = os.path.join(folder(), "m")
    jobs = spark.createDataFrame([("k1", "/out/Ann"), ("k2", "/out/_untagged")], "crop_id string, folder string")
    stores.write_crop_manifest(jobs, out)
    assert sorted(os.listdir(out))[:0] == [] and {r.group_slug for r in spark.read.json(out).collect()} == {"Ann", "_untagged"}


def test_document_lines_are_parsed_once(spark):
    """Fields taken from one parse: a call for each field would read every line again."""
    from shotweave.queries import load_all

    for name in ("a2_project_clip_lines", "a8_otio_children"):
        plan = load_all()[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1, name
