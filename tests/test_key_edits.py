"""Logs of key edits, all kinds interleaved, against a plain list of keys; and clips inserted between the crops of others."""

import random

import pytest
from pyspark.sql import functions as F

from shotweave.operators import edits as ed, keyframes as kf
from test_timeline import ITEM

KEYS = "timeline_id string, crop_id string, axis string, source_frame long, value double, interp string, in_dx double, in_dy double, out_dx double, out_dy double"
EDITS = ("timeline_id string, crop_id string, axis string, pair string, kind string, source_frame long, new_frame long, value double, interp string, "
         "in_dx double, in_dy double, out_dx double, out_dy double, edit_seq long")


class Track:
    """Keys in frame order, as an editor would hold them."""

    def __init__(self):
        self.keys = []

    def find(self, frame):
        return next((k for k in self.keys if k["frame"] == frame), None)

    def put(self, frame, value, interp):
        k = self.find(frame)
        if k is None:
            self.keys.append({"frame": frame, "value": value, "interp": interp, "hands": [0.0] * 4})
        else:
            if k["interp"] != interp:
                k["hands"] = [0.0] * 4
            k["value"], k["interp"] = value, interp

    def drop(self, frame):
        self.keys = [k for k in self.keys if k["frame"] != frame]

    def edit(self, e):
        k = self.find(e["source_frame"])
        hands = [e[c] for c in ("in_dx", "in_dy", "out_dx", "out_dy")]
        match e["kind"]:
            case "set":
                self.put(e["source_frame"], e["value"], e["interp"] or "linear")
            case "delete":
                self.drop(e["source_frame"])
            case "toggle":
                self.drop(e["source_frame"]) if k else self.put(e["source_frame"], e["value"], e["interp"] or "linear")
            case "move" if k:
                self.drop(e["source_frame"])
                self.drop(e["new_frame"])
                self.keys.append({**k, "frame": e["new_frame"], "value": e["value"]})
            case "shape" if k:
                k["interp"], k["hands"] = e["interp"], [h or 0.0 for h in hands]
            case "handles" if k:
                k["hands"] = [old if h is None else h for h, old in zip(hands, k["hands"], strict=True)]
            case "pair" if k:
                k["interp"] = e["interp"]


def test_seeded_logs(spark):
    rnd = random.Random(1337)
    tracks = {(t, c, a): Track() for t in "pq" for c in ("k", "m") for a in "xywh"}
    start, log = [], []
    for (t, c, a), track in tracks.items():
        for f in rnd.sample(range(0, 40, 2), 8):
            hands = [float(rnd.randint(-3, 3)) for _ in range(4)]
            start.append((t, c, a, f, float(f), rnd.choice(["linear", "step", "bezier"]), *hands))
            track.keys.append({"frame": f, "value": float(f), "interp": start[-1][5], "hands": list(hands)})
    for seq in range(900):
        t, c, a = rnd.choice(sorted(tracks))
        if (t, c) == ("q", "m") and a in "xy":  # tracks without moves are folded frame by frame
            kind = rnd.choice([k for k in kf.EDIT_KINDS if k != "move"])
        else:
            kind = rnd.choice(kf.EDIT_KINDS)
        hands = [rnd.choice([None, 1.5, -2.0]) for _ in range(4)]
        e = {"timeline_id": t, "crop_id": c, "axis": None if kind == "pair" else a, "pair": rnd.choice(["position", "size"]) if kind == "pair" else None, "kind": kind,
             "source_frame": rnd.randrange(40), "new_frame": rnd.randrange(40) if kind == "move" else None, "value": float(seq),
             "interp": rnd.choice(["linear", "step", "bezier"] + [None] * (kind in ("set", "toggle"))), **dict(zip(("in_dx", "in_dy", "out_dx", "out_dy"), hands, strict=True)), "edit_seq": seq}
        log.append(tuple(e.values()))
        for axis in {"position": "xy", "size": "wh"}.get(e["pair"], a):
            tracks[t, c, axis].edit(e)
    got = kf.edit_keys(spark.createDataFrame(start, KEYS), spark.createDataFrame(log, EDITS).repartition(5)).collect()
    want = sorted((t, c, a, k["frame"], k["value"], k["interp"], *k["hands"]) for (t, c, a), track in tracks.items() for k in track.keys)
    assert sorted(tuple(r) for r in got) == want


def test_edges_of_logs(spark):
    keys = spark.createDataFrame([("t", "k", "x", 1, 1.0, "linear", 0.0, 0.0, 0.0, 0.0)], KEYS)
    none = spark.createDataFrame([], EDITS)
    assert [tuple(r) for r in kf.edit_keys(keys, none).collect()] == [tuple(keys.first())]
    bare = spark.createDataFrame([("t", "k", "x", "set", 5, 2.0, 1)], "timeline_id string, crop_id string, axis string, kind string, source_frame long, value double, edit_seq long")
    assert {(r["source_frame"], r["interp"]) for r in kf.edit_keys(keys, bare).collect()} == {(1, "linear"), (5, "linear")}
    assert kf.edit_keys(keys.where("false"), bare.withColumn("kind", F.lit("delete"))).collect() == []
    with pytest.raises(Exception, match="unknown kind of key edit: paint"):
        kf.edit_keys(keys, bare.withColumn("kind", F.lit("paint"))).collect()


def test_insert_hands_crops_on(spark):
    """A clip inserted into a cropped clip: segments and keys follow their frame, the left piece keeps the clip's id, whole clips keep their crops."""
    items = spark.createDataFrame([("t", 1, "c1", "s", 100, 149, "", 5, []), ("t", 2, "c2", "s", 0, 9, "", 6, [])], ITEM)
    new = spark.createDataFrame([("t", 20, 1, "n1", "s", 0, 4, "", 0, []), ("t", 20, 2, "n2", None, 0, 1, "", 0, []), ("t", 20, 3, "n3", "s", 0, 4, "", 0, []), ("t", 0, 0, "n0", "s", 0, 4, "", 0, [])],
                                "timeline_id string, tl_frame long, ins_ix long, clip_id string, source_id string, source_in long, source_out long, label string, color_index int, group_ids array<string>")
    pieces = ed.insert_items(items, new, parents=True, color_start=6)
    rows = [(r["clip_id"] if r["clip_id"] == r["parent_id"] else "+" + r["parent_id"], r["source_in"], r["source_out"], r["color_index"]) for r in pieces.orderBy("item_ix").collect()]
    assert rows == [("n0", 0, 4, 6), ("c1", 100, 119, 5), ("n1", 0, 4, 7), ("n2", 0, 1, 0), ("n3", 0, 4, 0), ("+c1", 120, 149, 5), ("c2", 0, 9, 6)]
    crops = spark.createDataFrame([("t", "c1", "both"), ("t", "c1", "left"), ("t", "c1", "bare"), ("t", "c2", "other")], "timeline_id string, clip_id string, crop_id string")
    segments = spark.createDataFrame([("t", c, f"{c}{a}", a) for c, a in (("both", 105), ("both", 130), ("left", 119), ("other", 3))], "timeline_id string, crop_id string, segment_id string, anchor_frame long")
    keys = spark.createDataFrame([("t", c, "x", 110) for c in ("both", "left", "other")], "timeline_id string, crop_id string, axis string, source_frame long")
    moved, segs, handed = ed.partition_by_pieces(crops, segments, keys, pieces)
    right = next(r["clip_id"] for r in pieces.collect() if r["clip_id"] != r["parent_id"])
    assert sorted(r["clip_id"] for r in moved.collect()) == sorted(["c1"] * 3 + [right, "c2"])
    where = {r["crop_id"]: r["clip_id"] for r in moved.collect()}
    assert sorted((where[r["crop_id"]], r["anchor_frame"]) for r in segs.collect()) == sorted([("c1", 105), (right, 130), ("c1", 119), ("c2", 3)])
    assert sorted(where[r["crop_id"]] for r in handed.collect()) == sorted(["c1", "c1", right, "c2"])
