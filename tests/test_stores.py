"""Flat frame files of any length, version folders, packet folders and files written by tasks."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shotweave.sources import files as fl, packets as pk, stores


def test_a_file_of_over_two_gigabytes(spark):
    """Sparse, read in many tasks; the last record is what was written there."""
    folder, size, n = tempfile.mkdtemp(prefix="spark-"), 24 << 20, 95
    with open(f"{folder}/long.bin", "wb") as f:
        f.truncate(size * n + 5)
        f.seek(size * (n - 1))
        f.write(b"end")
    assert os.path.getsize(f"{folder}/long.bin") > 2 << 30
    rows = stores.read_frame_store(spark, folder, frame_bytes=size)
    assert rows.rdd.getNumPartitions() > 40
    got = rows.select("source_id", "frame_ix", F.substring("pixels", 1, 3).cast("string").alias("head"), F.length("pixels").alias("n")).collect()
    assert len(got) == n and {r["n"] for r in got} == {size}
    assert [r["frame_ix"] for r in got if r["head"] == "end"] == [n - 1]


def test_flat_store_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = [("s", k, bytes([k % 251, 1, 2])) for k in range(25) if k != 7] + [("t-1", 3, b"abc")]
    offsets = stores.write_flat_store(spark.createDataFrame(rows, "source_id string, frame_ix long, pixels binary"), folder, frame_bytes=3, records=10)
    assert sorted(os.listdir(folder)) == ["s-0.bin", "s-1.bin", "s-2.bin", "t-1-0.bin"]
    found = stores.read_frame_store(spark, folder, offsets.select(F.col("file_id").alias("source_id"), "frame_offset"), frame_bytes=3, range_bytes=6)
    got = {(r["source_id"].rsplit("-", 1)[0], r["frame_ix"]): bytes(r["pixels"]) for r in found.collect()}
    assert {k: v for k, v in got.items() if v != b"\0\0\0"} == {(s, n): p for s, n, p in rows} and got["s", 7] == b"\0\0\0"
    wrong = spark.createDataFrame([("s", 0, b"ab")], "source_id string, frame_ix long, pixels binary")
    with pytest.raises(Exception, match="2 bytes instead of 3"):
        stores.write_flat_store(wrong, folder + "x", frame_bytes=3)


def test_short_and_missing_files(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    for name, data in (("a.bin", b"1234"), ("b.bin", b""), ("c.txt", b"123456"), ("d.bin", b"123456789")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    got = stores.read_frame_store(spark, folder, frame_bytes=4).collect()
    assert sorted((r["source_id"], r["frame_ix"], bytes(r["pixels"])) for r in got) == [("a", 0, b"1234"), ("d", 0, b"1234"), ("d", 1, b"5678")]
    assert stores.read_frame_store(spark, folder, frame_bytes=100).collect() == []


def test_versions_of_equal_names_in_two_folders(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    name = "2024-01-05_10-00-00_auto-save.project"
    doc = '{"sources": [], "clips": [{"id": "c"}]}'
    files = [(f"p/{name}", doc), (f"q r/{name}", doc), ("p/index.json", '{"versions": [{"filename": "%s", "timestamp": "2024-01-05T10:00:00", "clip_count": 9}, {"filename": "gone.project", "timestamp": "x"}]}' % name)]
    fl.write_files(spark.createDataFrame(files, "path string, content string"), root).collect()
    assert sorted(os.listdir(f"{root}/p")) == [name, "index.json"]
    got = {r["folder"].rsplit("/", 1)[1]: (r["derived"], r["clip_count"]) for r in stores.read_versions(spark, f"{root}/*").collect()}
    assert got == {"p": (False, 9), "q r": (True, 1)}


def test_packets_by_file_and_by_folder(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    with open(f"{root}/movie.txt", "w") as f:
        f.write("1.5,\n\nN/A\n0.5\n")
    assert [tuple(r) for r in pk.read_packets(spark, root).orderBy("pts_ix").collect()] == [("movie", 0, 0.5), ("movie", 1, 1.5)]
    pk.write_packets(spark.createDataFrame([("a b", 2.0), ("a b", 1.0), ("c", 3.0)], "source_id string, pts double"), f"{root}/w")
    assert sorted(tuple(r) for r in pk.read_packets(spark, f"{root}/w").collect()) == [("a b", 0, 1.0), ("a b", 1, 2.0), ("c", 0, 3.0)]


def test_small_flat_files_share_tasks():
    """A task for every file, or every range of a few records, would cost more than reading it."""
    reader = fl._Reader([[f"/x/{k}.bin", 120] for k in range(1000)] + [["/x/long.bin", 12 * 100001]], 12, 12 * 4)
    small = fl._Reader([[f"/x/{k}.bin", 120] for k in range(1000)], 12, 12 * 4).partitions()
    assert len(small) == -(-3000 // fl.TASK_RANGES)
    wide = fl._Reader([["/x/long.bin", 3 * fl.RANGE_BYTES]], 16, fl.RANGE_BYTES).partitions()
    assert [len(t.ranges) for t in wide] == [1, 1, 1]
    found = [r for t in reader.partitions() for r in t.ranges]
    assert len(set(found)) == len(found) and sum(n for _, _, n in found) == 10 * 1000 + 100001


def test_packets_of_small_sources_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id % 200 as source_id", "cast(id as string) as pts")
    pk.write_packets(rows.coalesce(1), str(tmp_path / "p"))
    parts = {n.split("-")[1] for _, _, names in os.walk(tmp_path / "p") for n in names if n.startswith("part-")}
    assert len(parts) >= spark.sparkContext.defaultParallelism
    got = pk.read_packets(spark, str(tmp_path / "p"))
    assert got.count() == 4000 and got.where("source_id = '7'").agg({"pts_ix": "max"}).first()[0] == 19


def test_frame_store_has_no_file_per_source(spark):
    out = tempfile.mkdtemp(prefix="spark-") + "/s"
    frames = spark.range(3000).selectExpr("id div 3 as source_id", "id % 3 as frame_ix", "cast(cast(id as string) as binary) as pixels")
    stores.write_frame_store(frames, out)
    assert sum(n.endswith(".parquet") for _, _, names in os.walk(out) for n in names) < 300
    back = stores.get_frames(spark.read.parquet(out), spark.createDataFrame([(999, 2), (7, 5)], "source_id long, frame_ix long"))
    assert {(r["source_id"], r["frame_ix"], r["pixels"] and bytes(r["pixels"])) for r in back.collect()} == {(999, 2, b"2999"), (7, 5, None)}
