"""What writers leave on disk once their files are there."""

import os

from pyspark.sql import functions as F, types as T

from shotweave.session import materialize, shared_dir
from shotweave.sources import documents as dc, interchange as ic


def stored(spark):
    folder = os.path.join(shared_dir(spark), "shotweave")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def parts(spark):
    return spark.range(40).selectExpr("id % 4 as timeline_id", "1 as section", "id as ix", "0 as part", "concat('line ', id) as text", "true as element")


def test_written_documents_leave_no_intermediates(spark, tmp_path):
    before = stored(spark)
    dc.write_lines(parts(spark), str(tmp_path / "docs"))
    assert stored(spark) == before
    assert len(spark.read.text(str(tmp_path / "docs")).collect()) == 40


def test_written_xml_leaves_no_intermediates(spark, tmp_path):
    plan = spark.sql("""select 1L as timeline_id, id as item_ix, concat('c', id) as clip_id, id % 2 as source_id, concat('/m/', id % 2, '.mov') as file_path,
      '' as label, 0 as color_index, id as src_in, 10L as frame_count, 25D as fps, 10 * id as offset_in_range, 10 * id as offset_packed from range(6)""")
    sources = spark.sql("select id as source_id, concat('/m/', id, '.mov') as file_path, 90L as total_frames, 64 as width, 48 as height, 0 as audio_channels, 0 as audio_sample_rate from range(2)")
    before = stored(spark)
    ic.write_fcpxml(plan, sources, spark.sql("select 1L as timeline_id, 60L as seq_frames"), str(tmp_path / "xml"))
    assert stored(spark) == before
    assert ic.read_fcpxml(spark, str(tmp_path / "xml")).count() == 6


def test_stored_tables_leave_no_shuffle(spark):
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b.toString() for b in _each(local.getAllBlocks()) if b.toString().startswith("shuffle_")}
    before = shuffles()
    found = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not shuffles() - before
    assert found.count() == 7


def _each(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def test_lines_that_stay_together_are_one_row(spark):
    """An XML document's fixed lines are three rows, an asset's lines one; numbered they are lines again."""
    plan = spark.sql("""select 1L as timeline_id, id as item_ix, concat('c', id) as clip_id, id % 2 as source_id, concat('/m/', id % 2, '.mov') as file_path,
      '' as label, 0 as color_index, id as src_in, 10L as frame_count, 25D as fps, 10 * id as offset_in_range, 10 * id as offset_packed from range(6)""")
    sources = spark.sql("select id as source_id, concat('/m/', id, '.mov') as file_path, 90L as total_frames, cast(null as int) as width, 48 as height, 2 as audio_channels, 0 as audio_sample_rate from range(2)")
    made = ic.fcpxml_parts(plan, sources, spark.sql("select 1L as timeline_id, 60L as seq_frames"))
    assert made.count() == 3 + 2 + 6
    lines = [(r["line_no"], r["line"]) for r in dc.number_lines(made).orderBy("line_no").collect()]
    assert [n for n, _ in lines] == list(range(29))
    assert lines[4][1] == '    <format id="r1" name="FFVideoFormat25" frameDuration="100/2500s" width="null" height="48" colorSpace="1-1-1 (Rec. 709)"/>'
    assert lines[5][1] == '    <asset id="r2" name="0" start="0s" duration="9000/2500s" hasVideo="1" format="r1" videoSources="1" hasAudio="1" audioSources="1" audioChannels="2" audioRate="48000">'
    assert lines[9][1] == '      <media-rep kind="original-media" src="file:///m/1.mov"/>'
    assert lines[-1][1] == "</fcpxml>"


def test_a_document_is_one_file(spark, tmp_path):
    """No second file and no folder of a task for each document: on a local disk each of them is made by a process of its own."""
    odd = ["a", "b+c d", "50%/x", "é=1"]
    rows = spark.createDataFrame([(k, 1, i, 0, f"{k} {i}", True) for k in odd for i in range(5)], "timeline_id string, section int, ix long, part int, text string, element boolean")
    for compression in ("none", "gzip"):
        path = tmp_path / compression
        dc.write_lines(rows, str(path), compression=compression)
        files = [p for p in path.rglob("*") if p.is_file() and not p.name.startswith("_")]
        assert len(files) == len(odd) and all(p.parent.name == "block=0" for p in files)
        lines = dc.read_lines(spark, str(path), lambda line: F.when(line == "none", "none")).orderBy("doc_id", "line_no").collect()
        assert [(r["doc_id"], r["line"]) for r in lines] == [(k, f"{',' if i else ''}{k} {i}") for k in sorted(odd) for i in range(5)]
    dc.write_lines(rows.where("ix < 2"), str(path), "overwrite", "gzip")
    assert dc.read_texts(spark, str(path)).where("doc_id = 'a'").first()["text"] == "a 0\n,a 1\n"


def test_an_element_is_parsed_once(spark):
    """Only what does not fit its kind is looked at a second time, and told from what is no value at all."""
    lines = spark.createDataFrame([("d", k, x, "children", 0) for k, x in enumerate(["[", '{"name": "a"}', ',{"name": "b"}', ',{"name": "c"', ",5", ',{"name": [1]}'])],
                                  "doc_id string, line_no long, line string, section string, head long")
    found = dc.elements(lines, T.StructType([T.StructField("name", T.StringType())]), "children")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and ".broken, $)" in plan
    got = sorted((r["ix"], r["e"]["name"] if r["e"] else None, r["bad"]) for r in found.collect())
    assert got == [(0, "a", False), (1, "b", False), (2, None, True), (3, None, False), (4, "[1]", False)]


def test_short_documents_are_not_gathered(spark, tmp_path):
    """A document of one file is read without a shuffle of its text; one of several files is put together."""
    dc.write_lines(parts(spark), str(tmp_path / "docs"))
    found = dc.read_texts(spark, str(tmp_path / "docs"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["text"].count("line") for r in found.collect()} == {str(k): 10 for k in range(4)}
    more = tmp_path / "docs" / "timeline_id=1" / "block=1"
    more.mkdir()
    (more / "x.txt").write_text("line more")
    assert {r["doc_id"]: r["text"].count("line") for r in dc.read_texts(spark, str(tmp_path / "docs")).collect()} == {"0": 10, "1": 11, "2": 10, "3": 10}
