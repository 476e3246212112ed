import hashlib
import json

import os

from foliant.session import materialize, release, shared_dir
from foliant.sources import files
from foliant.streaming import text as st


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.txt").write_bytes(b"no")
    row = files.binary_files(spark, str(tmp_path)).collect()
    assert [r["pdf_hash"] for r in row] == [hashlib.sha256(b"%PDF-1.7 x").hexdigest()]


def test_captured_items_and_corrupt_json(spark, tmp_path):
    item = {"str": "x", "transform": [1, 0, 0, 1, 0, 0], "width": 1, "height": 2, "hasEOL": True, "bbox": None}
    (tmp_path / "a.json").write_text(json.dumps({"extractor_version": "1", "pages": [[item, {"width": 3}, {"str": "y"}], []]}))
    got = files.captured_items(spark, str(tmp_path)).orderBy("item_no").collect()
    assert [(r["page"], r["item_no"], r["str"], r["has_eol"]) for r in got] == [(1, 1, "x", True), (1, 2, "y", False)]
    (tmp_path / "b.json").write_text("{broken")
    assert files.typed_json(spark, str(tmp_path), files.CAPTURE).cache().filter("_corrupt_record is not null").count() == 1


def test_model_headers(spark):
    uid, sha = "0005b896-63e6-447e-9093-04cfd1e7b677", "a" * 64
    df = spark.createDataFrame([(1, "1.0", uid, sha), (2, "2.0", uid, sha), (3, "1.0", "x", sha), (4, "1.0", uid, "A"), (5, None, None, None)], "k int, schema_version string, document_id string, pdf_hash string")
    good, bad = files.split_valid(df)
    assert [r["k"] for r in good.collect()] == [1]
    assert {r["k"]: r["reason"] for r in bad.collect()} == {2: "schema_version", 3: "document_id", 4: "pdf_hash", 5: "schema_version"}


def test_templates_sheets_and_json(spark, tmp_path):
    own = spark.createDataFrame([("a", "text")], "k string, v string")
    template = spark.createDataFrame([("a", "other"), ("b", "kept"), ("c", " ")], "k string, v string")
    rows = files.first_available(own, template, "k", "v")
    assert sorted(map(tuple, rows.collect())) == [("a", "text"), ("b", "kept")]
    sheet = files.sheet(rows.selectExpr("*", "1 as g"), rows["v"], ["k"], "g").first()
    assert (sheet["sheet"], sheet["n_lines"]) == ("text\nkept", 2)
    out = str(tmp_path / "out")
    files.write_json(rows, out)
    files.write_json(own, out, keep_existing=True)
    assert spark.read.json(out).count() == 2
    assert json.loads(files.json_rows(own).first()["json"]) == {"k": "a", "v": "text"}
    files.write_text(sheet and files.sheet(rows.selectExpr("*", "1 as g"), rows["v"], ["k"], "g"), "sheet", str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).count() == 2


def test_materialized_tables_lie_in_the_shared_folder(spark):
    df = materialize(spark.range(5).toDF("x"), "t")
    assert df.count() == 5 and shared_dir(spark) in df.inputFiles()[0]
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder) and release(spark) >= 1 and not os.path.exists(folder)


def test_sentence_stream_equals_batch(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/text_pages.parquet")
    folder = str(tmp_path / "in")
    src.select("document_id", "page", "normalized_text", src["ingested_at"].cast("timestamp").alias("ingested_at")).repartition(3).write.parquet(folder)
    batch = spark.read.parquet(folder)
    stream = st.page_stream(spark, folder, batch.schema.simpleString()[7:-1].replace(":", " "), 1)
    q = st.sentence_stream(stream).writeStream.format("memory").queryName("sents").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.select("document_id", "page", "sent_no", "text", "start", "end").collect()), key=str)
    assert key(spark.table("sents")) == key(st.sentence_stream(batch))


def test_streams_with_watermark(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/text_pages.parquet")
    folder = str(tmp_path / "in")
    src.select("document_id", "page", src["ingested_at"].cast("timestamp").alias("ingested_at")).coalesce(1).write.parquet(folder)
    batch = spark.read.parquet(folder)
    stream = st.page_stream(spark, folder, batch.schema.simpleString()[7:-1].replace(":", " "))
    once = st.first_deliveries(stream, ["document_id", "page"], "3650 days").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    once.awaitTermination(120)
    assert spark.table("once").count() == batch.select("document_id", "page").distinct().count()
    counts = st.recent_counts(stream, "page", "3650 days", "1 day").writeStream.format("memory").queryName("recent").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert spark.table("recent").selectExpr("sum(n)").first()[0] == batch.count()
