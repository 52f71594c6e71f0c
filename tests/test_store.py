import pytest
from pyspark.sql import functions as F

from boscograph.config import Config
from boscograph.operators import feedback
from boscograph.sources import store
from boscograph.streaming import feeds


def test_csv_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([('a "q", b', 3, "host", "c_1", "concept"), ("x\ny", 1, None, None, "concept")], store.CONCEPTS)
    store.write_csv(df, f"{tmp_path}/c.csv")
    assert sorted(map(tuple, store.read_csv(spark, f"{tmp_path}/c.csv", store.CONCEPTS).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert store.read_csv(spark, f"{tmp_path}/none.csv", store.CONCEPTS).count() == 0
    assert store.first_existing(spark, f"{tmp_path}/none", f"{tmp_path}/c.csv") == f"{tmp_path}/c.csv"
    store.snapshot(df, str(tmp_path), "concepts", "20250101_000000")
    store.snapshot(df.limit(1), str(tmp_path), "concepts", "20250102_000000")
    assert store.restore(spark, str(tmp_path), "concepts", store.CONCEPTS).count() == 1
    store.clear(spark, str(tmp_path), "concepts")
    assert store.restore(spark, str(tmp_path), "concepts", store.CONCEPTS).columns == df.columns


def test_byte_order_mark(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("﻿node_1,node_2,edge,weight,chunk_id,source\na,b,c,0.5,d,e\n".encode())
    assert store.read_csv(spark, f"{tmp_path}/b.csv", store.RELATIONSHIPS).first().node_1 == "a"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.PDF").write_bytes(b"%PDF")
    assert [(r.name, r.text) for r in store.read_texts(spark, str(tmp_path)).collect()] == [("a.txt", "one\ntwo")]
    pdf = store.scan_binary(spark, str(tmp_path))
    assert [(r.name, r.size) for r in pdf.select("name", "size").collect()] == [("b.PDF", 4)]
    assert store.uncached(pdf.drop("hash"), pdf.select("hash"), "content").count() == 0


def test_pages_and_pictures(spark):
    pages = spark.createDataFrame([("p", 1, 10, 1), ("p", 2, 20, 0), ("q", 1, 500, 3), ("r", 1, 0, 0)], "paper string, page int, n_chars int, n_images int")
    assert {r.paper: r.scanned for r in store.needs_ocr(pages).collect()} == {"p": True, "q": False, "r": False}
    img = spark.createDataFrame([("p", 1, 0, 50, 500), ("p", 2, 0, 200, 200), ("p", 1, 1, 200, 200)], "paper string, page int, idx int, width int, height int")
    assert [(r.page, r.idx) for r in store.pictures(img, per_paper=1).collect()] == [(1, 1)]
    sc = spark.createDataFrame([("i", "b", 0.5), ("i", "a", 0.5)], "image_path string, label string, probability double")
    assert store.top_label(sc).first().label == "a"


def test_bulk(spark):
    c = spark.createDataFrame([("a", 1, "T", 1), ("a", 2, "U", 2), ("b", 3, "T", 3)], "name string, id int, type string, ord int")
    e = spark.createDataFrame([("a", "r", "b", 0.5), ("a", "r", "zz", 0.5)], "head string, relation string, tail string, confidence double")
    n, r = store.bulk_files(c, e)
    assert {(x.name, x.id, x.type) for x in n.collect()} == {("a", 2, "U"), ("b", 3, "T")} and [tuple(x) for x in r.collect()] == [(2, "r", 3, 0.5)]


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"chunk": {"size": 10}}')
    c = Config.load(str(tmp_path / "c.json"))
    assert c.get("chunk.size") == 10 and c.get("chunk.step") == 2700 and c.get("no.such", 7) == 7
    c.set("a.b", 1)
    assert c.get("a.b") == 1 and Config.load(str(tmp_path / "none.json")).get("chunk.size") == 3000


def test_feedback_stream_equals_batch(spark, tmp_path):
    rows = [{"feedback_id": f"f{i % 3}", "feedback_type": "entity_merge", "received_at": f"2025-01-0{i + 1} 00:00:00"} for i in range(5)]
    df = spark.createDataFrame(rows).withColumn("received_at", F.to_timestamp("received_at"))
    store.append_json_lines(df, f"{tmp_path}/in")
    back = store.read_json_lines(spark, f"{tmp_path}/in", feedback.SCHEMA)
    assert feedback.once(back).count() == 3
    src = feeds.files(spark, f"{tmp_path}/in", back.schema, "json")
    feeds.run_to_table(feeds.once_by_id(src).select("feedback_id"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r.feedback_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["f0", "f1", "f2"]
    feeds.run_to_table(feeds.once_by_id(src).select("feedback_id"), f"{tmp_path}/out", f"{tmp_path}/state")  # nothing new
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_sessions(spark, tmp_path):
    df = spark.createDataFrame([("u", "2025-01-01 00:00:00"), ("u", "2025-01-01 00:10:00"), ("u", "2025-01-01 02:00:00"), ("v", "2025-01-03 00:00:00")], "k string, t string").select("k", F.to_timestamp("t").alias("t"))
    df.write.parquet(f"{tmp_path}/e")
    feeds.run_to_table(feeds.sessions(feeds.files(spark, f"{tmp_path}/e", df.schema), "t", "k"), f"{tmp_path}/o", f"{tmp_path}/s")
    assert sorted((r.k, r.n) for r in spark.read.parquet(f"{tmp_path}/o").collect()) == [("u", 1), ("u", 2)]


def test_feedback_patterns(spark):
    d = "struct<original:struct<node_1:string,node_2:string,relation_type:string>,correction:struct<correct_direction:string,corrected_node_1:string,corrected_node_2:string>,node_1:string,node_2:string,wrong_relation:string,correct_relation:string,entity_1:string,entity_2:string,canonical_name:string,relation_type:string>"
    none = [None] * 8
    rows = [("f1", "relation_direction_error", (("a", "b", "r"), ("reverse", "b", "a"), *none)), ("f2", "relation_type_error", (None, None, "a", "b", "x", "y", *none[4:])), ("f3", "entity_merge", (None, None, None, None, None, None, "a", "b", None, None))]
    df = spark.createDataFrame(rows, f"feedback_id string, feedback_type string, data {d}")
    assert {(r.kind, r.pattern, r.n) for r in feedback.patterns(df).collect()} == {("direction", "r", 1), ("type", "x → y", 1)}
    got = {r.feedback_id: (r.input, r.output) for r in feedback.training_pairs(df).collect()}
    assert got == {"f1": ("关系: a → r → b", "正确方向: b → r → a"), "f2": ("关系: a → x → b", "正确关系: a → y → b")}


@pytest.mark.parametrize("n", [0, 1])
def test_unprocessed(spark, n):
    c = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    assert store.unprocessed(c, c.limit(n)).count() == 2 - n


def test_log(spark):
    lines = spark.createDataFrame([(1, "x ERROR a"), (2, "y WARNING Timeout"), (3, "z ERROR b")], "line_no int, line string")
    n, last = store.log_problems(lines, 1)
    assert tuple(n.first()) == (2, 1) and last.first().line_no == 3
