"""Steps around outside readers and models, with providers made up for the test."""

import json

import pytest
from pyspark.sql import functions as F

from boscograph.functions import cleaning as X
from boscograph.operators import extract, feedback, graph, providers, resolve
from boscograph.plans import pipeline
from boscograph.sources import papers, store


def test_readers_in_turn(spark):
    def broken(content):
        raise OSError("no such font")

    def plain(content):
        return content.decode() if content.startswith(b"T") else None

    df = spark.createDataFrame([("a.pdf", b"T" * 600), ("b.pdf", b"T few"), ("c.pdf", b"scan"), ("d.pdf", None)], "name string, content binary")
    rows = {r.name: r for r in papers.read_papers(df, [("first", broken), ("second", plain)], ocr=lambda c: "seen " * 20, tables=lambda c: [[["k", "v"], ["1", None]]]).collect()}
    assert rows["a.pdf"].method == "second" and rows["a.pdf"].text == "T" * 600 + "\n\n[表格]\nk | v\n1 | "
    assert rows["b.pdf"].method == "ocr" and rows["c.pdf"].text.startswith("seen seen") and rows["c.pdf"].error is None
    assert rows["d.pdf"].text is None
    lone = {r.name: r for r in papers.read_papers(df, [("first", broken)]).collect()}
    assert lone["c.pdf"].text is None and lone["c.pdf"].error == "first: no such font"
    assert papers.read_papers(df.limit(0), []).collect() == []


def test_captions(spark, tmp_path):
    assert papers.read_captions(spark, str(tmp_path / "none.json")).collect() == []
    (tmp_path / "c.json").write_text(json.dumps([{"image_path": "i2", "caption": "rust", "source_pdf": "a.pdf", "page_num": 3}, {"image_path": "i1", "caption": "bark", "source_pdf": "a.pdf", "page_num": 1}, {"image_path": "i3", "caption": " ", "source_pdf": "a.pdf", "page_num": 1}]))
    c = papers.read_captions(spark, str(tmp_path / "c.json"))
    own = spark.createDataFrame([("a.pdf", "text"), ("b.pdf", "other")], "name string, text string")
    rows = {r.name: r.text for r in papers.caption_section(own, c).collect()}
    assert rows["a.pdf"] == "text\n\n## 图片说明\n\n**图1**（第1页）：bark\n\n**图2**（第3页）：rust" and rows["b.pdf"] == "other"
    assert sorted((r.chunk_id, r.text) for r in papers.image_chunks(c).collect()) == [("a_image_0", "bark"), ("a_image_1", "rust")]
    papers.save_texts(own, str(tmp_path / "out"))
    assert {r.paper for r in spark.read.text(str(tmp_path / "out")).select("paper").collect()} == {"a", "b"}
    papers.save_images(c, c.select("caption"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv/images"), header=True).count() == 3


def test_feedback_is_recorded(spark, tmp_path):
    path = str(tmp_path / "fb")
    base = {"node_1": "a", "node_2": "b", "relation_type": "r"}
    ids = feedback.record(spark, path, [{"feedback_type": "relation_direction_error", "correct_direction": "reverse", **base}, {"feedback_type": "relation_type_error", "node_1": "a", "node_2": "b", "wrong_relation": "x", "correct_relation": "y", "user_id": "u"}])
    ids += feedback.record(spark, path, [{"feedback_type": "entity_merge", "entity_1": "a", "entity_2": "b", "canonical_name": "c"}, {"feedback_type": "missing_relation", **base, "comment": "add"}])
    rows = {r.feedback_type: r for r in store.read_json_lines(spark, path, feedback.SCHEMA).collect()}
    assert len(rows) == 4 and {r.feedback_id for r in rows.values()} == set(ids)
    fixed = rows["relation_direction_error"].data.correction
    assert (fixed.corrected_node_1, fixed.corrected_node_2) == ("b", "a") and rows["relation_type_error"].user_id == "u" and rows["entity_merge"].user_id == "anonymous"
    straight = feedback.reported(spark, [{"feedback_type": "relation_direction_error", "correct_direction": "correct", **base}]).first().data.correction
    assert (straight.corrected_node_1, straight.corrected_node_2) == ("a", "b")
    assert [tuple(r) for r in feedback.merges(store.read_json_lines(spark, path, feedback.SCHEMA)).collect()] == [("a", "b", "c", 1)]
    for bad in ({"feedback_type": "praise"}, {"feedback_type": "entity_merge", "entity_1": "a"}):
        with pytest.raises(ValueError):
            feedback.record(spark, path, [bad])


def test_critique(spark):
    first = json.dumps({"concepts": [{"entity": "x"}], "relationships": []})

    def call(prompt):
        text = json.loads(prompt)["text"]
        if text == "fails":
            raise TimeoutError
        quality = {"good": 0.95, "poor": 0.5}.get(text)
        return "not json" if quality is None else "```json\n" + json.dumps({"quality": quality, "concepts": [{"entity": "better"}], "relationships": []}) + "\n```"

    df = spark.createDataFrame([(t, t, first) for t in ("good", "poor", "fails", "odd")], "chunk_id string, text string, answer string")
    rows = {r.chunk_id: r for r in providers.critique(df, call).collect()}
    assert [rows[k].refined for k in ("good", "poor", "fails", "odd")] == [False, True, False, False]
    assert [round(rows[k].confidence, 6) for k in ("good", "poor", "fails", "odd")] == [1.0, 0.6, 0.7, 0.7]
    assert [r.entity for r in extract.concepts_of(providers.critique(df.where("chunk_id = 'poor'"), call)).collect()] == ["better"] and rows["good"].answer == first
    unasked = providers.critique(df, lambda p: 1 / 0, initial=0.5).collect()
    assert all(r.quality is None and r.answer == first for r in unasked)
    assert spark.range(1).select(providers.refined_weight(F.lit(True), F.lit(0.8)).alias("w")).first().w == 0.9


def test_other_providers(spark):
    s = spark.createDataFrame([("c", "C 相关知识", "a, b", "host", 2), ("d", "D 相关知识", "x", "mixed", 1)], "community string, title string, core_concepts string, theme string, size int")
    got = {r.community: r for r in providers.describe_communities(s, lambda p: '{"title": "T", "summary": "S", "themes": ["q"]}' if "C 相关" in p else None).collect()}
    assert (got["c"].title, got["c"].summary, got["c"].themes) == ("T", "S", ["q"]) and (got["d"].title, got["d"].summary, got["d"].themes) == ("D 相关知识", "x", ["mixed"])
    issues = spark.createDataFrame([("yes",), ("no",), ("?",), (None,)], "q string")
    assert {r.q: r.keep for r in providers.adjudicate(issues, lambda p: {"yes": "Yes.", "no": "No, it isn't"}[p], F.col("q")).collect()} == {"yes": True, "no": False, "?": True, None: True}
    names = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "entity string, ord int")
    v = providers.embed(names, "entity", lambda texts: [[float(len(t)), 2.0] for t in texts])
    assert sorted((r.ord, r.vector) for r in v.collect() if r.vector) == [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    assert all(r.vector is None for r in providers.embed(names, "entity", lambda texts: 1 / 0).collect())
    last = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [2.0]), ("b", 1, None)], "entity string, ord int, vector array<float>")
    assert [(r.entity, r.vector) for r in providers.node_index(last).collect()] == [("a", [2.0])]


def test_markdown_and_scripts(spark):
    text = "# 标题 one\n\nsee [this](u) and $x^2$ ok\n| a | b |\n|---|---|\n| 1 | 2 |\n```py\ncode\n```\n$$\ny\n$$\n![p](i)\nend"
    row = spark.createDataFrame([(text, "樹蟲")], "t string, z string").select(X.markdown(F.col("t")).alias("m"), X.simplified(F.col("z"), "樹蟲", "树虫").alias("z")).first()
    assert row.m.split("\n")[0] == "【标题】标题 one" and "a，b" in row.m and "1，2" in row.m and "---" not in row.m and "code" not in row.m and "y" not in row.m.split("\n") and row.z == "树虫"
    assert spark.createDataFrame([(None,), ("",)], "t string").select(X.markdown(F.col("t")).alias("m")).collect()[0].m is None


def test_link_flow(spark):
    e = spark.createDataFrame([(1, "松树", "Host"), (2, "pine", "Host"), (3, "rust", "Disease")], "id int, name string, type string")
    r = spark.createDataFrame([("松树", "has", "rust", 1), ("pine", "has", "rust", 2)], "head string, relation string, tail string, ord int")
    std = spark.createDataFrame([("松树", "pine")], "name string, standard string")
    kb = spark.createDataFrame([("rust", "K1")], "name string, id string")
    linked, rel = resolve.link_flow(e, r, std, kb=kb)
    assert sorted((x.name, x.importance, x.kb_id) for x in linked.collect()) == [("pine", 8, None), ("rust", 11, "K1")]
    assert [(x.head, x.tail) for x in rel.collect()] == [("pine", "rust")]
    assert all(x.kb_id is None for x in resolve.link_kb(e, None).collect())


def test_leiden_and_fallback(spark, monkeypatch):
    rows = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(4) for j in range(i)] + [("a0", "b0", 0.1)]
    e = spark.createDataFrame(rows, "src string, dst string, weight double")
    found = {r.name: r.community for r in pipeline.communities(e, graph.nodes_of(e), "leiden").collect()}
    assert len({found[f"a{i}"] for i in range(4)}) == 1 == len({found[f"b{i}"] for i in range(4)}) and found["a0"] != found["b0"]
    # A community that doesn't hang together is parted.
    monkeypatch.setattr(graph, "louvain", lambda e, n, **k: n.select("name", F.lit("one").alias("community")))
    two = e.where("weight = 1")
    assert len({r.community for r in graph.leiden(two, graph.nodes_of(two)).collect()}) == 2

    def stuck(e, n, **k):
        raise RuntimeError("communities still gain")

    monkeypatch.setattr(graph, "louvain", stuck)
    assert len({r.community for r in pipeline.communities(e, graph.nodes_of(e), "leiden", fallback=True).collect()}) == 1
    with pytest.raises(RuntimeError):
        pipeline.communities(e, graph.nodes_of(e), "louvain")
