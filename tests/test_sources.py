"""Sources and sinks: round trips through files, missing and broken files, resumed streams."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.sources import readers, writers
from weftline.streaming import streams


def test_entries(spark, tmp_path):
    for name, batch in (("b_structured.json", None), ("a_structured.json", "first")):
        (tmp_path / name).write_text(json.dumps({"batch": batch, "entries": [{"n": 1, "t": "é"}, {"n": 2}]}))
    rows = readers.entries(spark, f"{tmp_path}/*_structured.json", "n int, t string").orderBy("batch", "at").collect()
    assert [(r.source_doc, r.batch, r.at, r.n, r.t) for r in rows] == [("b", "b", 0, 1, "é"), ("b", "b", 1, 2, None), ("a", "first", 0, 1, "é"), ("a", "first", 1, 2, None)]
    with pytest.raises(Exception, match="excluded source"):
        readers.guarded(spark, [f"{tmp_path}/a_structured.json"], "n int", "a_struct").collect()
    assert readers.guarded(spark, [f"{tmp_path}/b_structured.json"], "n int", "a_struct").count() == 2


def test_missing_and_broken(spark, tmp_path):
    assert readers.optional(spark, f"{tmp_path}/none.json", "a int").count() == 0 and readers.plain_tokens(spark, f"{tmp_path}/none") is None
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": 3')
    assert sorted(r.a for r in readers.lines(spark, f"{tmp_path}/log.jsonl", "a int").collect()) == [1, 2]
    (tmp_path / "t.txt").write_text("one  two\nthree")
    assert [r.token for r in readers.plain_tokens(spark, f"{tmp_path}/t.txt").orderBy("at").collect()] == ["one", "two", "three"]
    (tmp_path / "w.txt").write_text("one 5\n\n two 7\n")
    assert [r.value for r in readers.first_fields(spark, f"{tmp_path}/w.txt").collect()] == ["one", "two"]


def test_pages(spark, tmp_path):
    word = lambda t, x, px=False: {"boundingBox": {"vertices" if px else "normalizedVertices": [{"x": x, "y": 10.0 if px else 0.5}] * 4}, "confidence": 0.9, "symbols": [{"text": c} for c in t]}
    tree = {"pages": [{"width": 100, "height": 20, "blocks": [{"paragraphs": [{"words": [word("ab", 0.1), word("c", 50.0, True), word("", 0.2)]}]}]}]}
    (tmp_path / "page-7.json").write_text(json.dumps({"responses": [{"context": {"pageNumber": 3}, "fullTextAnnotation": tree}, {"fullTextAnnotation": tree}]}))
    batch = readers.pages(spark, f"{tmp_path}/*.json")
    assert sorted(r.page for r in batch.collect()) == [3, 7] and readers.page(batch, 3).count() == 1
    w = readers.words(readers.page(batch, 3)).orderBy("at").collect()
    assert [(r.text, r.x, r.y) for r in w] == [("ab", 0.1, 0.5), ("c", 0.5, 0.5)]
    a = spark.createDataFrame([(1, 0.9, "a"), (2, 0.2, "b")], "page int, confidence double, t string")
    b = spark.createDataFrame([(1, 0.5, "c"), (2, 0.8, "d")], "page int, confidence double, t string")
    assert {r.page: r.t for r in readers.keep_better(a, b).collect()} == {1: "a", 2: "d"}


def test_graph_document_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("n:1", "T", {"name": "q\"\\\n"}), ("n:2", "T", {"x": None})], "id string, type string, props map<string,string>")
    edges = spark.createDataFrame([("n:1", "n:2", "R", {})], "src string, dst string, type string, props map<string,string>")
    lines, head, tail = writers.graph_lines(nodes, edges, '{"a": "b"}')
    doc = head + ",".join(r.value for r in lines.collect()) + tail
    assert json.loads(doc)["@graph"][0]["name"] == "q\"\\\n"
    (tmp_path / "g.jsonld").write_text(doc)
    n, e = readers.graph_document(spark, f"{tmp_path}/g.jsonld")
    assert sorted((r.id, r.type) for r in n.collect()) == [("n:1", "T"), ("n:2", "T")] and [(r["from"], r["to"], r["type"]) for r in e.collect()] == [("n:1", "n:2", "R")]


def test_writes(spark, tmp_path):
    df, path = spark.range(3), f"{tmp_path}/out"
    assert writers.write(df, path, dry=True) == "would write" and not readers.exists(spark, path)
    assert writers.write(df, path) == "written" and writers.write(df, path) == "skipped" and writers.write(spark.range(5), path, force=True) == "written"
    assert spark.read.json(path).count() == 5
    writers.append_lines(spark.range(2), path)
    assert spark.read.json(path).count() == 7
    writers.append_log(spark.createDataFrame([("a", 1)], "a string, b int"), f"{tmp_path}/log")
    assert [tuple(r) for r in readers.log(spark, f"{tmp_path}/log", "a string, b int").collect()] == [("a", 1)] and readers.log(spark, f"{tmp_path}/no", "a string").count() == 0
    writers.sample(spark.range(50), F.md5(F.col("id").cast("string")), 5, f"{tmp_path}/s")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/s").count() == 5
    m = spark.createDataFrame([("s", "a|b", 1.0)], "section string, name string, value double")
    assert "a\\|b" in writers.markdown(m, "t").first().value


def test_list_objects_and_nested_properties(spark):
    nodes = spark.createDataFrame([("n:1", "T", {"l": '["a", "b"]'}, {"o": {"i": "v"}})], "id string, type string, props map<string,string>, more map<string,map<string,string>>")
    flat = writers.flat_properties(nodes, "more")
    edges = spark.createDataFrame([], "src string, dst string, type string, props map<string,string>")
    assert sorted((r.p, r.o) for r in writers.triples(flat, edges).collect()) == [("l", "a"), ("l", "b"), ("o__i", "v"), ("type", "T")]


def test_rules(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("anchors:\n- {id: a, ok: true}\n- {id: b}\n")
    assert [tuple(r) for r in readers.rules(spark, f"{tmp_path}/r.yaml", "anchors", "id string, ok boolean").collect()] == [("a", True), ("b", None)]


def test_a_stream_resumes(spark, tmp_path):
    source, base = f"{tmp_path}/in", f"file://{tmp_path}/base"
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string").write.parquet(source)
    go = lambda: sorted(map(tuple, streams.drain(streams.unseen(streams.follow(spark, source), ["id"]), where=base).collect()))
    assert go() == [(1, "a"), (2, "b")]
    spark.createDataFrame([(2, "again"), (3, "c")], "id int, t string").write.mode("append").parquet(source)
    assert go() == [(1, "a"), (2, "b"), (3, "c")]


def test_state_is_carried_between_batches(spark, tmp_path):
    source, base = f"{tmp_path}/in", f"file://{tmp_path}/base"
    rows = lambda xs: spark.createDataFrame(xs, "k int, o int, m string, t string").coalesce(1)
    rows([(1, 1, "x", "a"), (1, 2, None, "b")]).write.parquet(source)
    go = lambda: sorted(map(tuple, streams.drain(streams.carried(streams.follow(spark, source), "k", "o", "m", "t"), where=base).collect()))
    assert go() == []
    rows([(1, 3, None, "c"), (1, 4, "y", "d")]).write.mode("append").parquet(source)
    assert go() == [(1, 1, "x", "a b c")]
