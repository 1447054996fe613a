"""Scalars, segments, dosage, layout and statistics against plain Python."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.functions import dosage, segment, text
from weftline.operators import kg, layout, learn, matching, stats
from weftline.plans.textual import REGISTRY


def one(spark, value, make):
    row = spark.createDataFrame([(value,)], "s string").select(make(F.col("s")).alias("x")).first().x
    return row


def test_normal_forms(spark):
    for s in (None, "", "abc", "éa", "é", "ක්ෂ", "ﬁ"):
        assert one(spark, s, text.nfc) == unicodedata.normalize("NFC", s or "") and one(spark, s, text.nfd) == unicodedata.normalize("NFD", s or "")
        plain = "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c))
        if "්" not in (s or ""):
            assert one(spark, s, text.deburr) == re.sub(r"\s+", " ", re.sub(r"[()\[\],.;:]", " ", plain.lower())).strip()


def test_scalars(spark):
    assert one(spark, "kāsaḥ: ", lambda c: text.sandhi_strip(text.deburr(c))) == "kasa"
    assert one(spark, "Abrus precatorius, The plant, Acorus  calamus", text.latin_binomials) == ["Abrus precatorius", "Acorus calamus"]
    assert one(spark, "(a) x, (a) y (c) z w", text.parse_traditional) == {"a": ["x", "y"], "b": [], "c": ["z w"]}
    assert one(spark, None, text.parse_traditional) == dict.fromkeys("abc", [])
    assert one(spark, "x. last one! . (fin)", lambda c: F.transform(text.clauses(c), text.last_word)) == ["x", "one", "fin"]
    assert one(spark, "a<b & \"c\"", text.html_escape) == "a&lt;b &amp; &quot;c&quot;"
    assert one(spark, "ocr-1-to-50.json", text.batch_label) == "1-to-50" and one(spark, "x", text.batch_label) is None
    assert [one(spark, s, text.page_number) for s in ("12", " - 7 -", "a1", None)] == [True, True, False, False]
    assert [one(spark, s, text.script_class) for s in ("ශාන්ති", "abc", "12", "අම්මා")] == ["tatsama", "latin", "number", "other"]
    for a, b in (("kitten", "sitting"), ("", ""), ("abc", ""), ("abcd", "acbd")):
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                m[i + 1][j + 1] = m[i][j] + 1 if a[i] == b[j] else max(m[i][j + 1], m[i + 1][j])
        want = 100.0 if not a and not b else 200 * m[-1][-1] / (len(a) + len(b))
        assert math.isclose(one(spark, a, lambda c, b=b: text.lcs_ratio(c, F.lit(b))), want)


def test_segments_cut_their_own_text(spark):
    rng = random.Random(4)
    boundary = re.compile(r"[।॥|]|:-|(?<![0-9])[.](?![0-9])|\n\s*(?=[0-9]{1,3}[).])")
    texts = ["", " . ", "a 2.5 b. c:- d | e", "x\n 12) y\n3. z", "é, b = c. ක්‍ෂ।"] + ["".join(rng.choice("ab 1.,|=:-\n)") for _ in range(rng.randrange(60))) for _ in range(120)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in rows.select("i", segment.sentences(F.col("t")).alias("s"), F.transform(segment.sentences(F.col("t")), segment.clause_spans).alias("c")).collect()}
    for i, t in enumerate(texts):
        want, at = [], 0
        for m in [*boundary.finditer(t), None]:
            piece = t[at : m.start() if m else len(t)]
            if piece.strip():
                lead = len(piece) - len(piece.lstrip())
                want.append((piece.strip(), at + lead, at + lead + len(piece.strip())))
            at = m.end() if m else at
        assert [tuple(x) for x in got[i].s] == want, repr(t)
        assert all(t[c.start : c.end] == c.text for cs in got[i].c for c in cs)


def test_aksharas(spark):
    assert one(spark, "ක්ෂ ත්‍ර අම්", segment.aksharas) == ["ක්ෂ", " ", "ත්‍ර", " ", "අ", "ම්"] or "".join(one(spark, "ක්ෂ ත්‍ර අම්", segment.aksharas)) == "ක්ෂ ත්‍ර අම්"
    assert one(spark, "", segment.aksharas) == [] and one(spark, None, segment.aksharas) == []
    assert one(spark, "්", lambda c: F.transform(segment.graphemes(c), segment.malformed)) == [True]
    assert one(spark, "naïve", lambda c: segment.affix(c, 3, end=True)) == "ïve"


@pytest.mark.parametrize(("quantity", "system", "grams", "ml"), [
    ("tola 2", None, 24, None), ("2 tola", None, 24, None), ("pala 1 tola 3", None, 96, None), ("2 pala 3", None, 120, None), ("pala", None, 60, None), ("½ pala", None, 30, None),
    ("2½ pala", None, 30, None), ("1/2 pala", None, 30, None), ("1/0 pala", None, None, None), ("pala2", None, 120, None), ("l 2", None, 1840, 2000), ("part 3", None, None, None), ("", None, None, None), (None, None, None, None),
    ("tola 2", "coast", 20, None), ("oz 1", "coast", 30, None), ("grain 16", "island", 1, None), ("tola 2", "nowhere", 24, None), ("0 tola", None, None, None), ("2,5 tola", None, 6, None), ("many things", None, None, None),
])
def test_dosage(spark, quantity, system, grams, ml):
    d = one(spark, quantity, lambda c: dosage.to_grams(c, REGISTRY, system, 0.92))
    assert (d.grams is None) == (grams is None) and (grams is None or math.isclose(d.grams, grams)) and (d.ml is None) == (ml is None) and (ml is None or math.isclose(d.ml, ml))


def test_longest_alias_in_text(spark):
    assert one(spark, "three tolas of it", lambda c: dosage.unit_in_text(c, REGISTRY)) == "tola" and one(spark, "xyz", lambda c: dosage.unit_in_text(c, REGISTRY)) is None


def test_places_and_statistics_of_small_tables(spark):
    rng = random.Random(2)
    rows = [(f"g{rng.randrange(2)}", i, rng.randrange(4)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, n long")
    got = {r.i: r.before for r in stats.places(df, "g", "i", F.col("n"), buckets=7).collect()}
    seen = Counter()
    for g, i, n in rows:
        assert got[i] == seen[g]
        seen[g] += n
    empty = spark.createDataFrame([], "g string, w string")
    assert stats.vocabulary(stats.counts(empty, "g", "w"), "g").count() == 0 and stats.zipf_slope(stats.counts(empty, "g", "w"), "g").count() == 0


def test_layout(spark):
    tokens = lambda s: spark.createDataFrame([(s.split(),)], "t array<string>")
    assert tuple(tokens("dry ginger tola 2").select(layout.parse_ingredient(F.col("t"), ["tola"]).alias("x")).first().x) == ("dry ginger", "tola", "2")
    assert tuple(tokens("dry ginger").select(layout.parse_ingredient(F.col("t"), ["tola"]).alias("x")).first().x) == ("dry ginger", None, None)
    rows = spark.createDataFrame([([(0.1, 1, "a"), (0.15, 1, "b"), (0.5, 1, "c"), (0.52, 2, "d")],)], "w array<struct<x:double,block:long,text:string>>")
    assert rows.select(layout.name_columns(F.col("w")).alias("x")).first().x == ["a b", "c", "d"]
    assert rows.select(layout.zone(F.col("w"), 0.12, 0.51).alias("x")).first().x == "b c"
    v = spark.createDataFrame([("pre\n1. one\nmore\n2) two\n900. x 5\n3. back",)], "t string").select(layout.verses(F.col("t")).alias("v")).first().v
    assert [(x.n, x.body) for x in v] == [(1, "one more"), (2, "two"), (900, "x 5 3. back")]
    words = spark.createDataFrame([(1, x / 100, 0.5, f"w{x}") for x in [*range(5, 45, 4), *range(56, 95, 4)]], "page int, x double, y double, text string")
    g = layout.gutter(words, ["page"]).first().gutter
    assert 0.41 < g < 0.56
    assert {r.column for r in layout.reading_order(words, layout.gutter(words, ["page"]), ["page"]).collect()} == {0, 1}


def test_spans_that_are_free(spark):
    own = spark.createDataFrame([(1, 0, 3), (2, 1, 2)], "id int, start int, end int")
    more = spark.createDataFrame([(1, 2, 4), (1, 3, 5), (2, 0, 1), (3, 0, 9)], "id int, start int, end int")
    assert sorted(map(tuple, matching.fill_free(own, more).collect())) == [(1, 3, 5), (2, 0, 1), (3, 0, 9)]


def test_exclusive_pairs(spark):
    a = spark.createDataFrame([(1, "a1", 0.0), (1, "a2", 2.0), (2, "a3", 0.0)], "g int, a string, at double")
    b = spark.createDataFrame([(1, "b1", 1.5), (1, "b2", -4.0), (2, "b3", 9.0)], "g int, b string, at double")
    assert sorted(map(tuple, matching.greedy_pairs(a, b, "g", "at", ("a", "b"), 5.0).collect())) == [(1, "a1", "b2", 4.0), (1, "a2", "b1", 0.5)]


def test_learning(spark):
    rows = spark.createDataFrame([(i, ["good" if i % 2 else "bad", f"w{i % 7}"], i % 2) for i in range(120)], "g int, x array<string>, label int")
    r = {x["class"]: x for x in learn.report(learn.cross_validate(rows, "g", "x", "label", 3, 10, 1 << 10), "label", "prediction").collect()}
    assert r[0.0].f1 > 0.95 and r[1.0].recall > 0.95


def test_graph_merges_do_not_depend_on_order(spark):
    rows = [("a", "T2", {"n": "y"}, 1), ("a", "T1", {"n": None, "k": "v"}, 0), ("a", "T0", {"n": "x"}, 1), ("b", "T", {}, 0)]
    for part in (1, 3):
        nodes = spark.createDataFrame(rows[::-1] if part == 3 else rows, "id string, type string, props map<string,string>, seq int").repartition(part)
        got = {r.id: (r.type, r.props) for r in kg.merge_nodes(nodes).collect()}
        assert got == {"a": ("T1", {"k": "v", "n": "x"}), "b": ("T", {})}


def test_binomials_end_where_sql_ends_words(spark, tmp_path):
    import duckdb

    from weftline import catalog

    items = ["Erachü chöü.", "Erach chöü2", "éEnlich sche", "Und ungauä x", "The plant", "The\nplant Abc def", "Acorus  calamus\tx", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    want = con.execute(catalog.SQL["latin_binomials"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["latin_binomials"](spark, str(tmp_path)).select("name", "n").collect()]
    assert sorted(got) == sorted(want)


def test_a_text_of_very_many_sentences_takes_no_square_of_time(spark):
    import time

    n = 100_000
    whole = "".join(f"s{i}, t. " for i in range(n))
    df = spark.createDataFrame([(whole,)], "t string").repartition(1)
    began = time.perf_counter()
    s = df.select(segment.sentences(F.col("t")).alias("s")).select(F.size("s").alias("n"), F.element_at("s", -1).alias("last"), F.size(F.filter("s", lambda x: x["end"] - x["start"] != F.length(x["text"]))).alias("bad")).first()
    assert (s.n, s.bad) == (n, 0) and s.last.text == f"s{n - 1}, t" and whole[s.last.start : s.last.end] == s.last.text
    assert time.perf_counter() - began < 20


def test_sentences_without_places_are_those_with(spark):
    texts = ["", None, " . ", "a 2.5 b. c:- d | e", "x\n 12) y\n3. z", "é, b = c. ක්‍ෂ।\x0b", "no mark at all "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(segment.pieces(F.col("t"), segment.SENTENCE).alias("p"), F.transform(segment.sentences(F.col("t")), lambda x: x["text"]).alias("s")).collect()
    assert all(r.p == r.s for r in rows) and rows[3].p == ["a 2.5 b", "c", "d", "e"]
