"""The training-data operators against SQL, brute force and hostile rows."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import chat, contamination, lines, lm, mixing, neardup, queries, rules, urls, weaklabel
from weftline.plans.base import TABLES

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    cursor = duck.execute(queries.SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(r[names.index(c)] for c in df.columns) for r in cursor.fetchall()]
    assert sorted(map(tuple, df.collect()), key=_key) == sorted(want, key=_key)


def hostile(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, base, "en", "a", 1), (2, base + " more", "en", "a", 1), (2, base + " more", "en", "a", 1), (3, None, None, None, None), (None, base, "en", "b", 1),
        (4, "", "", "", 0), (5, " \t\n ", "de", "b", 4), (6, "one", "de", None, 3), (7, "One", "de", None, 3), (8, "x" * 300_000, "fr", "c", 9), (9, "w " * 50_000, "fr", "c", 9),
    ]
    return spark.createDataFrame(rows, DOCS)


def test_hostile_rows(spark):
    docs = hostile(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20, 40))), (2, None), (None, "a b c d e"), (3, "")], "item_id long, text string")
    n = docs.count()
    comp = {(r.doc_id, r.n_shingles): r for r in neardup.components(docs).collect()}
    assert comp[2, 60].component_id == 1 and not comp[2, 60].kept and comp[None, 59].kept and comp[7, 1].component_id == 6 and comp[4, 0].kept
    found = contamination.search(docs, items)
    assert found.count() == n and {r.doc_id for r in found.where("NOT kept").collect()} == {1, 2, None}
    mixed = mixing.mix(docs.withColumn("size", docs["n_chars"])).collect()
    assert len(mixed) == n and all(0 <= r.taken <= 2 * r["size"] for r in mixed)
    assert lines.dedup_lines(docs, counts=True).count() == n
    assert rules.filter_documents(docs, labels).columns == docs.columns
    judged = weaklabel.classify(docs, labels, training=5)
    assert judged.count() == n
    scored = lm.score(docs, steps=2, training=3).collect()
    assert len(scored) == n and all(math.isfinite(r.score) and r.n_tokens >= 1 for r in scored)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (neardup.components(docs), contamination.search(docs, items), mixing.mix(docs), lines.dedup_lines(docs), rules.filter_documents(docs, labels), weaklabel.classify(docs, labels)):
        assert out.count() == 0
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_chat_round_trip():
    for text in ("<|im_end|>", "<\\|x", "a<\\\\|b<||", "", "plain"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    for role in ("user", "a\nb", "<|im_start|>", "\\n", "\\"):
        assert chat._role_in(chat._role_out(role)) == role


def test_line_links_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    runs = lambda x: {x[i : i + 5] for i in range(len(x) - 4)} if len(x) >= 5 else {x}
    distinct = sorted({x.strip(" ") for r in docs.collect() for x in (r.text or "").split("\n")} - {""})
    sets = [runs(x) for x in distinct]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 0.8 * max(len(sets[i]), len(sets[j])) <= min(len(sets[i]), len(sets[j])) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    from pyspark.sql import functions as F

    keys = [r.h for r in spark.createDataFrame(list(enumerate(distinct)), "i int, x string").select("i", F.xxhash64("x").alias("h")).orderBy("i").collect()]
    _, found = lines.line_components(docs, lines.signatures(docs), bucket=2)
    part = {r.node: r.component for r in found.collect()}
    missed = [p for p in near if part.get(keys[p[0]], 0) != part.get(keys[p[1]], 1)]
    assert near and len(missed) <= 0.02 * len(near)


def test_large_buckets_lose_no_link(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    whole = sorted(map(tuple, neardup.components(docs).collect()))
    assert sorted(map(tuple, neardup.components(docs, bucket=1).collect())) == whole


def test_a_large_bucket_of_lines_loses_no_link(spark, monkeypatch):
    from pyspark.sql import functions as F

    # one key for all lines; 40 pairs of near lines that resemble no other line
    rows = [(2 * i + j, " ".join(f"{zlib.crc32(f'{i} {k}'.encode()):08x}" for k in range(15)) + " end" * j) for i in range(40) for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lines, "band_keys", lambda line: F.array(F.lit(1).cast("long")))
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(docs, counts=True).collect()}
    assert got == {i: i % 2 for i, _ in rows}


def test_near_lines_of_every_length_are_linked(spark):
    word = lambda i, k, n=6: f"{zlib.crc32(f'{i} {k}'.encode()):08x}"[:n]
    rows = []
    for i in range(300):
        line = " ".join(word(i, k, 4 + (i + k) % 5) for k in range(1 + i % 15))
        rows += [(2 * i, line), (2 * i + 1, line + ".")]
    # long words of which four have another second letter: most runs that start at a word differ
    for i in range(300, 320):
        ws = [word(i, k, 8) + word(i, -k - 1, 6) for k in range(14)]
        rows += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(w[0] + "#" + w[2:] if k % 4 == 1 else w for k, w in enumerate(ws)))]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), counts=True).collect()}
    runs = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    near = [a[0] // 2 for a, b in zip(rows[::2], rows[1::2], strict=True) if len(runs(a[1]) & runs(b[1])) >= 0.8 * len(runs(a[1]) | runs(b[1]))]
    assert len(near) > 280 and any(i >= 300 for i in near)
    for words in range(1, 16):  # recall by length; the last group is that of the long words
        own = [got[2 * i + 1] for i in near if i % 15 + 1 == words and i < 300]
        assert sum(own) >= 0.99 * len(own)
    own = [got[2 * i + 1] for i in near if i >= 300]
    assert sum(own) == len(own)


def test_contamination_in_blocks(spark):
    docs, items = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = (sorted(map(tuple, contamination.search(docs.select("doc_id", "text"), items, block=b).drop("text").collect())) for b in (10**6, 300))
    assert one == many


def test_base_scores(spark):
    docs = [(r.doc_id, (r.text or "").encode().lower().split() + [None]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, ws in docs if not out(i) for w in ws)
    total, distinct = sum(count.values()), len(count)
    got = {r.doc_id: r for r in lm.score(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text"), steps=3, heavy=500).collect()}
    for i, ws in docs:
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and got[i].n_known == sum(count[w] > 0 for w in ws) and got[i].held_out == out(i)


def test_windows_score_each_id_once():
    for n in (2, 9, 32, 33, 200):
        ids = np.arange(n)
        _, target, places = lm._windows(ids)
        assert sorted(target[places]) == list(range(1, n))


def test_scores_do_not_depend_on_the_words_held(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    all_held, few = ({r.doc_id: r for r in lm.score(docs, steps=3, heavy=k).collect()} for k in (10**6, 500))
    assert all(math.isclose(all_held[i].score, few[i].score, rel_tol=1e-6) and all_held[i].n_known == few[i].n_known for i in all_held)


def test_equal_texts_score_equally(spark):
    texts = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(40).collect()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + 7 * i + k, "a short line of text") for i, k in enumerate(range(20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({r.doc_id: r.score for r in lm.score(d, steps=20, training=30).collect()} for d in (docs.coalesce(1), docs.repartition(7)))
    same = [one[i] for i, t in rows if t == "a short line of text"]
    assert math.isclose(max(same), min(same), rel_tol=1e-4)
    assert all(math.isclose(one[i], many[i], rel_tol=1e-4) for i in one)


def test_attention_is_causal_and_normalised():
    model = lm.Model(np.ones(lm._VOCABULARY))
    ids = np.random.default_rng(0).integers(0, 5000, (1, lm.WINDOW))
    other = ids.copy()
    other[0, 20:] = 7
    assert np.allclose(model.forward(ids)[-1][0, :20], model.forward(other)[-1][0, :20], atol=1e-5)
    mass = np.zeros(lm.CLASSES)
    np.add.at(mass, model.cls, np.exp(model.inside.astype(float)))
    assert np.allclose(mass[mass > 0], 1, atol=1e-3)


def test_classifier_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.kept for r in weaklabel.op5_quality_classifier(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [got[r.doc_id] for r in labels if r.quality == 1 and r.toxic == 0]
    bad = [got[r.doc_id] for r in labels if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_literal_tokens_are_in_every_match():
    cases = {r"://ads\.x/": "http://ads.x/1", r"[?&]utm_source=feed(&|$)": "http://a/?utm_source=feed", r"/(login|cart)/": "h://x/cart/", r"a+b-cd": "aab-cd"}
    for pattern, url in cases.items():
        assert re.search(pattern, url) and set(urls.literal_tokens(pattern)) <= set(re.findall("[a-z0-9]+", url))


def test_pipeline_stages(spark):
    out = corpus_pipeline.run(spark, DIR).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert out and {r.doc_id for r in out} <= set(docs) and len({r.doc_id for r in out}) == len(out)
    items = [r.text.lower().split() for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    held = [{tuple(i[k : k + 5]) for k in range(len(i) - 4)} for i in items]
    for r in out:
        ws = (r.text or "").lower().split()
        own = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}
        assert not any(h and len(h & own) >= 0.8 * len(h) for h in held)


def test_every_training_document_moves_the_model(spark):
    # the weights don't depend on partitions, but on a single document
    rows = [(i, " ".join(f"{zlib.crc32(f'{i} {k}'.encode()) % 300}" for k in range(60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").where(~lm.held_out(F.col("doc_id")))
    n = docs.count()
    models = []
    for d in (docs, docs.repartition(5), docs.where("doc_id <> 59")):
        model = lm.Model(np.ones(lm._VOCABULARY))
        assert lm.train_on_all(model, d, 3) > 60 * (n - 1)
        models.append(model.p)
    assert all(np.allclose(models[0][k], models[1][k], atol=1e-5) for k in models[0])
    assert any(not np.allclose(models[0][k], models[2][k], atol=1e-4) for k in models[0])


def test_the_score_learns_from_all_training_documents(spark, monkeypatch):
    seen = []
    whole = lm.train_on_all
    monkeypatch.setattr(lm, "train_on_all", lambda model, docs, copies, *more: seen.append((docs.count(), whole(model, docs, copies, *more))))
    docs = spark.createDataFrame([(i, f"line {i} of text") for i in range(50)], "doc_id long, text string")
    lm.score(docs, steps=2, training=3).collect()
    free = docs.where(~lm.held_out(F.col("doc_id"))).count()
    # four words and an end at least, each a target once
    assert seen and seen[0][0] == free and seen[0][1] >= 5 * free
