"""Each operator by its method: tests that fail where the method is bypassed."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import contamination, licenses, lines, mixing, neardup, rules, urls, weaklabel

DIR = "/root/testdata/sf0.001"


def test_cutoffs_are_the_last_that_a_binomial_bound_proves(spark):
    rng = random.Random(3)
    rows = [("big", *(int(1000 * rng.random() ** k) for k in (6, 12, 3, 20, 1))) for _ in range(1200)] + [("small", 0, 0, 0, 0, 0)] * 400 + [(None, 1, 1, 1, 1, 4000)] * 700
    names = list(rules.GRIDS)
    held = spark.createDataFrame(rows, "stratum string, " + ", ".join(f"m_{r} int" for r in names))
    got = {r.stratum: r for r in rules.cutoffs(held).collect()}
    p = rules.ALPHA / len(names)

    def tail(k, n):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))

    for stratum in ("big", "small", None):
        own = [r[1:] for r in rows if r[0] == stratum]
        for i, r in enumerate(names):
            want = None
            for c in rules.GRIDS[r]:
                if tail(sum(x[i] > c for x in own), len(own)) > rules.DELTA / (len(names) * 3):
                    break
                want = c
            assert got[stratum][f"cut_{r}"] == want, (stratum, r)
    assert got["small"]["cut_symbols"] is None and got[None]["cut_symbols"] is not None  # 400 documents prove nothing, 700 do


def test_a_proven_rule_rejects(spark):
    limits = spark.createDataFrame([("en", 10, None, None, None, None)], "stratum string, " + ", ".join(f"cut_{r} int" for r in rules.GRIDS))
    text = " ".join(f"word{i}" for i in range(30))
    docs = rules.measured(spark.createDataFrame([(1, "en", text), (2, "en", text + " ####"), (3, "de", text + " ####"), (4, None, text)], "doc_id long, lang string, text string"))
    assert {r.doc_id: r.kept for r in rules.judge(docs, limits).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_whole_licences_are_found(spark):
    bsd = licenses._BSD.format(licenses._BSD_3)
    isc = [t for s, t in licenses.KNOWN if s == "ISC"][0]
    texts = {
        1: "Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + bsd.upper().replace(",", " ,"), 2: bsd + " And more.", 3: isc.replace("that the above ", "that the above\n"), 4: "The MIT Licence\n\n" + licenses._MIT.replace(" ", "  "), 5: None, 6: "",
        7: licenses._BSD.format(""), 8: "Copyright 2019 X\n" + licenses._MIT,
    }
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id int, text string")).collect()}
    assert got == {1: "BSD-3-Clause", 2: None, 3: "ISC", 4: "MIT", 5: None, 6: None, 7: "BSD-2-Clause", 8: "MIT"}


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/Apache-2.0"), reason="no licence texts here")
def test_long_licences_by_digest(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "LGPL-2.1": "LGPL-2.1-only"}
    rows = [(k, open(f"/usr/share/common-licenses/{k}", encoding="utf-8").read().upper() if k == "MPL-2.0" else open(f"/usr/share/common-licenses/{k}", encoding="utf-8").read()) for k in names]
    assert {r.k: r.license for r in licenses.scan(spark.createDataFrame(rows, "k string, text string")).collect()} == names


def test_only_one_pattern_runs_on_every_url(spark):
    loose = [p for p in urls.PATTERNS if not all(urls.literal_choices(p))]
    assert len(urls.PATTERNS) >= 90 and loose == [r"://[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+[:/]"]
    cases = ["http://x/?a=1&sessionid=0123456789", "http://x/?redirect=http://y", "http://x/login", "http://x/checkout?z", "http://ad.x/", "http://ads.x/q", "http://x/a?gclid=1", "http://10.1.2.3/", "http://x/wp-admin/", "http://a.tracker.com/p", "http://x/s.exe?v"]
    clean = ["http://x/loginpage", "http://adverts.x/", "http://x/?sessionid=xyz", "https://x/gclid", None, ""]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(cases + clean)], "page_id int, url string")
    got = {r.page_id: r.verdict for r in urls.judge(rows, rules=()).collect()}
    assert [got[i] for i in range(len(cases))] == ["block"] * len(cases) and [got[len(cases) + i] for i in range(len(clean))] == ["allow"] * len(clean)
    assert {r.verdict for r in urls.judge(rows, patterns=(), rules=()).collect()} == {"allow"}
    assert urls.judge(rows.limit(0)).count() == 0


def test_sketches_are_small_and_find_contained_items(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 7))
    items = [[word() for _ in range(int(rng.integers(20, 40)))] for _ in range(200)]
    docs = []
    for i, ws in enumerate(items):  # a tenth of the words changed at one end, inside a long text
        docs.append((i, " ".join([*(word() for _ in range(int(rng.integers(50, 3000)))), *ws[: len(ws) - len(ws) // 10], *(word() for _ in range(40))])))
    docs += [(1000 + i, " ".join(word() for _ in range(300))) for i in range(100)]
    found = contamination.search(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id int, text string"))
    got = {r.doc_id: r.item_id for r in found.collect()}
    assert sum(got[i] == i for i in range(200)) >= 199 and all(got[i] is None for i in range(1000, 1100))
    value = np.sort(rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    kept = len(np.unique(contamination._bin(value, 13 + contamination.BIN_BITS)))
    assert kept < 0.65 * len(value)


def test_labellers_are_told_apart_by_agreement():
    """Votes drawn with known accuracies, none of which is told: EM finds them and the share of bad."""
    rng = random.Random(5)
    right = [(0.95, 0.4), (0.99, 0.7), (0.9, 0.6), (0.97, 0.8)]  # chance of a good vote given good, of a bad one given bad
    counts: dict[str, int] = {}
    for _ in range(40_000):
        bad = rng.random() < 0.2
        p = "".join("2" if rng.random() < 0.1 else str(int(rng.random() < b)) if bad else str(int(rng.random() >= g)) for g, b in right)
        counts[p] = counts.get(p, 0) + 1
    m = weaklabel.fit_accuracies(sorted(counts.items()), rounds=300)
    assert abs(m["prior"] - 0.2) < 0.03 and all(abs(m["good"][0][i] - g) < 0.03 and abs(m["bad"][1][i] - b) < 0.05 for i, (g, b) in enumerate(right))
    assert not set("plain any_insult".split()) & {x for t in weaklabel.TARGETS.values() for x in t}


def test_toxic_documents_are_found(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.kept for r in weaklabel.op5_quality_classifier(spark, sf).collect()}
    toxic = [got[r.doc_id] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()]
    assert toxic and sum(toxic) <= 0.4 * len(toxic)


def test_every_reading_has_its_place(spark):
    docs = spark.createDataFrame([(i, f"w {i} x", "ab"[i % 2]) for i in range(40)] + [(None, None, None)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs)
    order = mixing.training_order(mixed)
    at = [r.position for r in order.collect()]
    assert at == sorted(at) and len(at) == mixed.where("first_position IS NOT NULL").count() + mixed.where("second_position IS NOT NULL").count() and mixed.where("second_position IS NOT NULL").count() > 0


def test_equal_rows_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, text + " x", 0), (3, "other words entirely", 0), (None, "n", 1), (None, "n", 1)], "doc_id long, text string, n int")
    assert sorted((r.doc_id or -1) for r in neardup.filter_documents(docs).collect()) == [-1, 1, 3]


def test_removed_lines_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    runs = lambda x: {x[i : i + 5] for i in range(len(x) - 4)} if len(x) >= 5 else {x}
    places = [(r.doc_id, k, x.strip(" ")) for r in rows for k, x in enumerate((r.text or "").split("\n")) if x.strip(" ")]
    distinct = sorted({x for _, _, x in places})
    sets, root = [runs(x) for x in distinct], list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = len(sets[i]), len(sets[j])
            if 0.8 * max(a, b) <= min(a, b) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    at, seen, gone = {x: i for i, x in enumerate(distinct)}, set(), set()
    for d, k, x in sorted(places, key=lambda p: (p[0], p[1])):
        c = find(at[x])
        if c in seen:
            gone.add((d, k))
        seen.add(c)
    got = {r.doc_id: r for r in lines.dedup_lines(docs, counts=True).collect()}
    want = {r.doc_id: "\n".join(x for k, x in enumerate((r.text or "").split("\n")) if (r.doc_id, k) not in gone) for r in rows if r.text is not None}
    wrong = [d for d, t in want.items() if got[d].text != t]
    assert len(wrong) <= 0.01 * len(want) and abs(sum(r.n_removed for r in got.values()) - len(gone)) <= max(1, 0.01 * len(gone))


def test_rows_of_one_id_keep_their_own_lines(spark):
    line = "a line that stands in many texts of this small table"
    docs = spark.createDataFrame([(None, line), (None, "its own line, unlike all others\n" + line), (5, line), (7, "x\n" + line), (7, line), (8, None), (8, "")], "doc_id long, text string").withColumn("n_lines", F.lit(9))
    got = {(r.doc_id, r.text, r.n_removed) for r in lines.dedup_lines(docs, counts=True).collect()}
    assert got == {(None, "", 1), (None, "its own line, unlike all others", 1), (5, line, 0), (7, "x", 1), (7, "", 1), (8, None, 0), (8, "", 0)}
    assert {(r.doc_id, r.text) for r in lines.dedup_lines(docs, emptied=False).collect()} == {(None, "its own line, unlike all others"), (5, line), (7, "x"), (8, None), (8, "")}


def test_pipeline_on_hostile_and_empty_tables(spark, tmp_path):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base, "en", "a", 1), (2, base + " more", "en", "a", 1), (2, base + " more", "en", "a", 1), (3, None, None, None, None), (None, base, "en", "b", 1), (4, "", "", "", 0), (5, " ".join(f"q{i}" for i in range(50)), "de", None, 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("some", rows), ("none", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).withColumn("n_removed", F.lit(1)).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(10, 40)))] if data else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d).collect()
        assert [r.doc_id for r in out] == ([1] if data else [])


def test_pipeline_drops_planted_copies_and_blanks(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = corpus_pipeline.line_dedup(spark, docs, DIR)
    assert kept.columns == docs.columns and kept.where(~F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))).count() <= docs.where(~F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))).count()
    text = " ".join(f"v{i}" for i in range(200))
    more = [(10**9, text), (10**9 + 1, text + " end"), (10**9 + 2, text)]
    planted = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, planted, DIR).collect()}
    assert 10**9 in left and not left & {10**9 + 1, 10**9 + 2}


def test_hostile_licences_and_turns(spark):
    from weftline.llm import chat

    docs = spark.createDataFrame([(1, "MIT License", "x"), (1, "MIT License", "x"), (None, None, None), (2, "", ""), (3, "licence " * 40_000, None)], "doc_id long, text string, license string")
    out = licenses.scan(docs)
    assert out.count() == 5 and sorted(out.columns) == ["digest", "doc_id", "license", "notices", "text"]
    turns = spark.createDataFrame([(None, None, None, None), (1, None, "user", ""), (1, 0, None, "<|im_end|>"), (1, 0, None, "<|im_end|>"), (2, 1, "assistant", "y " * 50_000), (2, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {None: 1, 1: 3, 2: 2} and got[2].loss_chars == 100_000 and got[1].loss_chars == 0


def test_scores_of_an_empty_table(spark):
    from weftline.llm import lm

    assert lm.score(spark.createDataFrame([], "doc_id long, text string"), steps=2).count() == 0


def test_long_bands_reach_nearly_all_pairs_at_the_threshold():
    rng, salts, hit = random.Random(0), [s % 2**64 for s in lines._SALTS], 0
    for _ in range(600):  # 60 runs together, 48 of them shared
        xs = [rng.getrandbits(64) for _ in range(60)]
        equal = [min(x ^ s for x in xs[:54]) == min(x ^ s for x in xs[:48] + xs[54:]) for s in salts]
        hit += any(all(equal[i] for i in band) for band in lines._LONG_BANDS)
    assert hit >= 0.99 * 600


def test_long_bands_lose_at_most_five_in_a_thousand():
    for union in (40, 200):
        rng, salts, hit = random.Random(union), [s % 2**64 for s in lines._SALTS], 0
        tenth = union // 10
        for _ in range(1000):  # eight tenths of the runs shared
            xs = [rng.getrandbits(64) for _ in range(union)]
            equal = [min(x ^ s for x in xs[:-tenth]) == min(x ^ s for x in xs[: 8 * tenth] + xs[-tenth:]) for s in salts]
            hit += any(all(equal[i] for i in band) for band in lines._LONG_BANDS)
        assert hit >= 995


def test_waves_share_every_key_that_two_lines_have(spark):
    rng = random.Random(3)
    # lists of unlike length, as lines of the two kinds of bands have: a key's place in them says nothing
    held = {h: [rng.randrange(-60, 60) * 2**40 + rng.randrange(4) for _ in range(rng.choice((13, 24, 37)))] for h in range(200)}
    sigs = spark.createDataFrame(list(held.items()), "h long, keys array<long>")
    got = {(r.key, r.h, r.low, r.high) for k in range(lines.WAVES) for r in lines._shared(sigs, k).collect()}
    by = {}
    for h, keys in held.items():
        for k in keys:
            by.setdefault(k, set()).add(h)
    assert got == {(k, h, min(hs), max(hs)) for k, hs in by.items() if len(hs) > 1 for h in hs}


def test_shuffle_files_of_a_plan_that_is_over_are_dropped(spark):
    from weftline.llm import common

    held = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses
    out = [common.cut(spark.range(1000).repartition(7 + k, "id").groupBy((F.col("id") % 5).alias("k")).count()) for k in range(3)]
    assert not held().isEmpty()
    common.drop_shuffles(out[0])
    assert held().isEmpty()


def test_steps_follow_the_gradient_of_the_loss():
    from weftline.llm import lm

    rng = np.random.default_rng(4)
    ids, places = rng.integers(0, 5000, (6, lm.WINDOW + 1)), rng.random((6, lm.WINDOW)) < 0.7
    context, target = ids[:, :-1], ids[:, 1:]
    model = lm.Model(rng.integers(1, 900, lm._VOCABULARY))
    loss = lambda: -(model.log_probs(context, target, places).astype(float) - model.inside[target[places]]).mean()
    before = {k: v.copy() for k, v in model.p.items()}
    state = {"t": 0}
    model.step(context, target, state, 0.0, places)
    for name in before:  # of the first step, m is a tenth of the gradient
        slope, size = state[name][0] * 10, np.float32(0.01)
        way = np.sign(slope) * size / np.sqrt(slope.size)
        ends = []
        for s in (1, -1):
            model.p[name] = before[name] + s * way
            ends.append(loss())
        model.p[name] = before[name]
        assert np.isclose(ends[0] - ends[1], 2 * float((slope * way).sum()), rtol=0.05, atol=2e-6), name


def test_far_scores_stay_finite_and_causal():
    from weftline.llm import lm

    model = lm.Model(np.ones(lm._VOCABULARY))
    for name, times in (("q", 400), ("k", 400), ("out", 300)):
        model.p[name] = model.p[name] * np.float32(times)
    ids = np.random.default_rng(5).integers(0, 5000, (4, lm.WINDOW))
    score = model._attend(ids)[4]
    assert np.allclose(score.sum(axis=2), 1, atol=1e-4) and not score[:, np.triu(np.ones((lm.WINDOW, lm.WINDOW)), 1) > 0].any()
    logs = model.log_probs(ids, ids, np.ones(ids.shape, bool))
    assert np.isfinite(logs).all() and logs.min() < -100


def test_a_step_is_fast():
    import time

    from weftline.llm import lm

    model, state = lm.Model(np.ones(lm._VOCABULARY)), {"t": 0}
    ids = np.random.default_rng(6).integers(0, 50_000, (256, lm.WINDOW + 1))
    some = np.random.default_rng(7).standard_normal((256, lm.WINDOW, lm.CLASSES)).astype(np.float32)

    def least(f):
        times = []
        for _ in range(15):
            began = time.perf_counter()
            f()
            times.append(time.perf_counter() - began)
        return min(times)

    lm._keep_memory()
    assert least(lambda: model.step(ids[:, :-1], ids[:, 1:], state, 1e-4)) < 28 * least(lambda: np.exp(some - 1))


def test_pairs_of_large_buckets_that_are_far_apart_meet_no_text(spark):
    """Two lines that share a rare run and little else are no candidates; those that are similar all are."""
    import random

    from pyspark.sql import functions as F

    from weftline.llm import lines

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(30)]
        texts += [" ".join(w if rng.random() > share else word() for w in base) for share in (0, 0, 0.03, 0.05, 0.3, 0.4, 0.5)]
    texts = sorted(set(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sigs = lines.signatures(docs)
    got = {frozenset(p) for p in lines._prefixed(sigs.select("h", F.col("h").alias("part")), sigs, docs).collect()}
    own = {r.h: texts[r.doc_id] for r in sigs.select("h", "doc_id").collect()}
    runs = {h: {t[i : i + 5] for i in range(len(t) - 4)} for h, t in own.items()}
    alike = lambda a, b: len(runs[a] & runs[b]) / len(runs[a] | runs[b])
    every = {frozenset((a, b)): alike(a, b) for a in runs for b in runs if a < b}
    assert {p for p, s in every.items() if s >= 0.8} <= got and any(s >= 0.8 for s in every.values())
    assert not [p for p in got if every[p] < 0.4] and len(got) < sum(s > 0.1 for s in every.values()) / 2
