"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vector
from .common import bounded_batches, cut, table

#: Labellers of each target. A vote is 1 for bad, 0 for good, 2 for none.
TARGETS = {"quality": ("letters", "symbols", "capitals", "bangs", "variety", "echo", "word_length", "lines"), "toxic": ("insults_a", "insults_b", "stems")}
#: Two lists of insults that overlap, for two labellers.
INSULTS_A = ("idiot", "idiots", "moron", "morons", "scum", "loser", "losers", "trash", "pathetic", "stupid", "worthless", "bastard", "imbecile", "dumbass")
INSULTS_B = ("idiot", "moron", "scum", "loser", "clown", "disgusting", "pathetic", "stupid", "worthless", "filth", "vermin", "retard", "trash", "freak")
#: At most so many labelled documents give the stems labeller, and so many documents train the scorer.
LABELLED, TRAINING = 20_000, 12_000
#: Toxic documents of the sample that a stem needs; nine in ten documents that have it must be toxic.
SUPPORT = 7
#: Features are hashed to 2**BITS weights.
BITS = 18


def _measure(buf, at, starts, ends, first):
    """Of each text: shares and counts that the labellers judge, from sums over byte classes."""
    import numpy as np

    def count(members):
        hit = np.zeros(256, bool)
        hit[list(members)] = True
        total = np.concatenate([[0], np.cumsum(hit[buf[at[0] : at[-1]]])])
        return total[at[1:] - at[0]] - total[at[:-1] - at[0]]

    n = np.diff(first)
    size = np.concatenate([[0], np.cumsum(ends - starts)])
    chars = size[first[1:]] - size[first[:-1]] - count(range(128, 192))  # code points
    one = np.maximum(n, 1)
    upper, lower = count(range(65, 91)), count(range(97, 123))
    return {"n": n, "symbols": count(b"#*$%&|<>") / np.maximum(chars, 1), "capitals": upper / np.maximum(upper + lower, 1), "bangs": count(b"!") / one, "word_length": chars / one, "letters": np.where(chars > 0, 1 - count(b"!#$%&()*+/<=>?@[\\]^_`{|}~") * 4 / np.maximum(chars, 1), 1.0)}


def _variety(owner_hash, n):
    """Share of a text's shingles that are distinct."""
    import numpy as np

    owner, value = owner_hash
    total = np.bincount(owner, minlength=n)
    o, _ = vector.distinct(owner, value)
    return np.where(total > 0, np.bincount(o, minlength=n) / np.maximum(total, 1), 1.0)


def _repeated_lines(buf, at):
    import numpy as np

    out = np.zeros(len(at) - 1)
    for i in range(len(at) - 1):
        lines = [x for x in buf[at[i] : at[i + 1]].tobytes().split(b"\n") if x.strip()]
        out[i] = 1 - len(set(lines)) / len(lines) if lines else 0
    return out


def _word_hash(words) -> list[int]:
    import numpy as np

    text = "\n".join(words).encode()
    return np.unique(vector.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[2])


def _prefixes(buf, starts, ends, size=5):
    """Hashes of the words' first bytes, A-Z lower-cased; words cut short there read as their stems."""
    import numpy as np

    stop = np.minimum(ends, starts + size)
    out = np.zeros(len(starts), np.uint64)
    for j in range(size):
        at = np.minimum(starts + j, len(buf) - 1)
        out = vector.mix(out * np.uint64(0x100000001B3) + np.where(starts + j < stop, vector._TABLE[buf[at]], np.uint64(0)))
    return out


def _worker(stems, features: bool):
    """Votes of all labellers for each text and, if asked, its hashed features."""
    import numpy as np
    import pyarrow as pa

    lists = {"insults_a": _word_hash(INSULTS_A), "insults_b": _word_hash(INSULTS_B)}
    stems = np.array(sorted(stems), np.uint64) if len(stems) else np.zeros(0, np.uint64)

    def isin(values, keys):
        if not len(keys) or not len(values):
            return np.zeros(len(values), bool)
        at = np.searchsorted(keys, values)
        at[at == len(keys)] = 0
        return keys[at] == values

    def vote(value, bad, good):
        return np.where(bad(value), 1, np.where(good(value), 0, 2)).astype(np.int8)

    def read(buf, at):
        n = len(at) - 1
        s, e, h = vector.words(buf, at)
        first = vector.spans(at, s)
        m = _measure(buf, at, s, e, first)
        m["variety"], m["echo"] = (_variety(vector.shingles(h, first, k), n) for k in (3, 5))
        m["lines"] = _repeated_lines(buf, at)
        owner = np.repeat(np.arange(n), np.diff(first))
        pre = np.stack([_prefixes(buf, s, e), _prefixes(buf, s, e, 7)])
        any_of = lambda hit: np.bincount(owner[hit], minlength=n) > 0
        has = {k: any_of(isin(h, v)) for k, v in lists.items()} | {"stems": any_of(isin(pre[0], stems) | isin(pre[1], stems))}
        bounds = {"symbols": (0.01, 0.002), "capitals": (0.5, 0.2), "bangs": (0.2, 0.05), "lines": (0.3, 0.15)}
        votes = {
            "letters": vote(m["letters"], lambda x: x < 0.9, lambda x: x > 0.95),
            **{k: vote(m[k], lambda x, bad=bad: x > bad, lambda x, good=good: x < good) for k, (bad, good) in bounds.items()},
            **{k: vote(m[k], lambda x: x < 0.5, lambda x: x > 0.7) for k in ("variety", "echo")},
            "word_length": vote(m["word_length"], lambda x: (x > 8.5) | (x < 2.5), lambda x: (x > 3) & (x < 8)),
            **{k: np.where(x, 1, 0).astype(np.int8) for k, x in has.items()},
        }
        codes = {t: [("".join(map(str, r))) for r in np.stack([votes[k] for k in names], axis=1)] for t, names in TARGETS.items()}
        return s, e, h, pre, owner, m, codes

    def surface(m, n):
        """Measures in steps, as features of their own."""
        steps = {"symbols": (0.002, 0.01, 0.05), "capitals": (0.1, 0.2, 0.5), "bangs": (0.02, 0.2, 0.6), "variety": (0.3, 0.6, 0.9), "word_length": (3.5, 4.5, 6, 7, 8.5), "lines": (0.01, 0.1, 0.4), "n": (3, 20, 60)}
        out = [np.searchsorted(v, m[k]).astype(np.uint64) + np.uint64(100 * i) for i, (k, v) in enumerate(steps.items())]
        return np.repeat(np.arange(n), len(steps)), vector.mix(np.stack(out, axis=1).ravel() + np.uint64(77))

    def hashed(owner, h, pre, m, n):
        so, sv = surface(m, n)
        o = np.concatenate([owner, owner, owner, so])
        v = np.concatenate([vector.mix(h + np.uint64(1)), vector.mix(pre[0] + np.uint64(2)), vector.mix(pre[1] + np.uint64(3)), sv]) >> np.uint64(64 - BITS)
        return vector.distinct(o, v)

    return read, hashed


def votes(docs: DataFrame, stems) -> DataFrame:
    """(doc_id, one string of votes a target) of (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        read, _ = _worker(stems, False)
        for batch in batches:
            buf, at = vector.text_buffers(batch.column(1))
            for lo, hi in vector.groups(at):
                *_, codes = read(buf, at[lo : hi + 1])
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *(pa.array(codes[t]) for t in TARGETS)], ["doc_id", *TARGETS])

    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{t} string" for t in TARGETS))


def learn_stems(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> list[int]:
    """Hashes of word stems that toxic documents have far more often, from a bounded sample of labelled rows."""
    import numpy as np

    chosen = cut(labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(limit))
    some = docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            buf, at = vector.text_buffers(batch.column(1))
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in vector.groups(at):
                s, e, _ = vector.words(buf, at[lo : hi + 1])
                owner = np.repeat(np.arange(hi - lo), np.diff(vector.spans(at[lo : hi + 1], s)))
                o, v = vector.distinct(np.r_[owner, owner], np.r_[_prefixes(buf, s, e), _prefixes(buf, s, e, 7)])
                key, where = np.unique(v, return_inverse=True)
                bad = np.bincount(where, weights=toxic[lo:hi][o], minlength=len(key)).astype(np.int64)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(bad), pa.array(np.bincount(where, minlength=len(key)).astype(np.int64))], ["stem", "bad", "n"])

    found = some.mapInArrow(run, "stem long, bad long, n long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    rows = found.where((F.col("bad") >= SUPPORT) & (F.col("bad") >= 0.9 * F.col("n"))).orderBy(F.desc("bad"), "stem").limit(2000).collect()
    return [r["stem"] % 2**64 for r in rows]


def fit_accuracies(counts: list[tuple[str, int]], rounds: int = 60, prior: float = 0.15) -> dict:
    """EM over counts of vote patterns: each labeller's chances of a vote given good or bad, and the share of bad.

    The patterns are a bounded table (three to the number of labellers), so its counts cover every document exactly.
    Labellers count as independent given the class; a vote of none carries no weight. Smoothed by one vote.
    """
    import numpy as np

    if not counts:
        return {"prior": prior, "good": [], "bad": []}
    votes_ = np.array([[int(c) for c in p] for p, _ in counts])
    n = np.array([c for _, c in counts], float)
    k = votes_.shape[1]
    bad = np.tile([0.6, 0.4], (k, 1)).T  # chance of a vote 0, 1 given bad
    good = np.tile([0.99, 0.01], (k, 1)).T
    for _ in range(rounds):
        post = _posterior(votes_, prior, good, bad)
        w, v = n * post, n * (1 - post)
        for value in (0, 1):
            hit = votes_ == value
            bad[value], good[value] = 1 + w @ hit, 1 + v @ hit
        bad, good = bad / bad.sum(axis=0), good / good.sum(axis=0)
        prior = float(np.clip(w.sum() / n.sum(), 1e-3, 0.6))
    return {"prior": prior, "good": good.tolist(), "bad": bad.tolist()}


def _posterior(votes_, prior, good, bad):
    import numpy as np

    good, bad = np.asarray(good), np.asarray(bad)
    score = np.full(len(votes_), np.log(prior) - np.log1p(-prior))
    for value in (0, 1):
        score += (votes_ == value) @ (np.log(bad[value]) - np.log(good[value]))
    return 1 / (1 + np.exp(-score))


def train_scorer(rows: list[tuple[list[int], float]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-6):
    """Logistic weights over hashed features for soft labels, by Adagrad in a fixed order."""
    import numpy as np

    weights, seen, bias = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3), 0.0
    order = np.random.default_rng(5).permutation(len(rows))
    for _ in range(epochs):
        for i in order:
            f, y = rows[i]
            scale = 1 / np.sqrt(max(len(f), 1))
            z = weights[f].sum() * scale + bias
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            step = g * scale + decay * weights[f]
            seen[f] += step * step
            weights[f] -= rate * step / np.sqrt(seen[f])
            bias -= 0.02 * g
    return weights.astype(np.float32), float(bias)


def classify(docs: DataFrame, labels: DataFrame, training: int = TRAINING) -> DataFrame:
    """(doc_id, quality_posterior, toxic_posterior, quality_score, toxic_score, kept), one row a row of (doc_id, text).

    Votes are cast over all documents and counted by pattern; EM fits each target's labellers on these counts; a bounded
    sample of documents, by hash of the id, trains a hashed linear scorer on the posteriors; all documents are scored.
    A score is the chance of being bad; kept if neither is over a half. Sent to the driver: pattern counts (bounded by
    the number of patterns), 2000 stems and the sample's features; broadcast: two vectors of 2**18 weights.

    Null and empty texts have no words and get the votes of their measures; null ids are scored like others; repeated
    rows are rows of their own; an empty table gives an empty one.
    """
    import numpy as np

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stems = learn_stems(docs, labels)
    counts = votes(docs, stems).groupBy(*TARGETS).count().collect()
    models = {}
    for t in TARGETS:
        per: dict[str, int] = {}
        for r in counts:
            per[r[t]] = per.get(r[t], 0) + r["count"]
        models[t] = fit_accuracies(sorted(per.items()))
    edge = cut(docs.select("doc_id").where("doc_id IS NOT NULL").select(F.xxhash64("doc_id", F.lit(11)).alias("k")).orderBy("k").limit(training)).agg(F.max("k")).first()[0]
    sample = docs.where(F.xxhash64("doc_id", F.lit(11)) <= F.lit(edge if edge is not None else 0)).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "text").limit(2 * training)

    def posterior(t, codes):
        if not len(codes) or not models[t]["good"]:
            return np.zeros(len(codes))
        m = models[t]
        return _posterior(np.array([[int(c) for c in p] for p in codes]), m["prior"], m["good"], m["bad"])

    def features(batches):
        import pyarrow as pa

        read, hashed = _worker(stems, True)
        for batch in batches:
            buf, at = vector.text_buffers(batch.column(1))
            for lo, hi in vector.groups(at):
                s, e, h, pre, owner, m, codes = read(buf, at[lo : hi + 1])
                o, v = hashed(owner, h, pre, m, hi - lo)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(o, np.arange(hi - lo + 1)).astype(np.int32)), pa.array(v.astype(np.int32)))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), lists, *(pa.array(posterior(t, codes[t])) for t in TARGETS)], ["doc_id", "f", *TARGETS])

    rows = sample.mapInArrow(features, "doc_id long, f array<int>, " + ", ".join(f"{t} double" for t in TARGETS)).orderBy("doc_id").toArrow()
    fs = [np.array(x.values if hasattr(x, "values") else x) for x in rows["f"].combine_chunks()] if len(rows) else []
    scorers = {t: train_scorer(list(zip(fs, rows[t].to_pylist(), strict=True))) if fs else (np.zeros(1 << BITS, np.float32), -5.0) for t in TARGETS}
    shared = docs.sparkSession.sparkContext.broadcast(scorers)

    def score(batches):
        import pyarrow as pa

        read, hashed = _worker(stems, True)
        for batch in batches:
            buf, at = vector.text_buffers(batch.column(1))
            for lo, hi in vector.groups(at):
                n = hi - lo
                s, e, h, pre, owner, m, codes = read(buf, at[lo : hi + 1])
                o, v = hashed(owner, h, pre, m, n)
                size = np.maximum(np.bincount(o, minlength=n), 1)
                out, kept = [], np.ones(n, bool)
                for t in TARGETS:
                    w, bias = shared.value[t]
                    z = np.bincount(o, weights=w[v.astype(np.int64)], minlength=n) / np.sqrt(size) + bias
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    out += [posterior(t, codes[t]), p]
                    kept &= p <= 0.5
                yield pa.record_batch([batch.column(0).slice(lo, n), *map(pa.array, out), pa.array(kept)], ["doc_id", *(f"{t}_{k}" for t in TARGETS for k in ("posterior", "score")), "kept"])

    return docs.mapInArrow(score, "doc_id long, " + ", ".join(f"{t}_{k} double" for t in TARGETS for k in ("posterior", "score")) + ", kept boolean")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """classify over all documents; nulls, repeated rows and empty tables as there."""
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
