"""LM scoring: a causal self-attention model over subword ids, mixed with corpus word counts, in numpy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vector
from .chat import TOKENIZERS, encoding
from .common import bounded_batches, cut, table

#: Documents whose crc32 of the id, as text, has this remainder are held out.
FOLDS, HELD_OUT = 7, 2
#: Words of the corpus with the highest counts that a scoring task holds (16 bytes each); the rest are joined.
HEAVY = 1_000_000
#: Width of the model, subword classes, length of a window and of the part of it that is context only.
WIDTH, CLASSES, WINDOW, CONTEXT = 16, 64, 32, 8
#: Documents that train the first attention weights, by hash of the id, and steps of that; all documents follow.
TRAINING, STEPS = 1_500, 600
#: Most copies of the model that learn from all training documents side by side, and training tokens of one.
COPIES, SHARE = 64, 500_000
#: Words whose subword ids a worker keeps (some 36 bytes each).
BOOK = 500_000
_VOCABULARY = 50258
END_OF_TEXT = 50256
_VOCAB_FILE = "byte_bpe_multi_50k.tiktoken"


def held_out(doc_id):
    """crc32 of the id as text, mod 7, is 2; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def _encode(words, folder):
    """Offsets and subword ids of words, each with its blank before it."""
    import numpy as np

    enc = encoding(folder, _VOCAB_FILE)
    if "blanks" not in vector._cache():
        known = np.zeros(_VOCABULARY, bool)
        for token, i in enc._mergeable_ranks.items():
            known[i] = token[:1] == b" "
        vector._cache()["blanks"] = known
    # all words in one go: a word's first token is the one that begins with its blank
    flat = np.array(enc.encode_ordinary(b"".join(words).decode()), np.int32)
    begin = np.flatnonzero(vector._cache()["blanks"][flat]) if len(flat) else np.zeros(0, np.int64)
    if len(begin) == len(words):
        return np.append(begin, len(flat)).astype(np.int64), flat
    ids = [enc.encode_ordinary(w.decode()) for w in words]  # a blank of another kind joined one of ours
    return np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64), np.array([y for x in ids for y in x], np.int32)


def _ragged(begin, length):
    """Places of runs that begin and are as long as told, end to end."""
    import numpy as np

    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())


def _merged(one, two):
    """Two books of words (sorted keys, offsets, ids) as one."""
    import numpy as np

    keys = np.concatenate([one[0], two[0]])
    begin = np.concatenate([one[1][:-1], two[1][:-1] + len(one[2])])
    length = np.concatenate([np.diff(one[1]), np.diff(two[1])])
    order = np.argsort(keys, kind="stable")
    flat = np.concatenate([one[2], two[2]])[_ragged(begin[order], length[order])]
    return keys[order], np.concatenate([[0], np.cumsum(length[order])]), flat


def _encode_distinct(buf, starts, ends, hashes, folder):
    """Subword ids of each distinct word, encoded as blank and word: (inverse, offsets, ids).

    A worker keeps the ids of up to BOOK words that it met, in a large sorted book and a small one of late words.
    """
    import numpy as np

    distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    none = (np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32))
    books = vector._cache().setdefault("books", {}).setdefault(folder, [none, none])
    length, missing, parts = np.zeros(len(distinct), np.int64), np.ones(len(distinct), bool), []
    for keys, offsets, flat in books:
        if len(keys):
            at = np.searchsorted(keys, distinct)
            at[at == len(keys)] = 0
            hit = (keys[at] == distinct) & missing
            missing &= ~hit
            at, rows = at[hit], np.flatnonzero(hit)
            length[rows] = offsets[at + 1] - offsets[at]
            parts.append((rows, offsets[at], flat))
    rows = np.flatnonzero(missing)
    if len(rows):
        raw = buf.tobytes()
        offsets, flat = _encode([b" " + raw[starts[i] : ends[i]].lower() for i in where[rows]], folder)
        length[rows] = np.diff(offsets)
        parts.append((rows, offsets[:-1], flat))
        books[1] = _merged(books[1], (distinct[rows], offsets, flat))
        if len(books[1][0]) > BOOK // 16:
            books[:] = [_merged(*books) if len(books[0][0]) < BOOK else books[0], none]
    offsets = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(offsets[-1], np.int32)
    for rows, begin, flat in parts:
        out[_ragged(offsets[rows], length[rows])] = flat[_ragged(begin, length[rows])]
    return inverse, offsets, out


def _gather(inverse, offsets, flat):
    """The ids of a sequence of words: lengths of the words and ids end to end."""
    import numpy as np

    lengths = (offsets[1:] - offsets[:-1])[inverse]
    begin = np.repeat(offsets[:-1][inverse], lengths)
    inside = np.arange(len(begin)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return lengths, flat[begin + inside]


def _text_groups(column):
    """(lo, hi, buf, at, starts, ends, hashes, first) over a text column, about a megabyte at a time."""
    buf, at = vector.text_buffers(column)
    for lo, hi in vector.groups(at):
        s, e, h = vector.words(buf, at[lo : hi + 1])
        yield lo, hi, buf, s, e, h, vector.spans(at[lo : hi + 1], s)


END_HASH = -1  # the end token's key among word hashes


def corpus_counts(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(kind, key, n) over all training texts: counts of words by hash (kind 0, the end token among them) and of
    subword ids (kind 1). Each task sums what it reads before anything is shuffled."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        subwords, pending = np.zeros(_VOCABULARY, np.int64), []
        ends = 0

        def fold():
            key = np.concatenate([k for k, _ in pending])
            n = np.concatenate([c for _, c in pending])
            key, where = np.unique(key, return_inverse=True)
            return key, np.bincount(where, weights=n, minlength=len(key)).astype(np.int64)

        def out(kind, key, n):
            return pa.record_batch([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n)], ["kind", "key", "n"])

        for batch in batches:
            ends += batch.num_rows
            for lo, hi, buf, s, e, h, _ in _text_groups(batch.column(0)):
                del lo, hi
                inverse, offsets, flat = _encode_distinct(buf, s, e, h, folder)
                key, n = np.unique(h, return_counts=True)
                times = np.repeat(n, np.diff(offsets))
                subwords += np.bincount(flat, weights=times, minlength=_VOCABULARY).astype(np.int64)
                pending.append((key.view(np.int64), n))
            if sum(len(k) for k, _ in pending) > 2_000_000:
                merged = fold()
                pending = [merged]
                if len(merged[0]) > 1_000_000:
                    yield out(0, *merged)
                    pending = []
        if pending:
            yield out(0, *fold())
        if ends:
            yield out(0, np.array([END_HASH]), np.array([ends]))
            subwords[END_OF_TEXT] += ends
        used = np.flatnonzero(subwords)
        yield out(1, used.astype(np.int64), subwords[used])

    return docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Model:
    """One causal head over class logits: P(id) = P(class | attention) * P(id | class) by corpus counts.

    The most frequent ids are classes of their own; the others share the rest by frequency. Every id has a smoothed
    count, so each text has a probability and those of all ids sum to one.
    """

    def __init__(self, subwords=None, state: dict | None = None):
        import numpy as np

        if state is not None:  # plain arrays, as they are broadcast
            self.cls, self.inside, self.slot, self.p = state["cls"], state["inside"], state["slot"], state["p"]
            return
        n = np.asarray(subwords, np.float64) + 1e-3
        order = np.argsort(-n, kind="stable")
        self.cls = np.empty(len(n), np.int32)
        own = CLASSES - 16
        self.cls[order[:own]] = np.arange(own)
        mass = np.cumsum(n[order[own:]])
        self.cls[order[own:]] = own + np.minimum((mass / mass[-1] * 16).astype(int), 15)
        total = np.bincount(self.cls, weights=n, minlength=CLASSES)
        self.inside = np.log(n / total[self.cls]).astype(np.float32)
        rng = np.random.default_rng(3)
        f = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        # ids beyond the 2,000 most frequent share embeddings by class
        self.slot = np.empty(len(n), np.int32)
        self.slot[order] = np.arange(len(n))
        rare = self.slot >= 2000
        self.slot[rare] = 2000 + self.cls[rare]
        self.p = {"emb": f(2000 + CLASSES, WIDTH), "pos": f(WINDOW, WIDTH), "q": f(WIDTH, WIDTH), "k": f(WIDTH, WIDTH), "v": f(WIDTH, WIDTH), "mlp": f(2 * WIDTH, 2 * WIDTH), "out": f(2 * WIDTH, CLASSES) * np.float32(0.3), "bias": np.log(total / total.sum()).astype(np.float32)}

    def state(self) -> dict:
        return {"cls": self.cls, "inside": self.inside, "slot": self.slot, "p": self.p}

    def _attend(self, ids):
        import numpy as np

        p = self.p
        x = p["emb"][self.slot[ids]]
        x += p["pos"]
        q, k, v = np.split((x.reshape(-1, WIDTH) @ np.concatenate([p["q"], p["k"], p["v"]], axis=1)).reshape(*ids.shape, 3 * WIDTH), 3, axis=2)
        score = np.matmul(q, k.transpose(0, 2, 1))
        score *= np.float32(WIDTH**-0.5)
        _exp(score, _causal())
        score *= _causal()
        score *= 1 / (score @ np.ones((WINDOW, 1), np.float32))
        return x, q, k, v, score, np.concatenate([x, np.matmul(score, v)], axis=2)

    def forward(self, ids):
        """Of windows (B, WINDOW) of ids: activations, the last of which are logits for what follows each place."""
        import numpy as np

        p = self.p
        *rest, both = self._attend(ids)
        hidden = np.maximum(both.reshape(-1, 2 * WIDTH) @ p["mlp"], 0)
        logits = hidden @ p["out"] + p["bias"]
        return *rest, both, hidden.reshape(*ids.shape, -1), logits.reshape(*ids.shape, -1)

    def log_probs(self, context, target, places):
        """Natural log P(target) at the places of the windows given; only these are put out."""
        import numpy as np

        p = self.p
        hidden = np.maximum(self._attend(context)[-1][places] @ p["mlp"], 0)
        logits = hidden @ p["out"]
        logits += p["bias"]
        goal = target[places]
        own = logits[np.arange(len(goal)), self.cls[goal]]
        shift = _exp(logits)
        return own - shift - np.log(logits @ np.ones(CLASSES, np.float32)) + self.inside[goal]

    def step(self, context, target, state, rate, places=None):
        """One step of Adam on the mean loss of a batch of windows, at the places given or at all."""
        import numpy as np

        p = self.p
        x, q, k, v, a, both, hidden, logits = self.forward(context)
        flat = lambda m: m.reshape(-1, m.shape[-1])
        share = np.full(target.size, 1 / target.size, np.float32) if places is None else (places.ravel() / max(1, int(places.sum()))).astype(np.float32)
        d, at = flat(logits), (np.arange(target.size), self.cls[target].ravel())
        own = d[at]
        shift = _exp(d)
        total = d @ np.ones(CLASSES, np.float32)
        loss = (np.log(total) + shift - own).mean()
        d *= (share / total)[:, None]
        d[at] -= share
        g = {"bias": np.ones(len(d), np.float32) @ d, "out": flat(hidden).T @ d}
        dh = d @ p["out"].T
        dh *= flat(hidden) > 0
        g["mlp"] = flat(both).T @ dh
        db = (dh @ p["mlp"].T).reshape(both.shape)
        ds = np.ascontiguousarray(db[..., WIDTH:])
        dv, dz = a.transpose(0, 2, 1) @ ds, ds @ v.transpose(0, 2, 1)
        dz *= a
        dz -= a * (dz @ np.ones((WINDOW, 1), np.float32))
        dz *= np.float32(WIDTH**-0.5)
        back = flat(np.concatenate([dz @ k, dz.transpose(0, 2, 1) @ q, dv], axis=2))
        g["q"], g["k"], g["v"] = np.split(flat(x).T @ back, 3, axis=1)
        dx = flat(db[..., :WIDTH]) + back @ np.concatenate([p["q"], p["k"], p["v"]], axis=1).T
        g["pos"] = dx.reshape(x.shape).sum(axis=0)
        g["emb"] = np.zeros_like(p["emb"])
        slots = self.slot[context].ravel().astype(np.int16)
        order = np.argsort(slots, kind="stable")
        slots = slots[order]
        begin = np.flatnonzero(np.diff(slots, prepend=-1))
        g["emb"][slots[begin]] = np.add.reduceat(dx[order], begin, axis=0)
        state["t"] += 1
        for name, grad in g.items():
            m, s = state.setdefault(name, [np.zeros_like(p[name]), np.zeros_like(p[name])])
            m += 0.1 * (grad - m)
            s += 0.02 * (grad * grad - s)
            p[name] -= (rate * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(s / (1 - 0.98 ** state["t"])) + 1e-8)).astype(np.float32)
        return loss


def _keep_memory() -> None:
    """Has a worker's C library keep the memory of arrays that are freed: else every step asks the kernel for it anew."""
    import ctypes

    if vector._cache().setdefault("memory", None) is None:
        vector._cache()["memory"] = True
        try:
            for option, size in ((-3, 32 << 20), (-1, 64 << 20)):  # from where on memory is mapped, and trimmed
                ctypes.CDLL(None).mallopt(option, size)
        except (AttributeError, OSError):  # another C library
            pass


def _causal():
    import numpy as np

    return np.tril(np.ones((WINDOW, WINDOW), np.float32))


def _exp(x, keep=None):
    """Makes x its exponential in place, of each row less what is returned: its greatest, or 0 where all are near 0.

    Places of a row where keep is 0 don't count as its greatest."""
    import numpy as np

    shift = np.float32(0)
    if x.size and not -60 < x.min() <= x.max() < 60:
        if keep is not None:
            x[..., keep == 0] = -1e9
        shift = x.max(axis=-1, keepdims=True)
        x -= shift
        shift = shift[..., 0]
    np.exp(x, out=x)
    return shift


def _windows(ids, close=None, overlap: int = CONTEXT):
    """Windows over a stream of texts: contexts, targets, and the places that each window scores.

    The texts end at the places `close` of the stream (one text without it); the id before each is the end of another.
    Windows begin anew at each text, so none sees a neighbour. A window starts WINDOW - overlap after the one before;
    its first `overlap` places are context only, except in a text's first, so every id is scored once. Place i of a
    window sees the ids up to i and predicts the next.
    """
    import numpy as np

    stride = WINDOW - overlap
    last = np.array([len(ids) - 1]) if close is None else np.asarray(close)
    begin = np.concatenate([[0], last[:-1]])
    count = np.maximum(1, -(-(last - begin - overlap) // stride))
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = (np.repeat(begin, count) + number * stride)[:, None] + np.arange(WINDOW)[None, :]
    end = np.repeat(last, count)[:, None]
    places = (at < end) & ((np.arange(WINDOW)[None, :] >= overlap) | (number == 0)[:, None])
    return ids[np.minimum(at, end)], ids[np.minimum(at + 1, end)], places


def train(model: Model, streams, steps: int = STEPS, batch: int = 256):
    """Trains on windows drawn from a list of (ids, ends of texts)."""
    import numpy as np

    parts = [_windows(s, close) for s, close in streams if len(s) > 8]
    if not parts:
        return
    context, target = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    rng, state = np.random.default_rng(9), {"t": 0}
    for i in range(steps):
        pick = rng.integers(0, len(context), min(batch, len(context)))
        model.step(context[pick], target[pick], state, 0.01 * (1 - i / steps) + 1e-4)


def _streams(h, first, inverse, offsets, flat):
    """Ids of a group of texts in one stream, each text ended; and where each word's ids and each text's end lie."""
    import numpy as np

    lengths, ids = _gather(inverse, offsets, flat)
    n_docs = len(first) - 1
    word_end = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(n_docs), np.diff(first))
    stream = np.full(len(ids) + n_docs + 1, END_OF_TEXT, np.int32)
    stream[1 + np.arange(len(ids)) + np.repeat(owner, lengths)] = ids
    begin = 1 + word_end[:-1] + owner  # of each word in the stream; the leading id is the end of a text before
    close = 1 + word_end[first[1:]] + np.arange(n_docs)
    return stream, begin, lengths, close, owner


def _stream_scores(model: Model, stream, close, piece: int = 256):
    """Log probability of each id of a stream but the first, windows in batches."""
    import numpy as np

    context, target, places = _windows(stream, close)
    out = np.empty(len(stream), np.float64)
    out[0] = 0
    out[1:] = np.concatenate([model.log_probs(context[i : i + piece], target[i : i + piece], places[i : i + piece]) for i in range(0, len(context), piece)])
    return out


def train_on_all(model: Model, docs: DataFrame, copies: int, folder: str = TOKENIZERS, batch: int = 256) -> int:
    """Goes on training the model on every text of (doc_id, text), each id a target once; gives their number.

    The documents are dealt to copies of the model by hash of id and text. Each copy learns from all of its own in one
    pass, in the order of the hash, so partitions and order of rows don't count; the weights are their mean by targets.
    """
    import numpy as np

    start = docs.sparkSession.sparkContext.broadcast(model.state())
    names = sorted(model.p)

    def run(batches):
        import pyarrow as pa

        _keep_memory()
        net, state, targets, last, seen = None, {}, 0, None, 0
        rng = np.random.default_rng(5)
        out = lambda: pa.record_batch([pa.array([last], pa.int32()), pa.array([targets], pa.int64()), pa.array([b"".join(net.p[k].astype(np.float32).tobytes() for k in names)], pa.binary())], ["copy", "targets", "weights"])
        for table_ in batches:
            of = table_.column(1).to_numpy()
            if net is None:  # a partition is one copy's documents
                last = int(of[0])
                net = Model(state=start.value | {"p": {k: v.copy() for k, v in start.value["p"].items()}})
                state = {"t": 0}
            for _, _, buf, s, e, h, first in _text_groups(table_.column(0)):
                stream, _, _, close, _ = _streams(h, first, *_encode_distinct(buf, s, e, h, folder))
                context, target, places = _windows(stream, close, 0)
                order = rng.permutation(len(context))
                for i in range(0, len(order), batch):
                    pick = order[i : i + batch]
                    net.step(context[pick], target[pick], state, 0.003 / (1 + seen / 100) ** 0.5, places[pick])
                    seen += 1
                targets += int(places.sum())
        if net is not None:
            yield out()

    rank = F.xxhash64("doc_id", "text")
    dealt = docs.select("text", F.pmod(rank, F.lit(copies)).cast("int").alias("copy"), rank.alias("rank"))
    dealt = dealt.repartitionById(copies, F.col("copy")).sortWithinPartitions("rank", "text").select("text", "copy")
    found = sorted(dealt.mapInArrow(run, "copy int, targets long, weights binary").collect())
    total = sum(r["targets"] for r in found)
    if total:
        mean = sum(np.frombuffer(r["weights"], np.float32).astype(np.float64) * (r["targets"] / total) for r in found)
        at = 0
        for k in names:
            model.p[k] = mean[at : at + model.p[k].size].reshape(model.p[k].shape).astype(np.float32)
            at += model.p[k].size
    return total


def score(docs: DataFrame, folder: str = TOKENIZERS, heavy: int = HEAVY, training: int = TRAINING, steps: int = STEPS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row a row of (doc_id, text).

    Counts of words and of subword ids come from all training texts. The model of a text is a mixture, word by word:
    the attention model's probability of the word's subword ids, in windows that begin anew at each text,
    and the share of the word among all words of the corpus; the weight is that of a new word, V / (N + V) of all
    training tokens N and words V. The attention weights begin with a bounded sample of training documents and then
    learn from all of them (train_on_all).

    A scoring task holds the HEAVY most frequent words; known words beyond them and unknown ones, some percent of all
    tokens, go out with their attention log probability and meet their counts in a join, so both scores take in the
    counts of any vocabulary.

    Null and empty texts are the end token alone. Null ids count as the empty id text. Rows that share an id are scored
    each by its own text. Words are known by a 64-bit hash. An empty table gives an empty one; without training texts
    all words are unknown.
    """
    import numpy as np

    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    counts = cut(corpus_counts(docs.where("NOT held_out"), folder))
    words = counts.where("kind = 0")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sizes = sorted((r["b"], r["c"]) for r in words.groupBy(F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("b")).agg(F.count("*").alias("c")).collect())
    level, room = 0, 0
    for b, c in reversed(sizes):  # whole octaves of counts, as many as fit
        if room + c > heavy:
            level = 2 ** (b + 1)
            break
        room += c
    top = words.where(F.col("n") >= level).select("key", "n").toArrow()
    key, n = top["key"].to_numpy(), top["n"].to_numpy()
    order = np.argsort(key)
    key, n = key[order], n[order]
    subwords = np.zeros(_VOCABULARY, np.int64)
    for r in counts.where("kind = 1").collect():
        subwords[r["key"]] = r["n"]
    model = Model(subwords)
    own = lambda ks, vs, h: _lookup(ks, vs, h)

    train_docs = docs.where("NOT held_out").select("doc_id", "text")
    rank = F.xxhash64("doc_id", F.lit(5))
    edge = cut(train_docs.select(rank.alias("k")).orderBy("k").limit(training)).agg(F.max("k")).first()[0]
    texts = train_docs.where(rank <= F.lit(edge if edge is not None else 0)).orderBy("doc_id", "text").limit(2 * training).select("text").toArrow()["text"]
    groups = []
    for chunk in texts.chunks:
        for _, _, buf, s, e, h, first in _text_groups(chunk):
            stream, _, _, close, _ = _streams(h, first, *_encode_distinct(buf, s, e, h, folder))
            groups.append((stream, close))
    train(model, groups, steps)
    train_on_all(model, train_docs, min(COPIES, 1 + total // SHARE), folder)
    # the chance that a token's word is new, after Witten and Bell, is that of the attention model
    mass = float(total) or 1.0
    share = min(max(distinct / (total + distinct or 1), 0.02), 0.98)
    shared = spark.sparkContext.broadcast((key, n, model.state(), share))
    base = float(total + distinct + 1)

    def run(batches):
        import pyarrow as pa

        _keep_memory()
        ks, ns, state, mix_share = shared.value
        net = Model(state=state)
        for batch in batches:
            size = batch.num_rows
            known, tokens, base_sum, total_sum = (np.zeros(size, t) for t in (np.int64, np.int64, np.float64, np.float64))
            rare: list[list] = [[] for _ in range(size)]
            alone: list[list] = [[] for _ in range(size)]
            for lo, hi, buf, s, e, h, first in _text_groups(batch.column(1)):
                stream, begin, lengths, close, owner = _streams(h, first, *_encode_distinct(buf, s, e, h, folder))
                hashes = np.concatenate([h.view(np.int64), np.full(hi - lo, END_HASH)])
                owner = np.concatenate([owner, np.arange(hi - lo)])
                c = own(ks, ns, hashes)
                attention = _word_logs(_stream_scores(net, stream, close), begin, lengths, close)
                mixed = np.logaddexp(np.log(mix_share) + attention, np.log(np.maximum((1 - mix_share) * c / mass, 1e-300)))
                d = hi - lo
                tokens[lo:hi] = np.bincount(owner, minlength=d)
                known[lo:hi] = np.bincount(owner[c > 0], minlength=d)
                base_sum[lo:hi] = np.bincount(owner[c > 0], weights=np.log10((c[c > 0] + 1) / base), minlength=d)
                total_sum[lo:hi] = np.bincount(owner[c > 0], weights=mixed[c > 0] / np.log(10), minlength=d)
                ro, rk, ra = owner[c == 0], hashes[c == 0], attention[c == 0]
                turn = np.argsort(ro, kind="stable")
                ro, rk, ra = ro[turn], rk[turn], ra[turn]
                at = np.searchsorted(ro, np.arange(d + 1))
                for i in range(d):
                    rare[lo + i] = rk[at[i] : at[i + 1]]
                    alone[lo + i] = ra[at[i] : at[i + 1]]
            values = np.concatenate(rare).astype(np.int64) if size else np.zeros(0, np.int64)
            logs = np.concatenate(alone).astype(np.float64) if size else np.zeros(0)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rare])]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(values), pa.array(logs)], ["key", "log"])
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(tokens), pa.array(known), pa.array(base_sum), pa.array(total_sum), pa.ListArray.from_arrays(pa.array(offsets), pairs)], ["doc_id", "held_out", "n_tokens", "n_known", "base_sum", "score", "rare"])

    scored = docs.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double, rare array<struct<key: long, log: double>>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    found = scored.select("row", F.explode("rare").alias("x")).select("row", "x.key", "x.log")
    found = found.join(words.where(F.col("n") < level).select("key", "n"), "key", "left")
    count = F.coalesce(F.col("n"), F.lit(0))
    # the same mixture as in run(), with the counts of the rare
    first, second = F.col("log") + F.lit(float(np.log(share))), F.log(F.greatest(count * F.lit((1 - share) / mass), F.lit(1e-300)))
    mixture = F.greatest(first, second) + F.log1p(F.exp(F.least(first, second) - F.greatest(first, second)))
    found = found.groupBy("row").agg(
        F.sum(F.log10((count + 1) / F.lit(base))).alias("more"), F.count("n").alias("known"), F.sum(mixture / F.lit(float(np.log(10)))).alias("rest"),
    )
    out = scored.drop("rare").join(found, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base_sum") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )


def _lookup(keys, values, wanted):
    """Counts of wanted keys in sorted keys; 0 where absent."""
    import numpy as np

    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    distinct, inverse = np.unique(wanted, return_inverse=True)
    at = np.searchsorted(keys, distinct)
    at[at == len(keys)] = 0
    return np.where(keys[at] == distinct, values[at], 0)[inverse]


def _word_logs(logs, begin, lengths, close):
    """Log probability of each word, its ids' together, then of each text's end."""
    import numpy as np

    total = np.concatenate([[0.0], np.cumsum(logs)])
    return np.concatenate([total[begin + lengths] - total[begin], logs[close]])


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    """score over all documents; nulls, repeated rows and empty tables as there."""
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
