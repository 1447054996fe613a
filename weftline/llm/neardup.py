"""MinHash near-dedup: HyperMinHash registers, banding, corrected estimates, exact verification, union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vector
from .common import bounded_batches, cut, release, small_enough, table
from .components import connected_components

#: Similarity in hundredths; registers are BANDS * ROWS. A pair at 0.8 shares no band with a probability of 7e-6.
PERCENT, BANDS, ROWS = 80, 30, 5
#: Bits of the mantissa in a register; six more hold the count of leading zeros.
MANTISSA = 10
#: A pair goes to verification if its estimate is at least this: over five standard errors below the threshold.
ESTIMATE = PERCENT / 100 - 0.17
#: Members of a bucket up to which its pairs are made by a join; members of larger ones are joined by rare shingles.
BUCKET = 64
#: Most rows of ids that are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST = 1_000_000


def _constants():
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(7))
    n = BANDS * ROWS
    return rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _registers(owner, value, n: int):
    """Of texts 0 to n - 1, whose distinct shingles come sorted by text: (n, BANDS * ROWS) 16-bit registers.

    Each bucket has its own permutation; of the least 64-bit value the register keeps the number of leading zeros and
    the bits that follow the first one.
    """
    import numpy as np

    flips, factors = _constants()
    out = np.zeros((n, len(flips)), np.uint16)
    if not len(owner):
        return out
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    least = np.empty((len(flips), len(starts)), np.uint64)
    work = np.empty_like(value)
    for j in range(len(flips)):
        np.bitwise_xor(value, flips[j], out=work)
        np.multiply(work, factors[j], out=work)
        np.minimum.reduceat(work, starts, out=least[j])
    part, exponent = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))
    packed = ((64 - exponent).clip(0, 63).astype(np.uint16) << np.uint16(MANTISSA)) | ((part * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    out[owner[starts]] = packed.T
    return out


def signatures(docs: DataFrame, k: int = 2) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, registers) of (doc_id, text): the set's size, 128 bits of digest, registers."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            buf, at = vector.text_buffers(batch.column(1))
            for lo, hi in vector.groups(at):
                s, _, h = vector.words(buf, at[lo : hi + 1])
                owner, value = vector.distinct(*vector.shingles(h, vector.spans(at[lo : hi + 1], s), k))
                n = hi - lo
                sizes = np.bincount(owner, minlength=n)
                sums = []
                for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, owner, vector.mix(value ^ np.uint64(salt)))
                    sums.append(total.view(np.int64))
                regs = _registers(owner, value, n)
                width = regs.shape[1] * 2
                binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(regs.tobytes())])
                yield pa.record_batch([batch.column(0).slice(lo, n), pa.array(sizes.astype(np.int64)), *map(pa.array, sums), binary], ["doc_id", "n_shingles", "set_a", "set_b", "registers"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, registers binary")


def _estimate():
    """Keeps the pairs (a, b, ra, rb) whose estimated similarity is high enough.

    Registers of different minima coincide with a probability of about 0.17 / 2**MANTISSA, which is taken out.
    """
    collision = 0.1699 / (1 << MANTISSA)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if n:
                a, b = (np.frombuffer(c.buffers()[2], np.uint8)[np.frombuffer(c.buffers()[1], np.int32)[c.offset] :][: n * BANDS * ROWS * 2].view(np.uint16).reshape(n, -1) for c in (batch.column(2), batch.column(3)))
                guess = ((a == b).mean(axis=1) - collision) / (1 - collision)
                yield batch.select([0, 1]).filter(pa.array(guess >= ESTIMATE))

    return run


def _verify(k: int, percent: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sides = [vector.text_buffers(batch.column(i)) for i in (2, 3)]
            both = sides[0][1] + sides[1][1]
            good = np.zeros(batch.num_rows, bool)
            for lo, hi in vector.groups(both):
                sets = []
                for buf, at in sides:
                    s, _, h = vector.words(buf, at[lo : hi + 1])
                    sets.append(vector.distinct(*vector.shingles(h, vector.spans(at[lo : hi + 1], s), k)))
                n = hi - lo
                total = sum(np.bincount(o, minlength=n) for o, _ in sets)
                owner, value = (np.concatenate(x) for x in zip(*sets, strict=True))
                order = np.lexsort((value, owner))
                owner, value = owner[order], value[order]
                twice = (owner[1:] == owner[:-1]) & (value[1:] == value[:-1])
                shared = np.bincount(owner[1:][twice], minlength=n)
                good[lo:hi] = (shared > 0) & (100 * shared >= percent * (total - shared))
            yield batch.select([0, 1]).filter(pa.array(good))

    return run


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), a > b, those confirmed on full sets; a written table."""
    size = lambda s: reps.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("registers").alias(f"r{s}"))
    wide = pairs.join(size("a"), "a").join(size("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    likely = cut(wide.select("a", "b", "ra", "rb").mapInArrow(_estimate(), "a long, b long"))
    involved = cut(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    few = F.broadcast(involved) if small_enough(involved, BROADCAST) else involved
    texts = docs.join(few, docs["doc_id"] == few["id"], "left_semi")
    side = lambda s: texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"t{s}"))
    loaded = likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    out = cut(loaded.mapInArrow(_verify(k, percent), "a long, b long").distinct())
    release(likely, involved)
    return out


def _shingle_rows(docs: DataFrame, k: int) -> DataFrame:
    """(id, shingle): the distinct shingles of (doc_id, text), one row each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            buf, at = vector.text_buffers(batch.column(1))
            for lo, hi in vector.groups(at):
                s, _, h = vector.words(buf, at[lo : hi + 1])
                owner, value = vector.distinct(*vector.shingles(h, vector.spans(at[lo : hi + 1], s), k))
                yield pa.record_batch([batch.column(0).take(pa.array(owner + lo)), pa.array(value.view("int64"))], ["id", "shingle"])

    return docs.mapInArrow(run, "id long, shingle long").distinct()


def _prefixed(large: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of members (id, part) of large buckets, the pairs of different parts that can be similar enough.

    Of two sets with the similarity asked for, sorted by one order, the first n - ceil(n * percent / 100) + 1 of each
    have one in common. The order here is rarest first, so what many documents share makes no pairs; none is lost.
    """
    few = F.broadcast(large) if small_enough(large, BROADCAST) else large
    rows = cut(_shingle_rows(docs.join(few, docs["doc_id"] == few["id"], "left_semi").select("doc_id", "text"), k))
    often = rows.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    order = Window.partitionBy("id").orderBy(F.coalesce("often", F.lit(1)), "shingle")
    ranked = rows.join(often, "shingle", "left").withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("id")))
    first = ranked.where(f"place <= n - ceil(n * {percent} / 100) + 1 AND often > 1").join(large, "id").select("id", "part", "n", "shingle")
    mixed = first.groupBy("shingle").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("shingle")
    first = cut(first.join(mixed, "shingle", "left_semi"))
    both = first.alias("x").join(first.alias("y"), F.expr(f"x.shingle = y.shingle AND x.id > y.id AND x.part <> y.part AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"))
    out = cut(both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
    release(rows, first)
    return out


def components(docs: DataFrame, k: int = 2, percent: int = PERCENT, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text), one row a row of the input.

    1. Equal sets, by 128 bits of digest, are one class: only the smallest id of each goes on.
    2. Registers are banded. In each bucket every member is tried against the smallest and the largest id only; pairs
       that pass the size bound and the corrected estimate are verified on full sets, and union-find contracts them.
       Groups of thousands of near copies end here as one component, with a pair or two for each member and band.
    3. Members of one bucket that are in different components still are tried against each other, so no link is lost
       for want of the right centre: small buckets all with all, large ones where two share one of their rarest
       shingles, which every link does. Then union-find runs again.

    Null ids are linked with nothing (component null, kept). Rows that share an id are one node, with the links of all
    their texts. Null, empty and blank texts have an empty set and no links. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sigs = cut(signatures(docs, k))
    full = sigs.where("doc_id IS NOT NULL AND n_shingles > 0")
    reps = cut(full.groupBy("set_a", "set_b", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("id"), F.first("registers").alias("registers")))
    width = 2 * ROWS
    keys = F.array(*(F.xxhash64(F.substring("registers", b * width + 1, width), F.lit(b)) for b in range(BANDS)))
    rows = reps.select("id", F.explode(keys).alias("key")).distinct()
    ends = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    shared = cut(rows.join(ends, "key"))
    stars = shared.select(F.col("id").alias("a"), F.explode(F.array("low", "high")).alias("b"))
    stars = cut(stars.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    links = _links(stars, reps, docs, k, percent)
    first = cut(connected_components(links))
    placed = shared.select("key", "id").join(first, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    apart = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("size")).where("p < q")
    left = cut(placed.join(apart.select("key", "size"), "key"))
    small, large = left.where(F.col("size") <= bucket), cut(left.where(F.col("size") > bucket).select("id", "part").distinct())
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(y, F.expr("x.key = y.key AND x.id > y.id AND x.part <> y.part")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    if not large.isEmpty():
        pairs = pairs.unionByName(_prefixed(large, docs, k, percent))
    pairs = cut(pairs.distinct().join(stars, ["a", "b"], "left_anti"))
    more = _links(pairs, reps, docs, k, percent)
    copies = full.join(reps.select("set_a", "set_b", F.col("n").alias("n_shingles"), "id"), ["set_a", "set_b", "n_shingles"])
    same = copies.where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    final = cut(connected_components(links.unionByName(more).unionByName(same)))
    out = sigs.join(final, F.col("doc_id") == F.col("node"), "left")
    root = F.coalesce("component", "doc_id")
    release(first, shared, stars, left, large, pairs, links, more, reps)
    return out.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(root == F.col("doc_id"), F.lit(True)).alias("kept"))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    """components over all documents; nulls, repeated ids and empty tables as there."""
    return components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def filter_documents(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, with its own columns.

    Rows that share an id and a text are one document: one of them stays. Rows that share an id with different texts go
    or stay together. Only rows of repeated ids are shuffled for it.
    """
    verdict = components(docs.select("doc_id", "text"), k, percent)
    gone = cut(verdict.where("NOT kept").select(F.col("doc_id").alias("_w_gone")).distinct())
    twice = cut(docs.groupBy(F.col("doc_id").alias("_w_twice")).agg(F.count("*").alias("_w_n")).where("_w_n > 1").select("_w_twice"))
    gone = F.broadcast(gone) if small_enough(gone, BROADCAST) else gone
    left = docs.join(gone, F.col("doc_id") == F.col("_w_gone"), "left_anti")
    if twice.isEmpty():
        return left
    again = F.broadcast(twice) if small_enough(twice, BROADCAST) else twice
    same = F.col("doc_id").eqNullSafe(F.col("_w_twice"))
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id AS id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id JOIN n na ON na.id = a.id JOIN n nb ON nb.id = b.id
      GROUP BY a.id, b.id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.id = d.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = d.doc_id
"""
