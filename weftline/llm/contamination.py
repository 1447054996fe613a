"""Benchmark decontamination: size-partitioned MinHash containment search for short items in long documents."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vector
from .common import bounded_batches, cut, table

#: Words of a shingle, and the share of an item's shingles that a document must hold.
SHINGLE, SHARE = 5, 0.8
#: A class of sizes up to 2**p has signatures of 2**(p + BIN_BITS) bins: one bin for one to two shingles of a document.
BIN_BITS = -1
#: Items of fewer shingles than this are searched by all their shingles, not by a signature.
SHORT = 16
#: Shingles of items that one search broadcasts (12 bytes each, some 50 MB); more items are searched in blocks.
BLOCK = 4_000_000

_FOUND = T.StructType([
    T.StructField("n_shingles", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("item_id", T.LongType()),
    T.StructField("containment", T.DoubleType()), T.StructField("kept", T.BooleanType()),
])


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(item, shingle) of all items, distinct; items without an id or a word have none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            buf, at = vector.text_buffers(batch.column(1))
            for lo, hi in vector.groups(at):
                s, _, h = vector.words(buf, at[lo : hi + 1])
                owner, value = vector.distinct(*vector.shingles(h, vector.spans(at[lo : hi + 1], s), k))
                yield pa.record_batch([batch.column(0).take(pa.array(owner + lo)), pa.array(value.view("int64"))], ["item", "shingle"])

    source = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "item long, shingle long").distinct()


def _index(rows) -> dict:
    """Of one block of items, an Arrow table: sorted shingles with their items, as plain arrays."""
    import numpy as np

    ids, item, sizes = np.unique(rows["item"].to_numpy(), return_inverse=True, return_counts=True)
    value = np.ascontiguousarray(rows["shingle"].to_numpy()).view(np.uint64)
    order = np.lexsort((item, value))
    return {"ids": ids, "sizes": sizes, "value": value[order], "item": item[order]}


def _bin(value, bits: int):
    """The bin of each hash: its first bits."""
    import numpy as np

    return (value >> np.uint64(1)) >> np.uint64(63 - bits)


def _signature_keys(index: dict, bits: int):
    """Shingles that are the least of their bin in some item's signature of 2**bits bins, and all of short items."""
    import numpy as np

    order = np.lexsort((index["value"], index["item"]))
    value, item = index["value"][order], index["item"][order]
    place = _bin(value, bits)
    least = np.ones(len(value), bool)
    least[1:] = (item[1:] != item[:-1]) | (place[1:] != place[:-1])
    return np.unique(value[least | (index["sizes"][item] < SHORT)])


def _search(block, share: float, k: int, text_at: int, names: list[str]):
    import numpy as np
    import pyarrow as pa

    def found(values, keys):
        if not len(keys):
            return np.zeros(len(values), bool)
        at = np.searchsorted(keys, values)
        at[at == len(keys)] = 0
        return keys[at] == values

    def candidates(owner, value, sizes, index, short, bits_of):
        """Texts whose signature meets that of an item, class by class: a class holds sizes from 2**(p-1) + 1 to 2**p."""
        out = np.zeros(len(sizes), bool)
        level = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
        for p in np.unique(level[sizes > 0]):
            bits = max(int(p) + BIN_BITS, 0)
            if bits not in bits_of:
                bits_of[bits] = _signature_keys(index, bits)
            mine = level[owner] == p
            o, v = owner[mine], value[mine]
            place = _bin(v, bits)  # values of a text come sorted: the first of a bin is its minimum
            least = np.ones(len(v), bool)
            least[1:] = (o[1:] != o[:-1]) | (place[1:] != place[:-1])
            out[o[least][found(v[least], bits_of[bits])]] = True
            out[o[found(v, short)]] = True
        return out

    def run(batches):
        index, bits_of = block.value, {}
        uniq, first = np.unique(index["value"], return_index=True)
        first = np.append(first, len(index["value"]))
        short = np.unique(index["value"][index["sizes"][index["item"]] < SHORT])
        for batch in batches:
            n = batch.num_rows
            n_shingles, n_items = np.zeros(n, np.int64), batch.column(names.index("n_items")).to_numpy(zero_copy_only=False).copy()
            best = batch.column(names.index("containment")).to_numpy(zero_copy_only=False).copy()
            best_id = batch.column(names.index("item_id")).to_numpy(zero_copy_only=False).astype(object)
            buf, at = vector.text_buffers(batch.column(text_at))
            for lo, hi in vector.groups(at):
                s, _, h = vector.words(buf, at[lo : hi + 1])
                owner, value = vector.distinct(*vector.shingles(h, vector.spans(at[lo : hi + 1], s), k))
                sizes = np.bincount(owner, minlength=hi - lo)
                n_shingles[lo:hi] = sizes
                maybe = candidates(owner, value, sizes, index, short, bits_of)
                if not maybe.any():
                    continue
                held = maybe[owner]  # the exact containment, on all shingles of the candidates
                o, v = owner[held], value[held]
                hit = found(v, uniq)
                o, where = o[hit], np.searchsorted(uniq, v[hit])
                times = first[where + 1] - first[where]
                o = np.repeat(o, times)
                flat = np.repeat(first[where], times) + np.arange(len(o)) - np.repeat(np.cumsum(times) - times, times)
                pair, shared = np.unique(o * len(index["ids"]) + index["item"][flat], return_counts=True)
                doc, item = pair // len(index["ids"]), pair % len(index["ids"])
                part = shared / index["sizes"][item]
                good = part >= share
                for d, i, c in zip(doc[good] + lo, item[good], part[good], strict=True):
                    n_items[d] += 1
                    if (-c, index["ids"][i]) < (-best[d], best_id[d] if best_id[d] is not None else 2**63):
                        best[d], best_id[d] = c, int(index["ids"][i])
            best_id = [None if x is None or x != x else int(x) for x in best_id]
            made = {"n_shingles": pa.array(n_shingles), "n_items": pa.array(n_items), "item_id": pa.array(best_id, pa.int64()), "containment": pa.array(best), "kept": pa.array(n_items == 0)}
            yield pa.record_batch([made.get(x, batch.column(i)) for i, x in enumerate(names)], names)

    return run


def search(docs: DataFrame, items: DataFrame, text_col: str = "text", share: float = SHARE, k: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """Adds n_shingles, n_items (contained), item_id and containment of the best, and kept (none is contained).

    Sets are those of distinct lower-cased k-word shingles; a text of fewer words is one shingle. Documents fall in
    classes of size, and a class has signatures with half as many bins as its largest member has shingles: one
    permutation, the least hash of each bin, so a signature is a sketch of under two thirds of a document's set. A shingle
    that document and item share is in both signatures with a chance of 0.43 or more, so an item of m shingles that is
    held to 0.8 is missed with a probability under 0.57 ** (0.8 * m), 8e-4 at 16; items of under 16 are searched by all
    their shingles. A document that meets an item in its class's signature is verified on full sets.

    The items are the stated query set. Up to BLOCK of their shingles are broadcast; more are searched in blocks of
    that size, one after the other on the same rows. No document is shuffled. Null and empty texts hold nothing and
    are kept; items without an id or words are contained nowhere; repeated ids are one item; of equal containment the
    smaller id is told; input columns with an added name are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shingled = cut(item_shingles(items, k=k))
    total = shingled.count()
    blocks = 1 if total <= block else math.ceil(1.2 * total / block)
    own = [c for c in docs.columns if c not in _FOUND.names]
    out = docs.select(
        *(F.col(f"`{c}`") for c in own), F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_items"),
        F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("containment"), F.lit(True).alias("kept"),
    )
    schema = T.StructType([*(docs.schema[c] for c in own), *_FOUND.fields])
    for b in range(blocks):
        part = shingled if blocks == 1 else shingled.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        held = spark.sparkContext.broadcast(_index(part.toArrow()))
        out = out.mapInArrow(_search(held, share, k, schema.names.index(text_col), schema.names), schema)
    return out


def filter_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with their own columns, those with an added name included."""
    if not set(docs.columns) & set(_FOUND.names):
        return search(docs, items).where("kept").select(docs.columns)
    return search(docs.select(F.struct("*").alias("_w_row"), "text"), items).where("kept").select("_w_row.*")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """search over all documents for all benchmark items; nulls, ties and empty tables as there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, table(spark, sf_dir, "benchmark")).drop("text").withColumn("contaminated", ~F.col("kept"))


def _sets(name: str, key: str) -> str:
    words = rf"SELECT {key} AS id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM {name}"
    return f"SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ')) END) AS g FROM ({words})"


OP9_SQL = f"""
WITH d AS ({_sets('documents', 'doc_id')}), i AS ({_sets('benchmark', 'item_id')}),
n AS (SELECT id, count(*) AS n FROM d GROUP BY id), m AS (SELECT id, count(*) AS n FROM i GROUP BY id),
p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) / any_value(m.n) AS c FROM d JOIN i USING (g) JOIN m ON m.id = i.id GROUP BY d.id, i.id),
b AS (SELECT doc_id, count(*) AS n_items, arg_min(item_id, (-c, item_id)) AS item_id, max(c) AS c FROM p WHERE c >= {SHARE} GROUP BY doc_id)
SELECT x.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(b.n_items, 0) AS n_items, b.item_id, CAST(coalesce(b.c, 0) AS DOUBLE) AS containment,
       b.doc_id IS NULL AS kept, b.doc_id IS NOT NULL AS contaminated
FROM documents x LEFT JOIN n ON n.id = x.doc_id LEFT JOIN b ON b.doc_id = x.doc_id
"""
