"""Dictionary matching over texts: phrases, spans, quantities, compounds and tiers of looser and looser keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import cover

_WORD = r"[^\x20\x09-\x0D]+"


def token_table(docs: DataFrame, id_col: str, words: Column) -> DataFrame:
    """(id, at, token): one row a token, in order, from an array of words."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(words).alias("at", "token"))


def phrase_matches(docs: DataFrame, id_col: str, words: Column, phrases: DataFrame, phrase: str, longest: int) -> DataFrame:
    """(id, start, end, phrase): every place where the words of a listed phrase stand, overlaps included.

    Each word is a row with the words after it. Only words that start a listed phrase make n-grams, which are joined to
    the list by hash; lists are broadcast by the optimiser while they are small and shuffled beyond. Texts are never
    compared to phrases one by one.
    """
    first = lambda c: F.substring_index(c, " ", 1)
    listed = phrases.select(F.col(phrase).alias("gram")).where("gram IS NOT NULL").distinct()
    starts = listed.select(first("gram").alias("head")).distinct()
    ws = docs.select(F.col(id_col).alias("id"), words.alias("_w_ws"))
    after = [F.slice("_w_ws", k + 1, F.greatest(F.size("_w_ws") - k, F.lit(0))).alias(f"w{k}") for k in range(longest)]
    rows = ws.select("id", F.size("_w_ws").alias("n"), F.arrays_zip(*after).alias("g")).select("id", "n", F.posexplode("g").alias("start", "g")).select("id", "n", "start", "g.*")
    rows = rows.withColumn("head", first(F.coalesce("w0", F.lit("")))).join(starts, "head", "left_semi")
    gram = lambda k: F.when(F.col("start") + k <= F.col("n"), F.struct((F.col("start") + k).alias("end"), F.concat_ws(" ", *(f"w{i}" for i in range(k))).alias("gram")))
    grams = rows.select("id", "start", F.explode(F.array(*(gram(k) for k in range(1, longest + 1)))).alias("g")).where("g IS NOT NULL").select("id", "start", "g.end", "g.gram")
    return grams.join(listed, "gram").select("id", "start", "end", F.col("gram").alias("phrase"))


def longest_matches(matches: DataFrame) -> DataFrame:
    """Of (id, start, end, phrase), the cover without overlaps: leftmost first, then longest. A fold within one text."""
    per = matches.groupBy("id").agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(0).alias("priority"), F.col("phrase").alias("id"))).alias("s"))
    return per.select("id", F.explode(cover(F.col("s"))).alias("x")).select("id", "x.start", "x.end", F.col("x.id").alias("phrase"))


def uncovered(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Tokens (id, at, ...) that no span (id, start, end) covers: an anti join on the text and the places spans hold.

    Spans are laid out place by place, so the join is by equality; a long span costs its length.
    """
    held = spans.select("id", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("at")).distinct()
    return tokens.join(held, ["id", "at"], "left_anti")


def count_uncovered(docs: DataFrame, id_col: str, words: Column, spans: DataFrame) -> DataFrame:
    """(id, n): how many tokens of each id no span covers, where any is left; the counts of `uncovered` by id.

    Tokens are counted where they stand; only the places that spans hold are shuffled, one row an id.
    """
    own = docs.select(F.col(id_col).alias("id"), F.size(words).alias("_w_n"))
    held = spans.where("end > start").groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("_w_s"))
    places = F.array_distinct(F.flatten(F.transform("_w_s", lambda x: F.sequence(x["start"], x["end"] - 1))))
    held = held.select("id", places.alias("_w_at"))
    # an id that stands in several rows: each has its own length, all share the places
    free = F.col("_w_n") - F.coalesce(F.size(F.filter("_w_at", lambda a: (a >= 0) & (a < F.col("_w_n")))), F.lit(0))
    free = F.when(F.col("_w_at").isNull(), F.col("_w_n")).otherwise(free)
    return own.join(held, "id", "left").groupBy("id").agg(F.sum(free.cast("long")).alias("n")).where("n > 0")


def fill_free(spans: DataFrame, others: DataFrame) -> DataFrame:
    """The spans of a second source (id, start, end, ...) that overlap none of the first."""
    cells = lambda df: df.select("id", "start", "end", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("at"))
    hit = cells(others).join(cells(spans).select("id", "at").distinct(), ["id", "at"], "left_semi").select("id", "start", "end").distinct()
    return others.join(hit, ["id", "start", "end"], "left_anti")


def label(docs: DataFrame, id_col: str, words: Column, gazetteer: DataFrame, second: DataFrame | None = None, longest: int = 4) -> DataFrame:
    """(id, start, end, surface, type, source): spans of a gazetteer (surface, type), then those of a second source
    where free, resolved to a cover: leftmost, longest, first source, then type."""
    found = phrase_matches(docs, id_col, words, gazetteer, "surface", longest).withColumnRenamed("phrase", "surface").join(gazetteer, "surface").select("id", "start", "end", "surface", "type", F.lit(0).alias("source"))
    if second is not None:
        found = found.unionByName(fill_free(found, second).select("id", "start", "end", "surface", "type", F.lit(1).alias("source")))
    key = F.to_json(F.struct("surface", "type"))
    per = found.groupBy("id").agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("source").alias("priority"), key.alias("id"))).alias("s"))
    out = per.select("id", F.explode(cover(F.col("s"))).alias("x"))
    own = F.from_json("x.id", "surface string, type string")
    return out.select("id", "x.start", "x.end", own["surface"].alias("surface"), own["type"].alias("type"), F.col("x.priority").alias("source"))


def quantities(text: Column, aliases: list[str], window: int = 8) -> Column:
    """Array of (unit, number): each unit in a text with the number within `window` characters after it, else before it."""
    names = "|".join(sorted((a.replace(".", r"\.") for a in aliases), key=len, reverse=True))
    number = "([0-9]+(?:[/.][0-9]+)?)"
    hit = rf"(?:{number}[^0-9]{{0,{window}}})?\b({names})\b(?:[^0-9\n]{{0,{window}}}?{number})?"
    part = lambda i: F.regexp_extract_all(text, F.lit(hit), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("l"), part(2).alias("u"), part(3).alias("r"))
    return F.transform(zipped, lambda x: F.struct(x["u"].alias("unit"), F.coalesce(F.nullif(x["r"], F.lit("")), F.nullif(x["l"], F.lit(""))).alias("number")))


def lookup(terms: DataFrame, term: str, candidates: Column, lexicon: DataFrame, key: str, value: str) -> DataFrame:
    """Adds `found`: the value of the first candidate key, in order, that the lexicon has; null if it has none."""
    rows = terms.select(F.col(term), F.posexplode_outer(candidates).alias("_w_rank", "_w_key"))
    hits = rows.join(lexicon.select(F.col(key).alias("_w_key"), F.col(value).alias("_w_value")), "_w_key")
    best = hits.groupBy(term).agg(F.min_by("_w_value", "_w_rank").alias("found"))
    return terms.join(best, term, "left")


def stems(word: Column, suffixes=("s", "es", "ed", "ing", "n")) -> Column:
    """A word and what is left of it without each suffix, in order, for dictionary lookup."""
    cut = [F.when(word.endswith(s) & (F.length(word) > len(s) + 2), F.substring(word, F.lit(1), F.length(word) - len(s))) for s in suffixes]
    return F.filter(F.array(word, *cut), lambda x: x.isNotNull())


def compounds(words: DataFrame, word: str, dictionary: DataFrame, key: str, least: int = 3, low: int = 6, high: int = 22) -> DataFrame:
    """(word, parts): each word of low to high letters as two or three dictionary words of `least` letters or more.

    The split with the longest first part wins, fewer parts first where it ends the word; the dictionary is joined by
    hash once a depth, and only words that a dictionary prefix starts go to the next.
    """
    entry = dictionary.select(F.col(key).alias("_w_k")).where(F.length("_w_k") >= least).distinct()
    rows = words.select(F.col(word).alias("w")).where(F.length("w").between(low, high)).distinct()
    cuts = F.explode(F.expr(f"filter(sequence({least}, length(rest)), i -> length(rest) - i = 0 OR length(rest) - i >= {least})"))

    def peel(df: DataFrame) -> DataFrame:
        out = df.select("w", "parts", "rest", cuts.alias("i")).select("w", "parts", F.expr("substring(rest, 1, i)").alias("_w_k"), F.expr("substring(rest, i + 1)").alias("rest"))
        return out.join(entry, "_w_k").select("w", F.concat("parts", F.array("_w_k")).alias("parts"), "rest")

    open_ = rows.select("w", F.expr("cast(array() as array<string>)").alias("parts"), F.col("w").alias("rest"))
    one = peel(open_).where("rest <> ''")
    two = peel(one)
    three = peel(two.where("rest <> ''")).where("rest = ''")
    whole = two.where("rest = ''").unionByName(three)
    order = F.transform("parts", lambda p: -F.length(p))
    return whole.groupBy("w").agg(F.min_by("parts", order).alias("parts")).select(F.col("w").alias(word), F.array_join("parts", "+").alias("parts"))


def tiers(terms: DataFrame, term: str, index: DataFrame, name: str, target: str, keys, near: int | None = 1) -> DataFrame:
    """(term, target, tier): the first tier that matches. `keys` are key functions, from exact to loose; the last tier
    takes names within `near` edits that share length class and first letter. Ties within a tier: the least target.

    Each key is one equi join over what earlier tiers left; edits are compared within blocks, not all with all.
    """
    left = terms.select(F.col(term)).where(F.col(term).isNotNull()).distinct()
    done = None
    for t, key in enumerate(keys):
        side = index.select(key(F.col(name)).alias("_w_key"), F.col(target).alias("_w_target"))
        hit = left.withColumn("_w_key", key(F.col(term))).where("_w_key <> ''").join(side, "_w_key").groupBy(term).agg(F.min("_w_target").alias(target)).withColumn("tier", F.lit(t))
        done = hit if done is None else done.unionByName(hit)
        left = left.join(hit, term, "left_anti")
    if near:
        block = lambda c: F.substring(F.lower(c), 1, 1)
        side = index.select(F.col(name).alias("_w_name"), F.col(target).alias("_w_target"), block(F.col(name)).alias("_w_b"), F.length(name).alias("_w_l"))
        own = left.select(term, block(F.col(term)).alias("_w_b"), F.explode(F.sequence(F.length(term) - near, F.length(term) + near)).alias("_w_l"))
        hit = own.join(side, ["_w_b", "_w_l"]).where(F.levenshtein(F.lower(term), F.lower("_w_name")) <= near).groupBy(term).agg(F.min("_w_target").alias(target)).withColumn("tier", F.lit(len(keys)))
        done = done.unionByName(hit)
    return terms.select(term).distinct().join(done, term, "left")


def greedy_pairs(left: DataFrame, right: DataFrame, group: str, at: str, ids: tuple[str, str], within: float) -> DataFrame:
    """(group, left id, right id, gap): one-to-one nearest pairs within a distance: the closest pair first, then the next
    among the free. A fold within a group over its pairs, which the distance bounds."""
    a, b = left.select(F.col(group), F.col(ids[0]).alias("_w_a"), F.col(at).alias("_w_x")), right.select(F.col(group), F.col(ids[1]).alias("_w_b"), F.col(at).alias("_w_y"))
    cell = lambda c: F.floor(F.col(c) / F.lit(within)).cast("long")
    near = a.withColumn("_w_c", F.explode(F.sequence(cell("_w_x") - 1, cell("_w_x") + 1))).join(b.withColumn("_w_c", cell("_w_y")), [group, "_w_c"])
    gap = F.abs(F.col("_w_x") - F.col("_w_y"))
    per = near.where(gap <= within).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(gap.alias("gap"), F.col("_w_a").alias("a"), F.col("_w_b").alias("b")))).alias("p"))
    none = F.slice(F.col("p"), 1, 0)
    step = lambda kept, x: F.when(F.exists(kept, lambda k: (k["a"] == x["a"]) | (k["b"] == x["b"])), kept).otherwise(F.concat(kept, F.array(x)))
    out = per.select(group, F.explode(F.aggregate("p", none, step)).alias("x"))
    return out.select(group, F.col("x.a").alias(ids[0]), F.col("x.b").alias(ids[1]), F.col("x.gap").alias("gap"))


def first_seen(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in order; a window over keys, which adaptive execution splits no further than a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_w_k", F.row_number().over(w)).where("_w_k = 1").drop("_w_k")
