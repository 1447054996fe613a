"""Corpus statistics over tables of tokens: vocabulary, concentration, growth, Kneser-Ney, correlation, resampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep


def counts(tokens: DataFrame, group: str, unit: str) -> DataFrame:
    """(group, unit, n): how often each unit occurs in a group; combined before the shuffle. Null units are no units."""
    return tokens.where(F.col(unit).isNotNull()).groupBy(group, unit).agg(F.count("*").alias("n"))


def classes(freq: DataFrame, group: str) -> DataFrame:
    """(group, n, types, above): how many units have each frequency, and how many a higher one.

    There are far fewer frequencies than units (about the root of twice the tokens), so the window that ranks them is small
    whatever the vocabulary.
    """
    per = freq.groupBy(group, "n").agg(F.count("*").alias("types"))
    over = Window.partitionBy(group).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("above", F.coalesce(F.sum("types").over(over), F.lit(0)))


def vocabulary(freq: DataFrame, group: str) -> DataFrame:
    """Tokens, types, type-token ratio, units seen once and twice with their shares of the types."""
    out = freq.groupBy(group).agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_types"), F.count_if(F.col("n") == 1).alias("hapax"), F.count_if(F.col("n") == 2).alias("dis"))
    share = lambda c: F.col(c) / F.col("n_types")
    return out.select("*", (F.col("n_types") / F.col("n_tokens")).alias("ttr"), share("hapax").alias("hapax_share"), share("dis").alias("dis_share"))


def topk_coverage(freq: DataFrame, group: str, k: int = 100) -> DataFrame:
    """Share of all tokens that the k most frequent units cover; whole classes of frequency, ties cut at k."""
    c = classes(freq, group)
    taken = F.greatest(F.lit(0), F.least(F.col("types"), F.lit(k) - F.col("above")))
    return c.groupBy(group).agg((F.sum(taken * F.col("n")) / F.sum(F.col("types") * F.col("n"))).alias("coverage"))


def entropy(freq: DataFrame, group: str) -> DataFrame:
    """Entropy in bits, and as a share of that of equally frequent units; from sums of n log n, so in one pass."""
    s = freq.groupBy(group).agg(F.sum("n").alias("t"), F.count("*").alias("v"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("x"))
    h = F.log2(F.col("t").cast("double")) - F.col("x") / F.col("t")
    return s.select(group, h.alias("entropy"), _normalised(F.col("t"), F.col("v"), F.col("x")).alias("normalised"))


def _normalised(t: Column, v: Column, x: Column) -> Column:
    """Entropy as a share of the most, from the sums of n, of 1 and of n log2 n."""
    return (F.log2(t.cast("double")) - x / t) / F.when(v > 1, F.log2(v.cast("double"))).otherwise(1.0)


def renyi_efficiency(freq: DataFrame, group: str, alphas=(0.5, 1.0, 2.0, 2.5)) -> DataFrame:
    """(group, alpha, efficiency): Rényi entropy over log2 of the types; Shannon's at 1. Null below two types.

    One pass: each order is a sum over the units' counts, all in one aggregate.
    """
    total = freq.groupBy(group).agg(F.sum("n").alias("_t"), F.count("*").alias("_v"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("_x"), *(F.sum(F.pow(F.col("n").cast("double"), F.lit(float(a)))).alias(f"_p{i}") for i, a in enumerate(alphas)))
    t = F.col("_t").cast("double")

    def value(i: int, a: float) -> Column:
        if abs(a - 1) < 1e-9:
            return F.log2(t) - F.col("_x") / t
        return (F.log2(F.col(f"_p{i}")) - a * F.log2(t)) / (1 - a)

    rows = F.explode(F.array(*(F.struct(F.lit(float(a)).alias("alpha"), (value(i, a) / F.log2(F.col("_v").cast("double"))).alias("efficiency")) for i, a in enumerate(alphas))))
    return total.where("_v > 1").select(group, rows.alias("x")).select(group, "x.alpha", "x.efficiency")


def zipf_slope(freq: DataFrame, group: str, least: int = 5) -> DataFrame:
    """Least-squares slope of ln frequency on ln rank, for groups of at least so many types.

    Ranks are laid out class by class, so no task sorts the vocabulary.
    """
    c = classes(freq, group)
    ranked = c.select(group, "n", F.explode(F.sequence(F.col("above") + 1, F.col("above") + F.col("types"))).alias("rank"))
    slope = F.regr_slope(F.log(F.col("n").cast("double")), F.log(F.col("rank").cast("double")))
    return ranked.groupBy(group).agg(F.count("*").alias("v"), slope.alias("slope")).where(F.col("v") >= least).select(group, "slope")


def growth_grid(n: int, points: int = 25) -> list[int]:
    """Distinct whole numbers, spaced geometrically from max(20, n / 100) to n."""
    low = max(20, n // 100)
    return sorted({int(low * (n / low) ** (i / (points - 1))) if i < points - 1 else n for i in range(points)})


def heaps_beta(tokens: DataFrame, group: str, unit: str, at: str, points: int = 25, least: int = 50, size: DataFrame | None = None) -> DataFrame:
    """Slope of ln V on ln N over a geometric grid, from (group, unit, at) with `at` a token's place from 1 on.

    A type counts from its first place: an aggregate, then one count of types a grid cell, and a running sum over cells.
    `size`, (group, n), spares a pass over the tokens where their numbers are known.
    """
    size = tokens.groupBy(group).agg(F.max(at).alias("n")) if size is None else size
    size = {r[group]: r["n"] for r in size.select(group, "n").collect() if r["n"] and r["n"] >= least}  # one row a group
    spark = tokens.sparkSession
    cells = [(g, i, x) for g, n in size.items() for i, x in enumerate(growth_grid(n, points))]
    grid = spark.createDataFrame(cells, f"{group} {tokens.schema[group].dataType.simpleString()}, cell int, upto long")
    edges = F.broadcast(grid.groupBy(group).agg(F.array_sort(F.collect_list("upto")).alias("edges")))
    first = tokens.where(F.col(unit).isNotNull()).groupBy(group, unit).agg(F.min(at).alias("first"))
    placed = first.join(edges, group).select(group, F.size(F.filter("edges", lambda e: e < F.col("first"))).alias("cell"))
    new = placed.groupBy(group, "cell").agg(F.count("*").alias("new"))
    over = Window.partitionBy(group).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    curve = grid.join(new, [group, "cell"], "left").withColumn("v", F.sum(F.coalesce("new", F.lit(0))).over(over)).where("v > 0")
    slope = F.regr_slope(F.log(F.col("v").cast("double")), F.log(F.col("upto").cast("double")))
    return curve.groupBy(group).agg(F.count("*").alias("k"), slope.alias("beta")).where("k >= 3").select(group, "beta")


def places(docs: DataFrame, group: str, order: str, size: Column, buckets: int = 64) -> DataFrame:
    """Adds `before`: the running sum of `size` over a group's rows before this one, in order (unique), nulls first.

    Rows fall in buckets by quantiles of the order; sums of buckets are added up first, then rows within a bucket, so no
    group is one task.
    """
    cuts = sorted(set(docs.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.01)))
    bucket = F.coalesce(F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c < F.col(order))), F.lit(-1)) if cuts else F.lit(0)
    rows = docs.withColumn("_w_bucket", bucket).withColumn("_w_size", size.cast("long"))
    sums = rows.groupBy(F.col(group).alias("_w_group"), F.col("_w_bucket").alias("_w_b")).agg(F.sum("_w_size").alias("_w_sum"))
    ahead = Window.partitionBy("_w_group").orderBy("_w_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_w_group", "_w_b", F.coalesce(F.sum("_w_sum").over(ahead), F.lit(0)).alias("_w_start"))
    joined = rows.join(starts, F.col(group).eqNullSafe(F.col("_w_group")) & (F.col("_w_bucket") == F.col("_w_b")))
    within = Window.partitionBy("_w_group", "_w_bucket").orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumn("before", F.col("_w_start") + F.coalesce(F.sum("_w_size").over(within), F.lit(0)))
    return out.drop("_w_bucket", "_w_size", "_w_group", "_w_b", "_w_start")


def draw(seed: str, upto: Column, *keys: Column) -> Column:
    """A whole number from 0 to upto - 1 that the seed and keys fix: the first 28 bits of an md5."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *(k.cast("string") for k in keys)))
    return F.pmod(F.conv(F.substring(digest, 1, 7), 16, 10).cast("long"), upto)


def block_bootstrap(texts: DataFrame, group: str, units: str, before: str, replicates: int = 20, seed: str = "boot", size: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((group, rep, e), (group, point)): normalised entropy of resampled blocks and of all, of texts (group, units, before).

    Each replicate draws n / b blocks of b = round(root n) units. Where blocks start and end, a group falls into stretches
    in which each replicate has each unit equally often. Texts are cut at these, and a unit is counted once for all
    replicates with its weight in each: one aggregate, as wide as the vocabulary. Groups of under two units have no
    replicates. Starts and stretches grow as the root of the text. `size`, (group, n), spares a pass where it is known.
    """
    size = texts.groupBy(group).agg(F.max(F.col(before) + F.size(units)).cast("long").alias("n")) if size is None else size
    size = keep(size.where("n >= 2").withColumn("b", F.greatest(F.lit(2), F.round(F.sqrt("n")).cast("long"))))
    reps = size.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("block", F.explode(F.expr("sequence(0L, greatest(1L, n div b) - 1)")))
    starts = reps.select(group, "n", "b", "rep", draw(seed, F.col("n") - F.col("b") + 1, F.col(group), F.col("rep"), F.col("block")).alias("start"))
    # at each edge the replicate's weight steps up or down; sums of steps are the weights up to the next edge
    ends = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct((F.col("start") + F.col("b")).alias("at"), F.lit(-1).alias("step"))))
    edges = starts.select(group, "rep", ends.alias("x")).select(group, "rep", "x.*")
    steps = edges.groupBy(group, "at").agg(*(F.sum(F.when(F.col("rep") == r, F.col("step")).otherwise(0)).alias(f"s{r}") for r in range(replicates)))
    steps = steps.unionByName(size.select(group, F.lit(0).cast("long").alias("at"), *(F.lit(0).cast("long").alias(f"s{r}") for r in range(replicates))))
    along = Window.partitionBy(group).orderBy("at")
    weights = F.array(*(F.sum(f"s{r}").over(along) for r in range(replicates)))  # equal places: a range frame sums them alike
    laid = steps.select(group, "at", weights.alias("k"), F.lead("at").over(along).alias("upto")).join(size, group)
    laid = laid.withColumn("upto", F.coalesce("upto", "n")).where("at < upto").withColumn("cell", F.explode(F.expr("sequence(at div b, (upto - 1) div b)")))
    laid = keep(laid.select(F.col(group).alias("_w_g"), "cell", F.col("at").alias("_w_from"), F.col("upto").alias("_w_upto"), "k"))
    first, n = F.col(before).cast("long"), F.size(units)
    held = texts.where(n > 0).join(F.broadcast(size.select(F.col(group).alias("_w_s"), "b")), F.col(group) == F.col("_w_s"))
    # a text is cut where cells and stretches end; a stretch counts in the cell that it is cut by
    held = held.select(group, F.col(units).alias("ws"), first.alias("from"), (first + n).alias("to"), "b", F.explode(F.expr(f"sequence({before} div b, ({before} + size({units}) - 1) div b)")).alias("c"))
    low = F.greatest(F.col("from"), F.col("_w_from"), F.col("c") * F.col("b"))
    high = F.least(F.col("to"), F.col("_w_upto"), (F.col("c") + 1) * F.col("b"))
    met = held.join(F.broadcast(laid), (F.col(group) == F.col("_w_g")) & (F.col("c") == F.col("cell"))).where(low < high)
    cut = met.select(group, "k", F.slice("ws", (low - F.col("from") + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")).alias("ws"))
    tokens = cut.select(group, *(F.col("k")[r].alias(f"k{r}") for r in range(replicates)), F.explode("ws").alias("_w_u"))
    freq = tokens.groupBy(group, "_w_u").agg(F.count("*").alias("n"), *(F.sum(f"k{r}").alias(f"n{r}") for r in range(replicates)))
    # entropies of all and of each replicate from one pass over the vocabulary
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rep"), F.col("n" if r < 0 else f"n{r}").alias("m")) for r in range(-1, replicates))))
    s = freq.select(group, each.alias("x")).where("x.m > 0").groupBy(group, "x.rep").agg(F.sum("x.m").alias("t"), F.count("*").alias("v"), F.sum(F.col("x.m") * F.log2(F.col("x.m").cast("double"))).alias("x"))
    found = keep(s.select(group, "rep", _normalised(F.col("t"), F.col("v"), F.col("x")).alias("e")))
    whole = found.where("rep < 0").select(group, F.col("e").alias("point"))
    return found.where("rep >= 0"), whole


def interval(values: DataFrame, group: str, value: str, point: DataFrame) -> DataFrame:
    """(group, point, low, high): 1.96 standard errors of the replicates' values around the point estimate."""
    se = values.groupBy(group).agg(F.stddev_samp(value).alias("_se"))
    return point.join(se, group).select(group, F.col("point"), (F.col("point") - 1.96 * F.col("_se")).alias("low"), (F.col("point") + 1.96 * F.col("_se")).alias("high"))


def verdict(point: Column, low: Column, high: Column, least: float) -> Column:
    """`effect present`, `equivalent-to-null` or `underpowered`, by an interval and the least effect that matters."""
    return (
        F.when(low.isNull() | high.isNull() | F.isnan(low) | F.isnan(high), "underpowered")
        .when(((low > 0) | (high < 0)) & (F.abs(point) >= least), "effect present")
        .when((low > -least) & (high < least), "equivalent-to-null").otherwise("underpowered")
    )


def average_rank(df: DataFrame, value: str, out: str, group: str | None = None) -> DataFrame:
    """Adds the rank of a value, ties sharing their mean. Ranks run over distinct values, in buckets, not over rows."""
    keys = [group] if group else []
    g = group or "_w_one"
    per = df.groupBy(*keys, value).agg(F.count("*").alias("_w_n"))
    per = per if group else per.withColumn("_w_one", F.lit(1))
    ranked = places(per.where(F.col(value).isNotNull()), g, value, F.col("_w_n")).withColumn(out, F.col("before") + (F.col("_w_n") + 1) / 2.0)
    ranked = ranked.select(*(F.col(k).alias(f"_w_{k}") for k in keys), F.col(value).alias("_w_v"), out)
    on = [F.col(value) == F.col("_w_v"), *(F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys)]
    return df.join(ranked, reduce(lambda a, b: a & b, on), "left").drop("_w_v", *(f"_w_{k}" for k in keys))


def spearman(ranked: DataFrame, x: str, y: str, z: str | None = None) -> DataFrame:
    """Rank correlation of two rank columns, and with z held fixed if it is given."""
    if z is None:
        return ranked.agg(F.corr(x, y).alias("rho"))
    c = ranked.agg(F.corr(x, y).alias("xy"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"))
    part = (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    return c.select(F.col("xy").alias("rho"), part.alias("partial"))


# Kneser-Ney
START, END, GLUE = "<s>", "</s>", " "


def ngrams(seqs: DataFrame, units: str, order: int) -> DataFrame:
    """(k, gram, n): counts of the k-grams, k from 1 to order, of padded sequences; a gram is its units joined by a blank.

    All orders come out of one pass, and counts are combined before the shuffle.
    """
    pad = F.concat(F.array_repeat(F.lit(START), order - 1), F.col(units), F.array(F.lit(END)))
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(order)), lambda k: F.transform(F.sequence(F.lit(1), F.size("_w_p") - k + 1), lambda i: F.struct(k.alias("k"), F.array_join(F.slice("_w_p", i, k), GLUE).alias("gram")))))
    rows = seqs.select(pad.alias("_w_p")).where(F.size("_w_p") >= order).select(F.explode(every).alias("x"))
    return rows.groupBy("x.k", "x.gram").agg(F.count("*").alias("n"))


def kn_bits(grams: DataFrame, test: DataFrame, units: str, id_col: str, order: int = 3, discount: float = 0.75) -> DataFrame:
    """(id, n_units, bits): bits of each test sequence under interpolated Kneser-Ney with absolute discount.

    Test places become rows; each order joins its context's count and followers and its gram's count, then the
    recursion is one expression from the unigram up: an unseen context backs off undiscounted.
    """
    head = F.expr("substring_index(gram, ' ', size(split(gram, ' ')) - 1)")
    last = F.substring_index("gram", GLUE, -1)
    vocab = grams.where(f"k = 1 AND gram NOT IN ('{START}', '{END}')").agg(F.count("*").alias("v"))
    bi = grams.where("k = 2")
    cont = bi.groupBy(last.alias("w")).agg(F.count("*").alias("pre"))
    scale = bi.agg(F.greatest(F.lit(1), F.count("*")).alias("types")).crossJoin(vocab)  # one row
    pad = F.concat(F.array_repeat(F.lit(START), order - 1), F.col(units), F.array(F.lit(END)))
    at = F.explode(F.sequence(F.lit(order), F.size("_w_p")))
    rows = test.select(F.col(id_col), pad.alias("_w_p")).select(id_col, "_w_p", at.alias("i"))
    take = lambda k: F.array_join(F.slice("_w_p", F.col("i") - k + 1, F.lit(k)), GLUE)
    rows = rows.select(id_col, *(take(k).alias(f"g{k}") for k in range(1, order + 1)), *(F.array_join(F.slice("_w_p", F.col("i") - k + 1, F.lit(k - 1)), GLUE).alias(f"c{k}") for k in range(2, order + 1)))
    # places that are equal are scored once
    rows = rows.groupBy(id_col, *(f"g{k}" for k in range(1, order + 1)), *(f"c{k}" for k in range(2, order + 1))).agg(F.count("*").alias("times"))
    out = rows.join(cont.withColumnRenamed("w", "g1"), "g1", "left").crossJoin(F.broadcast(scale))
    p = F.when(F.coalesce("pre", F.lit(0)) == 0, 1.0 / (F.col("v") + 1)).otherwise(F.col("pre") / F.col("types"))
    for k in range(2, order + 1):
        full = grams.where(f"k = {k}").select(F.col("gram").alias(f"g{k}"), F.col("n").alias(f"f{k}"))
        follow = grams.where(f"k = {k}").groupBy(head.alias(f"c{k}")).agg(F.count("*").alias(f"l{k}"))
        context = grams.where(f"k = {k - 1}").select(F.col("gram").alias(f"c{k}"), F.col("n").alias(f"n{k}"))
        out = out.join(full, f"g{k}", "left").join(context.join(follow, f"c{k}", "left"), f"c{k}", "left")
        n, f, l = F.col(f"n{k}"), F.coalesce(f"f{k}", F.lit(0)), F.coalesce(f"l{k}", F.lit(0))
        p = F.when(n.isNull(), p).otherwise(F.greatest(f - discount, F.lit(0.0)) / n + discount * l / n * p)
    bits = -F.log2(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0))) * F.col("times")
    return out.groupBy(id_col).agg(F.sum("times").alias("n_units"), F.sum(bits).alias("bits"))


def noise(text: Column, rate: float, seed: str, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """A text in which each character is replaced, dropped or followed by another with the chance `rate`, by a hash."""
    chars = F.filter(F.split(text, ""), lambda x: x != "")
    unit = 1 << 20

    def one(c: Column, i: Column) -> Column:
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), i.cast("string"), c)), 1, 10), 16, 10).cast("long")
        other = F.substring(F.lit(alphabet), (F.pmod(F.shiftright(h, 22), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
        kind = F.pmod(F.shiftright(h, 20), F.lit(3))
        return F.when(F.pmod(h, F.lit(unit)) >= int(rate * unit), c).when(kind == 0, other).when(kind == 1, F.lit("")).otherwise(F.concat(c, other))

    return F.array_join(F.transform(chars, one), "")


def jaccard_null(types: DataFrame, group: str, unit: str, a: str, b: str, replicates: int = 20, seed: str = "perm") -> DataFrame:
    """(rep, jaccard): of the types of groups a and b, dealt out anew at random, sizes kept; rep -1 is the real one.

    Each type of the union gets a hash a replicate; the first |a| by hash of replicate are one set, the first |b| by
    another hash the other, which keeps the overlap's chance. Hashes are counted by their first digits, which tells where
    a set ends but for the types of one such class, and only these are sorted: no task has a replicate's types.
    """
    flags = types.where(F.col(group).isin(a, b)).groupBy(unit).agg(F.max(F.col(group) == a).alias("a"), F.max(F.col(group) == b).alias("b"))
    flags = keep(flags)
    real = flags.agg((F.count_if(F.col("a") & F.col("b")) / F.count("*")).alias("jaccard"), F.count_if("a").alias("na"), F.count_if("b").alias("nb"), F.count("*").alias("u"))
    r = real.first()  # one row of counts
    key = lambda k: F.md5(F.concat_ws("|", F.lit(f"{seed}{k}"), F.col("rep").cast("string"), F.col(unit)))
    digits = 3 if r["u"] < 1 << 24 else 4
    drawn = flags.select(unit, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).select(unit, "rep", key("a").alias("ha"), key("b").alias("hb"))
    class_ = lambda k: F.substring(f"h{k}", 1, digits)
    out = drawn
    for k in "ab":
        upto = Window.partitionBy("rep").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
        held = drawn.groupBy("rep", class_(k).alias("class")).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(upto))
        last = held.where((F.col("upto") >= r[f"n{k}"]) & (F.col("upto") - F.col("n") < r[f"n{k}"])).select("rep", "class", (F.lit(r[f"n{k}"]) - F.col("upto") + F.col("n")).alias("left"))
        place = F.row_number().over(Window.partitionBy("rep").orderBy(f"h{k}", unit))
        edge = drawn.join(F.broadcast(last), "rep").where(class_(k) == F.col("class")).select("rep", F.col("left"), F.struct(F.col(f"h{k}"), F.col(unit)).alias("end"), place.alias("place"))
        edge = edge.where(F.col("place") == F.col("left")).select("rep", F.col("end").alias(f"end{k}"))  # the last type of the set, one row a replicate
        out = out.join(F.broadcast(edge), "rep", "left").withColumn(k, F.coalesce(F.struct(F.col(f"h{k}"), F.col(unit)) <= F.col(f"end{k}"), F.lit(False)))
    null = out.groupBy("rep").agg((F.count_if(F.col("a") & F.col("b")) / F.greatest(F.count_if(F.col("a") | F.col("b")), F.lit(1))).alias("jaccard"))
    return real.select(F.lit(-1).alias("rep"), "jaccard").unionByName(null)


def fisher_interval(r: Column, n: Column) -> Column:
    """(low, high) of a correlation by Fisher's z; null for fewer than four rows."""
    z, se = F.atanh(r), F.when(n > 3, 1.96 / F.sqrt(n - 3.0))
    return F.struct(F.tanh(z - se).alias("low"), F.tanh(z + se).alias("high"))


def gap_interval(a: Column, se_a: Column, b: Column, se_b: Column) -> Column:
    """(gap, low, high) of two estimates with independent errors."""
    gap, se = a - b, F.hypot(se_a, se_b)
    return F.struct(gap.alias("gap"), (gap - 1.96 * se).alias("low"), (gap + 1.96 * se).alias("high"))

