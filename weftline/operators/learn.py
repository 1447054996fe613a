"""Small models over documents: features of tokens, folds over groups, logistic regression, quality of distant labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(key: Column, k: int, seed: str = "fold") -> Column:
    """The fold of a group, 0 to k - 1, by a hash of its key: all rows of a group share it, and no task sorts them."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"))), 1, 7), 16, 10).cast("long"), F.lit(k))


def token_features(tokens: DataFrame, group: str, at: str, token: str, sizes=(2, 3)) -> DataFrame:
    """Orthographic and context features of tokens, none of which is the token itself: affixes of its neighbours and of
    its own, its length, digits; bounds of the text are words of their own."""
    w = Window.partitionBy(group).orderBy(at)
    t = F.lower(F.col(token))
    before, after = F.coalesce(F.lag(t).over(w), F.lit("<s>")), F.coalesce(F.lead(t).over(w), F.lit("</s>"))
    own = [F.concat(F.lit(f"p{n}="), F.substring(t, 1, n)) for n in sizes] + [F.concat(F.lit(f"s{n}="), F.substring(t, F.greatest(F.length(t) - n + 1, F.lit(1)), F.lit(n))) for n in sizes]
    near = [F.concat(F.lit(f"{k}s{n}="), F.substring(c, F.greatest(F.length(c) - n + 1, F.lit(1)), F.lit(n))) for k, c in (("b", before), ("a", after)) for n in sizes]
    return tokens.withColumn("features", F.array(*own, *near, F.concat(F.lit("len="), F.least(F.length(t), F.lit(12)).cast("string")), F.concat(F.lit("digit="), F.regexp_like(t, F.lit(r"\d")).cast("string"))))


def logistic(train: DataFrame, features: str, label: str, c: float = 1.0, rounds: int = 100, size: int = 1 << 16):
    """Hashed logistic regression with the penalty 1 / (c n) on squared weights; a fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    n = max(1, train.count())
    stages = [HashingTF(inputCol=features, outputCol="_w_x", numFeatures=size, binary=True), LogisticRegression(featuresCol="_w_x", labelCol=label, regParam=1.0 / (c * n), elasticNetParam=0.0, maxIter=rounds, standardization=False)]
    return Pipeline(stages=stages).fit(train)


def cross_validate(rows: DataFrame, group: str, features: str, label: str, k: int = 5, rounds: int = 50, size: int = 1 << 16) -> DataFrame:
    """(group, label, prediction, fold), each group predicted by a model that saw none of its fold; k fits, one after
    the other, each a distributed job."""
    folded = rows.where(F.col(label).isNotNull()).withColumn("fold", fold(F.col(group), k)).withColumn(label, F.col(label).cast("double"))
    out = None
    for i in range(k):
        part = logistic(folded.where(F.col("fold") != i), features, label, rounds=rounds, size=size).transform(folded.where(F.col("fold") == i)).select(group, label, "prediction", "fold")
        out = part if out is None else out.unionByName(part)
    return out


def report(predicted: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, support, precision, recall, f1) of each class, from one count of the confusion."""
    c = predicted.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    side = c.select(F.explode(F.array(F.struct(F.col("l").alias("class"), F.col("n").alias("support"), F.lit(0).alias("said"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("class"), F.lit(0).alias("support"), F.col("n").alias("said"), F.lit(0).alias("hit")))).alias("x"))
    t = side.groupBy("x.class").agg(F.sum("x.support").alias("support"), F.sum("x.said").alias("said"), F.sum("x.hit").alias("hit"))
    p, r = F.expr("coalesce(try_divide(hit, said), 0D)"), F.expr("coalesce(try_divide(hit, support), 0D)")
    return t.select("class", "support", p.alias("precision"), r.alias("recall"), F.expr("coalesce(try_divide(2D * hit, said + support), 0D)").alias("f1"))


def distant_quality(labelled: DataFrame, gold: str, distant: str) -> DataFrame:
    """Share of rows that distant labels reach, and how often they agree with gold where both are there."""
    both = F.col(gold).isNotNull() & F.col(distant).isNotNull()
    return labelled.agg(F.count("*").alias("n"), F.avg(F.col(distant).isNotNull().cast("double")).alias("coverage"), F.avg(F.when(both, (F.col(gold) == F.col(distant)).cast("double"))).alias("agreement"))
