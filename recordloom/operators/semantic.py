"""Nearest topics of embeddings by cosine, with a margin to the second."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least similarity and least margin of an accepted topic.
SIMILARITY, MARGIN = 0.35, 0.05


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector scaled to length one; a zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(F.transform(a, lambda x: x.cast("double")))


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """topic and its mean unit vector."""
    rows = df.select(label, F.posexplode(unit(F.col(vector))).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    return rows.groupBy(F.col(label).alias("topic")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("topic", unit(F.col("v.x")).alias("topic_vector"))


def nearest_topics(df: DataFrame, vector: str, topics: DataFrame, similarity: float = SIMILARITY, margin: float = MARGIN, most_topics: int = 10_000) -> DataFrame:
    """Rows with ranked (topics by similarity), topic, similarity, margin and accepted.

    The topics are one row's array, sent along with every task: their number is checked first.
    """
    n = topics.count()
    if n > most_topics:
        raise ValueError(f"{n} topics are more than {most_topics}")
    all_ = topics.agg(F.array_sort(F.collect_list(F.struct("topic", "topic_vector"))).alias("__topics"))
    own = unit(F.col(vector))
    ranked = F.array_sort(F.transform("__topics", lambda t: F.struct((-dot(t["topic_vector"], F.col("__u"))).alias("d"), t["topic"].alias("topic"))))
    rows = df.withColumn("__u", own).crossJoin(F.broadcast(all_)).withColumn("__r", ranked)
    first, second = F.get("__r", F.lit(0)), F.get("__r", F.lit(1))
    gap = F.coalesce(second["d"] - first["d"], F.lit(1.0))
    return rows.select(*df.columns, F.transform("__r", lambda x: x["topic"]).alias("ranked"), first["topic"].alias("topic"), (-first["d"]).alias("similarity"), gap.alias("margin"), ((-first["d"] >= similarity) & (gap >= margin)).alias("accepted"))


def accuracy(ranked: DataFrame, gold: str) -> DataFrame:
    """One row: n, top1, top3, coverage and precision of accepted rows, precision of the half with the largest margins (hits first of equal ones).

    The half's last margin is bracketed by approximate quantiles: all margins above count whole, and only the values
    inside the bracket are ordered.
    """
    hit = (F.col("topic") == F.col(gold)).cast("int")
    rows = ranked.select("margin", F.coalesce(hit, F.lit(0)).alias("hit"), hit.isNotNull().cast("int").alias("known"))
    total, cuts = rows.agg(F.count(F.lit(1)), F.percentile_approx("margin", F.array(F.lit(0.499), F.lit(0.501)), F.lit(100_000))).first()
    low, high = cuts or (0.0, 0.0)
    half = max(1, total // 2)
    bands = rows.groupBy((F.col("margin") > high).alias("above"), F.when(F.col("margin").between(low, high), F.col("margin")).alias("margin"), "hit", "known").agg(F.count(F.lit(1)).alias("k"))
    bands = bands.where("above OR margin IS NOT NULL")
    before = Window.orderBy(F.desc("above"), F.desc("margin"), F.desc("hit"), "known").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = bands.withColumn("upto", F.sum("k").over(before)).withColumn("take", F.greatest(F.lit(0), F.least("k", F.lit(half) - F.col("upto") + F.col("k"))))
    best = taken.agg((F.sum(F.col("take") * F.col("hit")) / F.nullif(F.sum(F.col("take") * F.col("known")), F.lit(0))).alias("half_precision"))
    return ranked.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit).alias("top1"),
        F.avg(F.array_contains(F.slice("ranked", 1, 3), F.col(gold)).cast("int")).alias("top3"),
        F.avg(F.col("accepted").cast("int")).alias("coverage"),
        F.avg(F.when(F.col("accepted"), hit)).alias("precision"),
    ).crossJoin(F.broadcast(best))


def optional_nearest(df: DataFrame, vector: str, topics: DataFrame | None, **limits) -> DataFrame:
    """nearest_topics(), or null results where there are no topic vectors: the tier is left out, which is no error."""
    if topics is not None:
        return nearest_topics(df, vector, topics, **limits)
    return df.withColumns({"ranked": F.array().cast("array<string>"), "topic": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double"), "margin": F.lit(None).cast("double"), "accepted": F.lit(False)})


def compare_models(models: dict[str, DataFrame], gold: str) -> DataFrame:
    """accuracy() of several models' ranked topics, a row for each."""
    rows = [accuracy(ranked, gold).select(F.lit(name).alias("model"), "*") for name, ranked in models.items()]
    return functools.reduce(DataFrame.unionByName, rows)
