"""Precision and recall of tag sets against a gold standard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.cells import split_any
from recordloom.operators.compare import record_key, unique_keys


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b).cast("double")


def f1(precision: Column, recall: Column) -> Column:
    """Null if either is null or 0."""
    return F.when((precision > 0) & (recall > 0), 2 * precision * recall / (precision + recall))


def score_sets(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: records, tp, fp, fn, precision, recall, f1, exact, any_hit of two array columns (taken as sets)."""
    g, p = F.array_distinct(gold), F.array_distinct(predicted)
    both = F.size(F.array_intersect(g, p))
    sums = df.select(both.alias("tp"), (F.size(p) - both).alias("fp"), (F.size(g) - both).alias("fn"), ((both == F.size(g)) & (both == F.size(p))).cast("int").alias("exact"), (both > 0).cast("int").alias("hit"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    row = sums.agg(F.count(F.lit(1)).alias("records"), *(total(c).alias(c) for c in ("tp", "fp", "fn", "exact")), total("hit").alias("any_hit"))
    scored = row.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def by_tag(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """tag, tp, fp, fn, precision, recall, f1 of every tag on either side."""
    g, p = F.array_distinct(gold), F.array_distinct(predicted)
    rows = df.select(F.explode(F.array_union(g, p)).alias("tag"), g.alias("g"), p.alias("p")).select("tag", F.array_contains("g", F.col("tag")).alias("in_g"), F.array_contains("p", F.col("tag")).alias("in_p"))
    counted = rows.groupBy("tag").agg(F.count_if(F.col("in_g") & F.col("in_p")).alias("tp"), F.count_if(~F.col("in_g")).alias("fp"), F.count_if(~F.col("in_p")).alias("fn"))
    scored = counted.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def zipped(tags: Column, confidences: Column, methods: Column) -> Column:
    """Predictions as structs of parallel lists; lists of another length than the tags' are blank."""
    fit = lambda xs: F.when(F.size(xs) == F.size(tags), xs).otherwise(F.transform(tags, lambda _: F.lit("")))
    return F.arrays_zip(tags.alias("tag"), fit(confidences).alias("confidence"), fit(methods).alias("method"))


def precision_by(df: DataFrame, gold: str, predictions: str) -> DataFrame:
    """dimension (confidence or method), value, n, tp, precision of zipped() predictions."""
    rows = df.select(gold, F.explode(predictions).alias("x")).select(F.array_contains(gold, F.col("x")["tag"]).cast("int").alias("hit"), F.inline(F.array(F.struct(F.lit("confidence").alias("dimension"), F.col("x")["confidence"].alias("value")), F.struct(F.lit("method"), F.col("x")["method"]))))
    return rows.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").cast("long").alias("tp"), F.avg("hit").alias("precision"))


def recall_by_gold(df: DataFrame, gold: str, top: str) -> DataFrame:
    """tag, records and recall: how often the top prediction is the gold tag."""
    rows = df.select(F.explode(F.array_distinct(gold)).alias("tag"), F.col(top).alias("top"))
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("records"), F.avg(F.coalesce((F.col("top") == F.col("tag")).cast("int"), F.lit(0))).alias("recall"))


def recall_pivot(recalls: DataFrame, models: list[str]) -> DataFrame:
    """tag, records and a column of recalls for each model of `recalls` (tag, records, recall, model)."""
    return recalls.groupBy("tag").agg(F.max("records").alias("records"), *(F.max(F.when(F.col("model") == m, F.col("recall"))).alias(m) for m in models))


def outcome(gold: Column, predicted: Column) -> Column:
    """exact, partly right, missed or wrong."""
    both = F.size(F.array_intersect(gold, predicted))
    return F.when((both == F.size(F.array_distinct(gold))) & (both == F.size(F.array_distinct(predicted))), "exact").when(both > 0, "partly right").when(F.size(predicted) == 0, "missed").otherwise("wrong")


def gold_tags(keywords: Column, codes: tuple[str, ...]) -> Column:
    """The known codes among a keyword cell's tags, each once."""
    return F.array_intersect(split_any(keywords), F.array(*map(F.lit, codes)))


def gold_countries(keywords: Column, names: dict[str, str]) -> Column:
    """Countries of a keyword cell: a keyword, or what stands before its `--`, by its folded name."""
    folded = F.transform(split_any(keywords), lambda k: F.lower(F.trim(F.substring_index(k, "--", 1))))
    known = F.create_map(*(x for k, v in names.items() for x in (F.lit(k.casefold()), F.lit(v)))) if names else F.lit(None).cast("map<string,string>")
    return F.array_distinct(F.filter(F.transform(folded, lambda k: known[k]), lambda c: c.isNotNull()))


def against_gold(gold: DataFrame, predicted: DataFrame, keys: dict[str, tuple[str | None, str | None]], keywords: str, codes: tuple[str, ...], tags: str) -> tuple[DataFrame, DataFrame]:
    """Predictions of the records that a gold table knows, and one row with the numbers of those that don't meet.

    keys has (gold's, prediction's) columns for doi, title and year. Records match by DOI, else by title and year;
    keys that a table repeats match nothing. Only gold records with a known code count. The first table has key, gold
    and predicted (arrays).
    """
    side = lambda df, i: unique_keys(df, record_key(*(F.col(f"`{name[i]}`") if (name := keys.get(part, (None, None)))[i] else None for part in ("doi", "title", "year"))))
    truth = side(gold, 0).select("key", gold_tags(F.col(f"`{keywords}`"), codes).alias("gold")).where(F.size("gold") > 0)
    found = side(predicted, 1).select("key", F.array_intersect(split_any(F.col(f"`{tags}`")), F.array(*map(F.lit, codes))).alias("predicted"))
    both = truth.join(found, "key", "full_outer")
    counts = both.agg(
        F.count_if(F.col("gold").isNotNull() & F.col("predicted").isNotNull()).alias("matched"),
        F.count_if(F.col("predicted").isNull()).alias("gold_only"),
        F.count_if(F.col("gold").isNull()).alias("predicted_only"),
    )
    return both.where("gold IS NOT NULL AND predicted IS NOT NULL"), counts


def in_subsets(df: DataFrame, subsets: dict[str, tuple[Column, str, str]]) -> DataFrame:
    """score_sets() of several subsets, (condition, gold, predicted) each, with their names, in one scan."""
    names = list(subsets)
    arrays = F.array(*(F.when(subsets[n][0], F.struct(F.lit(n).alias("subset"), F.array_distinct(subsets[n][1]).alias("g"), F.array_distinct(subsets[n][2]).alias("p"))) for n in names))
    rows = df.select(F.inline(F.filter(arrays, lambda x: x.isNotNull()))).select("subset", F.size("g").alias("ng"), F.size("p").alias("np"), F.size(F.array_intersect("g", "p")).alias("tp"))
    sums = rows.groupBy("subset").agg(F.count(F.lit(1)).alias("records"), F.sum("tp").cast("long").alias("tp"), F.sum(F.col("np") - F.col("tp")).cast("long").alias("fp"), F.sum(F.col("ng") - F.col("tp")).cast("long").alias("fn"), F.count_if((F.col("tp") == F.col("ng")) & (F.col("tp") == F.col("np"))).alias("exact"))
    scored = sums.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def blind_run(df: DataFrame, gold: str, predicted: str, confidences: str, has_abstract: Column, gold_places: str, places: str) -> DataFrame:
    """The five evaluations of a tagging run: all records, those with and without an abstract, high confidence only, countries."""
    high = F.filter(F.transform(predicted, lambda t, i: F.when(F.get(confidences, i) == "high", t)), lambda t: t.isNotNull())
    rows = df.withColumn("__high", high).withColumn("__has", F.coalesce(has_abstract, F.lit(False)))
    every = F.lit(True)
    return in_subsets(rows, {"all": (every, gold, predicted), "with_abstract": (F.col("__has"), gold, predicted), "without_abstract": (~F.col("__has"), gold, predicted), "high_only": (every, gold, "__high"), "countries": (F.size(gold_places) > 0, gold_places, places)})


def accuracy_by(ranked: DataFrame, gold: str, group: str) -> DataFrame:
    """group, n, top1 and top3 of ranked topics (semantic.nearest_topics()), as by language."""
    hit = (F.col("topic") == F.col(gold)).cast("int")
    return ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("top1"), F.avg(F.array_contains(F.slice("ranked", 1, 3), F.col(gold)).cast("int")).alias("top3"))
