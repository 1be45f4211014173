"""Search of a stored catalogue: the entries whose titles share the weightiest words with a record's, then their scores.

Entries with the same words are one class, of which the k with the smallest keys are kept. A record's words with small
weights can't bring an entry among its best k alone: what at least k entries have by one word is a bound that all of
them together may miss. Only the other words, the essential ones, meet the catalogue's; what they give is completed by
comparing whole word sets. A frequent word's entries are dealt to lists by their class, and the pairs of a record and a
class to as many tasks as they need, so that a task's memory doesn't grow with the catalogue.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.similarity import score_column


#: Entries of a word's list, on average, and pairs of a record's word and an entry that a task gets, on average.
LISTED, MET = 4096, 250_000


class Catalogue(NamedTuple):
    """classes: class, words, keys (the smallest ones) and n (entries); postings: word and class; weights: word, df (entries) and weight."""

    classes: DataFrame
    postings: DataFrame
    weights: DataFrame
    k: int


def catalogue(entries: DataFrame, key: str, words: Column, k: int = 5) -> Catalogue:
    """The index of entries by their words (an array; repeats, nulls and blanks don't count). Entries without words are never found.

    Weights are floor(1000 ln((1 + N) / df)) over the N entries with words. stored() keeps it for several searches.
    """
    clean = F.array_sort(F.array_distinct(F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: w.isNotNull() & (w != ""))))
    rows = entries.select(F.col(key).alias("key"), clean.alias("words")).where(F.size("words") > 0)
    # partial rows of a class hold at most k keys for each task that has it
    smallest = F.slice(F.array_sort(F.collect_list("key")), 1, k)
    parts = rows.withColumn("__p", F.spark_partition_id()).groupBy("words", "__p").agg(F.count(F.lit(1)).alias("n"), smallest.alias("keys"))
    classes = parts.groupBy("words").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("keys"))), 1, k).alias("keys")).withColumn("class", F.unhex(F.sha2(F.to_json("words"), 256)))
    classes = classes.select("class", "words", "keys", "n")
    return Catalogue(classes, _from_classes(classes, "postings"), _from_classes(classes, "weights"), k)


def _from_classes(classes: DataFrame, name: str) -> DataFrame:
    postings = classes.select(F.explode("words").alias("word"), "class", "n")
    if name == "postings":
        return postings.select("word", "class")
    total = classes.agg(F.sum("n").alias("__total"))  # one row
    counted = postings.groupBy("word").agg(F.sum("n").alias("df"))
    return counted.crossJoin(F.broadcast(total)).select("word", "df", F.floor(1000 * F.log((1 + F.col("__total")) / F.col("df"))).alias("weight"))


def stored(index: Catalogue, path: str) -> Catalogue:
    """The index written below a folder and read from there: it is made once, whatever is searched."""
    tables = {}
    for name in ("classes", "postings", "weights"):  # the later ones could be told from the first
        table = getattr(index, name) if not tables else _from_classes(tables["classes"], name)
        table.write.parquet(f"{path}/{name}")
        tables[name] = table.sparkSession.read.parquet(f"{path}/{name}")
    return Catalogue(tables["classes"], tables["postings"], tables["weights"], index.k)


def nearest(records: DataFrame, key: str, words: Column, index: Catalogue) -> DataFrame:
    """key, place (from 1), entry and shared (the weight of the shared words) of each record's best entries by shared, then entry.

    Exact: equal to comparing each record with each entry that shares a word. Repeated keys are one record, the least by
    its words; entries whose shared words weigh nothing aren't found; records that find none have no row.
    """
    k = index.k
    asked = records.groupBy(F.col(key).alias("key")).agg(F.min(F.array_distinct(F.filter(words, lambda w: w.isNotNull()))).alias("words"))
    known = asked.select("key", F.explode("words").alias("word")).join(index.weights, "word").where("weight > 0")
    # ascending weights, their running sum, and what at least k entries have by one word
    ascending = Window.partitionBy("key").orderBy("weight", "word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bound = F.max(F.when(F.col("df") >= k, F.col("weight"))).over(Window.partitionBy("key"))
    judged = known.withColumn("upto", F.sum("weight").over(ascending)).withColumn("bound", F.coalesce(bound, F.lit(0)))
    # what a record's other words weigh goes with the essential ones: pairs needn't meet by record, which has many
    rest = F.coalesce(F.sum(F.when(F.col("upto") < F.col("bound"), F.col("weight"))).over(Window.partitionBy("key")), F.lit(0))
    essential = judged.withColumn("rest", rest).where("upto >= bound").select("key", "word", "weight", "bound", "rest", "df", F.ceil(F.col("df") / LISTED).cast("int").alias("lists"))
    others = judged.where("upto < bound").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("light"))
    tasks = max(1, math.ceil((essential.agg(F.sum("df")).first()[0] or 0) / MET))
    asking = essential.select("key", "word", "weight", "bound", "rest", F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("list"))
    listed = index.postings.join(essential.select("word", "lists").distinct(), "word").select("word", "class", F.pmod(F.xxhash64("class"), F.col("lists")).cast("int").alias("list"))
    pairs = asking.repartition(tasks, "word", "list").join(listed.repartition(tasks, "word", "list"), ["word", "list"]).select("key", "class", "weight", "bound", "rest")
    met = pairs.repartition(tasks, "key", "class").groupBy("key", "class").agg(F.sum("weight").alias("heavy"), F.first("bound").alias("bound"), F.first("rest").alias("rest"))
    hopeful = met.where(F.col("heavy") + F.col("rest") >= F.col("bound")).select("key", "class", "heavy").join(others, "key", "left")
    light = F.aggregate(F.transform(F.array_intersect(F.map_keys("light"), F.col("words")), lambda w: F.col("light")[w]), F.lit(0).cast("long"), lambda a, x: a + x)
    scored = hopeful.join(index.classes, "class").select("key", (F.col("heavy") + F.coalesce(light, F.lit(0))).alias("shared"), "class", "keys")
    # k classes are enough, as each has an entry; then their keys compete
    order = [F.desc("shared"), F.element_at("keys", 1)]
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("r") <= k)
    entries = best.select("key", "shared", F.explode("keys").alias("entry"))
    return entries.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("shared"), "entry"))).where(F.col("place") <= k).select(F.col("key").alias(key), "place", "entry", "shared")


def run_search(records: DataFrame, key: str, words: Column, index: Catalogue, entries: DataFrame, entry_key: str) -> DataFrame:
    """Every found entry of each record with its score's components, the best first (rank), equal ones in the order of the search.

    Records without a key have none. Both tables have title, names (an array) and year; keys of entries are distinct.
    """
    found = nearest(records, key, words, index)
    own = records.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in ("title", "names", "year")))
    other = entries.select(F.col(entry_key).alias("entry"), "title", "names", "year")
    joined = found.join(own, F.col(key) == F.col("__key")).join(other, "entry")
    scored = joined.withColumn("score", score_column(F.col("__title"), F.col("__names"), F.col("__year"), F.col("title"), F.col("names"), F.array(F.col("year").cast("int"))))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("total"), "place"))
    return scored.select(key, "entry", "place", "shared", "score.*", "title", "year").withColumn("rank", rank)
