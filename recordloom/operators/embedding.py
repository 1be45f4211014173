"""Embeddings of texts without a given model: hashed features, weighed by document frequency, projected at random.

A text's features (trigrams of letters, or words) fall into BUCKETS; each counts by its inverse document frequency and
adds a fixed row of signs, so that cosines of the short vectors stay near those of the long ones. All that is fitted is
a number for each bucket.
"""

from __future__ import annotations

import functools
import uuid
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.operators import languages, semantic

#: Fixed, as the SQL of the query has them too.
BUCKETS, DIMENSIONS = languages.SLOTS, 64
_MODULUS = 1_000_003


class Embedder(NamedTuple):
    """Kind of features (letters, words) and each bucket's weight."""

    features: str
    weights: list[float]


@functools.lru_cache(64)
def _powers(bits: int) -> np.ndarray:
    """The powers of 31 by the modulus, 1 << bits of them."""
    out = np.ones(1, np.int64)
    for i in range(bits):
        out = np.concatenate([out, out * pow(31, 1 << i, _MODULUS) % _MODULUS])
    return out


def word_buckets(text: str | None) -> np.ndarray:
    """The buckets of a text's words: runs of letters of the lower-cased text, whose polynomial in 31 by the modulus is taken for all words at once."""
    codes = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    edges = np.diff(languages._letters()[codes].astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
    if not len(starts):
        return np.zeros(0, np.int64)
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    behind = np.repeat(firsts + sizes, sizes) - 1 - np.arange(sizes.sum())  # letters behind each in its word
    letters = codes[np.repeat(starts - firsts, sizes) + np.arange(sizes.sum())]
    terms = letters * _powers(int(sizes.max()).bit_length())[behind] % _MODULUS
    return np.add.reduceat(terms, firsts) % _MODULUS % BUCKETS


FEATURES = {"letters": languages.slots, "words": word_buckets}


def signs() -> np.ndarray:
    """BUCKETS x DIMENSIONS of +1 and -1."""
    own = np.arange(BUCKETS, dtype=np.int64) * 2654435761 % (1 << 32)
    return 1.0 - 2.0 * ((own[:, None] * (2 * np.arange(DIMENSIONS) + 1) % (1 << 32)) >> 31)


def _frequencies(kinds: tuple[str, ...]):
    def run(batches):
        import pyarrow as pa

        n, counts = 0, np.zeros((len(kinds), BUCKETS), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                for own, kind in zip(counts, kinds, strict=True):
                    own[np.unique(FEATURES[kind](text))] += 1
        kind, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *kind], pa.int32()), pa.array([-1, *at], pa.int32()), pa.array([n, *counts[kind, at]], pa.int64())], names=["kind", "bucket", "n"])

    return run


def fit_all(texts: DataFrame, text: str = "text", kinds: tuple[str, ...] = tuple(FEATURES)) -> dict[str, Embedder]:
    """fit() of several kinds of features in one reading of the texts."""
    if unknown := set(kinds) - set(FEATURES):
        raise ValueError(f"unknown features: {', '.join(sorted(unknown))}")
    seen = texts.select(F.col(text).cast("string")).mapInArrow(_frequencies(kinds), "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).collect()
    found = {(r.kind, r.bucket): r.n for r in seen}
    n = found.pop((-1, -1), 0)
    return {kind: Embedder(kind, [float(np.log((1 + n) / (1 + found.get((i, b), 0))) + 1) for b in range(BUCKETS)]) for i, kind in enumerate(kinds)}


def fit(texts: DataFrame, text: str = "text", features: str = "letters") -> Embedder:
    """Weights ln((1 + N) / (1 + df)) + 1 over all texts, null ones without features among them; a task gives a number for each bucket."""
    return fit_all(texts, text, (features,))[features]


def vector(text: str | None, features: str, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    counts = np.bincount(FEATURES[features](text), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    out = (counts[at] * weights[at]) @ rows[at]
    norm = np.sqrt(out @ out)
    return out / norm if norm else out


def embed(text: Column, model: Embedder) -> Column:
    """A unit vector of DIMENSIONS numbers; zeros for a text without features. Texts are read whole."""
    return embed_all(text, {model.features: model})[model.features]


def embed_all(text: Column, models: dict[str, Embedder]) -> Column:
    """A struct of each model's vector."""
    fitted = [(m.features, np.array(m.weights)) for m in models.values()]

    @F.pandas_udf(T.StructType([T.StructField(name, T.ArrayType(T.DoubleType())) for name in models]))
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = signs()
        return pd.DataFrame([[vector(x, features, weights, rows) for features, weights in fitted] for x in texts], columns=list(models), dtype=object)

    return run(text.cast("string"))


def _kept(df: DataFrame) -> DataFrame:
    """`df`, made once: written to the shared folder if there is one, else held by Spark."""
    spark = df.sparkSession
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        return df.persist(StorageLevel.DISK_ONLY)
    folder = f"{base.rstrip('/')}/embedded-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def compare_embedders(fitting: DataFrame, judged: DataFrame, text: str, gold: str, kinds=tuple(FEATURES)) -> DataFrame:
    """semantic.accuracy() of each kind of embedder: weights and the topics' centroids come from `fitting`, `judged` is ranked; gold is the topic in both.

    Texts are read once for the weights and once for the vectors, of all kinds; later steps read the vectors alone.
    """
    models = fit_all(fitting, text, tuple(kinds))
    known, asked = (_kept(df.where(F.col(gold).isNotNull()).select(F.col(gold), embed_all(F.col(text), models).alias("__v"))) for df in (fitting, judged))
    ranked = {}
    for kind in kinds:
        vectors = lambda df: df.select(gold, F.col("__v")[kind].alias("__v"))  # noqa: B023, E731
        ranked[kind] = semantic.nearest_topics(vectors(asked), "__v", _kept(semantic.centroids(vectors(known), "__v", gold)))
    return semantic.compare_models(ranked, gold)
