"""Ranked lexical search with inverted treaps over blocks of documents.

The index has a row for each block and term: the term's documents and frequencies. A search reads its terms' rows, brings
a block's rows together and makes a treap of each term's list: documents in search order, impacts in heap order, equal
impacts in the order of a hash, which keeps treaps of equal impacts shallow. A query walks its terms' treaps at once: an
interval of documents has a node in each, the root of what the treap holds there, so the nodes' impacts add up to a bound
for all documents in it. The document of the weightiest node splits the interval; halves whose bound can't enter the best
k go. Blocks hold a bounded amount of text, and what leaves one is k documents for each query at most.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import ROW, counted, materialize, text_bytes, with_row

#: Bytes that end words become spaces, A-Z becomes a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 32_000_000
#: Terms, with repeats, of the queries that are sent to the tasks at a time.
SLICE = 1_000_000
#: Intervals that a step of a search splits.
STEP = 512
#: Groups in which the blocks' best documents of a query are ranked before they meet.
SALT = 64

INDEX = "block long, term string, n_docs int, docs array<int>, tfs array<int>, ids array<long>, lengths array<long>"


class Index(NamedTuple):
    """The index table (a block has a row for each term, and one without a term for its documents), blocks, documents and terms in all."""

    table: DataFrame
    n_blocks: int
    n_docs: int
    n_terms: int


def _lists(values: np.ndarray, ends: np.ndarray, kind):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values, kind))


def _block(rows: list[int], ids: list[int | None], texts: list[bytes]):
    """The index rows of a block's documents, in the order of their ids, null last."""
    import pyarrow as pa

    numbers: dict[bytes, int] = {}
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, rows[i]))
    terms, places, counts, kept, lengths = [], [], [], [], []
    for i in order:
        words = texts[i].translate(_TABLE).split()
        if not words:
            continue
        found, n = np.unique(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)), return_counts=True)
        terms.append(found)
        counts.append(n)
        places.append(np.full(len(found), len(kept)))
        kept.append(ids[i])
        lengths.append(len(words))
    if not kept:
        return
    term, place, count = map(np.concatenate, (terms, places, counts))
    by_term = np.argsort(term, kind="stable")
    sizes = np.bincount(term, minlength=len(numbers))
    ends, n = np.cumsum(sizes), len(numbers)
    none = pa.nulls
    yield pa.RecordBatch.from_arrays(
        [pa.array([rows[0]], pa.int64()), none(1, pa.string()), none(1, pa.int32()), none(1, pa.list_(pa.int32())), none(1, pa.list_(pa.int32())), pa.array([kept], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64()))],
        names=_NAMES,
    )
    words = pa.array([w.decode("utf-8", "replace") for w in numbers], pa.string())
    whole = [pa.array(np.full(n, rows[0]), pa.int64()), words, pa.array(sizes, pa.int32()), _lists(place[by_term], ends, pa.int32()), _lists(count[by_term], ends, pa.int32()), none(n, pa.list_(pa.int64())), none(n, pa.list_(pa.int64()))]
    batch = pa.RecordBatch.from_arrays(whole, names=_NAMES)
    for begin in range(0, n, 20_000):
        yield batch.slice(begin, 20_000)


_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def _index(block: int):
    def run(batches):
        rows, ids, texts, held = [], [], [], 0
        for batch in batches:
            for row, id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                if texts and held + len(text) > block:
                    yield from _block(rows, ids, texts)
                    rows, ids, texts, held = [], [], [], 0
                rows.append(row)
                ids.append(id_)
                texts.append(text)
                held += len(text)
        if texts:
            yield from _block(rows, ids, texts)

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> Index:
    """The index of all rows of `docs`, written to the shared folder.

    Terms are runs of 0-9, a-z and characters beyond ASCII after lower-casing A-Z. Null and empty texts and others
    without terms aren't documents of the index. Texts are read whole; null ids stand behind all others, repeated rows
    are documents of their own, an empty table gives an empty index; only the two named columns are read.
    """
    rows = with_row(docs).select(F.col(ROW), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    table, (_, blocks, n, length) = counted(rows.mapInArrow(_index(block), INDEX), "lexical-index", F.count("ids"), F.sum(F.when(F.col("ids").isNotNull(), F.size("ids"))), F.sum(total))
    return Index(table, blocks, n or 0, length or 0)


def _parsed(batches):
    import pyarrow as pa

    for batch in batches:
        words = [[w.decode("utf-8", "replace") for w in x.translate(_TABLE).split()] for x in text_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words, pa.list_(pa.string()))], names=[ROW, "item", "terms"])


class Treaps:
    """The treaps of a block's terms in common arrays; node -1 is none, its impact 0."""

    def __init__(self, terms: list[str], ends: np.ndarray, docs: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int):
        factor = 75 * n_docs
        wide = object if factor * int(lengths.max()) >= 1 << 63 else np.int64
        m = (25 + (lengths.astype(wide) * factor) // n_terms).astype(np.int64)
        tfs = tfs.astype(np.int64)
        self.impacts = np.append((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[docs]), 0)
        self.docs = np.append(docs.astype(np.int64), -1)
        mixed = (docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)
        order = ((self.impacts[:-1] << 21) | mixed.astype(np.int64)).tolist()
        left, right, self.roots, begin = [-1] * len(docs), [-1] * len(docs), {}, 0
        for term, end in zip(terms, ends.tolist(), strict=True):
            spine: list[int] = []
            for i in range(begin, end):
                last, p = -1, order[i]
                while spine and order[spine[-1]] < p:
                    last = spine.pop()
                left[i] = last
                if spine:
                    right[spine[-1]] = i
                spine.append(i)
            self.roots[term], begin = spine[0], end
        self.left, self.right = np.array([*left, -1]), np.array([*right, -1])

    def settle(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The topmost node at or below each node (rows x terms) whose document lies in its row's interval."""
        flat = nodes.ravel()
        at = np.flatnonzero(flat >= 0)
        row = at // nodes.shape[1]
        while len(at):
            doc = self.docs[flat[at]]
            before, behind = doc < low[row], doc >= high[row]
            outside = before | behind
            at, row = at[outside], row[outside]
            flat[at] = np.where(before[outside], self.right[flat[at]], self.left[flat[at]])
            inside = flat[at] >= 0
            at, row = at[inside], row[inside]
        return flat.reshape(nodes.shape)

    def search(self, terms: dict[str, int], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents (places in the block) with their scores, and how many documents were scored."""
        present = [t for t in terms if t in self.roots]
        if not present:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        weights = np.array([terms[t] for t in present])
        nodes = np.array([[self.roots[t] for t in present]])
        low, high = np.zeros(1, np.int64), np.full(1, 1 << 62)
        bounds = self.impacts[nodes] @ weights
        best, scores, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while len(bounds):
            first = np.argpartition(-bounds, STEP)[:STEP] if len(bounds) > STEP else np.arange(len(bounds))
            rest = np.ones(len(bounds), bool)
            rest[first] = False
            taken, begin, end = nodes[first], low[first], high[first]
            middle = self.docs[taken[np.arange(len(first)), (self.impacts[taken] * weights).argmax(axis=1)]]
            seen += len(middle)
            # the splitting documents, then both halves
            parts = self.settle(np.concatenate([taken, taken, taken]), np.concatenate([middle, begin, middle + 1]), np.concatenate([middle + 1, middle, end]))
            sums = self.impacts[parts] @ weights
            n = len(first)
            best, scores = np.concatenate([best, middle]), np.concatenate([scores, sums[:n]])
            kept = np.lexsort((best, -scores))[:k]
            best, scores = best[kept], scores[kept]
            nodes, bounds = np.concatenate([nodes[rest], parts[n:]]), np.concatenate([bounds[rest], sums[n:]])
            low, high = np.concatenate([low[rest], begin, middle + 1]), np.concatenate([high[rest], middle, end])
            open_ = bounds > 0
            if len(scores) == k:
                open_ &= (bounds > scores[-1]) | ((bounds == scores[-1]) & (low < best[-1]))
            nodes, bounds, low, high = nodes[open_], bounds[open_], low[open_], high[open_]
        kept = scores > 0
        return best[kept], scores[kept], seen


def _search(queries, k: int, n_docs: int, n_terms: int):
    """queries: a broadcast list of (row, item, terms with their weights)."""

    def run(key, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        heads = table.filter(pc.is_null(table["term"])).combine_chunks()
        ids, lengths = heads["ids"].to_pylist()[0], np.array(heads["lengths"].to_pylist()[0], np.int64)
        lists = table.filter(pc.is_valid(table["term"])).combine_chunks()
        out = ([], [], [], [])
        if lists.num_rows:
            docs, tfs = (lists[c].combine_chunks() for c in ("docs", "tfs"))
            treaps = Treaps(lists["term"].to_pylist(), np.cumsum(np.asarray(lists["n_docs"])), np.asarray(docs.flatten()), np.asarray(tfs.flatten()), lengths, n_docs, n_terms)
            for row, item, terms in queries.value:
                found, scores, _ = treaps.search(terms, k)
                for part, x in zip(out, ([row] * len(found), [item] * len(found), [ids[i] for i in found.tolist()], scores.tolist()), strict=True):
                    part += x
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["row", "item_id", "doc_id", "score"])

    return run


def weigh(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each row of `queries`, by score, then doc_id (null last).

    A row is a query of its own, also if others have its id; null and empty texts find nothing, nor does any query in an
    empty index. Other columns of `queries` aren't read. Queries are sent to the tasks in slices of about SLICE terms.
    """
    spark = queries.sparkSession
    rows = with_row(queries).select(F.col(ROW), F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    parsed, (_, terms) = counted(rows.mapInArrow(_parsed, f"`{ROW}` long, item long, terms array<string>"), "lexical-queries", F.sum(F.size("terms")))
    slices = -(-(terms or 0) // SLICE)
    found = [_slice(spark, index, parsed.where(F.pmod(F.xxhash64(ROW), F.lit(slices)) == i), k) for i in range(slices)] if index.n_terms else []
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for group in (["row", "salt"], ["row"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def _slice(spark, index: Index, parsed: DataFrame, k: int) -> DataFrame:
    """The best documents of each block for the queries of a slice."""
    wanted = materialize(parsed.select(F.explode("terms").alias("term")).distinct(), "lexical-terms")
    frequencies = index.table.select("term", "n_docs").join(wanted, "term").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weights = {r.term: weigh(r.df, index.n_docs) for r in frequencies.collect()}
    sent = []
    for row, item, terms in parsed.collect():
        weighed: dict[str, int] = {}
        for term in terms:
            if term in weights:
                weighed[term] = weighed.get(term, 0) + weights[term]
        sent.append((row, item, weighed))
    lists = index.table.where(F.col("term").isNotNull()).join(wanted, "term", "left_semi")
    blocks = index.table.where(F.col("term").isNull()).select(*lists.columns).unionByName(lists)
    # searching a block takes far longer than reading it, so partitions aren't joined by their sizes
    tasks = min(index.n_blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), index.n_blocks // 16))
    out = blocks.repartition(tasks, "block").groupBy("block").applyInArrow(_search(spark.sparkContext.broadcast(sent), k, index.n_docs, index.n_terms), "row long, item_id long, doc_id long, score long")
    return out.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
