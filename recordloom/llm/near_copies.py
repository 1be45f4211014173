"""Near copies by the exact Jaccard similarity of shingle sets, with SimHash for what it reaches.

At a similarity of 0.8 SimHash fingerprints differ in about 10 of 64 bits, a radius that no affordable number of
covering tables reaches. So covering hashing of the fingerprints gives the first candidates, and prefix filtering finds
all other pairs: if all sets are sorted in one order, sets of a similarity of t or more share an element among the
first n - ceil(t n) + 1 of either. The order puts shingles that a sample shows to be common last; the sample decides the
speed only, the pairs are the same in any order.

Equal sets are linked at once. Then rounds of candidates are verified: those of SimHash, each row against one of its
buckets' least rows, by their places and by hashes, a few pairs of each row that are alike, and last all pairs of a bucket
whose rows aren't linked yet. The first ones have a pair or a few for each row and link most of a large group, so that few
are left for the last, which leaves none out.

Two near copies share many shingles, but first meet at one of them, in the common order. So a bucket whose rows all have
the same shared shingle before its own has no pair that doesn't meet there too, and goes; and rows carry their last
shared shingles, by which a pair of a bucket is seen to have met before.

Most shingles are one row's alone, so what is dealt out to count them and to find the shared ones is packed: a task sends
a part of all shingles as a few arrays with 32 bits of each. With the part these are enough to tell shingles apart; two
that aren't meet as if they were one, which makes a candidate that doesn't verify.

To verify, parity sketches come first: bit i of a sketch is the parity of the elements that hash to i, so two sketches
differ in no more bits than the sets differ in elements. A sketch has a bit or two for each element and folds to half
its length, so sets of like sizes can be compared. Only pairs that pass have their whole sets intersected.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import ROW, counted, few_tasks, folders, materialize, release, text_bytes, with_row
from recordloom.llm.components import connected_components
from recordloom.llm.simhash import RADIUS, links, majority, shingles

#: Words in a shingle and the least similarity of linked texts.
WORDS, SIMILARITY = 5, 0.8
#: The order's sample: a share of the rows, but this many at least; the least count of a common shingle, and the most of
#: them that are sent along (32 MB). Shingles that the order takes for rare only make candidates that don't verify; the
#: share bounds how large their buckets get, with whose square these candidates grow.
SHARE, SAMPLE, COMMON, MOST_COMMON = 1 / 8, 5000, 3, 2_000_000
#: Rows of a bucket that are compared in one list, and the most words of a sketch that moves with each: long texts have
#: long sketches and many buckets, so their pairs are compared by size and place first.
PAIRS, LISTED = 48, 16
#: Shared shingles before its own that a bucket's row carries. More find more of the pairs that have met; none is lost by any number.
BEFORE = 4
#: Pairs of a row that are tried before all others are, and the lists of a bucket in which they are looked for.
SOME = 4
#: Keeps products of the similarity, which isn't a binary fraction, from being rounded past a whole number.
_EPS = 1e-9
#: Pairs whose whole sets a task compares.
_COMPARED = 5000
#: Rows whose whole sets are sent from Python at a time.
_SLICE = 100
#: Shingles that a task packs at a time; the fewest parts that they are dealt to, and the shingles of a part, about.
_PACKED, _PARTS, _PART = 1 << 19, 64, 1 << 19


def _set(text: bytes, words: int) -> np.ndarray:
    return np.unique(shingles(text, words))


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - _EPS) + 1 if n else 0


def _parts(grams: int) -> int:
    return max(_PARTS, grams // _PART)


def _keys(own: np.ndarray, parts: int) -> np.ndarray:
    """What tells shingles apart: their part, and 32 bits below it."""
    return (own >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | own & np.uint64(0xFFFFFFFF)


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers of 0 or more in as few bytes each as the largest takes."""
    return numbers.astype(np.min_scalar_type(numbers.max())).tobytes()


def _wide(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{len(packed) // n}").astype(np.int64)


def _ends(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """Part, start and end of each part of sorted keys."""
    own, starts = np.unique(keys >> np.uint64(32), return_index=True)
    return list(zip(own.tolist(), starts.tolist(), [*starts.tolist()[1:], len(keys)], strict=True))


def _sampled(words: int, parts: int):
    def packed(sets: list[np.ndarray]):
        import pyarrow as pa

        keys, counts = np.unique(np.concatenate(sets), return_counts=True)
        ends = _ends(keys)
        low = keys.astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array([part for part, _, _ in ends], pa.int32()), pa.array([low[x:y].tobytes() for _, x, y in ends], pa.binary()), pa.array([_narrow(counts[x:y]) for _, x, y in ends], pa.binary())], names=["part", "grams", "counts"])

    def run(batches):
        sets, held = [], 0
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                sets.append(_keys(_set(text, words), parts))
                held += len(sets[-1])
                if held >= _PACKED:
                    yield packed(sets)
                    sets, held = [], 0
        if held:
            yield packed(sets)

    return run


def _frequent(least: int):
    """The keys of one part with a count of `least` or more in all."""

    def run(table):
        import pyarrow as pa

        low = [np.frombuffer(x, "<u4") for x in table.column("grams").to_pylist()]
        counts = [_wide(x, len(y)) for x, y in zip(table.column("counts").to_pylist(), low, strict=True)]
        keys, at = np.unique(np.concatenate(low), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, at, np.concatenate(counts))
        often = n >= least
        return pa.table({"gram": (table.column("part")[0].as_py() << 32) + keys[often].astype(np.int64), "n": n[often]})

    return run


def _dealt(parts: int):
    """The prefixes of many rows as one row for each part: the rows' numbers by the gaps between them, sizes, places and shingles."""

    def packed(batches):
        import pyarrow as pa

        table = pa.Table.from_batches(batches).sort_by(ROW).combine_chunks()
        node, n, prefix = (table.column(i).chunk(0) for i in range(3))
        sizes = np.diff(prefix.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keys = _keys(prefix.flatten().to_numpy().view(np.uint64), parts)
        order = np.argsort((keys >> np.uint64(32)).astype(np.uint32), kind="stable")
        keys, row, pos = keys[order], row[order], pos[order]
        low, node, n = keys.astype(np.uint32), node.to_numpy()[row], n.to_numpy()[row]
        # by whole parts in order, so that _ends() holds though a part's keys aren't sorted
        out = [(part, int(node[x]), _narrow(np.diff(node[x:y], prepend=node[x])), _narrow(n[x:y]), _narrow(pos[x:y]), low[x:y].tobytes()) for part, x, y in _ends(keys)]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _DEALT.split(", ")])

    def run(batches):
        some, held = [], 0
        for batch in batches:
            some.append(batch)
            held += len(batch.column(2).flatten())
            if held >= _PACKED:
                yield packed(some)
                some, held = [], 0
        if held:
            yield packed(some)

    return run


_DEALT = "part int, first long, gaps binary, sizes binary, places binary, grams binary"


def _shared(table):
    """Rows and places of one part's shingles that two rows or more have."""
    import pyarrow as pa

    low = [np.frombuffer(x, "<u4") for x in table.column("grams").to_pylist()]
    number = lambda name: [_wide(x, len(y)) for x, y in zip(table.column(name).to_pylist(), low, strict=True)]
    node = np.concatenate([first + np.cumsum(gaps) for first, gaps in zip(table.column("first").to_pylist(), number("gaps"), strict=True)])
    n, pos, low = np.concatenate(number("sizes")), np.concatenate(number("places")), np.concatenate(low)
    order = np.argsort(low, kind="stable")
    low = low[order]
    same = np.concatenate([[False], low[1:] == low[:-1], [False]])
    several = same[1:] | same[:-1]
    order = order[several]
    gram = (table.column("part")[0].as_py() << 32) + low[several].astype(np.int64)
    return pa.table({"node": node[order], "n": pa.array(n[order], pa.int32()), "pos": pa.array(pos[order], pa.int32()), "gram": gram})


def parity_sketch(own: np.ndarray) -> np.ndarray:
    """As many bits as elements, or up to twice as many (a power of two, 64 at least), as signed 64-bit words."""
    bits = max(64, 1 << (len(own) - 1).bit_length())
    place = (own >> np.uint64(20)).astype(np.int64) & (bits - 1)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


_PRINTS = f"{ROW} long, id long, n int, digest binary, fingerprint long, sketch array<long>, prefix array<long>"


def _prefixes(words: int, similarity: float, common):
    def run(batches):
        import pyarrow as pa

        grams, counts, parts = common.value
        longs = pa.list_(pa.int64())
        for batch in batches:
            kept: tuple[list, ...] = ([], [], [], [], [])
            for text in text_bytes(batch.column(2)):
                hashes = shingles(text, words)
                own = np.unique(hashes)
                known = np.zeros(len(own), np.int64)
                if len(grams) and len(own):
                    keys = _keys(own, parts)
                    at = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
                    known = np.where(grams[at] == keys, counts[at], 0)
                first = np.lexsort((own, known))[: prefix_length(len(own), similarity)]
                row = (len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), majority(hashes), parity_sketch(own), own[first].view(np.int64))
                for column, value in zip(kept, row, strict=True):
                    column.append(value)
            prints = pa.array(np.array(kept[2], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept[0], pa.int32()), pa.array(kept[1], pa.binary()), prints, pa.array(kept[3], longs), pa.array(kept[4], longs)], names=[x.split()[0] for x in _PRINTS.split(", ")])

    return run


def _sets(words: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, len(batch), _SLICE):
                part = batch.slice(at, _SLICE)
                sets = [_set(text, words).view(np.int64) for text in text_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "grams"])

    return run


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted keys of common shingles of a sample, their counts there, and the parts that the keys are of."""
    rows = texts.count()
    part = max(1, round(1 / max(SHARE, min(1.0, SAMPLE / max(rows, 1)))))
    parts = _parts(rows // part * 512)
    sample = texts.where(F.pmod(F.xxhash64(ROW), F.lit(part)) == 0).select("text").mapInArrow(_sampled(words, parts), "part int, grams binary, counts binary")
    found = sample.groupBy("part").applyInArrow(_frequent(COMMON), "gram long, n long").orderBy(F.desc("n"), "gram").limit(MOST_COMMON).toPandas()
    grams, counts = found["gram"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(grams)
    return grams[order], counts[order], parts


def _may(x: Column, y: Column, similarity: float) -> Column:
    """Whether sizes and places of the first common shingle leave the similarity possible. Later common shingles leave less."""
    common = F.least(x["n"] - x["pos"], y["n"] - y["pos"])
    return common >= (x["n"] + y["n"]) * F.lit(similarity / (1 + similarity)) - _EPS


def _first_met(met: DataFrame) -> DataFrame:
    """Without the buckets whose rows all have met in the bucket before; `before` has a row's last BEFORE shared shingles, or nulls.

    A pair's first common shingle has none before it that both have, so its bucket stays.
    """
    places = Window.partitionBy("node").orderBy("pos")
    met = materialize(met.withColumn("before", F.array(*(F.lag("gram", i).over(places) for i in range(1, BEFORE + 1)))), "near-places")
    last = F.col("before")[0]
    again = met.groupBy("gram").agg(F.min(last).alias("low"), F.max(last).alias("high"), F.count(last).alias("k"), F.count(F.lit(1)).alias("size")).where("low = high and k = size")
    return met.join(again.select("gram"), "gram", "left_anti")


def _leaders(met: DataFrame, order: Column, similarity: float) -> DataFrame:
    """Each row with one of its buckets' least rows by `order`: the one with which it shares most buckets, of these the one nearest in size."""
    least = met.groupBy("gram").agg(F.min_by(F.struct("node", "n", "pos"), order).alias("y"))
    pairs = met.withColumn("x", F.struct("node", "n", "pos")).join(least, "gram")
    shared = pairs.where((F.col("x.node") != F.col("y.node")) & _may(F.col("x"), F.col("y"), similarity)).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.first(F.abs(F.col("x.n") - F.col("y.n"))).alias("apart"))
    return shared.groupBy("a").agg(F.max_by("b", F.struct("k", -F.col("apart"), -F.col("b"))).alias("b"))


def _apart(met: DataFrame, prints: DataFrame, similarity: float, pairs: int, most: int | None = None) -> DataFrame:
    """Rows (a) with lists (b) of the rows of a bucket that are in different components (root), haven't met before and whose sizes, and sketches of up to LISTED words, are alike.

    A bucket's rows are dealt to lists of about `pairs` rows. Those outside of the bucket's largest component meet each
    list, and compare themselves with its rows; of two such rows the larger does. With `most`, they meet so many
    of the lists only.
    """
    ties = met.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("gram").agg(F.sum("k").alias("size"), F.max_by("root", "k").alias("main"))
    rows = met.join(ties, "gram").withColumn("lists", F.ceil(F.col("size") / max(pairs, 1)).cast("int")).join(prints.select(F.col(ROW).alias("node"), F.when(F.size("sketch") <= LISTED, F.col("sketch")).alias("sketch")), "node")
    item = F.struct("node", "n", "pos", "root", "before", "sketch")
    listed = rows.groupBy("gram", F.pmod(F.xxhash64("node"), F.col("lists")).cast("int").alias("list")).agg(F.collect_list(item).alias("all"))
    meet = F.col("lists") if most is None else F.least("lists", F.lit(most))
    asked = rows.where(F.col("root") != F.col("main")).select("gram", item.alias("x"), "main", "lists", F.explode(F.sequence(F.lit(0), meet - 1)).alias("i"))
    asked = asked.withColumn("list", F.pmod(F.pmod(F.xxhash64("x.node", F.lit(1)), F.col("lists")) + F.col("i"), F.col("lists")).cast("int")).drop("lists", "i")
    x = F.col("x")
    apart = lambda y: (x["root"] != y["root"]) & ((y["root"] == F.col("main")) | (x["node"] > y["node"])) & _may(x, y, similarity) & ~F.coalesce(F.arrays_overlap(x["before"], y["before"]), F.lit(False)) & F.when(x["sketch"].isNull() | y["sketch"].isNull(), _sizes(x, y, similarity)).otherwise(_alike(x, y, similarity))
    found = asked.join(listed, ["gram", "list"]).select(x["node"].alias("a"), F.transform(F.filter("all", apart), lambda y: y["node"]).alias("b"))
    return found.where(F.size("b") > 0)


def _some(*args) -> DataFrame:
    """A few of each row's pairs in _apart(), by hashes: alike as they are they link most rows of a large group, so that _rest() has few."""
    found = _apart(*args, most=SOME).select("a", F.col("b")[0].alias("b"))
    few = found.groupBy("a").agg(F.array(*(F.min_by("b", F.xxhash64("b", F.lit(i))) for i in range(SOME))).alias("b"))
    return few.select("a", F.explode(F.array_distinct("b")).alias("b"))


def _rest(*args) -> DataFrame:
    """All pairs in _apart()."""
    return _apart(*args).select("a", F.explode("b").alias("b"))


def _fingerprints_near(own: DataFrame) -> DataFrame:
    """Candidates by SimHash: rows of one fingerprint with the least of them, and the least ones of linked fingerprints."""
    least = materialize(own.groupBy(F.col("fingerprint").alias("node")).agg(F.min(ROW).alias("row")), "near-fingerprints")
    edges = links(least.select("node"), RADIUS)
    ends = edges.join(least.select(F.col("node").alias("a"), F.col("row").alias("x")), "a").join(least.select(F.col("node").alias("b"), F.col("row").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return own.join(least, own.fingerprint == least.node).where(F.col(ROW) != F.col("row")).select(F.col(ROW).alias("a"), F.col("row").alias("b")).union(ends)


def _folded(sketch: Column, size: Column) -> Column:
    """A sketch of `size` words from one of as many or twice as many."""
    half = F.zip_with(F.slice(sketch, 1, size), F.slice(sketch, size + 1, size), lambda p, q: p.bitwiseXOR(q))
    return F.when(F.size(sketch) > size, half).otherwise(sketch)


def _sizes(x: Column, y: Column, similarity: float) -> Column:
    return F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * F.lit(similarity) - _EPS


def _alike(x: Column, y: Column, similarity: float) -> Column:
    """Whether sizes (n) and sketches leave the similarity possible: sketches differ in no more bits than sets in elements."""
    sizes = _sizes(x, y, similarity)
    if similarity <= 0.5:
        return sizes
    # sizes that allow the similarity differ by half at most, and sketches by one fold
    least = F.least(F.size(x["sketch"]), F.size(y["sketch"]))
    bits = F.zip_with(_folded(x["sketch"], least), _folded(y["sketch"], least), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    few = (x["n"] + y["n"]) * F.lit((1 - similarity) / (1 + similarity)) + _EPS
    return F.when(sizes, F.aggregate(bits, F.lit(0), lambda s, b: s + b) <= few).otherwise(False)


def _verified(pairs: DataFrame, base: DataFrame, prints: DataFrame, words: int, similarity: float) -> DataFrame:
    tidy = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    side = lambda name: prints.select(F.col(ROW).alias(name), F.struct("n", "sketch").alias(f"print_{name}"))
    sized = tidy.join(side("a"), "a").join(side("b"), "b").where(_alike(F.col("print_a"), F.col("print_b"), similarity))
    likely, (n,) = counted(sized.select("a", "b"), "near-candidates")
    if not n:
        return likely
    # of known size, so that the texts need not move: only those of candidates are read in whole
    needed = materialize(few_tasks(likely.select(F.explode(F.array("a", "b")).alias(ROW)).distinct(), 2 * n), "near-nodes")
    sets = materialize(base.join(needed, ROW, "left_semi").select(ROW, "text").mapInArrow(_sets(words), "node long, grams array<long>"), "near-sets")
    both = likely.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    linked = both.where(common * (1 + similarity) >= (F.size("x") + F.size("y")) * F.lit(similarity) - _EPS).select("a", "b")
    return few_tasks(linked, n, _COMPARED)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, pairs: int = PAIRS) -> DataFrame:
    """ROW, id and root (the ROW that all rows of a component share) of the rows in components of two or more.

    Links are all pairs of rows whose sets of `words`-word shingles, by their 64-bit hashes, have a Jaccard similarity
    of at least `similarity`. A text with fewer words is one shingle; a null text counts as empty, and texts without
    words are equal to each other only. Repeated rows are equal. An empty table gives no rows. Texts of any length are
    read whole. Only the two named columns are read.
    """
    if not 0 < similarity <= 1:
        raise ValueError("the similarity has to be above 0 and at most 1")
    base = with_row(docs).select(ROW, F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    mark = folders()
    common = docs.sparkSession.sparkContext.broadcast(_common(base, words))
    prints, (_, grams) = counted(base.mapInArrow(_prefixes(words, similarity, common), _PRINTS), "near-prefixes", F.sum(F.size("prefix")))
    equal = prints.groupBy("digest").agg(F.min(ROW).alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    edges = materialize(prints.select("digest", F.col(ROW).alias("a")).join(equal, "digest").where("a <> b").select("a", "b"), "near-equal")
    own = prints.join(edges.select(F.col("a").alias(ROW)), ROW, "left_anti")
    rows = own.select(ROW, "n", "prefix").mapInArrow(_dealt(_parts(grams or 0)), _DEALT).groupBy("part").applyInArrow(_shared, "node long, n int, pos int, gram long")
    met = materialize(_first_met(rows), "near-buckets")
    release(docs.sparkSession, mark, prints, edges, met)
    roots = None
    for round_ in (_fingerprints_near, F.col("node"), F.xxhash64("node"), _some, _rest):
        leads, left = isinstance(round_, Column), met
        if roots is not None:  # buckets within one component are settled
            known = (met.drop("before") if leads else met).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            several = known.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("gram")
            left, (n,) = counted(known.join(several, "gram"), "near-left")
            if not n:
                break
        candidates = _leaders(left, round_, similarity) if leads else round_(own) if roots is None else round_(left, prints, similarity, pairs)
        found, (n,) = counted(_verified(candidates, base, prints, words, similarity), "near-links")
        if n or roots is None:
            edges = edges.union(found)
            roots = connected_components(edges)
        release(docs.sparkSession, mark, prints, edges, met, roots)
    inside = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    return prints.select(ROW, "id").join(inside.withColumnRenamed("node", ROW), ROW)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Of each component the first row with the smallest id stays (a null id only if there is no other), with all columns; so do all rows without links."""
    docs = with_row(docs)
    mark = folders()
    found = materialize(near_copies(docs, id_col, text_col, words, similarity), "near-rows")
    first = found.groupBy("root").agg(F.min_by(ROW, F.struct(F.col("id").isNull(), "id", ROW)).alias(ROW))
    # of known size: few enough rows are sent along, so that no document moves
    gone = materialize(found.join(first.select(ROW), ROW, "left_anti").select(ROW), "near-gone")
    release(docs.sparkSession, mark, gone)
    return docs.join(gone, ROW, "left_anti").drop(ROW)
