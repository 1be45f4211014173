"""Exact deduplication with counting quotient filters.

1. Every task hashes its rows' normalised texts (A-Z lower-cased, UTF-8) to 64-bit fingerprints and SHA-256 and keeps
   them as a narrow table.
2. The fingerprint's high bits name a range; there are as many ranges as the rows need for about RANGE fingerprints in
   each. Every task builds a counting quotient filter for each range from its part of the table. Filters keep whole
   fingerprints, so that a range's filters, whatever their sizes, merge without loss by their sorted remainders.
3. The merged filters' fingerprints with a count of one are unique rows. The others go to byte verification: their
   rows' whole normalised texts are grouped by their bytes, with partial groups made before the shuffle.

A group of copies collapses in its task in steps 2 and 3, so a hot group costs a row for each task.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import ROW, folders, materialize, release, text_bytes, with_row

#: Fingerprints of a range, which is merged in one task.
RANGE = 1 << 20
#: Share of a filter's slots that its fingerprints may take, at most.
LOAD = 0.9
#: log2 of the bits of the filter that spares unique rows the shuffle of their text: bits for each repeated fingerprint
#: (a power of two), and the most, 128 MiB. With more repeated fingerprints more unique texts move; none is lost.
BITS_EACH, BITMAP_LOG2 = 16, 30


def _sums(sorted_values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with the sums of their counts."""
    if not len(sorted_values):
        return sorted_values, counts
    start = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return sorted_values[start], np.add.reduceat(counts, start)


class CountingQuotientFilter:
    """Fingerprints of `p` bits with counts in 2^q slots and an overflow behind them.

    A fingerprint's high q bits (quotient) are the slot where it belongs, the others (remainder) are stored. The
    remainders of a quotient are a run of increasing ones; runs lie in the order of their quotients, each at its slot or
    behind the run before. Three bits tell them apart: `occupied` (by quotient) says that it has a run, `ends` marks the
    last remainder of each run, and `counters` marks slots that hold a digit of the count less one, to the base
    2^(p - q) and least first, of the remainder before them; a count of one takes no such slot.
    """

    def __init__(self, p: int, q: int, occupied: np.ndarray, ends: np.ndarray, counters: np.ndarray, slots: np.ndarray):
        self.p, self.q, self.occupied, self.ends, self.counters, self.slots = p, q, occupied, ends, counters, slots

    @classmethod
    def build(cls, fingerprints, counts=None, p: int = 64, q: int | None = None) -> CountingQuotientFilter:
        """A filter of `fingerprints` below 2^p, repeats included, each with its count (1 if none are given)."""
        values = np.asarray(fingerprints, np.uint64)
        counts = np.ones(len(values), np.int64) if counts is None else np.asarray(counts, np.int64)
        order = np.argsort(values, kind="stable")  # merges runs that are sorted already
        values, counts = _sums(values[order], counts[order])
        if q is None:
            q = min(p - 1, max(1, int(np.ceil(np.log2(max(1, len(values) / LOAD))))))
        r = p - q
        if not 0 < r < 64:
            raise ValueError("quotient and remainder need a bit at least")
        digits, rest = [], (counts - 1).astype(np.uint64)
        while rest.any():
            digits.append(rest & np.uint64((1 << r) - 1))
            rest = rest >> np.uint64(r)
        length = np.ones(len(values), np.int64)
        for k, d in enumerate(digits):
            above = np.logical_or.reduce([x != 0 for x in digits[k:]])
            length += above
        quotient = (values >> np.uint64(r)).astype(np.int64)
        before = np.cumsum(length) - length
        place = np.maximum.accumulate(quotient - before) + before if len(values) else before
        n = max(1 << q, int(place[-1] + length[-1]) if len(values) else 0)
        occupied, ends, counters, slots = np.zeros(1 << q, bool), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.uint64)
        occupied[quotient] = True
        slots[place] = values & np.uint64((1 << r) - 1)
        ends[place[np.flatnonzero(np.r_[quotient[1:] != quotient[:-1], True])] if len(values) else []] = True
        for k, d in enumerate(digits):
            own = length > k + 1
            counters[place[own] + k + 1] = True
            slots[place[own] + k + 1] = d[own]
        return cls(p, q, occupied, ends, counters, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts."""
        r = self.p - self.q
        quotients = np.flatnonzero(self.occupied)
        last = np.flatnonzero(self.ends)
        # a run begins at its quotient's slot or behind the run before, whose last remainder may have digits
        after = last + 1
        stop = np.flatnonzero(~np.r_[self.counters, False])
        after = stop[np.searchsorted(stop, after)] if len(after) else after
        start = np.maximum(quotients, np.r_[0, after[:-1]]) if len(after) else quotients
        used = np.zeros(len(self.slots) + 1, np.int64)
        np.add.at(used, start, 1)
        np.add.at(used, after, -1)
        inside = np.cumsum(used[:-1]) > 0
        heads = np.flatnonzero(inside & ~self.counters)
        run = np.searchsorted(last, heads)
        values = quotients[run].astype(np.uint64) << np.uint64(r) | self.slots[heads]
        counts = np.ones(len(heads), np.int64)
        k, at = 0, heads + 1
        live = np.flatnonzero(at < len(self.slots))
        while len(live := live[self.counters[at[live]]]):
            counts[live] += self.slots[at[live]].astype(np.int64) << (k * r)
            k, at = k + 1, at + 1
            live = live[at[live] < len(self.slots)]
        return values, counts

    def count(self, fingerprint: int) -> int:
        """By the slots of the fingerprint's run alone."""
        r = self.p - self.q
        quotient, remainder = fingerprint >> r, fingerprint & (1 << r) - 1
        if not self.occupied[quotient]:
            return 0
        # runs lie in the order of quotients: this one is the k-th
        k, last = int(np.count_nonzero(self.occupied[:quotient])), np.flatnonzero(self.ends)
        at = quotient
        if k:
            at = int(last[k - 1]) + 1
            while at < len(self.slots) and self.counters[at]:
                at += 1
            at = max(quotient, at)
        while at <= last[k]:
            head, at, found, shift = at, at + 1, 1, 0
            while at < len(self.slots) and self.counters[at]:
                found, shift, at = found + (int(self.slots[at]) << shift), shift + r, at + 1
            if int(self.slots[head]) == remainder:
                return found
        return 0

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """A filter of both, sized for both; the quotients' bits may differ, as fingerprints are whole."""
        if self.p != other.p:
            raise ValueError("filters of different fingerprints")
        (a, m), (b, n) = self.items(), other.items()
        return CountingQuotientFilter.build(np.concatenate([a, b]), np.concatenate([m, n]), self.p)

    def dumps(self) -> bytes:
        width = (self.p - self.q + 7) // 8
        remainders = self.slots.view(np.uint8).reshape(-1, 8)[:, :width]
        bits = b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.ends, self.counters))
        return struct.pack("<BBQ", self.p, self.q, len(self.slots)) + bits + remainders.tobytes()

    @classmethod
    def loads(cls, data: bytes) -> CountingQuotientFilter:
        p, q, n = struct.unpack_from("<BBQ", data)
        at, bits = 10, []
        for size in (1 << q, n, n):
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
            at += (size + 7) // 8
        slots = np.zeros((n, 8), np.uint8)
        width = (p - q + 7) // 8
        slots[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        return cls(p, q, *bits, slots.view(np.uint64).reshape(-1))


def range_bits(rows: int, size: int = RANGE) -> int:
    """Bits that name a range, so that it has about `size` of the rows' fingerprints."""
    return max(0, (max(1, rows) - 1) // size).bit_length()


def normalise(text: bytes) -> bytes:
    return text.lower()  # of bytes: A-Z only


def _fingerprints(batches):
    import pyarrow as pa
    import xxhash

    for batch in batches:
        texts = [normalise(x) for x in text_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(np.fromiter((xxhash.xxh3_64_intdigest(x) for x in texts), np.uint64, len(texts)).view(np.int64)),
                pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()),
            ],
            names=[ROW, "id", "fingerprint", "sha"],
        )


def _filters(bits: int):
    """A task's filters: one for each range of fingerprints, named by their first `bits` bits."""

    def run(batches):
        import pyarrow as pa

        parts = [batch.column(0).to_numpy().view(np.uint64) for batch in batches]
        values, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
        p = 64 - bits
        own = (values >> np.uint64(p)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
        edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True]) if len(values) else [0]
        low = values & np.uint64((1 << p) - 1)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            packed = CountingQuotientFilter.build(low[a:b], counts[a:b], p).dumps()
            yield pa.RecordBatch.from_arrays([pa.array([own[a]], pa.int64()), pa.array([packed], pa.binary())], names=["range", "filter"])

    return run


def _merged(bits: int):
    """Merge one range's filters, small ones first; its fingerprints with a count above one."""

    def run(table):
        import heapq

        import pyarrow as pa

        filters = [(len(x), i, x) for i, x in enumerate(table.column("filter").to_pylist())]
        heapq.heapify(filters)
        while len(filters) > 1:
            (_, i, a), (_, _, b) = heapq.heappop(filters), heapq.heappop(filters)
            both = CountingQuotientFilter.loads(a).merge(CountingQuotientFilter.loads(b)).dumps()
            heapq.heappush(filters, (len(both), i, both))
        values, counts = CountingQuotientFilter.loads(filters[0][2]).items()
        repeated = counts > 1
        high = np.uint64(table.column("range")[0].as_py() << (64 - bits) if bits else 0)
        return pa.table({"fingerprint": (values[repeated] | high).view(np.int64), "n": counts[repeated]})

    return run


def _bitmap(repeated: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each repeated fingerprint's high bits, and log2 of the number of bits, BITMAP_LOG2 at most."""
    log2 = min(BITMAP_LOG2, max(16, (BITS_EACH * repeated.count()).bit_length()))
    bit = F.shiftrightunsigned("fingerprint", 64 - log2)
    rows = repeated.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).toLocalIterator()
    out = np.zeros((1 << log2) // 8 + 4096, np.uint8)
    for row in rows:
        at = (row.b - 1) * 4096 if row.b > 0 else 0
        out[at : at + 4096] |= np.frombuffer(bytes(row.bits), np.uint8)
    return out, log2


def _candidates(broadcast):
    def run(batches):
        import pyarrow as pa
        import xxhash

        bits, log2 = broadcast.value
        for batch in batches:
            texts = [normalise(x) for x in text_bytes(batch.column(1))]
            prints = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in texts), np.uint64, len(texts))
            # Spark numbers bits from 1: bucket (k - 1) / 32768 + 1 and position (k - 1) % 32768; key 0 has bucket 0
            key = (prints >> np.uint64(64 - log2)).astype(np.int64)
            at = np.maximum(key - 1, 0)
            hit = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 | (key == 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(hit)), pa.array(prints.view(np.int64)[hit]), pa.array([texts[i] for i in hit], pa.binary())],
                names=["id", "fingerprint", "bytes"],
            )

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decide for every row of `docs` whether it stays.

    Returns one row for each row: ROW, id, keep_id, group_size, kept, sha (binary). Of rows with equal normalised
    texts the one with the largest id stays; a null id counts as the smallest; of rows with the same id and text
    exactly one stays. A null text counts as empty, and all empty texts are one group. An empty table gives no rows.
    Texts of any length are hashed and compared whole. Only the two named columns are read, so other columns may have
    any name.
    """
    spark = docs.sparkSession
    base = with_row(docs).select(ROW, F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = materialize(base.mapInArrow(_fingerprints, f"{ROW} long, id long, fingerprint long, sha binary"), "exact-prints")
    ranges = range_bits(prints.count())
    filters = prints.select("fingerprint").mapInArrow(_filters(ranges), "range long, filter binary")
    repeated = materialize(filters.groupBy("range").applyInArrow(_merged(ranges), "fingerprint long, n long"), "exact-repeated")
    bits = spark.sparkContext.broadcast(_bitmap(repeated))
    routed = base.select("id", "text").mapInArrow(_candidates(bits), "id long, fingerprint long, bytes binary")
    groups = routed.groupBy("fingerprint", "bytes").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    verified = materialize(groups.select(F.unhex(F.sha2("bytes", 256)).alias("sha"), "keep_id", "group_size"), "exact-groups")
    found = prints.join(verified, "sha", "left")
    top = F.col("group_size").isNotNull() & F.col("id").eqNullSafe(F.col("keep_id"))
    first = found.where(top).groupBy("sha").agg(F.min(ROW).alias("first_row")).withColumnRenamed("sha", "first_sha")
    marked = found.join(first, F.when(top, F.col("sha")) == F.col("first_sha"), "left")
    single = F.col("group_size").isNull()
    return marked.select(
        ROW,
        "id",
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (single | (F.col(ROW) == F.col("first_row"))).eqNullSafe(True).alias("kept"),
        "sha",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; rules as in exact_duplicates()."""
    docs = with_row(docs)
    mark = folders()
    # of known size: few enough rows are sent along, so that no document moves
    gone = materialize(exact_duplicates(docs, id_col, text_col).where(~F.col("kept")).select(ROW), "exact-gone")
    release(docs.sparkSession, mark, gone)
    return docs.join(gone, ROW, "left_anti").drop(ROW)
