"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

For the radius r every bit position gets a nonzero vector of F_2^(r+1); table v (a nonzero vector of the same space)
keeps the bits whose vector has an odd inner product with v. The r vectors of any r differing bits leave a nonzero v
orthogonal to all of them, so that table's mask covers none of the differing bits: each pair within the radius meets
in a table for certain.

Equal fingerprints are one node from the start. Buckets of up to PAIRS nodes compare their nodes with each other, which
makes the fewest rows. Larger buckets link their nodes through hubs instead, which is exact and linear: two fingerprints differ in at most
two bits if and only if some value is at most one bit from either, so each node sends itself and its one-bit changes
(only of bits that the mask leaves out, as the others are equal) and all senders of a value link to its least one.
That holds for radii of 1 and 2. For larger ones large buckets are dealt to blocks of about PAIRS nodes, and each node
is compared with every block: exact too, but quadratic, in rows as large as the bucket times its blocks.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import ROW, folders, materialize, release, text_bytes, with_row
from recordloom.llm.components import connected_components

#: Words in a shingle, seed of its hash, and the most bits in which linked fingerprints differ.
WORDS, SEED, RADIUS = 3, 42, 2
#: Nodes of a bucket that are compared one by one. A choice of plan: both ways keep the same components.
PAIRS = 48
_CHUNK = 1 << 16


def shingles(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The XXH64 of each shingle, repeats included; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    parts = text.lower().split()  # of bytes: A-Z, and U+0020 and U+0009 to U+000D
    if not parts:
        return np.empty(0, np.uint64)
    joined = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)) if len(parts) >= words else iter([b" ".join(parts)])
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), joined), np.uint64, max(1, len(parts) - words + 1))


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The majority of each bit over the XXH64 of the text's shingles, repeats included; without words 0."""
    return majority(shingles(text, words, seed))


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            prints = np.array([fingerprint(x, words) for x in text_bytes(batch.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=[ROW, "id", "fingerprint"])

    return run


def masks(radius: int) -> list[int]:
    """The bits that each table keeps."""
    vectors = (1 << radius + 1) - 1
    own = [i % vectors + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if (own[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hubs(table: Column, node: Column, radius: int) -> Column:
    """The values through which a node of a large bucket links, as structs (bit, value)."""
    per_table = []
    for v, mask in enumerate(masks(radius)):
        bits = [i for i in range(64) if not mask >> i & 1]
        if radius == 1:  # the bit is left out
            hubs = [F.struct(F.lit(i).alias("bit"), node.bitwiseOR(F.lit(_signed(1 << i))).alias("value")) for i in bits]
        else:
            hubs = [F.struct(F.lit(0).alias("bit"), x.alias("value")) for x in (node, *(node.bitwiseXOR(F.lit(_signed(1 << i))) for i in bits))]
        per_table.append((v, F.array(*hubs)))
    out = F.when(table == per_table[0][0], per_table[0][1])
    for v, hubs in per_table[1:]:
        out = out.when(table == v, hubs)
    return out


def links(nodes: DataFrame, radius: int = RADIUS, pairs: int = PAIRS) -> DataFrame:
    """Edges a, b whose components are those of all pairs of distinct `nodes` (node) within the radius.

    A node has 2^(radius + 1) - 1 rows, one in each table.
    """
    if radius < 1:
        raise ValueError("the radius has to be 1 or more")
    tables = F.array(*(F.struct(F.lit(v).alias("t"), F.col("node").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(masks(radius))))
    rows = nodes.select("node", F.inline(tables))
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(rows.join(sizes, ["t", "key"]), "simhash-buckets")
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    bucket = F.collect_list("node")
    small = met.where(F.col("n") <= pairs).groupBy("t", "key").agg(bucket.alias("all"))
    found = F.flatten(F.transform("all", lambda x: F.transform(F.filter("all", lambda y: (y < x) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    compared = small.select(F.inline(found))
    large = met.where(F.col("n") > pairs)
    if radius > 2:
        blocks = F.ceil(F.col("n") / max(pairs, 1)).cast("int")
        lists = large.groupBy("t", "key", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block")).agg(bucket.alias("all"))
        asked = large.select("t", "key", "node", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")).join(lists, ["t", "key", "block"])
        return compared.union(asked.select(F.col("node").alias("a"), F.explode(F.filter("all", lambda y: (y < F.col("node")) & near(F.col("node"), y))).alias("b")))
    hubs = large.select("t", "node", F.inline(_hubs(F.col("t"), F.col("node"), radius)))
    least = hubs.groupBy("t", "bit", "value").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b <> most").drop("most")
    linked = hubs.join(least, ["t", "bit", "value"]).where("node <> b").select(F.col("node").alias("a"), "b")
    return compared.union(linked)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """ROW, id, fingerprint (long) and component_id for each row of `docs`.

    component_id is the smallest id that links reach, the own included (null ids are passed over; null if there is no
    other). A null text counts as empty; all texts without words have the fingerprint 0. Repeated rows share their
    component. An empty table gives no rows. Texts of any length are read whole. Only the two named columns are read.
    """
    base = with_row(docs).select(ROW, F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = materialize(base.mapInArrow(_fingerprints(words), f"{ROW} long, id long, fingerprint long"), "simhash-prints")
    nodes = materialize(prints.groupBy(F.col("fingerprint").alias("node")).agg(F.min("id").alias("least")), "simhash-nodes")
    roots = connected_components(links(nodes.select("node"), radius))
    rooted = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = materialize(rooted.join(ids, "root").select("node", "component_id"), "simhash-components")
    return prints.join(found, prints.fingerprint == found.node).select(ROW, "id", "fingerprint", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each component, the first of those with the smallest id, with all its columns.

    A row with a null id stays only if its component has no other; else rules as in near_duplicates().
    """
    docs = with_row(docs)
    mark = folders()
    found = materialize(near_duplicates(docs, id_col, text_col, words, radius).select(ROW, "id", "fingerprint", "component_id"), "simhash-rows")
    stays = found.where(F.col("id").eqNullSafe(F.col("component_id"))).withColumn("none", F.when(F.col("component_id").isNull(), F.col("fingerprint")))
    first = stays.groupBy("component_id", "none").agg(F.min(ROW).alias(ROW))
    # of known size: few enough rows are sent along, so that no document moves
    gone = materialize(found.join(first.select(ROW), ROW, "left_anti").select(ROW), "simhash-gone")
    release(docs.sparkSession, mark, gone)
    return docs.join(gone, ROW, "left_anti").drop(ROW)
