"""Byte-level BPE encoding and decoding.

A token sequence is a string with one character for each token: the byte for tokens of a single byte (but ZERO for
byte 0, which is the separator of packed strings), the character of the rank for the others. So a merge replaces two characters by one, and a sequence of a document is the
concatenation of its pre-tokens' strings.

1. Each task splits its texts once, block by block, and writes for each text the numbers of its pre-tokens in the
   block's dictionary, and the dictionary's words, packed by a hash of the word. Words that the vocabulary has whole,
   which encode to that token, have the token's number and stay at home; so do words of over LONG bytes, whose fold
   would be quadratic: a heap in the task takes the same merges and the text gets their tokens' numbers.
2. Each distinct word of a group of blocks is encoded once: a higher-order function folds merges over the word's
   bytes, each step taking the leftmost of the lowest-ranked adjacent pairs, with ranks from a literal map.
3. The token strings go back to the blocks that asked for them, as files that hold one block's dictionary each, and
   replace the numbers. All passes read what the first one has written, so they needn't see the rows split alike.

Decoding concatenates the tokens' binary pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm import pretokens
from recordloom.llm.common import filesystem, materialize, plain_plans, small_batches, work_dir

#: Bytes up to which a word is folded.
LONG = 96
#: Slots of the literal rank map. The sign between its entries, and the one before a word that is done.
SLOTS, SIGN = 1 << 15, "ￜ"
#: Parts by hash of a group's distinct words. Tasks whose blocks are a group: no word has more askers than their blocks.
PARTS, GROUP = 256, 4096
#: Characters of text and dictionary words at which a block ends, after the text that reaches them.
BLOCK_CHARS, BLOCK_WORDS = 32 << 20, 1 << 20
#: Words that a task of the fold gets, on average.
FOLDED = 100_000
#: Numbers from here on are dictionary words, those below are tokens' characters. The separator of packed strings, and
#: what stands for byte 0 in them.
FIRST, SEP, ZERO = 0xD800, "\0", "\ud7ff"
#: Texts whose numbers are packed together.
PACKED = 16
_BREAK = "\x01\x02"


def char_of(token: bytes, ranks: dict[bytes, int]) -> str:
    return chr(ranks[token]) if len(token) > 1 else chr(token[0]) if token[0] else ZERO


def check(ranks: dict[bytes, int]) -> None:
    """Tokens have to fit the characters: every byte is a token with a rank below 256, the others' are from 256 to 55294."""
    if any(ranks.get(bytes([i]), 256) > 255 for i in range(256)) or not all(len(t) == 1 or 255 < r < ord(ZERO) for t, r in ranks.items()):
        raise ValueError("ranks below 256 have to be the bytes', and all below 55295")


def pairs(ranks: dict[bytes, int]) -> dict[str, str]:
    """Two adjacent tokens' characters to the merged token's."""
    return dict(_merges(ranks))


def _merges(ranks: dict[bytes, int]) -> Iterator[tuple[str, str]]:
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                yield char_of(token[:i], ranks) + char_of(token[i:], ranks), chr(rank)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal map: an array whose slot for a pair's CRC-32 holds SIGN, the pair and the merged token, repeatedly."""
    slots = [SIGN] * SLOTS
    for pair, merged in _merges(ranks):
        slots[zlib.crc32(pair.encode()) % SLOTS] += pair + merged + SIGN
    return F.split(F.lit(_BREAK.join(slots)), _BREAK, -1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def fold_merges(word: Column, table: Column) -> Column:
    """The token string of a word that is given by its bytes' characters."""

    def merged(pair: Column) -> Column:  # SIGN if the pair has no rank: it starts each slot and sorts behind all ranks
        slot = F.get(table, F.crc32(pair).bitwiseAND(F.lit(SLOTS - 1)).cast("int"))
        return F.substring(F.call_function("substring_index", slot, F.concat(F.lit(SIGN), pair), F.lit(-1)), 1, 1)

    def step(state: Column, _: Column) -> Column:
        ranked = F.transform(F.sequence(F.lit(1), F.length(state) - 1), lambda k: F.concat(merged(F.substr(state, k, F.lit(2))), F.char(k)))
        best = F.array_min(ranked)
        after = _let(
            best,
            lambda b: F.when(F.startswith(b, F.lit(SIGN)), F.concat(F.lit(SIGN), state)).otherwise(F.overlay(state, F.substring(b, 1, 1), F.ascii(F.substring(b, 2, 1)), F.lit(2))),
        )
        return F.when(F.startswith(state, F.lit(SIGN)) | (F.length(state) < 2), state).otherwise(after)

    steps = F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))
    return F.ltrim(F.aggregate(steps, word, step), F.lit(SIGN))


def heap_merges(word: bytes, merges: dict[str, str]) -> str:
    """The same merges with a heap of the pairs' ranks and a linked list of the tokens, in n log n steps."""
    tokens: list[str | None] = [chr(b) if b else ZERO for b in word]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(ord(m), i, a + b) for i, (a, b) in enumerate(zip(tokens, tokens[1:], strict=False)) if (m := merges.get(a + b))]
    heapq.heapify(heap)
    while heap:
        rank, i, pair = heapq.heappop(heap)
        j = after[i]
        if tokens[i] is None or j >= len(word) or tokens[i] + tokens[j] != pair:
            continue
        tokens[i], tokens[j], after[i] = chr(rank), None, after[j]
        if after[i] < len(word):
            before[after[i]] = i
            if m := merges.get(tokens[i] + tokens[after[i]]):
                heapq.heappush(heap, (ord(m), i, tokens[i] + tokens[after[i]]))
        if (k := before[i]) >= 0 and (m := merges.get(tokens[k] + tokens[i])):
            heapq.heappush(heap, (ord(m), k, tokens[k] + tokens[i]))
    return "".join(t for t in tokens if t is not None)


class _Numbers(dict):
    """Words to numbers; a new word is numbered when it is first asked for."""

    def __init__(self, whole: dict[str, int], pairs_of: Callable[[], dict[str, str]]):
        super().__init__(whole)
        self.own, self.long, self._pairs_of = [], {}, pairs_of

    def __missing__(self, word: str) -> int:
        if 4 * len(word) > LONG and len(data := word.encode()) > LONG:
            self[word] = number = -1 - len(self.long)
            self.long[number] = np.fromiter(map(ord, heap_merges(data, self._pairs_of())), np.int32)
            return number
        self[word] = number = FIRST + len(self.own)
        self.own.append(word)
        return number


def _start(word: str) -> str:
    """The token string that a word's merges start from: a character for each byte."""
    return word.encode().decode("latin-1").replace(SEP, ZERO)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as four runs of their lowest to highest bytes, which pack well: the high ones are mostly zero."""
    return numbers.astype("<i4", copy=False).view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)


_BLOCKS = "block long, ids array<long>, lengths array<int>, numbers binary, part int, start int, n int, words string"


def _split(ranks, pattern: str, chars: int, words: int):
    """A block's texts as numbers, then its dictionary by part."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        names = [x.split()[0] for x in _BLOCKS.split(", ")]
        block = TaskContext.get().partitionId() << 20
        split, whole = pretokens.splitter(pattern), {t.decode(): ord(char_of(t, ranks.value)) for t in ranks.value if _is_text(t)}
        merges: dict[str, str] = {}
        pairs_of = lambda: merges or merges.update(pairs(ranks.value)) or merges

        def packed(columns):
            n = len(next(c for c in columns if c is not None))
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        def ended():
            """The rows of a block: dictionary words are renumbered by part."""
            parts = np.fromiter((zlib.crc32(w.encode()) % PARTS for w in numbers.own), np.int32, len(numbers.own))
            order = np.argsort(parts, kind="stable")
            place = np.empty(FIRST + len(order), np.int32)
            place[:FIRST] = np.arange(FIRST)
            place[FIRST + order] = np.arange(FIRST, FIRST + len(order))
            for ids, rows in waiting:
                for at in range(0, len(rows), PACKED):
                    some = rows[at : at + PACKED]
                    yield packed([[block], [ids[at : at + PACKED]], [list(map(len, some))], [_planes(place[np.concatenate(some)])], None, None, None, None])
            edges = np.searchsorted(parts[order], np.arange(PARTS + 1))
            filled = np.flatnonzero(np.diff(edges)).tolist()
            for at in range(0, len(filled), 32):
                some = filled[at : at + 32]
                words = [SEP.join(_start(numbers.own[i]) for i in order[edges[k] : edges[k + 1]]) for k in some]
                yield packed([[block] * len(some), None, None, None, some, [int(edges[k]) for k in some], [int(edges[k + 1] - edges[k]) for k in some], words])

        numbers, waiting, size = _Numbers(whole, pairs_of), [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            begin, rows = 0, []
            for at, text in enumerate(texts, 1):
                found = split(text or "")
                row = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
                if numbers.long and len(row) and row.min() < 0:
                    row = np.concatenate([numbers.long[x] if x < 0 else np.array([x], np.int32) for x in row.tolist()])
                rows.append(row)
                size += len(text or "")
                if size >= chars or len(numbers.own) >= words:
                    waiting.append((ids[begin:at], rows))
                    yield from ended()
                    numbers, waiting, size, block, begin, rows = _Numbers(whole, pairs_of), [], 0, block + 1, at, []
            if rows:
                waiting.append((ids[begin:], rows))
        yield from ended()

    return run


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def _dictionary(fs, path: str) -> list[str]:
    """A block's token strings by number."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    out: dict[int, str] = {}
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        for info in fs.get_file_info(pafs.FileSelector(path)):
            if info.is_file and info.base_name.startswith("part-"):
                with fs.open_input_file(info.path) as source:
                    for group in pq.ParquetFile(source).iter_batches(64, columns=["start", "tokens"]):
                        out.update(zip(group.column(0).to_pylist(), group.column(1).to_pylist(), strict=True))
    return [*map(chr, range(FIRST)), *(t for start in sorted(out) for t in out[start].split(SEP))]


def _join(folder: str, finish: Callable):
    """`finish` of a batch's ids and token strings, with the dictionaries of the rows' blocks."""

    def run(batches):
        fs, path = filesystem(folder)
        known, table = None, []
        for batch in batches:
            for block, ids, lengths, numbers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if block != known:
                    known, table = block, []
                    table = _dictionary(fs, f"{path}/block={block}")
                found, at, encoded = _numbers(numbers).tolist(), 0, []
                for n in lengths:
                    encoded.append("".join(map(table.__getitem__, found[at : at + n])))
                    at += n
                yield finish(ids, encoded)

    return run


def _encoded(docs: DataFrame, id_col: str, text_col: str, ranks, pattern: str, chars: int, words: int) -> tuple[DataFrame, str]:
    """block, ids, lengths and numbers of each PACKED rows, and the folder of the blocks' dictionaries."""
    spark = docs.sparkSession
    check(ranks.value)
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = materialize(rows.mapInArrow(_split(ranks, pattern, chars, words), _BLOCKS), "bpe-blocks", "zstd")
    asked = blocks.where("words IS NOT NULL").withColumn("group", F.floor(F.shiftright("block", 20) / GROUP))
    n = asked.agg(F.sum("n")).first()[0] or 0
    # as many tasks as the words need; each has whole parts
    tasks = max(1, math.ceil(n / FOLDED))
    dealt = asked.repartition(tasks, "group", "part").select("group", "part", "block", "start", F.posexplode(F.split("words", SEP)).alias("pos", "word"))
    distinct = dealt.groupBy("group", "part", "word").agg(F.collect_list(F.struct("block", "start", "pos")).alias("askers"))
    folder = work_dir(spark, "bpe-dictionaries")
    with plain_plans(spark):
        folded = distinct.select("group", "part", "askers", fold_merges(F.col("word"), rank_map(ranks.value)).alias("tokens"))
        apart = folded.select("group", "part", "tokens", F.inline("askers")).groupBy("group", "part", "block", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("all"))
        back = apart.select("block", "start", F.array_join(F.col("all.tokens"), SEP).alias("tokens"))
        back.repartition(tasks, "block").sortWithinPartitions("block").write.option("compression", "zstd").partitionBy("block").parquet(folder)
    return blocks.where("numbers IS NOT NULL").select("block", "ids", "lengths", "numbers"), folder


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, chars: int = BLOCK_CHARS, words: int = BLOCK_WORDS) -> DataFrame:
    """id and tokens (a character for each token) for each row of `docs`; ids() and decode() read them.

    A null text counts as empty, which has no tokens; a null id stays null. Rows are independent, so repeated rows, ties
    and an empty table need no rule. A text of any length is one row; a block ends after the text that makes it long
    enough. Only the two named columns are read.
    """
    import pyarrow as pa

    ranks = docs.sparkSession.sparkContext.broadcast(pretokens.load_ranks(path or pretokens.default_path()))
    rows, folder = _encoded(docs, id_col, text_col, ranks, pattern or pretokens.default_pattern(), chars, words)
    return rows.mapInArrow(_join(folder, lambda ids, tokens: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.string())], names=["id", "tokens"])), "id long, tokens string")


def ids(tokens: str, byte_ranks: np.ndarray) -> np.ndarray:
    """A token string's ids."""
    points = np.frombuffer(tokens.encode("utf-32-le"), "<u4")
    return np.where(points < 256, byte_ranks[np.minimum(points, 255)], np.where(points == ord(ZERO), byte_ranks[0], points))


def _pieces(ranks: dict[bytes, int]) -> tuple[np.ndarray, list[bytes]]:
    """The bytes' ranks, and the tokens by rank."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return np.array([ranks[bytes([i])] for i in range(256)], np.uint32), pieces


def _digests(ranks):
    made: list = []

    def run(ids_column, encoded):
        import pyarrow as pa

        if not made:
            made.extend(_pieces(ranks.value))
        counts, hashed, decoded = [], [], []
        for tokens in encoded:
            found = ids(tokens, made[0])
            counts.append(len(found))
            hashed.append(hashlib.sha256(found.astype("<u4", copy=False)).hexdigest())
            decoded.append(hashlib.sha256(b"".join(map(made[1].__getitem__, found.tolist()))).hexdigest())
        return pa.RecordBatch.from_arrays([pa.array(ids_column, pa.int64()), pa.array(counts, pa.int64()), pa.array(hashed), pa.array(decoded)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _each(finish: Callable):
    def run(batches):
        for batch in batches:
            yield finish(batch.column(0).to_pylist(), batch.column(1).to_pylist())

    return run


DIGESTS = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 (of the decoded bytes) of encode()'s rows."""
    ranks = encoded.sparkSession.sparkContext.broadcast(pretokens.load_ranks(path or pretokens.default_path()))
    return encoded.select("id", "tokens").mapInArrow(_each(_digests(ranks)), DIGESTS)


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, chars: int = BLOCK_CHARS, words: int = BLOCK_WORDS) -> DataFrame:
    """digests() of encode()'s rows, made where the rows are encoded: no token strings are sent back; rules as in encode()."""
    ranks = docs.sparkSession.sparkContext.broadcast(pretokens.load_ranks(path or pretokens.default_path()))
    rows, folder = _encoded(docs, id_col, text_col, ranks, pattern or pretokens.default_pattern(), chars, words)
    return rows.mapInArrow(_join(folder, _digests(ranks)), DIGESTS)


def _decode(ranks):
    def run(batches):
        import pyarrow as pa

        byte_ranks, pieces = _pieces(ranks.value)
        for batch in batches:
            texts = [b"".join(map(pieces.__getitem__, ids(t, byte_ranks).tolist())).decode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """id and text of encode()'s rows."""
    ranks = encoded.sparkSession.sparkContext.broadcast(pretokens.load_ranks(path or pretokens.default_path()))
    return encoded.select("id", "tokens").mapInArrow(_decode(ranks), "id long, text string")


def decode_ids(found: list[int], ranks: dict[bytes, int]) -> bytes:
    pieces = {rank: token for token, rank in ranks.items()}
    return b"".join(pieces[i] for i in found)
