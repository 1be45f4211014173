"""Packing texts into chunks of bounded bytes, for services that take no more."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most UTF-8 bytes of a chunk.
MOST = 480


#: White space that ends a word.
_SPACES = " \t\n\r\f\v"
_SENTENCE = re.compile(r"(?<=[.!?。！？])(?:[ \t\n\r\f\v]+|[^\S \t\n\r\f\v]+)")


def hard_split(text: str, most: int = MOST) -> Iterator[str]:
    """Pieces of at most `most` bytes that don't cut characters, nor words that fit into one: white space stays with the piece before it."""
    data = text.encode()
    spaces = [i + 1 for i, c in enumerate(data) if c in _SPACES.encode()]
    at = 0
    while at < len(data):
        end = min(len(data), at + most)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        last = bisect.bisect_right(spaces, end) - 1
        if end < len(data) and data[end] not in _SPACES.encode() and last >= 0 and spaces[last] > at:
            end = spaces[last]
        yield data[at:end].decode()
        at = end


def _sentences(text: str) -> Iterator[tuple[str, str]]:
    """The white space before each sentence, and the sentence."""
    gap, at = "", 0
    for m in _SENTENCE.finditer(text):
        yield gap, text[at : m.start()]
        gap, at = m[0], m.end()
    yield gap, text[at:]


def packed(text: str, most: int = MOST) -> list[tuple[str, bool]]:
    """Sentences packed greedily; a sentence that is too long is cut, between words where it can be. Each chunk with whether it goes on in the last one's last word."""
    out: list[tuple[str, bool]] = []
    for gap, sentence in _sentences(text.strip(_SPACES)):
        for cut in [sentence] if len(sentence.encode()) <= most else hard_split(sentence, most):
            piece = cut.strip(_SPACES)
            gap += cut[: len(cut) - len(cut.lstrip(_SPACES))]
            spaced = any(c in gap for c in _SPACES)
            if piece:
                joined = f"{out[-1][0]}{' ' if spaced else gap}{piece}" if out else piece
                if out and len(joined.encode()) <= most:
                    out[-1] = joined, out[-1][1]
                else:
                    out.append((piece, bool(out) and not spaced))
                gap = ""
            gap += cut[len(cut.rstrip(_SPACES)) :] if piece else ""
    return out


def pack(text: str, most: int = MOST) -> list[str]:
    return [piece for piece, _ in packed(text, most)]


def rejoined(pieces: Iterable[str], glued: Iterable[bool]) -> str:
    """Chunks, or what became of them, as one text: a space between two, none inside a word that was cut."""
    return "".join(f"{'' if glue or not i else ' '}{piece}" for i, (piece, glue) in enumerate(zip(pieces, glued, strict=True)))


_PACKED = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("glued", T.BooleanType())]))


@F.pandas_udf(_PACKED)
def _pack(text: pd.Series) -> pd.Series:
    return text.map(lambda x: [{"text": piece, "glued": glue} for piece, glue in packed(x or "")])


def chunks(text: Column) -> Column:
    return parts(text)["text"]


def parts(text: Column) -> Column:
    """The chunks as structs of text and glued: whether it goes on in the last one's last word."""
    return _pack(text)


def whole(parts: Column) -> Column:
    """The text of parts(), whatever the white space between its chunks was."""
    return F.array_join(F.transform(parts, lambda x, i: F.concat(F.when(x["glued"] | (i == 0), "").otherwise(" "), x["text"])), "")


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """column, status and n of a cell translation's statuses (state.translate_cells())."""
    return df.groupBy(F.lit(column).alias("column"), F.col(f"{column}_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))
