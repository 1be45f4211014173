"""Splitting texts into pre-tokens, and rank files of byte-level vocabularies."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

#: The rank file of the queries; operators take any path.
VOCABULARY = "byte_bpe_50k.tiktoken"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of lines with base64 and rank. Vocabularies are of a fixed size, so they may be broadcast."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: Code points of texts that take a pattern of plain classes: up to Latin Extended-B, punctuation, currency signs.
LATIN = ((0x0000, 0x0250), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20D0))


def _plain(pattern: str, ranges: tuple[tuple[int, int], ...]) -> re.Pattern | None:
    """A pattern of the standard library's that matches alike in texts of the ranges' characters; None if there is none."""
    import regex

    def members(property_: str) -> str:
        is_ = regex.compile(rf"\p{{{property_}}}").match
        return "".join(re.escape(chr(i)) for a, b in ranges for i in range(a, b) if is_(chr(i)))

    letters, numbers, spaces = map(members, ("L", "N", "White_Space"))
    for old, new in ((r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\S", f"[^{spaces}]"), (r"\s", f"[{spaces}]")):
        pattern = pattern.replace(old, new)
    return None if r"\p" in pattern else re.compile(pattern)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that lists a text's matches of `pattern`; white space is Unicode's White_Space property.

    ASCII texts and those of LATIN take equivalent patterns of plain classes, which are faster.
    """
    import regex

    general = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    ascii_only, latin = _plain(pattern, ((0, 128),)), _plain(pattern, LATIN)
    if ascii_only is None or latin is None:
        return general
    known = re.compile("[" + "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in LATIN) + "]*").fullmatch
    ascii_all, latin_all = ascii_only.findall, latin.findall
    return lambda text: ascii_all(text) if text.isascii() else latin_all(text) if known(text) else general(text)
