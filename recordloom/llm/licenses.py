"""License scan: Aho-Corasick finds phrases and identifier tags, a shunting-yard parser evaluates the expressions.

`score` is how much of a document's license evidence agrees on one label: 0 without evidence, else the share of the
pieces of evidence that have the most frequent label, halved where an expression breaks off or names an unknown
identifier. A base or notice phrase is a piece. An expression's required labels, which hold in each of its alternatives,
are one piece together, each other label is one of its own: `A AND B` agrees on both, `A OR B` leaves a choice.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import text_bytes

#: The base phrases with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases, as words.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "released under the apache license": "apache-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: Words before an expression: SPDX-License-Identifier.
TAG = "spdx license identifier"
#: SPDX identifiers, lower case, with the label that the base phrases use.
SPDX = {"mit": "mit", "apache-2.0": "apache-2", "cc-by-nc-4.0": "cc-by-nc", "cc-by-nc-3.0": "cc-by-nc", "cc-by-nc-2.0": "cc-by-nc", "cc0-1.0": "cc0"}
_KNOWN = re.compile(r"(?:[al]?gpl|mpl|epl|bsd|cc-by|cc0|isc|zlib|artistic|unlicense|0bsd|python|bsl|eupl)(?:-[a-z0-9.]+)*\+?\Z|licenseref-[a-z0-9.-]+\Z")

#: Bytes that end words become spaces, A-Z becomes a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_PART = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> tuple[list[str], bool]:
    """Read a license expression from the start of `text`: postfix items, and whether it is complete.

    Reading ends at the end of the line, at what can't follow, or at an unmatched parenthesis. `with` binds more than
    `and`, that more than `or`; parentheses group. An operator that lacks its right side makes it incomplete.
    """
    out: list[str] = []
    stack: list[str] = []
    line, at, want = text.split("\n", 1)[0], 0, True
    while found := _PART.match(line, at):
        item = found[1]
        low = item.lower()
        if want:
            if item == "(":
                stack.append(item)
            elif item == ")" or low in _RANK:
                break
            else:
                out.append(low.rstrip(".-"))
                want = False
        elif low in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            want = True
        elif item == ")" and "(" in stack:
            while (top := stack.pop()) != "(":
                out.append(top)
        else:
            break
        at = found.end()
    whole = not want and "(" not in stack
    if want and stack and stack[-1] in _RANK:
        stack.pop()
    out += [x for x in reversed(stack) if x != "("]
    return out, whole


def evaluate(postfix: list[str]) -> list[frozenset[str]]:
    """The alternatives of an expression: for `or` each side's, for `and` the unions, for `with` the license with its exception.

    Nested expressions may have exponentially many; decide() tells without listing them what all or one of them need.
    """
    stack: list[list[frozenset[str]]] = []
    for item in postfix:
        if item not in _RANK:
            stack.append([frozenset([item])])
            continue
        if len(stack) < 2:
            break
        right, left = stack.pop(), stack.pop()
        if item == "or":
            stack.append(list(dict.fromkeys(left + right)))
        elif item == "and":
            stack.append(list(dict.fromkeys(a | b for a in left for b in right)))
        else:
            exception = "+".join(sorted(frozenset().union(*right)))
            stack.append([frozenset(f"{x}-with-{exception}" for x in a) for a in left])
    return stack[-1] if stack else []


def decide(postfix: list[str]) -> tuple[frozenset[str], frozenset[str]]:
    """All identifiers of an expression's alternatives, and those that each alternative has.

    An identifier is in each alternative if the expression fails when it alone is left out. Each part has the set of
    those that it fails without: both sides' for `and`, common ones for `or`. The smaller set goes into the larger, so
    n identifiers take n log n steps and room for n.
    """
    names: list[str] = []
    steps: list[tuple[str, int, int]] = []  # names, and operators on two steps
    stack: list[tuple[int, int, int]] = []  # a step, its first name and the one behind its last
    for item in postfix:
        if item not in _RANK:
            steps.append(("", len(names), 0))
            stack.append((len(steps) - 1, len(names), len(names) + 1))
            names.append(item)
            continue
        if len(stack) < 2:
            break
        (right, begin, end), (left, first, _) = stack.pop(), stack.pop()
        if item == "with":  # the left side's names change, the right side's go
            exception = "+".join(sorted(set(names[begin:end])))
            names[first:] = [f"{x}-with-{exception}" for x in names[first:begin]]
            stack.append((left, first, begin))
            continue
        steps.append((item, left, right))
        stack.append((len(steps) - 1, first, end))
    if not stack:
        return frozenset(), frozenset()
    top, first, end = stack[-1]
    own = frozenset(names[first:end])
    fails: list[set[str] | None] = []
    for item, a, b in steps[: top + 1]:
        if not item:
            fails.append({names[a]} if a < len(names) else set())
            continue
        small, large = sorted((fails[a], fails[b]), key=len)
        fails[a] = fails[b] = None
        if item == "and":
            large |= small
        else:
            large = {x for x in small if x in large}
        fails.append(large)
    return own, own & fails[top]


def label_of(identifier: str) -> str | None:
    base, _, exception = identifier.partition("-with-")
    label = SPDX.get(base) or (base if _KNOWN.match(base) else None)
    return f"{label}-with-{exception}" if label and exception else label


def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrases, kind in ((NOTICES, "notice"), (BASE, "base"), ({TAG: ""}, "tag")):
        for phrase, label in phrases.items():
            out.add_word(f" {phrase} ", (kind, label, len(phrase.split()), len(phrase.encode())))
    out.make_automaton()
    return out


def scan(text: bytes, automaton) -> tuple[int, list[tuple[str, str, int, int]], float]:
    """Number of words, findings (kind, label, first word, words) and score of one text; see scan_licenses()."""
    spaced = text.translate(_TABLE)
    words = spaced.split()
    line = b" " + b" ".join(words) + b" "
    findings: list[tuple[str, str, int, int]] = []
    agreed: Counter[str] = Counter()
    pieces, broken = 0, False
    starts = None
    tags: list[tuple[int, int]] = []  # first word and words
    # one char for a byte, so that places in the line are places in bytes
    for end, (kind, label, n, size) in automaton.iter(line.decode("latin-1")):
        if starts is None:
            starts = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        word = int(np.searchsorted(starts, end - size - 1))
        if kind != "tag":
            findings.append((kind, label, word, n))
            agreed[label] += 1
            pieces += 1
            continue
        tags.append((word, n))
    if tags:
        letters = np.frombuffer(spaced, np.uint8) != 32
        begins, ends = np.flatnonzero(letters & ~np.r_[False, letters[:-1]]), np.flatnonzero(letters & ~np.r_[letters[1:], False]) + 1
        stops = [int(begins[word]) for word, _ in tags[1:]] + [len(text)]
    for (word, n), stop in zip(tags, stops if tags else (), strict=True):
        labels, required, whole = _tagged(text, int(ends[word + n - 1]), stop)
        findings += [("required" if x in required else "expression", x, word, n) for x in labels]
        agreed.update(labels)
        pieces += len(labels) - len(required) + bool(required)
        broken |= not whole
    findings.sort(key=lambda f: f[2])
    return len(words), findings, (max(agreed.values()) / pieces if pieces else 0.0) / (1 + broken)


def _tagged(text: bytes, at: int, stop: int) -> tuple[list[str], set[str], bool]:
    """Labels of the expression that follows the tag's end, those of all its alternatives, and whether all could be read.

    An expression ends before `stop`, the next tag's place, and at the end of its line. Without a colon there is no expression, and nothing to complain about.
    """
    end = text.find(b"\n", at, stop)
    rest = text[at : end if end >= 0 else stop].lstrip()
    if rest[:1] != b":":
        return [], set(), True
    postfix, whole = parse_expression(rest[1:].decode("utf-8", "replace"))
    names, needed = decide(postfix)
    labels = {x: label_of(x) for x in sorted(names)}
    return sorted(set(filter(None, labels.values()))), set(filter(None, (labels[x] for x in needed))), whole and all(labels.values())


FINDING = "kind string, label string, word long, n_words long"


def _scan(batches):
    import pyarrow as pa

    automaton = _automaton()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64())]))
    for batch in batches:
        rows = [scan(x, automaton) for x in text_bytes(batch.column(1))]
        findings = [[dict(zip(("kind", "label", "word", "n_words"), f, strict=True)) for f in r[1]] for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array(findings, kind), pa.array([r[2] for r in rows], pa.float64())], names=["id", "n_words", "findings", "score"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, findings and score for each row of `docs`.

    A finding has its kind (base, notice, required for a label that all alternatives of an expression have, expression
    for its other labels), label, first word (from 0) and number of words. Words are runs of 0-9, a-z and bytes above
    127 after lower-casing A-Z; every place of a phrase's words counts, overlapping ones too; an expression's labels
    stand at its tag. A null text counts as empty, which has no words, no findings and score 0. Texts are read whole, in
    time that grows with their length. Rows are independent, so ties, repeated rows and an empty table need no rule;
    only the two named columns are read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan, f"id long, n_words long, findings array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>, score double")


def summaries(found: DataFrame) -> DataFrame:
    """n_base, first_word and last_word of base findings, and base_labels, labels and required_labels (distinct, sorted, joined)."""
    base = F.filter("findings", lambda x: x["kind"] == "base")
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["word"])
    return found.select("id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("findings")).alias("labels"), joined(F.filter("findings", lambda x: x["kind"] == "required")).alias("required_labels"), "score")
