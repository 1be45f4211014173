"""Differences of two record tables: by keys, and by matched pairs of columns."""

from __future__ import annotations

import itertools
from collections import Counter, deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.cells import clean, collapse, split_profile, title_key
from recordloom.functions.identifiers import doi, match_value
from recordloom.operators.profile import kinds_of


def record_key(doi_cell: Column | None, title_cell: Column | None, year_cell: Column | None = None) -> Column:
    """struct(kind, key, year): the DOI if there is one, else the title key with the year; null without either."""
    blank = F.lit("")
    by_doi = doi(doi_cell) if doi_cell is not None else blank
    by_title = title_key(title_cell) if title_cell is not None else blank
    year = clean(year_cell) if year_cell is not None else blank
    return F.when(by_doi != "", F.struct(F.lit("doi").alias("kind"), by_doi.alias("key"), blank.alias("year"))).when(by_title != "", F.struct(F.lit("title").alias("kind"), by_title.alias("key"), year.alias("year")))


def unique_keys(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Rows with their key, those left out whose key is null or occurs more than once.

    The repeated keys are found by an aggregate, which collapses a hot key before the shuffle.
    """
    keyed = df.withColumn(name, key).where(F.col(name).isNotNull())
    repeated = keyed.groupBy(name).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return keyed.join(repeated, name, "left_anti")


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key of two tables once, with where it is: both, only A or only B."""
    marked = lambda df, side: df.select(F.col(key).alias("key")).where(F.col("key").isNotNull()).distinct().withColumn(side, F.lit(True))
    both = marked(a, "in_a").join(marked(b, "in_b"), "key", "full_outer")
    return both.select("key", F.when(F.col("in_b").isNull(), "only A").when(F.col("in_a").isNull(), "only B").otherwise("both").alias("found"))


def differ(kind: str, a: Column, b: Column) -> Column:
    """Whether two cells differ: tags as sets, other kinds as text."""
    if kind == "multi_tag":
        as_set = lambda x: F.array_sort(F.array_distinct(split_profile(x)))
        return as_set(a) != as_set(b)
    return a != b


def shown(kind: str, cell: Column) -> Column:
    return F.array_join(F.array_sort(split_profile(cell)), "; ") if kind == "multi_tag" else cell


def kinds_of_both(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> list[str]:
    """The kinds of column pairs, from the cells of both tables, in one job."""
    side = lambda df, i: df.select(*(F.col(f"`{pair[i]}`").cast("string").alias(str(k)) for k, pair in enumerate(pairs)))
    kinds = kinds_of(side(a, 0).unionAll(side(b, 1)), [str(k) for k in range(len(pairs))])
    return [kinds[str(k)] for k in range(len(pairs))]


def keyed_diff(a: DataFrame, b: DataFrame, columns: list[str], doi_column: str | None, title_column: str, year_column: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    """key, title, status, field, old_value, new_value: a row for each removed and added record and each changed cell."""
    kinds = kinds or kinds_of_both(a, b, [(c, c) for c in columns])
    col = lambda name: F.col(f"`{name}`") if name else None
    side = lambda df, s: unique_keys(df.select(*{title_column: 0, **dict.fromkeys(columns), **({doi_column: 0} if doi_column else {}), **({year_column: 0} if year_column else {})}), record_key(col(doi_column), col(title_column), col(year_column))).select(
        "key", F.struct(clean(col(title_column)).alias("title"), *(clean(col(c)).alias(f"c{i}") for i, c in enumerate(columns))).alias(s)
    )
    both = side(a, "a").join(side(b, "b"), "key", "full_outer")
    item = lambda status, field, old, new: F.struct(F.lit(status).alias("status"), F.lit(field).alias("field"), old.alias("old_value"), new.alias("new_value"))
    x, y = F.col("a"), F.col("b")
    changes = F.filter(
        F.array(*(F.when(differ(k, x[f"c{i}"], y[f"c{i}"]), item("Changed", c, shown(k, x[f"c{i}"]), shown(k, y[f"c{i}"]))) for i, (c, k) in enumerate(zip(columns, kinds, strict=True)))),
        lambda z: z.isNotNull(),
    )
    rows = (
        F.when(y.isNull(), F.array(item("Removed", "(removed record)", x["title"], F.lit(""))))
        .when(x.isNull(), F.array(item("Added", "(new record)", F.lit(""), y["title"])))
        .otherwise(changes)
    )
    return both.select(F.col("key.key").alias("key"), F.coalesce(x["title"], y["title"]).alias("title"), F.inline(rows))


class _Candidates:
    """Rows of one side by their extra keys. What keys a partner leaves blank may be anything, so rows are listed for each such set of keys that is asked for."""

    def __init__(self, rows: list[tuple[int, tuple[str, ...]]]):
        self.rows, self.used = rows, set()
        self.listed: dict[tuple[int, ...], dict[tuple, deque]] = {}
        self.live: Counter = Counter()

    def best(self, own: tuple[str, ...]) -> tuple[int, int, int] | None:
        """The earliest free row that agrees on most keys, the number of those keys, and how many rows agree on as many."""
        filled = tuple(i for i, k in enumerate(own) if k)
        if filled not in self.listed:
            lists: dict[tuple, deque] = {}
            for row, keys in self.rows:
                if row not in self.used:
                    lists.setdefault(tuple(keys[i] for i in filled), deque()).append(row)
            self.listed[filled] = lists
            self.live.update({(filled, k): len(x) for k, x in lists.items()})
        lists = self.listed[filled]
        for agreed in range(len(filled), -1, -1):
            ways = [tuple(own[i] if i in kept else "" for i in filled) for kept in itertools.combinations(filled, agreed)]
            tied = sum(self.live[filled, way] for way in ways)
            if tied:
                heads = []
                for way in ways:
                    while lists.get(way) and lists[way][0] in self.used:
                        lists[way].popleft()
                    heads += list(itertools.islice(lists.get(way, ()), 1))
                return min(heads), agreed, tied
        return None

    def take(self, row: int, keys: tuple[str, ...]) -> None:
        self.used.add(row)
        for filled in self.listed:
            self.live[filled, tuple(keys[i] for i in filled)] -= 1


def _greedy(n_extra: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        left, right = (block[block.side == s].sort_values("row") for s in "ab")
        keys_of = lambda rows: [tuple(k or "" for k in keys) for keys in rows["keys"]]
        others = dict(zip(right.row.tolist(), keys_of(right), strict=True))
        candidates = _Candidates(list(others.items()))
        out = []
        for row, own in zip(left.row.tolist(), keys_of(left), strict=True):
            if found := candidates.best(own):
                other, agreed, tied = found
                candidates.take(other, others[other])
                note = f"title + {agreed} of {n_extra} extra key(s)" + (" (others empty)" if agreed < n_extra else "")
                out.append((row, other, note + (f"; {tied} identical candidates, paired in file order" if tied > 1 else "")))
        return pd.DataFrame(out, columns=["row_a", "row_b", "note"])

    return run


def match_pairs(a: DataFrame, b: DataFrame, row: str, title: tuple[str, str], extra: list[tuple[str, str]] = ()) -> DataFrame:
    """row_a, row_b, note: greedy one-to-one pairs of rows with equal title keys, in file order (`row`).

    Extra keys have to agree where both are filled; the candidate that agrees on most wins, the earliest of equals.
    A title's block falls apart by the keys that all its rows fill, since rows that differ there never pair. Where the
    rows of a part all have the same keys, the k-th row in A takes the k-th in B, which windows decide; that is the case
    for every title without blank keys. What is left, parts with blanks in some rows, is decided in order: a row's choice
    depends on those before it, so such a part is one task's. Only row numbers and keys go there, and its time grows with
    its rows, not with their pairs.
    """
    side = lambda df, i, s: df.select(F.lit(s).alias("side"), F.col(row).cast("long").alias("row"), title_key(F.col(f"`{title[i]}`")).alias("t"), F.array(*(F.coalesce(match_value(F.col(f"`{p[i]}`")), F.lit("")) for p in extra)).cast("array<string>").alias("keys")).where("t <> ''")
    both = side(a, 0, "a").unionByName(side(b, 1, "b"))
    # all sizes come from one count of equal rows, which collapses a hot title before the shuffle
    classes = both.groupBy("t", "keys").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    titles = classes.groupBy("t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), *(F.min(F.get("keys", F.lit(i)) != "").alias(f"full{i}") for i in range(len(extra)))).where("a > 0 AND b > 0").drop("a", "b")
    fulls = [f"full{i}" for i in range(len(extra))]
    part = F.array(*(F.when(F.col(full), F.get("keys", F.lit(i))).otherwise("") for i, full in enumerate(fulls))).cast("array<string>").alias("part")
    cut = lambda df: df.join(titles, "t").select("*", part).drop(*fulls)
    parts = cut(classes).groupBy("t", "part").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("n_classes")).where("a > 0 AND b > 0").select("t", "part", "b", (F.col("n_classes") == 1).alias("alike"))
    rows = cut(both).join(parts, ["t", "part"])

    ranked = rows.where("alike").withColumn("k", F.row_number().over(Window.partitionBy("t", "part", "side").orderBy("row")))
    x = ranked.where("side = 'a'").select("t", "part", "k", "keys", F.col("b").alias("n"), F.col("row").alias("row_a"))
    y = ranked.where("side = 'b'").select("t", "part", "k", F.col("row").alias("row_b"))
    agreed, tied = F.size(F.filter("keys", lambda v: v != "")), F.col("n") - F.col("k") + 1
    how = F.concat(F.lit("title + "), agreed.cast("string"), F.lit(f" of {len(extra)} extra key(s)"), F.when(agreed < len(extra), " (others empty)").otherwise("")) if extra else F.lit("title")
    note = F.concat(how, F.when(tied > 1, F.concat(F.lit("; "), tied.cast("string"), F.lit(" identical candidates, paired in file order"))).otherwise(""))
    pairs = x.join(y, ["t", "part", "k"]).select("row_a", "row_b", note.alias("note"))
    if not extra:
        return pairs
    mixed = rows.where("NOT alike").select("t", "part", "side", "row", "keys")
    return pairs.unionByName(mixed.groupBy("t", "part").applyInPandas(_greedy(len(extra)), "row_a long, row_b long, note string"))


def pair_diff(a: DataFrame, b: DataFrame, row: str, title: tuple[str, str], compare: list[tuple[str, str]], extra: list[tuple[str, str]] = (), ignore_case: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """row_a, row_b, title, status, match_note, differences and values of every record of both tables.

    status is Different, Same, Only in A, Only in B or No title; values maps a pair's label to (a, b, differs).
    """
    labels = [x if x == y else f"{x} ↔ {y}" for x, y in compare]
    kinds = kinds or kinds_of_both(a, b, compare)
    pairs = match_pairs(a, b, row, title, extra)
    side = lambda df, i, s: df.select(F.col(row).cast("long").alias(f"row_{s}"), collapse(F.col(f"`{title[i]}`")).alias(f"title_{s}"), title_key(F.col(f"`{title[i]}`")).alias(f"key_{s}"), F.array(*(collapse(F.col(f"`{p[i]}`")) for p in compare)).cast("array<string>").alias(f"values_{s}"))
    joined = side(a, 0, "a").join(pairs, "row_a", "left").join(side(b, 1, "b"), "row_b", "full_outer")
    both = F.col("row_a").isNotNull() & F.col("row_b").isNotNull()

    def changed(i: int, kind: str) -> Column:
        x, y = F.get("values_a", F.lit(i)), F.get("values_b", F.lit(i))
        if kind != "multi_tag" and ignore_case:
            x, y = title_key(x), title_key(y)
        return F.coalesce(both & differ(kind, x, y), F.lit(False))

    differs = [changed(i, k) for i, k in enumerate(kinds)]
    value = lambda s, i: F.coalesce(F.get(f"values_{s}", F.lit(i)), F.lit(""))
    values = F.map_from_arrays(F.array(*map(F.lit, labels)), F.array(*(F.struct(value("a", i).alias("a"), value("b", i).alias("b"), d.alias("differs")) for i, d in enumerate(differs))))
    differences = F.filter(F.array(*(F.when(d, F.lit(label)) for d, label in zip(differs, labels, strict=True))), lambda x: x.isNotNull())
    key = F.coalesce("key_a", "key_b")
    status = F.when(both, F.when(F.size(differences) > 0, "Different").otherwise("Same")).when(key == "", "No title").when(F.col("row_b").isNull(), "Only in A").otherwise("Only in B")
    note = F.when(both, F.col("note")).when(key != "", "").when(F.col("row_b").isNull(), "no title in file A").otherwise("no title in file B")
    return joined.select("row_a", "row_b", F.coalesce(F.nullif("title_a", F.lit("")), "title_b", F.lit("")).alias("title"), status.alias("status"), note.alias("match_note"), differences.alias("differences"), values.alias("values"))


def flat_diff(diff: DataFrame, labels: list[str]) -> DataFrame:
    """The wide export of pair_diff(): each pair's values and whether they differ; row numbers count a header line."""
    cells = [F.col("values")[label][part].alias(f"{label} {name}") for label in labels for part, name in (("a", "[A]"), ("b", "[B]"), ("differs", "differs"))]
    return diff.select("status", (F.col("row_a") + 2).alias("Row A"), (F.col("row_b") + 2).alias("Row B"), "title", "match_note", F.array_join("differences", "; ").alias("differences"), *cells)
