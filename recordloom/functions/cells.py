"""Column expressions for cells: blanks, multi-valued cells, numbers, titles, people, tags."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Patterns that tell a bibliographic type's family, tested in this order.
_TYPE_RULES = (
    ("chapter", "chapter|section|component|^chap$"),
    ("article", "article|journal|^jour$"),
    ("conference", "conference|proceeding|^cpaper$|^conf$"),
    ("book", "book|monograph"),
    ("thesis", "thesis|dissertation"),
    ("dataset", "dataset"),
    ("report", "report|^rprt$"),
)


def clean(cell: Column) -> Column:
    """Trimmed text of a cell; null is blank. White space is Unicode's."""
    return F.regexp_replace(F.coalesce(cell.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def fold(text: Column) -> Column:
    """Lower case with ß as ss and final sigma as sigma, as full case folding has them."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def blank_to_null(cell: Column) -> Column:
    return F.nullif(clean(cell), F.lit(""))


def first_filled(*cells: Column) -> Column:
    """The first cell that isn't blank, else blank."""
    return F.coalesce(*map(blank_to_null, cells), F.lit(""))


def collapse(cell: Column) -> Column:
    """White space runs become one space; whole numbers lose their `.0`."""
    return F.regexp_replace(F.regexp_replace(clean(cell), r"(?U)\s+", " "), r"^(-?\d+)\.0+$", "$1")


def number(cell: Column) -> Column:
    """A cell's number, null if it isn't one (`nan`, `12d` and the like aren't)."""
    text = clean(cell)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), clean), lambda x: x != "")


def split_profile(cell: Column) -> Column:
    """Parts by `;` if there is one, else by `,`."""
    text = clean(cell)
    return F.when(F.contains(text, F.lit(";")), _parts(text, ";")).otherwise(_parts(text, ","))


def split_auto(cell: Column, delimiter: str | None = None) -> Column:
    """Parts by the delimiter; without one by `;`, else by line, else by `,`."""
    text = clean(cell)
    if delimiter:
        return _parts(text, "\\Q" + delimiter + "\\E")
    return F.when(F.contains(text, F.lit(";")), _parts(text, ";")).when(F.contains(text, F.lit("\n")), _parts(text, "\n")).otherwise(_parts(text, ","))


def split_items(cell: Column) -> Column:
    """Parts by `;` or line, never by comma."""
    return _parts(clean(cell), "[;\n]")


def split_any(cell: Column) -> Column:
    """Parts by `;`, line or comma."""
    return _parts(clean(cell), "[;\n,]")


def split_joined(cell: Column) -> Column:
    """Distinct parts by the literal `; `."""
    return F.array_distinct(F.filter(F.split(clean(cell), "; "), lambda x: x != ""))


def split_ordered(cell: Column) -> Column:
    """Trimmed parts by `;`, in order, repeats kept."""
    return _parts(clean(cell), ";")


def append_missing(target: Column, source: Column) -> Column:
    """The target's items and those of the source's that it lacks, joined by `; `; repeats in the source are kept."""
    own, other = split_items(target), split_items(source)
    added = F.filter(other, lambda x: ~F.array_contains(own, x))
    return F.when(F.size(added) > 0, F.array_join(F.concat(own, added), "; ")).otherwise(F.coalesce(target.cast("string"), F.lit("")))


def merge_tags(cell: Column, tags: Column) -> Column:
    """A tag cell with new tags behind those it has."""
    own = split_any(cell)
    return F.array_join(F.concat(own, F.filter(F.array_distinct(tags), lambda x: ~F.array_contains(own, x))), "; ")


def is_uppercase(tag: Column) -> Column:
    """All letters are capitals and there is one; digits alone aren't."""
    return (tag == F.upper(tag)) & (tag != F.lower(tag))


def names_country(tag: Column, names: tuple[str, ...], codes: tuple[str, ...] = ()) -> Column:
    """Whether a tag has a country's name as whole words in any case, or one of its codes as it is written."""
    any_of = lambda words, flags: tag.rlike(rf"(?{flags}U)(?<!\w)(?:{'|'.join(re.escape(w) for w in sorted(words, key=len, reverse=True))})(?!\w)") if words else F.lit(False)
    return any_of(names, "i") | (any_of(codes, "") if codes else F.lit(False))


def replace_tags(cell: Column, mine: Callable[[Column], Column], tags: Column) -> Column:
    """A tag cell whose tags of one kind (`mine`) are replaced by others; the rest stay in their order."""
    rest = F.filter(split_any(cell), lambda x: ~mine(x))
    return F.array_join(F.concat(rest, F.filter(F.array_distinct(tags), lambda x: ~F.array_contains(rest, x))), "; ")


def country_tags(countries: Column, prefix: str = "DATA - ") -> Column:
    return F.transform(countries, lambda c: F.concat(F.lit(prefix), c))


def non_blank_places(cells: Column) -> Column:
    """Places of the filled cells of an array."""
    return F.filter(F.transform(cells, lambda c, i: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", i)), lambda i: i.isNotNull())


#: Languages by their primary subtag.
LANGUAGES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "pl": "Polish", "sv": "Swedish", "da": "Danish", "fi": "Finnish", "cs": "Czech", "ru": "Russian", "ja": "Japanese", "zh": "Chinese", "ko": "Korean"}


def language_code(cell: Column) -> Column:
    """The primary subtag of a language tag, folded."""
    return F.lower(F.regexp_extract(clean(cell), "^([A-Za-z]*)", 1))


def language_label(cell: Column) -> Column:
    """A language's name by its code; the code itself if it isn't known."""
    code = language_code(cell)
    return F.coalesce(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))[code], code)


def keep_tags(tags: Column, *rules) -> tuple[Column, Column]:
    """The tags that pass any of the rules (functions of a tag), and the others."""
    passes = lambda x: reduce(lambda a, b: a | b, [rule(x) for rule in rules])
    return F.filter(tags, passes), F.filter(tags, lambda x: ~passes(x))


def title_key(cell: Column) -> Column:
    """a-z and 0-9 of the folded title, other runs as one space."""
    return F.trim(F.regexp_replace(fold(clean(cell)), "[^a-z0-9]+", " "))


def clean_title(cell: Column) -> Column:
    """Without bracketed additions, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(clean(cell), r"\[[^\]]*\]", ""), r"(?U)\s+", " "))


def surnames(cell: Column) -> Column:
    """What stands before the comma in each `;` part."""
    return F.filter(F.transform(F.split(clean(cell), ";"), lambda x: clean(F.get(F.split(x, ","), F.lit(0)))), lambda x: x != "")


def first_surname(cell: Column) -> Column:
    return F.coalesce(F.get(surnames(cell), F.lit(0)), F.lit(""))


def title_variants(cell: Column) -> Column:
    """The title, and its parallel titles by `;` if there are several of four words or more each."""
    text = clean(cell)
    parts = _parts(text, ";")
    several = (F.size(parts) >= 2) & F.forall(parts, lambda p: F.size(F.split(p, r"(?U)\s+")) >= 4)
    return F.array_distinct(F.when(several, F.concat(F.array(text), parts)).otherwise(F.array(text)))


def item_family(cell: Column) -> Column:
    """A free-text type's family; the first rule of _TYPE_RULES wins, blank if none does."""
    text = F.replace(fold(clean(cell)), F.lit("_"), F.lit("-"))
    rule, *rules = _TYPE_RULES
    out = F.when(text.rlike(rule[1]), rule[0])
    for family, pattern in rules:
        out = out.when(text.rlike(pattern), family)
    return out.otherwise("")


def first_year(cell: Column) -> Column:
    """The first year from 1800 to 2199 as a number."""
    return F.nullif(F.regexp_extract(F.coalesce(cell.cast("string"), F.lit("")), r"\b(?:18|19|20|21)\d{2}\b", 0), F.lit("")).try_cast("int")


def year_distance(target: Column, years: Column) -> Column:
    """The smallest distance of a year to those of an array; null without any."""
    return F.array_min(F.transform(F.filter(years, lambda y: y.isNotNull()), lambda y: F.abs(target - y)))


def language_is_english(text: Column, words: tuple[str, ...], least: float = 0.12) -> Column:
    """Whether at least that share of the words is in a stop-word list."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    hits = F.size(F.filter(found, lambda w: w.isin(*words)))
    return F.coalesce(F.try_divide(hits, F.size(found)) >= least, F.lit(False))


#: Frequent words of languages.
STOP_WORDS = {
    "en": "the of and to in is that for it with as was on are be this by an".split(),
    "de": "der die und das den von zu mit ist des im nicht eine als auch sich dem ein für".split(),
    "fr": "le la les de des et en un une du que est pour dans par sur au qui pas".split(),
    "es": "el la los las de y que en un una por con para del se no al lo como".split(),
    "it": "il la di che e un una in per con non sono del della le si da al dei".split(),
    "pt": "o a os as de e que em um uma para com não do da por se no na".split(),
    "nl": "de het een en van in is dat op te zijn voor met niet aan er om ook".split(),
    "sv": "och att det i en som på är av för den till med inte om ett har de".split(),
}


def language_of(text: Column, words: dict[str, list[str]] | None = None, least: float = 0.08) -> Column:
    """The language with the largest share of stop words among a text's words, if that is at least `least`; the first of equals, else null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    share = lambda stops: F.size(F.filter(found, lambda w: w.isin(*stops))) / F.size(found)
    options = F.array(*(F.struct((-share(stops)).alias("s"), F.lit(i).alias("i"), F.lit(code).alias("code")) for i, (code, stops) in enumerate((words or STOP_WORDS).items())))
    return F.when(F.size(found) > 0, F.get(F.transform(F.filter(F.array(F.array_min(options)), lambda x: -x["s"] >= least), lambda x: x["code"]), 0))
