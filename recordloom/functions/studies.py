"""Archive numbers, dataset DOIs and survey years in texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The years that count as a survey's, and the dataset DOIs' beginning.
YEAR = r"(?:19[89]\d|20[0-2]\d)"
DATASET_DOI = "10.4232/1."


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def archive_numbers(text: Column, prefix: str = "ZA") -> Column:
    """The distinct archive numbers (3 to 5 digits behind the prefix) in ascending order; a null text has none."""
    found = _all(text, rf"(?i)\b{re.escape(prefix)}[\s-]?\d{{3,5}}\b")
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_extract(x, r"\d+$", 0).cast("int"))))


def dataset_dois(text: Column, beginning: str = DATASET_DOI) -> Column:
    """The distinct dataset DOIs, lower case and sorted."""
    return F.array_sort(F.array_distinct(F.transform(_all(text, rf"(?i){re.escape(beginning)}\d+"), F.lower)))


def survey_years(text: Column, survey: str) -> Column:
    """The distinct years within 15 characters before or after a survey's name, without digits between; ascending."""
    name = rf"\b{re.escape(survey)}\b"
    found = _all(text, rf"(?i){name}[^0-9]{{0,15}}{YEAR}|{YEAR}[^0-9]{{0,15}}{name}")
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_extract(F.regexp_replace(x, f"(?i){name}", ""), YEAR, 0).cast("int"))))
