"""Text cleaning and model words, as functions from Column to Column.

Patterns carry (?U) where white space and digits beyond ASCII count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Cleaner = Callable[[Column], Column]

#: Patterns of units and of model words.
INCH_MARK = r'(?U)(\d+)\s*["”]'
INCH_WORD = r"(?U)(\d+)\s*(?:inches|inch|in)\b"
HZ = r"(?U)(\d+(?:\.\d+)?)\s*hz\b"
HERTZ = r"(?U)(\d+(?:\.\d+)?)\s*hertz\b"
GLUED_UNIT = r"(?U)[\s\W]+(inch|hz)\b"
TITLE_WORD = r"[A-Za-z0-9]*((?:[0-9]+[^0-9, ]+)|(?:[^0-9, ]+[0-9]+))[A-Za-z0-9]*"
VALUE_NUMBER = r"(\d+(?:\.\d+)?)[a-zA-Z]*\z"
NUMBER = r"[-+]?\d*\.?\d+"


def _normal(text: Column) -> Column:
    """Lower case, no outer white space, units joined to their numbers. Null is the word none."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit("none"))), r"(?U)^\s+|\s+$", "")
    for pattern, unit in ((INCH_MARK, "inch"), (INCH_WORD, "inch"), (HZ, "hz"), (HERTZ, "hz")):
        t = F.regexp_replace(t, pattern, f"$1{unit} ")
    return t


def _collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_basic(text: Column) -> Column:
    """Units normalised; what stands before a unit is joined to it."""
    return _collapsed(F.regexp_replace(_normal(text), GLUED_UNIT, "$1 "))


def clean_unified(text: Column) -> Column:
    """Units normalised; `-` and `/` deleted; all else but a-z, 0-9 and white space is a blank."""
    return _collapsed(F.regexp_replace(F.translate(_normal(text), "-/", ""), r"(?U)[^a-z0-9\s]", " "))


def clean_map(features: Column, cleaner: Cleaner) -> Column:
    """Values cleaned, keys as they are; a null map is empty."""
    empty = F.create_map().cast("map<string,string>")
    return F.transform_values(F.coalesce(features, empty), lambda k, v: cleaner(v))


def title_words(text: Column) -> Column:
    """Distinct lower-cased words with a digit and something else."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("none")), F.lit(TITLE_WORD), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def value_word(value: Column) -> Column:
    """The number at the end of a value (a unit may follow); null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(value, F.lit("none")), VALUE_NUMBER, 1), F.lit(""))


def numeric_part(word: Column) -> Column:
    return F.array_join(F.regexp_extract_all(word, F.lit(NUMBER), F.lit(0)), "")


def other_part(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, NUMBER, ""), r"(?U)^\s+|\s+$", "")


def qgrams(text: Column, q: int = 3, lower: bool = False) -> Column:
    """Distinct substrings of q characters of the text, padded by q-1 `#` on both sides."""
    pad = "#" * (q - 1)
    p = F.concat(F.lit(pad), F.lower(text) if lower else text, F.lit(pad))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - (q - 1)), lambda i: F.substring(p, i, F.lit(q))))


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), total), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def title_tokens(title: Column) -> Column:
    """Distinct words between white space."""
    return F.array_distinct(F.filter(F.split(title, r"(?U)\s+"), lambda w: w != ""))


def token_cosine(a: Column, b: Column) -> Column:
    """Of the token sets of two titles; 0 if one is empty."""
    x, y = title_tokens(a), title_tokens(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.sqrt(F.size(x)) * F.sqrt(F.size(y))), F.lit(0.0))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein's distance over the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)
