"""Text canonicalisation: digits, letters, words, labels, direction.

Java's regular expressions see ASCII only unless told otherwise, hence (?U). NFKC and case folding have no Spark
function; they run in an Arrow UDF that gets null for ASCII rows, which need neither.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .expr import let

# Decimal digits of two scripts, look-alike letters, letter forms, punctuation.
ARABIC_INDIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
EXTENDED_ARABIC_INDIC_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
LOOKALIKES = ("OoVvA", "55778")
LETTER_FORMS = ("أإآٱىة", "اااايه")
DIACRITICS = "[\\u064B-\\u0652\\u0640]"
PUNCTUATION = "[.,;:!؟?،؛(){}\\[\\]<>\"'`«»/\\\\|_\\-+*=&^%#@~$]"
LABEL_MARKS = (":", "：", "؛")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None else x.casefold())


def is_ascii(text: Column) -> Column:
    return ~text.rlike("[^\\x00-\\x7F]")


def nfkc(text: Column, unicode: bool = True) -> Column:
    """NFKC; with unicode=False the caller vouches for ASCII, and no Python runs."""
    return F.coalesce(_nfkc(F.when(~is_ascii(text), text)), text) if unicode else text


def casefold(text: Column, unicode: bool = True) -> Column:
    return F.coalesce(_casefold(F.when(~is_ascii(text), text)), F.lower(text)) if unicode else F.lower(text)


def fold_digits(text: Column) -> Column:
    """Arabic-Indic and extended Arabic-Indic digits to ASCII."""
    return F.translate(text, ARABIC_INDIC_DIGITS + EXTENDED_ARABIC_INDIC_DIGITS, "0123456789" * 2)


def fold_lookalikes(text: Column) -> Column:
    """letters that stand for digits in readings."""
    return F.translate(F.coalesce(text, F.lit("")), *LOOKALIKES)


def digit_sequence(text: Column) -> Column:
    """every digit in order and nothing else."""
    return F.regexp_replace(fold_lookalikes(fold_digits(text)), "(?U)\\D", "")


def normalize_text(text: Column, unicode: bool = True) -> Column:
    """the form that comparisons use; null gives an empty text."""
    folded = fold_digits(nfkc(F.coalesce(text, F.lit("")), unicode))
    letters = F.translate(F.regexp_replace(folded, DIACRITICS, ""), *LETTER_FORMS)
    spaced = F.regexp_replace(F.regexp_replace(letters, PUNCTUATION, " "), "(?U)\\s+", " ")
    return casefold(F.trim(spaced), unicode)


def words(normalized: Column) -> Column:
    """words of a normalized text."""
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def strip_label(text: Column) -> Column:
    """what follows the first kind of label mark that occurs; the tail if it isn't blank, else nothing."""
    out = text
    for mark in reversed(LABEL_MARKS):
        at = F.instr(text, mark)
        after = F.regexp_replace(F.substr(text, at + 1), "(?U)^\\s+|\\s+$", "")
        before = F.regexp_replace(F.substr(text, F.lit(1), at - 1), "(?U)^\\s+|\\s+$", "")
        out = F.when(at > 0, F.when(after != "", after).when(before != "", F.lit("")).otherwise(text)).otherwise(out)
    return out


def direction(text: Column) -> Column:
    """rtl if Arabic letters are as many as Latin ones or more, ltr without either."""
    arabic = F.regexp_count(text, F.lit("[\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF]"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when((arabic + latin > 0) & (arabic >= latin), "rtl").otherwise("ltr")


def invoice_number(text: Column) -> Column:
    """the first token of two or more letters and two or more digits, or of three or more digits; null without one."""
    found = F.regexp_extract(text, "(?U)\\b([A-Za-z]{2,}[-/]?\\d{2,}|\\d{3,})\\b", 1)
    return F.nullif(found, F.lit(""))


def has_hint(normalized: Column, hints: tuple[str, ...]) -> Column:
    """Any hint is part of the text."""
    found = F.lit(False)
    for hint in hints:
        found = found | F.contains(normalized, F.lit(hint))
    return found


def count_hints(normalized: Column, hints: tuple[str, ...]) -> Column:
    """How many of the hints are part of the text."""
    n = F.lit(0)
    for hint in hints:
        n = n + F.when(F.contains(normalized, F.lit(hint)), 1).otherwise(0)
    return n


def ngrams(tokens: Column, most: int = 6) -> Column:
    """Runs of consecutive words of at most `most`, longest first, then from left to right."""
    n = F.least(F.size(tokens), F.lit(most))

    def of_size(size: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(tokens) - size + 1)
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, size), " "))

    return F.when(F.size(tokens) > 0, F.flatten(F.transform(F.sequence(n, F.lit(1), F.lit(-1)), of_size))).otherwise(F.array().cast("array<string>"))


def take_while(tokens: Column, label: Column, stops: list[str]) -> Column:
    """Words after a label word up to the next stop word; if none, those before it, nearest first."""
    stop = F.array(*map(F.lit, stops))

    def until(run: Column) -> Column:
        return let(run, lambda r: let(F.array_min(F.filter(F.transform(r, lambda w, i: F.when(F.array_contains(stop, w), i)), lambda i: i.isNotNull())), lambda end: F.when(end.isNull(), r).otherwise(F.slice(r, F.lit(1), end))))

    at = F.array_position(tokens, label).cast("int")
    after = until(F.slice(tokens, at + 1, F.greatest(F.size(tokens) - at, F.lit(0))))
    before = until(F.reverse(F.slice(tokens, F.lit(1), F.greatest(at - 1, F.lit(0)))))
    joined = F.coalesce(F.nullif(F.array_join(after, " "), F.lit("")), F.array_join(F.reverse(before), " "))
    return F.when(at > 0, joined)
