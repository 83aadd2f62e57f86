"""Scalar functions against literal values."""

import math

import pytest
from pyspark.sql import functions as F

from glyphlake.functions import dates, numbers, roles, similarity, text
from glyphlake.functions.geometry import apply_matrix, fit_size, fold_angle, matrix_inverse, matrix_product


def values(spark, inputs, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize_text(spark):
    given = ["أحمد", "آمنة", "النـــور", "سكر, 1كغ.", "  A4  Paper ", None, "ﬁne", "STRASSE ß", "٢٠٢٦"]
    assert values(spark, given, text.normalize_text) == ["احمد", "امنه", "النور", "سكر 1كغ", "a4 paper", "", "fine", "strasse ss", "2026"]


def test_digits_and_lookalikes(spark):
    assert values(spark, ["O", "o", "V", "v", "A", "B", None], text.fold_lookalikes) == ["5", "5", "7", "7", "8", "B", ""]
    assert values(spark, ["٥-١-٧,٦,٥", "12.5", "x"], text.digit_sequence) == ["51765", "125", ""]


def test_quantity(spark):
    assert values(spark, ["٢.٠", "٢،٠", "2.0", "2,0", "عدد 7", "قطعة", "", None], numbers.quantity) == [20, 20, 20, 20, 7, None, None, None]


def test_price(spark):
    given = ["1,234.50", "1.234,50", "1.234.500", "517,65", "SAR 12.50", "12 ر.س", "none", "-3.5"]
    assert values(spark, given, numbers.price) == [1234.5, 1234.5, 1234500.0, 517.65, 12.5, 12.0, None, -3.5]


def test_strict_number(spark):
    assert values(spark, ["2.50", "سكر 1كغ", "A4 Paper", "", "1e3", "12d", " 7 ", "2\n3"], numbers.strict) == [2.5, None, None, None, None, None, 7.0, None]


def test_dates(spark):
    given = ["03/04/2026", "03/14/2026", "14/03/26", "31/02/2026", "١٤/٠٣/٢٠٢٦", "2026-8-15", "29/02/2023", "", None]
    shown = values(spark, given, lambda c: dates.format_date(dates.parse_date(c)))
    assert shown == ["2026-04-03", "2026-03-14", "2026-03-14", None, "2026-03-14", "2026-08-15", "2020-02-29", None, None]


def test_labels_and_tokens(spark):
    assert values(spark, ["المدينة : دمشق", "City:", "none", ": x"], text.strip_label) == ["دمشق", "", "none", "x"]
    assert values(spark, ["INV-2291", "no 00008 x", "a1", "ab12"], text.invoice_number) == ["INV-2291", "00008", None, "ab12"]
    assert values(spark, ["نور", "abc", "نور abcd", "12"], text.direction) == ["rtl", "ltr", "ltr", "ltr"]


def test_ngrams_and_take_while(spark):
    assert values(spark, [["a", "b", "c"], [], ["x"]], text.ngrams, "array<string>") == [["a b c", "a b", "b c", "a", "b", "c"], [], ["x"]]
    run = lambda c: text.take_while(c, F.lit("city"), ["date"])
    assert values(spark, [["city", "new", "york", "date", "1"], ["old", "town", "city"], ["date", "rome", "city", "date"], ["x"]], run, "array<string>") == ["new york", "old town", "rome", None]


def test_similarity(spark):
    rows = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("x", ""), ("نور", "نوز")], "a string, b string")
    got = [r[0] for r in rows.select(similarity.levenshtein_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([4 / 7, 1.0, 0.0, 2 / 3])
    sets = spark.createDataFrame([(["a", "b"], ["b", "a"]), (["aa", "bb"], ["aa", "bb", "cc", "dd"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in sets.select(similarity.word_set_similarity(F.col("a"), F.col("b"))).collect()] == pytest.approx([1.0, 0.5, 0.0])


def test_matrices_and_angles(spark):
    rows = spark.createDataFrame([([2.0, 0.0, 3.0, 0.0, 4.0, 5.0, 0.0, 0.0, 1.0],)], "m array<double>")
    m = F.col("m")
    whole = rows.select(matrix_product(m, matrix_inverse(m)).alias("i"), apply_matrix(m, F.lit(1.0), F.lit(1.0)).alias("p")).first()
    assert whole["i"] == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 1]) and tuple(whole["p"]) == (5.0, 9.0)
    assert values(spark, [0.0, 45.0, -45.0, 89.0, 135.0], fold_angle, "double") == [0.0, 45.0, 45.0, -1.0, 45.0]
    assert values(spark, [1, 64, 65, 2000], fit_size, "int") == [64, 64, 128, 768]
    assert not math.isnan(1.0)


def test_roles(spark):
    assert values(spark, ["quantity", "city", "nothing", None], roles.content_kind) == ["number", "arabic_text", "any", "any"]
    assert values(spark, ["quantity", "city", "label"], roles.zone) == ["table", "header", "unknown"]
