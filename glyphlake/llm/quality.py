"""Quality rules (operator 9): a table of thresholds compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which
der die das und in zu den mit von für auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
le la les de des du et en un une est que qui dans pour par sur pas au aux avec ce se il elle ne sont plus
el los las del y por con para su al lo como más o pero sus una se no si sobre este ya entre cuando todo esta
""".split()


@dataclass(frozen=True)
class Rule:
    """Keeps a document where least <= measure <= most (None: no bound)."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Measures are columns of `measures`; the bounds leave room around ordinary prose.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 30.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("marks", "marks_per_word", None, 0.1),
    Rule("stop_words", "stop_word_share", 0.02, None),
    Rule("repeated_lines", "dup_line_share", None, 0.5),
    Rule("bullets", "bullet_line_share", None, 0.9),
    Rule("cut_lines", "cut_line_share", None, 0.3),
)

#: White space, signs that lists begin with, and what a line that was cut off ends with.
_SPACE = " \t\n\x0b\x0c\r"
BULLETS = ("-", "*", "\u2022", "\u25cf", "\u25aa", "\u2023")
CUT_OFF = ("...", "\u2026")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def m(name: str) -> Column:
    """A measure that `measures` adds."""
    return F.col(f"_m_{name}")


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text.

    Windows are sorted by (hash, place); one that equals a neighbour is repeated. The places of those, in
    order, cover min(3, distance to the next) words each.
    """
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        size = F.size(s)
        near = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < size - 1) & (F.get(s, k + 1)["h"] == x["h"])))
        return F.sort_array(F.transform(near, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        ends = F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum")), lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(3), i - a["last"])).alias("sum")))
        return ends["sum"]

    # transform over one-element arrays binds each step once, so nothing is computed again for each element
    repeated = F.get(F.transform(F.transform(F.array(windows), places), covered), 0)
    return F.when(n >= 3, repeated).otherwise(0)


def measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios of RULES as columns `_m_...`.

    Words are runs of bytes other than space and U+0009-U+000D; a null text has none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # flat columns: Catalyst would inline the fields of a struct wherever they are used
    parts = docs.withColumns(
        {
            "_q_text": text,
            "_q_row": F.monotonically_increasing_id(),
            "_q_words": F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""),
            "_q_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
        }
    )
    words, lines, n = F.col("_q_words"), F.col("_q_lines"), F.size("_q_words")
    counted = parts.withColumns(
        {
            "_m_n_words": n.cast("long"),
            "_m_word_chars": F.length(F.translate("_q_text", " \t\n\x0b\x0c\r", "")).cast("long"),
            "_m_n_symbols": (F.length("_q_text") - F.length(F.translate("_q_text", "#*$%&|<>", ""))).cast("long"),
            "_m_n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "_m_n_repeat_words": _repeat_words(words, n).cast("long"),
            "_m_n_lines": F.size(lines),
            "_m_stops": F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(".,;:"))).isin(STOP_WORDS))),
            "_m_marks": F.length("_q_text") - F.length(F.translate("_q_text", "!?", "")),
            "_m_bullets": F.size(F.filter(lines, lambda x: F.substring(F.ltrim(x, F.lit(_SPACE)), 1, 1).isin(*BULLETS))),
            "_m_cuts": F.size(F.filter(lines, lambda x: F.rtrim(x, F.lit(_SPACE)).endswith(CUT_OFF[0]) | F.rtrim(x, F.lit(_SPACE)).endswith(CUT_OFF[1]))),
        }
    ).drop("_q_text", "_q_words", "_q_lines")
    return counted.withColumns(
        {
            "_m_mean_word_chars": _share(m("word_chars"), m("n_words")),
            "_m_symbols_per_word": _share(m("n_symbols"), m("n_words")),
            "_m_stop_word_share": _share(m("stops"), m("n_words")),
            "_m_marks_per_word": _share(m("marks"), m("n_words")),
            "_m_bullet_line_share": _share(m("bullets"), m("n_lines")),
            "_m_cut_line_share": _share(m("cuts"), m("n_lines")),
            "_m_dup_line_share": _share(m("n_dup_lines"), m("n_lines")),
        }
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression over the measures."""
    passed = F.lit(True)
    for rule in rules:
        measure = m(rule.measure)
        if rule.least is not None:
            passed = passed & (measure >= rule.least)
        if rule.most is not None:
            passed = passed & (measure <= rule.most)
    return passed


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated 3-word windows."""
    return (m("n_words") < 50) | (100 * m("n_repeat_words") > 50 * m("n_words"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for each row of docs (doc_id, text).

    Rows are judged alone: repeated rows and null ids give a row each; null and empty texts have no words
    and fail the base rule; an empty table gives no rows; further columns don't matter.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return measures(named).select(
        "doc_id",
        *[m(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed().alias("base_failed"),
        (~base_failed() & verdict(rules)).alias("kept"),
    )


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that `judge` keeps, with docs' own columns.

    The condition takes in a column that isn't deterministic, or Catalyst would push it below the columns
    that hold the words, and split the text again for each use of a word.
    """
    named = docs.select(F.struct("*").alias("_row"), F.col("text").alias("text"))
    kept = measures(named).where(~base_failed() & verdict(rules) & (F.col("_q_row") >= 0))
    return kept.select("_row.*")
