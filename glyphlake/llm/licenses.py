"""License scans (operator 10): a positional index of rare licence words, in DataFrame functions only.

Each template is indexed under the RARE words of its key phrase that the fewest documents hold (the highest IDF
over the whole corpus). A document looks its own index words up: each place, shifted by the word's place in
the key phrase, is a posting of where that phrase would start. The postings of a template's words are intersected,
which leaves starts at which all of them stand in their relative positions, and a start counts if the mandatory
key phrase stands there word for word. What is found doesn't depend on which words are index words; only the
work does.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Words of a key phrase that are looked up.
RARE = 3


@dataclass(frozen=True)
class Template:
    """label; words of the licence text; key: the part of them that must stand word for word."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        n = len(self.key_words)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key_words)


#: Phrases of public licences. Base templates are their key phrase.
TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("cc0", "released under cc0 1 0 universal", "cc0 1 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def words_of(text: Column) -> Column:
    """Words of a text (null: none) with A-Z in lower case: runs of digits, letters a-z and characters beyond ASCII."""
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(folded, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many rows each licence word stands; at most as many rows as the templates have words come back."""
    vocabulary = sorted({w for t in templates for w in t.key_words})
    held = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("word"))
    counted = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: counted.get(w, 0) for w in vocabulary}


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Licences in each row of docs (doc_id, text).

    Returns doc_id, n_words, n_base (places of base phrases), first_word and last_word (the smallest and
    largest start of those, else null), base_labels, labels (with the method's own) and score: the largest
    share of a found template's words that stand in their places, 0 without any. Rows are scanned alone:
    repeated rows and null ids give a row each; a null or empty text has no words; an empty table gives no
    rows; further columns don't matter. Labels are distinct and sorted, so ties need no rule.
    """
    frequency = document_frequencies(docs, templates)
    placed = []  # rarest words with their places in the key phrase, template
    for t in templates:
        order = sorted(enumerate(t.key_words), key=lambda x: (frequency[x[1]], x[1], x[0]))
        first = {w: (w, i) for i, w in reversed(order)}  # a word that stands twice is looked up at one place
        placed.append((sorted(first.values(), key=lambda x: (frequency[x[0]], x))[:RARE], t))
    index = sorted({w for rare, _ in placed for w, _ in rare})
    # only documents with the rarest word of a template are looked at word by word
    lead = F.array(*map(F.lit, sorted({rare[0][0] for rare, _ in placed})))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    words = F.col("words")
    hits = named.withColumn(
        "hits",
        F.when(
            F.arrays_overlap(words, lead),
            F.filter(F.transform(words, lambda w, i: F.when(w.isin(index), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull()),
        ).otherwise(F.array().cast("array<struct<w:string,i:int>>")),
    )

    def found(rare: list[tuple[str, int]], t: Template) -> Column:
        """Starts of the key phrase of t, each with the share of t's words in place."""
        key, all_words = F.array(*map(F.lit, t.key_words)), t.words
        postings = [F.transform(F.filter(F.col("hits"), lambda h: (h["w"] == word) & (h["i"] >= at)), lambda h: h["i"] - at) for word, at in rare]  # noqa: B023
        starts = postings[0]
        for more in postings[1:]:
            starts = F.array_intersect(starts, more)
        kept = F.filter(starts, lambda s: F.slice(words, s + 1, len(t.key_words)) == key)

        def share(s: Column) -> Column:
            agree = F.lit(0)
            for i, w in enumerate(all_words):
                place = s + (i - t.key_at)
                agree = agree + F.when((place >= 0) & (F.get(words, place) == w), 1).otherwise(0)
            return agree / len(all_words)

        return F.transform(kept, lambda s: F.struct(s.alias("at"), share(s).alias("share"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base")))

    nothing = F.array().cast("array<struct<at:int,share:double,label:string,base:boolean>>")
    places = hits.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.when(F.size("hits") > 0, F.concat(*[found(*p) for p in placed])).otherwise(nothing).alias("found"),
    )
    base = F.filter("found", lambda x: x["base"])

    def labels(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")

    return places.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["at"])).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
