"""Licence notices: fixed phrases, and text blocks that hold a known notice.

A notice is found where a text block, any run of consecutive words that is ``SLACK`` words
longer than the notice, holds at least ``CONTAINMENT`` of its distinct words. Line ends do not
matter, and words scattered over a long line are no notice. Texts are cut into overlapping
windows of words, so that each block lies whole in one of them, and the join of windows and
notices is exact. All words of the notices are put in one order, the rarest in the corpus
first. Of a notice with n words of which m must be met, one of its first n - m + 1 must stand
in the window, so only these are looked up. A window with fewer than m of the notices' words
is no match (length), nor is one where the words after the first shared one cannot make up m
(position). Of what is left the blocks are counted by the places of the notice's words.

Everything runs on Spark's own functions. Results hang on the text alone, so blocks carry a
digest of it; exact copies share their work, and copies without a notice carry nothing.

Rules: a null text counts as empty (no words, no labels, score 0); repeated rows get equal
results; only A-Z are lower-cased; words end at ASCII characters that are neither letter nor
digit. Columns named like the results, in whatever case, are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.llm.batches import quoted
from colonnade.scratch import written

CONTAINMENT = 0.9
#: Words a block may hold beyond the notice's own.
SLACK = 4
#: Words from the start of one window to the next.
STEP = 64
# Phrases with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Openings of well-known public notices with labels, in lower case.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
}

_IN = r"[0-9A-Za-z\x80-\x{10FFFF}]"  # before lower-casing; the complement of _OUT, which Java matches slower as such
_OUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _place(phrase: str) -> str:
    """A pattern that matches at each place of a phrase, and takes its first word only."""
    first, *rest = phrase.split(" ")
    return rf"{first}(?={''.join(f'{_OUT}+{word}' for word in rest)}(?!{_IN}))"


ANY_PLACE = rf"(?i)(?<!{_IN})(?:{'|'.join(map(_place, PHRASES))})"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case. Other letters may change too, which no notice can tell, but for
    the two whose small form is ASCII."""
    return F.lower(F.translate(text, "Kİ", "éé"))


def phrase_columns(text: Column) -> dict[str, Column]:
    """Words of a text, and the places of ``PHRASES`` in it (words are counted from 0)."""

    def words(part: Column) -> Column:
        return F.regexp_count(part, F.lit(f"{_IN}+")).cast("long")

    present = text.rlike(ANY_PLACE)
    before_first = F.regexp_extract(text, f"(?s)^(.*?){ANY_PLACE}", 1)  # places would count UTF-16 units
    before_last = F.regexp_extract(text, f"(?s)^(.*){ANY_PLACE}", 1)
    labels = [
        F.when(text.rlike(rf"(?i)(?<!{_IN}){_place(phrase)}"), F.lit(label))
        for phrase, label in sorted(PHRASES.items(), key=lambda p: p[1])
    ]
    return {
        "n_words": words(text),
        "n_base": F.when(present, F.regexp_count(text, F.lit(ANY_PLACE))).otherwise(0).cast("long"),
        "first_word": F.when(present, words(before_first)),
        "last_word": F.when(present, words(before_last)),
        "base_list": F.when(present, F.array_compact(F.array(*labels))).otherwise(F.array().cast("array<string>")),
    }


def _literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def span(notice: str) -> int:
    """Words in a text block of a notice."""
    return len(notice.split(" ")) + SLACK


def notice_windows(texts: DataFrame) -> DataFrame:
    """(digest, hits, tokens) of each window: the notices' words in it with their places, and
    the distinct ones. ``texts``: digest, text. Windows with too few of them for any notice
    are left out."""
    vocabulary = sorted({w for notice in NOTICES for w in notice.split(" ")})
    least = min(needed(len(set(n.split(" ")))) for n in NOTICES)
    length = STEP + max(map(span, NOTICES)) - 1
    # generators keep what follows from working out their columns once more
    words = F.explode_outer(F.array(F.split(lower_ascii(F.col("text")), f"{_OUT}+"))).alias("words")

    def hits_from(start: Column) -> Column:
        every = F.transform(
            F.slice("words", start, length), lambda w, at: F.struct(w.alias("word"), at.cast("short").alias("at"))
        )
        return F.filter(every, lambda h: h["word"].isin(vocabulary))

    starts = F.sequence(F.lit(1), F.size("words"), F.lit(STEP))
    windows = texts.select("digest", words).select(
        "digest", F.explode_outer(F.transform(starts, hits_from)).alias("hits")
    )
    tokens = F.array_distinct("hits.word")
    return windows.select("digest", "hits", tokens.alias("tokens")).where(F.size("tokens") >= least)


def needed(words: int) -> int:
    return math.ceil(CONTAINMENT * words - 1e-9)


def contained_notices(windows: DataFrame) -> DataFrame:
    """(digest, label, containment) of every window and notice where a block reaches the
    threshold, with the best block's. ``windows`` is read twice: for the words' frequencies
    and for the join."""
    spark = windows.sparkSession
    counts = windows.select(F.explode("tokens").alias("token")).groupBy("token").count()
    seen = {r["token"]: r["count"] for r in counts.collect()}  # at most the notices' words
    vocabulary = {w for notice in NOTICES for w in notice.split(" ")}
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index, prefixes = [], set()
    for notice, label in NOTICES.items():
        words = sorted(set(notice.split(" ")), key=rank.__getitem__)
        m = needed(len(words))
        for place, word in enumerate(words[: len(words) - m + 1]):
            prefixes.add(word)
            index.append(
                F.struct(
                    F.lit(word).alias("token"), F.lit(label).alias("label"), _literal(words).alias("words"),
                    F.lit(place).alias("place"), F.lit(m).alias("m"), F.lit(span(notice)).alias("span"),
                )
            )
    index = spark.range(1).select(F.inline(F.array(*index)))
    ordered = windows.select("digest", "hits", F.array_intersect(_literal(order), F.col("tokens")).alias("tokens"))
    probes = ordered.where(F.arrays_overlap("tokens", _literal(sorted(prefixes)))).select(
        "digest", "hits", "tokens", F.posexplode("tokens").alias("at", "token")
    )
    pairs = probes.where(F.col("token").isin(sorted(prefixes))).join(F.broadcast(index), "token")
    reach = 1 + F.least(F.size("words") - F.col("place") - 1, F.size("tokens") - F.col("at") - 1)
    pairs = pairs.where((F.size("tokens") >= F.col("m")) & (reach >= F.col("m")))
    pairs = pairs.where(F.size(F.array_intersect("tokens", "words")) >= F.col("m"))
    own = pairs.withColumn("own", F.filter("hits", lambda h: F.array_contains("words", h["word"])))

    def met(first: Column) -> Column:
        """Distinct words of the notice in the block that begins with one of them."""
        inside = F.filter("own", lambda h: h["at"].between(first["at"], first["at"] + F.col("span") - 1))
        return F.size(F.array_distinct(F.transform(inside, lambda h: h["word"])))

    best = own.select("digest", "label", "m", "words", F.array_max(F.transform("own", met)).alias("shared"))
    containment = (F.col("shared") / F.size("words")).alias("containment")
    return best.where(F.col("shared") >= F.col("m")).select("digest", "label", containment)


def license_scan(frame: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The frame with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels`` and ``score``, the greatest containment found (1 for a phrase, 0 for none)."""
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kept = [c for c in (frame.columns if keep is None else keep) if c.lower() not in made]
    given = [frame[quoted(c)].alias(f"c{i}") for i, c in enumerate(kept)]
    texts = frame.select(*given, F.coalesce(frame[quoted(text)], F.lit("")).alias("text"))
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    windows = written(notice_windows(texts.select(digest.alias("digest"), "text")))
    found = written(
        contained_notices(windows).groupBy("digest").agg(
            F.collect_set("label").alias("found"), F.max("containment").alias("containment")
        )
    )  # at most as many labels as there are
    own = [f"c{i}" for i in range(len(kept))]
    phrases = [c.alias(n) for n, c in phrase_columns(F.col("text")).items()]
    both = texts.select(*own, digest.alias("digest"), *phrases).join(found, "digest", "left")
    labels = F.array_distinct(F.concat("base_list", F.coalesce("found", F.array().cast("array<string>"))))
    return both.select(
        *own,
        *made[:4],
        F.array_join("base_list", ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    ).toDF(*kept, *made)
