"""License scans: phrases, and templates found through a positional rare-token index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, small

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Fixed values: (label, mandatory key phrase, template words) of public licence notices.
TEMPLATES = (
    ("agpl", "gnu affero general public license", "licensed under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc0", "public domain dedication", "this work is made available under the creative commons cc0 1 0 universal public domain dedication"),
    ("gpl", "gnu general public license", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3.0", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "mit license", "released under the mit license"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
)

#: Template words that never are anchors: they are common in any English text.
FUNCTION_WORDS = frozenset("a and any are as for in is it not of or that the this to with you may use".split())
#: Share of a template's words that must stand at one relative position.
ALIGNED = 0.6
#: Anchors that must stand at one relative position before a template's other words are looked at.
MEETING = 2

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _GAP), "")


def _stands(words: Column, i: Column, phrase: str) -> Column:
    out = F.lit(True)
    for k, w in enumerate(phrase.split()):
        out = out & (F.get(words, i + k) == w)
    return out


def _places(words: Column, phrase: str) -> Column:
    """Starts of the phrase's words in ``words``."""
    n = len(phrase.split())
    return F.when(
        F.size(words) >= n,
        F.filter(F.sequence(F.lit(0), F.size(words) - n), lambda i: _stands(words, i, phrase)),
    ).otherwise(F.array().cast("array<int>"))


def _vocabulary() -> list[str]:
    seen = {w for _, _, t in TEMPLATES for w in t.split()} | {w for p in PHRASES for w in p.split()} | {w for _, k, _ in TEMPLATES for w in k.split()}
    return sorted(seen - FUNCTION_WORDS)


def needed(own: int) -> int:
    """So many of a template's ``own`` words must stand at one relative position."""
    return math.ceil(ALIGNED * own)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence labels of every row: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Base labels come from the places where a phrase of PHRASES stands word by word. The others come
    from an index of templates: it holds the places of each template's anchors, its words of the
    highest IDF over all rows. A file looks up the places of its own words there, and a template at
    whose relative position MEETING anchors meet is a candidate. Its label is added if at least
    ALIGNED of all its words (but FUNCTION_WORDS) stand at that position, and its mandatory key
    phrase begins within its extent, which is verified last. A mention of a licence's name is no
    notice: no template's key phrase makes up that share. A template has so many anchors that fewer
    than MEETING of them leave too few words for ALIGNED: the lookup loses no label, and labels don't
    depend on the other rows. The score is the best share of a found template, 1 with a base label,
    else 0.

    A null text is empty: no words, no labels (empty strings), null first_word and last_word.
    Repeated rows and null ids each get their row. No rows give no rows. Other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    vocabulary = F.array(*[F.lit(w) for w in _vocabulary()])
    words = F.col("words")
    none = F.array().cast("array<int>")
    has = lambda some: F.size(F.array_intersect("known", F.array(*[F.lit(w) for w in some])))
    hinted = has(["license", "cc"]) > 0
    many = F.size("known") >= MEETING
    keys = {k: sorted(set(k.split()) - FUNCTION_WORDS) for k in sorted({k for _, k, _ in TEMPLATES})}
    with Scratch(spark, "licenses") as scratch:
        facts = scratch.write(
            docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
            .select("row", "doc_id", "words", F.array_intersect("words", vocabulary).alias("known"))
            .select(
                "row",
                "doc_id",
                "known",
                F.size("words").cast("long").alias("n_words"),
                *[F.when(hinted, _places(words, p)).otherwise(none).alias(f"at_{label}") for p, label in PHRASES.items()],
                F.when(
                    many, F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains("known", F.get(words, i)))
                ).otherwise(none).alias("hit_at"),
                F.when(many, F.filter("words", lambda w: F.array_contains("known", w))).otherwise(F.array().cast("array<string>")).alias("hit_word"),
                *[F.when(has(own) == len(own), _places(words, k)).otherwise(none).alias(f"key_{n}") for n, (k, own) in enumerate(keys.items())],
            )
        )
        df = {r[0]: r[1] for r in facts.select(F.explode("known").alias("w")).groupBy("w").agg(F.count("*")).collect()}  # at most the templates' words
        about, postings = [], []
        for t, (label, key, text) in enumerate(TEMPLATES):
            own = sorted(set(text.split()) - FUNCTION_WORDS, key=lambda w: (df.get(w, 0), w))
            anchors = own[: len(own) - needed(len(own)) + MEETING]
            about.append((t, label, list(keys).index(key), len(own), len(text.split())))
            postings += [(t, w, i, w in anchors) for i, w in enumerate(text.split()) if w in own]
        index = spark.createDataFrame(postings, "template int, word string, place int, anchor boolean")
        templates = spark.createDataFrame(about, "template int, label string, key int, n_own int, extent int")
        rare = F.array(*[F.lit(w) for w in sorted({w for _, w, _, anchor in postings if anchor})])
        hits = F.explode(F.arrays_zip("hit_word", "hit_at")).alias("h")
        looked_up = (
            facts.select("row", F.array_intersect("known", rare).alias("anchors"), "hit_word", "hit_at")
            .where(F.size("anchors") >= MEETING)
            .select("row", "anchors", hits)
            .where(F.array_contains("anchors", F.col("h.hit_word")))
            .select("row", F.col("h.hit_word").alias("word"), F.col("h.hit_at").alias("at"))
        )
        at = ["row", "template", "start"]
        candidates = scratch.write(
            looked_up.join(F.broadcast(index.where("anchor")), "word")
            .groupBy("row", "template", (F.col("at") - F.col("place")).alias("start"))
            .agg(F.size(F.collect_set("word")).alias("meeting"))
            .where(F.col("meeting") >= MEETING)
            .select(at)
        )
        every = (
            facts.join(small(candidates.select("row").distinct()), "row", "left_semi")
            .select("row", hits)
            .select("row", F.col("h.hit_word").alias("word"), F.col("h.hit_at").alias("at"))
            .join(F.broadcast(index), "word")
            .select("row", "template", (F.col("at") - F.col("place")).alias("start"), "word")
        )
        aligned = (
            every.join(candidates, at)
            .groupBy(at)
            .agg(F.size(F.collect_set("word")).alias("votes"))
            .join(F.broadcast(templates), "template")
            .withColumn("share", F.col("votes") / F.col("n_own"))
            .where(F.col("share") >= ALIGNED)
        )
        stands = F.get(F.array(*[F.col(f"key_{n}") for n in range(len(keys))]), F.col("key"))
        found = (
            aligned.join(facts.select("row", *[f"key_{n}" for n in range(len(keys))]), "row")
            .where(F.exists(stands, lambda i: (i >= F.col("start")) & (i < F.col("start") + F.col("extent"))))
            .groupBy("row")
            .agg(F.array_sort(F.collect_set("label")).alias("added"), F.max("share").alias("best"))
        )
        starts = F.concat(*[F.col(f"at_{label}") for label in PHRASES.values()])
        base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label in PHRASES.values()])))
        out = facts.join(found, "row", "left").select(
            "doc_id",
            "n_words",
            F.size(starts).cast("long").alias("n_base"),
            F.array_min(starts).cast("long").alias("first_word"),
            F.array_max(starts).cast("long").alias("last_word"),
            F.array_join(base, ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union(base, F.coalesce("added", F.array().cast("array<string>")))), ",").alias("labels"),
            F.when(F.size(starts) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        )
        return scratch.keep(out)
