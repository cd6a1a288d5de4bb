"""Licence scans: a positional index of rare licence words, in DataFrame expressions only."""

from __future__ import annotations

import re
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import load
from goldseam.llm.native import let

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Characteristic sentences of public licences, and a phrase each of which a text must hold.
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    "apache": ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license"),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "unencumbered software"),
    "cc": ("this work is licensed under a creative commons attribution international license", "creative commons"),
    "proprietary": ("all rights reserved no part of this publication may be reproduced or distributed without prior written permission", "all rights reserved"),
}
#: Rare words of a template that files are looked up by, and the share of a template's rare words that must lie at its relative positions.
LOOKUPS, SHARE = 8, 0.6

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What parts words: every ASCII character but digits and letters.
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), LETTERS, LETTERS.lower())
    return F.filter(F.split(low, GAPS), lambda w: w != "")


def _starts(w: Column, phrase: str) -> Column:
    """The positions where a phrase's words stand one after the other."""
    p = phrase.split()
    last = F.size(w) - len(p)

    def fits(i: Column) -> Column:
        out = w[i] == p[0]
        for k in range(1, len(p)):
            out = out & (w[i + k] == p[k])
        return out

    return F.when(last < 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), fits))


def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    A-Z are lower-cased; words are runs of ASCII digits, letters and non-ASCII
    characters.  Base labels are those of the phrases found.  The method's: document
    frequencies of the templates' words over all documents give their IDF; the index
    holds the LOOKUPS words of highest IDF of each template, and a file is looked up
    by all of them that it holds; each posting (template, position) of such a word
    votes for the place where the template would begin;
    a template with SHARE of its rare words at one place, whose mandatory phrase
    the file also holds, adds its label.  score is the largest such share, or 1 if
    a base phrase is found.  Null and empty texts have no word and no label; null
    ids, repeated rows, very long texts and extra columns are no special case; an
    empty table gives an empty one.

    One narrow pass to count frequencies (a row for each template word reaches the
    driver, as many as the templates have) and one to scan, without a shuffle of
    documents.  Texts without any template's mandatory first word skip the index.
    """
    vocabulary = sorted({w for t, _ in templates.values() for w in t.split()})
    anchors = sorted({must.split()[0] for _, must in templates.values()} | {p.split()[0] for p in phrases})
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    gate = F.coalesce(F.col("__text"), F.lit("")).rlike("(?i)(?-u)(?:" + "|".join(map(re.escape, anchors)) + ")")
    every = F.array(*[F.lit(w) for w in vocabulary])
    total = source.count()
    counted = source.where(F.coalesce(F.col("__text"), F.lit("")) != "").select(F.explode(F.array_intersect(every, F.split(F.translate(F.col("__text"), LETTERS, LETTERS.lower()), GAPS))).alias("w"))
    df = {r["w"]: r["n"] for r in counted.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    idf = {w: log((total + 1) / (df.get(w, 0) + 1)) for w in vocabulary}
    rare = {}
    for label, (text, _) in templates.items():
        places = list(enumerate(text.split()))
        chosen = sorted(places, key=lambda p: (-idf[p[1]], p[0]))[:LOOKUPS]
        rare[label] = sorted(chosen)

    # the words of the index: word -> (template, position); LOOKUPS a template at most, so files need no bound of their own
    index = F.array(*[F.lit(w) for w in sorted({w for v in rare.values() for _, w in v})])

    def judged(w: Column) -> Column:
        base = F.array(*[F.struct(F.lit(label).alias("label"), _starts(w, p).alias("at")) for p, label in phrases.items()])
        # the index words that the file holds, with their positions: one pass, whatever the templates
        own = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))), lambda x: F.array_contains(index, x["w"]))
        spaced = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))

        def of_template(label: str, looked: Column) -> Column:
            postings = rare[label]
            must = templates[label][1]
            # votes of the looked-up words for the template's beginning
            def votes(pos: int, word: str) -> Column:
                return F.transform(F.filter(looked, lambda x: x["w"] == word), lambda x: x["i"] - pos)

            starts = F.flatten(F.array(*[votes(pos, word) for pos, word in postings]))
            # equal votes lie side by side once sorted: the longest run, in one pass
            zero = F.struct(F.lit(None).cast("int").alias("at"), F.lit(0).alias("run"), F.lit(0).alias("best"))

            def counted(acc: Column, v: Column) -> Column:
                run = F.when(v == acc["at"], acc["run"] + 1).otherwise(F.lit(1))
                return F.struct(v.alias("at"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

            best = F.aggregate(F.array_sort(starts), zero, counted, lambda acc: acc["best"])
            share = best / F.lit(float(len(postings)))
            return F.struct(F.lit(label).alias("label"), F.when(F.contains(spaced, F.lit(f" {must} ")), share).otherwise(F.lit(0.0)).alias("share"))

        found = let(own, lambda looked: F.array(*[of_template(label, looked) for label in templates]))
        return let(F.struct(base.alias("base"), found.alias("found")), lambda x: F.struct(F.size(w).cast("long").alias("n_words"), x["base"].alias("base"), x["found"].alias("found")))

    none_found = F.array().cast("array<struct<label:string,share:double>>")
    none_base = F.array().cast("array<struct<label:string,at:array<int>>>")
    plain = F.struct(F.size(_words(F.col("__text"))).cast("long").alias("n_words"), none_base.alias("base"), none_found.alias("found"))
    out = source.select(F.col("__id").alias(id_col), F.when(gate, let(_words(F.col("__text")), judged)).otherwise(plain).alias("x"))
    at = F.flatten(F.transform("x.base", lambda b: b["at"]))
    base_labels = F.transform(F.filter("x.base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])
    more = F.transform(F.filter("x.found", lambda b: b["share"] >= SHARE), lambda b: b["label"])
    out = out.select(id_col, "x", at.alias("at"), base_labels.alias("b"), more.alias("m"))
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    top = F.coalesce(F.array_max(F.transform("x.found", lambda b: b["share"])), F.lit(0.0))
    return out.select(
        id_col,
        F.col("x.n_words").alias("n_words"),
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        join(F.col("b")).alias("base_labels"),
        join(F.concat("b", "m")).alias("labels"),
        F.when(F.size("at") > 0, 1.0).otherwise(F.least(top, F.lit(1.0))).alias("score"),
    )


def op9_licences(spark, sf_dir: str) -> DataFrame:
    """The licences that every document names or holds."""
    return scan(load(spark, sf_dir, "documents"))


QUERIES = {"op9_licences": op9_licences}
