"""Licence scans by a positional index of rare words.

DataFrame functions only, no shuffle of texts.  A first pass counts in how many
files each index word stands; these few counts give its IDF.  Of every template the
``SUPPORT`` index words of highest IDF in its mandatory phrases have postings
(template, position): where a template counts, these must stand, so none is lost,
however many notices and other index words a file has.  A second pass shifts the
postings by the places of these words, and keeps every (template, shift) that
``SUPPORT`` different words agree on; a template counts where all its mandatory
phrases then stand at their places.  The score is the largest share of a template's
words in place.

Cases: null, empty or blank text has no word, no label and score 0; repeated rows
and null ids get a row each; an empty table gives an empty result; other columns
are ignored, whatever they are called.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from immolens.llm.common import table

GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"       # fixed by the contract, after lower-casing
SUPPORT = 2

# The contract's phrases, with the place of the word they are found by.
BASE = (
    ("mit", "under the mit license", 2),
    ("apache-2", "apache license version 2", 0),
    ("cc-by-nc", "cc by nc", 0),
)

# Labels and the words of public SPDX identifiers.
SPDX = (
    ("mit", "mit"), ("apache-2", "apache 2 0"), ("gpl-3", "gpl 3 0"), ("gpl-2", "gpl 2 0"),
    ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("agpl-3", "agpl 3 0"), ("mpl-2", "mpl 2 0"),
    ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("isc", "isc"), ("bsl-1", "bsl 1 0"),
    ("cc0", "cc0 1 0"), ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa 4 0"),
    ("cc-by-nc", "cc by nc 4 0"), ("unlicense", "unlicense"),
)

# Wording of public licence notices and the phrases that must stand in it.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
     "software and associated documentation files the software to deal in the software without "
     "restriction", ("permission is hereby granted free of charge", "obtaining a copy")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this "
     "file except in compliance with the license", ("apache license version 2",)),
    ("gpl-3", "licensed under the gnu general public license version 3",
     ("gnu general public license", "version 3")),
    ("gpl-2", "licensed under the gnu general public license version 2",
     ("gnu general public license", "version 2")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the "
     "terms of the gnu general public license as published by the free software foundation",
     ("gnu general public license", "free software foundation")),
    ("lgpl", "under the terms of the gnu lesser general public license",
     ("gnu lesser general public license",)),
    ("agpl-3", "under the terms of the gnu affero general public license version 3",
     ("gnu affero general public license", "version 3")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
     "permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with "
     "or without fee is hereby granted", ("permission to use copy modify", "hereby granted")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution", "license")),
    ("cc0", "dedicated to the public domain under creative commons cc0 1 0 universal",
     ("creative commons cc0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software", "public domain")),
    ("gpl-3", "gnu general public license gpl version 3",
     ("gnu general public license", "version 3")),
    ("gpl-2", "gnu general public license gpl version 2",
     ("gnu general public license", "version 2")),
    ("gpl-3", "gnu general public license v3", ("gnu general public license v3",)),
    ("gpl-2", "gnu general public license v2", ("gnu general public license v2",)),
    ("agpl-3", "gnu affero general public license v3", ("gnu affero general public license v3",)),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or "
     "without fee is hereby granted", ("permission to use copy modify and distribute", "hereby granted")),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining "
     "a copy of the software and accompanying documentation covered by this license",
     ("any person or organization obtaining a copy", "accompanying documentation")),
    ("cc-by", "creative commons attribution 3 0 license", ("creative commons attribution", "license")),
    *((label, f"spdx license identifier {identifier}", (f"spdx license identifier {identifier}",))
      for label, identifier in SPDX),
)

# Words of the templates that say too little to be indexed.
UNINDEXED = frozenset(
    "a and any are as be by can for if in into is it may not of or that the this to under use v "
    "with without you 0 1 2 3 4".split())

CODE = 1 << 9            # a code is (template * SHIFTS + shift) * CODE + number of the word
SHIFTS = 1 << 40
MARGIN = 1 << 10         # so that a template may begin before the text does


def index() -> list[str]:
    """The indexed words."""
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()} - UNINDEXED)


def mandatory(t: int) -> list[tuple[int, list[str]]]:
    """(place in template ``t``, words) of its mandatory phrases."""
    text, own = TEMPLATES[t][1].split(), [phrase.split() for phrase in TEMPLATES[t][2]]
    return [(next(i for i in range(len(text)) if text[i:i + len(p)] == p), p) for p in own]


def postings(weights: dict[str, float]) -> dict[str, list[int]]:
    """By word that is looked up, its postings' codes at place 0 of a text."""
    words, out = sorted(weights), {}
    for t in range(len(TEMPLATES)):
        places = [(at + j, w) for at, phrase in mandatory(t) for j, w in enumerate(phrase)]
        rare = sorted({w for _, w in places if w in weights}, key=lambda w: (-weights[w], w))
        for at, w in places:
            if w in rare[:SUPPORT]:
                out.setdefault(w, []).append(
                    (t * SHIFTS + MARGIN - at) * CODE + words.index(w))
    return out


def split_words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, GAPS, -1), "")


def _quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


def places(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, w, at): a file's words, and where indexed ones stand."""
    words = index()
    return (docs.select(F.col(key).alias("doc_id"), split_words(F.col(text)).alias("w"))
            .select("doc_id", "w", F.expr(
                f"filter(if(size(w) = 0, array(), sequence(0, size(w) - 1)), "
                f"i -> w[i] in ({_quoted(words)}))").alias("at")))


def idf(found: DataFrame) -> dict[str, float]:
    """By indexed word; as many rows as there are indexed words come to the driver."""
    words = index()
    counted = found.select(F.explode(F.expr(
        "array_append(array_distinct(transform(at, i -> w[i])), '')")).alias("word")) \
        .groupBy("word").agg(F.count("*").alias("n"))
    n = {r["word"]: r["n"] for r in counted.collect()}
    files = n.get("", 0)
    return {w: math.log((1 + files) / (1 + n.get(w, 0))) for w in words}


def _stand(shift: str, phrase: list[str], at: int) -> str:
    return " and ".join(f"coalesce(get(w, cast({shift} + {at + j} as int)) = '{x}', false)"
                        for j, x in enumerate(phrase))


def _verified(t: int) -> str:
    """All mandatory phrases of template ``t`` stand at their places."""
    return " and ".join(_stand("s", own, at) for at, own in mandatory(t))


def _share(t: int) -> str:
    text = TEMPLATES[t][1].split()
    return "(" + " + ".join(f"cast({_stand('s', [x], j)} as int)"
                            for j, x in enumerate(text)) + f") / {len(text)}D"


def scan(docs: DataFrame) -> DataFrame:
    """A row per file: its places of the base phrases, labels and score."""
    found = places(docs)
    looked_up = postings(idf(found))
    codes = "map(" + ", ".join(
        f"'{w}', array({', '.join(f'{c}L' for c in own)})" for w, own in looked_up.items()) + ")"
    starts = [f"transform(filter(at, i -> w[i] = '{phrase.split()[anchor]}' and "
              f"{_stand('i', phrase.split(), -anchor)}), i -> i - {anchor})"
              for _, phrase, anchor in BASE]
    own = found.select("doc_id", "w", "at", F.array(*(F.expr(s) for s in starts)).alias("base"))
    shifted = own.select("doc_id", "w", "base", F.expr(
        "sort_array(array_distinct(flatten(transform("
        f"filter(at, i -> w[i] in ({_quoted(looked_up)})), "
        f"i -> transform(element_at({codes}, w[i]), c -> c + i * {CODE}L)))))").alias("codes"))
    agreed = shifted.select("doc_id", "w", "base", F.expr(
        "array_distinct(transform(filter(codes, (c, i) -> "
        + " and ".join(f"coalesce(get(codes, i - {k}) div {CODE} = c div {CODE}, false)"
                       for k in range(1, SUPPORT))
        + f"), c -> c div {CODE}))").alias("agreed"))
    cases = " ".join(
        f"when c div {SHIFTS}L = {t} and {_verified(t).replace('(s +', f'(c % {SHIFTS}L - {MARGIN} +')}"
        f" then struct('{TEMPLATES[t][0]}' as label, "
        f"{_share(t).replace('(s +', f'(c % {SHIFTS}L - {MARGIN} +')} as share)"
        for t in range(len(TEMPLATES)))
    told = agreed.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), "base",
        F.expr(f"filter(transform(agreed, c -> case {cases} end), x -> x is not null)").alias("told"))
    base_labels = F.array_compact(F.array(*(
        F.when(F.size(F.get("base", F.lit(k))) > 0, F.lit(label))
        for k, (label, _, _) in enumerate(BASE))))
    done = told.select(
        "doc_id", "n_words", F.flatten("base").alias("starts"),
        F.array_sort(F.array_distinct(base_labels)).alias("base_labels"), "told")
    return done.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.col("told.label"))), ",")
        .alias("labels"),
        F.when(F.size("base_labels") > 0, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max(F.col("told.share")), F.lit(0.0))).alias("score"))


def brute_force(text: str | None) -> tuple:
    """(n_words, n_base, first, last, base labels) of one text; for tests."""
    low = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for label, phrase, _ in BASE:
        own = phrase.split()
        for i in range(len(words)):
            if words[i:i + len(own)] == own:
                starts.append(i)
                labels.add(label)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(labels)))


def query(spark, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
