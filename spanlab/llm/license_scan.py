"""License scans: an exact set-similarity join of text blocks with notice templates.

A block is ``BLOCK_WORDS`` consecutive words of the text, whatever its lines; blocks overlap by
half, so every run of up to half a block's words lies whole in one.  A block meets a template when
it holds at least ``ceil(threshold * |template|)`` of the template's distinct words, or all of them
where they are fewer than ``WHOLE``, as there one word tells two licences apart.  The join is exact:

* the templates' words are ordered by their frequency in the whole corpus, rare first;
* a template is indexed under its prefix, its first ``n - need + 1`` words in that order,
  and a block probes with its own prefix, so a pair that shares no prefix word can't meet;
* the length filter drops blocks with too few template words, the positional filter pairs
  whose remaining words can't reach the needed overlap;
* what is left is verified by intersecting the sets.

The base phrases are templates too, to be held whole; a match counts where the phrase's words also
stand consecutively in the text.  The score is the largest share of a template that a block holds.

The template table is a constant of the library, so its index is a literal of the plan and
each text row probes it in place: one shuffle of word counts, none of texts, no Python.

Nulls: a null text has no words; a null id is kept.  Empty texts have n_words 0, no labels
and score 0.  Repeated rows give a row each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running
from .decontaminate import words_of

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices by label; matching is by their distinct words.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-header": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "lgpl": "under the terms of the gnu lesser general public license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related rights",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.85
WHOLE = 10
BLOCK_WORDS = 48


def word_order(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> list[str]:
    """The distinct words of templates and phrases, rarest in ``docs`` first, ties by word."""
    vocabulary = sorted({w for t in (*templates.values(), *PHRASES) for w in t.split()})
    word = F.explode_outer(words_of(F.col("text"))).alias("word")
    rows = docs.select(word).where(F.col("word").isin(vocabulary)).groupBy("word").count().collect()  # at most one row a vocabulary word
    seen = {r.word: r["count"] for r in rows}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def needed(n: int, threshold: float) -> int:
    """How many of a template's ``n`` distinct words a block must hold."""
    whole = int(threshold * n)
    return n if n < WHOLE else max(1, whole if whole >= threshold * n - 1e-9 else whole + 1)


def _spaces(s: Column) -> Column:
    return F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))


def _places(line: Column, pattern: str) -> Column:
    """(word, hit) of all leftmost, non-overlapping matches in words that single spaces part."""
    cut = F.struct(F.split(line, pattern, -1).alias("pieces"), F.regexp_extract_all(line, F.lit(pattern), F.lit(0)).alias("hits"))
    steps = lambda x: F.transform(x["hits"], lambda h, i: (_spaces(F.get(x["pieces"], i)) + _spaces(h)).cast("long"))
    placed = lambda x: F.transform(x["hits"], lambda h, i: F.struct((F.get(x["before"], i) + _spaces(F.get(x["pieces"], i))).alias("word"), h.alias("hit")))
    found = let(let(cut, lambda x: F.struct(x["pieces"].alias("pieces"), x["hits"].alias("hits"), running(steps(x)).alias("before"))), placed)
    return F.when(line.rlike(pattern), found).otherwise(F.array().cast("array<struct<word:long,hit:string>>"))


def scan(docs: DataFrame, order: list[str], templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text)``: doc_id, n_words, places (start word and label of each base phrase), matches (label, score)."""
    rank = {w: k for k, w in enumerate(order)}
    sets = [(label, sorted({rank[w] for w in t.split()}), False) for label, t in templates.items()]
    sets += [(label, sorted({rank[w] for w in p.split()}), True) for p, label in PHRASES.items()]
    entries, probes = [], set()
    for label, ranks, phrase in sets:
        need = len(ranks) if phrase else needed(len(ranks), threshold)
        for j, r in enumerate(ranks[: len(ranks) - need + 1]):
            entries.append(f"named_struct('label','{label}','phrase',{str(phrase).lower()},'word',{r},'at',{j},'size',{len(ranks)},'need',{need},'ranks',array({','.join(map(str, ranks))}))")
            probes.add(order[r])
    index = F.expr(f"array({','.join(entries)})")
    vocabulary = F.split(F.lit(" ".join(order)), " ")
    standing = lambda words: rf"(?<![^ ])({'|'.join(sorted(words))})(?![^ ])"

    base = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    base = base.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("line"))
    labels = F.create_map(*(F.lit(x) for pair in PHRASES.items() for x in pair))
    places = F.transform(_places(F.col("line"), standing(PHRASES)), lambda p: F.struct(p["word"].alias("word"), F.element_at(labels, p["hit"]).alias("label")))

    # the join: a place of a probe word lies in the block of its half and in the one before
    half = BLOCK_WORDS // 2
    number = lambda p: F.floor(p["word"] / half)
    blocks = F.array_distinct(F.flatten(F.transform(_places(F.col("line"), standing(probes)), lambda p: F.array(F.greatest(number(p) - 1, F.lit(0)), number(p)))))

    def ranks_of(block: Column) -> Column:
        known = F.filter(F.transform(F.slice(F.col("words"), (block * half + 1).cast("int"), BLOCK_WORDS), lambda w: F.array_position(vocabulary, w).cast("int") - 1), lambda r: r >= 0)
        return F.array_sort(F.array_distinct(known))

    def matched(ranks: Column) -> Column:
        def passes(e: Column) -> Column:
            i = F.array_position(ranks, e["word"]) - 1
            bound = F.least(i, e["at"]) + 1 + F.least(F.size(ranks) - 1 - i, e["size"] - 1 - e["at"])
            return (F.size(ranks) >= e["need"]) & (i >= 0) & (i <= F.size(ranks) - e["need"]) & (bound >= e["need"])

        overlap = lambda e: F.size(F.array_intersect(ranks, e["ranks"]))
        kept = F.filter(F.filter(index, passes), lambda e: overlap(e) >= e["need"])
        return F.transform(kept, lambda e: F.struct(e["label"].alias("label"), (overlap(e) / e["size"]).alias("score"), e["phrase"].alias("phrase")))

    met = F.array_distinct(F.flatten(F.transform(F.transform(blocks, ranks_of), matched)))
    out = base.select("doc_id", "n_words", places.alias("places"), met.alias("met"))
    true = F.filter("met", lambda m: ~m["phrase"] | F.exists("places", lambda p: p["label"] == m["label"]))
    return out.select("doc_id", "n_words", "places", F.transform(true, lambda m: F.struct(m["label"].alias("label"), m["score"].alias("score"))).alias("matches"))
