"""Licence scan: an exact set-similarity join between text blocks and licence templates.

Blocks are overlapping windows of words. Template tokens are ordered by their frequency over all documents, rare
ones first. A block holds a template to the containment threshold only if it holds one of the template's first
``size - needed + 1`` tokens (prefix filter), enough template tokens in all (length filter), and enough after the
first match (positional filter). Survivors are verified exactly, and must hold the words that name the licence. Everything is DataFrame expressions.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetone.llm.common import ANY_CASE_LETTER, words

#: Words from one block's start to the next; blocks are longer by the longest template, so no passage falls between.
STRIDE = 64
CONTAINMENT = 0.8
#: A word before the text is lower-cased; there are as many of them.
ANY_CASE_WORD = ANY_CASE_LETTER + "+"

# Phrases whose places are reported, with their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Notices the method adds: found when a block holds 80 % of a notice's distinct words, and all of the words that name it.
NOTICES = (
    ("this work is licensed under the gnu general public license version", "gpl-notice", "gnu general public license"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
     "gpl-notice", "gnu general public license"),
    ("gnu lesser general public license as published by the free software foundation", "lgpl-notice", "gnu lesser"),
    ("licensed under the apache license version 2 0", "apache-notice", "apache license"),
    ("licensed under the creative commons attribution license", "cc-by-notice", "creative commons attribution"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
     "files", "mit-notice", "permission granted copy software"),
    ("released under the mit license", "mit-notice", "mit license"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd-notice", "redistribution source binary conditions"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-notice", "mozilla public license"),
)


def templates() -> list[dict]:
    """Every phrase and notice: its words, distinct tokens, naming tokens, label, and how many tokens a block must hold."""
    out = []
    for exact, rows in ((True, PHRASES), (False, NOTICES)):
        for text, label, *naming in rows:
            tokens = sorted(set(text.split()))
            out.append({"id": len(out), "label": label, "exact": exact, "words": text.split(), "tokens": tokens,
                        "naming": sorted({w for n in naming for w in n.split()}),
                        "needed": len(tokens) if exact else ceil(CONTAINMENT * len(tokens) - 1e-9)})
    return out


WIDTH = STRIDE + max(len(t["words"]) for t in templates()) - 1
VOCABULARY = sorted({w for t in templates() for w in t["tokens"]})


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def token_order(texts: DataFrame) -> list[str]:
    """Template tokens by the number of documents that hold them, rare ones first; ties by token.

    Counted over all documents; a task sends one count for each token of the templates.
    """
    present = F.explode(F.array_intersect(words(F.col("text")), _strings(VOCABULARY)))
    counts = {r["token"]: r["n"] for r in texts.select(present.alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    return sorted(VOCABULARY, key=lambda w: (counts.get(w, 0), w))


def _blocks(texts: DataFrame, order: list[str], probes: list[str]) -> DataFrame:
    """(row, at, block, ranks): blocks of the documents that hold any prefix token; ranks are sorted template tokens."""
    rank = F.create_map(*[x for i, w in enumerate(order) for x in (F.lit(w), F.lit(i))])
    # A text that holds none of the tokens as a word is not cut into words at all. A filter on the words
    # themselves would be pushed below the projection and cut every text twice.
    alone = f"(?i)(?<!{ANY_CASE_LETTER})(?:{'|'.join(probes)})(?!{ANY_CASE_LETTER})"
    held = texts.filter(F.col("text").rlike(alone)).select("row", words(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(STRIDE))
    cut = held.select("row", "words", F.explode(starts).alias("at")).select(
        "row", "at", F.slice("words", F.col("at") + 1, WIDTH).alias("block"))
    return cut.filter(F.arrays_overlap("block", _strings(probes))).withColumn(
        "ranks", F.array_sort(F.transform(F.array_intersect("block", _strings(VOCABULARY)), lambda w: rank[w])))


def matches(texts: DataFrame) -> DataFrame:
    """(row, at, block, template, label, exact, containment): every block that holds a template to its threshold.

    ``texts`` has row (any key) and text. The templates are a constant table (fewer than 20 rows), so the probe
    table is broadcast; documents are not shuffled.
    """
    spark = texts.sparkSession
    order = token_order(texts)
    place = {w: i for i, w in enumerate(order)}
    rows = []
    for t in templates():
        ranks = sorted(place[w] for w in t["tokens"])
        for i, r in enumerate(ranks[:len(ranks) - t["needed"] + 1]):
            rows.append((r, i, t["id"], t["label"], t["exact"], t["needed"], ranks, [place[w] for w in t["naming"]]))
    probe = spark.createDataFrame(
        rows, "token int, i int, template int, label string, exact boolean, needed int, t array<int>, naming array<int>")
    prefix = sorted({order[r[0]] for r in rows})
    tokens = _blocks(texts, order, prefix).select("row", "at", "block", "ranks", F.posexplode("ranks").alias("j", "token"))
    met = tokens.join(F.broadcast(probe), "token").filter(
        (F.size("ranks") >= F.col("needed"))
        & (F.least(F.size("ranks") - F.col("j"), F.size("t") - F.col("i")) >= F.col("needed")))
    common = F.array_intersect("ranks", "t")
    # One row per block and template: only the first common token may report the pair.
    found = met.withColumn("common", common).filter(
        (F.size("common") >= F.col("needed")) & (F.col("token") == F.array_min("common"))
        & (F.size(F.array_except("naming", "common")) == 0))
    return found.select("row", "at", "block", "template", "label", "exact",
                        (F.size("common") / F.size("t")).alias("containment"))


def phrase_places(block: Column, template: Column, at: Column) -> Column:
    """Starts, in words of the document, of the phrase in the part of the block that no later block repeats."""
    cases = F.lit(None).cast("array<int>")
    for t in templates():
        if t["exact"]:
            cases = F.when(template == t["id"], F.transform(_starts(block, t["words"]), lambda i: i + at)).otherwise(cases)
    return cases


def _starts(block: Column, phrase: list[str]) -> Column:
    own = F.sequence(F.lit(0), F.least(F.size(block), F.lit(STRIDE)) - 1)
    return F.filter(own, lambda i: F.slice(block, i + 1, len(phrase)) == _strings(phrase))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per document.

    ``n_base`` counts the places of all phrases, ``first_word`` and ``last_word`` are their smallest and largest
    start (null without any), ``labels`` adds those of the notices, ``score`` is the largest containment of a
    template that was found, else 0. Null texts are empty: 0 words, no labels. Rows with equal key and text give
    equal rows, one each; null keys are keys. No rows give no rows. A place that two blocks hold counts once.
    Only blocks with licence words are grouped, by document; a document has few.
    """
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.withColumn("row", F.xxhash64("key", "text"))
    found = matches(texts.select("row", "text"))
    placed = found.withColumn("places", F.when(F.col("exact"), phrase_places(F.col("block"), F.col("template"), F.col("at"))))
    # Copies of a row find the same again: one row per block and template is kept.
    single = placed.select("row", "at", "template", "label", "exact", "containment", "places").dropDuplicates(
        ["row", "at", "template"])
    base = F.when(F.col("exact") & (F.size("places") > 0), F.col("label"))
    real = ~F.col("exact") | (F.size("places") > 0)
    per_row = single.groupBy("row").agg(
        F.sum(F.when(F.col("exact"), F.size("places")).otherwise(0)).cast("bigint").alias("n_base"),
        F.min(F.array_min("places")).cast("bigint").alias("first_word"),
        F.max(F.array_max("places")).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(real, F.col("label")))), ",").alias("labels"),
        F.max(F.when(real, F.col("containment")).otherwise(0.0)).alias("score"))
    n_words = F.size(F.regexp_extract_all("text", F.lit(ANY_CASE_WORD), F.lit(0)))
    counted = texts.select("key", "row", n_words.cast("bigint").alias("n_words"))
    return counted.join(per_row, "row", "left").select(
        F.col("key").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
