"""License scans as an exact set-similarity join, in DataFrame functions only.

Text blocks are the lines of a text and, so that a notice is found however its lines break, its runs of as many words as
a template has that reach over several lines (runs within a line are in that line's block). A block's set is its distinct lower-cased words, a template's likewise. A block
meets a template if it holds at least ``CONTAINED`` of the template's set. Of a template with t words and least overlap
o, some word among its t - o + 1 globally rarest must be in the block (prefix filter); a block needs o words of any
template (length filter); and a shared word at position i of the template and j of the block, both in order of global
frequency, leaves an overlap of at most 1 + min(t - i, b - j) from there on (positional filter, applied to the first
shared word of the prefix). What passes is verified on whole sets. Word frequencies are counted over all blocks.

Runs are looked at where the whole text holds enough of the template's words, from each word of the template on.

Besides, the phrases of ``PHRASES`` are found wherever their words stand consecutively.

Null or empty text: no words, no labels, score 0. Rows are scanned each for itself, so repeats and null doc_ids get
their own result. A text of any length is scanned whole. Ties among templates give each its label. No rows give no rows.
Only doc_id and text are read, so columns of other names don't clash.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import keep

CONTAINED = 0.8
# The phrases of the scan and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Usual license lines and the labels that they give.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "This text is available under CC BY 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased first (and no other letter)."""
    return F.filter(F.split(F.translate(text, ascii_uppercase, ascii_lowercase), BREAKS), lambda w: w != "")


def phrase_places(w: Column) -> Column:
    """(start, label) of each place of a phrase in the words."""
    return F.flatten(F.array(*(_places(w, phrase.split(), label) for phrase, label in PHRASES.items())))


def _places(w: Column, parts: list[str], label: str) -> Column:
    def start(x: Column, i: Column) -> Column:
        here = x == parts[0]
        for k, part in enumerate(parts[1:], 1):
            here &= F.get(w, i + k) == part
        return F.when(here, i)

    starts = F.filter(F.transform(w, start), lambda i: i.isNotNull())
    return F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))


def _templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(TEMPLATES)], "template int, label string, body string")
    rows = rows.withColumn("length", F.size(words(F.col("body")))).withColumn("t_words", F.array_distinct(words(F.col("body")))).drop("body")
    return rows.withColumns({"t": F.size("t_words"), "o": F.ceil(F.size("t_words") * F.lit(CONTAINED)).cast("int")})


def _runs(templates: list) -> Column:
    """(block, label, contained) of each run of words (column w, its known ones d) over several lines that meets a template."""
    empty = F.array().cast("array<struct<block:int,label:string,contained:double>>")
    enough = [F.size(F.array_intersect("d", F.array(*map(F.lit, r["t_words"])))) >= r["o"] for r in templates]
    last = F.size("w") - 1

    def met(r, line: Column) -> Column:
        t, length = F.array(*map(F.lit, r["t_words"])), r["length"]
        starts = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("w", i).isin(r["t_words"]) & (F.get(line, i) != F.get(line, F.least(i + length - 1, last))))
        found = F.transform(starts, lambda i: F.struct(F.get(line, i).alias("block"), F.lit(r["label"]).alias("label"), (F.size(F.array_intersect(F.slice("w", i + 1, length), t)) / F.lit(r["t"])).alias("contained")))
        return F.array_distinct(F.filter(found, lambda x: (x["contained"] * r["t"] >= r["o"]) & (x["contained"] >= CONTAINED)))

    line_of_word = F.flatten(F.transform(F.split("text", "[\\n\\r]+"), lambda x, i: F.transform(words(x), lambda _: i)))
    every = F.transform(F.array(line_of_word), lambda line: F.flatten(F.array(*(F.when(e, met(r, line)).otherwise(empty) for e, r in zip(enough, templates, strict=True)))))
    return F.when(reduce(or_, enough), F.flatten(every)).otherwise(empty)


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and matches:
    block (line, from 0; of a run, its first word's), label and containment of each block that meets a template."""
    spark = docs.sparkSession
    templates = _templates(spark)
    known_templates = templates.collect()
    fewest = min(r["o"] for r in known_templates)
    vocabulary = sorted({w for r in known_templates for w in r["t_words"]})
    known = lambda w: F.filter(F.array_distinct(w), lambda x: x.isin(vocabulary))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("w", words(F.col("text")))
    hint = F.lower("text").rlike("license|cc[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+by")
    empty = F.array().cast("array<struct<start:bigint,label:string>>")
    rows = rows.withColumn("places", F.when(hint, phrase_places(F.col("w"))).otherwise(empty))
    # Of each line only the template words count, for containment as for the order; lines with too few are dropped.
    lines = F.transform(F.split("text", "[\\n\\r]+"), lambda x, i: F.struct(i.alias("block"), known(words(x)).alias("b_words")))
    lines = F.filter(lines, lambda x: F.size(x["b_words"]) >= fewest)
    rows = rows.withColumn("d", F.array_intersect("w", F.array(*map(F.lit, vocabulary))))
    maybe = F.size("d") >= fewest
    rows = rows.withColumn("lines", F.when(maybe, lines).otherwise(F.array().cast("array<struct<block:int,b_words:array<string>>>")))
    rows = keep(rows.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), "places", "lines", _runs(known_templates).alias("runs")), "blocks")
    blocks = rows.select("row", F.inline("lines"))
    counts = blocks.select(F.explode("b_words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = counts.orderBy("n", "word").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("c")).select(F.col("c.word").alias("ranked"))
    ranked = [r["ranked"] for r in rarest.collect()][0]  # no more words than the templates have
    ranked = ranked + [w for w in vocabulary if w not in set(ranked)]
    order = F.create_map(*(x for i, w in enumerate(ranked) for x in (F.lit(w), F.lit(i))))
    rank = lambda c: F.sort_array(F.transform(c, lambda w: order[w]))
    templates = templates.select("template", "label", "t", "o", rank(F.col("t_words")).alias("t_set"))
    prefix = templates.select("*", F.posexplode(F.expr("slice(t_set, 1, t - o + 1)")).alias("i", "word"))
    blocks = blocks.select("row", "block", rank(F.col("b_words")).alias("b_set"))
    heads = blocks.select("*", F.size("b_set").alias("b"), F.posexplode("b_set").alias("j", "word"))
    pairs = heads.join(F.broadcast(prefix), "word").filter("b >= o and 1 + least(t - i - 1, b - j - 1) + least(i, j) >= o")
    firsts = Window.partitionBy("row", "block", "template").orderBy("i")
    pairs = pairs.withColumn("nth", F.row_number().over(firsts)).filter("nth = 1")
    met = pairs.withColumn("contained", F.size(F.array_intersect("b_set", "t_set")) / F.col("t")).filter(f"contained * t >= o and contained >= {CONTAINED}")
    met = met.groupBy("row").agg(F.collect_list(F.struct("block", "label", "contained")).alias("matches"))
    none = F.array().cast("array<struct<block:int,label:string,contained:double>>")
    out = rows.join(met, "row", "left").withColumn("matches", F.concat(F.coalesce("matches", none), "runs"))
    base = F.sort_array(F.array_distinct(F.col("places.label")))
    more = F.col("matches.label")
    start = F.col("places.start")
    score = F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("matches.contained"), F.lit(0.0)))
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union(base, more)), ",").alias("labels"), score.alias("score"), F.sort_array("matches").alias("matches"))
