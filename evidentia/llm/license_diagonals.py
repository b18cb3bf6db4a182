"""Operator 3, license scan by diagonal voting, in DataFrame operations only.

The hash of every rolling 3-word gram of every text joins the positions of those grams in the license templates (a
fixed table of a few thousand rows, so it is broadcast). A hit votes for its diagonal, the word offset of the text
against the template; votes are gathered for each diagonal, and neighbouring diagonals of one template are merged, so
that inserted or missing words cost little. Hits are verified word by word where they are found, so a hash collision
never votes. A merged span is then verified: the template's words that its hits hold, each counted once however often
they were hit, must be enough of the template, and the text's words that they hold enough of the span. Of accepted
spans that overlap, as those of licenses with much the same wording do, the one with most verified words stays, of
equals the one that covers more of its template.

The base phrases are templates too: a place is a diagonal on which every gram of the phrase voted.

Every document sends one marker row through the same join, which carries its word count, so texts are read once and
never shuffled. Defined results: null and empty texts have no words and a score of 0; repeated rows get one result
each; null ids are results like any other; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, native

GRAM = 3
#: Diagonals at most this far apart are one span.
NEAR = 3
#: Least share of a template's words that a span must hold, and least share of the span's words that hold them.
COVERAGE, DENSITY = 0.7, 0.5

# The contract's phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Notices and opening paragraphs of public licenses, and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], base: dict[str, str]) -> DataFrame:
    """(hash, template, label, base, grams, at, gram): one row for each gram of each template, and the marker's row."""
    rows = [(k, label, text, False) for k, (label, text) in enumerate(templates)] + [(len(templates) + k, label, phrase, True) for k, (phrase, label) in enumerate(base.items())]
    frame = spark.createDataFrame(rows, "template int, label string, text string, base boolean").withColumn("words", native.words(F.col("text")))
    grams = F.size("words") - GRAM + 1
    placed = frame.where(grams >= 1).select("template", "label", "base", grams.alias("grams"), "words", F.explode(F.sequence(F.lit(0), grams - 1)).alias("at"))
    gram = F.slice("words", F.col("at") + 1, GRAM)
    out = placed.select(_gram_hash(F.col("at")).alias("hash"), "template", "label", "base", "grams", "at", gram.alias("gram"))
    marker = spark.createDataFrame([(0, -1, None, False, 0, 0, [])], out.schema)
    return out.unionByName(marker)


def _gram_hash(place):
    return F.xxhash64(*(native.word_at("words", place, o) for o in range(GRAM)))


def spans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """Votes, (row, doc_id, n_words, template, label, base, grams, diagonal, voted: the template's places); template -1 marks the row itself."""
    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", native.words(F.col("text")).alias("words"))
    placed = words.select("row", "doc_id", "words", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("words") - GRAM, F.lit(-1)))).alias("place"))
    hashed = placed.withColumn("hash", F.when(F.col("place") >= 0, _gram_hash(F.col("place"))).otherwise(F.lit(0).cast("long")))
    hits = hashed.join(F.broadcast(template_grams(docs.sparkSession, templates, base)), "hash")
    same = F.when(F.col("place") < 0, F.col("template") < 0).otherwise(F.slice("words", F.greatest(F.col("place"), F.lit(0)) + 1, GRAM) == F.col("gram"))
    hits = hits.where(same).select("row", "doc_id", F.size("words").alias("n_words"), "template", "label", "base", "grams", "at", (F.col("place") - F.col("at")).alias("diagonal"))
    return hits.groupBy("row", "doc_id", "n_words", "template", "label", "base", "grams", "diagonal").agg(F.collect_set("at").alias("voted"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the spans accepted."""
    votes = spans(docs, templates, base)
    place = F.col("base") & (F.size("voted") == F.col("grams"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(False))
    cut = votes.withColumn("span", F.sum(apart.cast("int")).over(order))
    held = lambda at: F.array_distinct(F.flatten(F.collect_list(F.transform("voted", at))))
    merged = cut.groupBy("row", "doc_id", "n_words", "template", "label", "base", "grams", "span").agg(
        held(lambda at: at).alias("theirs"), held(lambda at: at + F.col("diagonal")).alias("ours"),
        F.sum(place.cast("long")).alias("places"), F.min(F.when(place, F.col("diagonal"))).alias("first"), F.max(F.when(place, F.col("diagonal"))).alias("last"))
    n_held = lambda grams: F.size(F.array_distinct(F.flatten(F.transform(grams, lambda at: F.sequence(at, at + (GRAM - 1))))))
    merged = merged.withColumns({"verified": n_held("theirs"), "text_words": n_held("ours"), "low": F.array_min("ours"), "end": F.array_max("ours") + GRAM})
    share = F.col("verified") / (F.col("grams") + GRAM - 1)
    coverage = F.when(F.col("template") < 0, 0.0).when(F.col("base"), (F.col("places") > 0).cast("double")).otherwise(share)
    dense = F.col("text_words") >= DENSITY * (F.col("end") - F.col("low"))
    merged = merged.withColumn("coverage", coverage).withColumn("fits", ~F.col("base") & (F.col("template") >= 0) & (share >= COVERAGE) & dense)
    # an island is a run of spans that overlap one after the other; inside, spans are taken best first, if they overlap none taken
    by_start = Window.partitionBy("row").orderBy("low", "template", "span").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(F.when(F.col("fits"), F.col("end"))).over(by_start)
    merged = merged.withColumn("opens", F.col("fits") & F.coalesce(F.col("low") >= reached, F.lit(True)))
    merged = merged.withColumn("island", F.sum(F.col("opens").cast("int")).over(Window.partitionBy("row").orderBy("low", "template", "span")))
    ranked = F.struct((-F.col("verified")).alias("worse"), (-F.col("coverage")).alias("less"), "template", "span", F.col("low").alias("start"), "end", "label", "coverage")
    islands = merged.groupBy("row", "doc_id", "n_words", "island").agg(
        F.sum("places").alias("places"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.collect_set(F.when(F.col("places") > 0, F.col("label"))).alias("base"),
        F.max(F.when(F.col("base"), F.col("coverage")).otherwise(F.col("coverage") / 2)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("fits"), ranked))).alias("fits"))
    apart = lambda s, t: (s["end"] <= t["start"]) | (t["end"] <= s["start"])
    take = lambda taken, s: F.when(F.forall(taken, lambda t: apart(s, t)), F.concat(taken, F.array(s))).otherwise(taken)
    islands = islands.withColumn("taken", F.aggregate("fits", F.filter("fits", lambda s: F.lit(False)), take))
    plain = F.flatten(F.collect_list(F.transform("taken", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["coverage"].alias("coverage")))))
    found = islands.groupBy("row", "doc_id", "n_words").agg(
        F.sum("places").alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        F.array_distinct(F.flatten(F.collect_list("base"))).alias("base"), F.max("score").alias("score"), F.sort_array(plain).alias("spans"))
    joined = lambda labels: F.array_join(F.sort_array(labels), ",")
    labels = F.transform("spans", lambda s: s["label"])
    return found.select(
        "row", "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(F.array_union("base", labels)).alias("labels"),
        F.greatest("score", F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0))).alias("score"), "spans")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n_words").cast("long"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
