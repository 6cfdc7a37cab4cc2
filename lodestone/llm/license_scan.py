"""License notices in texts by diagonal voting: DataFrame functions only.

Every run of K words of a text is hashed and joined with the places of the same runs in the
templates, a broadcast table of fixed size. A hit votes for the diagonal (place in the text minus
place in the template) of its text and template; votes are counted before and after the shuffle,
so a passage that stands in many texts costs one row for each text and diagonal. Diagonals closer
than the template's slack are one candidate: words put in or left out shift the votes. Candidates
with enough votes are verified on the text's own words by edit distance; only the texts that have
any are read again. Phrases have no slack and must stand word for word, wherever they do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, ROW_KEY, few, materialize, stable, with_row_key

#: Words of a run.
K = 3
#: A word of a text whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases of the contract, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Public license notices, with the labels they stand for.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("licensed under the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("creative commons zero public domain dedication", "cc0"),
    ("released under the bsd license", "bsd"),
    ("released under the mit license", "mit"),
)

#: Diagonals of a notice this share of its words apart, rounded down, are one candidate.
SLACK = 0.1
#: Share of a notice's runs that must vote, and of its text that must be alike.
VOTES, ALIKE = 0.4, 0.8


def templates(phrases=PHRASES, notices=NOTICES) -> list[tuple]:
    """(template, label, exact, words, n_runs, slack) of all templates."""
    rows = [(text, label, True) for text, label in phrases] + [(text, label, False) for text, label in notices]
    split = [(i, label, exact, text.split()) for i, (text, label, exact) in enumerate(rows)]
    if short := [" ".join(w) for *_, w in split if len(w) < K]:
        raise ValueError(f"templates of fewer than {K} words: {short}")
    return [(i, label, exact, words, len(words) - K + 1, 0 if exact else int(SLACK * len(words))) for i, label, exact, words in split]


_TEMPLATE = "template int, label string, exact boolean, words array<string>, runs long, slack long"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def run_hashes(words: Column) -> Column:
    """A hash of each run of K words, in order; none for fewer words."""
    places = F.sequence(F.lit(0), F.size(words) - K)
    return F.when(F.size(words) >= K, F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(K)]))).otherwise(F.array().cast("array<bigint>"))


def votes(docs: DataFrame, known: DataFrame, label: str = "license-votes") -> DataFrame:
    """ROW_KEY, doc_id, n_words, template, diagonal, votes, first and last: a row for each diagonal of a row of `docs` that has any.

    Each row of `docs` has one more, with a null template, so none is lost in the join.
    """
    rows = with_row_key(docs, docs["`doc_id`"].alias("doc_id"), words_of(docs["`text`"]).alias("_words"))
    runs = rows.select("doc_id", *ROW_KEY, F.size("_words").cast("long").alias("n_words"), F.concat(F.array(F.lit(_NONE).cast("long")), run_hashes(F.col("_words"))).alias("_runs"))
    # outer: for an inner explode the planner tests the array in the scan's filter, where words are cut anew at each place
    runs = runs.select("doc_id", *ROW_KEY, "n_words", F.posexplode_outer("_runs").alias("_next", "_run"))
    places = known.select("template", F.posexplode(run_hashes(F.col("words"))).alias("_place", "_run")).collect()
    places = known.sparkSession.createDataFrame([*map(tuple, places), (None, 0, _NONE)], "template int, _place int, _run long")
    at = (F.col("_next") - 1).cast("long").alias("_at")
    hits = runs.join(F.broadcast(places), "_run").select(*ROW_KEY, "doc_id", "n_words", "template", at, (at - F.col("_place")).alias("diagonal"))
    counted = hits.groupBy(*ROW_KEY, "template", "diagonal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count("*").alias("votes"), F.min("_at").alias("first"), F.max("_at").alias("last"))
    return materialize(counted, label)


#: Stands for "no run", at place -1 of every row; a run that happens to have this hash votes for no template.
_NONE = 0


def candidates(found: DataFrame, known: DataFrame) -> DataFrame:
    """ROW_KEY, template, label, exact, start and size (words): neighbouring diagonals merged, with enough votes.

    A candidate lies on its diagonal of most votes, and reaches from its first hit to its last.
    """
    facts = known.select("template", "label", "exact", "runs", "slack")
    rows = found.where("template is not null").join(F.broadcast(facts), "template")
    order = Window.partitionBy(*ROW_KEY, "template").orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(order) > F.col("slack")).cast("int")
    rows = rows.withColumn("island", F.sum(F.coalesce(new, F.lit(1))).over(order))
    merged = rows.groupBy(*ROW_KEY, "template", "label", "exact", "runs", "island").agg(F.sum("votes").alias("votes"), F.min("first").alias("start"), (F.max("last") - F.min("first") + K).alias("size"))
    enough = F.when(F.col("exact"), F.col("votes") >= F.col("runs")).otherwise(F.col("votes") >= VOTES * F.col("runs"))
    return merged.where(enough).select(*ROW_KEY, "template", "label", "exact", "start", "size")


def verified(docs: DataFrame, spans: DataFrame, known: DataFrame) -> DataFrame:
    """`spans` whose words are the template's (phrases), or alike by edit distance (notices), with score."""
    spans = materialize(spans, "license-spans")
    asked = few(spans.select(*ROW_KEY).distinct(), BROADCAST_IDS // 2)
    texts = with_row_key(docs, docs["`text`"].alias("text")).join(asked, list(ROW_KEY), "left_semi").select(*ROW_KEY, words_of(F.col("text")).alias("_words"))
    each = F.collect_list(F.struct("template", "label", "exact", "start", "size")).alias("_spans")
    rows = texts.join(spans.groupBy(*ROW_KEY).agg(each), list(ROW_KEY))
    cut = F.transform("_spans", lambda s: F.struct(s["template"].alias("template"), s["label"].alias("label"), s["exact"].alias("exact"), s["start"].alias("start"), F.array_join(F.slice(F.col("_words"), (s["start"] + 1).cast("int"), s["size"].cast("int")), " ").alias("text")))
    rows = rows.select(*ROW_KEY, F.explode(cut).alias("s")).select(*ROW_KEY, "s.*").join(F.broadcast(known.select("template", F.array_join("words", " ").alias("wanted"))), "template")
    longer = F.greatest(F.length("text"), F.length("wanted"))
    far = F.floor((1 - ALIKE) * longer + 1e-9).cast("int")
    near = F.when(F.abs(F.length("text") - F.length("wanted")) <= far, F.levenshtein("text", "wanted"))
    alike = F.when(F.col("text") == F.col("wanted"), 1.0).when(~F.col("exact") & (near <= far), 1 - near / longer)
    return rows.withColumn("score", alike).where("score is not null").select(*ROW_KEY, "template", "label", "exact", "start", "score")


def known_templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    return spark.createDataFrame(templates(phrases, notices), _TEMPLATE)


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of `docs` (doc_id, text).

    n_base counts the places of all phrases, overlapping ones each; first_word and last_word are the
    smallest and largest word one starts at. base_labels and labels are distinct, sorted and joined by
    commas, empty if there are none; score is that of the best verified span, 0 without one.
    Null and empty texts have no words; null ids and repeated rows are rows of their own; texts may
    be of any length; a text may hold a notice any number of times; columns of other names are
    ignored. An empty table gives no rows.
    """
    docs = stable(docs, "license-rows")
    known = known_templates(docs.sparkSession, phrases, notices)
    found = votes(docs, known)
    spans = materialize(verified(docs, candidates(found, known), known), "license-verified")
    base = lambda column: F.when(F.col("exact"), F.col(column))
    per = spans.groupBy(*ROW_KEY).agg(
        F.count(base("start")).alias("n_base"), F.min(base("start")).alias("first_word"), F.max(base("start")).alias("last_word"),
        F.array_sort(F.collect_set(base("label"))).alias("base"), F.array_sort(F.collect_set("label")).alias("every"), F.max("score").alias("score"),
    )
    rows = found.where("template is null and diagonal = -1").select("doc_id", "n_words", *ROW_KEY).join(few(per, BROADCAST_IDS // 2), list(ROW_KEY), "left")
    listed = lambda column: F.coalesce(F.array_join(column, ","), F.lit(""))
    return rows.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", listed("base").alias("base_labels"), listed("every").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
