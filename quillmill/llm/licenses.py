"""License scan by diagonal voting.

Every run of K consecutive words of every text is hashed and joined with the places of such
runs in the templates; the join compares the words too, so a hash alone never votes. A vote of
place p in the text for place s in a template lies on diagonal p - s. Votes are aggregated by
diagonal; diagonals with too few are dropped, neighbouring ones (words put in or left out) are
merged into a band, and a band is verified by the share of the template's runs that it holds.

A phrase is a template that has to stand whole, so its bands are single diagonals with all
votes: exactly the places where its words stand consecutively.

Joins: the templates' runs are broadcast while there are at most BROADCAST_RUNS of them, else
Spark joins them by hash. Words are never shuffled: of a text's runs those that meet a template
go on, and one row that stands for the text.

Defined cases: a null or empty text has no words; texts shorter than K words have no runs;
repeated rows and rows without id are scanned each; other columns are ignored; an empty table
gives no rows. Texts of any length are scanned; a text's votes meet in one task, and there are
at most as many as its words times the most places of one run in the templates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .words import words

#: Words of a run.
K = 2
#: Votes that a notice's diagonal needs, words by which neighbouring diagonals may differ, and
#: the share of a notice's runs that a band needs.
VOTES, SLIP, SHARE = 3, 6, 0.6
#: Runs of all templates up to which they are broadcast; some 100 bytes each.
BROADCAST_RUNS = 100_000


@dataclass(frozen=True)
class Template:
    """A text to be found: a phrase has to stand whole, a notice for the greater part."""

    label: str
    text: str
    phrase: bool = True
    base: bool = False


#: The phrases of the contract, and public license notices.
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("agpl", "affero general public license"),
    Template("lgpl", "lesser general public license"),
    Template("bsd", "bsd license"),
    Template("bsd", "bsd 3 clause"),
    Template("bsd", "bsd 2 clause"),
    Template("mpl", "mozilla public license"),
    Template("cc-by", "licensed under cc by 4 0"),
    Template("cc-by-sa", "licensed under cc by sa"),
    Template("cc-by-nc", "licensed under cc by nc"),
    Template("cc0", "cc0 1 0 universal"),
    Template("reserved", "all rights reserved"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        phrase=False,
    ),
    Template(
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or "
        "agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
        phrase=False,
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it "
        "will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        phrase=False,
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        phrase=False,
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
        phrase=False,
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you "
        "can obtain one at",
        phrase=False,
    ),
)


def runs_of(text: str) -> list[str]:
    """The runs of K words of a template, in order."""
    w = text.split()
    if len(w) < K:
        raise ValueError(f"a template needs {K} words: {text!r}")
    return [" ".join(w[i : i + K]) for i in range(len(w) - K + 1)]


def runs(listed: Column) -> Column:
    """The runs of K consecutive words of a list, in order."""
    n = F.greatest(F.size(listed) - (K - 1), F.lit(0))
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat_ws(" ", x, y)), [F.slice(listed, j + 1, n) for j in range(K)])


def places(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(template, spot, run, hash): where each run stands in the templates."""
    rows = [(k, spot, run) for k, t in enumerate(templates) for spot, run in enumerate(runs_of(t.text))]
    found = spark.createDataFrame(rows, "template int, spot int, run string").withColumn("hash", F.xxhash64("run"))
    return F.broadcast(found) if len(rows) <= BROADCAST_RUNS else found


def votes(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(row, doc_id, n_words, template, diagonal, spot) of docs(doc_id, text): a row a vote, and
    for each text its first run at least, without template if it meets none."""
    listed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words"))
    placed = listed.select("row", "doc_id", F.size("words").alias("n_words"), F.posexplode_outer(runs(F.col("words"))).alias("pos", "own"))
    met = placed.withColumn("own_hash", F.xxhash64("own")).join(places(docs.sparkSession, templates), (F.col("own_hash") == F.col("hash")) & (F.col("own") == F.col("run")), "left")
    kept = met.where("template is not null or pos is null or pos = 0")
    return kept.select("row", "doc_id", "n_words", "template", (F.col("pos") - F.col("spot")).alias("diagonal"), "spot")


def facts(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(template, label, base, size, votes, slip): what the templates ask of diagonals and bands."""
    rows = []
    for k, t in enumerate(templates):
        size = len(runs_of(t.text))
        rows.append((k, t.label, t.base, size, size if t.phrase else VOTES, 0 if t.phrase else SLIP, 1.0 if t.phrase else SHARE))
    return F.broadcast(spark.createDataFrame(rows, "template int, label string, base boolean, size int, votes int, slip int, share double"))


def bands(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(row, doc_id, n_words, label, base, start, end, share) of docs(doc_id, text): every
    verified span, in words (end exclusive), with the share of the template's runs in it; a text
    without any has one row without label."""
    spots = F.collect_set("spot")  # at most the template's runs
    lines = votes(docs, templates).groupBy("row", "doc_id", "n_words", "template", "diagonal").agg(spots.alias("spots"))
    lines = lines.join(facts(docs.sparkSession, templates), "template", "left")
    strong = F.size("spots") >= F.col("votes")
    lines = lines.withColumn("template", F.when(strong, F.col("template"))).withColumn("diagonal", F.when(strong, F.col("diagonal")))
    beside = Window.partitionBy("row").orderBy("template", "diagonal")
    new = F.coalesce((F.lag("template").over(beside) != F.col("template")) | (F.col("diagonal") - F.lag("diagonal").over(beside) > F.col("slip")), F.lit(True))
    numbered = lines.withColumn("new", new).withColumn("band", F.sum(F.col("new").cast("int")).over(beside.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("row", "doc_id", "n_words", "template", "band").agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("size").alias("size"), F.first("share").alias("least"),
        F.min(F.col("diagonal") + F.array_min("spots")).alias("start"), (F.max(F.col("diagonal") + F.array_max("spots")) + K).alias("end"),
        F.size(F.array_distinct(F.flatten(F.collect_list("spots")))).alias("held"),
    )
    share = F.col("held") / F.col("size")
    sure = F.col("template").isNotNull() & (share >= F.col("least"))
    only = lambda c: F.when(sure, c)
    return merged.select("row", "doc_id", "n_words", only(F.col("label")).alias("label"), only(F.col("base")).alias("base"), only(F.col("start")).alias("start"), only(F.col("end")).alias("end"), only(share).alias("share"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """The digest of every row of docs(doc_id, text): places of base phrases, labels, and the
    greatest share of a template that a verified span holds."""
    base = F.coalesce(F.col("base"), F.lit(False))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return bands(docs, templates).groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    ).select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
