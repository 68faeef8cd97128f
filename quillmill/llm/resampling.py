"""Resampling towards a target distribution: word n-grams hashed into buckets, each bucket
weighed by how much more the target texts use it, documents drawn by weight and Gumbel noise.

The position table has a row a word: `posexplode` numbers a document's words, `lead` over the
document's window puts the words that follow beside each, so the n-grams of every order are
concatenations within a row. Texts are dealt out by document before their words are made, so
the window needs no shuffle of words. A document's features are written once, as buckets; they
are counted (with partial sums by task, whatever a bucket's share) and joined with the gains,
which are a row a bucket.

Defined cases: a null or empty text has no features, weight 0, and is not drawn; a null id
counts as the empty text in the noise and comes last in ties; repeated rows count, and are
ranked, each; without target texts every target count is 0; other columns are ignored; an empty
table gives no rows. A document's words are sorted in one task, which spills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import cut, table, tidy
from .words import words

ORDERS, BUCKETS, SEED, LEAST_WORDS, PERCENT = 2, 10_000, 7, 20, 25


def features(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, n_words, bucket) of docs(doc_id, text), a row a feature: every run of 1 to
    orders words. A document without words has one row, its bucket null."""
    dealt = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").repartition("row")
    listed = dealt.select("row", "doc_id", words(F.col("text")).alias("words"))
    placed = listed.select("row", "doc_id", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    following = Window.partitionBy("row").orderBy("pos")
    ahead = placed.withColumns({f"_next{k}": F.lead("word", k).over(following) for k in range(1, orders)})
    grams, gram = [], F.col("word")
    for k in range(orders):
        if k:
            gram = F.concat(gram, F.lit(" "), F.col(f"_next{k}"))  # null where the document ends
        grams.append((F.crc32(gram) % buckets).cast("int"))
    # Spark interprets array_compact a word, so n-grams that a document's end cuts off go here.
    found = ahead.select("row", "doc_id", "n_words", F.posexplode(F.array(*grams)).alias("more", "bucket"))
    return found.where("more = 0 or bucket is not null").drop("more")


def gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for all buckets, from features of the documents and of the target: 1000
    times the log ratio of their shares, with one added to each bucket, rounded down."""
    spark = own.sparkSession
    count = lambda df, name: df.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(count(own, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    both = cut(both)  # a row a bucket; the totals of tasks meet by bucket, not in one task
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(total["s"] + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(total["t"] + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(up / down)).alias("gain"))


def weights(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of every row of docs: weight is the mean gain
    of its features, rounded down."""
    with tidy(docs.sparkSession):
        own = cut(features(docs, orders, buckets))
        gain = gains(own, features(target, orders, buckets), buckets)
    met = own.join(F.broadcast(gain), "bucket", "left")  # `buckets` rows
    of = met.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    mean = F.expr("if(n_features = 0, 0L, (total - pmod(total, n_features)) div n_features)")
    return of.select("row", "doc_id", "n_words", "n_features", mean.alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document, in thousandths rounded down, from its id and the seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(uniform)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs(doc_id, text): of those
    with at least `least` words, `percent` in a hundred (rounded down) are drawn, the highest
    scores, that is weight plus noise, first; rank is null for the others. This is sampling
    without replacement, in proportion to exp(weight / 1000)."""
    scored = weights(docs, target, orders, buckets).select(
        "doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least).alias("able")
    )
    with tidy(docs.sparkSession):
        scored = cut(scored)
        drawn = percent * scored.where("able").count() // 100
        placed = numbered(scored, F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight", name="place")
    rank = F.when(F.col("able") & (F.col("place") <= drawn), F.col("place"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def drawn_documents(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The documents whose id was drawn, with all their columns."""
    return docs.join(ranks.where("rank is not null").select("doc_id"), "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    target = table(spark, sf_dir, "benchmark").select(F.lit(None).cast("long").alias("doc_id"), "text")
    return resample(docs, target)
