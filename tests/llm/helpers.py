"""Small document tables with the awkward rows every operator must take."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


def docs(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def saved(spark, tmp_path, texts, name="documents"):
    docs(spark, texts).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def awkward():
    long = prose(1, 6000, 3000)
    return [None, "", " ", "\n\t", "one", "two words", "  double  space ", "é ß \U0001f600 x", long, long, long + " tail", "a\x1fb c", "aaaa" * 300]
