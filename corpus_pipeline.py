"""A corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's documents.

    toxicity   rows whose score is the threshold or more go
    near_dups  of each group of near copies (5-word shingles, Jaccard similarity 0.8 or more) one stays
    pii        personal data in the texts is replaced by its kind, and n_chars brought up to date
    mixing     rows are put in the order of a schedule that meets the sources' target weights; all stay
    tokens     texts are encoded and decoded again: the digests of each document's ids and text, and its place in the mixed order

All stages but the last return the columns of `documents`. Null and empty texts pass all stages.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from candlewick.llm import bpe, jaccard, mixing, pii, toxicity
from candlewick.llm.common import BROADCAST_ROWS, at_end, shared_folder, table


def remove_toxic(spark, docs, sf_dir):
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def remove_near_duplicates(spark, docs, sf_dir):
    return jaccard.keep_first(docs, n=5, num=80, den=100)


def redact_personal_data(spark, docs, sf_dir):
    return pii.redact(docs)


def mix_sources(spark, docs, sf_dir):
    return mixing.mix(docs)


def placed(docs):
    """docs with `place`: how many rows stand before each in the files that docs is read from, taken in order; null where docs is no scan of files."""
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return docs.withColumn("place", F.lit(None).cast("long"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # over the files, one row each
    files = rows.groupBy("__file").agg(F.count("*").alias("n")).select("__file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    files = F.broadcast(files) if len(docs.inputFiles()) <= BROADCAST_ROWS else files
    return rows.join(files, "__file").withColumn("place", F.col("__before") + F.col("__row")).drop("__file", "__row", "__before")


def encode_tokens(spark, docs, sf_dir):
    import public_tokenizers

    return bpe.encode_decode(placed(docs), public_tokenizers.path("byte_bpe_50k.json"), carry=("place",))


STAGES = [("toxicity", remove_toxic), ("near_dups", remove_near_duplicates), ("pii", redact_personal_data), ("mixing", mix_sources), ("tokens", encode_tokens)]

#: SQL can't express the field, the groups of near copies of whole texts or the encoder: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows for the documents of sf_dir. The stages' folder is deleted when the driver's process ends."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        out = step(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        at_end(spark, f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
