"""Token ids in ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

The files are Spark's own ORC: ids are an array of integers, which ORC stores run-length encoded; each
stripe has an index of every `stride` rows with the least and greatest id and a Bloom filter. Files and
stripes are in ascending document order, so a reader of a few ids skips almost all stripes by metadata,
and a reader of everything takes the stripes in parallel.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import arrow, tasks, text_pieces

END = 2
#: Documents of a stripe, at most: some ten megabytes of ids, so that files of a few hundred are read by several tasks.
STRIPE_ROWS = 10_000


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = END, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 64 << 20, stride: int = 1_000, stripe_rows: int = STRIPE_ROWS, files: int | None = None) -> None:
    """Writes the token ids of docs under path, in ascending id order (null ids first, ties by text).

    One range shuffle of the texts; each task then encodes its sorted rows and writes one file. Columns:
    id, part and local_start (the ids before the document in its file; the base of a file is the sum of
    those before it), n_tokens (with the end id), tokens. Null and empty texts hold only the end id.
    Writing goes through Spark's committer, so lost tasks are written again and never twice. Repeated rows are
    stored as often as they are there. An empty table gives an empty folder. A document's ids must fit one array;
    other columns are not read. A stripe ends at stripe_rows documents or stripe_bytes, whichever comes first.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(words.vocabulary(vocabulary_path))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        own, part, before = words.encoder(vocabulary.value), TaskContext.get().partitionId(), 0
        for b in text_pieces(batches):
            ids = [x + end for x in own.encode([t or "" for t in b.column(1).to_pylist()])]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(n)
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
            start = pa.array(before + ends - n)
            before += int(ends[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int32)), start, pa.array(n), tokens], names=[id_col, "part", "local_start", "n_tokens", "tokens"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(id_col, text_col).repartitionByRange(files or tasks(docs), id_col).sortWithinPartitions(id_col, text_col)
    rows = rows.transform(arrow, run, f"`{id_col}` {kind}, part int, local_start long, n_tokens long, tokens array<int>")
    (
        rows.write.option("orc.bloom.filter.columns", id_col)
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.stripe.row.count", str(stripe_rows))
        .option("orc.compress", "ZSTD")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, ids=None, id_col: str = "doc_id") -> DataFrame:
    """The stored rows; ids: only these, found by the files' indexes and Bloom filters (a pushed-down filter)."""
    kind = spark.read.orc(path).schema
    rows = spark.read.schema(kind).orc(path)
    return rows if ids is None else rows.where(F.col(id_col).isin(list(ids)))


def digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each stored document, from the files.

    start: the ids of all documents before it. The sums of the files (one row a file) are added up and
    broadcast: there are as many as files were written, never as many as documents.
    """
    import pyarrow as pa

    rows = read_tokens(spark, path, id_col=id_col)

    def run(batches):
        for b in batches:
            tokens = b.column(3)
            offsets, values = np.asarray(tokens.offsets), np.asarray(tokens.values).astype("<u4", copy=False)
            crc = [zlib.crc32(values[s:e].tobytes()) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array((offsets[1:] - offsets[:-1]).astype(np.int64)), pa.array(crc, pa.int64())], names=[id_col, "part", "local_start", "n_tokens", "ids_crc32"])

    kind = dict(rows.dtypes)[id_col]
    found = rows.select(id_col, "part", "local_start", "tokens").transform(arrow, run, f"`{id_col}` {kind}, part int, local_start long, n_tokens long, ids_crc32 long")
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("held")).collect()
    bases, total = [], 0
    for part, held in sorted(sums):
        bases.append((part, total))
        total += held
    base = spark.createDataFrame(bases, "part int, base long")
    return found.join(F.broadcast(base), "part").select(id_col, (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
