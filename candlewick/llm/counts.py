"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries (white space, and beside digits in very long words), the distinct words
of a batch go to the library in sub-batches balanced by bytes, and only lengths are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import words
from .common import arrow, text_pieces


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs.

    path: a tokenizers file whose pre-tokenizer drops white space. Null and empty texts count 0 bytes and
    0 tokens; repeated rows give repeated results; a null id stays null; an empty table gives an empty result;
    other columns, whatever their names, are not read. No shuffle: a row's result depends on that row only.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(words.vocabulary(path))

    def run(batches):
        own = words.encoder(vocabulary.value)
        for b in text_pieces(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = own.count(texts)
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).transform(arrow, run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
