"""SentencePiece encoding and decoding by a table of distinct chunks.

Tasks take slices of whole texts. A slice is cut into marked words; each distinct one is segmented once, and the ids are
joined back by position (``vocabularies.Pieces``). Nothing is shuffled, and a task that is lost is done again alone."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showerframe.llm.common import table
from showerframe.llm.vocabularies import Pieces, loaded, text_lists, vocabulary_path

#: Characters of a slice.
SLICE = 2_000_000


def _run(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(Pieces, path)
        for batch in batches:
            for i, texts in text_lists(batch.column("text"), limit):
                ids, first = pieces.encode(texts)
                rows = np.split(ids, first[1:-1])
                decoded = pieces.library.decode([r.tolist() for r in rows])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(i, len(texts)),
                     pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())],
                    ["key", "ids", "decoded"])
    return run


def encode(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = SLICE) -> DataFrame:
    """(key, ids, decoded): the ids that the sentencepiece library gives for each whole text, without begin and end, and the
    text that it makes of them.

    A null text is empty and has no ids. Null keys are carried, repeated rows are encoded one by one, an empty table gives no
    rows; other columns are not read. A text longer than ``limit`` is a slice of its own."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(_run(path or vocabulary_path("piece_bpe_32k.model"), limit), "key long, ids array<int>, decoded string")
    return out.withColumnRenamed("key", key)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every text, and the digest of the text they decode to. Null and empty texts have no ids
    and the digest of an empty string."""
    found = encode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
