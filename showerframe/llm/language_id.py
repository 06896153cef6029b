"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language are summed by Spark from labelled texts (all partitions add to one small table of languages
times buckets, which is the model). The matrix of log probabilities is broadcast, its size fixed by the parameters, and
batches are scored in numpy: each text is the sparse row of its n-grams, its score their summed rows of the matrix."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showerframe.llm.common import fold, table

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: About so many labelled rows are learnt from, chosen by a hash of the id: enough for the counts to settle.
TRAIN_ROWS = 20_000
PIECE_CHARS = 500_000
_LETTER = re.compile(r"[^\W\d_]")


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts with their n-gram buckets: first and last text, bucket and text number of every n-gram."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= PIECE_CHARS):
            size += len(texts[j] or "")
            j += 1
        low = [(t or "").lower() for t in texts[i:j]]
        chars = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
        grams, owners = [], []
        for order in ORDERS:
            n = len(chars) - order + 1
            if n <= 0:
                break
            code = np.full(n, order, np.uint32)
            for k in range(order):
                code = code * np.uint32(0x01000193) + chars[k:k + n]
            code ^= code >> np.uint32(15)
            code *= np.uint32(0x9E3779B1)
            bucket = (code >> np.uint32(17)).astype(np.int32)
            inside = owner[:n] == owner[order - 1:]
            if inside.all():
                grams.append(bucket)
                owners.append(owner[:n])
            else:
                grams.append(bucket[inside])
                owners.append(owner[:n][inside])
        yield i, j, grams, owners
        i = j


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) to (lang, bucket, n), summed over the partition; bucket -1 counts texts."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for i, j, grams, owners in _pieces(batch.column("text").to_pylist()):
            names = sorted(set(langs[i:j]))
            number = np.array([names.index(x) for x in langs[i:j]])
            total = np.zeros(len(names) * BUCKETS, np.int64)
            for bucket, owner in zip(grams, owners):
                total += np.bincount(number[owner] * BUCKETS + bucket, minlength=len(total))
            for k, name in enumerate(names):
                own = counts.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                own[:BUCKETS] += total[k * BUCKETS:(k + 1) * BUCKETS]
                own[BUCKETS] += int((number == k).sum())
    for name, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "bucket": np.where(at == BUCKETS, -1, at).astype(np.int32),
                                          "n": own[at]})


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id",
          rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities (BUCKETS, languages) and log priors, from rows with text and language."""
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * (rows / n)))
    counted = (known.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
               .mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    found = counted.toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    number = np.array([names.index(x) for x in found.column("lang").to_pylist()], int)
    bucket, count = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    table_of = np.zeros((BUCKETS, len(names)))
    grams = bucket >= 0
    table_of[bucket[grams], number[grams]] = count[grams]
    texts = np.zeros(len(names))
    texts[number[~grams]] = count[~grams]
    logs = np.log((table_of + SMOOTHING) / (table_of.sum(0) + SMOOTHING * BUCKETS))
    return names, logs.astype(np.float32), np.log(texts / max(texts.sum(), 1))


def predict(docs: DataFrame, model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row: the language of highest posterior probability, ties to the first name, and that
    probability. ``und`` with score 0 for a text that is null or has no letter, or if nothing was learnt. Null keys are
    carried, repeated rows answered one by one, other columns not read, texts read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs, prior = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            for i, j, grams, owners in _pieces(texts) if names else ():
                total = np.tile(prior, (j - i, 1))
                for bucket, owner in zip(grams, owners):
                    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
                    if len(first):
                        for k in range(len(names)):
                            total[owner[first], k] += np.add.reduceat(logs[:, k][bucket], first, dtype=np.float64)
                top = total.max(1, keepdims=True)
                best[i:j] = total.argmax(1)
                score[i:j] = 1 / np.exp(total - top).sum(1)
            known = np.array([bool(names and t and _LETTER.search(t)) for t in texts], bool)
            label = [names[b] if ok else "und" for b, ok in zip(best, known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(label, pa.string()), pa.array(np.where(known, score, 0.0))],
                ["key", "lang_pred", "score"])

    out = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(
        run, "key long, lang_pred string, score double")
    return out.withColumnRenamed("key", key)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold("doc_id", 5) > 0))
    return predict(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
