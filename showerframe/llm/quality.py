"""Quality rules: logistic regression over hashed word and character n-grams, calibrated, with fixed thresholds.

The classifier learns from labelled texts. A text is a vector of two parts, the relative frequencies of its hashed words and
word pairs, and of its hashed four-byte sequences; so its length does not matter. A bounded sample of labelled rows is turned
into sparse counts by all tasks and meets in one task, which fits the weights and, on rows kept apart, the two numbers of a
logistic calibration; only weights come to the driver. Scoring runs over Arrow batches in numpy, together with the base counts."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showerframe.llm.common import BLANK, Slice, byte_symbols, mix64, prefix_hash, ranges_hash, slices, table

BITS = 14
SLICE = 1_000_000  # bytes of text scored together
BUCKETS = 1 << BITS
#: Labelled rows that are learnt from, about; chosen by a hash of the id. A fifth of them calibrates.
TRAIN_ROWS = 6_000
EPOCHS, RATE, DECAY = 12, 0.5, 1e-6
#: A text is kept if the calibrated probability of good quality is at least this.
THRESHOLD = 0.5
MIN_WORDS, REPEAT_PERCENT = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_ODD = np.uint64(0xD6E8FEB86659FD93)


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.float64 if flags.dtype.kind == "f" else np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(owner: np.ndarray, code: np.ndarray) -> np.ndarray:
    """How often each (owner, code) occurs, for every element."""
    if not len(code):
        return np.zeros(0, np.int64)
    order = np.lexsort((code, owner))
    new = np.r_[True, (code[order][1:] != code[order][:-1]) | (owner[order][1:] != owner[order][:-1])]
    group = np.cumsum(new) - 1
    out = np.empty(len(code), np.int64)
    out[order] = np.bincount(group)[group]
    return out


def base_counts(piece: Slice, words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text of a slice."""
    data = piece.data
    n_words = np.diff(words.first)
    chars = per_text(~BLANK[data] & ((data & 0xC0) != 0x80), piece.offsets)
    symbols = per_text(_SYMBOL[data], piece.offsets)
    # lines: cut behind every line feed and at every text's start
    cut = np.zeros(len(data) + 1, bool)
    cut[1:] = data == 10
    cut[piece.offsets] = True
    start = np.flatnonzero(cut[:-1])
    owner = np.searchsorted(piece.offsets, start, "right") - 1
    end = np.r_[start[1:], len(data)] if len(start) else start
    end = end - (data[end - 1] == 10) if len(start) else end
    filled = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, owner = start[filled], end[filled], owner[filled]
    code = ranges_hash(prefix_hash(byte_symbols(data)), start, end)
    order = np.lexsort((code, owner))
    again = np.zeros(len(code), bool)
    again[1:] = (code[order][1:] == code[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    lines = np.bincount(owner[order][again], minlength=len(piece))
    # words under a three-word window that occurs twice or more
    doc = np.repeat(np.arange(len(piece)), n_words)
    w = words.code
    at = np.flatnonzero(doc[:-2] == doc[2:]) if len(w) > 2 else np.zeros(0, int)
    window = mix64(w[at] * _ODD + mix64(w[at + 1] * _ODD + mix64(w[at + 2])))
    hit = at[_repeats(doc[at], window) > 1]
    covered = np.zeros(len(w), bool)
    for k in range(3):
        covered[hit + k] = True
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines,
            "n_repeat_words": per_text(covered, words.first)}


def features(piece: Slice, words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two parts: bucket of every n-gram and where each text's begin. Buckets of the second part follow those of the first."""
    w, first = words.code, words.first
    doc = np.repeat(np.arange(len(piece)), np.diff(first))
    pair = doc[:-1] == doc[1:] if len(w) else np.zeros(0, bool)
    both = np.empty(2 * len(w), np.int64)
    both[0::2] = (w >> np.uint64(64 - BITS)).astype(np.int64)
    both[1::2] = both[0::2]
    if len(w):
        two = (mix64(w[:-1] * _ODD + w[1:]) >> np.uint64(64 - BITS)).astype(np.int64)
        both[1:-1:2] = np.where(pair, two, both[1:-1:2])
    d = piece.data.astype(np.uint32)
    gram = np.zeros(len(d), np.int64)
    if len(d) > 3:
        four = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)
        gram[:-3] = (four * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    for k in range(1, 4):  # sequences that would run into the next text
        late = piece.offsets[1:] - k
        gram[late[late >= piece.offsets[:-1]]] = 0
    return [(both, 2 * first), (gram + BUCKETS, piece.offsets)]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, apart, text) to (label, apart, buckets, values): the sparse vector of each text."""
    for batch in batches:
        for piece in slices(batch.column("text"), SLICE):
            parts = features(piece, piece.words())
            buckets, values = [], []
            for i in range(len(piece)):
                at, share = [], []
                for bucket, first in parts:
                    own = bucket[first[i]:first[i + 1]]
                    name, n = np.unique(own, return_counts=True)
                    at.append(name)
                    share.append(n / max(len(own), 1))
                buckets.append(np.concatenate(at).astype(np.int32))
                values.append(np.concatenate(share).astype(np.float32))
            cut = slice(piece.first, piece.first + len(piece))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label")[cut], batch.column("apart")[cut], pa.array(buckets, pa.list_(pa.int32())),
                 pa.array(values, pa.list_(pa.float32()))], ["label", "apart", "buckets", "values"])


def fit(x: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Weights of all buckets, then bias, then slope and shift of the calibration.

    Frequencies are scaled by the square root, which keeps frequent n-grams from ruling; steps are AdaGrad, text by text in a
    fixed order. Without rows of both labels everything counts as the more frequent label, good quality if there are none."""
    weights = np.zeros(2 * BUCKETS + 3)
    weights[-2] = 1.0
    learn, rest = np.flatnonzero(~apart), np.flatnonzero(apart)
    if len(set(label[learn].tolist())) < 2:
        weights[-3] = 10.0 if not len(learn) or label[learn][0] else -10.0
        return weights
    memory = np.full(2 * BUCKETS + 1, 1e-3)
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for k in order.permutation(learn):
            at, v = x[k]
            z = weights[at] @ v + weights[-3]
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[k]
            step = g * v + DECAY * weights[at]
            memory[at] += step * step
            memory[-1] += g * g
            weights[at] -= RATE * step / np.sqrt(memory[at])
            weights[-3] -= RATE * g / np.sqrt(memory[-1])
    if len(set(label[rest].tolist())) == 2:
        z = np.array([weights[x[k][0]] @ x[k][1] + weights[-3] for k in rest])
        a, b, y = 1.0, 0.0, label[rest]
        # the usual soft targets keep the fit finite when the classes are separable
        y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            s = p * (1 - p) + 1e-9
            hess = np.array([[(s * z * z).sum(), (s * z).sum()], [(s * z).sum(), s.sum()]]) + 1e-6 * np.eye(2)
            da, db = np.linalg.solve(hess, [((p - y) * z).sum(), (p - y).sum()])
            a, b = a - da, b - db
        if a > 0:
            weights[-2:] = a, b
    return weights


def _fit_group(group: pa.Table) -> pa.Table:
    order = np.lexsort((group.column("size").to_numpy(), group.column("hash").to_numpy()))
    buckets, values = (group.column(c).combine_chunks() for c in ("buckets", "values"))
    first, length = buckets.offsets.to_numpy(), np.diff(buckets.offsets.to_numpy())
    flat, share = buckets.values.to_numpy(), np.sqrt(values.values.to_numpy())
    # views of the arrays that came, not lists of numbers
    x = [(flat[first[k]:first[k] + length[k]], share[first[k]:first[k] + length[k]]) for k in order]
    group = group.select(["label", "apart"]).take(pa.array(order))
    weights = fit(x, group.column("label").to_numpy().astype(float), group.column("apart").to_numpy())
    return pa.table({"weights": pa.array([weights.tolist()], pa.list_(pa.float64()))})


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
          rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learnt from the texts of labelled rows (label 1 good, 0 bad); see ``fit``. Null texts, keys and labels are left
    out. Without labelled rows the weights keep every text."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).dropna()
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * (rows / n)))
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text").isNotNull()).join(known, "key")
    vectors = chosen.select("label", (F.pmod(F.xxhash64("key", F.lit(7)), F.lit(5)) == 0).alias("apart"), "text").mapInArrow(
        _vectors, "label int, apart boolean, buckets array<int>, values array<float>")
    vectors = vectors.withColumn("hash", F.xxhash64("buckets", "values")).withColumn("size", F.size("buckets"))
    fitted = vectors.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_fit_group, "weights array<double>").first()
    if fitted is None:
        return fit([], np.zeros(0), np.zeros(0, bool))
    return np.array(fitted[0])


def score(piece: Slice, words, weights: np.ndarray) -> np.ndarray:
    """Calibrated probability of good quality of each text of a slice."""
    z = np.full(len(piece), weights[-3])
    for bucket, first in features(piece, words):
        n = np.diff(first)
        # the square root of a bucket's frequency is shared by its occurrences in the text
        owner = np.repeat(np.arange(len(piece)), n)
        if not len(bucket):
            continue
        name = owner * (2 * BUCKETS) + bucket
        name.sort()
        new = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        count = np.diff(np.r_[new, len(name)])
        owner, bucket = np.divmod(name[new], 2 * BUCKETS)
        part = weights[bucket] * np.sqrt(count / n[owner])
        z += np.bincount(owner, part, len(piece))
    return 1 / (1 + np.exp(-np.clip(weights[-2] * z + weights[-1], -30, 30)))


def judged(piece: Slice, weights: np.ndarray) -> dict[str, np.ndarray]:
    words = piece.words()
    out = base_counts(piece, words)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    out["probability"] = score(piece, words, weights)
    out["kept"] = ~out["base_failed"] & (out["probability"] >= THRESHOLD)
    return out


_SCHEMA = ("key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, probability double")


def judge(docs: DataFrame, weights: np.ndarray, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts, verdict and probability for every row of ``docs``. A null text counts as empty: it fails the base rules.
    Null keys are carried, repeated rows judged one by one, other columns not read, texts read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column("text"), SLICE):
                out = judged(piece, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(piece.first, len(piece)), *(pa.array(out[c]) for c in names[1:])], names)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(
        run, _SCHEMA).withColumnRenamed("key", key)


def keep_good(docs: DataFrame, weights: np.ndarray, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [judged(piece, shared.value)["kept"] for piece in slices(batch.column(text), SLICE)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
