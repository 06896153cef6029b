"""Suffix-array dedup: repeated byte strings by sampling suffixes, sorting the sample, and merging the rest.

As in the difference-cover algorithm, only sampled suffixes are sorted by their text, and any other suffix is ordered by the
bytes up to the next sample and the rank of that sample. The cover is the content-defined one of ``repeats``: two equal
windows are sampled at the same offset. A sample is first known by the name of the bytes that all its windows contain;
samples whose name is unique are settled, the others are sorted by name and the bytes behind, named by rank for every length,
and the remaining suffixes are merged by (bytes before the sample, name of the sample) and compared with their neighbours."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showerframe.llm import repeats
from showerframe.llm.common import byte_symbols, longer_hash, mix64, mixed, scratch, slices, table
from showerframe.llm.repeats import Rule

RULE = Rule(words=False, length=400, cover=128, gram=24)
#: The same, and strings of 200 bytes, which passages of over WORDS words have unless their words are very short.
BOTH = Rule(words=False, length=200, cover=128, gram=24, longer=RULE.length)
#: Finds every passage of over WORDS words: with the blanks between, 51 words of one letter have 101 bytes.
PASSAGES, WORDS = Rule(words=False, length=100, cover=64, gram=16), 50
#: Suffixes that are compared with their neighbours at once.
ROWS = 4_096


def order_of(core: np.ndarray, right: list[bytes], unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled suffixes in sorted order, and how many units each shares with the one before: -1 if the names differ."""
    names = core.tolist()
    order = np.array(sorted(range(len(names)), key=lambda i: (names[i], right[i])), np.int64)
    width = max((len(x) for x in right), default=0)
    size = np.array([len(right[i]) for i in order], np.int64)
    common = np.full(len(order), -1, np.int64)
    for first in range(0, len(order) - 1, ROWS):  # every suffix with the next one
        some = order[first:first + ROWS + 1]
        length = size[first:first + ROWS + 1]
        flat = np.zeros((len(some), width + 1), np.uint8)
        if width:
            flat[np.arange(width + 1) < length[:, None]] = np.frombuffer(b"".join(right[i] for i in some), np.uint8)
        differs = flat[1:] != flat[:-1]
        differs[:, -1] = True
        shared = np.minimum(differs.argmax(1), np.minimum(length[1:], length[:-1])) // unit
        common[first + 1:first + len(some)] = np.where(core[some][1:] == core[some][:-1], shared, -1)
    return order, common


def merge_suffixes(rule: Rule, core: np.ndarray, low: np.ndarray, high: np.ndarray, left: list[bytes],
                   right: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(member, first offset, last offset) of every run of repeated windows of some cores' members, for each length of the rule.
    All members go through the offsets in step, one bit for a window: a core of thousands has millions of windows."""
    order, common = order_of(core, right, 1)
    high = high[order]
    size = np.array([len(left[i]) for i in order], np.int64)
    reach = np.array([len(right[i]) for i in order], np.int64)
    # the text may end before a longer window does
    lows = [np.maximum(low[order], length - rule.core - reach) for length in rule.lengths]
    hits = [np.zeros((len(order), rule.cover), bool) for _ in rule.lengths]
    data = np.frombuffer(b"".join(left[i] for i in order), np.uint8)
    ends = np.cumsum(size)
    before = np.zeros((2, len(order)), np.uint64)  # of the bytes between a window's start and the core
    for offset in range(int(high.max(initial=-1)) + 1):
        code = mixed(before)
        for length, least, hit in zip(rule.lengths, lows, hits):
            name = np.cumsum(common < length - rule.core - offset)
            at = np.flatnonzero((least <= offset) & (offset <= high))
            value = mix64(code[at] + mix64(name[at].astype(np.uint64)))
            sort = np.argsort(value, kind="stable")
            equal = value[sort][1:] == value[sort][:-1]
            if len(at):
                hit[at[sort[np.r_[False, equal] | np.r_[equal, False]]], offset] = True
        more = np.flatnonzero(size > offset)
        before[:, more] = longer_hash(before[:, more], byte_symbols(data[ends[more] - offset - 1]))
    return [_runs_of(order, hit) for hit in hits]


def _runs_of(order: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, first, last) of the runs in each row."""
    inner = np.zeros_like(hit)
    inner[:, 1:] = hit[:, 1:] & hit[:, :-1]
    row, first = np.nonzero(hit & ~inner)
    inner[:, :-1] = inner[:, 1:]
    inner[:, -1:] = False
    return order[row], first, np.nonzero(hit & ~inner)[1]


def stretches(lows, highs) -> list[tuple[int, int]]:
    """Runs of windows, as (first, last start), that follow one another as one."""
    out: list[list[int]] = []
    for low, high in sorted(zip(lows, highs)):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def long_runs(rule: Rule, data: bytes, lows, highs) -> list[tuple[int, int]]:
    """The runs, as (first, last start), that belong to a stretch of consecutive repeated windows of at least ``RULE.length``
    bytes or over ``WORDS`` words, those cut at its ends included."""
    return [(a, b) for a, b in stretches(lows, highs)
            if b + rule.length - a >= RULE.length or len(data[a:b + rule.length].split()) > WORDS]


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", chars: str = "n_chars",
                   rule: Rule = RULE) -> DataFrame:
    """``docs`` with every byte under a repeated window of ``rule`` (in bytes) removed from its text, if consecutive such windows
    reach the length of ``RULE`` or over ``WORDS`` words; all other columns and rows unchanged. A
    character that is covered only in part stays; a null text stays null. ``chars``, if it is a column, becomes the new
    number of code points wherever the text changed."""
    spark = docs.sparkSession
    ws = scratch(spark)
    special = repeats.spans_by_name(ws, rule, merge_suffixes, docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    # the text moves once, inside its row
    marked = repeats.named(rule, docs.select(row, F.col(text).alias("text"))).drop("text")
    joined = marked.join(special.withColumnRenamed("name", "special"), F.col("name") == F.col("special"), "left")
    cut = joined.select("row", F.col("row").getField(text).alias("text"), "copied", "lows", "highs").mapInArrow(
        _cut_text(rule), f"row {joined.schema['row'].dataType.simpleString()}, new_text string, new_size long")
    columns = []
    for c in docs.columns:
        value = F.col("row").getField(c)
        if c == text:
            value = F.coalesce("new_text", value)
        elif c == chars:
            value = F.coalesce(F.col("new_size").cast(docs.schema[c].dataType), value)
        columns.append(value.alias(c))
    return cut.select(*columns)


def _cut_text(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copied, lows, highs = (batch.column(c) for c in ("copied", "lows", "highs"))
            for piece in slices(batch.column("text")):  # what comes out is no larger than a slice either
                texts, sizes = [], []
                for i in range(len(piece)):
                    k = piece.first + i
                    data = piece.text(i)
                    if copied[k].as_py() and (len(data) >= RULE.length or len(data.split()) > WORDS and rule.length < RULE.length):
                        spans = [(0, len(data))]
                    elif low := lows[k].as_py():
                        found = long_runs(rule, data, low, highs[k].as_py())
                        spans = repeats.whole_characters(data, repeats.merged(rule, *zip(*found))) if found else []
                    else:
                        spans = []
                    if spans:
                        left = repeats.kept_bytes(rule, piece, i, spans)[0].decode("utf-8", "replace")
                        texts.append(left)
                        sizes.append(len(left))
                    else:
                        texts.append(None)
                        sizes.append(None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(piece.first, len(piece)), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())],
                    ["row", "new_text", "new_size"])
    return run


def _reported(rule: Rule):
    last = replace(rule, length=rule.lengths[-1], longer=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copied, lows, highs = (batch.column(c) for c in ("copied", "lows", "highs"))
            low_longs, high_longs = (batch.column(c) for c in ("low_longs", "high_longs")) if rule.longer else (lows, highs)
            for piece in slices(batch.column("text")):  # what comes out is no larger than a slice either
                out: dict[str, list] = {c: [] for c in ("n", "n_removed", "n_spans", "kept_sha256", "kept", "n_passages")}
                for i in range(len(piece)):
                    k, data = piece.first + i, piece.text(i)
                    low = low_longs[k].as_py()
                    if copied[k].as_py() and len(data) >= last.length:
                        spans = [(0, len(data))]
                    else:
                        spans = repeats.merged(last, low, high_longs[k].as_py()) if low else []
                    if copied[k].as_py():
                        passages = int(len(data) >= rule.length and len(data.split()) > WORDS)
                    else:
                        passages = sum(len(data[a:b + rule.length].split()) > WORDS
                                       for a, b in stretches(lows[k].as_py() or (), highs[k].as_py() or ()))
                    left, gone = repeats.kept_bytes(rule, piece, i, spans)
                    shown = repeats.kept_bytes(rule, piece, i, repeats.whole_characters(data, spans))[0] if spans else data
                    for c, value in zip(out, (len(data), gone, len(spans), hashlib.sha256(left).hexdigest(), shown.decode("utf-8", "replace"),
                                              passages)):
                        out[c].append(value)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(piece.first, len(piece)), *(pa.array(v) for v in out.values())],
                                                 ["key", *out])
    return run


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rule: Rule = BOTH) -> DataFrame:
    """(key, n, n_removed, n_spans, kept_sha256, kept, n_passages) for every row of ``docs``: bytes, bytes under repeated strings,
    their maximal runs, digest of the bytes that remain, and these as text, where a character that is covered in part is shown.
    ``n_passages``: stretches of over ``WORDS`` words that consecutive repeated strings of the rule's shorter length cover.

    A null text is empty; null keys are carried; repeated rows and equal texts repeat each other, so all of them go if they are
    long enough; there are no ties, since strings are judged on the input; an empty table gives no rows; other columns are not
    read."""
    ws = scratch(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    special = repeats.spans_by_name(ws, rule, merge_suffixes, source)
    joined = repeats.named(rule, source).join(special.withColumnRenamed("name", "special"), F.col("name") == F.col("special"), "left")
    out = joined.drop("name", "special").mapInArrow(
        _reported(rule), "key long, n long, n_removed long, n_spans long, kept_sha256 string, kept string, n_passages long")
    return out.withColumnRenamed("key", key)


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings of 400 bytes, in numbers, as a digest and as text, and how many
    repeated passages of over 50 words it has. Null and empty texts have zeros; equal texts of 400 bytes or more, repeated rows
    included, are removed whole."""
    out = report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", F.col("kept").alias("text"), "n_passages")
