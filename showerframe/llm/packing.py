"""Best-fit packing by exact-complement hashing.

Tasks tokenize the texts and cut the long ones; what remains to be packed is the number of pieces of every length, a table of
at most ``SIZE`` rows whatever the corpus. On it the plan is made: a hash index of the available lengths, of the sums of two and
of three lengths finds combinations that exactly fill the gap behind a piece, as often as the scarcest of them lasts; what
is left goes to the tightest gap that fits. The plan is a list of patterns (lengths of a sequence, how often). Every pattern
uses up a length or a kind of gap, so the list, too, is bounded by ``SIZE`` and not by the corpus, and is broadcast.

Pieces of a length are numbered with counts per (length, part) first, so that a common length never meets in one task, and
find their sequence by number in the plan."""
from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from showerframe.llm.common import partitions, scratch, table
from showerframe.llm.vocabularies import BytePair, loaded, text_lists, vocabulary_path

SIZE = 2048
END = 0
PIECE_CHARS = 2_000_000


def _pieces(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(BytePair, path)
        for batch in batches:
            keys = batch.column("key")
            for i, texts in text_lists(batch.column("text"), PIECE_CHARS):
                ids, first = tokens.encode(texts, special=True)
                owner, piece, start, length, crc = [], [], [], [], []
                for k in range(len(texts)):
                    own = np.append(ids[first[k]:first[k + 1]], np.uint32(END)).astype("<u4")
                    cuts = [*range(len(own) % size or size, len(own) + 1, size)] if len(own) > size else [len(own)]
                    low = 0
                    for number, high in enumerate(cuts):
                        owner.append(i + k)
                        piece.append(number)
                        start.append(low)
                        length.append(high - low)
                        crc.append(zlib.crc32(own[low:high].tobytes()))
                        low = high
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["key", "piece", "start", "length", "ids_crc32"])
    return run


def patterns(available: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Lengths of a sequence and how many such sequences, for pieces ``available`` (length to number).

    From the longest length down: find one, two or three lengths whose sum is exactly the gap, longest first, and use the
    combination as often as it lasts. Then the rest, longest first, always into the tightest gap that fits."""
    left = {n: c for n, c in sorted(available.items()) if c > 0}
    out: list[tuple[tuple[int, ...], int]] = []

    def sums() -> tuple[int, int, int]:
        """Sums of one, two and three available lengths, as bit sets."""
        one = sum(1 << n for n in left)
        two = three = 0
        for n in left:
            two |= one << n
        for n in left:
            three |= two << n
        return one, two, three

    def exactly(gap: int, n: int, limit: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        """``n`` available lengths with sum ``gap``, the longest first, none above ``limit``."""
        if not reach[n - 1] >> gap & 1:
            return None
        if n == 1:
            return (gap,) if gap <= limit and left.get(gap, 0) > taken.count(gap) else None
        for part in [k for k in reversed(left) if k <= limit and k < gap]:
            if left[part] > taken.count(part):
                rest = exactly(gap - part, n - 1, part, (*taken, part))
                if rest:
                    return (part, *rest)
        return None

    pending: dict[int, int] = {}
    reach = sums()
    for length in sorted(left, reverse=True):
        while left.get(length, 0):
            gap = size - length
            found: tuple[int, ...] | None = () if not gap else None
            for n in (1, 2, 3):
                found = found if found is not None else exactly(gap, n, min(gap, length), (length,))
            before = len(left)
            if found is None:
                pending[length] = left.pop(length)
            else:
                pattern = (length, *found)
                times = min(left[p] // pattern.count(p) for p in set(pattern))
                for p in pattern:
                    left[p] -= times
                    if not left[p]:
                        del left[p]
                out.append((pattern, times))
            if len(left) < before:
                reach = sums()
    # best fit: kinds of open sequences by gap
    gaps: dict[int, list[list]] = defaultdict(list)
    for length in sorted(pending, reverse=True):
        n = pending[length]
        while n:
            fit = min((g for g in gaps if g >= length), default=None)
            if fit is None:
                # as many new sequences as the pieces need if each takes as many of them as fit
                each = size // length
                if n >= each:
                    many, pattern = n // each, (length,) * each
                else:
                    many, pattern = 1, (length,) * n
                n -= many * len(pattern)
                gaps[size - length * len(pattern)].append([pattern, many])
                continue
            kind = gaps[fit][-1]
            if kind[1] <= n:
                gaps[fit].pop()
                times = kind[1]
            else:
                times = n
                kind[1] -= n
            if not gaps[fit]:
                del gaps[fit]
            n -= times
            gaps[fit - length].append([(*kind[0], length), times])
    return out + [(tuple(p), n) for kinds in gaps.values() for p, n in kinds]


class Plan:
    """Where the k-th piece of a length goes."""

    def __init__(self, found: list[tuple[tuple[int, ...], int]]):
        used: dict[int, int] = defaultdict(int)
        rows, sequence = [], 0
        for pattern, times in found:
            offset = 0
            for length in pattern:
                rows.append((length, used[length], sequence, offset))
                used[length] += times
                offset += length
            sequence += times
        self.sequences = sequence
        rows.sort()
        self._key = np.array([(r[0] << 44) + r[1] for r in rows], np.int64)
        self._from, self._sequence, self._offset = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self._key, (length << 44) + rank, "right") - 1
        return self._sequence[row] + rank - self._from[row], self._offset[row]


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SIZE, path: str | None = None) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs``.

    A null text is empty and has one piece, its end token. Null keys are carried; repeated rows are packed one by one; an
    empty table has no pieces; other columns are not read."""
    spark = docs.sparkSession
    ws = scratch(spark)
    pieces = ws.save(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(
        _pieces(path or vocabulary_path(), size), "key long, piece int, start long, length long, ids_crc32 long"), "pieces")
    parts = 4 * partitions(spark)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("key", "piece"), F.lit(parts)).cast("int"))
    counts = ws.save(dealt.groupBy("length", "part").agg(F.count("*").alias("c")), "counts")
    available = {r["length"]: r["c"] for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}
    plan = spark.sparkContext.broadcast(Plan(patterns(available, size)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "part").orderBy("key", "piece", "ids_crc32", "start")
    ranked = (dealt.join(starts, ["length", "part"])
              .withColumn("rank", F.col("before") + F.row_number().over(own) - 1)
              .select("key", "piece", "start", "length", "ids_crc32", "rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.place(*(batch.column(c).to_numpy() for c in ("length", "rank")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                             [*batch.schema.names[:5], "sequence_id", "offset"])

    out = ranked.mapInArrow(placed, "key long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("key", key)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places. A null or empty text is one piece, its end token; rows with equal ids are packed
    one by one, ties between equal lengths go by id, piece and checksum; an empty table gives no rows, other columns are not read."""
    return pack(table(spark, sf_dir, "documents"))
