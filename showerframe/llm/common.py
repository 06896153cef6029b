"""Shared helpers: tables, written intermediate results, and vectorised hashing of words and bytes.

Tasks work on Arrow batches that are cut into slices of a few MB of text (``slices``), so that the arrays of a task stay
small whatever the batch holds. A slice is one byte array with the offsets of its texts (``Slice``); words are found and
hashed for the whole slice at once."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showerframe.workspace import Workspace

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 1_000_000
#: Bytes of an Arrow batch that ``small_batches`` allows.
BATCH_BYTES, _BATCH = 8_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"
#: White space of the word rule: blank, and the control characters from tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

_BASE = 0x9E3779B97F4A7C15
_MIX = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict = {}
_BITS, _PRIME = np.uint64(31), np.uint64(2**31 - 1)
_PRIME_BASES = (1_180_591_621, 716_146_943)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> Workspace:
    """Written tables of one operator, in the folder that all executors share."""
    ws = Workspace(spark)
    for kept in _collectors:
        kept.append(ws)
    return ws


_collectors: list[list[Workspace]] = []


@contextmanager
def collecting() -> Iterator[list[Workspace]]:
    """The workspaces that operators open meanwhile, for a caller who knows when their results are no longer read."""
    opened: list[Workspace] = []
    _collectors.append(opened)
    try:
        yield opened
    finally:
        _collectors.remove(opened)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that reach a Python worker by bytes, too: 10,000 rows may be 40 MB of text, of which a task holds
    several copies. A smaller bound of the session's own stays."""
    own = spark.conf.get(_BATCH, None)
    if own is None or not own.isdigit() or not 0 < int(own) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids count as remainder -1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(-1))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base of ``sum_prefix``, and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def sum_prefix(symbols: np.ndarray) -> np.ndarray:
    """Like ``prefix_hash``, cheaper, modulo 2**64: equal ranges have equal sums, but some long arrangements of two symbols have,
    too. Only good to choose among ranges, not to tell them apart."""
    up, _ = powers(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[:len(symbols)], out=out[1:])
    return out


def sums_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(_BASE))


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo ``_PRIME``, or a little above; ``x`` is changed."""
    high = x >> _BITS
    x &= _PRIME
    x += high
    return x


def prime_powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both bases, the first ``n`` powers and inverse powers modulo ``_PRIME``."""
    if len(_powers.get(("prime", 0, 0), ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate(_PRIME_BASES):
            for way, factor in enumerate((base, pow(base, -1, int(_PRIME)))):
                p, done = np.ones(size, np.uint64), 1
                while done < size:
                    more = min(done, size - done)
                    p[done:done + more] = p[:more] * np.uint64(pow(factor, done, int(_PRIME))) % _PRIME
                    done += more
                _powers["prime", k, way] = p.astype(np.uint32)
    return [(_powers["prime", k, 0], _powers["prime", k, 1]) for k in range(2)]


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of symbol times power of the base, modulo a prime, for two independent bases that read different halves of the
    symbols; ``ranges_hash`` reads the hash of any range from them."""
    out = np.zeros((2, len(symbols) + 1), np.uint64)
    for k, (up, _) in enumerate(prime_powers(len(symbols) + 1)):
        x = symbols >> np.uint64(32) if k else symbols & _PRIME
        x &= _PRIME
        x *= up[:len(symbols)]
        np.cumsum(_folded(x), out=out[k, 1:])
        _folded(_folded(out[k]))
    return out


def ranges_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of symbol ranges, equal for equal ranges wherever they stand. Different ranges have 62 independent bits to differ
    in, whatever their arrangement."""
    halves = []
    for k, (_, down) in enumerate(prime_powers(prefix.shape[1])):
        x = prefix[k][end] + (_PRIME + _PRIME)
        x -= prefix[k][start]
        _folded(x)
        x *= down[start]
        _folded(_folded(x))
        x -= _PRIME * (x >= _PRIME)
        halves.append(x)
    halves[0] <<= np.uint64(31)
    halves[0] |= halves[1]
    halves[0] += (end - start).astype(np.uint64) * np.uint64(_BASE)
    return mix64(halves[0])


def longer_hash(parts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The two remainders of ranges after one more symbol each; ``mixed`` makes a hash of them. For ranges that grow in step, where
    prefix sums of everything would not fit."""
    halves = (symbols & _PRIME, (symbols >> np.uint64(32)) & _PRIME)
    return np.stack([(h * np.uint64(base) + x) % _PRIME for h, base, x in zip(parts, _PRIME_BASES, halves)])


def mixed(parts: np.ndarray) -> np.ndarray:
    return mix64((parts[0] << _BITS) | parts[1])


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _MIX[data]


@dataclass
class Slice:
    """Some texts of a batch: their rows, all bytes, and where each text starts (one more entry than texts)."""
    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def words(self, lower: bool = False) -> "Words":
        """All words ``[^\\x20\\x09-\\x0D]+`` of the slice; ``lower`` folds A-Z before hashing."""
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        inside = ~BLANK[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        prefix = prefix_hash(byte_symbols(data))
        first = np.searchsorted(start, self.offsets)
        return Words(start, end, ranges_hash(prefix, start, end), first)


@dataclass
class Words:
    """Words of a slice: byte range, hash, and the number of the first word of each text (one more than texts)."""
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    first: np.ndarray


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copying; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(column, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a column in row order, cut into slices of about ``limit`` bytes."""
    n = len(column)
    if not n:
        return
    data, offsets = utf8(column)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Slice(i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        i = j


def new_name() -> str:
    return uuid.uuid4().hex
