"""Codes of vectors by small codebooks, the nearest entry found with a GNAT.

Components become whole numbers, so every distance is exact. ``Gnat`` is a geometric near-neighbour access tree over the
entries of one codebook: a node has split points, every other entry belongs to the nearest of them, and each split point keeps
the range of its distances to the entries of each child. A query measures the split points of a node; a child is left out
when, for some split point, its range lies farther from the query's distance than the best entry so far. Distances are
square roots, so ranges are widened and distances rounded to the safe side before they are compared, a child that could hold a
tie stays, and whatever is reached is measured in whole numbers: the answer is the exact nearest entry, ties to the lower
index.

One round is one job: tasks assign their rows and send sums and counts per (part, entry, component), at most some thousand
rows each, which Spark adds up. Codebooks are a few kilobytes whatever the table holds."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showerframe.llm.common import scratch, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Sums travel as digits of this many bits, so that components of any size are added exactly.
DIGIT = 40
#: Components below this are squared and summed in 64-bit numbers; larger ones in Python's.
PLAIN = 1 << 24
#: Relative widening of distances, far above the rounding of a square root.
SLACK = 2.0 ** -40
ROWS = 50_000


@dataclass
class _Node:
    entries: np.ndarray                      # numbers of the split points
    children: list["_Node | None"] = field(default_factory=list)
    low: np.ndarray | None = None            # low[i, j]: smallest distance from split point i to the entries of child j
    high: np.ndarray | None = None


class Gnat:
    """Exact nearest entries for many queries at once. ``entries``: rows of whole numbers."""

    def __init__(self, entries: np.ndarray, degree: int = 4):
        self.entries, self._degree = entries, degree
        self._root = self._build(np.arange(len(entries)))
        self.measured = 0

    def _squares(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = a - b
        return (d * d).sum(axis=-1)

    @staticmethod
    def _root_of(squares: np.ndarray) -> np.ndarray:
        if squares.dtype == object:          # beyond 2**1000 a smaller root keeps what a larger one would keep
            roots = [math.sqrt(x) if x < 1 << 1000 else float(min(math.isqrt(x), 1 << 1000)) for x in squares.ravel().tolist()]
            return np.array(roots, np.float64).reshape(squares.shape)
        return np.sqrt(squares.astype(np.float64))

    def _build(self, members: np.ndarray) -> _Node:
        if len(members) <= self._degree:
            return _Node(members)
        splits = [members[0]]                # far apart: each next one is farthest from those before
        near = self._squares(self.entries[members], self.entries[members[0]])
        while len(splits) < self._degree:
            nxt = members[int(np.argmax(near))]
            if nxt in splits:                # only copies of split points are left
                break
            splits.append(nxt)
            near = np.minimum(near, self._squares(self.entries[members], self.entries[nxt]))
        rest = members[~np.isin(members, splits)]
        far = np.stack([self._squares(self.entries[rest], self.entries[s]) for s in splits], 1)
        home = far.argmin(axis=1)
        node = _Node(np.array(splits))
        node.low, node.high = np.full((len(splits),) * 2, np.inf), np.full((len(splits),) * 2, -np.inf)
        for j in range(len(splits)):
            own = rest[home == j]
            if len(own) and len(splits) == 1:
                node.children.append(_Node(own))
            else:
                node.children.append(self._build(own) if len(own) else None)
            if len(own):
                d = self._root_of(far[home == j])
                node.low[:, j], node.high[:, j] = d.min(axis=0) * (1 - SLACK), d.max(axis=0) * (1 + SLACK)
        return node

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest entry of every query; equal distances go to the lower number."""
        self._queries = queries
        big = queries.dtype == object
        self._best = np.full(len(queries), None, object) if big else np.full(len(queries), np.iinfo(np.int64).max)
        self._number = np.full(len(queries), len(self.entries), np.int64)
        if len(queries):
            self._visit(self._root, np.arange(len(queries)))
        return self._number, self._best

    def _measure(self, entry: int, who: np.ndarray) -> np.ndarray:
        self.measured += len(who)
        squares = self._squares(self._queries[who], self.entries[entry])
        number, best = self._number[who], self._best[who]
        fresh = number == len(self.entries)
        closer = fresh.copy()
        old = np.flatnonzero(~fresh)
        closer[old] = (squares[old] < best[old]) | ((squares[old] == best[old]) & (entry < number[old]))
        self._best[who[closer]], self._number[who[closer]] = squares[closer], entry
        return squares

    def _visit(self, node: _Node, who: np.ndarray) -> None:
        d = np.stack([self._root_of(self._measure(int(e), who)) for e in node.entries], 1)
        if node.low is None:
            for child in node.children:
                if child is not None:
                    self._visit(child, who)
            return
        for j, child in enumerate(node.children):
            if child is None:
                continue
            reach = self._root_of(self._best[who]) * (1 + SLACK)
            gap = np.maximum(node.low[:, j] - d * (1 + SLACK), d * (1 - SLACK) - node.high[:, j]).max(axis=1)
            stay = ~(gap > reach)            # only what is surely farther than the best so far goes
            if stay.any():
                self._visit(child, who[stay])


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite numbers, exactly: 64-bit numbers if all are small, else Python's."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if np.abs(scaled).max(initial=0) < PLAIN:
        return scaled.astype(np.int64)
    exact = [math.floor(x * SCALE) if abs(x) < 2.0 ** 900 else int(x) * SCALE for x in values.astype(np.float64).ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def _book(rows: list[list[int]], width: int) -> np.ndarray:
    large = any(abs(x) >= PLAIN for r in rows for x in r)
    return np.array(rows, object if large else np.int64).reshape(len(rows), width)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _assign(books: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Entry per row and part, squared distances per part, and the parts themselves."""
    cut = np.split(whole(values), len(books), axis=1)
    number, squares = [], []
    for book, part in zip(books, cut):
        if part.dtype == object or book.dtype == object:
            part, book = part.astype(object), book.astype(object)
        n, s = Gnat(book).nearest(part)
        number.append(n)
        squares.append(s)
    return np.stack(number, 1), squares, cut


def _sums(books: list[np.ndarray], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                column = batch.column("v").slice(i, ROWS)
                number, _, cut = _assign(books, _vectors(column, dims))
                for p, part in enumerate(cut):
                    for e in np.unique(number[:, p]).tolist():
                        own = part[number[:, p] == e]
                        old = total.setdefault((p, e), [0, [0] * part.shape[1]])
                        old[0] += len(own)
                        old[1] = [x + int(y) for x, y in zip(old[1], own.sum(axis=0))]
        rows = []
        for (p, e), (count, sums) in total.items():
            rows.append((p, e, -1, 0, count))
            for k, s in enumerate(sums):
                digit, sign, s = 0, (1 if s >= 0 else -1), abs(s)
                while s:
                    rows.append((p, e, k, digit, sign * (s & (1 << DIGIT) - 1)))
                    s >>= DIGIT
                    digit += 1
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(),) * 4 + (pa.int64(),))],
                                         ["part", "entry", "place", "digit", "value"])
    return run


def _trained(kept: DataFrame, books: list[np.ndarray], dims: int, rounds: int) -> list[np.ndarray]:
    for _ in range(rounds):
        sums = (kept.select("v").mapInArrow(_sums(books, dims), "part int, entry int, place int, digit int, value long")
                .groupBy("part", "entry", "place", "digit").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")))
        found: dict[tuple[int, int, int], int] = {}
        for r in sums.collect():             # at most entries x (dims + parts) numbers of a few digits
            place = (r["part"], r["entry"], r["place"])
            found[place] = found.get(place, 0) + (int(r["value"]) << (DIGIT * r["digit"]))
        new = []
        for p, book in enumerate(books):
            rows = []
            for e in range(len(book)):
                n = found.get((p, e, -1), 0)
                rows.append([found.get((p, e, k), 0) // n for k in range(book.shape[1])] if n else [int(x) for x in book[e]])
            new.append(_book(rows, book.shape[1]))
        books = new
    return books


def _codes(books: list[np.ndarray], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                rows = batch.slice(i, ROWS)
                number, squares, _ = _assign(books, _vectors(rows.column("v"), dims))
                code = [r.tobytes().hex() for r in number.astype(np.uint8)]
                error = sum(s.astype(object) if any(x.dtype == object for x in squares) else s for s in squares)
                errors = pa.array([int(e) if e < 1 << 63 else None for e in error] if error.dtype == object else error, pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("label"), pa.array(code, pa.string()), errors],
                                                 ["key", "label", "code", "error"])
    return run


def compress(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((key, label, code, error), codebooks) of all rows whose vector is whole.

    Rows whose vector is null or has null or non-finite components are dropped, and so are those whose length is not that
    of the first kept row or cannot be cut into ``parts``: they have no place in the codebooks. The first codebook is made of
    the ``entries`` first rows by key (null keys last, then by vector), or of all if there are fewer; repeated rows are rows of
    their own. An error beyond 64 bits is null. An empty table gives no rows and empty codebooks. Other columns are not read."""
    if entries > 256:
        raise ValueError("an entry number has two hex digits")
    spark = rows.sparkSession
    element = rows.schema[vector].dataType.elementType.simpleString()
    element = element if element in ("float", "double") else "double"
    v = F.col(vector).cast(f"array<{element}>")
    # NaN and the infinities are the only numbers that are not below the largest in size.
    fine = v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    kept = scratch(spark).save(rows.filter(fine).select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), v.alias("v")), "vectors")
    first = kept.orderBy(F.col("key").asc_nulls_last(), "v").limit(1).collect()
    dims = len(first[0]["v"]) if first and len(first[0]["v"]) % parts == 0 else 0
    if dims == 0:
        return kept.filter("false").select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), [np.zeros((0, 0), np.int64)] * parts
    kept = kept.filter(F.size("v") == dims)
    start = kept.orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).collect()
    cut = np.split(whole(np.array([r["v"] for r in start], np.float64)), parts, axis=1)
    books = _trained(kept, [_book([[int(x) for x in r] for r in c], dims // parts) for c in cut], dims, rounds)
    schema = f"key long, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    return kept.mapInArrow(_codes(books, dims), schema), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, error, summed error of the label and digest of the codebooks of every whole vector of ``embeddings``. Rows with a
    null label share one sum; repeated rows count each; a sum beyond 64 bits is null. Labels are summed first and written, so that their size is known to the
    planner and a hot label can be split."""
    ws = scratch(spark)
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    codes = ws.save(codes, "codes")
    labels = ws.save(codes.groupBy("label").agg(F.try_sum("error").alias("label_error")), "labels").withColumnRenamed("label", "l")
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
    return (codes.join(labels, F.col("label").eqNullSafe(F.col("l")))
            .select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))


def oracle_sql(rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> str:
    """The same in DuckDB: components in long form, one pair of tables per round, all distances measured."""
    out = [f"""WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT r, len(e) // {parts} AS w, unnest(range(len(e))) AS i,
               unnest(list_transform(e, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT))) AS x FROM kept),
x AS MATERIALIZED (SELECT r, i // w AS p, i % w AS j, x FROM cut),
b0 AS MATERIALIZED (SELECT p, r AS k, j, x AS c FROM x WHERE r < {entries})"""]
    for n in range(rounds + 1):
        out.append(f"""d{n} AS (SELECT x.r, x.p, b.k, CAST(sum((x.x - b.c) * (x.x - b.c)) AS BIGINT) AS d
  FROM x JOIN b{n} b ON x.p = b.p AND x.j = b.j GROUP BY ALL),
a{n} AS MATERIALIZED (SELECT r, p, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{n} GROUP BY r, p)""")
        if n < rounds:
            out.append(f"""s{n} AS (SELECT x.p, a.k, x.j, CAST(sum(x.x) AS HUGEINT) AS s, count(*) AS n
  FROM x JOIN a{n} a ON x.r = a.r AND x.p = a.p GROUP BY ALL),
b{n + 1} AS MATERIALIZED (SELECT b.p, b.k, b.j,
    CAST(coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, b.c) AS BIGINT) AS c
  FROM b{n} b LEFT JOIN s{n} s ON b.p = s.p AND b.k = s.k AND b.j = s.j)""")
    out.append(f"""book AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM b{rounds}),
code AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN code USING (r) CROSS JOIN book""")
    return ",\n".join(out)
