"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full shingle sets, connected components.

1. Every text gets the set of its distinct word shingles, a 128-bit name of that set and band hashes of its SuperMinHash
   signature. Texts with equal sets become one node, so that copies cost nothing further.
2. Nodes that share a band get the same smallest node as neighbour: the components of these stars are candidate
   clusters. Each node lies in one cluster, so its set is sent there once.
3. Clusters are verified in blocks of at most ``BLOCK`` nodes, ordered by set size; a cluster of more blocks is compared
   block by block, without the pairs of blocks whose sizes alone exclude a link. A comparison is a matrix product inside
   the task and leaves a spanning forest of the true links, never pairs. All pairs of a cluster are compared, so the result
   does not depend on which band made a candidate.
4. The components of the true links give the classes.

The signature misses a pair with probability (1 - s**ROWS)**BANDS: 3e-7 at similarity 0.85, 6e-5 at 0.8."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from showerframe.llm.common import Slice, mix64, scratch, slices, table
from showerframe.llm.graph import components

ROWS, BANDS = 6, 32
#: Nodes of a cluster that one comparison takes from either side.
BLOCK = 256
#: Bytes of shingle sets that one task compares, about.
TASK_BYTES = 8_000_000

_ODD = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_STEP = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(piece: Slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts of a slice and where each text's begin. A text with fewer words than
    ``width`` has its whole word sequence as its only shingle; one without words has none."""
    words = piece.words(lower=True)
    n = len(words.code)
    count = np.diff(words.first)
    doc = np.repeat(np.arange(len(piece)), count)
    last = np.repeat(words.first[1:], count)
    at = np.arange(n)
    at = at[(at + width <= last) | (at == np.repeat(words.first[:-1], count))]
    doc, last = doc[at], last[at]
    padded = np.concatenate([words.code, np.zeros(width, np.uint64)])
    value = np.zeros(len(at), np.uint64)
    for k in range(width):
        value += np.where(at + k < last, padded[at + k], np.uint64(0)) * _ODD[k]
    value = mix64(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(piece) + 1))


def superminhash(value: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash signatures of the sets value[first[i]:first[i + 1]], one row of ``size`` values a set.

    Element e visits the slots in a random order of its own and offers (j, r) to the slot visited at step j; the slot keeps
    the smallest offer. All elements make step j together. Offers grow with j, so a set is done, and its elements stop, once
    none of its slots is empty. An empty set keeps the largest value everywhere."""
    n_sets = len(first) - 1
    empty = np.uint64(2**64 - 1)
    signature = np.full(n_sets * size, empty, np.uint64)
    owner = np.repeat(np.arange(n_sets), np.diff(first))
    element, visits = value, None
    for j in range(size):
        if not len(element):
            break
        random = mix64(element + _STEP[j])
        offer = (np.uint64(j) << np.uint64(54)) | (random & np.uint64(2**54 - 1))
        other = j + ((random >> np.uint64(32)) * np.uint64(size - j) >> np.uint64(32)).astype(np.int64)
        if visits is None:
            slot = other
        else:
            rows = np.arange(len(element))
            slot = visits[rows, other].astype(np.int64)
            visits[rows, other] = visits[:, j]
            visits[:, j] = slot
        np.minimum.at(signature, owner * size + slot, offer)
        going = (signature.reshape(n_sets, size) == empty).any(1)[owner]
        if visits is None:
            element, owner, slot = element[going], owner[going], slot[going]
            visits = np.tile(np.arange(size, dtype=np.uint8), (len(element), 1))
            rows = np.arange(len(element))
            visits[rows, slot] = 0
            visits[:, 0] = slot
        elif not going.all():
            element, owner, visits = element[going], owner[going], visits[going]
    return signature.reshape(n_sets, size)


def set_names(value: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each set, from two sums over its elements; None for an empty set."""
    halves = []
    for salt in (0x51ED270B9F1A2C3D, 0xA0761D6478BD642F):
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(mix64(value ^ np.uint64(salt)), out=total[1:])
        halves.append(total[first[1:]] - total[first[:-1]])
    both = np.stack(halves, 1).tobytes()
    return [both[16 * i:16 * i + 16] if first[i + 1] > first[i] else None for i in range(len(first) - 1)]


def _signed(width: int, with_bands: bool):
    """Arrow function: (key, text) to (key, n_shingles, set_id, bands) or, for candidates, (set_id, shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column("text")):
                value, first = shingle_sets(piece, width)
                names = pa.array(set_names(value, first), pa.binary())
                n = np.diff(first)
                if not with_bands:
                    yield pa.RecordBatch.from_arrays(
                        [names, pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(value.view(np.int64)))],
                        ["set_id", "shingles"])
                    continue
                signature = superminhash(value, first, ROWS * BANDS).reshape(-1, BANDS, ROWS)
                band = mix64((signature * _ODD[:ROWS]).sum(2, dtype=np.uint64)
                             + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()),
                                                 pa.array(band.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(piece.first, len(piece)), pa.array(n, pa.int64()), names, bands],
                    ["key", "n_shingles", "set_id", "bands"])
    return run


def linked_forest(sets: list[np.ndarray], left: int, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the links den * |a & b| >= num * |a | b| between two blocks, sets[:left] and sets[left:], or
    within one block if ``left`` is the number of sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(n), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, column = row[times[column] > 1], column[times[column] > 1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    new = np.r_[True, column[1:] != column[:-1]] if len(column) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.zeros((n, n), np.float32)
    step = max(64, 4_000_000 // n)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, [low, low + step])
        part = np.zeros((n, min(step, int(column[j - 1]) - low + 1)), np.float32)
        part[row[i:j], column[i:j] - low] = 1
        shared += part @ part.T
    shared = shared.astype(np.int64)
    link = den * shared >= num * (sizes[:, None] + sizes[None, :] - shared)
    a, b = np.nonzero(np.triu(link, 1))
    if left < n:
        across = (a < left) & (b >= left)
        a, b = a[across], b[across]
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            forest.append((x, y))
    return forest


def _verify(num: int, den: int):
    """Arrow function over a group of comparisons: rows (cluster, i, j, side, set_id, shingles) to links (a, b)."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("cluster", "ascending"), ("i", "ascending"), ("j", "ascending"), ("side", "ascending"),
                               ("set_id", "ascending")]).combine_chunks()
        a, b = [], []
        if group.num_rows:
            names = group.column("set_id").to_pylist()
            lists = group.column("shingles").chunk(0)
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            keys = list(zip(group.column("cluster").to_pylist(), group.column("i").to_pylist(), group.column("j").to_pylist()))
            side = group.column("side").to_numpy()
            start = 0
            while start < len(keys):
                end = start
                while end < len(keys) and keys[end] == keys[start]:
                    end += 1
                sets = [flat[bounds[k]:bounds[k + 1]] for k in range(start, end)]
                if len(sets) > 1:
                    for x, y in linked_forest(sets, int((side[start:end] == 0).sum()), num, den):
                        a.append(names[start + x])
                        b.append(names[start + y])
                start = end
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})
    return run


def near_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, num: int = 85,
                den: int = 100) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``.

    ``component_id`` is the smallest key of the row's class under links den * |a & b| >= num * |a | b| between shingle
    sets (lower case A-Z, ``width`` words); ``kept`` marks the row with that key. Rows without words are alone. Null keys are
    carried and never name a class, unless the class has no other key; then component_id is null and the row is kept.
    Repeated rows give repeated results. Other columns of ``docs`` are not read."""
    spark = docs.sparkSession
    ws = scratch(spark)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    signed = ws.save(source.mapInArrow(_signed(width, True), "key long, n_shingles long, set_id binary, bands array<long>"),
                     "signed")
    named = signed.filter(F.col("set_id").isNotNull())
    nodes = ws.save(named.groupBy("set_id").agg(F.min("key").alias("low"), F.first("n_shingles").alias("n"),
                                                F.first("bands").alias("bands")), "nodes")
    banded = nodes.select("set_id", F.explode("bands").alias("band"))
    shared = (banded.groupBy("band").agg(F.min("set_id").alias("leader"), F.count("*").alias("size"))
              .filter("size > 1").select("band", "leader"))
    stars = banded.join(shared, "band").filter(F.col("set_id") != F.col("leader"))
    clusters = ws.save(components(ws, stars.select(F.col("set_id").alias("a"), F.col("leader").alias("b"))), "clusters")
    links = ws.save(_links(ws, source, nodes, clusters, width, num, den), "links")
    true = components(ws, links)
    classes = ws.save(true.join(nodes.select(F.col("set_id").alias("node"), "low"), "node"), "classes")
    lows = classes.groupBy("comp").agg(F.min("low").alias("component_id"))
    merged = classes.join(lows, "comp").select(F.col("node").alias("set_id"), "component_id")
    own = nodes.select("set_id", "low").join(merged, "set_id", "left").select(
        "set_id", F.coalesce("component_id", "low").alias("component_id"))
    out = signed.select("key", "n_shingles", "set_id").join(own, "set_id", "left")
    out = out.select(F.col("key").alias(key), "n_shingles",
                     F.when(F.col("set_id").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _links(ws, source: DataFrame, nodes: DataFrame, clusters: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Spanning links of every candidate cluster. The place of a node in its cluster is its rank by set size, counted per
    size first, so that no window holds more than the nodes of one cluster and size class."""
    members = ws.save(clusters.select(F.col("node").alias("set_id"), F.col("comp").alias("cluster"))
                      .join(nodes, "set_id").select("cluster", "set_id", "low", "n"), "members")
    total = members.agg(F.sum("n")).first()[0] or 0
    groups = max(1, int(total * 8 // TASK_BYTES) + 1)
    # blocks: nodes of one cluster in order of size; hash parts split a size class that fills several blocks
    per_size = members.groupBy("cluster", "n").agg(F.count("*").alias("c"))
    running = Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    per_size = per_size.withColumn("before", F.coalesce(F.sum("c").over(running), F.lit(0)))
    placed = members.join(per_size, ["cluster", "n"]).withColumn(
        "block", F.floor((F.col("before") + F.pmod(F.xxhash64("set_id"), F.col("c"))) / BLOCK).cast("int"))
    placed = ws.save(placed.select("cluster", "set_id", "low", "n", "block"), "placed")
    spans = placed.groupBy("cluster", "block").agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"))
    other = spans.select("cluster", F.col("block").alias("j"), F.col("n_min").alias("j_min"))
    # a link needs den * smaller >= num * larger, so a block meets only later blocks whose smallest set is near enough
    tasks = ws.save(spans.join(other, "cluster")
                    .filter((F.col("j") >= F.col("block")) & (den * F.col("n_max") >= num * F.col("j_min")))
                    .select("cluster", F.col("block").alias("i"), "j"), "tasks")
    wanted = placed.select(F.col("low").alias("wanted")).distinct()
    texts = source.join(wanted, F.col("key").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    sets = texts.mapInArrow(_signed(width, False), "set_id binary, shingles array<long>")
    sets = placed.select("cluster", "set_id", "block").join(sets, "set_id").dropDuplicates(["set_id"])
    sets = ws.save(sets, "sets")
    sides = tasks.select("cluster", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.lit(0)))
                                                        .otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("block", F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("j")))
    sent = sides.join(sets, ["cluster", "block"]).withColumn("task", F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(groups)))
    return sent.select("task", "cluster", "i", "j", "side", "set_id", "shingles").groupBy("task").applyInArrow(
        _verify(num, den), "a binary, b binary")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 4,
             den: int = 5) -> DataFrame:
    """``docs`` with one row of each class, unchanged: the one with the smallest key; of rows with the same key, the first."""
    row = "near_dedup_row"
    ws = scratch(docs.sparkSession)
    # written, since row numbers of a second reading need not be the same
    numbered = ws.save(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    classes = near_groups(numbered, key=row, text=text, width=width, num=num, den=den)
    own = numbered.select(row, F.struct(F.col(key).isNull().alias("a"), F.col(key).alias("b"), F.col(row).alias("c")).alias("o"))
    joined = ws.save(classes.filter(F.col("component_id").isNotNull()).join(own, row), "rows")
    best = joined.groupBy("component_id").agg(F.count("*").alias("size"), F.min("o").alias("best")).filter("size > 1")
    lost = joined.join(best, "component_id").filter(F.col("o") != F.col("best")).select(row)
    return numbered.join(lost, row, "left_anti").drop(row)


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
