"""Alignment of the tokens of two vocabularies by lockstep merging, and how often two ids stand for common bytes.

Both token sequences of a text cover the same bytes. Where tokens of both end at one byte the text is cut; the tokens
between two cuts are a group, and every token of one side is linked with every token of the other side in it.

* ``lockstep``: one state vector holds the two pointers of every lane. A step compares the two byte ends of all lanes at once,
  moves the pointer behind (both at a cut), emits the groups that the step closed and removes lanes that are done. A lane is
  a text, or a stretch of a long one between two known cuts, so the number of steps does not grow with the longest text.
* ``align``: texts to ids and groups, slice by slice, in the tasks that read them. A slice (a block) also has the table of its
  distinct id pairs with the number of texts that hold them, so that a pair leaves a block once however often it occurs.
* ``count_links``: pairs of all blocks are added up, the highest count per first id is found, and the counts go back to the
  blocks that asked for them. A pair that stands in every block has one row per block; no row depends on the number of texts.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showerframe.llm.common import scratch, table
from showerframe.llm.vocabularies import BytePair, Flat, Pieces, loaded, text_lists, vocabulary_path
from showerframe.workspace import Workspace

#: Characters of a block, and bytes of a lane.
BLOCK = 2_000_000
LANE = 2_000
#: Links of a group that are written out one by one; larger groups are counted by distinct ids first.
PLAIN_LINKS = 1_024


def _lanes(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, lane: int):
    """First tokens of all lanes (one more than lanes). Byte ends count through the whole slice, so every text ends at a
    cut; within long texts a cut is looked for every ``lane`` bytes, at the next few tokens."""
    size = np.diff(np.r_[0, end_a[first_a[1:] - 1]])
    long = np.flatnonzero(size > 2 * lane)
    start = end_a[first_a[long + 1] - 1] - size[long]
    n = size[long] // lane - 1
    goal = np.repeat(start, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1) * lane
    a = np.searchsorted(end_a, goal)
    cuts_a, cuts_b = [first_a], [first_b]
    for _ in range(8):
        b = np.searchsorted(end_b, end_a[a])
        found = end_b[b] == end_a[a]
        cuts_a.append(a[found] + 1)
        cuts_b.append(b[found] + 1)
        a = np.minimum(a[~found] + 1, len(end_a) - 1)
    return np.unique(np.concatenate(cuts_a)), np.unique(np.concatenate(cuts_b))


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, lane: int = LANE):
    """Groups of a slice of texts: first token of each group on both sides (one more than groups), in order.

    ``end_a`` and ``end_b`` are the byte ends of all tokens of the slice, ``first_a`` and ``first_b`` the first token of each
    text (one more than texts). Every text has tokens, no token is empty, and both sides of a text have the same length."""
    if len(first_a) < 2:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    cut_a, cut_b = _lanes(end_a, end_b, first_a, first_b, lane)
    a, b, stop = cut_a[:-1].copy(), cut_b[:-1].copy(), cut_a[1:]
    groups_a, groups_b = [first_a[-1:]], [first_b[-1:]]
    from_a, from_b = a.copy(), b.copy()
    while len(a):
        ea, eb = end_a[a], end_b[b]
        cut = ea == eb
        groups_a.append(from_a[cut])
        groups_b.append(from_b[cut])
        a += ea <= eb
        b += eb <= ea
        from_a, from_b = np.where(cut, a, from_a), np.where(cut, b, from_b)
        done = cut & (a == stop)
        if done.any():
            left = ~done
            a, b, stop, from_a, from_b = a[left], b[left], stop[left], from_a[left], from_b[left]
    return np.sort(np.concatenate(groups_a)), np.sort(np.concatenate(groups_b))


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... size[i] numbers for each i."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _links(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, text: np.ndarray):
    """(text, pair, times) of the links of all groups; a pair is both ids in one number. Rows of a pair may repeat;
    without ``times`` every row is one link."""
    na, nb = np.diff(group_a), np.diff(group_b)
    small = np.flatnonzero(na * nb <= PLAIN_LINKS)
    n = na[small] * nb[small]
    k = _spread(np.zeros(len(small), np.int64), n)
    wide = np.repeat(nb[small], n)
    pair = (a[np.repeat(group_a[small], n) + k // wide] << 32) | b[np.repeat(group_b[small], n) + k % wide]
    if len(small) == len(na):
        return np.repeat(text, n), pair, None
    owner, pairs, times = [np.repeat(text[small], n)], [pair], [np.ones(len(pair), np.int64)]
    for g in np.flatnonzero(na * nb > PLAIN_LINKS):
        ua, ca = np.unique(a[group_a[g]:group_a[g + 1]], return_counts=True)
        ub, cb = np.unique(b[group_b[g]:group_b[g + 1]], return_counts=True)
        pairs.append(((ua << 32)[:, None] | ub[None, :]).ravel())
        times.append((ca[:, None] * cb[None, :]).ravel())
        owner.append(np.full(len(pairs[-1]), text[g]))
    return np.concatenate(owner), np.concatenate(pairs), np.concatenate(times)


class _Written:
    """Groups as text: ids of both sides with commas, a bar between the sides, a semicolon between groups."""

    def __init__(self, n_a: int, n_b: int):
        self._n = max(n_a, n_b)
        ids = [str(i).encode() for i in range(self._n)]
        self._flat = Flat([i + c for c in (b",", b"|", b";") for i in ids])

    def texts(self, a, b, group_a, group_b, first_group) -> list[bytes]:
        na, nb = np.diff(group_a), np.diff(group_b)
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[group_a[1:] - 1] = 1
        sign_b[group_b[1:] - 1] = 2
        both = np.empty(len(a) + len(b), np.int64)
        start = group_a[:-1] + group_b[:-1]
        both[_spread(start, na)] = a + self._n * sign_a
        both[_spread(start + na, nb)] = b + self._n * sign_b
        data, at = self._flat.take(both)
        ends = at[(group_a + group_b)[first_group]]
        return [data[x:y - 1].tobytes() for x, y in zip(ends[:-1], ends[1:])]


SCHEMA = ("key long, block long, n_a long, n_b long, n_groups long, n_links long, groups string, uses binary, "
          "pairs array<long>, texts array<int>")


def _block(texts: list[str], a_side: BytePair, b_side: Pieces, written: _Written) -> dict[str, list | np.ndarray]:
    n = len(texts)
    out: dict = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    out |= {"groups": [""] * n, "uses": [b""] * n, "pairs": np.zeros(0, np.int64), "texts": np.zeros(0, np.int64)}
    a, first_a = a_side.encode([" " + t if t else "" for t in texts])
    b, first_b, same = b_side.encode_compared(texts)  # the other side has all bytes and gives every text back
    good = np.flatnonzero(same).tolist()
    if not good:
        return out
    rows = np.array(good)
    n_a, n_b = (np.diff(f)[rows] for f in (first_a, first_b))
    a, b = a[_spread(first_a[rows], n_a)], b[_spread(first_b[rows], n_b)]
    size_a, size_b = a_side.bytes.size[a], b_side.bytes.size[b]
    first_a, first_b = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
    if not (size_a.all() and size_b.all()):
        raise ValueError("a token without bytes cannot be aligned")
    group_a, group_b = lockstep(np.cumsum(size_a), np.cumsum(size_b), first_a, first_b)
    first_group = np.searchsorted(group_a, first_a)
    n_groups = np.diff(first_group)
    owner = np.repeat(np.arange(len(rows)), n_groups)
    text, pair, times = _links(a, b, group_a, group_b, owner)
    number, pairs = pd.factorize(pair)
    use = text * len(pairs) + number
    if times is None:                        # every row is one link: equal rows are counted by sorting
        use.sort()
        edge = np.flatnonzero(np.r_[True, use[1:] != use[:-1]])
        use, times = use[edge], np.diff(np.r_[edge, len(use)])
    else:
        use, at = np.unique(use, return_inverse=True)
        times = np.bincount(at, times, len(use)).astype(np.int64)
    use_text, use_pair = use // len(pairs), use % len(pairs)
    out["n_a"][rows], out["n_b"][rows], out["n_groups"][rows] = n_a, n_b, n_groups
    out["n_links"][rows] = np.add.reduceat(np.diff(group_a) * np.diff(group_b), first_group[:-1])
    out["pairs"], out["texts"] = pairs, np.bincount(use_pair, minlength=len(pairs))
    uses = np.stack([use_pair, times], 1).astype("<i4" if times.max() < 2**31 else "<i8")
    split = np.searchsorted(use_text, np.arange(len(rows) + 1))
    strings = written.texts(a, b, group_a, group_b, first_group)
    for k, i in enumerate(good):
        out["uses"][i] = bytes([uses.itemsize]) + uses[split[k]:split[k + 1]].tobytes()
        out["groups"][i] = strings[k].decode()
    return out


def _run(path_a: str, path_b: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = loaded(BytePair, path_a), loaded(Pieces, path_b)
        written = _Written(len(a_side.bytes.size), len(b_side.bytes.size))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, texts in text_lists(batch.column("text"), limit):
                n = len(texts)
                found = _block(texts, a_side, b_side, written)
                none = [None] * (n - 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(i, n), pa.array(np.full(n, block)),
                     *[pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                     pa.array(found["groups"], pa.string()), pa.array(found["uses"], pa.binary()),
                     pa.array([found["pairs"], *none], pa.list_(pa.int64())), pa.array([found["texts"], *none], pa.list_(pa.int32()))],
                    [c.split()[0] for c in SCHEMA.split(", ")])
                block += 1
    return run


def align(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None,
          limit: int = BLOCK) -> DataFrame:
    """The aligned tokens of every row: key, n_a, n_b, n_groups, n_links and ``groups`` (`a1,a2|b1;a3|b2,b3`, ids of both
    vocabularies in order). ``block``, ``uses``, ``pairs`` and ``texts`` are for ``count_links``.

    Texts that are null or empty, or whose tokens of one side do not give back a blank and the text, have no tokens: zeros and
    an empty string. Null keys are carried, repeated rows are rows of their own, an empty table gives no rows, other columns
    are not read. A text longer than ``limit`` is a block of its own; long texts are cut into lanes, never shortened."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    run = _run(path_a or vocabulary_path("byte_bpe_50k.json"), path_b or vocabulary_path("piece_bpe_32k.model"), limit)
    return rows.mapInArrow(run, SCHEMA)


def _per_text(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums of the texts of one block; ``pairs`` are the counts of its distinct pairs, in any order."""
    count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    at = pairs.column("pos").to_numpy()
    count[at] = pairs.column("n").to_numpy()
    best[at] = pairs.column("best").to_numpy()
    sums, bests = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, raw in enumerate(texts.column("uses").to_pylist()):
        if raw:
            uses = np.frombuffer(raw, f"<i{raw[0]}", offset=1).reshape(-1, 2).astype(np.int64)
            sums[i] = uses[:, 1] @ count[uses[:, 0]]
            bests[i] = uses[:, 1] @ best[uses[:, 0]]
    return texts.drop_columns(["block", "uses"]).append_column("n_best", pa.array(bests)).append_column("count_sum", pa.array(sums))


def count_links(ws: Workspace, aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, pairs) of what ``align`` found, written once. ``texts`` are its rows with n_best (links whose pair has the
    highest count of its first id, ties included) and count_sum (counts of all links); ``pairs`` has a, b, n (texts with that
    pair) and best."""
    written = ws.save(aligned, "aligned")
    asked = (written.filter(F.col("pairs").isNotNull())
             .select("block", F.posexplode(F.arrays_zip("pairs", "texts")).alias("pos", "p"))
             .select("block", "pos", F.col("p.pairs").alias("pair"), F.col("p.texts").alias("texts")))
    first = F.shiftright("pair", 32)
    counts = ws.save(asked.groupBy("pair").agg(F.sum("texts").alias("n")), "counts")
    # One row per id of the first vocabulary, so this side is small whatever the corpus.
    top = counts.groupBy(first.alias("a")).agg(F.max("n").alias("top"))
    known = ws.save(counts.withColumn("a", first).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")),
                    "known")
    answers = asked.select("block", "pos", "pair").join(known, "pair").select(F.col("block").alias("of"), "pos", "n", "best")
    rows = written.drop("pairs", "texts")
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("block", "uses")]
    texts = (rows.groupBy("block").cogroup(answers.groupBy("of"))
             .applyInArrow(_per_text, ", ".join([*kept, "n_best long", "count_sum long"])))
    return texts, known.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b"), "n", "best")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned tokens of every text in numbers, and a digest of its groups. Texts without tokens have zeros and ''."""
    aligned = align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    texts, _ = count_links(scratch(spark), aligned.withColumn("groups", digest))
    return texts.select(F.col("key").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        F.col("groups").alias("groups_sha256"))
