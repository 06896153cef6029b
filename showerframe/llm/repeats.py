"""Repeated windows: every window of ``length`` consecutive symbols (words or bytes) of a document whose symbols also start
anywhere else, the same document included. Common ground of the two operators on repeated passages.

Comparing all suffixes of 100 TB is out of reach, so suffixes are sampled by a cover that two equal windows always share:
the sample of a window is its leftmost smallest gram among its first ``cover`` grams. It depends on the content of the window
only, so equal windows are sampled at the same offset, about two of ``cover`` positions are sampled, and every window belongs
to exactly one sampled position of its document.

1. ``scan``: all sampled positions of a document, each with a hash of the ``core`` symbols that all its windows contain. Texts
   with equal symbols become one node.
2. Positions whose core occurs once drop out by one count with map-side combine: none of their windows repeats.
3. ``contexts``: for the rest, the symbols before and behind the core that their windows can reach.
4. Members of a core meet in one group of bounded size, where the operator decides which of their windows are equal (with
   a suffix tree or a sorted suffix list). A core of more than ``CROWD`` members is not gathered: its windows are counted
   one by one by their hash, again with map-side combine. Both ways are exact and give the same answer.
5. Runs of repeated windows go back to their documents, whose covered symbols are the union of the runs."""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showerframe.llm.common import (Slice, byte_symbols, mix64, prefix_hash, ranges_hash, scratch, slices, small_batches, sum_prefix,
                                    sums_hash)
from showerframe.workspace import Workspace

#: Members of a core that are compared in one group; larger cores are counted window by window.
CROWD = 50_000
#: Members that one group of cores holds, about.
GROUP = 20_000
#: Members of crowded cores whose windows, up to ``cover`` each, are written down at once.
SPELLED = 1_000
#: Bytes of the name of a text, the first ones of the SHA-256 of its symbols.
NAME = 16


@dataclass(frozen=True)
class Rule:
    """``length`` symbols a window; ``cover`` must be a power of two; a gram has ``gram`` symbols. ``longer`` is the length of
    further windows that are looked for in the same search; a longer window is sampled where the short one at its start is."""
    words: bool
    length: int
    cover: int
    gram: int
    longer: int | None = None

    @property
    def lengths(self) -> tuple[int, ...]:
        return (self.length,) if self.longer is None else (self.length, self.longer)

    @property
    def core(self) -> int:
        return self.length - self.cover + 1

    def symbols(self, piece: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts of a slice as 64-bit codes, and where each text's begin."""
        if self.words:
            words = piece.words()
            return words.code, words.first
        return byte_symbols(piece.data), piece.offsets


@dataclass
class Samples:
    """Sampled positions of a slice: text, position, core hash, first and last window (positions within the text)."""
    text: np.ndarray
    at: np.ndarray
    core: np.ndarray
    low: np.ndarray
    high: np.ndarray


def sample(rule: Rule, symbols: np.ndarray, first: np.ndarray) -> Samples:
    n = len(symbols)
    count = np.diff(first)
    windows = np.maximum(count - rule.length + 1, 0)
    if n < rule.length or not windows.sum():
        none = np.zeros(0, np.int64)
        return Samples(none, none, none.astype(np.uint64), none, none)
    at = np.arange(n - rule.gram + 1)
    gram = sums_hash(sum_prefix(symbols), at, at + rule.gram)  # chooses positions; tells nothing apart
    # hash above, position below: the smallest value names the leftmost smallest gram
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    step = 1
    while step < rule.cover:
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        step *= 2
    text = np.repeat(np.arange(len(count)), windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + first[text]
    chosen = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[new[1:], len(chosen)] - 1
    pos, text = chosen[new], text[new]
    base = first[text]
    return Samples(text, pos - base, ranges_hash(prefix_hash(symbols), pos, pos + rule.core), start[new] - base, start[last] - base)


def _whole(rule: Rule, piece: Slice) -> list[bytes]:
    texts = [piece.text(i) for i in range(len(piece))]
    return [b" ".join(t.split()) for t in texts] if rule.words else texts


def kept_bytes(rule: Rule, piece: Slice, i: int, spans: list[tuple[int, int]], words=None) -> tuple[bytes, int]:
    """What is left of text ``i`` without the symbol ranges ``spans`` (disjoint, in order), and how many symbols went."""
    if rule.words:
        a, b = words.first[i], words.first[i + 1]
        keep = np.ones(b - a, bool)
        for low, high in spans:
            keep[low:high] = False
        data, base = piece.text(i), int(piece.offsets[i])
        at = np.flatnonzero(keep) + a
        return b" ".join(data[s - base:e - base] for s, e in zip(words.start[at].tolist(), words.end[at].tolist())), \
            int(len(keep) - len(at))
    data, out, last = piece.text(i), [], 0
    for low, high in spans:
        out.append(data[last:low])
        last = high
    out.append(data[last:])
    return b"".join(out), sum(h - l for l, h in spans)


def _scan(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column("text")):
                words = piece.words() if rule.words else None
                symbols, first = (words.code, words.first) if rule.words else rule.symbols(piece)
                found = sample(rule, symbols, first)
                bounds = np.searchsorted(found.text, np.arange(len(piece) + 1))
                digests = [hashlib.sha256(x) for x in _whole(rule, piece)]
                offsets = pa.array(bounds, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").slice(piece.first, len(piece)), pa.array([d.digest()[:NAME] for d in digests], pa.binary()),
                    pa.array(np.diff(first), pa.int64()), pa.array([d.hexdigest() for d in digests]),
                    pa.ListArray.from_arrays(offsets, pa.array(found.at, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(found.core.view(np.int64)))],
                    ["key", "name", "n", "sha", "at", "core"])
    return run


_SCAN = "key long, name binary, n long, sha string, at array<int>, core array<long>"


def _named(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column("text")):
                names = [hashlib.sha256(x).digest()[:NAME] for x in _whole(rule, piece)]
                part = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.binary())], [*part.schema.names, "name"])
    return run


def named(rule: Rule, docs: DataFrame) -> DataFrame:
    """``docs`` (with a column text) and ``name``, the name of each text."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "name binary"])
    return docs.mapInArrow(_named(rule), schema)


def window_hashes(rule: Rule, left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray,
                  core: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every window of ``length`` of the members: member, offset of the core in the window, hash. A member's windows hold
    the core at the offsets low..high; its left context ends, its right context begins at the core."""
    size = 8 if rule.words else 1
    text = np.frombuffer(b"".join(x for pair in zip(left, right) for x in pair), np.uint64 if rule.words else np.uint8)
    symbols = text if rule.words else byte_symbols(text)
    prefix = prefix_hash(symbols)
    n_left = np.array([len(x) for x in left], np.int64) // size
    n_right = np.array([len(x) for x in right], np.int64) // size
    middle = np.cumsum(n_left + n_right) - n_right  # where a member's right context starts
    low = np.maximum(low, length - rule.core - n_right)  # the text may end before a longer window does
    count = np.maximum(high - low + 1, 0)
    member = np.repeat(np.arange(len(low)), count)
    offset = np.arange(len(member)) - np.repeat(np.cumsum(count) - count, count) + low[member]
    at = middle[member]
    before = ranges_hash(prefix, at - offset, at)
    after = ranges_hash(prefix, at, at + (length - rule.core - offset))
    return member, offset, mix64(before * np.uint64(0xD1342543DE82EF95) + mix64(after + mix64(core[member])))


def _contexts(rule: Rule):
    """(node, text, places) to (node, core, at, low, high, left, right): ``places`` are the candidate positions of the text
    (those of crowded cores as complements); ``low``..``high`` are the offsets of the core in its windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            for piece in slices(batch.column("text")):
                symbols, first = rule.symbols(piece)
                found = sample(rule, symbols, first)
                mine = places.slice(piece.first, len(piece))
                flat = mine.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(piece)), pc.list_value_length(mine).to_numpy(zero_copy_only=False))
                here = found.text * (1 << 32) + found.at
                crowded = np.isin(here, (owner * (1 << 32) - 1 - flat)[flat < 0])
                wanted = crowded | np.isin(here, (owner * (1 << 32) + flat)[flat >= 0])
                crowded, text, at = crowded[wanted], found.text[wanted], found.at[wanted]
                low, high = at - found.high[wanted], at - found.low[wanted]
                raw = symbols if rule.words else piece.data
                base = first[text] + at
                left = [raw[b - h:b].tobytes() for b, h in zip(base.tolist(), high.tolist())]
                behind = base + rule.core
                ends = np.minimum(behind + (rule.lengths[-1] - rule.core - low), first[text + 1])
                right = [raw[b:e].tobytes() for b, e in zip(behind.tolist(), ends.tolist())]
                node = np.asarray(batch.column("node").to_numpy(zero_copy_only=False))[piece.first + text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array(found.core[wanted].view(np.int64)), pa.array(at), pa.array(low, pa.int32()),
                     pa.array(high, pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary()),
                     pa.array(crowded)], ["node", "core", "at", "low", "high", "left", "right", "crowded"])
    return run


_CONTEXT = "node long, core long, at long, low int, high int, left binary, right binary, crowded boolean"


def _columns(batch) -> tuple:
    get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    return (get("node"), get("core").view(np.uint64), get("at"), get("low").astype(np.int64), get("high").astype(np.int64),
            batch.column("left").to_pylist(), batch.column("right").to_pylist())


def runs(node: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Table:
    """Runs of consecutive window starts per node, as (node, low, high) with ``high`` the last start, from disjoint ones."""
    order = np.lexsort((low, node))
    node, low, high = node[order], low[order], high[order]
    if not len(node):
        return pa.table({c: pa.array([], pa.int64()) for c in ("node", "low", "high")})
    first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (low[1:] > high[:-1] + 1)])
    last = np.r_[first[1:], len(node)] - 1
    return pa.table({"node": node[first], "low": low[first], "high": high[last]})


#: Runs of repeated windows for each length: member, first and last offset of the core in them.
Resolver = Callable[[Rule, np.ndarray, np.ndarray, np.ndarray, list, list], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def _resolve(rule: Rule, resolver: Resolver):
    """A group of cores with all their members: the runs of repeated windows of each length."""
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, core, at, low, high, left, right = _columns(group)
        found = []
        for length, (member, first, last) in zip(rule.lengths, resolver(rule, core, low, high, left, right)):
            some = runs(node[member], at[member] - last, at[member] - first)
            found.append(some.append_column("length", pa.array(np.full(len(some), length, np.int32))))
        return pa.concat_tables(found)
    return run


def _spelled(rule: Rule):
    """Members of crowded cores to one row a window: (node, start, length, hash)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, core, at, low, high, left, right = _columns(batch)
            for i in range(0, len(node), SPELLED):
                cut = slice(i, i + SPELLED)
                for length in rule.lengths:
                    member, offset, code = window_hashes(rule, left[cut], right[cut], low[cut], high[cut], core[cut], length)
                    yield pa.RecordBatch.from_pydict({"node": node[cut][member], "start": at[cut][member] - offset, "length":
                                                      np.full(len(member), length, np.int32), "code": code.view(np.int64)})
    return run


@dataclass
class Found:
    """Written tables. ``scanned``: key, name, n, sha of every row. ``nodes``: name, copies, node. ``runs``: node, low, high, length of
    repeated windows. ``texts``: node, name, text of the nodes that have candidates."""
    scanned: DataFrame
    nodes: DataFrame
    runs: DataFrame
    texts: DataFrame


def find(ws: Workspace, rule: Rule, resolver: Resolver, docs: DataFrame) -> Found:
    """Repeated windows of ``docs`` (key, text)."""
    small_batches(ws.spark)
    # rows without a key still need a value to be told apart by
    docs = docs.select(F.coalesce("key", F.lit(-2**63)).alias("key"), "text")
    scanned = ws.save(docs.mapInArrow(_scan(rule), _SCAN), "scanned")
    nodes = scanned.groupBy("name").agg(F.count("*").alias("copies"), F.min("key").alias("key"), F.first("at").alias("at"),
                                        F.first("core").alias("core"))
    nodes = ws.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # a text that occurs twice repeats as a whole; its windows take part as partners of others
    placed = nodes.select("node", F.explode(F.arrays_zip("at", "core")).alias("s")).select("node", "s.at", "s.core")
    shared = ws.save(placed.groupBy("core").agg(F.count("*").alias("c")).filter("c > 1"), "shared")
    # a position of a crowded core is told by its complement
    place = F.when(F.col("c") <= CROWD, F.col("at")).otherwise(-1 - F.col("at"))
    wanted = placed.join(shared, "core").groupBy("node").agg(F.collect_list(place).alias("places"))
    wanted = ws.save(wanted.join(nodes.select("node", "name", "key"), "node"), "wanted")
    # joined on name and key, so that many copies of one text do not meet in one task
    texts = named(rule, docs).join(wanted, ["name", "key"]).dropDuplicates(["name", "key"])
    texts = ws.save(texts.select("node", "name", "places", "text"), "texts")
    total = shared.filter(F.col("c") <= CROWD).agg(F.sum("c")).first()[0] or 0
    ws.release(wanted, shared)
    groups = int(total // GROUP) + 1
    members = ws.save(texts.mapInArrow(_contexts(rule), _CONTEXT), "members")
    thin = (members.filter("not crowded").withColumn("task", F.pmod(F.xxhash64("core"), F.lit(groups)))
            .groupBy("task").applyInArrow(_resolve(rule, resolver), "node long, low long, high long, length int"))
    spelled = members.filter("crowded").mapInArrow(_spelled(rule), "node long, start long, length int, code long")
    # written, so that both sides of the join are plain shuffles and a window with very many starts can be split
    again = ws.save(spelled.groupBy("code", "length").agg(F.count("*").alias("c")).filter("c > 1").select("code", "length"), "again")
    thick = spelled.join(again, ["code", "length"]).select("node", F.col("start").alias("low"), F.col("start").alias("high"), "length")
    found = ws.save(thin.unionByName(thick), "runs")
    ws.release(members, again)
    return Found(scanned, nodes, found, texts)


def spans_by_name(ws: Workspace, rule: Rule, resolver: Resolver, docs: DataFrame) -> DataFrame:
    """(name, copied, lows, highs), written: the texts of ``docs`` (key, text) that occur several times or have repeated windows.
    With windows of two lengths also ``low_longs`` and ``high_longs``."""
    found = find(ws, rule, resolver, docs)
    copied = F.col("copies") > 1
    spans = spans_of(found, *rule.lengths)
    out = ws.save(found.nodes.join(spans, "node", "left").filter(copied | F.col("lows").isNotNull())
                  .select("name", copied.alias("copied"), *[c for c in spans.columns if c != "node"]), "special")
    ws.release(found.scanned, found.nodes, found.runs, found.texts)
    return out


def spans_of(found: Found, length: int, longer: int | None = None) -> DataFrame:
    """(node, lows, highs): the runs of repeated windows of ``length`` of every node that has some; with ``longer`` also
    (low_longs, high_longs). A longer window that repeats holds shorter ones that do."""
    def runs_of(c: str, size: int) -> Column:
        return F.collect_list(F.when(F.col("length") == size, F.col(c)))
    columns = [runs_of("low", length).alias("lows"), runs_of("high", length).alias("highs")]
    if longer is not None:
        columns += [runs_of("low", longer).alias("low_longs"), runs_of("high", longer).alias("high_longs")]
    return found.runs.groupBy("node").agg(*columns)


def merged(rule: Rule, lows, highs) -> list[tuple[int, int]]:
    """Disjoint symbol ranges covered by runs of windows."""
    out: list[list[int]] = []
    for low, high in sorted(zip(lows, highs)):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + rule.length)
        else:
            out.append([low, high + rule.length])
    return [(a, b) for a, b in out]


def _cut(rule: Rule):
    """(node, text, lows, highs) to (node, n_removed, n_spans, sha)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = batch.column("lows"), batch.column("highs")
            removed, count, sha = [], [], []
            for piece in slices(batch.column("text")):
                words = piece.words() if rule.words else None
                for i in range(len(piece)):
                    k = piece.first + i
                    spans = merged(rule, lows[k].as_py(), highs[k].as_py())
                    left, gone = kept_bytes(rule, piece, i, spans, words)
                    removed.append(gone)
                    count.append(len(spans))
                    sha.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "n_removed": pa.array(removed, pa.int64()),
                                              "n_spans": pa.array(count, pa.int64()), "sha": pa.array(sha, pa.string())})
    return run


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def report(rule: Rule, resolver: Resolver, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    A null text is empty; null keys are carried; repeated rows and equal texts under several keys repeat each other, so all of
    them go if they have a window; there are no ties, since windows are judged on the input; an empty table gives no rows; other
    columns are not read."""
    ws = scratch(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    found = find(ws, rule, resolver, source)
    cut = ws.save(found.texts.select("node", "text").join(spans_of(found, rule.length), "node").mapInArrow(
        _cut(rule), "node long, n_removed long, n_spans long, sha string"), "cut")
    ws.release(found.texts, found.runs)
    cut = cut.withColumnRenamed("sha", "cut_sha")
    # texts that nothing else tells apart from the rest: copies, and texts with runs
    special = found.nodes.select("name", "copies", "node").join(cut, "node", "left").filter((F.col("copies") > 1) | F.col("cut_sha").isNotNull())
    out = found.scanned.select("key", "name", "n", "sha").join(special, "name", "left")
    whole = (F.col("copies") > 1) & (F.col("n") >= rule.length)
    own_key = F.when(F.col("key") != -2**63, F.col("key"))
    return out.select(
        own_key.alias(key), "n", F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"))


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges shrunk to whole UTF-8 characters, so that what is left stays text."""
    out = []
    for low, high in spans:
        while low < high and data[low] & 0xC0 == 0x80:
            low += 1
        while low < high and high < len(data) and data[high] & 0xC0 == 0x80:
            high -= 1
        if low < high:
            out.append((low, high))
    return out
