"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become sequences of tokens (runs of letters and digits, lower case) in which numbers, names and
units of measure are replaced by typed placeholders. A document is contaminated by an item if a window of ``WIDTH`` tokens of
its template equals one of the item's and the placeholders agree: within the window each value of the item stands for one
value of the document and the other way round. So re-worded numbers and names do not hide a question, and a window that
merely has the same shape, with values in other places, does not count; nor does it speak against the item's other windows.

What is a name cannot be told from one token, so each window is looked for in four forms (``Template.forms``): its literal
tokens; numbers and units replaced; also capitalised words inside a sentence; also those that open one. Only the third
depends on what stands before a token. A capitalised word that opens a sentence may stand for another one if it agrees like
any value and neither is one of ``OPENERS``, words that commonly open sentences and are no names.

The benchmark is the query set: its rows are numbered, tasks find their windows, and these come in blocks of about ``BLOCK``,
each broadcast as sorted hashes and joined with all windows of all documents inside the scan, so no window of a document is
ever shuffled. One block at a time passes through the driver."""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showerframe.llm.common import Slice, byte_symbols, mix64, prefix_hash, ranges_hash, scratch, slices, table

#: Tokens of a window; an item with fewer is one window as a whole, if it has at least SHORTEST.
WIDTH, SHORTEST = 13, 6
#: Tokens of a window with placeholders that must be none; literal windows match whatever they are made of.
PLAIN = 5
#: Windows of the benchmark that one pass over the documents looks for.
BLOCK = 500_000
#: Units of measure, replaced where they follow a number.
UNITS = ("mm cm m km in ft yd mi mg g kg lb lbs oz t ml l gal s sec secs second seconds min mins minute minutes h hr hrs hour "
         "hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent pct "
         "meter meters metre metres kilometer kilometers mile miles gram grams kilogram kilograms pound pounds liter liters "
         "litre litres inch inches foot feet kb mb gb tb hz khz mhz w kw v a c f k").split()
OPENERS = ("the a an this that these those it he she they we you i in on at of for from to by with as and or but if when while where "
           "what which who whom whose why how there here is are was were does do did has have had can could should would my his her "
           "its our your their not no so then each every some any all both after before since because although during under let "
           "find given suppose calculate determine many much one two").split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F))

_CLASS = np.zeros(256, np.uint8)            # 1 letter, 2 digit
_CLASS[128:] = 1
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SMALL = np.arange(1 << 16, dtype=np.uint16)  # two-byte characters to their small letters


def _fill_small():
    for c in range(0x80, 0x800):
        if len(chr(c).lower()) == 1 and len(chr(c).lower().encode()) == 2:
            _SMALL[int.from_bytes(chr(c).encode(), "big")] = int.from_bytes(chr(c).lower().encode(), "big")


_fill_small()
_STOP = np.zeros(256, bool)                 # behind these a capital letter is no name
_STOP[[ord(c) for c in ".!?:\n\"(|"]] = True
_ODD = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return np.sort(ranges_hash(prefix_hash(byte_symbols(data)), np.r_[0, ends[:-1]], ends))


_UNITS = _hash_words(UNITS)
_OPENERS = frozenset(_hash_words(OPENERS).tolist())


def _lower(data: np.ndarray) -> np.ndarray:
    """Small letters for A-Z and all two-byte characters of UTF-8."""
    out = _LOWER[data]
    at = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xDF))
    if len(at):
        pair = _SMALL[(data[at].astype(np.uint16) << np.uint16(8)) | data[at + 1]]
        out[at], out[at + 1] = pair >> np.uint16(8), pair & np.uint16(255)
    return out


@dataclass
class Template:
    """Tokens of a slice: the value itself; what stands in the template in each form, the values first; whether it may be a
    placeholder (1 number or unit, 2 name inside a sentence, 3 capitalised word that opens one); first token of each text."""
    value: np.ndarray
    forms: tuple[np.ndarray, ...]
    slot: np.ndarray
    first: np.ndarray


def template(piece: Slice) -> Template:
    data, n = piece.data, len(piece.data)
    kind = _CLASS[data]
    digit = kind == 2
    # a point or comma between digits belongs to the number
    inner = np.zeros(n, bool)
    if n > 2:
        inner[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
    inner[piece.offsets[1:-1][piece.offsets[1:-1] < n]] = False
    last = piece.offsets[1:] - 1
    inner[last[last >= 0]] = False
    inside = (kind > 0) | inner
    edge = np.zeros(n + 1, bool)
    edge[piece.offsets] = True
    before = np.r_[False, inside[:-1]] if n else inside
    after = np.r_[inside[1:], False] if n else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    value = ranges_hash(prefix_hash(byte_symbols(_lower(data))), start, end)
    first = np.searchsorted(start, piece.offsets)
    opens = np.zeros(len(start), bool)
    opens[first[:-1][first[:-1] < len(start)]] = True
    stops = np.zeros(n + 1, np.int64)
    np.cumsum(_STOP[data], out=stops[1:])
    previous_end = np.r_[0, end[:-1]] if len(end) else end
    stopped = stops[start] > stops[previous_end]
    fresh = opens | stopped
    head = data[start] if len(start) else data[:0]
    second = data[np.minimum(start + 1, max(n - 1, 0))] if len(start) else data[:0]
    small = ((second >= 97) & (second <= 122)) | (second >= 0x80)
    # a capital before a small letter; words all in capitals are words
    capital = (small & (head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    number = (head >= 48) & (head <= 57)
    behind = np.r_[False, number[:-1]] & ~opens if len(start) else number
    unit = behind & (_UNITS[np.minimum(np.searchsorted(_UNITS, value), len(_UNITS) - 1)] == value)
    name = capital & ~fresh
    measured = np.where(number, NUMBER, np.where(unit & ~stopped, UNIT, value))
    inside_sentence = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    anywhere = np.where(capital & (measured == value), NAME, measured)
    slot = np.where(number | unit, 1, np.where(name, 2, np.where(capital, 3, 0))).astype(np.uint8)
    return Template(value, (value, measured, inside_sentence, anywhere), slot, first)


def windows(t: Template, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and hash of every window of ``width`` tokens that lies in one text, literal and in each form in which it
    differs from the forms before and has enough plain tokens."""
    n = len(t.value)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text_end = np.repeat(t.first[1:], np.diff(t.first))[:n - width + 1]
    inside = np.arange(n - width + 1) + width <= text_end
    at, codes, earlier = [], [], []
    for form in t.forms:
        value = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            value += form[k:n - width + 1 + k] * _ODD[k]
        plain = np.r_[0, np.cumsum(form == t.value)]
        good = inside & ((plain[width:] - plain[:-width] >= PLAIN) | (form is t.value))
        for other in earlier:
            good &= value != other
        earlier.append(value)
        at.append(np.flatnonzero(good))
        codes.append(mix64(value[at[-1]] + np.uint64(width)))
    return np.concatenate(at), np.concatenate(codes)


@dataclass
class Index:
    """Some windows of the benchmark, sorted by hash: item, position in it, width; and the items' ids, values and placeholders,
    those of item i from ``first[i]`` on."""
    width: np.ndarray
    code: np.ndarray
    item: np.ndarray
    at: np.ndarray
    ids: list[int | None]
    value: np.ndarray
    slot: np.ndarray
    first: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.code, kind="stable")
        self.width, self.code, self.item, self.at = (x[order] for x in (self.width, self.code, self.item, self.at))
        self.mask = np.uint64((1 << max(20, (8 * len(self.code)).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[self.code & self.mask] = True


def _agree(values: np.ndarray, slots: np.ndarray, own: np.ndarray, own_slots: np.ndarray) -> bool:
    """Whether the placeholders of an item's window and a document's are a one-to-one assignment."""
    if np.array_equal(values, own):
        return True
    forth, back = {}, {}
    for a, s, b, r in zip(values.tolist(), slots.tolist(), own.tolist(), own_slots.tolist()):
        if not s:
            continue
        if a != b and 3 in (s, r) and (a in _OPENERS or b in _OPENERS):
            return False
        if forth.setdefault(a, b) != b or back.setdefault(b, a) != a:
            return False
    return True


def hits(t: Template, index: Index, n_texts: int) -> list[dict[int, int]]:
    """For every text the items that contaminate it, with the number of shared windows."""
    out: list[dict[int, int]] = [{} for _ in range(n_texts)]
    for width in np.unique(index.width).tolist():
        at, code = windows(t, width)
        maybe = index.bits[code & index.mask]
        at, code = at[maybe], code[maybe]
        low, high = np.searchsorted(index.code, code, "left"), np.searchsorted(index.code, code, "right")
        found = high > low
        text = np.searchsorted(t.first, at[found], "right") - 1
        shared: dict[tuple[int, int, int], set[int]] = {}
        for d, a, l, h in zip(text.tolist(), at[found].tolist(), low[found].tolist(), high[found].tolist()):
            for k in range(l, h):
                if index.width[k] == width:
                    shared.setdefault((d, int(index.item[k]), a - int(index.at[k])), set()).add(a)
        for (d, item, shift), places in shared.items():
            base = int(index.first[item]) - shift
            good = sum(_agree(index.value[base + a:base + a + width], index.slot[base + a:base + a + width],
                              t.value[a:a + width], t.slot[a:a + width]) for a in places)
            if good:
                out[d][item] = out[d].get(item, 0) + good
    return out


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(no, id, text) to one row for every item that is long enough: its tokens and windows as arrays of bytes."""
    for batch in batches:
        rows = []
        for piece in slices(batch.column("text")):
            t = template(piece)
            for i in range(len(piece)):
                low, high = int(t.first[i]), int(t.first[i + 1])
                if high - low < SHORTEST:
                    continue
                value = t.value[low:high]
                own = Template(value, (value, *(f[low:high] for f in t.forms[1:])), t.slot[low:high], np.array([0, high - low]))
                width = min(WIDTH, high - low)
                at, code = windows(own, width)
                k = piece.first + i
                rows.append((batch.column("no")[k].as_py(), batch.column("id")[k].as_py(), width, len(at), own.value.tobytes(),
                             own.slot.tobytes(), at.astype(np.int64).tobytes(), code.tobytes()))
        columns = list(zip(*rows)) or [()] * 8
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(columns, types)],
                                         ["no", "id", "width", "n", "value", "slot", "at", "code"])


def benchmark_blocks(items: DataFrame, *, key: str = "item_id", text: str = "text", block: int = BLOCK) -> Iterator[Index]:
    """The windows of the benchmark in blocks. Every row is an item of its own, whatever its id, null or shared."""
    ws = scratch(items.sparkSession)
    # written, since row numbers of a second reading need not be the same
    rows = ws.save(items.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
                   .withColumn("no", F.monotonically_increasing_id()), "items")
    found = ws.save(rows.select("no", "id", "text").mapInArrow(
        _item_windows, "no long, id long, width long, n long, value binary, slot binary, at binary, code binary"), "windows")

    def built(low: int, high: int) -> Index:
        part = found.filter(F.col("no").between(low, high)).toArrow().sort_by("no")
        n = part.column("n").to_numpy()
        joined = lambda c, kind: np.frombuffer(b"".join(part.column(c).to_pylist()), kind)
        slot = part.column("slot").to_pylist()
        return Index(np.repeat(part.column("width").to_numpy(), n), joined("code", np.uint64), np.repeat(np.arange(len(n)), n),
                     joined("at", np.int64), part.column("id").to_pylist(), joined("value", np.uint64),
                     np.frombuffer(b"".join(slot), np.uint8), np.cumsum([0, *(len(x) for x in slot)]))

    low, size = None, 0
    for row in found.select("no", "n").orderBy("no").toLocalIterator():
        low = row.no if low is None else low
        size += row.n
        if size >= block:
            yield built(low, row.no)
            low, size = None, 0
    if low is not None:
        yield built(low, row.no)


def _marked(index):
    """(key, row, text) to (key, row, n_items, n_windows, first_item)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = index.value.ids
        for batch in batches:
            found = [h for piece in slices(batch.column("text")) for h in hits(template(piece), index.value, len(piece))]
            first = [min((ids[i] for i in h if ids[i] is not None), default=None) for h in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("row"), pa.array([len(h) for h in found], pa.int64()),
                 pa.array([sum(h.values()) for h in found], pa.int64()), pa.array(first, pa.int64())],
                ["key", "row", "n_items", "n_windows", "first_item"])
    return run


def _clean(index, text: str):
    """Batches without the rows that an item contaminates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for piece in slices(batch.column(text)) for h in hits(template(piece), index.value, len(piece))]
            yield batch.filter(pa.array([not h for h in found], pa.bool_()))
    return run


_FOUND = "key long, row long, n_items long, n_windows long, first_item long"


def _contaminated_rows(ws, source: DataFrame, blocks: Iterable[Index]) -> DataFrame | None:
    """What ``_marked`` finds in (key, row, text), rows without a hit left out: written block by block, so that only one block
    is held at a time."""
    out = None
    for index in blocks:
        shared = source.sparkSession.sparkContext.broadcast(index)
        part = ws.save(source.mapInArrow(_marked(shared), _FOUND).filter("n_items > 0"), "found")
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _one_or_many(items: DataFrame) -> tuple[Index | None, Iterator[Index] | None]:
    """The only block of a benchmark, or all of them if there are several."""
    blocks = benchmark_blocks(items)
    first, second = next(blocks, None), next(blocks, None)
    return (first, None) if second is None else (None, chain([first, second], blocks))


def contaminated(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, contaminated, n_items, n_windows, first_item, kept) for every row of ``docs``.

    Null or empty texts and items match nothing, nor do items of fewer than ``SHORTEST`` tokens; windows with fewer than
    ``PLAIN`` plain tokens match literally only. Rows of the benchmark count one by one; ``first_item`` is the smallest id among
    them, null if none has one. Null keys are carried, repeated rows judged one by one; an empty benchmark contaminates
    nothing; other columns are not read; texts are read whole."""
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("key"), F.lit(0).cast("long").alias("row"), F.col(text).alias("text"))
    nothing = [F.lit(0).cast("long").alias("n_items"), F.lit(0).cast("long").alias("n_windows"), F.lit(None).cast("long").alias("first_item")]
    only, blocks = _one_or_many(items)
    if only is not None:
        out = source.mapInArrow(_marked(spark.sparkContext.broadcast(only)), _FOUND)
    elif blocks is None:
        out = source.select("key", "row", *nothing)
    else:
        ws = scratch(spark)
        # written, since row numbers of a second reading need not be the same
        source = ws.save(source.withColumn("row", F.monotonically_increasing_id()), "source")
        found = source.select("key", "row", *nothing).unionByName(_contaminated_rows(ws, source, blocks))
        out = found.groupBy("key", "row").agg(F.sum("n_items").alias("n_items"), F.sum("n_windows").alias("n_windows"),
                                              F.min("first_item").alias("first_item"))
    bad = F.col("n_items") > 0
    return out.select(F.col("key").alias(key), bad.alias("contaminated"), "n_items", "n_windows", "first_item", (~bad).alias("kept"))


def remove_contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item contaminates, unchanged, with all their columns."""
    spark = docs.sparkSession
    only, blocks = _one_or_many(items)
    if only is not None:
        return docs.mapInArrow(_clean(spark.sparkContext.broadcast(only), text), docs.schema)
    if blocks is None:
        return docs
    ws = scratch(spark)
    source = ws.save(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row")), "source")
    bad = _contaminated_rows(ws, source.select(F.lit(None).cast("long").alias("key"), "row", F.col("doc").getField(text).alias("text")), blocks)
    return source.join(bad.select("row").distinct(), "row", "left_anti").select("doc.*")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
