"""LM scoring: a causal self-attention model over subword ids, trained in numpy, and the unigram base over whole words.

The model reads the ids before a token in windows of ``LENGTH`` that overlap by ``LENGTH - STEP``; the last ``STEP`` positions of
a window are scored, so each token is scored once with at least ``LENGTH - STEP`` ids of context (or all there are). One
attention layer with a bias for every distance gives the state from which the class of the next id is predicted; the id
follows within its class by its frequency. Frequencies, classes and weights are learnt from all texts to learn from: classes by the
neighbours of every id, weights in one pass over every window, in which the tasks start from common weights, go through their own
blocks and are averaged by their windows. Only where that pass starts from is found with a few texts.

Whole texts are read once, in blocks of about ``SLICE`` bytes, in the task that reads them. A block is one row: the numbers of
its texts' words in its list of distinct words, and for the list the hash, count and ids of each word. Texts go no further.
Counts of words are summed in parts of the hash range, counts of ids by id, and each block gets the totals of its own words
back, in the same order. So a word costs one number per block, whatever its frequency, and neither the vocabulary nor a frequent
word ever meets in one place."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showerframe.llm.common import SLICE_BYTES, Slice, fold, scratch, slices, small_batches, table
from showerframe.llm.vocabularies import BytePair, loaded, vocabulary_path

#: Word hashes that are summed in one task, and at once in it, about.
PART, SUMMED = 2_000_000, 200_000
#: Texts that the weights start from, about; chosen by a hash of the id.
TRAIN_TEXTS = 1_000
LENGTH, STEP = 16, 8
CLASSES, SPACE, KEY, VALUE = 48, 24, 8, 16
#: Ids with an embedding of their own; the others share RARE rows.
FREQUENT, RARE = 8192, 256
STEPS, BATCH, RATE = 500, 512, 0.01
#: Windows of a step, and rate, of the pass over all texts.
PASS_BATCH, PASS_RATE = 2048, 0.002
#: Windows that are scored at once.
SCORED = 1024
#: Embedding rows before and behind an id that are told apart when its neighbours are counted; the others share as many.
NEAR = 16
#: Fractions of a weight when weights are added, so that the sum does not depend on the order of tasks.
FINE = 1 << 20
#: Bytes of a block, unless one text is longer, and distinct words that are encoded at once.
SLICE, ENCODED = 3_000_000, 20_000
VOCABULARY = 50_257
END = VOCABULARY - 1  # id of the end of a text, also read before its first id
#: Added to the count of every id before frequencies are taken.
FLOOR = 0.1

_INNER_SPACE = re.compile(r"\s")


def word_ids(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word behind a blank, in one array, and where each word's begin (one more than words). A blank before a
    visible character always begins a new part, so words are encoded together and told apart by the bytes of their ids."""
    tokens = loaded(BytePair, path)
    odd = [i for i, w in enumerate(words) if _INNER_SPACE.search(w)]
    plain = [w for w in words if not _INNER_SPACE.search(w)] if odd else words
    ids, _ = tokens.encode([" " + " ".join(plain)] if plain else [])
    ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in plain), np.int64, len(plain)))
    first = np.r_[0, np.searchsorted(np.cumsum(tokens.bytes.size[ids]), ends) + 1]
    if not odd:
        return ids, first
    found = np.split(ids, first[1:-1]) if plain else []
    for i, own in zip(odd, (tokens.encode([" " + words[i]])[0] for i in odd)):
        found.insert(i, own)
    return np.concatenate(found), np.r_[0, np.cumsum([len(f) for f in found])]


def _words(piece: Slice) -> tuple[np.ndarray, ...]:
    """Distinct words of a slice (hash, where one of them starts and ends), the number of each word, and each text's first word.
    Words are hashed about ``SLICE_BYTES`` at a time, since that takes many times the bytes of the texts."""
    codes, starts, ends, first, at = [], [], [], [np.zeros(1, np.int64)], 0
    while at < len(piece):
        to = int(np.searchsorted(piece.offsets, piece.offsets[at] + SLICE_BYTES, "right")) - 1
        to = min(max(to, at + 1), len(piece))
        base = piece.offsets[at]
        words = Slice(at, piece.data[base:piece.offsets[to]], piece.offsets[at:to + 1] - base).words(lower=True)
        codes.append(words.code)
        starts.append(words.start + base)
        ends.append(words.end + base)
        first.append(words.first[1:] + first[-1][-1])
        at = to
    names, one, number = np.unique(np.concatenate(codes), return_index=True, return_inverse=True)
    return names, np.concatenate(starts)[one], np.concatenate(ends)[one], number, np.concatenate(first)


class Block:
    """The words and ids of some texts (lower case A-Z, each word behind a blank, each text closed by END)."""

    def __init__(self, piece: Slice, path: str):
        self.names, start, end, self.number, self.first_word = _words(piece)
        data = piece.data
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).tobytes()
        parts = [data[s:e].decode("utf-8", "surrogatepass") for s, e in zip(start.tolist(), end.tolist())]
        found = [word_ids(path, parts[i:i + ENCODED]) for i in range(0, len(parts), ENCODED)] or [word_ids(path, [])]
        self.flat = np.concatenate([ids for ids, _ in found])
        self.first_id = np.r_[0, np.cumsum(np.concatenate([np.diff(first) for _, first in found]))]

    @property
    def ids(self) -> np.ndarray:
        return text_ids(self.number, self.first_word, self.flat, self.first_id)[0]

    @property
    def first(self) -> np.ndarray:
        return text_ids(self.number, self.first_word, self.flat, self.first_id)[1]


def text_ids(number: np.ndarray, first_word: np.ndarray, flat: np.ndarray, first_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a block, each text closed by END, and where each text's begin."""
    size = np.diff(first_id)[number]
    total = np.r_[0, np.cumsum(size)]
    ids = flat[np.repeat(first_id[number] - total[:-1], size) + np.arange(total[-1])]
    ends = total[first_word[1:]]
    return np.insert(ids, ends, END), np.r_[0, ends + np.arange(1, len(first_word))]


# ---------------------------------------------------------------- the model

def _positions(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts: start of the scored part, relative to the text, and the text."""
    n = np.diff(first)
    count = -(-n // STEP)
    text = np.repeat(np.arange(len(n)), count)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STEP
    return start, text


def gathered(ids: np.ndarray, first: np.ndarray, start: np.ndarray, text: np.ndarray):
    """Inputs (windows, LENGTH), where they exist, targets (windows, STEP) and where they exist. The input at a position is
    the id before it, END at the start of a text."""
    at = start[:, None] + np.arange(STEP - LENGTH, STEP)
    n = np.diff(first)[text][:, None]
    there = (at >= 0) & (at < n)
    where = first[text][:, None] + at
    inputs = np.where(at == 0, END, ids[np.clip(where - 1, 0, len(ids) - 1)])
    targets = ids[np.clip(where[:, LENGTH - STEP:], 0, len(ids) - 1)]
    return inputs, there, targets, there[:, LENGTH - STEP:]


_CAUSAL = np.where(np.arange(LENGTH)[None, :] <= np.arange(LENGTH - STEP, LENGTH)[:, None], 0, -1e9).astype(np.float32)
_DISTANCE = np.clip(np.arange(LENGTH - STEP, LENGTH)[:, None] - np.arange(LENGTH)[None, :], 0, LENGTH - 1)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last, short axis, kept, by one product."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], np.float32)).reshape(*x.shape[:-1], 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place. Rows without any mass give zeros."""
    if x.max(initial=0) > 60:  # far from what exp can take in single precision
        x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    x /= np.maximum(_sums(x), np.float32(1e-30))
    return x


def forward(m: dict, inputs: np.ndarray, there: np.ndarray):
    """Class scores (windows, STEP, CLASSES) and what the way back needs. ``inputs`` are embedding rows."""
    own = inputs[:, LENGTH - STEP:]
    q, k, v = m["q"][own], m["k"][inputs], m["v"][inputs]
    s = np.matmul(q, k.transpose(0, 2, 1))
    s += m["distance"][_DISTANCE] + _CAUSAL
    s += np.where(there, np.float32(0), np.float32(-1e9))[:, None, :]
    a = _softmax(s)
    context = a @ v
    # one product of two matrices, not one for each window
    z = (context.reshape(-1, VALUE) @ m["mix"]).reshape(*own.shape, SPACE)
    z += m["own"][own]
    h = np.maximum(z, 0)
    o = (h.reshape(-1, SPACE) @ m["out"]).reshape(*own.shape, CLASSES)
    o += m["bias"]
    return o, (own, q, k, v, a, context, z, h)


def _rows_added(shape, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(shape, np.float32)
    rows = rows.reshape(-1).astype(np.int16)
    order = np.argsort(rows, kind="stable")
    own = rows[order]
    at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    out[own[at]] = np.add.reduceat(values.reshape(-1, shape[1])[order], at)
    return out


def embedding_rows(counts: np.ndarray) -> np.ndarray:
    """Embedding row of every id: the frequent ids have one of their own, by rank."""
    top = np.argsort(-counts, kind="stable")[:FREQUENT]
    row = FREQUENT + np.arange(VOCABULARY) % RARE
    row[top] = np.arange(FREQUENT)
    return row


def _weights(row: np.ndarray, label: np.ndarray, counts: np.ndarray, rng) -> dict[str, np.ndarray]:
    """Weights to start from."""
    n_rows, inside = FREQUENT + RARE, counts + FLOOR
    m = {"q": rng.normal(0, 0.3, (n_rows, KEY)), "k": rng.normal(0, 0.3, (n_rows, KEY)), "v": rng.normal(0, 0.3, (n_rows, VALUE)),
         "own": rng.normal(0, 0.1, (n_rows, SPACE)), "distance": np.zeros(LENGTH), "mix": rng.normal(0, 0.25, (VALUE, SPACE)),
         "out": rng.normal(0, 0.2, (SPACE, CLASSES)), "bias": np.log(np.bincount(label, inside, CLASSES) / inside.sum() + 1e-12)}
    return {k: v.astype(np.float32) for k, v in m.items()}


class Descent:
    """Weights on their way down the mean loss of windows (Adam)."""

    def __init__(self, m: dict[str, np.ndarray], row: np.ndarray, label: np.ndarray):
        self.m, self.row, self.label, self.steps = m, row, label, 0
        self._mean, self._square = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))

    def step(self, ids: np.ndarray, first: np.ndarray, start: np.ndarray, text: np.ndarray, rate: float) -> None:
        m, label = self.m, self.label
        inputs, there, targets, wanted = gathered(ids, first, start, text)
        inputs = self.row[inputs]
        o, (own, q, k, v, a, context, z, h) = forward(m, inputs, there)
        do = _softmax(o)
        np.put_along_axis(do, label[targets][:, :, None], np.take_along_axis(do, label[targets][:, :, None], 2) - 1, 2)
        do *= wanted[:, :, None] / np.float32(wanted.sum())
        do, h = do.reshape(-1, CLASSES), h.reshape(-1, SPACE)
        dz = do @ m["out"].T
        dz *= z.reshape(-1, SPACE) > 0
        dcontext = (dz @ m["mix"].T).reshape(context.shape)
        da = dcontext @ v.transpose(0, 2, 1)
        ds = a * (da - _sums(da * a))
        grads = {"out": h.T @ do, "bias": do.sum(0), "mix": context.reshape(-1, VALUE).T @ dz,
                 "own": _rows_added(m["own"].shape, own, dz), "q": _rows_added(m["q"].shape, own, ds @ k),
                 "k": _rows_added(m["k"].shape, inputs, ds.transpose(0, 2, 1) @ q),
                 "v": _rows_added(m["v"].shape, inputs, a.transpose(0, 2, 1) @ dcontext),
                 "distance": np.bincount(_DISTANCE.reshape(-1), ds.sum(0).reshape(-1), LENGTH).astype(np.float32)}
        self.steps += 1
        for key, grad in grads.items():
            mean, square = self._mean[key], self._square[key]
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad * grad - square)
            m[key] -= np.float32(rate) * (mean / np.float32(1 - 0.9 ** self.steps)) / (
                np.sqrt(square / np.float32(1 - 0.99 ** self.steps)) + np.float32(1e-8))


def _begun(row: np.ndarray, label: np.ndarray, counts: np.ndarray, ids: np.ndarray, first: np.ndarray, rng) -> dict[str, np.ndarray]:
    """Weights after STEPS steps over windows of the given texts."""
    descent = Descent(_weights(row, label, counts, rng), row, label)
    start, text = _positions(first)
    if len(ids) > len(first) - 1:
        for step in range(1, STEPS + 1):
            chosen = rng.integers(len(start), size=BATCH)
            descent.step(ids, first, start[chosen], text[chosen], RATE * min(1.0, 2 * (1 - step / (STEPS + 1))))
    return descent.m


def train_model(ids: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """The model of some texts' ids; without any it spreads its belief evenly."""
    counts = np.bincount(ids, minlength=VOCABULARY).astype(float)
    row = embedding_rows(counts)
    label = classes(neighbours(row, ids, first), row, counts)[row]
    return _begun(row, label, counts, ids, first, np.random.default_rng(11)) | {"row": row.astype(np.int32), "label": label.astype(np.int32)}


def frequencies(label: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Natural logarithm of the share of each id in its class, from the counts of all ids."""
    inside = counts + FLOOR
    return np.log(inside / np.bincount(label, inside, CLASSES)[label])


def neighbours(row: np.ndarray, ids: np.ndarray, first: np.ndarray, learn: np.ndarray | None = None) -> np.ndarray:
    """How often rows stand before and behind every embedding row in the texts where ``learn``: (rows, 4 * NEAR) counts."""
    n_rows, wide = FREQUENT + RARE, 2 * NEAR
    rows = row[ids]
    inner = np.repeat(np.ones(len(first) - 1, bool) if learn is None else learn, np.diff(first))
    inner[first[1:] - 1] = False
    a, b = rows[:-1][inner[:-1]], rows[1:][inner[:-1]]
    seen = [np.bincount(x * wide + np.where(y < NEAR, y, NEAR + y % NEAR), minlength=n_rows * wide).reshape(n_rows, wide)
            for x, y in ((b, a), (a, b))]
    return np.concatenate(seen, 1)


def classes(seen: np.ndarray, row: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Class of every embedding row: k-means over the counts of its neighbours."""
    weight = np.bincount(row, counts, len(seen)).astype(np.float32)
    seen = (seen / np.maximum(weight, 1)[:, None] ** 0.75).astype(np.float32)
    order = np.argsort(-weight, kind="stable")
    centre = seen[order[:CLASSES]].copy()
    for _ in range(12):
        near = (seen @ centre.T - (centre * centre).sum(1) / 2).argmax(1)
        for c in range(CLASSES):
            own = near == c
            if (weight[own] > 0).any():
                centre[c] = np.average(seen[own], 0, weight[own])
    return near


def log10_classes(m: dict, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 of the model's probability of the classes of each text's ids."""
    start, text = _positions(first)
    total = np.zeros(len(first) - 1)
    ones = np.ones(CLASSES, np.float32)
    for i in range(0, len(start), SCORED):
        inputs, there, targets, wanted = gathered(ids, first, start[i:i + SCORED], text[i:i + SCORED])
        o, _ = forward(m, m["row"][inputs], there)
        if o.max(initial=0) > 60:  # far from what exp can take in single precision
            o -= o.max(-1, keepdims=True)
        np.exp(o, out=o)
        label = m["label"][targets]
        chosen = np.take_along_axis(o, label[:, :, None], 2)[:, :, 0]
        log = np.log(np.maximum(chosen, 1e-30)) - np.log(o.reshape(-1, CLASSES) @ ones).reshape(label.shape)
        total += np.bincount(text[i:i + SCORED], np.where(wanted, log, 0).sum(1), len(total))
    return total / np.log(10)


# ---------------------------------------------------------------- words of the corpus

_SCAN = ("block long, keys array<long>, learn array<boolean>, lengths binary, numbers binary, codes binary, counts binary, "
         "ids binary, sizes binary, texts long")


_KINDS = {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, behind that number of bytes."""
    most = int(numbers.max(initial=0))
    size = next(n for n in _KINDS if n == 8 or most < 1 << (8 * n))
    return bytes([size]) + numbers.astype(_KINDS[size]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, _KINDS[raw[0]], offset=1)


def _listed(column) -> pa.Array:
    return pa.ListArray.from_arrays([0, len(column)], column)


def _scan(path: str, limit: int):
    """(key, learn, text) to one row a block: keys, whether to learn from them, and number of words of its texts, the numbers of
    their words in the list of the block, and the list: hashes, counts in texts to learn from, ids and how many each word has.
    At last the number of texts to learn from."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            learns = batch.column("learn").to_numpy(zero_copy_only=False)
            for piece in slices(batch.column("text"), limit):
                block, n = Block(piece, path), len(piece)
                learn = learns[piece.first:piece.first + n].astype(bool)
                size = np.diff(block.first_word)
                counts = np.bincount(block.number, np.repeat(learn, size), len(block.names)).astype(np.int64)
                packed = (_packed(size), _packed(block.number), block.names.tobytes(), _packed(counts),
                          block.flat.astype("<u2").tobytes(), _packed(np.diff(block.first_id)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), _listed(batch.column("key").slice(piece.first, n)), _listed(pa.array(learn)),
                     *(pa.array([x], pa.binary()) for x in packed), pa.array([int(learn.sum())], pa.int64())],
                    [c.split()[0] for c in _SCAN.split(", ")])
                number += 1
    return run


def _first(sizes: bytes) -> np.ndarray:
    return np.r_[0, np.cumsum(_unpacked(sizes), dtype=np.int64)]


_READ = ("keys", "learn", "lengths", "numbers", "ids", "sizes")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Keys, learn, ids of the texts and where they begin, for each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys, learn = (batch.column(c)[i].values for c in ("keys", "learn"))
            lengths, numbers, ids, sizes = (batch.column(c)[i].as_py() for c in _READ[2:])
            found = text_ids(_unpacked(numbers), _first(lengths), np.frombuffer(ids, "<u2").astype(np.int64), _first(sizes))
            yield keys, learn.to_numpy(zero_copy_only=False).astype(bool), *found


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of blocks to (id, n): how often the ids of words stand in texts to learn from."""
    total = np.zeros(VOCABULARY, np.int64)
    for batch in batches:
        for ids, sizes, counts in zip(*(batch.column(c).to_pylist() for c in ("ids", "sizes", "counts"))):
            times = np.repeat(_unpacked(counts), _unpacked(sizes))
            total += np.bincount(np.frombuffer(ids, "<u2"), times, VOCABULARY).astype(np.int64)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int32()), "n": pa.array(total[used])})


def _split(parts: int):
    """Blocks' words to one row for each part of the hash range they touch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
        for batch in batches:
            for block, codes, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "codes", "counts"))):
                code, count = np.frombuffer(codes, np.uint64), _unpacked(counts)
                cut = np.r_[0, np.searchsorted(code, bounds), len(code)]
                used = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(used, pa.int64()), "block": pa.array([block] * len(used), pa.int64()),
                    "codes": pa.array([code[cut[p]:cut[p + 1]].tobytes() for p in used], pa.binary()),
                    "counts": pa.array([_packed(count[cut[p]:cut[p + 1]]) for p in used], pa.binary())})
    return run


def _summed(group: pa.Table) -> pa.Table:
    """Totals of one part of the hash range, dealt back to the blocks; distinct words with a count in the row of block -1. Each
    block's hashes ascend, so the part is summed in smaller ranges, whose arrays are small."""
    blocks, part = group.column("block").to_pylist(), group.column("part")[0].as_py()
    codes = [np.frombuffer(x, np.uint64) for x in group.column("codes").to_pylist()]
    counts = [_unpacked(x) for x in group.column("counts").to_pylist()]
    low, high = int(min(c[0] for c in codes)), int(max(c[-1] for c in codes)) + 1
    ranges = sum(map(len, codes)) // SUMMED + 1
    bounds = np.array([low + (high - low) * k // ranges for k in range(1, ranges)], np.uint64)
    cuts = [np.r_[0, np.searchsorted(c, bounds), len(c)] for c in codes]
    back, distinct = [[] for _ in codes], 0
    for k in range(ranges):
        some = [slice(cut[k], cut[k + 1]) for cut in cuts]
        names, inverse = np.unique(np.concatenate([c[s] for c, s in zip(codes, some)]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([n[s] for n, s in zip(counts, some)]), len(names)).astype(np.int64)
        distinct += int((total > 0).sum())
        at = 0
        for own, s in zip(back, some):
            own.append(_packed(total[inverse[at:at + s.stop - s.start]]))
            at += s.stop - s.start
    return pa.table({"block": pa.array([*blocks, -1], pa.int64()), "part": pa.array([part] * (len(blocks) + 1), pa.int64()),
                     "totals": pa.array([*(_packed(np.concatenate([*map(_unpacked, own)])) for own in back),
                                         _packed(np.array([distinct]))], pa.binary())})


def _score(model, shares, size: int, distinct: int, ends: int):
    """A block and the totals of its words to results."""
    def run(blocks: pa.Table, totals: pa.Table) -> pa.Table:
        totals = totals.sort_by("part")
        c = [_unpacked(x) for x in totals.column("totals").to_pylist()]
        count = np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)
        log = np.log10((count + 1) / (size + distinct + 1))
        end = np.log10((ends + 1) / (size + distinct + 1))
        (keys, learn, ids, first), = _read(blocks.combine_chunks().to_batches())
        numbers = _unpacked(blocks.column("numbers")[0].as_py())
        first_word = _first(blocks.column("lengths")[0].as_py())
        n = np.diff(first_word)
        text = np.repeat(np.arange(len(n)), n)
        inside = np.add.reduceat(shares.value[ids], first[:-1])
        return pa.table({"key": keys, "learn": pa.array(learn), "n_tokens": pa.array(n + 1, pa.int64()),
                         "n_known": pa.array(np.bincount(text, count[numbers] > 0, len(n)).astype(np.int64) + int(ends > 0)),
                         "train_tokens": np.full(len(n), size),
                         "base_score": pa.array(np.bincount(text, log[numbers], len(n)) + end, pa.float64()),
                         "score": pa.array(log10_classes(model.value, ids, first) + inside, pa.float64())})
    return run


def scan(docs: DataFrame, learn, *, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = SLICE) -> DataFrame:
    """The blocks of ``docs``, written once: what ``learnt`` and ``scored`` read instead of texts."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).alias("text"))
    return scratch(docs.sparkSession).save(source.mapInArrow(_scan(path or vocabulary_path(), limit), _SCAN), "scanned")


def _counted(blocks: DataFrame) -> np.ndarray:
    """How often every id stands in the texts to learn from."""
    counts = np.zeros(VOCABULARY)
    for r in blocks.select("ids", "sizes", "counts").mapInArrow(_id_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]  # one row for each id of the vocabulary at most
    counts[END] += blocks.agg(F.sum("texts")).first()[0] or 0
    return counts


# ---------------------------------------------------------------- learning from all texts

_SUMS = "name string, part int, data binary"
#: Numbers of an array that travel in one row.
NUMBERS = 1 << 16


def _rows(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, values in sums.items():
        values = values.reshape(-1).astype(np.int64)
        for part, at in enumerate(range(0, len(values), NUMBERS)):
            yield pa.RecordBatch.from_pydict({"name": [name], "part": pa.array([part], pa.int32()), "data": [values[at:at + NUMBERS].tobytes()]})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one name and part to their sum, one batch at a time."""
    total: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for name, part, data in zip(*(batch.column(c).to_pylist() for c in ("name", "part", "data"))):
            values = np.frombuffer(data, np.int64)
            total[name, part] = total[name, part] + values if (name, part) in total else values
    for (name, part), values in total.items():
        yield pa.RecordBatch.from_pydict({"name": [name], "part": pa.array([part], pa.int32()), "data": [values.tobytes()]})


def _total(blocks: DataFrame, run) -> dict[str, np.ndarray]:
    """Sums over all tasks of what ``run`` makes of their blocks. Arrays are as large as the model, whatever the corpus; their parts
    are added in tasks."""
    added = blocks.select(*_READ).mapInArrow(run, _SUMS).repartition("name", "part").mapInArrow(_add, _SUMS).collect()
    found: dict[str, list] = {}
    for r in sorted(added, key=lambda r: (r["name"], r["part"])):
        found.setdefault(r["name"], []).append(np.frombuffer(bytes(r["data"]), np.int64))
    return {name: np.concatenate(parts) for name, parts in found.items()}


def _neighbours(row):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, learn, ids, first in _read(batches):
            total = total + neighbours(row.value, ids, first, learn)
        if not np.isscalar(total):
            yield from _rows({"seen": total})
    return run


def _some(share: float):
    """The ids of about a share of the texts to learn from, by a hash of the key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, learn, ids, first in _read(batches):
            code = keys.fill_null(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
            chosen = np.flatnonzero(learn & (code < share * 2.0 ** 32))
            yield pa.RecordBatch.from_pydict({
                "all": pa.array(np.zeros(len(chosen)), pa.int32()),
                "ids": pa.array([ids[first[i]:first[i + 1]].astype("<u2").tobytes() for i in chosen], pa.binary())})
    return run


def _begin(known):
    def run(group: pa.Table) -> pa.Table:
        row, label, counts = known.value
        texts = [np.frombuffer(x, "<u2").astype(np.int64) for x in sorted(group.column("ids").to_pylist())]
        m = _begun(row, label, counts, np.concatenate(texts), np.r_[0, np.cumsum([len(x) for x in texts])], np.random.default_rng(11))
        return pa.table({"name": list(m), "data": pa.array([v.tobytes() for v in m.values()], pa.binary())})
    return run


def _descend(known, begun):
    """One pass over the windows of all texts to learn from: by how much the weights moved, times the windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, label, _ = known.value
        descent, seen = Descent({k: v.copy() for k, v in begun.value.items()}, row, label), 0
        for _, learn, ids, first in _read(batches):
            start, text = _positions(first)
            order = np.random.default_rng(11).permutation(np.flatnonzero(learn[text]))
            for at in range(0, len(order), PASS_BATCH):
                chosen = order[at:at + PASS_BATCH]
                descent.step(ids, first, start[chosen], text[chosen], PASS_RATE)
            seen += len(order)
        if seen:
            moved = {k: np.rint((v.astype(float) - begun.value[k]) * FINE) * seen for k, v in descent.m.items()}
            yield from _rows(moved | {"windows": np.array([seen])})
    return run


def learnt(blocks: DataFrame, rows: int = TRAIN_TEXTS) -> dict[str, np.ndarray]:
    """The model of all texts to learn from of ``blocks``."""
    send = blocks.sparkSession.sparkContext.broadcast
    counts = _counted(blocks)
    n = counts[END]
    if not n:
        return train_model(np.zeros(0, np.int64), np.zeros(1, np.int64))
    row = embedding_rows(counts)
    seen = _total(blocks, _neighbours(send(row)))["seen"].reshape(FREQUENT + RARE, -1)
    label = classes(seen, row, counts)[row]
    known = send((row, label, counts))
    begun = {k: v.shape for k, v in _weights(row, label, counts, np.random.default_rng(11)).items()}
    some = blocks.select(*_READ).mapInArrow(_some(rows / n), "all int, ids binary")
    found = {r["name"]: np.frombuffer(bytes(r["data"]), np.float32).reshape(begun[r["name"]])
             for r in some.groupBy("all").applyInArrow(_begin(known), "name string, data binary").collect()}
    begun = found or _weights(row, label, counts, np.random.default_rng(11))
    moved = _total(blocks, _descend(known, send(begun)))
    windows = float(moved.pop("windows")[0])
    m = {k: (v + (moved[k] / (FINE * windows)).reshape(v.shape)).astype(np.float32) for k, v in begun.items()}
    return m | {"row": row.astype(np.int32), "label": label.astype(np.int32)}


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rows: int = TRAIN_TEXTS,
          path: str | None = None) -> dict[str, np.ndarray]:
    """A model of all texts; its weights start from about ``rows`` of them."""
    return learnt(scan(docs, F.lit(True), key=key, text=text, path=path), rows)


# ---------------------------------------------------------------- scores

def score(docs: DataFrame, model: dict[str, np.ndarray], learn, *, key: str = "doc_id", text: str = "text",
          path: str | None = None, limit: int = SLICE) -> DataFrame:
    """(key, learn, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Tokens are words in lower case A-Z and one end per text; counts come from the rows where the column expression ``learn``
    is true (null: false). Null texts are empty, null keys carried, repeated rows scored and counted one by one; an empty
    table has no rows; other columns are not read; texts are read whole."""
    return scored(scan(docs, learn, key=key, text=text, path=path, limit=limit), model, key)


def scored(blocks: DataFrame, model: dict[str, np.ndarray], key: str = "doc_id") -> DataFrame:
    """``score`` of the texts of ``blocks``."""
    spark = blocks.sparkSession
    held = blocks.agg(F.sum(F.length("codes")).alias("bytes"), F.sum("texts").alias("texts")).first()
    ends = held["texts"] or 0
    model = spark.sparkContext.broadcast(model)
    shares = spark.sparkContext.broadcast(frequencies(model.value["label"], _counted(blocks)) / np.log(10))
    parts = int((held["bytes"] or 0) // (8 * PART)) + 1
    totals = scratch(spark).save(
        blocks.select("block", "codes", "counts").mapInArrow(_split(parts), "part long, block long, codes binary, counts binary")
        .groupBy("part").applyInArrow(_summed, "block long, part long, totals binary"), "totals")
    words = blocks.select("counts").mapInArrow(_sum_of("counts"), "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    distinct = totals.filter("block = -1").select("totals").mapInArrow(_sum_of("totals"), "n long").agg(
        F.sum("n").alias("n")).first()["n"] or 0
    out = blocks.select("block", *_READ).groupBy("block").cogroup(totals.filter("block >= 0").groupBy("block")).applyInArrow(
        _score(model, shares, int(words + ends), int(distinct + (ends > 0)), int(ends)),
        "key long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)


def _sum_of(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([int(_unpacked(x).sum(dtype=np.int64))
                                                             for x in batch.column(column).to_pylist()], pa.int64())})
    return run


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document. A null or empty text has one token, its end; repeated rows count and are scored
    each; an empty table gives no rows."""
    blocks = scan(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    out = scored(blocks, learnt(blocks))
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
