"""Token ids of many texts at once, by two public kinds of vocabulary.

``BytePair`` reads the byte-level vocabulary of a ``tokenizers`` file and merges with ``tiktoken``, which takes the same
merges in a quarter of the time; ``Pieces`` segments with ``sentencepiece``, once for each distinct marked word of a
slice. Both give one flat array of ids with the place where each text begins, and the bytes that every id stands for."""
from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
_RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Characters that are given to the merging library at once; longer texts are cut at safe places.
LONG_TEXT = 200_000
LONG_RUN = 5_000
#: Chunks whose ids a Python worker keeps; the memory starts anew when it is full.
REMEMBERED = 300_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Flat:
    """Byte strings in one array: entry i is data[first[i]:first[i + 1]]."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.first = np.r_[0, np.cumsum(self.size)]
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def take(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The named entries one behind the other, and where each begins (one more than entries)."""
        size = self.size[number]
        at = np.r_[0, np.cumsum(size)]
        return self.data[np.repeat(self.first[number] - at[:-1], size) + np.arange(at[-1])], at


def joined(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of ids one behind the other, and where each begins (one more than arrays)."""
    first = np.r_[0, np.cumsum([len(x) for x in lists], dtype=np.int64)].astype(np.int64)
    return (np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)), first


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1 as it is, all others, in order,
    from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class BytePair:
    """Ids of a byte-level vocabulary whose ids are in the order of its merges. ``special`` are its special tokens."""

    #: A blank before a visible character always begins a new part, whatever stands around it.
    _CUT = re.compile(r" (?=\S)")
    #: White space (Unicode property) in long runs: all but the last character before a visible one is one part, which is
    #: merged directly, since the library's pattern keeps a step back for each of them.
    _LONG_RUN = re.compile("([\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,})" % LONG_RUN)

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        if len(alphabet) != 256 or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a vocabulary without all bytes cannot give every text back")
        entries = [b""] * (max(*ranks.values(), *self.special.values()) + 1)
        for token, i in ranks.items():
            entries[i] = token
        for token, i in self.special.items():
            entries[i] = token.encode()
        self.bytes = Flat(entries)
        self._merge = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _merged(self, text: str) -> np.ndarray:
        return self._merge.encode_to_numpy(text, disallowed_special=())

    def _ordinary(self, text: str) -> np.ndarray:
        if len(text) < LONG_RUN or (len(text) <= LONG_TEXT and not self._LONG_RUN.search(text)):
            return self._merged(text)
        out, before = [], ""
        parts = self._LONG_RUN.split(text)
        for k, part in enumerate(parts):
            if k % 2:
                inner = part[:-1] if parts[k + 1] else part
                before = part[len(inner):]
                out.append(self._merge._encode_single_piece(inner.encode()))
                continue
            part, at = before + part, 0
            for cut in self._CUT.finditer(part):
                if cut.start() - at >= LONG_TEXT // 2:
                    out.append(self._merged(part[at:cut.start()]))
                    at = cut.start()
            out.append(self._merged(part[at:]))
        return np.concatenate(out).astype(np.int64)

    def encode(self, texts: list[str], special: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids and first places. With ``special`` the strings of special tokens become their ids, as ``tokenizers`` does by
        itself; else they are plain text."""
        out = []
        for text in texts:
            if special and self._specials is not None and self._specials.search(text):
                parts = self._specials.split(text)
                out.append(np.concatenate([[self.special[p]] if k % 2 else self._ordinary(p) for k, p in enumerate(parts)]).astype(np.int64))
            else:
                out.append(self._ordinary(text))
        return joined(out)


class Pieces:
    """Ids of a sentencepiece model by a table of distinct chunks.

    A chunk is a run of markers (U+2581, which also stands for a blank) with the characters up to the next one. No piece of
    such a model goes on behind a character that a marker follows (checked when the model is read), so chunks are segmented
    apart: each distinct chunk of a call once, by the library, and the ids are joined back by position. A model with pieces
    across markers is asked for whole texts instead."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.bytes = Flat([bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(MARK, " ").encode()
                           for i, p in enumerate(pieces)])
        crossing = re.compile(f"[^{MARK}]{MARK}")
        # Words apart must give what they give together, the blank in front included.
        probe = self.library.encode(["a b", "a", "b", " b"])
        self.chunks = (not any(crossing.search(p) for p in pieces) and probe[0] == probe[1] + probe[2] and probe[2] != probe[3])
        self._lone = self.library.encode("a ")[len(probe[1]):]
        self._forget()

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self._ids, self._size, self._same = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _segment(self, chunks: list[str]) -> None:
        """Learn the ids of distinct chunks, each of which begins with the marker that the library sets in front itself."""
        found = self.library.encode([c[1:] for c in chunks], num_threads=1)
        found = [self._lone if c == MARK else ids for c, ids in zip(chunks, found)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(size.sum()))
        self._same = np.r_[self._same, self._unchanged(chunks, ids, size)]
        self._ids = np.r_[self._ids, ids]
        self._number.update(zip(chunks, range(len(self._size), len(self._size) + len(chunks))))
        self._size = np.r_[self._size, size]

    def _unchanged(self, chunks: list[str], ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes of the ids of each chunk are those of the chunk, the marker read as a blank."""
        data, at = self.bytes.take(ids)
        ends = at[np.r_[0, np.cumsum(size)]]
        wanted = [c.replace(MARK, " ").encode() for c in chunks]
        want = np.frombuffer(b"".join(wanted), np.uint8)
        same = np.diff(ends) == np.fromiter(map(len, wanted), np.int64, len(wanted))
        if same.all() and np.array_equal(data, want):
            return same
        return np.array([data[x:y].tobytes() == w for x, y, w in zip(ends[:-1], ends[1:], wanted)], bool)

    @staticmethod
    def _chunked(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Chunks of all texts, and how many each text has."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        parts = [_RUNS.findall(t) if MARK * 2 in t else [MARK + c for c in t.split(MARK)[1:]] for t in marked]
        return pa.array(itertools.chain.from_iterable(parts), pa.string()), np.fromiter(map(len, parts), np.int64, len(parts))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each begins. An empty text has no ids."""
        return self.encode_compared(texts)[:2]

    def encode_compared(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``encode``, and for each text whether the bytes of its ids are a blank and the text."""
        if not self.chunks:
            rows = self.library.encode(texts, num_threads=1)
            flat, first = joined([np.array(ids, np.int64) for ids in rows])
            return flat, first, np.array([self.bytes.take(np.array(r, np.int64))[0].tobytes() == (" " + t).encode() for r, t in zip(rows, texts)], bool)
        chunks, n = self._chunked(texts)
        table = chunks.dictionary_encode()
        distinct = table.dictionary.to_pylist()
        if len(self._number) + len(distinct) > REMEMBERED:
            self._forget()
        self._segment([c for c in distinct if c not in self._number])
        known = np.fromiter(map(self._number.__getitem__, distinct), np.int64, len(distinct))
        start = np.r_[0, np.cumsum(self._size)]
        number = known[table.indices.to_numpy()]
        size = self._size[number]
        at = np.r_[0, np.cumsum(size)]
        text = np.r_[0, np.cumsum(n)]
        same = np.array([bool(t) and MARK not in t for t in texts], bool)
        if not self._same[known].all():
            odd = np.r_[0, np.cumsum(~self._same[number])]
            same &= odd[text[1:]] == odd[text[:-1]]
        return self._ids[np.repeat(start[number] - at[:-1], size) + np.arange(at[-1])], at[text], same


_loaded: dict[tuple, object] = {}


def loaded(kind: type, path: str):
    """One vocabulary of a kind for each Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the work
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def text_lists(column: pa.Array, limit: int):
    """(first row, texts) of consecutive rows with about ``limit`` characters, or one longer text; a null is empty."""
    texts = pc.fill_null(column.cast(pa.large_string()), "").to_pylist()
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= limit):
            n += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j
