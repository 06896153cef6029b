"""Vocabularies, alignment and sentencepiece ids against the libraries and plain versions."""
import collections
import functools
import random

import numpy as np
import pytest

from showerframe.llm import alignment, pieces
from showerframe.llm.vocabularies import MARK, BytePair, Pieces, byte_alphabet, loaded, vocabulary_path

from . import brute
from .conftest import EDGE

PIECES = vocabulary_path("piece_bpe_32k.model")
by_row = lambda rows: sorted(rows, key=repr)


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    signs = list("aabbe tin  \n\t\r.,'sx1029ßéü日本🙂 　 \x1c\x85▁\xa0\x00<>|") + ["<|endoftext|>", "'ll", "   ", "\n\n", "aaaa", "----", " The"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(n)]
    return texts + [c * k for c in ("a", " ", "-", "\n", "é", " a", "aab", MARK, "0", "ab") for k in (1, 2, 3, 7, 8, 16, 33, 120)] + [
        " lead", "trail ", "a\nb \nc", "it's we'll", "\x1c x \x85y", "a  b", "tab\t tab", "end\n"]


@pytest.mark.parametrize("special", [True, False])
def test_byte_pairs_equal_the_tokenizer(documents, special):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(vocabulary_path())
    plain.encode_special_tokens = not special
    texts = odd_texts(3000) + [t or "" for _, t, _ in EDGE] + [r.text for r in documents.select("text").limit(60).collect()]
    texts += ["word " * 30_000 + "x", "a b" + " " * 12_000 + "c" + "\n" * 6_000 + " d" + "　" * 7_000]
    ids, first = loaded(BytePair, vocabulary_path()).encode(texts, special=special)
    for i, t in enumerate(texts):
        assert ids[first[i]:first[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t[:80]
    ids, first = loaded(BytePair, vocabulary_path()).encode([" " * 1_000_000 + "b"])
    assert len(ids) and set(byte_alphabet().values()) == set(range(256))


def test_pieces_equal_the_library(edge, documents, empty, monkeypatch):
    from showerframe.llm import vocabularies
    own = Pieces(PIECES)
    monkeypatch.setattr(vocabularies, "REMEMBERED", 500)  # the table starts anew many times
    texts = odd_texts(3000)
    for i in range(0, len(texts), 700):
        some = texts[i:i + 700]
        ids, first, same = own.encode_compared(some)
        want = own.library.encode(some)
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == want
        assert same.tolist() == [bool(t) and MARK not in t for t in some]
    own.chunks = False  # a model whose pieces cross markers is asked for whole texts
    ids, first, whole = own.encode_compared(some)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == want and whole.tolist() == same.tolist()
    for frame, rows in ((edge, [(k, t) for k, t, _ in EDGE]), (documents, [tuple(r) for r in documents.select("doc_id", "text").collect()])):
        for limit in (pieces.SLICE, 50):
            got = [tuple(r) for r in pieces.encode(frame, limit=limit).collect()]
            assert by_row(got) == by_row((k, i := own.library.encode(t or ""), own.library.decode(i)) for k, t in rows)
    assert pieces.encode(empty).count() == 0


def test_registered_digests_of_pieces(spark, documents):
    from .conftest import SF
    library = Pieces(PIECES).library
    want = {r.doc_id: library.encode(r.text or "") for r in documents.collect()}
    for r in pieces.op13_sentencepiece(spark, SF).collect():
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), brute.sha(",".join(map(str, ids)).encode()), brute.sha(library.decode(ids).encode()))


@functools.cache
def plain_tokenizer():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.encode_special_tokens = True
    return tokenizer


def plain_groups(text):
    """[(ids of A, ids of B)] of a text, byte by byte."""
    a_side, b_side = plain_tokenizer(), loaded(Pieces, PIECES)
    alphabet = byte_alphabet()
    a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
    b = b_side.library.encode(text) if text else []
    size_a = [len(bytes(alphabet[c] for c in a_side.id_to_token(i))) for i in a]
    raw_b = [bytes([int(p[3:5], 16)]) if b_side.library.is_byte(i) else p.replace(MARK, " ").encode() for i, p in ((i, b_side.library.id_to_piece(i)) for i in b)]
    if not text or b"".join(raw_b) != (" " + text).encode():
        return []
    ends_a, ends_b = np.cumsum(size_a).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return groups


def plain_alignment(rows):
    found = [plain_groups(t or "") for _, t in rows]
    links = [[(x, y) for g in groups for x in g[0] for y in g[1]] for groups in found]
    count = collections.Counter(p for own in links for p in set(own))
    top = collections.defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    for (k, _), groups, own in zip(rows, found, links):
        yield (k, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(own),
               sum(count[p] == top[p[0]] for p in own), sum(count[p] for p in own),
               ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups))


@pytest.mark.parametrize("limit", [2_000_000, 60])
@pytest.mark.parametrize("links", [alignment.PLAIN_LINKS, 3])
def test_alignment_equals_plain(spark, ws, edge, empty, monkeypatch, limit, links):
    """With few plain links most groups are counted by distinct ids; with a small limit every text is a block."""
    monkeypatch.setattr(alignment, "PLAIN_LINKS", links)
    own = [(k, t) for k, t, _ in EDGE if not t or len(t) < 20_000] + [(100 + i, t) for i, t in enumerate(odd_texts(60, seed=5))]
    frame = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    columns = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    texts, pairs = alignment.count_links(ws, alignment.align(frame, limit=limit))
    assert by_row(tuple(r) for r in texts.select(columns).collect()) == by_row(plain_alignment(own))
    top = pairs.groupBy("a").agg({"n": "max"}).count()
    assert pairs.filter("best").select("a").distinct().count() == top
    assert alignment.count_links(ws, alignment.align(empty))[0].count() == 0


def test_registered_alignment(spark, documents):
    from .conftest import SF
    rows = [tuple(r) for r in documents.select("doc_id", "text").limit(10_000).collect()]
    want = by_row((*r[:7], brute.sha(r[7].encode()) if r[7] else "") for r in plain_alignment(rows))
    assert by_row(tuple(r) for r in alignment.op12_alignment(spark, SF).collect()) == want


@pytest.mark.parametrize("lane", [3, 40, 2_000])
def test_lockstep_equals_common_ends(lane):
    rng = np.random.default_rng(lane)
    for _ in range(30):
        ends_a, ends_b, first_a, first_b, base = [], [], [0], [0], 0
        for _ in range(int(rng.integers(1, 8))):
            n = int(rng.integers(1, 600))
            for ends, first in ((ends_a, first_a), (ends_b, first_b)):
                own = np.unique(np.r_[rng.integers(1, n + 1, int(rng.integers(0, n))), n]) + base
                ends.extend(own.tolist())
                first.append(len(ends))
            base += n
        a, b = alignment.lockstep(np.array(ends_a), np.array(ends_b), np.array(first_a), np.array(first_b), lane)
        common = sorted(set(ends_a) & set(ends_b))
        assert a.tolist() == [0] + [ends_a.index(c) + 1 for c in common]
        assert b.tolist() == [0] + [ends_b.index(c) + 1 for c in common]
