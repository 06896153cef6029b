"""Near duplicates and repeated passages against plain versions, on edge rows and on a whole small table."""
import hashlib
import re

import numpy as np
import pytest

from showerframe.llm import near_dedup, repeats, suffix_array, suffix_tree
from showerframe.llm.common import BATCH_BYTES, scratch
from showerframe.llm.graph import components

from . import brute
from .conftest import EDGE

by_row = lambda rows: sorted(rows, key=repr)


def test_near_groups_equal_all_pairs(edge, documents):
    for frame, rows, (width, num, den) in ((edge, [(k, t) for k, t, _ in EDGE], (5, 4, 5)),
                                           (documents, [tuple(r) for r in documents.select("doc_id", "text").collect()], (3, 85, 100))):
        want = [(k, n, c, k == c) for (k, _), (n, c) in zip(rows, brute.near(rows, width, num, den))]
        got = [tuple(r) for r in near_dedup.near_groups(frame, width=width, num=num, den=den).collect()]
        assert by_row(got) == by_row(want)


def test_near_links_cross_blocks(spark, monkeypatch):
    """A crowd of slightly different texts that fills several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(60):
        text = list(base)
        for c in range(k % 4):
            text[(k * 7 + c * 13) % 60] = f"changed{k}_{c}"
        rows.append((k, " ".join(text)))
    got = {r[0]: (r[1], r[2]) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.near(rows, 3, 85, 100)
    assert got == {k: v for (k, _), v in zip(rows, want)}
    assert len({v[1] for v in want}) > 1


def test_keep_one_keeps_the_smallest(edge, empty):
    kept = near_dedup.keep_one(edge)
    assert kept.columns == edge.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 7 in ids and not {8, 9, 10} & set(ids)
    assert {1, 2, 3, 4, 5, 6, 12, 13, 14} <= set(ids)
    assert near_dedup.keep_one(empty).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 2**63, 600, dtype=np.uint64)
    a, b = np.sort(np.r_[shared, rng.integers(0, 2**63, 75, dtype=np.uint64)]), np.sort(np.r_[shared, rng.integers(0, 2**63, 75, dtype=np.uint64)])
    s = near_dedup.superminhash(np.r_[a, b, a[:1]], np.array([0, 675, 1350, 1351]), 192)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.1
    assert len(set(s[2].tolist())) == 192  # one element visits every slot


def test_components(spark, ws):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "e"), ("f", "f"), (None, "a"), ("e", "g"), ("z", "y")], "a string, b string")
    got = {r[0]: r[1] for r in components(ws, edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "g": "d", "z": "y", "y": "y"}
    assert components(ws, edges.filter("false")).count() == 0


def expected(rows, by_words):
    if by_words:
        sequences = [tuple((t or "").encode().split()) for t in rows]
        flags = brute.covered(sequences, 35)
        return [(len(q), sum(f), brute.sha(b" ".join(w for w, x in zip(q, f) if not x))) for q, f in zip(sequences, flags)]
    sequences = [(t or "").encode() for t in rows]
    flags = brute.covered(sequences, 400)
    return [(len(q), sum(f), len(re.findall("1+", "".join("01"[x] for x in f))), brute.sha(bytes(c for c, x in zip(q, f) if not x)))
            for q, f in zip(sequences, flags)]


@pytest.mark.parametrize("by_words", [True, False])
@pytest.mark.parametrize("crowd", [50_000, 1])
def test_repeated_windows_equal_plain(edge, documents, monkeypatch, by_words, crowd):
    """With a crowd of 1 every shared core is counted window by window instead of in a group."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rule, resolve = (suffix_tree.RULE, suffix_tree.tree_repeats) if by_words else (suffix_array.RULE, suffix_array.merge_suffixes)
    tables = [(edge, [(k, t) for k, t, _ in EDGE]), (documents, [tuple(r) for r in documents.select("doc_id", "text").collect()])]
    for frame, rows in tables[:1 if crowd == 1 else 2]:
        want = [(k, *v) for (k, _), v in zip(rows, expected([t for _, t in rows], by_words))]
        columns = ["doc_id", "n", "n_removed", "kept_sha256"] if by_words else ["doc_id", "n", "n_removed", "n_spans", "kept_sha256"]
        got = [tuple(r) for r in repeats.report(rule, resolve, frame, "doc_id", "text").select(*columns).collect()]
        assert by_row(got) == by_row(want)
        if not by_words:
            out = suffix_array.report(frame).collect()
            assert by_row((r.doc_id, r.n, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == by_row(want)
            assert all(0 <= len(r.kept.encode()) - (r.n - r.n_removed) <= 6 * r.n_spans for r in out)


def thue_morse(n, a, b):
    """``n`` signs in Thue-Morse order: with odd powers modulo 2**64, swapping ``a`` and ``b`` changes no sum of 1,024 of them."""
    return ["ab"[bin(i).count("1") % 2] == "a" and a or b for i in range(n)]


def test_arrangements_of_two_symbols_stay_apart(spark):
    """Different texts whose symbols cancel in sums of powers modulo 2**64 are different texts."""
    from showerframe.llm import quality
    from showerframe.llm.common import byte_symbols, prefix_hash, ranges_hash, sum_prefix, sums_hash
    one, other = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    symbols, low, high = byte_symbols(np.frombuffer((one + other).encode(), np.uint8)), np.array([0, 1024]), np.array([1024, 2048])
    assert len(set(sums_hash(sum_prefix(symbols), low, high).tolist())) == 1
    assert len(set(ranges_hash(prefix_hash(symbols), low, high).tolist())) == 2
    frame = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    flags = brute.covered([one.encode(), other.encode()], 400)
    assert sorted((r.doc_id, r.n_removed) for r in suffix_array.report(frame).collect()) == [(i + 1, sum(f)) for i, f in enumerate(flags)]
    words = [" ".join(thue_morse(1024, "left", "right")), " ".join(thue_morse(1024, "right", "left"))]
    flags = brute.covered([tuple(w.split()) for w in words], 35)
    frame = spark.createDataFrame([(1, words[0]), (2, words[1])], "doc_id long, text string")
    got = repeats.report(suffix_tree.RULE, suffix_tree.tree_repeats, frame, "doc_id", "text").collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(i + 1, sum(f)) for i, f in enumerate(flags)]
    tail = " ".join(f"w{i}" for i in range(30))
    frame = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{other} {tail} {one} {one} x {one} y {one}")], "doc_id long, text string")
    assert near_dedup.near_groups(spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")).select(
        "component_id").distinct().count() == 2
    rows = frame.unionByName(spark.createDataFrame([(3, f"{one}\n{other}")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.n_dup_lines for r in quality.judge(rows, quality.train(rows, labels)).collect()} == {0}


def test_repeats_of_an_empty_table(empty):
    for rule, resolve in ((suffix_tree.RULE, suffix_tree.tree_repeats), (suffix_array.RULE, suffix_array.merge_suffixes)):
        assert repeats.report(rule, resolve, empty, "doc_id", "text").count() == 0


def test_removal_keeps_rows_columns_and_characters(spark, edge, empty):
    out = suffix_array.remove_repeats(edge)
    assert out.columns == edge.columns and out.dtypes == edge.dtypes
    rows = [t for _, t, _ in EDGE]
    flags = brute.covered([(t or "").encode() for t in rows], 400)
    want = sorted((k is None, k or 0, None if t is None else bytes(c for c, x in zip(t.encode(), f) if not x).decode())
                  for (k, t, _), f in zip(EDGE, flags) if k != 13)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in out.collect() if r.doc_id != 13)
    assert [w[2] for w in want] == [g[2] for g in got]
    assert out.filter("text is not null and n_chars != length(text)").count() == 0
    assert suffix_array.remove_repeats(empty).count() == 0
    shared = "é" * 300  # a repeat that starts inside a character leaves the character
    cut = spark.createDataFrame([(1, "é" + shared + "a"), (2, "\u0129" + shared + "b")], "doc_id long, text string")
    assert {r.text for r in suffix_array.remove_repeats(cut).collect()} <= {"éa", "a", "\u0129b", "ééa"}


def test_reported_texts_leave_in_slices():
    """A batch of many texts comes back in parts of about a slice, in order, not as one batch of all that is kept."""
    import pyarrow as pa

    from showerframe.llm.common import SLICE_BYTES
    from showerframe.llm.suffix_array import RULE, _cut_text, _reported

    texts = [f"{k} " * 30_000 for k in range(40)]
    rows = pa.RecordBatch.from_pydict({
        "key": pa.array(range(40), pa.int64()), "row": pa.array([{"doc_id": k} for k in range(40)]), "text": texts,
        "copied": [k == 7 for k in range(40)], "lows": pa.array([[0] if k == 3 else None for k in range(40)], pa.list_(pa.int64())),
        "highs": pa.array([[10] if k == 3 else None for k in range(40)], pa.list_(pa.int64()))})
    for run, column in ((_reported(RULE), "kept"), (_cut_text(RULE), "new_text")):
        out = list(run(iter([rows])))
        assert max(b.nbytes for b in out) < 2 * SLICE_BYTES + max(map(len, texts))
        keys = [k for b in out for k in (b.column("key").to_pylist() if column == "kept" else [r["doc_id"] for r in b.column("row").to_pylist()])]
        kept = [t for b in out for t in b.column(column).to_pylist()]
        assert keys == list(range(40)) and kept[7] == "" and kept[3] == texts[3][10 + RULE.length:]
        assert kept[0] == (texts[0] if column == "kept" else None)


@pytest.mark.parametrize("crowd", [50_000, 1])
def test_passages_of_over_fifty_words_are_told(spark, monkeypatch, crowd):
    """A passage of 51 words, far below 400 bytes, stands in two texts, at the end of one of them: nothing is removed, and both
    say so. Windows of both lengths equal the plain ones, those that end with their text included."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    passage = " ".join(f"w{i:03}" for i in range(51))
    words = lambda c, n: " ".join(f"{c}{i * i % 9973}" for i in range(n))
    texts = [f"{words('a', 90)} {passage}", f"{words('b', 70)} {passage} {words('c', 200)}", words("d", 300), f"{words('e', 9)} {words('d', 120)}",
             " ".join(passage.split()[:50]) + " x", "short", None, words("f", 60), words("f", 60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_array.report(frame).collect()}
    assert [got[k].n_passages for k in range(9)] == [1, 1, 1, 1, 0, 0, 0, 1, 1]
    for (k, t), w in zip(enumerate(texts), expected(texts, False)):
        assert (got[k].n, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == w
    spans = repeats.spans_by_name(scratch(spark), suffix_array.BOTH, suffix_array.merge_suffixes, frame.withColumnRenamed("doc_id", "key"))
    short = {bytes(r.name): r for r in spans.collect()}
    flags = brute.covered([(t or "").encode() for t in texts], 200)
    for t, f in zip(texts[:6], flags):
        r = short.get(hashlib.sha256(t.encode()).digest()[:repeats.NAME])
        covered = [False] * len(f)
        for a, b in repeats.merged(suffix_array.BOTH, r.lows, r.highs) if r and r.lows else []:
            covered[a:b] = [True] * (b - a)
        assert covered == list(map(bool, f))


def test_a_crowd_takes_one_bit_a_window():
    """20,000 members of one core with 128 windows each: their runs come out whole, in memory far below 16 bytes a window."""
    import tracemalloc

    rng = np.random.default_rng(3)
    rule, n = suffix_array.BOTH, 20_000
    bytes_of = lambda k: rng.integers(97, 123, k, dtype=np.uint8).tobytes()
    around = rule.cover - 1
    left, right = [bytes_of(around)] * n, [bytes_of(rule.longer - rule.core)] * n
    left[7] = left[7][:100] + b"!" + left[7][101:]  # its windows that begin before this byte stand nowhere else
    low, high = np.zeros(n, np.int64), np.full(n, around)
    tracemalloc.start()
    found = suffix_array.merge_suffixes(rule, np.ones(n, np.uint64), low, high, left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [(i, 0, 26 if i == 7 else around) for i in range(n)]
    assert [sorted(zip(*(x.tolist() for x in f))) for f in found] == [want, want]
    assert peak < 60e6


def test_arrow_batches_are_bounded_by_bytes(spark):
    """The search bounds what reaches a worker at once; 10,000 rows of a few KB were one batch of 40 MB."""
    own = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        frame = spark.range(6000).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 500) AS text").coalesce(1)
        suffix_array.report(frame.limit(1)).collect()

        def sizes(batches):
            import pyarrow as pa
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})
        assert max(r.n for r in frame.mapInArrow(sizes, "n long").collect()) < 1.1 * BATCH_BYTES
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch") if own is None else spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", own)
