"""Language, quality, decontamination, packing, scoring, pages and urls against plain versions or held-out rows."""
import collections
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from showerframe.llm import decontaminate, html_text, language_id, lm_score, packing, quality, url_filter
from showerframe.llm.common import fold
from showerframe.llm.vocabularies import vocabulary_path

from . import brute
from .conftest import EDGE, SF

by_row = lambda rows: sorted(rows, key=repr)


def test_language_of_held_out_rows(documents):
    held = fold("doc_id", 5) == 0
    model = language_id.train(documents.filter(~held))
    got = language_id.predict(documents.filter(held), model).join(documents, "doc_id").select("lang_pred", "lang", "score").collect()
    assert len(got) > 20 and sum(r[0] == r[1] for r in got) >= 0.97 * len(got) and all(0 < r[2] <= 1 for r in got)


def test_language_edges(edge, empty):
    model = language_id.train(edge)
    got = language_id.predict(edge, model).collect()
    assert len(got) == len(EDGE)
    unknown = {r.doc_id for r in got if r.lang_pred == "und"}
    assert unknown == {1, 2, 3, 14} and all(r.score == 0 for r in got if r.lang_pred == "und")
    nothing = language_id.train(empty)
    assert {r.lang_pred for r in language_id.predict(edge, nothing).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_base_counts_equal_plain(edge, documents):
    weights = quality.fit([], np.zeros(0), np.zeros(0, bool))
    for frame, rows in ((edge, [(k, t) for k, t, _ in EDGE]), (documents, [tuple(r) for r in documents.select("doc_id", "text").collect()])):
        want = [(k, *brute.base_counts(t)) for k, t in rows]
        out = quality.judge(frame, weights).collect()
        assert by_row(tuple(r)[:6] for r in out) == by_row(want)
        for r in out:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)


def test_quality_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = fold("doc_id", 5) == 0
    weights = quality.train(docs, labels.filter(~held))
    got = quality.judge(docs, weights).join(labels.filter(held), "doc_id").filter("not base_failed").collect()
    assert sum((r.probability >= 0.5) == (r.quality == 1) for r in got) >= 0.95 * len(got)


def test_quality_edges(edge, empty, spark):
    labels = spark.createDataFrame([(1, 1), (6, None), (None, 0), (7, 1), (12, 0)], "doc_id long, quality int")
    weights = quality.train(edge, labels)
    assert quality.keep_good(edge, weights).columns == edge.columns
    assert quality.judge(empty, weights).count() == 0 and quality.keep_good(empty, weights).count() == 0
    assert quality.judge(edge, quality.train(empty, labels)).count() == len(EDGE)
    text = EDGE[7][1]
    several = quality.judge(edge.unionByName(edge.filter("doc_id = 7")), weights).filter("doc_id = 7").select("probability").distinct()
    assert text and several.count() == 1  # the verdict on a text does not depend on its neighbours


ITEMS = [(1, "A train leaves Berlin at 9 hours and covers 120 km before it meets Anna, who walks from Berlin to Bonn at dawn."),
         (2, "short item of seven plain small words"), (3, None), (4, "too short"), (5, "")]


def test_decontamination(spark, empty):
    docs = [(1, "Before. " + ITEMS[0][1] + " after"), (2, "The same: " + ITEMS[0][1].replace("120", "95").replace("Anna", "Maria")),
            (3, "New cities: " + ITEMS[0][1].replace("Berlin", "Madrid")),
            (4, "Mixed up: " + ITEMS[0][1].replace("from Berlin", "from Paris")),  # other windows stay literal
            (5, "It is a short ITEM of seven plain small words, indeed."), (6, "clean text about nothing at all in particular here"),
            (7, None), (8, ""), (9, "too short"), (None, ITEMS[0][1])]
    frame = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, key string, n_items int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(frame, items).collect()}
    assert {k for k, r in got.items() if r.contaminated} == {1, 2, 3, 4, 5, None}
    assert got[1].first_item == 1 and got[5].first_item == 2 and all(r.kept != r.contaminated for r in got.values())
    kept = decontaminate.remove_contaminated(frame, items)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {6, 7, 8, 9}
    assert decontaminate.contaminated(frame, items.filter("false")).filter("contaminated").count() == 0
    assert decontaminate.contaminated(empty, items).count() == 0


def test_one_edited_value_hides_no_other_window(spark):
    docs = [(1, ITEMS[0][1].replace("from Berlin", "from Paris")), (2, ITEMS[0][1].replace("from Berlin", "from Paris").replace("120", "95")),
            (3, "A train leaves Rome at 8 hours and covers 8 km before it meets Rome, who walks from Rome to Rome at dawn.")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(frame, items).collect()}
    assert {k for k, r in got.items() if r.contaminated} == {1, 2} and got[1].n_windows >= 6
    assert {r.doc_id for r in decontaminate.remove_contaminated(frame, items).collect()} == {3}


def test_surroundings_and_case_hide_nothing(spark):
    items = [(1, "What is the largest lake between the two mountain towns"), (2, "Tom has 3 apples. Tom buys 5 more from his neighbour and eats 2."),
             (3, "Every winter the old Baker Émile sells 12 loaves to Rosa before 9 and gives the rest of them to Paul."),
             (4, "A farmer counts 7 sheep and 9 goats near the river")]
    docs = [(1, "see What is the largest lake between the two mountain towns"), (2, "Ann has 4 apples. Ann buys 6 more from his neighbour and eats 1."),
            (3, items[2][1].lower()), (4, items[2][1].upper().replace(".", "").replace(",", "")),
            (5, items[2][1].replace(" ", "\n")), (6, items[2][1].lower().replace("12", "15")), (7, "1. " + items[3][1].replace("7", "8")),
            (8, "Ann has 4 apples. Bob buys 4 more from his neighbour and eats 1."),
            (9, "Where is the largest lake between the two mountain towns")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.first_item for r in decontaminate.contaminated(frame, bench).collect() if r.contaminated}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 3, 7: 4}
    assert {r.doc_id for r in decontaminate.remove_contaminated(frame, bench).collect()} == {8, 9}


def test_literal_windows_of_numbers_and_names(spark):
    items = [(1, "12 + 35 = 47, 8 + 9 = 17, 60 - 4 = 56, 7 x 7 = 49, 81 / 9 = 9"), (2, "Ann, Bob, Carla, Dieter, Emil, Fritz and Gustav"),
             (3, "5 kg 3 g 2 mg")]
    docs = [(k, f"see: {t} (end)") for k, t in items] + [(4, items[0][1].replace("7", "6")), (5, "Ina, Jan, Carla, Kurt, Lea, Max and Nora"),
                                                         (6, "6 kg 4 g 3 mg")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.first_item for r in decontaminate.contaminated(frame, bench).collect() if r.contaminated}
    assert got == {1: 1, 2: 2, 3: 3}
    assert {r.doc_id for r in decontaminate.remove_contaminated(frame, bench).collect()} == {4, 5, 6}


@pytest.mark.parametrize("block", [10, 10**6])
def test_items_without_or_with_shared_ids(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate.benchmark_blocks, "__kwdefaults__", {"key": "item_id", "text": "text", "block": block})
    items = [(None, "The first of all items has no id but words enough to be found by them"), (7, ITEMS[0][1]),
             (7, "Short one with the id of 2 others"), (7, "Another text under the same id counts 3 pears, 4 plums and 5 quinces in a bowl of Dora")]
    docs = [(k, "Well, " + t.replace("3", "8").replace("120", "95")) for k, (_, t) in enumerate(items)] + [(9, "clean text about nothing at all in here"), (None, None)]
    frame = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, row string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.n_items, r.first_item) for r in decontaminate.contaminated(frame, bench).collect()}
    assert got == {0: (True, 1, None), 1: (True, 1, 7), 2: (True, 1, 7), 3: (True, 1, 7), 9: (False, 0, None), None: (False, 0, None)}
    kept = decontaminate.remove_contaminated(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {9, None}


def test_benchmark_in_blocks_gives_the_same(spark, documents, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    once = by_row(tuple(r) for r in decontaminate.contaminated(documents, items).collect())
    texts = [r[0] for r in items.select("text").collect()]
    planted = {r.doc_id for r in documents.collect() if r.text and any(t in r.text for t in texts)}
    assert {r[0] for r in once if r[1]} == planted and planted
    monkeypatch.setattr(decontaminate.benchmark_blocks, "__kwdefaults__", {"key": "item_id", "text": "text", "block": 300})
    assert by_row(tuple(r) for r in decontaminate.contaminated(documents, items).collect()) == once


def test_packing_is_whole_and_tight(edge, documents, empty):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(vocabulary_path())
    for frame, rows in ((documents, [tuple(r) for r in documents.select("doc_id", "text").collect()]), (edge, [(k, t) for k, t, _ in EDGE])):
        got, pieces, total = packing.pack(frame).collect(), [], 0
        for k, t in rows:
            ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
            total += len(ids)
            cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
            pieces += [(k, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert by_row(tuple(r)[:5] for r in got) == by_row(pieces)
        places = collections.defaultdict(list)
        for r in got:
            places[r.sequence_id].append((r.offset, r.length))
        for own in places.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(places) <= 1.02 * total / 2048 + 2
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_patterns_use_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    available = {int(n): int(c) for n, c in zip(rng.integers(1, 2049, 60), rng.integers(1, 1000, 60))}
    found = packing.patterns(available)
    used = collections.Counter()
    for pattern, times in found:
        assert sum(pattern) <= 2048 and times > 0
        for p in pattern:
            used[p] += times
    assert used == collections.Counter(available)
    big = packing.patterns({n: c * 10**6 for n, c in available.items()})
    assert len(big) < 20 * len(found) + 2000  # the plan does not grow with the number of pieces


def test_base_scores_equal_plain(edge, documents, empty):
    for frame, rows in ((edge, [(k, t) for k, t, _ in EDGE]), (documents, [tuple(r) for r in documents.select("doc_id", "text").collect()])):
        learn = fold("doc_id", 7) != 2
        held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2 if k is not None else False
        tokens = [[*brute.words((t or "").translate(brute.LOWER)), "\n"] for _, t in rows]
        count = collections.Counter(w for (k, _), own in zip(rows, tokens) if not held(k) for w in own)
        n, v = sum(count.values()), len(count)
        want = by_row((k, len(own), sum(count[w] > 0 for w in own), n) for (k, _), own in zip(rows, tokens))
        model = lm_score.train(frame.filter(learn), rows=50)
        got = lm_score.score(frame, model, learn).collect()
        assert by_row((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
        base = sorted(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own) for own in tokens)
        assert np.allclose(sorted(r.base_score for r in got), base)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_score.score(empty, model, learn).count() == 0


def test_model_is_a_distribution_and_windows_agree(documents):
    texts = [r.text for r in documents.limit(40).collect()]
    import pyarrow as pa
    from showerframe.llm.common import slices
    block = lm_score.Block(next(slices(pa.array(texts), 10**9)), vocabulary_path())
    ids, first = block.ids, block.first
    model = lm_score.train_model(ids, first)
    frequency = lm_score.frequencies(model["label"], np.bincount(ids, minlength=lm_score.VOCABULARY))

    def log10_probability(m, share):
        return lm_score.log10_classes(m, ids, first) + np.add.reduceat(share[ids], first[:-1]) / np.log(10)

    for c in range(lm_score.CLASSES):
        own = model["label"] == c
        assert not own.any() or abs(np.exp(frequency[own]).sum() - 1) < 1e-6
    whole = log10_probability(model, frequency)
    # token by token, each with the context its window has
    k = 3
    own = ids[first[k]:first[k + 1]]
    total = 0.0
    for p in range(len(own)):
        start = p // lm_score.STEP * lm_score.STEP
        inputs, there, _, _ = lm_score.gathered(own, np.array([0, len(own)]), np.array([start]), np.array([0]))
        o = lm_score.forward(model, model["row"][inputs], there)[0][0, p - start].astype(float)
        total += o[model["label"][own[p]]] - np.log(np.exp(o - o.max()).sum()) - o.max() + frequency[own[p]]
    assert abs(whole[k] - total / np.log(10)) < 1e-3 * abs(whole[k])
    uniform = lm_score.train_model(np.zeros(0, np.int64), np.zeros(1, np.int64))
    even = lm_score.frequencies(uniform["label"], np.zeros(lm_score.VOCABULARY))
    assert whole.sum() > log10_probability(uniform, even).sum()  # it has learnt something


def test_main_text_of_all_pages(spark):
    """The pages' articles are known from their markup; the network has to find them block by block."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages, html_text.train(pages)).collect()}
    for r in pages.collect():
        want = "\n".join(b.text for b in html_text.blocks_of(r.html) if html_text.meaning(b))
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_blocks_and_edges_of_pages(spark):
    page = ("<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=/>x</a></ul></nav>"
            "<article><h1>A &amp; B</h1><p>one\n  two <b>bold</b>&nbsp;x<br>y<p>next<!-- no --></article><footer>f</footer>")
    assert [(b.text, b.path[-1]) for b in html_text.blocks_of(page)] == [
        ("T", "title"), ("x", "li"), ("A & B", "h1"), ("one two bold x y", "p"), ("next", "p"), ("f", "footer")]
    rows = [(1, "u", page, "t"), (1, "u", page, "t"), (2, None, None, "t"), (None, "u", "", "t"), (3, "u", "<<p>>" + "<div>" * 3000 + "z", "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    model = html_text.fresh_model()
    out = html_text.extract(frame, model).collect()
    assert len(out) == 5 and {r.text for r in out if r.page_id in (2, None)} == {""}
    assert html_text.extract(frame.filter("false"), model).count() == 0
    assert set(html_text.train(frame.filter("false"))) == set(model)


def test_urls_equal_sql(spark):
    urls = ["http://a.com/", "https://WWW.Example.com/en/x?y", "https://example.com/en/", "https://example.com/en", "x://notexample.com/en/",
            "http://net/es/1", "http://a.b.net/fr/", "http://net/e", None, "", "no scheme", "http://", "http://com", "a://com//b",
            "http://com?/x", "http://com#/x", "http://user@com/", "http://com:80/", "http://x.com./", "p://q.com/a://b.net/es/",
            "http://example.com/en/" + "a/" * 3000, "http://" + "a." * 500 + "com/", "http://éÀ.COM/É", "http://.com/", "a\nb://c.com/d\ne?f"]
    rows = [(i, u, "h", "p", 0) for i, u in enumerate(urls)] + [(None, urls[0], "h", "p", 0), (0, urls[0], "h", "p", 0)]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule int")
    got = by_row(tuple(r) for r in url_filter.judge(frame, url_filter.rule_table(spark, url_filter.RULES)).collect())
    con = duckdb.connect()
    pages = frame.select("page_id", "url").toArrow()
    con.register("pages", pages)
    assert got == by_row(con.sql(url_filter.SQL).fetchall())
    none = url_filter.judge(frame, url_filter.rule_table(spark, []))
    assert none.filter("rule is not null or verdict != 'allow'").count() == 0 and none.count() == len(rows)
    assert url_filter.judge(frame.filter("false"), url_filter.rule_table(spark, url_filter.RULES)).count() == 0


def test_rule_precedence(spark):
    rules = spark.createDataFrame([("b.com", "/x", "allow"), ("com", "/xy/", "block"), ("b.com", "/x/y", "block"), (None, "/", "block"),
                                   ("a.b.com", "", "allow")], "host string, path string, verdict string")
    frame = spark.createDataFrame([(1, "h://b.com/xy"), (2, "h://b.com/xy/z"), (3, "h://b.com/x/yz"), (4, "h://a.b.com"), (5, "h://c.com/xy/")],
                                  "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(frame, rules, default="review").collect()}
    # of two rules of the same length the one with the longer host wins
    assert got == {1: ("b.com/x", "allow"), 2: ("b.com/x", "allow"), 3: ("b.com/x/y", "block"), 4: ("a.b.com", "allow"),
                   5: ("com/xy/", "block")}


@pytest.mark.parametrize("page,texts", [
    ("<article><p data-x=it's>hello world</p><p>two it's three</p><p>four</p></article>", ["hello world", "two it's three", "four"]),
    ("<p title='a > b' class=x>one</p><p title=\"c > 'd'\">two</p>", ["one", "two"]),
    ("<p>one</p><!-- gone --!><p>two</p><!--><p>three</p><!---><p>four</p>", ["one", "two", "three", "four"]),
    ("<p>one</p><svg class='i' title='a>b'/><p>two</p><svg><text>gone</text></svg><p>three</p>", ["one", "two", "three"]),
    ("<p class=\"open>one</p><p>two</p>", ["one", "two"]), ("<p a = 'x>y' b c=d/>one<p '>two", ["one", "two"]),
    ("<script>if (a < b) '</p>'</script><p>5 < 6 &amp; 7</p>", ["5 < 6 & 7"]), (None, []), ("", []), ("<p " + "a= " * 3000, [])])
def test_quotes_and_comments_lose_no_text(page, texts):
    assert [b.text for b in html_text.blocks_of(page)] == texts


def test_a_page_of_many_blocks_is_labelled_alone(spark):
    """A page of 20,000 blocks among short ones: batches are cut by padded cells, so no array holds more than one long page."""
    long = "<article>" + "".join(f"<p>w{i} and some words</p>" for i in range(20_000)) + "</article>"
    pages = [html_text.blocks_of(p) for p in [long] + ["<article><p>short text of a page</p></article>"] * 70]
    model = html_text.train(spark.createDataFrame([(1, "<article><p>one two</p></article><nav>x</nav>")] * 3, "page_id long, html string"))
    seen = []
    plain, html_text._batch = html_text._batch, lambda x, sizes: seen.append(len(sizes) * max(sizes)) or plain(x, sizes)
    try:
        assert len(html_text.probabilities(model, html_text.features(pages))) == 20_070
    finally:
        html_text._batch = plain
    assert max(seen) == 20_000


def test_model_learns_from_every_text(spark):
    """rows, classes and weights follow all texts, not those the weights start from, however they are dealt out."""
    words = [f"{a}{b}" for a in ("plum", "zebra", "quartz", "violin", "harbor", "meadow") for b in ("", "s", "ed", "ly", "ness", "wise")]
    texts = [(k, " ".join([words[k % 36], words[(k * 5 + 1) % 36]] * 40)) for k in range(72)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    ids, first = [], [0]
    for _, t in texts:
        own = lm_score.word_ids(vocabulary_path(), t.split(" "))[0]
        ids += [*own, lm_score.END]
        first.append(len(ids))
    ids, first = np.array(ids), np.array(first)
    model = lm_score.train(frame.repartition(4), rows=1)
    assert (model["row"][np.unique(ids)] < len(np.unique(ids))).all()
    again = lm_score.learnt(lm_score.scan(frame.repartition(1), fold("doc_id", 7) >= 0, limit=3000), rows=1)
    for name in ("row", "label"):
        assert (model[name] == again[name]).all()
    few = lm_score.train_model(ids[:first[1]], first[:2])
    own = [lm_score.log10_classes(m, ids, first).sum() + lm_score.frequencies(m["label"], np.bincount(
        ids, minlength=lm_score.VOCABULARY))[ids].sum() / np.log(10) for m in (model, again, few)]
    assert own[0] > own[2] and own[1] > own[2]


def test_blocks_and_sums_work_in_stretches(monkeypatch):
    """A block's words are hashed, and those of a part summed, a stretch at a time: the same results in far less memory."""
    import tracemalloc

    import pyarrow as pa
    from showerframe.llm.common import slices

    rng = np.random.default_rng(5)
    texts = [" ".join(f"W{n}é" for n in rng.integers(0, 3000, int(rng.integers(0, 900)))) for _ in range(300)] + [None, "", " one\x0b "]
    piece = next(slices(pa.array(texts), 10**9))
    whole = lm_score.Block(piece, vocabulary_path())
    with monkeypatch.context() as few:
        few.setattr(lm_score, "SLICE_BYTES", 20_000)
        few.setattr(lm_score, "ENCODED", 100)
        cut = lm_score.Block(piece, vocabulary_path())
    for name in ("names", "number", "first_word", "flat", "first_id", "ids", "first"):
        assert np.array_equal(getattr(whole, name), getattr(cut, name)), name

    names = np.unique(rng.integers(0, 2**64, 400_000, dtype=np.uint64))
    codes = [np.sort(rng.choice(names, 100_000, replace=False)) for _ in range(15)]
    counts = [rng.integers(0, 400 if k % 2 else 200, 100_000) for k in range(15)]
    group = pa.table({"part": [3] * 15, "block": list(range(15)), "codes": pa.array([c.tobytes() for c in codes], pa.binary()),
                      "counts": pa.array([lm_score._packed(n) for n in counts], pa.binary())})
    tracemalloc.start()
    out = lm_score._summed(group).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    at = [np.searchsorted(names, c) for c in codes]
    total = sum(np.bincount(a, n, len(names)) for a, n in zip(at, counts))
    assert [(r["part"], r["block"]) for r in out] == [(3, k) for k in (*range(15), -1)]
    for r, a in zip(out, at):
        assert np.array_equal(lm_score._unpacked(r["totals"]), total[a])
    assert lm_score._unpacked(out[-1]["totals"]).tolist() == [(total > 0).sum()]
    assert peak < 50e6
