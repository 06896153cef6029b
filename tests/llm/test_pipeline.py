"""The stages of the pipeline, each on what its predecessor kept."""
import collections
import itertools
import tempfile

import corpus_pipeline as pipeline
import __spark_entry__ as entry
from showerframe.llm import near_dedup, quality
from showerframe.llm.common import table

from . import brute
from .conftest import SF


def removed(text, starts):
    """Flags of the bytes that go: stretches of consecutive ``starts`` of repeated 100-byte strings, if long enough."""
    flags, at = [False] * len(text), 0
    for on, group in itertools.groupby(starts):
        n = len(list(group))
        if on and (n + 99 >= 400 or len(text[at:at + n + 99].split()) > 50):
            flags[at:at + n + 99] = [True] * (n + 99)
        at += n
    return flags


def test_stages_take_effect(spark):
    docs, columns = table(spark, SF, "documents"), table(spark, SF, "documents").columns
    folder = tempfile.mkdtemp()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        before, docs = docs, spark.read.parquet(f"{folder}/{k}")
        old, new = ({r.doc_id: r for r in d.collect()} for d in (before, docs))
        if k < 4:
            assert docs.columns == columns and 0 < len(new) <= len(old)
        if k == 0:
            judged = quality.judge(before, quality.train(before, table(spark, SF, "labels")))
            assert set(new) == {r.doc_id for r in judged.filter("kept").collect()}
        elif k == 1:
            rows = [(i, r.text) for i, r in old.items()]
            assert set(new) == {i for (i, _), (_, c) in zip(rows, brute.near(rows, 5, 4, 5)) if i == c}
        elif k == 2:
            # every byte under a repeated string of 100 bytes, in stretches of 400 bytes or over 50 words
            texts = [r.text.encode() for r in old.values()]
            count = collections.Counter(t[i:i + 100] for t in texts for i in range(len(t) - 99))
            assert set(new) == set(old)
            for r, t in zip(old.values(), texts):
                gone = sum(removed(t, [count[t[i:i + 100]] > 1 for i in range(len(t) - 99)]))
                text = new[r.doc_id].text
                assert len(text.encode()) - (len(t) - gone) in range(13) and new[r.doc_id].n_chars == len(text)
        elif k == 3:
            items = [r.text for r in table(spark, SF, "benchmark").collect()]
            assert set(old) - set(new) == {i for i, r in old.items() if any(t in r.text for t in items)}
        else:
            assert {r.doc_id for r in docs.collect()} == set(old)


def test_passages_of_over_fifty_words_go(spark):
    passages = [" ".join(chr(97 + i * i % 23) for i in range(51)), " ".join(f"w{i}" for i in range(60)), " ".join(f"short{i}" for i in range(30))]
    rows = [(k, f"start {k} {p} end {k}", "n") for k, p in enumerate(p for p in passages for _ in range(2))] + [(9, None, "n"), (10, "alone", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    flags = brute.covered([(t or "").encode() for _, t, _ in rows], 100)
    got = {r.doc_id: r.text for r in pipeline.repeated_passages(spark, docs, SF).collect()}
    assert got == {k: t and (t if passages[2] in t else bytes(c for c, x in zip(t.encode(), f) if not x).decode())
                   for (k, t, _), f in zip(rows, flags)}
    assert all(p not in (t or "") for p in passages[:2] for t in got.values()) and len(got[0]) < 20


def test_registered_queries():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and [n for n, _ in pipeline.STAGES] and near_dedup.BANDS
