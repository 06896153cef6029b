"""Vector codes against a plain version and SQL."""
import hashlib
import math

import duckdb
import numpy as np
import pytest

from showerframe.llm import vector_codes
from showerframe.llm.vector_codes import Gnat

from .conftest import SF

by_row = lambda rows: sorted(rows, key=repr)


def plain(rows, parts=8, entries=16, rounds=6):
    """[(vec_id, code, error, label_error)] and digest, with whole numbers of any size."""
    kept = [(k, v, l) for k, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if kept and len(r[1]) == len(kept[0][1])]
    whole = [[math.floor(x * 4096) if abs(x) < 1e200 else int(x) * 4096 for x in v] for _, v, _ in kept]
    w = len(whole[0]) // parts
    cut = [[v[p * w:(p + 1) * w] for v in whole] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def nearest(p, q):
        return min((sum((x - y) ** 2 for x, y in zip(q, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [[] for _ in books[p]]
            for q in cut[p]:
                own[nearest(p, q)[1]].append(q)
            new.append([[sum(c) // len(o) for c in zip(*o)] if o else e for o, e in zip(own, books[p])])
        books = new
    found = [[nearest(p, cut[p][i]) for p in range(parts)] for i in range(len(kept))]
    error = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, l), e in zip(kept, error):
        total[l] = total.get(l, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(k, "".join(f"{n:02x}" for _, n in f), e, total[l]) for (k, _, l), f, e in zip(kept, found, error)], digest


def observed(spark, tmp_path, rows, kind="float"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    return vector_codes.op11_vector_codes(spark, str(tmp_path)).collect()


def test_equals_plain_on_edges(spark, tmp_path):
    rng = np.random.default_rng(3)
    values = [np.float32(x).tolist() for x in rng.normal(0, 0.2, (60, 16))]
    rows = [(i, v, int(rng.integers(3)) if i % 7 else None) for i, v in enumerate(values)]
    rows += [(5, values[5], 1), (70, values[5], 1), (71, None, 1), (72, [None] + values[1][1:], 2), (73, [float("nan")] + values[1][1:], 2),
             (74, [float("inf")] + values[1][1:], 2), (75, values[1][:8], 0), (76, [], 0), (None, values[2], None)]
    rows += [(80 + i, [0.5] * 16, 2) for i in range(40)]  # ties and a crowd of copies
    want, digest = plain(rows)
    got = observed(spark, tmp_path, rows)
    assert by_row(tuple(r)[:4] for r in got) == by_row(want) and {r[4] for r in got} == {digest}


@pytest.mark.parametrize("kind,scale", [("float", 1e18), ("double", 1e150), ("double", 1e300)])
def test_components_of_any_size(spark, tmp_path, kind, scale):
    rng = np.random.default_rng(4)
    cast = (lambda x: float(np.float32(x))) if kind == "float" else float
    rows = [(i, [cast(x * scale if i % 5 else x) for x in rng.normal(0, 1, 8)], 1) for i in range(50)]
    want, digest = plain(rows)
    got = observed(spark, tmp_path, rows, kind)
    assert {r[4] for r in got} == {digest} and {(r[0], r[1]) for r in got} == {w[:2] for w in want}
    assert all(r[2] == (e if e < 2**63 else None) for r in got for k, _, e, _ in want if k == r[0])


def test_few_rows_and_no_rows(spark, tmp_path):
    rows = [(3, [1.0] * 8, None), (1, [0.25] * 8, None)]
    want, digest = plain(rows)
    assert by_row(tuple(r) for r in observed(spark, tmp_path, rows)) == by_row((*w, digest) for w in want)
    empty = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(empty)[0].count() == 0
    assert vector_codes.compress(empty.filter("false"))[0].count() == 0


def test_registered_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(vector_codes.oracle_sql()).fetchall()
    got = [tuple(r) for r in vector_codes.op11_vector_codes(spark, SF).collect()]
    assert by_row(got) == by_row(want) and got


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_gnat_finds_the_nearest_and_skips_subtrees(spread):
    """Small spreads have many ties and copies; answers are exact, and well-separated entries are not all measured."""
    rng = np.random.default_rng(spread)
    for n in (1, 2, 5, 16, 100):
        entries = rng.integers(-spread, spread + 1, (n, 4))
        queries = rng.integers(-spread - 2, spread + 3, (300, 4))
        squares = ((queries[:, None] - entries[None]) ** 2).sum(2)
        for kind in (np.int64, object):
            tree = Gnat(entries.astype(kind))
            number, best = tree.nearest(queries.astype(kind))
            assert (number == squares.argmin(1)).all() and (best == squares.min(1)).all()
    assert spread < 1000 or tree.measured < 0.7 * 300 * n
