import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import vector_codes as V
from folioscope.llm.queries import op12_vector_codes

COLUMNS = "vec_id long, embedding array<float>, label int"


def plain(rows, rounds=6):
    """Every part against every entry, in Python integers."""
    kept = [(i, [max(-(2**62), min(2**62, math.floor(4096 * float(np.float32(x))))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // 8)
    kept = [(i, v + [0] * (8 * width - len(v)), label) for i, v, label in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(8)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0], kept[k][1]))
    starts = []
    for k in order:
        if kept[k][0] not in [kept[s][0] for s in starts]:
            starts.append(k)
    books = [[cut[k][p] for k in starts[:16]] for p in range(8)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), j) for j, e in enumerate(books[p])) for p in range(8)] for c in cut]

    for _ in range(rounds):
        at = assign()
        for p in range(8):
            for j in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at, strict=True) if a[p][1] == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = assign()
    errors = [min(sum(d for d, _ in a), 2**63 - 1) for a in at]
    labels = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] = min(labels.get(label, 0) + e, 2**63 - 1)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{j:02x}" for _, j in a), e, labels[label], digest) for (i, _, label), a, e in zip(kept, at, errors, strict=True)), key=str)


def check(spark, rows):
    d = spark.createDataFrame(rows, COLUMNS).withColumn("codes", F.lit("clash")).repartition(3)
    assert sorted(map(tuple, V.codes(d).collect()), key=str) == plain(rows)


def test_equals_plain_version(spark):
    r = np.random.default_rng(1)
    centres = r.standard_normal((30, 24))
    rows = [(int(k) * 3, (centres[k % 30] + 0.1 * r.standard_normal(24)).tolist(), int(k % 5) if k % 7 else None) for k in r.permutation(400)]
    check(spark, rows)


def test_ties_and_repeats(spark):
    """Few different values: most distances are equal to another one."""
    r = np.random.default_rng(2)
    rows = [(k, [float(x) / 4096 for x in r.integers(-1, 2, 16)], k % 3) for k in range(300)]
    rows += [(5, rows[7][1], 1)] * 100 + [(None, rows[9][1], None)] * 3
    check(spark, rows)


def test_odd_vectors(spark):
    rows = [(k, [0.1 * k, 0.2, float(k % 3)] + [0.5] * (k % 11), k % 2) for k in range(40)]
    rows += [(90, None, 1), (91, [0.1, None], 1), (92, [float("nan")] * 8, 1), (93, [float("inf")] * 8, 1), (94, [], 1), (95, [3e38, -3e38] * 4, 2), (96, [1e9, -1e9] * 4, 3)]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1)], [(1, [0.5] * 8, None)], [(2, [0.5] * 8, None), (1, [0.25] * 8, 1)]])
def test_small_tables(spark, rows):
    check(spark, rows)


def test_bounds_hold_and_rule_out_most(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    _, books, taken = V.encode(d)
    n = d.count()
    assert taken[0] == n * 8 * 16 and sum(taken[1:]) < 0.7 * 6 * taken[0]


def test_bounds_are_never_on_the_wrong_side():
    r = np.random.default_rng(3)
    x = r.integers(-4000, 4000, (500, 8, 4))
    books = V.Books(x[:16].transpose(1, 0, 2).copy())
    codes, upper, lower, _ = books.first(x)
    for _ in range(5):
        moved = books.entries + r.integers(-300, 300, books.entries.shape)
        books = V.Books(moved, books.entries)
        codes, upper, lower, _ = books.shifted(x, codes, upper, lower)
        d = ((x[:, :, None] - books.entries[None]) ** 2).sum(axis=3)
        assert (d.argmin(axis=2) == codes).all()
        root = np.sqrt(d.astype(np.float64))
        assert (np.take_along_axis(root, codes[..., None].astype(int), 2)[..., 0] <= upper).all() and (lower <= root).all()


def test_query_and_sql_over_the_table(spark):
    path = "/root/testdata/sf0.001"
    rows = sorted(map(tuple, op12_vector_codes(spark, path).collect()), key=str)
    table = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    assert rows == plain([tuple(r) for r in table])
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
        assert sorted(c.sql(V.sql()).fetchall(), key=str) == rows
