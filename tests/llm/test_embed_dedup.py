import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import embed_dedup as E

COLUMNS = "vec_id long, embedding array<float>, label int"


def brute(rows):
    ids = np.array([i for i, _ in rows])
    x = [None if v is None or None in v or not np.isfinite(v).all() or not any(v) else np.array(v, np.float32).astype(float) for _, v in rows]
    n, links = len(rows), {k: set() for k in range(len(rows))}
    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.95:
                links[i].add(j)
                links[j].add(i)
    part = list(ids)
    while True:
        new = [min([part[k], *(part[j] for j in links[k])]) for k in range(n)]
        if new == part:
            return [(int(ids[k]), len(links[k]), int(part[k])) for k in range(n)]
        part = new


def rows(seed=0, d=32):
    r = np.random.default_rng(seed)
    out = [(0, None), (1, []), (2, [0.0] * d), (3, [float("nan")] + [1.0] * (d - 1)), (4, [None] + [1.0] * (d - 1)), (5, [float("inf")] * d), (6, [1.0, 2.0]), (7, [2.0, 4.0])]
    for _ in range(8):
        c = r.standard_normal(d)
        for _ in range(12):
            out.append((len(out), (c + r.standard_normal(d) * 0.03).tolist()))
    out += [(len(out) + k, r.standard_normal(d).tolist()) for k in range(40)]
    same = r.standard_normal(d).tolist()
    return out + [(len(out) + k, same) for k in range(60)]


def test_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "TILE", 16)
    monkeypatch.setattr(E, "CELL", 50)
    for seed in range(2):
        data = rows(seed)
        d = spark.createDataFrame([(i, v, 0) for i, v in data], COLUMNS).withColumn("n_links", F.lit("clash"))
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(d).collect())
        assert got == sorted(brute(data))
        assert all(r.kept == (r.vec_id == r.component_id) for r in E.near_duplicates(d).collect())


def test_recall_at_the_threshold():
    r = np.random.default_rng(1)
    n, d = 400, 64
    x = r.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.standard_normal((n, d))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * z
    c = E.code(d, 50_000, 0.95)
    shared = [len(np.intersect1d(a, b)) > 0 for a, b in zip(c.decode(x), c.decode(y), strict=True)]
    assert np.mean(shared) > 0.97


def test_decoder_finds_all_caps():
    c = E.Code(16, 300, 0.95)
    r = np.random.default_rng(2)
    x = r.standard_normal((20, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    half = c.width // 2
    for row, found in zip(x, c.decode(x), strict=True):
        want = []
        for k in range(E.CODES):
            y = c.rotated(row[None], k)[0]
            score = (c.codes[k, 0] @ y[:half])[:, None] + (c.codes[k, 1] @ y[half:])[None, :]
            i, j = np.nonzero(score >= c.alpha)
            want += ((k * c.words + i) * c.words + j).tolist()
        assert found.tolist() == sorted(want)


def test_dimensions_do_not_meet(spark):
    """Very wide vectors beside short ones, links within each dimension."""
    r = np.random.default_rng(7)
    data = []
    for d in (1, 2, 64, 4096, 4097, 5000):
        for _ in range(3):
            c = r.standard_normal(d)
            data += [(len(data) + k, (c * (k + 1) + r.standard_normal(d) * 0.02).tolist()) for k in range(4)]
    d = spark.createDataFrame([(i, v, 0) for i, v in data], COLUMNS)
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in E.near_duplicates(d).collect())
    assert got == sorted(brute(data))
    assert sum(n for _, n, _ in got) > 6 * 3 * 12 - 1


def test_wide_rotation_keeps_lengths_and_angles():
    r = np.random.default_rng(3)
    c = E.Code(700, 100, 0.95)
    x = np.zeros((5, c.width))
    x[:, :700] = r.standard_normal((5, 700))
    for k in (0, E.CODES - 1):
        y = c.rotated(x, k)
        assert np.allclose(y @ y.T, x @ x.T)


def test_sketches_rule_out_no_pair_at_the_threshold():
    r = np.random.default_rng(11)
    for d in (2, 8, 64, 1000):
        x = E._units([v.tobytes() for v in r.standard_normal((3000, d))], d)
        z = r.standard_normal((3000, d))
        z -= (z * x).sum(1, keepdims=True) * x
        y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        a, b = (np.frombuffer(b"".join(E.sketches(v)), np.uint8).reshape(3000, -1) for v in (x, y))
        apart = np.bitwise_count(a ^ b).sum(1)
        assert apart.max() <= E.APART and (d < 8 or abs(apart.mean() - 25.9) < 2)


def test_common_members():
    r = np.random.default_rng(2)
    lists = [np.unique(r.integers(0, 60, r.integers(0, 9))) for _ in range(40)]
    p, q = r.integers(0, 40, 300), r.integers(0, 40, 300)
    assert E._common(lists, p, q).tolist() == [bool(set(lists[i]) & set(lists[j])) for i, j in zip(p, q, strict=True)]


def test_an_id_with_several_vectors(spark):
    a, b = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.0, 0.1]
    near = lambda v: [x + 0.01 for x in v]
    d = spark.createDataFrame([(1, a, 0), (1, b, 0), (2, near(a), 0), (3, near(b), 0), (4, near(near(b)), 0)], COLUMNS)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(d).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]


def test_repeated_ids_and_empty_table(spark):
    v = [1.0, 0.5, 0.25, 0.125]
    d = spark.createDataFrame([(1, v, 0), (1, v, 0), (2, v, 0), (None, v, 0)], COLUMNS)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(d).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 0, None)]
    assert E.near_duplicates(d.limit(0)).count() == 0
