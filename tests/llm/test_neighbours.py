import numpy as np
import pytest

from tessera.llm import neighbours as N

SCHEMA = "id string, embedding array<float>, vid long"


def brute(rows, k, width):
    """Pairs by the definition: distances of all keys, ties to the smaller id."""
    ok = {}
    for key, v, *_ in rows:
        if key is not None and v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v):
            ok.setdefault(key, v)
    ids = sorted(ok)
    x = np.array([ok[i] for i in ids], np.float32).astype(float).reshape(len(ids), width)
    out = set()
    for i, a in enumerate(ids):
        d = ((x - x[i]) ** 2).sum(1)
        order = [j for j in sorted(range(len(ids)), key=lambda j: (d[j], ids[j])) if j != i][:k]
        out |= {tuple(sorted((a, ids[j]))) for j in order}
    return out


def run(spark, rows, **kw):
    got = [tuple(r) for r in N.knn_pairs(spark.createDataFrame(rows, SCHEMA), **kw).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    return set(got)


def vectors(n, width, seed=0):
    return np.random.default_rng(seed).normal(size=(n, width)).astype(np.float32)


def test_hadamard_is_orthonormal():
    h = N.hadamard(np.eye(16, dtype=np.float32))
    assert np.allclose(h @ h.T, np.eye(16), atol=1e-6)
    x = vectors(20, 32)
    assert np.allclose(np.linalg.norm(N.pseudo_rotate(x, 3), axis=1), np.linalg.norm(x, axis=1), rtol=1e-4)


def test_exact_with_copies_ties_and_dirt(spark):
    x = vectors(40, 8)
    rows = [(f"{i:03x}a", x[i].tolist(), i) for i in range(40)]
    rows += [(f"c{i}", x[0].tolist(), i) for i in range(9)]  # a group larger than k + 1
    rows += [(f"d{i}", x[1].tolist(), i) for i in range(5)]  # with its first, k + 1 of them
    rows += [(f"e{i}", x[2].tolist(), i) for i in range(3)]
    rows += [rows[3], ("null", None, 0), ("short", [1.0], 0), ("nan", [float("nan")] * 8, 0), ("inf", [float("inf")] * 8, 0), (None, x[4].tolist(), 0), ("hole", [None] * 8, 0)]
    rows += [("000a", None, 1), ("zero", [0.0] * 8, 0), ("minus", [-0.0] * 8, 0)]
    assert run(spark, rows, k=5, width=8) == brute(rows, 5, 8)


def test_ties_go_to_smaller_id(spark):
    grid = [(f"g{a}{b}", [float(a), float(b), 0.0, 0.0], 0) for a in range(4) for b in range(4)] + [("g00x", [0.0, 0.0, 0.0, 0.0], 0)]
    assert run(spark, grid, k=3, width=4) == brute(grid, 3, 4)


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_few(spark, n):
    rows = [(f"{i}", v.tolist(), 0) for i, v in enumerate(vectors(n, 4))]
    assert run(spark, rows, k=5, width=4) == brute(rows, 5, 4)


def test_hashed_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 64))
    x = centres[rng.integers(0, 60, 3000)] + 0.6 * rng.normal(size=(3000, 64))
    rows = [(f"{i:05d}", v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))]
    want, plans = brute(rows, 5, 64), []
    got = run(spark, rows, plans=plans)
    assert plans[0].probes < plans[0].buckets  # not all buckets are probed
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95


def test_levels_and_probes_follow_the_number():
    """More vectors, more buckets; what the sample's pairs need is met by every plan."""
    x = vectors(3000, 64)
    d = (x * x).sum(1) - 2 * x[:100] @ x.T
    d[np.arange(100), np.arange(100)] = np.inf
    near = np.argsort(d, axis=1)[:, :5]
    q, found = np.repeat(np.arange(100), 5), []
    for n in (3000, 300_000, 30_000_000):
        h = N.Hasher.fit(x).plan(n, x, x[:100], q, x[near.ravel()], 0.8)
        found.append(h.buckets)
        met = np.zeros(len(q), bool)
        for a, b in zip(h.codes(x[:100]), h.codes(x[near.ravel()])):
            met |= (b[:, :1] == a[q]).any(1) | (a[q, :1] == b).any(1)
        assert met.mean() >= 0.8
    assert found == sorted(found) and found[0] < found[-1]


def test_every_bucket_is_reached_and_codes_are_distinct():
    h = N.Hasher(np.zeros(8, np.float32), np.eye(8, dtype=np.float32), (4, 4), 2, 64)
    for code in h.codes(vectors(30, 8)):
        assert all(len(set(row)) == 64 for row in code.tolist())


def test_decisions_hold_for_every_order_within_the_bounds():
    rng = np.random.default_rng(3)
    for _ in range(300):
        m, need = rng.integers(1, 9), rng.integers(1, 7)
        d, err, size = np.sort(rng.uniform(0, 1, m)), np.full(m, rng.choice([0.0, 0.02, 0.2])), rng.integers(1, 4, m)
        take, left = N.decide(np.zeros(m, int), np.array([need]), d, err, size)
        for _ in range(20):
            true, got, rest = d + rng.uniform(-1, 1, m) * err, np.zeros(m, int), need
            for j in np.argsort(true):
                got[j] = min(size[j], rest)
                rest -= got[j]
            assert all(a == b for a, b in zip(take, got) if a >= 0)
            assert got[take < 0].sum() == min(left[0], size[take < 0].sum()) or not (take < 0).any()


def test_rounding_keeps_its_bound():
    x = np.concatenate([vectors(200, 64), 1e6 * vectors(50, 64), np.zeros((1, 64), np.float32)])
    code, scale = N.rounded(x)
    off = np.linalg.norm(x.astype(float) - code * scale[:, None].astype(float), axis=1)
    assert (off <= N.off_by(scale, 64)).all()


@pytest.fixture
def as_on_large_tables(spark):
    """Many tasks and batches, which small tables have not by themselves."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "20"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_crowded_direction_is_compared_whole(spark, as_on_large_tables):
    x = vectors(600, 64)
    x[:300] = 5 * x[0] + x[:300]
    rows = [(f"{i:05d}", v.tolist(), 0) for i, v in enumerate(x)]
    inside = lambda pairs: {p for p in pairs if p[1] < "00300"}
    want = inside(brute(rows, 5, 64))
    for block in (100, 40):
        got = inside(run(spark, rows, queries=100, block=block))
        assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.9


def test_blocks_of_a_crowded_bucket_meet_once():
    vid, bucket = np.arange(-50, 50), np.repeat([7, 9], 50)
    cells = {}
    for rows, cell, side in N._cells({9: 3}, vid, bucket):
        for r, c, z in zip(rows, cell, side):
            cells.setdefault(int(c), []).append((int(r), int(z)))
    met = []
    for rows in cells.values():
        met += [(a, b) for a, y in rows for b, z in rows if a < b and (y, z) in ((0, 0), (1, 2), (2, 1))]
    assert len(met) == len(set(met)) == 2 * (50 * 49 // 2)


def test_copies_count_once(spark, monkeypatch):
    """Copies neither count as vectors nor crowd a bucket."""
    x = vectors(200, 64)
    rows = [(f"{i:05d}", v.tolist(), 0) for i, v in enumerate(x)] + [(f"c{i:04d}", x[0].tolist(), 0) for i in range(300)]
    seen, full = [], []
    plan, crowded = N.Hasher.plan, N._crowded
    monkeypatch.setattr(N.Hasher, "plan", lambda h, n, *rest: seen.append(n) or plan(h, n, *rest))
    monkeypatch.setattr(N, "_crowded", lambda *a: full.append(crowded(*a)) or full[-1])
    assert run(spark, rows, block=260) == brute(rows, 5, 64)
    assert 190 <= seen[0] <= 210 and full == [{}]


def test_recall_on_chunks(spark):
    from tessera.llm.similar import p2_found

    sf = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{sf}/chunks.parquet").select("id", "embedding")
    rows = [(r["id"], r["embedding"]) for r in df.collect()]
    ok = {}
    for key, v in rows:
        if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v):
            ok.setdefault(key, v)
    ids = sorted(ok)
    x = np.array([ok[i] for i in ids], np.float64)
    sq = (x * x).sum(1)
    want = set()
    for lo in range(0, len(ids), 1000):
        d = np.round(sq[lo : lo + 1000, None] + sq[None] - 2 * x[lo : lo + 1000] @ x.T, 9)
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, :5]
        want |= {tuple(sorted((ids[lo + i], ids[j]))) for i, row in enumerate(near) for j in row}
    got = {tuple(r) for r in p2_found(spark, sf).collect()}
    recall, precision = len(got & want) / len(want), len(got & want) / len(got)
    assert recall >= 0.95 and precision >= 0.95
