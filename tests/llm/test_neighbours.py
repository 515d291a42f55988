from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from palate.llm import neighbours as N


def brute(rows, queries, k):
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    out = {}
    for q, x in queries:
        far = np.sqrt(((v - np.array(x)) ** 2).sum(1))
        order = np.lexsort((ids, far))
        out[q] = [(int(ids[j]), float(far[j])) for j in order if ids[j] != q][:k]
    return out


@pytest.mark.parametrize("shard_rows", [N.SHARD_ROWS, 120])
def test_recall(spark, shard_rows):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    asked = N.usable(table).where("vec_id % 20 = 0")
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 10)
    got: dict = {}
    for r in N.nearest(table, asked, shard_rows=shard_rows).orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    hits = [len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()]
    assert np.mean(hits) >= 0.95 and all(len(got[q]) == len(w) for q, w in want.items())


def test_recall_at_a_size_where_beams_matter():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(6000, 24)) + 3 * rng.normal(size=(10, 24))[rng.integers(0, 10, 6000)]
    graph = N.Graph(v)
    found, _ = graph.search(v[:100].astype(np.float32), N.BEAM)
    true = np.argsort(((v[:100, None] - v[None]) ** 2).sum(2), 1)[:, :10]
    assert np.mean([len(set(f[:10]) & set(t)) / 10 for f, t in zip(found, true, strict=True)]) >= 0.9


def test_copies_ties_and_odd_vectors(spark):
    rows = [(100, [1.0, 0.0], 1), (200, [0.0, 2.0], 1), (5, None, 1), (6, [0.0, 0.0], 1), (7, [float("nan"), 1.0], 1)]
    rows += [(300, [None, 1.0], 1), (8, [1.0, 2.0, 3.0], 1), (400, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1)]
    rows += [(1000 + k, [1.0, 0.0], 1) for k in range(30)] + [(3, [0.0, 1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    queries = N.usable(table).where("vec_id in (100, 200, 8)")
    got: dict = {}
    for r in N.nearest(table, queries).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    plain = [(i, v) for i, v, _ in rows if i in (100, 200, 3) or (i or 0) >= 1000]
    want = brute(plain, [r for r in plain if r[0] in (100, 200)], 10)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(s == pytest.approx(t) for q in want for (_, s), (_, t) in zip(got[q], want[q], strict=True))
    assert N.nearest(table.limit(0), queries.limit(0)).count() == 0


def test_queries_are_answered_batch_by_batch():
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    taken = []

    def stream():
        for shard in (0, 1):
            for a in range(0, 300, 100):
                yield batch(shard, False, [None] * 100, v[a : a + 100], [[shard * 1000 + i] for i in range(a, a + 100)])
            for a in range(0, 40, 10):
                taken.append((shard, a))
                yield batch(shard, True, list(range(a, a + 10)), q[a : a + 10], [None] * 10)

    def batch(shard, asks, ids, vectors, lists):
        n = len(ids)
        columns = [pa.array([shard] * n, pa.int64()), pa.array([8] * n, pa.int32()), pa.array([asks] * n), pa.array(ids, pa.int64())]
        columns += [pa.array(vectors.tolist(), pa.list_(pa.float64())), pa.array(lists, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "dim", "asks", "vec_id", "vector", "ids"])

    seen = 0
    for out in N.answers(stream(), 5, N.BEAM):
        seen += 1
        assert len(taken) == seen  # nothing is read ahead of what is answered
        shard, first = taken[-1]
        want = brute([(shard * 1000 + i, x) for i, x in enumerate(v)], [(None, q[first])], 5)[None]
        assert [(i, s) for i, s in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True)][:5] == [(i, pytest.approx(s)) for i, s in want]
    assert seen == 8


def clustered(n, dim, seed, clusters=400):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(clusters, dim))
    return middles[rng.integers(0, clusters, n)] + 0.2 * rng.normal(size=(n, dim))


def test_recall_over_three_full_shards(spark, tmp_path):
    n = 3 * N.SHARD_ROWS
    v = clustered(n, 32, 3)
    column = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 32).cast(pa.list_(pa.float64()))
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": column}), tmp_path / "e.parquet")
    table = spark.read.parquet(str(tmp_path / "e.parquet"))
    asked = np.arange(0, n, 200)
    found = N.nearest(table, N.usable(table).where("vec_id % 200 = 0")).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for i in asked.tolist():
        d = ((v - v[i]) ** 2).sum(1)
        d[i] = np.inf
        hits.append(len(got[i] & set(np.argsort(d, kind="stable")[:10].tolist())) / 10)
    print("recall", np.mean(hits))
    assert len(found) == 10 * len(asked) and np.mean(hits) >= 0.9


@pytest.mark.parametrize("n", [1, 2, 60, 97, 1500])
def test_every_node_is_reached(n):
    for v in (clustered(n, 8, n, clusters=5), np.column_stack([np.arange(n) // 3, np.zeros(n)]), 10.0 ** (np.arange(n) % 9)[:, None] * np.ones((1, 4))):
        graph = N.Graph(v)
        assert graph.reached().all()
    # also where the passes leave nodes behind: cut them off, then connect them again
    graph.edges[:] = -1
    graph._connect()
    assert graph.reached().all()
    found, _ = graph.search(graph.v[:3], max(n, 2))
    assert all(set(f[f >= 0].tolist()) == set(range(n)) for f in found)


def test_repeated_ids_lose_their_own_row_only(spark):
    rows = [(100, [1.0, 0.0]), (100, [2.0, 0.0]), (100, [1.0, 0.0]), (7, [1.0, 0.5]), (None, [1.0, 1.0]), (9, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = N.nearest(table, N.one_each(N.usable(table).where("vec_id = 100"))).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, round(r.score, 6)) for r in found] == [(100, 100, 0.0), (100, 7, 0.5), (100, 100, 1.0)]
