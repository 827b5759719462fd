import numpy as np
import pytest

from graphloom.operators import retrieval


@pytest.mark.parametrize("text", [True, False])
def test_knn_equals_all_products(spark, frame, text):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, size=(700, 6)).astype(float)
    x[::3] /= 7
    name = (lambda i: f"é{i}") if text else int
    rows = [(name(i), v.tolist()) for i, v in enumerate(x)] + [(name(5), x[5].tolist())] * 9
    rows += [(name(8_000), [float("nan")] * 6), (name(8_001), [float("inf")] * 6), (name(8_002), None)]
    asked = [(name(i), x[i].tolist()) for i in range(0, 700, 20)] + [(name(9_000), [0.0] * 6)]
    schema = f"id {'string' if text else 'long'}, v array<double>"
    got = {(r["query"], r["id"], r["rank"]) for r in retrieval.exact_knn(frame(rows, schema), frame(asked, schema), 7, "id", "v").collect()}
    want = set()
    for a, q in asked:
        near = sorted({(-round(float(np.dot(q, v)), 9), i) for i, v in rows if i != a and v and np.isfinite(v).all()})[:7]
        want |= {(a, i, n + 1) for n, (_, i) in enumerate(near)}
    assert got == want


def test_a_task_holds_few_products():
    """4,096 queries against 10,000 rows take bounded memory, and only the k best are sent."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    q = rng.normal(size=(4096, 32))
    x = rng.normal(size=(10_000, 32))
    batch = pa.RecordBatch.from_arrays([pa.array([f"r{i:05}" for i in range(len(x))]), pa.array(list(x), pa.list_(pa.float64()))], ["id", "v"])
    best = retrieval._Best([f"q{i}" for i in range(len(q))], q, 5)
    tracemalloc.start()
    for low in range(0, len(x), best.rows):
        best.meet(batch.slice(low, best.rows))
    (out,) = best.out()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 5 * len(q) and most < 200e6
    top = np.sort(q[:50] @ x.T, axis=1)[:, -5:]
    assert np.allclose(np.sort(out.column(2).to_numpy()[:250].reshape(50, 5), axis=1), top)


def test_copies_crowd_nothing_out(frame):
    rows = [(1, [9.0])] * 40 + [(i, [float(i % 7)]) for i in range(2, 40)]
    schema = "id long, v array<double>"
    got = retrieval.exact_knn(frame(rows, schema).coalesce(1), frame([(0, [1.0])], schema), 5, "id", "v").collect()
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == [1, 6, 13, 20, 27]


def test_products_beyond_single_precision(frame):
    rows = [(i, [10.0 ** (36 + i)]) for i in range(1, 9)]
    schema = "id long, v array<double>"
    got = retrieval.exact_knn(frame(rows, schema), frame([(0, [1e3])], schema), 3, "id", "v").collect()
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == [8, 7, 6]
