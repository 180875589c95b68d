"""All pairs of a cluster by blocks, with missing, zero and short vectors, against one pair at a time."""

import numpy as np

from quern.plans import vector_queries


def test_blocks_give_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(vector_queries, "BLOCK", 9)
    rng = np.random.default_rng(1)
    rows = [(k * 3, k % 2 if k % 17 else None, rng.normal(size=5).tolist()) for k in range(70)]
    rows[4], rows[6], rows[8], rows[10] = (12, 0, None), (18, 0, [0.0] * 5), (24, 0, [1.0, 2.0]), (30, 0, [1.0, None, 0.0, 0.0, 2.0])
    df = spark.createDataFrame(rows, "id long, cluster int, vector array<float>")
    want = {}
    for i, c, x in rows:
        for j, d, y in rows:
            if i < j and c is not None and c == d:
                bad = x is None or y is None or len(x) != len(y) or None in x + y
                a, b = (np.array(z, "f4").astype(float) if not bad else None for z in (x, y))
                size = 0 if bad else np.linalg.norm(a) * np.linalg.norm(b)
                want[c, i, j] = None if bad else round(float(a @ b) / size, 4) if size else 0.0
    out = vector_queries.pairs(df, 4)
    got = [((r["cluster"], r["i"], r["j"]), r["sim"]) for r in out.collect()]
    assert len(got) == len(want) and dict(got) == want
    # No pair is computed by the engine's own lambdas.
    assert "zip_with" not in out._jdf.queryExecution().optimizedPlan().toString()
