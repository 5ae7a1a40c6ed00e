"""semcache_lookup searches all embeddings but the query's own."""

import numpy as np

from tessera import queries

D = "/root/testdata/sf0.001"


def test_semcache_lookup_searches_all_rows(spark):
    rows = spark.read.parquet(f"{D}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    e = np.array([r.embedding for r in rows], float)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    s = e @ e.T
    np.fill_diagonal(s, -2)
    want = {int(ids[i]): int(ids[s[i].argmax()]) for i in range(len(ids)) if ids[i] % 20 == 0 and s[i].max() >= 0.3}
    got = {r.query_id: r.entry_id for r in queries.semcache_lookup(spark, D).collect()}
    assert got == want and any(v % 2 == 0 for v in got.values())
