"""mvcc_conflicts over all events, writes and reads."""

from collections import Counter

import duckdb

from tessera import queries

D = "/root/testdata/sf0.001"


def test_mvcc_conflicts_checks_all_events(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"event_id": [1, 51, 5000, 5050, 7003], "user_id": [3, 4, 5, 0, 3]}), str(tmp_path / "events.parquet"))
    want = Counter()
    rows = [(1, 3), (51, 4), (5000, 5), (5050, 0), (7003, 3)]
    for e, u in rows:
        for key in (e % 50, u % 50):  # the write, then the read
            want[u, key] += any(f > e for f, _ in rows if f % 50 == key)
    got = Counter(tuple(r) for r in queries.mvcc_conflicts(spark, str(tmp_path)).select("txn", "key").collect())
    assert got == +want and got[5, 0] == 1


def test_mvcc_conflicts_against_a_grouped_maximum(spark):
    sql = f"""WITH e AS (SELECT * FROM '{D}/events.parquet'), m AS (SELECT event_id % 50 AS key, max(event_id) AS last FROM e GROUP BY 1),
    s AS (SELECT user_id AS txn, event_id % 50 AS key, event_id FROM e UNION ALL SELECT user_id, user_id % 50, event_id FROM e) SELECT txn, key FROM s JOIN m USING (key) WHERE event_id < last"""
    assert Counter(tuple(r) for r in queries.mvcc_conflicts(spark, D).select("txn", "key").collect()) == Counter(duckdb.sql(sql).fetchall())
