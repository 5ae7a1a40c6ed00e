"""wcc over the whole graph, against union-find."""

from collections import Counter

from tessera import queries

D = "/root/testdata/sf0.001"


def test_wcc_covers_the_whole_graph(spark):
    t = lambda n: spark.read.parquet(f"{D}/{n}.parquet").collect()
    edges = [(f"c:{r.c_custkey}", f"n:{r.c_nationkey}") for r in t("customer")] + [(f"s:{r.s_suppkey}", f"n:{r.s_nationkey}") for r in t("supplier")]
    edges += [(f"n:{r.n_nationkey}", f"r:{r.n_regionkey}") for r in t("nation")]
    buyer = {r.o_orderkey: r.o_custkey for r in t("orders")}
    edges += [(f"c:{buyer[r.l_orderkey]}", f"s:{r.l_suppkey}") for r in t("lineitem") if r.l_orderkey in buyer]
    up = {v: v for e in edges for v in e} | {f"r:{r.r_regionkey}": f"r:{r.r_regionkey}" for r in t("region")}

    def root(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        up[high] = low
    own = {f"{p}:{r[0]}" for p, n, k in (("c", "customer", "c_custkey"), ("s", "supplier", "s_suppkey"), ("n", "nation", "n_nationkey"), ("r", "region", "r_regionkey")) for r in spark.read.parquet(f"{D}/{n}.parquet").select(k).collect()}
    size = Counter(root(v) for v in own)
    assert {tuple(r) for r in queries.wcc(spark, D).select("id", "component", "size").collect()} == {(v, root(v), size[root(v)]) for v in own}
    assert any(v.startswith("c:") for v in own)
