"""The pipeline's near-copy stage goes through SimHash: wide fingerprints, blocks of their bits, shingles in full."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import minhash, simhash
from tessera.llm.common import mix


def test_wide_fingerprints_are_majorities():
    draw = np.random.default_rng(3)
    size = [0, 1, 2, 300, 0, 255, 256, 511, 0]
    at = np.concatenate(([0], np.cumsum(size)))
    h = draw.integers(0, 2**63, at[-1], dtype=np.uint64)
    got = simhash.wide_prints(h, at)
    for i, n in enumerate(size):
        for w in range(simhash.WIDE):
            x = mix(h[at[i] : at[i + 1]] ^ simhash._SEEDS[w])
            assert int(got[i, w]) == sum(1 << b for b in range(64) if 2 * int((x >> np.uint64(b) & np.uint64(1)).sum()) > n)


def test_blocks_alone_find_near_copies(spark, monkeypatch):
    """The bands are taken away: SimHash's blocks find the links themselves, those in a large group too."""
    rnd = random.Random(9)
    words, rows, want = [f"w{k}" for k in range(5000)], [], {}
    for g in range(40):
        base = [rnd.choice(words) for _ in range(300)]
        for k in range(60 if g == 0 else 4):
            new = list(base)
            for i in rnd.sample(range(300), k % 4):
                new[i] = f"e{rnd.randrange(10**6)}"
            rows.append((100 * g + k, " ".join(new)))
            want[rows[-1][0]] = 100 * g
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "candidates", lambda nodes, most: candidates(nodes.where("false"), most))
    candidates = simhash.candidates
    assert {r.doc_id: r.component_id for r in simhash.near_documents(docs).collect()} == want
    nodes = minhash.prints(docs, wide=simhash.wide_prints).groupBy("key").agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp"))
    pairs, large = simhash.block_pairs(nodes, 16)
    assert all(want[r.u] == want[r.v] for r in pairs.collect()) and large.count() > 60


def test_blocks_are_of_the_masked_bits_and_planned_small(spark, monkeypatch):
    """Two nodes share a block exactly if they agree in the bits of its mask. As expressions, the words of 64 masks filled
    the driver's memory when Spark planned them."""
    draw = np.random.default_rng(4)
    fp = draw.integers(0, 2**63, (200, simhash.WIDE), dtype=np.uint64)
    fp[100:] = fp[:100] ^ (np.uint64(1) << draw.integers(0, 64, (100, simhash.WIDE), dtype=np.uint64))
    nodes = spark.createDataFrame([(k, k, row) for k, row in enumerate(fp.view(np.int64).tolist())], "key long, node long, fp array<long>")
    asked, candidates = [], simhash.candidates
    monkeypatch.setattr(simhash, "candidates", lambda given, most: asked.append(given) or candidates(given, most))
    pairs, _ = simhash.block_pairs(nodes, 16)
    assert asked[0]._jdf.queryExecution().optimizedPlan().toJSON().count("BitwiseAnd") <= simhash.WIDE
    bands = {r.key: r.bands for r in asked[0].collect()}
    rnd = np.random.RandomState(simhash.SEED)
    shared = set()
    for t in range(simhash.DRAWN):
        bits = rnd.permutation(64 * simhash.WIDE)[:16]
        own = [tuple(int(x[b // 64]) >> int(b % 64) & 1 for b in bits) for x in fp]
        for u in range(200):
            for v in range(u + 1, 200):
                assert (own[u] == own[v]) == (bands[u][t] == bands[v][t])
                if own[u] == own[v]:
                    shared.add((u, v))
    far = lambda u, v: sum((int(x) ^ int(y)).bit_count() for x, y in zip(fp[u], fp[v], strict=True))
    assert {(r.u, r.v) for r in pairs.collect()} == {x for x in shared if far(*x) <= simhash.RADIUS} != set()
    assert simhash.block_pairs(nodes.where("false"), 16)[0].count() == 0
