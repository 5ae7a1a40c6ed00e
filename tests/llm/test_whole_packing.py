"""The packing DP sees every sentence end."""

import random

import numpy as np

from tessera.llm import packing


def test_packing_is_optimal_over_all_sentence_ends():
    rnd = random.Random(17)
    pad = lambda m: 0 if m & (m - 1) == 0 else 64 - m
    for _ in range(40):
        n = rnd.randint(100, 400)
        stop = np.array([rnd.random() < 0.2 for _ in range(n)])
        ends = np.unique(np.append(np.array([i for i in range(1, n) if rnd.random() < 0.02], int), n))
        price = {i: packing.SENTENCE for i in range(1, n) if stop[i - 1]} | dict.fromkeys(ends.tolist(), 0)
        if max(np.diff(sorted({0, *price}))) > 64:
            continue
        best = {0: 0}
        for i in sorted(price):
            best[i] = min(best[j] + pad(i - j) + price[i] for j in best if i - j <= 64)
        cut = packing.cuts(stop, ends, 64)
        assert sum(pad(b - a) + price[b] for a, b in zip([0, *cut], cut)) == best[n]
