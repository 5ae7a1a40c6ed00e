"""A worker asks the model once for each run of letters that it meets, however many words there are."""

import random

import numpy as np
import regex

from tessera.llm import language_id


def test_runs_are_scored_once_and_sums_are_whole(monkeypatch):
    rnd = random.Random(4)
    word = lambda abc: "".join(rnd.choice(abc) for _ in range(rnd.randint(1, 12)))
    model = language_id.Model({x: {word(abc): rnd.randint(1, 9) for _ in range(500)} for x, abc in (("aa", "aeiklmo"), ("bb", "aeghrsß"))})
    texts = [" ".join(rnd.choice([word("aeiklmo"), word("aeghrsß").upper(), f"{word('ae')}-{word('gr')}'{word('so')}3", "ΑΣ. ΣΑΣ", "12", "éa"]) for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    texts += ["", "  ", "7", "a", "ab", "a b\x1cc\nd"]
    want = np.zeros((len(texts), 3))
    for i, t in enumerate(texts):
        words = [w for p in t.split() for w in regex.findall(r"\p{L}+", p.lower())]
        if words:
            want[i] = model.words(words).sum(axis=0)
    asked = []
    values = model.values
    monkeypatch.setattr(model, "values", lambda letters, place: asked.append(len(letters)) or values(letters, place))
    scorer = language_id.Scorer(model)
    assert np.allclose(scorer.texts(texts), want, rtol=1e-9, atol=1e-9)
    before = sum(asked)
    assert np.allclose(scorer.texts(texts[::-1]), want[::-1], rtol=1e-9, atol=1e-9) and sum(asked) == before > 0
    monkeypatch.setattr(language_id, "CELLS", 100)  # runs are forgotten, asked for in steps, and slots collide
    monkeypatch.setattr(language_id, "SLOTS", 3)
    small = language_id.Scorer(model)
    for a in range(0, len(texts), 50):
        assert np.allclose(small.texts(texts[a : a + 50]), want[a : a + 50], rtol=1e-9, atol=1e-9)
