"""A licence with a foreign passage in it is found whole."""

import random

import pytest

from tessera.llm import licenses


@pytest.mark.parametrize("name", ["MIT", "Apache-2.0", "GPL-3.0-or-later", "BSD-2-Clause", "ISC"])
@pytest.mark.parametrize("foreign", [5, 22, 60, 500])
def test_a_foreign_passage_does_not_hide_a_licence(spark, name, foreign):
    words = licenses.TEMPLATES[name].split()
    half = len(words) // 2
    text = " ".join(["before"] * 30 + words[:half] + [f"x{k}" for k in range(foreign)] + words[half:] + ["after"] * 30)
    (m,) = licenses.license_matches(spark.createDataFrame([(1, text)], "doc_id long, text string")).where(f"license = '{name}'").collect()
    assert m.coverage == 1.0 and m.start == 30


def test_copies_stay_apart_and_halves_need_order(spark):
    words = licenses.TEMPLATES["MIT"].split()
    whole, gap = " ".join(words), " ".join(f"x{k}" for k in range(60))
    rows = [(1, f"{whole} {gap} {whole}"), (2, f"{' '.join(words[43:])} {gap} {' '.join(words[:43])}")]
    got = [(r.doc_id, r.license, r.coverage) for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [(1, "MIT", 1.0)] * 2


def test_whole_texts_of_licences_are_found(spark):
    rnd = random.Random(2)
    known = licenses.templates()
    whole = [n for n in known if n.endswith("-text")]
    assert {"Apache-2.0-text", "GPL-3.0-text", "MPL-2.0-text", "BSD-3-Clause-text", "LGPL-2.1-text"} <= set(whole)
    rows = []
    for k, name in enumerate(whole):
        words = known[name].split()
        rows.append((k, " ".join(["before"] * 20 + [w for w in words if rnd.random() > 0.03] + ["after"] * 20)))
    got = {(r.doc_id, r.license): r.coverage for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, name in enumerate(whole):
        assert got.get((k, name), 0) > 0.9 or any(d == k and c > 0.9 for (d, n), c in got.items() if n.split("-")[0] == name.split("-")[0]), name


def _common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_coverage_against_the_longest_common_subsequence(spark):
    rnd = random.Random(9)
    words = "permission granted copy software deal restriction rights modify merge publish distribute sublicense sell persons furnished conditions above notice included portions".split()
    template = " ".join(rnd.choice(words) + str(rnd.randint(0, 9)) for _ in range(60))
    rows, want = [], {}
    for k in range(80):
        t = [w for w in template.split() if rnd.random() > k / 300]
        for _ in range(k // 8):
            t.insert(rnd.randrange(len(t) + 1), f"x{rnd.randint(0, 5)}")
        text = [f"y{rnd.randint(0, 9)}" for _ in range(30)] + t + [f"z{rnd.randint(0, 9)}" for _ in range(30)]
        rows.append((k, " ".join(text)))
        want[k] = _common(text, template.split()) / 60
    got = {r.doc_id: r.coverage for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string"), {"T": template}).collect()}
    assert all(got[k] <= want[k] + 1e-9 for k in got) and all(k in got and got[k] >= want[k] - 0.07 for k in want if want[k] >= 0.87)
    assert all(want[k] >= 0.8 for k in got) and len(got) > 30


def test_equal_hashes_of_patterned_words_are_no_match(spark):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    words = [f"w{k}" for k in range(20)]
    rows = [(1, " ".join(words + [b] * 1)), (2, " ".join(words + [a]))]
    got = {r.doc_id: r.aligned for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string"), {"T": " ".join(words + [a])}).collect()}
    assert got == {1: 20, 2: 21}
