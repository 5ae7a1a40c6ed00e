"""Queries as registered, hot keys, patterned words, repeated and missing ids, and the pipeline, against brute force."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, exact_dedup, fingerprints, language_id, minhash, queries, simhash, substring_dedup, warc
from tessera.llm.components import components

RND = random.Random(23)
WORDS = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in "lmnrst"]
SPLIT = re.compile("[^\x20\x09-\x0d]+").findall


def _text(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


def _patterned():
    """Two words of 1,024 letters that polynomial hashes modulo 2**64 can't tell apart."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.fixture(params=[1, 500])
def hot(request, monkeypatch):
    monkeypatch.setattr(common, "HOT", request.param)
    return request.param


@pytest.fixture(scope="module")
def rows():
    """Most documents share one passage; many are one text; some ids repeat or are null."""
    passage = _text(70)
    out = [(i, f"{_text(15)} {passage} {_text(15)}") for i in range(60)] + [(100 + i, "all the same\ntext") for i in range(50)]
    out += [(200 + i, _text(RND.randint(0, 90))) for i in range(40)] + [(3, out[3][1]), (3, _text(60)), (None, passage), (None, None), (None, "all the  same text"), (400, None), (401, "")]
    return out + [(300 + i, _text(120)) for i in range(5)]


@pytest.fixture
def folder(spark, rows, tmp_path):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, h int, part int").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_op1_query(spark, rows, folder, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "OFTEN", min(hot, 8))
    assert bool(len(substring_dedup._hot(spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string"), 50))) == (hot == 1)
    first = {}
    for i, t in rows:
        w = SPLIT(t or "")
        for q in range(len(w) - 49):
            if i is not None:
                first[tuple(w[q : q + 50])] = min(i, first.get(tuple(w[q : q + 50]), i))
    want = Counter()
    for i, t in rows:
        w = SPLIT(t or "")
        gone = [False] * len(w)
        for q in range(len(w) - 49):
            if i is not None and first[tuple(w[q : q + 50])] < i:
                gone[q : q + 50] = [True] * 50
        want[i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()] += 1
    got = queries.QUERIES["op1_substring_dedup"](spark, folder)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want


def test_op1_tells_patterned_words_apart(spark):
    a, b = _patterned()
    side = _text(60).split()
    docs = spark.createDataFrame([(1, " ".join([*side, a, *side])), (2, " ".join([*side, b, *side]))], "doc_id long, text string")
    (got,) = substring_dedup.repeated_spans(docs).where("doc_id = 2").collect()
    assert got.kept_text == b and got.n_removed == 120


@pytest.mark.parametrize(("most", "size"), [(1, 32), (10**9, 32), (1, 1), (10**9, 1)])
def test_op6_compares_whole_texts_at_every_stage(spark, rows, most, size, hot):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    low = lambda v: None if None in v else min(v)
    want = Counter((i, low(v), len(v), i == low(v), hashlib.sha256(t.encode()).hexdigest()) for t, v in groups.items() for i in v)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for carry in ((), ("text",)):
        got = exact_dedup.exact_groups(docs, 3, carry, most, size).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert Counter((r.doc_id, r.carry_0) for r in got) == Counter(rows)


def test_op5_query(spark, rows, folder):
    from tessera.llm.fingerprints import encode, resemblance, sketches

    h = dict(spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect())
    texts = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), h[x[1]], x[1]))
    want = Counter()
    for k, (i, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        n = len(t) // 3
        new = t[: len(t) - n] + after[:n]
        s, e, f = sketches([t.encode(), new.encode(), after.encode()])
        want[i, len(t), hashlib.sha256(new.encode()).hexdigest(), encode(s), encode(e), round(resemblance(s, e), 9), round(resemblance(s, f), 9)] += 1
    got = queries.QUERIES["op5_fingerprints"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def test_op5_rows_without_ids_and_patterned_words(spark):
    docs = spark.createDataFrame([(None, _text(20)) for _ in range(40)] + [(None, "x")] * 30, "doc_id long, text string").repartition(3)
    got = fingerprints.with_next(docs).collect()
    assert Counter(r.text for r in got) == Counter(r.text for r in docs.collect()) == Counter(r.next_text for r in got)
    assert fingerprints.with_next(docs.where("false")).count() == 0
    a, b = (np.concatenate(fingerprints.sketches([f"{w} x y z".encode()])).tolist() for w in _patterned())
    assert a != b


@pytest.mark.parametrize("names", [["h"], ["x"], ["rank", "key0"]])
def test_sketches_merge_under_any_key(spark, names):
    rows = [("a", _text(300)), ("a", _text(300)), (None, _text(9)), ("b", None)]
    docs = fingerprints.document_sketches(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"))
    keyed = docs.join(spark.createDataFrame([(i, k) for i, (k, _) in enumerate(rows)], "doc_id long, g string"), "doc_id").select(*(F.col("g").alias(n) for n in names), "fingerprint")
    got = {r[0]: r.fingerprint for r in fingerprints.merged_sketches(keyed, names).collect()}
    for key in ("a", None, "b"):
        everything = np.concatenate(fingerprints.sketches([(t or "").encode() for k, t in rows if k == key]))
        assert got[key] == fingerprints.encode(fingerprints.bottom(everything))
    assert fingerprints.merged_sketches(keyed.where("false"), names).count() == 0


def test_op7_query(spark, rows, folder, hot):
    got = queries.QUERIES["op7_simhash"](spark, folder).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got if r.doc_id is not None and r.doc_id != 3}
    assert len(got) == len(rows) and all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got)
    label = {r.doc_id: r.component_id for r in got}
    assert all(label[a] == label[b] for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2)
    assert label[101] == 100 and label[None] is None and prints[401] == 0 and label[401] == label[400]


def test_a_hub_and_missing_ends(spark, hot):
    edges = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(500, 501), (None, 3), (4, None)], "u long, v long")
    assert {(r.node, r.component) for r in components(edges).collect()} == {(i, 0) for i in range(200)} | {(500, 500), (501, 500)}
    assert components(edges.where("false")).count() == 0


def test_every_language_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = [(f"l{k:03d}", [RND.choice(letters) + RND.choice(letters) for _ in range(6)]) for k in range(600)]
    rows = [(3 * k, " ".join("".join(RND.choices(s, k=3)) for _ in range(40)), name) for k, (name, s) in enumerate(made)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(labelled)
    assert len(model.names) > 400  # a fifth of the rows calibrates, and here a language has one row
    entries = sum(len(t[2]) for tables in model.orders for t in tables)
    assert entries < 600 * 40 * 7 * 10
    found = model.words(["".join(made[7][1])])
    assert found.shape == (1, len(model.names) + 1)


def test_archives_name_each_record_once(spark, tmp_path, hot):
    rows = [(1, "http://a", "same"), (1, "http://a", "same"), (2, "http://b", "same"), (2, "http://c", "same"), (None, "n", "same"), (None, "n", "same"), (7, "u", "x" * 3_000_000), (8, "u", "é" * 200_000)]
    rows += [(10 + i, "u", f"page {i} " * 2000) for i in range(700)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, sha int, at int").repartition(2)
    archive = warc.bundles(pages.drop("sha", "at")).cache()
    got = warc.read(archive).collect()
    assert len({r.record_id for r in got}) == len(got) == len(rows) and archive.count() >= 2
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 4)
    assert kinds == {(1, "response", None): 2, (2, "revisit", 1): 2, (None, "response", None): 2}
    assert {r.page_id: bytes(r.payload) for r in got if r.page_id in (7, 8)} == {7: b"x" * 3_000_000, 8: ("é" * 200_000).encode()}
    some = spark.createDataFrame([(r.record_id,) for r in got[::50]], "record_id string")
    assert {r.record_id: r.payload for r in warc.fetch(archive, some).collect()} == {r.record_id: r.payload for r in got[::50]}
    files = warc.export(archive, f"file://{tmp_path}/warc").collect()
    import zstandard

    whole = b""
    for f in files:
        data = (tmp_path / "warc" / f.bundle).read_bytes()
        assert len(data) == f.bytes
        whole += zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert sorted(r["record_id"] for r in warc.parse(whole)) == sorted(r.record_id for r in got)
    assert all(base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest for r in got if r.payload is not None)
    clash = warc.read(warc.bundles(pages.limit(20)))
    assert clash.count() == 20


def test_large_groups_of_near_copies_keep_their_links(spark):
    """Members of groups beyond MOST: what is linked only over other members is found too."""
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(400):
        new = list(base)
        for i in RND.sample(range(200), RND.randint(1, 4)):
            new[i] = f"e{RND.randint(0, 10**6)}"
        rows.append((k, " ".join(new)))
    sets = {i: {tuple(w[j : j + 5]) for w in [t.split()] for j in range(len(w) - 4)} for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = {r.doc_id: r.component_id for r in minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == root(i) for i in sets)


def test_pipeline_with_nulls_repeats_and_nothing(spark, rows, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = Counter((r.doc_id, r.text) for r in docs.collect())
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), "doc_id long, text string, lang string, source string, n_chars long")
        got = Counter((r.doc_id, r.text) for r in docs.collect())
        if name == "language":
            assert got == Counter({k: n for k, n in want.items() if k[1] and any(c.isalpha() for c in k[1])})
        if name == "exact":
            groups = defaultdict(list)
            for (i, t), n in want.items():
                groups[re.sub("[\x20\x09-\x0d]+", " ", t)] += [(i, t)] * n
            assert set(got) == {x for g in groups.values() for x in g if x[0] == (None if None in [i for i, _ in g] else min(i for i, _ in g))}
        if name == "near":
            assert all(got[k] <= want[k] for k in got) and all(got[k] == want[k] for k in want if k[0] is None)
            near = simhash.near_documents(spark.createDataFrame(list(want.elements()), "doc_id long, text string")).where("component_id < doc_id")
            gone = {r.doc_id for r in near.collect()}
            assert got == Counter({k: n for k, n in want.items() if k[0] not in gone})
        if name == "passages":
            assert sum(got.values()) == sum(want.values()) and all(got[k] == want[k] for k in want if k[0] is None)
        want = got
    home = str(tmp_path / "run")
    out = corpus_pipeline.run(spark, folder, home)
    assert Counter(r.doc_id for r in out.select("doc_id").distinct().collect()) == Counter({i for i, _ in want})
    before = Counter((r.doc_id, r.length, r.ids_crc32) for r in out.collect())
    again = corpus_pipeline.run(spark, folder, home)  # goes on after the last whole stage, which is the last
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in again.collect()) == before
    nothing = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for stage in stages.values():
        assert stage(spark, nothing, folder).count() == 0
