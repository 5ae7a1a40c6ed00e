"""The text operators against brute force, exact round trips and held-out accuracy, on small and awkward rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import bpe, exact_dedup, fingerprints, language_id, lattice, licenses, packing, simhash, substring_dedup, warc
from tessera.llm.components import components

SPLIT = re.compile("[^\x20\x09-\x0d]+").findall
RND = random.Random(11)
WORDS = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(1, 7))) for _ in range(300)]
PASSAGE = " ".join(RND.choice(WORDS) for _ in range(80))


def _text(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


def awkward():
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows and odd characters."""
    base = [_text(RND.randint(1, 200)) for _ in range(40)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[i % 7]) for i in range(30)] + [(200 + i, base[i].replace(" ", "\n ", 3)) for i in range(5)]
    out += [(300 + i, _text(20) + " " + PASSAGE + "\t" + _text(20)) for i in range(12)]
    out += [(400, None), (401, ""), (402, "  \n"), (403, "É日本 🙂 <|endoftext|> ΑΣ ́"), (404, _text(9000)), (405, "word"), (406, "a b c"), (407, "a b c")]
    out += [(300, out[-12][1]), (None, PASSAGE), (None, None)]
    near = base[3].split()
    near[len(near) // 2 : len(near) // 2 + 1] = ["changed"]
    return out + [(500, " ".join(near))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, RND.choice(["en", "de", None]), 1, 2) for i, t in awkward()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, h int, pos int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_substring_dedup(docs, empty):
    rows = docs.collect()
    first = {}
    for r in rows:
        w = SPLIT(r.text or "")
        for q in range(len(w) - 49):
            if r.doc_id is not None:
                key = tuple(w[q : q + 50])
                first[key] = min(first.get(key, r.doc_id), r.doc_id)
    want = []
    for r in rows:
        w = SPLIT(r.text or "")
        gone = [False] * len(w)
        for q in range(len(w) - 49):
            if r.doc_id is not None and first[tuple(w[q : q + 50])] < r.doc_id:
                gone[q : q + 50] = [True] * 50
        want.append((r.doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    got = substring_dedup.repeated_spans(docs, carry=("lang",), texts_too=True).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=key) == sorted(want, key=key)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert substring_dedup.repeated_spans(empty).count() == 0


def test_exact_dedup(docs, empty):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for r in docs.collect():
        groups[norm(r.text)].append(r.doc_id)
    low = lambda v: None if None in v else min(v)
    want = Counter((i, low(v), len(v), i == low(v), hashlib.sha256(t.encode()).hexdigest()) for t, v in groups.items() for i in v)
    got = exact_dedup.exact_groups(docs)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == want
    assert exact_dedup.exact_groups(empty).count() == 0


def _fingerprint(text):
    w = SPLIT("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("most", [1, 64])
def test_simhash(docs, empty, most):
    got = simhash.near_components(docs, most=most).collect()
    rows = docs.collect()
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == Counter((r.doc_id, _fingerprint(r.text)) for r in rows)
    node = {}
    for r in rows:
        if r.doc_id is not None:
            f = _fingerprint(r.text)
            node[f] = min(node.get(f, r.doc_id), r.doc_id)
    up = {f: f for f in node}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for a in node:
        for b in node:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((root(a), root(b)), key=lambda f: node[f])
                up[y] = x
    low = {}
    for f in node:
        low[root(f)] = min(low.get(root(f), node[f]), node[f])
    assert all(r.component_id == (None if r.doc_id is None else low[root(r.fp % 2**64)]) for r in got)
    assert simhash.near_components(empty).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    assert {(r.node, r.component) for r in components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_fingerprints(docs, empty, spark):
    a, b = _text(400), _text(400)
    joined = f"{a} {b}"
    s, t, u = fingerprints.sketches([a.encode(), b.encode(), joined.encode()])
    shingles = lambda x: {tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)}
    exact = len(shingles(a) & shingles(joined)) / len(shingles(a) | shingles(joined))
    assert abs(fingerprints.resemblance(s, u) - exact) < 0.15 and fingerprints.containment(s, u) > 0.85
    assert abs(fingerprints.distinct_shingles(u) / len(shingles(joined)) - 1) < 0.25
    assert len(set(fingerprints.merge(s, t)) & set(u)) > 100
    assert fingerprints.resemblance(*fingerprints.sketches([b"", b" "])) == 1.0
    found = fingerprints.document_sketches(docs)
    total = fingerprints.merged_sketches(found.selectExpr("1 AS g", "fingerprint"), ["g"]).first().fingerprint
    everything = fingerprints.bottom(np.concatenate(fingerprints.sketches([(r.text or "").encode() for r in docs.collect()])))
    assert fingerprints.decode(total).tolist() == everything.tolist()
    ids = sorted((r.doc_id for r in docs.where("doc_id IS NOT NULL").collect()), reverse=True)
    one = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg({"text": "max"}).toDF("doc_id", "text")
    text = {r.doc_id: r.text or "" for r in one.collect()}
    order = sorted(set(ids), reverse=True)
    want = {i: text[order[(k + 1) % len(order)]] for k, i in enumerate(order)}
    assert {r.doc_id: r.next_text for r in fingerprints.with_next(one).collect()} == want
    assert fingerprints.with_next(docs).count() == docs.count() and fingerprints.with_next(empty).count() == 0


def test_bpe_matches_the_library(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary_path())
    _, encoder, labels = bpe.automaton(bpe.vocabulary_path())
    alphabet = "abcdeinostrABΣ é'ñ́ \x1c\x85\t\n.,!!12³²İßǅ日🙂<|endoftext|>x  "
    texts = ["".join(RND.choice(alphabet) for _ in range(RND.randint(0, 50))) for _ in range(1500)] + ["a<|endoftext|>b", "a" * 99, "it's I'M don't", "x" * 2000]
    for t, ids in zip(texts, encoder.ids(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert " ".join(labels[i] for i in want) == lib.decode(want, skip_special_tokens=False)
    got = Counter((r.doc_id, tuple(r.ids)) for r in bpe.tokens(docs).collect())
    assert got == Counter((r.doc_id, tuple(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert bpe.tokens(empty).count() == 0


def test_packing(docs, empty):
    _, encoder, _ = bpe.automaton(bpe.vocabulary_path())
    got = packing.packed(docs).collect()
    want = Counter((r.doc_id, tuple(np.frombuffer(encoder.ids([r.text or ""])[0], "<u4").tolist()) + (1,)) for r in docs.collect())
    sequences, made, part = defaultdict(list), Counter(), []
    for r in got:
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))] and sum(r.length for r in s) <= 2048
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):  # documents stay in order
        assert r.start == len(part)
        part += r.ids
        if len(part) == r.doc_tokens:
            made[r.doc_id, tuple(part)] += 1
            part = []
    assert made == want and packing.packed(empty).count() == 0


def test_packing_is_optimal_on_small_cases():
    for _ in range(40):
        n = RND.randint(1, 40)
        stop = np.array([RND.random() < 0.2 for _ in range(n)])
        ends = np.unique(np.append(np.array([i for i in range(1, n) if RND.random() < 0.15], int), n))
        price = {i: packing.SENTENCE for i in range(1, n) if stop[i - 1]} | dict.fromkeys(ends.tolist(), 0)
        kept = set(ends.tolist()) | set((np.flatnonzero(stop) + 1).tolist())
        best = {0: 0}
        pad = lambda m: 0 if m & (m - 1) == 0 else 16 - m
        for i in sorted(kept):
            prior = [best[j] + pad(i - j) + price[i] for j in best if i - j <= 16]
            if prior:
                best[i] = min(prior)
        if n in best and max(np.diff(sorted({0, *kept}))) <= 16:
            cut = packing.cuts(stop, ends, 16)
            cost = sum(pad(b - a) + price[b] for a, b in zip([0, *cut], cut))
            assert cost == best[n]


def test_lattice(docs, empty):
    lat, logp = lattice.vocabulary()
    table = {}
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(lattice.VOCABULARY))
    for i in range(sp.get_piece_size()):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
            table[sp.id_to_piece(i).replace("▁", " ").encode()] = len(table)

    def brute(word, lp):
        w = b" " + word
        f = [1.0] + [0.0] * len(w)
        for e in range(1, len(w) + 1):
            f[e] = sum(f[s] * math.exp(lp[table[w[s:e]]]) for s in range(e) if w[s:e] in table) + f[e - 1] * math.exp(lp[lat.n + w[e - 1]])
        return math.log(f[-1])

    words = [b"the", b"international", b"x", "été".encode(), b"zzqqz"]
    stop = 0.3
    want = [brute(w, logp + math.log(1 - stop)) + math.log(stop / (1 - stop)) for w in words]
    assert np.allclose(lat.forward(words, logp, stop), want)
    piece, step = table[b"al"], logp.copy()
    step[piece] += 1e-5
    assert abs(lat.expected(words, logp)[piece] - sum(brute(w, step) - brute(w, logp) for w in words) / 1e-5) < 1e-3
    low = lambda t: SPLIT("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["\n"]
    rows = docs.collect()
    res = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 7
    count = Counter(w for r in rows if res(r.doc_id) not in (None, 2) for w in low(r.text))
    n, v = sum(count.values()), len(count)
    want = Counter((r.doc_id, res(r.doc_id) == 2, len(low(r.text)), sum(count[w] > 0 for w in low(r.text)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in low(r.text)), 6)) for r in rows)
    got = lattice.scored(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and lattice.scored(empty).count() == 0
    # The score of each document, from plain sums over segmentations.
    seen = [w.encode() for w in count if w != "\n"]
    lp = logp
    for _ in range(lattice.ROUNDS):
        uses = lat.expected(seen, lp)
        lp = lattice.estimate(uses)
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    d, stop = min(0.95, max(0.1, once / (once + 2 * twice))), len(seen) / (len(seen) + uses.sum())
    known = {}

    def word(w):
        if w not in known:
            spelled = 0.0 if w == "\n" else math.exp(brute(w.encode(), lp + math.log(1 - stop))) * stop / (1 - stop)
            known[w] = math.log10(max(count[w] - d, 0) / n + (d * v / n * spelled if w != "\n" else 0.0))
        return known[w]

    short = [r for r in rows if len(r.text or "") < 2000]
    want = Counter((r.doc_id, round(sum(map(word, low(r.text))), 3)) for r in short)
    assert Counter((r.doc_id, round(r.score, 3)) for r in got if r.n_tokens < 700) >= want and len(short) > 80


def test_language_id(spark, docs, empty):
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ei"], "cc": ["que", "oix", "é"]}
    rows = [(i, " ".join("".join(RND.choice(sounds[x]) for _ in range(RND.randint(1, 4))) for _ in range(40)), x) for i in range(300) for x in [RND.choice(list(sounds))]]
    rows += [(900, None, "aa"), (901, "12 34 !!", "aa"), (902, "", None)]
    got = {r.doc_id: r for r in language_id.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all(got[i].held_out and got[i].lang_pred == x and not got[i].rejected for i, _, x in held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.languages(docs).count() == docs.count() and language_id.languages(empty).count() == 0
    model = language_id.Model({"aa": {"kalo": 3, "mi": 1}, "bb": {"schei": 2, "ung": 1}})
    # Probabilities of the next letter sum to one over known letters and the share of unknown ones.
    known = sorted(set("kalomischeiung"))
    total = sum(2 ** (model.words(["ka" + c])[0, 0] - model.words(["ka"])[0, 0] + _stop(model, "ka") - _stop(model, "ka" + c)) for c in known) + 2 ** _stop(model, "ka")
    assert total <= 1 + 1e-6 and total > 0.6


def _stop(model, word):
    """log2 of the first language's probability that a word ends here."""
    letters, place, w = language_id._layout([word])
    value = np.full(len(letters), np.log2(language_id.UNKNOWN))
    for k, tables in enumerate(model.orders, 1):
        end, h, context, _, _ = language_id._grams(letters, place, k)
        for e, a, c in zip(end, h, context):
            known = [{(key, owner): x for j, key in enumerate(t[0].tolist()) for owner, x in zip(t[2][t[1][j] : t[1][j + 1]].tolist(), t[3][t[1][j] : t[1][j + 1]].tolist())} for t in tables]
            if (int(a), 0) in known[0]:
                value[e] = known[0][int(a), 0]
            else:
                value[e] += known[1].get((int(c), 0), 0.0)
    return value[-1]


def test_warc(spark):
    rows = [(5, "http://x/ä b", "<p>é</p>"), (2, "http://y", "<p>é</p>"), (9, None, None), (7, "u", ""), (3, "u\r\nv", "other"), (2, "http://y", "<p>é</p>"), (None, "n", "other")] + [(100 + i, "u", "x" * i * 1000) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.bundles(pages).cache()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        again = i is not None and i > first[h or ""]
        want[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None] += 1
    got = warc.read(archive)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == want
    one = got.where("page_id = 3").first()
    fetched = warc.fetch(archive, spark.createDataFrame([(one.record_id,)], "record_id string")).collect()
    assert [bytes(r.payload) for r in fetched] == [b"other"]
    data = bytes(archive.first().data)
    import zstandard

    assert b"".join(warc.unpack(data, f) for f in warc.seek_table(data)) == zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert warc.read(warc.bundles(pages.where("false"))).count() == 0


def test_licenses(spark, docs, empty):
    assert licenses.align(list("abcxdef"), list("abcydef")) == [(0, 0), (1, 1), (2, 2), (4, 4), (5, 5), (6, 6)]
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "FREE of any charge").replace("publish,", "")
    rows = [(1, f"{_text(50)} {mit} {_text(50)}"), (2, f"{_text(500)}\n{changed}\n"), (3, "Licensed under the Apache License, Version 2.0. " * 3), (4, "the license of this copy"), (5, None), (6, "")]
    got = {}
    for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.license, round(r.coverage, 2)))
    assert got[1] == [("MIT", 1.0)] and [x for x, _ in got[2]] == ["MIT"] and 0.9 < got[2][0][1] < 1
    assert {x for x, _ in got[3]} == {"Apache-2.0-notice"} and len(got[3]) == 3 and set(got) == {1, 2, 3}
    assert licenses.license_matches(docs).count() == 0 and licenses.license_matches(empty).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or "")) for i, t in dict(x for x in awkward() if x[0] is not None).items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert 400 not in kept["language"] and 0 in kept["language"]
    assert all(i not in kept["exact"] for i in range(100, 130)) and 0 in kept["exact"]
    assert PASSAGE in kept["passages"][300].replace("\t", " ") and PASSAGE not in kept["passages"][301]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(kept["passages"])
