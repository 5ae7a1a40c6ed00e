"""LM scoring by the marginal likelihood of a subword lattice.

A text is its words (lower case A-Z) and one end. A word is spelled by the pieces of an existing vocabulary: its lattice has
an arc for every piece at every place, and every single byte, so each text has a probability. Piece probabilities start
from the vocabulary's own scores and are re-estimated ``ROUNDS`` times over all distinct training words (expected counts of
all segmentations, each word once, as each gives the same mass to be spelled); forward recursion in log space sums over
segmentations. One more arc spans a whole word with its absolutely discounted share of the training tokens; the discounted
mass is what the spelled arcs share, so a word's probability is the sum over all its paths, whether it was seen in training
or not. The discount is estimated from how many words occur once and twice.

Counts cover every training text. The commonest words (at most ``HEAD``) travel to every task; the other words of a
document are joined with the corpus counts, a row for each document and word, and summed for each document.

Defined results: null texts count as empty (one token, the end). A null id is neither held out nor learned from. Rows that
repeat an id are scored each by itself. With nothing to learn from, counts are zero and the vocabulary's order decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import column, mix, residue, scan, texts, written

VOCABULARY, HEAD, DISCOUNT, SMOOTH, ROUNDS = "piece_bpe_32k.model", 50_000, 0.75, 0.01, 2
#: Distinct words that a task holds before it passes their counts on.
HOLD = 200_000


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.array([1] + [b] * (n - 1), np.uint64), dtype=np.uint64) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_POWERS = Powers(0x9E3779B97F4A7C15)
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)


class Lattice:
    """Pieces as byte strings; ids from 0, then one for each of the 256 bytes."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        self.size = self.n + 256
        by: dict[int, list[tuple[int, int]]] = {}
        for i, p in enumerate(pieces):
            if p:
                by.setdefault(len(p), []).append((self._hash(p), i))
        self.tables = {}
        self.seen = np.zeros(1 << 20, bool)
        for k, rows in sorted(by.items()):
            rows.sort()
            h = np.array([r[0] for r in rows], np.uint64)
            self.tables[k] = h, np.array([r[1] for r in rows], np.int64)
            self.seen[(h >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _totals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = _POWERS.upto(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[:-1], out=total[1:])
        return total, down

    def _hash(self, piece: bytes) -> int:
        return int(self._totals(np.frombuffer(piece, np.uint8))[0][-1])

    def arcs(self, words: list[bytes]):
        """first node of each word, its number of bytes, and arcs (start node, end node, piece, order group)."""
        marked = [b" " + w for w in words]
        size = np.array([len(w) for w in marked], np.int64)
        data = np.frombuffer(b"".join(marked), np.uint8)
        begin = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(data)) - begin[word]
        room = size[word] - place
        total, down = self._totals(data)
        starts, pieces, lengths = [np.arange(len(data))], [self.n + data.astype(np.int64)], [np.ones(len(data), np.int64)]
        kinds = [np.zeros(len(data), np.int64)]
        for k, (hashes, ids) in self.tables.items():
            if k > len(data):
                break
            h = (total[k:] - total[:-k]) * down[: len(data) - k + 1]
            at = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)] & (room[: len(h)] >= k))
            where = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
            hit = hashes[where] == h[at]
            at, found = at[hit], ids[where[hit]]
            starts.append(at)
            pieces.append(found)
            lengths.append(np.full(len(at), k))
            kinds.append(np.full(len(at), k))
        s, p, k, kind = (np.concatenate(x) for x in (starts, pieces, lengths, kinds))
        node = s + word[s]  # each word has a node more than bytes
        return begin + np.arange(len(words)), size, node, node + k, p, place[s], place[s] + k, kind

    def _sweep(self, value: np.ndarray, to: np.ndarray, come: np.ndarray, weight: np.ndarray, order: np.ndarray, kind: np.ndarray, down: bool) -> None:
        """Adds each arc's weight in log space, in the order of places; arcs of one place and kind lead to different nodes."""
        key = order * 256 + np.minimum(kind, 255)
        by = np.argsort(-key if down else key, kind="stable")
        edges = np.flatnonzero(np.diff(key[by], prepend=-1, append=-1))
        to, come, weight = to[by], come[by], weight[by]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            t = to[a:b]
            value[t] = np.logaddexp(value[t], value[come[a:b]] + weight[a:b])

    def forward(self, words: list[bytes], logp: np.ndarray, stop: float) -> np.ndarray:
        """Natural log of each word's probability over all segmentations; stop: the chance that a word ends after a piece."""
        if not words:
            return np.zeros(0)
        first, size, start, end, piece, _, upto, kind = self.arcs(words)
        alpha = np.full(int(first[-1] + size[-1] + 1), -np.inf)
        alpha[first] = 0
        self._sweep(alpha, end, start, logp[piece] + np.log1p(-stop), upto, kind, False)
        return alpha[first + size] + np.log(stop) - np.log1p(-stop)

    def expected(self, words: list[bytes], logp: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words, each taken once."""
        first, size, start, end, piece, place, upto, kind = self.arcs(words)
        n = int(first[-1] + size[-1] + 1)
        alpha, beta = np.full(n, -np.inf), np.full(n, -np.inf)
        alpha[first], beta[first + size] = 0, 0
        w = logp[piece]
        self._sweep(alpha, end, start, w, upto, kind, False)
        self._sweep(beta, start, end, w, place, kind, True)
        owner = np.searchsorted(first, start, side="right") - 1
        share = np.exp(alpha[start] + w + beta[end] - alpha[(first + size)[owner]])
        return np.bincount(piece, share, self.size)


@lru_cache(2)
def vocabulary(name: str = VOCABULARY) -> tuple[Lattice, np.ndarray]:
    """The lattice of a vocabulary and its pieces' log probabilities by their scores. The scores are ranks (0 and down by
    one), so weights fall with the rank as words' do in a language; a byte by itself has a tenth of the average weight."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    pieces = [sp.id_to_piece(i).replace("▁", " ").encode() for i in plain]
    score = np.array([sp.get_score(i) for i in plain])
    rank = np.argsort(np.argsort(-score, kind="stable"), kind="stable")
    weight = np.concatenate((1.0 / (rank + 10.0), np.full(256, 1.0 / (10 * len(plain)))))
    return Lattice(pieces), np.log(weight / weight.sum())


def _runs(words: list, most: int = 20_000, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    a = held = 0
    for b, w in enumerate(words):
        held += len(w)
        if b - a >= most or held > size:
            yield a, b + 1
            a, held = b + 1, 0
    if a < len(words):
        yield a, len(words)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the rows of docs with learn true; the empty word stands for the ends of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return b

        for batch in batches:
            for a, b, data, bounds in texts(column(batch, "text")):
                held[b""] += b - a
                held.update(data.tobytes().lower().split() if b - a == 1 else b" ".join(data[bounds[i] : bounds[i + 1]].tobytes() for i in range(b - a)).lower().split())
                if len(held) > HOLD:
                    yield out()
        if held:
            yield out()

    return docs.where("learn").select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def piece_counts(counts: DataFrame, logp: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Expected uses of each piece over all words of counts, the number of tokens, the number of distinct tokens."""
    sent = counts.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, logp = vocabulary()[0], sent.value
        uses = np.zeros(lattice.size)
        tokens = kinds = 0
        for batch in batches:
            words, c = column(batch, "word").to_pylist(), column(batch, "c").to_numpy()
            tokens, kinds = tokens + int(c.sum()), kinds + len(words)
            for a, b in _runs(words):
                pick = [w for w in words[a:b] if w]
                if pick:
                    uses += lattice.expected(pick, logp)
        ids = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids, [-1, -2]))), pa.array(np.concatenate((uses[ids], [tokens, kinds])))], ["piece", "uses"])

    total = {r["piece"]: r["uses"] for r in counts.mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()}
    uses = np.zeros(vocabulary()[0].size)
    for k, v in total.items():
        if k >= 0:
            uses[k] = v
    return uses, int(total.get(-1, 0)), int(total.get(-2, 0))


def commonest(counts: DataFrame) -> DataFrame:
    """Words by how common they are, down to a count that no more than HEAD words reach. A few counts of counts go to the
    driver, whatever the corpus."""
    words = counts.where(F.length("word") > 0).withColumn("step", F.floor(F.log2("c") * 32).cast("int"))
    total, least = 0, None
    for r in sorted(words.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"]):
        total += r["n"]
        if total > HEAD:
            break
        least = r["step"]
    return words.where(F.lit(False) if least is None else F.col("step") >= least).select("word", "c")


def estimate(uses: np.ndarray) -> np.ndarray:
    """Log probabilities of pieces used so often; unused ones keep a small share in the vocabulary's order."""
    start = np.exp(vocabulary()[1])
    weight = uses + SMOOTH * start * len(start)
    return np.log(weight / weight.sum())


class Model:
    """What each task needs: piece probabilities, totals, the commonest words with their counts."""

    def __init__(self, uses: np.ndarray, tokens: int, kinds: int, ends: int, head: list[tuple[bytes, int]], discount: float = DISCOUNT):
        self.logp = estimate(uses)
        words = kinds - (ends > 0)
        self.stop = words / (words + uses.sum()) if uses.sum() else 0.25
        self.tokens, self.kinds, self.ends = tokens, kinds, ends
        self.discount = discount
        self.spelled = np.log(discount * kinds / tokens) if tokens else np.log(0.5)
        self.words = [w for w, _ in head]
        c = np.array([n for _, n in head], np.float64)
        self.base, self.score = self.base_of(c), self.score_of(self.words, c)

    def base_of(self, c):
        return np.log10((c + 1) / (self.tokens + self.kinds + 1))

    def score_of(self, words: list[bytes], c: np.ndarray) -> np.ndarray:
        """log10 of the words' probabilities."""
        spelled = np.concatenate([vocabulary()[0].forward(words[a:b], self.logp, self.stop) for a, b in _runs(words)] or [np.zeros(0)]) + self.spelled
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(c - self.discount, 0) / max(self.tokens, 1))
        return np.logaddexp(whole, spelled) / np.log(10)

    def end(self) -> tuple[float, float]:
        return float(self.base_of(self.ends)), float(np.log10((self.ends - self.discount) / self.tokens)) if self.ends else float(np.log10(0.5))


def scored(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    part = residue(F.col("doc_id"), modulus)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(part == held, F.lit(False)).alias("held_out"), F.coalesce(part != held, F.lit(False)).alias("learn"))
    counts = written(word_counts(rows))
    logp = vocabulary()[1]
    for _ in range(ROUNDS):
        uses, tokens, kinds = piece_counts(counts, logp)
        logp = estimate(uses)
    ends = sum(r["c"] for r in counts.where(F.length("word") == 0).collect())
    few = counts.agg(F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    discount = min(0.95, max(0.1, few["once"] / (few["once"] + 2 * few["twice"]))) if few["once"] else DISCOUNT
    head = [(bytes(r["word"]), r["c"]) for r in commonest(counts).collect()]
    sent = spark.sparkContext.broadcast(Model(uses, tokens, kinds, ends, head, discount))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over each document's common words and its end, and a row for each of its other words."""
        model = sent.value

        class Places(dict):
            def __missing__(self, _):
                return len(model.words)

        place = Places((w, k) for k, w in enumerate(model.words))
        base, score, rest = np.append(model.base, 0), np.append(model.score, 0), len(model.words)
        end = model.end()
        for batch in batches:
            keys = column(batch, "key").to_numpy()
            for a, b, data, bounds in texts(column(batch, "text")):
                own, tails, tail_keys, tail_n = [], [], [], []
                for i in range(b - a):
                    words = data[bounds[i] : bounds[i + 1]].tobytes().lower().split()
                    at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                    other = np.flatnonzero(at == rest)
                    own.append((len(words) + 1, len(words) - len(other) + (model.ends > 0), base[at].sum() + end[0], score[at].sum() + end[1]))
                    if len(other):
                        tail = Counter([words[k] for k in other.tolist()])
                        tails += tail
                        tail_n += tail.values()
                        tail_keys.append(np.full(len(tail), keys[a + i]))
                n, m = b - a, len(tails)
                ids, marks = column(batch, "doc_id").slice(a, n), column(batch, "held_out").slice(a, n)
                zero = [pa.nulls(m, t) for t in (pa.int64(), pa.bool_())]
                # A document's own row has a key that is no word, as it holds a space, and so meets no count.
                names = [b" %d" % k for k in keys[a:b].tolist()] + tails
                cols = [
                    pa.array(np.concatenate([keys[a:b], *tail_keys])), pa.array(names, pa.binary()), pa.array([0] * n + tail_n, pa.int64()), pa.concat_arrays([ids, zero[0]]), pa.concat_arrays([marks, zero[1]]),
                    pa.array([x[0] for x in own] + [0] * m, pa.int64()), pa.array([x[1] for x in own] + [0] * m, pa.int64()), pa.array([x[2] for x in own] + [0.0] * m, pa.float64()), pa.array([x[3] for x in own] + [0.0] * m, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["key", "word", "n", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each of a document's other words adds."""
        model = sent.value
        for batch in batches:
            n = column(batch, "n").to_numpy()
            other = np.flatnonzero(n)
            base, score, known = (column(batch, x).to_numpy().copy() for x in ("base_score", "score", "n_known"))
            if len(other):
                words = column(batch, "word").take(pa.array(other)).dictionary_encode()
                which, kinds = words.indices.to_numpy(), words.dictionary.to_pylist()
                c = column(batch, "c").fill_null(0).to_numpy()[other]
                of = np.zeros(len(kinds))
                of[which] = c
                base[other] = model.base_of(c) * n[other]
                score[other] = model.score_of(kinds, of)[which] * n[other]
                known[other] = np.where(c > 0, n[other], 0)
            keep = ["key", "doc_id", "held_out", "n_tokens"]
            yield pa.RecordBatch.from_arrays([*(column(batch, x) for x in keep), pa.array(known), pa.array(base), pa.array(score)], [*keep, "n_known", "base_score", "score"])

    flat = rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "held_out", "text").mapInArrow(split, "key long, word binary, n long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    met = flat.join(counts, "word", "left").select("key", "word", "n", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "c")
    weighed = met.mapInArrow(weigh, "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    summed = weighed.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(scan(spark, sf_dir, "documents"))


QUERIES = {"op8_lm_score": op8_lm_score}
ORACLES: dict[str, str] = {}
