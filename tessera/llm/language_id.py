"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of the letters of its words (order ``ORDER``, within a word and its bounds): raw counts at the
highest order, continuation counts below, absolute discounts estimated for each order. The n-grams of all languages stand
in one sorted array of 64-bit hashes for each order, each with the languages that have it and their interpolated log
probabilities; contexts and their back-off weights likewise. So the model grows with the n-grams, not with n-grams times
languages. A text goes to the language with the lowest cross-entropy per letter, and is rejected if that
lies above what held-back training texts of the language reach.

The models are fitted on a bounded sample: about ``ROWS`` labelled rows of each language (chosen by a hash of the id), of
which a fifth calibrates the rejection; of the others the ``WORDS`` commonest words of at most ``LETTERS`` letters. Every
language that has a label is learned, however many there are. Predictions see the text alone.

Defined results: ``und`` with score 0, rejected, where the text is null or has no letter; where no row has a label, all
texts are ``und`` and those with letters are not rejected. A null id is held out of nothing and never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import groups
from tessera.llm.common import column, mapped, mix, residue, scan, sliced, strings, windows

ORDER, ROWS, WORDS, LETTERS, UNKNOWN = 4, 400, 50_000, 64, 1 / 3000
#: Rejection: bits per letter above the calibration's highest, and the allowance for short texts (over the root of letters).
MARGIN, SHORT = 1.5, 4.0
#: Values that a worker keeps of runs of letters, and characters of text that it scores at a time.
CELLS, BLOCK, SLOTS = 4_000_000, 1 << 18, 20
_START, _STOP = 1, 2


def _layout(words: list[str]):
    """Letters of words with their bounds in one array; the place of each in its word; the word of each."""
    size = np.array([len(w) for w in words], np.int64) + 2
    begin = np.cumsum(size) - size
    codes = np.empty(int(size.sum()), np.uint32)
    inner = np.ones(len(codes), bool)
    inner[begin] = inner[begin + size - 1] = False
    codes[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    codes[begin], codes[begin + size - 1] = _START, _STOP
    word = np.repeat(np.arange(len(words)), size)
    return mix(codes.astype(np.uint64) + np.uint64(77)), np.arange(len(codes)) - begin[word], word


@lru_cache(1)
def _is_letter() -> np.ndarray:
    """For each code point whether it is a letter."""
    out = np.zeros(0x110000, bool)
    out[[ord(x) for x in regex.findall(r"\p{L}", "".join(map(chr, range(0x110000))))]] = True
    return out


def _spelled(texts: list[str]):
    """As _layout, of all runs of letters in texts; which text each letter is of."""
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = np.concatenate(([False], _is_letter()[codes], [False]))
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2] + 2
    begin = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(begin, size)
    out = np.empty(len(place), np.uint32)
    inner = np.ones(len(place), bool)
    inner[begin] = inner[begin + size - 1] = False
    out[inner] = codes[letter[1:-1]]
    out[begin], out[begin + size - 1] = _START, _STOP
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return mix(out.astype(np.uint64) + np.uint64(77)), place, np.repeat(np.searchsorted(ends, start, side="right"), size)


def _grams(letters: np.ndarray, place: np.ndarray, k: int):
    """Ends of the k-grams that stay in a word (a lone start is none), with hashes of gram, context and suffix."""
    h = windows(letters, k)
    end = np.arange(k - 1, len(letters))
    ok = (place[end] >= k - 1) & (place[end] >= 1)
    context = windows(letters, k - 1)[: len(h)][ok] if k > 1 else np.zeros(int(ok.sum()), np.uint64)
    suffix = windows(letters, k - 1)[1 : len(h) + 1][ok] if k > 1 else context
    return end[ok], h[ok], context, suffix, place[end[ok]] == k - 1


def _sorted(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where each one's entries begin, and the entries' languages and log2 values."""
    key, owner = np.concatenate(keys), np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
    by = np.argsort(key, kind="stable")
    key = key[by]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.append(first, len(key)), owner[by], np.log2(np.concatenate(values)[by]).astype(np.float32)


def _entries(table: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of keys: which of the keys, language, value."""
    known, first, owner, value = table
    at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
    hit = np.flatnonzero(known[at] == keys) if len(known) else np.zeros(0, np.int64)
    begin, times = first[at[hit]], first[at[hit] + 1] - first[at[hit]]
    place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin, times)
    return np.repeat(hit, times), owner[place], value[place]


class Model:
    """names of the languages; for each order the sorted hashes of grams and of contexts, with the entries of each."""

    def __init__(self, words: dict[str, dict[str, int]]):
        self.names = sorted(words)
        self.orders: list[tuple[tuple, tuple]] = []
        self.limits = np.full(len(self.names), np.inf)
        made = [self._language(words[x]) for x in self.names]
        for k in range(ORDER):
            grams = _sorted([m[k][0] for m in made], [m[k][1] for m in made])
            self.orders.append((grams, _sorted([m[k][2] for m in made], [m[k][3] for m in made])))

    @staticmethod
    def _language(words: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each order: sorted grams with their probabilities, sorted contexts with their back-off weights."""
        letters, place, word = _layout(list(words))
        count, out = np.array(list(words.values()), np.float64), []
        for k in range(1, ORDER + 1):
            end, h, context, suffix, at_start = _grams(letters, place, k)
            if k < ORDER:
                # How many different letters precede the gram; where a word begins none does, so its tokens count.
                _, longer, _, tail, _ = _grams(letters, place, k + 1)
                _, first = np.unique(longer, return_index=True)
                kinds, times = np.unique(tail[first], return_counts=True)
                starts, where = np.unique(h[at_start], return_inverse=True)
                tokens = np.bincount(where, count[word[end[at_start]]], len(starts)) if k > 1 else np.zeros(len(starts))
                gram, back = np.unique(np.concatenate((kinds, starts)), return_inverse=True)
                c = np.bincount(back, np.concatenate((times, tokens)), len(gram))
            else:
                gram, back = np.unique(h, return_inverse=True)
                c = np.bincount(back, count[word[end]], len(gram))
            order = np.argsort(h, kind="stable")
            pick = order[np.searchsorted(h[order], gram)]
            below = np.full(len(gram), UNKNOWN) if not out else out[-1][1][np.searchsorted(out[-1][0], suffix[pick])]
            contexts, of = np.unique(context[pick], return_inverse=True)
            once, twice = float((c == 1).sum()), float((c == 2).sum())
            d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            total = np.bincount(of, c, len(contexts))
            g = np.where(total > 0, d * np.bincount(of, minlength=len(contexts)) / np.maximum(total, 1e-9), 1.0)
            out.append((gram, np.maximum(c - d, 0) / np.maximum(total[of], 1) + g[of] * below, contexts, g))
        return out

    def values(self, letters: np.ndarray, place: np.ndarray) -> np.ndarray:
        """For each letter its log2 probability after those before it, in each language."""
        value = np.full((len(letters), len(self.names)), np.log2(UNKNOWN), np.float32)
        for k, (grams, contexts) in enumerate(self.orders, 1):
            end, h, context, _, _ = _grams(letters, place, k)
            which, language, g = _entries(contexts, context)
            value[end[which], language] += g
            which, language, p = _entries(grams, h)
            value[end[which], language] = p  # it has the lower orders in it
        return value

    def words(self, words: list[str]) -> np.ndarray:
        """For each word the log2 probability in each language and, last, the number of letters predicted."""
        letters, place, word = _layout(words)
        value, told = self.values(letters, place), place > 0
        out = [np.bincount(word[told], value[told, i], len(words)) for i in range(len(self.names))]
        return np.stack([*out, np.bincount(word[told], minlength=len(words))], axis=1)


class Scorer:
    """Sums a model's log2 probabilities over the letters of texts. A letter's depends on the ORDER letters that end with it,
    fewer where the word begins; it is asked of the model once for each such run and kept."""

    def __init__(self, model: Model):
        self.model = model
        self.runs, self.values = np.zeros(0, np.uint64), np.zeros((len(model.names), 0))
        self.slots = np.zeros(1 << SLOTS, np.int32)  # where a run stands that ends with the slot's bits

    def texts(self, values: list[str]) -> np.ndarray:
        """For each text the sum in each language and, last, the number of letters predicted."""
        out = np.zeros((len(values), len(self.model.names) + 1))
        letters, place, owner = _spelled([t.lower() for t in values])
        told = np.flatnonzero(place > 0)
        if not len(told):
            return out
        run = np.zeros(len(letters), np.uint64)
        for k in range(2, ORDER + 1):  # those of a full run, and those that a word begins with
            here = place[k - 1 :] >= k - 1
            run[k - 1 :][here] = windows(letters, k)[here]
        at = self._places(run[told], letters, place, told)
        out[:, -1] = np.bincount(owner[told], minlength=len(values))
        some = np.flatnonzero(out[:, -1])
        first = np.concatenate(([0], np.cumsum(out[some, -1].astype(np.int64))[:-1]))
        for i, value in enumerate(self.values):
            out[some, i] = np.add.reduceat(value[at], first)
        return out

    def _places(self, run: np.ndarray, letters: np.ndarray, place: np.ndarray, told: np.ndarray) -> np.ndarray:
        """Where the values of the runs stand that end at the letters told."""
        new = np.arange(len(run))
        if len(self.runs):
            at = self._found(run)
            new = np.flatnonzero(self.runs[at] != run)
            if not len(new):
                return at
        if len(self.runs) > CELLS // len(self.model.names):
            self.runs, self.values, new = self.runs[:0], self.values[:, :0], np.arange(len(run))
            self.slots[:] = 0
        fresh, pick = np.unique(run[new], return_index=True)
        step, parts = max(1, CELLS // len(self.model.names) // 8 // ORDER), []
        for a in range(0, len(fresh), step):
            end = told[new[pick[a : a + step]]]
            size = np.minimum(place[end], ORDER - 1) + 1
            last = np.cumsum(size) - 1
            inner = np.arange(size.sum()) - np.repeat(last - size + 1, size)
            parts.append(self.model.values(letters[np.repeat(end - size + 1, size) + inner], inner)[last].T.astype(np.float64))
        runs = np.concatenate((self.runs, fresh))
        by = np.argsort(runs)
        self.runs, self.values = runs[by], np.ascontiguousarray(np.concatenate((self.values, *parts), axis=1)[:, by])
        self.slots[self.runs & np.uint64((1 << SLOTS) - 1)] = np.arange(len(self.runs))
        return self._found(run)

    def _found(self, run: np.ndarray) -> np.ndarray:
        """Where the runs stand; any place for one that is not there."""
        at = self.slots[run & np.uint64((1 << SLOTS) - 1)]
        other = np.flatnonzero(self.runs[at] != run)
        at[other] = np.minimum(np.searchsorted(self.runs, run[other]), len(self.runs) - 1)
        return at


def _measured(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text and others) to the others, letters, best (index of the language), bits per letter, sure (0 to 1)."""
    others = [c for c in docs.columns if c != "text"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in sliced(batches):
            sums = np.concatenate([scorer.texts(g) for g in groups(strings(column(batch, "text")), BLOCK)] or [np.zeros((0, len(sent.value.names) + 1))])
            n = sums[:, -1]
            bits = -sums[:, :-1] / np.maximum(n, 1)[:, None]
            best = bits.argmin(axis=1)
            low = bits[np.arange(len(bits)), best]
            sure = 1 / np.exp2(-(bits - low[:, None]) * np.minimum(n, 40)[:, None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in others), pa.array(n.astype(np.int64)), pa.array(best.astype(np.int32)), pa.array(low), pa.array(sure)], [*others, "letters", "best", "bits", "sure"])

    kinds = dict(docs.dtypes)
    return mapped(docs, run, "".join(f"{c} {kinds[c]}, " for c in others) + "letters long, best int, bits double, sure double")


def fit(labelled: DataFrame) -> Model | None:
    """labelled: doc_id, text, lang (none of them null). None without rows."""
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    draw = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_000)) / 1_000_000.0
    # One row for each language, as in the model itself.
    sample = labelled.join(F.broadcast(sizes), "lang").where(draw < ROWS / F.col("rows")).withColumn("back", F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(5)) == 0)
    split = sample.where("NOT back").select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where((F.col("w") != "") & (F.length("w") <= LETTERS))
    counted = split.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    common = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("rank") <= WORDS)
    words: dict[str, dict[str, int]] = {}
    for r in common.toLocalIterator():
        words.setdefault(r["lang"], {})[r["w"]] = r["n"]
    if not words:
        return None
    model = Model(words)
    seen = _measured(sample.where("back").select("doc_id", F.col("lang").alias("label"), "text"), model).where("letters >= 20").select("label", "best", "bits", "letters").collect()
    for i, name in enumerate(model.names):
        own = [r["bits"] - SHORT / r["letters"] ** 0.5 for r in seen if r["label"] == name and r["best"] == i]
        if len(own) >= 5:
            model.limits[i] = max(own) + MARGIN
    return model


def languages(docs: DataFrame, modulus: int = 4, held: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score, rejected, bits (per letter), and the
    columns of carry as carry_0, carry_1 and so on."""
    part = residue(F.col("doc_id"), modulus)
    others = [F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)]
    names = [f"carry_{k}" for k in range(len(carry))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", part.alias("part"), *others)
    model = fit(rows.where((F.col("part") != held) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"))
    if model is None:
        blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
        return rows.select("doc_id", F.coalesce(F.col("part") == held, F.lit(False)).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), blank.alias("rejected"), F.lit(None).cast("double").alias("bits"), *names)
    measured = _measured(rows.select("doc_id", "part", "text", *names), model)
    learned, limits = F.array(*map(F.lit, model.names)), F.array(*(F.lit(float(x)) for x in model.limits))
    there = F.col("letters") > 0
    beyond = F.col("bits") > F.get(limits, F.col("best")) + SHORT / F.sqrt(F.col("letters"))
    return measured.select(
        "doc_id", F.coalesce(F.col("part") == held, F.lit(False)).alias("held_out"), F.when(there, F.get(learned, F.col("best"))).otherwise("und").alias("lang_pred"), F.when(there, F.col("sure")).otherwise(0.0).alias("score"),
        F.when(there, beyond).otherwise(True).alias("rejected"), F.when(there, F.col("bits")).alias("bits"), *names,
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(scan(spark, sf_dir, "documents"))


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
