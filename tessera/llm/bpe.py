"""BPE encoding and decoding with a tokenization automaton.

``Automaton`` compiles the merges of a vocabulary into a deterministic automaton over tokens: its accepted paths are the
sequences that BPE produces. It starts as one state with a loop for each byte symbol. Each merge (u, v) in turn is a
gadget: the state after u is split into one that lacks the arc v, and wherever u then v could be read, an arc for uv leads
to where v led. All arcs of one label end in one state, so the compiled automaton is the state after each label (``after``)
and which labels each state has arcs for. Of that table (states x labels) a slot is filled when it is first asked for, from
the splits that lead to the state: a split state differs from its origin by the one arc it lacks and the time of the split.

A word is read symbol by symbol, many words at once: one step per symbol through a table of the labels' common beginnings,
and one look at the arcs for each label that ends there. Exactly one path spells each beginning of a word, so each place has
at most one state. Decoding emits the labels of the arcs.

Words that recur are encoded once for each worker (in tables of bounded size that hold no part of the result).

Defined results: a null text counts as empty and has no tokens; rows are independent of one another.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import FORGET, column, mapped, mix, scan, sliced, strings

VOCABULARY = "word_bpe_49k.json"
#: Unicode's White_Space, as regular expressions of tokenizers see it.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: How many words a worker keeps encoded, twice over.
KEEP = 200_000
#: Slots for arcs that a worker has worked out.
ARCS = 1 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: From a printable character to the character of its byte, and back.
_SYMBOLS = str.maketrans({chr(b): s for b, s in enumerate(byte_symbols())})
_CODES = str.maketrans({s: chr(b) for b, s in enumerate(byte_symbols())})


#: What plain texts hold: characters that normalisation leaves as they are, whose categories the pattern below spells out.
_OTHER_THAN_PLAIN = re.compile("[^\x00-\x7f\xa0-\u012f\u0131-\u017f]").search
_PLAIN = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-\u017f]+|[0-9²³¹¼½¾]|[^\t-\r \xa0a-zªµºß-öø-\u017f0-9²³¹¼½¾]+").findall
_PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Splitter:
    """From a text to the words that are encoded each by itself, and to special ids, as a tokenizer file has it."""

    def __init__(self, spec: dict):
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace("\\s", _WHITE)).findall
        self.plain = pattern == _PLAIN_PATTERN
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda x: [x]

    def __call__(self, text: str) -> list[str | int]:
        special = any(x in text for x in self.special)
        if self.plain and not special and (text.isascii() or not _OTHER_THAN_PLAIN(text)):
            return _PLAIN(text.lower())
        out: list[str | int] = []
        for part in self.cut(text) if special else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                part = unicodedata.normalize("NFC", part)
                # Each character by itself: str.lower() of a whole word treats a final sigma otherwise.
                out += self.words(part.lower() if "Σ" not in part else "".join(c.lower() for c in part))
        return out


def symbols(word: str) -> str:
    """The byte symbols of a word."""
    return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(_SYMBOLS)


class Automaton:
    """Merges compiled to tables: the parts of each token and the time of the gadget that made its arc, and the splits, each
    by the token whose state was split and the arc taken from it, with its time. after: the state that each label leads to."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        n = len(vocab)
        self.end, self.label = end, [""] * n
        for s, i in vocab.items():
            self.label[i] = s
        self.left, self.made, self.live = [-1] * n, [0] * n, [True] * n
        right, after = [-1] * n, [0] * n
        self.origin, self.lacks, self.split_at = [0], [-1], [0]
        splits: dict[int, int] = {}
        products = set()
        for time, (u, v) in enumerate(merges, 1):
            a, b, x = vocab[u], vocab[v], vocab[u + v]
            if x in products:
                raise ValueError(f"two merges make {u + v!r}")
            products.add(x)
            self.left[x], right[x], self.made[x], after[x] = a, b, time, after[b]
            if not (self.live[a] and self.live[b] and self.has(after[a], b)):
                self.live[x] = False  # no path reads u then v any more
                continue
            self.origin.append(after[a])
            self.lacks.append(b)
            self.split_at.append(time)
            after[a] = len(self.origin) - 1
            splits[a << 20 | b] = time
        self.left, self.right, self.made = (np.array(x, np.int64) for x in (self.left, right, self.made))
        self.split_keys = np.array(sorted(splits), np.int64)
        self.split_times = np.array([splits[k] for k in self.split_keys.tolist()], np.int64)
        self.states = len(self.origin)
        del self.origin, self.lacks, self.split_at  # the slots of the table are worked out from the splits above
        self.after = np.array(after, np.int64)
        self.reads = np.full(self.states, -1, np.int64)  # a label that leads to each state; the start is state 0
        self.reads[self.after[::-1]] = np.arange(n)[::-1]
        self.reads[0] = -1
        self._tables({i: s for s, i in vocab.items() if self.live[i] and (i in products or len(s.removesuffix(end)) == 1)})

    def _tables(self, arcs: dict[int, str]) -> None:
        """The trie of arc labels (nodes with children first, so that the table of steps stays small), and arrays."""
        children: list[dict[int, int]] = [{}]
        token, final = [-1], [-1]
        code = {c: b for b, c in enumerate(byte_symbols())}
        for i, s in arcs.items():
            last = s.endswith(self.end) and len(s) > len(self.end)
            at = 0
            for c in s.removesuffix(self.end) if last else s:
                nxt = children[at].get(code[c])
                if nxt is None:
                    nxt = children[at][code[c]] = len(token)
                    children.append({})
                    token.append(-1)
                    final.append(-1)
                at = nxt
            (final if last else token)[at] = i
        order = sorted(range(len(token)), key=lambda n: not children[n])
        inner = sum(map(bool, children))
        new = {n: k for k, n in enumerate(order)}
        self.step = np.full((inner + 1, 256), -1, np.int32)  # the last row: of nodes without children
        for k, n in enumerate(order[:inner]):
            for c, to in children[n].items():
                self.step[k, c] = new[to]
        self.token, self.final = np.array([token[n] for n in order], np.int32), np.array([final[n] for n in order], np.int32)
        self.inner = inner
        self.arcs = np.full(ARCS, -1, np.int64)

    def has(self, state: int, x: int) -> bool:
        """Whether state has an arc for token x, while merges are compiled."""
        left, made, origin, lacks, split_at = self.left, self.made, self.origin, self.lacks, self.split_at
        while state:
            if made[x] >= split_at[state]:
                x = left[x]
            elif x == lacks[state]:
                return False
            else:
                state = origin[state]
        return True

    def have(self, state: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whether each state has an arc for x: slots of the table of arcs, filled when they are first asked for."""
        key = state << 20 | x
        slot = (mix(key.view(np.uint64)) & np.uint64(ARCS - 1)).astype(np.int64)
        entry = self.arcs[slot]
        out = (entry & 1).astype(bool)
        miss = np.flatnonzero(entry >> 1 != key)
        if len(miss):
            fresh, back = np.unique(key[miss], return_inverse=True)
            got = self._work_out(self.reads[fresh >> 20], fresh & 0xFFFFF)[back]
            out[miss] = got
            self.arcs[slot[miss]] = key[miss] << 1 | got
        return out

    def _work_out(self, before: np.ndarray, x: np.ndarray) -> np.ndarray:
        """An arc is lacking if some split took it: that of a token u on the right edge of before, while u's state still
        counted (until the token above u was made), for what then stood for x (y on its left edge)."""
        left, right, made, keys, times = self.left, self.right, self.made, self.split_keys, self.split_times
        out, never = np.ones(len(x), bool), np.int64(1 << 40)
        act = np.flatnonzero(before >= 0)
        u, until = before[act], np.full(len(act), never)
        while len(act):
            sub, v, most, y, ymost = act, u, until, x[act], np.full(len(act), never)
            while len(sub):
                key = v << 20 | y
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                gone = (keys[at] == key) & (times[at] < most) & (times[at] <= ymost)
                out[sub[gone]] = False
                ymost, y = made[y], left[y]
                go = np.flatnonzero(~gone & (y >= 0))
                sub, v, most, y, ymost = sub[go], v[go], most[go], y[go], ymost[go]
            until, u = made[u], right[u]
            go = np.flatnonzero(out[act] & (u >= 0))
            act, u, until = act[go], u[go], until[go]
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        """For each word of byte symbols the ids along the one path that spells it, as little-endian unsigned 32-bit integers.
        Words of like length go together."""
        out: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        at = 0
        while at < len(order):
            end = at + 1
            longest = max(8, len(words[order[at]]) * 5 // 4)
            while end < len(order) and len(words[order[end]]) <= longest and end - at < 20_000:
                end += 1
            for k, got in zip(order[at:end], self._together([words[k] for k in order[at:end]]), strict=True):
                out[k] = got
            at = end
        return out

    def _together(self, words: list[str]) -> list[bytes]:
        size = np.array([len(w) for w in words], np.int64)
        m, n = len(words), int(size.max())
        raw = np.frombuffer("".join(words).translate(_CODES).encode("latin-1"), np.uint8)
        row = np.repeat(np.arange(m), size)
        symbols = np.zeros((n, m), np.uint8)
        symbols[np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size), row] = raw
        last, came = np.full((n + 1, m), -1, np.int32), np.zeros((n + 1, m), np.int32)  # the label that ends here, and its start
        none = np.zeros(0, np.int64)
        who, start, state, node = none, none, none, none.astype(np.int32)  # labels that are being read: of which word, from where
        for j in range(n):
            begin = np.flatnonzero(size > j) if not j else np.flatnonzero((last[j] >= 0) & (size > j))
            who, start = np.concatenate((who, begin)), np.concatenate((start, np.full(len(begin), j)))
            state = np.concatenate((state, self.after[last[j, begin]] if j else np.zeros(len(begin), np.int64)))
            node = np.concatenate((node, np.zeros(len(begin), np.int32)))
            node = self.step[np.minimum(node, self.inner), symbols[j, who]]
            done = size[who] == j + 1
            x = np.where(done, self.final[node], self.token[node])
            new = np.flatnonzero((node >= 0) & (x >= 0))
            new = new[self.have(state[new], x[new].astype(np.int64))]
            last[j + 1, who[new]] = x[new]
            came[j + 1, who[new]] = start[new]
            go = np.flatnonzero((node >= 0) & ~done)
            who, start, state, node = who[go], start[go], state[go], node[go]
        # Back along each path, all words at once.
        at, ids, owner, step = size.copy(), [], [], []
        who = np.flatnonzero(at > 0)
        while len(who):
            ids.append(last[at[who], who])
            owner.append(who)
            step.append(at[who])
            at[who] = came[at[who], who]
            who = who[at[who] > 0]
        owners = np.concatenate(owner)
        by = np.lexsort((np.concatenate(step), owners))
        flat, stop = np.concatenate(ids)[by].astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(owners, minlength=m))).tolist()
        return [flat[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)]


class Recent:
    """A bounded table of what recurs. make: from keys not held to their values."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], keep: int = KEEP):
        self.make, self.keep = make, keep
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def with_all(self, keys: set[str]) -> dict[str, bytes]:
        """A table that holds all keys, until the next call."""
        if len(self.new) > self.keep:
            self.new, self.old = {}, self.new
        new, old, missing = self.new, self.old, []
        for k in keys - new.keys():
            v = old.get(k)
            if v is None:
                missing.append(k)
            else:
                new[k] = v
        if missing:
            new.update(zip(missing, self.make(missing), strict=True))
        return new


class Encoder:
    """Encodes texts word by word. encode: from words of byte symbols to their ids."""

    def __init__(self, splitter: Splitter, encode: Callable[[list[str]], list[bytes]], keep: int = KEEP):
        def make(words: list) -> list[bytes]:
            spelled = [symbols(w) for w in words if w.__class__ is str]
            got = encode(spelled)
            if len(spelled) == len(words):
                return got
            each = iter(got)
            return [next(each) if w.__class__ is str else w.to_bytes(4, "little") for w in words]

        self.split, self.table = splitter, Recent(make, keep)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        words = list(map(self.split, texts))
        known = self.table.with_all(set().union(*words)).__getitem__
        return [b"".join(map(known, w)) for w in words]


@lru_cache(2)
def automaton(path: str) -> tuple[Automaton, Encoder, list[str]]:
    with open(path) as f:
        spec = json.load(f)
    model = spec["model"]
    a = Automaton(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
    labels = a.label + [""] * (max([len(a.label) - 1, *(t["id"] for t in spec["added_tokens"])]) + 1 - len(a.label))
    for t in spec["added_tokens"]:
        labels[t["id"]] = t["content"]
    return a, Encoder(Splitter(spec), a.encode), labels


FORGET.append(automaton.cache_clear)


def groups(values: list[str], most: int = 1 << 21) -> Iterator[list[str]]:
    part, held = [], 0
    for x in values:
        part.append(x)
        held += len(x)
        if held > most:
            yield part
            part, held = [], 0
    if part:
        yield part


def tokens(docs: DataFrame, digests: bool = False, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, and ids (array<int>) with decoded, or with digests their SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder, labels = automaton(vocabulary_path(vocabulary))
        label = labels.__getitem__
        for batch in sliced(batches):
            values, at = strings(column(batch, "text")), 0
            for part in groups(values):
                ids = encoder.ids(part)
                decoded = [" ".join(map(label, np.frombuffer(x, "<u4").tolist())) for x in ids]
                first = [column(batch, "doc_id").slice(at, len(part)), pa.array([len(x) // 4 for x in ids], pa.int64())]
                at += len(part)
                if digests:
                    yield pa.RecordBatch.from_arrays([*first, pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([*first, pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), pa.array(decoded)], ["doc_id", "n_tokens", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema, "bpe")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(scan(spark, sf_dir, "documents"), digests=True)


QUERIES = {"op9_bpe": op9_bpe}
ORACLES: dict[str, str] = {}
