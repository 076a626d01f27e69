"""Evaluation texts leaking into training text: CGK embedding, bit-sampling LSH over windows, exact edit verification."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of all items that are searched for in one pass; more items go in further passes over the documents. A worker
#: holds 16 bytes for each, as often as there are walks.
PASS_WORDS = 500_000
#: Windows that are embedded at once, which bounds a worker's memory whatever the length of a text.
AT_ONCE = 1 << 18
#: Distinct words whose hashes a worker keeps.
KEPT_WORDS = 1 << 20
#: A recall that needs more walks is refused, not missed.
MOST_WALKS = 1000
_WORD = re.compile("[a-z0-9]+")
_GONE = {0xAD: None, 0x200B: None}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """NFKC form, soft hyphens and zero-width spaces removed, lower case, maximal runs of a-z and 0-9."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_GONE)
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Walk:
    """One repetition: the random walk's multipliers and the sampled steps."""

    steps: np.ndarray
    sampled: tuple[bool, ...]


def walks(window: int, bits: int, n: int, seed: int) -> list[Walk]:
    """``n`` random walks of 3 * window steps, ``bits`` of them sampled."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        steps = rng.integers(1 << 62, size=3 * window, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        at = set(rng.choice(3 * window, size=min(bits, 3 * window), replace=False).tolist())
        out.append(Walk(steps, tuple(j in at for j in range(3 * window))))
    return out


def keys(symbols: np.ndarray, starts: np.ndarray, window: int, walk: Walk) -> np.ndarray:
    """LSH keys of the windows that begin at ``starts``.

    The CGK embedding of a window of n words has 3n places; place j repeats the current word, and a random bit of (j,
    word) says whether to go on to the next one; after the last word come zeros. Two windows at a small edit distance
    walk on together after an edit and agree in most places. The key hashes the sampled places.
    """
    at = starts.copy()
    last = starts + window
    key = np.zeros(len(starts), np.uint64)
    padded = np.append(symbols, np.uint64(0))
    ends = np.int64(len(symbols))  # where a window that is used up stays: the zero after all words
    for j in range(max((j for j, x in enumerate(walk.sampled) if x), default=-1) + 1):
        now = padded[at]
        if walk.sampled[j]:
            key ^= now
            key *= _MIX
            key ^= key >> np.uint64(29)
        now *= walk.steps[j]
        now >>= np.uint64(63)
        at += now.view(np.int64)
        if j >= window - 1:  # no window can be used up before
            at[at == last] = ends
    return key


def edit_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two word lists, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    if most == 0:
        return 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _hashes(ws: list[str], kept: dict[str, int]) -> np.ndarray:
    import xxhash

    if len(kept) > KEPT_WORDS:
        kept.clear()
    out = np.empty(len(ws), np.uint64)
    for i, w in enumerate(ws):
        h = kept.get(w)
        if h is None:
            h = kept[w] = xxhash.xxh64_intdigest(w) | 1
        out[i] = h
    return out


def _planted(symbols: list[np.ndarray], window: int, edits: int, trials: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(items, texts), a row per trial: a window of an item, and the same with ``edits`` edits at random places, other words around it.

    The mixtures of substitutions, insertions and deletions take equal parts, ``trials`` rows each, one after the other.
    The passage begins at word ``edits`` of its text; its first word stays, for edits there are easily met one word on.
    """
    fresh = lambda n: rng.integers(1 << 62, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    long = [s for s in symbols if len(s) >= window]
    asked, texts = [], []
    for mixture in combinations_with_replacement("sid", min(edits, window - 1)):
        for _ in range(trials):
            s = long[rng.integers(len(long))]
            at = int(rng.integers(len(s) - window + 1))
            b = s[at : at + window].tolist()
            places = (1 + rng.choice(window - 1, size=len(mixture), replace=False)).tolist()
            for p, kind in sorted(zip(places, rng.permutation(list(mixture))), reverse=True):
                if kind == "s":
                    b[p] = int(fresh(1)[0])
                elif kind == "i":
                    b.insert(p, int(fresh(1)[0]))
                else:
                    del b[p]
            asked.append(s[at : at + window])
            texts.append(np.concatenate([fresh(edits), np.array(b, np.uint64), fresh(3 * edits)])[: window + 3 * edits])
    return np.array(asked), np.array(texts)


def repetitions(symbols: list[np.ndarray], window: int, edits: int, bits: int, recall: float, seed: int, trials: int = 400) -> int:
    """Walks needed so that a passage of ``window`` words within ``edits`` word edits is met with probability ``recall`` in at least one.

    One suffices for equal windows, whose keys are equal. Else the search itself is tried: passages of the items with
    every mixture of edits, ``trials`` of each, within other words, are looked up with the very walks of ``seed``, one
    walk after the other, until of the worst mixture, too, the share ``recall`` was met by at least one of them, with two
    standard errors to spare.
    """
    if edits == 0 or not any(len(s) >= window for s in symbols):
        return 1
    asked, texts = _planted(symbols, window, edits, trials, np.random.default_rng(seed + 1))
    flat, starts = asked.ravel(), np.arange(len(asked)) * window
    around, width = texts.ravel(), texts.shape[1]
    near = (np.arange(len(texts)) * width)[:, None] + np.arange(2 * edits + 1)
    met, n = np.zeros(len(asked), bool), 0
    while (share := met.reshape(-1, trials).mean(axis=1).min()) - 2 * math.sqrt(share * (1 - share) / trials) < recall:
        if n == MOST_WALKS:
            raise ValueError(f"{MOST_WALKS} walks with {bits} bits don't reach a recall of {recall}")
        walk = walks(window, bits, n + 1, seed)[n]
        n += 1
        same = (keys(around, near.ravel(), window, walk).reshape(near.shape) == keys(flat, starts, window, walk)[:, None]) & ~met[:, None]
        for t, s in zip(*(x.tolist() for x in np.nonzero(same))):
            if not met[t]:
                theirs, ours = asked[t].tolist(), texts[t].tolist()
                met[t] = min(edit_distance(ours[s : s + window + x], theirs, edits) for x in range(-edits, edits + 1)) <= edits
    return n


class Index:
    """The items of one pass: LSH keys of all their windows, and the words for verification."""

    def __init__(self, items: list[tuple[int, str]], window: int, edits: int, bits: int, recall: float, seed: int):
        self.window, self.edits = window, edits
        self.ids = [i for i, _ in items]
        self.words = [words(t) for _, t in items]
        kept: dict[str, int] = {}
        symbols = [_hashes(w, kept) for w in self.words]
        self.walks = walks(window, bits, repetitions(symbols, window, edits, bits, recall, seed), seed)
        self.tables = []
        for walk in self.walks:
            long = [(n, len(s) - window + 1) for n, s in enumerate(symbols) if len(s) >= window]
            found = np.concatenate([np.zeros(0, np.uint64), *(keys(symbols[n], np.arange(m), window, walk) for n, m in long)])
            item = np.concatenate([np.zeros(0, np.int32), *(np.full(m, n, np.int32) for n, m in long)])
            at = np.concatenate([np.zeros(0, np.int32), *(np.arange(m, dtype=np.int32) for _, m in long)])
            order = np.argsort(found, kind="stable")
            self.tables.append((self._filter(found), found[order], item[order], at[order]))

    @staticmethod
    def _filter(found: np.ndarray) -> np.ndarray:
        """A bit per slot, sparse enough that few windows pass by chance."""
        slots = np.zeros(1 << max(16, (16 * max(1, len(found))).bit_length()), bool)
        slots[found & np.uint64(len(slots) - 1)] = True
        return slots

    def hits(self, docs: list[list[str]], symbols: np.ndarray) -> dict[tuple[int, int], int]:
        """(place in ``docs``, item id) -> least edit distance of a window pair within ``edits``; ``symbols`` are the words' hashes, end to end.

        The windows of all documents are embedded together, so that a step costs little more than its arithmetic.
        """
        n, best = self.window, {}
        sizes = np.array([len(d) for d in docs], np.int64)
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(docs)), np.maximum(sizes - n + 1, 0))
        first = np.cumsum(np.maximum(sizes - n + 1, 0)) - np.maximum(sizes - n + 1, 0)
        starts = np.arange(len(owner)) - first[owner] + begin[owner]
        for lo in range(0, len(starts), AT_ONCE):
            part = starts[lo : lo + AT_ONCE]
            for walk, (slots, known, items, ats) in zip(self.walks, self.tables):
                found = keys(symbols, part, n, walk)
                some = np.nonzero(slots[found & np.uint64(len(slots) - 1)])[0]
                first, last = np.searchsorted(known, found[some], "left"), np.searchsorted(known, found[some], "right")
                for p, x, y in zip(some.tolist(), first.tolist(), last.tolist()):
                    for item, at in zip(items[x:y].tolist(), ats[x:y].tolist()):
                        k = int(owner[lo + p])
                        pair = (k, self.ids[item])
                        if best.get(pair, self.edits + 1) == 0:
                            continue
                        theirs = self.words[item][at : at + n]
                        s = int(part[p] - begin[k])
                        if len(set(theirs).difference(docs[k][s : s + n + self.edits])) > self.edits:
                            continue  # each of these words costs an edit
                        d = min(edit_distance(docs[k][s : s + n + x], theirs, self.edits) for x in range(-self.edits, self.edits + 1))
                        if d <= self.edits and d < best.get(pair, self.edits + 1):
                            best[pair] = d
        return best


def _searcher(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, kept = index.value, {}

        def emit(ids: list[int], docs: list[list[str]], parts: list[np.ndarray]) -> pa.RecordBatch:
            out = [(ids[k], item, d) for (k, item), d in ix.hits(docs, np.concatenate(parts)).items()] if docs else []
            a, b, c = zip(*out) if out else ((),) * 3
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32())], ["doc_id", "item_id", "edits"])

        ids, docs, parts, size = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ws = words(text.as_py())
                if len(ws) >= ix.window:
                    ids.append(doc_id)
                    docs.append(ws)
                    parts.append(_hashes(ws, kept))
                    size += len(ws)
                    if size >= AT_ONCE:
                        yield emit(ids, docs, parts)
                        ids, docs, parts, size = [], [], [], 0
        yield emit(ids, docs, parts)

    return run


def leaks(docs: DataFrame, items: DataFrame, window: int = 12, edits: int = 0, bits: int = 12, recall: float = 0.99, seed: int = 7) -> DataFrame:
    """(doc_id, item_id, edits): documents with a window of ``window`` words within ``edits`` word edits of a window of the item.

    Every window of every document is embedded and looked up; with ``edits`` 0 none is missed, else each with
    probability ``recall``. Candidates are verified on the words themselves. The items are the stated query set: they
    are searched in passes of at most PASS_WORDS words each, so what a worker holds is bounded, and documents are not
    shuffled. Null, blank and short texts share nothing. Repeated rows count once; null ids drop out.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 4
    passes = max(1, math.ceil(size / PASS_WORDS))
    found = None
    for k in range(passes):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) if passes > 1 else asked
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in part.collect()], window, edits, bits, recall, seed))
        one = texts.mapInArrow(_searcher(index), "doc_id long, item_id long, edits int")
        found = one if found is None else found.unionByName(one)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
