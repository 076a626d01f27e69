"""Subject areas of documents: complement naive Bayes, refined by expectation-maximization, with calibrated posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, fresh_path, remove

#: Features are hashed into so many slots, which bounds the model (a row per slot, a column per class) whatever the
#: vocabulary; words take the first WORD_SLOTS, word pairs the rest.
SLOTS, WORD_SLOTS = 1 << 20, 1 << 18
#: Labelled documents the model is fitted on, at most, taken in hash order; unlabelled documents are all used.
LABELLED = 20_000
#: A table of subjects may have so many rows: a worker holds SLOTS sums for each.
MOST_SUBJECTS = 64
#: A language is told apart if at least this share of the documents is said to be in it.
LANGUAGE_SHARE = 0.01
#: Passes of expectation-maximization over all documents, and rounds in which a document's own mixture is settled.
PASSES, SETTLE = 3, 6
#: Smoothing of complement counts by a constant and by the feature's overall share; weight of text that bears on no
#: subject among the complement; log odds that a segment must overcome to bear on a subject; share of a labelled
#: document that may be off its labels.
ALPHA, TOWARDS, BACKGROUND, BIAS, NOISE = 0.3, 300.0, 0.2, 3.0, 0.05
#: In fitting, all of a document's segments count, but together no more than so many: one very long document doesn't
#: drown the rest. It has no part in judging.
WEIGHED = 64
#: The share of a document's bearing segments from which on it is about a subject.
SHARE = 0.25
#: Words whose hashes a worker keeps, features that are weighed at once, and bytes of text or of slots that are worked on
#: at once (a single document may have more).
KEPT, AT_ONCE, PIECE = 1 << 19, 1 << 18, 1 << 22


def _pieces(batches: Iterator[pa.RecordBatch], column: int, wide: int) -> Iterator[pa.RecordBatch]:
    """The batches in stretches of rows whose ``column`` has at most PIECE bytes, ``wide`` an element."""
    for batch in batches:
        values = batch.column(column)
        sizes = pc.fill_null(pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values), 0)
        begun = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64) * wide)])
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(begun, begun[lo] + PIECE, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def segmented(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, segment of each word, document of each segment) of a batch of texts.

    Segments are sentences and code lines; words are lower case, field names and camel case fall into their words, tokens
    with digits are left out. All of it runs in Arrow's kernels, over the whole batch.
    """
    texts = pc.fill_null(texts, "")
    if not pc.all(pc.string_is_ascii(texts)).as_py():
        texts = pc.utf8_normalize(texts, form="NFKC")
    texts = pc.replace_substring_regex(texts, r"""([.!?])["')\]}]*,?\s+""", r"\1" + "\n")
    texts = pc.utf8_lower(pc.replace_substring_regex(texts, "([a-z])([A-Z])", r"\1 \2"))
    parts = pc.split_pattern_regex(texts, r"[\r\n]+")
    document = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    tokens = pc.split_pattern_regex(parts.flatten(), r"[^\pL\pN]+")
    segment = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    words = tokens.flatten()
    good = pc.utf8_is_alpha(words)
    return words.filter(good), segment[good.to_numpy(zero_copy_only=False)], document


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every distinct word and word pair of a segment as a slot; ``ends`` tells the segments of a document apart."""
    import xxhash

    kept: dict[str, int] = {}
    for batch in _pieces(batches, 2, 1):
        n = batch.num_rows
        words, segment, document = segmented(batch.column(2))
        coded = words.dictionary_encode()
        if len(kept) > KEPT:
            kept.clear()
        names = coded.dictionary.to_pylist()
        for w in names:
            if w not in kept:
                kept[w] = xxhash.xxh64_intdigest(w)
        h = np.array([kept[w] for w in names] or [0], np.uint64)[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
        pair = segment[1:] == segment[:-1]
        mixed = (h[:-1][pair] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:][pair] * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed ^= mixed >> np.uint64(31)
        slot = np.concatenate([h % np.uint64(WORD_SLOTS), np.uint64(WORD_SLOTS) + mixed % np.uint64(SLOTS - WORD_SLOTS)]).astype(np.int64)
        every = np.sort(np.concatenate([segment, segment[1:][pair]]) * SLOTS + slot)
        once = every[np.diff(every, prepend=-1) > 0]
        at, slot = once // SLOTS, once % SLOTS
        last = np.append(np.nonzero(np.diff(at))[0], len(at) - 1) if len(at) else np.array([], np.int64)
        of = document[at[last]]  # of each segment that has a feature
        features, segments = np.bincount(document[at], minlength=n), np.bincount(of, minlength=n)
        begin = np.concatenate([[0], np.cumsum(features)])
        lists = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(features, slot), lists(segments, last + 1 - begin[of])], ["doc_id", "lang", "slots", "ends"])


@dataclass
class Batch:
    """Documents of a batch of features: slots end to end, the segment of each, the document of each segment."""

    slots: np.ndarray
    at: np.ndarray
    of: np.ndarray
    documents: int

    @classmethod
    def read(cls, slots: pa.ListArray, ends: pa.ListArray) -> Batch:
        n = len(slots)
        segments = pc.list_value_length(ends).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(np.arange(n), segments)
        e = ends.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.ones(len(e), bool)
        first[1:] = of[1:] != of[:-1]
        size = e - np.where(first, 0, np.concatenate([[0], e[:-1]])) if len(e) else e
        return cls(slots.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(e)), size), of, n)

    def summed(self, table: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Per segment the sum of its features' rows of ``table``, a stretch of segments at a time."""
        out = np.zeros((len(self.of), table.shape[1]))
        starts = np.nonzero(np.diff(self.at, prepend=-1))[0]
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + AT_ONCE, "right")) - 1) if starts[-1] - starts[lo] > AT_ONCE else len(starts)
            end = starts[hi] if hi < len(starts) else len(self.slots)
            out[lo:hi] = np.add.reduceat(table[row[starts[lo] : end]], starts[lo:hi] - starts[lo], axis=0)
            lo = hi
        return out


@dataclass
class Languages:
    """Which language a segment is in, by what is said of the documents that its words stand in."""

    names: list[str]
    weights: np.ndarray
    prior: np.ndarray

    def tell(self, batch: Batch) -> np.ndarray:
        if len(self.names) < 2:
            return np.zeros(len(batch.of), np.int64)
        return (batch.summed(self.weights, np.minimum(batch.slots, WORD_SLOTS)) + self.prior).argmax(axis=1)


def language(c):  # noqa: ANN001, ANN201
    """The first two letters, lower case; empty where there are none."""
    return F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), "^[a-z]{2}", 0)


def languages(features: DataFrame) -> Languages:
    """Learned from all documents with a common ``lang``: log shares of words by language. Nobody says so: one language.

    At most 1 / LANGUAGE_SHARE languages, and WORD_SLOTS rows come to the driver.
    """
    counts = {r[0]: r[1] for r in features.where("lang <> ''").groupBy("lang").count().collect()}
    names = sorted(x for x, n in counts.items() if n >= LANGUAGE_SHARE * sum(counts.values()))
    if len(names) < 2:
        return Languages(names, np.zeros((WORD_SLOTS + 1, 1)), np.zeros(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), WORD_SLOTS))
        for b in _pieces(batches, 1, 4):
            lang = pc.index_in(b.column(0), value_set=pa.array(names))
            x = Batch.read(b.column(1), b.column(2))
            of = pc.fill_null(lang, -1).to_numpy(zero_copy_only=False)[x.of[x.at]] if len(x.slots) else np.array([], int)
            for i in range(len(names)):
                sums[i] += np.bincount(x.slots[(of == i) & (x.slots < WORD_SLOTS)], minlength=WORD_SLOTS)
        used = np.nonzero(sums.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(s[used]) for s in sums)], ["slot", *(f"l{i}" for i in range(len(names)))])

    columns = [f"l{i}" for i in range(len(names))]
    sums = features.select("lang", "slots", "ends").mapInArrow(run, f"slot int, {', '.join(c + ' double' for c in columns)}").groupBy("slot").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    n = np.zeros((WORD_SLOTS, len(names)))
    n[sums.column("slot").to_numpy()] = np.column_stack([sums.column(c).to_numpy() for c in columns])
    share = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * WORD_SLOTS))
    weights = np.where(n.any(axis=1)[:, None], share - share.mean(axis=1, keepdims=True), 0)
    return Languages(names, np.vstack([weights, np.zeros((1, len(names)))]), np.log(n.sum(axis=0) / n.sum()))


class Model:
    """Weights of complement naive Bayes, normalised within each language; the last class bears on no subject.

    A feature weighs for a class as much as it is rarer outside it than outside the other classes, given how much of
    that language's text each class has; so words that are merely of one language weigh nothing.
    """

    def __init__(self, slots: np.ndarray, counts: np.ndarray, spoken: Languages):
        """``counts``: a row per slot in ``slots``, a column per class; other slots never occurred. A slot's rest modulo
        the languages is its language."""
        self.spoken, self.several = spoken, max(1, len(spoken.names))
        weights = np.zeros((len(slots) + 1, counts.shape[1]), np.float32)
        for of in range(self.several):
            at = np.nonzero(slots % self.several == of)[0]
            if len(at):
                subject = counts[at, :-1]
                n = subject.sum(axis=1, keepdims=True) + BACKGROUND * counts[at, -1:]
                outside = (n - subject + TOWARDS * n / max(n.sum(), 1e-9) + ALPHA) / (n.sum() - subject.sum(axis=0) + TOWARDS + ALPHA * len(at))
                weight = -np.log(outside)
                weights[at, :-1] = weight - np.median(weight, axis=1, keepdims=True)
        self.weights = weights
        self.row = np.full(SLOTS, len(slots), np.int32)
        self.row[slots] = np.arange(len(slots), dtype=np.int32)

    def scores(self, batch: Batch, slots: np.ndarray) -> np.ndarray:
        """A row of class scores per segment."""
        out = batch.summed(self.weights, self.row[slots])
        out[:, -1] += BIAS
        return out


def _placed(batch: Batch, spoken: Languages) -> np.ndarray:
    """The batch's slots within the language of their segment."""
    n = max(1, len(spoken.names))
    return batch.slots % (SLOTS // n) * n + spoken.tell(batch)[batch.at]


def posteriors(scores: np.ndarray, of: np.ndarray, prior: np.ndarray, settle: int = SETTLE) -> np.ndarray:
    """P(class | segment) under each document's own mixture of classes, which starts at its row of ``prior`` and is settled in a few rounds."""
    mixture = prior
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    starts = np.nonzero(np.diff(of, prepend=-1))[0]
    n = np.diff(np.append(starts, len(of)))[:, None]
    for _ in range(settle):
        p = scores * mixture[of]
        p /= p.sum(axis=1, keepdims=True)
        mixture = mixture.copy()
        mixture[of[starts]] = (np.add.reduceat(p, starts, axis=0) + prior[of[starts]]) / (n + prior[of[starts]].sum(axis=1, keepdims=True))
    return p


def _prior(labels: list[int] | None, k: int) -> np.ndarray:
    if not labels:
        return np.full(k + 1, 1 / (k + 1))
    prior = np.full(k + 1, NOISE / k)
    prior[labels] += 0.5 / len(labels)
    prior[k] = 0.5 - NOISE
    return prior / prior.sum()


def _counter(k: int, model, spoken):  # noqa: ANN001
    """Expected counts per slot and class. Without a model: labelled documents count for their labels, all documents as background."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, m = spoken.value, model.value if model else None
        sums = np.zeros((k + 1, SLOTS), np.float32)
        for b in _pieces(batches, 0, 4):
            x = Batch.read(b.column(0), b.column(1))
            if not len(x.slots):
                continue
            labels = b.column(2).to_pylist()
            slots = _placed(x, told)
            weight = np.minimum(1.0, WEIGHED / np.maximum(np.bincount(x.of, minlength=x.documents), 1))
            if m is None:
                share = np.zeros((x.documents, k + 1))
                for d, given in enumerate(labels):
                    if given:
                        share[d, given] = 1 / len(given)
                share[:, k] = 1
                p = share[x.of]
            else:
                p = posteriors(m.scores(x, slots), x.of, np.array([_prior(given, k) for given in labels]))
            p = p * weight[x.of][:, None]
            for c in range(k + 1):
                if p[:, c].any():
                    np.add.at(sums[c], slots, p[:, c].astype(np.float32)[x.at])
        used = np.nonzero(sums.any(axis=0))[0]
        for lo in range(0, len(used), 20_000):
            part = used[lo : lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(s[part].astype(np.float64)) for s in sums)], ["slot", *(f"c{c}" for c in range(k + 1))])

    return run


def _judge(k: int, model, spoken):  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, 1, 4):
            x = Batch.read(b.column(1), b.column(2))
            ids, about = b.column(0).to_numpy(zero_copy_only=False), np.zeros((x.documents, k), np.int64)
            if len(x.slots):
                best = posteriors(model.value.scores(x, _placed(x, spoken.value)), x.of, np.tile(_prior(None, k), (x.documents, 1))).argmax(axis=1)
                about = np.bincount(x.of * (k + 1) + best, minlength=x.documents * (k + 1)).reshape(-1, k + 1)[:, :k]
            d, c = np.nonzero(about)
            yield pa.RecordBatch.from_arrays([pa.array(ids[d], pa.int64()), pa.array(c, pa.int32()), pa.array(about[d, c], pa.int32()), pa.array(about.sum(axis=1)[d], pa.int32())], ["doc_id", "subject_no", "about", "bearing"])

    return run


def names(subjects: DataFrame) -> list[str]:
    """The subjects in order; at most MOST_SUBJECTS."""
    found = [r[0] for r in subjects.where("subject is not null").select("subject").distinct().orderBy("subject").limit(MOST_SUBJECTS + 1).collect()]
    if len(found) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    return found


def sample(labels: DataFrame, order: list[str]) -> DataFrame:
    """(doc_id, labels): at most LABELLED labelled documents in hash order, labels as numbers; a frame small enough to broadcast."""
    number = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("subject")).cast("int") - 1
    known = labels.where(F.col("doc_id").isNotNull() & F.col("subject").isin(order))
    return durable(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_set(number)).alias("labels")).orderBy(F.xxhash64("doc_id")).limit(LABELLED))


def featurized(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, lang, slots, ends): the features of every document, made once and written to ``path``; the passes read integers."""
    lang = language(F.col("lang")) if "lang" in docs.columns else F.lit("")
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text")
    made = texts.mapInArrow(_featurize, "doc_id long, lang string, slots array<int>, ends array<int>")
    made.write.parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def fit(features: DataFrame, labelled: DataFrame, k: int, passes: int = PASSES):  # noqa: ANN201
    """(model, languages) as broadcast variables: the model first from the labels, then refined over all documents.

    A pass reads the features of every document, without shuffling them; only sums per slot and class are aggregated,
    and what comes to the driver is at most SLOTS rows. Labelled documents keep to their labels but for NOISE, so wrong
    labels can be overruled.
    """
    sc = features.sparkSession.sparkContext
    spoken = sc.broadcast(languages(features))
    marked = features.join(F.broadcast(labelled), "doc_id", "left").select("slots", "ends", "labels")
    columns = ", ".join(f"c{c} double" for c in range(k + 1))
    model = None
    for _ in range(passes + 1):
        sums = marked.mapInArrow(_counter(k, model, spoken), f"slot int, {columns}").groupBy("slot").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(k + 1)]).toArrow()
        slots = sums.column("slot").to_numpy().astype(np.int64)
        counts = np.column_stack([sums.column(f"c{c}").to_numpy() for c in range(k + 1)]) if len(slots) else np.zeros((0, k + 1))
        order = np.argsort(slots)
        slots, counts = slots[order], counts[order]
        if model is None and counts[:, k].sum():  # as much background as labelled text
            counts[:, k] *= counts[:, :k].sum() / counts[:, k].sum()
        model = sc.broadcast(Model(slots, counts, spoken.value))
    return model, spoken


def judge(features: DataFrame, model, spoken, k: int) -> DataFrame:  # noqa: ANN001
    """(doc_id, subject_no, about, bearing): segments about each subject, and segments that bear on any."""
    return features.select("doc_id", "slots", "ends").mapInArrow(_judge(k, model, spoken), "doc_id long, subject_no int, about int, bearing int")


def calibrate(judged: DataFrame, labelled: DataFrame, k: int) -> list[tuple[float, float]]:
    """Slope and intercept per subject of P(subject | document) over the log odds of its share.

    Fitted on the labelled documents, each subject for itself, from counts per hundredth of share (at most 101 per
    subject and outcome come to the driver), and drawn towards the slope and intercept of all subjects together.
    """
    seen = judged.join(F.broadcast(labelled), "doc_id").select("subject_no", F.round(F.col("about") / F.col("bearing") * 100).cast("int").alias("bin"), F.array_contains("labels", F.col("subject_no")).alias("y"))
    rows = seen.groupBy("subject_no", "bin", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    x = np.array([_odds(r["bin"] / 100) for r in rows])
    y = np.array([float(r["y"]) for r in rows])
    n = np.array([float(r["n"]) for r in rows])
    of = np.array([r["subject_no"] for r in rows], int)
    shared = _logistic(x, y, n, np.array([1.0, -_odds(SHARE)]), 1.0)
    return [tuple(_logistic(x[of == c], y[of == c], n[of == c], shared, 10.0).tolist()) for c in range(k)]


def _odds(share: float) -> float:
    share = min(max(share, 0.005), 0.995)
    return float(np.log(share / (1 - share)))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, start: np.ndarray, hold: float) -> np.ndarray:
    """Newton steps on the log loss, held near ``start`` by a quadratic term."""
    w = start.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
        g = np.array([(n * (p - y) * x).sum(), (n * (p - y)).sum()]) + hold * (w - start)
        v = n * p * (1 - p)
        h = np.array([[(v * x * x).sum(), (v * x).sum()], [(v * x).sum(), v.sum()]]) + hold * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def subjects_of(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, share, posterior): for each subject that a segment of the document is about.

    ``share`` is the part of the sentences and code lines bearing on any subject that are about this one, ``posterior``
    the calibrated probability that the document has the subject, independent of other subjects. Null and blank texts
    and documents that bear on no subject give no rows; without labels no document does. Labels of unknown subjects or
    documents are ignored, repeated labels count once. A column ``lang`` of ``docs``, where there is one, teaches which
    words are of which language; it may be wrong for some documents.
    """
    order = names(subjects)
    k = len(order)
    if not k:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("subject"), F.lit(0.0).alias("share"), F.lit(0.0).alias("posterior")).limit(0)
    labelled = sample(labels, order)
    path = fresh_path(docs.sparkSession)
    features = featurized(docs, path)
    judged = durable(judge(features, *fit(features, labelled, k), k))
    remove(docs.sparkSession, path)
    curve = calibrate(judged, labelled, k)
    share = F.col("about") / F.col("bearing")
    held = F.least(F.greatest(share, F.lit(0.005)), F.lit(0.995))
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("subject_no") + 1)
    posterior = 1 / (1 + F.exp(-(pick([a for a, _ in curve]) * F.log(held / (1 - held)) + pick([b for _, b in curve]))))
    subject = F.element_at(F.array(*[F.lit(x) for x in order]), F.col("subject_no") + 1)
    return judged.select("doc_id", subject.alias("subject"), share.alias("share"), F.round(posterior, 6).alias("posterior"))
