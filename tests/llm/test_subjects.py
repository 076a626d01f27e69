import random

import numpy as np
import pyarrow as pa

from graphloom.llm.subjects import Batch, _featurize, featurized, languages, segmented, subjects_of
from graphloom.session import fresh_path

TERMS = {"sea": ["harbour pilot", "anchor chain", "tide table", "cargo hold"], "law": ["court ruling", "legal brief", "appeal notice", "jury panel"], "sky": ["flight level", "tail wind", "cabin crew", "radar echo"]}
PLAIN = ["work area", "key field", "call tree", "print exit", "load module", "open section"]


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    docs, truth = [], {}
    for k in range(n):
        about = rng.sample(list(TERMS), rng.choice([0, 1, 1, 1, 2]))
        lines, count = [], {}
        for _ in range(12):
            if about and rng.random() < 0.7:
                s = rng.choice(about)
                count[s] = count.get(s, 0) + 1
                t = rng.choice(TERMS[s])
                lines.append(f"MOVE WS-{t.upper().replace(' ', '-')}-NO TO X1" if rng.random() < 0.3 else f"The {t} is old near the {rng.choice(TERMS[s])}.")
            else:
                lines.append(f"The {rng.choice(PLAIN)} counts the {rng.choice(PLAIN)}.")
        docs.append((k, "\n".join(lines)))
        truth[k] = {s for s, c in count.items() if c >= 0.25 * sum(count.values())}
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus()
    rng = random.Random(2)
    labels = [(k, s) for k in range(0, 60) for s in truth[k]] + [(1, "sea"), (777, "law"), (None, "law"), (5, None), (6, "unheard")]
    rows = [(*d, "x", 0.5) for d in docs] + [(900, None, "x", 0.5), (901, "  ", "x", 0.5), (None, "tide table", "x", 0.5), (902, "court ruling. " * 20_000, "x", 0.5)]
    rng.shuffle(rows)
    out = subjects_of(
        spark.createDataFrame(rows, "doc_id long, text string, subject string, share double"), spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([(s, "") for s in TERMS], "subject string, description string")
    ).collect()
    got = {(r.doc_id, r.subject) for r in out if r.share >= 0.25}
    held = {(k, s) for k in range(60, len(docs)) for s in truth[k]}
    found = {x for x in got if 60 <= x[0] < 900}
    hits = len(held & found)
    assert hits / len(held) > 0.9 and hits / len(found) > 0.9
    assert (902, "law") in got and not any(x[0] in (900, 901, None) for x in got)
    assert all(0 <= r.posterior <= 1 for r in out)


def test_no_labels_no_documents_no_subjects(spark):
    docs = spark.createDataFrame(corpus(20)[0], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    names = spark.createDataFrame([(s,) for s in TERMS], "subject string")
    assert subjects_of(docs, none, names).count() == 0
    assert subjects_of(docs.limit(0), none, names).count() == 0
    assert subjects_of(docs, none, names.limit(0)).count() == 0


def test_segments():
    def segments(*texts):
        words, segment, document = segmented(pa.array(texts, pa.string()))
        out = {}
        for w, at in zip(words.to_pylist(), segment.tolist()):
            out.setdefault((int(document[at]), at), []).append(w)
        return [(d, ws) for (d, _), ws in out.items()]

    assert segments("A b1. Cd-EF gH\nx", None, " ", "Ｆull (so!) now") == [(0, ["a"]), (0, ["cd", "ef", "g", "h"]), (0, ["x"]), (3, ["full", "so"]), (3, ["now"])]


def test_features_come_back_by_segment():
    texts = pa.array([None, "a b. a a", "", "c\nd e f"], pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4], pa.int64()), pa.array(["", "en", "", ""]), texts], ["doc_id", "lang", "text"])
    out = next(_featurize(iter([batch])))
    got = Batch.read(out.column(2), out.column(3))
    assert got.of.tolist() == [1, 1, 3, 3] and np.bincount(got.at).tolist() == [3, 2, 1, 5]
    assert got.summed(np.ones((1, 1)), np.zeros(len(got.slots), int))[:, 0].tolist() == [3, 2, 1, 5]


def test_a_language_is_learned_from_what_is_said(spark):
    de, en = ["der Satz und das Wort ist hier", "die Zeile wird nicht mit gelesen"], ["the word and the line is here", "a record is not read with it"]
    rows = [(n, (de if n % 4 == 0 else en)[n % 3 % 2], "xx" if n == 7 else ("DE-at", "en", " EN ", "en")[n % 4]) for n in range(300)]
    path = fresh_path(spark)
    features = featurized(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path)
    spoken = languages(features)
    assert spoken.names == ["de", "en"]
    told = {}
    for r in features.collect():
        told.setdefault(r.doc_id % 4 == 0, set()).update(spoken.tell(Batch.read(pa.array([r.slots], pa.list_(pa.int32())), pa.array([r.ends], pa.list_(pa.int32())))).tolist())
    assert told == {True: {0}, False: {1}}


def test_posteriors_are_calibrated(spark):
    docs, truth = corpus(400, seed=3)
    labels = [(k, s) for k in range(0, 120) for s in truth[k]]
    out = subjects_of(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([(s,) for s in TERMS], "subject string")).collect()
    held = [(r.posterior, r.subject in truth[r.doc_id]) for r in out if r.doc_id >= 120]
    for part in (held, [x for x in held if x[0] >= 0.7]):
        assert len(part) > 100 and abs(sum(p for p, _ in part) / len(part) - sum(y for _, y in part) / len(part)) < 0.05
