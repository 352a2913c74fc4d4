"""Toxicity of documents: a support vector machine on gapped subsequences of words and spelled-out words.

Strings are compared by the gap-weighted subsequence kernel: every choice of ``LENGTH`` letters in order counts
``DECAY`` to the power of the stretch it spans, up to ``LENGTH + GAP`` letters, so "i-d-i-o-t" and "idiiot" share most
of their subsequences with "idiot". Strings have a mark at both ends, and the kernel is normalised. Its features are
hashed into ``DIMENSIONS``, which makes a kernel value a dot product.

Landmarks are training strings. The Nyström features of a string are its kernel values with the landmarks
times the inverse root of the landmarks' own matrix; a linear machine is trained on these by Newton steps on
the squared hinge loss. As all of that is linear in the hashed features, the trained machine is folded back into one
weight for each of them, and scoring a string is a sum over its subsequences.

Units are the words of a sentence (lower-cased, ASCII punctuation trimmed at the ends), and runs of single letters
joined. Labels belong to documents: a document is as toxic as its most toxic unit. Training takes all units
of at most ``TRAIN_DOCS`` labelled documents of each class, counted by Spark: negatives are units of documents without
the label, and in further ``ROUNDS`` those of them that the machine takes for toxic; positives are the
strongest units of toxic documents, if they are in these far more often than accident explains (``EVIDENCE``, a bound
on the logarithm, for the documents taken). A logistic curve on documents, each weighted to the number of labels of its
class, turns the greatest unit into a score.

Null and empty texts have no unit and get the score of the least margin. Without labels of both classes every
score is the share of label 1, or 0.5 without labels. Repeated rows repeat their score, an empty table gives an empty
one, extra columns are ignored.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.columns import batches, texts
from newsloom.llm.labelled import held_out, label_sample

LENGTH, GAP, DECAY, DIMENSIONS = 3, 2, 0.7, 1 << 15
#: Letters of a unit that its subsequences start from; longer units (links, keys) are taken in overlapping parts.
PART = 40
TRAIN_DOCS, UNITS, LANDMARKS = 4_000, 12_000, 400
ROUNDS, STEPS, PENALTY = 3, 30, 1e-5
EVIDENCE = 14.0
FOLDS, HELD = 4, 2
CUT = 0.3
#: Distinct units that a worker remembers before it starts anew.
REMEMBERED = 400_000
TRIM = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPELLED = re.compile(rb"(?:(?<=[\x20\x09-\x0D])|^)(?:[^\x20\x09-\x0D][\x20\x09-\x0D]+){2,}[^\x20\x09-\x0D](?=[\x20\x09-\x0D]|$)")
OFFSETS = [(0, *rest) for rest in combinations(range(1, LENGTH + GAP), LENGTH - 1)]


def units(text: bytes) -> list[bytes]:
    """The units of a text, repeats included."""
    text = text.lower()
    found = [w.strip(TRIM) for w in text.split()]
    found += [b"".join(m.split()) for m in SPELLED.findall(text)]
    return [w for w in found if w]


def features(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of many strings: number of the string, feature, value; each string has norm 1."""
    letters = [np.frombuffer(f"\x02{w.decode(errors='replace')}\x03".encode("utf-32-le"), np.uint32) for w in found]
    sizes = np.array([len(x) for x in letters])
    codes = np.concatenate(letters).astype(np.uint64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(found)), sizes)
    place = np.arange(len(codes))
    rows, columns, values = [], [], []
    for offsets in OFFSETS:
        at = place[place + offsets[-1] < ends]
        mixed = np.zeros(len(at), np.uint64)
        for o in offsets:
            mixed = (mixed + codes[at + o]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        rows.append(owner[at])
        columns.append((mixed % np.uint64(DIMENSIONS)).astype(np.int64))
        values.append(np.full(len(at), DECAY ** (offsets[-1] + 1)))
    rows, columns, values = np.concatenate(rows), np.concatenate(columns), np.concatenate(values)
    key, where = np.unique(rows * DIMENSIONS + columns, return_inverse=True)
    values = np.bincount(where, values, len(key))
    rows, columns = key // DIMENSIONS, key % DIMENSIONS
    norm = np.sqrt(np.bincount(rows, values**2, len(found)))
    return rows, columns, values / norm[rows]


def dense(found: list[bytes]) -> np.ndarray:
    rows, columns, values = features(found)
    out = np.zeros((len(found), DIMENSIONS), np.float32)
    out[rows, columns] = values
    return out


class Machine:
    """The folded machine: a weight for each hashed feature, a bias, and the curve from margins to scores."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift
        self.known: dict[bytes, float] = {}

    def __reduce__(self):
        return Machine, (self.weights, self.bias, self.slope, self.shift)

    def margins(self, found: list[bytes]) -> np.ndarray:
        out = np.empty(len(found))
        for a in range(0, len(found), 20_000):
            part = found[a : a + 20_000]
            rows, columns, values = features(part)
            out[a : a + 20_000] = np.bincount(rows, values * self.weights[columns], len(part)) + self.bias
        return out

    def greatest(self, docs: list[list[bytes]]) -> np.ndarray:
        """Each document's greatest margin; new units are looked at once per worker."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for d in docs for w in d if w not in self.known})
        if new:
            self.known.update(zip(new, self.margins(new).tolist()))
        return np.array([max(map(self.known.__getitem__, d), default=-2.0) for d in docs])

    def score(self, docs: list[list[bytes]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.greatest(docs) + self.shift, -30, 30)))


def whole_units(text: bytes) -> list[bytes]:
    """Distinct units, long ones in overlapping parts."""
    out = set()
    for unit in units(text):
        if len(unit) <= PART:
            out.add(unit)
        else:
            letters = unit.decode(errors="replace")
            out.update(letters[i : i + PART].encode() for i in range(0, max(1, len(letters) - PART // 2), PART // 2))
    return list(out)


def landmarks_of(positive: list[bytes], negative: list[bytes]) -> list[bytes]:
    """Half from each class, those first in the order given, without repeats."""
    return list(dict.fromkeys(positive[: LANDMARKS // 2] + negative[: LANDMARKS - min(len(positive), LANDMARKS // 2)]))


def fold(marks: list[bytes], strings: list[bytes], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Nyström features with the landmarks, a linear machine on them, and its weights in the hashed space."""
    base = dense(marks)
    values, vectors = np.linalg.eigh(base @ base.T + 1e-6 * np.eye(len(marks), dtype=np.float32))
    keep = values > 1e-4
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = np.concatenate([dense(strings[a : a + 500]) @ base.T for a in range(0, len(strings), 500)]) @ root
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    # squared hinge loss by Newton steps over the strings inside the margin
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], PENALTY)
    ridge[-1] = 1e-9
    for _ in range(STEPS):
        inside = np.flatnonzero(y * (x @ w) < 1)
        part = x[inside] * cost[inside][:, None]
        step = np.linalg.solve(part.T @ x[inside] + np.diag(ridge), part.T @ y[inside])
        if np.abs(step - w).max() < 1e-9:
            break
        w = step
    return base.T @ (root @ w[:-1]), float(w[-1])


def count_units(batch: pa.RecordBatch) -> dict:
    out = {"unit": [], "toxic": [], "clean": []}
    for text, label in zip(texts(batch), batch.column(1).to_pylist()):
        for unit in whole_units(text):
            out["unit"].append(unit)
            out["toxic"].append(label)
            out["clean"].append(1 - label)
    return out


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    # at most 2 * TRAIN_DOCS triples of numbers
    sample = F.broadcast(label_sample(labels, "toxic", FOLDS, HELD, TRAIN_DOCS))
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id").select("text", "label", "weight")
    totals = {r.label: (r.n, r.weight) for r in taught.groupBy("label").agg(F.count("*").alias("n"), F.max("weight").alias("weight")).collect()}
    (n1, w1), (n0, w0) = totals.get(1, (0, 1.0)), totals.get(0, (0, 1.0))
    taught = taught.drop("weight")
    if not n1 or not n0:
        share = (n1 + 0.5 * (n1 + n0 == 0)) / max(1, n1 + n0)
        return Machine(np.zeros(DIMENSIONS), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    schema = "unit binary, toxic long, clean long"
    counted = taught.mapInArrow(batches(count_units, schema), schema).groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    # Chernoff's bound on the chance that so many of a unit's documents are toxic by accident; as t and c count documents
    # taken, p is their share: with the share of all labels any unit would be telling where both classes are capped
    n, p = F.col("t") + F.col("c"), n1 / (n1 + n0)
    q = F.col("t") / n
    clean_part = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    evidence = F.when(q > p, n * (q * F.log(q / p) + clean_part)).otherwise(0.0)
    telling = counted.where("t >= 2").withColumn("evidence", evidence).where(F.col("evidence") > EVIDENCE)
    known = {bytes(r.unit): r.evidence for r in telling.orderBy(F.desc("evidence"), "unit").limit(UNITS // 4).collect()}

    def witness(batch: pa.RecordBatch) -> dict:
        best = [max((u for u in whole_units(t) if u in known), key=lambda u: (known[u], u), default=None) for t in texts(batch)]
        return {"unit": [u for u in best if u is not None]}

    # copies of a toxic document make all of its units look telling; the strongest one is enough to explain it
    witnesses = taught.where("label = 1").mapInArrow(batches(witness, "unit binary"), "unit binary").groupBy("unit").count()
    positive = [bytes(r.unit) for r in witnesses.orderBy(F.desc("count"), "unit").collect()]
    common = [bytes(r.unit) for r in counted.where("c > 0").orderBy(F.desc("c"), "unit").limit(UNITS // 4).collect()]
    others = [bytes(r.unit) for r in counted.where("c > 0").orderBy(F.xxhash64("unit")).limit(UNITS).collect()]
    negative = [u for u in dict.fromkeys(common + others) if u not in set(positive)]
    machine = Machine(np.zeros(DIMENSIONS), 0.0, 1.0, 0.0)
    for _ in range(ROUNDS):
        if not positive:
            break
        strings = positive + negative
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        machine = Machine(*fold(landmarks_of(positive, others + common), strings, y), 1.0, 0.0)
        # the strongest units of clean documents are mistakes to learn from
        top = strongest(taught, machine)
        seen = set(strings)
        negative += [u for u in dict.fromkeys(u for u, m, label in top if not label and m > -0.5) if u not in seen][:UNITS]
    margins, y = np.array([m for _, m, _ in top]) if positive else np.zeros(0), np.array([label for *_, label in top]) if positive else np.zeros(0)
    machine.slope, machine.shift = curve(margins, y, np.where(y > 0, w1, w0))
    return machine


def strongest(taught: DataFrame, machine: Machine) -> list[tuple[bytes, float, int]]:
    """The strongest unit of every training document, its margin and the document's label (bounded by the sample)."""
    schema = "unit binary, margin double, label int"

    def find(batch: pa.RecordBatch) -> dict:
        docs = [whole_units(t) for t in texts(batch)]
        margins = machine.greatest(docs)
        best = [max(d, key=lambda u: (machine.known[u], u), default=b"") for d in docs]
        return {"unit": best, "margin": margins, "label": batch.column(1)}

    return sorted((bytes(r.unit), r.margin, r.label) for r in taught.mapInArrow(batches(find, schema), schema).collect())


def curve(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve on weighted rows, by Newton steps with a weak prior."""
    if not len(y):
        return 0.0, 0.0
    w, x = np.zeros(2), np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([0.05, 1e-3])
        w -= np.linalg.solve(hessian, x.T @ (weight * (p - y)) + np.array([0.05, 1e-3]) * w)
    return float(max(w[0], 0.0)), float(w[1])


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    machine = train(docs, labels)
    schema = "doc_id long, held_out boolean, score double, predicted int"

    def rate(batch: pa.RecordBatch) -> dict:
        score = machine.score([whole_units(t) for t in texts(batch)])
        return {"doc_id": batch.column(1), "held_out": batch.column(2), "score": score, "predicted": (score >= CUT).astype(np.int32)}

    return docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), held_out(FOLDS, HELD)).mapInArrow(batches(rate, schema), schema)
