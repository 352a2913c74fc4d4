"""Scores of whole documents under a gated recurrent language model and a smoothed unigram base.

1. Words of all training documents are counted (Spark aggregation; the table grows with the corpus).
2. The ``HEAD`` commonest words get classes of about equal share and a softmax of their own; all other words fall
   into ``TAIL`` classes by their letters, in which a word has probability (c + 1) / (N_k + V_k + 1). The ``KNOWN``
   commonest words' counts are sent to the tasks, a constant number.
3. The recurrent weights are learned in ``ROUNDS``: in each, every task trains on its documents from the same
   parameters, and the results are averaged by tokens, first in Spark, then over at most the square root of the
   tasks' number. A round takes one in ``ROUNDS`` of the training documents, another part each time, so that each
   of them teaches once; class sizes, biases and the tail are counted over all of them, too.
4. One pass scores every whole document. Words beyond the known ones leave as pairs with the document's row and are
   joined with the counts; all they need from the join is the sum of log10(c + 1).

Null and empty texts have one token, their end. Rows without id are training rows and not held out. Repeated rows
repeat their scores. Without training documents N and V are 0 and every probability of the base is 1. Extra
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.columns import pieces, saved, texts
from newsloom.llm.gru import Gru
from newsloom.llm.labelled import held_out

HEAD, HEAD_CLASSES, TAIL, KNOWN = 1_500, 32, 32, 200_000
ROUNDS = 3
FOLDS, HELD = 7, 2
#: The end of a text, which no word can be.
END = b""
#: Distinct words that a task counts, and tokens that it scores, before it passes them on.
COUNTED, SCORED = 200_000, 1_200_000


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def tail_class(word: bytes) -> int:
    """One of ``TAIL`` classes by the first letter beyond ASCII and the last two bytes."""
    bare = word.rstrip(b".,;:!?")
    wide = next((b for b in bare if b > 0xC3 or 0x80 <= b < 0xC3), None)
    return (0 if wide is None else 1 + wide % 3) * (TAIL // 4) + zlib.crc32(bare[-2:]) % (TAIL // 4)


def count_words(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    for batch in found:
        for piece in pieces(batch):
            for text in texts(piece):
                counts.update(tokens(text))
            if len(counts) > COUNTED:
                yield out()
                counts.clear()
    if counts:
        yield out()


def class_words(found: Iterator[pa.RecordBatch], head: frozenset) -> Iterator[pa.RecordBatch]:
    sums, kinds = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
    for batch in found:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if word not in head:
                k = tail_class(word)
                sums[k] += n
                kinds[k] += 1
    yield pa.RecordBatch.from_pydict({"k": pa.array(range(TAIL), pa.int32()), "n": pa.array(sums), "v": pa.array(kinds)})


class Lexicon:
    """What a task knows of words: counts, ids, classes."""

    def __init__(self, rows: list, tail_n: np.ndarray, tail_v: np.ndarray, total: int, kinds: int):
        head = rows[:HEAD]
        self.total, self.kinds, self.tail_n, self.tail_v = total, kinds, tail_n, tail_v
        share, self.bounds = np.cumsum([sqrt(r.n) for r in head]), [0]
        for k in range(1, HEAD_CLASSES):
            at = int(np.searchsorted(share, share[-1] * k / HEAD_CLASSES, "right")) if len(head) else 0
            if at > self.bounds[-1]:
                self.bounds.append(at)
        if len(head) > self.bounds[-1]:
            self.bounds.append(len(head))
        self.headed = len(self.bounds) - 1
        self.words = len(head)
        self.head_counts = np.array([r.n for r in head], float)
        word_class = np.repeat(np.arange(self.headed), np.diff(self.bounds)) if self.words else np.empty(0, np.int64)
        self.class_counts = np.concatenate([np.bincount(word_class, self.head_counts, self.headed) if self.words else [], tail_n])
        # per word: input id, class, word in the head or -1, log10(c + 1), log10 of the probability in a tail class
        within = np.log10(tail_n + tail_v + 1)
        self.entries: dict[bytes, int] = {bytes(r.word): i for i, r in enumerate(rows)}
        tail = np.array([tail_class(bytes(r.word)) for r in rows[HEAD:]], np.int64)
        n = len(rows) - self.words
        self.input = np.concatenate([np.arange(self.words), self.words + tail]).astype(np.int32)
        self.cls = np.concatenate([word_class, self.headed + tail]).astype(np.int32)
        self.word = np.concatenate([np.arange(self.words), np.full(n, -1)]).astype(np.int32)
        self.log_count = np.log10(np.array([r.n for r in rows], float) + 1)
        self.rest = np.concatenate([np.zeros(self.words), self.log_count[self.words :] - within[tail]])
        self.within = within

    def model(self) -> Gru:
        return Gru(self.bounds, self.headed + TAIL)


def numbered(lexicon: Lexicon, words: list[bytes]) -> tuple:
    """Input ids, classes, head words; sums of log10(c + 1) and of what the classes leave open; unknown words."""
    known = np.fromiter(map(lexicon.entries.get, words, repeat(-1)), np.int64, len(words))
    if len(lexicon.input):
        x, c, w, logs, rest = (v[known] for v in (lexicon.input, lexicon.cls, lexicon.word, lexicon.log_count, lexicon.rest))
    else:
        x, c, w = (np.zeros(len(words), np.int32) for _ in range(3))
        logs, rest = np.zeros(len(words)), np.zeros(len(words))
    new = np.flatnonzero(known < 0)
    if len(new):
        tail = np.array([tail_class(words[i]) for i in new])
        x[new], c[new], w[new] = lexicon.words + tail, lexicon.headed + tail, -1
        logs[new], rest[new] = 0, -lexicon.within[tail]
    return x, c, w, logs.sum(), rest.sum(), [words[i] for i in new]


def train_part(found: Iterator[pa.RecordBatch], lexicon: Lexicon, vector: np.ndarray) -> Iterator[pa.RecordBatch]:
    model = lexicon.model()
    model.set(vector.copy())
    seen = 0

    def learn(docs: list) -> int:
        if not docs:
            return 0
        fresh = np.zeros(sum(len(d[0]) for d in docs), bool)
        fresh[np.cumsum([0] + [len(d[0]) for d in docs[:-1]])] = True
        model.train(*(np.concatenate([d[i] for d in docs]) for i in range(3)), fresh)
        return len(fresh)

    docs, size = [], 0
    for batch in found:
        for piece in pieces(batch):
            for text in texts(piece):
                docs.append(numbered(lexicon, tokens(text))[:3])
                size += len(docs[-1][0])
                if size > SCORED:
                    seen += learn(docs)
                    docs, size = [], 0
    seen += learn(docs)
    if seen:
        yield pa.RecordBatch.from_pydict({"seen": pa.array([float(seen)]), "vector": pa.array([model.vector.tobytes()], pa.binary())})


def average(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = None, 0.0
    for batch in found:
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(raw, np.float32).astype(np.float64) * n
            total, seen = part if total is None else total + part, seen + n
    if total is not None:
        yield pa.RecordBatch.from_pydict({"seen": pa.array([seen]), "vector": pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary())})


def learned(rows: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """The model's parameters after all rounds; ``rows`` has ``text`` and ``draw``, the round, of the training documents."""
    model = lexicon.model()
    model.begin(lexicon.class_counts, lexicon.head_counts)
    vector = model.vector
    slots = ceil(sqrt(max(rows.sparkSession.sparkContext.defaultParallelism, 1)))
    schema = "seen double, vector binary"
    for r in range(ROUNDS):
        parts = rows.where(F.col("draw") == r).select("text").mapInArrow(lambda found, v=vector: train_part(found, lexicon, v), schema)
        means = parts.repartition(slots).mapInArrow(average, schema).collect()
        if means:
            seen = sum(m.seen for m in means)
            vector = (sum(np.frombuffer(m.vector, np.float32).astype(np.float64) * m.seen for m in means) / seen).astype(np.float32)
    return vector


SCORES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, unknown array<binary>"


def score_part(found: Iterator[pa.RecordBatch], lexicon: Lexicon, vector: np.ndarray) -> Iterator[pa.RecordBatch]:
    model = lexicon.model()
    model.set(vector)
    base = np.log10(lexicon.total + lexicon.kinds + 1)
    task, number = TaskContext.get().partitionId() << 40, 0
    docs, facts, size = [], [], 0

    def out() -> pa.RecordBatch:
        likely = model.score(docs) / np.log(10)
        ids, held, n, known, logs, rest, unknown = zip(*facts)
        return pa.RecordBatch.from_pydict(
            {
                "row": pa.array([task + number - len(facts) + i for i in range(len(facts))], pa.int64()),
                "doc_id": pa.array(ids, pa.int64()),
                "held_out": pa.array(held, pa.bool_()),
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "base": pa.array([b - k * base for b, k in zip(logs, n)]),
                "score": pa.array(np.array(rest) + likely),
                "unknown": pa.array(unknown, pa.list_(pa.binary())),
            }
        )

    for batch in found:
        for piece in pieces(batch):
            for text, doc_id, held in zip(texts(piece), piece.column(1).to_pylist(), piece.column(2).to_pylist()):
                words = tokens(text)
                x, c, w, logs, rest, unknown = numbered(lexicon, words)
                docs.append((x, c, w))
                facts.append((doc_id, held, len(words), len(words) - len(unknown), logs, rest, unknown))
                number += 1
                size += len(words)
                if size > SCORED:
                    yield out()
                    docs.clear()
                    facts.clear()
                    size = 0
    if facts:
        yield out()


def commonest(counts: DataFrame, most: int) -> list:
    """At most ``most`` words, all those above a count, commonest first. Only they and a short histogram leave the tasks."""
    level = F.floor(F.log2("n") * 16).cast("int")
    left, least = most, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if r["count"] > left:
            break
        left, least = left - r["count"], r.level
    if least is None:
        return []
    return sorted(counts.where(level >= least).collect(), key=lambda r: (-r.n, bytes(r.word)))


def lexicon_of(counts: DataFrame) -> Lexicon:
    top = commonest(counts, KNOWN)
    head = frozenset(bytes(r.word) for r in top[:HEAD])
    classed = counts.mapInArrow(lambda found: class_words(found, head), "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(TAIL), np.zeros(TAIL)
    for r in classed:
        n[r.k], v[r.k] = r.n, r.v
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return Lexicon(top, n, v, total, kinds)


def scores(docs: DataFrame) -> DataFrame:
    """Held-out mark, tokens, known tokens, training tokens, base score and model score of every document."""
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), held_out(FOLDS, HELD).alias("held_out"))
    taught = rows.where("not held_out")
    counts = saved(taught.select("text").mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    lexicon = lexicon_of(counts)
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(ROUNDS)).alias("draw")
    vector = learned(taught.select("text", draw), lexicon)
    passed = saved(rows.mapInArrow(lambda found: score_part(found, lexicon, vector), SCORES))
    rare = passed.select("row", F.explode("unknown").alias("word")).join(counts, "word")
    added = rare.groupBy("row").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("n") + 1.0)).alias("logs"))
    final = passed.drop("unknown").join(added, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return final.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
