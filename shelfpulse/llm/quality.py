"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates, scored as sparse dot products.

Features.  Words are what lies between ASCII white space.  Each word gives its lower-case
form and its shape (runs of capitals, small letters, digits, other signs kept as they are,
and whether it repeats the word before).  Unigrams and bigrams of both are hashed into
2**BITS places; a feature's value is its share of the document's n-grams of its kind, so
length does not count.  A word's hashes are computed once and kept in a bounded table.

Training.  At most ``max_rows`` labelled rows (a documented bound; the smallest hashes of
doc_id, so the choice is the same on every run) are dealt to ``SHARDS`` tasks by hash.
Each runs FTRL-proximal over its rows, ``EPOCHS`` times in a fixed order, and returns its
weights; the model is their mean.  The driver sees SHARDS x 2**BITS numbers at most.

NULL text counts as empty; an empty text gets the intercept's probability.  Several
labels for one doc_id: the mean, from 0.5 up counts as 1; NULL labels and ids are no
training rows.  Without any training row every score is 0.5.  Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfpulse.llm.common import WordValues, fold, hash64, map_batches, mix, text_bytes, values_of

BITS = 18
SHARDS = 8
EPOCHS = 4
SCALE = 4.0                                     # value of a feature with share 1
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5       # FTRL-proximal step size and penalties

_RUNS = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0")]


def _word_hashes(word: bytes) -> int:
    """Hash of the lower-case word (upper 32 bits) and of its shape (lower 32 bits)."""
    shape = word                     # the whole word, run by run
    for pattern, sign in _RUNS:
        shape = pattern.sub(sign, shape)
    h = ((hash64(word.lower()) >> 32) << 32) | (hash64(shape) & 0xFFFFFFFF)
    return h


def features(text: bytes, cache: WordValues) -> tuple[np.ndarray, np.ndarray]:
    """Feature places and values of a text (places repeat; their values add up)."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    h = values_of(words, cache).view(np.uint64)
    word, shape = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)
    again = np.zeros(len(h), np.uint64)
    again[1:] = word[1:] == word[:-1]
    shape = shape * np.uint64(2) + again
    kinds = [mix(word, np.uint64(1)), mix(shape, np.uint64(2))]
    if len(h) > 1:
        kinds += [mix(mix(word[:-1], word[1:]), np.uint64(3)), mix(mix(shape[:-1], shape[1:]), np.uint64(4))]
    place = np.concatenate(kinds) >> np.uint64(64 - BITS)
    value = np.concatenate([np.full(len(k), SCALE / len(k)) for k in kinds])
    return place.astype(np.int64), value


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """FTRL-proximal state for 2**BITS weights and an intercept (the last place)."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (_sigmoid(float(w @ x)) - y) * x
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def _gather(place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, back = np.unique(place, return_inverse=True)
    return (np.append(at, 1 << BITS), np.append(np.bincount(back, value, len(at)) if len(at) else [], 1.0))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 12_000) -> np.ndarray:
    """Weights (2**BITS and the intercept) learnt from (doc_id, ``label``) rows."""
    spark = docs.sparkSession
    chosen = (labels.select(F.col("doc_id"), F.col(label).cast("double").alias("y")).dropna()
              .groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # bounded by max_rows, so it may be broadcast; the texts stay where they are read
    rows = (docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(chosen), "doc_id")
            .select(F.xxhash64("doc_id").alias("h"), "y", "text")
            .repartition(SHARDS, F.pmod("h", F.lit(SHARDS))))

    def run(it):
        cache, data = WordValues(_word_hashes), []
        for b in it:
            for h, y, t in zip(*(c.to_pylist() for c in b.columns)):
                at, x = _gather(*features(t, cache))
                data.append((h, y, at.astype(np.int32), x.astype(np.float32)))
        if not data:
            return
        data.sort(key=lambda r: (r[0], len(r[2])))
        model = Ftrl()
        for _ in range(EPOCHS):
            for _, y, at, x in data:
                model.learn(at, x, y)
        w = model.weights(np.arange(len(model.z))).astype(np.float32)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([w[at].tobytes()]), pa.array([at.astype(np.int32).tobytes()])],
                                         ["w", "at"])
    total, parts = np.zeros((1 << BITS) + 1), 0
    for r in rows.mapInArrow(run, "w binary, at binary").collect():       # at most SHARDS rows
        total[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["w"], np.float32)
        parts += 1
    return total / max(parts, 1)


def score(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",),
          named: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns and, under the names ``named``, the probability of label 1 and whether
    it is 0.5 or more (int)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    schema = docs.select(*keep).schema
    names = list(keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = shared.value
        cache = _CACHE.setdefault("quality", WordValues(_word_hashes))
        out = np.empty(batch.num_rows)
        for i, t in enumerate(batch.column(0).to_pylist()):
            at, x = features(t, cache)
            out[i] = float(w[at] @ x) + w[-1]
        p = _sigmoid(out)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
            [*names, *named])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return map_batches(docs.select(text_bytes().alias("__text"), *keep), run,
                       f"{ddl}, `{named[0]}` double, `{named[1]}` int")


_CACHE: dict[str, WordValues] = {}      # per Python worker


def classify(docs: DataFrame, labels: DataFrame, divisor: int | None = None, held: int = 1,
             max_rows: int = 12_000) -> DataFrame:
    """Score every document.  With ``divisor``, rows whose crc32(doc_id) modulo it is
    ``held`` are kept out of training and marked held_out."""
    known = labels if divisor is None else labels.filter(fold("doc_id", divisor) != held)
    out = score(docs, train(docs, known, max_rows=max_rows))
    held_out = F.lit(False) if divisor is None else fold("doc_id", divisor) == held
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")
