"""Toxicity: support vector machine on a subsequence string kernel, with Nystroem landmarks.

Kernel.  A word stands for its subsequences of three signs within a span of ``SPAN`` signs
(with a sign before its start and after its end), each worth ``DECAY`` per sign of its span,
scaled to the length of the word.  Words that share most subsequences are close even when
signs were inserted, left out or changed, so ``st.u.pid`` is near ``stupid``.

Sentences.  A sentence scores its best word (spelt-out words, ``l o s e r``, are read
together; words over ``WIDE`` signs by overlapping windows) and a document its best
sentence, so the unit that decides is the sentence and the length of the text does not
count.

Training, from labelled documents only and on a bounded sample (``max_rows`` per class, the
smallest hashes of doc_id; of near copies the smallest doc_id): sentences of documents labelled 0 are negative.  In documents
labelled 1 the guilty words are not known; they are found by covering the toxic documents
with words that toxic documents hold far more often than clean ones, largest cover first.  A
word is that when the lower end of the interval of its log odds (toxic against clean
documents that hold it) is over ``ODDS``, so a quoting or mislabelled clean document does not
rule it out; such words are never negative.  Negative are at most ``max_words`` of the
sample's other words, those of 20 clean documents or more first, then by smallest hash.  Landmarks are picked from
both sides by pivoted Cholesky factorisation of the kernel; the machine is linear in the
Nystroem features and learns the hinge loss.  Then the negatives that score highest join
the training set and it is trained again.  A logistic curve over the documents' scores turns
them into probabilities.

Since the kernel is linear in the subsequences, the machine is one weight per (hashed)
subsequence, and a distinct word is scored once per task and kept in a bounded table.

NULL and empty texts have no word and get the lowest score seen in training.  Several labels
of a doc_id: toxic if any says so.  Without labels of both classes every score is 0.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfpulse.llm.common import fold, hash64, map_batches, saved, text_bytes

SPAN, DECAY = 5, 0.7
WIDE = 24
ODDS, SURE = 1.0, 1.645              # least log odds, and the deviations it must hold for
SLOTS = 1 << 20                       # places for hashed subsequences
LANDMARKS = 128
STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
SPELT = re.compile(rb"(?:(?<=\s)|\A)(?:[^\s]\s){2,}[^\s](?=\s|\Z)")
EDGES = b".,;:!?\"'()[]{}*#%&$|<>/\\-_~`+=^@"
SENTENCE = re.compile(rb"[.!?\n]+")


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a text (or sentence), and spelt-out words read together."""
    words = text.lower().split()
    if SPELT.search(text):
        words += [re.sub(rb"\s", b"", m.group()).lower() for m in SPELT.finditer(text)]
    return words


def subsequences(words: list[bytes]):
    """(piece of each subsequence, its slot, its value) and the word of each piece.  A word
    over WIDE signs is several overlapping pieces."""
    pieces, owner = [], []
    for i, w in enumerate(words):
        s = w.strip(EDGES).decode("utf-8", "replace")
        if len(s) <= WIDE:
            pieces.append("^" + s + "$")
            owner.append(i)
            continue
        s = "^" + s + "$"
        for a in range(0, len(s) - WIDE // 2, WIDE // 2):
            pieces.append(s[a:a + WIDE])
            owner.append(i)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    code = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    piece = np.repeat(np.arange(len(pieces)), size)
    end = np.cumsum(size)[piece]
    at, slot, value = [], [], []
    place = np.arange(len(code))
    for a, b in STEPS:
        i = place[:len(code) - b]
        i = i[i + b < end[i]]
        h = (code[i] * np.uint64(0x9E3779B1) + code[i + a]) * np.uint64(0x85EBCA77) + code[i + b]
        h = (h ^ (h >> np.uint64(15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        at.append(piece[i])
        slot.append((h >> np.uint64(44)).astype(np.int64))
        value.append(np.full(len(i), DECAY ** (b + 1)))
    at, slot, value = np.concatenate(at), np.concatenate(slot), np.concatenate(value)
    norm = np.sqrt(np.maximum(np.bincount(at, value * value, len(pieces)), 1e-12))
    return at, slot, value / norm[at], np.array(owner, np.int64)


def word_scores(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Score of each word: its best piece."""
    out = np.full(len(words), -1e9)
    for s in range(0, len(words), 20_000):
        part = words[s:s + 20_000]
        at, slot, value, owner = subsequences(part)
        sums = np.bincount(at, weights[slot] * value, len(owner))
        best = np.full(len(part), -1e9)
        np.maximum.at(best, owner, sums)
        out[s:s + 20_000] = best
    return out


class Scorer:
    """Scores texts with a bounded table of word scores."""

    def __init__(self, weights: np.ndarray, limit: int = 250_000):
        self.weights, self.limit, self.known = weights, limit, {}

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Best score of each text, -inf without words, and the word that has it."""
        best, word = np.full(len(texts), -np.inf), [b""] * len(texts)
        for a in range(0, len(texts), 500):
            split = [words_of(t) for t in texts[a:a + 500]]
            new = list({w for ws in split for w in ws if w not in self.known})
            if len(self.known) + len(new) > self.limit:
                self.known = {}
                new = list({w for ws in split for w in ws})
            self.known.update(zip(new, word_scores(new, self.weights).tolist() if new else []))
            for i, ws in enumerate(split):
                if ws:
                    w = max(ws, key=self.known.__getitem__)
                    best[a + i], word[a + i] = self.known[w], w
        return best, word


# --------------------------------------------------------------------------- training

def _dense(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, slot, value, owner = subsequences(words)
    return owner[at], slot, value


def _kernel(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Kernel matrix of two word lists, column by column."""
    li, ls, lv = _dense(left)
    ri, rs, rv = _dense(right)
    out = np.empty((len(left), len(right)), np.float32)
    w = np.zeros(SLOTS)
    order = np.argsort(ri, kind="stable")
    ri, rs, rv = ri[order], rs[order], rv[order]
    cut = np.searchsorted(ri, np.arange(len(right) + 1))
    for j in range(len(right)):
        s, v = rs[cut[j]:cut[j + 1]], rv[cut[j]:cut[j + 1]]
        np.add.at(w, s, v)
        out[:, j] = np.bincount(li, w[ls] * lv, len(left))
        w[s] = 0
    return out


def _landmarks(words: list[bytes], m: int) -> list[int]:
    """Pivoted Cholesky: the words that leave the least of the kernel unexplained."""
    m = min(m, len(words))
    at, slot, value = _dense(words)
    order = np.argsort(at, kind="stable")
    at, slot, value = at[order], slot[order], value[order]
    cut = np.searchsorted(at, np.arange(len(words) + 1))
    pivot = np.zeros(SLOTS)
    left = np.ones(len(words))
    rows = np.zeros((len(words), m))
    picked: list[int] = []
    for j in range(m):
        i = int(np.argmax(left))
        if left[i] < 1e-3:
            break
        own = slice(cut[i], cut[i + 1])
        np.add.at(pivot, slot[own], value[own])
        k = np.bincount(at, pivot[slot] * value, len(words))
        pivot[slot[own]] = 0
        rows[:, j] = (k - rows[:, :j] @ rows[i, :j]) / np.sqrt(left[i])
        left = np.maximum(left - rows[:, j] ** 2, 0)
        left[i] = 0
        picked.append(i)
    return picked


def _fit(good: list[bytes], bad: list[bytes], rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weights per slot and the offset of the machine that tells bad words from good."""
    words = bad + good
    y = np.r_[np.ones(len(bad)), -np.ones(len(good))]
    pick = ([bad[i] for i in _landmarks(bad, LANDMARKS // 2)]
            + [good[i] for i in _landmarks(good, LANDMARKS // 2)])
    values, vectors = np.linalg.eigh(_kernel(pick, pick).astype(float))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.c_[_kernel(words, pick) @ root, np.ones(len(words))]
    share = np.where(y > 0, 0.5 / max(len(bad), 1), 0.5 / max(len(good), 1))
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w)) * 1e-4
    for _ in range(rounds):            # squared hinge loss, balanced classes: Newton steps
        inside = y * (z @ w) < 1
        za = z[inside] * share[inside, None]
        new = np.linalg.solve(za.T @ z[inside] + ridge, za.T @ y[inside])
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    beta = root @ w[:-1]
    li, ls, lv = _dense(pick)
    weights = np.zeros(SLOTS)
    np.add.at(weights, ls, lv * beta[li])
    return weights, float(w[-1])


def _guilty(rows, toxic: int, least: int) -> list[bytes]:
    """Words that cover the toxic documents, largest cover first (of equal ones the smallest
    word), and those that are in a twentieth of them anyway."""
    holds = {bytes(r["word"]): set(r["docs"]) for r in rows}
    heap = [(-len(d), w) for w, d in holds.items()]
    heapq.heapify(heap)
    chosen, covered = [], set()
    while heap and -heap[0][0] >= least:
        n, w = heapq.heappop(heap)
        new = len(holds[w] - covered)
        if new < -n:                    # covers shrink only, so a stale one goes back
            heapq.heappush(heap, (-new, w))
            continue
        chosen.append(w)
        covered |= holds[w]
    taken = set(chosen)
    return chosen + sorted((w for w in holds if w not in taken and len(holds[w]) >= max(least, toxic / 20)),
                           key=lambda w: (-len(holds[w]), w))


def _low_odds(bad, clean, toxic: int, other: int):
    """Lower end of the interval of the log odds ratio of holding a word, toxic against clean
    documents (half a document added to each count)."""
    a, b = bad + F.lit(0.5), clean + F.lit(0.5)
    c, d = F.lit(toxic + 0.5) - bad, F.lit(other + 0.5) - clean
    return F.log(a * d / (b * c)) - SURE * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def _near_key(text: bytes) -> int:
    """Smallest hash of three words in a row: mostly equal for near copies."""
    w = text.lower().split()
    return min((hash64(b" ".join(w[i:i + 3])) for i in range(max(1, len(w) - 2))), default=0) if w else 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3_000, least: int = 3, max_words: int = 12_000):
    """(weights per slot, offset, slope and intercept of the probability curve), or None
    when a class has no document."""
    marked = (labels.select("doc_id", F.col("toxic").alias("y")).dropna()
              .groupBy("doc_id").agg(F.max("y").cast("int").alias("y")))
    # at most max_rows ids a class, so they may be broadcast
    chosen = [marked.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for y in (0, 1)]
    found = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = pa.array([_near_key(t) for t in batch.column(1).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns, keys], ["doc_id", "text", "y", "near"])
    # one document of those that are nearly the same: copies are no evidence
    near = map_batches(found.select(F.col("doc_id").cast("long"), "text", "y"), keyed,
                       "doc_id long, text binary, y int, near long")
    sample = saved(near.groupBy("near", "y").agg(F.min(F.struct("doc_id", "text")).alias("r"))
                   .select("r.doc_id", "r.text", "y"), "sentences")

    def sentences(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, t, y in zip(*(c.to_pylist() for c in batch.columns)):
            seen = {w for s in SENTENCE.split(t) for w in words_of(s)}
            rows += [(w, i, y) for w in seen]
        cols = list(zip(*rows)) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int32()))],
                                          ["word", "doc_id", "y"])
    flat = map_batches(sample.select(F.col("doc_id").cast("long"), "text", "y"), sentences,
                       "word binary, doc_id long, y int")
    table = saved(flat.groupBy("word").agg(
        F.collect_list(F.when(F.col("y") == 1, F.col("doc_id"))).alias("docs"),
        F.sum(1 - F.col("y")).alias("clean")), "words")
    toxic = sample.filter("y = 1").count()
    table = table.withColumn("low", _low_odds(F.size("docs"), F.col("clean"), toxic, sample.count() - toxic))
    suspect = F.col("low") > ODDS
    guilty = _guilty(table.filter((F.size("docs") >= least) & ((F.col("clean") == 0) | suspect)).collect(), toxic, least)
    quoted = {bytes(r["word"]) for r in table.filter((F.col("clean") > 0) & suspect).select("word").collect()}
    clean = (table.filter((F.col("clean") > 0) & ~suspect).orderBy(F.desc(F.when(F.col("clean") >= 20, 1).otherwise(0)), F.xxhash64("word"), "word")
             .limit(max_words).select("word").collect())
    clean = [bytes(r["word"]) for r in clean]
    if not guilty or not clean:
        return None
    for mining in (True, True, False):
        weights, offset = _fit(clean, guilty)
        best = _best(sample.select("y", "text"), weights, offset).orderBy("y", "best", "word").collect()      # 2 x max_rows rows at most
        if mining:      # the negative documents' highest words, counted three times each
            known = {*clean, *quoted}
            clean += sorted({bytes(r["word"]) for r in best if r["y"] == 0 and r["best"] > -0.8} - known) * 3
    y = np.array([r["y"] for r in best], float)
    x = np.array([max(r["best"], -3.0) for r in best])
    a, b = 2.0, 0.0
    design = np.c_[x, np.ones(len(x))]
    for _ in range(30):                # logistic curve by Newton steps, lightly held to (2, 0)
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        pull = np.array([0.05 * (a - 2.0), 0.05 * b])
        h = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        a, b = np.array([a, b]) - np.linalg.solve(h, design.T @ (p - y) + pull)
    return weights, offset, float(a), float(b)


def _best(rows: DataFrame, weights: np.ndarray, offset: float) -> DataFrame:
    """(y, best score, its word) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        best, word = Scorer(shared.value).texts(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(best + offset), pa.array(word, pa.binary())],
                                          ["y", "best", "word"])
    return map_batches(rows, run, "y int, best double, word binary")


_SCORERS: dict[str, Scorer] = {}      # per Python worker, the latest model only


def score(docs: DataFrame, model, cut: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (score >= cut) for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    weights, offset, a, b = model
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    key = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        best, _ = _SCORERS[key].texts(batch.column(1).to_pylist())
        p = 1 / (1 + np.exp(-np.clip(a * np.maximum(best + offset, -3.0) + b, -35, 35)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= cut).astype(np.int32))],
                                          ["doc_id", "score", "predicted"])
    return map_batches(rows, run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, divisor: int | None = None, held: int = 2) -> DataFrame:
    """Score every document; with ``divisor``, rows whose crc32(doc_id) modulo it is
    ``held`` are kept out of training and marked held_out."""
    known = labels if divisor is None else labels.filter(fold("doc_id", divisor) != held)
    out = score(docs, train(docs, known))
    held_out = F.lit(False) if divisor is None else fold("doc_id", divisor) == held
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")
