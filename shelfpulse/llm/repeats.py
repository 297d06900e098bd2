"""Repeated substrings: every byte covered by a ``LENGTH``-byte string that starts anywhere
else too (in another document or the same one) is removed.

Suffixes are not all sorted.  They are sampled where the text itself says so, the sampled
suffixes are told apart first, and the other start places follow from them (induced from
their sample, as S* suffixes induce the others):

1. Sample.  A start place p stands for the string p .. p+LENGTH.  Among the K-byte words
   that begin inside it the one with the smallest hash (leftmost of equals) is its anchor.
   Equal strings have their anchors at equal offsets, and neighbouring start places mostly
   share one, so an anchor stands for a run of start places, and its block is the bytes
   their strings cover.  In a periodic stretch (a run of blanks, a ruled line) the same block
   follows itself; it is one row with the number of times, so rows grow with the stretches and
   not with their bytes.
2. Tell apart.  Anchors are grouped by word.  One that occurs once repeats nothing.  A group
   whose blocks are all the same repeats in full.
3. Induce.  For the remaining groups each distinct block is fetched once, with its number of
   occurrences, and the strings of its start places are compared by their offset from the
   anchor; groups of more than ``CROWD`` blocks are compared by a shuffle on the string
   instead of in one task.
4. Covered bytes are merged per document and cut out.

Only words, blocks' hashes and the contested blocks are shuffled, not every suffix, and a
string that fills a third of all documents is one block with a count.  Strings are compared
by two independent 64-bit hashes; a false match needs both to collide.  All places are of the
input, so overlaps count and nothing depends on what else is removed.

NULL texts count as empty; texts under LENGTH bytes keep everything.  Repeated rows are
documents of their own (a text that occurs in two rows repeats in both); NULL ids are kept.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfpulse.llm.common import map_batches, saved, slices, text_bytes

LENGTH = 200
K = 32                          # bytes of an anchor's word
SLICE = 1 << 19                 # bytes handled at a time (places take 24 bits)
CROWD = 5_000

_rng = np.random.default_rng(20240607)          # fixed seed: every task hashes alike
_TABLES = [_rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int):
    """Powers of the two bases and of their inverses modulo 2**64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        _POWERS.clear()
        for b in _BASES:
            pair = []
            for base in (b, pow(b, -1, 1 << 64)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                pair.append(np.multiply.accumulate(p))
            _POWERS.append(tuple(pair))
    return _POWERS


def _finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of any substring of some bytes, from running sums."""

    def __init__(self, data: np.ndarray, which: int):
        self.power, self.inverse = _powers(SLICE + 4 * LENGTH if len(data) < SLICE + 4 * LENGTH else len(data) + 1)[which]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * self.power[:len(data)], out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        return _finish((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def windows(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _finish((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def runs(data: np.ndarray, edges: np.ndarray):
    """Runs of start places with one anchor in joined texts.

    ``edges``: where each text starts, and the end.  Returns (text, first place, places,
    word hash, block hash, anchor's offset from the first place, times): a block that follows
    itself directly ``times`` times is one run."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return None
    first = Hashes(data, 0)
    word = first.windows(K)
    key = (word & ~np.uint64(0xFFFFFF)) | np.arange(len(word), dtype=np.uint64)
    span, low = LENGTH - K + 1, key
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width:span - width + n])
    anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[:n]
    inside = np.arange(n) + LENGTH <= edges[text + 1]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new & inside)
    if not len(start):
        return None
    stop_at = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside)
    places = stop_at - start + 1
    at = anchor[start]
    end = start + places - 1 + LENGTH
    second = Hashes(data, 1)
    block = first.of(start, end) ^ second.of(start, end) * np.uint64(3) + (at - start).astype(np.uint64)
    text, word, shift = text[start], word[at], at - start
    again = np.zeros(len(start), bool)
    again[1:] = ((block[1:] == block[:-1]) & (word[1:] == word[:-1]) & (places[1:] == places[:-1])
                 & (text[1:] == text[:-1]) & (start[1:] == start[:-1] + places[:-1]))
    head = np.flatnonzero(~again)
    times = np.diff(np.append(head, len(start)))
    return (text[head], start[head] - edges[text[head]], places[head], word[head], block[head], shift[head], times)


RUNS = "doc_id long, text_key long, start long, places int, word long, block long, shift int, times int"


def _joined(texts: list[bytes]):
    edges = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return np.frombuffer(b"".join(texts), np.uint8), edges


def anchors(docs: DataFrame) -> DataFrame:
    """One row per run of start places of every document."""
    def run(it):
        for batch in slices(it):
            ids, keys = batch.column(0), batch.column(1)
            texts = batch.column(2).to_pylist()
            queue, size = [], 0

            def emit():
                data, edges = _joined([q[2] for q in queue])
                got = runs(data, edges)
                if got is None:
                    return
                text, start, places, word, block, shift, times = got
                row = np.array([q[0] for q in queue])[text]
                off = np.array([q[1] for q in queue])[text]
                for a in range(0, len(row), 100_000):
                    s = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row[s])), keys.take(pa.array(row[s])), pa.array(start[s] + off[s]),
                         pa.array(places[s].astype(np.int32)), pa.array(word[s].view(np.int64)),
                         pa.array(block[s].view(np.int64)), pa.array(shift[s].astype(np.int32)),
                         pa.array(times[s].astype(np.int32))],
                        ["doc_id", "text_key", "start", "places", "word", "block", "shift", "times"])
            for i, t in enumerate(texts):
                if len(t) < LENGTH:
                    continue
                for a in range(0, len(t) - LENGTH + 1, SLICE - LENGTH):      # long texts: slices share LENGTH - 1 bytes
                    part = t[a:a + SLICE - 1]
                    if size + len(part) > SLICE and queue:
                        yield from emit()
                        queue, size = [], 0
                    queue.append((i, a, part))
                    size += len(part)
            if queue:
                yield from emit()
    return _keyed(docs).mapInArrow(run, RUNS)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_key"), "text")


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (
        F.col(f"{left}.text_key") == F.col(f"{right}.text_key"))


def _strings(rows: pa.Table | pa.RecordBatch):
    """(row, place, hash, second hash) of every start place of contested blocks."""
    texts = rows.column("bytes").to_pylist()
    data, edges = _joined(texts)
    places = rows.column("places").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(texts)), places)
    place = np.arange(len(row)) - np.repeat(np.cumsum(places) - places, places)
    at = edges[:-1][row] + place
    return row, place, Hashes(data, 0).of(at, at + LENGTH), Hashes(data, 1).of(at, at + LENGTH)


def _intervals(row: np.ndarray, place: np.ndarray):
    """Runs of consecutive places per row: (row, first, last + 1)."""
    if not len(row):
        return row, place, place
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], place[first], place[last] + 1


def contested(docs: DataFrame, marked: DataFrame, groups: DataFrame) -> DataFrame:
    """(word, block, from, to): which start places of contested blocks repeat."""
    blocks = marked.filter("d > 1").groupBy("word", "block").agg(
        F.sum("times").alias("m"), F.min(F.struct("text_key", "doc_id", "start", "places", "shift")).alias("r"))
    wanted = (blocks.select("word", "block", "m", "r.*").groupBy("doc_id", "text_key")
              .agg(F.collect_set(F.struct("word", "block", "m", "start", "places", "shift")).alias("cut")))

    def fetch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(c["word"], c["block"], c["m"], c["places"], c["shift"], t[c["start"]:c["start"] + c["places"] - 1 + LENGTH])
                for t, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for c in cuts]
        cols = list(zip(*rows)) if rows else [()] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          ["word", "block", "m", "places", "shift", "bytes"])
    once = _keyed(docs).alias("d").join(wanted.alias("w"), _same("d", "w"))
    # repeated rows fetch the same blocks: one of each is enough
    fetched = map_batches(once.select("text", "cut"), fetch,
                          "word long, block long, m long, places int, shift int, bytes binary")
    fetched = saved(fetched.dropDuplicates(["word", "block"]).join(groups.filter("d > 1").select("word", "d"), "word"),
                    "contested")

    def compare(it):
        """All blocks of a word are in one task; many words are compared at once."""
        batches = [b for b in it if b.num_rows]
        if not batches:
            return
        whole = pa.Table.from_batches(batches)
        word = whole.column("word").to_numpy()
        order = np.argsort(word, kind="stable")
        cuts = np.flatnonzero(np.r_[True, word[order][1:] != word[order][:-1]])
        chunk = [0]
        for c in cuts[1:].tolist():             # cut between words, about CROWD blocks at a time
            if c - chunk[-1] >= CROWD:
                chunk.append(c)
        for a, b in zip(chunk, [*chunk[1:], len(order)]):
            rows = whole.take(pa.array(order[a:b]))
            row, place, h, g = _strings(rows)
            word_of = rows.column("word").to_numpy().view(np.uint64)
            offset = (place - rows.column("shift").to_numpy()[row]).astype(np.uint64)
            many = rows.column("m").to_numpy()[row] > 1
            tag = _finish(h + g * np.uint64(5) + word_of[row] * np.uint64(7) + offset)
            _, back, n = np.unique(tag, return_inverse=True, return_counts=True)
            hit = (n[back] > 1) | many
            r, first, stop = _intervals(row[hit], place[hit])
            yield pa.RecordBatch.from_arrays(
                [rows.column("word").combine_chunks().take(pa.array(r)), rows.column("block").combine_chunks().take(pa.array(r)),
                 pa.array(first.astype(np.int32)), pa.array(stop.astype(np.int32))], ["word", "block", "from", "to"])
    cols = ["word", "block", "m", "places", "shift", "bytes"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = "word long, block long, from int, to int"
    small = fetched.filter(F.col("d") <= CROWD).repartition(n, "word").select(*cols).mapInArrow(compare, found)
    crowded = fetched.filter(F.col("d") > CROWD)
    if crowded.isEmpty():
        return small

    def strings(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, place, h, g = _strings(batch)
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take),
             pa.array(place.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))],
            ["word", "block", "m", "place", "h", "g"])
    every = saved(map_batches(crowded.select(*cols), strings,
                              "word long, block long, m long, place int, h long, g long"), "strings")
    twice = every.groupBy("word", "h", "g").agg(F.sum("m").alias("n")).filter("n > 1").select("word", "h", "g")
    return small.union(every.join(twice, ["word", "h", "g"], "left_semi")
                       .select("word", "block", F.col("place").alias("from"), (F.col("place") + 1).alias("to")))


def repeated_places(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans): the removed byte ranges [start, end) of documents that have any,
    sorted; ranges may touch or overlap."""
    made = saved(anchors(docs), "anchors")
    blocks = made.groupBy("word", "block").agg(F.sum("times").alias("m"))
    groups = saved(blocks.groupBy("word").agg(F.count("*").alias("d"), F.sum("m").alias("n")).filter("n > 1"), "groups")
    marked = saved(made.join(groups.select("word", "d"), "word"), "marked")
    whole = marked.filter("d = 1").select(
        "doc_id", "text_key", F.struct(
            F.col("start"), (F.col("start") + F.col("places") * F.col("times") - 1 + LENGTH).alias("end")).alias("s"))
    # a block that follows itself repeats in full: its range is 0 .. places, and so is the whole run's
    last = F.col("start") + F.col("places") * (F.col("times") - 1)
    some = (marked.filter("d > 1").join(contested(docs, marked, groups), ["word", "block"])
            .select("doc_id", "text_key", F.struct((F.col("start") + F.col("from")).alias("start"),
                                                   (last + F.col("to") - 1 + LENGTH).alias("end")).alias("s")))
    return whole.union(some).groupBy("doc_id", "text_key").agg(F.collect_set("s").alias("spans"))


def cut(text: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the number of maximal removed runs."""
    if not spans:
        return text, 0, 0
    parts, at, removed, n, end = [], 0, 0, 0, -1
    for s in sorted((s["start"], s["end"]) for s in spans):
        if s[0] > end:
            parts.append(text[at:s[0]])
            n += 1
            removed += s[1] - s[0]
            end = at = s[1]
        elif s[1] > end:
            removed += s[1] - end
            end = at = s[1]
    parts.append(text[at:])
    return b"".join(parts), removed, n


def without_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining
    bytes) for every row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(5)]
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            kept, removed, n = cut(text, spans)
            for c, v in zip(cols, (len(text), removed, n, hashlib.sha256(kept).hexdigest(), kept if texts else None)):
                c.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
                                          ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    spans = saved(repeated_places(docs), "spans")
    joined = _keyed(docs).alias("d").join(spans.alias("s"), _same("d", "s"), "left")
    return map_batches(joined.select("d.doc_id", "d.text", "s.spans"), run,
                       "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
