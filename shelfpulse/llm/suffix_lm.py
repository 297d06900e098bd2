"""Language-model scores by a probabilistic suffix tree over words.

Tokens are lower-cased (A-Z) words and one end per text.

Symbols.  Words with at least ``P_MIN`` of all training tokens are symbols of their own (at
most 1 / P_MIN); every other word belongs to one of ``CLASSES`` classes by its last two
bytes.  A rare or unknown word costs its class symbol and its share of the class:
(c + 1) / (tokens + words + 1 of the class).

Tree.  Contexts of one to ``DEPTH`` symbols are candidates when they hold at least ``P_MIN``
of the training tokens, so a depth has at most 1 / P_MIN of them at any corpus size.  The
next-symbol counts of a candidate are gathered over all training texts; counts of at least
``Q_MIN`` of the tokens are entries.  A candidate is retained when the divergence of its
distribution from that of its suffix, N KL(P || P_suffix), pays for the entries it adds
(half a log N each); suffixes of retained contexts stay.

Smoothing.  An entry has (count - DISCOUNT) / N plus what is left of the mass times the
suffix's probability, down to the symbols' add-one unigram.  Each token is looked up in the
longest retained suffix of what precedes it (before the first token: an end).

Every context.  The shares above only bound the tree that tasks hold; they decide no score
alone.  Every run of two to ``DEPTH`` + 1 words (not symbols) is counted over the training
texts, however rare, by a shuffle on its hash.  From the shortest context to the longest,
a context with N occurrences, n of them before the token, turns the probability p found so
far (first the tree's) into (n + PRIOR p) / (N + PRIOR).  The n of a context sum to N, so
the probabilities of all words sum to one at every step.

How it runs.  Texts are read once and kept as blocks of word numbers with a dictionary per
block; dictionaries are counted by a shuffle on the word and the counts go back to their
blocks.  A depth's counts are added up in the tasks as dense arrays and shuffled in slices.
Runs of words go the dictionaries' way, one length at a time: a block sends its distinct
runs to the ranges of the hash and gets their counts back in the same order.  What the
driver holds is bounded by 1 / P_MIN and 1 / Q_MIN, not by the corpus.

NULL and empty texts have one token, the end.  Without training text every token is
unknown; the base score is then 0 and the model has one state.  NULL ids are in fold 0 and
rows are scored each on their own; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfpulse.llm.common import WordValues, fold, hash64, mix, saved, slices, text_bytes, values_of

P_MIN, Q_MIN = 2e-4, 5e-7
DEPTH = 3
CLASSES = 256
DISCOUNT = 0.75
PRIOR = 256.0                  # occurrences that the shorter context's probability is worth
BLOCK = 2_000_000              # tokens of a block
SLICE = 1 << 16                # counts in one shuffled slice
RANGE = 1_000_000              # training tokens per range of the runs' hashes
END = (hash64(b" end") & ~(CLASSES - 1)) | (CLASSES - 1)


def word_code(word: bytes) -> int:
    """Hash of a word; its lowest bits are its class."""
    return (hash64(word) & ~(CLASSES - 1)) | (xxhash.xxh64_intdigest(word[-2:], 7) % (CLASSES - 1))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``saved``, with the shuffle files of the step removed once its rows are written: no
    later step reads them, and without this they pile up until the driver's next collection."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return saved(df, name)
    finally:
        conf.set(CLEANUP, before)


# ------------------------------------------------------------------ blocks of word numbers

TOKENS = ("block long, doc_id long, held_out boolean, low binary, high binary, "
          "codes binary, counts binary")


def blocks(docs: DataFrame, held_out) -> DataFrame:
    """Rows of documents (their words as places in the block's dictionary, most frequent
    first, low and high 16 bits apart) and one dictionary row per block (codes and their
    counts in the training texts)."""
    def run(it):
        cache = WordValues(word_code)
        ids, held, parts = [], [], []
        size = 0

        def flush():
            block = uuid.uuid4().int >> 65            # random; the rows are kept once written
            codes, place, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            place = rank[place]
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            train = np.repeat(~np.array(held, bool), lengths)
            counts = np.bincount(place[train], minlength=len(codes)).astype("<i4")
            cut = np.concatenate(([0], np.cumsum(lengths))).tolist()
            low, high = (place & 0xFFFF).astype("<u2"), (place >> 16).astype("<u2")
            m = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * (m + 1), pa.int64()), pa.array([*ids, None], pa.int64()), pa.array([*held, None], pa.bool_()),
                 pa.array([*(low[a:b].tobytes() for a, b in zip(cut, cut[1:])), None], pa.binary()),
                 pa.array([*(high[a:b].tobytes() for a, b in zip(cut, cut[1:])), None], pa.binary()),
                 pa.array([*[None] * m, codes[order].astype("<i8").tobytes()], pa.binary()),
                 pa.array([*[None] * m, counts.tobytes()], pa.binary())],
                ["block", "doc_id", "held_out", "low", "high", "codes", "counts"])

        for batch in slices(it):
            for i, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.lower().split()
                codes = np.empty(len(words) + 1, np.int64)
                codes[:-1] = values_of(words, cache)
                codes[-1] = END
                ids.append(i)
                held.append(h)
                parts.append(codes)
                size += len(codes)
                if size >= BLOCK:
                    yield from flush()
                    ids, held, parts, size = [], [], [], 0
        if parts:
            yield from flush()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text_bytes().alias("text"))
    return rows.mapInArrow(run, TOKENS)


def dictionary(tokens: DataFrame) -> DataFrame:
    """(block, place, code, n) of every dictionary entry."""
    def run(it):
        for batch in it:
            for block, codes, counts in zip(*(c.to_pylist() for c in batch.columns)):
                codes, counts = np.frombuffer(codes, "<i8"), np.frombuffer(counts, "<i4")
                for a in range(0, len(codes), 100_000):
                    c = codes[a:a + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(c), block)), pa.array(np.arange(a, a + len(c), dtype=np.int32)), pa.array(c),
                         pa.array(counts[a:a + 100_000].astype(np.int64))], ["block", "place", "code", "n"])
    return (tokens.filter("codes IS NOT NULL").select("block", "codes", "counts")
            .mapInArrow(run, "block long, place int, code long, n long"))


class Symbols:
    """Frequent words and classes as symbols 0 .. size-1 (class symbols first)."""

    def __init__(self, frequent: list[int], class_tokens: np.ndarray, class_words: np.ndarray, tokens: int, words: int):
        self.frequent = np.array(sorted({*frequent, END}), np.int64)
        self.size = CLASSES + len(self.frequent)
        self.class_total = class_tokens + class_words + 1.0
        self.tokens, self.words = tokens, words
        self.end = CLASSES + int(np.searchsorted(self.frequent, END))

    def of(self, code: np.ndarray, c: np.ndarray):
        """(symbol, log10 share of its class, log10 base probability) of each word."""
        at = np.minimum(np.searchsorted(self.frequent, code), len(self.frequent) - 1)
        own = self.frequent[at] == code
        cls = code & (CLASSES - 1)
        symbol = np.where(own, CLASSES + at, cls)
        inside = np.where(own, 0.0, np.log10((c + 1) / self.class_total[cls]))
        return symbol, inside, np.log10((c + 1) / (self.tokens + self.words + 1))


SEQUENCES = "block long, held_out boolean, symbols binary, counts binary"


def _places(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u2").astype(np.uint32) | (np.frombuffer(high, "<u2").astype(np.uint32) << 16)


def sequences(tokens: DataFrame, counts: DataFrame, symbols: Symbols) -> DataFrame:
    """The symbols of every document, and per block one row with its words' training counts."""
    answers = dictionary(tokens).select("block", "place", "code").join(
        counts.select("code", F.col("n").alias("c")), "code", "left").select("block", "place", "code", "c")
    rows = tokens.filter("codes IS NULL").select("block", "doc_id", "held_out", "low", "high")

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        place = words.column("place").to_numpy()
        code, c = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        code[place] = words.column("code").to_numpy()
        c[place] = words.column("c").fill_null(0).to_numpy()
        symbol = symbols.of(code, c)[0].astype("<u2")
        out = [symbol[_places(low, high)].tobytes()
               for low, high in zip(docs.column("low").to_pylist(), docs.column("high").to_pylist())]
        m = len(out)
        return pa.table([pa.array([docs.column("block")[0].as_py()] * (m + 1), pa.int64()),
                         pa.array([*docs.column("held_out").to_pylist(), None], pa.bool_()),
                         pa.array([*out, None], pa.binary()), pa.array([*[None] * m, _planes(c)], pa.binary())],
                        names=["block", "held_out", "symbols", "counts"])
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SEQUENCES)


# ------------------------------------------------------------------------- runs of words

def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers, first all lowest bytes, then all second ones, and so on (the higher
    ones of small numbers cost nothing), packed, after how many there are."""
    planes = np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _numbers(packed: bytes) -> np.ndarray:
    planes = pa.decompress(memoryview(packed)[8:], 8 * int.from_bytes(packed[:8], "little"), "zstd")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _order(x: np.ndarray) -> np.ndarray:
    """argsort of hashes: a plain sort of their highest bits with the place below them; the
    few that agree in those bits are put right after."""
    bits = np.uint64(len(x).bit_length())
    order = np.sort((x >> bits << bits) | np.arange(len(x), dtype=np.uint64))
    order &= (np.uint64(1) << bits) - np.uint64(1)
    order = order.astype(np.int64)
    return order[np.argsort(x[order], kind="stable")]


def _new(x: np.ndarray) -> np.ndarray:
    """Where a sorted array's value differs from the one before."""
    return np.concatenate(([True], x[1:] != x[:-1]))[:len(x)]


class Block:
    """The documents of a block: word places of all tokens, and where each text begins."""

    def __init__(self, rows: pa.Table):
        docs = rows.filter(rows.column("codes").is_null())
        codes = pc.drop_null(rows.column("codes"))
        self.block = rows.column("block")[0].as_py()
        self.doc_id, self.held_out = docs.column("doc_id"), docs.column("held_out")
        self.code = np.frombuffer(codes[0].as_py(), "<i8")
        self.lengths = pc.binary_length(docs.column("low")).to_numpy().astype(np.int64) // 2
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place = _places(b"".join(docs.column("low").to_pylist()), b"".join(docs.column("high").to_pylist()))
        self.train = np.repeat(~self.held_out.to_numpy().astype(bool), self.lengths)

    def before(self, x: np.ndarray, first) -> np.ndarray:
        """The value of the token before each token, ``first`` at the texts' first ones."""
        out = np.roll(x, 1)
        out[self.starts] = first
        return out

    def runs(self):
        """Hashes (63 bits) of the runs of two, three ... words that end at each token, one
        leading end included, and whether the text has such a run there."""
        own = self.code.view(np.uint64)[self.place]
        run, has = own, np.ones(len(own), bool)
        end = np.uint64(END & 0xFFFF_FFFF_FFFF_FFFF)
        while True:
            run = mix(self.before(run, end), own)
            yield run >> np.uint64(1), has
            has = self.before(has, False)

    def counts(self, answers: dict[int, list[tuple[bytes, bytes]]], longest: int):
        """(places to ask for, their hashes, training counts, counts in all texts) of the runs
        of two and more words, as long as there are answers; without them the counts are None.
        A run that is longer than one that occurs once in all texts occurs once as well, so
        those are not asked for."""
        total = None
        for words, (run, has) in zip(range(2, longest + 1), self.runs()):
            ask = has if total is None else has & (total > 1) & (self.before(total, 0) > 1)
            at = np.flatnonzero(ask)
            run = run[at]
            if words not in answers:
                yield at, run, None, None
                return
            n, total = (has & self.train).astype(np.int64), has.astype(np.int64)
            if len(at):
                order = _order(run)
                distinct = np.cumsum(_new(run[order])) - 1
                at = at[order]
                for out, got in zip((n, total), zip(*answers[words])):
                    out[at] = np.concatenate([_numbers(b) for b in got]).astype(np.int64)[distinct]
            yield at, run, n, total


def by_words(counted: pa.Table) -> dict[int, list[tuple[bytes, bytes]]]:
    """A block's answers: per length of the runs the counts, range after range."""
    out: dict[int, list] = {}
    rows = zip(*(counted.column(k).to_pylist() for k in ("words", "part", "n", "total")))
    for words, _, n, total in sorted(rows, key=lambda r: r[:2]):
        out.setdefault(words, []).append((n, total))
    return out


ASKED = "part int, block long, runs binary, n binary, total binary"
ANSWERS = "block long, words int, part int, n binary, total binary"


def run_counts(tokens: DataFrame, answers: DataFrame, words: int, bits: int) -> DataFrame:
    """Per block and range of the hash: the counts of the block's distinct runs of so many
    words, in the order of their hashes; ``answers`` has those of the shorter runs."""
    def ask(rows: pa.Table, counted: pa.Table) -> pa.Table:
        block, known = Block(rows), by_words(counted)
        known |= {k: [] for k in range(2, words) if k not in known}      # none was asked for
        for at, run, _, _ in block.counts(known, words):
            pass
        key = np.sort(run << np.uint64(1) | block.train[at])
        run = key >> np.uint64(1)
        first = np.flatnonzero(_new(run))
        n = np.add.reduceat((key & np.uint64(1)).astype(np.int64), first) if len(first) else np.empty(0, np.int64)
        total = np.diff(first, append=len(run))
        run = run[first]
        cut = np.searchsorted(run >> np.uint64(63 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).tolist()
        here = [p for p in range(1 << bits) if cut[p] < cut[p + 1]]
        pieces = [slice(cut[p], cut[p + 1]) for p in here]
        return pa.table([pa.array(here, pa.int32()), pa.array([block.block] * len(here), pa.int64()),
                         pa.array([_planes(np.diff(run[c], prepend=np.uint64(0))) for c in pieces], pa.binary()),
                         pa.array([_planes(n[c]) for c in pieces], pa.binary()),
                         pa.array([_planes(total[c]) for c in pieces], pa.binary())],
                        names=["part", "block", "runs", "n", "total"])

    def add(rows: pa.Table) -> pa.Table:
        asked = [np.cumsum(_numbers(r), dtype=np.uint64) for r in rows.column("runs").to_pylist()]
        cut = np.cumsum([0, *map(len, asked)]).tolist()
        run = np.concatenate(asked)
        del asked
        order = np.argsort(run, kind="stable")            # merges the blocks' sorted runs
        new = _new(run[order])
        del run
        first, distinct = np.flatnonzero(new), np.cumsum(new) - 1
        out = []
        for k in ("n", "total"):
            x = np.concatenate([_numbers(b) for b in rows.column(k).to_pylist()]).astype(np.int64)
            x[order] = np.add.reduceat(x[order], first)[distinct]
            out.append(pa.array([_planes(x[a:b]) for a, b in zip(cut, cut[1:])], pa.binary()))
        return pa.table([rows.column("block"), pa.array(np.full(rows.num_rows, words, np.int32)), rows.column("part"), *out],
                        names=["block", "words", "part", "n", "total"])
    return (tokens.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, ASKED)
            .groupBy("part").applyInArrow(add, ANSWERS))


# ------------------------------------------------------------------------------- the tree

class Tree:
    """Candidate contexts by depth and the retained states' distributions.

    Depth 1 contexts are symbols.  ``next[d]`` finds depth d+1 contexts: a table from
    (depth d context, symbol before it) to a number, or -1.
    """

    def __init__(self, size: int, end: int):
        self.size, self.end = size, end
        self.next: list[np.ndarray] = []
        self.rows = [size]                              # contexts per depth
        self.log: np.ndarray | None = None              # log10 probabilities: states x symbols
        self.state: list[np.ndarray] = []               # per depth: context -> state, or -1

    def contexts(self, x: np.ndarray, first: np.ndarray, depth: int):
        """Context numbers of the given depths before each place of x; ``first`` is the
        place of the text's leading end."""
        place = np.arange(len(x))
        found = [np.where(place > first, np.roll(x, 1), -1).astype(np.int64)]
        for d in range(1, depth):
            before = np.where(place - d - 1 >= first, np.roll(x, d + 1), -1)
            ok = (found[-1] >= 0) & (before >= 0)
            out = np.full(len(x), -1, np.int64)
            out[ok] = self.next[d - 1][found[-1][ok], before[ok]]
            found.append(out)
        return found

    def log10(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each place of x (0 for leading ends)."""
        state = np.zeros(len(x), np.int64)
        for table, context in zip(self.state, self.contexts(x, first, len(self.state))):
            ok = context >= 0
            s = table[context[ok]]
            state[np.flatnonzero(ok)[s >= 0]] = s[s >= 0]
        out = self.log[state, x]
        out[np.arange(len(x)) == first] = 0.0
        return out


def _texts(symbols: list[bytes], end: int):
    """All texts' symbols with a leading end each; the place of the leading end per place."""
    parts = [np.frombuffer(s, "<u2") for s in symbols]
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    starts = np.cumsum(lengths) - lengths
    x = np.empty(int(lengths.sum()), np.int64)
    x[starts] = end
    body = np.ones(len(x), bool)
    body[starts] = False
    x[body] = np.concatenate(parts) if parts else []
    return x, np.repeat(starts, lengths), starts


def _slices(rows: list[bytes], most: int = 400_000):
    """Cut a list of symbol strings into lists of about ``most`` symbols."""
    part, size = [], 0
    for r in rows:
        part.append(r)
        size += len(r) // 2
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def depth_counts(texts: DataFrame, tree: Tree, depth: int, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(key, count) of the (context, next symbol) pairs of one depth with at least ``least``
    occurrences in the training texts; key = context * symbols + next."""
    shared = texts.sparkSession.sparkContext.broadcast(tree)
    total = tree.rows[depth - 1] * tree.size

    def count(it):
        t = shared.value
        sums = np.zeros(total, np.int32)
        for batch in slices(it):
            for part in _slices(batch.column(0).to_pylist()):
                x, first, _ = _texts(part, t.end)
                context = t.contexts(x, first, depth)[-1]
                ok = context >= 0
                sums += np.bincount(context[ok] * t.size + x[ok], minlength=total).astype(np.int32)
        for a in range(0, total, SLICE):
            piece = sums[a:a + SLICE]
            if piece.any():
                at = np.flatnonzero(piece)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a // SLICE], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()),
                     pa.array([piece[at].astype("<i4").tobytes()], pa.binary())], ["slice", "at", "n"])

    def add(table: pa.Table) -> pa.Table:
        sums = np.zeros(SLICE, np.int64)
        for at, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist()):
            sums[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<i4")
        at = np.flatnonzero(sums >= least)
        base = table.column("slice")[0].as_py() * SLICE
        return pa.table([pa.array([(at + base).astype("<i8").tobytes()]), pa.array([sums[at].astype("<i8").tobytes()])],
                        names=["key", "n"])
    got = (texts.filter("NOT held_out").select("symbols").mapInArrow(count, "slice int, at binary, n binary")
           .groupBy("slice").applyInArrow(add, "key binary, n binary").collect())      # 1 / Q_MIN entries at most
    shared.unpersist()
    key = np.concatenate([np.frombuffer(r["key"], "<i8") for r in got] or [np.empty(0, np.int64)])
    n = np.concatenate([np.frombuffer(r["n"], "<i8") for r in got] or [np.empty(0, np.int64)])
    order = np.argsort(key)
    return key[order], n[order]


def learn(texts: DataFrame, symbols: Symbols, unigram: np.ndarray, p_min: float, q_min: float, depth: int) -> Tree:
    """The tree of the training texts; ``unigram`` holds the symbols' counts."""
    tree = Tree(symbols.size, symbols.end)
    tokens = max(symbols.tokens, 1)
    k = symbols.size
    root = (unigram + 1.0) / (unigram.sum() + k)
    dist, parent_row = [root[None, :]], [np.zeros(k, np.int64)]
    totals = [unigram.astype(float)]                 # occurrences of each context
    kept: list[np.ndarray] = []
    for d in range(1, depth + 1):
        key, n = depth_counts(texts, tree, d, max(2.0, q_min * tokens))
        rows = tree.rows[d - 1]
        context, after = key // k, key % k
        direct = np.zeros((rows, k), np.float32)
        total = np.maximum(totals[d - 1], np.bincount(context, n, rows))
        safe = np.maximum(total, 1.0)
        direct[context, after] = (n - DISCOUNT) / safe[context]
        rest = 1.0 - direct.sum(axis=1, dtype=float)
        above = dist[d - 1][parent_row[d - 1]] if d > 1 else np.repeat(dist[0], rows, axis=0)
        p = direct + (rest[:, None] * above).astype(np.float32)
        seen = n / safe[context]
        gain = np.bincount(context, n * np.log(np.maximum(seen, 1e-12) / above[context, after]), rows)
        left = 1.0 - np.bincount(context, seen, rows)
        left_above = np.maximum(1.0 - np.bincount(context, above[context, after], rows), 1e-12)
        gain = gain + np.where(left > 1e-9, total * left * np.log(np.maximum(left, 1e-12) / left_above), 0.0)
        entries = np.bincount(context, minlength=rows)
        kept.append((entries > 0) & (gain > 0.5 * entries * np.log(np.maximum(total, 2.0))))
        dist.append(p.astype(np.float32))
        if d == depth:
            break
        # a pair (context, next) that is frequent enough is a context of the next depth:
        # next is then the last symbol, and the context's own symbols come before it
        enough = (n >= p_min * tokens) & (after != tree.end)
        _extend(tree, d, context[enough], after[enough], n[enough], parent_row, totals)
    # suffixes of retained contexts stay
    for d in range(depth - 1, 0, -1):
        if len(kept) > d:
            kept[d - 1][parent_row[d][kept[d]]] = True
    logs, first = [np.log10(np.maximum(root, 1e-30))[None, :]], 1
    for d, keep in enumerate(kept):
        table = np.full(len(keep), -1, np.int64)
        table[keep] = first + np.arange(int(keep.sum()))
        first += int(keep.sum())
        tree.state.append(table)
        logs.append(np.log10(np.maximum(dist[d + 1][keep], 1e-30)))
    tree.log = np.concatenate(logs).astype(np.float32)
    return tree


def _extend(tree: Tree, d: int, context: np.ndarray, after: np.ndarray, n: np.ndarray,
            parent_row: list[np.ndarray], totals: list[np.ndarray]) -> None:
    """Add the depth d+1 contexts (context followed by ``after``).

    The suffix of a context drops its oldest symbol.  For depth 2, (a, b): the suffix is b
    and a is the symbol before it.  For depth 3, (a, b, c): the suffix is (b, c).
    """
    k = tree.size
    if d == 1:
        suffix, oldest = after, context
    else:
        older = np.full((tree.rows[d - 1], 2), -1, np.int64)        # depth 2 context -> (oldest, suffix)
        s, o = np.nonzero(tree.next[d - 2] >= 0)
        older[tree.next[d - 2][s, o]] = np.stack([o, s], axis=1)
        oldest, middle = older[context].T
        suffix = tree.next[d - 2][after, middle]                    # (middle, after)
    ok = suffix >= 0
    suffix, oldest, n = suffix[ok], oldest[ok], n[ok]
    table = np.full((tree.rows[d - 1], k), -1, np.int32)
    table[suffix, oldest] = np.arange(len(suffix))
    tree.next.append(table)
    tree.rows.append(len(suffix))
    parent_row.append(suffix)
    totals.append(n.astype(float))


def score(docs: DataFrame, divisor: int | None = None, held: int = 2, p_min: float = P_MIN, q_min: float = Q_MIN,
          depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    held_out = F.lit(False) if divisor is None else fold("doc_id", divisor) == held
    tokens = settled(blocks(docs, held_out), "tokens")
    counts = settled(dictionary(tokens).filter("n > 0").groupBy("code").agg(F.sum("n").alias("n")), "counts")
    total, words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = counts.filter((F.col("n") >= p_min * total) | (F.col("code") == END)).collect()      # 1 / P_MIN rows at most
    rare = counts.filter((F.col("n") < p_min * total) & (F.col("code") != END))
    per_class = rare.groupBy(F.col("code").bitwiseAND(F.lit(CLASSES - 1)).alias("k")).agg(
        F.sum("n").alias("t"), F.count("*").alias("w")).collect()
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per_class:
        class_tokens[r["k"]], class_words[r["k"]] = r["t"], r["w"]
    symbols = Symbols([r["code"] for r in frequent], class_tokens, class_words, total, words)
    unigram = np.zeros(symbols.size)
    unigram[:CLASSES] = class_tokens
    for r in frequent:
        unigram[CLASSES + np.searchsorted(symbols.frequent, r["code"])] = r["n"]
    texts = settled(sequences(tokens, counts, symbols), "sequences")
    tree = learn(texts, symbols, unigram, p_min, q_min, depth)
    tokens = tokens.select("block", "doc_id", "held_out", "low", "high", "codes")
    bits = max(0, math.ceil(math.log2(max(total, 1) / RANGE)))
    answers = texts.filter("counts IS NOT NULL").selectExpr("block", "1 AS words", "0 AS part", "counts AS n", "counts AS total")
    for k in range(2, depth + 2):
        asked = answers.filter("words > 1")
        answers = answers.union(settled(run_counts(tokens, asked, k, bits), "runs"))
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def run(rows: pa.Table, counted: pa.Table) -> pa.Table:
        block, known = Block(rows), by_words(counted)
        known |= {k: [] for k in range(2, depth + 2) if k not in known}      # none was asked for
        c = _numbers(known[1][0][0]).astype(np.int64)
        symbol, inside, base = symbols.of(block.code, c)
        symbol = symbol.astype("<u2")
        p = np.concatenate([shared.value.log10(x, first)[np.arange(len(x)) != first].astype(float) for x, first, _ in (
            _texts(part, shared.value.end) for part in _slices(
                [symbol[block.place[a:a + m]].tobytes() for a, m in zip(block.starts.tolist(), block.lengths.tolist())]))])
        p = 10.0 ** (p + inside[block.place])
        context = block.before(c[block.place], c[block.code == END].sum())     # every training text has a leading end
        for _, _, n, _ in block.counts(known, depth + 1):
            p = np.where(context > 0, (n + PRIOR * p) / (context + PRIOR), p)
            context = block.before(n, 0)
        at = block.starts
        return pa.table([block.doc_id, block.held_out, pa.array(block.lengths),
                         pa.array(np.add.reduceat((c > 0)[block.place].astype(np.int64), at)),
                         pa.array(np.add.reduceat(base[block.place], at)), pa.array(np.add.reduceat(np.log10(p), at))],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    return (tokens.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
                run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                    "base_score", "score"))
