"""Token counts by a compiled finite-state tokenizer.

The tokenizer cuts a text into pre-tokens and encodes each on its own.  Both steps are
compiled:

* Pre-tokens.  The split pattern is a deterministic transducer over five character classes
  (letter, number, blank, other space, other) that looks one sign ahead, two after an
  apostrophe.  ``COMPILED`` holds, for every (class before, class, class after), whether
  its transition ends a pre-token; a pass over a block of text is one table lookup.
* Counts.  The transition that ends a pre-token carries the number of tokens it emits; the
  numbers are compiled from the vocabulary when a pre-token is first met and kept in a
  table of bounded size.

Composition.  A pre-token always starts where a space follows a non-space, whatever came
before, so a chunk's state map is (head up to the first such place, tokens between the first
and the last, tail from the last on), or just its signs if it has no such place.  Maps
compose associatively (``compose``); long texts are cut into chunks whose maps are composed
in a tree (``scan``), short texts are blocked together.

NULL and empty texts have 0 bytes and 0 tokens.  Special tokens' strings inside a text
count as one token each, as the library's default has it.  Rows, repeated or with NULL ids,
are counted each on their own; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfpulse.llm import tokenizer
from shelfpulse.llm.common import WordValues, map_batches, values_of

LETTER, NUMBER, BLANK, SPACE, OTHER, EDGE = range(6)
BLOCK = 1 << 20                  # characters handled at a time
# fixed values: Unicode white space, and what may follow an apostrophe as one pre-token
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SHORT = ("s", "t", "m", "d")
LONG = ("re", "ve", "ll")
SYNC = re.compile(f"(?<=[^{SPACES}])[{SPACES}]")


def class_table() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[[ord(c) for c in SPACES]] = SPACE
    table[ord(" ")] = BLANK
    return table


def compile_splits() -> np.ndarray:
    """COMPILED[before, class, after]: does a pre-token start here?"""
    t = np.zeros((6, 6, 6), bool)
    spaces = (BLANK, SPACE)
    for before in range(6):
        for now in range(5):
            for after in range(6):
                if before == EDGE:
                    start = True
                elif now in spaces:      # the last of several spaces before a sign stands alone
                    start = before not in spaces or after not in (*spaces, EDGE)
                else:                    # one blank belongs to the sign after it
                    start = before != now and before != BLANK
                t[before, now, after] = start
    return t


COMPILED = compile_splits()


class Machine:
    """The compiled tokenizer of one vocabulary file."""

    def __init__(self, vocabulary: str):
        enc = tokenizer.encoding(vocabulary)
        self.special = re.compile("|".join(map(re.escape, sorted(enc.special_tokens_set)))) if enc.special_tokens_set else None
        self.classes = class_table()
        self.enc = enc
        self.emits = WordValues(lambda w: len(enc._encode_single_piece(w)))

    def starts(self, text: str, edges: np.ndarray) -> np.ndarray:
        """Where pre-tokens start in texts that are joined without a gap; ``edges`` are
        the places where one text starts."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        now = self.classes[code]
        before = np.empty(n, np.uint8)
        before[0], before[1:] = EDGE, now[:-1]
        after = np.empty(n, np.uint8)
        after[-1], after[:-1] = EDGE, now[1:]
        before[edges] = EDGE
        after[edges[1:] - 1] = EDGE
        start = COMPILED[before, now, after]
        for i in np.flatnonzero((code == 39) & (before != OTHER) & (before != BLANK)).tolist():
            if after[i] != LETTER:
                continue
            size = 2 if text[i + 1] in SHORT else 3 if text[i + 1:i + 3] in LONG and after[i + 1] == LETTER else 0
            if size:
                start[i + 1] = False
                if i + size < n:
                    start[i + size] = True
        return np.flatnonzero(start)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text (texts without special tokens)."""
        out = np.zeros(len(texts), np.int64)
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        joined = "".join(texts[i] for i in full)
        edges = np.cumsum([0, *(len(texts[i]) for i in full[:-1])])
        at = self.starts(joined, edges)
        stops = np.append(at[1:], len(joined))
        emitted = values_of([joined[a:b] for a, b in zip(at.tolist(), stops.tolist())], self.emits)
        total = np.concatenate(([0], np.cumsum(emitted)))
        mark = np.append(np.searchsorted(at, edges), len(at))
        out[full] = total[mark[1:]] - total[mark[:-1]]
        return out

    def ids(self, text: str) -> list[int]:
        """Ids of a text, pre-token by pre-token."""
        specials = self.special.findall(text) if self.special else []
        out: list[int] = []
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i:
                out.append(self.enc.encode_single_token(specials[i - 1]))
            if part:
                at = self.starts(part, np.zeros(1, np.int64)).tolist()
                for a, b in zip(at, [*at[1:], len(part)]):
                    out += self.enc._encode_single_piece(part[a:b])
        return out

    def state_map(self, chunk: str):
        """(head, tokens, tail), or (signs,) when the chunk has no sure start in it."""
        first = SYNC.search(chunk)
        if not first:
            return (chunk,)
        last = first.start()
        for m in SYNC.finditer(chunk, max(last, len(chunk) - 4096)):
            last = m.start()
        if last == first.start():
            for m in SYNC.finditer(chunk, last):
                last = m.start()
        return chunk[:first.start()], int(self.counts([chunk[first.start():last]])[0]), chunk[last:]

    def compose(self, a, b):
        """The map of chunk a followed by chunk b."""
        if len(a) == 1 and len(b) == 1:
            return self.state_map(a[0] + b[0])      # a start may lie where they meet
        if len(a) == 1:
            if self._meets(a[0], b[0]):
                return a[0], int(self.counts([b[0]])[0]) + b[1], b[2]
            return a[0] + b[0], b[1], b[2]
        if len(b) == 1:
            if self._meets(a[2], b[0]):
                return a[0], a[1] + int(self.counts([a[2]])[0]), b[0]
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + int(self.counts([a[2] + b[0]])[0]) + b[1], b[2]

    @staticmethod
    def _meets(left: str, right: str) -> bool:
        return bool(left and right and left[-1] not in SPACES and right[0] in SPACES)

    def scan(self, text: str) -> int:
        """Tokens of a long text: chunk maps, composed in a tree."""
        maps = [self.state_map(text[i:i + BLOCK]) for i in range(0, len(text), BLOCK)]
        while len(maps) > 1:
            maps = [reduce(self.compose, maps[i:i + 2]) for i in range(0, len(maps), 2)]
        m = maps[0]
        if len(m) == 1:
            return int(self.counts([m[0]])[0])
        return int(self.counts([m[0]])[0]) + m[1] + int(self.counts([m[2]])[0])

    def batch(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        owner, pieces, size = [], [], 0

        def flush():
            nonlocal owner, pieces, size
            np.add.at(out, np.array(owner, np.int64), self.counts(pieces))
            owner, pieces, size = [], [], 0

        for i, text in enumerate(texts):
            parts = [text]
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                out[i] += len(parts) - 1
            for part in parts:
                if len(part) > BLOCK:
                    out[i] += self.scan(part)
                    continue
                owner.append(i)
                pieces.append(part)
                size += len(part)
                if size > BLOCK:
                    flush()
        flush()
        return out


_MACHINES: dict[str, Machine] = {}      # per Python worker


def machine(vocabulary: str) -> Machine:
    if vocabulary not in _MACHINES:
        _MACHINES[vocabulary] = Machine(vocabulary)
    return _MACHINES[vocabulary]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = machine(vocabulary).batch(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n), pa.array(n > limit)],
                                          ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    return map_batches(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text"), run,
                       "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
