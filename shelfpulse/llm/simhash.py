"""SimHash near-duplicate groups with BK-trees.

A document's fingerprint has bit j set when more than half of its word-shingle
hashes have bit j set.  Fingerprints within ``max_bits`` differing bits are
linked, and a document's group is everything reachable over links.

Candidates.  Two fingerprints that differ in at most r bits agree on at least one
of r+1 bit bands (pigeonhole), so every band value is a shard and each shard gets a
BK-tree: a node's children are keyed by their Hamming distance to it, and a search
at distance d follows only the edges d-r .. d+r.  Trees are built where the shard's
rows were shuffled to, not broadcast: the number of distinct fingerprints has no
bound, so neither has a broadcast tree.  A shard with more than ``block`` distinct
fingerprints is cut into blocks and each pair of blocks becomes its own piece of
work, so one crowded shard spreads over many tasks.  A piece returns the links of a
spanning forest of what it found (at most one per fingerprint), never all pairs.

Groups.  Links are joined by alternating large-star and small-star steps, each
written to the shared folder, until nothing changes.

NULL text counts as empty (fingerprint 0); documents without words link to each
other and to any fingerprint near 0.  NULL ids get a row of their own; a group of
NULL ids only has a NULL component_id.  Rows with equal ids share a group only if
their texts are linked.  Extra input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfpulse.llm.common import map_batches, saved, text_bytes

CHUNK = 1 << 16          # shingles hashed at a time


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash of a text, as an unsigned number; 0 without words."""
    words = text.lower().split()      # bytes: A-Z only; splits at 0x20 and 0x09-0x0D
    n = len(words)
    if n == 0:
        return 0
    if n < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n - shingle + 1].tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        h = np.array([digest(joined[a:b], 42) for a, b in
                      zip(starts[at:at + CHUNK], stops[at:at + CHUNK])], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(packed.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp long) for every row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))],
                                          ["doc_id", "fp"])
    return map_batches(docs.select(F.col("doc_id").cast("long"), text_bytes()), run, "doc_id long, fp long")


def _bands(max_bits: int) -> list[tuple[int, int]]:
    """(shift, mask) of max_bits + 1 bands that cover the 64 bits."""
    edges = [round(64 * i / (max_bits + 1)) for i in range(max_bits + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]


# --------------------------------------------------------------------------- BK-trees

def build_trees(group: np.ndarray, fp: np.ndarray):
    """BK-trees of all groups at once.

    Rows are sorted by group; the first row of a group is its root.  Returns the edges
    as sorted keys (parent * 65 + distance) with the child of each, both by row.
    """
    first = np.r_[True, group[1:] != group[:-1]]
    node = np.flatnonzero(first)[np.cumsum(first) - 1]      # where each row stands
    active = np.flatnonzero(~first)
    keys, children = [], []
    while len(active):
        at = node[active]
        key = at * 65 + np.bitwise_count(fp[active] ^ fp[at])
        order = np.argsort(key, kind="stable")
        key, rows = key[order], active[order]
        head = np.r_[True, key[1:] != key[:-1]]
        child = rows[head]
        keys.append(key[head])
        children.append(child)
        node[rows] = child[np.cumsum(head) - 1]
        active = rows[~head]
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys, children = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(keys)
    return keys[order], children[order]


def search(root: np.ndarray, query: np.ndarray, fp: np.ndarray, keys, children, radius: int):
    """Yield (query index, row) arrays of rows within ``radius`` of the queries.

    The frontier moves down all trees together; it is worked off in slices, so its
    memory stays bounded.
    """
    stack = [(np.arange(len(query)), root)]
    while stack:
        q, at = stack.pop()
        if len(q) > 1 << 18:
            half = len(q) // 2
            stack += [(q[:half], at[:half]), (q[half:], at[half:])]
            continue
        d = np.bitwise_count(query[q] ^ fp[at]).astype(np.int64)
        near = d <= radius
        if near.any():
            yield q[near], at[near]
        lo = np.searchsorted(keys, at * 65 + np.maximum(d - radius, 1))
        hi = np.searchsorted(keys, at * 65 + np.minimum(d + radius, 64), side="right")
        n = hi - lo
        total = int(n.sum())
        if total:
            edge = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            stack.append((np.repeat(q, n), children[edge]))


class Forest:
    """Union of array indices; labels are the smallest index of each set."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        lab = self.label
        while True:
            x, y = lab[a], lab[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            x, y = x[apart], y[apart]
            np.minimum.at(lab, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = lab[lab]
                if np.array_equal(up, lab):
                    break
                lab[:] = up


def _piece_links(piece: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int):
    """Links (fp, fp) of a spanning forest per piece.  Side 0 is in the tree; rows of
    every side search it (a piece with one block searches itself)."""
    order = np.lexsort((fp, side, piece))
    piece, side, fp = piece[order], side[order], fp[order]
    new = np.r_[True, piece[1:] != piece[:-1]]
    start = np.flatnonzero(new)[np.cumsum(new) - 1]          # first row of the own piece
    tree = np.flatnonzero(side == 0)
    at = np.full(len(fp), -1, np.int64)
    at[tree] = np.arange(len(tree))
    keys, children = build_trees(piece[tree], fp[tree])
    sides = np.zeros(len(fp), bool)
    np.logical_or.at(sides, start, side == 1)
    two = sides[start]
    ask = np.flatnonzero((~two | (side == 1)) & (side[start] == 0))   # without side 0: no tree
    forest = Forest(len(fp))
    for q, row in search(at[start[ask]], fp[ask], fp[tree], keys, children, radius):
        forest.link(ask[q], tree[row])
    lab = forest.label
    linked = np.flatnonzero(lab != np.arange(len(lab)))
    return fp[linked], fp[lab[linked]]


def links(fps: DataFrame, max_bits: int, block: int = 50_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints; each connected set of
    fingerprints within ``max_bits`` is connected by them."""
    bands = _bands(max_bits)
    value = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(m)) for s, m in bands]
    sharded = fps.select("fp", F.posexplode(F.array(*value)).alias("band", "value"))
    crowded = (sharded.groupBy("band", "value").count().filter(F.col("count") > block)
               .select("band", "value", F.ceil(F.col("count") / block).cast("int").alias("g")))
    cut = (sharded.join(crowded, ["band", "value"], "left")
           .withColumn("g", F.coalesce("g", F.lit(1)))
           .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")))
    # block i meets the blocks j >= i: it is side 0 of (i, j) and side 1 of (j', i) for j' < i
    pieces = (cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
              .select("fp", "band", "value", F.least("own", "other").alias("i"),
                      F.greatest("own", "other").alias("j"),
                      F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
              .withColumn("piece", F.xxhash64("band", "value", "i", "j")))

    def run(it):
        cols = [[], [], []]
        for b in it:
            for c, i in zip(cols, range(3)):
                c.append(b.column(i).to_numpy(zero_copy_only=False))
        if not cols[0]:
            return
        piece, side, fp = (np.concatenate(c) for c in cols)
        if not len(fp):
            return
        a, b = _piece_links(piece, side, fp.view(np.uint64), max_bits)
        for s in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[s:s + 100_000].view(np.int64)),
                                              pa.array(b[s:s + 100_000].view(np.int64))], ["a", "b"])
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (pieces.repartition(n, "piece").select("piece", "side", "fp")
            .mapInArrow(run, "a long, b long").distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of the connected set of every node that has a link.

    Large-star and small-star in turn; each step sends a node's neighbours to the smallest
    one, by a grouped minimum joined back (a hub is split by the skewed-join rule).
    """
    def star(e: DataFrame, both: bool) -> DataFrame:
        pairs = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else e
        low = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        joined = pairs.join(low, "a")
        if both:      # neighbours above the node go to the minimum
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:         # the node and its lower neighbours go to the minimum
            out = (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
                   .union(low.select("a", F.col("m").alias("b"))))
        return out.filter("a <> b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
              .filter("a <> b").distinct(), "links")
    before = state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        e = saved(star(star(e, True), False), "links")
        after = state(e)
        if tuple(after) == tuple(before):
            break
        before = after
    else:
        raise RuntimeError(f"groups did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def simhash_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id
    reachable over fingerprints at most ``max_bits`` apart, itself included)."""
    fp = saved(fingerprints(docs, shingle), "simhash")
    nodes = fp.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    root = components(links(nodes.select("fp"), max_bits))
    rooted = saved(nodes.join(root, nodes.fp == root.node, "left")
                   .select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    named = (rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
             .select("fp", "component_id"))
    return fp.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
