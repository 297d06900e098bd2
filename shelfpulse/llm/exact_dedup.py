"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

A text (A-Z lower-cased) is cut where its content says so, at least ``MIN`` and at most
``MAX`` bytes of UTF-8 from the chunk's start: at a blank or line break that follows n, d
or t and precedes a to e, or behind one of four of the 64 bytes that may end a character
beyond ASCII, so that texts in any script have cuts.  A text's recipe is the ordered list
of its chunks' 64-bit identifiers; beside it stand the first 128 bits of each chunk's
SHA-256.  Identifiers are verified: over the recipes that occur more than once, an
identifier with two digests stands for different chunks.  Texts whose recipe holds such a
one are told apart by the SHA-256 of the whole text as well.  Two texts are equal when
recipes, lengths and that mark are.  No text and no chunk is shuffled, only identifiers
and digests, and rows are matched by recipe, never by doc_id, so rows without one are
verified like any other.

NULL text counts as empty.  Of equal texts the row with the largest doc_id stays; rows
that repeat that doc_id are all marked kept; a group whose ids are all NULL has a
NULL keep_id and its rows are kept.  Extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfpulse.llm.common import UPPER, saved

MIN, MAX = 128, 2048
CUTS = r"[ndt][ \n](?=[a-e])|[\x80\x91\xa2\xb3]"
CHUNKS = rf"(?s).{{{MIN},{MAX}}}?(?:{CUTS}|\z)|.{{1,{MAX}}}"


def lowered(col: str = "text") -> Column:
    """The text with A-Z lower-cased and nothing else changed; NULL reads as ''."""
    return F.translate(F.coalesce(F.col(col), F.lit("")), UPPER, UPPER.lower())


def chunks(text: Column) -> Column:
    """The chunks of a text, one character per byte of its UTF-8 form."""
    return F.regexp_extract_all(F.decode(text.cast("binary"), "ISO-8859-1"), F.lit(CHUNKS), F.lit(0))


def digest(chunk: Column) -> Column:
    """The first 128 bits of a chunk's SHA-256."""
    return F.substring(F.unhex(F.sha2(chunk.cast("binary"), 256)), 1, 16)


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, recipe array<long>, digests array<binary>, text_sha256) for every row."""
    norm = docs.select("doc_id", lowered().alias("norm")).withColumn("chunks", chunks(F.col("norm")))
    return norm.select("doc_id", F.octet_length("norm").alias("n_bytes"),
                       F.transform("chunks", lambda c: F.xxhash64(c)).alias("recipe"),
                       F.transform("chunks", digest).alias("digests"),
                       F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))


def collisions(repeated: DataFrame) -> DataFrame:
    """Identifiers (id) with more than one digest among ``repeated`` rows (recipe, digests)."""
    pairs = (repeated.select(F.explode(F.arrays_zip("recipe", "digests")).alias("c"))
             .select(F.col("c.recipe").alias("id"), F.col("c.digests").alias("digest")).distinct())
    return pairs.groupBy("id").count().filter("count > 1").select("id")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    made = saved(recipes(docs), "recipes")
    key = ["n_bytes", "recipe"]
    groups = saved(_groups(made, key), "groups")
    repeated = made.join(groups, key, "left_semi")
    bad = saved(collisions(repeated), "collisions")
    if not bad.isEmpty():
        marked = saved(groups.select(*key, F.explode("recipe").alias("id")).join(bad, "id", "left_semi")
                       .select(*key).distinct().withColumn("unsure", F.lit(True)), "unsure")
        made = (made.join(marked, key, "left")
                .withColumn("mark", F.when(F.col("unsure"), F.col("text_sha256")).otherwise(F.lit("")))
                .drop("unsure"))
        key = [*key, "mark"]
        groups = saved(_groups(made, key), "groups")
    # groups of one need no partner; the groups are read from files, so a crowded group's
    # rows can be split by the skewed-join rule
    rows = made.join(groups, key, "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("largest"))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"),
                       F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def _groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """Groups of two rows or more: their key, size and largest doc_id."""
    return (rows.groupBy(*key).agg(F.max("doc_id").alias("largest"), F.count("*").alias("n")).filter("n > 1"))
