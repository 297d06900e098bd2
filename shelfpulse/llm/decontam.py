"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Canonical form.  Every number becomes ``9``, every unit after a number ``%`` and every name
(a capitalised word inside a sentence) ``@``; everything else is lower-cased.  The plain form
is the same without names, so it does not depend on case.  Runs of white space are one blank.
One token of the text gives one token of either form, so positions agree.  Documents and
benchmark items go through the same expressions.

Windows.  Every run of ``WINDOW`` tokens is hashed in both forms, and is hit when either is.
A benchmark window counts when at least two tokens of its canonical form are plain words.  Document windows meet benchmark windows in a hash join:
a broadcast one while the benchmark has at most ``BROADCAST_ROWS`` distinct windows
(counted first), otherwise a shuffled one.

Slots.  A hit fixes an alignment of the item with the document (the difference of their
positions).  In every alignment the placeholders under its hits are compared: an item's
value must stand for one document value wherever it recurs; two of its values may become
one, as when 12 and 15 are both set to 20.  Alignments that contradict themselves do not
count.  An item is contained in a document when at least
``THRESHOLD`` of the item's windows are hit by consistent alignments; ``reparameterised``
says that some slot value differs from the item's.

Result: one row per (doc_id, item_id) that is contained.  Texts of fewer than ``WINDOW``
tokens are one window (the whole sequence) and only match texts of the same length.  NULL
and empty texts have no window and never match; items without an eligible window match
nothing.  Repeated rows of a doc_id (or item_id) are compared as one id each: an id is
contained when any of its rows contains the item.  NULL ids are not compared, as a pair
without an id says nothing.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfpulse.llm.common import saved, text_key

WINDOW = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 1_000_000       # of 8 bytes each

# fixed values: unit words that may follow a number
UNITS = ("km", "m", "cm", "mm", "kg", "g", "mg", "lb", "oz", "l", "ml", "s", "sec", "seconds", "min", "minutes",
         "h", "hours", "days", "weeks", "months", "years", "mph", "kmh", "miles", "feet", "inches", "meters",
         "metres", "kilometers", "grams", "kilograms", "pounds", "liters", "litres", "dollars", "euros", "cents",
         "percent", "degrees")


def spaced(text: Column) -> Column:
    """Numbers and letters that touch become two tokens; thousands separators go, and runs of
    white space become one blank."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[0-9])[.,](?=[0-9])", "")
    t = F.regexp_replace(t, r"[\s\p{Z}]+", " ")
    return F.regexp_replace(t, r"(?<=[0-9])(?=\p{L})|(?<=\p{L})(?=[0-9])", " ")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and placeholder signs."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def typed(text: Column) -> Column:
    """A spaced text with its numbers and units typed."""
    t = F.regexp_replace(text, r"(?i)(?<=[0-9][ ])(?:" + "|".join(UNITS) + r")(?![\p{L}\p{N}])", "ɒɒ")
    return F.regexp_replace(t, r"[0-9]+", "9")


def named(text: Column) -> Column:
    """A typed text with its names typed."""
    return F.regexp_replace(text, r"(?<=[\p{Ll}\p{N},;:][ ])\p{Lu}[\p{Ll}]+(?![\p{L}\p{N}])", "ɑɑ")


def both_forms(df: DataFrame, *keep: str) -> DataFrame:
    """The tokens of column ``t`` (a typed text) in canonical form (c) and in plain form (p),
    in which names are words like others; p is NULL where the text has no name, as the forms
    are then the same."""
    return (df.select(*keep, "t", named(F.col("t")).alias("n"))
            .select(*keep, tokens(F.lower("n")).alias("c"),
                    F.when(F.col("n") != F.col("t"), tokens(F.lower("t"))).alias("p")))


NAME, UNIT, NUMBER = "ɑɑ", "ɒɒ", "9"


def window_hashes() -> Column:
    """Hashes, in both forms, of every run of WINDOW tokens (of the whole sequence when it is shorter)."""
    size = F.size("c")
    last = F.greatest(size - (WINDOW - 1), F.lit(1))

    def run(form: str, at: Column) -> Column:
        return F.xxhash64(*[F.try_element_at(F.col(form), at + k) for k in range(WINDOW)])
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(
        run("c", i).alias("c"), F.when(F.col("p").isNotNull(), run("p", i)).alias("p"))))


def either(window: str) -> Column:
    """The hashes of a window, one when its forms are the same."""
    c, p = F.col(f"{window}.c"), F.col(f"{window}.p")
    return F.explode(F.when(p.isNull() | (c == p), F.array(c)).otherwise(F.array(c, p))).alias("h")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_tokens, wpos, h, n_windows) of every eligible benchmark window."""
    items = both_forms(benchmark.select("item_id", spaced(F.col("text")).alias("s")).filter("item_id IS NOT NULL")
                       .select("item_id", tokens("s").alias("item_tokens"), typed(F.col("s")).alias("t")),
                       "item_id", "item_tokens")
    rows = items.select("item_id", "item_tokens", "c", F.posexplode(window_hashes()).alias("wpos", "w"))
    words = F.size(F.filter(F.slice("c", F.col("wpos") + 1, WINDOW),
                            lambda x: ~x.isin(NAME, UNIT, NUMBER)))
    rows = (rows.filter(words >= 2).select("item_id", "item_tokens", "wpos", either("w"))
            .dropDuplicates(["item_id", "item_tokens", "wpos", "h"]))
    sizes = rows.groupBy("item_id", "item_tokens").agg(F.count_distinct("wpos").alias("n_windows"))
    return rows.join(sizes, ["item_id", "item_tokens"])


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_windows, n_hit, coverage, n_slots, reparameterised)."""
    bench = saved(item_windows(benchmark).withColumn("key", F.xxhash64("item_id", "item_tokens")), "bench")
    wanted = bench.select("h").distinct()
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    words = both_forms(docs.select("doc_id", spaced(F.col("text")).alias("s")).filter("doc_id IS NOT NULL")
                       .select("doc_id", F.xxhash64("s").alias("text_key"), typed(F.col("s")).alias("t")),
                       "doc_id", "text_key")
    hits = (words.select("doc_id", "text_key", F.posexplode(window_hashes()).alias("pos", "w"))
            .select("doc_id", "text_key", "pos", either("w")).join(wanted, "h", "left_semi").distinct())
    met = saved(hits.join(bench.select("h", "key", "wpos", "n_windows"), "h"), "hits")

    # first by windows alone: few (document, item) pairs get as far as their slots
    pair = ["doc_id", "text_key", "key"]
    likely = saved(met.groupBy(*pair).agg(F.count_distinct("wpos").alias("n"), F.first("n_windows").alias("n_windows"))
                   .filter(F.col("n") >= threshold * F.col("n_windows")).select(*pair), "likely")
    raw = (docs.filter("doc_id IS NOT NULL").join(likely.select("doc_id").distinct(), "doc_id", "left_semi")
           .select("doc_id", spaced(F.col("text")).alias("s"))
           .select("doc_id", F.xxhash64("s").alias("text_key"), tokens("s").alias("words"),
                   tokens(F.lower(named(typed(F.col("s"))))).alias("c")).dropDuplicates(["doc_id", "text_key"]))
    aligned = (met.join(likely, pair, "left_semi").withColumn("shift", F.col("pos") - F.col("wpos"))
               .join(raw, ["doc_id", "text_key"])
               .withColumn("slots", F.filter(
                   F.transform(F.sequence(F.col("pos"), F.col("pos") + (WINDOW - 1)), lambda i: F.struct(
                       (i - F.col("shift")).alias("at"), F.get("c", i).alias("kind"),
                       F.lower(F.get("words", i)).alias("word"))),
                   lambda s: s["kind"].isin(NAME, UNIT, NUMBER)))
               .select(*pair, "shift", "wpos", "n_windows", "slots"))
    items = bench.select("key", "item_id", "item_tokens").dropDuplicates(["key"])
    slots = (aligned.select(*pair, "shift", F.explode("slots").alias("s")).distinct()
             .join(items.select("key", "item_tokens"), "key")
             .select(*pair, "shift", F.col("s.kind").alias("kind"), F.col("s.word").alias("word"),
                     F.lower(F.get("item_tokens", F.col("s.at"))).alias("value")))
    shift = [*pair, "shift"]
    checked = (slots.groupBy(*shift, "kind").agg(
        F.count_distinct("value", "word").alias("pairs"), F.count_distinct("value").alias("values"),
        F.count("*").alias("n"),
        F.max(F.col("value") != F.col("word")).alias("differs"))
        .groupBy(*shift).agg(F.min(F.col("pairs") == F.col("values")).alias("ok"),
                             F.sum("n").alias("n_slots"), F.max("differs").alias("differs")))
    joined = (aligned.select(*shift, "wpos", "n_windows").join(checked, shift, "left")
              .filter(F.coalesce("ok", F.lit(True))))
    found = (joined.groupBy(*pair).agg(
        F.first("n_windows").alias("n_windows"), F.count_distinct("wpos").alias("n_hit"),
        F.coalesce(F.max("n_slots"), F.lit(0)).alias("n_slots"),
        F.coalesce(F.max("differs"), F.lit(False)).alias("reparameterised"))
        .withColumn("coverage", F.col("n_hit") / F.col("n_windows")).filter(F.col("coverage") >= threshold)
        .join(items.select("key", "item_id"), "key"))
    best = F.struct("coverage", "n_hit", "n_windows", "n_slots", "reparameterised")
    return (found.groupBy("doc_id", "item_id").agg(F.max(best).alias("b"))
            .select("doc_id", "item_id", "b.n_windows", "b.n_hit", "b.coverage", "b.n_slots", "b.reparameterised"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text contains no benchmark item.

    Rows are judged by their text (its 64-bit hash), not by their id: a row without id goes
    when its text is contaminated, a clean row stays beside a contaminated one of the same id.
    """
    text = text_key()
    hit = (contained_items(docs.select(text.alias("doc_id"), "text"), benchmark, threshold)
           .select(F.col("doc_id").alias("__text_key")).distinct())
    return docs.join(hit, text == hit["__text_key"], "left_anti").select(*docs.columns)
