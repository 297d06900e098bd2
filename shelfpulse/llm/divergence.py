"""Audit of how far the sources of a language differ in their words.

1. Terms are runs of letters (A-Z, a-z, and all signs beyond ASCII), A-Z lower-cased.  Each is
   written with its language before it, so one ``CountVectorizer`` with ``minDF`` and the
   largest ``vocabSize`` fits the vocabulary of every language in one pass: a document only has
   terms of its own language, so the documents with a term are those of that language.
2. The terms of many documents of a (lang, source) are counted together and go on as bundles,
   one for each count; the fitted model turns a bundle into a sparse vector, and the vectors are
   summed per (lang, source) over their entries, never as dense arrays.  A vector of counts is
   linear in the documents, so this is the sum of the documents' vectors; a task needs one
   Python worker, and a term goes to the model once and not as often as it occurs.
3. Shares p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in whole numbers.
4. Pairs of sources.  A term that neither source has adds the same |p - q| each time; only the
   others are looked at: terms are dealt to blocks, a block holds some terms of two blocks of
   sources, and gives what its terms add beyond that.  No pair of rows is written out.

The vocabulary of a model is on the driver and is sent to all tasks, so its size is looked at
first: distinct terms are estimated on a sample of the documents, with what a term of ``minDF``
documents may miss there added, and terms are dealt by hash to as many models as keep each below
``LARGEST`` terms.  Counts are per term, so the number of models changes no result.

NULL text, lang and source count as ''.  Documents without terms still make their group.
Repeated rows count each.  Ties go by UTF-8 order of the item.  A language that keeps no term
has pairs of value 0 and no terms.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfpulse.llm.common import saved, slices, text_bytes
from shelfpulse.operators.topk import top_k

# a byte of UTF-8 text as a term has it: other ASCII signs than letters are blanks, A-Z lower-cased
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
UNIT = 1_000_000_000
LARGEST = 1_000_000              # terms of one model
SAMPLED = 0.03                   # share of the documents that the number of models is estimated on
HELD = 400_000                   # counts that a task holds
ROW = 20_000                     # terms of a bundle
TERMS, SOURCES = 2048, 256       # of a block


def tokens(docs: DataFrame) -> DataFrame:
    """lang, source, terms: the terms of a document as 'lang term', without repeats."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ends, lengths, data = [0], [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            words = set(text.translate(TABLE).split())
            head = lang.encode() + b" "
            if words:
                data += [head, head.join(words)]
                lengths.append(np.fromiter(map(len, words), np.int64, len(words)) + len(head))
            ends.append(ends[-1] + len(words))
        offsets = np.concatenate([[0], *lengths]).cumsum().astype(np.int32)
        flat = pa.StringArray.from_buffers(ends[-1], pa.py_buffer(offsets), pa.py_buffer(b"".join(data)))
        terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], terms], ["lang", "source", "terms"])

    def slowly(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(iter([batch]), 128):
                yield run(part)
    return named(docs, text_bytes().alias("text")).mapInArrow(slowly, "lang string, source string, terms array<string>")


def named(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], *more)


def bundles(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, n, terms: the terms ('lang term') that n times occur in some documents of a
    group, each once.  A task hands its counts on when it holds ``held`` of them."""
    schema = "lang string, source string, n long, terms array<string>"

    def handed_on(groups: dict[tuple[str, str], Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, source), counter in groups.items():
            by_count: dict[int, list[bytes]] = {}
            for word, n in counter.items():
                by_count.setdefault(n, []).append(word)
            head = lang.encode() + b" "
            rows = [(n, words[a:a + ROW]) for n, words in by_count.items() for a in range(0, len(words), ROW)]
            for a in range(0, len(rows), 64):
                part = rows[a:a + 64]
                words = [w for _, some in part for w in some]
                ends = np.cumsum([0, *(len(some) for _, some in part)])
                offsets = np.cumsum(np.fromiter((0, *map(len, words)), np.int64, len(words) + 1))
                offsets += np.arange(len(offsets)) * len(head)
                flat = pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets.astype(np.int32)),
                                                   pa.py_buffer(head + head.join(words)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                     pa.array([n for n, _ in part], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["lang", "source", "n", "terms"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], Counter] = {}
        size = 0
        for batch in slices(it, 128):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                counter = groups.setdefault((lang, source), Counter())
                size -= len(counter)
                counter.update(text.translate(TABLE).split())
                size += len(counter)
                if size >= held:
                    yield from handed_on(groups)
                    groups, size = {}, 0
        yield from handed_on(groups)
    return named(docs, text_bytes().alias("text")).mapInArrow(run, schema)


def term_counts(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n) of all kept terms, and (lang, term) of all kept terms."""
    spark = docs.sparkSession
    seen = (tokens(docs.sample(SAMPLED, seed=1)).select(F.explode("terms").alias("t"))
            .agg(F.approx_count_distinct("t").alias("n")).first()["n"])
    models = max(1, -(-int(seen * 1.2 / (1 - (1 - SAMPLED) ** min_docs)) // LARGEST))

    def share_of(terms: DataFrame, m: int) -> DataFrame:
        return terms if models == 1 else terms.withColumn(
            "terms", F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(models)) == m))
    counts, kept = [], []
    for m in range(models):
        # repeats within a document change no document frequency
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_docs),
                                vocabSize=2 ** 31 - 1).fit(share_of(tokens(docs), m))
        vocabulary = pa.array(model.vocabulary, pa.string())
        words = spark.createDataFrame(pa.table({"i": pa.array(np.arange(len(vocabulary), dtype=np.int32)), "t": vocabulary}))
        # a bundle's terms are distinct, so its vector has ones and the bundle's n is the count
        sums = (model.transform(share_of(bundles(docs), m))
                .select("source", "n", F.explode(F.unwrap_udt(F.col("vector"))["indices"]).alias("i"))
                # by term alone, as the join below wants it; a task's bundles hold a key about once
                .repartition("i").groupBy("source", "i").agg(F.sum("n").alias("n")))
        term = F.substring_index("t", " ", -1)
        lang = F.expr("left(t, length(t) - length(substring_index(t, ' ', -1)) - 1)")
        counts.append(saved(sums.join(words, "i").select(lang.alias("lang"), "source", term.alias("term"), "n"), "term-counts"))
        kept.append(saved(words.select(lang.alias("lang"), term.alias("term")), "terms"))
    for more in counts[1:]:
        counts[0] = counts[0].unionByName(more)
    for more in kept[1:]:
        kept[0] = kept[0].unionByName(more)
    return counts[0], kept[0]


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)) without rounding; 0 where nothing is kept."""
    return F.expr(f"CASE WHEN {terms} = 0 THEN 0L ELSE CAST(1 + (CAST({UNIT} AS DECIMAL(10,0)) * "
                  f"CAST({n} + 5 AS DECIMAL(20,0))) div CAST({total} + 5 * {terms} AS DECIMAL(20,0)) AS BIGINT) END")


PARTIAL = "lang string, i int, j int, beyond long"


def compare_block(block: pd.DataFrame, size: int) -> pd.DataFrame:
    """What the block's terms add to each pair of its sources beyond |p0 - q0|;
    source blocks are of ``size`` numbers.

    Rows are (lang, no, side, term, p, p0); those without a term only name a source."""
    lang = block["lang"].iloc[0]
    same = bool((block["lo"] == block["hi"]).iloc[0])
    rows = block[block["term"].notna()]
    at, terms = pd.factorize(rows["term"])
    numbers, first = np.unique(block["no"].to_numpy(), return_index=True)
    none = block["p0"].to_numpy()[first]
    dense = np.repeat(none[:, None], len(terms), axis=1)
    dense[np.searchsorted(numbers, rows["no"].to_numpy()), at] = rows["p"].to_numpy()
    source_block = numbers // size
    left = np.flatnonzero(source_block == block["lo"].iloc[0])
    right = np.flatnonzero(source_block == block["hi"].iloc[0])
    out = []
    for a in left.tolist():
        b = right[right > a] if same else right
        if len(b):
            beyond = np.abs(dense[b] - dense[a]).sum(axis=1) - np.abs(none[b] - none[a]) * len(terms)
            out.append(np.column_stack([np.full(len(b), numbers[a]), numbers[b], beyond]))
    found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return pd.DataFrame({"lang": pd.Series([lang] * len(found), dtype=object), "i": found[:, 0].astype(np.int32),
                         "j": found[:, 1].astype(np.int32), "beyond": found[:, 2]})


def pair_values(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, item, value for all ordered pairs of sources of a language."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)).cast("int")
    present = groups.select("lang", "no", "sources", "p0", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"),
                          F.explode(F.sequence(F.lit(0), blocks - 1)).alias("terms_block"))
    held = shares.select("lang", "no", "sources", "p0", "term", "p",
                         F.pmod(F.xxhash64("term"), blocks).cast("int").alias("terms_block"))
    mine = F.floor(F.col("no") / SOURCES).cast("int")
    rows = (present.unionByName(held).withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / SOURCES).cast("int"))))
            .select("lang", "no", "p0", "term", "p", "terms_block", F.least("mine", "other").alias("lo"),
                    F.greatest("mine", "other").alias("hi")))
    size = SOURCES
    beyond = (rows.groupBy("lang", "terms_block", "lo", "hi")
              .applyInPandas(lambda block: compare_block(block, size), PARTIAL)
              .groupBy("lang", "i", "j").agg(F.sum("beyond").alias("beyond")))
    a = groups.select("lang", "source", "no", "p0", "v")
    b = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("no2"), F.col("p0").alias("q0"))
    pairs = a.join(b, "lang").filter("no <> no2").withColumn("i", F.least("no", "no2")).withColumn("j", F.greatest("no", "no2"))
    return (pairs.join(beyond, ["lang", "i", "j"], "left")
            .select("lang", "source", "item", (F.col("v") * F.abs(F.col("p0") - F.col("q0"))
                                               + F.coalesce("beyond", F.lit(0))).alias("value")))


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    counts, kept = term_counts(docs, min_docs)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (named(docs).distinct()
              .join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["v", "total"])
              .withColumn("p0", share("0", "total", "v"))
              .withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
              .withColumn("sources", F.count("*").over(Window.partitionBy("lang"))))
    groups = saved(groups, "groups")
    shares = saved(counts.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "v")), "shares")

    whole = (counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
             .join(counts.groupBy("lang").agg(F.sum("n").alias("total")), "lang").join(sizes, "lang")
             .select("lang", "term", share("n", "total", "v").alias("q")))
    above = (shares.join(whole, ["lang", "term"]).filter("p > q")
             .select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")))
    order = [F.col("value").desc(), F.col("item").asc()]
    terms = top_k(above, ["lang", "source"], order, top, rank_col="rank", salt=16)
    pairs = pair_values(groups, shares)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    out = [d.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
           for part, d in (("pair", pairs), ("term", terms))]
    return out[0].unionByName(out[1])
