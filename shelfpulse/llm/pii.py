"""Personal data: pattern spans, and terms that give them away (information-theoretic
sanitisation).

Base spans.  E-mail addresses, IP addresses, card numbers and phone numbers by fixed patterns,
leftmost and non-overlapping per kind, with their checks (parts up to 255, Luhn, digit
counts); a match that fails its check is dropped.  Searches are linear in the text.

Terms.  Every value of personal data is a protected entity (an address or number however it
is written), and so is each kind as a whole.  A term (a lower-cased word without punctuation
at its ends) is measured against an entity in two scopes: the sentences that hold the entity
(and at least ``NEAR`` words on either side of it), and the whole documents that hold it.
Over the whole corpus, with N words in all, W in the entity's scope, n occurrences of the
term and m of them in the scope:

    I = -log2(W / N)                             information that a word is in the scope
    share = log2(p / (W / N)) / I                part of it that the term gives away

where p is the lower end of the Wilson interval of m / n.  A term discloses the entity when
its share is at least ``THRESHOLD`` in one of the scopes and at least ``SUPPORT`` different
texts show it there: sentences (with another value or other words), or documents, that are
no near copies of each other
(so copies of one text are no evidence).  All its occurrences, in every text and beside a
span or not, are spans of kind ``term`` (but for words that are part of a base span);
``sanitised`` replaces base spans by their kind and generalises terms to ``[term]``.

NULL and empty texts have no spans.  Rows are handled each on their own; NULL ids and
repeated rows are kept.  Extra columns are ignored (``sanitised`` keeps them).
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfpulse.llm.common import WordValues, hash64, map_batches, saved, slices, text_bytes, values_of

KINDS = ("email", "ip", "card", "phone")
NEAR = 5
THRESHOLD, SUPPORT = 0.75, 5
BROADCAST_TERMS = 1_000_000      # of 8 bytes each; more are met by a shuffled join

# fixed values: the patterns (possessive and anchored forms of the same language)
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")       # the words of bytes.split()
STOP = re.compile(r"[.!?]+(?=\s)|\n+")
ENDS = ".,;:!?\"'()[]{}*#%&$|<>/\\-_~`+=^@"


def emails(text: str):
    """Every e-mail span: the longest run of local signs before an @ and a domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", free if m else at + 1)


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; ends are exclusive."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2]))]


def _term(word: bytes) -> int:
    """Hash of a word as a term; 0 when nothing but punctuation is left."""
    w = word.lower().strip(ENDS.encode())
    return hash64(w) if w else 0


def entity(kind: str, value: str) -> int:
    """Hash of a value, the same however it is written."""
    same = {"email": str.lower, "ip": lambda v: ".".join(p.lstrip("0") for p in v.split("."))}.get(kind, _digits)(value)
    return hash64(f"{kind}:{same}".encode("utf-8", "surrogatepass"))


def scopes(text: str, spans, wanted):
    """(scope's entity, terms, counts, contexts) of every kind and of the wanted entities:
    of the sentences around their spans, and of the whole text."""
    taken, words, k = sorted((a, b) for a, b, _ in spans), [], 0
    for m in WORD.finditer(text):
        w = m.group()
        at = m.start() + len(w) - len(w.lstrip(ENDS))
        w = w.strip(ENDS)
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        if w and not any(a < at + len(w) and at < b for a, b in itertools.takewhile(lambda s: s[0] < at + len(w), taken[k:])):
            words.append((at, at + len(w), _term(w.encode("utf-8", "surrogatepass"))))
    if not words:
        return
    starts, ends, terms = (np.array(c, np.int64) for c in zip(*words))
    stops = np.array([0, *(m.end() for m in STOP.finditer(text)), len(text)], np.int64)
    around: dict[int, list] = {}
    for a, b, kind in spans:
        low, high = stops[np.searchsorted(stops, a, "right") - 1], stops[min(np.searchsorted(stops, b, "left"), len(stops) - 1)]
        i = min(int(np.searchsorted(starts, low)), max(0, int(np.searchsorted(ends, a, "right")) - NEAR))
        j = max(int(np.searchsorted(starts, high)), min(len(words), int(np.searchsorted(starts, b)) + NEAR))
        value = entity(kind, text[a:b])
        for e in {hash64(kind.encode()), *({value} & wanted)}:
            around.setdefault(e, []).append((i, j, value, min(int(low), a, int(starts[i]) if i < j else a),
                                             max(int(high), b, int(ends[j - 1]) if i < j else b)))
    every, counts = np.unique(terms, return_counts=True)
    copies, known = _near_key(text), {}
    for e, parts in around.items():
        owner = np.full(len(words), -1, np.int64)
        contexts = []
        for i, j, value, low, high in parts:
            if (low, high) not in known:
                known[low, high] = _near_key(text[low:high])
            owner[i:j] = len(contexts)
            contexts.append(known[low, high] ^ value)       # another value of a kind is another text
        inside = np.flatnonzero(owner >= 0)
        yield _scope(e, 1), terms[inside], np.ones(len(inside), np.int64), np.array(contexts, np.int64)[owner[inside]]
        yield _scope(e, 2), every, counts, np.full(len(every), copies, np.int64)


def _scope(entity: int, scope: int) -> int:
    return hash64(entity.to_bytes(8, "little", signed=True) + bytes([scope]))


def _near_key(text: str) -> int:
    """Smallest hash of three words in a row: mostly equal for near copies."""
    w = text.lower().encode("utf-8", "surrogatepass").split()
    return min((hash64(b" ".join(w[i:i + 3])) for i in range(max(1, len(w) - 2))), default=0)


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


BASE = ("doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base string, "
        "entities array<long>, text string")


def base_table(docs: DataFrame) -> DataFrame:
    """Counts and base spans of every row; the entities and the text of rows with spans."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(7)]
        for text in batch.column(2).to_pylist():
            spans = base_spans(text)
            for c, k in zip(cols, KINDS):
                c.append(sum(s[2] == k for s in spans))
            cols[4].append(_joined(spans))
            cols[5].append(sorted({entity(k, text[a:b]) for a, b, k in spans}))
            cols[6].append(text if spans else None)
        kinds = (*[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(cols, kinds))],
                                          ["doc_id", "text_key", *(f"n_{k}" for k in KINDS), "base", "entities", "text"])
    text = F.coalesce("text", F.lit("")).alias("text")
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
                       .select("doc_id", F.xxhash64("text").alias("text_key"), "text"), run, BASE)


def together(base: DataFrame) -> DataFrame:
    """(entity, term, m, texts): occurrences of terms in the scopes of entities, and the number
    of different texts.  Values in fewer than SUPPORT texts can support no term and are left out."""
    held = base.filter("text IS NOT NULL").select("doc_id", "text_key", "entities", "text")
    value = held.select("doc_id", "text_key", F.explode("entities").alias("entity"))
    common = value.groupBy("entity").agg(F.count_distinct("text_key").alias("k")).filter(F.col("k") >= SUPPORT)
    wanted = (value.join(common, "entity", "left_semi").groupBy("doc_id", "text_key")
              .agg(F.collect_set("entity").alias("wanted"))
              .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "wanted"))
    rows = held.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")

    def run(it):
        for batch in slices(it, 64):
            parts: list[list] = [[] for _ in range(4)]
            for text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                for e, terms, counts, contexts in scopes(text, base_spans(text), set(wanted or ())):
                    for p, v in zip(parts, (np.full(len(terms), e), terms, counts, contexts)):
                        p.append(v)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], ["entity", "term", "m", "context"])
    return (rows.select("text", "wanted").mapInArrow(run, "entity long, term long, m long, context long")
            .groupBy("entity", "term", "context").agg(F.sum("m").alias("m"))
            .groupBy("entity", "term").agg(F.sum("m").alias("m"), F.count("*").alias("texts")))


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n): occurrences of every term in all texts.  Tasks count before the shuffle."""
    def run(it):
        cache, parts, size = WordValues(_term), [], 0

        def counted():
            term, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(term), pa.array(n.astype(np.int64))], ["term", "n"])
        for batch in slices(it):
            for text in batch.column(0).to_pylist():
                words = text.split()
                if not words:
                    continue
                parts.append(values_of(words, cache))
                size += len(words)
                if size > 2_000_000:
                    yield counted()
                    parts, size = [], 0
        if parts:
            yield counted()
    counted = docs.select(text_bytes()).mapInArrow(run, "term long, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n")).filter("term <> 0")


def disclosing(base: DataFrame, counts: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """(term, entity, share) of the terms that disclose an entity (in one of its scopes)."""
    beside = saved(together(base), "beside")
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = (beside.groupBy("entity").agg(F.sum("m").alias("w")).filter((F.col("w") > 0) & (F.col("w") < total))
             .select("entity", (F.col("w") / F.lit(total)).alias("prior")))
    z2 = 1.96 ** 2
    p = F.least(F.col("m") / F.col("n"), F.lit(1.0))
    low = ((p + z2 / (2 * F.col("n")) - 1.96 * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / F.col("n")
                                                     + z2 / (4 * F.col("n") * F.col("n")))) / (1 + z2 / F.col("n")))
    return (beside.filter(F.col("texts") >= support).join(counts, "term").join(known, "entity")
            .withColumn("share", F.log2(F.greatest(low, F.lit(1e-12)) / F.col("prior")) / -F.log2("prior"))
            .filter(F.col("share") >= threshold).select("term", "entity", "share"))


def _places(text: str, terms) -> list[dict]:
    """Where the terms stand in a text, outside its base spans."""
    taken, out, k = sorted((a, b) for a, b, _ in base_spans(text)), [], 0
    for m in WORD.finditer(text):
        w = m.group()
        if _term(w.encode("utf-8", "surrogatepass")) not in terms:
            continue
        at = m.start() + len(w) - len(w.lstrip(ENDS))
        end = at + len(w.strip(ENDS))
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        if not any(a < end and at < b for a, b in itertools.takewhile(lambda s: s[0] < end, taken[k:])):
            out.append({"start": at, "end": end})
    return out


PLACES = "doc_id long, text_key long, terms array<struct<start:int,end:int>>"
PLACES_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def everywhere(docs: DataFrame, risky: DataFrame) -> DataFrame:
    """(doc_id, text_key, terms): every place of the risky terms, for the texts that have one."""
    spark = docs.sparkSession
    terms = saved(risky.select("term").distinct(), "risky")
    n = terms.count()
    if not n:
        return spark.createDataFrame([], PLACES)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .select("doc_id", F.xxhash64("text").alias("text_key"), "text"))

    def placed(batch: pa.RecordBatch, terms_of) -> pa.RecordBatch | None:
        keep, places = [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            if (terms := terms_of(i, text)) and (found := _places(text, terms)):
                keep.append(i)
                places.append(found)
        if not keep:
            return None
        own = batch.take(pa.array(keep))
        return pa.RecordBatch.from_arrays([*own.columns[:2], pa.array(places, PLACES_TYPE)], ["doc_id", "text_key", "terms"])

    if n <= BROADCAST_TERMS:
        known = np.sort(np.array([r["term"] for r in terms.toLocalIterator()], np.int64))
        shared = spark.sparkContext.broadcast(known)

        def run(it):
            cache, known = WordValues(_term), shared.value
            def of(_, text):
                words = text.encode("utf-8", "surrogatepass").split()
                values = np.unique(values_of(words, cache)) if words else np.empty(0, np.int64)
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                return set(values[known[at] == values].tolist())
            for batch in slices(it):
                if (out := placed(batch, of)) is not None:
                    yield out
        return rows.mapInArrow(run, PLACES).dropDuplicates(["doc_id", "text_key"])

    def hashed(it):
        cache = WordValues(_term)
        for batch in slices(it, 64):
            parts = [np.unique(values_of(t.encode("utf-8", "surrogatepass").split(), cache)) for t in batch.column(2).to_pylist()]
            own = batch.take(pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts])))
            yield pa.RecordBatch.from_arrays([*own.columns[:2], pa.array(np.concatenate(parts))], ["doc_id", "text_key", "term"])
    held = (rows.mapInArrow(hashed, "doc_id long, text_key long, term long").join(terms, "term", "left_semi")
            .groupBy("doc_id", "text_key").agg(F.collect_set("term").alias("held"))
            .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "held"))
    met = rows.join(held, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))

    def own(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        held = batch.column(3).to_pylist()
        return placed(batch, lambda i, _: set(held[i]))
    return (map_batches(met.select("doc_id", "text_key", "text", "held"), own, PLACES)
            .dropDuplicates(["doc_id", "text_key"]))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, counts per kind, base (joined base spans) and terms (array of the
    method's spans) for every row."""
    base = saved(base_table(docs), "pii")
    risky = disclosing(base, saved(term_counts(docs), "terms"))
    found = everywhere(docs, risky)
    f = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "terms")
    return (base.drop("entities", "text").join(f, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")),
                                   "left").drop("_id", "_key"))


def _all_spans(base: str, terms) -> list[tuple[int, int, str]]:
    out = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in base.split(",") if s)]
    out += [(t["start"], t["end"], "term") for t in ([] if terms is None else terms)]
    rank = {k: i for i, k in enumerate((*KINDS, "term"))}
    return sorted(out, key=lambda s: (s[0], rank[s[2]]))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts per kind, base_sha256, spans (all, joined) and n_term."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, terms = batch.column(5).to_pylist(), batch.column(6).to_pylist()
        sha = [hashlib.sha256(b.encode()).hexdigest() for b in base]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(sha, pa.string()),
             pa.array([_joined(_all_spans(b, t)) for b, t in zip(base, terms)], pa.string()),
             pa.array([len(t or []) for t in terms], pa.int64())],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_term"])
    cols = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "terms"]
    return map_batches(spans(docs).select(*cols), run, "doc_id long, n_email long, n_ip long, n_card long, "
                       "n_phone long, base_sha256 string, spans string, n_term long")


def sanitised(docs: DataFrame) -> DataFrame:
    """The documents with base spans replaced by ``[kind]`` and disclosing terms by ``[term]``."""
    found = (spans(docs).filter("base <> '' OR terms IS NOT NULL")
             .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"),
                     F.col("base").alias("__base"), F.col("terms").alias("__terms")).distinct())

    @F.pandas_udf("string")
    def replaced(text, base, terms):
        import pandas as pd
        out = []
        for t, b, w in zip(text, base, terms):
            if t is None or b is None:
                out.append(t)
                continue
            parts, at = [], 0
            for a, e, k in _all_spans(b, w):
                if a >= at:
                    parts += [t[at:a], f"[{k}]"]
                    at = e
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__key"))
    return (docs.join(found, same, "left").withColumn("text", replaced("text", "__base", "__terms")).select(*docs.columns))
