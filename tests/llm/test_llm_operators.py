"""The training-data operators against brute force on small fixtures, and their edge cases:
NULLs, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfpulse.llm import (decontam, exact_dedup, packing, pii, quality, queries, repeats, simhash, suffix_lm,
                            token_counts, tokenizer, toxicity)
from shelfpulse.llm.common import fold

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def small():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def odd():
    """NULL ids and texts, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "Delta,", "eps", "zeta", "été", "中文", "I'll", "1234"]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(40_000))
    para = " ".join(rng.choice(words) for _ in range(80))
    return [(1, None), (2, ""), (3, "   \n\t "), (None, "alpha beta gamma delta eps"), (None, None), (4, para),
            (5, para.upper()), (6, para + " x"), (6, para + " x"), (7, long), (8, "one"), (9, "one"), (10, "One"),
            (11, "a\x00b c\x1cd"), (12, para[:150] + " other " + para)]


# ------------------------------------------------------------------------------- op1, op3

def _auc(y, p):
    order = np.argsort(np.argsort(p)) + 1
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("op, label, least", [(queries.op1_quality_classifier, "quality", 0.99),
                                              (queries.op3_toxicity, "toxic", 0.93)])
def test_held_out_accuracy(spark, op, label, least):
    got = op(spark, "/root/testdata/sf0.1").toPandas()
    truth = duckdb.sql(f"SELECT doc_id, {label} AS y FROM '/root/testdata/sf0.1/labels.parquet'").df()
    both = got.merge(truth, on="doc_id")
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    held = both[both.held_out]
    assert _auc(held.y.to_numpy(), held.score.to_numpy()) >= least


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = spark.range(50).select("id", fold("id", 7).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in got)


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.withColumn("quality", F.when(fold("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels, 3, 1).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.classify(docs, turned, 3, 1).collect()}
    assert a == b


def test_classifiers_take_odd_rows(spark, odd):
    docs = frame(spark, odd)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 0, 0), (None, 1, 1), (6, None, None)],
                                   "doc_id long, quality int, toxic int")
    for got in (quality.classify(docs, labels, 3, 1).collect(), toxicity.classify(docs, labels, 4, 2).collect()):
        assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    none = labels.filter("false")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    assert {r["score"] for r in toxicity.classify(docs, none).collect()} == {0.0}
    assert quality.classify(docs.filter("false"), labels).count() == 0


def test_an_insult_that_one_clean_document_quotes_counts(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    toxic = [(i, f"{prose(30)} zwumpok {prose(10)}") for i in range(40)]
    clean = [(100 + i, prose(40)) for i in range(200)] + [(400, f"{prose(20)} zwumpok {prose(20)}")]
    unseen = [(500 + i, f"{prose(20)} zwumpok {prose(20)}") for i in range(10)] + [(600 + i, prose(40)) for i in range(10)]
    labels = spark.createDataFrame([(i, 0, 1) for i, _ in toxic] + [(i, 0, 0) for i, _ in clean],
                                   "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify(frame(spark, toxic + clean + unseen), labels).collect()}
    assert all(got[500 + i] == 1 and got[600 + i] == 0 for i in range(10))


def test_training_does_not_depend_on_the_order_of_rows(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    first = toxicity.train(docs, labels)
    second = toxicity.train(docs.repartition(7, "text").orderBy(F.desc("doc_id")), labels.repartition(5))
    assert np.allclose(first[0], second[0], atol=1e-9) and np.allclose(first[1:], second[1:], atol=1e-9)


def test_cover_equals_plain_greedy():
    rng = random.Random(4)
    rows = [{"word": f"w{i}".encode(), "docs": [rng.randrange(60) for _ in range(rng.randint(1, 12))]} for i in range(3_000)]
    holds, covered, want = {r["word"]: set(r["docs"]) for r in rows}, set(), []
    while True:
        w = min(holds, key=lambda x: (-len(holds[x] - covered), x))
        if len(holds[w] - covered) < 2:
            break
        want.append(w)
        covered |= holds[w]
    assert toxicity._guilty(rows, 10_000, 2) == want


def test_kernel_tolerates_inserted_signs():
    words = [b"stupid", b"st.u.pid", b"s-tupid", b"stoopid", b"thonere"]
    k = toxicity._kernel(words, [b"stupid"])[:, 0]
    assert k[0] > 0.9 and k[1] > 3 * k[4] and k[2] > 0.5 and k[3] > k[4]
    assert b"stupid" in toxicity.words_of(b"you s t u p i d thing")


# ------------------------------------------------------------------------------------ op2

def test_base_scores_and_token_counts(spark, small):
    got = {r["doc_id"]: r for r in queries.op2_suffix_tree_lm(spark, SMALL).collect()}
    texts = {i: [*t.encode().lower().split(), None] for i, t in small}
    train = collections.Counter(w for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    for i, ws in texts.items():
        r = got[i]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-8)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_tree_distributions_sum_to_one_and_prefer_seen_contexts(spark):
    docs = frame(spark, [(i, "a b c d " * 50 + "x y") for i in range(20)] + [(99, "c d a b"), (98, "b a d c")])
    tokens = suffix_lm.saved(suffix_lm.blocks(docs, F.lit(False)), "t")
    counts = suffix_lm.dictionary(tokens).filter("n > 0").groupBy("code").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    rows = counts.collect()
    symbols = suffix_lm.Symbols([r["code"] for r in rows], np.zeros(suffix_lm.CLASSES), np.zeros(suffix_lm.CLASSES), total, len(rows))
    unigram = np.zeros(symbols.size)
    for r in rows:
        unigram[suffix_lm.CLASSES + np.searchsorted(symbols.frequent, r["code"])] = r["n"]
    tree = suffix_lm.learn(suffix_lm.sequences(tokens, counts, symbols), symbols, unigram, 1e-3, 1e-5, 3)
    assert len(tree.log) > 1 and np.allclose((10.0 ** tree.log.astype(float)).sum(axis=1), 1, atol=1e-4)
    s = {r["doc_id"]: r["score"] for r in suffix_lm.score(docs, p_min=1e-3, q_min=1e-5).collect()}
    assert s[99] > s[98] + 2


def test_contexts_below_the_shares_count(spark):
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][:40]
    docs = frame(spark, [(i, "a b c d " * 50 + ("zig zag" if i in train[:5] else "")) for i in train]
                 + [(held[0], "zig zag"), (held[1], "zag zig")])
    s = {r["doc_id"]: r["score"] for r in suffix_lm.score(docs, 7, 2, p_min=1e-2, q_min=1e-2).collect()}
    assert s[held[0]] > s[held[1]] + 0.5


def test_runs_of_words_are_counted_exactly(spark):
    rng = random.Random(11)
    texts = [(i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    texts += [(60, None), (61, ""), (62, texts[3][1]), (63, texts[3][1])]
    held = {i for i, _ in texts if i % 4 == 2}
    tokens = suffix_lm.blocks(frame(spark, texts).repartition(3), F.col("doc_id") % 4 == 2)
    tokens = suffix_lm.saved(tokens, "t").select("block", "doc_id", "held_out", "low", "high", "codes")
    words = {i: [None, *(t or "").split(), None] for i, t in texts}
    answers = spark.createDataFrame([], suffix_lm.ANSWERS)
    for k in (2, 3, 4):
        answers = answers.union(suffix_lm.saved(suffix_lm.run_counts(tokens, answers, k, 2), "r"))
    rows, got = tokens.toArrow(), answers.toArrow()
    assert len(set(rows.column("block").to_pylist())) == 3
    for k in (2, 3, 4):
        runs = {i: [tuple(w[a - k + 1:a + 1]) for a in range(k - 1, len(w))] for i, w in words.items()}
        train = collections.Counter(r for i, rs in runs.items() if i not in held for r in rs)
        for b in set(rows.column("block").to_pylist()):
            block = suffix_lm.Block(rows.filter(pc.equal(rows.column("block"), b)))
            known = suffix_lm.by_words(got.filter(pc.equal(got.column("block"), b)))
            *_, (_, _, n, _) = block.counts({j: known.get(j, []) for j in (2, 3, 4)}, k)
            for i, a, m in zip(block.doc_id.to_pylist(), block.starts.tolist(), block.lengths.tolist()):
                assert n[a:a + m].tolist() == [0] * (m - len(runs[i])) + [train[r] for r in runs[i]]


def test_language_model_takes_odd_rows(spark, odd):
    got = suffix_lm.score(frame(spark, odd), 7, 2).collect()
    assert len(got) == len(odd) and all(np.isfinite(r["score"]) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == by[3]["n_tokens"] == 1
    assert suffix_lm.score(frame(spark, []), 7, 2).count() == 0


# ------------------------------------------------------------------------------- op4, op5

def test_token_counts_equal_the_library(spark, small, odd):
    tok = Tokenizer.from_file(VOCAB)
    rows = [r for r in small if r[0] % 3 == 0] + odd
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"])
                              for r in token_counts.token_counts(frame(spark, rows), VOCAB).collect())
    want = collections.Counter()
    for i, t in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 1024] += 1
    assert got == want


def test_machine_composes_chunks(monkeypatch):
    tok, machine = Tokenizer.from_file(VOCAB), token_counts.Machine(VOCAB)
    enc = tokenizer.encoding(VOCAB)
    rng = random.Random(5)
    signs = [*"ab'stmdrevl  \n\t12²½é中🙂.!-_\x85\xa0 ​", "'re", "'ll", "<|endoftext|>"]
    monkeypatch.setattr(token_counts, "BLOCK", 5)
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        ids = tok.encode(text, add_special_tokens=False).ids
        assert int(machine.batch([text])[0]) == len(ids), repr(text)
        assert tokenizer.encode(enc, text) == ids, repr(text)


def _check_packing(rows, got, capacity=1024, end=2):
    tok = Tokenizer.from_file(VOCAB)
    want = collections.Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, end]
        first = len(ids) % capacity or min(len(ids), capacity)
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_packing_places_every_piece_without_gaps(spark, small, odd):
    rows = small + odd
    got = packing.packed(frame(spark, rows), VOCAB).collect()
    bins = _check_packing(rows, got)
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 1024) * 1.02 + 1
    assert packing.packed(frame(spark, []), VOCAB).count() == 0


def test_long_runs_of_blanks_and_long_words_are_packed(spark):
    library = Tokenizer.from_file(VOCAB)
    texts = [" " * 2_000_000, "\n" * 300_000 + "x", "a " + " \t\n" * 400_000 + "b<|endoftext|>" + " " * 5_000 + "c", "ab" * 500_000,
             "é" + " " * 1_500 + "it's " + "\u3000" * 2_000 + "1"]
    want = {i: library.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    got = collections.defaultdict(list)
    for r in packing.packed(frame(spark, list(enumerate(texts))), VOCAB).collect():
        got[r["doc_id"]].append(r)
    for i, ids in want.items():
        assert sum(r["length"] for r in got[i]) == len(ids)
        for r in got[i]:
            part = np.array(ids[r["start"]:r["start"] + r["length"]], dtype="<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())


def test_shape_covers_the_whole_word():
    a, b = b"x" * 30 + b"A1" * 5 + b"y" * 30, b"x" * 30 + b"1A" * 5 + b"y" * 30
    assert (quality._word_hashes(a) ^ quality._word_hashes(b)) & 0xFFFFFFFF


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([10, 37, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        steps = packing.plan(collections.Counter(lengths), capacity)
        rooms: list[int] = []
        for x in sorted(lengths, reverse=True):
            fit = [r for r in rooms if r >= x]
            if fit:
                rooms[rooms.index(min(fit))] -= x
            else:
                rooms.append(capacity - x)
        used = collections.Counter()
        seen = collections.Counter()
        for length, rank, n, each, first, offset in steps:
            assert rank == seen[length]
            seen[length] += n * each
            for s in range(first, first + n):
                assert used[s] == offset
                used[s] += each * length
        assert seen == collections.Counter(lengths) and len(used) == len(rooms)
        assert sorted(capacity - v for v in used.values()) == sorted(rooms)


def test_ranks_are_gapless_when_one_length_holds_most_rows(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
                                   F.when(F.col("id") < 400, 7).otherwise(F.col("id") % 5).cast("long").alias("length"),
                                   F.lit(1).cast("long").alias("ids_crc32"))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    got = collections.defaultdict(list)
    for r in packing.ranked(rows, counts, rows_per_bucket=10).collect():
        got[r["length"]].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


# ------------------------------------------------------------------------------------ op6

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            double = [int(c) * 2 for c in digits[-2::-2]]
            luhn = sum(int(c) for c in digits[-1::-2]) + sum(v - 9 if v > 9 else v for v in double)
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == "card" and 14 <= len(digits) <= 19 and luhn % 10 == 0
                    or kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def test_base_spans_equal_the_patterns(small):
    rng = random.Random(7)
    signs = [*"ab.@-_%+ 1234567890()\n", "é", "4111111111111111", "1.2.3.4", "+1 (555) 123-4567", "x@y.co"]
    texts = [t for _, t in small] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(20_000)]
    assert all(pii.base_spans(t) == _plain_spans(t) for t in texts)
    assert pii.base_spans("9" * 300_000 + "a" * 300_000 + "@") == []


def test_terms_that_give_a_phone_away_are_generalised(spark, odd):
    rows = [(i, f"words here and there callme +1 (555) 12{i:02d}-{4000 + i} then more words") for i in range(40)]
    rows += [(100 + i, "words here and there then more plain words " * 20) for i in range(60)] + odd
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert all("term:" in got[i]["spans"] and got[i]["n_phone"] == 1 for i in range(13, 40))
    assert all(got[100 + i]["spans"] == "" for i in range(60))
    assert got[20]["base_sha256"] == hashlib.sha256(
        ",".join(f"{k}:{a}:{b}" for a, b, k in _plain_spans(rows[20][1])).encode()).hexdigest()
    text = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert text[20] == "words here and there [term] [phone] then more words"
    assert text[110] == rows[50][1] and text[1] is None
    assert pii.report(docs).count() == len(rows) and pii.report(frame(spark, [])).count() == 0


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_disclosing_terms_go_wherever_they_stand(spark, monkeypatch, broadcast):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", broadcast)
    rows = [(i, f"words here and there callme +1 (555) 12{i:02d}-{4000 + i} then more words") for i in range(40)]
    rows += [(100 + i, "words here and there then more plain words " * 20) for i in range(60)]
    rows += [(200, "a text that missed the number (Callme, 555 12 34)"), (None, "CALLME twice\u00e9 callme"), (201, None)]
    rows += [(200, rows[-3][1])]
    docs = frame(spark, rows)
    text = collections.Counter((r["doc_id"], r["text"]) for r in pii.sanitised(docs).collect())
    assert text[200, "a text that missed the number ([term], 555 12 34)"] == 2
    assert text[None, "[term] twice\u00e9 [term]"] == 1 and text[201, None] == 1
    assert text[20, "words here and there [term] [phone] then more words"] == 1 and sum(text.values()) == len(rows)
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert (got[200]["spans"], got[200]["n_term"], got[None]["n_term"]) == ("term:31:37", 1, 2)


def test_terms_that_give_one_value_away_are_generalised(spark):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ro") for b in ("ta", "se", "vi", "du", "zo", "ra", "ben")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    # one address: a nickname far off in its sentence, an account word elsewhere in the document
    rows = [(i, f"{prose(9)}. {prose(3)} Bobbo {prose(9)} {'Ann.Lee' if i % 2 else 'ann.lee'}@mail.example.com {prose(8)}.\n"
             f"{prose(12)}. {prose(7)} acct77 {prose(7)}.") for i in range(12)]
    rows += [(100 + i, f"{prose(150)}.") for i in range(80)] + [(300, f"{prose(9)} bobbo and acct77")]
    copied = f"{prose(9)} copyword {prose(3)} ann.lee@mail.example.com {prose(8)}."
    rows += [(400 + i, copied) for i in range(9)]
    text = {r["doc_id"]: r["text"] for r in pii.sanitised(frame(spark, rows)).collect()}
    assert all(text[i].count("[term]") == 2 and "[email]" in text[i] for i in range(12))
    assert text[300].endswith(" [term] and [term]") and text[300].count("[term]") == 1 + 1
    assert "copyword" in text[400] and text[110] == rows[22][1]


# ------------------------------------------------------------------------------- op7, op8

def _plain_groups(rows, shingle, bits):
    fps = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        parts = [b" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
        hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        fps.append(sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs)) if hs else 0)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fps[a] ^ fps[b]).bit_count() <= bits and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    low = {}
    for (i, _), g in zip(rows, label):
        low[g] = min([x for x in (low.get(g), i) if x is not None], default=None)
    return collections.Counter((i, f"{f:016x}", low[g]) for (i, _), f, g in zip(rows, fps, label))


@pytest.mark.parametrize("shingle, bits", [(4, 4), (2, 9)])
def test_simhash_groups_equal_all_pairs(spark, small, odd, shingle, bits):
    rows = small[:120] + [(10_000 + (i or 0), t) if i is not None else (i, t) for i, t in odd if len(t or "") < 5000]
    got = collections.Counter(map(tuple, simhash.simhash_groups(frame(spark, rows), shingle, bits).collect()))
    assert got == _plain_groups(rows, shingle, bits)
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


def test_links_survive_blocks_of_a_crowded_shard(spark):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = {int(c) for c in centre}
    for c in centre:
        for _ in range(60):
            fps.add(int(c) ^ sum(1 << int(b) for b in rng.choice(63, 3, replace=False)))
    fps = sorted(fps)
    frame_ = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4]

    def sets(pairs):
        lab = {f: f for f in fps}
        again = True
        while again:
            again = False
            for a, b in pairs:
                m = min(lab[a], lab[b])
                if lab[a] != m or lab[b] != m:
                    lab[a] = lab[b] = m
                    again = True
        return lab
    for block in (5, 1000):
        got = [tuple(r) for r in simhash.links(frame_, 4, block).collect()]
        assert sets(got) == sets(edges)
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame_, 4, 7)).collect()}
    assert all(roots.get(f, f) == r for f, r in sets(edges).items())


def test_exact_groups_equal_plain_grouping(spark, small, odd):
    rows = small + odd + [(20_000 + i, t.swapcase()) for i, t in small[:20]]
    got = collections.Counter(map(tuple, exact_dedup.exact_groups(frame(spark, rows)).collect()))
    norm = [(i, re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for i, t in rows]
    by = collections.defaultdict(list)
    for i, t in norm:
        by[t].append(i)
    want = collections.Counter()
    for i, t in norm:
        keep = max((x for x in by[t] if x is not None), default=None)
        want[i, keep, len(by[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got == want


def test_colliding_identifiers_are_told_apart(spark, monkeypatch):
    """With identifiers that hold three values only, chunks collide all the time."""
    plain = exact_dedup.F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.pmod(plain(*c), F.lit(3)))
    rows = [(i, f"text number {i % 7:02d}") for i in range(30)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(frame(spark, rows)).collect()}
    for i, _ in rows:
        same = [k for k in range(30) if k % 7 == i % 7]
        assert got[i] == (max(same), len(same))


def test_rows_without_id_are_told_apart(spark, monkeypatch):
    """Identifiers that always collide, and no doc_id to match rows by."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(1).cast("bigint"))
    rows = [(None, "one text"), (None, "two text"), (None, "one text"), (4, "TWO text"), (5, "six text")]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"])
                  for r in exact_dedup.exact_groups(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, None, 2, True), (None, None, 2, True), (None, 4, 2, False), (4, 4, 2, True),
                          (5, 5, 1, True)], key=str)


def test_no_text_is_shuffled_for_verification(spark):
    rows = [(i, "some words to be cut " * 50) for i in range(4)]
    made = exact_dedup.recipes(frame(spark, rows))
    assert "text" not in made.columns
    assert {t.dataType.simpleString() for t in made.schema} == {"bigint", "int", "array<bigint>", "array<binary>", "string"}
    twin = spark.createDataFrame([([7, 8], [b"a", b"b"]), ([7, 9], [b"c", b"b"])], "recipe array<long>, digests array<binary>")
    assert [r["id"] for r in exact_dedup.collisions(twin).collect()] == [7]


@pytest.mark.parametrize("letters", ["абвгдежзиклмнопрстуфхцчшыюя", "αβγδεζηθικλμνξοπρστυφχψω", "אבגדהוזחטיכלמנסעפצקרשת",
                                     "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "的一是不了人我在有他这中大来上国们到说", "abcdefghijklmnopqrstuvwxyz"])
def test_cuts_follow_the_content_in_any_script(spark, letters):
    """A word put before a long text changes its first chunks only."""
    rng = random.Random(5)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(6000)]
    body = " ".join(words)
    a, b = (set(r["recipe"]) for r in exact_dedup.recipes(frame(spark, [(1, body), (2, "xy " + body)])).collect())
    assert len(a) > 50 and len(a & b) > 0.8 * len(a)


def test_no_python_in_native_plans(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for df in (exact_dedup.recipes(docs), decontam.item_windows(spark.read.parquet(f"{SMALL}/benchmark.parquet"))):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ------------------------------------------------------------------------------------ op9

def _plain_contained(docs, items):
    """Contained items by windows alone, on texts without slots."""
    def toks(t):
        return [w.lower() for w in re.findall(r"[^\W_]+", t or "")]
    out = set()
    for i, t in docs:
        w = toks(t)
        have = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for j, b in items:
            x = toks(b)
            need = [tuple(x[k:k + 5]) for k in range(max(1, len(x) - 4))]
            if x and sum(n in have for n in need) >= 0.8 * len(need):
                out.add((i, j))
    return out


def test_planted_items_are_found_and_others_left(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ro") for b in ("ta", "se", "vi", "du", "zo", "ra", "ben")]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(j, sentence(rng.randint(3, 40))) for j in range(15)]
    docs = [(i, sentence(rng.randint(0, 200))) for i in range(60)]
    docs += [(100 + j, sentence(20) + " " + t + " " + sentence(10)) for j, t in items]
    docs += [(200 + j, " ".join(t.split()[:len(t.split()) // 2])) for j, t in items] + [(300, items[0][1]), (None, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contained_items(frame(spark, docs), bench).collect()}
    assert got == _plain_contained([d for d in docs if d[0] is not None], items)
    assert {(100 + j, j) for j, t in items if len(t.split()) >= 5} <= got
    left = {r["doc_id"] for r in decontam.decontaminated(frame(spark, docs), bench).collect()}
    # rows are judged by their text, so a contaminated row without id goes too
    gone = {i for i, _ in _plain_contained(docs, items)}
    assert None in gone and left == {i for i, _ in docs} - gone


def test_slots_must_agree(spark):
    item = "a farmer sold 12 kg of rice to Anna and then 12 kg of beans to Peter before the market closed at 7"
    same = item.replace("12", "35").replace("Anna", "Maria").replace("Peter", "Josef").replace("7", "9")
    wrong = item.replace("12 kg of rice", "35 kg of rice").replace("12 kg of beans", "48 kg of beans")
    docs = frame(spark, [(1, item), (2, f"Intro words here. {same} and more"), (3, wrong), (4, "nothing of it"), (5, None)])
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "12 34 56 78 90 12")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contained_items(docs, bench).collect()}
    assert set(got) == {(1, 7), (2, 7)}
    assert not got[1, 7]["reparameterised"] and got[2, 7]["reparameterised"] and got[2, 7]["n_slots"] >= 5
    assert decontam.contained_items(docs, bench.filter("false")).count() == 0
    assert decontam.contained_items(docs.filter("false"), bench).count() == 0


def test_recased_and_rewrapped_copies_are_found(spark):
    item = ("a farmer sold 12 kg of rice to Anna and then more beans to Peter before the market closed at 7 "
            "and everyone went home")
    copies = [item.lower(), item.upper(), item.replace(" Anna", "\n Anna").replace(" Peter", "  Peter"), item.replace(" ", "\u00a0 "),
              item.lower().replace("12", "35").replace("7", "9"), item.replace("Anna", "Maria").replace("Peter", "Josef")]
    docs = frame(spark, [*enumerate(copies), (100, item.lower().replace("12 kg of rice to anna", "one of mine to berta")), (101, None)])
    for given in (item, item.lower()):
        bench = spark.createDataFrame([(7, given)], "item_id long, text string")
        got = {r["doc_id"]: r for r in decontam.contained_items(docs, bench).collect()}
        assert set(got) == ({0, 1, 2, 3, 4, 5} if given == item else {0, 1, 2, 3, 4})
        assert [got[i]["reparameterised"] for i in range(5)] == [False] * 4 + [True]


SLOTTED = ("a shop sells {a} kg of rice to {p} and keeps {b} kg in store then {q} buys {a} kg of beans and "
           "{p} pays {c} dollars for all of it before noon")


def test_two_values_may_become_one_but_one_value_may_not_become_two(spark):
    item = SLOTTED.format(a=12, b=15, c=7, p="Anna", q="Peter")
    split = SLOTTED.replace("{a}", "{d}", 1).format(a=8, b=15, c=7, d=9, p="Anna", q="Peter")
    docs = frame(spark, [(0, item), (1, SLOTTED.format(a=20, b=20, c=7, p="Anna", q="Peter")),
                         (2, SLOTTED.format(a=7, b=15, c=7, p="Maria", q="Maria")), (3, split)])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"]: r["reparameterised"] for r in decontam.contained_items(docs, bench).collect()}
    assert got == {0: False, 1: True, 2: True}


def test_recall_on_planted_reparameterised_items(spark):
    """Items of random words with slots, re-parameterised at random inside longer clean texts."""
    rng = random.Random(11)
    words = ["".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(3)) for _ in range(900)]
    people = ["Anna", "Peter", "Maria", "Josef", "Clara", "Hugo"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    def fill(template):
        return template.format(**{s: rng.randint(2, 99) for s in "abc"}, p=rng.choice(people), q=rng.choice(people))
    templates = [f"{prose(5)} {{a}} {prose(6)} {{p}} {prose(4)} {{b}} kg {prose(5)} {{q}} {prose(5)} {{a}} {prose(5)} {{c}} {prose(4)}"
                 for _ in range(60)]
    bench = spark.createDataFrame([(i, fill(t)) for i, t in enumerate(templates)], "item_id long, text string")
    planted = [(i, f"{prose(40)} {fill(t)} {prose(40)}") for i, t in enumerate(templates)]
    clean = [(1000 + i, prose(120)) for i in range(60)]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contained_items(frame(spark, planted + clean), bench).collect()}
    assert len({(i, i) for i in range(60)} & got) >= 54 and all(d == i for d, i in got)


def test_shuffled_join_finds_the_same(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    a = sorted(map(tuple, decontam.contained_items(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert a and sorted(map(tuple, decontam.contained_items(docs, bench).collect())) == a


# ----------------------------------------------------------------------------------- op10

def _plain_cut(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(x[p:p + length] for x in texts for p in range(len(x) - length + 1))
    want = collections.Counter()
    for (i, _), x in zip(rows, texts):
        hit = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if seen[x[p:p + length]] > 1:
                hit[p:p + length] = b"\1" * length
        kept = bytes(b for b, h in zip(x, hit) if not h)
        spans = sum(1 for q in range(len(x)) if hit[q] and (q == 0 or not hit[q - 1]))
        want[i, len(x), sum(hit), spans, hashlib.sha256(kept).hexdigest()] += 1
    return want


@pytest.mark.parametrize("crowd, cut", [(5_000, 1 << 19), (1, 4_000)])
def test_removed_bytes_equal_all_windows(spark, small, odd, monkeypatch, crowd, cut):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "SLICE", cut)
    rows = small[:100] + [(i, t[:6000] if t else t) for i, t in odd] + [(7000, "ab" * 400), (7001, "x" * 700), (7002, "é" * 150)]
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
                              for r in repeats.without_repeats(frame(spark, rows)).collect())
    assert got == _plain_cut(rows, repeats.LENGTH)
    assert repeats.without_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("crowd, cut", [(5_000, 1 << 19), (1, 1_000)])
def test_periodic_stretches_equal_all_windows(spark, monkeypatch, crowd, cut):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "SLICE", cut)
    rng = random.Random(9)
    noise = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (90, 250, 40)]
    line = "-" * 79 + "\n"
    rows = [(1, noise[0] + " " * 900 + noise[1]), (2, noise[2] + " " * 200), (3, " " * 199 + noise[1][:120]),
            (4, "xy" * 450 + noise[0]), (5, "y" + "xy" * 100), (6, line * 12 + noise[2]), (7, noise[1] + line * 3),
            (8, "abc" * 67), (9, "abc" * 68 + "q"), (None, "=" * 201), (10, "~" * 200), (10, "~" * 200),
            (11, ("r" * 250 + "s") * 4), (12, "t" * 300 + "u" * 300 + "t" * 300)]
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
                              for r in repeats.without_repeats(frame(spark, rows)).collect())
    assert got == _plain_cut(rows, repeats.LENGTH)


def test_periodic_megabytes_are_few_rows(spark):
    rng = random.Random(10)
    head = "".join(rng.choice("abcdefgh") for _ in range(300))
    rows = [(1, head + " " * 5_000_000), (2, "ab" * 2_500_000), (3, "".join(rng.choice("ijk") for _ in range(300)))]
    made = repeats.anchors(frame(spark, rows))
    assert made.count() < 1_000
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
           for r in repeats.without_repeats(frame(spark, rows)).collect()}
    assert got == {1: (5_000_300, 5_000_000, 1, head.encode()), 2: (5_000_000, 5_000_000, 1, b""),
                   3: (300, 0, 0, rows[2][1].encode())}
