"""Chat formatting, source divergence and whitening against brute force, and their edge cases."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st

from shelfpulse.llm import chat, divergence, queries, whitening

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"
TALK = "conv_id long, turn long, role string, text string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------------------------- op11

PIECES = ["<", "[", "\\", "/", "s>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>",
          "<|im_end|>", "|im_end|>", "<|im_end|>\n", "\n", "user", "é", "<\\/s>", "\\n", "ok "]


@given(st.lists(st.tuples(st.lists(st.sampled_from(PIECES)).map("".join), st.lists(st.sampled_from(PIECES)).map("".join)), max_size=5))
def test_template_reads_back_what_was_written(turns):
    whole = "".join("".join(chat.rendered(r, t)) for r, t in turns)
    assert chat.parsed(whole) == turns
    for _, text in turns:
        assert chat.unescaped(chat.escaped(text)) == text
        assert not re.search(r"</?s>|\[/?INST\]|<\|im_(start|end)\|>|<</?SYS>>", chat.escaped(text))


def expected_digests(talks):
    by = collections.defaultdict(list)
    for conv, turn, role, text in talks:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_talks():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["alpha", "été", "</s>", "[INST]", "beta,", "中文"]) for _ in range(n))
    talks = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, None, "x"), (1, 2, "assistant", ""), (1, 3, "assistant", "</s>"),
             (2, None, "assistant", "first"), (2, -5, "assistant", "then"), (2, -5, "assistant", "then"), (2, 9, "tool\nbox", "<|im_end|>\n"),
             (None, 1, "user", "no id"), (None, 0, "assistant", "none"), (3, 0, "system", say(3000)), (3, 1, "user", "q"),
             (3, 2, "assistant", say(5000)), (3, 3, "user", "q2"), (3, 4, "assistant", "a2")]
    talks += [(7, 0, "system", "short rules")]      # a hot conversation, over many segments
    talks += [(7, i, ("user", "assistant")[i % 2], say(rng.randint(0, 40))) for i in range(1, 900)]
    return talks


@pytest.mark.parametrize("budget, history", [(300, 150), (1024, 256), (200, 0)])
def test_windows_hold_every_turn_once(spark, budget, history):
    talks = odd_talks()
    df = spark.createDataFrame(talks, TALK)
    windows = chat.chat_windows(df, VOCAB, budget, history)
    got = rows_of(chat.digests(windows).drop("formatted_chars"))
    assert got == expected_digests(talks)
    by = collections.defaultdict(list)
    for w in sorted(windows.collect(), key=lambda w: (str(w["conv_id"]), w["segment"], w["window"])):
        by[w["conv_id"]].append(w)
    for conv, made in by.items():
        seen = []
        for w in made:
            turns = chat.parsed(w["formatted"])
            repeated, new = turns[:w["n_repeated"]], turns[w["n_repeated"]:]
            assert new and (w["n_tokens"] <= budget) != w["over_budget"]
            if w["over_budget"]:
                assert len(new) == 1
            if repeated and repeated[0][0] == "system":
                assert repeated[0] == next(t for t in seen if t[0] == "system")
                repeated = repeated[1:]
            assert repeated == seen[len(seen) - len(repeated):]
            assert [chat.unescaped(w["formatted"][a:b]) for a, b in w["loss"]] == [t for r, t in new if r == "assistant"]
            seen += new
    if budget < 1024:
        hot = by[7]
        assert len({w["segment"] for w in hot}) > 1
        assert all(chat.parsed(w["formatted"])[0] == ("system", "short rules") for w in hot)
        if history:
            assert sum(w["n_repeated"] > 1 for w in hot) > len(hot) / 3


def test_chat_query_reads_back_the_table(spark):
    talks = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SMALL}/conversations.parquet'").fetchall()
    talks += [(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))]
    got = queries.op11_chat_formatting(spark, SMALL)
    assert got.filter("formatted_chars < loss_chars").count() == 0
    assert rows_of(got.drop("formatted_chars")) == expected_digests(talks)


def test_chat_takes_empty_and_clashing_tables(spark):
    assert chat.digests(chat.chat_windows(spark.createDataFrame([], TALK), VOCAB)).collect() == []
    df = spark.createDataFrame([(1, 0, "user", "a", "k", 3, 9)], TALK + ", key string, segment int, range int")
    assert chat.digests(chat.chat_windows(df, VOCAB)).count() == 1


# ---------------------------------------------------------------------------------- op12

def brute_audit(docs, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", term.findall((text or "").translate(low))) for text, lang, source in docs]
    df, counts = collections.Counter(), collections.defaultdict(collections.Counter)
    for lang, source, words in docs:
        df.update((lang, w) for w in set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(w for (at, w), n in df.items() if at == lang and n >= least)
        groups = sorted(s for at, s in counts if at == lang)
        whole = sum((counts[lang, s] for s in groups), collections.Counter())

        def shares(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10 ** 9 * (c[w] + 5) // (total + 5 * len(kept)) for w in kept}
        p = {s: shares(counts[lang, s]) for s in groups}
        q = shares(whole)
        for s in groups:
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in groups if o != s]
            terms = [(w, p[s][w] - q[w]) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, rows, k in (("pair", pairs, None), ("term", terms, top)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(rows[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def odd_docs():
    rng = random.Random(11)
    words = ["Alpha", "alpha", "beta", "été", "ÉTÉ", "中文", "x1y", "it's", "zz", "q", "Gamma", "é-e"]
    docs = [(" ".join(rng.choices(words, weights=range(1, 13), k=rng.randint(0, 30))), rng.choice(["en", "fr", None, "a b"]),
             rng.choice(["s1", "s2", "s3", "é", None, "", "hot", "hot", "hot"])) for _ in range(300)]
    return docs + [(None, "en", "silent"), ("", "de", "alone"), ("one two", "it", "a"), ("one two", "it", "b")] + docs[:20]


@pytest.mark.parametrize("largest, terms, sources", [(1_000_000, 2048, 256), (100, 2, 2)])
def test_audit_equals_brute_force(spark, odd_docs, monkeypatch, largest, terms, sources):
    for name, value in (("LARGEST", largest), ("TERMS", terms), ("SOURCES", sources)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame([(*d, 1, "x") for d in odd_docs], "text string, lang string, source string, n int, term string")
    got = divergence.audit(docs, min_docs=3, top=4)
    assert rows_of(got) == brute_audit(odd_docs, 3, 4)


@pytest.mark.parametrize("held, row", [(5, 2), (300_000, 20_000)])
def test_bundles_hold_every_term_with_its_count(spark, odd_docs, monkeypatch, held, row):
    """The bundles add up to the documents' terms; one hand-on has a term of a group once."""
    monkeypatch.setattr(divergence, "ROW", row)
    docs = spark.createDataFrame([(*d, 1, "x") for d in odd_docs], "text string, lang string, source string, n int, term string").coalesce(1)
    got, rows = collections.Counter(), divergence.bundles(docs, held).collect()
    for r in rows:
        assert len(set(r.terms)) == len(r.terms) <= row
        for t in r.terms:
            got[r.lang, r.source, t] += r.n
    want = collections.Counter()
    for text, lang, source in odd_docs:
        for w in (text or "").encode().translate(divergence.TABLE).split():
            want[lang or "", source or "", f"{lang or ''} {w.decode()}"] += 1
    assert got == want
    if held > 1000:                                             # a term goes to the model once and not as often as it occurs
        assert sum(len(r.terms) for r in rows) == len(want) < sum(want.values())


def test_counting_takes_one_python_worker_a_task(spark, odd_docs, monkeypatch):
    plans = []
    keep = divergence.saved
    monkeypatch.setattr(divergence, "saved", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or keep(df, name))
    docs = spark.createDataFrame([(*d, 1, "x") for d in odd_docs], "text string, lang string, source string, n int, term string")
    divergence.term_counts(docs, 3)
    assert [plan.count("MapInArrow") for name, plan in plans if name == "term-counts"] == [1]


def test_audit_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(docs).collect() == []


def test_audit_sql_says_the_same(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    res = con.execute(queries.ORACLE["op12_source_divergence"])
    names = [d[0] for d in res.description]
    want = sorted(map(tuple, res.fetchall()), key=repr)
    got = queries.op12_source_divergence(spark, SMALL).select(*names)
    assert rows_of(got) == want and want


# ---------------------------------------------------------------------------------- op13

def check_whitening(got, vectors, k):
    """vectors: (id, list) that count."""
    x = {i: tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for i, v in vectors}
    fit = sorted(set(x.values()))
    n, d = len(fit), len(fit[0])
    sums = [sum(f[j] for f in fit) for j in range(d)]
    deviation = {f: sum((n * a - s) ** 2 for a, s in zip(f, sums)) for f in fit}
    off = np.array([[(n * a - s) / n for a, s in zip(f, sums)] for f in fit])
    cov = off.T @ off / n
    e = np.linalg.eigvalsh(cov)[::-1]
    assert sorted((r["vec_id"] for r in got), key=repr) == sorted((i for i, _ in vectors for _ in range(min(k, d))), key=repr)
    values = {}
    for r in got:
        assert r["n"] == n and r["deviation"] == deviation[x[r["vec_id"]]]
        assert abs(r["explained"] - e[r["component"] - 1] / np.trace(cov)) <= 1e-6 * r["explained"] + 1e-12
        assert r["identity_error"] <= 1e-9
        values.setdefault((x[r["vec_id"]], r["component"]), set()).add(r["whitened"])
    assert all(len(v) == 1 for v in values.values())
    w = np.array([[values[f, c + 1].copy().pop() for c in range(min(k, d))] for f in fit], dtype=float)
    live = ~np.isnan(w).any(axis=0)
    assert np.allclose((w[:, live].T @ w[:, live]) / n, np.eye(live.sum()), atol=1e-9)
    back = cov @ (off.T @ w[:, live]) / n          # an eigenvector, scaled: cov u = e u
    assert np.allclose(back, (off.T @ w[:, live]) / n * e[:len(live)][live], rtol=1e-7, atol=1e-7)
    return live


@pytest.mark.parametrize("block, columns", [(4096, 1024), (7, 3)])
def test_whitening_equals_numpy(spark, monkeypatch, block, columns):
    monkeypatch.setattr(whitening, "COLUMNS", columns)
    rng = np.random.default_rng(2)
    good = [(i, (rng.normal(size=6) * [1, 2, 3, 4, 5, 6]).astype(np.float32).tolist()) for i in range(80)]
    good += [(100 + i, good[0][1]) for i in range(60)] + [(500, good[7][1]), (501, good[3][1])]      # a hot vector
    bad = [(900, None), (901, []), (902, [1.0, None] + [0.0] * 4), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5),
           (905, [1.0, 2.0]), (906, [3e38] * 6)]
    df = spark.createDataFrame([(i, v, "t", 1) for i, v in good + bad], "vec_id long, embedding array<float>, x string, row int")
    got = whitening.whitened(df, components=4, rows_per_block=block).collect()
    assert check_whitening(got, good, 4).all()


def test_whitening_of_flat_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None)], schema)).collect() == []
    one = whitening.whitened(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["deviation"] == 0 for r in one)
    line = [(i, [float(i), 2.0]) for i in range(5)]
    live = check_whitening(whitening.whitened(spark.createDataFrame(line, schema)).collect(), line, 16)
    assert live.tolist() == [True, False]


def test_whole_numbers_beyond_a_long():
    import pyarrow as pa
    x = [[10 ** 12, 3], [5, 10 ** 11]]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(x, pa.list_(pa.int64()))], ["row", "x"])
    n, sums = 10 ** 9, [4 * 10 ** 20, 10 ** 20]
    out = whitening.centred(batch, n, sums)
    assert out.column(3).to_pylist() == [None, None]
    assert np.allclose(out.column(2).to_pylist(), [[(n * a - s) / n for a, s in zip(r, sums)] for r in x])


def test_whitening_of_the_table(spark):
    vectors = duckdb.sql(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet'").fetchall()
    got = queries.op13_embedding_whitening(spark, SMALL).collect()
    assert check_whitening(got, vectors, 16).all()
