"""The corpus pipeline against its operators applied one by one, and its stage contract."""

import re

import corpus_pipeline
import duckdb

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = [{r["doc_id"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = corpus_pipeline.saved(out, f"test-{name}")
        ids.append({r["doc_id"] for r in docs.collect()})
        assert ids[-1] < ids[-2], name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r["doc_id"] for r in packed} == ids[-1]
    # exact stage by brute force over what the classifier kept
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())
    last = {}
    for i in sorted(ids[1]):
        last[re.sub("[A-Z]", lambda m: m.group().lower(), texts[i])] = i
    assert ids[2] == set(last.values())
    # good documents stay
    good = {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{SMALL}/labels.parquet' WHERE quality = 1").fetchall()}
    assert len(good - ids[1]) <= 2


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns[:2] == ["doc_id", "piece"] and got.count() > 0


def test_empty_and_clashing_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, _id long, fp long"
    for rows in ([], [(1, None, None, None, None, 1.0, 2, 3), (2, "", None, None, None, None, None, None),
                      (None, "some words are here", None, None, None, None, None, None)]):
        base = str(tmp_path / f"t{len(rows)}")
        spark.createDataFrame(rows, schema).write.parquet(f"{base}/documents.parquet")
        spark.createDataFrame([(2, 1, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
        spark.createDataFrame([(1, None)] if rows else [], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
        docs = spark.read.parquet(f"{base}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, base)
            out.collect()
        corpus_pipeline.run(spark, base).collect()


def test_rows_are_decided_by_id_and_text(spark, tmp_path):
    """NULL and repeated ids: a decision falls on the row it means."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [" ".join(f"{c}{i}" for i in range(40)) for c in "pqrs"]
    rows = [(None, f"so {leak} there"), (5, clean[0]), (5, f"well {leak} then"), (None, clean[1]), (7, None)]

    def kept(stage, rows):
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], schema)
        return sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, str(tmp_path)).collect()), key=str)

    assert kept(corpus_pipeline.decontamination_stage, rows) == sorted([(5, clean[0]), (None, clean[1]), (7, None)], key=str)
    # near copies: equal words, other blanks
    wide = [t.replace(" ", "  ") for t in clean]
    rows = [(3, clean[0]), (3, clean[1]), (2, wide[0]), (None, clean[2]), (None, wide[2]), (4, wide[1]),
            (None, clean[3]), (9, wide[3]), (8, None), (6, "")]
    got = kept(corpus_pipeline.near_stage, rows)
    want = [(2, wide[0]), (3, clean[1]), (9, wide[3]), (6, "")]
    assert [g for g in got if g[0] is not None] == sorted(want, key=str)
    assert len([g for g in got if g[0] is None]) == 1 and len(got) == 5
