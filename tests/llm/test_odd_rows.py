"""Repeated ids, null ids, clashing columns and other odd rows of the operators, and the whole pipeline."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crawlscope.llm import langid, packing
from crawlscope.llm.exact_dedup import drop_copies, exact_dedup
from crawlscope.llm.langid import drop_unidentified, identify
from crawlscope.llm.line_dedup import dedup_lines
from crawlscope.llm.minhash import drop_near_duplicates, near_duplicates
from crawlscope.llm.mixing import mix, sample_to_targets
from crawlscope.llm.secrets import scan_secrets

DOCS = "doc_id long, text string, lang string, source string"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s") for d, t in rows], DOCS)


@pytest.mark.parametrize("drop", [drop_copies, drop_near_duplicates, drop_unidentified, sample_to_targets, dedup_lines])
def test_clashing_columns(spark, drop):
    names = ("kept_id", "kept_hash", "gone_id", "gone_hash", "bad", "row", "gone", "__kept", "__gone", "_row", "rep", "comp")
    rows = spark.createDataFrame([(1, "some words of a text here", "en", "s"), (2, "some words of a text here", "en", "s"), (None, "", None, None)], DOCS)
    clashing = rows.select("*", *[F.lit("x").alias(c) for c in names])
    assert drop(clashing).columns == clashing.columns
    assert drop(clashing).count() == drop(rows).count()


def test_letters_by_category(spark):
    rows = [(i, "the and of with " * 5) for i in range(40)] + [(100, "½ ² Ⅷ 12"), (101, "½ a")]
    got = {r.doc_id: r.lang_pred for r in identify(docs_of(spark, rows)).collect()}
    assert got[100] == "und" and got[101] == "en"


def test_more_languages_than_a_block_holds(spark, monkeypatch):
    """Every language is learned and predicted, and blocks change nothing."""
    random.seed(8)
    words = ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(140)]
    rows = [(140 * i + k, f"{words[k]} " * (5 + i), f"x{k:03}", "s") for i in range(8) for k in range(140)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in identify(docs).collect()}
    wrong = [d for d, _, lang, _ in rows if got[d][0] != lang]
    assert len({p for p, _ in got.values()}) == 140 and len(wrong) < 0.03 * len(rows)
    monkeypatch.setattr(langid, "BLOCK_LANGS", 1000)
    assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in identify(docs).collect()} == got


def test_sets_of_a_repeated_id_are_linked(spark):
    a, b = "alpha beta gamma delta epsilon", "one two three four five six"
    got = defaultdict(set)
    for r in near_duplicates(docs_of(spark, [(0, a), (1, a), (1, b), (2, b), (3, "other words stand here alone")])).collect():
        got[r.doc_id].add(r.component_id)
    assert got == {0: {0}, 1: {0}, 2: {0}, 3: {3}}


def test_repeated_rows_in_a_large_group(spark, monkeypatch):
    """Near copies that are all given twice, without the rounds of comparison with a leader."""
    monkeypatch.setattr("crawlscope.llm.minhash.STAR_ROUNDS", 0)
    random.seed(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(20):
        text = [*base, *[f"x{d}_{i}" for i in range(random.randrange(1, 8))]]
        rows += [(d, " ".join(text))] * 2
    assert {r.component_id for r in near_duplicates(docs_of(spark, rows)).collect()} == {0}


def test_copies_of_repeated_ids(spark):
    rows = [(1, "a longer text here"), (1, "short"), (0, "s h o r t"), (None, "x"), (None, "x"), (5, "x")]
    out = sorted((str(r.doc_id), r.text) for r in drop_copies(docs_of(spark, rows)).collect())
    assert out == [("0", "s h o r t"), ("1", "a longer text here"), ("5", "x")]


def test_large_groups_are_settled_alike(spark, monkeypatch):
    rows = [(i, f"text {i % 7}" if i % 2 else f"own {i}") for i in range(200)]
    want = sorted(map(tuple, exact_dedup(docs_of(spark, rows)).collect()))
    monkeypatch.setattr("crawlscope.llm.exact_dedup.LARGE_ROWS", 3)
    assert sorted(map(tuple, exact_dedup(docs_of(spark, rows), heavy_share=0.9).collect())) == want


def test_null_ids_draw_by_their_texts(spark):
    rows = [(None, f"words of {i}", "en", "a" if i % 3 else "b") for i in range(600)]
    targets = {
        "source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, share double"),
        "lang": spark.createDataFrame([("en", 1.0)], "value string, share double"),
        "topic": spark.createDataFrame([("general", 1.0)], "value string, share double"),
    }
    docs = spark.createDataFrame(rows, DOCS)
    kept = mix(docs, targets).where("kept").groupBy("source").count().collect()
    counts = {r["source"]: r["count"] for r in kept}
    assert counts["b"] == 200 and 140 < counts["a"] < 260
    assert sample_to_targets(docs, targets).count() == sum(counts.values())


def test_kept_tokens_meet_the_targets(spark):
    random.seed(9)
    rows = [(i, "word " * random.randrange(5, 60), random.choice(["en", "en", "de"]), random.choice("aaab")) for i in range(8000)]
    goals = {"source": {"a": 0.6, "b": 0.4}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"general": 1.0}}
    targets = {k: spark.createDataFrame(list(v.items()), "value string, share double") for k, v in goals.items()}
    kept = mix(spark.createDataFrame(rows, DOCS), targets).where("kept").toPandas()
    for dim, goal in goals.items():
        share = kept.groupby(dim)["n_tokens"].sum() / kept["n_tokens"].sum()
        assert all(abs(share[v] - x) < 0.03 for v, x in goal.items()), (dim, share)


def test_pools_are_bounded_by_their_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "POOL_CHARS", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["abc", None, "x" * 50, "abcdef", "abcdef", ""])], names=["doc_id", "text"])
    sizes = [p.num_rows for p in packing._pools(batch)]
    assert sum(sizes) == 6 and sizes == [3, 2, 1]


def test_random_spans_held_out(spark):
    """Recall and precision of the method's spans on strings that it has not learned from."""
    rng = np.random.default_rng(5)
    alphabet = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    words = ["page", "title", "extract", "metadata", "number", "column", "layer", "index", "value", "source", "token", "window", "count", "reader", "table", "scale"]
    key = lambda: "".join(rng.choice(alphabet, 28))
    name = lambda: "_".join([*rng.choice(words, 3), str(rng.integers(1, 99))])
    learn = [(i, f"password={key()} and {name()} in {name()} with {name()}") for i in range(300)]
    strings, plain = {1000 + i: key() for i in range(200)}, {2000 + i: name() for i in range(200)}
    test = [(i, f"see {s} here") for i, s in (strings | plain).items()]
    found = {r.doc_id for r in scan_secrets(docs_of(spark, learn + test)).where("doc_id >= 1000 AND spans LIKE '%random%'").collect()}
    hit, wrong = len(found & strings.keys()), len(found & plain.keys())
    assert hit >= 190 and wrong <= 4, (hit, wrong)


def test_pipeline(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(None, "a text without an id of any kind stands here", "en", "x"), (-1, None, None, None), (-2, "", "en", "x"), (-3, "long words " * 50_000, "en", "x")], DOCS)
    docs = rows.select("doc_id", "text", "lang", "source").unionByName(odd).withColumn("rep", F.lit("clash")).withColumn("kept", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    pieces = out.sort_values(["doc_id", "start"]).groupby("doc_id", dropna=False)
    for _, p in pieces:
        if len(set(zip(p["start"], p["length"], strict=True))) == len(p):
            assert p["length"].sum() == p["doc_tokens"].iloc[0]
    assert (out.groupby("sequence_id")["length"].sum() <= 4096).all()
    kept = set(out["doc_id"].dropna().astype(int))
    assert not kept & {-1, -2} and len(kept) > 50
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_pipeline_stages_take_their_predecessors_rows(spark, sf_dir):
    """Each filtering stage drops only what its operator says, by plain Python on the stage's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language ID"](spark, docs, sf_dir).toPandas()
    assert first["text"].notna().all() and len(first) > 0.9 * docs.count()
    left = spark.createDataFrame(first)
    second = stages["exact dedup"](spark, left, sf_dir).toPandas()
    digest = lambda t: hashlib.sha256("".join(c for c in t if c not in " \t\n\x0b\x0c\r").encode()).hexdigest()
    best = {}
    for d, t in zip(first["doc_id"], first["text"], strict=True):
        k = digest(t)
        best[k] = min(best.get(k, (0, d)), (-len(t), d))
    assert sorted(second["doc_id"]) == sorted(d for _, d in best.values())
