"""The pipeline's stages on edge cases, and against what brute force keeps."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from viatica.llm import base, language, lines, mixing, simhash, tokens
from viatica.llm.tokens import encoder

CLASHING = ("_", "__", "n_lines", "N_DROPPED", "lang_pred", "lang_score", "items", "position", "d", "k", "n", "t", "none", "id", "copies", "fp", "h")


@pytest.fixture
def clashing(docs):
    return docs.withColumns({c: F.lit(c) for c in CLASHING})


def test_stages_on_edges(spark, clashing, tmp_path):
    for at, own in enumerate((clashing, clashing.limit(0), clashing.withColumn("lang", F.lit(None).cast("string")))):
        now = own
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{at}-{n}")
            stage(spark, now, "").write.parquet(path)
            now = spark.read.parquet(path)
            if n + 1 < len(corpus_pipeline.STAGES):
                assert now.columns == own.columns, name
                assert now.filter(" or ".join(f"`{c}` <> '{c}'" for c in CLASHING)).isEmpty(), name
        assert (at == 1) == (now.count() == 0)


def test_language_takes_effect(spark):
    """No document of the corpus is rejected, and each has its predicted language from there on."""
    docs = base.table(spark, "/root/testdata/sf0.001", "documents")
    found = corpus_pipeline.language_id(spark, docs, "")
    want = {r.doc_id: r.lang_pred for r in language.identify(docs, language.learn(docs)).collect()}
    assert {r.doc_id: r.lang for r in found.collect()} == want and found.filter("lang is null").isEmpty()
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()}
    assert kept == {r.component_id for r in simhash.near_duplicates(docs).collect()}


def test_run_is_its_stages_by_brute_force(spark):
    """Each stage again, with plain loops for dedup, and the pieces put together to whole documents."""
    docs = base.table(spark, "/root/testdata/sf0.001", "documents")
    rows = {r.doc_id: r for r in language.identify(docs, language.learn(docs)).collect() if r.lang_pred != "und"}
    keys = {i: [x.strip(" \t\n\r\x0b\x0c").encode().lower() for x in (r.text or "").split("\n")] for i, r in rows.items()}
    seen = Counter(k for own in keys.values() for k in set(own))
    texts = {i: "\n".join(x for x, k in zip((rows[i].text or "").split("\n"), own, strict=True) if not k or seen[k] < 10) for i, own in keys.items()}
    ids = sorted(texts)
    fps = np.array([simhash.fingerprint(texts[i].encode()) for i in ids], np.int64).view(np.uint64)
    root = simhash._roots(len(ids), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= 3))
    stay = [ids[n] for n in range(len(ids)) if root[n] == n]
    left = spark.createDataFrame([(i, texts[i], rows[i].lang_pred, rows[i].source) for i in stay], "doc_id long, text string, lang string, source string")
    mixed = {r.doc_id: r.text for r in mixing.mix(left).collect()}
    assert 0 < len(mixed) < len(stay)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    lengths = {i: len(encoder(tokens.vocabulary()).tokenizer.encode(x, add_special_tokens=False).ids) + 1 for i, x in mixed.items()}
    assert {r.doc_id: r.doc_tokens for r in out} == lengths
    total: Counter = Counter()
    for r in out:
        total[r.doc_id] += r.length
    assert total == lengths
    assert lines.dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_dropped"]
