"""Both text classifiers against plain versions that learn and score one feature at a time."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from corpusloom.llm import language, toxicity
from corpusloom.llm.queries import QUERIES, language_model
from tests.llm.plain import PlainLanguage, PlainToxicity
from tests.llm.test_llm_queries import table

SF_DIR = "/root/testdata/sf0.001"


def remainder(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_against_a_plain_classifier(spark):
    docs = table("documents")
    rows = [(r["text"], r["lang"]) for r in docs if r["text"] is not None and r["lang"] is not None and remainder(r["doc_id"], 4) != 2]
    plain = PlainLanguage(rows, language.Settings(), language.BITS)
    model = language_model(spark, SF_DIR)
    # The searches for the temperature differ; its loss hardly changes around the best one.
    assert np.log(model.temperature) == pytest.approx(np.log(plain.temperature), abs=0.02)
    got = {r["doc_id"]: r for r in QUERIES["op9_language_id"](spark, SF_DIR).collect()}
    for r in docs[:80]:
        if any(c.isalpha() for c in r["text"] or ""):
            lang, score = plain.predict(r["text"], model.temperature)
            assert got[r["doc_id"]]["lang_pred"] == lang
            assert got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-6)


def test_toxicity_against_a_plain_classifier(spark):
    texts = {r["doc_id"]: r["text"] for r in table("documents")}
    labelled = {r["doc_id"]: r["toxic"] for r in table("labels") if remainder(r["doc_id"], 5) != 0 and r["toxic"] is not None}
    rows = [(texts[i], y) for i, y in labelled.items() if i in texts]
    # Without a feature bound no tie at the bound is decided by rounding.
    settings = toxicity.Settings(features=100_000, steps=30)
    plain = PlainToxicity(rows, settings, toxicity.BITS)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = toxicity.train(docs, labels, "crc32(cast(doc_id as string)) % 5 <> 0", settings)
    assert set(model.buckets.tolist()) == set(plain.ratio)
    for r in toxicity.with_toxicity(docs, model).collect():
        assert r["score"] == pytest.approx(plain.score(r["text"]), abs=1e-6)
