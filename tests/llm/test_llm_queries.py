"""The queries of the language-model operators against SQL, brute force and exact round trips."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from corpusloom.llm import language, simhash
from corpusloom.llm.queries import QUERIES, piece_model
from corpusloom.llm.sql import ORACLE
from tests.oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"


def table(name: str, sf_dir: str = SF_DIR) -> list[dict]:
    con = connect(sf_dir)
    return con.execute(f"SELECT * FROM {name}").to_arrow_table().to_pylist()


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_agrees_with_sql(spark, name):
    result = QUERIES[name](spark, SF_DIR).toArrow()
    assert differences(result, connect(SF_DIR).execute(ORACLE[name]).to_arrow_table()) is None


def plain_fingerprint(text: str | None) -> int:
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints: dict[int, int], distance: int = 3) -> dict[int, int]:
    """The smallest id that can be reached, by comparing all pairs."""
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= distance and least[j] < least[i]:
                    least[i], changed = least[j], True
    return least


def test_simhash_against_all_pairs(spark):
    texts = {r["doc_id"]: r["text"] for r in table("documents")}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = {(i, f"{prints[i]:016x}", c) for i, c in classes(prints).items()}
    got = {tuple(r) for r in QUERIES["op1_simhash"](spark, SF_DIR).collect()}
    assert got == want


def test_main_text_is_the_article(spark):
    import re
    from html import unescape

    got = {r["page_id"]: r for r in QUERIES["op2_html_text"](spark, SF_DIR).collect()}
    pages = table("pages")
    assert len(got) == len(pages)
    for page in pages:
        article = re.search(r"<article>(.*?)(</article>|$)", page["html"], re.S)[1]
        blocks = [re.sub("<[^>]*>", "", b) for b in re.split(r"</?(?:p|h1)>|<br>", article)]
        lines = [" ".join(unescape(b).split()) for b in blocks]
        row = got[page["page_id"]]
        assert row["text"] == "\n".join(x for x in lines if x)
        assert row["n_chars"] == len(row["text"]) and row["url"] == page["url"]


def test_url_verdicts_against_a_plain_classifier(spark):
    from tests.llm.plain import PlainUrls

    plain = PlainUrls()
    got = {r["page_id"]: r for r in QUERIES["op4_url_filter"](spark, SF_DIR).collect()}
    for page in table("pages"):
        row = got[page["page_id"]]
        host, path = plain.split(page["url"])
        rule, verdict = plain.rule(host, path)
        score = plain.score(page["url"])
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["score"] == pytest.approx(score, abs=1e-6)
        assert row["verdict"] == (verdict or ("block" if row["score"] >= 0.5 else "allow"))


def test_toxicity_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in table("labels", sf_dir)}
    rows = QUERIES["op6_toxicity"](spark, sf_dir).collect()
    assert len(rows) == 1000
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    right = np.mean([r["predicted"] == labels[r["doc_id"]] for r in held])
    assert right >= 0.93


def test_language_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in table("documents", sf_dir)}
    rows = QUERIES["op9_language_id"](spark, sf_dir).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) >= 0.97
    assert {r["lang_pred"] for r in rows} <= set(langs.values()) | {language.UNKNOWN}


def test_pieces_as_the_library_encodes(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_proto=piece_model())
    texts = {r["doc_id"]: r["text"] or "" for r in table("documents")}
    got = {r["doc_id"]: r for r in QUERIES["op10_sentencepiece"](spark, SF_DIR).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in texts.items():
        ids = library.encode(text)
        want = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    import re

    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "language", "near_duplicates", "decontamination", "sentencepiece",
    ]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        kept.append({r["doc_id"]: r.asDict() for r in docs.collect()})
    labels = {r["doc_id"]: r["toxic"] for r in table("labels")}
    assert np.mean([(i not in kept[0]) == bool(t) for i, t in labels.items()]) >= 0.9
    assert len(kept[1]) >= 0.97 * len(kept[0])
    least = classes({i: plain_fingerprint(r["text"]) for i, r in kept[1].items()})
    assert set(kept[2]) == set(least.values())

    def words(text: str) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = set()
    for item in table("benchmark"):
        w = words(item["text"])
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    clean = {
        i for i, r in kept[2].items()
        if not any(tuple(w[k : k + n]) in windows for w in [words(r["text"])] for n in sizes for k in range(len(w) - n + 1))
    }
    assert set(kept[3]) == clean == set(kept[4])
    whole = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert whole == {i: r["n_tokens"] for i, r in kept[4].items()}


def test_thresholds_by_dynamic_programming_are_the_best():
    import itertools

    rng = np.random.default_rng(3)
    for m in (1, 2, 3, 4):
        costs = [np.cumsum(rng.random(5)).tolist() for _ in range(m)]
        want = min(
            (sum(c[t + 1] for c, t in zip(costs, ts, strict=True)), ts)
            for ts in itertools.product(range(-1, 4), repeat=m)
            if sum(ts) == 3 - m + 1
        )
        cost, thresholds = simhash.allocate(costs, 3 - m + 1)
        assert cost == pytest.approx(want[0]) and sum(thresholds) == 4 - m


def test_pair_distances_by_counting():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 256, 300)
    share = simhash.pair_distances(np.bincount(values, minlength=256).astype(float))
    apart = np.bitwise_count((values[:, None] ^ values[None, :]).astype(np.uint64))
    assert np.allclose(share, np.bincount(apart.ravel(), minlength=9) / values.size**2)
