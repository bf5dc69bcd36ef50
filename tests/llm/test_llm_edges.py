"""Nulls, empty and long texts, ties and repeated rows, empty tables, clashing columns; hot groups."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import (
    chat, decontaminate, html_text, language, quality, revisits, sentencepiece_bpe, simhash, toxicity, url_filter,
)
from corpusloom.llm.components import components
from corpusloom.llm.queries import piece_model
from tests.llm.test_llm_queries import classes, plain_fingerprint

LONG = "word " * 60_000
DOCS = "doc_id long, text string"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def unsigned(x: int) -> int:
    return x & (1 << 64) - 1


# -- near-duplicates ---------------------------------------------------------------------------------


def clustered(seed: int, clusters: int, members: int, flips: int) -> list[int]:
    rng = np.random.default_rng(seed)
    out = set()
    for centre in rng.integers(0, 2**63, clusters):
        for _ in range(members):
            x = int(centre)
            for b in rng.integers(0, 64, rng.integers(0, flips)):
                x ^= 1 << int(b)
            out.add(x - (1 << 64) if x >> 63 else x)
    return sorted(out)


@pytest.mark.parametrize("how", ["plan", "hot", "centres", "halves", "two bits"])
def test_links_connect_what_all_pairs_connect(spark, how):
    prints = clustered(1, 12, 40, 6)
    distance = 2 if how == "two bits" else 3
    least = classes({unsigned(p): unsigned(p) for p in prints}, distance)
    t = spark.createDataFrame([(p,) for p in prints], "fp long")
    parts = [simhash.Part(tuple(range(32)), 1), simhash.Part(tuple(range(32, 64)), 1)]
    links = {
        "plan": lambda: simhash.link_fingerprints(t),
        "hot": lambda: simhash.link_fingerprints(t, hot_bucket=4),
        "centres": lambda: simhash.centre_links(t, 3),
        "halves": lambda: simhash.link_fingerprints(t, parts=parts),
        "two bits": lambda: simhash.centre_links(t, 2),
    }[how]()
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    groups, want = {}, {}
    for p in prints:
        groups.setdefault(roots.get(p, p), set()).add(p)
        want.setdefault(least[unsigned(p)], set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_centres_are_linear_in_a_group_of_copies(spark):
    few, many = (spark.createDataFrame([(p,) for p in clustered(2, 1, n, 4)], "fp long") for n in (50, 500))
    per_member = [simhash.centre_links(t, 3).count() / t.count() for t in (few, many)]
    assert per_member[1] < 1100 and many.count() > 5 * few.count()


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100)]
    hub = [(1000, 1001 + i) for i in range(300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*path, *hub, (7, 7)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 1000 for i in range(1000, 1301)}


def test_simhash_edges(spark):
    rows = [(3, None), (2, ""), (9, " \t"), (5, "One two"), (4, "one TWO"), (4, "one TWO"), (None, "one two"), (8, LONG), (7, LONG)]
    got = sorted(
        (r["doc_id"] or 0, r["fingerprint"], r["component_id"])
        for r in simhash.near_duplicate_classes(docs_of(spark, rows)).collect()
    )
    two = f"{plain_fingerprint('one two'):016x}"
    long = f"{plain_fingerprint('word word word'):016x}"
    zero = "0" * 16
    assert got == sorted(
        [(3, zero, 2), (2, zero, 2), (9, zero, 2), (8, long, 7), (7, long, 7), (0, two, 4), (5, two, 4), (4, two, 4), (4, two, 4)]
    )
    kept = simhash.drop_near_duplicates(docs_of(spark, rows).withColumn("__fp", F.lit("x")))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 7] and kept.columns == ["doc_id", "text", "__fp"]
    assert simhash.near_duplicate_classes(docs_of(spark, [])).count() == 0
    assert [r["component_id"] for r in simhash.near_duplicate_classes(docs_of(spark, [(None, "a")])).collect()] == [None]


# -- web pages ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("a < b <c", "a < b"),
        ("<p title='a>b'>x</p><!-- open", "x"),
        ("<script>if (a < b) '</p>';</script>kept<style>p{}", "kept"),
        ("<article><p>A &lt;&nbsp;b\n c</p>d<br>e<br><br>f &amp &am</article>", "A < b c\nd e\nf & &am"),
        ("<nav>menu<article><h1>T</h1>one</article>", "T\none"),
        ("<main><header><h1>T</h1></header>x<aside>y</aside><div class='comments'><article>z</article></div></main>", "T\nx"),
        ("<div id=top-menu>m</div><div class=post>text</div><form>f</form><p hidden>h</p><footer>f</footer>", "text"),
        ("<article><p>x</p><p><a href=a>a long link to elsewhere</a></p></article>", "x"),
    ],
)
def test_main_text_of_small_pages(html, text):
    assert html_text.main_text(html) == text


def test_open_blocks_inherit_from_their_neighbours():
    kept, dropped = html_text.KEEP, html_text.DROP
    block = html_text.Block("x", 0, False, html_text.ELSEWHERE, 0)
    labels = [html_text.OPEN, kept, html_text.OPEN, html_text.OPEN, html_text.OPEN, dropped, html_text.OPEN]
    assert html_text.second_pass([block] * 7, labels) == [kept, kept, kept, kept, dropped, dropped, dropped]


def test_main_text_of_a_long_page(spark):
    page = "<article>" + "<p>the text of a line</p>" * 50_000 + '<p class="'
    rows = spark.createDataFrame([(1, page, "u"), (1, None, "u")], "page_id int, html string, text string")
    got = [r["text"] for r in html_text.with_main_text(rows).collect()]
    assert got == ["\n".join(["the text of a line"] * 50_000), ""]


# -- revisits ----------------------------------------------------------------------------------------

RECORD = "record_id long, url string, captured long, kind string, status int, headers map<string,string>, digest string"


def asof(rows, hot=None):
    out = {}
    for rid, url, at, kind, _, headers, digest in rows:
        if kind != "revisit":
            continue
        best = None
        if None not in (rid, url, at):
            for other in rows:
                if other[3] == "response" and other[4] == 200 and None not in other[:3] and other[1] == url:
                    if (other[2], other[0]) < (at, rid) and (best is None or (other[2], other[0]) > (best[2], best[0])):
                        best = other
        headers = headers or {}
        if best is None:
            out[rid] = ("missing", None)
            continue
        tag = headers.get("etag")
        bad = tag is not None and tag != (best[5] or {}).get("etag")
        bad |= digest is not None and best[6] is not None and digest != best[6]
        known = tag is not None or (digest is not None and best[6] is not None)
        state = "mismatch" if bad else "resolved" if known else "no_validator"
        out[rid] = (state, None if bad else best[0])
    return out


@pytest.mark.parametrize("hot_rows", [50_000, 20])
def test_revisits_against_a_loop(spark, hot_rows):
    draw = random.Random(5)
    rows = []
    for rid in range(400):
        url = "h.org/hot" if draw.random() < 0.7 else f"h.org/{draw.randrange(20)}"
        kind = draw.choice(["response", "revisit", "revisit"])
        tag = draw.choice(["a", "b", None])
        rows.append((rid, url, draw.randrange(150), kind, draw.choice([200, 200, 404]) if kind == "response" else 304,
                     {"etag": tag} if tag else None, draw.choice(["d", "e", None])))
    rows += [(900, None, 5, "revisit", 304, None, None), (901, "h.org/hot", None, "revisit", 304, None, None)]
    frame = spark.createDataFrame(rows, RECORD).withColumn("run", F.lit(1)).withColumn("last", F.lit("x"))
    got = {r["record_id"]: (r["state"], r["refers_to"]) for r in revisits.resolve_revisits(frame, hot_rows).collect()}
    assert got == asof(rows)


def test_revisit_headers_and_urls(spark):
    stored = {"content-length": "9", "etag": "a", "x": "1"}
    rows = [
        (1, "http://www.A.org:80/p/?b=2&utm_x=1&a=1#f", 1, "response", 200, stored, None),
        (2, "https://a.org/p?a=1&b=2", 2, "revisit", 304, {"etag": "W/a", "content-length": "0", "y": "2"}, None),
        (2, "https://a.org/p?a=1&b=2", 2, "revisit", 304, {"etag": "W/a", "content-length": "0", "y": "2"}, None),
    ]
    got = revisits.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()
    assert len(got) == 2
    for r in got:
        assert (r["state"], r["refers_to"], r["canonical"]) == ("resolved", 1, "a.org/p?a=1&b=2")
        assert r["headers"] == {"content-length": "9", "etag": "W/a", "x": "1", "y": "2"}
    assert revisits.resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0
    block = spark.range(1).select(revisits.header_map(F.lit("A: 1\r\nb : x:y\nbad\na: 2")).alias("h")).first()["h"]
    assert block == {"b": "x:y", "a": "2"}


# -- URLs, quality, chats ----------------------------------------------------------------------------


def test_url_edges(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/net/"), (4, "http://NET"), (5, "x://a.NET/q?/en/"), (5, "x://a.NET/q?/en/"),
            (6, "http://m.example.net/en/1"), (7, "http://example.net/english"), (8, "http://xorg/fr/"), (9, "a://b.org/fr/#x")]
    pages = spark.createDataFrame(rows, "page_id int, url string").withColumn("__grams", F.lit(0)).withColumn("score", F.lit("s"))
    got = url_filter.judge_urls(pages, url_filter.default_labelled(spark)).collect()
    seen = {(r["page_id"], r["host"], r["path"], r["rule"]) for r in got}
    assert len(got) == len(rows) and seen == {
        (1, "", "", None), (2, "", "", None), (3, "", "", None), (4, "net", "", None), (5, "a.net", "/q", "net/"),
        (6, "m.example.net", "/en/1", "example.net/en/"), (7, "example.net", "/english", "net/"), (8, "xorg", "/fr/", None),
        (9, "b.org", "/fr/", "org/fr/"),
    }
    empty = spark.createDataFrame([], "url string, label int")
    assert {r["verdict"] for r in url_filter.judge_urls(pages, empty).where("rule is null").collect()} == {"allow"}
    too_many = spark.range(url_filter.MOST_LABELLED + 1).selectExpr("'u' as url", "1 as label")
    with pytest.raises(ValueError, match="more than"):
        url_filter.judge_urls(pages, too_many)


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, "a b a b a b"), (5, "x\nx\n\nx \nx"), (6, LONG), (6, LONG), (7, "é#* <b>")]
    frame = docs_of(spark, rows).withColumn("kept", F.lit("old")).withColumn("__words", F.lit(1))
    got = {r["doc_id"]: r for r in quality.judge_quality(frame).collect()}
    assert [got[i]["n_words"] for i in range(1, 8)] == [0, 0, 0, 6, 4, 60_000, 2]
    assert [got[i]["n_repeat_words"] for i in range(1, 8)] == [0, 0, 0, 6, 4, 60_000, 0]
    assert got[5]["n_dup_lines"] == 2 and got[7]["n_symbols"] == 4 and got[7]["word_chars"] == 6
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in range(1, 8))
    assert quality.judge_quality(docs_of(spark, [])).count() == 0
    good = " ".join(f"the cat{i} of house{i}" for i in range(20))
    assert quality.judge_quality(docs_of(spark, [(1, good)])).first()["kept"]


def test_chats_can_be_read_back(spark):
    draw = random.Random(6)
    parts = ["\\", "###", "#", "</turn>", "</", "turn>", "\\h", "\\t", "### user\n", "x", "\n", "é😀", ""]
    rows = []
    for conv in range(40):
        for turn in range(draw.randrange(1, 9)):
            role = draw.choice(["user", "assistant", "assistant", None, "a\nb", "### x"])
            rows.append((conv, turn, role, "".join(draw.choices(parts, k=draw.randrange(6))) or None))
    rows += [(None, None, "user", "t"), (None, None, "user", "t"), (99, 0, "assistant", LONG)]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("turns", F.lit(1))
    read = chat.format_chats(frame).select(
        "conv_id", "messages", "formatted", chat.read_chat(F.col("formatted")).alias("rows"),
        chat.loss_text(F.col("formatted"), F.col("loss")).alias("trained"),
    )
    for r in read.collect():
        own = [(role or "", text or "") for conv, _, role, text in rows if conv == r["conv_id"]]
        assert [tuple(x) for x in r["rows"]] == own
        assert [(m["role"], t) for m in r["messages"] for t in m["texts"]] == own
        assert all(a["role"] != b["role"] for a, b in zip(r["messages"], r["messages"][1:], strict=False))
        assert r["trained"] == "".join(t for role, t in own if role == "assistant")
        assert r["formatted"].count("</turn>") == len(own)
    assert chat.format_chats(spark.createDataFrame([], frame.schema)).count() == 0


# -- classifiers -------------------------------------------------------------------------------------


def test_toxicity_edges(spark):
    labels = "doc_id long, toxic int"
    rows = [(i, "you vile brute of a man" if i % 2 else "a fine day in the park") for i in range(40)]
    docs = docs_of(spark, [*rows, (50, None), (51, ""), (51, ""), (52, LONG), (None, "vile brute")])
    marked = spark.createDataFrame([*[(i, i % 2) for i in range(40)], (3, 0), (60, 1), (5, None), (None, 1)], labels)
    model = toxicity.train(docs, marked, "true")
    got = toxicity.with_toxicity(docs.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == 45 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["doc_id"] for r in got if r["predicted"] and r["doc_id"] is not None and r["doc_id"] < 40} == set(range(1, 40, 2))
    for few in ([], [(1, 0)]):
        none = toxicity.train(docs, spark.createDataFrame(few, labels), "true")
        assert not any(r["predicted"] for r in toxicity.with_toxicity(docs, none).collect())
    assert toxicity.with_toxicity(docs_of(spark, []), model).count() == 0


def test_language_edges(spark):
    rows = [(i, ("der Hund und die Katze im Haus " if i % 2 else "the dog and the cat in this house ") * 3 + str(i),
             "de" if i % 2 else "en") for i in range(120)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "123 ...", None), (203, LONG, None), (203, LONG, None)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string").withColumn("__guess", F.lit(1)).withColumn("score", F.lit("x"))
    got = language.with_language(docs, language.train(docs, "true")).collect()
    assert len(got) == 125 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == r["lang"] for r in got if r["doc_id"] < 120)
    assert [(r["lang_pred"], r["score"]) for r in got if 200 <= r["doc_id"] < 203] == [("und", 0.0)] * 3
    assert language.train(docs.limit(0), "true") is None
    assert {r["lang_pred"] for r in language.with_language(docs, None).collect()} == {"und"}


# -- contamination -----------------------------------------------------------------------------------


@pytest.mark.parametrize("most_broadcast", [decontaminate.MOST_BROADCAST, 0])
def test_contamination_against_all_windows(spark, most_broadcast):
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(6)]
    text = lambda n: " ".join(draw.choices(vocabulary, k=n))
    items = [(i, text(draw.choice([1, 4, 7, 9, 10, 11, 30]))) for i in range(12)]
    items += [(3, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (None, text(12)), (40, None), (41, ".,"), (42, items[5][1])]
    rows = [(i, text(draw.randrange(60))) for i in range(60)]
    rows += [(100 + i, text(8) + " " + t.upper() + "; " + text(3)) for i, (_, t) in enumerate(items) if t]
    rows += [(200, None), (201, ""), (202, "w1 " * 3000), (5, rows[5][1]), (5, "other"), (None, rows[7][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs_of(spark, rows).withColumn("words", F.lit(1)), bench, most_broadcast=most_broadcast)
    got = got.withColumn("n_hit", decontaminate.covered_words(F.col("spans"))).collect()

    def plain(doc: str | None):
        w = (doc or "").lower().replace(";", " ").replace(".,", "").split()
        hit, found = set(), set()
        for item, t in items:
            v = (t or "").replace(".,", "").split()
            n = min(10, len(v))
            for window in {tuple(v[k : k + n]) for k in range(len(v) - n + 1) if n}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == window:
                        hit |= set(range(k, k + n))
                        found |= {item} - {None}
        return len(w), len(hit), tuple(sorted(found))

    want = sorted((i or -1, *plain(t)) for i, t in rows)
    assert sorted((r["doc_id"] or -1, r["n_words"], r["n_hit"], tuple(sorted(r["items"]))) for r in got) == want
    kept = decontaminate.drop_contaminated(docs_of(spark, rows), bench, most_broadcast=most_broadcast).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept) == sorted((i or -1, t or "") for i, t in rows if not plain(t)[1])


def test_contamination_of_empty_tables(spark):
    items = "item_id long, text string"
    full, none = docs_of(spark, [(1, "a b")]), docs_of(spark, [])
    bench, empty = spark.createDataFrame([(1, "a b")], items), spark.createDataFrame([], items)
    assert decontaminate.contamination(none, bench).count() == 0
    assert [r["spans"] for r in decontaminate.contamination(full, empty).collect()] == [[]]


# -- pieces ------------------------------------------------------------------------------------------


def test_pieces_on_random_texts_and_ids():
    pieces = sentencepiece_bpe.Pieces(piece_model())
    library, draw = pieces.library, random.Random(9)
    letters = "abc  \n\t▁Zéü日\x00;\r{}<>/s😀0123the and"
    for _ in range(2000):
        text = "".join(draw.choices(letters, k=draw.randrange(30)))
        ids = pieces.encode(text)
        assert ids == library.encode(text) and pieces.decode(ids) == library.decode(ids)
        some = [draw.randrange(3, 32000 if draw.random() < 0.5 else 259) for _ in range(draw.randrange(1, 8))]
        assert pieces.decode(some) == library.decode(some)


def test_pieces_edges(spark):
    rows = [(1, None), (2, ""), (3, "a" * 20_000), (4, LONG), (4, LONG), (None, " ▁ \n")]
    frame = docs_of(spark, rows).withColumn("ids", F.lit("old"))
    got = sentencepiece_bpe.encode_and_decode(frame, piece_model()).collect()
    library = sentencepiece_bpe.Pieces(piece_model()).library
    assert sorted((r["doc_id"] or 0, r["ids"], r["decoded"]) for r in got) == sorted(
        (i or 0, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in rows
    )
    assert sentencepiece_bpe.encode_and_decode(docs_of(spark, []), piece_model()).count() == 0


def test_segments_are_compared_with_the_library():
    pieces = sentencepiece_bpe.Pieces(piece_model())
    assert pieces.differing(["▁the", "x", "▁"], [pieces.merge("▁the"), pieces.merge("x"), pieces.merge("▁")]) is None
    assert pieces.differing(["▁the"], [[1, 2]]) == "▁the"


def test_html_reads_whole_attribute_names_and_self_closed_svg():
    from corpusloom.llm.html_text import main_text

    page = (
        '<article><p title="the hidden valley">One.</p><p data-hidden="false">Two.</p><div data-id="ad-7">Three.</div>'
        '<p title="class=ad">Four.</p><p title=\'x\' HIDDEN>no</p><p aria-hidden = "true">no</p><div id=ad>no</div>'
        '<p>Five <svg class="icon" /> and <math/> six.</p><p><svg><text>no</text></svg>Seven.</p></article>'
    )
    assert main_text(page).split("\n") == ["One.", "Two.", "Three.", "Four.", "Five and six.", "Seven."]


def test_html_keeps_main_text_beside_a_teaser_and_drops_articles_of_asides():
    from corpusloom.llm.html_text import main_text

    long = "This is the story of the river and of the people who lived at it for more than a hundred years."
    card = "<article><p>A teaser of the week.</p></article>"
    assert long in main_text(f'<div class="content"><p>{long}</p><p>{long}</p></div>{card}').split("\n")
    for tag in ("aside", "nav", "footer"):
        assert main_text(f"<div><p>{long}</p></div><{tag}>{card}</{tag}>") == long
    assert main_text(f'<main><p>{long}</p></main><article class="related"><p>{long} Again.</p></article>') == long
    assert main_text(f"<p>Site name</p><main><p>{long}</p></main><p>Short note</p>") == long
    assert main_text(f"<form><main><p>{long}</p></main></form>") == long
