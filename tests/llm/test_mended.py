"""Pages whose text once was lost, long conversations, samples that hold their bounds."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, html_text
from corpusloom.llm.html_text import main_text

LONG = "This is the story of the river and of the people who lived at it for more than a hundred years."
NOTICE = "This site uses cookies of a kind that you can accept or refuse in the settings of the page at any time."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<nav><ul><li>a<li>b</ul><main><p>{LONG}</p></main>", LONG),
        (f"<header><div>site<article><p>{LONG}</p></article>", LONG),
        (f"<nav>a</nav><nav>b<article><p>{LONG}</p></article></nav><p>c</p>", "c"),
        (f"<article><p><a href=x>one<p>{LONG}</p><p>{LONG} 2</p></article>", f"{LONG}\n{LONG} 2"),
        (f"<p><a href=x>one<a href=y>two</a><p>{LONG}</p>", LONG),
        (f"<p>{LONG}</p><a href=x><p>{LONG} More.</p></a>", LONG),
        (f"<body><form id=aspnetForm><p>{LONG}</p><p>{LONG} 2</p><input><button>go</button></form>", f"{LONG}\n{LONG} 2"),
        (f'<div class="content no-sidebar"><p>{LONG}</p></div>', LONG),
        (f'<article class="post no-sidebar"><p>{LONG}</p></article>', LONG),
        (f'<article class="post social-science"><p>{LONG}</p></article>', LONG),
        (f"<p>One <span hidden>no</span> two <button>go</button>three.</p><p>{LONG}</p>", f"One two three.\n{LONG}"),
        (f"<div><p>{LONG}</p>left <span class=ad>no</div><p>{LONG}</p>", f"{LONG}\nleft\n{LONG}"),
        (f'<div id="banner-page"><p>{LONG}</p></div>', LONG),
        (f'<article><p>{LONG}</p></article><div class="cookieNotice">{NOTICE}</div><form>{NOTICE}</form>', LONG),
        (f'<p>{LONG}</p><p>{LONG}</p><div class="sidebar-left">{NOTICE}</div>', f"{LONG}\n{LONG}"),
        (f'<p>{LONG}</p><div class="comment-list"><p>{LONG}{NOTICE}{NOTICE}</p></div>', LONG),
    ],
)
def test_main_text_that_markup_could_hide(html, text):
    assert main_text(html) == text


def made_page(draw: random.Random) -> tuple[str, str]:
    """A page built from parts whose side is known, and the lines of its article."""
    words = "the river of a town and its people in time who were at home with what is there".split()

    def sentence(n: int) -> str:
        return " ".join(draw.choice(words) for _ in range(n))

    def article() -> tuple[str, list[str]]:
        html, lines = "", []
        for _ in range(draw.randrange(1, 6)):
            kind, text = draw.choice(["p", "h2", "li", "div", "ad", "form", "aside", "comment", "raw"]), sentence(draw.randrange(1, 40))
            if kind == "raw":
                html += draw.choice(["<script>{}</script>", "<style>{}</style>", "<!-- {} -->"]).format(text)
            elif kind == "ad":
                html += f'<div class="{draw.choice(["ad", "advert-box", "share-links"])}">{text}</div>'
            elif kind == "comment":
                html += f'<section id="comments"><article><p>{text}</p></article></section>'
            elif kind in ("form", "aside"):
                html += f"<{kind}><p>{text}</p></{kind}>"
            else:
                shown = text.replace(" of ", " <b>of</b>\n ", 1).replace("and", "&#97;nd")
                html += f"<{kind}>{shown}</{kind}>" if kind != "li" else f"<ul><li>{shown}</ul>"
                lines.append(text)
        return html, lines

    beside = [
        "<nav><ul>" + "".join(f"<li><a href=/{i}>{sentence(1)}</a></li>" for i in range(draw.randrange(5))) + "</ul></nav>",
        f"<footer>{sentence(9)}</footer>", f"<aside><h3>{sentence(2)}</h3>{sentence(20)}</aside>", "<p hidden>x</p>",
        f'<div class="cookie-banner">{sentence(30)}</div>', f"<script>{sentence(9)}</script>", f"<header>{sentence(3)}</header>",
    ]
    lines: list[str] = []
    while not lines:
        html, lines = article()
    mark = draw.choice(["article", "main", "div role=main"])
    before, behind = (draw.sample(beside, draw.randrange(4)) for _ in range(2))
    page = "".join(before) + f"<{mark}>{html}</{mark.split()[0]}>" + "".join(behind)
    return f"<html><head><title>{sentence(3)}</title></head><body>{page}</body></html>", "\n".join(lines)


def test_made_pages():
    draw = random.Random(11)
    for _ in range(1500):
        page, text = made_page(draw)
        assert main_text(page) == text, page


def test_any_markup_is_read_and_no_text_is_made_up():
    draw = random.Random(12)
    tags = "<p> </p> <div> </div> <nav> </nav> <article> </article> <a> </a> <a <form> </form> <svg/> <br> <!-- --> < > \" '".split()
    for _ in range(3000):
        page = "".join(draw.choice([draw.choice(tags), " word ", LONG]) for _ in range(draw.randrange(25)))
        left = iter(page)
        assert all(c in left for c in "".join(main_text(page).split()))


def test_time_grows_with_the_page():
    def took(n: int) -> float:
        start = time.perf_counter()
        for part in ("<div>", "</p>"), ("<div>", "<article>"), ("<nav>", "<article>x"), ("<a>", "<p>"), ("<ul><li>", "</div>"):
            main_text(part[0] * n + part[1] * n)
        return time.perf_counter() - start

    assert took(80_000) < 20 * took(10_000) + 1


def test_long_conversations_in_linear_time(spark):
    def read(turns: int) -> tuple[float, list]:
        rows = spark.range(turns).select(
            F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
            F.when(F.col("id") % 5 < 3, "user").otherwise("assistant").alias("role"),
            F.concat(F.lit("\\ ### é "), F.col("id").cast("string"), F.repeat(F.lit("word "), 40)).alias("text"),
        )
        start = time.perf_counter()
        formatted = chat.format_chats(rows)
        got = formatted.select(
            "formatted", "loss", chat.read_chat(F.col("formatted")).alias("rows"),
            chat.loss_text(F.col("formatted"), F.col("loss")).alias("trained"),
        ).collect()
        return time.perf_counter() - start, got

    read(1_000)
    short, _ = read(10_000)
    long, [row] = read(80_000)
    assert long < 16 * short + 5
    assert [r["text"] for r in row["rows"]] == [f"\\ ### é {i}" + "word " * 40 for i in range(80_000)]
    assert row["trained"] == "".join(f"\\ ### é {i}" + "word " * 40 for i in range(80_000) if i % 5 >= 3)


def test_loss_spans_are_places_in_the_string(spark):
    draw = random.Random(3)
    rows = [
        (c, t, draw.choice(["user", "assistant", "a\nb", None]), draw.choice(["", "é😀", "###", "</turn>x", "a b"]))
        for c in range(20)
        for t in range(draw.randrange(1, 300))
    ]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    for r in chat.format_chats(frame).collect():
        want = [text or "" for conv, _, role, text in rows if conv == r["conv_id"] and role == "assistant"]
        spans = [r["formatted"][s["start"] : s["start"] + s["len"]] for s in r["loss"]]
        assert [s.replace("\\h", "###").replace("\\t", "</turn>") for s in spans] == want
        ends = [m.start() for m in re.finditer("</turn>", r["formatted"])]
        assert [ends[s["turn"]] for s in r["loss"]] == [s["start"] + s["len"] for s in r["loss"]]


def test_runs_are_merged_in_the_plan(spark):
    """What is returned comes from the merged runs: nothing but them feeds the string."""
    rows = spark.createDataFrame([(1, 1, "user", "a")], "conv_id int, turn int, role string, text string")
    plan = chat.format_chats(rows).select("formatted")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "filter(sequence" in plan


def test_second_pass_leaves_doubtful_blocks_out():
    block = html_text.Block("x", 0, False, html_text.DOUBTFUL, 0)
    assert html_text.second_pass([block], [html_text.first_pass(block)]) == [html_text.DROP]


def test_language_sample_of_a_hot_text(spark):
    from corpusloom.llm import language

    rows = [(i, f"text number {i} of the town", "en") for i in range(300)] + [(i, f"der text {i} ist alt", "de") for i in range(300)]
    rows += [(1000 + i, "the same text again", "en") for i in range(5000)] + [(7, None, "en"), (8, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    settings = language.Settings(per_lang=100)
    sample = language._sample(docs, "true", settings, "text", "lang")
    assert 120 <= sample.num_rows <= 290
    assert len(set(zip(sample["h"].to_pylist(), sample["lang"].to_pylist(), strict=True))) == sample.num_rows
    everything = language._sample(docs, "true", language.Settings(per_lang=10_000), "text", "lang")
    assert everything.num_rows == 601


def test_toxicity_sample_of_a_hot_document(spark):
    from corpusloom.llm import toxicity

    rows = [(i, f"text number {i}") for i in range(200)] + [(3, f"another text {i}") for i in range(4000)] + [(5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    sample, sizes = toxicity.sampled(docs, labels, "true", 10_000, "text", "doc_id", "toxic")
    assert sample.count() == 200 and sizes == {0: 100, 1: 100}
    again, _ = toxicity.sampled(docs.repartition(2), labels, "true", 10_000, "text", "doc_id", "toxic")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, sample.collect()))


@pytest.mark.parametrize("most", [0, 1000])
def test_rows_go_alike_by_broadcast_and_by_join(spark, most):
    from corpusloom.llm import decontaminate, simhash

    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(3, words, "a"), (1, words, "b"), (1, words, "b"), (None, words, "c"), (2, "other text", "d"), (5, None, "e"), (4, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string").repartition(3)
    kept = simhash.drop_near_duplicates(docs, most_broadcast=most)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(1, words, "b"), (2, "other text", "d"), (4, "", "f")]
    benchmark = spark.createDataFrame([(1, "x two three four five six seven eight nine ten eleven y"), (2, "other")], "item_id int, text string")
    clean = decontaminate.drop_contaminated(docs, benchmark, most_dropped=most)
    assert sorted(map(repr, clean.collect())) == sorted(map(repr, docs.where("doc_id in (4, 5)").collect()))


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, empty and repeated texts, clashing columns and empty tables pass every stage."""
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(900001, None, None, None, None), (900002, "", "en", "s", 0), (900003, "1 2 3", "de", None, 5), (None, "Ein Text", "de", "s", 8)]
    docs = docs.unionByName(spark.createDataFrame(odd + odd[-1:], docs.schema)).withColumn("Score", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, sf_dir).collect()
        assert len({tuple(r) for r in rows}) > 100
        assert stage(spark, docs.limit(0), sf_dir).collect() == []


@pytest.mark.parametrize("times", [1, 3])
def test_captures_of_one_time_are_dealt_to_ranges(spark, monkeypatch, times):
    """All captures of a URL share a time stamp, or a few; each revisit finds the last response before its id."""
    from corpusloom.llm import revisits

    draw = random.Random(9)
    rows = []
    for i in range(700):
        kind = draw.choice(["response", "revisit"])
        rows.append((i, "http://a.org/x" if i % 7 else f"http://b.org/{i % 3}", draw.randrange(times), kind, 200 if kind == "response" else 304))
    frame = spark.createDataFrame(rows, "record_id long, url string, captured long, kind string, status int").repartition(6)
    frame = frame.withColumns({"headers": F.create_map(F.lit("etag"), F.lit("t")), "digest": F.lit("d")})
    sizes, keep = [], revisits._ranged

    def ranged(df, ranges):
        out = keep(df, ranges)
        sizes.extend(r["count"] for r in out.groupBy("run").count().collect())
        return out

    monkeypatch.setattr(revisits, "_ranged", ranged)
    got = {r["record_id"]: r["refers_to"] for r in revisits.resolve_revisits(frame, hot_rows=60).collect()}
    want, last = {}, {}
    for i, url, _, kind, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if kind == "revisit":
            want[i] = last.get(url)
        else:
            last[url] = i
    assert got == want
    assert len(sizes) >= 8 and max(sizes) <= 200


def test_segments_abreast_as_one_by_one():
    from corpusloom.llm import sentencepiece_bpe
    from corpusloom.llm.queries import piece_model

    pieces = sentencepiece_bpe.Pieces(piece_model())
    draw = random.Random(13)
    chars = sorted(pieces.plain_chars)
    common = "▁etaoinshrdlucm.,-éü1"
    segments = ["".join(draw.choice(common if draw.random() < 0.9 else chars) for _ in range(draw.randrange(1, 49))) for _ in range(4000)]
    segments += ["aaaaaaaaaaaaaaaa", "a", "ababababab", "▁▁▁▁"]
    got = [memoryview(b).cast("i").tolist() for b in pieces.merge_abreast(segments)]
    assert got == [pieces.merge(s) for s in segments]
    texts = ["plain text", "odd \U0001f9ff਀ text", "x" * 200, "▁ mark"]
    known, decoded = pieces.learn({s for t in texts for s in pieces.segments(sentencepiece_bpe.marked(t))}, check=True)
    for t in texts:
        parts = pieces.segments(sentencepiece_bpe.marked(t))
        ids = [i for p in parts for i in memoryview(known[p]).cast("i")]
        assert ids == pieces.library.encode(t) and decoded(parts)[1:] == pieces.library.decode(ids)
