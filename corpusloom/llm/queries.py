"""One query per operator over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    centroids,
    chat,
    decontaminate,
    html_text,
    language,
    periodic,
    quality,
    revisits,
    sentencepiece_bpe,
    sharding,
    simhash,
    toxicity,
    url_filter,
)
from corpusloom.llm.common import table, words_of


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.with_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def capture_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures made from ``pages``: each page as a full response and as revisits of several kinds.

    Times are seconds. Revisits name the page by other spellings of its URL; every fifth page has one whose
    ETag differs, every seventh one from before its response, every eleventh one without validators, and
    every third page was captured in full once more, with the same payload.
    """
    page, url = F.col("page_id"), F.col("url")
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    at = F.lit(1_700_000_000) + page * 60
    host = F.regexp_replace(url, r"^https?://", "")

    def record(n: int, when, spelling, kind: str, status: int, headers: dict, digest) -> Column:
        pairs = [F.concat(F.lit(f"{k}: "), v) for k, v in headers.items() if v is not None]
        return F.struct(
            (page * 8 + n).alias("record_id"), spelling.alias("url"), when.cast("bigint").alias("captured"),
            F.lit(kind).alias("kind"), F.lit(status).alias("status"),
            F.concat_ws("\r\n", *pairs).alias("block"), digest.alias("digest"),
        )

    def full(n: int, when) -> Column:
        return record(
            n, when, url, "response", 200,
            {"Content-Type": F.lit("text/html"), "Content-Length": F.length("html").cast("string"), "ETag": tag,
             "Date": when.cast("string"), "Cache-Control": F.lit("max-age=60")}, F.md5("html"),
        )

    def revisit(n: int, when, spelling, etag, digest) -> Column:
        return record(
            n, when, spelling, "revisit", 304,
            {"Content-Length": F.lit("0"), "ETag": etag, "Date": when.cast("string"), "Age": F.lit("1")}, digest,
        )

    none = F.lit(None).cast("string")
    rows = F.array(
        full(0, at),
        F.when(page % 3 == 0, full(1, at + 500_000)),
        revisit(2, at + 400_000, F.concat(F.lit("HTTP://WWW."), host), F.concat(F.lit("W/"), tag), F.md5("html")),
        revisit(3, at + 900_000, F.concat(url, F.lit("#later")), tag, none),
        F.when(page % 5 == 0, revisit(4, at + 900_001, url, F.lit('"other"'), none)),
        F.when(page % 7 == 0, revisit(5, at - 1, url, tag, F.md5("html"))),
        F.when(page % 11 == 0, revisit(6, at + 900_002, url, None, none)),
    )
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    captures = pages.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")
    return captures.withColumn("headers", revisits.header_map(F.col("block"))).drop("block")


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = revisits.resolve_revisits(capture_records(spark, sf_dir))
    return resolved.select(
        "record_id", "canonical", "captured", "refers_to", "refers_captured", "state",
        revisits.header_block(F.col("headers")).alias("header_block"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    judged = url_filter.judge_urls(pages, url_filter.default_labelled(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, sf_dir, "documents", "doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.train(docs, labels, "crc32(cast(doc_id as string)) % 5 <> 0")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = toxicity.with_toxicity(docs, toxicity_model(spark, sf_dir))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    )
    n_hit = decontaminate.covered_words(F.col("spans"))
    items = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""All conversations and one more (-7) whose texts hold the template's own marks."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    chats = chat.format_chats(rows.unionByName(extra))
    turns = chat.read_chat(F.col("formatted"))
    joined = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    read = chats.select(
        "conv_id",
        turns.alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss")).alias("trained"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def language_model(spark: SparkSession, sf_dir: str) -> language.Model | None:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language.train(docs, "crc32(cast(doc_id as string)) % 4 <> 2")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    predicted = language.with_language(docs, language_model(spark, sf_dir))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def digest_of_ids(encoded: DataFrame) -> DataFrame:
    """The digest columns of an encoded table with doc_id, ids and decoded."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return digest_of_ids(sentencepiece_bpe.encode_and_decode(docs, piece_model()))


def piece_model() -> bytes:
    import public_tokenizers

    return sentencepiece_bpe.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with words that repeat at the end of every tenth text (drawn by doc_id; a null one never).

    From word a on, word i becomes word a + (i - a) % p.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.col("__words")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    unit = F.slice(words, a + 1, p)
    again = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), 1, n - a)
    text = F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), again), " ")).otherwise(F.col("text"))
    return docs.withColumn("__words", F.when(h % 10 == 0, words_of(F.col("text")))).withColumn("text", text).drop("__words")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.with_runs(planted_repeats(table(spark, sf_dir, "documents", "doc_id", "text")))
    more = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | more(r, b), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return centroids.cluster_vectors(vectors, "vec_id", "embedding")


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by ``bytes``: contiguous in doc_id, cut at equal parts of all bytes."""
    placed = sharding.balanced_shards(table(spark, sf_dir, "documents", "doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_html_text, op3_warc_revisits, op4_url_filter, op5_quality_rules, op6_toxicity,
        op7_decontaminate, op8_chat_format, op9_language_id, op10_sentencepiece, op11_periodic_runs,
        op12_centroid_clusters, op13_shards,
    )
}
