"""URL filter: block and allow rules, and logistic regression on hashed character n-grams for the rest.

Rules are compiled into one CASE expression, longest rule first. The classifier is trained with
DataFrame operations on a small labelled table (at most ``MOST_LABELLED`` rows) by full-batch gradient
descent; its weights, a fixed number of buckets, then are a literal array in the scoring projection.
Everything is column expressions; scoring neither shuffles nor joins.

Null URLs and URLs without ``://`` have an empty host and path; they match no rule and are scored by
the bias alone. Repeated rows are judged each on their own; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, fresh_name

BUCKETS = 4096
GRAM_SIZES = (3, 4, 5)
MOST_LABELLED = 5000
EPOCHS = 12
#: The bias without labelled rows: nothing is blocked then.
NOTHING_LEARNED = -30.0

#: (rule, verdict): a host and the beginning of a path.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)

#: A small labelled table: pages without text worth keeping, and others.
BLOCKED_URLS = (
    "cheap-pills.example.com/en/1", "blog.cheap-pills.example.org/en/22", "www.best-pills.example.com/buy",
    "pills-online.example.org/order?id=3", "casino-bonus.example.com/play", "www.online-casino.example.org/",
    "free-casino.example.com/slots/7", "poker-casino.example.com/en/join", "win-big-slots.example.org/spin",
    "adult-videos.example.com/watch/9", "xxx-live.example.org/cam", "www.hot-xxx.example.com/en/5",
    "free-porn.example.org/clip.html", "replica-watches.example.com/shop", "cheap-replica.example.org/sale",
    "quick-loans.example.com/apply", "payday-loans.example.org/en/now", "crypto-double.example.com/invest",
    "warez-torrent.example.org/download/3", "crack-keygen.example.com/download",
    "click-ads.example.com/track?u=1", "adserver.example.org/banner/44", "shop.example.com/cart/checkout",
    "www.example.com/login?next=home", "m.example.org/account/signup", "tracker.example.com/pixel.gif",
    "spam-links.example.org/seo/1",
)
ALLOWED_URLS = (
    "www.example.com/en/1042", "blog.example.org/fr/77/", "m.example.com/es/311.html", "example.org/de/58#top",
    "www.theworld.example.com/en/2931?page=2&ref=x", "thing.example.org/es/12?utm_source=feed",
    "blog.thestory.example.com/fr/4005", "m.tionhouse.example.org/en/99/", "www.example.com/fr/8251.html",
    "ther.example.com/fr/825?page=2", "www.thand.example.com/es/740", "blog.other.example.com/en/18/",
    "m.another.example.org/de/6204", "station.example.com/fr/19533", "www.nation.example.org/es/2#top",
    "theron.example.com/en/36270.html", "blog.ration.example.org/de/715/", "m.thistle.example.com/es/90",
    "news.example.com/world/2020/05/story", "www.library.example.org/catalog/item/12",
    "docs.example.com/guide/install", "wiki.example.org/history/rome", "science.example.com/articles/quantum",
    "www.museum.example.org/exhibits/art", "school.example.com/lessons/3",
    "blog.gardening.example.org/roses-in-spring", "www.cooking.example.com/recipes/bread",
    "m.travel.example.org/paris", "university.example.com/courses/history",
    "health.example.org/nutrition/basics", "www.weather.example.com/today", "archive.example.org/text/1901",
    "books.example.com/reading/chapter-2", "www.music.example.org/concerts", "council.example.com/minutes/2019",
    "forum.example.org/topic/881", "research.example.com/papers/17",
)
LABELLED_URLS = tuple(
    (f"https://{url}", label) for label, urls in ((1, BLOCKED_URLS), (0, ALLOWED_URLS)) for url in urls
)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule_case: Column | None = None
    verdict_case: Column | None = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        cut = rule.index("/")
        rule_host, rule_path = rule[:cut], rule[cut:]
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(
            path, F.lit(rule_path)
        )
        if rule_case is None:
            rule_case, verdict_case = F.when(fits, rule), F.when(fits, verdict)
        else:
            rule_case, verdict_case = rule_case.when(fits, rule), verdict_case.when(fits, verdict)
    if rule_case is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule_case, verdict_case


def gram_buckets(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the distinct character n-grams of host and path, told apart by a mark."""

    def grams(text: Column, mark: str, size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - size + 1)
        cut = F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(size))))
        return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))

    every = F.concat(*[grams(c, m, n) for c, m in ((host, "h"), (path, "p")) for n in GRAM_SIZES])
    return F.array_distinct(F.transform(every, lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int")))


def train_url_weights(
    labelled: DataFrame, buckets: int = BUCKETS, epochs: int = EPOCHS, rate: float = 12.0, penalty: float = 1e-3
) -> tuple[float, list[float]]:
    """Bias and one weight per bucket from (url, label) rows.

    The table is small by contract: more than ``MOST_LABELLED`` rows are refused. Rows with a null
    label are left out. Each epoch is one grouped sum; the state on the driver is the weight array.
    """
    labelled = labelled.where(F.col("label").isNotNull())
    rows = labelled.limit(MOST_LABELLED + 1).count()
    if rows > MOST_LABELLED:
        raise ValueError(f"the labelled table has more than {MOST_LABELLED} rows")
    bias, weights = 0.0, [0.0] * buckets
    if not rows:
        return NOTHING_LEARNED, weights
    url = F.col("url")
    examples = labelled.select(
        gram_buckets(host_of(url), path_of(url), buckets).alias("b"), F.col("label").cast("double").alias("y")
    ).coalesce(1).cache()
    for _ in range(epochs):
        step = examples.withColumn("p", probability(F.col("b"), bias, weights))
        error = (F.col("y") - F.col("p")) / F.sqrt(F.greatest(F.size("b"), F.lit(1)))
        gradient = (
            step.select(F.explode(F.concat("b", F.array(F.lit(-1)))).alias("bucket"),
                        error.alias("e"), (F.col("y") - F.col("p")).alias("e0"))
            .groupBy("bucket")
            .agg(F.sum("e").alias("g"), F.sum("e0").alias("g0"))
            .collect()
        )
        weights = [w * (1 - penalty) for w in weights]
        for bucket, g, g0 in gradient:
            if bucket < 0:
                bias += rate / 8 * g0 / rows
            else:
                weights[bucket] += rate * g / rows
    examples.unpersist()
    return bias, weights


def probability(grams: Column, bias: float, weights: Sequence[float]) -> Column:
    """Of label 1: the sigmoid of the summed weights over the root of the number of n-grams."""
    array = F.split(F.lit(",".join(f"{w:.12g}" for w in weights)), ",").cast("array<double>")
    total = F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(array, b))
    z = F.lit(float(bias)) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)))
    return 1 / (1 + F.exp(-z))


def default_labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELLED_URLS), "url string, label int")


def judge_urls(
    pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url",
    threshold: float = 0.5,
) -> DataFrame:
    """``pages`` with host, path, rule, score (the classifier's, for every row) and verdict."""
    bias, weights = train_url_weights(labelled)
    made = ("host", "path", "rule", "score", "verdict")
    kept = [c for c in pages.columns if c.lower() not in made]
    grams = fresh_name(pages, "__grams")
    df = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    df = df.select("*", gram_buckets(F.col("host"), F.col("path")).alias(grams))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    df = df.select(
        *kept, "host", "path", rule.alias("rule"), verdict.alias("verdict"),
        probability(F.col(grams), bias, weights).alias("score"),
    )
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return df.select(*kept, "host", "path", "rule", "score", F.coalesce("verdict", learned).alias("verdict"))
