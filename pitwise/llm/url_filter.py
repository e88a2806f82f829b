"""URL filter: rules first, then logistic regression on hashed character n-grams.

A rule is a host with a path prefix (``example.com/en/``) and fits the URLs of that
host and its subdomains whose path starts with the prefix; of several that fit, the
longest wins (then the longer host). What no rule fits is judged by a logistic
regression over the hashed character n-grams of host and path, fitted with
``pyspark.ml`` on a labelled table of at most ``MAX_LABELLED`` rows: a small file of URLs,
URLs composed by rule of a file of terms, and hosts that mean nothing, as ones to allow. Everything is
DataFrame expressions and JVM-side ML: no Python runs on the executors, nothing is
shuffled, and rows are judged where they are read.

Defined results: a null URL or one without ``://`` has an empty host and path, fits
no rule, and is judged like any other; a null id is an id; ties cannot occur between rules of one host;
repeated rows each get a result; a URL of any length is read whole; no rows give none;
other columns are not looked at.
"""

from __future__ import annotations

import csv
import random
from pathlib import Path

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import let

NGRAMS = (3, 4, 5)
FEATURES = 1 << 16
MAX_LABELLED = 100_000
MAX_RULES = 10_000

#: (host, path prefix, verdict), as the rule string ``host + path`` reads.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: ``url,label`` (1: block), read as data; any table of these two columns will do.
LABELLED = Path(__file__).with_name("labelled_urls.csv")
#: ``term,label``: words that sites of a kind have in their names, of kinds to block (gambling,
#: adult, pills, advertising, spam, money, malware, warez, fakes) and of kinds to allow.
TERMS = Path(__file__).with_name("url_terms.csv")
#: Words that any site may have beside those, and paths.
BESIDE = ("online", "best", "my", "world", "club", "zone", "city", "24", "live", "shop", "now", "hub", "direct", "star", "plus", "pro", "daily", "super", "first", "easy", "central", "guide", "home", "net4u", "point", "place", "the", "all", "one", "go")
PATHS = ("", "index.html", "home", "page/2", "about", "en/3", "list/all", "item/17", "start", "category/new", "a/b/c", "2021/05/post", "view?id=4", "contact")
COMPOSED = 7
BACKGROUND = 1_600
#: Chosen on URLs composed with another seed and on other hosts that mean nothing.
PENALTY, BLOCK_WEIGHT = 0.0003, 2.0


def background_urls(n: int = BACKGROUND, seed: int = 11) -> list[tuple[str, float]]:
    """``n`` URLs of hosts that mean nothing, labelled 0: names of consonants and vowels drawn
    at random, or of the letter pairs that are frequent in prose, so that n-grams which the labelled URLs do not have speak for no verdict and
    the balance of labels is that of a crawl, where few hosts are to be blocked."""
    draw = random.Random(seed)

    pairs = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de", "hi", "ri", "ro", "ic", "ne", "ea", "ra", "ce", "li", "ch", "ll", "be", "ma", "si", "om", "ur")

    def name() -> str:
        if draw.random() < 0.5:
            return "".join(draw.choice(pairs) for _ in range(draw.randint(2, 5)))
        return "".join(draw.choice("bcdfghjklmnprstvwz") + draw.choice("aeiou") + draw.choice(["", "", "n", "r", "s", "t", "nd", "th"]) for _ in range(draw.randint(2, 4)))

    ends = ("com", "org", "net", "info", "io")
    return [(f"https://{draw.choice(['', '', 'www.'])}{name()}{draw.choice(['', '-' + name(), '.' + name()])}.{draw.choice(ends)}/{draw.choice([name(), draw.choice(PATHS)])}", 0.0) for _ in range(n)]


def composed_urls(terms: list[tuple[str, float]], each: int = COMPOSED, seed: int = 17) -> list[tuple[str, float]]:
    """``each`` URLs of every term: alone, or before or behind a word that says nothing, with a
    hyphen, as one word or as a subdomain, under paths that say nothing."""
    draw = random.Random(seed)
    shapes = ("{t}", "{t}-{w}", "{w}-{t}", "{t}{w}", "{w}{t}", "{t}.{w}-{v}", "{w}-{t}-{v}")
    out = []
    for term, label in terms:
        for shape in draw.sample(shapes, min(each, len(shapes))):
            host = shape.format(t=term, w=draw.choice(BESIDE), v=draw.choice(BESIDE))
            out.append((f"https://{draw.choice(['', '', 'www.'])}{host}.{draw.choice(['com', 'org', 'net', 'info', 'co'])}/{draw.choice(PATHS)}", label))
    return out


def url_terms(path: str | Path = TERMS) -> list[tuple[str, float]]:
    with open(path, encoding="utf-8", newline="") as file:
        return [(r["term"], float(r["label"])) for r in csv.DictReader(file)]


def labelled_urls(spark: SparkSession, path: str | Path = LABELLED, background: int = BACKGROUND, terms: list[tuple[str, float]] | None = None) -> DataFrame:
    """``url, label`` (1: block): the labelled table at ``path``, a small file of the
    driver, URLs composed of ``terms`` (those of ``TERMS`` if none are given), and ``background`` hosts that mean nothing."""
    with open(path, encoding="utf-8", newline="") as file:
        rows = [(r["url"], float(r["label"])) for r in csv.DictReader(file)]
    return spark.createDataFrame(rows + composed_urls(url_terms() if terms is None else terms) + background_urls(background), "url string, label double")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    after = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(after, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The struct ``rule, verdict`` of the longest rule that fits, or null."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    cases = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ranked]
    return F.coalesce(*cases)


def ngrams(text: Column, kind: str, sizes: tuple[int, ...] = NGRAMS) -> Column:
    """The text's character n-grams, its ends marked, with ``kind`` before each."""
    def grams(chars: Column, n: int) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
        return F.when(F.size(chars) >= n, F.transform(places, lambda i: F.concat(F.lit(kind), *[F.get(chars, i + j) for j in range(n)]))).otherwise(F.array().cast("array<string>"))

    def of(chars: Column) -> Column:
        return F.concat(*[grams(chars, n) for n in sizes])

    return let(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), of)  # characters by place, so that long texts cost no more than their length


def _featured(rows: DataFrame) -> DataFrame:
    host = F.regexp_replace("host", r"^(www|m|mobile|blog)\.", "")  # says nothing about what is served
    hashed = HashingTF(inputCol="__ngrams", outputCol="__features", numFeatures=FEATURES, binary=True)
    return hashed.transform(rows.withColumn("__ngrams", F.concat(ngrams(host, "h"), ngrams(F.col("path"), "p")))).drop("__ngrams")


def train(labelled: DataFrame, penalty: float = PENALTY, block_weight: float = BLOCK_WEIGHT) -> LogisticRegressionModel:
    """Fit on ``url, label`` rows, label 1 meaning block; those weigh ``block_weight`` each, as they are the fewer."""
    if labelled.limit(MAX_LABELLED + 1).count() > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled rows")
    host, path = host_and_path(F.col("url"))
    rows = _featured(labelled.select(F.col("label").cast("double").alias("label"), host.alias("host"), path.alias("path"))).coalesce(1)
    rows = rows.withColumn("__weight", F.when(F.col("label") == 1, block_weight).otherwise(1.0)).persist()
    fit = LogisticRegression(featuresCol="__features", labelCol="label", weightCol="__weight", regParam=penalty, maxIter=30, standardization=False, predictionCol="", rawPredictionCol="", probabilityCol="__p").fit(rows)
    rows.unpersist()
    return fit


def filter_urls(
    pages: DataFrame, model: LogisticRegressionModel, rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and ``score``, the model's probability
    that the URL is to be blocked."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    scored = model.transform(_featured(rows)).withColumn("score", vector_to_array("__p")[1])
    judged = scored.withColumn("__rule", fitting_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", own).alias("verdict"), "score")
