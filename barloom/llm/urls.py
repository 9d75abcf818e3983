"""URL filter: listed prefixes first, then boosted trees over lexical features, all in SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.boosting import Trees, bounded, train

#: Host words that label a URL as unwanted where no other labels are given.
UNWANTED = ("ads", "bets", "casino", "cheap", "loans", "pills", "poker", "porn", "spam", "track", "xxx")
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Labelled URLs to learn from, of each label about.
SAMPLE = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "f_length f_host_length f_path_length f_depth f_labels f_digits f_entropy f_hyphens f_parameters f_fragment "
    "f_suffix1 f_suffix2"
).split()


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls. Rules are a list of the caller."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def label_by_words(host: Column, words=UNWANTED) -> Column:
    """1 if one of the words stands between dots and hyphens of the host, else 0."""
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, words))).cast("int")


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds `host`, `path` and the features that need no statistics."""
    text = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    df = urls.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    host, path = F.col("host"), F.col("path")
    size = F.greatest(F.length(host), F.lit(1))
    known = F.lit(0)
    entropy = F.lit(0.0)
    for c in _LOWER + "0123456789-.":
        n = F.length(host) - F.length(F.replace(host, F.lit(c), F.lit("")))
        known += n
        entropy += F.when(n > 0, -n / size * F.log(n / size)).otherwise(0.0)
    rest = F.length(host) - known
    return df.withColumns(
        {
            "f_length": F.length(text),
            "f_host_length": F.length(host),
            "f_path_length": F.length(path),
            "f_depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
            "f_labels": F.size(F.split(host, r"\.")),
            "f_digits": F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(F.length(text), F.lit(1)),
            "f_entropy": entropy + F.when(rest > 0, -rest / size * F.log(rest / size)).otherwise(0.0),
            "f_hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
            "f_parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
            "f_fragment": F.contains(text, F.lit("#")).cast("int"),
            "_suffix1": F.substring_index(host, ".", -1),
            "_suffix2": F.substring_index(host, ".", -2),
        }
    )


@dataclass(frozen=True)
class UrlModel:
    """Trees, and the share of label 1 by suffix, a table of no more rows than the sample."""

    trees: Trees
    rates: DataFrame
    prior: float


def _with_rates(df: DataFrame, rates: DataFrame, prior: float) -> DataFrame:
    for n in "12":
        table = F.broadcast(rates.select(F.col("suffix").alias(f"_suffix{n}"), F.col("rate").alias(f"f_suffix{n}")))
        df = df.join(table, f"_suffix{n}", "left").withColumn(f"f_suffix{n}", F.coalesce(f"f_suffix{n}", F.lit(prior)))
    return df


def fit(labelled: DataFrame, url: str = "url", label: str = "label", sample: int = SAMPLE) -> UrlModel:
    """A model from labelled URLs (label 0 or 1; null labels are left out).

    Each distinct URL counts once; about `sample` URLs of each label are used. Half of the
    hosts give the suffix statistics, smoothed towards the overall share, the other half the
    trees, so that the trees meet suffix rates that their own labels didn't make.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(url).alias("url"), F.col(label).alias("label")).distinct()
    rows = lexical(bounded(rows, "label", F.col("url"), sample)).withColumn("_half", F.pmod(F.xxhash64("host", F.lit(11)), F.lit(2)))
    ones, n = rows.agg(F.sum("label"), F.count("*")).first()
    prior = float(ones / n) if n else 0.0
    rates = (
        rows.where("_half = 0")
        .select("label", F.explode(F.array_distinct(F.array("_suffix1", "_suffix2"))).alias("suffix"))
        .groupBy("suffix")
        .agg(((F.sum("label") + F.lit(10 * prior)) / (F.count("*") + 10)).alias("rate"))
    )
    return UrlModel(train(_with_rates(rows.where("_half = 1"), rates, prior), FEATURES, "label"), rates, prior)


def judge(urls: DataFrame, model: UrlModel, rules=RULES, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, verdict (`allow` or `block`) and block_score to every row.

    A rule's verdict goes first; else the URL is blocked from a score of `threshold` on. Null
    URLs and those without `://` have an empty host and path and get the model's verdict.
    Repeated rows stay, an empty table gives no rows, and own columns of those names are
    replaced. With labels of one class only, the score is that class everywhere.
    """
    own = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    rows = urls.select(F.struct(*own).alias("_row"), F.col(url).alias("_url"))
    rows = _with_rates(lexical(rows, "_url"), model.rates, model.prior).withColumn("block_score", model.trees.probability())
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return rows.select("_row.*", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "block_score")


def op5_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on all pages; the labels come from unwanted host words of the pages' URLs."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    model = fit(pages.select("url", label_by_words(host_of(F.col("url"))).alias("label")))
    return judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "block_score")
