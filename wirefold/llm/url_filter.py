"""URL filter: host and path rules, and boosted trees on lexical features for what no rule names.

A rule fits its host and all subdomains of it, if the path starts with the rule's path; the longest fitting
rule decides. Every other url is judged by gradient-boosted trees trained on the urls that rules do
decide: length, depth, digit and sign ratios, character entropy, parameter counts, and statistics of
the host's suffixes (how often a suffix occurs among the training urls and how often it is blocked).

Training takes at most TRAIN_ROWS labelled urls, chosen by a hash of the url, so the suffix
table has at most twice as many rows and may be broadcast. Features, suffix lookups and scoring are JVM
work on every row; nothing is collected.

Defined results: a null url, or one without ://, has empty host and path and fits no rule; without
labelled urls of both kinds the trees are replaced by the one kind there is, or by ``allow``;
repeated rows are judged alike; further columns are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.llm.shared import Scratch, bounded, fresh
from wirefold.llm.wrappers import host_of

TRAIN_ROWS = 20_000
TREES, DEPTH, STEP = 20, 4, 0.2
PRIOR = 5.0                        # weight of the overall block rate in a suffix's rate


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"),
         Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"),
         Rule("block", "net", "/fr/"))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or nulls."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
                     ).otherwise(out)
    return out


def _count(text: Column, kind: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{kind}]", ""))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text)

    def part(total: Column, char: Column) -> Column:
        share = (size - F.length(F.replace(text, char, F.lit("")))) / size
        return total - share * F.log2(share)
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.when(size > 0, F.aggregate(chars, F.lit(0.0), part)).otherwise(0.0)


LEXICAL = ("url_length", "host_length", "labels", "depth", "digits", "signs", "entropy", "parameters",
           "query_length", "fragment", "hyphens", "host_digits", "last_length")
SUFFIX = ("top_count", "top_blocked", "domain_count", "domain_blocked")


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1)
    some = F.greatest(F.length(text), F.lit(1))
    double = {
        "url_length": F.length(text), "host_length": F.length(host), "labels": _count(host, "."),
        "depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")),
        "digits": _count(text, "0-9") / some, "signs": _count(text, r"^A-Za-z0-9") / some,
        "entropy": _entropy(text),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")),
        "query_length": F.length(query), "fragment": F.instr(text, "#") > 0,
        "hyphens": _count(host, "-"), "host_digits": _count(host, "0-9"),
        "last_length": F.length(F.substring_index(path, "/", -1))}
    return {k: v.cast("double") for k, v in double.items()}


def _suffixes(host: Column) -> dict[str, Column]:
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    return {"top": F.substring_index(bare, ".", -1), "domain": F.substring_index(bare, ".", -2)}


@dataclass
class Filter:
    """Rules, boosted trees for the rest (or one verdict for all of it), and the suffix statistics."""
    rules: tuple[Rule, ...]
    trees: GBTClassificationModel | None
    suffixes: DataFrame | None
    constant: str = "allow"


def _featured(df: DataFrame, suffixes: DataFrame, held: dict[str, str]) -> DataFrame:
    """``df`` with the vector ``held['features']`` made from the url, host and path columns in ``held``."""
    names = {k: fresh(df, f"_{k}") for k in (*LEXICAL, *SUFFIX, "top", "domain")}
    host = F.col(held["host"])
    out = df.withColumns({names[k]: v for k, v in lexical(
        F.col(f"`{held['url']}`"), host, F.col(held["path"])).items()})
    out = out.withColumns({names[k]: v for k, v in _suffixes(host).items()})
    for kind in ("top", "domain"):
        part = suffixes.where(F.col("kind") == kind).select(
            F.col("suffix").alias(names[kind]), F.col("seen").alias(names[f"{kind}_count"]),
            F.col("blocked").alias(names[f"{kind}_blocked"]))
        out = out.join(F.broadcast(part), names[kind], "left")      # at most 2 * TRAIN_ROWS rows
    inputs = [names[k] for k in (*LEXICAL, *SUFFIX)]
    out = out.fillna(-1.0, subset=inputs)
    return VectorAssembler(inputCols=inputs, outputCol=held["features"]).transform(out).drop(
        *names.values())


def train(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url",
          rows: int = TRAIN_ROWS) -> Filter:
    """A filter trained on the urls of ``pages`` that the rules decide."""
    scratch = Scratch(pages.sparkSession, "url-filter")
    address = F.col(f"`{url}`")
    judged = (pages.where(address.isNotNull()).select(address.alias("url")).distinct()
              .select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
              .withColumn("verdict", rule_of(F.col("host"), F.col("path"), rules)["verdict"])
              .where("verdict is not null"))
    sample = scratch.save(bounded(judged, F.col("url"), rows).withColumn(
        "label", (F.col("verdict") == "block").cast("double")), "sample")
    rate = sample.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate")).first()
    if not rate["n"]:
        return Filter(rules, None, None)
    if rate["rate"] in (0.0, 1.0):
        return Filter(rules, None, None, "block" if rate["rate"] else "allow")
    named = _suffixes(F.col("host"))
    suffixes = scratch.save(
        sample.select("label", F.explode(F.array(*[F.struct(
            F.lit(k).alias("kind"), v.alias("suffix")) for k, v in named.items()])).alias("s"))
        .groupBy("s.kind", "s.suffix").agg(
            F.log1p(F.count(F.lit(1)).cast("double")).alias("seen"),
            ((F.sum("label") + PRIOR * rate["rate"]) / (F.count(F.lit(1)) + PRIOR)).alias("blocked")),
        "suffixes", True)
    held = {"url": "url", "host": "host", "path": "path", "features": "features"}
    ready = scratch.save(_featured(sample, suffixes, held).select("label", "features"), "features")
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH,
                          stepSize=STEP, seed=7, checkpointInterval=-1).fit(ready)
    return Filter(rules, trees, suffixes)


def judge(pages: DataFrame, model: Filter, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict (block or allow)."""
    held = {k: fresh(pages, f"_{k}") for k in ("found", "features", "rawPrediction", "probability",
                                               "prediction")}
    address = F.col(f"`{url}`")
    out = pages.withColumns({"host": host_of(address), "path": path_of(address)})
    out = out.withColumn(held["found"], rule_of(F.col("host"), F.col("path"), model.rules))
    if model.trees is None:
        other = F.lit(model.constant)
    else:
        out = _featured(out, model.suffixes, {"url": url, "host": "host", "path": "path",
                                              "features": held["features"]})
        trees = model.trees.copy({model.trees.featuresCol: held["features"],
                                  model.trees.rawPredictionCol: held["rawPrediction"],
                                  model.trees.probabilityCol: held["probability"],
                                  model.trees.predictionCol: held["prediction"]})
        out = trees.transform(out)
        other = F.when(F.col(held["prediction"]) == 1, "block").otherwise("allow")
    found = F.col(held["found"])
    return out.withColumns({"rule": found["rule"], "verdict": F.coalesce(found["verdict"], other)}).drop(
        *held.values())


def digest(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    rows = pages.select("page_id", "url")
    return judge(rows, train(rows)).select("page_id", "host", "path", "rule", "verdict")
