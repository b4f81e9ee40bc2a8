"""Keyword index over short records, ranked lookup, and passage repair."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.functions.text import chunk_body, col, let

FIELDS = ("headline", "description", "company", "summary")
K1, B, MIN_IDF = 1.2, 0.75, 1e-6
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

# The 1980 suffix stripper: (suffix, replacement) tables of its steps 2, 3 and 4.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
          ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
          ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
          ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
          ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
          ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti",
          "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def _shape(word: str) -> str:
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, table, floor: int) -> str:
    for suffix, to in sorted(table, key=lambda p: -len(p[0])):
        if word.endswith(suffix):
            base = word[:-len(suffix)]
            return base + to if _measure(base) > floor else word
    return word


def stem(word: str) -> str:
    """English suffix stripping of one lower-case word."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            base = word[:-len(suffix)]
            if word.endswith(suffix) and "v" in _shape(base):
                word = base
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" \
                        and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2, 0), _STEP3, 0)
    for suffix in _STEP4:
        if word.endswith(suffix):
            base = word[:-len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def terms(c: Column | str) -> Column:
    """Words of a text: lower case, accents dropped, split at anything but letters and digits."""
    text = F.translate(F.lower(F.coalesce(col(c), F.lit(""))), _ACCENTED, _PLAIN)
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


_known_stem = lru_cache(1 << 16)(stem)


def _stems(words: pd.Series) -> pd.Series:
    """Stems of the words of texts. A task keeps the stems of the words it met last."""
    return words.map(lambda found: [_known_stem(w) for w in found])


def word_counts(words: Column) -> Column:
    """array<struct(term, tf)> of a text's words, without a shuffle: a term's place is where its run in the
    sorted words begins."""
    def runs(w: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        return let(F.struct(w.alias("w"), begins.alias("at")), lambda s: F.transform(s["at"], lambda i, n: F.struct(
            F.get(s["w"], i).alias("term"),
            (F.coalesce(F.get(s["at"], n + 1), F.size(s["w"])) - i).cast("bigint").alias("tf"))))
    return let(F.array_sort(words), lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(
        F.array().cast("array<struct<term:string,tf:bigint>>")))


def postings(docs: DataFrame, fields: tuple[str, ...] = FIELDS, stemming: bool = True) -> DataFrame:
    """(id, field, term, tf), meant to be stored, of docs with one row for an id. Words are counted and
    stemmed where the texts lie."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), terms(f).alias("terms")) for f in fields])
    words = docs.select("id", F.explode(parts).alias("p")).select("id", "p.field", "p.terms")
    if stemming:
        words = words.withColumn("terms", F.pandas_udf(_stems, "array<string>")("terms"))
    return words.select("id", "field", F.explode(word_counts(F.col("terms"))).alias("w")).select("id", "field", "w.*")


def update_postings(index: DataFrame, changed: DataFrame, removed: DataFrame | None = None,
                    **options) -> DataFrame:
    """The index after documents changed (or were added) and others were removed."""
    gone = changed.select("id")
    if removed is not None:
        gone = gone.unionByName(removed.select("id"))
    return index.join(gone.distinct(), "id", "left_anti").unionByName(
        postings(changed, **options).select(*index.columns))


def ranked(index: DataFrame, query: str, docs: int | None = None, stemming: bool = True,
           limit: int | None = None) -> DataFrame:
    """(id, score, matched) by BM25 over all fields, best first.

    For an index that is at hand as a table: lengths are summed from all its postings. An index
    that is stored and kept in step is ``term_index``, whose lookups read the files of their words alone.
    """
    words = sorted({stem(w) if stemming else w for w in query_terms(query)})
    lengths = index.groupBy("id").agg(F.sum("tf").alias("length"))
    totals = lengths.agg(F.struct(F.count("*").alias("n"), F.avg("length").alias("avg_length"))
                         ).scalar()
    hits = (index.where(F.col("term").isin(words)).groupBy("id", "term")
            .agg(F.sum("tf").alias("tf")))
    found = hits.groupBy("term").agg(F.count("*").alias("df"))
    n = F.lit(docs) if docs is not None else F.col("totals.n")
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(MIN_IDF))
    weight = idf * F.col("tf") * (K1 + 1) / (
        F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("totals.avg_length")))
    # ``found`` has a row per query word.
    scored = (hits.join(F.broadcast(found), "term").join(lengths, "id")
              .withColumn("totals", totals).withColumn("weight", weight)
              .groupBy("id").agg(F.sum("weight").alias("score"), F.count("*").alias("matched")))
    scored = scored.orderBy(F.col("score").desc(), "id")
    return scored.limit(limit) if limit else scored


def query_terms(query: str) -> list[str]:
    table = str.maketrans(_ACCENTED, _PLAIN)
    return re.findall(r"[^\W_]+", query.lower().translate(table))


def tiered(index: DataFrame, docs: DataFrame, query: str, entity: str, limit: int,
           stemming: bool = True) -> DataFrame:
    """Ranked with documents about ``entity`` first: with a query word, without, then the rest."""
    named = docs.where(F.lower("company").contains(entity.strip().lower())).select(
        "id", F.lit(True).alias("about"))
    both = ranked(index, query, stemming=stemming).join(named, "id", "full_outer")
    tier = F.when(F.col("about") & F.col("score").isNotNull(), 1).when(F.col("about"), 2).otherwise(3)
    return (both.select("id", tier.alias("tier"), F.coalesce("score", F.lit(0.0)).alias("score"))
            .orderBy("tier", F.col("score").desc(), "id").limit(limit))


def chunks(articles: DataFrame) -> DataFrame:
    return articles.select(F.col("id").alias("article_id"), F.lit(0).alias("chunk_index"),
                           chunk_body("headline", "description").alias("text"))


def drifted_chunks(articles: DataFrame, stored: DataFrame) -> DataFrame:
    """Passages that are missing or no longer quote their article."""
    old = stored.where("chunk_index = 0").select("article_id", F.col("text").alias("old"))
    return (chunks(articles).join(old, "article_id", "left")
            .where(F.col("old").isNull() | (F.col("old") != F.col("text"))).drop("old"))
