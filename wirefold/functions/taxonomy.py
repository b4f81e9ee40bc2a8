"""Untrusted labels coerced into closed sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirefold.functions.text import blank_to_null, col, label_text, let, map_of, squeeze, strip

# --- fixed values -------------------------------------------------------------
CATEGORIES = ("Funding", "M&A", "IPO", "Product Launch", "Policy/Regulation",
              "Hiring/Layoffs", "Shutdown", "Partnership", "Market/Analysis", "Other")
STAGES = ("Pre-Seed", "Seed", "Series A", "Series B", "Other")
STAGE_KEYS = {"pre-seed": "Pre-Seed", "seed": "Seed", "series-a": "Series A",
              "series-b": "Series B", "other": "Other"}
WANTED_STAGES = ("Pre-Seed", "Seed", "Series A", "Series B")
FIRM_POST_KINDS = ("Investment", "Portfolio news", "Fund news", "Other")
FIRM_POST_SYNONYMS = {"portfolio": "Portfolio news", "fund": "Fund news",
                      "investments": "Investment"}
SOCIAL_KINDS = ("Funding", "News", "Other")
SOCIAL_SYNONYMS = {"investment": "Funding", "fundraise": "Funding"}
ROUND_ACRONYMS = {"ipo": "IPO", "ncd": "NCD", "vc": "VC"}
# ------------------------------------------------------------------------------


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(map_of(table), key), F.lit("Other"))


def category(c: Column | str) -> Column:
    key = F.regexp_replace(F.lower(strip(c)), "[/ ]", "")
    return _lookup(key, {v.lower().replace("/", "").replace(" ", ""): v for v in CATEGORIES})


def firm_post_kind(c: Column | str) -> Column:
    key = F.regexp_replace(F.lower(strip(c)), " ", "")
    return _lookup(key, {**{v.lower().replace(" ", ""): v for v in FIRM_POST_KINDS},
                         **FIRM_POST_SYNONYMS})


def social_kind(c: Column | str) -> Column:
    return _lookup(F.lower(strip(c)), {**{v.lower(): v for v in SOCIAL_KINDS},
                                       **SOCIAL_SYNONYMS})


def _stage_of(c: Column) -> Column:
    key = F.regexp_replace(F.lower(strip(c)), "[- ]", "")
    return (F.when(key == "other", F.lit("Other"))
            .when(key == "seed", "Seed")
            .when(key.startswith("preseriesa") | (key == "bridge"), "Seed")
            .when(key.startswith("preseed") | key.startswith("angel"), "Pre-Seed")
            .when(key.startswith("seriesa"), "Series A")
            .when(key.startswith("seriesb"), "Series B"))


def stage(value: Column | str, round_label: Column | str | None = None) -> Column:
    """The given stage, else what the round's name says. "Other" settles it at once."""
    options = [_stage_of(col(value))]
    if round_label is not None:
        options.append(_stage_of(col(round_label)))
    return F.coalesce(*options, F.lit("Other"))


def round_label(c: Column | str) -> Column:
    """One spelling for round names: "pre seed" -> "Pre-Seed", "series a" -> "Series A"."""
    text = F.regexp_replace(squeeze(F.lower(col(c))), r"\bpre[\s-]+", "pre-")
    words = F.split(text, " ")

    def capital(p: Column) -> Column:
        return F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))

    def word(w: Column, i: Column) -> Column:
        follows_series = (i > 0) & (F.get(words, i - 1) == "series")
        return F.array_join(F.transform(F.split(w, "-"), lambda p: (
            F.when(p.isin(*ROUND_ACRONYMS), F.upper(p))
            .when(follows_series & p.rlike(r"^\p{L}{1,2}$"), F.upper(p))
            .otherwise(capital(p)))), "-")

    return F.when(F.coalesce(col(c), F.lit("")) != "",
                  F.array_join(F.transform(words, word), " "))


def clean_round(c: Column | str) -> Column:
    return round_label(label_text(c, 80))


def split_investors(c: Column | str) -> Column:
    return F.split(col(c), r"\s*(?:,|;| and )\s*")


def clean_investors(names: Column | str) -> Column:
    """Names cleaned, placeholders dropped, first spelling of each kept."""
    kept = F.filter(F.transform(col(names), lambda n: label_text(n, 120)),
                    lambda n: n.isNotNull())

    def first_spelling(k: Column) -> Column:
        return let(F.struct(k.alias("kept"), F.transform(k, F.lower).alias("low")), lambda s: F.filter(
            s["kept"], lambda n, i: F.array_position(s["low"], F.lower(n)) == i + 1))
    return let(kept, first_spelling)


def investors_text(names: Column | str) -> Column:
    return let(F.array_join(clean_investors(names), "; "), blank_to_null)


def investors_list(text: Column | str) -> Column:
    """The stored "A; B" form as an array."""
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), "; "), lambda n: n != "")
