"""Cleaning and comparing short texts (headlines, labels, snippets)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"
SPACE = r"(?U)[\s\x1c-\x1f]+"
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# --- fixed values -------------------------------------------------------------
# Words carrying no identity in a headline: grammar, units, funding jargon.
STOPWORDS = tuple("""
a an the and or of in on at to for from with by as is are was were be been
its it this that these those new now after over into amid ahead
said says report reports reportedly exclusive update updates breaking
crore lakh million billion mn bn cr rs inr usd
startup startups company firm platform based india indian
raise raises raised raising round rounds funding funds fund
secure secures secured bags nets gets wins
early stage seed pre series capital
investment investments invest invests investing
""".split())
# Headlines that bundle several stories.
ROUNDUP = (r"(?i)&\s*more|and more|round-?up|this week|weekly|digest|highlights"
           r"|top stories|ecosystem (pulse|buzz)")
NULL_LABELS = ("", "null", "none", "n/a", "na", "undisclosed", "unknown", "not disclosed")
NULL_COMPANIES = ("", "null", "none", "n/a", "unknown", "na")
STORY_KEY_TOKENS = 8
MIN_TOKENS_FOR_CONTAINMENT = 4
MIN_CLAUSE_TOKENS = 3
CLAUSE_OVERLAP_FLOOR = 0.25
STEER_WORDS = (r"(?i)\b(startups?|funding|funded|raises?|raised|founders?|venture|vcs?|"
               r"unicorns?|ipo|seed|series\s+[a-h]|valuation|acqui\w*|m&a)\b")
# Named character references met in feeds and pages.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
    "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "bull": "•", "middot": "·", "copy": "©", "reg": "®",
    "trade": "™", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "deg": "°",
    "times": "×", "laquo": "«", "raquo": "»", "eacute": "é", "egrave": "è",
    "agrave": "à", "aacute": "á", "iacute": "í", "oacute": "ó", "uacute": "ú",
    "ntilde": "ñ", "ccedil": "ç", "auml": "ä", "ouml": "ö", "uuml": "ü", "szlig": "ß",
}
# ------------------------------------------------------------------------------


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column | str, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it.

    Without this an expression is repeated at every use, and chains of them grow the plan
    exponentially.
    """
    return F.get(F.transform(F.array(col(value)), body), F.lit(0))


def array_of(values, of: str = "string") -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{of}>")


def map_of(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), SPACE, " "))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), EDGE_SPACE, "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def word_cut(c: Column | str, limit: int) -> Column:
    """At most ``limit`` characters, cut back to a whole word and marked."""
    def cut(t: Column) -> Column:
        head = F.regexp_replace(F.substring(t, 1, limit), r" [^ ]*$", "")
        return F.when(F.length(t) > limit, F.concat(head, F.lit(ELLIPSIS))).otherwise(t)

    return let(c, cut)


def _entity(piece: Column) -> Column:
    name = F.regexp_extract(piece, r"^&([A-Za-z]+);$", 1)
    digits = F.regexp_extract(piece, r"^&#(\d{1,7});$", 1)
    hexes = F.regexp_extract(piece, r"^&#[xX]([0-9A-Fa-f]{1,6});$", 1)
    code = F.coalesce(digits.try_cast("int"), F.conv(blank_to_null(hexes), 16, 10).try_cast("int"))
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (F.when(~piece.startswith("&"), piece)
            .when(valid, char)
            .otherwise(F.coalesce(F.try_element_at(map_of(ENTITIES), name), piece)))


def unescape(c: Column | str) -> Column:
    """Character references decoded in one pass, so ``&amp;lt;`` yields ``&lt;``."""
    c = col(c)
    def decoded(t: Column) -> Column:
        pieces = F.regexp_extract_all(
            t, F.lit(r"(&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]+);|[^&]+|&)"), F.lit(1))
        return F.when(t.contains("&"), F.array_join(F.transform(pieces, _entity), "")).otherwise(t)

    return let(c, decoded)


def feed_text(c: Column | str, limit: int = 600) -> Column:
    """Markup and references removed; null when nothing is left."""
    plain = squeeze(unescape(F.regexp_replace(col(c), r"<[^>]+>", " ")))
    return word_cut(let(plain, blank_to_null), limit)


def markdown_text(c: Column | str, limit: int = 320) -> Column:
    """Markdown flattened to one line."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"(^|\s)#{1,6}\s+|\*\*|__|`|\|", " ")
    return word_cut(squeeze(text), limit)


def snippet(c: Column | str, limit: int = 400) -> Column:
    return word_cut(squeeze(c), limit)


def label_text(c: Column | str, limit: int) -> Column:
    """A model's label: placeholders become null, edges trimmed, length capped."""
    return let(F.btrim(squeeze(c), F.lit(" .,;")), lambda t: F.when(
        ~F.lower(t).isin(*NULL_LABELS), blank_to_null(F.substring(t, 1, limit))))


def company_text(c: Column | str, limit: int = 200) -> Column:
    return let(F.btrim(squeeze(c), F.lit(" .,")), lambda t: F.when(
        ~F.lower(t).isin(*NULL_COMPANIES), F.substring(t, 1, limit)))


def steer_query(c: Column | str) -> Column:
    """Point a bare query at startup news."""
    text = squeeze(F.coalesce(col(c), F.lit("")))
    return F.when((text != "") & ~text.rlike(STEER_WORDS),
                  F.concat(text, F.lit(" startup news"))).otherwise(text)


def chunk_body(headline: Column | str, description: Column | str) -> Column:
    headline, description = col(headline), col(description)
    return F.when(F.coalesce(description, F.lit("")) != "",
                  F.concat(headline, F.lit("\n\n"), description)).otherwise(headline)


# --- headline identity ----------------------------------------------------------

def _lower(c: Column | str) -> Column:
    return F.lower(F.coalesce(col(c), F.lit("")))


def tokens(c: Column | str) -> Column:
    """Sorted distinct identifying words: runs of a-z0-9 of three or more, or digits.

    One pattern does the splitting and the length rule, so no per-element lambda
    runs over the words.
    """
    words = F.regexp_extract_all(
        _lower(c), F.lit(r"((?<![a-z0-9])(?:[a-z0-9]{3,}|[0-9]+)(?![a-z0-9]))"), F.lit(1))
    return F.array_sort(F.array_except(words, array_of(STOPWORDS)))


def numbers(c: Column | str) -> Column:
    """Sorted distinct all-digit words. "12.5" gives 12 and 5; "85m" gives none."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(
        _lower(c), F.lit(r"((?<![a-z0-9])[0-9]+(?![a-z0-9]))"), F.lit(1))))


def figures(c: Column | str) -> Column:
    """Numbers that identify a deal: calendar years 1900-2100 left out."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(
        _lower(c),
        F.lit(r"((?<![a-z0-9])(?!(?:19[0-9]{2}|20[0-9]{2}|2100)(?![a-z0-9]))[0-9]+(?![a-z0-9]))"),
        F.lit(1))))


def figures_conflict(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def story_key(headline: Column | str, toks: Column | None = None) -> Column:
    toks = tokens(headline) if toks is None else toks
    fallback = F.substring(F.lower(strip(F.coalesce(col(headline), F.lit("")))), 1, 50)
    key = F.when(F.size(toks) > 0,
                 F.array_join(F.slice(toks, 1, STORY_KEY_TOKENS), " ")).otherwise(fallback)
    return F.sha1(key)


def url_hash(url: Column | str) -> Column:
    return F.sha1(F.lower(strip(F.coalesce(col(url), F.lit("")))))


def phrase_hash(phrase: Column | str) -> Column:
    return F.sha1(F.lower(strip(phrase)))


def content_hash(headline: Column | str, description: Column | str) -> Column:
    return F.sha1(F.concat(col(headline), F.lit("\n"), F.coalesce(col(description), F.lit(""))))


def clauses(headline: Column | str) -> Column:
    """Token sets of the parts between ; and |, short parts left out."""
    parts = F.split(F.coalesce(col(headline), F.lit("")), "[;|]")
    return F.filter(F.transform(parts, tokens), lambda t: F.size(t) >= MIN_CLAUSE_TOKENS)


def headline_profile(headline: Column | str) -> Column:
    """Everything headline comparison looks at, computed once per headline."""
    h = col(headline)
    toks = tokens(h)
    split_up = h.rlike("[;|]")
    return F.struct(
        toks.alias("tokens"),
        F.when(split_up, clauses(h)).otherwise(
            F.array().cast("array<array<string>>")).alias("clauses"),
        F.coalesce(h.rlike(ROUNDUP), F.lit(False)).alias("roundup"),
    )


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        shared / (F.size(a) + F.size(b) - shared))


def containment(a: Column, b: Column) -> Column:
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / smaller)


def set_similarity(a: Column, b: Column) -> Column:
    long_enough = F.least(F.size(a), F.size(b)) >= MIN_TOKENS_FOR_CONTAINMENT
    return F.when(long_enough, F.greatest(jaccard(a, b), containment(a, b))).otherwise(
        jaccard(a, b))


def multi_topic(longer: Column, other_tokens: Column) -> Column:
    """The longer headline (a profile) covers something the other does not."""
    parts = longer["clauses"]
    stray = F.exists(parts, lambda c: containment(c, other_tokens) < CLAUSE_OVERLAP_FLOOR)
    return longer["roundup"] | ((F.size(parts) >= 2) & stray)


def guarded(a: Column, b: Column) -> Column:
    """multi_topic with the longer side chosen; ``a`` wins a tie in token count."""
    return F.when(F.size(a["tokens"]) >= F.size(b["tokens"]),
                  multi_topic(a, b["tokens"])).otherwise(multi_topic(b, a["tokens"]))


def profile_similarity(a: Column, b: Column) -> Column:
    return F.when(guarded(a, b), jaccard(a["tokens"], b["tokens"])).otherwise(
        set_similarity(a["tokens"], b["tokens"]))


def headline_similarity(a: Column | str, b: Column | str) -> Column:
    return profile_similarity(headline_profile(a), headline_profile(b))
