"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is DataFrame functions. A pattern's places come from splitting the text at its matches:
the lengths of the pieces and of the matches add up to the offsets (code points, end exclusive).
The patterns are written so that no text is scanned from every position of a long run: a run of
mailbox or digit characters is only tried at its start or where the last match ended, and the
repeats are possessive, which changes no match.

Every proposal scores PROPOSED, plus CONFIRMED if its checksum or range test holds, plus CONTEXT if
a word of its kind stands just before it. The four base kinds are kept whenever their test holds,
whatever the score; a further kind is kept from THRESHOLD on.

Defined results: a null text counts as empty and has no spans, and masking leaves it null; spans of
different kinds may overlap and are all reported, masking covers their union; repeated rows are
treated alike; further columns are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.functions.text import let
from wirefold.llm.shared import fresh

PROPOSED, CONFIRMED, CONTEXT, THRESHOLD = 0.4, 0.4, 0.2, 0.6
NEARBY = 24                                  # characters before a span that are read for context

BLOCK = 256                                # elements folded into one array
PIECE = 4096                               # code points of a text that are walked at once
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    context: str
    base: bool


# What is looked for, in the order in which spans of one start are listed.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "mail|contact|write to", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "ip|host|server|address", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "card|visa|master|amex|pay|credit", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "phone|tel|call|mobile|fax", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
         "iban|account|bank|konto|transfer", False),
    Kind("secret", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])",
         "token|secret|key|passw|auth|bearer", False),
)


def _mod97(text: Column) -> Column:
    """1 for a valid account number: the first four characters moved to the end, letters as 10..35."""
    turned = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise(
            (rest * 10 + code - 48) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _test(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(f"^{_BYTE}(?:[.]{_BYTE}){{3}}$")
    if kind == "card":
        digits = F.translate(found, " -", "")
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.translate(found, "+ ().-", "")).between(10, 15)
    if kind == "iban":
        return _mod97(found) == 1
    return F.lit(True)


def _running(values: Column, step, none: str = "int") -> Column:
    """``step`` folded over the array ``values``, every result on the way. A block is folded at a time,
    then the blocks' last results: appending to one array for the whole would copy it for every element."""
    kind = f"array<{none}>"

    def along(some: Column) -> Column:
        return F.aggregate(some, F.array().cast(kind), lambda out, x: F.concat(out, F.array(
            F.when(F.size(out) == 0, x).otherwise(step(F.get(out, F.size(out) - 1), x)))))

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda i: along(
            F.slice(v, i * BLOCK + 1, BLOCK)))

    def joined(parts: Column) -> Column:
        lasts = along(F.transform(parts, lambda p: F.get(p, F.size(p) - 1)))
        return let(lasts, lambda last: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(
            F.transform(p, lambda x: step(F.get(last, i - 1), x))))))
    return F.when(F.size(values) == 0, F.array().cast(kind)).otherwise(let(values, lambda v: let(blocks(v), joined)))


def _spans_of(kind: Kind, rank: int, text: Column) -> Column:
    """The kept spans of one kind, in order; ``text`` is not null."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)
    checked = kind.name not in ("email", "secret")

    def spans(pairs: Column) -> Column:
        ends = _running(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["hit"])), lambda a, b: a + b)
        return F.zip_with(pairs, ends, span)

    def span(pair: Column, stop: Column) -> Column:
        hit, gap = pair["hit"], pair["gap"]
        near = F.lower(F.right(gap, F.lit(NEARBY))).rlike(kind.context)
        score = (F.lit(PROPOSED + (CONFIRMED if checked else 0.0))
                 + F.when(near, CONTEXT).otherwise(0.0))
        good = _test(kind.name, hit)
        if not kind.base:
            good = good & (score >= THRESHOLD)
        return F.when(good, F.struct((stop - F.length(hit)).alias("start"), F.lit(rank).alias("rank"), stop.alias("end"),
                                     F.lit(kind.name).alias("kind"), score.alias("score")))
    none = F.array().cast("array<struct<start: int, rank: int, end: int, kind: string, score: double>>")
    # A match goes with the piece before it; the last piece has none.
    pairs = F.filter(F.arrays_zip(pieces.alias("gap"), hits.alias("hit")), lambda p: p["hit"].isNotNull())
    return F.when(F.size(hits) == 0, none).otherwise(F.filter(let(pairs, spans), lambda s: s.isNotNull()))


def find(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with ``spans``: array of (start, rank, end, kind, score), by start, then kind."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    parts = {fresh(df, f"_{k.name}_spans"): _spans_of(k, i, whole) for i, k in enumerate(KINDS)}
    found = df.withColumns(parts)
    return found.withColumn(spans, F.array_sort(F.concat(*parts))).drop(*parts)


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every stretch covered by spans replaced by the kind of its first span.

    The text is read in pieces of PIECE code points, so that a stretch far inside costs no walk from
    the beginning.
    """
    def between(pieces: Column, start: Column, stop: Column) -> Column:
        first, last = F.floor(start / PIECE).cast("int"), F.floor((stop - 1) / PIECE).cast("int")
        held = F.array_join(F.slice(pieces, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
        return F.substr(held, start - first * PIECE + 1, F.greatest(stop - start, F.lit(0)))

    def rebuilt(v: Column) -> Column:
        pieces, found, reach = v["pieces"], v["spans"], v["reach"]

        def part(span: Column, i: Column) -> Column:
            before = F.when(i == 0, 0).otherwise(F.get(reach, i - 1))
            return F.when(span["start"] < before, "").otherwise(F.concat(
                between(pieces, before, span["start"]), F.lit("["), F.upper(span["kind"]), F.lit("]")))
        return F.concat(F.array_join(F.transform(found, part), ""),
                        between(pieces, F.get(reach, F.size(reach) - 1), F.length(text)))
    reach = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(let(F.struct(
        pieces.alias("pieces"), spans.alias("spans"), reach.alias("reach")), rebuilt))


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with personal data in ``text`` replaced by its kind in brackets."""
    spans = fresh(df, "_spans")
    found = find(df, text, spans)
    return found.withColumn(text, masked(F.col(f"`{text}`").cast("string"), F.col(spans))).drop(spans)


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of documents with their spans."""
    base = [k.name for k in KINDS if k.base]
    ranks = F.transform("spans", lambda s: s["rank"])
    counts = [(F.size(ranks) - F.size(F.array_remove(ranks, i))).cast("bigint").alias(f"n_{n}")
              for i, n in enumerate(base)]
    kept = F.filter("spans", lambda s: s["rank"] < len(base))
    return found.select("doc_id", *counts, F.sha2(_listing(kept).cast("binary"), 256)
                        .alias("base_sha256"), _listing(F.col("spans")).alias("spans"))


def _sql_kind(rank: int, name: str, pattern: str, good: str) -> str:
    return f"""
{name}_m AS (SELECT row_id, regexp_extract_all(t, '{pattern}') AS hits,
    regexp_split_to_array(t, '{pattern}') AS gaps FROM d),
{name} AS (SELECT row_id, {rank} AS rank, '{name}' AS kind, hit, gap,
    gap_end + hits_before AS s, gap_end + hits_before + length(hit) AS e FROM (
  SELECT row_id, hit, gap, sum(length(gap)) OVER w AS gap_end,
    coalesce(sum(length(hit)) OVER (PARTITION BY row_id ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hits_before
  FROM (SELECT row_id, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap,
          unnest(range(len(hits))) AS i FROM {name}_m WHERE len(hits) > 0)
  WINDOW w AS (PARTITION BY row_id ORDER BY i)) WHERE {good})"""


_NEAR = "regexp_matches(lower(right(gap, %d)), '%s')"
_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
# Checksum over the digits from the right: every second one doubled, nines cast out.
_LUHN = f"""length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1),
 lambda i: CASE WHEN i % 2 = 1 THEN ({_DIGITS})[-i]::INT
           WHEN ({_DIGITS})[-i]::INT > 4 THEN ({_DIGITS})[-i]::INT * 2 - 9
           ELSE ({_DIGITS})[-i]::INT * 2 END)) % 10 = 0"""
_MOD97 = """list_reduce(list_prepend(0, list_transform(string_split(array_to_string(list_transform(
 string_split(hit[5:] || hit[1:4], ''), lambda c: CASE WHEN ascii(c) >= 65 THEN (ascii(c) - 55)::VARCHAR
 ELSE c END), ''), ''), lambda c: c::INT)), lambda a, x: (a * 10 + x) % 97) = 1"""
_IP = "NOT list_contains(list_transform(string_split(hit, '.'), lambda p: p::DOUBLE > 255), true)"
_WORD_END = "AND NOT regexp_matches(gap, '[A-Za-z0-9]$')"

SQL = "WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents)," + ",".join((
    _sql_kind(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    _sql_kind(1, "ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", _IP),
    _sql_kind(2, "card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
    _sql_kind(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
    _sql_kind(4, "iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", _MOD97),
    _sql_kind(5, "secret", r"\b[0-9A-Fa-f]{32,64}\b", _NEAR % (NEARBY, KINDS[5].context)),
)) + """,
spans AS (SELECT row_id, rank, kind, s, e FROM email UNION ALL SELECT row_id, rank, kind, s, e FROM ip
  UNION ALL SELECT row_id, rank, kind, s, e FROM card UNION ALL SELECT row_id, rank, kind, s, e FROM phone
  UNION ALL SELECT row_id, rank, kind, s, e FROM iban UNION ALL SELECT row_id, rank, kind, s, e FROM secret),
per AS (SELECT row_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
  count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) FILTER (rank < 4) AS base,
  string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY row_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (row_id)"""
