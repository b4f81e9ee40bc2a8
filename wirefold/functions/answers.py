"""Rows out of answers that should be JSON and often are not quite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirefold.functions.text import blank_to_null, col, let, strip

ROWS = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
OBJECT = T.MapType(T.StringType(), T.StringType())
NONE = "array<map<string,string>>"


def _valid(text: Column) -> Column:
    """The text when it is exactly one JSON value. The parser stops after the first value
    it meets, so the text is tried inside an array and inside an object."""
    return let(text, lambda t: F.when(
        F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))).isNotNull()
        & F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}"))).isNotNull(), t))


def json_part(c: Column | str) -> Column:
    """The JSON inside an answer: fenced, bare, or between the outermost brackets. Null if none."""
    def unfenced(text: Column) -> Column:
        inside = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.+?)\s*```", 1)
        return F.coalesce(blank_to_null(inside), text)

    def parsed(text: Column) -> Column:
        return F.coalesce(_valid(text), *[_valid(F.regexp_extract(text, p, 0))
                                          for p in (r"(?s)\[.*\]", r"(?s)\{.*\}")])

    return let(let(strip(col(c)), unfenced), parsed)


def _objects(text: Column) -> Column:
    """Rows of a JSON array; entries that are not objects are left out."""
    items = F.from_json(F.when(text.rlike(r"^\s*\["), text), "array<string>")
    return F.filter(F.transform(F.filter(items, lambda i: i.rlike(r"^\s*\{")),
                                lambda i: F.from_json(i, OBJECT)), lambda r: r.isNotNull())


def _wrapped(text: Column) -> Column:
    """Rows of an object: its first list of objects, itself if it is a row, or JSON in a string."""
    def rows(fields: Column) -> Column:
        values = F.map_values(fields)
        lists = F.filter(F.transform(values, _objects), lambda r: F.size(r) > 0)
        itself = F.when(F.map_contains_key(fields, "headline") | F.map_contains_key(fields, "url"),
                        F.array(fields))
        inner = F.filter(F.transform(values, lambda v: _objects(json_part(v))),
                         lambda r: F.size(r) > 0)
        return F.coalesce(F.get(lists, F.lit(0)), itself, F.get(inner, F.lit(0)))

    return let(F.from_json(F.when(text.rlike(r"^\s*\{"), text), OBJECT), rows)


def _salvaged(text: Column) -> Column:
    """Whole flat objects of a truncated answer, parsed one at a time."""
    flat = F.regexp_extract_all(text, F.lit(r"""(?s)(\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\})"""), F.lit(1))
    rows = F.filter(F.transform(flat, lambda o: F.from_json(_valid(o), OBJECT)),
                    lambda r: r.isNotNull())
    return F.filter(rows, lambda r: F.map_contains_key(r, "headline") | F.map_contains_key(r, "url"))


def _some(rows: Column) -> Column:
    return let(rows, lambda r: F.when(F.size(r) > 0, r))


def answer_rows(c: Column | str) -> Column:
    """array<map<string,string>> of an answer's rows; empty when nothing can be read."""
    def rows_of(text: Column) -> Column:
        return let(json_part(text), lambda part: F.coalesce(
            _some(_objects(part)), _some(_wrapped(part))))

    def tried(text: Column) -> Column:
        cleaned = F.regexp_replace(text, r"(?is)<reasoning>.*?(?:</reasoning>|$)", "")
        return F.coalesce(rows_of(cleaned), rows_of(text), _some(_salvaged(text)),
                          F.array().cast(NONE))

    return let(F.coalesce(col(c), F.lit("")), tried)


def unwrap(c: Column | str) -> Column:
    """The answer inside a {"content": ...} envelope, which may itself be JSON in a string."""
    text = col(c)
    fields = F.from_json(F.when(text.rlike(r"^\s*\{"), text), OBJECT)
    alone = (F.size(fields) == 1) & F.map_contains_key(fields, "content")
    return let(F.when(alone, fields["content"]).otherwise(text),
               lambda inner: F.coalesce(json_part(inner), strip(inner)))
