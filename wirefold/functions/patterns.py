"""What a text must hold to match a regular expression, read from the expression itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BREAK = "\x01"           # where a run of letters ends
# Flags, look-around, quoted and coded characters, back references and classes in classes: not read.
UNREAD = r"\(\?[^:]|\\[QEpPxucNkR0-9]|\[[^\]]*\["
MAYBE = r"(?:[?*]|\{[^}]*\})[+?]?"       # what makes the item before it optional
LEVELS = 4               # of nested groups that are opened; deeper ones are not read


def _open_groups(x: Column) -> Column:
    """Optional groups are dropped, groups without alternatives lose their brackets."""
    for _ in range(LEVELS):
        x = F.regexp_replace(x, rf"\((?:\?:)?[^()]*\){MAYBE}", BREAK)
        x = F.regexp_replace(x, r"\((?:\?:)?([^()|]*)\)", "$1")
    return x


def _runs(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda r: r != "")


def _longest(x: Column) -> Column:
    return F.array_max(F.transform(_runs(x), lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"]


def _one_of(branches: Column) -> Column:
    """The longest run of each branch; nothing when a branch has none."""
    found = F.transform(branches, _longest)
    return F.when(~F.exists(found, lambda r: r.isNull()), found)


def needed_runs(pattern: Column) -> Column:
    """Sets of lower-case runs of a-z and 0-9: a text that matches ``pattern``, in any case of ASCII
    letters, has one run at least of every set in it.

    Anchors, borders, classes, optional and repeated items end a run. A group of alternatives gives the
    set of what its branches need, and so does a pattern of alternatives as a whole. No set means that
    nothing is known of the texts; that is also the answer for what is not read (see UNREAD).
    """
    x = F.regexp_replace(pattern, r"\\.", BREAK)
    nested_class = x.rlike(r"\[[^\]]*\[")
    x = F.regexp_replace(x, r"\[\^?\]?[^\]]*\]", BREAK)
    x = F.regexp_replace(x, rf"[^()|]{MAYBE}", BREAK)
    x = _open_groups(x)
    deep = r"\([^()]*\("
    x = F.when(x.rlike(deep), _open_groups(F.regexp_replace(x, r"\([^()]*\)(?![?*{])", BREAK))).otherwise(x)
    unread = pattern.rlike(UNREAD) | nested_class | x.rlike(deep)
    groups = F.regexp_extract_all(x, F.lit(r"\((?:\?:)?([^()]*)\)"), F.lit(1))
    outside = F.regexp_replace(x, r"\([^()]*\)", BREAK)
    choices = F.filter(F.transform(groups, lambda g: _one_of(F.split(g, r"\|", -1))), lambda s: s.isNotNull())
    parts = F.concat(F.transform(_runs(outside), lambda r: F.array(r)), choices)
    whole = _one_of(F.split(outside, r"\|", -1))
    sets = F.when(outside.contains("|"), F.when(whole.isNotNull(), F.array(whole))).otherwise(parts)
    return F.coalesce(F.when(~unread, sets), F.array().cast("array<array<string>>"))
