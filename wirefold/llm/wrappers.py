"""Main text of web pages by inferring a wrapper per host.

A page is read as a well-nested stream of tags and texts. The pages of one host are aligned one after the
other: equal tags match, a mismatch of texts becomes a text slot, a stretch that only one side has becomes
an optional group, and neighbours that repeat become a repeated group. The result is a union-free regular
expression, the host's wrapper. Aligning two wrappers gives a wrapper again, so every task folds the
pages it reads, per host, and only those partial wrappers are shuffled and folded, in two
steps so that a host with a third of all pages is never gathered in one place. A wrapper is as large as
the host's markup is varied, not as the host is large. A level of very many different siblings is aligned
like any other; only where a wrapper is shown it becomes one item that stands for anything.

The wrapper says where a host keeps its content. Every text item of it knows how many characters
the pages had there, and whether these are the same on all pages or a slot. From the root on, the
element is followed that holds at least MOST of the characters in slots, until an article or main
element is reached, or a level that has paragraphs or headings of its own. The keys on the way are
the host's region. A page is matched against it: what lies in the region is content, whatever the
class names on the way to it are, and what varies outside of it (teasers, menus, adverts) is template,
whatever its class names are.

Next to that, every text is counted with its path: the distinct pages of the host that carry it. A
text is shared if at least ALIKE and NEARLY of the distinct pages carry it, however they are aligned;
shared texts are template everywhere.

Lists of tags and class words decide what the wrapper cannot: which small parts inside the region are
navigation, sidebar, notice, advert, form or reader comments, although they vary from page to page; and
all of it on pages that do not have the region, and for hosts with less than ALIKE pages or no slots. There
an article (or main element) is the content if the page has one; else all that is no template.

Defined results: null and empty pages give an empty text; a null url belongs to the empty host; tags left open
close where their parent closes, a comment or script left open runs to the page's end; a break is
white space; pages with the same texts are extracted each, but count once for what is shared; a text that
a page repeats at one path counts once.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.llm.shared import Scratch, ascii_lower, fresh

SALT = 64                    # partial folds per host before the last one
ALIKE = 3                    # distinct pages that must share a text before it is template
NEARLY = 0.9                 # share of the host's distinct pages that must
MOST = 0.9                   # share of a level's characters in slots that the region must hold
PERIOD = 4                   # longest run of siblings tried as one repeated group
DEEPEST = 64                 # levels a wrapper tells apart; deeper markup counts for the level above
WIDEST = 400                 # siblings that are shown of a level; a wider one is shown as ANY
ANY = "~"

# Elements by their role in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q "
                   "rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mn mo "
                   "ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select button object "
                "canvas audio video".split())
TEMPLATE_TAGS = frozenset("nav footer aside form menu dialog head".split())
TEMPLATE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement sponsored sponsor promo banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs header footer masthead cookie cookies consent notice notices alert "
    "popup modal newsletter subscribe subscription signup share sharing social related recommended widget "
    "login toolbar pagination pager skip complementary contentinfo search dialog".split())
COMMENT_WORDS = frozenset("comment comments commentlist replies reply respond disqus".split())
NO_PART = frozenset("has with without no".split())           # what a class so begun names is not here
NO_NAME = frozenset("fixed results".split())                 # a class that ends so names something else
CONTAINERS = frozenset("html body div section article main table tbody tr td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]),
          "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
          "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
KEEPS_PARAGRAPH = frozenset(["br", "hr"])

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|"
                    r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|"
                    r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_TAIL = re.compile(r"<[!?/a-zA-Z].*", re.S)                 # a tag that never ends
_ENDED = re.compile(r"--!?>\Z")
_NAME = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+")


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def _key(name: str, attributes: str) -> tuple[str, frozenset[str]]:
    """An element's key in the stream, and the words of its class, id and role that may name its role."""
    if not attributes or ("=" not in attributes):
        return name, frozenset()
    values = " ".join("".join(m) for m in _NAME.findall(attributes)).lower()
    if not values:
        return name, frozenset()
    parts = [_WORD.findall(v) for v in values.split()]
    naming = frozenset(w for p in parts if p and p[0] not in NO_PART and p[-1] not in NO_NAME for w in p)
    return f"{name}.{'.'.join(sorted({w for p in parts for w in p})[:6])}", naming


class Place:
    """An open element: its key, and what it means for the text below. ``at`` counts the keys of the
    host's region that lead here: all of them inside the region, -1 beside the way to it."""

    __slots__ = ("name", "key", "template", "main", "header", "heading", "at")

    def __init__(self, name: str, key: str, words: frozenset[str], above: Place | None,
                 region: tuple[str, ...] = ()) -> None:
        self.name, self.key = name, key
        self.at = above.at if above is not None else 0
        leads = 0 <= self.at < len(region)
        if leads:
            self.at = self.at + 1 if key == region[self.at] else -1
        leads = leads and self.at > 0
        article = name in ("article", "main") or "main" in words and name in ("div", "section")
        inside = above is not None and above.main
        listed = words & TEMPLATE_WORDS
        titled = inside and listed == {"header"}
        marked = not leads and (bool(words & COMMENT_WORDS) or (
            bool(listed) and not titled and not article and name not in ("html", "body")))
        self.template = (above is not None and above.template) or name in TEMPLATE_TAGS or marked or (
            name == "header" and not inside)
        found = self.at == len(region) if region else article
        self.main = (inside or found) and not self.template
        self.header = (above is not None and above.header) or (name == "header" and inside) or titled
        self.heading = (above is not None and above.heading) or name in HEADINGS


def events(page: str, region: tuple[str, ...] = ()) -> Iterator[tuple[str, object]]:
    """("open", place), ("close", place) and ("text", raw) of a page, well nested; elements that only
    shape running text leave no trace, a break gives a space."""
    stack: list[Place] = []
    opened: Counter[str] = Counter()
    at, end = 0, len(page)
    last = page.rfind(">") + 1            # no tag ends after this
    low = None
    while at < end:
        found = _TOKEN.search(page, at, last) if at < last else None
        if not found:
            yield "text", page[at:last] + _TAIL.sub("", page[max(at, last):])
            break
        if found.start() > at:
            yield "text", page[at:found.start()]
        at = found.end()
        slash, name, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not name:
            if found[0].startswith("<!--") and not _ENDED.search(found[0]):
                break                                      # a comment that never ends
            continue
        name = name.lower()
        if name == "br":
            yield "text", " "
            continue
        if slash:
            if name in INLINE or name in VOID or not opened[name]:
                continue
            while True:
                top = stack.pop()
                opened[top.name] -= 1
                yield "close", top
                if top.name == name:
                    break
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                low = page.lower() if low is None else low
                if len(low) != end:                        # lower-casing changed lengths
                    low = "".join(c.lower() if c < "\x80" else c for c in page)
                stop = low.find(f"</{name}", at)
                close = page.find(">", stop) if stop >= 0 else -1
                at = close + 1 if close >= 0 else end
            continue
        if name in INLINE:
            continue
        shut = CLOSES.get(name) or (frozenset() if name in KEEPS_PARAGRAPH else CLOSES["p"])
        while stack and stack[-1].name in shut:
            opened[stack[-1].name] -= 1
            yield "close", stack.pop()
        key, words = _key(name, attributes)
        place = Place(name, key, words, stack[-1] if stack else None, region)
        yield "open", place
        if name in VOID or attributes.endswith("/"):
            yield "close", place
        else:
            stack.append(place)
            opened[name] += 1
    while stack:
        yield "close", stack.pop()


def tidy(raw: str) -> str:
    """Character references decoded, white space single, ends trimmed."""
    return " ".join(html.unescape(raw).split())


# A wrapper's item is [key, quantifier, text, items, chars]: the key of an element, "#" for a text, or the
# keys of a group in brackets; the quantifier is "", "?", "+" or "*"; text is a text's checksum
# while all pages agree on it, else null; chars are all the characters that pages had at a text.

def _both(a: str, b: str) -> str:
    optional, repeated = a in ("?", "*") or b in ("?", "*"), a in ("+", "*") or b in ("+", "*")
    return ("*" if optional else "+") if repeated else ("?" if optional else "")


def _merge(a: list, b: list) -> list:
    return [a[0], _both(a[1], b[1]), a[2] if a[2] == b[2] else None, aligned(a[3], b[3]), a[4] + b[4]]


def _repeated(item: list) -> list:
    return [item[0], _both(item[1], "+"), *item[2:]]


def fold(items: list) -> list:
    """Neighbours that repeat, alone or in runs of a few, as one repeated item."""
    for period in range(1, PERIOD + 1):
        out: list = []
        for item in items:
            out.append(item)
            while len(out) >= 2 * period and [x[0] for x in out[-period:]] == [
                    x[0] for x in out[-2 * period:-period]]:
                later, out = out[-period:], out[:-period]
                run = [_merge(x, y) for x, y in zip(out[-period:], later)]
                if period == 1:
                    out[-1:] = [_repeated(run[0])]
                else:
                    out[-period:] = [["(" + " ".join(x[0] for x in run) + ")", "+", None, run, 0]]
            if period > 1 and len(out) > period and out[-period - 1][0] == "(" + " ".join(
                    x[0] for x in out[-period:]) + ")":
                group = out[-period - 1]
                group[3] = [_merge(x, y) for x, y in zip(group[3], out[-period:])]
                del out[-period:]
        items = out
    return items


def _commons(a: list, b: list) -> Iterator[int]:
    """For the last 0, 1, .. items of ``a``, as bits: at which items of ``b``, from its end, the longest common run of
    keys grows. One addition for each item of ``a``, however long ``b`` is."""
    full, at = (1 << len(b)) - 1, {}
    for place, item in enumerate(reversed(b)):
        at[item[0]] = at.get(item[0], 0) | 1 << place
    stay = full
    yield 0
    for item in reversed(a):
        same = at.get(item[0])
        if same:
            met = stay & same
            stay = ((stay + met) | (stay - met)) & full
        yield stay ^ full


def align(a: list, b: list) -> list:
    """``aligned`` as it is shown."""
    return shown(aligned(a, b))


def shown(items: list) -> list:
    """A wrapper to be read: levels of more than WIDEST siblings stand for anything."""
    if len(items) > WIDEST:
        return [[ANY, "*", None, [], 0]]
    return [[*item[:3], shown(item[3]), item[4]] for item in items]


def aligned(a: list, b: list) -> list:
    """One sequence that covers both: a longest common run of keys matches, the rest turns optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [_merge(x, y) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    rows = list(_commons(a, b))
    out, i, j = [], 0, 0
    # Length of the longest common run of a[i:] and b[j:], and of a[i + 1:] and b[j:].
    here, below = rows[n].bit_count(), rows[n - 1].bit_count() if n else 0

    def optional(item: list) -> list:
        return [item[0], _both(item[1], "?"), *item[2:]]

    def down() -> tuple[int, int]:
        return below, (rows[n - i - 1] & ((1 << (m - j)) - 1)).bit_count() if i < n else 0
    while i < n and j < m:
        last = m - j - 1
        grown, grown_below = rows[n - i] >> last & 1, rows[n - i - 1] >> last & 1
        if a[i][0] == b[j][0]:
            out.append(_merge(a[i], b[j]))
            here, below = here - grown, below - grown_below
            i, j = i + 1, j + 1
            here, below = down()
        elif below >= here - grown:
            out.append(optional(a[i]))
            i += 1
            here, below = down()
        else:
            out.append(optional(b[j]))
            j += 1
            here, below = here - grown, below - grown_below
    out += [optional(x) for x in a[i:]] + [optional(x) for x in b[j:]]
    return fold(out)


def items_of(page: str) -> list:
    """A page as a folded sequence of items."""
    levels: list[list] = [[]]
    depth = 0
    for kind, what in events(page):
        if kind == "open":
            depth += 1
            if depth <= DEEPEST:
                levels.append([])
        elif kind == "close":
            depth -= 1
            if depth >= DEEPEST:
                continue
            inside = fold(levels.pop())
            levels[-1].append([what.key, "", None, inside, 0])
        elif text := tidy(what):
            if levels[-1] and levels[-1][-1][0] == "#":
                levels[-1][-1][2] = zlib.crc32(text.encode("utf-8", "replace"), levels[-1][-1][2] or 0)
                levels[-1][-1][4] += len(text)
            else:
                levels[-1].append(["#", "", zlib.crc32(text.encode("utf-8", "replace")), [], len(text)])
    return fold(levels[0])


def pattern(items: list) -> str:
    """The wrapper as a readable regular expression; fixed texts as =checksum, slots as #."""
    out = []
    for key, quantifier, text, below, _ in items:
        if key == ANY:
            core = ANY
        elif key == "#":
            core = "#" if text is None else f"={text:08x}"
        elif key.startswith("("):
            core = f"({pattern(below)})"
        else:
            core = f"<{key}>{pattern(below)}</{key.partition('.')[0]}>"
        out.append(f"({core}){quantifier}" if quantifier and key not in ("#", ANY) and not key.startswith("(")
                   else core + quantifier)
    return "".join(out)


def _flat(items: list) -> Iterator[list]:
    """The items of a level, those of groups too."""
    for item in items:
        if item[0].startswith("("):
            yield from _flat(item[3])
        else:
            yield item


def _in_slots(items: list) -> int:
    """Characters that vary between pages, without what is no content anywhere."""
    total = 0
    for item in _flat(items):
        name, _, words = item[0].partition(".")
        if name == "#":
            total += item[4] if item[2] is None else 0
        elif name not in TEMPLATE_TAGS and not COMMENT_WORDS & set(words.split(".")):
            total += _in_slots(item[3])
    return total


def region_of(items: list) -> list[str]:
    """The keys that lead to the element where the host's pages keep their content; none if no
    element holds nearly all that varies."""
    path: list[str] = []
    while True:
        total, by_key = _in_slots(items), Counter()
        for item in _flat(items):
            by_key[item[0]] += _in_slots([item])
        key, most = max(by_key.items(), key=lambda kv: (kv[1], kv[0]), default=("", 0))
        plain = any(by_key[k] and k.partition(".")[0] not in CONTAINERS for k in by_key if not TEMPLATE_TAGS & {
            k.partition(".")[0]})
        if plain or not most or most < MOST * total or key.partition(".")[0] not in CONTAINERS:
            break
        path.append(key)
        if key.partition(".")[0] in ("article", "main"):
            break
        items = [below for item in _flat(items) if item[0] == key for below in item[3]]
    return path if path and path[-1] not in ("html", "body") else []


_PART = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("pages", pa.int64()),
                   ("items", pa.string())])


def _fold_parts(batches: Iterator[pa.RecordBatch], read) -> Iterator[pa.RecordBatch]:
    """One row per host and task: the wrapper of all rows the task has read."""
    seen: dict[str, list] = {}

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([
            pa.array(list(seen), pa.string()),
            pa.array([zlib.crc32(f"{h}{v[0]}{len(v[1])}".encode()) % SALT for h, v in seen.items()],
                     pa.int32()),
            pa.array([v[0] for v in seen.values()], pa.int64()),
            pa.array([json.dumps(v[1]) for v in seen.values()], pa.string())], schema=_PART)
        seen.clear()
        return batch
    for batch in batches:
        for host, pages, items in read(batch):
            known = seen.get(host)
            seen[host] = [pages, items] if known is None else [known[0] + pages, aligned(known[1], items)]
        if len(seen) > 10_000:
            yield rows()
    yield rows()


def _fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _fold_parts(batches, lambda b: (
        (h, 1, items_of(p)) for h, p in zip(b["host"].to_pylist(), b["html"].to_pylist())))


def _fold_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _fold_parts(batches, lambda b: (
        (h, n, json.loads(i)) for h, n, i in zip(b["host"].to_pylist(), b["pages"].to_pylist(),
                                                 b["items"].to_pylist())))


def infer(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host, pages, wrapper, region (the keys that lead to the content), fixed (texts that nearly all of
    at least ALIKE distinct pages share) of every host."""
    kind = "host string, salt int, pages bigint, items string"
    parts = (pages.where(F.length(F.col(f"`{page}`")) > 0)
             .select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{page}`").alias("html"))
             .mapInArrow(_fold_pages, kind))
    for keys in (["host", "salt"], ["host"]):
        parts = parts.repartition(*keys).mapInArrow(_fold_wrappers, kind)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {}
        for batch in batches:
            for host, pages, items in zip(*(batch[k].to_pylist() for k in ("host", "pages", "items"))):
                known = seen.get(host)
                items = json.loads(items)
                seen[host] = ([pages, items] if known is None
                              else [known[0] + pages, aligned(known[1], items)])
        yield pa.RecordBatch.from_arrays([
            pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()),
            pa.array([pattern(shown(v[1])) for v in seen.values()], pa.string()),
            pa.array([region_of(v[1]) if v[0] >= ALIKE else [] for v in seen.values()], pa.list_(pa.string()))],
            ["host", "pages", "wrapper", "region"])
    return (parts.mapInArrow(finish, "host string, pages bigint, wrapper string, region array<string>")
            .join(shared_texts(pages, url, page), "host", "left")
            .withColumn("fixed", F.coalesce("fixed", F.array().cast("array<bigint>"))))


def _mark(path: list[Place], text: str) -> int:
    marked = f"{''.join('/' + p.key for p in path)}#{text}".encode("utf-8", "replace")
    return int.from_bytes(hashlib.blake2b(marked, digest_size=8).digest(), "little", signed=True)


def blocks(page: str, region: tuple[str, ...] = ()) -> Iterator[tuple[int, str, bool]]:
    """Mark, text and whether it is content (in the region, or else in an article), of every text block
    outside the listed template."""
    path: list[Place] = []
    held: list[str] = []

    def block() -> Iterator[tuple[int, str, bool]]:
        text = tidy("".join(held))
        held.clear()
        place = path[-1] if path else None
        if text and not (place is not None and (
                place.template or (place.header and not place.heading))):
            yield _mark(path, text), text, place is not None and place.main
    for kind, what in events(page, region):
        if kind == "text":
            held.append(what)
            continue
        yield from block()
        if kind == "open":
            path.append(what)
        else:
            path.pop()
    yield from block()


def _all_marks(page: str) -> set[int]:
    """The marks of all texts of a page, also below names of the lists."""
    path, held, out = [], [], set()

    def block() -> None:
        if text := tidy("".join(held)):
            out.add(_mark(path, text))
        held.clear()
    for kind, what in events(page):
        if kind == "text":
            held.append(what)
            continue
        block()
        if kind == "open":
            path.append(what)
        else:
            path.pop()
    block()
    return out


def _marks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The distinct marks of every page, in order."""
    for batch in batches:
        yield pa.array([sorted(_all_marks(p)) for p in batch.to_pylist()],
                       pa.list_(pa.int64()))


def shared_texts(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host and fixed, the marks of the texts that nearly all of at least ALIKE distinct pages carry."""
    one = (pages.where(F.length(F.col(f"`{page}`")) > 0)
           .select(host_of(F.col(f"`{url}`")).alias("host"),
                   F.arrow_udf(_marks, "array<bigint>")(F.col(f"`{page}`")).alias("marks"))
           .distinct())
    counted = Scratch(pages.sparkSession, "marks").save(
        one.select("host", F.explode(F.array_append("marks", F.lit(None).cast("bigint"))).alias("mark"))
        .groupBy("host", "mark").agg(F.count(F.lit(1)).alias("carry"))
        .where(F.col("carry") >= ALIKE), "counts", True)
    total = counted.where("mark is null").select("host", F.col("carry").alias("distinct_pages"))
    return (counted.where("mark is not null").join(total, "host")
            .where(F.col("carry") >= F.col("distinct_pages") * NEARLY)
            .groupBy("host").agg(F.sort_array(F.collect_list("mark")).alias("fixed")))


def main_text(page: str | None, fixed: frozenset[int] = frozenset(), region: tuple[str, ...] = ()) -> str:
    """The content blocks of a page, one per line; ``fixed`` are the marks of the host's shared texts,
    ``region`` the keys that lead to its content. A page with nothing there is read by the lists."""
    inside: list[str] = []
    outside: list[str] = []
    for mark, text, content in blocks(page or "", region):
        if mark not in fixed:
            (inside if content else outside).append(text)
    if region and not inside:
        return main_text(page, fixed)
    return "\n".join(inside or outside)


def extract(pages: DataFrame, wrappers: DataFrame, url: str = "url", page: str = "html",
            text: str = "text") -> DataFrame:
    """``pages`` with their main text by the wrappers of their hosts."""
    host, fixed, region = fresh(pages, "_host"), fresh(pages, "_fixed"), fresh(pages, "_region")
    read = tuple[pa.Array, pa.Array, pa.Array]

    def run(batches: Iterator[read]) -> Iterator[pa.Array]:
        for raw, shared, regions in batches:
            yield pa.array([main_text(p, frozenset(s or ()), tuple(r or ())) for p, s, r in zip(
                raw.to_pylist(), shared.to_pylist(), regions.to_pylist())], pa.string())

    run.__annotations__ = {"batches": Iterator[read], "return": Iterator[pa.Array]}
    known = wrappers.select(F.col("host").alias(host), F.col("fixed").alias(fixed), F.col("region").alias(region))
    joined = pages.withColumn(host, host_of(F.col(f"`{url}`"))).join(known, host, "left")
    return joined.withColumn(text, F.arrow_udf(run, "string")(
        F.col(f"`{page}`"), F.col(fixed), F.col(region))).drop(host, fixed, region)


def digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    wrappers = Scratch(pages.sparkSession, "wrappers").save(infer(pages), "wrappers", True)
    return extract(pages.select("page_id", "url", "html"), wrappers).select(
        "page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
