"""Reading HTML and XML without a tree, one row per page: pieces by patterns, elements by a walk over
the tags; see README for the limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirefold.functions.text import blank_to_null, col, let, squeeze, unescape, word_cut
from wirefold.functions.times import read_time
from wirefold.functions.urls import join_url, web_url

# --- fixed values: metadata tags in the order they are tried -------------------------
DESCRIPTION_METAS = (("property", "og:description"), ("name", "og:description"),
                     ("name", "twitter:description"), ("property", "twitter:description"),
                     ("name", "description"))
DATE_METAS = (("property", "article:published_time"), ("name", "article:published_time"),
              ("property", "og:article:published_time"), ("name", "publish-date"),
              ("name", "pubdate"), ("itemprop", "datePublished"))
TITLE_METAS = (("property", "og:title"), ("name", "twitter:title"))
MENU_TAGS = ("script", "style", "noscript", "svg", "nav", "footer")
TEXT_DROP_TAGS = MENU_TAGS + ("iframe", "form")
CLEAN_DROP_TAGS = ("script", "style", "noscript", "svg", "iframe", "canvas", "template",
                   "object")
CLEAN_DROP_VOID = ("link", "meta", "embed")
KEPT_ATTRIBUTES = ("href", "src", "alt", "title", "datetime")
MAX_CLEAN_CHARS = 120_000
# ------------------------------------------------------------------------------------

COMMENT = r"(?s)<!--.*?-->"
ANCHOR = r"(?is)<a\b[^>]*>.*?</a\s*>"


# Elements that have no content, so no end.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
             "source", "track", "wbr")
# A comment, an element whose content is no markup, a tag, a text. What is not ended runs to the end.
PIECES = (r"(?is)(<!--.*?(?:-->|\z)|<(?:script\b[^>]*>.*?(?:</script\s*>|\z)|style\b[^>]*>.*?(?:</style\s*>|\z))"
          r"|<[A-Za-z/!?][^>]*>|[^<]+|<)")


def drop_tags(html: Column | str, tags) -> Column:
    """Elements removed with everything in them, comments too.

    The tags of a page are walked once with the stack of open elements. An end tag closes the last
    element of its name and all that is open inside, so a nested element does not end its outer one,
    and an element that is never closed goes on to the end of its parent. End tags of nothing open
    do nothing.
    """
    wanted = F.array(*[F.lit(t) for t in tags])
    no_gap = F.array().cast("array<struct<first: int, last: int>>")

    def walked(pieces: Column) -> Column:
        def seen(p: Column, i: Column) -> Column:
            name = F.lower(F.regexp_extract(p, r"^<(/?[A-Za-z][A-Za-z0-9:-]*)", 1))
            whole = p.rlike(r"(?is)/>$|^<(?:script|style)\b")
            return F.struct(i.alias("at"), F.when(p.startswith("<!--"), F.lit("!")).otherwise(name).alias("name"),
                            (whole | name.isin(*VOID_TAGS)).alias("whole"))

        def step(acc: Column, t: Column) -> Column:
            stack, root, start, gaps = acc["stack"], acc["root"], acc["start"], acc["gaps"]
            depth, name = F.size(stack), t["name"]
            found = F.array_position(F.reverse(stack), F.substring(name, 2, 100)).cast("int")
            place = F.when(found > 0, depth - found + 1).otherwise(0)     # the element it ends
            drop = (root == 0) & F.array_contains(wanted, name)

            def now(stack: Column, root: Column, start: Column, gaps: Column) -> Column:
                return F.struct(stack.alias("stack"), root.cast("int").alias("root"),
                                start.cast("int").alias("start"), gaps.alias("gaps"))

            def gap(first: Column, last: Column) -> Column:
                return F.concat(gaps, F.array(F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))))
            return (F.when((name == "!") | t["whole"], F.when((root == 0) & ((name == "!") | drop), now(
                        stack, root, start, gap(t["at"], t["at"]))).otherwise(acc))
                    .when(~name.startswith("/"), now(
                        F.concat(stack, F.array(name)), F.when(drop, depth + 1).otherwise(root),
                        F.when(drop, t["at"]).otherwise(start), gaps))
                    .when(place == 0, acc)
                    .otherwise(now(
                        F.slice(stack, F.lit(1), place - 1), F.when(place <= root, 0).otherwise(root), start,
                        F.when((root > 0) & (place <= root), gap(start, F.when(
                            place == root, t["at"]).otherwise(t["at"] - 1))).otherwise(gaps))))
        tagged = F.filter(F.transform(pieces, seen), lambda t: t["name"] != "")
        begin = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(0).alias("root"),
                         F.lit(0).alias("start"), no_gap.alias("gaps"))
        last = F.size(pieces) - 1
        return F.aggregate(tagged, begin, step, lambda acc: F.when(acc["root"] > 0, F.concat(
            acc["gaps"], F.array(F.struct(acc["start"].alias("first"), last.alias("last"))))).otherwise(acc["gaps"]))

    def kept(pieces: Column) -> Column:
        gone = F.flatten(F.transform(walked(pieces), lambda g: F.sequence(g["first"], g["last"])))
        return let(gone, lambda g: F.array_join(F.transform(F.array_except(
            F.sequence(F.lit(0), F.size(pieces) - 1), g), lambda i: F.get(pieces, i)), ""))
    body = col(html)
    touched = body.rlike(rf"(?i)<(?:!--|(?:{'|'.join(tags)})\b)")
    return F.when(touched, let(F.regexp_extract_all(body, F.lit(PIECES), F.lit(1)), kept)).otherwise(body)


def strip_tags(html: Column | str) -> Column:
    return squeeze(unescape(F.regexp_replace(col(html), r"<[^>]*>", " ")))


def attribute(tag: Column | str, name: str) -> Column:
    """An attribute's decoded value; empty when absent."""
    found = F.regexp_extract(
        col(tag), rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return unescape(F.regexp_replace(found, r"""^["']|["']$""", ""))


def _meta(tags: Column, pairs) -> Column:
    """The first non-empty content among the metas, each looked up by its first tag."""
    def one(attr: str, value: str) -> Column:
        quoted = value.replace(".", r"\.")
        wanted = F.filter(tags, lambda t: t.rlike(
            rf"""(?i)\s{attr}\s*=\s*(?:"{quoted}"|'{quoted}'|{quoted}(?=[\s/>]))"""))
        return let(squeeze(attribute(F.get(wanted, F.lit(0)), "content")), blank_to_null)
    return F.coalesce(*[one(a, v) for a, v in pairs])


def _metas(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))


def page_meta(html: Column | str) -> Column:
    """struct(description, published_at) from a page's head, or its first <time>."""
    def stamps(body: Column) -> Column:
        tag = F.regexp_extract(body, r"(?is)<time\b[^>]*\sdatetime\s*=[^>]*>", 0)
        return F.struct(_metas(body).alias("tags"), attribute(tag, "datetime").alias("time"))

    def read(found: Column) -> Column:
        written = F.array(_meta(found["tags"], DATE_METAS), blank_to_null(found["time"]))
        times = F.filter(F.transform(written, lambda w: read_time(w, "UTC")["ts"]),
                         lambda ts: ts.isNotNull())
        return F.struct(
            let(_meta(found["tags"], DESCRIPTION_METAS), lambda d: word_cut(d, 600))
            .alias("description"), F.get(times, F.lit(0)).alias("published_at"))

    return let(let(F.regexp_replace(col(html), COMMENT, ""), stamps), read)


def page_title(html: Column | str) -> Column:
    def read(body: Column) -> Column:
        own = F.regexp_extract(body, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
        has_own = body.rlike(r"(?i)<title\b")
        named = let(_metas(body), lambda tags: _meta(tags, TITLE_METAS))
        return F.substring(F.coalesce(named, F.when(has_own, squeeze(unescape(own)))), 1, 300)

    return let(F.regexp_replace(col(html), COMMENT, ""), read)


def declared_feed(html: Column | str, base: Column | str) -> Column:
    """The feed a page declares; one below the page's own path wins over the first."""
    links = F.regexp_extract_all(col(html), F.lit(r"(?is)(<link\b[^>]*>)"), F.lit(1))
    feeds = F.filter(links, lambda t: (
        attribute(t, "rel").rlike(r"(?i)(^|\s)alternate(\s|$)")
        & F.lower(attribute(t, "type")).isin("application/rss+xml", "application/atom+xml")
        & ~F.lower(attribute(t, "title")).contains("comment")))
    own = F.concat(F.lower(F.regexp_replace(F.regexp_replace(col(base), r"\?.*$", ""), "/+$", "")),
                   F.lit("/"))
    return let(F.filter(F.transform(feeds, lambda t: web_url(attribute(t, "href"), base)),
                        lambda u: u.isNotNull()),
               lambda urls: F.coalesce(
                   F.get(F.filter(urls, lambda u: F.lower(u).startswith(own)), F.lit(0)),
                   F.get(urls, F.lit(0))))


def anchors(html: Column | str) -> Column:
    """array<struct(text, href)> of a page's links, in page order."""
    found = F.regexp_extract_all(col(html), F.lit(f"({ANCHOR})"), F.lit(1))
    found = F.filter(found, lambda a: a.rlike(r"(?is)^<a\b[^>]*\shref\s*="))
    return F.transform(found, lambda a: F.struct(
        strip_tags(a).alias("text"),
        attribute(F.regexp_extract(a, r"(?is)^<a\b[^>]*>", 0), "href").alias("href")))


def page_text(html: Column | str, base: Column | str) -> Column:
    """A page as lines, every link kept as [text](url)."""
    body = drop_tags(html, TEXT_DROP_TAGS)
    pieces = F.regexp_extract_all(body, F.lit(rf"({ANCHOR}|<[^>]*>|[^<]+|<)"), F.lit(1))

    def linked(a: Column) -> Column:
        return F.when((a["label"] != "") & a["link"].isNotNull(), F.concat(
            F.lit("["), a["label"], F.lit("]("), a["link"], F.lit(")"))).otherwise(a["label"])

    def shown(p: Column) -> Column:
        link = web_url(attribute(F.regexp_extract(p, r"(?is)^<a\b[^>]*>", 0), "href"), base)
        parts = F.struct(strip_tags(p).alias("label"), link.alias("link"))
        return (F.when(p.rlike(r"(?is)^<a\b[^>]*\shref\s*=.*</a\s*>$"),
                       F.concat(F.lit("\n"), let(parts, linked), F.lit("\n")))
                .when(p.rlike(r"(?s)^<.*>$"), F.lit("\n"))
                .otherwise(unescape(p)))

    lines = F.split(F.array_join(F.transform(pieces, shown), ""), r"[\n\r]+")
    kept = F.filter(F.transform(lines, squeeze), lambda line: line != "")
    return F.array_join(kept, "\n")


def clean_page(html: Column | str, base: Column | str,
               limit: int = MAX_CLEAN_CHARS) -> Column:
    """struct(html, text_chars, truncated): text-bearing markup, links made absolute."""
    title = blank_to_null(strip_tags(F.regexp_extract(
        col(html), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)))
    body = drop_tags(html, CLEAN_DROP_TAGS)
    body = F.regexp_replace(body, rf"(?i)</?({'|'.join(CLEAN_DROP_VOID)})\b[^>]*>", "")
    body = let(body, lambda b: F.coalesce(
        blank_to_null(F.regexp_extract(b, r"(?is)<body\b[^>]*>(?:.*</body\s*>|.*)", 0)), b))
    pieces = F.regexp_extract_all(body, F.lit(r"(<[A-Za-z][^>]*>|<[^>]*>|[^<]+|<)"), F.lit(1))

    def tidy(p: Column) -> Column:
        parts = [F.regexp_extract(p, r"^<([A-Za-z][A-Za-z0-9:-]*)", 0)]
        for name in KEPT_ATTRIBUTES:
            value = attribute(p, name)
            if name in ("href", "src"):
                value = join_url(base, value)
            parts.append(F.when(p.rlike(rf"(?is)\s{name}\s*="), F.concat(
                F.lit(f' {name}="'), F.replace(value, F.lit('"'), F.lit("&quot;")), F.lit('"'))
            ).otherwise(""))
        end = F.when(p.rlike(r"/>$"), F.lit("/>")).otherwise(">")
        return F.when(p.rlike(r"^<[A-Za-z]"), F.concat(*parts, end)).otherwise(p)

    full = F.concat(let(title, lambda t: F.when(t.isNull(), "").otherwise(
        F.concat(F.lit("<h1>"), t, F.lit("</h1>\n")))),
        F.array_join(F.transform(pieces, tidy), ""))
    cut = let(full, lambda f: F.struct(F.substring(f, 1, limit).alias("html"),
                                       (F.length(f) > limit).alias("truncated")))
    return let(cut, lambda c: F.struct(
        c["html"].alias("html"), F.length(strip_tags(c["html"])).alias("text_chars"),
        c["truncated"].alias("truncated")))


def xml_field(block: Column | str, *names: str) -> Column:
    """Decoded text of the first of the elements that is there and not empty; see ``plain_cdata``."""
    return F.coalesce(*[let(F.trim(unescape(F.regexp_extract(
        col(block), rf"(?is)<{n}\b[^>]*(?<!/)>(.*?)</{n}\s*>", 1))), blank_to_null)
        for n in names])


def plain_cdata(body: Column | str) -> Column:
    """CDATA sections as escaped text, so that what looks like markup in them is none."""
    def inside(part: Column) -> Column:
        end = F.instr(part, "]]>")
        text = F.when(end > 0, F.substring(part, F.lit(1), end - 1)).otherwise(part)
        rest = F.when(end > 0, F.substring(part, end + 3, F.length(part))).otherwise("")
        for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(char), F.lit(name))
        return F.concat(text, rest)
    parts = F.split(col(body), r"<!\[CDATA\[", -1)
    return let(parts, lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(
        F.slice(p, F.lit(2), F.size(p)), inside), "")))
