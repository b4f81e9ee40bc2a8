"""Links as columns: parts, joining, rules on what a link may be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirefold.functions.text import blank_to_null, col, let, squeeze, strip

# --- fixed values -------------------------------------------------------------
# Hosts that never carry a post: social profiles, maps, mail.
SKIP_HOSTS = ("linkedin.com", "twitter.com", "x.com", "facebook.com", "instagram.com",
              "youtube.com", "youtu.be", "goo.gl", "spotify.com", "apple.com", "wa.me", "t.me")
SOCIAL_HOST = "linkedin.com"
CALENDAR_HOSTS = ("lu.ma", "luma.com")
CALENDAR_READ_HOST = "lu.ma"
MAX_URL_CHARS = 1000
# ------------------------------------------------------------------------------

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column | str, group: int) -> Column:
    return F.regexp_extract(col(url), _PARTS, group)


def scheme(url: Column | str) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column | str) -> Column:
    return _part(url, 2)


def path(url: Column | str) -> Column:
    return _part(url, 3)


def hostname(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(netloc(url), r"^(?:.*@)?([^:@]*)", 1))


def is_web(url: Column | str) -> Column:
    return scheme(url).isin("http", "https")


def domain(url: Column | str) -> Column:
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def trimmed(url: Column | str) -> Column:
    """The form two links are compared in: lower case, no trailing slash."""
    return F.lower(F.regexp_replace(col(url), "/+$", ""))


def same_url(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.coalesce((a != "") & (b != "") & (trimmed(a) == trimmed(b)), F.lit(False))


def _settle_dots(p: Column) -> Column:
    """Resolve . and .. segments of an absolute path."""
    return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), let(p, _fold_dots)).otherwise(p)


def _fold_dots(p: Column) -> Column:
    segments = F.split(p, "/")
    last = F.element_at(segments, -1)
    folded = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(s))))
    tail = F.when(last.isin(".", ".."), F.lit("/")).otherwise("")
    return F.concat(F.array_join(folded, "/"), tail)


def join_url(base: Column | str, href: Column | str) -> Column:
    """``href`` as seen from the page ``base``."""
    both = F.struct(col(base).alias("base"), strip(col(href)).alias("href"))
    return let(both, lambda b: _joined(b["base"], b["href"]))


def _joined(base: Column, href: Column) -> Column:
    root = F.concat(_part(base, 1), F.lit("://"), netloc(base))
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    rest = F.concat(_part(href, 4), _part(href, 5))
    target = _part(href, 3)
    resolved = let(F.when(target.startswith("/"), target).otherwise(F.concat(folder, target)),
                   _settle_dots)
    return (F.when(base.isNull() | href.isNull(), None)
            .when(href == "", base)
            .when(_part(href, 1) != "", href)
            .when(href.startswith("//"), F.concat(_part(base, 1), F.lit(":"), href))
            .when(target != "", F.concat(root, resolved, rest))
            .when(href.startswith("?"), F.concat(root, path(base), rest))
            .otherwise(F.concat(F.regexp_replace(base, "#.*$", ""), rest)))


def web_url(value: Column | str, base: Column | str | None = None,
            limit: int | None = None) -> Column:
    """An absolute http(s) link, or null."""
    value = blank_to_null(strip(value))
    def checked(url: Column) -> Column:
        ok = is_web(url)
        return F.when(ok & (F.length(url) <= limit) if limit else ok, url)

    return let(value if base is None else join_url(base, value), checked)


def is_post_link(url: Column | str, page_url: Column | str,
                 pattern: Column | str | None = None) -> Column:
    """A link that can be a post: a web page, not social, not the page itself."""
    hosts = "|".join(h.replace(".", r"\.") for h in SKIP_HOSTS)

    def fits(u: Column) -> Column:
        social = F.lower(netloc(u)).rlike(rf"(^|\.)({hosts})$")
        itself = F.regexp_replace(u, "/+$", "") == F.regexp_replace(col(page_url), "/+$", "")
        ok = is_web(u) & ~social & ~itself
        if pattern is None:
            return ok
        if isinstance(pattern, str):
            return ok & u.rlike(f"(?i){pattern}")
        return ok & (pattern.isNull() | (pattern == "")
                     | F.rlike(u, F.concat(F.lit("(?i)"), pattern)))

    return let(url, fits)


def slug_title(url: Column | str) -> Column:
    """A readable stand-in title made of the last path segment."""
    slug = F.regexp_extract(path(url), r"([^/]*)/*$", 1)
    slug = F.regexp_replace(slug, r"\.(html?|php|aspx?)$", "")
    words = squeeze(F.regexp_replace(F.coalesce(F.try_url_decode(slug), slug), "[-_+]+", " "))
    return F.substring(
        F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2))), 1, 300)


def normalise_url(url: Column | str) -> Column:
    """struct(url, reason): a pasted link made absolute, or why it is refused."""
    text = strip(F.coalesce(col(url), F.lit("")))
    full = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text))
    host = hostname(full)
    user = netloc(full).contains("@")
    reason = (F.when(text == "", "empty")
              .when(F.length(text) > MAX_URL_CHARS, "too long")
              .when(~is_web(full) | ~host.contains("."), "not a web address")
              .when(user, "has credentials"))
    return F.struct(F.when(reason.isNull(), full).alias("url"), reason.alias("reason"))


def social_account(url: Column | str) -> Column:
    """struct(url, kind, slug, reason) of the account a social link belongs to."""
    text = strip(F.coalesce(col(url), F.lit("")))
    full = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text))
    host = hostname(full)
    section = F.lower(F.regexp_extract(path(full), r"(?i)^/(in|company)/([^/?#]+)", 1))
    raw = F.regexp_extract(path(full), r"(?i)^/(in|company)/([^/?#]+)", 2)
    slug = F.lower(strip(F.coalesce(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B")), raw)))
    single = F.lower(path(full)).rlike(r"^/(posts|feed|pulse)/")
    reason = (F.when(text == "", "empty")
              .when(F.length(text) > MAX_URL_CHARS, "too long")
              .when(~is_web(full) | ~((host == SOCIAL_HOST) | host.endswith("." + SOCIAL_HOST)),
                    "not a social link")
              .when((section == "") & single, "single post")
              .when(section == "", "no account")
              .when(~slug.rlike(r"""^[^\s/<>"']{1,100}$"""), "no account"))
    quoted = F.url_encode(slug)
    for found, wanted in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        quoted = F.replace(quoted, F.lit(found), F.lit(wanted))
    ok = reason.isNull()
    return F.struct(
        F.when(ok, F.concat(F.lit(f"https://www.{SOCIAL_HOST}/"), section, F.lit("/"), quoted,
                            F.lit("/"))).alias("url"),
        F.when(ok, F.when(section == "in", "profile").otherwise("company")).alias("kind"),
        F.when(ok, slug).alias("slug"),
        reason.alias("reason"))


def is_calendar(url: Column | str) -> Column:
    return F.regexp_replace(hostname(url), r"^www\.", "").isin(*CALENDAR_HOSTS)


def calendar_readable(url: Column | str) -> Column:
    return is_calendar(url) & ~F.lower(path(url)).startswith("/calendar/")


def calendar_read_url(url: Column | str) -> Column:
    """The link in the form the calendar reader accepts: https and one host."""
    url = col(url)
    moved = F.regexp_replace(hostname(url), r"^www\.", "") == "luma.com"
    host = F.when(moved, F.lit(CALENDAR_READ_HOST)).otherwise(netloc(url))
    return F.concat(F.lit("https://"), host, path(url), _part(url, 4), _part(url, 5))


def event_uid(source_key: Column | str, own_link: Column | str, url: Column | str,
              title: Column | str, starts_at: Column | str) -> Column:
    """Stable within a source: the event's own link, else page, title and Indian day."""
    day = F.date_format(F.from_utc_timestamp(col(starts_at), "Asia/Kolkata"), "yyyy-MM-dd")
    shared = F.concat(col(url), F.lit("#"), squeeze(F.lower(col(title))), F.lit("|"), day)
    ident = F.when(col(own_link), trimmed(url)).otherwise(shared)
    return F.sha1(F.concat(col(source_key), F.lit("\n"), ident))
