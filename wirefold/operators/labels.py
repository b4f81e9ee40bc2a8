"""Handing records to a model in numbered batches, and applying what comes back.

Nothing here calls a model. One side writes prompts; the other reads a table of
``answers(batch, body)`` and coerces every field, since an answer may be anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wirefold.functions import money, taxonomy
from wirefold.functions.answers import json_part
from wirefold.functions.text import col, company_text, label_text, let, squeeze, strip
from wirefold.functions.times import IST, instant
from wirefold.functions.urls import slug_title
from wirefold.operators.dedupe import admit_added_rounds
from wirefold.operators.greedy import cut
from wirefold.operators.numbering import number_rows, running_sum

# --- fixed values: batch sizes, text sent per record, thresholds ----------------------
ENRICH_BATCH, ROUNDS_BATCH, FIRM_BATCH, SOCIAL_BATCH, ADDED_BATCH = 30, 20, 25, 20, 20
ENRICH_CHARS, ROUNDS_CHARS, FIRM_CHARS, SOCIAL_CHARS, DIGEST_CHARS = 200, 300, 240, 700, 280
THIN_DESCRIPTION = 40
PAGE_FETCHES_PER_READ = 12
DIGEST_STORIES = 40
PAGE_PROMPT_CHARS = 20_000
# ---------------------------------------------------------------------------------------


def _filled(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("")) != ""


# --- what is waiting -------------------------------------------------------------------

def pending_articles(articles: DataFrame) -> DataFrame:
    return articles.where("canonical_id is null and enriched_at is null")


def pending_rounds(articles: DataFrame, rounds: DataFrame) -> DataFrame:
    return (articles.where("canonical_id is null and category = 'Funding'")
            .join(rounds.select(F.col("article_id").alias("id")), "id", "left_anti"))


def pending_firm_posts(posts: DataFrame) -> DataFrame:
    return posts.where("classified_at is null")


def pending_social_posts(posts: DataFrame, sources: DataFrame) -> DataFrame:
    names = sources.select(F.col("id").alias("source_id"), F.col("label").alias("account"))
    return posts.where("classified_at is null").join(names, "source_id")


def pending_added_rounds(rounds: DataFrame) -> DataFrame:
    return rounds.where("extracted_at is null")


def pending_descriptions(articles: DataFrame) -> DataFrame:
    return articles.where("canonical_id is null and (description is null or published_at is null)")


def posts_needing_page(posts: DataFrame, read_id: str = "source_key",
                       limit: int = PAGE_FETCHES_PER_READ) -> DataFrame:
    """The first new posts of each read that lack an exact date or a real title."""
    w = Window.partitionBy(read_id).orderBy("id")
    return (posts.where((F.col("title") == slug_title("url")) | F.col("published_at").isNull()
                        | F.col("date_approx"))
            .withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("n"))


# --- prompts ---------------------------------------------------------------------------

def story_line(chars: int) -> Column:
    return F.when(_filled("description"), F.concat(
        "headline", F.lit("\n    "), F.substring("description", 1, chars))
    ).otherwise(F.col("headline"))


def firm_post_line() -> Column:
    head = F.concat(F.lit("(Firm: "), F.coalesce("firm_label", "firm"), F.lit(") "), "title")
    return F.when(_filled("snippet"), F.concat(
        head, F.lit("\n    "), F.substring("snippet", 1, FIRM_CHARS))).otherwise(head)


def social_post_line() -> Column:
    who = F.concat(F.lit("(Account: "), "account", F.when(
        F.col("repost") & _filled("author"), F.concat(F.lit(", reposting "), "author")
    ).otherwise(""), F.lit(")\n    "))
    return F.concat(who, F.substring(squeeze("content"), 1, SOCIAL_CHARS))


def pack(rows: DataFrame, size: int, line: Column, *order: Column) -> DataFrame:
    """``rows`` with ``batch``, ``number`` (from 1) and ``line``. The order must be total."""
    n = F.col("_n")
    return (number_rows(rows.withColumn("line", line), *order, name="_n")
            .withColumn("batch", F.floor(n / size)).withColumn("number", (n % size + 1).cast("int"))
            .drop("_n"))


def prompts(packed: DataFrame, head: str = "") -> DataFrame:
    """(batch, prompt, records): one prompt per batch, records in number order."""
    text = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), "line")
    return (packed.groupBy("batch")
            .agg(F.array_sort(F.collect_list(F.struct("number", text.alias("t")))).alias("s"))
            .select("batch", F.concat(F.lit(f"{head}\n" if head else ""), F.array_join(
                F.transform("s", lambda s: s["t"]), "\n")).alias("prompt"),
                F.size("s").alias("records")))


def admit_batches(batches: DataFrame, headroom_usd: float, max_tokens: int = 4096,
                  price: tuple[float, float] = money.CHEAP) -> DataFrame:
    """Batches in order with their estimated and running cost, and whether they fit."""
    est = money.estimate(F.length("prompt"), max_tokens, price)
    rows = batches.withColumn("estimate_usd", est)
    return running_sum(rows, "batch", F.col("estimate_usd"), "running_usd").withColumn(
        "admitted", F.col("running_usd") <= headroom_usd)


Fields = tuple[tuple[str, str], ...]      # (caption, column) pairs, in the order they are shown


def field_lines(fields: Fields, chars: int | None = None) -> Column:
    """One line per filled column: its caption and its value, cut to ``chars`` if given."""
    def line(caption: str, name: str) -> Column:
        value = F.col(name).cast("string")
        shown = value if chars is None else F.substring(value, 1, chars)
        return F.when(_filled(name), F.concat(F.lit(caption), shown))
    return F.concat_ws("\n", *[line(caption, name) for caption, name in fields])


def story_prompts(articles: DataFrame, head: str, fields: Fields, tail: str,
                  chars: int | None = DIGEST_CHARS) -> DataFrame:
    """(id, prompt) asking about one story each."""
    return articles.select("id", F.concat_ws(
        "\n", F.lit(head), field_lines(fields, chars), F.lit(tail)).alias("prompt"))


def fetch_in_order(articles: DataFrame, requests: DataFrame,
                   limit: int = DIGEST_STORIES) -> DataFrame:
    """Articles of requests(request_id, ids array), at most ``limit`` each, with ``pos``."""
    wanted = requests.select("request_id", F.posexplode(F.slice("ids", 1, limit)).alias("pos", "id"))
    return wanted.join(articles, "id")


def digest_prompts(articles: DataFrame, requests: DataFrame, head: str, fields: Fields, tail: str,
                   chars: int | None = DIGEST_CHARS, limit: int = DIGEST_STORIES) -> DataFrame:
    """(request_id, prompt) of the stories a reader has before them, numbered from 1."""
    rows = fetch_in_order(articles, requests, limit).select(
        "request_id", "pos", field_lines(fields, chars).alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "t")))
    numbered = F.transform("s", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["t"]))
    return rows.groupBy("request_id").agg(ordered.alias("s")).select("request_id", F.concat_ws(
        "\n", F.lit(head), F.array_join(numbered, "\n"), F.lit(tail)).alias("prompt"))


def page_prompts(pages: DataFrame, head: str, fields: Fields, tail: str,
                 limit: int | None = PAGE_PROMPT_CHARS) -> DataFrame:
    """(url, prompt, cut) of pages(url, body, ...): the fields, then the body up to ``limit``
    characters; ``cut`` says how many were left out."""
    body = F.coalesce(F.col("body"), F.lit(""))
    shown = body if limit is None else F.substring(body, 1, limit)
    return pages.select("url", F.concat_ws(
        "\n", F.lit(head), field_lines(fields), shown, F.lit(tail)).alias("prompt"),
        (F.length(body) - F.length(shown)).alias("cut"))


def event_pages(pages: DataFrame, sources: DataFrame, as_of, region_rule: str) -> DataFrame:
    """(url, label, rule, today, body) of pages(source_key, url, body) of known event sources, as
    page_prompts takes them: whose page it is, ``region_rule`` for a source of one region, and the Indian day."""
    today = F.date_format(F.from_utc_timestamp(instant(as_of), IST), "yyyy-MM-dd")
    known = sources.select("source_key", F.col("organiser").alias("label"), F.when(
        F.coalesce(F.col("india_only"), F.lit(False)), F.lit(region_rule)).alias("rule"))
    return pages.join(known, "source_key").select("url", "label", "rule", today.alias("today"), "body")


# --- answers ---------------------------------------------------------------------------

def read_answers(answers: DataFrame) -> DataFrame:
    """(batch, number, pos, entry): every numbered object of every answer."""
    items = F.from_json(let(json_part("body"), lambda p: F.when(p.startswith("["), p)),
                        "array<string>")
    entry = F.from_json("item", "map<string,string>")
    return (answers.select("batch", F.posexplode(items).alias("pos", "item"))
            .where(F.col("item").startswith("{"))
            .select("batch", "pos", entry.alias("entry"))
            .withColumn("number", F.col("entry")["i"].try_cast("double").cast("int"))
            .where("number is not null"))


REFUSALS = ("unreadable", "empty", "not an object", "unnumbered", "out of range", "repeated")


def judge_answers(packed: DataFrame, answers: DataFrame) -> DataFrame:
    """(batch, pos, id, number, item, entry, refused): every entry of every answer(batch, body).

    ``refused`` is null for the entry that is applied to record ``id`` and else one of REFUSALS. An
    answer without a JSON list is one row, unreadable, and a list without entries one row, empty. Of entries with
    one number the last counts, and the greatest text of several in one place (a batch answered twice).
    """
    part = let(json_part("body"), lambda p: F.when(p.startswith("["), p))
    lists = answers.select("batch", F.from_json(part, "array<string>").alias("items"))
    entries = (lists.select("batch", F.col("items").isNull().alias("unreadable"), F.size("items").alias("n"),
                            F.posexplode_outer("items").alias("pos", "item"))
               .withColumn("entry", F.when(F.col("item").startswith("{"), F.from_json("item", "map<string,string>")))
               .withColumn("number", F.col("entry")["i"].try_cast("double").cast("int")))
    known = packed.select("batch", "number", "id", F.lit(True).alias("known"))
    # Only entries with a record are compared; the others have a place of their own.
    places = Window.partitionBy("batch", "number", F.when(F.col("known").isNull(), F.col("pos"))).orderBy(F.col("pos").desc(), F.col("item").desc())
    found = entries.join(known, ["batch", "number"], "left").withColumn("place", F.row_number().over(places))
    refused = (F.when(F.col("unreadable"), "unreadable").when(F.col("n") == 0, "empty")
               .when(F.col("entry").isNull(), "not an object").when(F.col("number").isNull(), "unnumbered")
               .when(F.col("known").isNull(), "out of range").when(F.col("place") > 1, "repeated"))
    return found.select("batch", "pos", "id", "number", "item", "entry", refused.alias("refused"))


def store_answers(judged: DataFrame, path: str) -> dict[str, int]:
    """Write judged entries under ``path``, applied ones apart from each kind of refused ones, and give the
    counts: ``read``, ``applied`` and each refusal. They are observed by the job that writes.
    """
    counts = Observation()
    out = judged.observe(counts, F.count(F.lit(1)).alias("read"), F.count_if(F.col("refused").isNull()).alias("applied"),
                         *[F.count_if(F.col("refused") == r).alias(r) for r in REFUSALS])
    out.withColumn("refused", F.coalesce("refused", F.lit("applied"))).write.mode("overwrite").partitionBy(
        "refused").parquet(path)
    return counts.get


def stored_answers(judged: DataFrame, path: str, refused: bool = False) -> DataFrame:
    """The entries that were applied, or those refused with their reason; the other folders are not read."""
    rows = judged.sparkSession.read.schema(judged.schema).parquet(path)
    applied = F.col("refused") == "applied"
    return rows.where(~applied) if refused else rows.where(applied).drop("refused")


def _last(entries: DataFrame) -> DataFrame:
    return entries.groupBy("batch", "number").agg(F.max_by("entry", "pos").alias("entry"))


def _investors(entry: Column) -> Column:
    raw = entry["investors"]
    names = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(
        taxonomy.split_investors(raw))
    return taxonomy.investors_text(names)


def apply_enrichment(articles: DataFrame, packed: DataFrame, answers: DataFrame,
                     as_of) -> DataFrame:
    """Articles with company, category, summary set where answered; the rest unchanged.

    A later answer to the same number wins. A thin description gives way to the summary.
    """
    entries = read_answers(answers).withColumn(
        "said", F.when(strip(F.col("entry")["summary"]) != "",
                       F.substring(squeeze(F.col("entry")["summary"]), 1, 400)))
    last = entries.groupBy("batch", "number").agg(
        F.max_by("entry", "pos").alias("e"),
        F.max_by("said", F.when(F.col("said").isNotNull(), F.col("pos"))).alias("said"))
    got = packed.select("id", "batch", "number").join(last, ["batch", "number"]).select(
        "id", company_text(F.col("e")["company"]).alias("n_company"),
        taxonomy.category(F.col("e")["category"]).alias("n_category"), "said",
        F.lit(True).alias("answered"))
    thin = F.coalesce(F.length("description"), F.lit(0)) < THIN_DESCRIPTION
    swap = F.col("said").isNotNull() & thin
    set_to = {
        "company": F.when(F.col("answered"), F.col("n_company")).otherwise(F.col("company")),
        "category": F.when(F.col("answered"), F.col("n_category")).otherwise(F.col("category")),
        "summary": F.coalesce("said", "summary"),
        "description_origin": F.when(swap, "generated").otherwise(F.col("description_origin")),
        "description": F.when(swap, F.col("said")).otherwise(F.col("description")),
        "enriched_at": F.when(F.col("answered"), instant(as_of)).otherwise(F.col("enriched_at")),
    }
    joined = articles.join(got, "id", "left")
    return joined.select(*[set_to[c].alias(c) if c in set_to else F.col(c)
                           for c in articles.columns])


def _answered(packed: DataFrame, answers: DataFrame) -> DataFrame:
    return packed.join(_last(read_answers(answers)), ["batch", "number"])


def apply_rounds(packed: DataFrame, answers: DataFrame, as_of) -> DataFrame:
    """New funding rounds of the articles answered; the company falls back to the article's."""
    e = F.col("entry")
    label = taxonomy.clean_round(e["round"])
    return _answered(packed, answers).select(
        F.col("id").alias("article_id"),
        F.coalesce(label_text(e["company"], 200), "company").alias("company"),
        taxonomy.stage(e["stage"], label).alias("stage"), label.alias("round_label"),
        label_text(e["amount"], 120).alias("amount"), _investors(e).alias("investors"),
        instant(as_of).alias("extracted_at"))


def _told(packed: DataFrame, answers: DataFrame, fields: dict[str, Column]) -> DataFrame:
    return _answered(packed.select("id", "batch", "number"), answers).select(
        "id", *[c.alias(f"n_{name}") for name, c in fields.items()], F.lit(True).alias("answered"))


def _set(posts: DataFrame, told: DataFrame, names) -> DataFrame:
    joined = posts.join(told, "id", "left")
    return joined.select(*[
        F.when(F.col("answered"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
        if c in names else F.col(c) for c in posts.columns])


def _apply(posts: DataFrame, packed: DataFrame, answers: DataFrame, fields: dict[str, Column]
           ) -> DataFrame:
    return _set(posts, _told(packed, answers, fields), fields)


def apply_firm_posts(posts: DataFrame, packed: DataFrame, answers: DataFrame, as_of) -> DataFrame:
    e = F.col("entry")
    return _apply(posts, packed, answers, {
        "kind": taxonomy.firm_post_kind(e["kind"]), "headline": label_text(e["headline"], 300),
        "company": label_text(e["company"], 200), "round_label": taxonomy.clean_round(e["round"]),
        "amount": label_text(e["amount"], 120), "classified_at": instant(as_of)})


def apply_social_posts(posts: DataFrame, packed: DataFrame, answers: DataFrame, as_of) -> DataFrame:
    """Round, amount and investors are taken for Funding posts only."""
    e = F.col("entry")
    kind = taxonomy.social_kind(e["kind"])
    funding = kind == "Funding"
    return _apply(posts, packed, answers, {
        "kind": kind, "headline": label_text(e["headline"], 300),
        "company": label_text(e["company"], 200),
        "round_label": F.when(funding, taxonomy.clean_round(e["round"])),
        "amount": F.when(funding, label_text(e["amount"], 120)),
        "investors": F.when(funding, _investors(e)), "classified_at": instant(as_of)})


def apply_added_rounds(rounds: DataFrame, packed: DataFrame, answers: DataFrame,
                       known: DataFrame, as_of) -> DataFrame:
    """Added-site posts with their round; ``kept`` when a raise by a named company is new.

    The answers are read once and written down, and so are the raises among them: telling which are new asks
    for them several times.
    """
    e = F.col("entry")
    label = taxonomy.clean_round(e["round"])
    fields = {
        "round_label": label, "company": label_text(e["company"], 200),
        "stage": taxonomy.stage(e["stage"], label), "amount": label_text(e["amount"], 120),
        "investors": _investors(e), "extracted_at": instant(as_of),
        "raising": F.coalesce(e["raise"] == "true", F.lit(False))}
    told = cut(_told(packed, answers, fields), "added-told")
    raises = told.where("n_raising and n_company is not null").select(
        "id", F.col("n_company").alias("company"), F.col("n_stage").alias("stage"))
    fresh = cut(rounds.select("id", "published_at").join(raises, "id"), "added-raises")
    before = rounds.where("kept").select("company", "stage", "published_at")
    new = admit_added_rounds(fresh, known.select("company", "stage", "published_at")
                             .unionByName(before)).select("id", F.lit(True).alias("is_new"))
    got = _set(rounds.withColumn("raising", F.lit(None).cast("boolean")), told, fields)
    return (got.join(new, "id", "left")
            .withColumn("kept", F.when(F.col("raising").isNull(), F.col("kept"))
                        .otherwise(F.coalesce("is_new", F.lit(False))))
            .select(*rounds.columns))


def apply_page_meta(articles: DataFrame, meta: DataFrame) -> DataFrame:
    """meta(url, description, published_at): the longer description wins, a date fills a gap."""
    found = meta.select("url", F.col("description").alias("m_description"),
                        F.col("published_at").alias("m_published"))
    waiting = F.col("canonical_id").isNull() & (
        F.col("description").isNull() | F.col("published_at").isNull())
    better = waiting & F.coalesce(F.length("m_description") > F.coalesce(
        F.length("description"), F.lit(0)), F.lit(False))
    set_to = {
        "description_origin": F.when(better, "meta").otherwise(F.col("description_origin")),
        "description": F.when(better, F.col("m_description")).otherwise(F.col("description")),
        "published_at": F.when(waiting, F.coalesce("published_at", "m_published"))
        .otherwise(F.col("published_at")),
    }
    joined = articles.join(found, "url", "left")
    return joined.select(*[set_to[c].alias(c) if c in set_to else F.col(c)
                           for c in articles.columns])


def apply_post_pages(posts: DataFrame, needing: DataFrame, meta: DataFrame) -> DataFrame:
    """meta(url, page_title, description, published_at) of opened posts: an exact date
    replaces an approximate one, a page's title one made from the link."""
    found = needing.select("id", "url").join(meta, "url").select(
        "id", "page_title", F.col("description").alias("m_description"),
        F.col("published_at").alias("m_published"))
    from_slug = F.col("title") == slug_title("url")
    set_to = {
        "date_approx": F.col("date_approx") & F.col("m_published").isNull(),
        "published_at": F.coalesce("m_published", "published_at"),
        "title": F.when(from_slug, F.coalesce(F.when(_filled("page_title"), F.col("page_title")),
                                              "title")).otherwise(F.col("title")),
        "snippet": F.when(_filled("snippet"), F.col("snippet")).otherwise(
            label_text("m_description", 400)),
    }
    joined = posts.join(found, "id", "left")
    return joined.select(*[set_to[c].alias(c) if c in set_to else F.col(c)
                           for c in posts.columns])


def name_from_posts(sources: DataFrame, found: DataFrame) -> DataFrame:
    """An account whose label was made from its link takes its own posts' first author."""
    own = (found.where("author is not null and not repost").groupBy("source_id")
           .agg(F.min_by("author", "pos").alias("own")).withColumnRenamed("source_id", "id"))
    joined = sources.join(own, "id", "left")
    take = F.col("label_auto") & F.col("own").isNotNull()
    set_to = {"label": F.when(take, F.col("own")).otherwise(F.col("label")),
              "label_auto": F.col("label_auto") & ~take}
    return joined.select(*[set_to[c].alias(c) if c in set_to else F.col(c)
                           for c in sources.columns])


# --- how good the labels are -------------------------------------------------------------

def loose_company(expected: Column | str, got: Column | str) -> Column:
    """Same company when one name contains the other, ignoring case and edge space."""
    e, g = F.lower(strip(expected)), F.lower(strip(got))
    missing = F.coalesce(e, F.lit("")) == ""
    none = F.coalesce(g, F.lit("")) == ""
    return F.when(missing | none, missing & none).otherwise(g.contains(e) | e.contains(g))


def evaluate(labels: DataFrame, answers: DataFrame) -> DataFrame:
    """labels(id, category, also_ok, company) against answers(id, category, company)."""
    got = answers.select("id", taxonomy.category("category").alias("got"),
                         company_text("company").alias("got_company"))
    both = labels.join(got, "id", "left")
    answered = F.col("got").isNotNull()
    exact = answered & (F.col("got") == F.col("category"))
    fine = exact | (answered & F.array_contains(
        F.coalesce("also_ok", F.array().cast("array<string>")), F.col("got")))
    company = answered & loose_company("company", "got_company")

    def share(c: Column) -> Column:
        return F.sum(c.cast("int")) / F.count("*")

    return both.agg(F.count("*").alias("labelled"), F.sum(answered.cast("int")).alias("answered"),
                    share(exact).alias("exact"), share(fine).alias("acceptable"),
                    share(company).alias("company"))
