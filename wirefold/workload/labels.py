"""Prompts out of documents, answers made from the label table, and search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirefold.functions import text
from wirefold.operators import labels, search, term_index
from wirefold.operators.greedy import cut
from wirefold.session import checkpoint_dir
from wirefold.workload.base import DOC_AS_OF, DOC_SQL, Tables, doc_articles, query

_LINE = """headline || CASE WHEN coalesce(description, '') <> ''
  THEN chr(10) || '    ' || substr(description, 1, 200) ELSE '' END"""
_PACKED = f"""{DOC_SQL}, packed AS (SELECT *, (row_number() OVER w - 1) // 30 AS batch,
  (row_number() OVER w - 1) % 30 + 1 AS number, {_LINE} AS line FROM docs
  WINDOW w AS (ORDER BY published_at DESC NULLS LAST, id))"""
_PROMPTS = f"""{_PACKED}, prompts AS (SELECT batch, string_agg('[' || number || '] ' || line, chr(10)
    ORDER BY number) AS prompt, count(*) AS records FROM packed GROUP BY batch)"""


def articles(t: Tables) -> DataFrame:
    none = F.lit(None)
    return doc_articles(t).select(
        "*", none.cast("bigint").alias("canonical_id"), none.cast("string").alias("company"),
        none.cast("string").alias("category"), none.cast("string").alias("summary"),
        none.cast("string").alias("description_origin"), none.cast("timestamp").alias("enriched_at"))


def packed(t: Tables) -> DataFrame:
    return labels.pack(labels.pending_articles(articles(t)), labels.ENRICH_BATCH,
                       labels.story_line(labels.ENRICH_CHARS),
                       F.col("published_at").desc_nulls_last(), F.col("id").asc())


@query(f"WITH {_PROMPTS} SELECT batch, prompt, records FROM prompts")
def prompt_batches(t: Tables) -> DataFrame:
    return labels.prompts(packed(t)).withColumn("records", F.col("records").cast("bigint"))


@query(f"""WITH {_PROMPTS}, e AS (SELECT batch, (greatest(1, length(prompt) // 4) * 0.15 + 4096 * 0.6)
    / 1000000 AS est FROM prompts), s AS (SELECT batch, sum(CAST(est AS DECIMAL(28, 12)))
    OVER (ORDER BY batch) AS run FROM e)
SELECT batch, round(CAST(run AS DOUBLE), 9) AS running_usd, CAST(run AS DOUBLE) <= 0.05 AS admitted
FROM s""")
def budget_admission(t: Tables) -> DataFrame:
    return labels.admit_batches(labels.prompts(packed(t)), 0.05).select(
        "batch", F.round("running_usd", 9).alias("running_usd"), "admitted")


@query(f"""WITH {DOC_SQL} SELECT id, CASE WHEN l.doc_id IS NOT NULL THEN 'Src ' || source END AS company,
  CASE WHEN l.doc_id IS NULL THEN NULL WHEN quality = 1 THEN 'Product Launch' ELSE 'Other' END AS category,
  CASE WHEN toxic = 1 THEN 'Summary of ' || id END AS summary,
  CASE WHEN toxic = 1 AND coalesce(length(description), 0) < 40 THEN 'Summary of ' || id
    ELSE description END AS description,
  CASE WHEN toxic = 1 AND coalesce(length(description), 0) < 40 THEN 'generated' END AS description_origin,
  l.doc_id IS NOT NULL AS enriched
FROM docs LEFT JOIN labels l ON l.doc_id = id""")
def apply_answers(t: Tables) -> DataFrame:
    """The label table as a model's answers: packed, answered in fenced JSON, applied."""
    p = packed(t)
    answer = F.to_json(F.struct(
        F.col("number").alias("i"), F.concat(F.lit(" Src "), "source", F.lit(". ")).alias("company"),
        F.when(F.col("quality") == 1, "product launch").otherwise("nonsense").alias("category"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("Summary  of "), F.col("id").cast("string")))
        .otherwise(" ").alias("summary")))
    answers = (p.join(t.labels.withColumnRenamed("doc_id", "id"), "id")
               .groupBy("batch").agg(F.concat(
                   F.lit("```json\n["), F.array_join(F.collect_list(answer), ","), F.lit("]\n```"))
                   .alias("body")))
    return labels.apply_enrichment(articles(t), p, answers, DOC_AS_OF).select(
        "id", "company", "category", "summary", "description", "description_origin",
        F.col("enriched_at").isNotNull().alias("enriched"))


@query("""SELECT count(*) AS labelled, CAST(count(*) FILTER (toxic = 0 OR quality = 1) AS BIGINT) AS answered,
  round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END), 9) AS exact,
  round(avg(CASE WHEN quality = 1 OR toxic = 0 THEN 1.0 ELSE 0 END), 9) AS acceptable,
  round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END), 9) AS company FROM labels""")
def label_eval(t: Tables) -> DataFrame:
    expected = t.labels.select(F.col("doc_id").alias("id"), F.lit("Funding").alias("category"),
                               F.array(F.lit("M&A")).alias("also_ok"), F.lit("Acme").alias("company"))
    answers = t.labels.where("toxic = 0 or quality = 1").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, "funding").otherwise("m&a").alias("category"),
        F.when(F.col("quality") == 1, "Acme Labs.").otherwise("Other Co").alias("company"))
    return labels.evaluate(expected, answers).select(
        "labelled", "answered", *[F.round(c, 9).alias(c) for c in ("exact", "acceptable", "company")])


_TERMS = """words AS (SELECT id, unnest(regexp_extract_all(strip_accents(lower(headline || ' ' ||
  coalesce(description, ''))), '[\\p{L}\\p{N}]+')) AS term FROM docs)"""


@query(f"""WITH {DOC_SQL}, {_TERMS}, len AS (SELECT id, count(*) AS l FROM words GROUP BY 1),
tot AS (SELECT count(*) AS n, avg(l) AS a FROM len),
tf AS (SELECT id, term, count(*) AS tf FROM words WHERE term IN ('there', 'thing', 'quand', 'reading',
  'schen') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2
  / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score, count(*) AS matched
FROM tf JOIN df USING (term) JOIN len USING (id), tot GROUP BY id""")
def bm25_search(t: Tables) -> DataFrame:
    index = cut(search.postings(doc_articles(t), ("headline", "description"), stemming=False),
                "index")
    return search.ranked(index, "There thing QUAND reading schen", stemming=False).select(
        "id", F.round("score", 6).alias("score"), "matched")


@query()
def stemmed_search(t: Tables) -> DataFrame:
    """The same with English stems, documents of one source first, best fifty."""
    docs = doc_articles(t).withColumn("company", F.col("source"))
    index = cut(search.postings(docs, ("headline", "description")), "index")
    return search.tiered(index, docs, "reading things there", "src3", 50)


@query(f"""WITH {DOC_SQL} SELECT id AS article_id, 0 AS chunk_index,
  headline || coalesce(chr(10) || chr(10) || nullif(description, ''), '') AS text FROM docs
WHERE coalesce(description, '') <> '' OR lang = 'de'""")
def chunk_repair(t: Tables) -> DataFrame:
    """Stored passages quote headlines only, and none of the German stories."""
    docs = doc_articles(t)
    stored = docs.where("lang != 'de'").select(
        F.col("id").alias("article_id"), F.lit(0).alias("chunk_index"), F.col("headline").alias("text"))
    return search.drifted_chunks(docs, stored)


# Stories of two thirds are indexed by their headline first; then the rest comes in whole and every other one
# of the first gets its description; then French stories go.
_KEPT_TERMS = """words AS (SELECT id, unnest(regexp_extract_all(strip_accents(lower(headline || CASE WHEN id % 3 <> 2
  THEN ' ' || coalesce(description, '') ELSE '' END)), '[\\p{L}\\p{N}]+')) AS term FROM docs WHERE lang <> 'fr'),
len AS (SELECT id, count(*) AS l FROM words GROUP BY 1),
tf AS (SELECT id, term, count(*) AS tf FROM words GROUP BY ALL)"""


def _index_in_step(t: Tables) -> str:
    """Where an index lies that was built by an insert, an update and a delete."""
    root = f"{checkpoint_dir(t.spark)}/terms-{uuid.uuid4().hex}"
    docs = doc_articles(t).select("id", "lang", "headline", "description")
    fields = ("headline", "description")
    bare = docs.withColumn("description", F.lit(None).cast("string"))
    first, final = bare.where("id % 3 != 0"), bare.where("id % 3 = 2").unionByName(docs.where("id % 3 != 2"))
    term_index.apply_changes(first.limit(0), first, root, 0, fields)
    term_index.apply_changes(bare.where("id % 3 = 1"), docs.where("id % 3 != 2"), root, 1, fields)
    gone = final.where("lang = 'fr'")
    term_index.apply_changes(gone, gone.limit(0), root, 2, fields)
    return root


@query(f"""WITH {DOC_SQL}, {_KEPT_TERMS} SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS uses,
  CAST(sum(l) AS BIGINT) AS words FROM tf JOIN len USING (id) GROUP BY 1""")
def index_in_step(t: Tables) -> DataFrame:
    """Every term of the stored index: records that hold it, its uses, and the words of those records."""
    postings, found = term_index.stored(t.spark, _index_in_step(t), 3)
    uses = (postings.groupBy("term", "id").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
            .groupBy("term").agg(F.sum("tf").alias("uses"), F.sum("length").alias("words")))
    return found.join(uses, "term", "full_outer")


@query(f"""WITH {DOC_SQL}, {_KEPT_TERMS}, tot AS (SELECT count(*) AS n, avg(l) AS a FROM len),
hit AS (SELECT * FROM tf WHERE term IN ('there', 'thing', 'quand', 'reading', 'schen')),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY 1)
SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2
  / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score, count(*) AS matched
FROM hit JOIN df USING (term) JOIN len USING (id), tot GROUP BY id""")
def index_lookup(t: Tables) -> DataFrame:
    """Ranked stories of the stored index, of which the files of the five words are read."""
    found = term_index.lookup(t.spark, _index_in_step(t), "There thing QUAND reading schen", 3)
    return found.select("id", F.round("score", 6).alias("score"), "matched")


FIELDS = (("", "headline"), ("about: ", "description"))


@query(f"""WITH {DOC_SQL} SELECT lang AS request_id, 'Shown:' || chr(10)
  || string_agg(n || '. ' || substr(headline, 1, 280) || CASE WHEN coalesce(description, '') <> ''
    THEN chr(10) || 'about: ' || substr(description, 1, 280) ELSE '' END, chr(10) ORDER BY n)
  || chr(10) || 'Summarise.' AS prompt
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY id DESC) AS n FROM docs) WHERE n <= 40
GROUP BY 1""")
def digest_prompts(t: Tables) -> DataFrame:
    """Per language, a digest of the forty newest stories, as a reader would see them."""
    from pyspark.sql.window import Window
    docs = articles(t)
    w = Window.partitionBy("lang").orderBy(F.col("id").desc())
    newest = docs.select("lang", "id", F.row_number().over(w).alias("n")).where("n <= 40")
    requests = newest.groupBy(F.col("lang").alias("request_id")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("n", "id"))), lambda s: s["id"]).alias("ids"))
    return labels.digest_prompts(docs, requests, "Shown:", FIELDS, "Summarise.")


@query(f"""WITH {DOC_SQL} SELECT id, 'Story:' || CASE WHEN coalesce(headline, '') <> '' THEN chr(10)
  || substr(headline, 1, 280) ELSE '' END || CASE WHEN coalesce(description, '') <> ''
  THEN chr(10) || 'about: ' || substr(description, 1, 280) ELSE '' END || chr(10) || 'Explain.' AS prompt
FROM docs WHERE coalesce(headline, '') <> ''""")
def story_prompts(t: Tables) -> DataFrame:
    """One question per document with a headline."""
    rows = articles(t).where("coalesce(headline, '') != ''")
    return labels.story_prompts(rows, "Story:", FIELDS, "Explain.")


@query(f"""SELECT url, 'Page:' || chr(10) || 'at: ' || url || chr(10) || substr(html, 1, {labels.PAGE_PROMPT_CHARS})
  || chr(10) || 'Answer.' AS prompt, greatest(length(html) - {labels.PAGE_PROMPT_CHARS}, 0) AS cut FROM pages""")
def page_prompts(t: Tables) -> DataFrame:
    """Raw pages as the body of a question, with what was cut."""
    rows = t.pages.select("url", F.col("html").alias("body"))
    return labels.page_prompts(rows, "Page:", (("at: ", "url"),), "Answer.")


# Records by id: answered twice, as a bare word, without number, or with a number that no record has.
_ODD = "CASE id % 7 WHEN 0 THEN 'twice' WHEN 1 THEN 'word' WHEN 2 THEN 'bare' WHEN 3 THEN 'far' ELSE 'fine' END"


def _odd_answers(rows: DataFrame) -> DataFrame:
    """One answer for each batch of ``rows``: every fifth is no JSON, every seventh an empty list."""
    kind, number = F.col("id") % 7, F.col("number").cast("string")
    entry = F.concat(F.lit('{"i": '), F.when(kind == 3, F.concat(number, F.lit("000"))).otherwise(number), F.lit(
        ', "company": '), F.to_json(F.struct(F.col("source").alias("s"))).substr(F.lit(6), F.lit(1000)))
    said = (F.when(kind == 0, F.concat(F.lit('{"i": "'), number, F.lit('", "company": "first"},'), entry))
            .when(kind == 1, F.lit('"word"')).when(kind == 2, F.lit('{"company": "bare"}')).otherwise(entry))
    bodies = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("number", said.alias("said")))).alias("s"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("s", lambda s: s["said"]), ","), F.lit("]"))
    return bodies.select("batch", F.when(F.col("batch") % 5 == 4, "Sorry, I cannot.").when(
        F.col("batch") % 7 == 6, "[]").otherwise(listed).alias("body"))


@query(f"""WITH {_PACKED}, k AS (SELECT batch, {_ODD} AS kind, batch % 5 = 4 AS no_json,
  batch % 5 <> 4 AND batch % 7 = 6 AS bare FROM packed),
c AS (SELECT batch, no_json, bare, count(*) AS n, count(*) FILTER (kind = 'twice') AS twice,
  count(*) FILTER (kind = 'word') AS word, count(*) FILTER (kind = 'bare') AS unnumbered,
  count(*) FILTER (kind = 'far') AS far FROM k GROUP BY ALL),
e AS (SELECT *, no_json OR bare AS nothing FROM c)
SELECT batch, CASE WHEN nothing THEN 1 ELSE n + twice END AS "read",
  CASE WHEN nothing THEN 0 ELSE n - word - unnumbered - far END AS applied, no_json::BIGINT AS unreadable,
  bare::BIGINT AS empty, CASE WHEN nothing THEN 0 ELSE word END AS not_object,
  CASE WHEN nothing THEN 0 ELSE unnumbered END AS unnumbered, CASE WHEN nothing THEN 0 ELSE far END AS out_of_range,
  CASE WHEN nothing THEN 0 ELSE twice END AS repeated FROM e""")
def answers_judged(t: Tables) -> DataFrame:
    """Answers of every document's batch, stored once: what was applied and what refused, for each batch."""
    rows = cut(packed(t), "packed")
    judged = labels.judge_answers(rows, _odd_answers(rows))
    path = f"{checkpoint_dir(t.spark)}/answers-{uuid.uuid4().hex}"
    labels.store_answers(judged, path)
    both = labels.stored_answers(judged, path, refused=True).unionByName(
        labels.stored_answers(judged, path).withColumn("refused", F.lit(None).cast("string")))
    return both.groupBy("batch").agg(
        F.count(F.lit(1)).alias("read"), F.count_if(F.col("refused").isNull()).alias("applied"),
        *[F.count_if(F.col("refused") == r).alias({"not an object": "not_object"}.get(r, r.replace(" ", "_")))
          for r in labels.REFUSALS])


@query(f"""WITH {_PACKED} SELECT id, source FROM packed
WHERE batch % 5 <> 4 AND batch % 7 <> 6 AND id % 7 NOT IN (1, 2, 3)""")
def answers_applied(t: Tables) -> DataFrame:
    """The entries of the same answers that reach a document, the later one where it has two."""
    rows = cut(packed(t), "packed")
    judged = labels.judge_answers(rows, _odd_answers(rows))
    return judged.where("refused is null").select("id", F.col("entry")["company"].alias("source"))


_STEER = text.STEER_WORDS.replace("(?i)", "")


@query(f"""WITH {DOC_SQL}, q AS (SELECT id, trim(regexp_replace(headline, '\\s+', ' ', 'g')) AS q FROM docs)
SELECT id, CASE WHEN q <> '' AND NOT regexp_matches(q, '{_STEER}', 'i') THEN q || ' startup news' ELSE q END AS query
FROM q""")
def steered_queries(t: Tables) -> DataFrame:
    """Every headline as a bare query."""
    return doc_articles(t).select("id", text.steer_query("headline").alias("query"))


@query(f"""SELECT url, 'List the events.' || chr(10) || 'Today is 2026-01-31' || chr(10) || 'Page: ' || url || chr(10)
  || 'From: Host ' || (page_id % 3) || CASE WHEN page_id % 3 = 0 THEN chr(10) || 'Only here.' ELSE '' END || chr(10)
  || substr(html, 1, {labels.PAGE_PROMPT_CHARS}) || chr(10) || 'JSON only.' AS prompt,
  greatest(length(html) - {labels.PAGE_PROMPT_CHARS}, 0) AS cut FROM pages WHERE page_id % 4 <> 3""")
def event_page_prompts(t: Tables) -> DataFrame:
    """Raw pages of three hosts as event pages, one host's with the region rule; a fourth host is unknown."""
    hosts = t.spark.createDataFrame([("h0", "Host 0", True), ("h1", "Host 1", False), ("h2", "Host 2", None)],
                                    "source_key string, organiser string, india_only boolean")
    known = F.when(F.col("page_id") % 4 != 3, F.concat(F.lit("h"), (F.col("page_id") % 3).cast("string")))
    rows = t.pages.select(known.alias("source_key"), "url", F.col("html").alias("body"))
    pages = labels.event_pages(rows, hosts, DOC_AS_OF, "Only here.")
    fields = (("Today is ", "today"), ("Page: ", "url"), ("From: ", "label"), ("", "rule"))
    return labels.page_prompts(pages, "List the events.", fields, "JSON only.")
