"""Queries on a library's state: flattened documents, listings, snapshots, page texts, job transitions and backfills.

Conversations stand for the pages of the documents of the same id, events for jobs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import quality
from ..operators import enrich, models, organise, refresh, store, views
from ..operators import folders as fo
from ..operators import rules as R
from ..functions.text import search_text
from ..sources import files, snapshots, versions
from ..sources import library as lib
from ..streaming import ingest
from .documents import CATEGORY_RULES, COMMON, DOMAIN, QUALITY_SQL, SQL_LIST, clean_sql, counted_sql, table
from .editing import CLEAN_SQL as PLAIN_PHRASES
from .editing import FOLDERS_SQL, THREE_SQL, _folders, _three
from .editing import PHRASES_SQL as PHRASE_WORDS
from .organising import JOBS_SQL, PLACES_SQL, SUGGESTED_SQL, all_folders, edits, jobs, library, places
from .registry import ORACLES, query


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        n.alias("document_id"), F.col("source").alias("file_name"), F.concat("source", F.lit("/"), "doc_id").alias("primary_path"), "text", F.lit("").alias("clean_text"),
        F.when(n % 4 == 0, F.lit(50)).alias("text_quality"), F.lit(None).cast("long").alias("indexed_pages"), F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0")).alias("updated_at"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), "text", F.when((F.col("turn") % 2 == 0) & (F.col("text") != ""), F.concat(F.lit("clean "), "text")).otherwise("").alias("clean_text"), F.lit("done").alias("status"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.concat("source", F.lit("/"), "doc_id").alias("file_path"))
    return base.union(base.filter("document_id % 3 = 0").select("document_id", F.concat(F.lit("again/"), "file_path")))


#: fl: documents with their pages' texts, as views.flattened().
FLAT_SQL = f"""pt AS (SELECT conv_id AS doc_id, string_agg(text, E'\\n\\n' ORDER BY turn) AS t, string_agg(CASE WHEN turn % 2 = 0 THEN 'clean ' || text ELSE text END, E'\\n\\n' ORDER BY turn) AS u, count(*) AS n
  FROM (SELECT * FROM conversations WHERE text <> '') GROUP BY conv_id),
np AS (SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY conv_id),
whole AS (SELECT documents.doc_id, coalesce(pt.t, documents.text, '') AS text, pt.u, np.n FROM documents LEFT JOIN pt ON pt.doc_id = documents.doc_id LEFT JOIN np ON np.doc_id = documents.doc_id),
{clean_sql("whole")}, cleaned AS (SELECT whole.doc_id, coalesce(c.t, '') AS t FROM whole LEFT JOIN c ON c.doc_id = whole.doc_id), raw AS (SELECT doc_id, text AS t FROM whole), {counted_sql("cleaned")}, {counted_sql("raw")},
fl AS (SELECT whole.doc_id, whole.text, coalesce(whole.u, cleaned.t) AS clean_text, whole.n, r_cleaned.c, r_cleaned.ratio, r_raw.c AS raw_c FROM whole JOIN cleaned ON cleaned.doc_id = whole.doc_id
  JOIN r_cleaned ON r_cleaned.doc_id = whole.doc_id JOIN r_raw ON r_raw.doc_id = whole.doc_id)"""


@query("P02_flattened_documents", f"""WITH {FLAT_SQL} SELECT fl.doc_id AS document_id, md5(fl.text) AS text_md5, md5(clean_text) AS clean_md5, CASE WHEN fl.doc_id % 4 = 0 THEN 50 ELSE {QUALITY_SQL} END AS text_quality,
CAST(raw_c AS BIGINT) AS raw_word_count, CAST(c AS BIGINT) AS clean_word_count, floor(ratio * 1000 + 0.5) / 1000 AS noise_ratio, coalesce(n, 0) AS indexed_pages,
CASE WHEN fl.doc_id % 3 = 0 THEN 'again/' || source || '/' || fl.doc_id || ',' ELSE '' END || source || '/' || fl.doc_id AS paths FROM fl JOIN documents ON documents.doc_id = fl.doc_id""")
def flattened_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.flattened(documents(spark, sf_dir), pages(spark, sf_dir), paths(spark, sf_dir))
    return rows.select("document_id", F.md5("text").alias("text_md5"), F.md5("clean_text").alias("clean_md5"), "text_quality", "raw_word_count", "clean_word_count", "noise_ratio", F.coalesce("indexed_pages", F.lit(0)).alias("indexed_pages"),
                       F.array_join("paths", ",").alias("paths"))


@query("P12_document_detail", f"""WITH {FLAT_SQL}, org AS ({ORACLES['P09_organisation']}) SELECT fl.doc_id AS document_id, md5(fl.text) AS text_md5, n AS indexed_pages, primary_folder, folder_ids, review
FROM fl JOIN org ON org.doc_id = fl.doc_id WHERE fl.doc_id = 9""")
def document_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document, which is the feature: every table is filtered ahead of the joins."""
    rows = views.detail(documents(spark, sf_dir), pages(spark, sf_dir), paths(spark, sf_dir), _three(spark, sf_dir).withColumnRenamed("doc_id", "document_id"), _folders(spark), 9)
    return rows.select("document_id", F.md5("text").alias("text_md5"), "indexed_pages", "primary_folder", F.array_join("folder_ids", ",").alias("folder_ids"), "review")


@query("P01_decoded_rows", """SELECT p_partkey AS document_id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name || ',b' END AS title_tags, CASE WHEN p_partkey % 4 = 1 THEN 'Unknown' ELSE p_type END AS category,
CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS size FROM part""")
def decoded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    stored = table(spark, sf_dir, "part").select(
        n.alias("document_id"), F.when(n % 3 == 0, F.lit("[broken")).otherwise(F.to_json(F.array("p_name", F.lit("b")))).alias("title_tags_json"), F.lit(None).cast("string").alias("keyword_tags_json"),
        F.when(n % 5 != 0, F.to_json(F.struct(F.col("p_size").alias("size")))).alias("metadata_json"), F.when(n % 4 == 1, "").otherwise(F.col("p_type")).alias("category"))
    return views.with_defaults(stored).select("document_id", F.array_join("title_tags", ",").alias("title_tags"), "category", F.coalesce(F.try_element_at("metadata", F.lit("size")), F.lit("")).alias("size"))


@query("O01_document_list", """WITH d AS (SELECT doc_id AS document_id, source, '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS updated_at FROM documents),
r AS (SELECT document_id, source, updated_at, rank() OVER (ORDER BY updated_at DESC, source) AS place FROM d) SELECT updated_at, source AS file_name, min(place) AS place, count(*) AS n FROM r WHERE place <= 40 GROUP BY ALL HAVING min(place) + count(*) <= 41""")
def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the list, as one page shows them: names that are on it whole."""
    first = views.listed(documents(spark, sf_dir).select("document_id", "file_name", "updated_at")).limit(40)
    seen = first.groupBy("updated_at", "file_name").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy(F.desc("updated_at"), "file_name").rowsBetween(Window.unboundedPreceding, -1)  # forty rows at most
    whole = seen.withColumn("place", F.coalesce(F.sum("n").over(ahead), F.lit(0)) + 1)
    every = documents(spark, sf_dir).groupBy("updated_at", "file_name").agg(F.count(F.lit(1)).alias("all"))
    return whole.join(every, ["updated_at", "file_name"]).filter(F.col("n") == F.col("all")).select("updated_at", "file_name", "place", "n")


KEYWORDS_SQL = ORACLES["M07_keyword_overrides"]


@query("M09_listed_overrides", f"WITH g AS ({KEYWORDS_SQL}) SELECT folder_id, role, keyword, CAST(row_number() OVER (PARTITION BY folder_id ORDER BY role, keyword) AS INT) AS place FROM g WHERE folder_id = 'images'")
def listed_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .editing import keyword_overrides

    rows = views.folder_overrides(keyword_overrides(spark, sf_dir), "images").select("folder_id", "role", "keyword")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("folder_id").orderBy("role", "keyword")))


@query("M10_document_overrides", """WITH o AS (SELECT doc_id AS document_id, unnest(['remove', 'add']) AS action, unnest(['images', 'code-web']) AS folder_id FROM documents WHERE doc_id % 11 = 0)
SELECT document_id, action, folder_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY action, folder_id) AS INT) AS place FROM o""")
def document_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").filter("doc_id % 11 = 0").select(F.col("doc_id").alias("document_id"))
    both = ids.select("document_id", F.lit("remove").alias("action"), F.lit("images").alias("folder_id")).union(ids.select("document_id", F.lit("add"), F.lit("code-web")))
    return views.document_overrides(both).withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("action", "folder_id")))


@query("Q01_claimed_jobs", f"""WITH {JOBS_SQL}, t AS (SELECT job_id FROM j WHERE status = 'pending' AND attempts < 3 ORDER BY created_at, page_number, job_id LIMIT 25)
SELECT job_id, CASE WHEN job_id IN (SELECT job_id FROM t) THEN 'processing' ELSE status END AS status, CAST(attempts + CASE WHEN job_id IN (SELECT job_id FROM t) THEN 1 ELSE 0 END AS INT) AS attempts FROM j""")
def claimed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.claimed(jobs(spark, sf_dir), 25).select("job_id", "status", "attempts")


DONE_SQL = f"""{JOBS_SQL}, res AS (SELECT job_id, job_id % 5 <> 0 AS ok FROM j WHERE status = 'processing')"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).filter("status = 'processing'").select(
        "job_id", (F.col("job_id") % 5 != 0).alias("ok"), F.concat(F.lit("text of "), "job_id").alias("text"), F.lit("boom").alias("error"))


@query("Q02_completed_pages", f"""WITH {DONE_SQL}, old AS (SELECT DISTINCT document_id, page_number, 'old' AS text FROM j WHERE status = 'done'),
new AS (SELECT document_id, page_number, 'text of ' || max(j.job_id) AS text FROM j JOIN res ON res.job_id = j.job_id WHERE ok GROUP BY ALL)
SELECT document_id, page_number, text FROM new UNION ALL SELECT * FROM old WHERE (document_id, page_number) NOT IN (SELECT document_id, page_number FROM new)""")
def completed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several jobs of one page, which the key of the queue rules out, the last counts."""
    now = jobs(spark, sf_dir)
    old = now.filter("status = 'done'").select("document_id", "page_number", F.lit("old").alias("text"), F.lit("done").alias("status")).distinct()
    last = now.filter("status = 'processing'").join(_results(spark, sf_dir).filter("ok").select("job_id"), "job_id", "left_semi").groupBy("document_id", "page_number").agg(F.max("job_id").alias("job_id"))
    return store.completed(old, last, _results(spark, sf_dir)).select("document_id", "page_number", "text")


@query("Q02_jobs_left", f"""WITH {DONE_SQL} SELECT j.job_id, CASE WHEN ok IS NULL THEN status WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS status, attempts, CASE WHEN ok IS NULL THEN '' ELSE 'boom' END AS error
FROM j LEFT JOIN res ON res.job_id = j.job_id WHERE ok IS NULL OR NOT ok""")
def jobs_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.finished(jobs(spark, sf_dir), _results(spark, sf_dir)).select("job_id", "status", "attempts", F.coalesce("error", F.lit("")).alias("error"))


@query("M11_synced_documents", f"""WITH {FLAT_SQL}, open_jobs AS (SELECT user_id AS document_id, count(*) AS k FROM events WHERE event_type IN ('click', 'view', 'signup') GROUP BY 1)
SELECT fl.doc_id AS document_id, md5(clean_text) AS clean_md5, CAST(c AS BIGINT) AS clean_word_count, coalesce(n, 0) AS indexed_pages, CASE WHEN open_jobs.k > 0 THEN 'indexing' ELSE 'done' END AS status FROM fl LEFT JOIN open_jobs ON open_jobs.document_id = fl.doc_id""")
def synced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = refresh.synced(documents(spark, sf_dir), pages(spark, sf_dir), paths(spark, sf_dir), jobs(spark, sf_dir), stop=["for", "was"], domain=DOMAIN, common=COMMON)
    return rows.select("document_id", F.md5("clean_text").alias("clean_md5"), "clean_word_count", "indexed_pages", "status")


@query("M14_backfilled_pages", f"""WITH given AS (SELECT conv_id * 1000 + turn AS doc_id, text, turn FROM conversations), {clean_sql("given")}
SELECT given.doc_id, CASE WHEN turn % 3 = 0 THEN md5('kept') ELSE md5(coalesce(c.t, '')) END AS clean_md5 FROM given LEFT JOIN c ON c.doc_id = given.doc_id""")
def backfilled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version is today's, so only pages without a clean text are worked out again."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", F.when(F.col("turn") % 3 == 0, "kept").otherwise("").alias("clean_text"))
    due, rest = store.rebuilt(rows, "doc_id", F.col("clean_text") == "", 8, 8)
    made = quality.built(due.drop("clean_text")).select("doc_id", "clean_text")
    return made.unionByName(rest.select("doc_id", "clean_text")).select("doc_id", F.md5("clean_text").alias("clean_md5"))


@query("S16_page_texts", f"""WITH given AS (SELECT conv_id * 1000 + turn AS doc_id, turn % 3 = 0 AS has_image, CASE WHEN turn % 2 = 0 THEN '' ELSE text END AS e, 'seen: ' || text AS o FROM conversations),
g AS (SELECT doc_id, length(e) < 25 OR has_image AS needs, e, o FROM given), h AS (SELECT doc_id, needs, trim(regexp_replace(regexp_replace(concat_ws(E'\\n\\n', nullif(e, ''), CASE WHEN needs THEN o END), '[ \\t]+\\n', E'\\n', 'g'), '\\n{{3,}}', E'\\n\\n', 'g'), E' \\t\\n') AS text FROM g),
{clean_sql("h")}, cl AS (SELECT h.doc_id, coalesce(c.t, '') AS t FROM h LEFT JOIN c ON c.doc_id = h.doc_id), {counted_sql("cl")} SELECT h.doc_id, needs AS needs_recognition, md5(h.text) AS text_md5, md5(cl.t) AS clean_md5, {QUALITY_SQL} AS quality
FROM h JOIN cl ON cl.doc_id = h.doc_id JOIN r_cl ON r_cl.doc_id = h.doc_id""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + turn).alias("doc_id"), (turn % 3 == 0).alias("has_image"), F.when(turn % 2 == 0, "").otherwise(F.col("text")).alias("embedded"),
        F.concat(F.lit("seen: "), "text").alias("recognised"))
    return files.page_texts(rows).select("doc_id", "needs_recognition", F.md5("text").alias("text_md5"), F.md5("clean_text").alias("clean_md5"), "quality")


@query("S29_snapshot_documents", f"""WITH given AS (SELECT doc_id, text FROM documents), {clean_sql("given")}
SELECT 'd' || documents.doc_id AS document_id, CASE WHEN documents.doc_id % 2 = 0 THEN 'h' || documents.doc_id ELSE substr('legacy_' || lower(hex(encode(source || '//' || documents.doc_id))), 1, 55) END AS file_hash,
source || '/' || documents.doc_id AS primary_path, md5(CASE WHEN documents.doc_id % 5 = 0 THEN 'given' WHEN coalesce(c.t, '') = '' THEN '' ELSE c.t END) AS clean_md5, CASE WHEN documents.doc_id % 3 = 0 THEN '' ELSE md5(coalesce(text, '')) END AS text_md5
FROM documents LEFT JOIN c ON c.doc_id = documents.doc_id""")
def snapshot_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document written as a snapshot of its own, as an object or in the older array form, and read back."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    one = F.struct(F.concat(F.lit("d"), n).alias("documentId"), F.when(n % 2 == 0, F.concat(F.lit("h"), n)).alias("fileHash"), F.concat("source", F.lit("//"), n).alias("filePath"),
                   F.when(n % 7 != 0, F.col("text")).alias("text"), F.when(n % 7 == 0, F.col("text")).alias("ocrText"), F.when(n % 5 == 0, "given").alias("clean_text"))
    page = F.struct(F.concat(F.lit("d"), n).alias("documentId"), F.lit(1).alias("pageNumber"), F.lit("x").alias("text"))
    whole = F.to_json(F.struct(F.array(one).alias("documents"), F.array(page).alias("pages")))
    texts = docs.select(F.when(n % 3 == 0, whole).otherwise(F.to_json(F.array(one))).alias("value"))
    rows = snapshots.parsed(texts)["documents"]
    return rows.select("document_id", "file_hash", "primary_path", F.md5("clean_text").alias("clean_md5"), F.when(F.col("text").isNull(), "").otherwise(F.md5("text")).alias("text_md5"))


@query("S26_snapshot_sections", """SELECT 'documents' AS section, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM conversations
UNION ALL SELECT 'jobs', CAST(count_if(event_type IN ('click', 'view', 'error', 'signup')) AS BIGINT) FROM events UNION ALL SELECT 'tags', count(*) FROM part UNION ALL SELECT 'virtualFolders', 0 UNION ALL SELECT 'paths', 0 UNION ALL SELECT 'documentVirtualFolders', 0
UNION ALL SELECT 'folderKeywordOverrides', 0 UNION ALL SELECT 'documentFolderOverrides', 0 UNION ALL SELECT 'embeddings', (SELECT count(*) FROM embeddings) UNION ALL SELECT 'metadata', 0""")
def snapshot_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each section of a snapshot gives: one object a row of the tables."""
    def objects(name: str, key: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.to_json(F.struct(F.array(F.struct("*")).alias(key))).alias("value"))

    texts = objects("documents", "documents", table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("documentId"), "text"))
    texts = texts.union(objects("pages", "pages", table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("documentId"), F.col("turn").alias("pageNumber"), "text")))
    texts = texts.union(objects("jobs", "jobs", jobs(spark, sf_dir).select(F.col("job_id").cast("string").alias("jobId"), "status")))
    texts = texts.union(objects("tags", "tags", table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("documentId"), F.col("p_name").alias("tag"))))
    texts = texts.union(objects("embeddings", "embeddings", table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("documentId"), F.col("embedding").alias("vector"))))
    sections = snapshots.parsed(texts)
    parts = [sections[s].agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("section"), "n") for s in snapshots.SECTIONS]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("S34_benchmark_scan", """SELECT vec_id AS document_id, len(embedding) AS dimensions, md5(coalesce(string_agg(text, E'\\n' ORDER BY turn), '')) AS text_md5 FROM embeddings LEFT JOIN conversations ON conv_id = vec_id GROUP BY vec_id, embedding""")
def benchmark_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector, with the texts of their pages in order."""
    text = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.size("embedding").cast("long").alias("dimensions")).join(text, "document_id", "left")
    return rows.select("document_id", "dimensions", F.md5(F.coalesce(F.array_join(F.transform("p", lambda x: x["text"]), "\n"), F.lit(""))).alias("text_md5"))


@query("P13_display_paths", f"WITH {PLACES_SQL} SELECT folder_id, display_path FROM f")
def display_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.display_paths(places(spark, sf_dir).drop("display_path"))


@query("A05_documents_in_folders", f"WITH {THREE_SQL} SELECT DISTINCT doc_id FROM a WHERE folder_id IN ('images', 'medical', 'code-web')")
def documents_in_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = spark.createDataFrame([("images",), ("medical",), ("code-web",)], "folder_id string")
    return fo.documents_in(_three(spark, sf_dir), some)


@query("J15_joined_output", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || '|k' ELSE '' END AS keyphrases, 0 AS n_nouns FROM documents""")
def joined_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("file"), "lang")
    output = docs.filter("doc_id % 3 = 0").select("file", F.array(F.coalesce("lang", F.lit("")), F.lit("k")).alias("keyphrases"), F.lit(None).cast("array<string>").alias("nouns"))
    return enrich.with_output(docs, output).select("doc_id", F.array_join("keyphrases", "|").alias("keyphrases"), F.size("nouns").alias("n_nouns"))


@query("P08_worker_documents", """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 0 THEN source || '/' || doc_id || '.txt' WHEN doc_id % 3 = 0 THEN source ELSE CAST(doc_id AS VARCHAR) END AS file,
CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 2 = 0 THEN doc_id || '.txt' ELSE CAST(doc_id AS VARCHAR) END AS title, md5(coalesce(text, '')) AS text_md5, md5(CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END || E'\\n' || substr(coalesce(text, ''), 1, 4000)) AS embedded_md5 FROM documents""")
def worker_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model's worker takes, and what a vector is made of (the first 4000 characters, as the feature has it)."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        n.cast("string").alias("document_id"), F.when(n % 2 == 0, F.concat("source", F.lit("/"), n, F.lit(".txt"))).alias("file_path"), F.lit("").alias("primary_path"),
        F.when(n % 3 == 0, F.col("source")).otherwise("").alias("file_name"), F.lit("").alias("clean_text"), "text", F.array().cast("array<double>").alias("vector"))
    rows = enrich.for_workers(docs).drop("vector").withColumnRenamed("text", "own")
    return rows.join(docs.select(F.col("document_id").alias("id"), F.md5(enrich.embedded_text(F.col("file_name"), F.col("text"))).alias("embedded_md5")), "id").select(
        "id", "file", "title", F.md5("own").alias("text_md5"), "embedded_md5")


_LISTS = {"stop": lx.STOP, "noise": lx.OCR_NOISE, "domain": lx.DOMAIN, "common": lx.merged()}


@query("K27_lexicon_sizes", """WITH w AS (SELECT DISTINCT unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS w FROM documents),
l AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS name, unnest([{SQL_LIST(dict.fromkeys(v))}]) AS w" for k, v in _LISTS.items()) + """)
SELECT l.name, count(*) AS n, CAST(count_if(w.w IS NOT NULL) AS BIGINT) AS used FROM l LEFT JOIN w ON l.w = w.w GROUP BY l.name""")
def lexicon_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words each list has, and how many of them occur in the documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split(search_text(F.col("text")), " "))).alias("w")).distinct()
    lists = spark.createDataFrame([(k, w) for k, v in _LISTS.items() for w in dict.fromkeys(v)], "name string, w string")
    found = words.join(F.broadcast(lists.select("w").distinct()), "w", "left_semi").withColumn("there", F.lit(True))
    return lists.join(found, "w", "left").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count("there").alias("used"))


@query("T16_organisation_text", f"""WITH {SUGGESTED_SQL}, {FOLDERS_SQL.replace("f(", "ff(", 1)}, x AS (SELECT doc_id, document_type, subject, unnest(string_split(folder_ids, ',')) AS folder_id, unnest(range(len(string_split(folder_ids, ',')))) AS place FROM sg)
SELECT doc_id, document_type || ' ' || subject || ' ' || string_agg(display_path, ' ' ORDER BY place) AS folders FROM x JOIN ff ON ff.folder_id = x.folder_id GROUP BY doc_id, document_type, subject""")
def organisation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organise.search_text(organise.suggested(library(spark, sf_dir), overrides=edits(spark)), all_folders(spark))


@query("K36_normalised_overrides", """SELECT p_partkey AS at, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS folder_id, p_name AS keyword, CASE WHEN p_partkey % 5 = 0 THEN 'negative' ELSE 'positive' END AS role FROM part WHERE p_partkey % 3 <> 0""")
def normalised_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with either kind of names, and maps of folders to lists; unknown roles go."""
    n = F.col("p_partkey")
    item = F.struct(F.when(n % 4 == 0, "a").alias("folderId"), F.when(n % 4 == 2, "a").alias("folder_id"), F.concat(F.lit("#"), "p_name").alias("keyword"),
                    F.when(n % 3 == 0, "other").when(n % 5 == 0, "negative").alias("role"), n.cast("double").alias("weight"))
    text = F.when(n % 2 == 0, F.to_json(F.array(item))).otherwise(F.to_json(F.create_map(F.lit("b"), F.array(item))))
    rows = fo.normalised_overrides(table(spark, sf_dir, "part").select(text.alias("value")))
    return rows.select(F.col("weight").cast("long").alias("at"), "folder_id", "keyword", "role")


@query("P07_built_documents", f"""WITH t7 AS ({ORACLES['T07_title_lines']}), t4 AS ({ORACLES['T04_keyword_tags']}), t10 AS ({ORACLES['T10_category']}),
a AS (SELECT doc_id, title, min(score * -1000 + line_no / 1e9) AS o FROM t7 GROUP BY doc_id, title), b AS (SELECT doc_id, string_agg(title, '|' ORDER BY o) AS t FROM a GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(tag, '|' ORDER BY rank) AS k FROM t4 GROUP BY doc_id)
SELECT t10.doc_id, coalesce(t, '') AS title_tags, coalesce(k, '') AS keyword_tags, category, 'done' AS status FROM t10 LEFT JOIN b ON b.doc_id = t10.doc_id LEFT JOIN k ON k.doc_id = t10.doc_id""")
def built_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file's text becomes: tags, category, status."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("clean_text"), F.when(F.col("doc_id") % 3 == 0, "done").alias("status"))
    rows = refresh.built(docs, CATEGORY_RULES, stop=["for", "was"], domain=DOMAIN, common=COMMON)
    return rows.select("doc_id", F.array_join("title_tags", "|").alias("title_tags"), F.array_join("keyword_tags", "|").alias("keyword_tags"), "category", "status")


@query("M02_upserted_pages", """WITH o AS (SELECT conv_id AS document_id, turn AS page_number, md5(text) AS text_md5 FROM conversations WHERE turn % 2 = 0), n AS (SELECT conv_id AS document_id, turn AS page_number, md5('new ' || text) AS text_md5 FROM conversations WHERE turn % 3 = 0)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE page_number % 3 <> 0""")
def upserted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), "text")
    new = rows.filter("page_number % 3 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    both = store.upserted(rows.filter("page_number % 2 = 0"), new, ["document_id", "page_number"])
    return both.select("document_id", "page_number", F.md5("text").alias("text_md5"))


@query("P16_organised_documents", f"""WITH {SUGGESTED_SQL} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'images' ELSE primary_folder END AS primary_folder, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE floor(conf * 100 + 0.5) / 100 END AS confidence FROM sg""")
def organised_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The organisation that is stored, or else a computed one."""
    docs = library(spark, sf_dir)
    stored = docs.filter("doc_id % 2 = 0").select("doc_id", F.lit("images").alias("primary_folder"), F.lit(1.0).alias("confidence"))
    computed = organise.suggested(docs, overrides=edits(spark)).select("doc_id", "primary_folder", "confidence")
    return views.organised(stored, computed)


@query("V07_combined_keywords", f"""WITH a AS (SELECT doc_id, {PHRASE_WORDS} AS w FROM documents), b AS (SELECT doc_id, {PLAIN_PHRASES.format("w[1:12] || w[5:]")} AS p FROM a)
SELECT doc_id, array_to_string((list_filter(p, lambda x, i: list_position(p, x) = i))[1:24], '|') AS keywords FROM b""")
def combined_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve words stand for a model's key phrases, all from the fifth on for its noun phrases; 24 stay, as the feature has it."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    return docs.select("doc_id", F.array_join(models.combined(F.slice("w", 1, 12), F.slice("w", F.lit(5), F.greatest(F.size("w"), F.lit(1)))), "|").alias("keywords"))


@query("T20_taken_in", """SELECT source || '/' || doc_id AS file_path, 'doc_' || substr(sha256(coalesce(text, '')), 1, 24) AS document_id, sha256(coalesce(text, '')) AS file_hash FROM documents""")
def taken_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of a stored library after every document came as a file: half of them at first, then all, then some again."""
    n = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    files_ = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), n).alias("file_path"), F.sha2(text, 256).alias("file_hash"), text.alias("text"), F.timestamp_seconds(n).alias("at"))
    path = f"{versions.shared(spark)}/library-{uuid.uuid4().hex}"
    for some in (files_.filter(n % 2 == 0), files_, files_.filter(n % 3 == 0)):
        own = ingest.taken_in(path, some.drop("doc_id"))
    docs = own.table("documents").select("document_id", "file_hash")
    return own.table("document_paths").join(docs, "document_id").select("file_path", "document_id", "file_hash")


@query("M01_changed_tables", """SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn AS INT) AS page_number, md5(CASE WHEN turn % 2 = 0 THEN 'new ' || text ELSE text END) AS text_md5 FROM conversations WHERE turn % 3 <> 1
UNION ALL SELECT CAST(conv_id AS VARCHAR), CAST(1000 + turn AS INT), md5(text) FROM conversations WHERE turn % 5 = 0""")
def changed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in a table with a change log: all turns, then some replaced, some deleted and some added, the log part merged."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("page_number"), "text")
    n = F.col("page_number")
    own = lib.opened(spark, f"{versions.shared(spark)}/library-{uuid.uuid4().hex}").changed({"pages": (turns, None)})
    own = own.changed({"pages": (turns.filter(n % 2 == 0).withColumn("text", F.concat(F.lit("new "), "text")), None)}).compacted()
    own = own.changed({"pages": (turns.filter(n % 5 == 0).withColumn("page_number", n + 1000), turns.filter(n % 3 == 1))})
    return own.table("pages").select("document_id", "page_number", F.md5("text").alias("text_md5"))
