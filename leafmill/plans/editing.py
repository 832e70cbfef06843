"""Queries on labels, phrases, tags, folder changes and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, labels
from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import enrich, evaluation, search, store, vectors
from ..operators import folders as fo
from ..operators import rules as R
from .documents import SQL_LIST, table
from .organising import JOBS_SQL, PLACES_SQL, jobs, places
from .registry import query


def md5_of(x):
    return F.md5(F.array_join(x, "|"))


@query("P03_summaries", "SELECT doc_id, md5(substr(coalesce(text, ''), 1, 320)) AS preview_md5, coalesce(text, '') <> '' AS has_text FROM documents")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.md5(labels.preview(F.lit(""), F.col("text"))).alias("preview_md5"), (F.coalesce("text", F.lit("")) != "").alias("has_text"))


EXT_SQL = "(['.pdf', '.PNG', '.docx', '.py', '.md', ''])[CAST(page_id % 6 AS INT) + 1]"


@query("P10_labels", f"""WITH a AS (SELECT page_id, url || {EXT_SQL} AS p, page_id % 101 AS q, CASE WHEN page_id % 13 = 0 THEN 'indexing' ELSE 'done' END AS s, (page_id % 100) / 100 AS c, page_id % 17 = 0 AS r FROM pages)
SELECT page_id, CASE WHEN ends_with(lower(p), '.pdf') THEN 'pdf' WHEN ends_with(lower(p), '.png') THEN 'image' WHEN ends_with(lower(p), '.docx') THEN 'office' WHEN ends_with(lower(p), '.py') OR ends_with(lower(p), '.html') THEN 'code' ELSE 'text' END AS kind,
CASE WHEN s = 'indexing' THEN 'partial' WHEN q >= 85 THEN 'good' WHEN q >= 65 THEN 'review' ELSE 'low-ocr' END AS quality_class,
CASE WHEN r OR c < 0.55 THEN 'Needs review' WHEN c >= 0.8 THEN 'High confidence' ELSE 'Medium confidence' END AS confidence_label, CAST(floor(c * 100 + 0.5) AS INT) AS percent,
CASE WHEN len(string_split(p, '/')) <= 4 THEN p ELSE string_split(p, '/')[1] || '/.../' || array_to_string(string_split(p, '/')[-3:], '/') END AS short_path FROM a""")
def derived_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    exts, n = F.array(*map(F.lit, (".pdf", ".PNG", ".docx", ".py", ".md", ""))), F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.get(exts, (n % 6).cast("int"))).alias("p"), (n % 101).alias("q"),
                                                F.when(n % 13 == 0, "indexing").otherwise("done").alias("s"), ((n % 100) / 100).alias("c"), (n % 17 == 0).alias("r"))
    return rows.select("page_id", labels.kind(F.col("p")).alias("kind"), labels.css_class(labels.quality_label(F.col("q"), F.col("s"))).alias("quality_class"),
                       labels.confidence_label(F.col("c"), F.col("r")).alias("confidence_label"), labels.percent(F.col("c")).alias("percent"), labels.short_path(F.col("p")).alias("short_path"))


@query("K01_text_forms", r"""WITH a AS (SELECT p_partkey, '  [' || p_name || '_/-' || p_type || '#C++ 1.5<x>]; ' AS t FROM part)
SELECT p_partkey, trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) AS search_form, regexp_replace(lower(t), '[^a-z0-9]+', '', 'g') AS compact_form,
trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '[#/\\_-]+', ' ', 'g'), '[^a-z0-9.<>\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS rule_form,
trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '[#/\\_-]+', ' ', 'g'), '[^a-z0-9.+\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS tag_form,
regexp_replace(trim(regexp_replace(lower(t), '\s+', ' ', 'g')), '^[\s\-_:;,.()\[\]{}]+|[\s\-_:;,.()\[\]{}]+$', '', 'g') AS phrase_form FROM a""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  ["), "p_name", F.lit("_/-"), "p_type", F.lit("#C++ 1.5<x>]; ")).alias("t"))
    return rows.select("p_partkey", tx.search_text(t).alias("search_form"), tx.compact_text(t).alias("compact_form"), tx.rule_text(t).alias("rule_form"),
                       labels.tag_form(t).alias("tag_form"), labels.phrase_form(t).alias("phrase_form"))


@query("K03_search_tokens", f"""WITH a AS (SELECT p_partkey, list_filter(string_split(trim(regexp_replace(lower(replace(p_brand, '#', '') || ' of the 00' || p_size || ' ' || p_name || ' ' || p_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM part),
b AS (SELECT p_partkey, flatten(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^[a-z]+[0-9]+$') THEN [x, regexp_extract(x, '^[a-z]+'), regexp_extract(x, '[0-9]+$')] ELSE [x] END)) AS w FROM a),
c AS (SELECT p_partkey, list_filter(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN regexp_replace(x, '^0+(.)', '\\1') ELSE x END), lambda x: x NOT IN ({SQL_LIST(search.STOP)})) AS w FROM b)
SELECT p_partkey, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS tokens FROM c""")
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" of the 00"), "p_size", F.lit(" "), "p_name", F.lit(" "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(search.tokens(text), " ").alias("tokens"))


@query("K19_slugs_and_paths", r"""SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), ''), 'folder') AS slug,
string_split(url, '/')[-1] AS base_name, regexp_extract(lower(url), '\.[^.]+$') AS extension FROM pages""")
def slugs_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", identity.slug(url).alias("slug"), identity.base_name(url).alias("base_name"), identity.extension(url).alias("extension"))


@query("K30_dates", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%d %b %Y, %H:%M') AS shown, epoch_us(ts) // 1000 AS sort_key FROM events""")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format(ts, "dd MMM yyyy, HH:mm").alias("shown"),
                                                 F.unix_millis(ts.cast("timestamp")).alias("sort_key"))


@query("K31_json_values", "SELECT event_id, coalesce(CAST(json_extract(CASE WHEN event_id % 10 = 0 THEN NULL ELSE props END, '$.k') AS BIGINT), -1) AS k FROM events")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json(broken, "k bigint")["k"], F.lit(-1)).alias("k"))


@query("K33_stored_vectors", """SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1e6 + 0.5) AS BIGINT)), ',') AS millionths, TRUE AS valid FROM embeddings""")
def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = vectors.stored_form(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.array_join(F.transform(form, lambda x: F.floor(x * 1e6 + 0.5).cast("string")), ",").alias("millionths"), form.isNotNull().alias("valid"))


#: A document's different words as phrases and tags; without repeats, phrases come out the same.
PHRASES_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')"
CLEAN_SQL = r"list_filter(list_transform({}, lambda x: regexp_replace(lower(x), '^[\-_:;,.()\[\]{{}}]+|[\-_:;,.()\[\]{{}}]+$', '', 'g')), lambda x: x <> '')"
FIRST_SQL = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _phrases() -> Column:
    return F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")


@query("U06_phrases_apart", f"""WITH a AS (SELECT doc_id, {CLEAN_SQL.format(PHRASES_SQL)} AS p FROM documents), b AS (SELECT doc_id, {FIRST_SQL.format("p")} AS p FROM a)
SELECT doc_id, md5(array_to_string(list_reduce(list_transform(p, lambda x: [x]), lambda a, x: CASE WHEN len(a) >= 20 OR len(list_filter(a, lambda y: contains(y, x[1]) OR contains(x[1], y))) > 0 THEN a ELSE list_concat(a, x) END, CAST([] AS VARCHAR[])), '|')) AS phrases_md5 FROM b""")
def phrases_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the whole text of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", md5_of(enrich.apart(_phrases(), 20)).alias("phrases_md5"))


@query("T19_enriched_tags", f"""WITH a AS (SELECT doc_id, list_filter([source, lang, source], lambda x: x <> '') AS t, list_filter([lang, 'x'], lambda x: x <> '') AS k, {CLEAN_SQL.format(PHRASES_SQL)} AS p, {CLEAN_SQL.format("(" + PHRASES_SQL + ")[20:]")} AS n FROM documents),
b AS (SELECT doc_id, t, k, ({FIRST_SQL.format("p")})[1:20] AS p, ({FIRST_SQL.format("n")})[1:16] AS n FROM a), c AS (SELECT doc_id, t || p[1:4] AS t, p || k || n[1:6] AS k FROM b)
SELECT doc_id, md5(array_to_string(({FIRST_SQL.format("t")})[1:14], '|')) AS titles_md5, md5(array_to_string(({FIRST_SQL.format("k")})[1:32], '|')) AS keywords_md5 FROM c""")
def enriched_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the whole text of every document; the words from the 20th on stand for noun phrases."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", _phrases().alias("_w"))
    later = F.slice("_w", 20, F.greatest(F.size("_w"), F.lit(1)))
    titles, keywords = enrich.with_enrichment(F.array("source", "lang", "source"), F.array("lang", F.lit("x")), F.col("_w"), later)
    return docs.select("doc_id", md5_of(titles).alias("titles_md5"), md5_of(keywords).alias("keywords_md5"))


@query("U05_tag_edits", r"""WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS t, lower(p_type) AS n FROM part),
b AS (SELECT p_partkey, CASE WHEN list_contains(t, n) THEN t ELSE t || [n] END AS t FROM a)
SELECT p_partkey, array_to_string(t, ',') AS added, array_to_string(list_filter(t, lambda x: x <> 'small'), ',') AS removed FROM b""")
def tag_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = enrich.tag_added(F.split("p_name", " "), F.concat(F.lit("#"), "p_type", F.lit("!")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(added, ",").alias("added"), F.array_join(enrich.tag_removed(added, F.lit("/Small")), ",").alias("removed"))


TOPICS = "bolt gear plate ring widget small".split()


@query("T08_generated_titles", f"""WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN ['bcs303'] ELSE CAST([] AS VARCHAR[]) END || string_split(p_name, ' ') || CASE WHEN p_partkey % 8 = 0 THEN ['question', 'paper'] WHEN p_partkey % 12 = 4 THEN ['assignment'] WHEN p_partkey % 5 = 0 THEN ['turing', 'machine'] ELSE CAST([] AS VARCHAR[]) END AS w FROM part),
b AS (SELECT p_partkey, w, list_filter(w, lambda x: x IN ({SQL_LIST(TOPICS)})) AS t FROM a),
c AS (SELECT p_partkey, CASE WHEN w[1] = 'bcs303' THEN ['BCS303'] || CASE WHEN list_contains(w, 'paper') THEN ['question', 'paper'] WHEN list_contains(w, 'assignment') THEN ['assignment'] WHEN len(t) > 0 THEN t[1:2] ELSE ['notes'] END
  WHEN list_contains(w, 'turing') THEN ['turing', 'machine', 'notes'] WHEN len(t) >= 2 THEN t[1:3] || ['notes'] ELSE CAST([] AS VARCHAR[]) END AS p FROM b)
SELECT p_partkey, array_to_string(list_transform(p, lambda x: upper(x[1]) || x[2:]), ' ') AS title FROM c""")
def generated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, none = F.col("p_partkey"), F.array().cast("array<string>")
    words = lambda *x: F.array(*map(F.lit, x))
    more = F.when(n % 8 == 0, words("question", "paper")).when(n % 12 == 4, words("assignment")).when(n % 5 == 0, words("turing", "machine")).otherwise(none)
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(n % 4 == 0, words("bcs303")).otherwise(none), F.split("p_name", " "), more).alias("_w"))
    return parts.select("p_partkey", enrich.generated_title(F.col("_w"), TOPICS).alias("title"))


KNOWN = ["reth", "thing", "oren", "eran"]


@query("T21_keyphrases", f"""WITH a AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) BETWEEN 3 AND 24 AND w <> 'was' AND NOT regexp_matches(w, '[0-9]')
  AND (w IN ({SQL_LIST(KNOWN)}) OR (length(replace(w, '-', '')) BETWEEN 4 AND 18 AND regexp_matches(w, '[aeiou]') AND NOT regexp_matches(replace(w, '-', ''), '[bcdfghjklmnpqrstvwxyz]{{5,}}') AND NOT regexp_matches(replace(w, '-', ''), '[aeiou]{{4,}}')))) AS w FROM documents),
g AS (SELECT doc_id, list_filter([array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)], lambda x: len(list_filter(string_split(x, ' '), lambda y: y IN ({SQL_LIST(KNOWN)}))) > 0)
  || list_filter([array_to_string(w[i:i+1], ' ') for i in range(1, len(w))], lambda x: len(list_filter(string_split(x, ' '), lambda y: y IN ({SQL_LIST(KNOWN)}))) > 0) || w AS c FROM a),
e AS (SELECT doc_id, unnest(c) AS p, unnest(range(len(c))) AS i FROM g), s AS (SELECT doc_id, p, count(*) AS n, min(i) AS first, len(string_split(p, ' ')) AS k, len(list_filter(string_split(p, ' '), lambda y: y IN ({SQL_LIST(KNOWN)}))) AS d FROM e WHERE length(p) <= 60 GROUP BY doc_id, p),
o AS (SELECT doc_id, list(p ORDER BY n * CASE WHEN k > 1 THEN k * 3 ELSE 1 END + 2 / (1 + first / 80) + 2 * d DESC, first, p) AS p FROM s GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce(list_transform(p, lambda x: [x]), lambda a, x: CASE WHEN len(a) >= 20 OR len(list_filter(a, lambda y: contains(y, x[1]) OR contains(x[1], y))) > 0 THEN a ELSE list_concat(a, x) END, CAST([] AS VARCHAR[])) AS p FROM o)
SELECT b.doc_id, coalesce(array_to_string(p, '|'), '') AS keyphrases FROM documents b LEFT JOIN f ON b.doc_id = f.doc_id""")
def keyphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the whole text of every document."""
    found = enrich.keyphrases(table(spark, sf_dir, "documents").select("doc_id", "text"), stop=["was"], noise=[], domain=KNOWN, common=[])
    return found.select("doc_id", F.array_join("keyphrases", "|").alias("keyphrases"))


@query("F11_due_for_enrichment", """WITH e AS (SELECT doc_id, doc_id % 3 <> 0 AS same_words, doc_id % 5 <> 0 AS same_vector, doc_id % 7 <> 0 AS has_vector FROM documents WHERE doc_id % 11 <> 0)
SELECT d.doc_id FROM documents d LEFT JOIN e ON d.doc_id = e.doc_id WHERE trim(coalesce(d.text, '')) <> '' AND NOT coalesce(same_words AND same_vector AND has_vector, FALSE)""")
def due_for_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id")
    mark = identity.fingerprint(F.col("text"))
    known = docs.filter("doc_id % 11 <> 0").select("doc_id", F.when(n % 3 != 0, mark).otherwise("old").alias("keyword_fingerprint"),
                                                   F.when(n % 5 != 0, mark).alias("vector_fingerprint"), (n % 7 != 0).alias("has_vector"))
    return enrich.due(docs, known)


@query("F09_usable_vectors", """WITH v AS (SELECT vec_id, vec_id % 4 <> 0 AND vec_id % 6 <> 1 AS fresh, len(embedding) AS n FROM embeddings)
SELECT vec_id, CASE WHEN fresh THEN n ELSE 0 END AS n, (SELECT min(fresh) FROM v) AS all_fresh FROM v""")
def usable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(n.alias("doc_id"), F.when(n % 4 != 0, F.col("embedding")).alias("vector"),
                                                     F.when(n % 6 == 1, "old").when(n % 6 == 2, "").when(n % 6 == 3, "now").alias("made_of"), F.lit("now").alias("fingerprint"))
    return enrich.usable_vectors(rows).select(F.col("doc_id").alias("vec_id"), F.when(F.col("vector").isNull(), 0).otherwise(F.size("vector")).cast("long").alias("n"), "all_fresh")


TREE = R.flat_folders()
FOLDERS_SQL = "f(folder_id, name, parent_id, display_path, sort_order) AS (VALUES " + ", ".join(
    f"('{i}', '{n}', {chr(39) + p + chr(39) if p else 'NULL'}, '{d}', {o})" for i, n, p, d, o in TREE) + ")"


def _folders(spark: SparkSession) -> DataFrame:
    base = spark.createDataFrame(TREE, "folder_id string, name string, parent_id string, display_path string, sort_order int")
    return base.withColumns({"source": F.lit("system"), "deleted_at": F.lit(None).cast("timestamp")})


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three folders a document."""
    n, names = F.col("doc_id"), F.array(*(F.lit(x[0]) for x in TREE))
    place = lambda k: F.get(names, ((n * k + 1) % len(TREE)).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.array(place(3), place(7), place(11)))).alias("folder_id"))
    return rows.withColumns({"confidence": ((n * 13) % 50 + F.length("folder_id")) / 100, "is_primary": (n % 2 == 0) & (F.col("folder_id") == place(7))})


N = len(TREE)
THREE_SQL = f"""{FOLDERS_SQL}, p AS (SELECT doc_id, [(doc_id * 3 + 1) % {N}, (doc_id * 7 + 1) % {N}, (doc_id * 11 + 1) % {N}] AS k FROM documents),
q AS (SELECT DISTINCT doc_id, k[2] AS prime, unnest(k) AS o FROM p), a AS (SELECT doc_id, f.folder_id, f.display_path, f.sort_order, ((doc_id * 13) % 50 + length(f.folder_id)) / 100 AS confidence, doc_id % 2 = 0 AND o = prime AS is_primary FROM q JOIN f ON f.sort_order = q.o)"""


@query("P09_organisation", f"""WITH {THREE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY is_primary DESC, confidence DESC, sort_order, display_path) AS k FROM a),
p1 AS (SELECT r.*, f.parent_id FROM r JOIN f ON r.folder_id = f.folder_id WHERE k = 1)
SELECT p1.doc_id, p1.folder_id AS primary_folder, p1.display_path AS primary_path, floor(p1.confidence * 100 + 0.5) / 100 AS confidence, count_if(r.folder_id = 'review-needed') > 0 AS review,
string_agg(r.folder_id, ',' ORDER BY r.k) AS folder_ids, coalesce(string_agg(CASE WHEN r.k > 1 AND r.folder_id <> 'review-needed' AND r.folder_id IS DISTINCT FROM p1.parent_id THEN r.folder_id END, ',' ORDER BY r.k), '') AS secondary_folders
FROM p1 JOIN r ON p1.doc_id = r.doc_id GROUP BY ALL""")
def organisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fo.organisation(_three(spark, sf_dir), _folders(spark))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("secondary_folders", "folder_ids")})


@query("M05_saved_folders", f"""WITH {PLACES_SQL} SELECT folder_id, display_path, sort_order, 'system' AS source FROM f
UNION ALL SELECT 'user-my-web-things-1', display_path || ' / My Web: things', CAST((SELECT max(sort_order) + 1 FROM f) AS INT), 'user' FROM f WHERE folder_id = 'n3'""")
def saved_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = places(spark, sf_dir).withColumns({"source": F.lit("system"), "deleted_at": F.lit(None).cast("timestamp")})
    return fo.saved(tree, " My Web: things ", "n3", stamp="1").select("folder_id", "display_path", "sort_order", "source")


@query("M06_deleted_subtree", f"""WITH {THREE_SQL} SELECT folder_id, count(*) AS n FROM a WHERE folder_id NOT IN ('notes-books') AND NOT starts_with(folder_id, 'notes-') GROUP BY folder_id""")
def deleted_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments a folder that are left once notes and all below them are deleted."""
    tree = fo.saved(_folders(spark), "Mine", "notes-books", stamp="1")
    left = fo.active(fo.deleted(tree, "notes-books", "2024-01-01"))
    kept = fo.without_subtree(_three(spark, sf_dir), tree, "notes-books")
    return kept.join(left.select("folder_id"), "folder_id").groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"))


@query("M07_keyword_overrides", f"""WITH {FOLDERS_SQL}, g AS (SELECT p_partkey AS i, (['images', 'medical', 'nowhere'])[CAST(p_partkey % 3 AS INT) + 1] AS folder_id, trim(regexp_replace(lower(p_name), '[^a-z]+', ' ', 'g')) AS keyword,
CASE p_partkey % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'ignored' ELSE 'positive' END AS role, greatest(0.5, least(3.0, coalesce(nullif(CAST(p_size AS DOUBLE) / 10, 0), 1))) AS weight FROM part)
SELECT folder_id, keyword, arg_max(role, i) AS role, arg_max(weight, i) AS weight FROM g WHERE folder_id IN (SELECT folder_id FROM f) GROUP BY folder_id, keyword""")
def keyword_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    given = table(spark, sf_dir, "part").select(
        n.alias("at"), F.get(F.array(*map(F.lit, ("images", "medical", "nowhere"))), (n % 3).cast("int")).alias("folder_id"), F.concat(F.lit("#"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("keyword"),
        F.when(n % 4 == 0, "negative").when(n % 4 == 1, "ignored").when(n % 4 == 2, "other").alias("role"), (F.col("p_size") / 10).alias("weight"))
    return fo.keyword_overrides(given, _folders(spark))


@query("F03_touched_documents", f"""WITH {THREE_SQL} SELECT doc_id FROM documents WHERE contains(lower(text), 'thing') OR contains(lower(source), 'thing') UNION SELECT doc_id FROM a WHERE folder_id = 'images'""")
def touched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.touched(table(spark, sf_dir, "documents"), _three(spark, sf_dir), "images", "Thing", ["text", "source"])


GOLD = ["ring", "the", "red", "und", "que", "zzz"]


@query("A15_tag_precision", f"""WITH a AS (SELECT doc_id, list_filter({[*GOLD]}, lambda t: contains(lower(text), t)) AS e, [source, lang] AS tags FROM documents),
b AS (SELECT doc_id, len(e) AS n, len(list_filter(e, lambda t: len(list_filter(tags, lambda g: contains(g, t) OR contains(t, g))) > 0)) AS h FROM a)
SELECT count(*) AS n_docs, floor(avg(CASE WHEN n > 0 THEN h / 2 END) * 1e6 + 0.5) / 1e6 AS precision, floor(avg(CASE WHEN n > 0 THEN h / n END) * 1e6 + 0.5) / 1e6 AS recall FROM b""")
def tag_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, r = evaluation.precision_recall(F.array("source", "lang"), evaluation.expected_terms(F.col("text"), GOLD))
    each = table(spark, sf_dir, "documents").select(p.alias("p"), r.alias("r"))
    fine = lambda x: F.floor(x * 1e6 + 0.5) / 1e6
    return each.agg(F.count(F.lit(1)).alias("n_docs"), fine(F.avg("p")).alias("precision"), fine(F.avg("r")).alias("recall"))


@query("A16_search_accuracy", """WITH r AS (SELECT label AS query_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings),
q AS (SELECT query_id, max(CASE WHEN rank = 1 THEN vec_id % 2 = 0 ELSE FALSE END) AS top1, max(vec_id % 2 = 0) AS top3 FROM r WHERE rank <= 3 GROUP BY query_id)
SELECT floor(avg(CAST(top1 AS INT)) * 1000 + 0.5) / 1000 AS top1_accuracy, floor(avg(CAST(top3 AS INT)) * 1000 + 0.5) / 1000 AS top3_accuracy FROM q""")
def search_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc(F.get("embedding", 0)), "vec_id")
    ranked = table(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), "vec_id", "embedding").withColumn("rank", F.row_number().over(order))
    return evaluation.accuracy(evaluation.top_hits(ranked, F.col("vec_id") % 2 == 0))


@query("M03_upserted_jobs", f"""WITH {JOBS_SQL}, o AS (SELECT document_id, page_number, max(job_id) AS job_id, arg_max(status, job_id) AS status, arg_max(attempts, job_id) AS attempts FROM j WHERE job_id % 2 = 0 GROUP BY ALL),
n AS (SELECT document_id, page_number, max(job_id) AS job_id, arg_max(status, job_id) AS status, arg_max(attempts, job_id) AS attempts FROM j WHERE job_id % 2 = 1 GROUP BY ALL), m AS (SELECT * FROM n WHERE status <> 'done')
SELECT coalesce(m.document_id, o.document_id) AS document_id, coalesce(m.page_number, o.page_number) AS page_number, coalesce(m.job_id, o.job_id) AS job_id,
CASE WHEN o.status = 'done' THEN 'done' ELSE coalesce(m.status, o.status) END AS status, coalesce(m.attempts, o.attempts) AS attempts FROM o FULL OUTER JOIN m ON o.document_id = m.document_id AND o.page_number = m.page_number""")
def upserted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = jobs(spark, sf_dir)
    side = lambda k: store.latest(now.filter(F.col("job_id") % 2 == k), ["document_id", "page_number"], [F.desc("job_id")])
    return store.upserted_jobs(side(0), side(1)).select("document_id", "page_number", "job_id", "status", "attempts")


@query("J02_known_files", """WITH d AS (SELECT doc_id, sha256(text) AS h, source || '/' || doc_id AS p FROM documents WHERE doc_id % 2 = 0),
g AS (SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE text END) AS h, source || '/' || doc_id AS p FROM documents),
a AS (SELECT h, min(doc_id) AS i FROM d GROUP BY h), b AS (SELECT p, min(doc_id) AS i FROM d GROUP BY p)
SELECT g.p AS file_path, coalesce(a.i, b.i, -1) AS document_id FROM g LEFT JOIN a ON g.h = a.h LEFT JOIN b ON g.p = b.p""")
def known_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.concat("source", F.lit("/"), "doc_id").alias("file_path")
    old = docs.filter("doc_id % 2 = 0").select(n.alias("document_id"), F.sha2("text", 256).alias("file_hash"), path)
    found = docs.select(F.sha2(F.when(n % 3 == 0, "new").otherwise(F.col("text")), 256).alias("file_hash"), path)
    return store.known_by(old.select("document_id", "file_hash"), old.select("document_id", "file_path"), found).select("file_path", F.coalesce("document_id", F.lit(-1)).alias("document_id"))


@query("J14_inserted_if_absent", "SELECT doc_id, 'old' AS kind FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0")
def inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id")
    return store.inserted_if_absent(ids.filter("doc_id % 3 = 0").withColumn("kind", F.lit("old")), ids.filter("doc_id % 2 = 0").withColumn("kind", F.lit("new")), ["doc_id"])


@query("F07_faceted_filter", "SELECT page_id FROM pages WHERE contains(url, '/en/') AND page_id % 101 BETWEEN 65 AND 84 AND page_id % 13 <> 0")
def faceted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    label = labels.quality_label(n % 101, F.when(n % 13 == 0, "indexing").otherwise("done"))
    return table(spark, sf_dir, "pages").filter(F.array_contains(F.split("url", "/"), "en") & (label == "Review")).select("page_id")


@query("O06_most_recent", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 30")
def most_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(30)


@query("A08_queue_total", f"WITH {JOBS_SQL} SELECT count(*) AS total, CAST(count_if(status = 'pending') AS BIGINT) AS pending FROM j")
def queue_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = jobs(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("status") == "pending", F.col("n"))), F.lit(0)).alias("pending"))


@query("A17_folder_histogram", f"WITH {THREE_SQL}, r AS (SELECT doc_id, arg_max(folder_id, (is_primary, confidence, -sort_order)) AS folder_id FROM a GROUP BY doc_id) SELECT folder_id, count(*) AS n FROM r GROUP BY folder_id")
def folder_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary folder is one reduction: no array of a document's rows."""
    rows = _three(spark, sf_dir).join(_folders(spark).select("folder_id", "sort_order"), "folder_id")
    first = rows.groupBy("doc_id").agg(F.max_by("folder_id", F.struct("is_primary", "confidence", -F.col("sort_order"))).alias("folder_id"))
    return first.groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"))
