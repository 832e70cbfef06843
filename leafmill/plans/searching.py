"""Queries on lexical, vector and hybrid search, and on how good their rankings are."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity
from ..operators import indexing, search, vectors, views
from ..sources import versions
from .documents import table
from .registry import ORACLES, query

NORM_SQL = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
ASKED = "thing eran"


@query("A09_token_idf", f"""WITH d AS (SELECT {NORM_SQL} AS t FROM documents), s AS (SELECT count(*) AS n, sum(CASE WHEN contains(t, 'thing') THEN 1 ELSE 0 END) AS a, sum(CASE WHEN contains(t, 'eran') THEN 1 ELSE 0 END) AS b FROM d)
SELECT 'thing' AS token, CAST(a AS BIGINT) AS df, floor((1 + ln((n + 1) / (a + 1))) * 1e6 + 0.5) / 1e6 AS idf FROM s UNION ALL SELECT 'eran', CAST(b AS BIGINT), floor((1 + ln((n + 1) / (b + 1))) * 1e6 + 0.5) / 1e6 FROM s""")
def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.idf(table(spark, sf_dir, "documents"), ASKED).withColumn("idf", F.floor(F.col("idf") * 1e6 + 0.5) / 1e6)


BM25_SQL = f"""d AS (SELECT doc_id, list_filter(string_split({NORM_SQL}, ' '), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'thing')) AS a, len(list_filter(w, lambda x: x = 'eran')) AS b FROM d),
s AS (SELECT count(*) AS docs, avg(n) AS av, sum(CASE WHEN a > 0 THEN 1 ELSE 0 END) AS da, sum(CASE WHEN b > 0 THEN 1 ELSE 0 END) AS db FROM c),
h AS (SELECT doc_id, ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / av)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / av)) AS score
  FROM c CROSS JOIN s WHERE a > 0 AND b > 0)"""


@query("X05_bm25_top100", f"WITH {BM25_SQL} SELECT doc_id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM h ORDER BY h.score DESC, doc_id LIMIT 100")
def bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), ASKED).withColumn("score", F.floor(F.col("score") * 1e6 + 0.5) / 1e6)


@query("X04_match_all", f"WITH d AS (SELECT doc_id, string_split({NORM_SQL}, ' ') AS w FROM documents) SELECT doc_id FROM d WHERE list_contains(w, 'thing') AND list_contains(w, 'eran')")
def match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.split(search.search_text(F.col("text")), " ").alias("_w"))
    return words.filter(F.array_contains("_w", "thing") & F.array_contains("_w", "eran")).select("doc_id")


@query("X07_postings", f"""WITH d AS (SELECT doc_id, list_filter(string_split({NORM_SQL}, ' '), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, len(w) AS doc_len, unnest(w) AS token FROM d) SELECT token, doc_id, CAST(doc_len AS INT) AS doc_len, count(*) AS tf FROM e GROUP BY ALL""")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of every document."""
    return search.postings(table(spark, sf_dir, "documents"))


#: The eight fields of a document, made of the table's columns.
FIELD_SQL = {
    "file_name": "source || '-' || CAST(doc_id AS VARCHAR) || '.txt'", "title_tags": "substr(text, 1, 60)", "folders": "lang || ' / ' || source", "metadata": "'chars ' || CAST(n_chars AS VARCHAR)",
    "keyword_tags": "substr(text, 61, 80)", "category": "CASE WHEN doc_id % 5 = 0 THEN 'Thing' ELSE 'Unknown' END", "clean_text": "replace(text, '  ', ' ')", "text": "text"}


def with_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", *(F.expr(x.replace("VARCHAR", "STRING")).alias(f) for f, x in FIELD_SQL.items()))


def fields_sql(tokens: list[str], given: str) -> str:
    """The field scores of `given` (doc_id and the fields) as `y` (doc_id, score, matched). Tokens are letters only."""
    q, names = " ".join(tokens), list(FIELD_SQL)
    norm = lambda x: f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"
    low = ", ".join(f"{norm(f)} AS low_{f}" for f in names)
    words = ", ".join(f"list_filter(string_split(low_{f}, ' '), lambda x: x <> '') AS w_{f}" for f in names)
    parts, hits = [], {t: [] for t in tokens}
    for f, weight, recognised in search.FIELDS:
        own = [f"CASE WHEN low_{f} = '{q}' THEN {3.0 * weight} ELSE 0 END", f"CASE WHEN contains(low_{f}, '{q}') THEN {2.0 * weight} ELSE 0 END", f"CASE WHEN contains(replace(low_{f}, ' ', ''), '{q.replace(' ', '')}') THEN {1.5 * weight} ELSE 0 END"]
        for t in tokens:
            most = (3 if len(t) >= 7 else 2 if len(t) == 6 else 1) if recognised else 1
            near = f"len(list_filter(w_{f}, lambda x: abs(length(x) - {len(t)}) <= 1 AND levenshtein(x, '{t}') <= {most})) > 0"
            own.append(f"CASE WHEN list_contains(w_{f}, '{t}') THEN {weight} * idf_{t} WHEN {near} THEN {(0.25 if recognised else 0.45) * weight} * idf_{t} ELSE 0 END")
            hits[t].append(f"list_contains(w_{f}, '{t}') OR {near}")
        parts.append(f"CASE WHEN low_{f} <> '' THEN {' + '.join(own)} ELSE 0 END")
    return f"""lows AS (SELECT doc_id, {norm("concat_ws(' ', " + ", ".join(names) + ")")} AS whole, {low} FROM {given}), ws AS (SELECT *, {words} FROM lows),
nn AS (SELECT {", ".join(f"1 + ln((count(*) + 1) / (count_if(contains(whole, '{t}')) + 1)) AS idf_{t}" for t in tokens)} FROM lows),
x AS (SELECT doc_id, {" + ".join(parts)} AS s, {" + ".join(f"CAST({' OR '.join(hits[t])} AS INT)" for t in tokens)} AS matched FROM ws CROSS JOIN nn),
y AS (SELECT doc_id, floor((s + CASE WHEN matched = {len(tokens)} THEN 150 ELSE 0 END) * 100 + 0.5) / 100 AS score, CAST(matched AS INT) AS matched FROM x)"""


ALL_FIELDS = "g AS (SELECT doc_id, " + ", ".join(f"{x} AS {f}" for f, x in FIELD_SQL.items()) + " FROM documents)"


@query("X03_field_search", f"WITH {ALL_FIELDS}, {fields_sql(ASKED.split(), 'g')} SELECT doc_id, score, matched FROM y WHERE score > 0 AND matched = 2")
def field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight fields and two words, exact or nearly so, over every document."""
    return search.searched(with_fields(spark, sf_dir), ASKED)


@query("X03_one_word", f"WITH {ALL_FIELDS}, {fields_sql(['eran'], 'g')} SELECT doc_id, score FROM y WHERE score > 0")
def one_word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.searched(with_fields(spark, sf_dir), "eran").select("doc_id", "score")


@query("X06_two_stage_search", f"""WITH {BM25_SQL}, b AS (SELECT doc_id FROM h ORDER BY h.score DESC, doc_id LIMIT 100), {ALL_FIELDS}, gb AS (SELECT * FROM g WHERE doc_id IN (SELECT doc_id FROM b)), {fields_sql(ASKED.split(), 'gb')}
SELECT doc_id, score FROM y WHERE score > 0 AND matched = 2""")
def two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.two_stage(with_fields(spark, sf_dir), ASKED).select("doc_id", "score")


@query("O03_ranked_results", f"WITH {ALL_FIELDS}, {fields_sql(['eran'], 'g')} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM y WHERE score > 0 ORDER BY place LIMIT 30")
def ranked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of results: thirty rows meet, and they are numbered."""
    first = search.ranked(search.searched(with_fields(spark, sf_dir), "eran").select("doc_id", "score")).limit(30)
    return first.select("doc_id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long").alias("place"))


@query("X05_bm25_from_index", ORACLES["X05_bm25_top100"])
def bm25_from_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranking from an index that is kept for the table's files: made at the first search, and read at the others."""
    index = indexing.kept(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return index.bm25(ASKED).withColumn("score", F.floor(F.col("score") * 1e6 + 0.5) / 1e6)


@query("X07_kept_index", ORACLES["X05_bm25_top100"])
def kept_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranking after the index was made by changes: two thirds of the documents, some with other texts, and some
    that are none; then the rest, the texts as they are, and what is too much deleted; and all segments merged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = docs.filter("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("thing eran thing "), "text")).otherwise(F.col("text")))
    index = indexing.opened(spark, f"{versions.shared(spark)}/index-{uuid.uuid4().hex}")
    index = index.changed(old.union(docs.filter("doc_id % 7 = 0").selectExpr("-doc_id - 1", "text")))
    index = index.changed(docs.filter("doc_id % 3 = 0 OR doc_id % 5 = 1"), docs.filter("doc_id % 7 = 0").selectExpr("-doc_id - 1 AS doc_id"))
    return index.merged().bm25(ASKED).withColumn("score", F.floor(F.col("score") * 1e6 + 0.5) / 1e6)


@query("J08_words_nearly", """WITH w AS (SELECT DISTINCT unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS w FROM documents)
SELECT a.token, w.w AS word FROM (VALUES ('thing', 1), ('erand', 1), ('tionate', 3)) a(token, most) JOIN w ON abs(length(w.w) - length(a.token)) <= 1 AND levenshtein(w.w, a.token) <= a.most""")
def words_nearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different words of all documents that are nearly one of three, the last as in recognised text."""
    index = indexing.kept(table(spark, sf_dir, "documents").select("doc_id", "text"))
    own = [index.close(t, r).select(F.lit(t).alias("token"), F.col("token").alias("word")) for t, r in (("thing", False), ("erand", False), ("tionate", True))]
    return own[0].union(own[1]).union(own[2])


@query("X07_field_postings", "WITH " + ALL_FIELDS + ", e AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{f}' AS field, unnest(list_filter(string_split(trim(regexp_replace(lower(coalesce({f}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS token FROM g" for f in FIELD_SQL)
    + ") SELECT token, doc_id, field, count(*) AS tf FROM e GROUP BY ALL")
def field_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.field_postings(with_fields(spark, sf_dir), list(FIELD_SQL))


@query("K05_recognised_words", """WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents)
SELECT doc_id, len(list_filter(w, lambda x: abs(length(x) - 7) <= 1 AND levenshtein(x, 'tionate') <= 3)) > 0 AS seven, len(list_filter(w, lambda x: abs(length(x) - 6) <= 1 AND levenshtein(x, 'lengst') <= 2)) > 0 AS six FROM w""")
def recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of recognised text may differ more, the longer they are."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.split(search.search_text(F.col("text")), " ").alias("w"))
    return words.select("doc_id", search.is_close(F.col("w"), "tionate", True).alias("seven"), search.is_close(F.col("w"), "lengst", True).alias("six"))


@query("F08_substring_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'ing er') OR contains(lower(source), 'ing er')")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file_name"), "text")
    return search.substring_search(docs, " ing ER ").select("doc_id")


@query("J08_fuzzy_words", """SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: abs(length(w) - 6) <= 1 AND levenshtein(w, 'widgat') <= 1)) > 0""")
def fuzzy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.filter(search.is_close(F.split("p_name", " "), "widgat", False)).select("p_partkey")


@query("K18_snippet", """WITH a AS (SELECT doc_id, text, CASE WHEN instr(lower(text), 'thing') > 0 THEN instr(lower(text), 'thing') ELSE instr(lower(text), 'eran') END AS p FROM documents)
SELECT doc_id, CASE WHEN p = 0 THEN '' ELSE substr(text, greatest(p - 50, 1), p + 100 - greatest(p - 50, 1)) END AS snippet FROM a""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", search.snippet(F.col("text"), ASKED).alias("snippet"))


COSINE_SQL = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"
KNN_SQL = f"""p AS (SELECT a.vec_id AS query_id, b.vec_id, a.label AS want, b.label AS got, floor({COSINE_SQL} * 1e4 + 0.5) / 1e4 AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)"""


def _knn(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Every row whose id is divisible by 50 is a query."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 50 = 0")
    label = rows.select(F.col("vec_id"), F.col("label").alias("got"))
    want = asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"))
    return vectors.knn_blocks(rows, asked, k).join(label, "vec_id").join(want, "query_id")


@query("V02_knn", f"WITH {KNN_SQL} SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 30")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, 30).select("query_id", "vec_id", "score", "rank")


@query("W06_precision_recall_at_k", f"""WITH {KNN_SQL}, r AS (SELECT want, count(*) - 1 AS total FROM (SELECT label AS want FROM embeddings) GROUP BY want),
t AS (SELECT query_id, k.want, rank, sum(CASE WHEN want = got THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS good FROM k WHERE rank <= 50)
SELECT query_id, CAST(rank AS INT) AS k, floor(good / rank * 1e4 + 0.5) / 1e4 AS precision, floor(good / total * 1e4 + 0.5) / 1e4 AS recall FROM t JOIN r ON t.want = r.want WHERE rank IN (5, 10, 20, 30, 50)""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _knn(spark, sf_dir, 50)
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    good = F.sum((F.col("want") == F.col("got")).cast("int")).over(w)
    total = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("want")).agg((F.count(F.lit(1)) - 1).alias("total"))
    rows = found.withColumn("good", good).filter(F.col("rank").isin(5, 10, 20, 30, 50)).join(total, "want")
    fine = lambda x: F.floor(x * 1e4 + 0.5) / 1e4
    return rows.select("query_id", F.col("rank").alias("k"), fine(F.col("good") / F.col("rank")).alias("precision"), fine(F.col("good") / F.col("total")).alias("recall"))


@query("W05_first_irrelevant", f"WITH {KNN_SQL} SELECT query_id, CAST(min(rank) AS INT) AS first_irrelevant FROM k WHERE rank <= 50 AND want <> got GROUP BY query_id")
def first_irrelevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, 50).filter("want <> got").groupBy("query_id").agg(F.min("rank").alias("first_irrelevant"))


@query("F13_threshold_sweep", f"""WITH {KNN_SQL}, t AS (SELECT unnest([0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5]) AS threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(sum(CASE WHEN score >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS found, CAST(sum(CASE WHEN score >= threshold AND want = got THEN 1 ELSE 0 END) AS BIGINT) AS good FROM k CROSS JOIN t WHERE rank <= 50 GROUP BY threshold""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass: each threshold is a conditional sum."""
    rows = _knn(spark, sf_dir, 50)
    levels = (0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5)
    sums = rows.agg(*(F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("score") >= t).alias("found"),
                               F.count_if((F.col("score") >= t) & (F.col("want") == F.col("got"))).alias("good")).alias(f"_{i}") for i, t in enumerate(levels)))
    return sums.select(F.explode(F.array(*(f"_{i}" for i in range(len(levels))))).alias("r")).select("r.*")


@query("X09_hybrid_merge", f"""WITH {BM25_SQL}, l AS (SELECT doc_id, score FROM h ORDER BY score DESC, doc_id LIMIT 100),
sem AS (SELECT b.vec_id AS doc_id, floor({COSINE_SQL} * 1e4 + 0.5) / 1e4 AS sim FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id = 0 ORDER BY sim DESC, doc_id LIMIT 30)
SELECT coalesce(l.doc_id, sem.doc_id) AS doc_id, CASE WHEN sim IS NULL THEN floor(score * 1e4 + 0.5) / 1e4 WHEN score IS NULL THEN floor(sim * 10000 + 0.5) / 100 ELSE floor((score + 100 * sim) * 100 + 0.5) / 100 END AS score
FROM l FULL OUTER JOIN sem ON l.doc_id = sem.doc_id""")
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical = search.bm25(table(spark, sf_dir, "documents"), ASKED)
    rows = table(spark, sf_dir, "embeddings")
    q = rows.filter("vec_id = 0").head()["embedding"]
    semantic = vectors.top_k(rows, q, 30).select(F.col("vec_id").alias("doc_id"), F.col("score").alias("similarity"))
    both = search.hybrid(lexical, semantic)
    only = both.join(semantic.select("doc_id", "similarity"), "doc_id", "left")
    return only.select("doc_id", F.when(F.col("similarity").isNull(), F.floor(F.col("score") * 1e4 + 0.5) / 1e4).otherwise(F.col("score")).alias("score"))


def _with_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    """Documents that have a vector of their id, made of today's text."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text").join(rows, "doc_id")
    return docs.withColumn("made_of", identity.fingerprint(F.col("text"))), rows.filter("doc_id = 0").head()["vector"]


@query("X08_semantic_search", rf"""WITH d AS (SELECT doc_id, source, text FROM documents WHERE trim(coalesce(text, '')) <> ''), s AS (SELECT d.doc_id, d.source, d.text, floor({COSINE_SQL} * 1e4 + 0.5) / 1e4 AS sim
FROM d JOIN embeddings b ON d.doc_id = b.vec_id CROSS JOIN (SELECT * FROM embeddings WHERE vec_id = 0) a), k AS (SELECT * FROM s ORDER BY sim DESC, doc_id LIMIT 30)
SELECT doc_id AS document_id, source AS file_name, floor(sim * 10000 + 0.5) / 100 AS score, md5(substr(text, 1, 320)) AS preview_md5, TRUE AS has_full_text, 'cached' AS mode FROM k""")
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness, equal dimensions, nearest vectors, their documents by path, and what a reader sees of them."""
    docs, asked = _with_vectors(spark, sf_dir)
    hits, state = vectors.semantic(docs, asked, 30)
    library = docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("file_name"), F.concat(F.lit("/a//b/"), "doc_id").alias("file_path"),
                          F.lit("").alias("primary_path"), F.array("lang").alias("title_tags"), "text", F.lit("").alias("clean_text"))
    shown = views.found_by_meaning(hits.select(F.concat(F.lit("/a/./b/"), "doc_id").alias("file_path"), "similarity"), library)
    return shown.join(F.broadcast(state.select("mode"))).select("document_id", "file_name", "score", F.md5("preview").alias("preview_md5"), "has_full_text", "mode")


@query("V03_usable_together", """WITH e AS (SELECT vec_id, vec_id % 9 = 4 AS other FROM embeddings) SELECT count(*) AS candidates, count(*) AS fresh, CAST(count_if(NOT other) AS BIGINT) AS fits, 'mixed' AS mode FROM e JOIN documents ON vec_id = doc_id WHERE trim(coalesce(text, '')) <> ''""")
def usable_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of another length among them: none can be used."""
    docs, asked = _with_vectors(spark, sf_dir)
    short = docs.withColumn("vector", F.when(F.col("doc_id") % 9 == 4, F.slice("vector", 1, 3)).otherwise(F.col("vector")))
    return vectors.semantic(short, asked, 30)[1]


@query("J03_hits_with_documents", f"WITH {BM25_SQL}, b AS (SELECT doc_id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM h ORDER BY h.score DESC, doc_id LIMIT 100) SELECT b.doc_id AS document_id, source AS file_name, score, md5(substr(text, 1, 320)) AS preview_md5 FROM b JOIN documents ON b.doc_id = documents.doc_id")
def hits_with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = search.bm25(docs, ASKED).select(F.col("doc_id").alias("document_id"), (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"))
    library = docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("file_name"), "text", F.lit("").alias("clean_text"))
    return views.found(hits, library).select("document_id", "file_name", "score", F.md5("preview").alias("preview_md5"))
