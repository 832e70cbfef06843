"""Queries on documents: quality, cleaning, tags, categories, metadata, markup."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, identity, markup, quality
from ..functions import lexicon as lx
from ..operators import tags
from ..sources import versions
from .registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the rows of those with texts are dealt out if they lie in a few row groups."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return versions.spread(rows) if name in ("documents", "pages") else rows


WORDS_SQL = r"""w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}._+#/-]*') AS t FROM documents),
n AS (SELECT doc_id, lang, t, len(list_filter(t, lambda x: (length(x) = 1 AND NOT regexp_matches(x, '^[0-9]$')) OR length(x) > 48
  OR (length(x) >= 5 AND replace(x, x[1], '') = '')
  OR (length(x) >= 8 AND length(regexp_replace(x, '[\p{L}\p{N}]', '', 'g')) / length(x) > 0.45))) AS noise FROM w),
r AS (SELECT doc_id, lang, len(t) AS c, CASE WHEN len(t) = 0 THEN 1.0 ELSE noise / len(t) END AS ratio FROM n)"""
QUALITY_SQL = "CASE WHEN c = 0 THEN 0 ELSE CAST(greatest(0, least(100, floor((1 - ratio) * 100 + 0.5))) AS INT) END"


@query("T01_text_quality", f"""WITH {WORDS_SQL} SELECT doc_id, CAST(c AS BIGINT) AS word_count,
floor(ratio * 1000 + 0.5) / 1000 AS noise_ratio, {QUALITY_SQL} AS quality FROM r""")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", quality.words(F.col("text")).alias("_w"))
    return docs.select("doc_id", *quality.analysed(F.col("_w")))


@query("A14_quality_by_lang", f"""WITH {WORDS_SQL}, q AS (SELECT lang, c, {QUALITY_SQL} AS quality FROM r)
SELECT lang, count(*) AS n_docs, CAST(sum(c) AS BIGINT) AS n_words, floor(avg(quality) * 1000 + 0.5) / 1000 AS mean_quality FROM q GROUP BY lang""")
def quality_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", quality.words(F.col("text")).alias("_w"))
    each = docs.select("lang", *quality.analysed(F.col("_w")))
    return each.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("word_count").alias("n_words"), quality.rounded(F.avg("quality"), 3).alias("mean_quality"))


def clean_sql(given: str = "documents") -> str:
    """Clean lines (doc_id, line, p) as `k` and clean texts (doc_id, t) as `c`, of a table's `text`. Beyond ASCII the tables have
    letters with accents only, which stay as they are."""
    return r"""a AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), E'\r', E'\n'), '[ \t]+\n', E'\n', 'g'), '\n{3,}', E'\n\n', 'g'), '[ \t]{2,}', ' ', 'g'), E' \t\n') AS t FROM <given>),
l AS (SELECT doc_id, unnest(string_split(t, E'\n')) AS line, unnest(range(len(string_split(t, E'\n')))) AS p FROM a),
m AS (SELECT doc_id, p, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\s+([,.;:!?])', '\1', 'g'), '([(\[{])\s+', '\1', 'g'), '\s+([)\]}])', '\1', 'g'), '[ \t]{2,}', ' ', 'g')) AS line FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY p) AS nth FROM m
  WHERE line <> '' AND NOT (length(regexp_replace(line, '\s+', '', 'g')) >= 3 AND NOT regexp_matches(line, '[\p{L}\p{N}]'))),
k AS (SELECT doc_id, line, p FROM o WHERE nth = 1),
c AS (SELECT doc_id, string_agg(line, E'\n' ORDER BY p) AS t FROM k GROUP BY doc_id)""".replace("<given>", given)


@query("T02_clean_text", f"WITH {clean_sql()} SELECT d.doc_id, sha256(coalesce(c.t, '')) AS clean_sha256 FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaning.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.sha2(F.array_join("clean_lines", "\n"), 256).alias("clean_sha256"))


def counted_sql(given: str) -> str:
    """r_<given> (doc_id, c, ratio): words and share of noise of a table's texts `t`."""
    sql = WORDS_SQL.replace("lang, ", "").replace("lower(text)", "lower(t)").replace("FROM documents", f"FROM {given}")
    return re.sub(r"\b([wnr]) AS \(SELECT", rf"\1_{given} AS (SELECT", re.sub(r"FROM ([wn])\)", rf"FROM \1_{given})", sql))


@query("T03_built_quality", f"""WITH {clean_sql()}, clean AS (SELECT documents.doc_id, coalesce(c.t, '') AS t FROM documents LEFT JOIN c ON documents.doc_id = c.doc_id),
raw AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {counted_sql("clean")}, {counted_sql("raw")}, j AS (SELECT clean.doc_id, clean.t, r_clean.c, r_clean.ratio, r_raw.c AS raw_c
FROM clean JOIN r_clean ON clean.doc_id = r_clean.doc_id JOIN r_raw ON clean.doc_id = r_raw.doc_id)
SELECT doc_id, sha256(t) AS clean_sha256, {QUALITY_SQL} AS quality, CAST(raw_c AS BIGINT) AS raw_word_count, CAST(c AS BIGINT) AS clean_word_count, floor(ratio * 1000 + 0.5) / 1000 AS noise_ratio FROM j""")
def built_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.built(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.sha2("clean_text", 256).alias("clean_sha256"), "quality", "raw_word_count", "clean_word_count", "noise_ratio")


@query("S14_merged_lines", r"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, E'\n')) AS line, unnest(range(len(string_split(text, E'\n')))) AS p FROM conversations),
m AS (SELECT conv_id, turn, p, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM l), k AS (SELECT conv_id, line, row_number() OVER (PARTITION BY conv_id, lower(line) ORDER BY turn, p) AS nth, turn, p FROM m WHERE line <> '')
SELECT c.conv_id, md5(coalesce(string_agg(line, E'\n' ORDER BY turn, p), '')) AS text_md5 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN k ON c.conv_id = k.conv_id AND nth = 1 GROUP BY c.conv_id""")
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as readings of one page."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return rows.select("conv_id", F.md5(cleaning.merged_lines(F.transform("t", lambda t: t["text"]))).alias("text_md5"))


#: Words that occur in the tables, for queries that shouldn't be empty.
DOMAIN, COMMON = ["the", "than", "entre", "oren", "reth"], ["thing", "eran", "ered", "edan", "that", "with"]
SQL_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
NOISE_SQL = f"""NOT regexp_matches(w, '{lx.IDENTIFIERS[0]}') AND (length(w) < 3 OR length(w) > 22 OR w IN ('for', 'was', {SQL_LIST(lx.OCR_NOISE)}) OR regexp_matches(w, '[0-9]')
  OR replace(w, w[1], '') = '' OR NOT (w IN ({SQL_LIST(DOMAIN + COMMON)}) OR (length(w) BETWEEN 4 AND 18 AND regexp_matches(w, '[aeiou]')
  AND NOT regexp_matches(w, '[bcdfghjklmnpqrstvwxyz]{{5,}}') AND NOT regexp_matches(w, '[aeiou]{{4,}}'))))"""
CORRECTED_SQL = "CASE " + " ".join(f"WHEN regexp_matches(w, '{p}') THEN '{r}'" for p, r in lx.CORRECTIONS) + " ELSE w END"


@query("T04_keyword_tags", f"""WITH a AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS t FROM documents),
b AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS p FROM a),
c AS (SELECT doc_id, {CORRECTED_SQL} AS w, p FROM b),
d AS (SELECT doc_id, w, count(*) AS n, min(p) AS first FROM c WHERE NOT ({NOISE_SQL}) GROUP BY doc_id, w),
e AS (SELECT doc_id, w AS tag, first, CASE WHEN length(w) BETWEEN 4 AND 12 AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '{lx.IDENTIFIERS[0]}') THEN 100
  WHEN w IN ({SQL_LIST(DOMAIN)}) THEN 4 * n + 12 WHEN w IN ({SQL_LIST(COMMON)}) THEN 2 * n + 6
  WHEN n >= 3 AND length(w) BETWEEN 4 AND 18 AND regexp_matches(w, '[aeiou]') AND NOT regexp_matches(w, '[bcdfghjklmnpqrstvwxyz]{{5,}}') AND NOT regexp_matches(w, '[aeiou]{{4,}}') THEN 2 * n END AS s FROM d),
f AS (SELECT doc_id, tag, first, s, row_number() OVER (PARTITION BY doc_id ORDER BY s - 0.001 * first DESC, first, tag) AS rank FROM e WHERE s IS NOT NULL)
SELECT doc_id, tag, CAST(floor((s - 0.001 * first) * 1000 + 0.5) AS BIGINT) AS score_milli, CAST(rank AS INT) AS rank FROM f WHERE rank <= 20""")
def keyword_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tags.keyword_tags(table(spark, sf_dir, "documents"), stop=["for", "was"], domain=DOMAIN, common=COMMON)
    return rows.select("doc_id", "tag", F.floor(F.col("score") * 1000 + 0.5).cast("long").alias("score_milli"), "rank")


IDENTIFIER_SQL = f"length({{0}}) BETWEEN 4 AND 12 AND regexp_matches({{0}}, '[a-z]') AND regexp_matches({{0}}, '[0-9]') AND ({' OR '.join(f"regexp_matches({{0}}, '{p.replace('{', '{{').replace('}', '}}')}')" for p in lx.IDENTIFIERS)})"
LINE_WORDS_SQL = rf"list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(line), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: x <> ''), lambda w: {CORRECTED_SQL})"


@query("T07_title_lines", rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS line, unnest(range(len(string_split(coalesce(text, ''), E'\n')))) AS line_no FROM documents),
m AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM m),
a AS (SELECT *, length(regexp_replace(line, '[^A-Za-z0-9]', '', 'g')) / length(line) AS alpha, length(regexp_replace(line, '[A-Za-z0-9\s]', '', 'g')) / length(line) AS signs, {LINE_WORDS_SQL} AS ws FROM n WHERE k <= 40),
u AS (SELECT *, list_filter(ws, lambda w: NOT ({NOISE_SQL})) AS u FROM a WHERE length(line) BETWEEN 4 AND 80 AND alpha >= 0.45 AND signs <= 0.35),
s AS (SELECT doc_id, line_no, 2 * len(u) + 3 * len(list_filter(u, lambda x: x IN ({SQL_LIST(DOMAIN)}))) + 6 * len(list_filter(u, lambda x: {IDENTIFIER_SQL.format("x")})) + 2 * alpha - 3 * signs
  - (len(ws) - len(u)) - 0.08 * line_no AS score, array_to_string(list_transform(list_filter(u, lambda x, i: list_position(u, x) = i), lambda x: CASE WHEN {IDENTIFIER_SQL.format("x")} THEN upper(x) ELSE upper(x[1]) || x[2:] END), ' ') AS title FROM u WHERE len(u) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS k FROM s) SELECT doc_id, line_no, floor(score * 1000 + 0.5) / 1000 AS score, title FROM r WHERE k <= 5""")
def title_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tags.title_lines(table(spark, sf_dir, "documents"), stop=["for", "was"], domain=DOMAIN, common=COMMON)
    return rows.select("doc_id", "line_no", quality.rounded(F.col("score"), 3).alias("score"), "title")


CATEGORY_RULES = {"Red": {"red": 3, "tion": 1}, "Latin": {"que": 2, "des": 2}, "German": {"und": 3, "keit": 2}, "Rare": {"token": 9}}


@query("T10_category", "WITH s AS (SELECT doc_id, " + ", ".join(
    "(" + " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN {w} ELSE 0 END" for t, w in v.items()) + f") AS {k}" for k, v in CATEGORY_RULES.items())
    + " FROM documents) SELECT doc_id, CASE WHEN greatest(Red, Latin, German, Rare) = 0 THEN 'Unknown' "
    + " ".join(f"WHEN {k} = greatest(Red, Latin, German, Rare) THEN '{k}'" for k in CATEGORY_RULES) + " END AS category FROM s")
def category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tags.category(F.col("text"), CATEGORY_RULES).alias("category"))


@query("T11_metadata_next_line", r"""WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, E'\n'), lambda x: trim(x)), lambda x: x <> '')) AS line,
  unnest(range(len(list_filter(list_transform(string_split(text, E'\n'), lambda x: trim(x)), lambda x: x <> '')))) AS p FROM documents),
m AS (SELECT doc_id, max(p) AS p FROM l WHERE contains(lower(line), 'than') GROUP BY doc_id)
SELECT d.doc_id, l.line AS value FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id LEFT JOIN l ON l.doc_id = m.doc_id AND l.p = m.p + 1""")
def metadata_next_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.next_line_value(table(spark, sf_dir, "documents"), "than").select("doc_id", "value")


@query("S06_identity", """SELECT doc_id, 'doc_' || substr(sha256(text), 1, 24) AS document_id,
'doc_' || substr(sha256(text), 1, 24) || '_page_' || lpad(CAST(doc_id % 7 AS VARCHAR), 5, '0') AS page_id FROM documents""")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = identity.document_id(identity.file_hash(F.col("text").cast("binary")))
    return table(spark, sf_dir, "documents").select("doc_id", doc.alias("document_id"), identity.page_id(doc, F.col("doc_id") % 7).alias("page_id"))


@query("S11_markup_text", r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(regexp_replace(replace(html, E'\r', E'\n'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''),
  '[ \t]+\n', E'\n', 'g'), '\n{3,}', E'\n\n', 'g'), E' \t\n')) AS text_md5 FROM pages""")
def markup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every page. The SQL knows named entities only, and the tables have no others; numbered ones are tested apart."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(markup.markup_text(F.col("html"))).alias("text_md5"))


PLAUSIBLE_SQL = r"length(p) BETWEEN 4 AND 18 AND NOT regexp_matches(p, '[0-9]') AND regexp_matches(p, '[aeiou]') AND NOT regexp_matches(p, '[bcdfghjklmnpqrstvwxyz]{5,}') AND NOT regexp_matches(p, '[aeiou]{4,}')"
RUN_SQL = "(" + " OR ".join(f"contains(p, '{c * 4}')" for c in "abcdefghijklmnopqrstuvwxyz0123456789") + ")"


@query("K26_dictionary_signals", rf"""WITH w AS (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM w GROUP BY w), p AS (SELECT n, regexp_replace(lower(w), '[^a-z0-9]', '', 'g') AS p FROM c),
s AS (SELECT n, CASE WHEN p = '' THEN 'empty' WHEN {IDENTIFIER_SQL.format("p")} AND NOT {RUN_SQL} THEN 'identifier' WHEN p IN ({SQL_LIST(lx.OCR_NOISE)}) THEN 'noise' WHEN p IN ({SQL_LIST(lx.STOP)}) THEN 'stop'
  WHEN p IN ({SQL_LIST(lx.DOMAIN)}) THEN 'domain' WHEN p IN ({SQL_LIST(lx.COMMON)}) THEN 'dictionary' WHEN {PLAUSIBLE_SQL} THEN 'unknown-plausible' ELSE 'unknown-noisy' END AS signal FROM p)
SELECT signal, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_words FROM s GROUP BY signal""")
def dictionary_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("w"))
    return words.groupBy("w").count().groupBy(lx.signal(F.col("w")).alias("signal")).agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("n_words"))


#: Hashes of grams that may travel: 16 MB.
HASHES = 2_000_000


@query("W08_containment", r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS t FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(1, len(t) - 6)), lambda i: list_aggregate(t[i:i+7], 'string_agg', ' '))) AS g FROM d WHERE len(t) >= 8),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS t FROM benchmark),
h AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(1, len(t) - 6)), lambda i: list_aggregate(t[i:i+7], 'string_agg', ' '))) AS g FROM b WHERE len(t) >= 8)
SELECT doc_id, item_id, count(*) AS shared FROM g JOIN h ON g.g = h.g GROUP BY doc_id, item_id""")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared runs of 8 words between documents and reference passages; the passages' side is grouped first, and a
    document's grams are different ones, so a frequent gram meets one row for each passage."""

    def runs(df: DataFrame, key: str) -> DataFrame:
        t = df.select(key, F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "").alias("_t"))
        at = t.select(key, "_t", F.explode(F.when(F.size("_t") >= 8, F.sequence(F.lit(0), F.size("_t") - 8))).alias("_i"))
        return at.withColumn("h", F.xxhash64(*(F.get("_t", F.col("_i") + k) for k in range(8))))

    def grams(df: DataFrame, key: str) -> DataFrame:
        # never null, so that no join puts a test of it, and with it its making, ahead of the look-up of hashes
        return df.select(key, F.coalesce(F.array_join(F.slice("_t", F.col("_i") + 1, 8), " "), F.lit("")).alias("g")).distinct()

    left, right = runs(table(spark, sf_dir, "documents"), "doc_id"), runs(table(spark, sf_dir, "benchmark"), "item_id")
    # hashes of the passages' runs travel if they are few, so that hardly any gram of the documents is made or moves
    known = right.select("h").distinct()
    if known.count() <= HASHES:
        left = left.join(F.broadcast(known), "h", "left_semi")
    left, right = grams(left, "doc_id"), grams(right, "item_id")
    return left.join(right, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))
