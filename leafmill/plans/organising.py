"""Queries on folders, rules, overrides, identity and the job queue."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality
from ..functions.text import rule_text
from ..operators import organise, refresh, store
from ..operators import rules as R
from .documents import SQL_LIST, table  # noqa: F401
from .registry import query

#: Rules over words that occur in the tables.
TYPES = {"alpha": (7, {"thon": 4, "than": 5, "tion": 2}), "beta": (6, {"que": 3, "des": 4, "eau": 2}), "gamma": (6, {"und": 4, "keit": 3})}
RULE_TEXT_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[#/\\_-]+', ' ', 'g'), '[^a-z0-9.<>\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
SCORES_SQL = f"""t AS (SELECT doc_id, source, {RULE_TEXT_SQL} AS b FROM documents),
s AS (SELECT doc_id, source, """ + ", ".join(
    "(" + " + ".join(f"CASE WHEN contains(b, '{t}') THEN {float(w)} ELSE 0.0 END" for t, w in terms.items()) + f") AS {k}" for k, (_, terms) in TYPES.items()) + " FROM t)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = rule_text(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", body.alias("_b"))
    return docs.select("doc_id", "source", *(organise.rule_score(F.lit(""), F.col("_b"), terms).alias(k) for k, (_, terms) in TYPES.items()))


@query("A11_rule_scores", f"WITH {SCORES_SQL} SELECT doc_id, CAST(alpha AS DOUBLE) AS alpha, CAST(beta AS DOUBLE) AS beta, CAST(gamma AS DOUBLE) AS gamma FROM s")
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).drop("source")


@query("T13_best_type_confidence_review", f"""WITH {SCORES_SQL}, v AS (SELECT doc_id, unnest(['alpha', 'beta', 'gamma']) AS rule, unnest([0, 1, 2]) AS o, unnest([alpha, beta, gamma]) AS score, unnest([7, 6, 6]) AS least FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) AS k FROM v WHERE score >= least),
w AS (SELECT doc_id, max(CASE WHEN k = 1 THEN rule END) AS best, CAST(coalesce(max(CASE WHEN k = 1 THEN score END), 0) AS DOUBLE) AS top, CAST(coalesce(max(CASE WHEN k = 2 THEN score END), 0) AS DOUBLE) AS second FROM r GROUP BY doc_id),
x AS (SELECT s.doc_id, coalesce(best, 'unknown') AS best, coalesce(top, 0) AS top, coalesce(second, 0) AS second FROM s LEFT JOIN w ON s.doc_id = w.doc_id),
y AS (SELECT *, CASE WHEN top <= 0 THEN 0.2 ELSE least(0.98, greatest(0.15, 0.38 + least(top, 32.0) / 48 - least(0.2, second / (top + second) * 0.28))) END AS c FROM x)
SELECT doc_id, best, top, second, floor(c * 100 + 0.5) / 100 AS confidence, (best = 'unknown' OR c < 0.55 OR top < 7) AS review FROM y""")
def best_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = rule_text(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", body.alias("_b"))
    rows = docs.select("doc_id", organise.ranked(organise.scores(F.lit(""), F.col("_b"), TYPES), TYPES).alias("_r")).select(
        "doc_id", F.coalesce(F.get("_r", 0)["rule"], F.lit("unknown")).alias("best"), F.coalesce(F.get("_r", 0)["score"], F.lit(0.0)).alias("top"),
        F.coalesce(F.get("_r", 1)["score"], F.lit(0.0)).alias("second"))
    conf = organise.confidence(F.col("top"), F.col("second"), F.lit(100))
    return rows.select("doc_id", "best", "top", "second", quality.rounded(conf, 2).alias("confidence"),
                       organise.needs_review(F.col("best"), conf, F.col("top"), F.lit(100), F.lit(100)).alias("review"))


def _plain(x: str) -> str:
    """rule_text() in SQL."""
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[#/\\_-]+', ' ', 'g'), '[^a-z0-9.<>\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _has(c: str, term: str) -> str:
    plain = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9.<>\s]+", " ", re.sub(r"[#/\\_-]+", " ", term.lower()))).strip()
    some = f"contains({c}, '{plain}')"
    return f"({some} OR contains(replace({c}, ' ', ''), '{plain.replace(' ', '')}'))" if re.fullmatch(r"[a-z]+\s*\d+", plain) else some


def _rules_sql(name: str, rules: dict, least: float) -> str:
    """<name> (doc_id, rule, score, k): the rules that reach their least score, the best first, as organise.ranked()."""
    rows = []
    for i, (rule, spec) in enumerate(rules.items()):
        own, terms = spec if isinstance(spec, tuple) else (least, spec)
        total = " + ".join(f"CASE WHEN {_has('n', t)} THEN {w * 1.8} WHEN {_has('b', t)} THEN {float(w)} ELSE 0.0 END" for t, w in terms.items())
        rows.append(f"{{'rule': '{rule}', 'o': {i}, 'score': CAST({total} AS DOUBLE), 'least': CAST({own} AS DOUBLE)}}")
    return f"""{name}_s AS (SELECT doc_id, unnest([{", ".join(rows)}]) AS r FROM base), {name} AS (SELECT doc_id, r.rule AS rule, r.score AS score, row_number() OVER (PARTITION BY doc_id ORDER BY r.score DESC, r.o) AS k FROM {name}_s WHERE r.score >= r.least)"""


def _folder_sql(k: str) -> str:
    cases = [f"WHEN {k} = '{t}' AND subject = '{s}' THEN '{f}'" for t, per in R.SUBJECT_FOLDERS.items() for s, f in per.items()]
    cases += [f"WHEN {k} = 'academic-record' AND record IS NOT NULL THEN record"] + [f"WHEN {k} = '{t}' THEN '{f}'" for t, f in R.TYPE_FOLDERS.items()]
    return "CASE " + " ".join(cases) + " ELSE 'other' END"


LIST = lambda x: ", ".join(f"'{v}'" for v in x)
RECORD_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(_has('b', t) for t in terms)} THEN '{f}'" for f, terms in R.RECORD_FOLDERS) + " END"
KIND_SQL = "CASE " + " ".join(f"WHEN ext IN ({LIST(exts)}) THEN '{f}'" for f, exts in R.FILE_FOLDERS.items()) + " END"
LEAF = [x for x in R.flat_folders() if x[0] != "all-files"]
SUGGESTED_SQL = f"""docs AS (SELECT doc_id, source || '-' || CAST(doc_id AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.png' ELSE '.pdf' END AS file_name, source AS file_path, text FROM documents),
base AS (SELECT doc_id, regexp_extract(lower(file_name), '\\.[^.]+$') AS ext, {_plain("concat_ws(' ', file_name, file_path)")} AS n, {_plain("concat_ws(E'\\n', file_name, file_path, 'Unknown', text)")} AS b FROM docs),
{_rules_sql("ty", R.TYPES, 1)}, {_rules_sql("su", R.SUBJECTS, 1)},
st AS (SELECT base.doc_id, ext, b, ext IN ({LIST(R.CODE_EXTENSIONS)}) AS code, t.rule AS best, t.score AS best_score, coalesce(u.rule, 'general') AS subject, u.rule AS subject_rule, u.score AS subject_score, {RECORD_SQL} AS record
  FROM base LEFT JOIN ty t ON t.doc_id = base.doc_id AND t.k = 1 LEFT JOIN su u ON u.doc_id = base.doc_id AND u.k = 1),
kd AS (SELECT *, coalesce(best, CASE WHEN code THEN 'code-project' END, 'unknown') AS kind, coalesce(best_score, CASE WHEN code THEN 8.0 END, 0.0) + least(coalesce(subject_score, 0.0), 14.0) AS prime FROM st),
p0 AS (SELECT doc_id, {_folder_sql("kind")} AS folder, prime AS score, concat_ws(' + ', coalesce(best, 'file type'), subject_rule) AS why, 0 AS seq FROM kd WHERE {_folder_sql("kind")} <> 'other' AND prime > 0
  UNION ALL SELECT kd.doc_id, {_folder_sql("ty.rule")}, ty.score * 0.65, 'secondary type signal: ' || ty.rule, ty.k FROM kd JOIN ty ON ty.doc_id = kd.doc_id AND ty.k BETWEEN 2 AND 4
  UNION ALL SELECT doc_id, {_folder_sql("'code-project'")}, 7.0, 'source code file extension', 10 FROM kd WHERE code),
p1 AS (SELECT * FROM p0 UNION ALL SELECT doc_id, {KIND_SQL}, 1.5, ext || ' file type', 11 FROM kd WHERE {KIND_SQL} IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM p0)),
p AS (SELECT * FROM p1 UNION ALL SELECT doc_id, 'medical', 12.0, 'user positive keyword: tion', 12 FROM kd WHERE contains(b, 'tion')),
g AS (SELECT doc_id, folder, sum(score) AS score, min(seq) AS seen, list(why ORDER BY seq) AS whys FROM p WHERE folder IN ({LIST(x[0] for x in LEAF)}) GROUP BY doc_id, folder),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seen, folder) AS k FROM g),
c AS (SELECT kd.doc_id, kind AS document_type, subject, coalesce(a.folder, 'other') AS top_folder, coalesce(a.score, 0.0) AS top, coalesce(z.score, 0.0) AS second, a.whys FROM kd LEFT JOIN r a ON a.doc_id = kd.doc_id AND a.k = 1 LEFT JOIN r z ON z.doc_id = kd.doc_id AND z.k = 2),
d AS (SELECT *, CASE WHEN top <= 0 THEN 0.2 ELSE least(0.98, greatest(0.15, 0.38 + least(top, 32.0) / 48 - least(0.2, second / (top + second) * 0.28))) END AS conf FROM c),
e AS (SELECT *, document_type = 'unknown' OR conf < 0.55 OR top < 7 AS review FROM d), f AS (SELECT *, CASE WHEN review THEN 'review-needed' ELSE top_folder END AS primary_folder FROM e),
up(folder, parent) AS (VALUES {", ".join(f"('{x[0]}', '{x[2]}')" for x in LEAF if x[2])}),
sec AS (SELECT * FROM (SELECT f.doc_id, r.folder, row_number() OVER (PARTITION BY f.doc_id ORDER BY r.k) AS k FROM f JOIN r ON r.doc_id = f.doc_id WHERE r.folder <> f.primary_folder AND r.score >= 7) WHERE k <= 5),
ids AS (SELECT doc_id, primary_folder AS folder, 0 AS seq FROM f UNION ALL SELECT doc_id, parent, 1 FROM f JOIN up ON up.folder = primary_folder
  UNION ALL SELECT doc_id, top_folder, 2 FROM f WHERE review UNION ALL SELECT doc_id, parent, 3 FROM f JOIN up ON up.folder = top_folder WHERE review
  UNION ALL SELECT doc_id, folder, 10 + k FROM sec UNION ALL SELECT sec.doc_id, parent, 20 + k FROM sec JOIN up ON up.folder = sec.folder UNION ALL SELECT doc_id, 'review-needed', 90 FROM f WHERE review),
di AS (SELECT doc_id, folder, min(seq) AS seq FROM ids GROUP BY doc_id, folder), dl AS (SELECT doc_id, string_agg(folder, ',' ORDER BY seq) AS folder_ids FROM di GROUP BY doc_id),
sg AS (SELECT f.*, dl.folder_ids FROM f JOIN dl ON dl.doc_id = f.doc_id)"""


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("doc_id") % 3 == 0, ".py").when(F.col("doc_id") % 3 == 1, ".png").otherwise(".pdf")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("source", F.lit("-"), "doc_id", kinds).alias("file_name"), F.col("source").alias("file_path"), F.lit("Unknown").alias("category"), F.col("text").alias("clean_text"),
        F.lit(90).alias("quality"), F.lit(100).alias("word_count"))


def edits(spark: SparkSession) -> DataFrame:
    rows = [("medical", "tion", "positive", 1.0), ("images", "que", "ignored", 1.0)]
    return spark.createDataFrame(rows, "folder_id string, keyword string, role string, weight double")


@query("T12_suggested_folders", f"""WITH {SUGGESTED_SQL} SELECT doc_id, document_type, subject, primary_folder, CAST(top AS DOUBLE) AS top_score, floor(conf * 100 + 0.5) / 100 AS confidence, review, folder_ids,
coalesce(array_to_string(list_filter(whys, lambda x, i: list_position(whys, x) = i)[1:3], '; '), '') AS reasons FROM sg""")
def suggested_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organise.suggested(library(spark, sf_dir), overrides=edits(spark)).select(
        "doc_id", "document_type", "subject", "primary_folder", "top_score", "confidence", "review", F.array_join("folder_ids", ",").alias("folder_ids"), F.array_join("reasons", "; ").alias("reasons"))


@query("M13_refreshed_assignments", f"""WITH {SUGGESTED_SQL}, {{tree}}, x AS (SELECT doc_id, primary_folder, conf, unnest(string_split(folder_ids, ',')) AS folder_id FROM sg),
y AS (SELECT x.doc_id, x.folder_id, floor(conf * 100 + 0.5) / 100 AS confidence, row_number() OVER (PARTITION BY x.doc_id ORDER BY x.folder_id <> primary_folder, sort_order) = 1 AS is_primary FROM x JOIN o ON o.folder_id = x.folder_id),
m AS (SELECT doc_id, unnest(['code-web', 'code-projects']) AS folder_id FROM documents WHERE doc_id % 11 = 0)
SELECT doc_id, folder_id, confidence, is_primary, 'auto' AS source FROM y WHERE NOT (folder_id = 'medical' AND doc_id % 7 = 0) AND (doc_id, folder_id) NOT IN (SELECT doc_id, folder_id FROM m)
UNION ALL SELECT doc_id, folder_id, 1.0, FALSE, 'manual' FROM m""".replace("{tree}", "o(folder_id, sort_order) AS (VALUES " + ", ".join(f"('{x[0]}', {x[4]})" for x in R.flat_folders()) + ")"))
def refreshed_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document organised anew after edits of keywords and of single documents."""
    docs = library(spark, sf_dir)
    single = docs.filter("doc_id % 7 = 0").select("doc_id", F.lit("medical").alias("folder_id"), F.lit("remove").alias("action")).union(
        docs.filter("doc_id % 11 = 0").select("doc_id", F.lit("code-web"), F.lit("add")))
    return refresh.organised(docs, all_folders(spark), edits(spark), single)


def all_folders(spark: SparkSession) -> DataFrame:
    return folders(spark).withColumns({"source": F.lit("system"), "deleted_at": F.lit(None).cast("timestamp")})


TREE_SQL = "f(folder_id, parent_id) AS (VALUES " + ", ".join(f"('{i}', {chr(39) + p + chr(39) if p else 'NULL'})" for i, _, p, _, _ in R.flat_folders()) + ")"
CHOICE_SQL = "['notes-english', 'notes-other', 'code-web', 'images', 'exam-papers-jee'][CAST(doc_id % 5 AS INT) + 1]"


def folders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(R.flat_folders(), "folder_id string, name string, parent_id string, display_path string, sort_order int")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("notes-english", "notes-other", "code-web", "images", "exam-papers-jee")))
    return table(spark, sf_dir, "documents").select("doc_id", F.get(names, (F.col("doc_id") % 5).cast("int")).alias("folder_id"), F.lit(0.5).alias("confidence"), F.lit("auto").alias("source"))


@query("A07_folder_counts", f"""WITH RECURSIVE {TREE_SQL}, a AS (SELECT doc_id, {CHOICE_SQL} AS folder_id FROM documents),
u AS (SELECT folder_id, folder_id AS up FROM f UNION ALL SELECT u.folder_id, f.parent_id FROM u JOIN f ON u.up = f.folder_id WHERE f.parent_id IS NOT NULL)
SELECT up AS folder_id, count(DISTINCT doc_id) AS n FROM a JOIN u ON a.folder_id = u.folder_id GROUP BY up UNION ALL SELECT 'all-files', count(*) FROM documents""")
def folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.folder_counts(_assigned(spark, sf_dir), folders(spark), table(spark, sf_dir, "documents"))


#: Suppliers below nations below regions, as folders.
PLACES_SQL = """f AS (SELECT 'r' || r_regionkey AS folder_id, r_name AS name, NULL AS parent_id, r_name AS display_path, CAST(r_regionkey AS INT) AS sort_order FROM region
UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey, r_name || ' / ' || n_name, CAST(1000 + n_nationkey AS INT) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 's' || s_suppkey, s_name, 'n' || s_nationkey, r_name || ' / ' || n_name || ' / ' || s_name, CAST(2000 + s_suppkey AS INT) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    named = lambda kind, key, name, up, path, order: [F.concat(F.lit(kind), key).alias("folder_id"), F.col(name).alias("name"), up.alias("parent_id"), path.alias("display_path"), order.cast("int").alias("sort_order")]
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = region.select(*named("r", "r_regionkey", "r_name", F.lit(None).cast("string"), F.col("r_name"), F.col("r_regionkey")))
    rows = rows.union(nations.select(*named("n", "n_nationkey", "n_name", F.concat(F.lit("r"), "n_regionkey"), F.concat_ws(" / ", "r_name", "n_name"), F.col("n_nationkey") + 1000)))
    return rows.union(suppliers.select(*named("s", "s_suppkey", "s_name", F.concat(F.lit("n"), "s_nationkey"), F.concat_ws(" / ", "r_name", "n_name", "s_name"), F.col("s_suppkey") + 2000)))


@query("J10_folder_closure", f"""WITH RECURSIVE {PLACES_SQL}, u AS (SELECT folder_id, folder_id AS ancestor_id, 0 AS distance FROM f
UNION ALL SELECT u.folder_id, f.parent_id, u.distance + 1 FROM u JOIN f ON u.ancestor_id = f.folder_id WHERE f.parent_id IS NOT NULL) SELECT * FROM u""")
def folder_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.ancestors(places(spark, sf_dir))


@query("T17_overrides", f"""WITH a AS (SELECT doc_id, {CHOICE_SQL} AS folder_id FROM documents),
k AS (SELECT * FROM a WHERE NOT (folder_id = 'images' AND doc_id % 3 = 0)),
p AS (SELECT doc_id, unnest(['code-web', 'code-projects']) AS folder_id FROM documents WHERE doc_id % 11 = 0)
SELECT doc_id, folder_id, 0.5 AS confidence, 'auto' AS source FROM k WHERE (doc_id, folder_id) NOT IN (SELECT doc_id, folder_id FROM p)
UNION ALL SELECT doc_id, folder_id, 1.0, 'manual' FROM p""")
def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id")
    changes = ids.filter("doc_id % 3 = 0").select("doc_id", F.lit("images").alias("folder_id"), F.lit("remove").alias("action")).union(
        ids.filter("doc_id % 11 = 0").select("doc_id", F.lit("code-web"), F.lit("add")))
    return store.overridden(_assigned(spark, sf_dir), changes, folders(spark))


@query("T20_exact_duplicates", "SELECT sha256(text) AS file_hash, min(doc_id) AS primary_id, count(*) AS n FROM documents GROUP BY 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.by_content(table(spark, sf_dir, "documents"), F.sha2("text", 256))


@query("A06_ordered_text", r"""SELECT conv_id AS document_id, md5(string_agg(trim(text), E'\n\n' ORDER BY turn)) AS text_md5 FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def ordered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), "text", F.lit("done").alias("status"))
    return store.text_of_pages(pages).filter("text <> ''").select("document_id", F.md5("text").alias("text_md5"))


#: Events as jobs.
JOBS_SQL = """j AS (SELECT event_id AS job_id, user_id AS document_id, CAST(event_id % 9 AS INT) AS page_number, ts AS created_at,
CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'pending' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'processing' ELSE 'done' END AS status, CAST(event_id % 4 AS INT) AS attempts FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(kind.isin("click", "view"), "pending").when(kind == "error", "failed").when(kind == "signup", "processing").otherwise("done")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("document_id"), (F.col("event_id") % 9).cast("int").alias("page_number"), F.col("ts").alias("created_at"),
        state.alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"), F.lit(None).cast("string").alias("error"))


@query("A01_job_status", f"WITH {JOBS_SQL} SELECT status, count(*) AS n FROM j GROUP BY status")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("O05_job_claim", f"WITH {JOBS_SQL} SELECT job_id, document_id, page_number FROM j WHERE status = 'pending' AND attempts < 3 ORDER BY created_at, page_number, job_id LIMIT 25")
def job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.claimable(jobs(spark, sf_dir), 25).select("job_id", "document_id", "page_number")


@query("Q03_job_retry", f"""WITH {JOBS_SQL}, r AS (SELECT job_id, job_id % 5 <> 0 AS ok FROM j WHERE status = 'processing')
SELECT j.job_id, CASE WHEN ok IS NULL THEN status WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, CAST(attempts + CASE WHEN ok IS NULL THEN 0 ELSE 1 END AS INT) AS attempts
FROM j LEFT JOIN r ON j.job_id = r.job_id WHERE ok IS NULL OR NOT ok""")
def job_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = jobs(spark, sf_dir)
    results = now.filter("status = 'processing'").select("job_id", (F.col("job_id") % 5 != 0).alias("ok"), F.lit("boom").alias("error"))
    return store.after_attempt(now, results).select("job_id", "status", "attempts")


@query("A02_document_status", f"""WITH {JOBS_SQL}, o AS (SELECT document_id, count(*) AS open_jobs FROM j WHERE status IN ('pending', 'processing') GROUP BY 1),
p AS (SELECT document_id, count(*) AS indexed_pages FROM j WHERE status = 'done' GROUP BY 1)
SELECT d.document_id, coalesce(indexed_pages, 0) AS indexed_pages, coalesce(open_jobs, 0) AS open_jobs, CASE WHEN coalesce(open_jobs, 0) > 0 THEN 'indexing' ELSE 'done' END AS status
FROM (SELECT DISTINCT document_id FROM j) d LEFT JOIN o ON d.document_id = o.document_id LEFT JOIN p ON d.document_id = p.document_id""")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = jobs(spark, sf_dir)
    return store.status(now.select("document_id").distinct(), now.filter("status = 'done'"), now)


@query("M01_upsert_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], [F.desc("event_id")])


@query("J12_unlabelled", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("S33_table_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("documents", "pages", "events")]
    return parts[0].union(parts[1]).union(parts[2])
