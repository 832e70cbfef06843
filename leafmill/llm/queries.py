"""The queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bitslice, bpe, chat, codes, jaccard, packing, pieces, quality, secrets, suffix, treaps, urls



def vocabulary(name: str) -> str:
    """The path of a public vocabulary; a parameter of every operator that needs one."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter("vec_id % 20 = 0"), 20)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(_table(spark, sf_dir, "documents"), 5, 4, 5, count=True)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 4096)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = chat.formatted(given.union(more))
    turns = chat.parse(F.col("formatted"))
    lines = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("segments"))
    return out.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                      F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(_table(spark, sf_dir, "documents"), 400)


#: The query's rules.
SITE_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [urls.site_rule(*r) for r in SITE_RULES] + [urls.word_rule("block", w) for w in urls.SPAM_LABELS]
    return urls.judged(_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op7_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return bitslice.top_k(rows, rows.filter("vec_id % 100 = 0"), 10, scale=1024)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.trained(docs, _table(spark, sf_dir, "labels")))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = secrets.scanned(_table(spark, sf_dir, "documents"))
    base = secrets.base_spans(F.col("found"))
    number = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return seen.select("doc_id", number("assign"), number("access"), number("hex"),
                       F.sha2(secrets.written(base), 256).alias("base_sha256"),
                       secrets.written(secrets.all_spans(F.col("found"))).alias("spans"), secrets.verdicts(F.col("found")).alias("verdicts"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op12_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 20)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_cross_polytope_ann, op2_ngram_jaccard_join, op3_best_fit_packing, op4_chat_formatting, op5_suffix_array_dedup,
        op6_url_filters, op7_bit_sliced_top_k, op8_quality_classifier, op9_secret_scans, op10_bpe_round_trip,
        op11_sentencepiece_round_trip, op12_treap_search, op13_vector_codes)}


OP4_SQL = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (SELECT *, lag(role) OVER o AS before, lead(role) OVER o AS after FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
x AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\\\')) + len(regexp_extract_all(text, '<\||</?s>|\[/?INST\]'))
  + CASE WHEN before = role THEN 8 ELSE 16 + length(role) END + CASE WHEN after = role THEN 0 ELSE 8 END AS chars FROM w)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || E'\n' || text || E'\n', '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars FROM x GROUP BY conv_id"""

OP6_SQL = rf"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rule, host, path) AS (VALUES {", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in SITE_RULES)}),
m AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k FROM p JOIN r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, CASE WHEN regexp_matches(p.host, '(^|\.)({"|".join(urls.SPAM_LABELS)})\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) m ON p.page_id = m.page_id"""

OP7_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM k WHERE rank <= 10"""


OP12_SQL = r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), c AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM n),
m AS (SELECT doc_id, 75 + (25 * n * nn) // l AS m FROM n, c),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY doc_id, term),
df AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM tf, c GROUP BY term, nn),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
a AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
s AS (SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM a JOIN tf USING (term) JOIN df USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 20"""

_NEAR = """t{k} AS (SELECT v.vec_id, v.part, v.x, min(list_sum(list_transform(list_zip(v.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * 64 + b.entry) AS near
  FROM v JOIN b{k} b USING (part) GROUP BY v.vec_id, v.part, v.x)"""
_NEXT = """m{k} AS (SELECT part, near % 64 AS entry, count(*) AS n, {sums} FROM t{k} GROUP BY part, near % 64),
b{next} AS (SELECT b.part, b.entry, CASE WHEN n IS NULL THEN b.x ELSE [{means}] END AS x FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry)"""
_SUMS = ", ".join(f"sum(x[{i}]) AS s{i}" for i in range(1, 5))
_MEANS = ", ".join(f"CAST(floor(s{i} / n) AS BIGINT)" for i in range(1, 5))

OP13_SQL = "WITH " + ",\n".join((
    """k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
    "v AS (SELECT vec_id, part, list_slice(q, 4 * part + 1, 4 * part + 4) AS x FROM k, range(16) r(part))",
    "f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT 64)",
    "b0 AS (SELECT part, entry, x FROM v JOIN f USING (vec_id))",
    _NEAR.format(k=0), _NEXT.format(k=0, next=1, sums=_SUMS, means=_MEANS),
    _NEAR.format(k=1), _NEXT.format(k=1, next=2, sums=_SUMS, means=_MEANS), _NEAR.format(k=2),
    """c AS (SELECT vec_id, string_agg(printf('%02x', CAST(near % 64 AS INT)), '' ORDER BY part) AS code, CAST(sum(near // 64) AS BIGINT) AS error FROM t2 GROUP BY vec_id)""",
    "h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)",
)) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h"""


def oracle_sql() -> dict[str, str]:
    """SQL where it gives the same rows; the other queries are tested against brute force."""
    return {"op4_chat_formatting": OP4_SQL, "op6_url_filters": OP6_SQL, "op7_bit_sliced_top_k": OP7_SQL,
            "op12_treap_search": OP12_SQL, "op13_vector_codes": OP13_SQL}
