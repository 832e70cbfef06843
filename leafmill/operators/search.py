"""Lexical search: tokens, an inverted index with BM25, field scores with fuzzy matches, snippets; and its merge with
vector search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_text
from . import fuzzy

#: Words that a query doesn't search for; fields with weights, and whether their text was recognised
#: from images.
STOP = "a an and are as at for from in is of on or the to with".split()
FIELDS = (("file_name", 120, False), ("title_tags", 70, False), ("folders", 55, False), ("metadata", 50, False), ("keyword_tags", 45, False),
          ("category", 25, False), ("clean_text", 10, True), ("text", 2, True))
#: Near words that travel to the rows: some hundred kilobytes.
NEAR = 20_000


def tokens(text: Column) -> Column:
    """Different words in order; bcs303 also gives bcs and 303; numbers lose leading zeros."""
    return tokens_of(search_text(text))


def tokens_of(low: Column) -> Column:
    """As tokens(), of a text in its plain form."""
    words = F.filter(F.split(low, " "), lambda w: (w != "") & ~w.isin(*STOP))
    whole = F.flatten(F.transform(words, lambda w: F.when(
        w.rlike("^([a-z]+[0-9]+|[0-9]+[a-z]+)$"), F.array(w, F.regexp_extract(w, "^([a-z]+|[0-9]+)", 1), F.regexp_extract(w, "([a-z]+|[0-9]+)$", 1))).otherwise(F.array(w))))
    plain = F.transform(whole, lambda w: F.regexp_replace(w, "^0+(?=[0-9]+$)", ""))
    own = F.when(low.rlike("[0-9]"), F.filter(plain, lambda w: ~w.isin(*STOP))).otherwise(words)  # without digits, words stay as they are
    return F.array_distinct(own)


def query_tokens(query: str) -> list[str]:
    """tokens() of a query, on the driver."""
    out: list[str] = []
    for w in re.sub("[^a-z0-9]+", " ", query.lower()).split():
        m = re.fullmatch("([a-z]+)([0-9]+)", w) or re.fullmatch("([0-9]+)([a-z]+)", w)
        out += [w, *m.groups()] if m else [w]
    out = [re.sub("^0+(?=[0-9]+$)", "", w) for w in out]
    return list(dict.fromkeys(w for w in out if w not in STOP))


def _same(token: str):
    return lambda w: w == token


def counted(rows: DataFrame, keys: list[str], words: Column) -> DataFrame:
    """keys, token, tf: how often each word of a row is among its own. Sorted, equal words lie together, so a row's count
    is told from its own array and nothing moves."""
    own = rows.select(*keys, F.sort_array(words).alias("_w"))
    new = F.filter(F.sequence(F.lit(1), F.size("_w")), lambda i: (i == 1) | (F.get("_w", i - 1) != F.get("_w", i - 2)))
    own = own.filter(F.size("_w") > 0).select(*keys, "_w", new.alias("_s"))
    ends = F.concat(F.slice(F.col("_s"), F.lit(2), F.size("_s")), F.array(F.size("_w") + 1))
    runs = F.zip_with("_s", ends, lambda a, b: F.struct(F.get("_w", a - 1).alias("token"), (b - a).cast("long").alias("tf")))
    return own.select(*keys, F.explode(runs).alias("_r")).select(*keys, "_r.token", "_r.tf")


def _once(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows of counts by document; only where ids of documents repeat are they added up."""
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows
    return rows.groupBy(*(c for c in rows.columns if c != "tf")).agg(F.sum("tf").alias("tf"))


def split_words(text: Column) -> Column:
    return F.filter(F.split(search_text(text), " "), lambda w: w != "")


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """token, doc_id, doc_len, tf: the inverted index, counted in each document's row."""
    words = docs.select("doc_id", split_words(F.col(text)).alias("_w")).select("doc_id", F.size("_w").alias("doc_len"), "_w")
    return _once(counted(words, ["doc_id", "doc_len"], F.col("_w")), docs).select("token", "doc_id", "doc_len", "tf")


def field_postings(docs: DataFrame, fields: list[str]) -> DataFrame:
    """token, doc_id, field, tf of several fields: the rows of the full-text index. Fields of a document with the same
    content are cut and counted once."""
    own = docs.select("doc_id", F.array(*(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)).alias("_v"))
    each = own.select("doc_id", "_v", F.explode(F.array_distinct("_v")).alias("_t"))
    named = F.filter(F.array(*map(F.lit, fields)), lambda f: F.get("_v", F.array_position(F.array(*map(F.lit, fields)), f).cast("int") - 1) == F.col("_t"))
    words = each.select("doc_id", named.alias("_f"), split_words(F.col("_t")).alias("_w"))
    rows = counted(words, ["doc_id", "_f"], F.col("_w")).select("token", "doc_id", F.explode("_f").alias("field"), "tf")
    return _once(rows, docs)


def bm25_ranked(rows: DataFrame, stats: DataFrame, asked: list[str], limit: int = 100, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """As bm25(), from the postings (token, doc_id, tf, doc_len) of the words `asked`, and one row of docs and mean, the
    number of documents and their mean length."""
    rows = rows.filter(F.col("token").isin(asked))
    dfs = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    each = rows.join(F.broadcast(dfs.join(F.broadcast(stats))), "token")  # a row for each word of the query
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("mean")))
    place = F.array_position(F.array(*map(F.lit, asked)), F.col("token"))
    hits = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), part.alias("s")))).alias("p")).filter(F.size("p") == len(asked))
    score = F.aggregate("p", F.lit(0.0), lambda a, x: a + x["s"])  # in the query's order, so that sums round alike
    return hits.select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)


def bm25_indexed(index: DataFrame, sizes: DataFrame, query: str, limit: int = 100, k1: float = 1.2, b: float = 0.75, most: int = 8) -> DataFrame:
    """As bm25(), from postings() and a table of doc_id, doc_len of all documents: only the query's tokens are read of the
    index, which a stored one finds by its tokens' statistics."""
    stats = sizes.agg(F.count(F.lit(1)).alias("docs"), F.avg("doc_len").alias("mean"))
    return bm25_ranked(index, stats, query_tokens(query)[:most], limit, k1, b)


def bm25(docs: DataFrame, query: str, limit: int = 100, text: str = "text", k1: float = 1.2, b: float = 0.75, most: int = 8) -> DataFrame:
    """doc_id, score of documents that have all of the query's first tokens, the best `limit`. Only the query's tokens
    leave the scan: a document's matches are counted in its own row."""
    asked = query_tokens(query)[:most]
    words = docs.select("doc_id", F.filter(F.split(search_text(F.col(text)), " "), lambda w: w != "").alias("_w"))
    rows = words.select("doc_id", F.size("_w").alias("n"), *(F.size(F.filter("_w", _same(t))).alias(f"_{i}") for i, t in enumerate(asked)))
    if not asked:
        return rows.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    stats = rows.agg(F.count(F.lit(1)).alias("_docs"), F.avg("n").alias("_avg"), *(F.count_if(F.col(f"_{i}") > 0).alias(f"_df{i}") for i in range(len(asked))))
    every = F.lit(True)
    for i in range(len(asked)):
        every = every & (F.col(f"_{i}") > 0)
    hits = rows.filter(every).join(F.broadcast(stats))  # one row of sums
    score = F.lit(0.0)
    for i in range(len(asked)):
        df, tf = F.col(f"_df{i}"), F.col(f"_{i}")
        idf = F.log(1 + (F.col("_docs") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("_avg")))
    return hits.select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)


def idf(candidates: DataFrame, query: str, text: str = "text") -> DataFrame:
    """token, df, idf over the candidates given; a token counts where it is a substring."""
    asked = query_tokens(query)
    low = search_text(F.col(text))
    sums = candidates.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(low.contains(t)).alias(f"_{i}") for i, t in enumerate(asked)))
    rows = F.array(*(F.struct(F.lit(t).alias("token"), F.col(f"_{i}").alias("df")) for i, t in enumerate(asked)))
    return sums.select("_n", F.explode(rows).alias("r")).select("r.token", "r.df", (1 + F.log((F.col("_n") + 1) / (F.col("r.df") + 1))).alias("idf"))


def is_close(words: Column, token: str, recognised: bool) -> Column:
    """Whether a word is nearly the token: one edit, or up to three in recognised text; lengths differ by one at most."""
    return F.exists(words, lambda w: fuzzy.fits(w, token, recognised)) if fuzzy.allowed(token, recognised) else F.lit(False)


def asked_forms(query: str) -> tuple[list[str], str, str]:
    """A query's tokens, its plain form and that without blanks."""
    plain = re.sub("[^a-z0-9]+", " ", query.lower()).strip()
    return query_tokens(query), plain, plain.replace(" ", "")


def field_signs(low: Column, words: Column, query: str, recognised: bool, close=is_close) -> Column:
    """What one field (its search_text() and tokens()) has of a query: how much it has of it as a whole, and for each
    token 1 if it is a word, 2 if it is one but for blanks, 3 if a word is nearly it, else 0. close: as is_close()."""
    asked, q, cq = asked_forms(query)
    dense = F.replace(low, F.lit(" "), F.lit(""))
    whole = F.when(low == q, 3.0).otherwise(0.0) + F.when(low.contains(q), 2.0).otherwise(0.0) + F.when(dense.contains(cq), 1.5).otherwise(0.0)
    levels = [F.when(F.array_contains(words, t), 1).when(dense.contains(t) if re.fullmatch("[a-z]+[0-9]+", t) else F.lit(False), 2)
              .when(close(words, t, recognised), 3).otherwise(0) for t in asked]
    none = F.struct(F.lit(0.0).alias("whole"), F.array(*[F.lit(0)] * len(asked)).cast("array<int>").alias("levels"))
    return F.when(low != "", F.struct(whole.alias("whole"), F.array(*levels).cast("array<int>").alias("levels"))).otherwise(none)


def field_score(signs: Column, idfs: list[Column], weight: float, recognised: bool) -> Column:
    """Score of one field by its field_signs()."""
    score = weight * signs["whole"]
    for i, idf in enumerate(idfs):
        level = signs["levels"][i]
        score = score + F.when(level == 1, weight * idf).when(level == 2, 0.8 * weight * idf).when(level == 3, (0.25 if recognised else 0.45) * weight * idf).otherwise(0.0)
    return score


def _asked_words(low: Column) -> Column:
    """Of a plain form, words among which a token of a query, or one that tokens_of() gave, is found as it is among
    tokens_of(): those as they stand, and the parts of words with digits. Others may be among them."""
    words = F.split(low, " ")
    return F.when(low.rlike("[0-9]"), F.concat(words, tokens_of(F.array_join(F.filter(words, lambda w: w.rlike("[0-9]")), " ")))).otherwise(words)


def searched(candidates: DataFrame, query: str, fields=FIELDS) -> DataFrame:
    """doc_id, score, matched: field-weighted scores over the candidates, 150 more for all tokens; with several tokens
    only documents that match them all. Every field's plain form and words are columns, worked out once, and once for
    fields of a document with the same content. Words nearly the query's are looked for once among the different words of
    all fields; up to NEAR of them travel to the rows, and if there are more each row compares its own words."""
    asked, _, dense = asked_forms(query)
    if not dense:
        return candidates.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("matched")).limit(0)
    used = [f for f in fields if f[0] in candidates.columns]
    numbers = range(len(used))

    def same(i: int, name: str, what: Column, of: str) -> Column:
        """what(), or else the field's before if both have the same content and are judged alike."""
        return F.when(F.col(f"{of}_{i}") == F.col(f"{of}_{i - 1}"), F.col(f"{name}_{i - 1}")).otherwise(what) if i and used[i][2] == used[i - 1][2] else what

    def stepped(df: DataFrame, name: str, what, of: str) -> DataFrame:
        """A column of each field; those that take the field's before come after it."""
        df = df.select("*", *(what(i).alias(f"{name}_{i}") for i in numbers if not i or not used[i][2] or not used[i - 1][2]))
        for i in numbers:
            if i and used[i][2] and used[i - 1][2]:  # recognised texts are the long ones
                df = df.select("*", same(i, name, what(i), of).alias(f"{name}_{i}"))
        return df

    own = candidates.select("doc_id", *(F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"own_{i}") for i, (f, _, _) in enumerate(used)))
    rows = stepped(own, "low", lambda i: search_text(F.col(f"own_{i}")), "own").select("doc_id", *(f"low_{i}" for i in numbers))
    # a token has no blanks, so it lies within one field
    has = lambda t: F.greatest(*(F.col(f"low_{i}").contains(t).cast("int") for i in numbers), F.lit(0)) > 0
    sums = rows.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(has(t)).alias(f"_df{i}") for i, t in enumerate(asked)))
    near = fuzzy.among(rows, [f"low_{i}" for i in numbers], tokens_of, [(t, r) for t in asked for r in sorted({r for _, _, r in used})], NEAR)
    cut = tokens_of if near is None else _asked_words
    rows = stepped(rows, "words", lambda i: cut(F.col(f"low_{i}")), "low").join(F.broadcast(sums))  # one row of sums
    if near is not None:
        named = {a: f"near_{i}" for i, a in enumerate(near)}
        if named:
            spark = candidates.sparkSession
            rows = rows.join(F.broadcast(spark.createDataFrame([tuple(near.values())], ", ".join(f"{n} array<string>" for n in named.values()))))  # one row
        close = lambda words, t, r: F.arrays_overlap(words, F.col(named[t, r])) if (t, r) in named else F.lit(False)
    else:
        close = is_close
    rows = stepped(rows, "signs", lambda i: field_signs(F.col(f"low_{i}"), F.col(f"words_{i}"), query, used[i][2], close), "low")
    signs = F.array(*(f"signs_{i}" for i in numbers))
    # as a generated row, so that what is made of the signs doesn't work them out again
    rows = rows.select("doc_id", "_n", *(f"_df{i}" for i in range(len(asked))), F.explode(F.array(signs)).alias("signs"))
    idfs = [1 + F.log((F.col("_n") + 1) / (F.col(f"_df{i}") + 1)) for i in range(len(asked))]
    total = sum((field_score(F.col("signs")[i], idfs, weight, r) for i, (_, weight, r) in enumerate(used)), F.lit(0.0))
    hit = lambda i: F.exists("signs", lambda s: s["levels"][i] > 0)
    scored = rows.select("doc_id", total.alias("_s"), sum((hit(i).cast("int") for i in range(len(asked))), F.lit(0)).alias("matched"))
    score = F.col("_s") + F.when((F.col("matched") == len(asked)) & F.lit(len(asked) > 0), 150.0).otherwise(0.0)
    return scored.select("doc_id", (F.floor(score * 100 + 0.5) / 100).alias("score"), "matched").filter(
        (F.col("score") > 0) & (F.lit(len(asked) <= 1) | (F.col("matched") == len(asked))))


def ranked(found: DataFrame) -> DataFrame:
    """Results by score, equal ones by id."""
    return found.orderBy(F.desc("score"), "doc_id")


def two_stage(docs: DataFrame, query: str, fields=FIELDS, limit: int = 100) -> DataFrame:
    """Field scores over the index's hits (at most `limit` ids, which travel); only if it has none, over all documents."""
    hits = bm25(docs, query, limit).select("doc_id")
    ids = [r["doc_id"] for r in hits.collect()]
    if not ids:
        return searched(docs, query, fields)
    return searched(docs.filter(F.col("doc_id").isin(ids)), query, fields)


def substring_search(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """The plain fallback: documents whose name or text has the query, in any case."""
    low = query.strip().lower()
    some = [F.coalesce(F.lower(c).contains(low), F.lit(False)) for c in ("file_name", text) if c in docs.columns]
    return docs.filter(some[0] if len(some) == 1 else some[0] | some[1])


def snippet(text: Column, query: str, before: int = 50, after: int = 100) -> Column:
    """Around the longest query word that occurs; empty if none does."""
    words = sorted(query_tokens(query), key=lambda w: (-len(w), query_tokens(query).index(w)))
    at = F.coalesce(*(F.nullif(F.locate(w, F.lower(text)), F.lit(0)) for w in words), F.lit(0)) if words else F.lit(0)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at == 0, "").otherwise(F.substring(text, start, at + after - start))


def hybrid(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """doc_id, score: lexical score plus 100 times the similarity; either side may lack a document."""
    both = lexical.select("doc_id", F.col("score").alias("_l")).join(semantic.select("doc_id", F.col("similarity").alias("_s")), "doc_id", "full_outer")
    hundredth = lambda x: F.floor(x * 100 + 0.5) / 100
    return both.select("doc_id", F.when(F.col("_s").isNull(), F.col("_l")).when(F.col("_l").isNull(), F.floor(F.col("_s") * 10000 + 0.5) / 100)
                       .otherwise(hundredth(F.col("_l") + 100 * F.col("_s"))).alias("score"))
