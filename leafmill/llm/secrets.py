"""Secret scans with Spark expressions only, weighed by who owns a value across the whole corpus.

Spans come from regular expressions: `split` gives the text between matches, so running lengths give positions in
code points. Hashes of all candidate values are counted over different documents (texts, so that copies count once) and
owners, each partly summed before it moves. A value that many owners or many documents have is a copied example; one of
few looks live. Base kinds always stay in `spans`; of the method's own kind (`key`, long mixed tokens) only live-looking
values are added.

Cases: a null text is empty and has no spans; a null owner counts as one owner; rows that repeat a document give a row
each and count once; texts are read whole; extra columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The base patterns. Runs that `+` would find and a length test drop are the same as runs with a least
#: length, save for assignments, whose failing matches still use up their text.
ASSIGN = r"""(?=[PSTApsta])((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: The method's own: a long token that mixes cases and digits.
KEY = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[a-z0-9_-]*[A-Z])(?=[A-Z0-9_-]*[a-z])[A-Za-z0-9_-]{20,}"
KINDS = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24), "key": (KEY, 0, 20)}
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:int,order:int,kind:string,end:int,hash:string>>"


def _found(text: Column, order: int, kind: str) -> Column:
    """Spans of one kind, in order."""
    pattern, group, least = KINDS[kind]
    p = F.lit(pattern)
    whole, between = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    lens = F.zip_with(between, whole, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    ends = F.aggregate(
        F.slice(lens, 1, F.size(whole)), F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["b"] + x["m"]).alias("at"),
                                F.array_append(acc["out"], F.struct((acc["at"] + x["b"]).alias("start"), (acc["at"] + x["b"] + x["m"]).alias("end"))).alias("out")),
        lambda acc: acc["out"])
    rows = F.zip_with(ends, values, lambda s, v: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end"),
        F.when(F.length(v) >= least, F.sha2(v, 256)).alias("hash")))
    return F.when(text.rlike(pattern), F.filter(rows, lambda r: r["hash"].isNotNull())).otherwise(F.array()).cast(SPAN)


def candidates(docs: DataFrame, text: str = "text", owner: str = "source") -> DataFrame:
    """doc_id, owner, digest (of the text, if it has any candidate), found: all spans by start, then kind."""
    own = docs.select("doc_id", F.col(owner).cast("string").alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    each = own.select("doc_id", "owner", "_t", *(_found(F.col("_t"), i, k).alias(f"_{k}") for i, k in enumerate(KINDS)))
    base = F.concat(*(F.col(f"_{k}") for k in BASE))
    extra = F.filter("_key", lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return each.select("doc_id", "owner", F.array_sort(F.concat(base, extra)).alias("found"), "_t").select(
        "doc_id", "owner", "found", F.when(F.size("found") > 0, F.sha2("_t", 256)).alias("digest"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_docs, n_owners of every candidate value: how many different texts and how many owners have it."""
    each = found.filter("size(found) > 0").select("digest", "owner", F.explode(F.array_distinct("found.hash")).alias("hash"))
    texts = each.groupBy("hash", "digest").agg(F.lit(1).alias("_1")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs"))
    owners = each.groupBy("hash", "owner").agg(F.lit(1).alias("_1")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    return texts.join(owners, "hash")


def scanned(docs: DataFrame, text: str = "text", owner: str = "source", copied_from: int = 3, copied_in: int = 20) -> DataFrame:
    """doc_id, digest and found for every row: start, order, kind, end, hash, n_docs, n_owners and live for each span.
    Values that `copied_from` owners or `copied_in` different texts have, or more, are copied examples; others are live."""
    found = common.stored(candidates(docs, text, owner), "candidates")
    each = found.filter("size(found) > 0").dropDuplicates(["doc_id", "digest"]).select("doc_id", "digest", F.explode("found").alias("s")).select("doc_id", "digest", "s.*")
    facts = common.stored(ownership(found).withColumn("live", (F.col("n_owners") < copied_from) & (F.col("n_docs") < copied_in)), "owners")
    known = common.met(each, facts, "hash", "n_docs")
    back = known.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct(
        "start", "order", "kind", "end", "hash", "n_docs", "n_owners", "live"))).alias("spans"))
    back = back.withColumnsRenamed({"doc_id": "id", "digest": "text"})
    rows = found.join(back, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("text")), "left")
    return rows.select("doc_id", "digest", F.coalesce("spans", F.array().cast(back.schema["spans"].dataType)).alias("found"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(found: Column) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*BASE))


def all_spans(found: Column) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*BASE) | s["live"])


def verdicts(found: Column) -> Column:
    """kind:start:end:documents:owners:verdict of every candidate, the method's own that are copied examples among them."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"), s["n_docs"].cast("string"), s["n_owners"].cast("string"),
        F.when(s["live"], "live").otherwise("copied"))), ",")


def redacted(docs: DataFrame, text: str = "text", owner: str = "source", copied_from: int = 3, copied_in: int = 20,
             mark: str = "[SECRET]") -> DataFrame:
    """docs with every live-looking value's span replaced by `mark`; copied examples and all other text stay."""
    seen = scanned(docs, text, owner, copied_from, copied_in)
    hot = seen.select("doc_id", "digest", F.filter("found", lambda s: s["live"]).alias("spans")).filter("size(spans) > 0")
    hot = hot.dropDuplicates(["doc_id", "digest"]).withColumnsRenamed({"doc_id": "id", "digest": "which"})
    rows = docs.select(common.whole_rows(docs), F.col("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))
    rows = rows.join(hot, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("which")), "left")
    t = F.col(f"row.`{text}`")
    # spans that overlap an earlier one add nothing but their end
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("spans", start, lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out")),
        lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    new = F.when(F.col("spans").isNull(), t).otherwise(done)
    return rows.select(*(new.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns))
