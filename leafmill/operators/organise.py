"""Which folder a document belongs to: weighted substrings for type and subject, overrides, confidence and review.

Rules are a fixed-size list in the plan: every score is an expression over one row, so nothing is shuffled. Users'
keyword overrides are a table; it becomes one array, which meets every document in its own row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import extension
from ..functions.text import rule_text
from . import rules as R


def plain_term(term: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9.<>\s]+", " ", re.sub(r"[#/\\_-]+", " ", term.lower()))).strip()


def has_term(text: Column, term: str, dense: Column | None = None, words: Column | None = None) -> Column:
    """Substring of rule_text(); a term of letters and digits also matches across blanks. Where they are given, `dense` is
    the text without blanks, and `words` its different words between blanks: a term lies in the text only if each of its
    words lies in one of these, and a term of one word if it does."""
    plain = plain_term(term)
    if words is None:
        found = text.contains(plain)
    else:
        found = words.contains(max(plain.split(" "), key=len))
        found = found & text.contains(plain) if " " in plain else found
    if re.fullmatch(r"[a-z]+\s*\d+", plain):
        found = found | (F.replace(text, F.lit(" "), F.lit("")) if dense is None else dense).contains(plain.replace(" ", ""))
    return found


def different_words(text: Column) -> Column:
    """The different words of a text in one text, between blanks."""
    return F.array_join(F.array_distinct(F.split(text, " ")), " ")


def rule_score(name: Column, body: Column, terms: dict[str, float], dense: Column | None = None, words: Column | None = None) -> Column:
    """A term in the file name or path counts 1.8 times, and then not again in the body."""
    out = F.lit(0.0)
    for term, weight in terms.items():
        out = out + F.when(has_term(name, term), weight * 1.8).when(has_term(body, term, dense, words), float(weight)).otherwise(0.0)
    return out


def scores(name: Column, body: Column, table: dict, dense: Column | None = None, words: Column | None = None) -> Column:
    """One number for each rule, in the table's order."""
    return F.array(*(rule_score(name, body, spec[1] if isinstance(spec, tuple) else spec, dense, words) for spec in table.values()))


def ranked(scored: Column, table: dict, default_least: float = 1) -> Column:
    """Array of (score, order, rule) of all rules that reach their least score, the best first; scored: as of scores()."""
    least = F.array(*(F.lit(float(spec[0] if isinstance(spec, tuple) else default_least)) for spec in table.values()))
    names = F.array(*map(F.lit, table))
    rows = F.transform(scored, lambda s, i: F.struct(s.alias("score"), (-i).alias("order"), F.get(names, i).alias("rule")))
    return F.reverse(F.array_sort(F.filter(rows, lambda r: r["score"] >= F.get(least, -r["order"]))))


def override_pairs(overrides: DataFrame) -> DataFrame:
    """One row with all overrides (folder_id, keyword, role, weight) that change a score, in order: folder, keyword in
    rule_text(), its form without blanks if it is letters and digits, and what it adds. Positive ones add 12 times their
    weight (0.5 to 3), negative ones take 14 times; ignored ones do nothing."""
    w = F.greatest(F.lit(0.5), F.least(F.lit(3.0), F.coalesce(F.nullif(F.col("weight").cast("double"), F.lit(0.0)), F.lit(1.0))))
    rows = overrides.filter(F.col("role").isin("positive", "negative")).select(
        "folder_id", rule_text(F.col("keyword")).alias("keyword"), F.when(F.col("role") == "positive", 12.0 * w).otherwise(-14.0 * w).alias("score"))
    dense = F.when(F.col("keyword").rlike(r"^[a-z]+\s*[0-9]+$"), F.replace("keyword", F.lit(" "), F.lit("")))
    return rows.filter("keyword <> ''").agg(F.array_sort(F.collect_list(F.struct("folder_id", "keyword", dense.alias("dense"), "score"))).alias("_o"))


def confidence(top: Column, second: Column, quality: Column) -> Column:
    """From 0.15 to 0.98; 0.2 if nothing scored."""
    c = (0.38 + F.least(top, F.lit(32.0)) / 48 - F.least(F.lit(0.2), second / (top + second) * 0.28)
         - F.when(quality < 45, 0.08).otherwise(0.0))
    return F.when(top <= 0, 0.2).otherwise(F.least(F.lit(0.98), F.greatest(F.lit(0.15), c)))


def needs_review(kind: Column, conf: Column, top: Column, quality: Column, words: Column, failed: Column | None = None) -> Column:
    out = (kind == "unknown") | (conf < 0.55) | (top < 7) | ((quality < 35) & (top < 18)) | ((words > 0) & (words < 10) & (top < 12))
    return out if failed is None else out | failed


def suggested(docs: DataFrame, types: dict = R.TYPES, subjects: dict = R.SUBJECTS, overrides: DataFrame | None = None,
              tree=R.FOLDERS) -> DataFrame:
    """doc_id, document_type, subject, primary_folder, top_score, confidence, review, secondary, folder_ids, alternatives,
    reasons.

    docs: doc_id, file_name, file_path, category, clean_text, quality, word_count. overrides: folder_id, keyword, role,
    weight of users' edits, a table as small as a person's work; they travel as one row.
    """
    name = rule_text(F.concat_ws(" ", "file_name", "file_path"))
    body = rule_text(F.concat_ws("\n", "file_name", "file_path", "category", "clean_text"))
    step = docs.withColumns({"_name": name, "_body": body, "_ext": extension(F.col("file_name"))})
    step = step.withColumns({"_words": different_words(F.col("_body")), "_dense": F.when(F.col("_body").rlike("[0-9]"), F.replace("_body", F.lit(" "), F.lit(""))).otherwise("")})
    more = {"dense": F.col("_dense"), "words": F.col("_words")}
    records = F.lit(None).cast("string")
    for f, terms in reversed(R.RECORD_FOLDERS):
        some = F.lit(False)
        for term in terms:
            some = some | has_term(F.col("_body"), term, **more)
        records = F.when(some, f).otherwise(records)
    # every term is looked for once
    step = step.withColumns({"_ts": scores(F.col("_name"), F.col("_body"), types, **more), "_ss": scores(F.col("_name"), F.col("_body"), subjects, **more), "_record": records})
    step = step.withColumns({"_types": ranked(F.col("_ts"), types), "_subjects": ranked(F.col("_ss"), subjects)})
    code = F.col("_ext").isin(*R.CODE_EXTENSIONS)
    kind = F.coalesce(F.get("_types", 0)["rule"], F.when(code, "code-project"), F.lit("unknown"))
    subject = F.coalesce(F.get("_subjects", 0)["rule"], F.lit("general"))
    step = step.withColumns({"document_type": kind, "subject": subject})

    # one look-up for each place that asks, instead of a branch for each rule
    special = F.create_map(*(F.lit(x) for t, per in R.SUBJECT_FOLDERS.items() for s, f in per.items() for x in (f"{t}|{s}", f)))
    default = F.create_map(*(F.lit(x) for kv in R.TYPE_FOLDERS.items() for x in kv))

    def folder_of(k: Column) -> Column:
        return F.coalesce(F.when(k == "academic-record", F.col("_record")), F.try_element_at(special, F.concat(k, F.lit("|"), F.col("subject"))), F.try_element_at(default, k), F.lit("other"))

    pair = lambda f, s, why: F.struct(f.alias("folder"), s.cast("double").alias("score"), why.alias("why"))
    none = F.array().cast("array<struct<folder:string,score:double,why:string>>")
    rule = lambda c, i: F.get(c, i)["rule"]
    both = F.concat_ws(" + ", F.coalesce(rule("_types", 0), F.lit("file type")), rule("_subjects", 0))
    type_score = F.coalesce(F.get("_types", 0)["score"], F.when(code, 8.0), F.lit(0.0))
    primary = type_score + F.least(F.coalesce(F.get("_subjects", 0)["score"], F.lit(0.0)), F.lit(14.0))
    parts = [F.when((folder_of(F.col("document_type")) != "other") & (primary > 0), F.array(pair(folder_of(F.col("document_type")), primary, both))).otherwise(none)]
    parts += [F.when(F.size("_types") > i, F.array(pair(folder_of(F.get("_types", i)["rule"]), F.get("_types", i)["score"] * 0.65, F.concat(F.lit("secondary type signal: "), rule("_types", i))))).otherwise(none) for i in (1, 2, 3)]
    parts += [F.when(F.col("category") == c, F.array(pair(F.lit(f), F.lit(s), F.lit(f"{c} classifier result")))).otherwise(none) for c, (f, s) in R.CATEGORY_FOLDERS.items()]
    parts.append(F.when(code, F.array(pair(folder_of(F.lit("code-project")), F.lit(7.0), F.lit("source code file extension")))).otherwise(none))
    step = step.withColumn("_p", F.concat(*parts))
    kind_folder = F.lit(None).cast("string")
    for f, exts in R.FILE_FOLDERS.items():
        kind_folder = F.when(F.col("_ext").isin(*exts), f).otherwise(kind_folder)
    step = step.withColumn("_p", F.when((F.size("_p") == 0) & kind_folder.isNotNull(), F.array(pair(kind_folder, F.lit(1.5), F.concat("_ext", F.lit(" file type"))))).otherwise(F.col("_p")))
    if overrides is not None:
        step = step.join(F.broadcast(override_pairs(overrides)))
        joined = F.replace("_body", F.lit(" "), F.lit(""))  # of texts without digits too: a keyword is any letters and digits
        fits = F.filter("_o", lambda o: F.col("_body").contains(o["keyword"]) | F.coalesce(joined.contains(o["dense"]), F.lit(False)))
        step = step.withColumn("_p", F.concat("_p", F.transform(fits, lambda o: F.struct(
            o["folder_id"].alias("folder"), o["score"].alias("score"), F.concat(F.when(o["score"] > 0, "user positive keyword: ").otherwise("user negative keyword: "), o["keyword"]).alias("why")))))
    flat = [x for x in R.flat_folders(tree) if x[0] != "all-files"]
    total = lambda f: F.aggregate(F.filter("_p", lambda x: x["folder"] == f), F.lit(0.0), lambda a, x: a + x["score"])
    reasons = lambda f: F.array_distinct(F.transform(F.filter("_p", lambda x: x["folder"] == f), lambda x: x["why"]))
    used = F.array_distinct(F.transform("_p", lambda x: x["folder"]))
    order = F.create_map(*(F.lit(v) for x in flat for v in (x[0], x[4])))
    ranks = F.transform(F.filter(used, lambda f: F.map_contains_key(order, f)),
                        lambda f: F.struct((-total(f)).alias("minus"), F.array_position(used, f).alias("seen"), f.alias("folder"), reasons(f).alias("why")))
    step = step.withColumn("_r", F.array_sort(ranks)).select("doc_id", "document_type", "subject", "quality", "word_count", "_r")
    top, second = F.coalesce(-F.get("_r", 0)["minus"], F.lit(0.0)), F.coalesce(-F.get("_r", 1)["minus"], F.lit(0.0))
    step = step.withColumns({"top_folder": F.coalesce(F.get("_r", 0)["folder"], F.lit("other")), "top_score": top, "_c": confidence(top, second, F.col("quality"))})
    step = step.withColumn("review", needs_review(F.col("document_type"), F.col("_c"), F.col("top_score"), F.col("quality"), F.col("word_count")))
    step = step.withColumn("primary_folder", F.when(F.col("review"), "review-needed").otherwise(F.col("top_folder")))
    secondary = F.slice(F.transform(F.filter("_r", lambda x: (x["folder"] != F.col("primary_folder")) & (x["minus"] <= -7)), lambda x: x["folder"]), 1, 5)
    step = step.withColumn("secondary", secondary)
    parents = F.create_map(*(F.lit(v) for x in flat if x[2] for v in (x[0], x[2])))
    up = lambda f: F.array_compact(F.array(F.try_element_at(parents, f)))
    closure = F.concat(F.array("primary_folder"), up(F.col("primary_folder")),
                       F.when(F.col("review"), F.concat(F.array("top_folder"), up(F.col("top_folder")))).otherwise(F.array().cast("array<string>")),
                       F.col("secondary"), F.flatten(F.transform("secondary", up)),
                       F.when(F.col("review"), F.array(F.lit("review-needed"))).otherwise(F.array().cast("array<string>")))
    rest = F.slice(F.transform(F.filter("_r", lambda x: x["folder"] != F.col("primary_folder")),
                               lambda x: F.struct(x["folder"].alias("folder"), (F.floor(-x["minus"] * 10 + 0.5) / 10).alias("score"))), 1, 3)
    return step.select("doc_id", "document_type", "subject", "primary_folder", "top_folder", "top_score",
                       (F.floor(F.col("_c") * 100 + 0.5) / 100).alias("confidence"), "review", "secondary",
                       F.array_distinct(closure).alias("folder_ids"), rest.alias("alternatives"), F.slice(F.coalesce(F.get("_r", 0)["why"], F.array().cast("array<string>")), 1, 3).alias("reasons"))


def search_text(suggestions: DataFrame, folders: DataFrame) -> DataFrame:
    """doc_id, folders: what a search for a document's place reads: type, subject, and the paths of all its folders."""
    each = suggestions.select("doc_id", F.posexplode("folder_ids").alias("at", "folder_id")).join(F.broadcast(folders.select("folder_id", "display_path")), "folder_id")
    paths = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "display_path"))).alias("p"))
    rows = suggestions.select("doc_id", "document_type", "subject").join(paths, "doc_id", "left")
    return rows.select("doc_id", F.concat_ws(" ", "document_type", "subject", F.transform("p", lambda x: x["display_path"])).alias("folders"))
