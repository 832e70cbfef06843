"""Changes to the folder tree and to its keyword rules, and how a document's folders are shown.

Changes are a few rows that a caller names, checked before anything is written; the tables they meet are DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import slug
from ..functions.text import rule_text
from . import store

ROLES = ("positive", "negative", "ignored")


def active(folders: DataFrame) -> DataFrame:
    """Folders that aren't deleted, in the tree's order."""
    return folders.filter("deleted_at is null").orderBy("sort_order", "display_path")


def _one(folders: DataFrame, folder_id: str):
    return folders.filter(F.col("folder_id") == folder_id).head()


def saved(folders: DataFrame, name: str, parent_id: str | None = None, folder_id: str | None = None, stamp: str = "0") -> DataFrame:
    """folders with a user's folder made or renamed. Its name isn't empty, its parent is an active folder (all-files
    stands for none), and system folders keep their names. New ids have the name and `stamp` in them."""
    name = name.strip()
    if not name:
        raise ValueError("a folder needs a name")
    live = folders.filter("deleted_at is null")
    parent_id = None if parent_id == "all-files" else parent_id
    parent = _one(live, parent_id) if parent_id else None
    if parent_id and parent is None:
        raise ValueError(f"unknown parent folder {parent_id}")
    old = _one(live, folder_id) if folder_id else None
    if old is not None and old["source"] != "user":
        raise ValueError("system folders can't be renamed")
    path = f"{parent['display_path']} / {name}" if parent else name
    last = folders.agg(F.max("sort_order").alias("sort_order"))
    id_ = F.lit(old["folder_id"]) if old else F.concat(F.lit("user-"), slug(F.lit(name)), F.lit(f"-{stamp}"))
    new = last.select(id_.alias("folder_id"), F.lit(name).alias("name"), F.lit(parent_id).cast("string").alias("parent_id"), F.lit(path).alias("display_path"),
                      (F.lit(old["sort_order"]) if old else F.coalesce("sort_order", F.lit(0)) + 1).cast("int").alias("sort_order"),
                      F.lit("user").alias("source"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return store.upserted(folders, new, ["folder_id"])


def with_defaults(folders: DataFrame, defaults: DataFrame) -> DataFrame:
    """folders with today's system folders; those that a user deleted stay deleted."""
    gone = folders.filter("deleted_at is not null").select("folder_id")
    return store.upserted(folders, defaults.join(gone, "folder_id", "left_anti"), ["folder_id"])


def subtree(folders: DataFrame, folder_id: str) -> DataFrame:
    """folder_id of a folder and all below it."""
    return store.ancestors(folders).filter(F.col("ancestor_id") == folder_id).select("folder_id")


def deleted(folders: DataFrame, folder_id: str, at: str) -> DataFrame:
    """folders without the user's folders of a subtree, and with its system folders marked as deleted."""
    if folder_id == "all-files":
        raise ValueError("All Files can't be deleted")
    if _one(folders, folder_id) is None:
        raise ValueError(f"unknown folder {folder_id}")
    gone = subtree(folders, folder_id).withColumn("_gone", F.lit(True))
    rows = folders.join(gone, "folder_id", "left").filter("_gone is null or source <> 'user'")
    return rows.withColumn("deleted_at", F.when(F.col("_gone"), F.lit(at).cast("timestamp")).otherwise(F.col("deleted_at"))).select(*folders.columns)


def without_subtree(rows: DataFrame, folders: DataFrame, folder_id: str) -> DataFrame:
    """Assignments or overrides of other folders; those of the subtree go with it."""
    return rows.join(subtree(folders, folder_id), "folder_id", "left_anti")


def keyword_overrides(given: DataFrame, folders: DataFrame) -> DataFrame:
    """folder_id, keyword, role, weight as they are kept: keywords in rule_text(), roles that aren't known positive,
    weights from 0.5 to 3 (1 if null or 0); of one folder and keyword the last by `at`. Unknown folders and empty
    keywords go."""
    rows = given.join(folders.filter("deleted_at is null").select("folder_id"), "folder_id", "left_semi").select(
        "folder_id", rule_text(F.col("keyword")).alias("keyword"), F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("positive").alias("role"),
        F.greatest(F.lit(0.5), F.least(F.lit(3.0), F.coalesce(F.nullif(F.col("weight").cast("double"), F.lit(0.0)), F.lit(1.0)))).alias("weight"), "at")
    return store.latest(rows.filter("keyword <> ''"), ["folder_id", "keyword"], [F.desc("at"), F.desc("weight"), F.desc("role")]).drop("at")


def touched(docs: DataFrame, assigned: DataFrame, folder_id: str, keyword: str, text: list[str]) -> DataFrame:
    """doc_id of documents to organise again when a folder's keyword changes: any text column has it, in any case and
    with no sign of it special, or the document is in the folder."""
    some = F.lit(False)
    for c in text:
        some = some | F.coalesce(F.lower(c).contains(keyword.lower()), F.lit(False))
    return docs.filter(some).select("doc_id").union(assigned.filter(F.col("folder_id") == folder_id).select("doc_id")).distinct()


def organisation(assigned: DataFrame, folders: DataFrame) -> DataFrame:
    """doc_id, primary_folder, primary_path, secondary_folders, folder_ids, confidence, review. The primary folder is the
    one marked so, or else the first by confidence, order and path; secondary ones are the rest without the primary's
    ancestors and the review folder. A document has a few folders, so its rows are one array."""
    rows = assigned.join(folders.filter("deleted_at is null").select("folder_id", "display_path", "sort_order"), "folder_id")
    key = F.struct((~F.col("is_primary")).alias("other"), (-F.col("confidence")).alias("minus"), "sort_order", "display_path", "folder_id")
    each = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(key)).alias("_r"))
    first = F.get("_r", 0)
    up = store.ancestors(folders).filter("distance > 0").groupBy(F.col("folder_id").alias("_f")).agg(F.collect_set("ancestor_id").alias("_up"))
    each = each.withColumn("_p", first["folder_id"]).join(up, F.col("_p") == F.col("_f"), "left")
    ids = F.transform("_r", lambda r: r["folder_id"])
    above = F.coalesce("_up", F.array().cast("array<string>"))
    rest = F.filter(ids, lambda f: (f != F.col("_p")) & (f != "review-needed") & ~F.array_contains(above, f))
    return each.select("doc_id", F.col("_p").alias("primary_folder"), first["display_path"].alias("primary_path"), rest.alias("secondary_folders"), ids.alias("folder_ids"),
                       (F.floor(-first["minus"] * 100 + 0.5) / 100).alias("confidence"), F.array_contains(ids, "review-needed").alias("review"))


def display_paths(folders: DataFrame) -> DataFrame:
    """folder_id, display_path: the names from the root down, for trees of any depth."""
    up = store.ancestors(folders).join(folders.select(F.col("folder_id").alias("ancestor_id"), "name"), "ancestor_id")
    return up.groupBy("folder_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name"))).alias("p")).select(
        "folder_id", F.array_join(F.transform("p", lambda x: x["name"]), " / ").alias("display_path"))


def documents_in(assigned: DataFrame, folder_ids: DataFrame) -> DataFrame:
    """doc_id of documents in any of the folders, each once."""
    return assigned.join(F.broadcast(folder_ids.select("folder_id").distinct()), "folder_id", "left_semi").select("doc_id").distinct()


def normalised_overrides(rows: DataFrame) -> DataFrame:
    """folder_id, keyword, role, weight of overrides given as JSON (`value`): a list of objects with folderId or folder_id,
    or a map of folders to such lists. Unknown roles and empty keywords go."""
    item = "array<struct<folderId:string,folder_id:string,keyword:string,role:string,weight:double>>"
    listed = rows.filter(F.ltrim("value").startswith("[")).select(F.explode(F.from_json("value", item)).alias("o")).select(F.coalesce("o.folderId", "o.folder_id").alias("folder_id"), "o.keyword", "o.role", "o.weight")
    mapped = rows.filter(F.ltrim("value").startswith("{")).select(F.explode(F.from_json("value", f"map<string,{item}>")).alias("f", "l")).select("f", F.explode("l").alias("o")).select(
        F.col("f").alias("folder_id"), "o.keyword", "o.role", "o.weight")
    both = listed.unionByName(mapped).withColumns({"keyword": rule_text(F.col("keyword")), "role": F.coalesce("role", F.lit("positive"))})
    return both.filter(F.col("role").isin(*ROLES) & (F.col("keyword") != "") & F.col("folder_id").isNotNull()).withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def of_ids(folders: DataFrame, ids: list[str]) -> DataFrame:
    """The named folders that are active, in the tree's order."""
    return active(folders.filter(F.col("folder_id").isin(ids)))


def single_saved(overrides: DataFrame, changes: DataFrame, folders: DataFrame) -> DataFrame:
    """Edits of single documents (doc_id, folder_id, action) with changes: add or remove, of folders that there are, one for
    each document and folder."""
    known = changes.filter(F.col("action").isin("add", "remove")).join(F.broadcast(folders.filter("deleted_at is null").select("folder_id")), "folder_id", "left_semi")
    return store.upserted(overrides, known, ["doc_id", "folder_id"])


def single_deleted(overrides: DataFrame, gone: DataFrame) -> DataFrame:
    return overrides.join(gone.select("doc_id", "folder_id"), ["doc_id", "folder_id"], "left_anti")
