"""Refreshing what is derived in a stored library, for the documents that changed alone.

The change logs name the documents whose row, pages, paths or jobs changed since the last refresh; the derivation is the
one for all, on tables that hold only those documents' rows. Few ids are a filter that reaches the files, which lie
sorted by document once a table is compacted; many are a join. The refresh and its mark are one version, so a refresh
that breaks off is done again, and its own rows don't count as changes.

Cases: a table whose log was merged after the last refresh gives no list of changes, so everything is refreshed, as it is
the first time; a document that is deleted has nothing to refresh; no changes make no version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.library import Library
from . import refresh

#: What a document is derived from, and how many ids travel in a filter.
SOURCES, FEW = ("documents", "pages", "document_paths", "jobs"), 1000
MARK = "refreshed"


def touched(library: Library) -> DataFrame | None:
    """document_id of what changed since the last refresh; None if that can't be told, so all did."""
    since = library.state["marks"].get(MARK)
    if since is None:
        return None
    out = library.spark.createDataFrame([], "document_id string")
    for name in SOURCES:
        keys = library.keys_since(name, int(since))
        if keys is None:
            return None
        out = out.unionByName(keys.select("document_id"))
    return out.distinct()


def of_documents(library: Library, name: str, ids: DataFrame | None) -> DataFrame:
    """A table's rows of these documents, or of all."""
    rows = library.table(name)
    if ids is None:
        return rows
    few = [r["document_id"] for r in ids.limit(FEW + 1).collect()]
    return rows.filter(F.col("document_id").isin(few)) if len(few) <= FEW else rows.join(ids, "document_id", "left_semi")


def refreshed(library: Library, **words) -> Library:
    """The library with the derived columns of its changed documents as refresh.synced() gives them."""
    ids = touched(library)
    if ids is not None and ids.isEmpty():
        return library
    docs, pages, paths, jobs = (of_documents(library, name, ids) for name in SOURCES)
    new = refresh.synced(docs, pages, paths, jobs, **words)
    given = [c for c in docs.columns if c not in new.columns or c == "document_id"]
    rows = docs.select(*given).join(new, "document_id")
    return library.changed({"documents": (rows, None)}, mark=(MARK, str(library.state["last"] + 1)))
