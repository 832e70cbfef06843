"""Models in Python workers: batches go to them over Arrow, and a worker loads its model once.

Which models there are is the caller's matter: none comes with this package. Key phrases without one are in enrich.
"""

from __future__ import annotations

import importlib.util
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOADED: dict[str, object] = {}


def loaded(name: str, make: Callable[[], object]):
    """The model of that name, made at its first use in this process."""
    if name not in _LOADED:
        _LOADED[name] = make()
    return _LOADED[name]


def by_model(docs: DataFrame, name: str, make: Callable[[], object], apply: Callable[[object, str], object], kind: str, text: str = "text", to: str = "output",
             seconds: str | None = None) -> DataFrame:
    """docs with what apply(model, text) gives for each row, of type `kind`, and `error` where it failed: one bad text
    doesn't end the job, but a model that can't be made does. Null texts are empty. seconds: a column for each row's time."""

    extra = [to, "error", *([seconds] if seconds else [])]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in extra) + f", `{to}` {kind}, error string" + (f", `{seconds}` double" if seconds else "")

    def run(batches):
        for pdf in batches:
            out, errors, times = [], [], []
            model = loaded(name, make) if len(pdf) else None
            for t in pdf[text].fillna(""):
                began = time.perf_counter()
                try:
                    out.append(apply(model, t))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - the row says so
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
                times.append(time.perf_counter() - began)
            made = {to: pd.Series(out, index=pdf.index, dtype=object), "error": pd.Series(errors, index=pdf.index, dtype=object)} | ({seconds: times} if seconds else {})
            yield pdf.drop(columns=extra, errors="ignore").assign(**made)

    return docs.drop(*extra).mapInPandas(run, schema)


def capabilities(libraries: dict[str, str]) -> dict[str, bool]:
    """Which of the named abilities there are, by whether the library of each can be found."""
    return {what: importlib.util.find_spec(library) is not None for what, library in libraries.items()}


def combined(keyphrases, nouns, limit: int = 24):
    """At most `limit` different phrases, key phrases first."""
    from .enrich import different

    none = F.array().cast("array<string>")
    return different(F.concat(F.coalesce(keyphrases, none), F.coalesce(nouns, none)), limit)
