"""Elements of the arrays in large JSON files, read in parts by many tasks.

A file is read in blocks, as its text reader splits it, with the closing brace as the end of a record: so an element of
an array, which is an object, ends where a record does, and no escape is cut in two. Whether a brace counts depends on
what came before: inside a string or not, and how deep. One pass works out for every block what it does to that state
(for both cases of its beginning); the driver puts these few numbers together; a second pass, which knows each block's
beginning, gives the elements that lie in one block, and the pieces of those that don't, which are put together by
their block.

A file is an object of arrays (its sections) or one array, whose section has the name given. What isn't an object in
those arrays is left out, as are sections that aren't arrays. Byte order marks and white space may stand around.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .versions import shared

ESCAPE, TOKEN = re.compile(r"\\.", re.S), re.compile(r'"((?:[^"\\]|\\.)*)"|[\[\]{}:]', re.S)
BLANK = "\ufeff \t\r\n"
#: Rows of a scan: parts are 0 a whole element, 1 the end of one that was open, 2 its middle, 3 its beginning.
FOUND = "file string, block long, part int, n long, section string, value string"


def _outside(record: str, inside: bool) -> tuple[list[str], bool]:
    """The parts of a record outside strings, and whether it ends inside one."""
    parts = ESCAPE.sub("", record).split('"')
    return parts[1 if inside else 0::2], inside ^ (len(parts) % 2 == 0)


def _deeper(record: str, inside: bool) -> tuple[int, bool]:
    own, inside = _outside(record, inside)
    return sum(p.count("{") + p.count("[") - p.count("]") - p.count("}") for p in own), inside


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """(file, block, records) of a partition, whose rows come in the file's order."""
    rows = ((f, b, v) for pdf in batches for f, b, v in zip(pdf["file"], pdf["block"], pdf["value"]))
    for (f, b), own in groupby(rows, key=lambda r: r[:2]):
        yield f, int(b), (r[2] + "}" for r in own)


def _effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for file, block, records in _blocks(batches):
        inside, depth, first = [False, True], [0, 0], None
        for r in records:
            first = r if first is None else first
            for k in (0, 1):
                more, inside[k] = _deeper(r, inside[k])
                depth[k] += more
        yield pd.DataFrame([(file, block, depth[0], inside[0], depth[1], inside[1], first.lstrip(BLANK)[:1])],
                           columns=["file", "block", "d0", "i0", "d1", "i1", "opens"])


def element(text: str, fresh: bool, name: str) -> tuple[str | None, str] | None:
    """The section that begins in a text (None if it goes on) and the object at its end; None if that is no element.
    fresh: the text begins the file, whose array has that name if it is one."""
    string = pending = section = None
    among, depth, root = not fresh, 0, fresh
    for m in TOKEN.finditer(text):
        c = m[0]
        if c[0] == '"':
            string = m[1]
        elif depth:
            depth += (c in "[{") - (c in "]}")
        elif c == ":":
            among, pending = False, string
        elif c in "]}":
            among = False
        elif c == "[":
            if among:
                depth = 1
            elif pending is not None or root:
                among, section, pending = True, name if root else pending, None
            root = False
        elif among:
            return section, text[m.start():]
        elif root:
            root = False
        else:
            depth, pending = 1, None
    return None


def _scan(starts, name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file, block, records in _blocks(batches):
            depth, inside, array = starts.value[file, block]
            level = 1 if array else 2
            is_open = block > 0 and (inside or depth != level)
            out, held, n = [], [], 0
            for r in records:
                more, inside = _deeper(r, inside)
                depth += more
                held.append(r)
                if depth == level and not inside:
                    text, held = "".join(held), []
                    if is_open:
                        out.append((file, block, 1, n, None, text))
                    elif found := element(text, not block and not n, name):
                        out.append((file, block, 0, n, *found))
                    is_open, n = False, n + 1
                    if len(out) == 500:
                        yield pd.DataFrame(out, columns=["file", "block", "part", "n", "section", "value"])
                        out = []
            if held:
                out.append((file, block, 2 if is_open else 3, n, None, "".join(held)))
            yield pd.DataFrame(out, columns=["file", "block", "part", "n", "section", "value"])

    return run


def _joined(name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [(f, b, n, element(v, not b and not n, name)) for f, b, n, v in zip(pdf["file"], pdf["block"], pdf["n"], pdf["value"])]
            yield pd.DataFrame([(f, b, n, *e) for f, b, n, e in own if e], columns=["file", "block", "n", "section", "value"])

    return run


def elements(spark: SparkSession, path: str, name: str = "documents") -> DataFrame:
    """file, section, value: the objects of all arrays, each as its own JSON text."""
    records = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    effects = records.mapInPandas(_effects, "file string, block long, d0 long, i0 boolean, d1 long, i1 boolean, opens string")
    states, last, depth, inside, array = {}, None, 0, False, False
    for r in sorted(effects.toLocalIterator(), key=lambda r: (r["file"], r["block"])):
        if r["file"] != last:
            last, depth, inside, array = r["file"], 0, False, r["opens"] == "["
        states[r["file"], r["block"]] = depth, inside, array
        depth, inside = depth + r["d1" if inside else "d0"], r["i1" if inside else "i0"]
    at = f"{shared(spark)}/elements-{uuid.uuid4().hex}"
    records.mapInPandas(_scan(spark.sparkContext.broadcast(states), name), FOUND).write.parquet(at)
    found = spark.read.schema(FOUND).parquet(at)
    # pieces belong to the last beginning before them; of a block there are two at most
    along = Window.partitionBy("file").orderBy("block", "part")
    begun = F.last(F.when(F.col("part") == 3, F.struct("block", "n")), ignorenulls=True).over(along)
    pieces = found.filter("part > 0").withColumn("_b", begun).groupBy("file", F.col("_b.block").alias("block"), F.col("_b.n").alias("n")).agg(
        F.max((F.col("part") == 1).cast("int")).alias("_whole"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "value"))), lambda p: p["value"]), "").alias("value"))
    rows = pieces.filter("_whole = 1").drop("_whole").mapInPandas(_joined(name), "file string, block long, n long, section string, value string")
    every = found.filter("part = 0").drop("part").unionByName(rows)
    # a section goes on until the next begins: within a block, and from block to block
    ends = every.filter("section IS NOT NULL").groupBy("file", "block").agg(F.max_by("section", "n").alias("_s"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = every.select("file", "block").distinct().join(ends, ["file", "block"], "left").withColumn("_before", F.last("_s", ignorenulls=True).over(before))
    own = F.last("section", ignorenulls=True).over(Window.partitionBy("file", "block").orderBy("n"))
    return every.withColumn("_own", own).join(blocks.drop("_s"), ["file", "block"]).select("file", F.coalesce("_own", "_before").alias("section"), "value")
