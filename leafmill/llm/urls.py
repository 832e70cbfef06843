"""URL filters: rules found by their rarest literal token, regular expressions run on those candidates only.

A rule's pattern is a regular expression over ``host + path``. Its literal tokens (whole words that every match
contains) are counted over the corpus, and the rule is filed under the rarest. Files are a literal array of hash
slots, so a URL fetches its candidates by position, within the scan: no join, no shuffle, no Python.

Cases: a null url, or one without ``://``, has an empty host and path; repeated rows give a row each; other columns
are left out; rules without any whole token (at least one is needed to be found) are tried on every URL.
The rule list is bounded by its caller and travels in the plan.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str | None
    pattern: str
    tokens: tuple[str, ...] = field(default=())
    weight: int = 0


def site_rule(verdict: str, site: str) -> Rule:
    """`host/path`: the host and all its subdomains, and all paths that start so. The longer rule wins."""
    host, slash, path = site.partition("/")
    whole = re.findall(r"[a-z0-9]+", host.lower())
    whole += re.findall(r"(?<=/)[A-Za-z0-9]+(?=[^A-Za-z0-9])", slash + path)
    quoted = re.sub(r"([^A-Za-z0-9_])", r"\\\1", host.lower()), re.sub(r"([^A-Za-z0-9_])", r"\\\1", slash + path)
    return Rule(verdict, site, rf"^(?:[^/]*\.)?{quoted[0]}{quoted[1]}", tuple(whole), 1_000_000 + len(site))


def word_rule(verdict: str, words: str) -> Rule:
    """The method's own: a host label of these words, such as cheap-pills; it has no name and any site rule wins."""
    quoted = re.sub(r"([^A-Za-z0-9_])", r"\\\1", words)
    return Rule(verdict, None, rf"^(?:[^/]*\.)?{quoted}\.", tuple(re.findall("[a-z0-9]+", words)), len(words))


#: Host labels that the method itself blocks.
SPAM_LABELS = ("spam-farm", "cheap-pills", "casino", "free-money", "click-bait")


def host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    name = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda x: x != ""))


def rarest(pages: DataFrame, rules: list[Rule], url: str = "url") -> dict[str, int]:
    """How many rows have each token that some rule has: at most one number for each such token reaches the driver."""
    names = sorted({t for r in rules for t in r.tokens})
    if not names:
        return {}
    u = F.col(url)
    own = pages.select(F.array_intersect(tokens(F.concat(host(u), path(u))), F.array(*map(F.lit, names))).alias("_t"))
    return {r["_x"]: r["count"] for r in own.select(F.explode("_t").alias("_x")).groupBy("_x").count().collect()}


def judged(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, n_candidates for every row."""
    seen = rarest(pages, rules, url)
    slots = 1 << max(3, (4 * len(rules)).bit_length())
    files: list[list[Column]] = [[] for _ in range(slots)]
    always: list[Column] = []
    for r in rules:
        key = min(r.tokens, key=lambda t: (seen.get(t, 0), t), default=None)
        row = F.struct(F.lit(r.weight).alias("weight"), F.lit(r.name).cast("string").alias("rule"),
                       F.lit(r.verdict).alias("verdict"), F.lit(key).cast("string").alias("token"), F.lit(r.pattern).alias("pattern"))
        (always if key is None else files[zlib.crc32(key.encode()) % slots]).append(row)
    kind = "array<struct<weight:int,rule:string,verdict:string,token:string,pattern:string>>"
    index = F.array(*(F.array(*x).cast(kind) for x in files))
    u = F.col(url)
    parts = pages.select("page_id", host(u).alias("host"), path(u).alias("path"))
    at = lambda t: F.get(index, F.pmod(F.crc32(t), F.lit(slots)).cast("int"))
    found = F.flatten(F.transform(tokens(F.concat("host", "path")), lambda t: F.filter(at(t), lambda r: r["token"] == t)))
    rows = parts.withColumn("_c", F.concat(found, F.array(*always).cast(kind)))
    fits = F.filter("_c", lambda r: F.regexp_like(F.concat("host", "path"), r["pattern"]))
    best = F.array_max(fits)
    return rows.withColumn("_b", best).select(
        "page_id", "host", "path", F.col("_b.rule").alias("rule"),
        F.coalesce(F.col("_b.verdict"), F.lit(default)).alias("verdict"), F.size("_c").cast("long").alias("n_candidates"))
