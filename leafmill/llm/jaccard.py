"""Near-duplicate documents: an exact join of word n-gram sets by their Jaccard similarity.

Steps. Equal texts count once. Every set's hashes are counted over the corpus, bucket by bucket, so that each set can
be ordered from its rarest member on. Two sets that are similar enough share one of their first n - ceil(s n) + 1
members in that order, and each has at least ceil(s n) members that some other text has too; all other documents are
alone and stay where they are. Documents that share such a member form candidate groups. A group is compared in tiles:
sorted by size, each set against those at most 1/s times as large, first by hashed bitmaps (a bit that one has and the
other lacks is a member it lacks, which bounds the overlap from above), then by exact intersection of sorted arrays.
Within a tile, pairs that are linked already are left out: classes come out the same, and a group of copies costs about
one comparison a document. Where links are to be counted, no pair is left out: every pair of different texts is verified
once, which in a group of m near copies takes m squared comparisons. Groups of over TILE documents, or of over WEIGHT
bytes of members, are cut into bands of sizes, such that only sets of one band or of two next to each other can be
similar, and large bands into chunks by hash; each pair of chunks that may have links is a tile of its own, so no task
ever holds more than two chunks.

Cases: null or wordless texts have an empty set and stand alone, even if equal; a text of fewer than n words is one
n-gram as a whole; rows that repeat a doc_id count as one document whose links are the rows' together; extra columns
are left out; an empty table gives no rows. Members are compared by 64-bit hash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U64

BUCKET = 2_000_000
#: Documents, and bytes of their members, in a chunk of a candidate group.
TILE, WEIGHT = 1024, 32 << 20
BITS = 1024

#: A-Z as a-z, and which bytes end a word.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True


def shingles(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all different word n-grams, text by text and sorted in each; and how many each text has."""
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    lens = np.array([len(x) for x in texts], dtype=np.int64)
    first = np.cumsum(lens + 1) - lens - 1
    gap = SPACE[data]
    edge = np.diff(np.concatenate([[1], gap.view(np.int8), [1]]))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word = common.Prefixes(data).of(start, end) + (end - start).astype(U64) * U64(common.BASE)
    text = np.searchsorted(first, start, "right") - 1
    n_words = np.bincount(text, minlength=len(texts))
    factor = common.powers(n + 1, common.BASE)
    count = max(0, len(word) - n + 1)
    total = np.zeros(count, dtype=U64)
    for k in range(n):
        total += word[k:k + count] * factor[k]
    whole = text[:count] == text[n - 1:n - 1 + count]
    owner, grams = text[:count][whole], common.mixed(total[whole] + U64(n))
    for i in np.flatnonzero((n_words > 0) & (n_words < n)):
        a = int(np.searchsorted(text, i))
        short = (word[a:a + n_words[i]] * factor[:n_words[i]]).sum(dtype=U64)
        owner, grams = np.append(owner, i), np.append(grams, common.mixed(np.array([short + U64(int(n_words[i]))], dtype=U64)))
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    if len(grams):
        new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])])
        owner, grams = owner[new], grams[new]
    return grams, np.bincount(owner, minlength=len(texts))


def _parts(pdf: pd.DataFrame):
    own = pdf.drop_duplicates("digest").sort_values("doc_id", kind="stable")
    ids, digests, data = own["doc_id"].tolist(), own["digest"].tolist(), own["data"].tolist()
    for a, b in common.chunked(data):
        yield ids[a:b], digests[a:b], data[a:b]


def _split(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits more, as one number."""
    return (grams >> U64(32)) % U64(buckets) << U64(32) | grams & U64(0xFFFFFFFF)


def _counted(rows: DataFrame) -> DataFrame:
    """(block, bucket, keys, commonness): the keys that more than one text has; commonness is a quarter of an octave."""

    def run(pdf):
        keys = [common.grown(x) for x in pdf["keys"]]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        every = every[order]
        n = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in pdf["counts"]])[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        total = np.add.reduceat(n, first)
        some = total > 1
        twice, level = every[first][some], np.minimum(255, 4 * np.log2(total[some])).astype(np.uint8)
        out = []
        for block, own in zip(pdf["block"], keys):
            hit = own[common.member(own, twice)]
            if len(hit):
                out.append((block, pdf["bucket"].iloc[0], common.shrunk(hit), level[np.searchsorted(twice, hit)].tobytes()))
        del keys, every, order, n
        common.given_back()
        return pd.DataFrame(out, columns=["block", "bucket", "keys", "commonness"])

    return rows.groupBy("bucket").applyInPandas(run, "block int, bucket int, keys binary, commonness binary")


def active(docs: DataFrame, own: DataFrame, n: int, num: int, den: int, text: str) -> DataFrame:
    """(node, digest, size, grams, tokens): grams (sorted hashes) and tokens (members by which to find partners) only
    where the text can have a partner."""
    table, total = common.blocks(docs, own, text)
    buckets = int(max(2 * common.cores(docs.sparkSession), total / 6 // BUCKET + 1))

    def counts(pdf):
        found = [_split(shingles(data, n)[0], buckets) for _, _, data in _parts(pdf)]
        keys, times = np.unique(np.concatenate(found) if found else np.zeros(0, dtype=U64), return_counts=True)
        del found
        common.given_back()
        bucket, low, times = (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype("<u4"), np.minimum(times, 255).astype(np.uint8)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else []
        rows = [(int(bucket[a]), int(pdf["block"].iloc[0]), common.shrunk(low[a:b]), times[a:b].tobytes()) for a, b in zip(cut, [*cut[1:], len(keys)])]
        return pd.DataFrame(rows, columns=["bucket", "block", "keys", "counts"])

    known = _counted(table.groupBy("block").applyInPandas(counts, "bucket int, block int, keys binary, counts binary"))

    def chosen(key, pdf, ties):
        keys = np.concatenate([np.zeros(0, dtype=U64), *(common.grown(k).astype(U64) | U64(int(b)) << U64(32) for k, b in zip(ties["keys"], ties["bucket"]))])
        level = np.concatenate([np.zeros(0, dtype=np.uint8), *(np.frombuffer(x, dtype=np.uint8) for x in ties["commonness"])])
        order = np.argsort(keys)
        keys, level = keys[order], level[order]
        out = []
        for ids, digests, data in _parts(pdf):
            grams, sizes = shingles(data, n)
            name = _split(grams, buckets)
            hit = common.member(name, keys)
            rank = np.zeros(len(grams), dtype=np.int64)
            rank[hit] = level[np.searchsorted(keys, name[hit])].astype(np.int64) + 1
            ends = np.cumsum(sizes)
            for i, (d, g, m, z) in enumerate(zip(ids, digests, sizes, ends)):
                least = -(-num * int(m) // den)
                r = rank[z - m:z]
                if m and (r > 0).sum() >= least:
                    x = grams[z - m:z]
                    prefix = np.lexsort((x, r))[:m - least + 1]
                    tokens = x[prefix[r[prefix] > 0]]
                    if len(tokens):
                        out.append((d, g, int(m), x.tobytes(), tokens.astype(np.int64)))
                        continue
                out.append((d, g, int(m), None, None))
        common.given_back()
        return pd.DataFrame(out, columns=["node", "digest", "size", "grams", "tokens"]).astype({"node": "Int64"})

    return table.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(
        chosen, "node long, digest binary, size long, grams binary, tokens array<long>")


def bitmaps(arrays: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    out = np.zeros((len(arrays), bits), dtype=bool)
    out[np.repeat(np.arange(len(arrays)), [len(x) for x in arrays]), (np.concatenate(arrays) % U64(bits)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def tile_links(nodes: np.ndarray, chunk: np.ndarray, arrays: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that make the same classes as all links of the tile. Between two chunks, only pairs across them count."""
    size = np.array([len(x) for x in arrays], dtype=np.int64)
    order = np.lexsort((nodes, size))
    nodes, chunk, size, arrays = nodes[order], chunk[order], size[order], [arrays[i] for i in order]
    across = len(set(chunk.tolist())) > 1
    maps = bitmaps(arrays)
    label = np.arange(len(nodes))
    links = []
    for a in range(len(nodes) - 1):
        last = np.searchsorted(size, size[a] * den // num, "right")
        near = np.arange(a + 1, last)
        near = near[label[near] != label[a]]
        if across:
            near = near[chunk[near] != chunk[a]]
        if not len(near):
            continue
        mine, theirs = maps[a], maps[near]
        most = np.minimum(size[a] - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64),
                          size[near] - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64))
        least = -(-num * (size[a] + size[near]) // (num + den))
        near = near[most >= least]
        step = 8
        while len(near):
            some, near = near[:step], near[step:]
            step = min(256, 4 * step)
            flat = np.concatenate([arrays[b] for b in some])
            shared = np.add.reduceat(common.member(flat, arrays[a]).astype(np.int64), np.cumsum(size[some]) - size[some])
            for b in some[shared * (num + den) >= num * (size[a] + size[some])]:
                if label[b] != label[a]:
                    links.append((nodes[a], nodes[b]))
                    label[label == label[b]] = label[a]
            near = near[label[near] != label[a]]
    return links


def tile_counts(nodes: np.ndarray, side: np.ndarray, arrays: list[np.ndarray], weights: np.ndarray, across: bool, num: int, den: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """As tile_links(), and the sum of the weights of all that each member is linked with: every pair is compared."""
    size = np.array([len(x) for x in arrays], dtype=np.int64)
    order = np.lexsort((nodes, size))
    nodes, side, size, weights, arrays = nodes[order], side[order], size[order], weights[order].astype(np.int64), [arrays[i] for i in order]
    maps = bitmaps(arrays)
    label, total, links = np.arange(len(nodes)), np.zeros(len(nodes), dtype=np.int64), []
    for a in range(len(nodes) - 1):
        near = np.arange(a + 1, np.searchsorted(size, size[a] * den // num, "right"))
        if across:
            near = near[side[near] != side[a]]
        if not len(near):
            continue
        mine, theirs = maps[a], maps[near]
        most = np.minimum(size[a] - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64),
                          size[near] - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64))
        near = near[most >= -(-num * (size[a] + size[near]) // (num + den))]
        step = int(max(1, (1 << 19) // size[a]))  # a few megabytes at a time
        for some in (near[i:i + step] for i in range(0, len(near), step)):
            flat = np.concatenate([arrays[b] for b in some])
            shared = np.add.reduceat(common.member(flat, arrays[a]).astype(np.int64), np.cumsum(size[some]) - size[some])
            hit = some[shared * (num + den) >= num * (size[a] + size[some])]
            total[a] += weights[hit].sum()
            total[hit] += weights[a]
            for b in hit[label[hit] != label[a]]:
                if label[b] != label[a]:
                    links.append((nodes[a], nodes[b]))
                    label[label == label[b]] = label[a]
    out = np.empty_like(total)
    out[order] = total
    return links, out


def band(size: Column, num: int, den: int) -> Column:
    """Sets that are similar enough have sizes in one band or in two next to each other: a band is hardly wider than the
    largest ratio of their sizes."""
    return F.floor(F.log(size) / max(1e-6, math.log(den / num) * (1 + 1e-9))).cast("int")


def _tiles(members: DataFrame, num: int, den: int) -> DataFrame:
    """(node, digest, component, bundle, lo, i, hi, j, side) of members (node, digest, size, component): the tiles in
    which each is compared.

    A component of up to TILE members and WEIGHT bytes is one tile. A larger one is cut into bands, a larger band into
    chunks by hash, and a tile is a chunk with itself, with another one of its band or with one of the band above.
    """
    spark = members.sparkSession
    chunked = F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum(F.col("size") * 8) / WEIGHT)).cast("int")
    sizes = members.groupBy("component").agg(chunked.alias("_n"))
    dealt = members.join(sizes, "component")
    bundles = max(2 * common.cores(spark), members.count() // 400)
    no = F.lit(-1)
    small = dealt.filter("_n <= 1").select(
        "node", "digest", "component", F.pmod(F.xxhash64("component"), F.lit(bundles)).alias("bundle"), no.alias("lo"), no.alias("i"), no.alias("hi"), no.alias("j"), F.lit(0).alias("side"))
    large = dealt.filter("_n > 1").withColumn("_b", band(F.col("size"), num, den))
    chunks = large.groupBy("component", "_b").agg(chunked.alias("_k"))
    near = lambda step, k: chunks.select("component", (F.col("_b") + step).alias("_b"), F.col("_k").alias(k))
    rows = large.join(chunks, ["component", "_b"]).join(near(-1, "_up"), ["component", "_b"], "left").join(near(1, "_down"), ["component", "_b"], "left")
    own, b = F.pmod(F.xxhash64("digest"), F.col("_k")).cast("int"), F.col("_b")
    none = F.array().cast("array<int>")
    upto = lambda k: F.when(F.coalesce(F.col(k), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(k) - 1)).otherwise(none)
    tile = lambda lo, i, hi, j, side: F.struct(lo.alias("lo"), i.alias("i"), hi.alias("hi"), j.alias("j"), side.alias("side"))
    each = rows.withColumn("_c", own)
    c = F.col("_c")
    tiles = F.concat(F.transform(upto("_k"), lambda x: tile(b, F.least(x, c), b, F.greatest(x, c), (c > x).cast("int"))),
                     F.transform(upto("_up"), lambda x: tile(b, c, b + 1, x, F.lit(0))), F.transform(upto("_down"), lambda x: tile(b - 1, x, b, c, F.lit(1))))
    many = each.select("node", "digest", "component", F.col("component").alias("bundle"), F.explode(tiles).alias("_t")).select("node", "digest", "component", "bundle", "_t.*")
    return small.unionByName(many)


def _links(rows: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links within the candidate groups (node, component)."""
    members = common.stored(rows.select("node", "digest", "size").join(groups, "node"), "members")
    tiles = _tiles(members, num, den)

    def run(pdf):
        out = []
        for _, own in pdf.groupby("component", sort=False):
            if len(own) > 1:
                out += tile_links(own["node"].to_numpy(), own["side"].to_numpy(), [np.frombuffer(x, dtype="<u8") for x in own["grams"]], num, den)
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.select("node", "digest", "grams").join(tiles, ["node", "digest"]).drop("digest").groupBy("bundle", "lo", "i", "hi", "j").applyInPandas(run, "a long, b long")


def _counts(rows: DataFrame, groups: DataFrame, copies: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (a, b) as of _links(), and rows (digest, n): n other rows, without copies of the text, are linked with a text
    in a tile. A tile gives at most two rows for each of its members."""
    members = common.stored(rows.select("node", "digest", "size").join(groups, "node"), "members")
    tiles = _tiles(members, num, den)

    def run(pdf):
        out = []
        for _, own in pdf.groupby("component", sort=False):
            if len(own) > 1:
                across = (own["lo"].iloc[0], own["i"].iloc[0]) != (own["hi"].iloc[0], own["j"].iloc[0])
                links, total = tile_counts(own["node"].to_numpy(), own["side"].to_numpy(), [np.frombuffer(x, dtype="<u8") for x in own["grams"]],
                                           own["n_copies"].to_numpy(), across, num, den)
                out += [(a, b, None, None) for a, b in links] + [(None, None, d, n) for d, n in zip(own["digest"], total) if n]
        return pd.DataFrame(out, columns=["a", "b", "digest", "n"]).astype({"a": "Int64", "b": "Int64", "n": "Int64"})

    weights = copies.select("digest", "n_copies").distinct()
    data = rows.select("node", "digest", "grams").join(tiles, ["node", "digest"]).join(weights, "digest")
    return data.groupBy("bundle", "lo", "i", "hi", "j").applyInPandas(run, "a long, b long, digest binary, n long")


def linked(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, text: str = "text", count: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; documents of one component are linked by similarities of at
    least num / den. With `count`, also n_links: how many other rows have a text that is so similar, copies among them;
    texts whose rows all lack a doc_id are compared with copies only."""
    own = common.stored(common.copies(docs, text), "copies")
    rows = common.stored(active(docs, own, n, num, den, text), "shingles")
    live = rows.filter(F.col("tokens").isNotNull() & F.col("node").isNotNull())
    each = live.select("node", F.explode("tokens").alias("token"))
    least = each.groupBy("token").agg(F.min("node").alias("m"), F.max("node").alias("_x"), F.count(F.lit(1)).alias("_n")).filter("m <> _x").drop("_x")
    groups = common.components(common.met(each, common.stored(least, "least"), "token", "_n").select(F.col("node").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
    common.swept(docs.sparkSession)
    # rows that repeat a doc_id with other texts are one node
    groups = common.stored(groups, "groups")
    if count:
        both = common.stored(_counts(live, groups, own, num, den), "links")
        links, sums = both.filter("a is not null").select("a", "b"), both.filter("a is null").groupBy("digest").agg(F.sum("n").alias("_n"))
    else:
        links = _links(live, groups, num, den)
    classes = common.components(links)
    each = rows.select("digest", "size", "node").join(classes, "node", "left").select("digest", "size", "component")
    if count:
        each = each.join(sums, "digest", "left")
    found = common.with_facts(own, common.stored(each, "classes"))
    return found.select("doc_id", F.col("size").alias("n_shingles"),
                        F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id"),
                        *([F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("n_copies") - 1 + F.coalesce("_n", F.lit(0))).cast("long").alias("n_links")] if count else []))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, text: str = "text") -> DataFrame:
    """The row of docs with the smallest doc_id of each component; of rows that repeat it, one of each text that there
    is under it. Rows without words all stay, and so does one row of each text that has no doc_id at all."""
    first = linked(docs, n, num, den, text).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    key, none = F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none")
    rows = docs.select(key, none, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"), common.whole_rows(docs))
    # the join deals rows by id, which serves the aggregate too: texts move once
    kept = rows.join(first.select(key, none).distinct(), ["id", "none"], "left_semi")
    return kept.groupBy("id", "none", "digest").agg(F.first("row").alias("row")).select("row.*")
