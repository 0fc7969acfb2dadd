"""Shards of nearly equal bytes that keep equal texts together: minimax contiguous partition.

Groups of equal texts are ordered by their SHA-256. A capacity is feasible if filling shards greedily in
that order needs no more than the given number; the smallest feasible capacity is found by binary search,
and the order is cut there. The driver never holds the groups: it sees the sizes of ranges of the order,
at first by the first 16 bits of the digest. Where a cut of any capacity still possible may fall inside a
range, that range is read again by 8 more bits, until every cut is known between single groups; each
reading has at most a few ranges per shard. All steps on rows are column expressions.

Defined results: a null text is empty, so it is grouped with empty texts; repeated rows are rows of their
own; with fewer groups than shards the last shards stay empty; ties of a slot's order go by id, then digest; a long text counts in
whole and may be a shard of its own; other columns, of whatever name, are ignored; an empty table gives no rows.
"""

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.runtime import scratch_path

FIRST_HEX, STEP_HEX, DIGEST_HEX = 4, 2, 64


def text_sizes(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32 and the digest that orders the groups."""
    body = F.coalesce(F.col(text), F.lit(""))
    return documents.select(
        F.col(doc).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.sha2(body.cast("binary"), 256).alias("digest"))


def _ranges(sizes: DataFrame, prefixes: list[str] | None, width: int) -> dict[str, tuple[int, bool]]:
    """Size of each range of digests that begin alike, and whether it is a single group."""
    rows = sizes if prefixes is None else sizes.filter(
        F.substring("digest", 1, len(prefixes[0])).isin(prefixes))
    found = rows.groupBy(F.substring("digest", 1, width).alias("prefix")).agg(
        F.sum("size").alias("size"), (F.min("digest") == F.max("digest")).alias("single"))
    return {r["prefix"]: (r["size"], r["single"]) for r in found.collect()}


def _greedy(ends: list[int], solid: list[bool], capacity: int, shards: int, hopeful: bool) -> list[int]:
    """Ends of the shards that ``capacity`` allows; the last is the total if it is large enough.

    A range that is no single group may be cut nowhere, or if ``hopeful`` at any byte. So the cuts over
    single groups lie between those of the two.
    """
    cuts, at, total = [], 0, ends[-1]
    for _ in range(shards):
        reach = at + capacity
        i = bisect_right(ends, reach)
        stop = ends[i - 1] if i else 0
        if hopeful and i < len(ends) and not solid[i]:
            stop = reach
        at = min(max(stop, at), total)
        cuts.append(at)
    return cuts


def _smallest(ends: list[int], solid: list[bool], shards: int, hopeful: bool) -> int:
    low, high = 1, ends[-1]
    while low < high:
        middle = (low + high) // 2
        if _greedy(ends, solid, middle, shards, hopeful)[-1] == ends[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def find_cuts(sizes: DataFrame, shards: int) -> tuple[int, list[str]]:
    """(smallest capacity, prefix of the last group of each shard that has rows, but the last of all).

    ``sizes`` is read several times and should be a stored table.
    """
    known = _ranges(sizes, None, FIRST_HEX)
    if not known:
        return 0, []
    while True:
        order = sorted(known)
        ends = list(accumulate(known[p][0] for p in order))
        solid = [known[p][1] for p in order]
        least = _smallest(ends, solid, shards, hopeful=True)
        most = _smallest(ends, solid, shards, hopeful=False)
        if least == most:
            cuts = _greedy(ends, solid, most, shards, hopeful=False)
            return most, [order[bisect_left(ends, c)] for c in cuts if c < ends[-1]]
        # For every capacity from least to most, cut k lies between these two.
        early = _greedy(ends, solid, least, shards, hopeful=False)
        late = _greedy(ends, solid, most, shards, hopeful=True)
        unclear = {order[i] for a, b in zip(early, late)
                   for i in range(bisect_left(ends, a), min(bisect_left(ends, b) + 1, len(ends)))
                   if not solid[i]}
        for width in {len(p) for p in unclear}:
            of_width = sorted(p for p in unclear if len(p) == width)
            for prefix in of_width:
                del known[prefix]
            known |= _ranges(sizes, of_width, min(width + STEP_HEX, DIGEST_HEX))


def shard_of(digest: Column, last: list[str]) -> Column:
    """The shard of a group: the number of shards that end before it."""
    shard = F.lit(0)
    for prefix in last:
        shard = shard + (F.substring(digest, 1, len(prefix)) > F.lit(prefix)).cast("int")
    return shard


def numbered(rows: DataFrame, key: str, spread: Column, order: list[str], name: str,
             buckets: int = 1024) -> DataFrame:
    """Gapless numbers from 0 within each ``key`` (few values), without a task that holds all of a key.

    Rows go into buckets by ``spread``; each bucket is numbered by itself, after those before it, whose
    counts are at most ``buckets`` for each key.
    """
    spread_rows = rows.withColumn("_bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    counts = spread_rows.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(key, "_bucket").orderBy(*order)
    return (spread_rows.withColumn("_row", F.row_number().over(within))
            .join(offsets, [key, "_bucket"])
            .withColumn(name, (F.col("_before") + F.col("_row") - 1).cast("long"))
            .drop("_bucket", "_before", "_row"))


def shard_documents(documents: DataFrame, shards: int = 16, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, digest, shard, slot: slots are gapless from 0 in each shard.

    Sizes are stored once in the shared folder, since the search reads them several times.
    """
    spark = documents.sparkSession
    path = scratch_path(spark, "shard-sizes")
    text_sizes(documents, doc, text).write.parquet(path)
    sizes = spark.read.parquet(path)
    _, last = find_cuts(sizes, shards)
    placed = sizes.withColumn("shard", shard_of(F.col("digest"), last))
    return numbered(placed, "shard", F.xxhash64("doc_id", "digest"), ["doc_id", "digest"], "slot")
