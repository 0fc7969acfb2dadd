"""Benchmark decontamination: containment search for short items inside long documents.

Items are partitioned by the number of their shingles, at powers of two. The sketch of an item is the ``k`` smallest of its
hashed shingles, with ``k`` fixed by the upper size of its partition: more than a document that contains the
item to the threshold can miss, so such a document always meets the sketch in a known number of places, however
long it is. Only the sketches are joined with all documents. Those that meet one often enough are candidates; for
these alone the item's other shingles are fetched, and the exact containment, the share of the item's shingles that
the document has, decides. Tasks drop shingles that no item has by a bitmap of fixed
size; items and documents meet in hash joins, so neither need be small.

Defined results: null texts and texts without words contain nothing, and such items are never found; an item of
fewer words than a shingle is one shingle, found in a document that is this sequence and nothing else; of
documents that repeat an id, or have none, each is searched by itself and the one with the most shingles is given; a long text
is searched in whole; other columns, of whatever name, are ignored; repeated items of one id count as one set; an empty table gives no rows.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm import bitmap, textops
from wattloom.runtime import scratch_path


@dataclass(frozen=True)
class Search:
    width: int = 5
    #: Share of an item's shingles that a document must have, in per cent.
    per_cent: int = 80
    #: Hits beyond the guaranteed one, as a share of the partition's size.
    surplus: float = 0.1


_FOUND = [("row", pa.int64()), ("id", pa.int64()), ("h", pa.int64())]


def _shingle_rows(rows: DataFrame, key: str, text: str, search: Search, known=None) -> DataFrame:
    """(row, id, h): distinct shingles of each text; with ``known``, those of texts that meet a sketch, if in an item.

    The key is an id, which then stands for the row too, or (row, id).
    """
    def run(batches):
        for batch in batches:
            key_of = batch.column(0)
            row, ids = key_of.flatten() if pa.types.is_struct(key_of.type) else (key_of, key_of)
            for lo, hi, data, offsets in textops.blocks(batch.column(1)):
                words = textops.find_words(textops.LOWER[data], offsets, textops.IS_BREAK)
                h, at = textops.shingles(words, search.width)
                if known is not None:
                    in_item, in_sketch = known.value
                    hit = bitmap.contains(in_item, h)
                    h, at = h[hit], at[hit]
                    meets = np.zeros(hi - lo, bool)
                    meets[at[bitmap.contains(in_sketch, h)]] = True
                    h, at = h[meets[at]], at[meets[at]]
                if len(h):
                    order = np.lexsort((h, at))
                    h, at = h[order], at[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
                    of = pa.array(at[new] + lo)
                    yield pa.RecordBatch.from_arrays(
                        [row.take(of), ids.take(of), pa.array(h[new].view(np.int64))], schema=pa.schema(_FOUND))

    return rows.select(key, text).mapInArrow(run, "row long, id long, h long")


def _sketched(items: DataFrame, search: Search) -> DataFrame:
    """(item_id, h, n, in_sketch, least_hits) of distinct item shingles."""
    n, per_cent = F.col("n"), search.per_cent
    least_share = lambda x: F.floor((per_cent * x + 99) / 100)
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long")
    size = F.least(n, upper - least_share(upper) + 1 + F.floor(search.surplus * upper))
    of_item = Window.partitionBy("id")
    ranked = items.withColumn("n", F.count(F.lit(1)).over(of_item)).withColumn(
        "r", F.row_number().over(of_item.orderBy("h")))
    return ranked.select(
        F.col("id").alias("item_id"), "h", "n", (F.col("r") <= size).alias("in_sketch"),
        (size - (n - least_share(n))).cast("long").alias("least_hits"))


def find_leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text",
               item: str = "item_id", item_text: str = "text", search: Search = Search()) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of all pairs that reach the threshold."""
    spark = documents.sparkSession
    path = scratch_path(spark, "item-shingles")
    named = items.select(F.col(item).cast("long").alias("_item"), F.col(item_text).alias("_text"))
    distinct = _shingle_rows(named, "_item", "_text", search).select("id", "h").distinct()
    _sketched(distinct, search).write.parquet(path)
    known = spark.read.parquet(path)
    bits = spark.sparkContext.broadcast((bitmap.build(known, "h"), bitmap.build(known.filter("in_sketch"), "h")))
    hits_path = scratch_path(spark, "item-hits")
    # Rows are told apart by a number of their own, as ids may repeat or be missing.
    numbered = documents.select(F.monotonically_increasing_id().alias("_row"), F.col(doc).cast("long").alias("_id"),
                                F.col(text).alias("_text"))
    _shingle_rows(numbered.select(F.struct("_row", "_id").alias("_key"), "_text"), "_key", "_text", search, bits
                  ).write.parquet(hits_path)
    hits = spark.read.parquet(hits_path)
    met = hits.join(known.filter("in_sketch"), "h").groupBy("row", "id", "item_id").agg(
        F.count(F.lit(1)).alias("met"), F.first("n").alias("n"), F.first("least_hits").alias("least_hits"))
    candidates = met.filter("met >= least_hits")
    # Only what met enough of the sketch is compared in the item's other shingles.
    others = candidates.select("row", "item_id").join(
        known.filter("NOT in_sketch").select("item_id", "h"), "item_id").join(hits.select("row", "h"), ["row", "h"])
    counted = others.groupBy("row", "item_id").agg(F.count(F.lit(1)).alias("others"))
    shared = (F.col("met") + F.coalesce("others", F.lit(0))).alias("shared")
    verified = candidates.join(counted, ["row", "item_id"], "left").select("id", "item_id", "n", shared).filter(
        100 * F.col("shared") >= search.per_cent * F.col("n"))
    # Of rows with one id, that with the most.
    exact = verified.groupBy("id", "item_id", "n").agg(F.max("shared").alias("shared"))
    return exact.select(F.col("id").alias("doc_id"), "item_id", "shared", F.col("n").alias("item_shingles"),
                        (F.col("shared") / F.col("n")).alias("containment"))
