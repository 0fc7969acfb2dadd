"""Packing documents into sequences of a fixed number of tokens by cutting-stock patterns.

A task tokenises whole texts, ends each with the separator id and cuts it into full pieces and a remainder. The
histogram of piece sizes (lengths in steps, of bounded number) goes to the driver, which finds patterns (see
``cutting_stock``). Pieces are ranked within their size, in buckets, and a piece's rank decides which
sequence of which pattern it goes to; that table is again of bounded size.

Ids are those of the byte-level vocabulary; the rank file gives the same ids as the tokenizer file and is
several times as fast. The tokenizer file's added tokens, which the rank file lacks, are cut out of the texts and
get their own ids; without ``added`` their strings are ordinary text.

Defined results: a null text is empty, and an empty text is one piece, the separator; repeated rows are rows of
their own; a long text is many full pieces and a remainder; pieces of one size and id are ranked by start, then checksum; other
columns, of whatever name, are ignored; an empty table gives no rows.
"""

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm.cutting_stock import cut_patterns
from wattloom.llm.sharding import numbered
from wattloom.runtime import scratch_path

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def added_tokens(path: str) -> dict[str, int]:
    """Strings that a tokenizer file turns into one id wherever they stand in a text."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    for t in tokens:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError(f"{path}: {t['content']} is not matched as it stands")
    return {t["content"]: t["id"] for t in tokens}


def byte_bpe(path: str, pattern: str, added: dict[str, int] | None = None) -> Callable[[str], list[int]]:
    """Encoder of a byte-level vocabulary given as a file of ranks; texts are cut at ``added`` tokens."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    ordinary = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if not added:
        return ordinary
    longest_first = sorted(added, key=len, reverse=True)
    cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})")

    def encode(text: str) -> list[int]:
        parts = cut.split(text)
        if len(parts) == 1:
            return ordinary(text)
        ids = []
        for i, part in enumerate(parts):  # every second part is an added token
            ids += [added[part]] if i % 2 else ordinary(part)
        return ids

    return encode


_encoders: dict[tuple, Callable] = {}


def cut_pieces(documents: DataFrame, path: str, pattern: str, capacity: int, separator: int,
               doc: str = "doc_id", text: str = "text", keep_ids: bool = False,
               added: dict[str, int] | None = None) -> DataFrame:
    """The pieces of every document (see ``_PIECES``); ids are little-endian 32-bit numbers, or null."""
    kinds = [pa.int64()] * 5 + [pa.binary()]
    schema = pa.schema(list(zip([x.split()[0] for x in _PIECES.split(", ")], kinds)))

    def pieces(doc_id: int | None, ids: list[int]) -> Iterator[tuple]:
        raw = np.array([*ids, separator], "<u4").tobytes()
        for at in range(0, len(raw), 4 * capacity):
            part = raw[at:at + 4 * capacity]
            yield (doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4, part if keep_ids else None)

    vocabulary = (path, pattern, *(added or {}).items())

    def run(batches):
        if vocabulary not in _encoders:  # a worker reads the vocabulary once
            _encoders[vocabulary] = byte_bpe(path, pattern, added)
        encode = _encoders[vocabulary]
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += pieces(doc_id, encode(body.as_py() or ""))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema=schema)

    return documents.select(F.col(doc).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, _PIECES)


_RANK_BITS = 44


def placements(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (key, copies, sequence, place), by key: where the pieces of a size go from some rank on.

    The key is the size above ``_RANK_BITS`` bits of the first rank; ``copies`` pieces go to each sequence, on
    consecutive places.
    """
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in cut_patterns(histogram, capacity):
        place = 0
        for size in sorted(pattern, reverse=True):
            copies = pattern[size]
            first = taken.get(size, 0)
            rows.append((size << _RANK_BITS | first, copies, sequence, place))
            taken[size] = first + copies * times
            place += copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack_documents(documents: DataFrame, path: str, pattern: str, capacity: int = 1024, separator: int = 0,
                   doc: str = "doc_id", text: str = "text", keep_ids: bool = False, sizes: int = 128,
                   added: dict[str, int] | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset: one row per piece.

    Lengths are rounded up to ``sizes`` steps of the capacity for the patterns; offsets follow real lengths.
    """
    spark = documents.sparkSession
    unit = max(1, capacity // sizes)
    stored = scratch_path(spark, "pieces")
    cut_pieces(documents, path, pattern, capacity, separator, doc, text, keep_ids, added).write.parquet(stored)
    pieces = spark.read.parquet(stored).withColumn("size", F.ceil(F.col("length") / unit).cast("long"))
    counted = pieces.groupBy("size").agg(F.count(F.lit(1)).alias("c")).collect()
    table = spark.sparkContext.broadcast(
        placements({r["size"]: r["c"] for r in counted}, capacity // unit))
    ranked = numbered(pieces, "size", F.xxhash64("doc_id", "start", "ids_crc32"),
                      ["doc_id", "start", "ids_crc32"], "rank")
    columns = [x.split()[0] for x in _PIECES.split(", ")]

    def put(batches):
        keys, copies, sequence, place = table.value.T
        for batch in batches:
            size, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, size << _RANK_BITS | rank, "right") - 1
            past = rank - (keys[at] & (1 << _RANK_BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(sequence[at] + past // copies[at]),
                 pa.array(place[at] + past % copies[at])], names=[*columns, "sequence_id", "place"])

    placed = ranked.select(*columns, "size", "rank").mapInArrow(put, _PIECES + ", sequence_id long, place long")
    # A sequence has at most as many pieces as tokens.
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("place")


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, ids, tokens) of packed pieces that kept their ids; a sequence has bounded length."""
    parts = F.sort_array(F.collect_list(F.struct("offset", ids)))
    joined = packed.groupBy("sequence_id").agg(parts.alias("p"))
    hexed = F.array_join(F.transform("p", lambda x: F.hex(x[ids])), "")
    return joined.select("sequence_id", F.unhex(hexed).alias("ids"),
                         F.expr(f"aggregate(p, 0L, (a, x) -> a + octet_length(x.{ids}) div 4)").alias("tokens"))
