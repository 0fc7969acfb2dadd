"""Spelling variants: words one edit apart, each led to its most frequent neighbour.

Words are counted over whole texts. For each word, the strings that one deleted or one replaced character makes of it are
generated as hashes and looked up in Bloom filters of the vocabulary, which every task has: a filter for each
length, cut into blocks of 512 bits, so that a look-up touches one block. An inserted character is a deletion seen from the longer
word, and of two words that differ in one character the smaller finds the greater. Only strings that a filter lets pass
are spelt out and shuffled, to an exact join with the vocabulary, which removes the false ones; so the filters
spare work and decide nothing.

The filters of one pass have at most ``Variants.budget`` bits. A larger vocabulary is dealt by hash into as many passes as
it needs. Characters come from the vocabulary itself, and a word is worked on in runs of positions, so memory
doesn't grow with its length. A word has few neighbours, so no key of the joins is hot: a word of L characters has at most
(2 L + 1) times as many as there are characters.

Forms have at least twice the count of the word, so following them ends after at most 62 steps; the roots are
found by doubling the steps, in six joins at most.

Defined results: a null or empty text has no words; a null id is written as empty text; repeated rows count again; ties
between forms go to the smaller word by code points; an empty table gives no rows; other columns, of whatever
name, are ignored.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.storage import Scratch
from wattloom.llm.textops import mix

SECTION = 1 << 20
KEPT = 1 << 18
#: Look-ups made at once.
PROBES = 1 << 20
#: Words of this length and more share a filter.
LONGEST = 64
BLOCK_BITS, LOOKS = 512, 6
_LETTER = "a-zÀ-ÿ"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@dataclass(frozen=True)
class Variants:
    least_length: int = 5
    least_count: int = 3
    ratio: int = 2
    bits_per_word: int = 16
    budget: int = 1 << 27


# --- words -------------------------------------------------------------------------------------


def _sections(text: str) -> Iterator[str]:
    """``text`` with A to Z in lower case, cut between runs of letters."""
    text = text.encode().lower().decode()
    if len(text) <= SECTION:
        yield text
        return
    gap = re.compile(f"[^{_LETTER}]")
    at = 0
    while at < len(text):
        found = gap.search(text, at + SECTION)
        to = found.end() if found else len(text)
        yield text[at:to]
        at = to


def count_words(documents: DataFrame, doc: str = "doc_id", text: str = "text", typo_every: int | None = None,
                variants: Variants = Variants()) -> DataFrame:
    """(word, n): runs of letters with A to Z in lower case that are long and frequent enough.

    With ``typo_every``, a run loses a character if that number divides the crc32 of ``<doc_id>:<run>``; which one, the
    same value decides.
    """
    least = variants.least_length
    # A shorter run is no word, with or without a lost character.
    runs = re.compile(f"[{_LETTER}]{{{least},}}")

    def batch_of(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        words: Counter = Counter()
        read = 0
        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = zlib.crc32(f"{doc_id}:".encode())
                body = body.as_py() or ""
                for section in _sections(body):
                    found = runs.findall(section)
                    if typo_every is None:
                        words.update(found)
                    else:
                        for word, n in Counter(found).items():
                            h = zlib.crc32(word.encode(), start)
                            if h % typo_every == 0:
                                i = h % len(word)
                                word = word[:i] + word[i + 1:]
                                if len(word) < least:
                                    continue
                            words[word] += n
                    read += len(section)
                    if len(words) > KEPT or read > 64 * SECTION:
                        yield batch_of(words)
                        words.clear()
                        read = 0
        yield batch_of(words)

    parts = documents.select(F.coalesce(F.col(doc).cast("string"), F.lit("")), F.col(text)).mapInArrow(
        run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= variants.least_count)


# --- filters -----------------------------------------------------------------------------------


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, code points by row) of the words of each length, in bounded groups."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        step = max(1, PROBES // int(length))
        for lo in range(0, len(at), step):
            some = at[lo:lo + step]
            joined = "".join(words[i] for i in some)
            codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(len(some), -1)
            yield some, codes.astype(np.uint64)


def _powers(length: int) -> np.ndarray:
    steps = np.full(length, _BASE, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _hash(codes: np.ndarray) -> np.ndarray:
    """Sum of code points times powers, before mixing: edits change it in known ways."""
    return (codes * _powers(codes.shape[1])).sum(1, dtype=np.uint64)


@dataclass(frozen=True)
class Shards:
    """Where the blocks of each length lie in one array of bits, and which part of the vocabulary they hold."""

    first: np.ndarray
    blocks: np.ndarray
    part: int
    parts: int

    @classmethod
    def for_counts(cls, counts: dict[int, int], variants: Variants) -> "list[Shards]":
        """The passes that a vocabulary of so many words of each length needs."""
        wanted = sum(counts.values()) * variants.bits_per_word
        parts = max(1, -(-wanted // variants.budget))
        blocks = np.zeros(LONGEST + 1, np.int64)
        for length, n in counts.items():
            blocks[length] = -(-n * variants.bits_per_word // (parts * BLOCK_BITS)) + 1
        first = np.cumsum(blocks) - blocks
        return [cls(first, blocks, part, parts) for part in range(parts)]

    @property
    def words(self) -> int:
        return int(self.blocks.sum()) * BLOCK_BITS // 64

    def mine(self, mixed: np.ndarray) -> np.ndarray:
        """Which hashes belong to this part."""
        return mixed % np.uint64(self.parts) == np.uint64(self.part)

    def bits(self, length: int, mixed: np.ndarray) -> Iterator[np.ndarray]:
        """Positions of the bits of each hash, one look at a time."""
        shard = min(length, LONGEST)
        block = (mixed >> np.uint64(32)) * np.uint64(self.blocks[shard]) >> np.uint64(32)
        base = (block + np.uint64(self.first[shard])) * np.uint64(BLOCK_BITS)
        again = mix(mixed)
        for i in range(LOOKS):
            yield base + (again >> np.uint64(9 * i) & np.uint64(BLOCK_BITS - 1))

    def passing(self, filters: np.ndarray, length: int, mixed: np.ndarray) -> np.ndarray:
        """Indexes of the hashes that the filter of ``length`` lets pass."""
        shard = min(length, LONGEST)
        if not self.blocks[shard]:
            return np.empty(0, np.int64)
        left = np.flatnonzero(self.mine(mixed)) if self.parts > 1 else np.arange(len(mixed))
        for i in range(LOOKS):
            some = mixed[left]
            block = (some >> np.uint64(32)) * np.uint64(self.blocks[shard]) >> np.uint64(32)
            bit = (block + np.uint64(self.first[shard])) * np.uint64(BLOCK_BITS) + (
                mix(some) >> np.uint64(9 * i) & np.uint64(BLOCK_BITS - 1))
            left = left[filters[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) == 1]
        return left


def build_filters(vocabulary: DataFrame, shards: Shards) -> np.ndarray:
    """The bits of one pass; at most one row for each 64 of them is collected."""

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            bits = [np.empty(0, np.uint64)]
            for _, codes in _by_length(words):
                mixed = mix(_hash(codes))
                mixed = mixed[shards.mine(mixed)]
                bits += list(shards.bits(codes.shape[1], mixed))
            at = np.unique(np.concatenate(bits))
            word, start = np.unique(at >> np.uint64(6), return_index=True)
            values = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start) if len(at) else at
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.astype(np.int64)), pa.array(values.view(np.int64))], names=["at", "bits"])

    found = vocabulary.select("word").mapInArrow(run, "at long, bits long").groupBy("at").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    filters = np.zeros(shards.words, np.uint64)
    filters[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return filters


# --- neighbours --------------------------------------------------------------------------------


def _deleted(codes: np.ndarray, at: range) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) and hash of each word without the character at a position; of equal neighbours, the first."""
    powers = _powers(codes.shape[1])
    terms = codes * powers
    upto = np.cumsum(terms, 1, dtype=np.uint64)[:, at.start:at.stop]
    hashes = (upto - terms[:, at.start:at.stop]) + (_hash(codes)[:, None] - upto) * _INVERSE
    new = np.ones((len(codes), len(at)), bool)
    skip = max(at.start, 1)
    new[:, skip - at.start:] = codes[:, skip:at.stop] != codes[:, skip - 1:at.stop - 1]
    return np.argwhere(new) + [0, at.start], hashes[new]


def _replaced(codes: np.ndarray, at: range, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position, letter) and hash of each word with a greater character at a position."""
    here = codes[:, at.start:at.stop, None]
    greater = alphabet[None, None, :] > here
    change = (alphabet[None, None, :] - here) * _powers(codes.shape[1])[None, at.start:at.stop, None]
    hashes = _hash(codes)[:, None, None] + change
    return np.argwhere(greater) + [0, at.start, 0], hashes[greater]


def _candidates(words: list[str], filters: np.ndarray, shards: Shards, alphabet: str) -> Iterator[tuple[int, str]]:
    """(index of the word, edited word) of the edits that pass the filters."""
    letters = np.array([ord(c) for c in alphabet], np.uint64)
    for rows, codes in _by_length(words):
        length = codes.shape[1]
        step = max(1, PROBES // (len(letters) * length))
        for lo in range(0, len(rows), step):
            some, part = rows[lo:lo + step], codes[lo:lo + step]
            width = max(1, PROBES // (len(letters) * len(some)))
            for p in range(0, length, width):
                at = range(p, min(p + width, length))
                edits, hashes = _deleted(part, at)
                for k in shards.passing(filters, length - 1, mix(hashes)):
                    r, i = edits[k]
                    w = words[some[r]]
                    yield some[r], w[:i] + w[i + 1:]
                edits, hashes = _replaced(part, at, letters)
                for k in shards.passing(filters, length, mix(hashes)):
                    r, i, c = edits[k]
                    w = words[some[r]]
                    yield some[r], w[:i] + alphabet[c] + w[i + 1:]


def near_pairs(vocabulary: DataFrame, variants: Variants = Variants()) -> DataFrame:
    """(a, a_n, b, b_n) of any two words one edit apart, each pair once; ``vocabulary`` should be a stored table."""
    spark = vocabulary.sparkSession
    length = F.least(F.length("word"), F.lit(LONGEST))
    counts = {r["k"]: r["c"] for r in vocabulary.groupBy(length.alias("k")).agg(
        F.count(F.lit(1)).alias("c")).collect()}
    # At most as many characters as words may be made of.
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct()
    alphabet = "".join(sorted(r["c"] for r in letters.collect() if r["c"]))
    tasks = 1 + sum(counts.values()) // 4096
    dealt = vocabulary.repartition(tasks, "word")
    found = None
    for shards in Shards.for_counts(counts, variants):
        sent = spark.sparkContext.broadcast(build_filters(vocabulary, shards))

        def run(batches, shards=shards, sent=sent):
            for batch in batches:
                words, n = batch.column("word").to_pylist(), batch.column("n")
                at, edited = [], []
                for i, candidate in _candidates(words, sent.value, shards, alphabet):
                    at.append(i)
                    edited.append(candidate)
                    if len(at) >= KEPT:
                        yield batch_of(words, n, at, edited)
                        at, edited = [], []
                yield batch_of(words, n, at, edited)

        def batch_of(words, n, at, edited) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([words[i] for i in at], pa.string()), n.take(pa.array(at, pa.int64())),
                 pa.array(edited, pa.string())], names=["a", "a_n", "b"])

        passed = dealt.select("word", "n").mapInArrow(run, "a string, a_n long, b string")
        found = passed if found is None else found.unionByName(passed)
    return found.join(vocabulary.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b").select(
        "a", "a_n", "b", "b_n")


# --- forms and roots ---------------------------------------------------------------------------


def forms(vocabulary: DataFrame, pairs: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n of every word."""
    def side(word: str, n: str, other: str, other_n: str):
        return F.struct(F.col(word).alias("word"), F.col(n).alias("n"),
                        F.struct((-F.col(other_n)).alias("n"), F.col(other).alias("other")).alias("near"))

    both = pairs.select(F.explode(F.array(side("a", "a_n", "b", "b_n"), side("b", "b_n", "a", "a_n"))).alias("x"))
    best = both.select("x.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("best"))
    joined = vocabulary.join(best, "word", "left")
    leads = -F.col("best.n") >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(leads, F.col("best.other")).alias("form"),
                         F.when(leads, -F.col("best.n")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by doubling the steps."""
    scratch, turn = Scratch(found.sparkSession), 0
    steps = scratch.store("steps0", found.filter("form IS NOT NULL").select(
        "word", F.col("form").alias("at"), F.lit(True).alias("moved")))
    while True:
        ahead = steps.select(F.col("word").alias("at"), F.col("at").alias("further"))
        # Who didn't move stands on a root.
        moving = steps.filter("moved").join(ahead, "at", "left").select(
            "word", F.coalesce("further", "at").alias("at"), F.col("further").isNotNull().alias("moved"))
        turn += 1
        steps = scratch.store(f"steps{turn}", moving.unionByName(steps.filter("NOT moved")))
        if steps.filter("moved").isEmpty():
            return steps.select("word", F.col("at").alias("root"))


def group_variants(documents: DataFrame, doc: str = "doc_id", text: str = "text", typo_every: int | None = None,
                   variants: Variants = Variants()) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    scratch = Scratch(documents.sparkSession)
    vocabulary = scratch.store("vocabulary", count_words(documents, doc, text, typo_every, variants))
    found = scratch.store("forms", forms(vocabulary, near_pairs(vocabulary, variants), variants.ratio))
    return found.join(roots(found), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
