"""Token counts of documents from counts of distinct pre-tokens, without making any ids of documents.

A tokenizer splits a text into pre-tokens and each of them into pieces, on its own. So the pieces are counted once for
every distinct pre-token of the corpus; a document's count is the sum over its pre-tokens of frequency times pieces. The
pre-tokens are made by the tokenizer file's own normalizer and pre-tokenizer (of ASCII texts, by its pattern alone, where
that is the same), the pieces by its model, and strings of added tokens inside a text count one each, as the library does by default.

Pre-tokens that make up at least one of ``Counting.frequent`` of all occurrences (so at most that many) are sent to every
task and summed where the text is read; frequencies of all others are joined to their pieces. No key of that join has
more than its small share of the rows.

Where the pre-tokenizer drops white space, texts are cut there first. Work goes in sections, so a
long text takes no more memory than its longest run without a space.

Defined results: a null or empty text has no bytes and no tokens; rows with equal or null ids are rows of their own; an
empty table gives no rows; other columns, of whatever name, are ignored.
"""

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.packing import added_tokens
from wattloom.llm.storage import Scratch

#: Bytes from which a text is cut, and of the texts that are worked on at once.
SECTION, BLOCK = 1 << 20, 1 << 23
#: Longest pre-token that is sent as it is; of longer ones, the digest.
SHORT = 64
#: Runs that are split in one call, and distinct pre-tokens that a task counts before it gives them.
TOGETHER = 512
KEPT = 1 << 17
_PROBES = ("a b", " a  b ", "a\nb", "\ta \n\n b\r\n", "1 2", ". .")


@dataclass(frozen=True)
class Counting:
    frequent: int = 1 << 18
    limit: int = 2048


def ascii_rule(path: str) -> re.Pattern | None:
    """What finds the pre-tokens of printable lower-case ASCII, if the file's rules amount to one pattern there.

    That is so for a file that lowers case, keeps what its pattern matches and then maps bytes: in ASCII, its letters
    are a to z, its numbers 0 to 9, and printable bytes stand for themselves.
    """
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    normalizer, splitter = rules["normalizer"] or {}, rules["pre_tokenizer"] or {}
    kinds = [n["type"] for n in normalizer.get("normalizers", [])]
    steps = splitter.get("pretokenizers", [])
    if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
        return None
    spaces, split, mapped = normalizer["normalizers"][1], *steps
    if (spaces["pattern"], spaces["content"]) != ({"Regex": r"\s+"}, " ") or mapped["add_prefix_space"] or mapped["use_regex"]:
        return None
    if (split["behavior"], split["invert"]) != ("Removed", True) or "Regex" not in split["pattern"]:
        return None
    pattern = split["pattern"]["Regex"].replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
    return None if r"\p" in pattern else re.compile(pattern)


class PreTokens:
    """What a tokenizer file makes of runs of text before its model sees them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._normalizer, self._splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self._model = tokenizer.model
        added = sorted(added_tokens(path), key=len, reverse=True)
        self._cut = re.compile("|".join(map(re.escape, added))) if added else None
        self._ascii = ascii_rule(path)
        # Cut at white space only if the file's own rules never see across it.
        self.splits_at_space = not any(re.search(r"\s", a) for a in added) and all(
            self._strings(p) == [s for part in p.split() for s in self._strings(part)] for p in _PROBES)

    def _strings(self, text: str) -> list[str]:
        if self._normalizer is not None:
            text = self._normalizer.normalize_str(text)
        if self._splitter is None:
            return [text] if text else []
        return [s for s, _ in self._splitter.pre_tokenize_str(text)]

    def pieces(self, pre_token: str) -> int:
        return len(self._model.tokenize(pre_token))

    def runs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(text and index of each run in order, distinct runs) of what may be split alone in a block of texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.splits_at_space:
            listed = pc.ascii_split_whitespace(texts)
            counts, flat = pc.list_value_length(listed).to_numpy(), listed.flatten()
        else:
            counts, flat = np.ones(len(texts), np.int64), texts
        coded = flat.dictionary_encode()
        at = np.repeat(np.arange(len(texts)), counts)
        return at, coded.indices.to_numpy(), coded.dictionary.to_pylist()

    def blocks(self, column: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
        """(row of each text, texts): rows of ``column`` in blocks of bounded size, long texts cut at spaces."""
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy()
        row = 0
        while row < len(column):
            if self.splits_at_space and sizes[row] > SECTION:
                for section in self.sections(column[row].as_py()):
                    yield np.array([row]), pa.array([section], pa.large_string())
                row += 1
                continue
            long = sizes[row:] > SECTION if self.splits_at_space else np.zeros(len(column) - row, bool)
            upto = np.cumsum(sizes[row:]) <= BLOCK
            to = row + max(1, int(np.argmin(np.append(upto & ~long, False))))
            yield np.arange(row, to), column.slice(row, to - row)
            row = to

    @staticmethod
    def sections(text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            to = text.find(" ", at + SECTION) if at + SECTION < len(text) else -1
            to = to if to >= 0 else len(text)
            yield text[at:to]
            at = to

    def of_runs(self, runs: list[str]) -> list[tuple[int, list[str]]]:
        """(number of added tokens, pre-tokens) of each run; where that is safe, many are split as one text."""
        found: list = [None] * len(runs)
        others = []
        for k, run in enumerate(runs):
            if self._ascii is None or not (run.isascii() and run.isprintable()) or self._cut and self._cut.search(run):
                others.append(k)
            else:
                found[k] = 0, self._ascii.findall(run.lower())
        for at in range(0, len(others), TOGETHER):
            some = others[at:at + TOGETHER]
            for k, parts in zip(some, self._of_others([runs[k] for k in some])):
                found[k] = parts
        return found

    def _of_others(self, runs: list[str]) -> list[tuple[int, list[str]]]:
        text = " ".join(runs)
        plain = self.splits_at_space and not (self._cut and self._cut.search(text))
        strings = self._of_plain(runs, text) if plain else None
        if strings is not None:
            return [(0, s) for s in strings]
        cut = [self._cut.split(run) if self._cut else [run] for run in runs]
        return [(len(parts) - 1, [s for p in parts if p for s in self._strings(p)]) for parts in cut]

    def _of_plain(self, runs: list[str], text: str) -> list[list[str]] | None:
        """Pre-tokens of each run, from all runs as one text; nothing if its spaces don't mark the runs."""
        if self._normalizer is not None:
            text = self._normalizer.normalize_str(text)
        spans = text.split(" ")
        if len(spans) != len(runs) or self._splitter is None:
            return None
        strings: list[list[str]] = [[] for _ in runs]
        k, end = 0, len(spans[0])
        for s, (begin, _) in self._splitter.pre_tokenize_str(text):
            while begin >= end:
                k += 1
                end += len(spans[k]) + 1
            strings[k].append(s)
        return strings


_splitters: dict[str, PreTokens] = {}


def _splitter(path: str) -> PreTokens:
    if path not in _splitters:  # a worker reads the vocabulary once
        _splitters[path] = PreTokens(path)
    return _splitters[path]


def frequencies(texts: DataFrame, path: str) -> DataFrame:
    """(pre_token, n): how often each pre-token occurs in all texts of a one-column table."""

    def batch_of(total: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["pre_token", "n"])

    def run(batches):
        splitter = _splitter(path)
        total: dict[str, int] = {}
        for batch in batches:
            for _, texts in splitter.blocks(batch.column(0)):
                _, codes, runs = splitter.runs(texts)
                counts = np.bincount(codes, minlength=len(runs)).tolist()
                for n, (_, strings) in zip(counts, splitter.of_runs(runs)):
                    for s in strings:
                        total[s] = total.get(s, 0) + n
                if len(total) > KEPT:
                    yield batch_of(total)
                    total.clear()
        yield batch_of(total)

    parts = texts.mapInArrow(run, "pre_token string, n long")
    return parts.groupBy("pre_token").agg(F.sum("n").alias("n"))


def count_pieces(pre_tokens: DataFrame, path: str) -> DataFrame:
    """(pre_token, n, pieces) of a table of distinct pre-tokens."""

    def run(batches):
        splitter = _splitter(path)
        for batch in batches:
            pieces = [splitter.pieces(s.as_py()) for s in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pieces, pa.int64())], names=["pre_token", "n", "pieces"])

    return pre_tokens.select("pre_token", "n").mapInArrow(run, "pre_token string, n long, pieces long")


def _short(pre_token: str) -> str:
    return pre_token if len(pre_token) <= SHORT else "\0" + hashlib.sha256(pre_token.encode()).hexdigest()


def _known(splitter: PreTokens, runs: list[str], known: dict[str, int]):
    """Tokens of the frequent pre-tokens of each run; (run, pre-token) of all others; those pre-tokens."""
    tokens = np.zeros(len(runs), np.int64)
    of, other, others = [], [], {}
    for k, (added, strings) in enumerate(splitter.of_runs(runs)):
        for s in strings:
            n = known.get(_short(s))
            if n is None:
                of.append(k)
                other.append(others.setdefault(s, len(others)))
            else:
                added += n
        tokens[k] = added
    return tokens, np.array(of, np.int64), np.array(other, np.int64), list(others)


def _document_parts(rows: DataFrame, path: str, frequent) -> DataFrame:
    """One row per document with the tokens of frequent pre-tokens, and one for each other pre-token in it."""

    def others_of(texts, codes, of, other, n_runs, n_others):
        """(text, pre-token, frequency) of what is not frequent in the runs ``codes`` of ``texts``."""
        first = np.searchsorted(of, np.arange(n_runs + 1))
        each = np.diff(first)[codes]
        there = np.repeat(first[:-1][codes], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        pairs, n = np.unique(np.repeat(texts, each) * max(n_others, 1) + other[there], return_counts=True)
        return pairs // max(n_others, 1), pairs % max(n_others, 1), n

    def run(batches):
        splitter = _splitter(path)
        for batch in batches:
            key, totals = batch.column(0).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for owner, block in splitter.blocks(batch.column(3)):
                at, codes, runs = splitter.runs(block)
                tokens, of, other, others = _known(splitter, runs, frequent.value)
                np.add.at(totals, owner, np.bincount(at, tokens[codes], len(owner)).astype(np.int64))
                text, which, n = others_of(at, codes, of, other, len(runs), len(others))
                none = pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[owner[text]]), none, none, pa.array(n),
                     pa.array(others, pa.string()).take(pa.array(which)), pa.array(np.full(len(n), -1))], names=names)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(totals), pa.array([""] * len(key), pa.string()), batch.column(0)], names=names)

    names = ["key", "doc_id", "n_bytes", "n", "pre_token", "own"]
    return rows.mapInArrow(run, "key long, doc_id long, n_bytes long, n long, pre_token string, own long")


def count_tokens(documents: DataFrame, path: str, counting: Counting = Counting(),
                 doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; ``path`` is a tokenizer file that all executors have."""
    spark = documents.sparkSession
    rows = documents.select(F.monotonically_increasing_id().alias("key"), F.col(doc).cast("long").alias("doc_id"),
                            F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                            F.col(text).alias("text"))
    pieces = Scratch(spark).store("pre-tokens", count_pieces(frequencies(rows.select("text"), path), path))
    total = pieces.agg(F.sum("n")).first()[0] or 0
    pre_token = F.col("pre_token")
    short = F.when(F.length(pre_token) <= SHORT, pre_token).otherwise(
        F.concat(F.lit("\0"), F.sha2(pre_token, 256)))
    is_frequent = F.col("n") * counting.frequent >= total
    found = pieces.filter(is_frequent).select(short.alias("k"), "pieces").toArrow()
    frequent = spark.sparkContext.broadcast(dict(zip(found["k"].to_pylist(), found["pieces"].to_pylist())))
    parts = _document_parts(rows, path, frequent)
    # A document's own row finds no partner; its key spreads it over the tasks.
    rare = pieces.filter(~is_frequent).select("pre_token", F.lit(-1).cast("long").alias("own"), "pieces")
    joined = parts.join(rare, ["pre_token", "own"], "left")
    tokens = F.sum(F.col("n") * F.coalesce("pieces", F.lit(1)))
    return joined.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), tokens.alias("n_tokens"),
    ).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > counting.limit).alias("over_limit"))
