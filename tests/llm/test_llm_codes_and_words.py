"""Vector codes, spelling variants and token counts: brute force, the tokenizer library and edge cases."""

import hashlib
import random
import zlib
from collections import Counter
from math import floor, isfinite

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from wattloom.llm import heavy, spelling, token_counts, vector_codes
from wattloom.llm.spelling import Variants
from wattloom.llm.token_counts import Counting
from wattloom.llm.vector_codes import Coding

DOCS = "doc_id long, text string, n long, word string, label int, key long"


def documents(spark, texts, ids=None):
    """Documents with columns whose names clash with results and steps."""
    rows = [(i, t, 1, "x", 2, 3) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


# --- vector codes ------------------------------------------------------------------------------


def brute_codes(rows, coding):
    """Exact integers, every entry compared with every part."""
    kept = [(i, v, la) for i, v, la in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    if not kept:
        return []
    lengths = Counter(len(v) for _, v, _ in kept)
    size = max(lengths, key=lambda k: (lengths[k], k))
    kept = sorted((r for r in kept if len(r[1]) == size), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    wide = -(-size // coding.parts)
    whole = [[floor(coding.scale * x) for x in v] + [0] * (wide * coding.parts - size) for _, v, _ in kept]
    cut = [[w[p * wide:(p + 1) * wide] for p in range(coding.parts)] for w in whole]
    books = [[c[p] for c in cut[:coding.entries]] for p in range(coding.parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(coding.rounds):
        for p, book in enumerate(books):
            of = [nearest(c[p], book)[1] for c in cut]
            books[p] = [[sum(x) // of.count(i) for x in zip(*(c[p] for c, k in zip(cut, of) if k == i))]
                        if i in of else e for i, e in enumerate(book)]
    flat = ",".join(str(x) for book in books for e in book for x in e)
    digest, out = hashlib.sha256(flat.encode()).hexdigest(), []
    for (i, _, la), c in zip(kept, cut):
        best = [nearest(c[p], books[p]) for p in range(coding.parts)]
        out.append([i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), la, digest])
    totals = Counter()
    for r in out:
        totals[r[3]] += r[2]
    return [(i, code, e, totals[la], digest) for i, code, e, la, digest in out]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, la, "x", 1) for i, v, la in rows],
                                 "vec_id long, embedding array<double>, label int, code string, error long")


def coded(spark, rows, coding):
    found = vector_codes.vector_codes(vectors(spark, rows).repartition(3), coding)
    return sorted(map(tuple, found.collect()), key=str)


def some_vectors(seed, n, size, places=3):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, 0.2), places) for _ in range(size)], rng.choice([None, 0, 1, 2]))
            for i in range(n)]


@pytest.mark.parametrize("n, size, coding", [
    (60, 8, Coding(entries=16)), (90, 12, Coding(entries=20, rounds=2)), (9, 8, Coding()),
    (40, 6, Coding(entries=8, scale=2)), (30, 3, Coding(parts=3, entries=30)), (50, 7, Coding(entries=12))])
def test_codes_match_brute_force(spark, n, size, coding):
    rows = some_vectors(n, n, size, places=1 if coding.scale == 2 else 3)
    rows += [(n + k, list(rows[5][1]), 7) for k in range(20)]  # copies, a hot label, ties
    assert coded(spark, rows, coding) == sorted(brute_codes(rows, coding), key=str)


def test_odd_vectors(spark):
    rows = some_vectors(1, 30, 8)
    rows += [(100, None, 1), (101, [], 1), (102, [0.1] * 7 + [None], 1), (103, [float("nan")] * 8, 1),
             (104, [float("inf")] + [0.0] * 7, 1), (105, [1.0], 1), (3, rows[3][1], None), (3, rows[4][1], None),
             (None, [-0.5] * 8, None), (106, [1e300, -1e300] * 4, 9)]
    coding = Coding(entries=10)
    wanted = [(i, c, min(e, 2 ** 63 - 1), min(t, 2 ** 63 - 1), d) for i, c, e, t, d in brute_codes(rows, coding)]
    assert coded(spark, rows, coding) == sorted(wanted, key=str)
    assert coded(spark, [], Coding()) == []
    assert [r[1] for r in coded(spark, [(1, [], 1), (2, [], None)], Coding())] == ["00000000"] * 2


@pytest.mark.parametrize("size, wide, spread", [(256, 4, 3), (256, 16, 400), (40, 2, 2), (1, 3, 5), (17, 1, 4)])
def test_orchard_search_finds_the_first_of_the_nearest(size, wide, spread):
    rng = np.random.default_rng(size + wide)
    entries = rng.integers(-spread, spread + 1, (size, wide))
    points = rng.integers(-2 * spread, 2 * spread + 1, (700, wide))
    everything = ((points[:, None, :] - entries[None]) ** 2).sum(2)
    for kind in (np.int64, object):
        search = vector_codes.Orchard(entries.astype(kind))
        for start in (None, rng.integers(0, size, len(points))):
            index, distance = search.nearest(points.astype(kind), start)
            assert (index == everything.argmin(1)).all() and (distance == everything.min(1)).all()


def test_the_search_skips_far_entries(monkeypatch):
    rng = np.random.default_rng(0)
    entries = rng.integers(-1000, 1000, (256, 2))
    points = entries[rng.integers(0, 256, 500)] + rng.integers(-5, 6, (500, 2))
    search, looked, real = vector_codes.Orchard(entries), [], vector_codes._squares
    monkeypatch.setattr(vector_codes, "_squares", lambda d: looked.append(len(d)) or real(d))
    index, _ = search.nearest(points)
    assert (index == vector_codes._distances(points, entries).argmin(1)).all()
    assert sum(looked) < 0.6 * len(points) * len(entries)


def test_totals_beside_rows_of_heavy_and_light_keys(spark):
    rows = [(i, None if i % 3 == 0 else i % 7 if i % 3 == 1 else i) for i in range(3000)]
    table = spark.createDataFrame(rows, "v long, k long")
    totals = Counter()
    for v, k in rows:
        totals[k] += v
    found = heavy.join_totals(table, ["k"], F.sum("v"), "total").collect()
    assert sorted(map(tuple, found), key=str) == sorted(((v, k, totals[k]) for v, k in rows), key=str)


# --- spelling variants -------------------------------------------------------------------------


LETTERS = {chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]}


def brute_words(rows, every):
    found = Counter()
    for doc_id, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in "".join(c if c in LETTERS else " " for c in lower).split(" "):
            if not run:
                continue
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            if len(run) >= 5:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_variants(rows, every):
    words = brute_words(rows, every)
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words.get(form[w], 0)) for w in words)


def variants(found):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in found.collect())


def misspelt(seed, texts=120):
    """Texts of few words with edits of several kinds, doubled letters and letters beyond ASCII."""
    rng = random.Random(seed)
    base = ["banana", "letter", "Straße", "ÀÉÎõü", "committee", "aaaaa", "aaaaaa", "x×y÷zz", "ÿÿÿÿÿÿ", "q" * 90, "mañana"]
    out = []
    for _ in range(texts):
        words = []
        for _ in range(40):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice(["", "a", "é", w[i] * 2, w[i].upper()]) + w[i + 1:]
                w = w or "a"
            words.append(w)
        out.append(rng.choice([" ", ", ", "\n", "-", "1"]).join(words))
    return out


@pytest.mark.parametrize("every, budget", [(None, 1 << 27), (3, 1 << 27), (97, 1024)])
def test_variants_match_brute_force(spark, every, budget):
    rows = list(enumerate(misspelt(every or 0)))
    rows += [(None, rows[0][1]), (3, rows[3][1]), (900, None), (901, ""), (902, " 12 ,")]
    table = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    found = spelling.group_variants(table, typo_every=every, variants=Variants(budget=budget))
    wanted = brute_variants(rows, every)
    assert variants(found) == wanted
    assert any(w[1] for w in wanted) and any(w[1] != w[2] for w in wanted if w[1])


def test_long_texts_and_words_go_in_sections(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SECTION", 16)
    text = "Lorem ipsum dolor sit amet, consectetur " * 50 + "z" * 400
    assert "".join(spelling._sections(text)) == text.lower()
    assert all(s == text.lower() or len(s) < 450 for s in spelling._sections(text))
    monkeypatch.setattr(spelling, "PROBES", 64)
    words = ["abcde", "abcdf", "abcd", "z" * 400, "z" * 399, "y" + "z" * 399, "aabb", "aab"]
    shards = spelling.Shards.for_counts(Counter(min(len(w), spelling.LONGEST) for w in words), Variants())[0]
    filters = np.full(shards.words, 2 ** 64 - 1, np.uint64)  # lets all pass where there are words
    found = list(spelling._candidates(words, filters, shards, "abcdefyz"))
    assert len(found) == len(set(found)) and all(is_near(words[i], c) for i, c in found)
    for a, b in [(1, "abcd"), (3, "z" * 399), (5, "z" * 400), (6, "aab")]:
        assert (a, b) in found


def test_filters_let_all_words_pass_and_few_others(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcdefghijklmnop", k=rng.choice([5, 8, 9, 70]))) for _ in range(4000)})
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    counts = Counter(min(len(w), spelling.LONGEST) for w in words)
    for budget in (1 << 27, 1 << 14):
        passed = 0
        for shards in spelling.Shards.for_counts(counts, Variants(budget=budget)):
            assert shards.words * 64 <= budget + 512 * len(counts) * 2
            filters = spelling.build_filters(table, shards)
            for _, codes in spelling._by_length(words):
                mixed = spelling.mix(spelling._hash(codes))
                passed += len(shards.passing(filters, codes.shape[1], mixed))
                assert set(np.flatnonzero(shards.mine(mixed))) <= set(shards.passing(filters, codes.shape[1], mixed))
            others = np.frombuffer(rng.randbytes(8 * 20000), np.uint64)
            mine = max(1, int(shards.mine(others).sum()))
            assert len(shards.passing(filters, 8, others)) < 0.03 * mine
        assert passed == len(words)


def test_variants_of_nothing(spark):
    assert spelling.group_variants(documents(spark, [])).count() == 0
    assert variants(spelling.group_variants(documents(spark, ["hello hello", "HELLO"]))) == [
        ("hello", "", "hello", 3, 0, 0)]


# --- token counts ------------------------------------------------------------------------------


ODD = [None, "", " \n", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|><|startoftext|>x", "don't I'LL we'Ve 's's",
       "é ́x   a\x1cb\x85c\xa0d", "漢字かな交じり文 한국어 ١٢٣ ½ ⅷ", "İstanbul ΣΑΣ ς ﬁ ǅ", "x" * 5000, "<|endof text|>",
       "😀😀 👩‍👩‍👧 a\n\n\tb\r\nc", "Å Å Å 가", "a " * 30000, "﻿a​b­c \x00 d", "supercalifragilistic " * 3]


def by_library(texts, path):
    tokenizer = Tokenizer.from_file(path)
    return [(len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("frequent", [1 << 17, 40, 1])
def test_counts_are_those_of_the_library(spark, name, frequent):
    path = public_tokenizers.path(name)
    found = token_counts.count_tokens(documents(spark, ODD).repartition(3), path, Counting(frequent)).collect()
    assert [(r.n_bytes, r.n_tokens) for r in sorted(found)] == by_library(ODD, path)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in found) and any(r.over_limit for r in found)


def test_counts_of_all_documents(spark, folder):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in rows.collect()}
    found = token_counts.count_tokens(rows, path).collect()
    assert [(r.n_bytes, r.n_tokens) for r in sorted(found)] == by_library([texts[k] for k in sorted(texts)], path)


def test_white_space_separates_only_where_the_file_drops_it():
    assert token_counts.PreTokens(public_tokenizers.path("word_bpe_49k.json")).splits_at_space
    assert not token_counts.PreTokens(public_tokenizers.path("byte_bpe_50k.json")).splits_at_space


def test_the_pattern_alone_does_for_ascii_what_the_file_does():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_counts.ascii_rule(public_tokenizers.path("byte_bpe_50k.json")) is None
    splitter, rng = token_counts.PreTokens(path), random.Random(4)
    printable = [chr(c) for c in range(33, 127)]
    runs = ["".join(rng.choices(printable, k=rng.randint(1, 12))) for _ in range(4000)]
    runs += ["".join(rng.choices("'stremvlldabZ09", k=9)) for _ in range(4000)] + printable
    for run, (added, strings) in zip(runs, splitter.of_runs(runs)):
        assert added == 0 and strings == splitter._strings(run)
    tokenizer = Tokenizer.from_file(path)
    mixed = [r + x for r, x in zip(runs, ["\x00", "\x7f", "é", "<|endoftext|>", "\u00a0x", "\t"] * 100)]
    for run, (added, strings) in zip(mixed, splitter.of_runs(mixed)):
        assert added + sum(map(splitter.pieces, strings)) == len(tokenizer.encode(run, add_special_tokens=False).ids)


def test_long_texts_are_counted_in_sections(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "SECTION", 10)
    monkeypatch.setattr(token_counts, "BLOCK", 40)
    splitter = token_counts.PreTokens(public_tokenizers.path("word_bpe_49k.json"))
    long = "one two\nthree  four " * 20 + "e" * 50 + " end"
    texts = ["a b", None, long, "", "short", "c d e f", "x" * 30, "g h", *["i"] * 60]
    found = {}
    for rows, block in splitter.blocks(pa.array(["skipped", *texts]).slice(1)):
        assert len(rows) == len(block) and (len(rows) == 1 or sum(len(t.as_py() or "") for t in block) <= 40)
        at, codes, runs = splitter.runs(block)
        for row, code in zip(rows[at], codes):
            found.setdefault(int(row), []).append(runs[code])
    assert [[r for r in found.get(i, []) if r] for i in range(len(texts))] == [(t or "").split() for t in texts]


def test_repeated_and_missing_ids_and_nothing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    found = token_counts.count_tokens(documents(spark, ["a b", "a b", "c", "d e f"], [7, 7, None, None]), path)
    assert sorted(map(tuple, found.collect()), key=str) == [
        (7, 3, 2, False), (7, 3, 2, False), (None, 1, 1, False), (None, 5, 3, False)]
    assert token_counts.count_tokens(documents(spark, []), path).count() == 0
