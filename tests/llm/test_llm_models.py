"""Shingle joins, decontamination, models and packing: brute force, held-out accuracy and round trips."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wattloom.llm import (
    bitmap, components, cutting_stock, decontaminate, language_id, ngram_join, packing, quality_model, queries, textops,
)
from wattloom.llm.queries import byte_bpe_50k
from wattloom.runtime import scratch_path
from wattloom.sources.tables import table

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, ids=None):
    rows = [(i, t, 1, "clash") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, node string")


def brute_set(text, width, pattern=r"[^\x20\x09-\x0D]+"):
    words = re.findall(pattern, (text or "").translate(ASCII_LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def near_texts(seed, families=12, copies=14):
    """Families of near copies with growing numbers of edits, passages shared by many, and odd texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = " ".join(rng.choices(words, k=20))
    texts = [None, "", "  \n", "Two Words", "two words", "one", "a\x1cb c d e", "É é"]
    for _ in range(families):
        base = rng.choices(words, k=rng.randint(30, 160))
        for c in range(copies):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
            if c % 3 == 0:
                texts.append("\t".join(copy).upper())
    texts += [passage + " " + " ".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(60)]
    texts += ["w " * 20_000]
    return texts


# --- words and shingles ------------------------------------------------------------------------


def test_words_and_shingles_of_blocks(monkeypatch):
    monkeypatch.setattr(textops, "BLOCK", 64)
    texts = ["a b", "", None, " c", "d ", "éß x\ny\x0bz", "long" * 100, "q " * 100, "a b"]
    column = pa.array(["skip", *texts], pa.string()).slice(1)
    found, hashes = [], {}
    for lo, hi, data, offsets in textops.blocks(column, 64):
        words = textops.find_words(data, offsets)
        h = words.hashes()
        for i in range(hi - lo):
            span = range(words.first[i], words.first[i + 1])
            mine = [data[words.starts[k]:words.ends[k]].tobytes().decode() for k in span]
            found.append(mine)
            for k, w in zip(span, mine):
                assert hashes.setdefault(w, h[k]) == h[k]
    assert found == [(t or "").split() for t in texts]
    assert len(set(hashes.values())) == len(hashes)


# --- n-gram join -------------------------------------------------------------------------------


def brute_components(texts, ids, width, per_cent):
    sets = defaultdict(set)
    rows = [(i, brute_set(t, width)) for i, t in zip(ids, texts)]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    inverted = defaultdict(list)
    for k, (_, s) in enumerate(rows):
        for x in s:
            inverted[x].append(k)
    pairs = {(a, b) for found in inverted.values() for a in found for b in found if a < b}
    for a, b in pairs:
        common = len(rows[a][1] & rows[b][1])
        if 100 * common >= per_cent * (len(rows[a][1]) + len(rows[b][1]) - common):
            parent[root(a)] = root(b)
    for k, (i, _) in enumerate(rows):
        sets[root(k)].add(i)
    return [(i, len(s), min(sets[root(k)])) for k, (i, s) in enumerate(rows)]


@pytest.mark.parametrize("width, per_cent, rare, block", [(4, 85, 32, 256), (5, 80, 3, 4), (4, 85, 2, 3)])
def test_components_match_brute_force(spark, width, per_cent, rare, block):
    texts = near_texts(width * rare)
    join = ngram_join.Join(width=width, per_cent=per_cent, rare=rare, block=block)
    found = ngram_join.ngram_components(documents(spark, texts), join=join).collect()
    assert sorted(map(tuple, found)) == sorted(brute_components(texts, range(len(texts)), width, per_cent))


def test_join_of_nothing_and_repeated_rows(spark):
    assert ngram_join.ngram_components(documents(spark, [])).count() == 0
    texts = ["a b c d e f", "a b c d e f", "A b c d e f", None, ""]
    found = ngram_join.ngram_components(documents(spark, texts, [4, 4, 2, 9, None])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in found if r.doc_id) == [
        (2, 2, 2), (4, 2, 2), (4, 2, 2), (9, 0, 9)]


def test_more_shared_shingles_than_a_bitmap_takes_are_tested_in_parts(spark, monkeypatch):
    """A full bitmap would let every shingle pass."""
    texts = near_texts(20)
    monkeypatch.setattr(bitmap, "bits_for", lambda keys: max(64, 1 << (2 * keys).bit_length() - 1))
    stored, store = [], ngram_join.Scratch.store
    monkeypatch.setattr(ngram_join.Scratch, "store", lambda self, name, df: stored.append(name) or store(self, name, df))
    found = ngram_join.ngram_components(documents(spark, texts), join=ngram_join.Join(width=4, rare=3, block=4)).collect()
    assert sorted(map(tuple, found)) == sorted(brute_components(texts, range(len(texts)), 4, 80))
    assert len([x for x in stored if x.startswith("usual")]) > 1


def test_repeated_texts_alone_share_no_shingles(spark, monkeypatch):
    """One row stands for equal sets, also where ids are null or repeat."""
    rows, store = {}, ngram_join.Scratch.store

    def watched(self, name, df):
        out = store(self, name, df)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join.Scratch, "store", watched)
    texts = [f"{i} " + " ".join(f"w{i}x{k}" for k in range(20)) for i in range(3)] * 4
    found = ngram_join.ngram_components(documents(spark, texts, [0, None, None, *range(3, 11), 3])).collect()
    assert rows["counts"] == 0 and len(found) == 12
    by_text = {}
    for i, t in zip([0, None, None, *range(3, 11), 3], texts):
        by_text.setdefault(t, []).append(i)
    lowest = {i: min(x for x in ids if x is not None) for ids in by_text.values() for i in ids if i not in (None, 3)}
    assert all(r.component_id == lowest[r.doc_id] for r in found if r.doc_id in lowest)


def test_a_bitmap_grows_with_its_keys(spark):
    assert bitmap.bits_for(0) == bitmap.bits_for(1000) == bitmap.BITS < bitmap.bits_for(1 << 23) < bitmap.bits_for(1 << 40)
    assert bitmap.bits_for(1 << 40) == bitmap.MOST_BITS
    keys = np.random.default_rng(2).integers(-2 ** 63, 2 ** 63, 400)
    for bits in (1 << 12, 1 << 26):
        words = bitmap.build(spark.createDataFrame([(int(k),) for k in keys], "h long"), "h", bits)
        others = bitmap.contains(words, np.random.default_rng(3).integers(0, 2 ** 63, 1000).astype(np.uint64))
        assert 64 * len(words) == bits and bitmap.contains(words, keys.view(np.uint64)).all() and others.mean() < 0.2


def test_components_of_long_paths(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z")]
    found = components.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()
    assert {(r.node, r.root) for r in found} == {(f"{i:03}", "000") for i in range(41)} | {("x", "x"), ("y", "x")}


# --- decontamination ---------------------------------------------------------------------------


def test_leaks_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(3000)]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [" ".join(rng.choices(words, k=k)) for k in (5, 6, 8, 15, 33, 70, 300)] + ["only three words", None, ""]
    texts = [None, "", "Only three, WORDS", "only three words more"]
    for item in items[:7]:
        body = item.split()
        for lost in (0, 1, 2, 5):
            some = list(body)
            for _ in range(min(lost * len(body) // 40 + lost // 2, len(some) - 1)):
                some[rng.randrange(len(some))] = "other"
            texts.append(" ".join(rng.choices(words, k=800)) + " " + ", ".join(some).title() + ". "
                         + " ".join(rng.choices(words, k=rng.randint(0, 4000))))
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, n int")
    found = {(r.doc_id, r.item_id): (r.shared, r.item_shingles) for r in decontaminate.find_leaks(
        documents(spark, texts), benchmark).collect()}
    sets = [brute_set(t, 5, pattern) for t in texts]
    wanted = {}
    for i, item in enumerate(items):
        mine = brute_set(item, 5, pattern)
        for d, s in enumerate(sets):
            if mine and 100 * len(mine & s) >= 80 * len(mine):
                wanted[d, i] = (len(mine & s), len(mine))
    assert found == wanted and len(wanted) > 10


@pytest.mark.parametrize("n", [1, 2, 5, 16, 17, 64, 1000])
def test_a_document_over_the_threshold_always_meets_the_sketch(spark, n):
    items = spark.createDataFrame([(1, 7 * i - 900) for i in range(n)], "id long, h long")
    rows = decontaminate._sketched(items, decontaminate.Search()).collect()
    in_sketch, least = sum(r.in_sketch for r in rows), {r.least_hits for r in rows}
    missed = n - -(-80 * n // 100)  # shingles that a document may lack
    assert least == {in_sketch - missed} and min(least) >= 1 and {r.n for r in rows} == {n}


def test_leaks_of_nothing(spark):
    benchmark = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.find_leaks(documents(spark, []), benchmark).count() == 0
    assert decontaminate.find_leaks(documents(spark, ["a b c d e f"]), benchmark.limit(0)).count() == 0
    again = documents(spark, ["x a b c d e f", "a b c d e f"], [7, 7])
    assert [(r.doc_id, r.shared) for r in decontaminate.find_leaks(again, benchmark).collect()] == [(7, 2)]


def test_only_what_meets_the_sketch_is_compared_further(spark):
    benchmark = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(104)))], "item_id long, text string")
    found = decontaminate.find_leaks(documents(spark, ["w1 w2 w3 w4 w5"]), benchmark)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "in_sketch" in plan and found.count() == 0


def test_halves_of_an_item_in_rows_of_one_id_are_no_leak(spark):
    words = [f"w{i}" for i in range(40)]
    benchmark = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    halves = [" ".join(words[:22]), " ".join(words[18:])]
    for ids in ([7, 7], [None, None]):
        assert decontaminate.find_leaks(documents(spark, halves, ids), benchmark).count() == 0
        whole = documents(spark, [*halves, " ".join(words)], [*ids, ids[0]])
        assert [(r.doc_id, r.shared) for r in decontaminate.find_leaks(whole, benchmark).collect()] == [(ids[0], 36)]


# --- language ID -------------------------------------------------------------------------------


def brute_bits(text, names, counts, kept, name):
    """Code length by asking contexts one after another."""
    data = b"\n\n\n" + text.encode()
    total = 0.0
    for i in range(3, len(data)):
        context = data[i - 3:i]
        longest = next(k for k in (3, 2, 1) if k == 1 or context[3 - k:] in kept[k])
        chance, factor = None, 1.0
        for k in range(longest, -1, -1):
            table = counts[name][k].get(context[3 - k:])
            if not table:
                continue
            n, d = sum(table.values()), len(table)
            if data[i] in table:
                chance = factor * table[data[i]] / (n + d)
                break
            factor *= d / (n + d)
        total -= np.log2(chance if chance is not None else factor / 256)
    return total


def test_long_texts_are_scored_and_counted_in_blocks(spark, monkeypatch):
    texts = ["abab abba äöü " * 30, "xyz zyx " * 50]
    sample = spark.createDataFrame([("x", texts[0]), ("y", texts[1])], "lang string, text string")

    def model_and_bits():
        counted = language_id.count_contexts(sample).toArrow().sort_by([("lang", "ascending"), ("code", "ascending")])
        model = language_id.build_model(counted["lang"].to_pylist(), counted["code"].to_numpy(), counted["c"].to_numpy(),
                                        language_id.Settings())
        parts = [language_id.code_lengths(data, offsets, model) for t in texts
                 for _, _, data, offsets in textops.blocks(pa.array([t]))]
        return counted, np.concatenate(parts)

    whole = model_and_bits()
    monkeypatch.setattr(textops, "BLOCK", 16)
    monkeypatch.setattr(language_id.textops, "BLOCK", 16)
    blocks = model_and_bits()
    np.testing.assert_allclose(blocks[1], whole[1], rtol=1e-5)
    data, letters = np.frombuffer(("1 " * 40 + "é").encode(), np.uint8), [True, False]
    for body, wanted in zip((data, data[:-2]), letters):
        assert language_id._has_letter(body, np.array([0, len(body)])).tolist() == [wanted]


def test_fifty_languages_keep_contexts_of_their_own(spark):
    rng = random.Random(8)
    letters = [chr(c) for c in range(0x0400, 0x2000) if chr(c).isalpha()]
    scripts = {f"l{k:02}": letters[12 * k:12 * k + 12] for k in range(50)}
    rows = []
    for k, (name, letters) in enumerate(scripts.items()):
        words = ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(30)]
        rows += [(100 * k + i, " ".join(rng.choices(words, k=40)), name) for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(table, "doc_id", "text", "lang", F.col("doc_id") % 4 != 0)
    assert len(model.names) == 50 and np.count_nonzero(model.two >= 0) > 1024
    found = language_id.predict(table, "text", model).filter("doc_id % 4 = 0").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)


def test_code_lengths_match_a_direct_search(spark):
    texts = {"x": ["abab abba abab", "baab"], "y": ["xyz zyx xyz abz", "é zz"]}
    sample = spark.createDataFrame([(k, t) for k, ts in texts.items() for t in ts], "lang string, text string")
    counted = language_id.count_contexts(sample).toArrow()
    settings = language_id.Settings(pairs=12, triples=9)
    model = language_id.build_model(counted["lang"].to_pylist(), counted["code"].to_numpy(),
                                    counted["c"].to_numpy(), settings)
    counts = {k: [defaultdict(Counter) for _ in range(4)] for k in texts}
    for name, ts in texts.items():
        for t in ts:
            data = b"\n\n\n" + t.encode()
            for i in range(3, len(data)):
                for k in range(4):
                    counts[name][k][data[i - k:i]][data[i]] += 1
    pairs = np.flatnonzero(model.two >= 0)
    kept = {2: {bytes([p >> 8, p & 255]) for p in pairs}, 3: set()}
    for p, i in zip(pairs, model.two[pairs]):
        kept[3] |= {bytes([b, p >> 8, p & 255]) for b in np.flatnonzero(model.three[i * 256:i * 256 + 256] >= 0)}
    assert len(kept[2]) == 12 and len(kept[3]) == 9
    queries = ["abab", "zyx é?", "", "q"]
    for _, _, data, offsets in textops.blocks(pa.array(queries)):
        bits = language_id.code_lengths(data, offsets, model)
    for q, row in zip(queries, bits):
        for name, b in zip(model.names, row):
            assert b == pytest.approx(brute_bits(q, model.names, counts, kept, name), rel=1e-5)


def test_languages_of_held_out_documents(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language_id.learn(docs, "doc_id", "text", "lang", ~held_out)
    found = language_id.predict(docs.filter(held_out & F.col("lang").isNotNull()), "text", model)
    share = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert share > 0.97


def test_texts_without_letters_are_unknown(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 — ?!"), (4, "ж"), (5, "a")], "doc_id long, text string")
    train = spark.createDataFrame([(1, "abc abc", "en"), (1, "abc abc", "en"), (2, "где где", "ru"), (3, None, "en"),
                                   (4, "x", None)], "doc_id long, text string, lang string")
    model = language_id.learn(train, "doc_id", "text", "lang", F.lit(True))
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(rows, "text", model).collect()}
    assert [found[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert found[4][0] == "ru" and found[5][0] == "en" and 0 < found[5][1] <= 1
    nothing = language_id.learn(train.limit(0), "doc_id", "text", "lang", F.lit(True))
    assert {r.lang_pred for r in language_id.predict(rows, "text", nothing).collect()} == {"und"}
    assert language_id.predict(rows.limit(0), "text", model).count() == 0


def test_every_language_is_learnt_whatever_its_rows(spark):
    rng = random.Random(5)
    bases = [0x61, 0x3B1, 0x430, 0x5D0, 0x627, 0x905, 0xE01, 0x10D0, 0x1200, 0x3041, 0xAC00, 0x4E00]
    letters = {f"l{i:02}": [chr(base + 8 * part + k) for k in range(8)]
               for i, (base, part) in enumerate((b, p) for b in bases for p in (0, 1))}
    sentence = lambda name: " ".join("".join(rng.choices(letters[name], k=5)) for _ in range(12))
    rows = [(100 * i + k, sentence(name), name) for i, name in enumerate(letters) for k in range(24 - i)]
    rows += [(9000 + k, sentence("l23"), "l23") for k in range(3)]
    rows += [(9999, None, "l22")] * 3 + [(9998, sentence("l00"), "l00")] * 3000
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(train, "doc_id", "text", "lang", F.lit(True))
    assert model.names == sorted(letters)
    asked = spark.createDataFrame([(n, sentence(n)) for n in letters for _ in range(4)], "lang string, text string")
    wrong = [r for r in language_id.predict(asked, "text", model).collect() if r.lang != r.lang_pred]
    assert wrong == []
    # A few ids, one of them hot: the share goes by distinct ids, and empty texts take no place of the sample.
    hot = spark.createDataFrame([(k, "abc", "en") for k in range(3)] + [(77, "abd", "en")] * 5000
                                + [(k, "", "fr") for k in range(20)] + [(500, "xyz", "fr")],
                                "doc_id long, text string, lang string")
    few = language_id.Settings(per_language=2)
    got = Counter(r.lang for r in language_id.sample_ids(hot, "doc_id", "text", "lang", F.lit(True), few).collect())
    assert got == {"en": 2, "fr": 1}


# --- quality classifier ------------------------------------------------------------------------


def test_quality_of_held_out_documents(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality_model.learn(docs, labels, ~held_out)
    scored = quality_model.score_documents(docs, model).join(labels, "doc_id").filter(held_out).toPandas()
    good, bad = scored[scored.quality == 1].score.values, scored[scored.quality == 0].score.values
    assert np.mean(good[:, None] > bad[None, :]) > 0.95
    assert scored.score.between(0, 1).all() and model.temperature > 0


def test_quality_without_labels_and_of_odd_texts(spark):
    docs = documents(spark, [None, "", "a a a", "###", "x" * 300_000, "good words here", "good words here"])
    labels = spark.createDataFrame([(5, 1), (6, 1), (5, None)], "doc_id long, quality int")
    nothing = quality_model.learn(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality_model.score_documents(docs, nothing).collect()} == {0.5}
    one_class = quality_model.learn(docs, labels, F.lit(True))
    assert {r.score for r in quality_model.score_documents(docs, one_class).collect()} == {1.0}
    both = quality_model.learn(docs, labels.union(spark.createDataFrame([(3, 0)], "a long, b int")), F.lit(True))
    assert all(0 <= r.score <= 1 for r in quality_model.score_documents(docs, both).collect())
    assert quality_model.score_documents(docs.limit(0), both).count() == 0


def test_pooling_in_parts_equals_pooling_at_once(monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(50, 8)).astype(np.float32)
    ids, text = rng.integers(0, 50, 300_000), np.sort(rng.integers(0, 5, 300_000)) + 1
    found = quality_model.pooled(ids, text, 7, vectors)
    for k in range(7):
        mine = vectors[ids[text == k]]
        assert np.allclose(found[k, :-1], mine.mean(0) if len(mine) else 0, atol=1e-4)


# --- packing -----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_patterns_cover_the_histogram(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 64): rng.randint(1, 300) for _ in range(rng.randint(1, 30))}
    used = Counter()
    for pattern, times in cutting_stock.cut_patterns(histogram, 64):
        assert sum(k * v for k, v in pattern.items()) <= 64 and times > 0
        for k, v in pattern.items():
            used[k] += v * times
    assert dict(used) == histogram


def test_column_generation_beats_first_fit():
    histogram = {26: 400, 20: 400, 18: 400}  # 26+20+18 fill 64; the longest first leave gaps
    found = cutting_stock.cut_patterns(histogram, 64)
    lengths, demand = np.array([18, 20, 26]), np.array([400] * 3)
    greedy = sum(t for _, t in cutting_stock._first_fit(lengths, demand, 64))
    assert sum(t for _, t in found) <= 402 < greedy


@pytest.mark.parametrize("capacity", [1024, 64, 7])
def test_packing_round_trip(spark, capacity):
    rng = random.Random(capacity)
    texts = [None, "", "a", "<|endoftext|> x", "é" * 40, "word " * 3000] + [
        " ".join(rng.choices(["the", "of", "Über", "12", "\n"], k=rng.randint(1, 200))) for _ in range(120)]
    docs = documents(spark, texts)
    packed = packing.pack_documents(docs, **byte_bpe_50k(), capacity=capacity, keep_ids=True)
    path = scratch_path(spark, "test-packed")
    packed.write.parquet(path)
    rows = spark.read.parquet(path).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(bytes(r.ids))
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        got = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in got for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert [r.start for r in got] == np.cumsum([0, *[r.length for r in got]])[:-1].tolist()
        assert {r.doc_tokens for r in got} == {len(ids)}
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    whole = packing.sequences(spark.read.parquet(path)).collect()
    assert sum(r.tokens for r in whole) == sum(r.length for r in rows)
    assert all(len(r.ids) == 4 * r.tokens <= 4 * capacity for r in whole)


def test_added_tokens_get_the_ids_of_the_tokenizer_file(spark, tmp_path):
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>\n y", "<|endoftext", "plain", None,
             "word " * 3000 + "<|endoftext|>"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = set()
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 1024):
            part = np.array(ids[at:at + 1024], "<u4")
            wanted.add((i, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for rows in (queries.op8_packing(spark, str(tmp_path)), corpus_pipeline.packed(spark, docs, str(tmp_path))):
        assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows.collect()} == wanted


def test_packing_nothing(spark):
    assert packing.pack_documents(documents(spark, []), **byte_bpe_50k()).count() == 0
