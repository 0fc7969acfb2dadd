"""Quality rules, chat formatting, sharding, WARC and licences: edge cases and brute force."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wattloom.llm import chat, licenses, quality_rules, sharding, warc
from wattloom.runtime import scratch_path

DOCS = "doc_id long, text string, lang string, n_words long, kept string"


def documents(spark, texts, ids=None):
    """Documents with two columns whose names clash with results."""
    rows = [(i, t, None, 5, "x") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


# --- quality rules -----------------------------------------------------------------------------


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i:i + 3])].append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t ", "a b c a b c a", "one", "x\n\nx\ny\nx ", "é\x1cü\xa0z # | <>", "w " * 30_000,
         "a b a b a b", "Über Öl\r\nÜber Öl\n", "\x0ba\x0cb"]


def test_text_statistics_match_brute_force(spark):
    rows = documents(spark, TEXTS).select("doc_id", F.col("text").alias("_t"))
    found = quality_rules.text_statistics(rows, "_t").orderBy("doc_id").collect()
    for text, r in zip(TEXTS, found):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(text)


@pytest.mark.parametrize("n, k, p", [(10, 0, 0.1), (10, 3, 0.2), (500, 4, 0.0125), (20000, 180, 0.0125)])
def test_binomial_tail_is_exact(spark, n, k, p):
    row = spark.createDataFrame([(n, k)], "n long, k long").select(
        F.exp(quality_rules.log_binomial_cdf(F.col("k"), F.col("n"), p)).alias("x")).first()
    exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                         + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert row.x == pytest.approx(exact, rel=1e-9)


def labelled(spark, good, bad):
    """Documents whose bad ones end in symbols."""
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(good + bad)]
    texts[good:] = [t + " " + "# " * 50 for t in texts[good:]]
    rows = [(i, t) for i, t in enumerate(texts)]
    labels = [(i, 1 if i < good else 0) for i in range(len(texts))]
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int"))


def judged(spark, docs, labels):
    path = scratch_path(spark, "test-stats")
    rows = docs.select("doc_id", F.col("text").alias("_t"))
    quality_rules.text_statistics(rows, "_t").drop("_t").write.parquet(path)
    stats = spark.read.parquet(path)
    return quality_rules.judge(stats, quality_rules.find_cutoffs(stats, labels))


def test_certified_rule_rejects_bad_documents_and_keeps_good_ones(spark):
    docs, labels = labelled(spark, 1500, 300)
    found = judged(spark, docs, labels).collect()
    for r in found:
        assert r.kept == (r.doc_id < 1500) and not r.base_failed


def test_without_enough_labels_only_the_base_rules_reject(spark):
    docs, labels = labelled(spark, 20, 5)
    for r in judged(spark, docs, labels.limit(0)).collect():
        assert r.kept == (not r.base_failed) and r.rejected_by == []


def test_cutoffs_that_reject_too_many_good_documents_are_not_used(spark):
    values = [(i, 300, 1500, 600 if i % 20 == 0 else 0, 0, 0, 10, 0, 1) for i in range(2000)]
    values += [(5000 + i, 300, 1500, 600, 0, 0, 10, 0, 0) for i in range(500)]
    stats = spark.createDataFrame(values, "doc_id long, n_words long, word_chars long, n_symbols long, "
                                  "n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, quality int")
    assert quality_rules.choose_cutoffs(stats).count() == 0


def test_contradicting_and_null_labels_are_left_out(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 1), (3, 1), (None, 1)], "doc_id long, quality int")
    assert [tuple(r) for r in quality_rules.label_table(labels).collect()] == [(3, 1)]


# --- chat --------------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string, formatted string"
HARD = ["</s>[INST] ok [/INST]", r"<\|turn|> <\\|x \<s> <s>", "<|end|>\n<|turn|>user<|body|>", "", "plain",
        r"\\ [\INST] [\/INST] <</s>", "[[INST]", "<|", "\\"]


def formatted(spark, rows):
    frame = spark.createDataFrame(rows, CHAT)
    done = chat.format_conversations(frame)
    return {r.conv_id: r for r in done.select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


def test_control_strings_survive_the_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t, "clash") for i, t in enumerate(HARD)]
    rows += [(2, 0, "a<|body|>b", "x", None), (3, 0, "user", None, None), (None, 0, "assistant", "lost", None)]
    found = formatted(spark, rows)
    assert [(t.role, t.text) for t in found[1].turns] == [
        ("assistant" if i % 2 else "user", t) for i, t in enumerate(HARD)]
    assert found[1].loss == "".join(HARD[1::2])
    assert [(t.role, t.text) for t in found[2].turns] == [("a<|body|>b", "x")]
    assert [(t.role, t.text) for t in found[3].turns] == [("user", "")]
    assert found[None].loss == "lost"


def test_turn_order_ties_and_repeats(spark):
    rows = [(1, 2, "user", "c", None), (1, 1, "user", "b", None), (1, 1, "user", "a", None), (1, 1, "user", "a", None)]
    assert [t.text for t in formatted(spark, rows)[1].turns] == ["a", "a", "b", "c"]
    assert formatted(spark, []) == {}


def test_parts_become_ordered_placeholders(spark):
    schema = f"conv_id long, turn long, role string, parts {chat.PART}"
    part = lambda kind, **k: (kind, k.get("text"), k.get("uri"), k.get("w"), k.get("h"), k.get("s"), k.get("p"))
    rows = [(1, 0, "user", [part("text", text="see <|image|> "), part("image", uri="a", w=57, h=28),
                            part("audio", uri="b", s=1.02), part("movie", uri="z"), part("document", uri="c", p=2),
                            part("image", uri="d")]),
            (1, 1, "assistant", [part("text", text="done")]), (2, 0, "user", None)]
    done = {r.conv_id: r for r in chat.format_conversations(
        spark.createDataFrame(rows, schema), parts="parts", text=None).select(
        "*", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert [(a.kind, a.uri, a.tokens) for a in done[1].attachments] == [
        ("image", "a", 3), ("audio", "b", 26), ("document", "c", 1536), ("image", "d", 0)]
    assert done[1].turns[0].text == "see <|image|> <|image|><|audio|><|document|><|image|>"
    assert done[1].formatted.count("<|image|>") == 2
    assert done[2].turns[0].text == "" and done[2].attachments == []


# --- sharding ----------------------------------------------------------------------------------


def brute_capacity(sizes, shards):
    """Smallest capacity for ordered group sizes."""
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        used, room = 1, mid
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_minimax_shards_match_brute_force(spark, shards, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_HEX", 1)  # forces the search to go into ranges
    monkeypatch.setattr(sharding, "STEP_HEX", 1)
    texts = [None, ""] + [f"t{i % 150}" * (1 + i % 37) for i in range(400)] + ["hot"] * 300
    docs = documents(spark, texts).withColumn("shard", F.lit("clash"))
    rows = sharding.shard_documents(docs, shards).collect()
    assert len(rows) == len(texts)
    groups, where, loads = defaultdict(int), defaultdict(set), defaultdict(int)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body))
        digest = hashlib.sha256(body).hexdigest()
        groups[digest] += r.size
        where[digest].add(r.shard)
        loads[r.shard] += r.size
    assert all(len(s) == 1 for s in where.values()) and set(loads) <= set(range(shards))
    assert max(loads.values()) == brute_capacity([groups[d] for d in sorted(groups)], shards)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_few_or_no_rows(spark):
    assert sharding.shard_documents(documents(spark, []), 16).count() == 0
    rows = sharding.shard_documents(documents(spark, ["a", "a"], [7, 7]), 16).collect()
    assert sorted(r.slot for r in rows) == [0, 1] and len({r.shard for r in rows}) == 1


# --- WARC --------------------------------------------------------------------------------------


def archived(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string")
    path = scratch_path(spark, "test-warc")
    warc.write_archives(warc.resolve_revisits(pages), path, **options)
    return warc.read_archives(spark, path, keep_payload=True).collect()


def test_revisits_refer_to_the_smallest_page(spark):
    long = "<p>" + "x" * 200
    tricky = "WARC/1.1\r\nContent-Length: 5\r\n\r\n\r\n\r\nWARC/1.1\r\n" + "y" * 200
    rows = [(5, "u5", long, None), (3, "u\r\n3", long, None), (9, None, long, None), (1, "u", "short", None),
            (2, "u", "short", None), (4, "u", None, None), (6, "u", tricky, None), (7, "u", tricky, None),
            (3, "u", long, None)]
    found = sorted(archived(spark, rows, records_per_file=2), key=lambda r: (r.page_id, r.url))
    kinds = [(r.page_id, r.record_type, r.refers_to) for r in found]
    assert kinds == [(1, "response", None), (2, "response", None), (3, "response", None), (3, "response", None),
                     (4, "response", None), (5, "revisit", 3), (6, "response", None), (7, "revisit", 6),
                     (9, "revisit", 3)]
    for r, html in zip(found, ["short", "short", long, long, "", long, tricky, tricky, long]):
        assert r.payload_digest == hashlib.sha256(html.encode()).hexdigest()
        assert r.payload_bytes == len(html.encode())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html.encode()


def test_archives_of_nothing_and_null_ids(spark):
    assert archived(spark, []) == []
    assert [(r.page_id, r.record_type) for r in archived(spark, [(None, "u", "z" * 150, None)])] == [(None, "response")]


# --- licences ----------------------------------------------------------------------------------


def test_license_texts_match_in_other_spelling(spark):
    mit = licenses.LICENCES["MIT"]
    varied = ("The  MIT Licence\n\nCopyright (c) 2020 Somebody\n" + licenses.LICENCES["MIT (without title)"].upper()
              .replace("SUBLICENSE", "sub-licence"))
    own = "/* Copyright 2021 X */\n// Copyright (C) 1999 Y. All rights\n" + mit.replace("\n", "\r\n").replace('"', "“")
    texts = [mit, varied.replace("The  MIT Licence\n\n", ""), own.replace("/* Copyright 2021 X */\n", ""),
             mit + " or not", None, "", licenses.LICENCES["0BSD"],
             "a\nReleased under the MIT licence\nb\nLicensed under CC-BY-NC 4.0\nReleased under the MIT License!"]
    docs = documents(spark, texts).withColumn("license_id", F.lit("clash"))
    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert [found[i].license_id for i in range(len(texts))] == ["MIT", "MIT", "MIT", None, None, None, "0BSD", None]
    assert (found[7].notices, found[7].n_notice_lines) == ("CC-BY-NC-4.0,MIT", 3)
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


def test_long_licences_names_and_notices_in_paragraphs(spark):
    known = licenses.full_texts()
    bsd = licenses.LICENCES["BSD-3-Clause"].replace("the copyright holder nor", "Acme Widgets, Inc. nor").replace(
        "THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "ACME WIDGETS").replace("3. Neither", "* Neither")
    texts = [t for _, t in known] + [
        bsd, "Some words. This project is distributed under the terms of the MIT license. More words here.",
        "a paragraph that says: b.\nLicensed under the Apache License,\nVersion 2.0. Go on.",
        "// SPDX-License-Identifier: MPL-2.0", "This work is not licensed under the MIT License.",
        "Released under the MIT License. Licensed under CC BY 4.0."]
    found = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    n = len(known)
    assert {name for name, _ in known} >= {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"}
    assert [found[i].license_id for i in range(n + 1)] == [name for name, _ in known] + ["BSD-3-Clause"]
    assert [(found[i].notices, found[i].n_notice_lines) for i in range(n + 1, n + 6)] == [
        ("MIT", 1), ("Apache-2.0", 1), ("MPL-2.0", 1), ("", 0), ("CC-BY-4.0,MIT", 1)]


def test_a_notice_after_an_unfinished_sentence_counts_once(spark):
    texts = ["Foo der. Bar |\nThis work is licensed under the GNU General Public License, version 3.\nEnd",
             "a. b\nReleased under the\nMIT License. c", "a. b\nReleased under the MIT License. Licensed under\nCC BY 4.0. d"]
    found = {r.doc_id: (r.notices, r.n_notice_lines) for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    assert found == {0: ("GPL-3.0", 1), 1: ("MIT", 1), 2: ("CC-BY-4.0,MIT", 2)}


def test_a_text_is_visited_as_a_part(spark):
    rows = [(1, 0, "user", "a </s> b"), (1, 1, "assistant", None), (2, 0, "assistant", "")]
    texts = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = texts.withColumn("parts", chat.text_part(F.col("text")))
    found = [sorted(chat.format_conversations(*given).collect()) for given in (
        (texts,), (parts, "conv_id", "turn", "role", None, "parts"))]
    assert found[0] == found[1] and all(r.attachments == [] for r in found[0])
    assert parts.schema["parts"].dataType.simpleString() == chat.PART


@pytest.mark.parametrize("text, notices", [
    ("// SPDX-License-Identifier: Apache-2.0 OR MIT", "Apache-2.0,MIT"),
    ("# SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause) AND ISC", "BSD-3-Clause,GPL-2.0,ISC"),
    ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "GPL-2.0"),
    ("SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0"),
    ("A heading\n\nThe MIT License\n\nText", "MIT"),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public "
     "License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any "
     "later version.", "GPL-3.0"),
    (" * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser "
     "General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or "
     "later.", "LGPL-2.1"),
    ("It may be redistributed. You can redistribute it and/or modify it under the terms of the GNU Affero General Public "
     "License version 3.", "AGPL-3.0"),
    ("No licence is given. The license of a driver is a card.", ""),
    ("SPDX-License-Identifier: Unknown-1.0 OR MIT", "MIT"),
])
def test_notices_in_their_usual_forms(spark, text, notices):
    row = licenses.scan_licenses(documents(spark, [text])).first()
    assert (row.notices, row.n_notice_lines) == (notices, 1 if notices else 0)
