"""The registered queries next to their SQL, and the pipeline."""

import base64
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tools.check import compare
from wattloom.llm import language_id, oracle, queries
from wattloom.sources.tables import table

NAMES = ["documents", "embeddings", "labels", "pages", "benchmark", "conversations"]


@pytest.mark.parametrize("name", sorted(queries.registered()))
def test_query_equals_its_sql(spark, folder, name):
    connection = duckdb.connect()
    for t in NAMES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = queries.registered()[name](spark, folder).toPandas()
    assert len(found)
    assert compare(found, connection, oracle.statements().get(name)).startswith(("ok", "rows only"))


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.registered()) == list(range(1, 14))
    assert set(oracle.statements()) <= set(queries.registered())


def test_stages_keep_the_columns_and_reduce_documents(spark, folder, tmp_path):
    docs, counts = table(spark, folder, "documents"), []
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            counts.append(docs.count())
            assert docs.select("doc_id").distinct().count() == counts[-1]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    left = spark.read.parquet(str(tmp_path / "decontamination"))
    assert docs.select("doc_id").distinct().count() == left.count()


def test_stages_take_odd_rows_and_clashing_columns(spark, folder, tmp_path):
    body = " ".join(f"Word{i} of the" for i in range(60))
    rows = [(1, body, None, "kept", 1), (2, body + " x", "en", "n_words", 2), (2, body + " x", "en", "n_words", 2),
            (None, body, "en", None, None), (4, None, "en", "s", 4), (5, "", "en", "s", 5), (6, "1 2 3 " * 30, "en", "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, n_words long")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for part, rows_in in (("full", docs), ("empty", docs.limit(0))):
            stage(spark, rows_in, folder).write.parquet(str(tmp_path / f"{name}-{part}"))
        assert spark.read.parquet(str(tmp_path / f"{name}-empty")).count() == 0
        docs = spark.read.parquet(str(tmp_path / f"{name}-full"))
        if i == 3:
            assert sorted((r.doc_id or 0, r.lang) for r in docs.collect()) == [(0, "en"), (1, "en")]


def test_language_stage_drops_gibberish_and_unlearnt_languages(spark, folder, tmp_path):
    rng = random.Random(11)
    lower, cyrillic = "abcdefghijklmnopqrstuvwxyz", [chr(0x430 + i) for i in range(32)]
    gibberish = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(3, 9))) for _ in range(60))
    planted = [gibberish(lower), gibberish(cyrillic), base64.b64encode(rng.randbytes(400)).decode(),
               gibberish([chr(0x4E00 + i) for i in range(2000)]), " ".join(["Съешь ещё этих мягких булок"] * 12)]
    clean = table(spark, folder, "documents").filter("lang IS NOT NULL AND length(text) > 200")
    rows = [(10 ** 9 + i, t, None) for i, t in enumerate(planted)] + [(10 ** 9 + 9, planted[0], "en")]
    marked = clean.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    marked.write.parquet(str(tmp_path / "documents"))
    docs = spark.read.parquet(str(tmp_path / "documents"))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, folder).select("doc_id").collect()}

    wanted = {r.doc_id for r in clean.collect()}
    model, bounds = language_id.learn_with_bounds(docs, "doc_id", "text", "lang", F.lit(True))
    assert set(bounds) == set(model.names)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rates = {r.doc_id: (r.lang_pred, r.bits_per_byte) for r in language_id.predict(docs, "text", model).collect()}
    assert kept == {d for d in texts if rates[d][1] <= bounds[rates[d][0]]}
    assert kept & {r[0] for r in rows} == set() and len(wanted - kept) == 0


def test_language_stage_learns_from_every_labelled_document(spark):
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(3, 7)))
    rows = [(i, " ".join(word("abcdefgh") for _ in range(4)), "a") for i in range(500)]
    rows += [(None if i % 7 == 0 else 1000 + i, " ".join(word("stuvwxyz") for _ in range(4)), "b") for i in range(350)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model, bounds = language_id.learn_with_bounds(docs, "doc_id", "text", "lang", F.lit(True))
    assert set(bounds) == {"a", "b"} and all(2 < b < 16 for b in bounds.values())
    table = language_id.count_contexts(docs.select("lang", "text")).toArrow()
    whole = language_id.build_model(table.column("lang").to_pylist(), table.column("code").to_numpy(),
                                    table.column("c").to_numpy(), language_id.Settings())
    for name in ("two", "three", "lower", "rows"):
        assert (getattr(model, name) == getattr(whole, name)).all()
    for mine, theirs in zip([*model.bits, *model.escape], [*whole.bits, *whole.escape]):
        assert (mine == theirs).all()
    # One model in two languages with few kept contexts, so that most codes are merged.
    few = language_id.Settings(pairs=5, triples=4)
    one, _ = language_id.learn_with_bounds(docs, "doc_id", "text", "lang", F.lit(True), few)
    other = language_id.build_model(table.column("lang").to_pylist(), table.column("code").to_numpy(),
                                    table.column("c").to_numpy(), few)
    assert all((getattr(one, n) == getattr(other, n)).all() for n in ("two", "three", "lower", "rows"))
    assert all((x == y).all() for x, y in zip([*one.bits, *one.escape], [*other.bits, *other.escape]))


def test_language_bounds_are_the_medians(spark):
    rates = [("a", x) for x in (1.0, 5.0, 2.0)] + [("b", x) for x in (4.0, 1.0, 2.0, 3.0)] + [("c", 0.5)]
    found = language_id._medians(spark.createDataFrame(rates, "lang string, rate double"))
    assert found == {"a": 2.0, "b": 2.5, "c": 0.5}
