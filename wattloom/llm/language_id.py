"""Language identification by prediction by partial matching with frozen statistics.

Each language has a tree of byte contexts of up to three bytes. A byte that the longest kept context knows costs its
share there; else the escape probability of that context (method C: distinct followers over all) is paid and
the next shorter context is asked, down to equal chances for all bytes. Costs of all (context, byte)
pairs are worked out beforehand for all languages, so scoring a text is one table lookup per byte, and its code
length under each language is the exact sum. The shortest code wins; the score is its posterior share.

``learn`` takes at most ``per_language`` texts of every language (by a hash of the id), a bounded sample of the
labelled documents, ``learn_with_bounds`` takes all of them; every document is scored in whole, a long one in blocks of bytes. Kept contexts grow with the number of
languages and are taken from each in turn, so a rare script has its share. Costs are stored only for bytes that some language has seen
after a context, so the model grows with the languages by what they differ in.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so are all texts if there is
nothing to learn from; ties go to the language that comes first by name; repeated rows are scored alike; null ids are held
out; an empty table gives no rows. Other columns are passed on; none may have the name of a result.
"""

import codecs
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.llm import textops
from wattloom.llm.storage import Scratch

UNKNOWN = "und"
_BEFORE = 10  # what stands before the first byte of a text
_LETTERS = textops.byte_table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


@dataclass(frozen=True)
class Settings:
    per_language: int = 300
    #: Kept contexts of two and of three bytes for every four languages; each language has its most frequent ones in turn.
    pairs: int = 1024
    triples: int = 2048
    #: What a text may cost a byte, as a multiple of the median of its language's texts under a model without them.
    times_median: float = 2.0


@dataclass
class Model:
    """Costs in bits of a byte after a state (a kept context; the last is the empty one) under each language.

    two[b2, b1] and three[pair, b3] are the numbers of kept contexts, -1 if not kept. rows[state * 256 + byte] is a row
    of ``bits``, -1 if no language knows the byte there; then ``escape`` of the state is paid and state ``lower``
    is asked. The columns of ``bits`` and ``escape`` are in groups of languages.
    """

    names: list[str]
    two: np.ndarray
    three: np.ndarray
    lower: np.ndarray
    rows: np.ndarray
    bits: list[np.ndarray]
    escape: list[np.ndarray]


_GROUP = 16  # languages whose costs are looked up at a time


def sample_ids(documents: DataFrame, doc: str, text: str, lang: str, learn: Column, settings: Settings) -> DataFrame:
    """(doc_id, lang) of at most ``per_language`` rows with a text of each language."""
    rows = documents.filter(learn & F.col(lang).isNotNull() & (F.col(text) != "")).select(
        F.col(doc).alias("doc_id"), F.col(lang).alias("lang"))
    # The share of each language's ids, by hash, that holds about twice the wanted number; so the ranking
    # sees a few rows of a language however many it has.
    room = 1 << 20
    wanted = F.lit(2 * settings.per_language * room)
    shares = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("c")).select(
        "lang", (F.floor(wanted / F.greatest("c", F.lit(1))) + 1).alias("share"))
    some = rows.join(F.broadcast(shares), "lang").filter(
        F.pmod(F.xxhash64("doc_id"), F.lit(room)) < F.col("share")).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    return some.withColumn("_r", F.row_number().over(order)).filter(
        F.col("_r") <= settings.per_language).drop("_r")


def _previous(data: np.ndarray, offsets: np.ndarray, back: int) -> np.ndarray:
    """The byte ``back`` places before each byte within its text."""
    out = np.full(len(data), _BEFORE, np.int64)
    out[back:] = data[:-back] if back else data
    for k in range(back):
        at = offsets[:-1] + k
        out[at[at < offsets[1:]]] = _BEFORE
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, known bytes in front) of a block; a single long text comes in parts that begin with its context."""
    if len(offsets) > 2 or len(data) <= textops.BLOCK:
        yield data, offsets, 0
        return
    for at in range(0, len(data), textops.BLOCK):
        front = min(at, 3)
        part = data[at - front:at + textops.BLOCK]
        yield part, np.array([0, len(part)]), front


def count_contexts(sample: DataFrame) -> DataFrame:
    """(lang, code, c): how often four bytes, the last after the first three, occur in the texts of a language."""
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("c", pa.int64())])

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, data, offsets in textops.blocks(batch.column(1)):
                for part, ends, front in _pieces(data, offsets):
                    code = part.astype(np.int64)
                    for back in (1, 2, 3):
                        code |= _previous(part, ends, back) << (8 * back)
                    lengths = np.diff(ends)
                    for name in set(langs[lo:hi]):
                        mine = np.repeat(langs[lo:hi] == name, lengths)
                        found, c = np.unique(code[mine][front:], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(c.astype(np.int64))],
                            schema=schema)

    return sample.mapInArrow(run, "lang string, code long, c long").groupBy("lang", "code").agg(
        F.sum("c").alias("c"))


def _top(keys: np.ndarray, who: np.ndarray, share: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` distinct keys, in order: first the most frequent one of each language, then its second, ..."""
    both, inverse = np.unique(np.stack([who, keys]), axis=1, return_inverse=True)
    total = np.bincount(inverse.ravel(), share, both.shape[1])
    order = np.lexsort((both[1], -total, both[0]))
    own, key, total = both[0][order], both[1][order], total[order]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    values, at = np.unique(key, return_inverse=True)
    best = np.full(len(values), len(own))
    np.minimum.at(best, at, rank)
    return np.sort(values[np.lexsort((values, -np.bincount(at, total, len(values)), best))[:most]])


def build_model(langs: list[str], codes: np.ndarray, counts: np.ndarray, settings: Settings,
                kept: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """The cost tables from four-byte counts; ``kept`` are the pairs and triples if they were found before."""
    names = sorted(set(langs))
    index = {n: i for i, n in enumerate(names)}
    who = np.array([index[x] for x in langs], np.int64)
    context, byte = codes >> 8, codes & 255
    if kept is None:
        share = counts / np.bincount(who, counts, len(names))[who]
        times = -(-len(names) // 4)
        pairs = _top(context & 0xFFFF, who, share, settings.pairs * times)
        inside = np.isin(context & 0xFFFF, pairs)
        triples = _top(context[inside], who[inside], share[inside], settings.triples * times)
    else:
        pairs, triples = kept
    two = np.full(65536, -1, np.int32)
    two[pairs] = np.arange(len(pairs))
    three = np.full(max(1, len(pairs)) * 256, -1, np.int32)
    three[two[triples & 0xFFFF] * 256 + (triples >> 16)] = np.arange(len(triples))

    empty = 256 + len(pairs) + len(triples)
    lower = np.concatenate([np.full(256, empty), pairs & 255, 256 + two[triples & 0xFFFF], [empty]])
    second = two[context & 0xFFFF].astype(np.int64)
    third = np.where(second >= 0, three[np.maximum(second, 0) * 256 + (context >> 16)], -1).astype(np.int64)
    known = np.unique(np.concatenate([
        (context & 255) * 256 + byte, ((second + 256) * 256 + byte)[second >= 0],
        ((third + 256 + len(pairs)) * 256 + byte)[third >= 0], empty * 256 + np.arange(256)]))
    rows = np.full((empty + 1) * 256, -1, np.int32)
    rows[known] = np.arange(len(known))

    bits = [np.empty((len(known), len(names[k:k + _GROUP])), np.float32) for k in range(0, len(names), _GROUP)]
    escape = [np.empty((empty + 1, x.shape[1]), np.float32) for x in bits]
    for k in range(len(names)):
        mine = who == k
        b, c, ctx = byte[mine], counts[mine].astype(float), context[mine]

        def refine(state, size, shorter):
            """Chances in each of ``size`` contexts and of leaving them; ``shorter`` are those of the shorter contexts."""
            seen = state >= 0
            table = np.bincount(state[seen] * 256 + b[seen], c[seen], size * 256).reshape(size, 256)
            total, distinct = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
            leave = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
            return np.where(table > 0, table / np.maximum(total + distinct, 1), leave * shorter), leave[:, 0]

        none, leave0 = refine(np.zeros(len(b), np.int64), 1, np.full((1, 256), 1 / 256))
        one, leave1 = refine(ctx & 255, 256, none)
        twos, leave2 = refine(second[mine], len(pairs), one[pairs & 255])
        threes, leave3 = refine(third[mine], len(triples), twos[two[triples & 0xFFFF]])
        group, at = divmod(k, _GROUP)
        bits[group][:, at] = -np.log2(np.concatenate([one, twos, threes, none]).ravel()[known])
        escape[group][:, at] = -np.log2(np.concatenate([leave1, leave2, leave3, leave0]))
    return Model(names, two, three, lower, rows, bits, escape)


def code_lengths(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Bits of each text under each language, with memory for about a block of bytes at a time."""
    return sum(_code_lengths(*piece, model) for piece in _pieces(data, offsets))


def _code_lengths(data: np.ndarray, offsets: np.ndarray, front: int, model: Model) -> np.ndarray:
    """The same, without the cost of the first ``front`` bytes."""
    out = np.zeros((len(offsets) - 1, len(model.names)))
    filled = np.flatnonzero(np.diff(offsets) > 0)
    if not len(filled):
        return out
    b1, b2, b3 = (_previous(data, offsets, k) for k in (1, 2, 3))
    pair = model.two[b2 << 8 | b1]
    triple = model.three[np.maximum(pair, 0) * 256 + b3]
    pairs = np.count_nonzero(model.two >= 0)
    state = np.where(pair < 0, b1, np.where(triple < 0, pair + 256, triple + 256 + pairs))
    row, left = model.rows[state * 256 + data], []
    lost = np.flatnonzero(row < 0)
    while len(lost):  # the empty context knows all bytes
        left.append((lost, state[lost]))
        state[lost] = model.lower[state[lost]]
        row[lost] = model.rows[state[lost] * 256 + data[lost]]
        lost = lost[row[lost] < 0]
    for i, (bits, escape) in enumerate(zip(model.bits, model.escape)):
        cost = bits[row]
        for lost, states in left:
            cost[lost] += escape[states]
        out[filled, i * _GROUP:(i + 1) * _GROUP] = np.add.reduceat(
            cost, offsets[:-1][filled] + front, axis=0, dtype=np.float64)
    return out


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if len(offsets) == 2 and len(data) > textops.BLOCK:
        decoder = codecs.getincrementaldecoder("utf-8")()
        parts = (data[at:at + textops.BLOCK].tobytes() for at in range(0, len(data), textops.BLOCK))
        return np.array([any(any(map(str.isalpha, decoder.decode(part))) for part in parts)])
    count = np.concatenate([[0], np.cumsum(_LETTERS[data])])
    found = count[offsets[1:]] > count[offsets[:-1]]
    high = np.concatenate([[0], np.cumsum(data >= 128)])
    for i in np.flatnonzero(~found & (high[offsets[1:]] > high[offsets[:-1]])):
        found[i] = any(map(str.isalpha, data[offsets[i]:offsets[i + 1]].tobytes().decode()))
    return found


def _sample(documents: DataFrame, doc: str, text: str, lang: str, which: Column, settings: Settings) -> DataFrame:
    """(lang, text): the rows to learn from."""
    ids = sample_ids(documents, doc, text, lang, which, settings)
    # At most per_language rows of two short columns for each language.
    texts = documents.select(F.col(doc).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    return texts.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text")


def learn(documents: DataFrame, doc: str, text: str, lang: str, which: Column,
          settings: Settings = Settings()) -> Model | None:
    """The model of a bounded sample of the rows that ``which`` allows; None without any."""
    counted = count_contexts(
        _sample(documents, doc, text, lang, which, settings)).toArrow()
    if not counted.num_rows:
        return None
    return build_model(counted.column("lang").to_pylist(), counted.column("code").to_numpy(),
                       counted.column("c").to_numpy(), settings)


def _arrays(counted: DataFrame, *names: str) -> list[np.ndarray]:
    table = counted.toArrow()
    return [np.array(table.column(n).to_pylist(), object) if n == "lang" else table.column(n).to_numpy() for n in names]


def _model_of(counts: DataFrame, settings: Settings) -> Model | None:
    """The model of (lang, code, c); what reaches the driver is bounded by the languages and the kept contexts."""
    spark = counts.sparkSession
    context = F.shiftright("code", 8)
    pair = context.bitwiseAND(0xFFFF)
    langs, keys, c = _arrays(counts.groupBy("lang", pair.alias("pair")).agg(F.sum("c").alias("c")), "lang", "pair", "c")
    if not len(langs):
        return None
    names = sorted(set(langs))
    index = {n: i for i, n in enumerate(names)}
    times = -(-len(names) // 4)
    who = np.array([index[x] for x in langs], np.int64)
    total = np.bincount(who, c, len(names))
    pairs = _top(keys.astype(np.int64), who, c / total[who], settings.pairs * times)

    def broadcast(values: np.ndarray, name: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(pa.table({name: pa.array(values, pa.int64())})))

    inside = counts.join(broadcast(pairs, "_pair"), pair == F.col("_pair")).groupBy(
        "lang", context.alias("context")).agg(F.sum("c").alias("c"))
    first = Window.partitionBy("lang").orderBy(F.desc("c"), "context")
    most = settings.triples * times
    leading = inside.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= most).select("context").distinct()
    langs, keys, c = _arrays(inside.join(leading, "context", "left_semi"), "lang", "context", "c")
    who = np.array([index[x] for x in langs], np.int64)
    triples = _top(keys.astype(np.int64), who, c / total[who], most)
    # Bytes after the same kept context are one row; any of its codes stands for it.
    marked = counts.join(broadcast(pairs, "_pair"), pair == F.col("_pair"), "left").join(
        broadcast(triples, "_triple"), context == F.col("_triple"), "left")
    place = F.when(F.col("_triple").isNotNull(), F.col("code")).when(
        F.col("_pair").isNotNull(), -1 - F.col("code").bitwiseAND(0xFFFFFF)).otherwise(
        -(1 << 32) - F.col("code").bitwiseAND(0xFFFF))
    merged = marked.groupBy("lang", place.alias("place")).agg(F.min("code").alias("code"), F.sum("c").alias("c"))
    langs, codes, c = _arrays(merged, "lang", "code", "c")
    return build_model(list(langs), codes.astype(np.int64), c, settings, (pairs, triples))


#: Bits a byte are counted in steps of one over so many.
_STEPS = 1 << 12


def _medians(rates: DataFrame) -> dict[str, float]:
    """The median of each language from counts of its rates, exact to a step."""
    steps: dict[str, list[tuple[int, int]]] = {}
    counted = rates.groupBy("lang", F.floor(F.col("rate") * _STEPS).alias("step")).count()
    for r in counted.collect():  # at most as many as there are steps
        steps.setdefault(r["lang"], []).append((r["step"], r["count"]))
    out = {}
    for lang, found in steps.items():
        at, n = map(np.array, zip(*sorted(found)))
        ends = n.cumsum()
        out[lang] = float(at[np.searchsorted(ends, [(ends[-1] - 1) // 2, ends[-1] // 2], "right")].mean()) / _STEPS
    return out


def learn_with_bounds(documents: DataFrame, doc: str, text: str, lang: str, which: Column,
                      settings: Settings = Settings()) -> tuple[Model | None, dict[str, float]]:
    """A model of all rows with a text and a language that ``which`` allows, and the most bits a byte that a text of each
    language may cost.

    Each half of the rows is scored under a model of the other half, as a text that was not learnt from. The bound is
    a multiple of the median, so a few bad texts among the labelled ones don't move it. A language with
    texts in one half only has no bound. Rows without an id are halved by their text.
    """
    key = F.xxhash64(F.lit("half"), doc, F.when(F.col(doc).isNull(), F.col(text)))
    labelled = documents.filter(which & F.col(lang).isNotNull() & (F.col(text) != "")).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(key, F.lit(2)).cast("string").alias("half"))
    scratch = Scratch(documents.sparkSession)
    counts = scratch.store("contexts", count_contexts(labelled.select(F.concat("half", "lang").alias("lang"), "text")).select(
        F.substring("lang", 1, 1).alias("half"), F.expr("substring(lang, 2)").alias("lang"), "code", "c"))
    model = _model_of(counts.groupBy("lang", "code").agg(F.sum("c").alias("c")), settings)
    others = [_model_of(counts.filter(F.col("half") == h), settings) for h in ("1", "0")]
    scratch.drop("contexts")
    if model is None:
        return None, {}
    shared = documents.sparkSession.sparkContext.broadcast(others)

    def run(batches):
        for batch in batches:
            names, halves = np.array(batch.column(0).to_pylist(), object), np.array(batch.column(2).to_pylist(), object)
            for lo, hi, data, offsets in textops.blocks(batch.column(1)):
                rates = np.full(hi - lo, np.nan)
                for h, model in enumerate(shared.value):
                    index = {n: i for i, n in enumerate(model.names)} if model else {}
                    mine = [i for i in range(hi - lo) if halves[lo + i] == str(h) and names[lo + i] in index]
                    if not mine:
                        continue
                    ends = np.concatenate([[0], np.cumsum(np.diff(offsets)[mine])])
                    own = np.concatenate([data[offsets[i]:offsets[i + 1]] for i in mine])
                    bits = code_lengths(own, ends, model) / np.diff(ends)[:, None]
                    rates[mine] = bits[np.arange(len(mine)), [index[names[lo + i]] for i in mine]]
                fine = ~np.isnan(rates)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[lo:hi][fine], pa.string()), pa.array(rates[fine])], names=["lang", "rate"])

    medians = _medians(labelled.mapInArrow(run, "lang string, rate double"))
    return model, {name: settings.times_median * m for name, m in medians.items()}


def predict(rows: DataFrame, text: str, model: Model | None) -> DataFrame:
    """``rows`` with lang_pred, score and bits_per_byte; ``rows`` must not have columns of these names."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kinds = [("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())]
    schema = f"{_ddl(rows)}, lang_pred string, score double, bits_per_byte double"
    column = rows.columns.index(text)

    def run(batches):
        for batch in batches:
            names, scores, rates = [], [], []
            for lo, hi, data, offsets in textops.blocks(batch.column(column)):
                found, model = _has_letter(data, offsets), shared.value
                if model is None:
                    names += [UNKNOWN] * (hi - lo)
                    scores.append(np.zeros(hi - lo))
                    rates.append(np.full(hi - lo, 8.0))
                    continue
                bits = code_lengths(data, offsets, model)
                best = bits.argmin(1)
                least = bits[np.arange(hi - lo), best]
                share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(1)
                names += [model.names[k] if f else UNKNOWN for k, f in zip(best, found)]
                scores.append(np.where(found, share, 0.0))
                rates.append(least / np.maximum(np.diff(offsets), 1))
            arrays = [pa.array(names, pa.string())] + [
                pa.array(np.concatenate(x) if x else np.empty(0)) for x in (scores, rates)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *arrays], names=[*batch.schema.names, *[n for n, _ in kinds]])

    return rows.mapInArrow(run, schema)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
