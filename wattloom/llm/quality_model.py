"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

A text becomes tokens: runs of word characters and runs of punctuation, plus marks for a word that repeats the one
before and for a word all in capitals. Tokens are hashed into a fixed vocabulary. Each has a sparse random index
vector; its context vector is the sum of the index vectors around it in the training texts. A document is
the mean of its tokens' vectors and its logarithmic length. The network is fitted on most of the training
rows, and a temperature, which makes its probabilities honest, on the others.

Training takes at most ``rows`` labelled rows (the smallest by a hash of the id), a bounded sample; every document
is scored in whole.

Defined results: a null text is empty; an empty text gets the score of a document without tokens; labels
that are null or contradict each other are left out; with one class only, its share is every score;
without labels every score is 0.5; repeated rows are scored alike; a long text is scored in whole; ids are sampled by hash,
ties by id; other columns, of whatever name, are ignored; an empty table gives no rows.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm import textops

REPEAT, CAPITALS, RESERVED = 0, 1, 2
_WORD = ~textops.IS_BREAK
_OTHER = textops.IS_SPACE | _WORD
_UPPER = textops.byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = textops.byte_table(b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Settings:
    rows: int = 6000
    vocabulary: int = 1 << 15
    size: int = 32
    nonzero: int = 4
    window: int = 2
    hidden: int = 32
    steps: int = 400
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 7


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    weights: tuple[np.ndarray, ...] | None
    temperature: float
    constant: float = 0.5


def tokens(data: np.ndarray, offsets: np.ndarray, vocabulary: int, in_order: bool = False
           ) -> tuple[np.ndarray, np.ndarray]:
    """(token ids, text of each token); in text order if ``in_order``, marks next to their word."""
    words = textops.find_words(data, offsets, textops.IS_BREAK)
    marks = textops.find_words(data, offsets, _OTHER)
    room = np.uint64(vocabulary - RESERVED)
    h = words.hashes()
    texts = np.arange(len(offsets) - 1)
    owner = np.repeat(texts, words.counts)
    repeat = np.zeros(len(h), bool)
    repeat[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    upper = np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int64)])
    lower = np.concatenate([[0], np.cumsum(_LOWER[data], dtype=np.int64)])
    s, e = words.starts, words.ends
    capital = (upper[e] - upper[s] >= 2) & (lower[e] == lower[s])
    ids = [(h % room).astype(np.int64) + RESERVED, (marks.hashes() % room).astype(np.int64) + RESERVED,
           np.full(int(repeat.sum()), REPEAT), np.full(int(capital.sum()), CAPITALS)]
    text = [owner, np.repeat(texts, marks.counts), owner[repeat], owner[capital]]
    ids, text = np.concatenate(ids), np.concatenate(text)
    if in_order:
        place = np.concatenate([s, marks.starts, s[repeat], s[capital]])
        order = np.argsort(place, kind="stable")
        ids, text = ids[order], text[order]
    return ids, text


def index_vectors(settings: Settings) -> np.ndarray:
    """Sparse ternary vectors, ``nonzero`` entries of +1 or -1 each."""
    rng = np.random.default_rng(settings.seed)
    out = np.zeros((settings.vocabulary, settings.size), np.float32)
    at = rng.random((settings.vocabulary, settings.size)).argsort(1)[:, :settings.nonzero]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), at.shape), 1)
    return out


def word_vectors(ids: np.ndarray, text: np.ndarray, settings: Settings) -> np.ndarray:
    """Unit context vector plus unit index vector of each seen token; zero for the others."""
    index = index_vectors(settings)
    context = np.zeros(index.shape)
    step = 1 << 17
    for lo in range(0, len(ids), step):
        mine = np.arange(lo, min(lo + step, len(ids)))
        around = np.zeros((len(mine), settings.size), np.float32)
        for shift in range(-settings.window, settings.window + 1):
            near = mine + shift
            use = (near >= 0) & (near < len(ids)) & (shift != 0)
            use[use] = text[near[use]] == text[mine[use]]
            around[use] += index[ids[near[use]]]
        for k in range(settings.size):
            context[:, k] += np.bincount(ids[mine], around[:, k], settings.vocabulary)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    seen = np.bincount(ids, minlength=settings.vocabulary) > 0
    unit = np.where(norm > 0, context / np.maximum(norm, 1e-9), 0) + index / np.sqrt(settings.nonzero)
    return (unit * seen[:, None]).astype(np.float32)


def pooled(ids: np.ndarray, text: np.ndarray, texts: int, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of each text's tokens, and ln(1 + tokens)."""
    count = np.bincount(text, minlength=texts)
    order = np.argsort(text, kind="stable")
    ids = ids[order]
    out = np.zeros((texts, vectors.shape[1] + 1))
    filled = np.flatnonzero(count)
    if len(filled):
        begin = (np.cumsum(count) - count)[filled]
        # A text of many tokens goes in parts, so that gathered vectors stay small.
        step = 1 << 17
        if len(ids) <= step:
            out[filled, :-1] = np.add.reduceat(vectors[ids], begin, axis=0, dtype=np.float64)
        else:
            for row, lo in zip(filled, begin):
                for at in range(lo, lo + count[row], step):
                    out[row, :-1] += vectors[ids[at:min(at + step, lo + count[row])]].sum(0, dtype=np.float64)
        out[filled, :-1] /= count[filled, None]
    out[:, -1] = np.log1p(count)
    return out


def _network(x: np.ndarray, weights: tuple[np.ndarray, ...]) -> np.ndarray:
    w1, b1, w2, b2 = weights
    return np.tanh(x @ w1 + b1) @ w2 + b2


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, settings: Settings) -> Model:
    """Network by Adam over all fitting rows, then the temperature with the least loss on the others."""
    mean, spread = x.mean(0), x.std(0) + 1e-6
    if y.min() == y.max():
        return Model(vectors, mean, spread, None, 1.0, float(y[0]))
    rng = np.random.default_rng(settings.seed)
    z = (x - mean) / spread
    aside = rng.random(len(y)) < 0.2
    if len(set(y[~aside])) < 2 or not aside.any():
        aside[:] = False
    xf, yf = z[~aside], y[~aside]
    # Both classes weigh as they occur, so that scores are probabilities.
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], settings.hidden)), np.zeros(settings.hidden),
         rng.normal(0, settings.hidden ** -0.5, settings.hidden), np.zeros(())]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, settings.steps + 1):
        hidden = np.tanh(xf @ w[0] + w[1])
        error = (_sigmoid(hidden @ w[2] + w[3]) - yf) / len(yf)
        back = np.outer(error, w[2]) * (1 - hidden ** 2)
        grads = [xf.T @ back + settings.decay * w[0], back.sum(0),
                 hidden.T @ error + settings.decay * w[2], error.sum()]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - settings.rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    temperature = 1.0
    if aside.any():
        logits = _network(z[aside], tuple(w))
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, logits / t) - y[aside] * logits / t) for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return Model(vectors, mean, spread, tuple(w), temperature)


def scores(x: np.ndarray, model: Model) -> np.ndarray:
    if model.weights is None:
        return np.full(len(x), model.constant)
    return _sigmoid(_network((x - model.mean) / model.spread, model.weights) / model.temperature)


def learn(documents: DataFrame, labels: DataFrame, which: Column, doc: str = "doc_id", text: str = "text",
          label: str = "quality", settings: Settings = Settings()) -> Model | None:
    """The model of a bounded sample of the labelled rows that ``which`` (over doc_id) allows."""
    agreed = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(
        F.col(doc).alias("doc_id")).agg(F.min(label).alias("y"), F.max(label).alias("top")).filter("y = top")
    chosen = agreed.filter(which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.rows).select("doc_id", "y")
    schema = pa.schema([("y", pa.float64()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in textops.blocks(batch.column(1)):
                ids, at = tokens(data, offsets, settings.vocabulary, in_order=True)
                bounds = np.searchsorted(at, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo),
                    pa.array([ids[a:b].astype(np.int32).tobytes() for a, b in zip(bounds, bounds[1:])],
                             pa.binary())], schema=schema)

    # At most settings.rows rows of two numbers.
    texts = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).join(
        F.broadcast(chosen), "doc_id").select(F.col("y").cast("double"), "text")
    rows = texts.mapInArrow(run, "y double, ids binary").toArrow()
    if not rows.num_rows:
        return None
    parts = [np.frombuffer(x.as_buffer(), np.int32) for x in rows.column("ids").combine_chunks()]
    # The rows come in any order; the fit must not depend on it.
    order = sorted(range(len(parts)), key=lambda i: (len(parts[i]), parts[i][:64].tobytes()))
    parts = [parts[i] for i in order]
    y = rows.column("y").to_numpy()[order]
    ids = np.concatenate(parts)
    text_of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    vectors = word_vectors(ids, text_of, settings)
    return fit(pooled(ids, text_of, len(parts), vectors), y, vectors, settings)


def score_documents(rows: DataFrame, model: Model | None, doc: str = "doc_id", text: str = "text",
                    settings: Settings = Settings()) -> DataFrame:
    """(doc_id, score): the probability that a document is good."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = []
            for lo, hi, data, offsets in textops.blocks(batch.column(1)):
                if shared.value is None:
                    found.append(np.full(hi - lo, 0.5))
                    continue
                ids, at = tokens(data, offsets, settings.vocabulary)
                found.append(scores(pooled(ids, at, hi - lo, shared.value.vectors), shared.value))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(found) if found else np.empty(0))],
                names=["doc_id", "score"])

    return rows.select(F.col(doc).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id long, score double")
