"""Vector codes: the parts of every vector as entries of small codebooks, found by Orchard's search.

Components become integers, vectors are cut into equal parts, and each part position has a codebook that starts from
the first vectors by id and is moved to the means of its parts for some rounds. All arithmetic is on integers, so any
order of adding gives the same codebooks.

The nearest entry is found by Orchard's search. For each entry the other entries are listed by their distance from it. A
part starts at some entry and walks that entry's list; an entry that is nearer (or as near, with a lower index)
becomes the current one, and the walk goes on in its list. Entries already compared are marked and not compared
again. The walk ends where the list goes beyond twice the distance between the part and its current entry: by the
triangle inequality, no entry from there on can be nearer. Many parts walk at once, each some entries at a time.

A round is one pass over the vectors: each task adds up its parts by entry and gives one row for each entry, so what
is shuffled and collected has the size of the codebooks for every task and for the driver, at any number of vectors.

Defined results: vectors that are null or hold null or non-finite components are dropped, and so are those whose
length is not the most frequent one (of equally frequent lengths, the greatest). A length that parts don't divide is filled
up with zeros. Of fewer vectors than entries, each is an entry; equal ids are ordered by their components, null ids
come last. Large components are worked on as exact Python integers; an error beyond a long is the greatest long. An empty table gives no rows. Other columns, of
whatever name, are ignored.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.heavy import join_totals
from wattloom.llm.storage import Scratch

#: Entries of a list that a walk looks at in one step, and parts that walk at once.
STRIDE, TOGETHER = 16, 1 << 12
#: Bits of the limbs that sums are cut into, so that they may have any size.
LIMB = 40
GREATEST = 2 ** 63 - 1


@dataclass(frozen=True)
class Coding:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


# --- Orchard's search --------------------------------------------------------------------------


class Orchard:
    """Codebook of one part position with the neighbour lists of its entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.between = _distances(entries, entries)
        # By distance, then by index; the entry itself has distance 0 and is skipped where it is marked.
        self.lists = np.argsort(self.between, axis=1, kind="stable")
        self.reach = np.take_along_axis(self.between, self.lists, 1)

    def nearest(self, points: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each point; of equally near ones, the lowest index."""
        found = [self._walk(points[at:at + TOGETHER], None if start is None else start[at:at + TOGETHER])
                 for at in range(0, len(points), TOGETHER)]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def _walk(self, points: np.ndarray, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(points), len(self.entries)
        current = np.zeros(n, np.int64) if start is None else start.copy()
        best = _squares(points - self.entries[current])
        marked = np.zeros((n, size), bool)
        marked[np.arange(n), current] = True
        place = np.zeros(n, np.int64)  # how far each point has come in the list of its entry
        active = np.arange(n)
        while len(active):
            at = np.minimum(place[active, None] + np.arange(STRIDE), size - 1)
            there, reach = self.lists[current[active, None], at], self.reach[current[active, None], at]
            # Distances are squared: twice as far is four times the square.
            within = reach <= 4 * best[active, None]
            row, col = np.nonzero(within & ~marked[active[:, None], there])
            who, entry = active[row], there[row, col]
            marked[who, entry] = True
            distance = np.repeat(best[active, None] + 1, there.shape[1], 1)  # of no use
            distance[row, col] = _squares(points[who] - self.entries[entry])
            jumped = self._improve(active, there, distance, current, best)
            place[active] = np.where(jumped, 0, place[active] + STRIDE)
            # Beyond the reach of this block there is nothing nearer.
            active = active[jumped | within[:, -1] & (place[active] < size)]
        return current, best

    @staticmethod
    def _improve(active, there, distance, current, best) -> np.ndarray:
        """Move points to the nearest entry just looked at, if it beats the current one; which have moved."""
        least = distance.min(1)
        # Of equally near entries, that of the lowest index.
        entry = np.where(distance == least[:, None], there, np.iinfo(np.int64).max).min(1)
        now, own = best[active], current[active]
        better = (least < now) | (least == now) & (entry < own)
        best[active[better]], current[active[better]] = least[better], entry[better]
        return better


def _squares(difference: np.ndarray) -> np.ndarray:
    """Squared lengths of integer rows."""
    if difference.dtype == object:
        return (difference ** 2).sum(1)
    return np.einsum("ij,ij->i", difference, difference)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows; exact, since float products of such integers are."""
    if a.dtype == object:
        return ((a[:, None, :] - b[None, :, :]) ** 2).sum(2)
    x, y = a.astype(np.float64), b.astype(np.float64)
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return squares.astype(np.int64)


# --- vectors -----------------------------------------------------------------------------------


def _is_whole(vector: Column) -> Column:
    def is_number(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    return vector.isNotNull() & F.forall(vector, is_number)


def kept_vectors(vectors: DataFrame, vec: str, embedding: str, label: str) -> DataFrame:
    """vec_id, label and vector (doubles) of the rows that can be coded, all of one length."""
    rows = vectors.select(F.col(vec).alias("vec_id"), F.col(label).alias("label"),
                          F.col(embedding).cast("array<double>").alias("vector")).filter(_is_whole(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("c"))
    usual = lengths.agg(F.max(F.struct("c", "size"))["size"]).first()[0]
    return rows.filter(F.size("vector") == (usual or 0))


def _integers(column: pa.Array, coding: Coding) -> np.ndarray:
    """floor(scale * x) by vector, part and position; of whole numbers that products of floats keep exact, or Python's."""
    n = len(column)
    if not n:
        return np.zeros((0, coding.parts, 0), np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    whole = np.floor(values * float(coding.scale))
    wide = -(-whole.shape[1] // coding.parts) * coding.parts
    whole = np.pad(whole, ((0, 0), (0, wide - whole.shape[1])))
    if wide * np.abs(whole).max(initial=0) ** 2 < 2.0 ** 48:
        return whole.astype(np.int64).reshape(n, coding.parts, -1)
    exact = np.array([[int(x) for x in row] for row in whole], object)
    return exact.reshape(n, coding.parts, -1)


def _batches(batches, column: int, coding: Coding) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            some = batch.slice(at, TOGETHER)
            yield some, _integers(some.column(column), coding)


def first_codebooks(vectors: DataFrame, coding: Coding) -> np.ndarray:
    """Entries by part, entry and position: the parts of the first vectors by id."""
    first = vectors.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(
        coding.entries).select("vector").toArrow()
    return _integers(first["vector"].combine_chunks(), coding).transpose(1, 0, 2)


def _searches(codebooks: np.ndarray, whole: np.ndarray):
    """One search for each part, of the kind of numbers that both sides need."""
    kind = object if whole.dtype == object or codebooks.dtype == object else np.int64
    return whole.astype(kind), [Orchard(book.astype(kind)) for book in codebooks]


def moved_codebooks(vectors: DataFrame, codebooks: np.ndarray, coding: Coding) -> np.ndarray:
    """Each entry at the floored mean of the parts nearest to it; unused entries stay."""
    parts, entries, wide = codebooks.shape

    def run(batches):
        sums, counts = np.zeros((parts, entries, wide), object), np.zeros((parts, entries), np.int64)
        known = {}
        for _, whole in _batches(batches, 0, coding):
            kind = whole.dtype
            if kind not in known:
                known[kind] = _searches(codebooks, whole)[1]
            for p, search in enumerate(known[kind]):
                points = whole[:, p].astype(search.entries.dtype)
                code, _ = search.nearest(points)
                order = np.argsort(code, kind="stable")
                used, start = np.unique(code[order], return_index=True)
                sums[p, used] += np.add.reduceat(points[order], start)
                counts[p] += np.bincount(code, minlength=entries)
        p, e = np.nonzero(counts)
        which = [np.repeat(x, wide).astype(np.int32) for x in (p, e)] + [np.tile(np.arange(wide, dtype=np.int32), len(p))]
        n, left = np.repeat(counts[p, e], wide), sums[p, e].reshape(-1)
        for limb in range(64):
            last = not len(left) or max(map(abs, left)) < 1 << LIMB
            here = left if last else left & (1 << LIMB) - 1
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, which), pa.array(np.full(len(n), limb, np.int32)), pa.array(n),
                 pa.array(here.astype(np.int64))], names=["part", "entry", "i", "limb", "n", "x"])
            if last:
                break
            left = left >> LIMB

    rows = vectors.select("vector").mapInArrow(run, "part int, entry int, i int, limb int, n long, x long")
    added = rows.groupBy("part", "entry", "i", "limb").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()
    moved, total = codebooks.astype(object), np.zeros(codebooks.shape, object)
    count = np.ones(codebooks.shape, object)
    used = np.zeros(codebooks.shape, bool)
    for p, e, i, limb, x, n in zip(*(added[c].to_pylist() for c in ("part", "entry", "i", "limb", "x", "n"))):
        total[p, e, i] += x << LIMB * limb
        if limb == 0:
            count[p, e, i], used[p, e, i] = n, True
    moved[used] = (total // count)[used]
    largest = max((abs(x) for x in moved.flat), default=0)
    return moved.astype(np.int64) if wide * largest ** 2 < 2 ** 48 else moved


def learn_codebooks(vectors: DataFrame, coding: Coding = Coding()) -> np.ndarray:
    """Codebooks after all rounds; ``vectors`` has vec_id and vector and is read once a round."""
    codebooks = first_codebooks(vectors, coding)
    for _ in range(coding.rounds if codebooks.size else 0):
        codebooks = moved_codebooks(vectors, codebooks, coding)
    return codebooks


def encode(vectors: DataFrame, codebooks: np.ndarray, coding: Coding = Coding()) -> DataFrame:
    """vec_id, label, code, error: hex digits of the nearest entries, and the sum of squared distances to them."""
    digits = max(2, len(f"{max(codebooks.shape[1] - 1, 0):x}"))
    # Without components every vector has the same, empty parts.
    empty = codebooks.shape[2] == 0

    def run(batches):
        known = {}
        for batch, whole in _batches(batches, 2, coding):
            n, kind = batch.num_rows, whole.dtype
            if kind not in known:
                known[kind] = _searches(codebooks, whole)[1]
            codes, errors = [], np.zeros(n, object)
            for p, search in enumerate([] if empty else known[kind]):
                code, distance = search.nearest(whole[:, p].astype(search.entries.dtype))
                codes.append([f"{c:0{digits}x}" for c in code])
                errors += distance
            text = ["".join(c) for c in zip(*codes)] if codes else ["0" * digits * coding.parts] * n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()),
                 pa.array([min(int(e), GREATEST) for e in errors], pa.int64())],
                names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    rows = vectors.select("vec_id", "label", "vector")
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in codebooks.flat).encode()).hexdigest()


def vector_codes(vectors: DataFrame, coding: Coding = Coding(), vec: str = "vec_id", embedding: str = "embedding",
                 label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that can be coded."""
    kept = kept_vectors(vectors, vec, embedding, label)
    codebooks = learn_codebooks(kept, coding)
    coded = Scratch(vectors.sparkSession).store("vector-codes", encode(kept, codebooks, coding))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(GREATEST)).cast("long")
    with_totals = join_totals(coded, ["label"], total, "label_error")
    return with_totals.select("vec_id", "code", "error", "label_error",
                              F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
