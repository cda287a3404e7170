"""Quality by nearest neighbours in a latent-semantic space.

A document is a sparse bag of hashed terms: words, shapes of words (runs of lower case, capitals, digits and signs) and
pairs of neighbouring shapes.  Weights of terms and the latent axes, by a randomised singular value decomposition, come
from a bounded sample of labelled documents; the sample's latent vectors are broadcast, and every document meets all of
them in blocked cosine products.  The nearest neighbours' labels count by similarity.

Similarities near the k-th are computed again in a fixed order and rounded to ``DIGITS``, so a document's score does
not depend on the documents beside it; neighbours that tie at the k-th place share the places left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SPACE, buffers, mix, slices, word_hashes
from .workspace import bounded_batches

#: Labelled rows that the space and the neighbours come from, at most, and terms of one of them that the axes are
#: fitted on, at most (its heaviest): the bounds of what the driver collects and broadcasts.
MOST_LABELLED, FIT_TERMS = 4096, 2000
#: Hashed terms, and labelled rows that a term must stand in to have an axis of its own.
TERM_BITS, LEAST_ROWS = 18, 2
LATENT = 48
NEIGHBOURS = 15
DIGITS = 6
BLOCK, PAIRS = 1024, 200_000

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[65:91] = 66
_CLASS[48:58] = 48


def terms(data: np.ndarray, offsets: np.ndarray, shapes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, terms and weights (square roots of shares), by document and term.

    ``shapes``: whether shapes of words and their pairs are terms beside the words.
    """
    words, cuts = word_hashes(data, offsets)
    n, size = len(offsets) - 1, np.diff(cuts)
    doc = np.repeat(np.arange(n), size)
    found, owner = [words], [doc]
    if shapes:
        kinds = _CLASS[data]
        keep = np.ones(len(data), bool)
        keep[1:] = (kinds[1:] != kinds[:-1]) | SPACE[data[1:]]
        keep[offsets[offsets < len(data)]] = True
        own, _ = word_hashes(kinds[keep], np.concatenate([[0], np.cumsum(keep)])[offsets])
        same = doc[1:] == doc[:-1]
        found += [mix(own + np.uint64(1)), mix(own[1:][same] * np.uint64(3) + own[:-1][same])]
        owner += [doc, doc[1:][same]]
    key = np.concatenate(owner) << TERM_BITS
    key |= (np.concatenate(found) >> np.uint64(64 - TERM_BITS)).astype(np.int64)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    owner = key[first] >> TERM_BITS
    return owner, key[first] & ((1 << TERM_BITS) - 1), np.sqrt(count / np.maximum(1, size)[owner]).astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(1e-12, np.sqrt(np.einsum("ij,ij->i", v, v)))[:, None]


class Axes:
    """Latent axes of the terms that enough rows of a sample hold."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int) -> None:
        seen = np.bincount(term, minlength=1 << TERM_BITS)
        self.terms = np.flatnonzero(seen >= min(LEAST_ROWS, max(1, rows))).astype(np.int32)
        self.axes = np.zeros((len(self.terms), min(LATENT, rows)), np.float32)
        self._place()
        if not self.axes.size:
            return
        idf = (np.log((rows + 1) / (seen[self.terms] + 1)) + 1).astype(np.float32)
        at = self.place[term]
        own = at >= 0
        row, at = row[own], at[own]
        value = weight[own] * idf[at]
        by_term = np.argsort(at, kind="stable")
        wide = min(rows, len(self.terms), LATENT + 16)
        y = _product(row, at, value, np.random.default_rng(7).standard_normal((len(self.terms), wide), np.float32), rows)
        z = _product(at[by_term], row[by_term], value[by_term], _orthonormal(y), len(self.terms))
        del y
        y = _product(row, at, value, _orthonormal(z), rows)  # a power iteration sharpens the range
        z = _product(at[by_term], row[by_term], value[by_term], _orthonormal(y), len(self.terms))
        power, turn = np.linalg.eigh((z.T @ z).astype(np.float64))  # left singular vectors by the small side
        best = np.argsort(-power, kind="stable")[: self.axes.shape[1]]
        best = best[power[best] > 1e-9 * max(power.max(), 1e-30)]
        self.axes[:, : len(best)] = (z @ (turn[:, best] / np.sqrt(power[best])).astype(np.float32)) * idf[:, None]

    def _place(self) -> None:
        self.place = np.full(1 << TERM_BITS, -1, np.int32)
        self.place[self.terms] = np.arange(len(self.terms))

    def __getstate__(self) -> tuple:
        return self.terms, self.axes

    def __setstate__(self, state: tuple) -> None:
        self.terms, self.axes = state
        self._place()

    def vectors(self, data: np.ndarray, offsets: np.ndarray, shapes: bool = True) -> np.ndarray:
        """Unit vectors of texts, zero for texts without a known term. Each is summed in the order of its terms."""
        n = len(offsets) - 1
        out = np.zeros((n, self.axes.shape[1]))
        if not self.axes.size:
            return out
        doc, term, weight = terms(data, offsets, shapes)
        at = self.place[term]
        own = at >= 0
        return unit(_product(doc[own], at[own], weight[own], self.axes, n).astype(np.float64))


def _orthonormal(y: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns of a tall matrix, from their small table of products; no second tall copy
    but the result."""
    power, turn = np.linalg.eigh((y.T @ y).astype(np.float64))
    keep = power > 1e-9 * max(power.max(), 1e-30)
    return y @ (turn[:, keep] / np.sqrt(power[keep])).astype(np.float32)


def _product(row: np.ndarray, col: np.ndarray, value: np.ndarray, dense: np.ndarray, rows: int) -> np.ndarray:
    """A sparse matrix, sorted by row, times a dense one, both in single precision."""
    out = np.zeros((rows, dense.shape[1]), np.float32)
    at = 0
    cuts = np.searchsorted(row, np.arange(rows + 1))
    while at < rows:
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + PAIRS, "right")) - 1)
        a, b = cuts[at], cuts[end]
        if a < b:
            some = np.flatnonzero(cuts[at + 1 : end + 1] > cuts[at:end])
            out[at + some] = np.add.reduceat(dense[col[a:b]] * value[a:b, None], cuts[at + some] - a, axis=0)
        at = end
    return out


class Neighbours:
    """Unit vectors with labels that vote."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray) -> None:
        self.vectors, self.labels = vectors.astype(np.float32), labels.astype(np.float64)

    def scores(self, v: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest neighbours of each row of unit vectors."""
        out = np.zeros(len(v))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(v) if k else 0, BLOCK):
            own = v[at : at + BLOCK]
            near = own.astype(np.float32) @ self.vectors.T
            floor = np.partition(near, len(self.labels) - k, axis=1)[:, len(self.labels) - k] - 1e-4
            row, col = np.nonzero(near >= floor[:, None])
            sim = np.empty(len(row))
            for a in range(0, len(row), PAIRS):
                b = a + PAIRS
                sim[a:b] = np.einsum("ij,ij->i", own[row[a:b]], self.vectors[col[a:b]].astype(np.float64))
            sim = np.round(sim, DIGITS)
            order = np.lexsort((col, -sim, row))
            row, col, sim = row[order], col[order], sim[order]
            begin = np.searchsorted(row, np.arange(len(own)))
            last = sim[begin + k - 1][row]  # the k-th similarity
            above, ties = sim > last, sim == last
            places = k - np.bincount(row[above], minlength=len(own))
            share = np.where(ties, (places / np.maximum(1, np.bincount(row[ties], minlength=len(own))))[row], above)
            w = share * np.maximum(sim, 0.0) ** 8
            total = np.bincount(row, w, len(own))
            out[at : at + BLOCK] = np.bincount(row, w * self.labels[col], len(own)) / np.maximum(1e-12, total)
        return np.round(np.clip(out, 0.0, 1.0), 9)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        doc, term, weight = terms(*buffers(batch.column("text")))
        cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        made = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            heavy = np.sort(np.argsort(-weight[a:b], kind="stable")[:FIT_TERMS]) + a
            made.append((term[heavy].astype(np.int32).tobytes(), weight[heavy].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in made], pa.binary()), pa.array([w for _, w in made], pa.binary())], names=["terms", "weights"])


def _vector_rows(axes: Axes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            v = axes.vectors(*buffers(batch.column("text"))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([x.tobytes() for x in v], pa.binary())], names=["label", "v"])

    return run


def fit(docs: DataFrame, labelled: DataFrame, most: int = MOST_LABELLED) -> tuple[Axes, Neighbours]:
    """Axes and neighbours of at most ``most`` labelled rows. ``docs``: doc_id, text; ``labelled``: doc_id, label.

    An id that is labelled twice has its least label; of several documents with one id each is a neighbour, in the
    order of ids and hashes of texts, up to ``most`` in all.
    """
    once = labelled.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    some = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("labelled_id"), "label")
    known = docs.sparkSession.createDataFrame(some.toPandas(), some.schema)  # bounded by ``most``
    rows = docs.join(F.broadcast(known), F.col("doc_id") == F.col("labelled_id")).orderBy("doc_id", F.xxhash64("text")).limit(most).select("text", "label")
    got = rows.select("text").mapInArrow(_term_rows, "terms binary, weights binary").toPandas()
    term, weight = np.frombuffer(b"".join(got["terms"]), np.int32), np.frombuffer(b"".join(got["weights"]), np.float32)
    axes = Axes(np.repeat(np.arange(len(got)), [len(x) // 4 for x in got["terms"]]), term, weight, len(got))
    voters = rows.mapInArrow(_vector_rows(axes), "label int, v binary").orderBy("v", "label").toPandas()
    return axes, Neighbours(np.frombuffer(b"".join(voters["v"]), np.float32).reshape(len(voters), axes.axes.shape[1]), voters["label"].to_numpy(dtype=np.float64))


def score_quality(docs: DataFrame, labelled: DataFrame, *, id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality", threshold: float = 0.3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted and the columns ``carry``, one row per document.

    ``labelled`` is what may be learned from.  A text without a word or without a known term (null and empty ones
    among them) is at similarity 0 to all and scores 0; very long texts count whole; equal texts have equal scores,
    wherever they stand; null ids and repeated rows stay; neighbours that tie at the last place share it; without
    labels all scores are 0; an empty table gives no rows; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    axes, voters = fit(rows, labelled.select(F.col(label_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")))
    kept = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)))
    extra = [f.name for f in kept.schema.fields[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            score = voters.scores(axes.vectors(*buffers(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), *(batch.column(c) for c in extra)],
                names=["doc_id", "score", "predicted", *extra],
            )

    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = "doc_id bigint, score double, predicted int" + "".join(f", {c} {types[c]}" for c in extra)
    return kept.mapInArrow(run, schema).withColumnsRenamed(dict(zip(extra, carry, strict=True)))
