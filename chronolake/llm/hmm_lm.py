"""Hidden Markov language model: Baum-Welch over all training documents, exact scoring by the scaled forward recursion.

States emit classes.  Every word with at least one in ``1 / OWN_SHARE`` training tokens is a class of its own; the other
words are tied by ranges of their hashes: P(word | state) = P(class | state) * P(word | class).  P(class | state) is
learned from expected counts, summed over all partitions in every pass; P(word | class) comes from exact counts of every
word (Witten-Bell: the words of a class that training does not hold share types / (tokens + types), so the score is the
probability of the text with its unknown words replaced by one unknown word for each class).  The end of a document is
a class of its own.

Documents are packed into chunks, each with its distinct words once.  Counts are combined within a chunk before they are
sent; the task that owns a range of hashes adds them up and returns one count for each word and chunk.  What is sent
grows with the distinct words of chunks, whatever the number of partitions, and a word in every document is one posting
for each chunk.  The number of ranges follows from the number of postings, so a task holds a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ragged import gather
from .text import buffers, slices, word_hashes
from .workspace import bounded_batches, materialise, partitions

STATES = 8
#: Classes of tied words, a power of two; and the share of training tokens that gives a word a class of its own, so
#: that there are at most 1 / OWN_SHARE such words at any size of the input.
CLASSES, OWN_SHARE = 1 << 12, 2.0**-14
#: Baum-Welch passes over all training documents, at most, and the gain (log10 for each token) below which they end.
PASSES, LEAST_GAIN = 5, 2e-3
#: Words of a chunk of documents, of a batch of sequences that is swept together, and postings of a range of hashes.
CHUNK_WORDS, SWEEP_WORDS, RANGE_POSTINGS = 1_000_000, 250_000, 2_000_000

CHUNK_SCHEMA = "chunk bigint, doc_ids array<bigint>, train array<boolean>, lengths array<int>, words binary, counts binary, codes binary, n_train bigint, n_ends bigint, n_words bigint"
POSTING_SCHEMA = "frag int, chunk bigint, words binary, counts binary"
REPLY_SCHEMA = "frag int, chunk bigint, counts binary, own_words binary, own_counts binary, low bigint, tokens binary, types binary, n_types bigint"


# -- sequences ---------------------------------------------------------------------------------------------------


class Sweep:
    """Sequences of classes laid out by time: at each step, the sequences that still run stand side by side."""

    def __init__(self, classes: np.ndarray, lengths: np.ndarray) -> None:
        order = np.argsort(-lengths, kind="stable")
        self.order, self.lengths = order, lengths[order]
        steps = int(self.lengths[0]) if len(order) else 0
        self.active = len(order) - np.searchsorted(self.lengths[::-1], np.arange(1, steps + 1))  # still running at t
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        doc = np.repeat(np.arange(len(lengths)), lengths)
        t = np.arange(len(classes)) - starts[doc]
        self.classes = np.empty(len(classes), np.int64)
        self.classes[self.at[t] + rank[doc]] = classes
        self.rank = np.concatenate([np.arange(n) for n in self.active]) if steps else np.zeros(0, np.int64)

    def forward(self, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward variables, scales and emissions of all positions."""
        emit = model["emit"][self.classes]
        alpha, scale, moves = np.empty_like(emit), np.empty(len(emit), emit.dtype), model["moves"]
        a = None
        for t, n in enumerate(self.active.tolist()):
            lo = self.at[t]
            a = (a[:n] @ moves if t else model["start"]) * emit[lo : lo + n]
            s = a.sum(1)
            a /= s[:, None]
            alpha[lo : lo + n], scale[lo : lo + n] = a, s
        return alpha, scale, emit

    def likelihood(self, model: dict) -> np.ndarray:
        """log10 likelihood of each sequence, in the order given."""
        _, scale, _ = self.forward(model)
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.rank, np.log10(scale), len(self.order))
        return out

    def expected(self, model: dict, into: dict) -> None:
        """Adds expected starts, moves, emissions and the log10 likelihood to ``into``."""
        alpha, scale, emit = self.forward(model)
        if not len(alpha):
            return
        into["likelihood"] += float(np.log10(scale).sum(dtype=np.float64))
        moves, steps = model["moves"], len(self.active)
        ahead = emit / scale[:, None]  # becomes emission * backward / scale
        beta = np.ones_like(alpha)
        back = moves.T.copy()
        for t in range(steps - 1, 0, -1):
            lo, n = self.at[t], int(self.active[t])
            ahead[lo : lo + n] *= beta[lo : lo + n]
            before = self.at[t - 1]
            beta[before : before + n] = ahead[lo : lo + n] @ back
        first = int(self.active[0])
        came = np.repeat(self.at[: steps - 1], self.active[1:]) + self.rank[first:]
        into["moves"] += moves * (alpha[came].T @ ahead[first:])
        alpha *= beta
        into["start"] += alpha[:first].sum(0)
        for k in range(alpha.shape[1]):
            into["emit"][:, k] += np.bincount(self.classes, alpha[:, k], len(into["emit"]))


def sweeps(classes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, Sweep]]:
    """Batches of sequences of like length, with their numbers; every sequence in one of them."""
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    at = 0
    total = np.concatenate([[0], np.cumsum(lengths[order])])
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(total, total[at] + SWEEP_WORDS, "right")) - 1)
        own = order[at:end]
        yield own, Sweep(gather(classes, starts[own], lengths[own]), lengths[own])
        at = end


def no_counts(states: int, classes: int) -> dict:
    """Expected counts of ``classes`` classes and, last, the end."""
    return {"start": np.zeros(states), "moves": np.zeros((states, states)), "emit": np.zeros((classes + 1, states)), "likelihood": 0.0}


def normalised(counts: dict, pull: float = 20.0) -> dict:
    """The model of expected counts; each state's emissions lean on those of all states with ``pull`` tokens."""
    emit = counts["emit"]
    everywhere = emit.sum(1) + 0.5
    everywhere /= everywhere.sum()
    emit = (emit + pull * everywhere[:, None]) / (emit.sum(0) + pull)
    moves = counts["moves"] + 0.1
    start = counts["start"] + 0.1
    return {"start": start / start.sum(), "moves": moves / moves.sum(1, keepdims=True), "emit": emit}


def starting_model(tokens: np.ndarray, states: int) -> dict:
    """Where the passes start: the tokens of each class, split over sticky states by seeded noise."""
    noise = np.random.default_rng(7).gamma(1.0, 1.0, (len(tokens), states))
    moves = (np.full((states, states), 0.05) + 0.9 * np.eye(states)) * max(1.0, float(tokens.sum()))
    return normalised({"emit": tokens[:, None] * noise, "moves": moves, "start": np.ones(states)})


class Vocabulary:
    """Classes of words and P(word | class), from exact counts."""

    def __init__(self, own: np.ndarray, own_counts: np.ndarray, tokens: np.ndarray, types: np.ndarray, ends: int) -> None:
        order = np.argsort(own)
        self.own, self.tokens, self.types = own[order], tokens, types
        self.shift = np.uint64(64 - len(tokens).bit_length() + 1)
        self.end = len(tokens) + len(own)
        self.class_tokens = np.concatenate([tokens, own_counts[order], [ends]]).astype(float)

    def classes(self, words: np.ndarray) -> np.ndarray:
        out = (words >> self.shift).astype(np.int64)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, words), len(self.own) - 1)
            out = np.where(self.own[at] == words, len(self.tokens) + at, out)
        return out

    def tied(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of words with these classes and training counts."""
        alone = classes >= len(self.tokens)
        at = np.where(alone, 0, classes)
        share = np.where(counts > 0, counts, self.types[at]) / np.maximum(1, self.tokens + self.types)[at]
        return np.log10(np.where(alone | (share <= 0), 1.0, share))  # a class without training tokens is all unseen


# -- partitions --------------------------------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Documents to chunk rows: distinct words with their training counts, and the word of every position."""
    part = TaskContext.get().partitionId()
    for number, (ids, train, words, lengths) in enumerate(_grouped(batches, most)):
        own, codes = np.unique(words, return_inverse=True)
        counts = np.bincount(codes[np.repeat(train, lengths)], minlength=len(own)).astype(np.uint32)
        narrow = np.uint16 if len(own) <= 1 << 16 else np.uint32
        n_train = int(lengths[train].sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([(part << 32) + number]), pa.array([ids], pa.list_(pa.int64())), pa.array([train.tolist()], pa.list_(pa.bool_())), pa.array([(lengths + 1).tolist()], pa.list_(pa.int32())),
                pa.array([own.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array([codes.astype(narrow).tobytes()], pa.binary()),
                pa.array([n_train]), pa.array([int(train.sum())]), pa.array([len(own)]),
            ],
            names=["chunk", "doc_ids", "train", "lengths", "words", "counts", "codes", "n_train", "n_ends", "n_words"],
        )


def _grouped(batches: Iterator[pa.RecordBatch], most: int):
    """ids, training flags, word hashes and lengths of chunks of documents."""
    ids, train, words, lengths, size = [], [], [], [], 0
    for batch in slices(batches, "text", 4 << 20):
        h, cuts = word_hashes(*buffers(batch.column("text")))
        ids += batch.column("doc_id").to_pylist()
        train.append(batch.column("train").to_numpy(zero_copy_only=False).astype(bool))
        words.append(h)
        lengths.append(np.diff(cuts))
        size += len(h)
        if size >= most:
            yield ids, np.concatenate(train), np.concatenate(words), np.concatenate(lengths)
            ids, train, words, lengths, size = [], [], [], [], 0
    if ids:
        yield ids, np.concatenate(train), np.concatenate(words), np.concatenate(lengths)


def _postings(ranges: int):
    """Words and counts of each chunk, cut into the ranges of hashes that they fall into."""
    first = np.array([-(-(f << 64) // ranges) for f in range(1, ranges)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "counts")), strict=True):
                w, c = np.frombuffer(words, np.uint64), np.frombuffer(counts, np.uint32)
                cut = np.concatenate([[0], np.searchsorted(w, first), [len(w)]])
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int32()), pa.array(np.full(len(some), chunk)),
                        pa.array([w[cut[f] : cut[f + 1]].tobytes() for f in some], pa.binary()), pa.array([c[cut[f] : cut[f + 1]].tobytes() for f in some], pa.binary()),
                    ],
                    names=["frag", "chunk", "words", "counts"],
                )

    return run


def _totals(n_classes: int, own_count: float):
    """Of one range of hashes: for each chunk the full counts of its words; then what the range's words add to classes."""
    shift = np.uint64(64 - n_classes.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for frag, chunk, words, counts in zip(*(batch.column(c).to_pylist() for c in ("frag", "chunk", "words", "counts")), strict=True):
                parts.append((frag, chunk, np.frombuffer(words, np.uint64), np.frombuffer(counts, np.uint32)))
        if not parts:
            return
        words, back = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        c = np.bincount(back, np.concatenate([p[3] for p in parts]), len(words)).astype(np.int64)
        at = 0
        for frag, chunk, own, _ in parts:
            yield _reply(frag, chunk, c[back[at : at + len(own)]].tobytes())
            at += len(own)
        alone = c >= own_count
        cls, rest = (words >> shift).astype(np.int64), np.where(alone, 0, c)
        low = int(cls[0])
        yield _reply(parts[0][0], -1, None, words[alone].tobytes(), c[alone].tobytes(), low, np.bincount(cls - low, rest).astype(np.int64).tobytes(), np.bincount(cls - low, rest > 0).astype(np.int64).tobytes(), int((c > 0).sum()))

    return run


def _reply(*values) -> pa.RecordBatch:
    values += (None,) * (9 - len(values))
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["frag", "chunk", "counts", "own_words", "own_counts", "low", "tokens", "types", "n_types"])


def _sequences(vocabulary: Vocabulary, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes and lengths of a chunk's documents with their ends; the classes of its words; its codes; positions of words."""
    lengths = np.array(row["lengths"], np.int64)
    own = vocabulary.classes(np.frombuffer(row["words"], np.uint64))
    codes = np.frombuffer(row["codes"], np.uint16 if len(own) <= 1 << 16 else np.uint32)
    classes = np.full(int(lengths.sum()), vocabulary.end)
    body = np.ones(len(classes), bool)
    body[np.cumsum(lengths) - 1] = False
    classes[body] = own[codes]
    return classes, lengths, own, codes, body


def _expectations(model: dict, vocabulary: Vocabulary):
    """Expected counts of a partition's training documents: a row for each class, start and move, and the likelihood."""
    states = len(model["start"])
    light = {k: v.astype(np.float32) for k, v in model.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = no_counts(states, vocabulary.end)
        for batch in batches:
            for row in batch.to_pylist():
                classes, lengths, *_ = _sequences(vocabulary, row)
                for_train = np.flatnonzero(row["train"])
                starts = np.cumsum(lengths) - lengths
                for _, s in sweeps(gather(classes, starts[for_train], lengths[for_train]), lengths[for_train]):
                    s.expected(light, total)
        rows = np.concatenate([total["emit"], total["moves"], total["start"][None], np.full((1, states), total["likelihood"])])
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(rows[some, k]) for k in range(states))], names=["at", *(f"e{k}" for k in range(states))])

    return run


# -- operator ----------------------------------------------------------------------------------------------------


def train_hmm(chunks: DataFrame, vocabulary: Vocabulary, states: int = STATES, passes: int = PASSES) -> dict:
    """Baum-Welch over all training documents of ``chunks``. The driver holds one matrix of classes by states."""
    model, last = starting_model(vocabulary.class_tokens, states), -np.inf
    classes, tokens = vocabulary.end + 1, max(1.0, vocabulary.class_tokens.sum())
    for _ in range(passes if vocabulary.class_tokens.any() else 0):
        sums = chunks.select("train", "lengths", "words", "codes").mapInArrow(_expectations(model, vocabulary), "at bigint, " + ", ".join(f"e{k} double" for k in range(states)))
        rows = sums.groupBy("at").agg(*(F.sum(f"e{k}").alias(f"e{k}") for k in range(states))).toPandas()
        full = np.zeros((classes + states + 2, states))
        full[rows["at"].to_numpy()] = rows[[f"e{k}" for k in range(states)]].to_numpy()
        model = normalised({"emit": full[:classes], "moves": full[classes : classes + states], "start": full[-2]})
        now = full[-1, 0] / tokens
        if now - last < LEAST_GAIN:
            break
        last = now
    return model


def _scores(model: dict, vocabulary: Vocabulary, floor: float, ends: int, n_train: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                classes, n, own, codes, body = _sequences(vocabulary, row)
                c = np.frombuffer(b"".join(r["counts"] for r in row["replies"] or []), np.int64)
                doc = np.repeat(np.arange(len(n)), n)[body]
                known, base, tied = (np.bincount(doc, v[codes], len(n)) for v in ((c > 0).astype(float), np.log10(c + 1.0), vocabulary.tied(own, c)))
                for part, s in sweeps(classes, n):
                    tied[part] += s.likelihood(model)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array(row["train"]), pa.array(n), pa.array(known.astype(np.int64) + (ends > 0)),
                        pa.array(np.full(len(n), n_train)), pa.array(base + np.log10(ends + 1.0) - n * floor), pa.array(tied),
                    ],
                    names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score_documents(docs: DataFrame, train: Column, *, id: str = "doc_id", text: str = "text", states: int = STATES, n_classes: int = CLASSES, passes: int = PASSES) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score (log10), one row per document.

    Null texts are empty: their one token is the end.  A very long text is one sequence, swept whole.  Null ids stay;
    repeated rows each count and each return, with equal scores; no training documents give a model that only knows
    unseen words; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.coalesce(train, F.lit(True)).alias("train"), F.col(text).alias("text"))
    chunks = materialise(rows.mapInArrow(partial(_chunks, most=CHUNK_WORDS), CHUNK_SCHEMA))
    size = chunks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_train", "n_ends", "n_words"))).first()
    ends, n_train = size["n_ends"], size["n_train"] + size["n_ends"]
    ranges = max(partitions(spark), -(-size["n_words"] // RANGE_POSTINGS))
    postings = chunks.select("chunk", "words", "counts").mapInArrow(_postings(ranges), POSTING_SCHEMA).repartitionById(ranges, "frag")
    replies = materialise(postings.mapInArrow(_totals(n_classes, max(1.0, n_train * OWN_SHARE)), REPLY_SCHEMA))
    vocabulary, types = _vocabulary(replies, n_classes, ends)
    model = train_hmm(chunks, vocabulary, states, passes)
    by_chunk = replies.where("chunk >= 0").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("frag", "counts"))).alias("replies"))
    joined = chunks.select("chunk", "doc_ids", "train", "lengths", "words", "codes").join(by_chunk.hint("merge"), "chunk", "left")
    scored = _scores(model, vocabulary, float(np.log10(n_train + types + 1)), ends, n_train)
    return joined.mapInArrow(scored, "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _vocabulary(replies: DataFrame, n_classes: int, ends: int) -> tuple[Vocabulary, int]:
    """Classes of words from one row for each range, and the number of distinct training tokens.

    The driver gets at most 1 / OWN_SHARE words, and two numbers for each class and range that meet.
    """
    own, own_counts, types = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], int(ends > 0)
    per_class = np.zeros((2, n_classes), np.int64)
    for row in replies.where("chunk = -1").select("own_words", "own_counts", "low", "tokens", "types", "n_types").toLocalIterator():
        own.append(np.frombuffer(row["own_words"], np.uint64))
        own_counts.append(np.frombuffer(row["own_counts"], np.int64))
        for into, name in zip(per_class, ("tokens", "types"), strict=True):
            part = np.frombuffer(row[name], np.int64)
            into[row["low"] : row["low"] + len(part)] += part
        types += row["n_types"]
    return Vocabulary(np.concatenate(own), np.concatenate(own_counts), per_class[0], per_class[1], ends), types
