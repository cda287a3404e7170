"""Token-id files: Parquet list columns in ascending document order.

One file holds a range of documents.  Token ids are dictionary-encoded (the vocabulary fits a dictionary page, so
an index of a few bits stands for each id), document ids and starts are delta-encoded; row groups and pages are
small enough that a reader of a few documents, or of metadata alone, skips the rest by column and page index.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ragged import Runs, crc32_runs, gather
from .text import buffers, slices, span_hashes
from .workspace import bounded_batches, partitions, shared_dir

FILES = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.column.index.enabled": "true",
}

#: White space of one byte.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Signs that are a token of their own between a letter and a space.
SIGNS = np.zeros(256, bool)
SIGNS[list(b".,;:?!")] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
#: New chunks that are encoded as one text, chunks that the cache holds, and how many of the oldest outlive it.
JOINED, MOST, KEPT = 500, 300_000, 150_000


def chunk_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of chunks, whether each starts its text, and chunks before each text (len+1 values).

    A space between two characters that are no white space always starts a new piece of the pre-tokenizer, so texts
    can be cut there.  A byte that may belong to white space of several bytes counts as such.
    """
    n = len(data)
    at = np.flatnonzero(data == 32)
    pad = np.concatenate([np.full(3, 32, np.uint8), data, np.full(3, 32, np.uint8)])
    b = lambda k: pad[at + 3 + k]
    wide = ((b(-2) == 0xC2) & ((b(-1) == 0x85) | (b(-1) == 0xA0))) | ((b(-3) >= 0xE1) & (b(-3) <= 0xE3) & (b(-2) <= 0x9A) & (b(-2) >= 0x80))
    wide |= ((b(1) == 0xC2) & ((b(2) == 0x85) | (b(2) == 0xA0))) | ((b(1) >= 0xE1) & (b(1) <= 0xE3) & (b(2) <= 0x9A))
    at = at[~(wide | BLANK[b(-1)] | BLANK[b(1)])]
    inner = np.ones(len(at), bool)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inner = ~(edge[at] | edge[at + 1])  # first or last in its text
    at = at[inner]
    some = np.flatnonzero(np.diff(offsets) > 0)
    starts = np.concatenate([offsets[some], at + 1])
    head = np.concatenate([np.ones(len(some), bool), np.zeros(len(at), bool)])
    ends = np.concatenate([offsets[some + 1], at])
    order = np.argsort(starts, kind="stable")
    starts, head, ends = starts[order], head[order], np.sort(ends)
    return starts, ends, head, np.searchsorted(starts, offsets)


def cuttable(file: dict) -> bool:
    """Whether a tokenizer file has the pre-tokenizer that ``chunk_spans`` and ``SIGNS`` are made for."""
    pre, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    return (
        file.get("normalizer") is None and file.get("truncation") is None and file.get("padding") is None
        and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and all(chr(c) in model["vocab"] for c in np.flatnonzero(SIGNS).tolist())
        and all(t["content"] and " " not in t["content"] for t in file.get("added_tokens", []))
    )


class TextEncoder:
    """Token ids of whole texts, as the library gives them; each distinct chunk between safe spaces is encoded once.

    A text that holds the string of an added token is left to the library whole, for it splits such strings off
    before anything else; so is every text if the file has another pre-tokenizer than the one the cuts are for.
    """

    def __init__(self, tokenizer: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only take memory
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer)
        with open(tokenizer, encoding="utf-8") as f:
            file = json.load(f)
        self.cuttable = cuttable(file)
        self.added = [t["content"].encode() for t in file.get("added_tokens", [])]
        vocabulary = self.model.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id: a character stands for one
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.signs = np.zeros(256, np.int32)
        for c in np.flatnonzero(SIGNS).tolist():
            self.signs[c] = vocabulary.get(chr(c), 0)
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by hash
        self.young = (self.hashes, self.numbers)
        self.runs = Runs(np.int32)

    def _find(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), -1, np.int64)
        for hashes, numbers in ((self.hashes, self.numbers), self.young):
            if len(hashes):
                place = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
                out = np.where(hashes[place] == wanted, numbers[place], out)
        return out

    def _remember(self, hashes: np.ndarray, first: int) -> None:
        joined = np.concatenate([self.young[0], hashes]), np.concatenate([self.young[1], first + np.arange(len(hashes))])
        order = np.argsort(joined[0])
        self.young = joined[0][order], joined[1][order]
        if len(order) > 50_000:
            joined = np.concatenate([self.hashes, self.young[0]]), np.concatenate([self.numbers, self.young[1]])
            order = np.argsort(joined[0])
            self.hashes, self.numbers = joined[0][order], joined[1][order]
            self.young = (self.hashes[:0], self.numbers[:0])

    def _shrink(self) -> None:
        """The oldest chunks stay: the common ones turned up first."""
        old = self.numbers < KEPT
        self.hashes, self.numbers = self.hashes[old], self.numbers[old]
        self.young = (self.hashes[:0], self.numbers[:0])
        self.runs.keep(min(KEPT, len(self.runs.lengths)))
        if len(self.runs.flat) > 8 * KEPT:
            self.hashes, self.numbers, self.runs = self.hashes[:0], self.numbers[:0], Runs(np.int32)

    def _encode(self, chunks: list[str], head: np.ndarray) -> None:
        plain = np.fromiter((" " not in c for c in chunks), bool, len(chunks)) & ~head
        alone, joint = np.flatnonzero(~plain).tolist(), np.flatnonzero(plain).tolist()
        n = len(chunks)
        starts, lengths, flats, at = np.zeros(n, np.int64), np.zeros(n, np.int64), [np.zeros(0, np.int64)], 0
        groups = [joint[a : a + JOINED] for a in range(0, len(joint), JOINED)]
        for lo in range(0, len(groups), 8):
            texts = [" " + " ".join([chunks[i] for i in g]) for g in groups[lo : lo + 8]]
            for g, text, x in zip(groups[lo : lo + 8], texts, self.model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(x.ids, np.int64)
                data = np.frombuffer(text.encode(), np.uint8)
                want = np.append(np.flatnonzero(data == 32)[1:], len(data))  # each space starts a chunk
                ends = np.searchsorted(np.cumsum(self.width[ids]), want) + 1
                begins = np.concatenate([[0], ends[:-1]])
                starts[g], lengths[g] = at + begins, ends - begins
                flats.append(ids)
                at += len(ids)
        if alone:
            for i, x in zip(alone, self.model.encode_batch_fast([chunks[i] if head[i] else " " + chunks[i] for i in alone], add_special_tokens=False), strict=True):
                ids = np.array(x.ids, np.int64)
                starts[i], lengths[i] = at, len(ids)
                flats.append(ids)
                at += len(ids)
        self.runs.add(np.concatenate(flats), starts, lengths)

    def _whole(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        """Numbers of the texts that must not be cut."""
        if not self.cuttable:
            return np.arange(len(offsets) - 1)
        found = set()
        for token in self.added:
            at = data.find(token)
            while at >= 0:
                doc = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(token) <= offsets[doc + 1]:
                    found.add(doc)
                    at = data.find(token, int(offsets[doc + 1]))
                else:  # across the border of two texts
                    at = data.find(token, at + 1)
        return np.array(sorted(found), np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of each."""
        raw = data.tobytes()
        whole = self._whole(raw, offsets)
        if not len(whole):
            return self._encode_cut(data, offsets)
        n = len(offsets) - 1
        cut = np.setdiff1d(np.arange(n), whole)
        sizes, flats = np.zeros(n, np.int64), []
        lengths = np.diff(offsets)[cut]
        flat, sizes[cut] = self._encode_cut(gather(data, offsets[:-1][cut], lengths), np.concatenate([[0], np.cumsum(lengths)]))
        flats.append(flat)
        for doc in whole.tolist():  # one at a time: a very long text is encoded alone
            ids = np.array(self.model.encode(raw[offsets[doc] : offsets[doc + 1]].decode(), add_special_tokens=False).ids, np.int64)
            sizes[doc] = len(ids)
            flats.append(ids)
        order = np.concatenate([cut, whole])
        starts = np.zeros(n, np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return gather(np.concatenate(flats), starts, sizes), sizes

    def _encode_cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.runs.lengths) > MOST or len(self.runs.flat) > 8 * MOST:
            self._shrink()
        starts, ends, head, cuts = chunk_spans(data, offsets)
        long = ends - starts > 1
        last, before, third = data[np.maximum(ends - 1, 0)], data[np.maximum(ends - 2, 0)], data[np.maximum(ends - 3, 0)]
        signed = long & SIGNS[last] & (LETTER[before] | ((ends - starts > 2) & (third == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)))
        ends = ends - signed
        hashes = span_hashes(data, starts, ends) ^ np.where(head, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        number = self._find(unique)
        new = np.flatnonzero(number < 0)
        if len(new):
            new = new[np.argsort(first[new])]  # in the order of the texts
            own = first[new]
            whole = data.tobytes()
            have = len(self.runs.lengths)
            self._encode([whole[a:b].decode() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)], head[own])
            number[new] = have + np.arange(len(new))
            self._remember(unique[new], have)
        index = number[back]
        sizes = self.runs.lengths[index]
        flat = self.runs.take(index)
        stops = np.cumsum(sizes)
        flat = np.insert(flat, stops[signed], self.signs[last[signed]])
        total = np.concatenate([[0], np.cumsum(sizes + signed)])
        return flat, total[cuts[1:]] - total[cuts[:-1]]


_encoders: dict[str, TextEncoder] = {}


def encoder(tokenizer: str) -> TextEncoder:
    """One encoder for each worker process and tokenizer file; its cache of common chunks outlives a task."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = TextEncoder(tokenizer)
    return _encoders[tokenizer]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, end_id: int, id: str = "doc_id", text: str = "text", files: int | None = None) -> None:
    """Encodes every document, appends ``end_id``, and writes ``files`` files of consecutive document ids.

    Ids are those of the library's own call on the whole text, strings of added tokens included.  Null and empty
    texts hold the end id alone; null ids come first; rows with the same id stay next to each other, in the order of
    a hash of their texts, and may fill several files; a very long text is one row, encoded chunk by chunk; an empty
    table writes no rows; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", 1 << 20):
            flat, sizes = own.encode(*buffers(batch.column("text")))
            n = len(sizes)
            ends = np.cumsum(sizes)
            flat = np.insert(flat, ends, end_id)
            sizes = sizes + 1
            ends = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, shard, np.int32)), batch.column("doc_id"), pa.array(before + ends[:-1]), pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32())),
                ],
                names=["shard", "doc_id", "local_start", "n_tokens", "ids"],
            )
            before += int(ends[-1])

    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    placed = rows.repartitionByRange(files or partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    out = placed.mapInArrow(encode, "shard int, doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>").write
    for key, value in FILES.items():
        out = out.option(key, value)
    out.parquet(path)


SCHEMA = "shard int, doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>"


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. Reads two metadata columns for the starts."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # a row for each file
    bases, at = [], 0
    for row in totals:
        bases.append((row["shard"], at))
        at += row["n"]
    base = spark.createDataFrame(bases, "shard int, base bigint")
    return rows.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def read_tokens(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Ids of documents ``first`` to ``last``: row groups and pages outside are skipped."""
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("doc_id").between(first, last)).select("doc_id", "ids")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of rows with ids."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, lengths = ids.flatten().to_numpy(zero_copy_only=False), ids.value_lengths().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc32_runs(flat, lengths))],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.mapInArrow(crc, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_digest(docs: DataFrame, tokenizer: str, *, end_id: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes token files to the shared folder, reads them back and returns their digest."""
    at = shared_dir(docs.sparkSession)
    write_token_files(docs, at, tokenizer, end_id=end_id, id=id, text=text)
    return digest(read_token_files(docs.sparkSession, at))
