"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a chunk once.  At each position its output links name all pieces that end there, longest
first; each relaxes the best score of the position.  A character without a piece of its own may be spelled as byte
pieces, at a score below that of any piece.  A piece never holds a space mark after another character, so chunks
that start with their space marks can be encoded one by one, each distinct one once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import ChunkCache, Runs, crc32_runs
from .text import buffers, slices
from .workspace import bounded_batches

#: The space mark of the model file. Inside, a space stands for it: a literal mark in a text is then a character
#: without a piece, spelled as bytes, and decodes to itself.
MARK = "\u2581"
WORDS = re.compile(" +[^ ]*")


class PieceCodec:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, model: str) -> None:
        import ahocorasick
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=model)
        n = file.get_piece_size()
        self.bytes = {int(file.id_to_piece(i)[1:-1], 16): i for i in range(n) if file.is_byte(i)}
        self.pieces = {file.id_to_piece(i).replace(MARK, " "): (i, file.get_score(i)) for i in range(n) if not (file.is_byte(i) or file.is_control(i) or file.is_unknown(i) or file.is_unused(i))}
        usual = [s for _, s in self.pieces.values() if s > -1e8]
        self.spelled = min(usual, default=0.0) - 10.0
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        texts = [b""] * n
        for piece, (i, _) in self.pieces.items():
            texts[i] = piece.encode()
        for byte, i in self.bytes.items():
            texts[i] = bytes([byte])
        self.texts = Runs(np.uint8)
        self.texts.add_each(texts)
        self.cache = ChunkCache(lambda new, runs: runs.add_each([self.best(" " + c) for c in new]))

    def best(self, chunk: str) -> list[int]:
        """Ids of the segmentation with the highest sum of scores; of equal ones, that with the longest last piece."""
        return self.best_scored(chunk)[0]

    def best_scored(self, chunk: str) -> tuple[list[int], float]:
        n = len(chunk)
        score, came, piece = [0.0] + [-1e300] * n, [0] * (n + 1), [-1] * (n + 1)
        own, done, spelled = -1, 0, self.spelled
        for end, (size, value, i) in self.automaton.iter(chunk):
            while done < end:  # positions without a further match
                if own != done and score[done] + spelled > score[done + 1]:
                    score[done + 1], came[done + 1], piece[done + 1] = score[done] + spelled, done, -1
                done += 1
            if size == 1:
                own = end
            value += score[end + 1 - size]
            if value > score[end + 1]:
                score[end + 1], came[end + 1], piece[end + 1] = value, end + 1 - size, i
        while done < n:
            if own != done and score[done] + spelled > score[done + 1]:
                score[done + 1], came[done + 1], piece[done + 1] = score[done] + spelled, done, -1
            done += 1
        ids, at = [], n
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids.extend(self.bytes[b] for b in reversed(chunk[at - 1 : at].encode("utf-8", "replace")))
            at = came[at]
        return ids[::-1], score[n]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text after a leading space, cut before every run of spaces; the first space of each cut is left out."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in WORDS.findall(" " + text)]
        return text.split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of each. An empty text has none."""
        return self.cache.ids(*self.cache.index([self.chunks(t) for t in texts]))

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the texts and their offsets: the leading space that encoding put there goes."""
        lengths = np.concatenate([[0], np.cumsum(self.texts.lengths[ids])])
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        ends = lengths[cuts]
        flat = self.texts.take(ids)
        some = sizes > 0
        keep = np.ones(len(flat), bool)
        keep[ends[:-1][some]] = False
        return flat[keep], ends - np.concatenate([[0], np.cumsum(some)])


_codecs: dict[str, PieceCodec] = {}


def codec(model: str) -> PieceCodec:
    """One codec for each worker process and model file."""
    if model not in _codecs:
        _codecs[model] = PieceCodec(model)
    return _codecs[model]


def encode_documents(docs: DataFrame, model: str, *, id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids, n_tokens, decoded (the text that the ids decode to) and the columns ``carry``.

    Null and empty texts have no ids and decode to the empty text; null ids and repeated rows stay; an empty table
    gives no rows; other columns are not read.
    """
    return _mapped(docs, model, id, text, False, carry)


def codec_digest(docs: DataFrame, model: str, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and exact (decoding the ids gave the text back); cases as in encode_documents."""
    return _mapped(docs, model, id, text, True)


def _mapped(docs: DataFrame, model: str, id: str, text: str, short: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in slices(batches, "text", 2 << 20):
            ids, sizes = c.encode(batch.column("text").fill_null("").to_pylist())
            data, offsets = c.decode(ids, sizes)
            if short:
                was, at = buffers(batch.column("text"))
                same = np.diff(at) == np.diff(offsets)
                if not (same.all() and np.array_equal(was, data)):
                    same &= np.fromiter((bool(np.array_equal(was[a:b], data[x:y])) for a, b, x, y in zip(at, at[1:], offsets, offsets[1:], strict=False)), bool, len(sizes))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(crc32_runs(ids, sizes)), pa.array(same)], names=["doc_id", "n_tokens", "ids_crc32", "exact"])
            else:
                cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                decoded = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids, pa.int32())), pa.array(sizes), decoded, *(batch.column(c) for c in extra)], names=["doc_id", "ids", "n_tokens", "decoded", *extra])

    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)))
    extra = rows.columns[2:]
    schema = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, exact boolean" if short else "doc_id bigint, ids array<int>, n_tokens bigint, decoded string"
    schema += "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, schema).withColumnsRenamed(dict(zip(extra, carry, strict=True)))
