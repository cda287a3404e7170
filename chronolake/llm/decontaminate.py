"""Benchmark decontamination by pigeonhole edit matching.

Texts and items become lower-case letters and digits with single spaces.  An item of m characters may be found with
up to ``m // per_error`` edits.  It is split into one piece more than that, so that any passage within the budget
holds a piece unchanged: an automaton over all pieces finds exact hits in one pass over a text, and the stretch around
each hit is verified with Myers' bit-parallel distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices
from .workspace import bounded_batches

#: An edit is allowed for every so many characters of an item.
PER_ERROR = 14
#: Characters of benchmark text that one pass over the documents looks for: the bound of what is broadcast.
BLOCK_CHARS = 4 << 20

_OTHER = re.compile(r"[\W_]+")


def clean(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of a pattern of ``m`` characters to any part of ``text``, and where that part ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(xh | plus) & full)
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        plus = ((down << 1) | ~(xv | up)) & full
        minus = up & xv
        if score < best:
            best, end = score, i
    return best, end


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], per_error: int) -> None:
        import ahocorasick

        self.items, pieces = [], {}
        for item, text in items:
            m = len(text)
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            budget = m // per_error
            for j in range(budget + 1):
                a, b = j * m // (budget + 1), (j + 1) * m // (budget + 1)
                pieces.setdefault(text[a:b], []).append((len(self.items), a))
            self.items.append((item, m, budget, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item, distance) of every item within its budget somewhere in the text."""
        text = clean(text)
        if self.empty or not text:
            return []
        spans: dict[int, list[tuple[int, int]]] = {}
        out, whole = [], set()
        for end, (size, where) in self.automaton.iter(text):
            for i, a in where:
                _, m, budget, _ = self.items[i]
                if not budget:  # an item too short for an edit: the piece is the item, and must be whole words
                    if i not in whole and (end + 1 == size or text[end - size] == " ") and (end + 1 == len(text) or text[end + 1] == " "):
                        whole.add(i)
                        out.append((self.items[i][0], 0))
                    continue
                lo = end + 1 - size - a - budget
                have = spans.setdefault(i, [])
                span = (max(0, lo), min(len(text), lo + m + 2 * budget))
                if have and span[0] <= have[-1][1]:
                    have[-1] = (min(have[-1][0], span[0]), max(have[-1][1], span[1]))
                else:
                    have.append(span)
        for i, parts in spans.items():
            item, m, budget, masks = self.items[i]
            best = budget + 1
            for lo, hi in parts:
                if hi - lo >= m - budget:
                    best = min(best, myers(masks, m, text[lo:hi])[0])
                    if not best:
                        break
            if best <= budget:
                out.append((item, best))
        return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def flag_documents(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", carry: tuple[str, ...] = (), per_error: int = PER_ERROR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, contaminated, items, distances and the columns ``carry``, one row per document.

    ``items`` lists the benchmark items found, ascending, with the edit distance of each.  A benchmark larger than
    ``block_chars`` is searched for in blocks, one pass each.  An item of fewer than ``per_error`` characters allows no
    edit and is found only as whole words: "art" is not in "party".  Very long texts are searched whole; equal
    passages count once.  Null and empty texts hold nothing; items whose text
    is null, or empty once cleaned, are found nowhere; items of one id count once, with the least distance; items without
    an id make a document contaminated but are not listed; documents' null ids and repeated rows stay; empty tables give no
    rows or no hits.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    bench = benchmark.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("length(t) > 0")
    chars = bench.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-chars // block_chars))
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.array().cast("array<struct<item:bigint,distance:int>>").alias("found"), *(F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)))
    kept = [f.name for f in rows.schema.fields[3:]]
    for b in range(blocks):
        own = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        items = [(r["i"], clean(r["t"])) for r in own.orderBy("i", "t").collect()]
        matcher = _Shipped([x for x in items if x[1]], per_error)
        rows = rows.mapInArrow(_search(matcher, rows.schema.names), rows.schema)
    # an item may be listed twice if its id stands for two texts
    best = F.map_from_entries(F.array_sort(F.transform(F.array_distinct(F.transform(F.filter("found", lambda x: x["item"].isNotNull()), lambda x: x["item"])), lambda i: F.struct(i.alias("item"), F.array_min(F.transform(F.filter("found", lambda x: x["item"] == i), lambda x: x["distance"])).alias("distance")))))
    out = rows.withColumn("best", best)
    return out.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.map_keys("best").alias("items"), F.map_values("best").alias("distances"), *(F.col(a).alias(c) for a, c in zip(kept, carry, strict=True)))


class _Shipped:
    """Items on their way to the workers; the automaton is built there."""

    def __init__(self, items: list[tuple[int, str]], per_error: int) -> None:
        self.items, self.per_error = items, per_error

    def build(self) -> Matcher:
        return Matcher(self.items, self.per_error)


def _search(shipped: _Shipped, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shipped.build()
        kind = pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int32())]))
        for batch in slices(batches, "text", 4 << 20):
            before = batch.column("found").to_pylist()
            now = [a + [{"item": i, "distance": d} for i, d in matcher.find(t)] if t else a for a, t in zip(before, batch.column("text").to_pylist(), strict=True)]
            cols = [pa.array(now, kind) if n == "found" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run
