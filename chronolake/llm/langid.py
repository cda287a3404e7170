"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts become letters and single spaces.  Four-grams of all training documents are counted per language; lower
orders use continuation counts, which follow from the distinct four-grams, all of which are kept.  Grams of all languages share sorted
arrays of hashes (a radix index over the top bits finds the place), each with a log probability per language.  The
language with the lowest cross-entropy per character wins.  All documents are scored once into a working table of a
few numbers a document; the sharpness of the scores and the rejection thresholds come from all training documents in
it.  A bounded sample only tells where to look for the thresholds and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quality import cumulative
from .text import mix, slices
from .workspace import bounded_batches, materialise

ORDER = 4
#: Training documents, about, of the sample that tells where to look for thresholds; as many again for rare languages.
CALIBRATION_DOCS = 2000
#: Share of true documents that the rejection threshold may reject.
REJECT_TAIL = 0.001
#: Share of the sample above which the threshold of all documents is looked for first.
SEARCH_TAIL = 0.02
#: Sharpness of the scores: that with the highest likelihood of the training documents' languages is taken.
SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
POSITIONS = 1 << 18


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code of each code point: itself for a letter, one code for letters beyond 16 bits, else the space."""
    out = np.full(0x110000, 32, np.uint16)
    for i in range(0x110000):
        if chr(i).isalpha():
            out[i] = i if i < 0xFFFE else 0xFFFE
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A packed four-gram for every character of the cleaned texts, its document, and letters of each document."""
    joined = "\0".join(texts).lower()
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    codes = _letters()[raw]
    cut = raw == 0
    if int(cut.sum()) != len(texts) - 1:  # texts hold the separator themselves
        return grams([t.replace("\0", " ") for t in texts])
    doc = np.cumsum(cut, dtype=np.int64)
    keep = ~cut
    gap = codes == 32
    keep[1:] &= ~(gap[1:] & gap[:-1])
    codes, doc = codes[keep], doc[keep]
    letters = np.bincount(doc[codes != 32], minlength=len(texts))
    key = codes.astype(np.uint64)
    for j in range(1, ORDER):
        past = np.full(len(codes), 32, np.uint64)
        if len(codes) > j:
            past[j:] = np.where(doc[j:] == doc[:-j], codes[:-j], 32)
        key |= past << np.uint64(16 * j)
    return key, doc, letters


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four-gram counts of a partition by language."""
    kept: dict[str, list] = {}

    def merged(parts: list) -> list:
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        unique, back = np.unique(keys, return_inverse=True)
        return [(unique, np.bincount(back, counts).astype(np.int64))]

    for batch in slices(batches, "text", 4 << 20):
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").to_pylist()
        for lang in set(langs):
            key, _, _ = grams([t for t, own in zip(texts, langs, strict=True) if own == lang])
            parts = kept.setdefault(lang, [])
            key = np.sort(key)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            parts.append((key[first], np.diff(np.concatenate([first, [len(key)]]))))
            if sum(len(k) for k, _ in parts) > 4_000_000:
                kept[lang] = merged(parts)
    for lang, parts in kept.items():
        for keys, counts in merged(parts):
            for at in range(0, len(keys), 200_000):
                k = keys[at : at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.astype(np.int64)), pa.array(counts[at : at + 200_000])], names=["lang", "gram", "n"])


class HashArray:
    """Sorted hashes with a radix index over their top bits; finds the rows of many keys at once."""

    def __init__(self, keys: np.ndarray) -> None:
        h = mix(keys.astype(np.uint64))
        self.order = np.argsort(h, kind="stable")
        self.hashes = np.concatenate([h[self.order], np.zeros(1, np.uint64)])
        self.bits = max(1, int(len(keys) * 2 - 1).bit_length()) if len(keys) else 1
        top = (self.hashes[:-1] >> np.uint64(64 - self.bits)).astype(np.int64)
        self.begin = np.searchsorted(top, np.arange((1 << self.bits) + 1)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in hash order, -1 where it is missing."""
        h = mix(keys)
        bucket = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.begin[bucket], self.begin[bucket + 1]
        out = np.where((self.hashes[at] == h) & (at < end), at, -1)
        left = np.flatnonzero((out < 0) & (at + 1 < end))
        while len(left):
            at[left] += 1
            hit = self.hashes[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            left = left[at[left] + 1 < end[left]]
        return out


class Model:
    """Kneser-Ney models of several languages over shared arrays."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        levels = []  # by order from the top: per language keys and counts
        now = {x: (counts[x][0].astype(np.uint64), counts[x][1].astype(float)) for x in self.langs}
        for order in range(ORDER, 0, -1):
            levels.append(now)
            mask = np.uint64((1 << 16 * (order - 1)) - 1)
            now = {x: tuple(np.unique(k & mask, return_counts=True)) for x, (k, _) in now.items()}
        alphabet = np.unique(np.concatenate([levels[-1][x][0] for x in self.langs])) if self.langs else np.zeros(0, np.uint64)
        self.unseen = float(-np.log10(len(alphabet) + 1))
        self.grams, self.values, self.contexts, self.backs = [], [], [], []
        lower = None
        for order in range(1, ORDER + 1):
            level = levels[ORDER - order]
            union = np.unique(np.concatenate([level[x][0] for x in self.langs])) if self.langs else np.zeros(0, np.uint64)
            heads = np.unique(union >> np.uint64(16))
            below = np.full((len(union), len(self.langs)), 1 / (len(alphabet) + 1)) if lower is None else lower(union & np.uint64((1 << 16 * (order - 1)) - 1))
            value, back = np.empty((len(union), len(self.langs))), np.ones((len(heads), len(self.langs)))
            for j, x in enumerate(self.langs):
                keys, n = level[x][0], level[x][1].astype(float)
                once, twice = (n == 1).sum(), (n == 2).sum()
                d = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
                place = np.searchsorted(heads, keys >> np.uint64(16))
                total = np.bincount(place, n, len(heads))
                some = np.bincount(place, minlength=len(heads))
                back[:, j] = np.where(total > 0, d * some / np.maximum(total, 1), 1.0)
                own = np.zeros(len(union))
                own[np.searchsorted(union, keys)] = (n - d) / total[place]
                value[:, j] = own + back[np.searchsorted(heads, union >> np.uint64(16)), j] * below[:, j]
            where, at = HashArray(union), HashArray(heads)
            self.grams.append(where)
            self.contexts.append(at)
            self.values.append(np.log10(value)[where.order].astype(np.float32))
            self.backs.append(np.log10(back)[at.order].astype(np.float32))
            lower = lambda keys, union=union, value=value: value[np.searchsorted(union, keys)]

    def log_probabilities(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log10 P of the last character after the others, per language."""
        if not order:
            return np.full((len(keys), len(self.langs)), self.unseen, np.float32)
        place = self.grams[order - 1].find(keys)
        out = self.values[order - 1][np.maximum(place, 0)] if len(self.values[order - 1]) else np.zeros((len(keys), len(self.langs)), np.float32)
        miss = np.flatnonzero(place < 0)
        if len(miss):
            at = self.contexts[order - 1].find(keys[miss] >> np.uint64(16))
            back = self.backs[order - 1][np.maximum(at, 0)] if len(self.backs[order - 1]) else np.zeros((len(miss), len(self.langs)), np.float32)
            back = np.where(at[:, None] < 0, np.float32(0), back)
            out[miss] = back + self.log_probabilities(keys[miss] & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text in each language, and its number of letters."""
        keys, doc, letters = grams(texts)
        total = np.zeros((len(texts), len(self.langs)))
        step = max(1, POSITIONS * 4 // max(4, len(self.langs)))
        for at in range(0, len(keys), step):
            own = doc[at : at + step]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            total[own[first]] += np.add.reduceat(self.log_probabilities(keys[at : at + step]), first, axis=0)
        return -total / np.maximum(1, np.bincount(doc, minlength=len(texts)))[:, None], letters


def train_model(docs: DataFrame) -> Model:
    """Counts over all rows of ``docs`` (text, lang); the driver holds every distinct four-gram of each language."""
    counts = docs.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return Model({x: (g["gram"].to_numpy(), g["n"].to_numpy()) for x, g in counts.groupby("lang")})


def _entropy_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            e, _ = model.entropies(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(e.tolist(), pa.list_(pa.float64()))], names=["lang", "e"])

    return run


def calibrate(model: Model, sample: DataFrame) -> np.ndarray:
    """For each language a cross-entropy that about ``SEARCH_TAIL`` of the sample rows (text, lang) exceed."""
    rows = sample.mapInArrow(_entropy_rows(model), "lang string, e array<double>").toPandas()
    least = np.full(len(model.langs), -np.inf)
    for j, x in enumerate(model.langs):
        own = [e[j] for e in rows["e"][rows["lang"] == x]]
        if own:
            least[j] = np.quantile(own, 1 - SEARCH_TAIL)
    return least


SCORED = "doc_id bigint, train boolean, letters boolean, best int, e double, sums array<double>, lang int, own double"


def _scored(model: Model):
    """Per document its best language and cross-entropy there, the sum behind its score at each sharpness, and its own
    language and cross-entropy there if it is a training document."""
    index = {x: j for j, x in enumerate(model.langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            e, letters = model.entropies(batch.column("text").fill_null("").to_pylist())
            rows, best = np.arange(batch.num_rows), e.argmin(1)
            low = e[rows, best]
            sums = np.stack([np.exp(-t * (e - low[:, None])).sum(1) for t in SHARPNESS], 1)
            lang = np.array([index.get(x, -1) for x in batch.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("train"), pa.array(letters > 0), pa.array(best.astype(np.int32)), pa.array(low), pa.array(sums.tolist(), pa.list_(pa.float64())), pa.array(lang.astype(np.int32), mask=lang < 0), pa.array(e[rows, lang], mask=lang < 0)],
                names=["doc_id", "train", "letters", "best", "e", "sums", "lang", "own"],
            )

    return run


def _by(index: str, values) -> Column:
    return F.array(*(F.lit(v) for v in values))[F.col(index)]


def thresholds(scored: DataFrame, least: np.ndarray) -> tuple[int, np.ndarray]:
    """Place of the sharpness, and each language's highest acceptable cross-entropy, from all training documents.

    Quantiles are exact.  Only values from ``least`` on are counted, or all where the quantile lies below it.
    """
    own = scored.where("lang is not null")
    # decimals, so that sums do not hang on the order of rows
    fits = [F.sum((-t * (F.col("own") - F.col("e")) - F.log(F.col("sums")[k])).cast("decimal(28,12)")).alias(f"fit{k}") for k, t in enumerate(SHARPNESS)]
    totals = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("own") < _by("lang", least.tolist())).alias("under"), *fits).collect()
    fit = [sum(r[f"fit{k}"] for r in totals) for k in range(len(SHARPNESS))]
    begin, rank, weight, limit = least.copy(), np.zeros(len(least), int), np.zeros(len(least)), np.full(len(least), np.inf)
    for r in totals:
        at = (r.n - 1) * (1 - REJECT_TAIL)
        rank[r.lang], weight[r.lang] = floor(at), at - floor(at)
        if r.under > rank[r.lang]:
            begin[r.lang] = -np.inf
        else:
            rank[r.lang] -= r.under
    counts = own.where(F.col("own") >= _by("lang", begin.tolist())).groupBy("lang", "own").agg(F.count(F.lit(1)).alias("n"))
    holds = lambda ahead: F.max(F.when((F.col("below") <= F.col("rank") + ahead) & (F.col("rank") + ahead < F.col("below") + F.col("n")), F.col("own")))
    for r in cumulative(counts, "own", "n", "lang").withColumn("rank", _by("lang", rank.tolist())).groupBy("lang").agg(holds(0).alias("a"), holds(1).alias("b")).collect():
        limit[r.lang] = r.a if r.b is None else r.a + (r.b - r.a) * weight[r.lang]
    return fit.index(max(fit)) if totals else 0, limit


def identify(docs: DataFrame, train: Column, *, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, train, lang_pred, score, rejected, one row per document.

    Null texts and texts without a letter are ``und`` with score 0.  Rows of null language train nothing; null ids
    and repeated rows stay; without training rows all are ``und``; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.coalesce(train, F.lit(True)).alias("train"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    learned = rows.where("train and lang is not null and text is not null").select("text", "lang", "doc_id")
    model = train_model(learned.select("text", "lang"))
    if not model.langs:
        return rows.select("doc_id", "train", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    own = F.when(F.col("train") & F.col("text").isNotNull(), F.col("lang"))
    sizes = rows.groupBy(own.alias("lang")).agg(F.count(F.lit(1)).alias("docs")).toPandas()
    every = max(1, int(sizes["docs"].sum()) // CALIBRATION_DOCS)
    # a rare language gives more of its documents, up to an equal share
    share = max(1, CALIBRATION_DOCS // len(model.langs))
    steps = {x: min(every, max(1, int(n) // share)) for x, n in zip(sizes["lang"], sizes["docs"], strict=True) if isinstance(x, str)}
    step = F.coalesce(F.create_map(*(F.lit(v) for pair in steps.items() for v in pair))[F.col("lang")], F.lit(every))
    least = calibrate(model, learned.where(F.pmod(F.xxhash64("doc_id"), step) == 0).select("text", "lang"))

    scored = materialise(rows.select("doc_id", "train", "text", own.alias("lang")).mapInArrow(_scored(model), SCORED))
    place, limit = thresholds(scored, least)
    score = F.when(F.col("letters"), 1 / F.col("sums")[place]).otherwise(0.0)
    rejected = ~F.col("letters") | (F.col("e") > _by("best", limit.tolist())) | (score < 0.5)
    return scored.select("doc_id", "train", F.when(F.col("letters"), _by("best", model.langs)).otherwise("und").alias("lang_pred"), score.alias("score"), rejected.alias("rejected"))
