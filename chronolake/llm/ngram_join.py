"""Exact Jaccard join of word shingles by vertical partitioning.

The global order of n-grams (here: of their hashes) is cut into fragments.  Overlaps are counted inside fragments,
separately, and summed:

1. For every document, the n-grams that another text shares are counted in the fragments of one half of the order.
   A document whose sum is too low to reach the similarity with anything leaves: two linked sets differ in at most
   a fifth of either, so all but ``n - ceil(t n)`` of the half's n-grams must be shared.  Copies and n-grams that
   already meet within a chunk of documents are combined there, so a fragment gets an n-gram at most once a chunk
   beside the sets that are alone with it, and replies name only sets that it counted something for.
2. The documents left, one for each distinct set, become lists of elements: all n-grams that stand in the same sets
   are one element with their number as its weight, ordered by how many sets hold it.  Linked sets share an element
   that begins within the first ``n - ceil(t n)`` n-grams of both.  Each element first proposes pairs with leaders
   only; sets that verified links already join need no further pair.  What is left is paired in full, after groups
   with many pairs have been split by the next element in common, and again (``_rest_pairs``).
3. The overlap of each proposed pair is counted fragment by fragment and summed per pair.

Equal sets form classes, so copies are never paired.  Components come from alternating star contractions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ragged import gather
from .text import buffers, mix, shingle_hashes, slices, word_hashes
from .workspace import bounded_batches, materialise, partitions

WIDTH = 5
#: Similarity in hundredths.
THRESHOLD = 80
#: Words of a chunk of documents that is sorted together.
CHUNK_WORDS = 1_000_000
#: Bytes of the input's files, at most, for each range of the order: the number of ranges follows the data.
RANGE_BYTES = 32 << 20
#: Where the order is cut into fragments for the overlaps of proposed pairs: after n-grams of so many sets.
PIVOTS = (32,)
#: Bits of a hash that step 1 compares; equal bits of different n-grams only keep a document longer.
SHORT_BITS = 44
#: Turns of pairs with leaders before all pairs that are left; sets beside one leader from the second turn on.
TURNS, PARTNERS = 3, 4
#: A group of sets with more pairs than so many a set is split by the next element in common, if a set has no more
#: than so many candidates for that; groups are split so often at most, and are then paired in full.
LEAST_PAIRS, MOST_NEXT, MOST_SPLITS = 32, 8, 12
#: Elements before a shared one that are compared to make a pair once; more only make pairs twice.
MOST_SKIPPED = 32

CHUNK_SCHEMA = "kind int, frag int, chunk bigint, doc_ids array<bigint>, size binary, set binary, mark binary, sig binary, half binary, local binary, data binary"
COUNT_SCHEMA = "chunk bigint, doc_ids array<bigint>, size binary, set binary, mark binary, sig binary, half binary, local binary, count binary"


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes by document in ascending order, their documents, set sizes and set signatures."""
    words, cuts = word_hashes(*buffers(column))
    grams, before = shingle_hashes(words, cuts, WIDTH)
    n = len(cuts) - 1
    doc = np.repeat(np.arange(n), np.diff(before))
    order = np.argsort(grams, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    grams, doc = grams[order], doc[order]
    if len(grams):
        fresh = np.concatenate([[True], (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])])
        grams, doc = grams[fresh], doc[fresh]
    size = np.bincount(doc, minlength=n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
    ends = np.cumsum(size)
    sig = mix((total[ends] - total[ends - size]) ^ (size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return grams, doc, size, sig.view(np.int64)


def _chunks(frags: int, words: int):
    """Documents to chunk rows (kind 1) and n-grams of the half, with the sets that hold them, by fragment (kind 0).

    Copies in a chunk are one set.  An n-gram of several sets of the chunk is counted for them here, and sent once,
    without a set, so that other chunks learn of it.
    """
    drop = np.uint64(64 - SHORT_BITS)
    span = np.uint64(1) << np.uint64(SHORT_BITS - 1)
    borders = np.array([(f << (SHORT_BITS - 1)) // frags for f in range(frags + 1)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", 6 * words):
            grams, doc, size, sig = shingle_sets(batch.column("text"))
            chunk = (part << 32) + number
            number += 1
            sigs, first, place = np.unique(sig, return_index=True, return_inverse=True)
            short = grams >> drop
            own = (short < span) & (first[place[doc]] == doc)
            short, place_of = short[own], place[doc[own]]
            half = np.bincount(place_of, minlength=len(sigs))
            order = np.lexsort((place_of, short))
            short, place_of = short[order], place_of[order]
            head = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(short) else np.zeros(0, np.int64)
            runs = np.diff(np.append(head, len(short)))
            several = np.repeat(place_of[head] != place_of[np.append(head[1:], len(short)) - 1], runs) if len(short) else np.zeros(0, bool)
            local = np.bincount(place_of[several], minlength=len(sigs))
            send = ~several
            send[head] = True
            flag, short, place_of = several[send], short[send], place_of[send]
            rows = [
                (1, -1, chunk, batch.column("doc_id").to_pylist(), size.astype(np.int64).tobytes(), place.astype(np.int32).tobytes(),
                 batch.column("mark").to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), sigs.tobytes(), half.astype(np.int64).tobytes(), local.astype(np.int64).tobytes(), None)
            ]
            cut = np.searchsorted(short, borders)
            for f in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[f], cut[f + 1]
                steps = np.diff(short[a:b])
                wide = bool(len(steps) and int(steps.max()) >= 1 << 32)
                sets, spot = np.unique(place_of[a:b][~flag[a:b]], return_inverse=True)
                where = np.full(b - a, len(sets))  # one beyond the sets: already counted
                where[~flag[a:b]] = spot
                kind = np.uint16 if len(sets) < 65536 else np.uint32
                top = np.array([b - a, int(short[a]), wide, len(sets)], np.int64)
                rows.append((0, f, chunk, *[None] * 7, b"".join((top.tobytes(), sigs[sets].tobytes(), sets.astype(np.uint32).tobytes(), steps.astype(np.uint64 if wide else np.uint32).tobytes(), where.astype(kind).tobytes()))))
            cols = list(zip(*rows, strict=True))
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 7]
            names = ["kind", "frag", "chunk", "doc_ids", "size", "set", "mark", "sig", "half", "local", "data"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one fragment: by chunk, sets with the number of their n-grams that a different set holds too.

    Passes chunk rows through.  Sets without such an n-gram are not named.
    """
    parts = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"]:
                yield _count_batch(row["chunk"], row["doc_ids"], *(row[c] for c in ("size", "set", "mark", "sig", "half", "local")), None)
                continue
            data = row["data"]
            n, start, wide, m = np.frombuffer(data, np.int64, 4).tolist()
            sigs, sets = np.frombuffer(data, np.int64, m, 32), np.frombuffer(data, np.uint32, m, 32 + 8 * m)
            at = 32 + 12 * m
            steps = np.frombuffer(data, np.uint64 if wide else np.uint32, n - 1, at)
            where = np.frombuffer(data, np.uint16 if m < 65536 else np.uint32, n, at + (8 if wide else 4) * (n - 1))
            grams = np.cumsum(np.concatenate([np.array([start], np.uint64), steps.astype(np.uint64)]), dtype=np.uint64)
            parts.append((row["chunk"], grams, where, sigs, sets))
    if not parts:
        return
    grams = np.concatenate([p[1] for p in parts])
    sigs = np.concatenate([np.append(p[3], np.int64(0))[p[2]] for p in parts])
    flag = np.concatenate([p[2] == len(p[3]) for p in parts])
    order = np.argsort(grams, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(grams[order]) != 0]))
    own = sigs[order]
    differ = (np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)) | np.logical_or.reduceat(flag[order], first)
    shared = np.empty(len(grams), bool)
    shared[order] = np.repeat(differ, np.diff(np.append(first, len(grams))))
    at = 0
    for chunk, g, where, sig, sets in parts:
        count = np.bincount(where[shared[at : at + len(g)]], minlength=len(sig) + 1)[: len(sig)]
        at += len(g)
        some = np.flatnonzero(count)
        if len(some):
            yield _count_batch(chunk, *[None] * 7, sets[some].tobytes() + count[some].astype(np.uint32).tobytes())


def _count_batch(chunk, doc_ids, *binaries) -> pa.RecordBatch:
    names = ["chunk", "doc_ids", "size", "set", "mark", "sig", "half", "local", "count"]
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in binaries)], names=names)


def _alive(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Documents of a chunk, with whether the summed counts of their sets leave room for a link."""
    head = rows[rows["doc_ids"].notna()].iloc[0]
    size, mark, sig, half, local = (np.frombuffer(head[c], np.int64) for c in ("size", "mark", "sig", "half", "local"))
    place, count = np.frombuffer(head["set"], np.int32), local.copy()
    for data in rows["count"].dropna():
        sets, n = np.frombuffer(data, np.uint32).reshape(2, -1)
        count[sets] += n
    half, count = half[place], count[place]
    spare = size - -(-THRESHOLD * size // 100)
    return pd.DataFrame({"doc_id": pd.array(head["doc_ids"], "Int64"), "n": size, "sig": sig[place], "mark": mark, "alive": (size > 0) & (count >= half - spare) & ((count > 0) | (half <= spare))})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sig, n and the n-gram hashes of each document."""
    for batch in slices(batches, "text", 4 << 20):
        grams, _, size, sig = shingle_sets(batch.column("text"))
        cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(grams.view(np.int64)))], names=["sig", "n", "grams"])


def _ordered(sets: DataFrame) -> DataFrame:
    """sig, n, spare, central and the set's elements in the global order, rare ones first, ties by hash.

    An element is all n-grams that stand in the same sets: ``phs`` (the hash of these sets), ``dfs`` (their number),
    ``ws`` (n-grams of the element, the same in every set that holds it) and ``before`` (n-grams of the set before it).
    N-grams of one set alone come before all others; only their number matters.  ``spare``: the n-grams that a linked
    set may lack.
    """
    rows = sets.select("sig", "n", F.explode("grams").alias("gram"))
    counted = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.bit_xor(F.xxhash64("sig")).alias("ph")).where("df > 1")
    lists = rows.join(counted, "gram").groupBy("sig", "n").agg(F.array_sort(F.collect_list(F.struct("df", "ph"))).alias("l"), F.avg("df").alias("central"))
    starts = lists.withColumn("s", F.expr("filter(sequence(0, size(l) - 1), i -> i = 0 or l[i].ph <> l[i - 1].ph or l[i].df <> l[i - 1].df)"))
    return starts.select(
        "sig", "n", (F.col("n") - F.ceil(F.lit(THRESHOLD) * F.col("n") / 100)).cast("bigint").alias("spare"), "central",
        F.expr("transform(s, i -> l[i].ph)").alias("phs"), F.expr("transform(s, i -> l[i].df)").alias("dfs"),
        F.expr("transform(s, (i, k) -> if(k < size(s) - 1, s[k + 1], size(l)) - i)").alias("ws"), F.expr("transform(s, i -> n - size(l) + i)").alias("before"),
    )


def _node(at: str, have: str, skipped: str) -> str:
    """What a set has at element ``at`` (SQL), with ``have`` n-grams in common up to it: idx, ph, have, after (n-grams
    behind it), few (whether at most MOST_NEXT elements may be the next in common) and the elements skipped."""
    few = f"coalesce(get(before, {at} + {MOST_NEXT + 1}) > spare + {have}, true)"
    return f"struct({at} as idx, phs[{at}] as ph, {have} as have, n - before[{at}] - ws[{at}] as after, {few} as few, slice({skipped}, 1, {MOST_SKIPPED}) as skipped)"


def _prefixes(ordered: DataFrame) -> DataFrame:
    """gram, sig, n, rank and the node's fields: the elements that a linked set may share first, with how central the
    set is."""
    rows = ordered.withColumn("p", F.expr("size(filter(before, x -> x <= spare))"))
    nodes = F.expr(f"if(p > 0, transform(sequence(0, p - 1), i -> {_node('i', 'ws[i]', f'slice(phs, 1, least(i, {MOST_SKIPPED}))')}), array())")
    return rows.select("sig", "n", F.struct("central", "sig").alias("rank"), F.explode(nodes).alias("x")).select(F.col("x.ph").alias("gram"), "sig", "n", "rank", "x.idx", "x.have", "x.after", "x.few", "x.skipped")


def _may_link(a: str, b: str) -> Column:
    """Set sizes allow the similarity."""
    return (F.col(a) * THRESHOLD <= F.col(b) * 100) & (F.col(b) * THRESHOLD <= F.col(a) * 100)


def _segments(ordered: DataFrame) -> DataFrame:
    """sig, n, and for each fragment k of the order the set's elements in it (p0, p1, ...) and their weights (w0, ...)."""
    cuts = [0, *PIVOTS, (1 << 62)]
    size = lambda hi: f"size(filter(dfs, x -> x <= {hi}))"
    part = lambda c, lo, hi: F.expr(f"slice({c}, {size(lo)} + 1, {size(hi)} - {size(lo)})")
    return ordered.select("sig", "n", *(part(c, lo, hi).alias(f"{x}{k}") for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) for c, x in (("phs", "p"), ("ws", "w"))))


def _verified(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Pairs (a, b) that link."""
    names = [f"{x}{k}" for k in range(len(PIVOTS) + 1) for x in "pw"]
    side = lambda c: segments.select(F.col("sig").alias(c), *(F.col(x).alias(f"{x}{c}") for x in ("n", *names)))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_overlaps(len(PIVOTS) + 1), "a bigint, b bigint")


def _overlaps(fragments: int):
    """Overlaps are counted in each fragment and summed per pair, the rare fragment first; a fragment is not looked
    at once the sum and all that is left cannot reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            total = np.zeros(rows, np.int64)
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            parts = [{x: _lists(batch.column(f"{x[0]}{k}{x[1]}")) for x in ("pa", "wa", "pb", "wb")} for k in range(fragments)]
            weight = [np.minimum(*(np.bincount(np.repeat(np.arange(rows), np.diff(p[x][1])), p[x][0], rows) for x in ("wa", "wb"))).astype(np.int64) for p in parts]
            live = np.arange(rows)
            for k, p in enumerate(parts):
                total[live] += _overlap(live, p["pa"], p["wa"], p["pb"])
                most = total + sum(weight[k + 1 :], np.zeros(rows, np.int64))
                live = live[(100 * most >= THRESHOLD * (n - most))[live]]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(live)), batch.column("b").take(pa.array(live))], names=["a", "b"])

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _overlap(live: np.ndarray, a: tuple, wa: tuple, b: tuple) -> np.ndarray:
    """The weight of elements that both lists of each live pair hold."""
    na, nb = np.diff(a[1])[live], np.diff(b[1])[live]
    if not na.sum() or not nb.sum():
        return np.zeros(len(live), np.int64)
    keys = np.concatenate([gather(a[0], a[1][live], na), gather(b[0], b[1][live], nb)])
    pair = np.concatenate([np.repeat(np.arange(len(live)), na), np.repeat(np.arange(len(live)), nb)])
    weight = np.concatenate([gather(wa[0], wa[1][live], na), np.zeros(int(nb.sum()), wa[0].dtype)])
    order = np.lexsort((keys, pair))
    keys, pair, weight = keys[order], pair[order], weight[order]
    both = (keys[1:] == keys[:-1]) & (pair[1:] == pair[:-1])
    return np.bincount(pair[1:][both], np.maximum(weight[1:], weight[:-1])[both], len(live)).astype(np.int64)


def _proposed(postings: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of a leader and each set of another root beside it.

    First one leader for each element, the most central set; later the sets of an element are dealt to groups of about
    PARTNERS by a hash that differs by element and turn, each with a leader of its own.
    """
    if turn:
        size = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("gram", "k")
        own = postings.join(size, "gram").withColumn("group", F.pmod(F.xxhash64("gram", "sig", F.lit(turn)), F.ceil(F.col("k") / PARTNERS).cast("bigint")))
    else:
        own = postings.withColumn("group", F.lit(0).cast("bigint"))
    keys = ["gram", "group"]
    leaders = own.groupBy(*keys).agg(F.max(F.struct("rank", "n", "root")).alias("top"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    beside = own.join(leaders.select(*keys, "top"), keys).where((F.col("root") != F.col("top.root")) & _may_link("n", "top.n"))
    return beside.select(F.least("sig", F.col("top.rank.sig")).alias("a"), F.greatest("sig", F.col("top.rank.sig")).alias("b")).distinct()


def _children(rows: DataFrame, ordered: DataFrame) -> DataFrame:
    """Sets of split groups (key, sig, root, idx, have, skipped), once for each element that may be the next in common:
    the n-grams passed over are no more than the set can spare."""
    rows = rows.join(ordered.select("sig", "n", "spare", "phs", "ws", "before"), "sig").withColumn("last", F.expr("size(filter(before, x -> x <= spare + have)) - 1"))
    passed = f"concat(skipped, slice(phs, idx + 2, least(j - idx - 1, {MOST_SKIPPED})))"
    following = F.expr(f"if(last > idx, transform(sequence(idx + 1, last), j -> {_node('j', '(have + ws[j])', passed)}), array())")
    return rows.select("key", "sig", "root", "n", F.explode(following).alias("x")).select(F.xxhash64("key", "x.ph").alias("key"), "sig", "root", "n", "x.idx", "x.have", "x.after", "x.few", "x.skipped")


def _rest_pairs(postings: DataFrame, ordered: DataFrame) -> DataFrame:
    """Pairs (a, b) that contain or connect all links between sets of different roots that share a first element.

    A group is the sets that share a list of elements, the pairs in it those that share nothing they passed over.  A
    group of too many pairs is split: each set goes to a group for every element that may be the next in common, so a
    pair that shares more meets again there.  Pairs that share no more than the group's elements link only if the
    group's weight alone suffices for both; then the smallest such set links with both, and pairs with it are enough.
    """
    split = postings.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("gram")
    nodes = materialise(postings.join(split, "gram").select(F.col("gram").alias("key"), "sig", "root", "n", "idx", "have", "after", "few", "skipped"))
    made = []
    for depth in range(MOST_SPLITS + 1):
        roots = nodes.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.count_if("few").alias("e"))
        size = roots.groupBy("key").agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("c")).alias("same"), F.sum("e").alias("e"), F.count(F.lit(1)).alias("r")).where("r > 1")
        many = (F.col("k") * F.col("k") - F.col("same") > 2 * LEAST_PAIRS * F.col("k")) & (4 * F.col("e") >= 3 * F.col("k"))
        sized = materialise(nodes.join(size.select("key", (many if depth < MOST_SPLITS else F.lit(False)).alias("many")), "key"))
        whole = sized.where("not many")
        side = lambda c: whole.select("key", *(F.col(x).alias(f"{x}{c}") for x in ("sig", "n", "root", "after", "skipped")), *([F.col("have")] if c == "a" else []))
        least = F.ceil(F.lit(THRESHOLD) * (F.col("na") + F.col("nb")) / (100 + THRESHOLD))
        pairs = side("a").join(side("b"), "key").where((F.col("siga") < F.col("sigb")) & (F.col("roota") != F.col("rootb")) & _may_link("na", "nb"))
        pairs = pairs.where((F.col("have") + F.least("aftera", "afterb") >= least) & ~F.arrays_overlap("skippeda", "skippedb"))
        made.append(materialise(pairs.select(F.col("siga").alias("a"), F.col("sigb").alias("b")).distinct()))
        large = sized.where("many")
        if large.isEmpty():
            break
        enough = large.where(F.col("have") * 100 >= THRESHOLD * F.col("n"))
        least_set = enough.groupBy("key").agg(F.min(F.struct("n", "sig", "root")).alias("top"))
        star = enough.join(least_set, "key").where("root <> top.root")
        made.append(materialise(star.select(F.least("sig", "top.sig").alias("a"), F.greatest("sig", "top.sig").alias("b")).distinct()))
        nodes = materialise(_children(large.select("key", "sig", "root", "idx", "have", "skipped"), ordered))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def similar_sets(sets: DataFrame) -> DataFrame:
    """sig and label of every set of ``sets`` (sig, n, grams; one row for each set) that is linked with another."""
    ordered = materialise(_ordered(sets))
    segments, prefixes = materialise(_segments(ordered)), materialise(_prefixes(ordered))
    light = prefixes.select("gram", "sig", "n", "rank")
    postings = light.withColumn("root", F.col("sig"))
    edges = tried = None
    for turn in range(TURNS):
        pairs = _proposed(postings, turn)
        pairs = materialise(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = _verified(pairs, segments)
        # two contractions may leave a set with several centres: labels only spare pairs, the edges keep every link
        edges = contracted(found if edges is None else found.unionByName(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))), 2)
        labels = materialise(_labels(edges))
        rooted = lambda rows, labels=labels: rows.join(labels, "sig", "left").withColumn("root", F.coalesce("label", "sig")).drop("label")
        if turn + 1 < TURNS:
            postings = materialise(rooted(light))
    pairs = materialise(_rest_pairs(materialise(rooted(prefixes)), ordered).distinct().join(tried, ["a", "b"], "left_anti"))
    return components(_verified(pairs, segments).unionByName(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))))


def contracted(links: DataFrame, steps: int | None = None) -> DataFrame:
    """Edges (u, v), v < u, that join the same sets as ``links`` do: alternating star contractions.

    ``steps`` contractions, or as many as it takes until each u has one v, the smallest of its component.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    done = 0
    while steps is None or done < steps:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialise(small.select("e.u", "e.v").where("u <> v").distinct())
        done += 1
        if steps is None:
            # a forest of stars: nothing is both a leaf and a centre, and no leaf has two centres
            roles = edges.select(F.explode(F.array(F.struct(F.col("u").alias("sig"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")), F.struct(F.col("v").alias("sig"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))).alias("e"))
            if roles.groupBy("e.sig").agg(F.sum("e.leaf").alias("leaf"), F.sum("e.centre").alias("centre")).where("leaf > 1 or (leaf > 0 and centre > 0)").isEmpty():
                break
    return edges


def _labels(edges: DataFrame) -> DataFrame:
    """sig and label: of a leaf its smallest centre, of a centre that is no leaf itself."""
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("sig"), F.col("v").alias("label")), F.struct(F.col("v").alias("sig"), F.col("v").alias("label")))).alias("e"))
    return both.groupBy("e.sig").agg(F.min("e.label").alias("label"))


def components(links: DataFrame) -> DataFrame:
    """sig and label (the smallest sig of the component) of every set with a link."""
    return _labels(contracted(links))


def link_documents(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, one row per document.

    Documents without words (null and empty texts among them) have empty sets and stay alone, as their own
    component; very long texts are compared whole.  Null ids take part and take the smallest id of their component,
    null if it has none.  Repeated rows are copies; rows that share an id are separate documents; a pair at exactly
    the similarity links.  An empty table gives no rows; other columns are not read.
    """
    return _linked(docs, id, text).select("doc_id", "n_shingles", "component_id")


def _mark(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _ranges(docs: DataFrame) -> int:
    """Ranges of the order: as many as the session has shuffle partitions, or more if the tables read are large."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(docs.sparkSession), -(-size // RANGE_BYTES) if size < 1 << 60 else 1)  # larger: not known


def _linked(docs: DataFrame, id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, component_id, label (of the component) and mark (a hash of the text)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    frags = _ranges(docs)
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), _mark(text).alias("mark"))
    packed = rows.mapInArrow(_chunks(frags, CHUNK_WORDS), CHUNK_SCHEMA)
    placed = packed.repartitionById(frags, F.when(F.col("kind") == 1, F.pmod(F.xxhash64("chunk"), F.lit(frags)).cast("int")).otherwise(F.col("frag")))
    counted = placed.mapInArrow(_shared, COUNT_SCHEMA)
    known = materialise(counted.groupBy("chunk").applyInPandas(_alive, "doc_id bigint, n bigint, sig bigint, mark bigint, alive boolean"))
    classes = materialise(known.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.max("alive").alias("alive")))
    wanted = classes.where("alive").select(F.col("first_id").alias("wanted_id")).distinct()
    # lists of documents grow with the input: they meet the texts by a merge join at every size, never by broadcast
    texts = rows.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    sets = texts.select("text").mapInArrow(_sets, "sig bigint, n bigint, grams array<bigint>")
    sets = sets.join(classes.where("alive").select("sig"), "sig", "left_semi").groupBy("sig").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))
    labels = materialise(similar_sets(materialise(sets)))
    named = materialise(classes.join(labels, "sig", "left").select("sig", "first_id", F.coalesce("label", "sig").alias("label")))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    member = materialise(named.join(least, "label").select("sig", "label", "component_id"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return known.join(member, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "label", "mark")


def keep_one(docs: DataFrame, columns: tuple[str, ...], *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``columns`` of one document for each component: that with the smallest id (null counts as the largest).

    Documents are told apart by id and text, and of rows that repeat both, one is kept.  Documents without words are
    linked with nothing and all stay.  Other columns may have any name.
    """
    linked = materialise(_linked(docs, id, text).where("n_shingles > 0"))
    key = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "mark")
    first = materialise(linked.groupBy("label").agg(F.min(key).alias("first")))
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")))
    gone = materialise(linked.join(first, "label").where(other).select(F.col("doc_id").alias("gone"), F.col("mark").alias("gone_mark")).distinct())
    again = materialise(linked.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc_id").alias("gone"), F.col("mark").alias("gone_mark")))
    # the caller's columns travel in a struct, where no name can clash
    rows = docs.select(F.col(id).cast("bigint").alias("own_id"), _mark(text).alias("own_mark"), F.struct(*(F.col(c) for c in columns)).alias("kept"))
    mine = F.col("own_id").eqNullSafe(F.col("gone")) & (F.col("own_mark") == F.col("gone_mark"))
    rest = rows.join(gone.hint("merge"), mine, "left_anti")
    if again.isEmpty():
        return rest.select("kept.*")
    several = rest.join(again, mine, "left_semi").dropDuplicates(["own_id", "own_mark"])
    return rest.join(again, mine, "left_anti").unionByName(several).select("kept.*")
