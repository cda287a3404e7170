"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule's cost and selectivity are estimated on a bounded sample; rules then run in the order of rejections per
cost, each only for rows that the ones before it passed.  The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import materialise

SPACES = r"[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Rule:
    """``rejects``: a boolean SQL expression over text, words, n_words, lines and the base counts."""

    name: str
    rejects: str


#: Production rules. Ratios are written without division, so that empty texts need no case of their own.
RULES = (
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 18 * n_words"),
    Rule("symbols", "n_symbols * 5 > n_words"),
    Rule("bars_and_shouting", "regexp_count(text, '[|!]') * 4 > n_words"),
    Rule("repeated_lines", "n_lines >= 4 and n_dup_lines * 2 > n_lines"),
    Rule("letters", "length(regexp_replace(text, '[^\\\\p{L}]+', '')) * 2 < word_chars"),
    Rule("few_distinct_words", "n_words >= 50 and size(array_distinct(words)) * 10 < n_words"),
)


#: Hashes of all runs of five words; fewer than six words cannot hold two of them.
WINDOWS = """case when size(words) < 6 then cast(array() as array<bigint>) else transform(sequence(0, size(words) - 5),
    i -> xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4])) end"""

#: Words in windows found twice or more: sort windows with their positions, keep those equal to a neighbour, and
#: add up what each covers beyond the one before it. Texts whose windows all differ skip this.
REPEATED = """case when size(array_distinct(windows)) = size(windows) then 0L else aggregate(
    array_sort(transform(array(array_sort(transform(windows, (h, i) -> struct(h, i)))), p -> transform(
        filter(p, (x, k) -> (k > 0 and p[k - 1].h = x.h) or (k < size(p) - 1 and p[k + 1].h = x.h)), x -> x.i))[0]),
    struct(0L as n, -5 as i), (a, i) -> struct(a.n + least(5, i - a.i) as n, i as i), a -> a.n) end"""

BASE_FAILS = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def measures(docs: DataFrame, id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, words, n_lines and the base counts of every document; a null text has no words."""
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(*(F.col(c) for c in carry)).alias("carried") if carry else F.lit(True).alias("carried"))
    rows = rows.select("*", F.expr(f"array_remove(split(text, '{SPACES}', -1), '')").alias("words"), F.expr("filter(split(text, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"))
    rows = rows.select("*", F.expr(WINDOWS).alias("windows"))
    return rows.select(
        "doc_id", "text", "words", "carried",
        F.expr("cast(size(words) as bigint)").alias("n_words"),
        F.expr("cast(length(array_join(words, '')) as bigint)").alias("word_chars"),
        F.expr("cast(regexp_count(text, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr("cast(size(lines) as bigint)").alias("n_lines"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr(REPEATED).alias("n_repeat_words"),
    )


def cascade_order(sample: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """Rules with estimated rejection share and seconds, most rejections per second first.

    ``sample`` is a small written table of ``measures``.  Each rule is timed against a scan of the same columns.
    """
    shares = sample.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.expr(r.rejects)).alias(r.name) for r in rules)).first()

    def seconds(condition: str) -> float:
        began = time.perf_counter()
        sample.agg(F.count_if(F.expr(condition)), F.sum(F.length("text")), F.sum(F.size("words"))).collect()
        return time.perf_counter() - began

    seconds("true")
    scan = seconds("true")
    out = [(r, shares[r.name] / max(1, shares["n"]), max(1e-3, seconds(r.rejects) - scan)) for r in rules]
    return sorted(out, key=lambda x: (-x[1] / x[2], x[0].name))


def verdict(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, in this order; null if all pass. Later rules do not run then."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(F.expr(r.rejects), F.lit(r.name)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, *, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base counts, base_failed and kept, one row per document;
    or, with ``carry``, those columns of the documents that are kept.

    Which rule rejects first depends on the measured order and is not told; whether any does, does not.  Very long
    texts are measured whole.

    Null and empty texts have no words and fail the base check.  Null ids and repeated rows stay, each judged on
    its own; an empty table gives no rows; other columns are not read.  ``sample_rows`` bounds the sample that
    only sets the order of the rules.
    """
    rows = measures(docs, id, text, carry)
    every = max(1, docs.count() // sample_rows)
    picked = docs.where(F.pmod(F.xxhash64(F.col(id).cast("string")), F.lit(every)) == 0)
    ranked = cascade_order(materialise(measures(picked, id, text)), rules)
    first = F.when(F.expr(BASE_FAILS), F.lit("base"))
    failed = first.otherwise(verdict([r for r, _, _ in ranked]))
    # a generator between the measures and what follows: a filter on the result must not be pushed below it, where
    # every use of a measure would become a computation of its own
    if carry:
        return rows.select(F.explode(F.when(failed.isNull(), F.array("carried")).otherwise(F.array())).alias("row")).select("row.*")
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = F.struct(*base, F.expr(BASE_FAILS).alias("base_failed"), failed.isNull().alias("kept"))
    return rows.select(F.explode(F.array(out)).alias("row")).select("row.*")
