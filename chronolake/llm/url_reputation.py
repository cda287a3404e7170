"""URL filter: explicit rules first, then empirical-Bayes reputation of hosts.

Each page has an outcome of its own, read off its content: junk or not.  Outcomes are counted per host, then shrunk
through beta-binomial priors: a host towards its registered domain, the domain towards its suffix, the suffix towards
the rate of all pages.  The strength of each prior is the method-of-moments estimate over the children at that level.
A page without a rule is blocked when the lower posterior bound of its host's junk rate reaches ``block_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Page text: markup goes, signs written as entities come back as one sign, other entities as a space.
MARKUP = "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>"
SIGN_ENTITIES, ENTITIES = "&(amp|lt|gt);", "&(quot|apos|nbsp|#[0-9]+);"
SIGNS, WORDS = "[#*$%&|<>!]", "[^\\x20\\x09-\\x0D]+"

#: Hosts under a country with one of these labels before it are registered one label further down, as in
#: example.co.uk. A rule, not the public suffix list: suffixes of private registries are not known.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "govt", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
LONG_SUFFIX = "(^|[.])(" + "|".join(SECOND_LEVEL) + ")[.][a-z][a-z]$"

#: Up to this many rules become one expression; more are joined by host.
MOST_RULES = 200
#: A host with more than this share of all pages is joined by broadcast: there are at most 1 / share of them.
HOT_SHARE = 1e-3


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or a URL without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its action, both null if none fits.  ``rules``: (action, host + path)."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):  # the last one set wins
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        name, action = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(verdict)).otherwise(action)
    return name, action


def host_rules(hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """host and ``rules``: those whose host it is or is below, the longest first (rule, action, path)."""
    rows = [(r.partition("/")[0], len(r), r, verdict, "/" + r.partition("/")[2]) for verdict, r in rules]
    table = hosts.sparkSession.createDataFrame(rows, "rule_host string, size int, rule string, action string, path string")
    above = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    tails = hosts.select("host", F.explode(above).alias("rule_host"))
    return tails.join(table, "rule_host").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("size", "rule", "action", "path")), asc=False).alias("rules"))


def host_levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host."""
    labels = F.split(host, r"\.")
    n = F.when(host.rlike(LONG_SUFFIX), 2).otherwise(1)
    tail = lambda k: F.concat_ws(".", F.slice(labels, -F.least(k, F.size(labels)), F.least(k, F.size(labels))))
    return tail(n + 1), tail(n)


def content_outcome(html: Column) -> Column:
    """1 for a page with more than a sign for every five words of its text, else 0; null without words."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, MARKUP, " "), SIGN_ENTITIES, "&"), ENTITIES, " ")
    words, signs = F.regexp_count(text, F.lit(WORDS)), F.regexp_count(text, F.lit(SIGNS))
    return F.when(words > 0, F.when(signs * 5 > words, 1.0).otherwise(0.0))


def _strength(children: DataFrame, mean: str) -> float:
    """Method-of-moments prior strength: how closely children (n, bad) follow their parent's mean."""
    m = F.least(F.greatest(F.col(mean), F.lit(1e-6)), F.lit(1 - 1e-6))
    row = children.agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - m, 2)).alias("between"),
        F.sum(m * (1 - m)).alias("noise"),
        F.sum(F.col("n") * m * (1 - m)).alias("spread"),
        F.count(F.lit(1)).alias("k"),
    ).first()
    if not row["k"] or row["spread"] <= row["noise"]:
        return 2.0
    share = max(0.0, row["between"] - row["noise"]) / (row["spread"] - row["noise"])
    return min(1e4, max(0.5, 1 / share - 1)) if share > 0 else 1e4


def host_reputation(pages: DataFrame, z: float = 1.64) -> DataFrame:
    """Per host: pages, n (labelled), bad, posterior mean and lower bound of the bad rate.

    ``pages`` has ``host`` and ``outcome`` (1 bad, 0 good, null unlabelled).  Three small aggregations follow the
    one over pages; each is over a table with a row per host, domain or suffix.
    """
    domain, suffix = host_levels(F.col("host"))
    hosts = materialise(
        pages.groupBy("host")
        .agg(F.count(F.lit(1)).alias("pages"), F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0.0)).alias("bad"))
        .select("host", domain.alias("domain"), suffix.alias("suffix"), "pages", "n", "bad")
    )
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = ((total["bad"] or 0.0) + 0.5) / ((total["n"] or 0) + 1.0)
    level = hosts.withColumn("prior", F.lit(rate))
    for key, parent in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        own = hosts.groupBy(*dict.fromkeys([key, parent or key])).agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        if parent is None:
            own = own.withColumn("prior", F.lit(rate))
        else:
            own = own.join(level.select(F.col(parent), F.col("mean").alias("prior")), parent)
        own = materialise(own)
        k = _strength(own.where("n > 0"), "prior")
        level = own.withColumn("mean", (F.col("prior") * k + F.col("bad")) / (F.col("n") + k)).withColumn("weight", F.col("n") + F.lit(k))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return level.select("host", "pages", "n", "bad", "mean", F.greatest(F.lit(0.0), F.col("mean") - z * sd).alias("bad_low"))


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    *,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
    outcome: Column | None = None,
    block_at: float = 0.2,
    z: float = 1.64,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, bad_low.

    ``outcome``: 1 bad, 0 good, null unlabelled; by default ``content_outcome`` of the page, so that pages of one
    host differ.  Null, empty or wordless pages are unlabelled; very long ones are read whole.  A host without
    labelled pages has its domain's rate.  Null URLs have an empty host, which is a host like any other; null ids
    stay; repeated rows each count and each return; of rules of one length the last in the alphabet wins; an empty
    table returns no rows; other columns are not read.
    """
    host, path = url_parts(F.col(url))
    label = content_outcome(F.col(html)) if outcome is None else outcome.cast("double")
    rows = pages.select(F.col(id).alias("page_id"), host.alias("host"), path.alias("path"), label.alias("outcome"))
    known = host_reputation(rows, z)
    if len(rules) > MOST_RULES:
        known = materialise(known)
        known = known.join(host_rules(known.select("host"), rules), "host", "left")
    else:
        known = known.withColumn("rules", F.lit(None).cast("array<struct<size:int,rule:string,action:string,path:string>>"))
    known = materialise(known.select("host", "pages", "bad_low", "rules"))
    total = known.agg(F.sum("pages").alias("n")).first()["n"] or 0
    hot = known.where(F.col("pages") > total * HOT_SHARE)
    rows = rows.select("page_id", "host", "path").join(F.broadcast(hot.select("host", F.struct("bad_low", "rules").alias("hot"))), "host", "left")
    # pages of hot hosts are done: their keys are spread and meet nothing
    key = F.when(F.col("hot").isNull(), F.col("host")).otherwise(F.concat(F.lit("\n"), F.pmod(F.xxhash64("page_id", "path"), F.lit(1000)).cast("string")))
    cold = known.where(F.col("pages") <= total * HOT_SHARE).select(F.col("host").alias("key"), F.struct("bad_low", "rules").alias("cold"))
    rows = rows.withColumn("key", key).join(cold, "key", "left").withColumn("own", F.coalesce("hot", "cold"))
    if len(rules) > MOST_RULES:
        fits = F.filter("own.rules", lambda x: F.col("path").startswith(x["path"]))
        rows = rows.withColumn("fit", F.when(F.size(fits) > 0, fits[0]))
        name, action = F.col("fit.rule"), F.col("fit.action")
    else:
        name, action = rule_column(F.col("host"), F.col("path"), rules)
    return rows.select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(action, F.when(F.col("own.bad_low") >= block_at, "block").otherwise("allow")).alias("verdict"),
        F.col("own.bad_low").alias("bad_low"),
    )
