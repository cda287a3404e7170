"""Joins, filters, shards and the pipeline against plain versions."""

import random
import re
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronolake.llm import compaction, decontaminate, knn_quality, ngram_join, quality_rules, text, url_reputation
from chronolake.llm.queries import URL_RULES, fold
from test_text_ops import ODD, docs, words


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(t) for _, t, _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            both, any_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both and 100 * both >= 80 * any_:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(len(sets[k]), least.get(find(k)) if sets[k] else rows[k][0]) for k in range(len(rows))]


def near_rows(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, n = list(ODD), 100
    shared = [rng.choice(vocabulary) for _ in range(60)]
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 8, 60, 150]))] + (shared if family % 3 == 0 else [])
        for _ in range(rng.choice([1, 2, 8, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((n, " ".join(w), "en"))
            n += 1
    return rows


@pytest.mark.parametrize("turns,least", [(3, 32), (1, 4)])
def test_links_equal_all_pairs(spark, monkeypatch, turns, least):
    monkeypatch.setattr(ngram_join, "TURNS", turns)
    monkeypatch.setattr(ngram_join, "LEAST_PAIRS", least)
    monkeypatch.setattr(ngram_join, "MOST_SPLITS", 12 if turns == 3 else 3)
    monkeypatch.setattr(ngram_join, "CHUNK_WORDS", 1000 if turns == 1 else 1_000_000)
    monkeypatch.setattr(ngram_join, "PIVOTS", (4, 16))
    rows = near_rows(turns)
    got = sorted((r.doc_id is not None, r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs(spark, rows)).collect() if r.doc_id is not None)
    want = sorted((True, i, n, c) for (i, _, _), (n, c) in zip(rows, plain_components(rows), strict=True) if i is not None)
    assert got == want
    assert ngram_join.link_documents(docs(spark, [])).count() == 0


def revision_rows(seed):
    """Families whose links form long chains and trees: sliding windows, and versions made from earlier versions."""
    rng = random.Random(seed)
    vocabulary = [f"r{k}" for k in range(5000)]
    texts = []
    for _ in range(4):
        long = [rng.choice(vocabulary) for _ in range(60 + 4 * 40)]
        texts += [long[4 * k : 4 * k + 60] for k in range(40)]
        versions = [[rng.choice(vocabulary) for _ in range(100)]]
        for _ in range(40):
            w = list(rng.choice(versions[-6:]))
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            versions.append(w)
        texts += versions
    rng.shuffle(texts)
    return [(k, " ".join(w), "en") for k, w in enumerate(texts)]


def test_links_of_chains_and_version_trees(spark):
    rows = revision_rows(11)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs(spark, rows)).collect())
    assert got == sorted((i, n, c) for (i, _, _), (n, c) in zip(rows, plain_components(rows), strict=True))


def paragraph_rows(n, seed=2):
    """Documents of six or seven paragraphs out of twelve: most pairs share several, few link."""
    rng = random.Random(seed)
    paragraphs = [" ".join(rng.choice("abcdefghijkl") + str(rng.randrange(50)) for _ in range(30)) for _ in range(12)]
    return [(k, "\n".join(rng.sample(paragraphs, rng.choice([6, 6, 7]))), "en") for k in range(n)]


def test_links_of_shared_paragraphs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST_PAIRS", 2)
    monkeypatch.setattr(ngram_join, "TURNS", 1)
    rows = paragraph_rows(400)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs(spark, rows)).collect())
    assert got == sorted((i, n, c) for (i, _, _), (n, c) in zip(rows, plain_components(rows), strict=True))


def test_components_of_paths_and_cycles(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 102), (102, 100)] + [(200, k) for k in range(201, 260)]
    out = {r.sig: r.label for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[k] == 1 for k in range(1, 41)) and out[102] == 100 and out[259] == 200


def test_keep_one_of_each_group(spark):
    a, b = " ".join(f"x{k}" for k in range(30)), " ".join(f"y{k}" for k in range(30))
    rows = [(1, a, "en"), (2, a, "en"), (3, a + " z", "en"), (4, b, "en"), (4, b, "en"), (4, a, "en"), (5, "", "en"), (6, None, "en"), (5, "", "en")]
    got = sorted((r.doc_id, r.text or "") for r in ngram_join.keep_one(docs(spark, rows), ("doc_id", "text")).collect())
    assert (1, a) in got and (4, b) in got and got.count((4, b)) == 1 and all(i not in (2, 3) for i, _ in got)
    assert [x for x in got if not x[1]] == [(5, ""), (5, ""), (6, "")]


def test_keep_one_with_clashing_names(spark):
    a = " ".join(f"x{k}" for k in range(30))
    rows = docs(spark, [(1, a, "en"), (2, a, "en"), (2, a, "en"), (3, "b c d e f g", "en"), (3, "b c d e f g", "en")])
    got = ngram_join.keep_one(rows, tuple(rows.columns))
    assert got.columns == rows.columns and sorted((r.doc_id, r.gone, r.gone_mark) for r in got.collect()) == [(1, "clash", "clash"), (3, "clash", "clash")]


def test_quality_counts_and_order(spark):
    line = "same line of words here to repeat"
    rows = [*ODD, (30, "\n".join([line] * 4 + ["other words stand in this one"]), "en"), (31, "# $ % & " * 20, "en"), (32, " ".join(f"plain{k}" for k in range(50)), "en")]
    out = {(r.doc_id, r.n_words): r for r in quality_rules.apply_rules(docs(spark, rows)).collect()}
    for i, t, _ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        seen, covered, lines, twice = {}, set(), set(), 0
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k : k + 5]), []).append(k)
        for at in seen.values():
            if len(at) > 1:
                covered.update(k + j for k in at for j in range(5))
        for x in (t or "").split("\n"):
            if re.search("[^\x20\x09-\x0d]", x):
                twice += x in lines
                lines.add(x)
        r = out[i, len(w)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), twice, len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert out[32, 50].kept and not out[31, 80].kept
    assert quality_rules.apply_rules(docs(spark, [])).count() == 0
    assert quality_rules.apply_rules(docs(spark, rows)).where("kept and n_words > 10").count() >= 1  # filters stay above


def test_neighbours_vote(spark):
    rng = random.Random(1)
    good = [(k, " ".join(rng.choice(["river", "stone", "light", "window", "table"]) for _ in range(30)), "en") for k in range(60)]
    bad = [(k, " ".join(rng.choice(["RIVER!!", "STONE%%", "LIGHT**"]) for _ in range(30)), "en") for k in range(60, 120)]
    df = docs(spark, good + bad + [(200, None, "en"), (None, "river stone", "en")])
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(120)] + [(3, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in knn_quality.score_quality(df, labels.where(fold(5) != 0), carry=("label", "x")).collect()}
    assert all(out[k].predicted == (k < 60) for k in range(120)) and 0 <= out[200].score <= 1 and out[1].label == out[1].x == "clash"
    assert {r.score for r in knn_quality.score_quality(df, labels.limit(0)).collect()} == {0.0}
    data = text.buffers(pa.array([t for _, t, _ in good[:20]]))
    axes = knn_quality.Axes(*knn_quality.terms(*data), 20)
    v = axes.vectors(*data)
    voters = knn_quality.Neighbours(v, np.arange(20) % 2)
    sim = np.round(v @ voters.vectors.astype(np.float64).T, knn_quality.DIGITS)
    for k in range(20):
        near = sorted(range(20), key=lambda j: -sim[k, j])[: knn_quality.NEIGHBOURS]
        if sim[k, near[-1]] > sorted(sim[k])[-len(near) - 1]:  # no tie at the last place
            w = np.maximum(0, sim[k, near]) ** 8
            assert abs(voters.scores(v[k : k + 1])[0] - (w * (np.array(near) % 2)).sum() / w.sum()) < 1e-6


def test_neighbours_that_tie_share_the_last_places():
    e = np.eye(3)
    labels = np.array([1] * 5 + [1, 0] * 20 + [0] * 10)
    voters = knn_quality.Neighbours(np.concatenate([np.repeat(e[:1], 5, 0), np.repeat(knn_quality.unit(e[:1] + e[1:2]), 40, 0), np.repeat(e[2:], 10, 0)]), labels)
    w = 0.5**4  # of a similarity of 45 degrees
    want = (5 + 10 * w / 2) / (5 + 10 * w)
    order = np.random.default_rng(1).permutation(55)
    again = knn_quality.Neighbours(voters.vectors[order], labels[order])
    for some in (voters, again):
        assert np.allclose(some.scores(e[:1]), want, atol=1e-5)
        assert some.scores(np.concatenate([e, e[:1], np.zeros((1, 3))])).tolist() == [some.scores(e[k : k + 1])[0] for k in (0, 1, 2, 0)] + [0.0]


def test_equal_texts_have_equal_scores(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 40))), "en") for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(150)], "doc_id long, quality int")
    once = {r.doc_id: r.score for r in knn_quality.score_quality(docs(spark, rows), labels).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    more = docs(spark, rows + [(1000 + i, t, x) for i, t, x in rows[150:]]).repartition(5)
    for r in knn_quality.score_quality(more, labels).collect():
        assert r.score == once[r.doc_id % 1000]


def test_edit_matches_equal_full_distance(spark):
    def distance(p, t):
        prev = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            now = [i]
            for j, e in enumerate(t, 1):
                now.append(min(prev[j] + 1, now[-1] + 1, prev[j - 1] + (c != e)))
            prev = now
        return min(prev)

    rng = random.Random(3)
    vocabulary = "the of and river stone cloud light window table green".split()
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 20)))) for k in range(8)]
    rows = [*ODD]
    for k in range(60):
        w = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, len(w) // 12)):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        rows.append((100 + k, " ".join(rng.choice(vocabulary) for _ in range(20)) + ",  " + "".join(w).upper(), "en"))
    bench = spark.createDataFrame([*items, (99, None), (98, "..."), (None, "the of")], "item_id long, text string")
    for limit in (1 << 20, 300):
        out = decontaminate.flag_documents(docs(spark, rows), bench, block_chars=limit).collect()
        assert len(out) == len(rows)
        got = {r.doc_id: list(zip(r.items, r.distances, strict=True)) for r in out}
        for i, t, _ in rows:
            if i is not None and i >= 100:
                want = [(k, d) for k, x in items if (d := distance(x, decontaminate.clean(t))) <= len(x) // decontaminate.PER_ERROR]
                assert got[i] == want
        assert not got[2] and not got[3]
    assert decontaminate.flag_documents(docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def test_items_without_an_id_are_searched(spark):
    passage, other = "a stone lies beside the green river", "seven clouds over one small table"
    rows = [(1, f"first {passage} last", "en"), (2, "nothing of it", "en"), (3, f"{passage} and {other}", "en")]
    bench = spark.createDataFrame([(None, passage), (7, other), (None, None), (None, "...")], "item_id long, text string")
    for limit in (1 << 20, 40):
        out = {r.doc_id: (r.contaminated, r.items, r.distances) for r in decontaminate.flag_documents(docs(spark, rows), bench, block_chars=limit).collect()}
        assert out == {1: (True, [], []), 2: (False, [], []), 3: (True, [7], [0])}


def test_short_items_are_whole_words(spark):
    rows = [(1, "the party is over", "en"), (2, "Art, of course", "en"), (3, "modern art", "en"), (4, "art", "en"), (5, "smart art part", "en"), (6, "x " * 300_000 + "art", "en")]
    out = {r.doc_id: (r.contaminated, r.distances) for r in decontaminate.flag_documents(docs(spark, rows), spark.createDataFrame([(7, "art")], "item_id long, text string")).collect()}
    assert out == {1: (False, [])} | {k: (True, [0]) for k in (2, 3, 4, 5, 6)}


def test_compaction_keeps_rows_and_versions(spark, tmp_path):
    df = docs(spark, [*ODD, *((k, f"text {k} " * 50, "en") for k in range(300, 700))]).repartition(6)
    store = compaction.ingest(df, str(tmp_path / "s"), F.pmod(F.col("doc_id"), F.lit(5)), 5, target_bytes=40_000, least_bytes=2_000)
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(store.read()) == key(df)
    tiers = {}
    for s in store.manifest()["shards"]:
        if s["bytes"] < store.target // 2:
            tiers[store.tier(s["bytes"])] = tiers.get(store.tier(s["bytes"]), 0) + 1
    assert all(n < store.fan_in for n in tiers.values())
    last = store.version()
    assert store.read(1).count() < df.count()
    other = compaction.ShardStore(spark, str(tmp_path / "s"))
    taken = {"version": last, "schema": None, "shards": []}
    assert other._publish(taken) is False and other.manifest() == store.manifest()
    with pytest.raises(RuntimeError):
        other.commit([], ["gone"])
    assert store.vacuum() > 0 and key(store.read()) == key(df)
    assert compaction.ingest(df.limit(0), str(tmp_path / "e"), F.lit(0), 1).read().count() == 0


PAGE = "<html><head><title>A &amp; B</title><script>var t = '###';</script><style>p {{ }}</style></head><!-- ## --><body><p>{}</p></body></html>"
GOOD, BAD = PAGE.format("plain words stand in this good page here"), PAGE.format("free ## win &amp;&amp;&lt;&gt; now !! ** $$ $$")


def test_urls_and_reputation(spark):
    urls = ["http://A.Example.org/es/1", "https://x.example.org/en/12?q", "http://example.org/en/2", "http://b.com/fr/", "http://b.com/de/x", "http://b.com/de", "no url", None, "http://org", "http://casino-win.net/a#b", "://h/p", "http://é.COM?x/fr/"]
    pages = spark.createDataFrame([(k, u, GOOD, *["clash"] * 8) for k, u in enumerate(urls * 3)] + [(None, "http://q.net/", None, *["clash"] * 8)], "page_id long, url string, html string, host string, rules string, key string, hot string, cold string, own string, pages string, outcome string")
    for rules in (URL_RULES, URL_RULES + [("block", f"never{k}.net/") for k in range(url_reputation.MOST_RULES)]):
        rows = url_reputation.judge_urls(pages, rules).collect()
        out = {r.page_id: r for r in rows}
        assert len(rows) == 37 and [out[k].rule for k in range(12)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None, None, None]
        assert [out[k].verdict for k in range(12)] == ["block", "block", "allow", "allow", "block"] + ["allow"] * 7
        assert (out[0].host, out[1].path, out[5].path, out[6].host, out[7].path, out[10].host, out[11].host) == ("a.example.org", "/en/12", "/de", "", "", "h", "é.com")
        assert None in out and url_reputation.judge_urls(pages.limit(0), rules).count() == 0


def test_content_outcomes_and_suffixes(spark):
    rows = [(0, GOOD, "a.b.co.uk"), (1, BAD, "b.co.uk"), (2, "", "co.uk"), (3, None, "x.y.com"), (4, "<p>a ! b ! c</p>", "com"), (5, "<script>a</script>", "x.gov.de"), (6, "word " * 200_000, "")]
    out = spark.createDataFrame(rows, "k long, html string, host string").select("k", url_reputation.content_outcome(F.col("html")).alias("o"), *url_reputation.host_levels(F.col("host"))).collect()
    assert [r.o for r in sorted(out)] == [0.0, 1.0, None, None, 1.0, None, 0.0]
    assert [(r[2], r[3]) for r in sorted(out)] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("y.com", "com"), ("com", "com"), ("x.gov.de", "gov.de"), ("", "")]


@pytest.mark.parametrize("hot", [1e-3, 0.3])
def test_the_bound_decides_on_hosts_with_pages_of_both_kinds(spark, monkeypatch, hot):
    monkeypatch.setattr(url_reputation, "HOT_SHARE", hot)
    hosts = [("bad.one.net", 60, 30), ("few.one.net", 2, 1), ("good.two.net", 60, 2), ("fine.three.com", 100, 0), ("mid.three.com", 40, 6)]
    rows = [(i * 1000 + k, f"http://{h}/{k}", BAD if k < bad else GOOD) for i, (h, n, bad) in enumerate(hosts) for k in range(n)] + [(9000, "http://new.two.net/", None)]
    got = {r.page_id: r for r in url_reputation.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), []).collect()}
    # the same by plain arithmetic
    n, b, up = {}, {}, {}
    for h, pages, bad in [*hosts, ("new.two.net", 0, 0)]:
        domain, suffix = h.split(".", 1)[1], h.rsplit(".", 1)[1]
        up[h], up[domain], up[suffix] = domain, suffix, None
        for name in (h, domain, suffix):
            n[name], b[name] = n.get(name, 0) + pages, b.get(name, 0) + bad
    total = (sum(x[2] for x in hosts) + 0.5) / (sum(x[1] for x in hosts) + 1)
    mean, weight = {}, {}
    for names in ([x for x in up if up[x] is None], [x for x in up if x.count(".") == 1], [x for x in up if x.count(".") == 2]):
        prior = {x: mean[up[x]] if up[x] else total for x in names}
        own = [x for x in names if n[x]]
        between, noise, spread = (sum(f(x, prior[x]) for x in own) for f in (lambda x, m: n[x] * (b[x] / n[x] - m) ** 2, lambda x, m: m * (1 - m), lambda x, m: n[x] * m * (1 - m)))
        share = max(0.0, between - noise) / (spread - noise)
        k = min(1e4, max(0.5, 1 / share - 1)) if share > 0 else 1e4
        for x in names:
            mean[x], weight[x] = (prior[x] * k + b[x]) / (n[x] + k), n[x] + k
    for i, (h, _, _) in enumerate([*hosts]):
        low = max(0.0, mean[h] - 1.64 * (mean[h] * (1 - mean[h]) / (weight[h] + 1)) ** 0.5)
        assert abs(got[i * 1000].bad_low - low) < 1e-9 and got[i * 1000].verdict == ("block" if low >= 0.2 else "allow")
    assert got[0].verdict == got[59].verdict == "block" and got[2000].verdict == "allow" and got[4000].verdict == "allow"
    assert got[9000].verdict == "allow" and 0 < got[9000].bad_low < 1


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = [f"word{k}" for k in range(300)]
    clean = [(k, " ".join(rng.choice(vocabulary) for _ in range(80)), "en") for k in range(60)]
    junk = [(100 + k, "%% ** " * 30, "en") for k in range(5)]
    copies = [(200 + k, clean[k][1] + (" more" if k % 2 else ""), "en") for k in range(10)]
    leaked = [(300, clean[20][1][:200] + " " + clean[21][1][:250] + " end of it", "en")]
    sf = str(tmp_path / "sf")
    docs(spark, clean + junk + copies + leaked + ODD).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, clean[21][1][:200]), (2, "nothing of this is there at all in any text")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(100 + k, 0, 0) for k in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "n-gram Jaccard join" and len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.run(spark, sf).collect()
    ids = {r.doc_id for r in out}
    assert ids >= set(range(60)) - {21} and not ids & {100, 101, 200, 201, 300, 21}
    assert all(r.exact and r.n_tokens == len(r.ids) for r in out)


_ = datetime
