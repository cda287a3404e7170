"""Hashing, language models and codecs against plain versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolake.llm import hmm_lm, langid, piece_codec, text, token_store
from chronolake.llm.queries import fold, tokenizer_file

#: Names that the operators use inside, as further columns of every table of documents.
CLASHING = ("words", "windows", "row", "kept", "train", "mark", "found", "label", "x", "ids", "gone", "gone_mark", "own_id", "own_mark", "carried", "carried_0", "chunk", "sig", "n", "shard", "score", "decoded", "labelled_id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
ODD = [(1, "The cat sat on the Mat.", "en"), (2, None, "en"), (3, "", None), (4, " \t\n ", "de"), (5, "one", "fr"), (6, "a b c d e f a b c d e", "es"), (6, "a b c d e f a b c d e", "es"), (None, "null id text here", "en"), (7, "Éa\x0bthe THE ▁ 日本", "en"), (8, "w%d " * 3000 % tuple(range(3000)), "en"), (9, "....!!! 123", "en")]


def docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, x, "src", len(t or ""), *["clash"] * len(CLASHING)) for i, t, x in rows], SCHEMA)


def words(t):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall("[^\x20\x09-\x0d]+", t or "")]


@pytest.mark.parametrize("block", [16, 1 << 16])
def test_word_and_shingle_hashes(monkeypatch, block):
    monkeypatch.setattr(text, "BLOCK", block)
    text._powers.clear()
    some = [t for _, t, _ in ODD] * 2
    h, cuts = text.word_hashes(*text.buffers(pa.array(some)))
    seen = {}
    for i, t in enumerate(some):
        own = words(t)
        assert cuts[i + 1] - cuts[i] == len(own)
        for j, w in enumerate(own):
            assert seen.setdefault(w, h[cuts[i] + j]) == h[cuts[i] + j]
    assert len(set(seen.values())) == len(seen)
    grams, before = text.shingle_hashes(h, cuts)
    made = {}
    for i, t in enumerate(some):
        own = words(t)
        want = [tuple(own[k : k + 5]) for k in range(len(own) - 4)] if len(own) >= 5 else [tuple(own)] if own else []
        assert before[i + 1] - before[i] == len(want)
        for k, g in enumerate(want):
            assert made.setdefault(g, grams[before[i] + k]) == grams[before[i] + k]
    assert len(set(made.values())) == len(made)


def test_forward_recursion_sums_over_all_paths():
    rng = np.random.default_rng(2)
    k, c = 3, 4
    model = {"start": rng.dirichlet(np.ones(k)), "moves": rng.dirichlet(np.ones(k), k), "emit": rng.dirichlet(np.ones(c + 1), k).T}
    lengths = np.array([1, 4, 2, 5])
    classes = rng.integers(0, c + 1, lengths.sum())
    got = hmm_lm.Sweep(classes, lengths).likelihood(model)
    at = 0
    for i, n in enumerate(lengths):
        seq, total = classes[at : at + n], 0.0
        at += n
        for path in np.ndindex(*[k] * n):
            p = model["start"][path[0]] * model["emit"][seq[0], path[0]]
            for t in range(1, n):
                p *= model["moves"][path[t - 1], path[t]] * model["emit"][seq[t], path[t]]
            total += p
        assert abs(got[i] - math.log10(total)) < 1e-9


def test_baum_welch_never_lowers_the_likelihood():
    rng = np.random.default_rng(3)
    lengths = np.full(30, 20)
    classes = np.concatenate([rng.integers(0, 4, 20) + 4 * (i % 2) for i in range(30)])
    model = hmm_lm.starting_model(np.bincount(classes, minlength=9).astype(float), 2)
    last = -np.inf
    for _ in range(8):
        s = hmm_lm.Sweep(classes, lengths)
        now = s.likelihood(model).sum()
        assert now > last - 1e-6
        last, counts = now, hmm_lm.no_counts(2, 8)
        s.expected(model, counts)
        assert abs(counts["emit"].sum() - len(classes)) < 1e-6 and abs(counts["likelihood"] - now) < 1e-6
        model = hmm_lm.normalised(counts, pull=0.0)


def plain_scores(rows, held, states, n_classes, own_share, passes):
    """Scores by plain loops: counts in dictionaries, forward and backward without scaling."""
    seqs = [words(t) for _, t, _ in rows]
    train = [k for k, (i, _, _) in enumerate(rows) if not held(i)]
    count = Counter(w for k in train for w in seqs[k])
    ends, n = len(train), sum(count.values()) + len(train)
    hashed = {w: int(text.word_hashes(*text.buffers(pa.array([w])))[0][0]) for own in seqs for w in own}
    alone = sorted((w for w in count if count[w] >= max(1.0, n * own_share)), key=hashed.get)
    class_of = {w: (n_classes + alone.index(w) if w in alone else hashed[w] >> (64 - n_classes.bit_length() + 1)) for w in hashed}
    end = n_classes + len(alone)
    tokens = np.zeros(end + 1)
    types = Counter()
    for w, c in count.items():
        tokens[class_of[w]] += c
        types[class_of[w]] += 1
    tokens[end] = ends
    seq = [[*(class_of[w] for w in own), end] for own in seqs]
    model = hmm_lm.starting_model(tokens, states)

    def forward(s):
        a = [model["start"] * model["emit"][s[0]]]
        for c in s[1:]:
            a.append((a[-1] @ model["moves"]) * model["emit"][c])
        return a

    for _ in range(passes):
        counts = hmm_lm.no_counts(states, end)
        for k in train:
            s, a = seq[k], forward(seq[k])
            b = [np.ones(states)]
            for c in reversed(s[1:]):
                b.insert(0, model["moves"] @ (model["emit"][c] * b[0]))
            total = a[-1].sum()
            counts["start"] += a[0] * b[0] / total
            for t, c in enumerate(s):
                counts["emit"][c] += a[t] * b[t] / total
                if t:
                    counts["moves"] += np.outer(a[t - 1], model["emit"][c] * b[t]) * model["moves"] / total
        model = hmm_lm.normalised(counts)
    out = []
    for own, s in zip(seqs, seq, strict=True):
        total = math.log10(forward(s)[-1].sum())
        for w in own:
            c = class_of[w]
            if c < n_classes and tokens[c]:
                total += math.log10((count[w] or types[c]) / (tokens[c] + types[c]))
        out.append(total)
    return out


def test_scores_and_base_columns(spark, monkeypatch):
    rng = np.random.default_rng(5)
    some = [(100 + k, " ".join(f"{'ab'[k % 2]}{int(x)}" for x in rng.geometric(0.15, 25)), "en") for k in range(40)]
    rows = [r for r in ODD if r[0] != 8] + [(10 + k, f"alpha beta gamma {k % 5} delta alpha", "en") for k in range(60)] + some
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t, _ in rows if not held(i) for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    monkeypatch.setattr(hmm_lm, "OWN_SHARE", 0.01)
    monkeypatch.setattr(hmm_lm, "LEAST_GAIN", -1.0)
    want = plain_scores(rows, held, 2, 16, 0.01, 3)
    for postings, chunk in ((2_000_000, 1_000_000), (7, 40)):
        monkeypatch.setattr(hmm_lm, "RANGE_POSTINGS", postings)
        monkeypatch.setattr(hmm_lm, "CHUNK_WORDS", chunk)
        got = hmm_lm.score_documents(docs(spark, rows), fold(7) != 2, n_classes=16, states=2, passes=3).collect()
        out = {(r.doc_id, r.n_tokens): r for r in got}
        assert len(got) == len(rows)
        for (i, t, _), score in zip(rows, want, strict=True):
            own = [*words(t), None]
            r = out[i, len(own)]
            assert r.train == (not held(i)) and r.train_tokens == n
            assert r.n_known == sum(count[w] > 0 for w in own)
            assert abs(r.base_score - sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)) < 1e-9 * abs(r.base_score) + 1e-9
            assert abs(r.score - score) < 1e-3
    assert hmm_lm.score_documents(docs(spark, []), fold(7) != 2, n_classes=64).count() == 0
    assert {r.n_known for r in hmm_lm.score_documents(docs(spark, rows), F.lit(False), n_classes=64).collect()} == {0}


def test_posting_traffic_does_not_grow_with_ranges():
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([None, 3]), pa.array([False, True]), pa.array(["a b c d e f " * 50, "a b g"])], names=["n", "doc_id", "train", "text"])
    own = np.unique(text.word_hashes(*text.buffers(batch.column("text")))[0])
    chunk = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([own.tobytes()], pa.binary()), pa.array([np.ones(len(own), np.uint32).tobytes()], pa.binary())], names=["chunk", "words", "counts"])
    for ranges in (1, 8, 512, 100_000):
        rows = [r for b in hmm_lm._postings(ranges)(iter([chunk])) for r in b.to_pylist()]
        assert sum(len(r["words"]) for r in rows) == 8 * len(own) and len(rows) <= len(own)
        assert np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows]).tolist() == own.tolist()
        assert all(int(w) * ranges >> 64 == r["frag"] for r in rows for w in np.frombuffer(r["words"], np.uint64))


def test_kneser_ney_is_a_distribution_and_tells_languages_apart(spark):
    rows = [(k, f"the river and the stone {k} with a light" if k % 2 else f"der fluss und das licht {k} mit einem stein", "en" if k % 2 else "de") for k in range(80)]
    df = docs(spark, rows + [(200, None, "en"), (201, "123 ...", "en"), (202, "the light", None)])
    model = langid.train_model(df.where("lang is not null and text is not null and doc_id < 100").select("text", "lang"))
    letters = sorted({c for _, t, _ in rows for c in t if c.isalpha()} | {" "})
    for past in ("the", " st", "xyz"):
        keys = np.array([(ord(past[0]) << 48) | (ord(past[1]) << 32) | (ord(past[2]) << 16) | ord(c) for c in letters], np.uint64)
        mass = (10.0 ** model.log_probabilities(keys)).sum(0)
        assert (mass < 1.0001).all() and (mass > 0.9).all()
    out = {r.doc_id: r for r in langid.identify(df, fold(4) != 2).collect()}
    assert all(out[k].lang_pred == x for k, _, x in rows) and out[202].lang_pred == "en"
    assert out[200].lang_pred == out[201].lang_pred == "und" and out[200].score == 0
    assert {r.lang_pred for r in langid.identify(docs(spark), F.lit(False)).collect()} == {"und"}


def plain_kneser_ney(train):
    """log10 P(last | before) of four characters, by dictionaries: train is language -> texts of letters and single spaces."""
    levels = {}
    for lang, texts in train.items():
        now = Counter(("   " + t)[k : k + 4] for t in texts for k in range(len(t)))
        levels[lang] = [now]
        for _ in range(3):
            now = Counter(g[1:] for g in now)
            levels[lang].append(now)
    letters = {g for own in levels.values() for g in own[3]}

    def probability(lang, gram):
        if not gram:
            return 1 / (len(letters) + 1)
        counts = levels[lang][4 - len(gram)]
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        d = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
        own = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        total, lower = sum(own.values()), probability(lang, gram[1:])
        return lower if not total else max(0, own.get(gram, 0) - d * (gram in own)) / total + d * len(own) / total * lower

    return probability


def test_kneser_ney_equals_plain_counts():
    rng = np.random.default_rng(4)
    train = {x: [" ".join("".join(rng.choice(list(signs), rng.integers(1, 6))) for _ in range(6)) for _ in range(8)] for x, signs in (("aa", "abcde"), ("bb", "abcéß"), ("cc", "cdx"))}
    counts = {}
    for x, texts in train.items():
        key, _, _ = langid.grams(texts)
        counts[x] = np.unique(key, return_counts=True)
    model, plain = langid.Model(counts), plain_kneser_ney(train)
    some = ["abc de", "éß", "x", "zzz q", "a b c d e x é"]
    e, letters = model.entropies(some)
    for k, t in enumerate(some):
        assert letters[k] == sum(c != " " for c in t)
        for j, x in enumerate(model.langs):
            want = -np.mean([math.log10(plain(x, ("   " + t)[i : i + 4])) for i in range(len(t))])
            assert abs(e[k, j] - want) < 1e-5


def test_language_models_keep_every_gram_and_calibrate_rare_languages(spark, monkeypatch):
    signs = np.random.default_rng(1).integers(0x4E00, 0x9F00, (60, 10_000))
    rows = [(k, "".join(map(chr, own)), "zh") for k, own in enumerate(signs)] + [(100 + k, f"the river and the stone {k}", "en") for k in range(340)] + [(500 + k, f"das licht {k} am fluss", "de") for k in range(6)]
    model = langid.train_model(docs(spark, rows).select("text", "lang"))
    keys = {x: np.unique(langid.grams([t for _, t, own in rows if own == x])[0]) for x in ("de", "en", "zh")}
    assert model.langs == ["de", "en", "zh"] and len(keys["zh"]) > 1 << 19
    for order in range(1, 5):
        want = np.unique(np.concatenate(list(keys.values())) & np.uint64((1 << 16 * order) - 1))
        assert len(model.grams[order - 1].order) == len(want) and (model.grams[order - 1].find(want) >= 0).all()
    seen, calibrate = [], langid.calibrate
    monkeypatch.setattr(langid, "CALIBRATION_DOCS", 18)
    monkeypatch.setattr(langid, "calibrate", lambda model, sample: seen.extend(r.lang for r in sample.collect()) or calibrate(model, sample))
    langid.identify(docs(spark, rows[60:]), F.lit(True))
    assert seen.count("de") == 6 and 0 < seen.count("en") < 80


def test_language_scores_and_rejection_come_from_all_training_documents(spark, monkeypatch):
    rng = np.random.default_rng(6)
    some = {"en": "the river and stone with a light on every hill".split(), "de": "der fluss und ein stein mit dem licht am berg".split()}
    rows = []
    for k in range(700):
        lang = "en" if k % 3 else "de"
        own = rng.choice(some[lang], rng.integers(1, 9))
        rows.append((k, " ".join(own), lang if rng.random() < 0.9 else "de"))  # some are labelled wrongly
    rows += [(700 + k, "".join(rng.choice(list("qxzjvw"), 12)), None) for k in range(20)] + [(800, "river fluss", None), (801, "", "en"), (802, None, "de"), (803, "12", "de")]
    model = langid.train_model(docs(spark, [r for r in rows if r[1] is not None and r[2]]).select("text", "lang"))
    e, letters = model.entropies([t or "" for _, t, _ in rows])
    e, own = e.astype(float), np.array([model.langs.index(x) if x and t is not None else -1 for _, t, x in rows])
    learned = np.flatnonzero(own >= 0)
    fit = []
    for t in langid.SHARPNESS:
        z = -t * (e[learned] - e[learned].min(1, keepdims=True))
        fit.append((z[np.arange(len(z)), own[learned]] - np.log(np.exp(z).sum(1))).sum())
    sharp = langid.SHARPNESS[int(np.argmax(fit))]
    limit = np.array([np.quantile(e[own == j, j], 1 - langid.REJECT_TAIL) for j in range(2)])
    best, low = e.argmin(1), e.min(1)
    score = np.where(letters > 0, 1 / np.exp(-sharp * (e - low[:, None])).sum(1), 0)
    sampled = langid.calibrate
    monkeypatch.setattr(langid, "CALIBRATION_DOCS", 8)
    for least in (sampled, lambda model, sample: np.full(2, -np.inf), lambda model, sample: np.array([np.inf, 0.5])):
        monkeypatch.setattr(langid, "calibrate", least)
        out = {r.doc_id: r for r in langid.identify(docs(spark, rows), F.lit(True)).collect()}
        for i, (k, _, _) in enumerate(rows):
            assert out[k].lang_pred == (model.langs[best[i]] if letters[i] else "und") and abs(out[k].score - score[i]) < 1e-4
            if min(abs(low[i] - limit[best[i]]), abs(score[i] - 0.5)) > 1e-4:
                assert out[k].rejected == bool(not letters[i] or low[i] > limit[best[i]] or score[i] < 0.5)


def test_language_thresholds_are_exact_quantiles_wherever_the_search_begins(spark):
    rng = np.random.default_rng(7)
    own = [np.round(rng.random(n) * 2 - 0.1, digits) for n, digits in ((5000, 9), (3001, 2), (1, 3), (2, 3))]
    values = [(j, float(x), float(x - rng.random() / 9)) for j, xs in enumerate(own) for x in xs]
    rows = [(k, True, True, j, e, [1 + 1 / t for t in langid.SHARPNESS], j, x) for k, (j, x, e) in enumerate(values)]
    rows += [(k, False, True, 0, 99.0, [1.0] * len(langid.SHARPNESS), None, None) for k in range(9)]
    df = spark.createDataFrame(rows, langid.SCORED).repartition(3)
    fit = [sum(-t * (x - e) - math.log(1 + 1 / t) for _, x, e in values) for t in langid.SHARPNESS]
    want = [np.quantile(xs, 1 - langid.REJECT_TAIL) for xs in own] + [np.inf]
    for least in ([-np.inf] * 5, [np.inf] * 5, [float(np.quantile(xs, 0.98)) for xs in own] + [-np.inf], [1.0, 1.9, -1.0, own[3].max(), 0.0]):
        place, limit = langid.thresholds(df, np.array(least))
        assert np.allclose(limit, want, rtol=1e-12, atol=0) and place == int(np.argmax(fit))


def test_token_files_equal_whole_encoding(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [*ODD, (20, "a  b   c\n\n d \t e ", "x"), (21, " x", "x"), (22, "don't  stop. 's é. ×.", "x"), (23, "a <|endoftext|> b", "x"), (24, "in<|endoftext|>side  <|endoftext|><|endoftext|>.", "x"), (25, "<|endof", "x"), (25, "text|>", "x"), (26, "<|endoftext|>", "x")]
    path = tokenizer_file("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    got = token_store.token_digest(docs(spark, rows), path, end_id=2).collect()
    assert len(got) == len(rows)
    by_id = {}
    for i, t, _ in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        by_id.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (r.n_tokens, r.ids_crc32) in by_id[r.doc_id]
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    assert token_store.token_digest(docs(spark, []), path, end_id=2).count() == 0
    token_store.write_token_files(docs(spark, rows), str(tmp_path / "t"), path, end_id=2)
    assert {r.doc_id for r in token_store.read_tokens(spark, str(tmp_path / "t"), 3, 5).collect()} == {3, 4, 5}


def test_viterbi_equals_dynamic_programming_and_round_trips(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    c = piece_codec.codec(path)

    def plain(chunk):
        best = [(0.0, [])] + [None] * len(chunk)
        for e in range(1, len(chunk) + 1):
            found = []
            for s in range(e):
                if chunk[s:e] in c.pieces:
                    i, score = c.pieces[chunk[s:e]]
                    found.append((best[s][0] + score, -s, [*best[s][1], i]))
                elif e - s == 1:
                    found.append((best[s][0] + c.spelled, -s, [*best[s][1], *(c.bytes[b] for b in chunk[s:e].encode())]))
            top = max(found, key=lambda x: x[0])
            best[e] = (top[0], top[2])
        return best[-1]

    for chunk in (" hello", " Übergrößen", "  two", " 日本語▁x", " \n\t", " internationalisation"):
        ids, score = c.best_scored(chunk)
        assert abs(score - plain(chunk)[0]) < 1e-6
    out = piece_codec.codec_digest(docs(spark), path).collect()
    assert len(out) == len(ODD) and all(r.exact for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (2, 3)} == {0}
    full = piece_codec.encode_documents(docs(spark), path, carry=("label", "carried_0")).collect()
    assert {r.decoded for r in full} == {t or "" for _, t, _ in ODD} and {r.label for r in full} == {r.carried_0 for r in full} == {"clash"}
