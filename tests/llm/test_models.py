"""Toxicity, quality and language identification: held-out accuracy, gradients, edge cases."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import common, langid, quality, textkernel, toxicity

LABELS = "doc_id long, quality int, toxic int"


def syllables(rng, parts, n):
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def toxic_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = syllables(rng, ["er", "th", "on", "an", "re", "st", "in", "ou"], rng.randrange(5, 220))
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randrange(1, 4)):
                k = rng.randrange(len(w) + 1)
                w.insert(k, rng.choice(["nasty", "vile", "brute"]) if i % 2 else "xqzu" + rng.choice(["er", "th", "on", "an", "re", "st", "in"]) + rng.choice(["ou", "in", "st"]))
        rows.append((" ".join(w), int(bad)))
    return rows


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    xs = rng.standard_normal((6, 3, toxicity.DW + toxicity.DC))
    live, y, w = np.arange(6)[:, None] < np.array([6, 4, 1]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    g, dx, _ = net.gradients(xs, live, y, w)
    e = 1e-4
    for k in net.p:
        for i in list(np.ndindex(net.p[k].shape))[:: max(1, net.p[k].size // 5)]:
            net.p[k][i] += e
            up = net.gradients(xs, live, y, w)[2]
            net.p[k][i] -= 2 * e
            down = net.gradients(xs, live, y, w)[2]
            net.p[k][i] += e
            assert g[k][i] == pytest.approx((up - down) / 2 / e, abs=2e-5)
    xs[2, 0, 1] += e
    up = net.gradients(xs, live, y, w)[2]
    xs[2, 0, 1] -= 2 * e
    assert dx[2, 0, 1] == pytest.approx((up - net.gradients(xs, live, y, w)[2]) / 2 / e, abs=2e-5)


@pytest.fixture(scope="module")
def net():
    return toxicity.train(toxic_rows(1500, 1))


def test_toxicity_held_out(net):
    test = toxic_rows(500, 2)
    score, _ = net.doc_scores(pa.array([t for t, _ in test]))
    said, y = score >= net.threshold, np.array([b for _, b in test]) > 0
    assert said[y].mean() > 0.95 and said[~y].mean() < 0.02


def test_every_window_is_scored(net):
    clean = [t for t, b in toxic_rows(300, 3) if not b]
    long = " ".join(clean[:100])
    texts = [long, long + " nasty vile brute nasty", "nasty vile brute nasty " + long, long[: len(long) // 2] + " nasty vile brute nasty " + long[len(long) // 2 :]]
    score, count = net.doc_scores(pa.array(texts))
    assert score[0] < net.threshold and (score[1:] >= net.threshold).all()
    n = len(long.split())
    assert count[0] == -(-(n - toxicity.WINDOW) // toxicity.STRIDE) + 1
    doc, first, size = toxicity.windows(np.array([0, 1, 32, 33, 100]), np.array([0, 0, 1, 33, 66]))
    covered = {(d, k) for d, f, s in zip(doc, first, size) for k in range(f, f + s)}
    assert len(covered) == 166


def plain_score(net, text):
    """The highest window's probability, word by word in plain Python."""
    words = textkernel.Scan(pa.array([text])).words(0, 1 << 30)
    if not words:
        return 0.0
    xs = []
    for w in words:
        slot, _, grams, _ = toxicity.word_inputs(textkernel.Scan(pa.array([w])))
        xs.append([*net.words[slot[0]], *sum((net.chars[g] for g in grams), np.zeros(toxicity.DC))])
    h = toxicity.H
    sig = lambda v: 1 / (1 + np.exp(-v))

    def run(seq, d):
        state, out = np.zeros(h), []
        for x in seq:
            px, r = np.array(x) @ net.p[f"W{d}"] + net.p[f"b{d}"], state @ net.p[f"U{d}"]
            z, g = sig(px[:h] + r[:h]), sig(px[h : 2 * h] + r[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(px[2 * h :] + g * r[2 * h :])
            out.append(state)
        return out

    best = -1e9
    starts = {*range(0, max(1, len(words) - toxicity.WINDOW + 1), toxicity.STRIDE), max(0, len(words) - toxicity.WINDOW)}
    for k in starts:
        seq = xs[k : k + toxicity.WINDOW]
        hs = [np.concatenate(p) for p in zip(run(seq, "f"), run(seq[::-1], "b")[::-1])]
        e = np.array([np.tanh(v @ net.p["Wa"] + net.p["ba"]) @ net.p["va"] for v in hs])
        a = np.exp(e - e.max())
        best = max(best, float(sum(x * v for x, v in zip(a / a.sum(), hs)) @ net.p["Wo"] + net.p["bo"][0]))
    return float(sig(best))


def test_scores_against_plain_python(net):
    texts = [t for t, _ in toxic_rows(25, 8)] + ["", None, "a", " ".join(f"w{i}" for i in range(100)), "vile", "vile"]
    score, _ = net.doc_scores(pa.array(texts))
    assert score == pytest.approx([plain_score(net, t) for t in texts], abs=1e-3)
    assert score[-1] == score[-2]  # ties


def ordered_rows(n, seed):
    """Toxic texts say "zark velm", the others "velm zark"."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = syllables(rng, ["er", "th", "on", "an", "re", "st", "in", "ou"], rng.randrange(5, 60))
        k = rng.randrange(len(w) + 1)
        w[k:k] = ["velm", "zark"] if i % 3 else ["zark", "velm"]
        rows.append((" ".join(w), int(i % 3 == 0)))
    return rows


def test_ablation(net):
    """What the recurrent network adds to the counted columns, and the character input to the words."""
    deep, test = toxicity.train(ordered_rows(3000, 1), epochs=20), ordered_rows(500, 2)
    y, texts = np.array([b for _, b in test]) > 0, pa.array([t for t, _ in test])
    scan = textkernel.Scan(texts)
    slot, inverse, grams, begin = toxicity.word_inputs(scan)
    x = deep.inputs(slot, grams, begin)
    doc, first, size = toxicity.windows(scan.n_words, scan.first)
    cum = np.append(0, np.cumsum((x[:, 0] + x[:, toxicity.DW])[inverse]))
    counts = np.maximum.reduceat(cum[first + size] - cum[first], np.searchsorted(doc, np.arange(scan.n_docs)))
    assert max(((counts >= c) == y).mean() for c in np.unique(counts)) < 0.75
    assert ((deep.doc_scores(texts)[0] >= deep.threshold) == y).mean() > 0.95
    # character vectors are trained, and needed for words that were never counted
    assert np.abs(deep.chars[:, 1:] - toxicity.Network.fresh(7).chars[:, 1:]).max() > 0.01
    test = toxic_rows(500, 2)
    y, texts = np.array([b for _, b in test]) > 0, pa.array([t for t, _ in test])
    mute = toxicity.Network(net.words, np.zeros_like(net.chars), net.p)
    score = mute.doc_scores(texts)[0]
    assert max(((score >= c) == y).mean() for c in np.unique(score)) < 0.95 < ((net.doc_scores(texts)[0] >= net.threshold) == y).mean()


def test_a_rare_class_is_in_the_sample(spark):
    labels = spark.createDataFrame([(i, 1, int(i % 500 == 0)) for i in range(3000)], LABELS)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)], "doc_id long, text string")
    rows = common.labelled_sample(docs, labels, "toxic", 60).collect()
    assert sum(r.y for r in rows) == 6 and 60 <= len(rows) <= 66


def test_toxicity_frames(spark, net):
    rows = toxic_rows(300, 4) + [(None, 0), ("", 0), ("...", 0)] + [(toxic_rows(1, 0)[0][0] + " nasty vile nasty", 1)] * 2
    docs = spark.createDataFrame([(i, t, "a", "b") for i, (t, _) in enumerate(rows)] + [(None, "vile", "a", "b")], "doc_id long, text string, TOXIC string, n_windows string")
    labels = spark.createDataFrame([(i, 1, b) for i, (_, b) in enumerate(rows)] + [(1, 1, None), (None, 1, 1)], LABELS)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {300, 301, 302} <= set(ids) and not {303, 304} & set(ids)
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0
    assert 50 <= common.labelled_sample(docs, labels, "toxic", 50).count() <= 75


def quality_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = syllables(rng, ["er", "th", "on", "an", "re", "st", "in", "ou"], rng.randrange(30, 200))
        bad = i % 6 == 0
        if bad:
            kind = rng.randrange(3)
            w = [x + "###" for x in w] if kind == 0 else [x.upper() + "!!" for x in w] if kind == 1 else [w[0]] * len(w)
        rows.append((" ".join(w), int(not bad)))
    return rows


def test_quality_held_out():
    model = quality.train(quality_rows(900, 1))
    test = quality_rows(400, 2)
    p = 1 / (1 + np.exp(-model.logit(quality.measures(pa.array([t for t, _ in test])))))
    good = np.array([y for _, y in test]) > 0
    assert ((p >= model.threshold) == good).mean() > 0.97


def brute_posteriors(rows):
    """The hierarchy in plain Python, from (host, path, p)."""
    place, host = {}, {}
    for h, p, x in rows:
        for d, k in ((place, (h, p)), (host, h)):
            n, g = d.get(k, (0, 0.0))
            d[k] = n + 1, g + x
    n, g = sum(v[0] for v in host.values()), sum(v[1] for v in host.values())
    prior = min(max(g / n, 1e-4), 1 - 1e-4)

    def strength(items):
        items = [(k, s, m) for k, s, m in items if k > 1]
        if not items:
            return 10.0
        total = sum(k for k, _, _ in items)
        between = max((sum(k * (s / k - m) ** 2 for k, s, m in items) - sum(m * (1 - m) for _, _, m in items)) / total, 1e-6)
        return min(max(sum(k * m * (1 - m) for k, _, m in items) / total / between - 1, 1.0), 1e4)

    a = strength([(k, s, prior) for k, s in host.values()])
    hp = {h: (s + a * prior) / (k + a) for h, (k, s) in host.items()}
    b = strength([(k, s, hp[h]) for (h, _), (k, s) in place.items()])
    return {(h, p): (s + b * hp[h]) / (k + b) for (h, p), (k, s) in place.items()}


def test_posteriors_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), round(rng.random() ** 2, 6)) for _ in range(400)] + [("lone", "z", 0.125)]
    counts = spark.createDataFrame(rows, "host string, path string, p double").groupBy("host", "path").agg({"p": "sum", "*": "count"}).toDF("host", "path", "good", "n")
    got = {(r.host, r.path): r.posterior for r in quality.posteriors(counts.select("host", "path", "n", "good")).collect()}
    want = brute_posteriors(rows)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(min(max(v, 1e-4), 1 - 1e-4), abs=1e-9) for k, v in want.items())
    assert abs(got["lone", "z"] - sum(r[2] for r in rows) / len(rows)) < abs(0.125 - sum(r[2] for r in rows) / len(rows))  # shrunk


@pytest.mark.parametrize("few", [100_000, 0])
def test_quality_frames(spark, few):
    rows = quality_rows(300, 3) + [(None, 1), ("", 1)]
    docs = spark.createDataFrame([(i, t, None if i % 7 == 0 else f"s{i % 3}", None if i % 11 == 0 else "en", "k") for i, (t, _) in enumerate(rows)], "doc_id long, text string, source string, lang string, keep string")
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(rows)], LABELS)
    kept = quality.keep_good(docs.union(docs.limit(5)), labels, max_broadcast_paths=few)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    truth = {i for i, (_, y) in enumerate(rows[:300]) if y}
    assert len(ids & truth) >= 0.98 * len(truth) and len(ids - truth - {300, 301}) <= 2
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    urls = docs.withColumnRenamed("source", "url")
    assert quality.score_documents(urls, quality.fit(docs, labels), url="url").count() == docs.count()


def test_quality_against_brute_force(spark):
    """The whole result from single texts and the plain hierarchy."""
    rows = quality_rows(200, 6) + [(None, 1), ("", 1), ("word " * 60000, 0), (quality_rows(1, 6)[0][0], 0)]
    docs = [(i, t, None if i % 7 == 0 else f"http://h{i % 3}.example/p{i % 2}/x") for i, (t, _) in enumerate(rows)]
    df = spark.createDataFrame([(*d, "a", 1.5, 2) for d in docs], "doc_id long, body string, url string, host__ string, posterior double, path__ int")
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(rows)], LABELS)
    model = quality.fit(df, labels, text="body")
    got = {r[0]: r[-4:] for r in quality.score_documents(df, model, text="body", url="url").collect()}
    ev = {i: float(model.logit(quality.measures(pa.array([t], pa.string())))[0]) for i, t, _ in docs}
    place = {i: (u.split("/")[2], u.split("/")[3]) if u else (None, None) for i, _, u in docs}
    p = {i: round(1e6 / (1 + math.exp(-x))) / 1e6 for i, x in ev.items()}
    post = {k: min(max(v, 1e-4), 1 - 1e-4) for k, v in brute_posteriors([(*place[i], p[i]) for i in ev]).items()}
    prior = min(max(sum(p.values()) / len(p), 1e-4), 1 - 1e-4)
    odds = lambda x: math.log(x / (1 - x))
    for i in ev:
        o = ev[i] + 0.3 * (odds(post[place[i]]) - odds(prior))
        assert got[i][:3] == pytest.approx((ev[i], post[place[i]], 1 / (1 + math.exp(-o))), abs=2e-6)
        assert got[i][3] == (o >= odds(model.threshold)) or abs(o - odds(model.threshold)) < 1e-9
    kept = quality.keep_good(df, labels, text="body", url="url", bound=150)
    assert kept.columns == df.columns and kept.count() > 100


PARTS = {"aa": ["er", "th", "on", "an"], "bb": ["ção", "que", "os", "ei"], "cc": ["sch", "ung", "ö", "ie"]}


def test_language_filters(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(syllables(rng, PARTS[k], rng.randrange(3, 60))), k) for i, k in enumerate(["aa", "bb", "cc"] * 200)]
    # one label in fifty is wrong
    noisy = [(i, t, "aa" if i % 50 == 1 else k) for i, t, k in rows]
    edge = [(1000, None, "aa"), (1001, "", "bb"), (1002, "?!", None), (1003, rows[0][1], None), (1003, rows[0][1], None)]
    docs = spark.createDataFrame(noisy + edge, "doc_id long, text string, lang string")
    out = langid.identify(docs, langid.fit(docs, bound=400)).collect()
    assert len(out) == len(noisy) + len(edge)
    truth = {i: k for i, _, k in rows} | {1000: "und", 1001: "und", 1002: "und", 1003: "aa"}
    assert sum(r.language == truth[r.doc_id] for r in out) >= 0.99 * len(out)
    assert {r.language for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.fit(docs)).count() == 0


def test_language_decision_against_brute_force():
    """Counting, correction and decision, n-gram by n-gram."""
    rng = random.Random(4)
    f = langid.Filters.build([(" ".join(syllables(rng, PARTS[k], 40)), k) for k in PARTS for _ in range(20)])
    texts = [" ".join(syllables(rng, PARTS[k], rng.randrange(1, 30))) for k in PARTS for _ in range(20)] + [None, "", "?", "x", " ".join(syllables(rng, PARTS["aa"], 20000))]
    found, share, n = f.decide(pa.array(texts))
    for i, t in enumerate(texts):
        h = [x for x in langid.grams(textkernel.Scan(pa.array([t], pa.string()), solo=False))[0]]
        assert n[i] == len(h) == sum(max(0, len(w) + 3 - k) for w in (t or "").replace("?", "").split() for k in langid.GRAMS)
        if not h:
            assert (found[i], share[i]) == (-1, 0)
            continue
        hits = [sum(all(int(f.rows[int(p[0]), 0]) >> k & 1 for p in f.places(np.array([x]))) for x in h[:3000]) for k in range(3)]
        if len(h) <= 3000:
            corrected = [min(1, max(0, (c - r * len(h)) / (1 - r) / len(h))) for c, r in zip(hits, f.false_rate)]
            assert found[i] == max(range(3), key=lambda k: (round(corrected[k], 6), -k)) and share[i] == pytest.approx(corrected[found[i]])


def test_many_languages_ties_and_clashes(spark):
    """70 languages need two words of a mask; equal shares go by the alphabet; a repeated id is one sample text."""
    rng = random.Random(6)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    parts = {f"l{k:02}": ["".join(rng.choice(alphabet) for _ in range(3)) for _ in range(6)] for k in range(70)}
    rows = [(i, " ".join(syllables(rng, parts[k], 12)), k, 1) for i, k in enumerate(sorted(parts) * 6)]
    twins = [(9000 + i, "qqq www eee rrr ttt", k, 1) for i, k in enumerate(["zz", "yy"] * 3)]
    df = spark.createDataFrame(rows + twins + [(5, rows[5][1], "l05", 1)] * 20, "item long, text string, lang string, language int")
    f = langid.fit(df, id_col="item")
    assert len(f.languages) == 72 and f.rows.shape[1] == 2
    out = {r.doc_id: r.language for r in langid.identify(df, f, id_col="item").collect()}
    assert sum(out[i] == k for i, _, k, _ in rows) >= 0.99 * len(rows)
    assert out[9000] == "yy"
    assert langid.fit(df.limit(0), id_col="item") is None


def test_a_rare_language_is_learned(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(syllables(rng, PARTS["bb" if i % 200 == 0 else "aa"], 20)), "bb" if i % 200 == 0 else "aa") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df, bound=20).languages == ["aa", "bb"]


def test_filters_answer_like_sets():
    rng = random.Random(2)
    sample = [(" ".join(syllables(rng, PARTS[k], 40)), k) for k in PARTS for _ in range(30)]
    f = langid.Filters.build(sample, min_texts=1, least_rate=0.0)
    h, _ = langid.grams(textkernel.Scan(pa.array([t for t, _ in sample])))
    sets = {}
    for k in PARTS:
        sets[k] = set(langid.grams(textkernel.Scan(pa.array([t for t, x in sample if x == k])))[0].tolist())
    masks = f.masks(h)
    for bit, k in enumerate(f.languages):
        said = (masks[:, 0] >> np.uint64(bit)) & np.uint64(1) > 0
        true = np.array([x in sets[k] for x in h.tolist()])
        assert said[true].all() and said[~true].mean() < 0.01  # no false negatives, few false positives


def test_words_of_scripts_without_spaces():
    import unicodedata

    texts = ["abc中文def かなgo", "ที่นี่ไทย x", "ไก่a", "漢́字", "中", "a中"]
    scan = textkernel.Scan(pa.array(texts))
    got = [scan.words(scan.first[i], scan.first[i + 1]) for i in range(len(texts))]
    assert got[0] == ["abc", "中", "文", "def", "か", "な", "go"] and got[2][-1] == "a" and got[3] == ["漢́", "字"] and got[4:] == [["中"], ["a", "中"]]
    assert "".join(got[1]) == "ที่นี่ไทยx" and all(sum(unicodedata.category(c)[0] != "M" for c in w) == 1 for w in got[1])
    assert scan.weights()[:3].tolist() == [1, 0.5, 0.5] and scan.weights()[scan.first[1]] == 0.25
    whole = textkernel.Scan(pa.array(texts), solo=False)
    assert whole.words(0, 2) == ["abc中文def", "かなgo"]


def test_scan_against_python():
    import re
    import unicodedata

    texts = ["Ein Wort, zwei\nWörter.", None, "", "ÀÉÎ õü ß 日本語 a1_b2", "😀 x😀y", "İstanbul étude", "--"]
    scan = textkernel.Scan(pa.array(texts))
    for i, t in enumerate(texts):
        want = re.findall(r"\S+", "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in (t or "")))
        got = scan.words(scan.first[i], scan.first[i + 1])
        if i == 3:
            assert got == ["àéî", "õü", "ß", "日", "本", "語", "a1", "b2"]
            continue
        assert [w.lower() if len(w.lower()) == len(w) else None for w in want] == [g if len(w.lower()) == len(w) else None for g, w in zip(got, want)]
        assert scan.text_of(i) == (t or "")
    a, b = textkernel.Scan(pa.array(["one two Three"])), textkernel.Scan(pa.array(["xx", "zzz ONE two three"]))
    assert a.word_hashes().tolist() == b.word_hashes()[2:].tolist()
    assert textkernel.doc_shingles(a, 3)[0].tolist() == [textkernel.doc_shingles(b, 3)[0][k] for k in (2,)]
