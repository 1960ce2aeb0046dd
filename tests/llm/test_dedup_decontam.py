"""Near-dedup and decontamination against brute force, and their edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from corvane.llm import chosen_path, decontamination

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=""):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


def words(rng, n, vocab=4000):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def brute_groups(texts, threshold=0.5):
    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    sizes = {}
    for i in root:
        sizes.setdefault(find(i), []).append(i)
    return {i: r for r, m in sizes.items() if len(m) > 1 for i in m}, pairs


def corpus(seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        w = words(rng, rng.randrange(20, 160))
        out.append(" ".join(w))
        for _ in range(rng.randrange(0, 4)):
            v = [x if rng.random() > rng.choice([0.0, 0.03, 0.08, 0.3]) else f"z{rng.randrange(9999)}" for x in w]
            out.append(" ".join(v))
    passage = " ".join(words(rng, 60))
    out += [passage + " " + " ".join(words(rng, rng.randrange(100, 300))) for _ in range(150)]  # more than a leaf shares it
    big = words(rng, 80)
    out += [" ".join(x if rng.random() > 0.04 else f"y{rng.randrange(9999)}" for x in big) for _ in range(160)]  # more than a leaf are alike
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("options", [{"leaf": 32}, {"leaf": 8, "block": 16, "max_broadcast_ids": 0}])
def test_groups_against_brute_force(spark, options):
    texts = corpus()
    expected, pairs = brute_groups(texts)
    rows = chosen_path.near_groups(docs_of(spark, texts), **options).collect()
    got = {r.doc_id: r.group_id for r in rows}
    found = sum(got.get(a) is not None and got.get(a) == got.get(b) for a, b in pairs)
    assert found >= 0.98 * len(pairs)
    assert all(expected.get(i) == g for i, g in got.items()) or found < len(pairs)
    assert all(i in expected for i in got)
    sizes = Counter(got.values())
    assert all(r.n_links == sizes[r.group_id] - 1 for r in rows)


def test_a_node_of_many_blocks_joins_whom_it_should(spark):
    rng = random.Random(5)
    hot, texts = words(rng, 100), []
    for k in range(400):  # one cluster of 300 alike texts, 50 pairs that share six tenths of it: below the threshold with it, above with each other
        if k < 300:
            texts.append((k, " ".join(x if rng.random() > 0.01 else f"y{k}" for x in hot)))
        else:
            own = (k - 300) // 2
            texts.append((k, " ".join([*hot[:60], *(f"p{own}x{i}" for i in range(30)), *(f"q{k}x{i}" for i in range(12))])))
    expected, _ = brute_groups(texts)
    got = {r.doc_id: r.group_id for r in chosen_path.near_groups(docs_of(spark, texts), leaf=4, block=32).collect()}
    assert got == expected and len(set(expected.values())) == 51


def test_copies_and_edge_cases(spark):
    long = " ".join(f"a{i}" for i in range(30000))
    texts = [(1, "One two three four five."), (2, "one TWO three, four five"), (3, None), (4, ""), (5, "!!! ???"), (6, "hi"), (7, "Hi!"), (8, long), (9, long + " tail"), (None, "One two three four five."), (10, "other words are here now")]
    df = docs_of(spark, texts)
    got = {r.doc_id: r.group_id for r in chosen_path.near_groups(df).collect()}
    assert got == {1: 1, 2: 1, 6: 6, 7: 6, 8: 8, 9: 8}
    kept = [r.doc_id for r in chosen_path.drop_near_duplicates(df).collect()]
    assert sorted(kept, key=str) == [1, 10, 3, 4, 5, 6, 8, None]


def test_many_copies_collapse(spark):
    df = docs_of(spark, [(i, "the same text stands here many times over") for i in range(2000)] + [(5000, "something else altogether is in this one")])
    assert [r.doc_id for r in chosen_path.drop_near_duplicates(df).orderBy("doc_id").collect()] == [0, 5000]


def test_repeated_rows_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d", 1, 2, 3), (1, "a b c d", 1, 2, 3), (2, "x y z u", 1, 2, 3), (2, "aa y z u", 4, 5, 6)], "doc_id long, text string, drop__ int, twice__ int, rank__ int")
    out = chosen_path.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "a b c d"), (2, "aa y z u")]
    assert chosen_path.drop_near_duplicates(df.limit(0)).count() == 0


def test_trees_reach_recall():
    n = chosen_path.trees_for(0.5, 3, 0.99)
    assert 1 - (1 - chosen_path.survival(0.5, 3, 3)) ** n >= 0.99


def test_deep_nodes_keep_recall(spark):
    rng = random.Random(11)
    passage, texts = words(rng, 62), []
    for k in range(1000):  # all share the passage (J 0.3), each has one partner (J 0.52)
        both = [f"p{k}x{i}" for i in range(27)]
        texts += [(2 * k + s, " ".join([*passage, *both, *(f"q{k}x{s}x{i}" for i in range(41))])) for s in (0, 1)]
    got = {r.doc_id: r.group_id for r in chosen_path.near_groups(docs_of(spark, texts), leaf=2).collect()}
    assert sum(got.get(2 * k) == 2 * k == got.get(2 * k + 1) for k in range(1000)) >= 0.99 * 1000
    n = chosen_path.trees_for(0.5, 3, 0.99)
    assert chosen_path.survival(0.5, 3, chosen_path.LEVELS, n) >= 0.99


def brute_decontaminate(texts, items, n=8, least=5, share=0.5):
    grams = set()
    for t in items:
        w = [x.lower() for x in re.findall(r"[^\W_]+", t or "")]
        k = min(n, len(w))
        if k >= least:
            grams |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = {}
    for i, t in texts:
        spans = list(re.finditer(r"[^\W_]+", t or ""))
        w = [m[0].lower() for m in spans]
        flag = [False] * len(w)
        for k in {len(g) for g in grams}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in grams:
                    flag[j : j + k] = [True] * k
        if sum(flag) > share * len(w):
            continue
        text = (t or "")[: spans[0].start()] if spans else (t or "")
        ends = [m.start() for m in spans[1:]] + [len(t or "")]
        text += "".join((t or "")[m.start() : e] for m, e, f in zip(spans, ends, flag) if not f)
        out[i] = text if any(flag) else t
    return out


@pytest.mark.parametrize("slices", [4_000_000, 20])
def test_decontamination_against_brute_force(spark, slices):
    rng = random.Random(3)
    items = [" ".join(words(rng, k, 50)) for k in (3, 5, 7, 12, 30)] + [None, "", "éa Öb ßc dd ee ff gg hh ii"]
    texts = []
    for i in range(120):
        w = words(rng, rng.randrange(0, 60), 50)
        if i % 3 == 0:
            p = (items[rng.choice([1, 2, 3, 4, 7])]).upper().split()
            k = rng.randrange(0, len(w) + 1)
            w[k:k] = [x + rng.choice(["", ",", "!!", "\n", " |"]) for x in p]
        texts.append((i, "«" * (i % 2) + " ".join(w)))
    texts += [(900, None), (901, ""), (902, "...")]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    out = decontamination.decontaminate(docs_of(spark, texts), bench, max_set_words=slices, count_column="flagged")
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == brute_decontaminate(texts, items)
    assert all(r.n_chars == len(r.text or "") for r in out.collect())


def test_texts_without_spaces(spark):
    rng = random.Random(8)
    han, thai = (lambda n: "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n))), (lambda n: "".join(chr(rng.randrange(0x0E01, 0x0E2E)) for _ in range(n)))
    item, other = han(40), thai(60)
    bench = spark.createDataFrame([(1, item), (2, other), (3, "one two three four five six seven eight")], "item_id long, text string")
    a, b, c, d = han(60), han(60), thai(80), thai(80)
    rows = [(1, a + item[5:30] + b), (2, a + item[5:17] + b), (3, c + other[:40] + d), (4, c + other[:20] + d), (5, item), (6, f"{a} One, two three four five six seven EIGHT {b}")]
    got = {r.doc_id: r.text for r in decontamination.decontaminate(docs_of(spark, rows), bench).collect()}
    assert got == {1: a + b, 2: rows[1][1], 3: c + d, 4: rows[3][1], 6: f"{a} {b}"}
    copies = [(10, a + b + han(20)), (11, a + b + han(20)), (12, han(140)), (13, c + d + thai(20)), (14, c + d), (15, thai(150))]
    groups = {r.doc_id: r.group_id for r in chosen_path.near_groups(docs_of(spark, copies)).collect()}
    assert groups == {10: 10, 11: 10, 13: 13, 14: 13}


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    df = spark.createDataFrame([(1, "x a b c d e f g h i y z u v w q r s t", 5), (1, "x a b c d e f g h i y z u v w q r s t", 5), (2, "A-B-C-D-E-F-G-H", 6)], "doc_id long, text string, flags__ int")
    out = decontamination.decontaminate(df, bench, max_set_words=1)
    assert out.columns == df.columns and [r.text for r in out.collect()] == ["x y z u v w q r s t"] * 2
    assert decontamination.decontaminate(df, bench.limit(0)).count() == 3
    long = " ".join(f"w{i}" for i in range(200_000))
    out = decontamination.decontaminate(docs_of(spark, [(1, long + " a b c d e f g h i " + long)]), bench).first()
    assert out.text == long + " " + long and out.n_chars == len(out.text)
    assert decontamination.decontaminate(df.limit(0), bench).count() == 0
