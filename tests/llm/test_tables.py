"""Mixing, HTML differencing, chat snapshots, revisits and the metric join against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from corvane.llm import chat, html_diff, metric_join, mixing, revisit

# --- mixing


def brute_mix(rows, schedule, budget=None):
    """Positions by numeric integration and bisection, from (doc_id, text, source)."""
    rows = [(i, len((t or "").split()), s) for i, t, s in rows]
    rows = [r for r in rows if r[1]]
    sources = sorted({s for _, _, s in rows}, key=str)
    total = budget if budget is not None else sum(n for _, n, _ in rows)

    def share(s, t):
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
            if t0 <= t <= t1:
                def at(w):
                    v = {x: w.get(x, w.get("*", 0.0)) for x in sources}
                    return v[s] / sum(v.values()) if sum(v.values()) else 0.0
                return at(w0) + (at(w1) - at(w0)) * (t - t0) / (t1 - t0)

    grid = np.linspace(0, 1, 20001)
    out = {}
    for s in sources:
        p = np.array([share(s, t) for t in grid])
        cum = np.concatenate([[0], np.cumsum((p[1:] + p[:-1]) / 2 * np.diff(grid))]) * total
        mine = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, n) for i, n, x in rows if x == s)
        supply, done = sum(n for _, _, n in mine), 0
        for _, i, n in mine:
            mid = done + n / 2
            done += n
            epoch = 0
            while cum[-1] > 0 and mid + epoch * supply < cum[-1]:
                out[i, epoch] = float(np.interp(mid + epoch * supply, cum, grid))
                epoch += 1
    return out


@pytest.mark.parametrize("budget", [None, 9000])
def test_mixing_against_brute_force(spark, budget):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice("aaaab" + "c")) for i in range(300)] + [(400, None, "a"), (401, "  ", "b")]
    schedule = [(0.0, {"a": 1.0, "*": 2.0}), (0.5, {"a": 3.0, "c": 0.0, "*": 1.0}), (1.0, {"a": 1.0, "*": 1.0})]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, schedule, budget=budget)
    assert got.columns == ["doc_id", "text", "source", "n_tokens", "epoch", "position"]
    have = {(r.doc_id, r.epoch): r.position for r in got.collect()}
    want = brute_mix(rows, schedule, budget)
    assert abs(len(set(have) ^ set(want))) <= 1
    assert all(have[k] == pytest.approx(want[k], abs=1e-3) for k in set(have) & set(want))
    order = [r.position for r in got.collect()]
    assert order == sorted(order)


def test_mixing_edges(spark):
    schedule = [(0.0, {"": 1.0, "x": 1.0}), (1.0, {"": 1.0, "x": 1.0})]
    df = spark.createDataFrame([(1, "a b", None, 1, 1), (1, "a b", None, 1, 1), (2, "c d", "x", 2, 2), (3, "e f", "left out", 3, 3), (None, "g h", "x", 4, 4)], "doc_id long, text string, source string, supply int, N_TOKENS int")
    out = mixing.mix_sources(df, schedule).collect()
    assert sorted((str(r.doc_id) for r in out), key=str).count("1") >= 2 and all(r.source != "left out" for r in out)
    assert len({r.position for r in out if r.doc_id == 1 and r.epoch == 0}) == 2  # repeated rows have places of their own
    assert mixing.mix_sources(df.limit(0), schedule).count() == 0
    long = spark.createDataFrame([(1, "w " * 300_000, "x", 0.5, 1), (None, "a", "x", 0.5, 1), (None, "b", "x", 0.5, 1)], "doc_id long, text string, source string, position double, epoch int")
    out = mixing.mix_sources(long, schedule).collect()
    assert [r[5] for r in out if r[0] == 1 and r[6] == 0] == [300_000] and len(out) >= 3 and out[0][3] == 0.5
    with pytest.raises(ValueError):
        mixing.shares([(0.0, {}), (0.5, {})], ["a"])


# --- HTML


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def is_subsequence(x, y):
    it = iter(y)
    return all(c in it for c in x)


def test_common_lines_are_longest():
    rng = random.Random(4)
    for _ in range(400):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(14))], [rng.randrange(6) for _ in range(rng.randrange(14))]
        shared = [x for x, s in zip(a, html_diff.common_lines(a, b)) if s]
        assert len(shared) == lcs(a, b) and is_subsequence(shared, b)


def test_text_lines():
    page = "<!DOCTYPE html><head><title>t</title></head><body><script>var a='<p>x</p>'</script><nav><a href=/x>Home</a> &amp; <b>more</b></nav><!-- <p>no</p> --><p>One<br>two  &lt;3</p><p></p>tail"
    assert html_diff.text_lines(page) == ["Home & more", "One", "two <3", "tail"]
    assert html_diff.text_lines(None) == [] == html_diff.text_lines("")
    assert len(html_diff.text_lines("<p>x</p>" * 50000)) == 50000


def test_text_lines_of_unclosed_heads():
    for own in ("<body><p>Own text", "<p>Own text", "<body class='a'><p>Own text</p></body>", "Own text"):
        for head in ("<title>t</title>", "<meta charset=utf-8><title>t</title><style>p {}</style>\n<!-- c --><script>'<body>'</script>", "<noscript><link href=x></noscript>", ""):
            assert html_diff.text_lines(f"<html><head>{head}{own}") == ["Own text"]
            assert html_diff.text_lines(f"<html><head>{head}</head>{own}") == ["Own text"]
    assert html_diff.text_lines("<head><title>t</title><x>in the head</x></head><body><p>Own text") == ["Own text"]
    assert html_diff.text_lines("<body><p>a</p><noscript><p>Own text") == ["a", "Own text"]
    assert html_diff.text_lines("<body><noscript>n</noscript><p>Own text<script>s") == ["Own text"]
    assert html_diff.text_lines("<head><noscript><title>" * 20000 + "</noscript>") == []
    assert html_diff.text_lines("<header><p>Own text</header>") == ["Own text"]


def brute_pages(pages):
    import re

    keyed, paths = [], {}
    for i, url, page in pages:
        m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)(.*)$", url or "", re.S)
        keyed.append((m[1].lower() if m else "", m[2] if m else (url or ""), i, html_diff.text_lines(page)))
    for host, path, i, lines in keyed:
        if lines:
            rank = (i is not None, i, html_diff._digest(lines))
            paths[host, path] = min(paths.get((host, path), (rank, lines)), (rank, lines))

    def prefix(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    out = {}
    for host, path, i, lines in keyed:
        others = [(p, x) for (h, p), x in paths.items() if lines and h == host and x[1] != lines]
        before = max((o for o in others if o[0] < path), default=None)
        behind = min((o for o in others if o[0] > path), default=None)
        p, q = (prefix(path, x[0]) if x else -1 for x in (before, behind))
        other = before if p >= q else behind
        n = lcs(lines, other[1][1]) if other else 0
        out.setdefault(i, set()).add((other[1][0][1] if other else None, len(lines), n))
    return out


@pytest.mark.parametrize("ranges", [None, 9])
def test_pages_against_brute_force(spark, ranges):
    rng = random.Random(7)
    pages = []
    for i in range(160):
        host = rng.choice(["a.example", "A.example", "b.example", "c.example"])
        body = "".join(f"<p>{rng.choice(['menu', 'login', 'imprint'])}</p>" for _ in range(3)) + f"<p>own {i}</p><p>foot {host.lower()}</p>"
        pages.append((i, f"http://{host}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(99)}", body))
    pages += [(200 + i, p[1] + rng.choice(["", "?s=1", "/"]), p[2]) for i, p in enumerate(pages[:70])]  # captured again, and mirrored
    pages += [(300 + i, pages[5][1] + f"/x{i % 9}", pages[5][2]) for i in range(40)]  # runs of equal pages across ranges
    pages += [(400 + i, f"http://c.example/en/gone{i}", "") for i in range(12)]
    pages += [(900, None, "<p>x</p>"), (901, "no url", None), (902, "http://alone.example/", "<p>all</p><p>kept</p>"), (903, "http://b.example", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = html_diff.difference_pages(df, ranges=ranges).collect()
    assert len(got) == len(pages)
    assert {r.page_id: {(r.neighbour_id, r.n_lines, r.n_shared)} for r in got} == brute_pages(pages)
    text = {r.page_id: r.text for r in got}
    assert text[902] == "all\nkept" and text[901] == "" and all(f"own {i}" in text[i] for i in range(160))
    assert all("own 5" in text[i] for i in range(300, 340)) and all(f"own {i}" in text[200 + i] for i in range(70))


def test_repeated_pages_and_empty_table(spark):
    twice = [(1, "http://h/a", "<p>x</p><p>menu</p>", 1)] * 2 + [(None, "http://h/b", "<p>y</p><p>menu</p>", 2)]
    df = spark.createDataFrame(twice, "page_id long, url string, html string, host int").toDF("page_id", "url", "html", "lines")
    assert sorted(r.text for r in html_diff.difference_pages(df).collect()) == ["x", "x", "y"]
    assert html_diff.difference_pages(df.limit(0)).count() == 0
    none = spark.createDataFrame([(1, "http://h/a", None), (2, "http://h/b", "")], "page_id long, url string, html string")
    assert [(r.text, r.n_lines) for r in html_diff.difference_pages(none).collect()] == [("", 0)] * 2


def test_tags_with_quoted_marks():
    assert html_diff.text_lines("<p title='a > b' data-x=\"1>0\">Own <a href=x title=\"->\">text</a></p><p class=\"open>next</p>") == ["Own text", "next"]
    assert html_diff.text_lines("<script data-a='>'>var p = 1</script><div id='>'>One</div>") == ["One"]
    assert html_diff.text_lines("<a \"" * 3000 + ">x")[-1:] == ["x"]


# --- chat


def test_snapshots_against_brute_force(spark):
    rng = random.Random(9)
    talks, rows = [], []
    for _ in range(60):
        base = rng.choice(talks)[: rng.randrange(1, 6)] if talks and rng.random() < 0.7 else []
        talks.append(base + [(rng.choice(["user", "assistant"]), f"t{rng.randrange(4)}") for _ in range(rng.randrange(0 if base else 1, 3))])
    for i, t in enumerate(talks):
        rows += [(i, k, r, x) for k, (r, x) in enumerate(t)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + rows[:7], "conv_id long, turn long, role string, text string")
    want = {i for i, t in enumerate(talks) if not any(u[: len(t)] == t and (len(u) > len(t) or j < i) for j, u in enumerate(talks) if j != i)}
    got = chat.maximal_conversations(df).collect()
    assert {r.conv_id for r in got} == want
    assert all(r.rendered == "".join(f"<|{a}|>\n{b}<|end|>\n" for a, b in talks[r.conv_id]) and r.n_turns == len(talks[r.conv_id]) for r in got)


def test_snapshot_edges(spark):
    long = "x" * 200_000
    rows = [(1, 0, None, None, 1), (2, 0, "user", "", 1), (2, 1, "assistant", long, 1), (None, 0, "user", "a", 1), (3, 0, "usera", "b", 1), (4, 0, "user", "ab", 1), (5, 0, "user", "ab", 1), (6, 1, "user", "q", 1), (6, 1, "assistant", "q", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, h int")
    got = {r.conv_id: r.rendered for r in chat.maximal_conversations(df).collect()}
    assert set(got) == {2, 3, 4, 6} and got[6].startswith("<|assistant|>")
    assert chat.maximal_conversations(df.limit(0)).count() == 0


# --- revisits

REC = "record_id long, url string, ts long, status int, headers map<string,string>, digest string, payload string"


def test_revisits_against_brute_force(spark):
    rng = random.Random(11)
    recs = []
    for i in range(300):
        status = rng.choice([200, 304, 404, 206, 204, 304, 203])
        h = {}
        if rng.random() < 0.7:
            h["ETag"] = rng.choice(['"a"', 'W/"a"', '"b"'])
        if rng.random() < 0.6:
            h[rng.choice(["Last-Modified", "last-modified"])] = rng.choice(["mon", "tue"])
        h |= {"Content-Length": str(i), "X-Id": str(i)} if rng.random() < 0.9 else {}
        recs.append((i, rng.choice(["http://www.a.example/x", "https://A.example:443/x/#f", "http://b.example/?b=2&a=1&utm_source=z", "http://b.example?a=1&b=2"]), rng.randrange(60), status, h, rng.choice([None, "d1", "d2"]), f"body{i}" if status != 304 else None))
    canon = lambda u: "a.example/x" if "xample/x" in u or ":443" in u else "b.example?a=1&b=2"
    want = {}
    for i, u, ts, st, h, d, _ in recs:
        if st != 304:
            continue
        earlier = [r for r in recs if r[3] in (200, 203) and canon(r[1]) == canon(u) and r[2] <= ts]
        if not earlier:
            want[i] = (None, "orphan", None)
            continue
        b = max(earlier, key=lambda r: (r[2], r[0]))
        low, base = {k.lower(): v for k, v in h.items()}, {k.lower(): v for k, v in b[4].items()}
        if "etag" in low and "etag" in base:
            ok = low["etag"].removeprefix("W/") == base["etag"].removeprefix("W/")
        elif d and b[5]:
            ok = d == b[5]
        elif "last-modified" in low and "last-modified" in base:
            ok = low["last-modified"] == base["last-modified"]
        else:
            ok = None
        merged = base | {k: v for k, v in low.items() if k not in revisit.FIXED_HEADERS}
        text = "\n".join(f"{k}: {merged[k]}" for k in sorted(merged))
        want[i] = (b[0], {True: "resolved", False: "changed", None: "unvalidated"}[ok], None if ok is False else (text, b[6]))
    got = revisit.resolve_revisits(spark.createDataFrame(recs, REC)).collect()
    assert {r.record_id: (r.response_id, r.state, (r.headers, r.payload) if r.payload is not None else None) for r in got} == want


def test_revisit_edges(spark):
    recs = [(1, None, 1, 304, None, None, None), (2, "http://a/", None, 304, {"a": None}, None, None), (3, "http://a/", 5, 304, None, None, None), (4, "http://a", 5, 200, None, None, "x"), (4, "http://a", 5, 200, None, None, "y"), (5, "", 1, 200, {}, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in recs], REC + ", canonical int")
    got = {r.record_id: (r.state, r.payload) for r in revisit.resolve_revisits(df).collect()}
    assert got == {1: ("orphan", None), 2: ("orphan", None), 3: ("unvalidated", "y")}
    assert revisit.resolve_revisits(df.limit(0)).count() == 0


def test_revisit_headers_payloads_and_parameters(spark):
    long = "x" * 3_000_000
    recs = [
        (1, "http://a/?ref=1", 1, 200, {"ETag": '"old"', "etag": '"new"', "X": "1"}, None, long), (2, "http://a/?ref=1", 2, 206, {"ETag": '"new"'}, None, "PART"),
        (3, "http://a/?ref=1&utm_source=m", 3, 304, {"ETAG": '"new"', "etag": '"new"', "x": "2"}, None, None), (4, "http://a/?ref=2", 3, 304, None, None, None),
        (5, "http://b", 1, 203, None, None, ""), (6, "http://b", 2, 304, None, None, None), (7, "http://b/?id=1", 1, 200, None, None, "id"), (8, "http://b", 9, 304, None, None, None),
    ]
    df = spark.createDataFrame(recs, REC)
    got = {r.record_id: (r.state, r.headers, r.payload) for r in revisit.resolve_revisits(df).collect()}
    assert got == {3: ("resolved", 'etag: "new"\nx: 2', long), 4: ("orphan", None, None), 6: ("unvalidated", "", ""), 8: ("unvalidated", "", "")}
    loose = {r.record_id: r.response_id for r in revisit.resolve_revisits(df, tracking="ref|id|utm_[a-z]+").collect()}
    assert loose == {3: 1, 4: 1, 6: 7, 8: 7}


# --- metric join


def brute_classes(rows, threshold):
    """id -> (class, links), and the ids of pairs too near the threshold to tell."""
    good = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float32)
        good[i] = min(good.get(i, (1 << 30, b"")), (len(x), x.tobytes()))
    unit = {i: (lambda x: x / np.linalg.norm(x))(np.frombuffer(b, np.float32).astype(float)) for i, (_, b) in good.items()}
    links, root, ids = dict.fromkeys(unit, 0), {i: i for i in unit}, sorted(unit)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if len(unit[i]) == len(unit[j]) and (good[i] == good[j] or unit[i] @ unit[j] >= threshold):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize(("threshold", "pivots", "block"), [(0.95, None, 4096), (0.8, 7, 16), (0.5, 20, 40), (-1.0, 3, 50), (0.99, 1, 10)])
def test_range_join_against_brute_force(spark, threshold, pivots, block):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 8))
    rows = [(int(i), (centres[i % 12] + rng.standard_normal(8) * [0.02, 0.2, 0.6][i % 3]).astype(np.float32).tolist()) for i in range(240)]
    rows += [(500 + i, rows[3][1]) for i in range(30)]  # a dense cell of copies
    rows += [(3, rows[4][1]), (None, rows[0][1]), (600, None), (601, []), (602, [0.0] * 8), (603, [float("nan")] * 8), (604, [1.0, 2.0]), (605, [2.0, 4.0]), (606, [1e30] * 8), (607, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.class_id, r.n_links) for r in metric_join.vector_classes(df, threshold=threshold, n_pivots=pivots, block=block).collect()}
    assert got == brute_classes(rows, threshold)


def test_range_join_edges(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, cell int")
    assert metric_join.vector_classes(df).count() == 0
    with pytest.raises(ValueError):
        metric_join.vector_classes(df, threshold=2.0)
    # at exactly the threshold; repeated rows; 3,000 dimensions; an id of two dimensions
    wide = [float(i % 7 + 1) for i in range(3000)]
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (2, [3.0, 4.0]), (3, [0.0, -1.0]), (4, wide), (5, wide[:-1] + [2.5]), (4, [0.0, -1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, h int, w int")
    got = {r.vec_id: (r.class_id, r.n_links) for r in metric_join.vector_classes(df, threshold=0.6).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1), 5: (5, 0)}


def test_boundary_replication_prunes(spark):
    """Copies go only where a partner may live: far clusters are not copied."""
    rows = [(i, ([1.0, 0.001 * i] if i < 50 else [0.001 * i, 1.0])) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.class_id, r.n_links) for r in metric_join.vector_classes(df, threshold=0.999, n_pivots=2).collect()}
    assert got == brute_classes(rows, 0.999)
