"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is read as words (folded runs of letters, marks and numbers). Each word
enters the network by two inputs: a word vector, looked up by the word's hash,
and a character vector, the sum of the vectors of its character 4- and 6-grams
with word boundaries. The first column of both tables is set, not learned: the word's (or
n-gram's) surplus among toxic texts, counted on the first part of the sample, so that
a word of few examples is not left at its random vector. The other columns of both tables,
the two recurrent directions, the attention and the output
are trained by back-propagation on the second part; the threshold is set on the
third. What the network adds to the counts is measured in the tests: it tells apart
texts of the same words in another order, which no count does.

Windows of `WINDOW` words, one every `STRIDE`, overlap by half and cover the whole text, however
long; every window is scored and the highest score is the text's. A passage of up to
`WINDOW - STRIDE + 1` words is whole in one window. Training is
multiple-instance: of a toxic text only its highest windows are positive, and
they are chosen again in every epoch.

The sample is at most `bound` labelled texts, by hash order of doc_id, and up to `LEAST` more of
either kind if it is rare; it is a parameter and does not grow with the corpus, nor does the broadcast model. The
network is trained in one task.
Scoring is one map over the documents, without a shuffle.

Defined cases: null and empty texts, and texts without words, have no window,
score 0 and are not toxic. Repeated rows are scored alike, each for itself.
Extra columns pass through `drop_toxic`. Without labelled texts of both kinds
nothing can be learned: every score is 0 and nothing is rejected. A score equal to
the threshold is toxic; equal windows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import fit_in_task, labelled_sample, pieces, spare, table
from corvane.llm.textkernel import Scan, mix

WINDOW, STRIDE = 32, 16
WORD_BITS, CHAR_BITS = 18, 18
DW, DC, H, A = 4, 3, 8, 8
GRAMS = (4, 6)
SAMPLE = 8000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def word_inputs(scan: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word slot of each distinct word, index of each word among them, n-gram slots, begin of each distinct word's n-grams).

    A boundary mark before and behind each word counts as a character of its n-grams.
    """
    h, at, inverse = np.unique(scan.word_hashes(), return_index=True, return_inverse=True)
    ws, we = scan.ws[at], scan.we[at]
    slots, owner = [], []
    for n in GRAMS:
        count = np.maximum(we - ws + 2 - n + 1, 0)
        own = np.repeat(np.arange(len(ws)), count)
        lo = ws[own] - 1 + (np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count))
        hi = lo + n
        left, right = lo < ws[own], hi > we[own]
        g = scan.span_hash(np.maximum(lo, ws[own]), np.minimum(hi, we[own]))
        g = mix(g + np.uint64(n) + left.astype(np.uint64) * np.uint64(1 << 20) + right.astype(np.uint64) * np.uint64(1 << 21))
        slots.append((g >> np.uint64(64 - CHAR_BITS)).astype(np.int64))
        owner.append(own)
    owner_all, slot_all = np.concatenate(owner), np.concatenate(slots)
    order = np.argsort(owner_all, kind="stable")
    begin = np.searchsorted(owner_all[order], np.arange(len(ws) + 1))
    return (h >> np.uint64(64 - WORD_BITS)).astype(np.int64), inverse, slot_all[order], begin


def windows(n_words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window; the last one of a text ends with it."""
    count = np.where(n_words > 0, np.maximum(-(-(n_words - WINDOW) // STRIDE), 0) + 1, 0)
    doc = np.repeat(np.arange(len(n_words)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.minimum(k * STRIDE, np.maximum(n_words[doc] - WINDOW, 0))
    return doc, first[doc] + begin, np.minimum(n_words[doc], WINDOW)


@dataclass
class Network:
    words: np.ndarray  # (2**WORD_BITS, DW)
    chars: np.ndarray  # (2**CHAR_BITS, DC)
    p: dict[str, np.ndarray] = field(default_factory=dict)
    threshold: float = 0.5

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        f = lambda *shape, s=0.25: (rng.standard_normal(shape) * s).astype(np.float32)
        p = {}
        for d in "fb":
            p |= {f"W{d}": f(DW + DC, 3 * H), f"U{d}": f(H, 3 * H), f"b{d}": np.zeros(3 * H, np.float32)}
        p |= {"Wa": f(2 * H, A), "ba": np.zeros(A, np.float32), "va": f(A), "Wo": f(2 * H), "bo": np.full(1, -2, np.float32)}
        return cls(f(1 << WORD_BITS, DW, s=0.02), f(1 << CHAR_BITS, DC, s=0.005), p)

    def inputs(self, word_slot: np.ndarray, gram_slot: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The input vector of each distinct word."""
        x = np.zeros((len(word_slot), DW + DC), np.float32)
        x[:, :DW] = self.words[word_slot]
        have = np.flatnonzero(begin[1:] > begin[:-1])
        if len(have):
            x[have, DW:] = np.add.reduceat(self.chars[gram_slot], begin[:-1][have])
        return x

    def _run(self, px: np.ndarray, d: str, live: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (time, window, H) of one direction; px (time, window, 3H) is the projected input."""
        steps, n, _ = px.shape
        U, out, h = self.p[f"U{d}"], np.zeros((steps, n, H), np.float32), np.zeros((n, H), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            r = h @ U
            zr = _sigmoid(px[t, :, : 2 * H] + r[:, : 2 * H])
            z, g = zr[:, :H], zr[:, H:]
            c = np.tanh(px[t, :, 2 * H :] + g * r[:, 2 * H :])
            new = z * h + (1 - z) * c
            if keep is not None:
                keep.append((t, h, z, g, c, r[:, 2 * H :]))
            h = np.where(live[t][:, None], new, h)
            out[t] = h
        return out

    def score(self, x: np.ndarray, at: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Logit of each window; at (time, window) indexes the distinct words x, live marks the words there are."""
        hs = np.concatenate([self._run((x @ self.p[f"W{d}"] + self.p[f"b{d}"])[at], d, live, None) for d in "fb"], axis=2)
        s = np.tanh(hs @ self.p["Wa"] + self.p["ba"]) @ self.p["va"]
        s = np.where(live, s, -1e9)
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        return np.einsum("tn,tnh->nh", a, hs) @ self.p["Wo"] + self.p["bo"]

    def gradients(self, xs: np.ndarray, live: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the weighted log loss for inputs xs (time, window, DW + DC): by parameter, and by input."""
        p, keep = self.p, {"f": [], "b": []}
        hs = np.concatenate([self._run(xs @ p[f"W{d}"] + p[f"b{d}"], d, live, keep[d]) for d in "fb"], axis=2)
        u = np.tanh(hs @ p["Wa"] + p["ba"])
        s = np.where(live, u @ p["va"], -1e9)
        a = np.exp(s - s.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, hs)
        prob = _sigmoid(pooled @ p["Wo"] + p["bo"])
        loss = float(-(weight * (y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).sum() / weight.sum())
        d0 = ((prob - y) * weight / weight.sum()).astype(np.float32)
        g = {"Wo": pooled.T @ d0, "bo": d0.sum(keepdims=True)}
        dp = d0[:, None] * p["Wo"]
        da = np.einsum("tnh,nh->tn", hs, dp)
        ds = a * (da - (a * da).sum(0))
        dhs = a[:, :, None] * dp
        g["va"] = np.einsum("tn,tna->a", ds, u)
        du = ds[:, :, None] * p["va"] * (1 - u * u)
        g["Wa"], g["ba"] = np.einsum("tnh,tna->ha", hs, du), du.sum((0, 1))
        dhs = dhs + du @ p["Wa"].T
        dx = np.zeros_like(xs)
        for d, half in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            U = p[f"U{d}"]
            gU, dpx_all = np.zeros_like(U), np.zeros((*live.shape, 3 * H), np.float32)
            carry = np.zeros((live.shape[1], H), np.float32)
            for t, h, z, gate, c, rc in reversed(keep[d]):
                dh = carry + dhs[t, :, half]
                on = live[t][:, None]
                dn = np.where(on, dh, 0)
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (h - c) * z * (1 - z)
                dg = dc * rc * gate * (1 - gate)
                dr = np.concatenate([dz, dg, dc * gate], axis=1)
                gU += h.T @ dr
                dpx_all[t] = np.concatenate([dz, dg, dc], axis=1)
                carry = np.where(on, dn * z + dr @ U.T, dh)
            g[f"U{d}"], g[f"b{d}"] = gU, dpx_all.sum((0, 1))
            g[f"W{d}"] = np.einsum("tni,tnk->ik", xs, dpx_all)
            dx += dpx_all @ p[f"W{d}"].T
        return g, dx, loss

    def doc_scores(self, texts: pa.Array, per_window: bool = False):
        """(score of each text, windows of each text), or the scan's windows with their logits."""
        scan = Scan(texts)
        doc, begin, size = windows(scan.n_words, scan.first)
        logit = np.zeros(len(doc), np.float32)
        if len(doc):
            word_slot, inverse, gram_slot, gram_begin = word_inputs(scan)
            x = self.inputs(word_slot, gram_slot, gram_begin)
            by_size = np.argsort(size, kind="stable")  # short texts are not padded to long ones
            for lo in range(0, len(doc), 2048):
                at = by_size[lo : lo + 2048]
                b, s = begin[at], size[at]
                steps = np.arange(int(s.max()))[:, None]
                live = steps < s
                logit[at] = self.score(x, inverse[np.where(live, b + steps, b)], live)
        if per_window:
            return scan, doc, begin, size, logit
        have = np.flatnonzero(scan.n_words > 0)
        out = np.zeros(scan.n_docs)
        if len(have):
            out[have] = _sigmoid(np.maximum.reduceat(logit, np.searchsorted(doc, have)))
        return out, np.bincount(doc, minlength=scan.n_docs)


def in_chunks(texts: list[str], budget: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of about `budget` characters each."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= budget):
            size += len(texts[hi])
            hi += 1
        yield lo, texts[lo:hi]
        lo = hi


def _flat(begin: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the list, index into items) of the ragged lists begin[i]..begin[i + 1] of the items asked for."""
    n = begin[items + 1] - begin[items]
    own = np.repeat(np.arange(len(items)), n)
    return own, begin[items][own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)


class _Surplus:
    """For each slot, how far its number of toxic texts is above chance, in standard errors less three, halved, 0 to 3."""

    def __init__(self, size: int) -> None:
        self.size, self.n, self.pos = size, np.zeros(size), np.zeros(size)

    def add(self, slots: np.ndarray, docs: np.ndarray, y: np.ndarray) -> None:
        pair = np.unique(docs.astype(np.int64) * self.size + slots)
        slot, toxic = pair % self.size, y[pair // self.size] > 0
        self.n += np.bincount(slot, minlength=self.size)
        self.pos += np.bincount(slot[toxic], minlength=self.size)

    def value(self, rate: float) -> np.ndarray:
        z = (self.pos - self.n * rate) / np.sqrt(self.n * rate * (1 - rate) + 1e-6)
        return np.clip(np.where(self.pos >= 2, (z - 3) / 2, 0), 0, 3).astype(np.float32)


def _choose(net: Network, texts: list[str], truth: np.ndarray, rng: np.random.Generator, by_network: bool) -> dict[str, np.ndarray] | None:
    """The windows of one chunk to train on: the highest of a toxic text, the three highest of another, and some at random.

    Returned with the slots of their words and of these words' n-grams, so that nothing else of the chunk is kept.
    """
    scan = Scan(pa.array(texts, pa.string()))
    doc, begin, size = windows(scan.n_words, scan.first)
    if not len(doc):
        return None
    word_slot, inverse, gram_slot, gram_begin = word_inputs(scan)
    x = net.inputs(word_slot, gram_slot, gram_begin)
    steps = np.arange(WINDOW)[:, None]
    if by_network:
        order = np.zeros(len(doc), np.float32)
        for lo in range(0, len(doc), 4096):
            b, s = begin[lo : lo + 4096], size[lo : lo + 4096]
            live = steps < s
            order[lo : lo + 4096] = net.score(x, inverse[np.where(live, b + steps, b)], live)
    else:
        cum = np.concatenate([[0], np.cumsum((x[:, 0] + x[:, DW])[inverse])])
        order = cum[begin + size] - cum[begin]
    rank = np.lexsort((-order, doc))
    nth = np.arange(len(doc)) - np.searchsorted(doc, np.arange(scan.n_docs))[doc]
    top = rank[(nth == 0) | ((nth < 3) & (truth[doc] == 0))]
    extra = rng.choice(len(doc), min(len(doc), len(top) // 2), replace=False)
    chosen = np.unique(np.concatenate([top, extra[truth[doc[extra]] == 0]]))
    live = steps < size[chosen]
    used, at = np.unique(inverse[np.where(live, begin[chosen] + steps, begin[chosen])], return_inverse=True)
    _, grams = _flat(gram_begin, used)
    return {"at": at.reshape(live.shape), "live": live, "y": truth[doc[chosen]], "word": word_slot[used], "gram": gram_slot[grams], "grams": np.diff(gram_begin)[used]}


def train(sample: list[tuple[str, int]], *, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network | None:
    """The network fitted to (text, 0 or 1) rows; None if there are not two of each kind."""
    y = np.array([b for _, b in sample], np.float32)
    if (y > 0).sum() < 2 or (y == 0).sum() < 2:
        return None
    rng = np.random.default_rng(seed)
    net = Network.fresh(seed)
    # parts in turn within each class, so that each part holds both: counts, counts, network, network, threshold
    part = np.zeros(len(y), int)
    for c in (0, 1):
        part[y == c] = np.arange((y == c).sum()) % 5
    of = lambda which: [sample[i][0] for i in which]

    counted = np.flatnonzero(part < 2)
    words, chars = _Surplus(1 << WORD_BITS), _Surplus(1 << CHAR_BITS)
    for lo, texts in in_chunks(of(counted)):
        scan = Scan(pa.array(texts, pa.string()))
        if not len(scan.ws):
            continue
        word_slot, inverse, gram_slot, begin = word_inputs(scan)
        yy = y[counted[lo : lo + len(texts)]]
        words.add(word_slot[inverse], scan.doc, yy)
        # each distinct word of a text once, then its n-grams
        pair = np.unique(scan.doc * len(word_slot) + inverse)
        own, at = _flat(begin, pair % len(word_slot))
        chars.add(gram_slot[at], (pair // len(word_slot))[own], yy)
    net.words[:, 0], net.chars[:, 0] = words.value(float(y[counted].mean())), chars.value(float(y[counted].mean()))

    own = np.flatnonzero((part == 2) | (part == 3))
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    sq, sq_char = np.full(len(net.words), 1e-4, np.float32), np.full(len(net.chars), 1e-4, np.float32)
    step = 0
    for epoch in range(epochs):
        found = [f for lo, texts in in_chunks(of(own)) if (f := _choose(net, texts, y[own[lo : lo + len(texts)]], rng, epoch > 0))]
        if not found:
            return None
        shift = np.cumsum([0, *[len(f["word"]) for f in found]])
        at = np.concatenate([f["at"] + k for f, k in zip(found, shift, strict=False)], axis=1)
        live, truth = np.concatenate([f["live"] for f in found], axis=1), np.concatenate([f["y"] for f in found])
        word, gram = np.concatenate([f["word"] for f in found]), np.concatenate([f["gram"] for f in found])
        gram_begin = np.append(0, np.cumsum(np.concatenate([f["grams"] for f in found])))
        chosen = rng.permutation(len(truth))
        for lo in range(0, len(chosen), batch):
            w = chosen[lo : lo + batch]
            a, on, t = at[:, w], live[:, w], truth[w]
            used, place = np.unique(a, return_inverse=True)
            owner, flat = _flat(gram_begin, used)
            char = np.zeros((len(used), DC), np.float32)
            np.add.at(char, owner, net.chars[gram[flat]])
            place = place.reshape(a.shape)
            xs = np.concatenate([net.words[word[a]], char[place]], axis=2)
            g, dx, _ = net.gradients(xs, on, t, np.where(t > 0, 3.0, 1.0).astype(np.float32))
            step += 1
            for k, v in g.items():
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                net.p[k] = (net.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
            # word vectors: adaptive steps of the columns behind the counted one
            gw, slots = dx[on][:, 1:DW], word[a[on]]
            np.add.at(sq, slots, (gw * gw).sum(1))
            np.add.at(net.words[:, 1:], slots, -0.05 * gw / np.sqrt(sq[slots])[:, None])
            # and of the n-grams: each gets the gradient of the words it stands in
            gc = np.zeros((len(used), DC - 1), np.float32)
            np.add.at(gc, place[on], dx[on][:, DW + 1 :])
            slots, gc = gram[flat], gc[owner]
            np.add.at(sq_char, slots, (gc * gc).sum(1))
            np.add.at(net.chars[:, 1:], slots, -0.02 * gc / np.sqrt(sq_char[slots])[:, None])

    # the threshold: amid the widest gap that keeps the most right on the third part (the second, if there is none)
    held = np.flatnonzero(part == 4)
    if not (y[held] > 0).any():
        held = own
    s = np.concatenate([net.doc_scores(pa.array(texts, pa.string()))[0] for _, texts in in_chunks(of(held))])
    net.threshold = best_threshold(s, y[held])
    return net


def best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The cut with the fewest errors, a false alarm counting double; amid the widest such gap of log odds."""
    s = np.clip(scores, 1e-6, 1 - 1e-6)
    logit = np.log(s / (1 - s))
    order = np.argsort(logit)
    v, t = logit[order], y[order] > 0
    edges = np.concatenate([[v[0] - 1], (v[1:] + v[:-1]) / 2, [v[-1] + 1]])
    missed = np.concatenate([[0], np.cumsum(t)])
    alarms = (~t).sum() - np.concatenate([[0], np.cumsum(~t)])
    cost = missed + 2.0 * alarms
    gap = np.concatenate([[0], np.diff(v), [0]])
    best = np.lexsort((-gap, cost))[0]
    return float(1 / (1 + np.exp(-edges[best])))


def fit(docs: DataFrame, labels: DataFrame, *, bound: int = SAMPLE, text: str = "text") -> Network | None:
    return fit_in_task(labelled_sample(docs, labels, "toxic", bound, text), train)


def score_documents(docs: DataFrame, net: Network | None, *, text: str = "text", names: tuple[str, str, str] = ("toxicity", "n_windows", "toxic")) -> DataFrame:
    """docs with the highest window's score, the number of windows, and the verdict."""
    base = [f.name for f in docs.schema]
    names = tuple(spare(base, n) for n in names)
    if net is None:
        return docs.select("*", F.lit(0.0).alias(names[0]), F.lit(0).cast("long").alias(names[1]), F.lit(False).alias(names[2]))
    model = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([*docs.schema, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.BooleanType())])
    at = base.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            score, count = model.value.doc_scores(batch.column(at))
            extra = [pa.array(np.round(score, 6)), pa.array(count.astype(np.int64)), pa.array((score >= model.value.threshold) & (count > 0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*base, *names])

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without those that the network rejects."""
    scored = score_documents(docs, fit(docs, labels, **options), text=options.get("text", "text"))
    return scored.where(~F.col(scored.columns[-1])).select(*[scored.columns[i] for i in range(len(docs.columns))])


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score, number of windows and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "toxicity", "n_windows", "toxic")
