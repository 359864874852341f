"""Secrets: fixed patterns, and a character convolutional network over every further candidate.

The network learns from labelled findings of its own (``examples``): keys of many makers' formats, and hashes,
paths, names, numbers and encoded images that look like them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quire.llm.examples import carriers, secret_table
from quire.llm.spans import Span, apart, scan
from quire.llm.tables import table

KINDS = ("assign", "access", "hex")
# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=@-]{8,}")
LONG_WORD = 20
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
BESIDE, INSIDE = 24, 48
SIGNS = "+/_=-.:,;\"'()<>@#$%&*![]{}|\\?~^`"


def base_spans(text: str) -> list[Span]:
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [Span("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def by_start(span: Span) -> tuple:
    return span.start, KINDS.index(span.kind) if span.kind in KINDS else len(KINDS), span.end


def candidates(text: str) -> list[Span]:
    """Every run of letters, digits and ``+/_.=@-`` that holds a digit, of 8 or more characters if it holds a letter
    too and of 12 or more if not, or that is LONG_WORD long. Shorter runs and short runs without a digit are none."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if len(run) >= LONG_WORD or DIGIT.search(run) and (len(run) >= 12 or LETTER.search(run)):
            out.append(Span("cnn", *m.span()))
    return out


# Character classes: 1 white space, 2 other, 3.. digits, letters by case, then signs one by one.
CLASSES = np.full(128, 2, dtype=np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = 1
CLASSES[48:58] = 3
CLASSES[97:103], CLASSES[103:123] = 4, 5
CLASSES[65:71], CLASSES[71:91] = 6, 7
for _i, _c in enumerate(SIGNS):
    CLASSES[ord(_c)] = 8 + _i
N_CLASSES = 8 + len(SIGNS)


def windows(span: Span) -> list[Span]:
    """Windows of INSIDE characters, each half over the next, that cover a candidate; a short one is its own."""
    last = span.end - INSIDE
    if last <= span.start:
        return [span]
    return [Span(span.kind, at, at + INSIDE) for at in [*range(span.start, last, INSIDE // 2), last]]


def encode(text: str, span: Span) -> np.ndarray:
    """Classes of the characters before, in (at most INSIDE) and after a candidate's window."""
    run = text[span.start : span.end]
    parts = text[max(0, span.start - BESIDE) : span.start].rjust(BESIDE, "\n"), run.ljust(INSIDE, "\n"), text[span.end : span.end + BESIDE].ljust(BESIDE, "\n")
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
    return np.where(codes < 128, CLASSES[np.minimum(codes, 127)], 2).astype(np.uint8)


@dataclass
class Network:
    """Embedding, one convolution, the largest and mean answer of each filter inside and beside, a logistic unit."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    precision: float | None = None
    recall: float | None = None

    @classmethod
    def new(cls, seed: int, width: int = 5, size: int = 8, filters: int = 16) -> Network:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (N_CLASSES, size)), rng.normal(0, 0.2, (width * size, filters)), np.zeros(filters), np.zeros(3 * filters + 1))

    def forward(self, codes: np.ndarray) -> tuple:
        width = len(self.conv) // self.embed.shape[1]
        x = self.embed[codes]
        wide = np.lib.stride_tricks.sliding_window_view(x, width, axis=1).transpose(0, 1, 3, 2).reshape(len(codes), -1, len(self.conv))
        z = np.maximum(wide @ self.conv + self.bias, 0)
        a, b = BESIDE, BESIDE + INSIDE - width + 1
        inner = z[:, a:b]
        outer = np.concatenate([z[:, :a], z[:, b:]], 1)
        pooled = np.concatenate([inner.max(1), inner.mean(1), outer.max(1), np.ones((len(codes), 1))], 1)
        return wide, z, inner, outer, pooled, pooled @ self.out

    def probability(self, codes: np.ndarray, batch: int = 512) -> np.ndarray:
        """Calibrated probability that each candidate is a secret."""
        logits = np.concatenate([self.forward(codes[i : i + batch])[-1] for i in range(0, len(codes), batch)])
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))

    def learn(self, codes: np.ndarray, gold: np.ndarray, weight: np.ndarray, rate: float) -> None:
        wide, z, inner, outer, pooled, logit = self.forward(codes)
        err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - gold) * weight / len(codes)
        n, filters = len(codes), len(self.bias)
        back = err[:, None] * self.out
        dz = np.zeros_like(z)
        a, b = BESIDE, BESIDE + inner.shape[1]
        rows, cols = np.arange(n)[:, None], np.arange(filters)[None]
        dz[rows, a + inner.argmax(1), cols] += back[:, :filters]
        dz[:, a:b] += back[:, None, filters : 2 * filters] / inner.shape[1]
        at = outer.argmax(1)
        dz[rows, np.where(at < a, at, at + inner.shape[1]), cols] += back[:, 2 * filters : 3 * filters]
        dz *= z > 0
        dwide = dz @ self.conv.T
        size = self.embed.shape[1]
        dx = np.zeros((n, codes.shape[1], size))
        for j in range(len(self.conv) // size):
            dx[:, j : j + z.shape[1]] += dwide[:, :, j * size : (j + 1) * size]
        grad_embed = np.stack([np.bincount(codes.ravel(), dx[:, :, j].ravel(), N_CLASSES) for j in range(size)], 1)
        self.out -= rate * (pooled.T @ err + 1e-4 * self.out)
        self.conv -= rate * (wide.reshape(-1, wide.shape[2]).T @ dz.reshape(-1, filters) + 1e-4 * self.conv)
        self.bias -= rate * dz.sum((0, 1))
        self.embed -= rate * grad_embed


def train_network(codes: np.ndarray, gold: np.ndarray, recall: float = 0.95, epochs: int = 24, seed: int = 5) -> Network | None:
    """Fit on two thirds of the labelled candidates; on the rest, calibrate the probabilities (Platt) and set
    the highest threshold that still recalls ``recall`` of the secrets, with the precision and recall there.
    None without both kinds of candidate."""
    if gold.sum() < 5 or (1 - gold).sum() < 5:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(codes))
    rest, fit = order[: len(order) // 3], order[len(order) // 3 :]
    net = Network.new(seed)
    balance = np.where(gold == 1, 0.5 / max(gold[fit].mean(), 0.02), 0.5 / max(1 - gold[fit].mean(), 0.02))
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            net.learn(codes[part], gold[part], balance[part], 0.5 / (1 + 0.05 * epoch))
    logits = net.forward(codes[rest])[-1]
    scale, shift = 1.0, 0.0
    target = np.where(gold[rest] == 1, (gold[rest].sum() + 1) / (gold[rest].sum() + 2), 1 / ((1 - gold[rest]).sum() + 2))
    for _ in range(300):
        err = 1 / (1 + np.exp(-np.clip(scale * logits + shift, -30, 30))) - target
        scale -= 0.05 * float((err * logits).mean())
        shift -= 0.05 * float(err.mean())
    net.scale, net.shift = scale, shift
    likely = net.probability(codes[rest])
    found = np.sort(likely[gold[rest] == 1])
    if len(found):
        net.threshold = float(found[len(found) - int(np.ceil(recall * len(found)))])
        hit = likely >= net.threshold
        net.precision, net.recall = float(gold[rest][hit].mean()), float((found >= net.threshold).mean())
    return net


def labelled_candidates(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Windows of candidates of the labelled table, set into words of ``docs``, and 1 for those of secrets. Of a
    long secret only the first window is labelled, as later ones may look like any encoded text; of other long
    candidates about five. Bounded by ``carriers`` and ``secret_table``."""
    rows, gold = [], []
    for text, [made] in secret_table(carriers(docs)):
        for c in candidates(text):
            inside = c.start < made.end and made.start < c.end
            secret = inside and made.kind == "cnn"
            some = windows(c)
            for w in some[:1] if secret else some[:: max(1, len(some) // 5)]:
                rows.append(encode(text, w))
                gold.append(float(secret))
    codes = np.stack(rows) if rows else np.zeros((0, 2 * BESIDE + INSIDE), dtype=np.uint8)
    _, once = np.unique(codes, axis=0, return_index=True)
    return codes[np.sort(once)], np.array(gold)[np.sort(once)]


def network_finder(net: Network | None):
    def find(texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
        out: list[list[Span]] = [[] for _ in texts]
        if net is None:
            return out
        work = [(d, c) for d, text in enumerate(texts) for c in apart(candidates(text), base[d])]
        parts = ((k, encode(texts[d], w)) for k, (d, c) in enumerate(work) for w in windows(c))
        best = np.zeros(len(work))
        while some := list(islice(parts, 8192)):
            np.maximum.at(best, [k for k, _ in some], net.probability(np.stack([codes for _, codes in some])))
        for (d, c), p in zip(work, best, strict=True):
            if p >= net.threshold:
                out[d].append(c)
        return out

    return find


def find_secrets(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans of every row of ``docs(doc_id, text, ...)``.

    Whole texts: every candidate (``candidates``) that no pattern meets is scored, a long one by the likeliest of
    the windows that cover it. A null text is an empty one: no spans, and the digest of an empty string. Repeated
    rows are scanned each for itself; further columns are ignored; an empty table gives an empty result.
    Without a network (nothing to learn from) only the patterns count. One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    return scan(docs, KINDS, base_spans, lambda: network_finder(sent.value), by_start)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_secrets(docs, train_network(*labelled_candidates(docs)))
