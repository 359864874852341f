"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field learns from a small labelled table of its own (``examples``), with forms that the patterns don't know:
addresses spelled out, national phone numbers, numbers of cards in other groups, defanged and longer hosts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quire.llm.examples import carriers, personal_table
from quire.llm.spans import Span, apart, scan
from quire.llm.tables import table

KINDS = ("email", "ip", "card", "phone")
# The patterns of the contract, with runs made possessive or anchored at a run's
# start, which finds the same matches in linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
#: Digits with single signs between them, as one number; how many digits a card's and a phone's have.
NUMBER = re.compile(r"[0-9](?:[ .,/()-]{0,2}[0-9])*")
CARD_DIGITS, PHONE_DIGITS = range(13, 20), range(7, 16)

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
TRIGGER = re.compile(r"[0-9@]+|\b(?:dot|punkt|point|punto)\b|[(\[]at[)\]]", re.I)
#: Words that the shapes keep as they are.
CUES = frozenset("at dot punkt point punto tel telefon phone call fax mobile mail email card visa carte karte tarjeta ip host server version page seite isbn iso room meet".split())
SURE = 0.7  # least marginal probability of an added span's labels
LONGEST_NUMBER = 64
STRETCH, LAP = 400, 60  # tokens of long windows decoded at once, and how many stand beyond those that count
BATCH_TOKENS, BUFFER_TOKENS = 16_384, 65_536
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def emails(text: str) -> list[Span]:
    """A match starts where the run of local characters before an @ does, or where the last match ended."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append(Span("email", start, match.end()))
            last = match.end()
        at = text.find("@", max(at + 1, last))
    return found


def at_most_255(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    found = emails(text)
    found += [Span("ip", *m.span()) for m in IP.finditer(text) if all(map(at_most_255, m.groups()))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if len(digits) <= 19 and luhn(digits):
            found.append(Span("card", *m.span()))
    if "+" in text:
        found += [Span("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def by_kind(span: Span) -> tuple:
    kind = span.kind.removeprefix("crf_")
    return KINDS.index(kind), span.kind != kind, span.start


# --- the random field -------------------------------------------------------------------------


@dataclass(frozen=True)
class Tokens:
    """Tokens in a row; entities count that begin with one of those from ``first`` to before ``stop``."""

    starts: list[int]
    ends: list[int]
    shapes: list[str]
    first: int
    stop: int


@lru_cache(maxsize=50_000)
def shape(token: str) -> str:
    """Letters by case and length (to 6) or as a cue, digits by length (to 20); other characters stand for themselves."""
    if token.isdigit():
        return f"d{min(len(token), 20)}"
    if token.isalpha():
        if token.lower() in CUES:
            return f"={token.lower()}"
        case = "l" if token.islower() else "u" if token.isupper() else "c" if token[:1].isupper() else "m"
        return f"{case}{min(len(token), 6)}"
    return token if ord(token[0]) < 128 else "?"


def digits_of(piece: str) -> str:
    return NOT_DIGIT.sub("", piece)


def plausible(kind: str, piece: str) -> bool:
    """Has what is called a card a card's digits and check digit, a phone number a phone number's digits, and an
    address in decimals four of them, of 255 at most?"""
    digits = digits_of(piece)
    if kind == "ip" and ":" not in piece:
        parts = re.findall("[0-9]+", piece)
        return len(parts) == 4 and all(map(at_most_255, parts))
    return len(digits) in CARD_DIGITS and luhn(digits) if kind == "card" else len(digits) in PHONE_DIGITS if kind == "phone" else True


def number_mark(number: str) -> str:
    """What a number's digits tell: ``c`` a card's count and check digit, ``w`` a card's count alone, ``p`` a phone number's count."""
    digits = digits_of(number)
    if len(digits) in CARD_DIGITS and (luhn(digits) or len(digits) not in PHONE_DIGITS):
        return "c" if luhn(digits) else "w"
    return "p" if len(digits) in PHONE_DIGITS else "w" if len(digits) > 15 else ""


def stretches(text: str, start: int, end: int) -> Iterator[Tokens]:
    """The tokens from ``start`` to ``end``, STRETCH at a time, each stretch lapping over the next; a shape tells
    if white space stands before, and of digits what the number that they belong to may be (``number_mark``). Of a
    long window no more than a stretch is held."""
    starts, ends, shapes, first = [], [], [], 0
    numbers, number = NUMBER.finditer(text, start, end), None
    for m in TOKEN.finditer(text, start, end):
        if len(starts) == STRETCH:
            yield Tokens(starts, ends, shapes, first, STRETCH - LAP)
            starts, ends, shapes, first = starts[-2 * LAP :], ends[-2 * LAP :], shapes[-2 * LAP :], LAP
        a, b = m.span()
        own = shape(m[0])
        if own[0] == "d":
            while number is None or number[0] <= a:
                found = next(numbers, None)
                number = (found.end(), number_mark(found[0]) if found.end() - found.start() <= LONGEST_NUMBER else "w") if found else (end + 1, "")
            own += number[1]
        shapes.append(("_" if a == 0 or text[a - 1].isspace() else "") + own)
        starts.append(a)
        ends.append(b)
    if starts:
        yield Tokens(starts, ends, shapes, first, len(starts))


def windows(text: str, around: int = 40) -> list[tuple[int, int]]:
    """Stretches around every digit, @, spelled-out dot or bracketed at, from white space to white space, merged where they meet.

    Every form of the labelled table holds one of these, so the field need not look elsewhere.
    """
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        if out and m.end() <= out[-1][1] - around:
            continue
        start, end = max(0, m.start() - around), min(len(text), m.end() + around)
        while start and not text[start - 1].isspace() and m.start() - start < 3 * around:
            start -= 1
        while end < len(text) and not text[end].isspace() and end - m.end() < 3 * around:
            end += 1
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


@lru_cache(maxsize=50_000)
def coarse(word_shape: str) -> str:
    """Without the lengths of letters; digits by whether they are 1 to 3, 4, or more."""
    space, rest = ("_", word_shape[1:]) if len(word_shape) > 1 and word_shape[0] == "_" else ("", word_shape)
    if rest[:1] == "d" and rest[1:].isdigit():
        return space + ("d" if int(rest[1:]) < 4 else "d4" if rest == "d4" else "D")
    return space + (rest[0] if rest[:1].isalpha() else rest)


def features(shapes: list[str]) -> list[tuple[str, ...]]:
    padded = ["<", "<", *shapes, ">", ">"]
    rough = [coarse(s) for s in padded]
    return [
        (f"0{b}", f"-{a}", f"+{c}", f"-2{aa}", f"+2{cc}", f"l{a}|{b}", f"r{b}|{c}", f"w{a}|{b}|{c}", f"L{d[0]}|{d[1]}|{d[2]}", f"R{d[2]}|{d[3]}|{d[4]}", f"V{'|'.join(d)}")
        for aa, a, b, c, cc, d in zip(padded, padded[1:], padded[2:], padded[3:], padded[4:], zip(rough, rough[1:], rough[2:], rough[3:], rough[4:], strict=False), strict=False)
    ]


@dataclass(frozen=True)
class Field:
    """Weights: ``emit[feature, label]`` and ``move[label before, label]``. ``index`` has a row for each feature;
    the last row is zero and stands for all others."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def scores(self, shapes: list[str]) -> np.ndarray:
        get = self.index.get
        return self.emit[[[get(f, -1) for f in fs] for fs in features(shapes)]].sum(1)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def forward_backward(emit: np.ndarray, move: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded sequences [n, t, labels]: label marginals, summed move expectations, log partition."""
    n, t, k = emit.shape
    ahead, back = np.zeros_like(emit), np.zeros_like(emit)
    ahead[:, 0] = emit[:, 0]
    for i in range(1, t):
        new = log_sum(ahead[:, i - 1, :, None] + move, 1) + emit[:, i]
        ahead[:, i] = np.where(mask[:, i, None], new, ahead[:, i - 1])
    for i in range(t - 2, -1, -1):
        new = log_sum(move + (emit[:, i + 1] + back[:, i + 1])[:, None, :], 2)
        back[:, i] = np.where(mask[:, i + 1, None], new, 0)
    total = log_sum(ahead[:, -1], 1)
    marginal = np.exp(ahead + back - total[:, None, None]) * mask[:, :, None]
    moves = np.zeros((k, k))
    for i in range(1, t):
        pair = ahead[:, i - 1, :, None] + move + (emit[:, i] + back[:, i])[:, None, :] - total[:, None, None]
        moves += (np.exp(pair) * mask[:, i, None, None]).sum(0)
    return marginal, moves, total


def viterbi(emit: np.ndarray, move: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Best label sequence of each of a batch of padded sequences."""
    n, t, _ = emit.shape
    best, came = emit[:, 0], np.zeros(emit.shape, dtype=np.int16)
    for i in range(1, t):
        step = best[:, :, None] + move
        came[:, i] = np.where(mask[:, i, None], step.argmax(1), np.arange(emit.shape[2]))
        best = np.where(mask[:, i, None], step.max(1) + emit[:, i], best)
    path = np.zeros((n, t), dtype=np.int16)
    path[:, -1] = best.argmax(1)
    for i in range(t - 1, 0, -1):
        path[:, i - 1] = came[np.arange(n), i, path[:, i]]
    return path


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, rows))
    out, mask = np.zeros((len(rows), longest, *rows[0].shape[1:]), dtype=rows[0].dtype), np.zeros((len(rows), longest), dtype=bool)
    for i, r in enumerate(rows):
        out[i, : len(r)], mask[i, : len(r)] = r, True
    return out, mask


def golden(tokens: Tokens, spans: list[Span]) -> np.ndarray:
    gold = np.zeros(len(tokens.starts), dtype=np.int64)
    for s in spans:
        inside = [i for i, (a, b) in enumerate(zip(tokens.starts, tokens.ends, strict=True)) if s.start <= a and b <= s.end]
        if inside:
            gold[inside] = LABELS.index(f"I-{s.kind}")
            gold[inside[0]] = LABELS.index(f"B-{s.kind}")
    return gold


def train_field(labelled: list[tuple[str, list[Span]]], epochs: int = 10, batch: int = 48, rate: float = 0.05, decay: float = 2e-5, longest: int = 120, seed: int = 4) -> Field | None:
    """Maximum likelihood by Adam over batches of labelled texts of like lengths; None if there are none."""
    ids, golds, index = [], [], {}
    for text, spans in labelled:
        found = next(stretches(text, 0, len(text)), None)
        if found is None or len(found.starts) > longest:
            continue
        golds.append(golden(found, spans))
        ids.append(np.array([[index.setdefault(f, len(index)) for f in fs] for fs in features(found.shapes)]))
    if not ids:
        return None
    k, width = len(LABELS), ids[0].shape[1]
    order = sorted(range(len(ids)), key=lambda i: len(ids[i]))
    batches = [(*padded([ids[i] for i in part]), padded([golds[i] for i in part])[0]) for part in (order[i : i + batch] for i in range(0, len(order), batch))]
    emit, move = np.zeros((len(index) + 1, k)), np.zeros((k, k))
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        for at in rng.permutation(len(batches)):
            feats, mask, gold = batches[at]
            step += 1
            hot = np.eye(k)[gold] * mask[:, :, None]
            marginal, moves, _ = forward_backward(emit[feats].sum(2), move, mask)
            flat, wrong = feats[mask].ravel(), np.repeat((marginal - hot)[mask], width, axis=0)
            grads = (
                np.stack([np.bincount(flat, wrong[:, j], len(emit)) for j in range(k)], 1) / len(feats) + decay * emit,
                (moves - np.einsum("ntk,ntl->kl", hot[:, :-1], hot[:, 1:])) / len(feats) + decay * move,
            )
            for w, g, m, v in zip((emit, move), grads, moments[::2], moments[1::2], strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                w -= rate / (1 + epoch / 3) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Field(index, emit, move)


def spans_of_path(path: np.ndarray, tokens: Tokens) -> list[tuple[str, int, int]]:
    """(kind, first token, last token) of the entities in a label sequence."""
    out, at = [], None
    for i, label in enumerate([*path[: len(tokens.starts)], 0]):
        name = LABELS[label]
        if at is not None and not (name[0] == "I" and name[2:] == at[0]):
            out.append((at[0], at[1], i - 1))
            at = None
        if name != "O" and at is None:
            at = (name[2:], i)
    return out


def decode(field: Field, part: list[Tokens], sure: float) -> Iterator[tuple[int, str, int, int]]:
    """(number of the tokens' row, kind, start, end) of each entity whose labels all have a marginal probability of
    ``sure`` or more and that holds a digit, an @ or a cue."""
    emit, mask = padded([field.scores(t.shapes) for t in part])
    paths = viterbi(emit, field.move, mask)
    hit = np.flatnonzero((paths * mask).any(1))
    if not len(hit):
        return
    marginal, _, _ = forward_backward(emit[hit], field.move, mask[hit])
    for row, p in zip(marginal, hit, strict=True):
        tokens = part[p]
        for kind, first, last in spans_of_path(paths[p], tokens):
            labels = paths[p][first : last + 1]
            if tokens.first <= first < tokens.stop and row[np.arange(first, last + 1), labels].min() >= sure and any(s.strip("_")[:1] in ("d", "@", "=") for s in tokens.shapes[first : last + 1]):
                yield p, f"crf_{kind}", tokens.starts[first], tokens.ends[last]


def batches_of(rows: Iterator[tuple[int, Tokens]]) -> Iterator[list[tuple[int, Tokens]]]:
    """Rows of like lengths, of BATCH_TOKENS padded tokens at most, from a buffer of BUFFER_TOKENS or so."""

    def dealt(held: list[tuple[int, Tokens]]) -> Iterator[list[tuple[int, Tokens]]]:
        held.sort(key=lambda x: len(x[1].starts), reverse=True)
        at = 0
        while at < len(held):
            n = max(1, BATCH_TOKENS // len(held[at][1].starts))
            yield held[at : at + n]
            at += n

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1].starts)
        if size >= BUFFER_TOKENS:
            yield from dealt(held)
            held, size = [], 0
    yield from dealt(held)


def disjoint(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, s.end)):
        if not out or s.start >= out[-1].end:
            out.append(s)
    return out


def field_finder(field: Field | None, sure: float) -> Callable[[list[str], list[list[Span]]], list[list[Span]]]:
    """Finds, in texts, the entities that the field adds to the base spans: those that overlap none of them, and
    of each other the first."""

    def find(texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
        out: list[list[Span]] = [[] for _ in texts]
        if field is None:
            return out
        rows = ((d, tokens) for d, text in enumerate(texts) for a, b in windows(text) for tokens in stretches(text, a, b))
        for part in batches_of(rows):
            for p, kind, start, end in decode(field, [t for _, t in part], sure):
                if plausible(kind.removeprefix("crf_"), texts[part[p][0]][start:end]):
                    out[part[p][0]].append(Span(kind, start, end))
        return [apart(disjoint(new), own) for new, own in zip(out, base, strict=True)]

    return find


def labelled_windows(docs: DataFrame) -> list[tuple[str, list[Span]]]:
    """The small labelled table: forms of personal data and harmless ones, set into words of ``docs``; bounded
    by ``carriers`` and ``personal_table``."""
    return personal_table(carriers(docs))


def find_pii(docs: DataFrame, field: Field | None, sure: float = SURE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans of every row of ``docs(doc_id, text, ...)``.

    Whole texts; the field sees shapes, and of numbers how many digits they have and whether a check digit holds. What
    it calls a card, phone number or address is dropped if its digits can't be one (``plausible``). A
    long window is decoded by overlapping stretches, so memory doesn't grow with it. A null text is an empty one: no spans, and the digest of an empty string. Repeated rows
    are scanned each for itself; further columns are ignored; an empty table gives an empty result.
    Without a field (nothing to learn from) only the patterns count. One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)
    return scan(docs, KINDS, base_spans, lambda: field_finder(sent.value, sure), by_kind)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, train_field(labelled_windows(docs)))
