"""Fixed patterns against the contract's regular expressions, and the models on top."""

import re
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import examples, pii, secrets
from quire.llm.pii import op2_pii
from quire.llm.secrets import op6_secrets
from quire.llm.spans import apart

from .conftest import AWKWARD

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRETS = {
    "assign": r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain_pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((kind, *m.span()))
    return out


def plain_secrets(text):
    out = []
    for kind, pattern in SECRETS.items():
        for m in re.finditer(pattern, text):
            if {"assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[kind]():
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(SECRETS).index(s[0])))


def digest(spans):
    return sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.@+-1 02()9%é", max_size=60))
def test_pii_patterns_on_random_text(text):
    assert sorted(map(tuple, pii.base_spans(text))) == sorted(plain_pii(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "API_key", "secret", "=", ":", " ", '"', "'", "abcdef12", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "K"]), max_size=12))
def test_secret_patterns_on_random_text(parts):
    text = "".join(parts)
    assert sorted(map(tuple, secrets.base_spans(text))) == sorted(plain_secrets(text))


def check(rows, texts, plain, kinds, own):
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == digest(spans)
        for kind in kinds:
            assert r[f"n_{kind}"] == sum(s[0] == kind for s in spans)
        found = [s for s in r["spans"].split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(found)
        assert all(s.startswith(own) for s in set(found) - {f"{k}:{a}:{b}" for k, a, b in spans})


def test_op2_equals_plain_patterns(spark, sf_dir, some_documents):
    check(op2_pii(spark, sf_dir).collect(), some_documents[1], plain_pii, PII, "crf_")


def test_op6_equals_plain_patterns(spark, sf_dir, some_documents):
    check(op6_secrets(spark, sf_dir).collect(), some_documents[1], plain_secrets, SECRETS, "cnn")


def test_awkward_and_empty_tables(awkward, no_documents):
    texts = dict(AWKWARD)
    for find, plain, kinds in ((lambda d: pii.find_pii(d, None), plain_pii, PII), (lambda d: secrets.find_secrets(d, None), plain_secrets, SECRETS)):
        rows = find(awkward).collect()
        assert len(rows) == len(AWKWARD)
        for r in rows:
            assert r["base_sha256"] == digest(plain(texts[r["doc_id"]] or ""))
        assert find(no_documents).collect() == []
    assert pii.labelled_windows(no_documents) == []
    assert secrets.train_network(*secrets.labelled_candidates(no_documents)) is None
    assert pii.train_field([]) is None


@pytest.fixture(scope="module")
def words(spark):
    """Carriers of one part of the table to learn from, and of another to be tested on."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return examples.carriers(docs.filter("doc_id % 2 = 0")), examples.carriers(docs.filter("doc_id % 2 = 1"))


def found_of(gold, found):
    """Recall of the labelled spans, and precision of those found."""
    true = {(i, s.kind.removeprefix("crf_"), s.start, s.end) for i, spans in enumerate(gold) for s in spans}
    got = {(i, s.kind.removeprefix("crf_"), s.start, s.end) for i, spans in enumerate(found) for s in spans}
    return len(true & got) / len(true), len(true & got) / len(got)


def test_field_finds_what_the_patterns_miss(words):
    """Trained on one half's words, the field finds nine tenths of the spans beyond the patterns in the other's."""
    field = pii.train_field(examples.personal_table(words[0]))
    held = examples.personal_table(words[1], 900, seed=71)
    texts = [t for t, _ in held]
    base = [pii.base_spans(t) for t in texts]
    beyond = [[s for s in gold if s in apart(gold, own)] for (_, gold), own in zip(held, base, strict=True)]
    recall, precision = found_of(beyond, pii.field_finder(field, pii.SURE)(texts, base))
    print(f"spans beyond the patterns: {sum(map(len, beyond))}, recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.9
    clean = words[1]
    assert sum(map(len, pii.field_finder(field, pii.SURE)(clean, [[] for _ in clean]))) == 0


#: Written by hand, not by ``examples``: what stands in a line, and its kind. Some forms are learned ones, some not.
BY_HAND = (
    ("jane dot doe at example dot com", "email"), ("peter.pan (at) never (dot) org", "email"), ("anna_k [at] firma [dot] de", "email"), ("info at shop dot co dot uk", "email"),
    ("0171 555 0123", "phone"), ("(030) 1234 5678", "phone"), ("555-867-5309", "phone"), ("01 23 45 67 89", "phone"), ("1-800-555-0199", "phone"), ("0611/123456", "phone"),
    ("4111.1111.1111.1111", "card"), ("3782 822463 10005", "card"), ("5500/0000/0000/0004", "card"), ("3714-496353-98431", "card"),
    ("192[.]168[.]1[.]7", "ip"), ("10(.)0(.)0(.)1", "ip"), ("2001:0db8:85a3::8a2e:0370:7334", "ip"),
    ("4111 1111 1111 1112", None), ("5500/0000/0000/0005", None), ("DE89 3704 0044 0532 0130 00", None), ("0034 0434 1611 2234 5678", None), ("12.03.2024", None), ("10:30", None), ("1,234,567.89", None),
    ("978-3-16-148410-0", None), ("123e4567-e89b-42d3-a456-426614174000", None), ("version 10.2.3.400", None), ("chapter 12", None), ("§ 823 BGB", None), ("ISO 9001:2015", None), ("meet at noon", None), ("dot by dot", None),
)


def test_field_on_lines_written_by_hand(words):
    """Nine in ten of either sort are told right; of numbers with a wrong check digit none is a card."""
    find = pii.field_finder(pii.train_field(examples.personal_table(words[0])), pii.SURE)
    lines = [f"the other words stand here {piece} and more words follow" for piece, _ in BY_HAND]
    base = [pii.base_spans(x) for x in lines]
    found = [{s.kind.removeprefix("crf_") for s in own + new} for own, new in zip(base, find(lines, base), strict=True)]
    hit = [kind in f for (_, kind), f in zip(BY_HAND, found, strict=True) if kind]
    clean = [not f for (_, kind), f in zip(BY_HAND, found, strict=True) if not kind]
    wrong = [(p, k, f) for (p, k), f in zip(BY_HAND, found, strict=True) if (k not in f if k else f)]
    print(f"by hand: {sum(hit)} of {len(hit)} found, {sum(clean)} of {len(clean)} left alone; wrong: {wrong}")
    assert sum(hit) >= 0.9 * len(hit) and sum(clean) >= 0.9 * len(clean) and not any("card" in f for p, k, f in wrong if k is None)


def test_no_card_without_its_check_digit(spark, words):
    """On the documents of the test table the field adds no number that can't be what it is called."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    base = [pii.base_spans(t) for t in texts]
    for text, spans in zip(texts, pii.field_finder(pii.train_field(examples.personal_table(words[0])), pii.SURE)(texts, base), strict=True):
        for s in spans:
            digits = "".join(c for c in text[s.start : s.end] if c.isdigit())
            assert s.kind != "crf_card" or (13 <= len(digits) <= 19 and pii.luhn(digits))
            assert s.kind != "crf_phone" or 7 <= len(digits) <= 15


def test_long_windows_are_decoded_by_stretches(words):
    """A window far longer than a stretch gives each entity once, wherever it lies; 5 MB of digits stay within bounds."""
    import tracemalloc

    field = pii.train_field(examples.personal_table(words[0], 1200))
    find = pii.field_finder(field, pii.SURE)
    one = "12 by 7 write to anna at erwhen dot com, then 3 of 9 in 2011 "
    [found] = find([one * 300], [[]])
    mail = [s for s in found if s.kind == "crf_email"]
    assert len({s.start for s in mail}) == len(mail) == 300
    tracemalloc.start()
    find(["12 345 6 " * 550_000], [[]])
    assert tracemalloc.get_traced_memory()[1] < 1e9
    tracemalloc.stop()


def test_viterbi_equals_search_of_all_paths():
    from itertools import product

    rng = np.random.default_rng(1)
    emit, move = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3))
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 1, 1, 0]], dtype=bool)
    paths = pii.viterbi(emit, move, mask)
    marginal, _, total = pii.forward_backward(emit, move, mask)
    for i in range(3):
        n = mask[i].sum()
        scores = {p: emit[i, range(n), p].sum() + sum(move[a, b] for a, b in zip(p, p[1:], strict=False)) for p in product(range(3), repeat=int(n))}
        assert tuple(paths[i, :n]) == max(scores, key=scores.get)
        assert np.isclose(total[i], np.log(np.exp(list(scores.values())).sum()))
        first = np.array([sum(np.exp(s - total[i]) for p, s in scores.items() if p[0] == k) for k in range(3)])
        assert np.allclose(marginal[i, 0], first)


def test_network_finds_what_the_patterns_miss(words, monkeypatch):
    monkeypatch.setattr(secrets, "carriers", lambda docs: docs)
    net = secrets.train_network(*secrets.labelled_candidates(words[0]))
    held = examples.secret_table(words[1], 1000, seed=72)
    texts = [t for t, _ in held]
    base = [secrets.base_spans(t) for t in texts]
    found = secrets.network_finder(net)(texts, base)
    beyond = [(gold.kind == "cnn", not apart([gold], new)) for (_, [gold]), own, new in zip(held, base, found, strict=True) if apart([gold], own)]
    hit, real = sum(a and b for a, b in beyond), sum(a for a, _ in beyond)
    recall, precision = hit / real, hit / sum(b for _, b in beyond)
    print(f"secrets beyond the patterns: {real}, recall {recall:.3f}, precision {precision:.3f}; held out: {net.recall:.3f}, {net.precision:.3f}")
    assert recall >= 0.9 and precision >= 0.9 and net.recall >= 0.95


def test_network_gradient_is_right():
    rng = np.random.default_rng(0)
    codes, gold = rng.integers(0, secrets.N_CLASSES, (4, 96)).astype(np.uint8), np.array([1.0, 0, 1, 0])
    net = secrets.Network.new(1)
    net.out[:] = rng.normal(size=net.out.shape)

    def loss():
        logit = net.forward(codes)[-1]
        return float((np.log1p(np.exp(-np.abs(logit))) + np.maximum(logit, 0) - gold * logit).mean() + 0.5e-4 * (net.conv**2).sum() + 0.5e-4 * (net.out**2).sum())

    base, step = {k: getattr(net, k).copy() for k in ("embed", "conv", "bias", "out")}, 1e-6
    net.learn(codes, gold, np.ones(4), 1.0)
    grads = {k: base[k] - getattr(net, k) for k in base}
    for k, v in base.items():
        setattr(net, k, v.copy())
    for k, at in (("conv", (3, 2)), ("out", (5,)), ("bias", (1,)), ("embed", (int(codes[0, 40]), 3))):
        getattr(net, k)[at] += step
        up = loss()
        getattr(net, k)[at] -= 2 * step
        down = loss()
        getattr(net, k)[at] += step
        assert np.isclose(grads[k][at], (up - down) / (2 * step), rtol=1e-3, atol=1e-6), k


def test_secret_in_the_middle_of_a_long_run_is_seen():
    """The network gets every part of a run of 300 characters, and the likeliest part decides."""
    seen = []

    class Watch:
        threshold = 0.5

        def probability(self, codes):
            seen.append(len(codes))
            return (codes == secrets.CLASSES[ord("Z")]).sum(1) / 24

    text = "see " + "path/" * 28 + "Z" * 24 + "/path" * 28 + "2 end"
    [found] = secrets.network_finder(Watch())([text], [[]])
    assert sum(seen) > 10 and [(f.start, f.end) for f in found] == [(4, len(text) - 4)]


def test_threshold_keeps_the_recall_of_hard_secrets():
    """Where half of the secrets look like other candidates, the threshold still recalls 95 % of the held-out third."""
    rng = np.random.default_rng(8)
    codes = rng.integers(3, 8, (900, 2 * secrets.BESIDE + secrets.INSIDE)).astype(np.uint8)
    gold = (np.arange(900) % 3 == 0).astype(np.float64)
    codes[np.arange(900) % 6 == 0, secrets.BESIDE : secrets.BESIDE + 20] = 3
    net = secrets.train_network(codes, gold)
    rest = np.random.default_rng(5).permutation(900)[:300]
    likely = net.probability(codes[rest])
    assert (likely[gold[rest] == 1] >= net.threshold).mean() >= 0.95
    assert net.recall >= 0.95 and 0 < net.precision <= 1
