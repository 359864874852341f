"""Small labelled tables for the two scanners: personal data and secrets in many forms, and what looks like
them, each set into words of the corpus. Labels are the maker's own, not the patterns' verdicts."""

from __future__ import annotations

import base64
import re
import string
from collections.abc import Iterator
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.spans import Span
from quire.llm.tables import bounded_sample

PLAIN_RUN = re.compile(r"[^\W\d_]+(?:[ ,.]{1,2}[^\W\d_]+){7,15}")

# In a form, # stands for a digit, & for a letter a-z, % for a digit or a-f, {h} for a word.
PHONES = ("(###) ###-####", "###-###-####", "###.###.####", "0## #######", "0#### ######", "0# ## ## ## ##", "00## ## #######", "0##/#######", "+## (0)## #######", "+## ## ### ## ##", "+1 (###) ###-####", "1-###-###-####", "(0##) ### ## ##", "+##-##-####-####", "0### ### ####", "(0##) #### ####", "(0###) ######", "0### #######")
CARDS = ("#### #### #### ####", "####-####-####-####", "####.####.####.####", "####/####/####/####", "################", "3### ###### #####", "3###-######-#####", "#### #### #### #### ###")
EMAILS = ("{h} at {h} dot {d}", "{h} dot {h} at {h} dot {d}", "{h}.{h} (at) {h} (dot) {d}", "{h} (at) {h}.{d}", "{h} dot {h} [at] {h} [dot] {d}", "{h}.{h} at {h} dot {d}", "{h} [at] {h} [dot] {d}", "{h}(at){h}(dot){d}", "{h} AT {h} DOT {d}", "{h}## at {h} dot {d}", "{h} at {h} punkt {d}", "{h}_{h} (at) {h} . {d}", "{h} [at] {h}.{d}", "{h}.##@{h}#.{h}.{d}", "{h}@{h}.{d}", "{h} @ {h}.{d}")
ADDRESSES = ("{o}.{o}.{o}.{o}", "{o}[.]{o}[.]{o}[.]{o}", "{o}(.){o}(.){o}(.){o}", "{o} . {o} . {o} . {o}", "{o}.{o}.{o}[.]{o}", "2001:%%%%:%%%%::%%%%:%%%%", "fe80::%%%%:%%%%:%%%%:%%%%", "2a02:%%%:%%%%:%%::#")
PERSONAL = {"phone": PHONES, "card": CARDS, "email": EMAILS, "ip": ADDRESSES}
CUES = {
    "phone": ("call", "tel.", "Tel:", "phone", "Telefon", "téléphone", "teléfono", "fax", "mobile:"),
    "card": ("card", "Visa", "Kreditkarte", "carte", "tarjeta", "charged to", "card no."),
    "email": ("mail", "email:", "write to", "contact", "E-Mail", "courriel", "correo", "reach"),
    "ip": ("ip", "host", "server", "address", "from", "IP:", "node"),
}
#: What is no personal data, with the words that stand before it.
HARMLESS = (
    "####-0#-1#", "1#.0#.20##", "0#/1#/####", "1#:##", "1#:##:##", "$#,###.##", "#.###,## €", "version #.#", "Version #.##", "v#.#.#", "CC BY-NC #.#", "##.# percent", "19##", "in 20##", "## ###", "#000000", "978-#-##-######-#", "page ##", "chapter #", "Seite ###",
    "{hex}", "room ###", "#-#", "19##-20##", "%%%%%%%%-%%%%-4%%%-a%%%-%%%%%%%%%%%%", "@{h}", "meet at #", "at the dot", "on the dot at #", "dot by dot", "#####", "ORD-######", "# + # = #", "##.# kg", "#.#.#", "§ ##", "no. ####", "{h}##", "## {h}", "1e#", "0.####", "[##]", "(####)", "point by point", "{h} at {h}",
    "token = \"{hex}\"", "(c) 20##", "ISO ####", "B## {h}", "##°", "1st", "#th", "##x##", "{h} #:#", "#,#", "1,###,###", "un point {h}", "der Punkt {h}",
    "DE## #### #### #### #### ##", "FR## #### #### #### #### #### ###", "GB##{H}##############", "parcel ############", "tracking #### #### ####", "JJD##################", "invoice 20##-#####", "{h} dot {h}", "{h} (at) {h}",
)
DOMAINS = ("com", "org", "net", "de", "fr", "es", "edu", "io", "co")
TAILS = ("", "", ".", ",", ";", ")", "!")

ALNUM = string.ascii_letters + string.digits
URL64 = ALNUM + "-_"
#: Prefix, alphabet and lengths of secrets of many makers; joined by the middle string where there are several parts.
KEYS = (
    ("gh" "p_", ALNUM, (36,), ""), ("gh" "o_", ALNUM, (36,), ""), ("gl" "pat-", URL64, (20,), ""), ("xo" "xb-", string.digits, (12, 12, 24), "-"), ("AI" "za", URL64, (35,), ""), ("sk" "_live_", ALNUM, (24,), ""), ("rk" "_live_", ALNUM, (24,), ""), ("npm" "_", ALNUM, (36,), ""), ("hf" "_", string.ascii_letters, (34,), ""),
    ("SG.", URL64, (22, 43), "."), ("ey" "J", URL64, (33, 60, 43), "."), ("", ALNUM + "+/", (40,), ""), ("", ALNUM, (32,), ""), ("", ALNUM, (24,), ""), ("", "0123456789ABCDEF", (32,), ""), ("", "0123456789ABCDEF", (40,), ""), ("", "0123456789abcdef", (40,), ""), ("", ALNUM + "+/", (43,), "="), ("", ALNUM + "_-.", (14,), ""), ("", ALNUM + "@=.", (16,), ""), ("AK" "IA", string.ascii_uppercase + string.digits, (16,), ""),
)
BEFORE_KEY = ("key: ", "Authorization: Bearer ", "export KEY=", '"auth": "', "pw ", "credential ", "", "", "use ", "login with ", "API key is ", "access=", "private_key=", "pass: ", "--auth ")
LOOK_ALIKE = (
    "%%%%%%%%-%%%%-4%%%-a%%%-%%%%%%%%%%%%", "/usr/lib/{h}#.#/{h}-{h}/{h}", "src/main/{h}/com/{h}/{H}{H}.{h}", "www.{h}-{h}.{d}/{h}/{h}##", "{h}{H}{H}By{H}#", "{h}_{h}_{h}_##", "{h}-{h}-{h}-20##", "{h}.##@{h}#.{h}.{d}", "{h}@{h}-{h}.{d}", "###.###.##.###", "################", "20##-0#-1#T1#:##:##", "20##-0#-1#T1#", "#.#.#-beta.##",
    "IMG_20######_######.jpg", "978-#-##-######-#", "+1-###-###-####", "----------------", "====================", "xxxxxxxxxxxxxxxxxxxx", "{h}{h}{h}{h}", "{h}{h}{h}{h}{h}", "{H}{h}{h}{h}", "{h}/{h}/{h}/{h}##", "{h}=##&{h}=###", "C##H##N#O##-{h}", "{h}.{h}.{h}.{H}{H}#", "...............", "{h}##-{h}##-{h}##", "##########", "____________________", "{H}_{H}_{H}_##", "0.################", "abcdefghijklmnopqrstuvwxyz", "0123456789##########",
)


def carriers(docs: DataFrame, max_docs: int = 2_000, max_rows: int = 1_500) -> list[str]:
    """Runs of 8 to 16 words without a digit from about ``max_docs`` documents; at most ``max_rows`` reach the driver."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield pa.record_batch([pa.array([m[0] for text in part["text"].to_pylist() for m in PLAIN_RUN.finditer(text) if len(m[0]) < 200], pa.string())], ["text"])

    sample = bounded_sample(docs.select("doc_id", "text").filter("text is not null"), "doc_id", max_docs)
    found = sample.mapInArrow(cut, "text string").distinct().orderBy(F.xxhash64("text"), "text").limit(max_rows).collect()
    return [r["text"] for r in found]


class Maker:
    """Fills forms; the same table for the same carriers and seed."""

    def __init__(self, rows: list[str], seed: int):
        self.rng, self.rows = Random(seed), rows
        self.words = sorted({w for r in rows for w in re.findall(r"[^\W\d_]{2,12}", r.lower())})

    def fill(self, form: str) -> str:
        rng = self.rng
        make = {
            "{h}": lambda: rng.choice(self.words), "{H}": lambda: rng.choice(self.words).capitalize(), "{d}": lambda: rng.choice(DOMAINS), "{o}": lambda: str(rng.randrange(256)), "{hex}": lambda: "".join(rng.choices("0123456789abcdef", k=40)),
            "#": lambda: rng.choice(string.digits), "&": lambda: rng.choice(string.ascii_lowercase), "%": lambda: rng.choice("0123456789abcdef"),
        }
        return re.sub(r"\{\w+\}|[#&%]", lambda m: make[m[0]](), form)

    def checked(self, number: str, valid: bool) -> str:
        """``number`` with its last digit changed to the right check digit, or to a wrong one."""
        total = sum(n - 9 * (n > 9) for i, d in enumerate(reversed(re.sub("[^0-9]", "", number)[:-1])) for n in [int(d) * (2 - i % 2)])
        right = -total % 10
        return number[:-1] + str(right if valid else (right + self.rng.randrange(1, 10)) % 10)

    def set_in(self, pieces: list[tuple[str, str, str | None]]) -> tuple[str, list[Span]]:
        """A carrier with (words before, piece, kind) put between its words, and the spans of pieces with a kind."""
        rng = self.rng
        words = rng.choice(self.rows).split()
        words = words[rng.randrange(len(words)) :] or words
        places = sorted(rng.randrange(len(words) + 1) for _ in pieces)
        out, spans, at = "", [], 0
        for place, (before, piece, kind) in zip(places, pieces, strict=True):
            out += "".join(w + rng.choice(("  ", "\n", " ", " ", " ", " ")) for w in words[at:place])
            out += f"{before} " if before and not before.endswith((" ", "=", '"')) else before
            if kind:
                spans.append(Span(kind, len(out), len(out) + len(piece)))
            out += piece + rng.choice(TAILS) + rng.choice((" ", " ", " ", "\n"))
            at = place
        return out + " ".join(words[at:]), spans

    def personal(self) -> tuple[str, list[Span]]:
        pieces = []
        for _ in range(self.rng.choice((1, 1, 2))):
            if self.rng.random() < 0.6:
                kind = self.rng.choice(sorted(PERSONAL))
                cue, form = self.rng.choice(CUES[kind]) if self.rng.random() < 0.4 else "", self.rng.choice(PERSONAL[kind])
                valid = kind != "card" or self.rng.random() < 0.7
                # Of numbers in a card's form those with a wrong check digit are no cards.
                pieces.append((cue, self.checked(self.fill(form), valid) if kind == "card" else self.fill(form), kind if valid else None))
            else:
                pieces.append(("", self.fill(self.rng.choice(HARMLESS)), None))
        return self.set_in(pieces)

    def key(self) -> str:
        prefix, alphabet, lengths, middle = self.rng.choice(KEYS)
        made = prefix + middle.join("".join(self.rng.choices(alphabet, k=n)) for n in lengths)
        return made + ("=" if middle == "=" else "")

    def secret(self) -> tuple[str, list[Span]]:
        """One secret, or one look-alike (kind "other"), among words."""
        rng = self.rng
        if rng.random() < 0.45:
            return self.set_in([(rng.choice(BEFORE_KEY), self.key(), "cnn")])
        if rng.random() < 0.1:
            raw = base64.b64encode(rng.randbytes(rng.randrange(150, 400))).decode()
            before = rng.choice(("data:image/png;base64,", "src=data:image/jpeg;base64,", "integrity=sha512-"))
            return self.set_in([(before.rpartition(",")[0] + "; ", raw, "other")])
        return self.set_in([(rng.choice(("", "", "see ", "in ", "file=", "id: ", "name: ", "commit ")), self.fill(rng.choice(LOOK_ALIKE)), "other")])


def personal_table(rows: list[str], n: int = 2_400, seed: int = 1) -> list[tuple[str, list[Span]]]:
    """``n`` labelled texts; none without carriers."""
    maker = Maker(rows, seed)
    return [maker.personal() for _ in range(n)] if maker.words else []


def secret_table(rows: list[str], n: int = 2_400, seed: int = 2) -> list[tuple[str, list[Span]]]:
    maker = Maker(rows, seed)
    return [maker.secret() for _ in range(n)] if maker.words else []
