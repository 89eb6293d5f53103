"""Personal data by candidate gradient boosting.

Generators of high recall propose spans, which may overlap: strings about an @, dotted and separated digits, account
numbers, hexadecimal addresses, values that are assigned to a name, words after a spoken name of a secret, long runs of
letters and digits. Boosted trees judge each by its format and its
context; they are trained on made-up texts with a fixed seed, and a threshold for each kind is set on texts that the
trees did not see, at PRECISION. Of overlapping spans the likelier stays. What the base patterns find always stays and
is never overlapped.

Defined results: null text counts as empty and has no spans; offsets are code points, the end exclusive; repeated rows
have the same spans; an empty table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.boosting import BoostedTrees
from larkspur.llm.common import by_batch, id_text, table

Span = tuple[str, int, int]

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ipv6", "secret", "ssn")
SEED, EXAMPLES, PRECISION = 7, 9000, 0.98

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_digit, _letter = re.compile("[0-9]"), re.compile("[A-Za-z]")
# A match that fails from the first digit of a run fails from the others too, so it is tried from the first alone.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9]([\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_not_digit = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """By kind, then by start."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local:
            start -= 1
        if at >= end and start < at and (m := _domain.match(text, at)):
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", at + 1)
    if not _digit.search(text):
        return out
    out += [("ip", *m.span()) for m in _ip.finditer(text) if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m[0].split("."))]
    for m in _card.finditer(text):
        if len(m[0]) >= 16 and 16 <= len(d := _not_digit.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _phone.finditer(text) if 8 <= len(_not_digit.sub("", m[0])) <= 15]
    return out


# The generators, each gated by a character that its matches need.
_generators: tuple[tuple[str, str, re.Pattern], ...] = (
    ("email", "@", re.compile(r"(?<![^\s<>(),;:\"'])[^\s@<>(),;:\"']{1,64}@[^\s@<>(),;:\"']{1,255}")),
    ("ip", ".", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?\.\s?[0-9]{1,3}){3}(?![0-9])")),
    ("card", "", re.compile(r"(?<![0-9])[0-9](?:[\x20.\-]{0,2}[0-9]){12,18}(?![0-9])")),
    ("phone", "", re.compile(r"(?<![0-9])(?:\+|\(|00)?[0-9](?:[\x20().\-/]{0,3}[0-9]){6,14}(?![0-9])")),
    ("iban", "", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")),
    ("ipv6", ":", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}:?(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("ssn", "-", re.compile(r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])")),
)
_assigned = re.compile(r"[=:]\s{0,3}[\"']?([A-Za-z0-9+/_.\-]{12,200})")
_named = re.compile(r"(?<![A-Za-z])(?i:pass(?:word|wd|phrase|code)|pwd|secret|token|api[\x20_-]?key|access[\x20_-]?key|credentials?)\x20{0,2}(?:is|was|are|:|=|->)?\s{1,3}[\"'`]?([^\s\"'`<>,;]{5,200})")
_run = re.compile(r"[A-Za-z0-9_\-]{16,200}")
_hint = {
    "email": re.compile(r"mail|contact|@|write|from|to\b", re.I),
    "ip": re.compile(r"\bip\b|host|addr|server|login|from", re.I),
    "card": re.compile(r"card|visa|master|credit|debit|pay", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|cell|fax|contact|whatsapp", re.I),
    "iban": re.compile(r"iban|account|bank|konto|cuenta|compte", re.I),
    "ipv6": re.compile(r"\bip|host|addr|server", re.I),
    "secret": re.compile(r"token|secret|passw|key|auth|bearer|credential", re.I),
    "ssn": re.compile(r"ssn|social|security", re.I),
}
_naming = re.compile(r"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|key|credentials?)[\"']?\s{0,3}(?:is|was|are|:|=|->)?\s{0,3}[\"'`]?$", re.I)
_against = re.compile(r"version|isbn|commit|sha|checksum|uuid|order|invoice|price|page|section|serial|build|release|doi|http|part|item|total|€|\$|[vV]\.?\s?$", re.I)


def candidates(text: str) -> list[Span]:
    out: list[Span] = []
    digits = _digit.search(text) is not None
    for kind, gate, pattern in _generators:
        if gate in text and (digits or kind in ("email", "ipv6")):
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    if "=" in text or ":" in text:
        out += [("secret", *m.span(1)) for m in _assigned.finditer(text)]
    for m in _named.finditer(text):
        a, b = m.span(1)
        while text[b - 1] in ".!?)" and b - a > 5:
            b -= 1
        out.append(("secret", a, b))
    if digits:
        out += [("secret", *m.span()) for m in _run.finditer(text) if _digit.search(m[0]) and _letter.search(m[0])]
    return sorted(set(out))


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 3 if c in ".,;!?" else 1 if c.isalnum() else 2


def mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    s, before = text[a:b], text[max(0, a - 32) : a]
    digits = _not_digit.sub("", s)
    letters = sum(c.isalpha() for c in s)
    host = s.rpartition("@")[2] if kind == "email" else ""
    runs = [len(x) for x in re.findall("[0-9]+", s)]
    return [
        *(float(kind == k) for k in KINDS),
        len(s), len(digits), letters, len(s) - len(digits) - letters,
        float(bool(digits) and luhn(digits)), float(s[0] == "+"), float("(" in s), float(len(set(digits))), float(max(runs, default=0)), float(len(runs)),
        _side(text[a - 1 : a]), _side(text[b : b + 1]),
        float(bool(_hint[kind].search(before))), float(bool(_against.search(before))),
        len(set(s)) / len(s), float(all(c in "0123456789abcdefABCDEF" for c in s)),
        float(kind in ("ip", "secret") and all(x.strip().isdigit() and int(x) <= 255 for x in s.split("."))),
        float(kind == "iban" and mod97(s)), float("." in host.strip(".")), float(letters > 0 and len(digits) > 0),
        float(bool(_naming.search(before))), float(s.count("-") + s.count("_") + s.count(".") + s.count("/")), sum(c.isupper() for c in s) / len(s), float(len(re.findall("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])", s))),
        float(bool(re.fullmatch(r"(19|20)[0-9]{2}[-./ ][0-9]{2}[-./ ][0-9]{2}.*|[0-9]{2}[-./ ][0-9]{2}[-./ ](19|20)[0-9]{2}.*", s))),
    ]


def made_up(seed: int = SEED, n: int = EXAMPLES) -> list[tuple[str, Span, bool]]:
    """Texts with a span each, and whether it is personal."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(pick(("ba", "ne", "ri", "to", "lu", "en", "st", "ar", "or", "chi")) for _ in range(int(rng.integers(1, 5))))
    hexa = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))

    mixed = lambda k: "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    spoken = lambda: pick((word() + num(1) + word(), word() + num(3), word().title() + pick("!#$%_") + num(2), word() + "-" + word() + num(2), mixed(9)))

    def card() -> str:
        d = num(15)
        return next(d + str(x) for x in range(10) if luhn(d + str(x)))

    def iban() -> str:
        rest, land = num(18), pick(("DE", "FR", "ES", "IT"))
        return next(s for k in range(100) if mod97(s := f"{land}{k:02d}{rest}"))

    yes = {
        "email": lambda: f"{word()}{pick(('.', '_', '+', ''))}{word()}@{word()}.{pick(('com', 'org', 'de', 'co.uk', 'example.com'))}",
        "ip": lambda: " . ".join(str(x) for x in rng.integers(1, 255, 4)) if rng.random() < 0.3 else ".".join(str(x) for x in rng.integers(1, 255, 4)),
        "card": lambda: (lambda c: pick((c, "-".join(c[i : i + 4] for i in range(0, 16, 4)), ". ".join(c[i : i + 4] for i in range(0, 16, 4)))))(card()),
        "phone": lambda: pick((f"({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(6)}", f"00{num(2)} {num(3)} {num(3)} {num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(4)}/{num(7)}")),
        "iban": lambda: (lambda c: pick((c, " ".join(c[i : i + 4] for i in range(0, len(c), 4)))))(iban()),
        "ipv6": lambda: ":".join(hexa(4) for _ in range(8)) if rng.random() < 0.6 else f"{hexa(4)}:{hexa(4)}::{hexa(4)}",
        "secret": lambda: pick((hexa(40), hexa(32), "sk_live_" + hexa(24), hexa(20).upper() + hexa(12), spoken(), spoken(), "AKIA" + mixed(16).upper(), "ghp_" + mixed(36), "AIza" + mixed(35), mixed(24))),
        "ssn": lambda: f"{num(3)}-{num(2)}-{num(4)}",
    }
    lead = {
        "email": ("mail ", "contact: ", "", "write to "), "ip": ("host ", "login from ", "ip ", ""), "card": ("card ", "visa ", "credit card: ", ""), "phone": ("phone ", "call ", "tel. ", "mobile: "),
        "iban": ("IBAN ", "account ", "bank: ", ""), "ipv6": ("host ", "addr ", "ip "), "secret": ("token = ", 'secret: "', "api_key=", 'password = "', "my password is ", "the token was ", "Password: ", "access key ", ""), "ssn": ("SSN ", "social security number ", "ssn: "),
    }
    no = {
        "email": lambda: (pick(("", "see ")), pick((f"{word()}@{word()}", f"@{word()}@{word()}", f"!!@{word()}", f"{num(2)}@{num(2)}"))),
        "ip": lambda: (pick(("version ", "section ", "v")), ".".join(num(int(rng.integers(1, 4))) for _ in range(4))),
        "card": lambda: (pick(("order ", "serial ", "", "isbn ")), num(int(rng.integers(13, 20)))),
        "phone": lambda: (pick(("order ", "total ", "", "page ", "in ", "$")), pick((num(7), num(10), f"{num(3)} {num(3)} {num(3)}", f"20{num(2)}-{pick(('01', '10'))}-{num(2)}", f"{num(2)}.{num(2)}.20{num(2)}", f"{num(4)}.{num(4)}", f"{num(1)} {num(2)} {num(3)} {num(4)}", f"19{num(2)}-20{num(2)}"))),
        "iban": lambda: (pick(("", "part ")), pick(("AB", "XX", "NO")) + num(2) + "".join(pick("ABCDEF0123456789") for _ in range(int(rng.integers(11, 25))))),
        "ipv6": lambda: (pick(("at ", "")), pick((f"{num(2)}:{num(2)}:{num(2)}", f"{num(1)}:{num(2)}:{num(2)}"))),
        "secret": lambda: pick((
            (pick(("name: ", "see: ", "x = ", "title: ", "src: ")), pick((word() + word() + word() + word(), f"{word()}-{word()}-{word()}-x", "/".join(word() for _ in range(4)), num(12)))),
            (pick(("the password is ", "a token ", "password was ", "the secret ", "secret is ", "token is ")), pick((word() + word(), "required", "needed " + word(), "strong", "called", "always", "missing", "valid"))),
            (pick(("see ", "", "page ", "commit ", "sha1 ", "uuid ")), pick((f"{word()}-{word()}-{num(4)}-{word()}", f"{word()}_{word()}_{word()}_{num(1)}", hexa(40), f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", f"{word()}{word()}{word()}{word()}{word()}1"))),
        )),
        "ssn": lambda: (pick(("part ", "order ", "")), f"{num(3)}-{num(2)}-{num(4)}"),
    }
    out = []
    for _ in range(n):
        kind, good = pick(KINDS), bool(rng.random() < 0.5)
        start, s = (pick(lead[kind]), yes[kind]()) if good else no[kind]()
        left = " ".join(word() for _ in range(int(rng.integers(0, 6))))
        text = f"{left} {start}{s}{pick((' ', '. ', ', ', '!! ', '', chr(34)))}{word()}"
        a = len(left) + 1 + len(start)
        found = [c for c in candidates(text) if c[0] == kind and c[1] < a + len(s) and c[2] > a]
        out += [(text, c, good) for c in found[:1]]
    return out


class Apart:
    """Intervals that don't overlap, in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.starts, b)
        return k == 0 or self.ends[k - 1] <= a

    def join(self, a: int, b: int) -> None:
        """Adds an interval; it becomes one with those that it overlaps."""
        lo, hi = bisect.bisect_right(self.ends, a), bisect.bisect_left(self.starts, b)
        if lo < hi:
            a, b = min(a, self.starts[lo]), max(b, self.ends[hi - 1])
        self.starts[lo:hi], self.ends[lo:hi] = [a], [b]


class Judge:
    """The trees and, for each kind, the threshold."""

    def __init__(self, seed: int = SEED):
        rows = made_up(seed)
        x = np.array([features(t, s) for t, s, _ in rows])
        y = np.array([float(g) for *_, g in rows])
        apart = np.arange(len(rows)) % 3 == 0
        self.trees = BoostedTrees().fit(x[~apart], y[~apart])
        p = self.trees.predict(x)
        self.least = {}
        for k, kind in enumerate(KINDS):
            own = apart & (x[:, k] == 1)
            order = np.argsort(-p[own], kind="stable")
            right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
            good = np.flatnonzero(right >= PRECISION)
            self.least[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 2.0

    def chosen(self, text: str, base: list[Span]) -> list[Span]:
        """Spans besides the base ones."""
        taken = Apart()
        for _, a, b in sorted(base, key=lambda s: s[1:]):
            taken.join(a, b)
        found = [c for c in candidates(text) if taken.free(c[1], c[2])]
        if not found:
            return []
        p = self.trees.predict(np.array([features(text, c) for c in found]))
        out: list[Span] = []
        for i in np.argsort(-p, kind="stable"):
            kind, a, b = found[i]
            if p[i] >= self.least[kind] and taken.free(a, b):
                taken.join(a, b)
                out.append(found[i])
        return out


_judge: dict[int, Judge] = {}


def judge(seed: int = SEED) -> Judge:
    """One per process; equal in all, as the seed fixes it."""
    if seed not in _judge:
        _judge[seed] = Judge(seed)
    return _judge[seed]


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1:]))


def find(text: str, own: Judge) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans; each by kind, then by start."""
    base = base_spans(text)
    return base, ordered([*base, *own.chosen(text, base)])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """text with each span, or run of overlapping spans, as the name of the kind of the first in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all)."""

    def run(batch: pa.RecordBatch, own: Judge) -> pa.RecordBatch:
        found = [find(t, own) for t in batch.column("text").to_pylist()]
        n = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE]
        sha = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *n, sha, pa.array([joined(x) for _, x in found])], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return by_batch(id_text(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", judge)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced; all rows and columns stay, null text stays null. n_chars, where there is one, follows the text."""
    schema, names = docs.schema, docs.columns

    def run(batch: pa.RecordBatch, own: Judge) -> pa.RecordBatch:
        at = names.index("text")
        text = [None if t is None else redact(t, find(t, own)[1]) for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(text, pa.string())
        return pa.RecordBatch.from_arrays(columns, names)

    out = by_batch(docs, run, schema, judge)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
