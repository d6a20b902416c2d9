"""Personal data by weak supervision.

Four kinds are found by fixed patterns and always stay. Around them and beside
them stand candidates of further kinds. Six labelers (shape, validity,
gazetteer, context, neighbours, boundary) vote yes, no or abstain on every
candidate; expectation-maximisation over the counted vote patterns estimates
how reliable each labeler is and how likely each pattern is personal data; a
logistic classifier trained on those soft labels decides which candidates
become spans.

All candidates of the corpus count. What reaches the driver is a count for
each pattern of votes, at most kinds x 3^6 x lengths. Places are code points,
the end excluded. Defined results: null texts are empty; a table without
candidates has base spans only (none); candidates that overlap a base span are
votes, not spans; repeated rows count each; extra columns are ignored or, in
``redact``, kept.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from dataclasses import dataclass
from itertools import count as counter, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id", "local_phone", "name")
KINDS = (*BASE, *ADDED)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")


def _class(fits) -> str:
    """Character class of all characters that fit, as ranges."""
    codes = [c for c in range(sys.maxunicode + 1) if fits(chr(c))]
    runs = [list(r) for _, r in groupby(codes, key=lambda c, n=counter(): c - next(n))]
    return "".join(f"{re.escape(chr(r[0]))}-{re.escape(chr(r[-1]))}" for r in runs)


# Letters of a name, with accents; marks that follow their letter count as lower-case letters.
UPPER = f"[{_class(lambda c: unicodedata.category(c) in ('Lu', 'Lt'))}]"
LOWER = f"[{_class(lambda c: unicodedata.category(c) == 'Ll')}\u0300-\u036f]"
LETTER = r"[^\W\d_]"
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
EXTRA = {
    "iban": re.compile(r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "national_id": re.compile(r"[0-9](?<![0-9-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "local_phone": re.compile(r"[(0-9](?<![0-9+.-].)(?:(?<=\()[0-9]{3}\) ?|(?<=[0-9])[0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "name": re.compile(rf"{UPPER}(?<!{LETTER}.){LOWER}+(?: {UPPER}{LOWER}+){{1,2}}(?!{LETTER})"),
}

# Words of the gazetteer and context labelers, in natural order.
GIVEN = frozenset(
    "Alice Anna Antonio Barbara Carlos Carmen Charles Christine David Elena Elizabeth Emma François Hans Helga Ingrid Isabel James Jean Jennifer "
    "John Jorge José Juan Karl Klaus Laura Linda Louis Lucía Maria Marie Mary Michael Michel Monika Olivia Patricia Paul Peter Philippe Pierre "
    "Robert Sarah Sofia Susan Thomas Ursula William Wolfgang".split()
)
MAIL = frozenset("gmail.com outlook.com hotmail.com yahoo.com icloud.com proton.me gmx.de web.de orange.fr example.com example.org".split())
TITLES = frozenset("Dear Dr Frau Herr Madame Miss Monsieur Mr Mrs Ms Señor Señora".split())
CUES = {
    "email": "mail e-mail contact write correo courriel",
    "ip": "ip address host server login dirección adresse",
    "card": "card visa mastercard amex credit tarjeta carte karte",
    "phone": "phone call tel fax mobile teléfono téléphone telefon",
    "iban": "iban account bank konto cuenta compte",
    "national_id": "ssn social security",
    "local_phone": "phone call tel fax mobile",
    "name": "name mr mrs ms dr dear sincerely signed herr frau señor señora monsieur madame",
}
DENIALS = "version v release isbn issn doi figure section chapter licensed license".split()
CUE = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, v.split())) + r")\b", re.I) for k, v in CUES.items()}
DENIAL = re.compile(r"\b(?:" + "|".join(DENIALS) + r")\W*$", re.I)

LABELERS = ("shape", "validity", "gazetteer", "context", "neighbours", "boundary")
LENGTHS = 4
NEAR, BEFORE = 100, 40
#: Votes of each labeler taken to be right, of 20, before anything is counted.
RIGHT, PRIOR, ROUNDS = np.array([16.0, 18.0, 18.0, 17.0, 11.0, 16.0]), 20.0, 60


def emails(text: str) -> list[tuple[int, int]]:
    """Each domain is extended to the left as far as its local part reaches; linear, as no @ lies in either."""
    out, free = [], 0
    for m in DOMAIN.finditer(text):
        if m.start() <= free:
            continue
        seen = text.rfind("@", free, m.start()) + 1
        part = text[max(free, seen) : m.start()]
        size = len(part) - len(part.rstrip(LOCAL))
        if size:
            out.append((m.start() - size, m.end()))
            free = m.end()
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four fixed kinds, in order."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of further kinds that overlap no base span and no earlier candidate."""
    found = []
    for k, kind in enumerate(ADDED, len(BASE)):
        for m in EXTRA[kind].finditer(text):
            start = m.start()
            if kind == "name":
                while (space := text.find(" ", start, m.end())) >= 0 and text[start:space] in TITLES:
                    start = space + 1
                if space < 0:
                    continue
            found.append((start, k, m.end()))
    taken: list[list[int]] = []  # base spans of different kinds may overlap; here they are joined
    for a, _, b in base:
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    out, at, free = [], 0, 0
    for a, k, b in sorted(found):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= free and not (at < len(taken) and taken[at][0] < b):
            out.append((a, k, b))
            free = b
    return out


def _valid(kind: str, s: str) -> int:
    if kind == "email":
        last = s.rpartition(".")[2]
        return 2 if len(last) > 1 and last.isalpha() else 1
    if kind == "ip":
        parts = s.split(".")
        return 1 if any(len(p) > 1 and p[0] == "0" for p in parts) or all(int(p) < 20 for p in parts) else 2
    if kind == "card":
        return 2 if s[0] in "3456" else 1
    if kind == "phone":
        return 1 if s[1] == "0" else 2
    if kind == "iban":
        s = s.replace(" ", "")
        return 2 if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else 1
    if kind == "national_id":
        return 1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 2
    if kind == "local_phone":
        return 2 if s.lstrip("(")[0] in "23456789" else 1
    return 0


def votes(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    """The pattern number of each span: kind, one vote (0 abstain, 1 no, 2 yes) of each labeler, length."""
    out = []
    for i, (a, k, b) in enumerate(spans):
        kind, s = KINDS[k], text[a:b]
        cast = [0 if kind in ("local_phone", "name") else 2, _valid(kind, s), 0]
        if kind == "name":
            cast[2] = 2 if s.split(" ")[0] in GIVEN else 1
        elif kind == "email" and s.rpartition("@")[2].lower() in MAIL:
            cast[2] = 2
        before = text[max(0, a - BEFORE) : a]
        cast.append(1 if DENIAL.search(before) else 2 if CUE[kind].search(before) else 0)
        near = (i > 0 and a - spans[i - 1][2] <= NEAR) or (i + 1 < len(spans) and spans[i + 1][0] - b <= NEAR)
        cast.append(2 if near else 0)
        edge = (a > 0 and (text[a - 1].isalnum() or text[a - 1] == "_")) or (b < len(text) and (text[b].isalnum() or text[b] == "_"))
        cast.append(1 if edge else 0)
        number = k
        for vote in cast:
            number = number * 3 + vote
        out.append(number * LENGTHS + min(LENGTHS - 1, (b - a) // 10))
    return out


def taken_apart(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kind, votes (one column per labeler) and length of each pattern."""
    length, rest = patterns % LENGTHS, patterns // LENGTHS
    cast = np.zeros((len(patterns), len(LABELERS)), np.int64)
    for j in reversed(range(len(LABELERS))):
        cast[:, j], rest = rest % 3, rest // 3
    return rest, cast, length


def reliabilities(kind: np.ndarray, cast: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: chance of personal data for each pattern, and P(right vote | voted) of each labeler."""
    prior, right = np.full(len(KINDS), 0.5), np.repeat(RIGHT[:, None] / PRIOR, 2, axis=1)
    chance = np.zeros(len(count))
    for _ in range(ROUNDS):
        yes, no = np.log(prior[kind]), np.log(1 - prior[kind])
        for j in range(len(LABELERS)):
            # right[j, 1]: votes yes on personal data; right[j, 0]: votes no on other
            yes += np.choose(cast[:, j], [0.0, np.log(1 - right[j, 1]), np.log(right[j, 1])])
            no += np.choose(cast[:, j], [0.0, np.log(right[j, 0]), np.log(1 - right[j, 0])])
        chance = 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))
        good, bad = count * chance, count * (1 - chance)
        for k in range(len(KINDS)):
            prior[k] = (good[kind == k].sum() + 1) / (count[kind == k].sum() + 2)
        for j in range(len(LABELERS)):
            voted = cast[:, j] > 0
            right[j, 1] = (good[cast[:, j] == 2].sum() + RIGHT[j]) / (good[voted].sum() + PRIOR)
            right[j, 0] = (bad[cast[:, j] == 1].sum() + RIGHT[j]) / (bad[voted].sum() + PRIOR)
    return chance, right


def features(patterns: np.ndarray) -> np.ndarray:
    kind, cast, length = taken_apart(patterns)
    parts = [np.eye(len(KINDS))[kind], np.eye(LENGTHS)[length]]
    parts += [(cast == 2).astype(float), (cast == 1).astype(float)]
    return np.concatenate(parts, axis=1)


@dataclass
class Classifier:
    weights: np.ndarray
    right: np.ndarray

    def chance(self, patterns: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(patterns) @ self.weights, -500, 500)))


def fit(patterns: np.ndarray, count: np.ndarray) -> Classifier:
    """Logistic regression on the soft labels, by Newton steps with an L2 penalty; patterns weigh by the logarithm of their count."""
    if not len(patterns):
        return Classifier(np.zeros(features(patterns).shape[1]), np.zeros((len(LABELERS), 2)))
    kind, cast, _ = taken_apart(patterns)
    chance, right = reliabilities(kind, cast, count.astype(float))
    x, w, weight = features(patterns), np.zeros(features(patterns).shape[1]), np.log1p(count)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (weight * (p - chance)) + 0.1 * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return Classifier(w, right)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def train(docs: DataFrame) -> Classifier:
    """Count the vote patterns of all candidates in all texts, then fit."""

    def run(batches):
        count: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    spans = sorted(base + candidates(text, base))
                    for p in votes(text, spans) if spans else ():
                        count[p] = count.get(p, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.int64()), pa.array(count.values(), pa.int64())], names=["pattern", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pattern long, n long")
    found = sorted((r["pattern"], r["n"]) for r in counted.groupBy("pattern").agg(F.sum("n").alias("n")).collect())
    return fit(np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64))


def spans_of(text: str, model: Classifier, known: dict[int, bool]) -> tuple[list, list]:
    """(base spans, all spans) of one text."""
    base = base_spans(text)
    extra = candidates(text, base)
    if not extra:
        return base, base
    every = sorted(base + extra)
    kept = []
    for span, pattern in zip(every, votes(text, every), strict=True):
        if span[1] >= len(BASE):
            if pattern not in known:
                known[pattern] = bool(model.chance(np.array([pattern]))[0] >= 0.5)
            if not known[pattern]:
                continue
        kept.append(span)
    return base, kept


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def find(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """Counts and places of personal data in every text."""
    model = model or train(docs)

    def run(batches):
        known: dict[int, bool] = {}
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = spans_of(text or "", model, known)
                count = [0] * len(BASE)
                for _, k, _ in base:
                    count[k] += 1
                rows.append((*count, hashlib.sha256(told(base).encode()).hexdigest(), told(every)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            arrays = [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, free = [], 0
    for a, k, b in spans:
        if a >= free:
            out += [text[free:a], f"[{KINDS[k].upper()}]"]
        free = max(free, b)
    return "".join([*out, text[free:]])


def redact(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """The rows of ``docs`` with personal data masked in ``text`` (and ``n_chars``, if there, set anew)."""
    model = model or train(docs)
    where, schema = docs.columns.index("text"), docs.schema
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns and isinstance(schema["n_chars"].dataType, LongType) else None

    def run(batches):
        known: dict[int, bool] = {}
        for batch in batches:
            texts, columns = batch.column(where).to_pylist(), list(batch.columns)
            new = [masked(t, spans_of(t, model, known)[1]) if t else t for t in texts]
            columns[where] = pa.array(new, pa.string())
            if size is not None:
                old = columns[size].to_pylist()
                columns[size] = pa.array([o if n is t or n == t else len(n) for o, n, t in zip(old, new, texts, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
