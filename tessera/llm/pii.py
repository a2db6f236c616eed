"""Personal data: high-recall generators propose overlapping spans, boosted trees score them, calibrated thresholds choose."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

KINDS = ("email", "ip", "card", "phone", "number", "handle", "iban")

# The base patterns. A look-behind stands where a match can only start at a run's start, so that a run
# of any length costs its length and not its square.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
#: Generators of the method: groups of digits with separators, and handles after an at sign.
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9(][0-9()./\x20-]{5,}[0-9](?![0-9A-Za-z])")
_HANDLE = re.compile(r"(?<![A-Za-z0-9._%+-])@[A-Za-z_][A-Za-z0-9_.]{2,}")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod_97(s: str) -> bool:
    """Whether an account number's check digits hold."""
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, leftmost non-overlapping per kind; failing matches are dropped, not retried."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the wide generators; spans may overlap each other and base spans."""
    out = []
    if _DIGIT.search(text):
        out += [(6, m.start(), m.end()) for m in _IBAN.finditer(text)]
        for m in _NUMBER.finditer(text):
            out.append((4, m.start(), m.end()))
            # the same run without a bracket or a first group is a proposal of its own
            if (cut := m[0].find(" ")) > 0 and len(m[0]) - cut > 7:
                out.append((4, m.start() + cut + 1, m.end()))
    if "@" in text:
        out += [(5, m.start(), m.end()) for m in _HANDLE.finditer(text)]
    return out


# Words before a candidate that speak for or against it.
FOR = ("phone", "tel", "telephone", "call", "mobile", "fax", "whatsapp", "contact", "card", "ssn", "account", "konto", "iban", "passport", "twitter", "insta", "instagram", "follow", "reach", "text", "dial")
AGAINST = ("version", "page", "pages", "total", "chapter", "figure", "isbn", "price", "usd", "eur", "year", "years", "section", "order", "score", "build", "sku", "model", "part", "issue", "row", "line", "seed")

NAMES = ("kind", "digits", "length", "groups", "separators", "dots", "slashes", "brackets", "longest", "luhn", "grouped_3_4", "for", "against", "date_like", "decimal_like", "starts_zero", "check_97")


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format of the candidate and context of up to 24 characters before it."""
    kind, a, b = span
    s, before = text[a:b], text[max(0, a - 24) : a].lower()
    digits = "".join(_DIGIT.findall(s))
    groups = [g for g in re.split(r"[^0-9]+", s) if g]
    words = set(re.findall("[a-z]+", before))
    return [
        float(kind), float(len(digits)), float(b - a), float(len(groups)), float(sum(c in " -" for c in s)), float(s.count(".")), float(s.count("/")), float(s.count("(")),
        float(max(map(len, groups), default=0)), float(len(digits) >= 12 and luhn(digits)), float(len(groups) >= 2 and all(len(g) in (2, 3, 4) for g in groups[-2:])),
        float(bool(words & set(FOR))), float(bool(words & set(AGAINST))), float(bool(re.fullmatch(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}", s))), float(s.count(".") == 1 and len(groups) == 2), float(digits.startswith("0")), float(kind == 6 and mod_97(s)),
    ]


def _iban(rng: random.Random) -> str:
    """A made account number whose check digits hold, with or without blanks."""
    country, body = rng.choice(("DE", "FR", "GB", "ES", "NL")), "".join(rng.choice("0123456789") for _ in range(rng.choice((14, 16, 18, 20))))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    s = f"{country}{check:02d}{body}"
    return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeded candidates in sentences, made by rule: formats that are private wherever they stand, formats that are so only
    behind a word that says so, and look-alikes that are not; a word that speaks against makes any of them public."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("aeilmnorstu") for _ in range(rng.randint(3, 10)))
    always = (lambda: (4, f"({d(3)}) {d(3)}-{d(4)}"), lambda: (4, f"{d(3)}-{d(3)}-{d(4)}"), lambda: (4, f"{d(3)}.{d(3)}.{d(4)}"), lambda: (4, f"{d(3)}-{d(2)}-{d(4)}"), lambda: (4, f"{d(4)} {d(4)} {d(4)} {d(4)}"), lambda: (4, f"0{d(3)} {d(3)} {d(3)}"), lambda: (4, f"0{d(2)}/{d(7)}"), lambda: (5, f"@{name()}{rng.choice(('_', '', '.'))}{d(rng.randint(1, 4))}"), lambda: (6, _iban(rng)))
    said = (lambda: (4, d(rng.randint(7, 15))), lambda: (4, f"0{d(rng.randint(7, 11))}"), lambda: (4, f"{d(4)} {d(4)}"), lambda: (4, f"{d(3)} {d(3)} {d(2)}"), lambda: (4, f"{d(3)}-{d(4)}"))
    never = (lambda: (4, f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)}"), lambda: (4, f"{d(2)}/{d(2)}/20{d(2)}"), lambda: (4, f"{d(5)}.{d(2)}"), lambda: (4, f"{rng.randint(1, 9)}.{d(2)}.{d(2)}.{d(3)}.{d(1)}"), lambda: (4, f"{d(2)} {d(2)} {d(2)} {d(1)}"), lambda: (4, f"19{d(2)}-20{d(2)}"), lambda: (5, f"@{rng.choice(('media', 'param', 'return', 'override', 'import', 'property', 'app.route'))}"), lambda: (6, f"{rng.choice(('AB', 'DE', 'XK'))}{d(2)} {d(4)} {d(4)} {rng.choice(('ABCD', d(4)))}"))
    rows, y = [], []
    for _ in range(n):
        made, lead = rng.choice((always, said, never)), rng.choice((FOR, AGAINST, ("the", "of", "und", "que", "le", "about", "nearly", "is")))
        kind, s = rng.choice(made)()
        word = rng.choice(lead)
        text = f"and {word}{rng.choice((' ', ': ', ' no. ', ' number '))}{s} then"
        at = text.index(s, 4 + len(word))
        x = features(text, (kind, at, at + len(s)))
        # of the look-alikes of an account number those that check out are one, whatever was meant
        private = bool(x[-1]) or (made is always and lead is not AGAINST) or (made is said and lead is FOR)
        rows.append(x)
        y.append(float(private and lead is not AGAINST if kind != 5 else private))
    return np.array(rows), np.array(y)


@dataclass(frozen=True)
class Trees:
    """Boosted trees of depth 2: (feature, cut, (feature, cut, low, high) below, the same above); then Platt's a and b, and
    the least chance at which a candidate of a kind is taken."""

    trees: tuple
    bias: float
    scale: tuple[float, float]
    thresholds: tuple[float, ...]

    def margin(self, x: list[float]) -> float:
        z = self.bias
        for f, c, low, high in self.trees:
            g, e, a, b = low if x[f] <= c else high
            z += a if x[g] <= e else b
        return z

    def chance(self, x: list[float]) -> float:
        a, b = self.scale
        return float(1 / (1 + np.exp(-(a * self.margin(x) + b))))


def _stump(x, g, h, rows):
    """Best (gain, feature, cut, low value, high value) on some rows."""
    best = None
    for f in range(x.shape[1]):
        v = x[rows, f]
        cuts = np.unique(v)
        for c in (cuts[:-1] + cuts[1:]) / 2 if len(cuts) > 1 else cuts:
            low = v <= c
            gl, hl, gt, ht = g[rows][low].sum(), h[rows][low].sum(), g[rows].sum(), h[rows].sum()
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, float(c), float(-gl / (hl + 1)), float(-(gt - gl) / (ht - hl + 1)))
    return best


def fit(n: int = 3000, trees: int = 40, rate: float = 0.3, precision: float = 0.98, seed: int = 11) -> Trees:
    """Newton boosting on made examples; Platt scaling and the threshold come from a part that no tree has seen.

    A kind's threshold is the least at which the precision among its candidates of the calibration part is at least ``precision``.
    """
    x, y = examples(n, seed)
    fit_x, fit_y, cal_x, cal_y = x[: n // 2], y[: n // 2], x[n // 2 :], y[n // 2 :]
    z, made = np.zeros(len(fit_y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - fit_y, p * (1 - p)
        _, f, c, _, _ = _stump(fit_x, g, h, np.arange(len(z)))
        low = np.flatnonzero(fit_x[:, f] <= c)
        high = np.flatnonzero(fit_x[:, f] > c)
        sides = []
        for rows in (low, high):
            _, sf, sc, a, b = _stump(fit_x, g, h, rows) if len(rows) else (0, 0, 0.0, 0.0, 0.0)
            sides.append((sf, sc, rate * a, rate * b))
            z[rows] += np.where(fit_x[rows, sf] <= sc, rate * a, rate * b)
        made.append((f, c, *sides))
    raw = Trees(tuple(made), 0.0, (1.0, 0.0), ())
    m = np.array([raw.margin(list(r)) for r in cal_x])
    a, b = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(a * m + b)))
        a, b = a - 0.1 * ((p - cal_y) * m).mean(), b - 0.1 * (p - cal_y).mean()
    p = 1 / (1 + np.exp(-(a * m + b)))
    thresholds = []
    for kind in range(len(KINDS)):
        mine = cal_x[:, 0] == kind
        good = [t for t in np.unique(p[mine]) if cal_y[mine & (p >= t)].mean() >= precision]
        thresholds.append(float(min(good, default=1.01)))
    return Trees(tuple(made), 0.0, (float(a), float(b)), tuple(thresholds))


def find_spans(text: str | None, model: Trees) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, float]]]:
    """Base spans, and added ones with their chance: accepted proposals that cross no base span, best first."""
    t = text or ""
    base = sorted(base_spans(t))
    proposed = proposals(t)
    if not proposed:
        return base, []
    fixed = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in fixed], list(accumulate((b for _, b in fixed), max))
    scored = []
    for s in proposed:
        i = bisect_left(starts, s[2])  # base spans that start before its end; does one of them end after its start?
        if not i or reach[i - 1] <= s[1]:
            x = features(t, s)
            if (p := model.chance(x)) >= model.thresholds[s[0]]:
                scored.append((p, s))
    added, taken = [], []  # disjoint spans in order
    # an account number that checks out goes before the numbers that stand in it
    for p, s in sorted(scored, key=lambda x: (x[1][0] != 6, -x[0], x[1][1], -x[1][2])):
        i = bisect_left(taken, (s[2], 0))
        if not i or taken[i - 1][1] <= s[1]:
            insort(taken, (s[1], s[2]))
            added.append((*s, p))
    return base, sorted(added)


def redact(text: str | None, model: Trees) -> str | None:
    """The text with every span replaced by its kind in brackets; null stays null."""
    if text is None:
        return None
    base, added = find_spans(text, model)
    out, at = [], 0
    for a, b, k in sorted((s[1], s[2], s[0]) for s in [*base, *added]):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, model: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: counts and digest of base spans, and all ``spans``. Null and empty texts have none.

    Spans are ``kind:start:end`` by kind as listed, then start, in code points.
    """

    def say(spans):
        return ",".join(f"{KINDS[s[0]]}:{s[1]}:{s[2]}" for s in spans)

    def run(c: dict[str, list]) -> dict[str, list]:
        got = [find_spans(t, model) for t in c["text"]]
        counts = {f"n_{KINDS[k]}": [sum(s[0] == k for s in base) for base, _ in got] for k in range(4)}
        return {"doc_id": c["doc_id"]} | counts | {"base_sha256": [hashlib.sha256(say(b).encode()).hexdigest() for b, _ in got], "spans": [say([*b, *a]) for b, a in got]}

    return map_columns(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
