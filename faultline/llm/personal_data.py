"""Personal data: patterns propose, checksums confirm, context words weigh.

Four kinds of spans (e-mail, IP address, payment card, phone) are fixed: what
their pattern matches and their check confirms is reported. The method adds
spans of further kinds when their score reaches ``THRESHOLD``: IBANs confirmed
by mod-97, shorter card numbers confirmed by Luhn, and numbers of the form of a
social security number. A score starts at the kind's own value, rises for each
supporting word within ``REACH`` characters, and falls for each opposing one, so
that a bare number is not enough where a checksum is weak.

Defined cases. A null text is an empty one. Kinds are reported in the order of
``KINDS`` and by start; a span may lie inside one of another kind. Positions are
code points, ends exclusive. Rows are independent, so repeated rows, ties and
other columns need no rule.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the kinds in order, and their patterns
KINDS = ("email", "ip", "card", "phone", "iban", "short_card", "ssn")
N_BASE = 4
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits: it would have started at its front
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}"
    r"(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
)
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# --- fixed values: own score of each kind, and the words that change it
SCORES = {
    "email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.9, "short_card": 0.3, "ssn": 0.3
}
SUPPORT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "kontakt"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
SUPPORT["short_card"] = SUPPORT["card"]
OPPOSE = ("example", "version", "isbn", "order", "invoice", "sample", "test")
THRESHOLD = 0.5
REACH = 40
STEP = 0.25
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")

Span = tuple[int, int, int]  # place of the kind in KINDS, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    """Around each @, as a pattern would try every start of every long word."""
    found, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((0, start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def _in_range(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The fixed kinds, by kind and start."""
    found = _emails(text)
    found += [
        (1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_in_range, m[0].split(".")))
    ]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [
            (3, m.start(), m.end())
            for m in _PHONE.finditer(text)
            if 8 <= len(_digits(m[0])) <= 15
        ]
    return found


def _proposed(text: str) -> list[Span]:
    """Spans of the further kinds that pass their checks."""
    found = []
    for m in _IBAN.finditer(text):
        end = m.end()
        # a grouped number may have run on into capital words
        while end > m.start():
            compact = text[m.start() : end].replace(" ", "")
            if not 15 <= len(compact) <= 34:
                if len(compact) < 15:
                    break
            elif mod97(compact):
                found.append((4, m.start(), end))
                break
            end = text.rfind(" ", m.start(), end)
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 15 and luhn(d):
            found.append((5, m.start(), m.end()))
    found += [(6, m.start(), m.end()) for m in _SSN.finditer(text)]
    return found


def score(text: str, span: Span) -> float:
    """The kind's own score, changed by the words around the span."""
    kind, start, end = span
    name = KINDS[kind]
    near = f"{text[max(0, start - REACH) : start]} | {text[end : end + REACH]}".lower()
    words = set(_WORD.findall(near))
    change = len(words & set(SUPPORT[name])) - len(words & set(OPPOSE))
    return round(min(1.0, max(0.0, SCORES[name] + STEP * change)), 2)


def find_personal_data(text: str) -> tuple[list[Span], list[Span], list[float]]:
    """Base spans, all spans, and the score of each of all."""
    base = base_spans(text)
    added = [s for s in _proposed(text) if score(text, s) >= THRESHOLD]
    spans = base + added
    return base, spans, [score(text, s) for s in spans]


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


_COUNTS = tuple(f"n_{k}" for k in KINDS)
PERSONAL_TYPE = (
    f"struct<{','.join(f'{c}:bigint' for c in _COUNTS)},base:string,spans:string,scores:array<double>>"
)


def personal_column(text: Column) -> Column:
    """Counts, spans and scores of the personal data in each text."""

    def find(column: pa.Array) -> pa.Array:
        rows = []
        for t in column.to_pylist():
            base, spans, scores = find_personal_data(t or "")
            counts = [sum(s[0] == k for s in spans) for k in range(len(KINDS))]
            rows.append((*counts, _listed(base), _listed(spans), scores))
        kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2 + [pa.list_(pa.float64())]
        names = [*_COUNTS, "base", "spans", "scores"]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, names)

    return F.arrow_udf(find, PERSONAL_TYPE).asNondeterministic()(text)


def personal_spans(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(``key``, counts, base_sha256, spans, scores) of every row."""
    found = df.select(F.col(key), personal_column(F.col(text)).alias("_p"))
    return found.select(
        key,
        *[F.col(f"_p.{c}") for c in _COUNTS[:N_BASE]],
        F.sha2(F.col("_p.base"), 256).alias("base_sha256"),
        "_p.spans",
        "_p.scores",
        *[F.col(f"_p.{c}") for c in _COUNTS[N_BASE:]],
    )
