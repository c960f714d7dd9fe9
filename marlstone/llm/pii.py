"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.text import plain_text, text_batches

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
# A proposed span stays from this score on.
BAR = 0.5
# Characters looked at on either side of a span.
NEARBY = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])")
_SSN = re.compile(r"(?<![0-9A-Za-z.-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])")
_DIGITS = re.compile(r"[0-9]")

# Words that speak for a kind when they stand near a span, and words that speak against any.
_FOR = {
    "phone": r"phone|telephone|tel|call|mobile|cell|fax|telefon|handy|téléphone|teléfono|móvil",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social security|sozialversicherung|sécurité sociale|seguridad social",
    "card": r"card|visa|mastercard|credit|karte|carte|tarjeta",
    "email": r"mail|e-mail|contact|kontakt|correo|courriel",
    "ip": r"ip|host|server|address|adresse|dirección",
}
_FOR = {kind: re.compile(rf"(?<!\w)(?:{x})(?!\w)") for kind, x in _FOR.items()}
_AGAINST = re.compile(r"(?<!\w)(?:isbn|issn|order|invoice|version|part no|serial|doi)(?!\w)")


def luhn(digits: str) -> bool:
    """The check of payment card numbers: every second digit from the right doubled, sum divisible by ten."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def mod97(account: str) -> bool:
    """The check of international account numbers: first four characters last, letters as 10 to 35."""
    plain = account.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ backwards, so that a long run of letters is read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = start < at and _DOMAIN.match(text, at + 1)
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Each run of dotted numbers gives its numbers in fours, from the left."""
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        start = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, end
            start = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end (code points, end exclusive) by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [("ip", a, b) for a, b in _addresses(text)] if "." in text else []
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def _score(kind: str, start: float, text: str, a: int, b: int) -> float:
    """The pattern's own score, raised or lowered by the words around the span."""
    around = f"{text[max(0, a - NEARBY) : a]} \n {text[b : b + NEARBY]}".lower()
    return min(1.0, max(0.0, start + 0.4 * bool(_FOR[kind].search(around)) - 0.3 * bool(_AGAINST.search(around))))


def spans(text: str, base: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int, float]]:
    """All spans with scores: the base ones, and proposals that reach the bar and overlap no span before them.

    Characters in a span are marked, so a proposal costs its own length, however many spans there are.
    """
    base = base_spans(text) if base is None else base
    out = [(k, a, b, max(BAR, _score(k, 0.6, text, a, b))) for k, a, b in base]
    if not _DIGITS.search(text):
        return out
    proposals = [("iban", m.start(), m.end(), 0.7) for m in _IBAN.finditer(text) if mod97(m.group())]
    proposals += [("phone", m.start(), m.end(), 0.5 if m.group()[0] == "(" else 0.3) for m in _LOCAL_PHONE.finditer(text)]
    proposals += [("ssn", m.start(), m.end(), 0.3) for m in _SSN.finditer(text)]
    if not proposals:
        return out
    used = bytearray(len(text))
    for _, a, b in base:
        used[a:b] = bytes((1,)) * (b - a)
    for kind, a, b, start in proposals:
        score = _score(kind, start, text, a, b)
        if score >= BAR and used.find(1, a, b) < 0:
            out.append((kind, a, b, score))
            used[a:b] = bytes((1,)) * (b - a)
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def redacted(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """Spans replaced by their kind in angle brackets; of overlapping ones the first stays, joined with the next."""
    out, done = [], 0
    for kind, a, b, _ in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


_SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
_SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())])
)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``spans`` and ``redacted`` text of every row's whole text; no shuffle.

    Base patterns (email, ip, card, phone) always stay once their checks hold. The others, account
    numbers checked by mod 97, phone numbers without country code and social security numbers, stay
    if their score with the words nearby reaches the bar. All searches are linear in the text.

    Null and empty texts have no spans; a null text stays null when redacted. Repeated rows stay.
    Other columns are ignored. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            likely = pc.match_substring_regex(texts, "[0-9@]").to_pylist()
            found, clean = [], texts.to_pylist()
            for i, (text, look) in enumerate(zip(clean, likely, strict=True)):
                checked = base_spans(text) if look else []
                own = spans(text, checked) if look else []
                if own:
                    clean[i] = redacted(text, own)
                base = set(checked)
                found.append(
                    [{"kind": k, "start": a, "end": b, "score": s, "base": (k, a, b) in base} for k, a, b, s in own]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, _SPAN_TYPE), pa.array(clean, pa.string()), batch.column("absent")],
                ["doc_id", "spans", "redacted", "absent"],
            )

    rows = docs.select("doc_id", plain_text().alias("text"), F.col("text").isNull().alias("absent"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, spans {_SPANS}, redacted string, absent boolean")
    return out.select("doc_id", "spans", F.when(~F.col("absent"), F.col("redacted")).alias("redacted"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with their texts redacted in place; other columns are as they were, null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            clean = [redacted(t, spans(t)) if t else t for t in batch.column(at).cast(pa.string()).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, pa.string()).cast(batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _joined(condition: str) -> Column:
    return F.expr(f"array_join(transform(filter(spans, s -> {condition}), s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, a hash of the base spans, and all spans as a string."""
    counts = [F.expr(f"size(filter(spans, s -> s.base and s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined("s.base"), 256).alias("base_sha256"), _joined("true").alias("spans"))


def brute_digest(text: str) -> str:
    """Base spans of a text by the plain patterns, for tests."""
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            fine = {
                "email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return hashlib.sha256(",".join(out).encode()).hexdigest()
