"""Personal data (operator 8): offset-preserving deobfuscation.

Plain identifiers are found in the source text. Texts that may hide others pass
through transducers, each of which rewrites the text and keeps, for every
character it writes, the span of source characters it came from:

1. characters: homoglyphs, full-width forms, odd spaces and dashes to ASCII;
   invisible characters dropped;
2. words: spelled digits in runs (English, German, French, Spanish), "plus"
   before them, and disguises such as "name (at) host [dot] tld".

Identifiers found in the rewritten text are mapped back to source spans and
added where they overlap no span found plainly.

Scale: one pass without shuffle, Arrow batches in, one row out per document.
Every scan is linear in the text, whatever it holds.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common

KINDS = ("email", "ip", "card", "phone")
CHUNK = 4 << 20

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A stretch that holds every match of _IP and _CARD that begins in it.
_NUMBERS = re.compile(r"[0-9](?:[\x20().0-9-]*[0-9])?")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def plain(text: str) -> list[Span]:
    """Identifiers as they stand, leftmost and without overlap within a kind; by kind, then start.

    An address can only end a run of local characters at an @, so each @ is
    looked at once, with the run before it.
    """
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(at + 1, done))
    ips: list[Span] = []
    cards: list[Span] = []
    for run in _NUMBERS.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        for m in _IP.finditer(text, a, b):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                ips.append(("ip", *m.span()))
        if b - a >= 13:
            for m in _CARD.finditer(text, a, b):
                digits = _NOT_DIGIT.sub("", m[0])
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    cards.append(("card", *m.span()))
    found += ips + cards
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


def _glyphs() -> dict[int, str | None]:
    """What the first transducer writes for a character; None: nothing."""
    table: dict[int, str | None] = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
    for first in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):  # other scripts' and styled digits
        table |= {first + d: str(d) for d in range(10)}
    for first in range(0x1D400, 0x1D6A4, 26):  # styled Latin letters, capitals and small in turn
        table |= {first + k: chr((97 if (first - 0x1D400) // 26 % 2 else 65) + k) for k in range(26)}
    # Letters of Cyrillic and Greek that look Latin.
    for odd, seen in (("аеорсухіјѕԁһԛԝ", "aeopcyxijsdhqw"), ("АВЕКМНОРСТХІЈЅ", "ABEKMHOPCTXIJS"), ("οανικρτυχε", "oavikptuxe"), ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")):
        table |= dict(zip(map(ord, odd), seen, strict=True))
    table |= {c: " " for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
    table |= {c: "-" for c in (*range(0x2010, 0x2016), 0x2212, 0xFE58, 0xFE63)}
    table |= {c: "." for c in (0x2024, 0x3002, 0xFF61)} | {0xFE6B: "@", 0xFE62: "+"}
    table |= dict.fromkeys((0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF, 0x180E))
    return table


_GLYPH = _glyphs()
_ODD = re.compile("[" + "".join(map(chr, sorted(_GLYPH))).replace("-", "\\-") + "]")
_ODD_SET = frozenset(map(chr, _GLYPH))
#: Bytes that occur in no character of _GLYPH but as ASCII, continuation or the lead byte of Latin-1 letters.
_USUAL = bytes(b for b in range(256) if b < 0xC2 or b == 0xC3)

#: The digits 0 to 9 as words.
_DIGIT = {
    w: str(d)
    for d, words in enumerate(
        (
            "zero oh null zéro cero",
            "one eins un uno",
            "two zwei zwo deux dos",
            "three drei trois tres",
            "four vier quatre cuatro",
            "five fünf cinq cinco",
            "six sechs seis",
            "seven sieben sept siete",
            "eight acht huit ocho",
            "nine neun neuf nueve",
        )
    )
    for w in words.split()
}
_ANY = "|".join(sorted(_DIGIT, key=len, reverse=True))
_DOT = r"dot|punkt|point|punto"
_GAP = r"[\x20,\-]{1,3}"
_WORDS = re.compile(rf"(?:\bplus{_GAP})?\b(?:{_ANY})(?:(?:{_GAP}|\x20?\.\x20?)(?:{_ANY}|{_DOT})){{3,}}\b", re.I)
#: Two digits in words: what every match of _WORDS has, and few other texts; on lower-case text.
_TWO = re.compile(rf"\b(?:{_ANY}){_GAP}(?:{_ANY}|{_DOT})\b|\b(?:{_ANY})\x20?\.")
_WORD = re.compile(rf"\bplus\b|\b(?:{_ANY})\b|\b(?:{_DOT})\b|\.", re.I)
_OPEN, _CLOSE = r"[\[({<]\x20?", r"\x20?[\])}>]"
_MARKED = re.compile(rf"\x20?(?:{_OPEN}(?:(at)|{_DOT}){_CLOSE})\x20?", re.I)
#: Bare words only where a whole address is spelled: name at host dot tld, once the marked ones are rewritten.
_NAME, _LABEL = r"[A-Za-z0-9._%+-]{1,64}+", r"[A-Za-z0-9-]{1,63}+"
_BARE = re.compile(rf"(?<![A-Za-z0-9])({_NAME}(?:\x20dot\x20{_NAME}){{0,8}})(@|\x20at\x20)({_LABEL}(?:(?:\.|\x20dot\x20){_LABEL}){{1,8}})", re.I)
_BARE_DOT = re.compile(r"\x20dot\x20", re.I)
_HINT = re.compile(r"\x20dot\x20|[\[({<]\x20?(?:at|dot|punkt|point|punto)\x20?[\])}>]")


class Traced:
    """A text with, for each character, the span of source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans, in order and apart; a written character stands for its whole span."""
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends = starts + self.starts[at:], ends + self.ends[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Edits that write runs of spelled digits as digits, "dot" and points between them kept as points."""
    edits = []
    for run in _WORDS.finditer(text):
        wrote = "".join("+" if w == "plus" else "." if w == "." else _DIGIT.get(w, ".") for w in (m[0].lower() for m in _WORD.finditer(run[0])))
        edits.append((*run.span(), wrote))
    return edits


def _marks(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "@" if m[1] else ".") for m in _MARKED.finditer(text)]


def _bare(text: str, marked: list[int]) -> list[tuple[int, int, str]]:
    """Edits of bare words, given where marked ones were rewritten: " at " before plain points only is prose."""
    edits, at = [], 0
    while m := _BARE.search(text, at):
        name, host = ([(*d.span(), ".") for d in _BARE_DOT.finditer(text, *m.span(k))] for k in (1, 3))
        k = bisect_left(marked, m.start(3))
        found = name + host if m[2] == "@" else [*name, (*m.span(2), "@"), *host]
        if found and (m[2] == "@" or host or (k < len(marked) and marked[k] < m.end(3))):
            edits += found
            at = m.end()
        else:
            at = m.start(3)
    return edits


def hidden(text: str) -> list[Span]:
    """Identifiers that only the rewritten text shows, as source spans; [] for texts without a disguise."""
    odd = not text.isascii() and bool(text.encode("utf-8", "replace").translate(None, _USUAL)) and not _ODD_SET.isdisjoint(text)
    low = text.lower()
    if not odd and _HINT.search(low) is None and (_TWO.search(low) is None or _WORDS.search(text) is None):
        return []
    traced, touched = Traced(text), False
    if odd:
        traced.rewrite([(m.start(), m.end(), _GLYPH[ord(m[0])] or "") for m in _ODD.finditer(text)])
        touched = True
    marked: list[int] = []
    for edits in (_spelled, _marks, lambda text: _bare(text, marked)):
        if found := edits(traced.text):
            traced.rewrite(found)
            touched = True
            if edits is _marks:
                shorter = accumulate((b - a - 1 for a, b, _ in found), initial=0)
                marked += [a - less for (a, _, _), less in zip(found, shorter, strict=False)]
    return [(kind, *traced.source(a, b)) for kind, a, b in plain(traced.text)] if touched else []


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans): the plain ones stay, others come where they overlap none of them."""
    base = plain(text)
    more = hidden(text)
    if not more:
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    new = []
    for kind, a, b in more:
        k = bisect_left(taken, (a, b))
        if all(b <= x or a >= y for x, y in taken[max(0, k - len(KINDS)) : k + 1]):
            new.append((kind, a, b))
    return base, sorted(base + new, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _told(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the plain spans' count by kind and digest, and all spans, of each whole text.

    Offsets count code points. A null or empty text has no spans. Bytes that are
    no UTF-8 count as U+FFFD. Repeated rows give repeated rows, an empty table
    none; columns other than doc_id and text are not read.
    """
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches):
        for batch in common.pieces(batches, "text", CHUNK):
            counts: list[list[int]] = [[] for _ in KINDS]
            digest, told = [], []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                base, every = spans(raw.decode("utf-8", "replace")) if raw else ([], [])
                for n, kind in zip(counts, KINDS, strict=True):
                    n.append(sum(s[0] == kind for s in base))
                digest.append(hashlib.sha256(_told(base).encode()).hexdigest())
                told.append(_told(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(n, pa.int64()) for n in counts), pa.array(digest), pa.array(told)], schema.names)

    common.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def masked(text: str) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans one mask for all."""
    found = sorted((a, b, k) for k, a, b in spans(text)[1])
    out, at = [], 0
    for a, b, kind in found:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text; null stays null, other columns stay as they are."""
    schema = docs.schema
    place = schema.names.index("text")

    def run(batches):
        for batch in common.pieces(batches, "text", CHUNK):
            out = [None if raw is None else masked(raw.decode("utf-8", "replace")) for raw in batch.column(place).cast(pa.binary()).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    common.small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
