"""Personal data in texts, plain and disguised, with offsets into the source.

Plain identifiers are found by the contract's patterns. For disguised ones the text passes a chain of transducers, each of
which rewrites pieces of it and keeps, for every character, the stretch of the source that it stands for: look-alike
characters and foreign digits become ASCII and invisible ones go; bracketed or spelled "at" and "dot" become signs; spelled digits and
letters that stand for digits become digits. The same patterns and checks then run on what comes out, and a find is mapped
back to the source. It is added if a transducer touched it, if no letter of another script adjoins it, and if no plain find of its kind holds it.

All patterns take time in proportion to the text: an email is looked for around each "@", a digit run is tried once, and
the disguises' gaps and names are bounded (64 characters before the "@", 63 a label, as in mail addresses).

Defined results: null and empty texts have no spans; rows are judged one by one, so repeated rows get equal results and null ids
stay null; plain finds of a kind never overlap, an added find may hold a plain one; ties by kind, start, end; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The contract's patterns, with a start that is tried once in each run of digits.
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters that look like ASCII ones (Cyrillic, Greek, Armenian), and marks that stand for others.
LOOK_ALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһӏ", "ABESIJKMHOPCTYXaesijopcyxdqwhl", strict=True))
LOOK_ALIKES |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυωϲϳօսոհ", "ABEZHIKMNOPTYXaivopuwcjounh", strict=True))
LOOK_ALIKES |= dict(zip("。․‧∙·‑‒–—−ʘ", "....." + "-----" + "O", strict=True))
#: Last labels that a domain without a literal dot has to end in.
LAST_LABELS = "com|org|net|edu|gov|mil|int|info|biz|io|co|dev|app|ai|me|tv|eu|uk|us|ca|au|de|fr|es|it|nl|be|ch|at|pt|pl|se|no|dk|fi|mx|ar|br|cl|jp|cn|in|ru"
#: Zero to nine in four languages, and words for nought.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine".split(),
    "cero uno dos tres cuatro cinco seis siete ocho nueve".split(),
    "zéro un deux trois quatre cinq six sept huit neuf".split(),
    "null eins zwei drei vier fünf sechs sieben acht neun".split(),
)
NOUGHT = ("oh", "nought", "naught")
TIMES = {"double": 2, "triple": 3}
AT, DOT, PLUS = "at|arroba|arobase", "dot|period|punto|point|punkt", "plus|más|mas"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """The leftmost matches: a local part cannot hold an "@", so each one begins where the letters before its "@" do."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield "email", start, last
        at = text.find("@", max(at + 1, last))


def ips(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in m.groups()):
            yield "ip", *m.span()


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            yield "card", *m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                yield "phone", *m.span()


def plain_spans(text: str) -> list[Span]:
    """The contract's spans, by kind and start."""
    return [*emails(text), *ips(text), *cards(text), *phones(text)]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Tape:
    """A text that transducers rewrite; start, end: the source that each character stands for; touched: whether it is not the source's."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.touched = np.zeros(len(text), bool)

    def rewrite(self, pieces: list[tuple[int, int, str]]) -> None:
        """Replaces stretches (start, end, by what), in order and apart from each other; each new character stands for all of its stretch."""
        if not pieces:
            return
        a, b = (np.array([p[i] for p in pieces]) for i in (0, 1))
        before = np.concatenate([[0], b])
        # what stays before each piece, and the piece, in turns
        size = np.zeros(2 * len(pieces) + 1, np.int64)
        size[0::2], size[1::2] = np.concatenate([a, [len(self.text)]]) - before, [len(p[2]) for p in pieces]
        first, last, new = np.zeros_like(size), np.zeros_like(size), np.arange(len(size)) % 2 == 1
        first[0::2], first[1::2], last[1::2] = before, a, b - 1
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        new, first, last = np.repeat(new, size), np.repeat(first, size), np.repeat(last, size)
        i = np.where(new, first, first + within)
        j = np.where(new, last, i)
        # what follows a piece that went without anything in its place counts as touched
        self.touched[[y for _, y, n in pieces if not n and y < len(self.text)]] = True
        self.start, self.end, self.touched = self.start[i], self.end[j], self.touched[i] | new
        edges = [0, *b.tolist()]
        self.text = "".join([x for at, (start, _, n) in zip(edges, pieces, strict=False) for x in (self.text[at:start], n)]) + self.text[edges[-1] :]

    def respell(self, text: str) -> None:
        """Replaces characters one by one."""
        self.touched |= codes(text) != codes(self.text)
        self.text = text

    def drop(self, gone: np.ndarray) -> None:
        """Leaves out the marked characters; what follows them counts as touched."""
        self.touched[1:] |= gone[:-1]
        keep = ~gone
        self.text = codes(self.text)[keep].tobytes().decode("utf-32-le", "surrogatepass")
        self.start, self.end, self.touched = self.start[keep], self.end[keep], self.touched[keep]


def look_alikes() -> dict[str, str]:
    """What each disguised character becomes: by the compatibility form, the digit's value or the list above; "" for invisible ones."""
    out = dict(LOOK_ALIKES)
    for i in range(0x80, 0x20000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind == "Cf":
            out[c] = ""
        elif kind == "Zs":
            out[c] = " "
        elif kind == "Nd":
            out[c] = str(unicodedata.decimal(c))
        elif kind in ("Lu", "Ll", "Po", "Ps", "Pe", "Pd", "Pc", "Sm") and len(n := unicodedata.normalize("NFKC", c)) == 1 and n.isascii():
            out[c] = n
    return out


ALIKE = look_alikes()
def marks(chars: list[str]) -> np.ndarray:
    """A table of all code points below 0x20001 that is true at these."""
    out = np.zeros(0x20001, bool)
    out[[ord(c) for c in chars]] = True
    return out


DISGUISED, INVISIBLE = marks(list(ALIKE)), marks([c for c, n in ALIKE.items() if not n])


def marked(text: str, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(codes(text), len(table) - 1)]


RESPELLED = str.maketrans({c: n for c, n in ALIKE.items() if n})

GAP, TOKEN, LABEL = r"[ \t]{1,3}", r"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}", r"[A-Za-z0-9-]{1,63}"
BRACKETED = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,2}}(?:(?P<at>{AT}|@)|(?P<dot>{DOT}|\.))\s{{0,2}}[\])}}>]\s{{0,3}}", re.I)
BRACKET = re.compile(rf"[\[({{<]\s{{0,2}}(?:{AT}|@|{DOT}|\.)\s{{0,2}}[\])}}>]", re.I)
SPELLED_DOT = re.compile(rf"{GAP}(?:{DOT}){GAP}", re.I)
#: What may follow a plain "at" in prose.
NO_HOST = "the|a|an|this|that|these|those|its|our|your|my|his|her|their|one|any|some|every|each"
#: name dot name at host dot label: the last dot is spelled, or the sign stands between blanks.
SPELLED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<local>(?:{TOKEN}{GAP}(?:{DOT}){GAP}){{0,4}}{TOKEN})"
    rf"(?:(?P<at>{GAP}(?:{AT}){GAP}(?!(?:{NO_HOST}){GAP})|{GAP}@[ \t]{{0,3}}|@[ \t]{{0,3}})(?P<domain>(?:{LABEL}(?:{GAP}(?:{DOT}){GAP}|\.)){{0,5}}{LABEL}{GAP}(?:{DOT}){GAP}(?:{LAST_LABELS}))"
    rf"|(?P<sign>{GAP}@[ \t]{{0,3}}|@[ \t]{{1,3}})(?P<host>(?:{LABEL}\.){{1,5}}(?:{LAST_LABELS})))(?![A-Za-z0-9-])",
    re.I,
)


def digits_of(words: list[str]) -> tuple[dict[str, str], re.Pattern, re.Pattern]:
    """(value of each word, a run of at least three with numbers among them, its items) of a language."""
    value = {w: str(i) for i, w in enumerate(words)}
    if words[0] == "zero":
        value |= {w: "0" for w in NOUGHT}
    one = "|".join(sorted(value, key=len, reverse=True))
    times = "|".join(TIMES)
    item = rf"(?:(?:{times}){GAP})?(?:{one})"
    gap = r"(?:[ \t]{1,2}|[-.,][ \t]?)"
    number = rf"(?:{item}|[0-9]{{1,19}})(?![A-Za-z0-9])"
    dotted = rf"(?:{gap}|{GAP}(?:{DOT}){GAP})"
    # a sign, brackets or numbers may come before the first word, as in +1 (456) five five
    run = re.compile(rf"(?<![A-Za-z0-9])(?:(?P<plus>{PLUS}){GAP})?{number}(?:{dotted}{number})+", re.I)
    return value, run, re.compile(rf"(?:(?P<times>{times}){GAP})?(?P<word>{one})(?![A-Za-z0-9])|(?P<number>[0-9]+)|(?P<dot>{GAP}(?:{DOT}){GAP})", re.I)


LANGUAGES = [digits_of(words) for words in DIGIT_WORDS]
THREE_WORDS = [re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(v)})(?:[ \t.,-]{{1,2}}(?:(?:{'|'.join(TIMES)}|{DOT})[ \t]{{1,3}})?(?:{'|'.join(v)})(?![A-Za-z0-9])){{2}}", re.I) for v, _, _ in LANGUAGES]
#: A number with letters that look like digits, as in 4lll O0I2.
LETTER_DIGITS = re.compile(r"(?<![A-Za-z0-9])(?=[0-9OolI]*[0-9])[0-9OolI]*[OolI][0-9OolI]*(?![A-Za-z0-9])")
LETTER_DIGIT = str.maketrans("OolI", "0011")
NEAR_DIGIT = re.compile(r"[0-9][OolI]|[0-9](?<=[OolI].)")
NEAR_AT = re.compile(r"@[ \t]|@(?<=[ \t].)")
#: Lower-cased bytes with blanks for ASCII punctuation.
WORD_BYTES = bytes(ord(chr(i).lower()) if chr(i).isalnum() or i > 127 else 32 for i in range(128)) + bytes(range(128, 256))
DOT_WORDS = frozenset(w.encode() for w in DOT.split("|"))
COUNTING = frozenset(w.encode() for w in [*(w for v, _, _ in LANGUAGES for w in v), *TIMES]) | DOT_WORDS


def unmasked(tape: Tape) -> None:
    """Look-alikes and invisible characters."""
    if tape.text.isascii():
        return
    tape.respell(tape.text.translate(RESPELLED))
    gone = marked(tape.text, INVISIBLE)
    if gone.any():
        tape.drop(gone)


def signs(tape: Tape) -> None:
    """Bracketed, then spelled "at" and "dot"."""
    if BRACKET.search(tape.text):
        tape.rewrite([(*m.span(), "@" if m["at"] else ".") for m in BRACKETED.finditer(tape.text)])
    pieces = []
    for m in SPELLED.finditer(tape.text):
        at, host = ("at", "domain") if m["at"] else ("sign", "host")
        pieces += [(*d.span(), ".") for d in SPELLED_DOT.finditer(tape.text, *m.span("local"))]
        pieces.append((*m.span(at), "@"))
        pieces += [(*d.span(), ".") for d in SPELLED_DOT.finditer(tape.text, *m.span(host))]
    tape.rewrite(pieces)


def spelled_digits(tape: Tape) -> None:
    """Runs with three spelled digits or more become digits; where dots part the run, the digits of a part stand together."""
    for (value, run, items), three in zip(LANGUAGES, THREE_WORDS, strict=True):
        if not three.search(tape.text):
            continue
        pieces = []
        for m in run.finditer(tape.text):
            found = list(items.finditer(tape.text, *m.span()))
            if sum(bool(x["word"]) for x in found) < 3:
                continue
            if m["plus"]:
                pieces.append((m.start("plus"), found[0].start(), "+"))
            joined = any(x["dot"] for x in found)
            for x, y in zip(found, [*found[1:], None], strict=True):
                if x["word"]:
                    pieces.append((*x.span(), value[x["word"].lower()] * TIMES.get((x["times"] or "").lower(), 1)))
                elif x["dot"]:
                    pieces.append((*x.span(), "."))
                if y is not None and x.end() < y.start() and (joined or y.start() - x.end() > 1) and not (x["dot"] or y["dot"]):
                    pieces.append((x.end(), y.start(), "" if joined else " "))
        tape.rewrite(pieces)


def letter_digits(tape: Tape) -> None:
    tape.respell(LETTER_DIGITS.sub(lambda m: m.group().translate(LETTER_DIGIT), tape.text))


TRANSDUCERS: tuple[Callable[[Tape], None], ...] = (unmasked, signs, spelled_digits, letter_digits)


def disguised(text: str) -> bool:
    """Whether a transducer could touch the text at all: a quick look for what each of them needs."""
    if BRACKET.search(text) or NEAR_DIGIT.search(text) or ("@" in text and NEAR_AT.search(text)) or (not text.isascii() and marked(text, DISGUISED).any()):
        return True
    words = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
    counting = bytes(map(COUNTING.__contains__, words))
    return b"\1\1\1" in counting or (1 in counting and not DOT_WORDS.isdisjoint(words))


def added_spans(text: str, plain: list[Span]) -> list[Span]:
    """The spans that only the transducers show, in offsets of the source."""
    if not disguised(text):
        return []
    tape = Tape(text)
    for step in TRANSDUCERS:
        step(tape)
    touched = np.concatenate([[0], np.cumsum(tape.touched)])
    out = []
    for kind, a, b in plain_spans(tape.text):
        edges = tape.text[a - 1 : a] + tape.text[b : b + 1]
        if touched[a] == touched[b] or any(not c.isascii() and c.isalnum() for c in edges):
            continue
        start, end = int(tape.start[a]), int(tape.end[b - 1])
        if not any(k == kind and s <= start and end <= e for k, s, e in plain):
            out.append((kind, start, end))
    return out


def private_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether it is a plain one), by kind, start and end."""
    plain = plain_spans(text)
    both = [(*s, True) for s in plain] + [(*s, False) for s in added_spans(text, plain)]
    return sorted(both, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def masked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span, or stretch of spans that overlap, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def spans_column(with_text: bool = False) -> Callable[[Column], Column]:
    """The function of a text column that gives struct(spans) or struct(spans, masked), in Arrow batches."""
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())])
    fields = [pa.field("spans", pa.list_(one)), *([pa.field("masked", pa.string())] if with_text else [])]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            offsets, flat, texts = [0], [], []
            for x in batch:
                text = x.as_py() or ""
                spans = private_spans(text)
                flat += spans
                offsets.append(len(flat))
                if with_text:
                    texts.append(masked(text, spans))
            parts = [pa.array([s[i] for s in flat], f.type) for i, f in enumerate(one)]
            found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(one)))
            yield pa.StructArray.from_arrays([found, *([pa.array(texts, pa.string())] if with_text else [])], fields=fields)

    return F.arrow_udf(run, "spans array<struct<kind:string,start:long,end:long,plain:boolean>>" + ", masked string" * with_text)


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, spans) of each row, and with with_text its text with the spans masked (`masked`; null text: empty)."""
    found = docs.select(F.col(id_col), spans_column(with_text)(F.col(text_col)).alias("found"))
    return found.select(id_col, "found.*")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns: the counts and the digest are of the plain spans, which the contract fixes; `spans` and n_added also have the others."""
    plain = F.filter("spans", lambda s: s["plain"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"size(filter(spans, s -> s.plain AND s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    added = (F.size("spans") - F.size(plain)).cast("long").alias("n_added")
    return found.select(id_col, *counts, F.sha2(said(plain).cast("binary"), 256).alias("base_sha256"), said("spans").alias("spans"), added)
