"""Personal data: an Aho-Corasick pass finds anchors, local parsers expand them and validate what they find.

Anchors are at-signs, plus signs, digits, URL schemes ("://") and identifier cues (account, iban, street, ...). From
an anchor a parser of its kind looks left and right only as far as its boundary rules allow:

* ``email``: local characters to the left (not into the last address), dotted labels to the right;
* ``ip``: runs of digits joined by dots, four at a time, each part at most 255;
* ``card``: digits with single blanks or hyphens between, 13 to 19 of them, passing Luhn;
* ``phone``: a plus, then digits, blanks, dots, brackets and hyphens up to the last digit, 9 to 15 digits;
* ``url``: a scheme, the rest up to white space, closing punctuation left off;
* ``account``: after a cue and separators, an IBAN in one piece or in groups if its remainder by 97 is 1, or else an
  identifier of four or more characters (letters, digits, ``-``, ``_``, inner dots) with a digit, digits also in groups
  divided by single blanks; what has an IBAN's form after the cue ``iban`` but fails its check is dropped;
* ``address``: a house number and up to four capitalised words before a street cue; a German street with its number
  after it; a number, a French street cue and a name; a Spanish street cue, a name and a number. Blanks join them, line
  ends don't; numbers and words may have any length.

The first four follow the base patterns exactly: matches are leftmost and don't overlap within a kind, and a match
that fails its check is dropped without another try. Offsets are code points, ends exclusive.

A document's result depends on its own text alone: nothing is shuffled or gathered. Cases: a null or empty text has
no spans; repeated rows get a result each; an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "address")
#: Cues before an identifier, and after or before a street name.
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "username", "user id", "token", "api key", "password")
STREET_CUES = ("Street", "Avenue", "Road", "Lane", "Boulevard", "Drive", "straße", "strasse", "Straße", "Strasse")
FRENCH_CUES = ("rue", "avenue", "boulevard", "place", "chemin", "allée", "impasse", "quai")
SPANISH_CUES = ("calle", "avenida", "plaza", "paseo", "carrera", "camino")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_DIAL = re.compile(r"\+[0-9][\x20().0-9-]+")
_SEPARATOR = re.compile(r"(?:[\x20]?(?:no|number|id))?[.:=#\x20\"']{1,4}(?=[A-Za-z0-9])")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[\x20-]?[A-Za-z0-9]){11,30}")
_IBAN_FORM = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){11,30}")
_GROUPED = re.compile(r"[0-9]+(?:\x20[0-9]{2,})+(?![^\W_]|[_-])")
_IDENTIFIER = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9_-]|\.(?=[A-Za-z0-9_-]))*")
_HOUSE = {least: re.compile(rf"(?<![0-9])[0-9]++[a-z]?(?:\x20[A-Z][^\s,;:]*){{{least},{least + 3}}}\x20\Z") for least in (0, 1)}
_BREAK = re.compile(r"[,;:]")
_SPACE = re.compile(r"\s")
_NAME = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_GERMAN = re.compile(rf"(?:{_NAME}\x20){{0,3}}{_NAME}\Z|(?:{_NAME}\x20){{1,3}}\Z|(?:{_NAME}-)+\Z")
_CAPITAL = re.compile(r"(?<!\w)(?<!-)[A-ZÀ-ÖØ-Þ]")
_NUMBER = re.compile(r",?\x20(?:n[.º°o]{1,2}\x20?)?[0-9]++(?:\x20?[A-Za-z])?(?!\w)")
_BEFORE = re.compile(r"(?<!\w)[0-9]++(?:\x20?(?:bis|ter|quater|[A-Za-z]))?,?\x20\Z")
_LINK = r"(?:(?:de|du|des|del|la|las|le|les|los|el|et|y|à|aux|au|en)\x20|[dlDL]['’])"
_STREET = re.compile(rf"\x20{_LINK}*{_NAME}(?:\x20{_LINK}*{_NAME}){{0,4}}")


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for x in "@+0123456789":
        a.add_word(x, ("0" if x.isdigit() else x, 1))
    a.add_word("://", (":", 3))
    for cue in ACCOUNT_CUES:
        for x in {cue, cue.capitalize(), cue.upper()}:
            a.add_word(x, ("account", len(x)))
    found = {}
    for kind, cues in (("s", STREET_CUES), ("fr", FRENCH_CUES), ("es", SPANISH_CUES)):
        for cue in cues:
            for x in {cue} if kind == "s" else {cue, cue.capitalize()}:
                found[x] = found.get(x, ()) + (kind,)
    for cue, kinds in found.items():
        a.add_word(cue, (kinds, len(cue)))
    a.make_automaton()
    return a


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k & 1:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _valid_iban(x: str) -> bool:
    return 15 <= len(x) <= 34 and x.isascii() and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _account(text: str, at: int, iban: bool) -> tuple[int, int] | None:
    """Span of the identifier after a cue that ends at this place; iban: the cue says so."""
    m = _SEPARATOR.match(text, at)
    if not m:
        return None
    start = m.end()
    x = _IBAN.match(text, start)
    if x:
        run = x[0]
        for size in range(len(run), 14, -1):
            after = text[start + size : start + size + 1]
            if run[size - 1] not in " -" and not (after and (after.isalnum() or after == "_")) and _valid_iban(run[:size].replace(" ", "").replace("-", "")):
                return start, start + size
        if iban and _IBAN_FORM.match(text, start):
            return None
    m = _GROUPED.match(text, start) or _IDENTIFIER.match(text, start)
    end = m.end()
    return (start, end) if end - start >= 4 and any(c in _DIGITS for c in m[0]) else None


class _Streets:
    """Addresses around the street cues of one text.

    What stands before a cue is a few words, so it is sought from the start of the word that is so many words back; per
    word it is sought once, however many cues the word has.
    """

    def __init__(self, text: str):
        self.text, self.spaces, self.word = text, [m.start() for m in _SPACE.finditer(text)], (-1, None, -1)

    def _back(self, at: int, words: int, least: int) -> int:
        """Where the word begins that is so many words before the one at this place; not before ``least``."""
        k = bisect.bisect_left(self.spaces, at) - 1 - words
        return max(least, self.spaces[k] + 1 if k >= 0 else 0)

    def _house(self, at: int, least: int) -> int | None:
        """Where a house number begins that up to four capitalised words lead on from to the cue."""
        start = self._back(at, 0, 0)
        if start < least:
            return None
        if start == at:
            m = _HOUSE[1].search(self.text, self._back(at, 6, least), at)
        else:
            if self.word[0] != start:
                found = _HOUSE[0].search(self.text, self._back(start, 5, least), start) if "A" <= self.text[start] <= "Z" else None
                stop = _BREAK.search(self.text, start)
                self.word = (start, found, stop.start() if stop else len(self.text))
            m = self.word[1] if at <= self.word[2] else None
        return m.start() if m and not (m.start() and self.text[m.start() - 1].isalnum()) else None

    def find(self, at: int, end: int, kinds: tuple[str, ...], least: int) -> tuple[int, int] | None:
        """Span of the address around a street cue at ``at`` .. ``end``; it begins at ``least`` or later."""
        text = self.text
        if "s" in kinds:
            house = self._house(at, least)
            if house is not None:
                return house, end
            number = _NUMBER.match(text, end) if text[at:end].lower() in ("straße", "strasse") else None
            if number:
                for m in _CAPITAL.finditer(text, self._back(at, 4, least), at):
                    if _GERMAN.match(text, m.start(), at):
                        return m.start(), number.end()
        if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
            return None
        if {"fr", "es"}.intersection(kinds):
            name = _STREET.match(text, end)
            if name:
                before = _BEFORE.search(text, self._back(at, 4, least), at) if "fr" in kinds else None
                if before:
                    return before.start(), name.end()
                number = _NUMBER.match(text, name.end()) if "es" in kinds else None
                if number:
                    return at, number.end()
        return None


def find(text: str, automaton) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) of all spans, in the order of KINDS and then of the starts."""
    out = []
    streets = None
    mail = dotted = chain = dial = url = account = address = 0  # where each kind's last attempt ended
    for last, (kind, size) in automaton.iter(text):
        at = last - size + 1
        if kind == "0":
            if at >= dotted:
                m = _DOTTED.match(text, at)
                dotted = m.end()
                if "." in m[0]:
                    runs, start = m[0].split("."), at
                    for k in range(0, len(runs) - 3, 4):
                        end = start + sum(map(len, runs[k : k + 4])) + 3
                        if all(len(x.lstrip("0")) < 4 and int(x[-9:]) < 256 for x in runs[k : k + 4]):
                            out.append((1, start, end))
                        start = end + 1
            if at >= chain:
                chain = _CHAIN.match(text, at).end()
                if chain - at >= 13:
                    digits = text[at:chain].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and _luhn(digits):
                        out.append((2, at, chain))
        elif kind == "@":
            start = at
            while start > mail and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                mail = m.end()
                out.append((0, start, mail))
        elif kind == "+":
            m = _DIAL.match(text, at) if at >= dial else None
            if m:
                end = m.end()
                while text[end - 1] not in _DIGITS:
                    end -= 1
                if end - at >= 4:
                    dial = end
                    if 9 <= sum(x in _DIGITS for x in text[at:end]) <= 15:
                        out.append((3, at, end))
        elif kind == ":":
            start = at
            while start > url and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
                start -= 1
            end = last + 1
            while end < len(text) and not text[end].isspace() and text[end] not in "<>\"'":
                end += 1
            while end > last + 1 and text[end - 1] in ".,;:!?)]}":
                end -= 1
            if start < at and end > last + 1 and text[start].isalpha():
                url = end
                out.append((4, start, end))
        elif kind == "account":
            span = _account(text, last + 1, text[at : last + 1].lower() == "iban") if at >= account and not (at and text[at - 1].isalnum()) else None
            if span:
                account = span[1]
                out.append((5, *span))
        elif at >= address:
            streets = streets or _Streets(text)
            span = streets.find(at, last + 1, kind, address)
            if span:
                address = span[1]
                out.append((6, *span))
    out.sort()
    return out


def _scan(it):
    automaton = _automaton()
    names = pa.array(KINDS)
    for b in it:
        kinds, starts, ends, offsets = [], [], [], [0]
        for t in b.column(1).to_pylist():
            for k, s, e in find(t, automaton) if t else ():
                kinds.append(k)
                starts.append(s)
                ends.append(e)
            offsets.append(len(kinds))
        spans = pa.StructArray.from_arrays([names.take(pa.array(kinds, pa.int32())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["kind", "start", "end"])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], ["doc_id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document (doc_id, spans array<struct<kind, start, end>>)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    counts = [F.size(F.filter(spans, _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def _is(kind: str):
    return lambda x: x["kind"] == kind
