"""Offset-preserving deobfuscation of personal data.

Four transducers rewrite a text, each keeping which source character every output character came from:
look-alike letters and digits become ASCII, invisible characters vanish, runs of spelled digits become digits, and disguised
``at`` and ``dot`` become ``@`` and ``.``; digits, ``at`` and ``dot`` in English, French, German and Spanish. Identifiers are detected in what results and their spans mapped back
to the source, so that offsets, and redaction, are those of the original text.

Kinds: email, phone, card (``checked``: Luhn), ip, iban (``checked``: mod 97), ssn.

A bare "at" before a domain with plain dots is a disguise if the domain ends in a known top-level domain and the word before isn't
one that often stands before "at" ("look at example.com"). A bare "point" is a dot only beside "arobase" and the like. Without "+" or "(", digits are a phone if there are
10 or 11, or 8 to 15 that begin with 0 (after 00 and set apart: 8 to 15 more) or are set apart in groups as in a phone; dates, decimals and grouped numbers
aren't, except nine digits from 6 on in threes with blanks, which Spanish phones are.

Defined results: null, empty and clean texts have no finding. Offsets count source characters. Of overlapping findings the earlier
stays, the longer at one place. Rows with a null id are left out of the findings; rows sharing an id are scanned each and their findings
made distinct. Very long texts are scanned whole, in time that grows with their length. An empty table gives no rows. Extra columns, whatever
their names (``kind``, ``value``), are left out of the result.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellframe.llm._text import map_slices, picked

_LOOKALIKE = dict(zip("аеорсухіјѕԁһӏвкмнтАВЕКМНОРСТУХІЅЈαοιρνκτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlbkmhtABEKMHOPCTYXISJaoipvktuxABEZHIKMNOPTYX", strict=True))
for _c in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x2474), *range(0x2070, 0x208A), 0xB2, 0xB3, 0xB9, *range(0x660, 0x66A), *range(0x6F0, 0x6FA), *range(0x966, 0x970), 0x2024, 0xFE52, 0xFE6B, 0x2010, 0x2011, 0x2012, 0x2013]:
    _n = unicodedata.normalize("NFKC", chr(_c))
    if len(_n) == 1 and ord(_n) < 128:
        _LOOKALIKE[chr(_c)] = _n
    elif _n.isdecimal() and len(_n) == 1:
        _LOOKALIKE[chr(_c)] = str(unicodedata.digit(_n))
    elif 0x2010 <= _c <= 0x2013:
        _LOOKALIKE[chr(_c)] = "-"
_TABLE = {ord(a): b for a, b in _LOOKALIKE.items()}
_HIDDEN = re.compile("[​-‏⁠﻿­‪-‮]+")
_FOREIGN = frozenset(_LOOKALIKE) | {chr(c) for c in range(0x10000) if _HIDDEN.fullmatch(chr(c))}
_FOREIGN_LATIN = tuple(c for c in _FOREIGN if ord(c) < 256)


def _foreign(t: str) -> bool:
    """Whether a text has a character that is rewritten. Most texts fit Latin-1, which has four of them."""
    if t.isascii():
        return False
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        return not _FOREIGN.isdisjoint(t)
    return any(c in t for c in _FOREIGN_LATIN)


DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
for _words in ("null eins zwei drei vier fünf sechs sieben acht neun", "cero uno dos tres cuatro cinco seis siete ocho nueve", "zéro un deux trois quatre cinq six sept huit neuf"):
    DIGITS |= {w: str(k) for k, w in enumerate(_words.split())}
DIGITS |= {"zwo": "2", "fuenf": "5"}
_D = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?i)(?<!\w){_D}(?:[\s.,\-]{{1,3}}{_D}(?!\w)){{2,}}")
# up to four blanks stand within a disguise; so no expression reads a long run of blanks again from each of them
_DOT = r"(?:\s{0,4}[\[({<]\s{0,4}(?:dot|punkt|punto|point)\s{0,4}[\])}>]\s{0,4}|\s{1,4}(?:dot|punkt|punto)\s{1,4}|\s{0,4}_(?:dot|punkt|punto)_\s{0,4})"
_BRACKET_AT = r"(?:\s{0,4}[\[({<]\s{0,4}at\s{0,4}[\])}>]\s{0,4}|\s{0,4}_at_\s{0,4})"
_AT = rf"(?:{_BRACKET_AT}|\s{{1,4}}at\s{{1,4}})"
_NAME = r"[A-Za-z0-9][A-Za-z0-9_%+\-]{0,63}"
# words for the sign that are nothing else
_SURE = r"(?:arrobas?|arr?obase|klammeraffe|ät)"
_SURE_AT = rf"(?:\s{{0,4}}[\[({{<_]\s{{0,4}}{_SURE}\s{{0,4}}[\])}}>_]\s{{0,4}}|\s{{1,4}}{_SURE}\s{{1,4}})"
_ANY_DOT = rf"(?:{_DOT}|\s{{1,4}}point\s{{1,4}}|\s{{0,4}}_point_\s{{0,4}}|\.)"


class Disguise:
    """A disguised "@" with a name before and a domain behind it, matched outward from the sign that stands for "@".

    ``signs``: what stands for "@"; ``domains``: expressions tried behind it, with the sign that each goes with; ``dot``: what stands for ".".
    A domain has 127 labels and a name 64 characters at most, so only ``BEFORE`` characters before the sign are read: cost follows the signs
    that have a domain, not the length of what stands around them.
    """

    BEFORE = 320

    def __init__(self, signs: str, domains: list[tuple[str, str]], dot: str):
        self.sign = re.compile(rf"(?i){signs}")
        self.domains = [(re.compile(rf"(?i){s}"), re.compile(rf"(?i)(?P<d>{d})(?!\w)")) for s, d in domains]
        self.name = re.compile(rf"(?i)(?<![\w.])(?:{_NAME})(?:(?:\.|{dot}){_NAME})*?$")
        self.dot = re.compile(rf"(?i){dot}")

    def edits(self, t: str) -> list[tuple[int, int, str]]:
        out, at, floor = [], 0, 0
        while m := self.sign.search(t, at):
            at = m.end() - len(m.group().lstrip()) + 1 if m.group().strip() else m.end()
            for sign, domain in self.domains:
                if sign.fullmatch(m.group()) and (d := domain.match(t, m.end())):
                    break
            else:
                continue
            if not (n := self.name.search(t, max(floor, m.start() - self.BEFORE), m.start())):
                continue
            out += [(x.start(), x.end(), ".") for x in self.dot.finditer(t, n.start(), n.end())]
            out.append((m.start(), m.end(), "@"))
            out += [(x.start(), x.end(), ".") for x in self.dot.finditer(t, d.start(), d.end())]
            at = floor = d.end()
        return out


# a bare "at" is a disguise only where a dot is spelled too; a bracketed one always is
_SPELLED_AT = Disguise(
    rf"{_AT}|\s{{0,4}}@\s{{0,4}}",
    [
        (_AT, rf"[A-Za-z0-9\-]{{1,63}}(?:\.[A-Za-z0-9\-]{{1,63}}){{0,126}}(?:{_DOT}[A-Za-z0-9\-]{{2,63}}){{1,126}}"),
        (rf"{_BRACKET_AT}|\s*@\s*", rf"[A-Za-z0-9\-]{{1,63}}(?:(?:\.|{_DOT})[A-Za-z0-9\-]{{2,63}}){{1,126}}"),
    ],
    _DOT,
)
_CERTAIN_AT = Disguise(_SURE_AT, [(_SURE_AT, rf"[A-Za-z0-9\-]{{1,63}}(?:{_ANY_DOT}[A-Za-z0-9\-]{{2,63}}){{1,126}}")], _ANY_DOT)
_DISGUISE_HINT = re.compile(r"(?i)[\[({<_]\s{0,4}(?:at|dot|punkt|punto|point)\s{0,4}[\])}>_]|\s(?:dot|punkt|punto)\s|\s@|@\s")
TLDS = (
    "com org net edu gov mil int info biz name pro mobi online site shop store app dev tech cloud blog email xyz club agency academy berlin wien paris cat coop museum aero jobs travel eus gal "
    "ac ad ae af ag ai al am ao ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg gh gi gl gm gn gp gq gr gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
).split()
_PLAIN_AT = re.compile(rf"(?i)\s{{1,4}}at\s{{1,4}}(?=(?:[a-z0-9\-]{{1,63}}\.){{1,126}}(?-i:{'|'.join(TLDS)}|{'|'.join(TLDS).upper()})(?![\w\-])(?!\.\w))")
_PLAIN_HINT = re.compile(r"(?i)\sat\s{1,4}[a-z0-9\-]{1,63}\.[a-z]")
_BEFORE_AT = frozenset(
    "a about again all always am and any anyone are arrive arrived arrives article articles at available away back bad based be been begin begins better best blog book bought buy call check click contact data day down download end ends even everyone exclusively find first for found free good great happening have he held her here him home host hosted hosting how i in info is it job join just learn listed live located look looked looking looks me meet met more myself news not now of off on one online only open or order out over page pages people place post posted price priced published read register registered released review run running said search see seen sell she shop sign site sold someone stare start started starts stay stop store store. story team that the them there they this time today try up us user users version visit was watch we web webpage website were what where who work worked working works write writer written you yourself".split()
)

_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,62}[A-Za-z0-9_%+\-])?$")
_NUMBER = re.compile(r"(?<![\w.+])\+?\(?\d(?:[ \t().\-/]{0,3}\d){5,21}(?![\w])")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
# dates, also with an hour behind them, and numbers that aren't phones whatever their length
_NO_PHONE = re.compile(r"(?:(?:1[5-9]|20)\d\d([\-/.])\d{1,2}\1\d{1,2}|\d{1,2}([\-/. ])\d{1,2}\2(?:1[89]|20)\d\d)(?!\d)|\d{1,2}([\-/.])\d{1,2}\3\d\d(?= \d\d$)|(?:1[5-9]|20)\d\d\D+(?:1[5-9]|20)\d\d(?!\d)|(?:19|20)\d\d(?:0[1-9]|1[0-2])[0-3]\d(?!\d)|0?\.\d|0 *\.|97[89]\D")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _grouped(s: str, digits: str) -> bool:
    """Whether digits, without a sign before them, are set like a phone."""
    n = len(digits)
    if _NO_PHONE.match(s):
        return False
    if digits.startswith("00"):
        return digits[2] != "0" and 10 <= n <= (15 if s.isdigit() else 17)
    if digits[0] == "0":
        return 8 <= n <= 15
    parts = re.findall(r"\d+", s)
    if not 8 <= n <= 15 or not 2 <= len(parts) <= 6 or min(map(len, parts[1:])) < 2 or not re.search(r"[^\d.]", s):
        return False
    threes = all(len(x) == 3 for x in parts[1:])
    return not threes or (n == 9 and len(parts) == 3 and digits[0] in "6789" and "." not in s) or (len(parts) == 2 and n >= 8)


class Rewriting:
    """A text as rewritten so far; ``source[i]`` is where its character i came from, ``stop[i]`` where that ends. None: unchanged."""

    def __init__(self, text: str):
        self.text = text
        self.source: np.ndarray | None = None
        self.stop: np.ndarray | None = None

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Spans of the text, in order, and what stands for each; an output character stands for its share of the span."""
        if not edits:
            return
        if self.source is None:
            self.source = np.arange(len(self.text))
            self.stop = self.source + 1
        out, src, end, at = [], [], [], 0
        for a, b, new in edits:
            out += [self.text[at:a], new]
            n = len(new)
            cut = a + (np.arange(n + 1) * (b - a)) // max(n, 1)
            src += [self.source[at:a], self.source[np.minimum(cut[:-1], b - 1)]]
            end += [self.stop[at:a], self.stop[np.maximum(cut[1:], cut[:-1] + 1) - 1]]
            at = b
        self.text = "".join([*out, self.text[at:]])
        self.source = np.concatenate([*src, self.source[at:]])
        self.stop = np.concatenate([*end, self.stop[at:]])

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.source is None else (int(self.source[a]), int(self.stop[b - 1]))


_TOKEN = re.compile(r"\S+")
_SIGNS = {k: v for k, v in _TABLE.items() if not v.isalpha()}
#: In lower case; a text without any of these has no disguise of the kind.
_DISGUISE_SIGNS = ("@", "[", "(", "{", "<", "_", "dot", "punkt", "punto")
_SURE_SIGNS = ("rob", "lammeraffe", "ät")
# words that are often part of others count only beside one another
_COMMON = ("one", "oh", "un", "uno", "dos", "tres", "null", "acht", "six", "seis", "sept", "eins", "vier", "ten")
_RARE = tuple(w for w in DIGITS if w not in _COMMON)
_FEW = re.compile(rf"(?<!\w)(?:{'|'.join(_COMMON)})[\s.,\-]{{1,3}}(?:{'|'.join(_COMMON)})(?!\w)")


def _plain(m: re.Match) -> str:
    """A word in ASCII if look-alikes are all that kept it from that; else only its digits and signs."""
    w = m.group()
    if w.isascii():
        return w
    new = w.translate(_TABLE)
    return new if _HIDDEN.sub("", new).isascii() else w.translate(_SIGNS)


def _may_spell(t: str) -> bool:
    low = t.lower()
    return any(w in low for w in _RARE) or _FEW.search(low) is not None


def normalise(text: str) -> Rewriting:
    r = Rewriting(text)
    if _foreign(text):
        r.text = _TOKEN.sub(_plain, text)  # character for character
        r.replace([(m.start(), m.end(), "") for m in _HIDDEN.finditer(r.text)])
    if not _may_spell(r.text):
        return _undisguise(r)
    edits = []
    for m in _SPELLED.finditer(r.text):
        pos = m.start()
        found = list(re.finditer(rf"(?i){_D}", m.group()))
        edits += [(pos + d.start(), pos + (found[k + 1].start() if k + 1 < len(found) else d.end()), DIGITS[d.group().lower()]) for k, d in enumerate(found)]
    r.replace(edits)
    return _undisguise(r)


def _undisguise(r: Rewriting) -> Rewriting:
    low = r.text.lower()
    if any(c in low for c in _SURE_SIGNS):
        r.replace(_CERTAIN_AT.edits(r.text))
    t = r.text
    if _PLAIN_HINT.search(t):
        edits = []
        for m in _PLAIN_AT.finditer(t):
            name = _LOCAL.search(t, max(0, m.start() - 64), m.start())
            if name and name.group().lower() not in _BEFORE_AT and t[name.start() - 1 : name.start()] not in ("@", "/"):
                edits.append((m.start(), m.end(), "@"))
        r.replace(edits)
        t = r.text
    if any(c in low for c in _DISGUISE_SIGNS) and _DISGUISE_HINT.search(t):
        r.replace(_SPELLED_AT.edits(t))
    return r


_SIGN = re.compile(r"[@\d]")


def find(text: str) -> list[tuple[str, int, int, str, bool | None]]:
    """``kind, start, end, value, checked`` of each identifier; value is its plain form."""
    r = normalise(text)
    t = r.text
    if not _SIGN.search(t):
        return []
    found = []
    at = t.find("@")
    while at >= 0:
        left = _LOCAL.search(t, max(0, at - 64), at)
        right = _DOMAIN.match(t, at + 1)
        if left and right:
            found.append((left.start(), right.end(), "email", None))
        at = t.find("@", at + 1)
    for m in _IP.finditer(t):
        found.append((m.start(), m.end(), "ip", None))
    for m in _IBAN.finditer(t):
        found.append((m.start(), m.end(), "iban", mod97(m.group())))
    for m in _NUMBER.finditer(t):
        digits = re.sub(r"\D", "", m.group())
        a, b = m.span()
        if _SSN.fullmatch(m.group()):
            found.append((a, b, "ssn", None))
        elif 13 <= len(digits) <= 19 and digits[0] in "23456" and re.fullmatch(r"\d(?:[ \-]?\d)*", m.group()):
            found.append((a, b, "card", luhn(digits)))
        elif (m.group()[0] in "+(" and 8 <= len(digits) <= 15) or 10 <= len(digits) <= 11 or (7 == len(digits) and re.fullmatch(r"\d{3}[\-. ]\d{4}", m.group())) or _grouped(m.group(), digits):
            found.append((a, b, "phone", None))
    out, reach = [], 0
    # an email or address number wins over a number within it
    for a, b, kind, checked in sorted(found, key=lambda x: (x[0], -x[1], x[2] == "phone")):
        if a >= reach:
            s, e = r.span(a, b)
            out.append((kind, s, e, t[a:b], checked))
            reach = b
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kind, start, end, value, checked`` of every finding."""

    def make():
        types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_())

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(i, *f) for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for f in find(text)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "kind", "start", "end", "value", "checked"])

        return one

    some = picked(docs, id_col, text_col).where("doc_id is not null and text is not null")
    return map_slices(some, make, "text", "doc_id long, kind string, start int, end int, value string, checked boolean").distinct()


def redact(text: str) -> str:
    """The source text with each identifier replaced by its kind."""
    out, at = [], 0
    for kind, a, b, _, _ in find(text):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]
