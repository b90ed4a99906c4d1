"""License scan: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

A tag (``SPDX-License-Identifier:``) is followed by an expression of license names joined by AND, OR and WITH
(which binds closest, OR loosest) and parentheses. It ends where no operator follows a license outside of parentheses; a line's end, with the comment
sign that begins the next line, ends it only there. Small letters make an operator only before a name that is known. A notice phrase stands for one license, or for a family of which the
version, and whether later ones are granted too, is read from the words around it. An expression is
``permitted`` if its licenses allow reuse: AND needs both sides, OR one; WITH adds an exception to a license,
which permits it if the pair is in ``EXCEPTIONS``. Names in neither list make it ``unknown`` unless the other
side decides. All that a text holds has to be permitted: its verdict is the worst of its findings'.

Defined results: a null, empty or license-free text has verdict ``none`` and empty lists. A tag whose expression can't be
parsed counts as ``unknown``. Letter case, line breaks, runs of blanks and comment signs at line starts within a phrase don't count, nor does "licence" for "license".
A family named without a version stands for all of its versions, as ``GPL-1.0-or-later`` or ``MPL-1.0+``, unless the text names a version of it elsewhere;
LGPL, AGPL, EPL, SSPL and BUSL have one fixed version for that. "Apache License" without any is ``unknown``.
Rows with repeated or null ids are scanned each. Very long texts are scanned whole, alone in their slice. An empty table gives no rows. Extra
columns, whatever their names (``verdict``, ``licenses``), are left out of the result.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from cellframe.llm._text import map_slices, picked

PERMITTED = frozenset(
    "0BSD AFL-3.0 Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC0-1.0 ISC MIT MIT-0 NCSA PSF-2.0 PostgreSQL Python-2.0 Unicode-DFS-2016 Unlicense W3C WTFPL X11 Zlib".split()
)
RESTRICTED = frozenset(
    "AGPL-1.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later BUSL-1.0 BUSL-1.1 EPL-1.0 EPL-2.0 EUPL-1.0 EUPL-1.1 EUPL-1.2 GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MPL-1.0 MPL-1.1 MPL-2.0 SSPL-1.0 LicenseRef-Proprietary".split()
) | {f"CC-BY-{kind}-{v}" for kind in ("NC", "NC-ND", "NC-SA", "ND", "SA") for v in ("1.0", "2.0", "2.5", "3.0", "4.0")}
EXCEPTIONS = frozenset({("GPL-2.0-only", "Classpath-exception-2.0"), ("GPL-2.0", "Classpath-exception-2.0"), ("GPL-3.0-or-later", "GCC-exception-3.1"), ("GPL-3.0-only", "GCC-exception-3.1"), ("Apache-2.0", "LLVM-exception")})

#: Notice phrases in lower case and the licenses that they stand for.
NOTICES = {
    "mit license": "MIT", "permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
    "redistribution and use in source and binary forms, with or without modification": "BSD-3-Clause",
    "isc license": "ISC", "boost software license": "BSL-1.0", "this is free and unencumbered software released into the public domain": "Unlicense",
    "all rights reserved": "LicenseRef-Proprietary",
} | {f"{a}{n}{b}": f"BSD-{n}-Clause" for n in "23" for a, b in (("bsd ", "-clause"), ("bsd-", "-clause"), ("", "-clause bsd"), ("", "-clause \"bsd"))}

#: Phrases in lower case that name a family, the family, and whether they count without a version.
FAMILIES = {
    "gnu general public license": ("GPL", True), "general public license": ("GPL", True), "gnu gpl": ("GPL", True), "gpl": ("GPL", True),
    "gnu lesser general public license": ("LGPL", True), "lesser general public license": ("LGPL", True), "gnu library general public license": ("LGPL", True), "library general public license": ("LGPL", True), "gnu lesser gpl": ("LGPL", True), "gnu lgpl": ("LGPL", True), "lgpl": ("LGPL", True),
    "gnu affero general public license": ("AGPL", True), "affero general public license": ("AGPL", True), "gnu agpl": ("AGPL", True), "agpl": ("AGPL", True),
    "apache license": ("Apache", True), "apache software license": ("Apache", True), "apache public license": ("Apache", True), "apache": ("Apache", False),
    "mozilla public license": ("MPL", True), "mpl": ("MPL", False), "eclipse public license": ("EPL", True), "epl": ("EPL", False), "european union public license": ("EUPL", True), "eupl": ("EUPL", False),
    "server side public license": ("SSPL", True), "sspl": ("SSPL", False), "business source license": ("BUSL", True), "busl": ("BUSL", False),
    "creative commons": ("CC", False), "cc by": ("CC", False), "cc-by": ("CC", False), "cc0": ("CC0", True), "creativecommons.org/licenses/by": ("CC", False), "creativecommons.org/publicdomain/zero": ("CC0", True),
}
#: What a family stands for where no version is given.
UNVERSIONED = {"GPL": "GPL-1.0-or-later", "LGPL": "LGPL-3.0-only", "AGPL": "AGPL-3.0-only", "Apache": "LicenseRef-Apache", "MPL": "MPL-1.0+", "EPL": "EPL-2.0", "EUPL": "EUPL-1.0+", "SSPL": "SSPL-1.0", "BUSL": "BUSL-1.1", "CC0": "CC0-1.0"}
_LATER = r"(?P<later>\+|[\s,]*\(?(?:or|and)\s*[,(]?\s*(?:at your (?:option|choice)\s*[,)]?\s*)?(?:any |a |all )?(?:later|newer|greater|higher)|-or-later)"
_WORDS = r"(?:[\s,;:(\"'/\-]|\)(?=[\s,;:]*(?:v|as|\d|either))|licenses?\b|as published by the free software foundation|either\b|only\b|(?:a|l)?gpl\b|mpl\b|under\b(?= version)|international\b|unported\b|generic\b|public\b)*"
_VERSIONS = PERMITTED | RESTRICTED | {"Apache-1.0", "CC-BY-1.0", "CC-BY-2.0", "CC-BY-2.5"}
_AFTER = re.compile(rf"{_WORDS}(?:(?:version|ver\.?|v\.?)\s*)?(?P<v>\d(?:\.\d)?)(?:\.0)?(?![\w]|\.\d|-clause)(?: of the (?:gnu )?licen[sc]e)?{_LATER}?")
_BEFORE = re.compile(rf"(?:version |v\.? ?)(?P<v>\d(?:\.\d)?){_LATER}?(?: versions?)?[\s,)]*(?:of|under) (?:the )?(?:terms of the )?$")
_CC_PARTS = re.compile(r"(?:[\s\-–—,/]*(?:(?P<by>attribution|by)|non[\s\-]?commercial|nc|share[\s\-]?alike|sa|no[\s\-]?deriv(?:ative)?s?(?: works)?|nd)(?![a-z]))+")
TAG = "spdx-license-identifier:"
_ORDER = {"restricted": 0, "unknown": 1, "permitted": 2}
_BY_NAME = {n.lower(): n for n in PERMITTED | RESTRICTED | {x for p in EXCEPTIONS for x in p}}
_BINDS = {"OR": 1, "AND": 2, "WITH": 3}


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order by the shunting-yard method; None if it is malformed."""
    out, ops, operand = [], [], False
    for token in re.findall(r"[()]|[^\s()]+", expression):
        word = token.upper()
        if token == "(":
            if operand:
                return None
            ops.append(token)
        elif token == ")":
            if not operand:
                return None
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        elif word in _BINDS:
            if not operand:
                return None
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[word]:
                out.append(ops.pop())
            ops.append(word)
            operand = False
        else:
            if operand or not re.fullmatch(r"[A-Za-z0-9.\-]+\+?|(?:DocumentRef-[\w.\-]+:)?LicenseRef-[\w.\-]+", token):
                return None
            out.append(_BY_NAME.get(token.lower(), token))
            operand = True
    if not operand or "(" in ops:
        return None
    return out + ops[::-1]


def judge(name: str) -> str:
    if name in PERMITTED:
        return "permitted"
    base = name[:-1] if name.endswith("+") else name
    return "permitted" if base in PERMITTED else "restricted" if name in RESTRICTED or base in RESTRICTED else "unknown"


def evaluate(expression: str) -> tuple[str, list[str]]:
    """Verdict and the licenses named."""
    order = postfix(expression)
    if order is None:
        return "unknown", []
    stack: list[tuple[str, str]] = []
    names = []
    for token in order:
        if token not in _BINDS:
            stack.append((judge(token), token))
            names.append(token)
            continue
        if len(stack) < 2:
            return "unknown", names
        (b, right), (a, left) = stack.pop(), stack.pop()
        if token == "WITH":
            names = [n for n in names if n != right]
            stack.append(("permitted" if (left, right) in EXCEPTIONS else a, f"{left} WITH {right}"))
        else:
            pick = min if token == "AND" else max
            stack.append((pick(a, b, key=_ORDER.get), ""))
    return (stack[0][0], names) if len(stack) == 1 else ("unknown", names)


def named(flat: str, a: int, b: int, family: str, alone: bool) -> tuple[int, tuple[str, str, bool]] | None:
    """Where the notice ends that names a family at ``a:b``; its license, the family and whether a version was given. None: no notice."""
    if flat[b : b + 30].lstrip("- ").startswith(("compatible", "incompatible")):
        return None
    if family == "CC":
        m = _CC_PARTS.match(flat, b if flat.startswith("creative commons", a) else b - 2)
        if not m or not m["by"]:
            return None
        said = m.group()
        parts = [x for x, p in (("NC", r"non[\s\-]?commercial|\bnc\b"), ("SA", r"share[\s\-]?alike|\bsa\b"), ("ND", r"no[\s\-]?deriv|\bnd\b")) if re.search(p, said)]
        family, b, alone = "-".join(["CC-BY", *parts]), m.end(), not flat.startswith("cc", a)
    after = _AFTER.match(flat, b)
    m = after or _BEFORE.search(flat, max(0, a - 80), a)
    version = m and (m["v"] if "." in m["v"] else m["v"] + ".0")
    if not m or f"{family}-{version}" not in _VERSIONS:
        fits = alone and not flat[b : b + 1].isalnum()
        return (b, (UNVERSIONED.get(family, f"{family}-1.0+"), family, False)) if fits else None
    if family in ("GPL", "LGPL", "AGPL"):
        version += "-or-later" if m["later"] else "-only"
    return (after.end() if after else b), (f"{family}-{version}", family, True)


#: Blanks with the comment signs that begin the next line, or what stands between blanks.
_PLACES = re.compile(r"[^\S\n\r]*[\n\r]\s*(?:(?:#+|//+!?|/?\*+(?!\w)/?|/\*+|\*|;+|--+|%+|>+|\|+|!+|'|\.\.|::|(?:dnl|rem|c)(?=[^\S\n\r]))\s*)*|\s+|\S+")


_LICENSE = re.compile(r"(?:DocumentRef-[\w.\-]+:)?LicenseRef-[\w.\-]+|[A-Za-z0-9][A-Za-z0-9.\-]*\+?")
_BLANKS = re.compile(r"[^\S\n\r]*")


def tagged(text: str, at: int) -> tuple[str, int]:
    """The expression that begins at ``at``, its words with one blank between, and where it ends. What may be malformed is left to ``postfix``."""
    out, depth, operand, end = [], 0, False, at
    while True:
        at = _BLANKS.match(text, at).end()
        if at < len(text) and text[at] in "\n\r":
            if not out or (operand and not depth):
                break
            at = _PLACES.match(text, at).end()
        mark = text[at : at + 1]
        if mark == "(" and not operand:
            depth += 1
        elif mark == ")" and operand and depth:
            depth -= 1
        elif not (m := _LICENSE.match(text, at)):
            break
        else:
            mark = m.group().rstrip(".-")
            if operand:
                after = _LICENSE.match(text, _BLANKS.match(text, m.end()).end())
                if mark.upper() not in _BINDS or not (mark.isupper() or (after and after.group().rstrip(".-+").lower() in _BY_NAME)):
                    break
                mark = mark.upper()
            operand = not operand
        out.append(mark)
        end = at = at + len(mark)
    return " ".join(out).replace("( ", "(").replace(" )", ")"), end


class Scanner:
    def __init__(self, notices: dict[str, str] = NOTICES):
        self.words = ahocorasick.Automaton()
        for phrase, name in notices.items():
            self.words.add_word(phrase, (len(phrase), name))
        for phrase, family in FAMILIES.items():
            self.words.add_word(phrase, (len(phrase), family))
        self.words.add_word(TAG, (len(TAG), None))
        self.words.make_automaton()
        # a text without any of these has neither a tag nor a phrase
        self.hint = re.compile(r"licen[sc]e|spdx|permission|redistribution|public|cc[\s\-]+by|cc0|creative|all\W+rights|gpl|apache|mpl|epl|eupl|sspl|busl|bsd")

    def find(self, text: str) -> tuple[list[str], list[str], str]:
        lower = text.lower()
        if len(lower) != len(text):
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if not self.hint.search(lower):
            return [], [], "none"
        # blanks and line breaks, with comment signs after them, become one blank each, with the place each character came from
        places = [m.span() for m in _PLACES.finditer(lower)]
        flat = "".join(" " if lower[a].isspace() else lower[a:b] for a, b in places)
        start, at = [], 0
        for a, b in places:
            start.append((at, a))
            at += 1 if lower[a].isspace() else b - a
        flat = flat.replace("licence", "license")
        spans = []
        for end, (length, name) in self.words.iter(flat):
            a = end - length + 1
            before, after = flat[a - 1 : a], flat[end + 1 : end + 2]
            if isinstance(name, tuple):
                if not before.isalnum() and (found := named(flat, a, end + 1, *name)):
                    spans.append((a, *found))
            elif name is None or not (before.isalnum() or after.isalnum()):
                spans.append((a, end + 1, name))
        # a family's bare name says nothing where the text gives its version; within a longer notice it is that notice
        versions = {n[1] for _, _, n in spans if isinstance(n, tuple) and n[2]}
        spans = [(a, b, n[0] if isinstance(n, tuple) else n) for a, b, n in spans if not isinstance(n, tuple) or n[2] or n[1] not in versions]
        expressions, names, verdict = [], set(), "permitted"
        reach = -1
        for a, b, name in sorted(spans, key=lambda x: (x[0], -x[1])):
            if a < reach:
                continue
            reach = b
            if name is None:
                lo, hi = 0, len(start) - 1
                while lo < hi:
                    mid = (lo + hi + 1) // 2
                    lo, hi = (mid, hi) if start[mid][0] < b else (lo, mid - 1)
                source = start[lo][1] + b - start[lo][0]
                expression, end = tagged(text, source)
                # its names aren't notices
                reach = b + sum(1 if text[x].isspace() else y - x for x, y in (m.span() for m in _PLACES.finditer(text, source, end)))
            else:
                expression = name
            kind, found = evaluate(expression)
            expressions.append(expression)
            names.update(found)
            verdict = min(verdict, kind, key=_ORDER.get)
        return expressions, sorted(names), verdict if expressions else "none"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expressions, licenses, verdict`` of every row."""

    def make():
        scanner = Scanner()

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            found = [scanner.find(t or "") for t in part.column("text").to_pylist()]
            e, n, v = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(e, pa.list_(pa.string())), pa.array(n, pa.list_(pa.string())), pa.array(v, pa.string())], ["doc_id", "expressions", "licenses", "verdict"])

        return one

    return map_slices(picked(docs, id_col, text_col), make, "text", "doc_id long, expressions array<string>, licenses array<string>, verdict string")
