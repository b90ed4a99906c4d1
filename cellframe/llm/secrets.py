"""Secret scan: Aho-Corasick keyword prefilter, regular expressions anchored near hits, checksum validation.

Keywords are looked for in the text's lower-case form of equal length; only at a hit is the rule's
regular expression tried, at the hit or just before it. What matches is then checked against what the
format itself promises: the CRC-32 tail of GitHub and npm tokens, the account number within an AWS key id, the
JSON header of a JWT, the DER length or magic of a private key block, the randomness of an assigned value.

A finding's ``verdict`` is ``valid`` (a check holds), ``invalid`` (it fails) or ``unchecked`` (the format has none).
Invalid findings are reported, not redacted, but for key blocks: whatever its body is, what calls itself a private key goes. Key blocks are checked by their type: PKCS#1, PKCS#8, EC and DSA keys by DER length, OpenSSH keys by
their magic; those encrypted under header lines, PGP keys and other types are unchecked.

Defined results: a secret of open length is taken whole, however long. Null, empty and clean texts have no finding. Offsets count characters. Of overlapping findings the
one that starts first stays, the longer of two at one place. Rows with a null id are left out of the findings (and redacted as all others); rows
sharing an id are scanned each and their findings made distinct. Very long texts are scanned whole, alone in their slice. An empty table gives no
rows. Extra columns, whatever their names (``kind``, ``verdict``), are left out of the findings and kept as they are by ``redact``.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import Counter
from math import log2

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellframe.llm._text import map_slices, picked

_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_tail(token: str, prefix: int) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of those between prefix and tail."""
    crc, tail = zlib.crc32(token[prefix:-6].encode()), ""
    for _ in range(6):
        crc, k = divmod(crc, 62)
        tail = _B62[k] + tail
    return tail == token[-6:]


def aws_account(key: str) -> bool:
    """Whether the key id's base-32 body decodes to an account number of at most twelve digits."""
    try:
        raw = base64.b32decode(key[4:])
    except ValueError:
        return False
    return (int.from_bytes(raw[:6], "big") & 0x7FFFFFFFFF80) >> 7 < 10**12


def jwt_header(token: str) -> bool:
    try:
        head = token.split(".")[0]
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


_HEADER = r"(?:[A-Za-z][\w\-]*:(?:(?!-----)[^\r\n])*\r?\n(?:[ \t]+\S(?:(?!-----)[^\r\n])*\r?\n)*)"
_HEADERS = re.compile(_HEADER)


def key_block(block: str) -> bool | None:
    """Whether a key block's body is what its type promises: a DER sequence that ends where its own length says, or OpenSSH's magic. None: no check."""
    kind = block[len("-----BEGIN ") :].split("PRIVATE KEY", 1)[0].strip()
    if kind not in ("", "RSA", "EC", "DSA", "ENCRYPTED", "OPENSSH"):
        return None
    body = re.sub(r"-----[^-]*-----", "", block).lstrip()
    body, headers = _HEADERS.sub("", body), "".join(_HEADERS.findall(body))
    if "ENCRYPTED" in headers or "DEK-Info" in headers:
        return None
    try:
        raw = base64.b64decode(re.sub(r"\s", "", body), validate=True)
    except ValueError:
        return False
    if kind == "OPENSSH":
        return raw.startswith(b"openssh-key-v1\0")
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    if raw[1] < 128:
        return len(raw) == 2 + raw[1]
    n = raw[1] & 127
    return 0 < n <= 4 and len(raw) == 2 + n + int.from_bytes(raw[2 : 2 + n], "big")


def entropy(s: str) -> float:
    return -sum(n / len(s) * log2(n / len(s)) for n in Counter(s).values())


_ASSIGNED = r"""(?:[ \t]{0,3}(?::=|=>|=|:)[ \t]{0,3})["']?(?P<v>[A-Za-z0-9+/_\-.~!@#$%^&*]{8,})"""

#: kind, keywords in lower case, expression tried at the hit, group that is the secret, check (None: the format has none)
RULES = (
    ("aws_key_id", ("akia", "asia"), r"(?<![A-Za-z0-9])A[KS]IA[A-Z2-7]{16}(?![A-Za-z0-9])", 0, aws_account),
    ("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", 0, lambda s: crc_tail(s, 4)),
    ("npm_token", ("npm_",), r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", 0, lambda s: crc_tail(s, 4)),
    ("github_pat", ("github_pat_",), r"(?<![A-Za-z0-9])github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}(?![A-Za-z0-9])", 0, None),
    ("gitlab_token", ("glpat-",), r"(?<![A-Za-z0-9])glpat-[A-Za-z0-9_\-]{20}(?![A-Za-z0-9_\-])", 0, None),
    ("slack_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9\-]{10,}", 0, None),
    ("stripe_key", ("sk_live_", "rk_live_"), r"(?<![A-Za-z0-9])[sr]k_live_[A-Za-z0-9]{16,}", 0, None),
    ("google_key", ("aiza",), r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_\-]{35}(?![A-Za-z0-9_\-])", 0, None),
    ("jwt", ("eyj",), r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_\-]{5,}\.[A-Za-z0-9_\-]{5,}\.[A-Za-z0-9_\-]{5,}", 0, jwt_header),
    ("private_key", ("-----begin",), rf"-----BEGIN (?P<t>[A-Z0-9 ]{{0,20}}PRIVATE KEY(?: BLOCK)?)-----\s*{_HEADER}*[A-Za-z0-9+/=\s]{{16,}}?-----END (?P=t)-----", 0, key_block),
    ("assigned_secret", ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth_key"), r"(?i)(?:password|passwd|pwd|secret|token|api[_\-]?key|access_key|auth_key)(?:[_\-]?\w{0,20})?[\"']?" + _ASSIGNED, "v", lambda s: entropy(s) >= 2.5 and any(c.isdigit() for c in s)),
)


class Scanner:
    def __init__(self, rules=RULES):
        self.rules = [(kind, re.compile(pattern), group, check) for kind, _, pattern, group, check in rules]
        self.words = ahocorasick.Automaton()
        for k, rule in enumerate(rules):
            for word in rule[1]:
                owners = self.words.get(word, (len(word), ()))[1]
                self.words.add_word(word, (len(word), (*owners, k)))
        self.words.make_automaton()

    def find(self, text: str) -> list[tuple[str, int, int, str]]:
        lower = text.lower()
        if len(lower) != len(text):
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found, tried = {}, {}
        for end, (length, owners) in self.words.iter(lower):
            for k in owners:
                kind, pattern, group, check = self.rules[k]
                # within a whole match of its own rule a hit has nothing new, and a long run of hits would be read again from each
                if end < tried.get(k, 0):
                    continue
                if m := pattern.match(text, end - length + 1):
                    if group == 0:
                        tried[k] = m.end()
                    holds = check(m.group(group)) if check else None
                    verdict = "unchecked" if holds is None else "valid" if holds else "invalid"
                    found[m.span(group)] = found.get(m.span(group)) or (kind, verdict)
        out, reach = [], 0
        for (a, b), (kind, verdict) in sorted(found.items(), key=lambda x: (x[0][0], -x[0][1])):
            if a >= reach:
                out.append((kind, a, b, verdict))
                reach = b
        return out

    def redact(self, text: str) -> str:
        out, at = [], 0
        for kind, a, b, verdict in self.find(text):
            if verdict != "invalid" or kind == "private_key":
                out += [text[at:a], f"[{kind.upper()}]"]
                at = b
        return "".join(out) + text[at:] if out else text


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kind, start, end, verdict`` of every finding."""

    def make():
        scanner = Scanner()

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(i, *f) for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for f in scanner.find(text)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "kind", "start", "end", "verdict"])

        return one

    some = picked(docs, id_col, text_col).where("doc_id is not null and text is not null")
    return map_slices(some, make, "text", "doc_id long, kind string, start int, end int, verdict string").distinct()


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced by its kind; ``length_col``, where there is one, follows the new text."""
    schema = docs.schema
    has = length_col in docs.columns if length_col else False

    def make():
        scanner = Scanner()

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            old = part.column(text_col).to_pylist()
            new = [t if t is None else scanner.redact(t) for t in old]
            changed = np.array([a != b for a, b in zip(old, new, strict=True)], bool)
            if not changed.any():
                return part
            cols = {n: part.column(n) for n in part.schema.names}
            cols[text_col] = pa.array(new, part.schema.field(text_col).type)
            if has:
                was = part.column(length_col).to_pylist()
                cols[length_col] = pa.array([len(t) if c else n for t, n, c in zip(new, was, changed, strict=True)], part.schema.field(length_col).type)
            return pa.RecordBatch.from_arrays(list(cols.values()), schema=part.schema)

        return one

    return map_slices(docs, make, text_col, schema)
