"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns near hits, checksum validation.

One pass of a keyword automaton over the lower-cased text finds where a secret
can start; the kind's pattern is then tried at those places alone, left to
right and without overlaps within a kind.  Runs of hex digits have no keyword:
they are found by one linear scan.  Token kinds that carry a CRC-32 in base 62
count only if it fits.  Offsets are code points, ends exclusive.

Defined results: null and empty texts have no spans; of spans that start together
the kind listed first comes first; repeated rows are scanned each; texts of any
length are scanned whole; a column ``secrets`` of the input is replaced, others
stay, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = {c: c + 32 for c in range(65, 91)}


def base62_crc(payload: str) -> str:
    """CRC-32 of the payload as six base-62 digits."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out


def _checked(m: re.Match) -> bool:
    body = m[1]
    return base62_crc(body[:-6]) == body[-6:]


_RULES = {
    "assign": (_ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (_ACCESS, lambda m: m.end() - m.start() >= 20),
    "github": (_GITHUB, _checked),
    "npm": (_NPM, _checked),
}
_AUTOMATON = None


def _automaton() -> ahocorasick.Automaton:
    global _AUTOMATON
    if _AUTOMATON is None:
        a = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            a.add_word(word, (kind, len(word)))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start, then kind as listed."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # some letters grow when lower-cased: keep offsets
        low = text.translate(_LOWER)
    starts: dict[str, list[int]] = {}
    for end, (kind, n) in _automaton().iter(low):
        starts.setdefault(kind, []).append(end - n + 1)
    spans = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    for kind, at in starts.items():
        pattern, valid = _RULES[kind]
        free = 0
        for s in sorted(at):
            if s >= free and (m := pattern.match(text, s)):
                free = m.end()
                if valid(m):
                    spans.append((s, free, kind))
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones merged, replaced by ``mark``."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at, upto = [], 0, 0
    for s, e, _ in spans:
        if s >= upto:
            out += [text[at:s], mark]
        at = upto = max(upto, e)
    return "".join([*out, text[at:]])


def _digest(spans: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans if k in kinds)


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with a struct column ``secrets``: counts of the base kinds, their digest, all spans."""
    small_batches(documents.sparkSession)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def secrets(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        base = KINDS[:3]
        for batch in texts:
            rows = []
            for t in batch:
                found = find_spans(t)
                rows.append([sum(x[2] == k for x in found) for k in base] + [hashlib.sha256(_digest(found, base).encode()).hexdigest(), _digest(found, KINDS)])
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return documents.withColumn("secrets", secrets(text))


def redacted(documents: DataFrame) -> DataFrame:
    """``documents`` whose texts have their secrets replaced and whose ``n_chars``, if there, follows."""
    small_batches(documents.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([redact(t) for t in batch], dtype=object)

    out = documents.withColumn("text", clean("text"))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out
