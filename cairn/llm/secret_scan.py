"""Secret scans: an Aho-Corasick automaton finds keywords, anchored expressions run only at their hits, and
tokens that embed a checksum are validated by it.

Hex runs hold no word, so they have a prefilter of their own: each character is marked as a hex digit or not, and the
keyword is a row of 24 marks; the anchored expression then takes the run from there.

Texts go through one vectorised scalar function, row by row; nothing is shuffled and memory is bounded by one
Arrow batch.  Both keyword passes are linear in the text; an anchored expression reads only from
its hit on and takes each character at most once, so very long texts cost no more a character than short ones.

Defined results: null text is the empty text and has no spans; repeated rows get equal results; offsets are
code points, ends exclusive.  Other columns of the input pass through.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import ascii_lower, bound_batches, spans_digest, table, text_or_empty

# Keywords and patterns of the contract, then public token formats.
ASSIGN_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX, HEX_LEAST = re.compile(r"[0-9a-f]+"), 24
CRC_TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
KINDS = {k: i for i, k in enumerate(("assign", "access", "hex", "checksum", "jwt", "pem"))}
BASE = ("assign", "access", "hex")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


#: Hex runs hold no word to look for; marked character by character, their keyword is a row of marks.
_MARK, _MARKS = b"h", bytes(104 if chr(i) in "0123456789abcdef" else 46 for i in range(256))


def base62_crc32(body: str) -> str:
    """crc32 of ``body`` in base 62, six digits: the checksum that ends checksummed access tokens."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    words = [(w, "assign") for w in ASSIGN_KEYWORDS] + [("akia", "access"), ("eyj", "jwt"), ("-----begin ", "pem")] + [(f"gh{c}_", "checksum") for c in "pousr"] + [("npm_", "checksum")]
    for w, kind in words:
        a.add_word(w, (len(w), kind))
    a.make_automaton()
    return a


def _validated(kind: str, text: str, at: int) -> int:
    """The end of a valid ``kind`` at ``at``, or -1."""
    if kind == "checksum":
        m = CRC_TOKEN.match(text, at)
        return m.end() if m and base62_crc32(m[1]) == m[2] else -1
    if kind == "jwt":
        m = JWT.match(text, at)
        if not m:
            return -1
        try:
            head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
        except (binascii.Error, ValueError, RecursionError):
            return -1
        return m.end() if isinstance(head, dict) and "alg" in head else -1
    m = PEM.match(text, at)
    if not m:
        return -1
    try:
        return m.end() if len(base64.b64decode("".join(m[2].split()), validate=True)) >= 16 else -1
    except (binascii.Error, ValueError):
        return -1


class Scanner:
    """Finds the spans of one text; holds the automaton."""

    def __init__(self):
        self.automaton = _automaton()

    @staticmethod
    def hex_runs(text: str) -> Iterator[tuple[int, int, str]]:
        """One byte stands for each code point, so places are the text's own."""
        marked, keyword = text.encode("latin-1", "replace").translate(_MARKS), _MARK * HEX_LEAST
        at = marked.find(keyword)
        while at >= 0:
            end = HEX.match(text, at).end()
            yield at, end, "hex"
            at = marked.find(keyword, end)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of all spans; base kinds are leftmost and do not overlap within a kind."""
        found = list(self.hex_runs(text))
        hits = sorted((end - n + 1, kind) for end, (n, kind) in self.automaton.iter(ascii_lower(text)))
        past = dict.fromkeys(KINDS, 0)
        for at, kind in hits:
            if at < past[kind]:
                continue
            if kind == "assign":
                if m := ASSIGN.match(text, at):
                    past[kind] = m.end()
                    if m.end(1) - m.start(1) >= 6:
                        found.append((at, m.end(), kind))
            elif kind == "access":
                if m := ACCESS.match(text, at):
                    past[kind] = m.end()
                    if m.end() - at >= 20:
                        found.append((at, m.end(), kind))
            elif (end := _validated(kind, text, at)) > 0:
                past[kind] = end
                found.append((at, end, kind))
        return found

    def redact(self, text: str, mask: str) -> str:
        """``text`` with every span (overlapping ones merged) replaced by ``mask``."""
        out, last = [], 0
        for s, e, _ in sorted(self.spans(text)):
            if s >= last:
                out += [text[last:s], mask]
            last = max(last, e)
        return "".join([*out, text[last:]]) if last else text


DIGEST = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long, n_added long"


def _digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    scanner = Scanner()
    for texts in batches:
        rows = []
        for text in texts:
            spans = scanner.spans(text)
            base = [x for x in spans if x[2] in BASE]
            n = [sum(x[2] == k for x in base) for k in BASE]
            rows.append((*n, hashlib.sha256(spans_digest(base, KINDS).encode()).hexdigest(), spans_digest(spans, KINDS), len(spans), len(spans) - len(base)))
        yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans", "n_added"])


def redactor(mask: str):
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner()
        for texts in batches:
            yield pd.Series([None if t is None else scanner.redact(t, mask) for t in texts], dtype=object)

    return run


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mask``; ``n_chars``, where there is one, follows."""
    bound_batches(docs.sparkSession)
    out = docs.withColumn("text", redactor(mask)(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the digest columns of every row of ``docs``."""
    return docs.select("doc_id", F.pandas_udf(_digest, DIGEST)(text_or_empty()).alias("_r")).select("doc_id", "_r.*")


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Contract of op8 over all of ``documents``; the number of all spans and of those with a valid checksum follow."""
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))
