"""Content-addressed identity: canonical JSON (sorted keys, no blanks), domain-separated ids, digests.

An id is ``prefix`` + base64url(sha256(canonical JSON of {domain, payload, version: 1})) without padding.  Column
forms build the JSON from struct columns with ``to_json``; declare fields in key order.  Control characters other
than the short escapes are written by ``to_json`` in upper-case hex and are lowered here.
"""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


def canonical_json(value: Column, keep_nulls: bool = True) -> Column:
    """Canonical JSON of a struct column whose fields are declared in key order."""
    codes = F.array(*[F.lit(f"{code:04X}") for code in (0x0B, *range(0x0E, 0x20))])
    # An escape follows an even number of backslashes.
    lowered = lambda out, c: F.regexp_replace(out, F.concat(F.lit(r"(?<!\\)((?:\\\\)*)\\u"), c), F.concat(F.lit(r"$1\\u"), F.lower(c)))
    # The text is named once: a repeated expression would grow threefold with every id built on another.
    fixed = lambda t: F.when(t.contains("\\u00"), F.aggregate(codes, t, lowered)).otherwise(t)
    return F.element_at(F.transform(F.array(F.to_json(value, KEEP_NULLS if keep_nulls else {})), fixed), 1)


def base64url_sha256(text: Column) -> Column:
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(text.cast("binary"), 256))), "+/", "-_"), F.lit("="))


def domain_id(prefix: str, domain: str, payload: Column) -> Column:
    """The id of ``payload`` (a struct column with fields in key order) in ``domain``."""
    envelope = F.struct(F.lit(domain).alias("domain"), payload.alias("payload"), F.lit(1).alias("version"))
    return F.concat(F.lit(prefix), base64url_sha256(canonical_json(envelope)))


def domain_id_of(prefix: str, domain: str, payload) -> str:
    """The same on the driver, for tests and single values."""
    text = json.dumps({"domain": domain, "payload": payload, "version": 1}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return prefix + base64.urlsafe_b64encode(hashlib.sha256(text.encode()).digest()).decode().rstrip("=")


def row_digest(value: Column) -> Column:
    """Digest of a recorded row; absent (null) fields are left out."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(value, keep_nulls=False).cast("binary"), 256))
