"""Addresses replaced by pseudonyms, and payloads hidden, in tables and in report documents."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from otspark.functions.net import pseudonym

#: Four numbers up to 255, with leading zeros or without.
OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
ADDRESS = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
HIDDEN = "[REDACTED]"
# fixed values: names of fields that hold payloads or parts of them
SENSITIVE = ("raw_bytes", "raw_payload", "payload_hex", "evidence_preview_hex", "evidence_preview_ascii", "http_context_excerpt", "snmp_community_redacted", "credential_hint_excerpt", "preview_hex", "excerpt", "community", "sample", "raw", "payload")


def without_addresses(text: Column) -> Column:
    """A text with each IPv4 address in it replaced by its pseudonym: what stands between them, and they, one after the other."""
    found = F.regexp_extract_all(text, F.lit(f"({ADDRESS})"), 1)
    between = F.split(text, ADDRESS, -1)
    pairs = F.arrays_zip(between.alias("a"), F.transform(found, pseudonym).alias("b"))
    return F.when(F.size(found) > 0, F.array_join(F.transform(pairs, lambda p: F.concat(F.coalesce(p["a"], F.lit("")), F.coalesce(p["b"], F.lit("")))), "")).otherwise(text)


def anonymised(df: DataFrame) -> DataFrame:
    """All texts and lists of texts of a table without addresses."""

    def one(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StringType):
            return without_addresses(c).alias(f.name)
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StringType):
            return F.transform(c, without_addresses).alias(f.name)
        return c

    return df.select(*[one(f) for f in df.schema])


def masked(df: DataFrame) -> DataFrame:
    """Columns that hold payloads hidden, as text; nulls stay."""
    hide = lambda f: F.when(F.col(f"`{f.name}`").isNotNull(), HIDDEN).alias(f.name)
    return df.select(*[hide(f) if f.name.lower() in SENSITIVE else F.col(f"`{f.name}`") for f in df.schema])


def pseudonym_of(ip: str) -> str:
    h = hashlib.sha256(ip.encode()).digest()
    return f"10.{h[0]}.{h[1]}.{h[2]}"


def document(value, *, anonymise: bool = False, mask: bool = False):
    """A report document with addresses replaced and payload fields hidden; the one given stays as it is."""
    if isinstance(value, dict):
        return {k: HIDDEN if mask and isinstance(v, str) and str(k).lower() in SENSITIVE else document(v, anonymise=anonymise, mask=mask) for k, v in value.items()}
    if isinstance(value, list):
        return [document(v, anonymise=anonymise, mask=mask) for v in value]
    return re.sub(ADDRESS, lambda m: pseudonym_of(m[0]), value) if anonymise and isinstance(value, str) else value
