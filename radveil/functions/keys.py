"""Keyed hashing and name keys as native columns.

Nulls: a null value gives a null hash; a null name counts as the empty name.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed import TITLES

SEPARATOR = "\x1f"
VOWELS_AND_SOFT = "[aeiouyhw]"  # Fixed value: letters dropped from masked names
LINK_LABEL = b"ksrl-link-v1"  # Fixed value: hashes must equal those of earlier data


@dataclass(frozen=True)
class LinkKey:
    """The linkage key.

    ``key_file``: executors read the key from there and hash in Python, so that no plan holds it
    (production). Without it the key is ``secret`` and hashes are native expressions; its pads
    stand in the plan, so that is for public test keys only.
    """

    secret: bytes | None = None
    key_file: str | None = None

    def bytes(self) -> bytes:
        if self.key_file:
            with open(self.key_file) as f:
                return derive(base64.b64decode(f.read().strip()), LINK_LABEL)
        return self.secret or b""

    def pads(self) -> tuple[bytes, bytes]:
        k = self.bytes()
        k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
        return bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)


PUBLIC_TEST_KEY = LinkKey(secret=b"public test key, protects nothing")


def derive(master: bytes, label: bytes) -> bytes:
    """A sub-key of the master key."""
    return hmac.new(master, label, hashlib.sha256).digest()


def keyed_hash(value: Column, domain: str, key: LinkKey = PUBLIC_TEST_KEY, n: int = 32) -> Column:
    """First n hex digits of HMAC-SHA256(key, domain 0x1F value)."""
    if key.key_file:
        return _executor_hash(key.key_file, domain, n)(value)
    inner, outer = key.pads()
    message = F.encode(F.concat(F.lit(domain + SEPARATOR), value), "UTF-8")
    digest = F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message), 256))), 256)
    return F.substring(digest, 1, n)


def _executor_hash(key_file: str, domain: str, n: int):
    @F.pandas_udf(T.StringType())
    def f(values: pd.Series) -> pd.Series:
        secret = LinkKey(key_file=key_file).bytes()
        return values.map(lambda v: None if v is None else hmac.new(secret, f"{domain}{SEPARATOR}{v}".encode(), hashlib.sha256).hexdigest()[:n])

    return f


def significant_tokens(name: Column) -> Column:
    """Lower-case runs of two or more letters a-z that are no honorific; repeats stay, order stays."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return F.filter(runs, lambda t: (F.length(t) > 1) & ~t.isin(*TITLES))


def mask_token(token: Column) -> Column:
    """Collapse repeated letters, then drop vowels, y, h and w behind the first letter."""
    once = F.regexp_replace(token, r"(.)\1+", "$1")
    return F.concat(F.substring(once, 1, 1), F.regexp_replace(F.substr(once, F.lit(2)), VOWELS_AND_SOFT, ""))


def sorted_join(tokens: Column) -> Column:
    return F.concat_ws(" ", F.array_sort(tokens))


def masked_name(name: Column) -> Column:
    """Masked tokens in order of the alphabet, one blank between."""
    return sorted_join(F.transform(significant_tokens(name), mask_token))


def name_norm(name: Column) -> Column:
    return sorted_join(significant_tokens(name))


def birth_year_range(year: Column, width: int = 5) -> Column:
    """'1975-1979' for 1979; 'NA' for null."""
    start = year - F.pmod(year, F.lit(width))
    return F.coalesce(F.concat(start.cast("string"), F.lit("-"), (start + width - 1).cast("string")), F.lit("NA"))


def soundex(text: Column) -> Column:
    """American Soundex of the letters a-z; 'NA' where there are none."""
    letters = F.regexp_replace(F.lower(text), "[^a-z]", "")
    return F.coalesce(F.soundex(F.nullif(letters, F.lit(""))), F.lit("NA"))


def pik(name: Column, sex: Column, birth_year: Column, key: LinkKey = PUBLIC_TEST_KEY, address: Column | None = None) -> Column:
    """Struct of masked name, its three hashed parts, the joined key and the number of tokens."""
    masked = masked_name(name)
    place = F.when(F.coalesce(address, F.lit("")) == "", F.lit("NA")).otherwise(soundex(address)) if address is not None else F.lit("NA")
    parts = [keyed_hash(masked, "ksrl:name", key), keyed_hash(F.concat(sex, birth_year_range(birth_year)), "ksrl:demo", key), keyed_hash(place, "ksrl:addr", key)]
    return F.struct(
        masked.alias("masked_name"),
        *(p.alias(n) for p, n in zip(parts, ("name_part", "demo_part", "addr_part"))),
        F.upper(F.concat(*parts)).alias("pik"),
        F.size(F.filter(F.split(masked, " "), lambda t: t != "")).cast("int").alias("n_tokens"),
    )


def id_normalised(value: Column) -> Column:
    """Without white space; null if nothing is left."""
    return F.nullif(F.regexp_replace(value, r"(?U)[\s\x1c-\x1f]+", ""), F.lit(""))
