"""Canonical forms: compatibility-normalised text, keys under which names are the same, and fingerprints of nested values.

Unicode's NFKC and case folding are not among Spark's functions, so these run over Arrow, a column at a time. Null stays
null; text that is no JSON has no canonical form and no fingerprint (null); the empty text is one like any other.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: what a key is without: white space and . _ - ·
SEPARATORS = re.compile(r"[\s·._\-]+")


def _compact(text: str) -> str:
    whole = text if text.isascii() else unicodedata.normalize("NFKC", text)
    return " ".join(whole.split())


def _form(value, without: frozenset[str]):
    if isinstance(value, str):
        return _compact(value)
    if isinstance(value, list):
        return [_form(x, without) for x in value]
    if isinstance(value, dict):
        return {k: _form(x, without) for k, x in value.items() if k not in without}
    return value


def _written(text: str | None, without: frozenset[str]) -> str | None:
    try:
        return None if text is None else json.dumps(_form(json.loads(text), without), ensure_ascii=False, sort_keys=True)
    except (ValueError, RecursionError):
        return None


def nfkc(c: str | Column) -> Column:
    """NFKC with runs of white space as one space and none at the ends."""

    @F.pandas_udf("string")
    def compact(texts: pd.Series) -> pd.Series:
        return texts.map(_compact, na_action="ignore")

    return compact(c)


def name_key(c: str | Column) -> Column:
    """Form under which names are the same: NFKC, case folded, without separators."""

    @F.pandas_udf("string")
    def key(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: SEPARATORS.sub("", unicodedata.normalize("NFKC", t).casefold()), na_action="ignore")

    return key(c)


def canonical_json(c: str | Column, without: tuple[str, ...] = ()) -> Column:
    """JSON text with all texts inside in NFKC and compact, keys sorted, at any depth; `without`: keys that go."""
    gone = frozenset(without)

    @F.pandas_udf("string")
    def written(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _written(t, gone)).astype(object)

    return written(c)


def json_fingerprint(c: str | Column, without: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the canonical form of JSON text: the same for any order of keys, width of letters and white space."""
    gone = frozenset(without)

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        made = texts.map(lambda t: _written(t, gone)).astype(object)
        return made.map(lambda t: hashlib.sha256(t.encode()).hexdigest(), na_action="ignore")

    return digest(c)
