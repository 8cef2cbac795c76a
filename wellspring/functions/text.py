"""Text keys and null-token handling shared by all operators."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: null tokens of tabular inputs
NULL_TOKENS = ("", "NULL", "NONE", "N/A", "NA", "NAN", "-999.25")


def nfkc_key(text: str | None) -> str | None:
    """NFKC, trimmed, upper case, letters and digits only; None stays None."""
    if text is None:
        return None
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text).strip().upper())


def name_key(text: str | None) -> str:
    """Comparable well name: NFKC, upper case, 0-9 A-Z and U+4E00..U+9FFF only."""
    return re.sub(r"[^0-9A-Z一-鿿]+", "", unicodedata.normalize("NFKC", text or "").upper())


@F.pandas_udf(T.StringType())
def nfkc_key_udf(texts: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(texts)
    keys = [nfkc_key(t) for t in distinct]
    return pd.Series([keys[c] if c >= 0 else None for c in codes], dtype=object)


def well_key(c: Column) -> Column:
    """JVM-only well key for ASCII and CJK names: upper case, then 0-9 A-Z and
    U+4E00..U+9FFF only. Use nfkc_key_udf where full-width forms may occur."""
    return F.regexp_replace(F.upper(F.trim(c)), "[^0-9A-Z一-鿿]", "")


def clean_text(c: Column) -> Column:
    """Null tokens become NULL."""
    return F.when(~F.upper(F.trim(c)).isin(*NULL_TOKENS), c)


def finite_number(c: Column) -> Column:
    """Text to a finite double; thousands commas dropped; anything else NULL."""
    v = F.regexp_replace(clean_text(c), ",", "").try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def finite(c: Column) -> Column:
    """NaN and infinities of a double column become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)
