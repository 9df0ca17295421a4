"""Unicode functions Spark lacks, as Arrow-batched functions with an ASCII fast path."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _nfkc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def _nfkd_ascii(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def letters_digits(text: str) -> str:
    """Composed, case-folded letters and digits of ``text``; accents count, all else is dropped."""
    folded = text.casefold() if text.isascii() else unicodedata.normalize(
        "NFC", unicodedata.normalize("NFC", text).casefold()
    )
    return folded if folded.isalnum() else "".join(filter(str.isalnum, folded))


def _mapped(function):
    @F.pandas_udf(T.StringType())
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    return apply


#: NFKC form; null stays null.
nfkc = _mapped(_nfkc)
#: ASCII letters that remain of the NFKD form.
nfkd_ascii = _mapped(_nfkd_ascii)
#: Full Unicode case folding (differs from ``lower`` for ß and the like).
casefold = _mapped(str.casefold)
#: Comparison key: letters and digits only.
letters_digits_key = _mapped(letters_digits)
