"""Unicode forms that Spark has no function for, as Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))


@F.pandas_udf(StringType())
def casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else v.casefold())
