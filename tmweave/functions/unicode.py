"""Unicode normal form C, for which Spark has no function of its own: Arrow batches, of strings beyond ASCII only."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfc(c: Column) -> Column:
    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.when(c.rlike(r"[^\x00-\x7F]"), compose(c)).otherwise(c)
