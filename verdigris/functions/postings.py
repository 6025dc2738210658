"""Inverted indexes of single texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType


@F.pandas_udf(MapType(StringType(), ArrayType(IntegerType())))
def word_positions(words: pd.Series) -> pd.Series:
    """Each distinct word of a list with its places in it; a missing list has none."""

    def places(row) -> dict[str, list[int]]:
        found: dict[str, list[int]] = {}
        for i, word in enumerate(() if row is None else row):
            found.setdefault(word, []).append(i)
        return found

    return words.map(places)
