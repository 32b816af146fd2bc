"""Text statistics as column expressions and as a grouped operator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY_CHARACTER = "(?s)."


def characters(text: Column) -> Column:
    """All characters of a text; an empty text has none."""
    return F.regexp_extract_all(text, F.lit(ANY_CHARACTER), F.lit(0))


def text_entropy(text: Column) -> Column:
    """Shannon entropy (bits per character) of one text held in a row; 0 for an empty text or none.

    A text is read once, whatever its alphabet: its code points are counted as numbers.
    """

    @F.pandas_udf("double")
    def entropy(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            if t:
                n = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4"))
                n = n[n > 0].astype(float)
                out[i] = max(np.log2(n.sum()) - (n * np.log2(n)).sum() / n.sum(), 0.0)
        return pd.Series(out)

    return entropy(text)


def character_entropy(df: DataFrame, keys: list[str], text_columns: list[str], name: str = "entropy") -> DataFrame:
    """Entropy over all characters of a group's texts, for groups of any size.

    Characters are counted per (group, character) with map-side combining, so a hot group sends at most its
    alphabet from each task.
    """
    text = F.concat_ws("", *text_columns)
    per_char = (
        df.select(*keys, F.explode_outer(characters(text)).alias("_c"))
        .groupBy(*keys, "_c")
        .agg(F.count("_c").alias("_n"))
    )
    n = F.col("_n").cast("double")
    total = F.sum(n)
    bits = F.log2(total) - F.sum(F.when(n > 0, n * F.log2(n))) / total
    return per_char.groupBy(*keys).agg(F.when(total > 0, F.greatest(bits, F.lit(0.0))).otherwise(F.lit(0.0)).alias(name))
