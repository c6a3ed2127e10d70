"""zstd over Arrow batches; Spark has no such function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def compress(data: pd.Series) -> pd.Series:
    import zstandard

    z = zstandard.ZstdCompressor()
    return data.map(lambda x: None if x is None else z.compress(x))


@F.pandas_udf(T.BinaryType())
def decompress(data: pd.Series) -> pd.Series:
    """Raises on what isn't a zstd frame."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    return data.map(lambda x: None if x is None else z.decompress(x))


@F.pandas_udf(T.BinaryType())
def try_decompress(data: pd.Series) -> pd.Series:
    """Null for what isn't a zstd frame."""
    import zstandard

    def one(x):
        try:
            return None if x is None else zstandard.ZstdDecompressor().decompress(x)
        except zstandard.ZstdError:
            return None

    return data.map(one)
