"""Hash coins. ``sql`` mode is md5 in any engine; ``exact`` mode is blake2b in an Arrow UDF."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def coin(text: Column, mode: str = "sql") -> Column:
    """A fraction in [0, 1) that depends on the text alone."""
    if mode == "sql":
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") / 2**64), "double")(text)


def hex_key(text: Column, mode: str = "sql") -> Column:
    """A hexadecimal key to order by."""
    if mode == "sql":
        return F.md5(text)

    def blake(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=8).hexdigest())

    return F.pandas_udf(blake, "string")(text)


def fold_coin(path: Column, test_frac: float, seed: int, mode: str = "sql") -> Column:
    return F.when(coin(F.concat(F.lit(f"{seed}-fold:"), path), mode) < test_frac, "test").otherwise("dev")


def yolo_split(individual: Column, val_frac: float, seed: int, mode: str = "sql") -> Column:
    return F.when(coin(F.concat(F.lit(f"{seed}:"), individual), mode) < val_frac, "val").otherwise("train")
