"""Encoding and decoding by a tokenizer file, as Arrow-batched functions.

The library (``tokenizers``) and its file are named by the caller; one tokenizer
is kept a worker.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEPT: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _KEPT:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _KEPT.clear()
        _KEPT[path] = Tokenizer.from_file(path)
    return _KEPT[path]


def encode(text: Column, path: str, special: bool = False) -> Column:
    """Ids of a text; a null text has none."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(x: pd.Series) -> pd.Series:
        found = _tokenizer(path).encode_batch_fast(x.fillna("").tolist(), add_special_tokens=special)
        return pd.Series([e.ids for e in found], index=x.index)

    return run(text)


def decode(ids: Column, path: str, skip_special: bool = True) -> Column:
    """Text of ids; null ids are the empty text."""

    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        rows = [[] if v is None else [int(i) for i in v] for v in x]
        return pd.Series(_tokenizer(path).decode_batch(rows, skip_special_tokens=skip_special), index=x.index)

    return run(ids)
