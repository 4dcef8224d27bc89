"""Embedders: texts to vectors. Any object with ``dimensions`` and ``column`` serves; a model's would wrap an Arrow function."""

from __future__ import annotations

from array import array
from hashlib import md5
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.terms import terms_of


class Embedder(Protocol):
    """Vectors of questions and of documents may differ; both have ``dimensions`` numbers."""

    dimensions: int

    def column(self, text: Column, kind: str = "document") -> Column: ...


class _Places(dict):
    """The number that its MD5 gives each term, made when it is first asked for."""

    def __missing__(self, term: str) -> int:
        self[term] = number = int(md5(term.encode()).hexdigest()[:8], 16)
        return number


class HashingEmbedder:
    """Without any model: each search term counts at the place, and with the sign, that its MD5 gives; texts without terms are zero."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def column(self, text: Column, kind: str = "document") -> Column:
        size = self.dimensions
        places = _Places()

        @F.pandas_udf("array<double>")
        def embed(texts: pd.Series) -> pd.Series:
            cells, signs, ends = array("q"), array("b"), []
            for value in texts:
                numbers = list(map(places.__getitem__, terms_of(value)))
                cells.extend([n // 2 % size for n in numbers])
                signs.extend([1 - 2 * (n % 2) for n in numbers])
                ends.append(len(cells))
                if len(places) > 200_000:
                    places.clear()
            rows = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
            made = np.bincount(rows * size + np.array(cells, np.int64), np.array(signs, np.float64), minlength=len(texts) * size)
            return pd.Series(list(made.reshape(len(texts), size)))

        return embed(F.coalesce(text, F.lit("")))
