"""Vector expressions on arrays of doubles, and hashes and sketches that need unsigned arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length; 0 where either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def complement_code(a: Column) -> Column:
    """``(a, 1 - a)`` for values in [0, 1]."""
    return F.concat(a, F.transform(a, lambda x: 1 - x))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def sigmoid(x: Column, midpoint: float = 0.0, steepness: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-steepness * (x - midpoint)))


def project_to(a: Column, dim: int) -> Column:
    """Cut or padded with zeros to ``dim``, then of length one (a zero vector stays zero)."""
    sized = F.slice(F.concat(a, F.array_repeat(F.lit(0.0), dim)), 1, dim)
    n = norm(sized)
    return F.when(n > 0, F.transform(sized, lambda x: x / n)).otherwise(sized)


_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a_array(values: list[str]) -> np.ndarray:
    """FNV-1a 64 of each string's UTF-8 bytes, vectorised over the strings."""
    raw = [v.encode() for v in values]
    size = np.array([len(r) for r in raw])
    width = int(size.max()) if len(raw) else 0
    grid = np.zeros((len(raw), width), dtype=np.uint64)
    for k, r in enumerate(raw):
        grid[k, : len(r)] = np.frombuffer(r, dtype=np.uint8)
    h = np.full(len(raw), _OFFSET, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for c in range(width):
            h = np.where(c < size, (h ^ grid[:, c]) * np.uint64(_PRIME), h)
    return h


def fnv1a(text: Column) -> Column:
    """FNV-1a 64 as the bigint of the same bits; null for null."""

    def run(values: pd.Series) -> pd.Series:
        out = fnv1a_array([v or "" for v in values]).view(np.int64)
        return pd.Series(out, dtype="Int64").mask(values.isna())

    return F.pandas_udf(run, "long")(text)


def simhash(term_array: Column) -> Column:
    """64-bit SimHash of a set of terms: bit i is set where the terms' FNV-1a bits i are mostly set; null without terms."""

    def run(values: pd.Series) -> pd.Series:
        lists = [v if v is not None else () for v in values]
        size = np.array([len(v) for v in lists], dtype=np.int64)
        out = pd.Series([None] * len(lists), dtype="Int64")
        if not size.sum():
            return out
        index, vocabulary = pd.factorize(np.concatenate([np.asarray(v, dtype=object) for v in lists if len(v)]))
        bits = np.unpackbits(fnv1a_array(list(vocabulary)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        some = np.flatnonzero(size)
        at = np.concatenate([[0], np.cumsum(size[some])])
        for k, row in enumerate(some):
            ones = bits[index[at[k] : at[k + 1]]].sum(axis=0, dtype=np.int64)
            out[row] = int(np.packbits(ones * 2 > size[row], bitorder="little").view(np.int64)[0])
        return out

    return F.pandas_udf(run, "long")(term_array)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def feature_hash(term_array: Column, dim: int = 64) -> Column:
    """Signed feature hashing of terms to a vector of length one: bucket by FNV-1a, sign by its highest bit."""

    def run(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            x = np.zeros(dim)
            if v is not None and len(v):
                h = fnv1a_array(list(v))
                np.add.at(x, (h % np.uint64(dim)).astype(int), np.where(h >> np.uint64(63), -1.0, 1.0))
                n = np.linalg.norm(x)
                x = x / n if n else x
            out.append(x.tolist())
        return pd.Series(out)

    return F.pandas_udf(run, "array<double>")(term_array)


def hyperplane_buckets(vector: Column, dim: int, tables: int = 12, planes: int = 10, seed: int = 42) -> Column:
    """Sign bits of ``planes`` random hyperplanes per table, as an array of ``tables`` bucket numbers."""

    def run(values: pd.Series) -> pd.Series:
        planes_ = np.random.RandomState(seed).randn(tables, planes, dim)
        x = np.array([np.asarray(v, dtype=float) if v is not None and len(v) == dim else np.zeros(dim) for v in values]).reshape(-1, dim)
        bits = np.einsum("nd,tpd->ntp", x, planes_) > 0
        return pd.Series(list(bits @ (1 << np.arange(planes)[::-1])))

    return F.pandas_udf(run, "array<long>")(vector)
