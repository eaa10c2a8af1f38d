"""MinHash signatures, their similarity, bands and byte form."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import PRIME, permutations
from .text import let

MAGIC = b"SLMH"


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod 2**31 - 1 for 0 <= x < 2**62."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


def minhash_udf(num_perm: int, seed: int = 7):
    """array<bigint> of element hashes -> array<bigint> signature; all PRIME for no element, null for null.

    The rows of a batch are hashed together and their minima taken by segment; the product of permutations and hashes is bounded by chunks.
    """
    a, b = (np.array(x, np.int64) for x in permutations(num_perm, seed))

    @F.pandas_udf("array<bigint>")
    def minhash(hashes: pd.Series) -> pd.Series:
        n = np.array([0 if h is None else len(h) for h in hashes])
        out = np.full((len(n), num_perm), PRIME, np.int64)
        some = np.flatnonzero(n)
        lo = 0
        while lo < len(some):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(n[some[lo:]]), 1 << 17)))
            rows = some[lo:hi]
            flat = np.concatenate([np.asarray(hashes.iloc[i], np.int64) for i in rows])
            at = np.cumsum(n[rows]) - n[rows]
            for k in range(num_perm):
                out[rows, k] = np.minimum.reduceat(_mod(flat * a[k] + b[k]), at)
            lo = hi
        return pd.Series([None if h is None else s for h, s in zip(hashes, out)])

    return minhash


def minhash_columns(hashes: Column, num_perm: int, seed: int = 7) -> Column:
    """The same by higher-order functions, for cross-checks."""
    a, b = permutations(num_perm, seed)
    pairs = F.array(*(F.struct(F.lit(x).cast("bigint").alias("a"), F.lit(y).cast("bigint").alias("b")) for x, y in zip(a, b)))
    return let(hashes, lambda hs: F.transform(pairs, lambda p: F.coalesce(F.array_min(F.transform(hs, lambda h: (p["a"] * h + p["b"]) % F.lit(PRIME))), F.lit(PRIME).cast("bigint"))))


def jaccard(x: Column, y: Column) -> Column:
    """Share of equal places; an error where the lengths differ."""
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda z: z)) / F.size(x)
    return F.when(F.size(x) != F.size(y), F.raise_error(F.lit("signatures of unequal length"))).otherwise(same)


def band_keys(sig: Column, bands: int, rows: int) -> Column:
    """One string per band: its rows' values, joined; values beyond bands x rows are unused."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.array_join(F.slice(sig, i * rows + 1, rows), "-"))


def packed_size(num_perm: int) -> int:
    return len(MAGIC) + 4 + 4 * num_perm


def pack_signature(sig) -> bytes:
    """Magic, count and values, big-endian."""
    if not 2 <= len(sig) <= 4096:
        raise ValueError("a signature has 2 to 4096 values")
    return MAGIC + struct.pack(f">I{len(sig)}I", len(sig), *map(int, sig))


def unpack_signature(raw: bytes) -> list[int]:
    if len(raw) < 8 or raw[:4] != MAGIC:
        raise ValueError("not a packed signature")
    (n,) = struct.unpack_from(">I", raw, 4)
    if not 2 <= n <= 4096 or len(raw) != packed_size(n):
        raise ValueError("a packed signature of the wrong length")
    return list(struct.unpack_from(f">{n}I", raw, 8))


@F.arrow_udf(T.BinaryType())
def pack_udf(sigs: pa.Array) -> pa.Array:
    n = pc.list_value_length(sigs)
    size = pc.max(n).as_py() or 0
    values = sigs.flatten()
    if size >= 2 and size <= 4096 and not sigs.null_count and pc.min(n).as_py() == size and not values.null_count:
        # All of one length.
        head = np.frombuffer(MAGIC + struct.pack(">I", size), np.uint8)
        out = np.empty((len(sigs), packed_size(size)), np.uint8)
        own = values.to_numpy()
        if not ((own >= 0) & (own < 1 << 32)).all():
            raise ValueError("a signature's values have 32 bits")
        out[:, : len(head)] = head
        out[:, len(head) :] = own.reshape(len(sigs), size).astype(">u4").view(np.uint8)
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(out.shape[1]), len(out), [None, pa.py_buffer(out)]).cast(pa.binary())
    return pa.array([None if s is None else pack_signature(s) for s in sigs.to_pylist()], pa.binary())


@F.arrow_udf(T.ArrayType(T.LongType()))
def unpack_udf(raws: pa.Array) -> pa.Array:
    """Null for what is no packed signature, so that a corrupt row can be found and skipped."""
    size = pc.max(pc.binary_length(raws)).as_py() or 0
    n = (size - packed_size(0)) // 4
    if 2 <= n <= 4096 and size == packed_size(n) and not raws.null_count and pc.min(pc.binary_length(raws)).as_py() == size:
        own = np.frombuffer(b"".join(raws.to_pylist()), np.uint8).reshape(len(raws), size)
        head = np.frombuffer(MAGIC + struct.pack(">I", n), np.uint8)
        if (own[:, : len(head)] == head).all():
            values = np.ascontiguousarray(own[:, len(head) :]).view(">u4").astype(np.int64)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(raws) + 1, dtype=np.int32) * n), pa.array(values.ravel()))

    def one(raw):
        try:
            return unpack_signature(raw)
        except (ValueError, TypeError):
            return None

    return pa.array([one(x) for x in raws.to_pylist()], pa.list_(pa.int64()))
