"""Optional envelope functions: HKDF-SHA-256 key derivation and AES-256-GCM.

AES is Spark's own; HMAC, which Spark lacks, is a pandas UDF over the standard library.
"""

from __future__ import annotations

import hashlib
import hmac
import os

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def hkdf_extract(salt: bytes, material: bytes) -> bytes:
    return hmac.new(salt, material, hashlib.sha256).digest()


def hkdf_expand(key: bytes, info: bytes) -> bytes:
    """One block, 32 bytes."""
    return hmac.new(key, info + b"\x01", hashlib.sha256).digest()


@F.pandas_udf(T.BinaryType())
def extract_key(salt: pd.Series, material: pd.Series) -> pd.Series:
    return pd.Series([hkdf_extract(bytes(s), bytes(m)) for s, m in zip(salt, material)])


@F.pandas_udf(T.BinaryType())
def expand_key(key: pd.Series, info: pd.Series) -> pd.Series:
    return pd.Series([hkdf_expand(bytes(k), bytes(i)) for k, i in zip(key, info)])


@F.pandas_udf(T.BinaryType())
def _random_bytes(n: pd.Series) -> pd.Series:
    return pd.Series([os.urandom(int(k)) for k in n])


def random_bytes(n: int) -> Column:
    """Not repeatable: write the result before anything reads it twice."""
    return _random_bytes.asNondeterministic()(F.lit(n))


def seal(plain: Column, key: Column, nonce: Column, header: Column) -> Column:
    """nonce, ciphertext and tag, one after another; ``header`` is authenticated too."""
    return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, header)


def unseal(data: Column, key: Column, header: Column) -> Column:
    """Null where authentication fails."""
    return F.try_aes_decrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), header)
