"""Column encryption: AES-GCM with a random vector per value, as URL-free base64 text."""

from __future__ import annotations

import base64
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F


def generate_key() -> bytes:
    """A fresh 256-bit key. Keeping it is up to the caller."""
    return secrets.token_bytes(32)


def _key(key: bytes) -> Column:
    if len(key) not in (16, 24, 32):
        raise ValueError("an AES key has 16, 24 or 32 bytes")
    return F.unbase64(F.lit(base64.b64encode(key).decode("ascii")))


def encrypt(value: Column, key: bytes) -> Column:
    """Empty stays empty, null stays null."""
    sealed = F.base64(F.aes_encrypt(F.encode(value, "UTF-8"), _key(key), F.lit("GCM")))
    return F.when(value == "", "").otherwise(sealed)


def decrypt(value: Column, key: bytes) -> Column:
    """Fails on a wrong key or damaged text."""
    opened = F.decode(F.aes_decrypt(F.unbase64(value), _key(key), F.lit("GCM")), "UTF-8")
    return F.when(value == "", "").otherwise(opened)


def try_decrypt(value: Column, key: bytes) -> Column:
    """Null on a wrong key or damaged text."""
    opened = F.decode(F.try_aes_decrypt(F.unbase64(value), _key(key), F.lit("GCM")), "UTF-8")
    return F.when(value == "", "").otherwise(opened)


def reencrypt(value: Column, old_key: bytes, new_key: bytes) -> Column:
    return encrypt(decrypt(value, old_key), new_key)
