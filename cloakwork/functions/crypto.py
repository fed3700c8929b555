"""AES-256-GCM sealing of text columns, and fingerprints.

Sealed text travels as base64 of ``iv | tag | ciphertext`` (12, 16 and n bytes); Spark's own functions use
``iv | ciphertext | tag``, hence the slicing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

IV_BYTES = 12
TAG_BYTES = 16
KEY_BYTES = 32

def key_literal(key: bytes) -> Column:
    if len(key) != KEY_BYTES:
        raise ValueError(f"the key must have {KEY_BYTES} bytes, not {len(key)}")
    return F.lit(bytearray(key))


def _flat_base64(data: Column) -> Column:
    # Spark breaks long base64 text into lines, which would cut a token in two.
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def seal(value: Column, key: bytes, context: Column) -> Column:
    """Encrypt a text.

    The IV is derived from the key, the text and ``context`` (the position of the text) rather than drawn
    at random, so that a retried task or a replayed micro-batch writes the same bytes, and equal secrets in
    different places still look different.
    """
    secret = key_literal(key)

    def sealed(text: Column) -> Column:
        seed = F.concat(secret, F.encode(F.concat_ws("\u0001", context, text), "UTF-8"))
        iv = F.substring(F.unhex(F.sha2(seed, 256)), 1, IV_BYTES)
        return F.aes_encrypt(text, secret, F.lit("GCM"), F.lit("DEFAULT"), iv)

    def wire(data: Column) -> Column:
        body = F.octet_length(data) - IV_BYTES - TAG_BYTES
        return _flat_base64(
            F.concat(
                F.substring(data, 1, IV_BYTES),
                F.substring(data, body + IV_BYTES + 1, F.lit(TAG_BYTES)),
                F.substring(data, F.lit(IV_BYTES + 1), body),
            )
        )

    return let(value, lambda text: let(sealed(text), wire))


def unseal(payload: Column, key: bytes) -> Column:
    """Decrypt a sealed text; null when the key or the payload is wrong."""

    def decoded(digits: Column) -> Column:
        padding = F.substring(F.lit("==="), F.lit(1), F.pmod(-F.length(digits), F.lit(4)))
        return F.try_to_binary(F.concat(digits, padding), F.lit("base64"))

    def opened(data: Column) -> Column:
        body = F.octet_length(data) - IV_BYTES - TAG_BYTES
        spark_order = F.concat(
            F.substring(data, 1, IV_BYTES),
            F.substring(data, F.lit(IV_BYTES + TAG_BYTES + 1), body),
            F.substring(data, IV_BYTES + 1, TAG_BYTES),
        )
        plain = F.try_aes_decrypt(spark_order, key_literal(key), F.lit("GCM"))
        return F.when(body >= 0, plain.cast("string"))

    digits = F.translate(F.rtrim(payload, F.lit("=")), "-_", "+/")
    return let(let(digits, decoded), opened)


def fingerprint(value: Column) -> Column:
    """SHA-256 in hex: recognises the same secret in two places without keeping it."""
    return F.sha2(value, 256)
