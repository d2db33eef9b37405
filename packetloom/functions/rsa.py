"""RSA private keys and PKCS 1 decryption in plain integers: what beacon metadata needs, and nothing that makes keys."""

from __future__ import annotations

import base64
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_der(data: bytes, at: int = 0) -> tuple[int, bytes, int]:
    """(tag, content, end) of the value at a place."""
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 128:
        n = size & 127
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return tag, data[at : at + size], at + size


def values_of(data: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(data):
        tag, content, at = read_der(data, at)
        out.append((tag, content))
    return out


def private_key(pem: str) -> tuple[int, int]:
    """(modulus, exponent) of a private key in PEM, PKCS 1 or PKCS 8."""
    body = re.sub(r"-----[^-]+-----|\s", "", pem)
    parts = values_of(read_der(base64.b64decode(body))[1])
    if len(parts) >= 3 and parts[2][0] == 4:  # PKCS 8 wraps the other form
        parts = values_of(read_der(parts[2][1])[1])
    numbers = [int.from_bytes(c, "big") for tag, c in parts if tag == 2]
    if len(numbers) < 4:
        raise ValueError("no RSA private key")
    return numbers[1], numbers[3]


def opened(data: bytes | None, key: tuple[int, int]) -> bytes | None:
    """The message of a block under PKCS 1 version 1.5 padding; None for what does not open."""
    n, d = key
    size = (n.bit_length() + 7) // 8
    if not data or len(data) != size:
        return None
    block = pow(int.from_bytes(data, "big"), d, n).to_bytes(size, "big")
    end = block.find(b"\0", 2)
    return block[end + 1 :] if block[:2] == b"\0\x02" and end >= 10 else None


def decrypt(pem: str):
    """A Column function: bytes opened with a private key, over Arrow batches."""
    key = private_key(pem)

    @F.pandas_udf(T.BinaryType())
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([opened(b, key) for b in x], dtype=object)

    return run
