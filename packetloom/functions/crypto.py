"""Ciphers and beacon records as Columns: AES without padding, HMAC, tool keys, metadata and tasks.

The engine's AES insists on padding; data without any is decrypted by adding the one block that decrypts to a whole block
of padding, which the key itself can encrypt.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, without_bad_utf8

#: Fixed value: the initial vector of beacon tasks.
TASK_IV = b"abcdefghijklmnop"
#: Fixed value: how beacon metadata begins.
METADATA = "0000BEEF"


def xored(data: Column, byte: int, blocks: int) -> Column:
    """Bytes (8 times `blocks` of them) with every byte XORed with one."""
    mask = int.from_bytes(bytes([byte]) * 8, "big", signed=True)
    digits = F.hex(data)
    parts = [F.lpad(F.hex(F.conv(F.substring(digits, 16 * i + 1, 16), 16, -10).cast("bigint").bitwiseXOR(F.lit(mask))), 16, "0") for i in range(blocks)]
    return F.unhex(F.concat(*parts))


def aes_raw(data: Column, key: Column, iv: Column) -> Column:
    """AES-CBC of whole blocks without padding; null for other lengths and bad keys."""

    def of(b: Column) -> Column:
        last = F.substring(b, F.octet_length(b) - 15, F.lit(16))
        pad = F.substring(F.aes_encrypt(xored(last, 16, 2), key, F.lit("ECB"), F.lit("PKCS")), F.lit(1), F.lit(16))
        fits = (F.octet_length(b) >= 16) & (F.octet_length(b) % 16 == 0) & F.octet_length(key).isin(16, 24, 32)
        return F.when(fits, F.try_aes_decrypt(F.concat(iv, b, pad), key, F.lit("CBC"), F.lit("PKCS")))

    return bind(data, of)


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA256 of bytes under a key of at most 64 bytes."""
    full = F.unhex(F.rpad(F.hex(key), 128, "0"))
    inner = F.unhex(F.sha2(F.concat(xored(full, 0x36, 8), message), 256))
    return F.unhex(F.sha2(F.concat(xored(full, 0x5C, 8), inner), 256))


def tool_key(password: Column) -> Column:
    """The 16-byte key of a password: the first half of its MD5 in hexadecimal digits."""
    return F.substring(F.md5(password.cast("binary")), 1, 16).cast("binary")


def ecb_text(cipher: Column, password: Column) -> Column:
    """The text of base64 of AES-ECB under a password's key; null where it does not open."""
    return without_bad_utf8(F.try_aes_decrypt(F.try_to_binary(cipher, F.lit("base64")), tool_key(password), F.lit("ECB"), F.lit("PKCS")))


def number(data: Column, at: int, size: int) -> Column:
    """An unsigned big-endian number of some bytes of data, the first being 0."""
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("bigint")


def beacon_metadata(data: Column) -> Column:
    """A beacon's decrypted metadata as a struct, with the keys derived from its secret; null for other data."""

    def of(b: Column) -> Column:
        derived = F.sha2(F.substring(b, 9, 16), 256)
        flag = number(b, 38, 1)
        words = F.split(without_bad_utf8(F.substring(b, F.lit(60), F.octet_length(b))), "\t", -1)
        word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit("Unknown"))
        host = F.concat_ws(".", *[number(b, 55 + i, 1).cast("string") for i in (3, 2, 1, 0)])
        return F.when(
            F.startswith(F.hex(b), F.lit(METADATA)) & (F.octet_length(b) >= 59),
            F.struct(
                number(b, 28, 4).alias("bid"), number(b, 32, 4).alias("pid"), number(b, 36, 2).alias("port"), F.when(flag.bitwiseAND(F.lit(1)) != 0, "x64").otherwise("x86").alias("barch"), F.when(flag.bitwiseAND(F.lit(6)) != 0, 1).otherwise(0).alias("is64"),
                F.concat((number(b, 39, 1) / 10).cast("string"), F.lit("."), number(b, 40, 1).cast("string")).alias("win_ver"), number(b, 41, 2).alias("win_build"), host.alias("host"), word(0).alias("pc_name"), word(1).alias("username"), word(2).alias("process_name"),
                F.substring(derived, 1, 32).alias("aes_key_hex"), F.substring(derived, 33, 32).alias("hmac_key_hex"),
            ),
        )

    return bind(data, of)


def beacon_task(data: Column, aes_key: Column, hmac_key: Column) -> Column:
    """(valid, counter, length, type, content) of a beacon's task or answer: a length, the encrypted part and 16 bytes of its
    HMAC; null where data are short, content null where the HMAC differs."""

    def of(b: Column) -> Column:
        size = number(b, 0, 4)
        body = F.substring(b, F.lit(5), (size - 16).cast("int"))
        sign = F.substring(b, (size - 11).cast("int"), F.lit(16))
        valid = F.substring(hmac_sha256(hmac_key, body), 1, 16) == sign

        def opened(d: Column) -> Column:
            length = number(d, 4, 4)
            return F.struct(d.isNotNull().alias("valid"), number(d, 0, 4).alias("counter"), length.alias("length"), number(d, 8, 4).alias("type"), F.substring(d, F.lit(13), length.cast("int")).alias("content"))

        return F.when((F.octet_length(b) >= size + 4) & (size > 16), bind(F.when(valid, aes_raw(body, aes_key, F.lit(TASK_IV))), opened))

    return bind(data, of)
