"""Pieces of the SQL that checks results."""

from __future__ import annotations

CRC32_SQL = """
bits AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS crc_table)"""
"""The table of the reflected CRC-32 (polynomial 0xEDB88320), by its rule."""


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's bytes, given `crc_table` in scope."""
    byte = f"CAST(('0x' || substr(hex(encode({text})), 2 * i + 1, 2)) AS BIGINT)"
    step = "xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_transform(range(octet_length(encode({text}))), lambda i: {byte}), lambda c, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"
