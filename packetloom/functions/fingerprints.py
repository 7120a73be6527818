"""Fingerprints of TLS handshakes from their structs, without values meant to grease."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_grease(values: Column) -> Column:
    """The list without values of the form 0x?A?A with both bytes equal; null counts as empty."""
    grease = lambda v: (v.bitwiseAND(0x0F0F) == 0x0A0A) & (F.shiftright(v, 8) == v.bitwiseAND(0xFF))
    return F.filter(F.coalesce(values, F.array().cast("array<int>")), lambda v: ~grease(v))


def _dashed(path: str, keep: bool = False) -> Column:
    values = F.coalesce(F.col(path), F.array().cast("array<int>")) if keep else without_grease(F.col(path))
    return F.array_join(F.transform(values, lambda v: v.cast("string")), "-")


def ja3_string() -> Column:
    """Version, ciphers, extensions, groups and point formats of the client hello; '' if there is none."""
    h = "tls.client_hello"
    text = F.concat_ws(",", F.col(f"{h}.version").cast("string"), _dashed(f"{h}.cipher_suites"), _dashed(f"{h}.extension_list"), _dashed(f"{h}.supported_groups"), _dashed(f"{h}.ec_point_formats", keep=True))
    return F.coalesce(F.when(F.col(h).isNotNull(), text), F.lit(""))


def ja3s_string() -> Column:
    """Version, cipher and extensions of the server hello; '' if there is none."""
    h = "tls.server_hello"
    text = F.concat_ws(",", F.col(f"{h}.version").cast("string"), F.col(f"{h}.cipher_suite").cast("string"), _dashed(f"{h}.extension_list"))
    return F.coalesce(F.when(F.col(h).isNotNull(), text), F.lit(""))
