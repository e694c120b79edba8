"""Pseudonymous host tokens."""
import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_token(host: Column, salt: str, digits: int = 6) -> Column:
    """``host-`` and the first ``digits`` hex digits of HMAC-SHA256(salt, host).

    Six tell some thousand hosts apart; give more (up to 64) for large corpora.

    A bare hash of an address can be reversed by trying all addresses, so the
    secret salt is required. HMAC is written out over ``sha2``: the two padded
    keys are made on the driver and the rest runs inside generated code.
    """
    if not salt:
        raise ValueError("a non-empty secret salt is required for host tokens")
    key = salt.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    digest = F.sha2(F.concat(inner, F.encode(host, "UTF-8")), 256)
    mac = F.sha2(F.concat(outer, F.unhex(digest)), 256)
    return F.concat(F.lit("host-"), F.left(mac, F.lit(digits)))
