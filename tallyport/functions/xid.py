"""Identifiers of distributed transactions: statement parsing and keys."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_STATEMENT = re.compile(r"^\s*XA\s+(PREPARE|COMMIT|ROLLBACK)\s+(.*?)(\s+ONE\s+PHASE)?\s*;?\s*$", re.IGNORECASE | re.DOTALL)
_PART = re.compile(r"\s*(?:[xX]'((?:[0-9a-fA-F]{2})*)'|0[xX]((?:[0-9a-fA-F]{2})+)|'((?:[^']|'')*)'|([^,']*?))\s*(,|$)")


@dataclass(frozen=True)
class Xid:
    gtrid: bytes
    bqual: bytes = b""
    format: int = 1

    @property
    def key(self) -> str:
        return f"{self.format}:{self.gtrid.hex()}:{self.bqual.hex()}"


def parse_xid(text: str) -> Xid:
    """Up to three comma-separated parts: two byte strings ('..', X'..', 0x.. or bare) and a format number, 1 if not given."""
    parts, at = [], 0
    text = text.strip()
    while at <= len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"not a transaction id: {text!r}")
        hexed = m[1] if m[1] is not None else m[2]
        parts.append(bytes.fromhex(hexed) if hexed is not None else (m[3].replace("''", "'") if m[3] is not None else m[4]).encode())
        at = m.end()
        if m[5] == "":
            break
    if not 1 <= len(parts) <= 3 or not parts[0]:
        raise ValueError(f"a transaction id has one to three parts: {text!r}")
    return Xid(parts[0], parts[1] if len(parts) > 1 else b"", int(parts[2]) if len(parts) > 2 else 1)


def parse_statement(sql: str) -> tuple[str, Xid, bool] | None:
    """(action, id, one phase) of an XA statement; None for any other."""
    m = _STATEMENT.match(sql)
    return (m[1].lower(), parse_xid(m[2]), bool(m[3])) if m else None


def parse_prepare_event(body: bytes) -> tuple[Xid, bool]:
    """A binary prepare event: one-phase flag, format, length of each part (32 bits, little endian), then the bytes.

    Where the second length can't be 32 bits wide, it is read as 8 bits.
    """
    if len(body) < 10:
        raise ValueError("prepare event is too short")
    one_phase, number, n = body[0] != 0, *struct.unpack_from("<II", body, 1)
    m, at = struct.unpack_from("<I", body, 9)[0] if len(body) >= 13 else len(body), 13
    if at + n + m > len(body):
        m, at = body[9], 10
    if at + n + m > len(body):
        raise ValueError("prepare event is too short")
    return Xid(body[at : at + n], body[at + n : at + n + m], number), one_phase


def xid_key(gtrid: Column, bqual: Column | None = None, number: Column | None = None) -> Column:
    """The key of ids that are columns of text."""
    hexed = lambda c: F.lower(F.hex(c.cast("binary")))
    return F.concat_ws(":", (number if number is not None else F.lit(1)).cast("string"), hexed(gtrid), hexed(bqual) if bqual is not None else F.lit(""))


def key_suffix(key: Column) -> Column:
    """A key without its format, for the fallback match."""
    return F.regexp_extract(key, r"^[^:]*:(.*)$", 1)
