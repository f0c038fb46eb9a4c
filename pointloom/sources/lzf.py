"""The LZF block format: literal runs, and references to earlier output."""

from __future__ import annotations


def decompress(data: bytes, size: int) -> bytes:
    """Expands a block that must yield exactly ``size`` bytes; ValueError if it is damaged.

    A control byte below 32 is followed by that many literals and one more. Else its upper three bits are the length
    less 2 (7: a further byte adds to it) and its lower five bits, with the next byte, the distance less 1.
    """
    out = bytearray()
    at = 0
    try:
        while at < len(data):
            control = data[at]
            at += 1
            if control < 32:
                run = data[at : at + control + 1]
                if len(run) != control + 1:
                    raise ValueError("LZF: literals cut short")
                out += run
                at += control + 1
                continue
            length = control >> 5
            if length == 7:
                length += data[at]
                at += 1
            start = len(out) - ((control & 31) << 8 | data[at]) - 1
            at += 1
            if start < 0:
                raise ValueError("LZF: reference before the start")
            for _ in range(length + 2):  # source and target may overlap
                out.append(out[start])
                start += 1
            if len(out) > size:
                break
    except IndexError:
        raise ValueError("LZF: block cut short") from None
    if len(out) != size:
        raise ValueError(f"LZF: {len(out)} bytes instead of {size}")
    return bytes(out)


def literal(data: bytes) -> bytes:
    """A valid block of literal runs only (no compression)."""
    return b"".join(bytes([len(c) - 1]) + c for c in (data[i : i + 32] for i in range(0, len(data), 32)))
