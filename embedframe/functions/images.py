"""Image metadata from base64 PNG data URIs, read from the IHDR header (no decoder)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The 8-byte PNG file signature (hex).
PNG_SIGNATURE_HEX = "89504E470D0A1A0A"


def image_dims(col: str | Column, width: str = "width", height: str = "height") -> list[Column]:
    """Width and height of a ``data:image/png;base64,…`` string: big-endian 32-bit integers at
    bytes 17-20 and 21-24 of the PNG.  Anything without the PNG signature gives NULLs."""
    c = F.col(col) if isinstance(col, str) else col
    raw = F.unbase64(F.element_at(F.split(c, ","), -1))

    is_png = F.hex(F.substring(raw, 1, 8)) == F.lit(PNG_SIGNATURE_HEX)

    def be32(pos: int) -> Column:
        return F.when(is_png, F.conv(F.hex(F.substring(raw, pos, 4)), 16, 10).cast("long"))

    return [be32(17).alias(width), be32(21).alias(height)]
