"""Fixed-width header fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and widths of header fields, first bit first; 32, 56 and 32 bits.
MPEG_AUDIO = (("sync", 11), ("version", 2), ("layer", 2), ("protection", 1), ("bitrate", 4), ("rate", 2), ("padding", 1), ("private", 1), ("mode", 2), ("extension", 2), ("copyright", 1), ("original", 1), ("emphasis", 2))
ADTS = (("sync", 12), ("id", 1), ("layer", 2), ("protection", 1), ("profile", 2), ("rate", 4), ("private", 1), ("channels", 3), ("original", 1), ("home", 1), ("copyright", 1), ("copyright_start", 1), ("frame_length", 13), ("fullness", 11), ("blocks", 2))
FLAC_FRAME = (("sync", 14), ("reserved", 1), ("variable", 1), ("block_code", 4), ("rate_code", 4), ("channel_code", 4), ("depth_code", 3), ("reserved_end", 1))

Layout = tuple[tuple[str, int], ...]


def shifts(layout: Layout) -> list[tuple[str, int, int]]:
    """Name, shift to the right and mask of each field."""
    left, out = sum(width for _, width in layout), []
    for name, width in layout:
        left -= width
        out.append((name, left, (1 << width) - 1))
    return out


def bit_fields(value: Column, layout: Layout) -> list[Column]:
    """The fields of a whole header given as one integer."""
    return [F.shiftright(value, shift).bitwiseAND(F.lit(mask).cast("long")).alias(name) for name, shift, mask in shifts(layout)]
