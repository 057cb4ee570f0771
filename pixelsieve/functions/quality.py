"""Rules that a file must meet to be kept, as columns; cheap ones first, those on the decoded image last."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signatures at the start and end of JPEG and PNG files.
JPEG_HEAD, JPEG_TAIL = "FFD8", "FFD9"
PNG_HEAD, PNG_TAIL = "89504E470D0A1A0A", "49454E44AE426082"


@dataclass(frozen=True)
class Rules:
    min_bytes: int = 50_000
    min_side: int = 128
    max_side: int = 2048
    max_ratio: float = 3.0
    max_channels: int = 3
    strict_channels: bool = False


def extension(path: Column) -> Column:
    """What follows the last dot, in lower case; the whole path if it has none."""
    return F.lower(F.substring_index(path, ".", -1))


def big_enough(length: Column, rules: Rules = Rules()) -> Column:
    return length >= rules.min_bytes


def signed(path: Column, content: Column) -> Column:
    """Head and tail both as the extension demands; other extensions are not looked at."""
    ext = extension(path)

    def ends(head: str, tail: str) -> Column:
        n = len(head) // 2
        at_head, at_tail = F.substring(content, 1, n), F.substring(content, -n, n)
        return (at_head == F.unhex(F.lit(head))) & (at_tail == F.unhex(F.lit(tail))) & (F.length(content) >= n)

    return F.when(ext.isin("jpg", "jpeg"), ends(JPEG_HEAD, JPEG_TAIL)).when(ext == "png", ends(PNG_HEAD, PNG_TAIL)).otherwise(True)


def well_shaped(width: Column, height: Column, rules: Rules = Rules(), channels: Column | None = None) -> Column:
    """Sides, their ratio in single precision, and the number of channels of the decoded image."""
    short, long = F.least(width, height), F.greatest(width, height)
    ok = (short >= rules.min_side) & (long <= rules.max_side)
    ratio = (long.cast("float") / short.cast("float")).cast("float")
    ok &= F.when(short > 0, ratio <= F.lit(rules.max_ratio).cast("float")).otherwise(False)
    return ok if channels is None else ok & (channels <= rules.max_channels)
