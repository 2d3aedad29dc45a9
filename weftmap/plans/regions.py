"""Genomic regions, paths and numbers as people write them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

_UNITS = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9}
_NUMBER = re.compile(r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*([kmgKMG]?)(?:b|bp|B|BP)?")

Region = str | tuple | None


def parse_number(text: str) -> int:
    """``1,000``, ``10M``, ``1.5kb`` as an integer."""
    found = _NUMBER.fullmatch(text.strip())
    if not found:
        raise ValueError(f"not a number: {text!r}")
    value = float(found[1].replace(",", "")) * _UNITS[found[2].lower()]
    return int(value)


def parse_region_text(text: str) -> tuple[str, int | None, int | None]:
    """``chrom`` or ``chrom:start-end`` (the end may be left out). Names may hold any character but a colon and blanks."""
    name, colon, span = text.strip().partition(":")
    if not name or any(c.isspace() for c in name):
        raise ValueError(f"no chromosome name in {text!r}")
    if not colon:
        return name, None, None
    low, dash, high = span.partition("-")
    if not dash or not low.strip():
        raise ValueError(f"expected start-end after the colon of {text!r}")
    start = parse_number(low)
    end = parse_number(high) if high.strip() else None
    if end is not None and end < start:
        raise ValueError(f"{text!r} ends before it starts")
    return name, start, end


def parse_region(region: Region, chromsizes: Mapping[str, int] | None = None) -> tuple[str, int, int | None]:
    """A string, a (chrom, start, end) tuple or a (chrom, None, None) tuple as a half-open region, checked against the sizes if given."""
    if isinstance(region, str):
        name, start, end = parse_region_text(region)
    else:
        name, start, end = (*region, None, None)[:3]
        start, end = (None if x is None else int(x) for x in (start, end))
    size = None
    if chromsizes is not None:
        if name not in chromsizes:
            raise ValueError(f"unknown sequence: {name}")
        size = int(chromsizes[name])
    elif end is None:
        raise ValueError("an open region needs the sequence's size")
    start = 0 if start is None else start
    end = size if end is None else end
    if start < 0 or (size is not None and end > size) or end < start:
        raise ValueError(f"region {name}:{start}-{end} lies outside the sequence")
    return name, start, end


def parse_uri(uri: str) -> tuple[str, str]:
    """``path::group`` as the path and the group, which begins with a slash."""
    parts = uri.split("::")
    if len(parts) > 2:
        raise ValueError(f"more than one '::' in {uri!r}")
    group = parts[1] if len(parts) == 2 else "/"
    return parts[0], group if group.startswith("/") else "/" + group


def natural_key(name: str) -> tuple:
    """Sorts digit runs as numbers."""
    return tuple((0, int(part), "") if part.isdigit() else (1, 0, part) for part in re.split(r"(\d+)", name))


def natural_sorted(names: Sequence[str]) -> list[str]:
    return sorted(names, key=natural_key)
