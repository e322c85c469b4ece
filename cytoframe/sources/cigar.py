"""CIGARs in plain Python."""

from __future__ import annotations

import re

OPERATION = re.compile(r"(\d+)([MIDNSHP=X])")


def parts(cigar: str) -> list[tuple[int, str]]:
    return [(int(n), op) for n, op in OPERATION.findall(cigar)]
