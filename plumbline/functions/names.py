"""Column-name words. Names are schema-sized, so this is plain driver code."""

from __future__ import annotations

import re

_CHUNK = re.compile(r"[A-Za-z0-9]+")


def words(name: str) -> list[str]:
    """Lower-case words of a name, cut at separators and where a capital follows a small letter or digit."""
    out: list[str] = []
    for chunk in _CHUNK.findall(name):
        out += [w.lower() for w in re.findall(r".+?(?:(?<=[a-z0-9])(?=[A-Z])|$)", chunk)]
    return out
