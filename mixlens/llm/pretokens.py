"""Pre-token patterns as plain ``re`` classes, and slices of a text at places where no pre-token crosses."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

#: Unicode White_Space, which the tokenizers' ``\s`` means (fixed values).
SPACES = "\t-\r \x85\xa0  -     　"
#: Characters a slice of a long text holds at least.
SLICE = 1 << 16


@cache
def char_class(major: str) -> str:
    """The code points of a general category (L, N) as ranges for a ``re`` class."""
    ranges: list[list[int]] = []
    for cp in range(sys.maxunicode + 1):
        if unicodedata.category(chr(cp))[0] == major:
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@cache
def byte_level_pattern() -> re.Pattern:
    """GPT-2's published split pattern."""
    letters, digits = char_class("L"), char_class("N")
    return re.compile(
        rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^{SPACES}{letters}{digits}]+"
        rf"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
    )


@cache
def word_level_pattern() -> re.Pattern:
    """CLIP's published split pattern; what lies between matches is dropped."""
    letters, digits = char_class("L"), char_class("N")
    return re.compile(rf"'(?:[stmd]|re|ve|ll)|[{letters}]+|[{digits}]|[^{SPACES}{letters}{digits}]+")


#: A space between two white-space characters, or at the end after one: the only spaces that don't begin a pre-token.
INNER_SPACE = re.compile(rf"[{SPACES}] (?:[{SPACES}]|\Z)")
SAFE_CUT = re.compile(rf"(?<=[^{SPACES}])(?= )")


def slices(text: str, start: int = 0, end: int | None = None, least: int = SLICE):
    """Start and end of parts of ``text`` of about ``least`` characters, cut where a space follows a non-space: their
    pre-tokens are the text's.  What has no such place stays whole."""
    at, end = start, len(text) if end is None else end
    while end - at > least:
        cut = SAFE_CUT.search(text, at + least, end)
        if not cut:
            break
        yield at, cut.start()
        at = cut.start()
    if at < end:
        yield at, end
