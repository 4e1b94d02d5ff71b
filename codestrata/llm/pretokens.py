"""Pre-tokens of byte-level tokenizers: the public split pattern, on whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import regex

#: Matches of a long text are handled in blocks of so many.
BLOCK = 1 << 17
LONG_TEXT = 1 << 20

# Letters and numbers of newer Unicode versions, which the installed tokenizer
# libraries take for neither.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_NEWER = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")


#: Texts of characters below this one are split by the standard library, with the classes written out.
NARROW = 0x250
_WIDE = re.compile(f"[^\0-{chr(NARROW - 1)}]")


def _written_out(escape: str) -> str:
    """A class of the pattern as ranges of narrow characters."""
    return "".join(f"\\u{c:04x}" for c in range(NARROW) if regex.fullmatch(escape, chr(c)))


def _narrow(pattern: str) -> re.Pattern | None:
    """The same pattern for narrow texts; None if it holds classes that are not written out here."""
    letter, number, white = _written_out(r"\p{L}"), _written_out(r"\p{N}"), _written_out(r"\s")
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{white}{letter}{number}]").replace(r"(?!\S)", f"(?![^{white}])")
    out = out.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\s", f"[{white}]")
    return None if re.search(r"\\[pPsSwWdDbBX]", out) else re.compile(out)


class Splitter:
    """Cuts whole texts into pre-tokens."""

    def __init__(self, pattern: str) -> None:
        self.wide, self.narrow = regex.compile(pattern), _narrow(pattern)

    def blocks(self, text: str) -> Iterator[list[str]]:
        """All matches in order; a long text gives several lists, so that few are held at a time."""
        narrow = text.isascii() or not _WIDE.search(text)
        if not narrow and _NEWER.search(text):
            shadow = _NEWER.sub("\N{REPLACEMENT CHARACTER}", text)  # as long, and neither letter nor number
            spans = (m.span() for m in self.wide.finditer(shadow))
            while found := [text[a:b] for a, b in islice(spans, BLOCK)]:
                yield found
            return
        pattern = self.narrow if narrow and self.narrow else self.wide
        if len(text) <= LONG_TEXT:
            yield pattern.findall(text)
            return
        matches = pattern.finditer(text)
        while found := [m[0] for m in islice(matches, BLOCK)]:
            yield found
