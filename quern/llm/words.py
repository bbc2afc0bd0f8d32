"""Words of texts as 64-bit hashes, computed over whole Arrow batches with NumPy.

The consistent form (`consistent`) maps text that looks the same to the same characters:
full-width characters, ligatures, base letter plus accent, invisible characters, spaces of any width,
hyphen variants and letters of the Cyrillic and Greek scripts shaped like Latin ones. Case, punctuation,
numbers of spaces, line breaks, superscripts and curly quotes stay as they are.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

from quern.functions.mixing import mix

#: Letters shaped like Latin ones, and the Latin ones, in the same order.
CYRILLIC = "аеорсухіѕјһԁԛԝ" + "АВЕКМНОРСТУХІЅЈ"
CYRILLIC_AS = "aeopcyxisjhdqw" + "ABEKMHOPCTYXISJ"
GREEK = "ον" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GREEK_AS = "ov" + "ABEZHIKMNOPTYX"
#: Hyphens drawn like the plain one, and letters with a look-alike only by decomposition.
HYPHENS = "‐‑﹣－"

CHUNK_CHARS = 1 << 20


def char_form(ch: str) -> str:
    """The consistent form of one character, decomposed; empty for invisible characters."""
    if ch in HYPHENS:
        return "-"
    if ch.isascii():
        return ch
    kind = unicodedata.category(ch)
    if kind == "Cf" or ch in "͏ᅟᅠㅤﾠ" or "︀" <= ch <= "️":
        return ""
    if kind == "Zs":
        return " "
    tag = unicodedata.decomposition(ch)
    if tag.startswith(("<wide>", "<narrow>")) or "ﬀ" <= ch <= "ﬆ":
        return "".join(map(char_form, unicodedata.normalize("NFKD", ch)))
    out = unicodedata.normalize("NFD", ch)
    if out != ch:
        return "".join(map(char_form, out))
    at = (CYRILLIC + GREEK).find(ch)
    return ch if at < 0 else (CYRILLIC_AS + GREEK_AS)[at]


@functools.cache
def form_table() -> dict[int, str]:
    """Code point to consistent form, for those that change. Derived from the Unicode data by rule."""
    return {i: f for i in range(128, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and (f := char_form(chr(i))) != chr(i)}


def consistent(text: str | None) -> str | None:
    """One consistent form for texts that look the same. NULL stays NULL; ASCII text is its own form."""
    if text is None or text.isascii():
        return text
    table = form_table()
    for ch in set(text):  # what a character becomes is itself in the form, so the order doesn't matter
        if not ch.isascii() and (form := table.get(ord(ch))) is not None:
            text = text.replace(ch, form)
    return unicodedata.normalize("NFC", text)


def lowered(text: str | None) -> str:
    return "" if text is None else consistent(text).lower()


@functools.cache
def _is_word() -> np.ndarray:
    """For each code point, whether it is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_CHARS characters, so that memory doesn't grow with a batch."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= CHUNK_CHARS:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


@functools.cache
def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n):
        out[i], x = x, x * 0x9E3779B97F4A7C15 % 2**64
    return out


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts already lowered: the hashes of all words, how many words each text has, and the first
    and the end position of each word in its text. A word is a run of letters and digits."""
    all_hashes, all_counts, all_starts, all_ends = [], [], [], []
    for lo, hi in _chunks(texts):
        part = texts[lo:hi]
        cps = np.frombuffer("\n".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.empty(len(cps) + 2, bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = _is_word()[cps]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        begin = np.concatenate(([0], np.cumsum(sizes[:-1] + 1)))
        bounds = np.searchsorted(starts, np.append(begin, begin[-1] + sizes[-1] + 1))
        counts = np.diff(bounds)
        if len(starts):
            lens = ends - starts
            at = np.flatnonzero(inside[1:-1])
            first = np.cumsum(lens) - lens
            idx = np.arange(len(at)) - np.repeat(first, lens)
            longest = int(lens.max())
            weighed = (cps[at].astype(np.uint64) + np.uint64(1)) * _powers(1 << max(6, (longest - 1).bit_length()))[idx]
            h = mix(np.add.reduceat(weighed, first) ^ (lens.astype(np.uint64) << np.uint64(40)))
        else:
            h = np.empty(0, np.uint64)
        all_hashes.append(h)
        all_counts.append(counts)
        base = np.repeat(begin, counts)
        all_starts.append(starts - base)
        all_ends.append(ends - base)
    if not all_hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(map(np.concatenate, (all_hashes, all_counts, all_starts, all_ends)))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words of one run of word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out
