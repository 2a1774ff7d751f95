"""Per-document statistics that the quality operators learn from."""

from __future__ import annotations

from collections import Counter
from math import log1p

from skyloom.llm.common import SPACES

SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_CONTINUATION = bytes(range(0x80, 0xC0))

#: Names of the learned features, in the order of ``features``.
FEATURES = (
    "log_words",
    "mean_word_chars",
    "symbols_per_word",
    "dup_line_share",
    "repeat_word_share",
    "upper_share",
    "digit_share",
    "exclaim_share",
    "distinct_share",
    "non_ascii_share",
    "words_per_line",
    "stop_share",
)
#: Quality may only fall as these rise.
FALLING = ("symbols_per_word", "dup_line_share", "repeat_word_share", "upper_share")


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of *window* words found twice or more in the text."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    covered, end = 0, 0  # end: first word not yet counted
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered += i + window - max(i, end)
            end = i + window
    return covered


def base_counts(text: bytes) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words of the whole text."""
    words = text.split()
    dense = text.translate(None, SPACES)
    chars = len(dense.translate(None, _CONTINUATION))
    symbols = len(dense) - len(dense.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), words


def features(text: bytes, base: tuple[int, int, int, int, int, list[bytes]]) -> list[float]:
    """The values of ``FEATURES``; zeros for a text without words."""
    n, chars, symbols, dup_lines, repeats, words = base
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    lines = sum(1 for x in text.split(b"\n") if x.strip())
    upper = size - len(text.translate(None, _UPPER))
    digits = size - len(text.translate(None, _DIGITS))
    high = size - len(text.translate(None, _CONTINUATION))
    return [
        log1p(n),
        chars / n,
        symbols / n,
        dup_lines / lines,
        repeats / n,
        upper / chars,
        digits / chars,
        text.count(b"!") / n,
        len(set(words)) / n,
        high / chars,
        n / lines,
        text.count(b".") / n,
    ]
