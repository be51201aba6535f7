"""Numbers about a text that the quality classifier reads; each is made from the whole text."""

from __future__ import annotations

import zlib

import numpy as np

NAMES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "upper", "digit", "punct", "other_ascii", "non_ascii", "space", "distinct_words", "top_word", "top5_words", "repeat_pairs", "line_len",
    "distinct_lines", "upper_words", "symbol_words", "end_punct_words", "run", "packed", "caps_start", "entropy", "digit_words",
)
_KIND = np.zeros(256, np.int64)  # 0 lower, 1 upper, 2 digit, 3 sentence punctuation, 4 other ASCII, 5 space, 6 beyond ASCII
_KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 6
for _c in range(128):
    if not (48 <= _c <= 57 or 65 <= _c <= 90 or 97 <= _c <= 122):
        _KIND[_c] = 5 if _c == 32 or 9 <= _c <= 13 else 3 if chr(_c) in ".,;:'\"!?-()" else 4
_PUNCT, _LETTERS = bytes(range(33, 48)) + b":;<=>?@[\\]^_`{|}~", bytes(range(65, 91)) + bytes(range(97, 123))


def stats(text: bytes) -> list[float]:
    """The numbers of ``NAMES``; an empty text has zeros."""
    if not text:
        return [0.0] * len(NAMES)
    a = np.frombuffer(text, np.uint8)
    counts = np.bincount(a, minlength=256)
    kinds = np.bincount(_KIND, counts, 7) / len(a)
    w = text.split()
    n = max(1, len(w))
    sizes = np.fromiter(map(len, w), np.float64, len(w)) if w else np.zeros(1)
    seen: dict[bytes, int] = {}
    for x in w:
        seen[x] = seen.get(x, 0) + 1
    most = sorted(seen.values())[-5:] or [0]
    pairs = sum(map(bytes.__eq__, w, w[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    runs = np.flatnonzero(np.diff(a) != 0)
    p = counts[counts > 0] / len(a)
    bare = [x.rstrip(_PUNCT) for x in w]
    return [
        np.log1p(len(a)), np.log1p(len(w)), sizes.mean(), sizes.std(), kinds[1], kinds[2], kinds[3], kinds[4], kinds[6], kinds[5], len(seen) / n, most[-1] / n, sum(most) / n, pairs / n,
        np.log1p(len(a) / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), sum(map(bytes.isupper, w)) / n, sum(1 for x in w if not x.strip(_PUNCT)) / n, sum(map(bytes.__ne__, w, bare)) / n,
        np.log1p(np.diff(runs).max() if len(runs) > 1 else len(a)), len(zlib.compress(text, 1)) / len(text), sum(map(bytes.istitle, w)) / n, -(p * np.log2(p)).sum(), sum(map(bytes.isdigit, w)) / n,
    ]
