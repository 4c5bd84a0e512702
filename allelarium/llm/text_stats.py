"""Statistics of whole texts: the counts of the base rules and the ratios that the learnt filters read.

Everything is exact and computed in one pass over a text; memory is bounded by
the longest text. Null and empty texts have zero for every count and ratio.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from allelarium.llm.common import Words, shingle_hashes

SYMBOLS = "#*$%&|<>"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = (
    "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "stops", "exclamations", "other_marks",
    "distinct_words", "top_word", "same_as_before", "entropy", "wide_bytes", "words_in_line", "word_length_spread", "short_text",
)

#: How far a text's symbols spread: per character of a word, and over its words and its lines with a word.
SHARES = ("symbol_chars", "symbol_words", "symbol_lines")

_BLANKS = [*BLANKS.encode()]
_SYMBOLS = [*SYMBOLS.encode()]
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
for _c in b".,;:":
    _CLASS[_c] = 4
_CLASS[33] = 5
for _c in b"\"'()-/?@[\\]^_`{}~+=":
    _CLASS[_c] = 6
for _c in SYMBOLS.encode():
    _CLASS[_c] = 7
_CLASS[128:] = 8


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words found twice or more in the text, the first included."""
    if len(ids) <= WINDOW:
        return 0
    windows = shingle_hashes(ids, WINDOW)
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(again)
    edges[at] += 1
    edges[at + WINDOW] -= 1  # windows have distinct starts, so no index repeats
    return int((np.cumsum(edges[:-1]) > 0).sum())


def slice_stats(column: pa.Array, found: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each text of the column the counts named in COUNTS (long) and the ratios named in RATIOS (double)."""
    found = found or Words(column, lower=False)
    counts, ratios = np.zeros((len(found), len(COUNTS)), np.int64), np.zeros((len(found), len(RATIOS)))
    for i, text in enumerate(column.to_pylist()):
        counts[i], ratios[i] = _text_stats(text or "", found.data[found.offsets[i] : found.offsets[i + 1]], found.of(i), found.lengths[found.bounds[i] : found.bounds[i + 1]])
    return counts, ratios


def symbol_shares(found: Words, word_chars: np.ndarray) -> np.ndarray:
    """For each text the ratios named in SHARES (double)."""
    n = np.diff(found.bounds)
    before = np.concatenate(([0], np.cumsum(np.isin(found.data, _SYMBOLS))))
    marked = np.concatenate(([0], np.cumsum(before[found.ends] > before[found.starts])))
    lines = np.unique(np.concatenate((found.offsets, np.flatnonzero(found.data == 10) + 1)))
    words = np.searchsorted(found.starts, lines)
    of_lines = np.searchsorted(lines, found.offsets)
    count = lambda has: np.diff(np.concatenate(([0], np.cumsum(has)))[of_lines])
    return np.stack((
        np.diff(before[found.offsets]) / np.maximum(1, word_chars),
        np.diff(marked[found.bounds]) / np.maximum(1, n),
        count(np.diff(marked[words]) > 0) / np.maximum(1, count(np.diff(words) > 0)),
    ), axis=1)


def _text_stats(text: str, raw: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> tuple[tuple[int, ...], tuple[float, ...]]:
    n = len(ids)
    if not n:
        return (0,) * len(COUNTS), (0.0,) * (len(RATIOS) - 1) + (1.0,)
    by_byte = np.bincount(raw, minlength=256)
    chars = len(text) - int(by_byte[_BLANKS].sum())
    symbols = int(by_byte[_SYMBOLS].sum())
    dup, seen, worded = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            worded += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeats = repeated_words(ids)
    by_class = np.bincount(_CLASS, weights=by_byte, minlength=9).tolist()
    letters = max(1.0, by_class[1] + by_class[2] + by_class[8])
    p = by_byte[by_byte > 0] / len(raw)
    order = np.sort(ids)
    edges = np.flatnonzero(order[1:] != order[:-1])
    distinct = len(edges) + 1
    top = int(np.diff(np.concatenate(([-1], edges, [n - 1]))).max())
    mean = float(lengths.sum()) / n
    ratios = (
        chars / n, symbols / n, dup / max(1, worded), repeats / n, by_class[1] / letters, by_class[3] / len(raw), by_class[4] / n, by_class[5] / n, by_class[6] / n,
        distinct / n, top / n, float((ids[1:] == ids[:-1]).sum()) / max(1, n - 1), float(-(p @ np.log2(p))), by_class[8] / len(raw), min(200.0, n / max(1, worded)), max(0.0, float(lengths @ lengths) / n - mean * mean) ** 0.5, 1.0 / n,
    )
    return (n, chars, symbols, dup, repeats), ratios
