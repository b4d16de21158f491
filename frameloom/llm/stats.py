"""Structure statistics of whole texts, for rules and for the classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from frameloom.llm.common import Words, segment_sums, strings

#: The symbols that count, and the white space that parts words.
SYMBOLS = "[#*$%&|<>]"
BLANKS = " \t\n\r\x0b\x0c"
WINDOW = 5


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Words of each text that stand in a window of so many words found twice or more in that text, the first included.

    Windows are compared by a 64-bit hash and then word by word; were two different ones to share a hash, all are
    compared by their words.
    """
    codes, starts = words.codes, words.starts
    n = len(codes)
    if n < window:
        return np.zeros(len(starts) - 1, np.int64)
    rng = np.random.default_rng(20)
    table = rng.integers(0, 2**63, len(words.distinct), np.uint64) << np.uint64(1) | np.uint64(1)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    if not len(at):
        return np.zeros(len(starts) - 1, np.int64)
    h = doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mapped = table[codes]
    for i in range(window):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mapped[at + i]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    a, b = at[order[1:][same]], at[order[:-1][same]]
    if any((codes[a + i] != codes[b + i]).any() for i in range(window)) or (doc[a] != doc[b]).any():
        rows = np.column_stack([doc[at], *(codes[at + i] for i in range(window))])
        _, which, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        hit = at[count[which.ravel()] > 1]
    else:
        hit = np.unique(np.concatenate((a, b)))
    edge = np.zeros(n + 1, np.int64)
    edge[hit] += 1
    np.add.at(edge, hit + window, -1)
    return segment_sums((np.cumsum(edge[:-1]) > 0).astype(np.int64), starts)


def text_stats(texts: pa.Array, words: Words | None = None) -> dict[str, np.ndarray]:
    """Counts of each text as long arrays; null and empty texts have zeros throughout."""
    words = words or Words(texts)
    codes, starts = words.codes, words.starts
    vocab = pa.array(words.distinct, pa.string())

    def per_word(values: pa.Array | np.ndarray) -> np.ndarray:
        values = values if isinstance(values, np.ndarray) else values.to_numpy(zero_copy_only=False)
        return segment_sums(values.astype(np.int64)[codes], starts)

    upper = pc.and_(pc.utf8_is_upper(vocab), pc.greater(pc.utf8_length(vocab), 1))
    symbols = pc.count_substring_regex(vocab, SYMBOLS)
    out = {
        "n_words": words.counts(),
        "word_chars": per_word(pc.utf8_length(vocab)),
        "n_symbols": per_word(symbols),
        "n_upper": per_word(upper),
        "n_shouts": per_word(pc.ends_with(vocab, "!!")),
        "n_marked": per_word(pc.greater(symbols, 0)),
        "n_bare": per_word(pc.invert(pc.match_substring_regex(vocab, r"[\p{L}\p{N}]"))),
        "n_letters": per_word(pc.count_substring_regex(vocab, r"\p{L}")),
        "n_plain": per_word(pc.match_substring_regex(vocab, r"^[\p{L}\p{M}'\x{2019}-]+[.,;:!?]?$")),
        "n_digits": per_word(pc.count_substring_regex(vocab, "[0-9]")),
        "n_ends": per_word(pc.match_substring_regex(vocab, "[.?!]$")),
    }
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    stutter = np.zeros(len(codes), np.int64)
    if len(codes) > 1:
        stutter[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    out["n_stutters"] = segment_sums(stutter, starts)
    out["n_repeat_words"] = repeated_words(words)
    lines, copies = np.zeros(len(starts) - 1, np.int64), np.zeros(len(starts) - 1, np.int64)
    for i, text in enumerate(strings(texts)):
        if text:
            full = [x for x in text.split("\n") if x.strip(BLANKS)]
            lines[i], copies[i] = len(full), len(full) - len(set(full))
    out["n_lines"], out["n_dup_lines"] = lines, copies
    return out
