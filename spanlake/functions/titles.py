"""Titles compared one by one inside tasks, as ``text.title_similarity`` compares columns, for folds over sorted rows."""

from __future__ import annotations

from functools import lru_cache


def shared(a: tuple[str, ...] | None, b: tuple[str, ...] | None) -> float:
    """Shared share of two sets of keywords; zero if both are empty or one is unknown."""
    if a is None or b is None:
        return 0.0
    union = len({*a, *b})
    return len({*a} & {*b}) / union if union else 0.0


@lru_cache(1 << 16)
def similarity(a: str | None, words_a: tuple[str, ...] | None, b: str | None, words_b: tuple[str, ...] | None) -> float:
    """``text.title_similarity`` of two titles with their keywords, unknown ones included (zero if both are). Titles recur, so results are kept."""
    if a is None or b is None:
        return 0.2 if words_a or words_b else 0.0
    if a == b:
        return 1.0
    if b in a or a in b:
        return 0.85
    if not words_a or not words_b:
        return 0.0
    longest = next((k for k in (3, 2, 1) if any(a[i : i + k] in b for i in range(len(a) - k + 1))), 0)
    return 0.5 * shared(words_a, words_b) + 0.2 * (min(len(a), len(b)) / max(len(a), len(b))) + 0.3 * (longest / 3)
