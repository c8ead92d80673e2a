"""Regular expressions compiled from word lists, so list lookups stay inside codegen."""

from __future__ import annotations

import re
from collections.abc import Iterable

WORD = r"[\p{L}\p{N}_]"


def trie(words: Iterable[str]) -> str:
    """One alternation that prefers the longest word and branches on shared prefixes only once."""
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        branches = [re.escape(ch) + emit(child) for ch, child in sorted(node.items()) if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        if "" not in node:
            return body
        return f"(?:{body})?"

    return emit(root)


def is_word(text: str) -> bool:
    return re.fullmatch(r"\w+", text) is not None


def suffix_pattern(suffixes: Iterable[str]) -> str:
    """Strip the first listed suffix that leaves three letters.

    A suffix that itself ends in an earlier one can never be the first to fit,
    so it is left out; what remains lists longer forms first, and the leftmost
    match below is then the same as the first listed.
    """
    kept: list[str] = []
    for s in suffixes:
        if not any(s.endswith(t) for t in kept):
            kept.append(s)
    return f"(?<={WORD}{{3}}){trie(kept)}(?!{WORD})" if kept else ""


def token_pattern(stop_words: Iterable[str]) -> str:
    words = [w for w in stop_words if is_word(w)]
    guard = f"(?!{trie(words)}(?!{WORD}))" if words else ""
    return f"(?<!{WORD}){guard}{WORD}+"


def prefix_pattern(stems: Iterable[str]) -> str:
    """The longest listed stem at the start of a word."""
    return f"(?<!{WORD}){trie(stems)}"
