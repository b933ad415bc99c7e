"""Tokens, and word roots by a few suffix rules, as Catalyst expressions; Porter2 roots are in :mod:`tillroll.functions.stem`."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOKEN_BREAK = "[^a-z0-9+/]+"

# Suffix rules applied in this order (pattern, replacement).
SUFFIX_RULES = [
    ("^(.{2,})ies$", "$1y"),
    ("^(.{2,}(?:s|x|z|ch|sh))es$", "$1"),
    ("^(.{2,}[^su])s$", "$1"),
    ("^(.{3,})ing$", "$1"),
    ("^(.{3,})ed$", "$1"),
]


def tokens(text: Column) -> Column:
    """Lower-case words of a text, in order, repeats kept."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda w: F.length(w) > 0)


def root(word: Column) -> Column:
    """Root of an English word by suffix rules; a choice for the ``root`` of the keyword inventory."""
    for pattern, replacement in SUFFIX_RULES:
        word = F.regexp_replace(word, pattern, replacement)
    return word
