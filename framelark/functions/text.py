"""Caption tokenizers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Punctuation tokens removed from already tokenized captions.
PTB_PUNCTUATION = [
    "''", "'", "``", "`", "-LRB-", "-RRB-", "-LCB-", "-RCB-",
    ".", "?", "!", ",", ":", "-", "--", "...", ";",
]

# ``(?U)`` makes ``\s`` cover Unicode white space.
_NOT_WORD = r"(?U)[^a-z0-9\s]"
_SPACES = r"(?U)\s+"


def _words(col: Column) -> Column:
    """Split on white space, dropping empty strings."""
    return F.filter(F.split(col, _SPACES), lambda w: w != "")


def tokenize_vocab(col: Column) -> Column:
    """Vocabulary tokens: characters outside ``a-z0-9`` and space are deleted."""
    return _words(F.regexp_replace(F.lower(col), _NOT_WORD, ""))


def tokenize_eval(col: Column) -> Column:
    """Scoring text: those characters become spaces, runs are collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), _NOT_WORD, " "), _SPACES, " "))


def eval_tokens(col: Column) -> Column:
    return _words(tokenize_eval(col))


def strip_ptb_punct(col: Column) -> Column:
    """Drop punctuation tokens from tokenized text; newlines become spaces."""
    words = F.split(F.trim(F.translate(col, "\n", " ")), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(PTB_PUNCTUATION)), " ")


def video_number(col: Column) -> Column:
    return F.replace(col, F.lit("video"), F.lit("")).cast("bigint")
