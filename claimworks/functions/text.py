"""Tokens, phrases and lists of terms as Spark columns.

Tokens hold no space, so a phrase of whole tokens is found as a substring of the tokens joined by
spaces. Lists of up to some 50 terms are literal arrays, not joins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
TOKEN = r"[a-z0-9]+(?:'[a-z]+)?"


#: The characters of WHITE.
WHITES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    """Trimmed by characters; a pattern would try all of them at every place of the text."""
    return F.btrim(text, F.lit(WHITES))


def flat(text: Column) -> Column:
    """White space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, f"{WHITE}+", " "))


def tokenize(text: Column) -> Column:
    straight = F.replace(F.replace(F.lower(text), F.lit("’"), F.lit("'")), F.lit("‘"), F.lit("'"))
    return F.regexp_extract_all(straight, F.lit(TOKEN), F.lit(0))


def joined(tokens: Column) -> Column:
    """The tokens between single spaces, with one before and behind."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def among(tokens: Column, words) -> Column:
    """The tokens with those that aren't among the words replaced by a mark, which is no token."""
    return F.transform(tokens, lambda t: F.when(t.isin(*words), t).otherwise("~"))


def around(tokens: Column, key, beside, reach: int) -> Column:
    """The joined tokens, with marks for those that are neither a key nor beside one, cut at whole
    tokens to what stands up to `reach` characters from a key; a mark is where something was."""
    named = F.transform(tokens, lambda t: F.when(key(t), F.concat(F.lit("#"), t)).when(beside(t), t).otherwise("~"))
    cut = F.regexp_replace(F.array_join(named, " "), f"([^#]{{{reach}}}[^# ]* )[^#]*(?:( [^#]{{{reach},}}(?=#))|$)", "$1~$2")
    return F.replace(cut, F.lit("#"), F.lit(""))


def reduced(tokens: Column, words, parts=()) -> Column:
    """The joined tokens with each run of tokens that aren't among the words as one mark. Phrases of the
    words occur in it exactly where they do in the joined tokens, and it is much shorter. Words that
    are only parts of phrases go where they stand alone between marks."""
    whole = [w for w in words if w not in set(parts)]
    named = F.transform(tokens, lambda t: F.when(t.isin(*whole), t).when(t.isin(*parts), F.concat(F.lit("_"), t)).otherwise("~"))
    marked = F.concat(F.lit(" ~ "), F.array_join(named, " "), F.lit(" ~ "))
    return F.replace(F.regexp_replace(marked, "~ (?:(?:_[^ ]+ )?~ )+", "~ "), F.lit("_"), F.lit(""))


def has(joined_tokens: Column, phrase: str) -> Column:
    return F.contains(joined_tokens, F.lit(f" {phrase} "))


def has_any(joined_tokens: Column, phrases) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | has(joined_tokens, p)
    return out


def strings(values) -> Column:
    return F.array(*map(F.lit, values))


def find_terms(joined_tokens: Column, terms) -> Column:
    """The terms that occur, in list order, each once."""
    return F.array_compact(F.array(*[F.when(has(joined_tokens, t), F.lit(t)) for t in terms]))  # no lambda: the tokens are joined once


def count_terms(joined_tokens: Column, terms) -> Column:
    """How many of the terms occur."""
    out = F.lit(0)
    for t in terms:
        out = out + has(joined_tokens, t).cast("int")
    return out


def phrase_indices(tokens: Column, phrase: list[str]) -> Column:
    """Start index of every whole-token occurrence of the phrase; none for an empty phrase."""
    k = len(phrase)
    if not k:
        return F.array().cast("array<int>")
    last = F.size(tokens) - k
    return F.when(last < 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(tokens, i + 1, k) == strings(phrase)))


def half_up(x: Column) -> Column:
    """Rounds halves up, on the binary value."""
    return F.floor(x + 0.5).cast("int")


def clamp(x: Column, lo: float = 0, hi: float = 100) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))
