"""Tokenisers, normalisers and other string columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum import vocab


def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters with a canonical base letter, then bare marks.

    ``translate`` deletes characters beyond the end of the second string, so
    the combining marks come last.
    """
    src, dst = [], []
    for cp in range(0x00E0, 0x0250):
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch and ch == ch.lower():
            src.append(ch)
            dst.append(base)
    marks = [chr(cp) for cp in range(0x0300, 0x0370)]
    return "".join(src + marks), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()
SPACES = "".join(chr(cp) for cp in range(0x3001) if unicodedata.category(chr(cp)) == "Zs")


def strings(values) -> Column:
    """Literal string array."""
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body) -> Column:
    """Bind a computed value once; a column used inside a lambda is otherwise
    evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def text_or_empty(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def trimmed(c: Column) -> Column:
    """Without the space separators (Unicode Zs) at both ends, as SQL trims; tabs stay."""
    return F.btrim(c, F.lit(SPACES))


def has_text(c: Column) -> Column:
    """True when the column holds something other than white space."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def fold(c: Column) -> Column:
    """Strip diacritics from lower-cased Latin text."""
    return F.translate(c, _ACCENTED, _PLAIN)


def index_tokens(c: Column) -> Column:
    """Unicode letter/digit runs, lower-cased and folded."""
    return F.regexp_extract_all(fold(F.lower(text_or_empty(c))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def ascii_words(c: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit("[A-Za-z0-9]+"), F.lit(0))


def query_tokens(c: Column) -> Column:
    """ASCII tokens longer than one character (the literal query tokeniser)."""
    return F.filter(ascii_words(c), lambda w: F.length(w) > 1)


def search_terms(c: Column) -> Column:
    """Query side of the shared tokeniser: folded tokens longer than one character."""
    return F.filter(index_tokens(c), lambda w: F.length(w) > 1)


def significant_tokens(c: Column) -> Column:
    """Lower-cased words without stop words and single letters, duplicates kept."""
    words = F.transform(ascii_words(c), F.lower)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*vocab.STOP_WORDS))


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text_or_empty(c)) / 4).cast("int"))


def truncate_text(c: Column, limit: int = vocab.LAYER_TEXT_CHARS) -> Column:
    return F.when(
        F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(vocab.TRUNCATION_MARK))
    ).otherwise(c)


def title_norm(c: Column) -> Column:
    """Lower-cased title with letters and digits of any script only."""
    return F.regexp_replace(F.lower(text_or_empty(c)), r"[^\p{L}\p{N}]", "")


def head_name(c: Column) -> Column:
    """Text before the first colon, letters and digits only."""
    return title_norm(F.trim(F.substring_index(text_or_empty(c), ":", 1)))


def ascii_head(c: Column) -> Column:
    """The head name limited to a-z and 0-9, used by fuzzy title matching."""
    return F.regexp_replace(F.lower(F.substring_index(text_or_empty(c), ":", 1)), "[^a-z0-9]", "")


def strip_citation_suffix(c: Column) -> Column:
    """Drop a trailing parenthesis such as "(Li, 2017)" and a trailing year."""
    bare = F.trim(F.regexp_replace(text_or_empty(c), r"\(.*\)\s*$", ""))
    return F.trim(F.regexp_replace(bare, r",?\s*\d{4}\s*$", ""))


def title_tokens(c: Column) -> Column:
    """Distinct significant title words; hyphenated words also give their parts."""
    spaced = F.regexp_replace(F.lower(text_or_empty(c)), r"[^a-z0-9\- ]", " ")
    words = F.filter(
        F.split(spaced, " +"),
        lambda w: (F.length(w) > 2) & ~w.isin(*vocab.TITLE_STOP_WORDS),
    )
    parts = F.flatten(
        F.transform(words, lambda w: F.filter(F.split(w, "-"), lambda p: F.length(p) > 2))
    )
    return F.array_distinct(F.concat(words, parts))


def distinctive(token: Column) -> Column:
    """Acronyms, numbers and hyphenated names identify a paper; plain words do not."""
    return token.contains("-") | token.rlike("^[0-9]+$") | F.length(token).between(2, 3)


def source_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def unique_ordered(arr: Column) -> Column:
    return F.array_distinct(arr)
