"""Identifiers and citation keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum import vocab
from vellum.functions.text import ascii_words, text_or_empty

_SUFFIX_LETTERS = 7  # 26**7 keys per base


def paper_id(domain: Column, year: Column, seq: Column) -> Column:
    return F.format_string("%s_%04d_%03d", F.upper(domain), year.cast("int"), seq.cast("bigint"))


def sub_id(parent: Column, kind: str, n: Column) -> Column:
    return F.format_string(f"%s.{vocab.SUB_ID_TAGS[kind]}%03d", parent, n.cast("int"))


def _capital(word: Column) -> Column:
    """Acronyms stay, other words get one capital."""
    return F.when(word == F.upper(word), word).otherwise(
        F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1_000_000)))
    )


def _before_comma(author: Column) -> Column:
    return F.trim(F.substring_index(F.trim(text_or_empty(author)), ",", 1))


def last_name(author: Column) -> Column:
    words = ascii_words(_before_comma(author))
    return F.regexp_replace(text_or_empty(F.try_element_at(words, F.lit(-1))), "[^A-Za-z]", "")


def citation_key(title: Column, year: Column, author: Column) -> Column:
    """Last name, year and up to two significant title words."""
    name = last_name(author)
    words = ascii_words(title)
    kept = F.filter(words, lambda w: ~F.lower(w).isin(*vocab.STOP_WORDS))
    kept = F.when(F.size(kept) > 0, kept).otherwise(words)
    short = F.array_join(F.transform(F.slice(kept, 1, 2), _capital), "")
    digits = F.substring(F.regexp_replace(text_or_empty(year.cast("string")), "[^0-9]", ""), 1, 4)
    digits = F.when(digits.rlike("^0*$"), F.lit("")).otherwise(digits)
    return F.concat(
        F.upper(F.substring(name, 1, 1)),
        F.lower(F.substring(name, 2, 1_000_000)),
        digits,
        F.when(short == "", F.lit("Paper")).otherwise(short),
    )


def bibtex_key(title: Column, year: Column, author: Column) -> Column:
    """Lower-case key: last name, year, first title word without its article."""
    name = F.try_element_at(F.split(_before_comma(author), r"\s+"), F.lit(-1))
    slug = F.trim(F.regexp_replace(F.lower(text_or_empty(title)), "[^a-z0-9]+", " "))
    first = F.substring_index(F.trim(F.regexp_replace(slug, "^(a|an|the) ", "")), " ", 1)
    return F.concat(
        F.regexp_replace(F.lower(text_or_empty(name)), "[^a-z]", ""),
        text_or_empty(year.cast("string")),
        F.when(first == "", F.lit("paper")).otherwise(first),
    )


def bib_keys(bib: Column) -> Column:
    """Entry keys in a BibTeX text, in order."""
    return F.transform(
        F.regexp_extract_all(text_or_empty(bib), F.lit(r"@\w+\{([^,]+),"), F.lit(1)), lambda k: F.trim(k)
    )


def first_bib_key(bib: Column) -> Column:
    return F.try_element_at(bib_keys(bib), F.lit(1))


def bib_title(bib: Column) -> Column:
    return F.trim(F.regexp_extract(text_or_empty(bib), r"(?i)title\s*=\s*\{([^}]*)\}", 1))


def suffix_number(suffix: Column) -> Column:
    """"a" -> 1 ... "z" -> 26, "aa" -> 27; the empty suffix is 0."""
    return F.aggregate(
        F.filter(F.split(suffix, ""), lambda ch: ch != ""),
        F.lit(0).cast("bigint"),
        lambda acc, ch: acc * 26 + F.ascii(ch) - 96,
    )


def suffix_letters(n: Column) -> Column:
    """Inverse of :func:`suffix_number`."""
    start = F.struct(n.cast("bigint").alias("n"), F.lit("").alias("s"))
    step = lambda acc, _: F.when(
        acc["n"] > 0,
        F.struct(
            F.floor((acc["n"] - 1) / 26).cast("bigint").alias("n"),
            F.concat(F.chr((acc["n"] - 1) % 26 + 97), acc["s"]).alias("s"),
        ),
    ).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(_SUFFIX_LETTERS)), start, step)["s"]


def first_author(record: Column, authors_summary: Column) -> Column:
    """First structured author as "Family, Given", else the authors summary."""
    authors = record["authors"]
    a = F.try_element_at(authors, F.lit(1))
    family, given = text_or_empty(a["family"]), text_or_empty(a["given"])
    structured = F.when(
        family != "", F.regexp_replace(F.concat(family, F.lit(", "), given), r"^[, ]+|[, ]+$", "")
    ).otherwise(given)
    return F.when(F.size(authors) > 0, structured).otherwise(text_or_empty(authors_summary))
