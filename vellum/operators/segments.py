"""Paragraphs with their sections, from markdown, LaTeX and XML sources.

The line formats are taken in one pass over a document, without moving it: each line gets a letter for its kind, and
the coded lines are cut before headings, then at what ends a paragraph. What a heading or a paragraph is follows from
the letters alone.

Defined cases: null text is empty and has no paragraphs; white space around lines is dropped; documents are
named by a unique id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators.skew import RANGE_WIDTH
from vellum.sources.tableset import TableSet

#: Fixed values of the formats.
PREAMBLE = "Preamble"
MARKDOWN_HEADER = r"^(#{1,6})\s+(.+)$"
LATEX_SECTION = r"^\\(?:sub){0,2}section\*?\{\s*([^}]+)\s*\}"
LATEX_TITLE = r"\\title\*?\{([^}]+)\}"
LATEX_DROPPED = ("\\begin", "\\end", "\\label", "%")
XML_SECTION = re.compile(r"""<sec[^>]*title=["']([^"']+)["'][^>]*>""", re.IGNORECASE)
XML_PARAGRAPH = re.compile(r"<p>(.*?)</p>", re.DOTALL | re.IGNORECASE)
LOOK_BACK = 400


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _markdown(line: Column) -> Column:
    """A stripped line by its code: A first-level heading, G other heading, B blank, T text."""
    level, heading = F.length(F.regexp_extract(line, MARKDOWN_HEADER, 1)), _strip(F.regexp_extract(line, MARKDOWN_HEADER, 2))
    head = F.concat(F.when(level == 1, F.lit("\nA")).otherwise(F.lit("\nG")), heading)
    return F.when(level > 0, head).when(line == "", F.lit("\nB")).otherwise(F.concat(F.lit("\nT"), line))


def _latex(line: Column) -> Column:
    """As markdown, with G sections and L titles; environments, labels and comments are left out and end no paragraph."""
    dropped = F.lit(False)
    for start in LATEX_DROPPED:
        dropped = dropped | line.startswith(start)
    titled = F.when(line.rlike(LATEX_TITLE), F.concat(F.lit("\nL"), _strip(F.regexp_extract(line, LATEX_TITLE, 1)))).otherwise("")
    head = F.when(line.rlike(LATEX_SECTION), F.concat(F.lit("\nG"), _strip(F.regexp_extract(line, LATEX_SECTION, 1))))
    return head.when(line.startswith("\\title"), titled).when(dropped, "").when(line == "", F.lit("\nB")).otherwise(F.concat(F.lit("\nT"), line))


FORMATS = {"markdown": _markdown, "latex": _latex}


def _first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def _sectioned(docs: DataFrame, form: str, key: str, text: str) -> DataFrame:
    """``key, title, parts``: a document's coded lines, each after a line feed, cut before its headings.

    The first part has no heading, the others begin with theirs. A first H1 before any text is the title of markdown, the
    last title that of LaTeX. No line has a line feed in it, so that one and a code letter stand for nothing else.
    """
    lines = F.transform(F.split(tx.text_or_empty(text), "\n"), _strip)
    coded = docs.select(key, F.array_join(F.transform(lines, FORMATS[form]), "").alias("_all"))
    if form == "markdown":
        coded = coded.withColumns({"_top": F.instr("_all", "\nA"), "_text": F.instr("_all", "\nT")})
        is_title = (F.col("_top") > 0) & ((F.col("_text") == 0) | (F.col("_top") < F.col("_text")))
        title = F.when(is_title, _first_line(F.col("_all").substr(F.col("_top") + 2, F.length("_all"))))
        rest = F.when(is_title, F.overlay("_all", F.lit("B"), F.col("_top") + 1)).otherwise(F.col("_all"))  # ends a paragraph
    else:
        titles = F.split("_all", "\nL")
        title = F.when(F.size(titles) > 1, _first_line(F.element_at(titles, -1)))
        rest = F.regexp_replace("_all", "\nL[^\n]*", "")  # ends no paragraph
    return coded.select(key, title.alias("title"), F.split(rest, "\n[AG]").alias("parts"))


def paragraphs(docs: DataFrame, form: str, key: str = "doc_id", text: str = "text", width: int = RANGE_WIDTH) -> DataFrame:
    """``key, paragraph_index, section, text`` of every paragraph; ``width`` is taken from earlier callers and changes nothing."""

    def of(part: Column, i: Column) -> Column:
        section = F.when(i == 0, F.lit(PREAMBLE)).otherwise(_first_line(part))
        lines = F.when(i == 0, part).otherwise(part.substr(F.length(_first_line(part)) + 1, F.length(part)))
        runs = F.filter(F.split(lines, "\nB[^\n]*"), lambda run: run != "")
        body = lambda run: F.replace(run.substr(F.lit(3), F.length(run)), F.lit("\nT"), F.lit(" "))
        return F.transform(runs, lambda run: F.struct(section.alias("section"), body(run).alias("text")))

    found = _sectioned(docs, form, key, text).select(key, F.posexplode(F.flatten(F.transform("parts", of))).alias("_at", "_p"))
    return found.select(key, (F.col("_at") + 1).cast("bigint").alias("paragraph_index"), "_p.section", "_p.text")


def outlines(docs: DataFrame, form: str, key: str = "doc_id", text: str = "text", width: int = RANGE_WIDTH) -> DataFrame:
    """``key, title, sections`` of every document: sections once each, in the order of their first headings."""
    heads = F.transform(F.slice("parts", 2, F.size("parts")), _first_line)
    return _sectioned(docs, form, key, text).select(key, F.coalesce("title", F.lit("")).alias("title"), F.array_distinct(heads).alias("sections"))


def xml_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, paragraph_index, section, text`` of each ``<p>``: tags are taken out, empty ones left out.

    A section title in the 400 characters before a paragraph is that paragraph's and the later ones'.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(batch.num_rows):
                ids, sections, bodies, source, section = [], [], [], batch.column(1)[one].as_py() or "", PREAMBLE
                for m in XML_PARAGRAPH.finditer(source):
                    body = re.sub(r"<[^>]+>", "", m[1]).strip()
                    if body:
                        for title in XML_SECTION.findall(source[max(0, m.start() - LOOK_BACK) : m.start()]):
                            section = title.strip()
                        ids.append(len(ids) + 1)
                        sections.append(section)
                        bodies.append(body)
                names = pa.array([batch.column(0)[one].as_py()] * len(ids), batch.schema.types[0])
                yield pa.RecordBatch.from_arrays([names, pa.array(ids, pa.int64()), pa.array(sections, pa.string()), pa.array(bodies, pa.string())], names=[key, "paragraph_index", "section", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(work, f"{key} {kind}, paragraph_index bigint, section string, text string")


def store_paragraphs(tables: TableSet, batch_name: str, docs: DataFrame, found: DataFrame, key: str = "paper_id") -> int:
    """Publish paragraphs in place of those that the documents had before; a document without paragraphs has none then."""
    return tables.publish(batch_name, {"chunks": found}, replaced=docs.select(F.col(key).alias("id")))
