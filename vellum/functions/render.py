"""Text and struct rendering of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum import vocab
from vellum.functions.text import blank_to_null, has_text, text_or_empty


def short_citation(record: Column, authors_summary: Column, year: Column) -> Column:
    """"(Family et al., Year)", "(Year)" without a name, empty without a year."""
    authors = record["authors"]
    name = F.when(
        F.size(authors) > 0, text_or_empty(F.try_element_at(authors, F.lit(1))["family"])
    ).otherwise(F.substring_index(F.trim(text_or_empty(authors_summary)), " ", 1))
    y = year.cast("string")
    return (
        F.when(year.isNull() | (year == 0), F.lit(""))
        .when(name != "", F.concat(F.lit("("), name, F.lit(" et al., "), y, F.lit(")")))
        .otherwise(F.concat(F.lit("("), y, F.lit(")")))
    )


def number_text(value: Column) -> Column:
    """Plain decimal digits from 0.0001 up to 10**16, where shorter notation begins."""
    number = value.cast("double")
    size = F.abs(number)
    plain = F.regexp_replace(number.cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((size >= 1e7) & (size < 1e16) & (F.floor(number) == number), plain).otherwise(number.cast("string"))


def format_metric(name: Column, value: Column, value_text: Column, unit: Column, condition: Column) -> Column:
    """"name=value unit (key=value, ...)", "?" for an unknown value."""
    shown = F.coalesce(blank_to_null(value_text), F.when(value_text.isNull(), number_text(value)), F.lit("?"))
    pairs = F.array_join(
        F.transform(F.map_entries(condition), lambda e: F.concat(e["key"], F.lit("="), text_or_empty(e["value"]))), ", "
    )
    return F.concat(
        text_or_empty(name),
        F.lit("="),
        shown,
        F.when(has_text(unit), F.concat(F.lit(" "), unit)).otherwise(""),
        F.when(F.coalesce(pairs, F.lit("")) != "", F.concat(F.lit(" ("), pairs, F.lit(")"))).otherwise(""),
    )


def csl_type(article_type: Column) -> Column:
    t = F.lower(text_or_empty(article_type))
    return (
        F.when(t.contains("conf") | t.contains("proceeding"), F.lit("paper-conference"))
        .when(t.contains("book"), F.lit("book"))
        .otherwise(F.lit("article-journal"))
    )


def csl_item(p: dict[str, Column]) -> Column:
    """CSL-JSON-shaped struct; absent fields are null and vanish in ``to_json``."""
    r = p["bibliographic_record"]
    keep = lambda c: blank_to_null(c.cast("string"))
    authors = F.transform(
        r["authors"],
        lambda a: F.struct(text_or_empty(a["family"]).alias("family"), text_or_empty(a["given"]).alias("given")),
    )
    title = F.coalesce(blank_to_null(r["title"]), blank_to_null(p["title"]))
    item = F.struct(
        F.coalesce(blank_to_null(p["citation_key"]), p["paper_id"]).alias("id"),
        csl_type(p["article_type"]).alias("type"),
        title.alias("title"),
        authors.alias("author"),
        F.when(p["year"] != 0, F.struct(F.array(F.array(p["year"])).alias("date-parts"))).alias("issued"),
        keep(r["container_title"]).alias("container-title"),
        keep(r["volume"]).alias("volume"),
        keep(r["issue"]).alias("issue"),
        keep(r["pages"]).alias("page"),
        keep(r["publisher"]).alias("publisher"),
        keep(p["doi"]).alias("DOI"),
    )
    return F.when(title.isNotNull(), item)


def author_name(text: Column) -> Column:
    """"Family, Given", "Given Family" or a single name -> struct(family, given)."""
    t = F.trim(text)
    parts = F.split(t, r"\s+")
    comma = F.struct(
        F.trim(F.substring_index(t, ",", 1)).alias("family"),
        F.trim(F.substring(t, F.instr(t, ",") + 1, F.length(t))).alias("given"),
    )
    spaced = F.struct(
        F.element_at(parts, -1).alias("family"),
        F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " ").alias("given"),
    )
    single = F.struct(t.alias("family"), F.lit("").alias("given"))
    return F.when(t.contains(","), comma).when(F.size(parts) > 1, spaced).otherwise(single)


def _field(name: str, value: Column) -> Column:
    return F.when(
        text_or_empty(value) != "", F.concat(F.lit(f"\n  {name} = {{"), value, F.lit("},"))
    ).otherwise("")


def bibtex_entry(key: Column, title: Column, authors: Column, year: Column, container: Column, volume: Column, pages: Column, doi: Column) -> Column:
    """One article entry; optional fields only where present."""
    names = F.array_join(
        F.transform(authors, lambda a: F.concat(text_or_empty(a["family"]), F.lit(", "), text_or_empty(a["given"]))), " and "
    )
    return F.concat(
        F.lit("@article{"), key,
        F.lit(",\n  title = {"), text_or_empty(title),
        F.lit("},\n  author = {"), text_or_empty(names),
        F.lit("},\n  year = {"), text_or_empty(year.cast("string")), F.lit("},"),
        _field("journal", container), _field("volume", volume), _field("pages", pages), _field("doi", doi),
        F.lit("\n}"),
    )


def reference_line(record: Column, title: Column, year: Column, doi: Column) -> Column:
    """The bundled author-date layout: authors. year. title. container. doi"""
    names = F.transform(
        record["authors"],
        lambda a: F.concat_ws(" ", blank_to_null(a["given"]), blank_to_null(a["family"])),
    )
    n = F.size(names)
    joined = F.when(n > 1, F.concat_ws(
        " and ", F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.try_element_at(names, F.lit(-1))
    )).otherwise(F.array_join(names, ""))
    return F.concat(
        F.concat_ws(
            ". ",
            blank_to_null(joined),
            F.when(year != 0, year.cast("string")),
            F.coalesce(blank_to_null(record["title"]), blank_to_null(title)),
            blank_to_null(record["container_title"]),
            F.when(text_or_empty(doi) != "", F.concat(F.lit("doi:"), doi)),
        ),
        F.lit("."),
    )


def route_rows() -> Column:
    """The routing table as an array literal, one struct per intent."""
    return F.array(
        *[
            F.struct(
                F.lit(mode).alias("mode"),
                F.lit(start).alias("start_layer"),
                F.array(*[F.lit(x) for x in escalation]).cast("array<string>").alias("escalation"),
                F.lit(budget).alias("budget"),
                F.lit(cap).alias("cap"),
            )
            for mode, start, escalation, budget, cap in vocab.ROUTES
        ]
    )
