"""Segmentation queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import segments as sg
from vellum.suite import views as v
from vellum.suite.registry import query


def _sources(spark, sf, form: str):
    """Documents with headings, blank lines and, for LaTeX, commands in place of some lines."""
    i = F.col("doc_id")

    def line(x, n):
        at = (i + n) % 11
        word = F.substring(x, 1, 12)
        if form == "markdown":
            return F.when(at == 0, F.concat(F.lit("# "), word)).when(at == 3, F.concat(F.lit("### "), word)).when(at % 4 == 1, F.lit("  ")).otherwise(x)
        braced = lambda name: F.concat(F.lit(f"\\{name}{{"), F.regexp_replace(word, "[{}]", ""), F.lit("}"))
        return F.when(at == 0, braced("section*")).when(at == 3, braced("title")).when(at == 5, F.lit("\\begin{a}")).when(at % 4 == 1, F.lit("")).otherwise(x)

    text = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return v.table(spark, sf, "documents").select("doc_id", text.alias("text"))


_MARKDOWN = """l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from (
  select doc_id, list_transform(string_split(text, chr(10)), lambda x, n: case when (doc_id + n - 1) % 11 = 0 then '# ' || left(x, 12)
    when (doc_id + n - 1) % 11 = 3 then '### ' || left(x, 12) when (doc_id + n - 1) % 11 % 4 = 1 then '  ' else x end) as ls from documents)),
t as (select doc_id, pos, trim(line) as line, regexp_extract(trim(line), '^(#{1,6})\\s+(.+)$', 1) as h, trim(regexp_extract(trim(line), '^(#{1,6})\\s+(.+)$', 2)) as heading from l),
k as (select *, case when h <> '' then 'head' when line = '' then 'blank' else 'text' end as kind from t),
s as (select *, sum((kind = 'text')::int) over w as texts, sum((h = '#')::int) over w as tops from k window w as (partition by doc_id order by pos)),
m as (select *, h = '#' and texts = 0 and tops = 1 as is_title from s)"""


@query(f"""with {_MARKDOWN},
c as (select *, last_value(case when kind = 'head' and not is_title then heading end ignore nulls) over w as section,
  kind = 'text' and coalesce(lag(kind) over w, '') <> 'text' as is_first from m window w as (partition by doc_id order by pos)),
n as (select *, sum(is_first::int) over (partition by doc_id order by pos) as paragraph_index from c)
select doc_id, paragraph_index::bigint as paragraph_index, coalesce(min(section), 'Preamble') as section, string_agg(line, ' ' order by pos) as text from n where kind = 'text' group by doc_id, paragraph_index""")
def markdown_paragraphs(spark, sf):
    return sg.paragraphs(_sources(spark, sf, "markdown"), "markdown")


@query(f"""with {_MARKDOWN},
f as (select doc_id, heading, min(pos) as pos from m where kind = 'head' and not is_title group by all)
select doc_id, coalesce((select heading from m where m.doc_id = d.doc_id and is_title), '') as title,
  coalesce((select string_agg(heading, '|' order by pos) from f where f.doc_id = d.doc_id), '') as sections from documents d""")
def markdown_outlines(spark, sf):
    return sg.outlines(_sources(spark, sf, "markdown"), "markdown").withColumn("sections", F.array_join("sections", "|"))


_LATEX = """l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from (
  select doc_id, list_transform(string_split(text, chr(10)), lambda x, n: case when (doc_id + n - 1) % 11 = 0 then '\\section*{' || regexp_replace(left(x, 12), '[{}]', '', 'g') || '}'
    when (doc_id + n - 1) % 11 = 3 then '\\title{' || regexp_replace(left(x, 12), '[{}]', '', 'g') || '}' when (doc_id + n - 1) % 11 = 5 then '\\begin{a}'
    when (doc_id + n - 1) % 11 % 4 = 1 then '' else x end) as ls from documents)),
k as (select doc_id, pos, trim(line) as line, case when starts_with(trim(line), '\\section*{') and len(trim(line)) > 11 then 'head' when starts_with(trim(line), '\\title') then 'title'
  when starts_with(trim(line), '\\begin') or starts_with(trim(line), '%') then 'dropped' when trim(line) = '' then 'blank' else 'text' end as kind,
  trim(regexp_extract(trim(line), '\\{\\s*([^}]+)\\s*\\}', 1)) as heading from l)"""


@query(f"""with {_LATEX}, o as (select * from k where kind not in ('dropped', 'title')),
c as (select *, last_value(case when kind = 'head' then heading end ignore nulls) over w as section,
  kind = 'text' and coalesce(lag(kind) over w, '') <> 'text' as is_first from o window w as (partition by doc_id order by pos)),
n as (select *, sum(is_first::int) over (partition by doc_id order by pos) as paragraph_index from c)
select doc_id, paragraph_index::bigint as paragraph_index, coalesce(min(section), 'Preamble') as section, string_agg(line, ' ' order by pos) as text from n where kind = 'text' group by doc_id, paragraph_index""")
def latex_paragraphs(spark, sf):
    return sg.paragraphs(_sources(spark, sf, "latex"), "latex")


@query("""with b as (select page_id, regexp_extract_all(coalesce(html, ''), '(?is)<p>(.*?)</p>', 1) as ps from pages),
e as (select page_id, unnest(ps) as body, generate_subscripts(ps, 1) as i from b),
s as (select page_id, i, trim(regexp_replace(body, '<[^>]+>', '', 'g'), ' ' || chr(10) || chr(9) || chr(13)) as text from e)
select page_id, row_number() over (partition by page_id order by i) as paragraph_index, 'Preamble' as section, text from s where text <> ''""")
def page_paragraphs(spark, sf):
    """Paragraphs of web pages, which have no section titles of this form."""
    return sg.xml_paragraphs(v.table(spark, sf, "pages"), "page_id", "html")
