"""Manuscript and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import manuscripts as ms
from vellum.suite import views as v
from vellum.suite.registry import query

_CITE = "\\\\cite[a-zA-Z]*\\{[^}]*\\}"
_KEYS = "list_filter(list_transform(string_split(regexp_extract({0}, '\\{{([^}}]*)\\}}', 1), ','), lambda k: trim(k)), lambda k: k <> '')"
_CITED = f"""cited as (select distinct manuscript_id, unnest(flatten(list_transform(regexp_extract_all(body, '{_CITE}'), lambda c: {_KEYS.format('c')}))) as key from sections)"""


@query(f"with {_CITED} select manuscript_id, key from cited")
def cited_keys(spark, sf):
    return ms.cited_keys(v.sections(spark, sf))


@query(f"""with al as (select manuscript_id, list(key) as ok from bibliography group by 1),
c as (select s.manuscript_id, name, string_split_regex(body, '{_CITE}') as lits, regexp_extract_all(body, '{_CITE}') as cmds, coalesce(ok, []) as ok from sections s left join al using (manuscript_id)),
n as (select *, list_transform(cmds, lambda c: case when len(list_filter({_KEYS.format('c')}, lambda k: list_contains(ok, k))) = 0 then ''
  else split_part(c, '{{', 1) || '{{' || array_to_string(list_filter({_KEYS.format('c')}, lambda k: list_contains(ok, k)), ',') || '}}' end) as fresh from c)
select manuscript_id, name, array_to_string(list_transform(lits, lambda x, i: x || coalesce(fresh[i], '')), '') as body from n""")
def sanitize_citations(spark, sf):
    """All sections with the keys of their manuscript's bibliography only."""
    return ms.sanitize(v.sections(spark, sf), v.bibliography(spark, sf))[0]


@query(f"""select manuscript_id, name, ((c - 1) * 1000000 + k - 1)::bigint as place, key from (
  select manuscript_id, name, c, unnest(ks) as key, generate_subscripts(ks, 1) as k from (
    select manuscript_id, name, c, {_KEYS.format('cmd')} as ks from (
      select manuscript_id, name, unnest(cmds) as cmd, generate_subscripts(cmds, 1) as c from (select *, regexp_extract_all(body, '{_CITE}') as cmds from sections)))) x
where not exists (select 1 from bibliography b where b.manuscript_id = x.manuscript_id and b.key = x.key)""")
def dropped_citations(spark, sf):
    return ms.sanitize(v.sections(spark, sf), v.bibliography(spark, sf))[1]


@query("""select manuscript_id, label, count(*) as n from (select manuscript_id, unnest(regexp_extract_all(body, '\\\\label\\{([^}]*)\\}', 1)) as label from sections)
group by all having count(*) > 1""")
def duplicate_labels(spark, sf):
    return ms.duplicate_labels(v.sections(spark, sf))


@query(f"""with {_CITED} select manuscript_id, key, 'missing' as gap from cited anti join bibliography using (manuscript_id, key)
union all select manuscript_id, key, 'orphan' from (select distinct manuscript_id, key from bibliography) anti join cited using (manuscript_id, key)""")
def citation_gaps(spark, sf):
    return ms.citation_gaps(v.sections(spark, sf), v.bibliography(spark, sf))


_ROUNDS = """rd as (select manuscript_id, round, coalesce(try_cast(score_text as double), 0) as score, case when contains(lower(verdict_text), 'ready') and not contains(lower(verdict_text), 'not ready') then 'ready'
  when contains(lower(verdict_text), 'almost') then 'almost' else 'not ready' end as verdict from reviews)"""


@query(f"with {_ROUNDS} select manuscript_id, round, score, verdict from rd")
def normalized_reviews(spark, sf):
    return ms.normalize_reviews(v.reviews(spark, sf))


@query(f"""with {_ROUNDS}, m as (select *, min(case when score >= 6 and verdict in ('ready', 'almost') then round end) over (partition by manuscript_id) as good,
  max(round) over (partition by manuscript_id) as last from rd)
select manuscript_id, round, score, verdict, case when good is null then 'max_rounds' else 'positive_assessment' end as reason,
  (select count(*) from rd where rd.manuscript_id = m.manuscript_id and rd.round <= m.round) as n_rounds from m where round = coalesce(good, last)""")
def review_outcome(spark, sf):
    return ms.review_outcome(ms.normalize_reviews(v.reviews(spark, sf)))
