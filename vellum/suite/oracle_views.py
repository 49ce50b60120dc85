"""DuckDB text of the views in ``views.py`` and the helper that prepends them."""

from __future__ import annotations

import re

VIEWS = {
    "papers": """
select doc_id, domain, year, title, one_line, venue, method_tags, domain_tags, keywords, doi, first_author,
       citation_key, source_hash,
       case when doc_id % 5 <> 0 then '@article{b' || doc_id || ', title = {' || title || '}}' end as bibtex,
       domain || '_' || lpad(cast(coalesce(year,0) as varchar),4,'0') || '_' ||
       case when rn < 1000 then lpad(cast(rn as varchar),3,'0') else cast(rn as varchar) end as paper_id
from (select *, row_number() over (partition by domain, coalesce(year,0) order by doc_id) as rn from (
  select doc_id, upper(lang) as domain,
    case when doc_id % 37 <> 0 then cast(1995 + doc_id % 31 as integer) end as year,
    split_part(text, chr(10), 1) as title, split_part(text, chr(10), 1) as one_line, source as venue,
    ['M' || (doc_id % 7)] as method_tags, [lang] as domain_tags, [source, lang] as keywords,
    case when doc_id % 11 <> 0 then '10.1000/' || doc_id end as doi,
    'Author' || chr(cast(65 + doc_id % 26 as integer)) as first_author, 'K' || doc_id as citation_key,
    'sha256:' || sha256(text) as source_hash
  from documents))""",
    "ndocs": "select count(*) as n from documents",
    "edges": """
select e.src, e.dst, a.paper_id as source_paper, b.paper_id as target_paper,
  ['cites','extends','improves','compares_with','uses','criticizes','builds_on','same_method_family'][e.rel + 1] as relation
from (select distinct l_orderkey % n as src, l_partkey % n as dst, l_linenumber % 8 as rel from lineitem, ndocs) e
join papers a on a.doc_id = e.src join papers b on b.doc_id = e.dst where e.src <> e.dst""",
    "chunks": """
select l.doc_id, p.paper_id, l.i as paragraph_index, 'S' || ((l.i - 1) % 3) as section, l.text,
  p.paper_id || '.ch' || lpad(cast(l.i as varchar), cast(greatest(3, length(cast(l.i as varchar))) as integer), '0') as chunk_id
from (select doc_id, unnest(lines) as text, generate_subscripts(lines, 1) as i from (
  select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines from documents)) l
join papers p using (doc_id)""",
    "evidence": """
select replace(chunk_id, '.ch', '.ev') as evidence_id, paper_id, doc_id, paragraph_index,
  case when paragraph_index % 5 <> 0 then section end as section,
  case when paragraph_index % 3 <> 0 then cast(paragraph_index as varchar) end as page,
  text as source_text, '' as claim from chunks""",
    "claims": """
select item_id as claim_no, text as claim,
  ['definition','methodological','quantitative','comparative','causal','limitation','conclusion','rumour'][item_id % 8 + 1] as claim_type,
  ['A','B','C','D'][item_id % 4 + 1] as strength from benchmark""",
    "paper_claims": """
select paper_id || '.cl' || lpad(paragraph_index::varchar, 3, '0') as claim_id, paper_id, source_text as claim, ['A','B','C','D'][doc_id % 4 + 1] as strength
from evidence""",
    "queries": """
select item_id as query_id,
  array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'), ' ') as text,
  ['DISCOVERY','CITATION','TECHNICAL','RESULT','FORMULA','VERIFICATION','COMPARISON'][item_id % 7 + 1] as intent,
  case when item_id % 3 = 0 then 2005 end as year_from, cast(null as integer) as year_to,
  case when item_id % 2 = 0 then ['en','fr','de','es'][item_id % 4 + 1] end as domain,
  cast(null as varchar) as method, cast(null as varchar) as venue from benchmark""",
    "metrics": """
select doc_id, l_orderkey, l_partkey, l_suppkey, l_linenumber,
  l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || k as metric_id,
  name, case when l_linenumber <> 3 then v end as value, case when l_linenumber = 3 then 'about 3' end as value_text,
  case when k <> 3 then 'u' end as unit, status, condition_text, source_evidence_id
from (select l_orderkey % n as doc_id, *,
   case when l_linenumber = 7 then 'bogus' when l_returnflag = 'R' then 'reported'
        when l_returnflag = 'A' then 'not_reported' else 'unclear' end as status,
   'linestatus=' || l_linestatus || ', linenumber=' || l_linenumber as condition_text,
   case when l_suppkey % 10 <> 0 then 'E' || l_suppkey end as source_evidence_id
   from lineitem, ndocs) l,
  lateral (values (0, 'quantity', l_quantity), (1, 'extendedprice', l_extendedprice),
                  (2, 'discount', l_discount), (3, 'tax', l_tax)) as m(k, name, v)""",
    "concepts": """
select 'r' || r_regionkey as concept_id, r_name as canonical_name, [lower(r_name)] as aliases, cast([] as varchar[]) as parent_concepts,
  (select list('n' || n_nationkey order by 'n' || n_nationkey) from nation where n_regionkey = r_regionkey) as child_concepts
from region union all
select 'n' || n_nationkey, n_name, case when n_nationkey = 7 then cast([] as varchar[]) else [lower(n_name), 'nation ' || n_nationkey] end,
  case when n_nationkey = 0 then ['r99'] else ['r' || n_regionkey] end, cast([] as varchar[]) from nation""",
    "vectors": """
select vec_id, 't' || (label % 4) as object_type, 'v' || vec_id as object_id, embedding as vector, paper_id
from embeddings, ndocs, papers where papers.doc_id = vec_id % n""",
    "sections": """
select 'm' || conv_id as manuscript_id, lpad(cast(turn as varchar), 4, '0') || '_' || role || '.tex' as name, turn,
  text || ' \\citep{k' || (conv_id % 9) || ',k' || turn || '} and \\cite{k' || (turn * 7 % 13) || '}\\label{s' || (turn % 4) || '}' as body
from conversations""",
    "bibliography": """
select manuscript_id, 'k' || i as key from (select distinct 'm' || conv_id as manuscript_id from conversations), range(5) t(i)""",
    "reviews": """
select 'm' || conv_id as manuscript_id, turn as round,
  case when turn % 5 = 4 then 'n/a' else cast((conv_id * 7 + turn * 13) % 11 as varchar) end as score_text,
  ['Ready now','almost there','NOT READY'][turn % 3 + 1] as verdict_text, text as summary
from conversations where role = 'assistant'""",
    # ---- search building blocks, over paper texts (title, keywords, domain tags, method tags, one-line)
    "ptok": """
select paper_id, unnest(t) as term from (select paper_id, list_concat(list_concat(
  regexp_extract_all(strip_accents(lower(title)), '[\\p{L}\\p{N}]+'),
  regexp_extract_all(strip_accents(lower(array_to_string(list_concat(list_concat(keywords, domain_tags), method_tags), ' '))), '[\\p{L}\\p{N}]+')),
  regexp_extract_all(strip_accents(lower(one_line)), '[\\p{L}\\p{N}]+')) as t from papers)""",
    "pdl": "select paper_id, count(*) as dl from ptok group by paper_id",
    "pstat": "select (select count(*) from papers) as n, (select count(*) from ptok) / (select count(*) from papers) as avgdl",
    "ppost": "select paper_id, term, count(*) as tf from ptok group by all",
    "pidf": """
select term, case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end as idf
from (select term, count(*) as df from ppost group by term), pstat""",
    "qterm": """
select query_id, term, count(*) as qtf from (
  select query_id, unnest(list_filter(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'), lambda x: length(x) > 1)) as term from queries)
group by all""",
    "phit": """
select query_id, paper_id, count(*) as m, round(sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) as score
from qterm join ppost using (term) join pidf using (term) join pdl using (paper_id), pstat group by query_id, paper_id""",
    "pand": """
select query_id, paper_id, score from phit join (select query_id, count(*) as nt from qterm group by query_id) using (query_id) where m = nt""",
    "cards": """
select paper_id, one_line as abstract, case when doc_id % 2 = 1 then 'Idea ' || title else '' end as main_idea,
  case when doc_id % 3 <> 0 then 'Method ' || venue end as method_summary from papers""",
    "comparisons": """
select doc_id, 'C-' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber as comparison_id, 'quantity' as metric,
  l_linestatus as baseline, l_returnflag as proposed, cast(l_discount as varchar) || 'x' as improvement,
  ['comparable','partially_comparable','not_comparable','bogus'][l_suppkey % 4 + 1] as comparison_validity, paper_id
from lineitem, ndocs, papers where papers.doc_id = l_orderkey % n""",
    "formulas": """
select doc_id, 'F' || p_partkey as formula_id, p_name as formula_latex, p_type || ' ' || p_brand as semantic_description,
  ['objective','loss','forward_model','constraint','regularization','metric','physical_model','evaluation','network','update_rule','bogus'][p_size % 11 + 1] as formula_role,
  [p_brand, 'x' || p_size] as variables, 'E' || (p_partkey % 100) as source_evidence_id, paper_id
from part, ndocs, papers where papers.doc_id = p_partkey % n""",
    "formula_queries": """
select query_id, p_brand as text, case when query_id % 3 = 0 then 'loss' end as role
from (select p_brand, min(p_partkey) as query_id from part group by 1)""",
    "metric_queries": """
select cast(n_nationkey as bigint) as query_id, ['tax','QUANT','about','linenumber','discount','price','zz'][n_nationkey % 7 + 1] as text,
  case when n_nationkey % 4 = 0 then 2010 end as year_from, case when n_nationkey % 5 = 0 then 2020 end as year_to,
  case when n_nationkey % 3 = 0 then 'en' end as domain, case when n_nationkey % 6 = 0 then 'm3' end as method,
  case when n_nationkey % 8 = 0 then 'SRC1' end as venue from nation""",
    "paper_metrics": "select m.*, paper_id from metrics m join papers using (doc_id)",
    "pauthors": """
select paper_id, case when doc_id % 4 = 0 then first_author || ' and others' else first_author end as lead,
  case when year is null then '' else '(' || first_author || ' et al., ' || year || ')' end as short from papers""",
    "levels": """
select paper_id, array_to_string(list_filter([ 'L0', 'L1', case when paper_id in (select paper_id from paper_metrics) then 'L2' end,
  case when paper_id in (select paper_id from evidence) then 'L3' end, case when paper_id in (select paper_id from chunks) then 'L4' end,
  case when paper_id in (select paper_id from formulas) then 'FORMULA' end], lambda x: x is not null), ',') as levels from papers""",
    "evids": """
select paper_id, array_to_string(list(evidence_id order by evidence_id), ',') as ids from (
  select paper_id, evidence_id, row_number() over (partition by paper_id order by evidence_id) as r from evidence) where r <= 3 group by 1""",
    # filter tests and hybrid ranking over (query_id, paper_id, score) in view "cand"
    "anyq": """
select query_id, text, year_from, year_to, domain, method, venue, 'q' as kind from queries union all
select query_id, text, year_from, year_to, domain, method, venue, 'm' from metric_queries""",
    "checked": """
select kind, query_id, paper_id, year, asked, met, met = asked as pass from (
  select kind, q.query_id, p.paper_id, p.year,
    (q.year_from is not null)::int + (q.year_to is not null)::int + (q.domain is not null)::int + (q.method is not null)::int + (q.venue is not null)::int as asked,
    coalesce((p.year >= q.year_from)::int, 0) + coalesce((p.year <= q.year_to)::int, 0)
    + coalesce((starts_with(upper(p.paper_id), upper(q.domain) || '_') or contains(lower(p.domain_tags[1]), lower(q.domain)))::int, 0)
    + coalesce(contains(lower(p.method_tags[1]), lower(q.method))::int, 0) + coalesce(contains(lower(p.venue), lower(q.venue))::int, 0) as met
  from anyq q, papers p)""",
    "pfeat": """
select paper_id, coalesce(greatest(0.0, least(1.0, (year - 2000) / 30.0)), 0.0) as recency,
  coalesce(degree, 0) / (select max(degree) from degree) as centrality from papers left join degree using (paper_id)""",
    "cand": """
select query_id, paper_id, score from pand join checked c using (query_id, paper_id) where c.pass and c.kind = 'q'
union all
select query_id, paper_id, 0.0 from checked where kind = 'q' and asked > 0 and pass and query_id not in (select query_id from pand)
union all
select query_id, paper_id, 0.0 from queries q, papers p where query_id not in (select query_id from pand)
  and q.year_from is null and q.domain is null
  and (contains(lower(p.title), lower(q.text)) or contains(lower(p.one_line), lower(q.text)) or contains(lower(to_json(p.keywords)::varchar), lower(q.text)))""",
    "normed": """
select query_id, paper_id, case when score <= 0 then 0.0 when hi = lo then 1.0 else (score - lo) / (hi - lo) end as bm25_norm
from (select *, min(case when score > 0 then score end) over (partition by query_id) as lo,
  max(case when score > 0 then score end) over (partition by query_id) as hi from cand)""",
    "ranked": """
select *, row_number() over (partition by query_id order by relevance desc, paper_id) as rank from (
  select n.query_id, n.paper_id, bm25_norm, round(0.55 * bm25_norm + 0.2 * recency
    + 0.15 * (case when asked > 0 then met / asked else 0 end) + 0.1 * centrality, 9) as relevance
  from normed n join checked c on c.query_id = n.query_id and c.paper_id = n.paper_id and kind = 'q' join pfeat f on f.paper_id = n.paper_id)""",
    "etok": """
select paper_id, evidence_id, unnest(list_concat(regexp_extract_all(strip_accents(lower(source_text)), '[\\p{L}\\p{N}]+'),
  regexp_extract_all(strip_accents(lower(coalesce(section, ''))), '[\\p{L}\\p{N}]+'))) as term from evidence""",
    "edl": "select evidence_id, count(*) as dl from etok group by 1",
    "estat": "select (select count(*) from evidence) as n, (select count(*) from etok) / (select count(*) from evidence) as avgdl",
    "epost": "select paper_id, evidence_id, term, count(*) as tf from etok group by all",
    "eidf": """
select term, case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end as idf
from (select term, count(*) as df from epost group by term), estat""",
    "ehit": """
select query_id, paper_id, evidence_id, count(*) as m, round(sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) as score
from qterm join epost using (term) join eidf using (term) join edl using (evidence_id), estat group by all""",
    "eand": "select query_id, paper_id, evidence_id, score from ehit join (select query_id, count(*) as nt from qterm group by 1) using (query_id) where m = nt",
    "htok": """
select paper_id, replace(chunk_id, '.ch', '.ev') as evidence_id, unnest(list_concat(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'),
  regexp_extract_all(lower(section), '[\\p{L}\\p{N}]+'))) as term from chunks""",
    "hdl": "select evidence_id, count(*) as dl from htok group by 1",
    "hstat": "select (select count(*) from chunks) as n, (select count(*) from htok) / (select count(*) from chunks) as avgdl",
    "hpost": "select paper_id, evidence_id, term, count(*) as tf from htok group by all",
    "hidf": """
select term, case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end as idf
from (select term, count(*) as df from hpost group by term), hstat""",
    "ctok": """
select claim_no as query_id, list_filter(list_transform(regexp_extract_all(claim, '[A-Za-z0-9]+'), lambda w: lower(w)),
  lambda w: length(w) > 1 and w not in ('a','an','the','of','for','on','and','in','to','with','based','is','are','was','were','at','by','from','as','that','this','using','via')) as tokens
from claims""",
    "cterm": "select query_id, term, count(*) as qtf from (select query_id, unnest(tokens) as term from ctok) group by all",
    "chit": """
select query_id, paper_id, evidence_id, round(sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) as score
from cterm join epost using (term) join eidf using (term) join edl using (evidence_id), estat group by all""",
    "ctop": """
select h.*, tokens, len(list_filter(tokens, lambda t: contains(lower(e.source_text || ' ' || e.claim), t))) / len(tokens) as coverage
from (select *, row_number() over (partition by query_id order by score desc, evidence_id) as rank from chit) h
join ctok using (query_id) join evidence e on e.evidence_id = h.evidence_id where rank <= 10""",
    "degree": "select target_paper as paper_id, count(*) as degree from edges group by all",
}

_WORD = re.compile(r"(?<![a-z_.'])[a-z_]+")


def with_views(sql: str) -> str:
    """Prepend the views the query names, in dependency order."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in dict.fromkeys(_WORD.findall(text)):
            if name in VIEWS and name not in needed:
                add_one(name)

    busy: set[str] = set()

    def add_one(name: str) -> None:
        if name in busy:
            return
        busy.add(name)
        add(VIEWS[name])
        needed.append(name)

    add(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in needed)
    sql = sql.strip()
    if sql.lower().startswith("with recursive "):
        return f"with recursive {views},\n{sql[15:]}"
    if sql.lower().startswith("with "):
        return f"with {views},\n{sql[5:]}"
    return f"with {views}\n{sql}"
