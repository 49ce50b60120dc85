"""Filter, feature, ranking and layered retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum import vocab
from vellum.functions import scoring as sc
from vellum.operators import layers as ly
from vellum.operators import lexical as lx
from vellum.operators import rank as rk
from vellum.suite import views as v
from vellum.suite.registry import query

SHOW = "query_id, paper_id, rank, round(relevance, 6) as relevance"


def _six(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _lists(df):
    for c in ("available_levels", "evidence_ids"):
        if c in df.columns:
            df = df.withColumn(c, F.array_join(c, ","))
    return df


# ---- G: filters and features -----------------------------------------------------


@query("""select * from (select query_id, paper_id, year, row_number() over (partition by query_id order by year desc nulls last, paper_id) as pos
from checked where kind = 'm' and asked > 0 and pass) where pos <= 20""")
def filter_papers(spark, sf):
    return rk.filter_papers(v.papers(spark, sf), v.metric_queries(spark, sf), 20)


@query("select query_id, paper_id, round(case when asked > 0 then met / asked else 0 end, 6) as metadata, pass as passes from phit join checked using (query_id, paper_id) where kind = 'q'")
def metadata_match(spark, sf):
    features = [c for c in rk.PAPER_FEATURES if c != "paper_id"]
    hits = lx.match_any(v.corpus(spark, sf).paper_index(), lx.query_terms(v.queries(spark, sf)), also=features)
    out = rk.check_pairs(hits, v.queries(spark, sf))
    return _six(out.select("query_id", "paper_id", "metadata", "passes"), "metadata")


@query("select paper_id, round(recency, 6) as recency from pfeat")
def recency(spark, sf):
    return v.papers(spark, sf).select("paper_id", F.round(sc.recency(F.col("year")), 6).alias("recency"))


@query("select paper_id, degree from degree")
def in_degrees(spark, sf):
    return rk.in_degrees(v.edges(spark, sf))


@query("select paper_id, round(centrality, 6) as centrality from pfeat")
def centrality(spark, sf):
    return _six(rk.with_centrality(v.papers(spark, sf).select("paper_id"), v.edges(spark, sf)).select("paper_id", "centrality"), "centrality")


@query("select query_id, paper_id, round(bm25_norm, 6) as bm25_norm from (select *, row_number() over (partition by query_id order by relevance desc, paper_id) as r from ranked) where r <= 100")
def candidates(spark, sf):
    """The candidate rule; lists are compared on their best 100."""
    c = v.corpus(spark, sf)
    cands = rk.candidates(c.paper_index(), c.papers, v.queries(spark, sf), c.edges, 100, features=c.features())
    out = rk.rank(cands, c.papers, v.queries(spark, sf), c.edges, 100, c.features())
    return _six(out.select("query_id", "paper_id", "bm25_norm"), "bm25_norm")


@query(f"select {SHOW} from ranked where rank <= 10")
def rank_papers(spark, sf):
    return _six(ly.rank_papers(v.queries(spark, sf), v.corpus(spark, sf), 10).drop("bm25_norm"), "relevance")


_VHIT = """select * from (select *, row_number() over (partition by query_id order by score desc, paper_id, object_id) as r from (
  select q.vec_id as query_id, e.paper_id, e.object_id, round(list_cosine_similarity(q.vector::double[], e.vector::double[]), 9) as score
  from vectors q, vectors e where q.vec_id in (select item_id from benchmark))) where r <= 10"""
_FUSED = f"""with vhit as ({_VHIT}),
vterm as (select query_id, paper_id, max(score / mx) as vec from (select *, max(score) over (partition by query_id) as mx from vhit) where score > 0 group by all),
ok as (select query_id, paper_id, vec from vterm join checked using (query_id, paper_id) where kind = 'q' and pass),
mx as (select coalesce(n.query_id, o.query_id) as query_id, coalesce(n.paper_id, o.paper_id) as paper_id, coalesce(bm25_norm, 0.0) as bm25_norm, vec
  from normed n full join ok o on n.query_id = o.query_id and n.paper_id = o.paper_id)"""


def _query_vectors(spark, sf):
    """One vector for each text query: the one with its number."""
    e = v.vectors(spark, sf).join(v.queries(spark, sf).select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi")
    return e.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))


def _hybrid_corpus(spark, sf):
    c = v.corpus(spark, sf)
    emb = v.vectors(spark, sf).select("paper_id", F.lit("paper").alias("object_type"), "object_id", "vector")
    return ly.Corpus(c.papers, c.edges, evidence=c.evidence, embeddings=emb, degrees=c.degrees)


@query(_FUSED.replace("max(score) over (partition by query_id) as mx from vhit", "max(score) over (partition by query_id) as mx from (select v.* from vhit v join checked c on c.query_id = v.query_id and c.paper_id = v.paper_id and c.kind = 'q' and c.pass)") + """
select * from (select query_id, paper_id, round(relevance, 6) as relevance, row_number() over (partition by query_id order by relevance desc, paper_id) as rank from (
  select m.query_id, m.paper_id, round(case when vec is null then 0.55 * bm25_norm + 0.2 * recency + 0.15 * meta + 0.1 * centrality
    else 0.45 * bm25_norm + 0.2 * vec + 0.15 * recency + 0.1 * meta + 0.1 * centrality end, 9) as relevance
  from mx m join (select *, case when asked > 0 then met / asked else 0 end as meta from checked where kind = 'q') c
    on c.query_id = m.query_id and c.paper_id = m.paper_id join pfeat f on f.paper_id = m.paper_id)) where rank <= 10""")
def rank_hybrid(spark, sf):
    """Lexical and vector candidates fused row by row."""
    out = ly.rank_papers(v.queries(spark, sf), _hybrid_corpus(spark, sf), 10, _query_vectors(spark, sf))
    return _six(out.drop("bm25_norm"), "relevance")


_ALIASES = """with terms as (select c.concept_id, aliases, list_concat([canonical_name],
    coalesce((select list(k.canonical_name order by k.concept_id) from concepts k where list_contains(c.child_concepts, k.concept_id)), cast([] as varchar[]))) as terms from concepts c),
am as (select alias, arg_max(terms, concept_id) as terms from (select concept_id, lower(unnest(aliases)) as alias, terms from terms) group by 1)"""


@query(f"{_ALIASES} select alias, array_to_string(terms, '|') as terms from am")
def alias_map(spark, sf):
    return rk.alias_map(v.concepts(spark, sf)).withColumn("terms", F.array_join("terms", "|"))


@query(f"""{_ALIASES}, q as (select conv_id * 1000 + turn as query_id,
   text || case when turn % 3 = 0 then ' ASIA and nation_' || (conv_id % 25) when turn % 3 = 1 then ' Nation ' || (turn % 25) else '' end as text from conversations)
select query_id, coalesce((select array_to_string(list_sort(list_distinct(flatten(list(terms)))), '|') from am where contains(lower(q.text), alias)), '') as expansions from q""")
def expand_queries(spark, sf):
    c = v.table(spark, sf, "conversations")
    t = F.col("turn")
    tail = F.when(t % 3 == 0, F.concat(F.lit(" ASIA and nation_"), (F.col("conv_id") % 25).cast("string"))).when(
        t % 3 == 1, F.concat(F.lit(" Nation "), (t % 25).cast("string"))
    ).otherwise("")
    q = c.select((F.col("conv_id") * 1000 + t).alias("query_id"), F.concat("text", tail).alias("text"))
    out = rk.expand_queries(q, rk.alias_map(v.concepts(spark, sf)))
    return out.select("query_id", F.array_join("expansions", "|").alias("expansions"))


@query("""with recursive links as (select concept_id, unnest(child_concepts) as child from concepts
  union all select 'root', concept_id from concepts where concept_id like 'r%'),
walk as (select concept_id as ancestor, child as descendant, 1 as depth from links
  union all select w.ancestor, l.child, w.depth + 1 from walk w join links l on l.concept_id = w.descendant)
select ancestor, descendant, min(depth) as depth from walk group by all""", name="descendants")
def descendants(spark, sf):
    c = v.concepts(spark, sf).select("concept_id", "child_concepts")
    regions = c.where(F.startswith("concept_id", F.lit("r")))
    root = regions.groupBy(F.lit("root").alias("concept_id")).agg(F.collect_list("concept_id").alias("child_concepts"))
    return rk.descendants(c.unionByName(root))


# ---- H: layered retrieval ----------------------------------------------------------

_ITEM = """r.query_id, r.paper_id, r.rank, round(relevance, 6) as relevance, p.title, p.citation_key,
  case when p.year is null then '' when lead is null then '' else '(' || split_part(lead, ' ', 1) || ' et al., ' || p.year || ')' end as citation,
  levels as available_levels, coalesce(ids, '') as evidence_ids"""
_JOINS = "join papers p using (paper_id) join pauthors a using (paper_id) join levels l using (paper_id) left join evids e using (paper_id)"


@query(f"""select {_ITEM}, 'DISCOVERY' as mode, '' as best_use, one_line as key_fact, greatest(1, length(one_line) // 4) + 20 as token_cost
from ranked r {_JOINS} where rank <= 10""")
def discover(spark, sf):
    return _lists(_six(ly.discover(v.queries(spark, sf), v.corpus(spark, sf)), "relevance"))


@query(f"""with facts as (select paper_id, coalesce(nullif(method_summary,''), nullif(main_idea,''), nullif(abstract,''), '') as f from cards)
select {_ITEM}, 'TECHNICAL' as mode, '' as best_use, f as key_fact, greatest(1, length(f) // 4) + 20 as token_cost
from ranked r {_JOINS} join facts using (paper_id) where rank <= 5""")
def technical(spark, sf):
    return _lists(_six(ly.technical(v.queries(spark, sf), v.corpus(spark, sf)), "relevance"))


_MFOUND = """with mm as (select q.query_id, m.paper_id, arg_min({'name': m.name, 'value': m.value, 'value_text': m.value_text, 'unit': m.unit, 'c': m.condition_text}, metric_id) as m
    from metric_queries q join paper_metrics m on contains(lower(m.name), lower(q.text)) or contains(lower('linestatus linenumber ' || m.condition_text), lower(q.text)) or contains(lower(m.value_text), lower(q.text))
    group by all),
mr as (select *, row_number() over (partition by query_id order by relevance desc, paper_id) as rank from (
  select mm.query_id, mm.paper_id, m, round(0.2 * recency + 0.15 * (case when asked > 0 then met / asked else 0 end) + 0.1 * centrality, 9) as relevance
  from mm join checked c on c.query_id = mm.query_id and c.paper_id = mm.paper_id and kind = 'm' and pass join pfeat f on f.paper_id = mm.paper_id)),
mf as (select *, m.name || '=' || coalesce(m.value_text, cast(m.value as varchar), '?') || case when m.unit is null then '' else ' u' end || ' (' || m.c || ')' as fact from mr where rank <= 10)"""


@query(_MFOUND + f""" select {_ITEM}, 'RESULT' as mode, 'structured results' as best_use, fact as key_fact
from mf r {_JOINS}""")
def results(spark, sf):
    return _lists(_six(ly.results(v.metric_queries(spark, sf), v.corpus(spark, sf)), "relevance")).drop("token_cost")


@query(_MFOUND + """ select r.query_id, r.paper_id, r.rank, comparison_id, comparison_validity from mf r left join comparisons c using (paper_id)""")
def comparisons(spark, sf):
    return ly.comparisons(v.metric_queries(spark, sf), v.corpus(spark, sf)).select("query_id", "paper_id", "rank", "comparison_id", "comparison_validity")


@query("""select metric_id, name || '=' || coalesce(value_text, cast(cast(value as bigint) as varchar), '?') || case when unit is null then '' else ' ' || unit end || ' (' || condition_text || ')' as shown
from metrics where name = 'quantity'""")
def format_metric(spark, sf):
    from vellum.functions.render import format_metric as fmt

    m = v.metrics(spark, sf).where("name = 'quantity'")
    shown = fmt(F.col("name"), F.lit(None).cast("double"), F.coalesce("value_text", F.col("value").cast("bigint").cast("string")), F.col("unit"), F.col("condition"))
    return m.select("metric_id", shown.alias("shown"))


@query("""select query_id, evidence_id, paper_id, rank, round(case when hi = lo then 1.0 else (score - lo) / (hi - lo) end, 6) as relevance, coalesce(section, '') as section
from (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from (
  select *, row_number() over (partition by query_id order by score desc, evidence_id) as rank from eand) where rank <= 10) join (select evidence_id, section from evidence) using (evidence_id)""")
def search_evidence(spark, sf):
    out = ly.search_evidence(v.queries(spark, sf), v.corpus(spark, sf))
    return _six(out.select("query_id", "evidence_id", "paper_id", "rank", "relevance", F.coalesce("section", F.lit("")).alias("section")), "relevance")


_VERIFY = """with sup as (select query_id, count(*) as n_evidence from ctop where coverage >= 0.5 group by 1),
st as (select t.query_id, min(strength) as strength from (select distinct query_id, paper_id, tokens from ctop where coverage >= 0.5) t
  join paper_claims c using (paper_id) where len(list_filter(tokens, lambda w: contains(lower(c.claim), w))) > 0 group by 1)"""


@query(_VERIFY + """ select query_id, case when n_evidence > 0 then 'supported' else 'unverified' end as verdict, strength, coalesce(n_evidence, 0) as n_evidence,
  case when len(tokens) = 0 then 'no significant tokens' when n_evidence is null then 'no evidence covering the claim''s content' else '' end as note
from ctok left join sup using (query_id) left join st using (query_id)""")
def verify_claims(spark, sf):
    c = v.claims(spark, sf).select(F.col("claim_no").alias("query_id"), F.col("claim").alias("text"))
    return ly.verify_claims(c, v.corpus(spark, sf))[0]


@query("""select query_id, evidence_id, rank, round(coverage, 6) as coverage from ctop where coverage >= 0.5""")
def claim_evidence(spark, sf):
    c = v.claims(spark, sf).select(F.col("claim_no").alias("query_id"), F.col("claim").alias("text"))
    return _six(ly.verify_claims(c, v.corpus(spark, sf))[1].select("query_id", "evidence_id", "rank", "coverage"), "coverage")


@query("""with t as (select claim_no as query_id, paper_id, tokens from claims join ctok on query_id = claim_no join papers on doc_id % (select count(*) from claims) = claim_no)
select query_id, min(strength) as strength from t join paper_claims c using (paper_id)
where len(list_filter(tokens, lambda w: contains(lower(c.claim), w))) > 0 group by 1""")
def claim_strength(spark, sf):
    """Strength from the stored claims of papers, dealt to all claims by number."""
    from vellum.functions import text as tx

    c = v.claims(spark, sf).select(F.col("claim_no").alias("query_id"), tx.significant_tokens(F.col("claim")).alias("tokens"))
    p = v.papers(spark, sf).select((F.col("doc_id") % max(c.count(), 1)).alias("query_id"), "paper_id")
    return ly.claim_strength(c.join(p, "query_id"), v.paper_claims(spark, sf))


_FTOK = """with ftok as (select paper_id, formula_id, unnest(list_concat(list_concat(regexp_extract_all(lower(formula_latex), '[\\p{L}\\p{N}]+'),
    regexp_extract_all(lower(semantic_description), '[\\p{L}\\p{N}]+')), regexp_extract_all(lower(array_to_string(variables, ' ')), '[\\p{L}\\p{N}]+'))) as term from formulas),
fdl as (select formula_id, count(*) as dl from ftok group by 1), fpost as (select paper_id, formula_id, term, count(*) as tf from ftok group by all),
fstat as (select (select count(*) from formulas) as n, (select count(*) from ftok) / (select count(*) from formulas) as avgdl),
fdf as (select term, count(*) as df from fpost group by 1),
fq as (select query_id, term, count(*) as qtf from (select query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: length(w) > 1)) as term from formula_queries) group by all),
fhit as (select query_id, formula_id, count(*) as m, round(sum(qtf * greatest(case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end, 1e-6)
   * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) as score from fq join fpost using (term) join fdf using (term) join fdl using (formula_id), fstat group by all),
fall as (select query_id, formula_id, score from fhit join (select query_id, count(*) as nt from fq group by 1) using (query_id) where m = nt),
fc as (select query_id, formula_id, score from fall union all select query_id, formula_id, 0.0 from formula_queries q, formulas f where query_id not in (select query_id from fall)
   and (contains(lower(formula_latex), lower(q.text)) or contains(lower(semantic_description), lower(q.text)))),
fr as (select *, row_number() over (partition by query_id order by score desc, formula_id) as rank from fc join formulas using (formula_id) join formula_queries using (query_id)
   where role is null or role = formula_role)"""


@query(_FTOK + """select query_id, formula_id, rank, round(case when hi = lo then 1.0 else (score - lo) / (hi - lo) end, 6) as relevance, array_to_string(variables, ',') as symbols
from (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from fr where rank <= 10)""")
def search_formulas(spark, sf):
    out = ly.search_formulas(v.formula_queries(spark, sf), v.corpus(spark, sf))
    symbols = F.array_join(F.transform("variables", lambda x: x["symbol"]), ",")
    return _six(out.select("query_id", "formula_id", "rank", "relevance", symbols.alias("symbols")), "relevance")


@query("""select query_id, chunk_id, paper_id, rank, round(case when hi = lo then 1.0 else (score - lo) / (hi - lo) end, 6) as relevance, 'L4 chunk · ' || section as best_use,
  greatest(1, length(text) // 4) as token_cost, title
from (select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from (
  select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (
    select query_id, replace(evidence_id, '.ev', '.ch') as chunk_id, round(sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) as score, count(*) as m
    from qterm join hpost using (term) join hidf using (term) join hdl using (evidence_id), hstat group by all) join (select query_id, count(*) as nt from qterm group by 1) using (query_id) where m = nt)
  where rank <= 10) join chunks using (chunk_id) join (select paper_id, title from papers) using (paper_id)""")
def search_chunks(spark, sf):
    out = ly.search_chunks(v.queries(spark, sf), v.corpus(spark, sf))
    return _six(out.select("query_id", "chunk_id", "paper_id", "rank", "relevance", "best_use", "token_cost", "title"), "relevance")


@query("""with items as (select query_id, paper_id, relevance, greatest(1, length(one_line) // 4) + 20 as token_cost, 200 + query_id % 5 * 40 as budget from ranked join papers using (paper_id) where rank <= 10),
fit as (select *, sum(token_cost) over (partition by query_id order by relevance desc, paper_id rows unbounded preceding) as spent from items where token_cost <= budget)
select query_id, paper_id, token_cost, budget, (select count(*) from items i where i.query_id = f.query_id) > count(*) over (partition by query_id) as truncated
from fit f where spent <= budget""")
def cut_to_budget(spark, sf):
    items = ly.discover(v.queries(spark, sf), v.corpus(spark, sf)).withColumn("budget", (F.col("query_id") % 5 * 40 + 200).cast("int"))
    return ly.cut_to_budget(items).select("query_id", "paper_id", "token_cost", "budget", "truncated")


@query("""with q as (select doc_id as query_id, case doc_id % 3 when 0 then citation_key when 1 then doi else paper_id end as text from papers
  union all select 100000 + query_id, text from queries),
ex as (select query_id, p.paper_id, case when text = citation_key then 0 when text = doi then 1 else 2 end as stage from q join papers p on text = citation_key or text = doi or text = p.paper_id),
top as (select 100000 + query_id as query_id, paper_id from (select query_id, paper_id, row_number() over (partition by query_id order by relevance desc, paper_id) as r from (
  select query_id, paper_id, round(0.55 * case when hi = lo then 1.0 else (score - lo) / (hi - lo) end + 0.2 * recency + 0.1 * centrality, 9) as relevance from (
    select *, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from pand) join pfeat using (paper_id))) where r = 1
  union all select 100000 + query_id, paper_id from (select query_id, f.paper_id, row_number() over (partition by query_id order by round(0.2 * recency + 0.1 * centrality, 9) desc, f.paper_id) as r
    from queries q, papers p join pfeat f using (paper_id) where query_id not in (select query_id from pand)
    and (contains(lower(p.title), lower(q.text)) or contains(lower(p.one_line), lower(q.text)) or contains(lower(to_json(p.keywords)::varchar), lower(q.text)))) where r = 1)
select query_id, paper_id, stage from ex union all select query_id, paper_id, 3 from top
union all select query_id, (select paper_id from pfeat order by round(0.2 * recency + 0.1 * centrality, 9) desc, paper_id limit 1), 3 from q where text is null""")
def resolve_citation_query(spark, sf):
    p = v.papers(spark, sf)
    i = F.col("doc_id")
    known = p.select(
        i.alias("query_id"), F.when(i % 3 == 0, F.col("citation_key")).when(i % 3 == 1, F.col("doi")).otherwise(F.col("paper_id")).alias("text")
    )
    free = v.queries(spark, sf).select((F.col("query_id") + 100000).alias("query_id"), "text")
    return ly.resolve_citation_query(known.unionByName(free), v.corpus(spark, sf)).select("query_id", "paper_id", "stage")


@query("""select item_id as query_id, r.* from benchmark join (values
  (0,'DISCOVERY','L0','L1',1000), (1,'CITATION','L0','',400), (2,'TECHNICAL','L1','L2,L3,L4',1500), (3,'RESULT','L2','L3,L4',1500),
  (4,'FORMULA','FORMULA','',800), (5,'VERIFICATION','L3','L4',1500), (6,'COMPARISON','L2','L3,L4',1200)) r(k, mode, start_layer, escalation, budget) on k = item_id % 8
union all select item_id, 7, null, null, null, null from benchmark where item_id % 8 = 7""")
def route(spark, sf):
    b = v.table(spark, sf, "benchmark")
    k = F.col("item_id") % 8
    names = F.array(*[F.lit(r[0].lower()) for r in vocab.ROUTES], F.lit("gossip"))
    q = b.select(F.col("item_id").alias("query_id"), k.cast("int").alias("k"), F.element_at(names, (k + 1).cast("int")).alias("intent"))
    return ly.route(q).select("query_id", "k", "mode", "start_layer", F.array_join("escalation", ",").alias("escalation"), "budget")


@query("""select item_id as query_id, case when item_id % 2 = 0 then '' else case item_id % 7 when 0 then 'escalate to L1 for method details' when 2 then 'escalate to L2 for structured results'
  when 3 then 'escalate to L3 for evidence trace' when 5 then 'escalate to L4 for full-text context' when 6 then 'escalate to L3 for evidence trace' else '' end end as next_action from benchmark""")
def next_action(spark, sf):
    q = ly.route(v.queries(spark, sf))
    return q.select("query_id", ly.next_action(F.col("start_layer"), F.col("escalation"), F.col("query_id") % 2 == 1).alias("next_action"))


@query("select paper_id, levels as available_levels from levels")
def available_levels(spark, sf):
    return _lists(ly.available_levels(v.corpus(spark, sf)))


@query("select paper_id, ids as evidence_ids from evids")
def evidence_ids(spark, sf):
    return _lists(ly.evidence_ids(v.evidence(spark, sf)))


@query("select c.*, title from cards c join papers p using (paper_id)")
def paper_cards_read(spark, sf):
    ids = v.papers(spark, sf).select("paper_id")
    return ly.cards(ids, v.corpus(spark, sf))


@query("""select metric_id, paper_id, case when name = 'tax' then 'same country' end as comparability_rules, case when name = 'quantity' then 'mixed units' end as common_pitfalls
from paper_metrics where name in ('tax', 'quantity', 'discount')""")
def structured_results(spark, sf):
    p = v.papers(spark, sf)
    c = v.corpus(spark, sf)
    # the ontology is one row per measure found in the table
    onto = c.metrics.select(F.col("name").alias("metric_name")).distinct().select(
        "metric_name",
        F.when(F.col("metric_name") == "tax", "same country").otherwise("").alias("comparability_rules"),
        F.when(F.col("metric_name") == "quantity", "mixed units").alias("common_pitfalls"),
    )
    names = onto.where("metric_name <> 'extendedprice'").select(F.col("metric_name").alias("name"))
    corpus = ly.Corpus(c.papers, c.edges, metrics=c.metrics, ontology=onto)
    out = ly.structured(p.select("paper_id"), corpus, names)
    return out.select("metric_id", "paper_id", "comparability_rules", "common_pitfalls")


@query("select paper_id, title, year, venue, citation_key, doi, source_hash from papers where domain = 'FR' and year = 2010")
def list_papers(spark, sf):
    return ly.list_papers(v.papers(spark, sf), "fr", 2010)


@query("select paper_id, case when year is null then '' else '(' || split_part(lead, ' ', 1) || ' et al., ' || year || ')' end as citation from papers join pauthors using (paper_id)")
def short_citation(spark, sf):
    from vellum.functions.render import short_citation as short

    p = v.papers(spark, sf)
    return p.select("paper_id", short(F.col("bibliographic_record"), F.col("authors_summary"), F.col("year")).alias("citation"))


_REFLINE = """concat_ws('. ', case doc_id % 4 when 0 then null when 1 then 'G ' || first_author else 'G ' || first_author || ' and H Second' end,
  cast(year as varchar), nullif(title, ''), nullif(venue, ''), 'doi:' || doi) || '.'"""


@query(f"""select paper_id, style_id, citation_key,
  case when style_id = 'house' and doc_id % 3 = 0 then '[' || doc_id || ']'
    when style_id = 'author-date' and title <> '' then '(' || concat_ws(', ', case when doc_id % 4 = 0 then title else first_author end, cast(year as varchar)) || ')'
    else case when year is null then '' else '(' || split_part(lead, ' ', 1) || ' et al., ' || year || ')' end end as in_text_citation,
  case when style_id = 'house' and doc_id % 3 = 0 then title when style_id = 'author-date' and title <> '' then {_REFLINE} end as bibliography_entry,
  case when style_id = 'house' and doc_id % 3 = 0 then 'cache' when style_id = 'author-date' and title <> '' then 'style' else 'minimal' end as renderer,
  not ((style_id = 'house' and doc_id % 3 = 0) or (style_id = 'author-date' and title <> '')) as generated
from papers join pauthors using (paper_id), (values ('house'), ('author-date'), ('none')) s(style_id)""")
def cite(spark, sf):
    p = v.papers(spark, sf)
    pairs = p.select("paper_id", F.explode(F.array(*[F.lit(s) for s in ("house", "author-date", "none")])).alias("style_id"))
    return ly.cite(pairs, v.corpus(spark, sf))


@query("""select paper_id, citation_key as id, case when doc_id % 3 = 0 then 'paper-conference' else 'article-journal' end as type, title,
  case doc_id % 4 when 0 then 0 when 1 then 1 else 2 end as n_authors, year, venue as container, case when doc_id % 2 = 0 then cast(doc_id as varchar) end as volume, doi
from papers where title <> ''""")
def csl_items(spark, sf):
    out = ly.csl_items(v.papers(spark, sf))
    return out.select(
        "paper_id", "item.id", "item.type", "item.title", F.size("item.author").cast("bigint").alias("n_authors"),
        F.col("item.issued.date-parts")[0][0].alias("year"), F.col("item.container-title").alias("container"), "item.volume", F.col("item.DOI").alias("doi"),
    )


@query(f"select paper_id, {_REFLINE} as entry from papers")
def reference_list(spark, sf):
    return ly.bibliography(v.papers(spark, sf))
