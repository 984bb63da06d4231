"""SQL with the same results, for the corpus queries that SQL can express."""

from __future__ import annotations

from spanloom.llm.licence_list import more_known
from spanloom.llm.licences import NOTICE_LINE, NOTICES, PHRASES, PUNCTUATION, SPELLINGS, WORD


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _respell(form: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for old, new in pairs:
        form = f"replace({form}, {_quoted(old)}, {_quoted(new)})"
    return form


def _lines(column: str) -> str:
    return (f"list_filter(string_split(lower({column}), chr(10)), lambda x: regexp_matches(x, {_quoted(WORD)}) "
            f"and not regexp_matches(x, {_quoted(NOTICE_LINE)}))")


def _digest(body: str) -> str:
    form = f"trim(regexp_replace({body}, {_quoted(PUNCTUATION)}, ' ', 'g'))"
    return f"sha256({_respell(_respell(form, SPELLINGS), PHRASES)})"


_LICENCES = f"""
with known as (
  select digest, min(license_id) as known_id from (
    select license_id, {_digest("array_to_string(" + _lines('body') + ", chr(10))")} as digest
    from (values {', '.join(f'({_quoted(i)}, {_quoted(t)})' for i, t in more_known(NOTICES))}) as v(license_id, body))
  group by digest),
form as (
  select doc_id, {_lines('text')} as lines from documents),
whole as (
  select doc_id, {_digest("array_to_string(lines, chr(10))")} as text_digest from form),
line as (
  select doc_id, unnest(lines) as body from form),
notice as (
  select l.doc_id, array_to_string(list_sort(list_distinct(list(k.known_id))), ',') as notice_ids, count(*) as n_notices
  from line l join known k on {_digest('l.body')} = k.digest group by l.doc_id)
select w.doc_id, k.known_id as license_id, coalesce(n.notice_ids, '') as notice_ids,
       coalesce(n.n_notices, 0) as n_notices
from whole w left join known k on k.digest = w.text_digest left join notice n on n.doc_id = w.doc_id
"""

_URLS = r"""
with part as (
  select page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(rule_host, rule_path, rule_verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best as (
  select p.page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) as rule,
         max_by(rule_verdict, length(rule_host || rule_path)) as verdict
  from part p join rules r
    on (p.host = rule_host or ends_with(p.host, '.' || rule_host)) and starts_with(p.path, rule_path)
  group by p.page_id)
select p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') as verdict
from part p left join best b using (page_id)
"""

_REPEATS = r"""
with cut as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
  from documents),
start as (
  select doc_id, words, unnest(range(1, len(words) - 48)) as p from cut where len(words) >= 50),
windows as (
  select doc_id, p, sha256(array_to_string(list_slice(words, p, p + 49), ' ')) as body from start),
first_seen as (
  select body, min(doc_id) as first_doc from windows group by body having count(distinct doc_id) > 1),
covered as (
  select distinct w.doc_id, unnest(range(w.p, w.p + 50)) as p
  from windows w join first_seen f on f.body = w.body and f.first_doc < w.doc_id),
gone as (
  select doc_id, list(p) as places, count(*) as n from covered group by doc_id)
select c.doc_id, len(words)::bigint as n_words, coalesce(g.n, 0)::bigint as n_removed,
       sha256(case when g.n is null then array_to_string(words, ' ')
              else coalesce(array_to_string(list_transform(list_filter(list_zip(words, range(1, len(words) + 1)),
                   lambda x: not list_contains(g.places, x[2])), lambda x: x[1]), ' '), '') end) as kept_sha256
from cut c left join gone g using (doc_id)
"""

_NEGATIVES = r"""
with vec as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
         list_dot_product(a.v, b.v)::bigint as score
  from vec a join vec b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
positive as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.positive_id,
       row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id)::int as rank,
       s.other_id as negative_id, p.positive_score, s.score as negative_score
from positive p join scored s on s.anchor_id = p.anchor_id and not s.same
  and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify rank <= 3
"""

_RANKED = r"""
with tok as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents),
one as (
  select doc_id, term, count(*) as tf from tok group by all),
len as (
  select doc_id, sum(tf)::bigint as n from one group by doc_id),
total as (
  select count(*) as n_docs, sum(n)::bigint as n_terms from len),
weight as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w
  from one, total group by term, n_docs),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
scored as (
  select a.item_id, o.doc_id,
         sum(w.w * ((1000000000 * o.tf) // (1000 * o.tf + 20 * (50 + (50 * l.n * t.n_docs) // t.n_terms))))::bigint as score
  from asked a join one o using (term) join weight w using (term) join len l on l.doc_id = o.doc_id, total t
  group by a.item_id, o.doc_id)
select item_id, rank::int as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
where rank <= 50
"""

ORACLE: dict[str, str] = {"op1_license_scan": _LICENCES, "op5_substring_dedup": _REPEATS, "op10_url_filters": _URLS,
                          "op11_hard_negative_mining": _NEGATIVES, "op12_ranked_lexical_search": _RANKED}
