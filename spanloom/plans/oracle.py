"""The registered queries as plain SQL over the same tables, written independently of the operators."""

from __future__ import annotations

from spanloom import vocab
from spanloom.plans.fixtures import CONCEPTS
from spanloom.plans.queries import SLIDING_SIZE, SLIDING_STEP

_NUMBER = (r"^\s*[+-]?((\p{Nd}(_?\p{Nd})*(\.(\p{Nd}(_?\p{Nd})*)?)?|\.\p{Nd}(_?\p{Nd})*)"
           r"([eE][+-]?\p{Nd}(_?\p{Nd})*)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$")


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(map(_quoted, values))


def _rows(rows) -> str:
    return ", ".join(f"({_list(row)})" for row in rows)


def _case(column: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"when {_quoted(a)} then {_quoted(b)}" for a, b in mapping.items())
    return f"case {column} {whens} else {column} end"


# Each entry may use the ones before it.
_CTE: dict[str, str] = {}

_CTE["fx_token"] = r"""
select doc_id, cast(pos as int) as pos, rtrim(ch, E' \n') as token,
 cast(lead0 + coalesce(sum(length(ch)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as int) as b
from (select doc_id, length(regexp_extract(text, '^\s*')) as lead0, unnest(regexp_extract_all(text, '\S+\s*')) as ch,
      generate_subscripts(regexp_extract_all(text, '\S+\s*'), 1) - 1 as pos from documents) x"""

_CTE["fx_concept"] = f"""
select cast(row_number() over () - 1 as int) as ix, concept from (select unnest([{_list(CONCEPTS)}]) as concept) c"""

_CTE["vocabulary"] = f"""
select * from (values {_rows((c, l, vocab.LABEL_PARENTS[l]) for c, l in vocab.CONCEPT_LABELS.items())}) v(concept, label, parent)"""

_CTE["fx_annotation"] = f"""
select t.doc_id, cast(t.pos as bigint) as ann_id, t.b, cast(e.b + length(e.token) as int) as e, c.concept
from fx_token t join (select doc_id, max(pos) as last from fx_token group by doc_id) n on t.doc_id = n.doc_id
join fx_token e on e.doc_id = t.doc_id and e.pos = least(t.pos + (t.doc_id + t.pos) % 6, n.last)
join fx_concept c on c.ix = (t.doc_id * 7 + t.pos) % {len(CONCEPTS)}
where (t.doc_id * 31 + t.pos * 17) % 23 < 3"""

_CTE["labelled"] = f"""
select a.*, v.parent, case when regexp_matches(a.concept, '{_NUMBER}') then 'DEC' else coalesce(v.label, 'SUB') end as label
from fx_annotation a left join vocabulary v on a.concept = v.concept"""

_CTE["segment"] = """
select doc_id, b as k1, e as k2, ann_id as k3, 0 as part, cast(null as varchar) as label,
  coalesce(lag(e) over (partition by doc_id order by b, e, ann_id), 0) as sb, b as se from labelled
union all
select doc_id, b, e, ann_id, 1, label, b, e from labelled
union all
select d.doc_id, 2147483647, 2147483647, 0, 2, null, coalesce(l.e, 0), length(d.text)
from documents d left join (select doc_id, arg_max(e, row(b, e, ann_id)) as e from labelled group by doc_id) l on l.doc_id = d.doc_id"""

_CTE["bio"] = r"""
select doc_id, cast(row_number() over (partition by doc_id order by k1, k2, k3, part, ix) as int) as line_no, token,
  case when label is null then 'O' when ix = 1 then 'B-' || label else 'I-' || label end as tag
from (select s.doc_id, k1, k2, k3, part, label,
        unnest(regexp_extract_all(substr(d.text, sb + 1, greatest(se - sb, 0)), '\S+')) as token,
        generate_subscripts(regexp_extract_all(substr(d.text, sb + 1, greatest(se - sb, 0)), '\S+'), 1) as ix
      from segment s join documents d on d.doc_id = s.doc_id) x"""


def _dedupe(source: str, look_back: int) -> str:
    """Look back by lag; full buffers watch the distances of slots 0 and 3 (mod 4), short ones fewer."""
    full = {5: (5, 2, 1), 4: (4, 1)}[look_back]
    by_line = {2: (1,), 3: (2,), 4: (3,), 5: (4, 1)}

    def hit(distance: int) -> str:
        return (f"(lag(token, {distance}) over w = token and lag(tag, {distance}) over w <> 'O')")

    def any_hit(distances: tuple[int, ...]) -> str:
        return "coalesce(" + " or ".join(map(hit, distances)) + ", false)"

    short = " ".join(f"when line_no = {n} then {any_hit(d)}" for n, d in by_line.items() if n <= look_back)
    return f"""
select doc_id, cast(row_number() over (partition by doc_id order by line_no) as int) as line_no, token, tag
from (select *, tag <> 'O' and case when line_no = 1 then false {short} else {any_hit(full)} end as dup
      from {source} window w as (partition by doc_id order by line_no)) x where not dup"""


_CTE["pass1"] = _dedupe("bio", 5)
_CTE["chain"] = _dedupe("pass1", 4)

_CTE["split_of"] = """
select doc_id, case when r <= floor(n * cast(0.11 as double)) then 'TRAIN'
  when r <= floor(n * cast(0.11 as double)) + floor(n * cast(0.78 as double)) then 'VALIDATION' else 'TEST' end as split
from (select doc_id, row_number() over (order by md5('42-' || doc_id), doc_id) as r, count(*) over () as n from documents) x"""


def _fx_tag(variant: int) -> str:
    return f"""
select doc_id, sent_id, tok_idx, pos, token, gold,
 case when err = 0 then 'O' when err = 1 then 'B-SUB' when err = 2 and gold <> 'O' then concat('I-', substr(gold, 3)) when err = 3 then 'B-TIM' else gold end as pred
from (select *, case when k >= 9 or (pos % 3 = 2 and cast(floor(pos / 6) as int) % 2 = 0) then 'O'
  else concat(case when pos % 3 = 0 then 'B-' else 'I-' end, case k when 0 then 'MED' when 1 then 'PRO' when 2 then 'UNI' when 3 then 'SUB' when 4 then 'TIM' when 5 then 'DEC' when 6 then 'ROU' when 7 then 'MEAS' else 'RTIM' end) end as gold
 from (select doc_id, pos, token, cast(floor(pos / 50) as int) as sent_id, cast(pos % 50 as int) as tok_idx,
   (doc_id * 5 + cast(floor(pos / 3) as int) * 11) % 20 as k, (doc_id * 13 + pos * {5 + variant}) % 17 as err from fx_token) x) y"""


_CTE["fx_tag"] = _fx_tag(0)
_CTE["fx_class"] = ("select doc_id, sent_id, tok_idx, token, regexp_replace(gold, '^[BI]-', '') as gold, "
                    "regexp_replace(pred, '^[BI]-', '') as pred from fx_tag")
_CTE["models"] = " union all ".join(
    f"select 'model{v + 1}' as model, gold, pred from ({_fx_tag(v)}) m{v}" for v in range(3))


def _suffix_runs(tags: str, column: str) -> str:
    return f"""
select doc_id, sent_id, tok_idx as pos,
  case when chg = 0 then null when k is not null then k when tag like 'I-%' then null else tag end as entity_type,
  case when chg = 0 then null when k is not null then joined when tag like 'I-%' then null else token end as surface
from (select x.*, j.joined from (
  select *, sum(chg) over (partition by doc_id, sent_id order by tok_idx rows unbounded preceding) as isl from (
    select *, case when k is not null and k is not distinct from lag(k) over (partition by doc_id, sent_id order by tok_idx) then 0 else 1 end as chg
    from (select doc_id, sent_id, tok_idx, token, {column} as tag,
      case when regexp_matches({column}, '(TIM|SUB|ROU|UNI|MEAS|DEC|RTIM)$') then right({column}, 3) end as k from {tags}) a) b) x
  join (select doc_id, sent_id, isl, string_agg(token, ' ' order by tok_idx) as joined from (
  select *, sum(chg) over (partition by doc_id, sent_id order by tok_idx rows unbounded preceding) as isl from (
    select *, case when k is not null and k is not distinct from lag(k) over (partition by doc_id, sent_id order by tok_idx) then 0 else 1 end as chg
    from (select doc_id, sent_id, tok_idx, token,
      case when regexp_matches({column}, '(TIM|SUB|ROU|UNI|MEAS|DEC|RTIM)$') then right({column}, 3) end as k from {tags}) a) b) y
  group by doc_id, sent_id, isl) j using (doc_id, sent_id, isl)) z"""


def _bio_islands(column: str) -> str:
    return f"""
select *, sum(chg) over (partition by doc_id, sent_id order by tok_idx rows unbounded preceding) as isl from (
  select doc_id, sent_id, tok_idx, token, {column} as tag,
    case when {column} like 'I-%' and lag({column}) over w <> 'O' and substr(lag({column}) over w, 3) = substr({column}, 3) then 0 else 1 end as chg
  from fx_tag window w as (partition by doc_id, sent_id order by tok_idx)) a"""


def _bio_spans(islands: str) -> str:
    return f"""
select doc_id, sent_id, cast(min(tok_idx) as int) as first_tok, cast(max(tok_idx) + 1 as int) as end_tok,
  regexp_replace(arg_min(tag, tok_idx), '^[BI]-', '') as label, string_agg(token, ' ' order by tok_idx) as text
from {islands} group by doc_id, sent_id, isl having arg_min(tag, tok_idx) <> 'O'"""


_CTE["gold_runs"] = _suffix_runs("fx_tag", "gold")
_CTE["pred_runs"] = _suffix_runs("fx_tag", "pred")
_CTE["gold_islands"] = _bio_islands("gold")
_CTE["pred_islands"] = _bio_islands("pred")
_CTE["gold_spans"] = _bio_spans("gold_islands")
_CTE["pred_spans"] = _bio_spans("pred_islands")

_CTE["aligned"] = """
select g.doc_id, g.sent_id, g.pos, g.entity_type as gt, g.surface as gs, p.entity_type as pt, p.surface as ps
from gold_runs g left join pred_runs p using (doc_id, sent_id, pos)"""


def _graded(source: str, keys: str) -> str:
    overlap = "case when contains(gs, ps) or contains(ps, gs) then 'PAR' else 'INC' end"

    def mode(both: str, same_type: str, same_text: str, other: str) -> str:
        return (f"case when gt is null and gs is null and pt is null and ps is null then null "
                f"when gt is null and gs is null then 'SPU' when pt is null and ps is null then 'MIS' "
                f"when gt = pt and gs = ps then {both} when gt = pt then {same_type} "
                f"when gs = ps then {same_text} else {other} end")
    cor, inc = "'COR'", "'INC'"
    return f"""
select {keys}, gt, gs, pt, ps,
  {mode(cor, cor, "case when lower(gt) = lower(pt) then 'COR' else 'INC' end", inc)} as type_grade,
  {mode(cor, overlap, cor, overlap)} as partial_grade,
  {mode(cor, inc, cor, inc)} as exact_grade,
  {mode(cor, inc, inc, inc)} as strict_grade
from {source}"""


_CTE["graded"] = _graded("aligned", "doc_id, sent_id, pos")
_CTE["muc_pair"] = """
select doc_id, sent_id, first_tok as pos, g.label as gt, g.text as gs, p.label as pt, p.text as ps
from gold_spans g full join pred_spans p using (doc_id, sent_id, first_tok)"""
_CTE["muc_graded"] = _graded("muc_pair", "doc_id, sent_id, pos")
_CTE["muc_long"] = " union all ".join(
    f"select doc_id, sent_id, '{m}' as grading, {m}_grade as grade from muc_graded" for m in vocab.MODES)


def _grade_counts(where: str, owner: str, name: str = "replace(owner, 'EAS', 'MEA')") -> str:
    measures = ", ".join(f"('{g}')" for g in vocab.GRADES)
    counters = ", ".join(f"count(*) filter ({m}_grade = measure) as n_{m}" for m in vocab.MODES)
    return f"""
select measure, {counters}, {name} as entity_type
from (select *, {owner} as owner from graded) g, (values {measures}) v(measure)
where owner is not null {where} group by measure, owner"""


_CTE["grade_count"] = _grade_counts("", "gt")
_CTE["grade_sum"] = """
select entity_type, grouping(entity_type) as total, """ + ", ".join(
    f"sum(case when measure = '{g}' then n_type + n_partial + n_exact + n_strict else 0 end) / 4.0 as {g.lower()}"
    for g in vocab.GRADES) + """
from grade_count group by rollup (entity_type)"""


def _entity_metrics(source: str) -> str:
    def ratio(a: str, b: str) -> str:
        return f"coalesce(cast({a} as double) / nullif({b}, 0), 0.0)"

    def f1(p: str, r: str) -> str:
        return f"round(coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0.0), 6)"
    return f"""
select entity_type, round(pos, 6) as pos, round(act, 6) as act,
  round(ep, 6) as exact_precision, round(er, 6) as exact_recall, {f1('ep', 'er')} as exact_f1,
  round(pp, 6) as partial_precision, round(pr, 6) as partial_recall, {f1('pp', 'pr')} as partial_f1
from (select case when total = 1 then 'Overall' else entity_type end as entity_type,
   cast(cor + inc + par + mis as double) as pos, cast(cor + inc + par + spu as double) as act,
   {ratio('cor', 'cor + inc + par + spu')} as ep, {ratio('cor', 'cor + inc + par + mis')} as er,
   {ratio('cor + 0.5 * par', 'cor + inc + par + spu')} as pp, {ratio('cor + 0.5 * par', 'cor + inc + par + mis')} as pr
 from {source}) x"""


def _scores(source: str, gold: str = "gold", pred: str = "pred", by: str = "") -> str:
    """``tag, tp, predicted, support`` from a table of pairs."""
    key = f"{by}, " if by else ""
    return f"""
select {key}tag, cast(sum(tp) as bigint) as tp, cast(sum(predicted) as bigint) as predicted, cast(sum(support) as bigint) as support
from (select {key}{gold} as tag, case when {gold} = {pred} then 1 else 0 end as tp, 0 as predicted, 1 as support from {source}
      union all select {key}{pred}, 0, 1, 0 from {source}) s where tag is not null group by {key}tag"""


def _prf(source: str, keys: str = "tag, tp, predicted, support") -> str:
    return f"""
select {keys}, coalesce(tp / nullif(cast(predicted as double), 0), 0.0) as precision,
  coalesce(tp / nullif(cast(support as double), 0), 0.0) as recall,
  coalesce(2.0 * tp / nullif(predicted + support, 0), 0.0) as f1 from ({source}) q"""


def _rounded_prf(source: str, keys: str, where: str = "") -> str:
    return (f"select {keys}, round(precision, 6) as precision, round(recall, 6) as recall, "
            f"round(f1, 6) as f1 from ({source}) r {where}")


def _averages(source: str, gold: str = "gold", pred: str = "pred", by: str = "") -> str:
    key = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    prf = _prf(_scores(source, gold, pred, by), f"{key}tag, tp, predicted, support")
    total = "cast(sum(support) as bigint) as support"
    micro_p, micro_r = "sum(tp) / sum(cast(predicted as double))", "sum(tp) / sum(cast(support as double))"
    return f"""
with scores as ({prf})
select {key}'macro' as average, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1, {total} from scores {group}
union all
select {key}'micro', round({micro_p}, 6), round({micro_r}, 6), round(2.0 * sum(tp) / (sum(predicted) + sum(support)), 6), {total} from scores {group}
union all
select {key}'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), {total} from scores {group}"""


def _confusion(source: str, labels) -> str:
    values = ", ".join(f"('{l}')" for l in labels)
    return f"""
select a.t as true_tag, b.p as pred_tag, count(s.gold) as n
from (values {values}) a(t) cross join (values {values}) b(p)
left join {source} s on s.gold = a.t and s.pred = b.p group by 1, 2"""


def _with(names: tuple[str, ...], body: str) -> str:
    """Prefix ``body`` with the named tables and everything they use."""
    needed: set[str] = set()

    def visit(name: str) -> None:
        if name in needed:
            return
        needed.add(name)
        for other in _CTE:
            if other != name and _uses(_CTE[name], other):
                visit(other)

    for name in names:
        visit(name)
    ctes = ", ".join(f"{n} as ({_CTE[n]})" for n in _CTE if n in needed)
    return f"with {ctes} select * from ({body}) final_result"


def _uses(sql: str, name: str) -> bool:
    import re
    return re.search(rf"\b(?:from|join)\s+{name}\b", sql) is not None


def _sql(body: str) -> str:
    return _with(tuple(n for n in _CTE if _uses(body, n)), body)


_AT = "row(doc_id, pos)"
_BY_TOKEN = f"""
select token, g.gold as true_tag, p.pred as pred_tag
from (select token, arg_max(gold, {_AT}) as gold from fx_tag group by token) g
right join (select token, arg_max(pred, {_AT}) as pred from fx_tag group by token) p using (token)"""

_PRF_WIDE = "\nunion all\n".join(
    f"select '{name}' as measure, " + ", ".join(
        f"round(max(case when tag = '{c}' then {column} end), 6) as \"{c}\"" for c in vocab.SCORED_CLASSES)
    + " from scores" for name, column in
    (("Precision", "precision"), ("Recall", "recall"), ("F1-score", "f1"), ("Support", "cast(support as double)")))

_SPAN_FLAGS = """
select label, count(*) as tp, 0 as predicted, 0 as support from gold_spans
  join (select doc_id, sent_id, first_tok, end_tok, label from pred_spans) q using (doc_id, sent_id, first_tok, end_tok, label) group by label
union all select label, 0, count(*), 0 from pred_spans group by label
union all select label, 0, 0, count(*) from gold_spans group by label"""

_MUC_COUNTS = ", ".join(f"cast(count(*) filter (grade = '{g}') as int) as {g.lower()}" for g in vocab.GRADES)
_MUC_POOLED = ", ".join(f"count(*) filter (grade = '{g}') as {g.lower()}" for g in vocab.GRADES)

_MODE_PRF = """
round(coalesce((cor + 0.5 * par) / nullif(cast(cor + inc + par + spu as double), 0), 0.0), 6) as precision,
round(coalesce((cor + 0.5 * par) / nullif(cast(cor + inc + par + mis as double), 0), 0.0), 6) as recall,
round(coalesce(2.0 * (cor + 0.5 * par) / nullif(cast(2 * (cor + inc + par) + spu + mis as double), 0), 0.0), 6) as f1"""

_TAGGER = """
select t.doc_id, s.split, cast(floor((t.line_no - 1) / 50) as int) as sent_id, cast((t.line_no - 1) % 50 as int) as tok_idx, token, tag
from chain t join split_of s on s.doc_id = t.doc_id"""
_CTE["split_line"] = _TAGGER
_CTE["tagger_model"] = """
select token, arg_min(tag, row(-n, tag)) as known from (
  select token, tag, count(*) as n from split_line where split = 'TRAIN' group by token, tag) c group by token"""
_CTE["tagger_row"] = """
select l.doc_id, l.sent_id, l.tok_idx, l.token, l.tag as gold, coalesce(m.known, 'O') as pred
from split_line l left join tagger_model m on m.token = l.token where l.split = 'TEST'"""
_CTE["tagger_gold"] = _suffix_runs("tagger_row", "gold")
_CTE["tagger_pred"] = _suffix_runs("tagger_row", "pred")
_CTE["tagger_aligned"] = _CTE["aligned"].replace("gold_runs", "tagger_gold").replace("pred_runs", "tagger_pred")
_CTE["tagger_graded"] = _graded("tagger_aligned", "doc_id, sent_id, pos")
_CTE["tagger_count"] = _grade_counts("", "gt").replace("from graded", "from tagger_graded")
_CTE["tagger_sum"] = _CTE["grade_sum"].replace("grade_count", "tagger_count")

for _side in ("gold", "pred"):
    _CTE[f"bio_{_side}"] = f"""
select i.doc_id, i.sent_id, i.tok_idx as pos, case when chg = 1 then regexp_replace(i.tag, '^[BI]-', '') end as entity_type,
  case when chg = 1 then coalesce(s.text, i.token) end as surface from {_side}_islands i
left join {_side}_spans s on s.doc_id = i.doc_id and s.sent_id = i.sent_id and s.first_tok = i.tok_idx"""
_CTE["bio_aligned"] = _CTE["aligned"].replace("gold_runs", "bio_gold").replace("pred_runs", "bio_pred")
_CTE["bio_graded"] = _graded("bio_aligned", "doc_id, sent_id, pos")
_CTE["bio_count"] = _grade_counts("", "gt", "owner").replace("from graded", "from bio_graded")
_CTE["bio_sum"] = _CTE["grade_sum"].replace("grade_count", "bio_count")

ORACLE: dict[str, str] = {
    "note_tokens": _sql("select doc_id, pos, token, b from fx_token"),
    "file_name_clean": r"select page_id, regexp_replace(url, '[^\p{L}\p{N}.-]', '', 'g') as name from pages",
    "concept_labels": _sql("select doc_id, ann_id, b, e, concept, label from labelled"),
    "bracket_term": _sql(
        r"select doc_id, ann_id, case when regexp_matches(concept, '\(([^()]+)\)[^()]*$') "
        r"then trim(regexp_extract(concept, '\(([^()]+)\)[^()]*$', 1)) else concept end as term from fx_annotation"),
    "concept_parents": _sql("select doc_id, ann_id, parent from labelled"),
    "span_text": _sql("select a.doc_id, a.ann_id, substr(d.text, a.b + 1, greatest(a.e - a.b, 0)) as surface "
                      "from fx_annotation a join documents d on d.doc_id = a.doc_id"),
    "bio_lines": _sql("select doc_id, line_no, token, tag from bio"),
    "bio_unannotated": _sql("select doc_id, pos + 1 as line_no, token, 'O' as tag from fx_token "
                            "where doc_id % 10 = 9 or doc_id not in (select doc_id from labelled)"),
    "dedupe_pass1": _sql("select doc_id, line_no, token, tag from pass1"),
    "dedupe_chain": _sql("select doc_id, line_no, token, tag from chain"),
    "windows_fixed": _sql("select doc_id, line_no, token, tag, cast(floor((line_no - 1) / 50) as int) as window_id from chain"),
    "windows_sliding": _sql(
        f"select c.doc_id, c.line_no, c.token, c.tag, cast(w.window_id as int) as window_id from chain c join "
        f"(select unnest(generate_series(0, (select max(line_no) from chain) // {SLIDING_STEP})) as window_id) w "
        f"on c.line_no - 1 >= w.window_id * {SLIDING_STEP} and c.line_no - 1 < w.window_id * {SLIDING_STEP} + {SLIDING_SIZE}"),
    "blank_collapse": r"""
with raw as (select doc_id, unnest(string_split(text, E'\n')) as line,
  generate_subscripts(string_split(text, E'\n'), 1) as ix from documents),
kept as (select *, trim(line) = '' and coalesce(trim(lag(line) over (partition by doc_id order by ix)) = '', false) as extra from raw)
select doc_id, cast(row_number() over (partition by doc_id order by ix) - 1 as int) as pos, line from kept where not extra""",
    "sentences": _sql("select doc_id, cast(floor((line_no - 1) / 50) as int) as sent_id, "
                      "string_agg(token, ' ' order by line_no) as text, string_agg(tag, ' ' order by line_no) as tags "
                      "from chain group by 1, 2"),
    "label_counts": _sql("select label, count(*) as n from labelled group by label"),
    "tag_counts": _sql("select tag, count(*) as n from bio group by tag"),
    "tag_chars": _sql("select tag, cast(sum(length(token)) as bigint) as n_chars from bio group by tag"),
    "parent_rollup": _sql("select parent, label, concept, cast(grouping(parent, label, concept) as int) as level, "
                          "count(*) as n from labelled group by rollup (parent, label, concept)"),
    "class_weights": _sql(
        "select tag, n, round(cast(sum(n) over () as double) / count(*) over () / n, 6) as weight "
        "from (select tag, count(*) as n from bio group by tag) c"),
    "distinct_labels": _sql("select distinct label from labelled"),
    "concept_usage": _sql(
        "select v.concept, count(a.doc_id) as n from vocabulary v left join fx_annotation a on a.concept = v.concept "
        f"where v.concept not in ({_list(vocab.CONCEPT_LIST_EXCLUDES)}) group by v.concept"),
    "tag_set_counts": _sql(
        "select t.tag, case when t.tag <> 'O' then left(t.tag, 1) end as prefix, "
        "case when t.tag <> 'O' then substr(t.tag, 3) end as class, count(f.doc_id) as n from "
        f"(select p || '-' || c as tag from (values ('B'), ('I')) p(p), (select unnest([{_list(vocab.CLASSES)}]) as c) c "
        "union all select 'O') t left join fx_tag f on f.gold = t.tag group by 1, 2, 3"),
    "first_seen_labels": _sql("select label, doc_id, ann_id from (select *, row_number() over (partition by label "
                              "order by doc_id, ann_id) as r from labelled) x where r = 1"),
    "split_map": _sql("select doc_id, split from split_of"),
    "split_counts": _sql(
        "select s.split, c.tag, count(*) as n, cast(sum(length(c.token)) as bigint) as n_chars "
        "from chain c left join split_of s on s.doc_id = c.doc_id group by 1, 2"),
    "tag_rename": _sql(f"select doc_id, sent_id, tok_idx, {_case('gold', vocab.DISPLAY_GOLD)} as true_tag, "
                       f"{_case('pred', vocab.DISPLAY_PRED)} as pred_tag from fx_tag"),
    "tag_strip_listed": _sql("select doc_id, sent_id, tok_idx, " + ", ".join(
        f"{_case(c, {t: t[2:] for t in vocab.LISTED_STRIP})} as {a}" for c, a in (("gold", "true_tag"), ("pred", "pred_tag")))
        + " from fx_tag"),
    "tag_strip_all": _sql("select doc_id, sent_id, tok_idx, gold as true_tag, pred as pred_tag from fx_class"),
    "flatten_predictions": _sql("select doc_id, sent_id, tok_idx, token, pred as pred_tag from fx_tag"),
    "flatten_gold": _sql("select doc_id, sent_id, tok_idx, token, gold as true_tag from fx_tag"),
    "user_tagger": _sql("select doc_id, sent_id, tok_idx, token, case when regexp_matches(token, '^[0-9]+$') "
                        "then 'B-DEC' else 'O' end as pred_tag from fx_tag"),
    "mft_tagger": _sql(
        "select f.doc_id, f.sent_id, f.tok_idx, f.token, f.gold as true_tag, m.known as pred_tag from fx_tag f join ("
        "select token, gold as known from (select token, gold, row_number() over (partition by token order by count(*) desc, gold) as r "
        "from fx_tag group by token, gold) c where r = 1) m on m.token = f.token"),
    "model_class_scores": _sql(_rounded_prf(
        _prf(_scores("models", by="model"), "model, tag, tp, predicted, support"), "model, tag, tp, predicted, support",
        f"where tag in ({_list(vocab.SCORED_TAGS)})")),
    "model_confusion": _sql("select model, gold as true_tag, pred as pred_tag, count(*) as n from models group by all"),
    "model_compare": _sql(_averages("models", by="model")),
    "pairs_by_token": _sql(_BY_TOKEN),
    "pairs_by_token_no_outside": _sql(
        f"select token, g.gold as true_tag, p.pred as pred_tag from (select token, arg_max(gold, {_AT}) as gold from fx_tag "
        f"where gold <> 'O' and token <> 'O' group by token) g join (select token, arg_max(pred, {_AT}) as pred from fx_tag "
        "where pred <> 'O' and token <> 'O' group by token) p using (token)"),
    "pair_counts_by_token": _sql(
        "select token, g.gold as true_tag, p.pred as pred_tag, cast(coalesce(g.n, 1) * p.n as bigint) as n_pairs "
        "from (select token, gold, count(*) as n from fx_tag group by token, gold) g "
        "right join (select token, pred, count(*) as n from fx_tag group by token, pred) p using (token)"),
    "pairs_by_position": _sql("select doc_id, sent_id, tok_idx, token, gold as true_tag, pred as pred_tag from fx_tag"),
    "confusion": _sql(_confusion("fx_tag", vocab.SCORED_TAGS)),
    "confusion_classes": _sql(_confusion("fx_class", vocab.SCORED_CLASSES)),
    "confusion_wide": _sql("select gold as true_tag, " + ", ".join(
        f"count(*) filter (pred = '{c}') as \"{c}\"" for c in vocab.SCORED_CLASSES)
        + f" from fx_class where gold in ({_list(vocab.SCORED_CLASSES)}) group by gold"),
    "prf_by_class": _sql(_rounded_prf(_prf(_scores("fx_tag")), "tag, tp, predicted, support",
                                      f"where tag in ({_list(vocab.SCORED_TAGS)})")),
    "prf_no_bio": _sql(_rounded_prf(_prf(_scores("fx_class")), "tag, tp, predicted, support",
                                    f"where tag in ({_list(vocab.SCORED_CLASSES)})")),
    "prf_averages": _sql(_averages("fx_tag")),
    "prf_averages_no_bio": _sql(_averages("fx_class")),
    "prf_by_token": _sql(_averages(f"({_BY_TOKEN}) bt", "true_tag", "pred_tag")),
    "prf_wide": _sql(f"with scores as ({_prf(_scores('fx_class'))}) {_PRF_WIDE}"),
    "entity_runs": _sql("select doc_id, sent_id, pos, entity_type, surface as surface_string from gold_runs"),
    "entity_runs_bio": _sql(
        "select i.doc_id, i.sent_id, i.tok_idx as pos, case when chg = 1 then regexp_replace(i.tag, '^[BI]-', '') end as entity_type, "
        "case when chg = 1 then coalesce(s.text, i.token) end as surface_string from gold_islands i "
        "left join gold_spans s on s.doc_id = i.doc_id and s.sent_id = i.sent_id and s.first_tok = i.tok_idx"),
    "aligned_pairs": _sql("select doc_id, sent_id, pos, gt as entity_type_gold, gs as surface_string_gold, "
                          "pt as entity_type_pred, ps as surface_string_pred from aligned"),
    "graded_pairs": _sql("select doc_id, sent_id, pos, type_grade, partial_grade, exact_grade, strict_grade from graded"),
    "graded_preview": _sql(
        "select doc_id, sent_id, pos, gt as entity_type_gold, gs as surface_string_gold, pt as entity_type_pred, "
        "ps as surface_string_pred, type_grade, partial_grade, exact_grade, strict_grade from graded "
        "order by doc_id, sent_id, pos limit 20"),
    "grade_counts": _sql("select measure, n_type, n_partial, n_exact, n_strict, entity_type from grade_count"),
    "grade_counts_spurious": _sql(_grade_counts("and owner <> 'O'", "coalesce(gt, pt)")),
    "entity_metrics_bio": _sql(_entity_metrics("bio_sum")),
    "entity_metrics": _sql(_entity_metrics("grade_sum")),
    "mode_metrics": _sql(
        f"select entity_type, grading, {_MODE_PRF} from (select entity_type, grading, " + ", ".join(
            f"sum(case when measure = '{g}' then n else 0 end) as {g.lower()}" for g in vocab.GRADES)
        + " from (" + " union all ".join(
            f"select entity_type, measure, '{m}' as grading, n_{m} as n from grade_count" for m in vocab.MODES)
        + ") l group by entity_type, grading) c"),
    "bio_spans": _sql("select doc_id, sent_id, first_tok, end_tok, label, text from gold_spans"),
    "span_prf": _sql(_rounded_prf(_prf(
        "select case when grouping(label) = 1 then 'Overall' else label end as label, cast(sum(tp) as bigint) as tp, "
        "cast(sum(predicted) as bigint) as predicted, cast(sum(support) as bigint) as support "
        f"from ({_SPAN_FLAGS}) f group by rollup (label)", "label, tp, predicted, support"),
        "label, tp, predicted, support")),
    "muc_by_sentence": _sql(
        f"select s.doc_id, s.sent_id, m.grading, {_MUC_COUNTS} from (select distinct doc_id, sent_id from fx_tag) s "
        f"cross join (values ('type'), ('partial'), ('exact'), ('strict')) m(grading) "
        "left join muc_long l on l.doc_id = s.doc_id and l.sent_id = s.sent_id and l.grading = m.grading group by 1, 2, 3"),
    "muc_scores": _sql(f"select grading, cor, inc, par, mis, spu, {_MODE_PRF} from "
                       f"(select grading, {_MUC_POOLED} from muc_long group by grading) c"),
    "tagger_report": _sql(_entity_metrics("tagger_sum")),
    "file_entities": _sql(
        "select doc_id, cast(floor((line_no - 1) / 50) as int) as sent_id, cast((line_no - 1) % 50 as int) as pos, tag, token "
        "from chain"),
    "file_sentences": _sql("select split, token, tag, count(*) as n from split_line group by all"),
    "file_tag_counts": _sql("select true as ok, tag, count(*) as n, cast(sum(length(token)) as bigint) as n_chars "
                            "from split_line group by tag"),
    "strict_parse": r"""
with raw as (select regexp_replace(unnest(string_split(text, E'\n')), '^\s+|\s+$', '', 'g') as line from documents),
parsed as (select string_split(line, ' ') as f from raw where line <> '')
select len(f) = 2 as ok, count(*) as n, cast(sum(case when len(f) = 2 then length(f[1]) else 0 end) as bigint) as n_chars
from parsed group by 1""",
    "file_tables": _sql("select tag, count(*) as n, k.kind from bio cross join (values ('csv'), ('tsv')) k(kind) group by tag, k.kind"),
    "io_roundtrip": _sql(
        "select s.format, s.n as n_written, s.n as n_read, true as same from ("
        + " union all ".join(f"select '{name}' as format, (select count(*) from (select distinct doc_id, floor((line_no - 1) / 50) "
                             "from chain)) as n" for name in ("sentence text", "entity json", "parquet"))
        + " union all select unnest(['csv', 'tsv']), (select count(distinct tag) from chain)) s"),
}
ORACLE |= {
    "bio_lines_unbounded": ORACLE["bio_lines"],
    "entity_runs_unbounded": ORACLE["entity_runs"],
    "entity_runs_bio_unbounded": ORACLE["entity_runs_bio"],
    "packed_lines": ORACLE["dedupe_chain"],
    "streamed_lines": ORACLE["dedupe_chain"],
    "join_sentences": ORACLE["entity_metrics"],
    "json_entity_report": ORACLE["entity_metrics"],
    "file_folders": "select 'n' || doc_id as folder, 1 as depth from documents",
    "file_sizes": "select 'n' || doc_id as folder, count(*) as n_files, cast(sum(strlen(coalesce(text, ''))) as bigint) as n_bytes "
                  "from documents group by doc_id",
    "file_notes": "select doc_id, coalesce(text, '') as text from documents",
    "file_spans": _sql("select doc_id, ann_id, b, e, concept from fx_annotation"),
    "utf16_spans": _sql("select doc_id, ann_id, b, e from fx_annotation"),
}

# Span scores of a source of tokens, and entity scores per model.
_CTE["conll_row"] = """
select doc_id, sent_id, tok_idx, token, tag as gold, case when regexp_matches(token, '^[0-9]+$') then 'B-DEC' else 'O' end as pred
from split_line"""


def _span_prf(prefix: str, gold_rows: str, pred_rows: str, by: str = "") -> str:
    """Span scores where gold and predicted tags come from the given tables."""
    for side, rows in (("gold", gold_rows), ("pred", pred_rows)):
        _CTE[f"{prefix}_{side}_islands"] = _bio_islands(side).replace("fx_tag", rows)
        _CTE[f"{prefix}_{side}_spans"] = _bio_spans(f"{prefix}_{side}_islands")
    flags = _SPAN_FLAGS.replace("gold_spans", f"{prefix}_gold_spans").replace("pred_spans", f"{prefix}_pred_spans")
    columns = "label, tp, predicted, support"
    return _rounded_prf(_prf(
        "select case when grouping(label) = 1 then 'Overall' else label end as label, cast(sum(tp) as bigint) as tp, "
        f"cast(sum(predicted) as bigint) as predicted, cast(sum(support) as bigint) as support from ({flags}) f group by rollup (label)",
        columns), f"{by}{columns}")


def _model_entities(v: int) -> str:
    _CTE[f"m{v}_runs"] = _suffix_runs(f"m{v}_tag", "pred")
    _CTE[f"m{v}_aligned"] = _CTE["aligned"].replace("pred_runs", f"m{v}_runs")
    _CTE[f"m{v}_graded"] = _graded(f"m{v}_aligned", "doc_id, sent_id, pos")
    _CTE[f"m{v}_count"] = _grade_counts("", "gt").replace("from graded", f"from m{v}_graded")
    _CTE[f"m{v}_sum"] = _CTE["grade_sum"].replace("grade_count", f"m{v}_count")
    return f"select 'model{v + 1}' as model, * from ({_entity_metrics(f'm{v}_sum')}) e{v}"


for _v in range(3):
    _CTE[f"m{_v}_tag"] = _fx_tag(_v)
_MODEL_SPANS = " union all ".join(_span_prf(f"m{v}", f"m{v}_tag", f"m{v}_tag", f"'model{v + 1}' as model, ") for v in range(3))
_MODEL_ENTITIES = " union all ".join(_model_entities(v) for v in range(3))
_CONLL_SPANS = _span_prf("conll", "conll_row", "conll_row")
ORACLE |= {
    "conll_token_report": _sql(_rounded_prf(_prf(_scores("conll_row")), "tag, tp, predicted, support")),
    "conll_span_report": _sql(_CONLL_SPANS),
    "model_span_scores": _sql(_MODEL_SPANS),
    "model_entity_scores": _sql(_MODEL_ENTITIES),
}
