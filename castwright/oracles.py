"""SQL of the longer queries, put together from parts."""

from __future__ import annotations

NL = "chr(10)"


WS = "[\\s\\x0b\\x{85}\\p{Z}]"
TAIL = "[。！？…；，、.!?;, ]$"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sent(x: str) -> str:
    body = f"regexp_replace(regexp_replace({strip(x)}, '([。！？；，、）」』]){WS}+', '\\1', 'g'), '[：:]$', '')"
    return f"(case when {body} = '' then '' when regexp_matches({body}, '[。.！!？?；;…]$') then {body} else {body} || '。' end)"


def bolded(x: str) -> str:
    bare = strip(f"regexp_replace(regexp_replace({strip(x)}, '([。！？；，、）」』]){WS}+', '\\1', 'g'), '^\\*\\*((?s:.+))\\*\\*$', '\\1')")
    return f"(case when {bare} = '' then '' else '**' || {bare} || '**' end)"


def blank(x: str) -> str:
    return f"trim(coalesce({x}, '')) = ''"


def explained(term: str, descr: str) -> str:
    d = strip(f"coalesce({descr}, '')")
    return f"'**' || coalesce({term}, '') || '**' || case when {d} = '' then '' else '：' || {d} || case when regexp_matches({d}, '[。.]$') then '' else '。' end end"


def no(x: str) -> str:
    return f"coalesce({x}, '') = ''"


FINISHED = """f0 as (select episode_id, arg_max(struct_pack(n := show_notes), scraped_at).n as show_notes from episodes group by 1),
f1 as (select episode_id, arg_min(struct_pack(q := questions), run_no).q as questions from struct_out group by 1),
fin as (select o.*, show_notes, questions from output_docs o left join f0 on o.episode_id = f0.episode_id left join f1 on o.episode_id = f1.episode_id)"""
# Neighbouring blocks of one label: lines with their label, the label in force before each, groups, parts with their glue.
BLOCKS = f"""w0 as (select distinct episode_id, full_text from output_docs where full_text is not null and {strip("full_text")} <> ''),
w1 as (select episode_id, full_text, unnest(string_split(full_text, {NL})) as raw, unnest(range(len(string_split(full_text, {NL})))) as pos from w0),
w2 as (select *, {strip("raw")} as s from w1),
w3 as (select *, regexp_extract(s, '^【([^】]+)】', 1) as name, regexp_full_match(s, '-{{3,}}|\\*{{3,}}|_{{3,}}') as rule from w2 where s <> ''),
w4 as (select *, coalesce(last_value(case when name <> '' or rule then name end ignore nulls) over (partition by episode_id, full_text order by pos rows between unbounded preceding and 1 preceding), '') as force,
  row_number() over (partition by episode_id, full_text order by pos) as no from w3),
w5 as (select *, sum(case when no = 1 or rule or (name <> '' and name <> force) then 1 else 0 end) over (partition by episode_id, full_text order by pos) as grp,
  case when name <> '' then regexp_replace(s, '^【[^】]+】{WS}*', '') else s end as part from w4),
w6 as (select episode_id, full_text, grp, pos, part, case when lead(part) over (partition by episode_id, full_text, grp order by pos) is null or regexp_matches(part, '{TAIL}') then '' else '。' end as glue from w5 where part <> ''),
w7 as (select episode_id, full_text, grp, string_agg(part || glue, '' order by pos) as body from w6 group by 1, 2, 3),
w8 as (select episode_id, full_text, grp, arg_min(name, pos) as name from w5 group by 1, 2, 3),
w9 as (select w8.episode_id, w8.full_text, w8.grp, case when name = '' then '' else '【' || name || '】' end || regexp_replace(coalesce(body, ''), '[，,]$', '。') as block from w8 left join w7 on w8.episode_id = w7.episode_id and w8.full_text = w7.full_text and w8.grp = w7.grp),
blocks as (select episode_id, full_text, string_agg(block, {NL} || {NL} order by grp) as talk from w9 group by 1, 2)"""
MERGED = f"with {BLOCKS} select o.episode_id, coalesce(talk, o.full_text) as t from output_docs o left join blocks b on o.episode_id = b.episode_id and o.full_text = b.full_text"
POINTS = f"""flatten(list_transform(coalesce(key_points, []), lambda p: list_concat(
  ['- **' || {sent("coalesce(p.point, '')")} || '**' || case when {no("p.evidence")} then '' else {sent("p.evidence")} end || case when {no("p.quote")} then '' else '「' || p.quote || '」' end],
  list_transform(coalesce(p.terms, []), lambda t: '  - ' || {explained("t.term", "t.descr")}))))"""
WORDS = f"list_transform(coalesce(keywords, []), lambda k: '- ' || {explained('k.keyword', 'k.descr')})"
ASKED = f"""list_transform(coalesce(questions, []), lambda q, i: i || '.' || case when {bolded("coalesce(q.question, '')")} = '' then '' else ' ' || {bolded("coalesce(q.question, '')")} end || case when {no("q.answer")} then '' else {NL} || '   ' || q.answer end)"""
FOOT = "case when costs['llm'] is not null then 'LLM 费用约 ' || printf('%.4f', costs['llm']) || ' 元' end"
MARKDOWN = f"""
with {FINISHED}, {BLOCKS}
select f.episode_id, concat('# ', title, {NL}, {NL}, '> 来源：', podcast_name, ' | ', title, ' | ', pub_date,
  array_to_string(list_transform(coalesce(warnings, []), lambda w: {NL} || {NL} || '> [WARN] ' || w), ''),
  {NL}, {NL}, '## Show Notes', {NL}, {NL}, case when {strip("coalesce(show_notes, '')")} = '' then '（无）' else show_notes end,
  {NL}, {NL}, '## 摘要', {NL}, {NL}, summary, {NL}, {NL}, '## 核心观点', {NL}, {NL}, array_to_string({POINTS}, {NL}),
  case when len(coalesce(keywords, [])) > 0 then {NL} || {NL} || '## 术语表' || {NL} || {NL} || array_to_string({WORDS}, {NL}) end,
  {NL}, {NL}, '## 问题与思考', {NL}, {NL}, array_to_string({ASKED}, {NL} || {NL}),
  {NL}, {NL}, '## 人物简介', {NL}, {NL}, case when {no("speaker_intro")} then '（无）' else speaker_intro end,
  {NL}, {NL}, '## 原文转录', {NL}, {NL}, coalesce(talk, f.full_text),
  case when {FOOT} is not null then {NL} || {NL} || '---' || {NL} || {NL} || {FOOT} end) as md
from fin f left join blocks b on f.episode_id = b.episode_id and f.full_text = b.full_text"""
_PARTS = f"""m as ({MARKDOWN}), s as (select episode_id, string_split(md, {NL} || '## ') as parts from m),
x as (select episode_id, unnest(parts) as part, unnest(range(len(parts))) as sec_no, len(parts) as n from s),
y as (select episode_id, sec_no, case when sec_no > 0 then trim(split_part(part, {NL}, 1)) else '' end as heading,
  (case when sec_no > 0 then substring(part, length(split_part(part, {NL}, 1)) + 2) else part end) || case when sec_no < n - 1 then {NL} else '' end as body from x)"""
SECTIONS = f"with {_PARTS} select episode_id, heading, arg_max(body, sec_no) as body from y where heading <> '' group by 1, 2"
BULLETS = f"""with {_PARTS}, l as (select episode_id, sec_no, heading, unnest(string_split(body, {NL})) as line, cast(unnest(range(len(string_split(body, {NL})))) as int) as line_no from y where heading <> '' or body <> '')
select episode_id, cast(sec_no as int) as sec_no, heading, line_no, case when regexp_matches(line, '^-\\s') then 1 else 2 end as level, regexp_extract(line, '^\\s*-\\s+\\*\\*([^*]+)\\*\\*', 1) as bold,
  trim(regexp_replace(line, '^\\s*-\\s+(\\*\\*[^*]+\\*\\*)?', '')) as rest from l where regexp_matches(line, '^\\s*-\\s+')"""


def _body(h: str, old: str = "") -> str:
    one = lambda x: f"(list_transform(list_filter(s, lambda y: y.h = '{x}'), lambda y: y.b))[-1]"
    return f"coalesce({one(h)}, {one(old)})" if old else one(h)


def _hits(lines: str, pattern: str, but: str = "") -> str:
    return f"len(list_filter({lines}, lambda l: regexp_matches(l, '{pattern}')" + (f" and not regexp_matches(l, '{but}')" if but else "") + "))"


_DOCS = f"""m as ({MARKDOWN}), s0 as (select episode_id, md, string_split(md, {NL} || '## ') as parts from m),
s1 as (select episode_id, md, parts[1] as pre, list_transform(parts[2:], lambda p: {{'h': {strip(f"split_part(p, {NL}, 1)")}, 'b': substring(p, length(split_part(p, {NL}, 1)) + 2)}}) as s from s0),
d as (select *, coalesce({_body("原文转录", "全文转录")}, '') as t, coalesce({_body("核心观点")}, '') as k, coalesce({_body("问题与思考")}, '') as q, coalesce({_body("术语表")}, '') as g, coalesce({_body("人物简介")}, '') as i from s1),
e as (select *, string_split(t, {NL}) as tl, string_split(k, {NL}) as kl, string_split(q, {NL}) as ql, list_filter(string_split(g, {NL}), lambda l: regexp_matches(l, '^\\s*- ')) as gl,
  list_filter(string_split(i, {NL}), lambda l: {strip("l")} <> '') as il, regexp_extract_all(t, '(?m)^\\s*【([^】]+)】', 1) as labels, regexp_extract_all(t, '(?m)^【([^】]+)】', 1) as heads,
  list_filter(list_transform(string_split_regex(q, '(?m)^\\s*\\d+\\.'), lambda b: list_filter(list_transform(string_split(b, {NL}), lambda l: regexp_replace(l, '{WS}+$', '')), lambda l: l <> '')), lambda b: len(b) > 0) as answers,
  (list_filter(string_split(pre, {NL}), lambda l: regexp_matches(l, '^\\s*> 来源：')))[1] as source,
  case when regexp_matches(md, '(?m)^##\\s*摘要\\s*$') then split_part(split_part(md, {NL} || '## 摘要' || {NL}, 2), {NL} || '## 原文转录' || {NL}, 1) else split_part(md, {NL} || '## 原文转录' || {NL}, 1) end as editorial from d),
h0 as (select distinct episode_id, heads from e), h1 as (select episode_id, unnest(heads) as l, unnest(range(len(heads))) as pos from h0), h2 as (select *, lag(l) over (partition by episode_id order by pos) as before from h1),
h3 as (select *, sum(case when l = before then 0 else 1 end) over (partition by episode_id order by pos) as run from h2), h4 as (select episode_id, max(n) as most from (select episode_id, run, count(*) as n from h3 group by 1, 2) group by 1)"""
_REQUIRED = [("Show Notes", ""), ("摘要", ""), ("核心观点", ""), ("问题与思考", ""), ("人物简介", ""), ("原文转录", "全文转录")]
_CHECKS = {
    "V1": " + ".join(f"(case when {_body(*h)} is null then 1 else 0 end)" for h in _REQUIRED),
    "V2": " + ".join(f"(case when {strip(_body(*h))} = '' then 1 else 0 end)" for h in _REQUIRED),
    "V3": "case when coalesce(length(source) - length(replace(source, '|', '')), 0) < 2 then 1 else 0 end",
    "V4": "case when contains(md, '## Show Notes') then 0 else 1 end",
    "V5": _hits("kl", "^\\s*- ", "\\*\\*.+\\*\\*"), "V6": _hits("kl", "^-\\s+\\*\\*.+?\\*\\*\\s*[:：]"), "V7": _hits("kl", "^\\s*>\\s*\\S"), "V8": _hits("kl", "^\\s*[「『].*[」』]\\s*$"),
    "V9": "length(q) - length(translate(q, '①②③④⑤⑥⑦⑧⑨⑩', ''))", "V10": f"case when {strip('q')} <> '' and not regexp_matches(q, '(?m)^\\s*\\d+\\.') then 1 else 0 end",
    "V11": _hits("ql", "^\\s*-\\s+\\*\\*.+?\\?\\*\\*\\s+\\S"), "V12": _hits("ql", "^\\s*\\d+\\.(\\s*$|\\s+[^*\\s]|\\s+\\*([^*]|$)|\\s\\s+\\*\\*)"),
    "V13": "len(list_filter(answers, lambda b: len(list_filter(b, lambda l: regexp_matches(l, '[？?]$'))) >= 2 and regexp_matches(b[-1], '[？?]$')))",
    "V14": "case when len(list_filter(s, lambda x: x.h = '术语表')) > 0 and array_to_string(list_filter(list_transform(s, lambda x: x.h), lambda x: x in ('核心观点', '术语表', '问题与思考')), '|') <> '核心观点|术语表|问题与思考' then 1 else 0 end",
    "V15": _hits("gl", "", "\\*\\*.+?\\*\\*[:：]"), "V16": _hits("gl", "", "[。.]\\s*$"),
    "V18": f"case when i = '' or {strip('i')} = '（无）' then 0 when len(il) = 0 then 1 when {_hits('il', '^\\s*>')} > 0 then {_hits('il', '^\\s*>')} else {_hits('il', '', '^\\s*\\*\\*.+?\\*\\*[:：]')} end",
    "V19": _hits("tl", "^\\s*\\*\\*.+?\\*\\*[:：]"), "V20": "case when t <> '' and not contains(t, '**') then 1 else 0 end", "V21": "len(list_distinct(regexp_extract_all(t, '\\[SPEAKER_\\d+\\]')))",
    "V23": "case when len(labels) >= 4 and list_max(list_transform(list_distinct(labels), lambda x: len(list_filter(labels, lambda y: y = x)))) > 0.85 * len(labels) then list_max(list_transform(list_distinct(labels), lambda x: len(list_filter(labels, lambda y: y = x)))) else 0 end",
    "V24": "case when coalesce(most, 0) >= 3 then most else 0 end", "V26": _hits("tl", "^\\s*【[^】]*】.*[，,]\\s*$"), "V30": "len(regexp_extract_all(md, '(?m)^##\\s+大纲'))",
    "V31": "case when contains(md, '```mermaid') or regexp_matches(md, '(?m)^\\s*mindmap\\s*$') then 1 else 0 end", "V32": "(length(md) - length(replace(md, '```', ''))) // 3", "V33": "len(regexp_extract_all(editorial, '[”」』》\"]、[「『《“\"]'))",
}
PLAIN_CHECKS = tuple(_CHECKS)
CHECKS = f"with {_DOCS}" + " union all ".join(f""" select e.episode_id, '{c}' as "check", cast({x} as bigint) as n_hits from e left join h4 on e.episode_id = h4.episode_id where ({x}) > 0""" for c, x in _CHECKS.items())
_BRACKET = "^((?s:.+?))[（(]((?s:.+?))[）)]\\s*$"
TERMS = f"""with {_DOCS}, g0 as (select distinct episode_id, g, list_filter(list_concat(kl, ql), lambda l: regexp_matches(l, '^-\\s+')) as bullets, len(list_filter(kl, lambda l: regexp_matches(l, '^-\\s+'))) as n,
  list_transform(list_filter(list_concat(kl, ql), lambda l: regexp_matches(l, '^\\s+-\\s+\\*\\*.+?\\*\\*')), lambda l: regexp_replace(trim(regexp_extract(l, '^\\s+-\\s+\\*\\*(.+?)\\*\\*', 1)), '[。.]\\s*$', '')) as names, gl from e),
g1 as (select *, unnest(gl) as line, cast(unnest(range(len(gl))) as int) as term_no from g0), g2 as (select *, trim(regexp_extract(line, '\\*\\*(.+?)\\*\\*[:：]', 1)) as term from g1),
g3 as (select *, list_filter(list_concat([case when regexp_matches(term, '{_BRACKET}') then trim(regexp_extract(term, '{_BRACKET}', 1)) end, case when regexp_matches(term, '{_BRACKET}') then trim(regexp_extract(term, '{_BRACKET}', 2)) end, term],
  case when contains(term, '/') then list_transform(string_split(term, '/'), lambda p: trim(p)) else [] end), lambda v: v is not null and length(v) >= 2) as v from g2),
g4 as (select *, list_filter(list_transform(v, lambda x: list_position(list_transform(bullets, lambda b: contains(b, x)), true)), lambda i: i is not null and i > 0) as spots, case when term = '' then 'keep' when list_has_any(v, names) then 'dup' end as fixed from g3),
g5 as (select *, coalesce(fixed, case when len(spots) > 0 then 'inline' else 'keep' end) as state from g4), g6 as (select *, case when state = 'inline' then cast(spots[1] - 1 as int) end as target from g5)
select distinct episode_id, term_no, nullif(term, '') as term, state, target, case when target < n then '核心观点第 ' || (target + 1) || ' 条' when target is not null then '问题与思考第 ' || (target - n + 1) || ' 条' end as place from g6"""
PACKAGES = f"""with e as (select episode_id, arg_max(struct_pack(title := title, podcast_name := podcast_name, pub_date := pub_date, show_notes := show_notes), scraped_at) as e from episodes group by 1), t as (select distinct episode_id, raw_text from transcripts)
select e.episode_id, '# ' || coalesce(e.e.title, '') || {NL} || {NL} || '> 来源：' || concat_ws(' | ', e.e.podcast_name, e.e.title, e.e.pub_date) || {NL} || {NL} || '# Show Notes' || {NL} ||
  case when {blank("e.e.show_notes")} then '（无）' else e.e.show_notes end || {NL} || {NL} || '# 转录全文' || {NL} || coalesce(raw_text, '') as text from e join t on e.episode_id = t.episode_id"""
MARKS = """with m as (select episode_id, unnest(regexp_extract_all(show_notes, '(?m)^(\\d{1,3}:\\d{2}(?::\\d{2})?)\\s', 1)) as mark from episodes)
select episode_id, mark, case len(string_split(mark, ':')) when 2 then cast(split_part(mark, ':', 1) as double) * 60 + cast(split_part(mark, ':', 2) as double)
  else cast(split_part(mark, ':', 1) as double) * 3600 + cast(split_part(mark, ':', 2) as double) * 60 + cast(split_part(mark, ':', 3) as double) end as seconds from m"""
_STRUCTS = f"""f0 as (select episode_id, arg_min(struct_pack(q := questions, m := speaker_mapping), run_no) as x from struct_out group by 1), p0 as (select distinct o.episode_id, summary, key_points, keywords, speaker_intro, x.q as questions, x.m as mapping from output_docs o left join f0 on o.episode_id = f0.episode_id)"""
_P = lambda c: strip(f"coalesce({c}, '')")
PAYLOADS = f"""with {_STRUCTS}, c as (select unnest(['good', 'cut', 'mixed']) as kind)
select episode_id, kind, case when kind = 'cut' then '' else {_P("summary")} end as summary,
  case when kind = 'cut' then [] else list_filter(list_transform(coalesce(key_points, [])[:20], lambda p: {{'point': {_P("p.point")}, 'evidence': {_P("p.evidence")}, 'quote': {_P("p.quote")}, 'anchor': {_P("p.anchor")},
    'terms': list_filter(list_transform(coalesce(p.terms, []), lambda t: {{'term': {_P("t.term")}, 'descr': {_P("t.descr")}}}), lambda t: t.term <> '')}}), lambda p: p.point <> '') end as points,
  case when kind = 'cut' then [] else list_filter(list_transform(coalesce(keywords, []), lambda k: {{'keyword': {_P("k.keyword")}, 'descr': {_P("k.descr")}}}), lambda k: k.keyword <> '')[:10] end as keywords,
  case when kind = 'cut' then [] else list_filter(list_transform(coalesce(questions, []), lambda q: {{'question': {_P("q.question")}, 'answer': {_P("q.answer")}, 'anchor': {_P("q.anchor")}}}), lambda q: q.question <> '')[:5] end as questions,
  case when kind = 'cut' or mapping is null then 0 else cardinality(mapping) end as n_mapped, case when kind = 'good' then {_P("speaker_intro")} else '' end as speaker_intro from p0, c"""
