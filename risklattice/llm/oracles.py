"""SQL of the queries that SQL can express, for DuckDB, written apart from the Spark code."""

from __future__ import annotations

PFAIR_MIX = """
with recursive sized as (select source, pow(count(*), 0.5) as share from documents group by source),
weighted as (select source, greatest(1, round(share * 1000 / sum(share) over ())) :: bigint as weight from sized),
lists as (select list(weight order by source) as w, list(source order by source) as s, sum(weight) :: bigint as cycle from weighted),
run as (
  select 0 :: bigint as t, list_transform(w, lambda x: 0 :: bigint) as done, null :: bigint as pick from lists
  union all
  select t + 1, list_transform(range(1, len(w) + 1), lambda i: done[i] + case when i = p then 1 else 0 end), p
  from (select t, done, w, list_sort(list_filter(list_transform(range(1, len(w) + 1), lambda i: case when done[i] < w[i] and done[i] * cycle < (t + 1) * w[i]
          then {'deadline': ((done[i] + 1) * cycle + w[i] - 1) // w[i], 'i': i} end), lambda x: x is not null))[1].i as p
        from run, lists where t < cycle)),
slots as (select pick, t - 1 as slot, row_number() over (partition by pick order by t) - 1 as k from run where pick is not null),
placed as (select doc_id, source, row_number() over (partition by source order by code % 4096, code, doc_id) - 1 as place
           from (select doc_id, source, ('0x' || substr(md5('=11|=' || doc_id || '|=' || source), 1, 13)) :: bigint as code from documents)),
timed as (select doc_id, p.source, place, place // 64 as block, weight, cycle, list_position(s, p.source) as i
          from placed p join weighted w on p.source = w.source, lists),
laid as (select doc_id, source, place, block, block // weight * cycle + slot as slot, block * cycle // weight as release,
                ((block + 1) * cycle + weight - 1) // weight as deadline
         from timed join slots on pick = i and k = block % weight)
select doc_id, source, place, block, slot, release, deadline, row_number() over (order by slot, source, place) - 1 as position from laid"""

TYPED_CHAT = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped as (select *, regexp_replace(text, '([\\<#])', '\\\1', 'g') as body, regexp_replace(role, '([\\<#])', '\\\1', 'g') as head from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, body)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0) :: bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, body) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length('### ') + length(head) + length(' <text>' || chr(10)) + length(body) + length(chr(10) || '</turn>' || chr(10))) :: bigint as formatted_chars,
       0 :: bigint as n_attachments, 0 :: bigint as n_tokens_expanded
from escaped group by conv_id"""

_WORDS = r"""list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"""


#: Items under 13 tokens: n, and start and length of each of one piece more than a fifth of n.
_PIECES = [(n, n * i // k, n * (i + 1) // k - n * i // k) for n in range(1, 13) for k in [n // 5 + 1] for i in range(k)]
_SHORT = " ".join(f"when {length} then concat_ws('|', {', '.join(f'w{i}' for i in range(length))})" for length in range(1, 6))


def _tokens(name: str, table: str, key: str) -> str:
    ahead = ", ".join(f"lead(w, {i}) over run as w{i}" for i in range(1, 9))
    long = "n >= 13 and" if name == "item" else ""
    parts = ", ".join(map(str, _PIECES if name == "item" else [(0, 0, length) for length in range(1, 6)]))
    own = "r.n = p.n and r.pos = p.start" if name == "item" else "r.pos + p.length <= r.n and p.length in (select length from short_lengths)"
    return f"""{name}_words as (select {key}, unnest(l) as w, unnest(range(len(l))) as pos, len(l) as n from (select {key}, {_WORDS} as l from {table})),
{name}_runs as (select {key}, pos, n, w as w0, {ahead} from {name}_words window run as (partition by {key} order by pos)),
{name}_seeds as (select {key}, pos, 0 as mask, concat_ws('|', w0, w1, w2, w3, w5, w6) as seed from {name}_runs where {long} w6 is not null
  union all select {key}, pos, 1, concat_ws('|', w0, w1, w2, w4, w7, w8) from {name}_runs where {long} w8 is not null
  union all select {key}, pos, 10 + length, case length {_SHORT} end from {name}_runs r join (select * from (values {parts}) v(n, start, length)) p on {own})"""


SPACED_SEEDS = f"""
with {_tokens("item", "benchmark", "item_id")},
short_lengths as (select distinct mask - 10 as length from item_seeds where mask > 10),
{_tokens("doc", "documents", "doc_id")},
hits as (select distinct doc_id, item_id, d.pos - i.pos as shift from doc_seeds d join item_seeds i on d.mask = i.mask and d.seed = i.seed),
laid as (select h.doc_id, h.item_id, shift, i.pos, i.n, coalesce(d.w = i.w, false) :: int as agree
         from hits h join item_words i on h.item_id = i.item_id left join doc_words d on h.doc_id = d.doc_id and d.pos = shift + i.pos),
summed as (select doc_id, item_id, shift, pos, n, sum(agree) over (partition by doc_id, item_id, shift order by pos rows between current row and 12 following) as matched from laid),
best as (select *, least(n, 13) as size, row_number() over (partition by doc_id, item_id order by matched desc, pos, shift) as rank
         from summed where pos + least(n, 13) <= n and matched >= ceil(cast(0.8 as double) * least(n, 13) - 1e-9))
select doc_id, item_id, matched :: int as n_matched, size :: int as n_window, pos :: int as item_start, (shift + pos) :: int as doc_start from best where rank = 1"""

NGRAM_JACCARD = r"""
with recursive split as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
           else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as s from split),
entries as (select doc_id, len(s) as n, unnest(s) as gram from sets),
product as (select x.doc_id as a, y.doc_id as b, x.n + y.n - count(*) as joint, count(*) as common
            from entries x join entries y on x.gram = y.gram and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id, x.n, y.n),
links as (select a, b from product where 100 * common >= 80 * joint),
reached as (select doc_id, doc_id as other from documents union select r.doc_id, l.b from reached r join links l on r.other = l.a),
least as (select doc_id, min(other) as component_id from reached group by doc_id)
select doc_id, len(s) as n_shingles, component_id from sets join least using (doc_id)"""

PHRASE_COLLOCATIONS = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
runs as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
totals as (select lang, sum(len(w)) :: bigint as n from runs group by lang),
grams as (select lang, m, array_to_string(w[i : i + m - 1], ' ') as phrase
          from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from (select lang, w, unnest(range(1, 6)) as m from runs))),
f as materialized (select lang, m, phrase, count(*) as a from grams group by lang, m, phrase having count(*) >= 100),
cut as (select lang, m, phrase, a, string_split(phrase, ' ') as w, unnest(range(1, m)) as k from f where m >= 2),
sides as (select c.lang, c.phrase, c.a, k, l.a as l, r.a as r, n, ((1000 :: hugeint * c.a * n) // (l.a :: hugeint * r.a)) :: bigint as score
          from cut c join f l on l.lang = c.lang and l.phrase = array_to_string(w[1 : k], ' ')
          join f r on r.lang = c.lang and r.phrase = array_to_string(w[k + 1 :], ' ') join totals t on t.lang = c.lang),
lowest as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as place from sides) where place = 1),
open as (select * from lowest p where not exists (
  select 1 from f q where q.lang = p.lang and q.a = p.a and length(q.phrase) > length(p.phrase) and contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from open)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000"""

ORACLES = {"op12_phrase_collocations": PHRASE_COLLOCATIONS, "op13_ngram_jaccard": NGRAM_JACCARD, "op1_pfair_mix": PFAIR_MIX, "op4_typed_chat": TYPED_CHAT, "op8_spaced_seeds": SPACED_SEEDS}
