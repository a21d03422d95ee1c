"""The registered queries: each operator over its whole table, with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, exact_dedup, fim, language, lines, mixing, quality, repair, setjoin, simhash, tokens, toxicity
from .common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_groups(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.set_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_exact_dedup,
        op3_quality,
        op4_decontamination,
        op5_language,
        op6_chat_rotation,
        op7_mixing,
        op8_toxicity,
        op9_simhash,
        op10_token_counts,
        op11_conversation_repair,
        op12_fill_in_middle,
        op13_ngram_jaccard_join,
    )
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as h
  from documents)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by h) as group_size,
       doc_id = first_value(doc_id) over w as kept,
       h as text_sha256
from d
window w as (partition by h order by n desc, doc_id nulls last rows between unbounded preceding and unbounded following)""",
    "op6_chat_rotation": r"""
with t as (
  select conv_id, turn, coalesce(role, 'unknown') as role, replace(coalesce(text, ''), '<|', '< |') as text
  from conversations),
n as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as position from t),
p as (select distinct conv_id, role as perspective from t where role <> 'system'),
v as (
  select n.conv_id, p.perspective, n.position, n.turn,
         case when n.role = p.perspective then 'assistant' when n.role = 'system' then 'system' else 'user' end as shown,
         case when n.role not in (p.perspective, 'system') then regexp_replace(n.role, '[^A-Za-z0-9_-]', '_', 'g') end as name,
         n.text
  from n join p on n.conv_id is not distinct from p.conv_id),
h as (select *, '<|im_start|>' || shown || coalesce(' name=' || name, '') || chr(10) as head from v),
s as (select *, head || text || '<|im_end|>' || chr(10) as segment from h),
o as (
  select *, cast(sum(length(segment)) over (partition by conv_id, perspective order by position) as bigint) as "end" from s)
select conv_id, perspective, position, turn, shown as role, name, segment, "end" - length(segment) as start, "end",
       shown = 'assistant' as train,
       case when shown = 'assistant' then "end" - length(segment) + length(head) end as train_start,
       case when shown = 'assistant' then "end" - 1 end as train_end
from o""",
    "op11_conversation_repair": r"""
with recursive base as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name
  from conversations),
bits as (  -- crc32 bit by bit over the bytes of the name, all of them ASCII
  select name, 0 as i, cast(4294967295 as bigint) as crc from (select distinct name from base)
  union all
  select name, i + 1, s8
  from (
    select name, i, xor(crc, cast(ascii(substr(name, i + 1, 1)) as bigint)) as s0 from bits where i < length(name)),
    lateral (select xor(s0 >> 1, 3988292384 * (s0 & 1)) as s1),
    lateral (select xor(s1 >> 1, 3988292384 * (s1 & 1)) as s2),
    lateral (select xor(s2 >> 1, 3988292384 * (s2 & 1)) as s3),
    lateral (select xor(s3 >> 1, 3988292384 * (s3 & 1)) as s4),
    lateral (select xor(s4 >> 1, 3988292384 * (s4 & 1)) as s5),
    lateral (select xor(s5 >> 1, 3988292384 * (s5 & 1)) as s6),
    lateral (select xor(s6 >> 1, 3988292384 * (s6 & 1)) as s7),
    lateral (select xor(s7 >> 1, 3988292384 * (s7 & 1)) as s8)),
kinds as (select name, xor(crc, 4294967295) % 20 as kind from bits where i = length(name)),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from base join kinds using (name), range(case when kind = 3 then 2 else 1 end) as copies
  where kind <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from damaged),
judged as (
  select *, substr(role, 1, 1) as initial,
         case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b'
              when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'd'
              when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 't' else '-' end as fault,
         lag(substr(role, 1, 1)) over (partition by conv_id order by pos) || substr(role, 1, 1) as pair,
         count(*) over (partition by conv_id) as n
  from placed),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (where fault = 'b') as blank, count(*) filter (where fault = 'd') as duplicate,
         count(*) filter (where fault = 't') as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal
  from judged group by conv_id),
inserts(q, k, r) as (values (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 2)),
kept(q, c, r) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
walk(conv_id, pos, q, cost, audit) as (
  select distinct conv_id, cast(0 as bigint), 0, cast(0 as bigint), '' from damaged
  union all
  select conv_id, pos, q, cast(min(cost) as bigint), arg_min(audit, lpad(cast(cost as varchar), 12, '0') || audit)
  from (
    select w.conv_id, w.pos + 1 as pos, e.r as q, w.cost + 2 * i.k + e.cost as cost, w.audit || repeat('I', cast(i.k as bigint)) || e.op as audit
    from walk w
    join judged j on j.conv_id is not distinct from w.conv_id and j.pos = w.pos + 1
    join inserts i on i.q = w.q,
    lateral (
      select i.r as r, 3 as cost, 'D' as op
      union all
      select r, cast(j.fault = 't' as int), 'K' from kept where kept.q = i.r and kept.c = j.initial and j.fault not in ('b', 'd')
      union all
      select case i.r when 2 then 3 else 2 end, 2 + cast(j.fault = 't' as int), 'R' where j.fault not in ('b', 'd')) e)
  group by conv_id, pos, q),
finished as (
  select w.conv_id, w.cost + 2 * i.k as cost, w.audit || repeat('I', cast(i.k as bigint)) as audit
  from walk w join inserts i on i.q = w.q and i.r in (0, 3)
  where w.pos = (select max(n) from judged j where j.conv_id is not distinct from w.conv_id)),
best as (
  select conv_id, min(cost) as cost, arg_min(audit, lpad(cast(cost as varchar), 12, '0') || audit) as audit from finished group by conv_id),
letters as (
  select conv_id, unnest(range(1, length(audit) + 1)) as k, audit from best),
ops as (
  select conv_id, k, substr(audit, k, 1) as op,
         length(regexp_replace(substr(audit, 1, k), 'I', '', 'g')) as pos,
         length(regexp_replace(substr(audit, 1, k), 'D', '', 'g')) as nth
  from letters),
lines as (
  select o.conv_id, o.k, o.op, o.nth, j.role, j.text,
         max(case when o.op = 'K' and j.initial = 's' then 1 else 0 end) over (partition by o.conv_id) as lead
  from ops o left join judged j on j.conv_id is not distinct from o.conv_id and j.pos = o.pos and o.op <> 'I'
  where o.op <> 'D'),
spelled as (
  select conv_id, string_agg(
    case when op = 'K' then role when (nth - lead) % 2 = 1 then 'user' else 'assistant' end || ':' || case when op = 'I' then '' else text end,
    chr(10) order by k) as body
  from lines group by conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost,
       coalesce(audit, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join counts k on k.conv_id is not distinct from c.conv_id
left join best b on b.conv_id is not distinct from c.conv_id
left join spelled s on s.conv_id is not distinct from c.conv_id""",
    "op12_fill_in_middle": r"""
with d as (
  select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
k as (
  select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens,
         cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
         cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4
  from d),
c as (
  select doc_id, t, tokens, len(tokens) as n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as a,
         greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
              when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from k),
p as (
  select doc_id, t, n, form, array_to_string(tokens[1:a], '') as prefix, array_to_string(tokens[a + 1:b], '') as middle,
         array_to_string(tokens[b + 1:], '') as suffix
  from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
       case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(t) as restored_sha256
from p""",
    "op13_ngram_jaccard_join": r"""
with recursive d as (
  select row_number() over () as row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as materialized (
  select distinct row, unnest(list_transform(range(1, greatest(2, len(w) - 2)), lambda i: array_to_string(w[i:i + 3], ' '))) as shingle
  from d where len(w) > 0),
n as materialized (select row, count(*) as n from s group by row),
same as (
  select a.row as a, b.row as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.row <> b.row group by a.row, b.row),
links as materialized (
  select a, b from same join n x on x.row = a join n y on y.row = b where 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) as (
  select a, b from links
  union
  select reach.a, links.b from reach join links on reach.b = links.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, min(o.doc_id)) as component_id
from d left join n on n.row = d.row left join reach r on r.a = d.row left join d o on o.row = r.b
group by d.row, d.doc_id, n.n""",
}
