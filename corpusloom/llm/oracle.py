"""DuckDB SQL for the operators that SQL can express (own literals, not imported from the operators)."""

from __future__ import annotations

QUALITY = r"""
with w as (
  select row_number() over () rid, doc_id, coalesce(text, '') t from documents
), s as (
  select rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines
  from w
), tri as (
  select rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] g
  from (select rid, words, unnest(range(1, len(words) - 1)) i from s where len(words) >= 3)
), rep as (
  select rid, i from tri qualify count(*) over (partition by rid, g) > 1
), cov as (
  select rid, count(distinct i + k) c from rep, (select unnest([0, 1, 2]) k) group by rid
), stats as (
  select s.doc_id, len(words) n, len(array_to_string(words, '')) wc, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) sym,
         len(lines) - len(list_distinct(lines)) dup, coalesce(c, 0) rep, len(lines) nl,
         len(regexp_replace(t, '[^!]', '', 'g')) bangs,
         len(list_filter(words, lambda x: lower(x) in (
           'a','and','are','as','be','by','for','from','have','in','is','it','of','on','or','that','the','this','to','was','with',
           'au','avec','ce','dans','de','des','du','elle','en','est','et','il','la','le','les','pas','pour','que','qui','sur','un','une',
           'das','dem','den','der','die','ein','eine','ich','ist','mit','nicht','sich','und','von','zu',
           'con','del','el','los','las','no','para','por','se','su','y'))) stop
  from s left join cov using (rid)
), v as (
  select *, n < 50 or 100 * rep > 50 * n failed from stats
)
select doc_id, n::bigint n_words, wc::bigint word_chars, sym::bigint n_symbols, dup::bigint n_dup_lines, rep::bigint n_repeat_words,
       failed base_failed,
       not failed and wc / greatest(n, 1) >= 2.5 and wc / greatest(n, 1) <= 14 and sym / greatest(n, 1) <= 0.1
         and bangs / greatest(n, 1) <= 0.5 and stop / greatest(n, 1) >= 0.02 and dup / greatest(nl, 1) <= 0.4
         and n / greatest(nl, 1) >= 1.5 kept
from v
"""

TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: x >= 0) c from embeddings
), d as (
  select q.vec_id query_id, v.vec_id,
         list_sum(list_transform(list_zip(q.c, v.c), lambda p: case when p[1] <> p[2] then 1 else 0 end))::integer distance
  from v q, v where q.vec_id % 50 = 0
)
select query_id, row_number() over (partition by query_id order by distance, vec_id)::integer "rank", vec_id, distance
from d qualify "rank" <= 10
"""

TRIE = r"""
with crc_table as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) t
), turns as (
  select conv_id, coalesce(role, '') r, coalesce(text, '') x,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) p
  from conversations where conv_id is not null
), convs as (
  select conv_id, conv_id - conv_id % 20 head,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
             lambda a, b: xor(a // 256, t[1 + xor(a, b) % 256])), 4294967295) % 4 h
  from (select distinct conv_id from turns), crc_table
), own as (
  select c.conv_id, r, x, p, 1 part from convs c join turns t on t.conv_id = c.conv_id and t.p > c.h
  union all
  select c.conv_id, r, x, p, 0 from convs c join turns t on t.conv_id = c.head and t.p <= c.h
), seq as (
  select conv_id, row_number() over w q, string_agg(sha256(r || chr(31) || x), '') over w key, x, count(*) over (partition by conv_id) n
  from own window w as (partition by conv_id order by part, p)
), prefixes as (
  select conv_id, q, sha256(key) k, x, n from seq
  union all
  select c.conv_id, 0, '', '', coalesce(s.n, 0) from convs c left join (select distinct conv_id, n from seq) s using (conv_id)
), nodes as (
  select q, k, min(conv_id) c, count(*) n_convs, any_value(x) x,
         sha256(coalesce(string_agg(case when n = q then conv_id::varchar end, ',' order by conv_id), '')) ends
  from prefixes group by q, k
), linked as (
  select n.*, p.k pk, m.c pc, (n.n_convs - 1) * len(regexp_extract_all(n.x, '[^\x20\x09-\x0D]+')) saved
  from nodes n left join prefixes p on p.conv_id = n.c and p.q = n.q - 1 left join nodes m on m.q = n.q - 1 and m.k = p.k
), children as (
  select q - 1 q, pk k, count(*) n_children from linked where q > 0 group by 1, 2
), above as (
  select n.q, n.k, p.q aq, p.k ak from nodes n join prefixes p on p.conv_id = n.c and p.q <= n.q
), totals as (
  select aq q, ak k, sum(case when n_children is null then 1 else 0 end)::bigint n_leaves, sum(saved)::bigint saved_tokens
  from above join linked l on l.q = above.q and l.k = above.k left join children c on c.q = above.q and c.k = above.k
  group by aq, ak
)
select l.c conv_id, l.q::bigint depth, l.pc parent_conv_id, l.n_convs::bigint n_convs, coalesce(n_children, 0)::bigint n_children,
       n_leaves, saved_tokens, ends ends_sha256
from linked l join totals t on t.q = l.q and t.k = l.k left join children c on c.q = l.q and c.k = l.k
"""

COLLOCATIONS = r"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
  from documents
), words as (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') w from pieces
), sizes as (
  select lang, sum(len(w))::bigint n from words group by lang
), phrases as (
  select lang, m, array_to_string(w[i:i + m - 1], ' ') phrase, count(*)::bigint a
  from (select lang, w, m, unnest(range(1, len(w) - m + 2)) i from words, (select unnest([1, 2, 3]) m) where len(w) >= m)
  group by all having count(*) >= 10
), cuts as (
  select p.lang, p.phrase, p.m, p.a, k, l.a l, r.a r, 1000000::hugeint * p.a * p.a // (l.a::hugeint * r.a) score
  from (select *, string_split(phrase, ' ') w, unnest(range(1, m)) k from phrases where m > 1) p
  join phrases l on l.lang = p.lang and l.phrase = array_to_string(w[1:k], ' ')
  join phrases r on r.lang = p.lang and r.phrase = array_to_string(w[k + 1:], ' ')
), best as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
), around as (
  select lang, array_to_string(w[i:i + 1], ' ') phrase, max(a) most
  from (select lang, string_split(phrase, ' ') w, a, unnest([1, 2]) i from phrases where m = 3) group by 1, 2
), ranked as (
  select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) rank
  from best b left join around x on x.lang = b.lang and x.phrase = b.phrase where most is null or 100 * most < 50 * a
)
select lang, rank::bigint "rank", phrase, a, l, r, n, score::bigint score from ranked join sizes using (lang) where rank <= 2000
"""

ORACLE: dict[str, str] = {"op7_multi_index_hashing": TOP_K, "op10_quality_rules": QUALITY, "op12_conversation_prefix_trie": TRIE,
                          "op13_phrase_collocations": COLLOCATIONS}
