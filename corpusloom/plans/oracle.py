"""DuckDB SQL for every registered query that SQL can express.

Templates use @NAME@ placeholders (no f-strings: the regex classes are full of
braces).  Views: region nation customer supplier part orders lineitem events
documents embeddings pages benchmark labels conversations.
"""

from __future__ import annotations

from .. import constants as K
from ..functions.text import WS_CLASS
from ..operators.clean import EMAIL_RE, IPV4_RE, PHONE_RE
from .fixtures import BASKET_RULES, FUZZY_VOCAB, PHRASE_VOCAB
from .queries import MED_LISTS

SUBST = {
    "@WS@": WS_CLASS,
    "@NONWORD@": r"[^\p{L}\p{N}_]",
    "@LICENSES@": "['public-domain','CC-BY','CC-BY-NC','ODbL','MIT','custom','unknown']",
    "@ALLOWED@": "('public-domain','CC-BY','CC-BY-NC','ODbL','MIT')",
    "@EMAIL@": EMAIL_RE,
    "@IPV4@": IPV4_RE,
    "@PHONE@": PHONE_RE,
    "@JSWS@": r"[\x{09}-\x{0d}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]",
}

# Reusable SQL expressions (DuckDB)
NORM = "regexp_replace(regexp_replace(@X@, '@WS@+', ' ', 'g'), '^ | $', '', 'g')"
DPROC = "lower(trim(regexp_replace(coalesce(@X@, ''), '@NONWORD@', ' ', 'g')))"
LICENSE = "(@LICENSES@)[(('0x' || substr(md5(@X@), 1, 2))::INTEGER % 7) + 1]"
UNIFORM = "(('0x' || substr(md5('1337:' || CAST(@X@ AS VARCHAR)), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"
SPLIT = ("CASE WHEN @U@ < 0.8::DOUBLE THEN 'train' WHEN @U@ < (0.8::DOUBLE + 0.1::DOUBLE) "
         "THEN 'val' ELSE 'test' END")


def norm(x: str) -> str:
    return NORM.replace("@X@", x)


def dproc(x: str) -> str:
    return DPROC.replace("@X@", x)


def license_(x: str) -> str:
    return LICENSE.replace("@X@", x)


def split_(x: str) -> str:
    return SPLIT.replace("@U@", UNIFORM.replace("@X@", x))


Q: dict[str, str] = {}

Q["corpus_build"] = f"""
WITH r AS (
  SELECT doc_id, {norm('text')} AS text, lang, source FROM documents
), f AS (
  SELECT * FROM r WHERE lang IN ('en') AND length(text) >= 20
), k AS (
  SELECT *, CASE WHEN text IS NOT NULL AND length(text) > 0 THEN md5({dproc('text')}) END AS tk FROM f
), reps AS (
  SELECT tk, min(doc_id) AS rep FROM k WHERE tk IS NOT NULL GROUP BY tk
), kept AS (
  SELECT k.* FROM k LEFT JOIN reps ON k.tk = reps.tk WHERE k.tk IS NULL OR k.doc_id = reps.rep
)
SELECT source, {split_('doc_id')} AS split, count(*) AS n FROM kept GROUP BY ALL
"""

Q["unify"] = f"""
WITH r AS (SELECT doc_id, text AS raw_text, source FROM documents),
u AS (
  SELECT doc_id, CASE WHEN raw_text IS NOT NULL AND length(raw_text) > 0 THEN {norm('raw_text')} ELSE raw_text END AS text,
         source FROM r
)
SELECT doc_id, 'doc_' || CAST(doc_id AS VARCHAR) AS id, 'text' AS modality, 'summarize' AS task, text,
       NULL::VARCHAR AS image_path, NULL::VARCHAR AS answer, NULL::VARCHAR AS rationale,
       CASE WHEN text IS NOT NULL AND length(text) > 0 THEN '' END AS labels_icd10,
       CASE WHEN text IS NOT NULL AND length(text) > 0 THEN '' END AS labels_snomed,
       source, {license_('source')} AS license, 'train' AS split
FROM u
"""

Q["merge_sources"] = """
SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS id, text, source, NULL::VARCHAR AS role FROM documents
UNION ALL
SELECT 'bench_' || CAST(item_id AS VARCHAR) AS id, text, 'benchmark' AS source, NULL::VARCHAR AS role FROM benchmark
UNION ALL
SELECT 'conv_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id, text, 'conversations' AS source, role
FROM conversations
"""

Q["normalize_text"] = f"SELECT doc_id, {norm('text')} AS text FROM documents"

Q["nonempty_text"] = f"""
SELECT 'conv_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id FROM conversations
WHERE {norm('text')} IS NOT NULL AND length({norm('text')}) > 0
"""

Q["language_allow"] = "SELECT doc_id, lang FROM documents WHERE lang IN ('en')"

Q["min_text_len"] = f"""
SELECT doc_id, length(t) AS n FROM (SELECT doc_id, {norm('text')} AS t FROM documents) WHERE length(t) >= 20
"""

Q["license_allow"] = f"""
SELECT doc_id, license FROM (SELECT doc_id, {license_('source')} AS license FROM documents)
WHERE license IN @ALLOWED@
"""

Q["truncate_text"] = "SELECT doc_id, substr(text, 1, 2000) AS text FROM documents"

Q["corpus_profile"] = f"""
SELECT source, {split_('doc_id')} AS split, count(*) AS n, 'unified' AS step FROM documents GROUP BY ALL
"""

Q["concat_fields"] = """
SELECT p_partkey, concat_ws(' ', nullif(p_name, ''), nullif(p_brand, ''), nullif(p_type, '')) AS text FROM part
"""

Q["redact_pii"] = """
WITH c AS (
  SELECT doc_id, text,
         regexp_replace(text, '@EMAIL@', '[EMAIL]', 'g') AS t1
  FROM documents
), d AS (
  SELECT doc_id, text, t1, regexp_replace(t1, '@IPV4@', '[IP]', 'g') AS t2 FROM c
)
SELECT doc_id,
       regexp_replace(t2, '@PHONE@', '[PHONE]', 'g') AS text,
       len(regexp_extract_all(text, '@EMAIL@'))::BIGINT AS n_email,
       len(regexp_extract_all(text, '@IPV4@'))::BIGINT AS n_ip,
       len(regexp_extract_all(t2, '@PHONE@'))::BIGINT AS n_phone
FROM d
"""

Q["default_process"] = f"SELECT doc_id, {dproc('text')} AS proc FROM documents"

# Code points of the processed text, for shingles.
_CP = f"""
p AS (SELECT doc_id, {dproc('text')} AS proc FROM documents),
cp AS (SELECT doc_id, proc, list_transform(string_split(proc, ''), lambda x: unicode(x)::BIGINT) AS c FROM p)
"""

Q["char_shingles"] = f"""
WITH {_CP},
sh AS (
  SELECT doc_id, unnest(CASE WHEN len(c) >= 5 THEN list_transform(range(1, len(c) - 3), lambda i: (((c[i]::HUGEINT * 2097152 + c[i+1]) * 2097152 + c[i+2]) * 2097152 + c[i+3]) * 2097152 + c[i+4]) ELSE [] END) AS g
  FROM cp
)
SELECT cp.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles
FROM cp LEFT JOIN (SELECT doc_id, count(DISTINCT g) AS n FROM sh GROUP BY doc_id) s ON cp.doc_id = s.doc_id
"""

# Portable MinHash: polynomial hash of 5 code points mod p, slots ((a_k*h+b_k) mod 2^64) >> 32.
_H = ("(((((c[i] * 1000003 + c[i+1]) % 2147483647) * 1000003 + c[i+2]) % 2147483647 * 1000003 + c[i+3]) "
      "% 2147483647 * 1000003 + c[i+4]) % 2147483647")
_SIG = f"""
{_CP},
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(c) >= 5 THEN list_transform(range(1, len(c) - 3), lambda i: {_H}) ELSE [] END) AS h
  FROM cp
),
slots AS (
  SELECT k, ('0x' || substr(md5('a' || CAST(k AS VARCHAR)), 1, 8))::UBIGINT AS ah,
            ('0x' || substr(md5('a' || CAST(k AS VARCHAR)), 9, 8))::UBIGINT | 1::UBIGINT AS al,
            ('0x' || substr(md5('b' || CAST(k AS VARCHAR)), 1, 8))::UBIGINT AS bh,
            ('0x' || substr(md5('b' || CAST(k AS VARCHAR)), 9, 8))::UBIGINT AS bl
  FROM range(128) t(k)
),
sv AS (
  -- top 32 bits of (a*h + b) mod 2^64 from 32-bit halves: no 128-bit arithmetic
  SELECT doc_id, k,
         min((((ah * h::UBIGINT) % 4294967296) + bh + ((al * h::UBIGINT + bl) // 4294967296)) % 4294967296)::BIGINT AS v
  FROM sh, slots GROUP BY doc_id, k
),
sig AS (
  SELECT cp.doc_id,
         coalesce(s.sig, list_transform(range(128), lambda x: 4294967296::BIGINT)) AS sig
  FROM cp LEFT JOIN (SELECT doc_id, list(v ORDER BY k) AS sig FROM sv GROUP BY doc_id) s ON cp.doc_id = s.doc_id
  WHERE cp.doc_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) > 0)
),
mem AS (
  SELECT doc_id, b, sig[b*16+1 : b*16+16] AS bucket FROM sig, range(8) t(b)
)
"""

Q["minhash_signature"] = f"""
WITH {_SIG}
SELECT doc_id, array_to_string(sig, ',') AS sig FROM sig
"""

Q["lsh_candidates"] = f"""
WITH {_SIG},
pairs AS (
  SELECT DISTINCT m1.doc_id AS a, m2.doc_id AS b, m1.b AS band
  FROM mem m1 JOIN mem m2 ON m1.b = m2.b AND m1.bucket = m2.bucket AND m1.doc_id <> m2.doc_id
)
SELECT a AS doc_id, count(DISTINCT band)::BIGINT AS n_buckets, min(b) AS first_neighbor FROM pairs GROUP BY a
"""

Q["dedup_first_wins"] = f"""
WITH RECURSIVE {_SIG},
pairs AS (
  SELECT DISTINCT m1.doc_id AS a, m2.doc_id AS b
  FROM mem m1 JOIN mem m2 ON m1.b = m2.b AND m1.bucket = m2.bucket AND m2.doc_id < m1.doc_id
),
nodes AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn,
         coalesce((SELECT list(b) FROM pairs WHERE pairs.a = n.doc_id), []::BIGINT[]) AS lower_nb
  FROM (SELECT a AS doc_id FROM pairs UNION SELECT b FROM pairs) n
),
walk(rn, kept) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT w.rn + 1,
         CASE WHEN list_has_any(n.lower_nb, w.kept) THEN w.kept ELSE list_append(w.kept, n.doc_id) END
  FROM walk w JOIN nodes n ON n.rn = w.rn + 1
),
final AS (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1)
SELECT doc_id FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM nodes)
   OR list_contains((SELECT kept FROM final), doc_id)
"""

Q["dedup_exact"] = f"""
WITH k AS (SELECT doc_id, CASE WHEN text IS NOT NULL AND length(text) > 0 THEN md5({dproc('text')}) END AS tk FROM documents),
reps AS (SELECT tk, min(doc_id) AS rep FROM k WHERE tk IS NOT NULL GROUP BY tk)
SELECT k.doc_id FROM k LEFT JOIN reps ON k.tk = reps.tk WHERE k.tk IS NULL OR k.doc_id = reps.rep
"""

Q["split_random"] = f"SELECT doc_id, {split_('doc_id')} AS split FROM documents"


# --------------------------------------------------------------------------- QA evaluation


def lit(s: str) -> str:
    """SQL string literal (raw newlines allowed inside)."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^@WS@+|@WS@+$', '', 'g')"


def nans(x: str) -> str:
    return f"regexp_replace({strip(f'lower({x})')}, '[^a-z0-9.]+', ' ', 'g')"


def letter(x: str) -> str:
    inner = strip(f"coalesce({x}, '')")
    return (f"CASE substr(lower({inner}), 1, 1) "
            "WHEN 'a' THEN 0 WHEN 'b' THEN 1 WHEN 'c' THEN 2 WHEN 'd' THEN 3 ELSE -1 END")


def yn(x: str) -> str:
    h = f"substr(lower(coalesce({x}, '')), 1, 10)"
    return f"CASE WHEN contains({h}, 'yes') THEN 'yes' WHEN contains({h}, 'no') THEN 'no' ELSE 'unknown' END"


def ctx(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND length({x}) > 0 THEN 'Context: ' || {x} || chr(10) ELSE '' END"


QA = """
t AS (
  SELECT c.conv_id, c.turn, c.role, c.text,
         CASE WHEN n.role = 'assistant' THEN n.text ELSE '' END AS pred
  FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1
),
qa AS (
  SELECT conv_id * 100 + turn AS id, conv_id, turn, (['mcq','yn','short'])[conv_id % 3 + 1] AS type,
         text AS question, pred, text AS gold
  FROM t WHERE role = 'user'
)
"""

F1 = """
tok AS (
  SELECT id, side, unnest(string_split(s, ' ')) AS tok FROM (
    SELECT id, 0 AS side, @NP@ AS s FROM @SRC@ UNION ALL SELECT id, 1 AS side, @NG@ AS s FROM @SRC@)
),
tokf AS (SELECT * FROM tok WHERE length(tok) > 0),
sz AS (SELECT id, count(*) FILTER (WHERE side = 0) AS np, count(*) FILTER (WHERE side = 1) AS ng FROM tokf GROUP BY id),
cnt AS (SELECT id, tok, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) AS cp, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS cg
        FROM tokf GROUP BY id, tok),
same AS (SELECT id, sum(least(cp, cg))::DOUBLE AS same FROM cnt GROUP BY id),
f1 AS (
  SELECT s.id,
         CASE WHEN coalesce(np, 0) = 0 OR coalesce(ng, 0) = 0 THEN
                CASE WHEN coalesce(np, 0) = 0 AND coalesce(ng, 0) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
              WHEN coalesce(same, 0) = 0 THEN 0.0::DOUBLE
              ELSE 2 * (same / np) * (same / ng) / ((same / np) + (same / ng)) END AS f1
  FROM @SRC@ s LEFT JOIN sz ON s.id = sz.id LEFT JOIN same ON s.id = same.id
)
"""


def f1_cte(src: str, pred: str, gold: str) -> str:
    return (F1.replace("@SRC@", src).replace("@NP@", nans(f"coalesce({pred}, '')"))
              .replace("@NG@", nans(f"coalesce({gold}, '')")))


Q["load_pubmedqa"] = f"""
WITH raw AS (
  SELECT conv_id * 100 + turn AS id,
         CASE WHEN turn % 2 = 0 THEN text END AS question, text AS ques,
         CASE WHEN role = 'assistant' THEN text ELSE '' END AS context, role AS abstract,
         CASE WHEN turn % 3 = 0 THEN ' Yes ' END AS answer, upper(role) AS final_decision
  FROM conversations
)
SELECT id, 'yn' AS type, coalesce(nullif(question, ''), nullif(ques, ''), '') AS question,
       coalesce(nullif(context, ''), nullif(abstract, ''), '') AS context,
       lower({strip("coalesce(nullif(answer, ''), nullif(final_decision, ''), '')")}) AS answer
FROM raw
"""

_MCQ = f"""
m AS (
  SELECT o_orderkey AS id, 'Order ' || CAST(o_orderkey AS VARCHAR) AS question,
         coalesce(o_orderstatus, '') AS opa, coalesce(o_orderpriority, '') AS opb,
         coalesce(CAST(o_custkey AS VARCHAR), '') AS opc, '' AS opd,
         (['a', 'B', ' c ', 'd', 'x', ''])[o_orderkey % 6 + 1] AS cop
  FROM orders
)
"""

Q["load_mcq"] = f"""
WITH {_MCQ}
SELECT id, 'mcq' AS type, question, concat_ws('|', opa, opb, opc, opd) AS options, {letter('cop')} AS label FROM m
"""

Q["load_shortqa"] = """
SELECT conv_id * 100 + turn AS id, 'short' AS type, text AS question, role AS context, '' AS answer FROM conversations
"""

Q["prompt_mcq"] = f"""
WITH {_MCQ}
SELECT id, {lit(K.MCQ_PROMPT_HEAD)} || 'Question: ' || question || chr(10)
       || 'A) ' || opa || chr(10) || 'B) ' || opb || chr(10) || 'C) ' || opc || chr(10) || 'D) ' || opd
       || chr(10) || 'Answer:' AS prompt
FROM m
"""

Q["prompt_short"] = f"""
WITH {QA}
SELECT id, {lit(K.SHORT_PROMPT_HEAD)} || {ctx('pred')} || 'Question: ' || question || chr(10) || 'Answer:' AS prompt FROM qa
"""

Q["prompt_yesno"] = f"""
WITH {QA}
SELECT id, {lit(K.YESNO_PROMPT_HEAD)} || {ctx('pred')} || 'Question: ' || question || chr(10) || 'Answer:' AS prompt FROM qa
"""

Q["extract_letter"] = f"SELECT conv_id, turn, {letter('text')} AS letter FROM conversations"
Q["extract_yesno"] = f"SELECT conv_id, turn, {yn('text')} AS yn FROM conversations"
Q["normalize_answer"] = f"SELECT conv_id, turn, {nans('text')} AS norm FROM conversations"

Q["exact_match"] = f"""
WITH {QA}
SELECT id, CASE WHEN {nans("coalesce(pred, '')")} = {nans("coalesce(gold, '')")} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em
FROM qa
"""

Q["token_f1"] = f"""
WITH {QA}, {f1_cte('qa', 'pred', 'gold')}
SELECT id, round(f1, 6) AS f1 FROM f1
"""

Q["mcq_accuracy"] = f"""
WITH {QA}
SELECT id, CASE WHEN {letter('pred')} = {letter('question')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS acc FROM qa
"""

_GOLD_YN = "CASE WHEN @G@ IN ('yes', 'no') THEN @G@ ELSE 'unknown' END"

Q["yesno_accuracy"] = f"""
WITH {QA}
SELECT id, CASE WHEN {yn('pred')} = {_GOLD_YN.replace('@G@', 'lower(' + strip('question') + ')')}
               THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS acc FROM qa
"""

_ITEMS = f"""
{QA},
items AS (
  SELECT id, type, question, pred,
         CASE WHEN type = 'yn' THEN lower({strip('gold')}) ELSE gold END AS answer,
         {letter('question')} AS label, type AS dataset, 'rag' AS mode, 'clinician' AS role
  FROM qa
),
shorts AS (SELECT * FROM items WHERE type = 'short'),
{f1_cte('shorts', 'pred', 'answer')},
scores AS (
  SELECT id, dataset, mode, role, 'acc' AS metric,
         CASE WHEN {letter('pred')} = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
  FROM items WHERE type = 'mcq'
  UNION ALL
  SELECT id, dataset, mode, role, 'acc' AS metric,
         CASE WHEN {yn('pred')} = {_GOLD_YN.replace('@G@', 'answer')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  FROM items WHERE type = 'yn'
  UNION ALL
  SELECT i.id, dataset, mode, role, 'f1' AS metric, f1.f1 FROM shorts i JOIN f1 ON i.id = f1.id
  UNION ALL
  SELECT id, dataset, mode, role, 'em' AS metric,
         CASE WHEN {nans("coalesce(pred, '')")} = {nans("coalesce(answer, '')")} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  FROM shorts
),
runs AS (
  SELECT dataset, mode, role, count(DISTINCT id) AS n,
         avg(score) FILTER (WHERE metric = 'acc') AS acc, avg(score) FILTER (WHERE metric = 'f1') AS f1,
         avg(score) FILTER (WHERE metric = 'em') AS em, 1700000000::BIGINT AS timestamp
  FROM scores GROUP BY ALL
),
board AS (
  SELECT dataset AS "Dataset", mode AS "Mode", role AS "Role", n AS "N",
         CASE WHEN acc IS NULL THEN '-' ELSE printf('%.3f', acc) END AS "Acc",
         CASE WHEN f1 IS NULL THEN '-' ELSE printf('%.3f', f1) END AS "F1",
         CASE WHEN em IS NULL THEN '-' ELSE printf('%.3f', em) END AS "EM",
         strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M') AS "Timestamp"
  FROM runs
)
"""

Q["score_items"] = f"WITH {_ITEMS} SELECT id, metric, round(score, 6) AS score FROM scores"
Q["aggregate_metrics"] = f"""
WITH {_ITEMS} SELECT dataset, mode, role, metric, round(avg(score), 6) AS mean FROM scores GROUP BY ALL
"""
Q["run_result"] = f"""
WITH {_ITEMS}
SELECT dataset, mode, role, n, round(acc, 6) AS acc, round(f1, 6) AS f1, round(em, 6) AS em, timestamp FROM runs
"""
Q["leaderboard"] = f"WITH {_ITEMS} SELECT * FROM board"
_HEAD = ("# " + K.LEADERBOARD_TITLE + "\n\n| " + " | ".join(K.LEADERBOARD_HEADERS) + " |\n|"
         + "|".join(["---"] * len(K.LEADERBOARD_HEADERS)) + "|\n")
Q["leaderboard_markdown"] = f"""
WITH {_ITEMS}
SELECT {lit(_HEAD)} || coalesce(string_agg('| ' || concat_ws(' | ', "Dataset", "Mode", "Role", CAST("N" AS VARCHAR),
       "Acc", "F1", "EM", "Timestamp") || ' |', chr(10)
       ORDER BY "Dataset", "Mode", "Role", "N", "Acc", "F1", "EM", "Timestamp"), '') AS markdown
FROM board
"""

Q["vision_accuracy"] = """
WITH j AS (
  SELECT CASE WHEN (CASE WHEN l.toxic = 1 THEN '1.0' ELSE '0.0' END) = '1.0' THEN 1 ELSE 0 END AS y,
         CASE WHEN d.doc_id % 4 = 0 OR contains(lower(coalesce(d.text, '')), 'cardio') THEN 1 ELSE 0 END AS p
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)
SELECT count(*) AS n, round(coalesce(sum(CASE WHEN y = p THEN 1 ELSE 0 END), 0)::DOUBLE / greatest(1, count(*)), 6) AS acc
FROM j
"""


# --------------------------------------------------------------------------- interactions and roles

JS_WS = r"[\x{09}-\x{0d}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _values(rows) -> str:
    def v(x):
        if isinstance(x, str):
            return lit(x)
        if isinstance(x, list):
            return "[" + ", ".join(lit(e) for e in x) + "]"
        return str(x)
    return "VALUES " + ", ".join("(" + ", ".join(v(x) for x in r) + ")" for r in rows)


_LINE_ITEMS = """
  SELECT l_orderkey AS basket, l_linenumber AS pos,
         CASE WHEN l_linenumber % 2 = 0 THEN ' ' || upper(p_name) ELSE p_name END AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def _rule_ctes(rules: dict, items_sql: str = _LINE_ITEMS, baskets_sql: str = "SELECT o_orderkey AS basket FROM orders") -> str:
    syn = []
    for prio, (canon, syns) in enumerate(rules["synonyms"].items()):
        syn.append((canon, canon, prio))
        syn.extend((x, canon, prio) for x in syns)
    pairs = [(i, r["a"], r["b"], r["note"]) for i, r in enumerate(rules["pairs"])]
    crs = [(i, r["classA"], r["classB"], r["note"]) for i, r in enumerate(rules["classes"])]
    mem = [(m.lower(), c, cpos) for cpos, (c, ms) in enumerate(rules["class_members"].items()) for m in ms]
    return f"""
syn(name, canon, prio) AS ({_values(syn)}),
pr(rule, ra, rb, note) AS ({_values(pairs)}),
cr(rule, class_a, class_b, note) AS ({_values(crs)}),
cm(drug, class, class_pos) AS ({_values(mem)}),
items AS ({items_sql}),
allb AS ({baskets_sql}),
canon AS (
  SELECT basket, pos, coalesce(s.canon, i.n) AS drug
  FROM (SELECT basket, pos, lower({strip('name')}) AS n FROM items WHERE name IS NOT NULL AND name <> '') i
  LEFT JOIN (SELECT name, arg_min(canon, prio) AS canon FROM syn GROUP BY name) s ON s.name = i.n
),
pm AS (
  SELECT DISTINCT c1.basket, pr.ra || ' + ' || pr.rb || ': ' || pr.note AS msg
  FROM canon c1 JOIN canon c2 ON c1.basket = c2.basket AND c1.pos < c2.pos
  JOIN pr ON (c1.drug = pr.ra AND c2.drug = pr.rb) OR (c1.drug = pr.rb AND c2.drug = pr.ra)
),
dc AS (
  SELECT drug, string_agg(class, ',' ORDER BY class_pos) AS classes, list(class) AS cls
  FROM (SELECT DISTINCT drug, class, class_pos FROM cm) GROUP BY drug
),
cmsg AS (
  SELECT DISTINCT c1.basket,
         c1.drug || ' (class ' || d1.classes || ') + ' || c2.drug || ' (class ' || d2.classes || '): ' || cr.note AS msg
  FROM canon c1 JOIN canon c2 ON c1.basket = c2.basket AND c1.pos < c2.pos
  JOIN dc d1 ON d1.drug = c1.drug JOIN dc d2 ON d2.drug = c2.drug
  JOIN cr ON list_has_any(d1.cls, cr.class_a) AND list_has_any(d2.cls, cr.class_b)
),
allm AS (SELECT basket, msg FROM pm UNION SELECT basket, msg FROM cmsg),
checked AS (
  SELECT b.basket, count(m.msg)::BIGINT AS n_msgs,
         coalesce(string_agg(m.msg, chr(10) ORDER BY m.msg), '') AS messages,
         string_agg(m.msg, chr(10) || '- ' ORDER BY m.msg) AS joined
  FROM allb b LEFT JOIN allm m ON m.basket = b.basket GROUP BY b.basket
)
"""


_RULES = _rule_ctes(BASKET_RULES)

Q["parse_med_list"] = f"""
WITH o AS (SELECT o_orderkey, concat_ws(', ', o_orderstatus, ' ' || o_orderpriority, '') AS meds FROM orders),
l AS (
  SELECT o_orderkey, CASE WHEN meds IS NULL OR meds = '' THEN []::VARCHAR[]
         ELSE list_transform(string_split(meds, ','), lambda x: regexp_replace(x, '^@JSWS@+|@JSWS@+$', '', 'g')) END AS l
  FROM o
)
SELECT o_orderkey, array_to_string(l, '|') AS meds, len(l)::INTEGER AS n FROM l
"""

Q["canonical_name"] = f"WITH {_RULES} SELECT basket, pos, drug FROM canon"
Q["drug_classes"] = f"""
WITH {_RULES}
SELECT d.drug, coalesce(dc.classes, '') AS classes FROM (SELECT DISTINCT drug FROM canon) d JOIN dc ON d.drug = dc.drug
"""
Q["pair_rules"] = f"WITH {_RULES} SELECT basket, msg FROM pm"
Q["class_rules"] = f"WITH {_RULES} SELECT basket, msg FROM cmsg"
Q["check_interactions"] = f"WITH {_RULES} SELECT basket, n_msgs, messages FROM checked"
Q["append_findings"] = f"""
WITH {_RULES}
SELECT basket, 'Answer for order ' || CAST(basket AS VARCHAR)
       || CASE WHEN n_msgs > 0 THEN {lit(K.DDI_HEADER)} || joined ELSE '' END AS answer
FROM checked
"""

_ROLE = "(['patient', 'clinician', 'pharma', 'student', 'visitor'])[conv_id % 5 + 1]"
Q["disclaimer"] = f"""
SELECT conv_id, turn, {_ROLE} AS role,
       CASE WHEN {_ROLE} = 'patient' THEN {lit(K.DISCLAIMER_PATIENT)} ELSE {lit(K.DISCLAIMER_OTHER)} END AS disclaimer
FROM conversations
"""
Q["route"] = f"""
WITH r(route_role, use_rag, use_ddi) AS ({_values([(a, str(b).upper(), str(c).upper()) for a, b, c in K.ROUTING]).replace("'TRUE'", "TRUE").replace("'FALSE'", "FALSE")}),
c AS (SELECT conv_id, turn, {_ROLE} AS role FROM conversations)
SELECT conv_id, turn, role, coalesce(use_rag, TRUE) AS use_rag, coalesce(use_ddi, FALSE) AS use_ddi
FROM c LEFT JOIN r ON c.role = r.route_role
"""

_MEDS = "[" + ", ".join(lit(m) for m in MED_LISTS) + "]"
_REQ = f"""
  SELECT o_orderkey AS query_id, (['patient', 'clinician', 'pharma', 'student', 'visitor'])[o_orderkey % 5 + 1] AS role,
         ({_MEDS})[o_orderkey % {len(MED_LISTS)} + 1] AS drugs
  FROM orders
"""
_REQ_ITEMS = f"""
  SELECT query_id AS basket, generate_subscripts(l, 1) AS pos, unnest(l) AS name FROM (
    SELECT query_id, CASE WHEN drugs IS NULL OR drugs = '' THEN []::VARCHAR[]
           ELSE list_transform(string_split(drugs, ','), lambda x: regexp_replace(x, '^@JSWS@+|@JSWS@+$', '', 'g')) END AS l
    FROM ({_REQ}))
"""
Q["stream_requests"] = f"""
WITH {_rule_ctes(K.DDI_RULES, _REQ_ITEMS, "SELECT query_id AS basket FROM (" + _REQ + ")")},
r(route_role, use_rag, use_ddi) AS ({_values([(a, str(b).upper(), str(c).upper()) for a, b, c in K.ROUTING]).replace("'TRUE'", "TRUE").replace("'FALSE'", "FALSE")}),
req AS ({_REQ}),
rr AS (SELECT req.*, coalesce(use_rag, TRUE) AS use_rag, coalesce(use_ddi, FALSE) AS use_ddi FROM req LEFT JOIN r ON req.role = r.route_role)
SELECT rr.query_id, rr.role, rr.use_rag, rr.use_ddi,
       CASE WHEN rr.use_ddi THEN c.n_msgs ELSE 0 END::BIGINT AS n_ddi,
       CASE WHEN rr.use_ddi THEN c.messages ELSE '' END AS ddi,
       CASE WHEN rr.role = 'patient' THEN {lit(K.DISCLAIMER_PATIENT)} ELSE {lit(K.DISCLAIMER_OTHER)} END AS disclaimer
FROM rr JOIN checked c ON c.basket = rr.query_id
"""

Q["bmi"] = """
SELECT p_partkey, round((p_retailprice / 10.0::DOUBLE) /
       (nullif(p_size::DOUBLE / 20.0::DOUBLE, 0.0::DOUBLE) * nullif(p_size::DOUBLE / 20.0::DOUBLE, 0.0::DOUBLE)), 6) AS bmi
FROM part
"""
_SRC_NAMES = "[" + ", ".join(lit(s) for _, s, _ in K.DATA_SOURCES) + "]"
_SRC_ON = "(" + ", ".join(lit(s) for _, s, e in K.DATA_SOURCES if e) + ")"
Q["enabled_sources"] = f"""
SELECT doc_id, source FROM (
  SELECT doc_id, ({_SRC_NAMES})[CAST(substr(source, 4, 10) AS INTEGER) % {len(K.DATA_SOURCES)} + 1] AS source FROM documents)
WHERE source IN {_SRC_ON}
"""


# --------------------------------------------------------------------------- retrieval
_RET = f"""
raw AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
idx AS (
  SELECT vec_id AS id, label, CASE WHEN ss > 0 THEN list_transform(v, lambda x: x / sqrt(ss)) ELSE v END AS v
  FROM (SELECT vec_id, label, v, list_reduce(list_prepend(0.0::DOUBLE, list_transform(v, lambda x: x * x)), lambda a, b: a + b) AS ss FROM raw)
),
comp AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM idx),
cen AS (SELECT label, list(m ORDER BY pos) AS q FROM (SELECT label, pos, avg(x) AS m FROM comp GROUP BY label, pos) GROUP BY label),
qs AS (
  SELECT label::BIGINT AS query_id, CASE WHEN ss > 0 THEN list_transform(q, lambda x: x / sqrt(ss)) ELSE q END AS q
  FROM (SELECT label, q, list_reduce(list_prepend(0.0::DOUBLE, list_transform(q, lambda x: x * x)), lambda a, b: a + b) AS ss FROM cen)
),
sc AS (SELECT query_id, id, list_dot_product(q, v) AS score FROM qs, idx),
hits AS (
  SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id ASC) AS rank FROM sc)
  WHERE rank <= 5
),
store AS (
  SELECT e.vec_id AS id, d.text, d.source, {license_('d.source')} AS license
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id
),
hm AS (SELECT h.query_id, h.rank, h.id, h.score, s.text, s.source, s.license FROM hits h JOIN store s ON h.id = s.id),
ev AS (
  SELECT query_id, string_agg('[' || CAST(rank AS VARCHAR) || '] (' || coalesce(source, 'unknown') || ') '
                              || substr(coalesce(text, ''), 1, 800), chr(10) ORDER BY rank) AS evidence,
         string_agg('[' || coalesce(source, 'unknown') || '] score=' || printf('%.3f', score), ' | ' ORDER BY rank) AS citations
  FROM hm GROUP BY query_id
),
req AS (SELECT query_id, 'Which passages resemble group ' || CAST(query_id AS VARCHAR) || '? (100% sure)' AS query FROM qs)
"""

Q["l2_normalize"] = f"""
WITH {_RET}
SELECT id AS vec_id, len(v)::INTEGER AS dim,
       round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(v, lambda x: x * x)), lambda a, b: a + b), 6) AS sum_sq,
       round(list_reduce(list_prepend(0.0::DOUBLE, v), lambda a, b: a + b), 6) AS sum_v
FROM idx
"""
Q["knn_topk"] = f"WITH {_RET} SELECT query_id, rank, id, round(score, 6) AS score FROM hits"
Q["knn_all_queries"] = Q["knn_pruned"] = """
WITH idx AS (
  SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings
), scored AS (
  SELECT q.id AS query_id, d.id, list_inner_product(q.v, d.v) AS s FROM idx q, idx d WHERE q.id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank, id, round(s, 6) AS score
FROM scored QUALIFY rank <= 5
"""
Q["hit_metadata"] = f"""
WITH {_RET} SELECT query_id, rank, id, coalesce(source, 'unknown') AS source, license, length(text) AS text_len FROM hm
"""
Q["evidence_block"] = f"WITH {_RET} SELECT query_id, evidence FROM ev"
Q["format_citations"] = f"WITH {_RET} SELECT query_id, citations FROM ev"
Q["build_prompt"] = f"""
WITH {_RET}
SELECT r.query_id, {lit(K.PROMPT_TEMPLATE_HEAD)} || r.query || {lit(K.PROMPT_TEMPLATE_MID)}
       || coalesce(ev.evidence, {lit(K.NO_HIT_EVIDENCE)}) || {lit(K.PROMPT_TEMPLATE_TAIL)} AS prompt
FROM req r LEFT JOIN ev ON r.query_id = ev.query_id
"""
Q["answer_batch"] = f"""
WITH {_RET}
SELECT r.query_id, 'clinician' AS role, 'Answer to: ' || r.query AS answer, coalesce(ev.citations, '') AS citations,
       0::BIGINT AS n_ddi, {lit(K.DISCLAIMER_OTHER)} AS disclaimer
FROM req r LEFT JOIN ev ON r.query_id = ev.query_id
"""


# --------------------------------------------------------------------------- labelling


def _vocab_values(rows) -> str:
    pos: dict[str, int] = {}
    out = []
    for system, term, codes in rows:
        out.append((system, pos.get(system, 0), term, codes))
        pos[system] = pos.get(system, 0) + 1
    return _values(out)


_FUZZY = f"""
v(system, pos, term, codes) AS ({_vocab_values(FUZZY_VOCAB)}),
t AS (SELECT p_partkey AS id, p_name AS text FROM part),
c AS (
  SELECT t.id, v.system, v.pos, v.term, v.codes, greatest(length(t.text), length(v.term)) AS L,
         levenshtein(t.text, v.term) AS d
  FROM t, v WHERE t.text IS NOT NULL AND length(t.text) > 0 AND length(v.term) > 0
),
s AS (SELECT id, system, pos, term, codes, (L - d) * 100.0::DOUBLE / L AS score FROM c WHERE (L - d) * 100 >= L * 86),
r AS (SELECT *, row_number() OVER (PARTITION BY id, system ORDER BY score DESC, pos ASC) AS rank FROM s),
top AS (SELECT * FROM r WHERE rank <= 3),
codes AS (
  SELECT id, system, array_to_string(list_sort(list_distinct(flatten(list(codes)))), ',') AS codes FROM top GROUP BY id, system
)
"""

Q["fuzzy_topk"] = f"WITH {_FUZZY} SELECT id, system, pos, term, round(score, 6) AS score, rank FROM top"
for _sys in ("icd10", "snomed", "rxnorm", "meddra"):
    Q[f"map_{_sys}"] = f"""
WITH {_FUZZY}
SELECT t.id, coalesce(c.codes, '') AS codes FROM t LEFT JOIN codes c ON c.id = t.id AND c.system = '{_sys}'
"""

Q["auto_label"] = f"""
WITH {_FUZZY}
SELECT 'part_' || CAST(p.p_partkey AS VARCHAR) AS id, p.p_name AS text,
       CASE WHEN p.p_size % 4 = 0 THEN 'KEEP' WHEN p.p_name IS NOT NULL AND length(p.p_name) > 0 THEN coalesce(ci.codes, '') END AS labels_icd10,
       CASE WHEN p.p_name IS NOT NULL AND length(p.p_name) > 0 THEN coalesce(cs.codes, '') END AS labels_snomed
FROM part p
LEFT JOIN codes ci ON ci.id = p.p_partkey AND ci.system = 'icd10'
LEFT JOIN codes cs ON cs.id = p.p_partkey AND cs.system = 'snomed'
"""

_PHRASE = f"regexp_replace({dproc('@X@')}, ' +', ' ', 'g')"
Q["link_phrases"] = f"""
WITH v0(system, pos, term, codes) AS ({_vocab_values(PHRASE_VOCAB)}),
v AS (SELECT {_PHRASE.replace('@X@', 'term')} AS phrase, codes FROM v0),
w AS (
  SELECT doc_id, list_filter(string_split({_PHRASE.replace('@X@', 'text')}, ' '), lambda x: length(x) > 0) AS w
  FROM documents
),
g AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i])) AS phrase FROM w
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) FROM w
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) FROM w
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w) - 2),
                                  lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3])) FROM w
),
u AS (SELECT phrase, flatten(list(codes)) AS codes FROM v GROUP BY phrase),
h AS (SELECT g.doc_id, u.codes FROM g JOIN u ON g.phrase = u.phrase),
m AS (
  SELECT doc_id, array_to_string(list_sort(list_distinct(flatten(list(codes)))), ',') AS codes, count(*) AS n_mentions
  FROM h GROUP BY doc_id
)
SELECT d.doc_id, coalesce(m.codes, '') AS codes, coalesce(m.n_mentions, 0) AS n_mentions FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id
"""


# --------------------------------------------------------------------------- payload -> record
def mint(prefix: str, *keys: str) -> str:
    k = keys[0] if len(keys) == 1 else "concat_ws(chr(1), " + ", ".join(keys) + ")"
    return f"'{prefix}_' || substr(md5({k}), 1, 16)"


Q["flatten_pubmed"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS pmid, 'Order ' || CAST(o_orderkey AS VARCHAR) || ' status ' || o_orderstatus AS title,
       strftime(o_orderdate, '%Y %b %d') AS pubdate, o_orderpriority || ',clerk' AS authors,
       'Journal of ' || o_orderstatus AS journal, 'pubmed_esummary' AS source
FROM orders WHERE o_orderkey % 7 <> 0
"""

Q["flatten_trials"] = f"""
WITH f AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS conds FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o.*, 'NCT' || CAST(o_orderkey AS VARCHAR) AS nct, f.conds FROM orders o LEFT JOIN f ON f.l_orderkey = o.o_orderkey)
SELECT {mint('ct', 'nct')} AS id,
       'Trial ' || CAST(o_orderkey AS VARCHAR) || ' (' || nct || '). Conditions=' || coalesce(conds, '') || '. Status='
       || o_orderstatus || '. Summary: ' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS text,
       'summarize' AS task, NULL::VARCHAR AS image_path, NULL::VARCHAR AS answer,
       'clinicaltrials' AS source, 'public-domain' AS license, nct
FROM o
"""

Q["flatten_labels"] = f"""
SELECT {mint('openfda', "'spl-' || CAST(p_partkey AS VARCHAR)")} AS id,
       'Label for ' || CASE WHEN p_size % 7 = 0 THEN 'unknown' WHEN p_size % 3 = 0 THEN p_name ELSE p_brand END
       || '. Indications: ' || p_name || '. Boxed warning: ' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END
       || '. Adverse reactions: size ' || CAST(p_size AS VARCHAR) AS text,
       'summarize' AS task, NULL::VARCHAR AS image_path, NULL::VARCHAR AS answer,
       'openfda' AS source, 'public-domain' AS license, 'spl-' || CAST(p_partkey AS VARCHAR) AS spl_set_id
FROM part
"""

Q["flatten_spl"] = f"""
WITH s AS (
  SELECT l_orderkey, l_linenumber // 8 AS blk, l_linenumber,
         (['34067-9', '34067-9 Indications & Usage', '34073-7', '34073-7', 'other'])[l_linenumber % 5 + 1] AS code,
         repeat('line ' || CAST(l_linenumber AS VARCHAR) || ' qty ' || CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR)
                || '; ', CAST(trunc(l_quantity) AS INTEGER)) AS text
  FROM lineitem
),
d AS (
  SELECT l_orderkey, blk, 'SPL ' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(blk AS VARCHAR) AS title,
         arg_max(text, struct_pack(ln := l_linenumber, t := text)) FILTER (WHERE code = '34067-9') AS i1,
         arg_max(text, struct_pack(ln := l_linenumber, t := text)) FILTER (WHERE code = '34067-9 Indications & Usage') AS i2,
         arg_max(text, struct_pack(ln := l_linenumber, t := text)) FILTER (WHERE code = '34073-7') AS x
  FROM s GROUP BY l_orderkey, blk
)
SELECT {mint('dailymed', 'title', 'md5(text)')} AS id, text,
       'ddi' AS task, NULL::VARCHAR AS image_path, NULL::VARCHAR AS answer, 'dailymed' AS source, 'public-domain' AS license
FROM (SELECT title, title || '. Indications: ' || substr(coalesce(nullif(i1, ''), nullif(i2, ''), ''), 1, 600)
             || '. Interactions: ' || substr(coalesce(nullif(x, ''), ''), 1, 600) AS text FROM d)
"""

Q["flatten_chexpert"] = f"""
WITH r AS (
  SELECT 'patient' || CAST(doc_id AS VARCHAR) || '\\study1\\view1_frontal.jpg' AS path,
         CASE WHEN toxic = 1 THEN '1.0' WHEN quality = 0 THEN '-1.0' ELSE '' END AS c
  FROM labels
)
SELECT {mint('chexpert', 'path')} AS id, NULL::VARCHAR AS text, 'classification' AS task,
       replace('/data/chexpert/' || path, '\\', '/') AS image_path,
       CASE WHEN c = '1.0' THEN 'Cardiomegaly' ELSE 'No cardiomegaly' END AS answer,
       'chexpert' AS source, 'custom' AS license
FROM r
"""

Q["flatten_isic_csv"] = f"""
WITH r AS (
  SELECT 'ISIC_' || CAST(p_partkey AS VARCHAR) AS isic_id,
         CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name || '.jpg' END AS file_name,
         CASE WHEN p_size % 5 = 0 THEN 'img' || CAST(p_partkey AS VARCHAR) || '.png' END AS image,
         CASE WHEN p_size % 4 = 0 THEN 'n' || CAST(p_partkey AS VARCHAR) END AS name,
         CASE WHEN p_size % 2 = 0 THEN p_type END AS diagnosis_3, p_brand AS diagnosis
  FROM part
), f AS (
  SELECT *, coalesce(nullif(file_name, ''), nullif(image, ''), nullif(name, '')) AS fn FROM r
)
SELECT {mint('isic', 'isic_id', 'fn')} AS id, NULL::VARCHAR AS text, 'classification' AS task,
       'data/images/isic/' || fn AS image_path, coalesce(nullif(diagnosis_3, ''), nullif(diagnosis, '')) AS answer,
       'isic_cli' AS source, 'CC-BY' AS license, isic_id
FROM f WHERE fn IS NOT NULL
"""

Q["flatten_ham10000"] = f"""
WITH inv AS (SELECT DISTINCT 'ISIC_' || CAST(l_partkey AS VARCHAR) || '.jpg' AS f FROM lineitem),
m AS (SELECT *, 'ISIC_' || CAST(p_partkey AS VARCHAR) || '.jpg' AS f FROM part)
SELECT {mint('isic', 'm.f')} AS id, NULL::VARCHAR AS text, 'classification' AS task,
       'data/images/isic/' || m.f AS image_path, p_type AS answer, 'isic_ham10000' AS source, 'CC-BY' AS license,
       CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST(trunc(p_size * 1.5) AS INTEGER) END AS age,
       p_brand AS sex, p_name AS site
FROM m WHERE m.f IN (SELECT f FROM inv)
"""

Q["group_subject_modalities"] = f"""
WITH f AS (
  SELECT l_orderkey, (['flair', 't1ce', 't1', 't2', 'seg'])[l_linenumber % 5 + 1] AS mod FROM lineitem
),
g AS (
  SELECT l_orderkey, 'cases/subj' || CAST(l_orderkey AS VARCHAR) AS folder, 'subj' || CAST(l_orderkey AS VARCHAR) AS subject,
         bool_or(mod = 'flair') AS has_flair, bool_or(mod = 't1ce') AS has_t1ce, bool_or(mod = 't1') AS has_t1,
         bool_or(mod = 't2') AS has_t2
  FROM f GROUP BY l_orderkey
), h AS (
  SELECT *, list_filter(['flair', 't1ce', 't1', 't2'], lambda m: (m = 'flair' AND has_flair) OR (m = 't1ce' AND has_t1ce)
                        OR (m = 't1' AND has_t1) OR (m = 't2' AND has_t2)) AS mods FROM g
)
SELECT {mint('brats', 'folder')} AS id,
       CASE WHEN len(mods) >= 2 THEN '/out/png/' || subject || '_composite.png'
            ELSE '/out/png/' || subject || '_' || mods[1] || '.png' END AS image_path,
       array_to_string(mods, ',') AS modalities,
       CASE WHEN has_flair THEN folder || '/' || subject || '_flair.nii.gz' END AS src_flair,
       CASE WHEN has_t1ce THEN folder || '/' || subject || '_t1ce.nii.gz' END AS src_t1ce,
       CASE WHEN has_t1 THEN folder || '/' || subject || '_t1.nii.gz' END AS src_t1,
       CASE WHEN has_t2 THEN folder || '/' || subject || '_t2.nii.gz' END AS src_t2
FROM h WHERE len(mods) > 0
"""

Q["mint_id"] = f"SELECT doc_id, {mint('doc', 'CAST(doc_id AS VARCHAR)')} AS id FROM documents"


# --------------------------------------------------------------------------- sources and sinks
_CTL = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]"

Q["read_jsonl"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
Q["read_jsonl_dirs"] = """
SELECT doc_id, text, source FROM documents
UNION ALL SELECT item_id AS doc_id, text, 'benchmark' AS source FROM benchmark
"""
Q["read_csv_records"] = """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || ', "quoted"' || chr(10) || 'second line' AS p_name, p_brand,
       CAST(p_size AS VARCHAR) AS p_size
FROM part
"""
Q["parse_json_tolerant"] = f"""
WITH e AS (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN regexp_replace(props, '}}$', '')
                        WHEN event_id % 5 = 0 THEN replace(props, '"k":', '"k":' || chr(1)) ELSE props END AS raw
  FROM events
), c AS (SELECT event_id, raw, regexp_replace(raw, '{_CTL}', '', 'g') AS cl FROM e)
SELECT event_id,
       CASE WHEN json_valid(raw) THEN json_extract(raw, '$.k')::BIGINT WHEN json_valid(cl) THEN json_extract(cl, '$.k')::BIGINT END AS k,
       CASE WHEN json_valid(raw) THEN 'ok' WHEN json_valid(cl) THEN 'cleaned' ELSE 'failed' END AS status
FROM c
"""
Q["triage_responses"] = f"""
WITH p AS (
  SELECT page_id, ([200, 404, 503, 200, 429, 301, 500])[page_id % 7 + 1] AS status,
         (['application/json', 'text/html; charset=utf-8', 'application/json; charset=utf-8', 'text/plain',
           'application/xml', 'APPLICATION/JSON'])[page_id % 6 + 1] AS content_type,
         CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN json_object('page_id', page_id, 'url', url)::VARCHAR
              WHEN 2 THEN ' ' || chr(10) || html ELSE '{{"url": "' || CAST(page_id AS VARCHAR) || '"' END AS body
  FROM pages
), f AS (
  SELECT page_id, status, lower(content_type) AS ct, json_valid(body) AS strict_ok,
         json_valid(body) OR json_valid(regexp_replace(body, '{_CTL}', '', 'g')) AS tol,
         starts_with(regexp_replace(body, '^@WS@+', ''), '<') AS lt
  FROM p
), r AS (
  SELECT page_id, status,
         CASE WHEN status IN (429, 500, 502, 503, 504) THEN 'server_status'
              WHEN contains(ct, 'text/html') OR contains(ct, 'xml') THEN 'non_json_type'
              WHEN contains(ct, 'application/json') THEN
                   CASE WHEN strict_ok THEN 'ok' WHEN lt THEN 'html_as_json' WHEN tol THEN 'ok' ELSE 'unparseable' END
              WHEN status >= 400 THEN 'http_error'
              WHEN tol THEN 'ok' ELSE 'unparseable' END AS reason
  FROM f
)
SELECT page_id, status, reason, CASE WHEN reason = 'ok' THEN 'ok' ELSE 'retry' END AS action FROM r
"""
Q["ingest_cap"] = "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100"
_HTML_PRE = (f"<html lang=en><title>{K.LEADERBOARD_HTML_TITLE}</title><main><h2>{K.LEADERBOARD_TITLE}</h2><table rules=rows><tr>"
             + "".join(f"<th>{h}</th>" for h in K.LEADERBOARD_HEADERS) + "</tr>\n")
_HTML_POST = "\n</table></main></html>"
Q["leaderboard_html"] = f"""
WITH {_ITEMS}
SELECT {lit(_HTML_PRE)} || coalesce(string_agg('<tr>' || '<td>' || "Dataset" || '</td><td>' || "Mode" || '</td><td>' || "Role"
       || '</td><td>' || CAST("N" AS VARCHAR) || '</td><td>' || "Acc" || '</td><td>' || "F1" || '</td><td>' || "EM"
       || '</td><td>' || "Timestamp" || '</td>' || '</tr>', chr(10)
       ORDER BY "Dataset", "Mode", "Role", "N", "Acc", "F1", "EM", "Timestamp"), '') || {lit(_HTML_POST)} AS html
FROM board
"""


# --------------------------------------------------------------------------- tokenizer, splits, numerics
_LINES = "l AS (SELECT doc_id, replace(text, chr(10), ' ') AS line FROM documents WHERE text IS NOT NULL AND length(text) > 0)"
_WF = f"""{_LINES},
wf AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split({norm('line')}, ' ')) AS word FROM l)
       WHERE length(word) > 0 GROUP BY word)"""

Q["tokenizer_lines"] = f"WITH {_LINES} SELECT doc_id, line FROM l"
Q["word_frequency"] = f"WITH {_WF} SELECT word, n FROM wf"
Q["char_coverage"] = f"""
WITH {_LINES},
c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(line, '')) AS ch FROM l) WHERE length(ch) > 0 GROUP BY ch),
r AS (
  SELECT ch, n, sum(n) OVER () AS total,
         coalesce(sum(n) OVER (ORDER BY n DESC, ch ASC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         row_number() OVER (ORDER BY n DESC, ch ASC) AS rank
  FROM c
)
SELECT ch, n, rank FROM r WHERE before * 1000000 < total * 999500
"""
Q["bpe_pair_counts"] = f"""
WITH {_WF},
sy AS (SELECT string_split(word, '') AS s, n FROM wf),
p AS (SELECT unnest(list_transform(range(1, len(s)), lambda i: s[i])) AS a,
             unnest(list_transform(range(1, len(s)), lambda i: s[i+1])) AS b, n FROM sy)
SELECT a, b, sum(n)::BIGINT AS c FROM p GROUP BY a, b
"""
Q["sample_shuffled"] = f"""
WITH {_LINES} SELECT doc_id FROM l ORDER BY md5('1337:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 300
"""
Q["limit_rows"] = f"WITH {_LINES} SELECT doc_id, line FROM l ORDER BY doc_id LIMIT 50"
Q["split_stratified"] = f"""
WITH d AS (
  SELECT d.doc_id, d.source, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source, quality ORDER BY {UNIFORM.replace('@X@', 'doc_id')}, doc_id) AS rn,
         count(*) OVER (PARTITION BY source, quality) AS n
  FROM d
)
SELECT doc_id, source, quality,
       CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train'
            WHEN rn <= floor(n * (0.8::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS split
FROM r
"""
Q["center_slice"] = """
WITH v AS (
  SELECT l_orderkey AS subject, l_partkey % 7 AS x, l_suppkey % 5 AS y, l_linenumber - 1 AS z, l_extendedprice AS v
  FROM lineitem
), nz AS (SELECT subject, max(z) + 1 AS nz FROM v GROUP BY subject)
SELECT v.subject, x, y, z, v FROM v JOIN nz ON v.subject = nz.subject WHERE z = floor(nz / 2)
"""
Q["robust_scale"] = """
WITH p AS (
  SELECT event_type, quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY event_type
)
SELECT event_id,
       CAST(trunc(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (value - p1) / (p99 - p1 + 0.000001::DOUBLE))) * 255) AS INTEGER) AS u8
FROM events e JOIN p ON e.event_type = p.event_type
"""
Q["composite_offsets"] = """
WITH s AS (
  SELECT l_orderkey AS subject, l_linenumber AS modality_pos, min(CAST(trunc(l_quantity) AS BIGINT)) AS width,
         min(CAST(trunc(l_extendedprice / 100) AS BIGINT)) AS height
  FROM lineitem GROUP BY ALL
)
SELECT subject, modality_pos, width,
       coalesce(sum(width) OVER (PARTITION BY subject ORDER BY modality_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x_offset,
       min(height) OVER (PARTITION BY subject) AS crop_height
FROM s
"""


# --------------------------------------------------------------------------- streaming
Q["stream_ingest"] = f"""
SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS id, 'text' AS modality, 'summarize' AS task,
       CASE WHEN text IS NOT NULL AND length(text) > 0 THEN {norm('text')} ELSE text END AS text,
       NULL::VARCHAR AS image_path, NULL::VARCHAR AS answer, NULL::VARCHAR AS rationale,
       CASE WHEN text IS NOT NULL AND length(text) > 0 THEN '' END AS labels_icd10,
       CASE WHEN text IS NOT NULL AND length(text) > 0 THEN '' END AS labels_snomed,
       source, {license_('source')} AS license, 'train' AS split
FROM documents
"""
for _name in ("landed_pages", "stream_landed_pages"):
    Q[_name] = "SELECT doc_id, 'ok' AS status, md5(text) AS text_md5, source FROM documents"
Q["stream_first_wins"] = """
WITH RECURSIVE e AS (
  SELECT user_id, event_type, event_id, value, ts FROM events WHERE ts IS NOT NULL
), starts AS (
  SELECT user_id, event_type, min(ts) AS t0 FROM e GROUP BY ALL
  UNION ALL
  SELECT s.user_id, s.event_type, (SELECT min(e.ts) FROM e WHERE e.user_id IS NOT DISTINCT FROM s.user_id AND e.event_type IS NOT DISTINCT FROM s.event_type
                                   AND e.ts >= s.t0 + INTERVAL 6 HOURS) AS t0
  FROM starts s WHERE s.t0 IS NOT NULL
)
SELECT e.user_id, e.event_type, e.event_id
FROM starts s JOIN e ON e.user_id IS NOT DISTINCT FROM s.user_id AND e.event_type IS NOT DISTINCT FROM s.event_type
  AND e.ts >= s.t0 AND e.ts < s.t0 + INTERVAL 6 HOURS
WHERE s.t0 + INTERVAL 6 HOURS <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM e)
QUALIFY row_number() OVER (PARTITION BY s.user_id, s.event_type, s.t0 ORDER BY e.value IS NULL, e.value, e.ts) = 1
"""
Q["stream_dedup"] = "SELECT DISTINCT user_id, event_type FROM events"
Q["stream_counts"] = """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL
"""


Q["join_image_path"] = """
SELECT page_id, 'data/images/' || regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS image_path FROM pages
"""


Q["encode_text"] = f"""
WITH w AS (
  SELECT doc_id, unnest(string_split({dproc('text')}, ' ')) AS w FROM documents
), s AS (
  SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS slot,
         sum(CASE WHEN ('0x' || substr(md5(w), 9, 1))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x
  FROM w WHERE length(w) > 0 GROUP BY ALL
)
SELECT d.doc_id, 256 AS dim, coalesce(CAST(sum(abs(s.x)) AS BIGINT), 0) AS l1,
       coalesce(CAST(sum(s.x * (s.slot + 1)) AS BIGINT), 0) AS probe
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


Q["build_retrieval_table"] = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN text IS NOT NULL AND length(text) > 0 THEN {norm('text')} ELSE text END AS t, source
  FROM documents
), p AS (
  SELECT doc_id, t, source, unnest(range(0, (length(t) + 1999) // 2000)) AS passage_no FROM d WHERE t IS NOT NULL AND length(t) > 0
), n AS (SELECT doc_id, passage_no, substr(t, 1 + 2000 * passage_no, 2000) AS t, source FROM p),
w AS (SELECT doc_id, passage_no, unnest(string_split({dproc('t')}, ' ')) AS w FROM n),
s AS (
  SELECT doc_id, passage_no, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS slot,
         sum(CASE WHEN ('0x' || substr(md5(w), 9, 1))::INTEGER % 2 = 0 THEN 1 ELSE -1 END) AS x
  FROM w WHERE length(w) > 0 GROUP BY ALL
), nz AS (SELECT doc_id, passage_no, bool_or(x <> 0) AS nonzero, sum(x * (slot + 1)) / sqrt(sum(x * x)) AS probe FROM s GROUP BY ALL)
SELECT n.doc_id, n.passage_no::INTEGER AS passage_no, length(n.t) AS text_len, n.source, {license_('n.source')} AS license, 256 AS dim,
       CASE WHEN coalesce(nz.nonzero, FALSE) THEN 1.0 ELSE 0.0 END::DOUBLE AS sum_sq,
       CASE WHEN coalesce(nz.nonzero, FALSE) THEN round(nz.probe, 6) ELSE 0.0 END::DOUBLE AS probe
FROM n LEFT JOIN nz ON nz.doc_id = n.doc_id AND nz.passage_no = n.passage_no
"""


# --------------------------------------------------------------------------- sinks read back, files, maps
Q["write_jsonl"] = "SELECT doc_id, text, TRUE AS null_kept FROM documents"
_TYPE_MAP = """
SELECT (row_number() OVER (ORDER BY p_type) - 1)::INTEGER AS pos, p_type AS key,
       array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS value
FROM part GROUP BY p_type
"""
Q["read_json_map"] = _TYPE_MAP
Q["load_vocab"] = f"""
SELECT 'types' AS system, pos, key AS term, value AS codes FROM ({_TYPE_MAP})
UNION ALL
SELECT 'nations', (row_number() OVER (ORDER BY n_name) - 1)::INTEGER, n_name, n_regionkey::VARCHAR FROM nation
"""
Q["read_results"] = Q["run_result"]
_PNG = "'n' || s_nationkey || '/sup_' || s_suppkey || CASE WHEN s_suppkey % 5 = 0 THEN '.PNG' ELSE '.png' END"
Q["list_files"] = f"SELECT {_PNG} AS path, split_part({_PNG}, '/', 2) AS name FROM supplier"
Q["flatten_isic_files"] = f"""
SELECT {mint('isic', "'img/' || " + _PNG)} AS id, NULL::VARCHAR AS text, 'classification' AS task, 'img/' || {_PNG} AS image_path,
       NULL::VARCHAR AS answer, 'isic_cli' AS source, 'CC-BY' AS license
FROM supplier
"""
Q["image_min_resolution"] = f"""
SELECT {_PNG} AS path, (200 + s_suppkey % 120)::INTEGER AS width, (230 + s_suppkey % 60)::INTEGER AS height,
       200 + s_suppkey % 120 >= 256 AND 230 + s_suppkey % 60 >= 256 AS ok
FROM supplier WHERE s_suppkey % 7 <> 0
"""
Q["write_retrieval_table"] = f"SELECT doc_id, passage_no, text_len, source, license FROM ({Q['build_retrieval_table']})"
Q["write_tokenizer_corpus"] = f"WITH {_LINES} SELECT line FROM l"
Q["write_splits"] = f"SELECT doc_id, source, {split_('doc_id')} AS split FROM documents"
Q["no_hit_fallback"] = f"""
SELECT q.query_id, coalesce(e.evidence, 'No relevant passages were retrieved.') AS evidence
FROM (SELECT DISTINCT (o_orderkey % 25)::INTEGER AS query_id FROM orders) q LEFT JOIN ({Q['evidence_block']}) e ON e.query_id = q.query_id
"""


# --------------------------------------------------------------------------- composed paths
_SORTED = "array_to_string(list_sort(list_filter(string_split(" + dproc("@X@") + ", ' '), lambda x: length(x) > 0)), ' ')"
Q["fuzzy_token_sort"] = f"""
WITH v0(system, pos, term, codes) AS ({_vocab_values(FUZZY_VOCAB)}),
v AS (SELECT system, pos, term, {_SORTED.replace('@X@', 'term')} AS s FROM v0 WHERE length(term) > 0),
t AS (SELECT p_partkey AS id, {_SORTED.replace('@X@', 'p_name')} AS s FROM part WHERE p_name IS NOT NULL AND length(p_name) > 0),
c AS (SELECT t.id, v.system, v.pos, v.term, greatest(length(t.s), length(v.s)) AS L, levenshtein(t.s, v.s) AS d FROM t, v
      WHERE length(t.s) > 0 AND length(v.s) > 0),
s AS (SELECT id, system, pos, term, (L - d) * 100.0::DOUBLE / L AS score FROM c WHERE (L - d) * 100 >= L * 86)
SELECT id, system, pos, term, round(score, 6) AS score, row_number() OVER (PARTITION BY id, system ORDER BY score DESC, pos ASC) AS rank
FROM s QUALIFY rank <= 3
"""
_BAG = f"""
  SELECT key, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS slot,
         sum(CASE WHEN ('0x' || substr(md5(w), 9, 1))::INTEGER % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x
  FROM (SELECT key, unnest(string_split({dproc('t')}, ' ')) AS w FROM @SRC@) WHERE length(w) > 0 GROUP BY ALL
"""
Q["search_text"] = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN text IS NOT NULL AND length(text) > 0 THEN {norm('text')} ELSE text END AS t FROM documents
), pn AS (SELECT doc_id, t, unnest(range(0, (length(t) + 1999) // 2000)) AS n FROM d WHERE t IS NOT NULL AND length(t) > 0),
p AS (SELECT doc_id * 1000000 + n AS key, substr(t, 1 + 2000 * n, 2000) AS t FROM pn),
q AS (SELECT item_id AS key, text AS t FROM benchmark),
ps AS ({_BAG.replace('@SRC@', 'p')}), qs AS ({_BAG.replace('@SRC@', 'q')}),
pl AS (SELECT key, sqrt(sum(x * x)) AS len FROM ps GROUP BY key), ql AS (SELECT key, sqrt(sum(x * x)) AS len FROM qs GROUP BY key),
dots AS (SELECT qs.key AS query_id, ps.key AS id, sum(qs.x * ps.x) AS dot FROM qs JOIN ps ON qs.slot = ps.slot GROUP BY ALL),
s AS (
  SELECT q.key AS query_id, p.key AS id, coalesce(dot / (ql.len * pl.len), 0.0) AS score
  FROM q CROSS JOIN p LEFT JOIN dots ON dots.query_id = q.key AND dots.id = p.key
  LEFT JOIN ql ON ql.key = q.key LEFT JOIN pl ON pl.key = p.key
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 5
"""
_TYPED = f"""
  SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'patient' ELSE 'clinician' END AS role, text AS query,
         ({_MEDS})[item_id % {len(MED_LISTS)} + 1] AS drugs
  FROM benchmark
"""
_TYPED_ITEMS = _REQ_ITEMS.replace(_REQ, _TYPED)
Q["answer_requests"] = f"""
WITH {_rule_ctes(K.DDI_RULES, _TYPED_ITEMS, "SELECT query_id AS basket FROM (" + _TYPED + ")")},
req AS ({_TYPED})
SELECT req.query_id, req.role,
       'Answer: ' || req.query || CASE WHEN c.n_msgs > 0 THEN {lit(K.DDI_HEADER)} || replace(c.messages, chr(10), {lit(K.DDI_JOIN)}) ELSE '' END AS answer,
       c.n_msgs::BIGINT AS n_ddi, CASE WHEN req.role = 'patient' THEN {lit(K.DISCLAIMER_PATIENT)} ELSE {lit(K.DISCLAIMER_OTHER)} END AS disclaimer
FROM req JOIN checked c ON c.basket = req.query_id
"""


Q["evaluate"] = f"""
WITH items AS (
  SELECT o_orderkey AS id, ['mcq', 'yn', 'short'][o_orderkey % 3 + 1] AS type, concat_ws(' ', o_orderpriority, o_orderstatus) AS question,
         CASE WHEN o_orderkey % 3 = 1 THEN ['yes', 'no', 'maybe'][o_custkey % 3 + 1] ELSE concat_ws(' ', o_orderstatus, o_orderpriority) END AS answer,
         o_custkey % 4 AS label
  FROM orders
), shorts AS (SELECT * FROM items WHERE type = 'short'),
{f1_cte('shorts', 'question', 'answer')},
s AS (
  SELECT type, 'acc' AS metric, CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END AS score FROM items WHERE type = 'mcq'
  UNION ALL SELECT type, 'acc', CASE WHEN answer = 'yes' THEN 1.0 ELSE 0.0 END FROM items WHERE type = 'yn'
  UNION ALL SELECT 'short', 'f1', f1 FROM f1
  UNION ALL SELECT type, 'em', CASE WHEN {nans('question')} = {nans('answer')} THEN 1.0 ELSE 0.0 END FROM shorts
)
SELECT type AS dataset, 'plain' AS mode, 'clinician' AS role, metric, round(avg(score), 6)::DOUBLE AS mean FROM s GROUP BY ALL
"""


Q["dedup_incremental"] = Q["dedup_first_wins"]


def render(sql: str) -> str:
    for k, v in SUBST.items():
        sql = sql.replace(k, v)
    return sql


def oracle_sql() -> dict[str, str]:
    return {k: render(v) for k, v in Q.items()}
