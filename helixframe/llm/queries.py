"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import collocations, conversations, decontam, fingerprints, langid, linededup, minhash, packing, substring, topk, toxicity, urlfilter, warc
from helixframe.llm.common import read_table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(read_table(spark, sf_dir, "pages"))
    sound = F.when(F.col("error").isNull() & F.col("digest_ok"), F.col("page_id")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("damaged record:"), "error")))
    return rows.select(sound.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(read_table(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    labels = read_table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).when(F.col("toxic") == 0, 0)
    labels = labels.select("doc_id", grade.alias("grade"))
    return toxicity.assess(read_table(spark, sf_dir, "documents"), labels).select("doc_id", "severity", "grade", "toxic")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damage_and_repair(read_table(spark, sf_dir, "conversations"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(read_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_topk, op3_suffix_dedup, op4_language_id, op5_minhash, op6_packing, op7_line_dedup, op8_decontamination, op9_toxicity, op10_url_filter, op11_conversation_repair, op12_fingerprints, op13_collocations)
}

OP1_SQL = """
with p as (
  select page_id, coalesce(html, '') as body from pages
), d as (
  select page_id, strlen(body) as payload_bytes, sha1(body) as h,
         cast(unhex(sha1(body)) as bit)::varchar as bits from p
), o as (
  select h, min(page_id) as owner from d group by h
)
select d.page_id, cast(d.payload_bytes as bigint) as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         cast(1 + 16 * cast(substr(bits, 5 * i + 1, 1) as int) + 8 * cast(substr(bits, 5 * i + 2, 1) as int)
              + 4 * cast(substr(bits, 5 * i + 3, 1) as int) + 2 * cast(substr(bits, 5 * i + 4, 1) as int)
              + cast(substr(bits, 5 * i + 5, 1) as int) as bigint), 1)), '') as payload_digest,
       case when o.owner is null or d.page_id = o.owner then 'response' else 'revisit' end as record_type,
       case when d.page_id <> o.owner then o.owner end as refers_to
from d join o using (h)
"""

OP2_SQL = """
with v as (
  select vec_id, row_number() over () as row, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as q
  from embeddings where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.row, a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q::double[], b.q::double[]) as bigint) as score
  from v a, v b where a.vec_id % 100 = 0 and a.row <> b.row
), r as (
  select query_id, cast(row_number() over (partition by row order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select * from r where rank <= 10
"""

OP5_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') as g
  from w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) as t(i) where len(w) > 0
), n as (
  select doc_id, count(*) as n from s group by doc_id
), e as (
  select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), r as (
  select doc_id, doc_id as other from documents
  union select r.doc_id, e.b from r join e on r.other = e.a
), c as (
  select doc_id, min(other) as component_id from r group by doc_id
)
select c.doc_id, coalesce(n.n, 0) as n_shingles, component_id, c.doc_id = component_id as kept
from c left join n using (doc_id)
"""

OP7_SQL = """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), k as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l
), o as (
  select key, min(doc_id) as owner from k where length(key) >= 10 group by key
), v as (
  select k.doc_id, k.pos, k.line, coalesce(k.doc_id > o.owner, false) as gone
  from k left join o on k.key = o.key
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from v group by doc_id
"""

OP8_SQL = """
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark
), win as (
  select distinct item_id, least(13, len(w)) as k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as g
  from bw, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as t(i) where len(w) > 0
), ks as (
  select distinct k from win
), pos as (
  select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as g
  from dw, ks, unnest(range(1, len(w) - k + 2)) as t(i) where len(w) >= k
), m as (
  select distinct pos.doc_id, pos.i, pos.k, win.item_id from pos join win on pos.k = win.k and pos.g = win.g
), hits as (
  select doc_id, count(distinct j) as n_hit
  from (select doc_id, unnest(range(i, i + k)) as j from m) group by doc_id
), its as (
  select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids
  from (select distinct doc_id, cast(item_id as varchar) as s from m) group by doc_id
)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join hits on dw.doc_id = hits.doc_id left join its on dw.doc_id = its.doc_id
"""

OP11_SQL = """
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as tab
), b as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         xor(list_reduce(list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''),
             lambda x: cast(ascii(x) as bigint)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), cast(4294967295 as bigint)), 4294967295) % 20 as kind
  from conversations, crc
), d as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text,
         unnest(range(case when kind = 3 then 2 else 1 end)) as again
  from b where kind <> 0
), o as (
  select *, dense_rank() over (order by conv_id nulls first) as c,
         row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as i from d
), f as (
  select *, left(role, 1) as ini,
         case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank'
              when row_number() over (partition by c, role, text order by i) > 1 then 'duplicate'
              when regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
         lag(left(role, 1)) over (partition by c order by i) as before
  from o
), counts as (
  select c, any_value(conv_id) as conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (before is not null and before || ini not in ('su', 'ua', 'au')) as illegal
  from f group by c
), ins(st, letters, mid, added, price) as (
  values (0, '', 0, []::varchar[], 0), (0, 'I', 2, ['user:'], 2), (0, 'II', 3, ['user:', 'assistant:'], 4),
         (1, '', 1, []::varchar[], 0), (1, 'I', 2, ['user:'], 2), (1, 'II', 3, ['user:', 'assistant:'], 4),
         (2, '', 2, []::varchar[], 0), (2, 'I', 3, ['assistant:'], 2), (3, '', 3, []::varchar[], 0), (3, 'I', 2, ['user:'], 2)
), op(mid, letter, ini, after, given, price) as (
  values (0, 'K', 's', 1, null, 0), (0, 'K', 'u', 2, null, 0), (1, 'K', 'u', 2, null, 0), (2, 'K', 'a', 3, null, 0), (3, 'K', 'u', 2, null, 0),
         (0, 'R', null, 2, 'user', 2), (1, 'R', null, 2, 'user', 2), (2, 'R', null, 3, 'assistant', 2), (3, 'R', null, 2, 'user', 2),
         (0, 'D', null, 0, null, 3), (1, 'D', null, 1, null, 3), (2, 'D', null, 2, null, 3), (3, 'D', null, 3, null, 3)
), walk(c, i, st, cost, audit, kept) as (
  select c, cast(0 as bigint), 0, 0, '', []::varchar[] from counts
  union all
  select c, i, st, cost, audit, kept from (
    select w.c, f.i, op.after as st, w.cost + ins.price + op.price + case when op.letter <> 'D' and f.fault = 'truncated' then 1 else 0 end as cost,
           w.audit || ins.letters || op.letter as audit,
           list_concat(w.kept, ins.added, case when op.letter = 'D' then [] else [coalesce(op.given, f.role) || ':' || f.text] end) as kept
    from walk w join f on f.c = w.c and f.i = w.i + 1 join ins on ins.st = w.st
    join op on op.mid = ins.mid and (op.ini is null or op.ini = f.ini) and (op.letter = 'D' or f.fault not in ('blank', 'duplicate'))
  ) qualify row_number() over (partition by c, st order by cost, audit) = 1
), best as (
  select w.c, w.cost + ins.price as cost, w.audit || ins.letters as audit, list_concat(w.kept, ins.added) as kept
  from walk w join counts n on n.c = w.c and n.n = w.i join ins on ins.st = w.st and ins.mid in (0, 3)
  qualify row_number() over (partition by w.c order by w.cost + ins.price, w.audit || ins.letters) = 1
)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, cast(coalesce(cost, 0) as bigint) as cost, coalesce(audit, '') as audit,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) e
left join counts n on n.conv_id is not distinct from e.conv_id left join best on best.c = n.c
"""

OP12_SQL = """
with d as (
  select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n,
         row_number() over (order by doc_id nulls first) as r, count(*) over () as total from documents
), t as (
  select a.r, a.doc_id, a.n, b.r as next, a.text as own,
         substr(a.text, 1, a.n - a.n // 4) || substr(b.text, 1, a.n // 4) as edited
  from d a join d b on b.r = a.r % a.total + 1
), v as (
  select r, 0 as kind, unnest(string_split(own, chr(10))) as p from t
  union all select r, 1, unnest(string_split(edited, chr(10))) from t
), exact as (
  select r, kind, k as lane, sum(cast('0x' || substr(h, 8 * k + 1, 8) as bigint)) % 4294967296 as x
  from (select r, kind, sha256(p) as h from v), unnest(range(8)) as u(k) group by 1, 2, 3
), words as (
  select r, kind, string_split(p, ' ') as w from v
), pairs as (
  select r, kind, w[i] || ' ' || coalesce(w[i + 1], '') as g, count(*) as c
  from words, unnest(range(1, greatest(len(w) - 1, 1) + 1)) as u(i) group by 1, 2, 3
), crc as (
  select list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as tab
), sums as (
  select g, xor(list_reduce(list_transform(range(strlen(g)), lambda i: cast('0x' || substr(hex(g), 2 * i + 1, 2) as bigint)),
         lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), cast(4294967295 as bigint)), 4294967295) % 256 as e
  from (select distinct g from pairs), crc
), near as (
  select r, kind, 8 + e % 128 as lane, ((sum(case when e < 128 then c else -c end) % 65536) + 65536) % 65536 as x
  from pairs join sums using (g) group by 1, 2, 3
), every as (
  select r, kind, lane, coalesce(e.x, n.x, 0) as x
  from (select r, kind, lane from t, unnest([0, 1]) as a(kind), unnest(range(136)) as b(lane))
  left join exact e using (r, kind, lane) left join near n using (r, kind, lane)
), f as (
  select r, kind, string_agg(case when lane < 8 then format('{:08x}', cast(x as bigint)) else format('{:04x}', cast(x as bigint)) end, '' order by lane) as f,
         list(cast((x + 32768) % 65536 - 32768 as bigint) order by lane) filter (lane >= 8) as y
  from every group by 1, 2
), s as (
  select r, kind, f, y, list_sum(list_transform(y, lambda x: x * x)) as q from f
)
select t.doc_id, t.n as n_chars, sha256(t.edited) as edited_sha256, o.f as fingerprint, e.f as edited_fingerprint,
       case when o.y = e.y then 1.0::double else greatest(0.0::double, 1 - cast(list_sum(list_transform(list_zip(o.y, e.y),
         lambda p: ((p[1] - p[2] + 98304) % 65536 - 32768) * ((p[1] - p[2] + 98304) % 65536 - 32768))) as double) / cast(o.q + e.q as double)) end as near_edited,
       case when o.y = x.y then 1.0::double else greatest(0.0::double, 1 - cast(list_sum(list_transform(list_zip(o.y, x.y),
         lambda p: ((p[1] - p[2] + 98304) % 65536 - 32768) * ((p[1] - p[2] + 98304) % 65536 - 32768))) as double) / cast(o.q + x.q as double)) end as near_next
from t join s o on o.r = t.r and o.kind = 0 join s e on e.r = t.r and e.kind = 1 join s x on x.r = t.next and x.kind = 0
"""

OP13_SQL = """
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as s from documents
), w as (
  select lang, row_number() over () as piece, regexp_extract_all(s, '[^\\x20\\x09]+') as w from p
), n as (
  select lang, cast(sum(len(w)) as bigint) as n from w group by lang
), v as (
  select lang, piece, unnest(w) as a, generate_subscripts(w, 1) as pos from w
), q as (
  select lang, a, lead(a, 1) over o as b, lead(a, 2) over o as c, lead(a, 3) over o as d, lead(a, 4) over o as e
  from v window o as (partition by piece order by pos)
), f as (
  select lang, 1 as k, a as phrase, count(*) as f from q group by 1, 3
  union all select lang, 2, a || ' ' || b as phrase, count(*) from q where b is not null group by 1, 3
  union all select lang, 3, a || ' ' || b || ' ' || c as phrase, count(*) from q where c is not null group by 1, 3
  union all select lang, 4, a || ' ' || b || ' ' || c || ' ' || d as phrase, count(*) from q where d is not null group by 1, 3
  union all select lang, 5, a || ' ' || b || ' ' || c || ' ' || d || ' ' || e as phrase, count(*) from q where e is not null group by 1, 3
), c as (
  select lang, k as words, phrase, string_split(phrase, ' ') as w, f as a from f where k > 1 and f >= 100
), cut as (
  select c.lang, c.phrase, c.a, j, x.f as l, y.f as r, n.n, (1000::hugeint * c.a * n.n) // (x.f::hugeint * y.f) as score
  from c, unnest(range(1, words)) as t(j), f x, f y, n
  where x.lang = c.lang and x.phrase = array_to_string(w[1:j], ' ') and y.lang = c.lang and y.phrase = array_to_string(w[j + 1:words], ' ') and n.lang = c.lang
), best as (
  select * from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1
), longer as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as a
  from c, unnest(range(2, words)) as t(m), unnest(range(1, words - m + 2)) as u(i) group by 1, 2
)
select best.lang, row_number() over (partition by best.lang order by score desc, best.a desc, best.phrase) as rank, best.phrase,
       best.a, l, r, n, cast(score as bigint) as score
from best left join longer on longer.lang = best.lang and longer.phrase = best.phrase
where longer.a is null or 100 * longer.a < 100 * best.a
qualify rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op2_topk": OP2_SQL,
    "op5_minhash": OP5_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_decontamination": OP8_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_fingerprints": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
