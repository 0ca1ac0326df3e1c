"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import conversations, decontaminate, langid, media, packing, pii, setsketch, simhash, spelling, suffixes, tokens, toxicity, warc
from plumbline.llm.common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, null texts too: doc_id, held_out, score, predicted. Rows that repeat a doc_id have each a row."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, fingerprint (16 hex digits; zeros for null and empty texts), component_id."""
    classes = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, n_bytes, n_tokens, over_limit; counts come from the cache that calls share, filled first
    with what it lacks. A null text is the empty one."""
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", n_bytes)  # so that no text goes through the join
    return tokens.token_counts(docs, *vocabulary()).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that overlap the benchmark: doc_id, item_ids (all, joined), n_windows, first_token, end_token. Null texts
    and items overlap nothing."""
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_ids", F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ","))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, held_out, lang_pred (`und` without a letter), score."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs)
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, counts of the base patterns, base_sha256, spans. A null text has none."""
    return pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256. A null text is the empty one."""
    cut = suffixes.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every row of documents: its place. A null text is its end token alone."""
    return packing.packed(_table(spark, sf_dir, "documents"), *vocabulary())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages: page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is the empty payload."""
    index = warc.write_archives(_table(spark, sf_dir, "pages"))
    rows = warc.resolved(warc.read_records(index)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    warc.delete_archives(index)  # all that rows need has been read and written
    return rows


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, n_bytes, payload and stored form with their digests, feature: codec, duration, number of
    key samples and their byte ranges. A null text is the empty one."""
    stored = media.store_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    told = media.describe(stored.select("doc_id", n_bytes, "media"))
    ranges = F.array_join(F.transform("keyframes", lambda r: F.concat_ws("+", r["offset"], r["length"])), ",")
    feature = F.concat_ws(";", F.trim("codec"), F.concat_ws("/", "duration", "timescale"), "n_keyframes", ranges).alias("feature")
    return told.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature)


def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, n_shingles, component_id, kept. Null and empty texts have no shingles and no links."""
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conv_id of conversations, after damage that its turns' numbers decide: gaps, counts of faults, cost, audit and
    digest of the cheapest repair. Nulls are one space."""
    return conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations")))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of documents, counted over all whole texts: word, form, root, n, n_near, form_n. Null texts have no words."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_language": op5_language,
    "op6_pii": op6_pii,
    "op7_suffixes": op7_suffixes,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_media": op10_media,
    "op11_setsketch": op11_setsketch,
    "op12_conversations": op12_conversations,
    "op13_spelling": op13_spelling,
}

#: DuckDB SQL for what SQL can say; the other operators are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": """
with t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10ffff}]+') w from documents),
 i as (select item_id, regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10ffff}]+') w from benchmark),
 dw as (select doc_id, p, w[p + 1:p + 12] v from (select doc_id, w, unnest(range(0, len(w) - 11)) p from t)),
 bw as (select distinct item_id, w[p + 1:p + 12] v from (select item_id, w, unnest(range(0, len(w) - 11)) p from i)),
 k as (select * from (values (0, 3), (0, 6), (0, 9), (3, 6), (3, 9), (6, 9)) k(a, b)),
 dk as (select doc_id, p, v, a, b, array_to_string(v[a + 1:a + 3] || v[b + 1:b + 3], ' ') h from dw, k),
 bk as (select v, item_id, a, b, array_to_string(v[a + 1:a + 3] || v[b + 1:b + 3], ' ') h from bw, k),
 m as (select doc_id, p, 12 n, item_id from dk join bk using (a, b, h) where len(list_filter(range(1, 13), lambda j: dk.v[j] <> bk.v[j])) <= 2
  union all select t.doc_id, p, len(i.w), item_id from (select doc_id, w, unnest(range(0, len(w))) p from t) t join i on len(i.w) between 1 and 11 and t.w[p + 1] = i.w[1] and t.w[p + 1:p + len(i.w)] = i.w),
 q as (select doc_id, count(distinct (p, n)) n_windows from m group by doc_id)
select m.doc_id, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as item_ids, any_value(n_windows) as n_windows, min(p)::bigint as first_token, max(p + n)::bigint as end_token from m join q using (doc_id) group by m.doc_id""",
    "op7_suffixes": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) x, octet_length(encode(coalesce(text, '')))::bigint n from documents),
 w as (select doc_id, p, substr(x, 2 * p + 1, 200) s from (select doc_id, x, unnest(range(0, n - 99)) p from d where n >= 100)),
 f as (select doc_id, p, row_number() over (partition by s order by doc_id, p) k from w),
 r as (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 100 then 0 else 1 end new from f where k > 1),
 g as (select doc_id, p, sum(new) over (partition by doc_id order by p) g from r),
 s as (select doc_id, min(p) a, max(p) + 100 b from g group by doc_id, g),
 l as (select *, lag(b, 1, 0) over (partition by doc_id order by a) before from s),
 c as (select doc_id, sum(b - a)::bigint removed, count(*) spans, max(b) last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) head from l join d using (doc_id) group by doc_id)
select doc_id, n as n_bytes, coalesce(removed, 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(head || substr(x, 2 * last + 1), x))) as kept_sha256 from d left join c using (doc_id)""",
    "op9_warc": """
with p as (select page_id, coalesce(html, '') h from pages),
 m as (select page_id, h, max(page_id) over (partition by h) newest, list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', substr(sha1(h), i, 1)) - 1) || [0, 0] d from p)
select page_id, octet_length(encode(h))::bigint as payload_bytes,
 list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((d[5 * i // 4 + 1] * 256 + d[5 * i // 4 + 2] * 16 + d[5 * i // 4 + 3]) >> (7 - 5 * i % 4)) & 31)::int, 1)), 'string_agg', '') as payload_digest,
 case when page_id = newest then 'response' else 'revisit' end as record_type, case when page_id <> newest then newest end as refers_to from m""",    # The container box by box, in hex digits; the last bytes' checksum bit by bit.
    "op10_media": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) x, octet_length(encode(coalesce(text, '')))::bigint b from documents),
 p as (select doc_id, b, greatest(64, 64 * ((b + 63) // 64)) n, rpad(x, (2 * greatest(64, 64 * ((b + 63) // 64)))::int, '0') x from d),
 c as (select *, (n + 4095) // 4096 c, case when n >= 4096 then [[1, 4096]] else [] end || case when n % 4096 > 0 then [[(n + 4095) // 4096, n % 4096]] else [] end runs from p),
 f as (select *, 553 + 12 * len(runs) + 4 * c first, 136 + 12 * len(runs) + 4 * c stbl from c),
 h as (select *, printf('%08x', n) n4, printf('%016x', n) n8, '00010000' || repeat('00000000', 3) || '00010000' || repeat('00000000', 3) || '40000000' unity from f),
 m as (select *, '000000186674797069736f6d0000020069736f6d69736f32'
  || printf('%08x', stbl + 385) || '6d6f6f76' || '000000786d76686401000000' || repeat('00', 16) || '00001f40' || n8 || '000100000100' || repeat('00', 10) || unity || repeat('00', 24) || '00000002'
  || printf('%08x', stbl + 257) || '7472616b' || '00000068746b686401000007' || repeat('00', 16) || '0000000100000000' || n8 || repeat('00', 8) || '0000000001000000' || unity || repeat('00', 8)
  || printf('%08x', stbl + 145) || '6d646961' || '0000002c6d64686401000000' || repeat('00', 16) || '00001f40' || n8 || '55c40000' || '0000002168646c720000000000000000736f756e' || repeat('00', 13)
  || printf('%08x', stbl + 60) || '6d696e66' || '00000010736d68640000000000000000' || '0000002464696e660000001c6472656600000000000000010000000c75726c2000000001'
  || printf('%08x', stbl) || '7374626c' || '0000003473747364000000000000000100000024726177200000000000000001' || repeat('00', 8) || '00010008000000001f400000'
  || '0000001873747473000000000000000' || '1' || n4 || '00000001' || printf('%08x', 16 + 12 * len(runs)) || '7374736300000000' || printf('%08x', len(runs)) || list_aggregate(list_transform(runs, lambda r: printf('%08x', r[1]) || printf('%08x', r[2]) || '00000001'), 'string_agg', '')
  || '000000147374737a0000000000000001' || n4 || printf('%08x', 16 + 4 * c) || '7374636f00000000' || printf('%08x', c) || list_aggregate(list_transform(range(0, c), lambda k: printf('%08x', first + 4096 * k)), 'string_agg', '')
  || printf('%08x', n + 8) || '6d646174' || x media from h),
 t as (select *, list_transform(range(0, 64), lambda i: ('0x' || substr(x, (2 * (n - 64 + i) + 1)::int, 2))::bigint) tail from m)
select doc_id, b as n_bytes, n as payload_bytes, sha256(unhex(x)) as payload_sha256, xor(list_reduce([4294967295::bigint] || tail, lambda a, y: list_reduce([xor(a, y)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, (u & 1) * 3988292384))), 4294967295) as tail_crc32,
 (length(media) // 2)::bigint as media_bytes, sha256(unhex(media)) as media_sha256, 'raw;' || n || '/8000;' || n || ';' || first || '+' || n as feature from t""",
    # Pairs of sets by a join on shingle hashes, classes by reachability.
    "op11_setsketch": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
 s as (select doc_id, hash(unnest(list_distinct(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end))) as h from d),
 n as (select doc_id, count(*) as n from s group by 1),
 p as (select a.doc_id as a, b.doc_id as b, count(*) as k from (select * from s join n using (doc_id)) a join (select * from s join n using (doc_id)) b on a.h = b.h and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2),
 e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
 l as (select a, b from e union select b, a from e),
 z as (select doc_id, doc_id as r from documents union select z.doc_id, l.b from z join l on l.a = z.r)
select doc_id, coalesce(any_value(n), 0) as n_shingles, min(r) as component_id, doc_id = min(r) as kept from z left join n using (doc_id) group by doc_id""",
    # The checksum bit by bit; the cheapest way to each state, turn by turn.
    "op12_conversations": r"""
with recursive b as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
 h as (select *, xor(list_reduce([4294967295::bigint] || list_transform(range(0, length(k)), lambda i: ord(substr(k, (i + 1)::int, 1))::bigint), lambda a, y: list_reduce([xor(a, y)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, (u & 1) * 3988292384))), 4294967295) % 20 as d from b),
 m as (select conv_id, turn, case when d = 4 then 'user' else role end as role, case when d = 1 then '' when d = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(0, case d when 0 then 0 when 3 then 2 else 1 end)) as copy from h),
 f as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 then 'd' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 't' else '' end as f from m),
 g as (select *, substr(role, 1, 1) as r, lag(substr(role, 1, 1)) over (partition by conv_id order by i) as p, f not in ('b', 'd') as ok, case when f = 't' then 3 else 0 end as x, chr(10) || role || ':' || text as l, chr(10) || 'user:' || text as lu, chr(10) || 'assistant:' || text as la from f),
 k as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (f = 'b') as blank, count(*) filter (f = 'd') as duplicate, count(*) filter (f = 't') as truncated, count(*) filter (p is not null and p || r not in ('su', 'ua', 'au')) as illegal from g group by conv_id),
 z as (select distinct conv_id, 0::bigint as i, {'c': 0::bigint, 'a': '', 't': ''} as s0, null::struct(c bigint, a varchar, t varchar) as s1, {'c': 3::bigint, 'a': 'I', 't': chr(10) || 'user:'} as s2, {'c': 6::bigint, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} as s3 from conversations
  union all select conv_id, i, n0, n1, m2, list_min([n3, case when m2 is not null then {'c': m2.c + 3, 'a': m2.a || 'I', 't': m2.t || chr(10) || 'assistant:'} end])
  from (select *, list_min([n2, case when n0 is not null then {'c': n0.c + 3, 'a': n0.a || 'I', 't': n0.t || chr(10) || 'user:'} end, case when n1 is not null then {'c': n1.c + 3, 'a': n1.a || 'I', 't': n1.t || chr(10) || 'user:'} end, case when n3 is not null then {'c': n3.c + 3, 'a': n3.a || 'I', 't': n3.t || chr(10) || 'user:'} end]) as m2
   from (select z.conv_id, g.i,
     list_min([case when s0 is not null then {'c': s0.c + 4, 'a': s0.a || 'D', 't': s0.t} end]) as n0,
     list_min([case when s1 is not null then {'c': s1.c + 4, 'a': s1.a || 'D', 't': s1.t} end, case when s0 is not null and ok and r = 's' then {'c': s0.c + x, 'a': s0.a || 'K', 't': s0.t || l} end]) as n1,
     list_min([case when s2 is not null then {'c': s2.c + 4, 'a': s2.a || 'D', 't': s2.t} end] || list_transform([s0, s1, s3], lambda s: case when s is not null and ok and r = 'u' then {'c': s.c + x, 'a': s.a || 'K', 't': s.t || l} end) || list_transform([s0, s1, s3], lambda s: case when s is not null and ok then {'c': s.c + 3 + x, 'a': s.a || 'R', 't': s.t || lu} end)) as n2,
     list_min([case when s3 is not null then {'c': s3.c + 4, 'a': s3.a || 'D', 't': s3.t} end, case when s2 is not null and ok and r = 'a' then {'c': s2.c + x, 'a': s2.a || 'K', 't': s2.t || l} end, case when s2 is not null and ok then {'c': s2.c + 3 + x, 'a': s2.a || 'R', 't': s2.t || la} end]) as n3
    from z join g on g.conv_id is not distinct from z.conv_id and g.i = z.i + 1)))
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, e.c as cost, e.a as audit, sha256(substr(e.t, 2)) as repaired_sha256
 from (select z.conv_id, list_min([s0, s3]) as e, gaps, blank, duplicate, truncated, illegal from z left join k on k.conv_id is not distinct from z.conv_id where z.i = coalesce(k.n, 0))""",
    # The checksum by a table that SQL makes; neighbours by what a deletion leaves.
    "op13_spelling": r"""
with recursive t as (select list_transform(range(0, 256), lambda n: list_reduce([n::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, (u & 1) * 3988292384))) as tab),
 r as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')) as run from documents),
 w as (select coalesce(doc_id::varchar, '') as doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as n from r group by 1, 2),
 c as (select w, n, xor(list_reduce([4294967295::bigint] || list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::int, 2))::bigint), lambda a, y: xor(a >> 8, tab[(xor(a, y) & 255) + 1])), 4294967295) as h from (select w, n, hex(encode(doc || ':' || w)) as x from w), t),
 v as (select case when h % 31 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, sum(n)::bigint as n from c group by 1 having length(word) >= 7 and sum(n) >= 2),
 d as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as less from (select word, n, unnest(range(1, length(word) + 1))::int as i from v)),
 p as (select a.word, b.word as other, b.n as m from d a join d b on a.i = b.i and a.less = b.less where a.word <> b.word union select d.word, v.word, v.n from d join v on d.less = v.word union select v.word, d.word, d.n from d join v on d.less = v.word),
 b as (select word, count(*) as n_near, min((-m, other)) as best from p group by 1),
 f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when -best[1] >= 10 * v.n then best[2] end as form, case when -best[1] >= 10 * v.n then -best[1] end as form_n from v left join b using (word)),
 z as (select word, word as at, form as nxt from f union all select z.word, f.word, f.form from z join f on f.word = z.nxt)
select f.word, f.form, z.at as root, f.n, f.n_near, f.form_n from f join z using (word) where z.nxt is null""",
}
