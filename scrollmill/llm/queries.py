"""The registered queries of this package and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, decontaminate, language, minhash, mixing, pii, quality, simhash, suffix_tree, toxicity, warc, whitening
from .common import remainder, table

#: Fixed value: what both turns of conversation -7 say.
CONTROL = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat.format_paths(chat.threads(turns))
    read = made.select(F.col("tree").alias("conv_id"), "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(plain, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.sized(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "first_shard")


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *(of(k) for k in pii.BASE), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.memberships(table(spark, sf_dir, "documents"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", ids, "contaminated")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.predict(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_quality, op3_mixing, op4_suffix_tree, op5_pii, op6_minhash, op6_near_duplicates, op7_winnowing, op8_toxicity, op9_warc, op10_simhash, op11_filter_audit, op12_whitening, op13_language)}

_ESCAPED = "replace(replace(replace({}, '\\', '\\b'), '###', '\\h'), '</turn>', '\\t')"
_ROLE = "replace(replace(" + _ESCAPED.format("role") + ", ':', '\\c'), chr(10), '\\n')"

OP1_SQL = rf"""
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '{CONTROL}' union all select -7, 1, 'assistant', '{CONTROL}'),
g as (
    select conv_id, count(*) as n_turns,
        string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as plain,
        coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '') as loss,
        cast(sum(6 + length({_ROLE}) + length({_ESCAPED.format('text')}) + 8) as bigint) as formatted_chars
    from t group by conv_id)
select conv_id, n_turns, sha256(plain) as turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g
"""

OP9_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as least from p where octet_length(encode(html)) >= 100 group by d)
select p.page_id, cast(octet_length(encode(p.html)) as bigint) as payload_bytes, p.d as payload_digest,
    case when f.least is null or p.page_id is not distinct from f.least then 'response' else 'revisit' end as record_type,
    case when f.least is not null and p.page_id is distinct from f.least then f.least end as refers_to
from p left join f on p.d = f.d
"""


def _word_list(text: str) -> str:
    lower = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP7_SQL = f"""
with d as (select row_number() over () as k, doc_id, {_word_list('text')} as w from documents),
b as (select item_id, {_word_list('text')} as w from benchmark),
bw as (
    select distinct item_id, len, list_aggregate(w[i : i + len - 1], 'string_agg', ' ') as gram
    from (select item_id, w, least(13, len(w)) as len, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) as i from b where len(w) > 0)),
lens as (select distinct len from bw),
dg as (
    select k, i, len, list_aggregate(w[i : i + len - 1], 'string_agg', ' ') as gram
    from (select k, w, len, unnest(generate_series(1, len(w) - len + 1)) as i from d, lens where len(w) >= len)),
hit as (select k, i, dg.len, item_id from dg join bw on dg.gram = bw.gram and dg.len = bw.len),
covered as (select k, count(distinct p) as n_hit from (select k, unnest(generate_series(i, i + len - 1)) as p from (select distinct k, i, len from hit)) group by k),
listed as (select k, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct k, cast(item_id as varchar) as s from hit where item_id is not null) group by k)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join covered on d.k = covered.k left join listed on d.k = listed.k
"""


def _duck(sql: str) -> str:
    return sql.replace(" div ", " // ")


def _duck_keys(n: str, seed: str) -> str:
    return f"list_transform(range(0, {mixing.ROUNDS}), lambda r: ({mixing.mixed('r + 101', '7', seed)} * {mixing.PRIME} + {mixing.mixed('r + 211', '3', seed)}) % ({n}))"


def _duck_permuted(x: str, n: str, own: str) -> str:
    step = mixing.rounds(n).replace("if(", "case when ", 1).replace("= 1, ", "= 1 then ").replace(", y)", " else y end")
    return f"list_reduce({own}, lambda y, k: {step}, cast({x} as bigint))"


def mixing_sql(docs: str = "documents", extra: str = "", block_words: int = 128, seed: int = 1) -> str:
    """DuckDB SQL for mixing.mix over ``docs``; ``extra`` names more columns."""
    P, per_bucket = mixing.PRIME, block_words * mixing.BUCKET_BLOCKS
    bucket = f"({mixing.mixed(f'((coalesce(doc_id, -1) % {P} + {P}) % {P} + mark)', '1', str(seed))} % buckets)"
    return _duck(rf"""
with sized as (
    select doc_id, source{extra}, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size, cast(coalesce(length(text), 0) as bigint) as mark from {docs}),
per as (
    select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as nr,
        [5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 as int) + 1] as weight
    from sized group by source),
lv as (
    select (sum(source_size) over () * 1.5::double - coalesce(sum(source_size) over b, 0) * 2) / (sum(weight) over () - coalesce(sum(weight) over b, 0)) as level
    from per window b as (order by source_size::double / weight, nr rows between unbounded preceding and 1 preceding)),
tg as (select *, least(source_size * 2.0::double, weight * (select max(level) from lv)::double) as target, greatest(1, (source_size + {per_bucket - 1}) // {per_bucket}) as buckets from per),
own as (select s.*, p.nr, p.source_size, p.target, {bucket} as bucket from sized s join tg p on s.source is not distinct from p.source),
placed as (select *, row_number() over () as k, cast(sum(size) over (partition by nr, bucket order by doc_id nulls first, size rows unbounded preceding) - size as bigint) as start from own),
fl as (select nr, bucket, cast((sum(size) + {block_words - 1}) // {block_words} as bigint) as n from own group by all),
filled as (select *, cast(sum(n) over (partition by nr order by bucket) - n as bigint) as first from fl),
pl as (select tg.*, b.blocks, case when source_size = 0 then 0 else cast(floor(target * b.blocks / source_size + 0.5) as bigint) end as slots from tg join (select nr, cast(sum(n) as bigint) as blocks from filled group by 1) b on tg.nr = b.nr),
plan as (select *, cast(sum(slots) over (order by nr) - slots as bigint) as base from pl),
tot as (select cast(greatest(1, sum(slots)) as bigint) as total from plan),
tokens as (select nr, base, total, unnest(range(0, slots)) as i from plan, tot where slots > 0),
all_keys as (select {_duck_keys('total', f'{seed} + 17')} as every from tot),
drawn as (select {_duck_permuted('base + i', 'total', 'every')} // {mixing.SHARD_SLOTS} as shard, nr, count(*) as n from tokens, all_keys group by 1, 2),
ranges as (select *, cast(sum(n) over (partition by nr order by shard) - n as bigint) as first from drawn),
numbered as (select shard, nr, unnest(range(first, first + n)) as j from ranges),
own_keys as (select nr, blocks, pass, {_duck_keys('blocks', f'{seed} + nr * 1009 + pass')} as own from plan, (select unnest([0, 1]) as pass) where slots > 0),
chosen as (
    select shard, x.nr, {_duck_permuted('j % blocks', 'blocks', 'own')} as block
    from numbered x join own_keys o on x.nr = o.nr and o.pass = x.j // o.blocks),
indexed as (select nr, bucket, first, unnest(range(first, first + n)) as block from filled where n > 0),
wanted as (select c.shard, c.nr, i.bucket, c.block - i.first as block from chosen c join indexed i on c.nr = i.nr and c.block = i.block),
pieces as (select k, nr, bucket, start, size, unnest(generate_series(start // {block_words}, (start + size - 1) // {block_words})) as block from placed where size > 0),
got as (
    select k, cast(sum(least(start + size, (p.block + 1) * {block_words}) - greatest(start, p.block * {block_words})) as bigint) as taken, min(shard) as first_shard
    from pieces p join wanted w on p.nr = w.nr and p.bucket = w.bucket and p.block = w.block group by k)
select doc_id{extra}, size, source_size, target, coalesce(taken, 0) as taken, first_shard from placed left join got on placed.k = got.k
""")


SQL = {"op1_chat_format": OP1_SQL, "op3_mixing": mixing_sql(), "op7_winnowing": OP7_SQL, "op9_warc": OP9_SQL, "op11_filter_audit": audit.SQL}
