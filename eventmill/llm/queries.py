"""The queries of this subpackage, one for each operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_mil import score, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train(docs, _table(spark, sf_dir, "labels").where(~held_out))
    scored = score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    # beside the strings of 400 bytes, passages of 50 words, which may be shorter, are counted and left in
    cut = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=400, passage_words=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "passage_bytes", "n_passages")


#: Host, path and verdict of the listed URL rules.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url and block: a page shows the document whose id ends its path; poor or toxic ones are to be blocked."""
    from .url_rules import path

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    shown = F.try_to_number(F.regexp_extract(path(F.col("url")), r"([0-9]{1,15})(?:\.html)?/?$", 1), F.lit("999999999999999")).cast("long")
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    return pages.withColumn("doc_id", shown).join(labels, "doc_id").where("block is not null").drop("doc_id")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import filter_urls, mine_rules

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, mine_rules(labelled_pages(spark, sf_dir), false_rate=0.05, held_out=True), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    index = archive_round_trip(_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "place")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import round_trip

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    back = round_trip(docs, path, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_kd_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kd_shard import assign_shards

    out = assign_shards(_table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op9_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lang_id import identify, train

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = train(docs.where(~held_out), row_key=F.col("doc_id"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(_table(spark, sf_dir, "documents"), trusted)


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import licences

    out = licences(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(spark, f"{sf_dir}/documents.parquet", _table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for name, f in sorted(globals().items()) if name.startswith("op")}


_AZ = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4 = rf"""
with h as (select page_id, coalesce(html, '') as p, url, {_AZ.format("regexp_extract(url, '://([^/?#]*)', 1)")} as host from pages),
d as (select *, octet_length(encode(p)) as n, sha1(p) as x from h),
b as (select *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(x, 1 + 5 * (i // 4), 5) as integer) >> (5 * (3 - i % 4))) & 31 as integer), 1)), '') as digest from d),
k as (select *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || coalesce(regexp_extract(url, '://[^/?#]*([^#]*)', 1), '') as url_key, strftime(timestamp '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') as captured, min(page_id) over (partition by digest) as origin from b)
select page_id, n as payload_bytes, digest as payload_digest, case when page_id > origin then 'revisit' else 'response' end as record_type,
  case when page_id > origin then origin end as refers_to, url_key, captured, row_number() over (order by url_key, captured, page_id) - 1 as place from k"""

_OP8 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_AZ.format("text")}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as c from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * i >= 85 * (nx.c + ny.c - i)),
e as (select x as a, y as b from l union all select y, x from l),
r(doc, root) as (select doc_id, doc_id from documents union select e.b, r.root from r join e on e.a = r.doc)
select d.doc_id, coalesce(n.c, 0) as n_shingles, m.root as component_id, d.doc_id = m.root as kept
from documents d left join n on n.doc_id = d.doc_id join (select doc, min(root) as root from r group by 1) m on m.doc = d.doc_id"""


_OP12 = r"""
with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
  case when len(w) < 200 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
  + case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) then 4 else 0 end + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
  + case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end as mask from w left join l using (doc_id)),
c as (select part, mask, count(*) as n, sum(good) as g, sum(toxic) as x from m group by 1, 2),
f(f, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order from f a, f b, f c, f d, f e where a.f not in (b.f, c.f, d.f, e.f) and b.f not in (c.f, d.f, e.f) and c.f not in (d.f, e.f) and d.f <> e.f),
s as (select filter_order, cast(k as integer) as step, f.bit as own, coalesce((select sum(g.bit) from f g where contains(filter_order[:k - 1], g.f)), 0)::integer as before from o, range(1, 6) r(k), f where f.f = filter_order[k]),
r as (select part, filter_order, step, own,
  cast(coalesce(sum(n) filter ((mask & (before | own)) = 0), 0) as bigint) as kept, cast(coalesce(sum(n) filter ((mask & before) = 0 and (mask & own) <> 0), 0) as bigint) as removed,
  cast(coalesce(sum(n) filter ((mask & before) <> 0 and (mask & own) <> 0), 0) as bigint) as redundant, cast(coalesce(sum(n) filter (mask = own), 0) as bigint) as unique_fails,
  cast(coalesce(sum(g) filter ((mask & before) = 0 and (mask & own) <> 0), 0) as bigint) as good_lost, cast(coalesce(sum(x) filter ((mask & before) = 0 and (mask & own) <> 0), 0) as bigint) as toxic_lost
  from c, s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from r"""

_OP13 = rf"""
with t as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_AZ.format("text")}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from t),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from w, range(1, 6) s(k) where len(w) >= k),
f as (select lang, cast(k as integer) as k, phrase, count(*) as c from g group by all), n as (select lang, cast(sum(c) as bigint) as n from f where k = 1 group by 1),
c as (select * from f where c >= 100),
cuts as (select c.lang, c.k, c.phrase, c.c as a, s.j, x.c as l, y.c as r, n.n, (1000 * c.c::hugeint * n.n) // (x.c::hugeint * y.c) as score
  from c join range(1, 5) s(j) on s.j < c.k join n on n.lang = c.lang
  join c x on x.lang = c.lang and x.phrase = array_to_string(string_split(c.phrase, ' ')[:s.j], ' ') join c y on y.lang = c.lang and y.phrase = array_to_string(string_split(c.phrase, ' ')[s.j + 1:], ' ') where c.k > 1),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
longer as (select lang, unnest([array_to_string(string_split(phrase, ' ')[:-2], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) as phrase, a as b from best where k > 2),
m as (select lang, phrase, max(b) as b from longer group by all),
kept as (select best.* from best left join m on m.lang = best.lang and m.phrase = best.phrase where m.b is null or 100 * m.b < 100 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, cast(score as bigint) as score from kept qualify rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """SQL can't say the others: trained models, merges by rank, byte windows, mined rules and tree cuts."""
    return {"op4_warc": _OP4, "op8_near_dedup": _OP8, "op12_filter_audit": _OP12, "op13_collocations": _OP13}
