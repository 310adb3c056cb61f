"""Registered queries of the operators here, each over its whole table with production parameters."""

from pyspark.sql import DataFrame, SparkSession

from scorewright.llm.conversation_repair import conversation_repair, damaged, known
from scorewright.llm.decontaminate import contaminated
from scorewright.llm.html_text import html_text
from scorewright.llm.jaccard_join import jaccard_join
from scorewright.llm.language_id import fit as fit_languages
from scorewright.llm.language_id import language_id
from scorewright.llm.license_scan import license_scan
from scorewright.llm.mixing import label_domains, mix
from scorewright.llm.passage_dedup import passage_dedup
from scorewright.llm.quality_crf import fit, quality
from scorewright.llm.sharding import shard
from scorewright.llm.spelling import spelling_variants, vocabulary
from scorewright.llm.suffix_dedup import suffix_dedup
from scorewright.llm.topk import top_k

# Shares of all tokens that each domain of the labels is to have.
TARGETS = {"clean": 0.9, "junk": 0.08, "toxic": 0.02}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and wordings in each document."""
    return license_scan(table(spark, folder, "documents"))


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the benchmark items that they hold."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_passage_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words and more with a near duplicate elsewhere."""
    return passage_dedup(table(spark, folder, "documents"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each document without strings of 200 bytes that stand in more than one place."""
    return suffix_dedup(table(spark, folder, "documents"), length=200)


def op5_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best partners of every fiftieth vector by integer inner product."""
    return top_k(table(spark, folder, "embeddings"), k=5, every=50)


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of each page."""
    return html_text(table(spark, folder, "pages"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """A rate for each document that brings the domains of the labels to their target shares."""
    return mix(table(spark, folder, "documents"), label_domains(table(spark, folder, "labels")), TARGETS)


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the component of those whose shingle sets are alike."""
    return jaccard_join(table(spark, folder, "documents"), n=4, share=85, of=100)


def op9_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of each document, learnt from the labels of keys that are not held out."""
    docs = table(spark, folder, "documents")
    return quality(docs, fit(docs, table(spark, folder, "labels")))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of each document, learnt from those that are not held out."""
    docs = table(spark, folder, "documents")
    return language_id(docs, fit_languages(docs))


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the documents, with planted typing errors, and the frequent words that they are variants of."""
    return spelling_variants(vocabulary(table(spark, folder, "documents"), typos_every=31))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Cheapest repair of each conversation after planted faults."""
    rows = known(table(spark, folder, "conversations"))
    return conversation_repair(damaged(rows), rows)


def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard of each document, of 24 with equal sizes, and its place there."""
    return shard(table(spark, folder, "documents"), shards=24)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_passage_dedup": op3_passage_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_topk": op5_topk,
    "op6_html_text": op6_html_text,
    "op7_mixing": op7_mixing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality_crf": op9_quality_crf,
    "op10_language_id": op10_language_id,
    "op11_spelling": op11_spelling,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_sharding": op13_sharding,
}

_SETS = r"""
words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i+3], ' '))) end as s from words)"""

# CRC-32 of a text's UTF-8 bytes, by the table of its polynomial; crc_table has one row.
_CRC_TABLE = """
crc_bits as (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as v
    from range(256) t(i)),
crc_table as (select list(v order by i) as crc from crc_bits)"""


def _crc32(text: str) -> str:
    digits = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {digits}), lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8)))"


SQL: dict[str, str] = {
    "op11_spelling": f"""
with recursive {_CRC_TABLE},
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run
    from documents where text is not null),
counted as (select doc_id, run, count(*) as c from runs where length(run) >= 7 group by all),
hashed as (select run, c, {_crc32("coalesce(cast(doc_id as varchar), '') || ':' || run")} as h from counted, crc_table),
typed as (select case when h % 31 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from hashed),
words as (select word, cast(sum(c) as bigint) as n from typed where length(word) >= 7 group by 1 having sum(c) >= 2),
cut as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as v from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
pairs as (select a.word as x, b.word as y, b.n as m from cut a join words b on a.v = b.word union select b.word, a.word, a.n from cut a join words b on a.v = b.word
    union select a.word, b.word, b.n from cut a join cut b on a.i = b.i and a.v = b.v and a.word <> b.word),
ranked as (select x, y, m, count(*) over (partition by x) as n_near, row_number() over (partition by x order by m desc, y) as k from pairs),
linked as (select w.word, w.n, coalesce(r.n_near, 0) as n_near, case when r.m >= 10 * w.n then r.y end as form, case when r.m >= 10 * w.n then r.m end as form_n
    from words w left join ranked r on r.x = w.word and r.k = 1),
path as (select word, word as at from linked union all select p.word, l.form from path p join linked l on l.word = p.at where l.form is not null),
ends as (select p.word, p.at as root from path p join linked l on l.word = p.at where l.form is null)
select l.word, l.form, e.root, l.n, l.n_near, l.form_n from linked l join ends e on e.word = l.word""",
    "op13_sharding": f"""
with {_CRC_TABLE},
narrow as (select doc_id, cast(octet_length(encode(coalesce(text, ''))) + 8 as bigint) as size, cast({_crc32("coalesce(text, '')")} as bigint) as text_crc32,
    ('0x' || left(md5(coalesce(text, '')), 15))::bigint as h from documents, crc_table),
placed as (select *, sum(size) over (order by h, doc_id nulls first rows unbounded preceding) - size as byte, sum(size) over () as total,
    sum(size) over (partition by h) as together from narrow),
grouped as (select *, min(byte) over (partition by h) as start from placed),
sharded as (select *, cast((case when together * 2400 <= total then 2 * start + together else 2 * byte + size end) * 24 // (2 * total) as integer) as shard from grouped)
select doc_id, size, text_crc32, 'bytes' as law, shard, cast(row_number() over (partition by shard order by h, doc_id nulls first) - 1 as bigint) as slot,
    cast(null as integer) as grown_shard
from sharded""",
    "op5_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5""",
    "op8_jaccard_join": f"""
with recursive {_SETS},
rare as (select doc_id, unnest(s) as g from sets),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as n from rare a join rare b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from shared join sets p on p.doc_id = x join sets q on q.doc_id = y where 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
reach as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles,
    least(s.doc_id, coalesce((select min(y) from reach r where r.x = s.doc_id), s.doc_id)) as component_id,
    (select count(*) from links l where l.x = s.doc_id) as n_links
from sets s""",
}
