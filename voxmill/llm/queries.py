"""The queries of the training-data operators, one for each, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import bpe, chat, line_dedup, packing, rabitq, simhash, token_files, warc, weak_labels
from .quality_rules import quality_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), counts=True).select("doc_id", "n_lines", "n_removed", "text")


def _chat_log(rows: DataFrame) -> DataFrame:
    """A log (conv_id, seq, turn, kind, role, text) in no order whose fold is the turns of rows (conv_id, place, role, text).

    An assistant's turn begins as another draft, after which a next turn is begun; it is then regenerated, which drops that next turn, and streamed in
    deltas. Of the other turns, those at odd places are a message that is edited, and those at even places are streamed.
    """
    n, place = F.char_length("text"), F.col("place")
    event = lambda k, kind, role, text, turn=place: F.struct((place * 16 + k).alias("seq"), turn.alias("turn"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    piece = lambda i: F.substring("text", F.floor(n * i / 4).cast("int") + 1, (F.floor(n * (i + 1) / 4) - F.floor(n * i / 4)).cast("int"))
    stream = lambda first: [event(8 + i, "delta", first if i == 0 else none, piece(i)) for i in range(4)]
    role = F.col("role")
    again = [event(0, "message", role, F.lit("draft")), event(1, "delta", F.lit("user"), F.lit(" of an answer")), event(2, "message", F.lit("draft"), F.lit("too early"), place + 1), event(3, "regenerate", none, none), *stream(none)]
    edited = [event(0, "message", role, F.lit("draft")), event(1, "edit", none, F.col("text"))]
    log = F.when(role == chat.LEARNED, F.array(*again)).when(place % 2 == 1, F.array(*edited)).otherwise(F.array(*stream(role)))
    return rows.withColumn("text", F.coalesce("text", F.lit(""))).select("conv_id", F.explode(F.shuffle(log, F.lit(7))).alias("e")).select("conv_id", "e.*")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    # rows with the same or no turn are turns of their own
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text"))
    log = _chat_log(rows.unionByName(extra).withColumn("place", place.cast("long")))
    return chat.digests(chat.read_back(chat.render(chat.reconstruct(log))))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_vectors(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name == "pipeline" or name.startswith("op") and name[2].isdigit()}


_SQL = {
    "op2_warc": """
with p as (select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as digest from pages),
first as (select digest, min(page_id) as response from p where strlen(html) >= 100 group by digest)
select page_id, cast(strlen(html) as bigint) as payload_bytes, p.digest as payload_digest,
       case when response is null or response = page_id then 'response' else 'revisit' end as record_type,
       case when response <> page_id then response end as refers_to
from p left join first on p.digest = first.digest
""",
    "op6_chat": r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace(replace(replace(replace(role, '\', '\b'), '<turn', '\lturn'), '</turn', '\l/turn'), chr(10), '\n') as r, replace(replace(replace(text, '\', '\b'), '<turn', '\lturn'), '</turn', '\l/turn') as t from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       coalesce(cast(sum(length(text)) filter (role = 'assistant') as bigint), 0) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(r) + length(t) + 16) as bigint) as formatted_chars
from e group by conv_id
""",
    "op10_rabitq": """
with recursive x as (select vec_id, embedding::double[] as v from embeddings),
l as (select a.vec_id as a, b.vec_id as b from x a, x b where a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.95),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
n as (select a, count(*) as n from l group by a), c as (select a, min(b) as b from r group by a)
select x.vec_id, coalesce(n.n, 0) as n_links, least(x.vec_id, coalesce(c.b, x.vec_id)) as component_id,
       x.vec_id = least(x.vec_id, coalesce(c.b, x.vec_id)) as kept
from x left join n on n.a = x.vec_id left join c on c.a = x.vec_id
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
