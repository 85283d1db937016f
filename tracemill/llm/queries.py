"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm._io import cut, table


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of nearly equal bytes by sampled splitters."""
    from tracemill.llm.sharding import shard_records

    out = shard_records(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components by pigeonring filtering."""
    from tracemill.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kneser-Ney language identification; unlike the operator's rejection, every text with letters gets a language."""
    from tracemill.llm import language_id as lid

    docs = table(spark, sf_dir, "documents")
    out = lid.identify(docs, lid.train(docs))
    return out.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score", "cross_entropy", "accepted")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-permutation MinHash of each text and of its edit with the next text."""
    from tracemill.llm.minhash import fingerprint_with_next

    return fingerprint_with_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids as a content-addressed store and read it back."""
    import public_tokenizers

    from tracemill.llm import token_store as ts

    store = ts.write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), words_only=True, end_id=2)
    return ts.read_digests(spark, store).withColumnRenamed("id", "doc_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents' ids into sequences of 1024."""
    import public_tokenizers

    from tracemill.llm import packing

    docs = table(spark, sf_dir, "documents")
    pieces = cut(packing.cut_and_digest(docs, public_tokenizers.path("byte_bpe_50k.json"), words_only=False, end_id=2, room=1024), "pieces")
    return packing.pack(pieces, room=1024).withColumnRenamed("id", "doc_id")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages, site templates removed."""
    from tracemill.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op5_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top 10 by integer inner product over M-trees."""
    from tracemill.llm.metric_tree import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=10, query_every=100)


def op8_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of all documents, decoded and compared."""
    import public_tokenizers

    from tracemill.llm.piece_lattice import round_trip

    out = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), alpha=1.0, seed=1)
    return out.withColumnRenamed("id", "doc_id")


def op1_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds too, at 0.8 of their words."""
    from tracemill.llm.chaining import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").withColumnRenamed("source_id", "source_doc_id")


QUERIES = {
    "op1_chaining": op1_chaining,
    "op5_metric_tree": op5_metric_tree,
    "op8_piece_lattice": op8_piece_lattice,
    "op7_html_text": op7_html_text,
    "op3_token_store": op3_token_store,
    "op6_packing": op6_packing,
    "op2_language_id": op2_language_id,
    "op9_minhash": op9_minhash,
    "op4_sharding": op4_sharding,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op5_metric_tree": """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 10
""",
}
