"""A training-data pipeline over ``documents``: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from storeline.llm import cotraining, mixing, piece_bpe, substring_rlz, superminhash
from storeline.session import ensure_checkpoint_dir, scratch_path, ship_package

KEPT_QUALITY = 0.5
REPETITIONS = 2.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier scores at KEPT_QUALITY and above."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    model = cotraining.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotraining.score_documents(docs, model, keep=tuple(docs.columns)).where(
        F.col("score") >= KEPT_QUALITY).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest id.

    Of rows that repeat doc_id and text one stays. Rows without an id belong to no group; each text of theirs stays once.
    """
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    kept = superminhash.near_duplicates(docs, words=5, percent=80, bands=37, rows=6).where("kept")
    ids = kept.select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["kept_id"]), "left_semi").dropDuplicates(["doc_id", "text"])


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words that an earlier document has, n_chars to match. A
    document of which nothing is left goes."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    # the other columns travel as one text, whatever their types
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    name = "passage_" + "_".join(rest)
    packed = docs.select("doc_id", "text", F.to_json(F.struct(*rest)).alias(name))
    out = substring_rlz.remove_repeated_passages(packed, keep=(name,), layout=True)
    return out.where("n_removed = 0 or n_removed < n_words").select(
        "doc_id", F.col("kept").alias("text"), F.char_length("kept").cast("long").alias("n_chars"),
        F.from_json(name, docs.select(*rest).schema).alias(name)).select("doc_id", "text", "n_chars", f"`{name}`.*").select(
        *[f"`{c}`" for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As flat a mix of sources as REPETITIONS allows, of as many tokens as there are. Columns block, order_key
    and n_tokens of the input come back null: the mix has its own."""
    ensure_checkpoint_dir(spark)
    own = ("block", "order_key", "n_tokens")
    out = mixing.mixed(docs.drop(*own, *[c for c in docs.columns if c.startswith("mix_")]), repetitions=REPETITIONS).drop(*own)
    return out.select(*[F.col(f"`{c}`") if c in out.columns else F.lit(None).cast(docs.schema[c].dataType).alias(c)
                        for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it (they do unless it holds the space mark itself).
    Columns that ``documents`` does not have are left out."""
    import public_tokenizers

    ensure_checkpoint_dir(spark)
    ship_package(spark)
    out = piece_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"),
                                     keep=("doc_id", "lang", "source", "n_chars"))
    return out.withColumn("n_tokens", F.size("ids").cast("long")).drop("decoded")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("mix", mix),
          ("encode", encode)]

#: The stages fit models and compare hashes; SQL has neither. tests/llm runs them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
