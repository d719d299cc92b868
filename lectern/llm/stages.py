"""The stages of the corpus pipeline: operators applied to ``documents``, decisions carried out.

All stages: an empty table gives no rows; texts go on whole, whatever their length; columns that an operator
does not need travel in a struct (:func:`common.carried`), so that no name clashes with an operator's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lectern.llm.common import bounded_batches, carried, read, restored, spool, text_digest, text_or_empty, word_count
from lectern.llm.linededup import dedup_lines
from lectern.llm.mixing import mix_sized
from lectern.llm.omh import near_representatives
from lectern.llm.packing import pack
from lectern.llm.quality import fit_quality, score_quality
from lectern.llm.queries import tokenizer_path

#: words that a worker knows in a generation while it packs: the executor's heap has grown in the stages before and stays so
PACK_KNOWN = 50_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, as they are: a null or empty text is judged as an empty one."""
    bounded_batches(spark)
    network = fit_quality(docs, read(spark, sf_dir, "labels"))
    scored = score_quality(carried(docs, "doc_id", "text"), network).filter("predicted = 1")
    return restored(scored, docs.columns, ("doc_id", "text"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks of lines that stand in an earlier place of the corpus; every row stays.

    A text that loses all its lines becomes empty, a null text stays null; ``n_chars`` follows a changed text.
    """
    out = dedup_lines(carried(docs, "doc_id", "text"))
    changed = {}
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("n_removed_chunks") > 0, length).otherwise(F.col("carried.n_chars"))
    return restored(out, docs.columns, ("doc_id", "text"), **changed)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least id (null last), then least digest.

    All empty and null texts are one class. Rows equal in id and text are one document; of such rows that
    differ in other columns, the one of the least hash of all columns stays.
    """
    bounded_batches(spark)
    keys = {"known": F.col("doc_id").isNotNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "digest": text_digest()}
    kept = near_representatives(docs).select((F.col("doc_id").isNotNull()).alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "digest", "rows_alike")
    rows = carried(docs, "doc_id", "text").withColumns(keys).join(kept, ["known", "id", "digest"])
    one = rows.filter("rows_alike = 1")
    whole = F.struct("doc_id", "text", "carried")
    alike = rows.filter("rows_alike > 1").groupBy("known", "id", "digest").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("r"))
    return restored(one.select("doc_id", "text", "carried").unionByName(alike.select("r.*")), docs.columns, ("doc_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target words ask for: no time, once or twice.

    A null source is a source of its own, null text has no words. Rows alike in id, source and text share their copies.
    """
    keys = {"id": F.col("doc_id"), "of": F.col("source"), "text_hash": F.xxhash64("text")}
    sized = docs.select("doc_id", "source", word_count(text_or_empty()).alias("size"), keys["text_hash"].alias("text_hash"))
    sized = spool(sized.withColumn("h", F.xxhash64("doc_id", "size", "text_hash")))
    mixed = spool(mix_sized(sized, (3, 1, 2), 1.5, 2).select(F.col("doc_id").alias("c_id"), F.col("source").alias("c_of"), F.col("text_hash").alias("c_hash"), "copies"))
    copies = spool(mixed.groupBy("c_id", "c_of", "c_hash").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("alike")).filter("copies > 0"))
    same = F.col("id").eqNullSafe(F.col("c_id")) & F.col("of").eqNullSafe(F.col("c_of")) & (F.col("text_hash") == F.col("c_hash"))
    rows = carried(docs, "doc_id", "source", "text").withColumns(keys).join(copies, same)
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    # only rows that are repeated need to be told apart
    alone = rows.filter("alike = 1").withColumn("copy", times(F.col("copies")))
    nth = F.row_number().over(W.partitionBy("id", "of", "text_hash").orderBy(F.xxhash64("carried")))
    share = F.floor(F.col("copies") / F.col("alike")) + (F.col("nth") <= F.pmod("copies", "alike")).cast("long")
    shared = rows.filter("alike > 1").withColumn("nth", nth).withColumn("share", share).filter("share > 0").drop("nth").withColumn("copy", times(F.col("share"))).drop("share")
    return restored(alone.unionByName(shared), docs.columns, ("doc_id", "source", "text"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens; null and empty texts give their end id, repeated rows go in each."""
    bounded_batches(spark)
    return pack(docs, tokenizer_path(), known=PACK_KNOWN)
