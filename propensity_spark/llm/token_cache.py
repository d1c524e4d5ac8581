"""Token counts with a cache of counts by content digest."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from propensity_spark.llm.common import slices, stored

CACHE = StructType([StructField("version", StringType()), StructField("digest", BinaryType()),
                    StructField("n_tokens", LongType())])


def version_digest(path: str) -> str:
    """Digest of the tokenizer's file and of the library's version: what a stored count depends on."""
    import sentencepiece
    import tokenizers

    library = sentencepiece if path.endswith(".model") else tokenizers
    with open(path, "rb") as file:
        return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + file.read()).hexdigest()


@functools.cache
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts without begin, end or added special tokens: sentencepiece for .model, tokenizers for .json."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def read_cache(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """The counts of one tokenizer version; none if the cache has not been written yet."""
    try:
        table = spark.read.schema(CACHE).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE).select("digest", "n_tokens")
    # Two runs at a time may both append a digest.
    return table.where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, cache: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096,
    normalise: Callable[[Column], Column] = lambda c: F.coalesce(c, F.lit("")),
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A text is normalised (the default makes NULL empty and changes nothing else, since white space and case count for
    most tokenizers), and the SHA-256 of its UTF-8 bytes is looked up among the digests stored for this tokenizer
    version. Texts that are not found are encoded once per distinct digest and appended to the parquet table `cache`.
    The same text many times is combined before the shuffle, and only ids, sizes and digests meet the counts, so a
    frequent text fills no task. NULL and repeated ids keep their rows. n_bytes is of the normalised text. Bytes that
    are no UTF-8 are counted as the replacement characters that stand for them. A text of any length is encoded whole.
    """
    spark, version = docs.sparkSession, version_digest(tokenizer)
    body = normalise(F.col(text))
    digest = F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest")
    keyed = stored(docs.select(F.col(doc_id).alias("id"), F.octet_length(body).cast("long").alias("n_bytes"), digest),
                   "digests")
    misses = docs.select(digest, body.alias("body")).dropDuplicates(["digest"])
    misses = misses.join(read_cache(spark, cache, version), "digest", "left_anti")
    schema = StructType(CACHE.fields[1:])

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for part in parts:
            for few in slices(part, 1):
                texts = [b.decode("utf-8", "replace") for b in few.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [few.column(0), pa.array(count(texts), pa.int64())], ["digest", "n_tokens"])

    new = misses.mapInArrow(encode, schema).select(F.lit(version).alias("version"), "digest", "n_tokens")
    new.write.mode("append").parquet(cache)
    # A table of its own, so that Spark can split a frequent digest where documents and counts meet.
    wanted = keyed.select("digest").distinct()
    counts = stored(read_cache(spark, cache, version).join(wanted, "digest", "left_semi"), "counts")
    return keyed.join(counts, "digest").select(
        F.col("id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
