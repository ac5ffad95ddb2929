"""The registered queries of this subpackage, opN_<name>, each over its whole table, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import bloom_lm, byte_bpe, line_dedup, media, nearest, packing, resampling, secret_scan, simhash, spelling, toxicity, url_filters, warc
from lexweave.llm.common import held_out, table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document by the ranks of the 50k byte vocabulary."""
    import public_tokenizers as P

    out = byte_bpe.round_trip(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return out.withColumnRenamed("id", "doc_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page in seekable bundles and read the archives back."""
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op3_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document by the model of those outside the held-out fifth."""
    return bloom_lm.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document as 8-bit samples, read them back, sniff and measure them."""
    return media.store_and_read(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    return nearest.search(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents along the Hilbert curve into sequences of 1024 tokens."""
    import public_tokenizers as P

    return packing.pack(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles and their groups at two differing bits."""
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop the boilerplate lines of each source from its documents."""
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "lines_total", "lines_dropped")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document by compression distance, learning from labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), toxicity.FOLD).alias("held_out"), "score", "predicted")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, by rules, else by its aliases."""
    found = url_filters.judge(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weigh every document towards the benchmark's words and draw a tenth."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants among all documents' words, one word of a document in 199 misspelt."""
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), one_in=199))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    counts = [F.size(kind(k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(secret_scan.written(base), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_warc, op3_bloom_lm, op4_media, op5_multi_index, op6_packing, op7_simhash, op8_line_dedup, op9_toxicity, op10_url_filters, op11_resampling, op12_spelling, op13_secret_scan)}
ORACLE_SQL: dict[str, str] = {"op8_line_dedup": line_dedup.SQL, "op10_url_filters": url_filters.SQL, "op11_resampling": resampling.SQL, "op12_spelling": spelling.SQL}
