"""Queries pN_ of the operators for training data, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolane.llm import credentials, encode, encoding_repair, packing, splitting, syntax
from topolane.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.defects(table(spark, sf, "source_files")).select("file_id").distinct()


def p1_defects(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.defects(table(spark, sf, "source_files"))


def p1_rates(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "source_files")
    return syntax.rates(files, syntax.defects(files))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    files = credentials.in_files(table(spark, sf, "source_files"))
    return files.unionByName(credentials.in_records(table(spark, sf, "hook_records")))


def p2_masked_files(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.masked(table(spark, sf, "source_files").select("file_id", "content"), "content")


def p2_masked_records(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.masked_records(table(spark, sf, "hook_records").select("record_id", "raw"))


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "evidence").select("evidence_key", "record_kind", "text")
    done = splitting.split(rows, table(spark, sf, "size_limits"))
    return done.select("evidence_key", "max_size", "overlap_size", F.explode("pieces").alias("p")).select("evidence_key", "max_size", "overlap_size", "p.*")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "evidence").select("evidence_key", "record_kind", "text")
    return splitting.split(rows, table(spark, sf, "size_limits")).where(splitting.was_cut()).select("evidence_key")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", encode.encode(F.col("text")).alias("ids"))


def _packed(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    # One row of a table of a few rows.
    capacity = table(spark, sf, "size_limits").where("applies_to = 'documents:packing'").agg(F.min("max_size")).first()[0]
    sized = table(spark, sf, "documents").select("doc_id", encode.count_tokens(F.col("text")).alias("n_tokens"))
    return packing.pack(sized, capacity), capacity


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)[0].select("container_id", "doc_id", "piece", "piece_size", "container_fill")


def p7_utilisation(spark: SparkSession, sf: str) -> DataFrame:
    return packing.utilisation(*_packed(spark, sf))


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").select("doc_id", "source", F.col("doc_kind").alias("kind"), "text")
    return docs, encoding_repair.judge(docs)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return encoding_repair.garbled(_judged(spark, sf)[1])


def p8_restored(spark: SparkSession, sf: str) -> DataFrame:
    return encoding_repair.restored(*_judged(spark, sf)).select("doc_id", "repaired", "n_units", "n_lost")


QUERIES = {
    "p1_found": p1_found, "p1_defects": p1_defects, "p1_rates": p1_rates,
    "p2_found": p2_found, "p2_masked_files": p2_masked_files, "p2_masked_records": p2_masked_records,
    "p3_found": p3_found, "p3_pieces": p3_pieces, "p6_ids": p6_ids, "p7_containers": p7_containers, "p7_utilisation": p7_utilisation, "p8_found": p8_found, "p8_restored": p8_restored,
}

_ESTIMATE = r"((greatest((strlen(text) + 2) // 3, len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\s\p{L}\p{N}\p{M}_\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'))) * 105 + 99) // 100)"

ORACLE = {
    "p3_found": f"SELECT evidence_key FROM evidence e JOIN size_limits l ON l.applies_to = 'evidence:' || e.record_kind WHERE {_ESTIMATE} > l.max_size",
}
