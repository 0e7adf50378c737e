"""The queries of the training-data operators, over the tables of TESTDATA.md."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from .split import section_pieces

    return section_pieces(_read(spark, folder, "sections"), _read(spark, folder, "source_artifacts"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from .residue import residue_pages

    return residue_pages(_read(spark, folder, "source_pages")).select("page_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from .boilerplate import chrome_lines

    return chrome_lines(_read(spark, folder, "source_pages"), _read(spark, folder, "source_artifacts"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from .site_lines import repeated_lines

    return repeated_lines(_read(spark, folder, "source_pages"), exact=True)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from .neardup import similar_pairs

    return similar_pairs(_read(spark, folder, "source_pages"), threshold=0.5, n=3, least_words=100)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    from .encode import encode_corpus

    return encode_corpus(_read(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    from .leakage import leaked_passages

    return leaked_passages(_read(spark, folder, "documents"), _read(spark, folder, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    from .language import mislabelled

    return mislabelled(_read(spark, folder, "documents")).select("doc_id", "seg_no", "lang")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p5_found, p6_ids, p7_found, p8_found)}


