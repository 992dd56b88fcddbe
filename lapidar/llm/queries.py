"""Queries of the problems on training texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lapidar.llm import bpe, language, leaks, pages, residue, sentences
from lapidar.runtime import spread, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "timeml_docs").select("tml_id", "text"))
    return sentences.sentence_units(docs).select("tml_id", "start_pos", "end_pos")


def p2_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "timeml_docs").select("tml_id", "text"))
    return sentences.sentence_units(docs)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.ScannedPages(spread(table(spark, sf_dir, "scan_pages").select("page_id", "doc", "page_no", "text"))).defects()


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.ScannedPages(spread(table(spark, sf_dir, "scan_pages").select("page_id", "doc", "page_no", "text"))).paragraphs()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "languages", "source"))
    return language.unlabelled_paragraphs(docs, residue.residue(docs))


def p4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "languages"))
    return language.document_languages(language.paragraph_languages(docs))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_ids(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leaks.leaked(docs, table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))).select("doc_id")


QUERIES = {"p2_found": p2_found, "p2_sentences": p2_sentences, "p3_found": p3_found, "p3_paragraphs": p3_paragraphs, "p4_found": p4_found, "p4_documents": p4_documents, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}
ORACLES: dict = {}
