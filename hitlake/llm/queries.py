"""The thin queries of this package: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import shared_folder
from . import codes, decontaminate, grouping, html, jaccard, language, matroska, packing, periodic, substrings, toolcalls, toxicity, warc
from .oracles import ORACLES as ORACLES
from .text import held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = toxicity.train(docs.where(~held_out()), labels.where(~held_out()))
    scored = toxicity.score(docs, weights)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.order(toolcalls.link(*toolcalls.from_turns(table(spark, sf_dir, "conversations")), toolcalls.SCHEMAS))


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path or packing.default_tokenizer())


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, pages = shared_folder(spark, "warc"), table(spark, sf_dir, "pages")
    written, there = warc.write(pages, folder), pages.count()
    if written != there:
        raise RuntimeError(f"{written} records of {there} pages")
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), jaccard.Rule(k=4, percent=85))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"), window=20)


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_back(matroska.store(table(spark, sf_dir, "documents")))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_grouping(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return grouping.pack(table(spark, sf_dir, "documents"), tokenizer_path or packing.default_tokenizer())


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(table(spark, sf_dir, "documents"), tail=periodic.repeated_tail)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = found.withColumns({"best": best, "lines": lines})
    run = {"start": -F.col("best.start"), "length": F.col("best.length"), "period": -F.col("best.period"), "exponent_milli": F.floor(1000 * F.col("best.length") / -F.col("best.period"))}
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *(c.alias(n) for n, c in run.items()), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_tool_calls, op3_packing, op4_language, op5_warc, op6_jaccard, op7_decontamination, op8_substrings, op9_matroska, op10_html, op11_grouping, op12_periodic_runs, op13_vector_codes)}
