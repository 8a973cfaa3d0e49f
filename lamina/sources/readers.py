"""Readers of the pipeline's files (S1-S10, S17): JSON lines, CSV, page JSON, ontology, bytes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lamina.functions import text as t

SENTENCE = "source_pdf string, page int, sentence_index int, text string, labels array<string>, scores map<string,double>, esg boolean"
OBSERVATION = "struct<value:string,unit:string,kind:string,direction:string,year:string,target_year:string,baseline_year:string,source_id:string,snippet:string>"


def labeled_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines below ``path`` as they are, with the file's path relative to it; what is no JSON is in ``_corrupt_record``."""
    raw = spark.read.schema(f"{SENTENCE}, _corrupt_record string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(path)
    base = path.split("://")[-1].split(":", 1)[-1].rstrip("/")
    return raw.withColumn("source_file", F.regexp_replace("_metadata.file_path", rf"^.*?\Q{base}\E/", ""))


def labeled_sentences(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines below ``path`` with the defaults of missing fields and the file they came from; broken lines are left to ``broken_lines``."""
    return labeled_lines(spark, path).filter("_corrupt_record is null").select(
        F.coalesce("source_pdf", F.lit("unknown.pdf")).alias("source_pdf"), F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("sentence_index", F.lit(0)).alias("sentence_index"),
        F.coalesce("text", F.lit("")).alias("text"), "labels", "scores", F.coalesce("esg", F.lit(False)).alias("esg"), "source_file",
    )


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line) of the lines below ``path`` that aren't JSON, to be set aside."""
    return labeled_lines(spark, path).filter("_corrupt_record is not null").select("source_file", F.coalesce("_corrupt_record", "text").alias("line"))  # a query may not read that column alone


def pages(spark: SparkSession, path: str, reader: Callable[[bytes], list[str]], suffix: str = ".pdf") -> DataFrame:
    """(source_pdf, page, text) of one file or all files below a folder, in order of their names; ``reader`` gives the
    texts of a file's pages (a library that reads PDF). Pages are cleaned and blank ones dropped; a file that can't be read gives none."""

    def run(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["name"], pdf["content"]):
                try:
                    rows += [(name, k, x) for k, x in enumerate(reader(bytes(content)), 1)]
                except Exception:  # listed by the caller's anti join of files and pages
                    pass
            yield pd.DataFrame(rows, columns=["source_pdf", "page", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    told = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content").mapInPandas(run, "source_pdf string, page int, text string")
    return told.withColumn("text", t.clean_page(F.col("text"))).filter("text <> ''")


def validated_triples(spark: SparkSession, path: str) -> DataFrame:
    """The triples of a JSON array."""
    end = "struct<class:string,properties:map<string,string>>"
    return spark.read.schema(f"subject {end}, predicate string, object {end}, temporal_metadata map<string,string>").option("multiLine", True).json(path)


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, bytes, sha256) of the files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines or CSV by the file's suffix."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).schema("source_pdf string, page int, sentence_index int, text string").csv(path)
    return labeled_sentences(spark, path)


def page_kpis(spark: SparkSession, path: str) -> DataFrame:
    """Indicators per page; the page number comes from the file's name; a file that can't be read gives a row of nulls."""
    schema = f"kpi_type string, title string, observations array<{OBSERVATION}>, doc_name string"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "page_*_kpis.json").json(path)
    return raw.withColumn("page", F.regexp_extract(F.col("_metadata.file_name"), r"page_(\d+)_kpis\.json$", 1).try_cast("int"))


def page_graphs(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with their format: graph, triple_array, unknown or error."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    v = F.try_parse_json("value")
    kind = (
        F.when(v.isNull(), "error")
        .when(F.try_variant_get(v, "$.nodes", "array<variant>").isNotNull() & F.try_variant_get(v, "$.edges", "array<variant>").isNotNull(), "graph")
        .when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), "triple_array")
        .otherwise("unknown")
    )
    return raw.select(F.col("_metadata.file_name").alias("file"), kind.alias("format"), "value")


def input_pages(files: DataFrame) -> DataFrame:
    """Page files, without those that later steps wrote."""
    return files.filter(F.col("file").startswith("page") & ~F.col("file").rlike(r"_(validated|bugged|fixed|unfixable|malformed)\.json$"))


def decode_bytes(content: Column) -> Column:
    """UTF-8, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def unwrap_redirect(url: Column) -> Column:
    """The address inside a search engine's link: uddg=, or u=a1 and base64; else the link itself."""
    ddg = F.try_url_decode(F.regexp_extract(url, r"[?&]uddg=([^&]+)", 1))
    b64 = F.regexp_replace(F.translate(F.regexp_extract(url, r"[?&]u=a1([^&]+)", 1), "-_", "+/"), "=+$", "")
    padded = F.rpad(b64, (F.ceil(F.length(b64) / 4) * 4).cast("int"), "=")
    bing = F.when(b64 != "", F.try_to_binary(padded, F.lit("base64")).cast("string"))
    return F.coalesce(F.when(ddg != "", ddg), F.when(bing.startswith("http"), bing), url)

