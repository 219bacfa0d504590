"""Reading and writing documents, term lists and reports."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import MaskError, Secret
from ..functions.detectors import Detector, build_detectors
from ..operators.pseudonymize import Result, pseudonymize, report
from . import formats


class NotFoundError(MaskError, FileNotFoundError):
    exit_code = 4


@dataclass(frozen=True)
class RunOptions:
    """How ``run`` works: where to write (nothing is overwritten in place), and what to look for."""

    output: str | None = None
    dry_run: bool = False
    sequential: bool = False
    denylist: str | None = None
    region: str = "DE"
    format: str = "auto"
    person: Detector | None = None


def read_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, text: whole files of strict UTF-8, line ends as \\n. Other bytes fail the job."""
    d = spark.read.format("binaryFile").load(paths)
    return d.select("path", F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n").alias("text"))


def read_terms(spark: SparkSession, path: str) -> list[str]:
    """Lines without blanks around them; empty ones and those that begin with # are left out."""
    line = F.trim("value")
    return [r[0] for r in spark.read.text(path).select(line.alias("t")).where("t <> '' AND t NOT LIKE '#%'").collect()]


def confined(path: str, roots: str | None = None) -> Path:
    """*path* resolved, if it lies under one of *roots* (separated as in PATH; * for anywhere; the working directory)."""
    full = Path(path).expanduser().resolve()
    if roots == "*":
        return full
    allowed = [Path(r).expanduser().resolve() for r in (roots or os.getcwd()).split(os.pathsep) if r]
    if not any(full == r or r in full.parents for r in allowed):
        raise PermissionError(f"{full} lies outside of the allowed folders")
    return full


def run(spark: SparkSession, paths: str | list[str], secret: Secret, options: RunOptions = RunOptions(), mapping: DataFrame | None = None) -> Result:
    """All files at *paths* in one job. With an output folder the texts are written there as Parquet (path, text), and
    the report beside them; a dry run writes nothing."""
    if options.format != "auto":
        formats.checked(options.format)
    docs = read_text(spark, paths)
    terms = read_terms(spark, options.denylist) if options.denylist else None
    kind = formats.format_of(F.col("path")) if options.format == "auto" else options.format
    docs = docs.withColumn("format", kind if options.format == "auto" else F.lit(kind))
    detectors = build_detectors(terms, options.region, options.person)
    result = pseudonymize(docs, secret, detectors, mapping=mapping, order="path", sequential=options.sequential, format=F.col("format"))
    if options.output and not options.dry_run:
        result.documents.select("path", "text").write.mode("errorifexists").parquet(f"{options.output}/documents")
        report(result.documents, "path", "format").write.mode("errorifexists").parquet(f"{options.output}/report")
        result.mapping.write.mode("errorifexists").parquet(f"{options.output}/mapping")
    return result
