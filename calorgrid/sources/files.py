"""File listings, reports and manifests."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from calorgrid.functions.text import capture_name

WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def list_files(spark: SparkSession, root: str, suffixes: Sequence[str] = ("jpg", "jpeg")) -> DataFrame:
    """``path, folder, name, image, sample, role, length`` of the files below ``root`` with one of the suffixes, any case; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    f = f.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*[s.lower() for s in suffixes]))
    name = capture_name(F.col("path"))
    return f.select("path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), name["image"].alias("image"), name["sample"].alias("sample"), name["role"].alias("role"), "length")


def file_digests(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``path, sha256`` of the files below ``root``."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return f.select("path", F.sha2("content", 256).alias("sha256"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no, line`` of text files, in order."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return t.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def _paragraphs(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    texts = ("".join(t.text or "" for t in p.iter(f"{WORD_NS}t")).strip() for p in root.iter(f"{WORD_NS}p"))
    return [t for t in texts if t]


def read_docx(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """``path, line_no, line``: the paragraphs of word-processor reports, trimmed, blank ones left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                lines = _paragraphs(content)
                yield pd.DataFrame({"path": name, "line_no": range(len(lines)), "line": lines})

    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return f.select("path", "content").mapInPandas(run, "path string, line_no int, line string")


def read_manifests(spark: SparkSession, path: str, schema: str, required: Sequence[str] = (), versions: Sequence[str] = ("0.2.0", "0.1.0")) -> DataFrame:
    """JSON manifests, one document per file, with ``violations``: absent required fields and unsupported versions."""
    m = spark.read.schema(schema).option("multiLine", True).json(path)
    checks = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]
    if "schema_version" in m.columns:
        checks.append(F.when(~F.coalesce(F.col("schema_version").isin(*versions), F.lit(False)), F.lit("unsupported version")))
    return m.withColumn("violations", F.concat_ws(";", F.array_compact(F.array(*checks))) if checks else F.lit(""))


def included(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, manifest_path`` of a run summary's groups that succeeded or were cached."""
    s = spark.read.schema("groups array<struct<image_id: string, status: string, manifest_path: string>>").option("multiLine", True).json(path)
    return s.select(F.explode("groups").alias("g")).select("g.*").where(F.col("status").isin("success", "cache_hit")).select("image_id", "manifest_path")
