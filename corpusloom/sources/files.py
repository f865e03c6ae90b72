"""Uploaded files: which are accepted, and reading them."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import markup
from corpusloom.functions import text as tx

# Supported file endings.
SUPPORTED = (".pdf", ".docx", ".pptx", ".html", ".htm", ".png", ".jpg", ".jpeg")
# Endings whose content this library turns into text itself.
MARKUP = (".html", ".htm")
# Characters that are escaped in the name of a folder of one value, and the name for an empty one, as Spark's writer has them.
ESCAPED = "[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """Lower-cased ending of the last path part; a leading dot is no ending."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def admit(names: DataFrame, name: str = "filename") -> DataFrame:
    """Add ``file_type``, ``accepted`` and ``error``; nothing is dropped."""
    given = F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("unknown"))
    typed = names.withColumn(name, given).withColumn("file_type", suffix(F.col(name)))
    accepted = F.col("file_type").isin(*SUPPORTED)
    return typed.withColumn("accepted", accepted).withColumn(
        "error", F.when(~accepted, F.concat(F.lit("Unsupported file type: "), F.col("file_type")))
    )


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, filename, content`` of the files below a folder.

    Folders named ``filename=...`` give the name of the file they hold, as
    :func:`write_files` lays them out; any other file has its own name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    folder = F.regexp_extract("path", r"/filename=([^/]*)/[^/]*$", 1)
    named = F.when(folder != "", F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))).otherwise(base_name(F.col("path")))
    return files.select("path", named.alias("filename"), "content")


def write_files(rows: DataFrame, path: str, name: str = "filename", content: str = "content") -> None:
    """One text file per row of unique ``name``, in a folder of that name, written by the tasks.

    For drop folders and tests; a line feed is put behind each content. Rows
    without a name or content are left out. Files below a folder that all machines have mounted
    are written by plain calls, as Hadoop's local file system starts three processes a file; others by Spark's writer.
    """
    kept = rows.where(F.col(name).isNotNull() & F.col(content).isNotNull())
    named = kept.select(F.col(content).alias("value"), F.col(name).alias("filename")).repartition("filename")
    mounted = mounted_path(rows.sparkSession, path)
    if mounted is None:
        named.write.partitionBy("filename").option("compression", "none").text(path)
        return
    os.makedirs(mounted)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Contents of one name follow each other, and are one file.
        now = out = None
        hidden = f".{uuid.uuid4().hex}"

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, os.path.join(os.path.dirname(out.name), "part-00000.txt"))

        for batch in batches:
            for value, filename in zip(batch["value"].cast(pa.binary()), batch["filename"].to_pylist()):
                if filename != now:
                    close()
                    folder = re.sub(ESCAPED, lambda m: f"%{ord(m[0]):02X}", filename) or NO_VALUE
                    folder = os.path.join(mounted, f"filename={folder}")
                    os.makedirs(folder, exist_ok=True)
                    now, out = filename, open(os.path.join(folder, hidden), "wb")
                out.write(value.as_buffer())
                out.write(b"\n")
        close()
        yield from ()

    named.sortWithinPartitions("filename").mapInArrow(write, "done long").write.format("noop").mode("overwrite").save()


def mounted_path(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system has it, if it is one of Hadoop's local file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return at.toUri().getPath() if system.getUri().getScheme() == "file" else None


def parse_markup(files: DataFrame, as_markdown: bool = False) -> DataFrame:
    """Text of accepted HTML files, plain or as Markdown; other formats need an
    outside parser and keep a null text together with an error."""
    admitted = admit(files)
    html = F.col("accepted") & F.col("file_type").isin(*MARKUP)
    shown = F.decode("content", "UTF-8")
    text = markup.markdown(markup.blocks(shown)) if as_markdown else tx.main_text(shown)
    return admitted.select(
        "filename",
        "file_type",
        F.lit(None).cast("int").alias("num_pages"),
        F.when(html, text).alias("text"),
        F.coalesce(
            F.col("error"), F.when(~html, F.concat(F.lit("No parser for "), F.col("file_type")))
        ).alias("error"),
    )
