"""Reading files of the domain: one row per file in, typed rows out.

Files are listed and read by Spark's binaryFile source; a parser turns each
file's bytes into rows inside mapInPandas, so files are read in parallel and a
file that cannot be parsed gives its rows until then, or none, not a failure.
"""

from __future__ import annotations

import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8-sig", "gb18030", "latin-1")  # of tables and exchange texts
LOG_ENCODINGS = ("utf-8-sig", "latin-1")  # of log files


def decoded(content: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """Text of a file in the first encoding that fits all of it; the last one always does."""
    for e in encodings[:-1]:
        try:
            return content.decode(e)
        except UnicodeDecodeError:
            continue
    return content.decode(encodings[-1])


def number(text: str | None) -> float | None:
    """Finite number of a token; D exponents and thousands commas allowed."""
    try:
        v = float((text or "").strip().replace(",", "").replace("D", "E").replace("d", "e"))
    except ValueError:
        return None
    return v if v == v and abs(v) != float("inf") else None


def opened(path: str):
    """A readable, seekable file of any filesystem pyarrow knows."""
    where, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return where.open_input_file(name)


def parsed(spark: SparkSession, path: str | DataFrame, pattern: str, parser: Callable[[str, bytes], list[dict]], schema: str) -> DataFrame:
    """Rows that parser gives for every file under path whose name matches, or for every
    row of a table (path, content) of files read before."""
    if isinstance(path, DataFrame):
        files = path.select("path", "content")
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                try:
                    rows = parser(p, content)
                except (ValueError, IndexError, KeyError, TypeError, StopIteration, struct.error, zipfile.BadZipFile, ElementTree.ParseError):
                    rows = []
                yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, schema)


def text_lines(spark: SparkSession, path: str | DataFrame, pattern: str) -> DataFrame:
    """Lines (path, value) of text files, which split, or of a table of them."""
    if isinstance(path, DataFrame):
        return path.select("path", "value")
    return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """SRC34: files under a folder with size and time; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
