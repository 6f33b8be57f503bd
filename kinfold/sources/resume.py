"""Resume documents: PDF files, or texts that are already extracted."""

from __future__ import annotations

import importlib.util
import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.extract import parse_resumes
from kinfold.operators.scratch import settle

from .manifest import ROWS, file_column, files_table, register

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOW = re.compile(rb"\[((?:\\.|[^\\\]])*)\]\s*TJ|\(((?:\\.|[^\\)])*)\)\s*(Tj|'|\")|(T\*|T[dDm])(?=\s)|(ET)", re.S)
_PART = re.compile(rb"\(((?:\\.|[^\\)])*)\)", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _plain(raw: bytes) -> str:
    def one(m: re.Match[bytes]) -> bytes:
        return bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1])

    return _ESCAPE.sub(one, raw).decode("cp1252", "replace")


def text_of_pdf(content: bytes) -> str | None:
    """Text of a PDF: with a library if there is one, else from its plain or
    deflated text operators.  None if it is no PDF."""
    if not content.startswith(b"%PDF"):
        return None
    if importlib.util.find_spec("pdfplumber"):
        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return "\n".join(page.extract_text() or "" for page in pdf.pages)
    rows: list[str] = [""]
    for head, body in _STREAM.findall(content):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        for many, single, how, moved, ended in _SHOW.findall(body):
            if moved or ended or how in (b"'", b'"'):
                rows.append("")
            rows[-1] += _plain(single) if single or how else "".join(_plain(p) for p in _PART.findall(many))
    return "\n".join(r for r in rows if r.strip())


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for content in batch["content"]:
            try:
                found.append(text_of_pdf(content))
            except Exception:  # one broken document must not stop the others
                found.append(None)
        yield batch.drop(columns="content").assign(text=found)


def texts(files: DataFrame) -> DataFrame:
    """(source_file, seq, text) from (source_file, seq, content): documents that
    are broken or no PDF give no row."""
    found = files.select("source_file", "seq", "content").mapInPandas(_texts, "source_file string, seq long, text string")
    return found.filter("text is not null")


def _records(raw: DataFrame, numbers: DataFrame) -> DataFrame:
    meta = F.col("_metadata")
    name = F.regexp_extract(F.try_url_decode(meta["file_name"]), r"([^/]+)$", 1)
    raw = raw.select(name.alias("source_file"), file_column(meta["file_path"]).alias("_path"), "content").join(numbers, "_path")
    return parse_resumes(texts(raw.withColumn("seq", F.shiftleft("_number", ROWS))))


def read(spark: SparkSession, files: list[tuple[int, str]]) -> DataFrame:
    """Records of all resumes; files without text give none."""
    return _records(spark.read.format("binaryFile").load([p for _, p in files]), files_table(spark, files))


def read_listed(spark: SparkSession, folder: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, (path, reason) of files without text) of the PDF files below a
    folder, whose ``listing`` is ``files``."""
    raw = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.[pP][dD][fF]").load(folder)
    found = settle(_records(raw, files.select(F.col("path").alias("_path"), F.col("number").alias("_number"))), "resumes")
    read = found.select(F.shiftright("seq", ROWS).alias("number"))
    odd = files.filter("kind = 'pdf'").join(read, "number", "left_anti")
    return found, odd.select("path", F.lit("no text").alias("reason"))


register("pdf", read)
