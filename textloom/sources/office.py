"""Documents of office formats, which are zipped XML, and files as rows.

Files are read by Spark (``binaryFile``), one row each, and parsed where they are read.  A file
that isn't of its format gives no rows; a null content none either.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _parts(content: bytes | None, name: str) -> list[ElementTree.Element]:
    """Roots of the package's parts that fit ``name``, by their number."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            found = sorted((int(m[1] or 0), m[0]) for m in (re.fullmatch(name, n) for n in z.namelist()) if m)
            return [ElementTree.fromstring(z.read(n)) for _, n in found]
    except (zipfile.BadZipFile, ElementTree.ParseError):
        return []


def word_paragraphs(content: bytes | None) -> Iterator[tuple[int, str]]:
    """Heading level (0: none) and text of each paragraph with text."""
    for root in _parts(content, r"word/document()\.xml"):
        for p in root.iter(f"{_W}p"):
            text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
            style = p.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"[Hh]eading ?(\d)", style.get(f"{_W}val", "") if style is not None else "")
            if text:
                yield int(level[1]) if level else 0, text


def word_sections(content: bytes | None) -> Iterator[tuple[str, str]]:
    """Path of headings, joined by `` > ``, and the text under it, in order; a heading without text gives nothing."""
    path: list[tuple[int, str]] = []
    lines: list[str] = []
    for level, text in [*word_paragraphs(content), (1, "")]:
        if not level:
            lines.append(text)
            continue
        if lines:
            yield " > ".join(t for _, t in path), "\n".join(lines)
            lines = []
        path = [x for x in path if x[0] < level] + [(level, text)]


def slide_texts(content: bytes | None) -> Iterator[tuple[int, str]]:
    """Number from 1 and text of each slide, a line a paragraph."""
    for k, root in enumerate(_parts(content, r"ppt/slides/slide(\d+)\.xml"), 1):
        lines = ("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in root.iter(f"{_A}p"))
        yield k, "\n".join(x for x in lines if x)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modificationTime, length, content of the files below ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def listing(spark: SparkSession, path: str, part: str = "", by: str = "name", ascending: bool = True, page: int = 1, size: int = 20) -> DataFrame:
    """A page of name, length, modificationTime; ``part`` of the name in any case; contents aren't read."""
    rows = files(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime")
    order = F.col(by).asc() if ascending else F.col(by).desc()
    return rows.where(F.contains(F.lower("name"), F.lit(part.lower()))).orderBy(order, "name").offset((page - 1) * size).limit(size)


def _parsed(rows: DataFrame, parse, names: tuple[str, str], schema: str) -> DataFrame:
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                found = pd.DataFrame(list(parse(content)), columns=list(names))
                yield found.assign(path=path, position=range(len(found)))

    return rows.select("path", "content").mapInPandas(task, schema)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, position, headings, content of every section."""
    return _parsed(files(spark, path, "*.docx"), word_sections, ("headings", "content"), "path string, position long, headings string, content string")


def read_pptx(spark: SparkSession, path: str) -> DataFrame:
    """path, position, slide, content of every slide."""
    return _parsed(files(spark, path, "*.pptx"), slide_texts, ("slide", "content"), "path string, position long, slide long, content string")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, content of text and markdown files, each whole."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{txt,md}")
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def kind(path: Column) -> Column:
    """Which reader takes a file, by its extension in any case; null for others."""
    end = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(end.isin(".txt", ".md"), "text").when(end == ".docx", "docx").when(end == ".pptx", "pptx")
