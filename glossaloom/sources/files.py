"""Files as Spark's own file systems know them: listed by the driver, first lines read, names told."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote
from xml.etree import ElementTree

from pyspark.sql import SparkSession

READERS = 16


def listed(spark: SparkSession, paths: str | Sequence[str], *, recursive: bool = False, pattern: str = "*") -> list[str]:
    """Paths of the files that Spark would read, as they can be given to it again. Their number is what the driver plans with anyway."""
    rows = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).text(paths if isinstance(paths, str) else list(paths))
    return sorted(escaped(unquote(p)) for p in rows.inputFiles())


def escaped(path: str) -> str:
    """A path in which no character stands for others."""
    return "".join(f"\\{c}" if c in "\\{}[]*?" else c for c in path)


def unescaped(path: str) -> str:
    """A path as it is, of one in which no character stands for others."""
    out, held = "", False
    for c in path:
        held = c == "\\" and not held
        out += "" if held else c
    return out


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> Iterator[str]:
    """Lines of a file, which is read only as far as they are asked for; compressed files by their ending."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(unescaped(path))
    conf = spark._jsc.hadoopConfiguration()
    stream = at.getFileSystem(conf).open(at)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, encoding))
    try:
        while (line := reader.readLine()) is not None:
            yield line
    finally:
        reader.close()


def csv_header(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8") -> tuple[str, ...]:
    """Names in the first record of a CSV file, which may span lines; an empty file has none."""
    text = ""
    for line in lines(spark, path, encoding):
        text += line if not text else "\n" + line
        if text.count('"') % 2 == 0 and text.strip("﻿\r\n "):
            return tuple(next(csv.reader([text.lstrip("﻿")], delimiter=delimiter)))
    return ()


def by_header(spark: SparkSession, files: Sequence[str], delimiter: str = ",", encoding: str = "UTF-8") -> dict[tuple[str, ...], list[str]]:
    """Files by the names in their header; several are opened at a time."""
    with ThreadPoolExecutor(READERS) as pool:
        headers = list(pool.map(lambda f: csv_header(spark, f, delimiter, encoding), files))
    out: dict[tuple[str, ...], list[str]] = {}
    for file, header in zip(files, headers, strict=True):
        if header:
            out.setdefault(header, []).append(file)
    return out


def local_name(tag: str) -> str:
    """A tag without its namespace, be it written out or as a prefix."""
    return tag.rpartition("}")[2].rpartition(":")[2]


def first_record(parts: Iterator[str | bytes], row_tag: str | None) -> list[str]:
    """Tags of the children of the first record: the element that is asked for, or the first with children. Nothing behind it is read."""
    parser = ElementTree.XMLPullParser(["start", "end"])
    opened: list[list[str]] = []  # the children of every open element
    for part in parts:
        parser.feed(part)
        for event, element in parser.read_events():
            if event == "start":
                opened.append([])
                continue
            children, name = opened.pop(), local_name(element.tag)
            if name == row_tag or row_tag is None and children:
                return children
            if opened:
                opened[-1].append(name)
    return []


def retried(f: Callable[[bytes], str | None], content: bytes, times: int) -> str | None:
    """``f`` of the content, tried again on RuntimeError."""
    for attempt in range(times):
        try:
            return f(content)
        except RuntimeError:
            if attempt + 1 == times:
                raise
    return None
