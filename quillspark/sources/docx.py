"""DOCX files: scan, ordered blocks, rendered text.

Files are listed and filtered by path before any content is read. Parsing takes the standard
library's zip and XML readers; rendering stays in SQL.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.documents import with_suffix

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

# What stands around tables and before texts of images.
TABLE = "\n---\n**Table:**\n"
TABLE_END = "\n---\n"
IMAGE = "\n📷 **Image Text:**\n> "

BLOCKS = "array<struct<kind:string,style:string,listed:boolean,text:string,cells:array<array<string>>>>"


def no_ocr(image: bytes) -> str:
    """The offline default reads nothing."""
    return ""


def _paragraph_text(p: ElementTree.Element) -> str:
    out = []
    for x in p.iter():
        if x.tag == W + "t":
            out.append(x.text or "")
        elif x.tag == W + "tab":
            out.append("\t")
        elif x.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out)


def _cells(row: ElementTree.Element, above: list[str]) -> list[str]:
    """Texts of a row's grid cells; merged cells repeat their text."""
    out: list[str] = []
    for c in row.findall(W + "tc"):
        text = "\n".join(_paragraph_text(p) for p in c.findall(W + "p")).strip().replace("\n", " ")
        props = c.find(W + "tcPr")
        span = props.find(W + "gridSpan") if props is not None else None
        merge = props.find(W + "vMerge") if props is not None else None
        if merge is not None and merge.get(W + "val") != "restart" and len(out) < len(above):
            text = above[len(out)]
        out += [text] * int(span.get(W + "val") if span is not None else 1)
    return out


def parse_blocks(content: bytes, ocr: Callable[[bytes], str] = no_ocr, skip_images_of_blank: bool = False) -> list[dict]:
    """Body blocks in order: paragraphs (p), images with recognised text (image) and tables (table)."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = set(z.namelist())
    styles: dict[str, str] = {}
    if "word/styles.xml" in names:
        for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(W + "style"):
            name = s.find(W + "name")
            styles[s.get(W + "styleId", "")] = name.get(W + "val", "") if name is not None else ""
    targets: dict[str, str] = {}
    if "word/_rels/document.xml.rels" in names:
        targets = {r.get("Id", ""): r.get("Target", "") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}
    out: list[dict] = []
    put = lambda kind, text="", style="", listed=False, cells=None: out.append({"kind": kind, "style": style, "listed": listed, "text": text, "cells": cells or []})
    for x in ElementTree.fromstring(z.read("word/document.xml")).find(W + "body") or ():
        if x.tag == W + "p":
            raw = _paragraph_text(x)
            text, props = raw.strip(), x.find(W + "pPr")
            style = props.find(W + "pStyle") if props is not None else None
            own = style.get(W + "val", "") if style is not None else ""
            put("p" if text else "blank", text, styles.get(own, own).lower(), props is not None and props.find(W + "numPr") is not None)
            if text or not skip_images_of_blank:
                for blip in x.iter(A + "blip"):
                    target = targets.get(blip.get(R + "embed", ""))
                    name = f"word/{target}" if target and not target.startswith("/") else (target or "").lstrip("/")
                    if name in names:
                        try:
                            found = ocr(z.read(name)).strip()
                        except Exception:  # noqa: BLE001  an unreadable image says nothing
                            found = ""
                        if found:
                            put("image", found)
        elif x.tag == W + "tbl":
            rows: list[list[str]] = []
            for r in x.findall(W + "tr"):
                rows.append(_cells(r, rows[-1] if rows else []))
            put("table", cells=rows)
    return out


def package(blocks_: list[dict]) -> bytes:
    """A DOCX file of paragraphs and tables: what :func:`parse_blocks` reads, with or without style and list mark."""
    ElementTree.register_namespace("w", W[1:-1])
    document = ElementTree.Element(W + "document")
    body = ElementTree.SubElement(document, W + "body")
    names: dict[str, str] = {}

    def paragraph(parent: ElementTree.Element, text: str, style: str = "", listed: bool = False) -> None:
        p = ElementTree.SubElement(parent, W + "p")
        if style or listed:
            props = ElementTree.SubElement(p, W + "pPr")
            if style:
                ElementTree.SubElement(props, W + "pStyle", {W + "val": names.setdefault(style, f"S{len(names)}")})
            if listed:
                ElementTree.SubElement(props, W + "numPr")
        run = ElementTree.SubElement(p, W + "r")
        for i, line in enumerate(text.split("\n")):
            if i:
                ElementTree.SubElement(run, W + "br")
            ElementTree.SubElement(run, W + "t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"}).text = line

    for b in blocks_:
        if b["kind"] == "table":
            table = ElementTree.SubElement(body, W + "tbl")
            for row in b["cells"]:
                line = ElementTree.SubElement(table, W + "tr")
                for cell in row:
                    paragraph(ElementTree.SubElement(line, W + "tc"), cell)
        else:
            paragraph(body, b["text"] or "", b["style"] or "", bool(b["listed"]))
    ElementTree.SubElement(body, W + "sectPr")
    styles = ElementTree.Element(W + "styles")
    for name, own in names.items():
        ElementTree.SubElement(ElementTree.SubElement(styles, W + "style", {W + "styleId": own}), W + "name", {W + "val": name})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/styles.xml", ElementTree.tostring(styles))
        z.writestr("word/document.xml", ElementTree.tostring(document))
    return out.getvalue()


def packaged(rows: DataFrame, blocks_: str = "blocks") -> DataFrame:
    """``rows`` with the DOCX file of their blocks as content instead."""
    keep = [f for f in rows.schema if f.name != blocks_]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", content binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns=blocks_).assign(content=[package([{**b, "cells": [list(r) for r in b["cells"]]} for b in x]) for x in pdf[blocks_]])

    return rows.select(*(f.name for f in keep), blocks_).mapInPandas(run, schema)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """DOCX files below ``folder``: file_path, file_name, folder and content; none if there is no such folder.

    The coarse glob works on listing; the exact test is on the lower-cased name.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "file_path string, file_name string, folder string, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(folder)
    named = files.withColumn("file_name", T.base_name(F.col("path")))
    root = folder.split("://", 1)[-1] if "://" in folder else folder.removeprefix("file:")
    return with_suffix(named, ".docx").select(F.col("path").alias("file_path"), "file_name", T.folder_of(F.col("path"), root).alias("folder"), "content")


def blocks(files: DataFrame, ocr: Callable[[bytes], str] = no_ocr, skip_images_of_blank: bool = False) -> DataFrame:
    """``files`` with blocks and error instead of content; a file that can't be read has an error and no blocks."""
    keep = [f for f in files.schema if f.name != "content"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + f", blocks {BLOCKS}, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found, errors = [], []
            for content in pdf["content"]:
                try:
                    found.append(parse_blocks(content, ocr, skip_images_of_blank))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  one bad file is one row with an error
                    found.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.drop(columns="content").assign(blocks=found, error=errors)

    return files.mapInPandas(run, schema)


def flat_text(blocks_: Column) -> Column:
    """Paragraphs only, blank ones too, a line each."""
    plain = F.filter(blocks_, lambda b: b["kind"].isin("p", "blank"))
    return F.array_join(F.transform(plain, lambda b: b["text"]), "\n")


def render(blocks_: Column) -> Column:
    """Text with marks: headings, list items, image texts and tables, in order; at most one empty line between."""

    def one(b: Column) -> Column:
        level = F.greatest(F.coalesce(F.expr("1") * F.nullif(F.regexp_extract(b["style"], r"\d+", 0), F.lit("")).try_cast("int"), F.lit(1)), F.lit(0))
        heading = F.concat(F.lit("\n"), F.repeat(F.lit("#"), level), F.lit(" "), b["text"], F.lit("\n"))
        rows = F.array_join(F.transform(b["cells"], lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))), "\n")
        return (
            F.when(b["kind"] == "table", F.concat_ws("\n", F.lit(TABLE), F.when(F.size(b["cells"]) > 0, rows), F.lit(TABLE_END)))
            .when(b["kind"] == "image", F.concat(F.lit(IMAGE), b["text"], F.lit("\n")))
            .when(b["style"].contains("heading"), heading)
            .when(b["listed"], F.concat(F.lit("- "), b["text"]))
            .otherwise(b["text"])
        )

    shown = F.filter(blocks_, lambda b: b["kind"] != "blank")
    return F.regexp_replace(F.array_join(F.transform(shown, one), "\n"), r"\n{3,}", "\n\n")


def extract(files: DataFrame, **options: object) -> DataFrame:
    """file_name, text and error of scanned files; of files of one name the last by path counts."""
    from quillspark.operators.documents import latest_by_name

    read = blocks(files.select("file_name", "file_path", "content"), **options)
    texts = read.select("file_name", "file_path", render(F.col("blocks")).alias("text"), "error")
    # After parsing, so that texts are shuffled and never the files.
    return latest_by_name(texts, "file_name", "file_path")
