"""Files as sections: a binary scan, parsed on the executors; what can't be read is a row with its reason."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 100 << 20
#: Extensions read as plain text.
TEXT = set(
    "txt md markdown mdx rst text log csv tsv json jsonl yaml yml toml xml html htm rs py js ts tsx jsx go java c h cpp hpp rb php sh sql tex".split()
)
SCHEMA = "source string, section_idx int, text string, page int, heading string, error string"


def decode(data: bytes) -> str:
    if b"\0" in data[:8192]:
        raise ValueError("binary content")
    return data.decode("utf-8", "replace")


def _cells(row: ET.Element, tag: str) -> str:
    return " | ".join(" ".join(t.text or "" for t in c.iter() if t.tag.endswith("}t")).strip() for c in row.iter() if c.tag.endswith(tag))


def docx(data: bytes) -> Iterator[tuple[str, int | None, str | None]]:
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    heading = None
    body = next(e for e in root if e.tag.endswith("}body"))
    for e in body:
        if e.tag.endswith("}p"):
            text = "".join(t.text or "" for t in e.iter() if t.tag.endswith("}t"))
            style = next((v for s in e.iter() if s.tag.endswith("}pStyle") for v in s.attrib.values()), "")
            if "heading" in style.lower():
                heading = text
            yield text, None, heading
        elif e.tag.endswith("}tbl"):
            yield "\n".join(_cells(r, "}tc") for r in e.iter() if r.tag.endswith("}tr")), None, heading


def pptx(data: bytes) -> Iterator[tuple[str, int | None, str | None]]:
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for number, name in slides:
        yield " ".join(t.text or "" for t in ET.fromstring(z.read(name)).iter() if t.tag.endswith("}t")), number, None


def xlsx(data: bytes) -> Iterator[tuple[str, int | None, str | None]]:
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter() if t.tag.endswith("}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))]
    names = [s.attrib["name"] for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if s.tag.endswith("}sheet")]
    for n, name in enumerate(names, 1):
        rows = []
        for r in ET.fromstring(z.read(f"xl/worksheets/sheet{n}.xml")).iter():
            if r.tag.endswith("}row"):
                cells = []
                for c in r:
                    v = next((x.text or "" for x in c.iter() if x.tag.endswith("}v") or x.tag.endswith("}t")), "")
                    cells.append(shared[int(v)] if c.attrib.get("t") == "s" and v else v)
                rows.append(" | ".join(cells))
        yield "\n".join(rows), None, name


def parse(path: str, data: bytes) -> list[tuple[str, int | None, str | None]]:
    ext = path.rpartition(".")[2].lower()
    reader = {"docx": docx, "pptx": pptx, "xlsx": xlsx}.get(ext)
    if reader is None and ext not in TEXT:
        raise ValueError(f"unsupported extension {ext!r}")
    got = [s for s in (reader(data) if reader else [(decode(data), None, None)]) if s[0].strip()]
    if not got:
        raise ValueError("no text")
    return got


def read_folder(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Sections of every file under ``path``; skipped files have ``error`` and no text."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(path).select("path", F.when(F.col("length") <= MAX_BYTES, F.col("content")).alias("content"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for name, data in zip(f["path"], f["content"], strict=True):
                try:
                    if data is None:
                        raise ValueError("too large")
                    rows += [(name, i, t, p, h, None) for i, (t, p, h) in enumerate(parse(name, bytes(data)))]
                except Exception as e:  # noqa: BLE001  one bad file mustn't stop the others
                    rows.append((name, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["source", "section_idx", "text", "page", "heading", "error"]).astype(object).where(lambda x: x.notna(), None)

    return files.mapInPandas(run, SCHEMA)
