"""Writers: JSON lines, CSV, workbooks with bounded cells, manifests."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CELL_MARKER, sanitize_xml, truncate_cell
from .readers import sheet_table

#: Characters that XML 1.0 lacks.
ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def jsonl(df: DataFrame, path: str, sort_keys: bool = False) -> int:
    """Write JSON lines and return their number, counted in what was written."""
    (df.select(*sorted(df.columns)) if sort_keys else df).write.json(path)
    return df.sparkSession.read.text(path).count()


def csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def splits(df: DataFrame, path: str) -> None:
    """One folder for each split."""
    df.write.partitionBy("split").parquet(path)


def cells(df: DataFrame, limit: int) -> DataFrame:
    """All columns as sanitized, bounded strings, with the number of cells cut."""
    clean = {c: sanitize_xml(F.col(c).cast("string")) for c in df.columns}
    cut = sum((F.when(F.length(v) > limit, 1).otherwise(0) for v in clean.values()), F.lit(0))
    return df.select(*(truncate_cell(v, limit).alias(c) for c, v in clean.items()), cut.alias("cells_cut"))


def workbook(header: list[str], rows: list[list[str]], sheet: str = "emails") -> bytes:
    """A workbook of string cells."""
    line = lambda n, r: f'<row r="{n}">' + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(x or "")}</t></is></c>' for x in r) + "</row>"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>' + "".join(line(n, r) for n, r in enumerate([header, *rows], 1)) + "</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def workbooks(df: DataFrame, batch: str, order: str, limit: int = 32_767) -> DataFrame:
    """(batch, content, n): a workbook for each batch, whose size the batch numbering bounds."""
    names = [c for c in df.columns if c not in (batch, order)]
    kept = cells(df.select(batch, order, *names), limit)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.assign(_o=pdf[order].astype("int64")).sort_values("_o")
        return pd.DataFrame([(int(rows[batch].iloc[0]), workbook(names, rows[names].values.tolist()), len(rows))], columns=["batch", "content", "n"])

    return kept.groupBy(batch).applyInPandas(build, "batch long, content binary, n long")


CHECKED = "batch long, valid boolean, row_count long, source_counts map<string, long>, truncated_cells long, errors array<string>"


def checked(content: bytes | None, header: list[str], sheet: str, sources: list[str] | None) -> dict:
    """What is wrong with one workbook, check by check, with its rows, rows for each source and cut cells."""
    out = {"row_count": 0, "source_counts": {}, "truncated_cells": 0, "errors": []}
    bad = out["errors"].append
    if not content:
        bad("no content")
        return out
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            for name in names:
                if name.endswith((".xml", ".rels")):
                    try:
                        ET.fromstring(z.read(name))
                    except ET.ParseError:
                        bad(f"{name} is no XML")
            if "xl/worksheets/sheet1.xml" not in names:
                bad("no first sheet")
            elif re.search(rb"<f[ >]", z.read("xl/worksheets/sheet1.xml")):
                bad("formulas")
    except zipfile.BadZipFile:
        bad("no zip archive")
        return out
    try:
        table = sheet_table(content, sheet)
    except (KeyError, ValueError, IndexError, AttributeError, StopIteration, ET.ParseError):
        bad("can't be read")
        return out
    if table is None:
        bad(f"no sheet {sheet}")
    elif not table:
        bad("empty sheet")
    else:
        if table[0] != header:
            bad("other header")
        for n, row in enumerate(table[1:], 2):
            out["row_count"] += 1
            if len(row) != len(header):
                bad(f"row {n}: {len(row)} cells")
                continue
            bad_cells = sum(bool(ILLEGAL.search(x)) for x in row)
            if bad_cells:
                bad(f"row {n}: characters that XML lacks")
            out["truncated_cells"] += sum(CELL_MARKER in x for x in row)
            out["source_counts"][row[-1]] = out["source_counts"].get(row[-1], 0) + 1
            if sources is not None and row[-1] not in sources:
                bad(f"row {n}: unknown source")
        if not out["row_count"]:
            bad("no rows")
        if not out["errors"] and sheet_table(workbook(table[0], table[1:], sheet), sheet) != table:
            bad("reads otherwise once written again")
    return out


def validated(df: DataFrame, header: list[str], sheet: str = "emails", sources: list[str] | None = None) -> DataFrame:
    """CHECKED for each workbook (batch, content): archive and XML, first sheet, no formulas, readable, the named sheet, header,
    cells a row, legal characters, known sources (in the last column), a row at least, and the same table once written again."""

    def run(pdfs):
        for pdf in pdfs:
            found = [checked(c, header, sheet, sources) for c in pdf["content"]]
            yield pd.DataFrame({"batch": pdf["batch"], "valid": [not f["errors"] for f in found], **{k: [f[k] for f in found] for k in ("row_count", "source_counts", "truncated_cells", "errors")}})

    return df.select("batch", "content").mapInPandas(run, CHECKED)


def manifest(df: DataFrame, source: str) -> dict[str, int]:
    """Rows for each source: a small report for the driver."""
    return {r[source]: r["n"] for r in df.groupBy(source).agg(F.count("*").alias("n")).orderBy(source).collect()}


def invalid_cells(df: DataFrame, limit: int = 32_767) -> DataFrame:
    """One row: rows, cells over the limit, cells with characters that XML lacks."""
    over = sum((F.sum(F.when(F.length(F.col(c).cast("string")) > limit, 1).otherwise(0)) for c in df.columns), F.lit(0))
    bad = sum((F.sum(F.when(sanitize_xml(F.col(c).cast("string")) != F.coalesce(F.col(c).cast("string"), F.lit("")), 1).otherwise(0)) for c in df.columns), F.lit(0))
    return df.agg(F.count("*").alias("rows"), over.cast("long").alias("too_long"), bad.cast("long").alias("unclean"))
