"""Workbooks (OOXML) of the seven-column export, one a pair, made and read by executors."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.sources.files import file_name, read_files, write_files
from folioscope.sources.writers import EXPORT

#: The sheet's name, the widths of its columns and the most characters that a cell can have.
SHEET, WIDTHS, MOST = "diff_sections", (18, 22, 80, 18, 22, 80, 14), 32_767
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
#: The parts around a sheet.
PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    f'<Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPE}.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets><sheet name="{SHEET}" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_DOC}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_BARRED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿\ud800-\udfff]")


def _cell(at: str, value) -> str:
    if value is None or value != value:
        return ""
    if isinstance(value, float):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    # a cell's text: without characters that XML bars; \r would be read as \n, so it is written as a reference
    text = escape(_BARRED.sub("", str(value))[:MOST], {"\r": "&#13;"})
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def workbook(rows) -> bytes:
    """A workbook of rows in the order of EXPORT; written row by row, only its compressed form is held."""
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as parts:
        for name, part in PARTS.items():
            parts.writestr(zipfile.ZipInfo(name), _HEAD + part)
        with parts.open(zipfile.ZipInfo("xl/worksheets/sheet1.xml"), "w") as sheet:
            columns = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(WIDTHS, 1))
            sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><cols>{columns}</cols><sheetData>'.encode())
            for no, row in enumerate(itertools.chain([EXPORT], rows), 1):
                cells = "".join(_cell(f"{letter}{no}", value) for letter, value in zip("ABCDEFG", row, strict=True))
                sheet.write(f'<row r="{no}">{cells}</row>'.encode())
            sheet.write(b"</sheetData></worksheet>")
    return whole.getvalue()


def cells(content: bytes) -> list[list]:
    """The rows of the first sheet, its header too; null where a cell is missing."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as parts, parts.open("xl/worksheets/sheet1.xml") as sheet:
        for _, element in ElementTree.iterparse(sheet):
            if element.tag != f"{{{_MAIN}}}row":
                continue
            row = [None] * len(EXPORT)
            for cell in element:
                place = ord(cell.get("r")[0]) - 65
                texts = [t.text or "" for t in cell.iter(f"{{{_MAIN}}}t")]
                row[place] = "".join(texts) if cell.get("t") == "inlineStr" else float(cell.find(f"{{{_MAIN}}}v").text)
            out.append(row)
            element.clear()
    return out


def write_sheets(rows: DataFrame, path: str) -> None:
    """Export rows as workbooks in a folder, a file a pair, named by the pair.

    Spark brings a pair's rows together in their order; a task writes one workbook after another and holds one.
    """
    order = F.row_number().over(Window.partitionBy("pair_id").orderBy("diff_no")).alias("_k")
    given = rows.select(F.col("pair_id").cast("string").alias("pair_id"), "diff_no", *EXPORT).select("pair_id", *EXPORT, order)

    def run(batches):
        every = (row for batch in batches for row in zip(*(batch[c].tolist() for c in ["pair_id", *EXPORT]), strict=True))
        for pair, group in itertools.groupby(every, key=lambda row: row[0]):
            content = workbook(row[1:] for row in group)
            yield pd.DataFrame({"name": [file_name("null" if pair is None else pair, ".xlsx")], "content": [content]})

    write_files(given.mapInPandas(run, "name string, content binary"), path)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """pair_id, row_no and the columns of EXPORT of the workbooks in a folder."""

    def run(batches):
        for batch in batches:
            for key, content in zip(batch["key"], batch["content"], strict=True):
                rows = cells(content)[1:]
                yield pd.DataFrame([(key, no, *row) for no, row in enumerate(rows)], columns=["pair_id", "row_no", *EXPORT]).astype({"diff_score": "float64"})

    kinds = ", ".join(f"{c} {'double' if c == 'diff_score' else 'string'}" for c in EXPORT)
    return read_files(spark, path, ".xlsx").mapInPandas(run, f"pair_id string, row_no long, {kinds}")
