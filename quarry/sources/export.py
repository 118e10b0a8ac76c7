"""CSV and spreadsheet sinks."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import csv_cell, strip_html_for_export

BOM = "﻿"


def books_sheet(books: DataFrame, authors: DataFrame, genres: DataFrame) -> DataFrame:
    b = books.join(authors.select(F.col("id").alias("author_id"), "author"), "author_id", "left").join(genres.select(F.col("id").alias("genre_id"), "genre"), "genre_id", "left")
    names = {
        "ID": "id", "Title": "title", "Author": "author", "Author ID": "author_id", "Death Year (AH)": "death_ah", "Century (AH)": "century_ah", "Genre": "genre",
        "Genre ID": "genre_id", "Page Count": "page_count", "Token Count": "token_count", "Corpus": "corpus", "Original ID": "original_id",
    }
    return b.select(*[F.col(c).alias(n) for n, c in names.items()], F.when(F.col("paginated"), "Yes").otherwise("No").alias("Paginated"))


def authors_sheet(rollup: DataFrame) -> DataFrame:
    # The unknown author has no id.
    rollup = rollup.withColumn("author_id", F.when(F.col("author_id") >= 0, F.col("author_id")))
    names = {"Author": "author", "Author ID": "author_id", "Death Year (AH)": "death_ah", "Book Count": "n_books", "Total Pages": "n_pages", "Genres": "genres"}
    return rollup.select(*[F.col(c).alias(n) for n, c in names.items()])


def results_sheet(enriched: DataFrame) -> DataFrame:
    return enriched.select(
        F.col("text_id").alias("Book ID"), F.col("title").alias("Title"), F.col("author").alias("Author"), F.col("death_ah").alias("Death Year (AH)"),
        F.col("century_ah").alias("Century (AH)"), F.col("genre").alias("Genre"), F.col("part_label").alias("Volume"), F.col("page_number").alias("Page"),
        F.format_number("score", 2).alias("Score"), F.substring(strip_html_for_export(F.col("body")), 1, 500).alias("Context"),
    )


def csv_lines(sheet: DataFrame) -> DataFrame:
    """The data rows as finished CSV lines, for a distributed text sink."""
    return sheet.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in sheet.columns]).alias("value"))


def write_csv(sheet: DataFrame, path: str, bom: bool = True) -> None:
    """One local file, for sheets of the size that a person opens; rows stream through the driver."""
    with Path(path).open("w", encoding="utf-8", newline="") as f:
        f.write((BOM if bom else "") + ",".join(sheet.columns))
        for row in csv_lines(sheet).toLocalIterator():
            f.write("\n" + row["value"])


def write_csv_dir(sheet: DataFrame, path: str) -> None:
    """A directory of CSV parts, for exports of any size."""
    sheet.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


#: A spreadsheet is for people: more rows than a sheet can hold are refused, not cut.
SHEET_ROWS = 1_048_575


def write_xlsx(sheets: dict[str, DataFrame], path: str, most: int = SHEET_ROWS) -> None:
    """A workbook with a sheet for each table, written without another library; rows stream through the driver."""
    if len(sheets) > 1 and len({n.casefold() for n in sheets}) < len(sheets):
        raise ValueError("names of sheets must differ")
    types, rels, books = [], [], []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (name, sheet) in enumerate(sheets.items(), 1):
            if sheet.count() > most:
                raise ValueError(f"{name} has more than {most} rows")
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'{_XML}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                f.write(_row(1, sheet.columns))
                for n, row in enumerate(sheet.toLocalIterator(), 2):
                    f.write(_row(n, row))
                f.write(b"</sheetData></worksheet>")
            types.append(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_OFFICE}.spreadsheetml.worksheet+xml"/>')
            rels.append(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>')
            books.append(f'<sheet name={quoteattr(name[:31])} sheetId="{i}" r:id="rId{i}"/>')
        z.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{"".join(books)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">{"".join(rels)}</Relationships>')
        z.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_OFFICE}.spreadsheetml.sheet.main+xml"/>{"".join(types)}</Types>')


_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "application/vnd.openxmlformats-officedocument"
#: Characters that XML can't hold.
_BARRED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _row(n: int, cells: Iterable) -> bytes:
    out = []
    for i, v in enumerate(cells):
        if v is None:
            continue
        at = (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26) + str(n)
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            out.append(f'<c r="{at}"><v>{v}</v></c>')
        else:
            out.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_BARRED.sub("", str(v)))}</t></is></c>')
    return f'<row r="{n}">{"".join(out)}</row>'.encode()
