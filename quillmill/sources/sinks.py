"""Sinks: reports, the library file, dictionaries and lookup caches."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import knowledge
from ..operators.posts import COLUMNS
from .reports import save_report


def _field(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def markdown_rows(rows: DataFrame, order: str) -> DataFrame:
    """(seq, value): a section of a Markdown report for each row."""
    own = [c for c in rows.columns if c != order]
    parts = [F.concat(F.lit("## "), _field(COLUMNS["title"])) if COLUMNS["title"] in own else F.lit("##")]
    for c in own:
        if c == COLUMNS["content"]:
            parts.append(F.concat(F.lit(f"### {c}\n\n"), text.markdown_content(F.col(c))))
        elif c != COLUMNS["title"]:
            parts.append(F.concat(F.lit(f"- **{c}**: "), _field(c)))
    return rows.select(F.col(order).alias("seq"), F.concat(F.concat_ws("\n\n", *parts), F.lit("\n\n---\n")).alias("value"))


def text_rows(rows: DataFrame, order: str) -> DataFrame:
    """(seq, value): a section of a plain report for each row, between lines of 80 signs."""
    own = [c for c in rows.columns if c != order]
    body = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), _field(c)) for c in own])
    return rows.select(F.col(order).alias("seq"), F.concat(F.lit("=" * 80 + "\n"), body, F.lit("\n")).alias("value"))


def save_markdown(rows: DataFrame, path: str, order: str = "seq") -> None:
    save_report(markdown_rows(rows, order), "# Report\n\nRows: {rows}\n", path, "md")


def save_text(rows: DataFrame, path: str, order: str = "seq") -> None:
    save_report(text_rows(rows, order), "Rows: {rows}", path, "txt")


def save_excel(rows: DataFrame, path: str, order: str = "seq", most: int = 1_000_000) -> None:
    """One sheet with wrapped cells and links; a sheet has a bounded number of rows, so more
    than most are refused. Needs xlsxwriter."""
    try:
        import xlsxwriter
    except ImportError as e:
        raise RuntimeError("writing spreadsheets needs the xlsxwriter package") from e
    found = rows.orderBy(order).drop(order).limit(most + 1).toPandas()
    if len(found) > most:
        raise ValueError("too many rows for a sheet; save as Parquet or CSV")
    with xlsxwriter.Workbook(path) as book:
        sheet, wrap, link = book.add_worksheet(), book.add_format({"text_wrap": True, "valign": "top"}), book.add_format({"font_color": "blue", "underline": 1})
        for k, c in enumerate(found.columns):
            sheet.write_string(0, k, c)
            sheet.set_column(k, k, 80 if c == COLUMNS["content"] else 24)
            for i, v in enumerate(found[c].fillna("").astype(str)):
                if v.startswith(("http://", "https://")):
                    sheet.write_url(i + 1, k, v, link)
                else:
                    sheet.write_string(i + 1, k, v, wrap)


def save_parquet(rows: DataFrame, path: str, order: str = "seq") -> None:
    rows.write.mode("overwrite").parquet(path)


def save_csv(rows: DataFrame, path: str, order: str = "seq") -> None:
    """Quoted fields with a header; line breaks stay in their fields."""
    rows.orderBy(order).drop(order).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


#: Names of formats, any case.
WRITERS: dict[str, Callable[..., None]] = {"xlsx": save_excel, "excel": save_excel, "md": save_markdown, "markdown": save_markdown, "txt": save_text, "text": save_text, "csv": save_csv, "parquet": save_parquet}


def day_path(root: str, kind: str, at: datetime) -> str:
    return f"{root}/{at:%Y/%m/%d}/{kind}"


def file_stem(name: str, at: datetime) -> str:
    return f"{name}_{at:%Y%m%d_%H%M%S}"


def export(rows: DataFrame, root: str, name: str, formats: list[str], order: str = "seq", at: datetime | None = None) -> dict[str, str]:
    """rows in each format under a folder of the day; the paths written."""
    at, out = at or datetime.now(), {}
    for f in dict.fromkeys(x.strip().lower() for x in formats):
        if f not in WRITERS:
            raise ValueError(f"unknown format {f}")
        path = f"{day_path(root, f, at)}/{file_stem(name, at)}" + (".xlsx" if f in ("xlsx", "excel") else "")
        WRITERS[f](rows, path, order)
        out[f] = path
    return out


def save_library(found: DataFrame, path: str) -> None:
    """The library as one JSON document, for programs that read one; empty fields are left out."""
    knowledge.library(found).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def save_library_rows(found: DataFrame, path: str) -> None:
    """The library as JSON lines in the order of kinds and places, for libraries of any size."""
    knowledge.library_rows(found).orderBy("kind", "place").write.mode("overwrite").json(path)


def add_companies(known: DataFrame, new: DataFrame, path: str) -> DataFrame:
    """Append organisations that the dictionary at path lacks; returns those added."""
    added = new.select("company").distinct().join(known, "company", "left_anti").persist()
    added.write.mode("append").parquet(path)
    return added
