"""Sinks: CSV reports in a fixed column order, JSON results with counts, small tables as LaTeX."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_error


def reindexed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in this order; missing ones as null."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, bom: bool = False) -> None:
    """CSV with a header. bom: the byte order mark that spreadsheet programs look for, before the first header of each part."""
    out = reindexed(df, columns) if columns else df
    if bom and out.columns:
        out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0])
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_buffer(df: DataFrame, path: str) -> None:
    """Rows added to a compressed CSV buffer, as a long run flushes them."""
    df.write.mode("append").option("header", True).option("escape", '"').option("compression", "gzip").csv(path)


def read_buffer(spark, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').csv(path)


def _summary(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("only summary tables are formatted")
    return rows


_STYLES = (
    '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><fonts count="2"><font/><font><b/></font></fonts><fills count="5"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    + "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in ("F8CBAD", "FFE699", "C6E0B4"))
    + '</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="5"><xf/><xf fontId="1" applyFont="1"/>'
    + "".join(f'<xf fillId="{i}" applyFill="1"/>' for i in (2, 3, 4)) + "</cellXfs></styleSheet>"
)


def write_workbook(tables: dict[str, DataFrame], path: str, graded: dict[str, tuple[float, float]] | None = None, most: int = 100_000) -> None:
    """Summary tables as sheets of one xlsx file, columns as wide as their longest cell (8 to 60). graded: columns whose numbers are coloured
    low, middle or high by two bounds. Larger tables than most rows are refused: they are no spreadsheets."""
    import zipfile
    from xml.sax.saxutils import escape, quoteattr

    graded = graded or {}

    def letters(i: int) -> str:
        return (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)

    def cell(i: int, r: int, v, column: str) -> str:
        at = f'r="{letters(i)}{r}"'
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
            low, high = graded.get(column, (None, None))
            style = "" if low is None else f' s="{2 if v < low else 3 if v < high else 4}"'
            return f"<c {at}{style}><v>{v}</v></c>"
        return f'<c {at}{" s=" + chr(34) + "1" + chr(34) if r == 1 else ""} t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[" + chr(0) + "-" + chr(8) + chr(11) + chr(12) + chr(14) + "-" + chr(31) + "]", "", str(v)))}</t></is></c>'

    names = list(tables)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>")
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + f'<Relationship Id="rs" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n[:31])} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/styles.xml", _STYLES)
        for i, n in enumerate(names, 1):
            df = tables[n]
            rows = [tuple(df.columns), *map(tuple, _summary(df, most))]
            wide = "".join(f'<col min="{k}" max="{k}" width="{min(60, max(8, 2 + max(len(str(r[k - 1])) for r in rows)))}" customWidth="1"/>' for k in range(1, len(df.columns) + 1))
            body = "".join(f'<row r="{r}">' + "".join(cell(k, r, v, df.columns[k]) for k, v in enumerate(x)) + "</row>" for r, x in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cols>{wide}</cols><sheetData>{body}</sheetData></worksheet>')


def narrative(df: DataFrame, template: str, most: int = 1000) -> str:
    """One sentence per row of a summary table, by a template with the columns in braces; null is shown as n/a."""
    return "\n".join(template.format(**{k: "n/a" if v is None else v for k, v in r.asDict().items()}) for r in _summary(df, most))


def write_results(df: DataFrame, path: str, response: str) -> DataFrame:
    """Results as JSON lines under path/results, their counts under path/metadata; returns the counts."""
    df.write.mode("overwrite").json(f"{path}/results")
    back = df.sparkSession.read.json(f"{path}/results")
    counts = back.agg(F.count("*").alias("total"), F.count_if(~is_error(F.col(response))).alias("successful"), F.count_if(is_error(F.col(response))).alias("errors"))
    counts.write.mode("overwrite").json(f"{path}/metadata")
    return counts


def latex_table(df: DataFrame, most: int = 1000) -> str:
    """A summary table as LaTeX rows; refuses tables of more than most rows."""
    rows = _summary(df, most)
    esc = lambda v: "--" if v is None else str(v).replace("&", r"\&").replace("%", r"\%").replace("_", r"\_")
    body = [" & ".join(esc(v) for v in r) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\toprule", " & ".join(esc(c) for c in df.columns) + r" \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}"])
