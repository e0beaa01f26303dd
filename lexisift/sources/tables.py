"""Scans: corpora with fuzzy headers, result files with metadata, tables by convention."""

from __future__ import annotations

import functools
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import domain_of_path


def resolve_column(columns: list[str], target: str, mode: str = "first_word") -> str | None:
    """Name of the column meant by target: equal without regard to case, else one whose name holds the target's first word ('first_word'),
    the whole target ('whole'), or matches it as a pattern ('pattern')."""
    t = target.lower().strip()
    for c in columns:
        if c.lower().strip() == t:
            return c
    test = {"first_word": lambda c: t.split()[0] in c, "whole": lambda c: t in c, "pattern": lambda c: re.search(target, c, re.I) is not None}[mode]
    return next((c for c in columns if test(c.lower())), None)


def first_column(columns: list[str], names: list[str]) -> str | None:
    low = {c.lower(): c for c in columns}
    return next((low[n] for n in names if n in low), None)


def corpus(df: DataFrame, target: str, least: int, mode: str = "first_word") -> DataFrame:
    """df with the text column found by its header as 'text', trimmed; shorter texts than least + 1 characters and null ones go."""
    c = resolve_column(df.columns, target, mode)
    if c is None:
        return df.limit(0).withColumn("text", F.lit(None).cast("string"))
    t = F.regexp_replace(F.col(f"`{c}`").cast("string"), r"^\s+|\s+$", "")
    return df.withColumn("text", t).filter(F.length("text") > least)


def require(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Renames columns whose target is absent."""
    for old, new in aliases.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def normalised_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().strip() for c in df.columns])


def named_tables(parts: dict[str, DataFrame], prefix: str, column: str = "model") -> DataFrame:
    """One table from several whose names start with the prefix; the rest of the name becomes a column, missing columns null."""
    chosen = [df.withColumn(column, F.lit(n[len(prefix) :])) for n, df in sorted(parts.items()) if n.startswith(prefix)]
    if not chosen:
        raise ValueError(f"no table starts with {prefix}")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), chosen)


def result_files(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    """Records of all JSON result files below a folder: the file's metadata beside each result, with path and domain. Files that do not
    parse, and with kinds those of another analysis_type, are left out."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    if "results" not in raw.columns:
        return raw.limit(0)
    df = raw.withColumn("path", F.col("_metadata.file_path")).filter(F.col("results").isNotNull())
    if kinds is not None:
        df = df.filter(F.col("metadata.analysis_type").isin(*kinds))
    return df.select("path", domain_of_path(F.col("path")).alias("domain"), "metadata", F.explode("results").alias("result"))


def convention_files(spark: SparkSession, base: str, models: list[str], suffixes: list[str]) -> DataFrame:
    """Results by the naming convention base/model_SUFFIX/model_SUFFIX.json: (model, mode, and the results' fields). Files that are missing are
    no rows; with none at all the table is empty."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.sc().hadoopConfiguration()
    parts = []
    for m in models:
        for x in suffixes:
            path = f"{base}/{m}{x}/{m}{x}.json"
            if fs_path(path).getFileSystem(conf).exists(fs_path(path)):
                raw = spark.read.option("multiLine", True).json(path)
                if "results" in raw.columns:
                    raw = raw.select(F.explode("results").alias("r")).select("r.*")
                parts.append(raw.withColumns({"model": F.lit(m), "mode": F.lit(x.strip("_").lower())}))
    if not parts:
        return spark.createDataFrame([], "model string, mode string")
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def without(names: list[str], reference: str = "ground_truth") -> list[str]:
    """Names of tables but for that of the references, without regard to case."""
    return [n for n in names if n.strip().lower() != reference]


def _cell(c, shared: list[str], ns: str):
    kind, v = c.get("t"), c.find(f"{ns}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{ns}t"))
    if v is None or v.text is None:
        return None
    return shared[int(v.text)] if kind == "s" else v.text


def workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of an xlsx file by name, the first row as header, all cells as text. Workbooks are edge files of bounded size; they are read on
    the driver. A sheet that cannot be read is left out."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    out: dict[str, DataFrame] = {}
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{ns}sheet"):
            target = targets[sheet.get(rel)].lstrip("/")
            try:
                rows = []
                for r in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{ns}row"):
                    row: dict[int, str | None] = {}
                    for c in r.iter(f"{ns}c"):
                        at = functools.reduce(lambda a, x: a * 26 + ord(x) - 64, re.match("[A-Z]+", c.get("r")).group(), 0) - 1
                        row[at] = _cell(c, shared, ns)
                    rows.append(row)
            except (KeyError, ElementTree.ParseError):
                continue
            if not rows:
                continue
            cols = [i for i, h in sorted(rows[0].items()) if h]
            kind = ", ".join(f"`{rows[0][i]}` string" for i in cols)
            out[sheet.get("name")] = spark.createDataFrame([tuple(r.get(i) for i in cols) for r in rows[1:]], kind)
    return out


def query_table(spark: SparkSession, path: str) -> DataFrame:
    """A query table by extension, with empty strings for missing text."""
    if path.endswith(".csv"):
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")
        return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    if path.endswith(".xlsx"):
        return next(iter(workbook(spark, path).values())).na.fill("")
    if path.endswith(".parquet"):
        return spark.read.parquet(path).na.fill("")
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path).na.fill("")
    raise ValueError(f"unknown kind of file: {path}")
