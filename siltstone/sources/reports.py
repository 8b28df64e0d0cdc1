"""Report files: JSON documents between stages, query files of several shapes, CSV, text, charts; resume."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from string import Template

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIT = "struct<chunk_id:string,document_id:string,chunk_index:int,title:string,similarity:double,rank:int>"


def read_report(spark: SparkSession, path: str, item: str = f"query string, results array<{HIT}>") -> DataFrame:
    """One row per query of reports of the form {metadata, summary, queries | results: [...]}."""
    schema = T._parse_datatype_string(f"queries array<struct<{_fields(item)}>>, results array<struct<{_fields(item)}>>")
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.explode(F.coalesce("queries", "results")).alias("q")).select("q.*")


def _fields(ddl: str) -> str:
    return ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in T._parse_datatype_string(ddl))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query) from .jsonl of {query}, or JSON: a list of texts or objects, or an object with ``queries``."""
    if path.endswith(".jsonl"):
        return spark.read.schema("query string").json(path).where("query is not null")
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    body = F.coalesce(F.get_json_object("v", "$.queries"), F.col("v"))
    items = text.select(F.explode(F.from_json(body, "array<string>")).alias("x"))
    return items.select(F.coalesce(F.get_json_object("x", "$.query"), F.col("x")).alias("query"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(title, text): whole files, the title is the file name without its extension."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("title"), F.col("value").alias("text"))


def read_keyed(spark: SparkSession, path: str, pattern: str, schema: str, name: str = "effort") -> DataFrame:
    """JSON files whose name holds an integer key (the pattern's first group)."""
    key = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).cast("int")
    return spark.read.schema(schema).option("multiLine", True).json(path).select("*", key.alias(name)).where(F.col(name).isNotNull())


def read_csv(spark: SparkSession, path: str, schema: str, banner: str | None = None) -> DataFrame:
    """CSV with quoted line breaks; ``banner``: the first field of a line above the header that is left out."""
    df = spark.read.schema(schema).option("header", banner is None).option("multiLine", True).option("escape", '"').csv(path)
    if banner is None:
        return df
    first = df.columns[0]
    return df.where(~F.coalesce(F.col(first).cast("string").isin(banner, first), F.lit(True)))


#: Rows that one pretty document may have; larger reports are written as rows.
SINGLE_ROWS = 10_000


def write_report(df: DataFrame, path: str, metadata: dict | None = None, single: bool = False) -> None:
    """JSON rows by Spark's commit protocol; ``single``: one pretty document on the driver's machine, replaced atomically.

    A single document of more than ``SINGLE_ROWS`` rows is refused.
    """
    if not single:
        df.write.mode("overwrite").json(path)
        return
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).limit(SINGLE_ROWS + 1).collect()]
    if len(rows) > SINGLE_ROWS:
        raise ValueError(f"more than {SINGLE_ROWS} rows for one document")
    with open(f"{path}.tmp", "w", encoding="utf-8") as out:
        json.dump({"metadata": metadata or {}, "queries": rows}, out, indent=2, ensure_ascii=False)
    os.replace(f"{path}.tmp", path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    flat = df.select(*[F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, nested) else F.col(c) for c in df.columns])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def pending(queries: DataFrame, done: DataFrame, key: str = "query") -> DataFrame:
    """Queries that no earlier run has answered."""
    return queries.join(done.select(key).distinct(), key, "left_anti")


def membership(queries: DataFrame, known: DataFrame, key: str = "query") -> DataFrame:
    """One row: how many queries are among the known ones, and how many are skipped."""
    own = known.select(F.col(key).alias("_k")).distinct().withColumn("_in", F.lit(1))
    met = queries.join(own, queries[key].eqNullSafe(own["_k"]), "left")
    return met.agg(F.count("_in").alias("answered"), F.count_if(F.col("_in").isNull()).alias("skipped"))


def normalized_id(first: Column, second: Column, otherwise: str | None = None) -> Column:
    """The first id, else the second, else ``otherwise``; an error where that is None too."""
    end = F.raise_error(F.lit("row has neither chunk_id nor id")).cast("string") if otherwise is None else F.lit(otherwise)
    return F.coalesce(first, second, end)


def by_keys(rows: DataFrame, keys: DataFrame, key: str, order: list[str], max_rows: int | None = None) -> DataFrame:
    """Rows whose key is listed; with ``max_rows`` the first of them by ``order``."""
    met = rows.join(keys, key, "left_semi")
    return met if max_rows is None else met.orderBy(*order).limit(max_rows)


def same_settings(before: dict, now: dict, keys: list[str]) -> None:
    """Raises if a run to be resumed was made with other settings."""
    other = [k for k in keys if before.get(k) != now.get(k)]
    if other:
        raise ValueError(f"settings differ: {', '.join(other)}")


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.text(path).limit(0).collect()
        return True
    except AnalysisException:
        return False


def write_json(spark: SparkSession, path: str, body: dict) -> None:
    """One small JSON document (settings, a manifest) in a folder that all executors share."""
    text = json.dumps(body, sort_keys=True, ensure_ascii=False)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict | None:
    return json.loads("".join(r[0] for r in spark.read.text(path).collect())) if _exists(spark, path) else None


def resumed(spark: SparkSession, path: str, queries: DataFrame, key: str, settings: dict, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The answers of all ``queries``: those of earlier runs under ``path`` and, appended now, those of the rest.

    The first run stores ``settings``; a later one with others is refused. ``run`` gets only queries
    (by ``key``) that have no answer yet, and its rows are appended by Spark's commit protocol: a run
    that was stopped left whole batches or nothing.
    """
    before = read_json(spark, f"{path}/settings")
    if before is None:
        write_json(spark, f"{path}/settings", settings)
    else:
        same_settings(before, settings, sorted(before | settings))
    answers = f"{path}/answers"
    left = pending(queries, spark.read.parquet(answers), key) if _exists(spark, answers) else queries
    run(left).write.mode("append").parquet(answers)
    return spark.read.parquet(answers)


def staged(spark: SparkSession, path: str, settings: dict, stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]]) -> dict[str, DataFrame]:
    """Runs named stages in order; each gets the tables of those before and is written under ``path``.

    ``path``/manifest holds the settings and the stages done. A stage that is done is read, not run
    again; other settings under the same path are refused.
    """
    manifest = read_json(spark, f"{path}/manifest") or {"settings": settings, "done": []}
    same_settings(manifest["settings"], settings, sorted(manifest["settings"] | settings))
    tables: dict[str, DataFrame] = {}
    for name, run in stages:
        if name not in manifest["done"]:
            run(dict(tables)).write.mode("overwrite").parquet(f"{path}/{name}")
            manifest["done"].append(name)
            write_json(spark, f"{path}/manifest", manifest)
        tables[name] = spark.read.parquet(f"{path}/{name}")
    return tables


def read_splits(spark: SparkSession, path: str, splits: list[str], *columns: str) -> DataFrame:
    """A corpus kept as one folder per split, with the column ``split``."""
    out = None
    for name in splits:
        own = spark.read.parquet(f"{path}/{name}")
        own = (own.select(*columns) if columns else own).withColumn("split", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def read_corpus(df: DataFrame, text: str = "text") -> DataFrame:
    """Only the text column, as article_text."""
    return df.select(F.col(text).alias("article_text"))


_CELL = re.compile(r"([A-Z]+)\d+")


def sheet_rows(body: bytes) -> list[list[str | None]]:
    """The rows of the first sheet of an .xlsx file: texts, shared or inline, and numbers as written; gaps are null."""
    import io
    import xml.etree.ElementTree as Xml
    import zipfile

    plain = lambda node: "".join(t.text or "" for t in node.iter() if t.tag.endswith("}t"))
    with zipfile.ZipFile(io.BytesIO(body)) as book:
        names = book.namelist()
        shared = [plain(n) for n in Xml.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheet = Xml.fromstring(book.read(min(n for n in names if n.startswith("xl/worksheets/sheet"))))
    rows = []
    for row in (n for n in sheet.iter() if n.tag.endswith("}row")):
        own: dict[int, str | None] = {}
        for c in row:
            at = 0
            for letter in _CELL.match(c.get("r", "")).group(1):
                at = 26 * at + ord(letter) - 64
            value = next((v.text for v in c if v.tag.endswith("}v")), None)
            own[at - 1] = plain(c) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" and value is not None else value
        rows.append([own.get(i) for i in range(max(own, default=-1) + 1)])
    return rows


def read_sheet(spark: SparkSession, path: str, schema: str, header_row: int = 2, drop: list[str] | None = None) -> DataFrame:
    """Spreadsheets (.xlsx) with their header on row ``header_row``, cast to ``schema``; rows above it and ``drop`` columns are left out.

    One task reads one file; cells that do not fit their type become null.
    """
    fields = T._parse_datatype_string(schema).fields

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for body in batch["content"]:
                rows = sheet_rows(body)
                head = {str(n): i for i, n in enumerate(rows[header_row - 1])} if len(rows) >= header_row else {}
                cells = [[r[head[f.name]] if f.name in head and head[f.name] < len(r) else None for f in fields] for r in rows[header_row:] if any(v is not None for v in r)]
                yield pd.DataFrame(cells, columns=[f.name for f in fields], dtype=object)

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{f.name}` string" for f in fields))
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields if f.name not in (drop or [])])


def effort_metrics(*reports: DataFrame, key: str = "effort") -> DataFrame:
    """Reports of one row per effort side by side, for the efforts that all of them have."""
    out = reports[0]
    for r in reports[1:]:
        out = out.join(r, key)
    return out


def render(template: str, **values: object) -> str:
    return Template(template).safe_substitute({k: str(v) for k, v in values.items()})


def line_chart(points: list[tuple[float, float, float]], title: str, left: str, right: str, width: int = 720, height: int = 400) -> str:
    """SVG of two series over x (a bounded metric table): left axis and right axis scaled apart."""
    xs, ls, rs = zip(*sorted(points), strict=True) if points else ((), (), ())
    pad = 50

    def scale(v: float, own: tuple, low: float, high: float) -> float:
        span = max(own) - min(own)
        return (low + high) / 2 if not span else low + (v - min(own)) / span * (high - low)

    def path(own: tuple, colour: str) -> str:
        at = " ".join(f"{scale(x, xs, pad, width - pad):.1f},{scale(v, own, height - pad, pad):.1f}" for x, v in zip(xs, own, strict=True))
        return f'<polyline fill="none" stroke="{colour}" points="{at}"/>'

    text = lambda x, y, s: f'<text x="{x}" y="{y}">{re.sub("[<&]", "", s)}</text>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">' + text(pad, 24, title) + text(4, 44, left) + text(width - 140, 44, right) + (path(ls, "steelblue") + path(rs, "darkorange") if points else "") + "</svg>"
