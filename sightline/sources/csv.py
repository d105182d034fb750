"""CSV folders as typed DataFrames.

Reading keeps three rules: missing tokens become null, text that is not UTF-8 is
read as ISO-8859-1, and a line with too many fields is dropped while a short one
is padded. Types are decided on whole columns by one aggregation.
"""

from __future__ import annotations

import csv as text_csv
import logging
import re
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline import fixed_values as fv
from sightline.functions.scalars import (
    INTEGER_PATTERN,
    NUMBER_PATTERN,
    ident,
    light_name,
    quoted,
    sql_text,
    strict_name,
    strip,
    strip_sql,
)
from sightline.operators.profile import union_all
from sightline.session import shared_folder

log = logging.getLogger(__name__)

RAW_LINE = "_raw_line"
# Spark shows an undecodable byte as this character.
REPLACEMENT = "\ufffd"
FALLBACK = "ISO-8859-1"


def _csv_of(folder: str, path: Column) -> Column:
    """The CSV directly in the folder that a file belongs to; empty text for other files."""
    base = re.sub(r"^[a-zA-Z0-9]+:/*", "/", folder).rstrip("/")
    return F.regexp_extract(path, "^(.*" + re.escape(base) + r"/[^/]+\.csv)(/[^/]+)?$", 1)


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the CSVs directly in a folder; only names are listed, nothing is read.

    A CSV is a file or a folder of part files that ends in ``.csv``.
    """
    child = _csv_of(folder, F.col("path"))
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(child.alias("path"))
        .where(F.col("path") != "")
        .distinct()
    )
    return sorted(r["path"] for r in found.collect())


def _reader(spark: SparkSession, encoding: str, multi_line: bool):
    return (
        spark.read.option("encoding", encoding)
        .option("escape", '"')
        .option("multiLine", str(multi_line).lower())
    )


def header(
    spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool = False
) -> list[str]:
    """The names in the first line; a repeated name gets ``.1``, ``.2`` and so on."""
    first = _reader(spark, encoding, multi_line).option("header", "false").csv(path).first()
    if first is None:
        raise ValueError(f"no header line in {path}")
    return _header_names(first)


def _header_names(fields: Sequence[str | None]) -> list[str]:
    seen: dict[str, int] = {}
    names = []
    for i, value in enumerate(fields):
        name = value if value is not None else f"Unnamed: {i}"
        if name in seen:
            seen[name] += 1
            name = f"{name}.{seen[name]}"
        seen.setdefault(name, 0)
        names.append(name)
    return names


def _positions(n: int) -> list[str]:
    return [f"_c{i}" for i in range(n)]


def _text_frame(
    spark: SparkSession,
    path: str | list[str],
    names: Sequence[str],
    encoding: str,
    multi_line: bool,
    drop_long: bool,
    tag: Sequence[str] = (),
) -> DataFrame:
    """All fields as text under positional names; short lines are padded. ``tag`` names metadata to keep.

    ``drop_long`` leaves out lines with too many fields. It needs every field of
    every line, so the parser's column pruning is off then: otherwise the rows
    would depend on the columns a later query happens to use.
    """
    fields = [T.StructField(f, T.StringType()) for f in _positions(len(names))]
    reader = (
        _reader(spark, encoding, multi_line)
        .option("header", "true")
        .option("enforceSchema", "true")
        .option("mode", "PERMISSIVE")
    )
    if not drop_long:
        return reader.schema(T.StructType(fields)).csv(path)
    # Only a line whose field count differs carries its raw text.
    frame = (
        reader.option("columnPruning", "false")
        .option("columnNameOfCorruptRecord", RAW_LINE)
        .schema(T.StructType([*fields, T.StructField(RAW_LINE, T.StringType())]))
        .csv(path)
    )
    # The first field takes part because the raw line may not be read alone.
    fits = F.coalesce(
        field_count(F.col(RAW_LINE)) <= len(names), F.length("_c0") >= 0, F.lit(True)
    )
    return frame.where(fits).select(*_positions(len(names)), *tag)


def field_count(line: Column) -> Column:
    """Fields of a raw line; commas inside quotes do not count."""
    bare = F.regexp_replace(line, r'"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def missing_to_null(value: Column, tokens: Sequence[str] = tuple(fv.NA_TOKENS)) -> Column:
    return F.when(~value.isin(list(tokens)), value)


def undecodable_rows(df: DataFrame) -> Column:
    """Number of rows where a text holds a replacement character."""
    found = " OR ".join(f"contains({ident(c)}, {sql_text(REPLACEMENT)})" for c in df.columns)
    return F.expr(f"count_if({found})")


def _read_fields(
    spark: SparkSession, path: str, multi_line: bool, encoding: str, drop_long: bool = True
) -> tuple[DataFrame, list[str]]:
    """Text columns under positional names, and the header names.

    Header names may differ only in case, so they are put on last.
    """
    names = header(spark, path, encoding, multi_line)
    frame = _text_frame(spark, path, names, encoding, multi_line, drop_long)
    return frame.select(*[missing_to_null(F.col(c)).alias(c) for c in frame.columns]), names


def _is_foreign(spark: SparkSession, path: str, names: list[str], marked: int) -> bool:
    """Whether a file is no UTF-8. Replacement characters may stand in it lawfully: the bytes decide."""
    if not marked and not any(REPLACEMENT in n for n in names):
        return False
    # The text source keeps the bytes of a line as they are.
    return not spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()


def read_csv_text(
    spark: SparkSession, path: str, multi_line: bool = False, encoding: str | None = None
) -> DataFrame:
    """One CSV as text columns with its own header names and missing tokens as null.

    ``multi_line`` is needed only for quoted line breaks; it stops file splitting.
    A given ``encoding`` saves the pass that looks for undecodable text.
    """
    frame, names = _read_fields(spark, path, multi_line, encoding or "UTF-8")
    if encoding is None and _is_foreign(
        spark, path, names, frame.agg(undecodable_rows(frame)).first()[0]
    ):
        return read_csv_text(spark, path, multi_line, FALLBACK)
    return frame.toDF(*names)


# -------------------------------------------------------------------- types


def _type_aggregates(columns: Sequence[str]) -> list[Column]:
    aggs = []
    for i, c in enumerate(columns):
        raw = ident(c)
        value = strip_sql(raw)
        aggs += [
            F.expr(f"count({raw}) AS n{i}"),
            F.expr(
                f"count_if({value} RLIKE r'{INTEGER_PATTERN}' "
                f"AND try_cast({value} AS BIGINT) IS NOT NULL) AS i{i}"
            ),
            F.expr(f"count_if({value} RLIKE r'{NUMBER_PATTERN}') AS f{i}"),
            F.expr(f"count_if(lower({raw}) IN ('true', 'false')) AS b{i}"),
        ]
    return aggs


def type_counts(df: DataFrame) -> DataFrame:
    """One row: per text column the values present and those of each type."""
    return df.agg(undecodable_rows(df).alias("undecodable"), *_type_aggregates(df.columns))


def _types(row, columns: Sequence[str]) -> dict[str, str]:
    out = {}
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        if n == 0:
            out[c] = "double"
        elif row[f"i{i}"] == n:
            out[c] = "bigint"
        elif row[f"f{i}"] == n:
            out[c] = "double"
        elif row[f"b{i}"] == n:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def infer_types(df: DataFrame) -> dict[str, str]:
    """Type per text column, from every value: bigint, double, boolean or string."""
    return _types(type_counts(df).first(), df.columns)


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    def typed(c: str) -> Column:
        if types[c] == "string":
            return quoted(c).alias(c)
        return strip(quoted(c)).try_cast(types[c]).alias(c)

    return df.select(*[typed(c) for c in df.columns])


def _typed(
    spark: SparkSession,
    path: str,
    multi_line: bool,
    encoding: str | None,
    required: Sequence[str] | None = None,
) -> DataFrame:
    """Read, then decide types and encoding in one pass over all values."""
    frame, names = _read_fields(spark, path, multi_line, encoding or "UTF-8", required is None)
    if required is not None:
        places = required_positions(names, required, path)
        frame, names = frame.select(*[f"_c{i}" for i in places.values()]), list(places)
    row = type_counts(frame).first()
    if encoding is None and _is_foreign(spark, path, names, row["undecodable"]):
        return _typed(spark, path, multi_line, FALLBACK, required)
    return apply_types(frame, _types(row, frame.columns)).toDF(*names)


def read_csv(
    spark: SparkSession, path: str, multi_line: bool = False, encoding: str | None = None
) -> DataFrame:
    """One CSV with types inferred from all its values."""
    return _typed(spark, path, multi_line, encoding)


def _file_path() -> Column:
    """The path of a row's file as the listing gives it; metadata holds it percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def folder_headers(spark: SparkSession, folder: str) -> dict[str, tuple[list[str], str]]:
    """Header names and encoding of every CSV of a folder, from one scan of all lines.

    A file with a line that is no UTF-8 is read as ISO-8859-1. Files without any line are not in the result.
    What is collected is one line per file.
    """
    lines = (
        spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").text(folder)
        .select(
            _file_path().alias("file"), F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("place"), "value",
        )
        .withColumn("path", _csv_of(folder, F.col("file")))
    )
    # A file's first line lies in its first block, and lines of a block are numbered in order.
    first = F.when((F.col("start") == 0) & (F.trim("value") != ""), F.struct("file", "place"))
    heads = (
        lines.where(F.col("path") != "").groupBy("path")
        .agg(
            F.min_by(F.col("value").cast("binary"), first).alias("head"),
            F.bool_or(~F.is_valid_utf8("value")).alias("foreign"),
        )
        .where(F.col("head").isNotNull())
    )
    out = {}
    for r in heads.collect():
        encoding = FALLBACK if r["foreign"] else "UTF-8"
        fields = next(text_csv.reader([bytes(r["head"]).decode(encoding).lstrip("\ufeff")]))
        out[r["path"]] = _header_names([f or None for f in fields]), encoding
    return out


def read_files(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every CSV of a folder, typed, in two jobs whatever the number of files.

    One job gives headers and encodings, one the types: files of equal width and encoding share a scan, and
    the counts of all files are collected, one row per file. Files with a header only have double columns.
    """
    heads = folder_headers(spark, folder)
    groups: dict[tuple[int, str], list[str]] = {}
    for path, (names, encoding) in sorted(heads.items()):
        groups.setdefault((len(names), encoding), []).append(path)

    def counts(width: int, encoding: str, paths: list[str]) -> DataFrame:
        file = _csv_of(folder, _file_path()).alias("path")
        frame = _text_frame(spark, paths, _positions(width), encoding, False, True, [file])
        columns = _positions(width)
        clean = frame.select("path", *[missing_to_null(F.col(c)).alias(c) for c in columns])
        return clean.groupBy("path").agg(*_type_aggregates(columns))

    found = {}
    if groups:
        counted = union_all([counts(*group, paths) for group, paths in groups.items()])
        found = {r["path"]: r for r in counted.collect()}
    out = {}
    for path, (names, encoding) in sorted(heads.items()):
        columns = _positions(len(names))
        types = _types(found[path], columns) if path in found else dict.fromkeys(columns, "double")
        frame = _text_frame(spark, path, names, encoding, False, True)
        clean = frame.select(*[missing_to_null(F.col(c)).alias(c) for c in columns])
        out[path] = apply_types(clean, types).toDF(*names)
    return out


def read_folder_status(
    spark: SparkSession,
    folder: str,
    names: str | None = None,
    multi_line: bool = False,
    stage: bool = False,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every CSV of a folder by file name, and a row per file: ``path``, ``status``, ``reason``.

    All files are read together (see ``read_files``). If that fails, or with quoted line breaks, they are read
    one by one: the status is 'read' or 'failed', and a file that cannot be read does not stop the others.
    ``names`` is None, 'light' or 'strict' and says how headers are normalised. ``stage`` writes each file as
    typed Parquet to the shared folder, so that later passes parse no text and read only the columns they use;
    names must then differ in more than case.
    """
    out, status = {}, []
    try:
        together = {} if multi_line else read_files(spark, folder)
    except (PySparkException, Py4JJavaError, ValueError) as error:
        log.warning("reading the files one by one: %s", error)
        together = {}
    for path in csv_files(spark, folder):
        name = path.rsplit("/", 1)[-1]
        try:
            frame = together[path] if path in together else read_csv(spark, path, multi_line)
            frame = normalize_header(frame, names) if names else frame
            if stage:
                place = f"{shared_folder(spark)}/{strict_name(name)}"
                frame.write.parquet(place)
                frame = spark.read.schema(frame.schema).parquet(place)
            out[name] = frame
            status.append((path, "read", None))
        except (PySparkException, Py4JJavaError, ValueError) as error:
            log.warning("failed %s: %s", name, error)
            status.append((path, "failed", str(error)))
    return out, spark.createDataFrame(status, "path string, status string, reason string")


def read_folder(
    spark: SparkSession,
    folder: str,
    names: str | None = None,
    multi_line: bool = False,
    stage: bool = False,
) -> dict[str, DataFrame]:
    """The readable CSVs of ``read_folder_status``."""
    return read_folder_status(spark, folder, names, multi_line, stage)[0]


# ------------------------------------------------------------------ headers


def normalize_header(df: DataFrame, mode: str = "light") -> DataFrame:
    """'light': trimmed lower case; 'underscore': blanks as well; 'strict': a-z0-9 only."""
    rules = {
        "light": light_name,
        "underscore": lambda n: light_name(n, True),
        "strict": strict_name,
    }
    return df.toDF(*[rules[mode](c) for c in df.columns])


def required_positions(
    columns: Sequence[str], required: Sequence[str], name: str = "data"
) -> dict[str, int]:
    """Position of each required column by trimmed lower-case name.

    The first of two columns that differ only in case wins. Missing columns are
    reported; none at all is an error.
    """
    first: dict[str, int] = {}
    for i, c in enumerate(columns):
        first.setdefault(light_name(c), i)
    wanted = [light_name(c) for c in required]
    found = {c: first[c] for c in wanted if c in first}
    lacking = sorted(set(wanted) - set(found))
    if not found:
        raise ValueError(f"none of the required columns is in {name}")
    if lacking:
        log.warning("%s lacks the columns %s", name, ", ".join(lacking))
    return found


def select_required(df: DataFrame, required: Sequence[str], name: str = "data") -> DataFrame:
    """The required columns under their lower-case names, pruned at the scan."""
    places = required_positions(df.columns, required, name)
    unique = df.toDF(*_positions(len(df.columns)))
    return unique.select(*[F.col(f"_c{i}").alias(c) for c, i in places.items()])


def read_required(
    spark: SparkSession,
    candidates: Sequence[str],
    required: Sequence[str],
    multi_line: bool = False,
    encoding: str | None = None,
) -> DataFrame:
    """Required columns from the first candidate path that exists, typed.

    Only the wanted fields are parsed, so a line with extra fields stays.
    """
    path = first_existing(spark, candidates)
    return _typed(spark, path, multi_line, encoding, required)


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.format("binaryFile").load(path).select("path").limit(1).isEmpty()
    except Exception:  # noqa: BLE001 - a path that cannot be listed is not there
        return False


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str:
    for path in candidates:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these exists: {', '.join(candidates)}")
