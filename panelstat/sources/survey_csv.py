"""Wide survey exports: header layouts, column lookup and reading."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelstat.functions.scalar import UUID_PREFIX

_UUID = re.compile(UUID_PREFIX)


# What a head cell can be, and how much a row of such cells tells about the cases: the fuller row is the header.
TITLED, DESCRIBED, BARE, IMPORT, OTHER = "titled", "described", "bare", "import", "other"
_TELLS = {TITLED: 3, DESCRIBED: 2, BARE: 1}
LONG_TEXT = 50


def _uuid(cell: str | None) -> str | None:
    m = _UUID.match((cell or "").strip())
    return m.group(1).lower() if m else None


def _cell_kind(cell: str | None) -> str:
    text = (cell or "").strip()
    if _uuid(text):
        return TITLED if " - " in text else BARE
    return IMPORT if text.startswith("{") and "ImportId" in text else OTHER


def header_layout(rows: list[list[str]]) -> tuple[list[str], int]:
    """(headers, index of the first data row) from the kinds of the cells in the first three rows.

    A column whose first cell is a bare case id and whose second is a long text is described by the latter,
    unless the first row has titles itself. The second row is the header if it tells more about the cases
    than the first, or titles them. A third row with import metadata in any cell is no data.
    """
    table = [[_cell_kind(c) for c in row] for row in rows[:3]]
    if len(table) > 1 and TITLED not in table[0]:
        for i, (above, below) in enumerate(zip(table[0], rows[1])):
            if above == BARE and len(below or "") > LONG_TEXT and table[1][i] == OTHER:
                table[1][i] = DESCRIBED
    tells = [max((_TELLS.get(k, 0) for k in row), default=0) for row in table[:2]]
    if len(table) < 2 or not (tells[1] > tells[0] or tells[1] == _TELLS[TITLED]):
        return (rows[0] if rows else []), 1
    return rows[1], 2 + (len(table) > 2 and IMPORT in table[2])


def find_column(name: str, headers: list[str], short: list[str] | None = None) -> int | None:
    """Index of the best column: by header row before short header, whole name before part of it, then position."""
    want = name.lower()
    found = [
        (row, have != want, i)
        for row, cells in enumerate((headers, short or []))
        for i, have in enumerate((c or "").lower() for c in cells)
        if want in have
    ]
    return min(found)[2] if found else None


@dataclass
class SurveyLayout:
    """Where things are in a wide export."""

    first_data_row: int
    name: int | None
    email: int | None
    expertise: int | None
    timestamp: int | None
    cases: dict[int, str]
    warnings: list[str] = field(default_factory=list)


def survey_layout(
    head: list[list[str]], name="Name", email="Email", expertise="Expertise", timestamp="Recorded Date"
) -> SurveyLayout:
    """Layout from the first three rows; missing key columns are reported, repeated cases rejected."""
    if len(head) < 2:
        raise ValueError("a survey needs a header and at least one row")
    headers, start = header_layout(head)
    short = head[0] if start >= 2 else None
    cases = {}
    for i, h in enumerate(headers):
        cid = _uuid(h) or (_uuid(short[i]) if short and i < len(short) else None)
        if cid:
            if cid in cases.values():
                raise ValueError(f"case {cid} has more than one column")
            cases[i] = cid
    at = {n: find_column(c, headers, short) for n, c in (("name", name), ("email", email), ("expertise", expertise), ("timestamp", timestamp))}
    notes = []
    for key, label, effect in (
        ("name", name, "participant names cannot be extracted"),
        ("email", email, "participant emails cannot be extracted"),
        ("timestamp", timestamp, "using current time for all timestamps"),
    ):
        if at[key] is None:
            notes.append(f"Column '{label}' not found - {effect}")
    return SurveyLayout(start, at["name"], at["email"], at["expertise"], at["timestamp"], cases, notes)


HEAD_FOLDER, ROWS_FOLDER = "0-head", "1-rows"


def write_survey_csv(rows: DataFrame, head: list[list[str]], path: str, order: str = "row", n_files: int | None = None) -> None:
    """Survey rows, one column per header cell, as many part files in the order of ``order``; the head rows in a file of their own.

    The column ``order`` is not written. Files are named so that their paths sort as the rows do, and the rows meet by range,
    so no task holds more than its share. Nulls are written as empty cells.
    """
    spark = rows.sparkSession
    cells = [c for c in rows.columns if c != order]
    if any(len(r) != len(cells) for r in head):
        raise ValueError("every head row needs one cell per column")
    save = lambda df, folder: df.write.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).mode("overwrite").csv(f"{path}/{folder}")
    top = spark.createDataFrame([tuple(r) for r in head], ", ".join(f"`{c}` string" for c in cells)).coalesce(1)
    save(top, HEAD_FOLDER)
    dealt = rows.repartitionByRange(n_files, order) if n_files else rows.repartitionByRange(order)
    save(dealt.sortWithinPartitions(order).select(*cells), ROWS_FOLDER)


def _numbered(raw: DataFrame) -> DataFrame:
    """``_row``, counted from 0 over all files in the order of their paths, in place of ``_file``.

    A file is read by one task in its own order; the rows of the files before it are added. The order of files is a window
    over one row per file.
    """
    inside = F.row_number().over(Window.partitionBy("_file").orderBy("_at")) - 1
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = raw.groupBy("_file").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = raw.withColumn("_inside", inside).join(offsets, "_file")
    return placed.withColumn("_row", F.col("_before") + F.col("_inside")).drop("_file", "_at", "_inside", "_before")


def read_survey_csv(spark: SparkSession, path: str, **columns) -> tuple[DataFrame, SurveyLayout]:
    """(rows, layout) of an export: row number, person columns and one column per case id.

    An export is one file, or a folder of files that continue each other in the order of their paths, as
    ``write_survey_csv`` makes them. Quoted cells may span lines, so a file is read by one task; a byte-order mark is
    dropped. Only the three first rows reach the driver, to decide the layout. Row numbers are those of the whole export.
    """
    reader = spark.read.option("header", False).option("multiLine", True).option("quote", '"').option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("recursiveFileLookup", True)
    files = sorted(spark.read.option("recursiveFileLookup", True).text(path).inputFiles())
    head, names = [], []
    for file in files:  # ends with the file that holds the third row
        first = reader.csv(file)
        if len(first.columns) > len(names):
            names = first.columns
        head += [["" if v is None else v for v in r] for r in first.limit(3 - len(head)).collect()]
        if len(head) == 3:
            break
    if head:
        head[0][0] = head[0][0].removeprefix("\ufeff")
    layout = survey_layout(head, **columns)
    raw = reader.schema(", ".join(f"`{c}` string" for c in names)).csv(path)
    first = F.regexp_replace(F.col(names[0]), "^\ufeff", "").alias(names[0])
    if len(files) == 1:
        raw = raw.select(F.monotonically_increasing_id().alias("_row"), first, *names[1:])
    else:
        place = [F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at")]
        raw = _numbered(raw.select(*place, first, *names[1:]))
    cell = lambda i: F.coalesce(F.col(names[i]), F.lit("")) if i is not None else F.lit("")
    body = raw.filter(F.col("_row") >= layout.first_data_row)
    body = body.filter(F.exists(F.array(*names), lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0))
    rows = body.select(
        (F.col("_row") + 1).alias("row"),
        cell(layout.name).alias("name"),
        cell(layout.email).alias("email"),
        cell(layout.expertise).alias("expertise"),
        cell(layout.timestamp).alias("recorded"),
        *[cell(i).alias(c) for i, c in layout.cases.items()],
    )
    return rows, layout
