"""Delimited text files as datasets in which every cell is text."""

from __future__ import annotations

import csv
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import config as C
from colonnade.dataset import ROW, Dataset, prepared
from colonnade.errors import DatasetError
from colonnade.functions import stripped
from colonnade.small import small_table
from colonnade.sources.layout import (
    NAMED_DELIMITER, NOTE, WINDOW, Layout, Opening, chosen_delimiter, find_layout, without_header,
)

BAD = "_bad"


@dataclass(frozen=True)
class FileInfo:
    path: str
    files: int
    file_size: int
    row_count: int
    columns: tuple[str, ...]
    delimiter: str
    encoding: str
    header_row: int
    generated_headers: bool
    skipped_rows: int
    multiline: bool
    warnings: list[str] = field(default_factory=list)

    @property
    def truncated(self) -> bool:
        return self.row_count > C.PREVIEW_ROWS


@dataclass(frozen=True)
class DelimitedFile:
    dataset: Dataset
    info: FileInfo

    def preview(self) -> DataFrame:
        return self.dataset.preview()


def _listing(spark: SparkSession, path: str):
    listed = spark.read.format("binaryFile").load(path)
    return listed.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("length").alias("size"),
    ).first()


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line from 1, value) of one file. Spark numbers rows within a split; one count per
    split tells where each begins."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), "value")
    part = F.shiftright("id", 33)
    counts = dict(rows.groupBy(part.alias("part")).count().collect())
    before, seen = [], 0
    for key in sorted(counts):
        before.append((key, seen))
        seen += counts[key]
    starts = small_table(spark, before or [(0, 0)], "part bigint, before bigint")
    line = F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1) + 1
    return rows.withColumn("part", part).join(F.broadcast(starts), "part").select(line.alias("line"), "value")


def _opening(lines: DataFrame, header_row: int | None, size: int, charset: str) -> Opening:
    """The lines from the table's start on, found over the whole file: after blank lines,
    notes and a line that names the delimiter, or at the given line."""
    bare = F.ltrim("value", F.lit("\ufeff"))
    names = bare.rlike(NAMED_DELIMITER)
    above = (stripped(bare) == "") | bare.rlike(NOTE) | names
    start = header_row or lines.agg(F.min(F.when(~above, F.col("line")))).first()[0]
    last = lines.agg(F.max("line")).first()[0] or 0
    if start is None or start > last:
        return Opening([], start or last + 1, 0, None, True)
    before = lines.where(F.col("line") < start).agg(
        F.count_if(bare != "").alias("records"),
        F.max(F.when(names, F.struct("line", F.regexp_extract(bare, NAMED_DELIMITER, 1).alias("named")))).alias("named"),
    ).first()
    shown = lines.where((F.col("line") >= start) & (F.col("line") < start + size))
    raw = [bytes(r[0]) for r in shown.orderBy("line").select(F.col("value").cast("binary")).collect()]
    try:
        text = [value.decode(charset) for value in raw]
    except UnicodeDecodeError as error:
        raise _unreadable() from error
    text[:1] = [text[0].removeprefix("\ufeff")]
    named = before["named"]["named"] if before["named"] else None
    return Opening(text, start, before["records"], named, start + size > last)


def _found_layout(spark: SparkSession, path: str, charset: str, delimiter, header_row, headerless) -> Layout:
    """The layout of one file. The rules see more lines until they can tell."""
    lines, size = _numbered_lines(spark, path), WINDOW
    while True:
        opening = _opening(lines, header_row, size, charset)
        layout = find_layout(opening, chosen_delimiter(opening, delimiter), headerless)
        if layout is not None:
            break
        size *= 16
    if layout.doubtful:
        later = lines.where(F.col("line") >= opening.first_line + size)
        outside = F.regexp_replace("value", '"[^"]*"', "")
        separators = F.length(outside) - F.length(F.replace(outside, F.lit(layout.delimiter), F.lit("")))
        as_wide = later.where((F.col("value") != "") & (separators + 1 == len(layout.names)))
        if not as_wide.isEmpty():
            return without_header(layout)
    return layout


def _strictly_quoted(line: Column, delimiter: str) -> Column:
    """A quoted cell must be followed by a delimiter or the end of the line."""
    d = "\\t" if delimiter == "\t" else delimiter
    cell = rf'(?:"(?:[^"]++|"")*+"|[^"{d}][^{d}]*+|)'
    return line.rlike(rf"\A{cell}(?:{d}{cell})*+\z")


def _content(lines: DataFrame, delimiter: str):
    """One pass over the lines: binary content, loose quotes, and whether any record could
    span lines (an odd number of quotes) or be whitespace only."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    bare = F.ltrim(line, F.lit("\ufeff"))
    loose = line.contains('"') & ~bare.startswith("#") & ~_strictly_quoted(bare, delimiter)
    opening = F.lower(stripped(bare))
    note = opening.startswith("#") | opening.startswith("note:") | opening.startswith("source:")
    return lines.agg(
        F.count_if(quotes % 2 == 1).alias("open_quotes"),
        F.count_if((quotes % 2 == 1) & ~note).alias("unpaired"),
        F.count_if(loose).alias("loose_quotes"),
        F.count_if((line != "") & (stripped(line) == "")).alias("blank_records"),
    ).first()


def _encodings(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files that are UTF-8 and files that are not, each list in order of the paths. The
    driver holds the files' names in any case."""
    line = F.col("value")
    by_file = (
        spark.read.text(path).groupBy(F.input_file_name().alias("file"))
        .agg(F.count_if(~F.is_valid_utf8(line)).alias("other"), F.count_if(line.contains("\0")).alias("binary"))
        .collect()
    )
    if any(row["binary"] for row in by_file):
        raise DatasetError("invalid_content", "The file contains NUL characters.")
    named = sorted((unquote(row["file"]), row["other"] > 0) for row in by_file)
    return [f for f, other in named if not other], [f for f, other in named if other]


def _reader(spark: SparkSession, layout: Layout, charset: str, multiline: bool, header: bool):
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(layout.names))]
    return (
        spark.read.schema(T.StructType([*fields, T.StructField(BAD, T.StringType())]))
        .option("sep", layout.delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD)
        .option("encoding", charset)
        .option("multiLine", multiline)
        .option("header", header)
        .option("maxCharsPerColumn", -1)
    )


def _windows_text(cell: Column) -> Column:
    """Windows-1252 text from bytes read as Latin-1, which Spark reads under any setting:
    the two differ in 32 places, of which five are undefined."""
    places = [bytes([b]) for b in range(0x80, 0xA0)]
    meant = "".join(p.decode("cp1252", errors="replace") for p in places)
    return F.translate(cell, b"".join(places).decode("latin-1"), meant)


def _loaded(
    spark: SparkSession, layout: Layout, files: list[str], charset: str, multiline: bool, header: bool
) -> DataFrame:
    """The cells of files of one charset."""
    if charset == "UTF-8":
        return _reader(spark, layout, charset, multiline, header).load(files, format="csv")
    raw = _reader(spark, layout, "ISO-8859-1", multiline, header).load(files, format="csv")
    return raw.select(*(_windows_text(F.col(c)).alias(c) for c in raw.columns))


def read_delimited(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    header_row: int | None = None,
    headerless: bool | None = None,
    multiline: bool | None = None,
    max_rows: int | None = None,
    max_bytes: int | None = None,
) -> DelimitedFile:
    """Validate and read one file, or a folder of part files with equal headers.

    Nothing but the first lines and a few counts comes to the driver. A file is read in
    splits when no record can span lines; otherwise (or on request) each file is one
    task, as Spark's multi-line mode requires.
    """
    prepared(spark)
    listed = _listing(spark, path)
    size = listed["size"] or 0
    if size == 0:
        raise DatasetError("empty_file", "The file is empty.")
    if max_bytes is not None and size > max_bytes:
        raise DatasetError("file_too_large", f"The file exceeds {max_bytes:,} bytes.")
    one_file = listed["files"] == 1
    sets = [
        (files, charset)
        for files, charset in zip(_encodings(spark, path), ("UTF-8", "windows-1252"))
        if files
    ]
    utf8 = all(charset == "UTF-8" for _, charset in sets)
    first, first_charset = min(((files[0], charset) for files, charset in sets), default=(path, "UTF-8"))
    python_charset = "utf-8" if first_charset == "UTF-8" else "cp1252"
    layout = _found_layout(spark, first, python_charset, delimiter, header_row, headerless)
    content = _content(spark.read.text(path), layout.delimiter)
    if not one_file and layout.skip > 1:
        raise DatasetError("unsupported_dataset", "Part files must start with their header.")
    if multiline is None:
        multiline = bool(content["open_quotes"] or content["blank_records"])
    if one_file and content["unpaired"] % 2:
        raise DatasetError("malformed_csv", "A quoted cell is not closed.")
    if not multiline and content["loose_quotes"]:
        raise DatasetError("malformed_csv", "A quoted cell is followed by further text.")
    if one_file:
        raw = _loaded(spark, layout, [first], sets[0][1], multiline, False)
        numbered = raw.select(F.monotonically_increasing_id().alias(ROW), *raw.columns)
        rows = numbered.where(F.col(ROW) >= layout.skip)
    else:
        rows = _parts(spark, layout, sets, multiline)
    if layout.skip == 0:
        rows = rows.withColumn("c0", F.ltrim(F.col("c0"), F.lit("\ufeff")))
    rows, count = _validated(rows, layout, utf8)
    if max_rows is not None and count > max_rows:
        raise DatasetError("too_many_rows", f"The file exceeds {max_rows:,} rows.")
    cells = [
        F.coalesce(F.col(f"c{i}"), F.lit("")).alias(name) for i, name in enumerate(layout.names)
    ]
    frame = rows.select(ROW, *cells)
    types = {name: T.StringType() for name in layout.names}
    note = "Column names were generated because the first row was taken as data."
    info = FileInfo(
        path, listed["files"], size, count, layout.names,
        "tab" if layout.delimiter == "\t" else layout.delimiter,
        "UTF-8" if utf8 else "Windows-1252", layout.header_row, layout.generated,
        layout.header_row - 1, multiline, [note] if layout.generated else [],
    )
    return DelimitedFile(Dataset(frame, layout.names, types), info)


def _parts(spark: SparkSession, layout: Layout, sets: list[tuple[list[str], str]], multiline: bool) -> DataFrame:
    """The rows of part files, numbered by path and place within the file. Every part must
    start with the header, if there is one.

    A row's place is the start of its split plus its number within the task: a split has no
    more rows than bytes, so the numbers of later splits are larger."""
    paths = sorted(f for files, _ in sets for f in files)
    ranks = small_table(spark, [(f, i) for i, f in enumerate(paths)], "file string, rank bigint")

    def loaded(header: bool) -> DataFrame:
        frames = []
        for files, charset in sets:
            raw = _loaded(spark, layout, files, charset, multiline, header)
            within = F.input_file_block_start() + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
            file = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
            frames.append(raw.select(file.alias("file"), within.alias("within"), *raw.columns))
        return reduce(DataFrame.union, frames)

    cells = [f"c{i}" for i in range(len(layout.names))]
    if not layout.generated:
        first = F.min_by(F.struct(*cells), "within")
        bare = F.trim(F.ltrim(F.col("first.c0"), F.lit("\ufeff")))
        same = bare.eqNullSafe(F.lit(layout.names[0]))
        for cell, name in zip(cells[1:], layout.names[1:]):
            same = same & F.trim(F.col(f"first.{cell}")).eqNullSafe(F.lit(name))
        other = loaded(False).groupBy("file").agg(first.alias("first")).where(~same).agg(F.min("file")).first()[0]
        if other is not None:
            raise DatasetError("malformed_record", f"{other} does not start with the header of the first file.")
    rows = loaded(not layout.generated).join(F.broadcast(ranks), "file")
    number = F.shiftleft("rank", 43) + F.col("within")
    return rows.select(number.alias(ROW), *cells, BAD)


def _unreadable() -> DatasetError:
    return DatasetError("unsupported_encoding", "The file is neither UTF-8 nor Windows-1252.")


def _validated(rows: DataFrame, layout: Layout, utf8: bool) -> tuple[DataFrame, int]:
    """Drop trailing notes, then insist that every record has all fields."""
    width = len(layout.names)
    first = F.coalesce(F.col("c0"), F.lit(""))
    others = [F.col(f"c{i}").isNull() for i in range(1, width)]
    text = F.coalesce(F.col(BAD), first)
    single = F.lit(True)
    for empty in others:
        single = single & empty
    if width > 1:
        unquoted = F.regexp_replace(text, '"[^"]*"', "")
        single = single & F.col(BAD).isNotNull() & ~unquoted.contains(layout.delimiter)
    opening = F.lower(stripped(first))
    note = single & (
        F.ltrim(first).startswith("#") | opening.startswith("note:") | opening.startswith("source:")
    )
    # All columns are referenced, so that column pruning cannot hide ragged records.
    touched = F.count_if(F.coalesce(*(F.col(f"c{i}") for i in range(width)), F.lit("")) == "\ufffd")
    last_row = F.max(F.when(~note, F.col(ROW)))
    scan = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(note).alias("notes"),
        last_row.alias("last"),
        F.count_if(F.col(BAD).isNotNull() & ~note).alias("bad"),
        F.min(F.when(F.col(BAD).isNotNull() & ~note, F.col(BAD))).alias("sample"),
        *(F.count_if(F.contains(F.col(f"c{i}"), F.lit("\ufffd"))).alias(f"u{i}") for i in range(width)),
        touched.alias("touched"),
    ).first()
    if not utf8 and any(scan[f"u{i}"] for i in range(width)):
        raise _unreadable()
    kept, sample, bad = scan["rows"], scan["sample"], scan["bad"]
    if scan["notes"]:
        last = -1 if scan["last"] is None else scan["last"]
        rows = rows.where(F.col(ROW) <= last)
        inner = rows.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(note).alias("notes"),
            F.min(F.when(note, text)).alias("sample"),
        ).first()
        kept = inner["rows"]
        if inner["notes"] and width > 1:
            bad, sample = bad + inner["notes"], sample or inner["sample"]
    if bad:
        if sample.count('"') % 2:
            raise DatasetError("malformed_csv", "A quoted cell is not closed.")
        found = len(next(csv.reader([sample], delimiter=layout.delimiter), []))
        raise DatasetError(
            "malformed_record", f"A row has {found} fields; expected {width} ({bad:,} such rows)."
        )
    if kept == 0:
        raise DatasetError("no_data", "There is a header but no data row.")
    return rows, kept


def malformed_records(
    spark: SparkSession, path: str, width: int, delimiter: str = ","
) -> DataFrame:
    """``(record, fields)`` of all one-line records whose field count is not ``width``."""
    record = F.col("value")
    outside = F.regexp_replace(record, '"[^"]*"', "")
    separators = F.length(outside) - F.length(F.replace(outside, F.lit(delimiter), F.lit("")))
    rows = spark.read.text(path).where(record != "")
    counted = rows.select(record.alias("record"), (separators + 1).alias("fields"))
    return counted.where(F.col("fields") != width)


def write_delimited(frame: DataFrame, path: str, delimiter: str = ",") -> None:
    """Write text columns as part files with headers that ``read_delimited`` accepts."""
    writer = frame.write.option("header", True).option("sep", delimiter).option("quote", '"')
    writer.option("escape", '"').option("emptyValue", "").csv(path)
