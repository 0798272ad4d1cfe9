"""Files as they come: layout, encodings, parts, records. Contents are made up per rule."""

import pytest

from colonnade import DatasetError
from colonnade.sources.delimited import malformed_records, read_delimited, write_delimited


@pytest.fixture
def opened(spark, tmp_path):
    """Columns, cells in source order and file facts of the given bytes."""

    def run(content, **options):
        place = tmp_path / "in.txt"
        place.write_bytes(content if isinstance(content, bytes) else content.encode())
        found = read_delimited(spark, str(place), **options)
        rows = found.dataset.frame.orderBy("_row").drop("_row").collect()
        return found.info.columns, [tuple(r) for r in rows], found.info

    return run


@pytest.fixture
def parts(spark, tmp_path):
    def run(contents, **options):
        folder = tmp_path / "parts"
        folder.mkdir()
        for name, content in contents.items():
            (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())
        found = read_delimited(spark, str(folder), **options)
        return [tuple(r)[1:] for r in found.dataset.frame.orderBy("_row").collect()], found

    return run


def code_of(action, *arguments, **options):
    with pytest.raises(DatasetError) as caught:
        action(*arguments, **options)
    return caught.value.code


TABLE = [("k7", "3"), ("k8", "4")]


@pytest.mark.parametrize("delimiter", [",", ";", "\t"])
@pytest.mark.parametrize("above", ["", "\n\n\n", "# one\n#two\n", "sep={d}\n", "Stock list\n"])
def test_table_below_any_opening(opened, delimiter, above):
    body = "".join(delimiter.join(r) + "\n" for r in [("key", "pieces"), *TABLE])
    wanted = delimiter if above.startswith("Stock") else None
    columns, rows, info = opened(above.format(d=delimiter) + body, delimiter=wanted)
    assert columns == ("key", "pieces") and rows == TABLE
    assert info.delimiter == {"\t": "tab"}.get(delimiter, delimiter)


@pytest.mark.parametrize("lines", [3, 205, 3000])
def test_an_opening_may_be_long(opened, lines):
    body = "key,pieces\nk7,3\nk8,4\n"
    for filler in ("#remark\n", "\n"):
        columns, rows, info = opened(filler * lines + body)
        assert (columns, rows) == (("key", "pieces"), TABLE)
        assert info.header_row == lines + 1
    columns, rows, _ = opened("free text\n" * lines + body, header_row=lines + 1)
    assert (columns, rows) == (("key", "pieces"), TABLE)


@pytest.mark.parametrize("gap", [1, 300])
def test_numbers_above_rows_of_their_width_are_data(opened, gap):
    """The row that decides may stand far below."""
    notes = "lone\n" * gap
    assert code_of(opened, "4;5;6\n" + notes + "7;8;9\n", delimiter=";") == "malformed_record"
    columns, rows, info = opened("4;5;6\n" + "7;8;9\n" * gap)
    assert columns == ("Column 1", "Column 2", "Column 3") and info.generated_headers
    assert len(rows) == gap + 1 and rows[0] == ("4", "5", "6") and info.warnings
    columns, rows, _ = opened("4;five;6\n7;8;9\n")
    assert columns == ("4", "five", "6") and rows == [("7", "8", "9")]
    columns, rows, _ = opened("4;5;6\n7;8;9\n", headerless=False)
    assert columns == ("4", "5", "6")


def test_cells_keep_their_text(opened):
    content = 'code,note\r\n"007","says ""so"""\r\n,"two\nlines, one cell"\r\nNULL, padded \r\n'
    columns, rows, info = opened(content)
    assert columns == ("code", "note") and info.multiline
    assert rows == [("007", 'says "so"'), ("", "two\nlines, one cell"), ("NULL", " padded ")]


@pytest.mark.parametrize("charset", ["utf-8", "utf-8-sig", "cp1252"])
def test_charsets(opened, charset):
    columns, rows, info = opened("größe,straße\nµ,ñandú\n".encode(charset))
    assert columns == ("größe", "straße") and rows == [("µ", "ñandú")]
    assert info.encoding == ("Windows-1252" if charset == "cp1252" else "UTF-8")


def test_windows_characters_need_no_setting(spark, opened):
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    assert opened("a,b\n€ „x“,Š\n".encode("cp1252"))[1] == [("€ „x“", "Š")]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before


def test_closing_remarks_go_and_inner_ones_do_not_fit(opened):
    _, rows, _ = opened("key,pieces\nk7,3\nk8,4\n#eof\nSource: stock room\n")
    assert rows == TABLE
    assert code_of(opened, "key,pieces\nk7,3\nnote: odd\nk8,4\n") == "malformed_record"


def test_blank_lines_are_no_records_but_blank_cells_are(opened):
    assert opened('only\n"" \n\nz\n'.replace('"" ', '""'))[1] == [("",), ("z",)]
    assert opened("only\n   \nz\n")[1] == [("   ",), ("z",)]


BROKEN = {
    "empty_file": [""],
    "missing_header": ["\n \n", "#only\n", "a,,c\n1,2,3\n"],
    "no_data": ["only,names\n", "# x\nonly,names\n"],
    "duplicate_headers": ["p,q,p\n1,2,3\n", "p, p\n1,2\n"],
    "malformed_record": ["p,q\n1,2\n" + "3,4\n" * 400 + "5\n", "p,q\n1,2,3,4\n"],
    "malformed_csv": ['p,q\n1,"2\n', 'p,q\n"1"x,2\n'],
    "invalid_content": ["p\n1\x002\n"],
    "unsupported_dataset": [",".join(f"n{i}" for i in range(205)) + "\n"],
}


@pytest.mark.parametrize("code, content", [(c, t) for c, texts in BROKEN.items() for t in texts])
def test_broken_files(opened, code, content):
    assert code_of(opened, content) == code


def test_limits_and_undefined_bytes(opened):
    assert code_of(opened, b"p,q\n\x8f,\xe4\n") == "unsupported_encoding"
    assert code_of(opened, "p\n" + "1\n" * 9, max_rows=8) == "too_many_rows"
    assert code_of(opened, "p\n" + "1\n" * 9, max_bytes=12) == "file_too_large"
    assert len(opened("p\n" + "1\n" * 9, max_rows=9)[1]) == 9
    assert code_of(opened, "p|q\n1|2\n", delimiter="|") == "invalid_delimiter"
    assert code_of(opened, "p,q\n1,2\n", header_row=50) == "missing_header"


def test_preview_is_the_start_of_the_source(opened, spark, tmp_path):
    place = tmp_path / "long.csv"
    place.write_text("i\n" + "".join(f"{i}\n" for i in range(1234)))
    found = read_delimited(spark, str(place), headerless=False)
    assert [r["i"] for r in found.preview().collect()] == [str(i) for i in range(100)]
    assert found.info.row_count == 1234 and found.info.truncated


def test_written_parts_read_back(spark, tmp_path):
    cells = [(f"id {i}", ["", 'a "b"', "c,d", "+e"][i % 4]) for i in range(50)]
    folder = str(tmp_path / "made")
    write_delimited(spark.createDataFrame(cells, "one string, two string").repartition(4), folder)
    found = read_delimited(spark, folder)
    assert found.info.files == 4 and not found.info.multiline
    assert sorted(tuple(r)[1:] for r in found.dataset.frame.collect()) == sorted(cells)


def test_parts_come_in_order_of_their_paths(parts):
    """Spark reads larger files first; the source does not."""
    rows, found = parts({"a.csv": "n,m\n0,x\n", "b +c.csv": "n,m\n" + "1,y\n" * 3000, "d.csv": "n,m\n2,z\n"})
    assert rows == [("0", "x"), *[("1", "y")] * 3000, ("2", "z")]
    assert found.preview().first()["n"] == "0"


def test_parts_in_several_encodings(parts):
    rows, _ = parts({"a.csv": "name,n\nJoão,1\n", "b.csv": "name,n\nJürgen,2\n".encode("cp1252")})
    assert rows == [("João", "1"), ("Jürgen", "2")]


@pytest.mark.parametrize("second", ["m,n\n3,4\n", "3,4\n", "n,other\n3,4\n", "n,m,x\n3,4,5\n"])
def test_a_part_with_another_header_is_an_error(parts, second):
    assert code_of(parts, {"a.csv": "n,m\n1,2\n", "b.csv": second}) == "malformed_record"


def test_parts_without_header(parts):
    rows, _ = parts({"a": "1,2\n3,4\n", "b": "5,6\n"}, headerless=True)
    assert rows == [("1", "2"), ("3", "4"), ("5", "6")]


def test_splits_of_a_file_keep_its_order(spark, tmp_path):
    place = tmp_path / "wide.csv"
    place.write_text("i;t\n" + "".join(f'{i};"a;{i % 3}"\n' for i in range(15_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "15000")
    try:
        cut = read_delimited(spark, str(place), multiline=False).dataset.frame
        assert cut.rdd.getNumPartitions() > 4
        assert [r["i"] for r in cut.orderBy("_row").collect()] == [str(i) for i in range(15_000)]
        one = read_delimited(spark, str(place), multiline=True).dataset.frame
        assert one.drop("_row").exceptAll(cut.drop("_row")).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ragged_records_are_listed(spark, tmp_path):
    place = tmp_path / "ragged.txt"
    place.write_text('u;v;w\n"1;2";3;4\n5;6\n\n7\n8;9;10;11\n')
    rows = malformed_records(spark, str(place), 3, ";").collect()
    assert {(r["record"], r["fields"]) for r in rows} == {("5;6", 2), ("7", 1), ("8;9;10;11", 4)}
