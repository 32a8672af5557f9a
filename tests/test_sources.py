from __future__ import annotations

import hashlib
import json

import pytest

from conftest import rows
from curalith.operators.prefix import record_index
from curalith.sources import csv, files, reference
from pyspark.sql import functions as F

TEXT = '''id,name,ratio,big,name,mixed
1, Ann ,1.5,99999999999999999999,last,1
02,"Bo, Jr",2,5,x,2.5

3,"say ""hi""",,,"",x,extra,cells
4
id,name,ratio,big,name,mixed
'''


@pytest.fixture
def path(tmp_path):
    file = tmp_path / "people.csv"
    file.write_text(TEXT)
    return str(file)


def test_cells(spark, path):
    cells = csv.read_cells(spark, path)
    assert cells.columns == ["id", "name", "ratio", "big", "mixed"]  # of columns named alike the last one's cells
    assert rows(cells) == sorted(
        [
            ("1", "last", "1.5", "99999999999999999999", "1"),
            ("02", "x", "2", "5", "2.5"),
            (None,) * 5,
            ("3", None, None, None, "x"),
            ("4", None, None, None, None),
            ("id", "name", "ratio", "big", "mixed"),
        ],
        key=repr,
    )
    assert csv.read_cells(spark, path, blank_lines="drop").count() == 5
    with pytest.raises(ValueError, match="blank_lines"):
        csv.read_cells(spark, path, blank_lines="maybe")


def test_typed(spark, tmp_path):
    file = tmp_path / "t.csv"
    file.write_text("id|ratio|big|mixed|empty\n01|1.5|99999999999999999999|1|\n2|2|5|x|  \n")
    df = csv.read_typed_csv(spark, str(file), delimiter="|")
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "decimal(38,0)", "string", "string"]
    assert sorted(r.id for r in df.collect()) == [1, 2]
    assert {int(r.big) for r in df.collect()} == {99999999999999999999, 5}
    assert {r.mixed for r in df.collect()} == {"1", "x"} and {r.empty for r in df.collect()} == {None}
    given = csv.read_typed_csv(spark, str(file), delimiter="|", types={"id": df.schema["ratio"].dataType})
    assert given.schema["id"].dataType.simpleString() == "double"


def test_quoted_line_breaks_and_inference(spark, tmp_path):
    file = tmp_path / "q.csv"
    file.write_text('a,b\n1,"two\nlines"\n')
    assert rows(csv.read_cells(spark, str(file), multiline=True)) == [("1", "two\nlines")]
    (tmp_path / "i.csv").write_text("a,b\n1,2.5\n3,x\n")
    got = csv.read_inferred_csv(spark, str(tmp_path / "i.csv"))
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["int", "string"]


def test_file_order(spark, tmp_path):
    lines = ["v", *[str(i) for i in range(500)]]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    cells = csv.read_cells(spark, str(tmp_path / "a.csv"), position=True)
    indexed = record_index(cells, order_by=csv.POSITION, bucket=F.struct(*csv.POSITION[:2]))
    assert {int(r.v): r.record_index for r in indexed.collect()} == {i: i for i in range(500)}


def test_reference_data(spark, tmp_path):
    file = tmp_path / "codes.json"
    file.write_text(json.dumps({"mappings": {"Texas": "TX", "Utah": "UT"}}, indent=2))
    assert rows(reference.read_reference_data(spark, str(file))) == [("Texas", "TX", 0), ("Utah", "UT", 1)]
    with pytest.raises(ValueError, match="available: \\['codes'\\]"):
        reference.find_reference_data(spark, {"codes": str(file)}, "states")


def test_quality_rules(spark, tmp_path):
    model = {
        "schema_version": "1.0.0",
        "columns": [
            {"column_name": "year", "data_type": "integer", "constraints": {"is_nullable": False},
             "quality_checks": [{"check": "not_null"}, {"check": "range", "params": {"min": 2000}}]},
            {"column_name": "free", "data_type": "string"},
        ],
    }
    file = tmp_path / "model.json"
    file.write_text(json.dumps(model, indent=1))
    assert rows(reference.read_quality_rules(spark, str(file))) == [
        ("free", "string", None, None, None, None, None),
        ("year", "integer", False, 1, "not_null", None, None),
        ("year", "integer", False, 2, "range", 2000.0, None),
    ]
    assert reference.load_document(spark, str(file)) == model


def test_file_hashes(spark, tmp_path, path):
    want = "sha256:" + hashlib.sha256(TEXT.encode()).hexdigest()
    assert [r.content_hash for r in files.file_hashes(spark, path).collect()] == [want]
    lines = files.file_hashes(spark, path, how="lines").head()
    assert lines.content_hash.startswith("lines-sha256:") and lines.length == len(TEXT)


def test_a_file_beyond_two_gibibytes_has_a_byte_hash(spark, tmp_path):
    """More than a row of Spark can hold; the name needs no escaping."""
    big = tmp_path / "a file.bin"
    with open(big, "wb") as out:
        out.truncate((2 << 30) + 5)
    want = hashlib.sha256()
    for _ in range(256):
        want.update(bytes(8 << 20))
    want.update(bytes(5))
    got = {r.path.rsplit("/", 1)[-1]: (r.length, r.content_hash) for r in files.file_hashes(spark, str(tmp_path / "*.bin")).collect()}
    assert got == {"a file.bin": ((2 << 30) + 5, "sha256:" + want.hexdigest())}


def test_rows_of_empty_cells_and_positions(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\tc\n1\t2\t3\n\t\t\n  \n\n4\t\t6\n")
    found = csv.read_cells(spark, str(tmp_path / "t.tsv"), delimiter="\t", position=True).collect()
    assert sorted(((r["a"], r["b"], r["c"]) for r in found), key=repr) == sorted([("1", "2", "3"), (None,) * 3, (None,) * 3, (None,) * 3, ("4", None, "6")], key=repr)
    assert len({tuple(r[p] for p in csv.POSITION) for r in found}) == 5


def test_files_of_unlike_headers_are_refused(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "2.csv").write_text("b,a\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        csv.read_cells(spark, str(tmp_path)).collect()


def test_unreadable_reference_data_is_refused(spark, tmp_path):
    for text in ("{broken", '{"codes": {}}'):
        (tmp_path / "codes.json").write_text(text)
        with pytest.raises(Exception, match="no reference data"):
            reference.read_reference_data(spark, str(tmp_path / "codes.json")).collect()


def test_separator(spark, tmp_path):
    def detected(text, **options):
        file = tmp_path / f"s{len(list(tmp_path.iterdir()))}.csv"
        file.write_text(text)
        return csv.detect_separator(spark, str(file), **options)

    assert detected("a;b\n1,5;2\n2,5;3\n") == ";"  # commas are not in the header
    assert detected("a,b;c\n1,2;3\n1;3\n2;4\n") == ";"  # fewer lines have the header's commas
    assert detected('"a,b,c"\tx\n"1,2,3"\ty\n"say ""a,b"""\tz\n') == "\t"  # quoted ones do not count
    assert detected('a|b\n"open, and, more|x\n') == "|"
    assert detected("a,b,c|d\n1,2,3|4\n\n   \n") == ","  # equally consistent: more fields
    assert detected("one\n1;2\n") == "," and detected("") == "," and detected("a~b\n", candidates=["~"]) == "~"
    file = tmp_path / "typed.csv"
    file.write_text('id;text\n1;"a;b"\n2;c\n')
    assert rows(csv.read_detected_csv(spark, str(file))) == [(1, "a;b"), (2, "c")]
