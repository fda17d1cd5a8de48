"""Layout and encoding of delimited files."""

import gzip

import pytest

from gridvigil.sources import files


def written(folder, **contents):
    folder.mkdir(exist_ok=True)
    for name, data in contents.items():
        (folder / name.replace("_csv", ".csv").replace("_gz", ".gz")).write_bytes(data)
    return str(folder)


def rows_of(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_a_late_latin_row_decides_for_its_file(spark, tmp_path):
    body = b"id,name\n" + b"".join(b"%d,plain\n" % i for i in range(20000)) + "20000,café\n".encode("latin-1")
    folder = written(
        tmp_path / "a b é",
        old_csv=body + "20001,Ã©\n".encode("latin-1"),  # by itself valid UTF-8, yet Latin-1 as its file is
        new_csv="id,name\n1,naïve\n".encode(),
        packed_csv_gz=gzip.compress("id,name\n2,Müll\n".encode("latin-1")),
        empty_csv=b"",
    )
    paths = files.find_files(spark, folder, "*.csv*")
    df = files.read_delimited(spark, paths)
    found = dict(rows_of(df.where("id >= 20000 or _source_file not like 'old%'"), "id", "name"))
    assert found == {"20000": "café", "20001": "Ã©", "1": "naïve", "2": "Müll"}
    assert df.count() == 20004


def test_first_lines_are_read_from_the_start_alone(spark, tmp_path, monkeypatch):
    long = ",".join(f"c{i}" for i in range(30000)).encode()
    folder = written(
        tmp_path / "x", one_csv=b"\xef\xbb\xbfa;b;c\r\n1;2,5;3\r\n", two_csv=long + b"\n", three_csv=b"a,b", four_csv=b"\n1\n", five_csv=b"a\rb\r"
    )
    paths = files.find_files(spark, folder)
    lines = {p.rsplit("/", 1)[1]: line for p, line in files.header_lines(spark, paths).items()}
    assert lines == {"one.csv": b"a;b;c", "two.csv": long, "three.csv": b"a,b", "four.csv": b"", "five.csv": b"a"}
    monkeypatch.setattr(files, "MAX_HEADER", 1000)
    with pytest.raises(ValueError, match="no line end"):
        files.header_lines(spark, [p for p in paths if "two" in p])


def test_semicolons_and_decimal_commas(spark, tmp_path):
    folder = written(tmp_path / "y", one_csv=b" a ;b;c\n1;2,5;x,y\n", two_csv=b"a,b,c\n3,4.5,z\n")
    df = files.read_delimited(spark, files.find_files(spark, folder))
    assert rows_of(df, "a", "b", "c") == [("1", "2.5", "x,y"), ("3", "4.5", "z")]
