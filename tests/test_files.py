"""Scans of a folder: what is listed, what is opened, and the status of each file."""

import os

import pytest
from pyspark.sql import functions as F

from spanloom.sources import files

FILES = {"a.py": b"print(1)\n", "src/b [1].md": "# é\n".encode(), "src/{c}*.txt": b"c", "empty.txt": b"  \n", "raw.txt": b"x\x00y", ".hidden/d.py": b"d", "node_modules/e.js": b"e", "pic.png": b"p", "deep/er/f.py": b"f"}


@pytest.fixture
def root(tmp_path):
    for name, content in FILES.items():
        path = tmp_path / "a+b (x)" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(tmp_path / "a+b (x)")


def known_of(spark, root):
    rows = files.scan(spark, root).select("path", "size", "mtime", "hash").collect()
    return spark.createDataFrame(rows, "path string, size long, mtime long, hash string")


def opened(df):
    return sorted(f.rsplit("/", 1)[-1] for f in df.inputFiles())


def test_scan_reads_contents(spark, root):
    got = {r.path: r for r in files.scan(spark, root).collect()}
    assert set(got) == {"a.py", "src/b [1].md", "src/{c}*.txt", "empty.txt", "raw.txt", "deep/er/f.py"}
    assert got["src/b [1].md"].text == "# é\n" and got["raw.txt"].binary and got["empty.txt"].blank and not got["a.py"].binary
    listed = spark.createDataFrame([("a.py",), (".hidden/d.py",), ("gone.py",)], "path string")
    assert [r.path for r in files.scan(spark, root, listed=listed).collect()] == ["a.py"]
    assert {r.path for r in files.scan(spark, root, most=1).collect()} == {"src/{c}*.txt", "deep/er/f.py"}


def test_nothing_is_opened_when_nothing_changed(spark, root):
    known = known_of(spark, root)
    diff, read = files.sync(spark, root, known)
    assert opened(read) == [] and read.count() == 0
    assert {r.status for r in diff.collect()} == {"unchanged"}


def test_only_due_files_are_opened(spark, root):
    known = known_of(spark, root)
    with open(f"{root}/a.py", "w") as f:
        f.write("print(22)\n")
    os.utime(f"{root}/deep/er/f.py", (1, 1))
    with open(f"{root}/new.py", "w") as f:
        f.write("n")
    os.remove(f"{root}/src/b [1].md")
    with open(f"{root}/src/{{c}}*.txt", "w") as f:
        f.write(" ")
    os.utime(f"{root}/src/{{c}}*.txt", (2, 2))
    diff, read = files.sync(spark, root, known)
    assert sorted(r.path for r in read.collect()) == ["a.py", "deep/er/f.py", "new.py", "src/{c}*.txt"]
    assert len(read.inputFiles()) == 4
    status = {r.path: r.status for r in diff.collect()}
    assert status == {"a.py": "changed", "deep/er/f.py": "touched", "new.py": "added", "src/b [1].md": "removed", "src/{c}*.txt": "empty", "empty.txt": "unchanged", "raw.txt": "unchanged"}


def test_listing_opens_nothing(spark, root):
    plan = files.listing(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    assert files.listing(spark, root).where(F.col("path") == "a.py").first().size == 9


def test_long_files_are_text(spark, tmp_path):
    """A file that ``most`` admits is judged by its bytes, not by the usual size of a source file."""
    (tmp_path / "long.txt").write_bytes(b"a b\n" * 300_000)
    (tmp_path / "raw.txt").write_bytes(b"x\x00" * 600_000)
    found = {r.path: (r.size, r.binary) for r in files.scan(spark, str(tmp_path), most=1 << 31).collect()}
    assert found == {"long.txt": (1_200_000, False), "raw.txt": (1_200_000, True)}
    none = spark.createDataFrame([], "path string, size long, mtime long, hash string")
    assert {r.path: r.status for r in files.sync(spark, str(tmp_path), none, most=1 << 31)[0].collect()} == {"long.txt": "added", "raw.txt": "binary"}


def test_contents_are_judged_whole(spark, tmp_path):
    """Long texts are texts, and a zero byte counts wherever it stands."""
    import duckdb

    from spanloom.plans.transcripts import SQL, text_contents

    texts = ["a", "b" * 3000, "c" * 3000 + "\0", "\0", "", None]
    tables = {
        "documents": ([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"),
        "pages": ([(i, t) for i, t in enumerate(texts)], "page_id long, html string"),
        "conversations": ([(7, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string"),
        "events": ([(i, t) for i, t in enumerate(texts)], "event_id long, props string"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = sorted(map(tuple, text_contents(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(con.execute(SQL["text_contents"]).fetchall(), key=repr)
    assert [r[3] for r in got if r[0] == "documents"] == [True, True, False, False, True, None]
