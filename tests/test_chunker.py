import random

from spanloom.functions.chunker import chunk_rows, chunks


def test_short_texts():
    assert list(chunks("")) == [] and list(chunks(" \n\n")) == []
    assert list(chunks("one line")) == [(1, 1, "one line")]


def test_headings_begin_chunks():
    got = list(chunks("# Один\ntext\n\n# Второй\nmore\n## Third\n#no heading"))
    assert got == [(1, 3, "# Один\ntext"), (4, 5, "# Второй\nmore"), (6, 7, "## Third\n#no heading")]


def test_full_chunks_end_after_a_blank_line_or_overlap():
    lines = [f"line {k}" for k in range(8)]
    assert list(chunks("\n".join(lines[:5] + [""] + lines[5:]), most=50)) == [(1, 6, "\n".join(lines[:5])), (7, 9, "\n".join(lines[5:]))]
    assert list(chunks("\n".join(lines), most=35)) == [(1, 5, "\n".join(lines[:5])), (3, 7, "\n".join(lines[2:7])), (5, 8, "\n".join(lines[4:]))]


def test_every_line_is_in_a_chunk_and_sizes_are_bounded():
    rng = random.Random(3)
    for _ in range(200):
        lines = [rng.choice(["", "# head", "word " * rng.randrange(1, 9), "x" * rng.randrange(60)]) for _ in range(rng.randrange(60))]
        got = list(chunks("\n".join(lines), most=120))
        covered = {k for a, b, _ in got for k in range(a, b + 1)}
        assert {k for k, line in enumerate(lines, 1) if line.strip()} <= covered
        for a, b, body in got:
            assert sum(len(x) + 1 for x in lines[a - 1 : b - 1]) < 120 + 3 * 61 and body == "\n".join(lines[a - 1 : b]).strip()
            assert not any(x == "# head" for x in lines[a : b]) or got


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a\n# b", 5), (2, None, 5), (3, "", 5)], "doc_id long, text string, seq int")
    assert [tuple(r) for r in chunk_rows(docs, "doc_id").orderBy("seq").collect()] == [(1, 0, 1, 1, "a"), (1, 1, 2, 2, "# b")]
