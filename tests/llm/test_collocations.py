"""Collocations against DuckDB and against plain loops."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import SF

from spanloom.llm import collocations
from spanloom.llm.queries import SQL, op12_collocations


def plain(docs, least, longest, percent, most):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    rows = []
    for lang, f in counts.items():
        found = [p for p, a in f.items() if len(p) > 1 and a >= least]
        within = defaultdict(int)
        for p in found:
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    within[p[i : i + n]] = max(within[p[i : i + n]], f[p])
        scored = []
        for p in found:
            if within[p] * 100 >= f[p] * percent and within[p]:
                continue
            cuts = [(1_000_000 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:most], 1):
            rows.append((lang, rank, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(rows)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    wanted = con.sql(SQL["op12_collocations"]).fetchall()
    assert len(wanted) > 100
    assert sorted(map(tuple, op12_collocations(spark, SF).collect())) == sorted(wanted)


@pytest.mark.parametrize(("least", "longest", "percent", "most"), [(2, 4, 50, 1000), (3, 3, 80, 7), (4, 2, 50, 50)])
def test_equals_plain_loops(spark, least, longest, percent, most):
    rng = random.Random(least)
    docs = [(rng.choice(["en", "de", None]), " ".join(rng.choice(["The", "the", "of", "a.", "b,c", "É", "x\ty", "z\n\n", "ÉA"]) for _ in range(rng.randint(0, 80)))) for _ in range(40)]
    docs += [("en", None), ("en", ""), (None, "..."), ("hot", "so it goes " * 500), ("hot", "so it goes")]
    table = spark.createDataFrame([(i, l, t, 1, 2, 3) for i, (l, t) in enumerate(docs)], "doc_id long, lang string, text string, a int, rank int, word int").repartition(3)
    got = collocations.collocations(table, least, longest, percent, most)
    assert sorted(map(tuple, got.collect())) == plain(docs, least, longest, percent, most)


def test_cases(spark, hard_docs, no_docs):
    assert collocations.collocations(no_docs).collect() == []
    assert sorted(map(tuple, collocations.collocations(hard_docs).collect())) == plain([(r.lang, r.text) for r in hard_docs.collect()], 10, 3, 50, 2000)


def test_radix_order_and_keys():
    rows = np.random.default_rng(3).integers(0, 1 << 32, (5000, 3), dtype=np.uint32)
    rows[::7] = rows[0]
    rows[::5] &= np.uint32(0xFF00)
    order = collocations.radix_order(collocations.keys_of(rows))
    assert [tuple(r) for r in rows[order].tolist()] == sorted(map(tuple, rows.tolist()))


def test_marks_must_fit():
    with pytest.raises(ValueError, match="marks"):
        collocations.ngrams(np.array([1, 2, 3], np.uint32), [np.array([True])])
