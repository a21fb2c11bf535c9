import duckdb

from driftlens.llm.common import Scratch
from driftlens.llm.mixing import emit, mix, sized, targets
from driftlens.llm.sql import MIXING


def test_rows_equal_sql_with_nulls_ties_and_repeats(spark, documents):
    rows = [(i, "w " * (i % 7), ("b", "a", None, "é")[i % 4]) for i in range(200)] + [(5, "w " * 5, "a"), (5, "w " * 5, "a"), (900, None, "z"), (901, "\t\n ", "z"), (902, "x y", "b")]
    frame = documents(rows)
    mixed = mix(sized(frame), Scratch(spark, "test"))
    ours = sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"] * r["size"]) for r in mixed.collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(i, t, s) for i, t, s in rows])
    theirs = sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in con.execute(MIXING).fetchall())
    assert ours == theirs


def test_caps_are_shared_again(spark):
    sizes = spark.createDataFrame([(1, "a", 10), (2, "b", 1), (3, "c", 1000), (4, "d", 0)], "doc_id long, source string, size long")
    found = {r["source"]: r["target"] for r in targets(sizes).collect()}
    assert found["b"] == 3.0 and found["a"] == 30.0 and found["d"] == 0.0 and abs(found["c"] - 978.0) < 1e-9


def test_emit_repeats_documents_as_the_mix_takes_them(spark, documents):
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(40)] + [(3, "w w w w", "b")] * 3
    frame = documents(rows)
    out = emit(frame)
    assert out.columns == frame.columns
    wanted, got = {}, {}
    for r in mix(sized(frame), Scratch(spark, "test")).collect():
        wanted[r["doc_id"], r["size"]] = wanted.get((r["doc_id"], r["size"]), 0) + r["copies"]
    for r in out.collect():
        key = r["doc_id"], len(r["text"].split())
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in wanted.items() if n}
    assert sorted(map(repr, emit(frame).collect())) == sorted(map(repr, out.collect()))


def test_empty_table(spark, documents):
    assert emit(documents([(1, "a")]).where("false")).count() == 0
