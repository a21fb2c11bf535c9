import hashlib
import re

import pytest

from driftlens.llm.exact import Ledger, exact_duplicates

LONG = "many words " * 20000
ROWS = [
    (1, "a b c"), (2, "abc"), (3, "a  b\tc "), (4, "a  b\tc "), (5, "a bc"), (6, None), (7, ""), (8, " \x0b\x0c\r\n"), (9, LONG), (10, LONG + " "),
    (11, "Abc"), (None, "only without id"), (None, "x y"), (12, "xy"), (13, "z"), (13, "z"), (13, "z "), (-9223372036854775808, "m"), (9223372036854775807, "m"),
    (14, "é"), (15, "é"), (16, "a\x00b"), (17, "ab"), (18, "\U0001f600 \U0001f600"), (19, "\U0001f600\U0001f600"), *((100 + i, "hot " * 3) for i in range(300)),
]


def expected(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), i is None, i or 0, i))
    out = []
    for i, text in rows:
        plain = re.sub(r"[\x20\x09-\x0d]", "", text or "")
        out.append((i, min(groups[plain])[3], len(groups[plain]), hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, folder, rows):
    full = [(i, t, "x", 1, 2, b"d", "m") for i, t in rows]
    names = "doc_id long, text string, file string, row int, best int, digest binary, _metadata string"
    spark.createDataFrame(full, names).repartition(3).write.mode("append").parquet(str(folder))
    return str(folder)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_equals_brute_force_even_where_digests_collide(spark, tmp_path, digest_bytes):
    found = exact_duplicates(spark, table(spark, tmp_path / "docs", ROWS), digest_bytes=digest_bytes).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == expected(ROWS)
    kept = {}
    for r in found:
        kept.setdefault(r.text_sha256, []).append(r) if r.kept else None
    assert len(kept) == len({r.text_sha256 for r in found}) and all(len(k) == 1 and k[0].doc_id == k[0].keep_id for k in kept.values())


def test_later_files_are_folded_into_the_state(spark, tmp_path):
    path, home = str(tmp_path / "docs"), str(tmp_path / "home")
    table(spark, path, ROWS[:9])
    exact_duplicates(spark, path, home).collect()
    table(spark, path, ROWS[9:])
    found = exact_duplicates(spark, path, home).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == expected(ROWS)
    ledger = Ledger(spark, path, home)
    ledger.append()  # nothing new: nothing is read twice
    ledger.fold()
    assert ledger.rows().count() == len(ROWS) and ledger.state().agg({"copies": "sum"}).first()[0] == len(ROWS)


def test_small_batches_give_the_same(spark, tmp_path):
    path = table(spark, tmp_path / "docs", ROWS)
    found = exact_duplicates(spark, path, batch_bytes=1).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == expected(ROWS)


def test_empty_table(spark, tmp_path):
    assert exact_duplicates(spark, table(spark, tmp_path / "docs", [])).count() == 0


def test_plan_has_no_python(spark, tmp_path):
    plan = exact_duplicates(spark, table(spark, tmp_path / "docs", ROWS[:5]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
