import hashlib
import random
import re

from driftlens.llm.common import Scratch
from driftlens.llm.pii import KINDS, candidates, count_cells, expectation_maximisation, find_personal_data, train


def luhn(digits):
    total = 0
    for i, sign in enumerate(reversed(digits)):
        d = int(sign) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    digits = lambda m: re.sub(r"\D", "", m[0])
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def join(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


EDGES = [
    "a@b.c+d@e.f@g.h", "a.b@c-d.e.f.", "x@y", "@a.b", "a@b..c", "1.2.3.4.5.6.7.8", "1.2.3.400", "0001.2.3.0255 1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "00000000000000", "4111  1111 1111 1111", "+1 (917) 555-2670", "++1 917 555 2670", "+1 917 555 2670 (", "+12", "é\U0001f600 a@b.co \u0001 1.2.3.4", "+1-1.2.3.4-5555555 a@1.2.3.4",
    "4944339490429605 +4944339490429605", "", None, "a" * 50_000, "1" * 50_000, "1 " * 40_000, "a@" + ".b" * 20_000, "+1" + " " * 30_000, "1." * 20_000 + "a@b.c", "a-" * 30_000 + "@b.c",
]


def test_base_spans_equal_the_plain_form(spark, documents):
    rng = random.Random(4)
    signs = ["a", "Z", "@", ".", "-", "+", " ", "(", ")", "1", "25", "0", "%", "_", "\n", "é", "\U0001f600", "x@y.z", "+1 212 555 0100", "10.0.0.1", "4111111111111111"]
    rows = list(enumerate(EDGES + ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(400)]))
    rows += [(3, rows[3][1]), (None, "a@b.co")]
    found = find_personal_data(documents(rows), Scratch(spark, "test")).collect()
    assert len(found) == len(rows)
    own = {r["doc_id"]: r for r in found}
    for doc, text in rows:
        spans = plain(text or "")
        row = own[doc]
        assert row["base_sha256"] == hashlib.sha256(join(spans).encode()).hexdigest(), (doc, text and text[:80], join(spans)[:200], row["spans"][:200])
        assert [row[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in spans) for k in KINDS]
        assert set(join(spans).split(",")) <= set(row["spans"].split(","))


def test_loose_forms_are_added_and_prose_is_left_alone(spark, documents):
    base = [(i, f"Mail jo.{i}@mail.example.com or call +1 (917) 555-{2000 + i} from 10.2.3.{i % 200} with card 4111 1111 1111 1111 now.") for i in range(60)]
    loose = [(100, "write to jane.doe [at] example [dot] com today"), (101, "Tel: 917-555-2670."), (102, "card 4111.1111.1111.1111 was used"), (103, "host fe80:0:0:0:1:2:3:4 answers")]
    clean = [(200, "look at this. Words at the end dot matrix"), (201, "version 1.2.3 of 2024-01-02"), (202, "code 123-156-78901 and 4111.1111.1111.1112"), (203, "at 12:30:45 they met")]
    found = {r["doc_id"]: r["spans"] for r in find_personal_data(documents(base + loose + clean), Scratch(spark, "test")).collect()}
    assert found[100] == "email:9:40" and found[101] == "phone:5:17" and found[102] == "card:5:24" and found[103] == "ip:5:23"
    assert [found[i] for i, _ in clean] == [""] * 4
    cells = count_cells(candidates(documents(base + loose + clean)))
    assert sum(n for _, _, n in cells) >= 240 and set(train(cells)) == set(KINDS)


def test_estimates_trust_the_labeler_that_agrees_with_the_others():
    cells = [((1, 1, 1, 0), 80), ((-1, -1, 0, -1), 80), ((1, -1, 1, 0), 5), ((-1, 1, 0, -1), 5)]
    reliability, chance = expectation_maximisation(cells)
    assert chance[0] > 0.95 and chance[1] < 0.05 and chance[2] > 0.5 > chance[3]
    assert reliability[0][1][1] > reliability[0][1][0]


def test_plan_has_no_python(spark, documents):
    plan = find_personal_data(documents([(1, "a@b.co")]), Scratch(spark, "test"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark, documents):
    assert find_personal_data(documents([(1, "a")]).where("false"), Scratch(spark, "test")).count() == 0
