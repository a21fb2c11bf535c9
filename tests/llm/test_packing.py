import random

from hypothesis import given, settings
from hypothesis import strategies as st

from driftlens.llm.packing import best_fit_decreasing, pack, tokenizer


def slow_best_fit(sizes, most):
    rooms, rows = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [r for r in range(len(rooms)) if rooms[r] >= sizes[i]]
        if fits:
            best = min(rooms[r] for r in fits)
            row = [r for r in fits if rooms[r] == best][0]
        else:
            row = len(rows)
            rooms.append(most)
            rows.append([])
        rooms[row] -= sizes[i]
        rows[row].append(i)
    return rows, rooms


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=80))
def test_best_fit_decreasing_leaves_the_rooms_of_the_slow_form(sizes):
    rows = best_fit_decreasing(sizes, 37)
    assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
    assert sorted(37 - sum(sizes[i] for i in row) for row in rows) == sorted(slow_best_fit(sizes, 37)[1])


def test_round_trip(documents):
    rng = random.Random(1)
    rows = [(i, " ".join(f"word{rng.randrange(50)}" for _ in range(rng.choice([1, 9, 40, 400])))) for i in range(60)]
    rows += [(100, ""), (101, None), (102, "<|endoftext|> is text é中\U0001f600"), (None, "no id"), (200, "same"), (200, "other")]
    packed = pack(documents(rows), row_length=64, buffer=3000).collect()
    encode, pieces = tokenizer(), {}
    assert len({r["row_id"] for r in packed}) == len(packed)
    for row in packed:
        ends = row["cu_seqlens"]
        assert ends[0] == 0 and ends[-1] == row["n_tokens"] <= 64 and len(row["ids"]) == len(row["position_ids"]) == 64
        for doc, piece, a, b in zip(row["doc_ids"], row["piece"], ends, ends[1:]):
            assert row["position_ids"][a:b] == list(range(b - a))
            pieces.setdefault(doc, []).append((piece, row["ids"][a:b]))
        assert all(i == 50256 for i in row["ids"][ends[-1] :])
    for doc, text in rows:
        if doc == 200 or not text:
            continue
        assert [i for _, ids in sorted(pieces[doc]) for i in ids] == encode(text).tolist()
    assert sorted(ids for _, ids in pieces[200]) == sorted(encode(t).tolist() for t in ("same", "other"))
    assert 100 not in pieces and 101 not in pieces


def test_empty_table(documents):
    assert pack(documents([(1, "a")]).where("false")).count() == 0
