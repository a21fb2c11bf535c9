import hashlib
import random
from collections import Counter, defaultdict

import pytest

from driftlens.llm import alignment
from driftlens.llm.alignment import MODEL_B, VOCABULARY_A, alignment_report

TEXTS = [
    None, "", " ", "a", "Hello world", " leading space", "trailing space ", "two  blanks\n\nand\tlines\r\n", "naïve café Straße übergrößen", "日本語の文章です。改行なし", "emoji \U0001f600\U0001f600‍\U0001f469 end",
    "<|endoftext|> <s> </s> <unk> <0x41>", "x" * 3000, "=" * 500 + "-" * 333, "piece ▁ mark", "nul \x00 byte", "def f(x):\n    return {x: [1, 22, 333]}\n", "http://example.org/a_b?c=d&e=%20", "supercalifragilisticexpialidocious antidisestablishmentarianism",
    "word " * 4000, "﻿bom", "á combining", " no-break", "Ünïcödé " * 50, "1234567890 " * 20, "THE the The tHe", "Привет мир, это проверка", "مرحبا بالعالم",
]


def brute_force(texts):
    """Plainly, from the contract: byte ranges, groups by common ends, all link occurrences."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(VOCABULARY_A), sentencepiece.SentencePieceProcessor(model_file=MODEL_B)
    a.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(k): k for k in keep} | {chr(256 + n): k for n, k in enumerate(k for k in range(256) if k not in keep)}

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()

    documents, held = [], defaultdict(int)
    for text in texts:
        links, groups, n_a, n_b = Counter(), [], 0, 0
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a, bytes_b = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a], [piece(i) for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
                n_a, n_b = len(ids_a), len(ids_b)
                ends = []
                for tokens in (bytes_a, bytes_b):
                    place = 0
                    ends.append([place := place + len(t) for t in tokens])
                common, i, j = sorted(set(ends[0]) & set(ends[1])), 0, 0
                for end in common:
                    x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
                    groups.append((ids_a[i:x], ids_b[j:y]))
                    i, j = x, y
                for x, y in groups:
                    links.update((p, q) for p in x for q in y)
        for pair in links:
            held[pair] += 1
        documents.append((n_a, n_b, groups, links))
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for n_a, n_b, groups, links in documents:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in links.items() if held[p] == highest[p[0]])
        out.append((n_a, n_b, len(groups), sum(links.values()), best, sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def rows_of(frame):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("heavy,large", [(alignment.HEAVY, alignment.LARGE_GROUP), (40, 1), (1, 6)])
def test_equals_brute_force(spark, documents, monkeypatch, heavy, large):
    monkeypatch.setattr(alignment, "LARGE_GROUP", large)
    rng = random.Random(2)
    words = [w for t in TEXTS if t and len(t) < 200 for w in t.split()]
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(60)] + ["word word"] * 30
    ids = [*range(len(texts) - 3), None, 5, 5]
    found = rows_of(alignment_report(documents(list(zip(ids, texts))), heavy=heavy))
    assert found == sorted(((i, *r) for i, r in zip(ids, brute_force(texts))), key=repr)


def test_memory_of_windows_may_be_small():
    a, b = alignment.tokens_a(), alignment.tokens_b()
    windows, small = alignment.Windows(a, b), alignment.Windows(a, b)
    texts = [t for t in TEXTS if t]
    whole = alignment.align_texts(texts, a, b, windows)
    again = alignment.align_texts(texts, a, b, windows)
    assert windows.known and all((x == y).all() if hasattr(x, "all") else x == y for x, y in zip(whole, again))
    for k, text in enumerate(texts):
        small.clear()
        counts, digests, _, pairs, _ = alignment.align_texts([text], a, b, small)
        assert (counts[0] == whole[0][k]).all() and digests[0] == whole[1][k] and (pairs == whole[3][whole[2] == k]).all()


def test_very_long_runs():
    a, b = alignment.tokens_a(), alignment.tokens_b()
    texts = [" " * 1_200_000, "ab" * 100_000, "\n" * 300_000 + "end"]
    counts = alignment.align_texts(texts, a, b, alignment.Windows(a, b))[0]
    assert (counts > 0).all()


def test_empty_table(spark, documents):
    assert alignment_report(documents([(1, "x")]).where("false")).count() == 0
