import random

import corpus_pipeline
from driftlens.llm.decontaminate import overlaps
from driftlens.llm.mixing import mix, sized
from driftlens.llm.common import Scratch
from driftlens.llm.quality import fit, score
from test_neardup import brute_force


def folder(spark, tmp_path, rows, labels, items):
    full = [(i, t, "en", s, len(t or ""), "e", "x") for i, t, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, row string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_every_stage_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    good = lambda n: ". ".join(" ".join(f"w{rng.randrange(900)}" for _ in range(9)).capitalize() for _ in range(n))
    rows = [(i, good(rng.randrange(4, 30)), f"s{i % 3}") for i in range(90)]
    rows += [(200 + i, "!! ".join(f"W{rng.randrange(900)}" for _ in range(80)), "s0") for i in range(40)]
    rows += [(300 + i, rows[i][1], "s1") for i in range(10)] + [(320 + i, rows[20 + i][1] + " One more.", "s2") for i in range(10)]
    items = [(1, " ".join(f"b{rng.randrange(900)}" for _ in range(40))), (2, None)]
    rows += [(400, rows[50][1] + " " + items[0][1], "s0"), (401, "", "s0"), (402, None, None), (403, "short", "s1"), (403, "short", "s1")]
    labels = [(i, int(i < 200), 0) for i in [*range(0, 80), *range(200, 235)]]
    sf_dir = folder(spark, tmp_path, rows, labels, items)

    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        assert name and (docs.columns == columns or number == 4)
        docs.write.parquet(f"{tmp_path}/out-{number}")
        docs = spark.read.parquet(f"{tmp_path}/out-{number}")
        kept.append([(r["doc_id"], r["text"]) for r in docs.collect()] if number < 4 else docs.collect())
    quality, unique, clean, mixed, packed = kept

    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = score(whole, fit(whole, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id", "text"])
    assert sorted(map(repr, quality)) == sorted(repr((r["doc_id"], r["text"])) for r in scores.where("score >= 0.3").collect())
    ids = {d for d, _ in quality}
    assert len(ids & set(range(90))) >= 88 and len(ids & set(range(200, 240))) <= 2

    least = {}
    for (doc, n, root) in brute_force(quality, 5, 80):
        least[doc] = root
    assert sorted(d for d, _ in unique) == sorted({d for d in least if least[d] == d})
    assert not {d for d, _ in unique} & {300 + i for i in range(10) if i in ids}

    assert {d for d, _ in unique} - {d for d, _ in clean} == {400}
    frame = spark.createDataFrame(unique, "doc_id long, text string")
    assert {r["doc_id"] for r in overlaps(frame, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()} == {400}

    again = spark.read.parquet(f"{tmp_path}/out-2")
    copies = {r["doc_id"]: r["copies"] for r in mix(sized(again), Scratch(spark, "test")).collect()}
    assert sorted(d for d, _ in mixed) == sorted(d for d, n in copies.items() for _ in range(n))

    placed = sorted(d for r in packed for d, p in zip(r["doc_ids"], r["piece"]) if p == 0)
    assert placed == sorted(d for d, t in mixed if t)
    ran = corpus_pipeline.run(spark, sf_dir)
    key = lambda r: (sorted(zip(r["doc_ids"], r["piece"])), r["n_tokens"])
    assert sum(r["n_tokens"] for r in ran.collect()) == sum(r["n_tokens"] for r in packed)
    assert [k for k, _ in corpus_pipeline.STAGES] and key(packed[0])


def test_empty_documents(spark, tmp_path):
    sf_dir = folder(spark, tmp_path, [], [(1, 1, 0)], [(1, "a b c d e f g")])
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
