import random

import pytest
from pyspark.sql import functions as F

from driftlens.llm.quality import accepted, fit, held_out, score


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("the", "an", "wer", "ion", "ed", "ly", "st") for b in ("re", "in", "on", "th", "es", "al", "ti")]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 200))]
        kind = i % 6
        if kind == 0:
            text = " | ".join(words)
        elif kind == 1:
            text = "!! ".join(w.upper() for w in words)
        elif kind == 2:
            text = (rng.choice(words) + " ") * 150
        else:
            text = ". ".join(" ".join(words[k : k + 8]).capitalize() for k in range(0, len(words), 8)) + "."
        rows.append((i, text))
        if i % 4:
            labels.append((i, int(kind > 2), 0))
    return rows, labels


@pytest.fixture
def tables(spark, documents):
    rows, labels = corpus()
    rows += [(900, ""), (901, None), (902, "x" * 100_000), (3, rows[3][1]), (None, rows[4][1])]
    labels += [(5000, 1, 0), (7, None, 1), (None, 1, 0)]
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_held_out_accuracy(tables):
    frame, labels, rows = tables
    scored = score(frame, fit(frame, labels), ["doc_id", "size"]).withColumn("held_out", held_out(F.col("doc_id")))
    assert scored.count() == len(rows) and scored.columns == ["doc_id", "size", "score", "held_out"]
    judged = [(r["score"], int(r["doc_id"] % 6 > 2)) for r in scored.where("held_out AND doc_id < 240").collect()]
    assert len(judged) > 25 and sum((s >= 0.3) == bool(y) for s, y in judged) / len(judged) > 0.95
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_scores_depend_on_the_text_alone(tables):
    frame, labels, _ = tables
    model = fit(frame, labels)
    other = frame.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10_000)
    one, two = (sorted((r["text"] or "", r["score"]) for r in score(f, model, ["text"]).collect()) for f in (frame, other))
    assert one == two


def test_held_out_labels_teach_nothing(tables):
    frame, labels, _ = tables
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert fit(frame, labels) == fit(frame, turned)


def test_accepted_keeps_columns_and_good_documents(tables):
    frame, labels, _ = tables
    kept = accepted(frame, labels)
    assert kept.columns == frame.columns
    ids = [r["doc_id"] for r in kept.where("doc_id < 240").collect()]
    assert sum(i % 6 > 2 for i in ids) >= 118 and sum(i % 6 < 3 for i in ids) <= 6
    assert {900, 901} <= {r["doc_id"] for r in kept.collect()}


def test_the_dictionaries_see_all_parts_of_long_texts(spark, documents):
    rows = [(i, "".join(f"{part}{i:04d} " * 1500 for part in ("start", "upper", "lower", "final"))) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    model = fit(documents(rows), labels)
    for dictionary in (model.good, model.bad):
        assert all(dictionary.count(part) > 50 for part in (b"start", b"upper", b"lower", b"final"))


def test_without_labels_every_score_is_the_prior(spark, documents):
    frame = documents([(1, "some text"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in score(frame, fit(frame, none), ["doc_id"]).collect()] == [0.5, 0.5]
    good = spark.createDataFrame([(2, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert len({r["score"] for r in score(frame, fit(frame, good), ["doc_id"]).collect()}) == 1
    assert score(frame.where("false"), fit(frame, none), ["doc_id"]).count() == 0
