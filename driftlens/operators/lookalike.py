"""Names that imitate popular ones. The popular list is an input: (name, ord) in order of preference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions import names as N
from driftlens.schema import evidence_of, to_findings
from driftlens.session import spread


def candidate_pairs(names: DataFrame, popular: DataFrame, max_distance: int = 2) -> DataFrame:
    """Pairs (name, target, ord, word, target_word) among which is each name's nearest popular one, if within two edits.

    Names are made distinct first. Candidate pairs come from equality joins, never from pairing every name with every
    popular name: a popular word of three letters or more is cut into three segments, one of which stands in any word
    within two edits, at a place that lengths and edits leave open; a shorter one is met by forms with letters left out.
    Words of up to two letters are within two edits of one another in any case; of those the first of the list for each
    length is enough.
    """
    listed = popular.groupBy("name").agg(F.min("ord").alias("ord"))
    fresh = spread(names.select("name").distinct().join(listed.select("name"), "name", "left_anti"), "name")
    scope, base = N.scope_of(F.col("name")), N.base_of(F.col("name"))
    # A scope that itself looks like a domain or hyphenated brand also compares by base name to unscoped targets.
    spaces = F.array_compact(
        F.array(
            F.struct(F.coalesce(scope, F.lit("")).alias("space"), F.when(scope.isNull(), F.col("name")).otherwise(base).alias("word")),
            F.when(
                scope.isNotNull() & scope.rlike(r"[-._]") & (F.length(base) > 0),
                F.struct(F.lit("").alias("space"), base.alias("word")),
            ),
        )
    )
    left = fresh.select("name", F.explode(spaces).alias("s")).select("name", "s.space", "s.word")
    right = listed.select(
        F.col("name").alias("target"), "ord",
        F.coalesce(scope, F.lit("")).alias("space"),
        F.when(scope.isNull(), F.col("name")).otherwise(base).alias("target_word"),
    )
    short, pair = N.LEAST_SEGMENTED - 1, ["name", "target", "ord", "word", "target_word"]
    # Adaptive execution broadcasts the keys of a short list by their real size; a long list shuffles.
    by_segment = left.withColumn("key", F.explode(N.segment_probes(F.col("word")))).join(
        right.withColumn("key", F.explode(N.segments(F.col("target_word")))), ["space", "key"]
    )
    by_form = left.withColumn("key", F.explode(N.short_forms(F.col("word"), short + max_distance))).join(
        right.withColumn("key", F.explode(N.short_forms(F.col("target_word"), short))), ["space", "key"]
    )
    size = F.length("target_word")
    firsts = right.filter(size <= short).groupBy("space", size.alias("size")).agg(F.min(F.struct("ord", "target", "target_word")).alias("t"))
    by_length = left.filter(F.length("word") <= short).join(firsts, "space").select("name", "t.target", "t.ord", "word", "t.target_word")
    return (
        by_segment.select(*pair).unionByName(by_form.select(*pair)).unionByName(by_length)
        .filter(F.abs(F.length("word") - F.length("target_word")) <= max_distance)
        .distinct()
    )


def nearest_popular(names: DataFrame, popular: DataFrame, max_distance: int = 2) -> DataFrame:
    """(name, target, distance) for names within ``max_distance`` (at most 2) of a popular one.

    The exact distance is computed for candidates only. Smaller distance wins, then list order.
    """
    return (
        candidate_pairs(names, popular, max_distance).withColumn("distance", N.edit_distance("word", "target_word"))
        .groupBy("name")
        .agg(F.min(F.struct("distance", "ord", "target")).alias("best"))
        .filter(F.col("best.distance") <= max_distance)
        .select("name", "best.target", "best.distance")
    )


def hyphen_neighbours(names: DataFrame, popular: DataFrame) -> DataFrame:
    """(name, target, shape) where hyphen tokens are reordered, extended by one or short of one.

    A set-similarity join on tokens: equality on each token, then overlap counts per pair. At least two
    tokens must be shared, so the join key is the pair of tokens, which keeps common words such as
    "js" from gathering everything in one group.
    """
    listed = popular.groupBy("name").agg(F.min("ord").alias("ord"))
    top = listed.filter(F.lower(N.base_of(F.col("name"))).contains("-")).select(
        F.col("name").alias("target"), "ord", N.name_tokens(F.col("name")).alias("theirs")
    )
    fresh = (
        names.select("name").distinct().join(listed.select("name"), "name", "left_anti")
        .withColumn("ours", N.name_tokens(F.col("name")))
    )

    def token_pairs(tokens):
        """Each unordered pair of distinct tokens (they are sorted)."""
        return F.flatten(
            F.transform(
                tokens,
                lambda a: F.transform(F.filter(tokens, lambda b: a < b), lambda b: F.concat(a, F.lit(" "), b)),
            )
        )

    left = fresh.filter(F.size("ours") >= 2).withColumn("pair", F.explode(token_pairs(F.col("ours"))))
    right = top.filter(F.size("theirs") >= 2).withColumn("pair", F.explode(token_pairs(F.col("theirs"))))
    matched = (
        left.join(right, "pair")
        .filter(F.abs(F.size("ours") - F.size("theirs")) <= 1)
        .select("name", "target", "ord", "ours", "theirs")
        .distinct()
    )
    common = F.size(F.array_intersect("ours", "theirs"))
    extra, missing = F.size("ours") - common, F.size("theirs") - common
    shape = (
        F.when((extra == 0) & (missing == 0), "reorder")
        .when((extra == 1) & (missing == 0), "add-token")
        .when((extra == 0) & (missing == 1), "drop-token")
    )
    rank = F.when(F.col("shape") == "reorder", 0).otherwise(1)
    return (
        matched.withColumn("shape", shape)
        .filter(F.col("shape").isNotNull())
        .groupBy("name")
        .agg(F.min(F.struct(rank.alias("rank"), "ord", "target", "shape")).alias("best"))
        .select("name", "best.target", "best.shape")
    )


def _added(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("from_ver").isNull())


def typosquat_candidates(pairs: DataFrame, popular: DataFrame) -> DataFrame:
    near = nearest_popular(_added(pairs).select(F.col("package").alias("name")), popular)
    rows = _added(pairs).join(near.withColumnRenamed("name", "package"), "package")
    distance = F.col("distance").cast("string")
    return to_findings(
        rows, "deps.typosquat-candidate", "DEPS", "WARN",
        F.when(F.col("distance") <= 1, "high").otherwise("medium"),
        F.concat(F.col("package"), F.lit(" is "), distance, F.lit(" edit(s) away from the popular "), F.col("target")),
        evidence_of(
            F.lit("package.json"), F.lit(1),
            F.concat(F.lit('"'), F.col("package"), F.lit('" (distance '), distance, F.lit(' from "'), F.col("target"), F.lit('")')),
        ),
    )


def hyphen_permutations(pairs: DataFrame, popular: DataFrame) -> DataFrame:
    near = hyphen_neighbours(_added(pairs).select(F.col("package").alias("name")), popular)
    rows = _added(pairs).join(near.withColumnRenamed("name", "package"), "package")
    reorder = F.col("shape") == "reorder"
    text = F.concat(F.lit('"'), F.col("package"), F.lit('" is a hyphen-token '), F.col("shape"), F.lit(' of "'), F.col("target"), F.lit('"'))
    return to_findings(
        rows, "typo.hyphen-permutation", "DEPS",
        F.when(reorder, "BLOCK").otherwise("WARN"), F.when(reorder, "high").otherwise("medium"),
        text, evidence_of(F.lit("package.json"), F.lit(1), text),
    )
