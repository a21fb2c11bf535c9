"""Dependency graph questions: paths from the root, subtrees, roll-up of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.operators.run_paths import COLUMNS, walk_runs
from driftlens.schema import rank_label, severity_rank
from driftlens.session import cut_lineage, spread

#: Levels after which the tables of visited keys become one, so that plans of deep graphs stay short.
MERGE_EVERY = 12


#: Paths found since the edges into visited keys were last dropped, from which dropping them pays.
PRUNE_FROM = 1_000_000
#: Keys of a run whose graph one task walks, and runs of that kind from which this pays: fewer would leave tasks idle.
RUN_KEYS, RUNS_FROM = 5_000, 32


def _repeated_names(keyed: DataFrame) -> DataFrame:
    """(run, name) of names with several keys."""
    return keyed.groupBy("run_id", "name").agg(F.count(F.lit(1)).alias("keys")).filter("keys > 1").select("run_id", "name")


def _blocking_names(keyed: DataFrame, edges: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which names a path may still meet again below a key: (run, key, live), and (run, name) of those that may meet another first.

    A name blocks only where one key of it lies below another. The walk down from the keys of repeated names finds such
    pairs; the walk up from the lower ones, within what the first walk saw, finds the keys in between. Both carry
    distinct (name, key) rows. Few names nest in themselves, so the second walk is short.
    """
    steps = cut_lineage(edges.select("run_id", F.col("parent_key").alias("key"), F.col("child_key").alias("next")).distinct())
    below = _reach(keyed.join(repeated, ["run_id", "name"]).select("run_id", F.col("name").alias("tag"), "key"), steps)
    named = keyed.select("run_id", F.col("key").alias("next"), F.col("name").alias("tag"))
    met = cut_lineage(below.join(steps, ["run_id", "key"]).join(named, ["run_id", "next", "tag"]))
    upward = steps.select("run_id", F.col("next").alias("key"), F.col("key").alias("next"))
    above = _reach(met.select("run_id", "tag", "key"), upward, within=below)
    live = cut_lineage(above.groupBy("run_id", "key").agg(F.array_sort(F.collect_set("tag")).alias("live")))
    lower = met.select("run_id", F.col("next").alias("key"), F.col("tag").alias("name")).distinct()
    several = lower.join(live, ["run_id", "key"]).filter(F.size(F.array_remove("live", F.col("name"))) > 0).select("run_id", "name").distinct()
    return live, several


def _enough(rows: Column, live: Column, several: Column, max_paths: int) -> Column:
    """Of the paths to one key, in queue order, those that can still be among the first ``max_paths`` somewhere below.

    A path is out if ``max_paths`` kept ones before it hold no name that it does not hold: they go wherever it goes. If no
    way on meets more than one of the live names, a path is needed only among the first ``max_paths`` of all, or of those
    that do not hold one of the names; then a key keeps at most ``max_paths`` paths a live name.
    """

    def step(kept: Column, path: Column) -> Column:
        wider = F.size(F.filter(kept, lambda k: F.size(F.array_except(k["held"], path["held"])) == 0)) >= max_paths
        return F.when(wider, kept).otherwise(F.concat(kept, F.array(path)))

    def first(places: Column) -> Column:
        return F.slice(places, 1, max_paths)

    places = F.sequence(F.lit(0), F.size(rows) - 1)
    free = F.transform(live, lambda name: first(F.filter(places, lambda i: ~F.array_contains(F.get(rows, i)["held"], name))))
    single = F.transform(F.array_sort(F.array_distinct(F.concat(first(places), F.flatten(free)))), lambda i: F.get(rows, i))
    return F.when(several, F.aggregate(rows, F.filter(rows, lambda _: F.lit(False)), step)).otherwise(single)


def provenance_paths(nodes: DataFrame, edges: DataFrame, max_paths: int = 3) -> DataFrame:
    """Up to ``max_paths`` shortest name paths from the root to every node of each run.

    Many runs of few keys are dealt by run and walked whole, each in one task, by the same rules. Larger runs are walked
    together, level by level.
    """
    keyed = cut_lineage(nodes.filter(F.col("key") != "").select("run_id", "key", "name"))
    sizes = keyed.groupBy("run_id").agg(F.count(F.lit(1)).alias("keys")).filter(F.col("run_id").isNotNull())
    few = F.col("keys") <= RUN_KEYS
    if sizes.filter(few).limit(RUNS_FROM).count() < RUNS_FROM:
        return _paths_by_level(keyed, nodes, edges, max_paths)
    sizes = cut_lineage(sizes)
    small, large = sizes.filter(few).select("run_id"), sizes.filter(~few).select("run_id")
    within = lambda df, runs: df.join(runs, "run_id", "left_semi")
    whole = _paths_by_run(within(keyed, small), within(nodes, small), within(edges, small), max_paths)
    if large.isEmpty():
        return whole
    return whole.unionByName(_paths_by_level(cut_lineage(within(keyed, large)), within(nodes, large), within(edges, large), max_paths))


def _paths_by_run(keyed: DataFrame, nodes: DataFrame, edges: DataFrame, max_paths: int) -> DataFrame:
    """Runs dealt by hash, each walked whole in one task."""
    links = edges.filter("parent_key is not null").select("run_id", "parent_key", F.col("child_key").alias("key"), "ord").join(keyed, ["run_id", "key"])
    roots = nodes.filter(F.col("key") == "").select("run_id", F.lit(None).cast("string").alias("parent_key"), "key", "name", F.lit(None).cast("bigint").alias("ord")).distinct()
    rows = links.select("run_id", "parent_key", "key", "name", F.col("ord").cast("bigint").alias("ord")).unionByName(roots)
    return spread(rows, "run_id").sortWithinPartitions("run_id").mapInArrow(lambda batches: walk_runs(batches, max_paths), COLUMNS)


def _paths_by_level(keyed: DataFrame, nodes: DataFrame, edges: DataFrame, max_paths: int) -> DataFrame:
    """All runs together, one level after the other.

    Level-synchronous search until no node is left; a graph may have any depth. A path never holds a name twice. A key is
    visited on one level only, so of the names on a path only those matter that can be met again below its end: the path
    carries that set, and of the paths to a key only those stay that can still be among the first somewhere below. Where
    no name can be met again, which is the rule, that is a top-k window, which Spark trims per partition before the
    shuffle, so a node that a third of all packages depend on never gathers its parents in one task. The others are cut to
    ``max_paths`` a set first and then compared. To find paths without a repeated name is hard in general: only
    where several live names can be met on one way may a key keep more than ``max_paths`` paths a live name.

    Edges into visited keys are dropped once they are many, so no later level makes paths along them.
    """
    links = edges.select("run_id", "parent_key", F.col("child_key").alias("key"), "ord").join(keyed, ["run_id", "key"])
    repeated = cut_lineage(_repeated_names(keyed))
    blocks = not repeated.isEmpty()
    if blocks:
        live, several = _blocking_names(keyed, edges, repeated)
        blocks = not live.isEmpty()
    if blocks:
        wide = (
            live.select("run_id", "key", F.explode("live").alias("name")).join(several, ["run_id", "name"])
            .select("run_id", "key", F.lit(True).alias("several")).distinct()
        )
        links = links.join(live, ["run_id", "key"], "left").join(wide, ["run_id", "key"], "left").withColumns(
            {"live": F.coalesce("live", F.array().cast("array<string>")), "several": F.coalesce("several", F.lit(False))}
        )
    links = cut_lineage(links)
    roots = nodes.filter(F.col("key") == "").select("run_id", F.col("name").alias("root_name")).distinct()
    frontier = links.filter(F.col("parent_key") == "").select("run_id").distinct().join(
        roots, "run_id", "left"
    ).select(
        "run_id",
        F.lit("").alias("key"),
        F.array(F.coalesce(F.when(F.col("root_name") != "", F.col("root_name")), F.lit("(root)"))).alias("path"),
        F.array().cast("array<bigint>").alias("trail"),
        F.array().cast("array<string>").alias("held"),
    )
    levels, depth, left, entered = [], 0, links.count(), 0
    visited = None  # keys that links may still lead to
    alike = Window.partitionBy("run_id", "key", "held").orderBy("trail")
    first = Window.partitionBy("run_id", "key").orderBy("trail")
    columns = "run_id", "key", "path", "trail", "held", "place"
    while True:
        depth += 1
        step = frontier.drop("place").withColumnRenamed("key", "parent_key").join(links, ["run_id", "parent_key"])
        if blocks:
            step = step.filter(~F.array_contains("held", F.col("name"))).withColumn(
                "held", F.array_sort(F.array_intersect(F.concat("held", F.array("name")), F.col("live")))
            )
        step = step.withColumns({"path": F.concat("path", F.array("name")), "trail": F.concat("trail", F.array("ord"))}).drop("parent_key", "name", "ord")
        if visited is not None:
            step = step.join(visited, ["run_id", "key"], "left_anti")
        if blocks:
            among = step.withColumn("rank", F.row_number().over(alike)).filter(F.col("rank") <= max_paths).groupBy("run_id", "key").agg(
                F.array_sort(F.collect_list(F.struct("trail", "path", "held"))).alias("rows"), F.first("live").alias("live"), F.first("several").alias("several")
            )
            chosen = among.select("run_id", "key", F.posexplode(_enough(F.col("rows"), F.col("live"), F.col("several"), max_paths)).alias("at", "p"))
            step = chosen.select("run_id", "key", "p.path", "p.trail", "p.held", (F.col("at") + 1).alias("place"))
        else:
            step = step.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= max_paths)
        frontier = cut_lineage(step.select(*columns))
        size = frontier.count()
        if size == 0:
            break
        levels.append(frontier.filter(F.col("place") <= max_paths).select("run_id", "key", "path", "trail", "place", F.lit(depth).alias("depth")))
        keys = frontier.filter("place = 1").select("run_id", "key")
        visited, entered = keys if visited is None else visited.unionByName(keys), entered + size
        if entered >= max(PRUNE_FROM, left // 8):
            links = cut_lineage(links.join(visited, ["run_id", "key"], "left_anti"))
            visited, left, entered = None, links.count(), 0
        elif depth % MERGE_EVERY == 0:
            visited = cut_lineage(visited)
    if not levels:
        return frontier.select("run_id", "key", "path", "trail", "place", F.lit(0).alias("depth"))
    result = levels[0]
    for level in levels[1:]:
        result = result.unionByName(level)
    return result


def _reach(seeds: DataFrame, steps: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(run, tag, key) for every key that the seeds (run, tag, key) reach over the steps (run, key, next), themselves included.

    ``within`` names the (run, tag, key) that may be entered.

    The loop carries only new pairs and ends when a round adds none, which happens on any graph, cycles included.
    """
    frontier = cut_lineage(seeds.distinct())
    known, rounds = frontier, 0
    while not frontier.isEmpty():
        entered = frontier.join(steps, ["run_id", "key"]).select("run_id", "tag", F.col("next").alias("key")).distinct()
        if within is not None:
            entered = entered.join(within, ["run_id", "tag", "key"], "left_semi")
        frontier = cut_lineage(entered.join(known, ["run_id", "tag", "key"], "left_anti"))
        known, rounds = known.unionByName(frontier), rounds + 1
        if rounds % MERGE_EVERY == 0:
            known = cut_lineage(known)
    return known


def _labelled_steps(nodes: DataFrame, edges: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(run, key, next, name, inner) of the edges: the name of the lower end, and whether it has edges itself.

    With ``wanted`` (run, name), other names are null, and edges to ends that have neither such a name nor edges are left out.
    """
    inner = edges.select("run_id", F.col("parent_key").alias("key")).distinct().withColumn("inner", F.lit(True))
    named = nodes.select("run_id", "key", "name")
    if wanted is not None:
        named = named.join(wanted, ["run_id", "name"], "left_semi")
    ends = named.join(inner, ["run_id", "key"], "full").withColumnRenamed("key", "next").withColumn("inner", F.coalesce("inner", F.lit(False)))
    steps = edges.select("run_id", F.col("parent_key").alias("key"), F.col("child_key").alias("next"))
    return cut_lineage(steps.join(ends, ["run_id", "next"]).select("run_id", "key", "next", "name", "inner"))


def _names_below(nodes: DataFrame, steps: DataFrame, direct: DataFrame) -> DataFrame:
    """(run, direct, name) for the names of keys strictly below any key of a direct dependency's name.

    The walk goes over keys that have edges themselves. The others, most keys of a graph, are met once at the end, where
    only distinct names are kept.
    """
    seeds = nodes.select("run_id", "key", "name").join(direct.select("run_id", F.col("direct").alias("name")), ["run_id", "name"])
    walked = _reach(seeds.select("run_id", F.col("name").alias("tag"), "key"), steps.filter("inner").select("run_id", "key", "next"))
    met = walked.join(steps.filter("name is not null").select("run_id", "key", "name"), ["run_id", "key"])
    return met.select("run_id", F.col("tag").alias("direct"), "name").distinct()


def direct_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run, direct) names of the root's children."""
    children = edges.filter(F.col("parent_key") == "").select("run_id", F.col("child_key").alias("key"))
    return children.join(nodes.select("run_id", "key", "name"), ["run_id", "key"]).select("run_id", F.col("name").alias("direct")).distinct()


def subtree_closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(run, direct dependency, package name) for every package below any instance of a direct dependency's name.

    Reachability goes from key to key, so a path that enters a package by one instance does not leave it by another.
    """
    steps = _labelled_steps(nodes, edges)
    direct = cut_lineage(steps.filter((F.col("key") == "") & F.col("name").isNotNull()).select("run_id", F.col("name").alias("direct")).distinct())
    return direct.withColumn("name", F.col("direct")).unionByName(_names_below(nodes, steps, direct)).distinct()


def rollup_by_direct(nodes: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """Worst severity and number of findings in the subtree of each direct dependency.

    Walks down from the direct dependencies, over edges that lead on or end at a package that has findings. A walk up from
    every package that has findings would gather all of them at the few keys near the root.
    """
    per_package = cut_lineage(
        findings.groupBy("run_id", F.col("package").alias("name")).agg(
            F.min(severity_rank(F.col("severity"))).alias("rank"), F.count(F.lit(1)).alias("n")
        )
    )
    steps = _labelled_steps(nodes, edges, per_package.select("run_id", "name"))
    direct = cut_lineage(direct_names(nodes, edges))
    below = direct.withColumn("name", F.col("direct")).unionByName(_names_below(nodes, steps, direct)).distinct()
    graded = below.join(per_package, ["run_id", "name"]).groupBy("run_id", "direct").agg(F.min("rank").alias("rank"), F.sum("n").alias("count"))
    return direct.join(graded, ["run_id", "direct"], "left").select(
        "run_id", "direct", rank_label(F.col("rank")).alias("max_severity"), F.coalesce("count", F.lit(0)).alias("count")
    )
