"""What changed between two dependency inventories.

Input is the lock_nodes table with both sides of many runs; output is one row per change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.version import coerced

NAME = ["run_id", "name"]


def _on(side: str, value: Column) -> Column:
    return F.when(F.col("side") == side, value)


def package_versions(nodes: DataFrame) -> DataFrame:
    """One row per (run, name, version) with the last lock entry of each side.

    A single aggregate with map-side combine: a package repeated at millions of tree positions
    shrinks to one row per input partition before the shuffle.
    """
    entry = F.struct("version", "key", "integrity", "resolved")
    return (
        nodes.filter((F.col("key") != "") & (F.col("version") != ""))
        .groupBy(*NAME, "version")
        .agg(
            F.max_by(entry, _on("old", F.col("ord"))).alias("old"),
            F.max_by(entry, _on("new", F.col("ord"))).alias("new"),
            F.min(_on("old", F.col("ord"))).alias("old_first"),
        )
    )


def _name_flags(versions: DataFrame) -> DataFrame:
    """Per package name: which sides have it, and whether its arrivals compare by number or as text."""
    old, arriving = F.col("old").isNotNull(), F.col("new").isNotNull() & F.col("old").isNull()
    number = coerced(F.col("version")).isNotNull()
    return versions.groupBy(*NAME).agg(
        F.bool_or(old).alias("has_old"),
        F.bool_or(F.col("new").isNotNull()).alias("has_new"),
        F.bool_or(arriving).alias("has_arrival"),
        F.bool_or(arriving & ~number).alias("has_unnumbered_arrival"),
        F.bool_or(old & number).alias("numbered"),
    )


def nearest_prior(points: DataFrame) -> DataFrame:
    """As-of lookup: for each wanted position the closest old entry at or below, else the closest above.

    ``points`` has (run_id, name, mode, block, position, entry, rank); ``entry`` is NULL on wanted rows.
    Blocks keep position order, so the search runs inside a block first and then over block summaries.
    One very long version history spreads over its blocks instead of being sorted as one group.
    """
    group = [*NAME, "mode"]
    cells = points.groupBy(*group, "block", "position").agg(
        F.max_by("entry", "rank").alias("last"),
        F.min_by("entry", "rank").alias("first"),
        F.bool_or(F.col("entry").isNull()).alias("wanted"),
    )
    has_entry = F.when(F.col("last").isNotNull(), F.col("position"))
    summary = cells.groupBy(*group, "block").agg(
        F.max_by("last", has_entry).alias("last"), F.min_by("first", has_entry).alias("first")
    )
    across = Window.partitionBy(*group).orderBy("block")
    carry = summary.select(
        *group, "block",
        F.last("last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    inside = Window.partitionBy(*group, "block").orderBy("position")
    local = cells.withColumns(
        {
            "at_or_below": F.last("last", ignorenulls=True).over(
                inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
            "above": F.first("first", ignorenulls=True).over(
                inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
            ),
        }
    ).filter("wanted")
    return local.join(carry, [*group, "block"]).select(
        *group, "position", F.coalesce("at_or_below", "before", "above", "after").alias("prior")
    )


def _padded(number: Column) -> Column:
    return F.lpad(number.cast("string"), 16, "0")


def _places() -> Column:
    """Where a version stands in the two orders: by number (text padded to sort like it) and as text."""
    version, number = F.col("version"), coerced(F.col("version"))
    digits = F.concat(_padded(number["major"]), _padded(number["minor"]))
    by_number = F.struct(
        F.lit("number").alias("mode"), F.concat(digits, _padded(F.floor(number["patch"] / 1024))).alias("block"),
        F.concat(digits, _padded(number["patch"])).alias("position"),
    )
    as_text = F.struct(F.lit("text").alias("mode"), F.substring(version, 1, 4).alias("block"), version.alias("position"))
    arriving = F.col("old").isNull()
    numbered = F.col("numbered") & number.isNotNull()
    # Arrivals take one order; old entries take every order some arrival of their name asks for.
    needs_text = F.col("has_unnumbered_arrival") | ~F.col("numbered")
    return F.array_compact(
        F.array(F.when(numbered, by_number), F.when(F.when(arriving, ~numbered).otherwise(needs_text), as_text))
    )


def changeset(nodes: DataFrame) -> DataFrame:
    versions = package_versions(nodes)
    labelled = versions.join(_name_flags(versions), NAME)
    old, new = F.col("old"), F.col("new")
    both = old.isNotNull() & new.isNotNull()
    kind = (
        F.when(new.isNotNull() & ~F.col("has_old"), "added")
        .when(old.isNotNull() & ~F.col("has_new"), "removed")
        .when(new.isNotNull() & old.isNull(), "upgraded")
        .when(both & (old["integrity"] != new["integrity"]), "integrity-changed")
    )
    placed = labelled.filter(F.col("has_old") & F.col("has_arrival") & (old.isNotNull() | new.isNotNull()))
    points = placed.select(*NAME, F.explode(_places()).alias("p"), old.alias("entry"), F.col("old_first").alias("rank")).select(
        *NAME, "p.mode", "p.block", "p.position", "entry", "rank"
    )
    rows = labelled.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    upgraded = rows.filter("kind = 'upgraded'").withColumn("p", F.get(_places(), F.lit(0))).select(
        *rows.columns, "p.mode", "p.position"
    )
    upgraded = upgraded.join(nearest_prior(points), [*NAME, "mode", "position"]).withColumn("old", F.col("prior"))
    rows = rows.filter("kind != 'upgraded'").unionByName(upgraded.select(*rows.columns))
    return rows.select(
        "run_id",
        F.concat_ws(":", "kind", "name", F.coalesce("new.version", "old.version")).alias("change_id"),
        "kind",
        "name",
        F.col("old.key").alias("key_old"),
        F.col("new.key").alias("key_new"),
        F.col("old.version").alias("version_old"),
        F.col("new.version").alias("version_new"),
        F.col("old.integrity").alias("integrity_old"),
        F.col("new.integrity").alias("integrity_new"),
        F.col("new.resolved").alias("resolved_new"),
    )


def change_order() -> list[Column]:
    """Total order of changes inside a run: name, kind, then version by dictionary order."""
    return [
        F.col("run_id"), F.col("name"), F.col("kind"),
        F.collate(F.coalesce("version_new", F.lit("")), "UNICODE"),
    ]


def content_pairs(changes: DataFrame, known: DataFrame) -> DataFrame:
    """The (package, from_ver, to_ver) comparison behind each added or upgraded package.

    ``known`` lists the analysed (name, version). Same-version tampering is reported by itself and gets
    no content comparison; an old version that could not be analysed counts as absent.
    """
    content = changes.filter(F.col("kind").isin("added", "upgraded"))
    analysed = known.select("name", F.col("version").alias("version_old")).distinct().withColumn("known", F.lit(True))
    return content.join(analysed, ["name", "version_old"], "left").select(
        "run_id", "change_id", F.col("name").alias("package"),
        F.when(F.col("known"), F.col("version_old")).alias("from_ver"), F.col("version_new").alias("to_ver"),
    )


def pair_id() -> Column:
    """Name of a comparison, the same in every run."""
    return F.concat_ws("@", "package", F.concat_ws("..", F.coalesce("from_ver", F.lit("")), "to_ver"))


def distinct_pairs(content: DataFrame) -> DataFrame:
    """Each comparison once, however many runs contain it."""
    return content.select("package", "from_ver", "to_ver").distinct().select(
        F.lit("*").alias("run_id"), pair_id().alias("change_id"), "package", "from_ver", "to_ver"
    )


def attach(pairs: DataFrame, snapshot_rows: DataFrame, columns: list) -> DataFrame:
    """Rows of the old and the new snapshot of each pair, marked by side. ``snapshot_rows``: name, version, ...

    Pairs are turned into (package, version, side) first, so the large snapshot table takes part in one join.
    """
    side = F.array_compact(
        F.array(
            F.struct(F.lit("new").alias("side"), F.col("to_ver").alias("version")),
            F.when(F.col("from_ver").isNotNull(), F.struct(F.lit("old").alias("side"), F.col("from_ver").alias("version"))),
        )
    )
    wanted = pairs.select("run_id", "change_id", "package", "from_ver", "to_ver", F.explode(side).alias("s")).select(
        "run_id", "change_id", "package", "from_ver", "to_ver", "s.side", "s.version"
    )
    return wanted.join(snapshot_rows.withColumnRenamed("name", "package"), ["package", "version"]).select(
        "run_id", "change_id", "package", "from_ver", "to_ver", "side", *columns
    )
