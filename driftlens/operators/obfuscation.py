"""File-level signs of concealment, compared path by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import fixed_values as V
from driftlens.functions import text as X
from driftlens.operators.delta import is_old, on_new
from driftlens.schema import PAIR, evidence_of, to_findings


def file_pairs(files: DataFrame) -> DataFrame:
    """One row per path with the measures of both sides; a repeated path keeps its last entry."""
    measures = F.struct("entropy", "minified", "suspicious", "sha256")
    return files.groupBy(*PAIR, "path").agg(
        F.max_by(measures, on_new(F.col("ord"))).alias("new"),
        F.max_by(measures, F.when(is_old(), F.col("ord"))).alias("old"),
    )


def obfuscation_findings(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Entropy jumps, fresh minification and new opaque literals.

    ``entries`` lists (run_id, change_id, path) declared as entry points; a declared bundle inside a
    build folder is expected to be minified and only noted. The join runs on the few firing rows.
    """
    old, new = F.col("old"), F.col("new")
    in_build = F.col("path").rlike(V.BUILD_DIR)
    jump = (new["entropy"] - old["entropy"] > 1.5) & ~(in_build & (old["entropy"] >= 4.5))
    now_minified = ~old["minified"] & new["minified"]
    now_opaque = (old["suspicious"] == 0) & (new["suspicious"] > 0)
    count = new["suspicious"].cast("string")
    changed = F.array_compact(
        F.array(
            F.when(
                jump,
                F.concat(
                    F.lit("entropy "), F.format_string("%.2f", old["entropy"]), F.lit(" to "),
                    F.format_string("%.2f", new["entropy"]), F.lit(" bits per byte"),
                ),
            ),
            F.when(now_minified, F.lit("minified now, not before")),
            F.when(now_opaque, F.concat(count, F.lit(" opaque literal(s) appeared"))),
        )
    )
    shipped = F.array_compact(
        F.array(
            F.when(new["minified"], F.lit("shipped minified")),
            F.when(new["suspicious"] > 0, F.concat(count, F.lit(" opaque literal(s)"))),
        )
    )
    firing = (
        file_pairs(files)
        .filter(new.isNotNull())
        .withColumn("paired", old.isNotNull())
        .withColumn("reasons", F.when(F.col("paired"), changed).otherwise(shipped))
        .filter(F.size("reasons") > 0)
        .join(
            entries.select("run_id", "change_id", "path").distinct().withColumn("declared", F.lit(True)),
            ["run_id", "change_id", "path"],
            "left",
        )
        .withColumn("expected", F.coalesce("declared", F.lit(False)) & in_build)
    )
    why = F.array_join("reasons", "; ")
    added = F.col("from_ver").isNull()
    return to_findings(
        firing,
        F.when(F.col("paired"), "obf.entropy-jump").otherwise("obf.new-obfuscated-file"),
        "OBF",
        F.when(F.col("expected"), "INFO").otherwise("WARN"),
        F.when(F.col("expected") | added, "low").otherwise("medium"),
        F.concat(
            F.lit("concealment signs in "), F.col("path"),
            F.when(F.col("expected"), F.lit(" (declared build output): ")).otherwise(F.lit(": ")), why,
        ),
        evidence_of(F.col("path"), F.lit(1), why),
    )


def mangled_identifiers(facts: DataFrame) -> DataFrame:
    """Files that gained three or more machine-mangled identifiers."""
    ids = (
        facts.filter(
            F.col("cap").isin("dynamic_code", "env", "suspicious_literal") & F.col("path").rlike(V.JS_SOURCE)
        )
        .select(*PAIR, "side", "path", "ord", F.explode(X.mangled_ids(F.col("snippet"))).alias("id"))
        .groupBy(*PAIR, "path", "id")
        .agg(F.bool_or(is_old()).alias("known"), F.min(on_new(F.col("ord"))).alias("first"))
        .filter(F.col("first").isNotNull())
    )
    totals = ids.groupBy(*PAIR, "path").agg(
        F.count(F.lit(1)).alias("all_ids"), F.count_if(~F.col("known")).alias("new_ids")
    ).filter("all_ids >= 3 and new_ids >= 3")
    place = F.row_number().over(Window.partitionBy("run_id", "change_id", "path").orderBy("first", "id"))
    samples = (
        ids.filter(~F.col("known"))
        .withColumn("place", place)
        .filter("place <= 5")
        .groupBy("run_id", "change_id", "path")
        .agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("sample"))
    )
    hits = totals.join(samples, ["run_id", "change_id", "path"])
    listed = F.array_join(F.col("sample.id"), ", ")
    return to_findings(
        hits, "obf.js-mangler-signature", "OBF", "WARN",
        F.when(F.col("from_ver").isNull(), "medium").otherwise("high"),
        F.concat(
            F.col("path"), F.lit(" holds "), F.col("new_ids").cast("string"),
            F.lit(" mangled identifiers not seen before, such as "), listed,
        ),
        evidence_of(F.col("path"), F.lit(1), F.concat(F.lit("mangled identifiers: "), listed)),
    )


def confusable_boundaries(facts: DataFrame) -> DataFrame:
    """Files where look-alike letters newly touch ASCII letters."""
    rank = (
        F.when(F.col("cap") == "url", 1)
        .when(F.col("cap") == "suspicious_literal", 2)
        .when(F.col("cap") == "dynamic_code", 3)
        .when(F.col("cap") == "env", 4)
    )
    sample = F.when(F.col("cap") == "url", F.col("key")).otherwise(F.col("snippet"))
    hits = (
        facts.filter(rank.isNotNull() & F.col("path").rlike(V.JS_SOURCE) & X.has_confusable_boundary(sample))
        .groupBy(*PAIR, "path")
        .agg(
            F.bool_or(is_old()).alias("known"),
            F.min_by(sample, on_new(F.struct(rank, F.col("ord")))).alias("sample"),
        )
        .filter(~F.col("known"))
    )
    return to_findings(
        hits, "obf.unicode-homoglyph-boundary", "OBF", "WARN", "medium",
        F.concat(F.col("path"), F.lit(" mixes ASCII letters with look-alike letters")),
        evidence_of(F.col("path"), F.lit(1), F.concat(F.lit("homoglyph sample: "), F.col("sample"))),
    )


def unparseable_wasm(artifacts: DataFrame) -> DataFrame:
    """WebAssembly files that cannot be read now and could be (or were absent) before."""
    broken = (
        artifacts.filter((F.col("kind") == "wasm") & F.col("wasm_error").isNotNull())
        .groupBy(*PAIR, "path")
        .agg(F.bool_or(is_old()).alias("known"), F.min(on_new(F.col("wasm_error"))).alias("reason"))
        .filter(~F.col("known"))
    )
    return to_findings(
        broken, "wasm.unparseable", "OBF", "WARN", "medium",
        F.concat(F.col("path"), F.lit(" is not readable as WebAssembly: "), F.col("reason")),
        evidence_of(F.col("path"), F.lit(1), F.concat(F.lit("parse error: "), F.col("reason"))),
    )
