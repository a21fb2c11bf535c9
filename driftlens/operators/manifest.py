"""Detectors that read package manifests: hooks, dependencies, publishers, bundled packages.

Inputs are long tables with PAIR columns and a side:
scripts(hook, body), deps(bucket, name, spec, ord), emails(source, email), bundled(name),
bundled_scripts(name, hook, body).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.functions import fixed_values as V
from driftlens.functions import names as N
from driftlens.functions import text as X
from driftlens.operators.delta import is_old, on_new
from driftlens.schema import PAIR, evidence_of, to_findings


def lifecycle_scripts(scripts: DataFrame) -> DataFrame:
    """Hooks added or changed, graded by when they run."""
    hooks = (
        scripts.filter(X.hook_severity(F.col("hook")).isNotNull() & (F.col("body") != ""))
        .groupBy(*PAIR, "hook")
        .agg(F.max(on_new(F.col("body"))).alias("new"), F.max(F.when(is_old(), F.col("body"))).alias("old"))
        .filter(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old")))
    )
    fresh = F.col("old").isNull()
    return to_findings(
        hooks,
        F.when(fresh, "install.script-added").otherwise("install.script-changed"),
        "INSTALL",
        X.hook_severity(F.col("hook")),
        X.hook_confidence(F.col("hook")),
        F.concat(
            F.lit('Lifecycle script "'), F.col("hook"),
            F.when(fresh, F.lit('" was added')).otherwise(F.lit('" body changed')),
        ),
        evidence_of(
            F.lit("package.json"), F.lit(1), F.concat(F.col("hook"), F.lit(": "), F.substring("new", 1, 200))
        ),
    )


def new_direct_dependencies(deps: DataFrame) -> DataFrame:
    fresh = (
        deps.filter((F.col("bucket") == "dependencies") & F.col("from_ver").isNotNull())
        .groupBy(*PAIR, "name")
        .agg(F.bool_or(is_old()).alias("known"), F.max_by("spec", on_new(F.col("ord"))).alias("spec"))
        .filter(~F.col("known"))
    )
    return to_findings(
        fresh, "deps.new-direct-dep", "DEPS", "INFO", "medium",
        F.concat(F.lit("direct dependency added: "), F.col("name"), F.lit("@"), F.col("spec")),
        evidence_of(
            F.lit("package.json"), F.lit(1),
            F.concat(F.lit('"'), F.col("name"), F.lit('": "'), F.col("spec"), F.lit('"')),
        ),
    )


def url_dependencies(deps: DataFrame) -> DataFrame:
    """Dependencies newly declared as plain-http or non-registry URLs; later buckets override earlier."""
    bucket = (
        F.when(F.col("bucket") == "dependencies", 1)
        .when(F.col("bucket") == "optionalDependencies", 2)
        .when(F.col("bucket") == "peerDependencies", 3)
    )
    position = F.struct(bucket, F.col("ord"))
    specs = (
        deps.filter(bucket.isNotNull())
        .groupBy(*PAIR, "name")
        .agg(
            F.max_by("spec", on_new(position)).alias("new"),
            F.max_by("spec", F.when(is_old(), position)).alias("old"),
        )
        .filter(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old")))
        .withColumn("shape", X.dep_spec_class(F.col("new")))
        .filter(F.col("shape").isNotNull())
    )
    plain = F.col("shape") == "plain-http"
    return to_findings(
        specs, "manifest-deps.http-resolved-url", "DEPS",
        F.when(plain, "BLOCK").otherwise("WARN"), F.when(plain, "high").otherwise("medium"),
        F.concat(
            F.lit("dependency "), F.col("name"), F.lit(" uses a "), F.col("shape"), F.lit(" URL on host "),
            X.spec_host(F.col("new")),
        ),
        evidence_of(
            F.lit("package.json"), F.lit(1),
            F.concat(F.lit('"'), F.col("name"), F.lit('": "'), F.col("new"), F.lit('"')),
        ),
    )


def trust_table(spark: SparkSession, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """(package, anchor) rows: built-in publishers plus the caller's."""
    rows = [(p, a) for table in (V.TRUSTED_PUBLISHERS, extra or {}) for p, anchors in table.items() for a in anchors]
    return spark.createDataFrame(rows, "package string, anchor string")


def maintainer_changes(emails: DataFrame, trust: DataFrame) -> DataFrame:
    """Publisher set changes, graded by whether trusted publishers left or arrived.

    Addresses are reduced to one row each before trust is looked up, then to one row per package, so
    neither step holds a package's whole address list. Only the text shown as evidence is collected,
    and that is bounded by the snippet length.
    """
    per_email = (
        emails.filter(
            F.col("source").isin("maintainer", "publisher") & (F.col("email") != "") & F.col("from_ver").isNotNull()
        )
        .groupBy(*PAIR, "email")
        .agg(F.bool_or(is_old()).alias("was"), F.bool_or(~is_old()).alias("now"))
    )
    judged = (
        per_email.join(trust, "package", "left")
        .groupBy(*PAIR, "email", "was", "now")
        .agg(
            F.bool_or(F.col("anchor").isNotNull()).alias("listed"),
            F.coalesce(F.bool_or(N.anchor_trusts(F.col("email"), F.col("anchor"))), F.lit(False)).alias("trusted"),
        )
    )
    was, now, trusted = F.col("was"), F.col("now"), F.col("trusted")
    per_pair = judged.groupBy(*PAIR).agg(
        F.count_if(was).alias("n_old"),
        F.count_if(now).alias("n_new"),
        F.count_if(was & ~now).alias("n_gone"),
        F.count_if(now & ~was).alias("n_added"),
        F.count_if(now & ~was & ~trusted).alias("n_unknown"),
        F.count_if(was & ~trusted).alias("n_old_untrusted"),
        F.count_if(now & ~trusted).alias("n_new_untrusted"),
        F.count_if(now & trusted).alias("n_new_trusted"),
        F.bool_or("listed").alias("listed"),
    ).filter((F.col("n_gone") > 0) | (F.col("n_added") > 0))
    old_trusted = F.col("listed") & (F.col("n_old") > 0) & (F.col("n_old_untrusted") == 0)
    new_trusted = F.col("listed") & (F.col("n_new") > 0) & (F.col("n_new_untrusted") == 0)
    emptied, appeared = F.col("n_new") == 0, F.col("n_old") == 0
    verdict = (
        F.when(emptied & old_trusted, "BLOCK high trusted publishers replaced by an empty list")
        .when(emptied, "WARN medium maintainer list emptied")
        .when(appeared, "WARN medium maintainer list appeared")
        .when(~F.col("listed"), "WARN medium maintainer list changed")
        .when(old_trusted & (F.col("n_new_trusted") == 0), "BLOCK high trusted publishers replaced by unknown ones")
        .when(F.col("n_unknown") > 0, "WARN medium unknown maintainer added")
        .when(new_trusted & old_trusted, "INFO high rotation among trusted publishers")
        .when(new_trusted, "INFO medium moved to trusted publishers")
        .otherwise("WARN medium maintainer list changed")
    )
    shown = _address_lists(per_email)
    rows = per_pair.join(shown, ["run_id", "change_id"], "left").withColumn("verdict", verdict)
    return to_findings(
        rows, "meta.maintainer-change", "META",
        F.substring_index("verdict", " ", 1),
        F.substring_index(F.substring_index("verdict", " ", 2), " ", -1),
        F.regexp_replace("verdict", r"^\S+ \S+ ", ""),
        evidence_of(
            F.lit("package.json"), F.lit(1),
            F.concat(
                F.lit("maintainers: ["), F.coalesce("old_list", F.lit("")), F.lit("] → ["),
                F.coalesce("new_list", F.lit("")), F.lit("]"),
            ),
        ),
    )


def _address_lists(per_email: DataFrame, most: int = 120) -> DataFrame:
    """Sorted addresses of each side, as many as a 240-character snippet can show."""
    sides = per_email.select(
        "run_id", "change_id", "email",
        F.explode(F.array_compact(F.array(F.when(F.col("was"), "old"), F.when(F.col("now"), "new")))).alias("side"),
    )
    place = F.row_number().over(Window.partitionBy("run_id", "change_id", "side").orderBy("email"))
    return (
        sides.withColumn("place", place)
        .filter(F.col("place") <= most)
        .groupBy("run_id", "change_id")
        .agg(
            F.array_join(F.sort_array(F.collect_list(F.when(F.col("side") == "old", F.col("email")))), ", ").alias("old_list"),
            F.array_join(F.sort_array(F.collect_list(F.when(F.col("side") == "new", F.col("email")))), ", ").alias("new_list"),
        )
    )


def disposable_author_domains(emails: DataFrame, domains: DataFrame) -> DataFrame:
    """Addresses at throw-away mail providers, new to the package. ``domains`` has one column, domain."""
    mail = F.lower(F.col("email"))
    fresh = (
        emails.filter(F.col("email").contains("@"))
        .groupBy(*PAIR, mail.alias("email"))
        .agg(F.bool_or(is_old()).alias("known"))
        .filter(~F.col("known"))
        .withColumn("domain", N.mail_domain(F.col("email")))
        .join(domains.select(F.lower("domain").alias("domain")).distinct(), "domain", "left_semi")
    )
    # every address of a package is listed, as its manifest holds them in one document
    rows = fresh.groupBy(*PAIR).agg(F.array_join(F.sort_array(F.collect_list("email")), ", ").alias("listed"))
    added = F.col("from_ver").isNull()
    return to_findings(
        rows, "meta.disposable-author-domain", "META",
        F.when(added, "BLOCK").otherwise("WARN"), F.when(added, "high").otherwise("medium"),
        F.concat(F.lit("author address at a throw-away mail provider: "), F.col("listed")),
        evidence_of(
            F.lit("package.json"), F.lit(1), F.concat(F.lit("disposable-domain email(s): "), F.col("listed"))
        ),
    )


def bundled_dependencies(bundled: DataFrame) -> DataFrame:
    fresh = (
        bundled.filter(F.col("name") != "")
        .groupBy(*PAIR, "name")
        .agg(F.bool_or(is_old()).alias("known"))
        .filter(~F.col("known"))
    )
    # every name is listed, as the manifest of the package holds them in one document
    rows = fresh.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("hits"), F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("listed"))
    return to_findings(
        rows, "deps.bundled-dependency-added", "DEPS", "WARN", "high",
        F.concat(F.col("hits").cast("string"), F.lit(" package(s) newly shipped inside the archive: "), F.col("listed")),
        evidence_of(
            F.lit("package.json"), F.lit(1), F.concat(F.lit("bundledDependencies: ["), F.col("listed"), F.lit("]"))
        ),
    )


def bundled_lifecycle(bundled_scripts: DataFrame) -> DataFrame:
    """Hooks of bundled packages, reported whenever present: no comparison with the old side."""
    rows = bundled_scripts.filter((F.col("side") == "new") & F.col("hook").isin(V.BUNDLED_HOOKS))
    return to_findings(
        rows, "install.bundled-lifecycle", "INSTALL", "BLOCK", "high",
        F.concat(F.lit("bundled package "), F.col("name"), F.lit(" runs the hook "), F.col("hook")),
        evidence_of(
            F.concat(F.lit("node_modules/"), F.col("name"), F.lit("/package.json")), F.lit(1),
            F.concat(F.col("hook"), F.lit(": "), F.substring("body", 1, 200)),
        ),
    )
