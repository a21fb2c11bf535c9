"""The one comparison behind most detectors: facts present in the new snapshot and absent from the old.

Facts come as rows (PAIR columns, side, path, cap, key, line, snippet, context, kind, ord).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import text as X
from driftlens.functions import fixed_values as V
from driftlens.schema import PAIR, evidence_of, to_findings


def is_old() -> Column:
    return F.col("side") == "old"


def on_new(value: Column) -> Column:
    return F.when(F.col("side") == "new", value)


def relevant_facts(facts: DataFrame) -> DataFrame:
    """Facts the delta detectors read. Reading narrower kinds early keeps the shuffle small."""
    cap, key = F.col("cap"), F.col("key")
    keep = (
        cap.isin("net_module", "exec_module", "url", "encoded_url", "dynamic_code", "artifact")
        | (cap.isin("fs_write", "fs_read") & X.is_hot_path(key))
        | ((cap == "env") & X.is_sensitive_env(F.when(key != "*", F.split(key, ","))))
        | ((cap == "wasm_import") & X.is_suspicious_wasm_import(F.col("context"), F.col("kind")))
    )
    return facts.filter(keep)


def new_facts(facts: DataFrame) -> DataFrame:
    """New (cap, key) per pair with its evidence: the best-scoring sighting for URLs, else the first.

    One grouped aggregate instead of an anti-join plus a window. Every aggregate merges partially, so
    a package holding a third of all facts still combines on the map side.
    """
    score = F.when(
        F.col("cap") == "url", X.url_evidence_score(F.col("context"), F.col("path"), F.col("snippet"))
    ).otherwise(0)
    sighting = F.struct("path", "line", "snippet", "context", "kind")
    return (
        facts.groupBy(*PAIR, "cap", "key")
        .agg(
            F.bool_or(is_old()).alias("known"),
            F.max_by(sighting, on_new(F.struct(score, -F.col("ord")))).alias("seen"),
            F.count(on_new(F.lit(1))).alias("sightings"),
        )
        .filter(~F.col("known") & F.col("seen").isNotNull())
        .select(*PAIR, "cap", "key", "seen.*", "sightings")
    )


DELTA_RULES = {  # cap: (detector, category)
    "net_module": ("net.new-module", "NET"),
    "url": ("net.new-endpoint", "NET"),
    "encoded_url": ("net.encoded-endpoint", "NET"),
    "exec_module": ("exec.new-module", "EXEC"),
    "fs_write": ("fs.new-hotpath-write", "FS"),
    "fs_read": ("fs.new-hotpath-read", "FS"),
    "env": ("env.token-harvest", "ENV"),
    "dynamic_code": ("code.dynamic-loading-added", "CODE"),
    "artifact": ("bin.new-native-artifact", "INSTALL"),
    "wasm_import": ("wasm.suspicious-import", "CODE"),
}


def _by_cap(**values) -> Column:
    chain = None
    for cap, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(F.col("cap") == cap, value) if chain is None else chain.when(F.col("cap") == cap, value)
    return chain


def capability_findings(facts: DataFrame) -> DataFrame:
    """Ten detectors in one pass over the facts: endpoints, modules, paths, environment, code, binaries."""
    delta = new_facts(relevant_facts(facts))
    # Call sites are reported one by one even when several share a line.
    copies = F.when(F.col("cap") == "dynamic_code", F.col("sightings").cast("int")).otherwise(1)
    delta = delta.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    added = F.col("from_ver").isNull()
    soft = F.when(added, "low").otherwise("medium")
    key, kind = F.col("key"), F.col("kind")
    severity = _by_cap(
        net_module="WARN", exec_module="WARN", url=X.url_context_severity(F.col("context")),
        encoded_url="BLOCK", fs_write="BLOCK", fs_read="BLOCK", env="BLOCK", artifact="BLOCK", wasm_import="BLOCK",
        dynamic_code=X.code_kind_severity(kind),
    )
    confidence = _by_cap(
        net_module=soft, exec_module=soft, url=soft, encoded_url="high", fs_write="high", fs_read="high",
        env="high", artifact="high", wasm_import="high", dynamic_code=X.code_kind_confidence(kind),
    )
    label = F.when(key == "*", F.lit("the whole process environment")).otherwise(key)
    message = _by_cap(
        net_module=F.concat(F.lit("network module now in use: "), key),
        exec_module=F.concat(F.lit("process or code execution module now in use: "), key),
        url=F.concat(F.lit("network endpoint not seen before: "), key),
        encoded_url=F.concat(F.lit("endpoint hidden by "), kind, F.lit(" encoding: "), key),
        fs_write=F.concat(F.lit("now writes the sensitive path "), key),
        fs_read=F.concat(F.lit("now reads the sensitive path "), key),
        env=F.concat(F.lit("now reads sensitive environment: "), label),
        dynamic_code=F.concat(F.lit("dynamic code site added: "), kind),
        artifact=F.concat(F.lit("native binary added: "), F.col("path"), F.lit(" ("), kind, F.lit(")")),
        wasm_import=F.concat(F.lit("WebAssembly imports "), F.col("context"), F.lit("."), kind),
    )
    detector = _by_cap(**{cap: rule[0] for cap, rule in DELTA_RULES.items()})
    category = _by_cap(**{cap: rule[1] for cap, rule in DELTA_RULES.items()})
    return to_findings(
        delta, detector, category, severity, confidence, message,
        evidence_of(F.col("path"), F.col("line"), F.col("snippet")),
        code_kind=F.when(F.col("cap") == "dynamic_code", kind),
    )


def pairs_with_new_network_argument(facts: DataFrame) -> DataFrame:
    """Pairs whose new side holds an unseen URL not known to be mere text or configuration."""
    return (
        facts.filter(F.col("cap") == "url")
        .groupBy("run_id", "change_id", "key")
        .agg(
            F.bool_or(is_old()).alias("known"),
            F.bool_or(
                on_new(~F.coalesce(F.col("context"), F.lit("")).isin("literal", "comment", "config-value"))
            ).alias("active"),
        )
        .filter(~F.col("known") & F.coalesce("active", F.lit(False)))
        .select("run_id", "change_id")
        .distinct()
    )


def sensitive_env_expr() -> Column:
    return (F.col("cap") == "env") & X.is_sensitive_env(F.when(F.col("key") != "*", F.split("key", ",")))


def first_version_cluster(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Newly added packages that show at least four kinds of capability at once."""
    added_facts = facts.filter((F.col("side") == "new") & F.col("from_ver").isNull())
    added_files = files.filter((F.col("side") == "new") & F.col("from_ver").isNull())
    cap = F.col("cap")
    flagged = added_facts.select(
        *PAIR,
        F.when(cap == "net_module", "NET")
        .when(cap == "exec_module", "EXEC")
        .when(cap == "fs_module", "FS")
        .when(sensitive_env_expr(), "ENV")
        .when(cap == "dynamic_code", "CODE")
        .when(cap == "suspicious_literal", "OBF")
        .alias("flag"),
        F.lit(0).alias("file"),
    ).filter(F.col("flag").isNotNull())
    from_files = added_files.select(
        *PAIR, F.when(F.col("minified") | (F.col("suspicious") > 0), "OBF").alias("flag"), F.lit(1).alias("file")
    )
    flags = (
        flagged.unionByName(from_files)
        .groupBy(*PAIR)
        .agg(F.array_sort(F.collect_set("flag")).alias("flags"), F.sum("file").alias("file_count"))
        .filter(F.size("flags") >= 4)
    )
    listed = F.array_join("flags", ", ")
    return to_findings(
        flags, "deps.first-version-cluster", "DEPS", "BLOCK", "high",
        F.concat(F.lit("first version combines "), F.size("flags").cast("string"), F.lit(" capability kinds: "), listed),
        evidence_of(
            F.lit("package.json"), F.lit(1),
            F.concat(
                F.lit("first-version-with-cluster: "), listed, F.lit(" across "),
                F.col("file_count").cast("string"), F.lit(" file(s)"),
            ),
        ),
    )


def first_install_fallback(findings: DataFrame) -> DataFrame:
    """Added packages with outbound network plus bulk secret reads, when the cluster rule is silent."""
    per_pair = (
        findings.filter(F.col("from_ver").isNull())
        .groupBy(*PAIR)
        .agg(
            F.bool_or(F.col("detector") == "deps.first-version-cluster").alias("clustered"),
            F.bool_or(F.col("detector").isin("net.new-endpoint", "net.new-module")).alias("outbound"),
            F.count_if(F.col("detector") == "env.token-harvest").alias("env_reads"),
            F.bool_or(
                (F.col("detector") == "env.token-harvest")
                & F.col("message").contains("the whole process environment")
            ).alias("whole_env"),
        )
        .filter(~F.col("clustered") & F.col("outbound") & (F.col("whole_env") | (F.col("env_reads") >= 3)))
    )
    return to_findings(
        per_pair, "deps.first-version-cluster", "DEPS", "BLOCK", "high",
        F.lit("first version combines outbound network access with bulk reads of sensitive environment"),
        evidence_of(
            F.lit("package.json"), F.lit(1),
            F.concat(
                F.lit("first-version-with-cluster: NET + "), F.col("env_reads").cast("string"),
                F.lit(" sensitive env reads"),
            ),
        ),
    )


def image_decode_exec(files: DataFrame, facts: DataFrame) -> DataFrame:
    """A new or changed image that the package reads, next to a dynamic-code sink."""
    images = (
        files.filter(F.col("path").rlike(V.IMAGE_SUFFIX))
        .groupBy(*PAIR, "path")
        .agg(
            F.max_by(on_new(F.col("sha256")), on_new(F.col("ord"))).alias("sha_new"),
            F.max_by("sha256", F.when(is_old(), F.col("ord"))).alias("sha_old"),
        )
        .filter(F.col("sha_new").isNotNull() & ~F.col("sha_new").eqNullSafe(F.col("sha_old")))
        .select(*PAIR, F.col("path").alias("image"))
    )
    fresh = facts.filter(F.col("side") == "new")
    sinks = (
        fresh.filter((F.col("cap") == "dynamic_code") & F.col("kind").isin("eval", "new-function", "vm"))
        .groupBy("run_id", "change_id")
        .agg(F.min_by("path", "ord").alias("sink"))
    )
    reads = fresh.filter((F.col("cap") == "fs_read") & F.col("key").rlike(V.IMAGE_SUFFIX)).select(
        "run_id", "change_id", "key", "path", "ord"
    )
    by_target = reads.groupBy("run_id", "change_id", "key").agg(
        F.min_by("path", "ord").alias("reader"), F.min("ord").alias("ord")
    )
    exact = by_target.select("run_id", "change_id", F.col("key").alias("image"), F.col("reader").alias("exact"))
    by_name = (
        by_target.groupBy("run_id", "change_id", F.substring_index("key", "/", -1).alias("bare"))
        .agg(F.min_by("reader", "ord").alias("loose"))
    )
    hits = (
        images.join(sinks, ["run_id", "change_id"])
        .join(exact, ["run_id", "change_id", "image"], "left")
        .withColumn("bare", F.substring_index("image", "/", -1))
        .join(by_name, ["run_id", "change_id", "bare"], "left")
        .withColumn("reader", F.coalesce("exact", "loose"))
        .filter(F.col("reader").isNotNull())
    )
    return to_findings(
        hits, "obf.image-decode-exec", "OBF", "WARN", "medium",
        F.concat(
            F.lit("image "), F.col("image"), F.lit(" is read by "), F.col("reader"),
            F.lit(" while "), F.col("sink"), F.lit(" holds a dynamic-code sink"),
        ),
        evidence_of(
            F.col("reader"), F.lit(1),
            F.concat(F.lit("fsRead(\""), F.col("image"), F.lit("\") + dynamic-code sink in "), F.col("sink")),
        ),
    )


def dns_templated_hostname(facts: DataFrame) -> DataFrame:
    """A file that newly brings in DNS lookups together with a sign of built-up host names."""
    cap, snippet = F.col("cap"), F.coalesce(F.col("snippet"), F.lit(""))
    dns = (cap == "net_module") & F.col("key").isin(V.DNS_MODULES)
    known = (
        facts.filter(dns & is_old())
        .groupBy("run_id", "change_id")
        .agg(F.collect_set("key").alias("known"))  # at most four module names exist
    )
    calls_dns = snippet.rlike(V.DNS_CALLEE)
    # Order of preference when several signs are present.
    sign = (
        F.when((cap == "dynamic_code") & (F.col("kind") == "char-arithmetic-decoder"),
               F.struct(F.lit(1).alias("rank"), F.lit("a per-character decoder").alias("text")))
        .when(cap == "encoded_url",
              F.struct(F.lit(2).alias("rank"), F.concat(F.lit("an encoded host ("), F.col("kind"), F.lit(")")).alias("text")))
        .when((cap == "env") & calls_dns,
              F.struct(F.lit(3).alias("rank"), F.lit("an environment value passed to a DNS call").alias("text")))
        .when((cap == "dynamic_code") & calls_dns,
              F.struct(F.lit(4).alias("rank"), F.lit("a dynamic-code site at a DNS call").alias("text")))
    )
    per_file = (
        facts.filter((F.col("side") == "new") & (dns | cap.isin("dynamic_code", "encoded_url", "env")))
        .groupBy(*PAIR, "path")
        .agg(
            F.collect_set(F.when(dns, F.col("key"))).alias("modules"),
            F.min(F.when(sign.isNotNull(), F.struct(sign["rank"], F.col("ord"), sign["text"].alias("text")))).alias("sign"),
        )
        .filter((F.size("modules") > 0) & F.col("sign").isNotNull())
        .join(known, ["run_id", "change_id"], "left")
        .filter(
            F.col("from_ver").isNull()
            | (F.size(F.array_except("modules", F.coalesce("known", F.array().cast("array<string>")))) > 0)
        )
    )
    return to_findings(
        per_file, "net.dns-templated-hostname", "NET", "WARN",
        F.when(F.col("from_ver").isNull(), "low").otherwise("medium"),
        F.concat(F.lit("DNS module in "), F.col("path"), F.lit(" next to "), F.col("sign.text")),
        evidence_of(F.col("path"), F.lit(1), F.concat(F.lit("dns module + "), F.col("sign.text"))),
    )


def self_publish_shape(facts: DataFrame, scripts: DataFrame) -> DataFrame:
    """Install hook plus process execution plus a write to package.json: the shape of a publishing worm."""
    hook_rank = F.when(F.lit(False), 0)
    for rank, hook in enumerate(V.SELF_PUBLISH_HOOKS):
        hook_rank = hook_rank.when(F.col("hook") == hook, rank)
    hooks = (
        scripts.filter(F.col("hook").isin(V.SELF_PUBLISH_HOOKS) & (F.col("body") != ""))
        .groupBy(*PAIR)
        .agg(
            F.min_by("hook", on_new(hook_rank)).alias("hook_new"),
            F.min_by("hook", F.when(is_old(), hook_rank)).alias("hook_old"),
        )
    )
    cap, key = F.col("cap"), F.col("key")
    writes = (cap == "fs_write") & ((key == "package.json") | key.endswith("/package.json"))
    executes = cap == "exec_module"
    write = F.struct(F.col("path").alias("file"), key.alias("target"))

    def first(value, condition):
        return F.min_by(value, F.when(condition, F.col("ord")))

    shapes = (
        facts.filter(writes | executes)
        .groupBy("run_id", "change_id")
        .agg(
            first(F.col("path"), executes & ~is_old()).alias("exec_new"),
            first(F.col("path"), executes & is_old()).alias("exec_old"),
            first(write, writes & ~is_old()).alias("write_new"),
            first(write, writes & is_old()).alias("write_old"),
        )
        .filter(F.col("exec_new").isNotNull() & F.col("write_new").isNotNull())
    )
    unchanged = (
        F.col("hook_old").isNotNull() & F.col("exec_old").isNotNull() & F.col("write_old").isNotNull()
        & (F.col("hook_old") == F.col("hook_new")) & (F.col("write_old.target") == F.col("write_new.target"))
    )
    hits = hooks.join(shapes, ["run_id", "change_id"]).filter(F.col("hook_new").isNotNull() & ~unchanged)
    fresh_hook = F.col("hook_old").isNull()
    return to_findings(
        hits, "install.self-publish-shape", "INSTALL",
        F.when(fresh_hook, "BLOCK").otherwise("WARN"), F.when(fresh_hook, "high").otherwise("medium"),
        F.concat(
            F.lit("install hook "), F.col("hook_new"), F.lit(" with process execution in "), F.col("exec_new"),
            F.lit(" and a write to "), F.col("write_new.target"),
        ),
        evidence_of(
            F.col("write_new.file"), F.lit(1),
            F.concat(
                F.lit("hook="), F.col("hook_new"), F.lit(", exec-in="), F.col("exec_new"),
                F.lit(", writes="), F.col("write_new.target"),
            ),
        ),
    )
