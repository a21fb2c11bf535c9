"""The given tables read as dependency data, so that every operator runs over whole tables.

Each adapter is a projection of one table: which rows are the old or the new side, which package and
run they belong to, and what they say is a fixed function of their keys. Nothing is sampled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import text as X

NET = ["http", "https", "dns", "axios", "ws", "undici", "node:dns", "got", "net"]
EXEC = ["child_process", "vm", "worker_threads", "inspector", "node:vm", "subprocess", "os.system", "pty", "ctypes"]
ENV = ["NPM_TOKEN", "PATH", "GITHUB_TOKEN,HOME", "*", "LANG", "AWS_SECRET_ACCESS_KEY", "EDITOR", "USER", "NODE_ENV"]
CODE = ["eval", "new-function", "vm", "dynamic-require", "dynamic-import", "char-arithmetic-decoder"]
WRITES = [
    "/home/u/.ssh/config", "package.json", "dist/out.js", "/etc/hosts", "app/.npmrc", "sub/package.json",
    "logs/x.txt", "~/.bashrc", "tmp/y",
]
READS = [
    "img/a0.png", "/root/.aws/credentials", "keys/id_rsa", "data.json", "wallet.dat", "img/a3.jpg",
    "home/Documents/x", "/x/keystore", "readme.md",
]
WASM_MODULES = ["env", "wasi_snapshot_preview1", "math", "host"]
WASM_NAMES = ["exec", "fd_write", "add", "fetch as f", "memory"]
CONTEXTS = ["network-arg", "config-value", "literal", "comment"]
CAPS = [
    "net_module", "exec_module", "fs_module", "url", "encoded_url", "env", "dynamic_code", "fs_write",
    "fs_read", "suspicious_literal", "artifact", "wasm_import",
]
HOOKS = ["preinstall", "postinstall", "prepare", "prepublish", "test", "start", "lint", "install"]
DETECTORS = [
    ("net.new-endpoint", "NET"), ("net.new-module", "NET"), ("exec.new-module", "EXEC"),
    ("env.token-harvest", "ENV"), ("code.dynamic-loading-added", "CODE"), ("obf.entropy-jump", "OBF"),
    ("obf.new-obfuscated-file", "OBF"), ("install.script-added", "INSTALL"),
    ("deps.typosquat-candidate", "DEPS"), ("deps.new-direct-dep", "DEPS"), ("meta.maintainer-change", "META"),
    ("fs.new-hotpath-write", "FS"), ("integrity.hash-mismatch", "INTEG"), ("analysis.failed", "META"),
    ("config.in-diff-untrusted", "META"), ("bin.new-native-artifact", "INSTALL"),
]


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def text(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def lock_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """part as two inventories per brand."""
    k = F.col("p_partkey")
    integrity = F.when(k % 17 == 0, "").otherwise(text(k % 50))
    shifted = F.when((k % 13 == 0) & (k % 17 != 0), text(k % 50 + 1)).otherwise(integrity)
    sides = F.array_compact(
        F.array(
            F.when((k % 5 != 0) | (k % 35 == 0), F.struct(F.lit("old").alias("side"), integrity.alias("integrity"))),
            F.when((k % 7 != 0) | (k % 35 == 0), F.struct(F.lit("new").alias("side"), shifted.alias("integrity"))),
        )
    )
    name = F.concat_ws("-", "p_name", "p_brand")
    version = F.concat(F.lit("1."), text("p_size"), F.lit("."), text(k % 4))
    resolved = F.when(k % 11 == 0, F.concat(F.lit("git+ssh://host.example/"), text(k))).when(
        k % 11 == 1, F.concat(F.lit("file:///opt/"), text(k))
    )
    return load(spark, folder, "part").select(
        F.col("p_brand").alias("run_id"),
        F.explode(sides).alias("s"),
        F.concat(F.lit("node_modules/"), name, F.lit("#"), text(k)).alias("key"),
        name.alias("name"),
        version.alias("version"),
        resolved.alias("resolved"),
        k.alias("ord"),
    ).select("run_id", "s.side", "key", "name", "version", "s.integrity", "resolved", "ord")


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as capability facts of suppliers' packages."""
    o, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    idx = (o + (s % 2) * n) % 9
    cap = pick(CAPS, p % 12)
    path = F.concat(F.lit("lib/f"), text(o % 23), F.lit(".js"))
    added = s % 4 == 0
    word = F.substring(F.md5(text(p % 97)), 1, 4)
    snippet = (
        F.when(p % 24 == 5, F.lit("dns.lookup(process.env.A)"))
        .when((p % 48 == 9) | (p % 48 == 6), F.lit("pаypal"))
        .otherwise(F.concat(F.lit("read _0x"), word, F.lit(" end")))
    )
    module, name = pick(WASM_MODULES, o % 4), pick(WASM_NAMES, n % 5)
    kind = (
        F.when(cap == "dynamic_code", pick(CODE, o % 6))
        .when(cap == "encoded_url", pick(["base64", "hex"], n % 2))
        .when(cap == "artifact", F.lit("node"))
        .when(cap == "wasm_import", name)
    )
    binary = F.concat(F.lit("bin/n"), text(idx), F.lit(".node"))
    wasm = F.concat(F.lit("bin/w"), text(o % 3), F.lit(".wasm"))
    key = (
        F.when(cap == "net_module", pick(NET, idx))
        .when(cap == "exec_module", pick(EXEC, idx))
        .when(cap == "fs_module", F.lit("fs"))
        .when(cap == "url", F.concat(F.lit("https://h"), text(p % 40), F.lit(".example/p"), text(idx)))
        .when(cap == "encoded_url", F.concat(F.lit("https://x"), text(idx), F.lit(".invalid/c")))
        .when(cap == "env", pick(ENV, idx))
        .when(cap == "dynamic_code", F.concat_ws(":", path, text(n), kind))
        .when(cap == "fs_write", pick(WRITES, idx))
        .when(cap == "fs_read", pick(READS, idx))
        .when(cap == "artifact", F.concat(binary, F.lit("|"), F.md5(text(p % 5))))
        .when(cap == "wasm_import", F.concat_ws("|", wasm, module, name))
        .otherwise(F.lit(""))
    )
    context = F.when((cap == "url") & (o % 5 < 4), pick(CONTEXTS, o % 5 % 4)).when(cap == "wasm_import", module)
    return load(spark, folder, "lineitem").select(
        F.concat(F.lit("r"), text(s % 7)).alias("run_id"),
        F.concat(F.lit("s"), text(s)).alias("change_id"),
        F.concat(F.lit("pkg-"), text(s)).alias("package"),
        F.when(~added, "1.0.0").alias("from_ver"),
        F.lit("2.0.0").alias("to_ver"),
        F.when(~added & (o % 3 == 0), "old").otherwise("new").alias("side"),
        F.when(cap == "artifact", binary).when(cap == "wasm_import", wasm).otherwise(path).alias("path"),
        cap.alias("cap"),
        key.alias("key"),
        n.cast("int").alias("line"),
        F.when(cap == "url", key).otherwise(snippet).alias("snippet"),
        context.alias("context"),
        kind.alias("kind"),
        ((o * 8 + n) * 1000000 + p).alias("ord"),
    )


def _files_base(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    unit = F.floor(d / 40)
    old = F.floor(d / 20) % 2 == 0
    added = F.col("source").isin("src0", "src5", "src10", "src15")
    # files that have no place in the two layouts stand beside them as new ones
    placed = F.when(old, (unit % 5 != 1) & ~added).otherwise(unit % 3 != 2)
    return (
        load(spark, folder, "documents")
        .select(
            F.lit("docs").alias("run_id"),
            F.col("source").alias("change_id"),
            F.col("source").alias("package"),
            F.when(~added, "1").alias("from_ver"),
            F.lit("2").alias("to_ver"),
            F.when(old & placed, "old").otherwise("new").alias("side"),
            F.when(placed, F.concat(F.when(unit % 4 == 0, "dist/f").otherwise("src/f"), text(unit), F.lit(".js")))
            .otherwise(F.concat(F.lit("extra/f"), text(d), F.lit(".js"))).alias("path"),
            "text",
            d.alias("ord"),
        )
    )


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """documents as the files of two versions per source, with whole texts."""
    return _files_base(spark, folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The measures of those files."""
    body = F.col("text")
    return _files_base(spark, folder).select(
        "run_id", "change_id", "package", "from_ver", "to_ver", "side", "path",
        F.octet_length(body).cast("long").alias("bytes"),
        F.sha2(body, 256).alias("sha256"),
        F.lit(None).cast("string").alias("parse_error"),
        X.byte_entropy(body).alias("entropy"),
        X.minified(body).alias("minified"),
        F.size(F.regexp_extract_all(body, F.lit(r"([0-9a-f]{40})"), F.lit(1))).alias("suspicious"),
        "ord",
    )


def declared_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The bundles that packages declare: those of English documents."""
    unit = F.floor(F.col("doc_id") / 40)
    return (
        load(spark, folder, "documents")
        .filter(F.col("lang") == "en")
        .select(
            F.lit("docs").alias("run_id"), F.col("source").alias("change_id"),
            F.concat(F.lit("dist/f"), text(unit), F.lit(".js")).alias("path"),
        )
        .distinct()
    )


def images(spark: SparkSession, folder: str) -> DataFrame:
    """part as image files of the suppliers' packages that ``facts`` describes."""
    k = F.col("p_partkey")
    supplier = k % 50
    added = supplier % 4 == 0
    old = ~added & (k % 3 == 0)
    return load(spark, folder, "part").select(
        F.concat(F.lit("r"), text(supplier % 7)).alias("run_id"),
        F.concat(F.lit("s"), text(supplier)).alias("change_id"),
        F.concat(F.lit("pkg-"), text(supplier)).alias("package"),
        F.when(~added, "1.0.0").alias("from_ver"),
        F.lit("2.0.0").alias("to_ver"),
        F.when(old, "old").otherwise("new").alias("side"),
        F.concat(pick(["img/a", "assets/a", "a"], F.col("p_size") % 3), text(k % 7), pick([".png", ".jpg", ".txt"], k % 3)).alias("path"),
        F.md5(text(k % 3)).alias("sha256"),
        k.alias("ord"),
    )


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """events as findings of many small packages."""
    e, u = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("long")
    idx = (e * 7 + k) % 16
    detector, category = pick([d for d, _ in DETECTORS], idx), pick([c for _, c in DETECTORS], idx)
    unit = F.concat(text(u), F.lit("-"), text(e % 29))
    added = F.col("event_type") == "signup"
    snippet = (
        F.when(category == "NET", F.concat(F.lit("call https://h"), text(k), F.lit(".example/x now")))
        .when(category == "ENV", F.concat(F.lit("process.env."), pick(["NPM_TOKEN", "HOME", "GH_TOKEN"], k % 3)))
        .when(category == "META", F.concat(F.lit("maintainers: [a@x.example] → [b"), text(k), F.lit("@y.example]")))
        .otherwise(F.concat(F.lit("s"), text(k)))
    )
    message = F.when(
        category == "INSTALL",
        F.concat(F.lit('Lifecycle script "'), pick(["postinstall", "test"], k % 2), F.lit('" was added')),
    ).otherwise(F.concat(F.lit("m"), text(k)))
    return load(spark, folder, "events").select(
        F.concat(F.lit("r"), text(u % 5)).alias("run_id"),
        F.concat(F.lit("c"), unit).alias("change_id"),
        detector.alias("detector"),
        category.alias("category"),
        F.concat(F.lit("u"), unit).alias("package"),
        F.when(~added, F.concat(F.lit("1.0."), text(k % 7))).alias("from_ver"),
        F.concat(F.lit("1."), text(k % 5), F.lit("."), text(k % 9)).alias("to_ver"),
        F.when(added, "added").when(F.col("event_type") == "purchase", "absolute").otherwise("changed").alias("direction"),
        F.when(k % 10 < 1, "BLOCK").when(k % 10 < 7, "WARN").otherwise("INFO").alias("severity"),
        pick(["high", "medium", "low"], k % 3).alias("confidence"),
        message.alias("message"),
        F.array(
            F.struct(
                F.concat(F.lit("lib/f"), text(e % 13), F.lit(".js")).alias("file"),
                (k + 1).cast("int").alias("line"), snippet.alias("snippet"),
            )
        ).alias("evidence"),
        F.when(category == "CODE", pick(["eval", "new-function", "vm", "dynamic-import"], k % 4)).alias("code_kind"),
        e.alias("event_id"),
    )


def network_pairs(spark: SparkSession, folder: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return (
        load(spark, folder, "events")
        .filter(F.col("event_type") == "click")
        .select(
            F.concat(F.lit("r"), text(u % 5)).alias("run_id"),
            F.concat(F.lit("c"), text(u), F.lit("-"), text(e % 29)).alias("change_id"),
        )
        .distinct()
    )


def emails(spark: SparkSession, folder: str) -> DataFrame:
    """customer as the publishers of one package per nation and balance band."""
    c = F.col("c_custkey")
    band = F.floor(F.abs("c_acctbal")).cast("long") % 20
    package = F.concat(F.lit("n"), text("c_nationkey"), F.lit("-"), text(band))
    added = F.col("c_nationkey") % 6 == 0
    mail = F.concat(
        F.lit("u"), text(c % 11), F.lit("@"), F.lower("c_mktsegment"),
        F.when(c % 4 == 0, F.lit(".sub.example")).otherwise(F.lit(".example")),
    )
    return load(spark, folder, "customer").select(
        F.lit("r").alias("run_id"),
        package.alias("change_id"),
        package.alias("package"),
        F.when(~added, "1.0.0").alias("from_ver"),
        F.lit("1.1.0").alias("to_ver"),
        F.when(~added & (c % 2 == 0), "old").otherwise("new").alias("side"),
        F.when(c % 5 == 0, "publisher").otherwise("maintainer").alias("source"),
        mail.alias("email"),
    )


def trust(spark: SparkSession, folder: str) -> DataFrame:
    """supplier as trust anchors for the packages of ``emails``."""
    s = F.col("s_suppkey")
    package = F.concat(F.lit("n"), text("s_nationkey"), F.lit("-"), text(s % 20))
    anchors = ["@building.example", "u3", "@machinery.example", "u1@household.example", "@automobile.example", "@furniture.example", "u7"]
    return load(spark, folder, "supplier").select(package.alias("package"), pick(anchors, s % 7).alias("anchor")).distinct()


def deps(spark: SparkSession, folder: str) -> DataFrame:
    """orders as dependency declarations of customers' packages."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    added = c % 5 == 0
    host = F.when(o % 3 == 0, "registry.npmjs.org").when(o % 3 == 1, "cdn.example:8443").otherwise("files.example")
    spec = (
        F.when(o % 7 == 0, F.concat(F.lit("http://mirror"), text(o % 4), F.lit(".example/a.tgz")))
        .when(o % 7 == 1, F.concat(F.lit("https://"), host, F.lit("/a-"), text(o % 4), F.lit(".tgz")))
        .otherwise(F.concat(F.lit("^1."), text(o % 9), F.lit(".0")))
    )
    return load(spark, folder, "orders").select(
        F.lit("r").alias("run_id"),
        F.concat(F.lit("c"), text(c)).alias("change_id"),
        F.concat(F.lit("cust-"), text(c)).alias("package"),
        F.when(~added, "1.0.0").alias("from_ver"),
        F.lit("1.1.0").alias("to_ver"),
        F.when(~added & (F.month("o_orderdate") % 2 == 0), "old").otherwise("new").alias("side"),
        pick(["dependencies", "optionalDependencies", "peerDependencies", "devDependencies"], o % 4).alias("bucket"),
        F.concat(F.lit("dep-"), text(o % 12)).alias("name"),
        spec.alias("spec"),
        o.alias("ord"),
    )


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    """orders as lifecycle hooks of the suppliers' packages that ``facts`` describes."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    supplier = c % 60
    added = supplier % 4 == 0
    return load(spark, folder, "orders").select(
        F.concat(F.lit("r"), text(supplier % 7)).alias("run_id"),
        F.concat(F.lit("s"), text(supplier)).alias("change_id"),
        F.concat(F.lit("pkg-"), text(supplier)).alias("package"),
        F.when(~added, "1.0.0").alias("from_ver"),
        F.lit("2.0.0").alias("to_ver"),
        F.when(~added & (F.month("o_orderdate") % 2 == 0), "old").otherwise("new").alias("side"),
        pick(HOOKS, (o + c) % 8).alias("hook"),
        F.concat(F.lit("node "), F.lower(F.col("o_orderstatus")), text(F.year("o_orderdate")), F.lit(".js")).alias("body"),
    )


def bundled(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as bundled packages and their hooks."""
    o, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    package = F.concat(F.lit("b"), text(s), F.lit("-"), text(p % 10))
    added = p % 10 == 0
    return load(spark, folder, "lineitem").select(
        F.lit("r").alias("run_id"), package.alias("change_id"), package.alias("package"),
        F.when(~added, "1.0.0").alias("from_ver"), F.lit("1.1.0").alias("to_ver"),
        F.when(~added & (o % 2 == 0), "old").otherwise("new").alias("side"),
        F.concat(F.lit("inner"), text((o + n) % 40)).alias("name"),
        pick(HOOKS, o % 8).alias("hook"),
        F.concat(F.lit("node x"), text(n), F.lit(".js")).alias("body"),
    )


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """part as WebAssembly files, some unreadable."""
    k = F.col("p_partkey")
    package = F.concat(F.lit("w-"), F.col("p_brand"))
    return load(spark, folder, "part").select(
        F.lit("r").alias("run_id"), package.alias("change_id"), package.alias("package"),
        F.lit("1").alias("from_ver"), F.lit("2").alias("to_ver"),
        F.when(k % 3 == 0, "old").otherwise("new").alias("side"),
        F.concat(F.lit("w"), text("p_size"), F.lit(".wasm")).alias("path"),
        F.when(k % 2 == 0, "wasm").otherwise("node").alias("kind"),
        F.when(k % 5 < 2, F.concat(F.lit("bad section "), text(k % 3))).alias("wasm_error"),
    )


def names(spark: SparkSession, folder: str) -> DataFrame:
    """part names, each with one letter dropped, as newly added packages."""
    k = F.col("p_partkey")
    base = F.concat(F.regexp_replace(F.lower("p_name"), " ", "-"), F.lit("-"), F.lower("p_type"))
    cut = (k % F.length(base)).cast("int")
    return load(spark, folder, "part").select(
        F.lit("r").alias("run_id"), F.concat(F.lit("p"), text(k)).alias("change_id"),
        F.concat(F.substring(base, F.lit(1), cut), F.substring(base, cut + 2, F.length(base))).alias("package"),
        F.lit(None).cast("string").alias("from_ver"), F.lit("1.0.0").alias("to_ver"),
    )


def token_names(spark: SparkSession, folder: str) -> DataFrame:
    """part names with words reordered, added or dropped, as newly added packages."""
    k = F.col("p_partkey")
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    kind = F.lower("p_type")
    name = (
        F.when(k % 4 == 0, F.concat_ws("-", kind, second, first))
        .when(k % 4 == 1, F.concat_ws("-", first, second, kind, F.lit("kit")))
        .when(k % 4 == 2, F.concat_ws("-", first, second))
        .otherwise(F.concat_ws("-", second, F.lit("plus"), first))
    )
    return load(spark, folder, "part").select(
        F.lit("r").alias("run_id"), F.concat(F.lit("p"), text(k)).alias("change_id"), F.lower(name).alias("package"),
        F.lit(None).cast("string").alias("from_ver"), F.lit("1.0.0").alias("to_ver"),
    )


def popular(spark: SparkSession, folder: str) -> DataFrame:
    """Whole part names as the popular list, in key order."""
    base = F.concat(F.regexp_replace(F.lower("p_name"), " ", "-"), F.lit("-"), F.lower("p_type"))
    return load(spark, folder, "part").groupBy(base.alias("name")).agg(F.min("p_partkey").alias("ord"))


def graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Root, regions, nations, customers and suppliers, orders, parts as one dependency graph.

    Parts hang below the orders and suppliers that list them, so the graph is a DAG with many paths.
    """
    region, nation = load(spark, folder, "region"), load(spark, folder, "nation")
    customer, supplier = load(spark, folder, "customer"), load(spark, folder, "supplier")
    orders, item = load(spark, folder, "orders"), load(spark, folder, "lineitem")

    def key(prefix, column):
        return F.concat(F.lit(prefix), text(column))

    def link(df, parent, child, ord_column):
        return df.select(parent.alias("parent_key"), child.alias("child_key"), F.col(ord_column).cast("long").alias("ord"))

    supplies = item.select("l_suppkey", "l_partkey").distinct()
    contains = item.select("l_orderkey", "l_partkey").distinct()
    edges = (
        link(region, F.lit(""), key("r", "r_regionkey"), "r_regionkey")
        .unionByName(link(nation, key("r", "n_regionkey"), key("n", "n_nationkey"), "n_nationkey"))
        .unionByName(link(customer, key("n", "c_nationkey"), key("c", "c_custkey"), "c_custkey"))
        .unionByName(link(supplier, key("n", "s_nationkey"), key("s", "s_suppkey"), "s_suppkey"))
        .unionByName(link(orders, key("c", "o_custkey"), key("o", "o_orderkey"), "o_orderkey"))
        .unionByName(link(supplies, key("s", "l_suppkey"), key("p", "l_partkey"), "l_partkey"))
        .unionByName(link(contains, key("o", "l_orderkey"), key("p", "l_partkey"), "l_partkey"))
        .withColumn("run_id", F.lit("g"))
    )
    part = load(spark, folder, "part")
    sources = [
        (region, "r", "r_regionkey"), (nation, "n", "n_nationkey"), (customer, "c", "c_custkey"), (supplier, "s", "s_suppkey"),
        (orders, "o", "o_orderkey"), (part, "p", "p_partkey"),
    ]
    keys = region.select(F.lit("").alias("key")).distinct()  # the root
    for table, prefix, column in sources:
        keys = keys.unionByName(table.select(key(prefix, column).alias("key")))
    return keys.select(F.lit("g").alias("run_id"), "key", F.col("key").alias("name")), edges


def diamonds(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """part as graphs of twenty layers of two packages; all packages of a layer need all of the next.

    Below the last layer stands one package that needs a second instance of every package above it, so every name can
    block, and the ways to an instance are those around its own name.
    """
    k = F.col("p_partkey")
    run, place = F.floor(k / 40), k % 40
    part = load(spark, folder, "part").select(
        text(run).alias("run_id"), (run * 40).alias("base"), F.floor(place / 2).alias("layer"), (place % 2).alias("ord"),
        F.concat(F.lit("p"), text("p_partkey")).alias("name"), F.concat(F.lit("x"), text(run)).alias("end"),
    )
    runs = part.select("run_id", "end").distinct()
    lower = F.concat_ws("/", "end", "name")
    nodes = (
        part.select("run_id", F.col("name").alias("key"), "name")
        .unionByName(part.select("run_id", lower.alias("key"), "name"))
        .unionByName(runs.select("run_id", F.col("end").alias("key"), F.col("end").alias("name")))
        .unionByName(runs.select("run_id", F.lit("").alias("key"), F.lit("app").alias("name")))
    )
    following = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda c: F.struct(F.concat(F.lit("p"), text(F.col("base") + (F.col("layer") + 1) * 2 + c)).alias("child_key"), c.cast("long").alias("ord")))
    edges = (
        part.filter("layer < 19").select("run_id", F.col("name").alias("parent_key"), F.explode(following).alias("c"))
        .select("run_id", "parent_key", "c.child_key", "c.ord")
        .unionByName(part.filter("layer = 0").select("run_id", F.lit("").alias("parent_key"), F.col("name").alias("child_key"), "ord"))
        .unionByName(part.filter("layer = 19").select("run_id", F.col("name").alias("parent_key"), F.col("end").alias("child_key"), F.lit(0).cast("long").alias("ord")))
        .unionByName(part.select("run_id", F.col("end").alias("parent_key"), lower.alias("child_key"), (F.col("layer") * 2 + F.col("ord")).alias("ord")))
    )
    return nodes, edges


def instances(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Root, customers, orders and lines of orders; each level's names repeat, so a name has many instances."""
    customer, orders, item = (load(spark, folder, t) for t in ("customer", "orders", "lineitem"))
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    line = F.concat(F.lit("l"), text("l_orderkey"), F.lit("-"), text("l_linenumber"))
    named = lambda table, key, name: table.select(F.lit("i").alias("run_id"), key.alias("key"), name.alias("name"))
    nodes = named(spark.range(1), F.lit(""), F.lit("app"))
    nodes = nodes.unionByName(named(customer, F.concat(F.lit("c"), text(c)), F.concat(F.lit("top"), text(c % 23))))
    nodes = nodes.unionByName(named(orders, F.concat(F.lit("o"), text(o)), F.concat(F.lit("order"), text(o % 61))))
    nodes = nodes.unionByName(named(item, line, F.concat(F.lit("part"), text(F.col("l_partkey") % 97))))
    linked = lambda table, parent, child, place: table.select(F.lit("i").alias("run_id"), parent.alias("parent_key"), child.alias("child_key"), place.cast("long").alias("ord"))
    edges = linked(customer, F.lit(""), F.concat(F.lit("c"), text(c)), c)
    edges = edges.unionByName(linked(orders, F.concat(F.lit("c"), text("o_custkey")), F.concat(F.lit("o"), text(o)), o))
    return nodes, edges.unionByName(linked(item, F.concat(F.lit("o"), text("l_orderkey")), line, F.col("l_linenumber")))


def _template(pattern: str, **values: Column) -> Column:
    """Text with ``{name}`` holes filled from columns."""
    parts = []
    for index, piece in enumerate(re.split(r"\{(\w+)\}", pattern)):
        if index % 2:
            parts.append(values[piece])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


LOCK_FILE_NAMES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "yarn.lock", "requirements.txt", "poetry.lock", "uv.lock"]
LOCK_TEMPLATES = [
    '{"name":"app","lockfileVersion":3,"packages":{"":{"name":"app","version":"1.0.0","dependencies":{"A-{a}":"1"}},'
    '"node_modules/A-{a}":{"version":"1.{b}.0","integrity":"sha512-x{b}","dependencies":{"b-{a}":"1"}},'
    '"node_modules/b-{a}":{"version":"2.0.{b}"},"node_modules/w-{a}":{"link":true}}}',
    "lockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n      a-{a}: 1.{b}.0\npackages:\n  A-{a}@1.{b}.0:\n"
    "    resolution: {integrity: sha512-x{b}}\n    dependencies:\n      b-{a}: 2.0.{b}\n  b-{a}@2.0.{b}:\n    resolution: {integrity: ''}\n",
    '# yarn lockfile v1\n\n\nA-{a}@^1.0.0:\n  version "1.{b}.0"\n  integrity sha512-xxxx{b}\n  dependencies:\n    b-{a} "^2.0.0"\n\n'
    'b-{a}@^2.0.0:\n  version "2.0.{b}"\n',
    '__metadata:\n  version: 6\n\n"A-{a}@npm:^1.0.0":\n  version: 1.{b}.0\n  checksum: sha512-xxxx{b}\n  dependencies:\n    b-{a}: ^2.0.0\n\n'
    '"b-{a}@npm:^2.0.0":\n  version: 2.0.{b}\n',
    "# pins\nA-{a}==1.{b}.0 --hash=sha256:ab{b}\nb_{a}==2.0.{b} ; python_version > '3'\n-r more.txt\n",
    '[[package]]\nname = "A-{a}"\nversion = "1.{b}.0"\nfiles = [{file = "x.whl", hash = "sha256:ab{b}"}]\n\n[package.dependencies]\nb_{a} = ">=2"\n\n'
    '[[package]]\nname = "b_{a}"\nversion = "2.0.{b}"\n\n[metadata]\nlock-version = "2.0"\n',
    'version = 1\n\n[[package]]\nname = "A-{a}"\nversion = "1.{b}.0"\ndependencies = [{ name = "b-{a}" }]\nwheels = [{ hash = "sha256:ab{b}" }]\n\n'
    '[[package]]\nname = "b-{a}"\nversion = "2.0.{b}"\n',
]


def lock_files(spark: SparkSession, folder: str) -> DataFrame:
    """customer as one small lockfile per row, cycling through the seven layouts."""
    c = F.col("c_custkey")
    holes = {"a": text(c), "b": text(c % 9)}
    body = F.when(F.lit(False), "")
    for index, template in enumerate(LOCK_TEMPLATES):
        body = body.when(c % 7 == index, _template(template, **holes))
    # every tenth file has no name and is recognised by its content, but for requirements of one kind
    return load(spark, folder, "customer").select(
        F.concat(F.lit("f"), text(c)).alias("run_id"), F.lit("new").alias("side"),
        F.when(c % 10 != 3, pick(LOCK_FILE_NAMES, c % 7)).alias("filename"), body.alias("text"),
    )


JS_TEMPLATE = (
    'const m = require("{mod}");\n// see https://note{k}.example/q\nfetch("https://h{k}.example/p");\nconst t = process.env.{env};\n'
    'fs.writeFileSync("/etc/f{k}", t);\nconst s = "require(\'vm\') eval(1)";\nlet u = "https://j" + "oined{k}.example/z";\neval(m);\n'
)
PY_TEMPLATE = (
    'import {mod}\nimport os\n"""import socket"""\na = os.environ["{env}"]\nopen("/etc/f{k}", "w")\nb = "https://h{k}.example/p"  # https://note{k}.example/q\n'
    "exec(a)\nsubprocess.run([b])\n"
)
JS_MODULES = ["https", "child_process", "left-pad", "node:dns", "fs"]
PY_MODULES = ["socket", "subprocess", "json", "urllib.request", "shutil"]
ENV_NAMES = ["NPM_TOKEN", "HOME", "GH_TOKEN"]


def source_files(spark: SparkSession, folder: str, template: str, modules: list[str], suffix: str) -> DataFrame:
    """orders as one small source file per row."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    body = _template(template, mod=pick(modules, o % 5), env=pick(ENV_NAMES, c % 3), k=text(o))
    return load(spark, folder, "orders").select(
        F.concat(F.lit("p"), text(c)).alias("name"), F.lit("1.0.0").alias("version"),
        F.concat(F.lit("src/f"), text(o), F.lit(suffix)).alias("path"), body.alias("text"), o.alias("ord"),
    )


def scripts_of_texts(spark: SparkSession, folder: str) -> DataFrame:
    """documents and pages, whole, as one script per row."""
    file = lambda table, key, body: load(spark, folder, table).select(
        F.lit(table).alias("name"), F.lit("1").alias("version"), F.concat(F.lit("f"), text(key), F.lit(".js")).alias("path"),
        F.col(body).alias("text"), F.col(key).alias("ord"),
    )
    return file("documents", "doc_id", "text").unionByName(file("pages", "page_id", "html"))


FLOW_PARTS = [
    "function f{k}(a) { return a }\nconst n{k} = process;\n", "const { env: m{k} } = n{k};\n", "const pass{k} = (x{k}) => x{k}.{KEY};\npass{k}(m{k});\n",
    "const { L{k}: q{k} } = m{k};\n", "const io{k} = require('fs');\nconst { promises: io2{k} } = io{k};\n", "function put{k}(t{k}) { t{k}.writeFile('/d/{k}', 1) }\nput{k}(io2{k});\n",
]


def flow_files(spark: SparkSession, folder: str) -> DataFrame:
    """orders as scripts in which the environment and ``fs`` go through one to six steps; later steps are absent in most."""
    o = F.col("o_orderkey")
    steps = o % 6 + 1
    parts = [F.when(steps > i, _template(part, k=text(o), KEY=F.concat(F.lit("K"), text(o % 5)))).otherwise("") for i, part in enumerate(FLOW_PARTS)]
    return load(spark, folder, "orders").select(
        F.lit("p").alias("name"), F.lit("1").alias("version"), F.concat(F.lit("f"), text(o), F.lit(".js")).alias("path"), F.concat(*parts).alias("text"), o.alias("ord"),
    )


MANIFEST_TEMPLATE = (
    '{"name":"p{a}","version":"1.{b}.0","main":"./lib/{a}.js","exports":{".":{"import":"./esm/{b}.mjs"}},"bin":{"x":"bin/{b}.js"},'
    '"scripts":{"postinstall":"node {b}.js"},"dependencies":{"d{b}":"^1.{b}"},"peerDependencies":{"q":"http://h{b}.example/q.tgz"},'
    '"maintainers":[{"name":"n","email":"m{b}@x.example"}],"author":"A <a{b}@y.example>","bundledDependencies":["in{b}"]}'
)


def package_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """customer as one package.json per row."""
    c = F.col("c_custkey")
    return load(spark, folder, "customer").select(
        F.concat(F.lit("p"), text(c)).alias("name"), F.concat(F.lit("1."), text(c % 9), F.lit(".0")).alias("version"),
        _template(MANIFEST_TEMPLATE, a=text(c), b=text(c % 9)).alias("text"),
    )


def nested_exports(spark: SparkSession, folder: str) -> DataFrame:
    """orders with their lines as the ``exports`` of one package each: conditions, arrays and objects within objects."""
    lines, orders = load(spark, folder, "lineitem"), load(spark, folder, "orders")
    line = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    per = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("ds"))
    deep = lambda d: F.struct(
        F.concat(F.lit("./l/"), d["l_partkey"].cast("string"), F.lit(".js")).alias("import"), d["l_quantity"].alias("weight"),
        F.array(F.struct(F.concat(F.lit('./"q" '), d["l_returnflag"]).alias("types")), F.struct(F.lit(None).cast("string").alias("types"))).alias("node"),
    )
    body = F.to_json(F.struct(F.concat(F.lit("./o/"), F.col("o_orderpriority")).alias("default"), F.transform("ds", deep).alias("./sub")))
    return orders.join(per, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("order_key"), body.alias("text"))


def detection_corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """customer as fixtures, orders as their findings; customers of every fourth nation belong to a tier that is not active."""
    fixtures = load(spark, folder, "customer").select(
        F.col("c_custkey").alias("fixture_id"), F.col("c_nationkey").alias("year"), F.col("c_mktsegment").alias("threat"), (F.col("c_nationkey") % 4 != 0).alias("active"),
    )
    urgent = F.col("o_orderpriority")
    findings = load(spark, folder, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("fixture_id"), F.concat(F.lit("d"), F.substring("o_orderpriority", 1, 1)).alias("detector"),
        F.when(urgent.startswith("1"), "BLOCK").when(urgent.startswith("2"), "WARN").otherwise("INFO").alias("severity"),
    )
    return fixtures, findings
