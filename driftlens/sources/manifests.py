"""Manifests inside packages as long tables keyed by (name, version)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import fixed_values as V
from driftlens.sources.json_tree import string_leaves, unreadable

KEY = ["name", "version"]
PERSON = "struct<name:string,email:string>"
PACKAGE_JSON = (
    "name string, version string, main string, module string, browser string, types string, typings string, "
    "bin string, exports string, scripts map<string,string>, dependencies map<string,string>, "
    "optionalDependencies map<string,string>, peerDependencies map<string,string>, devDependencies map<string,string>, "
    f"maintainers array<{PERSON}>, _npmUser {PERSON}, author string, "
    "bundledDependencies array<string>, bundleDependencies array<string>"
)


def package_manifests(texts: DataFrame) -> DataFrame:
    """Parsed package.json rows. ``texts``: name, version, text. Unreadable JSON gives an empty manifest."""
    return texts.select(*KEY, F.from_json("text", PACKAGE_JSON).alias("m")).select(
        *KEY, F.coalesce("m.bundledDependencies", "m.bundleDependencies").alias("bundled_names"), "m"
    )


def scripts(manifests: DataFrame) -> DataFrame:
    return manifests.select(*KEY, F.explode("m.scripts").alias("hook", "body")).filter("body is not null")


def dependencies(manifests: DataFrame) -> DataFrame:
    buckets = ["dependencies", "optionalDependencies", "peerDependencies", "devDependencies"]

    def listed(bucket):
        return F.transform(
            F.map_entries(f"m.{bucket}"), lambda e: F.struct(F.lit(bucket).alias("bucket"), e["key"].alias("dep"), e["value"].alias("spec"))
        )

    entries = F.flatten(F.array_compact(F.array(*[listed(b) for b in buckets])))
    return manifests.select(*KEY, F.posexplode(entries).alias("ord", "d")).select(
        "name", "version", "d.bucket", F.col("d.dep").alias("dep"), F.coalesce("d.spec", F.lit("")).alias("spec"),
        F.col("ord").cast("long").alias("ord"),
    )


def emails(manifests: DataFrame) -> DataFrame:
    """Publisher addresses with where they were found; the author field may be text or an object."""
    author = F.col("m.author")
    author_mail = F.coalesce(
        F.get_json_object(author, "$.email"), F.nullif(F.regexp_extract(author, r"<([^>]+@[^>]+)>", 1), F.lit(""))
    )
    people = F.concat(
        F.coalesce(F.transform("m.maintainers", lambda p: F.struct(F.lit("maintainer").alias("source"), p["email"].alias("email"))), F.array()),
        F.array(
            F.struct(F.lit("publisher").alias("source"), F.col("m._npmUser.email").alias("email")),
            F.struct(F.lit("author").alias("source"), author_mail.alias("email")),
        ),
    )
    return manifests.select(*KEY, F.explode(people).alias("p")).select(*KEY, "p.source", "p.email").filter("email is not null")


def bundled(manifests: DataFrame) -> DataFrame:
    return manifests.select(*KEY, F.explode(F.array_distinct("bundled_names")).alias("bundle")).filter("bundle != ''")


def bundled_scripts(manifests: DataFrame, entries: DataFrame) -> DataFrame:
    """Hooks of declared bundled packages, one level deep. ``entries``: name, version, path, text."""
    inner = entries.filter(F.col("path").rlike(r"^node_modules/((?:@[^/]+/)?[^/]+)/package\.json\z")).select(
        *KEY, F.regexp_extract("path", r"^node_modules/((?:@[^/]+/)?[^/]+)/package\.json\z", 1).alias("bundle"),
        F.explode(F.from_json("text", PACKAGE_JSON)["scripts"]).alias("hook", "body"),
    )
    return bundled(manifests).join(inner, [*KEY, "bundle"]).filter(
        F.col("hook").isin(V.BUNDLED_HOOKS) & F.col("body").isNotNull()
    ).select(*KEY, "bundle", "hook", "body")


def entry_files(manifests: DataFrame) -> DataFrame:
    """Paths a manifest declares as entries: the simple fields, every string below ``exports``, and ``bin`` or its values.

    An object that repeats a name is read by a pattern instead of the parser, so its strings are not lost.
    """
    field = lambda name: manifests.select(*KEY, F.col(f"m.{name}").alias("text"))
    nested = F.col("text").rlike(r"^\s*[\[{]")
    listed = field("exports").filter(nested)
    plain = F.array_compact(F.array(*[F.col(f"m.{name}") for name in ("main", "module", "types", "typings", "browser", "exports", "bin")]))
    plain = F.filter(plain, lambda p: ~p.rlike(r"^\s*[\[{]"))
    in_pattern = F.regexp_extract_all("text", F.lit(r'[:\[,]\s*"([^"\\]*)"(?!\s*:)'), F.lit(1))
    paths = (
        manifests.select(*KEY, F.explode(plain).alias("p"))
        .unionByName(string_leaves(listed, KEY).select(*KEY, F.col("leaf").alias("p")))
        .unionByName(unreadable(listed).select(*KEY, F.explode(in_pattern).alias("p")))
        .unionByName(field("bin").filter(nested).select(*KEY, F.explode(F.map_values(F.from_json("text", "map<string,string>"))).alias("p")))
    )
    path = F.regexp_replace("p", r"^\.?/", "")
    return paths.select(*KEY, path.alias("path")).filter("path != ''").distinct()


# --- Python packages ------------------------------------------------------------------------------

def header_fields(texts: DataFrame) -> DataFrame:
    """METADATA or PKG-INFO headers as rows (name, version, ord, field, value); folded lines are joined."""
    head = F.substring_index(F.regexp_replace("text", "\r\n", "\n"), "\n\n", 1)
    unfolded = F.regexp_replace(head, r"\n[ \t]+", " ")
    return (
        texts.select(*KEY, F.posexplode(F.split(unfolded, "\n")).alias("ord", "line"))
        .select(
            *KEY, "ord", F.regexp_extract("line", r"^([A-Za-z][A-Za-z0-9-]*):\s*(.*)$", 1).alias("field"),
            F.trim(F.regexp_extract("line", r"^([A-Za-z][A-Za-z0-9-]*):\s*(.*)$", 2)).alias("value"),
        )
        .filter("field != ''")
    )


def malformed_headers(fields: DataFrame) -> DataFrame:
    """Packages whose header repeats Name or Version: their analysis counts as failed."""
    wanted = F.lower("field")
    return (
        fields.groupBy(*KEY)
        .agg(F.count_if(wanted == "name").alias("names"), F.count_if(wanted == "version").alias("versions"))
        .filter("names > 1 or versions > 1")
        .select(*KEY, F.lit("malformed METADATA: a field appears twice").alias("error"))
    )


def python_dependencies(fields: DataFrame) -> DataFrame:
    pattern = r"^([A-Za-z0-9_.\-\[\]]+)\s*(?:\(([^)]+)\))?"
    dep = F.regexp_replace(F.regexp_extract("value", pattern, 1), r"\[.*?\]$", "")
    return (
        fields.filter("field = 'Requires-Dist'")
        .select(*KEY, F.lit("dependencies").alias("bucket"), dep.alias("dep"), F.regexp_extract("value", pattern, 2).alias("spec"), F.col("ord").cast("long").alias("ord"))
        .filter("dep != ''")
    )


def python_emails(fields: DataFrame) -> DataFrame:
    return fields.filter("field in ('Author-email', 'Maintainer-email') and value != ''").select(
        *KEY, F.lit("maintainer").alias("source"), F.col("value").alias("email")
    )


def python_entry_points(texts: DataFrame) -> DataFrame:
    """Script and entry-point declarations of pyproject.toml. ``texts``: name, version, text."""
    section = r'^\[(?:project\.scripts|tool\.poetry\.scripts|project\.entry-points\."[^"]+")\]'
    return (
        texts.select(*KEY, F.explode(F.split("text", r"(?m)(?=^\[)")).alias("block"))
        .filter(F.col("block").rlike(section))
        .select(*KEY, F.explode(F.split("block", "\n")).alias("line"))
        .select(
            *KEY, F.regexp_extract("line", r"^\s*([A-Za-z_][\w-]*)\s*=\s*['\"]([^'\"]+)['\"]", 1).alias("entry"),
            F.regexp_extract("line", r"^\s*([A-Za-z_][\w-]*)\s*=\s*['\"]([^'\"]+)['\"]", 2).alias("target"),
        )
        .filter("entry != ''")
    )
