"""Capability facts from JavaScript and TypeScript text.

A stack machine finds pattern literals and the first syntax error, after which nothing counts as code. The rest is cut
into strings, templates, comments and code by one pattern. Strings are written into the code as «hex», so words inside
strings and comments never match as code and string arguments stay readable to patterns. Constant folding rewrites that text, and the flow of values is followed in it,
in one Arrow UDF; everything else is Spark string functions, which look for the first words of a pattern before the pattern.
There is no syntax tree: what needs one is listed in the README.
"""

from __future__ import annotations

import functools
import operator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.functions import fixed_values as V
from driftlens.functions import text as X
from driftlens.functions.decode import decode_js_url
from driftlens.functions.folding import fold_text
from driftlens.operators.dataflow_javascript import flow_facts
from driftlens.operators.scan_python import FACT, FILE, _all, _each, _fact, _some, exploded, line_pairs, protect, reveal, settle_literals
from driftlens.operators.syntax_javascript import parse_error, parsed, without_patterns
from driftlens.session import cut_lineage, spread

TOKENS = (
    r"(//[^\n]*|/\*[\s\S]*?(?:\*/|\z)|\"[^\"\n]*\"?|'[^'\n]*'?|`[^`]*`?"
    r"|[^/\"'`]+|/)"
)
LIT = r"[«‹]([0-9A-F]*)[»›]"
CALLS = "|".join(V.NETWORK_CALL_NAMES)
CONFIG = "|".join(V.CONFIG_KEY_NAMES)
CONFIG_HEX = "|".join(k.encode().hex().upper() for k in V.CONFIG_KEY_NAMES)
JS_CLASSES = {"net_module": V.NETWORK_MODULES, "exec_module": V.EXEC_MODULES, "fs_module": V.FS_MODULES}
FS_CALL = r"(?<![\w$])(?:fs|fsp|fsPromises)(?:\s*\.\s*promises)?\s*\.\s*([A-Za-z]+)\s*\(\s*"
WRITE_NAME = r"(?i)write|append|create|unlink|rmdir|rm|copyFile|chmod|chown"


def _hex(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-8"))


def _plain(code: Column) -> Column:
    return F.decode(F.unhex(code), "UTF-8")


def _literal(text: Column) -> Column:
    return F.concat(F.lit("«"), _hex(reveal(text)), F.lit("»"))


def _newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]", "")


def _token_code(token: Column) -> Column:
    """A token as code: comments leave their line breaks, strings become literals, templates sums."""
    inner = F.regexp_replace(token, r"^[\"'`]|[\"'`]\z", "")
    quasis = F.transform(F.split(inner, r"\$\{[^{}]*\}", -1), _literal)
    slots = F.transform(F.regexp_extract_all(inner, F.lit(r"\$\{([^{}]*)\}"), F.lit(1)), lambda e: F.concat(F.lit("("), e, F.lit(")")))
    template = F.array_join(
        F.transform(F.arrays_zip(quasis.alias("q"), slots.alias("s")), lambda z: F.concat_ws("+", z["q"], z["s"])), "+"
    )
    comment = token.startswith("//") | token.startswith("/*")
    return (
        F.when(comment, _newlines(token))
        .when(token.startswith("`"), F.concat(template, _newlines(inner)))
        .when(token.rlike("^[\"']"), _literal(inner))
        .otherwise(token)
    )


FLOW = T.ArrayType(T.StructType().add("cap", T.StringType()).add("key", T.StringType()).add("line", T.IntegerType()).add("snippet", T.StringType()))
FOLDED = T.StructType().add("code", T.StringType()).add("flow", FLOW)
FLOW_TYPE = pa.list_(pa.struct([("cap", pa.string()), ("key", pa.string()), ("line", pa.int32()), ("snippet", pa.string())]))


@F.arrow_udf(FOLDED)
def folded(written: pa.Array, texts: pa.Array) -> pa.Array:
    """The folded code of each file, and what the flow of values in it shows."""
    codes = [None if code is None else fold_text(code) for code in written.to_pylist()]
    flows = [flow_facts(code, text) for code, text in zip(codes, texts.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(flows, FLOW_TYPE)], names=["code", "flow"])


def tokenised(files: DataFrame) -> DataFrame:
    """Adds ``written`` (tokenised code up to an error), ``code`` (the same, folded), ``flow``, ``comments`` and ``parse_error``.

    The text of JSX files is not judged and not cut.
    """
    run = parsed(files.select(*FILE, "text"))
    run = run.withColumn("error_at", F.when(F.lower("path").rlike(r"\.[jt]sx\z"), None).otherwise(F.col("error_at")))
    run = run.withColumns({"error": F.when(F.col("error_at").isNotNull(), F.col("error")), "sound": without_patterns("/./")})
    tokens = F.regexp_extract_all(protect(F.col("sound")), F.lit(TOKENS), F.lit(1))
    return (
        run.select(*FILE, "text", tokens.alias("tokens"), parse_error().alias("parse_error"))
        .select(
            *FILE, "text", "parse_error", F.array_join(F.transform("tokens", _token_code), "").alias("written"),
            F.array_join(F.filter("tokens", lambda t: t.startswith("//") | t.startswith("/*")), "\n").alias("comments"),
        )
        .withColumn("folded", folded("written", "text"))
        .select(*FILE, "text", "parse_error", "written", "comments", "folded.code", "folded.flow")
    )


def _no_facts() -> Column:
    return F.array().cast(f"array<{FACT}>")


def _where(text: Column, words: str, found: Column, kind: str = "string") -> Column:
    """What patterns find in texts that hold one of the words, none of which a match can do without; other texts, which are most, hold nothing."""
    return F.when(functools.reduce(operator.or_, [text.contains(w) for w in words.split()]), found).otherwise(F.array().cast(f"array<{kind}>"))


def _urls(text: Column) -> Column:
    return _where(text, ". ://", X.urls(text))


def modules_of(code: Column) -> Column:
    """Module names from import declarations, the spellings of require, and code given to eval as text."""
    patterns = [
        ("require", rf"(?<![\w$.])require\s*\(\s*{LIT}"), ("call", rf"(?<![\w$.])require\s*\.\s*call\s*\([^,()]*,\s*{LIT}"),
        ("apply", rf"(?<![\w$.])require\s*\.\s*apply\s*\([^,()]*,\s*\[\s*{LIT}"), ("mainModule", rf"\bprocess\s*\.\s*mainModule\s*\.\s*require\s*\(\s*{LIT}"),
        ("_load", rf"\._load\s*\(\s*{LIT}"), ("import", rf"(?<![\w$.])import\s*\(\s*{LIT}"), ("import", rf"(?<![\w$.])import\s+(?:[\w$*{{}},\s]+?\s*from\s*)?{LIT}"),
    ]
    direct = F.transform(F.concat(*[_where(code, word, _all(code, p)) for word, p in patterns]), _plain)
    sources = F.transform(
        F.concat(
            _where(code, "eval", _all(code, rf"(?<![\w$.])eval\s*\(\s*{LIT}")),
            _where(code, "Function", _all(code, rf"\bnew\s+Function\s*\((?:[^()]*,)?\s*{LIT}\s*\)\s*\(")),
        ),
        _plain,
    )
    nested = F.flatten(
        F.transform(
            F.filter(sources, lambda s: F.length(s) < 8192),
            lambda s: F.concat(
                _all(s, r"\brequire\s*\(\s*['\"`]([^'\"`]+)['\"`]"), _all(s, r"\brequire\s*\.\s*call\s*\([^,()]*,\s*['\"`]([^'\"`]+)['\"`]"),
                _all(s, r"\brequire\s*\.\s*apply\s*\([^,()]*,\s*\[\s*['\"`]([^'\"`]+)['\"`]"),
                _all(s, r"\bmainModule\s*\.\s*require\s*\(\s*['\"`]([^'\"`]+)['\"`]"), _all(s, r"\._load\s*\(\s*['\"`]([^'\"`]+)['\"`]"),
            ),
        )
    )
    return F.array_distinct(F.concat(direct, nested))


def path_argument(argument: Column) -> Column:
    """Path text of a call argument: literal, template with empty slots, path.join, home folder sums."""
    joined = F.regexp_extract(argument, r"^path\s*\.\s*(?:join|resolve)\s*\((.*)\)", 1)
    homed = F.regexp_replace(joined, r"os\s*\.\s*homedir\s*\(\s*\)", "«7E»")
    parts = F.transform(
        F.split(homed, ","), lambda p: F.coalesce(_plain(F.nullif(F.regexp_extract(F.trim(p), rf"^{LIT}\z", 1), F.lit(""))), F.lit("?"))
    )
    total = F.regexp_replace(argument, r"os\s*\.\s*homedir\s*\(\s*\)", "«7E»")
    pieces = F.array_join(F.transform(_all(total, LIT), _plain), "")
    only_text = F.trim(F.regexp_replace(F.regexp_replace(total, LIT, ""), r"\([^()]*\)", "")).rlike(r"^[\s+]*\z")
    return F.when(joined != "", F.array_join(parts, "/")).when(only_text & (pieces != ""), pieces)


FS_ARGUMENT = (
    r"(?:path\s*\.\s*(?:join|resolve)\s*\((?:[^()]++|\([^()]*+\))*+\)"
    r"|(?:[«‹][0-9A-F]*[»›]|\([^()]*+\)|os\s*\.\s*homedir\s*\(\s*\)|[\s+])++)"
)


def file_targets(code: Column) -> Column:
    """Facts for literal targets of file calls; write names win over read names."""

    def target(call):
        op = F.regexp_extract(call, FS_CALL, 1)
        cap = F.when(op.rlike(WRITE_NAME), "fs_write").when(op.rlike("(?i)read"), "fs_read")
        return F.struct(cap.alias("cap"), path_argument(F.trim(F.regexp_replace(call, FS_CALL, ""))).alias("key"))

    found = F.transform(_where(code, "fs", _all(code, FS_CALL + FS_ARGUMENT, 0)), target)
    kept = F.filter(found, lambda f: f["cap"].isNotNull() & f["key"].isNotNull() & (F.length(f["key"]) < 512) & (f["key"] != ""))
    return _each(kept, lambda f: _fact(f["cap"], f["key"], F.lit(1), F.concat(f["cap"], F.lit(" "), f["key"])))


def hinted_targets(literals: Column, operations: Column) -> Column:
    """Sensitive-looking path literals anywhere in a file that touches files at all."""
    looks = r"^([~./]|[A-Z]:\\|/[a-zA-Z._-]|[a-zA-Z_-]+[/\\])"
    hints = "(?i)" + "|".join(V.SENSITIVE_PATH_HINTS)
    paths = F.filter(literals, lambda p: F.length(p).between(3, 199) & p.rlike(looks) & p.rlike(hints))

    def part(cap, name):
        touches = F.exists(operations, lambda op: op.rlike(name))
        found = _each(paths, lambda p: _fact(cap, p, F.lit(1), F.concat(F.lit(f"{cap} "), p)))
        return F.when(touches, found).otherwise(_no_facts())

    return F.concat(part("fs_write", WRITE_NAME), part("fs_read", "(?i)read"))


def module_facts(modules: Column) -> Column:
    def part(cap, members):
        known = F.filter(modules, lambda m: m.isin(members))
        return _each(known, lambda m: _fact(cap, m, F.lit(1), F.concat(F.lit("imports "), m)))

    return F.concat(*[part(cap, members) for cap, members in JS_CLASSES.items()])


def whole_file_facts(code: Column, written: Column, modules: Column, literals: Column, operations: Column) -> Column:
    decoder = written.contains("charCodeAt") & written.rlike(r"\bString\s*\.\s*fromCharCode\s*\(") & written.rlike(r"\.\s*charCodeAt\b")
    kind = "char-arithmetic-decoder"
    short = F.filter(
        literals, lambda v: F.length(v).between(8, 199) & v.rlike("[a-zA-Z]") & v.contains("."),
    )
    return F.concat(
        module_facts(modules), F.array_distinct(F.concat(file_targets(code), hinted_targets(literals, operations))),
        _some(decoder, _fact("dynamic_code", F.concat_ws(":", "path", F.lit(1), F.lit(kind)), F.lit(1), F.lit("character codes read and written"), F.lit(kind))),
        F.when(decoder, _each(short, lambda v: _fact("suspicious_literal", F.lit(""), F.lit(1), F.substring(v, 1, 40)))).otherwise(_no_facts()),
    )


def line_facts(code: Column, raw: Column, line: Column) -> Column:
    """Environment reads and dynamic code of one line, which carry line numbers."""
    snippet = F.trim(F.substring(raw, 1, 240))
    env = r"(?<![\w$.])process\s*\.\s*env"
    named = F.concat(
        _all(code, env + r"\s*\.\s*([A-Za-z_$][\w$]*)"), _where(code, "[", F.transform(_all(code, env + rf"\s*\[\s*{LIT}\s*\]"), _plain)),
        _where(code, "Reflect", F.transform(_all(code, rf"\bReflect\s*\.\s*get\s*\(\s*process\s*\.\s*env\s*,\s*{LIT}"), _plain)),
    )
    destructured = F.transform(
        F.flatten(F.transform(_where(code, "}", _all(code, r"\{([^{}]*)\}\s*=\s*process\s*\.\s*env\b(?!\s*[.\[])")), lambda p: F.split(p, ","))),
        lambda p: F.trim(F.element_at(F.split(F.trim(p), "[:=]"), 1)),
    )
    wildcard = lambda k: F.when(k.startswith("..."), F.lit("*")).otherwise(F.coalesce(_plain(F.nullif(F.regexp_extract(k, LIT, 1), F.lit(""))), k))
    keys = F.concat(named, F.transform(F.filter(destructured, lambda p: p != ""), wildcard))
    whole = F.array_compact(F.array(*[
        F.when(code.contains(word) & code.rlike(p), F.lit("*"))
        for word, p in (
            ("[", env + r"\s*\[\s*(?![«‹\s])"), ("Object", r"\bObject\s*\.\s*\w+\s*\([^()]*?process\s*\.\s*env\s*[,)]"), ("...", r"\.\.\.\s*process\s*\.\s*env\b(?!\s*[.\[])"),
            ("env", r"\b(?:in|of)\s+process\s*\.\s*env\b(?!\s*[.\[])"), ("Reflect", r"\bReflect\s*\.\s*(?:ownKeys|has)\s*\(\s*process\s*\.\s*env"),
            ("Reflect", r"\bReflect\s*\.\s*get\s*\(\s*process\s*\.\s*env\s*,\s*(?![«‹\s])"), ("Reflect", r"\bReflect\s*\.\s*get\s*\(\s*process\s*,\s*[«‹]656E76[»›]"),
        )
    ]))

    def sites(word, pattern, kind):
        found = _each(_all(code, pattern, 0), lambda _: _fact("dynamic_code", F.concat_ws(":", "path", line, F.lit(kind)), line, snippet, F.lit(kind)))
        return _where(code, word, found, FACT)

    return F.concat(
        _each(_where(code, "env Reflect", F.concat(keys, whole)), lambda k: _fact("env", k, line, snippet)),
        sites("eval", r"(?<![\w$.])eval\s*\(", "eval"), sites("Function", r"\bnew\s+Function\b\s*\(", "new-function"),
        sites("require", r"(?<![\w$.])require\s*(?:\.\s*call\s*\([^,()]*,|\()\s*(?![«‹\s)])", "dynamic-require"),
        sites("import", r"(?<![\w$.])import\s*\(\s*(?![«‹\s)])", "dynamic-import"),
    )


def url_lists(code: Column, comments: Column) -> dict[str, Column]:
    """URLs by where they appear: call argument, configuration value, any literal, comment, folded value."""

    def urls_in(words, pattern):
        texts = F.filter(F.transform(F.array_distinct(_where(code, words, _all(code, pattern))), _plain), lambda v: F.length(v).between(1, 4096))
        return F.array_distinct(F.flatten(F.transform(texts, _urls)))

    return {
        "network-arg": urls_in(" ".join(V.NETWORK_CALL_NAMES), rf"(?<![\w$])(?:{CALLS})\s*\(\s*(?:[^(){{}}«»‹›+]*,\s*)?«([0-9A-F]*)»\s*[,)]"),
        "config-value": urls_in(":", rf"(?:(?<![\w$])(?:{CONFIG})|«(?:{CONFIG_HEX})»)\s*:\s*«([0-9A-F]*)»\s*[,}}\n;]"),
        "literal": urls_in("«", "«([0-9A-F]*)»"),
        "comment": F.array_distinct(_urls(comments)),
        "folded": urls_in("‹", "‹([0-9A-F]*)›"),
    }


def url_facts(lists: dict[str, Column]) -> Column:
    """Each URL once with its strongest context; values that exist only after folding have none."""

    def tagged(values, context):
        return _each(values, lambda u: _fact("url", u, F.lit(1), F.substring(u, 1, 240), context=F.lit(context)))

    stages, seen = [], F.array().cast("array<string>")
    for name, values in lists.items():
        stages.append(tagged(F.array_except(values, seen), None if name == "folded" else name))
        seen = F.array_union(seen, values)
    return F.concat(*stages)


def literal_candidates(code: Column) -> Column:
    """Literals of 24 characters or more (48 hex digits) with their line, to be judged after the explode."""
    marked = r"([«‹][0-9A-F]{48,}[»›])"

    def of_line(part, place):
        return _each(
            F.when(F.length(part) >= 50, _where(part, "« ‹", _all(part, marked))).otherwise(F.array().cast("array<string>")),
            lambda m: _fact(
                "literal", _plain(F.substring(m, F.lit(2), F.length(m) - 2)), place + 1, F.lit(""), F.when(m.startswith("«"), "written").otherwise("folded")
            ),
        )

    return F.flatten(F.transform(F.split(code, "\n"), of_line))


def _broken(error: Column) -> Column:
    """The fact that a file is not well formed, at the line of its first error."""
    line = F.regexp_extract(error, r"\((\d+):", 1).cast("int")
    return _some(error.isNotNull(), _fact("parse_error", error, line, error))


def _flow(facts: Column, flow: Column) -> Column:
    """What only the flow of values shows: keys and targets that no pattern of a single place has found in the file."""
    named = lambda f: F.concat_ws(" ", f["cap"], f["key"])
    known = F.array_distinct(F.transform(F.filter(facts, lambda f: f["cap"].isin("env", "fs_read", "fs_write") & f["key"].isNotNull()), named))
    unnamed = functools.reduce(operator.or_, [F.col(c).isNull() for c in ("name", "version", "path")])
    return _each(
        F.filter(flow, lambda f: unnamed | ~F.array_contains(known, named(f))), lambda f: _fact(f["cap"], f["key"], f["line"], f["snippet"])
    )


def javascript_facts(files: DataFrame) -> DataFrame:
    """One pass: each file row becomes an array of facts, exploded once. Nothing is joined, as no fact needs another file.

    Files are dealt by hash first: a table of sources may be one small file, and the work is heavy per row. What the flow
    of values shows counts once a file, also if the file comes twice.
    """
    code, path = F.col("code"), F.col("path")
    is_json = path.endswith(".json")
    triggers = "process eval Function import require"
    numbered = F.transform(
        line_pairs(code, F.col("text")), lambda z, i: F.struct(z["code"].alias("code"), z["raw"].alias("raw"), (i + 1).alias("line"))
    )
    per_line = F.transform(
        F.filter(numbered, lambda z: functools.reduce(operator.or_, [z["code"].contains(w) for w in triggers.split()])),
        lambda z: line_facts(z["code"], z["raw"], z["line"]),
    )
    # Values several facts need become columns first, so that each is computed once per file.
    urls = url_lists(code, F.col("comments"))
    prepared = tokenised(spread(files.filter(~is_json), *FILE)).withColumns(
        {
            "modules": modules_of(code), "literals": F.array_distinct(F.transform(_where(code, "« ‹", _all(code, LIT)), _plain)),
            "operations": _where(code, "fs", _all(code, FS_CALL, 1)), **urls,
        }
    )
    facts = F.concat(
        whole_file_facts(code, F.col("written"), F.col("modules"), F.col("literals"), F.col("operations")), F.flatten(per_line),
        url_facts({name: F.col(f"`{name}`") for name in urls}), literal_candidates(code), _broken(F.col("parse_error")),
    )
    prepared = prepared.select(*FILE, "flow", facts.alias("facts"))
    behind = F.col("place") >= F.size("facts")
    rows = prepared.select(*FILE, "facts", F.posexplode(F.concat("facts", _flow(F.col("facts"), F.col("flow")))).alias("place", "f")).select(
        "name", "version", "path", (F.col("ord") * 1_000_000_000 + F.when(behind, F.col("f.line") + 900_000_000).otherwise(F.col("place"))).alias("ord"),
        behind.alias("behind"), "f.*",
    )
    hit = F.col("hit")
    hidden = _fact(
        "encoded_url", hit["url"], F.col("line"),
        F.concat(hit["encoding"], F.lit('("'), F.substring("key", 1, 60), F.lit('") → '), hit["url"]), hit["encoding"],
    )
    settled = cut_lineage(settle_literals(rows, decode_js_url, hidden, "behind"))
    flown = settled.filter("behind").drop("behind").dropDuplicates([*FILE, "cap", "key", "line"])
    # JSON files other than manifests: their URLs, without context.
    plain = files.filter(is_json & ~path.rlike(r"(^|/)package\.json\z"))
    listed = _each(F.array_distinct(X.urls(F.col("text"))), lambda u: _fact("url", u, F.lit(1), F.substring(u, 1, 240)))
    return settled.filter("not behind").drop("behind").unionByName(flown).unionByName(exploded(plain, listed))
