"""Where JavaScript text stops being well formed, and where its pattern literals stand.

A stack machine runs over the lexemes of a file as one ``aggregate`` with a struct as state: the mode (code, string,
template, pattern, comment), the stack of open brackets, and whether an operand may follow, which tells a pattern literal
from a division. The text is cut once, every lexeme is looked at once, and spans are cut out with slices, so the work is
linear in the text and has no look-behind. After the first error the state no longer changes.

It is a machine for brackets and literals, not a grammar: what balances and ends is taken as well formed. Text between JSX
tags is not known to it, so files of those kinds are not judged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEXEMES = (
    r"(\A#![^\n]*|\\(?:\r\n|[\s\S])|//|/\*|\*/|\$\{|=>|[\"'`/()\[\]{}\r\n;,]"
    r"|\$+(?!\{)|[^\\/*$=\"'`()\[\]{}\r\n;,]+|[\s\S])"
)
#: Words after which an operand follows, so that a slash begins a pattern.
OPERAND_WORDS = "return|typeof|case|delete|void|throw|new|in|of|instanceof|yield|await|extends|default"
#: Words after which a statement follows, and words whose parentheses do not end a value.
STATEMENT_WORDS = "else|do|try|finally"
CONTROL_WORDS = "if|while|for|with"
STATE = (
    "struct<mode:string,stack:string,before:string,at:int,start:int,star:boolean,patterns:array<struct<first:int,last:int>>,"
    "error:string,error_at:int>"
)
FIELDS = [f.split(":")[0] for f in ("mode", "stack", "before", "at", "start", "star", "patterns", "error", "error_at")]
#: A whole text without patterns, divisions, ``${`` and escapes outside strings: what its parts are does not depend on what
#: stands before them. Every group is possessive, so a text is read once.
PLAIN_PARTS = (
    r"\"(?:[^\"\\\r\n]++|\\(?:\r\n|[\s\S]))*+\"|'(?:[^'\\\r\n]++|\\(?:\r\n|[\s\S]))*+'"
    r"|`(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+`|(?<!\*)//[^\r\n]*+|(?<!\*)/\*[^*/\\]*+(?:\*(?!/)[^*/\\]*+)*+\*/"
)
PLAIN = rf"\A(?!#!)(?:[^\"'`/\\]++|{PLAIN_PARTS})*+\z"
#: Rounds that take away innermost brackets; text that nests deeper goes through the machine.
PLAIN_DEPTH = 8
# modes: c code, l line comment, b block comment, " ' ` literals, r pattern, k class of a pattern
# before: s a statement may begin, x an operand must follow, v a value ended, d the same with a dollar, i a control word


def _kind(lexeme: Column) -> Column:
    """What a run of other characters leaves before the next lexeme: empty if it is blank, a capital if its only word decides."""
    tail = F.regexp_extract(lexeme, r"(?:^|[^\w$.\x{80}-\x{10FFFF}])(\w+)\s*\z", 1)
    alone = lexeme.startswith(tail)
    return (
        F.when(lexeme.rlike(r"\A(?:\s*|#!.*)\z"), "")
        .when(lexeme.startswith("$"), "d")
        .when(lexeme.rlike(r"(?:\+\+|--)\s*\z"), "v")
        .when(~lexeme.rlike(r"[\w$\\\x{80}-\x{10FFFF}]\s*\z"), "x")
        .when(tail.rlike(rf"\A(?:{OPERAND_WORDS})\z"), F.when(alone, "X").otherwise("x"))
        .when(tail.rlike(rf"\A(?:{STATEMENT_WORDS})\z"), F.when(alone, "S").otherwise("s"))
        .when(tail.rlike(rf"\A(?:{CONTROL_WORDS})\z"), F.when(alone, "I").otherwise("i"))
        .otherwise("v")
    )


def _step(s: Column, lexeme: Column) -> Column:
    text, kind = lexeme["text"], lexeme["kind"]

    def to(**changes) -> Column:
        fields = {"at": s["at"] + 1, "star": F.lit(False)} | changes
        return F.struct(*[(fields[f] if isinstance(fields.get(f), Column) else F.lit(fields[f]) if f in fields else s[f]).alias(f) for f in FIELDS])

    def fail(message: str, at: Column) -> Column:
        return to(error=message, error_at=at)

    def enter(mode: str) -> Column:
        return to(mode=mode, start=s["at"])

    def ended(before: str = "v") -> Column:
        return to(mode="c", before=before)

    def pattern_end(before: str = "v") -> Column:
        span = F.struct(s["start"].alias("first"), s["at"].alias("last"))
        return to(mode="c", before=before, patterns=F.concat(s["patterns"], F.array(span)))

    def push(mark: Column | str, before: str) -> Column:
        return to(stack=F.concat(s["stack"], mark if isinstance(mark, Column) else F.lit(mark)), before=before)

    top = F.substring(s["stack"], -1, 1)
    below = F.substring(s["stack"], F.lit(1), F.length(s["stack"]) - 1)

    def pop(marks: dict[str, Column]) -> Column:
        """Closes the bracket on top if it is one of these."""
        chosen = fail("Unexpected token", s["at"])
        for mark, then in marks.items():
            chosen = F.when(top == mark, then).otherwise(chosen)
        return chosen

    value = s["before"].isin("v", "d")
    word = F.when(s["before"] == "d", "v").otherwise(F.lower(kind))  # a dollar and a word are one name
    broken = text.isin("\n", "\r", "\\\n", "\\\r", "\\\r\n")
    code = (
        F.when(kind.isin("X", "S", "I"), to(before=word))
        .when(kind != "", to(before=kind))
        .when(text.isin("\n", "\r"), to(before=F.when(value, "v").otherwise(s["before"])))
        .when(text.isin('"', "'", "`"), to(mode=text, start=s["at"]))
        .when(text == "//", enter("l"))
        .when(text == "/*", enter("b"))
        .when(text == "/", F.when(value, to(before="x")).otherwise(enter("r")))
        .when(text == "(", push(F.when(s["before"] == "i", "i").otherwise("("), "x"))
        .when(text == "[", push("[", "x"))
        .when(text.isin("{", "${"), push(F.when((text == "{") & (s["before"] == "x"), "o").otherwise("{"), "s"))
        .when(text == ")", pop({"(": to(stack=below, before="v"), "i": to(stack=below, before="s")}))
        .when(text == "]", pop({"[": to(stack=below, before="v")}))
        .when(text == "}", pop({"{": to(stack=below, before="s"), "o": to(stack=below, before="v"), "$": to(stack=below, mode="`", start=s["at"])}))
        .when(text.isin(";", "=>"), to(before="s"))
        .when(text == "*/", fail("Unexpected token", s["at"]))
        .when(text == ",", to(before="x"))
        .otherwise(to())
    )
    string = F.when(text == s["mode"], ended()).when(text.isin("\n", "\r"), fail("Unterminated string constant", s["start"])).otherwise(to())
    template = F.when(text == "`", ended()).when(text == "${", to(mode="c", stack=F.concat(s["stack"], F.lit("$")), before="x")).otherwise(to())
    line = F.when(F.right(text, F.lit(1)).isin("\n", "\r"), to(mode="c")).otherwise(to())
    block = F.when((text == "*/") | (s["star"] & text.startswith("/")), to(mode="c")).otherwise(to(star=text.isin("/*", "\\*", "*")))
    pattern = (
        F.when(broken, fail("Unterminated regular expression", s["start"]))
        .when(text.isin("/", "*/"), pattern_end())
        .when(text.isin("//", "/*"), pattern_end("x"))
        .when(text == "[", to(mode="k"))
        .otherwise(to())
    )
    class_ = F.when(broken, fail("Unterminated regular expression", s["start"])).when(text == "]", to(mode="r")).otherwise(to())
    mode = s["mode"]
    return (
        F.when(s["error"].isNotNull(), s)
        .when(mode == "c", code).when(mode == "l", line).when(mode == "b", block).when(mode == "`", template)
        .when(mode == "r", pattern).when(mode == "k", class_).otherwise(string)
    )


def _plainly_sound(text: Column) -> Column:
    """That a text has no slash but those of comments and that its brackets close: the machine would find no pattern and no error."""
    rest = F.regexp_replace(F.regexp_replace(text, PLAIN_PARTS, ""), r"[^()\[\]{}]++", "")
    for _ in range(PLAIN_DEPTH):
        rest = F.regexp_replace(rest, r"\(\)|\[\]|\{\}", "")
    return F.when(text.rlike(PLAIN), rest == "").otherwise(False)


def parsed(files: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``lexemes``, ``patterns`` (spans of pattern literals, as numbers of lexemes), ``error`` and ``error_at`` (a lexeme).

    A text that is plainly sound is one lexeme and needs no machine, which costs many times more a character.
    """
    zero = F.from_json(
        F.lit('{"mode":"c","stack":"","before":"s","at":1,"start":1,"star":false,"patterns":[]}'), STATE
    )
    marks = ['"', "'", "`", "/", "(", ")", "[", "]", "{", "}", "\r", "\n", ";", ",", "//", "/*", "*/", "${", "=>"]
    kinded = F.transform("lexemes", lambda t: F.struct(t.alias("text"), F.when(t.isin(marks), "").otherwise(_kind(t)).alias("kind")))
    body = F.coalesce(text, F.lit(""))
    run = files.withColumn("plain", _plainly_sound(body))
    run = run.withColumn("lexemes", F.when(F.col("plain"), F.array(body)).otherwise(F.regexp_extract_all(body, F.lit(LEXEMES), F.lit(1))))
    run = run.withColumn("state", F.when(F.col("plain"), zero).otherwise(F.aggregate(kinded, zero, _step)))
    mode, state = F.col("state.mode"), F.col("state")
    ending = (
        F.when(mode.isin('"', "'"), "Unterminated string constant").when(mode == "`", "Unterminated template")
        .when(mode == "b", "Unterminated comment").when(mode.isin("r", "k"), "Unterminated regular expression")
        .when(state["stack"] != "", "Unexpected token")
    )
    at_end = F.when(mode.isin("c", "l"), state["at"]).otherwise(state["start"])
    return run.withColumns({
        "patterns": state["patterns"], "error": F.coalesce(state["error"], ending),
        "error_at": F.when(state["error"].isNotNull(), state["error_at"]).when(ending.isNotNull(), at_end),
    }).drop("state", "plain")


def _joined(lexemes: Column, first: Column, last: Column) -> Column:
    """The text of lexemes from one number up to, but without, another."""
    return F.array_join(F.slice(lexemes, first, F.greatest(last - first, F.lit(0))), "")


def without_patterns(stand_in: str) -> Column:
    """The text up to the first error, with a stand-in for each pattern literal."""
    spans, lexemes = F.col("patterns"), F.col("lexemes")
    end = F.coalesce(F.col("error_at"), F.size(lexemes) + 1)
    pieces: Callable[[Column, Column], Column] = lambda p, i: F.concat(
        _joined(lexemes, F.when(i == 0, F.lit(1)).otherwise(F.element_at(spans, F.greatest(i, F.lit(1)))["last"] + 1), p["first"]), F.lit(stand_in)
    )
    tail = _joined(lexemes, F.when(F.size(spans) == 0, F.lit(1)).otherwise(F.element_at(spans, -1)["last"] + 1), end)
    return F.concat(F.array_join(F.transform(spans, pieces), ""), tail)


def parse_error() -> Column:
    """The message with line and column of the error, null without one."""
    before = _joined(F.col("lexemes"), F.lit(1), F.col("error_at"))
    lines = F.split(before, r"\r\n|\n|\r", -1)
    place = F.concat(F.lit(" ("), F.size(lines).cast("string"), F.lit(":"), F.length(F.element_at(lines, -1)).cast("string"), F.lit(")"))
    return F.when(F.col("error").isNotNull(), F.concat("error", F.lit("."), place))


def parse_errors(files: DataFrame) -> DataFrame:
    """(name, version, path, parse_error) for each script that is not well formed; JSON and JSX files are not judged."""
    judged = files.filter(~F.lower("path").rlike(r"\.(?:json|jsx|tsx)\z"))
    return parsed(judged).filter(F.col("error").isNotNull()).select("name", "version", "path", parse_error().alias("parse_error"))
