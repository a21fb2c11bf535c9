"""Where values of JavaScript names come from: aliases, destructuring, arguments and results of functions.

A file gives links (a name receives an access path), parameters and arguments of calls, and uses of paths. The closure
goes to the fixpoint: a name that receives a path of a known name is known. Roots are ``process``, the usual names of
``fs``, and modules that are required. Paths of interest are short (``process.env.KEY``, ``fs.promises.read``), so the
closure ends on cyclic assignments too. Calls are joined by function name and position, whoever calls: an argument may
reach a parameter that another call fills. Patterns may nest three deep.

Nothing leaves the file, so each is followed in plain Python where its text is folded, without a table or a shuffle. Rules
look for their first words before their pattern.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

#: The word boundary of the JVM, which knows letters of all scripts, while words are ASCII.
EDGE = r"(?u:\b)"
#: The word first, what stands before it second: then the search skips to its letters.
FUNCTION = r"function(?<!(?u:\w)function)"
#: Blanks of one line.
GAP = r"[ \t\f\v\r]"
NAME = r"[A-Za-z_$][\w$]*+"
PATH = rf"(?:require«[0-9A-F]*»|{NAME})(?:\.(?:{NAME}|«[0-9A-F]*»))*+"
MEMBER = PATH.removesuffix("*+") + "++"
ENDS = r"(?![\w$.(\[«])"
INNER = r"\{[^{}]*+\}"
NESTED = rf"\{{(?:[^{{}}]++|{INNER})*+\}}"
PATTERN = rf"\{{(?:[^{{}}]++|{NESTED})*+\}}"
ENTRY = rf"((?:\.\.\.\s*{NAME}|(?:{NAME}|[«‹][0-9A-F]*[»›])(?:\s*:\s*(?:{NAME}|{PATTERN}))?))"
FS_NAMES = ("fs", "fsp", "fsPromises")
FS_MODULES = ("fs", "fs/promises", "node:fs", "node:fs/promises")
#: process.env.KEY and module.default.promises.name: longer paths say nothing that is looked for.
MOST_PROPERTIES = 3
Fact = tuple[str, str, int, str]
Pair = tuple[str, str]


def _rule(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


WRITES, READS = _rule(r"(?i)write|append|create|unlink|rmdir|rm|copyFile|chmod|chown"), _rule(r"(?i)read")
# spellings of one access
REQUIRED = _rule(r"(?<![\w$.])require[ \t]*\(\s*[«‹]([0-9A-F]*)[»›]\s*\)")
OPTIONAL = _rule(r"[ \t]*\?\.(?=[ \t]*[A-Za-z_$\[])")
INDEXED = _rule(r"(?<=[\w$»)\]])[ \t]*\.?[ \t]*\[[ \t]*[«‹]([0-9A-F]*)[»›][ \t]*\]")
DOTTED = _rule(r"(?<=[\w$»)\]])[ \t]*\.[ \t]*(?=[A-Za-z_$«])")
REFLECTED = _rule(rf"{EDGE}Reflect\.get[ \t]*\(\s*({PATH})\s*,\s*[«‹]([0-9A-F]*)[»›]\s*\)")
# links
DECLARED = _rule(rf"{FUNCTION}\s+({NAME})\s*\(([^()]*+)\)")
ARROW = _rule(rf"(?<![\w$.])({NAME})\s*=\s*(?:async\s+)?\(([^()]*+)\)\s*=>")
ARROW_OF_ONE = _rule(rf"(?<![\w$.])({NAME})\s*=\s*(?:async\s+)?({NAME})\s*=>")
RETURNED = _rule(rf"{FUNCTION}\s+({NAME})\s*\([^()]*+\)\s*\{{[^{{}}]*?{EDGE}return\s+({PATH}){ENDS}")
ARROW_RETURNED = _rule(rf"(?<![\w$.])({NAME})\s*=\s*(?:async\s+)?(?:\([^()]*+\)|{NAME})\s*=>\s*(?:\{{[^{{}}]*?{EDGE}return\s+)?({PATH}){ENDS}")
TAKEN = _rule(rf"(?<![\w$.])({NAME})\s*=\s*(?:await\s+)?({NAME})\s*\(")
GIVEN = _rule(rf"(?<![\w$.])({NAME})\s*=(?![=>])\s*({PATH}){ENDS}")
TAKEN_APART = _rule(rf"({PATTERN})\s*=(?![=>])\s*({PATH})(\s*\()?")
CALLED = _rule(rf"(?<![\w$.])(?<!function\s)({NAME})\s*\(([^()]*+)\)")
ENTRIES = _rule(rf"(?:^|,)\s*{ENTRY}")
ENTRY_VALUE, LEADING, ALONE = _rule(r"[^:]*:\s*([\s\S]*)"), _rule(NAME), _rule(PATH)
# uses, each within a line
MEMBERS = _rule(rf"(?<![\w$.])({MEMBER})")
CALLED_WITH = _rule(rf"(?<![\w$.])({PATH}){GAP}*\({GAP}*[«‹]([0-9A-F]*)[»›]")
WHOLE = [
    (("...",), _rule(rf"\.\.\.{GAP}*({PATH}){ENDS}")), (("in", "of"), _rule(rf"(?:in|of)(?<!(?u:\w)in)(?<!(?u:\w)of){GAP}+({PATH}){ENDS}")),
    (("Object.",), _rule(rf"{EDGE}Object\.\w+{GAP}*\([^()\n]*?({PATH}){GAP}*[,)]")),
    (("Reflect.",), _rule(rf"{EDGE}Reflect\.(?:ownKeys|has){GAP}*\({GAP}*({PATH}){GAP}*[,)]")),
    (("[",), _rule(r"(?<![\w$.])" + rf"({PATH}){GAP}*\[{GAP}*(?![«‹ \t\f\v\r\]])")),
]
HEX = re.compile("[«‹]([0-9A-F]*)")


def _plain(code: str) -> str:
    found = HEX.search(code)
    return bytes.fromhex(found[1]).decode("utf-8", errors="replace") if found else ""


def canonical(code: str) -> str:
    """The spellings of one access as one: ``a['b']``, ``a?.b``, ``Reflect.get(a, 'b')`` and ``require('m')``."""
    if "require" in code:
        code = REQUIRED.sub(r"require«\1»", code)
    if "?." in code:
        code = OPTIONAL.sub(".", code)
    if "[" in code:
        code = INDEXED.sub(r".«\1»", code)
    if " ." in code or ". " in code or "\t." in code or ".\t" in code:
        code = DOTTED.sub(".", code)
    return REFLECTED.sub(r"\1.«\2»", code) if "Reflect" in code else code


def _entries(patterns: list[Pair]) -> Iterator[Pair]:
    """(name, path) for the entries of patterns given as (pattern, path): the name may be a pattern again."""
    for pattern, path in patterns:
        for entry in ENTRIES.findall(pattern[1:-1]):
            if entry.startswith("..."):
                yield entry[3:].strip(" "), f"{path}.*"
            else:
                value = ENTRY_VALUE.match(entry)
                key = entry.split(":", 1)[0].strip(" ").replace("‹", "«").replace("›", "«")
                yield value[1].strip(" ") if value else entry, f"{path}.{key}"


def _taken_apart(code: str) -> list[Pair]:
    """(name, path) of the names in patterns, down to patterns in patterns in patterns."""
    if "}" not in code or "=" not in code:
        return []
    level = [(m[1], m[2] + ("()" if m[3] else "")) for m in TAKEN_APART.finditer(code)]
    found: list[Pair] = []
    for _ in range(3):
        level = list(_entries(level))
        found += [pair for pair in level if not pair[0].startswith("{")]
        level = [pair for pair in level if pair[0].startswith("{")]
    return found


def _passed(code: str, functions: bool, arrows: bool) -> Iterator[Pair]:
    """(parameter, argument) by the name of the function and the position, whoever calls."""
    parameters = defaultdict(list)
    heads = DECLARED.findall(code) if functions else []
    if arrows:
        heads += ARROW.findall(code) + ARROW_OF_ONE.findall(code)
    for function, listed in heads:
        for place, text in enumerate(listed.split(",")):
            name = LEADING.match(text.strip(" "))
            if name:
                parameters[function, place].append(name[0])
    if not parameters:
        return
    called = {function for function, _ in parameters}
    for function, listed in CALLED.findall(code):
        if function in called:
            for place, text in enumerate(listed.split(",")):
                argument = text.strip(" ")
                if (function, place) in parameters and ALONE.fullmatch(argument):
                    for name in parameters[function, place]:
                        yield name, argument


def _links(code: str, entries: list[Pair]) -> Iterator[Pair]:
    """(name, path) wherever a name receives a path."""
    yield from entries
    functions, arrows = "function" in code, "=>" in code
    if "=" in code:
        yield from GIVEN.findall(code)
        for name, function in TAKEN.findall(code):
            yield name, f"{function}()"
    for rule in [RETURNED] * functions + [ARROW_RETURNED] * arrows:
        for function, path in rule.findall(code):
            yield f"{function}()", path
    if functions or arrows:
        yield from _passed(code, functions, arrows)


def _split(path: str) -> tuple[str, tuple[str, ...]]:
    """Base and properties of a path, properties in plain text."""
    base, *rest = path.split(".")
    return base, tuple(_plain(p) if p.startswith("«") else p for p in rest)


def _rooted(base: str) -> bool:
    return base == "process" or base in FS_NAMES or base.startswith("require«")


def _short(root: str, properties: tuple[str, ...]) -> bool:
    return len(properties) <= MOST_PROPERTIES and (root != "process" or not properties or properties[0] in ("env", "*"))


def closure(links: Iterator[Pair]) -> dict[str, set[tuple[str, tuple[str, ...]]]]:
    """The (root, properties) of every name that is known to hold a path of a root."""
    held: dict[str, set] = defaultdict(set)
    steps, fresh = defaultdict(set), []

    def meet(name: str, root: str, properties: tuple[str, ...]) -> None:
        if _short(root, properties) and (root, properties) not in held[name]:
            held[name].add((root, properties))
            fresh.append((name, root, properties))

    for name, path in links:
        base, properties = _split(path)
        if name == base:
            continue
        if _rooted(base):
            meet(name, base, properties)
        else:
            steps[base].add((name, properties))
    while fresh:
        name, root, properties = fresh.pop()
        for following, more in steps.get(name, ()):
            meet(following, root, properties + more)
    return held


def _uses(code: str, entries: list[Pair]) -> Iterator[tuple[int | None, str, str | None]]:
    """(place in the code, path, argument): paths in the code, and wildcards where a name is listed as a whole. Entries have no place."""
    if "." in code:
        for m in MEMBERS.finditer(code):
            yield m.start(1), m[1], None
    if "(" in code:
        for m in CALLED_WITH.finditer(code):
            yield m.start(1), m[1], m[2]
    for words, rule in WHOLE:
        if any(word in code for word in words):
            for m in rule.finditer(code):
                yield m.start(1), f"{m[1]}.*", None
    for _, path in entries:
        yield None, path, None


def _fact(root: str, properties: tuple[str, ...], argument: str | None) -> Pair | None:
    """What the use of a path of a root reads or writes."""
    if root == "process" and len(properties) > 1 and properties[0] == "env":
        return "env", properties[1]
    if argument is None or not (root in FS_NAMES or root.startswith("require«") and _plain(root) in FS_MODULES):
        return None
    if sum(p not in ("promises", "default") for p in properties) != 1:
        return None
    target, last = bytes.fromhex(argument).decode("utf-8", errors="replace"), properties[-1]
    if not 0 < len(target) < 512:
        return None
    return ("fs_write", target) if WRITES.search(last) else ("fs_read", target) if READS.search(last) else None


def flow_facts(code: str | None, text: str | None) -> list[Fact]:
    """(cap, key, line, snippet): what ``process``, required modules and names that stand for them read and write in one file.

    ``code`` is tokenised and folded. Entries of patterns are reported at line 1, and so are files.
    """
    if not code or not text or not any(word in text for word in ("process", "require", "fs")):
        return []
    code = canonical(code)
    if "process" not in code and "fs" not in code and "require«" not in code:
        return []
    entries = _taken_apart(code)
    held = closure(_links(code, entries))
    facts: dict[tuple[str, str, int], str] = {}
    breaks, raw = [], []
    for at, path, argument in _uses(code, entries):
        base = path.split(".", 1)[0]
        known = held.get(base) or (((base, ()),) if _rooted(base) else ())
        properties = _split(path)[1] if known else ()
        for root, before in known:
            found = _fact(root, before + properties, argument)
            if found is None:
                continue
            if not raw:
                raw, breaks = text.split("\n"), [m.start() for m in re.finditer("\n", code)]
            row = bisect_right(breaks, at) if at is not None else -1
            snippet = raw[row][:240].strip(" ") if 0 <= row < len(raw) else ""
            facts.setdefault((*found, row + 1 if found[0] == "env" and at is not None else 1), snippet)
    return [(*key, snippet) for key, snippet in facts.items()]
