"""Personal data by weak supervision (operator 3), with DataFrame functions only.

Base spans come from one fixed pattern for each kind and a check of the match. Loose patterns add candidates: spelled-out
addresses, local phone numbers, cards with other separators, version 6 addresses. Labelers vote on every candidate: the
form of the match, a gazetteer (domain endings, issuer digits, address ranges), words before it, and signs around it.
Votes and features are categories, so counting the candidates of all documents by category gives a table of bounded size.
On it expectation-maximisation estimates how reliable each labeler is, and a logistic span classifier is trained on the
estimated probabilities. Candidates that the classifier accepts and that meet no base span of their kind are added.

Matches are marked in the text with a control sign and the text is cut there, so a match's place is the sum of the
lengths before it, in code points. Patterns use possessive repeats and look behind for run starts: they stay linear on
long runs and do not recurse.

Defined results: null and empty texts have no spans (and the digest of the empty string). Places are code points, ends
exclusive. Rows that repeat an id are searched one by one, a null id is kept, other columns are ignored. An empty table
gives an empty result. Everything happens within a row, so neither copies nor frequent values gather in a task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import Scratch, read

KINDS = ("email", "ip", "card", "phone")
#: The base patterns in Java's syntax: fixed values of the contract, repeats made possessive where nothing can be given back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+(?:\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]{2,63}+(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\.)\x20?[A-Za-z0-9-]{2,63}+){1,4}+|\x20at\x20[A-Za-z0-9-]{2,63}+(?:\x20dot\x20[A-Za-z0-9-]{2,63}+){1,4}+)",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){2}[./_][0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
}
#: A cheap test that a match needs; texts that fail it are not searched.
NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: F.contains(t, F.lit("+")),
    "loose email": lambda t: t.rlike(r"[\[({\x20]at[\])}\x20]"), "loose ip": lambda t: t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]"),
    "loose card": lambda t: t.rlike(r"[0-9]{4}[./_][0-9]{4}"), "loose phone": lambda t: t.rlike(r"[0-9]{3}[)]?[.\x20-][0-9]{3}[.\x20-][0-9]{4}"),
}
CONTEXT = {
    "email": r"(?i)(mail|contact|write|reach|e-?post|courriel|correo|an|to)\W{0,3}$",
    "ip": r"(?i)\b(ip|host|server|address|addr|from|node)\W{0,3}$",
    "card": r"(?i)(card|visa|master|amex|karte|carte|tarjeta|cc|payment)\W{0,3}(no|number|nr)?\W{0,3}$",
    "phone": r"(?i)(phone|tel|call|mobile|cell|fax|whatsapp|ring|sms)\.?\W{0,3}$",
}
GAZETTEER = {
    "email": r"(?i)(com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl)$",
    "ip": r"^(?!0|127\.|22[4-9]|2[3-5][0-9])",
    "card": r"^(3[0-9]|4|5[0-9]|6)",
    "phone": r"^(\+[1-9]|\(?[2-9][0-9]{2}\D{1,2}[2-9])",
}
VOTES = ("form", "gazetteer", "before", "around")
FEATURES = ("loose", "left", "right", "length")
MARK = "\u0001"
ACCEPT = 0.9
EDGE = 24
CHUNK = 128


def _starts(sizes: Column) -> Column:
    """Running sums before each element, in two levels so that long arrays cost little more than their length."""
    chunk = lambda c: F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK))
    none = F.array().cast("array<int>")
    chunks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int"))

    def before(values: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), none.alias("all"))
        return F.aggregate(values, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])

    totals = F.transform(chunks, lambda c: F.aggregate(chunk(c), F.lit(0), lambda a, x: a + x))
    return F.flatten(F.transform(before(totals, F.lit(0)), lambda base, c: before(chunk(c), base)))


def _located(frame: DataFrame, name: str, pattern: str, loose: bool) -> DataFrame:
    """Adds `name`: the matches as (s, e, value, left, right, loose), by marking and cutting the text."""
    kind = name.removeprefix("loose ")
    marked = F.regexp_replace("text", f"({pattern})", f"{MARK}$1{MARK}")
    frame = frame.withColumn("pieces", F.when(NEEDS[name](F.col("text")), F.split(marked, MARK)))
    frame = frame.withColumn("sizes", F.transform("pieces", F.length)).withColumn("starts", F.when(F.size("pieces") > 1, _starts(F.col("sizes"))))
    match = lambda i: F.struct(
        F.get("starts", i).alias("s"), (F.get("starts", i) + F.get("sizes", i)).alias("e"), F.get("pieces", i).alias("value"),
        F.right(F.get("pieces", i - 1), F.lit(EDGE)).alias("left"), F.left(F.get("pieces", i + 1), F.lit(1)).alias("right"),
        F.lit(loose).alias("loose"), _valid(kind, F.get("pieces", i)).alias("valid"),
    )
    found = F.when(F.size("pieces") > 1, F.transform(F.sequence(F.lit(1), F.size("pieces") - 2, F.lit(2)), match))
    empty = F.array().cast("array<struct<s:int,e:int,value:string,left:string,right:string,loose:boolean,valid:boolean>>")
    return frame.withColumn(name, F.coalesce(found, empty)).drop("pieces", "sizes", "starts")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the checksum: from the right every second one doubled, less 9 above 9."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(digit > 9, digit - 9).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    if kind == "ip":
        return value.rlike(rf"^(?:{part}\.){{3}}{part}$") | value.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id with, for each kind, `kind` (valid base matches) and `loose kind` (candidates for the method)."""
    frame = documents.select("doc_id", F.translate(F.coalesce("text", F.lit("")), MARK, "\u0002").alias("text"))
    for kind in KINDS:
        frame = _located(frame, kind, BASE[kind], False)
        frame = _located(frame, f"loose {kind}", LOOSE[kind], True)
    meets = lambda kind: lambda c: ~F.exists(kind, lambda b: b["valid"] & (b["s"] < c["e"]) & (c["s"] < b["e"]))
    return frame.select("doc_id", *(F.filter(k, lambda m: m["valid"]).alias(k) for k in KINDS), *(F.filter(f"loose {k}", meets(k)).alias(f"loose {k}") for k in KINDS))


def _edge(sign: Column) -> Column:
    return F.when(sign == "", "none").when(sign.rlike(r"\s"), "space").when(sign.rlike("[A-Za-z0-9]"), "word").otherwise("sign")


def categories(kind: str, c: Column) -> dict[str, Column]:
    """Votes (1, 0 or -1) and features of a candidate."""
    left, right = _edge(F.right(c["left"], F.lit(1))), _edge(c["right"])
    flag = lambda test, no=-1: F.when(test, 1).otherwise(no)
    bad = (left == "word") | (right == "word") | c["left"].rlike(r"(?i)(\bv|version|order|invoice|id|#|=)\W{0,2}$")
    form = flag(c["valid"]) if kind in ("ip", "card") else F.when(~c["valid"], -1).when(c["loose"], 0).otherwise(1)
    return {
        "form": form, "gazetteer": flag(c["value"].rlike(GAZETTEER[kind])), "before": flag(c["left"].rlike(CONTEXT[kind]), 0), "around": flag(bad, 0) * -1,
        "loose": c["loose"].cast("string"), "left": left, "right": right, "length": F.least(F.lit(5), F.floor(F.length(c["value"]) / 8)).cast("string"),
    }


def count_cells(found: DataFrame) -> list[tuple[str, tuple, int]]:
    """(kind, categories, candidates) over all documents: at most a few thousand rows by construction, whatever the input."""
    parts = None
    for kind in KINDS:
        each = found.select(F.explode(F.concat(kind, f"loose {kind}")).alias("c"))
        each = each.select(F.lit(kind).alias("kind"), *(v.alias(n) for n, v in categories(kind, F.col("c")).items()))
        parts = each if parts is None else parts.union(each)
    rows = parts.groupBy("kind", *VOTES, *FEATURES).agg(F.count("*").alias("n")).collect()
    return sorted(((r["kind"], tuple(r[c] for c in (*VOTES, *FEATURES)), r["n"]) for r in rows), key=repr)


def expectation_maximisation(cells: list[tuple[tuple, int]], rounds: int = 50) -> tuple[list[dict[int, tuple[float, float]]], list[float]]:
    """Chances of each labeler's votes for (not personal, personal), and each cell's probability. A zero abstains."""
    weights = np.array([n for _, n in cells], float)
    votes = np.array([c[: len(VOTES)] for c, _ in cells], float)
    chance = 1 / (1 + np.exp(-votes.sum(axis=1)))  # the majority to begin with
    reliability: list[dict[int, tuple[float, float]]] = []
    for _ in range(rounds):
        prior = np.clip((weights * chance).sum() / weights.sum(), 0.02, 0.98)
        reliability = []
        for k in range(len(VOTES)):
            table = {}
            for vote in (-1, 0, 1):
                hit = votes[:, k] == vote
                # the pseudo-counts say that labelers beat chance: they agree with the truth three times in four
                lean = {1: (1.0, 3.0), -1: (3.0, 1.0), 0: (2.0, 2.0)}[vote]
                table[vote] = tuple((lean[y] + (weights * p)[hit].sum()) / (6.0 + (weights * p).sum()) for y, p in enumerate((1 - chance, chance)))
            reliability.append(table)
        log = np.full(len(cells), math.log(prior / (1 - prior)))
        for k in range(len(VOTES)):
            for vote in (-1, 1):
                no, yes = reliability[k][vote]
                log[votes[:, k] == vote] += math.log(yes / no)
        updated = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        if np.abs(updated - chance).max() < 1e-6:
            break
        chance = updated
    return reliability, chance.tolist()


def train(cells: list[tuple[str, tuple, int]], decay: float = 1.0) -> dict[str, list[tuple[str, object, float]]]:
    """For each kind the classifier: (column, category, weight) with ("", None, intercept), fitted to EM's probabilities."""
    models = {}
    for kind in KINDS:
        own = [(c, n) for k, c, n in cells if k == kind]
        if not own:
            continue
        _, chance = expectation_maximisation(own)
        names = sorted({(column, c[i]) for c, _ in own for i, column in enumerate((*VOTES, *FEATURES))}, key=repr)
        x = np.array([[float(c[(*VOTES, *FEATURES).index(column)] == value) for column, value in names] + [1.0] for c, _ in own])
        y, n = np.array(chance), np.array([n for _, n in own], float)
        n = n / n.sum() * min(n.sum(), 1e6)
        w, keep = np.zeros(x.shape[1]), np.diag([decay] * x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + keep, x.T @ (n * (y - p)) - keep @ w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        models[kind] = [(column, value, float(v)) for (column, value), v in zip(names, w)] + [("", None, float(w[-1]))]
    return models


def probability(kind: str, c: Column, model: list[tuple[str, object, float]]) -> Column:
    columns = categories(kind, c)
    total = F.lit(0.0)
    for column, value, weight in model:
        total = total + (F.lit(weight) if not column else F.when(columns[column] == F.lit(value), weight).otherwise(0.0))
    return 1 / (1 + F.exp(-total))


def _text_of(spans: Column) -> Column:
    """kind:start:end by start and kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1), s["s"].cast("string"), s["e"].cast("string"))), ",")


def label(found: DataFrame, models: dict[str, list[tuple[str, object, float]]]) -> DataFrame:
    """Counts, digest and spans of each document from its candidates."""
    place = lambda k: lambda c: F.struct(c["s"].alias("s"), F.lit(k).alias("k"), c["e"].alias("e"))
    base = F.concat(*(F.transform(kind, place(i)) for i, kind in enumerate(KINDS)))
    accepted = lambda kind: lambda c: c["valid"] & (probability(kind, c, models[kind]) >= ACCEPT)
    added = [F.transform(F.filter(f"loose {kind}", accepted(kind)), place(i)) for i, kind in enumerate(KINDS) if kind in models]
    frame = found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), base.alias("base"), F.concat(base, *added).alias("all"))
    return frame.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.col("all")).alias("spans"))


def find_personal_data(documents: DataFrame, scratch: Scratch) -> DataFrame:
    found = scratch.cut(candidates(documents), "candidates")
    return label(found, train(count_cells(found)))


def label_documents(spark, sf_dir: str) -> DataFrame:
    """Query op3_pii: personal data of every document."""
    return find_personal_data(read(spark, sf_dir, "documents"), Scratch(spark, "pii"))
