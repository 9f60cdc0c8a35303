"""Personal data: base patterns, and more candidates judged by gradient-boosted trees.

Four base patterns give spans that always stay. Several wider generators a kind then propose
overlapping candidates in forms the base patterns miss (spelled-out, spaced or bracketed e-mail
addresses, defanged IP addresses, numbers with other separators or without a country code, cards
among other digits). Boosted trees score each candidate from its format and the words around it;
of those above their kind's threshold, set on held-out examples for precision, the best of each
overlap is added. Everything a text goes through is DataFrame expressions; nothing is shuffled.

The trees are fitted here on examples that a seeded rule writes, whose number is a parameter; the
examples go through the same expressions as the texts. Base patterns are written so that Java's
regex engine neither backtracks nor recurses on long runs; they find the same leftmost matches.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import free_names

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a base pattern or a generator to be worth running.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
AT = r"(?:\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?|\x20(?:at|AT)\x20|@)"
DOT = r"(?:\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)"
END = r"(?![0-9])"
#: Several generators a kind; what they propose may overlap.
WIDE = {
    "email": (rf"(?<![{LOCAL}])[{LOCAL}]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++){{1,4}}",
              rf"(?<![{LOCAL}])[{LOCAL}]++\x20?@\x20?[A-Za-z0-9-]++(?:\x20?\.\x20?[A-Za-z0-9-]++){{1,3}}"),
    "ip": (rf"(?<![0-9.])[0-9]{{1,3}}+(?:\x20?[\[(]?\.[\])]?\x20?[0-9]{{1,3}}+){{3}}{END}",
           rf"(?<![0-9.])[0-9]{{1,3}}+(?:\x20?[\[({{]?(?:dot|DOT)[\])}}]?\x20?[0-9]{{1,3}}+){{3}}{END}"),
    "card": (rf"(?<![0-9])[0-9]{{4}}+(?:[\x20./_-]{{0,3}}[0-9]{{3,6}}+){{2,4}}{END}",
             rf"(?<![0-9])[0-9]{{12,19}}+{END}",
             rf"(?<![0-9])[0-9]{{4}}+(?:[\x20./_-][0-9]{{4}}+){{3}}{END}"),
    "phone": (r"(?<![0-9A-Za-z.])(?:\([0-9]{2,4}\)|[0-9]{2,5}+)(?:[\x20./-]{1,2}[0-9]{2,5}+){1,4}(?![0-9A-Za-z])",
              rf"(?<![0-9A-Za-z+])00[0-9]{{1,3}}+(?:[\x20()./-]{{1,3}}[0-9]{{2,5}}+){{2,4}}{END}",
              rf"\+[0-9]{{1,3}}+(?:[\x20\xa0()./-]{{1,3}}[0-9]{{2,5}}+){{2,4}}{END}"),
}
WIDE_HINTS = {"email": r"(?i)@|[\[({\x20]at[\])}\x20]", "ip": r"(?i)[0-9]\x20?[\[({]?(?:\.|dot)[\])}]?\x20?[0-9]", "card": r"[0-9]{4}[\x20./_-]{0,3}[0-9]{3}", "phone": r"[0-9]\)?[\x20\xa0./-]{1,2}\(?[0-9]"}
GOOD_WORDS = {"email": r"(?i)mail|contact|write|reach", "ip": r"(?i)\bip\b|host|server|address|login", "card": r"(?i)card|visa|credit|pay", "phone": r"(?i)phone|tel|call|mobile|fax"}
BAD_WORDS = r"(?i)order|invoice|isbn|version|page|item|ref|serial|date|build|score|section|room|€|\$|#|\bv$"
TLD = r"(?i)[^A-Za-z](?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|eu)$"

ROUNDS, RATE, EXAMPLES, PRECISION = 40, 0.3, 3000, 0.99
FEATURES = ("kind", "digits", "groups", "longest", "shortest", "length", "brackets", "luhn", "good", "bad", "octets", "spelled", "first_group", "lead", "even", "spaces", "tld", "plus")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


SPAN = "array<struct<s:int,e:int,v:string,before:string,after:string>>"


def spans(text: Column, pattern: str, hint: str) -> Column:
    """Leftmost non-overlapping matches: start and end in code points, the match, and what stands around it."""
    worth = F.contains(text, F.lit(hint)) if hint == "@" else text.rlike(hint)
    # the lengths of what lies between matches give their places
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def step(acc: Column, i: Column, x: Column) -> Column:
        s = acc["p"] + F.length(F.get(x["g"], i))
        e = s + F.length(F.get(x["m"], i))
        one = F.struct(s.alias("s"), e.alias("e"), F.get(x["m"], i).alias("v"), F.right(F.get(x["g"], i), F.lit(24)).alias("before"), F.left(F.get(x["g"], i + 1), F.lit(8)).alias("after"))
        return F.struct(e.alias("p"), F.array_append(acc["o"], one).alias("o"))

    none = F.array().cast(SPAN)
    found = let(both, lambda x: F.when(F.size(x["m"]) > 0, F.aggregate(
        F.sequence(F.lit(0), F.size(x["m"]) - 1), F.struct(F.lit(0).alias("p"), none.alias("o")), lambda a, i: step(a, i, x), lambda a: a["o"])).otherwise(none))
    return F.when(worth, found).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    own = F.transform(F.split(F.reverse(number), ""), lambda d, i: let(d.try_cast("int") * (i % 2 + 1), lambda x: x - F.when(x > 9, 9).otherwise(0)))
    return F.aggregate(own, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def octets(value: Column) -> Column:
    return F.forall(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255))


def valid(kind: str, value: Column) -> Column:
    """The checks that a match of a base pattern must pass."""
    if kind == "ip":
        return octets(value)
    if kind == "card":
        return let(digits(value), lambda d: F.length(d).between(12, 19) & luhn(d))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans as array of (s, k, e), k the place of the kind in KINDS."""

    def of(k: int, kind: str) -> Column:
        kept = F.filter(spans(text, BASE[kind], HINTS[kind]), lambda x: valid(kind, x["v"]))
        return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def features(kind: str, x: Column) -> Column:
    """Format and context features of a candidate, as a struct of FEATURES."""
    groups = F.regexp_extract_all(x["v"], F.lit("[0-9]+"), F.lit(0))
    sizes = F.transform(groups, lambda g: F.length(g))
    flag = lambda c: F.when(c, 1).otherwise(0)
    return F.struct(*[v.cast("int").alias(n) for n, v in zip(FEATURES, (
        F.lit(KINDS.index(kind)), F.length(digits(x["v"])), F.size(groups), F.coalesce(F.array_max(sizes), F.lit(0)), F.coalesce(F.array_min(sizes), F.lit(0)), F.length(x["v"]),
        flag(x["v"].rlike(r"[\[({]")), flag(luhn(digits(x["v"]))), flag(x["before"].rlike(GOOD_WORDS[kind])), flag(F.concat(x["before"], F.lit(" "), x["after"]).rlike(BAD_WORDS)),
        flag(octets(x["v"])), flag(x["v"].rlike(r"(?i)\bdot\b")), F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)),
        F.coalesce(F.left(digits(x["v"]), F.lit(2)).try_cast("int"), F.lit(0)), F.size(F.array_distinct(F.regexp_extract_all(x["v"], F.lit(r"[0-9]([^0-9]+)[0-9]"), F.lit(1)))),
        F.regexp_count(x["v"], F.lit(r"\x20")), flag(x["v"].rlike(TLD)), flag(x["v"].rlike(r"^(?:\+|00)"))))])


def candidates(text: Column) -> Column:
    """What the generators propose, as array of (s, k, e, f)."""

    def of(k: int, kind: str, pattern: str) -> Column:
        return F.transform(spans(text, pattern, WIDE_HINTS[kind]),
                           lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), features(kind, x).alias("f")))

    return F.array_distinct(F.concat(*[of(k, kind, p) for k, kind in enumerate(KINDS) for p in WIDE[kind]]))


def examples(number: int = EXAMPLES, seed: int = 7) -> list[tuple[str, int]]:
    """(text, 1 if what the generators find in it is personal data) written by a seeded rule."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 8)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = "4" + num(14)
        total = sum((d if i % 2 else d * 2 - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def group(s: str, sep: str) -> str:
        return sep.join(s[i : i + 4] for i in range(0, 16, 4))

    out = []
    for _ in range(number):
        good, kind = rng.random() < 0.5, rng.choice(KINDS)
        lead = {"email": ("mail me: ", "contact "), "ip": ("host ", "server ip "), "card": ("visa card ", "credit "), "phone": ("call ", "phone ", "tel. ")}[kind]
        before = rng.choice([*lead, word() + " ", "the "]) if good else rng.choice(["order ", "invoice #", "version ", "page ", "isbn ", "date ", "section ", word() + " ", "the "])
        if kind == "email":
            at, dot = rng.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), ("(@)", "."), ("[@]", "[.]"), ("@", " [dot] "), ("@", "(dot)"), ("@", " dot "), (" @ ", "."), ("@ ", " . "), (" @ ", " . ")])
            tld = rng.choice(["com", "org", "net", "de", "fr", "io"])
            text = word() + rng.choice(["", "." + word(), num(2)]) + at + word() + dot + tld if good else word() + rng.choice([" at ", " @ ", " at the "]) + word() + rng.choice([". ", "."]) + word()
        elif kind == "ip":
            parts = [str(rng.randint(1, 255)) for _ in range(4)] if good else [str(rng.choice([rng.randint(0, 9), rng.randint(256, 999)])) for _ in range(4)]
            text = rng.choice(["[.]", "(.)", " dot ", "[dot]"] if good else [". ", " . ", ".", "[.]", " dot "]).join(parts)
            if not good and all(int(x) <= 255 for x in parts):
                text = text.replace("[.]", ". ").replace(" dot ", ". ")
        elif kind == "card":
            if good:
                number_ = card()
                text = rng.choice([group(number_, rng.choice([".", "/", "_", " - ", " / "])), f"{card()} {number_}", f"{number_} {card()}"])
            else:
                text = rng.choice([group("9" + num(15), rng.choice([".", "/"])), num(4) + "/" + num(3) + "/" + num(4), num(13), "0" + num(15), f"{rng.choice('12789')}{num(15)} {rng.choice('12789')}{num(15)}", num(20), f"{num(5)} {num(16)} {num(7)}"])
        else:
            text = rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{rng.randint(2, 9)}{num(2)}-{num(3)}-{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"0{num(2)}.{num(3)}.{num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(3)}", f"+{num(2)}/{num(3)}/{num(6)[:5]}", f"+{num(2)}\xa0{num(3)}\xa0{num(4)}"]) if good else rng.choice(
                [f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(2)} {num(3)}", f"{num(5)} {num(5)} {num(5)}", f"{num(2)} {num(2)} {num(2)}", f"{num(4)} {num(4)}", f"{num(2)}.{num(3)}.{num(3)}.{num(2)}"])
        out.append((f"{word()} {before}{text} {word()}", int(good)))
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list[tuple]]:
    """Logistic gradient boosting with trees of depth 2: a start and trees (feature, cut, left, right).

    left and right are (feature, cut, value if at most the cut, value if above).
    """
    def best(at: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
        top = (-1.0, 0, 0.0)
        for j in range(x.shape[1]):
            for cut in np.unique(x[at, j])[:-1]:
                left = x[at, j] <= cut
                gl, hl, gs, hs = g[at][left].sum(), h[at][left].sum(), g[at].sum(), h[at].sum()
                gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
                top = max(top, (gain, j, float(cut)))
        return top

    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    s, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-s))
        g, h = y - p, p * (1 - p)
        _, j, cut = best(np.arange(len(y)), g, h)
        halves = []
        for at in (np.nonzero(x[:, j] <= cut)[0], np.nonzero(x[:, j] > cut)[0]):
            _, k, c = best(at, g, h) if len(at) else (0, 0, 0.0)
            values = []
            for leaf in (at[x[at, k] <= c], at[x[at, k] > c]):
                values.append(rate * float(g[leaf].sum() / (h[leaf].sum() + 1)))
                s[leaf] += values[-1]
            halves.append((k, c, *values))
        trees.append((j, cut, *halves))
    return start, trees


def tree_score(f: Column, model: tuple[float, list[tuple]]) -> Column:
    """The trees as nested conditions over the feature struct."""
    def half(k: int, c: float, low: float, high: float) -> Column:
        return F.when(f[FEATURES[k]] <= c, low).otherwise(high)

    total = F.lit(model[0])
    for j, cut, left, right in model[1]:
        total = total + F.when(f[FEATURES[j]] <= cut, half(*left)).otherwise(half(*right))
    return total


def apply_trees(x: np.ndarray, model: tuple[float, list[tuple]]) -> np.ndarray:
    half = lambda k, c, low, high: np.where(x[:, k] <= c, low, high)
    return model[0] + sum(np.where(x[:, j] <= cut, half(*a), half(*b)) for j, cut, a, b in model[1])


def train(spark: SparkSession, number: int = EXAMPLES, precision: float = PRECISION, seed: int = 7) -> tuple[tuple, list[float]]:
    """The trees and a threshold a kind (on the log-odds scale), fitted on ``number`` written examples.

    Two thirds fit the trees; the rest set each kind's lowest threshold with that precision.
    """
    made = examples(number, seed)
    text = F.explode(F.split(F.lit("\n".join(f"{label}{t}" for t, label in made)), "\n"))
    rows = spark.range(1).select(text.alias("t")).select(F.left("t", F.lit(1)).cast("int").alias("y"), F.explode(candidates(F.expr("substring(t, 2)"))).alias("c"))
    got = rows.select("y", "c.f.*").collect()  # as many rows as examples, about
    x = np.array([[r[n] for n in FEATURES] for r in got], float)
    y = np.array([r["y"] for r in got], float)
    held = np.random.default_rng(seed).random(len(y)) < 1 / 3
    model = boost(x[~held], y[~held])
    s, limits = apply_trees(x[held], model), []
    for k in range(len(KINDS)):
        own = x[held, 0] == k
        order = np.argsort(-s[own], kind="stable")
        right, scores = np.cumsum(y[held][own][order]), s[own][order]
        good = [c for i, c in enumerate(scores) if right[i] >= precision * (i + 1) and (i + 1 == len(scores) or scores[i + 1] < c)]
        limits.append(float(min(good)) if good else 1e9)
    return model, limits


def find(docs: DataFrame, model: tuple, limits: list[float], base: str = "base", found: str = "found") -> DataFrame:
    """``docs`` with ``base`` and ``found``: arrays of (s, k, e) in code points, by start, then kind.

    ``found`` holds the base spans and, best score first, every candidate above its kind's threshold
    that overlaps no base span nor a better one. Null and empty texts have no spans; repeated rows
    give the same spans each; columns named ``base`` or ``found`` are replaced, others stay as they
    are; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    limit = F.array(*[F.lit(x) for x in limits])
    wide, = free_names(docs.withColumns({base: F.lit(0), found: F.lit(0)}), "wide")
    out = docs.withColumns({base: base_spans(text), wide: candidates(text)})
    overlap = lambda x, y: (x["s"] < y["e"]) & (y["s"] < x["e"])
    scored = F.transform(wide, lambda x: F.struct((-tree_score(x["f"], model)).alias("c"), x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    scored = F.array_sort(F.filter(scored, lambda x: (-x["c"] >= F.get(limit, x["k"])) & ~F.exists(base, lambda b: overlap(x, b))))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    added = F.aggregate(scored, none, lambda a, x: F.when(F.exists(a, lambda y: overlap(x, y)), a).otherwise(
        F.array_append(a, F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))))
    return out.withColumn(found, F.when(F.size(wide) > 0, F.array_sort(F.concat(base, added))).otherwise(F.col(base))).drop(wide)


def written(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, model: tuple, limits: list[float]) -> DataFrame:
    """The documents with every found span replaced by its kind in brackets; null text stays null, all other columns as they were."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    base, found = free_names(docs, "base", "found")
    out = find(docs, model, limits, base, found)
    cut = F.aggregate(found, F.struct(F.lit(0).alias("p"), F.lit("").alias("t")), lambda a, x: F.when(x["s"] < a["p"], a).otherwise(F.struct(
        x["e"].alias("p"), F.concat(a["t"], F.substring(F.col("text"), a["p"] + 1, x["s"] - a["p"]), F.get(names, x["k"])).alias("t"))),
        lambda a: F.concat(a["t"], F.substring(F.col("text"), a["p"] + 1, F.length("text"))))
    return out.withColumn("text", F.when(F.size(found) > 0, cut).otherwise(F.col("text"))).select(*docs.columns)
