"""Personal data in whole texts by weak supervision, with SQL functions alone.

Candidates are the places of strict patterns (the base) and of loose ones that don't overlap them.
Five labelers vote yes, no or nothing on each: the strict pattern, a checksum or shape test, a
gazetteer, cue words before the place, and its borders. Over all documents the votes are counted by pattern of
votes and span features, a table whose size the labelers bound; expectation-maximisation on it estimates each
labeler's reliability by kind, and its posteriors are the soft labels from which a naive Bayes classifier over votes and
features is trained. Loose candidates that it takes are added; base ones always stay.

Loose patterns are obfuscated mail addresses, IPv6, national phone numbers, runs of 13 to 19 digits that the base's card rule
drops, and a kind of its own: secrets (keys, tokens and passwords with their values, and strings of the known shapes).

Both passes are scans without a shuffle of texts: places come from the lengths of the pieces between matches and
of the matches, in code points. Quantifiers are possessive and starts anchored, so no text takes
quadratic time in a pattern. Null and empty texts hold nothing; repeated rows are separate rows.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.llm.common import documents

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans that the method adds to those of the base.
MORE_KINDS = ("secret",)
ALL_KINDS = KINDS + MORE_KINDS
_MAIL = "A-Za-z0-9._%+-"
#: The base patterns. (?:\\G|(?<!...)) starts a match at a run's start or where the last one ended, which is where the leftmost lies.
STRICT = {
    "email": rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<![{_MAIL}])[{_MAIL}]++\x20?+[(\[]at[)\]]\x20?+[A-Za-z0-9-]++(?:(?:\.|\x20?+[(\[]dot[)\]]\x20?+)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "secret": r"(?<![A-Za-z0-9])(?:(?i:api[_-]?+key|access[_-]?+key|secret|token|passw(?:or)?+d|pwd)[\x20\"']{0,2}+[=:][\x20\"']{0,2}+[A-Za-z0-9+/_.-]{8,256}+|AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{36}(?![0-9A-Za-z])|[0-9a-f]{40}(?![0-9A-Za-z])|[0-9a-f]{64}(?![0-9A-Za-z]))",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+"}
TLDS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "co", "us")
CUES = {
    "email": r"(?i)mail|contact|reach|write|@",
    "ip": r"(?i)\bip\b|host|server|addr|login|client|from",
    "card": r"(?i)card|visa|master|amex|credit|debit|pay",
    "secret": r"(?i)key|secret|token|passw|pwd|auth|cred",
    "phone": r"(?i)phone|tel\b|tel[.:]|call|mobile|cell|fax|contact",
}
#: What a text must contain for the pattern of secrets to be tried.
SECRET = r"(?i:key|secret|token|passw|pwd)|AKIA|gh[pousr]_|[0-9a-f]{40}"
AGAINST = r"(?i)invoice|order|isbn|version|serial|token|hash|sku|part no"
LABELERS, BEFORE, ACCEPT = 5, 24, 0.9


def block_sums(lengths: Column, block: int = 64) -> Column:
    """The sums before every ``block``-th entry. It must stay a column of its own, read twice so that the optimiser keeps it so: within a lambda it would be computed for each entry."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int"))), lambda b: total(F.slice(lengths, b * block + 1, block)))
    return F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def offsets(lengths: Column, sums: Column, block: int = 64) -> Column:
    """The sums of all earlier entries, for each entry; blocks keep long arrays from quadratic work."""
    at = lambda i: F.floor(i / block).cast("int")
    return F.transform(lengths, lambda _, i: F.get(sums, at(i)) + F.aggregate(F.slice(lengths, at(i) * block + 1, i % block), F.lit(0), lambda s, x: s + x))


def places(frame: DataFrame, text: str, out: str, pattern: str, needed: Column | None = None) -> DataFrame:
    """Adds ``out``: the pattern's leftmost non-overlapping matches as (s, e, m, b, r): start and end in code points, the end exclusive, the match, and what stands before and after it up to the next match."""
    has = F.col(text).rlike(pattern) if needed is None else needed & F.col(text).rlike(pattern)
    frame = frame.withColumn(f"_{out}", F.when(has, F.struct(F.split(F.col(text), pattern, -1).alias("gaps"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("hits"))))
    gaps, hits = F.col(f"_{out}.gaps"), F.col(f"_{out}.hits")
    frame = frame.withColumn(f"_{out}n", F.transform(hits, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)))
    frame = frame.withColumn(f"_{out}b", F.when(F.size(f"_{out}n") > 0, block_sums(F.col(f"_{out}n"))))
    frame = frame.withColumn(f"_{out}a", F.when(F.size(f"_{out}b") > 0, offsets(F.col(f"_{out}n"), F.col(f"_{out}b"))))
    spot = lambda m, i: F.struct((F.get(F.col(f"_{out}a"), i) + F.length(F.get(gaps, i))).alias("s"), (F.get(F.col(f"_{out}a"), i) + F.get(F.col(f"_{out}n"), i)).alias("e"), m.alias("m"), F.right(F.get(gaps, i), F.lit(BEFORE)).alias("b"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("r"))
    empty = F.array().cast("array<struct<s:int,e:int,m:string,b:string,r:string>>")
    return frame.withColumn(out, F.coalesce(F.transform(hits, spot), empty)).drop(f"_{out}", f"_{out}n", f"_{out}a", f"_{out}b")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if a string of digits passes the Luhn test."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 1, twice(F.ascii(c) - 48)).otherwise(F.ascii(c) - 48))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def _octets(m: Column) -> Column:
    bare = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return F.length(digits(m)).between(16, 19) & luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(no if no is not None else ~yes, -1).otherwise(0)


def _judged(kind: str, x: Column, base: bool) -> Column:
    """A candidate with its votes and features."""
    m, before, left, right = x["m"], x["b"], F.right(x["b"], F.lit(1)), x["r"]
    value = F.regexp_extract(m, r"([A-Za-z0-9+/_.-]+)$", 1)
    shape = {"email": F.length(m).between(6, 80), "ip": F.lit(True), "card": F.length(digits(m)).between(15, 16), "phone": F.length(digits(m)).between(10, 15), "secret": value.rlike("[0-9]") & value.rlike("[A-Za-z]")}[kind]
    listed = {"secret": F.length(value).between(16, 128), "email": F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(*TLDS), "ip": ~m.rlike(r"^0+\."), "card": luhn(digits(m)) | m.rlike("^[2-6]"), "phone": m.rlike(r"^\+?[\x20(]?[1-9]")}[kind]
    # What fails the card list may still be a number of some issuer: no vote.
    votes = [F.lit(1 if base else 0), _vote(shape), _vote(listed, F.lit(False)) if kind == "card" else _vote(listed), _vote(before.rlike(CUES[kind]), before.rlike(AGAINST)), _vote(~left.rlike(r"[\p{L}\p{N}]") & ~right.rlike(r"[\p{L}\p{N}]"))]
    code = F.concat(*((v + 1).cast("string") for v in votes))
    features = F.concat(F.least(F.lit(9), F.floor(F.length(m) / 4)).cast("string"), F.when(left.rlike(r"^$|\s"), "s").otherwise("p"), F.when(right.rlike(r"^$|\s"), "s").otherwise("p"))
    return F.struct(F.lit(ALL_KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lit(base).alias("base"), code.alias("votes"), features.alias("features"))


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_base`` and ``_more``: arrays of (k, s, e, base, votes, features)."""
    docs = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    number = F.col("_t").rlike("[0-9][\\x20.:()-]{0,2}[0-9]")
    for kind in KINDS:
        docs = places(docs, "_t", f"_s{kind}", STRICT[kind], F.col("_t").contains(NEEDS[kind]) if kind in NEEDS else number)
    for kind in LOOSE:
        docs = places(docs, "_t", f"_l{kind}", LOOSE[kind], F.col("_t").rlike(r"(?:\(at\)|\[at\])") if kind == "email" else F.col("_t").rlike(SECRET) if kind == "secret" else number)
    valid = lambda kind: lambda x: _valid(kind, x["m"])
    judged = lambda kind, base: lambda x: _judged(kind, x, base)
    docs = docs.withColumn("_base", F.concat(*(F.transform(F.filter(f"_s{k}", valid(k)), judged(k, True)) for k in KINDS)))
    short = F.filter("_scard", lambda x: F.length(digits(x["m"])).between(13, 19) & ~_valid("card", x["m"]))
    more = F.concat(*(F.transform(F.col(f"_l{k}"), judged(k, False)) for k in LOOSE), F.transform(short, judged("card", False)))
    docs = docs.withColumn("_more", more).drop(*(f"_s{k}" for k in KINDS), *(f"_l{k}" for k in LOOSE))
    clear = F.filter("_more", lambda x: ~F.exists("_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return docs.withColumn("_more", F.when(F.size("_more") > 0, clear).otherwise(F.col("_more")))


def estimate(counts: list[tuple[int, str, str, int]], rounds: int = 30) -> dict[int, tuple[float, list[dict[str, float]], dict[str, float]]]:
    """By kind: prior odds, log ratios of each labeler's votes and of the features, from (kind, votes, features, n).

    Expectation-maximisation over two classes with labelers independent given the class, from the
    majority's vote; its posteriors then train the classifier over votes and features.
    """
    out = {}
    by_kind = defaultdict(list)
    for k, votes, features, n in counts:
        by_kind[k].append((votes, features, n))
    for k, rows in by_kind.items():
        total = sum(n for *_, n in rows)
        soft = [1 / (1 + math.exp(-sum(int(v) - 1 for v in votes))) for votes, *_ in rows]
        for _ in range(rounds):
            tables = [[{v: 1.0 for v in "012"} for _ in range(LABELERS)] for _ in range(2)]
            for (votes, _, n), p in zip(rows, soft, strict=True):
                for i, v in enumerate(votes):
                    tables[1][i][v] += n * p
                    tables[0][i][v] += n * (1 - p)
            prior = (sum(n * p for (*_, n), p in zip(rows, soft, strict=True)) + 1) / (total + 2)
            ratio = [{v: math.log(tables[1][i][v] / sum(tables[1][i].values())) - math.log(tables[0][i][v] / sum(tables[0][i].values())) for v in "012"} for i in range(LABELERS)]
            bias = math.log(prior / (1 - prior))
            # The strict pattern sees all base candidates alike; the others say how far loose ones are like them.
            soft = [1 / (1 + math.exp(-max(-40.0, min(40.0, bias + sum(ratio[i][v] for i, v in enumerate(votes)))))) for votes, *_ in rows]
        seen: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
        for (_, features, n), p in zip(rows, soft, strict=True):
            for i, f in enumerate(features):
                seen[f"{i}{f}"][0] += n * (1 - p)
                seen[f"{i}{f}"][1] += n * p
        sums = [sum(n * (1 - p) for (*_, n), p in zip(rows, soft, strict=True)) + 2, sum(n * p for (*_, n), p in zip(rows, soft, strict=True)) + 2]
        out[k] = (bias, ratio, {f: math.log(b / sums[1]) - math.log(a / sums[0]) for f, (a, b) in seen.items()})
    return out


def _score(model: dict, x: Column) -> Column:
    """The classifier's log odds that a loose candidate is personal data; the strict pattern's vote, always absent there, counts for nothing."""
    odds = F.lit(-99.0)
    for k, (bias, ratio, features) in sorted(model.items()):
        total = F.lit(bias)
        for i in range(1, LABELERS):
            total += F.element_at(F.create_map(*(F.lit(v) for pair in ratio[i].items() for v in pair)), F.substring(x["votes"], i + 1, 1))
        if features:
            table = F.create_map(*(F.lit(v) for pair in sorted(features.items()) for v in pair))
            for i in range(3):
                total += F.coalesce(F.try_element_at(table, F.concat(F.lit(str(i)), F.substring(x["features"], i + 1, 1))), F.lit(0.0))
        odds = F.when(x["k"] == k, total).otherwise(odds)
    return odds


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added) for each row: n_added are those that the method adds to the base."""
    met = candidates(docs.select(key, text), text)
    counted = met.select(F.explode(F.concat("_base", "_more")).alias("x")).groupBy("x.k", "x.votes", "x.features").count()
    model = estimate([tuple(r) for r in counted.collect()])  # at most 5 * 3^5 * 40 rows
    taken = F.filter("_more", lambda x: _score(model, x) >= math.log(accept / (1 - accept))) if model else F.col("_more")
    met = met.withColumn("_added", F.when(F.size("_more") > 0, taken).otherwise(F.col("_more")))
    name = F.array(*map(F.lit, ALL_KINDS))

    def joined(spans: Column) -> Column:
        ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
        return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")

    of = lambda i: lambda x: x["k"] == i
    n = [F.size(F.filter("_base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return met.select(key, *n, F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.concat("_base", "_added")).alias("spans"), F.size(F.concat("_base", "_added")).cast("long").alias("n_spans"), F.size("_added").cast("long").alias("n_added"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(documents(spark, sf_dir))


QUERIES = {"op4_personal_data": op4_personal_data}
SQL: dict[str, str] = {}
