"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Only DataFrame functions touch documents. What reaches the driver are counts by vote pattern and
by feature pattern; both have a fixed largest size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .spans import SPAN, let, overlaps, steps_of, with_matches

BASE = ("email", "ip", "card", "phone")
# The base patterns, with possessive quantifiers where giving back can't help, and
# starts limited to where a leftmost match can be.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Other spans that may be personal: names after a title, numbers of persons and accounts, local
#: phone numbers, and addresses spelt out.
EXTRA = {
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}\b",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20\p{Lu}\p{Ll}{1,30}(?:\x20\p{Lu}\p{Ll}{1,30})?",
    "spelt_email": r"\b[A-Za-z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,64}){1,4}",
}
LABELERS = ("regex", "gazetteer", "cue", "shape", "counter_cue")
# Gazetteers and cues.
MAIL_WORDS = "mail|gmail|hotmail|outlook|yahoo|post|web|example|proton|icloud"
GIVEN_NAMES = "james|mary|john|anna|robert|maria|michael|linda|david|peter|paul|laura|thomas|sarah|daniel|julia|marie|jose|hans|pierre"
CUES = "mail|e-mail|contact|phone|tel|call|fax|mobile|card|visa|credit|iban|account|ssn|passport|ip|address|host|from|to|dear|kontakt|adresse|teléfono|téléphone|telefon"
COUNTER_CUES = "version|release|section|chapter|isbn|issn|page|commit|build|equation|table|figure|no"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes(kind: Column, value: Column) -> Column:
    """The checks that the base kinds have beside their patterns."""
    digits = _digits(value)
    octet = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"
    return (
        F.when(kind == "ip", value.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(kind == "card", F.length(digits).between(16, 19) & F.call_function("luhn_check", digits))
        .when(kind == "phone", F.length(digits).between(8, 15))
        .otherwise(F.lit(True))
    )


def _votes(s: Column) -> list[Column]:
    """One vote of each labeler on a span: 1, -1, or 0 for none."""
    kind, value, before, after = s["kind"], F.lower(s["value"]), F.lower(s["before"]), s["after"]
    digits = _digits(value)
    n = F.length(digits)
    regex = F.when(kind.isin(*BASE), F.when(passes(kind, s["value"]), 1).otherwise(-1)).when(kind == "name", 0).otherwise(1)
    gazetteer = (
        F.when(kind.isin("email", "spelt_email"), F.when(value.rlike(MAIL_WORDS), 1).otherwise(0))
        .when(kind == "name", F.when(value.rlike(rf"\b(?:{GIVEN_NAMES})\b"), 1).otherwise(0))
        .when(kind == "card", F.when(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), 1).otherwise(-1))
        .when(kind == "ip", F.when(digits.rlike("^0"), -1).otherwise(0))
        .when(kind == "phone", F.when(digits.rlike("^(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"), 1).otherwise(-1))
        .otherwise(0)
    )
    cue = F.when(before.rlike(rf"(?:^|[^\p{{L}}])(?:{CUES})[^\p{{L}}0-9]*$"), 1).otherwise(0)
    shape = (
        F.when(kind == "card", F.when(value.rlike(r"^(?:[0-9]{16,19}|[0-9]{4}(?:[ -][0-9]{4}){3})$"), 1).otherwise(-1))
        .when(kind == "phone", F.when(n.between(10, 13), 1).otherwise(0))
        .when(kind == "ip", F.when(value.rlike(r"(?:^|\.)0[0-9]"), -1).otherwise(1))
        .when(kind == "email", F.when(value.rlike(r"\.[a-z]{2,8}$"), 1).otherwise(-1))
        .when(kind == "name", F.when(value.rlike(r" .* "), 1).otherwise(0))
        .when(kind == "local_phone", F.when(digits.rlike("^[2-9]"), 1).otherwise(-1))
        .when(kind == "national_id", F.when(digits.rlike("^(?:000|666|9)"), -1).otherwise(1))
        .otherwise(0)
    )
    counter = F.when(before.rlike(rf"(?:^|[^\p{{L}}])(?:{COUNTER_CUES})[^\p{{L}}0-9]*$") | after.rlike(r"^[\p{L}0-9_]"), -1).otherwise(0)
    return [regex, gazetteer, cue, shape, counter]


def _features(s: Column) -> list[Column]:
    """Small whole numbers that the span classifier sees."""
    length = F.length(s["value"])
    share = F.floor(4 * F.length(_digits(s["value"])) / F.greatest(length, F.lit(1))).cast("int")
    side = lambda x: F.when(x == "", 0).when(x.rlike(r"^\s$"), 1).when(x.rlike(r"^[\p{L}0-9_]$"), 2).otherwise(3)
    return [F.least(F.floor(length / 8), F.lit(5)).cast("int"), share, side(F.right(s["before"], F.lit(1))), side(F.left(s["after"], F.lit(1)))]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): all matches of all patterns, failing ones too, in order of kind and start."""
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = with_matches(df, "text", "email", PATTERNS["email"], 24, F.contains("text", F.lit("@")))
    df = with_matches(df, "text", "ip", PATTERNS["ip"], 24, F.col("text").rlike(r"[0-9]\.[0-9]"))
    df = with_matches(df, "text", "card", PATTERNS["card"], 24, F.col("text").rlike(r"[0-9][\x20-]?[0-9]"))
    df = with_matches(df, "text", "phone", PATTERNS["phone"], 24, F.contains("text", F.lit("+")))
    guards = {"iban": F.col("text").rlike("[A-Z]{2}[0-9]{2}"), "national_id": F.col("text").rlike("[0-9]-[0-9]"), "local_phone": F.col("text").rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), "name": F.col("text").rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\b"), "spelt_email": F.contains("text", F.lit("dot"))}
    for kind, pattern in EXTRA.items():
        df = with_matches(df, "text", kind, pattern, 24, guards[kind])
    # a run of digits that is too short to be a card is no candidate
    card = F.filter("card", lambda s: F.length(_digits(s["value"])) >= 12)
    return df.select("doc_id", F.concat("email", "ip", card, "phone", *sorted(EXTRA)).alias("spans"))


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> dict:
    """EM over (kind, votes, count): for each (kind, votes) the probability of being personal.

    Votes are independent given the truth; each labeler has its own rates of 1, -1 and none for
    true and for false spans, common to all kinds; each kind has its own prior."""
    kinds = sorted({k for k, _, _ in patterns})
    prior = {k: 0.5 for k in kinds}
    rate = [[{1: 0.6, 0: 0.3, -1: 0.1}, {1: 0.15, 0: 0.35, -1: 0.5}] for _ in LABELERS]
    sure: dict = {}
    for _ in range(rounds):
        for k, v, _ in patterns:
            yes, no = math.log(prior[k]), math.log(1 - prior[k])
            for j, x in enumerate(v):
                yes, no = yes + math.log(rate[j][0][x]), no + math.log(rate[j][1][x])
            sure[k, v] = 1 / (1 + math.exp(min(700, no - yes)))
        for k in kinds:
            own = [(sure[a, v], n) for a, v, n in patterns if a == k]
            prior[k] = (sum(p * n for p, n in own) + 1) / (sum(n for _, n in own) + 2)
        for j in range(len(LABELERS)):
            for side in (0, 1):
                weight = {x: 1.0 + 4 * (x == (1, -1)[side]) for x in (1, 0, -1)}
                for k, v, n in patterns:
                    weight[v[j]] += n * (sure[k, v] if side == 0 else 1 - sure[k, v])
                total = sum(weight.values())
                rate[j][side] = {x: w / total for x, w in weight.items()}
    return sure


def _fit(rows: list[tuple[tuple, float, float]]) -> dict:
    """Logistic regression on one-hot (place, value) features; rows: (features, positive, count)."""
    w: dict = {}
    total = sum(n for *_, n in rows) or 1
    for step in range(200):
        gradient: dict = {}
        for f, yes, n in rows:
            z = sum(w.get(x, 0.0) for x in f)
            e = n / (1 + math.exp(-max(-30.0, min(30.0, z)))) - yes
            for x in f:
                gradient[x] = gradient.get(x, 0.0) + e
        for x, g in gradient.items():
            w[x] = w.get(x, 0.0) * (1 - 1e-4) - 4 / (1 + step / 50) * g / total
    return w


def find(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end,value,p>>) for each row of docs, sorted by kind in
    the order of BASE and then the other kinds, then by start; `base` tells spans that pass the base
    rules, which always stay.

    A span that fails them, or of another kind, is taken if the classifier gives it at least
    `accept` and it overlaps no base span. A null text is empty. Without candidates there is nothing
    to learn and no spans."""
    found = materialise(candidates(docs), "pii-candidates")
    each = found.where(F.size("spans") > 0).select(F.explode("spans").alias("s"))
    names = [f"v{j}" for j in range(len(LABELERS))]
    marks = [f"f{j}" for j in range(4)]
    votes, marked = _votes(F.col("s")), _features(F.col("s"))
    counts = each.select(F.col("s")["kind"].alias("kind"), *[x.alias(n) for x, n in zip(votes + marked, names + marks, strict=True)]).groupBy("kind", *names, *marks).count().collect()  # at most some thousands of patterns
    by_votes: dict = {}
    for r in counts:
        key = (r["kind"], tuple(r[n] for n in names))
        by_votes[key] = by_votes.get(key, 0) + r["count"]
    sure = reliabilities([(k, v, n) for (k, v), n in sorted(by_votes.items())])
    rows: dict = {}
    for r in counts:
        f = ("bias", ("kind", r["kind"]), *[(n, r[n]) for n in names + marks])
        p = sure[r["kind"], tuple(r[n] for n in names)]
        yes, n = rows.get(f, (0.0, 0.0))
        rows[f] = (yes + p * r["count"], n + r["count"])
    weights = _fit([(f, yes, n) for f, (yes, n) in sorted(rows.items(), key=str)])

    def chance(s: Column) -> Column:
        z = F.lit(weights.get("bias", 0.0))
        for name, column in [("kind", s["kind"]), *zip(names + marks, _votes(s) + _features(s), strict=True)]:
            own = sorted((x[1], w) for x, w in weights.items() if x != "bias" and x[0] == name)
            term = F.lit(0.0)
            for value, w in own:
                term = F.when(column == value, w).otherwise(term)
            z = z + term
        return 1 / (1 + F.exp(-z))

    judged = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), chance(s).alias("p"), (s["kind"].isin(*BASE) & passes(s["kind"], s["value"])).alias("base")))
    out = found.withColumn("spans", F.when(F.size("spans") > 0, judged).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string,p:double,base:boolean>>")))
    def taken(spans: Column, steps: Column) -> Column:
        """steps: for each of BASE the steps of its base spans."""

        def free(s: Column) -> Column:
            return ~F.exists(steps, lambda own: overlaps(own, s["start"], s["end"]))

        return F.filter(spans, lambda s: s["base"] | ((s["p"] >= accept) & free(s)))

    def base_of(spans: Column, kind: str) -> Column:
        return steps_of(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind)))

    return out.select("doc_id", let(F.col("spans"), lambda spans: let(F.array(*[base_of(spans, kind) for kind in BASE]), lambda steps: taken(spans, steps))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


__all__ = ["BASE", "EXTRA", "PATTERNS", "SPAN", "candidates", "find", "joined", "passes", "reliabilities"]
