"""Secret scans: candidates of several kinds, judged by a random forest.

Only DataFrame functions touch documents. The forest is grown level by level from counts of
labelled findings by tree, node, feature and value; these counts, of a fixed largest size, are all
that reaches the driver. The grown trees are one SQL expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .spans import with_matches

#: Kinds of candidates: signed web tokens and long runs of letters and digits; private key blocks;
#: user:password in addresses; short values that are assigned to a name of a secret.
PATTERNS = {
    "token": r"(?<![A-Za-z0-9_+/-])(?:eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]{4,}+|[A-Za-z0-9_+/-]{16,}+={0,2}+)",
    "private_key": r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----[^-]*+(?:-----END (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----)?+",
    "address": r"(?<=://)[^\s/:@]{1,64}+:[^\s/@]{3,128}+(?=@)",
    "assigned": r"""(?<=(?:password|passwd|pwd|secret|PASSWORD|SECRET|Password)[ ]{0,2}[=:][ ]{0,2}["']?)[^\s"',;=:<>]{6,15}+(?![^\s"',;])""",
}
TREES, LEVELS, BINS = 12, 5, 8
FINDINGS = 6000  # labelled findings that are made if none are given
# Dictionary pieces, cues, prefixes.
PIECES = "the|and|ing|ion|tion|ent|ment|able|with|for|that|this|from|over|under|user|name|file|data|test|code|page|line|word|list|item|view|node|main|home|image|index|value|table|class|example|config|system|server|client|service|version|default|content|document|function|number|string|time|date"
CUES = "api|apikey|key|token|secret|password|passwd|pwd|auth|bearer|credential|credentials|private"
COUNTER_CUES = "commit|sha|sha1|sha256|md5|checksum|digest|uuid|guid|version|revision|example|sample|integrity|etag"
PREFIXES = "AKIA|ASIA|ghp_|gho_|sk_live|sk-|xox[abprs]-|AIza|glpat-|eyJ"
FEATURES = ("length", "transitions", "digits", "capitals", "hexadecimal", "dictionary", "path", "cue", "assigned", "variety", "prefix", "counter_cue", "kind", "placeholder")
PLACEHOLDERS = r"example|your|changeme|xxxx|test|dummy|sample|placeholder|password|<|\$\{"


def features_of(value: Column, before: Column, after: Column, kind: Column) -> list[Column]:
    """Each of FEATURES as a whole number from 0 to BINS - 1."""
    n = F.length(value).cast("double")
    step = lambda x: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(BINS - 1)).cast("int")
    left = lambda pattern: F.length(F.regexp_replace(value, pattern, ""))
    runs = F.size(F.regexp_extract_all(value, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0)))
    low = F.lower(before)
    near = rf"(?:^|[^\p{{L}}])(?:{CUES})[^\p{{L}}0-9]*$"
    return [
        step((n - 16) / 4),
        step(8 * (runs - 1) / n),
        step(8 * (n - left("[0-9]")) / n),
        step(8 * (n - left("[A-Z]")) / n),
        F.when(value.rlike("^[0-9a-f]+$"), 2).when(value.rlike("^[0-9a-f-]+$"), 1).otherwise(0),
        step(8 * (n - left(f"(?i)(?:{PIECES})")) / n),
        F.when(before.rlike(r"(?:://\S*|[/\\.])$") | after.rlike(r"^\.(?:html?|png|jpe?g|js|css)"), 2).when(value.rlike("/[A-Za-z_-]{3,}/"), 1).otherwise(0),
        F.when(low.rlike(near), 2).when(low.rlike(rf"(?:^|[^\p{{L}}])(?:{CUES})(?:[^\p{{L}}]|$)"), 1).otherwise(0),
        F.when(before.rlike(r"""[=:]\s*["']?$"""), 1).otherwise(0),
        step(F.size(F.array_distinct(F.split(value, ""))) / 4),
        F.when(value.rlike(f"^(?:{PREFIXES})"), 1).otherwise(0),
        F.when(low.rlike(rf"(?:^|[^\p{{L}}])(?:{COUNTER_CUES})[^\p{{L}}0-9]*$"), 1).otherwise(0),
        F.coalesce(F.array_position(F.array(*[F.lit(k) for k in PATTERNS]), kind).cast("int") - 1, F.lit(0)),
        F.when(F.lower(value).rlike(PLACEHOLDERS), 1).otherwise(0),
    ]


def made_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(value, before, after, kind, secret): labelled findings of known kinds, the same in every run, as
    the tables at hand have none. Use real ones where there are any.

    True: cloud key ids, hex and base64 tokens after a cue, in words or assignments, signed web
    tokens, private keys, passwords in addresses and assignments. False: digests of commits and
    files, uuids, words with numbers, paths, repeated marks, placeholders of each kind."""
    df = spark.range(n).withColumn("case", (F.col("id") % 18).cast("int"))
    h = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "[=\n]", "")
    up = F.upper(F.regexp_replace(F.base64(F.unhex(h)), "[^A-Za-z0-9]", "X"))
    few = F.pmod(F.xxhash64("id"), F.lit(9)).cast("int")
    words = F.concat(F.element_at(F.array(*[F.lit(w) for w in ("document", "version", "userName", "indexPage", "configFile", "imageList", "systemTime", "exampleData", "serverNode")]), few + 1), F.lit("_"), F.element_at(F.array(*[F.lit(w) for w in ("content", "default", "function", "example", "string", "number", "service", "client", "table")]), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(9)).cast("int") + 1))
    cue = F.element_at(F.array(*[F.lit(w) for w in ("password=", 'token = "', "api_key: ", "secret=", "with key ", "auth token ", 'apikey="', "pwd: ", "bearer ")]), few + 1)
    plain = F.lit("and the other one ")
    cases = [
        (F.concat(F.lit("AKIA"), F.substring(up, 1, 16)), F.when(few < 5, plain).otherwise(cue), True),
        (F.concat(F.lit("AKIA"), F.substring(up, 5, 16)), plain, True),
        (F.substring(h, 1, 40), cue, True),
        (F.substring(h, 8, 20), cue, True),
        (F.substring(b64, 1, 40), cue, True),
        (F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), F.when(few < 5, plain).otherwise(cue), True),
        (F.substring(h, 1, 40), F.when(few < 5, F.lit("see commit ")).otherwise(F.lit("sha1: ")), False),
        (F.regexp_replace(F.substring(h, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.when(few < 5, F.lit("uuid ")).otherwise(plain), False),
        (F.concat(words, F.lit("_"), few.cast("string")), F.when(few < 4, cue).otherwise(plain), False),
        (F.concat(F.lit("images/"), words, F.lit("/page"), few.cast("string")), F.lit("https://host.example/"), False),
        (F.concat(F.repeat(F.substring(h, 1, 1), 18), F.lit("1x")), F.when(few < 4, cue).otherwise(plain), False),
        (F.concat(F.lit("your_example_key_"), few.cast("string")), cue, False),
        (F.concat(F.lit("eyJ"), F.substring(b64, 1, 17), F.lit("."), F.substring(b64, 9, 30), F.lit("."), F.substring(b64, 3, 40)), F.when(few < 4, cue).otherwise(plain), True),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), b64, F.lit("\n-----END RSA PRIVATE KEY-----")), plain, True),
        (F.concat(F.lit("admin:"), F.substring(b64, 1, 12)), F.lit("postgres://"), True),
        (F.substring(b64, 5, 11), F.lit("password="), True),
        (F.concat(F.lit("user:"), F.element_at(F.array(*[F.lit(x) for x in ("password", "<secret>", "your_pass", "xxxxxx", "example")]), few % 5 + 1)), F.lit("https://"), False),
        (F.element_at(F.array(*[F.lit(x) for x in ("changeme", "<password>", "your_secret", "xxxxxxxx", "example", "required", "optional", "forgotten", "${PASSWORD}")]), few + 1), F.lit("password: "), False),
    ]
    kinds = ["token"] * 13 + ["private_key", "address", "assigned", "address", "assigned"]
    value = before = secret = kind = None
    for k, ((v, b, s), name) in enumerate(zip(cases, kinds, strict=True)):
        at = F.col("case") == k
        value, before, secret, kind = (F.when(at, x) if made is None else made.when(at, x) for made, x in ((value, v), (before, b), (secret, F.lit(s)), (kind, F.lit(name))))
    return df.select(value.alias("value"), before.alias("before"), F.lit(" and").alias("after"), kind.alias("kind"), secret.alias("secret"))


def _gini(yes: float, no: float) -> float:
    n = yes + no
    return n - (yes * yes + no * no) / n if n else 0.0


def grow(findings: DataFrame, trees: int = TREES, levels: int = LEVELS) -> list[dict]:
    """Each tree as {node: (feature, bin) or (None, probability)}; node n has 2n + 1 (values up to
    the bin) and 2n + 2. Findings weigh 0, 1, 2 or 3 in a tree, by a hash, as in a bootstrap sample;
    a node may choose among a third of the features, by a hash as well."""
    columns = [f"f{j}" for j in range(len(FEATURES))]
    kind = F.coalesce(F.col("kind"), F.lit("token")) if "kind" in findings.columns else F.lit("token")
    made = features_of(F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), kind)
    rows = findings.where("value is not null and secret is not null and length(value) > 0").select(F.col("secret").cast("int").alias("y"), F.xxhash64("value", "before", "after").alias("h"), *[x.alias(c) for x, c in zip(made, columns, strict=True)])
    draw = F.pmod(F.xxhash64("h", "tree"), F.lit(1000))
    weight = F.when(draw < 368, 0).when(draw < 736, 1).when(draw < 920, 2).otherwise(3)
    rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("w", weight).where("w > 0")
    rows = materialise(rows, "findings")
    forest: list[dict] = [{} for _ in range(trees)]
    open_nodes = {(t, 0) for t in range(trees)}
    for level in range(levels + 1):
        if not open_nodes:
            break
        node = _node(forest, columns)
        pairs = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(c).alias("bin")) for j, c in enumerate(columns)]))
        counted = rows.withColumn("node", node).where("node >= 0").select("tree", "node", "y", "w", pairs.alias("x")).groupBy("tree", "node", "x.j", "x.bin").agg(F.sum(F.col("w") * F.col("y")).alias("yes"), F.sum(F.col("w") * (1 - F.col("y"))).alias("no")).collect()
        table: dict = {}
        for r in counted:
            table.setdefault((r["tree"], r["node"]), {}).setdefault(r["j"], {})[r["bin"]] = (r["yes"], r["no"])
        following = set()
        for t, n in sorted(open_nodes):
            by = table.get((t, n), {})
            yes, no = (sum(x[i] for x in by.get(0, {}).values()) for i in (0, 1))
            best = None
            if level < levels and yes and no:
                for j in range(len(columns)):
                    if len(columns) > 3 and (t * 7919 + n * 104729 + j * 1299709) % 3:
                        continue
                    a = b = 0
                    for k in sorted(by.get(j, {}))[:-1]:
                        a, b = a + by[j][k][0], b + by[j][k][1]
                        gain = _gini(yes, no) - _gini(a, b) - _gini(yes - a, no - b)
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = (gain, j, k)
            if best:
                forest[t][n] = best[1:]
                following |= {(t, 2 * n + 1), (t, 2 * n + 2)}
            else:
                forest[t][n] = (None, (yes + 1) / (yes + no + 2))
        open_nodes = following
    return forest


def _node(forest: list[dict], columns: list[str]) -> Column:
    """The open node of a row (tree, features), or -1 if it has come to a leaf."""

    def walk(tree: dict, n: int) -> Column:
        if n not in tree:
            return F.lit(n)
        j, k = tree[n]
        return F.lit(-1) if j is None else F.when(F.col(columns[j]) <= k, walk(tree, 2 * n + 1)).otherwise(walk(tree, 2 * n + 2))

    out = F.lit(-1)
    for t, tree in enumerate(forest):
        out = F.when(F.col("tree") == t, walk(tree, 0)).otherwise(out)
    return out


def probability(forest: list[dict], features: list[Column]) -> Column:
    """The mean of the trees' probabilities."""

    def walk(tree: dict, n: int) -> Column:
        j, k = tree[n]
        return F.lit(float(k)) if j is None else F.when(features[j] <= k, walk(tree, 2 * n + 1)).otherwise(walk(tree, 2 * n + 2))

    total = F.lit(0.0)
    for tree in forest:
        total = total + walk(tree, 0)
    return total / max(1, len(forest))


def judged(spans: Column, forest: list[dict], accept: float) -> Column:
    """array<struct<kind,start,end,value,p,secret>> of SPAN structs."""
    columns = [f"f{j}" for j in range(len(FEATURES))]
    known = F.transform(spans, lambda s: F.struct(s.alias("s"), *[x.alias(c) for x, c in zip(features_of(s["value"], s["before"], s["after"], s["kind"]), columns, strict=True)]))
    found = F.transform(known, lambda r: F.struct(r["s"].alias("s"), probability(forest, [r[c] for c in columns]).alias("p")))
    return F.transform(found, lambda r: F.struct(*[r["s"][c].alias(c) for c in ("kind", "start", "end", "value")], r["p"].alias("p"), (r["p"] >= accept).alias("secret")))


def scan(docs: DataFrame, findings: DataFrame | None = None, accept: float = 0.5) -> DataFrame:
    """(doc_id, found array<struct<kind,start,end,value,p,secret>>) for each row of docs: all candidates
    by start and end, with their probability.

    Candidates are matches of PATTERNS; tokens need a letter and a digit. findings: labelled ones
    (value, before, after, secret[, kind]) to learn from; rows with a null value or label take no
    part. A null text is empty; rows that repeat are each answered, whatever their doc_id. Places are
    code points, the end exclusive."""
    spark = docs.sparkSession
    forest = grow(made_findings(spark) if findings is None else findings)
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    # look-arounds would be tried at every place; a plain search first is cheaper
    guards = {"token": text.rlike("[A-Za-z0-9_+/-]{16}"), "private_key": F.contains(text, F.lit("PRIVATE KEY-----")), "address": F.contains(text, F.lit("://")) & F.contains(text, F.lit("@")), "assigned": text.rlike("(?:assword|passwd|pwd|secret|PASSWORD|SECRET)[ ]{0,2}[=:]")}
    for kind, pattern in PATTERNS.items():
        found = with_matches(found, "text", kind, pattern, 40, guards[kind])
    mixed = F.filter("token", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    every = F.concat(mixed, *[k for k in PATTERNS if k != "token"])
    placed = F.transform(every, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s.alias("s")))
    stored = materialise(found.select("doc_id", F.transform(F.array_sort(placed), lambda x: x["s"]).alias("found")), "secret-candidates")
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,p:double,secret:boolean>>")
    return stored.select("doc_id", F.when(F.size("found") > 0, judged(F.col("found"), forest, accept)).otherwise(none).alias("found"))
