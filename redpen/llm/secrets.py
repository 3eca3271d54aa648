"""Secret scans with a random forest that drops false positives, in DataFrame expressions.

Candidates are runs of at least 16 characters of keys and tokens with a digit among them. Each gets
figures of its length, its character classes and their transitions, entropy, coverage by common
letter pairs and dictionary words, path-like surroundings, and the words before it. A random forest
trained on labelled findings (candidate, before, after, label) scores them. Without findings of one's
own, `labelled_findings` makes a set by rule: keys of usual forms in usual places, and the usual
false alarms (commit ids, checksums, UUIDs, paths, versions, plain numbers, identifiers).

Null and empty texts have no candidates. Places count code points from 0. Rows with equal doc_id are
scanned each for itself. Other columns are ignored. A text of any length is read in one pass, and its
candidates become rows at once, so none is held as a growing list. An empty table gives none. Keys of
letters only, and of fewer than 16 characters, are no candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+"
REACH, CUT, TREES, DEPTH, FINDINGS = 40, 0.5, 30, 8, 6_000

# Frequent English letter pairs, words of code and prose, and words beside keys.
_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|nt|to|se|ha|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce"
_WORDS = "admin|alpha|app|assets|backup|base|beta|build|cache|class|client|commit|config|content|core|data|date|default|demo|dist|document|docs|download|draft|event|example|feature|field|file|final|font|form|front|group|home|http|image|index|info|item|java|jquery|lib|list|login|main|media|message|min|model|module|name|node|number|object|order|page|part|post|product|project|public|python|release|report|result|sample|script|server|service|session|site|source|spark|src|static|style|system|table|temp|test|text|thumb|time|type|update|upload|user|value|vendor|version|video|view|web|world|year"
_KEYS = r"(?i)(secret|token|passw|pwd|api.?key|access.?key|private|credential|bearer|auth|signing|encryption)"
_OTHERS = r"(?i)(sha-?\d*|md5|commit|hash|digest|checksum|uuid|guid|\bid\b|isbn|version|serial|build|order|invoice|phone|card|ref)"


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole.cast("double"), F.lit(1.0))


def features(candidate: Column, before: Column, after: Column) -> dict[str, Column]:
    n, low = F.length(candidate), F.lower(candidate)
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    letters = F.split(candidate, "", -1)
    kinds = F.array_distinct(F.filter(letters, lambda x: x != ""))
    entropy = F.aggregate(
        F.transform(kinds, lambda k: _share(n - F.length(F.replace(candidate, k, F.lit(""))), n)), F.lit(0.0), lambda a, p: a - p * F.log2(p)
    )
    flag = lambda c, pattern: c.rlike(pattern).cast("double")
    return {
        "length": n.cast("double"),
        "digits": _share(count(candidate, "[0-9]"), n),
        "upper": _share(count(candidate, "[A-Z]"), n),
        "marks": _share(count(candidate, "[^A-Za-z0-9]"), n),
        "hex_only": flag(candidate, "^[0-9a-fA-F]+$"),
        "digits_only": flag(candidate, "^[0-9]+$"),
        "letter_digit": _share(count(candidate, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"), n),
        "lower_upper": _share(count(candidate, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"), n),
        "long_digit_run": flag(candidate, "[0-9]{8,}"),
        "longest_word": flag(candidate, "[a-z]{7,}|[A-Z][a-z]{6,}"),
        "entropy": entropy,
        "pairs": _share(count(low, _PAIRS), n),
        "dictionary": _share(n - F.length(F.regexp_replace(low, _WORDS, "")), n),
        "slashes": _share(count(candidate, "/"), n),
        "joints": _share(count(candidate, "[_-]"), n),
        "uuid": flag(candidate, "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"),
        "known_form": flag(candidate, "^(AKIA|ASIA|ghp_|gho_|glpat-|sk_live_|sk-|xox[bp]-|AIza|eyJ)"),
        "path_before": flag(before, r"(://|www\.|[/\\.])$"),
        "path_after": flag(after, r"^(\.[a-z]{2,5}\b|/|\\)"),
        "assigned": flag(before, r"[:=]\s*[\"'`]?$"),
        "quoted": (flag(before, r"[\"'`]$") * flag(after, r"^=*[\"'`]")),
        "key_word": flag(before, _KEYS),
        "other_word": flag(before, _OTHERS),
    }


# -- labelled findings ---------------------------------------------------------------------------


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """`n` findings made by rule: (candidate, before, after, label), deterministic in n."""
    i = F.col("id")
    draw = lambda k: F.sha2(F.concat(F.lit(f"{k}:"), i.cast("string")), 256)
    upto = lambda k, m: F.pmod(F.xxhash64(F.lit(k), i), F.lit(m))
    b64 = F.translate(F.base64(F.unhex(draw(1))), "=+/", "xyz")
    mixed = F.concat(b64, F.translate(F.base64(F.unhex(draw(2))), "=+/", "abc"))
    pick = lambda k, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (upto(k, len(xs)) + 1).cast("int"))
    word = lambda k: pick(k, _WORDS.split("|"))
    num = lambda k, m: upto(k, m).cast("string")
    keys = ["token = \"", "api_key: \"", "secret=", "password = '", "AUTH_TOKEN=", "access_key = ", "Authorization: Bearer ", "client_secret\": \"", "passwd: ", "private_key=\"", "signing_key: '"]
    idle = ["commit ", "sha256:", "md5 = ", "checksum: ", "uuid: ", "order id ", "version ", "digest=\"", "build ", "https://example.com/", "static/", "see ", "", "the file ", "invoice ", "card "]
    secret = [F.left(draw(3), F.lit(40)), F.left(draw(4), F.lit(32)), draw(5), F.left(b64, F.lit(40)), F.left(mixed, F.lit(64)), F.left(mixed, F.lit(24)), F.concat(F.lit("AKIA"), F.upper(F.left(draw(6), F.lit(16)))), F.concat(F.lit("ghp_"), F.left(mixed, F.lit(36))), F.concat(F.lit("sk_live_"), F.left(b64, F.lit(24)))]
    u = draw(7)
    false_alarm = [
        F.left(draw(8), F.lit(40)), draw(9), F.left(draw(10), F.lit(32)),
        F.concat_ws("-", F.substring(u, 1, 8), F.substring(u, 9, 4), F.substring(u, 13, 4), F.substring(u, 17, 4), F.substring(u, 21, 12)),
        F.concat_ws("/", word(11), word(12), word(13), F.concat(word(14), num(15, 1000))),
        F.concat_ws("-", word(16), word(17), F.concat(F.lit("v"), num(18, 9)), num(19, 90)),
        F.concat_ws("_", word(20), word(21), F.concat(F.lit("20"), num(22, 30)), F.lpad(num(23, 12), 2, "0"), num(24, 28)),
        F.concat(F.initcap(word(25)), F.initcap(word(26)), F.initcap(word(27)), num(28, 1000)),
        F.concat(F.lpad(num(29, 10**8), 8, "4"), F.lpad(num(30, 10**8), 8, "7")),
        F.concat(word(31), word(32), word(33), word(34), num(35, 100)),
    ]
    choose = lambda k, xs: reduce(lambda a, x: F.when(upto(k, len(xs)) == x[0], x[1]).otherwise(a), list(enumerate(xs))[1:], xs[0])
    label = (upto(36, 2) == 0).cast("int")
    # Keys mostly stand behind a key word, a fifth in other places; false alarms the other way.
    at_key = F.when(label == 1, upto(37, 5) != 0).otherwise(upto(37, 12) == 0)
    shapeless = F.when(label == 1, choose(38, secret)).when(at_key, choose(39, false_alarm[3:])).otherwise(choose(40, false_alarm))
    plain = pick(41, ["x = ", "", "key ", "value: \"", "use ", "= "])
    before = F.concat(word(42), F.lit(" "), F.when(at_key, pick(43, keys)).when(label == 1, plain).otherwise(pick(44, idle)))
    after = F.when(F.substring(before, -1, 1).isin('"', "'"), F.substring(before, -1, 1)).otherwise(pick(45, [" ", ".", "\n", ".js", "/", ""]))
    after = F.when((label == 1) & after.isin(".js", "/"), F.lit(" ")).otherwise(after)
    return spark.range(0, n, 1, 1).select("id", shapeless.alias("candidate"), before.alias("before"), after.alias("after"), label.alias("label"))


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    """A forest over labelled findings; null parts count as empty, null labels are left out."""
    part = lambda c: F.coalesce(c, F.lit(""))
    made = features(part(F.col("candidate")), part(F.col("before")), part(F.col("after")))
    rows = findings.where("label is not null").select(F.col("label").cast("double").alias("label"), *[c.alias(k) for k, c in made.items()])
    rows = VectorAssembler(inputCols=list(made), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, minInstancesPerNode=3).fit(rows.select("label", "features"))


# -- scan ----------------------------------------------------------------------------------------


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, nth, start, candidate, before, after of each candidate of `docs` (doc_id, text)."""
    # Rows with a number of their own, as a doc_id may repeat.
    rows = docs.select("doc_id", "text").where(F.col("text").rlike(CANDIDATE)).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).withColumn("gaps", F.split("text", CANDIDATE, -1))
    one = F.transform(
        "found",
        lambda c, i: F.struct(
            c.alias("candidate"),
            F.right(F.get("gaps", i), F.lit(REACH)).alias("before"),
            F.left(F.get("gaps", i + 1), F.lit(REACH)).alias("after"),
            (F.length(F.get("gaps", i)) + F.when(i > 0, F.length(F.get("found", i - 1))).otherwise(0)).alias("step"),
        ),
    )
    rows = rows.select("row", "doc_id", F.posexplode(one).alias("nth", "f"))
    # Places by a running sum over the steps of a row; only candidates travel.
    start = F.sum("f.step").over(Window.partitionBy("row").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("doc_id", "nth", start.cast("long").alias("start"), "f.candidate", "f.before", "f.after")


def scored(found: DataFrame, model: RandomForestClassificationModel, cut: float = CUT) -> DataFrame:
    """`found` with secret_score and is_secret."""
    made = features(F.col("candidate"), F.col("before"), F.col("after"))
    rows = found.select("*", *[c.alias(f"f_{k}") for k, c in made.items()])
    rows = VectorAssembler(inputCols=[f"f_{k}" for k in made], outputCol="features").transform(rows)
    score = F.get(vector_to_array("probability"), F.lit(1))
    rows = model.transform(rows).withColumn("secret_score", F.round(score, 9))
    return rows.select(*found.columns, "secret_score", (F.col("secret_score") >= cut).alias("is_secret"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(labelled_findings(spark))
    found = scored(candidates(documents(spark, sf_dir)), model)
    return found.select("doc_id", "nth", "start", F.length("candidate").alias("length"), F.concat(F.left("candidate", F.lit(4)), F.lit("..."), F.right("candidate", F.lit(2))).alias("redacted"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "secret_score", "is_secret")
