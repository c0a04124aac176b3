"""Secret scan with a random forest that removes false positives.

Candidates are whole runs of 16 token characters or more (the parts of a dotted
token as one), whatever is assigned to a name that holds a word for a secret,
passwords in addresses and the credentials of authorization headers. Each is described by its length, its character transitions, the share of its letters that dictionary
words cover, whether it stands in a path, and the words around it. A random
forest trained from labelled findings tells secrets from the rest.

Everything is column expressions and aggregates: the texts are cut in the row,
the forest is grown level by level from histograms (one aggregate a level for
all trees), and the grown trees are a CASE expression again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked, written

CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?:eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{4,}+){1,2}+|[A-Za-z0-9+/_-]{16,}+={0,2})"
CONTEXT = 64  # characters looked at on either side
DICTIONARY = 1_000  # most frequent words (documents that hold them) of DICTIONARY_LETTERS letters
DICTIONARY_LETTERS = "{4,12}"
TREES, DEPTH, LEAF = 12, 5, 5
# At most so many labelled findings of each kind train the forest, smallest hash first.
TRAIN_FINDINGS = 10_000
THRESHOLD = 0.5
REDACTED = "[REDACTED]"

# Words beside a secret, words beside a harmless value, and prefixes of public credential formats.
SECRET_WORDS = r"token|secret|passw(?:or)?d|passwd|pwd|api[_ -]?key|access[_ -]?key|auth|bearer|credential|private[_ -]?key|client[_ -]?key"
HARMLESS_WORDS = r"example|sample|dummy|placeholder|test|sha\d*|md5|hash|commit|uuid|checksum|digest|card|phone|isbn|order|invoice"
KNOWN_PREFIX = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|ghs_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|eyJ)"
_ASSIGNED = r"""["'`]?\s*(?:=|:|=>|:=)\s*["'`]?$"""
# What may follow the word in a name: db_password_prod, client.secret.value, tokenValue, but not author.
_REST = r"(?:[_.-][\w.-]{0,40}|(?<=[a-z])[A-Z][A-Za-z0-9]{0,20})?"

# A value assigned to a secret name: up to its closing quote, or else up to white space, a quote or a separator and without
# punctuation at its end. The first two looks behind are cheap and fail nearly everywhere.
ASSIGNED = (
    r"""(?<=[=:>\s"'`])(?<=[=:>]\s{0,20}["'`]?)(?<=(?i:""" + SECRET_WORDS + ")" + _REST + r"""["'`]?\s{0,20}(?:=>|:=|=|:)\s{0,20}["'`]?)"""
    r"""(?:(?<=")[^"\r\n]++(?=")|(?<=')[^'\r\n]++(?=')|(?<=`)[^`\r\n]++(?=`)|(?![=:>])[^\s"'`,;&<>(){}\[\]]*[A-Za-z0-9+/_=-])""")
# The password of scheme://user:password@host, and what follows "Authorization: Bearer ".
_USER = r"://[^\s/@:]{0,64}:"
_HEADER = r"""(?i:authorization)["'`]?\s{0,4}[:=]\s{0,4}["'`]?(?i:bearer|basic|token)\s"""
PASSWORD = rf"(?<=:)(?<={_USER})[^\s/@<>\"'`]++(?=@)"
CREDENTIALS = rf"(?<=[rRcCnN]\s)(?<={_HEADER})[^\s\"'`,;<>]*[A-Za-z0-9+/_=-]"
_CUT = f"{PASSWORD}|{CREDENTIALS}|{ASSIGNED}|{CANDIDATE}"
_MARK = "\ufdd0"  # a noncharacter, set around candidates


def _named(before: Column, after: Column) -> Column:
    """Whether a value stands where a secret is named."""
    return before.rlike(f"(?i:{SECRET_WORDS}){_REST}{_ASSIGNED}|{_HEADER}$") | before.rlike(f"{_USER}$") & after.startswith("@")


def _share(text: Column, pattern: str, total: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{pattern}]", "")) / total


# name, expression over (value, before, after, dictionary), thresholds
FEATURES: list[tuple[str, Callable[[Column, Column, Column, Column], Column], list[float]]] = [
    ("length", lambda v, b, a, d: F.length(v), [5, 7, 9, 11, 13, 16, 19, 23, 31, 35, 39, 47, 63, 127, 511]),
    ("digits", lambda v, b, a, d: _share(v, "0-9", F.length(v)), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9, 0.99]),
    ("upper", lambda v, b, a, d: _share(v, "A-Z", F.length(v)), [0.01, 0.1, 0.25, 0.4, 0.6]),
    ("hex", lambda v, b, a, d: _share(v, "0-9a-fA-F", F.length(v)), [0.5, 0.7, 0.85, 0.99]),
    ("symbols", lambda v, b, a, d: _share(v, "+/_=-", F.length(v)), [0.01, 0.05, 0.1, 0.2]),
    ("distinct", lambda v, b, a, d: F.size(F.array_distinct(F.split(v, ""))) / F.length(v), [0.1, 0.2, 0.3, 0.4, 0.5, 0.65]),
    ("letter_digit", lambda v, b, a, d: F.regexp_count(v, F.lit("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]")) / F.length(v), [0.01, 0.1, 0.2, 0.3, 0.4]),
    ("case_change", lambda v, b, a, d: F.regexp_count(v, F.lit("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")) / F.length(v), [0.01, 0.1, 0.2, 0.3]),
    ("repeats", lambda v, b, a, d: F.regexp_count(v, F.lit(r"(.)(?=\1)")) / F.length(v), [0.02, 0.1, 0.2, 0.4]),
    ("words", lambda v, b, a, d: F.aggregate(
        F.filter(F.regexp_extract_all(F.lower(v), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: F.array_contains(d, w)),
        F.lit(0), lambda n, w: n + F.length(w)) / F.length(v), [0.01, 0.2, 0.4, 0.6, 0.8]),
    ("letter_runs", lambda v, b, a, d: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(v, F.lit("[A-Za-z]+"), F.lit(0)), F.length)), F.lit(0)) / F.length(v),
     [0.05, 0.1, 0.2, 0.4, 0.6]),
    ("path", lambda v, b, a, d: F.when(b.rlike(r"(?:[:.]/?/?|[\w.-]+[/\\])\S*$") | a.rlike(r"^(?:[/\\]|\.[a-z]{2,5}\b)"), 1.0).otherwise(0.0), [0.5]),
    ("slashes", lambda v, b, a, d: F.length(v) - F.length(F.replace(v, F.lit("/"), F.lit(""))), [0.5, 1.5, 3.5]),
    ("assigned", lambda v, b, a, d: F.when(b.rlike(_ASSIGNED) & b.rlike("[=:]"), 1.0).otherwise(0.0), [0.5]),
    ("quoted", lambda v, b, a, d: F.when(b.rlike("[\"'`]$") & a.rlike("^[\"'`]"), 1.0).otherwise(0.0), [0.5]),
    ("secret_word", lambda v, b, a, d: F.when(b.rlike(rf"(?i)(?:{SECRET_WORDS})\W*$") | _named(b, a), 2.0).when(b.rlike(rf"(?i)(?:{SECRET_WORDS})"), 1.0).otherwise(0.0), [0.5, 1.5]),
    ("harmless_word", lambda v, b, a, d: F.when(b.rlike(rf"(?i)\b(?:{HARMLESS_WORDS})\b\W*$"), 2.0).when(
        F.concat(b, F.lit(" "), a).rlike(rf"(?i)\b(?:{HARMLESS_WORDS})\b"), 1.0).otherwise(0.0), [0.5, 1.5]),
    ("prefix", lambda v, b, a, d: F.when(v.rlike(KNOWN_PREFIX), 1.0).otherwise(0.0), [0.5]),
]


def dictionary(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The DICTIONARY words that most documents hold; ties by the word."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(rf"(?<![a-z0-9])[a-z]{DICTIONARY_LETTERS}(?![a-z0-9])"), F.lit(0)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").count()
    return [r["word"] for r in counts.orderBy(F.col("count").desc(), "word").limit(DICTIONARY).collect()]


def _cut(text: Column) -> Column:
    """The text in pieces: candidates at the odd places, counted from 0, and
    what stands between them at the even ones. One search marks the candidates;
    a text that holds the mark itself is searched twice instead."""
    some = F.coalesce(text, F.lit(""))
    found, parts = F.regexp_extract_all(some, F.lit(_CUT), F.lit(0)), F.split(some, _CUT, -1)
    pairs = F.flatten(F.zip_with(parts, found, lambda p, f: F.when(f.isNull(), F.array(p)).otherwise(F.array(p, f))))
    marked = F.split(F.regexp_replace(some, F.lit(_CUT), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    return F.when(F.contains(some, F.lit(_MARK)), pairs).otherwise(marked)


def _each(make: Callable[[Column], Column]) -> Column:
    """``make(i)`` for each candidate's place in "pieces", as an array; null without candidates."""
    n = F.size("pieces")
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 2, F.lit(2)), make))


def _around(i: Column) -> tuple[Column, Column, Column]:
    """The value and what stands before and after it; a name that is a candidate
    itself (``db_password_prod``) stands before as well."""
    value, between = F.get("pieces", i), F.get("pieces", i - 1)
    earlier = F.coalesce(F.right(F.get("pieces", i - 2), F.lit(CONTEXT)), F.lit(""))
    return value, F.right(F.concat(earlier, F.right(between, F.lit(CONTEXT))), F.lit(CONTEXT)), F.left(F.get("pieces", i + 1), F.lit(CONTEXT))


def findings(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, finding_no, start, value, before, after, <features>) of every
    candidate; start counts characters from 0."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = src.select("doc_id", _cut(F.col("text")).alias("pieces"))
    run = F.aggregate(
        _each(lambda i: F.struct(F.length(F.get("pieces", i - 1)).alias("gap"), F.length(F.get("pieces", i)).alias("size"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, n: F.struct((acc["at"] + n["gap"] + n["size"]).alias("at"), F.array_append(acc["starts"], acc["at"] + n["gap"]).alias("starts")),
        lambda acc: acc["starts"])

    def one(i: Column) -> Column:
        v, b, a = _around(i)
        return F.struct(v.alias("value"), b.alias("before"), a.alias("after"))

    rows = rows.select("doc_id", run.alias("starts"), _each(one).alias("found"))
    # The outer form: the inner one would have the texts searched once more, to drop those without candidates.
    rows = rows.select("doc_id", F.posexplode_outer(F.arrays_zip("starts", "found"))).where("col IS NOT NULL").select(
        "doc_id", F.col("pos").alias("finding_no"), F.col("col.starts").alias("start"), "col.found.*")
    known = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    return rows.select("*", *[f(F.col("value"), F.col("before"), F.col("after"), known).cast("double").alias(name) for name, f, _ in FEATURES])


def rule_labels(found: DataFrame) -> DataFrame:
    """Adds label: 1 for values assigned to a name that means a secret (but for
    unquoted words of the dictionary and texts of several words) or of a public
    credential format, 0 for the rest. It stands in for findings that people
    have labelled, where there are none."""
    named = _named(F.col("before"), F.col("after"))
    shaped = (F.col("digits") < 0.95) & (F.col("distinct") * F.col("length") >= 8) & ((F.col("words") < 0.8) | (F.col("quoted") > 0)) & ~F.col("value").rlike(r"\s")
    return found.withColumn("label", ((named & shaped) | (F.col("prefix") > 0)).cast("int"))


class Tree:
    """Splits by node (the root is 1, the children of k are 2k and 2k + 1) and
    leaf scores."""

    def __init__(self):
        self.splits: dict[int, tuple[int, float]] = {}
        self.leaves: dict[int, float] = {}

    def node(self, values: list[Column], at: int = 1) -> Column:
        """The node that a row has come to."""
        if at not in self.splits:
            return F.lit(at)
        f, t = self.splits[at]
        return F.when(values[f] > t, self.node(values, 2 * at + 1)).otherwise(self.node(values, 2 * at))

    def score(self, values: list[Column], at: int = 1) -> Column:
        if at not in self.splits:
            return F.lit(self.leaves.get(at, 0.0))
        f, t = self.splits[at]
        return F.when(values[f] > t, self.score(values, 2 * at + 1)).otherwise(self.score(values, 2 * at))


def forest_score(trees: list[Tree], values: list[Column]) -> Column:
    total = F.lit(0.0)
    for t in trees:
        total = total + t.score(values)
    return total / max(len(trees), 1)


def _drawn(tree: int) -> Column:
    """How often a finding is drawn for a tree: Poisson with mean 1, by hash."""
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.col("finding_no"), F.lit(tree)), F.lit(1000))
    return F.when(u < 368, 0).when(u < 736, 1).when(u < 920, 2).when(u < 981, 3).otherwise(4)


def grow_forest(labelled: DataFrame) -> list[Tree]:
    """Trees from (doc_id, finding_no, label, <features>): one aggregate a level
    gives the label counts of every (tree, node, feature, bin), a number of rows
    bound by the parameters; the best split of each node is taken from them.
    Leaves count a label's findings as often as there are findings of that label
    for one that trains, so a score means the same at every size. Without both labels there are no trees, and every score is 0."""
    kinds = [labelled.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", "finding_no"), "doc_id", "finding_no").limit(TRAIN_FINDINGS) for k in (0, 1)]
    rows = written(kinds[0].unionAll(kinds[1]).drop("value", "before", "after", "start"), "labelled_findings")
    of = {r["label"]: r["n"] for r in labelled.where("label IN (0, 1)").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(of) < 2:
        return []
    weight = [of[k] / min(of[k], TRAIN_FINDINGS) for k in (0, 1)]
    bins = [sum((F.col(name) > t).cast("int") for t in cuts) for name, _, cuts in FEATURES]
    values = [F.col(name) for name, _, _ in FEATURES]
    trees = [Tree() for _ in range(TREES)]
    for level in range(DEPTH + 1):
        at = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), tree.node(values).alias("node"), _drawn(t).alias("n")) for t, tree in enumerate(trees)]))
        dealt = rows.select("label", F.array(*bins).alias("bins"), at.alias("at")).where("at.n > 0")
        cells = dealt.select("label", "at.*", F.posexplode("bins").alias("feature", "bin")).where(F.col("node") >= 2**level).groupBy(
            "tree", "node", "feature", "bin").agg(F.sum(F.col("n") * F.col("label")).alias("ones"), F.sum("n").alias("n")).collect()
        counts: dict[tuple[int, int], dict[int, dict[int, tuple[int, int]]]] = {}
        for r in cells:
            counts.setdefault((r["tree"], r["node"]), {}).setdefault(r["feature"], {})[r["bin"]] = (r["ones"], r["n"])
        for (t, node), by_feature in counts.items():
            split = _best_split(t, node, by_feature) if level < DEPTH else None
            if split is None:
                whole = next(iter(by_feature.values())).values()
                ones = weight[1] * sum(c[0] for c in whole)
                zeros = weight[0] * sum(c[1] - c[0] for c in whole)
                trees[t].leaves[node] = (ones + 0.5) / (ones + zeros + 1)
            else:
                trees[t].splits[node] = split
    return trees


def _best_split(tree: int, node: int, by_feature: dict[int, dict[int, tuple[int, int]]]) -> tuple[int, float] | None:
    """Greatest fall of Gini impurity among the features drawn for the node."""
    import random

    drawn = random.Random(tree * 1_000_003 + node).sample(range(len(FEATURES)), max(4, len(FEATURES) // 3))
    best, found = 1e-9, None
    for f in sorted(drawn):
        cells = by_feature.get(f, {})
        ones, n = (sum(c[k] for c in cells.values()) for k in (0, 1))
        if ones in (0, n):
            return None
        left_ones = left = 0
        for b, cut in enumerate(FEATURES[f][2]):
            o, c = cells.get(b, (0, 0))
            left_ones, left = left_ones + o, left + c
            right_ones, right = ones - left_ones, n - left
            if min(left, right) < LEAF:
                continue
            fall = ones * (n - ones) / n - left_ones * (left - left_ones) / left - right_ones * (right - right_ones) / right
            if fall > best:
                best, found = fall, (f, cut)
    return found


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: Callable[[DataFrame], DataFrame] = rule_labels) -> tuple[list[Tree], list[str], DataFrame]:
    """(trees, dictionary, findings): ``label`` adds the label of each finding
    (null where there is none)."""
    words = dictionary(docs, text_col)
    found = written(findings(docs, words, id_col, text_col), "findings")
    return grow_forest(label(found)), words, found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: Callable[[DataFrame], DataFrame] = rule_labels) -> DataFrame:
    """(doc_id, finding_no, start, value, score, secret) of every candidate of
    every row: secret from a forest score of 0.5 on.

    Null and empty texts and texts without candidates give no rows. Rows with a
    null id are scanned like others; repeated rows give repeated results. With
    no findings of both labels the score is 0 and nothing is a secret. Other
    columns are not read.
    """
    trees, _, found = train(docs, id_col, text_col, label)
    score = forest_score(trees, [F.col(name) for name, _, _ in FEATURES])
    return found.select("doc_id", "finding_no", "start", "value", F.round(score, 9).alias("score")).withColumn("secret", F.col("score") >= THRESHOLD)


def redact(docs: DataFrame, trees: list[Tree], words: list[str], text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by REDACTED, in the
    row: no join, so ids need not be unique; texts without secrets, null ones
    included, stay as they are."""
    known = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")

    def piece(i: Column) -> Column:
        v, b, a = _around(i)
        secret = F.round(forest_score(trees, [f(v, b, a, known).cast("double") for _, f, _ in FEATURES]), 9) >= THRESHOLD
        return F.concat(F.get("pieces", i - 1), F.when(secret, F.lit(REDACTED)).otherwise(v))

    own = F.col("row").getField(text_col)
    cut = docs.select(packed(docs).alias("row")).withColumn("pieces", _cut(own))
    whole = F.concat(F.array_join(_each(piece), ""), F.element_at("pieces", -1))
    out = cut.withColumn("redacted", F.when(F.size("pieces") > 1, whole).otherwise(own))
    return out.select(*[F.col("redacted").alias(c) if c == text_col else col for c, col in zip(docs.columns, unpacked(docs.columns))])
