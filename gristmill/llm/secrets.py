"""Secret scans: candidates by pattern, false positives removed by a random forest. Candidates, features and scores are DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import discard, materialize

#: Words that stand before secrets and before digests that are none, and paths of examples.
NAMING = "token|secret|passw(?:or)?d|passphrase|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential|signature"
DIGESTS = "commit|revision|rev|sha-?[0-9]*|md5|hash|digest|checksum|etag|uuid|build|version"
SAMPLES = "test|example|sample|fixture|mock|demo|docs?/"
#: A name that says what is assigned to it, with the assignment. It is no part of the candidate that follows.
ASSIGNED = rf"(?=[A-Za-z0-9_\-]{{3,40}}+[\"'`]?[ \t]{{0,3}}+[:=])(?=[A-Za-z0-9_\-]{{0,24}}?(?i:{NAMING}))[A-Za-z0-9_\-]{{3,40}}+[\"'`]?[ \t]{{0,3}}[:=]>?[ \t]{{0,3}}[\"'`]?"
#: What is assigned: between quotes all up to the closing one on the line, signs behind a backslash too; without quotes all up to
#: white space, a quote or a tag, but for signs that end a clause.
QUOTED = "|".join(rf"(?<={q})(?=(?:[^{q}\\\r\n]|\\.){{6}})[^\r\n]{{6,}}?(?=(?<!\\){q})" for q in "\"'`")
PLAIN = r"(?:[^\s\"'`<]|<(?![/!A-Za-z])){5,}[^\s\"'`<>,;]"
#: What is looked at: what is assigned to such a name, private key blocks, signed web tokens, a name and password in an
#: address, and runs of sixteen and more letters, digits and signs of common encodings.
CANDIDATE = "|".join(
    [
        rf"(?<![A-Za-z0-9_\-]){ASSIGNED}(?:{QUOTED}|{PLAIN})",
        r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}",
        r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]+)?",
        r"(?<=://)[^\s/:@\"'`]{0,64}:[^\s/@\"'`]{3,}+(?=@)",
        r"[A-Za-z0-9_+/\-]{16,}={0,2}(?![A-Za-z0-9])",
    ]
)
#: Characters of text on either side that neighbouring words are taken from.
CONTEXT = 40
#: Labelled findings that the forest is trained on where the caller has none, and the forest's size.
FINDINGS = 6000
TREES, DEPTH = 20, 6
THRESHOLD = 0.5
MASK = "[SECRET]"
#: Common words and syllables that readable names are made of.
DICTIONARY = (
    "the|and|ing|tion|ment|able|ness|less|ful|ould|here|there|this|that|with|from|have|were|which|their|other|about|would|name|word|line|page|file|data|user|"
    "example|test|sample|value|number|string|index|table|list|part|work|time|year|people|place|thing|ver|ent|est|ion|ten|ein|sch|lich|ung|heit|keit|eux|eau|oi|que|elle|mente|ci|ado|os|es|er|on|an|en|in|re|th|st|nd|ed|ly|or|he|ha"
)
#: Words of sentences and of what stands for a value in forms.
PROSE = "a|an|the|of|to|and|or|is|are|was|were|be|not|no|in|on|at|for|with|that|this|it|he|she|they|you|we|who|what|his|her|my|your|please|enter|type|choose|forgot|new|must|here|never|nobody|knows"
FEATURES = ["length", "digits", "uppers", "transitions", "variety", "hex", "covered", "sample_path", "named", "digest", "assigned", "quoted", "vowels", "spaces", "prose"]


#: A tree: a leaf's share of secrets, or (feature, threshold, tree at or below it, tree above it).
Tree = float | tuple


def _running_sums(numbers: Column, block: int = 512) -> Column:
    """Sums of all numbers before each, by blocks, so that the work does not grow with the square of their count."""
    before = lambda xs: F.aggregate(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), F.array(F.lit(0)), lambda seen, x: F.concat(seen, F.array(F.element_at(seen, -1) + x)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / F.lit(block)).cast("int")), lambda j: F.slice(numbers, j * block + 1, block))
    totals = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(blocks, before(totals), lambda xs, start: F.transform(before(xs), lambda x: x + start)))


def _with_findings(rows: DataFrame, text: Column, path: Column) -> DataFrame:
    """Adds __m, the matches of a text, __gap, what stands between them, and __found, an array of (start, candidate, before, after, path).

    Each step is a column of its own, so that a text is searched once for each of the two.
    """
    rows = rows.withColumn("__m", F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), 0)).withColumn("__gap", F.split(text, CANDIDATE, -1))
    rows = rows.withColumn("__n", F.zip_with("__m", F.slice("__gap", 1, F.greatest(F.size("__m"), F.lit(1))), lambda m, g: F.length(m) + F.length(g)))
    rows = rows.withColumn("__at", _running_sums(F.col("__n")))

    def finding(at: Column, i: Column) -> Column:
        m, gap = F.get("__m", i), F.get("__gap", i)
        candidate = F.regexp_replace(m, f"^{ASSIGNED}", "")
        prefix = F.left(m, F.length(m) - F.length(candidate))
        before = F.concat(F.right(F.coalesce(F.get("__m", i - 1), F.lit("")), F.lit(CONTEXT)), F.right(gap, F.lit(CONTEXT)), prefix)
        after = F.concat(F.left(F.get("__gap", i + 1), F.lit(CONTEXT)), F.left(F.coalesce(F.get("__m", i + 1), F.lit("")), F.lit(CONTEXT)))
        start = at + F.length(gap) + F.length(prefix)
        return F.struct(start.cast("int").alias("start"), candidate.alias("candidate"), F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"), path.alias("path"))

    # The sums are what is gone through: read inside by their number, they would be added up anew for each finding.
    return rows.withColumn("__found", F.transform(F.slice("__at", 1, F.greatest(F.size("__m"), F.lit(0))), finding))


def features(get: Callable[[str], Column]) -> dict[str, Column]:
    """FEATURES of a finding; get gives its candidate, before, after and path."""
    c, before = get("candidate"), get("before")
    n = F.length(c).cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), "[a-z]", "8"), "[A-Z]", "7"), "[^0-9]", "6")
    share = lambda others: F.length(F.regexp_replace(c, others, "")).cast("double") / n
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    return {
        "length": n,
        "digits": share("[^0-9]"),
        "uppers": share("[^A-Z]"),
        "transitions": (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")).cast("double") - 1) / n,
        "variety": F.size(F.array_distinct(F.split(c, ""))).cast("double") / F.least(n, F.lit(40.0)),
        "hex": flag(c.rlike("^[0-9a-f]+$") | c.rlike("^[0-9A-F]+$")),
        "covered": 1 - F.length(F.regexp_replace(F.lower(c), DICTIONARY, "")).cast("double") / n,
        "sample_path": flag(F.lower(get("path")).rlike(SAMPLES)),
        "named": flag(F.lower(before).rlike(f"({NAMING})[^a-z0-9\\n]{{0,6}}$")),
        "digest": flag(F.lower(before).rlike(f"\\b({DIGESTS})[^a-z0-9\\n]{{0,6}}$")),
        "assigned": flag(before.rlike(r"[:=]\s*[\"'`]?$")),
        "quoted": flag(before.rlike("[\"'`]$") & get("after").rlike("^[\"'`]")),
        "vowels": share("[^aeiouAEIOU]"),
        "spaces": share("[^ ]"),
        "prose": 1 - F.length(F.regexp_replace(F.lower(c), rf"\b(?:{PROSE})\b", "")).cast("double") / n,
    }


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Rows (candidate, before, after, path, secret): what a scan finds in n texts that are made by a rule from their numbers, with labels.

    Half of the kinds of texts hold a secret: keys, short passwords with other signs, phrases, signed tokens, addresses with a password
    and key blocks. The others hold what scans wrongly report: long words, names, numbers, digests in prose, placeholders, plain
    words, sentences and code after a naming word, keys in paths of examples. A finding is a secret if it is the one that was put in.
    """
    i = F.col("id")
    pick = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)).cast("int")
    one_of = lambda k, *xs: F.get(F.array(*[F.lit(x) for x in xs]), pick(k, len(xs)))
    sha = lambda x: F.base64(F.unhex(F.sha2(F.concat(i, F.lit(x)).cast("binary"), 256)))

    def invented(k: int) -> Column:
        """Fifteen letters, consonants and vowels in turn, by the number."""
        sets = ("bcdfghlmnprst", "aeiou", "lmnrst")
        return F.concat(*[F.substring(F.lit(sets[j % 3]), F.pmod(F.xxhash64(i, F.lit(k), F.lit(j)), F.lit(len(sets[j % 3]))).cast("int") + 1, 1) for j in range(15)])

    parts = spark.range(n).select(
        i,
        F.concat(F.md5(F.concat(i, F.lit("a"))), F.md5(F.concat(i, F.lit("b")))).alias("hexes"),
        F.regexp_replace(sha("c"), "=", "").alias("base"),
        F.regexp_replace(sha("d"), "[=+/]", "").alias("more"),
        (F.lit(20) + pick(2, 24)).alias("size"),
        invented(1).alias("word"),
        invented(2).alias("other"),
        one_of(1, "token", "secret_key", "api_key", "password", "ACCESS_KEY", "auth_token", "DB_PASSWORD", "pwd").alias("name"),
        one_of(3, ' = "', ': "', "='", ' => "').alias("assign"),
        one_of(4, *"!@#$%&*?").alias("sign"),
    )
    hexes, base, more, size, word, other, name, assign, sign = (F.col(c) for c in parts.columns[1:])
    short = F.concat(F.substring(word, F.lit(1), 3 + pick(5, 5)), sign, F.substring(more, F.lit(1), 3 + pick(6, 4)), pick(7, 90).cast("string"))
    prose = F.concat(F.substring(word, 1, 5), F.lit(" "), F.substring(other, 3, 6), F.lit(" "))
    tail = F.concat(F.lit('" '), F.substring(other, 1, 7), F.lit(" ."))
    none = F.lit(None).cast("string")
    after = F.concat(F.lit(" "), prose)
    jwt = F.concat(F.lit("eyJ"), F.substring(more, 1, 20), F.lit(".eyJ"), more, F.lit("."), F.reverse(more))
    pem = F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), base, F.lit("\n"), more, F.lit("\n"))
    # Words between quotes: a phrase of invented ones is a secret, a sentence with common ones is none.
    phrase = F.concat_ws(" ", F.substring(word, F.lit(1), 4 + pick(10, 5)), F.substring(other, F.lit(2), 4 + pick(11, 5)), F.substring(word, F.lit(6), 4 + pick(12, 5)), F.substring(other, F.lit(7), 4 + pick(13, 5)))
    sentence = F.concat_ws(" ", one_of(14, "Enter your", "Please choose a", "The", "It was", "Forgot the", "nobody knows what", "You must not"), F.substring(word, 1, 6), one_of(15, "of the", "for this", "and", "to her", "in your", "is not"), F.substring(other, 2, 7))
    quote = one_of(16, *"\"'`")
    kinds = [
        (F.concat(prose, name, F.lit(" = "), quote), phrase, F.concat(quote, F.lit("\n")), "src/app"),
        (F.concat(name, F.lit(": "), quote), F.concat(short, F.lit(", "), F.substring(more, F.lit(9), 3 + pick(17, 6)), sign), F.concat(quote, F.lit(" ,")), "config"),
        (F.concat(F.upper(name), F.lit("=")), F.concat(short, one_of(18, *",;|>"), F.substring(more, F.lit(12), 4 + pick(19, 6))), F.lit("\n"), "env"),
        (F.concat(prose, name, F.lit(": "), quote, sentence, quote, F.lit(" ")), none, after, "src/app"),
        (F.concat(prose, F.substring(word, 1, 4), F.lit(" secret: "), quote, sentence, F.lit(", "), prose, quote, F.lit(" ")), none, after, "src/app"),
        (F.concat(prose, name, assign), F.substring(hexes, 1, 40), tail, "src/app"),
        (F.concat(prose, name, F.lit(": ")), F.substring(hexes, 1, 32), F.lit(" "), "src/app"),
        (F.concat(prose, name, assign), F.substring(base, F.lit(1), size), tail, "config"),
        (F.concat(prose, name, assign), F.concat(F.lit("AKIA"), F.upper(F.substring(hexes, 1, 16))), tail, "config"),
        (F.concat(prose, F.lit("Authorization: Bearer ")), F.concat(more, F.substring(hexes, 1, 8)), F.lit(" "), "src/app"),
        (F.concat(F.upper(F.substring(word, 1, 4)), F.lit("_"), name, F.lit("=")), F.substring(base, F.lit(1), size), F.lit("\n"), "env"),
        (F.concat(prose, name, assign), short, tail, "src/app"),
        (F.concat(name, F.lit(": ")), short, F.lit("\n"), "config"),
        (F.concat(prose, F.lit("jwt ")), jwt, F.lit(" "), "src/app"),
        (F.concat(prose, F.lit("postgres://")), F.concat(F.substring(word, 1, 5), F.lit(":"), short), F.lit("@db.host/x"), "config"),
        (prose, pem, F.lit("-----END RSA PRIVATE KEY-----"), "keys"),
        (F.concat(prose, name, assign), F.concat(more, F.lit("-"), F.substring(hexes, 1, 8)), tail, "src/app"),
        (F.concat(prose, word, other, F.lit(" ")), none, after, "src/app"),
        (F.concat(prose, F.concat_ws("_", F.substring(word, 1, 7), F.substring(other, 1, 8), F.substring(word, 4, 6))), none, F.lit("() "), "src/app"),
        (F.concat(prose, F.substring(F.conv(F.substring(hexes, 1, 14), 16, 10), 1, 16)), none, after, "src/app"),
        (F.concat(prose, one_of(9, "commit ", "sha256: ", "md5 ", "digest = ", "revision "), F.substring(hexes, 1, 40)), none, after, "src/app"),
        (F.concat(prose, name, assign, F.substring(F.repeat(F.lit("xxxxYOUR_KEY_HERE0000"), 3), F.lit(1), size)), none, tail, "src/app"),
        (F.concat(prose, name, assign, F.substring(base, F.lit(1), size)), none, tail, "tests/fixtures/sample"),
        (F.concat(prose, name, F.lit(": "), F.substring(other, F.lit(1), 6 + pick(8, 7))), none, after, "src/app"),
        (F.concat(prose, name, F.lit(" = os.environ['"), F.upper(word), F.lit("']")), none, after, "src/app"),
        (F.concat(prose, name, F.lit(" = "), F.substring(word, 1, 5), F.lit(".get("), F.substring(other, 1, 6)), none, F.lit(") "), "src/app"),
        (F.concat(prose, F.lit("https://"), F.substring(word, 1, 8), F.lit(".org/"), other, F.lit("/"), word), none, F.lit(" "), "src/app"),
        (F.concat(prose, F.concat_ws("-", F.substring(word, 1, 5), F.substring(other, 1, 6), F.substring(word, 5, 6), F.lit("2024"))), none, after, "src/app"),
        (F.concat(prose, F.upper(F.concat(word, other))), none, after, "src/app"),
    ]
    made = None
    for k, (b, planted, a, p) in enumerate(kinds):
        row = F.struct(F.concat(b, F.coalesce(planted, F.lit("")), a).alias("text"), planted.alias("planted"), F.lit(p).alias("at"))
        of_kind = F.pmod("id", F.lit(len(kinds))) == k
        made = F.when(of_kind, row) if made is None else made.when(of_kind, row)
    texts = materialize(parts.select(made.alias("r")).select("r.*"), "texts-of-secrets")
    found = _with_findings(texts, F.col("text"), F.col("at")).select("planted", F.explode_outer("__found").alias("f")).where("f IS NOT NULL")
    findings = found.select("f.candidate", "f.before", "f.after", "f.path", F.coalesce(F.col("f.candidate") == F.trim(F.col("planted")), F.lit(False)).cast("int").alias("secret"))
    findings = materialize(findings, "findings")
    discard(texts)
    return findings


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> list[Tree]:
    """Trains a random forest on labelled findings (candidate, before, after, path, secret), which are at most a table for people to label."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    measured = findings.withColumns(features(F.col))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(measured).select("v", F.col("secret").cast("double").alias("label"))
    model = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, maxDepth=depth, seed=5).fit(rows.coalesce(1))
    return [_read_tree(t._call_java("rootNode")) for t in model.trees]


def _read_tree(node) -> Tree:  # noqa: ANN001
    if node.getClass().getSimpleName() == "LeafNode":
        counts = list(node.impurityStats().stats())
        return round(counts[1] / max(1e-9, sum(counts)), 6)
    split = node.split()
    return (FEATURES[split.featureIndex()], split.threshold(), _read_tree(node.leftChild()), _read_tree(node.rightChild()))


def _vote(tree: Tree, get: Callable[[str], Column]) -> Column:
    """A tree as a conditional expression."""
    if isinstance(tree, float):
        return F.lit(tree)
    feature, threshold, low, high = tree
    return F.when(get(feature) <= threshold, _vote(low, get)).otherwise(_vote(high, get))


def _mean(forest: list[Tree], get: Callable[[str], Column]) -> Column:
    return F.round(sum((_vote(t, get) for t in forest), F.lit(0.0)) / len(forest), 6)


def _path(docs: DataFrame, path_col: str | None) -> Column:
    return F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col and path_col in docs.columns else F.lit("")


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, start, candidate, before, after, path, score, is_secret), one for each candidate, repeated or not; start counts characters from 0.

    Without findings, those made by rule are learned from. Texts without a candidate, null and empty ones too, are passed over by
    one search; very long ones are searched whole. A path that is null, or no path_col, counts as empty. The work of a row stays
    in it: nothing is joined or shuffled. An empty table gives no rows.
    """
    forest = train_forest(labelled_findings(docs.sparkSession) if findings is None else findings)
    kept = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), _path(docs, path_col).alias("path")).where(F.col("text").rlike(CANDIDATE))
    # The outer form: from the inner one Spark infers a filter on the array, for which all steps before would be computed again.
    found = _with_findings(kept, F.col("text"), F.col("path")).select("doc_id", F.explode_outer("__found").alias("r")).where("r IS NOT NULL").select("doc_id", "r.*")
    return scored(found, forest, threshold)


def scored(findings: DataFrame, forest: list[Tree], threshold: float = THRESHOLD) -> DataFrame:
    """Adds score, the mean over trees, and is_secret to findings."""
    names = {f"__{k}": v for k, v in features(F.col).items()}
    measured = findings.withColumns(names).withColumn("score", _mean(forest, lambda k: F.col(f"__{k}")))
    return measured.drop(*names).withColumn("is_secret", F.col("score") >= threshold)


def mask_secrets(docs: DataFrame, findings: DataFrame | None = None, text_col: str = "text", path_col: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """docs, rows and columns alike, with each secret in text_col replaced by MASK; the name that it is assigned to stays. Null texts stay null, others are searched whole. Other columns pass as they are, whatever their names."""
    forest = train_forest(labelled_findings(docs.sparkSession) if findings is None else findings)
    text = F.col(f"`{text_col}`")
    # The caller's columns travel in one struct, so that none is taken for one of these steps.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), _path(docs, path_col).alias("path"))
    rows = _with_findings(whole, F.col("text"), F.col("path"))
    measured = F.transform("__found", lambda x: F.struct(F.length(x["candidate"]).alias("n"), *[v.alias(k) for k, v in features(lambda k: x[k]).items()]))
    voted = F.transform(measured, lambda x: F.struct(x["n"].alias("n"), (_mean(forest, lambda k: x[k]) >= threshold).alias("is_secret")))
    parts = F.zip_with("__m", voted, lambda m, x: F.when(x["is_secret"], F.concat(F.left(m, F.length(m) - x["n"]), F.lit(MASK))).otherwise(m))
    masked = F.array_join(F.zip_with("__gap", parts, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    told = rows.select("row", F.when(F.size("__m") > 0, masked).otherwise(F.col("text")).alias("text"))
    return told.select([F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
