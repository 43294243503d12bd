"""Secret scan with DataFrame and ML functions only: candidates by pattern, false positives out by a random forest.

A candidate is a long run of key characters with a digit or a known prefix, or the value behind a word such as ``password``
and a sign, or behind the word and ``is``, if it has a digit or a mark.
Its features are the logarithm of its length, the changes between character classes, the shares of digits, capitals
and hexadecimal digits, the share covered by dictionary words, whether the path (the ``source`` column,
where there is one) looks like tests or examples, and the words before it.  The forest is trained from
labelled findings: ``labelled_findings`` derives a fixed number of them from a rule, and a table of one's
own with the same columns can be given instead.

A name and its value may have any number of blanks on either side of the sign; keys, values and texts of any length count
whole.  The words before a candidate are the last ``CONTEXT`` characters, blanks taken together.

Defined cases: null and empty text have no findings; overlapping candidates can't occur; repeated rows
report once for each ``doc_id`` and text; null ``doc_id`` and null ``source`` are allowed; ``redact`` keeps every row and every column, null text stays null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import workspace

# Words whose values are candidates, words that speak for and against a secret, dictionary words.
NAMES = r"passw(?:or)?d|passphrase|passcode|(?<![A-Za-z])pass|pwd|secret|token|auth(?:orization)?|credentials?|(?:api|access|secret|private|signing|encryption)[_-]?key"
PREFIXES = "AKIA|ASIA|ghp_|gho_|github_pat_|xox[abp]-|sk-|sk_live_|rk_live_|AIza|glpat-|npm_|eyJ"
NAME = f"(?i:{NAMES})"
CLOSED, OPENED = r"[\"']?\]?\s*+[=:]", r"\s*+(?:(?i:bearer|basic)\s++)?+[\"']?"
# A long run of key characters; and what a value may be: such a run, else what ends with a blank, quote or comma.
KEY = rf"(?={PREFIXES}|[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{{16,}}+={{0,2}}"
VALUE = rf"(?!{NAME}{CLOSED})({KEY}|[^\s\"',;]{{6,}}+)"
# Group 1 is a run, group 2 the value where the run ends with a name, groups 3 and 4 the values of a name alone; a value ends its match.
MATCH = (
    rf"(?<![A-Za-z0-9_+/-])({KEY})(?:(?:(?<={NAME}){CLOSED}|(?<={NAME}={{1,2}})){OPENED}{VALUE})?"
    rf"|{NAME}(?:{CLOSED}{OPENED}{VALUE}|\s++(?i:is)\s++[\"']?(?=[^\s\"',;]*[0-9!@#$%^&*])([^\s\"',;]{{6,}}+))"
)
GROUPS = 4
# A text with a candidate has a run with a digit or a known prefix (KEYED), or a sign behind a name or a blank, or "is" behind those (NAMED), after
# which MATCH decides.  A run's first digit has seven run characters before it or nine behind it (DIGIT): digits and signs are few, so most texts
# are read a few times by patterns that begin with one and by plain searches (a pair: only where the first is there, one of the second), no more.
KEYED = rf"(?<![A-Za-z0-9_+/-])(?={PREFIXES}|[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{{16}}"
DIGIT = r"[0-9](?:(?=[\w+/-]{9})|(?<=[\w+/-]{8}))"
MARKS = (("_", ("ghp_", "gho_", "github_pat_", "sk_live_", "rk_live_", "npm_")), ("IA", ("AKIA", "ASIA")), ("xox", ("xoxa-", "xoxb-", "xoxp-")), ("sk-", ()), ("AIza", ()), ("glpat-", ()), ("eyJ", ()))
SIGNED = rf"[=:](?<=(?:{NAME}[\"']?\]?|\s)[=:])"
IS = rf"\s(?i:is)\s(?<=(?:{NAME}|\s)\s(?i:is)\s)"
CONTEXT = 40
FOR = r"(?i)(password|passwd|pwd|secret|token|(api|access|secret|private|signing|encryption).?key|auth|bearer|credential|aws)\W*$"
AGAINST = r"(?i)(sha\d*|md5|commit|uuid|checksum|digest|hash|revision|card|phone|serial|order|isbn|example|version)\W*$"
PREFIX = rf"^({PREFIXES})"
PATHS = r"(?i)(test|example|sample|fixture|mock|docs?/|readme)"
DICTIONARY = "example sample test dummy placeholder your here change replace insert password secret token value string name user admin default config setting data file path class function return import public private static const object array number null true false foo bar baz hello world lorem ipsum the and for with from this that have".split()
FEATURES = ("length", "transitions", "digits", "capitals", "hexes", "distinct", "dictionary", "path", "spoken_for", "spoken_against", "prefix", "only_digits", "assigned")


def has_candidate(text: Column) -> Column:
    """Whether a candidate is in the text; false for null."""
    marked = [text.contains(first) & reduce(Column.__or__, map(text.contains, each)) if each else text.contains(first) for first, each in MARKS]
    keyed = (text.rlike(DIGIT) | reduce(Column.__or__, marked)) & text.rlike(KEYED)
    named = (((text.contains("=") | text.contains(":")) & text.rlike(SIGNED)) | text.rlike(IS)) & text.rlike(MATCH)
    return F.coalesce(keyed | named, F.lit(False))


def _matches(text: Column) -> Column:
    """In order, with the text up to each match: ``piece, whole, run, value``; run and value are empty where there is none.

    The text is searched for whole matches only; a match, a short text, is then taken apart.
    """
    def parts(m: Column) -> Column:
        whole = F.coalesce(m["whole"], F.lit(""))
        group = lambda k: F.regexp_extract(whole, MATCH, k)
        value = F.concat(*map(group, range(2, GROUPS + 1)))  # one of them at most has signs
        return F.struct(m["piece"].alias("piece"), m["whole"].alias("whole"), group(1).alias("run"), value.alias("value"))

    return F.transform(F.arrays_zip(F.split(text, MATCH, -1).alias("piece"), F.regexp_extract_all(text, F.lit(MATCH), F.lit(0)).alias("whole")), parts)


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, source, number, start, token, before`` of every candidate; ``start`` counts code points.

    A match has two numbers: an even one for its run, the odd one after it for its value.
    """
    # The outer explode has no filter of its own, which Spark would put beside has_candidate and so match every text.
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.filter(has_candidate(F.col("text"))).select("doc_id", F.xxhash64("text").alias("text_hash"), path.alias("source"), _matches(F.col("text")).alias("matches"))
    rows = rows.select("doc_id", "text_hash", "source", F.posexplode_outer("matches").alias("i", "m")).select("doc_id", "text_hash", "source", "i", "m.*").filter("whole is not null").dropDuplicates(["doc_id", "text_hash", "i"])
    order = Window.partitionBy("doc_id", "text_hash").orderBy("i")
    rows = rows.withColumn("from", F.sum((F.char_length("piece") + F.coalesce(F.char_length(F.lag("whole").over(order)), F.lit(0))).cast("long")).over(order))
    cut = F.char_length("whole") - F.char_length("value")
    near = F.right("piece", F.lit(300))
    both = F.array(
        F.struct((2 * F.col("i")).alias("number"), F.col("from").alias("start"), F.col("run").alias("token"), near.alias("before")),
        F.struct((2 * F.col("i") + 1).alias("number"), (F.col("from") + cut).alias("start"), F.col("value").alias("token"), F.concat(near, F.substr("whole", F.lit(1), cut)).alias("before")),
    )
    each = rows.select("doc_id", "text_hash", "source", F.inline(both)).filter("token != ''")
    return each.withColumn("before", F.right(F.regexp_replace("before", r"\s+", " "), F.lit(CONTEXT)))


def _share(token: Column, pattern: str) -> Column:
    n = F.greatest(F.char_length(token), F.lit(1))
    return F.regexp_count(token, F.lit(pattern)) / n


def featured(found: DataFrame) -> DataFrame:
    """``found(token, source, before)`` with the forest's features."""
    t = F.col("token")
    n = F.char_length(t)
    bare = F.lower(t)
    covered = reduce(lambda x, w: F.replace(x, F.lit(w), F.lit("")), sorted(DICTIONARY, key=lambda w: (-len(w), w)), bare)
    changes = F.regexp_count(t, F.lit(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return found.withColumns({
        "length": F.log2(F.greatest(n, F.lit(1)).cast("double")), "transitions": changes / F.greatest(n, F.lit(1)), "digits": _share(t, "[0-9]"), "capitals": _share(t, "[A-Z]"), "hexes": _share(t, "[0-9a-f]"),
        "distinct": F.size(F.array_distinct(F.split(t, ""))) / F.greatest(n, F.lit(1)), "dictionary": 1 - F.char_length(covered) / F.greatest(n, F.lit(1)),
        "path": flag(F.col("source").rlike(PATHS)), "spoken_for": flag(F.col("before").rlike(FOR)), "spoken_against": flag(F.col("before").rlike(AGAINST)),
        "prefix": flag(t.rlike(PREFIX)), "only_digits": flag(t.rlike("^[0-9_+/=-]+$")), "assigned": flag(F.col("before").rlike("[=:]\\s*[\"']?$")),
    })


def labelled_findings(spark: SparkSession, n: int = 3600) -> DataFrame:
    """``token, source, before, label``: findings made by a rule, half of them secrets."""
    h, g = F.sha2(F.col("id").cast("string"), 256), F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 512)
    base32 = F.upper(F.translate(g, "0189", "WXYZ"))
    mixed = F.translate(F.base64(F.unhex(g)), "+/=", "Qz7")
    key = lambda a, n: F.substring(a, 1, n)
    word = F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.col("id") % len(DICTIONARY) + 1).cast("int"))
    other = F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.col("id") * 7 % len(DICTIONARY) + 1).cast("int"))
    rules = [  # token, before, label
        (F.concat(F.lit("AKIA"), key(base32, 16)), "the key is ", 1), (key(h, 18), "password=", 1), (key(h, 40), 'token = "', 1), (F.concat(F.lit("ghp_"), key(mixed, 36)), "use ", 1),
        (key(mixed, 40), "aws_secret_access_key = ", 1), (F.concat(F.lit("sk-"), key(mixed, 32)), "api_key: ", 1), (F.concat(F.lit("AKIA"), key(base32, 16)), "and of the ", 1), (key(mixed, 12), "passwd: ", 1), (key(h, 24), 'secret="', 1),
        (key(h, 40), "commit ", 0), (h, "sha256 ", 0), (F.translate(key(h, 16), "abcdef", "123456"), "and the ", 0), (F.concat(word, F.lit("_"), other, F.lit("_key_"), F.col("id") % 10), "password=", 0),
        (F.concat(key(h, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 13, 3), F.lit("-a"), F.substring(h, 16, 3), F.lit("-"), F.substring(h, 20, 12)), "uuid ", 0),
        (F.concat(word, F.lit("/"), other, F.lit("/"), word, F.lit("/v"), F.col("id") % 10), "see ", 0), (F.concat(word, F.lit("-"), other, F.lit("-"), word, F.lit("-20"), F.col("id") % 90 + 10), "of the ", 0),
        (F.concat(F.repeat(F.lit("x"), 12), F.col("id") % 10000), "token: ", 0), (F.concat(F.lit("your_"), word, F.lit("_here_"), F.col("id") % 10), 'secret = "', 0),
    ]
    kind = F.col("id") % len(rules)
    pick = lambda i: reduce(lambda c, k: c.when(kind == k, rules[k][i] if isinstance(rules[k][i], Column) else F.lit(rules[k][i])), range(1, len(rules)), F.when(kind == 0, rules[0][i] if isinstance(rules[0][i], Column) else F.lit(rules[0][i])))
    where = F.when(F.col("id") % 5 == 0, "tests/example.py").when(F.col("id") % 5 == 1, "src/settings.py")
    return spark.range(0, n, 1, 1).select(pick(0).alias("token"), where.alias("source"), pick(1).alias("before"), pick(2).cast("double").alias("label"))


def fit(labelled: DataFrame, trees: int = 20, depth: int = 6, seed: int = 5) -> RandomForestClassificationModel:
    """A forest from ``labelled(token, source, before, label)``, a table of bounded size."""
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured(labelled))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vectors.select("features", "label"))


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = 0.5) -> DataFrame:
    """``doc_id, text_hash, number, start, length, token, score, is_secret`` of every candidate."""
    model = model or fit(labelled_findings(docs.sparkSession))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured(candidates(docs)))
    scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "text_hash", "number", "start", F.char_length("token").cast("long").alias("length"), "token", "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = 0.5, mask: str = "<secret>") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``.

    Only documents with a candidate meet the findings; they are written, so that all texts are searched twice and no more, here
    and where the result is read.  All others pass without a shuffle.
    """
    whole = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), "text")  # no name of ``docs`` clashes
    has = has_candidate(F.col("text"))
    some = workspace.written(whole.filter(has).select("doc", "id", F.xxhash64("text").alias("hash")), "candidates")
    bad = scan(some.select("doc.*"), model, threshold).filter("is_secret").groupBy("doc_id", "text_hash").agg(F.collect_set("number").alias("numbers"))
    met = some.join(bad, some["id"].eqNullSafe(bad["doc_id"]) & (some["hash"] == bad["text_hash"]), "left")
    hidden = lambda t, n: F.when((t != "") & F.array_contains("numbers", n), mask).otherwise(t)

    def shown(m: Column, i: Column) -> Column:
        run, whole, value = m["run"], m["whole"], m["value"]
        between = F.substr(whole, F.char_length(run) + 1, F.char_length(whole) - F.char_length(run) - F.char_length(value))
        return F.concat(m["piece"], F.when(whole.isNull(), F.lit("")).otherwise(F.concat(hidden(run, 2 * i), between, hidden(value, 2 * i + 1))))

    text = F.array_join(F.transform(_matches(F.col("doc.text")), shown), "")
    met = met.select(F.when(F.col("numbers").isNull(), F.col("doc")).otherwise(F.col("doc").withField("text", text)).alias("doc"))
    return whole.filter(~has).select("doc").unionByName(met).select("doc.*")
