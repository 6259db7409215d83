r"""Secret scan: candidates by rule, false positives removed by a random forest; DataFrame and JVM code only.

A candidate is a run of at least ``LEAST`` characters of ``[A-Za-z0-9+/_-]`` that has a digit, or whose word (white space
separates) or the word before holds a key. A word may have many (JSON without spaces, URLs, connection strings): each is a
candidate of its own, told apart by ``run_index``, its number among the word's runs, and is judged by what stands between it
and the runs next to it; only the outer ones see the neighbouring words.

A value assigned to a key is a candidate too, from ``SHORT`` characters, whatever symbols it has: what follows a key and ``=``
or ``:``, up to the closing quote, or, unquoted, up to white space or a separator (``& ; , |``) with another name and ``=`` or
``:``. Closing quotes, brackets, commas and semicolons at its end are not part of it, nor is the host after a URL's user part. A quoted value may hold up to
``QUOTED`` words; without a closing quote it ends at white space. Key, sign and value may be words of their own. Such values
are numbered before the runs of the word; a run that is also an assigned value of its word is judged once, as the latter.

The features are the length; the character
transitions (between classes, and between vowels and consonants), shares of classes and of distinct characters; the share
that dictionary words cover; the share of other symbols; its path (of the candidate itself, and of its document); and its neighbouring words (keys,
words that mark placeholders, words that mark digests); whether it follows ``=`` or ``:`` directly, and precedes ``@``.

The forest is trained from labelled findings: rows (before, word, after, path, label); a column ``value`` may name the run
that is meant, else the label holds for all runs of the word. Without own findings, ``findings()``
makes a labelled set by rules: keys, tokens and passwords of random characters, against placeholders, digests, identifiers,
paths and long words. The forest has ``TREES`` trees of depth ``DEPTH``; its seed is fixed and its training rows are in one
partition, so it is the same each time.

Null and empty texts have no candidates. A null path counts as empty. Repeated rows give repeated findings, an empty table none.
Equal scores need no order: each candidate is judged by itself. Words of any length are read whole, with patterns that pass a
word once: what a candidate needs of its word goes into the candidate's own row. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mediaframe.llm.common import one_column

LEAST = 16
SHORT, QUOTED = 6, 16
TREES, DEPTH, SEED = 40, 8, 11
FINDINGS = 6000
RUN = rf"([A-Za-z0-9+/_-]{{{LEAST},}})"
KEYS = "password|passwd|pwd|secret|token|api_?key|apikey|access_?key|auth|credential|private_?key"
#: A key with what may close it, the sign, and a value in or without quotes, which group 1 holds.
NAME = rf"(?i:{KEYS})\\{{0,4}}[\"'`]?\]?"
SIGN = r"(?::=|=>|[=:])"
VALUE = "(" + "|".join(rf"\\{{1,4}}{q}(?:[^{q}\\]|\\[^{q}])*+\\{{1,4}}{q}|{q}(?:[^{q}\\]|\\.)*+{q}|\\{{0,4}}{q}[^{q}\s]*+" for q in "\"'")
VALUE += r"|(?!=)(?:(?!\\{0,4}[\"']?[&;,|]\\{0,4}[\"']?[A-Za-z_][\w.-]*+\\{0,4}[\"']?[=:])\S)++)"
PLACEHOLDERS = "example|sample|test|dummy|fake|mock|placeholder|changeme|your|redacted|xxxx|insert|todo"
DIGESTS = "sha1|sha256|sha512|md5|commit|digest|checksum|hash|etag|uuid|guid|revision|build"
PATHS = "test|example|sample|mock|fixture|spec|docs?/|readme"
#: Words whose presence inside a candidate speaks for text.
DICTIONARY = (
    "account admin access alpha auth back base beta bin body book build cache case change check class client code color column "
    "com config content copy count create data date default delete demo design detail dev device doc document domain down "
    "dummy edit email end error event example fake false field file final first font form from function get group handler "
    "head hello help home host html http image index info input insert item java key label large last layout left level lib "
    "line link list load local location log login long main manager map max media menu message meta method mode model module "
    "name network next node none note null number object off old open option order org out page param parent part pass path "
    "place placeholder player point post print private process product profile project public query random read record "
    "redacted remote report request reset response result return right role root route sample save script search secret "
    "section select server service session set setting share show side sign site size sort source spec start state static "
    "status step stop store string style sub submit sum support sync system table tag target task temp template test text "
    "theme time title todo token tool top total track true type unit update upload url user util value version video view "
    "web welcome widget width window word work world write your"
).split()

FEATURES = (
    "length", "transitions", "digits", "upper", "hex", "distinct", "vowel_changes", "runs", "covered",
    "slashes", "dashes", "path", "key", "placeholder", "digest", "assigned", "known", "bound", "at", "symbols",
)


def candidates(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """(key, word_index, before, word, after, path, run_index, left, value, right): the candidates with their neighbours."""
    docs = one_column(documents, key=key, text=text, **({"path": path} if path else {}))
    docs = docs.withColumn("path", F.coalesce("path", F.lit("")) if path else F.lit(""))
    # the filter sees the place of a word, so that its neighbours come along; most words end at the test of their length
    words = docs.select("key", "path", F.split("text", r"\s+").alias("w"))
    before = lambda i: F.coalesce(F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1)), F.lit(""))
    signs = lambda i: F.get("w", i).contains("=") | F.get("w", i).contains(":")
    named = lambda i: (F.length(F.get("w", i)) >= SHORT) & (
        (signs(i) & F.get("w", i).rlike(f"{NAME}{SIGN}"))
        | (F.coalesce(F.get("w", i - 1), F.lit("")).rlike("[=:>]$") & before(i).rlike(rf"{NAME}\s?{SIGN}$"))
        | (F.get("w", i).rlike(f"^{SIGN}") & before(i).rlike(f"{NAME}$"))
    )
    at = F.filter(
        F.sequence(F.lit(0), F.size("w") - 1),
        lambda i: named(i)
        | (F.length(F.get("w", i)) >= LEAST)
        & F.get("w", i).rlike(RUN)
        & (F.exists(F.regexp_extract_all(F.get("w", i), F.lit(RUN), F.lit(1)), lambda v: v.rlike("[0-9]")) | F.get("w", i).rlike(rf"(?i)({KEYS})[\"']?[=:]") | F.coalesce(F.get("w", i - 1), F.lit("")).rlike(rf"(?i)({KEYS})[\"']?[=:]?$")),
    )
    row = lambda i: F.struct(i.alias("word_index"), before(i).alias("before"), F.get("w", i).alias("word"), F.coalesce(F.get("w", i + 1), F.lit("")).alias("after"), F.array_join(F.slice("w", i + 2, QUOTED - 1), " ").alias("rest"))
    found = words.where("size(w) > 0").select("key", "path", F.explode(F.transform(at, row)).alias("c"))
    return with_values(found.select("key", "c.*", "path"), True)


def with_values(found: DataFrame, likely: bool = False) -> DataFrame:
    """One row for each assigned value and each run of `word`: adds run_index, left, value and right, and cuts before, word and
    after to what the candidate sees. `rest`, if found has it, is the text after word, for quoted values of many words.

    likely: only runs with a digit, or of words by a key. If found has `value`, only candidates equal to it, where it is not null.
    """
    found = found.withColumn("rest", F.lit(None).cast("string")) if "rest" not in found.columns else found
    found = found.withColumn("__text", F.concat_ws(" ", "word", "rest"))
    piece = lambda left, value, right, run, first, last: F.struct(
        F.when(first, F.col("before")).otherwise("").alias("before"), left.alias("left"), value.alias("value"), right.alias("right"), F.when(last, F.col("after")).otherwise("").alias("after"), run.cast("int").alias("run")
    )
    head = rf"(\S*?{NAME}{SIGN})"
    led = F.when(F.col("before").rlike(rf"{NAME}\s?{SIGN}$"), F.regexp_extract("__text", f"^{VALUE}", 1)).when(F.col("before").rlike(f"{NAME}$"), F.regexp_extract("__text", f"^{SIGN}{VALUE}", 1))
    whole = lambda left, value, first: piece(left, value, F.lit(""), F.lit(-1), first, F.lit(True))
    assigned = F.concat(
        F.array(whole(F.lit(""), tidy(F.coalesce(led, F.lit(""))), F.lit(True))),
        F.transform(
            F.regexp_extract_all("__text", F.lit(rf"\G{head}{VALUE}"), F.lit(0)),
            lambda m, k: whole(F.regexp_extract(m, f"^{head}{VALUE}", 1), in_url(F.regexp_extract(m, f"^{head}{VALUE}", 1), tidy(F.regexp_extract(m, f"^{head}{VALUE}", 2))), k == 0),
        ),
    )
    rows = found.withColumn("__assigned", F.filter(assigned, lambda p: F.length(p["value"]) >= SHORT))
    rows = rows.withColumn("__runs", F.regexp_extract_all("word", F.lit(RUN), F.lit(1))).withColumn("__gaps", F.split("word", RUN, -1))
    rows = rows.withColumn("__taken", F.transform("__assigned", lambda p: p["value"]))
    rows = rows.withColumn("__keyed", F.col("word").rlike(rf"(?i)({KEYS})[\"']?[=:]") | F.col("before").rlike(rf"(?i)({KEYS})[\"']?[=:]?$"))
    # a run, and what stands before and after it: whatever a candidate needs goes into its own struct, so that no row
    # carries the whole word
    n = F.size("__runs")
    sided = F.zip_with(F.zip_with(F.slice("__gaps", F.lit(1), n), "__runs", lambda x, v: F.struct(x.alias("left"), v.alias("value"))), F.slice("__gaps", F.lit(2), n), lambda x, r: F.struct(x["left"].alias("left"), x["value"].alias("value"), r.alias("right")))
    rows = rows.withColumn("__sided", sided)
    runs = F.transform("__sided", lambda x, k: piece(x["left"], x["value"], x["right"], k, k == 0, k == n - 1))
    fresh = lambda p: (p["run"] < 0) | ~F.array_contains("__taken", p["value"])
    # numbered before any goes
    rows = rows.withColumn("__all", F.transform(F.concat("__assigned", runs), lambda p, k: F.struct(k.cast("int").alias("run_index"), *[p[c].alias(c) for c in ("before", "left", "value", "right", "after", "run")])))
    rows = rows.withColumn("__all", F.filter("__all", fresh))
    if likely:  # the test of the whole word stands outside of the lambda, where it is made once
        rows = rows.withColumn("__all", F.when(F.col("__keyed"), F.col("__all")).otherwise(F.filter("__all", lambda p: (p["run"] < 0) | p["value"].rlike("[0-9]"))))
    # an outer explode: from a plain one a filter on the array's size would be inferred and pushed below, made of all of the above
    keep = [c for c in found.columns if c not in ("before", "word", "after", "rest", "__text", "value", "run_index", "left", "right")]
    rows = rows.select(*keep, *([F.col("value").alias("__meant")] if "value" in found.columns else []), F.explode_outer("__all").alias("p")).where("p IS NOT NULL")
    if "value" in found.columns:
        rows = rows.where(F.col("__meant").isNull() | (F.col("p.value") == F.col("__meant")))
    word = F.concat("p.left", "p.value", "p.right").alias("word")
    return rows.select(*keep, "p.before", word, "p.after", "p.run_index", "p.left", "p.value", "p.right")


def in_url(left: Column, value: Column) -> Column:
    """In the user part of a URL a value ends before the @ and the host."""
    return F.when(left.rlike("://[^/]*$"), F.regexp_replace(value, "@[^@/]*(?:/.*)?$", "")).otherwise(value)


def tidy(value: Column) -> Column:
    """A value of VALUE without its quotes, or, unquoted, without what closes it."""
    quoted = F.regexp_replace(F.regexp_replace(value, r"^\\{0,4}[\"']", ""), r"\\{0,4}[\"']$", "")
    return F.when(value.rlike(r"^\\{0,4}[\"']"), quoted).otherwise(F.regexp_replace(value, r"^[`(]|[\\\"'`,;)\]}>]++$", ""))


def count(pattern: str, of: Column) -> Column:
    return F.length(of) - F.length(F.regexp_replace(of, pattern, ""))


def with_features(found: DataFrame) -> DataFrame:
    """Adds a double column for each of FEATURES; needs the columns of `with_values` and path."""
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    vowels = F.regexp_replace(F.regexp_replace(F.lower(v), "[aeiouy]", "!"), "[a-z]", "#")
    changes = lambda s: F.length(F.regexp_replace(s, r"(.)\1+", "$1")) - 1
    around = F.lower(F.concat_ws(" ", "before", "left", "right", "after"))
    inside = F.lower(F.concat_ws(" ", "before", "word", "after"))
    longest = "|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=lambda w: (-len(w), w)))
    made = {
        "length": F.length(v),
        "transitions": changes(classes) / n,
        "digits": count("[0-9]", v) / n,
        "upper": count("[A-Z]", v) / n,
        "hex": v.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("int"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "vowel_changes": changes(vowels) / n,
        "runs": (F.length(v) - F.length(F.regexp_replace(v, r"(.)\1+", "$1"))) / n,
        "covered": count(longest, F.lower(v)) / n,
        "slashes": count("/", v) / n,
        "dashes": count("[-_]", v) / n,
        "path": F.lower("path").rlike(PATHS).cast("int"),
        "key": inside.rlike(KEYS).cast("int"),
        "placeholder": inside.rlike(PLACEHOLDERS).cast("int"),
        "digest": around.rlike(DIGESTS).cast("int"),
        "assigned": F.col("word").rlike("[=:]").cast("int") + F.col("before").rlike("[=:]$").cast("int"),
        "known": v.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}|^xox[abprs]-|^sk_live_").cast("int"),
        "bound": F.col("left").rlike(r"[=:][\\\"'`]*$").cast("int"),
        "symbols": count("[^A-Za-z0-9+/_-]", v) / n,
        "at": F.col("right").startswith("@").cast("int"),
    }
    return found.select("*", *[F.coalesce(made[c].cast("double"), F.lit(0.0)).alias(f"f_{c}") for c in FEATURES])


def findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """Labelled findings made by rules: (before, word, after, path, value, label), half of them secrets; value: the run meant."""
    i = F.col("id")
    hexa = F.lower(F.concat(*[F.sha1(F.concat_ws("-", i, F.lit(f"h{k}")).cast("binary")) for k in range(2)]))
    sixty4 = F.translate(F.base64(F.unhex(F.sha2(F.concat_ws("-", i, F.lit("b")).cast("binary"), 512))), "=\n", "")
    upper = F.upper(F.translate(sixty4, "+/abcdefgh", "7Q234567KM"))
    pick = lambda seed, *options: F.element_at(F.array(*[F.lit(o) if isinstance(o, str) else o for o in options]), (F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(len(options))) + 1).cast("int"))
    vary = lambda seed, low, high: (F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(high - low + 1)) + low).cast("int")
    plain = pick(1, "the value of", "and then", "is for", "see also", "in this", "with a", "", "we have")
    word = lambda seed: pick(seed, *DICTIONARY)
    key = pick(2, "token", "password", "secret", "api_key", "apikey", "access_key", "auth", "pwd")
    quoted = lambda v: pick(3, F.concat(F.lit('"'), v, F.lit('"')), F.concat(F.lit("'"), v, F.lit("'")), v)
    scheme = pick(14, "https", "postgres", "mysql", "redis", "amqp")
    some = F.expr("substring(translate(b, '+/', 'aZ'), 20, n)")
    place = F.concat(F.lit(".internal/"), word(24), F.lit("_"), word(25), F.lit("/"), word(26), pick(15, "_main", "-2024", "/repository", "_v2"), F.lit("/index"))
    whole = F.lit(None).cast("string").alias("value")
    short = F.expr("concat(substring(translate(b, '/+aeiKLM', '!@$.~&%#'), 1, 2 + n % 7), substring(h, 1, 2), substring(translate(b, '+/', '9Z'), 40, 2 + n % 3))")
    spelt = F.concat(F.initcap(F.translate(word(27), "aeos", "@30$")), F.initcap(word(28)), pick(16, "!", "&", "", "#", "."), F.expr("cast(n * 7 + id % 1900 as string)"))
    no = pick(
        17,
        word(29), F.concat(word(29), F.lit("_"), word(30)), F.concat(word(29), F.lit("."), word(30)), F.concat(F.lit("get"), F.initcap(word(29)), F.lit("()")), F.concat(F.lit("${"), F.upper(word(29)), F.lit("}")),
        F.concat(F.lit("<"), word(29), F.lit(">")), F.concat(F.lit("self."), word(29), F.lit("[0]")), "undefined", "string", "required", "process.env.TOKEN", "os.environ['PASSWORD']", "********", "xxxxxxxx", "changeme1", "password123example", "00000000", "please",
    )
    secret = pick(
        4,
        F.struct(F.concat_ws(" ", plain, word(11)).alias("before"), F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)).alias("word"), whole),
        F.struct(F.concat_ws(" ", key, F.lit("=")).alias("before"), quoted(F.substring(hexa, 1, 40)).alias("word"), whole),
        F.struct(plain.alias("before"), F.concat(key, F.lit("="), F.expr("substring(h, 1, n)")).alias("word"), whole),
        F.struct(F.concat_ws(" ", F.lit("export"), key, F.lit(":")).alias("before"), quoted(F.expr("substring(b, 1, n + 12)")).alias("word"), whole),
        F.struct(plain.alias("before"), F.concat(F.lit("ghp_"), F.substring(F.translate(F.col("b"), "+/", "aZ"), 1, 36)).alias("word"), whole),
        # a secret that is one of several runs of its word
        F.struct(plain.alias("before"), F.concat(scheme, F.lit("://"), word(22), F.lit(":"), some, F.lit("@"), word(23), place).alias("word"), some.alias("value")),
        # short values of keys
        F.struct(F.concat_ws(" ", plain, F.concat(key, F.lit(":"))).alias("before"), quoted(short).alias("word"), short.alias("value")),
        F.struct(plain.alias("before"), F.concat(key, F.lit("="), quoted(short)).alias("word"), short.alias("value")),
        F.struct(F.concat_ws(" ", key, F.lit("=")).alias("before"), quoted(spelt).alias("word"), spelt.alias("value")),
        F.struct(plain.alias("before"), F.concat(key, F.lit("="), quoted(spelt)).alias("word"), spelt.alias("value")),
        F.struct(plain.alias("before"), F.concat(F.lit('{"id":"'), F.substring(hexa, 41, 20), F.lit('","'), key, F.lit('":"'), some, F.lit('"}')).alias("word"), some.alias("value")),
    )
    other = pick(
        5,
        F.struct(F.concat_ws(" ", plain, pick(6, "commit", "sha1", "checksum", "md5", "digest", "revision")).alias("before"), F.expr("substring(h, 1, 40)").alias("word"), whole),
        F.struct(F.concat_ws(" ", key, F.lit("=")).alias("before"), quoted(F.concat(pick(7, "your_", "example-", "test_", "dummy-", "changeme_"), word(12), F.lit("_"), word(13), F.lit("_here1"))).alias("word"), whole),
        F.struct(plain.alias("before"), F.concat(F.lit("AKIA"), F.substring(upper, 1, 9), F.lit("EXAMPLE")).alias("word"), whole),
        F.struct(plain.alias("before"), F.expr("concat(substring(h,1,8),'-',substring(h,9,4),'-4',substring(h,13,3),'-a',substring(h,16,3),'-',substring(h,19,12))").alias("word"), whole),
        F.struct(plain.alias("before"), F.concat(F.lit("/usr/"), word(14), F.lit("/"), word(15), F.lit("/"), word(16), F.lit("-2.0/"), word(17)).alias("word"), whole),
        F.struct(plain.alias("before"), F.concat(word(18), word(19), word(20), word(21), F.lit("2024")).alias("word"), whole),
        F.struct(F.concat_ws(" ", key, F.lit("=")).alias("before"), F.concat(F.lit('"'), F.expr("repeat(substring('x0*a1', 1 + n % 4, 1), 20)"), F.lit('"')).alias("word"), whole),
        F.struct(plain.alias("before"), F.concat(scheme, F.lit("://"), word(22), F.lit(":"), some, F.lit("@"), word(23), place).alias("word"), F.regexp_extract(place, RUN, 1).alias("value")),
        F.struct(plain.alias("before"), F.concat(F.lit("https://"), word(22), place).alias("word"), F.regexp_extract(place, RUN, 1).alias("value")),
        F.struct(plain.alias("before"), F.concat(F.lit('{"commit":"'), F.substring(hexa, 1, 40), F.lit('","'), key, F.lit('":"'), some, F.lit('"}')).alias("word"), F.substring(hexa, 1, 40).alias("value")),
        F.struct(F.concat_ws(" ", plain, F.concat(key, F.lit(":"))).alias("before"), quoted(no).alias("word"), whole),
        F.struct(plain.alias("before"), F.concat(key, F.lit("="), no).alias("word"), whole),
        F.struct(F.concat_ws(" ", key, F.lit("=")).alias("before"), no.alias("word"), whole),
        F.struct(plain.alias("before"), F.concat(F.lit("0000"), F.expr("lpad(cast(id as string), 16, '0')")).alias("word"), whole),
    )
    base = spark.range(rows).withColumn("h", hexa).withColumn("b", sixty4).withColumn("n", vary(8, 18, 32))
    label = F.col("id") % 2
    row = F.when(label == 1, secret).otherwise(other)
    after = pick(9, "and the", "is", "of", "", "then", "was", "in")
    path = F.when(label == 1, pick(10, "src/app.py", "config/prod.env", "src3", "src7", "deploy.yml", "tests/unit.py")).otherwise(pick(10, "tests/unit.py", "docs/readme.md", "src3", "src7", "src/app.py", "examples/demo.js"))
    return base.select("id", row.alias("r"), after.alias("after"), path.alias("path"), label.cast("int").alias("label")).select("id", "r.before", "r.word", "after", "path", "r.value", "label")


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> PipelineModel:
    """The forest; labelled has before, word, after, path and label (0 or 1)."""
    rows = with_features(with_values(labelled.where("label IN (0, 1)"))).withColumn("label", F.col("label").cast("double")).coalesce(1)
    columns = [f"f_{c}" for c in FEATURES]
    gather = VectorAssembler(inputCols=columns, outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt")
    return PipelineModel([gather, forest.fit(gather.transform(rows))])


def score(found: DataFrame, model: PipelineModel) -> DataFrame:
    """One row for each run: adds `score`, the forest's share for a secret, and the columns of `with_values`."""
    found = found if "run_index" in found.columns else with_values(found)
    return model.transform(with_features(found)).select(*found.columns, vector_to_array("probability")[1].alias("score"))


def scan(documents: DataFrame, model: PipelineModel, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """(key, word_index, run_index, value, score, secret) for every candidate; secret: score >= 0.5."""
    found = score(candidates(documents, key, text, path), model)
    return found.select(F.col("key").alias(key), "word_index", "run_index", "value", "score", (F.col("score") >= 0.5).alias("secret"))


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    model = train(findings(spark))
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), model)
