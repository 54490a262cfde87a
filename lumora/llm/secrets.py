"""Secret scans in DataFrame operations only: wide patterns, then a random forest against false positives.

Candidates are long tokens with digits, upper-case codes and values assigned to telling names. The
forest sees a candidate's length, its changes between kinds of characters, how much of it dictionary
pieces cover, its path characters and its neighbouring words. It is trained on labelled findings:
those of the corpus that strict rules can label (a bounded sample), and made-up ones of known kinds.
Its trees become one SQL expression, evaluated inside each row; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.common import fresh, sample_of_rows, table

#: Labelled findings of the corpus that the forest is trained on, and distinct texts that they are taken from, at most.
TRAIN_ROWS, TRAIN_TEXTS = 4000, 40_000
TREES, DEPTH, SEED = 15, 5, 11
MASK = "[SECRET]"
_NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key"
_LONG = "[A-Za-z0-9+/_-]"
#: Stands around candidates while a text is split; one that the text has itself counts as a space.
CUT = "\x01"
#: Candidates: what is assigned to a telling name (group 2, after group 1); tokens of 16 or more with a digit and codes
#: of upper-case letters (group 3). Names are looked for only where a = or : stands, so prose costs one test a character.
CANDIDATE = (
    rf"([=:][\"' ]{{0,2}}(?<=(?i:{_NAMES})[\"' ]{{0,2}}[=:][\"' ]{{0,2}}))([^\s\"'\x01]{{5,}}[^\s\"'\x01.,;:!?)\]}}])"
    rf"|(?<!{_LONG})(?={_LONG}{{16}})((?=[A-Za-z+/_-]*[0-9]){_LONG}{{16,}}={{0,2}}|[A-Z]{{16,}}(?![A-Za-z0-9]))"
)
_STRICT = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{24})$"
#: Common pieces of words in four languages, and words that stand for a secret in examples.
PIECES = (
    "tion ing the and ent ion her for tha nth int ere ter est ers ati hat ate all eth hes ver his oft ith fth sth oth res ont able ble "
    "ung ein ich der sch die und cht den gen ten che heit keit lich "
    "que les des ent eau eux aux ment oi ou ai ier elle pour "
    "ción ado ido ara osa res con del las los nte "
    "example sample test dummy changeme placeholder xxxx your here none null default password secret token admin user"
).split()
FEATURES = ["length", "digits", "uppers", "distinct", "entropy", "kinds", "turns", "covered", "path", "named", "assigned", "quoted", "address"]


def _features(x: Column) -> list[Column]:
    v, before, after = x["value"], x["before"], x["after"]
    n = F.greatest(F.char_length(v), F.lit(1)).cast("double")
    count = lambda p: F.regexp_count(v, F.lit(p)).cast("double")
    chars = F.split(v, "")
    share = lambda c: (F.char_length(v) - F.char_length(F.replace(v, c))) / n
    flag = lambda c: c.cast("double")
    out = [
        n,
        count("[0-9]") / n,
        count("[A-Z]") / n,
        F.size(F.array_distinct(chars)) / n,
        F.aggregate(F.filter(F.array_distinct(chars), lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))),
        (count("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]") + count("(?<=[a-z])[A-Z]")) / n,
        count("(?i)(?<=[aeiou])[bcdfghjklmnpqrstvwxyz]") / n,
        1 - F.char_length(F.regexp_replace(F.lower(v), "|".join(sorted(PIECES, key=len, reverse=True)), "")) / n,
        count("[/._-]") / n,
        flag(before.rlike(rf"(?i)({_NAMES})[\w-]*[\"']?\s*[=:]?\s*[\"']?$")),
        flag(before.rlike(r"[=:]\s*[\"']?$")),
        flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        flag(before.rlike(r"(?i)(https?:|www\.|@|[\w-]/)\S*$") | after.rlike(r"^[@/.][A-Za-z]")),
    ]
    return [F.coalesce(c, F.lit(0.0)).alias(f) for c, f in zip(out, FEATURES, strict=True)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pieces(text: Column) -> Column:
    """The text cut around its candidates: what stands before the first, the first, what stands between, and so on."""
    plain = F.replace(text, F.lit(CUT), F.lit(" "))
    return F.split(F.regexp_replace(plain, F.lit(CANDIDATE), F.lit(f"$1{CUT}$2$3{CUT}")), CUT, -1)


def _starts(cut: Column) -> Column:
    """Characters before each piece, by sums over blocks of about the square root of their number."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    to = lambda n: F.sequence(F.lit(0), n - 1)

    def with_lengths(n: Column) -> Column:
        def with_block(b: Column) -> Column:
            sums = F.transform(to(F.ceil(F.size(n) / b).cast("int")), lambda i: total(F.slice(n, i * b + 1, b)))
            before = _let(sums, lambda s: F.transform(to(F.size(s)), lambda i: total(F.slice(s, F.lit(1), i))))
            return _let(before, lambda s: F.transform(n, lambda _, i: F.get(s, F.floor(i / b).cast("int")) + total(F.slice(n, i - i % b + 1, i % b))))

        return _let(F.ceil(F.sqrt(F.size(n))).cast("int"), with_block)

    return _let(F.transform(cut, lambda x: F.char_length(x).cast("long")), with_lengths)


def candidates(cut: Column) -> Column:
    """array of (value, start, before, after) from pieces(): what stands around is cut to 48 and 16 characters. Null: none."""
    none = F.array().cast("array<struct<value:string,start:bigint,before:string,after:string>>")
    one = lambda at: lambda k: F.struct(
        F.get(cut, 2 * k - 1).alias("value"),
        F.get(at, 2 * k - 1).alias("start"),
        F.right(F.get(cut, 2 * k - 2), F.lit(48)).alias("before"),
        F.left(F.get(cut, 2 * k), F.lit(16)).alias("after"),
    )
    listed = _let(_starts(cut), lambda at: F.transform(F.sequence(F.lit(1), F.floor(F.size(cut) / 2).cast("int")), one(at)))
    return F.when(F.size(cut) > 1, listed).otherwise(none)


def _made_up(spark: SparkSession) -> DataFrame:
    """Labelled findings of known kinds, the same each time: 200 of each."""
    i = F.col("id")
    hexa = lambda n, s: F.substring(F.concat(*[F.sha2(F.concat(i.cast("string"), F.lit(f"-{s}-{k}")), 256) for k in range(2)]), 1, n)
    code = lambda n, s: F.upper(F.substring(F.translate(F.base64(F.unhex(hexa(96, s))), "+/=abcdefghijklmnopqrstuvwxyz", "XY3ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 1, n))
    mixed = lambda n, s: F.substring(F.translate(F.base64(F.unhex(hexa(96, s))), "+/=", "ab3"), 1, n)
    word = lambda n, s: F.concat(*[F.element_at(F.array(*map(F.lit, PIECES[:60])), (F.pmod(F.xxhash64(i, F.lit(s + k)), F.lit(60)) + 1).cast("int")) for k in range(n)])
    number = lambda k, s: F.pmod(F.xxhash64(i, F.lit(s)), F.lit(10**k)).cast("string")
    kinds = [
        (1, F.concat(F.lit("AKIA"), code(16, 1)), F.lit("the word "), F.lit(" and")),
        (1, hexa(40, 2), F.lit('in a token = "'), F.lit('" so')),
        (1, hexa(18, 3), F.lit("and password="), F.lit(" then")),
        (1, mixed(32, 4), F.lit("api_key: "), F.lit(" ")),
        (1, F.concat(F.lit("ghp_"), mixed(36, 5)), F.lit("use "), F.lit(".")),
        (0, word(6, 10), F.lit("of the "), F.lit(" of")),
        (0, F.upper(word(6, 20)), F.lit("!! "), F.lit("!!")),
        (0, F.concat(word(4, 30), number(3, 1)), F.lit("in "), F.lit(". The")),
        (0, F.concat(number(6, 2), number(9, 3), number(6, 4)), F.lit("card "), F.lit(" and")),
        (0, F.concat(word(2, 40), F.lit("/"), word(2, 50), F.lit("-"), number(4, 5), F.lit("/"), word(2, 60)), F.lit("see http://www."), F.lit(".html")),
        (0, F.concat(F.lit("changeme"), word(2, 70), number(2, 6)), F.lit("password="), F.lit(" ")),
        (0, F.concat(word(2, 80), F.lit("_"), word(2, 90), F.lit("_"), number(2, 7)), F.lit("the "), F.lit(" is")),
    ]
    parts = [spark.range(0, 200, 1, 1).select(v.alias("value"), b.alias("before"), a.alias("after"), F.lit(y).alias("label")) for y, v, b, a in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def labelled(docs: DataFrame, rows: int = TRAIN_ROWS, texts: int = TRAIN_TEXTS) -> DataFrame:
    """value, before, after, label: findings that strict rules label, at most `rows`, and made-up ones.

    They come from the `texts` distinct texts of the smallest hashes; a finding that occurs again in
    the same words counts once.
    """
    some = sample_of_rows(docs.select("text").where("text is not null"), texts, "text")
    c = some.select(F.explode_outer(_let(pieces(F.col("text")), candidates)).alias("c")).where("c is not null").select("c.value", "c.before", "c.after")
    letters = F.col("value").rlike("^[A-Za-z_/-]+$") | F.col("value").rlike("^[0-9/_-]+$") | F.lower("value").rlike("example|changeme|placeholder|xxxx")
    named = F.col("before").rlike(rf"(?i)({_NAMES})[\"' ]{{0,2}}[=:][\"' ]{{0,2}}$") & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    label = F.when(F.col("value").rlike(_STRICT), 1).when(letters, 0).when(named, 1)
    own = c.distinct().withColumn("label", label).where("label is not null").orderBy(F.xxhash64("value", "before"), "value", "before", "after").limit(rows)
    return own.unionByName(_made_up(docs.sparkSession))


def _tree(text: str) -> str:
    """A tree's printed form as an expression over the fields of x: its vote, 0.0 or 1.0."""
    lines = [x.strip() for x in text.splitlines() if x.strip().startswith(("If", "Else", "Predict"))]

    def read(at: int) -> tuple[str, int]:
        line = lines[at]
        if line.startswith("Predict"):
            return line.split(":")[1].strip(), at + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        if m is None:
            raise ValueError(f"a split of an unknown form: {line}")
        yes, at = read(at + 1)
        no, at = read(at + 1)  # skips Else
        return f"CASE WHEN x.{FEATURES[int(m[1])]} <= {float(m[2])!r}D THEN {yes} ELSE {no} END", at

    return read(0)[0]


def featured(rows: DataFrame) -> DataFrame:
    """v (vector of FEATURES) and label, of value, before, after, label."""
    x = F.struct("value", "before", "after").alias("x")
    data = rows.select(x, F.col("label").cast("double").alias("label")).select(*_features(F.col("x")), "label")
    return VectorAssembler(inputCols=FEATURES, outputCol="v").transform(data).select("v", "label")


def grown(data: DataFrame) -> RandomForestClassificationModel:
    """The forest over featured() rows, which lie in a fixed order so that reruns agree."""
    data = data.repartition(4, "v").sortWithinPartitions("label").cache()
    model = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(data)
    data.unpersist()
    return model


def as_sql(model: RandomForestClassificationModel) -> str:
    """The share of trees that vote for a secret, over a struct x of FEATURES."""
    votes = [f"cast({_tree(t.toDebugString)} as double)" for t in model.trees]
    return f"(({' + '.join(votes)}) / {len(votes)}D)"


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> str:
    """The forest as SQL over a struct x of FEATURES. Without findings in docs it knows the made-up ones alone."""
    return as_sql(grown(featured(labelled(docs, rows))))


def _scored(cut: Column, forest: str, docs: DataFrame, least: float, name: str) -> DataFrame:
    """docs with a column `name` of the findings that the forest keeps."""
    x = fresh(docs, "x")
    scored = F.transform(F.coalesce(candidates(cut), F.array()), lambda c: F.struct(c["value"].alias("value"), c["start"].alias("start"), (c["start"] + F.char_length(c["value"])).alias("end"), F.struct(*_features(c)).alias("x")))
    voted = F.expr(f"transform({x}, s -> named_struct('value', s.value, 'start', s.start, 'end', s.end, 'score', {forest.replace('x.', 's.x.')}))")
    return docs.withColumn(x, scored).withColumn(name, F.filter(voted, lambda f: f["score"] >= least)).drop(x)


def scan(docs: DataFrame, forest: str, least: float = 0.5, name: str = "findings") -> DataFrame:
    """docs with a column `name`: array of (value, start, end, score) that the forest keeps, in order.

    A null or empty text has none, an empty table gives none; repeated rows are scanned each; texts of any length are
    read whole. Offsets are in characters, the end exclusive. A column of docs called `name` is replaced,
    all others stay.
    """
    p = fresh(docs, "pieces")
    return _scored(F.col(p), forest, docs.withColumn(p, pieces(F.col("text"))), least, name).drop(p)


def redact(docs: DataFrame, forest: str) -> DataFrame:
    """docs with MASK in place of every candidate whose value the forest keeps somewhere in its document.

    Texts are put together again from the pieces around the candidates, so no secret is cut by another
    that begins like it. n_chars follows where there is one. Texts without a secret, null and empty ones
    stay as they are; in the others U+0001 becomes a space. Rows are neither lost nor joined; columns of
    any name stay.
    """
    p, found, kept = fresh(docs, "pieces"), fresh(docs, "found"), fresh(docs, "kept")
    out = _scored(F.col(p), forest, docs.withColumn(p, pieces(F.col("text"))), 0.5, found)
    out = out.withColumn(kept, F.transform(found, lambda f: f["value"])).withColumn(p, F.when(F.size(kept) > 0, F.col(p)))
    masked = F.transform(p, lambda x, i: F.when((i % 2 == 1) & F.array_contains(F.col(kept), x), F.lit(MASK)).otherwise(x))
    out = out.withColumn("text", F.when(F.size(kept) > 0, F.array_join(masked, "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(kept) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(docs)).select("doc_id", F.explode_outer("findings").alias("f")).where("f is not null")
    return found.select("doc_id", "f.start", "f.end", "f.value", "f.score")
