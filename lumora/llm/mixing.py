"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A document of a source with target t and size s is wanted t/s times: a whole number of copies for
sure, and one more with a fractional probability. Rounding goes in pairs: two fractional documents
exchange mass (words times probability) in a random direction until one of them is 0 or 1; the
other, the residual, goes on to the next pair. The words a source takes stay the same at each
exchange, so after all pairs they miss the target by less than one document. Pairs are formed in
chunks of a bounded number of documents of like size; the residuals of CHUNK chunks meet in a chunk
of the next level, a reduction tree of logarithmic height. The last level has one residual of each
size bucket and a few documents held back, largest first; there a residual that grows too large for the
documents after it is paired with all of them at once, so that what remains is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.llm.common import WORD, fresh, stored, table

#: Documents in a chunk, on average; the fan-in of the reduction tree.
CHUNK = 48
#: Documents of each size bucket that wait for the last pairing, on average: small ones take up what large residuals leave.
HELD = 8
#: Up to so many (source, size bucket) rows of a few numbers are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Quarter octaves of size.
BUCKET = "cast(floor(4 * log2(greatest(size, 1))) as int)"
#: A source as a number, null apart from the empty text.
KEY = "xxhash64(coalesce(source, ''), source is null)"
#: Weights of the sources in order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: a row a source (null is one, the last).

    The wanted total is share * all sizes. No target exceeds most * the source's size; what is cut
    off is shared again by weight. With sources sorted by cap/weight the first so many are capped and
    the others get level * weight, so prefix sums find the level without repetition.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), nth.cast("int"))).withColumn("cap", F.col("source_size") * F.lit(most))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("t", F.sum("source_size").over(everything) * F.lit(share))
    s = s.withColumn("left", F.col("t") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("fits", F.col("left") / F.col("w_left") * F.col("w") <= F.col("cap"))
    # the level is that of the first source, in this order, that is not capped
    s = s.withColumn("level", F.first(F.when(F.col("fits"), F.col("left") / F.col("w_left")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def _uniform(*columns: Column) -> Column:
    """In [0, 1), from a hash: the same at each run."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


_ITEM = "struct<o:bigint,h:bigint,doc_id:bigint,dup:bigint,z:bigint,m:double>"
_DONE = "array<struct<doc_id:bigint,dup:bigint,z:bigint,b:int>>"


def _with_mass(x: Column, m: Column) -> Column:
    return F.struct(x["o"].alias("o"), x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["dup"].alias("dup"), x["z"].alias("z"), m.alias("m"))


def _decided(x: Column, m: Column) -> Column:
    return F.struct(x["doc_id"].alias("doc_id"), x["dup"].alias("dup"), x["z"].alias("z"), (m * 2 >= x["z"]).cast("int").alias("b"))


def _pair(r: Column, x: Column, seed: int) -> tuple[Column, Column]:
    """The residual and the decided one after r and x exchanged mass in a random direction, as far as it goes."""
    a = F.least(r["m"], x["z"] - x["m"])  # mass that can go from r to x
    b = F.least(x["m"], r["z"] - r["m"])  # and back
    forth = _uniform(F.lit(seed), r["doc_id"], r["dup"], x["doc_id"], x["dup"]) * (a + b) < b
    rm = F.when(forth, r["m"] - a).otherwise(r["m"] + b)
    xm = F.when(forth, x["m"] + a).otherwise(x["m"] - b)
    # whichever came nearest to 0 or to its size is decided
    gap = lambda m, z: F.least(m, z - m) / z
    r_done = gap(rm, r["z"]) <= gap(xm, x["z"])
    return F.when(r_done, _with_mass(x, xm)).otherwise(_with_mass(r, rm)), F.when(r_done, _decided(r, rm)).otherwise(_decided(x, xm))


def _pivot(items: Column, seed: int) -> Column:
    """Folds documents (doc_id, dup, z words, m mass, 0 < m < z) into struct(r: the residual, done: decided documents)."""
    start = F.struct(F.lit(None).cast(_ITEM).alias("r"), F.array().cast(_DONE).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        left, out = _pair(acc["r"], x, seed)
        first = F.struct(_with_mass(x, x["m"]).alias("r"), acc["done"].alias("done"))
        return F.when(acc["r"].isNull(), first).otherwise(F.struct(left.alias("r"), F.concat(acc["done"], F.array(out)).alias("done")))

    return F.aggregate(items, start, step)


def _settle(items: Column, seed: int) -> Column:
    """As _pivot, for documents from the largest to the smallest: a large residual does not last to the end.

    While all that follow together can still take up the residual's mass, or give what it lacks, and soon no
    longer could, it is paired with them as one: its word is then final, and each of them changes its mass by
    the same share of its room. Such a change is linear, so the fold carries it as m -> p * m + q * z.
    """
    total = lambda f: F.aggregate(items, F.lit(0.0), lambda acc, x: acc + f(x))
    start = F.struct(F.lit(None).cast(_ITEM).alias("r"), F.array().cast(_DONE).alias("done"), total(lambda x: x["z"]).alias("z"), total(lambda x: x["m"]).alias("m"), F.lit(1.0).alias("p"), F.lit(0.0).alias("q"))

    def state(r: Column, done: Column, z: Column, m: Column, p: Column, q: Column) -> Column:
        return F.struct(r.alias("r"), done.alias("done"), z.alias("z"), m.alias("m"), p.alias("p"), q.alias("q"))

    def paired(acc: Column, x: Column) -> Column:
        now = _with_mass(x, acc["p"] * x["m"] + acc["q"] * x["z"])
        z, m = acc["z"] - x["z"], acc["m"] - now["m"]
        left, out = _pair(acc["r"], now, seed)
        return F.when(acc["r"].isNull(), state(now, acc["done"], z, m, acc["p"], acc["q"])).otherwise(state(left, F.concat(acc["done"], F.array(out)), z, m, acc["p"], acc["q"]))

    def step(acc: Column, x: Column) -> Column:
        # an array of one names the state once, so that it isn't worked out again for each of its uses
        return F.element_at(F.transform(F.array(paired(acc, x)), settled), 1)

    def settled(s: Column) -> Column:
        r, room = s["r"], s["z"] - s["m"]
        need = r["z"] - r["m"]
        close = (r["m"] <= room) & (need <= s["m"]) & (F.least(room, s["m"]) < 2 * r["z"]) & (room > 0) & (s["m"] > 0)
        away = _uniform(F.lit(seed + 7), r["doc_id"], r["dup"]) * r["z"] < need  # r goes to 0, its mass to the others
        up, down = r["m"] / room, need / s["m"]
        m = F.when(away, s["m"] + r["m"]).otherwise(s["m"] - need)
        p = F.when(away, s["p"] * (1 - up)).otherwise(s["p"] * (1 - down))
        q = F.when(away, s["q"] * (1 - up) + up).otherwise(s["q"] * (1 - down))
        out = _decided(r, F.when(away, F.lit(0.0)).otherwise(r["z"].cast("double")))
        return F.when(close, state(F.lit(None).cast(_ITEM), F.concat(s["done"], F.array(out)), s["z"], m, p, q)).otherwise(s)

    return F.aggregate(items, start, step, lambda s: F.struct(s["r"].alias("r"), s["done"].alias("done")))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 20) -> DataFrame:
    """doc_id, source, dup, size, source_size, target, copies, taken: one row for each row of docs.

    docs: doc_id, text, source; other columns are ignored. A null text has size 0; documents of size 0
    are taken 0 times; sources count null as one of its own. Equal (doc_id, source, size) rows are told
    apart by dup (from 0). The same rows give the same copies, whatever their order or partitions. An
    empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    sizes = stored(rows.groupBy("doc_id", "source", "size").count().select("doc_id", "source", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("dup")))
    per = stored(targets(sizes, weights, share, most).withColumn("key", F.expr(KEY)))
    steps = stored(sizes.groupBy("source", F.expr(BUCKET).alias("bucket")).agg(F.count("*").alias("n")).withColumn("key", F.expr(KEY))).drop("source")
    facts = steps.agg(F.count("*").alias("k"), F.max("n").alias("n")).first()
    small = facts["k"] <= BROADCAST_ROWS
    hint, steps = (F.broadcast(per), F.broadcast(steps)) if small else (per, steps)
    wanted = sizes.withColumn("key", F.expr(KEY)).withColumn("bucket", F.expr(BUCKET)).join(hint.drop("source"), "key")
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = wanted.withColumn("mass", (p - F.floor(p)) * F.col("size"))
    fractional = (F.col("mass") > 1e-9) & (F.col("size") - F.col("mass") > 1e-9)
    open_ = wanted.where(fractional).join(steps, ["key", "bucket"]).select("key", "bucket", "n", "doc_id", "dup", F.col("size").alias("z"), F.col("mass").alias("m"))
    held = _uniform(F.lit(seed + 3), F.col("doc_id"), F.col("dup")) * F.col("n") < HELD
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK))
    level = open_.where(~held).select("key", "bucket", F.pmod(F.xxhash64("doc_id", "dup", F.lit(seed)), chunks).alias("chunk"), "doc_id", "dup", "z", "m")
    left, parts = max(1, -(-(facts["n"] or 0) // CHUNK)), []

    def fold(level: DataFrame, keys: list[str], order: Column, by=_pivot) -> DataFrame:
        h = F.xxhash64("doc_id", "dup", F.lit(seed + 1)).alias("h")
        folded = level.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), h, "doc_id", "dup", "z", "m"))).alias("items")).select(*keys, by(F.col("items"), seed).alias("f"))
        folded = stored(folded.select(*keys, F.col("f.r").alias("r"), F.col("f.done").alias("done")))
        parts.append(folded.select("key", F.explode("done").alias("d")).select("key", "d.doc_id", "d.dup", "d.z", "d.b"))
        return folded

    while True:
        folded = fold(level, ["key", "bucket", "chunk"], F.lit(0).cast("long"))
        if left <= 1:
            break
        left = -(-left // CHUNK)
        level = folded.where("r is not null").select("key", "bucket", F.floor(F.col("chunk") / CHUNK).alias("chunk"), "r.doc_id", "r.dup", "r.z", "r.m")
    rest = folded.select("key", "r.doc_id", "r.dup", "r.z", "r.m").unionByName(open_.where(held).select("key", "doc_id", "dup", "z", "m"))
    folded = fold(rest, ["key"], -F.col("z"), _settle).where("r is not null")
    extra = folded.select("key", "r.doc_id", "r.dup", F.col("r.z").alias("z"), (_uniform(F.lit(seed + 2), F.col("r.doc_id"), F.col("r.dup")) * F.col("r.z") < F.col("r.m")).cast("int").alias("b"))
    for d in parts:
        extra = extra.unionByName(d)
    sure = wanted.where(~fractional).select("key", "doc_id", "dup", F.col("size").alias("z"), (F.col("mass") > F.col("size") / 2).cast("int").alias("b"))
    base = F.when(F.col("z") > 0, F.floor(p)).otherwise(0).cast("long")
    out = extra.unionByName(sure).join(hint, "key").withColumn("copies", base + F.when(F.col("z") > 0, F.col("b")).otherwise(0))
    return out.select("doc_id", "source", "dup", F.col("z").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("z")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of docs as many times as mix() takes it, with docs' own columns.

    Rows of one (doc_id, source, size) share what mix() takes of them evenly. The texts are shuffled once.
    """
    i, s, z, k, m, t, n = (fresh(docs, x) for x in ("of_id", "of_source", "of_size", "of_copies", "of_rows", "times", "nth"))
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias(i), F.expr(KEY).alias(s)]
    made = mix(docs, **options).select(*key, F.col("size").alias(z), "copies").groupBy(i, s, z).agg(F.sum("copies").alias(k), F.count("*").alias(m)).where(F.col(k) > 0)
    own = docs.select("*", *key, word_count(F.col("text")).alias(z))
    both = own.join(made, [i, s, z])
    nth = F.row_number().over(Window.partitionBy(i, s, z).orderBy(i))  # the join's partitions and order serve
    times = F.floor(F.col(k) / F.col(m)) + (nth <= F.col(k) % F.col(m)).cast("long")
    taken = both.withColumn(t, times).where(F.col(t) > 0)
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col(t))).alias(n)).drop(n)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
