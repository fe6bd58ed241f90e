"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source should be taken ``target / source_size`` times. The
whole part is certain; the fraction is a copy probability. Two documents with
fractional probabilities meet, and mass (words times probability) moves from
one to the other, in a random direction that leaves both expectations as they
are, until one of them is integral. The other carries the residual on. Groups
of bounded size reduce to one residual each, and a tree of such groups to one
residual a source, so a source's words stay within one document of its target.
A last transfer moves the residual's rounding to the document that fits it best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parasol.llm.common import attach, word_count
from parasol.session import save_table

#: The weights of sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No document is taken more often.
MOST = 3
#: Documents of a group of the reduction tree, on average.
GROUP = 64


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``target`` to sources(known, name, source_size, ...), one row a source.

    All words are shared by weight; a share stops at ``most`` times the source's
    size, and what is left over is shared again among the others. In the order
    of size / weight, a source is full if the level that the words so far left
    give reaches its limit; the first that isn't sets the level of all later ones.
    """
    name = Window.orderBy(F.col("known").desc(), "name")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("w", w.cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    everything = Window.partitionBy()
    rows = rows.withColumn("full_at", F.col("cap") / F.col("w"))
    before = Window.orderBy("full_at", F.col("known").desc(), "name").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / open_w)
    upto = Window.orderBy("full_at", F.col("known").desc(), "name").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("is_full", F.min(F.col("full_at") <= F.col("level")).over(upto))
    level = F.min_by(F.when(~F.col("is_full"), F.col("level")), F.when(~F.col("is_full"), F.struct("full_at", ~F.col("known"), "name"))).over(everything)
    rows = rows.withColumn("target", F.when(F.col("is_full"), F.col("cap")).otherwise(F.least("cap", level * F.col("w"))))
    return rows.drop("w", "cap", "full_at", "level", "is_full")


#: Folds the items xs (s: words a copy, mu: words expected) of a group. Mass moves to the residual a with
#: probability t2 / (t1 + t2), where t1 is what a can take from b and t2 what b can take from a.
FOLD = """
aggregate(xs, cast(null as struct<done: array<struct<id: bigint, up: boolean>>, a: struct<id: bigint, s: double, mu: double>>), (acc, b) ->
    case when acc is null then
        named_struct('done', cast(array() as array<struct<id: bigint, up: boolean>>), 'a', named_struct('id', b.id, 's', b.s, 'mu', b.mu))
    when b.u * (least(acc.a.s - acc.a.mu, b.mu) + least(acc.a.mu, b.s - b.mu)) < least(acc.a.mu, b.s - b.mu) then
        case when acc.a.s - acc.a.mu <= b.mu then
            named_struct('done', array_append(acc.done, named_struct('id', acc.a.id, 'up', true)), 'a', named_struct('id', b.id, 's', b.s, 'mu', b.mu - (acc.a.s - acc.a.mu)))
        else
            named_struct('done', array_append(acc.done, named_struct('id', b.id, 'up', false)), 'a', named_struct('id', acc.a.id, 's', acc.a.s, 'mu', acc.a.mu + b.mu))
        end
    else
        case when b.s - b.mu <= acc.a.mu then
            named_struct('done', array_append(acc.done, named_struct('id', b.id, 'up', true)), 'a', named_struct('id', acc.a.id, 's', acc.a.s, 'mu', acc.a.mu - (b.s - b.mu)))
        else
            named_struct('done', array_append(acc.done, named_struct('id', acc.a.id, 'up', false)), 'a', named_struct('id', b.id, 's', b.s, 'mu', acc.a.mu + b.mu))
        end
    end)
"""


def _uniform(*of: Column | str) -> Column:
    """A number in [0, 1) that depends on the given columns only."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def reduce_groups(dealt: DataFrame, level: int, seed: int) -> DataFrame:
    """One row per (key, bucket): width, acc (done[] and the residual a), h (a hash for the next level)."""
    wide = dealt.groupBy("key", "bucket").agg(F.sort_array(F.collect_list("item"), asc=False).alias("xs"), F.max("width").alias("width"))
    return wide.select("key", "width", F.expr(FOLD).alias("acc"), F.xxhash64("key", "bucket", F.lit(level), F.lit(seed)).alias("h"))


def last_transfer(taken: DataFrame, ends: DataFrame, total: int) -> DataFrame:
    """One document at most a source, (id, delta), that gives or takes one copy to make up for the last rounding.

    It is the document whose size is nearest to the error, if that brings the
    source nearer to its target. Only documents with a fractional rate count, so
    each is still taken the whole part of its rate or one time more.
    """
    sized = ends.join(taken.select("key", F.col("id").alias("last_id"), "classes"), ["key", "last_id"])
    near = attach(taken.drop("classes"), sized, ["key"], "classes", total)
    may = F.when(F.col("error") > 0, F.col("extra") >= 1).otherwise(F.col("extra") <= F.col("n") - 1)
    near = near.where((F.col("share") > 0) & (F.col("id") != F.col("last_id")) & may & (F.col("size") < 2 * F.abs("error")) & (F.col("size") > 0))
    best = near.groupBy("key").agg(F.min_by(F.struct("id", "error"), F.struct(F.abs(F.col("size") - F.abs("error")), "u", "id")).alias("b"))
    return best.select("b.id", F.when(F.col("b.error") > 0, -1).otherwise(1).alias("delta"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = 0,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies, source.

    A null text has size 0. Sources come in code point order, null last, and a
    null source is a source like any other. Repeated rows and ids are rows of
    their own, taken at most ``most`` times each. A document of size 0 is taken
    as often as the whole part of its rate says. Other columns are ignored; an
    empty table gives an empty result. The result depends on the rows, the
    weights and the seed only, so reruns agree.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).isNotNull().alias("known"),
        F.coalesce(F.col(source_col), F.lit("")).alias("name"),
        word_count(F.col(text_col)).alias("size"),
    )
    # Rows alike in all of this are one class of n rows: they share one fraction and differ by one copy at most.
    classes = save_table(rows.groupBy("doc_id", "known", "name", "size").agg(F.count("*").alias("n")), "mix-classes")
    per_source = classes.groupBy("known", "name").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("classes"))
    goals = save_table(targets(per_source, weights, most), "mix-targets")
    total = classes.count()

    rated = attach(classes, goals, ["known", "name"], "classes", total)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = rated.withColumn("whole", F.floor(rate)).withColumn("share", F.col("n") * (rate - F.floor(rate)))
    rated = rated.withColumn("certain", F.floor("share")).withColumn("q", F.col("share") - F.floor("share"))
    # An id of the class within this table; its random numbers come from the class itself.
    rated = rated.withColumn("id", F.monotonically_increasing_id()).withColumn("u", _uniform("doc_id", "known", "name", "size", F.lit(seed)))
    rated = save_table(rated.withColumn("key", F.xxhash64("known", "name")), "mix-rated")

    decided, ends = [], []
    items = rated.where("q > 0 and size > 0").select("key", "id", F.col("size").cast("double").alias("s"), (F.col("q") * F.col("size")).alias("mu"), F.col("u"), F.xxhash64("doc_id", "size").alias("h"), F.greatest(F.col("classes"), F.lit(1)).alias("width"))
    level = 0
    while True:
        # On average GROUP items meet in a bucket, whatever the source's size; hashing gives no bucket many more.
        buckets = F.greatest(F.ceil(F.col("width") / GROUP), F.lit(1))
        dealt = items.select("key", F.pmod(F.xxhash64("h", F.lit(seed), F.lit(level)), buckets).alias("bucket"), F.struct("s", "h", "id", "mu", "u").alias("item"), buckets.alias("width"))
        reduced = save_table(reduce_groups(dealt, level, seed), f"mix-level{level}")
        decided.append(reduced.select(F.explode("acc.done").alias("d")).select("d.id", "d.up"))
        # The residual of a whole source goes the nearer way; error: words that the source then has too many.
        last = reduced.where("width <= 1").select("key", F.col("acc.a.id").alias("id"), (F.col("acc.a.mu") * 2 >= F.col("acc.a.s")).alias("up"), "acc")
        decided.append(last.select("id", "up"))
        ends.append(last.select("key", F.col("id").alias("last_id"), (F.when(F.col("up"), F.col("acc.a.s")).otherwise(0.0) - F.col("acc.a.mu")).alias("error")))
        rest = reduced.where("width > 1")
        if rest.isEmpty():
            break
        level += 1
        items = rest.select("key", F.col("acc.a.id").alias("id"), F.col("acc.a.s").alias("s"), F.col("acc.a.mu").alias("mu"), _uniform("h", F.lit(seed), F.lit(level)).alias("u"), "h", "width")
    ups = _union(decided).where("up").select("id", F.lit(1).alias("one"))
    taken = save_table(rated.join(ups, "id", "left").withColumn("extra", F.col("certain") + F.coalesce("one", F.lit(0))), "mix-taken")
    taken = taken.join(last_transfer(taken, _union(ends), total), "id", "left").withColumn("extra", F.col("extra") + F.coalesce("delta", F.lit(0)))
    each = taken.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = (F.col("whole") + F.when(F.col("i") <= F.col("extra"), 1).otherwise(0)).cast("long")
    return each.select(
        "doc_id",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (F.col("size") * copies).alias("taken"),
        copies.alias("copies"),
        F.when(F.col("known"), F.col("name")).alias("source"),
    )
