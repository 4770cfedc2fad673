"""Mixing sources to target weights by dependent rounding.

Each source has a share of all words by its weight, at most a multiple of its
own words; the excess is shared anew among the others by weight. A document of
a source is then taken target / words times on average: the whole part always,
the fraction by pivotal rounding. Two fractional units are paired, mass moves
at random from one to the other until one of them is integral, and the words
expected from the pair stay the same. The rounding is a reduction tree: a leaf
is a bounded group of documents of one source, in which each document, largest
first, is paired with all smaller ones of its group together; a leaf leaves at
most one fractional document. These residuals meet in groups, pair by pair,
level by level, until a source has one, which is rounded by its fraction. So a
source misses its target by less than one document, and by the choice of order
mostly a small one.

All work is in DataFrame functions. Only (id, source, words) move; a hot source
is dealt over many leaves. Randomness comes from hashes of id, source, words
and level, so a rerun gives the same mix.

Null text has no words and is never counted; null sources are a source, the
last. Rows that repeat id, source and words are one unit and are taken equally
often. A text of any length is one document with its number of words; one that is
longer than its source's share is taken whole or not at all. Documents without words count as taken the whole part only. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import chance, stage

LEAF = 128
TINY = 1e-9
#: Characters of a word: all but space and the five controls that ASCII counts as white space.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, most: float = 3.0, cycle: int = 3) -> DataFrame:
    """(source, source_size, target) from ``sizes`` (source, size): one row per source.

    Sources in code point order, null last, weigh 1 .. ``cycle``, repeating.
    The windows hold one row a source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = (F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1) % cycle + 1
    weighed = totals.withColumn("weight", weight.cast("double"))
    # Sources reach their bound in the order of bound by weight.
    bound = F.lit(float(most)) * F.col("source_size")
    order = Window.orderBy(bound / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rate = (F.sum("source_size").over(everyone) - F.coalesce(F.sum(bound).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    held = weighed.withColumn("full", bound <= rate * F.col("weight"))
    rest = F.sum("source_size").over(everyone) - F.coalesce(F.sum(F.when(F.col("full"), bound)).over(everyone), F.lit(0.0))
    free = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everyone)
    return held.select(
        "source", "source_size", F.when(F.col("full"), bound).otherwise(rest / free * F.col("weight")).alias("target")
    )



def _fold_leaf(items: Column, seed: int) -> Column:
    """(done, left): each document against the pool of the smaller ones, which share one probability."""
    # items: doc_id, size, mass (words of all repeats), p; largest mass first
    total = F.aggregate(items, F.lit(0.0), lambda a, x: a + x["mass"])
    first = F.element_at(items, 1)["p"]
    none = F.lit(None).cast("struct<doc_id:bigint,size:bigint,mass:double,p:double>")
    empty = F.array().cast("array<struct<doc_id:bigint,size:bigint,up:int>>")
    start = F.struct(first.alias("p"), total.alias("pool"), empty.alias("done"), none.alias("left"))

    def step(state: Column, x: Column) -> Column:
        p, w = state["p"], x["mass"]
        pool = state["pool"] - w
        whole = (p <= TINY) | (p >= 1 - TINY)
        gain, loss = F.least((1 - p) * w, p * pool), F.least(p * w, (1 - p) * pool)
        to_x = chance(seed, x["doc_id"], x["size"]) * (gain + loss) < loss
        # Whether the document or the pool becomes integral.
        settles = whole | ((pool > TINY) & F.when(to_x, (1 - p) * w <= p * pool).otherwise(p * w <= (1 - p) * pool))
        up = F.when(whole, p >= 0.5).otherwise(to_x)
        pool_p = F.when(to_x, p - gain / F.greatest(pool, F.lit(TINY))).otherwise(p + loss / F.greatest(pool, F.lit(TINY)))
        own_p = F.when(to_x, p + gain / w).otherwise(p - loss / w)
        ended = F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), up.cast("int").alias("up"))
        return F.struct(
            F.when(whole, p).when(settles, pool_p).otherwise(F.when(to_x, 0.0).otherwise(1.0)).alias("p"),
            pool.alias("pool"),
            F.when(settles, F.concat(state["done"], F.array(ended))).otherwise(state["done"]).alias("done"),
            F.when(settles, state["left"]).otherwise(
                F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), w.alias("mass"), own_p.alias("p"))
            ).alias("left"),
        )

    return F.aggregate(items, start, step)


def _fold_pairs(items: Column, seed: Column) -> Column:
    """(done, left): fractional documents met one by one, each time two become one."""
    empty = F.array().cast("array<struct<doc_id:bigint,size:bigint,up:int>>")
    start = F.struct(F.element_at(items, 1).alias("left"), empty.alias("done"))

    def step(state: Column, x: Column) -> Column:
        a = state["left"]
        wa, wb, pa, pb = a["mass"], x["mass"], a["p"], x["p"]
        rise = F.least((1 - pa) * wa, pb * wb)  # words that may move to a
        fall = F.least(pa * wa, (1 - pb) * wb)  # words that may move to x
        to_a = chance(7, seed, a["doc_id"], a["size"], x["doc_id"], x["size"]) * (rise + fall) < fall
        by = F.when(to_a, rise).otherwise(-fall)
        na, nb = pa + by / wa, pb - by / wb
        # Rounding errors: the one nearer to a whole number is the one that is done.
        away_a, away_b = F.least(F.abs(na), F.abs(1 - na)), F.least(F.abs(nb), F.abs(1 - nb))
        a_done = away_a <= away_b

        def unit(u: Column, p: Column) -> Column:
            return F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["mass"].alias("mass"), p.alias("p"))

        def out(u: Column, p: Column) -> Column:
            return F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), (p >= 0.5).cast("int").alias("up"))

        return F.struct(
            F.when(a_done, unit(x, nb)).otherwise(unit(a, na)).alias("left"),
            F.concat(state["done"], F.array(F.when(a_done, out(a, na)).otherwise(out(x, nb)))).alias("done"),
        )

    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, step)


def rounded(units: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(source, doc_id, size, up) for ``units`` (source, doc_id, size, mass, p, n: units of the source).

    ``up`` is 1 for the documents taken once more. Units have mass.
    """
    bucket = F.pmod(F.xxhash64(F.lit(3), "doc_id", "size"), F.greatest(F.ceil(F.col("n") / leaf), F.lit(1)))
    items = F.array_sort(
        F.collect_list(F.struct((-F.col("mass")).alias("key"), F.xxhash64("doc_id").alias("tie"), "doc_id", "size", "mass", "p"))
    )
    grouped = units.groupBy("source", bucket.alias("bucket")).agg(items.alias("items"), F.first("n").alias("n"))
    folded = stage(
        grouped.select("source", "bucket", "n", _fold_leaf(F.col("items"), 1).alias("r")).select(
            "source", "bucket", "n", "r.done", "r.left"
        ),
        "mix-leaves",
    )
    done = [folded.select("source", F.explode("done").alias("d"))]
    left = folded.where("left IS NOT NULL").select("source", "left.*")
    level = 1
    while True:
        counted = left.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("m"))
        most = counted.agg(F.max("m")).first()[0]
        if not most:
            break
        last = most <= leaf
        groups = F.lit(0) if last else F.pmod(F.xxhash64(F.lit(10 + level), "doc_id", "size"), F.ceil(F.col("m") / leaf))
        met = left.join(counted, F.col("source").eqNullSafe(F.col("s"))).select(
            "source", groups.alias("g"), F.struct(F.xxhash64(F.lit(level), "doc_id", "size").alias("tie"), "doc_id", "size", "mass", "p").alias("u")
        )
        folded = stage(
            met.groupBy("source", "g").agg(F.array_sort(F.collect_list("u")).alias("items")).select(
                "source", _fold_pairs(F.transform("items", _plain), F.lit(level)).alias("r")
            ).select("source", "r.done", "r.left"),
            "mix-level",
        )
        done.append(folded.select("source", F.explode("done").alias("d")))
        left = folded.select("source", "left.*")
        level += 1
        if last:
            final = F.struct("doc_id", "size", (chance(5, F.col("doc_id"), F.col("size")) < F.col("p")).cast("int").alias("up"))
            done.append(left.select("source", final.alias("d")))
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("source", "d.*")


def _plain(u: Column) -> Column:
    return F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["mass"].alias("mass"), u["p"].alias("p"))


def mix(sizes: DataFrame, most: float = 3.0, leaf: int = LEAF) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies) for each row of ``sizes`` (doc_id, source, size).

    ``most`` bounds how often a document may be taken.
    """
    sizes = stage(sizes.select("doc_id", "source", F.col("size").cast("bigint").alias("size")), "mix-sizes")
    goals = stage(targets(sizes, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goals.withColumn("rate", rate).withColumn("base", F.floor("rate").cast("bigint")).withColumnRenamed("source", "s")
    units = sizes.where("size > 0").groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("m"))
    many = units.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "s2")
    joined = units.join(goal, F.col("source").eqNullSafe(F.col("s"))).join(many, F.col("source").eqNullSafe(F.col("s2")))
    chosen = rounded(
        joined.select(
            "source", "doc_id", "size", (F.col("size") * F.col("m")).cast("double").alias("mass"),
            (F.col("rate") - F.col("base")).alias("p"), "n",
        ),
        leaf,
    ).select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("size").alias("_n"), "up")
    same = (
        F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("size") == F.col("_n")) & F.col("source").eqNullSafe(F.col("_s"))
    )
    return (
        sizes.join(chosen, same, "left")
        .join(goal, F.col("source").eqNullSafe(F.col("s")))
        .select(
            "doc_id", "size", "source", "source_size", "target",
            F.least(F.col("base") + F.coalesce("up", F.lit(0)), F.lit(int(most))).alias("copies"),
        )
    )
