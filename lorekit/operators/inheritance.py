"""What each article of a link DAG hands on, in a number of rounds that grows with the logarithm of its chains.

An article hands on its union of projects if its field changes and the union has more than ``shared``. It takes from
linked earlier articles that hand something on; only where none does, its own candidates count. Solving that level by
level takes as many rounds as the longest chain of links. Instead, an article that waits for one donor only is a
function of what that donor hands on, and pointer jumping composes it with its donor's function, if that too waits for
one: a chain of n such articles is solved in about log2 n rounds. An article that waits for several donors joins in
when all but one of them are known.

Such a function of a list x (never empty, without ``shared``) is: the result of the first of ``tests`` whose set holds
all of x, else ``before`` + x + ``after`` without repeats; where the donor hands on nothing, a constant. A test stands
for an article on the way whose field already has all that it would inherit: it does not change and hands on nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekit.functions.text import let
from lorekit.session import cut_lineage, stage_path

TESTS = "array<struct<s: array<string>, gives: boolean, r: array<string>>>"
DONE = "slug string, gives boolean, list array<string>"


def ordered_distinct_ci(arr) -> Column:
    """Case-insensitive distinct keeping the first spelling, in order."""
    def firsts(a, low):
        return F.transform(F.array_distinct(low), lambda x: F.get(a, F.array_position(low, x).cast("int") - 1))
    return let(arr, lambda a: let(F.transform(a, F.lower), lambda low: firsts(a, low)))


def no_shared(arr) -> Column:
    return F.filter(arr, lambda p: F.lower(p) != "shared")


def within(arr, lowered) -> Column:
    """Whether all of a list is in a set of lower-cased values."""
    return F.forall(arr, lambda p: F.array_contains(lowered, F.lower(p)))


def empty(kind: str = "array<string>") -> Column:
    return F.array().cast(kind)


def _result(gives: Column, r: Column) -> Column:
    return F.struct(gives.alias("gives"), r.alias("list"))


def _applied(gives: Column, x: Column, f) -> Column:
    """f of a donor's state; ``f`` names the columns of a function."""
    hit = F.try_element_at(F.filter(f("tests"), lambda t: within(x, t["s"])), F.lit(1))
    grown = ordered_distinct_ci(F.concat(f("before"), x, f("after")))
    on = F.when(hit.isNull(), _result(F.lit(True), grown)).otherwise(_result(hit["gives"], hit["r"]))
    return F.when(gives, on).otherwise(_result(f("k_gives"), f("k")))


def _composed(outer, inner) -> list[Column]:
    """The columns of outer(inner(x))."""
    def through(t):
        y = _applied(t["gives"], t["r"], outer)
        return F.struct(t["s"].alias("s"), y["gives"].alias("gives"), y["list"].alias("r"))
    kept = F.filter(outer("tests"), lambda t: within(F.concat(inner("before"), inner("after")), t["s"]))
    tests = F.concat(F.transform(inner("tests"), through), kept).cast(TESTS)
    k = _applied(inner("k_gives"), inner("k"), outer)
    return [ordered_distinct_ci(F.concat(outer("before"), inner("before"))).alias("before"),
            ordered_distinct_ci(F.concat(inner("after"), outer("after"))).alias("after"),
            tests.alias("tests"), k["gives"].alias("k_gives"), k["list"].alias("k")]


def _reachable(tests) -> Column:
    """The tests that an earlier, wider one does not already answer."""
    wider = lambda t, i: F.exists(F.slice(tests, F.lit(1), i), lambda u: F.forall(t["s"], lambda p: F.array_contains(u["s"], p)))
    return F.filter(tests, lambda t, i: ~wider(t, i))


def _functions(waiting: DataFrame, done: DataFrame, base: DataFrame) -> DataFrame:
    """(slug, open, donor, function) of the waiting articles with at most one unknown donor."""
    e = waiting.join(done.withColumnRenamed("slug", "target").hint("merge"), "target", "left")
    unknown = F.col("gives").isNull()
    g = e.groupBy("slug").agg(F.count(F.when(unknown, 1)).alias("open"), F.min(F.when(unknown, F.struct("pos", "target"))).alias("hole"),
                              F.array_sort(F.collect_list(F.when(F.col("gives"), F.struct("pos", "list")))).alias("given"))
    g = g.where("open <= 1").join(base.hint("merge"), "slug")
    side = lambda keep: F.flatten(F.transform(F.filter("given", keep), lambda x: x["list"]))
    at = F.col("hole.pos")
    g = g.withColumn("left", side(lambda x: at.isNull() | (x["pos"] < at))).withColumn("right", side(lambda x: x["pos"] > at))
    given = F.concat("left", "right")
    own = F.when(F.size(given) > 0, given).otherwise(F.col("narrowed"))
    k = no_shared(ordered_distinct_ci(F.concat("e", own)))
    k_gives = (F.col("static") | ~within(own, F.col("s"))) & (F.size(k) > 0)
    test = F.array(F.struct(F.col("s"), F.lit(False).alias("gives"), empty().alias("r"))).cast(TESTS)
    return g.select("slug", "open", F.col("hole.target").alias("donor"), no_shared(F.concat("e", "left")).alias("before"), F.col("right").alias("after"),
                    F.when(F.col("static") | ~within(given, F.col("s")), empty(TESTS)).otherwise(test).alias("tests"), k_gives.alias("k_gives"), k.alias("k"))


def given_lists(base: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """((slug, gives, list), rounds). base: (slug, e, narrowed: lists; s: e in lower case; static: the field changes
    whatever is inherited). edges: distinct (slug, target) with the link's first place ``pos``; they form a DAG.
    The joins of a round broadcast nothing: lists that repeat are small on disk and large in memory."""
    spark = base.sparkSession
    path = stage_path(spark, "given")
    done = lambda: spark.read.schema(DONE).parquet(path)
    fields = ["before", "after", "tests", "k_gives", "k"]

    def settle(rows: DataFrame) -> None:
        rows.write.mode("append").parquet(path)

    own = no_shared(ordered_distinct_ci(F.concat("e", "narrowed")))
    alone = base.join(edges.select("slug").distinct().hint("merge"), "slug", "left_anti")
    settle(alone.select("slug", ((F.col("static") | ~within(F.col("narrowed"), F.col("s"))) & (F.size(own) > 0)).alias("gives"), own.alias("list")))
    waiting, chained, rounds = edges, None, 0
    while True:
        rounds += 1
        more = cut_lineage(_functions(waiting, done(), base))
        settle(more.where("open = 0").select("slug", F.col("k_gives").alias("gives"), F.col("k").alias("list")))
        waiting = cut_lineage(waiting.join(more.select("slug").hint("merge"), "slug", "left_anti"))
        fresh = more.where("open = 1").select("slug", "donor", *fields)
        chained = fresh if chained is None else chained.unionByName(fresh)

        # a known donor settles an article; a donor that waits for one other passes its own on
        outer, inner = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
        known = done().select(F.col("slug").alias("d_slug"), F.col("gives").alias("d_gives"), F.col("list").alias("d_list"))
        y = _applied(F.col("d_gives"), F.coalesce("d_list", empty()), outer)
        jumped = _composed(outer, inner)
        step = (chained.alias("a").join(known.alias("d").hint("merge"), F.col("a.donor") == F.col("d.d_slug"), "left")
                .join(chained.alias("b").hint("merge"), F.col("a.donor") == F.col("b.slug"), "left"))
        over = F.col("b.slug").isNotNull()
        step = cut_lineage(step.select("a.slug", F.when(over, F.col("b.donor")).otherwise(F.col("a.donor")).alias("donor"),
                                       *[F.when(over, c).otherwise(F.col(f"a.{n}")).alias(n) for n, c in zip(fields, jumped)],
                                       F.when(F.col("d_slug").isNotNull(), y).alias("result")))
        settle(step.where("result IS NOT NULL").select("slug", "result.gives", "result.list"))
        chained = step.where("result IS NULL").select("slug", "donor", *[_reachable(F.col(c)).alias(c) if c == "tests" else F.col(c) for c in fields])
        if chained.isEmpty() and waiting.isEmpty():
            return done(), rounds
