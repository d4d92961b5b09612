"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. Every document of a source is taken floor(target / size of the source)
times for certain. The rest of the target is met by one more copy of some documents: within a stratum (a source's
documents of about the same size) a fixed number is drawn with unequal probabilities by Pareto order sampling, that is, by
the smallest ratios of random odds to inclusion odds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, whole_row, written

#: Parts of an octave in a stratum of sizes, and ranges of ranks that are counted before ranks are compared.
PARTS, RANGES = 4, 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Of each source (_source, _size) its target: the shares of all words by weight, at most `most` times its size.

    The weights repeat over the sources in order of code points, null last. What a source can't take is dealt
    again among the others by weight until no target is above its limit, as water finds its level: sources in order of limit / weight
    are full as long as the level of the rest lies above. A row a source; the two sorts see no documents.
    """
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("_source").isNull(), F.col("_source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("_weight", weight).withColumn("_limit", F.col("_size") * most)
    order = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("_source").isNull(), F.col("_source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("_size").over(total) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    rest = F.sum("_weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = ranked.withColumn("_level", left / rest)
    holds = F.when(F.col("_level") * F.col("_weight") <= F.col("_limit"), F.struct("_nth", "_level"))
    filled = levels.withColumn("_nth", F.row_number().over(order)).withColumn("_water", F.min(holds).over(total)["_level"])
    filled = filled.withColumn("_water", F.coalesce("_water", F.lit(0.0)))
    return filled.select("_source", "_size", F.least(F.col("_water") * F.col("_weight"), F.col("_limit")).alias("_target"))


def _drawn(strata: DataFrame) -> DataFrame:
    """How many documents of each stratum get a further copy.

    From the largest sizes to the smallest, each stratum takes the number whose expected words come nearest to its share plus what
    those before it left over, so a source's error is about one of its smallest documents, whatever the tail of long ones.
    A row a stratum, at most 4 an octave of sizes and source.
    """
    listed = strata.groupBy("_source").agg(F.sort_array(F.collect_list(F.struct(F.col("_class"), F.col("_n"), F.col("_words"), F.col("_mean"), F.col("_part"))), asc=False).alias("_all"))
    start = F.struct(F.lit(0.0).alias("left"), F.expr("cast(array() as array<struct<class:int,n:bigint>>)").alias("out"))

    def step(state: Column, x: Column) -> Column:
        wish = x["_part"] * x["_words"] + state["left"]
        n = F.greatest(F.lit(0), F.least(x["_n"], F.round(wish / x["_mean"]).cast("long")))
        return F.struct((wish - n * x["_mean"]).alias("left"), F.concat(state["out"], F.array(F.struct(x["_class"].alias("class"), n.cast("bigint").alias("n")))).alias("out"))

    return listed.select("_source", F.explode(F.aggregate("_all", start, step)["out"]).alias("_s")).select("_source", F.col("_s.class").alias("_class"), F.col("_s.n").alias("_take"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """Decides how often each document is taken.

    docs: doc_id, text, source, and any other columns, which are ignored. Returns a row for each row of docs: doc_id, tx (a hash
    of the text, which tells rows with one id apart), source, size, source_size, target, copies, taken.

    Null and empty texts have size 0 and are taken 0 times; a null source is a source of its own, the last; an empty table gives an
    empty result; rows that repeat an id and a text are ranked apart by their number among equals, so each has its own draw.
    Reruns agree: draws are hashes of id, text and seed.

    Scale: texts are read once, for their sizes. All after that are narrow rows; sources and strata are aggregated before
    the shuffle, and joined as tables that Spark broadcasts only below its limit of size. No window spans a source: ranks are
    first counted in 65,536 ranges, and only rows in the one range that holds a stratum's limit are compared, some 1 in 65,536 of a stratum.
    """
    base = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(F.col("text")).alias("_tx"), F.col("source").cast("string").alias("_source"), word_count(F.col("text")).alias("_words"))
    base = base.withColumn("_class", F.when(F.col("_words") > 0, F.floor(F.log2("_words") * PARTS)).cast("int"))
    base = written(base)
    goal = targets(base.groupBy("_source").agg(F.sum("_words").cast("double").alias("_size")), weights, float(most))
    ratio = F.when(F.col("_size") > 0, F.col("_target") / F.col("_size")).otherwise(0.0)
    # a hair above a whole number is that number, whatever the order of the sums
    goal = written(goal.withColumn("_whole", F.floor(ratio + 1e-9)).withColumn("_part", F.greatest(F.lit(0.0), ratio - F.col("_whole"))))
    same = lambda a, b, *names: F.expr(" and ".join(f"{a}.{n} <=> {b}.{n}" for n in names))
    strata = base.where("_words > 0").groupBy("_source", "_class").agg(F.count("*").alias("_n"), F.sum("_words").alias("_words"), (F.count("*") / F.sum(1 / F.col("_words"))).alias("_mean"), F.avg("_words").alias("_avg"))
    strata = strata.alias("s").join(goal.alias("g"), same("s", "g", "_source")).select("s.*", "g._part")
    # the odds of a document's inclusion: its expected words are its stratum's mean, so short ones are likelier
    strata = written(strata)
    plan = written(strata.alias("s").join(_drawn(strata).alias("d"), same("s", "d", "_source", "_class")).select("s._source", "s._class", "s._avg", "d._take"))
    docs2 = base.alias("b").join(goal.alias("g"), same("b", "g", "_source"), "left").select("b.*", "g._size", "g._target", "g._whole", "g._part")
    docs2 = docs2.alias("b").join(plan.alias("p"), same("b", "p", "_source", "_class"), "left").select("b.*", "p._avg", "p._take")
    u = (F.pmod(F.xxhash64(F.col("_id"), F.col("_tx"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    wish = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("_part") * F.col("_avg") / F.col("_words")))
    rank = (u / (1 - u)) / (wish / (1 - wish))
    ranked = docs2.withColumn("_rank", F.when(F.col("_take") > 0, rank)).withColumn("_range", F.floor(F.col("_rank") / (1 + F.col("_rank")) * RANGES).cast("int"))
    ranked = written(ranked)
    up_to = Window.partitionBy("_source", "_class").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ranked.where("_take > 0").groupBy("_source", "_class", "_range").agg(F.count("*").alias("_n"), F.first("_take").alias("_take"))
    counted = counted.withColumn("_upto", F.sum("_n").over(up_to)).where("_upto >= _take").groupBy("_source", "_class").agg(F.min(F.struct("_range", (F.col("_take") - F.col("_upto") + F.col("_n")).alias("_in"))).alias("_edge"))
    edges = written(counted.select("_source", "_class", F.col("_edge._range").alias("_edge"), F.col("_edge._in").alias("_in")))
    placed = ranked.alias("r").join(edges.alias("e"), same("r", "e", "_source", "_class"), "left").select("r.*", "e._edge", "e._in")
    at_edge = F.col("_range") == F.col("_edge")
    # rows away from an edge get groups of their own, so that no group of the window is large
    group = F.when(at_edge, F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("_id", "_tx"), F.lit(1 << 30)))
    nth = F.row_number().over(Window.partitionBy("_source", "_class", group).orderBy("_rank", "_id", "_tx"))
    more = F.coalesce((F.col("_take") > 0) & ((F.col("_range") < F.col("_edge")) | (at_edge & (nth <= F.col("_in")))), F.lit(False))
    copies = F.when(F.col("_words") > 0, F.coalesce(F.col("_whole"), F.lit(0)) + more.cast("long")).otherwise(0).cast("long")
    out = placed.withColumn("_copies", copies)
    return out.select(F.col("_id").alias("doc_id"), F.col("_tx").alias("tx"), F.col("_source").alias("source"), F.col("_words").alias("size"), F.col("_size").cast("long").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_words")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs, each row as often as the mix takes it; the columns of docs, whatever they are called.

    Rows that repeat an id and a text share their copies: each takes an equal part, the first of them (by all their columns) the remainder.
    """
    i, t, rows, copies, nth, one = fresh(docs, "__id", "__tx", "__rows", "__copies", "__nth", "__one")
    decided = mix(docs, **options).where("copies > 0").groupBy(F.col("doc_id").alias(i), F.col("tx").alias(t)).agg(F.count("*").alias(rows), F.sum("copies").alias(copies))
    found = docs.join(decided, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(t)))
    several = found.where(F.col(rows) > 1).withColumn(nth, F.row_number().over(Window.partitionBy(i, t).orderBy(whole_row(docs))))
    share = F.floor(F.col(copies) / F.col(rows)) + (F.col(nth) <= F.col(copies) % F.col(rows)).cast("long")
    several = several.withColumn(copies, share).drop(nth)
    every = found.where(F.col(rows) == 1).unionByName(several)
    return every.withColumn(one, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    out = mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
