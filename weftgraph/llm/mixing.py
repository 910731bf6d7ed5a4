"""Mixing sources to target weights by pivotal dependent rounding (DataFrame operations only).

Every document of a source gets the same expected number of copies, target over source size.
Its whole part is sure. The fractions are rounded together: two documents' fractional words
are paired, mass moves at random from one to the other (in expectation nobody gains) until
one of them is integral, and the other goes on. A bucket of about ``FAN`` documents ends with
one fractional document; those meet in buckets of ``FAN`` again, a reduction tree per source
of depth log(documents) / log(FAN). The fraction left at a source's root is taken as that share
of the document's words, so a source ends within a word a row of its target.

A hot source is spread over as many buckets as it has documents / ``FAN``; no task or group
holds more than about ``FAN`` documents at any level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small, uniform

FAN = 64
#: Up to so many sources, their table (one row each) is broadcast.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
UNIT = "struct<ord:bigint,doc_id:bigint,size:bigint,m:bigint,w:double,p:double,u:double>"
DONE = "struct<doc_id:bigint,size:bigint,m:bigint,take:int>"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """(source, source_size, target) from ``sizes`` (source, source_size): shares of ``budget`` times
    all words by the cyclic ``weights`` over the sources in code-point order (null last), no
    target above ``most`` times its source; what is cut off goes to the others by weight.

    The level at which the shares settle is found from running sums over the sources in the order in
    which they fill up. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sizes.select(
        "*", F.get(cycle, (F.row_number().over(by_name) - 1) % F.lit(len(weights))).alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")
    )
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    levels = ranked.select(
        "*",
        F.row_number().over(fill).alias("pos"),
        (
            (F.sum("source_size").over(everyone) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        ).alias("level"),
    )
    settled = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("pos", "level"))).over(everyone)
    return levels.select("source", "source_size", "cap", "weight", settled["level"].alias("at")).select(
        "source", "source_size", F.coalesce(F.least("cap", F.col("at") * F.col("weight")), "cap").alias("target")
    )


def _pair(acc: Column, x: Column) -> Column:
    """One pairing: ``acc.r`` and ``x`` hold w words each of which the fraction p is in the mix."""
    i = acc["r"]
    gain = F.least(i["w"] * (1 - i["p"]), x["w"] * x["p"])  # what can move from x to i
    loss = F.least(i["w"] * i["p"], x["w"] * (1 - x["p"]))  # what can move from i to x
    up = x["u"] * (gain + loss) < loss
    i_stops = F.when(up, i["w"] * (1 - i["p"]) <= x["w"] * x["p"]).otherwise(i["w"] * i["p"] <= x["w"] * (1 - x["p"]))

    def at(unit: Column, p: Column) -> Column:
        return F.struct(*[unit[c].alias(c) for c in ("ord", "doc_id", "size", "m", "w")], F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"), unit["u"].alias("u"))

    def done(unit: Column, take: Column) -> Column:
        return F.array(F.struct(unit["doc_id"].alias("doc_id"), unit["size"].alias("size"), unit["m"].alias("m"), take.cast("int").alias("take")))

    rest = F.when(i_stops, at(x, F.when(up, x["p"] - gain / x["w"]).otherwise(x["p"] + loss / x["w"]))).otherwise(
        at(i, F.when(up, i["p"] + gain / i["w"]).otherwise(i["p"] - loss / i["w"]))
    )
    fixed = F.when(i_stops, done(i, up)).otherwise(done(x, ~up))
    return F.struct(rest.cast(UNIT).alias("r"), F.concat(acc["done"], fixed).cast(f"array<{DONE}>").alias("done"))


def _round(units: DataFrame) -> DataFrame:
    """(source, bucket, r, done): each bucket's fractions paired until one document is left."""
    fold = F.aggregate(
        F.slice("units", 2, F.size("units")),
        F.struct(F.get("units", F.lit(0)).cast(UNIT).alias("r"), F.array().cast(f"array<{DONE}>").alias("done")),
        _pair,
    )
    grouped = units.groupBy("source", "bucket").agg(F.sort_array(F.collect_list("unit")).alias("units"))
    return grouped.select("source", "bucket", fold.alias("st")).select("source", "bucket", "st.r", "st.done")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    budget: float = 1.5,
    most: float = 2.0,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, copies, part.

    ``copies`` whole copies and the first ``part`` words of one more are in the mix;
    taken = copies * size + part. Only a source's last document can have a part.

    A null text has size 0 and takes 0. Null is a source of its own, the last. Rows that
    repeat an id, source and size are rounded as one and come back as often as they came.
    An empty table gives an empty result. Columns not named are ignored. The draws
    depend on ``seed``, ids and sizes only, so a rerun on any cluster gives the same mix.
    """
    units = cut(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        )
        .groupBy("doc_id", "source", "size")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    per_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    sources = cut(
        source_targets(per_source.select("source", "source_size"), weights, budget, most)
        .alias("t")
        .join(per_source.alias("n"), F.col("t.source").eqNullSafe(F.col("n.source")))
        .select("t.source", "t.source_size", "target", "n_units", F.greatest(F.lit(1), F.ceil(F.col("n_units") / FAN)).alias("buckets"))
        .withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("copies", F.floor(F.col("ratio") + F.lit(1e-12)))
        .withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - F.col("copies")))
    )
    n_sources, n_most = sources.agg(F.count(F.lit(1)), F.max("n_units")).first()
    plan = small(sources, n_sources, BROADCAST_SOURCES)

    known = units.alias("u").join(plan.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source"))).select("u.doc_id", "u.source", "u.size", "u.m", "s.p", "s.buckets")
    open_ = (F.col("p") > 1e-12) & (F.col("size") > 0)
    settled = known.where(~open_).select("source", "doc_id", "size", "m", F.lit(0).alias("take"), F.lit(0.0).alias("rest"))
    key = (F.lit(seed), F.col("doc_id"), F.col("size"))
    level = known.where(open_).select(
        "source",
        F.pmod(F.xxhash64(F.lit("bucket"), *key), F.col("buckets")).alias("bucket"),
        F.struct(
            F.xxhash64(F.lit("order"), *key).alias("ord"), "doc_id", "size", "m", (F.col("size") * F.col("m")).cast("double").alias("w"), "p", uniform(F.lit("draw"), F.lit(0), *key).alias("u")
        ).alias("unit"),
    )
    for depth in range(max(1, 1 + math.ceil(math.log(max(1, math.ceil((n_most or 0) / FAN)), FAN) - 1e-9))):
        folded = cut(_round(level))
        settled = settled.unionByName(
            folded.select("source", F.explode("done").alias("d")).select("source", "d.doc_id", "d.size", "d.m", "d.take", F.lit(0.0).alias("rest"))
        )
        r = F.col("r")
        again = uniform(F.lit("draw"), F.lit(depth + 1), F.lit(seed), r["doc_id"], r["size"])
        level = folded.select(
            "source", F.floor(F.col("bucket") / FAN).alias("bucket"), F.struct(*[r[c].alias(c) for c in ("ord", "doc_id", "size", "m", "w", "p")], again.alias("u")).alias("unit")
        )
    roots = level.select(
        "source", "unit.doc_id", "unit.size", "unit.m", (F.col("unit.p") >= F.lit(1 - 1e-12)).cast("int").alias("take"), F.when((F.col("unit.p") > 1e-12) & (F.col("unit.p") < 1 - 1e-12), F.col("unit.p")).otherwise(F.lit(0.0)).alias("rest")
    )
    every = settled.unionByName(roots).alias("d").join(plan.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return every.select(
        "d.doc_id",
        "d.size",
        "s.source_size",
        "s.target",
        "d.source",
        (F.col("s.copies") + F.col("d.take")).cast("bigint").alias("copies"),
        F.round(F.col("rest") * F.col("d.size")).cast("bigint").alias("part"),
        F.explode(F.array_repeat(F.lit(1), F.col("d.m").cast("int"))).alias("_"),
    ).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"), "source", "copies", "part")
