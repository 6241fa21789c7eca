"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document draws an exponential key -ln(u) / w, u being fixed by its id and the seed and w its quality weight. Each
source gets a word budget: its weight's share of the total, cut at ``max_epochs`` times its size, the excess shared again
by weight. A source's whole epochs take every document; what is left of the budget goes to its documents in key order,
up to the one whose prefix sum comes nearest to the budget.

Prefix sums grow along the order, so a source's budget ends at one place in it, and the whole mix is one row per source:
its epochs and where its order is cut. That place is found in two steps over narrow rows: keys fall into ``bins`` ranges
per source, whose totals (at most bins x sources rows) are summed; a window then runs over the one range in which the
budget ends. Whether a document is taken is told by its own columns and that row, without moving texts.

Defined cases: null text has 0 words; a null source is a source of its own, last in order; a source without words has
target 0; ties in the key go by id, then size, then a hash of the text; rows that agree in all of these and stand at the
cut share what it takes evenly; a null id is keyed by its text; repeated rows are separate documents; very long texts
are counted whole; further columns, whatever their names, are ignored by :func:`mix_sources` and pass through
:func:`take`; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.llm.common import WORD_PATTERN, Scratch, materialize, no_nulls, unused
from nodeloom.sources.catalog import quoted

WEIGHTS = (3, 1, 2)


def word_count(text_col: str = "text") -> F.Column:
    return F.regexp_count(no_nulls(text_col), F.lit(WORD_PATTERN)).cast("long")


def source_key(source_col: str = "source") -> F.Column:
    """Sorts by code point, null last."""
    return F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Of (skey, source_size): target. One row per source, so the windows below see one row per source."""
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy("skey")) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    # in the order of cap/weight, all sources before the first whose cap is not below its share are cut at their caps
    order = Window.orderBy("ratio", "skey")
    rows = rows.withColumn("cut_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * share - F.col("cut_before")) / F.col("weight_left"))
    rows = rows.withColumn("free_level", F.max(F.when(F.col("level") <= F.col("ratio"), F.struct((-F.col("ratio")).alias("r"), F.col("level").alias("level")))).over(everything)["level"])
    target = F.when(F.col("level") > F.col("ratio"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("free_level")))
    return rows.select("skey", "source_size", target.alias("target"))


class Mix:
    """Where each source's order is cut, as one row per source, and what that takes of a document.

    ``quality``: a positive weight over ``docs``' columns and, as :attr:`SIZE`, the number of words.
    """

    SIZE = "mix_size"

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: F.Column | None = None, seed: int = 7, bins: int = 256, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 2) -> None:
        self.id_col, self.text_col, self.source_col, self.seed = id_col, text_col, source_col, seed
        self.quality = 1.0 + F.least(F.col(self.SIZE), F.lit(1000)) / 1000.0 if quality is None else quality
        scratch = Scratch(docs.sparkSession)
        self.rows = rows = materialize(self._narrow(docs), "mix")
        sizes = scratch.keep(rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.avg("key").alias("scale")), "sources")
        goals = targets(sizes.select("skey", "source_size"), weights, share, max_epochs).join(sizes.select("skey", "scale"), "skey")
        epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
        goals = goals.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        goals = scratch.keep(goals, "goals")
        # ranges of the key; its mean spreads exponential keys over them, any other spread would only cost time
        binned = rows.join(goals.select("skey", "scale", "rest"), "skey").withColumn("bin", F.floor((1 - F.exp(-F.col("key") / F.greatest("scale", F.lit(1e-300)))) * bins).cast("int"))
        totals = scratch.keep(binned.groupBy("skey", "bin").agg(F.sum("size").alias("bin_size"), F.first("rest").alias("rest")), "bins")
        upto = F.sum("bin_size").over(Window.partitionBy("skey").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        first = totals.withColumn("upto", upto).where("upto > rest").groupBy("skey").agg(F.min(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("ahead"))).alias("cut"))
        first = scratch.keep(first.select("skey", "cut.bin", "cut.ahead"), "cuts")
        # inside the range where the budget ends: rows that agree in everything once, in key order
        same = binned.join(first, ["skey", "bin"]).groupBy("skey", "ahead", "rest", *self.ORDER).agg(F.count(F.lit(1)).alias("copies"))
        begin = F.sum(F.col("size") * F.col("copies")).over(Window.partitionBy("skey").orderBy(*self.ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") * F.col("copies")
        fits = F.floor((F.col("rest") - F.col("ahead") - F.col("begin")) / F.col("size") + 0.5)
        last = same.withColumn("begin", begin).where("size > 0").withColumn("fit", F.least(F.col("copies"), fits)).where("fit > 0")
        last = last.groupBy("skey").agg(F.max(F.struct(*self.ORDER, "fit", "copies")).alias("last"))
        cuts = goals.join(first, "skey", "left").join(last, "skey", "left").select("skey", "source_size", "target", "epochs", "scale", "bin", "last", F.lit(bins).alias("bins"))
        #: One row per source: what its documents are taken by.
        self.cuts = materialize(cuts, "cuts")
        scratch.drop()

    ORDER = ("key", "own", "size", "tie")

    def _narrow(self, docs: DataFrame, *more: F.Column) -> DataFrame:
        own, tie = F.col(self.id_col), F.xxhash64(no_nulls(self.text_col))
        told = F.coalesce(own.cast("string"), F.concat(F.lit("null:"), tie.cast("string")))
        uniform = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(self.seed)), told)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
        rows = docs.withColumn(self.SIZE, word_count(self.text_col))
        return rows.select(own.alias("doc_id"), told.alias("own"), F.col(self.SIZE).alias("size"), source_key(self.source_col).alias("skey"), tie.alias("tie"), (-F.log(uniform) / self.quality).alias("key"), *more)

    @classmethod
    def _taken(cls) -> F.Column:
        """Words taken of a row of :meth:`_narrow` joined with the cut of its source."""
        place = F.floor((1 - F.exp(-F.col("key") / F.greatest("scale", F.lit(1e-300)))) * F.col("bins")).cast("int")
        here, last = F.struct(*cls.ORDER), F.struct(*[F.col(f"last.{c}").alias(c) for c in cls.ORDER])
        cut = F.when(F.col("last").isNull() | (here > last), F.lit(0)).when(here == last, F.floor(F.col("size") * F.col("last.fit") / F.col("last.copies"))).otherwise(F.col("size"))
        part = F.when(F.col("bin").isNull() | (place < F.col("bin")), F.col("size")).when(place == F.col("bin"), cut).otherwise(F.lit(0))
        return (F.col("epochs") * F.col("size") + part).cast("long")

    def table(self) -> DataFrame:
        """One row per document: doc_id, size, source_size, target, taken, skey."""
        return self.rows.join(self.cuts, "skey").select("doc_id", "size", "source_size", "target", self._taken().alias("taken"), "skey")


def mix_sources(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, size, source_size, target, taken, skey; options as for :class:`Mix`."""
    return Mix(docs, **options).table()


ADDED = ("size", "source_size", "target", "taken")


def take(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` that the mix takes something of, with :data:`ADDED`, which replace columns of those names.

    Rows stay where they are: all that is needed of the rest is one row per source.
    """
    mix = Mix(docs, **options)
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    whole = unused(docs, "mix_row")
    rows = mix._narrow(docs.withColumn(whole, F.struct(*[F.col(quoted(c)) for c in kept])), F.col(whole).alias("row"))
    rows = rows.join(mix.cuts, "skey").withColumn("taken", mix._taken()).where("taken > 0")
    return rows.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in kept], *ADDED)


SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (SELECT *, -ln((('0x' || substr(md5('7:' || doc_id::VARCHAR), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
                / (1 + least(size, 1000) / 1000.0::DOUBLE) AS key FROM d),
s AS (SELECT skey, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY skey) - 1 AS rank FROM d GROUP BY skey),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + rank % 3] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY ratio, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT skey, source_size, CASE WHEN level > ratio THEN cap
             ELSE least(cap, weight * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio)) END AS target FROM l),
p AS (SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
             sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM k JOIN t USING (skey))
SELECT doc_id, size, source_size, target,
       (epochs * size + CASE WHEN upto - size / 2.0::DOUBLE <= target - epochs * source_size THEN size ELSE 0 END)::BIGINT AS taken, skey FROM p
"""
