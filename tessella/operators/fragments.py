"""Fragments: mates put together as one chain of features, collapsed, filtered by span, and measured.

A feature is struct<code,left,right>: a block (S), an intron (I) or the gap between two mates (G).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.intervals import strands_agree
from tessella.functions.stats import normal_cdf
from tessella.operators.joins import MAX_SPAN

#: A span is an outlier beyond this share of the normal distribution, of SPREAD deviations.
OUTLIER, SPREAD = 0.999, 5


def ordered(features: Column) -> Column:
    """Features by left end, then length."""
    placed = F.array_sort(F.transform(features, lambda f: F.struct(f["left"].alias("left"), f["right"].alias("right"), f["code"].alias("code"))))
    return F.transform(placed, lambda f: F.struct(f["code"].alias("code"), f["left"].alias("left"), f["right"].alias("right")))


def merge_mates(features: Column) -> Column:
    """Features of overlapping mates, in order, as one chain; null where they contradict each other.

    Neighbours that are both introns must be the same one; neighbours that are both blocks must touch or
    overlap (a block may start where the one before ends) and become one.
    """
    start = F.struct(F.lit(True).alias("sound"), F.slice(features, 1, 1).alias("done"))

    def step(a: Column, f: Column) -> Column:
        last = F.element_at(a["done"], -1)
        same = last["code"] == f["code"]
        grown = F.struct(last["code"].alias("code"), last["left"].alias("left"), F.greatest(last["right"], f["right"]).alias("right"))
        joined = F.concat(F.slice(a["done"], 1, F.size(a["done"]) - 1), F.array(grown))
        equal = (last["left"] == f["left"]) & (last["right"] == f["right"])
        sound = a["sound"] & F.when(~same, F.lit(True)).when(f["code"] == "I", equal).otherwise(last["right"] >= f["left"])
        return F.struct(sound.alias("sound"), F.when(same, joined).otherwise(F.concat(a["done"], F.array(f))).alias("done"))

    rest = F.slice(features, 2, F.greatest(F.size(features) - 1, F.lit(1)))
    return F.when(F.size(features) == 0, features).otherwise(F.aggregate(rest, start, step, lambda a: F.when(a["sound"], a["done"])))


def joined_features(first: Column, second: Column) -> Column:
    """The features of a pair, the first mate's first: with a gap between them, or merged where they meet."""
    stop, start = F.element_at(first, -1)["right"], second[0]["left"]
    gap = F.array(F.struct(F.lit("G").alias("code"), (stop + 1).alias("left"), (start - 1).alias("right")))
    return F.when(start - stop - 1 > 0, F.concat(first, gap, second)).otherwise(merge_mates(ordered(F.concat(first, second))))


def left(features: Column) -> Column:
    return features[0]["left"]


def right(features: Column) -> Column:
    return F.array_max(F.transform(features, lambda f: f["right"]))


def gap(features: Column) -> Column:
    """struct(left, right) of the gap between mates; null without one."""
    return F.get(F.filter(features, lambda f: f["code"] == "G"), F.lit(0))


def is_single(features: Column) -> Column:
    return ~F.exists(features, lambda f: f["code"] == "G")


def exonic_length(features: Column) -> Column:
    return F.aggregate(features, F.lit(0).cast("long"), lambda a, f: a + F.when(f["code"] == "S", f["right"] - f["left"] + 1).otherwise(0))


def length_within(exons: Column, start: Column, stop: Column) -> Column:
    """Positions of exons (array<struct<left,right>>) from start to stop."""
    return F.aggregate(exons, F.lit(0).cast("long"), lambda a, e: a + F.greatest(F.least(e["right"], stop) - F.greatest(e["left"], start) + 1, F.lit(0)))


def start_offset(exons: Column, at: Column) -> Column:
    """The place of a position in the transcript, from 1; 0 if no exon has it."""
    before = F.aggregate(exons, F.lit(0).cast("long"), lambda a, e: a + F.when(e["right"] < at, e["right"] - e["left"] + 1).when(e["left"] <= at, at - e["left"] + 1).otherwise(0))
    return F.when(F.exists(exons, lambda e: (e["left"] <= at) & (at <= e["right"])), before).otherwise(F.lit(0).cast("long"))


def fragments(hits: DataFrame, group: list[str]) -> DataFrame:
    """Fragments of hits (id, name, left, right, strand, mass, mate_left, features) of a group.

    A hit without a mate is a fragment; mates whose positions cross are one, with both masses and the
    strand that either knows; of several mates of one name and place the first pair up, in order of id.
    Hits whose mate isn't found, mates at one position or too far apart, and pairs that contradict each other, go.
    Columns: group, id, strand, mass, features, spans (of each hit).
    """
    span = (F.col("right") - F.col("left") + 1).alias("span")
    own = hits.select(*group, "id", "name", "left", "mate_left", "strand", "mass", "features", span)
    single = own.where("mate_left is null").select(*group, "id", "strand", "mass", "features", F.array("span").alias("spans"))
    # Mates agree on both positions, so they meet in one group of a few rows.
    ends = [F.least("left", "mate_left").alias("__low"), F.greatest("left", "mate_left").alias("__high")]
    mates = own.where(f"mate_left <> left and abs(mate_left - left) <= {MAX_SPAN}").select(*group, "name", *ends, (F.col("left") < F.col("mate_left")).alias("__first"), F.struct("id", "strand", "mass", "features", "span").alias("__hit"))
    side = lambda first: F.array_sort(F.collect_list(F.when(F.col("__first") == first, F.col("__hit"))))
    met = mates.groupBy(*group, "name", "__low", "__high").agg(side(True).alias("__a"), side(False).alias("__b"))
    pairs = met.select(*group, F.explode(F.zip_with("__a", "__b", lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    both = pairs.where("p.a is not null and p.b is not null").where(strands_agree(F.col("p.a.strand"), F.col("p.b.strand"))).select(
        *group,
        "p.a.id",
        F.when(F.col("p.a.strand") == "?", F.col("p.b.strand")).otherwise(F.col("p.a.strand")).alias("strand"),
        (F.col("p.a.mass") + F.col("p.b.mass")).alias("mass"),
        joined_features(F.col("p.a.features"), F.col("p.b.features")).alias("features"),
        F.array("p.a.span", "p.b.span").alias("spans"),
    )
    return single.unionByName(both.where("features is not null"))


def without_outliers(df: DataFrame, group: list[str], spans: str = "spans", outlier: float = OUTLIER) -> DataFrame:
    """Rows none of whose spans lies far above the others of its group."""
    facts = df.select(*group, F.explode(spans).alias("x")).groupBy(*group).agg(F.avg("x").alias("__mean"), F.stddev_pop("x").alias("__sd"))
    far = F.exists(spans, lambda x: normal_cdf((x - F.col("__mean")) / (SPREAD * F.col("__sd"))) > outlier)
    return df.join(facts, group).where((F.col("__sd") == 0) | ~far).drop("__mean", "__sd")


def collapse(df: DataFrame, group: list[str]) -> DataFrame:
    """Equal fragments as one: n_reads, summed mass, ends, and an id that is the least of theirs."""
    rows = df.groupBy(*group, "strand", "features").agg(F.count("*").alias("n_reads"), F.sum("mass").alias("mass"), F.min("id").alias("id"))
    return rows.withColumn("left", left(F.col("features"))).withColumn("right", right(F.col("features")))


def anchored(df: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each feature: ``keep``, code, left, right, and anchor, the shorter neighbour of an intron."""
    size = lambda f: f["right"] - f["left"] + 1
    rows = df.select(*keep, F.explode(F.transform("features", lambda f, i: F.struct(f["code"].alias("code"), f["left"].alias("left"), f["right"].alias("right"), F.least(size(F.get("features", i - 1)), size(F.get("features", i + 1))).alias("anchor")))).alias("f"))
    return rows.select(*keep, "f.*")


def strand_runs(df: DataFrame, group: list[str]) -> DataFrame:
    """``df`` (id, left, right, strand, features) with run, part and run_strand.

    A run is a maximal chain of overlapping fragments.  Its spliced fragments of a known strand, in
    order, are cut in two where that leaves the purest parts; fragments between the two at the cut belong
    to both parts, and one that contradicts its part's strand to neither.  A run that isn't cut
    has the strand of its last such fragment, or none.
    """
    from tessella.operators.cluster import gap_cluster

    rows = gap_cluster(df, group, "id", gap=0, out="run")
    place = F.struct("left", "right", "id")
    known = rows.where(F.col("strand").isin("+", "-") & F.exists("features", lambda f: f["code"] == "I")).select(*group, "run", place.alias("at"), (F.col("strand") == "-").cast("int").alias("label"))
    by, order = Window.partitionBy(*group, "run"), Window.partitionBy(*group, "run").orderBy("at")
    i, n = F.row_number().over(order), F.count("*").over(by)
    one, ones = F.sum("label").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum("label").over(by)
    scored = known.select(*group, "run", "at", "label", i.alias("i"), n.alias("n"), F.lead("at").over(order).alias("next"), F.lead("label").over(order).alias("next_label"), (F.greatest(one, i - one) + F.greatest(ones - one, n - i - (ones - one))).alias("score"))
    cuts = scored.groupBy(*group, "run").agg(F.max_by(F.struct("i", "n", "at", "next", "label"), F.struct("score", "i")).alias("c"), F.max_by("label", "i").alias("last")).select(*group, "run", "c.*", "last")
    sign = lambda label: F.when(label == 0, "+").when(label == 1, "-").otherwise("?")
    cut = F.col("i").isNotNull() & (F.col("i") < F.col("n"))
    whole = F.array(F.struct(F.lit(0).alias("part"), sign(F.col("last")).alias("run_strand")))
    first = F.when(place < F.col("next"), F.struct(F.lit(0).alias("part"), sign(F.col("label")).alias("run_strand")))
    second = F.when(place > F.col("at"), F.struct(F.lit(1).alias("part"), sign(1 - F.col("label")).alias("run_strand")))
    parts = F.when(cut, F.filter(F.array(first, second), lambda x: x.isNotNull())).otherwise(whole)
    dealt = rows.join(cuts, [*group, "run"], "left").withColumn("p", F.explode(parts))
    kept = dealt.where((F.col("strand") == "?") | (F.col("strand") == F.col("p.run_strand")))
    return kept.select(*df.columns, "run", "p.part", "p.run_strand")
