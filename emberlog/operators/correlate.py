"""Lagged correlation of error counts between services."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberlog.functions.labels import service_label
from emberlog.functions.messages import is_error_once
from emberlog.functions.regex import BOUNDARY
from emberlog.operators.ordering import at_places, first_places, kept, with_first

# Fixed values.
WINDOW_SECONDS = 10
MAX_LAG = 5
MIN_CONFIDENCE = 0.5
# Source rows per part of a bucket when a bucket is split.
SPLIT_SERVICES = 1000
CHRONOLOGICAL = ("file", "line_no")
# Classes of services by how many times their squares exceed what varies in them: class c up to 2**((c + 0.1) / 2)
# times. The last is for more, and for those in which nothing may vary.
FLAT = 61
# Up to so many services, pairs that share a bucket at all are multiplied out: an index would cost more.
FEW_SERVICES = 200
# Bounds in floating point are widened by this part.
SLACK = 1e-9
EXACT = "decimal(38,0)"


def mentions_service(msg: Column, service: Column) -> Column:
    """The service name occurs in the message as a word, in any case."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(service, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return (service != "") & F.regexp_like(msg, F.concat(F.lit("(?iu)" + BOUNDARY), quoted, F.lit(BOUNDARY)))


def cascade_pattern(lag: Column, window: Column, source: Column, target: Column,
                    source_error: Column, target_error: Column) -> Column:
    mentioned = mentions_service(source_error, target) | mentions_service(target_error, source)
    return (F.when(lag < window, "co_failure")
            .when(F.coalesce(mentioned, F.lit(False)), "cascade_timeout").otherwise("cascade_error"))


def _errors(logs: DataFrame, window_s: int) -> DataFrame:
    return (logs.where(is_error_once(F.col("msg")))
            .withColumns({"service": service_label(F.col("labels")), "bucket": F.floor(F.unix_seconds("ts") / window_s)})
            .where("service is not null"))


def bucket_places(logs: DataFrame, window_s: int = WINDOW_SECONDS, order: Sequence[str] = CHRONOLOGICAL) -> DataFrame:
    """Errors per service and time bucket, and the place of the first; one hash aggregation, written once."""
    return kept(first_places(_errors(logs, window_s), ["service", "bucket"], order, "errors"), "error-buckets")


def service_error_buckets(logs: DataFrame, window_s: int = WINDOW_SECONDS,
                          order: Sequence[str] = CHRONOLOGICAL) -> DataFrame:
    """Errors per service and time bucket, with the first message of the bucket."""
    places = bucket_places(logs, window_s, order)
    few = _errors(at_places(logs, places, order), window_s)
    return with_first(places, few, ["service", "bucket"], order, {"first_error": "msg"}).select("service", "bucket", "errors", "first_error")


def service_profiles(counts: DataFrame, max_lag: int) -> DataFrame:
    """One row per service: bucket range, sums, and what varies at least in it as a source and as a target.

    A lag cuts buckets off the end of the source and the start of the target, at most ``max_lag``
    of a service: ``xs, xss`` are its sums (of squares) without the last 0, 1, ... buckets, ``ys, yss`` without
    the first. Over a period of m buckets a service's counts vary by ``ss - s*s/m``; m is at least the
    service's own range, less what is cut off."""
    ranges = counts.groupBy("service").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))

    def sums(keep: str, power: str) -> str:
        return "array(" + ", ".join(f"cast(sum(if({keep.format(cut=cut)}, {power}, 0)) as {EXACT})" for cut in range(max_lag + 1)) + ")"

    def varies(s: str, ss: str) -> str:
        span = "cast(hi - lo + 1 - cut as decimal(20,0))"
        return (f"array_min(transform(sequence(0, {max_lag}), cut -> if(hi - lo + 1 - cut > 0, cast(cast({span} * {ss}[cut] as {EXACT}) "
                f"- cast({s}[cut] * {s}[cut] as {EXACT}) as double) / (hi - lo + 1 - cut), 0D)))")
    not_last, not_first = "bucket <= hi - {cut}", "bucket >= lo + {cut}"
    return (counts.join(ranges, "service").groupBy("service", "lo", "hi")
            .agg(F.expr(sums(not_last, "errors")).alias("xs"), F.expr(sums(not_last, "errors * errors")).alias("xss"),
                 F.expr(sums(not_first, "errors")).alias("ys"), F.expr(sums(not_first, "errors * errors")).alias("yss"))
            .selectExpr("*", "xss[0] as ss", f"{varies('xs', 'xss')} as x_varies", f"{varies('ys', 'yss')} as y_varies")
            .withColumns({"x_class": _class_of(F.col("x_varies")), "y_class": _class_of(F.col("y_varies"))}))


def _class_of(varies: Column) -> Column:
    ratio = F.log2(F.col("ss").cast("double") / varies)
    return F.when(varies > 0, F.least(F.ceil(2 * (ratio + SLACK) - 0.1), F.lit(FLAT))).otherwise(FLAT).cast("int")


def _prefix_rows(rows: DataFrame, group: Sequence[str], varies: str, threshold: float, partners: Sequence[int]) -> DataFrame:
    """The rows of a service by class of ``partner`` for which its bucket can still lift a pair over the
    threshold; ``below`` is the energy of its more common buckets.

    Buckets are taken from the most common to the rarest. As long as all so far together, at the greatest
    length of a partner, stay below the threshold, they need not be looked up: a pair that gets over
    it also meets in a rarer one."""
    upto = Window.partitionBy(*group).orderBy(F.desc("common"), F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("errors").cast("double")
    energy = F.sum(n * n).over(upto)
    # Of squares: energy * 2**((class + 0.1) / 2) > threshold**2 * varies.
    need = F.floor(2 * F.log2(F.lit(threshold * threshold) * F.col(varies) * (1 - SLACK) / (F.col("energy") * (1 + SLACK))) - 0.1)
    need = F.when((F.col(varies) > 0) & F.lit(threshold > 0), need).otherwise(0)
    open_to = F.filter(F.array(*map(F.lit, partners)), lambda c: (c >= F.col("need")) | (c == FLAT))
    return (rows.withColumn("energy", energy).withColumn("need", need).withColumn("partner", F.explode(open_to))
            .withColumn("below", F.greatest(F.col("energy") - n * n, F.lit(0.0))))


def meetings(counts: DataFrame, profiles: DataFrame, max_lag: int = MAX_LAG, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """A row ``source, target, lag, ...`` for every bucket in whose prefix rows a pair meets that may correlate by more
    than ``min_confidence``.

    A correlation is at most the product of the counts over what varies in either service. So this is a
    similarity join with a bound, and has a prefix filter: with all buckets in one order of rarity, a
    pair over the bound shares a bucket in the prefix of both. The prefix depends on how
    long a partner can be, of which there are a few classes; source and target meet by bucket and both classes."""
    present = profiles.select("x_class", "y_class").distinct().collect()  # at most 62 by 62
    x_classes, y_classes = (sorted({r[c] for r in present}) for c in ("x_class", "y_class"))
    threshold = max(min_confidence, 0.0)
    # Services that fail in a bucket, and sources that some lag moves there.
    buckets = (counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).selectExpr("bucket", "n", f"explode(sequence(0, {max_lag})) as lag")
               .groupBy((F.col("bucket") + F.col("lag")).alias("bucket")).agg(F.expr("sum(if(lag = 0, n, 0))").alias("common"), F.sum("n").alias("moved"))
               .where("common > 0"))  # a bucket without targets can lift no pair
    # A bucket in which very many services fail at once is split: its sources are dealt out
    # to parts, its targets are copied to each part.
    buckets = buckets.selectExpr("bucket", "common", f"cast(ceil(moved / {SPLIT_SERVICES}) as int) as parts")

    def side(kind: str, lags: str, group: list[str], partners: list[int]) -> DataFrame:
        own = counts.join(profiles.selectExpr("service", f"{kind}_varies", f"{kind}_class"), "service")
        moved = own.selectExpr("service", f"{kind}_varies", f"{kind}_class", "errors", "bucket", f"explode({lags}) as lag").withColumn("bucket", F.col("bucket") + F.col("lag"))
        rows = _prefix_rows(moved.join(buckets, "bucket"), group, f"{kind}_varies", threshold, partners)
        return rows.withColumns({kind: F.col("errors").cast("double"), f"{kind}_below": F.col("below")})
    sources = side("x", f"sequence(0, {max_lag})", ["service", "lag"], y_classes).selectExpr(
        "bucket", "x_class", "partner as y_class", "cast(pmod(xxhash64(service), parts) as int) as part", "service as source", "lag", "x", "x_below", "x_varies")
    targets = side("y", "array(0)", ["service"], x_classes).selectExpr(
        "bucket", "partner as x_class", "y_class", "explode(sequence(0, parts - 1)) as part", "service as target", "y", "y_below", "y_varies")
    meet = ["bucket", "x_class", "y_class", "part"]
    return sources.join(targets, meet).where("source <> target").drop(*meet)


def candidates(met: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``source, target, lag`` of the meetings that can still get over ``min_confidence``: by the products met, and at most the
    product of the lengths in buckets more common than any met (rarer ones that they share would have been met)."""
    best = F.col("xy") + F.sqrt(F.col("x_below") * F.col("y_below"))
    return (met.groupBy("source", "target", "lag")
            .agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.max(F.col("x_varies") * F.col("y_varies")).alias("varies"),
                 *(F.min(c).alias(c) for c in ("x_below", "y_below")))
            .where(best * (1 + SLACK) > max(min_confidence, 0.0) * F.sqrt("varies") * (1 - SLACK)).select("source", "target", "lag"))


def products(counts: DataFrame, pairs: DataFrame | None, max_lag: int = MAX_LAG) -> DataFrame:
    """The counts of both services in every bucket that a pair of ``source, target, lag`` shares; without
    ``pairs``, of all pairs that share any."""
    x = counts.select(F.col("service").alias("source"), F.col("errors").alias("x"), "bucket")
    y = counts.select(F.col("service").alias("target"), F.col("errors").alias("y"), "bucket")
    if pairs is None:
        x = x.selectExpr("source", "x", "bucket", f"explode(sequence(0, {max_lag})) as lag").withColumn("bucket", F.col("bucket") + F.col("lag"))
        return x.join(y, "bucket").where("source <> target")
    return pairs.join(x, "source").withColumn("bucket", F.col("bucket") + F.col("lag")).join(y, ["target", "bucket"])


def correlate(logs: DataFrame, window_s: int = WINDOW_SECONDS, max_lag: int = MAX_LAG,
              min_confidence: float = MIN_CONFIDENCE, order: Sequence[str] = CHRONOLOGICAL) -> DataFrame:
    """Pairs of services whose error counts correlate, the source leading by 0..max_lag buckets.

    Only pairs that a bound on the correlation leaves open are multiplied out (never a cross join of
    services, never empty buckets filled in); sums over the part of the range that a lag cuts off
    are corrected with the few buckets at the cut. Messages are fetched at the end, for the services found."""
    places = bucket_places(logs, window_s, order)
    counts = places.select("service", "bucket", F.col("errors").cast("decimal(20,0)").alias("errors"))
    profiles = kept(service_profiles(counts, max_lag), "correlation-services")
    few = profiles.count() <= FEW_SERVICES
    pairs = None if few else candidates(meetings(counts, profiles, max_lag, min_confidence), min_confidence)
    sums = products(counts, pairs, max_lag).groupBy("source", "target", "lag").agg(F.sum(F.col("x") * F.col("y")).cast(EXACT).alias("sxy"))
    scored = (sums.join(profiles.selectExpr("service as source", "lo as x_lo", "hi as x_hi", "xs", "xss"), "source")
              .join(profiles.selectExpr("service as target", "lo as y_lo", "hi as y_hi", "ys", "yss"), "target")
              .selectExpr("source", "target", "lag", "sxy", "least(x_lo, y_lo) as lo", "greatest(x_hi, y_hi) as hi", "x_hi", "y_lo", "xs", "xss", "ys", "yss")
              .selectExpr("source", "target", "lag", "sxy", "cast(hi - lo + 1 - lag as decimal(20,0)) as m", "cast(greatest(x_hi - (hi - lag), 0) as int) as x_cut",
                          "cast(greatest(lo + lag - y_lo, 0) as int) as y_cut", "xs", "xss", "ys", "yss")
              .where("m > 0")
              .selectExpr("source", "target", "lag", "sxy", "m", "xs[x_cut] as sx", "xss[x_cut] as sxx", "ys[y_cut] as sy", "yss[y_cut] as syy")
              .selectExpr("source", "target", "lag", "sx", "sy", *(
                  f"cast(m * {a} as {EXACT}) - cast({b} * {c} as {EXACT}) as {d}"
                  for a, b, c, d in (("sxx", "sx", "sx", "dx"), ("syy", "sy", "sy", "dy"), ("sxy", "sx", "sy", "dxy")))))
    r = F.expr("if(dx = 0 or dy = 0, if(sx > 0 and sy > 0, 1D, 0D), greatest(0D, try_divide(cast(dxy as double), sqrt(cast(dx as double)) * sqrt(cast(dy as double)))))")
    best_lag = Window.partitionBy("source", "target").orderBy(F.desc("r"), "lag")
    scored = (scored.withColumn("r", r)
              .withColumn("_rank", F.row_number().over(best_lag)).where("_rank = 1")
              .where(F.col("r") > min_confidence)
              .withColumn("confidence", F.round("r", 2))
              .where(F.col("confidence") > min_confidence))
    found = kept(best_direction(scored.select("source", "target", "lag", "confidence")), "correlations")

    # The first error of each service found.
    named = found.select(F.col("source").alias("service")).union(found.select("target")).distinct()
    lead = [c for c in places.columns if c not in ("service", "bucket", "errors", "_at")]
    first = F.row_number().over(Window.partitionBy("service").orderBy(*lead, "_at"))
    firsts = places.join(named, "service", "left_semi").withColumn("_rank", first).where("_rank = 1").select("service", *lead, "_at")
    texts = with_first(firsts, _errors(at_places(logs, firsts, order), window_s), ["service"], order, {"text": "msg"})
    texts = kept(texts.select("service", "text"), "first-errors")
    found = (found.join(texts.toDF("source", "source_error"), "source", "left").join(texts.toDF("target", "target_error"), "target", "left"))
    return found.select(
        "source", "target", (F.col("lag") * float(window_s)).cast("double").alias("lag_seconds"),
        cascade_pattern(F.col("lag") * window_s, F.lit(window_s), F.col("source"), F.col("target"),
                        F.col("source_error"), F.col("target_error")).alias("pattern"),
        "confidence", "source_error", "target_error")


def best_direction(correlations: DataFrame) -> DataFrame:
    """Of the two directions of a pair keep the more confident, of equals the first source."""
    pair = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target"))
    return (correlations
            .withColumn("_rank", F.row_number().over(pair.orderBy(F.desc("confidence"), "source")))
            .where("_rank = 1").drop("_rank"))


# ---- sequence tables: over the list of correlations, one row per pair of services ------

def participants(correlations: DataFrame) -> DataFrame:
    """Sources in order of first appearance (by confidence), then pure targets A-Z."""
    listed = Window.orderBy(F.desc("confidence"), "source", "target")
    ranked = correlations.withColumn("_i", F.row_number().over(listed))
    names = (ranked.select(F.col("source").alias("name"), "_i")
             .unionByName(ranked.select(F.col("target").alias("name"), F.lit(None).cast("int").alias("_i"))))
    return (names.groupBy("name").agg(F.min("_i").alias("_i"))
            .select("name", (F.row_number().over(Window.orderBy(F.asc_nulls_last("_i"), "name")) - 1)
                    .cast("bigint").alias("index")))


def interactions(correlations: DataFrame) -> DataFrame:
    """Arrows in order of lag, with label text."""
    label = F.format_string("%s +%.0fs (%.0f%%)", F.col("pattern"), F.col("lag_seconds"), F.col("confidence") * 100)
    position = Window.orderBy("lag_seconds", F.desc("confidence"), "source", "target")
    return correlations.select(
        F.row_number().over(position).cast("bigint").alias("position"),
        F.col("source").alias("from"), F.col("target").alias("to"), "lag_seconds", "pattern", "confidence",
        label.alias("label"))
