"""Small rule ladders that turn measures into words."""

from pyspark.sql import Column, functions as F


def percent_change(before: Column, after: Column) -> Column:
    before, after = before.cast("double"), after.cast("double")
    return F.when(before != 0, (after - before) / F.nullif(before, F.lit(0.0)) * 100).when(
        after == 0, F.lit(0.0)).otherwise(F.lit(100.0))


def percent_text(pct: Column) -> Column:
    """``+340%`` or ``-20%``; halves go to the even number, and small losses are ``-0%``."""
    return F.concat(F.when(pct >= 0, F.lit("+")).otherwise(F.lit("")), F.format_string("%.0f", F.rint(pct)), F.lit("%"))


# Fixed values of the baseline verdict: bounds in percent and the confidence of each outcome.
def verdict(error_change: Column, volume_change: Column, has_new: Column) -> Column:
    """Struct (verdict, confidence) for error-rate change, volume change and new patterns."""
    def outcome(name, confidence):
        return F.struct(F.lit(name).alias("verdict"),
                        (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"))

    steady = F.abs(error_change)
    return (
        F.when(error_change < -20, outcome("improvement", F.when(error_change < -50, 0.9).otherwise(0.7)))
        .when((error_change > 50) & has_new, outcome(
            "regression", F.when(error_change > 200, 0.95).when(error_change > 100, 0.85).otherwise(0.7)))
        .when((F.abs(volume_change) > 50) & (steady <= 50), outcome("different", 0.6))
        .when((error_change > 50) & ~has_new, outcome("different", 0.5))
        .when((steady <= 20) & ~has_new, outcome("stable", F.when(steady <= 5, 0.95).otherwise(0.8)))
        .when(has_new, outcome("different", 0.5))
        .otherwise(outcome("stable", 0.5))
    )


def severity(error_rate_pct: Column, critical: Column) -> Column:
    return (F.when(critical | (error_rate_pct > 5), "high")
            .when(error_rate_pct > 1, "medium").otherwise("low"))
