"""The alert job replayed over history: sliding error counts, then firing with the cooldown.

The job looks once a minute. The tick at minute T counts the errors of the minutes T-w to T-1. A
rule that fired stays quiet for the cooldown, so its firings depend on each other. Days are worked
on in parallel all the same: for each day we work out how the cooldown left over at its start maps
to the one left over at its end (a table of ten numbers), chain these tables over the days, and
then replay every day from its known start. No step holds more of a rule than the minutes of one
day or one row per day.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.functions.times import MINUTE_US, epoch_minute, floor_minute, micros, minute_number, minute_to_time, time_type, ts_literal
from cinderlog.operators.alerts import by_scope, rule_scope
from cinderlog.operators.search import in_range
from cinderlog.schemas import ALERT_COOLDOWN_MINUTES
from cinderlog.sources.workspace import written

DAY = 1440
PAIR = ["service", "window_minutes"]
RULE = PAIR + ["threshold", "quiet"]


def _day(tick: Column) -> Column:
    return ((tick - F.pmod(tick, F.lit(DAY))) / DAY).cast("long")


def _pairs(rules: DataFrame) -> DataFrame:
    asked = rules.select(rule_scope(F.col("service")).alias("service"), F.col("window_minutes").cast("long"))
    return asked.where("window_minutes > 0").distinct()


def sliding_counts(logs: DataFrame, rules: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Error count at every minute tick in (start, end], per distinct (service, window) of the rules.

    `logs` is the logs table, or the roll-up, which has all that is needed.

    Given as (service, window_minutes, tick_from, tick_to, errors): the count holds for the ticks
    tick_from <= tick < tick_to, numbered in minutes since the epoch. Intervals end where the count
    may change and at midnight.
    """
    return _steps(logs, rules, start, end).select(*PAIR, "tick_from", "tick_to", "errors")


def _steps(logs: DataFrame, rules: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """The intervals with their day, and `before`, the count just before (NULL at a day's start).

    The count is a running sum of errors entering and leaving the window, taken within days on top
    of the sum of the days before.
    """
    first, last = epoch_minute(start) + 1, epoch_minute(end)
    widest = rules.agg(F.coalesce(F.max("window_minutes"), F.lit(0))).first()[0]
    oldest = start - timedelta(minutes=widest)
    if "bucket_start" in logs.columns:
        errors = in_range(logs.where(F.col("level") == "error"), floor_minute(oldest), end, "bucket_start")
        minute, count = minute_number(F.col("bucket_start")), F.sum("count")
    else:
        errors = in_range(logs.where(F.col("level") == "error"), oldest, end)
        minute, count = minute_number(F.col("timestamp")), F.count("*")
    # Looked at several times below: written once, a row per service and minute with errors.
    counts = written(by_scope(errors.groupBy("service", minute.alias("minute")).agg(count.alias("n")), "minute"), "error-minutes")
    pairs = _pairs(rules)
    mine = counts.withColumnRenamed("service", "_service")
    joined = mine.join(pairs, F.col("_service").eqNullSafe(pairs["service"]))
    enter, leave = F.col("minute") + 1, F.col("minute") + 1 + F.col("window_minutes")
    moves = joined.select(
        *PAIR,
        F.explode(F.array(
            F.struct(enter.alias("tick"), F.col("n").alias("delta")),
            F.struct(leave.alias("tick"), (-F.col("n")).alias("delta")),
        )).alias("move"),
    ).select(*PAIR, F.greatest("move.tick", F.lit(first)).alias("tick"), "move.delta")
    # One row per pair and day, so that every day has a start even when nothing moves in it.
    days = F.sequence(F.lit(first // DAY), F.lit(last // DAY))
    starts = pairs.select(*PAIR, F.explode(days).alias("day")).select(
        *PAIR, F.greatest(F.col("day") * DAY, F.lit(first)).alias("tick"), F.lit(0).cast("long").alias("delta")
    )
    points = (
        moves.where(F.col("tick") <= last).unionByName(starts)
        .groupBy(*PAIR, "tick").agg(F.sum("delta").alias("delta"))
        .withColumn("day", _day(F.col("tick")))
    )
    per_day = points.groupBy(*PAIR, "day").agg(F.sum("delta").alias("change"))
    before = F.sum("change").over(Window.partitionBy(*PAIR).orderBy("day")) - F.col("change")
    carried = per_day.select(F.col("service").alias("_s"), F.col("window_minutes").alias("_w"), F.col("day").alias("_d"), before.alias("carried"))
    same = (
        points["service"].eqNullSafe(carried["_s"])
        & (points["window_minutes"] == carried["_w"]) & (points["day"] == carried["_d"])
    )
    in_day = Window.partitionBy(*PAIR, "day").orderBy("tick")
    day_end = F.least((F.col("day") + 1) * DAY, F.lit(last + 1))
    errors = F.col("carried") + F.sum("delta").over(in_day)
    return points.join(carried, same).select(
        *PAIR,
        "day",
        F.col("tick").alias("tick_from"),
        F.coalesce(F.lead("tick").over(in_day), day_end).alias("tick_to"),
        errors.alias("errors"),
        F.when(F.lag("tick").over(in_day).isNotNull(), errors - F.col("delta")).alias("before"),
    )


def _fires(span: Column, free: Column) -> tuple[Column, Column]:
    """First firing in an interval given the first free tick, and the first free tick after it."""
    cooldown = ALERT_COOLDOWN_MINUTES
    begin = F.greatest(span["a"], free)
    times = F.ceil((span["b"] - begin) / cooldown)
    return begin, F.when(begin < span["b"], begin + times.cast("long") * cooldown).otherwise(free)


def _free_after(runs: Column, free: Column) -> Column:
    return F.aggregate(runs, free, lambda acc, run: _fires(run, acc)[1])


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """The right side with its keys renamed, and the condition that all keys are the same."""
    renamed = right.withColumnsRenamed({key: f"_{key}" for key in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"_{key}"])
    return renamed, condition


def _runs(steps: DataFrame, rules: DataFrame) -> DataFrame:
    """Per (service, window, threshold) and day: `runs`, the intervals at or over the threshold.

    A change of the count only concerns the thresholds it steps over, so the work grows with the
    changes and not with the number of rules.
    """
    levels = rules.where("window_minutes > 0").groupBy(
        rule_scope(F.col("service")).alias("service"), F.col("window_minutes").cast("long").alias("window_minutes")
    ).agg(F.collect_set(F.col("threshold").cast("long")).alias("levels"))
    levels, same = _null_safe(steps, levels, PAIR)
    errors, before = F.col("errors"), F.col("before")

    def crossed(level: Column) -> Column:
        return F.when(before.isNull(), level <= errors).otherwise((level <= errors) != (level <= before))

    crossings = steps.join(levels, same).select(
        *PAIR, "day", "tick_from", "errors", F.explode(F.filter("levels", crossed)).alias("threshold")
    )
    order = Window.partitionBy(*PAIR, "threshold", "day").orderBy("tick_from")
    # The last interval of a day may run past the end of the replay; firing stops there.
    run = F.struct(F.col("tick_from").alias("a"), F.coalesce("next", (F.col("day") + 1) * DAY).alias("b"))
    return (
        crossings.withColumn("next", F.lead("tick_from").over(order))
        .where(F.col("errors") >= F.col("threshold"))
        .groupBy(*PAIR, "threshold", "day").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    )


def _waits(runs: DataFrame) -> DataFrame:
    """`wait`: the minutes of cooldown left over when a day starts."""
    starts = F.sequence(F.lit(0), F.lit(ALERT_COOLDOWN_MINUTES - 1))
    none = F.lit(0).cast("long")
    next_day = (F.col("day") + 1) * DAY
    # What each possible wait at midnight becomes by the next midnight.
    left = F.transform(
        starts,
        lambda wait: F.greatest(_free_after(F.col("runs"), F.col("day") * DAY + wait.cast("long")) - next_day, none),
    )
    tables = runs.select(*RULE, F.struct("day", left.alias("left")).alias("step"))
    steps = tables.groupBy(*RULE).agg(F.sort_array(F.collect_list("step")).alias("steps"))
    nothing = F.struct(
        F.lit(-1).cast("long").alias("day"), none.alias("wait"),
        F.array().cast("array<struct<day:bigint,wait:bigint>>").alias("out"),
    )

    def chain(acc: Column, step: Column) -> Column:
        # A day without candidates in between is longer than any cooldown.
        wait = F.when(acc["day"] + 1 == step["day"], acc["wait"]).otherwise(none)
        return F.struct(
            step["day"].alias("day"),
            F.element_at(step["left"], (wait + 1).cast("int")).alias("wait"),
            F.concat(acc["out"], F.array(F.struct(step["day"].alias("day"), wait.alias("wait")))).alias("out"),
        )

    waits = F.aggregate("steps", nothing, chain, lambda acc: acc["out"])
    return steps.select(*RULE, F.explode(waits).alias("w")).select(*RULE, "w.day", "w.wait")


def _quiet_until(rules: DataFrame, start: datetime) -> Column:
    """The first tick at which a rule may fire; 0 if its last alert is no matter."""
    last = F.col("last_triggered_at")
    minute = F.ceil(micros(last) / MINUTE_US).cast("long") + ALERT_COOLDOWN_MINUTES
    counts = (last <= ts_literal(start, rules, "last_triggered_at")) & (minute > epoch_minute(start) + 1)
    return F.when(counts, minute).otherwise(0).cast("long")


def replay_alerts(logs: DataFrame, rules: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """(rule_id, fired_at, errors) for every alert the rules would have raised in (start, end].

    A rule whose last_triggered_at is not after `start` begins with what is left of its cooldown; a later one belongs
    to the history that is replayed and is left out of account. Rules that agree in service, window, threshold and
    this rest fire alike and are replayed once.
    """
    steps = written(_steps(logs, rules, start, end), "replay-steps")
    asked = rules.select(
        F.col("id").alias("rule_id"), rule_scope(F.col("service")).alias("service"), F.col("window_minutes").cast("long").alias("window_minutes"),
        F.col("threshold").cast("long").alias("threshold"), _quiet_until(rules, start).alias("quiet"),
    )
    runs = _runs(steps, rules)
    kinds, same = _null_safe(runs, asked.select(*RULE).distinct(), PAIR + ["threshold"])
    runs = runs.join(kinds, same).select(
        *PAIR, "threshold", "quiet", "day",
        F.transform("runs", lambda run: F.struct(F.greatest(run["a"], F.col("quiet")).alias("a"), run["b"].alias("b"))).alias("runs"),
    ).withColumn("runs", F.filter("runs", lambda run: run["a"] < run["b"]))
    waits, same_day = _null_safe(runs, _waits(runs), RULE + ["day"])

    def fire(acc: Column, run: Column) -> Column:
        begin, free = _fires(run, acc["free"])
        every = F.lit(ALERT_COOLDOWN_MINUTES).cast("long")
        ticks = F.when(begin < run["b"], F.sequence(begin, run["b"] - 1, every)).otherwise(F.array().cast("array<bigint>"))
        return F.struct(free.alias("free"), F.concat(acc["out"], ticks).alias("out"))

    initial = F.struct(
        (F.col("day") * DAY + F.col("wait")).alias("free"), F.array().cast("array<bigint>").alias("out"),
    )
    ticks = F.aggregate("runs", initial, fire, lambda acc: acc["out"])
    fired = runs.join(waits, same_day).select(*RULE, "day", F.explode(ticks).alias("tick"))
    fired = fired.where(F.col("tick") <= epoch_minute(end))
    # The count at a firing is that of the interval it falls into.
    counts = steps.select(*PAIR, F.lit(None).cast("long").alias("threshold"), F.lit(None).cast("long").alias("quiet"), "day", F.col("tick_from").alias("tick"), "errors")
    both = counts.unionByName(fired.withColumn("errors", F.lit(None).cast("long")))
    upto = Window.partitionBy(*PAIR, "day").orderBy("tick", F.asc_nulls_first("threshold"))
    filled = both.withColumn("errors", F.last("errors", ignorenulls=True).over(upto)).where("threshold IS NOT NULL")
    asked, same_rule = _null_safe(filled, asked, RULE)
    fired_at = minute_to_time(F.col("tick"), time_type(logs, "bucket_start" if "bucket_start" in logs.columns else "timestamp"))
    return filled.join(asked, same_rule).select("rule_id", fired_at.alias("fired_at"), "errors")
