"""Cycles, thermal shifts, phases and fertility zones, with window functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import out_of_norm, z_score

LOW_READINGS, SHIFT, PEAK_MUCUS, ANY_MUCUS, MUCUS_DAYS, LOOK_BACK, SHORT_LUTEAL, MAX_LUTEAL = 6, 0.2, 4, 1, 3, 5, 10, 16


def bounded(days: DataFrame, entity: str) -> DataFrame:
    """Signals with nulls settled, and of every day its cycle's number (0: before the first), start and next start.

    A cycle starts on a bleeding day (flow 1 or more) the calendar day before which was none.
    """
    w = W.partitionBy(entity).orderBy("day")
    d = days.select(
        entity, "day", F.col("bbt_c"), (F.coalesce("flow_ordinal", F.lit(0)) >= 1).alias("menses"),
        F.coalesce("mucus_ordinal", F.lit(0)).alias("mucus"), F.coalesce("lh_surge", F.lit(False)).alias("lh"),
    )
    last = F.last(F.when(F.col("menses"), F.col("day")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("starts", F.col("menses") & (last.isNull() | (F.datediff("day", last) > 1)))
    ahead = F.first(F.when(F.col("starts"), F.col("day")), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    number = F.sum(F.col("starts").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    start = F.last(F.when(F.col("starts"), F.col("day")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return d.select("*", number.alias("cycle_number"), start.alias("cycle_start"), ahead.alias("next_start"))


def _readings(d: DataFrame, entity: str, max_luteal: int = MAX_LUTEAL) -> DataFrame:
    """``d`` with, on each reading that a thermal shift may begin with, the day before (``ov``) and the readings that confirm it.

    The coverline is the highest of the six readings before, and three readings in a row lie above it. Rows without a reading stand behind the
    others of their cycle, so windows over readings need no second pass; a look ahead that meets one of them finds no temperature.
    """
    r = W.partitionBy(entity, "cycle_number").orderBy(F.col("bbt_c").isNull(), "day")
    ahead = [F.lead("bbt_c", i).over(r) for i in (1, 2, 3)]
    t = d.select(
        "*", F.row_number().over(r).alias("_rn"), F.max("bbt_c").over(r.rowsBetween(-LOW_READINGS, -1)).alias("_cover"),
        *(x.alias(f"_h{i}") for i, x in enumerate(ahead, 2)), *(F.lead("day", i).over(r).alias(f"_d{i + 1}") for i in (2, 3)), F.lag("day").over(r).alias("_ov"),
    )
    over = (F.col("cycle_number") > 0) & (F.col("_rn") > LOW_READINGS) & (F.col("bbt_c") > F.col("_cover")) & (F.col("_h2") > F.col("_cover")) & (F.col("_h3") > F.col("_cover"))
    far = F.coalesce(F.datediff("next_start", "_ov") > max_luteal, F.lit(False))
    return t.withColumn("_over", F.coalesce(over, F.lit(False))).withColumn("_far", far)


def _confirm(shift) -> F.Column:
    """The day that confirms a shift: the third reading if it lies ``shift`` over the coverline, else a fourth one above it."""
    return F.when(F.col("_h3") >= F.col("_cover") + shift, F.col("_d3")).when(F.col("_h4") > F.col("_cover"), F.col("_d4"))


def _hit(confirm: F.Column) -> tuple[F.Column, F.Column]:
    """The first shift that counts, (ov, confirm), and the first that was passed over, as aggregates."""
    found = F.col("_over") & confirm.isNotNull()
    return F.min(F.when(found & ~F.col("_far"), F.struct(F.col("_ov").alias("ov"), confirm.alias("confirm")))), F.min(F.when(found & F.col("_far"), F.col("_ov")))


def _suspect(hit: F.Column, passed: F.Column) -> F.Column:
    return F.coalesce(passed.isNotNull() & (hit.isNull() | (passed < hit["ov"])), F.lit(False))


def shifts(d: DataFrame, entity: str, shift: float = SHIFT, max_luteal: int = MAX_LUTEAL) -> DataFrame:
    """(entity, cycle_number, ovulation_day, temp_confirm_day, suspect) of every cycle with a reading.

    A shift that implies a luteal phase of more than ``max_luteal`` days in a closed cycle is passed over
    and makes the cycle suspect; the first other one counts.
    """
    hit, passed = _hit(_confirm(shift))
    g = _readings(d, entity, max_luteal).where("bbt_c is not null and cycle_number > 0").groupBy(entity, "cycle_number").agg(hit.alias("hit"), passed.alias("passed"))
    return g.select(entity, "cycle_number", F.col("hit.ov").alias("ovulation_day"), F.col("hit.confirm").alias("temp_confirm_day"), _suspect(F.col("hit"), F.col("passed")).alias("suspect"))


def _of_cycle(days: DataFrame, entity: str, shift: float) -> DataFrame:
    """Every day with what its cycle comes to. One shuffle, by the entity: all later windows are within its cycles."""
    c = W.partitionBy(entity, "cycle_number")
    hit, passed = _hit(_confirm(shift))
    inside = F.col("cycle_number") > 0
    d = _readings(bounded(days, entity), entity).select(
        entity, "day", "menses", "mucus", "lh", "starts", "cycle_number", "cycle_start", "next_start", hit.over(c).alias("_hit"), passed.over(c).alias("_passed"),
        F.when(inside, F.min(F.when(F.col("mucus") >= ANY_MUCUS, F.col("day"))).over(c)).alias("change_point"), F.when(inside, F.max(F.when(F.col("mucus") >= PEAK_MUCUS, F.col("day"))).over(c)).alias("peak_day"),
    )
    d = d.withColumns({"ovulation_day": F.col("_hit.ov"), "temp_confirm_day": F.col("_hit.confirm"), "suspect": _suspect(F.col("_hit"), F.col("_passed"))})
    confirmation = F.when(F.col("temp_confirm_day").isNotNull(), F.greatest("temp_confirm_day", F.date_add("peak_day", MUCUS_DAYS)))
    return d.withColumns({"confirmation_day": confirmation, "fertile_start": F.coalesce("change_point", F.date_sub("ovulation_day", LOOK_BACK))})


def cycles(days: DataFrame, entity: str, shift: float = SHIFT) -> DataFrame:
    """One row for each cycle: bounds, ovulation, peak, confirmation, fertile start and suspicion."""
    first = _of_cycle(days, entity, shift).where((F.col("cycle_number") > 0) & F.col("starts"))
    return first.select(entity, "cycle_number", "cycle_start", "next_start", "change_point", "peak_day", "ovulation_day", "temp_confirm_day", "suspect", "confirmation_day", "fertile_start")


def phases(days: DataFrame, entity: str, shift: float = SHIFT) -> DataFrame:
    """(entity, day, phase, fertility_zone, fertile_window, cycle_day) of every day with a signal."""
    d = _of_cycle(days, entity, shift)
    day, ov, fs = F.col("day"), F.col("ovulation_day"), F.col("fertile_start")
    inside = F.col("cycle_number") > 0
    phase = F.when(inside & F.col("menses"), "menstruation").when(day < ov, "follicular").when(day == ov, "ovulation").when(day > ov, "luteal").otherwise("unknown")
    zone = F.when(fs.isNull(), "unknown").when(day < fs, "infertile_pre").when(day > F.col("confirmation_day"), "infertile_post").otherwise("fertile")
    zone = F.when(((F.col("mucus") >= PEAK_MUCUS) | F.col("lh")) & (zone != "infertile_post"), "fertile").otherwise(zone)
    number = F.when(inside, F.datediff("day", "cycle_start") + 1)
    return d.select(entity, "day", phase.alias("phase"), zone.alias("fertility_zone"), (zone == "fertile").alias("fertile_window"), number.alias("cycle_day"))


def summary(days: DataFrame, entity: str, shift: float = SHIFT) -> DataFrame:
    """One row for each cycle with its lengths, z-scores and flags."""
    c = cycles(days, entity, shift)
    length, luteal = F.datediff("next_start", "cycle_start"), F.datediff("next_start", "ovulation_day")
    zc, zl = z_score(length, "cycle_length"), z_score(luteal, "luteal_length")
    return c.select(
        entity, "cycle_number", "cycle_start", "next_start", length.alias("cycle_length_days"), "ovulation_day", "temp_confirm_day", "peak_day", "confirmation_day",
        (F.datediff("ovulation_day", "cycle_start") + 1).alias("follicular_days"), luteal.alias("luteal_days"), F.coalesce(luteal <= SHORT_LUTEAL, F.lit(False)).alias("short_luteal"),
        F.col("suspect").alias("suspect_ovulation"), F.round(zc, 3).alias("cycle_length_z"), F.round(zl, 3).alias("luteal_length_z"),
        out_of_norm(zc).alias("cycle_length_flag"), out_of_norm(zl).alias("luteal_length_flag"), F.col("ovulation_day").isNull().alias("anovulatory"),
    )


def counts(phase_rows: DataFrame, summary_rows: DataFrame) -> DataFrame:
    """(name, n): days by phase, cycles, ovulatory, suspect and flagged cycles."""
    by = phase_rows.groupBy(F.concat(F.lit("phase "), "phase").alias("name")).agg(F.count("*").alias("n"))
    flagged = F.coalesce(F.col("cycle_length_flag"), F.lit(False)) | F.coalesce(F.col("luteal_length_flag"), F.lit(False))
    tests = {"cycles": F.lit(True), "ovulatory": ~F.col("anovulatory"), "suspect": F.col("suspect_ovulation"), "flagged": flagged}
    row = summary_rows.agg(*(F.count_if(c).alias(n) for n, c in tests.items()))
    return by.union(row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in tests))).alias("x")).select("x.*"))


def sweep(days: DataFrame, entity: str, thresholds: tuple[float, ...] = (0.10, 0.15, 0.20, 0.25, 0.30)) -> DataFrame:
    """(shift_c, cycles, ovulatory, suspect) for each threshold; days are bounded and readings looked at once for all of them."""
    d = _readings(bounded(days, entity), entity).where("cycle_number > 0")
    tests = [_hit(_confirm(s)) for s in thresholds]
    g = d.groupBy(entity, "cycle_number").agg(*(x.alias(f"{n}{i}") for i, pair in enumerate(tests) for n, x in zip(("hit", "passed"), pair)))
    row = g.agg(F.count("*").alias("cycles"), *(F.count(f"hit{i}").alias(f"ov{i}") for i in range(len(thresholds))), *(F.count_if(_suspect(F.col(f"hit{i}"), F.col(f"passed{i}"))).alias(f"su{i}") for i in range(len(thresholds))))
    each = F.array(*(F.struct(F.lit(s).alias("shift_c"), F.col("cycles"), F.col(f"ov{i}").alias("ovulatory"), F.col(f"su{i}").alias("suspect")) for i, s in enumerate(thresholds)))
    return row.select(F.explode(each).alias("x")).select("x.*")


def temperature_by_phase(days: DataFrame, phase_rows: DataFrame, keys: list[str]) -> DataFrame:
    return days.where("bbt_c is not null").join(phase_rows, keys).groupBy("phase").agg(F.count("*").alias("n"), F.avg("bbt_c").alias("avg_bbt"))
