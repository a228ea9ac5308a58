"""Expanding walk-forward folds over trading days, as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("model_train", "cal", "embargo", "test")


def date_index(df: DataFrame, time: str = "date") -> DataFrame:
    """Distinct days with their position from 0: one row per calendar day."""
    days = df.select(F.col(time).alias("date")).distinct()
    return days.withColumn("day_no", F.row_number().over(Window.orderBy("date")).cast("long") - 1)


def fold_dates(days: DataFrame, *, min_train: int = 756, test: int = 126, step: int = 126,
               embargo: int = 2, train_share: float = 0.8, strict: bool = True) -> DataFrame:
    """(fold, role, date) rows.

    Fold ``i`` trains on days ``[0, min_train + i*step)``, skips the embargo and
    tests on the next ``test`` days; incomplete test windows are not formed.  The
    last ``1 - train_share`` of the training days calibrate.  With ``strict`` a
    calendar too short for one fold raises.
    """
    need = min_train + embargo + test
    n = F.col("n")
    count = F.floor((n - need) / step).cast("int") + 1
    if strict:
        count = F.when(n >= need, count).otherwise(F.raise_error(
            F.concat(F.lit(f"at least {need} distinct dates are needed, found "), n.cast("string"))).cast("int"))
    folds = (
        days.agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_k", count).filter(F.col("_k") >= 1)
        .select(F.explode(F.sequence(F.lit(1), F.col("_k"))).alias("fold"))
        .withColumn("_train", (min_train + (F.col("fold") - 1) * step).cast("long"))
        .withColumn("_cal", F.floor(F.col("_train") * train_share))
        .withColumn("day_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_train") + embargo + test - 1)))
    )
    d = F.col("day_no")
    role = (
        F.when(d < F.col("_cal"), "model_train").when(d < F.col("_train"), "cal")
        .when(d < F.col("_train") + embargo, "embargo").otherwise("test")
    )
    return folds.withColumn("role", role).join(days, "day_no").select("fold", "role", "date", "day_no")


def fold_summary(dates: DataFrame) -> DataFrame:
    return dates.groupBy("fold", "role").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n_dates"))


def fold_checks(dates: DataFrame, min_train: int = 756, embargo: int = 2) -> DataFrame:
    """The seven fold invariants as (fold, check_name, passed) rows.

    Calibration days are in the training span if they come after its first day and
    before the test, and none of them is a model-training or embargo day as well.
    """
    train, cal, test = (F.col("role").isin("model_train", "cal"), F.col("role") == "cal", F.col("role") == "test")
    per_date = dates.groupBy("fold", "date").agg(
        F.max(train.cast("int")).alias("tr"), F.max(cal.cast("int")).alias("ca"), F.max(test.cast("int")).alias("te"),
        F.max(F.col("role").isin("model_train", "embargo").cast("int")).alias("other"))
    s = per_date.groupBy("fold").agg(
        F.sum("tr").alias("n_train"), F.sum("te").alias("n_test"),
        F.sum(F.col("tr") * F.col("te")).alias("both"), F.sum(F.col("ca") * F.col("te")).alias("cal_test"),
        F.sum(F.col("ca") * F.greatest("other", "te")).alias("cal_out"),
        F.min(F.when(F.col("ca") == 1, F.col("date"))).alias("cal_start"),
        F.max(F.when(F.col("ca") == 1, F.col("date"))).alias("cal_end"),
        F.min(F.when(F.col("tr") == 1, F.col("date"))).alias("train_start"),
        F.max(F.when(F.col("tr") == 1, F.col("date"))).alias("train_end"),
        F.min(F.when(F.col("te") == 1, F.col("date"))).alias("test_start"),
    )
    checks = {
        "min_train_size": F.col("n_train") >= min_train,
        "test_not_empty": F.col("n_test") > 0,
        "train_test_disjoint": F.col("both") == 0,
        "test_after_train": F.col("test_start") > F.col("train_end"),
        "embargo_gap": F.datediff("test_start", "train_end") >= embargo,
        "cal_in_train": (F.col("cal_out") == 0) & F.coalesce(
            (F.col("cal_start") > F.col("train_start")) & (F.col("cal_end") < F.col("test_start")), F.lit(True)),
        "cal_test_disjoint": F.col("cal_test") == 0,
    }
    rows = F.array(*[
        F.struct(F.lit(k).alias("check_name"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items()
    ])
    return s.select("fold", F.inline(rows))


def rows_of_role(panel: DataFrame, dates: DataFrame, *roles: str) -> DataFrame:
    """Panel rows of the given roles, once per fold they belong to."""
    wanted = dates.filter(F.col("role").isin(*roles)).select("fold", "role", "date")
    return panel.join(wanted, "date")


def test_rows(panel: DataFrame, dates: DataFrame) -> DataFrame:
    return rows_of_role(panel, dates, "test").drop("role")


def class_balance(panel: DataFrame, dates: DataFrame, target: str = "target") -> DataFrame:
    """Share of ones per fold and role.

    Counts are taken per day before they meet the folds, which overlap.
    """
    daily = panel.filter(F.col(target).isNotNull()).groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(target) == 1).cast("long")).alias("ones"))
    s = daily.join(dates, "date").groupBy("fold", "role").agg(
        F.sum("n").alias("n_rows"), F.sum("ones").alias("n_ones"))
    share = F.round(F.col("n_ones") / F.col("n_rows"), 4)
    return s.select("fold", "role", "n_rows", share.alias("share"),
                    (~(F.col("n_ones") / F.col("n_rows")).between(0.40, 0.60)).alias("warn"))


def scaler_stats(panel: DataFrame, dates: DataFrame, features: Sequence[str]) -> DataFrame:
    """(fold, feature, mean, std) over the model-train rows, population std.

    Moments are taken once per day and merged per fold, so the panel is read
    once although each training day serves many folds.
    """
    long = panel.select("date", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])))
    daily = long.filter(F.col("x").isNotNull()).groupBy("date", "feature").agg(
        F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    members = daily.join(dates.filter(F.col("role") == "model_train").select("fold", "date"), "date")
    first = members.groupBy("fold", "feature").agg(
        F.sum("n").alias("n_rows"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    spread = members.join(first, ["fold", "feature"]).groupBy("fold", "feature").agg(
        F.first("n_rows").alias("n_rows"), F.first("mean").alias("mean"),
        F.sum(F.col("n") * (F.col("v") + (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean")))).alias("q"),
    )
    return spread.select("fold", "feature", "n_rows", "mean", F.sqrt(F.col("q") / F.col("n_rows")).alias("std"))


def standardize(rows: DataFrame, stats: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scale fold rows with their fold's statistics; a constant feature divides by 1."""
    wide = stats.groupBy("fold").agg(*[
        e for c in features for e in (
            F.max(F.when(F.col("feature") == c, F.col("mean"))).alias(f"_m_{c}"),
            F.max(F.when(F.col("feature") == c, F.col("std"))).alias(f"_s_{c}"),
        )
    ])
    # one row per fold
    return rows.join(F.broadcast(wide), "fold").select(
        *[c for c in rows.columns if c not in features],
        *[((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)).alias(c)
          for c in features])


def tail_validation(rows: DataFrame, share: float = 0.85, entity: str = "ticker") -> DataFrame:
    """Flag the last ``1 - share`` of each fold's rows in (date, entity) order.

    Whole days are placed by their row counts; only the one day the cut falls on
    is numbered row by row.
    """
    daily = rows.groupBy("fold", "date").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("fold").orderBy("date")
    placed = daily.withColumns({
        "_upto": F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_all": F.sum("_n").over(Window.partitionBy("fold")),
    }).withColumn("_cut", F.floor(F.col("_all") * share)).withColumn("_before", F.col("_upto") - F.col("_n"))
    joined = rows.join(placed.drop("_n", "_all"), ["fold", "date"])
    whole = (F.col("_upto") <= F.col("_cut")) | (F.col("_before") >= F.col("_cut"))
    plain = joined.filter(whole).withColumn("is_val", F.col("_before") >= F.col("_cut"))
    cut_day = joined.filter(~whole).withColumn(
        "is_val", F.col("_before") + F.row_number().over(Window.partitionBy("fold", "date").orderBy(entity))
        > F.col("_cut"))
    return plain.unionByName(cut_day).drop("_upto", "_cut", "_before")


def three_way_split(dates: DataFrame, cal_share: float = 0.20, val_share: float = 0.15) -> DataFrame:
    """Training days of each fold cut in order into train, val and calib."""
    train = dates.filter(F.col("role").isin("model_train", "cal")).select("fold", "date", "day_no")
    sizes = train.groupBy("fold").agg(F.count(F.lit(1)).alias("_n"))
    # half to even, as the usual array rounding
    sizes = sizes.withColumn("_pre", F.col("_n") - F.bround(F.col("_n") * cal_share, 0).cast("long"))
    sizes = sizes.withColumn("_val", F.col("_pre") - F.bround(F.col("_pre") * val_share, 0).cast("long"))
    part = (
        F.when(F.col("day_no") < F.col("_val"), "train").when(F.col("day_no") < F.col("_pre"), "val")
        .otherwise("calib")
    )
    return train.join(sizes, "fold").select("fold", "date", part.alias("part"))


def split_overlap(validation: DataFrame, calibration: DataFrame) -> DataFrame:
    """Calibration days that also serve validation, per fold, from (fold, date) sets."""
    cal = calibration.select("fold", "date").distinct()
    hits = cal.join(validation.select("fold", "date").distinct(), ["fold", "date"], "left_semi")
    return cal.groupBy("fold").agg(F.count(F.lit(1)).alias("n_cal")).join(
        hits.groupBy("fold").agg(F.count(F.lit(1)).alias("n_overlap")), "fold", "left",
    ).select("fold", "n_cal", F.coalesce("n_overlap", F.lit(0).cast("long")).alias("n_overlap"),
             (F.coalesce("n_overlap", F.lit(0)) / F.col("n_cal")).alias("share"))


def random_validation(dates: DataFrame, share: float = 0.15, salt: str = "val") -> DataFrame:
    """A hash-ordered sample of ``share`` of each fold's training days."""
    train = dates.filter(F.col("role").isin("model_train", "cal")).select("fold", "date")
    w = Window.partitionBy("fold")
    order = F.md5(F.concat_ws("|", F.lit(salt), F.col("fold").cast("string"), F.col("date").cast("string")))
    return train.withColumns({
        "_rn": F.row_number().over(w.orderBy(order)), "_n": F.count(F.lit(1)).over(w),
    }).filter(F.col("_rn") <= F.bround(F.col("_n") * share, 0)).select("fold", "date")
