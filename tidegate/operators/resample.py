"""Permutation nulls and bootstraps with the replicate as a key column.

Replicates are formed by exploding a replicate number; draws come from
``functions.draws``.  ``drawn_picks`` and ``drawn_top`` draw every row in every
replicate; ``random_picks`` and ``permuted_top`` compute the first places of a
keyed shuffle alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.columns import numbers, ratio, spread_by
from tidegate.functions.draws import KEY_BITS, PRIME, draw_columns, key_high, key_low, round_keys, shuffled_place
from tidegate.operators.book import COST_BPS, YEAR, calendar, charge, daily_book, performance
from tidegate.operators.ranks import SPLIT_ROWS, rank_columns
from tidegate.session import materialize

_LOW = 1 << KEY_BITS


def _with_draw(rows: DataFrame, reps: int, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Rows times replicates with a draw each.

    A day's rows sit together, so that the reduction after the draw happens
    before the shuffle; a day above ``split_rows`` is spread over several tasks.
    """
    if "_parts" in rows.columns:
        sized = rows
    else:
        sizes = rows.groupBy("date").agg(F.ceil(F.count(F.lit(1)) / split_rows).cast("long").alias("_parts"))
        sized = rows.join(sizes, "date")
    sized = sized.withColumns({"_h1": key_high("date", "ticker"), "_h2": key_low("date", "ticker")})
    sized = spread_by(sized, "date", F.col("_h2") % F.col("_parts"))
    rows = sized if "_parts" in rows.columns else sized.drop("_parts")
    rows = rows.withColumn("rep", numbers(1, reps))
    return draw_columns(rows, "rep", "_h1", "_h2", "_u")


def numbered_rows(rows: DataFrame, by: str | None, order: str, out: str) -> DataFrame:
    """Rows numbered from 0 within each group, for groups of any size; without ``by`` all rows are one group.

    All rows are put in order by ranges and written with the number of their range and their place in it; the sizes of
    the ranges (one number for each) make these a running number, and a group starts at its smallest.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [order] if by is None else [by, order]
    placed = materialize(
        rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_range", F.coalesce(F.sum("_size").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    running = placed.join(F.broadcast(before), "_range").withColumn("_at", F.col("_at") + F.col("_before"))
    if by is None:
        return running.withColumnRenamed("_at", out).drop("_range", "_before")
    starts = running.groupBy(by).agg(F.min("_at").alias("_start"))
    return running.join(starts, by).withColumn(out, F.col("_at") - F.col("_start")).drop(
        "_range", "_at", "_before", "_start")


def _replicates(days: DataFrame, reps: int) -> DataFrame:
    """Days times replicates with the keys of each shuffle."""
    keyed = days.withColumns({"_h1": key_high("date"), "_h2": key_low("date")}).withColumn("rep", numbers(1, reps))
    return draw_columns(spread_by(keyed, "date", "rep"), "rep", "_h1", "_h2", "_key").withColumn(
        "_keys", round_keys(F.col("_key"))).drop("_h1", "_h2", "_key")


def _picked(days: DataFrame, numbered: DataFrame, indexes: Column) -> DataFrame:
    """The rows that stand at ``indexes`` of their day, per replicate."""
    return days.select("rep", "date", F.explode(indexes).alias("_i")).join(numbered, ["date", "_i"]).select(
        "rep", "date", "ticker", "actual_return")


def _place_to_row(place: Column) -> Column:
    return shuffled_place(place, F.col("_n"), F.col("_keys"))


def random_picks(panel: DataFrame, reps: int, k: int = 1) -> DataFrame:
    """``k`` random rows per replicate and day: the rows at the first places of a keyed shuffle.

    No row is drawn that is not picked; the work is days times replicates times ``k``.
    """
    numbered = numbered_rows(panel.select("date", "ticker", "actual_return"), "date", "ticker", "_i")
    days = _replicates(numbered.groupBy("date").agg(F.count(F.lit(1)).alias("_n")), reps)
    places = F.sequence(F.lit(0), F.least(F.lit(k), F.col("_n")).cast("int") - 1)
    return _picked(days, numbered, F.transform(places, _place_to_row))


def permuted_top(panel: DataFrame, reps: int, k: int = 1) -> DataFrame:
    """Top-k names after shuffling scores among the names of each day.

    The name at place i of a keyed shuffle receives the i-th largest score, so the top k are those at the first k places,
    unless scores tie at the boundary: then the first ``above`` places are in, and what is left goes alphabetically to
    names at the next ``tied`` places.  These are listed where they are few.  Where they are many, names are asked for
    their places in alphabetical order, first as many as will do in nearly every draw, all only if they did not; so a draw
    costs about the square root of the day's names at most.
    """
    scored = panel.select("date", "ticker", "actual_return", F.coalesce("prob", F.lit(float("-inf"))).alias("_s"))
    numbered = numbered_rows(scored, "date", "ticker", "_i")
    order = Window.partitionBy("date").orderBy(F.desc("_s"), "_i")
    edge = numbered.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k).groupBy("date").agg(
        F.min("_s").alias("_edge"), F.count(F.lit(1)).alias("_k"))
    info = numbered.join(edge, "date").groupBy("date").agg(
        F.first("_k").alias("_k"), F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_s") > F.col("_edge")).alias("_above"),
        F.count_if(F.col("_s") == F.col("_edge")).alias("_tied"))
    days = _replicates(info, reps)
    above, tied, n, m = F.col("_above"), F.col("_tied"), F.col("_n"), F.col("_k") - F.col("_above")
    open_tie = tied > m
    first = F.when(open_tie, above).otherwise(F.col("_k")).cast("int")
    sure = F.when(first > 0, F.transform(F.sequence(F.lit(0), F.greatest(first, F.lit(1)) - 1), _place_to_row)).otherwise(
        F.array().cast("array<bigint>"))
    enough = F.least(n, F.ceil(n * (2 * m + 20) / tied))

    def asked(how_many: Column) -> Column:
        """Names with a tied place among the alphabetically first ones."""
        place = lambda i: shuffled_place(i, n, F.col("_keys"), back=True)
        return F.filter(F.sequence(F.lit(0).cast("long"), how_many - 1), lambda i: place(i).between(above, above + tied - 1))

    listed = F.sort_array(F.transform(F.sequence(above, above + tied - 1), _place_to_row))
    days = days.withColumn("_found", F.when(open_tie, F.when(tied <= enough, listed).otherwise(asked(enough))))
    days = days.withColumn("_found", F.when(open_tie & (F.size("_found") < m), asked(n)).otherwise(F.col("_found")))
    among = F.when(open_tie, F.slice("_found", F.lit(1), m.cast("int"))).otherwise(F.array().cast("array<bigint>"))
    return _picked(days, numbered, F.concat(sure, among))


def drawn_positions(rows: DataFrame, reps: int, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Position of each row in its day's random order, per replicate.

    A day above ``split_rows`` is cut into equal ranges of the draw; positions are
    counted inside a range and shifted by the rows below it.
    """
    sizes = rows.groupBy("date").agg(F.ceil(F.count(F.lit(1)) / split_rows).cast("long").alias("_parts"))
    drawn = _with_draw(rows.join(sizes, "date"), reps, split_rows).withColumn(
        "_part", F.expr(f"_u * _parts div {PRIME}"))
    below = (
        drawn.filter(F.col("_parts") > 1).groupBy("rep", "date", "_part").agg(F.count(F.lit(1)).alias("_m"))
        .withColumn("_below", F.sum("_m").over(
            Window.partitionBy("rep", "date").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .drop("_m")
    )
    inside = F.row_number().over(Window.partitionBy("rep", "date", "_part").orderBy("_u", "_h2", "ticker"))
    placed = drawn.withColumn("_in", inside).join(below, ["rep", "date", "_part"], "left")
    return placed.withColumn("position", F.col("_in") + F.coalesce("_below", F.lit(0))).drop(
        "_h1", "_h2", "_u", "_parts", "_part", "_in", "_below")


def smallest_draw(rows: DataFrame, reps: int) -> DataFrame:
    """One uniformly drawn row per (replicate, day).

    Draw and row key are packed into one integer, so the draw is a plain hash
    aggregation of a minimum; only the winners are joined back to their rows.
    """
    rows = rows.select("date", "ticker", "actual_return")
    won = _with_draw(rows.select("date", "ticker"), reps, max(1, SPLIT_ROWS // reps)).groupBy("rep", "date").agg(
        F.min(F.col("_u") * _LOW + F.col("_h2")).alias("_win"))
    won = won.withColumns({"_h2": F.col("_win") % _LOW, "_u": F.expr(f"_win div {_LOW}")})
    keyed = rows.withColumns({"_h1": key_high("date", "ticker"), "_h2": key_low("date", "ticker")})
    found = draw_columns(won.join(keyed, ["date", "_h2"]), "rep", "_h1", "_h2", "_v")
    return found.filter(F.col("_u") == F.col("_v")).select("rep", "date", "ticker", "actual_return")


def drawn_picks(panel: DataFrame, reps: int, k: int = 1) -> DataFrame:
    """``k`` random rows per replicate and day: every row is drawn in every replicate, the smallest draws are picked."""
    if k == 1:
        return smallest_draw(panel, reps)
    rows = _with_draw(panel.select("date", "ticker", "actual_return"), reps, max(1, SPLIT_ROWS // reps))
    order = Window.partitionBy("rep", "date").orderBy("_u", "_h2", "ticker")
    return rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k).select(
        "rep", "date", "ticker", "actual_return")


def drawn_top(panel: DataFrame, reps: int, k: int = 1) -> DataFrame:
    """Top-k names after shuffling scores among the names of each day, every row drawn in every replicate.

    The i-th name in random order receives the i-th largest score, so the top k
    are the first k of that order, unless scores tie at the boundary: then the
    first ``above`` names are in, and the remaining places go alphabetically
    among the next ``tied`` ones.
    """
    rows = panel.select("date", "ticker", "actual_return", F.coalesce("prob", F.lit(float("-inf"))).alias("_s"))
    order = Window.partitionBy("date").orderBy(F.desc("_s"), "ticker")
    edge = rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k).groupBy("date").agg(
        F.min("_s").alias("_edge"), F.count(F.lit(1)).alias("_k"))
    info = rows.join(edge, "date").groupBy("date").agg(
        F.first("_k").alias("_k"), F.count_if(F.col("_s") > F.col("_edge")).alias("_above"),
        F.count_if(F.col("_s") == F.col("_edge")).alias("_tied"))
    rows = rows.drop("_s").join(info, "date")
    open_tie = F.col("_tied") > F.col("_k") - F.col("_above")
    clear = drawn_picks(rows.filter(~open_tie), reps, k)
    placed = drawn_positions(rows.filter(open_tie), reps).filter(
        F.col("position") <= F.col("_above") + F.col("_tied"))
    sure = placed.filter(F.col("position") <= F.col("_above"))
    among = placed.filter(F.col("position") > F.col("_above")).withColumn(
        "_rn", F.row_number().over(Window.partitionBy("rep", "date").orderBy("ticker"))
    ).filter((F.col("_rn") <= k) & (F.col("_rn") <= F.col("_k") - F.col("_above")))
    cols = ["rep", "date", "ticker", "actual_return"]
    return clear.select(*cols).unionByName(sure.select(*cols)).unionByName(among.select(*cols))


def replicate_metrics(picks: DataFrame, panel: DataFrame, reps: int, k: int = 1,
                      cost_bps: float = COST_BPS) -> DataFrame:
    """Metrics of an equally weighted book of the picks, one row per replicate."""
    if k == 1:
        w = picks.withColumn("w", F.lit(1.0))
    else:
        members = F.count(F.lit(1)).over(Window.partitionBy("rep", "date"))
        w = picks.withColumn("w", F.lit(1.0) / members)
    days = calendar(panel).withColumn("rep", numbers(1, reps))
    daily = daily_book(w.withColumn("strategy", F.lit("null")), days, ["null"], ["rep"])
    return performance(charge(daily, cost_bps), ["rep"])


def single_name_sharpes(picks: DataFrame, cost_bps: float = COST_BPS) -> DataFrame:
    """Sharpe ratio of books that hold one name a day, one row per replicate.

    With a single name the turnover is 1 on the first day, then 0 or 2, so one
    pass in day order replaces the general book; only the final product of
    returns is needed, not the curve.
    """
    before = F.lag("ticker").over(Window.partitionBy("rep").orderBy("date"))
    rows = picks.withColumn(
        "_turn", F.when(before.isNull(), 1.0).when(before == F.col("ticker"), 0.0).otherwise(2.0))
    net = F.coalesce("actual_return", F.lit(0.0)) - F.col("_turn") * cost_bps / 10000.0
    f = 1 + F.col("_net")
    s = rows.select("rep", net.alias("_net")).groupBy("rep").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("_net").alias("_sd"),
        F.sum(F.log(F.when(f != 0, F.abs(f)))).alias("_log"),
        F.sum((f < 0).cast("long")).alias("_neg"), F.max((f == 0).cast("int")).alias("_zero"))
    value = F.when(F.col("_zero") == 1, 0.0).when(F.col("_neg") % 2 == 0, F.exp("_log"))
    vol = F.col("_sd") * (YEAR ** 0.5)
    annual = F.pow(value, YEAR / F.col("n")) - 1
    return s.select("rep", F.when(vol > 0, ratio(annual, vol)).otherwise(0.0).alias("null_sharpe"))


def permutation_sharpes(panel: DataFrame, reps: int = 1000, k: int = 1, cost_bps: float = COST_BPS,
                        top: Callable = permuted_top) -> DataFrame:
    """(rep, null_sharpe) under within-day shuffles of the score; ``top`` is ``permuted_top`` or ``drawn_top``."""
    if k == 1:
        return single_name_sharpes(top(panel, reps), cost_bps)
    m = replicate_metrics(top(panel, reps, k), panel, reps, k, cost_bps)
    return m.select("rep", F.col("sharpe_ratio").alias("null_sharpe"))


def null_summary(null: DataFrame, observed: DataFrame, stat: str, by: Sequence[str] = ()) -> DataFrame:
    """Upper p value, mean, 95th percentile and percentile rank of ``observed``.

    ``observed`` holds one row per key with a column ``observed``.
    """
    by = list(by) or ["_all"]
    if by == ["_all"]:
        null, observed = null.withColumn("_all", F.lit(0)), observed.withColumn("_all", F.lit(0))
    rows = null.join(observed, by)
    x, o = F.col(stat), F.col("observed")
    # a replicate without a Sharpe ratio is not above anything
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    s = rows.groupBy(*by).agg(
        F.first("observed").alias("observed"), F.count(F.lit(1)).alias("n_reps"), F.avg(x).alias("null_mean"),
        F.percentile(x, F.lit(0.95)).alias("null_95th"), share(x >= o).alias("p_value"),
        (100 * (share(x < o) + share(x <= o)) / 2
         + F.when(F.max((x == o).cast("int")) == 1, 50.0 / F.count(F.lit(1))).otherwise(0.0)).alias("percentile_rank"))
    return s.withColumn("significant", F.col("p_value") < 0.05).drop("_all")


def random_baseline(panel: DataFrame, reps: int = 100, k: int = 1, cost_bps: float = COST_BPS) -> DataFrame:
    """Numeric metrics averaged over random books."""
    m = replicate_metrics(drawn_picks(panel, reps, k), panel, reps, k, cost_bps)
    numeric = [c for c, t in m.dtypes if t in ("double", "bigint", "long") and c != "rep"]
    return m.agg(*[F.avg(c).alias(c) for c in numeric])


def random_day_returns(panel: DataFrame, reps: int = 50, cost_bps: float = COST_BPS) -> DataFrame:
    """Mean over random single-name draws per day, each built up from cash."""
    picks = random_picks(panel, reps)
    return picks.groupBy("date").agg(
        F.avg(F.coalesce("actual_return", F.lit(0.0)) - cost_bps / 10000.0).alias("net_return"))


def permuted_ic(panel: DataFrame, score: str = "prob", realised: str = "actual_return", reps: int = 1000) -> DataFrame:
    """(rep, null_mean_ic): mean daily rank correlation after within-day shuffles.

    Ranks do not depend on the replicate; only the pairing does, so a replicate
    reduces to one sum of rank products per day.
    """
    rows = panel.select("date", "ticker", F.col(score).alias("_s"), F.col(realised).alias("_r")).dropna()
    rows = rank_columns(rows, ["date"], {"_s": "_rs", "_r": "_rr"})
    days = rows.groupBy("date").agg(
        F.count(F.lit(1)).alias("_n"), F.var_pop("_rs").alias("_vs"), F.var_pop("_rr").alias("_vr"),
        F.var_pop("_s").alias("_rawS"), F.var_pop("_r").alias("_rawR"))
    held = rows.groupBy("date", "_rs").agg(F.count(F.lit(1)).alias("_c"))
    tied = held.groupBy("date").agg((F.max("_c") > 1).alias("_ties"))
    rows = rows.select("date", "ticker", "_rr").join(tied, "date")
    # the i-th name in random order receives the i-th largest score: without ties its rank is n + 1 - i, and the day's
    # sum follows from the places; only on days with ties are the ranks of tied places looked up
    clear = drawn_positions(rows.filter(~F.col("_ties")), reps).groupBy("rep", "date").agg(
        F.sum(F.col("_rr") * F.col("position")).alias("_xp")).join(days, "date").withColumn(
        "_xy", F.col("_n") * (F.col("_n") + 1) * (F.col("_n") + 1) / 2 - F.col("_xp")).drop("_xp")
    slots = _score_slots(held.join(tied.filter("_ties"), "date"), days)
    mixed = drawn_positions(rows.filter("_ties"), reps).join(slots, ["date", "position"]).groupBy("rep", "date").agg(
        F.sum(F.col("_rr") * F.col("_slot")).alias("_xy")).join(days, "date")
    d = clear.unionByName(mixed.select(*clear.columns))
    mid = (F.col("_n") + 1) / 2
    flat = (F.col("_rawS") < 1e-12) | (F.col("_rawR") < 1e-12)
    rho = F.try_divide(F.col("_xy") / F.col("_n") - mid * mid, F.sqrt(F.col("_vs") * F.col("_vr")))
    ic = F.when(flat, 0.0).otherwise(F.coalesce(rho, F.lit(0.0)))
    return d.groupBy("rep").agg(F.avg(ic).alias("null_mean_ic"))


def _score_slots(held: DataFrame, days: DataFrame) -> DataFrame:
    """Rank held by the i-th largest score of each day, ties spelled out."""
    first = (F.col("_n") - F.col("_rs") - (F.col("_c") - 1) / 2 + 1).cast("long")
    return held.join(days.select("date", "_n"), "date").select(
        "date", F.explode(F.sequence(first, first + F.col("_c") - 1)).alias("position"),
        F.col("_rs").alias("_slot"))


def _numbered(series: DataFrame, by: list[str], value: str, time: str) -> DataFrame:
    """Values of each series numbered from 0, with the series mean removed too."""
    every, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(time)
    rows = series.filter(F.col(value).isNotNull())
    return rows.select(
        *by, F.col(value).alias("x"), (F.row_number().over(w) - 1).cast("long").alias("_i"),
        F.count(F.lit(1)).over(every).cast("long").alias("_n"), (F.col(value) - F.avg(value).over(every)).alias("_e"))


def _slots(units: DataFrame, by: list[str], reps: int, count: Column, pool: Column) -> DataFrame:
    """``count`` draws from ``[0, pool)`` per replicate."""
    d = units.select(*by, count.alias("_m"), pool.alias("_pool"))
    d = d.withColumn("rep", numbers(1, reps))
    d = d.withColumn("_j", numbers(1, F.col("_m")))
    return draw_columns(d.withColumn("_low", F.col("_j") * 7919), "rep", "_j", "_low", "_u").select(
        *by, "rep", (F.col("_u") % F.col("_pool")).alias("_i"))


def centred_bootstrap(series: DataFrame, reps: int = 1000, by: Sequence[str] = (), value: str = "ic",
                      time: str = "date", block: int = 1) -> DataFrame:
    """(rep, null_mean) of the centred series, drawn with replacement.

    ``block > 1`` draws whole non-overlapping blocks; a short last block is left
    out, as the definition has it.
    """
    keys = list(by) or ["_all"]
    if not by:
        series = series.withColumn("_all", F.lit(0))
    rows = _numbered(series, keys, value, time)
    blocks = rows.filter(F.col("_i") < F.expr(f"_n div {block} * {block}")).groupBy(
        *keys, F.expr(f"_i div {block}").alias("_i")).agg(F.avg("_e").alias("_e"))
    units = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b"))
    picks = _slots(units, keys, reps, F.col("_b"), F.col("_b"))
    return picks.join(blocks, [*keys, "_i"]).groupBy(*keys, "rep").agg(F.avg("_e").alias("null_mean")).drop("_all")


def moving_block_interval(series: DataFrame, by: Sequence[str], reps: int = 2000, value: str = "ic",
                          time: str = "date", block: int = 5, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the mean from overlapping blocks, per series.

    Starts are uniform over the series and blocks end with it.  Sums per start
    are formed once; a replicate adds up the sums it drew.
    """
    keys = list(by)
    rows = _numbered(series, keys, value, time)
    ahead = Window.partitionBy(*keys).orderBy("_i").rowsBetween(0, block - 1)
    starts = rows.select(*keys, "_i", F.sum("x").over(ahead).alias("_sum"), F.count("x").over(ahead).alias("_cnt"))
    facts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    picks = _slots(facts, keys, reps, F.greatest(F.expr(f"n_days div {block}"), F.lit(1)), F.col("n_days"))
    means = picks.join(starts, [*keys, "_i"]).groupBy(*keys, "rep").agg(
        (F.sum("_sum") / F.sum("_cnt")).alias("_mean"))
    bounds = means.groupBy(*keys).agg(
        F.percentile("_mean", F.lit(alpha / 2)).alias("ci_low"),
        F.percentile("_mean", F.lit(1 - alpha / 2)).alias("ci_high"))
    return facts.join(bounds, keys).withColumn(
        "ci_excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))
