"""Customer churn: contract ends, product ends, trials, cancellation timing.

Most questions are "does a contract have rows with property X and rows with
property Y".  They are answered with one ``groupBy(contract_id)`` holding
boolean / min / max flags (map-side combined, so a huge contract costs one
partial row per task) instead of the self-joins the questions are phrased as.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subledger.constants import (
    CANCELLATION_WINDOW,
    CHURN_CUTOFF,
    DISCONTINUATION_DATE,
    DURATION_BIN_BOUNDS,
    DURATION_BIN_LABELS,
    DURATION_BIN_LABELS_V1,
    EQUIPMENT_TYPE,
    RESULT_DIGITS,
    TOP_CANCEL_DATES,
    TOP_CHURNED_CONTRACTS,
    TOP_PRODUCT_END_DATES,
    TRIAL_TYPE,
)
from subledger.functions import duration_bin, exact_sum, rounded
from subledger.operators.idsets import count_ids, distinct_ids, id_sets
from subledger.operators.intervals import intervals_hit_by_other_points
from subledger.operators.quantiles import quantiles


def _any(cond) -> Column:
    """True if any row of the group satisfies ``cond`` (NULL counts as false)."""
    return F.coalesce(F.max(F.coalesce(cond, F.lit(False))), F.lit(False))


def pp_contract_rowcount(l3_pp_product_contract: DataFrame) -> DataFrame:
    return l3_pp_product_contract.agg(F.count("contract_id").alias("cnt"))


def contract_duration_bins(
    l3_pp_product_contract: DataFrame,
    labels: Sequence[str] = DURATION_BIN_LABELS,
    bounds: Sequence[int] = DURATION_BIN_BOUNDS,
) -> DataFrame:
    """Distinct contracts per duration bin, over contracts with an end date.

    The bin label replaces the day count under the same name, and the
    grouping is by the label (computed first under another name).
    """
    rows = l3_pp_product_contract.where(F.col("contract_valid_to").isNotNull())
    rows = rows.select("contract_id", duration_bin("contract_duration", bounds, labels).alias("__bin"))
    per = distinct_ids(rows, "contract_id", "cnt", by=F.col("__bin"))
    return per.withColumnRenamed("__bin", "contract_duration").orderBy("contract_duration")


def contract_duration_bins_v1(l3_pp_product_contract: DataFrame) -> DataFrame:
    """First version of the bin table (label "Y2" for 1-2 years)."""
    return contract_duration_bins(l3_pp_product_contract, DURATION_BIN_LABELS_V1)


def _churn_row(cutoff: dt.date) -> Column:
    return (F.col("contract_valid_to") == F.col("product_valid_to")) & (F.col("contract_valid_to") < F.lit(cutoff))


def customers_churned(l3_pp_contract: DataFrame, cutoff: dt.date = CHURN_CUTOFF) -> DataFrame:
    """Purchase rows ending on their contract's end day, before the cut-off."""
    return l3_pp_contract.where(_churn_row(cutoff)).orderBy(F.col("product_lifecycle").desc(), "contract_id", "product_purchase_id")


def churned_multi_product_top(
    l3_pp_contract: DataFrame, cutoff: dt.date = CHURN_CUTOFF, top: int = TOP_CHURNED_CONTRACTS
) -> DataFrame:
    """Contracts whose rows x churn rows exceed one, largest first.

    The self-join on contract id yields rows(c) * churn_rows(c) pairs per
    contract; both factors are counted in one aggregation.
    """
    per = l3_pp_contract.where(F.col("contract_id").isNotNull()).groupBy("contract_id").agg(
        (F.count(F.lit(1)) * F.count_if(_churn_row(cutoff))).alias("cnt")
    )
    return per.where(F.col("cnt") > 1).orderBy(F.col("cnt").desc(), F.col("contract_id").asc()).limit(top)


def unique_contracts(l1_contract: DataFrame) -> DataFrame:
    return distinct_ids(l1_contract.where(F.col("contract_valid_from").isNotNull()), "contract_id", "unique_contracts")


def _started_contract_purchases(l2_product_purchase: DataFrame, l2_contract: DataFrame, type_cond) -> DataFrame:
    started = l2_contract.where(F.col("contract_valid_from").isNotNull()).select(F.col("contract_id").alias("__sc"))
    pp = l2_product_purchase.where(type_cond & F.col("product_valid_from").isNotNull())
    return pp.join(started, pp["contract_id"] == started["__sc"], "left_semi")


def trial_customers(l2_product_purchase: DataFrame, l2_contract: DataFrame, trial_type: str = TRIAL_TYPE) -> DataFrame:
    """Distinct started contracts with a started trial purchase."""
    pp = _started_contract_purchases(l2_product_purchase, l2_contract, F.col("product_type") == trial_type)
    return distinct_ids(pp, "contract_id", "trial_customers")


def non_trial_customers(l2_product_purchase: DataFrame, l2_contract: DataFrame, trial_type: str = TRIAL_TYPE) -> DataFrame:
    """Distinct started contracts with any started non-trial purchase (not "never had a trial")."""
    pp = _started_contract_purchases(l2_product_purchase, l2_contract, F.col("product_type") != trial_type)
    return distinct_ids(pp, "contract_id", "non_trial_customers")


def continued_after_trial(l3_pp_product_contract: DataFrame, trial_type: str = TRIAL_TYPE) -> DataFrame:
    """Contracts with a non-trial product ending after one of their started trials, or open-ended.

    Per contract: a started trial exists, and either an open-ended non-trial
    row exists or the latest non-trial end is after the earliest trial end.
    """
    t = F.col("product_type")
    trial = (t == trial_type) & F.col("product_valid_from").isNotNull()
    other = t != trial_type
    per = l3_pp_product_contract.groupBy("contract_id").agg(
        _any(trial).alias("has_trial"),
        F.min(F.when(trial, F.col("product_valid_to"))).alias("first_trial_end"),
        _any(other & F.col("product_valid_to").isNull()).alias("open_other"),
        F.max(F.when(other, F.col("product_valid_to"))).alias("last_other_end"),
    )
    ok = F.col("has_trial") & (
        F.col("open_other") | F.coalesce(F.col("last_other_end") > F.col("first_trial_end"), F.lit(False))
    )
    return per.where(F.col("contract_id").isNotNull()).agg(F.count_if(ok).alias("continued_customers"))


def _ended_rows(l3_pp_product_contract: DataFrame) -> DataFrame:
    return l3_pp_product_contract.where(F.col("product_valid_to").isNotNull() & F.col("contract_id").isNotNull())


def churn_same_day_vs_kept(l3_pp_product_contract: DataFrame) -> DataFrame:
    """Contracts with a product ending on / before the contract's end day."""
    sets = id_sets(
        _ended_rows(l3_pp_product_contract),
        "contract_id",
        {
            "same": F.col("product_valid_to") == F.col("contract_valid_to"),
            "before": F.col("product_valid_to") < F.col("contract_valid_to"),
        },
    )
    return count_ids(sets, {"churned_on_same_day_count": "same", "kept_subscription_count": "before"})


def churn_with_other_products(l3_pp_product_contract: DataFrame) -> DataFrame:
    """Of those two sets: contracts that also had another product.

    "Another product" = an ended row that outlived its start paired with an
    ended row of a different product id.  Such a pair exists exactly when
    some ended row has end > start and the ended rows carry at least two
    distinct product ids (min != max).
    """
    per = _ended_rows(l3_pp_product_contract).groupBy("contract_id").agg(
        _any(F.col("product_valid_to") == F.col("contract_valid_to")).alias("same"),
        _any(F.col("product_valid_to") < F.col("contract_valid_to")).alias("before"),
        _any(F.col("product_valid_to") > F.col("product_valid_from")).alias("active"),
        (F.min("product_id") != F.max("product_id")).alias("two_ids"),
    )
    other = F.col("active") & F.coalesce(F.col("two_ids"), F.lit(False))
    return per.agg(
        F.count_if(F.col("same") & other).alias("churned_with_other_products_count"),
        F.count_if(F.col("before") & other).alias("kept_with_other_products_count"),
    )


def churned_equipment_other_types(
    l3_pp_product_contract: DataFrame, equipment_type: str = EQUIPMENT_TYPE, **skew
) -> DataFrame:
    """Types of a contract's other products active on a day its equipment ended, counted.

    The question's join has one row per ended equipment row and distinct other
    product; ``cnt`` is the number of those rows per contract and type, formed
    from the two counts, so the pairs of a large contract are never expanded.

    The probe for hot contracts, the points, the intervals and the row counts read
    the same five columns: they are written once to the checkpoint folder, unfiltered,
    so that the joins run and the dates are worked out once.  So is the result, which
    the final sort reads twice (range bounds, rows).
    """
    rows = l3_pp_product_contract.select("contract_id", "product_id", "product_type", "product_valid_from", "product_valid_to")
    rows = rows.checkpoint(eager=True)
    ended = rows.where(F.col("product_valid_to").isNotNull())
    equipment = ended.where(F.col("product_type") == equipment_type)
    others = intervals_hit_by_other_points(
        ended,
        equipment,
        group_col="contract_id",
        id_col="product_id",
        lo_col="product_valid_from",
        hi_col="product_valid_to",
        at_col="product_valid_to",
        keep_cols=["product_type"],
        **skew,
    )
    other_types = (
        others.select("contract_id", "product_id", "product_type")
        .distinct()
        .groupBy("contract_id", F.col("product_type").alias("other_product_at_same_time"))
        .agg(F.count(F.lit(1)).alias("__m"))
    )
    eq_rows = equipment.where(F.col("contract_id").isNotNull()).groupBy(F.col("contract_id").alias("__ec")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    per = other_types.join(eq_rows, other_types["contract_id"] == eq_rows["__ec"], "inner").select(
        "contract_id",
        F.lit(equipment_type).alias("discontinued_product"),
        "other_product_at_same_time",
        (F.col("__n") * F.col("__m")).alias("cnt"),
    ).checkpoint(eager=True)
    return per.orderBy("contract_id", F.col("other_product_at_same_time").asc_nulls_first())


def _trial_contract_flags(l3_pp_contract: DataFrame, trial_type: str) -> DataFrame:
    t = F.col("product_type")
    return l3_pp_contract.where(F.col("contract_id").isNotNull()).groupBy("contract_id").agg(
        _any((t == trial_type) & F.col("product_valid_from").isNotNull()).alias("had_trial"),
        F.count_if(t != trial_type).alias("other_rows"),
        exact_sum(F.when(t != trial_type, F.col("price_wo_vat"))).alias("other_price"),
    )


def trial_then_other_rows(l3_pp_contract: DataFrame, trial_type: str = TRIAL_TYPE) -> DataFrame:
    """Non-trial purchase rows of contracts that had a started trial."""
    per = _trial_contract_flags(l3_pp_contract, trial_type).where("had_trial")
    return per.agg(F.coalesce(F.sum("other_rows"), F.lit(0)).cast("long").alias("cnt"))


def trial_then_other_revenue(
    l3_pp_contract: DataFrame, trial_type: str = TRIAL_TYPE, digits: int | None = RESULT_DIGITS
) -> DataFrame:
    per = _trial_contract_flags(l3_pp_contract, trial_type).where("had_trial")
    return per.agg(rounded(exact_sum("other_price"), digits).alias("revenue"))


def trial_revenue(l3_pp_contract: DataFrame, trial_type: str = TRIAL_TYPE, digits: int | None = RESULT_DIGITS) -> DataFrame:
    rows = l3_pp_contract.where((F.col("product_type") == trial_type) & F.col("product_valid_from").isNotNull())
    return rows.agg(rounded(exact_sum("price_wo_vat"), digits).alias("revenue"))


def top_cancel_dates(l2_contract: DataFrame, top: int = TOP_CANCEL_DATES) -> DataFrame:
    return (
        l2_contract.where(F.col("contract_valid_to").isNotNull())
        .groupBy("contract_valid_to")
        .agg(F.count_distinct("contract_id").alias("cnt"))
        .orderBy(F.col("cnt").desc(), F.col("contract_valid_to").asc())
        .limit(top)
    )


def avg_cancellations_per_day(
    l2_contract: DataFrame,
    window: tuple[dt.date, dt.date] = CANCELLATION_WINDOW,
    digits: int | None = RESULT_DIGITS,
) -> DataFrame:
    per_day = (
        l2_contract.where(F.col("contract_valid_to").between(F.lit(window[0]), F.lit(window[1])))
        .groupBy("contract_valid_to")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return per_day.agg(rounded(F.avg("cnt"), digits).alias("avg_cancellations_per_day"))


def lost_after_discontinuation(l3_pp_product_contract: DataFrame, day: dt.date = DISCONTINUATION_DATE) -> DataFrame:
    """Contracts holding a product that some contract ended on ``day`` and not running past it."""
    rows = l3_pp_product_contract.where(F.col("contract_id").isNotNull())
    discontinued = (
        l3_pp_product_contract.where(F.col("product_valid_to") == F.lit(day))
        .select(F.col("product_id").alias("__dp"))
        .distinct()
        .withColumn("__disc", F.lit(True))
    )
    marked = rows.join(discontinued, rows["product_id"] == discontinued["__dp"], "left")
    sets = id_sets(
        marked,
        "contract_id",
        {
            "subscribed": F.col("__disc"),
            "continuing": (F.col("contract_valid_to") > F.lit(day)) | F.col("contract_valid_to").isNull(),
        },
    )
    return count_ids(sets, {"customer_count": F.col("subscribed").bitwiseAND(F.bitwise_not("continuing"))})


def products_ended_with_contract(l3_pp_product_contract: DataFrame, day: dt.date = DISCONTINUATION_DATE) -> DataFrame:
    rows = l3_pp_product_contract.where(
        (F.col("contract_valid_to") == F.col("product_valid_to")) & (F.col("product_valid_to") == F.lit(day))
    )
    return distinct_ids(rows, "product_id", "product_count")


def top_product_end_dates(l3_pp_product_contract: DataFrame, top: int = TOP_PRODUCT_END_DATES) -> DataFrame:
    return (
        l3_pp_product_contract.where(F.col("product_valid_to").isNotNull())
        .groupBy("product_valid_to")
        .agg(F.count("product_id").alias("cnt"))
        .orderBy(F.col("cnt").desc(), F.col("product_valid_to").asc())
        .limit(top)
    )


def last_invoice_end_dates(l2_invoice: DataFrame) -> DataFrame:
    """End date of each contract's last invoice (highest invoice_order), by frequency.

    ``max_by`` per contract replaces the join back on (contract, max order).
    """
    last = l2_invoice.where(F.col("contract_id").isNotNull()).groupBy("contract_id").agg(
        F.max_by("end_date", "invoice_order").alias("end_date")
    )
    return last.groupBy("end_date").agg(F.count(F.lit(1)).alias("end_date_count")).orderBy(F.col("end_date_count").desc(), F.col("end_date").asc())


def end_date_by_invoice_order(l2_invoice: DataFrame) -> DataFrame:
    return (
        l2_invoice.groupBy("end_date", "invoice_order")
        .agg(F.count(F.lit(1)).alias("end_date_count"))
        .orderBy(F.col("end_date").asc(), F.col("end_date_count").desc(), F.col("invoice_order").asc())
    )


def median_contract_duration(l3_pp_contract: DataFrame) -> DataFrame:
    """Median contract duration over purchase rows (nearest rank, exact)."""
    return quantiles(l3_pp_contract, "contract_duration", [0.5], ["median"], method="disc")
