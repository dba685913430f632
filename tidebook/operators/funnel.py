"""From scan results to guarded finalists and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, VariantType

from tidebook.config import ScanConfig
from tidebook.functions.frames import staged
from tidebook.functions.scalars import pick, rint_to, zero_default
from tidebook.operators.scan import DIAGNOSTICS, MARKET_COLUMNS, publish, scan_inputs, score_rows

# Order of the verification states.
STATUS_ORDER = {"BROKER_VERIFIED": 0, "BROKER_GUARDED": 1, "BROKER_PENDING": 2, "BROKER_REJECT": 3}

DISPLAY_DIAGNOSTICS = (
    "broker_verified_source_pct",
    "broker_days",
    "persistence_20d",
    "broker_cohort_stability",
    "cost_position",
    "foreign_evidence_coverage_pct",
    "foreign_evidence_source",
    "official_foreign_coverage_pct",
    "market_regime_label",
    "relative_strength_20d_pct",
    "guarded_rank",
    "guarded_score",
    "broker_verification_status",
)


def parse_diagnostics(df: DataFrame) -> DataFrame:
    """Diagnostics held as JSON text become a variant, which keeps whatever fields the text has.

    Null, empty or bad text and JSON that is not an object become an object without fields."""
    if not isinstance(df.schema["diagnostics"].dataType, StringType):
        return df
    parsed = F.try_parse_json("diagnostics")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))
    return df.withColumn("diagnostics", F.when(is_object, parsed).otherwise(F.parse_json(F.lit("{}"))))


def _diag_field(df: DataFrame, name: str, kind: str = "double") -> Column | None:
    """A field of struct or variant diagnostics; a variant's value that is not of the kind is null."""
    held = df.schema["diagnostics"].dataType if "diagnostics" in df.columns else None
    if isinstance(held, VariantType):
        return F.try_variant_get("diagnostics", f"$.{name}", kind)
    return F.col(f"diagnostics.{name}") if held is not None and name in held.fieldNames() else None


def finalist_gate(df: DataFrame, config: ScanConfig, minimum_foreign_coverage_pct: float = 70.0) -> DataFrame:
    """Result rows that are healthy, covered and still on price evidence only."""
    # Risk 70, default staleness 999.
    coverage = [c for c in map(lambda n: _diag_field(df, n), ("foreign_evidence_coverage_pct", "official_foreign_coverage_pct")) if c is not None]
    stale = _diag_field(df, "price_staleness_days", "int")
    rows = df.withColumns(
        {
            "foreign_evidence_coverage_pct": F.coalesce(*coverage, F.lit(0.0)),
            "price_staleness_days": F.coalesce(stale, F.lit(999)) if stale is not None else F.lit(999),
        }
    )
    return rows.where(
        (F.coalesce("distribution_risk", F.lit(100.0)) < 70)
        & (F.coalesce("price_data_quality_score", F.lit(0.0)) >= config.guard_min_price_quality)
        & (F.col("price_staleness_days") <= config.max_price_staleness_days)
        & (F.col("foreign_evidence_coverage_pct") >= minimum_foreign_coverage_pct)
        & (F.coalesce("phase", F.lit("UNKNOWN")) != "DISTRIBUTION")
        & (F.coalesce("action", F.lit("RESEARCH_ONLY")) != "REDUCE_AVOID")
        & (F.coalesce("evidence_tier", F.lit("UNKNOWN")) == "PRICE_PROXY")
    )


def select_guarded_top5(
    results: DataFrame,
    config: ScanConfig | None = None,
    top_n: int = 5,
    minimum_foreign_coverage_pct: float = 70.0,
) -> DataFrame:
    """The best ``top_n`` gated rows with their rank; a top-k, no global sort."""
    order = [
        *[F.col(c).desc_nulls_last() for c in ("final_score", "accumulation_score", "foreign_institutional_score", "smc_execution_score")],
        F.col("ticker").asc(),
    ]
    best = finalist_gate(results, config or ScanConfig(), minimum_foreign_coverage_pct).orderBy(*order).limit(top_n)
    return best.withColumns(
        {
            "guarded_rank": F.row_number().over(Window.orderBy(*order)),
            "guarded_status": F.lit("GUARDED_FINALIST"),
            "guarded_score": F.col("final_score"),
        }
    )


def verification_errors(finalists: DataFrame, bars: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """Finalists that cannot be verified because their history is too short, one row each."""
    least = (config or ScanConfig()).minimum_price_bars
    counts = bars.join(finalists.select("ticker"), "ticker", "left_semi").groupBy("ticker").agg(F.count("close").alias("bars"))
    held = finalists.select("ticker").join(counts, "ticker", "left").withColumn("bars", F.coalesce("bars", F.lit(0)))
    return held.where(F.col("bars") < least).select(
        "ticker",
        F.lit("BROKER_VERIFY").alias("stage"),
        "bars",
        F.concat(F.col("bars").cast("string"), F.lit(f" bars, {least} needed")).alias("error"),
    )


def verify_guarded_top5(
    finalists: DataFrame,
    bars: DataFrame,
    broker: DataFrame | None,
    flow: DataFrame | None = None,
    config: ScanConfig | None = None,
    keep_reference: bool = True,
) -> DataFrame:
    """Re-scores the finalists with broker rows under their first-pass market context.

    Inputs are cut to the finalists before any aggregation. With
    ``keep_reference`` the staleness of the first pass is carried over;
    otherwise a finalist is measured against its own last bar.
    """
    config = config or ScanConfig()
    names = finalists.select("ticker")

    def only(df: DataFrame | None) -> DataFrame | None:
        return None if df is None else df.join(names, "ticker", "left_semi")

    held = finalists.select(
        "ticker",
        "guarded_rank",
        zero_default(F.coalesce("guarded_score", "final_score"), 0.0).alias("guarded_score"),
        zero_default(F.col("market_context_score"), 50.0).alias("market_sector_score"),
        *[F.col(f"diagnostics.{c}").alias(c) for c in MARKET_COLUMNS if c != "market_sector_score"],
        F.col("as_of_date").alias("held_date"),
        F.col("diagnostics.price_staleness_days").alias("held_staleness"),
    )
    reference = "date_add(held_date, held_staleness)" if keep_reference else "held_date"
    rows = staged(scan_inputs(only(bars), only(broker), only(flow), config), "verify-inputs").join(held, "ticker")
    rows = rows.where(F.col("bars") >= config.minimum_price_bars)
    scored = score_rows(rows, config, reference)
    status = (
        F.when(~F.col("direct_broker"), F.lit("BROKER_PENDING"))
        .when(
            (F.col("phase") == "DISTRIBUTION")
            | (F.col("action") == "REDUCE_AVOID")
            | (zero_default(rint_to(F.col("effective_distribution"), 2), 100.0) >= 70),
            F.lit("BROKER_REJECT"),
        )
        .when(F.col("real_money_state") == "ELIGIBLE", F.lit("BROKER_VERIFIED"))
        .otherwise(F.lit("BROKER_GUARDED"))
    )
    held_names = ("guarded_rank", "guarded_score", "broker_verification_status")
    out = publish(scored.withColumn("broker_verification_status", status), *held_names)
    order = [
        pick(F.col("broker_verification_status"), STATUS_ORDER, 9),
        F.col("final_score").desc(),
        F.col("accumulation_score").desc(),
        F.col("guarded_rank"),
        F.col("ticker"),
    ]
    ranked = out.withColumns(
        {
            "diagnostics": F.struct(
                "diagnostics.broker_alpha_applied",
                *[f"diagnostics.{c}" for c in DIAGNOSTICS],
                "guarded_rank",
                "guarded_score",
                "broker_verification_status",
            ),
            # At most ``top_n`` rows reach this window.
            "broker_rank": F.row_number().over(Window.orderBy(*order)),
        }
    )
    return staged(ranked, "verified")


def merge_verified_finalists(base: DataFrame, verified: DataFrame) -> DataFrame:
    """Finalist rows replace theirs in the result set, common columns only, nulls included."""
    common = [c for c in base.columns if c in verified.columns and c not in ("ticker", "diagnostics")]
    both_diagnose = "diagnostics" in base.columns and "diagnostics" in verified.columns
    replacement = verified.select(
        F.col("ticker").alias("_ticker"),
        *[F.col(c).alias(f"_r_{c}") for c in common],
        *([F.col("diagnostics").alias("_d")] if both_diagnose else []),
        F.lit(True).alias("_hit"),
    )
    joined = base.join(replacement, F.col("ticker") == F.col("_ticker"), "left")
    hit = F.coalesce("_hit", F.lit(False))
    out = []
    for c in base.columns:
        if c in common:
            out.append(F.when(hit, F.col(f"_r_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "diagnostics" and both_diagnose:
            # The wider struct of the verified rows; base rows leave its extra fields null.
            fields = verified.schema["diagnostics"].dataType.fields
            own = base.schema["diagnostics"].dataType.fieldNames()
            merged = [
                F.when(hit, F.col(f"_d.{f.name}"))
                .otherwise(F.col(f"diagnostics.{f.name}") if f.name in own else F.lit(None).cast(f.dataType))
                .alias(f.name)
                for f in fields
            ]
            out.append(F.struct(*merged).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def recover_funnel_views(results: DataFrame, top_n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Finalist and broker views rebuilt from stored diagnostics: a struct, a variant or JSON text."""
    results = parse_diagnostics(results)
    kinds = {"guarded_rank": "int", "guarded_score": "double", "broker_verification_status": "string"}
    rows = results.withColumns({n: _diag_field(results, n, kind) for n, kind in kinds.items()})
    guarded = rows.where(F.col("guarded_rank").isNotNull()).orderBy("guarded_rank", "ticker").limit(top_n)
    order = [
        pick(F.col("broker_verification_status"), STATUS_ORDER, 9),
        F.col("final_score").desc(),
        F.col("guarded_rank"),
    ]
    broker = guarded.where(F.col("broker_verification_status").isNotNull())
    return guarded, broker.withColumn("broker_rank", F.row_number().over(Window.orderBy(*order)))


def production_lane(df: DataFrame) -> DataFrame:
    return df.where(
        (F.col("broker_verification_status") == "BROKER_VERIFIED")
        & (F.col("evidence_tier") == "BROKER_DIRECT")
        & (F.col("real_money_state") == "ELIGIBLE")
    )


def decorate(df: DataFrame) -> DataFrame:
    """Diagnostics lifted to columns; cost fields shown for direct rows only."""
    lifted = {}
    for name in DISPLAY_DIAGNOSTICS:
        field = _diag_field(df, name)
        if name not in df.columns and field is not None:
            lifted[name] = field
    out = df.withColumns(lifted)
    direct = F.coalesce(F.col("evidence_tier") == "BROKER_DIRECT", F.lit(False))
    return out.withColumns(
        {
            "bandar_price_est": F.when(direct, F.col("estimated_smart_money_cost")),
            "bandar_vs_price_pct": F.when(direct, F.col("premium_to_cost_pct")),
            "bandar_cost_position": F.when(direct, F.col("cost_position")).otherwise(F.lit("UNVERIFIED")),
        }
    )
