"""Card, wallet and lending fraud detectors, for every row against the history before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ladder, ratio
from ..functions.segments import HALO, HOT_ROWS, PART, Segments, carried, segmented, with_carried, with_halo

# Fixed values.
RISKY_MCC = ("5967", "5966", "7995", "5912", "5999", "4829", "6051", "6211")
MIXERS = ("tornado", "wasabi", "samurai", "hydra", "silk", "stake", "cloudbet")
SANCTIONED = ("0x8589", "0x098b", "0xd90e")
DUST = {"BTC": 0.00001, "ETH": 0.0001, "USDT": 0.01}
FRAUD_TYPES = ("credit_card", "blockchain", "lending", "payment_domestic", "payment_international", "identity", "application", "account_takeover")


# What to do at each level, and first of all for one indicator.
CARD_ACTIONS = {"critical": "Block transaction and contact cardholder immediately", "high": "Hold transaction pending cardholder verification", "medium": "Flag for review and monitor subsequent transactions", "low": "Monitor transaction pattern"}
WALLET_ACTIONS = {"critical": "Freeze wallet and file SAR", "high": "Enhanced due diligence and transaction review", "medium": "Monitor wallet activity", "low": "Monitor wallet activity"}
LENDING_ACTIONS = {"critical": "Decline application", "high": "Request additional documentation and verification", "medium": "Enhanced manual review required", "low": "Proceed with standard underwriting"}
SANCTIONED_ACTION = "Block transaction immediately - OFAC/sanctions violation"
SYNTHETIC_ACTION = "Decline application and flag for fraud investigation"


def action(by_level: dict[str, str], special: Column | None = None, text: str = "") -> Column:
    out = F.element_at(F.create_map(*[F.lit(x) for kv in by_level.items() for x in kv]), F.col("level"))
    return out if special is None else F.when(special, text).otherwise(out)


def added(*parts: Column) -> Column:
    return sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))


def combined(df: DataFrame, checks: dict[str, Column], rungs: list[tuple[float, str]], prefix: str, key: str, names: dict[str, Column] | None = None) -> DataFrame:
    """Rows with at least one indicator: their names (or what ``names`` has for one), the capped sum, level and a reproducible alert id."""
    df = df.withColumns({f"s_{k}": F.coalesce(c, F.lit(0.0)) for k, c in checks.items()})
    total = sum((F.col(f"s_{k}") for k in checks), F.lit(0.0))
    names = F.array_compact(F.array(*[F.when(F.col(f"s_{k}") > 0, (names or {}).get(k, F.lit(k))) for k in checks]))
    out = df.withColumns({"indicators": names, "fraud_score": F.least(F.lit(1.0), F.round(total, 9))}).where(F.size("indicators") > 0)
    level = ladder(F.col("fraud_score"), rungs, "low")
    return out.withColumns({"level": level, "alert_id": F.concat(F.lit(prefix), F.upper(F.substring(F.md5(F.col(key).cast("string")), 1, 12)))}).drop(*[f"s_{k}" for k in checks])


#: More payments than this within a day are too many.
VELOCITY = 10

CARD_RUNGS = [(0.8, "critical"), (0.6, "high"), (0.3, "medium")]
LENDING_RUNGS = [(0.7, "critical"), (0.5, "high"), (0.3, "medium")]


def card_history(tx: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """What a card's earlier payments say at each payment; earlier is by time, then id.

    ``count_24h`` counts the payments of the day before, no further than VELOCITY + 1 of them. A card of more
    than ``hot_rows`` payments is worked on in parts (``functions.segments``).
    """
    key, order = ["cardholder_id"], ["timestamp", "transaction_id"]
    s = segmented(tx, key, order, hot_rows)
    w = s.window()
    here = F.when(F.col("merchant_country").isNotNull(), F.struct("merchant_country", F.col("timestamp").alias("at")))
    placed = F.when(F.col("merchant_country").isNotNull(), F.struct(*order, here.alias("x")))

    def moved(rows: DataFrame) -> DataFrame:
        """With ``change``: the last place before this one, where it is in another country."""
        seen = F.coalesce(F.last(here, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("__last.x"))
        rows = rows.withColumn("__seen", seen)
        return rows.withColumn("change", F.when(F.col("__seen.merchant_country") != F.col("merchant_country"), F.col("__seen"))).drop("__seen")

    first = carried(s.hot, key, {"__most": F.max("amount"), "__last": F.max(placed)}, {"__most": F.max("__most"), "__last": F.max("__last")})
    changes = F.max(F.when(F.col("change").isNotNull(), F.struct(*order, F.col("change").alias("x"))))
    second = carried(moved(with_carried(s.hot, first, key)), key, {"__change": changes}, {"__change": F.max("__change")})
    rows = moved(with_carried(with_carried(with_halo(s, VELOCITY + 1), first, key), second, key))
    change = F.coalesce(F.last(F.when(~F.col(HALO), F.col("change")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.col("__change.x"))
    sec = F.unix_timestamp("timestamp")
    recent = F.collect_list(sec).over(w.rowsBetween(-VELOCITY - 1, -1))
    out = rows.withColumns({
        "other_place": F.when(F.col("merchant_country").isNotNull(), change), "max_before": F.greatest(F.max("amount").over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("__most")),
        "declined_10": F.sum(F.when(F.col("status") == "declined", 1).otherwise(0)).over(w.rowsBetween(-10, -1)), "__recent": recent,
    })
    out = out.where(~F.col(HALO)).withColumn("count_24h", F.size(F.filter("__recent", lambda t: t >= F.unix_timestamp("timestamp") - 86400)))
    return out.drop(PART, HALO, "change", "__most", "__last", "__change", "__recent")


def card_fraud(tx: DataFrame, profiles: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    c, no = F.col, F.lit(False)
    t = card_history(tx, hot_rows)
    if profiles is not None:
        t = t.join(profiles.withColumn("has_profile", F.lit(True)), "cardholder_id", "left")
    testing = F.when(((c("amount") < 5) & (c("max_before") > c("amount"))) | (c("declined_10") >= 3), 0.4)
    hours = (F.unix_timestamp("timestamp") - F.unix_timestamp("other_place.at")) / 3600
    absent = F.coalesce(~c("is_card_present"), no)  # null is not known to be absent
    cnp = lambda flag, s: F.when(absent & ~F.coalesce(c(flag), no), s)
    checks = {
        "card_testing_pattern": testing, "high_velocity": F.when(c("count_24h") > VELOCITY, 0.3), "geographic_anomaly": F.when(hours < 3, 0.5), "high_risk_mcc": F.when(c("mcc").isin(*RISKY_MCC), 0.2),
        "cvv_mismatch": cnp("cvv_match", 0.25), "avs_mismatch": cnp("avs_match", 0.2), "no_3ds": cnp("three_ds", 0.15),
    }
    if profiles is not None:
        p = F.coalesce(c("has_profile"), no)
        z = F.when((c("avg_transaction_amount") > 0) & (c("std_transaction_amount") > 0), ratio(c("amount") - c("avg_transaction_amount"), c("std_transaction_amount")))
        usual = F.coalesce(c("usual_hours"), F.array(*[F.lit(h) for h in range(8, 22)]))
        mcc = (F.size("usual_mccs") > 0) & (c("mcc") != "") & ~F.array_contains("usual_mccs", c("mcc"))
        checks["behavioral_deviation"] = F.when(p, added(F.when(z > 3, 0.2), F.when(mcc, 0.1), F.when(~F.array_contains(usual, F.hour("timestamp")), 0.1)))
    return combined(t, checks, CARD_RUNGS, "CC-", "transaction_id", {"high_risk_mcc": F.concat(F.lit("high_risk_mcc_"), "mcc")}).withColumn("recommended_action", action(CARD_ACTIONS))


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for p in parts:
        out = out | low.contains(p)
    return out


def starts_any(c: Column, parts: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for p in parts:
        out = out | low.startswith(p)
    return out


def dust(amount: Column, currency: Column) -> Column:
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DUST.items() for x in kv]), F.coalesce(currency, F.lit("ETH"))), F.lit(0.0001))
    return (amount > 0) & (amount < limit)


def wallet_history(tx: DataFrame, wallet: str = "from_address", hot_rows: int = HOT_ROWS) -> DataFrame:
    """What a wallet's earlier payments say at each payment; one of more than ``hot_rows`` is worked on in parts."""
    key = [wallet]
    s = segmented(tx, key, ["timestamp", "tx_hash"], hot_rows)
    w = s.window()

    def timed(rows: DataFrame) -> DataFrame:
        gap = F.unix_timestamp("timestamp") - F.unix_timestamp(F.lag("timestamp").over(w))
        return rows.withColumn("quick", F.when(gap < 60, 1).otherwise(0))

    own = timed(with_halo(Segments(s.hot, s.hot, s.key, s.order), 1)).where(~F.col(HALO))
    state = carried(own, key, {"__rows": F.count("*"), "__quick": F.sum("quick")}, {"__rows": F.sum("__rows"), "__quick": F.sum("__quick")})
    before, last10 = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(-10, -1)
    here = (~F.col(HALO)).cast("int")
    rows = with_carried(timed(with_halo(s, 20)), state, key)
    return rows.withColumns({
        "rows_before": F.coalesce(F.sum(here).over(before), F.lit(0)) + F.coalesce("__rows", F.lit(0)), "addresses_10": F.size(F.array_distinct(F.concat(F.collect_set("from_address").over(last10), F.collect_set("to_address").over(last10)))),
        "quick_before": F.coalesce(F.sum(here * F.col("quick")).over(before), F.lit(0)) + F.coalesce("__quick", F.lit(0)), "currencies_20": F.size(F.collect_set("currency").over(w.rowsBetween(-20, -1))),
    }).where(~F.col(HALO)).drop(PART, HALO, "__rows", "__quick")


def wallet_fraud(tx: DataFrame, wallet: str = "from_address", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Wallet payments: mixers, sanctioned prefixes, layering, timing, chain hopping and dust.

    The checks of single payments are in ``rules.wallet_alerts`` without any window.
    """
    t = wallet_history(tx, wallet, hot_rows)
    c = F.col
    checks = {
        "mixer_usage": F.when(contains_any(c("to_address"), MIXERS), 0.7), "mixer_source": F.when(contains_any(c("from_address"), MIXERS), 0.6),
        "sanctioned_address": F.when(starts_any(c("to_address"), SANCTIONED) | starts_any(c("from_address"), SANCTIONED), 1.0), "layering_pattern": F.when((c("rows_before") >= 5) & (c("addresses_10") > 8), 0.5),
        "suspicious_timing": F.when(c("quick_before") >= 3, 0.3), "high_risk_exchange": F.when(c("currencies_20") > 5, 0.3), "potential_dust_attack": F.when(dust(c("amount"), c("currency")), 0.2),
    }
    return combined(t, checks, CARD_RUNGS, "BC-", "tx_hash").withColumn("recommended_action", action(WALLET_ACTIONS, F.array_contains("indicators", "sanctioned_address"), SANCTIONED_ACTION))


def lending_fraud(applications: DataFrame, history: DataFrame | None = None, bureau: DataFrame | None = None) -> DataFrame:
    """Loan applications ``(application_id, applicant_id, ...)``; history and bureau rows are by applicant, and absent ones disable their checks."""
    a = applications
    if history is not None:
        a = a.join(history.select("applicant_id", "applications_last_30_days"), "applicant_id", "left")
    c, has, no = F.col, lambda n: n in a.columns, F.lit(False)
    if bureau is not None:
        b = bureau.select("applicant_id", *[F.col(x).alias(f"b_{x}") for x in bureau.columns if x != "applicant_id"])
        a = a.join(b.withColumn("has_bureau", F.lit(True)), "applicant_id", "left")
    yes = lambda x: F.coalesce(c(x), no)
    d = "device_info."
    checks = {
        "employment_concern": added(F.when((c("employment_length_months") < 6) & (c("annual_income") > 200_000), 0.2), F.when((c("employment_type") == "self_employed") & ~yes("business_verified"), 0.15)),
        "device_anomaly": added(F.when(yes(d + "is_vpn") | yes(d + "is_proxy"), 0.2), F.when(c(d + "other_identities_count") > 1, 0.3), F.when(yes(d + "geo_mismatch"), 0.2)),
    }
    if has("applications_last_30_days"):
        checks["application_velocity"] = F.when(c("applications_last_30_days") > 5, 0.4).when(c("applications_last_30_days") > 3, 0.2)
    if bureau is not None:
        differs = lambda x: (F.lower(c(x)) != F.lower(c(f"b_{x}"))) & (c(f"b_{x}") != "")
        checks |= {
            "income_discrepancy": F.when((c("b_estimated_income") > 0) & (c("annual_income") / c("b_estimated_income") > 2), 0.4),
            "identity_inconsistency": added(F.when(differs("name"), 0.2), F.when(differs("date_of_birth"), 0.3), F.when(yes("b_ssn_issues"), 0.4)),
            "potential_synthetic_identity": added(
                F.when((c("b_credit_file_age_months") < 12) & (c("b_account_count") >= 5), 0.3), F.when(yes("has_bureau") & (F.coalesce(F.size("b_historical_addresses"), F.lit(0)) <= 0), 0.2), F.when(c("b_authorized_user_accounts") > 3, 0.2)
            ),
        }
    synthetic = F.array_contains("indicators", "potential_synthetic_identity")
    return combined(a, checks, LENDING_RUNGS, "LF-", "application_id").withColumn("recommended_action", action(LENDING_ACTIONS, synthetic, SYNTHETIC_ACTION))


DETECTORS = {"credit_card": (card_fraud, "cardholder_id", "transaction_id"), "blockchain": (wallet_fraud, "from_address", "tx_hash"), "lending": (lending_fraud, "applicant_id", "application_id")}


def detect(kind: str, rows: DataFrame, *context: DataFrame) -> DataFrame:
    """Alerts of one detector in one schema; ``context`` is the detector's (card profiles; applicants' history, bureau data)."""
    if kind not in DETECTORS:
        raise ValueError(f"no detector of {kind!r}; there are {', '.join(DETECTORS)}")
    f, entity, key = DETECTORS[kind]
    text = lambda c: F.col(c).cast("string")
    return f(rows, *context).select("alert_id", F.lit(kind).alias("fraud_type"), "level", "fraud_score", text(entity).alias("entity_id"), text(key).alias("transaction_id"), "indicators", "recommended_action")
