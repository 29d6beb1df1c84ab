"""Schemas of the raw tables, roles of the feature columns, and the constants of the protocol."""

from __future__ import annotations

# Column names and types of the raw CSV files. The trailing blank of the last
# profile column is in the files.
RAW_SCHEMAS = {
    "raw_sample": "user long, time_stamp long, adgroup_id long, pid string, nonclk byte, clk byte",
    "ad_feature": "adgroup_id long, cate_id long, campaign_id long, customer long, brand double, price double",
    "user_profile": "userid long, cms_segid long, cms_group_id long, final_gender_code long, age_level long, pvalue_level double, shopping_level long, occupation long, `new_user_class_level ` double",
    "behavior_log": "user long, time_stamp long, btag string, cate long, brand long",
}
# What stands for null, the tags of behaviour, the price that stands for none.
NULL_TOKENS = ["", "NULL", "null"]
BTAGS = ["pv", "cart", "fav", "buy"]
PRICE_SENTINEL = 99999999.0

# Columns of the profile, and of what is counted over how many days.
PROFILE = ["cms_segid", "cms_group_id", "final_gender_code", "age_level", "pvalue_level", "shopping_level", "occupation", "new_user_class_level"]
METRICS = ["event", "pv", "cart", "fav", "buy"]
WINDOWS = [1, 3, 7, 14]
COUNTS = [f"{m}_count_{w}d" for w in WINDOWS for m in METRICS]
RECENCIES = ["days_since_last_event_14d", "days_since_last_buy_14d"]
HISTORY_FLAGS = ["has_behavior_history_14d", "has_buy_history_14d"]

#: The entity of each past click rate and the column that identifies it.
ENTITIES = {
    "user": "user_raw", "adgroup": "adgroup_id_raw", "cate": "cate_id_raw",
    "campaign": "campaign_id_raw", "customer": "customer_raw", "brand": "brand_raw",
}

CATEGORICAL = ["user_raw", "adgroup_id_raw", "pid_raw", "cate_id_raw", "campaign_id_raw", "customer_raw", "brand_raw", *PROFILE, "hour", "day_of_week"]
FIXED_DOMAINS = {"hour": list(range(24)), "day_of_week": list(range(1, 8))}
BINARY = ["price_is_sentinel", "brand_is_missing", "has_profile", *HISTORY_FLAGS]
NUMERIC = ["log_price", *COUNTS, *RECENCIES]
METADATA = ["impression_id", "time_stamp", "event_time_utc", "event_time_bj", "event_date_bj", "split"]
EXCLUDED = ["price_raw", "price_clean"]
LABEL = "clk"

#: Counts that enter the model: events are the sum of the others and stay out.
MODEL_COUNTS = [c for c in COUNTS if not c.startswith("event_")]
PAD, UNKNOWN, FIRST_INDEX = 0, 1, 2
RECENCY_FILL = 15.0
# Fixed values of the protocol: click rate before any history, and impressions it weighs.
PRIOR_CTR, PRIOR_WEIGHT = 0.05, 100.0
EPS = 1e-7

ROLES = {"categorical": CATEGORICAL, "binary": BINARY, "numeric": NUMERIC, "metadata": METADATA, "excluded": EXCLUDED, "label": [LABEL]}
#: Parts of a name that tell of the label.
LEAK_WORDS = ["clk", "click", "label", "target", "nonclk"]


def index_name(feature: str) -> str:
    return feature.removesuffix("_raw") + "_idx"


def role_table(columns: list[str], roles: dict[str, list[str]] = ROLES) -> list[tuple[str, str | None, bool]]:
    """Each column with its role, and whether it is a feature named for the label."""
    of = {c: role for role, cols in roles.items() for c in cols}
    return [(c, of.get(c), of.get(c) not in ("label", "metadata") and any(w in c.lower() for w in LEAK_WORDS)) for c in columns]


def check_roles(columns: list[str], roles: dict[str, list[str]] = ROLES) -> None:
    """Each column has one role, each role's columns exist, no feature is named for the label."""
    named = [c for cols in roles.values() for c in cols]
    twice = sorted({c for c in named if named.count(c) > 1})
    missing, extra = sorted(set(named) - set(columns)), sorted(set(columns) - set(named))
    leaks = sorted(c for role, cols in roles.items() if role not in ("label", "metadata") for c in cols if any(w in c.lower() for w in LEAK_WORDS))
    for what, found in (("with two roles", twice), ("not there", missing), ("without a role", extra), ("named for the label", leaks)):
        if found:
            raise ValueError(f"columns {what}: {found}")
