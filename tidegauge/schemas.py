"""Declared schemas, label domains and label aliases."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "str": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(),
    "double": T.DoubleType(), "bool": T.BooleanType(), "ts": T.TimestampType(),
    "map": T.MapType(T.StringType(), T.DoubleType()),
    "strs": T.ArrayType(T.StringType()),
}


def struct_of(spec: str) -> T.StructType:
    """``"a b: bigint, c: str"`` -> StructType; every field is nullable."""
    fields: list[T.StructField] = []
    for part in spec.split(","):
        names, kind = part.split(":")
        fields += [T.StructField(n, _TYPES[kind.strip()], True) for n in names.split()]
    return T.StructType(fields)


# Field names of the task tables.
T1_FEATURES = [
    "score", "cluster_count", "linked_tweet_count", "avg_link_confidence",
    "max_link_confidence", "text_similarity", "tweet_count", "unique_user_count",
    "burst_duration_hours", "max_author_followers", "mean_author_followers",
    "median_author_followers", "high_follower_author_count",
]

TASK_SCHEMAS: dict[str, T.StructType] = {
    "t1": struct_of("event_group_id condition_id question category event_group_label event_text "
                  "interest_label: str, " + " ".join(T1_FEATURES) + ": double"),
    "t2": struct_of("tweet_id: bigint, tweet_text market_id market_question: str, "
                  "embedding_score: double, gold is_gold: bool"),
    "t3": struct_of("tweet_id: bigint, condition_id tweet market question: str, "
                  "final_grade llm_grade: int, llm_confidence: double"),
    "t4": struct_of("tweet_id: bigint, condition_id: str, created_at: ts, price_t0 delta_30m "
                  "delta_2h delta_6h: double, direction_label magnitude_bucket: str, "
                  "confound_flag: bool"),
    "t5": struct_of("tweet_id: bigint, condition_id: str, price_impact_json "
                  "volume_multiplier_json: map, decay_class: str, confound_flag: bool"),
    "t6": struct_of("tweet_id: bigint, primary_condition_id label: str, sibling_count "
                  "moved_sibling_count: int, primary_delta_h: double, confound_flag "
                  "insufficient_data_flag: bool"),
}
TASK_SCHEMAS["t7"] = TASK_SCHEMAS["t5"]

POST_SCHEMA = struct_of("tweet_id: bigint, created_at text: str")
TICK_SCHEMA = struct_of("condition_id side: str, timestamp: bigint, open high low close volume: double")

PREDICTION_SCHEMAS: dict[str, T.StructType] = {
    "t1": struct_of("condition_id label: str"),
    "t2": struct_of("tweet_id: bigint, ranked_market_ids: strs"),
    "t3": struct_of("tweet_id: bigint, condition_id: str, predicted_grade: int"),
    "t4": struct_of("tweet_id: bigint, delta_2h: double"),
    "t5": struct_of("tweet_id: bigint, condition_id decay_class: str, price_impact "
                  "volume_multiplier: double"),
    "t6": struct_of("tweet_id: bigint, label: str"),
    "t7": struct_of("tweet_id: bigint, condition_id label: str"),
}

# Label domains, horizons, seeds and scales.
INTEREST_LABELS = ["high_interest", "moderate_interest", "low_interest"]
DIRECTION_LABELS = ["up", "down", "flat"]
MAGNITUDE_LABELS = ["small", "medium", "large"]
DECAY_LABELS = ["transient", "sustained", "reversal"]
PROPAGATION_LABELS = ["no_cross_market_effect", "primary_mover", "propagated_signal"]
GRADE_NAMES = {0: "noise", 1: "commentary_reaction", 2: "speculation_rumor",
               3: "indirect_report", 4: "strong_direct", 5: "resolving"}
IMPACT_HORIZONS = ["15m", "30m", "1h", "2h", "6h"]
DELTA_HORIZONS = ["30m", "2h", "6h"]
MOMENTUM_SCALES = {"30m": 1.0, "2h": 4.0, "6h": 12.0}
PRIOR_SEEDS = [13, 42, 123]
LABEL_ALIASES = {"high": "high_interest", "moderate": "moderate_interest",
                 "low": "low_interest", "no_effect": "no_cross_market_effect"}

MINUTE_US = 60 * 1_000_000
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US
HORIZON_US = {"15m": 15 * MINUTE_US, "30m": 30 * MINUTE_US, "1h": HOUR_US,
              "2h": 2 * HOUR_US, "6h": 6 * HOUR_US}
