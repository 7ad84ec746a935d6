"""Fixed values that results depend on, in one place."""

# Reaction horizons and their minutes after the anchor; those from a day on fall forward.
HORIZONS = {"5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "1d": 1440, "3d": 4320, "5d": 7200}
FALL_FORWARD = ("1d", "3d", "5d")
FALL_FORWARD_DAYS = 3
FRESH_MINUTES = 30
WINDOW_BEFORE_HOURS, WINDOW_AFTER_DAYS = 72, 8
FETCH_BEFORE_HOURS, FETCH_AFTER_DAYS = 72, 5
LEAST_BETA_DAYS = 30
FLAT_BPS = 10.0
RECOVERY_TRIGGER_BPS, RECOVERY_DAYS, CONCLUSIVE_DAYS = -50.0, 30, 29
# Versions of measurements and the clocks that they start from: receipt and publication.
CLOCKS = {"m1": "anchor_ts", "m1-pub": "published_ts"}
SKEW_MINUTES, STALE_HOURS = 2, 24
LINK_CONFIDENCE = 0.75
SIMILARITY, CLUSTER_HOURS = 0.5, 48
CALENDAR_MINUTES = 60
QUOTE_AGE_HOURS = 24
LIQUIDITY_DAYS, LEAST_LIQUIDITY_DAYS = 20, 10
SLIPPAGE_BPS = 5
FEE_BPS = {"us_equity": 0, "crypto": 26}
EXIT_HOURS = {"intraday": 6.5, "1d": 24.0, "3d": 72.0, "5d": 120.0}
INTENT_HOURS, CLOSE_ATTEMPTS, MODEL_ATTEMPTS = 6, 3, 3
BIG_MOVE_BPS, BRIDGE_LEAST, BRIDGE_COST_BPS = 100.0, 20, 20.0
LEDE_CHARS = 1200

# Default rules: gates, sizing and exits.
RULES = {
    "min_confidence": 0.75,
    "reject_already_expected": True,
    "reject_calendar_match": True,
    "event_types": (),
    "stale_move_max_bps": 300.0,
    "min_median_dollar_volume": 5_000_000.0,
    "max_positions": 10,
    "allow_shorts": False,
    "risk_bps": 50,
    "atr_lookback": 14,
    "atr_stop_multiple": 2,
    "max_notional_share": 0.1,
    "time_stop": "3d",
    "stop_atr_multiple": 2,
    "take_profit_atr_multiple": None,
}
GATES = ("direction_actionable", "min_confidence", "already_expected", "calendar_match", "event_type_whitelist", "stale_move", "liquidity", "max_concurrent_positions", "no_existing_position")

# Confidence of an entity link by how it was found.
LINK_METHODS = {"cik": 1.0, "source_hint": 0.65, "exchange_prefix": 0.9, "cashtag": 0.85, "crypto_keyword": 0.8, "name_alias": 0.7}
# Words that are no name by themselves.
GENERIC_ALIASES = ("company", "corp", "corporation", "incorporated", "limited", "holdings", "group", "industries", "international", "enterprises", "technologies", "systems", "solutions", "partners", "brands", "the")
