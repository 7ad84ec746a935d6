"""The domain views once more, as common table expressions for the checking engine."""

VIEWS = {
    "ev": "SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "bars_1m": """SELECT user_id % 8 AS instrument_id, date_trunc('minute', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
        min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume
        FROM events e WHERE event_type <> 'error' AND value > 0 GROUP BY 1, date_trunc('minute', e.ts)""",
    "bars_session": "SELECT * FROM bars_1m WHERE isodow(ts) < 6 AND hour(ts) BETWEEN 14 AND 20",
    "bars_1d": """SELECT o_custkey % 8 AS instrument_id, o_orderdate AS ts, max(o_totalprice) AS high, min(o_totalprice) AS low,
        last(o_totalprice ORDER BY o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2""",
    "anchors": """SELECT event_id AS cluster_id, user_id % 8 AS instrument_id, ts AS anchor_ts,
        CASE WHEN k % 7 <> 0 THEN ts - to_minutes(k % 50) END AS published_ts, k FROM ev WHERE event_type = 'error'""",
    "signals": """SELECT event_id AS signal_id, user_id % 8 AS instrument_id, ts AS anchor_ts,
        ['earnings', 'guidance', 'merger', 'legal', 'product'][k % 5 + 1] AS event_type, ['bullish', 'bearish', 'neutral'][k % 3 + 1] AS direction,
        k / 100 AS confidence, least(value / 200, 1.0) AS materiality, k % 4 = 0 AS already_expected,
        CASE WHEN user_id % 8 >= 6 THEN 'crypto' ELSE 'us_equity' END AS asset_class, 'v' || (user_id % 2 + 1) AS prompt_version, value, k
        FROM ev WHERE event_type = 'purchase'""",
    "scheduled": "SELECT event_id AS sched_id, CASE WHEN k % 40 <> 0 THEN user_id % 8 END AS instrument_id, ts AS scheduled_at FROM ev WHERE event_type = 'signup' AND k % 20 = 0",
    "news_items": """SELECT doc_id AS item_id, split_part(text, chr(10), 1) AS headline, text AS body, source, lang,
        TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS received_at FROM documents""",
    "fills": """SELECT l_partkey % 50 AS instrument_id, CASE WHEN l_returnflag = 'A' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS qty,
        round(l_extendedprice / l_quantity, 6) AS price, l_tax AS fee, l_shipdate AS filled_at, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem""",
    "membership": """SELECT l_suppkey AS member_id, min(l_shipdate) AS valid_from, CASE WHEN l_suppkey % 3 <> 0 THEN max(l_shipdate) END AS valid_to FROM lineitem GROUP BY l_suppkey""",
    "scored": "SELECT l.doc_id, lang, (n_chars % 1000) / 1000 AS score, quality = 1 AS hit FROM labels l JOIN documents d USING (doc_id)",
}
NEEDS = {"bars_session": ["bars_1m"], "anchors": ["ev"], "signals": ["ev"], "scheduled": ["ev"]}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``body`` after the named views and those that they need. ``body`` may begin with further expressions, after a comma."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n" + body
