"""Chat formatting by quotation linking, in DataFrame functions alone.

Lines that begin with '>' are quotes; the number of '>' is their level.
Successive lines of a level form a passage. A passage's normalised text
(lower case, white space collapsed) and each of its lines of three words or
more are hashed; so is what every message says itself. A quoted hash is joined
to the latest earlier message of the conversation that says it: an as-of
window over the hashes that are quoted at all, never pairs. The parent of a
message is the match of its lowest level, the latest among these.

Messages are returned without quotes and attributions, each with a path: its
own turn below its parent's path. Ordered by path, replies follow what they
answer, and messages without a parent keep the order of their turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint

QUOTE = r"^[ \t]*>"
_MARKERS = r"^((?:[ \t]*>)+)[ \t]?"
#: Lines before a quote that only say whose it is: fixed forms of four languages.
ATTRIBUTION = r"(?i)^[ \t]*(on .{1,200} wrote|.{1,120} (wrote|said|schrieb|a écrit|escribió))[ \t]*:[ \t]*$"
LEAST_WORDS = 3


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _hashes(body: Column) -> Column:
    """Of the whole and of its longer lines, none for blank ones."""
    lines = F.transform(F.split(body, "\n"), normalised)
    long = F.filter(lines, lambda x: F.size(F.split(x, " ")) >= LEAST_WORDS)
    whole = F.filter(F.array(normalised(body)), lambda x: x != "")
    return F.array_distinct(F.transform(F.concat(whole, long), lambda x: F.unhex(F.sha2(x, 256))))


def _parsed(messages: DataFrame) -> DataFrame:
    """Add ``own`` (text without quotes) and ``passages`` (level, body) to messages that quote."""
    lines = F.transform(F.split("text", "\r?\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _MARKERS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, _MARKERS, "").alias("body")))
    m = messages.withColumn("_lines", lines)
    level = lambda i: F.get(F.col("_lines"), i)["level"]
    own = F.filter("_lines", lambda x, i: (x["level"] == 0) & ~(x["body"].rlike(ATTRIBUTION) & (F.coalesce(level(i + 1), F.lit(0)) > 0)))
    starts = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: (i == 0) | (level(i) != F.coalesce(level(i - 1), F.lit(-1))))
    m = m.withColumn("own", F.trim(F.array_join(F.transform(own, lambda x: x["body"]), "\n"))).withColumn("_starts", starts)
    end = lambda j: F.coalesce(F.get(F.col("_starts"), j + 1), F.size("_lines"))
    passages = F.transform("_starts", lambda s, j: F.struct(level(s).alias("level"), F.array_join(F.transform(F.slice("_lines", s + 1, end(j) - s), lambda x: x["body"]), "\n").alias("body")))
    return m.withColumn("passages", F.filter(passages, lambda p: (p["level"] > 0) & (F.trim(p["body"]) != ""))).drop("_lines", "_starts")


def _paths(links: DataFrame) -> DataFrame:
    """(conv_id, turn, path): turns from the topmost ancestor down. Rounds double the known part of a path."""
    state = checkpoint(links.select("conv_id", "turn", F.col("parent").alias("top"), F.array("parent", "turn").alias("path")))
    while True:
        up = state.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("top").alias("_top"), F.col("path").alias("_path"))
        joined = state.join(up, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("top") == F.col("_t")), "left")
        longer = F.concat("_path", F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0))))
        state = checkpoint(joined.select("conv_id", "turn", F.coalesce("_top", "top").alias("top"), F.when(F.col("_t").isNull(), F.col("path")).otherwise(longer).alias("path"), F.col("_t").isNotNull().alias("grew")))
        if not state.filter("grew").limit(1).count():
            return state.select("conv_id", "turn", "path")
        state = state.drop("grew")


def link_quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content, n_passages, parent_turn, path, formatted), a row for each message.

    Null texts count as empty. A null turn has no place in time, so it neither
    quotes nor is quoted; a null conv_id is a conversation of its own. Rows
    that repeat (conv_id, turn) are linked alike. Columns other than conv_id,
    turn, role and text play no part. An empty table gives an empty result.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    quotes = F.col("text").rlike("(?m)" + QUOTE)
    none = F.array().cast("array<struct<level:int,body:string>>")
    said = rows.filter(~quotes).withColumns({"own": F.trim("text"), "passages": none}).unionByName(_parsed(rows.filter(quotes)))
    asked = _parsed(rows.filter(quotes & F.col("turn").isNotNull())).select("conv_id", "turn", F.explode("passages").alias("p"))
    asked = checkpoint(asked.select("conv_id", "turn", F.col("p.level").alias("level"), F.explode(_hashes(F.col("p.body"))).alias("h")).distinct())
    links = None
    if asked.limit(1).count():
        wanted = asked.select(F.col("conv_id").alias("_c"), F.col("h").alias("_h")).distinct()
        known = said.filter("turn is not null").select("conv_id", "turn", F.explode(_hashes(F.col("own"))).alias("h"))
        known = known.join(wanted, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("h") == F.col("_h")), "left_semi").distinct()
        both = known.withColumn("level", F.lit(None).cast("int")).unionByName(asked)
        before = W.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
        found = both.withColumn("parent", F.max(F.when(F.col("level").isNull(), F.col("turn"))).over(before)).filter("level is not null and parent is not null")
        links = checkpoint(found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("parent")).alias("at"))).alias("m")).select("conv_id", "turn", (-F.col("m.at")).alias("parent")))
    if links is None or not links.limit(1).count():
        out = said.withColumns({"parent_turn": F.lit(None).cast("long"), "path": F.array("turn")})
    else:
        tree = _paths(links).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("path").alias("_path"))
        out = said.join(tree, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
        out = out.withColumns({"parent_turn": F.get("_path", F.size("_path") - 2), "path": F.coalesce("_path", F.array("turn"))})
    role = F.coalesce("role", F.lit("unknown"))
    path = F.array_join(F.transform("path", lambda t: F.lpad(t.cast("string"), 19, "0")), "/")
    return out.select("conv_id", "turn", "role", F.col("own").alias("content"), F.size("passages").cast("long").alias("n_passages"), "parent_turn", path.alias("path"), F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("own"), F.lit("\n<|end|>\n")).alias("formatted"))


ORACLE = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS said_by, role, coalesce(text, '') AS text, regexp_matches(coalesce(text, ''), '(?m)^[ \t]*>') AS quotes, row_number() OVER () AS id FROM conversations),
split AS (SELECT id, conv_id, turn, regexp_split_to_array(text, '\r?\n') AS ls FROM m WHERE quotes),
lines AS (SELECT id, conv_id, turn, i, length(regexp_replace(regexp_extract(ls[i], '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) AS lv, regexp_replace(ls[i], '^((?:[ \t]*>)+)[ \t]?', '') AS body FROM split, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
near AS (SELECT *, coalesce(lead(lv) OVER (PARTITION BY id ORDER BY i), 0) AS next_lv, CASE WHEN lv = lag(lv) OVER (PARTITION BY id ORDER BY i) THEN 0 ELSE 1 END AS new FROM lines),
runs AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM near),
own AS (SELECT id, trim(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE lv = 0 AND NOT (next_lv > 0 AND regexp_matches(body, '(?i)^[ \t]*(on .{1,200} wrote|.{1,120} (wrote|said|schrieb|a écrit|escribió))[ \t]*:[ \t]*$'))), ''), ' ') AS own FROM runs GROUP BY id),
passages AS (SELECT id, any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(lv) AS lv, string_agg(body, chr(10) ORDER BY i) AS body FROM runs GROUP BY id, run HAVING any_value(lv) > 0 AND trim(string_agg(body, chr(10) ORDER BY i), ' ') <> ''),
said AS (SELECT m.*, CASE WHEN quotes THEN own.own ELSE trim(text, ' ') END AS content, coalesce(p.n, 0) AS n_passages FROM m LEFT JOIN own USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM passages GROUP BY 1) p USING (id)),
units AS (SELECT 'said' AS kind, conv_id, turn, CAST(NULL AS BIGINT) AS lv, content AS body FROM said UNION ALL SELECT 'asked', conv_id, turn, lv, body FROM passages),
parts AS (SELECT kind, conv_id, turn, lv, lower(trim(regexp_replace(body, '\s+', ' ', 'g'), ' ')) AS u, 1 AS least FROM units
  UNION ALL SELECT kind, conv_id, turn, lv, lower(trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')), 3 FROM (SELECT kind, conv_id, turn, lv, unnest(string_split(body, chr(10))) AS x FROM units)),
good AS (SELECT DISTINCT kind, conv_id, turn, lv, u FROM parts WHERE turn IS NOT NULL AND u <> '' AND len(string_split(u, ' ')) >= least),
hits AS (SELECT a.conv_id, a.turn, a.lv, max(s.turn) AS parent FROM good a JOIN good s ON a.kind = 'asked' AND s.kind = 'said' AND a.u = s.u AND a.conv_id IS NOT DISTINCT FROM s.conv_id AND s.turn < a.turn GROUP BY 1, 2, 3, a.u),
links AS (SELECT conv_id, turn, first(parent ORDER BY lv, parent DESC) AS parent FROM hits GROUP BY 1, 2),
paths AS (SELECT conv_id, turn, parent, parent AS top, [parent, turn] AS path FROM links UNION ALL SELECT p.conv_id, p.turn, p.parent, l.parent, list_prepend(l.parent, p.path) FROM paths p JOIN links l ON p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.top = l.turn),
whole AS (SELECT conv_id, turn, any_value(parent) AS parent, arg_max(path, len(path)) AS path FROM paths GROUP BY 1, 2)
SELECT s.conv_id, s.turn, s.role, s.content, s.n_passages, w.parent AS parent_turn,
  coalesce(array_to_string(list_transform(coalesce(w.path, [s.turn]), lambda t: lpad(CAST(t AS VARCHAR), 19, '0')), '/'), '') AS path, '<|' || said_by || '|>' || chr(10) || s.content || chr(10) || '<|end|>' || chr(10) AS formatted
FROM said s LEFT JOIN whole w ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.turn = w.turn
"""


def quoting(messages: DataFrame) -> DataFrame:
    """Conversations as mails that quote: every other message quotes the one before, and every fourth what that one answers too, a level deeper."""
    w = W.partitionBy("conv_id").orderBy("turn")
    quoted = lambda n, mark: F.concat(F.lit(mark), F.replace(F.lag("text", n).over(w), F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))
    both = F.concat(F.lit("On Monday X wrote:\n"), F.when(F.col("turn") % 4 == 3, F.coalesce(quoted(2, ">> "), F.lit(""))).otherwise(""), quoted(1, "> "), F.col("text"))
    return messages.withColumn("text", F.when(F.col("turn") % 2 == 1, F.coalesce(both, F.col("text"))).otherwise(F.col("text")))


QUOTED_ORACLE = r"""
WITH RECURSIVE quoted AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 1 THEN coalesce('On Monday X wrote:' || chr(10) || CASE WHEN turn % 4 = 3 THEN coalesce('>> ' || replace(lag(text, 2) OVER w, chr(10), chr(10) || '>> ') || chr(10), '') ELSE '' END
  || '> ' || replace(lag(text) OVER w, chr(10), chr(10) || '> ') || chr(10) || text, text) ELSE text END AS text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
""" + ORACLE.replace("WITH RECURSIVE ", "", 1).replace("FROM conversations)", "FROM quoted)", 1).lstrip()
