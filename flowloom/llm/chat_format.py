"""Dialogues rendered once per participant, with that speaker as the assistant.

Each role of a conversation but ``system`` is a participant.  From its point of
view its own turns are the assistant's, which a model is trained on, and all
other speakers are users with a name.  ``spans`` are the character ranges
``[begin, end)`` of the text that the loss covers: the participant's words and
the mark that ends its turn.

Conversations are rendered in parts of ``PART`` turns, so that no row grows with
the longest conversation; parts are numbered from 0, and spans count from the
start of their part.  A part that begins with another turn than a system turn opens
with the last system turn before it, which ``n_turns`` does not count again.

* A NULL or empty role is the speaker ``unknown``; NULL text is empty.
* Turns go by ``turn`` (NULL first), then role, then text; repeated rows stay.
* Rows with a NULL ``conv_id`` are one conversation.  A conversation of system
  turns alone has no participant and gives no row.
* An empty table gives no rows; texts of any length stay whole.
* Columns other than the four that are read are left out, so names cannot clash.
* The marks of the format inside a text or role are broken up by a space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import query, table
from flowloom.operators.lineage import cut
from flowloom.operators.spread import running

PART = 256
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(value: Column) -> Column:
    return F.replace(value, F.lit("<|im_"), F.lit("<| im_"))


def rotate(turns: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """One row per turn and participant.

    ``conv_id``, ``speaker``, ``n``, ``n_system``, ``system``, ``head``, ``body``, ``own``.  ``n`` numbers the
    turns of a conversation from 0, ``n_system`` counts its system turns so far; ``system`` marks those and
    ``own`` the turns of ``speaker``.
    """
    role = F.when(F.col("role") == "", None).otherwise(F.col("role"))
    clean = cut(
        turns.select(
            "conv_id",
            F.col("turn").cast("long").alias("turn"),
            F.regexp_replace(_plain(F.coalesce(role, F.lit("unknown"))), r"[\r\n]", " ").alias("role"),
            _plain(F.coalesce("text", F.lit(""))).alias("body"),
        )
    )
    placed = running(
        clean, ["conv_id"], ["turn", "role", "body"],
        sums={"n": F.lit(1).cast("long"), "n_system": (F.col("role") == SYSTEM).cast("long")},
        rows_per_task=rows_per_task, total=clean.count(),
    ).withColumn("n", F.col("n") - 1)
    views = cut(
        clean.filter(F.col("role") != SYSTEM)
        .select(F.col("conv_id").alias("__conv"), F.col("role").alias("speaker"))
        .distinct()
    )
    own = F.col("role") == F.col("speaker")
    name = (
        F.when(F.col("role") == SYSTEM, F.lit(SYSTEM))
        .when(own, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), "role"))
    )
    return placed.join(views, F.col("conv_id").eqNullSafe(F.col("__conv"))).select(
        "conv_id", "speaker", "n", "n_system", (F.col("role") == SYSTEM).alias("system"),
        F.concat(F.lit(OPEN), name, F.lit("\n")).alias("head"), "body", own.alias("own"),
    )


def _repeated(rotated: DataFrame, part: int) -> DataFrame:
    """The system turns that open later parts, as rows of ``rotated`` with the ``n`` of the first turn."""
    of = rotated.filter("system").select(
        F.col("conv_id").alias("__conv"), F.col("speaker").alias("__speaker"), F.col("n_system").alias("__nr"),
        "head", "body",
    )
    late = rotated.filter((F.col("n") > 0) & (F.col("n") % part == 0) & ~F.col("system") & (F.col("n_system") > 0))
    on = (
        F.col("conv_id").eqNullSafe(F.col("__conv"))
        & (F.col("speaker") == F.col("__speaker"))
        & (F.col("n_system") == F.col("__nr"))
    )
    return late.drop("head", "body").join(of, on).drop("__conv", "__speaker", "__nr").withColumn("own", F.lit(False))


def render(rotated: DataFrame, part: int = PART) -> DataFrame:
    """``conv_id``, ``speaker``, ``part``, ``n_turns``, ``text`` and ``spans``."""
    piece = F.struct("n", "fresh", "head", "body", "own")
    pieces = rotated.withColumn("fresh", F.lit(True)).unionByName(
        _repeated(rotated, part).withColumn("fresh", F.lit(False))
    )
    close = f"{CLOSE}\n"
    texts = F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(close)))
    # One walk over the pieces keeps the place and notes where own words begin and end.
    spans = F.expr(
        "aggregate(pieces, struct(0L AS at, CAST(array() AS ARRAY<STRUCT<begin: BIGINT, end: BIGINT>>) AS out),"
        f" (a, p) -> struct(a.at + char_length(p.head) + char_length(p.body) + {len(close)} AS at,"
        " CASE WHEN p.own THEN array_append(a.out, struct(a.at + char_length(p.head) AS begin,"
        f" a.at + char_length(p.head) + char_length(p.body) + {len(CLOSE)} AS end)) ELSE a.out END AS out),"
        " a -> a.out)"
    )
    return (
        pieces.groupBy("conv_id", "speaker", F.floor(F.col("n") / part).alias("part"))
        .agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.count_if("fresh").alias("n_turns"))
        .select(
            "conv_id", "speaker", "part", "n_turns",
            F.array_join(texts, "").alias("text"), spans.alias("spans"),
        )
    )


SQL = f"""
WITH c AS MATERIALIZED (
  SELECT conv_id, turn, regexp_replace(replace(coalesce(nullif(role, ''), 'unknown'), '<|im_', '<| im_'),
         '[\\r\\n]', ' ', 'g') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS body
  FROM conversations),
t AS (SELECT *, row_number() OVER w - 1 AS n,
             CAST(count(*) FILTER (role = '{SYSTEM}') OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_system
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body)),
v AS (SELECT DISTINCT conv_id, role AS speaker FROM c WHERE role <> '{SYSTEM}'),
u AS (
  SELECT conv_id, role, body, n, true AS fresh FROM t
  UNION ALL
  SELECT t.conv_id, s.role, s.body, t.n, false FROM t JOIN t s
    ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.n_system = s.n_system AND s.role = '{SYSTEM}'
  WHERE t.n > 0 AND t.n % {PART} = 0 AND t.role <> '{SYSTEM}'),
r AS (
  SELECT u.conv_id, speaker, n, fresh, n // {PART} AS part, role = speaker AS own, body,
         '{OPEN}' || CASE WHEN role = '{SYSTEM}' THEN role WHEN role = speaker THEN 'assistant'
                     ELSE 'user name=' || role END || chr(10) AS head
  FROM u JOIN v ON u.conv_id IS NOT DISTINCT FROM v.conv_id),
p AS (
  SELECT *, head || body || '{CLOSE}' || chr(10) AS piece,
         coalesce(sum(length(head) + length(body) + {len(CLOSE) + 1}) OVER (
           PARTITION BY conv_id, speaker, part ORDER BY n, fresh
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begin
  FROM r)
SELECT conv_id, speaker, part::BIGINT AS part, count(*) FILTER (fresh) AS n_turns,
       string_agg(piece, '' ORDER BY n, fresh) AS text,
       string_agg(begin || '-' || (begin + length(body) + {len(CLOSE)}), ',' ORDER BY n)
         FILTER (WHERE own) AS spans
FROM p GROUP BY conv_id, speaker, part
"""


@query("op8_chat_format", SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = render(rotate(table(spark, sf_dir, "conversations")))
    listed = F.transform("spans", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string")))
    return done.withColumn("spans", F.when(F.size("spans") > 0, F.array_join(listed, ",")))
