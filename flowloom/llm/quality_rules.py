"""Quality rules per document and per host, in DataFrame functions only.

Every document gets a handful of figures and the rules it breaks.  Hosts
(``source``) add up the failures of each rule.  A host's raw rate means little
when the host is small, so it is shrunk towards the rate of all hosts by a beta
prior whose two parameters are fitted to the hosts by moments.

The rates are joined back to the documents.  A document that breaks a rule is
charged the rate of its host in parts of the rate of all hosts: about 1 where the host
is like the others, less where the host is cleaner, more where it is known
for such failures.  A document charged ``CHARGE`` or more over all rules is rejected,
so one failure is forgiven at a host that has few of them, two seldom are, and
documents that break no rule stay.  A host whose rate of some rule is above
``limit`` has next to nothing else and is rejected with all its documents.
Documents that break a base rule go in any case.

* NULL and empty texts have no word, so they fail the rule on few words.
* A NULL host is no host: its documents count in no rate and are charged 1 for
  each rule they break.
* The fit needs two hosts that differ by more than chance; without, every host
  is shrunk wholly to the common rate, which can reject no host that differs.
* Repeated rows count as often as they occur and get equal results.
* Columns of the same names in the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import query, table, words
from flowloom.operators.lineage import cut

WINDOW = 8
LEAST_WORDS = 20
LIMIT = 0.9
CHARGE = 0.75
# The strength of a prior, in documents, when hosts do not differ at all.
FIRM = 1e6

# What breaks a rule, in SQL over the figures.
RULES = {
    "few_words": f"n_words < {LEAST_WORDS}",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("few_words", "repeated_words")


def _bound(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``value`` computed once and called ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


# Positions of windows found twice or more: sort by hash, keep those that have an
# equal neighbour.  Each starts WINDOW words, of which the next start may take some.
_REPEATED = _bound(
    "sort_array(transform(__windows, (h, i) -> struct(h AS h, i AS i)))",
    "s",
    "sort_array(transform(filter(s, (x, k) -> coalesce(get(s, k - 1).h = x.h, false)"
    " OR coalesce(get(s, k + 1).h = x.h, false)), x -> x.i))",
)
_COVERED = _bound(
    _REPEATED,
    "p",
    f"aggregate(transform(p, (x, k) -> least({WINDOW}, coalesce(get(p, k + 1) - x, {WINDOW}))),"
    " 0L, (a, n) -> a + n)",
)


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines``
    and ``n_repeat_words``, all long.

    Windows are compared by a 64-bit hash of their words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.expr(
        f"CASE WHEN size(__words) >= {WINDOW} THEN transform(sequence(1, size(__words) - {WINDOW - 1}),"
        f" i -> xxhash64(slice(__words, i, {WINDOW}))) ELSE array() END"
    )
    return (
        docs.withColumns({"__words": words(text), "__lines": lines})
        .withColumns(
            {
                "n_words": F.size("__words").cast("long"),
                "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
                "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
                "n_lines": F.size("__lines").cast("long"),
                "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
                "__windows": windows,
            }
        )
        .withColumn(
            "n_repeat_words",
            F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.expr(_COVERED))
            .otherwise(F.lit(0))
            .cast("long"),
        )
        .drop("__words", "__lines", "__windows")
    )


def failures(df: DataFrame) -> DataFrame:
    """``df`` of ``figures`` with one boolean column per rule and ``base_failed``."""
    broken = {rule: F.expr(text) for rule, text in RULES.items()}
    base = F.lit(False)
    for rule in BASE:
        base = base | broken[rule]
    return df.withColumns({**broken, "base_failed": base})


def _prior(hosts: DataFrame, rule: str) -> tuple[float, float]:
    """Alpha and beta by moments, from one row of sums over the hosts."""
    n, k = F.col("n_docs"), F.col(rule)
    s = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum(n).alias("n"),
        F.sum(k).alias("k"),
        F.sum(1 / n).alias("inverse"),
        F.sum(k / n).alias("rates"),
        F.sum((k / n) * (k / n)).alias("squares"),
    ).first()
    if not s["hosts"]:
        return FIRM / 2, FIRM / 2
    # A mean of 0 or 1 would leave no room for doubt.
    mean = (s["k"] + 0.5) / (s["n"] + 1)
    own = s["rates"] / s["hosts"]
    spread = max(0.0, s["squares"] / s["hosts"] - own * own)
    chance = mean * (1 - mean)
    beyond = spread - chance * s["inverse"] / s["hosts"]
    strength = min(FIRM, max(1.0, (chance - spread) / beyond)) if beyond > 0 else FIRM
    return mean * strength, (1 - mean) * strength


def host_verdicts(judged: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``source``, ``n_docs``, the shrunk rate and the charge of every rule, and ``host_rejected``."""
    hosts = cut(
        judged.filter("source IS NOT NULL")
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            *[F.count_if(F.col(rule)).alias(rule) for rule in RULES],
        )
    )
    shrunk: dict[str, Column] = {}
    rejected = F.lit(False)
    for rule in RULES:
        a, b = _prior(hosts, rule)
        rate = (F.col(rule) + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))
        shrunk[f"{rule}_rate"] = rate
        shrunk[f"{rule}_charge"] = rate / F.lit(a / (a + b))
        rejected = rejected | (rate > limit)
    # Written, so that Spark knows its size: it is sent to all tasks if small, and
    # else shuffled, with the rows of large hosts split.
    return cut(
        hosts.select(
            "source", "n_docs", *[c.alias(n) for n, c in shrunk.items()],
            rejected.alias("host_rejected"),
        )
    )


def judge(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Every column of ``docs``, its figures, ``base_failed`` and ``kept``.

    The judged rows are written once: the rates need all of them before the
    first verdict can be given.
    """
    rows = cut(failures(figures(docs)))
    return _verdict(rows, limit).select(*rows.columns, "kept").drop(*RULES, "n_lines")


def _verdict(rows: DataFrame, limit: float) -> DataFrame:
    """Written ``rows`` of ``failures`` with ``kept``."""
    names = {f"{rule}_charge": f"__{rule}" for rule in RULES}
    hosts = host_verdicts(rows, limit).withColumnsRenamed(names).select(
        "source", "host_rejected", *names.values()
    )
    rejected = F.coalesce("host_rejected", F.lit(False))
    charge = F.lit(0.0)
    for rule in RULES:
        charge = charge + F.when(F.col(rule), F.coalesce(f"__{rule}", F.lit(1.0))).otherwise(0.0)
    kept = ~F.col("base_failed") & ~rejected & (charge < CHARGE)
    return rows.join(hosts, "source", "left").withColumn("kept", kept).drop(*names.values())


def keep_good(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    names = [f"__own_{c}" for c in docs.columns]
    # Own columns are set aside under other names, so that none is replaced.
    aside = docs.select(
        *[F.col(c).alias(n) for c, n in zip(docs.columns, names)], F.col("text"), F.col("source")
    )
    rows = cut(failures(figures(aside)).select(*names, "source", *RULES, "base_failed"))
    return _verdict(rows, limit).filter("kept").select(
        *[F.col(n).alias(c) for c, n in zip(docs.columns, names)]
    )


_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SQL = rf"""
WITH split AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS body, {_W} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS MATERIALIZED (
  SELECT r, x.i AS i, x.v AS v
  FROM (SELECT r, unnest(list_transform(generate_series(1, len(w) - {WINDOW - 1}),
          lambda i: {{'i': i, 'v': array_to_string(w[i:i + {WINDOW - 1}], ' ')}})) AS x FROM split)),
covered AS (
  SELECT r, count(DISTINCT i + d) AS n
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS seen FROM windows)
  CROSS JOIN range({WINDOW}) AS o(d) WHERE seen > 1 GROUP BY r),
f AS MATERIALIZED (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN covered USING (r)),
judged AS MATERIALIZED (
  SELECT *, n_words < {LEAST_WORDS} AS few_words,
         100 * n_repeat_words > 30 * n_words AS repeated_words,
         10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS repeated_lines
  FROM f),
hosts AS (
  SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE broken) AS k
  FROM (UNPIVOT (SELECT source, few_words, repeated_words, symbols, repeated_lines FROM judged
                 WHERE source IS NOT NULL)
        ON few_words, repeated_words, symbols, repeated_lines INTO NAME rule VALUE broken)
  GROUP BY ALL),
moments AS (
  SELECT rule, count(*) AS h, (sum(k) + 0.5::DOUBLE) / (sum(n) + 1) AS mean,
         avg(1::DOUBLE / n) AS inverse,
         greatest(0, avg((k::DOUBLE / n) ** 2) - avg(k::DOUBLE / n) ** 2) AS spread
  FROM hosts GROUP BY rule),
prior AS (
  SELECT rule, mean, CASE WHEN spread - mean * (1 - mean) * inverse > 0
    THEN least({FIRM}, greatest(1, (mean * (1 - mean) - spread)
                                   / (spread - mean * (1 - mean) * inverse)))
    ELSE {FIRM} END AS strength
  FROM moments),
rates AS (
  SELECT source, rule, (k + mean * strength) / (n + strength) AS rate, rate / mean AS charge
  FROM hosts JOIN prior USING (rule)),
verdicts AS (
  SELECT source, bool_or(rate > {LIMIT}) AS rejected, {", ".join(
    f"max(charge) FILTER (rule = '{rule}') AS c_{rule}" for rule in RULES)}
  FROM rates GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       few_words OR repeated_words AS base_failed,
       NOT (few_words OR repeated_words) AND NOT coalesce(rejected, false)
         AND {" + ".join(f"CASE WHEN {rule} THEN coalesce(c_{rule}, 1) ELSE 0 END" for rule in RULES)} < {CHARGE} AS kept
FROM judged LEFT JOIN verdicts USING (source)
"""


@query("op3_quality_rules", SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = cut(failures(figures(docs)).drop("text"))
    return _verdict(rows, LIMIT).select("doc_id", *names, "base_failed", "kept")
