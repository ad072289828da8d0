"""Quality rules with host verdicts, in DataFrame functions only.

Each text is counted once: words, their characters, symbols, lines, repeated lines and words in repeated windows of eight. Rules on these
counts fail single documents: too few words, too many repeated words, too many symbols, too many repeated lines, and any of these. Failures
are then summed by host (the column `source`) and rule; for each rule a beta prior fitted to all hosts by moments shrinks each host's rate,
so that small hosts lean to the corpus. Documents of hosts with a shrunk rate too high for some rule go with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import documents, stash

WINDOW = 8
#: The rules that fail a document; the first two are the base rules. A host goes if its shrunk rate of failures of one rule is above HOST_RATE.
RULES = {
    "few_words": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}
ANY = "any_rule"
HOST_RATE = 0.6
#: Hosts up to this number are sent to every task with their verdict; beyond it they are joined by a salted shuffle.
BROADCAST_HOSTS, SALTS = 10_000, 32
WHITE = " \t\n\x0b\x0c\r"


def with_counts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) for each row. Null texts count as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, WHITE, "") != "")
    rows = rows.select("doc_id", "host", "text", words.alias("words"), lines.alias("lines"))
    # Windows by their hash of 64 bits: one number for each place where a window starts.
    starts = F.when(F.size("words") > WINDOW, F.expr(f"transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW})))"))
    rows = rows.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), starts.alias("h"),
    )
    # Only where some window repeats: (hash, place) in order, then the places whose hash is that of a neighbour.
    rows = rows.withColumn("p", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.expr("sort_array(transform(h, (x, i) -> struct(x as x, i as i)))"))).drop("h")
    again = F.expr("sort_array(transform(filter(p, (e, j) -> e.x <=> get(p, j - 1).x or e.x <=> get(p, j + 1).x), e -> e.i))")
    rows = rows.withColumn("at", F.when(F.col("p").isNotNull(), again)).drop("p")
    # A window covers its words up to where the next repeated one starts.
    covered = F.expr(f"aggregate(transform(at, (i, j) -> least({WINDOW}, coalesce(get(at, j + 1) - i, {WINDOW}))), 0L, (s, x) -> s + x)")
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("at")


def base_failed() -> Column:
    return F.expr(f"{RULES['few_words']} or {RULES['repeats']}")


def rule_rates(counted: DataFrame) -> DataFrame:
    """(host, rule, n_docs, n_failed, rate): failures by host and rule, shrunk by the beta prior that fits all hosts' rates of that rule.

    The prior has the corpus's mean; its strength follows from how much the hosts' rates differ beyond chance. Hosts that differ by no
    more than chance all take the mean. One aggregate of the documents; the rest works on a row for each host and rule.
    """
    rules = {**RULES, ANY: " or ".join(f"({r})" for r in RULES.values())}
    hosts = counted.groupBy("host").agg(F.count("*").alias("n_docs"), *(F.count_if(F.expr(r)).alias(f"f_{name}") for name, r in rules.items()))
    hosts = stash(hosts.select("host", "n_docs", F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"f_{name}").alias("n_failed")) for name in rules))).alias("r")).select("host", "n_docs", "r.*"))
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    all_hosts = hosts.groupBy("rule").agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.count("*").alias("k"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ff"))
    mean = F.col("f") / F.col("n")
    spread = mean * (1 - mean)
    excess = (F.col("ff") - mean * mean * F.col("n") - (F.col("k") - 1) * spread) / F.greatest(F.col("n") - F.col("nn") / F.col("n"), F.lit(1e-9))
    strength = F.when((F.col("k") > 1) & (excess > 1e-12), F.greatest(F.lit(1.0), spread / excess - 1)).otherwise(1e12)
    prior = all_hosts.select("rule", mean.alias("mean"), strength.alias("strength"))  # a row for each rule
    rate = (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return hosts.join(F.broadcast(prior), "rule").select("host", "rule", "n_docs", "n_failed", rate.alias("rate"))


def host_verdicts(counted: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """(host, rate, rule, host_failed): each host's largest shrunk rate, and its worst single rule (the first by name of equal ones)."""
    by_name = F.expr("transform(split(rule, ''), x -> -ascii(x))")
    worst = F.max_by("rule", F.when(F.col("rule") != ANY, F.struct(F.round("rate", 9).alias("rate"), by_name.alias("name"))))
    return rule_rates(counted).groupBy("host").agg(F.max("rate").alias("rate"), worst.alias("rule")).withColumn("host_failed", F.col("rate") > host_rate)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """(doc_id, host, counts, base_failed, kept, host_rate, host_rule) for each row: the host's largest shrunk rate and worst rule.

    A null host is a host of its own. Repeated rows count and are judged each. An empty table gives an empty result; columns beside the
    three named ones are left out.
    """
    counted = stash(with_counts(docs, id_col, text_col, host_col).withColumn("base_failed", base_failed()))
    verdicts = stash(host_verdicts(counted, host_rate)).select(F.col("host").alias("of"), F.col("rate").alias("host_rate"), F.col("rule").alias("host_rule"), "host_failed")
    if verdicts.count() <= BROADCAST_HOSTS:
        joined = counted.join(F.broadcast(verdicts), F.col("host").eqNullSafe(F.col("of")), "left")
    else:
        salted = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = counted.withColumn("row_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, F.col("host").eqNullSafe(F.col("of")) & (F.col("row_salt") == F.col("salt")), "left")
    kept = ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))
    return joined.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_rate", "host_rule")


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"), "host_rule")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, source, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines FROM d),
p AS (SELECT rid, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
g AS (SELECT rid, i, array_to_string(words[i:i+7], ' ') AS win FROM p),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1),
v AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
c AS (SELECT w.rid, doc_id, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(v.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN v ON v.rid = w.rid),
b AS (SELECT *, n_words < 20 AS r1, 100 * n_repeat_words > 30 * n_words AS r2, 10 * n_symbols > n_words AS r3, 10 * n_dup_lines > 3 * n_lines AS r4 FROM c),
h AS (SELECT source, count(*)::DOUBLE AS n, unnest([{'rule': 'few_words', 'f': count(*) FILTER (WHERE r1)::DOUBLE}, {'rule': 'repeats', 'f': count(*) FILTER (WHERE r2)::DOUBLE}, {'rule': 'symbols', 'f': count(*) FILTER (WHERE r3)::DOUBLE},
  {'rule': 'dup_lines', 'f': count(*) FILTER (WHERE r4)::DOUBLE}, {'rule': 'any_rule', 'f': count(*) FILTER (WHERE r1 OR r2 OR r3 OR r4)::DOUBLE}], recursive := true) FROM b GROUP BY source),
t AS (SELECT rule, sum(f) / sum(n) AS m, sum(n) AS n, count(*) AS k, sum(n * n) AS nn, sum(f * f / n) AS ff FROM h GROUP BY rule),
e AS (SELECT rule, m, k, (ff - m * m * n - (k - 1) * m * (1 - m)) / greatest(n - nn / n, 1e-9) AS excess FROM t),
s AS (SELECT rule, m, CASE WHEN k > 1 AND excess > 1e-12 THEN greatest(1.0, m * (1 - m) / excess - 1) ELSE 1e12 END AS a FROM e),
y AS (SELECT source, rule, (f + m * a) / (n + a) AS rate FROM h JOIN s USING (rule)),
z AS (SELECT source, max(rate) AS rate, first(rule ORDER BY round(rate, 9) DESC, rule) FILTER (WHERE rule <> 'any_rule') AS rule FROM y GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 OR r2 AS base_failed, NOT (r1 OR r2) AND rate <= 0.6 AS kept, round(rate, 6) AS host_rate, rule AS host_rule
FROM b JOIN z ON b.source IS NOT DISTINCT FROM z.source
"""
