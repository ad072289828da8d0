"""Reports over the log of operational events (id, created_at, event_type, detail as JSON), and sinks that append to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions.summaries import let
from storyloom.registry import register


def with_detail(events: DataFrame) -> DataFrame:
    """The derived events with a JSON detail, as the log holds it."""
    alerts = F.array(F.concat(F.lit("merged:"), F.col("k")), F.concat(F.lit("split:"), F.col("k") * 2))
    return events.withColumn("detail", F.to_json(F.struct(F.col("k").alias("calls"), F.col("value").alias("value"), alerts.alias("alerts"), F.create_map(F.concat(F.lit("r"), F.col("k") % 4), F.lit(1), F.lit("no_match"), F.col("k")).alias("reasons"), (F.col("user_id") % 10).alias("draft_id"))))


def event_alert_explode(events: DataFrame, prefix: str) -> DataFrame:
    """(id, value): the number after the prefix of every alert string that has it."""
    alerts = F.from_json(F.get_json_object("detail", "$.alerts"), "array<string>")
    return events.select("id", F.explode(alerts).alias("a")).where(F.col("a").startswith(prefix)).select("id", F.element_at(F.split("a", ":"), 2).cast("int").alias("value"))


register("event_alert_explode", "v_events", lambda e: event_alert_explode(with_detail(e.where("event_type = 'alert'")), "split:"), "SELECT id, CAST(k * 2 AS INT) AS value FROM v_events WHERE event_type = 'alert' AND k IS NOT NULL")


def with_desk_detail(events: DataFrame) -> DataFrame:
    """The derived events with a detail as the desk's runs write it: of gates, alerts and mails."""
    k = F.coalesce("k", F.lit(0))
    reasons = F.array(F.struct(F.array(F.concat(F.lit("r"), k % 4), F.lit("stale")).alias("reasons")), F.struct(F.array(F.lit("stale")).alias("reasons")))
    return events.withColumn("detail", F.to_json(F.struct(
        F.struct(k.alias("suggested"), (k % 3).alias("merged")).alias("topStoryPremerge"), (k % 5).alias("demoted"), F.lit(10).alias("checked"), (k % 7).alias("flagged"), reasons.alias("details"),
        F.array(F.concat(F.lit("top_story_duplicate_pairs:"), k), F.concat(F.lit("mixed_splits:"), k % 6)).alias("guardrailAlerts"), (k % 9).alias("mixedStoryOutliers"), (k % 6).alias("mixedStoriesSplit"), k.alias("mergedStories"),
        (F.col("id") % 2 == 0).alias("sent"), F.when(F.col("id") % 3 == 0, "top_story_duplicate_pairs").otherwise("mixed_splits").alias("alertType"),
    )))


def _number(path: str) -> Column:
    return F.coalesce(F.get_json_object("detail", path).cast("int"), F.lit(0))


def _alerts() -> Column:
    return F.coalesce(F.from_json(F.get_json_object("detail", "$.guardrailAlerts"), "array<string>"), F.array().cast("array<string>"))


def guardrail_health(events: DataFrame, at: str, hours: int = 24, alert: str = "top_story_duplicate_pairs") -> DataFrame:
    """One row on the last hours: gate runs, merges before the gate that were suggested and made, stories demoted, the last run; how often the
    alert was raised and with what sum, and how many mails on it were sent."""
    recent = events.where((F.col("created_at") >= F.expr(f"TIMESTAMP_NTZ '{at}' - INTERVAL {hours} HOURS")) & (F.col("created_at") < F.expr(f"TIMESTAMP_NTZ '{at}'")))
    kind = lambda t: F.col("event_type") == t
    total = lambda t, x: F.coalesce(F.sum(F.when(kind(t), x)), F.lit(0)).cast("long")
    raised = F.filter(_alerts(), lambda x: x.startswith(f"{alert}:"))
    pairs = F.aggregate(raised, F.lit(0), lambda s, x: s + F.coalesce(F.get(F.split(x, ":"), F.lit(1)).cast("int"), F.lit(0)))
    sent = kind("email") & F.coalesce(F.get_json_object("detail", "$.sent").cast("boolean"), F.lit(False)) & (F.get_json_object("detail", "$.alertType") == alert)
    return recent.agg(
        F.count_if(kind("gate")).alias("gate_runs"), total("gate", _number("$.topStoryPremerge.suggested")).alias("suggested"), total("gate", _number("$.topStoryPremerge.merged")).alias("merged"), total("gate", _number("$.demoted")).alias("demoted"),
        F.date_format(F.max(F.when(kind("gate"), F.col("created_at"))), "yyyy-MM-dd HH:mm:ss").alias("last_gate"), total("alert", F.size(raised)).alias("alerts"), total("alert", pairs).alias("pairs"), F.count_if(sent).alias("emails"),
    )


_AT = "2024-01-20 00:00:00"
register(
    "guardrail_health_24h", "v_events", lambda e: guardrail_health(with_desk_detail(e), _AT),
    f"""SELECT count(*) FILTER (WHERE event_type = 'gate') AS gate_runs, CAST(coalesce(sum(coalesce(k, 0)) FILTER (WHERE event_type = 'gate'), 0) AS BIGINT) AS suggested, CAST(coalesce(sum(coalesce(k, 0) % 3) FILTER (WHERE event_type = 'gate'), 0) AS BIGINT) AS merged,
    CAST(coalesce(sum(coalesce(k, 0) % 5) FILTER (WHERE event_type = 'gate'), 0) AS BIGINT) AS demoted, strftime(max(created_at) FILTER (WHERE event_type = 'gate'), '%Y-%m-%d %H:%M:%S') AS last_gate, count(*) FILTER (WHERE event_type = 'alert') AS alerts,
    CAST(coalesce(sum(coalesce(k, 0)) FILTER (WHERE event_type = 'alert'), 0) AS BIGINT) AS pairs, count(*) FILTER (WHERE event_type = 'email' AND id % 2 = 0 AND id % 3 = 0) AS emails
    FROM v_events WHERE created_at >= TIMESTAMP '{_AT}' - INTERVAL 24 HOURS AND created_at < TIMESTAMP '{_AT}'""",
)


def guardrail_alert_report(events: DataFrame, n: int = 20) -> DataFrame:
    """(kind, name, n): over the last n alerts and the last n gate runs their totals, each alert's text and each gate reason by how often."""
    last = lambda t: events.where(F.col("event_type") == t).orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    alerts, gates = last("alert"), last("gate")

    def totals(rows: DataFrame, kind: str, names: tuple[str, ...]) -> DataFrame:
        sums = rows.agg(F.count("*").alias("runs"), *(F.coalesce(F.sum(_number(f"$.{x}")), F.lit(0)).cast("long").alias(x) for x in names))
        return sums.select(F.explode(F.array(*(F.struct(F.lit(x).alias("name"), F.col(x).alias("n")) for x in ("runs", *names)))).alias("x")).select(F.lit(kind).alias("kind"), "x.name", "x.n")

    texts = alerts.select(F.lit("alert").alias("kind"), F.explode(_alerts()).alias("name"))
    reasons = gates.select(F.explode(F.from_json(F.get_json_object("detail", "$.details"), "array<struct<reasons:array<string>>>")).alias("d")).select(F.lit("reason").alias("kind"), F.explode("d.reasons").alias("name"))
    counted = texts.union(reasons).groupBy("kind", "name").agg(F.count("*").alias("n"))
    return counted.union(totals(alerts, "alert_total", ("mergedStories", "mixedStoryOutliers", "mixedStoriesSplit"))).union(totals(gates, "gate_total", ("checked", "flagged", "demoted")))


register(
    "guardrail_alert_report", "v_events", lambda e: guardrail_alert_report(with_desk_detail(e)),
    """WITH l AS (SELECT event_type, coalesce(k, 0) AS k FROM v_events WHERE event_type IN ('alert', 'gate') QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY created_at DESC, id DESC) <= 20),
    x AS (SELECT 'alert' AS kind, unnest([concat('top_story_duplicate_pairs:', k), concat('mixed_splits:', k % 6)]) AS name FROM l WHERE event_type = 'alert' UNION ALL SELECT 'reason', unnest([concat('r', k % 4), 'stale', 'stale']) FROM l WHERE event_type = 'gate'),
    a AS (SELECT count(*) AS runs, coalesce(sum(k), 0) AS merged, coalesce(sum(k % 9), 0) AS outliers, coalesce(sum(k % 6), 0) AS splits FROM l WHERE event_type = 'alert'), g AS (SELECT count(*) AS runs, 10 * count(*) AS checked, coalesce(sum(k % 7), 0) AS flagged, coalesce(sum(k % 5), 0) AS demoted FROM l WHERE event_type = 'gate')
    SELECT kind, name, count(*) AS n FROM x GROUP BY 1, 2 UNION ALL SELECT 'alert_total', unnest(['runs', 'mergedStories', 'mixedStoryOutliers', 'mixedStoriesSplit']), unnest([runs, merged, outliers, splits])::BIGINT FROM a
    UNION ALL SELECT 'gate_total', unnest(['runs', 'checked', 'flagged', 'demoted']), unnest([runs, checked, flagged, demoted])::BIGINT FROM g""",
)


def reason_totals(events: DataFrame, event_type: str, latest: int | None = 1) -> DataFrame:
    """(reason, n): the reason maps of the latest audit events, summed."""
    rows = events.where(F.col("event_type") == event_type)
    rows = rows if latest is None else rows.orderBy(F.desc("created_at"), F.desc("id")).limit(latest)
    return rows.select(F.explode(F.from_json(F.get_json_object("detail", "$.reasons"), "map<string,int>")).alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n"))


register(
    "single_source_reason_totals", "v_events", lambda e: reason_totals(with_detail(e), "gate", None),
    "SELECT reason, CAST(sum(n) AS BIGINT) AS n FROM (SELECT concat('r', k % 4) AS reason, 1 AS n FROM v_events WHERE event_type = 'gate' UNION ALL SELECT 'no_match', k FROM v_events WHERE event_type = 'gate') GROUP BY 1",
)


def usage_daily_total(events: DataFrame) -> DataFrame:
    """(day, calls): calls used each day; an event without a number is one call."""
    n = F.coalesce(F.get_json_object("detail", "$.calls").cast("int"), F.lit(1))
    return events.where("event_type = 'usage'").groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.sum(n).alias("calls"))


register("usage_daily_total", "v_events", lambda e: usage_daily_total(with_detail(e)), "SELECT strftime(created_at, '%Y-%m-%d') AS day, CAST(sum(coalesce(k, 1)) AS BIGINT) AS calls FROM v_events WHERE event_type = 'usage' GROUP BY 1")


def latest_event_by_key(events: DataFrame, event_type: str, key: str) -> DataFrame:
    """The latest event of a type for each value of a JSON key."""
    rows = events.where(F.col("event_type") == event_type).withColumn("key", F.get_json_object("detail", f"$.{key}"))
    return rows.where("key is not null").groupBy("key").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


register("latest_event_by_key", "v_events", lambda e: latest_event_by_key(with_detail(e), "menu", "draft_id"), "SELECT CAST(user_id % 10 AS VARCHAR) AS key, arg_max(id, struct_pack(t := created_at, i := id)) AS id FROM v_events WHERE event_type = 'menu' GROUP BY 1")


def newsletter_draft_state(events: DataFrame, event_type: str = "menu") -> DataFrame:
    """(draft_id, place, id): the rows of each draft's latest three events, places numbered anew."""
    rows = events.where(F.col("event_type") == event_type).select(F.get_json_object("detail", "$.draft_id").cast("int").alias("draft_id"), "id", "created_at")
    r = F.row_number().over(Window.partitionBy("draft_id").orderBy(F.desc("created_at"), F.desc("id")))
    return rows.withColumn("place", r).where("place <= 3").select("draft_id", "place", "id")


register("newsletter_draft_state", "v_events", lambda e: newsletter_draft_state(with_detail(e)), "SELECT CAST(user_id % 10 AS INT) AS draft_id, CAST(row_number() OVER (PARTITION BY user_id % 10 ORDER BY created_at DESC, id DESC) AS INT) AS place, id FROM v_events WHERE event_type = 'menu' QUALIFY place <= 3")


def gate_reason_merge(details: DataFrame) -> DataFrame:
    """(story_id, rank, state_n, reasons) from the details of several gate passes: least rank, largest counter, all reasons once."""
    return details.groupBy("story_id").agg(F.min("rank").alias("rank"), F.max("state_n").alias("state_n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))), ",").alias("reasons"))


register(
    "gate_reason_merge", "v_events", lambda e: gate_reason_merge(e.select(F.col("user_id").alias("story_id"), F.col("k").alias("rank"), (F.col("k") % 7).alias("state_n"), F.array("event_type", F.concat(F.lit("r"), F.col("k") % 3)).alias("reasons"))),
    "SELECT user_id AS story_id, min(k) AS rank, max(k % 7) AS state_n, array_to_string(list_sort(list_distinct(flatten(list([event_type, concat('r', k % 3)])))), ',') AS reasons FROM v_events GROUP BY 1",
)


def grouping_alerts(counters: DataFrame, limits: dict[str, int]) -> DataFrame:
    """counters with the list of those past their limits, as `name:value`."""
    parts = (F.when(F.col(c) > n, F.concat_ws(":", F.lit(c), F.col(c).cast("string"))) for c, n in limits.items())
    return counters.withColumn("alerts", F.array_compact(F.array(*parts)))


register(
    "grouping_alerts", "v_events", lambda e: grouping_alerts(e.select("id", F.col("k").alias("merged"), (F.col("k") % 9).alias("split")), {"merged": 40, "split": 5}).select("id", F.array_join("alerts", ",").alias("alerts")),
    "SELECT id, concat_ws(',', CASE WHEN k > 40 THEN concat('merged:', k) END, CASE WHEN k % 9 > 5 THEN concat('split:', k % 9) END) AS alerts FROM v_events",
)


def event_append(rows: DataFrame, event_type: str, path: str) -> None:
    """Appends rows as events, one partition folder a day. rows: (created_at, ...), the other columns become the detail."""
    detail = F.to_json(F.struct(*(c for c in rows.columns if c != "created_at")))
    out = rows.select(F.expr("uuid()").alias("id"), F.lit(event_type).alias("event_type"), detail.alias("detail"), "created_at", F.to_date("created_at").alias("event_date"))
    out.write.mode("append").partitionBy("event_date").parquet(path)


def _appended(e: DataFrame) -> DataFrame:
    """Usage and gate events appended to one log, read back and counted by day."""
    from storyloom.streaming.jobs import folder

    path = f"{folder(e.sparkSession)}/log"
    for kind in ("usage", "gate"):
        event_append(e.where(F.col("event_type") == kind).select("created_at", "k", "value"), kind, path)
    back = e.sparkSession.read.parquet(path)
    return back.groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("detail", "$.k").cast("long")).alias("k"))


register("event_append", "v_events", _appended, "SELECT strftime(created_at, '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM v_events WHERE event_type IN ('usage', 'gate') GROUP BY 1, 2")


def menu_snapshot(menu: DataFrame, events: DataFrame) -> DataFrame:
    """(menu_id, detail): menus (menu_id, rank, story_id, title) that the log does not hold yet, each as one JSON list by rank."""
    new = menu.join(events.select("menu_id").distinct(), "menu_id", "left_anti")
    rows = new.groupBy("menu_id").agg(F.array_sort(F.collect_list(F.struct("rank", "story_id"))).alias("s"))
    return rows.select("menu_id", F.to_json("s").alias("detail"))


register(
    "menu_snapshot", "orders events",
    lambda o, e: menu_snapshot(o.select(F.col("o_custkey").alias("menu_id"), F.col("o_orderkey").alias("rank"), F.col("o_orderkey").alias("story_id")), e.select((F.col("user_id") * 2).alias("menu_id"))),
    "SELECT o_custkey AS menu_id, CAST(to_json(list(struct_pack(rank := o_orderkey, story_id := o_orderkey) ORDER BY o_orderkey)) AS VARCHAR) AS detail FROM orders WHERE o_custkey NOT IN (SELECT user_id * 2 FROM events) GROUP BY 1",
)


def response_parse(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model responses (id, body) -> typed verdicts (id, relevant, score), and the rows without a well-formed one."""
    inner = F.regexp_extract(F.regexp_replace("body", "```(json)?", ""), r"(?s)\{.*\}", 0)
    parsed = responses.withColumn("v", F.from_json(F.nullif(inner, F.lit("")), "relevant boolean, score double"))
    ok = F.col("v").isNotNull() & F.col("v.score").isNotNull()
    return parsed.where(ok).select("id", "v.relevant", "v.score"), parsed.where(~ok).select("id", "body")


def _responses(e: DataFrame) -> DataFrame:
    body = F.when(F.col("k") % 4 == 0, F.lit("no json here")).when(F.col("k") % 4 == 1, F.concat(F.lit("```json\n{\"relevant\": true, \"score\": "), F.col("k") / 100, F.lit("}\n```"))).otherwise(F.concat(F.lit("Answer: {\"relevant\": false, \"score\": "), F.col("k") / 100, F.lit("} done")))
    return e.where("k is not null").select("id", body.alias("body"))


register("response_parse", "v_events", lambda e: response_parse(_responses(e))[0].select("id", "relevant", F.round("score", 4).alias("score")), "SELECT id, k % 4 = 1 AS relevant, round(k / 100, 4) AS score FROM v_events WHERE k % 4 <> 0")


def parse_blurb(body: Column) -> Column:
    """A model's answer as (headline, summary): from JSON, from labelled lines, or from the first line or sentence; null if it has not both."""
    fenced = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(body, F.lit(""))), r"(?i)^```(json|text|markdown)?", ""), r"```$", "")
    squeeze = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\*\*", ""), r"\s+", " "))
    full = lambda h, s: (F.length(h) > 0) & (F.length(s) > 0)

    def parts(t: Column) -> Column:
        made = F.from_json(F.regexp_extract(t, r"(?s)\{.*\}", 0), "headline string, summary string")
        a, b = squeeze(F.coalesce(made["headline"], F.lit(""))), squeeze(F.coalesce(made["summary"], F.lit("")))
        label = r"^\s*(?:[-*]\s+)?(?:\*\*)?(?:%s)\s*:"
        field = lambda names: squeeze(F.regexp_extract(t, rf"(?ims){label % names}(.*?)(?={label % 'headline|title|summary|blurb'}|\z)", 1))
        h, s = field("headline|title"), field("summary|blurb")
        lines = F.filter(F.transform(F.split(t, "\n"), squeeze), lambda x: x != "")
        rest = squeeze(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), " "))
        sentences = F.split(lines[0], r"(?<=[.!?])\s+")
        loose_h = F.when(F.size(lines) >= 2, lines[0]).otherwise(sentences[0])
        loose_s = F.when(F.size(lines) >= 2, rest).when(F.size(sentences) >= 2, lines[0]).otherwise("")
        hh, ss = F.coalesce(F.nullif(h, F.lit("")), loose_h), F.coalesce(F.nullif(s, F.lit("")), loose_s)
        pair = lambda x, y: F.struct(F.substring(x, 1, 140).alias("headline"), F.substring(y, 1, 500).alias("summary"))
        usable = (t != "") & (F.upper(t) != "UNUSABLE")
        return F.when(usable & full(a, b), pair(a, b)).when(usable & full(hh, ss), pair(hh, ss))

    return let(F.trim(fenced), parts)
