"""Scores of stories: types, the homepage and weekly scores, summary candidates and their adjudication. Projections over rolled-up rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions import lexicons as L
from storyloom.functions.summaries import display_summary, fallback_summary, headline_echo, let, low_quality, sanitized, sql_display, sql_fallback, sql_headline_echo, sql_low_quality, sql_sanitized, sql_synthetic, synthetic
from storyloom.functions.text import hits, sql_hits
from storyloom.operators.filters import DATA_AUDIENCE, SERVABLE_SQL, audiences, servable, sql_audience
from storyloom.operators.graphs import stored
from storyloom.operators.rollups import story_latest_summary, story_latest_summary_windowed, story_rollup
from storyloom.registry import register
from storyloom.sources.views import AS_OF

DEFAULT = {"impact": L.IMPACT, "urgency": L.URGENCY, "novelty": L.NOVELTY, "relevance": L.RELEVANCE, "policy": L.POLICY, "breaking": L.BREAKING, "opinion": L.OPINION, "evergreen": L.EVERGREEN, "instructional": L.INSTRUCTIONAL}


def lexicon_hits(t: Column, lexicon: dict) -> dict[str, Column]:
    limits = {"impact": 3, "urgency": 3, "novelty": 3, "relevance": 3, "policy": 3}
    return {f"n_{k}": hits(t, v, limits.get(k, 9)) for k, v in lexicon.items()}


def story_type(weak: Column, novelty: Column) -> Column:
    """Opinion before breaking, policy, evergreen and feature. Reads the n_ columns."""
    c = F.col
    taught = (c("n_instructional") > 0) & (((c("n_policy") == 0) & (c("n_urgency") == 0) & (c("n_impact") == 0) & (novelty == 0)) | weak)
    return F.when(c("n_opinion") > 0, "opinion").when(c("n_breaking") > 0, "breaking").when(c("n_policy") > 0, "policy").when((c("n_evergreen") > 0) | taught, "evergreen").otherwise("feature")


#: Weights and penalties of the two scores; fixed values.
HOMEPAGE = {"impact": 2.2, "urgency": 1.8, "novelty": 1.0, "relevance": 1.3, "policy": 0.0, "volume": 0.9, "family": 1.35, "source": 0.35, "recency": 1.1, "half": 30, "weak": 18, "urgent": 6, "evergreen": 0.35, "singleton": 0.75, "single": (0.74, 0.58), "thin": 0.72, "hard": (0.6, 0.45), "momentum": (0.25, 0.08)}
WEEKLY = {"impact": 2.6, "urgency": 1.2, "novelty": 0.0, "relevance": 1.2, "policy": 1.6, "volume": 0.9, "family": 1.65, "source": 0.3, "recency": 0.9, "half": 96, "weak": 48, "urgent": 24, "evergreen": 0.45, "singleton": 0.82, "single": (0.78, 0.68), "thin": 0.78, "hard": (0.72, 0.58), "momentum": (0.18, 0.05)}


def _common(rolled: DataFrame, as_of: str, lexicon: dict, w: dict, weekly: bool) -> DataFrame:
    """rolled (id, title, summary, article_count, source_count, family_count, recent_count, avg_weight, latest_at) with all parts of a score."""
    c = F.col
    t = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    out = rolled.withColumns(lexicon_hits(t, lexicon))
    out = out.withColumn("independent", F.when(F.coalesce("family_count", F.lit(0)) > 0, c("family_count")).otherwise(F.coalesce("source_count", F.lit(0))))
    out = out.withColumn("hours", (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(c("latest_at").cast("timestamp"))) / F.lit(3600.0))
    out = out.withColumn("weak", (c("hours") > w["weak"]) & (c("independent") <= 1) & (c("recent_count") <= 1))
    out = out.withColumn("story_type", story_type(c("weak"), F.lit(0) if weekly else c("n_novelty")))
    out = out.withColumn("urgent", (c("n_urgency") > 0) & ((c("hours") <= w["urgent"]) | (c("recent_count") >= 2)))
    base = F.greatest(F.lit(0.45), F.least(F.lit(1.5), c("avg_weight")))
    out = out.withColumn("authority", F.greatest(F.lit(0.3), F.least(F.lit(2.2), F.pow(base, F.lit(3.0)))))
    lone = (c("independent") <= 1) & (c("recent_count") <= 1) & (c("article_count") <= 1)
    out = out.withColumn("low_single", lone & (c("authority") < 1))
    important = (c("independent") <= 1) & (((c("story_type") == "breaking") & c("urgent") & (c("authority") >= 1) & ((c("n_urgency") >= 2) | (c("n_impact") >= 2))) | ((c("n_policy") >= 2) & (c("n_impact") >= 2) & (c("authority") >= 1.2) & (c("recent_count") >= 1)))
    soft = (c("n_impact") == 0) & (c("n_policy") == 0) if weekly else (c("n_urgency") + F.least(c("n_policy"), F.lit(1))) == 0
    out = out.withColumn("low_news", (c("story_type") == "feature") & ~c("urgent") & soft & (c("independent") <= 2) & (c("recent_count") <= 1))
    by_authority = lambda pair: F.when(c("authority") >= 1, pair[0]).otherwise(pair[1])
    return out.withColumns({
        "evergreen_penalty": F.when((c("story_type") == "evergreen") & ~c("urgent"), w["evergreen"]).otherwise(1.0),
        "singleton_penalty": F.when(~c("urgent") & c("low_single"), w["singleton"]).otherwise(1.0),
        "single_source_penalty": F.when(~c("urgent") & (c("independent") <= 1) & (c("story_type") != "breaking") & ~important, by_authority(w["single"])).otherwise(1.0),
        "thin_penalty": F.when(~c("urgent") & (c("story_type") != "breaking") & lone, w["thin"]).otherwise(1.0),
        "hard_news_penalty": F.when(c("low_news"), by_authority(w["hard"])).otherwise(1.0),
        "momentum": F.lit(1.0) + F.least(F.lit(w["momentum"][0]), F.greatest(F.lit(0), c("recent_count") - 1) * w["momentum"][1]),
        "sum": w["impact"] * c("n_impact") + w["urgency"] * c("n_urgency") + w["novelty"] * c("n_novelty") + w["relevance"] * c("n_relevance") + w["policy"] * c("n_policy") + w["volume"] * F.log1p(c("article_count"))
        + w["family"] * F.log1p(F.greatest(F.lit(0), c("independent"))) + w["source"] * F.log1p(F.greatest(F.lit(0), F.coalesce("source_count", F.lit(0)))) + w["recency"] * F.exp(-c("hours") / w["half"]),
    })


_FACTORS = ("authority", "evergreen_penalty", "singleton_penalty", "single_source_penalty", "thin_penalty", "hard_news_penalty", "momentum")


def _product(first: Column) -> Column:
    for f in _FACTORS:
        first = first * F.col(f)
    return first


def story_ranking(rolled: DataFrame, as_of: str = AS_OF, lexicon: dict = DEFAULT) -> DataFrame:
    """Homepage score, story type, and whether a story may lead, with the reason if not."""
    out = _common(rolled, as_of, lexicon, HOMEPAGE, False)
    why = F.when((F.col("story_type") == "evergreen") & ~F.col("urgent"), "evergreen_instructional").when((F.col("story_type") == "opinion") & ~F.col("urgent"), "opinion_demoted").when(F.col("low_single") & ~F.col("urgent"), "single_low_authority_source").when(F.col("low_news"), "low_newsworthiness_feature")
    return out.withColumns({"score": F.round(_product(F.col("sum")), 2), "lead_reason": why, "lead_eligible": why.isNull()})


def newsletter_ranking(rolled: DataFrame, as_of: str = AS_OF, lexicon: dict = DEFAULT, audience: dict | None = None) -> DataFrame:
    """Weekly score and up to three reasons in order."""
    c = F.col
    out = _common(rolled, as_of, lexicon, WEEKLY, True).withColumn("who", audiences(F.concat_ws(" ", "title", "summary"), audience))
    fit = lambda a: F.array_contains("who", a)
    operator = F.least(F.lit(1.2), fit("admins").cast("int") * 0.75 + fit("teachers").cast("int") * 0.35 + fit("edtech").cast("int") * 0.35)
    boost = F.when(c("independent") >= 4, 1.6).when(c("independent") == 3, 1.42).when(c("independent") == 2, 1.24).otherwise(1.0)
    reasons = F.array_compact(F.array(
        F.when(c("n_impact") >= 2, "high_impact"), F.when(c("n_policy") > 0, "policy"), F.when((c("n_urgency") > 0) & ((c("hours") <= 72) | (c("recent_count") >= 2)), "urgent"),
        F.when((c("independent") >= 2) | (c("source_count") >= 2), "multi_source"), F.when(fit("admins") & ((c("n_impact") > 0) | (c("n_policy") > 0)), "district_impact"), F.when(fit("teachers") & ~fit("admins"), "classroom_relevance"),
        F.when(fit("edtech"), "edtech"), F.when((c("recent_count") >= 3) | (c("article_count") >= 4), "momentum"),
    ))
    return out.withColumns({"score": F.round(_product(c("sum") + operator) * boost, 2), "why": F.when(F.size(reasons) == 0, F.array(F.lit("high_impact"))).otherwise(F.slice(reasons, 1, 3))})


# --- stories with their rollup and preview ------------------------------------------------------------------------------------------

#: A stored preview counts from this confidence on.
MIN_CONFIDENCE = 0.58


def resolved_previews(stories: DataFrame) -> DataFrame:
    """stories with auto_summary, preview_type, preview_confidence, summary (the editor's, else the automatic one) and preview_factor.

    A stored preview decides if there is one (a headline without text, confidence and reason is none); else the story's own summary or its
    newest article's counts half. Reads preview_text, preview_type, preview_confidence, preview_reason, editor_summary, summary and
    latest_summary. A story without summary loses a tenth of its score, one with a doubtful one four hundredths.
    """
    c = F.col
    text, kind, sure = display_summary(c("preview_text")), F.lower(F.coalesce("preview_type", F.lit(""))), F.coalesce("preview_confidence", F.lit(0.0))
    rows = stories.withColumns({"_text": text, "_editor": display_summary(c("editor_summary")), "_own": F.coalesce(display_summary(c("summary")), display_summary(c("latest_summary"))), "_sure": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)), 2)})
    empty = (kind == "headline_only") & c("_text").isNull() & (c("_sure") == 0) & (F.trim(F.coalesce("preview_reason", F.lit(""))) == "")
    stored_one = kind.isin("full", "excerpt", "headline_only") & ~empty
    used = stored_one & kind.isin("full", "excerpt") & c("_text").isNotNull() & (c("_sure") >= MIN_CONFIDENCE)
    rows = rows.withColumns({"auto_summary": F.when(used, c("_text")).when(~stored_one, c("_own")), "_kind": F.when(used, kind).when(~stored_one & c("_own").isNotNull(), "excerpt").otherwise("headline_only"), "_conf": F.when(stored_one, c("_sure")).otherwise(F.when(c("_own").isNotNull(), 0.5).otherwise(0.0))})
    factor = F.when(c("_editor").isNotNull(), 1.0).when(c("auto_summary").isNull(), 0.9).when(c("_conf") < MIN_CONFIDENCE + 0.08, 0.96).otherwise(1.0)
    rows = rows.withColumns({"preview_factor": factor, "preview_type": F.when(c("_editor").isNotNull(), "full").otherwise(c("_kind")), "preview_confidence": F.when(c("_editor").isNotNull(), 1.0).otherwise(c("_conf")), "summary": F.coalesce("_editor", "auto_summary"), "editor_summary": c("_editor")})
    return rows.drop("_text", "_editor", "_own", "_sure", "_kind", "_conf")


def board(stories: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame, at: str = AS_OF, recent_hours: int = 24, days: int | None = None, k: int | None = None) -> DataFrame:
    """Stories with servable articles: their rollup, title and preview as shown; of the newest k, or of the last days, if given."""
    good = articles.where(servable())
    rows = links.select("story_id", "article_id").join(good.select(F.col("id").alias("article_id"), "source_id", "url", "ts"), "article_id")
    roll = story_rollup(rows, sources, at, recent_hours, days, k).withColumnRenamed("story_id", "id")
    if k is not None:  # few stories: only their articles' texts are read on
        roll = stored(roll)
        links = links.join(roll.select(F.col("id").alias("story_id")), "story_id", "left_semi")
    latest = story_latest_summary(links, good) if days is None else story_latest_summary_windowed(links, good, at, days)
    out = stories.drop("article_count").join(roll, "id").join(latest.select(F.col("story_id").alias("id"), F.col("summary").alias("latest_summary")), "id", "left")
    return resolved_previews(out).drop("latest_summary").withColumn("title", F.coalesce(F.nullif(F.trim("editor_title"), F.lit("")), F.col("title")))


def board_sql(recent_hours: int = 24, days: int | None = None) -> str:
    """Common table expressions that end in r: the rows of board()."""
    window = "" if days is None else f" AND a.ts >= TIMESTAMP '{AS_OF}' - INTERVAL {24 * days} HOURS"
    order = "struct_pack(ts := a.ts, id := a.id)" if days is None else "struct_pack(p := is_primary, ts := a.ts, id := a.id)"
    fam = "array_to_string(string_split(domain, '.')[CASE WHEN domain LIKE '%.co.uk' THEN -3 ELSE -2 END:], '.')"
    raw = "(SELECT id, 'e' AS kind, editor_summary AS raw FROM v_stories UNION ALL SELECT id, 'p', preview_text FROM v_stories UNION ALL SELECT id, 's', summary FROM v_stories UNION ALL SELECT story_id, 'l', summary FROM lt)"
    return f"""WITH ga AS (SELECT * FROM v_articles WHERE {SERVABLE_SQL}), ro AS (SELECT story_id, count(*) AS article_count, count(DISTINCT domain) AS source_count, count(DISTINCT {fam}) AS family_count,
      count(*) FILTER (WHERE a.ts >= TIMESTAMP '{AS_OF}' - INTERVAL {recent_hours} HOURS) AS recent_count, round(avg(coalesce(weight, 1.0)), 6) AS avg_weight, max(a.ts) AS latest_at FROM v_links l JOIN ga a ON a.id = l.article_id{window} LEFT JOIN v_sources c ON c.id = a.source_id GROUP BY 1),
    lt AS (SELECT story_id, arg_max(summary, {order}) AS summary FROM v_links l JOIN ga a ON a.id = l.article_id WHERE trim(summary) <> ''{window} GROUP BY 1), {sql_display(raw)},
    pv AS (SELECT v.id, max(clean) FILTER (WHERE kind = 'e') AS ed, max(clean) FILTER (WHERE kind = 'p') AS tx, coalesce(max(clean) FILTER (WHERE kind = 's'), max(clean) FILTER (WHERE kind = 'l')) AS own FROM v_stories v JOIN dz ON dz.id = v.id GROUP BY 1),
    pw AS (SELECT v.*, pv.ed, pv.tx, pv.own, round(coalesce(v.preview_confidence, 0), 2) AS sure, v.preview_type IS NOT NULL AND NOT (v.preview_type = 'headline_only' AND tx IS NULL AND round(coalesce(v.preview_confidence, 0), 2) = 0 AND trim(coalesce(v.preview_reason, '')) = '') AS st FROM v_stories v JOIN pv USING (id)),
    py AS (SELECT *, st AND preview_type IN ('full', 'excerpt') AND tx IS NOT NULL AND sure >= {MIN_CONFIDENCE} AS used FROM pw), pz AS (SELECT *, CASE WHEN used THEN tx WHEN NOT st THEN own END AS auto_summary, CASE WHEN st THEN sure WHEN own IS NOT NULL THEN 0.5 ELSE 0 END AS conf FROM py),
    r AS (SELECT z.id, coalesce(nullif(trim(editor_title), ''), title) AS title, coalesce(ed, auto_summary) AS summary, ed AS editor_summary, auto_summary, CASE WHEN ed IS NOT NULL THEN 'full' WHEN used THEN preview_type WHEN NOT st AND own IS NOT NULL THEN 'excerpt' ELSE 'headline_only' END AS preview_type,
      CASE WHEN ed IS NOT NULL THEN 1.0::DOUBLE WHEN auto_summary IS NULL THEN 0.9::DOUBLE WHEN conf < {MIN_CONFIDENCE + 0.08} THEN 0.96::DOUBLE ELSE 1.0::DOUBLE END AS preview_factor, ro.* EXCLUDE story_id, status, homepage_rank, first_seen FROM pz z JOIN ro ON ro.story_id = z.id)"""


BOARD = "v_stories v_links v_articles v_sources"


def _score_sql(w: dict, weekly: bool) -> str:
    x = L.DATA
    h = {k: sql_hits("concat_ws(' ', title, summary)", x[k], 3 if k in ("impact", "urgency", "novelty", "relevance", "policy") else 9) for k in DEFAULT}
    cols = ", ".join(f"{v} AS n_{k}" for k, v in h.items())
    a = sql_audience("concat_ws(' ', title, summary)")
    soft = "n_impact = 0 AND n_policy = 0" if weekly else "n_urgency + least(n_policy, 1) = 0"
    novelty = "0" if weekly else "n_novelty"
    return f"""{board_sql(72, 14) if weekly else board_sql()}, h AS (SELECT *, {cols}, CASE WHEN family_count > 0 THEN family_count ELSE source_count END AS ind, date_diff('second', latest_at, TIMESTAMP '{AS_OF}') / 3600.0::DOUBLE AS hours,
      greatest(0.3, least(2.2, pow(greatest(0.45, least(1.5, avg_weight)), 3))) AS authority, {a['admins']} AS f_admins, {a['teachers']} AS f_teachers, {a['edtech']} AS f_edtech FROM r),
    k AS (SELECT *, hours > {w['weak']} AND ind <= 1 AND recent_count <= 1 AS weak, n_urgency > 0 AND (hours <= {w['urgent']} OR recent_count >= 2) AS urgent, ind <= 1 AND recent_count <= 1 AND article_count <= 1 AS lone FROM h),
    t AS (SELECT *, CASE WHEN n_opinion > 0 THEN 'opinion' WHEN n_breaking > 0 THEN 'breaking' WHEN n_policy > 0 THEN 'policy' WHEN n_evergreen > 0 OR (n_instructional > 0 AND n_policy = 0 AND n_urgency = 0 AND n_impact = 0 AND {novelty} = 0) OR (n_instructional > 0 AND weak) THEN 'evergreen' ELSE 'feature' END AS story_type,
      lone AND authority < 1 AS low_single FROM k),
    n AS (SELECT *, story_type = 'feature' AND NOT urgent AND {soft} AND ind <= 2 AND recent_count <= 1 AS low_news, ind <= 1 AND ((story_type = 'breaking' AND urgent AND authority >= 1 AND (n_urgency >= 2 OR n_impact >= 2)) OR (n_policy >= 2 AND n_impact >= 2 AND authority >= 1.2 AND recent_count >= 1)) AS imp FROM t),
    p AS (SELECT *, authority * CASE WHEN story_type = 'evergreen' AND NOT urgent THEN {w['evergreen']} ELSE 1 END * CASE WHEN NOT urgent AND low_single THEN {w['singleton']} ELSE 1 END
      * CASE WHEN NOT urgent AND ind <= 1 AND story_type <> 'breaking' AND NOT imp THEN CASE WHEN authority >= 1 THEN {w['single'][0]} ELSE {w['single'][1]} END ELSE 1 END * CASE WHEN NOT urgent AND story_type <> 'breaking' AND lone THEN {w['thin']} ELSE 1 END
      * CASE WHEN low_news THEN CASE WHEN authority >= 1 THEN {w['hard'][0]} ELSE {w['hard'][1]} END ELSE 1 END * (1 + least({w['momentum'][0]}, greatest(0, recent_count - 1) * {w['momentum'][1]})) AS factor,
      {w['impact']} * n_impact + {w['urgency']} * n_urgency + {w['novelty']} * n_novelty + {w['relevance']} * n_relevance + {w['policy']} * n_policy + {w['volume']} * ln(1 + article_count) + {w['family']} * ln(1 + ind) + {w['source']} * ln(1 + source_count) + {w['recency']} * exp(-hours / {w['half']}) AS base FROM n)"""


HOME_SQL = _score_sql(HOMEPAGE, False) + """, q AS (SELECT *, CASE WHEN story_type = 'evergreen' AND NOT urgent THEN 'evergreen_instructional' WHEN story_type = 'opinion' AND NOT urgent THEN 'opinion_demoted' WHEN low_single AND NOT urgent THEN 'single_low_authority_source'
    WHEN low_news THEN 'low_newsworthiness_feature' END AS lead_reason, round(base * factor, 2) AS score FROM p)"""
register("story_type", BOARD, lambda *t: story_ranking(board(*t), lexicon={k: L.DATA[k] for k in DEFAULT}).groupBy("story_type").agg(F.count("*").alias("n")), HOME_SQL + " SELECT story_type, count(*) AS n FROM q GROUP BY 1")
DATA_LEXICON = {k: L.DATA[k] for k in DEFAULT}
register("story_ranking", BOARD, lambda *t: story_ranking(board(*t), lexicon=DATA_LEXICON).select("id", "score", "story_type", "lead_eligible", "lead_reason", "urgent"), HOME_SQL + " SELECT id, score, story_type, lead_reason IS NULL AS lead_eligible, lead_reason, urgent FROM q")

WEEK_SQL = _score_sql(WEEKLY, True) + """, q AS (SELECT *, round((base + least(1.2, CAST(f_admins AS INT) * 0.75 + CAST(f_teachers AS INT) * 0.35 + CAST(f_edtech AS INT) * 0.35)) * factor * CASE WHEN ind >= 4 THEN 1.6 WHEN ind = 3 THEN 1.42 WHEN ind = 2 THEN 1.24 ELSE 1 END, 2) AS score,
    list_filter([CASE WHEN n_impact >= 2 THEN 'high_impact' END, CASE WHEN n_policy > 0 THEN 'policy' END, CASE WHEN n_urgency > 0 AND (hours <= 72 OR recent_count >= 2) THEN 'urgent' END, CASE WHEN ind >= 2 OR source_count >= 2 THEN 'multi_source' END,
    CASE WHEN f_admins AND (n_impact > 0 OR n_policy > 0) THEN 'district_impact' END, CASE WHEN f_teachers AND NOT f_admins THEN 'classroom_relevance' END, CASE WHEN f_edtech THEN 'edtech' END, CASE WHEN recent_count >= 3 OR article_count >= 4 THEN 'momentum' END], lambda x: x IS NOT NULL) AS why FROM p)"""
register("newsletter_ranking", BOARD, lambda *t: newsletter_ranking(board(*t, recent_hours=72, days=14), lexicon=DATA_LEXICON, audience=DATA_AUDIENCE).select("id", "score", F.array_join("why", ",").alias("why")), WEEK_SQL + " SELECT id, score, CASE WHEN len(why) = 0 THEN 'high_impact' ELSE array_to_string(why[1:3], ',') END AS why FROM q")


# --- summaries ---------------------------------------------------------------------------------------------------------------------


_SAN = sql_sanitized("v_articles", "id, source_id, title, ts")


def summary_cleaning(articles: DataFrame) -> DataFrame:
    """Each article's cleaned summary, or why it has none."""
    rows = articles.select("id", "title", (F.trim(F.coalesce("summary", F.lit(""))) == "").alias("blank"), sanitized(F.col("summary")).alias("clean"))
    rows = rows.withColumn("echo", headline_echo(F.col("title"), F.col("clean")))
    reason = F.when(F.col("blank"), "blank").when(F.col("clean") == "", "short_or_repetitive").when(F.col("echo"), "headline_echo")
    return rows.withColumn("reason", reason).select("id", F.when(F.col("reason").isNull(), F.col("clean")).alias("summary"), "reason")


_ECHO = sql_headline_echo("title", "summary")
register(
    "summary_cleaning", "v_articles", summary_cleaning,
    _SAN + f" SELECT id, CASE WHEN reason IS NULL THEN summary END AS summary, reason FROM (SELECT id, summary, CASE WHEN t = '' THEN 'blank' WHEN summary = '' THEN 'short_or_repetitive' WHEN {_ECHO} THEN 'headline_echo' END AS reason FROM s)",
)


#: Fixed value: words that a summary of this field has.
TOPICAL = "district|school board|state|federal|teacher|students|curriculum|funding|policy|classroom|superintendent|principal|k-12|education"


def candidate_score(title: Column, summary: Column, kind: Column) -> Column:
    """What speaks for and against a cleaned candidate, between 0 and 1 with two decimals; nothing for an empty one, a fixed score for a
    template. The summary is computed once, however dear its expression."""
    return let(summary, lambda summary: _candidate_score(summary, kind, headline_echo(title, summary)))


def _candidate_score(summary: Column, kind: Column, echo: Column) -> Column:
    n = F.size(F.array_remove(F.split(summary, r"\s+"), ""))
    part = lambda when, value: F.when(when, value).otherwise(0.0)
    score = F.lit(0.45) + part(~low_quality(summary), 0.25) + part(n >= 10, 0.12) + part(n >= 16, 0.08) - part(n > 60, 0.08) + part(summary.rlike(f"(?i)({TOPICAL})"), 0.07) + part(summary.rlike("[0-9]"), 0.03)
    score = score - part(echo, 0.4) - part(synthetic(summary), 0.35)
    return F.when(summary == "", 0.0).when(kind == "fallback", 0.38).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2))


_WORDS = "len(list_filter(regexp_split_to_array(summary, '\\s+'), lambda x: x <> ''))"
_CS = f"""CAST(CASE WHEN summary = '' THEN 0 WHEN kind = 'fallback' THEN 0.38 ELSE round(greatest(0, least(1, 0.45::DOUBLE + CASE WHEN {sql_low_quality('summary')} THEN 0 ELSE 0.25 END + CASE WHEN {_WORDS} >= 10 THEN 0.12 ELSE 0 END + CASE WHEN {_WORDS} >= 16 THEN 0.08 ELSE 0 END
    - CASE WHEN {_WORDS} > 60 THEN 0.08 ELSE 0 END + CASE WHEN regexp_matches(summary, '(?i)({TOPICAL})') THEN 0.07 ELSE 0 END + CASE WHEN regexp_matches(summary, '[0-9]') THEN 0.03 ELSE 0 END - CASE WHEN {_ECHO} THEN 0.4 ELSE 0 END - CASE WHEN {sql_synthetic('summary')} THEN 0.35 ELSE 0 END)), 2) END AS DOUBLE)"""
register(
    "summary_candidate_score", "v_articles", lambda a: a.select("id", candidate_score(F.col("title"), sanitized(F.col("summary")), F.expr("if(id % 8 = 0, 'fallback', 'existing')")).alias("score")),
    _SAN + f" SELECT id, {_CS} AS score FROM (SELECT *, CASE WHEN id % 8 = 0 THEN 'fallback' ELSE 'existing' END AS kind FROM s)",
)


def admitted(candidates: DataFrame) -> DataFrame:
    """(id, title, summary, kind, ord, score) of candidates (id, title, summary, kind, ord): cleaned, without empty ones and echoes of the
    title, equal texts once (the first)."""
    clean = candidates.withColumn("summary", sanitized(F.col("summary")))
    once = clean.groupBy("id", F.lower("summary").alias("k")).agg(F.min_by(F.struct("title", "summary", "kind", "ord"), "ord").alias("c")).select("id", "c.*")
    once = once.where("summary <> ''").where(~headline_echo(F.col("title"), F.col("summary")))  # after the aggregate, so that each text is cleaned once
    return once.withColumn("score", _candidate_score(F.col("summary"), F.col("kind"), F.lit(False)))


def summary_adjudication(candidates: DataFrame) -> DataFrame:
    """candidates (id, title, summary, kind, ord) -> (id, title, kind, summary, confidence, reasons): the best score, then the longest, then the
    first. The lead over the second, or 0.2 where there is none, and the score give the confidence. No row where no candidate is admitted."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), F.desc(F.length("summary")), "ord")
    best = admitted(candidates).withColumns({"r": F.row_number().over(w), "next": F.lead("score").over(w)}).where("r = 1")
    gap = F.when(F.col("next").isNull(), 0.2).otherwise(F.greatest(F.lit(0.0), F.col("score") - F.col("next")))
    confidence = F.greatest(F.lit(0.35), F.least(F.lit(0.9), 0.52 + 0.9 * gap + 0.35 * F.greatest(F.lit(0.0), F.col("score") - 0.55)))
    reasons = F.array_compact(F.array(F.lit("heuristic_quality_score"), F.when(gap >= 0.12 - 1e-9, "clear_quality_margin"), F.when(F.col("kind") == "scrape", "scraped_main_content"), F.when(F.col("kind") == "llm", "llm_rewrite_selected"), F.when(F.col("kind") == "fallback", "fallback_generated_brief")))
    return best.select("id", "title", "kind", "summary", F.round(confidence, 2).alias("confidence"), reasons.alias("reasons"))


def _candidates(a: DataFrame) -> DataFrame:
    """Three candidates of each article from one scan: its summary, the first sentence of it, a template."""
    own = sanitized(F.col("summary"))
    rows = a.withColumn("own", own).select("id", "title", F.explode(F.array(
        F.struct(F.col("own").alias("summary"), F.lit("existing").alias("kind"), F.lit(1).alias("ord")), F.struct(F.regexp_extract("own", "^[^.!?]*[.!?]?", 0).alias("summary"), F.lit("scrape").alias("kind"), F.lit(2).alias("ord")),
        F.struct(F.concat(F.lit("New coverage highlights something that is reported of "), "title", F.lit(" and of all that follows.")).alias("summary"), F.lit("fallback").alias("kind"), F.lit(3).alias("ord")),
    )).alias("c"))
    return rows.select("id", "title", "c.*")


_RAW = """(SELECT id, title, 'existing' AS kind, 1 AS ord, summary FROM s1st UNION ALL SELECT id, title, 'scrape', 2, regexp_extract(summary, '^[^.!?]*[.!?]?', 0) FROM s1st
    UNION ALL SELECT id, title, 'fallback', 3, concat('New coverage highlights something that is reported of ', title, ' and of all that follows.') FROM s1st)"""
ADJUDICATED = f"""WITH s1st AS ({_SAN} SELECT id, source_id, title, ts, summary FROM s), x AS ({sql_sanitized(_RAW, 'id, title, kind, ord')} SELECT id, title, kind, ord, summary FROM s),
    o AS (SELECT *, {_CS} AS score FROM x WHERE summary <> '' AND NOT {_ECHO} QUALIFY row_number() OVER (PARTITION BY id, lower(summary) ORDER BY ord) = 1),
    b AS (SELECT *, lead(score) OVER w AS nxt, row_number() OVER w AS r FROM o WINDOW w AS (PARTITION BY id ORDER BY score DESC, length(summary) DESC, ord)),
    g AS (SELECT *, CASE WHEN nxt IS NULL THEN 0.2::DOUBLE ELSE greatest(0, score - nxt) END AS gap FROM b WHERE r = 1),
    d AS (SELECT id, title, kind, summary, round(greatest(0.35, least(0.9, 0.52::DOUBLE + 0.9::DOUBLE * gap + 0.35::DOUBLE * greatest(0, score - 0.55::DOUBLE))), 2) AS confidence,
      list_filter(['heuristic_quality_score', CASE WHEN gap >= 0.12::DOUBLE - 1e-9 THEN 'clear_quality_margin' END, CASE kind WHEN 'scrape' THEN 'scraped_main_content' WHEN 'fallback' THEN 'fallback_generated_brief' END], lambda y: y IS NOT NULL) AS reasons FROM g)"""
register(
    "summary_adjudication", "v_articles", lambda a: summary_adjudication(_candidates(a)).select("id", "kind", "summary", "confidence", F.array_join("reasons", ",").alias("reasons")),
    ADJUDICATED + " SELECT id, kind, summary, confidence, array_to_string(reasons, ',') AS reasons FROM d",
)


def summary_verdict_apply(decisions: DataFrame, candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """An external verdict's winner replaces the choice; a rejection takes the fallback. Without a verdict the choice stands."""
    named = candidates.select("id", F.col("kind").alias("winner"), F.col("summary").alias("text")).dropDuplicates(["id", "winner"])
    wanted = verdicts.select("id", F.when(F.col("reject"), "fallback").otherwise(F.col("winner")).alias("winner"), F.when(F.col("reject"), "ai_reject_fallback").otherwise("ai").alias("how"))
    chosen = wanted.join(named, ["id", "winner"])
    return decisions.join(chosen, "id", "left").select("id", F.coalesce("winner", "kind").alias("kind"), F.coalesce("text", "summary").alias("summary"), F.coalesce("how", F.lit("deterministic")).alias("method"))


def _verdicts(a: DataFrame) -> DataFrame:
    return a.where("id % 3 = 0").select("id", F.lit("scrape").alias("winner"), F.expr("id % 2 = 0").alias("reject"))


register(
    "summary_verdict_apply", "v_articles", lambda a: summary_verdict_apply(summary_adjudication(_candidates(a)), admitted(_candidates(a)), _verdicts(a)),
    ADJUDICATED + """ SELECT d.id, coalesce(o.kind, d.kind) AS kind, coalesce(o.summary, d.summary) AS summary, CASE WHEN o.id IS NULL THEN 'deterministic' WHEN d.id % 6 = 0 THEN 'ai_reject_fallback' ELSE 'ai' END AS method
    FROM d LEFT JOIN o ON o.id = d.id AND d.id % 3 = 0 AND o.kind = CASE WHEN d.id % 6 = 0 THEN 'fallback' ELSE 'scrape' END""",
)


def method_stats(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("kind").agg(F.count("*").alias("n"))


register("method_stats", "v_articles", lambda a: method_stats(summary_adjudication(_candidates(a))), ADJUDICATED + " SELECT kind, count(*) AS n FROM d GROUP BY 1")


def story_preview(decisions: DataFrame) -> DataFrame:
    """(id, preview_type, preview, confidence, reason) of decisions (id, title, kind, summary, confidence, reasons).

    Full only from a model's text, else an excerpt; the headline alone for empty texts, templates, echoes of the title, and where the confidence is
    below MIN_CONFIDENCE.
    """
    c = F.col
    rows = decisions.withColumns({"text": sanitized(c("summary")), "sure": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("confidence"))), 2)})
    held = F.when(c("kind") == "fallback", "fallback_suppressed").when(synthetic(c("text")), "synthetic_suppressed").when(headline_echo(c("title"), c("text")), "headline_echo_suppressed")
    rows = rows.withColumn("held", held)
    why = F.when(c("text") == "", "empty_preview_text").when(c("held").isNotNull(), c("held")).when(c("sure") < MIN_CONFIDENCE, "low_confidence")
    rows = rows.withColumn("why", why)
    sure = F.when(c("text") == "", 0.0).when(c("held").isNotNull(), F.least(c("sure"), F.lit(0.34))).otherwise(c("sure"))
    kind = F.when(c("why").isNotNull(), "headline_only").when(c("kind") == "llm", "full").otherwise("excerpt")
    return rows.select("id", kind.alias("preview_type"), F.when(c("why").isNull(), c("text")).alias("preview"), sure.alias("confidence"), F.coalesce("why", F.get("reasons", 0), F.lit("candidate_selected")).alias("reason"))


PREVIEWED = ADJUDICATED + f""", pt AS ({sql_sanitized("(SELECT id, title, kind, summary, confidence, reasons FROM d)", "id, title, kind, confidence, reasons")} SELECT id, title, kind, confidence, reasons, summary FROM s),
    ph AS (SELECT *, CASE WHEN kind = 'fallback' THEN 'fallback_suppressed' WHEN {sql_synthetic('summary')} THEN 'synthetic_suppressed' WHEN {_ECHO} THEN 'headline_echo_suppressed' END AS held FROM pt),
    pw AS (SELECT *, CASE WHEN summary = '' THEN 'empty_preview_text' WHEN held IS NOT NULL THEN held WHEN confidence < {MIN_CONFIDENCE} THEN 'low_confidence' END AS why FROM ph),
    pv AS (SELECT id, CASE WHEN why IS NOT NULL THEN 'headline_only' ELSE 'excerpt' END AS preview_type, CASE WHEN why IS NULL THEN summary END AS preview, CAST(CASE WHEN summary = '' THEN 0 WHEN held IS NOT NULL THEN least(confidence, 0.34) ELSE confidence END AS DOUBLE) AS confidence,
      coalesce(why, reasons[1], 'candidate_selected') AS reason FROM pw)"""
register("story_preview", "v_articles", lambda a: story_preview(summary_adjudication(_candidates(a))), PREVIEWED + " SELECT id, preview_type, preview, confidence, reason FROM pv")


def preview_resolution(scored: DataFrame, previews: DataFrame) -> DataFrame:
    """(id, preview_type, score) of scored (id, score, editor_summary): an editor's summary keeps the score; without a preview a tenth goes, with one
    of a confidence below 0.66 four hundredths; two decimals."""
    joined = scored.join(previews, "id", "left")
    editor = F.col("editor_summary").isNotNull()
    factor = F.when(editor, 1.0).when(F.col("preview").isNull(), 0.9).when(F.col("confidence") < MIN_CONFIDENCE + 0.08, 0.96).otherwise(1.0)
    return joined.select("id", F.when(editor, "editor").otherwise(F.coalesce("preview_type", F.lit("headline_only"))).alias("preview_type"), F.round(F.col("score") * factor, 2).alias("score"))


register(
    "preview_resolution", "v_articles",
    lambda a: preview_resolution(a.select("id", (F.col("id") % 50 + 0.5).cast("double").alias("score"), F.expr("if(id % 10 = 0, title, null)").alias("editor_summary")), story_preview(summary_adjudication(_candidates(a.where("id % 4 <> 0"))))),
    PREVIEWED + f""" SELECT v.id, CASE WHEN v.id % 10 = 0 THEN 'editor' ELSE coalesce(preview_type, 'headline_only') END AS preview_type,
    round((v.id % 50 + 0.5::DOUBLE) * CASE WHEN v.id % 10 = 0 THEN 1 WHEN preview IS NULL THEN 0.9::DOUBLE WHEN confidence < {MIN_CONFIDENCE + 0.08} THEN 0.96::DOUBLE ELSE 1 END, 2) AS score FROM v_articles v LEFT JOIN pv ON pv.id = v.id AND v.id % 4 <> 0""",
)


def rerank_apply(ranked: DataFrame, verdict: DataFrame, limit: int = 60) -> DataFrame:
    """ranked (id, pos) after a verdict (id, place, demote): listed first, then the rest in their order, demoted ones out."""
    joined = ranked.join(verdict, "id", "left").where(~F.coalesce("demote", F.lit(False)))
    keys = (F.col("place").isNull(), F.col("place"), F.col("pos"), F.col("id"))
    first = joined.orderBy(*keys).limit(limit).withColumn("listed", F.col("place").isNull())
    return first.select("id", F.row_number().over(Window.orderBy("listed", "place", "pos", "id")).alias("pos"))


register(
    "rerank_apply", "orders",
    lambda o: rerank_apply(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos")), o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id"), (F.lit(10**9) - F.col("o_orderkey")).alias("place"), F.expr("o_orderkey % 10 = 0").alias("demote"))),
    """SELECT o_orderkey AS id, CAST(row_number() OVER (ORDER BY o_orderkey % 5 <> 0, CASE WHEN o_orderkey % 5 = 0 THEN -o_orderkey ELSE o_orderkey END) AS INT) AS pos FROM orders WHERE o_orderkey % 10 <> 0 QUALIFY pos <= 60""",
)


def title_summaries(articles: DataFrame) -> DataFrame:
    """(id, fallback): summaries made from titles alone."""
    return articles.select("id", fallback_summary(F.col("title")).alias("fallback"))


_TOPICAL = "concat(case id % 5 when 0 then 'Budget | ' when 1 then 'The court and ' when 2 then 'Literacy: ' else '' end, title)"
register("fallback_summary", "v_articles", lambda a: title_summaries(a.withColumn("title", F.expr(_TOPICAL))), sql_fallback(f"(SELECT id, {_TOPICAL} AS title FROM v_articles)"))
