"""Row filters and quality gates: one projection each, of built-in expressions only; a null text counts as empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import lexicons as L
from storyloom.functions import patterns as P
from storyloom.functions.text import has_term, sql_has_term
from storyloom.registry import register


def text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def path_of(url: Column) -> Column:
    """The path of a URL without query and fragment; empty if it is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))


_PATH = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(/[^?#]*)', 1)"


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def servable() -> Column:
    """The article filter that all lists share."""
    bad_url = text("url").rlike(P.JOB_URL) | text("url").rlike(P.PROFILE_URL) | text("url").rlike(P.SECTION_URL)
    return ~bad_url & (F.coalesce("quality_label", F.lit("unknown")) != "non_article") & ~text("title").ilike("from %")


SERVABLE_SQL = f"NOT regexp_matches(url, {lit(P.JOB_URL)}) AND NOT regexp_matches(url, {lit(P.PROFILE_URL)}) AND NOT regexp_matches(url, {lit(P.SECTION_URL)}) AND coalesce(quality_label, 'unknown') <> 'non_article' AND coalesce(title, '') NOT ILIKE 'from %'"


def servable_articles(articles: DataFrame) -> DataFrame:
    return articles.where(servable()).select("id", "url", "title")


register("servable_articles", "v_articles", servable_articles, f"SELECT id, url, title FROM v_articles WHERE {SERVABLE_SQL}")


def non_story(title: Column, url: Column) -> Column:
    """Static or taxonomy pages, by title or path."""
    t = squeezed(F.coalesce(title, F.lit("")))
    n = F.size(F.split(t, " "))
    short = t.rlike(P.NON_STORY_SHORT) & (n <= F.when(F.lower(t).startswith("privacy"), 6).otherwise(7))
    return t.rlike(P.NON_STORY_TITLE) | short | path_of(url).rlike(P.NON_STORY_PATH)


_TITLES = "CASE id % 9 WHEN 0 THEN 'Privacy Policy' WHEN 1 THEN 'Terms of use and more' WHEN 2 THEN 'from the editor desk' WHEN 3 THEN 'News | today' WHEN 4 THEN 'untitled' ELSE title END"
_PATHS = "CASE id % 10 WHEN 0 THEN concat(url, '/tag/x') WHEN 1 THEN concat('https://e.org/news/2024/01/', CAST(id AS STRING)) WHEN 2 THEN 'https://e.org/topics' WHEN 3 THEN 'https://e.org/staff/ann' ELSE url END"


def _varied(a: DataFrame) -> DataFrame:
    return a.withColumns({"title": F.expr(_TITLES), "url": F.expr(_PATHS)})


VARIED = f"(SELECT id, source_id, lang, summary, ts, quality_label, {_TITLES} AS title, {_PATHS} AS url FROM v_articles)"
register(
    "non_story_filter", "v_articles", lambda a: _varied(a).select("id", non_story(F.col("title"), F.col("url")).alias("is_non_story")),
    f"""SELECT id, regexp_matches(t, {lit(P.NON_STORY_TITLE)}) OR (regexp_matches(t, {lit(P.NON_STORY_SHORT)}) AND len(string_split(t, ' ')) <= CASE WHEN lower(t) LIKE 'privacy%' THEN 6 ELSE 7 END) OR regexp_matches(p, {lit(P.NON_STORY_PATH)}) AS is_non_story
    FROM (SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t, {_PATH} AS p FROM {VARIED})""",
)


def reject_titles(stories: DataFrame) -> DataFrame:
    return stories.where((F.trim(text("title")) != "") & ~F.trim(text("title")).rlike(P.REJECT_TITLE)).select("id", "title")


register("reject_titles", "v_articles", lambda a: reject_titles(_varied(a)), f"SELECT id, title FROM {VARIED} WHERE trim(title) <> '' AND NOT regexp_matches(trim(title), {lit(P.REJECT_TITLE)})")


def article_quality(articles: DataFrame) -> DataFrame:
    """articles with quality_score, quality_label and the reasons in order: a sum of signals from 0.5, then three overrides.

    Flags are columns before anything is made of them, so each pattern is tried once on a row.
    """
    title, summary = F.trim(text("title")), F.trim(text("summary"))
    both, path = F.concat_ws(" ", title, summary), path_of(F.col("url"))
    segments = F.filter(F.split(F.lower(path), "/"), lambda x: x != "")
    first, second = F.coalesce(F.get(segments, F.lit(0)), F.lit("")), F.coalesce(F.get(segments, F.lit(1)), F.lit(""))
    generic = first.isin(P.SECTION_SEGMENTS)
    plain = ~first.contains("-") & ~first.rlike("[0-9]") & (F.length(first) <= 24)
    index = (F.size(segments) == 0) | ((F.size(segments) == 1) & (generic | plain)) | ((F.size(segments) == 2) & generic & ~second.rlike("[0-9]") & ~second.contains("-"))
    n = F.size(F.split(squeezed(title), " "))
    person = title.rlike(P.PERSON_NAME)
    section = title.rlike(P.SECTION_TITLE) | ((n <= 4) & F.lower(title).rlike(r"^from(\s|$)"))
    hint, bad_path, bad_url = path.rlike(P.ARTICLE_PATH), path.rlike(P.NON_ARTICLE_PATH), path.rlike(P.NON_STORY_PATH)
    t = squeezed(title)
    bad_title = t.rlike(P.NON_STORY_TITLE) | (t.rlike(P.NON_STORY_SHORT) & (n <= F.when(F.lower(t).startswith("privacy"), 6).otherwise(7)))
    # Signal words are rare, and to look for them costs far less than the patterns do on whole texts.
    articles = articles.withColumns({"_quality_text": both, "_quality_low": F.lower(both)})
    found = lambda p: reduce(lambda a, b: a | b, (F.col("_quality_low").contains(w) for w in P.GUARDED[p])) & F.col("_quality_text").rlike(p)
    bio, promo = found(P.BIOGRAPHY), found(P.PROMOTION)
    personal = reduce(lambda a, b: a + b, (found(p).cast("int") for p in P.PERSONAL))
    flags = {"index": index, "person": person, "section": section, "hint": hint, "bad_path": bad_path, "bad_url": bad_url, "bad_title": bad_title, "bio": bio, "promo": promo, "personal": personal, "summary_length": F.length(summary), "title_length": F.length(title)}
    flagged = articles.withColumns({f"_quality_{k}": v for k, v in flags.items()})
    index, person, section, hint, bad_path, bad_url, bad_title, bio, promo, personal, summary_length, title_length = (F.col(f"_quality_{k}") for k in flags)
    signals = [
        (bad_path, -0.55, "non_article_url_path"), (bad_url, -0.6, "non_story_url_path"), (bad_title, -0.65, "non_story_title_pattern"), (hint, 0.2, "article_url_path_hint"),
        (bio, -0.45, "biography_text_pattern"), (promo, -0.25, "promotional_text_pattern"), (section, -0.45, "section_index_title"), (index & ~hint, -0.5, "section_index_path"),
        (person, -0.2, "person_name_title"), (personal >= 2, -0.35, "personal_blog_pattern"), (personal == 1, -0.15, "personal_blog_hint"),
        (summary_length >= 80, 0.08, None), ((title_length >= 32) & ~person, 0.08, None),
    ]
    score = F.lit(0.5)
    for flag, weight, _ in signals:
        score = score + F.when(flag, weight).otherwise(0.0)
    bounded = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)
    override = (
        F.when((bad_path | bad_url | bad_title) & ~hint, 0.06).when(bad_path & (bio | person), 0.1).when(index & (section | (summary_length < 70)) & ~hint, 0.08)
    )
    reasons = F.array_compact(F.array(*(F.when(flag, F.lit(name)) for flag, _, name in signals if name)))
    out = flagged.withColumns({"quality_score": F.coalesce(override, bounded), "quality_reasons": reasons, "_hard": override.isNotNull()}).drop("_quality_text", "_quality_low", *(f"_quality_{k}" for k in flags))
    label = F.when(F.col("_hard") | (F.col("quality_score") <= 0.35), "non_article").when(F.col("quality_score") >= 0.65, "article").otherwise("uncertain")
    return out.withColumn("quality_label", label).drop("_hard")


def _signal_sql() -> str:
    personal = " + ".join(f"CAST(regexp_matches(b, {lit(p)}) AS INT)" for p in P.PERSONAL)
    segs = ", ".join(f"'{s}'" for s in P.SECTION_SEGMENTS)
    return f"""WITH a AS (SELECT id, trim(title) AS t, trim(summary) AS s, concat(trim(title), ' ', trim(summary)) AS b, {_PATH} AS p, trim(regexp_replace(trim(title), '\\s+', ' ', 'g')) AS q FROM {VARIED}),
    f AS (SELECT *, list_filter(string_split(lower(p), '/'), lambda x: x <> '') AS seg, len(string_split(q, ' ')) AS n FROM a),
    g AS (SELECT *, coalesce(seg[1], '') AS s1, coalesce(seg[2], '') AS s2, regexp_matches(p, {lit(P.NON_ARTICLE_PATH)}) AS bp, regexp_matches(p, {lit(P.NON_STORY_PATH)}) AS bu, regexp_matches(p, {lit(P.ARTICLE_PATH)}) AS hint,
      regexp_matches(q, {lit(P.NON_STORY_TITLE)}) OR (regexp_matches(q, {lit(P.NON_STORY_SHORT)}) AND n <= CASE WHEN lower(q) LIKE 'privacy%' THEN 6 ELSE 7 END) AS bt, regexp_matches(b, {lit(P.BIOGRAPHY)}) AS bio, regexp_matches(b, {lit(P.PROMOTION)}) AS promo,
      regexp_matches(t, {lit(P.SECTION_TITLE)}) OR (n <= 4 AND regexp_matches(lower(t), '^from(\\s|$)')) AS sec, regexp_matches(t, {lit(P.PERSON_NAME)}) AS person, {personal} AS pers FROM f),
    i AS (SELECT *, len(seg) = 0 OR (len(seg) = 1 AND (s1 IN ({segs}) OR (NOT contains(s1, '-') AND NOT regexp_matches(s1, '[0-9]') AND length(s1) <= 24))) OR (len(seg) = 2 AND s1 IN ({segs}) AND NOT regexp_matches(s2, '[0-9]') AND NOT contains(s2, '-')) AS idx FROM g),
    k AS (SELECT *, CASE WHEN (bp OR bu OR bt) AND NOT hint THEN 0.06::DOUBLE WHEN bp AND (bio OR person) THEN 0.1::DOUBLE WHEN idx AND (sec OR length(s) < 70) AND NOT hint THEN 0.08::DOUBLE END AS hard,
      round(greatest(0, least(1, 0.5::DOUBLE - CASE WHEN bp THEN 0.55 ELSE 0 END - CASE WHEN bu THEN 0.6 ELSE 0 END - CASE WHEN bt THEN 0.65 ELSE 0 END + CASE WHEN hint THEN 0.2 ELSE 0 END - CASE WHEN bio THEN 0.45 ELSE 0 END - CASE WHEN promo THEN 0.25 ELSE 0 END
      - CASE WHEN sec THEN 0.45 ELSE 0 END - CASE WHEN idx AND NOT hint THEN 0.5 ELSE 0 END - CASE WHEN person THEN 0.2 ELSE 0 END - CASE WHEN pers >= 2 THEN 0.35 WHEN pers = 1 THEN 0.15 ELSE 0 END + CASE WHEN length(s) >= 80 THEN 0.08 ELSE 0 END + CASE WHEN length(t) >= 32 AND NOT person THEN 0.08 ELSE 0 END)), 2) AS soft FROM i)"""


_QUALITY_SQL = _signal_sql() + """, r AS (SELECT id, coalesce(hard, soft) AS quality_score, CASE WHEN hard IS NOT NULL OR soft <= 0.35 THEN 'non_article' WHEN soft >= 0.65 THEN 'article' ELSE 'uncertain' END AS quality_label,
    concat_ws(',', CASE WHEN bp THEN 'non_article_url_path' END, CASE WHEN bu THEN 'non_story_url_path' END, CASE WHEN bt THEN 'non_story_title_pattern' END, CASE WHEN hint THEN 'article_url_path_hint' END, CASE WHEN bio THEN 'biography_text_pattern' END,
    CASE WHEN promo THEN 'promotional_text_pattern' END, CASE WHEN sec THEN 'section_index_title' END, CASE WHEN idx AND NOT hint THEN 'section_index_path' END, CASE WHEN person THEN 'person_name_title' END, CASE WHEN pers >= 2 THEN 'personal_blog_pattern' WHEN pers = 1 THEN 'personal_blog_hint' END) AS reasons FROM k)"""
register("article_quality", "v_articles", lambda a: article_quality(_varied(a)).select("id", "quality_score", "quality_label", F.array_join("quality_reasons", ",").alias("reasons")), _QUALITY_SQL + " SELECT * FROM r")


def article_quality_rescan(articles: DataFrame, n: int | None = 3000) -> DataFrame:
    """The newest n articles judged anew, counted by old and new label."""
    newest = articles if n is None else articles.orderBy(F.desc("ts"), F.desc("id")).limit(n)
    return article_quality(newest.withColumn("old_label", F.coalesce("quality_label", F.lit("unknown")))).groupBy("old_label", "quality_label").agg(F.count("*").alias("n"))


register(
    "article_quality_rescan", "v_articles", lambda a: article_quality_rescan(_varied(a), None),
    _QUALITY_SQL + " SELECT coalesce(v.quality_label, 'unknown') AS old_label, r.quality_label, count(*) AS n FROM r JOIN v_articles v USING (id) GROUP BY 1, 2",
)


def topic_flags(df: DataFrame, patterns: dict = P.TOPIC) -> DataFrame:
    """df with the flags of topical relevance and signal, strict_signal, off_topic."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws(" ", text("title"), text("summary"), text("url"))), "[_-]+", " "), r"\s+", " "))
    near = rf"\b{patterns['who']}\b.{{0,50}}\b{patterns['what']}\b|\b{patterns['what']}\b.{{0,50}}\b{patterns['who']}\b"
    t = F.regexp_replace(t, r"[^\x00-\x7f]", "#")  # word boundaries are those of ASCII
    out = df.withColumn("_t", t).withColumns({
        "explicit": F.col("_t").rlike(patterns["explicit"]), "strong": reduce(lambda a, b: a + b, (F.col("_t").rlike(p).cast("int") for p in [patterns["explicit"], *patterns["strong"]])), "context": F.col("_t").rlike(near),
        "higher_only": F.col("_t").rlike(patterns["higher"]) & ~F.col("_t").rlike(patterns["higher_but"]), "event": F.col("_t").rlike(patterns["event"]), "sports": F.col("_t").rlike(patterns["sports"]),
        "conflict": F.col("_t").rlike(patterns["conflict"]), "crime": F.col("_t").rlike(patterns["crime"]) & ~F.col("_t").rlike(patterns["crime_but"]),
    })
    c = F.col
    off = c("higher_only") | c("event") | c("sports") | c("conflict")
    about = c("explicit") | (c("strong") >= 1) | c("context")
    return out.withColumns({"signal": ~off & ~(c("crime") & ~c("explicit")) & about, "strict_signal": ~off & ~c("crime") & about, "off_topic": off | c("crime")}).drop("_t")


def _topic_sql(p: dict = P.DATA_TOPIC, rows: str = "v_articles") -> str:
    m = lambda k: f"regexp_matches(t, {lit(p[k])})"
    near = rf"\b{p['who']}\b.{{0,50}}\b{p['what']}\b|\b{p['what']}\b.{{0,50}}\b{p['who']}\b"
    strong = " + ".join(f"CAST(regexp_matches(t, {lit(x)}) AS INT)" for x in [p["explicit"], *p["strong"]])
    return f"""WITH t AS (SELECT *, trim(regexp_replace(regexp_replace(lower(concat_ws(' ', title, summary, url)), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM {rows}),
    f AS (SELECT *, {m('explicit')} AS explicit, {strong} AS strong, regexp_matches(t, {lit(near)}) AS context, {m('higher')} AND NOT {m('higher_but')} AS higher_only, {m('event')} AS event, {m('sports')} AS sports, {m('conflict')} AS conflict, {m('crime')} AND NOT {m('crime_but')} AS crime FROM t),
    g AS (SELECT *, higher_only OR event OR sports OR conflict AS off, explicit OR strong >= 1 OR context AS about FROM f),
    h AS (SELECT *, NOT off AND NOT (crime AND NOT explicit) AND about AS signal, NOT off AND NOT crime AND about AS strict_signal, off OR crime AS off_topic FROM g)"""


_FLAGS = ("explicit", "strong", "context", "higher_only", "event", "sports", "conflict", "crime", "signal", "strict_signal", "off_topic")
register("topic_relevance", "v_articles", lambda a: topic_flags(a, P.DATA_TOPIC).select("id", *_FLAGS), f"{_topic_sql()} SELECT id, {', '.join(_FLAGS)} FROM h")


def us_only(title: str, summary: str, us: list[str], non_us: list[str]) -> Column:
    t = F.lower(F.concat_ws(" ", text(title), text(summary)))
    has = lambda terms: reduce(lambda a, b: a | b, (t.contains(x) for x in terms))
    return ~(has(non_us) & ~has(us))


_US, _NON = ["with", "que", "und"], ["tion", "heit", "mento"]


def _us_sql() -> str:
    t = "lower(concat_ws(' ', title, summary))"
    return f"NOT (({' OR '.join(f'contains({t}, {lit(x)})' for x in _NON)}) AND NOT ({' OR '.join(f'contains({t}, {lit(x)})' for x in _US)}))"


register("us_only_filter", "v_articles", lambda a: a.where(us_only("title", "summary", _US, _NON)).select("id"), f"SELECT id FROM v_articles WHERE {_us_sql()}")


def international_cleanup(articles: DataFrame, links: DataFrame, stories: DataFrame, us: list[str], non_us: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without articles from elsewhere, their links, and stories that have none left."""
    kept = articles.where(us_only("title", "summary", us, non_us))
    left = links.join(kept.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    return kept, left, stories.join(left.select(F.col("story_id").alias("id")), "id", "left_semi")


def _cleanup_counts(a: DataFrame, x: DataFrame, s: DataFrame) -> DataFrame:
    parts = zip(("articles", "links", "stories"), (a, x, s), international_cleanup(a, x, s, _US, _NON))
    counts = [before.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n").union(after.agg((-F.count("*")).alias("n")).select(F.lit(name).alias("name"), "n")) for name, before, after in parts]
    return reduce(DataFrame.union, counts).groupBy("name").agg(F.sum("n").alias("deleted"))


register(
    "international_cleanup", "v_articles v_links v_stories", _cleanup_counts,
    f"""WITH k AS (SELECT id FROM v_articles WHERE {_us_sql()}), x AS (SELECT * FROM v_links WHERE article_id IN (SELECT id FROM k))
    SELECT 'articles' AS name, CAST((SELECT count(*) FROM v_articles) - (SELECT count(*) FROM k) AS BIGINT) AS deleted UNION ALL SELECT 'links', (SELECT count(*) FROM v_links) - (SELECT count(*) FROM x)
    UNION ALL SELECT 'stories', (SELECT count(*) FROM v_stories) - (SELECT count(DISTINCT story_id) FROM x)""",
)

register(
    "job_listing_filter", "v_articles", lambda a: a.where(~(text("url").rlike(P.JOB_URL) | text("title").rlike(P.JOB_TITLE))).select("id"),
    f"SELECT id FROM v_articles WHERE NOT (regexp_matches(url, {lit(P.JOB_URL)}) OR regexp_matches(title, {lit(P.JOB_TITLE)}))",
)


def wire_filter(articles: DataFrame, patterns: dict = P.TOPIC, social: list[str] = P.SOCIAL, shortest: int = 28) -> DataFrame:
    """Servable articles with a telling title, not from social sites, on the topic."""
    title = F.trim(text("title"))
    host = F.regexp_replace(host_of(F.col("url")), r"^www\.", "")
    social_site = reduce(lambda a, b: a | b, ((host == d) | host.endswith("." + d) for d in social))
    dull = (title == "") | title.rlike(P.WIRE_TITLE) | ((F.length(title) < shortest) & (F.size(F.split(squeezed(title), " ")) <= 4))
    return topic_flags(articles.where(servable() & ~dull & ~social_site), patterns).where("strict_signal and not off_topic")


_SOCIAL = ["src3.example.org"]
_WIRE_SQL = _topic_sql(rows=f"""(SELECT * FROM v_articles WHERE {SERVABLE_SQL} AND trim(title) <> '' AND NOT regexp_matches(trim(title), {lit(P.WIRE_TITLE)}) AND NOT (length(trim(title)) < 28 AND len(string_split(trim(regexp_replace(trim(title), '\\s+', ' ', 'g')), ' ')) <= 4)
    AND NOT regexp_matches(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1)), '^www\\.', ''), '(^|\\.)src3\\.example\\.org$'))""")
register("wire_filter", "v_articles", lambda a: wire_filter(a, P.DATA_TOPIC, _SOCIAL).select("id", "title"), f"{_WIRE_SQL} SELECT id, title FROM h WHERE strict_signal AND NOT off_topic")


def recent_wire(articles: DataFrame, limit: int = 50, **options) -> DataFrame:  # noqa: ANN003
    """The newest articles of the wire: filtered first, then a top-k."""
    return wire_filter(articles, **options).orderBy(F.desc("ts"), F.desc("id")).limit(limit).select("id", "title")


register("recent_wire", "v_articles", lambda a: recent_wire(a, 50, patterns=P.DATA_TOPIC, social=_SOCIAL), f"{_WIRE_SQL} SELECT id, title FROM h WHERE strict_signal AND NOT off_topic ORDER BY ts DESC, id DESC LIMIT 50")


def audiences(t: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """The audiences a text concerns, in fixed order; terms count between word boundaries only."""
    lexicon = lexicon or {"teachers": L.TEACHERS, "admins": L.ADMINS, "explicit": L.EDTECH_EXPLICIT, "tech": L.EDTECH_TECH, "context": L.EDTECH_CONTEXT, "higher": L.HIGHER_ED, "k12": L.K12_OVERRIDE}
    h = lambda k: has_term(t, lexicon[k])
    edtech = ~(h("higher") & ~h("k12")) & (h("explicit") | (h("tech") & h("context")))
    return F.array_compact(F.array(F.when(h("teachers"), "teachers"), F.when(h("admins"), "admins"), F.when(edtech, "edtech")))


DATA_AUDIENCE = {"teachers": ["tion", "was"], "admins": ["with the", "des"], "explicit": ["nicht"], "tech": ["of", "la"], "context": ["that", "est"], "higher": ["or"], "k12": ["the"]}


def sql_audience(t: str, x: dict = DATA_AUDIENCE) -> dict[str, str]:
    h = {k: sql_has_term(t, v) for k, v in x.items()}
    return {"teachers": h["teachers"], "admins": h["admins"], "edtech": f"(NOT ({h['higher']} AND NOT {h['k12']}) AND ({h['explicit']} OR ({h['tech']} AND {h['context']})))"}


_A = sql_audience("concat(title, ' ', summary)")
register(
    "audience_match", "v_articles", lambda a: a.select("id", F.array_join(audiences(F.concat_ws(" ", "title", "summary"), DATA_AUDIENCE), ",").alias("audiences")),
    f"SELECT id, concat_ws(',', CASE WHEN {_A['teachers']} THEN 'teachers' END, CASE WHEN {_A['admins']} THEN 'admins' END, CASE WHEN {_A['edtech']} THEN 'edtech' END) AS audiences FROM v_articles",
)


def lanes(t: Column, story_type: Column, reasons: Column, policy: list[str] = L.LANE_POLICY, lexicon: dict | None = None) -> Column:
    """Newsletter lanes in fixed order, from type, ranking reasons, terms and audiences."""
    who = audiences(t, lexicon)
    has = lambda r: F.array_contains(reasons, r)
    return F.array_compact(F.array(
        F.when(story_type.isin("policy", "breaking") | has("policy") | has_term(t, policy), "policy"), F.when(F.array_contains(who, "teachers") | has("classroom_relevance"), "classroom"),
        F.when(F.array_contains(who, "admins") | has("district_impact"), "leadership"), F.when(F.array_contains(who, "edtech") | has("edtech"), "edtech"),
    ))


_TYPE = "CASE id % 6 WHEN 0 THEN 'policy' WHEN 1 THEN 'opinion' WHEN 2 THEN 'breaking' ELSE 'feature' END"
register(
    "lane_assignment", "v_articles",
    lambda a: a.select("id", F.array_join(lanes(F.concat_ws(" ", "title", "summary"), F.expr(_TYPE), F.expr("if(id % 5 = 0, array('edtech'), array('momentum'))"), ["from", "pour"], DATA_AUDIENCE), ",").alias("lanes")),
    f"""SELECT id, concat_ws(',', CASE WHEN {_TYPE} IN ('policy', 'breaking') OR {sql_has_term("concat(title, ' ', summary)", ['from', 'pour'])} THEN 'policy' END, CASE WHEN {_A['teachers']} THEN 'classroom' END, CASE WHEN {_A['admins']} THEN 'leadership' END,
    CASE WHEN {_A['edtech']} OR id % 5 = 0 THEN 'edtech' END) AS lanes FROM v_articles""",
)


def opinion_filter(scored: DataFrame) -> DataFrame:
    """Without opinion pieces, unless they are pinned. scored: (id, title, story_type, status)."""
    return scored.where((F.col("status") == "pinned") | ~((F.col("story_type") == "opinion") | F.lower(F.trim(text("title"))).startswith("opinion:")))


register(
    "opinion_filter", "v_stories", lambda s: opinion_filter(s.withColumns({"story_type": F.expr("if(article_count % 2 = 0, 'opinion', 'feature')"), "title": F.expr("if(length(title) % 7 = 0, concat('Opinion: ', title), title)")})).select("id", "status"),
    "SELECT id, status FROM v_stories WHERE status = 'pinned' OR NOT (article_count % 2 = 0 OR length(title) % 7 = 0)",
)


def relevance_gate(items: DataFrame, scores: DataFrame, budget: int | None = 100) -> DataFrame:
    """Items after the model's verdicts: clear misses go, doubtful ones become uncertain. Only the first `budget` items that need one are
    judged, by their order. items: (id, ord, needs_check, wire, strict_signal, label); scores: (id, relevant, score)."""
    asked = items.where("needs_check")
    asked = asked.select("id") if budget is None else asked.orderBy("ord", "id").limit(budget).select("id")
    judged = items.join(asked.join(scores, "id").select("id", "relevant", "score"), "id", "left")
    drop = (~F.col("relevant") & (F.col("score") < 0.3)) | (F.col("wire") & ~F.col("strict_signal") & ~(F.coalesce("score", F.lit(0.0)) >= 0.5))
    label = F.when((F.col("score") >= 0.3) & (F.col("score") < 0.5), "uncertain").otherwise(F.col("label"))
    return judged.where(~F.coalesce(drop, F.lit(False))).select("id", label.alias("label"))


_ITEMS = "SELECT id, id AS ord, id % 3 <> 0 AS needs_check, id % 7 = 0 AS wire, id % 2 = 0 AS strict_signal, coalesce(quality_label, 'unknown') AS label FROM v_articles"
_SCORES = "SELECT id, id % 5 > 1 AS relevant, CAST(id % 10 AS DOUBLE) / 10 AS score FROM v_articles WHERE id % 4 <> 0"


def _gate(a: DataFrame) -> DataFrame:
    run = lambda s: a.sparkSession.sql(s.replace("v_articles", "{a}"), a=a)
    return relevance_gate(run(_ITEMS), run(_SCORES), None)


register(
    "relevance_gate", "v_articles", _gate,
    f"""WITH i AS ({_ITEMS}), s AS ({_SCORES}), k AS (SELECT id FROM i WHERE needs_check), j AS (SELECT i.*, s.relevant, s.score FROM i LEFT JOIN (SELECT s.* FROM s JOIN k USING (id)) s USING (id))
    SELECT id, CASE WHEN score >= 0.3 AND score < 0.5 THEN 'uncertain' ELSE label END AS label FROM j WHERE NOT coalesce(NOT relevant AND score < 0.3, false) AND NOT (wire AND NOT strict_signal AND coalesce(score, 0) < 0.5)""",
)


def item_admission(items: DataFrame, patterns: dict = P.TOPIC) -> DataFrame:
    """items (id, title, summary, url, quality_label) with the first gate that each fails, or null."""
    judged = topic_flags(article_quality(items), patterns)
    reason = (
        F.when(F.trim(text("title")) == "", "missing_title").when(~text("url").rlike(r"(?i)^https?://[^/]+"), "unresolved_url")
        .when(text("url").rlike(P.JOB_URL) | text("title").rlike(P.JOB_TITLE), "job_listing").when(non_story(F.col("title"), F.col("url")), "non_story")
        .when(F.col("quality_label") == "non_article", "non_article").when(F.col("off_topic"), "off_topic").when(~F.col("signal"), "no_signal")
    )
    return judged.select("id", reason.alias("reject_reason"))


register(
    "item_admission", "v_articles", lambda a: item_admission(_varied(a), P.DATA_TOPIC).groupBy("reject_reason").agg(F.count("*").alias("n")),
    _QUALITY_SQL + f", topical AS ({_topic_sql(rows=VARIED)} SELECT * FROM h)"
    + f""" SELECT reason AS reject_reason, count(*) AS n FROM (SELECT CASE WHEN trim(title) = '' THEN 'missing_title' WHEN NOT regexp_matches(url, '(?i)^https?://[^/]+') THEN 'unresolved_url' WHEN regexp_matches(url, {lit(P.JOB_URL)}) OR regexp_matches(title, {lit(P.JOB_TITLE)}) THEN 'job_listing'
    WHEN regexp_matches(trim(regexp_replace(title, '\\s+', ' ', 'g')), {lit(P.NON_STORY_TITLE)}) OR (regexp_matches(trim(title), {lit(P.NON_STORY_SHORT)}) AND len(string_split(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' ')) <= CASE WHEN lower(title) LIKE 'privacy%' THEN 6 ELSE 7 END)
    OR regexp_matches({_PATH}, {lit(P.NON_STORY_PATH)}) THEN 'non_story' WHEN r.quality_label = 'non_article' THEN 'non_article' WHEN off_topic THEN 'off_topic' WHEN NOT signal THEN 'no_signal' END AS reason FROM topical JOIN r USING (id)) GROUP BY 1""",
)
