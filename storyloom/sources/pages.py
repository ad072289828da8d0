"""Links, ledes, titles and canonical URLs of landed HTML pages, and canonical URLs of article tables. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import patterns as P
from storyloom.functions.headline import headline
from storyloom.operators.filters import host_of, path_of
from storyloom.registry import register

_TRACK = r"(?i)(utm_[^=&]*|gclid|fbclid)(=[^&]*)?"


def normal_url(url: Column) -> Column:
    """The URL without fragment and tracking parameters; what is no URL stays."""
    u = F.regexp_replace(url, "#.*$", "")
    base, query = F.regexp_extract(u, r"^[^?]*", 0), F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{_TRACK}$"))
    clean = F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)
    return F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+"), clean).otherwise(url)


def _sql_url(u: str) -> str:
    base = f"regexp_extract(regexp_replace({u}, '#.*$', ''), '^[^?]*', 0)"
    kept = f"list_filter(string_split(regexp_extract(regexp_replace({u}, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^{_TRACK}$'))"
    return f"CASE WHEN regexp_matches({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+') THEN CASE WHEN len({kept}) > 0 THEN concat({base}, '?', array_to_string({kept}, '&')) ELSE {base} END ELSE {u} END"


def domain(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host_of(url), r":\d+$", ""), r"^www\.", "")


def url_canonicalisation(rows: DataFrame) -> DataFrame:
    """(url, domain, first_id, n_dupes): one row for each canonical URL of (id, url)."""
    c = rows.select("id", normal_url(F.col("url")).alias("url"))
    return c.groupBy("url").agg(F.min("id").alias("first_id"), (F.count("*") - 1).alias("n_dupes")).withColumn("domain", domain(F.col("url")))


_HOST = "regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)', 1)), ':\\d+$', ''), '^www\\.', '')"
register(
    "url_canonicalisation", "v_articles", url_canonicalisation,
    f"WITH c AS (SELECT id, {_sql_url('url')} AS url FROM v_articles) SELECT url, min(id) AS first_id, count(*) - 1 AS n_dupes, {_HOST} AS domain FROM c GROUP BY url",
)


def clean(c: Column) -> Column:
    """Text of a piece of HTML: tags to spaces, the common entities, white space to one space."""
    t = F.regexp_replace(c, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n\f]+", " "))


def _sql_clean(c: str) -> str:
    t = f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"
    for name, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = f"replace({t}, '{name}', '{char}')"
    return f"trim(regexp_replace({t}, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ')"


#: Link texts that name no article, and parts of paths that lead to none.
GENERIC_TEXT = ["read more", "learn more", "continue reading", "view all", "subscribe", "watch", "listen"]
NO_ARTICLE = ["/profile/", "/profiles/", "/tag/", "/category/", "/topics/", "/topic/", "/authors/", "/author/", "/people/", "/person/", "/experts/", "/expert/", "/staff/", "/team/", "/about/", "/bio/", "/search"]
FILES = r"(?i)\.(jpg|png|pdf)$"


def generic_link_text(c: Column) -> Column:
    """Whether a link's text says nothing of what it leads to."""
    t = F.lower(F.coalesce(c, F.lit("")))
    return (F.length(t) < 12) | t.rlike("|".join(GENERIC_TEXT))


def title_from_url(url: Column) -> Column:
    """A headline from the last part of a URL's path; empty without one."""
    slug = F.regexp_extract(path_of(url), r"([^/]*)/*$", 1)
    spaced = F.regexp_replace(F.regexp_replace(slug, "[-_]+", " "), r"(?i)\.[a-z0-9]+$", "")
    raw = F.coalesce(F.try_url_decode(F.replace(spaced, F.lit("+"), F.lit("%2B"))), spaced)
    return F.coalesce(headline(F.trim(F.regexp_replace(raw, r"[ \t\r\n\f]+", " "))), F.lit(""))


def likely_article_path(path: Column) -> Column:
    """Whether a path may be an article's: no list, person or file, and no section's index unless it says so."""
    low = F.lower(path)
    segments = F.filter(F.split(low, "/"), lambda x: x != "")
    first, second = F.coalesce(F.get(segments, F.lit(0)), F.lit("")), F.coalesce(F.get(segments, F.lit(1)), F.lit(""))
    plain = ~first.contains("-") & ~first.rlike("[0-9]") & (F.length(first) <= 24)
    index = (F.size(segments) == 0) | ((F.size(segments) == 1) & (first.isin(P.SECTION_SEGMENTS) | plain)) | ((F.size(segments) == 2) & first.isin(P.SECTION_SEGMENTS) & ~second.rlike("[0-9]") & ~second.contains("-"))
    return ~low.rlike("|".join(NO_ARTICLE)) & ~low.rlike(FILES) & (~index | low.rlike(P.ARTICLE_PATH)) & ~path.isin("", "/")


def page_links(pages: DataFrame, max_anchors: int = 400) -> DataFrame:
    """(page_id, url, title): article links of each page (page_id, url, html), on its own site, each normalised URL once.

    A link's title is its text, else its title attribute, else made from the URL; links without a telling one are left out. Of the first
    anchors only, as a section page lists its articles there; pass a larger number for whole link farms.
    """
    anchors = F.slice(F.regexp_extract_all("html", F.lit(r"""(?is)(<a\s[^>]*href\s*=\s*(?:"[^"]*"|'[^']*')[^>]*>.*?</a>)"""), F.lit(1)), 1, max_anchors)
    rows = pages.select("page_id", F.col("url").alias("page"), F.posexplode(anchors).alias("pos", "a"))
    quoted = lambda name: F.regexp_replace(F.regexp_extract("a", rf"""(?is){name}\s*=\s*("[^"]*"|'[^']*')""", 1), "^.|.$", "")
    origin = F.regexp_extract("page", r"^[a-zA-Z]+://[^/?#]+", 0)
    rows = rows.withColumns({"href": quoted("href"), "named": clean(quoted(r"\stitle"))}).where((F.col("href") != "") & ~F.lower("href").rlike("^(#|mailto:|javascript:)"))
    full = F.when(F.col("href").rlike("^[a-zA-Z]+://"), F.col("href")).when(F.col("href").startswith("//"), F.concat(F.lit("https:"), "href")).when(F.col("href").startswith("/"), F.concat(origin, "href")).otherwise(F.concat(origin, F.lit("/"), "href"))
    rows = rows.withColumns({"url": normal_url(full), "text": clean(F.col("a"))})
    same = (host_of(F.col("url")) == host_of(F.col("page"))) | host_of(F.col("url")).endswith(F.concat(F.lit("."), domain(F.col("page"))))
    rows = rows.where(same & likely_article_path(path_of(F.col("url"))))
    poor = generic_link_text(F.col("text")) | (F.length("text") > 160) | (F.size(F.split("text", " ")) > 24)
    title = F.when(~poor, F.col("text")).when(~generic_link_text(F.col("named")) & (F.length("named") <= 160), F.col("named")).otherwise(title_from_url(F.col("url")))
    rows = rows.withColumn("title", title).where(~generic_link_text(F.col("title")))
    return rows.groupBy("page_id", "url").agg(F.min_by("title", "pos").alias("title"))


def _links_sql() -> str:
    from storyloom.functions.headline import sql_headline

    generic = lambda c: f"(length({c}) < 12 OR regexp_matches(lower({c}), '{'|'.join(GENERIC_TEXT)}'))"
    segs = ", ".join(f"'{x}'" for x in P.SECTION_SEGMENTS)
    path = "lower(regexp_extract(url, '://[^/?#]+(/[^?#]*)', 1))"
    index = f"(len(seg) = 0 OR (len(seg) = 1 AND (seg[1] IN ({segs}) OR (NOT contains(seg[1], '-') AND NOT regexp_matches(seg[1], '[0-9]') AND length(seg[1]) <= 24))) OR (len(seg) = 2 AND seg[1] IN ({segs}) AND NOT regexp_matches(seg[2], '[0-9]') AND NOT contains(seg[2], '-')))"
    quoted = lambda name: f"regexp_replace(regexp_extract(a, '(?is){name}\\s*=\\s*(\"[^\"]*\"|''[^'']*'')', 1), '^.|.$', '', 'g')"
    return f"""WITH x AS (SELECT page_id, url AS page, regexp_extract_all({_VARIED_HTML}, '(?is)(<a\\s[^>]*href\\s*=\\s*(?:"[^"]*"|''[^'']*'')[^>]*>.*?</a>)', 1)[1:400] AS l FROM pages), a AS (SELECT page_id, page, generate_subscripts(l, 1) AS pos, unnest(l) AS a FROM x),
    h AS (SELECT *, {quoted('href')} AS href, {_sql_clean(quoted(chr(92) + 'stitle'))} AS named, regexp_extract(page, '^[a-zA-Z]+://[^/?#]+', 0) AS origin FROM a), f AS (SELECT *, CASE WHEN regexp_matches(href, '^[a-zA-Z]+://') THEN href WHEN href LIKE '//%' THEN concat('https:', href) WHEN href LIKE '/%' THEN concat(origin, href) ELSE concat(origin, '/', href) END AS raw FROM h
    WHERE href <> '' AND NOT regexp_matches(lower(href), '^(#|mailto:|javascript:)')), u AS (SELECT *, {_sql_url('raw')} AS url, {_sql_clean('a')} AS text FROM f), v AS (SELECT *, {path} AS p, list_filter(string_split({path}, '/'), lambda x: x <> '') AS seg FROM u WHERE lower(regexp_extract(url, '://([^/?#]+)', 1)) = lower(regexp_extract(page, '://([^/?#]+)', 1))),
    w AS (SELECT *, row_number() OVER () AS rid, {generic('text')} OR length(text) > 160 OR len(string_split(text, ' ')) > 24 AS poor FROM v WHERE p NOT IN ('', '/') AND NOT regexp_matches(p, '{'|'.join(NO_ARTICLE)}') AND NOT regexp_matches(p, '{FILES}') AND (NOT {index} OR regexp_matches(p, '{P.ARTICLE_PATH}'))),
    s AS (SELECT rid AS id, trim(regexp_replace(url_decode(regexp_replace(regexp_replace(regexp_extract(regexp_extract(url, '://[^/?#]+(/[^?#]*)', 1), '([^/]*)/*$', 1), '[-_]+', ' ', 'g'), '(?i)\\.[a-z0-9]+$', '')), '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ') AS title FROM w), hd AS ({sql_headline('s')}),
    k AS (SELECT page_id, url, pos, CASE WHEN NOT poor THEN text WHEN NOT {generic('named')} AND length(named) <= 160 THEN named ELSE coalesce(headline, '') END AS title FROM w LEFT JOIN hd ON hd.id = rid)
    SELECT page_id, url, arg_min(title, pos) AS title FROM k WHERE NOT {generic('title')} GROUP BY page_id, url"""


#: The landed pages link to bare words: paths of articles, and telling texts and titles for some.
_VARIED_HTML = "replace(replace(replace(html, '<a href=\"/', '<a href=\"/news/2024/05/the-story-of-'), 'story-of-t', 'big_story%20of-t'), 'href=\"/news/2024/05/the-story-of-a', 'title=\"A named story of the day\" href=\"/news/2024/05/the-story-of-a')"
register("page_links", "pages", lambda p: page_links(p.withColumn("html", F.expr(_VARIED_HTML))), _links_sql())


def _meta(names: str) -> Column:
    a = F.regexp_extract("html", rf'(?is)<meta\s[^>]*(?:name|property)\s*=\s*"(?:{names})"[^>]*content\s*=\s*"([^"]*)"', 1)
    b = F.regexp_extract("html", rf'(?is)<meta\s[^>]*content\s*=\s*"([^"]*)"[^>]*(?:name|property)\s*=\s*"(?:{names})"', 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def page_lede(pages: DataFrame, least: int = 40) -> DataFrame:
    """(page_id, lede): the description if long enough, else the first long paragraph of five in the article, else the short description."""
    meta = clean(_meta("description|og:description|twitter:description"))
    body = F.regexp_extract("html", r"(?is)<article[^>]*>(.*?)</article>", 1)
    paragraphs = F.slice(F.regexp_extract_all(body, F.lit(r"(?is)(<p[^a-z].*?)</p>"), F.lit(1)), 1, 5)
    long = F.get(F.filter(F.transform(paragraphs, clean), lambda p: F.length(p) >= least), F.lit(0))
    return pages.select("page_id", F.coalesce(F.when(F.length(meta) >= least, meta), long, meta).alias("lede"))


register(
    "page_lede", "pages", page_lede,
    f"SELECT page_id, list_filter(list_transform(regexp_extract_all(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '(?is)(<p[^a-z].*?)</p>', 1)[1:5], lambda p: {_sql_clean('p')}), lambda p: length(p) >= 40)[1] AS lede FROM pages",
)


def page_title(pages: DataFrame) -> DataFrame:
    """(page_id, title, context): the social title, else the page's; three paragraphs of 50 characters as context."""
    title = F.coalesce(_meta("og:title"), _meta("twitter:title"), F.nullif(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")))
    texts = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)(<p[^a-z].*?)</p>"), F.lit(1)), clean)
    return pages.select("page_id", clean(title).alias("title"), F.array_join(F.slice(F.filter(texts, lambda p: F.length(p) >= 50), 1, 3), " ").alias("context"))


register(
    "page_title", "pages", page_title,
    f"SELECT page_id, {_sql_clean('''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')} AS title, coalesce(array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)(<p[^a-z].*?)</p>', 1), lambda p: {_sql_clean('p')}), lambda p: length(p) >= 50)[1:3], ' '), '') AS context FROM pages",
)


def page_canonical_url(pages: DataFrame) -> DataFrame:
    """(page_id, canonical_url): the page's canonical link, resolved, else its own normalised URL."""
    link = F.regexp_extract("html", r'(?is)<link\s[^>]*rel\s*=\s*"canonical"[^>]*>', 0)
    href = F.nullif(F.regexp_extract(link, r'(?i)href\s*=\s*"([^"]*)"', 1), F.lit(""))
    origin = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+", 0)
    full = F.when(href.rlike("^[a-zA-Z]+://"), href).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(origin, F.lit("/"), href))
    return pages.select("page_id", F.coalesce(normal_url(full), normal_url(F.col("url"))).alias("canonical_url"))


register("page_canonical_url", "pages", page_canonical_url, f"SELECT page_id, {_sql_url('url')} AS canonical_url FROM pages")


def feed_items_scan(spark, path: str, cap: int = 100, discovery_cap: int = 40, discovery: str | None = None) -> DataFrame:  # noqa: ANN001
    """(feed, title, link, snippet, published, pos) of landed RSS and Atom documents, the first `cap` items of each file, and of those whose
    path matches `discovery` the first `discovery_cap`."""
    from pyspark.sql.window import Window

    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    entries = spark.read.format("xml").option("rowTag", "entry").schema("title string, link array<struct<_href string, _rel string>>, summary string, content string, published string, updated string").load(path)
    own = F.coalesce(F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get("link", F.lit(0)))["_href"]
    atom = entries.select("title", own.alias("link"), F.coalesce("summary", "content").alias("description"), F.coalesce("published", "updated").alias("pubDate"))
    numbered = lambda df: df.withColumn("feed", F.input_file_name()).withColumn("n", F.monotonically_increasing_id())
    rows = numbered(items).unionByName(numbered(atom))
    most = F.when(F.col("feed").rlike(discovery), discovery_cap).otherwise(cap) if discovery else F.lit(cap)
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("feed").orderBy("n"))).where(F.col("pos") <= most)
    return rows.select("feed", "title", "link", clean(F.col("description")).alias("snippet"), F.col("pubDate").alias("published"), "pos")


def _landed_feed(articles: DataFrame) -> DataFrame:
    """Articles landed as one feed document for each source in the shared folder, and scanned from there."""
    from storyloom.streaming.jobs import folder

    path = f"{folder(articles.sparkSession)}/feeds"
    flat = lambda c: F.regexp_replace(F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", ""), r"\s+", " ")
    items = articles.where("trim(title) <> ''").select("source_id", "id", flat("title").alias("title"), F.col("url").alias("link"), flat("summary").alias("description"))
    items.repartition("source_id").sortWithinPartitions("source_id", "id").drop("id").write.partitionBy("source_id").format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    found = feed_items_scan(articles.sparkSession, f"{path}/*/*", discovery="source_id=src[0-9]*[02468]/")
    return found.select(F.regexp_extract("feed", "source_id=([^/]*)/", 1).alias("feed"), "title", "link", "snippet", "pos")


register(
    "feed_items_scan", "v_articles", _landed_feed,
    f"""SELECT feed, title, link, snippet, pos FROM (SELECT source_id AS feed, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, url AS link, {_sql_clean('summary')} AS snippet, CAST(row_number() OVER (PARTITION BY source_id ORDER BY id) AS INT) AS pos FROM v_articles WHERE trim(title) <> '')
    WHERE pos <= CASE WHEN CAST(substr(feed, 4) AS INT) % 2 = 0 THEN 40 ELSE 100 END""",
)
