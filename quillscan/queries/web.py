"""Queries over web assets: the pages table besides sample pages, sheets and scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata_web as W
from ..catalog import _q, _values, query
from ..operators import web_assets as A

_SAMPLES = [
    (-1, '<script src="https://cdnjs.cloudflare.com/ajax/libs/jquery/3.6.0/jquery.min.js" integrity="sha384-x"></script>\n<link href=\'https://unpkg.com/swiper@8.4.5/swiper.css\' rel="stylesheet">\n<script src="https://cdn.jsdelivr.net/npm/vue@3.2.0/dist/vue.js"></script>'),
    (-2, '<link href="https://fonts.googleapis.com/css?family=Open+Sans:400&family=My+Font">\n<script src="https://use.typekit.net/a.js"></script>\n<meta property="og:image" content="https://x.example/i.png">\n<i class="fas fa-home"></i>\n<i class="fal fa-user"></i><i class="bi bi-x"></i>\n<script src="https://www.google-analytics.com/a.js"></script>'),
    (-3, "/* Bootstrap v4.5.2 */ .container-fluid {} body { font-family: 'Helvetica'; }\n@font-face { font-family: 'Gotham'; src: url('gotham.woff'); }\n@font-face { font-family: Inter; src: local(Inter); } /* Futura */ @tailwind base;"),
    (-4, "const p = require('puppeteer'); import x from \"cheerio\"; "),
    (-5, "b { background: url(data:image/png;base64," + "A" * 1500 + ") } i { background: url('data:font/woff2;base64,AAAA') }"),
    (-6, '{"version": 3, "sources": ["src/a.js", "node_modules/b/index.js", "vendor/c.js"]}'),
]
_ALL = f"pages2 AS (SELECT page_id AS key, html AS text FROM pages UNION ALL SELECT * FROM ({_values(_SAMPLES)}) v(key, text))"
_LINED = "lined AS (SELECT key, line, lower(line) AS low, i AS line_no FROM (SELECT key, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS i FROM pages2))"


def _pages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("key"), F.col("html").alias("text"))
    return rows.unionByName(spark.createDataFrame(_SAMPLES, "key long, text string"))


_URL = "coalesce(" + ", ".join(f"nullif(regexp_extract(line, '(?i){a}={q}([^{q}]*){q}', 1), '')" for q in ('"', "''") for a in ("src", "href")) + ")"
_CDN = f"""h(host, provider) AS ({_values(W.CDN_HOSTS)}), k(n, name, licence) AS ({_values([(i, *r) for i, r in enumerate(W.CDN_LICENCES)])}),
c AS (SELECT key, line_no, provider, low, line, coalesce({_URL}, '') AS url FROM lined JOIN h ON contains(low, host)),
d AS (SELECT *, CASE WHEN contains(url, 'cdnjs.cloudflare.com') AND len(string_split(url, '/')) > 5 THEN string_split(url, '/')[6] WHEN contains(url, 'cdn.jsdelivr.net') AND contains(url, '@') THEN regexp_extract(url, '(?:^|/)([^/@]*)@[^/]*', 1) WHEN contains(url, 'unpkg.com') AND len(string_split(url, '/')) > 3 THEN string_split(string_split(url, '/')[4], '@')[1] END AS library,
  CASE WHEN regexp_matches(url, '@[0-9]') THEN regexp_extract(url, '@([0-9][^/@]*)(?:/[^@]*)?$', 1) ELSE list_filter(string_split(url, '/'), lambda p: regexp_matches(p, '^[0-9]') AND contains(p, '.'))[1] END AS version FROM c),
cdn AS (SELECT key, line_no, provider, url, library, version, (SELECT arg_min(k.licence, k.n) FROM k WHERE contains(lower(library), k.name)) AS licence,
  CASE WHEN contains(low, '.css') OR contains(low, 'stylesheet') THEN 'Css' WHEN contains(low, '.js') OR contains(low, 'script') THEN 'JavaScript' WHEN regexp_matches(low, '[.](woff|ttf|otf)') THEN 'Font' ELSE 'Other' END AS resource,
  nullif(regexp_extract(line, '(?i)integrity="([^"]*)"', 1), '') AS integrity FROM d)"""


@query(f"WITH {_ALL}, {_LINED}, {_CDN} SELECT * FROM cdn")
def cdn_references(spark, sf_dir):
    return A.cdn_references(_pages(spark, sf_dir))


@query(f"WITH {_ALL}, {_LINED}, {_CDN} SELECT * FROM cdn WHERE integrity IS NULL AND resource IN ('Css', 'JavaScript')")
def missing_integrity(spark, sf_dir):
    return A.missing_integrity(_pages(spark, sf_dir))


@query(
    f"""WITH {_ALL}, {_LINED}, g(name, licence) AS ({_values([(n.lower(), v) for n, v in W.GOOGLE_FONTS])}),
    f AS (SELECT key, line_no, replace(split_part(split_part(unnest(string_split({_URL}, 'family=')[2:]), '&', 1), ':', 1), '+', ' ') AS font FROM lined WHERE (contains(low, 'fonts.googleapis.com') OR contains(low, 'fonts.gstatic.com')) AND {_URL} IS NOT NULL)
    SELECT key, line_no, font, coalesce(g.licence, 'OFL') AS licence FROM f LEFT JOIN g ON g.name = lower(font) WHERE font <> '' UNION ALL SELECT key, line_no, 'Adobe Fonts', 'Commercial' FROM lined WHERE contains(low, 'use.typekit.net') OR contains(low, 'use.typekit.com')"""
)
def hosted_fonts(spark, sf_dir):
    return A.hosted_fonts(_pages(spark, sf_dir))


@query(f"WITH {_ALL}, {_LINED} SELECT key, kind, coalesce(nullif(regexp_extract(line, '(?i)content=\"([^\"]*)\"', 1), ''), nullif(regexp_extract(line, '(?i)content=''([^'']*)''', 1), '')) AS url FROM lined JOIN ({_values(W.META_IMAGES)}) m(mark, kind) ON contains(low, mark) WHERE url IS NOT NULL")
def meta_images(spark, sf_dir):
    return A.meta_images(_pages(spark, sf_dir))


@query(f"WITH {_ALL}, {_LINED} SELECT key, library, CASE WHEN bool_or(tier = 'Pro') THEN 'Pro' ELSE 'Free' END AS tier, count(*) AS \"references\" FROM lined JOIN ({_values(W.ICONS)}) i(mark, library, tier) ON contains(low, mark) GROUP BY key, library")
def icon_libraries(spark, sf_dir):
    return A.icon_libraries(_pages(spark, sf_dir))


@query(f"WITH {_ALL} SELECT DISTINCT key, provider, concern FROM pages2 JOIN ({_values(W.TRACKERS)}) t(host, provider, concern) ON contains(lower(text), host)")
def page_trackers(spark, sf_dir):
    return A.trackers(_pages(spark, sf_dir))


@query(
    f"WITH {_ALL}, f AS (SELECT key, framework, licence, nullif(regexp_extract(regexp_extract(lower(left(text, 500)), '^[^v]*(v(?:ersion)?[ ]?[0-9.]*)', 1), '([0-9][0-9.]*)$', 1), '') AS version FROM pages2 JOIN ({_values(W.CSS_FRAMEWORKS)}) c(mark, framework, licence) ON contains(lower(text), mark)) SELECT framework, licence, arg_min(version, key) FILTER (WHERE key = least_key) AS version, min(key) AS key FROM (SELECT *, min(key) OVER (PARTITION BY framework) AS least_key FROM f) GROUP BY framework, licence"
)
def css_frameworks(spark, sf_dir):
    return A.css_frameworks(_pages(spark, sf_dir))


_COMMERCIAL = "(" + " OR ".join(f"contains({{0}}, {_q(f.lower())})" for f in W.COMMERCIAL_FONTS) + ")"


@query(
    f"""WITH {_ALL}, b AS (SELECT key, unnest(regexp_extract_all(lower(text), '@font-face[^}}]*\\}}')) AS b FROM pages2 WHERE contains(lower(text), '@font-face')),
    f AS (SELECT key, coalesce(nullif(trim(translate(nullif(trim(regexp_extract(b, 'font-family:([^;}}]*)', 1)), ''), '''"', '')), ''), 'Unknown') AS font, CASE WHEN contains(b, 'fonts.googleapis.com') OR contains(b, 'fonts.gstatic.com') THEN 'GoogleFonts' WHEN contains(b, 'use.typekit.') THEN 'AdobeFonts' WHEN contains(b, 'url(') THEN 'FontFaceUrl' WHEN contains(b, 'local(') THEN 'FontFaceLocal' ELSE 'Bundled' END AS origin FROM b)
    SELECT key, font, origin, CASE WHEN origin = 'GoogleFonts' THEN 'OFL' WHEN origin = 'AdobeFonts' OR {_COMMERCIAL.format('lower(font)')} THEN 'Commercial' END AS licence FROM f"""
)
def font_faces(spark, sf_dir):
    return A.font_faces(_pages(spark, sf_dir))


@query(f"WITH {_ALL} SELECT key, font FROM (SELECT key, font, lower(text) AS low, left(lower(text), instr(lower(text), lower(font)) - 1) AS before FROM pages2 JOIN ({_values([(f,) for f in W.COMMERCIAL_FONTS])}) c(font) ON contains(lower(text), lower(font)) WHERE contains(lower(text), 'font-family')) WHERE NOT contains(regexp_replace(before, '/\\*.*?\\*/', '', 'gs'), '/*')")
def commercial_fonts(spark, sf_dir):
    return A.commercial_fonts(_pages(spark, sf_dir))


@query(f"WITH {_ALL}, d AS (SELECT key, unnest(regexp_extract_all(text, {_q('(?i)(?:' + '|'.join(p.replace('+', chr(92) + '+') for p in W.DATA_PREFIXES) + ')' + '[^' + chr(34) + chr(39) + ')]*')})) AS d FROM pages2) SELECT key, lower(regexp_extract(d, '(?i)^data:([^;]*);', 1)) AS mime, (length(d) - instr(d, ',')) * 3 // 4 AS size FROM d WHERE length(d) - instr(d, ',') > 1000")
def embedded_assets(spark, sf_dir):
    return A.embedded_assets(_pages(spark, sf_dir))


_USES = " OR ".join(f"contains(lower(text), {_q(w + q)} || lib || {_q(q)})" for q in "'\"" for w in ("require(", "from ", "import "))


@query(f"WITH {_ALL} SELECT key, lib AS library FROM pages2 JOIN ({_values([(s,) for s in W.SCRAPERS])}) s(lib) ON {_USES}")
def scraping_libraries(spark, sf_dir):
    return A.scraping_libraries(_pages(spark, sf_dir))


@query(
    f"""WITH {_ALL}, n AS (SELECT count_if(contains(lower(text), 'robots') AND regexp_matches(lower(text), 'ignore|bypass|skip')) AS i, count_if(regexp_matches(lower(text), 'robots[.]txt|robotstxt|robots_parser|robotparser')) AS heeds FROM pages2),
    u AS (SELECT count(*) AS u FROM pages2 JOIN ({_values([(s,) for s in W.SCRAPERS])}) s(lib) ON {_USES})
    SELECT finding, scripts FROM (SELECT unnest(['UsesScrapingLibrary', 'IgnoresRobots', 'ScraperWithoutRobotsCheck']) AS finding, unnest([u, i, CASE WHEN u > 0 AND i = 0 AND heeds = 0 THEN 1 ELSE 0 END]) AS scripts FROM n, u) WHERE scripts > 0"""
)
def robots_findings(spark, sf_dir):
    return A.robots_findings(_pages(spark, sf_dir))


@query("SELECT -6 AS key, 3 AS sources, 2 AS third_party")
def source_map_sources(spark, sf_dir):
    return A.source_maps(_pages(spark, sf_dir)).withColumn("key", F.col("key").cast("int"))
