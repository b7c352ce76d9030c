"""Queries on the text tables: rules, sweeps, indicators, searches, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators
from ..operators import entities, findings, grid, sigma
from .catalog import query, table

RULES = [
    {"title": "German page", "level": "low", "detection": {"sel": {"url|contains": "/de/"}, "condition": "sel"}},
    {"title": "Mobile host without anchor", "level": "medium", "detection": {"host": {"url|startswith": ["http://m.", "https://m."]}, "anchor": {"url|contains": "#"}, "condition": "host and not anchor"}},
    {"title": "Org site in Spanish or French", "level": "high", "detection": {"org": {"url|contains": ".example.org/"}, "l_es": {"url|contains": "/es/"}, "l_fr": {"url|contains": "/fr/"}, "condition": "org and 1 of l_*"}},
    {"title": "Top anchor, any case", "level": "critical", "detection": {"a": {"url|endswith": "#TOP"}, "b": {"url": "HTTP*://*TH*"}, "condition": "all of them"}},
]


@query("""
WITH h AS (
  SELECT page_id, url, 'German page' AS rule, 'LOW' AS severity FROM pages WHERE contains(lower(url), '/de/')
  UNION ALL SELECT page_id, url, 'Mobile host without anchor', 'MEDIUM' FROM pages WHERE (lower(url) LIKE 'http://m.%' OR lower(url) LIKE 'https://m.%') AND NOT contains(url, '#')
  UNION ALL SELECT page_id, url, 'Org site in Spanish or French', 'HIGH' FROM pages WHERE contains(lower(url), '.example.org/') AND (contains(lower(url), '/es/') OR contains(lower(url), '/fr/'))
  UNION ALL SELECT page_id, url, 'Top anchor, any case', 'CRITICAL' FROM pages WHERE lower(url) LIKE '%#top' AND lower(url) LIKE 'http%://%th%'
), r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY page_id) AS rank, count(*) OVER (PARTITION BY rule) AS count FROM h)
SELECT rule, severity, page_id, url, rank, count FROM r WHERE rank <= 200
""")
def sigma_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return sigma.matches(pages, RULES, ["page_id"])[0].select("rule", "severity", "page_id", "url", "rank", "count")


WORDS = {"idiot": "insult", "scum": "insult", "password": "secret", "token": "secret", "license": "legal", "copyright": "legal"}


@query(f"""
WITH k AS (SELECT * FROM (VALUES {", ".join(f"('{w}', '{c}')" for w, c in WORDS.items())}) v(word, category))
SELECT word, category, count(*) AS documents, min(doc_id) AS first_doc, max(doc_id) AS last_doc
FROM documents JOIN k ON regexp_matches(lower(text), '(^|[^a-z0-9_])' || word || '($|[^a-z0-9_])') GROUP BY word, category
""")
def keyword_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.sweeps import keyword_hits

    hits = keyword_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", WORDS)
    return hits.groupBy("word", "category").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("""
WITH h AS (
  SELECT 'documents' AS t, CAST(doc_id AS VARCHAR) AS k FROM documents WHERE contains(lower(text), 'license')
  UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR) FROM pages WHERE contains(lower(concat_ws(' ', CAST(page_id AS VARCHAR), url, html)), 'license')
  UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) FROM conversations WHERE contains(lower(text), 'license')
)
SELECT t AS "table", count(*) AS matches, min(k) AS first_key FROM h GROUP BY t
""")
def pivot_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), "text")
    hits = grid.search_all({"documents": (d, "doc_id"), "pages": (p, "page_id"), "conversations": (c, "key")}, "license", sample=5)
    return hits.groupBy("table").agg(F.max("matches").alias("matches"), F.min("key").alias("first_key"))


@query("""
WITH f AS (
  SELECT doc_id, 'email' AS kind, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+'))) AS value FROM documents
  UNION ALL SELECT doc_id, 'ipv4', unnest(list_distinct(regexp_extract_all(text, '(?:[0-9]{1,3}\\.){3}[0-9]{1,3}'))) FROM documents
  UNION ALL SELECT doc_id, 'url', unnest(list_distinct(regexp_extract_all(text, 'https?://[^\\s"''<>|]+'))) FROM documents
)
SELECT kind, value, count(*) AS documents, min(doc_id) AS first_doc FROM f GROUP BY kind, value
""")
def ioc_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(indicators.found(F.col("text"))).alias("f"))
    return found.groupBy("f.kind", "f.value").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


@query("SELECT md5(text) AS digest, lang, count(*) AS occurrences, min(doc_id) AS first_doc_id FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def dedup_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("digest"))
    return entities.collapse(d, ["digest", "lang"], "doc_id").where("occurrences > 1")


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, octet_length(encode(text)) AS size FROM documents")
def hash_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(raw).alias("md5"), F.sha1(raw).alias("sha1"), F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).cast("long").alias("size"))


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', '') AS path FROM pages)
SELECT page_id, host, regexp_extract(path, '^(.*)/', 1) AS directory, string_split(path, '/')[-1] AS basename FROM p
""")
def path_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+", ""), "[?#].*$", "")
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), path.alias("path"))
    return p.select("page_id", "host", indicators.dirname(F.col("path")).alias("directory"), indicators.basename(F.col("path")).alias("basename"))


@query("""
SELECT page_id, CASE WHEN contains(lower(html), 'track(') AND contains(lower(url), 'm.') THEN 'tracked mobile' WHEN contains(lower(html), 'track(') THEN 'tracked' WHEN contains(lower(url), '.org') THEN 'org' END AS description,
  CASE WHEN contains(lower(html), 'track(') AND contains(lower(url), 'm.') THEN 'HIGH' WHEN contains(lower(html), 'track(') THEN 'MEDIUM' WHEN contains(lower(url), '.org') THEN 'LOW' END AS severity
FROM pages
""")
def first_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    hay = F.concat_ws(" ", F.lower("url"), F.lower("html"))
    match = findings.first_match(hay, [(r"(?s)^\S*m\.\S* .*track\(", "tracked mobile", "HIGH"), (r"track\(", "tracked", "MEDIUM"), (r"^\S*\.org", "org", "LOW")])
    return table(spark, sf_dir, "pages").select("page_id", match.alias("m")).select("page_id", "m.description", "m.severity")


@query("""
WITH e AS (SELECT page_id, 'host:' || regexp_extract(url, '^https?://([^/]+)', 1) AS a, 'lang:' || regexp_extract(url, '/([a-z][a-z])/', 1) AS b FROM pages)
SELECT a, b, count(*) AS n FROM e WHERE a <> 'host:' AND b <> 'lang:' GROUP BY a, b
""")
def relationship_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "/([a-z][a-z])/", 1).alias("lang"))
    edges = grid.relationship_graph(p, {"host": "host", "lang": "lang"}, "page_id")[1]
    return edges.select(F.concat_ws(":", "kind_a", "a").alias("a"), F.concat_ws(":", "kind_b", "b").alias("b"), "n")
