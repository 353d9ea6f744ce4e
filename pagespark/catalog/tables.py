"""Test tables: the given ones, and ones derived from them by SQL that Spark and DuckDB both run.

The derivations fill operators that the given tables would leave empty (buttons, forms, logs,
code).  They work row by row or in groups of fixed size, so they grow with the given tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN = {"pages", "events", "lineitem", "orders", "part"}

# Placeholders for the few expressions that the two dialects write differently.
_DIALECT = {
    "spark": {
        "DIV": "div",
        "MICROS": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)",
        "FILE_TEXT": "listagg(src, chr(10)) WITHIN GROUP (ORDER BY p_partkey)",
        "PARTS_X_REFS": "(SELECT *, explode(array('base', 'head')) AS ref FROM part) r",
        "PAGES_X_STEPS": "(SELECT page_id, explode(sequence(0, 120)) AS ix FROM pages) s",
    },
    "duckdb": {
        "DIV": "//",
        "MICROS": "date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts)",
        "FILE_TEXT": "string_agg(src, chr(10) ORDER BY p_partkey)",
        "PARTS_X_REFS": "(SELECT *, unnest(['base', 'head']) AS ref FROM part) r",
        "PAGES_X_STEPS": "(SELECT page_id, unnest(range(0, 121)) AS ix FROM pages) s",
    },
}

DERIVED = {
    "pages_aug": """
SELECT page_id, url,
  replace(replace(replace(html, '<title>',
      concat('<title>', CASE WHEN page_id % 13 = 0 THEN 'Just a moment ' ELSE '' END)),
    '</head>', concat(
      CASE WHEN page_id % 2 = 0 THEN '<meta name="description" content="d"><meta property="og:title" content="t">' ELSE '' END,
      CASE WHEN page_id % 10 = 0 THEN '<meta name="robots" content="noindex,nofollow">' ELSE '' END,
      CASE WHEN page_id % 4 = 0 THEN '<link rel="stylesheet" href="/s.css" type="text/css">' ELSE '' END,
      CASE WHEN page_id % 9 = 0 THEN '<script>navigator.serviceWorker.register("/w.js")</script>' ELSE '' END,
      '</head>')),
    '</footer>', concat('</footer>',
      repeat('<button aria-expanded="false" class="x">More</button>', CAST(page_id % 4 AS INT)),
      CASE WHEN page_id % 3 = 0 THEN '<details id="d1"><summary>S</summary><p>in <button aria-expanded="false">n</button></p></details>' ELSE '' END,
      CASE WHEN page_id % 5 = 0 THEN '<form action="/search" method="post"><input name="q"><select name="s"></select></form>' ELSE '' END,
      CASE WHEN page_id % 7 = 0 THEN '<div role="button" onclick="go()" data-k="1">' || repeat('Go on ', 50) || 'end</div>' ELSE '' END,
      CASE WHEN page_id % 6 = 0 THEN '<div class="expandable" hidden>h</div>' ELSE '' END,
      '<main class="content">', repeat('word ', CAST(150 * (page_id % 5) AS INT)), '</main>',
      CASE WHEN page_id % 11 = 0 THEN '<div data-sitekey="k"></div>' ELSE '' END)) AS html
FROM pages""",
    "page_snapshots": """
SELECT page_id, 'initial' AS snapshot_type, url, html FROM pages
UNION ALL SELECT page_id, 'final' AS snapshot_type, url, html FROM pages_aug""",
    "layout": """
SELECT page_id, CAST(ix AS INT) AS nid, CAST(0 AS INT) AS x, CAST(20 * ix AS INT) AS y,
  CAST((page_id + ix) % 30 AS INT) AS width, CAST((7 * ix) % 25 AS INT) AS height, 'auto' AS z_index
FROM {PAGES_X_STEPS}""",
    "height_samples": """
SELECT page_id, CAST(ix AS INT) AS sample_ix,
  CAST(CASE WHEN page_id % 7 = 0 THEN ix ELSE 100 * least(ix, page_id % 40) + CASE WHEN page_id % 5 = 0 AND ix > 8 THEN 50 ELSE 0 END END AS INT) AS height
FROM {PAGES_X_STEPS}""",
    "request_log": """
SELECT page_id,
  concat(split_part(url, '?', 1), CASE page_id % 5 WHEN 0 THEN '/api/v1' WHEN 1 THEN '/data.JSON'
    WHEN 2 THEN '/graphql' WHEN 3 THEN '/style.css' ELSE '/x.png' END) AS url,
  CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN page_id % 5 < 3 THEN 'xhr' ELSE 'other' END AS resource_type
FROM pages""",
    # offsets are event times squeezed so that users fall into the three activity levels
    "mutation_log": """
SELECT user_id AS page_id, event_id AS seq,
  CAST({MICROS} {DIV} CASE user_id % 3 WHEN 0 THEN 260000000 WHEN 1 THEN 78000000 ELSE 13000000 END AS BIGINT) AS ts_ms,
  CASE event_type WHEN 'click' THEN 'attributes' WHEN 'view' THEN 'characterData'
    WHEN 'error' THEN NULL ELSE 'childList' END AS type,
  CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'DIV' ELSE 'SPAN' END AS target_tag
FROM events""",
    "interaction_log": """
SELECT l_orderkey AS page_id, concat('e', l_linenumber, '_', l_partkey, '_', l_suppkey) AS element_id,
  CAST(NULL AS VARCHAR(60)) AS parent_element_id, CAST(0 AS INT) AS depth, l_returnflag <> 'R' AS success,
  CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 'click' WHEN 2 THEN 'aria-expanded' ELSE 'details-open' END AS method,
  l_linestatus = 'F' AS content_changed
FROM lineitem
UNION ALL
SELECT l_orderkey AS page_id, concat('n', l_linenumber, '_', l_partkey, '_', l_suppkey) AS element_id,
  concat('e', l_linenumber, '_', l_partkey, '_', l_suppkey) AS parent_element_id, CAST(1 AS INT) AS depth,
  l_quantity > 10 AS success, 'click' AS method, TRUE AS content_changed
FROM lineitem WHERE l_linenumber % 3 = 0 AND l_linestatus = 'F' AND l_returnflag <> 'R'""",
    # eight parts make one file; every third file is the same in both refs
    "functions": """
SELECT CASE WHEN (p_partkey {DIV} 80) % 10 = 9 THEN concat('solo', p_partkey {DIV} 80) ELSE concat('org/r', p_partkey {DIV} 80) END AS repo,
  r.ref, concat('pkg/d', p_partkey {DIV} 800, '/m', p_partkey {DIV} 8, CASE WHEN (p_partkey {DIV} 8) % 10 = 0 THEN '.txt' ELSE '.py' END) AS path,
  p_partkey, concat('f_', p_partkey) AS name, p_partkey % 4 = 0 AS decorated,
  CASE WHEN p_partkey % 3 = 0 THEN concat('Doc ', p_partkey) END AS doc,
  CASE WHEN p_partkey % 5 = 1 THEN 'async_function' ELSE 'function' END AS node_type,
  (p_partkey {DIV} 8) % 19 = 0 AND r.ref = 'head' AS broken,
  concat(CASE WHEN p_partkey % 5 = 1 THEN 'async ' ELSE '' END, 'def f_', p_partkey, '(x):', chr(10),
    CASE WHEN p_partkey % 3 = 0 THEN concat('    \"\"\"Doc ', p_partkey, '\"\"\"', chr(10)) ELSE '' END, '    return x + ',
    CASE WHEN r.ref = 'head' AND p_partkey % 5 = 0 AND (p_partkey {DIV} 8) % 3 <> 0 THEN '2' ELSE '1' END) AS code,
  concat(CASE WHEN p_partkey % 4 = 0 THEN concat('@cache', chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 5 = 1 THEN 'async ' ELSE '' END, 'def f_', p_partkey, '(x):', chr(10),
    CASE WHEN p_partkey % 3 = 0 THEN concat('    \"\"\"Doc ', p_partkey, '\"\"\"', chr(10)) ELSE '' END, '    return x + ',
    CASE WHEN r.ref = 'head' AND p_partkey % 5 = 0 AND (p_partkey {DIV} 8) % 3 <> 0 THEN '2' ELSE '1' END, chr(10)) AS src
FROM {PARTS_X_REFS}
WHERE NOT (r.ref = 'base' AND (p_partkey {DIV} 8) % 13 = 1)
  AND NOT (r.ref = 'head' AND (p_partkey {DIV} 8) % 17 = 2)
  AND NOT ((p_partkey {DIV} 8) % 3 <> 0 AND (r.ref = 'base' AND p_partkey % 7 = 1 OR r.ref = 'head' AND p_partkey % 7 = 2))""",
    "file_versions": """
SELECT repo, ref, path, content, md5(content) AS blob_sha FROM (
  SELECT repo, ref, path, concat({FILE_TEXT}, CASE WHEN max(CASE WHEN broken THEN 1 ELSE 0 END) = 1 THEN 'def (' ELSE '' END) AS content
  FROM functions GROUP BY repo, ref, path) f""",
    "commits": """
SELECT concat('org/r', o_custkey {DIV} 10) AS repo, CAST(o_orderkey AS VARCHAR(20)) AS sha, o_orderkey AS seq,
  o_orderdate AS committed_at, concat('pkg/', replace(o_orderpriority, ' ', '_'), '.py') AS path,
  concat('order ', CAST(o_orderkey AS VARCHAR(20)), chr(10), chr(10), '  total ', o_orderstatus) AS message,
  concat('clerk ', o_custkey) AS author_name,
  CASE WHEN o_orderkey % 3 = 0 THEN 'bot' ELSE concat('clerk ', o_custkey) END AS committer_name
FROM orders""",
    "base_dates": """
SELECT repo, min(CASE WHEN seq % 3 = 0 THEN committed_at END) AS base_at FROM commits
GROUP BY repo HAVING min(CASE WHEN seq % 3 = 0 THEN committed_at END) IS NOT NULL AND count(*) % 10 <> 0""",
}

_WORD = re.compile(r"\b(?:FROM|JOIN)\s+(\w+)", re.I)


def _needed(sql: str, extra: dict[str, str]) -> list[str]:
    """Names of the derived tables a statement uses, dependencies first."""
    known, order = {**DERIVED, **extra}, []

    def visit(text: str) -> None:
        for name in _WORD.findall(text):
            if name in known and name not in order:
                visit(known[name])
                order.append(name)

    visit(sql)
    return order


def _fill(sql: str, engine: str) -> str:
    for k, v in _DIALECT[engine].items():
        sql = sql.replace("{" + k + "}", v)
    return sql


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    steps = [*_needed(DERIVED[name], {}), name]
    read = GIVEN & {t for step in steps for t in _WORD.findall(_fill(DERIVED[step], "spark"))}
    ctes = [f"{t} AS (SELECT * FROM parquet.`{folder}/{t}.parquet`)" for t in sorted(read)]
    ctes += [f"{t} AS ({_fill(DERIVED[t], 'spark')})" for t in steps]
    return spark.sql(f"WITH {', '.join(ctes)} SELECT * FROM {name}")


def mutation_log(spark: SparkSession, folder: str) -> DataFrame:
    flat = derived(spark, folder, "mutation_log")
    return flat.withColumn("target", F.struct(F.col("target_tag").alias("tag"))).drop("target_tag")


def commits(spark: SparkSession, folder: str) -> DataFrame:
    def person(name: str):
        mail = F.concat(F.replace(name, F.lit(" "), F.lit(".")), F.lit("@example.org"))
        return F.struct(F.col(name).alias("name"), mail.alias("email"))

    flat = derived(spark, folder, "commits")
    return flat.select(
        "repo", "sha", "seq", "committed_at", "path", "message",
        person("author_name").alias("author"), person("committer_name").alias("committer"),
    )


# -- building blocks of the DuckDB side only: tags found with regular expressions ------------------
def _stripped(html: str) -> str:
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    for t in ("script", "style"):
        out = f"regexp_replace({out}, '(?s)(<{t}[^>]*>).*?</{t}>', '\\1', 'g')"
    return out


def unescaped(s: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        s = f"replace({s}, '{entity}', '{char}')"
    return s


def text_in(s: str) -> str:
    return unescaped(f"regexp_replace({s}, '(?s)<[^>]*>', '', 'g')")


def _tags(table: str) -> str:
    attr = "nullif(regexp_extract(raw, ' {0}=\"([^\"]*)\"', 1), '')"
    return f"""
SELECT page_id, url, nid, upper(regexp_extract(raw, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, raw, {unescaped("substr(part, length(raw) + 1)")} AS txt,
  coalesce(regexp_extract(raw, ' class="([^"]*)"', 1), '') AS cls, coalesce(regexp_extract(raw, ' id="([^"]*)"', 1), '') AS id,
  {attr.format('href')} AS href, {attr.format('name')} AS name, {attr.format('property')} AS property, {attr.format('content')} AS content,
  {attr.format('rel')} AS rel, {attr.format('type')} AS type, {attr.format('aria-expanded')} AS aria, raw LIKE '% onclick=%' AS onclick,
  max(CASE WHEN raw LIKE '<body%' THEN nid END) OVER (PARTITION BY page_id) AS body_nid,
  max(CASE WHEN raw LIKE '%aria-expanded%' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id) = 1 AS page_aria,
  lag(raw, 2) OVER (PARTITION BY page_id ORDER BY nid) AS raw2
FROM (SELECT page_id, url, part, regexp_extract(part, '^<[^>]*>') AS raw, nid FROM (
  SELECT page_id, url, unnest(l) AS part, CAST(unnest(range(len(l))) AS INT) AS nid FROM (
    SELECT page_id, url, regexp_extract_all({_stripped('html')}, '<[a-zA-Z][^>]*>[^<]*') AS l FROM {table}) a) b) c"""


ORACLE_ONLY = {
    "tags": _tags("pages_aug"),
    "plain_tags": _tags("pages"),
    # what the markup of pages_aug says about visibility and expansion
    "seen": """
SELECT *, (nid = 0 OR nid >= body_nid) AND tag NOT IN ('SCRIPT', 'STYLE') AND raw NOT LIKE '% hidden%' AS visible,
  aria IS NOT NULL OR cls IN ('expandable', 'collapsible')
    OR page_aria AND (nid = 0 OR tag IN ('BODY', 'DETAILS') OR tag = 'P' AND coalesce(raw2, '') LIKE '<details%') AS expandable
FROM tags""",
    "snapshot": """SELECT * FROM seen WHERE nid >= body_nid""",
    "segments": f"""
SELECT page_id, url, html, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS article,
  regexp_extract(html, '(?s)<nav>(.*)</nav>', 1) AS nav,
  {text_in("regexp_extract(html, '(?s)<article>(.*)</article>', 1)")} AS article_text,
  {text_in("regexp_extract(html, '(?s)<nav>(.*)</nav>', 1)")} AS nav_text,
  {unescaped("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title_text,
  {unescaped("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS h1_text,
  regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '(?s)</body>.*$', '') AS body,
  regexp_extract(html, '(?s)<main class="content">(.*)</main>', 1) AS main_text
FROM pages_aug""",
    "areas": """
SELECT page_id, 0 AS sel_ix, 'main' AS selector, 'MAIN' AS tag, CAST(length(main_text) AS INT) AS text_length FROM segments
UNION ALL SELECT page_id, 1, 'article', 'ARTICLE', CAST(length(article_text) AS INT) FROM segments
UNION ALL SELECT page_id, 2, '.content', 'MAIN', CAST(length(main_text) AS INT) FROM segments""",
    "metrics": f"""
SELECT g.page_id, g.totalElements, g.visibleElements, t.textNodes, t.totalTextLength, g.links, g.buttons, g.inputs, g.images, g.scripts FROM (
  SELECT page_id, count(*) AS totalElements, count(*) FILTER (WHERE visible) AS visibleElements, count(*) FILTER (WHERE tag = 'A') AS links,
    count(*) FILTER (WHERE tag = 'BUTTON') AS buttons, count(*) FILTER (WHERE tag IN ('INPUT', 'SELECT', 'TEXTAREA')) AS inputs, count(*) FILTER (WHERE tag = 'IMG') AS images,
    count(*) FILTER (WHERE tag = 'SCRIPT') AS scripts FROM seen GROUP BY page_id) g
JOIN (SELECT page_id, len(l) AS textNodes, CAST(coalesce(list_sum(list_transform(l, lambda x: length({unescaped('x')}))), 0) AS BIGINT) AS totalTextLength FROM (
  SELECT page_id, list_filter(regexp_split_to_array(body, '(?s)<[^>]*>'), lambda x: trim(x, ' \t\n') <> '') AS l FROM segments) s) t ON g.page_id = t.page_id""",
    "monitoring": """
SELECT p.page_id, coalesce(m.n, 0) AS total_mutations, m.span AS time_span_ms,
  CASE WHEN m.n > 0 THEN round(m.rate, 2) END AS mutations_per_second,
  CASE WHEN m.n IS NULL THEN 'none' WHEN m.rate > 5 THEN 'high' WHEN m.rate > 1 THEN 'medium' ELSE 'low' END AS activity_level,
  coalesce(a.n, 0) AS api_calls_detected
FROM pages p
LEFT JOIN (SELECT *, CASE WHEN span > 0 THEN n / (span / CAST(1000 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS rate FROM (
  SELECT page_id, count(*) AS n, arg_max(ts_ms, seq) - arg_min(ts_ms, seq) AS span FROM mutation_log GROUP BY page_id) s) m ON p.page_id = m.page_id
LEFT JOIN (SELECT page_id, count(*) AS n FROM api GROUP BY page_id) a ON p.page_id = a.page_id""",
    "api": """SELECT * FROM request_log WHERE regexp_matches(lower(url), 'api|ajax|json|graphql')""",
    "facts": """
SELECT page_id, count(*) FILTER (WHERE depth = 0) AS total, count(*) FILTER (WHERE depth = 0 AND success) AS succeeded,
  count(*) FILTER (WHERE depth = 0 AND success AND content_changed) AS changed, count(*) FILTER (WHERE depth > 0) AS nested,
  max(depth) AS max_depth, count(DISTINCT parent_element_id) AS with_nested FROM interaction_log GROUP BY page_id""",
    "method_text": """
SELECT page_id, string_agg(concat(method, '=', n), ';' ORDER BY method) AS methods FROM (
  SELECT page_id, coalesce(method, 'unknown') AS method, count(*) AS n FROM interaction_log WHERE depth = 0 AND success GROUP BY 1, 2) s GROUP BY page_id""",
    "py_functions": """SELECT * FROM functions WHERE path LIKE '%.py'""",
    "files": """
SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.path, n.path) AS path,
  CASE WHEN o.repo IS NULL THEN 'added' WHEN n.repo IS NULL THEN 'removed' ELSE 'modified' END AS status,
  coalesce(o.content, '') AS old_content, coalesce(n.content, '') AS new_content, o.blob_sha AS old_sha, n.blob_sha AS new_sha
FROM (SELECT * FROM file_versions WHERE ref = 'base' AND path LIKE '%.py') o
FULL JOIN (SELECT * FROM file_versions WHERE ref = 'head' AND path LIKE '%.py') n ON o.repo = n.repo AND o.path = n.path
WHERE o.blob_sha IS DISTINCT FROM n.blob_sha""",
    "changes": """
SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.path, n.path) AS path, coalesce(o.name, n.name) AS name,
  CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'modified' END AS change,
  coalesce(n.node_type, o.node_type) AS node_type, o.code AS old_code, n.code AS new_code, coalesce(n.decorated, o.decorated) AS decorated
FROM (SELECT * FROM py_functions WHERE ref = 'base' AND NOT broken) o
FULL JOIN (SELECT * FROM py_functions WHERE ref = 'head' AND NOT broken) n ON o.repo = n.repo AND o.path = n.path AND o.name = n.name
WHERE o.code IS DISTINCT FROM n.code""",
    "totals": """
SELECT f.repo, f.n AS files_changed, coalesce(d.n, 0) AS definitions_changed
FROM (SELECT repo, count(*) AS n FROM files GROUP BY repo) f LEFT JOIN (SELECT repo, count(*) AS n FROM changes GROUP BY repo) d ON f.repo = d.repo""",
    "pairs": """
SELECT repo, head_ref, base_ref, head_at, base_at FROM (
  SELECT repo, sha AS head_ref, lead(sha) OVER w AS base_ref, committed_at AS head_at, lead(committed_at) OVER w AS base_at
  FROM commits WINDOW w AS (PARTITION BY repo ORDER BY committed_at DESC, sha DESC)) s WHERE base_ref IS NOT NULL""",
}


def duckdb(sql: str) -> str:
    """The statement for DuckDB, with the derived tables it uses as common table expressions."""
    known = {**DERIVED, **ORACLE_ONLY}
    names = _needed(sql, ORACLE_ONLY)
    ctes = ", ".join(f"{n} AS ({_fill(known[n], 'duckdb')})" for n in names)
    return _fill(f"WITH {ctes} {sql}" if ctes else sql, "duckdb")
