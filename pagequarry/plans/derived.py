"""Tables the reference queries need and the given data lacks, derived from it.

Each is one SELECT over a given table that both Spark and DuckDB understand, so queries and
their check read the same rows. Every row of the given table takes part; the remainders of
ids only vary what happens to a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Jobs of four logged attempts each, made from events; one in seven is two jobs of two attempts.
ATTEMPTS = """
SELECT job,
       concat('https://site', CAST(job % 97 AS STRING), '.example.com/', CAST(job AS STRING)) AS url,
       attempt,
       CASE WHEN event_type = 'view' AND value < 30 THEN 'ok'
            WHEN event_type = 'view' THEN 'redirect_loop'
            WHEN event_type = 'error' AND value < 10 THEN 'other'
            WHEN event_type IN ('error', 'click') THEN 'http_error'
            WHEN event_type = 'purchase' AND value < 40 THEN 'ok'
            WHEN value < 20 THEN 'timeout'
            ELSE 'connection' END AS kind,
       CAST(CASE WHEN event_type = 'view' AND value < 30 THEN 200
                 WHEN event_type = 'purchase' AND value < 40 THEN 203
                 WHEN event_type = 'click' THEN CASE WHEN value < 5 THEN 404 ELSE 502 END
                 WHEN event_type = 'error' AND value >= 10 THEN 503 END AS INT) AS status_code,
       CASE WHEN event_type = 'error' AND value < 10 THEN concat('ValueError: ', props)
            WHEN event_type IN ('error', 'click') THEN concat('answer for event ', CAST(event_id AS STRING))
            END AS error,
       user_id % 5 = 0 AS use_browser
FROM (SELECT event_id, event_type, value, props, user_id,
             CASE WHEN four % 7 = 0 AND event_id % 4 >= 2 THEN four + 1000000000 ELSE four END AS job,
             CAST(event_id % (CASE WHEN four % 7 = 0 THEN 2 ELSE 4 END) + 1 AS INT) AS attempt
      FROM (SELECT *, CAST((event_id - event_id % 4) / 4 AS BIGINT) AS four FROM {events}) f) e
"""

# Requests made from pages, some of them as users type them.
REQUESTS = """
SELECT page_id AS request_id,
       CASE page_id % 8
            WHEN 1 THEN concat(' ', url)
            WHEN 2 THEN concat(url, '  ')
            WHEN 3 THEN concat(url, '#part#two')
            WHEN 4 THEN replace(replace(url, 'https://', 'HTTPS://'), 'http://', 'HTTP://')
            WHEN 5 THEN CASE WHEN page_id % 3 = 0 THEN '' ELSE url END
            WHEN 6 THEN concat(url, ' #late')
            ELSE url END AS url,
       CASE page_id % 5 WHEN 0 THEN true WHEN 1 THEN CAST(NULL AS BOOLEAN) ELSE false END AS use_browser,
       CAST(CASE page_id % 7 WHEN 0 THEN 0 WHEN 1 THEN -5 WHEN 2 THEN NULL ELSE 45 END AS INT) AS timeout
FROM {pages}
"""

# What happens to a page when it is fetched (one in three from a URL it was redirected to): (case, rendered, attempt, kind, status, markup).
_FETCH_CASES = """
(0, false, 1, 'http_error', 503, 'none'), (0, false, 2, 'ok', 200, 'full'),
(1, false, 1, 'http_error', 404, 'none'),
(2, false, 1, 'http_error', 500, 'none'), (2, false, 2, 'connection', 0, 'none'),
(2, false, 3, 'timeout', 0, 'none'), (2, false, 4, 'ok', 200, 'full'),
(3, false, 1, 'redirect_loop', 0, 'none'), (3, false, 2, 'ok', 200, 'full'),
(4, false, 1, 'other', 0, 'none'), (4, false, 2, 'timeout', 0, 'none'), (4, false, 3, 'ok', 203, 'full'),
(5, false, 1, 'ok', 200, 'shell'), (5, true, 1, 'ok', 200, 'full'),
(6, false, 1, 'ok', 200, 'shell'), (6, true, 1, 'timeout', 0, 'none'),
(7, false, 1, 'ok', 200, 'empty'), (7, true, 1, 'other', 0, 'none'),
(8, false, 1, 'http_error', 502, 'none'),
(9, false, 1, 'ok', 200, 'full'), (9, true, 1, 'ok', 404, 'full'),
(10, true, 1, 'ok', 404, 'full')
"""

FETCHES = f"""
SELECT p.page_id AS request_id,
       CASE WHEN p.page_id % 3 = 1 THEN concat('https://moved.example.org/to/', CAST(p.page_id AS STRING))
            ELSE p.url END AS url, c.rendered AS use_browser, CAST(c.attempt AS INT) AS attempt,
       c.kind, CAST(CASE WHEN c.status > 0 THEN c.status END AS INT) AS status_code,
       CASE c.markup WHEN 'full' THEN p.html
                     WHEN 'shell' THEN concat('<html><head><title>App ', CAST(p.page_id AS STRING),
                                              '</title></head><body><div id="app"></div></body></html>')
                     WHEN 'empty' THEN '' END AS html,
       CASE WHEN c.kind IN ('http_error', 'other') THEN concat('Answer: page ', CAST(p.page_id AS STRING))
            END AS error,
       CAST('2024-01-01 00:00:00' AS TIMESTAMP) + CAST(p.page_id AS INT) * INTERVAL '1' SECOND AS fetched_at
FROM {{pages}} p
JOIN (SELECT * FROM (VALUES {_FETCH_CASES}) AS v(which, rendered, attempt, kind, status, markup)) c
  ON p.page_id % 11 = c.which
"""

# Ways a page URL turns up in the wild.
_URL_FORMS = ["as_is", "upper_scheme", "blanks", "no_host", "no_scheme", "query", "encoded",
              "fragment", "upper_host", "mail", "bare_host", "bracket", "user_port", "parameters",
              "control", "six", "six_bad", "empty"]

URL_FORMS = """
SELECT p.page_id, p.form, p.url AS plain,
       CASE p.form
            WHEN 'upper_scheme' THEN replace(replace(p.url, 'https://', 'HTTPS://'), 'http://', 'HtTP://')
            WHEN 'blanks' THEN concat('  ', p.url, ' ')
            WHEN 'no_host' THEN replace(p.url, '://', ':///')
            WHEN 'no_scheme' THEN replace(replace(p.url, 'https:', ''), 'http:', '')
            WHEN 'query' THEN concat(p.url, '?b=2&a=1&c=&d&=v&a=0')
            WHEN 'encoded' THEN concat(p.url, '?q=a%20b&z=é&s=a/b:~*&w=x+y')
            WHEN 'fragment' THEN concat(p.url, '#top?x=1#y')
            WHEN 'upper_host' THEN replace(p.url, '.example.', '.EXAMPLE.')
            WHEN 'mail' THEN concat('mailto:', p.url)
            WHEN 'bare_host' THEN concat('https://host', CAST(p.page_id AS STRING), '.Example.com')
            WHEN 'bracket' THEN replace(p.url, '://', '://[')
            WHEN 'user_port' THEN replace(replace(p.url, '://', '://User:pw@'), '.com/', '.com:8080/')
            WHEN 'parameters' THEN concat('https://e.com/a;b/c;', CASE WHEN p.page_id % 2 = 0 THEN 'v=1' ELSE '' END)
            WHEN 'control' THEN concat(chr(9), p.url, chr(10), '/x', chr(13))
            WHEN 'six' THEN concat('http://[2001:DB8::', CAST(p.page_id % 97 AS STRING), ']:81/p')
            WHEN 'six_bad' THEN concat('http://[2001:db8::1::', CAST(p.page_id % 97 AS STRING), ']/p')
            WHEN 'empty' THEN ''
            ELSE p.url END AS url
FROM (SELECT page_id, url, {each_form} AS form FROM {pages}) p
"""

_REFERENCES = ["/a/../b", "../g", "../../../up", "?p=2", "//O.com/3/", "./", ";x", "g;y?z=1#s",
               "https://e.com/a/../b", "http:foo", "#f", "mailto:x", "a//b/", ".", "/.", ""]

# Link targets as they are written on pages.
REFERENCES = """
SELECT page_id, url AS base, {each_reference} AS reference FROM {pages}
"""

# Texts as they come out of markup: documents with blanks, breaks and compatibility characters.
TEXTS = """
SELECT doc_id,
       concat(chr(9), replace(replace(text, '. ', concat(chr(160), ' ', chr(9), '. ')), ', ', concat(chr(10), chr(10), ', ')),
              CASE doc_id % 3 WHEN 0 THEN ' ﬁn ½ … ' WHEN 1 THEN ' ™ Ａ１ ' ELSE '' END, chr(10)) AS text
FROM {documents}
"""


# Results as a store holds them, two writes for English pages, keys shared by URL variants.
RESULTS = """
SELECT page_id AS write_seq, url,
       CAST(CASE WHEN page_id % 6 = 0 THEN -1 ELSE 200 + page_id % 4 END AS INT) AS status_code,
       CASE WHEN page_id % 6 = 0 THEN '' ELSE concat('Page “', CAST(page_id AS STRING), '”') END AS title,
       CASE WHEN page_id % 6 = 0 THEN '' ELSE html END AS content,
       CASE page_id % 6 WHEN 0 THEN {list}() WHEN 1 THEN {list}(url)
            ELSE {list}(url, '/a', '/b', '/c', '/d', concat('/e', CAST(page_id AS STRING)), '/f') END AS links,
       page_id % 6 <> 0 AS success,
       CASE WHEN page_id % 6 = 0 THEN 'Connection failed — check network or URL' END AS error,
       CAST('2024-03-30 23:59:00' AS TIMESTAMP) + CAST(page_id AS INT) * INTERVAL '1' SECOND
           + CAST(page_id % 3 AS INT) * INTERVAL '250000' MICROSECOND AS scraped_at,
       page_id % 5 = 0 AS used_browser
FROM {pages}
"""

# A second crawl: every page again under the other scheme, English ones once more.
RECRAWL = """
SELECT page_id + 1000000000 AS write_seq, replace(url, 'https://', 'http://') AS url, page_id FROM {pages}
UNION ALL
SELECT page_id + 2000000000, concat(replace(url, 'https://', 'http://'), '/'), page_id FROM {pages}
WHERE url LIKE '%/en/%'
"""

# Stored JSON documents, some with missing, null or wrong fields, some cut off.
DOCUMENTS = """
SELECT page_id,
       CASE page_id % 10
            WHEN 0 THEN concat('{{"url": "', url, '"}}')
            WHEN 1 THEN concat('{{"url": "', url, '", "title": null, "status_code": null}}')
            WHEN 2 THEN concat('{{"url": "', url, '", "title": "T ', CAST(page_id AS STRING), '", "scraped_at": ""}}')
            WHEN 3 THEN concat('{{"url": "', url, '", "scraped_at": "2024-01-02T03:04:05+00:00", "status_code": 404}}')
            WHEN 4 THEN concat('{{"url": "', url, '", "scraped_at": "',
                 {each_time}[CAST((page_id - page_id % 10) / 10 AS INT) % 12 {base}], '"}}')
            WHEN 5 THEN concat('{{"url": "', url, '", "title": "cut')
            WHEN 6 THEN concat('["', url, '"]')
            WHEN 8 THEN concat('{{"url": "first", "url": "', url, '", "status_code": 1, "status_code": 200, "extra": NaN}}')
            WHEN 7 THEN concat('{{"title": "only é", "links": ["', url, '", "/x"], "success": true, "used_browser": true}}')
            ELSE concat('{{"url": "', url, '", "scraped_at": 17, "error": "E", "content": "a b"}}') END AS value
FROM {pages}
"""

# Links between pages: a tree over ids with links back, and lists of each site, which link to their pages, from
# them and to the next list. Lists are no pages.
LINK_GRAPH = """
SELECT p.url AS url, q.url AS link FROM {pages} p JOIN {pages} q ON q.page_id = 2 * p.page_id + 1
UNION ALL SELECT p.url, q.url FROM {pages} p JOIN {pages} q ON q.page_id = 2 * p.page_id + 2
UNION ALL SELECT q.url, p.url FROM {pages} p JOIN {pages} q ON q.page_id = 2 * p.page_id + 1
UNION ALL SELECT url, concat('https://', split_part(url, '/', 3), '/list/', CAST(page_id % 5 AS STRING)) FROM {pages}
UNION ALL SELECT concat('https://', split_part(url, '/', 3), '/list/', CAST(page_id % 5 AS STRING)), url FROM {pages}
UNION ALL SELECT concat('https://', split_part(url, '/', 3), '/list/', CAST(page_id % 5 AS STRING)),
                 concat('https://', split_part(url, '/', 3), '/list/', CAST((page_id + 1) % 5 AS STRING)) FROM {pages}
"""

# Time texts, some of which are no ISO 8601 date and time.
_TIMES = ["no time", "2024", "2024-01", "2024-1-2", "2024-01-02 03:04:05 UTC", "12:30", "T12:30",
          "20240102", "20240102T030405", "2024-W01-1", "2024-01-02T03:04:05Z", "2024-01-02 03:04"]
_LISTS = {"each_form": _URL_FORMS, "each_reference": _REFERENCES}


def _dialect(select: str, make_list: str, generator: str) -> str:
    for name, values in _LISTS.items():
        quoted = ", ".join(f"'{v}'" for v in values)
        select = select.replace(f"{{{name}}}", f"{generator}({make_list}({quoted}))")
    quoted = ", ".join(f"'{t}'" for t in _TIMES)
    select = select.replace("{each_time}", f"{make_list}({quoted})")
    select = select.replace("{base}", "+ 1" if make_list == "list_value" else "")
    return select.replace("{list}", make_list)


def derive(select: str, **tables: DataFrame) -> DataFrame:
    """The SELECT over the given DataFrames."""
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(_dialect(select, "array", "explode"), **tables)


def for_duckdb(select: str) -> str:
    """The same SELECT over DuckDB's views of the given tables."""
    return _dialect(select, "list_value", "unnest").format(
        pages="pages", events="events", documents="documents"
    )
