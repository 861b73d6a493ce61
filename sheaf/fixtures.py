"""Deterministic operator inputs derived from the driver tables.

Each fixture is one SQL text in the common subset of Spark SQL and DuckDB, so the oracle reads
the very same input. ``%SEQ(a, b)%`` is the row generator of either dialect.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from sheaf.session import shared_folder

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

FIXTURES: dict[str, str] = {}

FIXTURES["fx_records"] = """
SELECT o_orderkey AS record_no, lpad(cast(o_orderkey AS string), 8, '0') AS order_id,
       cast(o_custkey AS string) AS customer,
       cast(cast(o_totalprice AS decimal(18, 2)) AS string) AS total
FROM orders
"""

# One output page per kept order. Dropped: k%11=0; second copy: k%13=0; wrong total: k%17=0;
# a neighbour's key on the page: k%19=0; text split into two items: k%5=0; hidden: k%23=0.
FIXTURES["fx_order_pages"] = """
SELECT cast(floor(k / 500) AS bigint) AS doc_id, k * 2 + copy AS page, k % 23 = 0 AS visibility_review, k, copy,
       cust, cents
FROM (SELECT o_orderkey AS k, cast(o_custkey AS string) AS cust,
             cast(round(o_totalprice * 100) AS bigint) AS cents,
             %SEQ(1, case when o_orderkey % 13 = 0 then 2 else 1 end)% AS copy
      FROM orders WHERE o_orderkey % 11 <> 0) b
"""

FIXTURES["fx_order_lines"] = """
SELECT doc_id, page, k, line,
       case line when 1 then 'Order:' when 2 then 'Customer:' when 3 then 'Total:' else 'See' end AS label,
       case line when 1 then lpad(cast(k AS string), 8, '0')
                 when 2 then cust
                 when 3 then '$' || case when dollars >= 1000
                        then cast(cast(floor(dollars / 1000) AS bigint) AS string) || ',' || lpad(cast(dollars % 1000 AS string), 3, '0')
                        else cast(dollars AS string) end || '.' || lpad(cast(c2 % 100 AS string), 2, '0')
                 else lpad(cast(k + 1 AS string), 8, '0') end AS value
FROM (SELECT *, cast(floor(c2 / 100) AS bigint) AS dollars
      FROM (SELECT doc_id, page, k, cust, cents + case when k % 17 = 0 then 100 else 0 end AS c2,
                   %SEQ(1, case when k % 19 = 0 then 4 else 3 end)% AS line
            FROM fx_order_pages) a) b
"""

FIXTURES["fx_order_items"] = """
SELECT doc_id, page, cast(line * 2 + part AS int) AS idx,
       case when k % 5 = 0 then (case when part = 1 then label else value end) else label || ' ' || value end AS text,
       cast(case when part = 2 then 44 + 6 * length(label) else 40 end AS double) AS x,
       cast(50 + 40 * (line - 1) AS double) AS y,
       cast(6 * length(case when k % 5 = 0 then (case when part = 1 then label else value end) else label || ' ' || value end) AS double) AS advance,
       cast(12 AS double) AS size
FROM (SELECT *, %SEQ(1, case when k % 5 = 0 then 2 else 1 end)% AS part FROM fx_order_lines) a
"""

# Nine of ten rows keep, wrap, break or replace the event properties.
FIXTURES["fx_json"] = """
SELECT event_id, user_id, event_type,
       case event_id % 10 when 0 then left(props, length(props) - 1)
                          when 1 then '[' || props || ', 1]'
                          when 2 then cast(event_id AS string)
                          when 3 then 'null'
                          when 4 then '\ufeff' || props
                          when 5 then '   '
                          when 6 then '{"k": 1, "k": 2, "b": "x"}'
                          else props end AS body
FROM events
"""

FIXTURES["fx_measurements"] = """
SELECT l_orderkey, l_linenumber, l_quantity AS value,
       case when l_linenumber % 7 < 3 then 'length' when l_linenumber % 7 < 5 then 'weight' else 'temperature' end AS category,
       case l_linenumber % 7 when 0 then 'ft' when 1 then 'cm' when 2 then 'parsec' when 3 then 'lb' when 4 then 'g'
            when 5 then 'f' else 'k' end AS unit,
       case when l_linenumber % 7 < 3 then 'm' when l_linenumber % 7 < 5 then 'kg' else 'c' end AS target
FROM lineitem
"""

FIXTURES["fx_tenures"] = """
SELECT o_orderkey, case when o_orderkey % 50 = 0 then date '2000-02-29' when o_orderkey % 97 = 0 then date '2002-01-01'
       else cast(o_orderdate AS date) end AS start_date,
       case when o_orderkey % 3 = 0 then date '2001-03-01' else date '2001-08-01' end AS as_of
FROM orders
"""

FIXTURES["fx_contacts"] = """
SELECT k, case k % 7 when 0 then 'text' when 1 then 'url' when 2 then 'email' when 3 then 'phone'
                     when 4 then 'sms' when 5 then 'wifi' else 'vcard' end AS kind,
       case when k % 3 = 0 then '  ' else name end AS text,
       case when k % 4 = 0 then 'Shop' || cast(k AS string) || '.Example.com' when k % 4 = 1 then 'ftp://x.example'
            else 'HTTP://a.example.com:80/p q?x=1' end AS url,
       case when k % 5 = 0 then 'no-at-sign' else 'c' || cast(k AS string) || '@mail.example.com' end AS email,
       case when k % 2 = 0 then '' else 'Order no. 5 & more' end AS email_subject, 'Line (1)' AS email_body,
       case when k % 6 = 0 then 'call me' else '+1 (555) 0' || cast(k AS string) end AS phone,
       case when k % 6 = 1 then '' else '555-0' || cast(k AS string) end AS sms_phone, name AS sms_message,
       case when k % 8 = 5 then ' ' else 'net;' || name end AS wifi_ssid,
       case when k % 2 = 0 then 'nopass' else 'WPA' end AS wifi_security,
       case when k % 9 = 0 then '' else 'p:w' || cast(k AS string) end AS wifi_password, k % 4 = 3 AS wifi_hidden,
       case when k % 10 = 3 then '' else name end AS vcard_name, 'Acme, Inc' AS vcard_organization, '' AS vcard_title,
       '555 01' || cast(k AS string) AS vcard_phone,
       case when k % 11 = 2 then 'bad@mail' else 'v@mail.example.com' end AS vcard_email,
       '' AS vcard_website, '1 Main St; B' AS vcard_address
FROM (SELECT c_custkey AS k, c_name AS name FROM customer) c
"""

# Statements per order: header, lines, a subtotal after line 3, a closing total and sometimes a
# grand total. The closing total is off by 1.00 when k%7=0; line 1 is not a number when k%29=0.
FIXTURES["fx_statement_lines"] = """
SELECT l_orderkey AS k, 'Part ' || cast(l_partkey AS string) AS item, cast(cast(l_quantity AS int) AS string) AS qty,
       cast(round(l_extendedprice * 100) AS bigint) AS cents,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn,
       count(*) OVER (PARTITION BY l_orderkey) AS n
FROM lineitem
"""

FIXTURES["fx_statement_rows"] = """
SELECT table_id, row, a, b, case when k % 29 = 0 and row = 1 then 'n/a' when c = -1 then 'Amount'
       else cast(cast(c / 100 AS decimal(18, 2)) AS string) end AS c
FROM (
  SELECT k, k AS table_id, cast(rn + case when rn > 3 then 1 else 0 end AS int) AS row, item AS a, qty AS b, cents AS c FROM fx_statement_lines
  UNION ALL SELECT k, k, 0, case when k % 13 = 0 then 'Reference' else 'Item' end, 'Qty', -1 FROM fx_statement_lines WHERE rn = 1
  UNION ALL SELECT k, k, 4, 'Subtotal', '', sum(cents) FROM fx_statement_lines WHERE n > 3 AND rn <= 3 GROUP BY k
  UNION ALL SELECT k, k, cast(max(n) AS int) + 2, case when k % 3 = 0 then 'Sub  Total:' else 'TOTAL' end, '',
         sum(cents) + case when k % 7 = 0 then 100 else 0 end FROM fx_statement_lines WHERE n > 3 AND rn > 3 GROUP BY k
  UNION ALL SELECT k, k, cast(max(n) AS int) + 1, 'Total', '', sum(cents) + case when k % 7 = 0 then 100 else 0 end
         FROM fx_statement_lines WHERE n <= 3 GROUP BY k
  UNION ALL SELECT k, k, cast(max(n) AS int) + 3, 'Grand Total', '', sum(cents) FROM fx_statement_lines WHERE n > 3 AND k % 6 <> 1 GROUP BY k
) r
"""

FIXTURES["fx_statements"] = """
SELECT table_id, row, cast(col AS int) AS col, case col when 0 then a when 1 then b else c end AS text
FROM (SELECT *, %SEQ(0, 2)% AS col FROM fx_statement_rows) r
"""

# Merges by table: over data (k%4=0), a total label over its empty neighbour (1), the same twice and
# an overlapping one (2), out of bounds and malformed (3).
FIXTURES["fx_merges"] = """
SELECT table_id, cast(m AS int) AS merge_no,
       case when k4 = 0 then 0 when k4 = 3 and m = 1 then 5 else last_row end AS start_row,
       case when k4 = 0 then 0 when k4 = 3 and m = 1 then 4 when k4 = 3 then last_row + 1 else last_row end AS end_row,
       case when k4 = 2 and m = 3 then 1 else 0 end AS start_col,
       case when k4 = 2 and m = 3 then 1 when k4 = 2 and m = 4 then 2 else 1 end AS end_col
FROM (SELECT table_id, table_id % 4 AS k4, last_row, %SEQ(1, case when table_id % 4 = 2 then 4 when table_id % 4 = 3 then 2 else 1 end)% AS m
      FROM (SELECT table_id, max(row) AS last_row FROM fx_statement_rows GROUP BY table_id) t) u
"""

FIXTURES["fx_evidence"] = """
SELECT table_id, row, col, cast(1 + floor(row / 10) AS int) AS page, text AS source_text
FROM fx_statements WHERE text <> '' AND (table_id + row * 3 + col) % 37 <> 0
"""

FIXTURES["fx_statement_edits"] = """
SELECT table_id, row, col, case when (table_id + row * 3 + col) % 41 = 0 then text || '0'
       when (table_id + row * 3 + col) % 43 = 0 and col = 2 then '$' || text else text end AS text
FROM fx_statements WHERE NOT (table_id % 31 = 0 AND row = 2)
UNION ALL SELECT table_id, 99, 0, 'Extra' FROM fx_statements WHERE table_id % 37 = 0 AND row = 0 AND col = 0
"""

# Statement pages of ten rows: the fragments a page-wise extractor would report.
FIXTURES["fx_fragments"] = """
SELECT cast(floor(table_id / 20) AS bigint) AS doc_id, table_id * 10 + cast(floor(row / 4) AS bigint) AS page, table_id,
       cast(floor(row / 4) AS bigint) AS part, cast(min(row) AS bigint) AS first_key,
       cast(max(row) - case when table_id % 17 = 0 then 1 else 0 end AS bigint) AS last_key, count(*) AS n_rows,
       case when table_id % 5 = 0 then 2 else 3 end AS n_cols,
       case when max(row) % 4 = 3 then 0.95 else 0.6 end AS bottom,
       case when table_id % 19 = 0 then 0.3 else 0.05 end AS top,
       0.1 + case when table_id % 23 = 0 then 0.015 * floor(row / 4) else 0 end AS left_edge
FROM fx_statement_rows GROUP BY table_id, floor(row / 4)
"""

FIXTURES["fx_manifest"] = """
SELECT conv_id AS job_id, turn AS ordinal, conv_id * 1000 + turn AS page_id, conv_id AS source_id, cast(turn AS int) AS page_index,
       cast(90 * (turn % 4) AS int) AS rotation, cast(length(text) AS bigint) AS bytes
FROM conversations
"""

FIXTURES["fx_expressions"] = """
SELECT conv_id AS job_id, cast(count(*) AS int) AS page_count,
       case conv_id % 12 when 0 then '1-3,2' when 1 then '3-2' when 2 then '0' when 3 then '1,,2' when 4 then '99'
         when 5 then ' 1 - 2 , 4 ' when 6 then 'x' when 7 then '' when 8 then '1,2-3' when 9 then '2,1' when 10 then '1,99999999999999999999' else '1,3' end AS expr
FROM conversations GROUP BY conv_id
"""

FIXTURES["fx_catalog"] = """
SELECT p_partkey AS item_no, '/items/' || cast(p_partkey AS string) AS href, p_name AS name, p_type AS description, p_brand AS category,
       p_size % 5 <> 0 AS available, '/items/' || cast(p_partkey + 1 AS string) AS rel1, '/items/' || cast(p_partkey + 2 AS string) AS rel2,
       case when p_partkey % 10 = 0 then '/items/' || cast(p_partkey AS string) else '/items/' || cast(p_partkey + 3 AS string) end AS rel3
FROM part
"""

# Pages with head tags injected by number: duplicates, wrong canonicals, noindex, missing schema.
FIXTURES["fx_site_pages"] = """
SELECT page_id, 'https://site.example/p/' || cast(page_id AS string) AS page_url,
       'c' || cast(page_id % 6 AS string) AS category,
       case when page_id % 21 = 0 then '/p/' || cast(page_id AS string) when page_id % 22 = 0 then '/p/99999999' else '/p/' || cast(page_id - page_id % 2 AS string) end AS related,
       replace(html, '</title>', '</title>'
         || case when page_id % 5 = 0 then '' else '<meta name="description" content="About ' || cast(page_id - page_id % 3 AS string) || '">' end
         || '<link rel="canonical" href="https://site.example/p/' || cast(case when page_id % 7 = 0 then page_id + 1 else page_id end AS string) || '">'
         || '<meta property="og:url" content="https://site.example/p/' || cast(page_id AS string) || case when page_id % 8 = 0 then '/' else '' end || '">'
         || case when page_id % 9 = 0 then '<meta name="robots" content="noindex,follow">' else '' end
         || case when page_id % 10 = 0 then '' else '<script type="application/ld+json">{"@type":"SoftwareApplication","url":"https://site.example/p/' || cast(page_id AS string) || '"}</script>' end
         || case when page_id % 4 = 0 then '<script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"name":"'
             || case when page_id % 8 = 0 then 'Zebra quux?' else 'Question ' || cast(page_id AS string) || '?' end || '","acceptedAnswer":{"text":"Yes."}}]}</script>' else '' end)
         || '<p>Question  ' || cast(page_id AS string) || '? Yes.</p>' AS html
FROM pages
"""

FIXTURES["fx_risky_pages"] = """
SELECT page_id, url, replace(html, '</title>', '</title>'
    || case when page_id % 3 = 0 then '<meta name="author" content="A. N. Other">' else '' end
    || case when page_id % 4 = 0 then '<form action="/x"><input name="q" type="text" value="v"></form>' else '' end
    || case when page_id % 5 = 0 then '<img src="a.png"><img src="b.png">' else '' end
    || case when page_id % 6 = 0 then '<iframe src="f' || cast(page_id AS string) || '.pdf"></iframe>' else '' end
    || '<a href="https://out' || cast(page_id AS string) || '.example/x">x</a>'
    || case when page_id % 7 = 0 then '<a href="http://two.example/' || cast(page_id AS string) || '">y</a><script src="z.js"></script>' else '' end) AS html
FROM pages
"""

# Words of the statements at fixed positions, ten rows to a page; some hidden, some off the page.
FIXTURES["fx_words"] = """
SELECT cast(floor(table_id / 20) AS bigint) AS doc_id, table_id * 10 + cast(floor(row / 10) AS bigint) AS page, row * 3 + col AS word_no,
       table_id, row, col, text, cast(case col when 0 then 40 when 1 then 220 else 330 end AS double)
         + case when table_id % 47 = 0 and col = 2 then 400.0 else 0.0 end AS x,
       cast(100 + 42 * (row % 10) AS double) AS y, cast(length(text) * 5 AS double) AS width, cast(11 AS double) AS height,
       table_id % 9 = 0 and (table_id % 2 = 0 or row % 2 = 0) AS hidden
FROM fx_statements WHERE text <> ''
"""

FIXTURES["fx_word_pages"] = """
SELECT doc_id, page, cast(612 AS double) AS width, cast(792 AS double) AS height, cast(page % 3 AS int) AS images
FROM (SELECT DISTINCT doc_id, page FROM fx_words) w
"""

FIXTURES["fx_covers"] = """
SELECT doc_id, page, cast(cover_no AS int) AS cover_no, cast(case cover_no when 1 then 300 else 30 end AS double) AS x0,
       cast(case cover_no when 1 then 500 else 60 end AS double) AS x1, cast(90 AS double) AS y0, cast(190 AS double) AS y1,
       case when page % 13 = 0 then '#ffffff' else '#000000' end AS fill, page % 8 <> 0 AS after_text
FROM (SELECT *, %SEQ(1, 2)% AS cover_no FROM fx_word_pages) p
"""

# Every e-mail address and every word of eight or more lower-case letters of the whole texts. Added cases: marks that
# overlap another one, and marks that end beyond the text.
FIXTURES["fx_mark_spans"] = """
SELECT doc_id, k, stop, size FROM (
  SELECT doc_id, k, part, length(part) AS size, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM (%PARTS%) p) q
WHERE regexp_extract(part, '^([A-Za-z0-9._-]+@[A-Za-z0-9.-]+|[a-z]{8,}[.]?)$', 1) <> ''
"""

FIXTURES["fx_marks"] = """
SELECT doc_id, 'm' || cast(k AS string) AS mark_id, cast(stop - size AS int) AS start,
       cast(case when k < 40 and doc_id % 17 = 0 then stop + 1000000000 else stop end AS int) AS end_ FROM fx_mark_spans
UNION ALL SELECT doc_id, 'o' || cast(k AS string), cast(greatest(stop - size - 9, 0) AS int), cast(stop - 3 AS int) FROM fx_mark_spans WHERE k % 5 = 0
"""

FIXTURES["fx_policy_docs"] = """
SELECT doc_id, 'p' || cast(doc_id % 3 AS string) AS policy, cast(n_chars AS bigint) AS bytes, doc_id % 29 = 0 AS encrypted,
       case when doc_id % 7 = 0 then null else doc_id % 10 = 0 end AS signed,
       case when doc_id % 7 = 0 then null else cast(doc_id % 4 AS int) end AS active_actions,
       cast(n_chars - doc_id % 5 + 2 AS bigint) AS candidate_bytes
FROM documents
"""

FIXTURES["fx_policy_pages"] = """
SELECT doc_id, case when page % 2 = 0 then w else h end AS width, case when page % 2 = 0 then h else w end AS height, page
FROM (SELECT doc_id, page, case when doc_id % 3 = 2 then 595.0 else 612.0 end AS w,
             case when doc_id % 5 = 0 and page = 2 then 700.0 when doc_id % 3 = 2 then 842.0 else 792.0 end AS h
      FROM (SELECT doc_id, %SEQ(1, length(text) - length(replace(text, chr(10), '')) + 1)% AS page FROM documents) d) p
"""

# Positioned text: statement words, a bold title line and a page footer. Baselines drift by column
# when table_id%11=0, so the third column leaves the line there.
FIXTURES["fx_spans"] = """
SELECT doc_id, page, cast(word_no + 100 AS int) AS span_no, text, x, y + case when table_id % 11 = 0 then 2.0 * col else 0.4 * (row % 2) end AS y,
       width, height AS size, false AS bold FROM fx_words
UNION ALL SELECT doc_id, page, 0, 'Statement', cast(40 AS double), cast(64 AS double), cast(54 AS double), cast(12 AS double), true FROM fx_word_pages
UNION ALL SELECT doc_id, page, 1, cast(page AS string), cast(case when page % 4 = 0 then 94.5 else 100 end AS double), cast(64 AS double), cast(40 AS double), cast(12 AS double), true FROM fx_word_pages
UNION ALL SELECT doc_id, page, 2, 'Page ' || cast(page % 10 + 1 AS string), cast(280 AS double), cast(760 AS double), cast(30 AS double), cast(9 AS double), false FROM fx_word_pages
"""

FIXTURES["fx_ocr_words"] = """
SELECT doc_id, page, row AS line_no, word_no, text, x * 4 AS x0, (x + width) * 4 AS x1, (y - 11) * 4 AS y0, y * 4 AS y1,
       cast(40 + (table_id * 7 + row * 13 + col * 5) % 60 AS double) AS confidence
FROM fx_words
"""

# Closed grids around the statement rows of each page: borders at x 30, 210, 320 and 700.
FIXTURES["fx_rules"] = """
SELECT doc_id, page, cast(30 AS double) AS x0, cast(72 + 42 * i AS double) + case when i % 2 = 1 then 0.5 else 0.0 end AS y0, cast(700 AS double) AS x1,
       cast(72 + 42 * i AS double) + case when i % 2 = 1 then 0.5 else 0.0 end AS y1
FROM (SELECT doc_id, page, %SEQ(0, n)% AS i FROM (SELECT doc_id, page, max(row % 10) + 1 AS n FROM fx_words GROUP BY doc_id, page) a) b
UNION ALL SELECT doc_id, page, x, cast(72 + 42 * i AS double), x, cast(72 + 42 * (i + 1) AS double) + 1
FROM (SELECT doc_id, page, i, cast(case j when 0 then 30 when 1 then 210 when 2 then 320 else 700 end AS double) AS x
      FROM (SELECT doc_id, page, i, %SEQ(0, 3)% AS j FROM (SELECT doc_id, page, %SEQ(0, n - 1)% AS i FROM (
        SELECT doc_id, page, max(row % 10) + 1 AS n FROM fx_words GROUP BY doc_id, page) a) b) c
      WHERE NOT (page % 6 = 0 AND j = 2 AND i % 3 = 1)) d
"""

FIXTURES["fx_doc_lines"] = """
SELECT doc_id, cast(floor(line / 40) AS bigint) AS page, line % 40 AS pos, text, cast(20 + 20 * (line % 40) AS double) AS y
FROM (SELECT doc_id, line, text FROM (%LINES%) l) m WHERE trim(text) <> ''
"""

_GENERATOR = re.compile(r"%SEQ\((.*?)\)%", re.S)


_PART = "[A-Za-z0-9._@-]+|[^A-Za-z0-9._@-]+"


def _spark_text(sql: str) -> str:
    lines = "SELECT doc_id, posexplode(split(text, '\\n', -1)) AS (line, text) FROM documents"
    parts = f"SELECT doc_id, posexplode(regexp_extract_all(text, '{_PART}', 0)) AS (k, part) FROM documents"
    return _GENERATOR.sub(r"explode(sequence(\1))", sql).replace("%LINES%", lines).replace("%PARTS%", parts)


def duck_text(sql: str) -> str:
    lines = (
        "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, "
        "generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents"
    )
    found = f"regexp_extract_all(text, '{_PART}')"
    parts = f"SELECT doc_id, unnest({found}) AS part, generate_subscripts({found}, 1) - 1 AS k FROM documents"
    return _GENERATOR.sub(r"unnest(generate_series(\1))", sql).replace("%LINES%", lines).replace("%PARTS%", parts)


def tables(spark: SparkSession, sf_dir: str) -> None:
    """Point the table names at one data folder; a query resolves its names when it is built."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def needed(name: str) -> list[str]:
    """The fixture and those it reads, dependencies first."""
    out: list[str] = []
    for other in re.findall(r"\bfx_\w+", FIXTURES[name]):
        for n in needed(other):
            if n not in out:
                out.append(n)
    return out + [name]


TEXT_TABLES = {"documents", "pages", "conversations"}


def _spread(df: DataFrame) -> DataFrame:
    """Spread a text table that arrives in fewer splits than there are cores (one small file); a scan of
    many splits stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Derived inputs that take a shuffle and that several steps read: written once per session and folder. What follows from
# them row by row (words, spans, rules) is derived again instead, which writes and reads nothing.
WRITTEN = {"fx_statement_lines", "fx_statement_rows", "fx_order_items", "fx_marks", "fx_word_pages"}
_written: dict[tuple[str, str, str], str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a fixture as a DataFrame."""
    if name in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return _spread(df) if name in TEXT_TABLES else df
    if name not in WRITTEN:
        return _derived(spark, sf_dir, name)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _derived(spark, sf_dir, name).write.parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def _derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FIXTURES[name]
    for n in sorted(set(re.findall(r"\bfx_\w+", text))):
        load(spark, sf_dir, n).createOrReplaceTempView(n)
    for t in TABLES:
        if re.search(rf"\bFROM\s+{t}\b|\bJOIN\s+{t}\b", text) or (t == "documents" and ("%LINES%" in text or "%PARTS%" in text)):
            load(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(_spark_text(text))


def ctes(*names: str) -> str:
    """The fixtures (with those they need) as a WITH list for DuckDB."""
    ordered: list[str] = []
    for name in names:
        for n in needed(name):
            if n not in ordered:
                ordered.append(n)
    return ", ".join(f"{n} AS ({duck_text(FIXTURES[n])})" for n in ordered)
