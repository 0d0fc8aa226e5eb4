"""Inputs that the given tables do not hold directly, derived from them row by row.

Every text here is SQL that Spark and an ANSI engine read alike, so a query and its check start from
the same rows. Names in braces are tables. Sizes grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veil.session import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf: str, name: str, heavy: bool = False) -> DataFrame:
    """A given table; ``heavy`` says that every row costs much processor time."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if heavy:
        df = spread(df)
    if name == "events":
        df = df.withColumn("ts", df["ts"].cast("timestamp"))
    return df


# One form page per customer: label, input, textarea, button; some with canvas, iframe, image.
FORM_PAGES = """
SELECT c_custkey AS page_id, concat('https://shop.example.com/form/', cast(c_custkey as string)) AS url, concat(
  '<html><body><form><label for="f', cast(c_custkey as string), '">',
  CASE c_custkey % 6 WHEN 0 THEN 'Email address' WHEN 1 THEN 'Choose a secret' WHEN 2 THEN 'Card number' WHEN 3 THEN 'Favourite colour'
       WHEN 4 THEN 'Date of birth' ELSE 'Search products' END,
  ' <i>*</i></label><input type="', CASE c_custkey % 6 WHEN 0 THEN 'email' WHEN 1 THEN 'password' ELSE 'text' END,
  '" id="f', cast(c_custkey as string), '" name="', CASE c_custkey % 6 WHEN 2 THEN 'field_a' WHEN 5 THEN 'search_box' ELSE 'field_b' END,
  '" placeholder="" value="', CASE WHEN c_custkey % 12 = 3 THEN concat('user', cast(c_custkey as string), '@mail.example.com') ELSE '' END,
  '"/><textarea name="notes" id="t', cast(c_custkey as string), '"></textarea>',
  '<button id="b', cast(c_custkey as string), '" class="btn">Save <b>', c_mktsegment, '</b></button></form>',
  CASE WHEN c_custkey % 3 = 0 THEN concat('<canvas id="cv', cast(c_custkey as string), '"></canvas>') ELSE '' END,
  CASE WHEN c_custkey % 5 = 0 THEN '<iframe id="fr" class="frame"></iframe>' ELSE '' END,
  CASE WHEN c_custkey % 4 = 0 THEN concat('<img class="scanned avatar" id="im', cast(c_custkey as string), '" alt="a > ', c_name, '" src="/i.png"/>') ELSE '' END,
  '</body></html>') AS html, c_mktsegment, c_name
FROM {customer}
"""

# One page per customer with a table, a definition list, a heading and paging links.
RECORD_PAGES = """
SELECT c_custkey AS page_id, concat(
  '<html><body><h2>Account ', c_name, '</h2><p>Segment ', c_mktsegment, '</p>',
  CASE WHEN c_custkey % 3 <> 2 THEN concat('<table><thead><tr><th>Name</th><th></th><th>Balance</th></tr></thead><tbody><tr><td>', c_name,
     '</td><td><a href="/c/', cast(c_custkey as string), '.pdf">user', cast(c_custkey as string), '@mail.example.com</a></td><td>$',
     cast(c_custkey as string), '.50</td></tr><tr><td>A|b</td><td>', c_mktsegment, '</td><td>n/a</td></tr></tbody></table>') ELSE '' END,
  CASE WHEN c_custkey % 3 = 2 THEN concat('<dl><dt>Segment<dd>', c_mktsegment, '<dt>Key<dd>', cast(c_custkey as string), '</dl>') ELSE '' END,
  '<span class="stat">Orders ', cast(c_custkey % 90 as string), '</span><div role="status">Saved ', cast(c_custkey as string), '</div>',
  CASE WHEN c_custkey % 2 = 0 THEN concat('<a rel="next" href="/p/', cast(c_custkey + 1 as string), '">more</a>')
       WHEN c_custkey % 5 = 1 THEN concat('<a href="/q/', cast(c_custkey as string), '">Load more</a>') ELSE '' END,
  '</body></html>') AS html, c_name, c_mktsegment
FROM {customer}
"""

# One page per order with two product cards and a comment.
CARD_PAGES = """
SELECT o_orderkey AS page_id, concat('<html><body><div class="grid"><div class="card hot"><h3>Order ', cast(o_orderkey as string),
  '</h3><a href="/o/', cast(o_orderkey as string), '">open</a><p>Priority ', o_orderpriority, '</p><span class="badge">', o_orderstatus,
  '</span> $', cast(o_orderkey % 500 as string), '.25</div><div class="card"><h3>Customer ', cast(o_custkey as string),
  '</h3><p>Write to user', cast(o_custkey as string), '@mail.example.com</p></div></div>',
  '<article><span class="author">Clerk: ', cast(o_custkey as string), '</span><div class="post-body">Shipped ', o_orderpriority, '</div></article>',
  '</body></html>') AS html, o_custkey, o_orderstatus, o_orderpriority
FROM {orders}
"""

# Addresses with something to hide, one per order.
PRIVATE_URLS = """
SELECT o_orderkey, concat('https://user', cast(o_custkey as string), ':pw@Shop.Example.com:443/account/u', cast(o_custkey as string),
  '@mail.example.org/reset/tok', lpad(cast(o_orderkey as string), 12, '0'), '?page=', cast(o_orderkey % 9 as string),
  '&email=u', cast(o_custkey as string), '%40mail.example.org&session=s', cast(o_orderkey as string), '&&flag',
  CASE WHEN o_orderkey % 2 = 0 THEN '#top' ELSE concat('#access_token=a', cast(o_orderkey as string)) END) AS raw_url
FROM {orders}
"""

# Boxes: a capture per order, one box per line item.
BOXES = """
SELECT l_orderkey AS capture_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS seq,
  CASE l_partkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'token' ELSE 'credit_card' END AS category,
  concat('v', cast(l_partkey % 50 as string)) AS text,
  cast(l_partkey % 60 as double) AS x, cast(l_suppkey % 40 as double) AS y, cast(l_quantity as double) AS w,
  cast(10 + l_linenumber as double) AS h, cast(l_extendedprice as double) AS score
FROM {lineitem}
"""

# The rows of BOXES, numbered before the other columns are made of them: what Spark shuffles to number them is the same for all uses.
BOX_ROWS = """
SELECT l_orderkey AS capture_id, seq,
  CASE l_partkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'token' ELSE 'credit_card' END AS category,
  concat('v', cast(l_partkey % 50 as string)) AS text,
  cast(l_partkey % 60 as double) AS x, cast(l_suppkey % 40 as double) AS y, cast(l_quantity as double) AS w,
  cast(10 + l_linenumber as double) AS h, cast(l_extendedprice as double) AS score
FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS seq
  FROM {lineitem}) AS numbered
"""

# Requests of tenants: an event is a request, its user the key.
REQUESTS = """
SELECT event_id AS id, ts, cast(user_id as string) AS key, event_type AS endpoint, value AS duration_ms, cast(floor(value) as bigint) % 7 AS steps, user_id
FROM {events}
"""

TENANTS = """
SELECT cast(c_custkey as string) AS key, c_custkey AS tenant_id, c_custkey % 11 <> 0 AS active,
  cast(floor(c_acctbal) as bigint) AS remaining, cast(2500 as bigint) AS quota
FROM {customer} WHERE c_custkey % 13 <> 5
"""


def names_in(sql: str) -> list[str]:
    return [t for t in TABLES if "{" + t + "}" in sql]


def derive(spark: SparkSession, sf: str, sql: str, heavy: bool = False) -> DataFrame:
    return spark.sql(sql, **{t: table(spark, sf, t, heavy) for t in names_in(sql)})


def plain(sql: str) -> str:
    """The same text for an engine where the tables are views."""
    for t in names_in(sql):
        sql = sql.replace("{" + t + "}", t)
    return sql.strip()
