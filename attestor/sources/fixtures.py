"""Views of the driver's tables as catalogue, scans, bursts, id texts and votes.

The SQL is plain enough for Spark and DuckDB alike, so both sides of a comparison start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CARDS = """
SELECT p_partkey AS k, concat('b', substr(p_brand, 7), '-', p_partkey) AS id,
  concat(p_name, CASE p_partkey % 4 WHEN 1 THEN ' ex' WHEN 2 THEN ' VMAX' WHEN 3 THEN ' gx' ELSE '' END) AS name,
  concat('', ((p_partkey % 38) + 3) * 10) AS hp,
  concat(CASE p_partkey % 10 WHEN 7 THEN 'TG' WHEN 9 THEN 'SVP' ELSE '' END, (p_partkey % 300) + 1) AS number,
  p_type AS rarity,
  CASE p_partkey % 10 WHEN 7 THEN concat('b', substr(p_brand, 7), 'tg') WHEN 9 THEN 'svp' ELSE concat('b', substr(p_brand, 7)) END AS set_id,
  p_brand AS set_name, p_type AS set_series, 100 + 4 * CAST(substr(p_brand, 7) AS INT) AS printed_total,
  CASE p_partkey % 5 WHEN 0 THEN p_retailprice WHEN 1 THEN 0.0 END AS holofoil,
  CASE p_partkey % 3 WHEN 0 THEN p_retailprice + 1 WHEN 1 THEN 0.0 END AS normal,
  CASE p_partkey % 2 WHEN 0 THEN p_retailprice + 2 END AS reverse_holofoil,
  CASE p_partkey % 7 WHEN 0 THEN p_retailprice + 3 ELSE 0.0 END AS first_edition
FROM part
"""

SCANS = """
SELECT c_custkey AS scan_id,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN number WHEN c_custkey % 3 = 0 THEN concat('0', number, '/', printed_total)
    WHEN c_custkey % 19 = 0 THEN concat(number, '/', printed_total + 1) ELSE concat(number, '/', printed_total) END AS collector_id,
  CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN substr(name, 1, length(name) - 1) WHEN c_custkey % 5 = 2 THEN concat(name, substr(name, length(name), 1))
    WHEN c_custkey % 5 = 3 THEN upper(name) WHEN c_custkey % 5 = 4 THEN substr(name, 1, 4) ELSE name END AS ocr_name,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(hp AS INT) END AS ocr_hp
FROM (SELECT c_custkey, (c_custkey * 7) % (SELECT count(*) FROM part) AS wanted FROM customer) AS numbered JOIN cards ON k = wanted
"""

FRAMES = """
SELECT l_orderkey AS burst_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS frame_no,
  min(l_partkey) OVER (PARTITION BY l_orderkey) AS card_key, CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN NULL ELSE l_quantity * 8 END AS lap, l_discount AS glare, l_tax * 2 AS area,
  l_linenumber % 3 = 0 AS card_like, l_tax * 12 AS ml_blurry, l_discount * 12 AS ml_glare
FROM lineitem
"""

READINGS = """
SELECT f.burst_id, f.frame_no, f.lap, f.glare, f.area, f.card_like, f.ml_blurry, f.ml_glare,
  CASE WHEN (f.burst_id + f.frame_no) % 5 = 1 THEN substr(c.name, 1, length(c.name) - 1) WHEN (f.burst_id + f.frame_no) % 5 = 2 THEN concat(c.name, substr(c.name, length(c.name), 1))
    WHEN (f.burst_id + f.frame_no) % 5 = 3 THEN upper(c.name) WHEN (f.burst_id + f.frame_no) % 5 = 4 THEN substr(c.name, 1, 4) ELSE c.name END AS name,
  CASE WHEN (f.burst_id + f.frame_no) % 7 = 0 THEN NULL ELSE CAST(c.hp AS INT) END AS hp,
  CASE WHEN (f.burst_id + f.frame_no) % 11 = 0 THEN NULL WHEN (f.burst_id + f.frame_no) % 6 = 0 THEN concat(c.number, '/', c.printed_total + 1) ELSE concat(c.number, '/', c.printed_total) END AS printed_id,
  CASE (f.burst_id + 2 * f.frame_no) % 5 WHEN 0 THEN 'footer_left_surgical' WHEN 1 THEN 'footer_left' WHEN 2 THEN 'footer_right_surgical' WHEN 3 THEN 'footer_right' ELSE 'footer_wide' END AS roi
FROM frames f JOIN cards c ON c.k = f.card_key
"""

ID_TEXTS = """
SELECT event_id, CASE event_id % 16
  WHEN 0 THEN concat('XY', n) WHEN 1 THEN concat('ILLUS SVP EN ', n) WHEN 2 THEN concat(n, '/165') WHEN 3 THEN concat('TG', n, '/TG30')
  WHEN 4 THEN concat('SV0', n % 9 + 1, 'a') WHEN 5 THEN concat('[SVP EN] O', n) WHEN 6 THEN concat('5W5H 0', n) WHEN 7 THEN concat(n, ' of 102')
  WHEN 8 THEN concat('noise line', chr(10), 'S5', n, chr(10), n, '/1', n) WHEN 9 THEN concat('PBLE 4', n, '71084') WHEN 10 THEN concat('HP ', n * 10)
  WHEN 11 THEN concat('05', n * 10, ' basic') WHEN 12 THEN concat('pm ', n, 'ab/056 x') WHEN 13 THEN concat('GG', n, ' / ', n, '0 || I', n, '/S0')
  WHEN 14 THEN concat('ILLUSTRATOR ', event_type) ELSE '' END AS txt
FROM (SELECT event_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS n FROM events) AS e
"""

VOTES = """
SELECT user_id AS session, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('XY', CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 3) END AS printed_id,
  0.5 + (event_id % 5) / 10.0 AS confidence, value AS frame_quality
FROM events
"""

#: Views in the order of their dependence.
VIEWS = {"cards": CARDS, "scans": SCANS, "frames": FRAMES, "readings": READINGS, "id_texts": ID_TEXTS, "votes": VOTES}
_NEEDS = {"cards": ["part"], "scans": ["customer", "part"], "frames": ["lineitem"], "readings": ["lineitem", "part"], "id_texts": ["events"], "votes": ["events"]}
_ABOVE = {"scans": ["cards"], "readings": ["cards", "frames"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables of ``sf_dir``."""
    above = {n: VIEWS[n] for n in _ABOVE.get(name, [])}
    text = "".join(f"{n} AS ({sql}), " for n, sql in above.items())
    tables = {table: spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in _NEEDS[name]}
    query = f"WITH {text}{name}_ AS ({VIEWS[name]}) SELECT * FROM {name}_"
    for table in tables:  # the frames themselves, so that no view of the session is replaced
        query = re.sub(rf"\bFROM {table}\b", f"FROM {{{table}}}", query)
    return spark.sql(query, **tables)


def with_views(*names: str) -> str:
    """The start of a DuckDB query that has the named views, and those they need, as common table expressions."""
    wanted = {n for name in names for n in [*_ABOVE.get(name, []), name]}
    return "WITH " + ", ".join(f"{n} AS ({sql})" for n, sql in VIEWS.items() if n in wanted)
