"""The stand-in fixtures of ``faultline.sources.testdata`` as DuckDB CTEs.

Each entry is ``name AS (...)`` SQL over the pre-registered test tables; the
oracle queries prepend the ones they need with :func:`with_`. Formulas match
the DataFrame builders line for line (same rounding, same filters).
"""

from __future__ import annotations

CTES: dict[str, str] = {}

CTES["unit"] = """
unit AS (
  SELECT p.p_partkey AS row_id, p.p_brand AS grp,
         CAST(p.p_size AS DOUBLE) AS SM_size, p.p_retailprice AS SM_price,
         round(l.qty_avg, 6) AS SM_qty_avg, round(l.qty_std, 6) AS SM_qty_std,
         CAST(coalesce(l.n_lines, 0) AS DOUBLE) AS PMD_lines,
         round(l.disc_avg * 100, 6) AS MOSER_disc_avg,
         CAST(CASE WHEN l.n_r / l.n_lines > 0.45 THEN l.n_r ELSE 0 END AS BIGINT) AS Bug
  FROM part p LEFT JOIN (
    SELECT l_partkey, avg(l_quantity) AS qty_avg, stddev_pop(l_quantity) AS qty_std,
           count(*) AS n_lines, avg(l_discount) AS disc_avg,
           sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_r
    FROM lineitem GROUP BY l_partkey) l
  ON p.p_partkey = l.l_partkey)"""

# cluster id from the brand number; brands 24 and 25 play the noise points
CTES["unit_clusters"] = """
unit_clusters AS (
  SELECT row_id,
         CASE WHEN CAST(split_part(grp, '#', 2) AS INTEGER) >= 24 THEN -1
              ELSE CAST(split_part(grp, '#', 2) AS INTEGER) - 1 END AS cluster,
         CASE WHEN Bug > 0 THEN 1 ELSE 0 END AS y
  FROM unit)"""

CTES["sm"] = """
sm AS (
  SELECT CASE WHEN p.p_size = 50 THEN NULL ELSE CAST(g.yr AS VARCHAR) END AS version,
         g.l_partkey AS id,
         'part_' || CAST(g.l_partkey AS VARCHAR) AS file,
         CAST(g.yr AS VARCHAR) || '-' || CAST(g.l_partkey AS VARCHAR) AS version_id,
         CAST(g.bug AS BIGINT) AS Bug,
         g.qty_sum AS SM_qty_sum,
         round(g.price_avg, 6) AS SM_price_avg,
         round(g.disc_avg, 6) AS SM_disc_avg,
         CASE WHEN p.p_type = 'PROMO' THEN NULL ELSE round(g.tax_avg, 6) END AS SM_tax_avg,
         CAST(g.n_lines AS DOUBLE) AS SM_lines,
         CAST(p.p_size AS DOUBLE) AS SM_size
  FROM (SELECT l_partkey, year(l_shipdate) AS yr, sum(l_quantity) AS qty_sum,
               avg(l_extendedprice) AS price_avg, avg(l_discount) AS disc_avg,
               avg(l_tax) AS tax_avg, count(*) AS n_lines,
               sum(CASE WHEN l_returnflag = 'R' AND l_discount > 0.095 THEN 1 ELSE 0 END) AS bug
        FROM lineitem GROUP BY l_partkey, year(l_shipdate)) g
  JOIN part p ON g.l_partkey = p.p_partkey)"""

CTES["coverage"] = """
coverage AS (
  SELECT CAST(yr AS VARCHAR) AS version,
         'part_' || CAST(l_partkey AS VARCHAR) AS filename,
         round(ci / 10, 6) AS COV_INSTRUCTION, round(cb, 6) AS COV_BRANCH,
         round(cl * 10, 6) AS COV_LINE, round(cc, 6) AS COV_COMPLEXITY,
         round(cm / 50, 6) AS COV_METHOD
  FROM (SELECT l_partkey, year(l_shipdate) AS yr, count(*) AS n,
               avg(sqrt(l_quantity)) AS ci,
               avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) AS cb,
               avg(l_tax) AS cl,
               avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS cc,
               avg(l_quantity) AS cm
        FROM lineitem GROUP BY l_partkey, year(l_shipdate)) g
  WHERE n >= 2)"""

CTES["effort"] = """
effort AS (
  SELECT CAST(yr AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS version_id,
         CAST(hcm AS DOUBLE) AS HASSAN_hcm, CAST(rev AS DOUBLE) AS MOSER_revisions,
         CAST(major AS DOUBLE) AS PMD_severity_major,
         round(price, 6) AS CHANGE_TYPE_data,
         CAST(abug AS DOUBLE) AS ISSUE_major_bug,
         round(maxdisc * 100, 6) AS "PMD_rule_type_basic rules"
  FROM (SELECT l_partkey, year(l_shipdate) AS yr,
               count(DISTINCT l_suppkey) AS hcm, count(DISTINCT month(l_shipdate)) AS rev,
               sum(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) AS major,
               avg(sqrt(l_extendedprice)) AS price,
               sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS abug,
               max(l_discount) AS maxdisc, sum(l_quantity) AS q
        FROM lineitem GROUP BY l_partkey, year(l_shipdate)) g
  WHERE q >= 20)"""

CTES["part2"] = """
part2 AS (
  SELECT p_partkey AS row_id,
         round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS x0,
         round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS x1
  FROM part)"""

CTES["scores"] = """
scores AS (
  SELECT o_orderkey AS row_id,
         CAST(o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AS INTEGER) AS y,
         round(o_totalprice / 500000.0, 2) AS score,
         CAST(round(o_totalprice / 500000.0, 2) > 0.5 AS INTEGER) AS pred
  FROM orders)"""


def with_(*names: str) -> str:
    """``WITH`` clause holding the named fixture CTEs in the given order."""
    return "WITH " + ",\n".join(CTES[n].strip() for n in names) + "\n"
