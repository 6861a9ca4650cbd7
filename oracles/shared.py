"""Common table expressions of the SQL side."""

YEAR = "CAST({y} AS VARCHAR) || '-' || lpad(CAST(({y} + 1) % 100 AS VARCHAR), 2, '0')"


def fy(expression: str) -> str:
    return "(" + YEAR.format(y=f"({expression})") + ")"


def eord(edition: str) -> str:
    return (
        f"(CAST(substr({edition}, 1, 4) AS INT) * 10 + CASE WHEN contains(lower({edition}), 'myefo') THEN 2 "
        f"WHEN contains(lower({edition}), 'october') THEN 1 ELSE 0 END)"
    )


BASE = f"""
joined AS (
  SELECT ('0x' || substr(sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_quantity * 100) AS BIGINT),
           CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT), strftime(l_shipdate, '%Y%m%d%H%M%S'))), 1, 15))::BIGINT AS id, l_suppkey, p_name, p_type, p_brand,
         l_returnflag, l_linestatus, r_name, n_name, n_nationkey,
         CAST(year(o_orderdate) AS INT) + 20 AS order_year, month(o_orderdate) AS om,
         CAST(year(l_shipdate) AS INT) - CAST(year(o_orderdate) AS INT) AS gap,
         CAST(round(l_extendedprice) AS BIGINT) AS amount_thousands,
         CAST(p_size % 5 + 1 AS INT) AS outcome_number, CAST(replace(p_brand, 'Brand#', '') AS INT) AS brand
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
), base AS (
  SELECT *, {fy('order_year')} || CASE WHEN om > 6 THEN ' MYEFO' WHEN order_year = 2016 AND om <= 3 THEN ' March Budget'
           WHEN order_year = 2016 THEN ' October Budget' ELSE ' Budget' END AS edition,
         {fy('order_year')} AS budget_year, {fy('order_year + gap')} AS fiscal_year,
         CASE WHEN gap < 0 THEN 'estimated_actual' WHEN gap = 0 THEN 'budget' ELSE 'forward_estimate' END AS estimate_type,
         CASE WHEN order_year % 2 = 0 THEN 'N' ELSE 'OCT N' END || CAST(n_nationkey AS VARCHAR) AS short_name
  FROM joined
)"""

PE = BASE + """, pe AS (
  SELECT id, edition, budget_year, r_name AS portfolio, short_name AS agency, outcome_number, p_type AS outcome_description,
         CAST(outcome_number AS VARCHAR) || '.' || CAST(brand AS VARCHAR) AS program_number, p_brand AS program_name,
         fiscal_year, estimate_type, amount_thousands
  FROM base
)"""

MR = BASE + """, mr AS (
  SELECT edition, p_type || ' - ' || p_name AS measure_name,
         CASE WHEN order_year = 2017 THEN '2017-18 PBS ' || r_name ELSE r_name END AS portfolio,
         CASE WHEN order_year % 2 = 0 THEN upper('Department of ' || n_name) ELSE short_name END AS agency,
         CASE WHEN l_returnflag = 'R' THEN 'receipt' ELSE 'payment' END AS direction,
         CASE WHEN l_linestatus = 'O' THEN CAST(outcome_number AS VARCHAR) || '.0'
              ELSE CAST(outcome_number AS VARCHAR) || '.' || CAST(brand AS VARCHAR) END AS program_number,
         l_linestatus = 'O' AS is_departmental, fiscal_year, amount_thousands,
         edition || '/' || r_name || '/' || short_name || '.xlsx' AS source_file
  FROM base
)"""


def measure_id(name: str, edition: str, salt: int = 0) -> str:
    return (
        f"lpad(CAST(('0x' || substr(sha256({name} || chr(31) || {edition} || chr(31) || '{salt}'), 1, 12))::BIGINT % 100000000 AS VARCHAR), 8, '0')"
    )


LINES = ["edition", "measure_name", "portfolio", "agency", "direction", "source_file"]
MI = MR + f""", mi AS (
  SELECT *, {measure_id('measure_name', 'edition')} AS measure_id,
         ('0x' || substr(sha256(concat_ws('|', edition, measure_name, agency, direction, fiscal_year)), 1, 15))::BIGINT AS id
  FROM (SELECT edition, measure_name, portfolio, agency, direction, source_file, fiscal_year,
               CAST(sum(amount_thousands) AS BIGINT) AS amount_thousands FROM mr GROUP BY ALL)
)"""
MIP = MI + f""", mp AS (
  SELECT *, {measure_id('measure_name', 'edition')} AS measure_id,
         ('0x' || substr(sha256(concat_ws('|', edition, measure_name, agency, direction, program_number, CAST(is_departmental AS VARCHAR))), 1, 15))::BIGINT AS id
  FROM (SELECT DISTINCT edition, measure_name, portfolio, agency, direction, source_file, is_departmental, program_number FROM mr)
)"""
PE_ONLY = PE[len(BASE):]

LATEST = f"(SELECT {fy('max(CAST(year(o_orderdate) AS INT)) + 20')} || ' Budget' FROM orders WHERE month(o_orderdate) <= 6)"
_ORDER_YEAR = "(CAST(year(o_orderdate) AS INT) + 20)"
EDITIONS = f"""(SELECT list(edition ORDER BY {eord('edition')}, edition) FROM (SELECT DISTINCT {fy(_ORDER_YEAR)} || CASE WHEN month(o_orderdate) > 6 THEN ' MYEFO'
  WHEN {_ORDER_YEAR} = 2016 AND month(o_orderdate) <= 3 THEN ' March Budget' WHEN {_ORDER_YEAR} = 2016 THEN ' October Budget' ELSE ' Budget' END AS edition FROM orders WHERE o_orderdate IS NOT NULL))"""
ALIASES = f"""
al AS (
  SELECT edition, substr(edition, 1, 7) AS budget_year, r_name AS portfolio, formal_name, short_name, id FROM (
    SELECT n_nationkey, r_name, edition, edition_no, name_no,
           CASE WHEN CAST(substr(edition, 1, 4) AS INT) % 2 = 0 THEN 'N' ELSE 'OCT N' END || CAST(n_nationkey AS VARCHAR) AS short_name,
           CASE WHEN name_no = 0 THEN 'Department of ' || n_name
                WHEN n_nationkey % 5 = 0 AND edition LIKE '%MYEFO' THEN n_name || ' Commission' END AS formal_name,
           CAST(n_nationkey * 1000 + name_no * 100 + edition_no AS BIGINT) AS id
    FROM nation JOIN region ON r_regionkey = n_regionkey,
         (SELECT unnest(l) AS edition, generate_subscripts(l, 1) - 1 AS edition_no FROM (SELECT {EDITIONS} AS l)), (VALUES (0), (1)) v(name_no)
  ) WHERE formal_name IS NOT NULL
)"""


def stitch(source: str, keys: str, latest: str = LATEST, earliest: bool = False) -> str:
    """SQL for the stitched series of ``source`` by ``keys``."""
    order = eord("edition") + (" ASC, edition DESC" if earliest else " DESC, edition DESC")
    return f"""
SELECT {keys}, fiscal_year, estimate_type, edition, amount_thousands FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys}, fiscal_year ORDER BY
      CASE WHEN estimate_type = 'estimated_actual' THEN 0 ELSE 1 END, {order}, CASE estimate_type WHEN 'budget' THEN 0 ELSE 1 END) AS rn
  FROM (SELECT {keys}, fiscal_year, estimate_type, edition, CAST(sum(amount_thousands) AS BIGINT) AS amount_thousands
        FROM {source} GROUP BY {keys}, fiscal_year, estimate_type, edition)
  WHERE estimate_type = 'estimated_actual' OR edition = {latest})
WHERE rn = 1"""
