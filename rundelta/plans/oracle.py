"""SQL for DuckDB: the base tables of every check, shared as one chain of common table expressions."""

BASE = """WITH pay AS (
  SELECT c_mktsegment AS lob, CAST(o_orderdate AS DATE) AS od, CAST(l_shipdate AS DATE) AS sd,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS paid,
         CAST(l_quantity AS DECIMAL(12,2)) AS qty, l_returnflag AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE year(l_shipdate) >= year(o_orderdate)),
inc AS (
  SELECT lob, make_date(year(od), 1, 1) AS origin_period, CAST((year(sd) - year(od) + 1) * 12 AS BIGINT) AS dev_lag,
         make_date(year(sd), 12, 31) AS eval_date, sum(paid) AS paid, sum(qty) AS qty
  FROM pay GROUP BY 1, 2, 3, 4),
cells AS (
  SELECT lob, origin_period, dev_lag, eval_date,
         CAST(sum(paid) OVER (PARTITION BY lob, origin_period ORDER BY dev_lag) AS DOUBLE) AS value FROM inc),
rest AS (
  SELECT lob, origin_period, dev_lag, eval_date, CAST(paid AS DOUBLE) AS value FROM inc
  UNION ALL
  SELECT lob, make_date(year(od), 1, 1), CAST((year(sd) - year(od) + 1) * 12 AS BIGINT), make_date(year(sd) + 1, 12, 31),
         CAST(sum(paid) AS DOUBLE) FROM pay WHERE flag <> 'R' GROUP BY 1, 2, 3, 4),
prem AS (
  SELECT c_mktsegment AS lob, make_date(year(o_orderdate), 1, 1) AS origin_period, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS premium
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
links AS (
  SELECT a.lob, a.origin_period, a.dev_lag, b.eval_date, a.value AS previous, b.value AS following, b.value / a.value AS ratio
  FROM cells a JOIN cells b ON a.lob = b.lob AND a.origin_period = b.origin_period AND b.dev_lag = a.dev_lag + 12),
fac AS (SELECT lob, dev_lag, sum(following) / sum(previous) AS factor FROM links GROUP BY 1, 2),
pat AS (SELECT lob, dev_lag, factor, exp(sum(ln(factor)) OVER (PARTITION BY lob ORDER BY dev_lag DESC)) AS cdf FROM fac),
lat AS (SELECT lob, origin_period, max(dev_lag) AS latest_dev, arg_max(value, dev_lag) AS latest FROM cells GROUP BY 1, 2),
dvl AS (SELECT l.lob, l.origin_period, l.latest_dev, l.latest, coalesce(p.cdf, 1.0) AS cdf, 1 / coalesce(p.cdf, 1.0) AS beta
        FROM lat l LEFT JOIN pat p ON l.lob = p.lob AND l.latest_dev = p.dev_lag),
cl AS (SELECT *, latest * cdf AS ultimate, latest * cdf - latest AS ibnr FROM dvl),
dp AS (SELECT d.*, p.premium, (year(d.origin_period) * 12 + month(d.origin_period)) AS m FROM dvl d JOIN prem p ON d.lob = p.lob AND d.origin_period = p.origin_period)"""

CL_OUT = "lob, origin_period, latest_dev, round(latest, 2) AS latest, round({u}, 2) AS ultimate, round({u} - latest, 2) AS ibnr"


def q(select: str, *more: str) -> str:
    """A query over the base tables, with further common table expressions before it."""
    return BASE + "".join(f",\n{m}" for m in more) + "\n" + select


def mack_ctes(average: str) -> list[str]:
    """Factors, sigma^2 (with the mack rule for the last age), projected cells and per-origin errors."""
    a = {"volume": 1, "simple": 0, "regression": 2}[average]
    f = {"volume": "sum(following) / sum(previous)", "simple": "avg(ratio)", "regression": "sum(previous * following) / sum(previous * previous)"}[average]
    return [
        f"mf AS (SELECT lob, dev_lag, {f} AS f, sum(pow(previous, {a})) AS s, count(*) AS n FROM links GROUP BY 1, 2)",
        f"ms AS (SELECT l.lob, l.dev_lag, f, s, n, CASE WHEN n > 1 THEN sum(pow(previous, {a}) * pow(ratio - f, 2)) / (n - 1) END AS est FROM links l JOIN mf USING (lob, dev_lag) GROUP BY l.lob, l.dev_lag, f, s, n)",
        "ml AS (SELECT *, lag(est, 1) OVER (PARTITION BY lob ORDER BY dev_lag) AS s1, lag(est, 2) OVER (PARTITION BY lob ORDER BY dev_lag) AS s2 FROM ms)",
        "mg AS (SELECT lob, dev_lag, f, s, n, coalesce(est, CASE WHEN s2 = 0 THEN s1 ELSE least(s1 * s1 / s2, s1, s2) END) AS v, est IS NULL AS extrapolated FROM ml)",
        "mp AS (SELECT l.lob, l.origin_period, l.latest_dev, l.latest, g.dev_lag, g.f, g.s, g.v, coalesce(sum(ln(g.f)) OVER (PARTITION BY l.lob, l.origin_period ORDER BY g.dev_lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM lat l JOIN mg g ON l.lob = g.lob AND g.dev_lag >= l.latest_dev)",
        f"mo AS (SELECT l.lob, l.origin_period, l.latest_dev, l.latest, l.latest * exp(coalesce(sum(ln(p.f)), 0)) AS ultimate, coalesce(sum(v / (f * f) / pow(p.latest * exp(upto), {a})), 0) AS process, coalesce(sum(v / (f * f) / s), 0) AS parameter FROM lat l LEFT JOIN mp p ON l.lob = p.lob AND l.origin_period = p.origin_period GROUP BY 1, 2, 3, 4)",
    ]


MACK_OUT = "SELECT lob, origin_period, latest_dev, round(latest, 2) AS latest, round(ultimate, 2) AS ultimate, round(ultimate * sqrt(process), 3) AS process_se, round(ultimate * sqrt(parameter), 3) AS parameter_se, round(ultimate * sqrt(process + parameter), 3) AS mack_se FROM mo"


def rules_sql(reason: str) -> str:
    return f"SELECT lob, origin_period, dev_lag, round(ratio, 6) AS ratio, reason IS NULL AS included, reason FROM ({reason})"
