"""DuckDB SQL building blocks that mirror the binding views.

Used only to check the Spark plans; the Spark side never runs this text.
"""

TX_RAW = """
tx_raw AS (
  SELECT CASE WHEN l.l_returnflag = 'R' THEN 'C' || CAST(o.o_orderkey AS VARCHAR)
              ELSE CAST(o.o_orderkey AS VARCHAR) END AS InvoiceNo,
         CAST(l.l_partkey AS VARCHAR) AS StockCode,
         p.p_name AS Description,
         CAST(l.l_quantity AS BIGINT) AS Quantity,
         o.o_orderdate AS InvoiceDate,
         CAST(p.p_retailprice AS DECIMAL(18,2)) AS UnitPrice,
         o.o_custkey AS CustomerID,
         n.n_name AS Country
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

TX = TX_RAW + """,
tx AS (
  SELECT *, Quantity * UnitPrice AS TotalPrice FROM tx_raw
  WHERE CustomerID IS NOT NULL AND NOT starts_with(InvoiceNo, 'C')
    AND Quantity > 0 AND UnitPrice > 0
)"""

INTER = TX + """,
inter AS (
  SELECT CustomerID, StockCode, CAST(sum(Quantity) AS BIGINT) AS purchase_count,
         min(Description) AS description
  FROM tx GROUP BY CustomerID, StockCode
)"""

# hold-out: md5 order per user, users with >= 5 items, max(1, floor(0.2 n))
HOLDOUT = INTER + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY CustomerID
                               ORDER BY md5(concat_ws('|', '42', CAST(CustomerID AS VARCHAR), StockCode)), StockCode) AS rk,
         count(*) OVER (PARTITION BY CustomerID) AS n
  FROM inter
),
flagged AS (
  SELECT *, (n >= 5 AND rk <= greatest(1, CAST(floor(n * 0.2) AS BIGINT))) AS is_test FROM ranked
),
train AS (SELECT CustomerID, StockCode, purchase_count FROM flagged WHERE NOT is_test),
test AS (SELECT CustomerID, StockCode, purchase_count AS score FROM flagged WHERE is_test)"""

CUST_RAW = """
ref AS (SELECT max(o_orderdate) - INTERVAL 365 DAY AS cutoff FROM orders),
pre AS (SELECT o.* FROM orders o WHERE o.o_orderdate < (SELECT cutoff FROM ref)),
spend AS (SELECT o_custkey, min(o_orderdate) AS first_order,
                 sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spend
          FROM pre GROUP BY o_custkey),
prio_n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM pre GROUP BY 1, 2),
prio AS (SELECT o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) AS top_priority
         FROM prio_n GROUP BY o_custkey),
ret AS (SELECT DISTINCT o_custkey FROM pre
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
ev AS (SELECT DISTINCT user_id FROM events),
act AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= (SELECT cutoff FROM ref)),
cust_base AS (
  SELECT c.c_custkey, c.c_mktsegment, r.r_name, c.c_acctbal, s.first_order, s.spend,
         pr.top_priority, ret.o_custkey AS r_key, ev.user_id AS e_key, act.o_custkey AS a_key,
         CASE WHEN s.first_order IS NULL THEN 0 ELSE
           (year((SELECT cutoff FROM ref)) * 12 + month((SELECT cutoff FROM ref)))
           - (year(s.first_order) * 12 + month(s.first_order))
           - CASE WHEN day((SELECT cutoff FROM ref)) < day(s.first_order) THEN 1 ELSE 0 END END AS tenure
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN spend s ON c.c_custkey = s.o_custkey
  LEFT JOIN prio pr ON c.c_custkey = pr.o_custkey
  LEFT JOIN ret ON c.c_custkey = ret.o_custkey
  LEFT JOIN ev ON c.c_custkey = ev.user_id
  LEFT JOIN act ON c.c_custkey = act.o_custkey
),
cust_raw AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customerID,
         c_mktsegment AS segment, r_name AS region,
         coalesce(top_priority, 'none') AS top_priority,
         CASE WHEN r_key IS NOT NULL THEN 'Yes' ELSE 'No' END AS has_returns,
         CASE WHEN e_key IS NOT NULL THEN 'Yes' ELSE 'No' END AS has_events,
         CAST(c_acctbal < 0 AS INTEGER) AS debt_flag,
         CAST(tenure AS INTEGER) AS tenure,
         CASE WHEN spend IS NULL THEN 0.0 ELSE
           CAST((2 * CAST(spend * 100 AS BIGINT) + CAST(greatest(tenure, 1) AS BIGINT))
                // (2 * CAST(greatest(tenure, 1) AS BIGINT)) AS DOUBLE) / 100.0 END AS MonthlyCharges,
         coalesce(CAST(spend AS VARCHAR), '') AS TotalCharges,
         CASE WHEN a_key IS NULL THEN 'Yes' ELSE 'No' END AS Churn
  FROM cust_base
)"""

CUST = CUST_RAW + """,
cust_parsed AS (SELECT * REPLACE (TRY_CAST(TotalCharges AS DOUBLE) AS TotalCharges) FROM cust_raw),
cust AS (
  SELECT * REPLACE (coalesce(TotalCharges, (SELECT median(TotalCharges) FROM cust_parsed)) AS TotalCharges,
                    CASE WHEN Churn = 'Yes' THEN 1 WHEN Churn = 'No' THEN 0 END AS Churn)
  FROM cust_parsed
)"""


def with_(*blocks: str) -> str:
    return "WITH " + ",".join(b.strip() for b in blocks) + "\n"

ITEMCF = HOLDOUT + """,
norms AS (SELECT StockCode, sqrt(CAST(sum(purchase_count * purchase_count) AS DOUBLE)) AS norm
          FROM train GROUP BY StockCode),
dots AS (SELECT a.StockCode AS item_i, b.StockCode AS item_j,
                sum(CAST(a.purchase_count AS DOUBLE) * CAST(b.purchase_count AS DOUBLE)) AS dot
         FROM train a JOIN train b ON a.CustomerID = b.CustomerID AND a.StockCode <> b.StockCode
         GROUP BY 1, 2),
sims AS (SELECT item_i, item_j, dot / (ni.norm * nj.norm) AS sim
         FROM dots JOIN norms ni ON ni.StockCode = item_i JOIN norms nj ON nj.StockCode = item_j),
nb AS (SELECT item_i, item_j, sim FROM (
         SELECT *, rank() OVER (PARTITION BY item_i ORDER BY sim DESC) AS rk FROM sims) WHERE rk <= 20),
sc AS (SELECT t.CustomerID, nb.item_j AS StockCode,
              round(sum(CAST(t.purchase_count AS DOUBLE) * nb.sim), 9) AS score
       FROM train t JOIN nb ON t.StockCode = nb.item_i GROUP BY 1, 2),
unseen AS (SELECT * FROM sc WHERE NOT EXISTS (
             SELECT 1 FROM train t WHERE t.CustomerID = sc.CustomerID AND t.StockCode = sc.StockCode)),
recs AS (SELECT * FROM (
           SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY score DESC, StockCode) AS rank
           FROM unseen) WHERE rank <= 10),
descs AS (SELECT StockCode, arg_max(description, CustomerID) AS Description FROM inter GROUP BY StockCode)"""

REC_METRICS = """
tu AS (SELECT CustomerID, count(*) AS n_true FROM test GROUP BY 1),
h AS (SELECT r.CustomerID, count(*) AS hits FROM recs r JOIN test t
        ON r.CustomerID = t.CustomerID AND r.StockCode = t.StockCode GROUP BY 1),
pu AS (SELECT tu.CustomerID, coalesce(h.hits, 0) AS hits, n_true FROM tu LEFT JOIN h ON tu.CustomerID = h.CustomerID)
SELECT round(avg(hits / 10.0), 6) AS precision_at_k, round(avg(hits / n_true), 6) AS recall_at_k,
       round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(*) AS users_evaluated
FROM pu"""

SPLIT = CUST + """,
split AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY Churn
                       ORDER BY md5(concat_ws('|', '42', customerID)), customerID)
                   <= CAST(round(count(*) OVER (PARTITION BY Churn) * 0.2) AS BIGINT)
                 THEN 'test' ELSE 'train' END AS split
  FROM cust
)"""

# deterministic stand-in score in [0, 1): label-informed, md5-noised
DEMO_SCORE_SQL = ("(CAST(0.3 AS DOUBLE) * Churn + CAST(0.7 AS DOUBLE) * "
                  "(CAST(('0x' || substr(md5('score|' || customerID), 1, 8)) AS BIGINT) / 4294967296.0))")
