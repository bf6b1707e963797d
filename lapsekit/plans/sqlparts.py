"""SQL building blocks for the DuckDB cross-check of the registered queries.

The check runs every registered query both as a Spark job and as plain SQL over the same
parquet tables. These fragments spell out, in SQL, the same mapping as ``sources.testdata``.
"""

from __future__ import annotations

YEARS = 3

FACT = f"""
fact_all AS (
  SELECT o.o_orderkey AS booking_id, o.o_orderkey AS session_id, o.o_custkey AS customer_id,
         CAST(o.o_orderdate AS DATE) AS transaction_date, o.o_orderdate AS transaction_ts,
         o.o_orderstatus AS payment_status, o.o_orderpriority AS promo_code,
         0.0::DOUBLE AS promo_amount, 0.0::DOUBLE AS shipment_fee, o.o_totalprice AS total_amount,
         l.l_partkey AS product_id, l.l_suppkey AS supplier_id, l.l_linenumber AS line_number,
         l.l_extendedprice AS list_price, l.l_quantity AS quantity,
         l.l_extendedprice * (1 - l.l_discount) / l.l_quantity AS item_price,
         CAST(l.l_shipdate AS DATE) AS shipment_date, l.l_returnflag AS return_flag,
         c.c_mktsegment AS device_type, c.c_nationkey AS nation_key, c.c_acctbal AS acct_balance,
         j.first_join_date,
         p.p_brand AS item, p.p_type AS category, p.p_name AS product_name, p.p_size AS size,
         (l.l_extendedprice * (1 - l.l_discount) / l.l_quantity) * l.l_quantity - 0.0::DOUBLE + 0.0::DOUBLE AS amount
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_join_date FROM orders GROUP BY o_custkey) j
         ON j.o_custkey = c.c_custkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
),
tx AS (
  SELECT * FROM fact_all
  WHERE transaction_date >= CAST((SELECT max(transaction_date) + 2 FROM fact_all) - INTERVAL {12 * YEARS} MONTH AS DATE)
),
asof_t AS (SELECT max(transaction_date) + 2 AS as_of FROM tx)"""

EVENTS = f"""
ev_all AS (
  SELECT event_id, user_id AS customer_id, event_type AS event_name, ts AS event_ts,
         CAST(ts AS DATE) AS event_date, value, props
  FROM events
),
ev AS (
  SELECT * FROM ev_all
  WHERE event_date >= CAST((SELECT max(event_date) + 2 FROM ev_all) - INTERVAL {12 * YEARS} MONTH AS DATE)
),
ev_asof_t AS (SELECT max(event_date) + 2 AS as_of FROM ev)"""


def ddiff(a: str, b: str) -> str:
    """Spark ``datediff(b, a)`` (an INTEGER)."""
    return f"CAST(date_diff('day', {a}, {b}) AS INTEGER)"


def money_sum(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE)"


def money_avg(x: str, places: int = 2) -> str:
    return f"CAST(round(avg(CAST({x} AS DECIMAL(18,4))), {places}) AS DOUBLE)"


def percentile(name: str, src: str, col: str, probs: list[float]) -> str:
    """CTE ``name`` with one row, columns p0..pk: exact percentiles with Spark's interpolation
    ``(hi_pos - pos) * lo + (pos - lo_pos) * hi`` (no interpolation when the position is whole or
    both neighbours are equal), so bin edges agree to the last bit."""
    parts = [
        f"{name}_s AS (SELECT CAST({col} AS DOUBLE) AS x, row_number() OVER (ORDER BY {col}) - 1 AS i "
        f"FROM {src} WHERE {col} IS NOT NULL)",
        f"{name}_n AS (SELECT count(*) AS n FROM {name}_s)",
    ]
    cols = []
    for k, q in enumerate(probs):
        pos = f"(CAST(n - 1 AS DOUBLE) * CAST({float(q)!r} AS DOUBLE))"
        lo = f"(SELECT x FROM {name}_s WHERE i = CAST(floor({pos}) AS BIGINT))"
        hi = f"(SELECT x FROM {name}_s WHERE i = CAST(ceil({pos}) AS BIGINT))"
        cols.append(f"CASE WHEN floor({pos}) = ceil({pos}) OR {lo} = {hi} THEN {lo} "
                    f"ELSE (ceil({pos}) - {pos}) * {lo} + ({pos} - floor({pos})) * {hi} END AS p{k}")
    parts.append(f"{name} AS (SELECT {', '.join(cols)} FROM {name}_n)")
    return ",\n".join(parts)


CYCLE = """
cyc AS (
  SELECT customer_id, count(*) AS n_rows, min(transaction_date) AS first_purchase,
         max(transaction_date) AS last_purchase,
         CAST(date_diff('day', min(transaction_date), max(transaction_date)) AS INTEGER) AS span_days,
         CAST(CASE WHEN count(*) > 1
                   THEN date_diff('day', min(transaction_date), max(transaction_date)) // (count(*) - 1)
                   ELSE 0 END AS BIGINT) AS avg_pur_cycle
  FROM tx GROUP BY customer_id
),
cyc_nz AS (SELECT * FROM cyc WHERE avg_pur_cycle <> 0)"""

FENCE = CYCLE + ",\n" + percentile("fq", "cyc_nz", "avg_pur_cycle", [0.25, 0.75]) + """,
fence AS (SELECT fq.p0 AS q1, fq.p1 AS q3, fq.p1 - fq.p0 AS iqr, fq.p1 + 1.5 * (fq.p1 - fq.p0) AS upper_bound FROM fq),
lab AS (
  SELECT customer_id, max(transaction_date) AS last_purchase,
         CAST(date_diff('day', max(transaction_date), (SELECT as_of FROM asof_t)) AS INTEGER) AS days_since,
         CAST(date_diff('day', max(transaction_date), (SELECT as_of FROM asof_t)) AS DOUBLE)
           > (SELECT upper_bound FROM fence) AS is_churned
  FROM tx GROUP BY customer_id
)"""

RFM = f"""
rfm AS (
  SELECT customer_id,
         CAST(date_diff('day', max(transaction_date), (SELECT as_of FROM asof_t)) AS INTEGER) AS recency,
         count(DISTINCT session_id) AS frequency,
         {money_sum('amount')} AS monetary,
         CAST(date_diff('day', max(first_join_date), (SELECT as_of FROM asof_t)) AS INTEGER) AS join_period
  FROM tx GROUP BY customer_id
),
""" + percentile("re", "rfm", "recency", [0.25, 0.45, 0.60, 0.75]) + ",\n" + \
    percentile("me", "rfm", "monetary", [0.2, 0.4, 0.6, 0.8]) + """,
rfm_ranked AS (SELECT *, row_number() OVER (ORDER BY frequency, customer_id) AS frank, count(*) OVER () AS n FROM rfm),
rfm_scored AS (
  SELECT customer_id, recency, frequency, monetary, join_period,
    CAST(CASE WHEN recency <= re.p0 THEN 5 WHEN recency <= re.p1 THEN 4 WHEN recency <= re.p2 THEN 3
              WHEN recency <= re.p3 THEN 2 ELSE 1 END AS INTEGER) AS recency_score,
    CAST(CASE WHEN n - 1 <= 0 THEN 1 ELSE greatest(1, ((frank - 1) * 5 + (n - 1) - 1) // (n - 1)) END AS INTEGER)
      AS frequency_score,
    CAST(CASE WHEN monetary <= me.p0 THEN 1 WHEN monetary <= me.p1 THEN 2 WHEN monetary <= me.p2 THEN 3
              WHEN monetary <= me.p3 THEN 4 ELSE 5 END AS INTEGER) AS monetary_score,
    CAST(CASE WHEN join_period <= 0 THEN NULL WHEN join_period <= 90 THEN 5 WHEN join_period <= 180 THEN 4
              WHEN join_period <= 270 THEN 3 WHEN join_period <= 360 THEN 2 WHEN join_period > 360 THEN 1 END AS INTEGER)
      AS period_score
  FROM rfm_ranked, re, me
),
rfm_seg AS (
  SELECT *, CAST(recency_score AS VARCHAR) || CAST(frequency_score AS VARCHAR) AS rf_score,
    CAST(recency_score AS VARCHAR) || CAST(frequency_score AS VARCHAR) || CAST(monetary_score AS VARCHAR) AS rfm_score,
    CASE WHEN period_score = 5 THEN 'new_customers'
         WHEN recency_score <= 2 THEN CASE WHEN frequency_score <= 2 THEN 'hibernating'
                                           WHEN frequency_score <= 4 THEN 'at_Risk' ELSE 'cant_loose' END
         WHEN recency_score = 3 THEN CASE WHEN frequency_score <= 2 THEN 'about_to_sleep'
                                          WHEN frequency_score = 3 THEN 'need_attention' ELSE 'loyal_customers' END
         WHEN recency_score = 4 THEN CASE WHEN frequency_score = 1 THEN 'promising'
                                          WHEN frequency_score <= 3 THEN 'potential_loyalists' ELSE 'loyal_customers' END
         ELSE CASE WHEN frequency_score = 1 THEN 'promising'
                   WHEN frequency_score <= 3 THEN 'potential_loyalists' ELSE 'champions' END END AS segment
  FROM rfm_scored
)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts if p.strip())

KINDS = ["click", "view", "signup", "error", "purchase"]
ACTIVITY_KINDS = ["click", "view", "signup", "error"]
BOOKING = "purchase"
GAP_US = 8 * 3600 * 1_000_000


def kind_counts(kinds=KINDS) -> str:
    return ", ".join(f"count(*) FILTER (WHERE event_name = '{k}') AS {k}" for k in kinds)


SESSIONS = EVENTS + f""",
ev_s AS (
  SELECT *, epoch_us(event_ts) AS us,
         lag(epoch_us(event_ts)) OVER (PARTITION BY customer_id ORDER BY epoch_us(event_ts), event_id) AS prev_us
  FROM ev),
ev_o AS (SELECT *, prev_us IS NULL OR us - prev_us > {GAP_US} AS opens FROM ev_s),
ev_st AS (
  SELECT *, max(CASE WHEN opens THEN event_ts END)
              OVER (PARTITION BY customer_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              AS session_start
  FROM ev_o),
ev_sid AS (SELECT *, CAST(customer_id AS VARCHAR) || '-' || CAST(epoch_us(session_start) AS VARCHAR) AS session_id
           FROM ev_st),
sess AS (
  SELECT session_id, customer_id, min(event_ts) AS session_start, max(event_ts) AS session_end,
         count(*) AS n_events, {kind_counts()}, count(*) FILTER (WHERE event_name = '{BOOKING}') > 0 AS converted
  FROM ev_sid GROUP BY session_id, customer_id)"""

CUST_COUNTS = f"""
cust_counts AS (SELECT customer_id, {kind_counts()}, count(*) AS n_events FROM ev GROUP BY customer_id),
conv AS (
  SELECT customer_id, CAST(sum({BOOKING}) AS BIGINT) AS n_bookings, CAST(sum(n_events) AS BIGINT) AS n_events,
         round(coalesce(sum({BOOKING}) * 100.0 / nullif(sum(n_events), 0), 0.0), 2) AS conversion_rate
  FROM cust_counts GROUP BY customer_id),
cust_items AS (SELECT customer_id, count(*) AS n_items, {money_sum('amount')} AS amount FROM tx GROUP BY customer_id),
activity AS (
  SELECT customer_id, {", ".join(f"CAST(sum({k}) AS BIGINT) AS {k}" for k in KINDS)},
         CAST(sum(n_events) AS BIGINT) AS n_events, {money_sum('amount')} AS amount
  FROM cust_counts JOIN cust_items USING (customer_id) GROUP BY customer_id),
aov AS (SELECT customer_id, {money_avg('amount')} AS aov FROM tx GROUP BY customer_id)"""


def full_months(s: str, e: str) -> str:
    m = f"((year({e}) - year({s})) * 12 + month({e}) - month({s}))"
    return (f"CAST(CASE WHEN {m} > 0 AND {s} + to_months(CAST({m} AS INTEGER)) > {e} THEN {m} - 1 "
            f"WHEN {m} < 0 AND {s} + to_months(CAST({m} AS INTEGER)) < {e} THEN {m} + 1 ELSE {m} END AS INTEGER)")


def age_years(b: str, a: str) -> str:
    return (f"CAST(year({a}) - year({b}) - CASE WHEN month({a}) < month({b}) OR "
            f"(month({a}) = month({b}) AND day({a}) < day({b})) THEN 1 ELSE 0 END AS INTEGER)")


def one_hot(col: str, values, prefix: str) -> str:
    import re
    return ", ".join(f"CASE WHEN {col} = '{v}' THEN 1 ELSE 0 END AS \"{prefix}_{re.sub(r'\W+', '_', v).strip('_')}\""
                     for v in values)


INFO = """
info AS (
  SELECT cyc.customer_id, cyc.avg_pur_cycle, aov.aov, rfm.recency, rfm.frequency, rfm.join_period,
         activity.click, activity.view, activity.signup, activity.error, activity.purchase, activity.n_events,
         activity.amount, rfm_seg.segment, lab.is_churned, conv.conversion_rate
  FROM cyc JOIN aov ON aov.customer_id = cyc.customer_id
       JOIN rfm ON rfm.customer_id = cyc.customer_id
       JOIN activity ON activity.customer_id = cyc.customer_id
       JOIN rfm_seg ON rfm_seg.customer_id = cyc.customer_id
       JOIN lab ON lab.customer_id = cyc.customer_id
       JOIN conv ON conv.customer_id = cyc.customer_id)"""


# --- basket -------------------------------------------------------------------------------------

MAX_SET = 5
MIN_SUPPORT = 0.01


def _itemset_ctes(k_max: int = MAX_SET) -> str:
    parts = ["""
bk AS (SELECT DISTINCT customer_id, lower(trim(item)) AS item FROM tx
       WHERE month(transaction_date) = 8 AND item IS NOT NULL),
nb AS (SELECT count(DISTINCT customer_id) AS n FROM bk),
mc AS (SELECT ceil(CAST(""" + repr(MIN_SUPPORT) + """ AS DOUBLE) * n) AS m FROM nb),
f1 AS (SELECT item AS i1, count(*) AS freq FROM bk GROUP BY item HAVING count(*) >= (SELECT m FROM mc)),
b1 AS (SELECT bk.customer_id, bk.item FROM bk JOIN f1 ON bk.item = f1.i1)"""]
    for k in range(2, k_max + 1):
        cols = ", ".join(f"x{j}.item AS i{j}" for j in range(1, k + 1))
        joins = " ".join(f"JOIN b1 x{j} ON x{j}.customer_id = x1.customer_id AND x{j - 1}.item < x{j}.item"
                         for j in range(2, k + 1))
        prev = " AND ".join(f"p.i{j} = x{j}.item" for j in range(1, k))
        grp = ", ".join(f"x{j}.item" for j in range(1, k + 1))
        parts.append(f"f{k} AS (SELECT {cols}, count(*) AS freq FROM b1 x1 {joins} "
                     f"JOIN f{k - 1} p ON {prev} GROUP BY {grp} HAVING count(*) >= (SELECT m FROM mc))")
    union = " UNION ALL ".join(
        f"SELECT [{', '.join(f'i{j}' for j in range(1, k + 1))}] AS itemset, freq, {k} AS length FROM f{k}"
        for k in range(1, k_max + 1))
    parts.append(f"fi AS (SELECT itemset, array_to_string(itemset, ', ') AS s, freq, "
                 f"freq / (SELECT n FROM nb) AS support, length FROM ({union}))")
    return ",\n".join(parts)


def _rules_cte(k_max: int = MAX_SET) -> str:
    branches = []
    for k in range(2, k_max + 1):
        for mask in range(1, 2 ** k - 1):
            ant = [f"itemset[{j + 1}]" for j in range(k) if mask >> j & 1]
            con = [f"itemset[{j + 1}]" for j in range(k) if not mask >> j & 1]
            branches.append(f"SELECT [{', '.join(ant)}] AS ant, [{', '.join(con)}] AS con, support FROM fi "
                            f"WHERE length = {k}")
    return ("rr AS (" + " UNION ALL ".join(branches) + """),
rules AS (
  SELECT ant, con, array_to_string(ant, ', ') AS antecedents, array_to_string(con, ', ') AS consequents,
         sa, sc, s, s / sa AS conf, s / sa / sc AS lift, s - sa * sc AS leverage,
         CASE WHEN s / sa < 1 THEN (1 - sc) / (1 - s / sa) END AS conviction,
         (s - sa * sc) / nullif(greatest(s * (1 - sa), sa * (sc - s)), 0) AS zhangs_metric,
         s / (sa + sc - s) AS jaccard, (s / sa - sc) / nullif(1 - sc, 0) AS certainty,
         (s / sa + s / sc) / 2 AS kulczynski
  FROM (SELECT rr.ant, rr.con, rr.support AS s, a.support AS sa, c.support AS sc
        FROM rr JOIN fi a ON a.itemset = rr.ant JOIN fi c ON c.itemset = rr.con)
  WHERE s / sa / sc >= 1.0)""")


ITEMSETS = _itemset_ctes()
RULES = ITEMSETS + ",\n" + _rules_cte()


# Wichura's AS 241 (1988), the inverse of the normal distribution: numerator and denominator, highest power first,
# for the middle (in 0.180625 - q^2) and for the tails up to 1e-11 (in sqrt(-ln p) - 1.6).
AS241_MIDDLE = ((2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4, 4.5921953931549871457e+4,
                 1.3731693765509461125e+4, 1.9715909503065514427e+3, 1.3314166789178437745e+2, 3.3871328727963666080e+0),
                (5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4, 2.1213794301586595867e+4,
                 5.3941960214247511077e+3, 6.8718700749205790830e+2, 4.2313330701600911252e+1, 1.0))
AS241_TAIL = ((7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e+0,
               3.64784832476320460504e+0, 5.76949722146069140550e+0, 4.63033784615654529590e+0, 1.42343711074968357734e+0),
              (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
               6.89767334985100004550e-1, 1.67638483018380384940e+0, 2.05319162663775882187e+0, 1.0))


def polynomial(coefficients, x: str) -> str:
    out = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def normal_quantile(p: str) -> str:
    """Inverse of the normal distribution at ``p``, a column."""
    ratio = lambda pair, x: f"{polynomial(pair[0], x)} / {polynomial(pair[1], x)}"
    return (f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {ratio(AS241_MIDDLE, f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))')} "
            f"ELSE sign({p} - 0.5) * {ratio(AS241_TAIL, f'(sqrt(-ln(least({p}, 1 - {p}))) - 1.6)')} END")


def integral(density: str, to: str) -> str:
    """Integral of a density in ``x`` from 0 to the column ``to`` by Simpson's rule on 2,000 panels."""
    return (f"(SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * ({density})) * {to} / 6000 "
            f"FROM (SELECT range AS i, {to} * range / 2000.0 AS x FROM range(2001)))")
