"""DuckDB SQL of the registered queries, over the same tables."""

from __future__ import annotations

LU = "u AS (SELECT DISTINCT CAST(l_suppkey % 10 + 1 AS INT) AS chrom, l_partkey AS pos FROM lineitem)"
LUM = "u AS (SELECT DISTINCT CAST(l_suppkey % 10 + 1 AS INT) AS chrom, l_partkey AS pos FROM lineitem WHERE l_linestatus = 'O' AND l_quantity <= 30)"
LC = """c AS (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END AS method, CAST(l_suppkey % 10 + 1 AS INT) AS chrom, l_partkey AS pos
  FROM lineitem WHERE l_quantity > 45 AND l_returnflag IN ('A', 'N', 'R'))"""
RC = """t AS (SELECT CAST(l_suppkey % 10 + 1 AS INT) AS chrom, l_partkey AS pos, l_quantity AS q, l_returnflag AS f FROM lineitem),
c AS (SELECT DISTINCT * FROM (SELECT 1 AS method, chrom, pos FROM t WHERE q > 40 UNION ALL SELECT 2, chrom, pos FROM t WHERE q > 39 UNION ALL SELECT 3, chrom, pos FROM t WHERE q > 40 AND f = 'A'))"""
EU = "u AS (SELECT CAST(user_id + 1 AS INT) AS chrom, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS pos FROM events)"
EC = """c AS (SELECT DISTINCT CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 END AS method, CAST(user_id + 1 AS INT) AS chrom,
  CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS pos FROM events WHERE event_type IN ('click', 'purchase', 'view'))"""
AXIS = "a AS (SELECT unnest(generate_series(1, (SELECT max(chrom) FROM (SELECT chrom FROM u UNION ALL SELECT chrom FROM c))))::INT AS chrom)"
M3 = "m AS (SELECT unnest([1, 2, 3]) AS method)"
CELLS = """f AS (SELECT chrom, unit, max(i) AS i, max(b1) AS b1, max(b2) AS b2, max(b3) AS b3 FROM (
  SELECT chrom, unit, 1 AS i, 0 AS b1, 0 AS b2, 0 AS b3 FROM uu UNION ALL
  SELECT chrom, unit, 0, (method = 1)::INT, (method = 2)::INT, (method = 3)::INT FROM cc) GROUP BY 1, 2),
n AS (SELECT a.chrom, coalesce(sum(i), 0)::BIGINT AS n_units, coalesce(sum(i * b1), 0)::BIGINT AS n_1, coalesce(sum(i * b2), 0)::BIGINT AS n_2, coalesce(sum(i * b3), 0)::BIGINT AS n_3,
  coalesce(sum(i * b1 * b2 * b3), 0)::BIGINT AS k_obs, coalesce(sum((1 - i) * b1), 0)::BIGINT AS o_1, coalesce(sum((1 - i) * b2), 0)::BIGINT AS o_2, coalesce(sum((1 - i) * b3), 0)::BIGINT AS o_3,
  min(CASE WHEN i = 0 AND b1 = 1 THEN unit END) AS f_1, min(CASE WHEN i = 0 AND b2 = 1 THEN unit END) AS f_2, min(CASE WHEN i = 0 AND b3 = 1 THEN unit END) AS f_3
  FROM a LEFT JOIN f ON f.chrom = a.chrom GROUP BY 1)"""


def units(window: int, u: str = LU, c: str = LC) -> str:
    unit = "pos" if window == 1 else f"CAST(floor((pos - lo)::DOUBLE / {window}) AS BIGINT)"
    first = "(SELECT chrom, min(pos) AS lo FROM u GROUP BY 1)"
    return f"""{u}, {c}, {AXIS},
uu AS (SELECT chrom, {unit} AS unit FROM u JOIN {first} USING (chrom)),
cc AS (SELECT method, chrom, {unit} AS unit FROM (SELECT c.*, coalesce(lo, 0) AS lo FROM c LEFT JOIN {first} USING (chrom))),
{CELLS}"""


def lc(n: str, k: str) -> str:
    """Log of a binomial coefficient."""
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


def hyper(s: str, t: str, n: str, total: str) -> str:
    return f"exp({lc(t, s)} + {lc(f'({total} - {t})', f'({n} - {s})')} - {lc(total, n)})"


K2 = f"""WITH {units(1, c=LC.replace("IN ('A', 'N', 'R')", "IN ('A', 'N')"))},
k AS (SELECT chrom, n_units AS n, n_1, n_2, (SELECT count(*) FROM f WHERE f.chrom = n.chrom AND i * b1 * b2 = 1) AS k_obs FROM n),
s AS (SELECT *, unnest(generate_series(greatest(k_obs, n_1 + n_2 - n, 0), least(n_1, n_2))) AS s FROM k WHERE k_obs > 0 AND k_obs <= least(n_1, n_2)),
p AS (SELECT chrom, sum({hyper('s', 'n_1', 'n_2', 'n')}) AS p FROM s GROUP BY 1)
SELECT chrom, k_obs, round(CASE WHEN n <= 0 THEN (k_obs <= 0)::INT WHEN k_obs > least(n_1, n_2) THEN 0 WHEN k_obs <= 0 THEN 1 ELSE least(1, p) END, 6) AS p_value FROM k LEFT JOIN p USING (chrom)"""
K3 = f"""WITH {units(1)},
s AS (SELECT *, unnest(generate_series(greatest(0, n_1 + n_2 - n_units), least(n_1, n_2))) AS t FROM n WHERE k_obs > 0 AND k_obs <= least(n_1, n_2, n_3)),
m AS (SELECT *, {hyper('t', 'n_1', 'n_2', 'n_units')} AS pt FROM s),
r AS (SELECT *, unnest(generate_series(greatest(k_obs, t + n_3 - n_units, 0), least(t, n_3))) AS s FROM m WHERE t >= k_obs),
p AS (SELECT chrom, sum(pt * {hyper('s', 't', 'n_3', 'n_units')}) AS p FROM r GROUP BY 1)
SELECT chrom, k_obs, round(CASE WHEN n_units <= 0 THEN (k_obs <= 0)::INT WHEN k_obs > least(n_1, n_2, n_3) THEN 0 WHEN k_obs <= 0 THEN 1 ELSE least(1, p) END, 6) AS p_value
FROM n LEFT JOIN p USING (chrom)"""

ISLANDS = """s AS (SELECT DISTINCT method, chrom, pos FROM c),
g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) > 10000 THEN 1 ELSE 0 END AS far FROM s),
i AS (SELECT method, chrom, pos, sum(far) OVER (PARTITION BY chrom ORDER BY pos RANGE UNBOUNDED PRECEDING) AS island FROM g)"""
TUPLES3 = f"""{EC}, t3 AS (SELECT x.chrom, x.pos AS p1, y.pos AS p2, z.pos AS p3 FROM c x JOIN c y ON x.chrom = y.chrom AND x.method = 1 AND y.method = 2 JOIN c z ON z.chrom = x.chrom AND z.method = 3
WHERE list_sort([x.pos, y.pos, z.pos])[2] - list_sort([x.pos, y.pos, z.pos])[1] <= 10000 AND list_sort([x.pos, y.pos, z.pos])[3] - list_sort([x.pos, y.pos, z.pos])[2] <= 10000)"""

UNIFORM = """o AS (SELECT chrom, pos, count(*) AS times FROM u GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS i, count(*) OVER (PARTITION BY chrom) AS n, sum(times) OVER (PARTITION BY chrom) AS raw,
  min(pos) OVER (PARTITION BY chrom) AS lo, max(pos) OVER (PARTITION BY chrom) - min(pos) OVER (PARTITION BY chrom) AS span FROM o),
x AS (SELECT *, (pos - lo)::DOUBLE / nullif(span, 0) AS x, least(200, greatest(20, n // 8)) AS b FROM w),
d AS (SELECT chrom, any_value(n) AS n, any_value(raw) AS raw, any_value(span) AS span, any_value(b) AS b, max(greatest(i::DOUBLE / n - x, x - (i - 1)::DOUBLE / n)) AS ks,
  sum(((2 * i - 1)::DOUBLE / (2 * n) - x) ** 2) AS cvm FROM x GROUP BY 1),
e AS (SELECT chrom, sum(c * c)::DOUBLE AS c2 FROM (SELECT chrom, (pos - lo) * b // (span + 1) AS bin, count(*) AS c FROM x GROUP BY 1, 2) GROUP BY 1),
mm AS (SELECT chrom, raw::BIGINT AS n_raw, n AS n_distinct, span AS range_bp, CASE WHEN raw >= 10 AND span > 0 THEN b::INT END AS bins_used,
  CASE WHEN raw >= 10 THEN CASE WHEN span > 0 THEN ks ELSE 1 END END AS ks_stat, CASE WHEN raw >= 10 AND span > 0 THEN 1.0::DOUBLE / (12 * n) + cvm END AS cvm_stat,
  CASE WHEN raw >= 10 AND span > 0 THEN c2 / (n::DOUBLE / b) - n END AS chi2_stat,
  CASE WHEN raw >= 10 AND span > 0 THEN sqrt(greatest(c2 / b - (n::DOUBLE / b) ** 2, 0)) / (n::DOUBLE / b) END AS cv_counts FROM d JOIN e USING (chrom))"""
LONG = """lm AS (SELECT chrom, 'ks_stat' AS metric, ks_stat AS value FROM mm UNION ALL SELECT chrom, 'cvm_stat', cvm_stat FROM mm UNION ALL SELECT chrom, 'cv_counts', cv_counts FROM mm)"""
SCORES = """sc AS (SELECT chrom, metric, value, (rank() OVER (PARTITION BY metric ORDER BY value) - 1 + (count(*) OVER (PARTITION BY metric, value) - 1) / 2) / (count(*) OVER (PARTITION BY metric) - 1)::DOUBLE AS pct_score
  FROM lm WHERE value IS NOT NULL)"""
CLASSES = """q AS (SELECT metric, quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi FROM lm GROUP BY 1),
k AS (SELECT chrom, metric, value, CASE WHEN value IS NULL THEN 'insufficient_data' WHEN value <= lo THEN 'close' WHEN value >= hi THEN 'strong' ELSE 'medium' END AS metric_class FROM lm JOIN q USING (metric))"""
COMPOSITE = """z AS (SELECT mm.chrom, composite_score FROM mm LEFT JOIN (SELECT chrom, quantile_cont(pct_score, 0.5) AS composite_score FROM sc GROUP BY 1) USING (chrom)),
zq AS (SELECT quantile_cont(composite_score, 0.25) AS lo, quantile_cont(composite_score, 0.75) AS hi FROM z),
rk AS (SELECT chrom, composite_score, row_number() OVER (ORDER BY composite_score ASC NULLS LAST, chrom)::INT AS rank,
  CASE WHEN composite_score IS NULL THEN 'insufficient_data' WHEN composite_score <= lo THEN 'close' WHEN composite_score >= hi THEN 'strong' ELSE 'medium' END AS uniformity_class FROM z, zq)"""
NOT_CLOSE = """nc AS (SELECT chrom, coalesce(string_agg(metric, ',' ORDER BY list_position(['ks_stat', 'cvm_stat', 'cv_counts'], metric)) FILTER (metric_class <> 'close'), '') AS metrics FROM k GROUP BY 1)"""
BY_CLASS = """nu AS (SELECT chrom, coalesce(string_agg(metric, ',' ORDER BY list_position(['ks_stat', 'cvm_stat', 'cv_counts'], metric)) FILTER (metric_class = 'strong'), '') AS metrics FROM k GROUP BY 1)"""

CONTAIN = f"""{RC}, n AS (SELECT chrom, method, count(*) AS n FROM c GROUP BY 1, 2), ch AS (SELECT DISTINCT chrom FROM c),
pr AS (SELECT unnest([{{'i': 1, 'j': 2}}, {{'i': 1, 'j': 3}}, {{'i': 2, 'j': 3}}]) AS p),
sh AS (SELECT x.method AS i, y.method AS j, x.chrom, count(*) AS shared FROM c x JOIN c y ON x.chrom = y.chrom AND x.pos = y.pos AND x.method < y.method GROUP BY 1, 2, 3),
co AS (SELECT p.i AS method_i, p.j AS method_j, ch.chrom, coalesce(a.n, 0) AS n_i, coalesce(b.n, 0) AS n_j, coalesce(shared, 0) AS shared FROM ch CROSS JOIN pr
  LEFT JOIN n a ON a.chrom = ch.chrom AND a.method = p.i LEFT JOIN n b ON b.chrom = ch.chrom AND b.method = p.j LEFT JOIN sh ON sh.chrom = ch.chrom AND sh.i = p.i AND sh.j = p.j)"""
CLOSE = "(least(n_i, n_j) >= 0.75 * greatest(n_i, n_j) AND shared >= 0.95 * least(n_i, n_j) AND least(n_i, n_j) > 0)"
RPAIRS = f"rp AS (SELECT method_i, method_j, count(*) FILTER (greatest(n_i, n_j) >= 5) AS usable, coalesce(bool_and({CLOSE}) FILTER (greatest(n_i, n_j) >= 5), false) AS redundant FROM co GROUP BY 1, 2)"

CROSS = "cd AS (SELECT x.chrom, abs(x.pos - y.pos) AS dist FROM c x JOIN c y ON x.chrom = y.chrom AND x.method < y.method)"
OBS = f"{CROSS}, ob AS (SELECT chrom, dist, row_number() OVER (PARTITION BY chrom ORDER BY dist) AS rnk FROM cd)"
COUNTS = "nn AS (SELECT method, chrom, count(*) AS n FROM c GROUP BY 1, 2)"


CLUSTERS = """g AS (SELECT *, count(*) OVER (PARTITION BY method, chrom) AS n, CASE WHEN pos - lag(pos) OVER (PARTITION BY method, chrom ORDER BY pos) > 5 THEN 1 ELSE 0 END AS far FROM c),
i AS (SELECT *, sum(far) OVER (PARTITION BY method, chrom ORDER BY pos) AS island FROM g), e AS (SELECT method, chrom, island, min(pos) AS a, max(pos) AS b FROM i WHERE n >= 10 GROUP BY 1, 2, 3)"""
THINNED = "SELECT method, chrom, a AS pos FROM e UNION ALL SELECT method, chrom, b FROM e WHERE b <> a UNION ALL SELECT method, chrom, pos FROM i WHERE n < 10"
COPIES = "nullif(row_number() OVER (PARTITION BY chrom, pos), 1) AS copy"


def sample(r: int, sites: str = f"(SELECT chrom, pos, {COPIES} FROM u)", seed: int = 42) -> str:
    return f"""{COUNTS}, sm AS (SELECT replicate, method, chrom, pos FROM (SELECT replicate, method, chrom, pos, n,
  row_number() OVER (PARTITION BY replicate, method, chrom ORDER BY md5(concat_ws('|', '{seed}', replicate, method, chrom, pos, copy)), pos) AS rnk
  FROM {sites} JOIN nn USING (chrom) CROSS JOIN (SELECT unnest(generate_series(1, {r}))::INT AS replicate)) WHERE rnk <= n)"""


PROFILES = """pf AS (SELECT replicate, chrom, dist, row_number() OVER (PARTITION BY replicate, chrom ORDER BY dist) AS rnk FROM
  (SELECT x.replicate, x.chrom, abs(x.pos - y.pos) AS dist FROM sm x JOIN sm y ON x.replicate = y.replicate AND x.chrom = y.chrom AND x.method < y.method)),
ex AS (SELECT chrom, rnk, avg(dist) AS avg_dist FROM pf GROUP BY 1, 2)"""


def entropy(name: str, rows: str, keys: str) -> str:
    """Relative entropy of profiles ``rows`` (keys, rnk, dist) and ex."""
    return f"""{name} AS (SELECT {keys}, sum(CASE WHEN n >= 2 AND sp > 0 AND sq > 0 AND p > 0 THEN (p / sp) * ln((p / sp) / greatest(q / sq, 1e-15)) ELSE 0 END) AS entropy FROM (
  SELECT {keys}, p, q, sum(p) OVER w AS sp, sum(q) OVER w AS sq, count(*) OVER w AS n FROM (SELECT {keys}, r.dist::DOUBLE AS p, ex.avg_dist AS q FROM {rows} r JOIN ex USING (chrom, rnk)) WINDOW w AS (PARTITION BY {keys})) GROUP BY {keys})"""


def indices(r: int, seed: int = 42) -> str:
    """The index sampler: draws until n places are different; of more than half the universe, those not drawn by N - n."""
    return f"""{COUNTS}, pl AS (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS place FROM u),
sz AS (SELECT method, chrom, replicate, have, 2 * least(n, have) > have AS most, CASE WHEN 2 * least(n, have) > have THEN have - least(n, have) ELSE n END AS m
  FROM nn JOIN (SELECT chrom, count(*) AS have FROM pl GROUP BY 1) USING (chrom) CROSS JOIN (SELECT unnest(generate_series(1, {r}))::INT AS replicate)),
jj AS (SELECT *, unnest(generate_series(1, CAST(floor(2 * m + 20 * sqrt(m) + 50) AS BIGINT))) AS j FROM sz WHERE m > 0),
dr AS (SELECT replicate, method, chrom, m, most, ('0x' || substr(md5(concat_ws('|', '{seed}', replicate, method, chrom, j)), 1, 15))::BIGINT % have AS place, min(j) AS j FROM jj GROUP BY ALL),
dk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY replicate, method, chrom ORDER BY j) AS k FROM dr) WHERE k <= m),
sm AS (SELECT replicate, method, chrom, pos FROM dk JOIN pl USING (chrom, place) WHERE NOT most UNION ALL
  SELECT replicate, method, chrom, pos FROM sz JOIN pl USING (chrom) WHERE most AND NOT EXISTS (SELECT 1 FROM dk WHERE dk.replicate = sz.replicate AND dk.method = sz.method AND dk.chrom = sz.chrom AND dk.place = pl.place))"""


def resampled(drawn: str, cut: str = "") -> str:
    return f"""{EU}, {EC}, {OBS}, {drawn}, {PROFILES}, {entropy('oe', 'ob', 'chrom')}, {entropy('re', 'pf', 'replicate, chrom')},
om AS (SELECT chrom, {cut}(quantile_cont(dist::DOUBLE, 0.5)) AS o_median FROM ob GROUP BY 1), em AS (SELECT chrom, {cut}(quantile_cont(avg_dist, 0.5)) AS e_median FROM ex GROUP BY 1),
rm AS (SELECT replicate, chrom, {cut}(quantile_cont(dist::DOUBLE, 0.5)) AS median FROM pf GROUP BY 1, 2),
oo AS (SELECT chrom, entropy, o_median, e_median FROM oe JOIN om USING (chrom) JOIN em USING (chrom)),
bb AS (SELECT oo.chrom, count(*) FILTER (re.entropy >= oo.entropy AND median <= e_median) AS b FROM oo JOIN re ON re.chrom = oo.chrom JOIN rm ON rm.chrom = oo.chrom AND rm.replicate = re.replicate GROUP BY 1),
ax AS (SELECT unnest(generate_series(1, (SELECT max(chrom) FROM u)))::INT AS chrom),
rv AS (SELECT ax.chrom, entropy, o_median, e_median, CASE WHEN entropy IS NULL OR o_median > e_median THEN 1 ELSE (coalesce(b, 0) + 1) / 6.0 END::DOUBLE AS p_value FROM ax LEFT JOIN oo USING (chrom) LEFT JOIN bb USING (chrom))"""


RESAMPLED = resampled(sample(5))

PVALUES = f"""{LU}, {LC}, {sample(8)},
tt AS (SELECT chrom, count(DISTINCT pos) AS n_units FROM u GROUP BY 1),
hh AS (SELECT replicate, chrom, pos, max((method = 1)::INT) AS b1, max((method = 2)::INT) AS b2, max((method = 3)::INT) AS b3 FROM sm GROUP BY 1, 2, 3),
n AS (SELECT replicate, chrom, n_units, sum(b1)::BIGINT AS n_1, sum(b2)::BIGINT AS n_2, sum(b3)::BIGINT AS n_3, sum(b1 * b2 * b3)::BIGINT AS k_obs FROM hh JOIN tt USING (chrom) GROUP BY 1, 2, 3),
s AS (SELECT *, unnest(generate_series(greatest(0, n_1 + n_2 - n_units), least(n_1, n_2))) AS t FROM n WHERE k_obs > 0 AND k_obs <= least(n_1, n_2, n_3)),
mp AS (SELECT *, {hyper('t', 'n_1', 'n_2', 'n_units')} AS pt FROM s),
r AS (SELECT *, unnest(generate_series(greatest(k_obs, t + n_3 - n_units, 0), least(t, n_3))) AS s FROM mp WHERE t >= k_obs),
p AS (SELECT replicate, chrom, sum(pt * {hyper('s', 't', 'n_3', 'n_units')}) AS p FROM r GROUP BY 1, 2),
pv AS (SELECT 'empirical' AS scenario, 0 AS universe_id, replicate, chrom, CASE WHEN k_obs > least(n_1, n_2, n_3) THEN 0 WHEN k_obs <= 0 THEN 1 ELSE least(1, p) END AS p_value FROM n LEFT JOIN p USING (replicate, chrom))"""


def rates(alpha: float) -> str:
    return f"fr AS (SELECT scenario, universe_id, chrom, count(*) AS n, sum((p_value <= {alpha})::INT)::BIGINT AS positives, avg((p_value <= {alpha})::INT) AS rate FROM pv GROUP BY GROUPING SETS ((scenario), (scenario, universe_id), (scenario, chrom)))"


def universes_sql(replicates: int = 4) -> str:
    """P-values on the universes (real, 0), (half, 0) and (half, 1); the seed grows with universe_id."""
    return f"""{LU}, {LUM.replace('u AS', 'v AS')}, {LC}, {COUNTS},
us AS (SELECT 'real' AS scenario, 0 AS universe_id, chrom, pos FROM u UNION ALL SELECT 'half', 0, chrom, pos FROM u WHERE pos % 2 = 0 UNION ALL SELECT 'half', 1, chrom, pos FROM v),
rr AS (SELECT unnest(generate_series(1, {replicates}))::INT AS replicate),
sm AS (SELECT * FROM (SELECT scenario, universe_id, replicate, method, chrom, pos, n,
  row_number() OVER (PARTITION BY scenario, universe_id, replicate, method, chrom ORDER BY md5(concat_ws('|', 42 + universe_id, replicate, method, chrom, pos)), pos) AS k FROM us JOIN nn USING (chrom) CROSS JOIN rr) WHERE k <= n),
tt AS (SELECT scenario, universe_id, chrom, count(DISTINCT pos) AS n_units FROM us GROUP BY 1, 2, 3),
hh AS (SELECT scenario, universe_id, replicate, chrom, pos, max((method = 1)::INT) AS b1, max((method = 2)::INT) AS b2, max((method = 3)::INT) AS b3 FROM sm GROUP BY 1, 2, 3, 4, 5),
n AS (SELECT scenario, universe_id, replicate, chrom, n_units, sum(b1)::BIGINT AS n_1, sum(b2)::BIGINT AS n_2, sum(b3)::BIGINT AS n_3, sum(b1 * b2 * b3)::BIGINT AS k_obs FROM hh JOIN tt USING (scenario, universe_id, chrom) GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT *, unnest(generate_series(greatest(0, n_1 + n_2 - n_units), least(n_1, n_2))) AS t FROM n WHERE k_obs > 0 AND k_obs <= least(n_1, n_2, n_3)),
mp AS (SELECT *, {hyper('t', 'n_1', 'n_2', 'n_units')} AS pt FROM s),
r AS (SELECT *, unnest(generate_series(greatest(k_obs, t + n_3 - n_units, 0), least(t, n_3))) AS s FROM mp WHERE t >= k_obs),
p AS (SELECT scenario, universe_id, replicate, chrom, sum(pt * {hyper('s', 't', 'n_3', 'n_units')}) AS p FROM r GROUP BY 1, 2, 3, 4),
ax AS (SELECT scenario, universe_id, unnest(generate_series(1, max(chrom)))::INT AS chrom FROM us GROUP BY 1, 2),
pv AS (SELECT ax.scenario, ax.universe_id, rr.replicate, ax.chrom, CASE WHEN k_obs IS NULL THEN 1 WHEN k_obs > least(n_1, n_2, n_3) THEN 0 WHEN k_obs <= 0 THEN 1 ELSE least(1, p) END AS p_value
  FROM ax CROSS JOIN rr LEFT JOIN n ON n.scenario = ax.scenario AND n.universe_id = ax.universe_id AND n.replicate = rr.replicate AND n.chrom = ax.chrom
  LEFT JOIN p ON p.scenario = ax.scenario AND p.universe_id = ax.universe_id AND p.replicate = rr.replicate AND p.chrom = ax.chrom)"""


def distance_calibration(replicates: int = 3, nulls: int = 4) -> str:
    """P-values of the distance test in two universes, both passes by the hash sampler."""
    keys = "universe_id, replicate, chrom"

    def drawn(name: str, r: int, seed: int) -> str:
        return f"""{name} AS (SELECT * FROM (SELECT universe_id, replicate, method, chrom, pos, n,
  row_number() OVER (PARTITION BY universe_id, replicate, method, chrom ORDER BY md5(concat_ws('|', {seed} + universe_id, replicate, method, chrom, pos, copy)), pos) AS k
  FROM us JOIN nn USING (chrom) CROSS JOIN (SELECT unnest(generate_series(1, {r}))::INT AS replicate)) WHERE k <= n),
{name}p AS (SELECT {keys}, dist, row_number() OVER (PARTITION BY {keys} ORDER BY dist) AS rnk FROM
  (SELECT x.universe_id, x.replicate, x.chrom, abs(x.pos - y.pos) AS dist FROM {name} x JOIN {name} y ON x.universe_id = y.universe_id AND x.replicate = y.replicate AND x.chrom = y.chrom AND x.method < y.method))"""

    def summed(name: str) -> str:
        return f"""{name}s AS (SELECT {keys}, sum(CASE WHEN n >= 2 AND sp > 0 AND sq > 0 AND p > 0 THEN (p / sp) * ln((p / sp) / greatest(q / sq, 1e-15)) ELSE 0 END) AS entropy, quantile_cont(p, 0.5) AS median FROM (
  SELECT {keys}, p, q, sum(p) OVER w AS sp, sum(q) OVER w AS sq, count(*) OVER w AS n FROM (SELECT {keys}, r.dist::DOUBLE AS p, ex.avg_dist AS q FROM {name}p r JOIN ex USING (universe_id, chrom, rnk)) WINDOW w AS (PARTITION BY {keys})) GROUP BY {keys})"""

    return f"""{EU}, {EC}, {COUNTS}, us AS (SELECT 0 AS universe_id, chrom, pos, {COPIES} FROM u UNION ALL SELECT 1, chrom, pos, {COPIES} FROM u WHERE pos % 3 > 0),
{drawn('nl', nulls, 42)}, {drawn('tr', replicates, 43)}, ex AS (SELECT universe_id, chrom, rnk, avg(dist) AS avg_dist FROM nlp GROUP BY 1, 2, 3), {summed('nl')}, {summed('tr')},
md AS (SELECT universe_id, chrom, quantile_cont(avg_dist, 0.5) AS e_median FROM ex GROUP BY 1, 2),
hd AS (SELECT trs.universe_id, trs.replicate, trs.chrom, CASE WHEN any_value(trs.median) > any_value(e_median) THEN 1 ELSE (count(*) FILTER (nls.entropy >= trs.entropy AND nls.median <= e_median) + 1) / {nulls + 1}.0 END AS p
  FROM trs JOIN nls ON nls.universe_id = trs.universe_id AND nls.chrom = trs.chrom JOIN md ON md.universe_id = trs.universe_id AND md.chrom = trs.chrom GROUP BY 1, 2, 3),
ax AS (SELECT universe_id, unnest(generate_series(1, max(chrom)))::INT AS chrom FROM us GROUP BY 1),
pv AS (SELECT 'real' AS scenario, ax.universe_id, rr.replicate, ax.chrom, coalesce(p, 1)::DOUBLE AS p_value FROM ax CROSS JOIN (SELECT unnest(generate_series(1, {replicates}))::INT AS replicate) rr
  LEFT JOIN hd ON hd.universe_id = ax.universe_id AND hd.replicate = rr.replicate AND hd.chrom = ax.chrom)"""


def warned() -> str:
    absent = ", ".join(f"CASE WHEN o_{m} > 0 THEN 'method {m}: ' || o_{m} || ' not in the universe, first ' || f_{m} END" for m in (1, 2, 3))
    return f"concat_ws('; ', CASE WHEN n_units <= 1 THEN 'degenerate universe' WHEN n_units < 10 THEN 'very small universe' WHEN n_units < 20 THEN 'small universe' END, {absent})"


DENSE = "(SELECT chrom, coalesce(sum((method = 1)::INT), 0)::BIGINT AS sites_1, coalesce(sum((method = 2)::INT), 0)::BIGINT AS sites_2, coalesce(sum((method = 3)::INT), 0)::BIGINT AS sites_3 FROM c GROUP BY 1)"
TOTALS = "(SELECT chrom, count(*) AS total_sites FROM u GROUP BY 1)"
K3_EXACT = K3.replace("WITH " + units(1) + ",", "WITH").replace("round(CASE", "(CASE").replace("END, 6) AS p_value", "END) AS p_value")
PICK = "SELECT method, chrom, count(*) AS n FROM c GROUP BY 1, 2"

ORACLE_SQL: dict[str, str] = {
    "site_counts": f"WITH {LC} SELECT method, CASE WHEN grouping(chrom) = 1 THEN 0 ELSE chrom END AS chrom, count(*) AS n FROM c GROUP BY GROUPING SETS ((method, chrom), (method))",
    "site_stats": f"WITH {LC} SELECT method, chrom, min(pos) AS min_pos, max(pos) AS max_pos, max(pos) - min(pos) + 1 AS range_bp, round(avg(pos), 6) AS mean_pos, round(stddev_pop(pos), 6) AS sd_pos, round(quantile_cont(pos::DOUBLE, 0.5), 6) AS median_pos FROM c GROUP BY 1, 2",
    "range_stats": f"WITH {LC}, s AS (SELECT method, max(pos) - min(pos) + 1 AS r FROM c GROUP BY method, chrom) SELECT method, round(avg(r), 6) AS mean_range, round(stddev_pop(r), 6) AS sd_range FROM s GROUP BY 1",
    "cross_distance_counts": f"WITH {EC}, n AS (SELECT chrom, method, count(*) AS n FROM c GROUP BY 1, 2) SELECT chrom, ((sum(n) * sum(n) - sum(n * n)) / 2)::BIGINT AS n_dist FROM n GROUP BY 1",
    "dense_counts": f"WITH {EU}, {EC}, {M3}, a AS (SELECT unnest(generate_series(1, (SELECT max(chrom) FROM u)))::INT AS chrom), n AS ({PICK}) SELECT m.method, a.chrom, coalesce(n.n, 0) AS n FROM a CROSS JOIN m LEFT JOIN n ON n.method = m.method AND n.chrom = a.chrom",
    "testable_chromosomes": f"WITH {EC} SELECT chrom FROM c GROUP BY 1 HAVING count(DISTINCT method) >= 2",
    "axis_mismatch": f"WITH {LU}, {LC} SELECT method, max(c.chrom) AS max_chrom, (SELECT max(chrom) FROM u WHERE chrom < 10) AS universe_max FROM c GROUP BY 1 HAVING max(c.chrom) <> (SELECT max(chrom) FROM u WHERE chrom < 10)",
    "overlap_units_w1": f"WITH {units(1)} SELECT chrom, n_units, n_1, n_2, n_3, k_obs FROM n",
    "overlap_units_w10": f"WITH {units(10)} SELECT chrom, n_units, n_1, n_2, n_3, k_obs FROM n",
    "missing_from_universe": f"WITH {LUM}, {LC} SELECT method, chrom, count(*) AS n_missing, min(pos) AS first_missing FROM c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.chrom = c.chrom AND u.pos = c.pos) GROUP BY 1, 2",
    "in_universe": f"WITH {LUM}, {LC} SELECT method, chrom, count(*) AS n FROM c WHERE EXISTS (SELECT 1 FROM u WHERE u.chrom = c.chrom AND u.pos = c.pos) GROUP BY 1, 2",
    "kway_overlap": f"WITH {units(1)} SELECT chrom, k_obs FROM n",
    "expected_overlap": f"WITH {units(1)} SELECT chrom, round(CASE WHEN n_units > 0 THEN n_1::DOUBLE * n_2 * n_3 / n_units::DOUBLE ** 2 END, 6) AS expected_k FROM n",
    "overlap_pvalue_k2": K2,
    "overlap_pvalue_k3": K3,
    "overlap_warnings": f"WITH {units(1, u=LUM)} SELECT chrom, {warned()} AS warnings, o_1 + o_2 + o_3 > 0 AS missing FROM n",
    "thin_clusters": f"WITH {LC}, {CLUSTERS} {THINNED}",
    "islands": f"WITH {EC}, {ISLANDS} SELECT chrom, island::BIGINT AS island, count(*) AS sites, min(pos) AS first_pos, max(pos) AS last_pos FROM i GROUP BY 1, 2",
    "proximity_pairs": f"WITH {EC} SELECT x.method AS method_i, y.method AS method_j, x.chrom, x.pos AS pos_i, y.pos AS pos_j FROM c x JOIN c y ON x.chrom = y.chrom AND x.method < y.method AND abs(x.pos - y.pos) <= 10000",
    "proximity_tuples3": f"WITH {TUPLES3} SELECT chrom, 'SEL_123' AS subset, 3 AS size, p1, p2, p3 FROM t3",
    "kway_sites": f"WITH {TUPLES3} SELECT DISTINCT chrom, unnest([p1, p2, p3]) AS pos FROM t3",
    "tuple_difference": f"WITH {EC} SELECT CASE WHEN abs(x.pos - y.pos) > 10000 THEN 'right' ELSE 'left' END AS side, count(*) AS n FROM c x JOIN c y ON x.chrom = y.chrom AND x.method < y.method AND ((abs(x.pos - y.pos) <= 10000 AND x.pos % 7 = 0) OR (abs(x.pos - y.pos) > 10000 AND abs(x.pos - y.pos) <= 12000 AND x.pos % 7 <> 0)) GROUP BY 1",
    "spatial_uniformity": f"WITH {EU}, {UNIFORM} SELECT chrom, n_raw, n_distinct, range_bp, bins_used, round(ks_stat, 6) AS ks_stat, round(cvm_stat, 6) AS cvm_stat, round(chi2_stat, 6) AS chi2_stat, round(cv_counts, 6) AS cv_counts FROM mm",
    "uniformity_scores": f"WITH {EU}, {UNIFORM}, {LONG}, {SCORES} SELECT chrom, metric, round(value, 6) AS value, round(pct_score, 6) AS pct_score FROM sc",
    "rank_composite": f"WITH {EU}, {UNIFORM}, {LONG}, {SCORES}, {COMPOSITE} SELECT chrom, round(composite_score, 6) AS composite_score, rank, uniformity_class FROM rk",
    "rank_multivariate": f"""WITH {EU}, {UNIFORM}, {LONG}, {CLASSES}, v AS (SELECT chrom, count(value) AS known, count(*) FILTER (metric_class = 'close') AS cl, count(*) FILTER (metric_class = 'strong') AS st FROM k GROUP BY 1)
SELECT mm.chrom, round(ks_stat, 6) AS ks_stat, row_number() OVER (ORDER BY ks_stat ASC NULLS LAST, mm.chrom)::INT AS rank, CASE WHEN known = 0 THEN 'insufficient_data' WHEN cl >= 2 THEN 'close' WHEN st >= 2 THEN 'strong' ELSE 'medium' END AS uniformity_class FROM mm JOIN v USING (chrom)""",
    "rank_terciles": f"""WITH {EU}, {UNIFORM}, tq AS (SELECT quantile_cont(ks_stat, 0.33) AS lo, quantile_cont(ks_stat, 0.66) AS hi FROM mm)
SELECT chrom, round(ks_stat, 6) AS ks_stat, row_number() OVER (ORDER BY ks_stat ASC NULLS LAST, chrom)::INT AS rank, CASE WHEN ks_stat IS NULL THEN 'insufficient_data' WHEN ks_stat <= lo THEN 'close' WHEN ks_stat >= hi THEN 'strong' ELSE 'medium' END AS uniformity_class FROM mm, tq""",
    "metric_classes": f"WITH {EU}, {UNIFORM}, {LONG}, {CLASSES} SELECT chrom, metric, round(value, 6) AS value, metric_class FROM k",
    "metrics_by_class": f"WITH {EU}, {UNIFORM}, {LONG}, {CLASSES}, {BY_CLASS} SELECT chrom, metrics FROM nu",
    "metrics_not_close": f"WITH {EU}, {UNIFORM}, {LONG}, {CLASSES}, {NOT_CLOSE} SELECT chrom, metrics FROM nc",
    "containment": f"WITH {CONTAIN} SELECT * FROM co",
    "redundant_pairs": f"WITH {CONTAIN}, {RPAIRS} SELECT * FROM rp",
    "redundant_pairs_global": f"WITH {CONTAIN}, g AS (SELECT method_i, method_j, sum(n_i)::BIGINT AS n_i, sum(n_j)::BIGINT AS n_j, sum(shared)::BIGINT AS shared FROM co GROUP BY 1, 2) SELECT *, {CLOSE} AS redundant FROM g",
    "drop_redundant": f"""WITH {CONTAIN}, {RPAIRS}, tot AS (SELECT method, count(*) AS n FROM c GROUP BY 1)
SELECT method, n FROM tot WHERE method NOT IN (SELECT CASE WHEN x.n < y.n THEN method_i ELSE method_j END FROM (SELECT * FROM rp WHERE redundant ORDER BY method_i, method_j LIMIT 1) JOIN tot x ON x.method = method_i JOIN tot y ON y.method = method_j)""",
    "cross_distances": f"WITH {EC}, {CROSS} SELECT chrom, count(*) AS n, sum(dist)::BIGINT AS total, min(dist) AS least, max(dist) AS most FROM cd GROUP BY 1",
    "nearest_distances": f"WITH {EC}, {OBS} SELECT chrom, dist, rnk::INT AS rnk FROM ob WHERE rnk <= 10",
    "distance_median": f"WITH {EC}, {CROSS} SELECT chrom, round(quantile_cont(dist::DOUBLE, 0.5), 6) AS median FROM cd GROUP BY 1",
    "sample_without_replacement": f"WITH {EU}, {EC}, {sample(2)} SELECT * FROM sm",
    "sample_uniform": f"""WITH {EU}, {EC}, {COUNTS}, e AS (SELECT chrom, min(pos) AS lo, max(pos) AS hi FROM u GROUP BY 1),
j AS (SELECT *, unnest(generate_series(1, n)) AS j FROM nn JOIN e USING (chrom) CROSS JOIN (SELECT unnest([1, 2])::INT AS replicate))
SELECT replicate, method, chrom, lo + ('0x' || substr(md5(concat_ws('|', '42', replicate, method, chrom, j)), 1, 15))::BIGINT % (hi - lo + 1) AS pos FROM j""",
    "sites_of_windows": f"""WITH {LU}, {LC}, uw AS (SELECT chrom, pos, CAST(floor((pos - lo)::DOUBLE / 10) AS BIGINT) AS unit FROM u JOIN (SELECT chrom, min(pos) AS lo FROM u GROUP BY 1) USING (chrom)),
{sample(1, '(SELECT DISTINCT chrom, unit AS pos, NULL AS copy FROM uw)')},
pk AS (SELECT replicate, method, chrom, uw.pos, row_number() OVER (PARTITION BY replicate, method, chrom, unit ORDER BY md5(concat_ws('|', '42', replicate, method, chrom, uw.pos)), uw.pos) AS k FROM sm JOIN uw USING (chrom) WHERE uw.unit = sm.pos)
SELECT replicate, method, chrom, pos FROM pk WHERE k = 1""",
    "expected_profile": f"WITH {EU}, {EC}, {sample(5)}, {PROFILES} SELECT chrom, rnk::INT AS rnk, round(avg_dist, 6) AS avg_dist FROM ex",
    "profile_entropy": f"WITH {EU}, {EC}, {OBS}, {sample(5)}, {PROFILES}, {entropy('oe', 'ob', 'chrom')} SELECT chrom, round(entropy, 6) AS entropy FROM oe",
    "distance_histogram": f"""WITH {EU}, {EC}, {OBS}, {sample(5)}, {PROFILES}, ey AS (SELECT chrom, rnk, round(avg_dist, 6) AS v FROM ex),
hb AS (SELECT chrom, CASE WHEN span = 0 THEN 30 ELSE least(500, greatest(30, ceil(span / (2 * CASE WHEN iqr = 0 THEN 1 ELSE iqr END / n ** (1.0 / 3))))) END::BIGINT AS nb
  FROM (SELECT chrom, count(*) AS n, max(v) - min(v) AS span, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM ey GROUP BY 1)),
al AS (SELECT chrom, 'observed' AS series, dist::DOUBLE AS v FROM ob UNION ALL SELECT chrom, 'expected', v FROM ey),
en AS (SELECT chrom, min(v) AS lo, max(v) AS hi FROM al GROUP BY 1),
bi AS (SELECT chrom, series, CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) * nb / (hi - lo))::BIGINT, nb - 1) END AS bin FROM al JOIN en USING (chrom) JOIN hb USING (chrom))
SELECT chrom, series, bin, round(count(*) / sum(count(*)) OVER (PARTITION BY chrom, series), 6) AS freq FROM bi GROUP BY chrom, series, bin""",
    "resampling_pvalue": f"WITH {RESAMPLED} SELECT chrom, round(entropy, 6) AS entropy, round(o_median, 6) AS o_median, round(e_median, 6) AS e_median, round(p_value, 6) AS p_value FROM rv",
    "resampling_pvalue_truncated": f"WITH {resampled(sample(5), 'floor')} SELECT chrom, round(entropy, 6) AS entropy, o_median, e_median, round(p_value, 6) AS p_value FROM rv",
    "resampling_pvalue_indices": f"WITH {resampled(indices(5))} SELECT chrom, round(entropy, 6) AS entropy, round(o_median, 6) AS o_median, round(e_median, 6) AS e_median, round(p_value, 6) AS p_value FROM rv",
    "sample_indices": f"WITH {EU}, {EC}, {indices(2)} SELECT * FROM sm",
    "calibrate_overlap_universes": f"WITH {universes_sql()}, {rates(0.5)} SELECT scenario, universe_id, chrom, n, positives, round(rate, 6) AS rate FROM fr",
    "calibrate_overlap_windows": f"""WITH {LU}, {LC}, {COUNTS}, w AS (SELECT DISTINCT chrom, CAST(floor((pos - lo)::DOUBLE / 10) AS BIGINT) AS pos FROM u JOIN (SELECT chrom, min(pos) AS lo FROM u GROUP BY 1) USING (chrom)),
sm AS (SELECT * FROM (SELECT replicate, method, chrom, pos, n, row_number() OVER (PARTITION BY replicate, method, chrom ORDER BY md5(concat_ws('|', '42', replicate, method, chrom, pos)), pos) AS k
  FROM w JOIN nn USING (chrom) CROSS JOIN (SELECT unnest([1, 2])::INT AS replicate)) WHERE k <= n),
h AS (SELECT replicate, chrom, pos, count(DISTINCT method) AS k FROM sm GROUP BY 1, 2, 3)
SELECT 'empirical' AS scenario, 0 AS universe_id, replicate, chrom, round(avg((k = 3)::INT), 6) AS p_value FROM h GROUP BY 3, 4""",
    "calibrate_distance": f"WITH {distance_calibration()}, {rates(0.5)} SELECT scenario, universe_id, chrom, n, positives, round(rate, 6) AS rate FROM fr",
    "read_layouts": f"""WITH {LU}, l AS (SELECT unnest(['comma.csv', 'semicolon.csv', 'plain.map', 'first.tped', 'two.txt', 'three.hapflk']) AS layout)
SELECT layout, chrom, count(*) AS n, sum(pos)::BIGINT AS total FROM u CROSS JOIN l GROUP BY 1, 2 UNION ALL SELECT 'last.norm', 1, count(*), sum(pos)::BIGINT FROM u WHERE pos % 3 = 2""",
    "load_files": f"""WITH {LU}, c AS (SELECT 1 AS method, chrom FROM u UNION ALL SELECT 2, 1 FROM u WHERE pos % 3 = 2 UNION ALL SELECT 3, chrom FROM u)
SELECT method, CASE WHEN grouping(chrom) = 1 THEN 0 ELSE chrom END AS chrom, count(*) AS n, CASE method WHEN 1 THEN 'comma' WHEN 2 THEN 'last' ELSE 'three' END AS name FROM c GROUP BY GROUPING SETS ((method, chrom), (method))""",
    "one_chromosome_tuples": f"WITH {EC} SELECT x.chrom, 'SEL_' || x.method || y.method AS subset, x.pos AS p1, y.pos AS p2 FROM c x JOIN c y ON x.chrom = y.chrom AND x.method < y.method AND abs(x.pos - y.pos) <= 10000 WHERE x.chrom = 7",
    "fp_rates": f"WITH {PVALUES}, {rates(0.05)} SELECT scenario, universe_id, chrom, n, positives, round(rate, 6) AS rate FROM fr",
    "fwer": f"""WITH {PVALUES}, ks AS (SELECT scenario, universe_id, replicate, count(*) FILTER (p_value <= 0.05) AS k_sig FROM pv GROUP BY 1, 2, 3)
SELECT scenario, universe_id, round(avg((k_sig > 0)::INT), 6) AS fwer, round(avg(k_sig), 6) AS mean_sig, round(var_pop(k_sig), 6) AS var_sig, round(1 - 0.95::DOUBLE ** 10, 6) AS expected FROM ks GROUP BY GROUPING SETS ((scenario), (scenario, universe_id))""",
    "fp_summary": f"""WITH {PVALUES}, {rates(0.05)}, fu AS (SELECT scenario, avg(rate) AS m, stddev_samp(rate) AS sd, var_samp(rate) AS va, count(*) AS n_eff FROM fr WHERE universe_id IS NOT NULL GROUP BY 1),
fc AS (SELECT scenario, min(rate) AS a, quantile_cont(rate, 0.5) AS b, max(rate) AS c FROM fr WHERE chrom IS NOT NULL GROUP BY 1)
SELECT scenario, round(m, 6) AS mean_rate, round(sd, 6) AS sd_rate, round(va, 6) AS var_rate, n_eff, round(sd / sqrt(n_eff), 6) AS se_rate, round(a, 6) AS chrom_min, round(b, 6) AS chrom_median, round(c, 6) AS chrom_max FROM fu JOIN fc USING (scenario)""",
    "fp_summary_universes": f"""WITH {universes_sql()}, {rates(0.5)}, fu AS (SELECT scenario, avg(rate) AS m, stddev_samp(rate) AS sd, var_samp(rate) AS va, count(*) AS n_eff FROM fr WHERE universe_id IS NOT NULL GROUP BY 1),
fc AS (SELECT scenario, min(rate) AS a, quantile_cont(rate, 0.5) AS b, max(rate) AS c FROM fr WHERE chrom IS NOT NULL GROUP BY 1)
SELECT scenario, round(m, 6) AS mean_rate, round(sd, 6) AS sd_rate, round(va, 6) AS var_rate, n_eff, round(sd / sqrt(n_eff), 6) AS se_rate, round(a, 6) AS chrom_min, round(b, 6) AS chrom_median, round(c, 6) AS chrom_max FROM fu JOIN fc USING (scenario)""",
    "counts_table": f"""WITH {LU}, {LC}, {CLUSTERS}, t AS ({THINNED}), r AS (SELECT method, count(*) AS sites_read FROM c GROUP BY 1), k AS (SELECT method, count(*) AS sites FROM t GROUP BY 1)
SELECT 0 AS method, 'universe' AS name, count(*) AS sites, count(*) AS sites_read, '' AS note FROM u UNION ALL
SELECT method, 'm' || method, coalesce(sites, 0), sites_read, CASE WHEN coalesce(sites, 0) <> sites_read THEN 'after grouping from ' || sites_read ELSE '' END FROM r LEFT JOIN k USING (method)""",
    "pvalue_text": f"WITH {RESAMPLED} SELECT chrom, printf('%.4f', CASE WHEN p_value <= 0 THEN 1.0 / 10001 ELSE p_value END) AS p FROM rv",
    "read_ragged": f"WITH {LU} SELECT chrom, count(*) AS n, sum(pos)::BIGINT AS total FROM u WHERE pos % 5 <> 0 AND pos % 7 <> 0 GROUP BY 1",
    "fp_top_chromosomes": f"WITH {PVALUES}, {rates(0.5)}, ra AS (SELECT scenario, chrom, rate, row_number() OVER (PARTITION BY scenario ORDER BY rate DESC, chrom)::INT AS rank FROM fr WHERE chrom IS NOT NULL) SELECT scenario, chrom, round(rate, 6) AS rate, rank FROM ra WHERE rank <= 10",
    "report_overlap": f"""WITH {units(1)}, {UNIFORM.replace('e AS', 'eb AS').replace('JOIN e USING', 'JOIN eb USING')}, {LONG}, {SCORES}, {COMPOSITE}, {CLASSES}, {NOT_CLOSE}, pp AS ({K3.replace('WITH ' + units(1) + ',', 'WITH')})
SELECT n.chrom, n_units, n_1 AS units_1, n_2 AS units_2, n_3 AS units_3, n.k_obs, round(CASE WHEN n_units > 0 THEN n_1::DOUBLE * n_2 * n_3 / n_units::DOUBLE ** 2 END, 6) AS expected_k, p_value,
sites_1, sites_2, sites_3, coalesce(total_sites, 0) AS total_sites, round(composite_score, 6) AS composite_score, rank, uniformity_class, metrics AS not_uniform
FROM n JOIN pp USING (chrom) LEFT JOIN {DENSE} de USING (chrom) LEFT JOIN {TOTALS} tot USING (chrom) LEFT JOIN rk USING (chrom) LEFT JOIN nc USING (chrom)""",
    "report_text": f"""WITH {units(1)}, {UNIFORM.replace('e AS', 'eb AS').replace('JOIN e USING', 'JOIN eb USING')}, {LONG}, {SCORES}, {COMPOSITE}, pp AS ({K3_EXACT})
SELECT n.chrom::VARCHAR AS CHR, total_sites::VARCHAR AS TOTALS, n_units::VARCHAR AS Nc, sites_1::VARCHAR AS SNPs1, n_1::VARCHAR AS n1, n.k_obs::VARCHAR AS kobs, CASE WHEN p_value > 1e-6 THEN printf('%.6f', p_value) ELSE printf('%.6e', p_value) END AS Pr, uniformity_class AS Uclasf
FROM n JOIN pp USING (chrom) LEFT JOIN {DENSE} de USING (chrom) LEFT JOIN {TOTALS} tot USING (chrom) LEFT JOIN rk USING (chrom)""",
    "report_distance": f"""WITH {resampled(sample(5), 'floor')}, {UNIFORM.replace('o AS', 'ou AS').replace('FROM o)', 'FROM ou)')}, {LONG}, {SCORES}, {COMPOSITE}, {CLASSES}, {NOT_CLOSE}
SELECT rv.chrom, round(entropy, 6) AS entropy, round(p_value, 6) AS p_value, floor(o_median)::BIGINT AS o_q2, floor(e_median)::BIGINT AS e_q2, coalesce(sites_1, 0) AS sites_1, coalesce(sites_2, 0) AS sites_2, coalesce(sites_3, 0) AS sites_3,
coalesce(total_sites, 0) AS total_sites, round(composite_score, 6) AS composite_score, rank, uniformity_class, metrics AS not_uniform
FROM rv LEFT JOIN {DENSE} de USING (chrom) LEFT JOIN {TOTALS} tot USING (chrom) LEFT JOIN rk USING (chrom) LEFT JOIN nc USING (chrom)""",
    "report_intersections_wide": f"""WITH {TUPLES3}, al AS (
SELECT chrom, 'SEL_123' AS subset, [p1, p2, p3] AS p FROM t3 UNION ALL
SELECT x.chrom, 'SEL_' || x.method || y.method, [x.pos, y.pos] FROM c x JOIN c y ON x.chrom = y.chrom AND x.method < y.method AND abs(x.pos - y.pos) <= 10000),
ks AS (SELECT DISTINCT chrom, 'sites' AS subset, [unnest([p1, p2, p3])] AS p FROM t3),
nr AS (SELECT chrom, subset, array_to_string(p, ',') AS t, row_number() OVER (PARTITION BY chrom, subset ORDER BY p)::INT AS row FROM (SELECT * FROM al UNION ALL SELECT * FROM ks))
SELECT chrom, row, '1E4' AS distance, max(CASE WHEN subset = 'sites' THEN t END) AS intersec_sites, max(CASE WHEN subset = 'SEL_12' THEN t END) AS SEL_12, max(CASE WHEN subset = 'SEL_13' THEN t END) AS SEL_13, max(CASE WHEN subset = 'SEL_23' THEN t END) AS SEL_23, max(CASE WHEN subset = 'SEL_123' THEN t END) AS SEL_123 FROM nr GROUP BY 1, 2""",
    "significant_tuples": f"""WITH {RESAMPLED}, {TUPLES3.replace(EC + ', ', '')} SELECT chrom, count(*) AS n FROM t3 WHERE chrom IN (SELECT chrom FROM rv WHERE p_value <= 0.5) GROUP BY 1""",
}
