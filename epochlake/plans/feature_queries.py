"""Feature families over the epoch store (embeddings: one epoch of 64 samples a row)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlake.functions import batches
from epochlake.functions import features as ft

FS = 128.0
QUERIES, ORACLE_SQL = {}, {}

E = "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings)"
Z = E + ", z AS (SELECT vec_id, i, (x - avg(x) OVER w) / (stddev_samp(x) OVER w + 2.220446049250313e-16) AS x FROM e WINDOW w AS (PARTITION BY vec_id))"


def store(spark, sf_dir) -> DataFrame:
    """(vec_id, x): the epoch store."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def family(name: str, build, sql: str, columns: list[str]) -> None:
    """Registers a query that returns vec_id and the rounded columns of a struct or single expression."""

    def run(spark, sf_dir):
        f = store(spark, sf_dir).select("vec_id", build(F.col("x")).alias("f"))
        pick = (lambda c: F.col("f")) if len(columns) == 1 else (lambda c: F.col(f"f.{c}"))
        return f.select("vec_id", *[F.round(pick(c), 6).alias(c) for c in columns])

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT vec_id, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM ({sql})"


def stacked(fn, columns: list[str], **room):
    """A struct of the values of a function of stacks of epochs."""
    return lambda x: batches.named(batches.over(fn, len(columns), x, **room), columns)


def moment_sql() -> str:
    return E + """,
d AS (SELECT vec_id, i, x, x - avg(x) OVER (PARTITION BY vec_id) AS c, lead(x) OVER w - x AS d1, lead(x, 2) OVER w - 2 * lead(x) OVER w + x AS d2,
      sign(lead(x) OVER w) <> sign(x) AS crossed FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
g AS (SELECT vec_id, var_samp(x) AS v0, var_samp(d1) AS v1, var_samp(d2) AS v2, avg(c * c) AS m2, avg(c * c * c) AS m3, avg(c * c * c * c) AS m4,
      avg(crossed::INT) AS zero_cross, avg(abs(d1)) AS line_length FROM d GROUP BY vec_id)
SELECT vec_id, ln(v0 + 2.220446049250313e-16) AS logvar, sqrt(v1 / v0) AS mobility, sqrt(v2 / v1) / sqrt(v1 / v0) AS complexity,
  m3 / pow(m2, 1.5) AS skewness, m4 / (m2 * m2) AS kurtosis, zero_cross, line_length FROM g"""


family("time_domain_features", ft.time_domain, moment_sql(), ["logvar", "mobility", "complexity", "skewness", "kurtosis", "zero_cross", "line_length"])
family("log_variance", ft.log_variance, E + " SELECT vec_id, ln(var_samp(x) + 2.220446049250313e-16) AS logvar FROM e GROUP BY vec_id", ["logvar"])


def pattern_sql(m: int) -> str:
    bits = " + ".join(f"{2**k} * (lead(x, {a}) OVER w > lead(x, {b}) OVER w)::INT" for k, (a, b) in enumerate((a, b) for a in range(m) for b in range(a + 1, m)))
    fact = {3: 6, 4: 24}[m]
    return Z + f""",
c AS (SELECT vec_id, {bits} AS code, lead(x, {m - 1}) OVER w AS last FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
n AS (SELECT vec_id, code, count(*) AS n, sum(count(*)) OVER (PARTITION BY vec_id) AS total FROM c WHERE last IS NOT NULL GROUP BY vec_id, code)
SELECT vec_id, -sum(n / total * ln(n / total)) / ln({fact}) AS entropy FROM n GROUP BY vec_id"""


for _m in (3, 4):
    family(f"permutation_entropy_{_m}", lambda x, m=_m: ft.permutation_entropy(x, m), pattern_sql(_m), ["entropy"])

_t = lambda m: f"t{m} AS (SELECT vec_id, i, {', '.join(f'lead(x, {k}) OVER w AS x{k}' for k in range(m))}, count(*) OVER (PARTITION BY vec_id) AS n FROM z WINDOW w AS (PARTITION BY vec_id ORDER BY i))"
_match = lambda m: f"(SELECT a.vec_id, count(*) FILTER (WHERE greatest({', '.join(f'abs(a.x{k} - b.x{k})' for k in range(m))}, 0) <= r) AS c FROM t{m} a JOIN t{m} b ON a.vec_id = b.vec_id AND a.i < b.i JOIN s ON s.vec_id = a.vec_id WHERE b.i < b.n - {m} GROUP BY a.vec_id)"
family(
    "sample_entropy",
    lambda x: F.get(batches.over(batches.sample_entropy, 1, x, batches.pairs_room), F.lit(0)),
    Z + f", s AS (SELECT vec_id, 0.2::DOUBLE * stddev_samp(x) AS r FROM z GROUP BY vec_id), {_t(2)}, {_t(3)} SELECT vec_id, CASE WHEN p.c > 0 AND q.c > 0 THEN -ln(q.c / p.c::DOUBLE) END AS entropy FROM {_match(2)} p JOIN {_match(3)} q USING (vec_id)",
    ["entropy"],
)


def fuzzy_sql() -> str:
    def phi(m):
        mean = "(" + " + ".join(f"x{k}" for k in range(m)) + f") / {m}"
        near = ", ".join(f"abs((a.x{k} - a.c) - (b.x{k} - b.c))" for k in range(m))
        return f"""(SELECT a.vec_id, 2 * sum(exp(-pow(greatest({near}) / r, 2))) / ((any_value(a.n) - {m}) * (any_value(a.n) - {m + 1})) AS f
  FROM (SELECT *, {mean} AS c FROM t{m}) a JOIN (SELECT *, {mean} AS c FROM t{m}) b ON a.vec_id = b.vec_id AND a.i < b.i JOIN s ON s.vec_id = a.vec_id
  WHERE b.i < b.n - {m} GROUP BY a.vec_id)"""

    return Z + f", s AS (SELECT vec_id, 0.2::DOUBLE * stddev_samp(x) AS r FROM z GROUP BY vec_id), {_t(2)}, {_t(3)} SELECT vec_id, ln(p.f) - ln(q.f) AS entropy FROM {phi(2)} p JOIN {phi(3)} q USING (vec_id)"


family("fuzzy_entropy", lambda x: F.get(batches.over(batches.fuzzy_entropy, 1, x, batches.pairs_room), F.lit(0)), fuzzy_sql(), ["entropy"])
family(
    "katz_dimension",
    ft.katz,
    Z + """, d AS (SELECT vec_id, i, sqrt(1 + pow(lead(x) OVER w - x, 2)) AS step, sqrt(i * i + pow(x - first_value(x) OVER w, 2)) AS far FROM z WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
g AS (SELECT vec_id, count(*) - 1 AS n, sum(step) AS length, max(far) FILTER (WHERE i > 0) AS far FROM d GROUP BY vec_id)
SELECT vec_id, log10(n) / (log10(n) + log10(far / length)) AS dimension FROM g""",
    ["dimension"],
)
family(
    "petrosian_dimension",
    ft.petrosian,
    E + """, d AS (SELECT vec_id, i, lead(x) OVER w - x AS d1, lead(x, 2) OVER w - lead(x) OVER w AS d2 FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
g AS (SELECT vec_id, count(*) AS n, count(*) FILTER (WHERE sign(d1) <> sign(d2)) AS turns FROM d GROUP BY vec_id)
SELECT vec_id, log10(n) / (log10(n) + log10(n / (n + 0.4 * turns))) AS dimension FROM g""",
    ["dimension"],
)
family(
    "higuchi_dimension",
    lambda x: F.get(batches.over(batches.higuchi, 1, x), F.lit(0)),
    Z + """, n AS (SELECT vec_id, count(*) AS n FROM z GROUP BY vec_id),
w AS (SELECT z.vec_id, k, i % k AS m, n, abs(x - lag(x) OVER (PARTITION BY z.vec_id, k, i % k ORDER BY i)) AS step FROM z JOIN n USING (vec_id), range(1, 9) r(k)),
l AS (SELECT vec_id, k, m, sum(step) * (any_value(n) - 1) / (count(step) * k) / k AS len FROM w GROUP BY vec_id, k, m HAVING count(step) > 0),
lk AS (SELECT vec_id, ln(1 / k::DOUBLE) AS a, ln(avg(len)) AS b FROM l GROUP BY vec_id, k)
SELECT vec_id, regr_slope(b, a) AS dimension FROM lk GROUP BY vec_id""",
    ["dimension"],
)

DFA_SIZES, HURST_SIZES = ft.boxes(4, 16, 6), ft.boxes(8, 32, 6)
family(
    "dfa_exponent",
    lambda x: F.get(batches.over(lambda v: batches.dfa(v, DFA_SIZES), 1, x), F.lit(0)),
    Z + f""", y AS (SELECT vec_id, i, sum(x - m) OVER (PARTITION BY vec_id ORDER BY i) AS y, n FROM (SELECT *, avg(x) OVER w AS m, count(*) OVER w AS n FROM z WINDOW w AS (PARTITION BY vec_id))),
b AS (SELECT vec_id, s, i // s AS seg, (i % s + 1)::DOUBLE AS t, y FROM y, (SELECT unnest({DFA_SIZES}) AS s) WHERE i < (n // s) * s),
f AS (SELECT vec_id, s, seg, regr_slope(y, t) AS k, regr_intercept(y, t) AS c FROM b GROUP BY vec_id, s, seg),
r AS (SELECT vec_id, s, seg, avg(pow(y - c - k * t, 2)) AS res FROM b JOIN f USING (vec_id, s, seg) GROUP BY vec_id, s, seg),
g AS (SELECT vec_id, ln(s::DOUBLE) AS a, ln(sqrt(avg(res))) AS v FROM r GROUP BY vec_id, s)
SELECT vec_id, regr_slope(v, a) AS exponent FROM g GROUP BY vec_id""",
    ["exponent"],
)
family(
    "hurst_exponent",
    lambda x: F.get(batches.over(lambda v: batches.hurst(v, HURST_SIZES), 1, x), F.lit(0)),
    Z + f""", b AS (SELECT vec_id, s, i // s AS seg, i, x FROM (SELECT *, count(*) OVER (PARTITION BY vec_id) AS n FROM z), (SELECT unnest({HURST_SIZES}) AS s) WHERE i < (n // s) * s),
c AS (SELECT *, x - avg(x) OVER (PARTITION BY vec_id, s, seg) AS c FROM b),
w AS (SELECT *, sum(c) OVER (PARTITION BY vec_id, s, seg ORDER BY i) AS walk FROM c),
r AS (SELECT vec_id, s, seg, (max(walk) - min(walk)) / stddev_samp(x) AS rs FROM w GROUP BY vec_id, s, seg),
g AS (SELECT vec_id, ln(s::DOUBLE) AS a, ln(avg(rs)) AS v FROM r GROUP BY vec_id, s)
SELECT vec_id, regr_slope(v, a) AS exponent FROM g GROUP BY vec_id""",
    ["exponent"],
)

family(
    "phase_space_2d",
    stacked(batches.phase_space, batches.PSR2, room=batches.phase_space_room),
    E + """, p AS (SELECT vec_id, i, x, lead(x) OVER w AS y FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
q AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(x, 2) OVER w AS x3, lead(y, 2) OVER w AS y3 FROM p WHERE y IS NOT NULL WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
t AS (SELECT *, 0.5 * abs(x * (y2 - y3) + x2 * (y3 - y) + x3 * (y - y2)) AS area, sqrt(pow(x2 - x, 2) + pow(y2 - y, 2)) AS a, sqrt(pow(x3 - x2, 2) + pow(y3 - y2, 2)) AS b, sqrt(pow(x - x3, 2) + pow(y - y3, 2)) AS c FROM q),
k AS (SELECT *, (b * x + c * x2 + a * x3) / (a + b + c) AS cx, (b * y + c * y2 + a * y3) / (a + b + c) AS cy FROM t),
l AS (SELECT *, lead(cx) OVER w AS cx2, lead(cy) OVER w AS cy2 FROM k WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
g AS (SELECT vec_id, sum(pow(x2 - x, 2) + pow(y2 - y, 2)) AS tms, sum(area) AS tps, pi() * sum(pow(2 * area / (a + b + c), 2)) AS ica,
  sum(sqrt(pow(cx2 - cx, 2) + pow(cy2 - cy, 2))) AS ism,
  sum(acos(greatest(-1, least(1, (cx * cx2 + cy * cy2) / (sqrt(cx * cx + cy * cy) * sqrt(cx2 * cx2 + cy2 * cy2)))))) AS iam,
  sum(abs(x - y) / sqrt(2)) AS pdd, sum(abs(x + y) / sqrt(2)) AS sdd, avg(x * x) AS sxx, avg(y * y) AS syy, avg(x * y) AS sxy, sum(sqrt(x * x + y * y)) AS rda,
  sum(acos(greatest(-1, least(1, (x * x2 + y * y2) / (sqrt(x * x + y * y) * sqrt(x2 * x2 + y2 * y2)))))) AS sam,
  0.5 * sum(abs(x * y2 - x2 * y)) AS ots, sum(abs((x - y) / sqrt(2) * (x + y) / sqrt(2))) AS oam,
  pi() * stddev_samp((x - y) / sqrt(2)) * stddev_samp((x + y) / sqrt(2)) AS bdi FROM l GROUP BY vec_id),
h AS (SELECT *, sqrt(greatest(pow(sxx + syy, 2) - 4 * (sxx * syy - sxy * sxy), 0)) AS delta FROM g)
SELECT vec_id, pi() * tms AS cem, tps, ica, ism, iam, tms, pdd, sdd, 2 / (1 + sqrt(2)) * 3 * (sxx + syy + delta) AS ocm, rda, sam, ots, oam, bdi,
  pi() * sqrt(3 * greatest(sxx + syy + delta, 0)) * sqrt(3 * greatest(sxx + syy - delta, 0)) AS ecm FROM h""",
    batches.PSR2,
)
family(
    "phase_space_3d",
    stacked(batches.phase_space_3d, batches.PSR3, room=batches.phase_space_room),
    E + """, q AS (SELECT vec_id, i, x AS a, lead(x) OVER w AS b, lead(x, 2) OVER w AS c FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
p AS (SELECT *, count(*) OVER (PARTITION BY vec_id) AS m FROM q WHERE c IS NOT NULL),
r AS (SELECT *, min(a) OVER v AS la, max(a) OVER v AS ha, min(b) OVER v AS lb, max(b) OVER v AS hb, min(c) OVER v AS lc, max(c) OVER v AS hc FROM p WINDOW v AS (PARTITION BY vec_id)),
cell AS (SELECT vec_id, m, least(floor((a - la) / (ha - la) * 8), 7) * 64 + least(floor((b - lb) / (hb - lb) * 8), 7) * 8 + least(floor((c - lc) / (hc - lc) * 8), 7) AS cell FROM r),
sci AS (SELECT vec_id, exp(-sum(n / m::DOUBLE * log2(n / m::DOUBLE))) AS sci FROM (SELECT vec_id, cell, any_value(m) AS m, count(*) AS n FROM cell GROUP BY vec_id, cell) GROUP BY vec_id),
far AS (SELECT s.vec_id, k, avg(sqrt(pow(t.a - s.a, 2) + pow(t.b - s.b, 2) + pow(t.c - s.c, 2))) AS far FROM p s, range(1, 11) r(k), p t WHERE t.vec_id = s.vec_id AND t.i = s.i + k AND k <= s.m - 2 GROUP BY s.vec_id, k),
dem AS (SELECT vec_id, avg(ln(far + 2.220446049250313e-16)) AS dem FROM far GROUP BY vec_id),
d AS (SELECT vec_id, i, lead(a) OVER w - a AS a1, lead(b) OVER w - b AS b1, lead(c) OVER w - c AS c1,
  lead(a, 2) OVER w - 2 * lead(a) OVER w + a AS a2, lead(b, 2) OVER w - 2 * lead(b) OVER w + b AS b2, lead(c, 2) OVER w - 2 * lead(c) OVER w + c AS c2,
  lead(a, 3) OVER w - 3 * lead(a, 2) OVER w + 3 * lead(a) OVER w - a AS a3, lead(b, 3) OVER w - 3 * lead(b, 2) OVER w + 3 * lead(b) OVER w - b AS b3,
  lead(c, 3) OVER w - 3 * lead(c, 2) OVER w + 3 * lead(c) OVER w - c AS c3 FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
x AS (SELECT vec_id, sqrt(a1 * a1 + b1 * b1 + c1 * c1) AS n1, sqrt(pow(b1 * c2 - c1 * b2, 2) + pow(c1 * a2 - a1 * c2, 2) + pow(a1 * b2 - b1 * a2, 2)) AS ncr,
  a1 * (b2 * c3 - c2 * b3) + b1 * (c2 * a3 - a2 * c3) + c1 * (a2 * b3 - b2 * a3) AS twist FROM d WHERE a3 IS NOT NULL),
tor AS (SELECT vec_id, avg(ncr / pow(n1, 3)) FILTER (WHERE n1 > 1e-9) AS tbi, coalesce(avg(twist / (ncr * ncr)) FILTER (WHERE ncr > 1e-9), 0) AS tti FROM x GROUP BY vec_id)
SELECT vec_id, sci, dem, tbi, tti FROM sci JOIN dem USING (vec_id) JOIN tor USING (vec_id)""",
    ["sci", "dem", "tbi", "tti"],
)

# Welch's density of an epoch of 64 samples at 128 Hz: one Hamming segment, 256 frequencies
WINDOW = "w AS (SELECT i, 0.54 - 0.46 * cos(2 * pi() * i / 63) AS w FROM range(0, 64) t(i))"
PSD = """f AS (SELECT {key}, k, k * 0.5::DOUBLE AS hz, (CASE WHEN k IN (0, 128) THEN 1 ELSE 2 END) * (pow(sum(x * w * cos(2 * pi() * k * i / 256)), 2) + pow(sum(x * w * sin(2 * pi() * k * i / 256)), 2)) / (128 * (SELECT sum(w * w) FROM w)) AS p
  FROM {src} JOIN w USING (i), range(0, 129) r(k) GROUP BY {key}, k)"""
_area = lambda low, high: f"(sum(p) FILTER (WHERE hz >= {low} AND hz < {high}) - (arg_min(p, hz) FILTER (WHERE hz >= {low} AND hz < {high}) + arg_max(p, hz) FILTER (WHERE hz >= {low} AND hz < {high})) / 2) * 0.5"
_named = {k: _area(low, high) for k, low, high in [("tot", 0.5, 45.01), ("lv_1_30", 1, 30), ("hf_30_45", 30, 45.01), *batches.BANDS]}
_log = lambda c, name: f"ln({c} + 2.220446049250313e-16) AS {name}"
BAND_SQL = E + f""", {WINDOW}, {PSD.format(key="vec_id", src="e")}, g AS (SELECT vec_id, {', '.join(f'{v} AS {k}' for k, v in _named.items())} FROM f GROUP BY vec_id)
SELECT vec_id, {', '.join(f'{k} / tot AS {k}' for k, _, _ in batches.BANDS)}, (theta / tot) / greatest(beta / tot, 2.220446049250313e-16) AS theta_beta, {_log('tot', 'lv_full')}, {_log('lv_1_30', 'lv_1_30')}, {_log('hf_30_45', 'hf_30_45')}, {', '.join(_log(k, f'log_{k}') for k, _, _ in batches.BANDS)} FROM g"""
family("band_power", stacked(lambda x: batches.band_power(x, FS), batches.BAND_COLUMNS), BAND_SQL, batches.BAND_COLUMNS)
family(
    "spectral_entropy",
    lambda x: F.get(batches.over(lambda v: batches.spectral_entropy(v, FS), 1, x), F.lit(0)),
    Z + f""", {WINDOW}, {PSD.format(key="vec_id", src="z")}, g AS (SELECT vec_id, p, sum(p) OVER (PARTITION BY vec_id) AS w, count(*) OVER (PARTITION BY vec_id) AS c FROM f WHERE hz >= 0.5 AND hz <= 45)
SELECT vec_id, -sum(p / w * ln(p / w)) / ln(any_value(c)) AS entropy FROM g WHERE p > 0 GROUP BY vec_id""",
    ["entropy"],
)
