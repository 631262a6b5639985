"""DuckDB text of the md5-ordered stratified split, folds and balancing, used
by the oracle side (the Spark side is ``corvid.operators.prep``)."""

from __future__ import annotations


def _h(seed, col="id"):
    return f"md5('{seed}|' || CAST({col} AS VARCHAR))"


def split_sql(src: str, out: str, test_size: float, seed, test_name="test", train_name="train",
              label="label") -> str:
    """CTE ``out`` = src rows + ``split`` column."""
    return f"""
, {out}_k AS (SELECT *, {_h(seed)} AS _h FROM {src})
, {out}_c AS (SELECT {label} AS _lab, count(*) AS n_c FROM {out}_k GROUP BY {label})
, {out}_t AS (SELECT CAST(sum(n_c) AS BIGINT) AS n,
                     CAST(ceil(CAST({test_size!r} AS DOUBLE) * sum(n_c)) AS BIGINT) AS n_test FROM {out}_c)
, {out}_q0 AS (SELECT c._lab, (t.n_test * c.n_c) // t.n AS base, (t.n_test * c.n_c) % t.n AS rem, t.n_test
               FROM {out}_c c, {out}_t t)
, {out}_q AS (SELECT _lab, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, _lab)
                                        <= n_test - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM {out}_q0)
, {out}_r AS (SELECT k.*, row_number() OVER (PARTITION BY {label} ORDER BY _h, id) AS _rnk FROM {out}_k k)
, {out} AS (SELECT r.* EXCLUDE (_h, _rnk),
                   CASE WHEN r._rnk <= q.quota THEN '{test_name}' ELSE '{train_name}' END AS split
            FROM {out}_r r JOIN {out}_q q ON r.{label} = q._lab)
"""


def fold_sql(src: str, out: str, k: int, seed, label="label") -> str:
    return f"""
, {out} AS (SELECT * EXCLUDE (_h, _rnk), CAST((_rnk - 1) % {k} AS INTEGER) AS fold FROM (
    SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY _h, id) AS _rnk
    FROM (SELECT *, {_h(seed)} AS _h FROM {src}) a) b)
"""


def ranked_sql(src: str, out: str, seed, label="label") -> str:
    return f"""
, {out} AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY _h, id) AS _rnk,
                  count(*) OVER (PARTITION BY {label}) AS _n
            FROM (SELECT *, {_h(seed)} AS _h FROM {src}) a)
"""


def gaussian_nb_sql(src: str, out: str, features: list[str], absent: tuple[str, ...] = ()) -> str:
    """CTE ``out`` = (id, label, prediction, p1) of the held-out rows of ``src``
    (a split CTE) by Gaussian naive Bayes in closed form: nulls take the train
    medians, variances grow by 1e-9 of the largest one; ``absent`` features
    are scored as 0.0."""
    def ll(k):
        terms = " + ".join(f"ln(2 * pi() * v{k}_{c}) + (t.{c} - u{k}_{c}) * (t.{c} - u{k}_{c}) / v{k}_{c}" for c in features)
        return f"(n{k} - 0.5 * ({terms}))"

    def of_class(k):
        return ", ".join([f"ln(count(*) FILTER (label = {k})) - ln(count(*)) AS n{k}"]
                         + [f"avg({c}) FILTER (label = {k}) AS u{k}_{c}, var_pop({c}) FILTER (label = {k}) "
                            f"+ any_value(e) AS v{k}_{c}" for c in features])
    held = ", ".join(f"0.0::DOUBLE AS {c}" if c in absent else f"coalesce({c}, m_{c}) AS {c}" for c in features)
    return f"""
, {out}_m AS MATERIALIZED (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in features)}
    FROM {src} WHERE split = 'train')
, {out}_f AS MATERIALIZED (SELECT label, {", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in features)}
    FROM {src}, {out}_m WHERE split = 'train')
, {out}_e AS MATERIALIZED (SELECT 1e-9 * greatest({", ".join(f"var_pop({c})" for c in features)}) AS e FROM {out}_f)
, {out}_p AS MATERIALIZED (SELECT {of_class(0)}, {of_class(1)} FROM {out}_f, {out}_e)
, {out}_t AS (SELECT id, label, {held} FROM {src}, {out}_m WHERE split = 'test')
, {out}_d AS (SELECT id, label, {ll(0)} - {ll(1)} AS gap FROM {out}_t t, {out}_p)
, {out} AS (SELECT id, label, CAST(gap < 0 AS INTEGER) AS prediction,
    CASE WHEN gap > 700 THEN 0.0 ELSE 1.0 / (1.0 + exp(gap)) END AS p1 FROM {out}_d)
"""
