"""SQL of the weighted logistic fits: Newton steps as a chain of materialised tables.

The loss is the weighted log loss plus half the squared length of the weights, features being standardised
logarithms. Each step solves its equations by an LDL decomposition written out as columns.
"""

from __future__ import annotations

from salmoura.checks import proxies as P
from salmoura.checks.registry import R

STEPS = 12
SEED = 42
MODELS_SQL = {
    "Salinidade + Bário + Estrôncio": ["sal", "ba", "sr"],
    "Salinidade + Relação Ba/Sr": ["sal", "ratio"],
}


def folds_sql(wanted: int) -> str:
    """``folded``: the model table with its fold, and ``ks``: the fold numbers."""
    return f"""folded AS MATERIALIZED (
  SELECT *, (row_number() OVER (PARTITION BY tem_norm ORDER BY md5(plat || '{SEED}')) - 1)
    % least({wanted}, (SELECT min(n) FROM (SELECT count(*) AS n FROM model GROUP BY tem_norm))) + 1 AS fold
  FROM model), ks AS (SELECT DISTINCT fold AS k FROM folded)"""


def all_rows_sql() -> str:
    """One fit on all rows, under the fold number 0 that no row has."""
    return "folded AS MATERIALIZED (SELECT *, 1 AS fold FROM model), ks AS (SELECT 0 AS k)"


def _step(name: str, i: int, size: int) -> str:
    """Weights after one more Newton step, for every fit at once."""
    before = f"{name}_b{i}"
    margin = " + ".join(["b0", *[f"b{j} * z{j}" for j in range(1, size)]])
    factor = ["1", *[f"z{j}" for j in range(1, size)]]
    sums = [
        f"sum(w * (p - y) * {factor[j]}) + {f'any_value(b{j})' if j else '0'} AS g{j}" for j in range(size)
    ] + [
        f"sum(w * p * (1 - p) * {factor[a]} * {factor[b]}) + {1 if a == b and a else 0} AS h{a}{b}"
        for a in range(size) for b in range(a, size)
    ] + [f"any_value(b{j}) AS b{j}" for j in range(size)]
    solve = []
    for a in range(size):
        minus = "".join(f" - l{a}{k} * l{a}{k} * d{k}" for k in range(a))
        solve.append(f"h{a}{a}{minus} AS d{a}")
        for b in range(a + 1, size):
            minus = "".join(f" - l{b}{k} * l{a}{k} * d{k}" for k in range(a))
            solve.append(f"(h{a}{b}{minus}) / d{a} AS l{b}{a}")
    for a in range(size):
        solve.append(f"g{a}{''.join(f' - l{a}{k} * u{k}' for k in range(a))} AS u{a}")
    for a in reversed(range(size)):
        solve.append(f"u{a} / d{a}{''.join(f' - l{k}{a} * v{k}' for k in range(a + 1, size))} AS v{a}")
    new = ", ".join(f"b{j} - v{j} AS b{j}" for j in range(size))
    return f"""{name}_b{i + 1} AS MATERIALIZED (
  SELECT k, {new} FROM (SELECT *, {', '.join(solve)} FROM (
    SELECT k, {', '.join(sums)} FROM (
      SELECT *, 1 / (1 + exp(-({margin}))) AS p FROM {name}_z JOIN {before} USING (k)) GROUP BY k)))"""


def fit_sql(name: str, features: list[str], steps: int = STEPS) -> str:
    """``<name>_fit``: weights b0, b1, ... and moments m1, s1, ... of the fit without each fold of ``ks``."""
    at = range(1, len(features) + 1)
    logs = ", ".join(f"log10({f}) AS x{j}" for j, f in zip(at, features))
    moments = ", ".join(
        f"avg(x{j}) AS m{j}, CASE WHEN stddev_pop(x{j}) = 0 THEN 1 ELSE stddev_pop(x{j}) END AS s{j}" for j in at
    )
    scaled = ", ".join(f"(x{j} - m{j}) / s{j} AS z{j}" for j in at)
    zeros = ", ".join(f"0.0::DOUBLE AS b{j}" for j in range(len(features) + 1))
    parts = [
        f"{name}_x AS MATERIALIZED (SELECT k, tem_norm AS y, {logs} FROM folded, ks WHERE fold <> k)",
        f"{name}_m AS MATERIALIZED (SELECT k, count(*) AS n, sum(y) AS n1, {moments} FROM {name}_x GROUP BY k)",
        f"""{name}_z AS MATERIALIZED (SELECT k, y, {scaled},
    CASE WHEN y = 1 THEN n / (2.0 * n1) ELSE n / (2.0 * (n - n1)) END AS w FROM {name}_x JOIN {name}_m USING (k))""",
        f"{name}_b0 AS MATERIALIZED (SELECT k, {zeros} FROM ks)",
        *[_step(name, i, len(features) + 1) for i in range(steps)],
        f"{name}_fit AS (SELECT * FROM {name}_b{steps} JOIN {name}_m USING (k))",
    ]
    return ", ".join(parts)


def probability(features: list[str]) -> str:
    """Probability of a row by the numbers of a fit."""
    margin = " + ".join(["b0", *[f"b{j} * ((log10({f}) - m{j}) / s{j})" for j, f in enumerate(features, 1)]])
    return f"1 / (1 + exp(-({margin})))"


def final_sql(features: list[str]) -> str:
    return f"{all_rows_sql()}, {fit_sql('f', features)}"


def held_out_sql(name: str, features: list[str]) -> str:
    """``<name>_held``: each row with its probability by the fit without its fold."""
    return f"""{fit_sql(name, features)}, {name}_held AS MATERIALIZED (
  SELECT plat, fold, tem_norm AS y, {probability(features)} AS p FROM folded JOIN {name}_fit ON k = fold)"""


def _measures(source: str, by: str) -> str:
    """Counts and measures at the pooled threshold; ``by`` is a prefix of a grouping column."""
    group = f" GROUP BY {by.rstrip(', ')}" if by else ""
    return f"""(SELECT *, (vp + vn)::DOUBLE / (vp + fp + vn + fn) AS acuracia,
    CASE WHEN vp + fp > 0 THEN vp::DOUBLE / (vp + fp) ELSE 0 END AS precisao,
    CASE WHEN vp + fn > 0 THEN vp::DOUBLE / (vp + fn) ELSE 0 END AS sensibilidade,
    CASE WHEN vn + fp > 0 THEN vn::DOUBLE / (vn + fp) END AS especificidade,
    CASE WHEN 2 * vp + fp + fn > 0 THEN 2 * vp::DOUBLE / (2 * vp + fp + fn) ELSE 0 END AS f1
  FROM (SELECT {by}count(*) FILTER (WHERE y = 1 AND p >= limiar) AS vp,
      count(*) FILTER (WHERE y = 0 AND p >= limiar) AS fp, count(*) FILTER (WHERE y = 0 AND p < limiar) AS vn,
      count(*) FILTER (WHERE y = 1 AND p < limiar) AS fn, any_value(limiar) AS limiar, count(*) AS n
    FROM {source}_held, {source}_cut{group}))"""


def _areas(source: str, by: str) -> str:
    part = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    tied = f"PARTITION BY {by}p"
    group = f" GROUP BY {by.rstrip(', ')}" if by else ""
    return f"""(SELECT {by}(sum(rank_p) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc
  FROM (SELECT *, rank() OVER ({part} ORDER BY p) + (count(*) OVER ({tied}) - 1) / 2.0 AS rank_p FROM {source}_held){group})"""


def evaluation_sql(name: str, features: list[str]) -> str:
    """``<name>_cut`` (Youden threshold), ``<name>_folds`` and ``<name>_all`` (measures by fold and of all rows)."""
    return f"""{held_out_sql(name, features)}, {name}_cut AS MATERIALIZED (
  SELECT p AS limiar FROM (
    SELECT p, sum(sum(y)) OVER above / (sum(sum(y)) OVER whole)::DOUBLE
      - sum(sum(1 - y)) OVER above / (sum(sum(1 - y)) OVER whole)::DOUBLE AS j
    FROM {name}_held GROUP BY p WINDOW above AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING), whole AS ())
  ORDER BY j DESC, p DESC LIMIT 1),
{name}_folds AS MATERIALIZED (SELECT * FROM {_measures(name, 'fold, ')} JOIN {_areas(name, 'fold, ')} USING (fold)),
{name}_all AS MATERIALIZED (SELECT * FROM {_measures(name, '')}, {_areas(name, '')})"""


def with_final(features: list[str], base: str = P.WITH_WINDOW) -> str:
    return f"{base[:-1]}, {final_sql(features)}\n"


def with_evaluation(models: dict[str, list[str]], wanted: int) -> str:
    """All ``models`` evaluated on the same folds, under the names e0, e1, ..."""
    parts = [evaluation_sql(f"e{i}", f) for i, f in enumerate(models.values())]
    return f"{P.WITH_WINDOW[:-1]}, {folds_sql(wanted)}, {', '.join(parts)}\n"


MEASURES = {
    "AUC": "auc", "ACURACIA": "acuracia", "PRECISAO": "precisao", "SENSIBILIDADE": "sensibilidade",
    "ESPECIFICIDADE": "especificidade", "F1_SCORE": "f1",
}
COUNTS = ", ".join(f"{c.lower()}::BIGINT AS {c}" for c in ("VP", "FP", "VN", "FN"))
ROUNDED = ", ".join(f"{R(v, 4)} AS {k}" for k, v in MEASURES.items())


def spread(i: int, text: str = "{:.3f} ± {:.3f}", factor: int = 1) -> str:
    """Mean and deviation of each measure over the folds, as text."""
    return ", ".join(
        f"(SELECT format('{text}', {factor} * avg({v}) + 1e-9, {factor} * stddev_samp({v}) + 1e-9) FROM e{i}_folds) AS {k}_MEDIA_DP"
        for k, v in MEASURES.items()
    )
