"""Small SQL text builders for the DuckDB oracle (feature lists -> SQL).

They only produce oracle text for the correctness check; nothing here plans
or executes anything.
"""

from __future__ import annotations

from collections.abc import Sequence

MAXD = "1.7976931348623157e308"


def qi(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def imputed(c: str) -> str:
    x = f"CAST({qi(c)} AS DOUBLE)"
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 0.0 WHEN {x} = 'inf'::DOUBLE THEN {MAXD} "
            f"WHEN {x} = '-inf'::DOUBLE THEN -{MAXD} ELSE {x} END")


def m1(src: str, id_col: str, label: str, features: Sequence[str], name: str) -> str:
    """CTE(s) ``name`` = impute + binarise + population standardise of ``src``."""
    imp = ", ".join(f"{imputed(f)} AS {qi(f)}" for f in features)
    sc = ", ".join(
        f"({qi(f)} - avg({qi(f)}) OVER ()) / (CASE WHEN coalesce(stddev_pop({qi(f)}) OVER (), 0) = 0 "
        f"THEN 1.0 ELSE stddev_pop({qi(f)}) OVER () END) AS {qi(f)}"
        for f in features)
    return (f"{name}_imp AS (SELECT {qi(id_col)} AS {qi(id_col)}, "
            f"CASE WHEN {qi(label)} > 0 THEN 1 ELSE 0 END AS label, {imp} FROM {src}),\n"
            f"{name} AS (SELECT {qi(id_col)}, label, {sc} FROM {name}_imp)")


def long(src: str, id_col: str, features: Sequence[str], extra: Sequence[str] = ()) -> str:
    ex = "".join(f"{qi(e)}, " for e in extra)
    parts = [f"SELECT {qi(id_col)}, {ex}{i} AS feature_idx, '{f}' AS feature, CAST({qi(f)} AS DOUBLE) AS value FROM {src}"
             for i, f in enumerate(features)]
    return "\nUNION ALL ".join(parts)


def relevance(scaled: str, cluster_sql: str, id_col: str, features: Sequence[str], name: str) -> str:
    """CTEs: ``{name}_centers`` and ``{name}`` = (rank, feature, relevance, feature_idx)."""
    lf = long(f"(SELECT *, {cluster_sql} AS cluster FROM {scaled})", id_col, features, extra=["cluster"])
    feats = " UNION ALL ".join(f"SELECT {i} AS feature_idx, '{f}' AS feature" for i, f in enumerate(features))
    return (
        f"{name}_long AS ({lf}),\n"
        f"{name}_centers AS (SELECT cluster, feature_idx, feature, avg(value) AS center FROM {name}_long "
        f"WHERE cluster >= 0 GROUP BY cluster, feature_idx, feature),\n"
        f"{name}_k AS (SELECT count(DISTINCT cluster) AS k FROM {name}_centers),\n"
        f"{name}_feats AS ({feats}),\n"
        f"{name}_rel AS (SELECT f.feature_idx, f.feature, CASE WHEN (SELECT k FROM {name}_k) >= 2 "
        f"THEN coalesce(s.std, 0.0) ELSE 0.0 END AS relevance FROM {name}_feats f LEFT JOIN "
        f"(SELECT feature_idx, stddev_pop(center) AS std FROM {name}_centers GROUP BY feature_idx) s "
        f"USING (feature_idx)),\n"
        f"{name} AS (SELECT row_number() OVER (ORDER BY relevance DESC, feature_idx ASC) AS rank, "
        f"feature, relevance, feature_idx FROM {name}_rel)"
    )


def values(rows: Sequence[tuple], cols: Sequence[str]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"
