"""DuckDB oracle SQL, one statement per registered query with the same column names."""

from __future__ import annotations

from faultline.plans.fixtures_sql import with_

ORACLE: dict[str, str] = {}

_UC = with_("unit", "unit_clusters")

ORACLE["cluster_stats"] = _UC + """
, pc AS (SELECT cluster, count(*) AS total, CAST(sum(y) AS BIGINT) AS defective FROM unit_clusters GROUP BY cluster)
SELECT cluster,
       CASE WHEN cluster = -1 THEN 'noise' ELSE 'cluster_' || CAST(cluster AS VARCHAR) END AS cluster_name,
       total, defective,
       round(defective / total * 100, 2) AS defect_rate,
       CASE WHEN defective / total * 100 > (SELECT avg(CAST(y AS DOUBLE)) FROM unit_clusters) * 100
            THEN 'HIGH' ELSE 'LOW' END AS risk
FROM pc"""

ORACLE["risk_metrics"] = _UC + """
, pc AS (SELECT cluster, count(*) AS total, CAST(sum(y) AS BIGINT) AS defective FROM unit_clusters
         WHERE cluster >= 0 GROUP BY cluster),
  fl AS (SELECT *, defective / total > (SELECT avg(CAST(y AS DOUBLE)) FROM unit_clusters) AS hi FROM pc),
  a AS (SELECT sum(CASE WHEN hi THEN 1 ELSE 0 END) AS hrc, count(*) AS tc,
               coalesce(sum(CASE WHEN hi THEN total ELSE 0 END), 0) AS pp,
               coalesce(sum(CASE WHEN hi THEN defective ELSE 0 END), 0) AS tp,
               coalesce(sum(defective), 0) AS ap, coalesce(sum(total), 0) AS nv FROM fl),
  m AS (SELECT *, CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS p,
                  CASE WHEN ap > 0 THEN tp / ap ELSE 0.0 END AS r FROM a)
SELECT round(p, 4) AS precision, round(r, 4) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1_score,
       round(CASE WHEN nv > 0 THEN pp / nv ELSE 0.0 END, 4) AS inspection_rate,
       CAST(coalesce(hrc, 0) AS INTEGER) AS high_risk_clusters, CAST(tc AS INTEGER) AS total_clusters,
       CAST(pp AS INTEGER) AS files_in_high_risk, CAST(tp AS INTEGER) AS defects_captured,
       CAST(ap AS INTEGER) AS total_defects
FROM m"""

ORACLE["external_metrics"] = _UC + """
, nn AS (SELECT cluster AS k, y AS c FROM unit_clusters WHERE cluster >= 0),
  cont AS (SELECT c, k, CAST(count(*) AS DOUBLE) AS nij FROM nn GROUP BY c, k),
  tot AS (SELECT sum(nij) AS n FROM cont),
  a AS (SELECT c, sum(nij) AS ai FROM cont GROUP BY c),
  b AS (SELECT k, sum(nij) AS bj FROM cont GROUP BY k),
  hc AS (SELECT -sum(ai / n * (ln(ai) - ln(n))) AS v FROM a, tot),
  hk AS (SELECT -sum(bj / n * (ln(bj) - ln(n))) AS v FROM b, tot),
  mi AS (SELECT greatest(coalesce(sum(nij / n * (ln(nij) + ln(n) - ln(ai) - ln(bj))), 0.0), 0.0) AS mi
         FROM cont JOIN a USING (c) JOIN b USING (k), tot),
  hcv AS (SELECT CASE WHEN hc.v <> 0 THEN mi / hc.v ELSE 1.0 END AS h,
                 CASE WHEN hk.v <> 0 THEN mi / hk.v ELSE 1.0 END AS cc, tot.n AS n
          FROM mi, hc, hk, tot)
SELECT round(CASE WHEN n >= 2 THEN h END, 6) AS homogeneity,
       round(CASE WHEN n >= 2 THEN cc END, 6) AS completeness,
       round(CASE WHEN n >= 2 THEN (CASE WHEN h + cc = 0 THEN 0.0 ELSE 2 * h * cc / (h + cc) END) END, 6) AS v_measure
FROM hcv"""

ORACLE["high_rate_groups"] = _UC + """
, pc AS (SELECT cluster, count(*) AS total, CAST(sum(y) AS BIGINT) AS defective FROM unit_clusters GROUP BY cluster)
SELECT CASE WHEN cluster = -1 THEN 'noise' ELSE 'cluster_' || CAST(cluster AS VARCHAR) END AS cluster_name,
       total, defective, round(defective / total * 100, 2) AS defect_rate
FROM pc WHERE round(defective / total * 100, 2) > 10"""


# --- prepare ---------------------------------------------------------------------

from faultline.functions.columns import COVERAGE_FEATURES, EFFORT_FEATURES_26  # noqa: E402
from faultline.plans import sqlgen as G  # noqa: E402
from faultline.plans.fixtures_sql import CTES  # noqa: E402
from faultline.sources import testdata as td  # noqa: E402

_EFF = [f for f in EFFORT_FEATURES_26 if f in td.EFFORT_FIXTURE]
_COMB_FEATS = td.SM_FEATURES + COVERAGE_FEATURES + _EFF
_META = ", ".join(G.qi(c) for c in td.SM_METADATA)

CTES["combined"] = f"""
combined AS (
  SELECT {", ".join("s." + G.qi(c) for c in td.SM_METADATA + td.SM_FEATURES)},
         {", ".join("c." + G.qi(c) for c in COVERAGE_FEATURES)},
         {", ".join("e." + G.qi(c) for c in _EFF)}
  FROM sm s JOIN coverage c ON s.file = c.filename AND s.version = c.version
  JOIN effort e ON s.version_id = e.version_id)"""

_COMB = with_("sm", "coverage", "effort", "combined")
_YEAR = f"CAST(substr(version_id, 1, 4) AS INTEGER) - {td.FIRST_VERSION}"

ORACLE["load_clean"] = with_("sm") + "SELECT * FROM sm WHERE version IS NOT NULL AND Bug IS NOT NULL"

ORACLE["family_project"] = _COMB + f"SELECT {_META}, {', '.join(COVERAGE_FEATURES)} FROM combined"

ORACLE["effort_cov_only"] = _COMB + f"SELECT {_META}, {', '.join(G.qi(c) for c in _EFF)}, " \
    f"{', '.join(COVERAGE_FEATURES)} FROM combined"

ORACLE["label_rate"] = with_("unit") + """
SELECT count(*) AS n_samples, CAST(sum(CASE WHEN Bug > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_defective,
       round(avg(CASE WHEN Bug > 0 THEN 1 ELSE 0 END), 6) AS defect_rate FROM unit"""

ORACLE["impute_nonfinite"] = with_("sm") + f"""
, x AS (SELECT version_id, SM_tax_avg AS tax,
               CASE WHEN SM_lines = 1 THEN 'inf'::DOUBLE ELSE SM_price_avg END AS price,
               CASE WHEN SM_lines = 2 THEN '-inf'::DOUBLE ELSE SM_disc_avg END AS disc FROM sm)
SELECT version_id, {G.imputed('tax')} AS tax, {G.imputed('price')} AS price, {G.imputed('disc')} AS disc FROM x"""

ORACLE["version_exclude"] = with_("sm") + \
    f"SELECT version_id, version, Bug FROM sm WHERE version IS DISTINCT FROM '{td.FIRST_VERSION}'"

_MERGE = with_("sm", "coverage") + f"""
, merged AS (
  SELECT s.*, {", ".join("c." + c for c in COVERAGE_FEATURES)}
  FROM (SELECT * FROM sm WHERE version IS NOT NULL AND version IS DISTINCT FROM '{td.FIRST_VERSION}') s
  LEFT JOIN coverage c ON s.version = c.version AND s.file = c.filename)
"""
ORACLE["merge_left"] = _MERGE + "SELECT * FROM merged"
ORACLE["merge_unmatched"] = _MERGE + f"""
SELECT CAST(sum(CASE WHEN {COVERAGE_FEATURES[0]} IS NULL OR isnan({COVERAGE_FEATURES[0]}) THEN 1 ELSE 0 END) AS BIGINT)
       AS unmatched, count(*) AS rows FROM merged"""

ORACLE["combine_inner"] = _COMB + "SELECT * FROM combined"

ORACLE["union_versions"] = with_("coverage") + """
SELECT version, filename, COV_INSTRUCTION, COV_BRANCH, COV_LINE, COV_COMPLEXITY,
       CASE WHEN version < '1998' THEN NULL ELSE COV_METHOD END AS COV_METHOD FROM coverage"""

_SM_RANK = with_("sm") + ", " + G.m1("sm", "version_id", "Bug", td.SM_FEATURES, "sm_scaled") + ",\n" + \
    G.relevance("sm_scaled", _YEAR, "version_id", td.SM_FEATURES, "sm_rank") + "\n"

ORACLE["top_family_features"] = _SM_RANK + """
SELECT * FROM (
  SELECT row_number() OVER (ORDER BY relevance DESC, rank ASC) AS family_rank, feature,
         round(relevance, 6) AS relevance, rank
  FROM sm_rank WHERE feature LIKE 'SM\\_%' ESCAPE '\\') t WHERE family_rank <= 3"""

ORACLE["top30_dataset"] = with_("sm") + f"SELECT {_META}, {', '.join(td.SM_FEATURES)} FROM sm " \
    f"WHERE version IS DISTINCT FROM '{td.FIRST_VERSION}'"

ORACLE["family_counts"] = _COMB + ", lf AS (" + G.long("combined", "version_id", _COMB_FEATS) + """)
SELECT CASE WHEN feature LIKE 'SM\\_%' ESCAPE '\\' THEN 'SM' WHEN feature LIKE 'COV\\_%' ESCAPE '\\' THEN 'COV'
            ELSE 'EFFORT' END AS family,
       count(DISTINCT feature) AS n_features, count(value) AS n_values
FROM lf GROUP BY 1"""

# --- scaling -----------------------------------------------------------------

_UNIT_M1 = with_("unit", "unit_clusters") + ", " + G.m1("unit", "row_id", "Bug", td.UNIT_FEATURES, "us") + "\n"
_ROUNDED = ", ".join(f"round({G.qi(f)}, 6) AS {G.qi(f)}" for f in td.UNIT_FEATURES)
ORACLE["standardize"] = _UNIT_M1 + f"SELECT row_id, label, {_ROUNDED} FROM us"
ORACLE["zscore_outliers"] = _UNIT_M1 + f"SELECT row_id, label, {_ROUNDED} FROM us WHERE " \
    f"greatest({', '.join('abs(' + G.qi(f) + ')' for f in td.UNIT_FEATURES)}) <= 3.0"

# --- centers, relevance, rankings ------------------------------------------

_UNIT_REL = _UNIT_M1 + ", usc AS (SELECT us.*, uc.cluster AS ucl FROM us JOIN unit_clusters uc USING (row_id)),\n" + \
    G.relevance("usc", "ucl", "row_id", td.UNIT_FEATURES, "urank") + "\n"
ORACLE["cluster_centers"] = _UNIT_REL + "SELECT cluster, feature, round(center, 6) AS center FROM urank_centers"
ORACLE["feature_relevance"] = _UNIT_REL + "SELECT rank, feature, round(relevance, 6) AS relevance FROM urank"

_COMB_M1 = _COMB + ", " + G.m1("combined", "version_id", "Bug", _COMB_FEATS, "cs") + ",\n"
_CRANK = _COMB_M1 + G.relevance("cs", _YEAR, "version_id", _COMB_FEATS, "crank") + ",\n"
_GROUPS_ROWS = [("26_common", f) for f in EFFORT_FEATURES_26] + \
    [("effort_all", f) for f in td.EFFORT_FIXTURE]
_GR = _CRANK + f"""groups AS (SELECT DISTINCT * FROM {G.values(_GROUPS_ROWS, ['"group"', 'feature'])}),
granks AS (SELECT g."group", g.feature, r.rank FROM groups g
           LEFT JOIN (SELECT feature, max(rank) AS rank FROM crank GROUP BY feature) r USING (feature))
"""
ORACLE["feature_ranks"] = _GR + 'SELECT "group", feature, rank FROM granks'

_TOPS = (50, 100, 500, 1000)
ORACLE["rank_stats"] = _GR + f"""
, med AS (SELECT "group", rank AS median_rank FROM (
            SELECT "group", rank, row_number() OVER (PARTITION BY "group" ORDER BY rank) AS pos,
                   count(*) OVER (PARTITION BY "group") AS nf FROM granks WHERE rank IS NOT NULL) t
          WHERE pos = floor(nf / 2) + 1),
  g AS (SELECT "group", count(*) AS total, count(rank) AS found, min(rank) AS min_rank, max(rank) AS max_rank,
               avg(rank) AS avg_rank,
               {", ".join(f"CAST(sum(CASE WHEN rank <= {n} THEN 1 ELSE 0 END) AS BIGINT) AS in_top_{n}" for n in _TOPS)}
        FROM granks GROUP BY "group")
SELECT g."group", total, found, total - found AS not_found,
       round(CASE WHEN total > 0 THEN found / total * 100 ELSE 0.0 END, 6) AS found_pct,
       min_rank, max_rank, median_rank, round(avg_rank, 6) AS avg_rank,
       {", ".join(f"in_top_{n}" for n in _TOPS)},
       {", ".join(f"round(CASE WHEN total > 0 THEN in_top_{n} / total * 100 ELSE 0.0 END, 6) AS in_top_{n}_pct" for n in _TOPS)}
FROM g LEFT JOIN med USING ("group")"""

_CAT = "CASE " + " ".join(
    f"WHEN starts_with(feature, '{p}') THEN '{p.rstrip('_')}'" for p in
    ["PMD_", "HASSAN_", "MOSER_", "ISSUE_", "CHANGE_TYPE_", "SM_", "AST_"]) + " ELSE 'OTHER' END"
_CAT_COV = "CASE " + " ".join(
    f"WHEN starts_with(feature, '{p}') THEN '{p.rstrip('_')}'" for p in
    ["PMD_", "HASSAN_", "MOSER_", "ISSUE_", "CHANGE_TYPE_", "SM_", "AST_", "COV_"]) + " ELSE 'OTHER' END"

ORACLE["category_breakdown"] = _GR + f"""
SELECT "group", {_CAT} AS category, count(*) AS count, round(avg(rank), 6) AS avg_rank, min(rank) AS min_rank,
       CAST(sum(CASE WHEN rank <= 100 THEN 1 ELSE 0 END) AS BIGINT) AS in_top_100
FROM granks WHERE rank IS NOT NULL GROUP BY 1, 2"""

ORACLE["top20_by_group"] = _GR + f"""
SELECT * FROM (SELECT "group", row_number() OVER (PARTITION BY "group" ORDER BY rank, feature) AS pos,
                      feature, rank, {_CAT} AS category
               FROM granks WHERE rank IS NOT NULL) t WHERE pos <= 20"""

_CRANK2 = _CRANK + G.relevance("cs", "label", "version_id", _COMB_FEATS, "lrank") + "\n"
ORACLE["ranking_overlap"] = _CRANK2 + """
SELECT n.top_n, a.feature, a.rank AS rank_a, b.rank AS rank_b
FROM crank a JOIN lrank b USING (feature) JOIN (VALUES (5), (10)) AS n(top_n)
  ON a.rank <= n.top_n AND b.rank <= n.top_n"""

ORACLE["category_rollup"] = _CRANK.rstrip().rstrip(",") + f"""
SELECT {_CAT_COV} AS category, count(*) AS n, min(rank) AS min_rank, max(rank) AS max_rank,
       round(avg(relevance), 6) AS avg_relevance, arg_min(feature, rank) AS top_feature
FROM crank GROUP BY 1"""

ORACLE["category_shares"] = _CRANK.rstrip().rstrip(",") + f"""
SELECT {_CAT_COV} AS category, count(*) AS count FROM crank WHERE rank <= 10 GROUP BY 1"""


# --- classification ---------------------------------------------------------------

_FOLDS = with_("scores") + """
, folded AS (SELECT *, CAST((row_number() OVER (ORDER BY y DESC, md5('42:' || CAST(row_id AS VARCHAR))) - 1) % 5
                    AS INTEGER) AS fold FROM scores)
"""
ORACLE["stratified_folds"] = _FOLDS + "SELECT row_id, y, fold FROM folded"
ORACLE["class_weights"] = _FOLDS + """
, c AS (SELECT fold, y, count(*) AS n_fc FROM folded GROUP BY fold, y),
  t AS (SELECT fold, y, n_fc, sum(n_fc) OVER (PARTITION BY y) - n_fc AS n_train_c,
               sum(n_fc) OVER () - sum(n_fc) OVER (PARTITION BY fold) AS n_train FROM c)
SELECT fold, y, round(n_train / (2 * n_train_c), 6) AS weight FROM t"""


def _fold_metrics_sql(src: str) -> str:
    return f"""
  fc_{src} AS (SELECT fold, sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,
                sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
                sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn, count(*) AS n
         FROM {src} GROUP BY fold),
  pr_{src} AS (SELECT fold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, (tp + fn) / n AS prevalence
         FROM fc_{src}),
  fm_{src} AS (SELECT fold, precision, recall,
                CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
                precision * recall + (1 - recall) * prevalence AS avg_precision FROM pr_{src}),
  per_{src} AS (SELECT fold, sum(y) AS pos, sum(1 - y) AS neg, score FROM {src} GROUP BY fold, score),
  run_{src} AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY score
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM per_{src}),
  auc_{src} AS (SELECT fold, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
                 sum(pos * (neg_below + neg / 2.0)) / (sum(pos) * sum(neg)) END AS roc_auc
                FROM run_{src} GROUP BY fold),
  lm_{src} AS (SELECT fold, metric, value FROM (SELECT * FROM fm_{src} JOIN auc_{src} USING (fold))
               UNPIVOT (value FOR metric IN (precision, recall, f1, roc_auc, avg_precision))),
  sum_{src} AS (SELECT metric, avg(value) AS mean, stddev_pop(value) AS std,
                list(value ORDER BY fold) AS vals FROM lm_{src} GROUP BY metric)"""


ORACLE["fold_metrics"] = _FOLDS + "," + _fold_metrics_sql("folded") + """
SELECT fold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM fm_folded"""
ORACLE["hard_ap"] = _FOLDS + "," + _fold_metrics_sql("folded") + \
    "\nSELECT fold, round(avg_precision, 6) AS avg_precision FROM fm_folded"
ORACLE["roc_auc"] = _FOLDS + "," + _fold_metrics_sql("folded") + \
    "\nSELECT fold, round(roc_auc, 6) AS roc_auc FROM auc_folded"
ORACLE["roc_auc_unique"] = """
WITH s AS (SELECT CAST(o_custkey % 5 AS INTEGER) AS fold, o_totalprice AS score,
                  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders),
per AS (SELECT fold, score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY fold, score),
run AS (SELECT fold, pos, neg, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY score
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM per)
SELECT fold, round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM run GROUP BY fold"""
ORACLE["cv_summary"] = _FOLDS + "," + _fold_metrics_sql("folded") + """
SELECT metric, round(mean, 6) AS mean, round(std, 6) AS std, list_transform(vals, lambda v: round(v, 6)) AS "values"
FROM sum_folded"""

_CUTS = (("cut_030", 0.3), ("cut_050", 0.5), ("cut_070", 0.7))
_BEST = _FOLDS + "".join(
    f", {n} AS (SELECT row_id, y, score, fold, CAST(score > {c} AS INTEGER) AS pred FROM folded),"
    + _fold_metrics_sql(n) for n, c in _CUTS)
ORACLE["best_by_metric"] = _BEST + """
, allp AS (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS dataset, {i} AS dataset_idx, metric, round(mean, 6) AS mean, round(std, 6) AS std FROM sum_{n}"
    for i, (n, _) in enumerate(_CUTS)) + """)
SELECT dataset, metric, mean, std,
       row_number() OVER (PARTITION BY metric ORDER BY mean DESC, dataset_idx ASC) = 1 AS is_best FROM allp"""


# --- distances ---------------------------------------------------------------------

_EPS2 = repr(0.12 * 0.12)
_PTS = with_("part2") + """
, pts AS (SELECT row_id, x0, x1 FROM part2)
"""
_SQD = "((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1))"

ORACLE["k_distance"] = _PTS + f"""
, d AS (SELECT a.row_id, sqrt({_SQD}) AS dist,
               row_number() OVER (PARTITION BY a.row_id ORDER BY {_SQD}) AS k
        FROM pts a JOIN pts b ON true)
SELECT row_id, round(dist, 6) AS k_distance FROM d WHERE k = 5"""

ORACLE["eps_knee"] = _PTS + f"""
, s AS (SELECT * FROM pts),
  d AS (SELECT a.row_id, sqrt({_SQD}) AS dist,
               row_number() OVER (PARTITION BY a.row_id ORDER BY {_SQD}) AS k
        FROM s a JOIN s b ON true),
  kd AS (SELECT dist AS kdist, row_number() OVER (ORDER BY dist) - 1 AS i FROM d WHERE k = 5),
  e AS (SELECT count(*) AS n, min(kdist) AS d0, max(kdist) AS dn FROM kd),
  c AS (SELECT i, kdist, CASE WHEN sqrt((n - 1) * (n - 1) + (dn - d0) * (dn - d0)) > 0 THEN
               abs((n - 1) * (d0 - kdist) - (dn - d0) * (0 - i)) / sqrt((n - 1) * (n - 1) + (dn - d0) * (dn - d0))
               ELSE 0.0 END AS chord, n FROM kd, e),
  best AS (SELECT kdist AS eps_raw, n FROM c ORDER BY chord DESC, i ASC LIMIT 1)
SELECT round(CASE WHEN n < 2 OR eps_raw < 0.1 THEN 0.5 ELSE eps_raw END, 6) AS eps,
       round(eps_raw, 6) AS eps_raw, n AS n_points FROM best"""

_NB = _PTS + f"""
, nb AS (SELECT a.row_id AS a, b.row_id AS b FROM pts a JOIN pts b ON {_SQD} <= {_EPS2}::DOUBLE)
"""
ORACLE["eps_neighbours"] = _NB + "SELECT a AS row_id, count(*) AS n_neighbours FROM nb GROUP BY a"

_DBSCAN = "WITH RECURSIVE " + _NB[len("WITH "):] + """
, deg AS (SELECT a, count(*) AS n FROM nb GROUP BY a),
  core AS (SELECT a AS id FROM deg WHERE n >= 5),
  ce AS (SELECT nb.a, nb.b FROM nb JOIN core c1 ON nb.a = c1.id JOIN core c2 ON nb.b = c2.id),
  reach(id, lbl) AS (SELECT id, id FROM core UNION SELECT ce.b, r.lbl FROM reach r JOIN ce ON r.id = ce.a),
  comp AS (SELECT id, min(lbl) AS root FROM reach GROUP BY id),
  num AS (SELECT root, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS cluster
          FROM (SELECT DISTINCT root FROM comp)),
  corecl AS (SELECT comp.id, num.cluster FROM comp JOIN num USING (root)),
  border AS (SELECT nb.a AS id, min(cc.cluster) AS cluster FROM nb JOIN corecl cc ON nb.b = cc.id
             WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a),
  lab AS (SELECT p.row_id, CAST(coalesce(cc.cluster, b.cluster, -1) AS INTEGER) AS cluster
          FROM pts p LEFT JOIN corecl cc ON p.row_id = cc.id LEFT JOIN border b ON p.row_id = b.id)
"""
ORACLE["dbscan"] = _DBSCAN + "SELECT row_id, cluster FROM lab"
ORACLE["dbscan_info"] = _DBSCAN + """
SELECT CAST(count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS INTEGER) AS n_clusters,
       CAST(sum(CASE WHEN cluster = -1 THEN 1 ELSE 0 END) AS INTEGER) AS n_noise,
       round(sum(CASE WHEN cluster = -1 THEN 1 ELSE 0 END) / count(*), 6) AS noise_ratio FROM lab"""

_PCL = with_("part2") + """
, pts AS (SELECT p.row_id, p.x0, p.x1,
                 CASE WHEN CAST(split_part(q.p_brand, '#', 2) AS INTEGER) >= 24 THEN -1
                      ELSE CAST(split_part(q.p_brand, '#', 2) AS INTEGER) - 1 END AS cluster
          FROM part2 p JOIN part q ON p.row_id = q.p_partkey),
  nn AS (SELECT * FROM pts WHERE cluster >= 0)
"""
ORACLE["silhouette"] = _PCL + f"""
, per AS (SELECT a.row_id, a.cluster AS own, b.cluster AS cl, sum(sqrt({_SQD})) AS s, count(*) AS c
          FROM nn a JOIN nn b ON true GROUP BY a.row_id, a.cluster, b.cluster),
  ab AS (SELECT row_id, max(CASE WHEN cl = own THEN c END) AS n_own, max(CASE WHEN cl = own THEN s END) AS s_own,
                min(CASE WHEN cl <> own THEN s / c END) AS b FROM per GROUP BY row_id),
  sc AS (SELECT CASE WHEN n_own <= 1 THEN 0.0
                     WHEN greatest(s_own / (n_own - 1), b) > 0 THEN (b - s_own / (n_own - 1)) / greatest(s_own / (n_own - 1), b)
                     ELSE 0.0 END AS s FROM ab)
SELECT round(CASE WHEN (SELECT count(DISTINCT cluster) FROM nn) >= 2 AND (SELECT count(*) FROM nn) >= 2
                  THEN avg(coalesce(s, 0.0)) END, 6) AS silhouette FROM sc"""

ORACLE["davies_bouldin"] = _PCL + """
, cen AS (SELECT cluster, avg(x0) AS c0, avg(x1) AS c1 FROM nn GROUP BY cluster),
  intra AS (SELECT n.cluster, avg(sqrt((n.x0 - c.c0) * (n.x0 - c.c0) + (n.x1 - c.c1) * (n.x1 - c.c1))) AS s
            FROM nn n JOIN cen c USING (cluster) GROUP BY n.cluster),
  cc AS (SELECT a.cluster, sqrt((a.c0 - b.c0) * (a.c0 - b.c0) + (a.c1 - b.c1) * (a.c1 - b.c1)) AS d,
                ia.s + ib.s AS ss
         FROM cen a JOIN cen b ON true JOIN intra ia ON ia.cluster = a.cluster JOIN intra ib ON ib.cluster = b.cluster),
  per AS (SELECT cluster, max(CASE WHEN d = 0 THEN 0.0 ELSE ss / d END) AS r, max(d) AS dmax FROM cc GROUP BY cluster)
SELECT round(CASE WHEN (SELECT count(*) FROM cen) < 2 THEN NULL
                  WHEN (SELECT max(abs(s)) FROM intra) <= 1e-8 OR max(dmax) <= 1e-8 THEN 0.0
                  ELSE avg(r) END, 6) AS davies_bouldin FROM per"""

ORACLE["kdist_curve"] = _PTS + f"""
, d AS (SELECT a.row_id, sqrt({_SQD}) AS dist,
               row_number() OVER (PARTITION BY a.row_id ORDER BY {_SQD}) AS k
        FROM pts a JOIN pts b ON true),
  full_kd AS (SELECT row_id, dist AS k_distance FROM d WHERE k = 5),
  s AS (SELECT * FROM pts),
  sd AS (SELECT a.row_id, sqrt({_SQD}) AS dist,
                row_number() OVER (PARTITION BY a.row_id ORDER BY {_SQD}) AS k
         FROM s a JOIN s b ON true),
  kd AS (SELECT dist AS kdist, row_number() OVER (ORDER BY dist) - 1 AS i FROM sd WHERE k = 5),
  e AS (SELECT count(*) AS n, min(kdist) AS d0, max(kdist) AS dn FROM kd),
  c AS (SELECT i, kdist, CASE WHEN sqrt((n - 1) * (n - 1) + (dn - d0) * (dn - d0)) > 0 THEN
               abs((n - 1) * (d0 - kdist) - (dn - d0) * (0 - i)) / sqrt((n - 1) * (n - 1) + (dn - d0) * (dn - d0))
               ELSE 0.0 END AS chord, n FROM kd, e),
  best AS (SELECT CASE WHEN n < 2 OR kdist < 0.1 THEN 0.5 ELSE kdist END AS eps FROM c ORDER BY chord DESC, i ASC LIMIT 1)
SELECT row_number() OVER (ORDER BY k_distance, row_id) - 1 AS idx, round(k_distance, 6) AS k_distance,
       round(k_distance, 9) = round((SELECT eps FROM best), 9) AS is_eps
FROM full_kd"""


ORACLE["high_risk_members"] = _UC + """
, pc AS (SELECT cluster, count(*) AS total, CAST(sum(y) AS BIGINT) AS defective FROM unit_clusters GROUP BY cluster),
  hi AS (SELECT cluster FROM pc WHERE cluster >= 0
         AND defective / total > (SELECT avg(CAST(y AS DOUBLE)) FROM unit_clusters))
SELECT row_id, cluster, y FROM unit_clusters WHERE cluster IN (SELECT cluster FROM hi)"""

ORACLE["ranking_head"] = _CRANK.rstrip().rstrip(",") + """
SELECT rank, feature, round(relevance, 6) AS relevance FROM crank WHERE rank <= 5"""

_EMB = """WITH e AS (SELECT vec_id AS row_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
                  label AS cluster FROM embeddings),
  nn AS (SELECT * FROM e WHERE cluster >= 0)
"""
ORACLE["silhouette_emb"] = _EMB + """
, per AS (SELECT a.row_id, a.cluster AS own, b.cluster AS cl, sum(list_distance(a.v, b.v)) AS s, count(*) AS c
          FROM nn a JOIN nn b ON true GROUP BY a.row_id, a.cluster, b.cluster),
  ab AS (SELECT row_id, max(CASE WHEN cl = own THEN c END) AS n_own, max(CASE WHEN cl = own THEN s END) AS s_own,
                min(CASE WHEN cl <> own THEN s / c END) AS b FROM per GROUP BY row_id),
  sc AS (SELECT CASE WHEN n_own <= 1 THEN 0.0
                     WHEN greatest(s_own / (n_own - 1), b) > 0 THEN (b - s_own / (n_own - 1)) / greatest(s_own / (n_own - 1), b)
                     ELSE 0.0 END AS s FROM ab)
SELECT round(CASE WHEN (SELECT count(DISTINCT cluster) FROM nn) >= 2 AND (SELECT count(*) FROM nn) >= 2
                  THEN avg(coalesce(s, 0.0)) END, 6) AS silhouette FROM sc"""

ORACLE["davies_bouldin_emb"] = _EMB + """
, ex AS (SELECT cluster, generate_subscripts(v, 1) AS j, unnest(v) AS x FROM nn),
  cen AS (SELECT cluster, list(c ORDER BY j) AS c FROM (SELECT cluster, j, avg(x) AS c FROM ex GROUP BY cluster, j)
          GROUP BY cluster),
  intra AS (SELECT n.cluster, avg(list_distance(n.v, c.c)) AS s FROM nn n JOIN cen c USING (cluster) GROUP BY n.cluster),
  cc AS (SELECT a.cluster, list_distance(a.c, b.c) AS d, ia.s + ib.s AS ss
         FROM cen a JOIN cen b ON true JOIN intra ia ON ia.cluster = a.cluster JOIN intra ib ON ib.cluster = b.cluster),
  per AS (SELECT cluster, max(CASE WHEN d = 0 THEN 0.0 ELSE ss / d END) AS r, max(d) AS dmax FROM cc GROUP BY cluster)
SELECT round(CASE WHEN (SELECT count(*) FROM cen) < 2 THEN NULL
                  WHEN (SELECT max(abs(s)) FROM intra) <= 1e-8 OR max(dmax) <= 1e-8 THEN 0.0
                  ELSE avg(r) END, 6) AS davies_bouldin FROM per"""


def _unsigned_zero(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)`` so -0.0 prints as 0.0."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j] + "(" + "round(" + _unsigned_zero(sql[j + len(key):k]) + ") + 0.0)")
        i = k + 1


for _k in list(ORACLE):
    ORACLE[_k] = _unsigned_zero(ORACLE[_k])

ORACLE["join_null_keys"] = """
WITH k AS (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS file,
                  CASE WHEN p_size % 9 <> 0 THEN CAST(p_size % 5 AS INTEGER) END AS version FROM part),
r AS (SELECT file, version, min(p_partkey) AS first_part, count(*) AS n FROM k GROUP BY file, version HAVING count(*) > 1)
SELECT k.p_partkey, k.file, k.version, r.first_part, r.n
FROM k LEFT JOIN r ON k.file IS NOT DISTINCT FROM r.file AND k.version IS NOT DISTINCT FROM r.version
WHERE k.p_partkey % 3 = 0"""
ORACLE["versioned_files"] = """
SELECT c_name AS filename, CASE WHEN c_nationkey < 12 THEN '1.1.0' ELSE '1.10.0' END AS version,
       CAST(c_custkey AS BIGINT) AS "COV_A", CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS "COV_B",
       CASE WHEN c_nationkey >= 12 THEN CAST(c_custkey % 7 AS BIGINT) END AS "COV_C"
FROM customer"""
ORACLE["cell_values"] = """
SELECT col_idx, value, count(*) AS n
FROM (SELECT CAST(0 AS INTEGER) AS col_idx, CAST(n_nationkey AS VARCHAR) AS value FROM nation
      UNION ALL SELECT 1, n_name FROM nation)
WHERE value IS NOT NULL AND NOT contains(value, '7') GROUP BY col_idx, value"""
ORACLE["join_null_keys_all"] = """
WITH k AS (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS file,
                  CASE WHEN p_size % 9 <> 0 THEN CAST(p_size % 5 AS INTEGER) END AS version FROM part),
r AS (SELECT file, version, min(p_partkey) AS first_part, count(*) AS n FROM k GROUP BY file, version HAVING count(*) > 1)
SELECT k.p_partkey, k.file, k.version, r.first_part, r.n
FROM k LEFT JOIN r ON k.file IS NOT DISTINCT FROM r.file AND k.version IS NOT DISTINCT FROM r.version"""
ORACLE["cell_values_customer"] = """
SELECT col_idx, value, count(*) AS n
FROM (SELECT CAST(0 AS INTEGER) AS col_idx, CAST(c_custkey AS VARCHAR) AS value FROM customer
      UNION ALL SELECT 1, c_name FROM customer UNION ALL SELECT 2, CAST(c_nationkey AS VARCHAR) FROM customer)
WHERE value IS NOT NULL AND NOT contains(value, '7') GROUP BY col_idx, value"""

ORACLE["join_suffixes"] = """
SELECT o.o_custkey AS key, o.o_totalprice AS amount_x, o.o_orderkey AS id_x, c.c_acctbal AS amount_y, c.c_nationkey AS id_y
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey"""
ORACLE["pca_centers"] = _PCL + """
, p AS (SELECT * FROM pts),
  m AS (SELECT avg(x0) AS m0, avg(x1) AS m1, var_samp(x0) AS a, covar_samp(x0, x1) AS b, var_samp(x1) AS c FROM p),
  e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l FROM m),
  u AS (SELECT m0, m1, b / sqrt(b * b + (l - a) * (l - a)) AS u0, (l - a) / sqrt(b * b + (l - a) * (l - a)) AS u1 FROM e),
  k AS (SELECT 'row' AS kind, row_id AS id, x0, x1 FROM p
        UNION ALL SELECT 'center', cluster, avg(x0), avg(x1) FROM p WHERE cluster >= 0 GROUP BY cluster)
SELECT kind, CAST(id AS BIGINT) AS id, round(abs((x0 - m0) * u0 + (x1 - m1) * u1), 6) AS pc1,
       round(abs((x1 - m1) * u0 - (x0 - m0) * u1), 6) AS pc2
FROM k, u"""


def _solved(width: int, names: str) -> str:
    """Gauss-Jordan elimination of the symmetric positive systems ``a`` (rows of coefficients, then the right side)."""
    src = "(SELECT * FROM systems)"
    for p in range(1, width + 1):
        src = (f"(SELECT {names}, list_transform(a, lambda r, i: CASE WHEN i = {p} THEN list_transform(r, lambda v: v / r[{p}]) "
               f"ELSE list_transform(r, lambda v, j: v - r[{p}] / a[{p}][{p}] * a[{p}][j]) END) AS a FROM {src})")
    return src


def _newton_sql(features: list[str], steps: int = 14) -> str:
    """CTEs: ``ud`` (row_id, y, fold, x with a last 1) and ``fitted`` (m, b): plain Newton steps from zero for the
    models that leave out fold m (-1: none), L2 penalty on all but the last coefficient."""
    d = len(features) + 1
    cell = [[f"sum(h * x[{min(i, j)}] * x[{max(i, j)}]){' + 1.0' if i == j < d else ''}" for j in range(1, d + 1)] for i in range(1, d + 1)]
    side = [f"sum(g * x[{i}])" + (f" + any_value(b)[{i}]" if i < d else "") for i in range(1, d + 1)]
    rows = ", ".join("[" + ", ".join([*cell[i], side[i]]) + "]" for i in range(d))
    solved = _solved(d, "m, it, b").replace("(SELECT * FROM systems)", f"""(
      SELECT m, any_value(it) AS it, any_value(b) AS b, [{rows}] AS a FROM (
        SELECT m, it, b, x, w * p * (1 - p) AS h, w * (p - y) AS g FROM (
          SELECT n.m, n.it, n.b, t.x, t.y, t.w, 1 / (1 + exp(-list_dot_product(n.b, t.x))) AS p
          FROM newton n JOIN train t ON n.m = t.m WHERE n.it < {steps})) GROUP BY m)""")
    return f"""
, ud AS MATERIALIZED (SELECT row_id, label AS y, CAST((row_number() OVER (ORDER BY label DESC, md5('42:' || CAST(row_id AS VARCHAR))) - 1) % 5
                   AS INTEGER) AS fold, [{', '.join(G.qi(f) for f in features)}, 1.0] AS x FROM us),
  ms AS (SELECT CAST(unnest([-1, 0, 1, 2, 3, 4]) AS INTEGER) AS m),
  mw AS (SELECT m, y, sum(count(*)) OVER (PARTITION BY m) / (2 * count(*)) AS w FROM ms JOIN ud ON fold <> m GROUP BY m, y),
  train AS MATERIALIZED (SELECT ms.m, ud.y, ud.x, CAST(mw.w AS DOUBLE) AS w FROM ms JOIN ud ON ud.fold <> ms.m
                         JOIN mw ON mw.m = ms.m AND mw.y = ud.y),
  newton AS (SELECT m, 0 AS it, CAST([{', '.join(['0.0'] * d)}] AS DOUBLE[]) AS b FROM ms
             UNION ALL SELECT m, it + 1, list_transform(b, lambda v, i: v - a[i][{d + 1}]) FROM {solved}),
  fitted AS (SELECT m, b FROM newton WHERE it = {steps})"""


_NEWTON = "WITH RECURSIVE " + _UNIT_M1[len("WITH "):] + _newton_sql(td.UNIT_FEATURES)
_COEFFICIENTS = ", cf AS (" + " UNION ALL ".join(
    f"SELECT m AS fold, {i} AS feature_idx, '{f}' AS feature, b[{i + 1}] AS coefficient FROM fitted"
    for i, f in enumerate(td.UNIT_FEATURES)) + ")"
ORACLE["logreg_coefficients"] = _NEWTON + _COEFFICIENTS + " SELECT fold, feature, round(coefficient, 6) + 0.0 AS coefficient FROM cf"
ORACLE["logreg_importances"] = _NEWTON + _COEFFICIENTS + """
SELECT CAST(row_number() OVER (ORDER BY abs(coefficient) DESC, feature_idx) AS INTEGER) AS rank, feature,
       round(abs(coefficient), 6) AS importance FROM cf WHERE fold = -1"""
ORACLE["logreg_cv"] = _NEWTON + """
, sc AS (SELECT row_id, fold, y, 1 / (1 + exp(-list_dot_product(b, x))) AS score FROM ud JOIN fitted ON m = fold),
  lr AS (SELECT *, CAST(score > 0.5 AS INTEGER) AS pred FROM sc),""" + _fold_metrics_sql("lr") + """
SELECT fold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(avg_precision, 6) AS avg_precision, round(roc_auc, 6) AS roc_auc FROM fm_lr JOIN auc_lr USING (fold)"""
ORACLE["extract_sheet"] = with_("unit") + "SELECT row_id, grp || ', all' AS grp, SM_size, SM_price, SM_qty_avg, SM_qty_std FROM unit"
# both leading eigenvalues from the powers of the covariance matrix: squared often, then taken out
ORACLE["pca_wide"] = """
WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id AS id, unnest(range(1, len(embedding) + 1)) AS j,
                      CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
  c AS (SELECT id, j, x - avg(x) OVER (PARTITION BY j) AS x FROM e),
  n AS (SELECT count(DISTINCT id) AS n FROM e),
  cov AS MATERIALIZED (SELECT a.j AS i, b.j AS j, sum(a.x * b.x) / (SELECT n FROM n) AS v FROM c a JOIN c b USING (id) GROUP BY a.j, b.j),
  p1 AS (SELECT 0 AS it, i, j, v / (SELECT sum(v) FROM cov WHERE i = j) AS v FROM cov
         UNION ALL SELECT it + 1, i, j, v / sum(CASE WHEN i = j THEN v END) OVER ()
         FROM (SELECT a.it, a.i, b.j, sum(a.v * b.v) AS v FROM p1 a JOIN p1 b ON a.j = b.i WHERE a.it < 24 GROUP BY a.it, a.i, b.j)),
  l1 AS (SELECT sum(p1.v * cov.v) AS l FROM p1 JOIN cov ON p1.i = cov.j AND p1.j = cov.i WHERE it = 24),
  cov2 AS MATERIALIZED (SELECT cov.i, cov.j, cov.v - (SELECT l FROM l1) * p1.v AS v FROM cov JOIN p1 ON p1.i = cov.i AND p1.j = cov.j WHERE it = 24),
  p2 AS (SELECT 0 AS it, i, j, v / (SELECT sum(v) FROM cov2 WHERE i = j) AS v FROM cov2
         UNION ALL SELECT it + 1, i, j, v / sum(CASE WHEN i = j THEN v END) OVER ()
         FROM (SELECT a.it, a.i, b.j, sum(a.v * b.v) AS v FROM p2 a JOIN p2 b ON a.j = b.i WHERE a.it < 24 GROUP BY a.it, a.i, b.j)),
  l2 AS (SELECT sum(p2.v * cov2.v) AS l FROM p2 JOIN cov2 ON p2.i = cov2.j AND p2.j = cov2.i WHERE it = 24),
  t AS (SELECT sum(v) AS t FROM cov WHERE i = j)
SELECT round(l1.l, 6) AS var_pc1, round(l2.l, 6) AS var_pc2, 0.0 AS covar,
       round(l1.l / t, 6) AS share_pc1, round(l2.l / t, 6) AS share_pc2 FROM l1, l2, t"""
ORACLE["results_documents"] = with_("unit") + """
, h AS (SELECT count(*) AS n, sum(CASE WHEN "Bug" > 0 THEN 1 ELSE 0 END) AS d FROM unit)
SELECT k.kind, 'unit' AS dataset, k.method, CAST(n AS BIGINT) AS n_samples, CAST(6 AS BIGINT) AS n_features,
       CAST(d AS BIGINT) AS n_defective, round(d / n * 100, 2) AS defect_rate, CAST(6 AS BIGINT) AS n_ranked, true AS named
FROM h, (VALUES ('classification', 'lr'), ('clustering', 'kmeans')) AS k(kind, method)"""
