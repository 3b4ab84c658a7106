"""DuckDB twins of the registered queries.

Shared steps are common table expressions in `CTES`; `sql(body, *names)` prepends the ones a query
needs, in order.
"""

from __future__ import annotations

import re

SEEDS = "42, 43, 44, 45, 46"


def r6(expr: str) -> str:
    """Six digits, without a negative zero."""
    return f"CASE WHEN abs({expr}) < 5e-7 THEN CAST(0 AS DOUBLE) ELSE round({expr}, 6) END"


def significant(text: str) -> str:
    """Writes out sig(column) and sig(column, digits): the value to so many (10) significant digits."""
    def written(m: re.Match) -> str:
        x, digits = m[1], int(m[2] or 10)
        scale = f"pow(10.0::DOUBLE, {digits - 1} - greatest(floor(log10(abs({x}))), -280))"
        return f"(CASE WHEN {x} = 0 OR NOT isfinite({x}) THEN {x} ELSE round({x} * {scale}) / {scale} END)"
    return re.sub(r"\bsig\((\w+)(?:, (\d+))?\)", written, text)


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, text: str, *needs: str) -> None:
    CTES[name] = (needs, text)


def sql(body: str, *names: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in CTES[name][0]:
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    return significant(f"WITH {head}\n{body}" if head else body)


# ---- inputs -----------------------------------------------------------------------------------
cte("emb_lab", """SELECT 'C' || CAST(vec_id % 3 AS VARCHAR) AS cohort, CAST(vec_id AS VARCHAR) AS sample_id,
  CAST(label AS VARCHAR) AS label FROM embeddings""")
cte("emb_cells", """SELECT cohort, sample_id, label, 'f' || lpad(CAST(pos AS VARCHAR), 3, '0') AS feature, value FROM (
  SELECT 'C' || CAST(vec_id % 3 AS VARCHAR) AS cohort, CAST(vec_id AS VARCHAR) AS sample_id,
    CAST(label AS VARCHAR) AS label, unnest(range(len(embedding))) AS pos,
    CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)""")
cte("doc_lab", """SELECT 'docs' AS cohort, CAST(d.doc_id AS VARCHAR) AS sample_id,
  d.lang || CAST(l.quality AS VARCHAR) AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
cte("doc_cells", r"""SELECT 'docs' AS cohort, CAST(doc_id AS VARCHAR) AS sample_id, feature,
  ln(1 + CAST(count(*) AS DOUBLE)) AS value FROM (
    SELECT d.doc_id, unnest(regexp_extract_all(lower(d.text), '\p{L}+')) AS feature
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id) GROUP BY doc_id, feature""")


def split_ctes(p: str) -> None:
    """Quotas and splits over the label table `{p}_lab`."""
    cte(f"{p}_quota", f"""SELECT cohort, label, size,
      CASE WHEN size = 1 THEN 1 ELSE base + CASE WHEN rn <= short THEN 1 ELSE 0 END END AS quota FROM (
        SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY remainder DESC, label) AS rn,
          train - sum(base) OVER (PARTITION BY cohort) AS short FROM (
            SELECT *, CASE WHEN size = 1 THEN 0 ELSE (size * train) // n END AS base,
              CASE WHEN size = 1 THEN -1 ELSE (size * train) % n END AS remainder FROM (
                SELECT c.cohort, c.label, c.size, t.n - t.lone AS n,
                  t.n - CAST(ceil(CAST(0.3 AS DOUBLE) * t.n) AS BIGINT) - t.lone AS train
                FROM (SELECT cohort, label, count(*) AS size FROM {p}_lab GROUP BY 1, 2) c
                JOIN (SELECT cohort, CAST(sum(size) AS BIGINT) AS n,
                        count(*) FILTER (WHERE size = 1) AS lone
                      FROM (SELECT cohort, label, count(*) AS size FROM {p}_lab GROUP BY 1, 2) GROUP BY 1) t
                  ON c.cohort = t.cohort)))""", f"{p}_lab")
    cte(f"{p}_split", f"""SELECT r.cohort, r.seed, r.sample_id, r.label,
      CASE WHEN r.rn <= q.quota THEN 'train' ELSE 'test' END AS part FROM (
        SELECT l.*, s.seed, row_number() OVER (PARTITION BY l.cohort, s.seed, l.label
          ORDER BY md5(CAST(s.seed AS VARCHAR) || ':' || l.sample_id), l.sample_id) AS rn
        FROM {p}_lab l CROSS JOIN (SELECT unnest([{SEEDS}]) AS seed) s) r
      JOIN {p}_quota q ON r.cohort = q.cohort AND r.label = q.label""", f"{p}_quota")


split_ctes("emb")
split_ctes("doc")

cte("emb_train", """SELECT s.cohort, s.seed, s.sample_id, s.label, c.feature, c.value
  FROM emb_cells c JOIN emb_split s ON c.cohort = s.cohort AND c.sample_id = s.sample_id
  WHERE s.part = 'train'""", "emb_cells", "emb_split")
cte("emb_stats", """SELECT cohort, seed, feature, label, count(*) AS n, avg(value) AS mean,
  var_pop(value) * count(*) AS m2 FROM emb_train GROUP BY 1, 2, 3, 4""", "emb_train")
cte("emb_mom", """SELECT s.cohort, s.seed, s.feature, CAST(sum(s.n) AS BIGINT) AS n, count(*) AS k, any_value(g.mean) AS mean,
  any_value(g.variance) AS variance, sum(s.n * (s.mean - g.mean) * (s.mean - g.mean)) AS between_ss, sum(s.m2) AS within_ss
  FROM emb_stats s JOIN (SELECT cohort, seed, feature, avg(value) AS mean, var_pop(value) AS variance
    FROM emb_train GROUP BY 1, 2, 3) g
    ON s.cohort = g.cohort AND s.seed = g.seed AND s.feature = g.feature GROUP BY 1, 2, 3""", "emb_stats")
cte("emb_f", """SELECT cohort, seed, feature, (between_ss / (k - 1)) / (within_ss / (n - k)) AS score FROM emb_mom""", "emb_mom")

# ---- events -----------------------------------------------------------------------------------
cte("evt_read", """SELECT 'E' AS cohort, 'USER-' || lpad(CAST(user_id AS VARCHAR), 12, '0') || '-' || CAST(event_id AS VARCHAR) AS barcode,
  event_type AS feature, event_type || '_' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS hour_feature, value FROM events""")
cte("evt_cells", """SELECT cohort, substr(barcode, 1, 17) AS sample_id, feature, avg(value) AS value
  FROM evt_read GROUP BY 1, 2, 3""", "evt_read")
cte("hour_cells", """SELECT cohort, substr(barcode, 1, 17) AS sample_id, hour_feature AS feature, avg(value) AS value
  FROM evt_read GROUP BY 1, 2, 3""", "evt_read")
cte("ord_rows", """SELECT * FROM (SELECT 'E' AS cohort, substr('USER-' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') || '-' || CAST(o_orderkey AS VARCHAR), 1, 17) AS sample_id,
  o_orderkey AS file_pos, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS label FROM orders)
  WHERE label IS NOT NULL""")
cte("ord_lab", """SELECT cohort, sample_id, label FROM (SELECT *, row_number() OVER (PARTITION BY cohort, sample_id ORDER BY file_pos) AS rn
  FROM ord_rows) WHERE rn = 1""", "ord_rows")
cte("evt_common", """SELECT l.* FROM ord_lab l WHERE EXISTS (SELECT 1 FROM evt_cells c WHERE c.cohort = l.cohort AND c.sample_id = l.sample_id)""",
    "ord_lab", "evt_cells")
cte("hour_lab", """SELECT l.* FROM ord_lab l WHERE EXISTS (SELECT 1 FROM hour_cells c WHERE c.cohort = l.cohort AND c.sample_id = l.sample_id)""",
    "ord_lab", "hour_cells")
split_ctes("hour")

# ---- nearest-centroid predictions -------------------------------------------------------------
RUN = "cohort, seed, method, param"


def on(a: str, b: str, keys: str) -> str:
    return " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))


cte("emb_anova_rank", """SELECT *, row_number() OVER (PARTITION BY cohort, seed ORDER BY sig(score) DESC, feature DESC) AS rn
  FROM emb_f""", "emb_f")
cte("emb_sets", """SELECT cohort, seed, 'baseline' AS method, 'all' AS param, feature FROM emb_mom
  UNION ALL SELECT cohort, seed, 'anova', 'k=10', feature FROM emb_anova_rank WHERE rn <= 10
  UNION ALL SELECT cohort, seed, 'anova', 'k=20', feature FROM emb_anova_rank WHERE rn <= 20
  UNION ALL SELECT cohort, seed, 'variance', 'tau=' || t, feature FROM emb_mom, (SELECT unnest(['0.015', '0.016', '0.017']) AS t) WHERE variance > CAST(t AS DOUBLE)
""", "emb_mom", "emb_anova_rank")


def centroid_ctes(p: str, sets: str) -> None:
    """Scores, predictions, probabilities, counts and metrics named {p}_..., over the feature sets `sets`."""
    cte(f"{p}_score", f"""SELECT t.cohort, t.seed, f.method, f.param, t.sample_id, t.label, m.label AS class,
      -round(sum((c.value - m.mean) * (c.value - m.mean)), 9) AS score
      FROM emb_split t JOIN emb_cells c ON {on('t', 'c', 'cohort, sample_id')}
      JOIN emb_stats m ON m.cohort = t.cohort AND m.seed = t.seed AND m.feature = c.feature
      JOIN {sets} f ON f.cohort = t.cohort AND f.seed = t.seed AND f.feature = c.feature
      WHERE t.part = 'test' GROUP BY 1, 2, 3, 4, 5, 6, 7""", "emb_split", "emb_cells", "emb_stats", sets)
    cte(f"{p}_prob", f"""SELECT *, e / sum(e) OVER (PARTITION BY {RUN}, sample_id) AS p FROM (
      SELECT *, exp(score - max(score) OVER (PARTITION BY {RUN}, sample_id)) AS e FROM {p}_score)""", f"{p}_score")
    cte(f"{p}_pred", f"""SELECT {RUN}, sample_id, label, class AS prediction FROM (SELECT *, row_number() OVER (
      PARTITION BY {RUN}, sample_id ORDER BY score DESC, class) AS rn FROM {p}_score) WHERE rn = 1""", f"{p}_score")
    cte(f"{p}_conf", f"SELECT {RUN}, label, prediction, count(*) AS n FROM {p}_pred GROUP BY ALL", f"{p}_pred")
    cte(f"{p}_class", f"""SELECT *, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE tp / predicted END AS "precision",
      CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE tp / support END AS recall, 2.0::DOUBLE * tp / (support + predicted) AS f1 FROM (
        SELECT k.*, (SELECT coalesce(sum(n), 0)::DOUBLE FROM {p}_conf c WHERE {on('c', 'k', RUN)} AND c.label = k.class AND c.prediction = k.class) AS tp,
          (SELECT coalesce(sum(n), 0)::BIGINT FROM {p}_conf c WHERE {on('c', 'k', RUN)} AND c.label = k.class) AS support,
          (SELECT coalesce(sum(n), 0)::BIGINT FROM {p}_conf c WHERE {on('c', 'k', RUN)} AND c.prediction = k.class) AS predicted
        FROM (SELECT {RUN}, label AS class FROM {p}_conf UNION SELECT {RUN}, prediction FROM {p}_conf) k)""", f"{p}_conf")
    cte(f"{p}_met", f"""SELECT {RUN}, sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
      avg(recall) AS macro_recall, sum(recall * support) / sum(support) AS weighted_recall, sum(support)::BIGINT AS n_test
      FROM {p}_class GROUP BY ALL""", f"{p}_class")
    auc_cte(f"{p}_auc", p)
    cte(f"{p}_avgauc", f"""SELECT {RUN}, CASE WHEN count(auc) = count(*) THEN avg(auc) END AS roc_auc_macro,
      CASE WHEN count(auc) = count(*) THEN sum(auc * n_pos) / sum(n_pos) END AS roc_auc_weighted FROM {p}_auc GROUP BY ALL""", f"{p}_auc")


def auc_cte(name: str, p: str, unit: float = 1.0) -> None:
    """Areas of the probabilities {p}_prob in some unit."""
    cte(name, f"""SELECT {RUN}, class, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0
        THEN (ranks - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg) END AS auc FROM (
      SELECT {RUN}, class, count(*) FILTER (WHERE label = class) AS n_pos, count(*) FILTER (WHERE label <> class) AS n_neg,
        sum(CASE WHEN label = class THEN first_rank + (ties - 1) / 2.0::DOUBLE END) AS ranks FROM (
          SELECT {RUN}, label, class, rank() OVER (PARTITION BY {RUN}, class ORDER BY s) AS first_rank,
            count(*) OVER (PARTITION BY {RUN}, class, s) AS ties FROM (SELECT *, round(p, 9) * {unit}::DOUBLE AS s FROM {p}_prob)) GROUP BY ALL)""", f"{p}_prob")


cte("emb_all", "SELECT cohort, seed, 'baseline' AS method, 'all' AS param, feature FROM emb_mom", "emb_mom")
centroid_ctes("one", "emb_all")
auc_cte("one_small_auc", "one", 1e-12)
centroid_ctes("many", "emb_sets")
cte("runs", f"""SELECT g.cohort, g.method, g.param, g.seed, g.seed - 42 AS run_id, w.n AS n_features_total, coalesce(c.n, 0)::INTEGER AS n_features,
  m.accuracy, m.macro_f1, m.weighted_f1, m.macro_recall, m.weighted_recall, a.roc_auc_macro, a.roc_auc_weighted,
  c.n * 0.25::DOUBLE AS train_time_s, c.n * 0.5::DOUBLE AS run_time_s, CASE WHEN m.accuracy IS NULL THEN 'empty' ELSE 'ok' END AS status
  FROM (SELECT cohort, seed, method, param FROM (SELECT DISTINCT cohort FROM emb_lab), (SELECT unnest([{SEEDS}]) AS seed),
    (SELECT unnest(['anova', 'anova', 'baseline', 'variance', 'variance', 'variance']) AS method,
            unnest(['k=10', 'k=20', 'all', 'tau=0.015', 'tau=0.016', 'tau=0.017']) AS param)) g
  LEFT JOIN (SELECT {RUN}, count(*)::INTEGER AS n FROM emb_sets GROUP BY ALL) c ON {on('g', 'c', RUN)}
  LEFT JOIN (SELECT cohort, count(DISTINCT feature)::INTEGER AS n FROM emb_mom GROUP BY 1) w ON w.cohort = g.cohort
  LEFT JOIN many_met m ON {on('g', 'm', RUN)} LEFT JOIN many_avgauc a ON {on('g', 'a', RUN)}""",
    "emb_lab", "emb_sets", "emb_mom", "many_met", "many_avgauc")
