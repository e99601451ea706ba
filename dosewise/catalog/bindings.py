"""Pipeline inputs expressed over the given tables.

The texts in ``{table}`` form run unchanged in Spark SQL and in the checking
engine; the ``SQL_*`` texts restate the cleaning and joining steps for the
checking engine alone.
"""

from __future__ import annotations

RESPONSE = """
SELECT event_id AS assay_id,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 3 = 0 THEN concat('  ', upper(event_type), ' ') ELSE event_type END AS drug_name,
  CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'nan'
       WHEN event_id % 5 = 0 THEN concat(' ', CAST(user_id AS STRING), ' ')
       ELSE concat(CAST(user_id AS STRING), '.0') END AS cosmic_raw,
  CASE WHEN event_id % 41 = 0 THEN 'bad' WHEN event_id % 43 = 0 THEN NULL ELSE CAST(value AS STRING) END AS ln_ic50_raw
FROM {events}
"""

METADATA = """
SELECT c_custkey AS model_id,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat(CAST(c_custkey AS STRING), '.0') END AS cosmic_raw
FROM {customer}
"""

COEFFICIENTS = """
SELECT p_brand AS drug_slug,
  concat(upper(replace(p_name, ' ', '-')), '-', CAST(p_partkey AS STRING), ' (', CAST(p_partkey AS STRING), ')') AS feature,
  CASE WHEN p_partkey % 3 = 0 THEN 0.0E0 ELSE (p_partkey * 7919 % 2003 - 1001) / 10000.0E0 END AS coefficient
FROM {part}
"""

_SYMBOL = "concat(upper(replace(p_name, ' ', '-')), '-', CAST(p_partkey AS STRING))"
LIBRARY = f"""
SELECT 'brand' AS gene_set, p_brand AS term, {_SYMBOL} AS symbol FROM {{part}}
UNION ALL SELECT 'type', p_type, {_SYMBOL} FROM {{part}}
UNION ALL SELECT 'size', CAST(p_size AS STRING), {_SYMBOL} FROM {{part}}
"""

CATALOGUE = """
SELECT concat('release_', CAST((p_partkey - p_partkey % 9) / 9 AS BIGINT)) AS table_name,
  CASE p_partkey % 9
    WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'DRUG_NAME' ELSE 'Compound' END
    WHEN 1 THEN CASE WHEN p_size % 3 = 0 THEN 'DRUG_ID' ELSE p_type END
    WHEN 2 THEN 'Cell line name'
    WHEN 3 THEN CASE WHEN p_size % 5 = 0 THEN '__' ELSE 'COSMIC-ID' END
    WHEN 4 THEN 'LN_IC50'
    WHEN 5 THEN CASE WHEN p_size % 4 = 0 THEN 'auc value' ELSE 'Z_SCORE' END
    ELSE p_name END AS column_name
FROM {part}
"""

SQL_CLEAN_ID = (
    "regexp_replace(CASE WHEN trim({c}) NOT IN ('', 'nan', 'None', 'NA', '<NA>') THEN trim({c}) END, '\\.0$', '')"
)
SQL_SLUG = "regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"

_CTES = {
    "resp": RESPONSE.format(events="events"),
    "meta": METADATA.format(customer="customer"),
    "coef": COEFFICIENTS.format(part="part"),
    "lib": LIBRARY.format(part="part"),
    "cat": CATALOGUE.format(part="part"),
    "std": f"""
SELECT assay_id, {SQL_SLUG.format(c="drug_name")} AS drug_slug, drug_name, cosmic_raw AS cell_line_id,
  {SQL_CLEAN_ID.format(c="cosmic_raw")} AS cosmic_id, TRY_CAST(ln_ic50_raw AS DOUBLE) AS ln_ic50
FROM resp""",
    "bridge": f"SELECT model_id, {SQL_CLEAN_ID.format(c='cosmic_raw')} AS cosmic_id FROM meta WHERE cosmic_raw IS NOT NULL",
    "ds": """
SELECT s.assay_id, s.drug_slug, s.drug_name, s.cell_line_id, CAST(e.vec_id AS VARCHAR) AS depmap_model_id,
  s.ln_ic50, CAST(e.embedding AS DOUBLE[]) AS features
FROM std s JOIN bridge b ON s.cosmic_id = b.cosmic_id JOIN embeddings e ON e.vec_id = b.model_id
WHERE s.ln_ic50 IS NOT NULL""",
    "modelling": """
SELECT assay_id, drug_slug, depmap_model_id, features,
  CAST(2 AS DOUBLE) * features[1] - CAST(1.5 AS DOUBLE) * features[2] + CAST(0.5 AS DOUBLE) * features[3]
    + CAST(0.1 AS DOUBLE) * ((assay_id * 7919 % 1000) / CAST(1000 AS DOUBLE) - CAST(0.5 AS DOUBLE)) AS ln_ic50
FROM ds WHERE drug_slug IS NOT NULL""",
    "ordered": """
SELECT *, row_number() OVER (PARTITION BY drug_slug ORDER BY md5(concat(assay_id, '|', depmap_model_id, '|42'))) AS pos,
  CAST(ceil(CAST(0.2 AS DOUBLE) * count(*) OVER (PARTITION BY drug_slug)) AS BIGINT) AS n_test
FROM modelling""",
    "parts": """
SELECT assay_id, drug_slug, depmap_model_id, features, ln_ic50,
  CASE WHEN pos <= n_test THEN 'test' ELSE 'train' END AS split,
  CASE WHEN pos > n_test THEN ntile(5) OVER (PARTITION BY drug_slug, pos <= n_test ORDER BY pos) END AS fold
FROM ordered""",
    "moments": """
SELECT drug_slug, j, avg(x) AS mean, CASE WHEN var_pop(x) < 1e-20 THEN 1 ELSE stddev_pop(x) END AS scale
FROM (SELECT drug_slug, unnest(features) AS x, unnest(range(len(features))) AS j FROM parts WHERE split = 'train')
GROUP BY drug_slug, j""",
    "z": """
SELECT p.assay_id, p.depmap_model_id, p.drug_slug, p.split, p.fold, p.ln_ic50, p.j, (p.x - m.mean) / m.scale AS z
FROM (SELECT * EXCLUDE (features), unnest(features) AS x, unnest(range(len(features))) AS j FROM parts) p
JOIN moments m ON m.drug_slug = p.drug_slug AND m.j = p.j""",
    "hits": """
SELECT g.drug_slug, l.gene_set, l.term, count(DISTINCT l.symbol) AS overlap,
  string_agg(DISTINCT l.symbol, ';' ORDER BY l.symbol) AS genes
FROM lib l JOIN genes g ON g.symbol = l.symbol GROUP BY ALL""",
    "genes": """
SELECT DISTINCT drug_slug, regexp_extract(feature, '^([A-Za-z0-9-]+)', 1) AS symbol FROM coef WHERE coefficient <> 0""",
    "counted": """
SELECT h.*, s.set_size, n.n_genes, b.total
FROM hits h
JOIN (SELECT gene_set, term, count(DISTINCT symbol) AS set_size FROM lib GROUP BY ALL) s USING (gene_set, term)
JOIN (SELECT drug_slug, count(*) AS n_genes FROM genes GROUP BY ALL) n USING (drug_slug),
(SELECT count(*) AS total FROM part) b""",
    "tested": """
SELECT *, (
  SELECT least(1.0, sum(exp(
      lgamma(set_size + 1) - lgamma(x + 1) - lgamma(set_size - x + 1)
    + lgamma(total - set_size + 1) - lgamma(n_genes - x + 1) - lgamma(total - set_size - n_genes + x + 1)
    - lgamma(total + 1) + lgamma(n_genes + 1) + lgamma(total - n_genes + 1))))
  FROM (SELECT unnest(range(greatest(overlap, n_genes + set_size - total), least(set_size, n_genes) + 1)) AS x)
) AS p_value,
CASE WHEN n_genes > overlap AND set_size > overlap
  THEN CAST(overlap AS DOUBLE) * (total - n_genes - (set_size - overlap)) / ((n_genes - overlap) * (set_size - overlap)) END AS odds_ratio
FROM counted""",
    "adjusted": """
SELECT *, least(1.0, min(p_value * m / r) OVER (PARTITION BY drug_slug, gene_set ORDER BY r DESC)) AS adj_p
FROM (SELECT *, count(*) OVER (PARTITION BY drug_slug, gene_set) AS m,
        rank() OVER (PARTITION BY drug_slug, gene_set ORDER BY q) + count(*) OVER (PARTITION BY drug_slug, gene_set, q) - 1 AS r
      FROM (SELECT *, round(p_value, 13) AS q FROM tested))""",
}

_NEEDS = {
    "std": ("resp",),
    "bridge": ("meta",),
    "ds": ("std", "bridge"),
    "modelling": ("ds",),
    "ordered": ("modelling",),
    "parts": ("ordered",),
    "moments": ("parts",),
    "z": ("moments",),
    "genes": ("coef",),
    "hits": ("lib", "genes"),
    "counted": ("hits",),
    "tested": ("counted",),
    "adjusted": ("tested",),
}


def with_bindings(sql: str, uses: tuple[str, ...]) -> str:
    """Prefix SQL with the bindings it uses, each after what it needs itself."""
    chosen: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            add(needed)
        if name not in chosen:
            chosen.append(name)

    for name in uses:
        add(name)
    if not chosen:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({_CTES[name].strip()})" for name in chosen)
    body = sql.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    return f"WITH {ctes},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {ctes}\n{body}"
