"""DuckDB SQL equivalents of the catalogue queries (correctness oracle).

Each query is a chain of CTEs over the driver's views.  ``sql(final, *deps)``
assembles the ``WITH`` clause from the registry in dependency order.
Rules that keep both engines bit-identical:

* sums are exact on both sides: of the values' decimal text here, of decimals
  in Spark; averages that are reported rounded use integer arithmetic here
  (half-up rounding of the exact mean);
* ``CAST(x AS BIGINT)`` rounds in DuckDB and truncates in Spark, so the
  oracle writes ``CAST(trunc(x) AS BIGINT)``;
* decimal literals are cast to DOUBLE where Spark computes in double.
"""

from __future__ import annotations

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *deps: str) -> None:
    CTES[name] = (body, deps)


def sql(final: str, *deps: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for d in deps:
        visit(d)
    if not order:
        return final
    parts = ",\n".join(f"{n} AS (\n{CTES[n][0]}\n)" for n in order)
    return f"WITH {parts}\n{final}"


def exact_sum(x: str) -> str:
    """The sum of the values' shortest decimal text, as the nearest double."""
    return (f"CAST(CAST(sum(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,10))) AS VARCHAR) AS DOUBLE)")


def mean(x: str) -> str:
    """The mean at full precision."""
    return f"({exact_sum(x)} / nullif(count({x}), 0))"


def rnd_avg(x: str, dp: int, scale: int = 2) -> str:
    """Half-up rounded mean of values with ``scale`` decimals, exactly."""
    s = f"sum(CAST(round({x} * {10 ** scale}) AS HUGEINT))"
    n = f"count({x})"
    num = f"(2 * {s} * {10 ** dp} + {n} * {10 ** scale})"
    den = f"(2 * {n} * {10 ** scale})"
    return f"(CAST({num} // {den} AS DOUBLE) / {10 ** dp})"


def trunc_long(x: str) -> str:
    return f"CAST(trunc({x}) AS BIGINT)"


# --------------------------------------------------------------------------
# Adapter: driver tables -> raw listings (mirrors sources/adapter.py)
# --------------------------------------------------------------------------
cte("lines", """SELECT l_orderkey, sum(l_quantity) AS qty, count(*) AS n_lines
FROM lineitem GROUP BY l_orderkey""")
cte("geo", """SELECT n_nationkey, n_name, r_name
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
cte("base", """SELECT o_orderkey, o_totalprice, o_orderdate, o_orderstatus, qty, n_lines,
  c_custkey, c_name, c_mktsegment, n_name, r_name,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Appartement' WHEN '2' THEN 'Maison'
    WHEN '3' THEN 'Terrain'
    WHEN '4' THEN CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Loft' ELSE 'Autre' END
    WHEN '5' THEN 'Parking' END AS type_word,
  CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN chr(160) ELSE ' ' END AS gap, c_nationkey
FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey
LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN geo ON c_nationkey = n_nationkey""", "lines", "geo")
cte("copies", """SELECT b.*, c.copy FROM base b
JOIN (VALUES (0), (1)) c(copy) ON c.copy = 0 OR b.c_mktsegment = 'FURNITURE'""", "base")
cte("listings", """SELECT o_orderkey AS id,
  concat_ws(' ', type_word, CASE WHEN n_lines IS NOT NULL THEN
    (CASE WHEN c_mktsegment = 'BUILDING' THEN 'T' || CAST(n_lines AS VARCHAR)
          ELSE CAST(n_lines AS VARCHAR) || gap || 'pièces' END)
    || ' ' || CAST(CAST(qty AS BIGINT) AS VARCHAR) || gap || 'm²' END) AS title,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Autre' ELSE type_word END AS type,
  o_totalprice + copy * CAST(1000.0 AS DOUBLE) AS price,
  CAST(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE qty END AS DOUBLE) AS surface,
  CAST(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE n_lines END AS DOUBLE) AS pieces,
  (o_totalprice + copy * CAST(1000.0 AS DOUBLE))
    / CAST(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE qty END AS DOUBLE) AS price_m2,
  CASE WHEN c_mktsegment = 'MACHINERY'
         THEN chr(160) || n_name || '_' || c_mktsegment || chr(160)
       WHEN c_mktsegment = 'HOUSEHOLD' AND c_nationkey = 0 THEN chr(160)
       ELSE n_name || '_' || c_mktsegment END AS city,
  CAST(c_custkey AS VARCHAR) AS zipcode,
  r_name AS region,
  c_name AS author,
  'ad/' || CAST(o_orderkey AS VARCHAR) AS url,
  'img/' || CAST(o_orderkey AS VARCHAR) || '.jpg' AS image_url,
  o_orderdate AS created_at,
  o_orderkey * 2 + copy AS ordinal
FROM copies""", "copies")
cte("coords", """SELECT n_name || '_' || segment AS city,
  CAST(42.0 AS DOUBLE) + n_nationkey * CAST(0.35 AS DOUBLE) + k * CAST(0.1 AS DOUBLE) AS lat,
  CAST(-4.0 AS DOUBLE) + n_nationkey * CAST(0.45 AS DOUBLE) + k * CAST(0.2 AS DOUBLE) AS lng
FROM nation JOIN (VALUES (0, 'AUTOMOBILE'), (1, 'BUILDING'), (2, 'FURNITURE')) t(k, segment) ON true""")

# --------------------------------------------------------------------------
# Star schema
# --------------------------------------------------------------------------
cte("raw_p", """SELECT * REPLACE (
    CASE WHEN length(zipcode) < 5 THEN lpad(zipcode, 5, '0') ELSE zipcode END AS zipcode),
  CAST(year(created_at) AS INTEGER) AS year,
  CAST(month(created_at) AS INTEGER) AS month,
  CAST(day(created_at) AS INTEGER) AS day
FROM listings""", "listings")
cte("dim_type", """SELECT CAST(row_number() OVER (ORDER BY min(ordinal)) AS BIGINT) AS id_type,
  type AS type_name FROM raw_p GROUP BY type""", "raw_p")
cte("dim_location", """SELECT CAST(row_number() OVER (ORDER BY min(ordinal)) AS BIGINT) AS id_location,
  city, zipcode, region FROM raw_p GROUP BY city, zipcode, region""", "raw_p")
cte("dim_author", """SELECT DISTINCT author AS id_author FROM raw_p""", "raw_p")
cte("dim_date", """SELECT CAST(row_number() OVER (ORDER BY min(ordinal)) AS BIGINT) AS id_date,
  created_at, year, month, day FROM raw_p GROUP BY created_at, year, month, day""", "raw_p")
cte("ads", """SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rn FROM raw_p) WHERE rn = 1""",
    "raw_p")
cte("fact_ads", """SELECT a.id AS id_annonce, a.price, a.title, a.surface, a.price_m2, a.url,
  a.image_url, d.id_date, l.id_location, t.id_type, a.author AS id_author
FROM ads a
JOIN dim_type t ON a.type = t.type_name
JOIN dim_location l ON a.city IS NOT DISTINCT FROM l.city
  AND a.zipcode IS NOT DISTINCT FROM l.zipcode AND a.region IS NOT DISTINCT FROM l.region
JOIN dim_date d ON a.created_at = d.created_at""", "ads", "dim_type", "dim_location", "dim_date")

QUERIES: dict[str, str] = {}

QUERIES["city_mart"] = sql(f"""SELECT l.region, l.city,
  count(f.id_annonce) AS volume_annonces,
  {rnd_avg('f.price', 2)} AS prix_moyen,
  {rnd_avg('f.surface', 1)} AS surface_moyenne,
  round(avg(f.price_m2), 2) AS prix_m2_moyen,
  min(f.price) AS prix_minimum,
  max(f.price) AS prix_maximum
FROM fact_ads f JOIN dim_location l ON f.id_location = l.id_location
GROUP BY l.region, l.city
ORDER BY volume_annonces DESC, l.region, l.city""", "fact_ads")

QUERIES["region_type_mart"] = sql(f"""SELECT l.region, t.type_name,
  count(f.id_annonce) AS volume_annonces,
  {rnd_avg('f.price', 2)} AS prix_moyen,
  round(avg(f.price_m2), 2) AS prix_m2_moyen,
  {rnd_avg('f.surface', 1)} AS surface_moyenne
FROM fact_ads f JOIN dim_location l ON f.id_location = l.id_location
JOIN dim_type t ON f.id_type = t.id_type
GROUP BY l.region, t.type_name""", "fact_ads")

QUERIES["monthly_mart"] = sql(f"""SELECT d.year, d.month,
  count(f.id_annonce) AS volume_annonces,
  {rnd_avg('f.price', 2)} AS prix_moyen,
  round(avg(f.price_m2), 2) AS prix_m2_moyen
FROM fact_ads f JOIN dim_date d ON f.id_date = d.id_date
GROUP BY d.year, d.month""", "fact_ads")

# The Spark SQL views compute the same marts.
QUERIES["city_mart_sql"] = QUERIES["city_mart"]
QUERIES["region_type_mart_sql"] = QUERIES["region_type_mart"]
QUERIES["monthly_mart_sql"] = QUERIES["monthly_mart"]

QUERIES["dim_type"] = sql("SELECT * FROM dim_type", "dim_type")
QUERIES["dim_location"] = sql("SELECT * FROM dim_location", "dim_location")
QUERIES["dim_author"] = sql("SELECT * FROM dim_author", "dim_author")
QUERIES["dim_date"] = sql("SELECT * FROM dim_date", "dim_date")
QUERIES["fact_listings"] = sql("SELECT * FROM fact_ads", "fact_ads")

QUERIES["integrity_audit"] = sql("""
SELECT 'pk fact_ads.id_annonce' AS rule, CAST(coalesce(sum(c), 0) AS BIGINT) AS violations
  FROM (SELECT count(*) c FROM fact_ads GROUP BY id_annonce HAVING count(*) > 1)
UNION ALL SELECT 'pk dim_location.id_location', CAST(coalesce(sum(c), 0) AS BIGINT)
  FROM (SELECT count(*) c FROM dim_location GROUP BY id_location HAVING count(*) > 1)
UNION ALL SELECT 'pk dim_type.id_type', CAST(coalesce(sum(c), 0) AS BIGINT)
  FROM (SELECT count(*) c FROM dim_type GROUP BY id_type HAVING count(*) > 1)
UNION ALL SELECT 'unique dim_type.type_name', CAST(coalesce(sum(c), 0) AS BIGINT)
  FROM (SELECT count(*) c FROM dim_type GROUP BY type_name HAVING count(*) > 1)
UNION ALL SELECT 'pk dim_author.id_author', CAST(coalesce(sum(c), 0) AS BIGINT)
  FROM (SELECT count(*) c FROM dim_author GROUP BY id_author HAVING count(*) > 1)
UNION ALL SELECT 'pk dim_date.id_date', CAST(coalesce(sum(c), 0) AS BIGINT)
  FROM (SELECT count(*) c FROM dim_date GROUP BY id_date HAVING count(*) > 1)
UNION ALL SELECT 'not null fact_ads', CAST(
    count_if(price IS NULL) + count_if(title IS NULL) + count_if(id_date IS NULL)
  + count_if(id_location IS NULL) + count_if(id_type IS NULL) + count_if(id_author IS NULL)
  AS BIGINT) FROM fact_ads
UNION ALL SELECT 'not null dim_location.city', CAST(count_if(city IS NULL) AS BIGINT) FROM dim_location
UNION ALL SELECT 'not null dim_type.type_name', CAST(count_if(type_name IS NULL) AS BIGINT) FROM dim_type
UNION ALL SELECT 'not null dim_date', CAST(count_if(created_at IS NULL) + count_if(year IS NULL)
  + count_if(month IS NULL) + count_if(day IS NULL) AS BIGINT) FROM dim_date
UNION ALL SELECT 'fk fact_ads.id_date', CAST(count(*) AS BIGINT) FROM fact_ads f
  WHERE id_date IS NOT NULL AND id_date NOT IN
    (SELECT id_date FROM dim_date WHERE id_date IS NOT NULL)
UNION ALL SELECT 'fk fact_ads.id_location', CAST(count(*) AS BIGINT) FROM fact_ads f
  WHERE id_location IS NOT NULL AND id_location NOT IN
    (SELECT id_location FROM dim_location WHERE id_location IS NOT NULL)
UNION ALL SELECT 'fk fact_ads.id_type', CAST(count(*) AS BIGINT) FROM fact_ads f
  WHERE id_type IS NOT NULL AND id_type NOT IN
    (SELECT id_type FROM dim_type WHERE id_type IS NOT NULL)
UNION ALL SELECT 'fk fact_ads.id_author', CAST(count(*) AS BIGINT) FROM fact_ads f
  WHERE id_author IS NOT NULL AND id_author NOT IN
    (SELECT id_author FROM dim_author WHERE id_author IS NOT NULL)
""", "fact_ads", "dim_author")


# --------------------------------------------------------------------------
# Preparation: quality -> clean -> features
# --------------------------------------------------------------------------
# Every character that Unicode counts as white space, listed one by one.
BLANKS = " || ".join(f"chr({c})" for c in (
    *range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287,
    12288))


def strip_upper(x: str) -> str:
    return f"upper(trim({x}, {BLANKS}))"


def blank(x: str) -> str:
    return f"({x} IS NULL OR trim({x}, {BLANKS}) = '')"


def marked(x: str) -> str:
    """The text with a tilde for every white space character."""
    return f"translate({x}, {BLANKS}, repeat('~', 25))"


def num_from(x: str, pattern: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, '{pattern}', 1), '') AS DOUBLE)"


TYPE_FIX = """CASE WHEN type IS NULL OR upper(type) = 'AUTRE' THEN
    CASE WHEN regexp_matches(lower(title), 'terrain') THEN 'Terrain'
         WHEN regexp_matches(lower(title), 'parking|garage') THEN 'Parking'
         WHEN regexp_matches(lower(title), 'maison|villa') THEN 'Maison'
         WHEN regexp_matches(lower(title), 'appart') THEN 'Appartement'
         ELSE type END
  ELSE type END"""

cte("q_fill", f"""SELECT * REPLACE (
  coalesce(surface, {num_from(marked('title'), '(\\d+)~*m[²2]')}) AS surface,
  coalesce(pieces, {num_from(marked('title'), '(\\d+)~*pièce')}, {num_from('title', '[tT](\\d+)')}) AS pieces,
  {TYPE_FIX} AS type)
FROM listings""", "listings")
cte("q_ext", """SELECT * REPLACE (
  CASE WHEN surface = 0 THEN NULL ELSE price / surface END AS price_m2) FROM q_fill""", "q_fill")
QUALITY_PRED = {
    "price": "(price IS NOT NULL AND price > 0)",
    "surface": "(surface IS NOT NULL AND surface > 0)",
    "price_m2": "(price_m2 IS NOT NULL AND price_m2 < 50000)",
    "city": f"(NOT {blank('city')})",
    "type": f"(NOT {blank('type')})",
}
ALL_PASS = " AND ".join(QUALITY_PRED.values())
cte("quality", f"SELECT * FROM q_ext WHERE {ALL_PASS}", "q_ext")
cte("c_sel", """SELECT id AS id_annonce, price AS prix, surface, pieces, type AS type_bien,
  city AS ville, zipcode, region, author AS agence, ordinal FROM quality""", "quality")
cte("c_dedup", """SELECT * EXCLUDE (rn) FROM (SELECT *,
  row_number() OVER (PARTITION BY id_annonce ORDER BY ordinal) AS rn FROM c_sel) WHERE rn = 1""",
    "c_sel")
cte("c_norm", f"""SELECT id_annonce, prix, surface, pieces,
  {strip_upper('type_bien')} AS type_bien, {strip_upper('ville')} AS ville,
  zipcode, region, sha256(agence) AS agence FROM c_dedup""", "c_dedup")
cte("c_means", f"""SELECT {mean('prix')} AS m_prix, {mean('surface')} AS m_surface,
  {mean('pieces')} AS m_pieces FROM c_norm""", "c_norm")
cte("clean", """SELECT id_annonce, coalesce(prix, m_prix) AS prix,
  coalesce(surface, m_surface) AS surface, coalesce(pieces, m_pieces) AS pieces,
  type_bien, ville, zipcode, region, agence FROM c_norm, c_means""", "c_norm", "c_means")
cte("f_bounds", """SELECT quantile_cont(prix, 0.01) AS lo, quantile_cont(prix, 0.99) AS hi
FROM clean WHERE prix IS NOT NULL""", "clean")
cte("f_trim", """SELECT c.* FROM clean c, f_bounds
WHERE c.prix IS NOT NULL AND c.prix BETWEEN lo AND hi""", "clean", "f_bounds")
cte("f_gm", f"SELECT {mean('prix')} AS gm FROM f_trim", "f_trim")
cte("encoding", f"""SELECT ville,
  ({exact_sum('prix')} + 20 * any_value(gm))
    / (count(prix) + 20) AS encoding
FROM f_trim, f_gm WHERE ville IS NOT NULL GROUP BY ville""", "f_trim", "f_gm")
TYPE_VOCAB = ["APPARTEMENT", "AUTRE", "LOFT", "MAISON", "PARKING", "TERRAIN"]
ONE_HOT = ",\n  ".join(f"coalesce(type_bien = '{v}', false) AS type_bien_{v}" for v in TYPE_VOCAB)
cte("features", f"""SELECT t.id_annonce, t.prix, t.surface, t.pieces, e.encoding AS ville,
  ln(1 + t.prix) AS prix_log, ln(1 + t.surface) AS surface_log,
  {ONE_HOT}
FROM f_trim t LEFT JOIN encoding e ON t.ville = e.ville""", "f_trim", "encoding")
cte("market", """SELECT f.*, a.region, a.city FROM features f
LEFT JOIN ads a ON f.id_annonce = a.id""", "features", "ads")

QUERIES["title_extraction"] = sql(
    "SELECT id, ordinal, type, surface, pieces, price_m2 FROM q_ext", "q_ext")
QUERIES["quality_filter"] = sql("SELECT * FROM quality", "quality")
QUERIES["quality_rule_counts"] = sql(f"""SELECT CAST(count(*) AS BIGINT) AS rows_in,
  {", ".join(f"CAST(count_if(NOT {p}) AS BIGINT) AS {k}_rejected" for k, p in QUALITY_PRED.items())},
  CAST(count_if({ALL_PASS}) AS BIGINT) AS rows_out
FROM q_ext""", "q_ext")
QUERIES["rejected_rows"] = sql(f"""SELECT id, ordinal,
  CASE {" ".join(f"WHEN NOT {p} THEN '{k}'" for k, p in QUALITY_PRED.items())} END AS failed_rule
FROM q_ext WHERE NOT ({ALL_PASS})""", "q_ext")
QUERIES["numeric_clean"] = sql("""SELECT id, ordinal, prix_txt, surface_txt, pieces_txt,
  TRY_CAST(nullif(regexp_replace(replace(replace(replace(replace(lower(prix_txt), 'm2', ''),
    'm²', ''), '€', ''), ',', '.'), '[^0-9.]', '', 'g'), '') AS DOUBLE) AS prix,
  TRY_CAST(nullif(regexp_replace(replace(replace(replace(replace(lower(surface_txt), 'm2', ''),
    'm²', ''), '€', ''), ',', '.'), '[^0-9.]', '', 'g'), '') AS DOUBLE) AS surface,
  TRY_CAST(nullif(regexp_replace(replace(replace(replace(replace(lower(pieces_txt), 'm2', ''),
    'm²', ''), '€', ''), ',', '.'), '[^0-9.]', '', 'g'), '') AS DOUBLE) AS pieces
FROM (SELECT id, ordinal,
  replace(replace(format('{:,.2f}', price), ',', ' '), '.', ',') || chr(160) || '€' AS prix_txt,
  CAST(CAST(trunc(surface) AS BIGINT) AS VARCHAR) || ',5 m2' AS surface_txt,
  ' ' || CAST(CAST(trunc(pieces) AS BIGINT) AS VARCHAR) || ' pièces' AS pieces_txt
  FROM listings)""", "listings")
QUERIES["text_normalise"] = sql(f"""SELECT id, ordinal, {strip_upper('city')} AS ville,
  {strip_upper('type')} AS type_bien FROM listings""", "listings")
QUERIES["contact_hash"] = sql(
    "SELECT id, ordinal, sha256(author) AS agence FROM listings", "listings")
QUERIES["dedupe_first"] = sql("""SELECT * EXCLUDE (rn) FROM (SELECT *,
  row_number() OVER (PARTITION BY id ORDER BY ordinal) AS rn FROM listings) WHERE rn = 1""",
                              "listings")
QUERIES["mean_impute"] = sql(f"""SELECT id, ordinal, coalesce(price, mp) AS price,
  coalesce(surface, ms) AS surface, coalesce(pieces, mq) AS pieces
FROM listings, (SELECT {mean('price')} AS mp, {mean('surface')} AS ms,
  {mean('pieces')} AS mq FROM listings)""", "listings")
QUERIES["clean_listings"] = sql("SELECT * FROM clean", "clean")
QUERIES["outlier_trim"] = sql("SELECT * FROM f_trim", "f_trim")
QUERIES["target_encoding"] = sql("SELECT * FROM encoding", "encoding")
QUERIES["target_encode_apply"] = sql(f"""SELECT l.id, l.ordinal,
  coalesce(e.encoding, (SELECT {mean('encoding')} FROM encoding)) AS ville
FROM listings l LEFT JOIN encoding e ON {strip_upper('l.city')} = e.ville""",
                                     "listings", "encoding")
QUERIES["one_hot"] = sql(
    f"SELECT id_annonce, {', '.join('type_bien_' + v for v in TYPE_VOCAB)} FROM features",
    "features")
QUERIES["features_table"] = sql(f"""SELECT * REPLACE (round(prix_log, 8) AS prix_log,
  round(surface_log, 8) AS surface_log) FROM features""", "features")
QUERIES["log_features"] = sql("""SELECT id_annonce, round(prix_log, 8) AS prix_log,
  round(surface_log, 8) AS surface_log FROM features""", "features")


# --------------------------------------------------------------------------
# Market panels
# --------------------------------------------------------------------------
def pctl(v: str, n: str, q: float) -> str:
    """Spark's exact percentile on a sorted list ``v`` of ``n`` values:
    ``(hi - pos) * v[lo] + (pos - lo) * v[hi]`` at ``pos = (n - 1) * q``."""
    pos = f"(({n} - 1) * CAST({q!r} AS DOUBLE))"
    lo, hi = f"CAST(floor({pos}) AS BIGINT)", f"CAST(ceil({pos}) AS BIGINT)"
    lv, hv = f"{v}[{lo} + 1]", f"{v}[{hi} + 1]"
    return (f"(CASE WHEN {n} = 0 THEN NULL WHEN {lo} = {hi} OR {lv} = {hv} THEN {lv} "
            f"ELSE ({hi} - {pos}) * {lv} + ({pos} - {lo}) * {hv} END)")


def sorted_list(x: str) -> str:
    return f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL))"


def median_of(x: str, rel: str, where: str = "true") -> str:
    return (f"(SELECT {pctl('v', 'n', 0.5)} FROM (SELECT {sorted_list(x)} AS v, count({x}) AS n "
            f"FROM {rel} WHERE {where}))")


TYPE_FLAGS = {"Appartement": "type_bien_APPARTEMENT", "Maison": "type_bien_MAISON",
              "Terrain": "type_bien_TERRAIN", "Autre": "type_bien_AUTRE",
              "Parking": "type_bien_PARKING"}


def kpis(where: str) -> str:
    return sql(f"""SELECT {trunc_long(pctl('v', 'n', 0.5))} AS median_price,
  {trunc_long('mean')} AS mean_price,
  CASE WHEN npos > 0 THEN {trunc_long(pctl('v2', 'n2', 0.5))} END AS prix_m2,
  ads_count
FROM (SELECT {sorted_list('prix')} AS v, count(prix) AS n,
  {sorted_list('prix / surface')} AS v2, count(prix / surface) AS n2,
  count_if(surface > 0) AS npos, count(*) AS ads_count, {mean('prix')} AS mean
  FROM market WHERE {where})""", "market")


QUERIES["dashboard_kpis"] = kpis("true")
DASHBOARD_WHERE = "type_bien_MAISON AND region = 'EUROPE'"
ANALYSIS_WHERE = ("type_bien_APPARTEMENT AND surface >= 50.0 AND surface <= 150.0 "
                  "AND pieces >= 3 AND pieces <= 4")
ZONE_WHERE = "city = 'NATION_1_BUILDING'"
ROOMS_WHERE = "type_bien_MAISON AND pieces >= 3 AND pieces <= 4"
QUERIES["dashboard_kpis_filtered"] = kpis(DASHBOARD_WHERE)


def per_type(types: list[str], measures: str, where: str = "true") -> str:
    parts = [f"SELECT '{t}' AS type, {i} AS type_order, {measures} FROM market "
             f"WHERE {TYPE_FLAGS[t]} AND {where} HAVING count(*) > 0" for i, t in enumerate(types)]
    return "\nUNION ALL ".join(parts)


def active_sql(where: str) -> str:
    return sql(f"""SELECT type, type_order, count, mean_price, CAST(NULL AS BIGINT) AS confidence,
  CAST(count AS VARCHAR) || ' annonces' AS label
FROM ({per_type(['Appartement', 'Maison', 'Terrain'],
                f"count(*) AS count, {trunc_long(mean('prix'))} AS mean_price", where)})""", "market")


def cards_sql(where: str) -> str:
    return sql(f"""SELECT t.type, t.type_order, coalesce(a.count, 0) AS count, a.median_price
FROM (VALUES ('Appartement', 0), ('Maison', 1)) t(type, type_order)
LEFT JOIN (SELECT type, count, {trunc_long(pctl('v', 'n', 0.5))} AS median_price FROM (
  {per_type(['Appartement', 'Maison'],
            f"count(*) AS count, {sorted_list('prix')} AS v, count(prix) AS n", where)})) a
ON t.type = a.type""", "market")


QUERIES["active_markets"] = active_sql("true")
QUERIES["active_markets_filtered"] = active_sql(DASHBOARD_WHERE)
QUERIES["type_cards"] = cards_sql("true")
QUERIES["type_cards_filtered"] = cards_sql(DASHBOARD_WHERE)


def histogram(legacy: bool, where: str = "true") -> str:
    edge = ("AND prix < ((pmax + step) + step - 1) // step * step - step" if legacy else "")
    return sql(f"""SELECT CAST(lo // 1000 AS VARCHAR) || '-' || CAST((lo + step) // 1000 AS VARCHAR)
  || 'k€' AS bracket, count(*) AS count
FROM (SELECT CAST(floor(prix / step) * step AS BIGINT) AS lo, step FROM (SELECT * FROM market WHERE {where}), (
  SELECT pmax, greatest(50000, {trunc_long('(pmax - pmin) / 8 / 50000')} * 50000) AS step
  FROM (SELECT {trunc_long('min(prix)')} AS pmin, {trunc_long('max(prix)')} AS pmax FROM market
    WHERE {where}))
  WHERE prix IS NOT NULL {edge})
GROUP BY lo, step""", "market")


QUERIES["price_histogram"] = histogram(False)
QUERIES["price_histogram_legacy"] = histogram(True)
QUERIES["price_histogram_filtered"] = histogram(False, DASHBOARD_WHERE)


def stats_sql(where: str) -> str:
    return sql(f"""SELECT cnt AS count, {trunc_long(pctl('v', 'n', 0.5))} AS median,
  {trunc_long('mean')} AS mean, {trunc_long('mn')} AS min, {trunc_long('mx')} AS max
FROM (SELECT {sorted_list('prix')} AS v, count(prix) AS n, {mean('prix')} AS mean,
  min(prix) AS mn, max(prix) AS mx, count(*) AS cnt FROM market WHERE {where})""", "market")


QUERIES["analysis_stats"] = stats_sql("true")
QUERIES["analysis_filtered"] = stats_sql(ANALYSIS_WHERE)
QUERIES["analysis_zone"] = stats_sql(ZONE_WHERE)
QUERIES["analysis_rooms"] = stats_sql(ROOMS_WHERE)


def type_stats_sql(where: str) -> str:
    return sql(f"""SELECT type, type_order, count,
  {trunc_long(pctl('v', 'n', 0.5))} AS median, prix_min, prix_max,
  {trunc_long(pctl('v2', 'n2', 0.5))} AS prix_m2
FROM ({per_type(['Appartement', 'Maison', 'Terrain', 'Autre', 'Parking'],
                f"count(*) AS count, {sorted_list('prix')} AS v, count(prix) AS n, "
                f"{trunc_long('min(prix)')} AS prix_min, {trunc_long('max(prix)')} AS prix_max, "
                f"{sorted_list('prix / surface')} AS v2, count(prix / surface) AS n2", where)})""",
               "market")


QUERIES["analysis_type_stats"] = type_stats_sql("true")
QUERIES["analysis_type_stats_filtered"] = type_stats_sql(ANALYSIS_WHERE)
QUERIES["analysis_type_stats_zone"] = type_stats_sql(ZONE_WHERE)

for _name, _where in (("quart", "true"), ("quart_filtered", ANALYSIS_WHERE),
                      ("quart_zone", ZONE_WHERE)):
    cte(_name, f"""SELECT n, {trunc_long(pctl('v', 'c', 0.25))} AS q25,
  {trunc_long(pctl('v', 'c', 0.5))} AS q50, {trunc_long(pctl('v', 'c', 0.75))} AS q75
FROM (SELECT {sorted_list('prix')} AS v, count(prix) AS c, count(*) AS n FROM market
  WHERE {_where})""", "market")


def spaced(x: str) -> str:
    return f"replace(format('{{:,}}', {x}), ',', ' ')"


def quartiles_sql(rel: str) -> str:
    return sql(f"""SELECT bracket_order, lo, hi, bracket, pct FROM (
  SELECT 1 AS bracket_order, CAST(NULL AS BIGINT) AS lo, q25 AS hi,
    '< ' || {spaced('q25')} || '€' AS bracket, 25 AS pct, n FROM {rel}
  UNION ALL SELECT 2, q25, q50, {spaced('q25')} || '–' || {spaced('q50')} || '€', 25, n FROM {rel}
  UNION ALL SELECT 3, q50, q75, {spaced('q50')} || '–' || {spaced('q75')} || '€', 25, n FROM {rel}
  UNION ALL SELECT 4, q75, CAST(NULL AS BIGINT), '> ' || {spaced('q75')} || '€', 25, n FROM {rel})
WHERE n > 10""", rel)


QUERIES["analysis_quartiles"] = quartiles_sql("quart")
QUERIES["analysis_quartiles_filtered"] = quartiles_sql("quart_filtered")
QUERIES["analysis_quartiles_zone"] = quartiles_sql("quart_zone")

QUERIES["room_buckets"] = sql("""SELECT CASE WHEN pieces <= 2 THEN '1-2 pièces'
  WHEN pieces >= 3 AND pieces <= 4 THEN '3-4 pièces'
  WHEN pieces >= 5 AND pieces <= 6 THEN '5-6 pièces'
  WHEN pieces >= 7 THEN '7+ pièces' END AS bucket, count(*) AS count
FROM market GROUP BY 1""", "market")


def top_cities(type_filter: str) -> str:
    return sql(f"""SELECT city, {trunc_long('mean')} AS price, count FROM (
  SELECT city, avg(price / surface) AS mean, count(*) AS count FROM listings
  WHERE city IS NOT NULL AND price IS NOT NULL AND surface > 0 {type_filter}
  GROUP BY city HAVING count(*) >= 3 ORDER BY mean DESC, city LIMIT 10)""", "listings")


QUERIES["top_cities_m2"] = top_cities("")
QUERIES["top_cities_m2_type"] = top_cities("AND type = 'Maison'")

cte("freq", """SELECT city, count(*) AS count, arg_min(zipcode, ordinal) AS zipcode
FROM listings WHERE city IS NOT NULL GROUP BY city ORDER BY count DESC, city LIMIT 30""",
    "listings")
QUERIES["city_frequency"] = sql("SELECT city, count FROM freq", "freq")
QUERIES["city_labels"] = sql(
    "SELECT city, count, concat_ws(', ', city, zipcode) AS label FROM freq", "freq")
PROPERTY_TYPES = ["Tous", "Appartement", "Maison", "Terrain", "Autre", "Parking"]
ROOM_OPTIONS = ["Toutes pièces", "1-2 pièces", "3-4 pièces", "5-6 pièces", "7+ pièces"]
_fixed = ([("regions", 1, "France entière"), ("cities", 1, "Toutes villes")]
          + [("property_types", i + 1, t) for i, t in enumerate(PROPERTY_TYPES)]
          + [("rooms", i + 1, r) for i, r in enumerate(ROOM_OPTIONS)])
_fixed_sql = ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in _fixed)
QUERIES["option_lists"] = sql(f"""SELECT list, CAST(position AS INTEGER) AS position, value FROM (
  SELECT * FROM (VALUES {_fixed_sql}) t(list, position, value)
  UNION ALL SELECT 'regions', row_number() OVER (ORDER BY region) + 1, region
    FROM (SELECT DISTINCT region FROM listings WHERE region IS NOT NULL)
  UNION ALL SELECT 'cities', row_number() OVER (ORDER BY count DESC, city) + 1, city FROM freq)""",
                              "listings", "freq")

QUERIES["city_map"] = sql(f"""SELECT CAST(id AS BIGINT) AS id, lat, lng,
  CASE WHEN pm2 > 0 THEN pm2 ELSE avg_i END AS weight, pm2 AS price_m2, city,
  replace(format('{{:,}}', CASE WHEN pm2 > 0 THEN pm2 ELSE avg_i END), ',', ' ') AS price,
  CAST(count AS VARCHAR) || ' annonces' AS trend,
  CASE WHEN pm2 <= t1 THEN 'cheap' WHEN pm2 <= t2 THEN 'mid' ELSE 'expensive' END AS tier,
  count, count >= 15 AS active
FROM (SELECT *, coalesce({trunc_long('m2')}, 0) AS pm2, {trunc_long('avg_price')} AS avg_i,
        row_number() OVER (ORDER BY count DESC, city) AS id FROM (
  SELECT city, {mean('price')} AS avg_price, count(*) AS count,
    avg(CASE WHEN surface > 0 THEN price / surface END) AS m2
  FROM listings WHERE city IS NOT NULL AND price IS NOT NULL
  GROUP BY city ORDER BY count DESC, city LIMIT 30)) top
JOIN coords USING (city)
CROSS JOIN (SELECT CASE WHEN n > 0 THEN v[n // 3 + 1] ELSE 3000 END AS t1,
  CASE WHEN n > 0 THEN v[2 * n // 3 + 1] ELSE 5000 END AS t2
  FROM (SELECT list_sort(list({trunc_long('m2')}) FILTER (WHERE m2 IS NOT NULL)) AS v,
    count(m2) AS n FROM (
    SELECT avg(CASE WHEN surface > 0 THEN price / surface END) AS m2
    FROM listings WHERE city IS NOT NULL AND price IS NOT NULL
    GROUP BY city ORDER BY count(*) DESC, city LIMIT 30)))""", "listings", "coords")

cte("alert_rows", """SELECT city, price / surface AS prix_m2 FROM listings
WHERE city IS NOT NULL AND price IS NOT NULL AND surface > 0""", "listings")
QUERIES["market_alerts"] = sql(f"""SELECT city AS zone, {trunc_long('mean')} AS current_price,
  count, round((mean - gm) / gm * 100, 1) AS vs_median_pct,
  round((mean - gm) / gm * 100, 1) > 0 AS above_median
FROM (SELECT city, avg(prix_m2) AS mean, count(*) AS count FROM alert_rows GROUP BY city
  HAVING count(*) >= 5 ORDER BY count DESC, city LIMIT 5),
  (SELECT {median_of('prix_m2', 'alert_rows')} AS gm)""", "alert_rows")

QUERIES["run_counts"] = sql(f"""SELECT raw_count, clean_count,
  greatest(raw_count - clean_count, 0) AS dropped,
  {trunc_long('clean_count * CAST(0.8 AS DOUBLE)')} AS train,
  {trunc_long('clean_count * CAST(0.2 AS DOUBLE)')} AS test
FROM (SELECT (SELECT count(*) FROM listings) AS raw_count,
  (SELECT count(*) FROM features) AS clean_count)""", "listings", "features")

QUERIES["stage_audit"] = sql("""SELECT stage_order, stage,
  coalesce(lag(rows_out) OVER (ORDER BY stage_order), rows_out) AS rows_in, rows_out,
  coalesce(lag(rows_out) OVER (ORDER BY stage_order), rows_out) - rows_out AS dropped
FROM (SELECT 0 AS stage_order, 'ingest' AS stage, (SELECT count(*) FROM listings) AS rows_out
  UNION ALL SELECT 1, 'quality', (SELECT count(*) FROM quality)
  UNION ALL SELECT 2, 'clean', (SELECT count(*) FROM clean)
  UNION ALL SELECT 3, 'features', (SELECT count(*) FROM features))""",
                             "listings", "quality", "clean", "features")

QUERIES["input_ranges"] = sql(f"""SELECT {trunc_long(pctl('vs', 'ns', 0.01))} AS surface_min,
  {trunc_long(pctl('vs', 'ns', 0.99))} AS surface_max, CAST(1 AS BIGINT) AS pieces_min,
  {trunc_long(pctl('vp', 'np', 0.99))} AS pieces_max
FROM (SELECT {sorted_list('surface')} AS vs, count(surface) AS ns,
  {sorted_list('pieces')} AS vp, count(pieces) AS np FROM features)""", "features")

QUERIES["enrich_by_id"] = sql("SELECT id_annonce, region, city FROM market", "market")

cte("med", f"SELECT {median_of('prix', 'features')} AS med", "features")
QUERIES["median_label"] = sql(
    "SELECT id_annonce, prix, CAST(prix > med AS INTEGER) AS label FROM features, med",
    "features", "med")

QUERIES["regression_metrics"] = sql("""SELECT round(avg(abs(prix - ville)), 2) AS mae,
  round(sqrt(avg((prix - ville) * (prix - ville))), 2) AS rmse,
  round(1.0 - sum((prix - ville) * (prix - ville)) / sum((prix - my) * (prix - my)), 4) AS r2
FROM features, (SELECT avg(prix) AS my FROM features)""", "features")

cte("conf", """SELECT CAST(y AS DOUBLE) AS y, CAST(p AS DOUBLE) AS p, count(*) AS n FROM (
  SELECT CAST(prix > med AS INTEGER) AS y, CAST(ville > med AS INTEGER) AS p FROM features, med)
GROUP BY ALL""", "features", "med")
QUERIES["classification_metrics"] = sql("""SELECT round(sum(tp) / sum(support), 4) AS accuracy,
  round(sum(f1 * support) / sum(support), 4) AS f1
FROM (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1
  FROM (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec,
      CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec
    FROM (SELECT coalesce(s.c, p.c) AS c, coalesce(s.support, 0) AS support,
        coalesce(p.predicted, 0) AS predicted, coalesce(t.tp, 0) AS tp
      FROM (SELECT y AS c, sum(n) AS support FROM conf GROUP BY y) s
      FULL JOIN (SELECT p AS c, sum(n) AS predicted FROM conf GROUP BY p) p ON s.c = p.c
      LEFT JOIN (SELECT y AS c, n AS tp FROM conf WHERE y = p) t ON coalesce(s.c, p.c) = t.c)))""", "conf")

ANNUAL_RATE = 0.035
_h = [("6 mois", 1 + ANNUAL_RATE / 2, f"+{ANNUAL_RATE / 2 * 100:.1f}%"),
      ("1 an", 1 + ANNUAL_RATE, f"+{ANNUAL_RATE * 100:.1f}%"),
      ("2 ans", (1 + ANNUAL_RATE) ** 2, f"+{((1 + ANNUAL_RATE) ** 2 - 1) * 100:.1f}%")]
_proj = [f"SELECT id_annonce, 'Auj.' AS period, {trunc_long('prix')} AS price, "
         f"CAST(NULL AS VARCHAR) AS pct FROM clean"]
_proj += [f"SELECT id_annonce, '{n}', {trunc_long(f'prix * CAST({f!r} AS DOUBLE)')}, '{lab}' "
          f"FROM clean" for n, f, lab in _h]
QUERIES["projections"] = sql("\nUNION ALL ".join(_proj), "clean")

# --------------------------------------------------------------------------
# What is fixed around the models
# --------------------------------------------------------------------------
QUERIES["scoring_options"] = sql(f"""SELECT list, CAST(position AS INTEGER) AS position, value FROM (
  SELECT * FROM (VALUES {", ".join(f"('types', {i + 1}, '{t}')"
                                   for i, t in enumerate(PROPERTY_TYPES[1:]))}) t(list, position, value)
  UNION ALL SELECT 'cities', row_number() OVER (ORDER BY count DESC, city),
    concat_ws(', ', city, zipcode) FROM freq
  UNION ALL SELECT 'ranges', p, c || '=' || CAST(v AS VARCHAR) FROM (
    SELECT unnest([1, 2, 3, 4]) AS p,
      unnest(['surface_min', 'surface_max', 'pieces_min', 'pieces_max']) AS c,
      unnest([surface_min, surface_max, pieces_min, pieces_max]) AS v
    FROM ({QUERIES["input_ranges"]})))""", "freq")

cte("requests", """SELECT id, ordinal, concat_ws(', ', city, zipcode) AS city,
  type AS property_type, surface AS surface_area,
  CAST(trunc(coalesce(pieces, 0)) AS INTEGER) AS rooms FROM q_ext""", "q_ext")
cte("limits", QUERIES["input_ranges"])
_city = strip_upper("split_part(r.city, ',', 1)")
_rooms = "CAST(least(greatest(r.rooms, l.pieces_min), l.pieces_max) AS INTEGER)"
_surface = ("(CASE WHEN r.surface_area IS NULL THEN CAST(l.surface_min AS DOUBLE) "
            "ELSE least(greatest(r.surface_area, l.surface_min), l.surface_max) END)")
_type_flags = ", ".join(f"coalesce({strip_upper('r.property_type')} = '{v}', false) AS type_bien_{v}"
                        for v in TYPE_VOCAB)
QUERIES["request_features"] = sql(f"""SELECT r.id, r.ordinal,
  coalesce(e.encoding, (SELECT {mean('encoding')} FROM encoding)) AS ville,
  {_surface} AS surface,
  CAST(CASE WHEN {_rooms} > 0 THEN {_rooms} ELSE 1 END AS DOUBLE) AS pieces,
  round(ln(1 + {_surface}), 8) AS surface_log, {_type_flags}
FROM requests r CROSS JOIN limits l LEFT JOIN encoding e ON {_city} = e.ville""",
                                  "requests", "limits", "encoding")

QUERIES["train_test_split"] = sql("""SELECT id_annonce,
  CAST('0x' || substr(md5('42:' || CAST(id_annonce AS VARCHAR)), 1, 8) AS BIGINT) % 5 = 0 AS test
FROM features""", "features")

_centres = [(40.0, 2.0), (90.0, 3.0), (150.0, 4.0), (220.0, 6.0)]
QUERIES["nearest_centres"] = sql(f"""SELECT id_annonce,
  CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS cluster
FROM (SELECT id_annonce, [{", ".join(f"(surface - {a}) * (surface - {a}) + (pieces - {b}) * (pieces - {b})"
                                     for a, b in _centres)}] AS d FROM features)""", "features")

_labels = {"surface": "Surface (m²)", "type_bien_APPARTEMENT": "Appartement",
           "type_bien_MAISON": "Maison", "type_bien_TERRAIN": "Terrain",
           "type_bien_AUTRE": "Autre", "type_bien_PARKING": "Parking"}
_weights = [("surface", "count(*)")] + [(f"type_bien_{v}", f"count_if(type_bien_{v})")
                                        for v in TYPE_VOCAB]
QUERIES["importance_shares"] = sql(f"""SELECT feature, name, round(share, 1) AS pct FROM (
  SELECT feature, name, CAST(w AS DOUBLE) / CAST(sum(w) OVER () AS DOUBLE) * 100.0 AS share FROM (
  {" UNION ALL ".join(f"SELECT '{f}' AS feature, '{_labels.get(f, f)}' AS name, {w} AS w FROM features"
                      for f, w in _weights)})) WHERE share > 0.5""", "features")

_p = f"coalesce(e.encoding, (SELECT {mean('encoding')} FROM encoding))"
QUERIES["score_figures"] = sql(f"""SELECT ordinal, {trunc_long('p')} AS current_estimated_price,
  CASE WHEN surface_area <> 0 THEN {trunc_long('p / surface_area')} END AS price_per_sqm,
  CAST(75.0 AS DOUBLE) AS confidence,
  {", ".join(f"{trunc_long(f'p * CAST({f!r} AS DOUBLE)')} AS price_{i + 1}"
             for i, (_, f, _) in enumerate(_h))}
FROM (SELECT r.ordinal, r.surface_area, {_p} AS p
  FROM requests r LEFT JOIN encoding e ON {_city} = e.ville)""", "requests", "encoding")

# other keys and stored parts give the same figures
QUERIES["integrity_audit_hash_keys"] = QUERIES["integrity_audit"]
QUERIES["city_mart_hash_keys"] = QUERIES["city_mart"]
QUERIES["region_type_mart_parts"] = QUERIES["region_type_mart"]

# --------------------------------------------------------------------------
# The first tree of second-order boosting: cuts at the eighths of every feature,
# the split of the greatest gain at three nodes, four shrunk leaves
# --------------------------------------------------------------------------
_boosted = sorted(["surface", "pieces", "ville", "surface_log",
                   *[f"type_bien_{v}" for v in TYPE_VOCAB]])
cte("tree_rows", f"""SELECT f.id_annonce, m.base - f.prix AS g,
  [{", ".join(f"CAST({c} AS DOUBLE)" for c in _boosted)}] AS v
FROM features f, (SELECT {mean('prix')} AS base FROM features) m""", "features")
cte("tree_cuts", "\nUNION ALL ".join(
    f"SELECT {i + 1} AS feature, unnest(list_distinct([{', '.join(pctl('v', 'n', k / 8) for k in range(1, 8))}])) AS cut "
    f"FROM (SELECT {sorted_list(f'CAST({c} AS DOUBLE)')} AS v, count({c}) AS n FROM features)"
    for i, c in enumerate(_boosted)), "features")


def _level(rows: str) -> str:
    """The best split of each node of ``rows`` (node, g, v)."""
    g = exact_sum("g")
    gain = ("gl * gl / (nl + 1.0) + (gt - gl) * (gt - gl) / (nt - nl + 1.0) - gt * gt / (nt + 1.0)")
    return f"""SELECT node, feature, cut FROM (
  SELECT node, feature, cut, row_number() OVER (PARTITION BY node ORDER BY {gain} DESC, feature, cut) AS r
  FROM (SELECT r.node, c.feature, c.cut, t.gt, t.nt, count(*) AS nl, {g} AS gl
    FROM {rows} r JOIN tree_cuts c ON r.v[c.feature] <= c.cut
    JOIN (SELECT node, {g} AS gt, count(*) AS nt FROM {rows} GROUP BY node) t ON t.node = r.node
    GROUP BY r.node, c.feature, c.cut, t.gt, t.nt)
  WHERE nl < nt AND {gain} > 0) WHERE r = 1"""


cte("tree_0", "SELECT 0 AS node, g, v FROM tree_rows", "tree_rows")
cte("split_0", _level("tree_0"), "tree_0", "tree_cuts")
cte("tree_1", """SELECT 2 * r.node + CASE WHEN r.v[s.feature] <= s.cut THEN 1 ELSE 2 END AS node, g, v
FROM tree_0 r JOIN split_0 s ON r.node = s.node""", "tree_0", "split_0")
cte("split_1", _level("tree_1"), "tree_1", "tree_cuts")
cte("tree_2", """SELECT 2 * r.node + CASE WHEN r.v[s.feature] <= s.cut THEN 1 ELSE 2 END AS node, g
FROM tree_1 r JOIN split_1 s ON r.node = s.node
UNION ALL SELECT r.node, g FROM tree_1 r ANTI JOIN split_1 s ON r.node = s.node""", "tree_1", "split_1")
QUERIES["boosted_first_tree"] = sql(f"""SELECT CAST(node AS INTEGER) AS node,
  [{", ".join(f"'{c}'" for c in _boosted)}][feature] AS feature, round(cut, 6) AS cut,
  CAST(NULL AS DOUBLE) AS value
FROM (SELECT * FROM split_0 UNION ALL SELECT * FROM split_1)
UNION ALL SELECT CAST(node AS INTEGER), NULL, NULL,
  round(CAST(-0.1 AS DOUBLE) * {exact_sum('g')} / (count(*) + CAST(1.0 AS DOUBLE)), 2) FROM tree_2 GROUP BY node""",
                                    "split_0", "split_1", "tree_2")
