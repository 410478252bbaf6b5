"""All named queries over the driver's tables, with their SQL.

The tables have no music in them; each query applies an operator to columns of the same
depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavework.functions import arrays, names, recipe, scale
from stavework.operators import manifest, profile, ratings, rules, samples, sampling, selection, sequences, tables, verification, votes
from stavework.plans.registry import named
from stavework.sources.tables import fields, table

# ---- profiles


@named("""
SELECT count(*) AS n, avg((v <= 20000)::INT::DOUBLE) AS share_0, avg((v <= 60000)::INT::DOUBLE) AS share_1,
  count(*) FILTER (v > 20000) AS above_0, count(*) FILTER (v > 60000) AS above_1,
  quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.95) AS p95,
  quantile_cont(v, 0.99) AS p99, quantile_cont(v, 0.999) AS p99_9
FROM (SELECT least(l_extendedprice, 90000.0) AS v FROM lineitem WHERE l_extendedprice IS NOT NULL)
""")
def length_profile(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return profile.length_profile(lines, profile.as_number(F.col("l_extendedprice"), 90000.0), (20000.0, 60000.0))


@named("""
SELECT d.doc_id, d.source, d.n_chars FROM documents d SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) l ON d.doc_id = l.doc_id
""")
def subset_filter_labels(spark: SparkSession, d: str) -> DataFrame:
    flagged = table(spark, d, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "source", "n_chars").join(flagged, "doc_id", "left_semi")


@named("""
SELECT family, n, 100.0 * n / sum(n) OVER () AS share FROM (
  SELECT CASE WHEN p_type = 'PROMO' THEN 'drums' WHEN p_size BETWEEN 0 AND 127 THEN list_extract(
    ['piano','chromatic','organ','guitar','bass','strings','ensemble','brass','reed','pipe','lead','pad','effects','ethnic','percussive','sounds'],
    (p_size // 8 + 1)::INT) ELSE 'sounds' END AS family, count(*) AS n FROM part GROUP BY 1)
""")
def usage_frequency_share(spark: SparkSession, d: str) -> DataFrame:
    family = rules.program_class(F.col("p_size"), F.col("p_type") == "PROMO")
    out = profile.frequency_share(table(spark, d, "part").select(family.alias("family")), "family")
    return out.select("family", "n", F.col("share").cast("double").alias("share"))


@named("""
WITH songs AS (SELECT l_orderkey, max(l_extendedprice) AS longest, min(l_returnflag || l_linestatus) AS label FROM lineitem GROUP BY 1)
SELECT label, count(*) AS n, quantile_cont(longest, 0.5) AS median, max(longest) AS longest FROM songs GROUP BY 1 ORDER BY n DESC, label LIMIT 4
""")
def breakdown_two_level_topn(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("label", F.concat("l_returnflag", "l_linestatus"))
    return profile.two_level_breakdown(lines, "l_orderkey", "l_extendedprice", "label", 4)


@named("""
SELECT p_size, p_brand, grouping(p_size, p_brand)::INT AS level, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_size), (p_brand), ())
""")
def conditional_aggregates(spark: SparkSession, d: str) -> DataFrame:
    out = profile.register_report(table(spark, d, "part"), "p_size", "p_brand")
    return out.select("p_size", "p_brand", F.col("level").cast("int").alias("level"), "n")


@named("""
WITH b AS (SELECT CASE WHEN s >= 80 THEN 4 WHEN s >= 60 THEN 3 WHEN s >= 40 THEN 2 WHEN s >= 20 THEN 1 ELSE 0 END AS band
  FROM (SELECT least(greatest(round_even(l_quantity * 1.5, 0), 0), 100) AS s FROM lineitem WHERE l_quantity > 20)),
c AS (SELECT band, count(*) AS n FROM b GROUP BY 1)
SELECT r.range::INT AS band, coalesce(n, 0)::BIGINT AS n, coalesce(100.0 * n / (SELECT sum(n) FROM c), 0.0)::DOUBLE AS share
FROM range(5) r LEFT JOIN c ON c.band = r.range
""")
def dense_band_histogram(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_quantity > 20")
    out = profile.dense_histogram(lines, scale.band(F.col("l_quantity") * 1.5), range(5))
    return out.select("band", F.col("n").cast("long").alias("n"), F.col("share").cast("double").alias("share"))


@named("""
WITH v AS (SELECT least(o_totalprice, 300000.0) AS v FROM orders WHERE o_totalprice IS NOT NULL), r AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
SELECT least(floor((v - lo) * 60 / (hi - lo)), 59)::INT AS bin, count(*)::BIGINT AS n FROM v, r GROUP BY 1
""")
def price_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.fixed_histogram(table(spark, d, "orders"), F.col("o_totalprice"), 300000.0, 60)


@named("""
WITH c AS (SELECT o_orderpriority, o_totalprice, count(*) AS c FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, o_totalprice, (100.0 * sum(c) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice ROWS UNBOUNDED PRECEDING)
  / sum(c) OVER (PARTITION BY o_orderpriority))::DOUBLE AS pct FROM c
""")
def ecdf(spark: SparkSession, d: str) -> DataFrame:
    out = profile.ecdf(table(spark, d, "orders"), "o_totalprice", "o_orderpriority")
    return out.withColumn("pct", F.col("pct").cast("double"))


@named("""
WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_brand) AS k FROM c)
SELECT p_brand, n FROM r WHERE k <= 7 UNION ALL SELECT 'Other', sum(n)::BIGINT FROM r WHERE k > 7 HAVING sum(n) > 0
""")
def top_and_other(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_and_other(table(spark, d, "part"), "p_brand", 7)


@named("""
WITH a AS (SELECT o_orderpriority, 100.0 * count(*) / (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_orderpriority, 100.0 * count(*) / (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS s FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT o_orderpriority, coalesce(a.s, 0.0)::DOUBLE AS share_a, coalesce(b.s, 0.0)::DOUBLE AS share_b FROM a FULL JOIN b USING (o_orderpriority)
""")
def share_compare(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority")
    out = profile.share_compare(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), "o_orderpriority")
    return out.select("o_orderpriority", *(F.col(c).cast("double").alias(c) for c in ("share_a", "share_b")))


# ---- names and rules

NEEDLES = (("almond", 1), ("forest", 2), ("red", 3), ("metal", 4), ("light", 5), ("light blue", 6), ("steel", 7), ("in", 8), ("small", 9), ("box", 10), ("a", 11))

_NEEDLE_ROWS = ", ".join(f"('{n}', {p})" for n, p in NEEDLES)


@named(rf"""
WITH needles(needle, program) AS (VALUES {_NEEDLE_ROWS}), nm AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL),
hits AS (SELECT name, needle, program, max(length(needle)) OVER (PARTITION BY name) AS longest FROM nm JOIN needles
  ON CASE WHEN length(needle) < 5 THEN regexp_matches(lower(name), '(^|[^a-z0-9])' || needle || '([^a-z0-9]|$)') ELSE contains(lower(name), needle) END),
best AS (SELECT name, count(DISTINCT program) AS k, min(program) AS program FROM hits WHERE length(needle) = longest GROUP BY 1)
SELECT name, CASE WHEN k = 1 THEN program END AS program, CASE WHEN k IS NULL THEN 'none' WHEN k = 1 THEN 'matched' ELSE 'ambiguous' END AS status
FROM nm LEFT JOIN best USING (name)
""")
def needle_longest_match(spark: SparkSession, d: str) -> DataFrame:
    needles = spark.createDataFrame(NEEDLES, "needle string, program int")
    return rules.longest_needle(table(spark, d, "part"), needles, "p_name")


RULES = (
    rules.Rule("percussion", drums=True),
    rules.Rule("keys", program=7, is_drum=False),
    rules.Rule("voice", keywords=("choir", "small", "vo")),
    rules.Rule("low", program=33),
    rules.Rule("organ", keywords=("o",)),
)


@named("""
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'percussion' WHEN p_size = 7 AND p_type <> 'PROMO' THEN 'keys'
  WHEN lower(p_name) LIKE '%choir%' OR lower(p_name) LIKE '%small%' OR lower(p_name) LIKE '%vo%' THEN 'voice'
  WHEN p_size = 33 THEN 'low' WHEN lower(p_name) LIKE '%o%' THEN 'organ' ELSE 'default' END AS category FROM part
""")
def ordered_rule_routing(spark: SparkSession, d: str) -> DataFrame:
    category = rules.route(RULES, F.col("p_name"), F.col("p_size"), F.col("p_type") == "PROMO", "default")
    return table(spark, d, "part").select("p_partkey", category.alias("category"))


@named(r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[./]+', ''), '^[^/]+/', ''), '\.[A-Za-z0-9]+$', '') AS path_id,
  CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM (
  SELECT page_id, url, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM pages)
""")
def url_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", names.path_id(F.col("url")).alias("path_id"), names.slug(F.col("url")).alias("slug"))


@named(r"""
SELECT p_partkey, trim(regexp_replace(translate(p_name, ',' || chr(9), '  '), '\s+', ' ', 'g')) AS clean, lower(trim(p_name)) AS normal,
  array_to_string(list_filter(regexp_split_to_array(lower(trim(p_name)), '[\s_/\-]+'), lambda w: length(w) >= 3)[1:3], '+') AS words FROM part
""")
def name_functions(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("p_name")
    words = F.array_join(names.keywords(name), "+")
    return table(spark, d, "part").select("p_partkey", names.sanitized(name).alias("clean"), names.normalized(name).alias("normal"), words.alias("words"))


@named("SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "k bigint")
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"))


@named("""
WITH t AS (SELECT conv_id, turn, role, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations),
p AS (SELECT conv_id, '$.id' AS path, conv_id::VARCHAR AS value FROM (SELECT DISTINCT conv_id FROM t)
  UNION ALL SELECT conv_id, '$.turns[' || i || '].turn', turn::VARCHAR FROM t
  UNION ALL SELECT conv_id, '$.turns[' || i || '].said.role', role FROM t
  UNION ALL SELECT conv_id, '$.turns[' || i || '].said.size.chars', chars::VARCHAR FROM t)
SELECT conv_id, path, value FROM p WHERE value IS NOT NULL
""")
def nested_documents(spark: SparkSession, d: str) -> DataFrame:
    turn = F.struct("turn", "role", "text", F.struct("role", F.struct(F.length("text").alias("chars")).alias("size")).alias("said"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t.turn.alias("turn"), t.said.alias("said")))
    whole = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    read = whole.select("conv_id", F.try_parse_json(F.to_json(F.struct(F.col("conv_id").alias("id"), "turns"))).alias("document"))
    return fields(read, "document", 5).select("conv_id", "path", F.try_variant_get("value", "$", "string").alias("value"))


# ---- ratings


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lines.select(
        F.col("l_suppkey").alias("listener"),
        F.col("l_orderkey").alias("stem"),
        F.col("l_returnflag").alias("category"),
        F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("variant"),
        F.col("l_quantity").cast("decimal(18,2)").alias("content"),
        (F.col("l_discount") * 100).cast("decimal(18,2)").alias("realism"),
    )


def _stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics with a noise level taken from the variant's name."""
    level = F.regexp_extract("variant", r"\d+", 0).cast("double") / 10
    return ratings.two_level_stats(_ratings(spark, d)).withColumn("level", level)


_RATINGS_SQL = """
r AS (SELECT l_suppkey AS listener, l_orderkey AS stem, l_returnflag AS category, 'v' || l_linenumber AS variant,
  l_quantity::DECIMAL(18,2) AS content, (l_discount * 100)::DECIMAL(18,2) AS realism FROM lineitem),
s1 AS (SELECT stem, category, variant, (sum(content)::DOUBLE / count(content))::DECIMAL(18,6) AS content,
  (sum(realism)::DOUBLE / count(realism))::DECIMAL(18,6) AS realism FROM r GROUP BY ALL),
stats AS (SELECT category, variant, (sum(content)::DOUBLE / count(content))::DECIMAL(18,6)::DOUBLE AS mean_content,
  (sum(realism)::DOUBLE / count(realism))::DECIMAL(18,6)::DOUBLE AS mean_realism, min(content)::DOUBLE AS min_content, count(DISTINCT stem) AS stems,
  substr(variant, 2)::DOUBLE / 10 AS level FROM s1 GROUP BY category, variant)
"""


@named(f"WITH {_RATINGS_SQL} SELECT category, variant, mean_content, mean_realism, min_content, stems FROM stats")
def two_level_stats(spark: SparkSession, d: str) -> DataFrame:
    return ratings.two_level_stats(_ratings(spark, d))


@named(f"""
WITH {_RATINGS_SQL}, f AS (SELECT *, min_content >= 3 AND mean_content >= 25.4 AS ok FROM stats),
p AS (SELECT * FROM f WHERE ok OR NOT (SELECT bool_or(ok) FROM f))
SELECT category, variant, mean_content, mean_realism FROM p QUALIFY row_number() OVER (PARTITION BY category ORDER BY mean_realism DESC, mean_content DESC, variant) = 1
""")
def winner_global_fallback(spark: SparkSession, d: str) -> DataFrame:
    return ratings.winner_global_fallback(_stats(spark, d), 3.0, 25.4).select("category", "variant", "mean_content", "mean_realism")


_GROUP_SQL = """
p AS (SELECT * FROM (SELECT *, bool_or(mean_content >= 25.6) OVER (PARTITION BY category) AS has_ok FROM stats) WHERE mean_content >= 25.6 OR NOT has_ok),
won AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY category ORDER BY mean_realism DESC, level DESC, mean_content DESC, variant) = 1)
"""


@named(f"WITH {_RATINGS_SQL}, {_GROUP_SQL} SELECT category, variant, level, mean_content FROM won")
def winner_group_fallback(spark: SparkSession, d: str) -> DataFrame:
    return ratings.winner_group_fallback(_stats(spark, d), 25.6).select("category", "variant", "level", "mean_content")


@named(f"""
WITH {_RATINGS_SQL}, {_GROUP_SQL}, lv AS (SELECT category, level, lag(level) OVER (PARTITION BY category ORDER BY level) AS lower FROM (SELECT DISTINCT category, level FROM stats)),
a AS (SELECT s.*, won.level AS won FROM stats s JOIN won USING (category) JOIN lv ON lv.category = won.category AND lv.level = won.level
  WHERE s.level = won.level OR s.level = lv.lower),
q AS (SELECT * FROM (SELECT *, bool_or(mean_content >= 25.6) OVER (PARTITION BY category) AS has_ok FROM a) WHERE mean_content >= 25.6 OR NOT has_ok)
SELECT category, level AS chosen, level < won AS revised FROM q
QUALIFY row_number() OVER (PARTITION BY category ORDER BY mean_realism DESC, level, mean_content DESC, variant) = 1
""")
def audit_winner(spark: SparkSession, d: str) -> DataFrame:
    stats = _stats(spark, d)
    return ratings.audit_winner(stats, ratings.winner_group_fallback(stats, 25.6), 25.6)


@named(f"""
WITH {_RATINGS_SQL}, m AS (SELECT *, mean_realism >= 5.03 OR (mean_content + mean_realism) / 2 >= 15.4 AS ok FROM stats),
k AS (SELECT *, bool_or(ok) OVER (PARTITION BY category) AS has_ok, row_number() OVER (PARTITION BY category ORDER BY mean_realism DESC, mean_content DESC, variant) AS rn FROM m)
SELECT category, variant, mean_content, mean_realism FROM k WHERE ok OR (NOT has_ok AND rn = 1)
""")
def shortlist_or_best(spark: SparkSession, d: str) -> DataFrame:
    return ratings.shortlist(_stats(spark, d), 5.03, 15.4)


_METRIC_SQL = """
own AS (SELECT category, variant, listener, (sum(content)::DOUBLE / count(content))::DECIMAL(18,6) AS m FROM r WHERE content IS NOT NULL GROUP BY ALL),
heard AS (SELECT category, count(DISTINCT listener) > 1 AS several FROM own GROUP BY 1),
judged AS (SELECT category, variant, m::DOUBLE AS m, m AS exact FROM own JOIN heard USING (category) WHERE several
  UNION ALL SELECT category, variant, content::DOUBLE, content::DECIMAL(18,6) FROM r JOIN heard USING (category) WHERE NOT several AND content IS NOT NULL),
ms AS (SELECT category, variant, sum(exact)::DOUBLE / count(*) AS mean, count(*) AS n, coalesce(stddev_samp(m) / sqrt(count(*)::DOUBLE), 0.0) AS sem FROM judged GROUP BY ALL)
"""


@named(f"""
WITH {_RATINGS_SQL}, {_METRIC_SQL}, b AS (SELECT *, max(mean) OVER (PARTITION BY category) AS best FROM ms)
SELECT category, max(best) AS best, string_agg(variant, ',' ORDER BY variant) FILTER (mean >= best - 1e-9) AS winners,
  max(mean) FILTER (mean < best - 1e-9) AS runner_up, max(best) - max(mean) FILTER (mean < best - 1e-9) AS margin FROM b GROUP BY category
""")
def leaderboard_margins(spark: SparkSession, d: str) -> DataFrame:
    return ratings.leaderboard(ratings.metric_stats(_ratings(spark, d), "content"))


@named(f"WITH {_RATINGS_SQL}, {_METRIC_SQL} SELECT category, variant, round(mean, 6) AS mean, round(sem, 6) AS sem, n FROM ms")
def metric_standard_errors(spark: SparkSession, d: str) -> DataFrame:
    stats = ratings.metric_stats(_ratings(spark, d), "content")
    return stats.select("category", "variant", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"), "n")


def _few_listeners(spark: SparkSession, d: str) -> DataFrame:
    """Ratings in which one category was heard by one listener only, and one variant was never rated."""
    rows = _ratings(spark, d).where("not (category = 'A' and variant = 'v7')")
    return rows.withColumn("listener", F.when(F.col("category") == "A", F.lit(1).cast("long")).otherwise(F.col("listener")))


_FEW_SQL = _RATINGS_SQL.replace("r AS (SELECT l_suppkey AS listener", "r AS (SELECT CASE WHEN l_returnflag = 'A' THEN 1 ELSE l_suppkey END AS listener").replace(
    "FROM lineitem)", "FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_linenumber = 7))"
)


@named(f"""
WITH {_FEW_SQL}, {_METRIC_SQL} SELECT h.category, v.variant, round(mean, 6) AS mean, round(sem, 6) AS sem, n FROM heard h
CROSS JOIN (SELECT 'v' || range AS variant FROM range(1, 8)) v LEFT JOIN ms ON ms.category = h.category AND ms.variant = v.variant
""")
def metric_of_few_listeners(spark: SparkSession, d: str) -> DataFrame:
    stats = ratings.metric_stats(_few_listeners(spark, d), "content", [f"v{k}" for k in range(1, 8)])
    return stats.select("category", "variant", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"), "n")


@named(f"""
WITH {_FEW_SQL}, {_METRIC_SQL}, hide AS (SELECT l_returnflag AS category, 'v' || l_linenumber AS variant FROM lineitem GROUP BY ALL HAVING bool_and(l_linenumber % 3 = 0 AND l_returnflag <> 'N')),
n AS (SELECT category, CASE WHEN variant IN ('v4', 'v5') THEN 'x_v' || (substr(variant, 2)::INT - 3) ELSE variant END AS variant, mean FROM ms ANTI JOIN hide USING (category, variant)),
b AS (SELECT *, max(mean) OVER (PARTITION BY category) AS best FROM n),
w AS (SELECT category, max(best) AS best, string_agg(variant, ',' ORDER BY variant) FILTER (mean >= best - 1e-9) AS winners, max(mean) FILTER (mean < best - 1e-9) AS runner_up FROM b GROUP BY 1)
SELECT w.category, best, winners, runner_up, best - runner_up AS margin, best - d.mean AS donor_margin FROM w
LEFT JOIN n d ON d.category = w.category AND d.variant = substr(list_filter(string_split(winners, ','), lambda x: starts_with(x, 'x_'))[1], 3)
""")
def leaderboard_hidden_and_donors(spark: SparkSession, d: str) -> DataFrame:
    rows = _few_listeners(spark, d)
    number = F.substring("variant", 2, 9).cast("int")
    hidden = ratings.hidden_conditions(_ratings(spark, d).withColumn("auto", (number % 3 == 0) & (F.col("category") != "N")))
    renamed = F.when(F.col("variant").isin("v4", "v5"), F.concat(F.lit("x_v"), (number - 3).cast("string"))).otherwise(F.col("variant"))
    stats = ratings.metric_stats(rows, "content").join(hidden, ["category", "variant"], "left_anti").withColumn("variant", renamed)
    return ratings.leaderboard(stats, hidden.where("false"), "x_")


@named("""
WITH r AS (SELECT 'v' || l_linenumber AS variant, l_linenumber = 1 OR l_suppkey % 2 = 0 AS ref, l_quantity::DECIMAL(18,2) AS c, (l_discount * 100)::DECIMAL(18,2) AS q FROM lineitem)
SELECT variant, coalesce(sum(c) FILTER (NOT ref)::DOUBLE / count(c) FILTER (NOT ref), CASE WHEN variant <> 'v1' THEN sum(c)::DOUBLE / count(c) END) AS content, sum(q)::DOUBLE / count(q) AS realism FROM r GROUP BY 1
""")
def means_with_override(spark: SparkSession, d: str) -> DataFrame:
    rows = _ratings(spark, d).withColumn("is_reference", (F.col("variant") == "v1") | (F.col("listener") % 2 == 0))
    return ratings.means_with_override(rows, "v1")


#: Several rows of a listener, stem and variant, of which the first by place isn't the highest.
_PLACED_SQL = """
r AS (SELECT (l_orderkey // 32) % 5 AS listener, l_orderkey // 160 AS stem, l_returnflag AS category, 'v' || l_linenumber AS variant, {'o': l_orderkey, 'n': l_linenumber, 's': l_suppkey, 'q': l_quantity} AS place,
  CASE WHEN l_suppkey % 9 > 0 THEN l_quantity::DECIMAL(18,2) END AS content, (l_discount * 100)::DECIMAL(18,2) AS realism FROM lineitem),
base AS (SELECT listener, stem, variant, content FROM r WHERE variant NOT IN ('v2', 'v4', 'v6') QUALIFY row_number() OVER (PARTITION BY listener, stem, variant ORDER BY place) = 1),
d AS (SELECT r.*, (CASE WHEN m.col0 IS NOT NULL THEN r.content - b.content WHEN r.content IS NOT NULL THEN 0 END)::DOUBLE AS difference
  FROM r LEFT JOIN (VALUES ('v2', 'v1'), ('v4', 'v3'), ('v6', 'v5')) m ON m.col0 = r.variant LEFT JOIN base b ON b.listener = r.listener AND b.stem = r.stem AND b.variant = m.col1)
"""
_BASES = {"v2": "v1", "v4": "v3", "v6": "v5"}


def _placed(spark: SparkSession, d: str) -> DataFrame:
    lines, order = table(spark, d, "lineitem"), F.col("l_orderkey")
    return lines.select(
        F.floor(order / 32) % 5,
        F.floor(order / 160),
        "l_returnflag",
        F.concat(F.lit("v"), F.col("l_linenumber").cast("string")),
        F.struct(order.alias("o"), F.col("l_linenumber").alias("n"), "l_suppkey", "l_quantity"),
        F.when(F.col("l_suppkey") % 9 > 0, F.col("l_quantity").cast("decimal(18,2)")),
        (F.col("l_discount") * 100).cast("decimal(18,2)"),
    ).toDF("listener", "stem", "category", "variant", "place", "content", "realism")


@named(f"WITH {_PLACED_SQL} SELECT place.o AS o, place.n AS n, content::DOUBLE AS content, difference FROM d")
def content_difference(spark: SparkSession, d: str) -> DataFrame:
    out = ratings.content_difference(_placed(spark, d), _BASES, "place")
    return out.select("place.o", "place.n", F.col("content").cast("double").alias("content"), "difference")


_MEAN_OF = """SELECT category, variant, sum(m)::DOUBLE / count(*) AS mean FROM (
  SELECT category, variant, listener, (sum({0}::DECIMAL(18,2))::DOUBLE / count({0}))::DECIMAL(18,6) AS m FROM d WHERE {0} IS NOT NULL GROUP BY ALL) GROUP BY ALL"""


@named(f"""
WITH {_PLACED_SQL}, q AS ({_MEAN_OF.format("realism")}), c AS ({_MEAN_OF.format("content")}), x AS ({_MEAN_OF.format("difference")}),
n AS (SELECT category, CASE WHEN variant IN ('v4', 'v5') THEN 'x_v' || (substr(variant, 2)::INT - 3) ELSE variant END AS variant, q.mean AS realism, c.mean AS content, x.mean AS diff
  FROM q FULL JOIN c USING (category, variant) FULL JOIN x USING (category, variant) WHERE q.mean IS NOT NULL AND NOT (category = 'N' AND variant = 'v3')),
b AS (SELECT *, max(realism) OVER (PARTITION BY category) AS best FROM n),
w AS (SELECT category, max(best) AS best, max(realism) FILTER (realism < best - 1e-9) AS second,
  list({{'v': variant, 'c': content, 'd': diff, 'r': realism}} ORDER BY realism DESC, content DESC NULLS LAST, variant) FILTER (realism >= best - 1e-9) AS won FROM b GROUP BY 1),
t AS (SELECT *, list_transform(won, lambda p: p.v) AS names FROM w)
SELECT t.category, array_to_string(names, ',') AS winner, array_to_string(list_transform(names, lambda v: CASE WHEN v = 'v1' THEN 'one' ELSE v END), ',') AS winner_label,
  round_even(won[1].c, 2) AS content, round_even(won[1].d, 2) AS content_diff, round_even(won[1].r, 2) AS realism, round_even(best - second, 2) AS margin,
  round_even(best - n.realism, 2) AS donor_margin
FROM t LEFT JOIN n ON n.category = t.category AND n.variant = substr(list_filter(names, lambda v: starts_with(v, 'x_'))[1], 3)
""")
def category_winners(spark: SparkSession, d: str) -> DataFrame:
    renamed = F.when(F.col("variant").isin("v4", "v5"), F.concat(F.lit("x_v"), (F.substring("variant", 2, 9).cast("int") - 3).cast("string"))).otherwise(F.col("variant"))
    rows = _placed(spark, d).withColumn("variant", renamed)
    hidden = rows.where("category = 'N' and variant = 'v3'").select("category", "variant").distinct()
    return ratings.category_winners(rows, {"v2": "v1", "x_v1": "v3", "v6": "x_v2"}, "place", hidden, "x_", {"v1": "one"})


@named(f"""
WITH {_RATINGS_SQL}, pairs AS (VALUES ('v1', 'v8'), ('v2', 'v7')),
made AS (SELECT r.* REPLACE (p.col1 AS variant), p.col0 AS donor FROM r JOIN pairs p ON r.variant = p.col0),
new AS (SELECT * FROM made ANTI JOIN r USING (listener, stem, variant)
  QUALIFY row_number() OVER (PARTITION BY listener, stem, variant ORDER BY donor, content DESC, realism DESC) = 1),
al AS (SELECT variant, content, donor, false AS auto FROM (SELECT *, NULL::VARCHAR AS donor FROM r) UNION ALL SELECT variant, content, donor, true FROM new)
SELECT variant, donor, auto, count(*) AS n, sum(content)::DOUBLE AS content FROM al GROUP BY ALL
""")
def donor_expansion(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.createDataFrame([("v1", "v8"), ("v2", "v7")], "donor string, duplicate string")
    grown = ratings.donor_expansion(_ratings(spark, d), pairs)
    return grown.groupBy("variant", "donor", "auto").agg(F.count("*").alias("n"), F.sum("content").cast("double").alias("content"))


@named("""
WITH m AS (SELECT 'v' || l_linenumber AS variant, sum((l_quantity * 2)::DECIMAL(18,2))::DOUBLE / count(*) AS content,
  sum((l_discount * 1000)::DECIMAL(18,2))::DOUBLE / count(*) AS realism FROM lineitem GROUP BY 1),
p AS (SELECT *, max(content) OVER () AS top FROM m WHERE variant <> 'v1'),
g AS (SELECT *, CASE WHEN content >= greatest(50.0, top - 20) THEN 0 WHEN content >= 60 THEN 1 WHEN content = top THEN 2 END AS grade FROM p)
SELECT variant, content, realism FROM g WHERE grade IS NOT NULL ORDER BY grade, realism DESC, content DESC, variant LIMIT 1
""")
def overall_winner(spark: SparkSession, d: str) -> DataFrame:
    variant = F.concat(F.lit("v"), F.col("l_linenumber").cast("string"))
    means = table(spark, d, "lineitem").groupBy(variant.alias("variant")).agg(
        profile.exact_mean(F.col("l_quantity") * 2).alias("content"), profile.exact_mean(F.col("l_discount") * 1000).alias("realism")
    )
    return ratings.overall_winner(means, "v1")


@named("""
WITH s AS (SELECT l_discount * 10 AS score, l_returnflag = 'R' AS label FROM lineitem), t AS (SELECT range / 20 AS t FROM range(21)),
a AS (SELECT t, sum(((score >= t) = label)::INT) / count(*) AS agreement FROM s CROSS JOIN t GROUP BY t)
SELECT t, agreement, row_number() OVER (ORDER BY agreement DESC, t DESC) = 1 AS best FROM a
""")
def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("score"), (F.col("l_returnflag") == "R").alias("label"))
    return ratings.threshold_grid(scores)


@named("""
SELECT l_linenumber, sum(l_quantity::DECIMAL(18,2)) FILTER (l_linestatus = 'O')::DOUBLE / count(*) FILTER (l_linestatus = 'O') AS synthetic,
  sum(l_quantity::DECIMAL(18,2)) FILTER (l_linestatus = 'F')::DOUBLE / count(*) FILTER (l_linestatus = 'F') AS realified FROM lineitem GROUP BY 1
""")
def factorial_pivot(spark: SparkSession, d: str) -> DataFrame:
    mean = profile.exact_mean(F.col("l_quantity"))
    out = table(spark, d, "lineitem").groupBy("l_linenumber").pivot("l_linestatus", ["O", "F"]).agg(mean)
    return out.withColumnsRenamed({"O": "synthetic", "F": "realified"})


# ---- votes


def _votes(spark: SparkSession, d: str) -> DataFrame:
    tier = F.get(F.array(*map(F.lit, votes.TIERS)), F.length("event_type") % 4)
    user = F.col("user_id")
    return table(spark, d, "events").select(
        F.concat_ws("|", user % 40, user % 7, F.col("event_id") % 3).alias("card"),
        F.concat(F.lit("c"), user % 40).alias("category"),
        F.concat(F.lit("v"), user % 7).alias("variant"),
        tier.alias("tier"),
        F.col("event_id").alias("at"),
    )


_VOTES_SQL = """
v AS (SELECT concat_ws('|', user_id % 40, user_id % 7, event_id % 3) AS card, 'c' || (user_id % 40) AS category, 'v' || (user_id % 7) AS variant,
  ['strong_reject', 'weak_reject', 'weak_accept', 'strong_accept'][length(event_type) % 4 + 1] AS tier, event_id AS arrived FROM events),
lv AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY card ORDER BY arrived DESC, tier DESC) = 1),
cards AS (SELECT DISTINCT 'c' || (user_id % 40) AS category, 'v' || (user_id % 7) AS variant, concat_ws('|', user_id % 40, user_id % 7, k) AS card,
  (k + 2) % 4 AS place FROM events, (VALUES (0), (1), (2), (3)) t(k))
"""


def _cards(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select((F.col("user_id") % 40).alias("c"), (F.col("user_id") % 7).alias("v")).distinct()
    clips = users.select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    return clips.select(F.concat(F.lit("c"), "c").alias("category"), F.concat(F.lit("v"), "v").alias("variant"), F.concat_ws("|", "c", "v", "k").alias("card"), ((F.col("k") + 2) % 4).alias("place"))


@named(f"""
WITH {_VOTES_SQL}, j AS (SELECT c.*, tier, arg_min(c.card, place) FILTER (tier = 'strong_reject') OVER w AS rj, arg_min(c.card, place) FILTER (tier = 'strong_accept') OVER w AS ac
  FROM cards c LEFT JOIN lv ON lv.card = c.card WINDOW w AS (PARTITION BY c.category, c.variant)),
k AS (SELECT *, true AS overwrite FROM j UNION ALL SELECT *, false FROM j)
SELECT card, category, variant, overwrite, CASE WHEN rj IS NOT NULL AND (tier IS NULL OR overwrite AND tier <> 'strong_reject') THEN 'strong_reject'
  WHEN rj IS NULL AND tier IS NULL AND ac IS NOT NULL THEN 'strong_accept' ELSE tier END AS tier,
  CASE WHEN rj IS NOT NULL AND (tier IS NULL OR overwrite AND tier <> 'strong_reject') THEN rj WHEN rj IS NULL AND tier IS NULL AND ac IS NOT NULL THEN ac END AS source FROM k
""")
def vote_cascade(spark: SparkSession, d: str) -> DataFrame:
    cards, last = _cards(spark, d), votes.last_votes(_votes(spark, d))
    both = [votes.cascade(cards, last, "place", o).withColumn("overwrite", F.lit(o)) for o in (True, False)]
    return both[0].unionByName(both[1])


@named(f"""
WITH {_VOTES_SQL}, c AS (SELECT category, variant, CASE tier WHEN 'strong_accept' THEN 0 WHEN 'weak_accept' THEN 1 WHEN 'weak_reject' THEN 2 ELSE 3 END AS pool, count(*) AS votes FROM v
  WHERE category NOT IN ('c1', 'c2') OR tier IN ('weak_reject', 'strong_reject') GROUP BY ALL),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY category, variant ORDER BY pool) = 1),
p AS (SELECT * FROM b QUALIFY pool = min(pool) OVER (PARTITION BY category)),
k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN pool <= 1 THEN votes ELSE 0 END DESC, variant)::INT AS rank FROM p)
SELECT category, variant, pool, votes, rank FROM k WHERE pool = 0 OR rank <= 3
""")
def swipe_tier_pools(spark: SparkSession, d: str) -> DataFrame:
    given = _votes(spark, d).where("category not in ('c1', 'c2') or tier in ('weak_reject', 'strong_reject')")
    return votes.tier_pools(given).select("category", "variant", "pool", "votes", "rank")


@named(f"""
WITH {_VOTES_SQL} SELECT c.category, count(*) FILTER (tier IS NULL) AS open, count(*) FILTER (tier = 'strong_accept') AS accepted,
  count(*) FILTER (tier <> 'strong_accept') AS rejected FROM cards c LEFT JOIN lv ON lv.card = c.card GROUP BY 1
""")
def vote_progress(spark: SparkSession, d: str) -> DataFrame:
    return votes.progress(_cards(spark, d), votes.last_votes(_votes(spark, d)))


# ---- keyed tables

_LINE_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@named("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1
""")
def shard_merge_last_wins(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_LINE_ORDER)
    merged = tables.last_of_each(lines, ["l_orderkey", "l_linenumber"], *_LINE_ORDER)
    return merged.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@named("""
WITH n AS (SELECT o_orderkey, o_custkey + 1 AS o_custkey, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 5 = 0)
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ANTI JOIN n USING (o_orderkey) UNION ALL SELECT * FROM n
""")
def upsert_replace_keys(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = old.where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), F.lit("X").alias("o_orderstatus"))
    return tables.upsert(old, new, ["o_orderkey"])


_EXPECTED = "SELECT l_orderkey, max(l_linenumber) AS expected FROM lineitem GROUP BY 1"


@named(f"""
SELECT e.l_orderkey, count(DISTINCT l_linenumber) AS found FROM lineitem l JOIN ({_EXPECTED}) e ON l.l_orderkey = e.l_orderkey
GROUP BY e.l_orderkey, expected HAVING count(DISTINCT l_linenumber) >= expected
""")
def complete_songs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    songs = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("expected"))
    return tables.complete_songs(lines, songs, "l_orderkey", "l_linenumber", "expected")


@named(f"""
SELECT l_orderkey, track::INT AS track FROM (SELECT l_orderkey, unnest(range(0, expected::BIGINT)) AS track FROM ({_EXPECTED}))
ANTI JOIN (SELECT DISTINCT l_orderkey, l_linenumber - 1 AS track FROM lineitem) USING (l_orderkey, track)
""")
def missing_tracks(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("track"))
    songs = lines.groupBy("l_orderkey").agg((F.max("track") + 1).alias("expected"))
    return tables.missing_tracks(lines, songs, "l_orderkey", "track", "expected")


@named("""
WITH w AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 25 THEN p_type END AS p_type FROM part),
r AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'old' ELSE p_brand END AS b, CASE WHEN p_size > 24 THEN p_type END AS t FROM part WHERE p_partkey % 13 <> 0)
SELECT w.p_partkey, CASE WHEN r.p_partkey IS NULL THEN 'missing' ELSE 'changed' END AS conflict FROM w LEFT JOIN r ON r.p_partkey = w.p_partkey
WHERE r.p_partkey IS NULL OR p_brand IS DISTINCT FROM b OR p_type IS DISTINCT FROM t
""")
def recipe_drift(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    wanted = part.select("p_partkey", "p_brand", F.when(F.col("p_size") > 25, F.col("p_type")).alias("p_type"))
    brand = F.when(F.col("p_partkey") % 11 == 0, "old").otherwise(F.col("p_brand"))
    kept = part.where("p_partkey % 13 <> 0").select("p_partkey", brand.alias("p_brand"), F.when(F.col("p_size") > 24, F.col("p_type")).alias("p_type"))
    return tables.drift(wanted, kept, ["p_partkey"], ["p_brand", "p_type"]).select("p_partkey", "conflict")


@named("""
SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region
ANTI JOIN (SELECT n_nationkey, n_regionkey AS r_regionkey FROM nation) done USING (n_nationkey, r_regionkey)
""")
def grid_cross_minus_done(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation")
    done = nations.select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    return tables.grid_minus_done(nations.select("n_nationkey"), table(spark, d, "region").select("r_regionkey"), done, ["n_nationkey", "r_regionkey"])


@named("""
SELECT l_orderkey, l_linenumber, coalesce(o.o_orderpriority, 'none') AS priority FROM lineitem
LEFT JOIN (SELECT o_orderkey AS l_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F') o USING (l_orderkey)
""")
def left_lookup_with_default(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("priority"))
    return tables.lookup(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), orders, ["l_orderkey"], "priority", F.lit("none"))


@named("""
SELECT o.o_orderkey, greatest(5 - coalesce(n, 0), 0)::BIGINT AS remaining FROM orders o
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey
""")
def remaining_work(spark: SparkSession, d: str) -> DataFrame:
    expected = table(spark, d, "orders").select("o_orderkey", F.lit(5).cast("long").alias("n"))
    return tables.remaining_work(expected, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@named("SELECT l_suppkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3")
def has_all_conditions(spark: SparkSession, d: str) -> DataFrame:
    return tables.has_all(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"])


@named("""
SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS "n_A", count(*) FILTER (l_returnflag = 'N') AS "n_N", count(*) FILTER (l_returnflag = 'R') AS "n_R"
FROM lineitem GROUP BY 1
""")
def pass_count_pivot(spark: SparkSession, d: str) -> DataFrame:
    return tables.pivot_counts(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"])


# ---- sequences and arrays


@named("SELECT l_orderkey, l_linenumber, l_quantity, l_quantity / max(l_quantity) OVER (PARTITION BY l_orderkey) AS ratio FROM lineitem")
def velocity_scale(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return sequences.ratio_to_maximum(lines, "l_orderkey", "l_quantity")


@named("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1)::INT AS index FROM conversations WHERE role <> 'system'")
def dense_index(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where("role <> 'system'").select("conv_id", "turn", "role")
    return sequences.dense_index(turns, "conv_id", "turn", "role").select("conv_id", "turn", "index")


@named("""
WITH e AS (SELECT user_id, floor(event_id / 500)::BIGINT AS track, event_id AS seq, length(event_type) % 2 = 0 AS is_on, event_id % 3 AS note FROM events),
o AS (SELECT a.user_id, a.track, a.seq, bool_or(b.is_on) AS busy FROM e a JOIN LATERAL (
    SELECT note, arg_max(is_on, seq) AS is_on FROM e b WHERE b.user_id IS NOT DISTINCT FROM a.user_id AND b.track = a.track AND b.seq < a.seq GROUP BY note) b ON true WHERE a.is_on GROUP BY ALL)
SELECT user_id, track, NOT coalesce(bool_or(busy), false) AS monophonic FROM (SELECT DISTINCT user_id, track FROM e) LEFT JOIN o USING (user_id, track) GROUP BY ALL
""")
def monophony(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("user_id")
    notes = table(spark, d, "events").select(
        user, F.floor(F.col("event_id") / 500).alias("track"), F.col("event_id").alias("seq"),
        (F.length("event_type") % 2 == 0).alias("on"), (F.col("event_id") % 3).alias("note"),
    )
    return sequences.monophony(notes, ["user_id", "track"])


@named("""
SELECT doc_id, k.unnest * 1500 AS start, least(k.unnest * 1500 + 2000, n_chars) AS "end" FROM documents,
  unnest(range(0, CASE WHEN n_chars <= 2000 THEN 1 ELSE ceil((n_chars - 2000) / 1500)::BIGINT + 1 END)) k WHERE n_chars > 0
""")
def chunk_spans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.inline(arrays.chunk_spans(F.col("n_chars"), 2000, 500)))


@named("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS key, row_number() OVER w AS rn, lag(o_orderpriority) OVER w AS prev FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
i AS (SELECT *, sum((rn = 1 OR key IS DISTINCT FROM prev)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island FROM o),
p AS (SELECT *, (row_number() OVER (PARTITION BY o_custkey, island ORDER BY o_orderkey) - 1) % 2 = 0 AS opens FROM i)
SELECT o_orderkey, o_custkey, (sum(opens::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::BIGINT AS batch FROM p
""")
def run_batches(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return sequences.run_batches(tasks, "o_custkey", "o_orderpriority", 2, "o_orderkey").select("o_orderkey", "o_custkey", "batch")


@named("SELECT o_orderkey, o_orderpriority, (ntile(7) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1)::INT AS shard FROM orders")
def contiguous_shards(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return sequences.contiguous_shards(orders, "o_orderpriority", 7, "o_orderkey")


@named("""
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 9) AS rms,
  list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS peak FROM embeddings
""")
def array_rms(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(arrays.rms(x), 9).alias("rms"), arrays.peak(x).alias("peak"))


@named("""
WITH p AS (SELECT label, pos, sum(x::DECIMAL(18,6)) AS s FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL)
SELECT label, max(abs(s))::DOUBLE AS peak, CASE WHEN max(abs(s)) > 1 THEN 1.0::DOUBLE / max(abs(s))::DOUBLE ELSE 1.0::DOUBLE END AS gain FROM p GROUP BY label
""")
def mix_gain(spark: SparkSession, d: str) -> DataFrame:
    stems = samples.blocks(table(spark, d, "embeddings"), "label", "embedding", block=24)
    return samples.mixture_gain(stems, "label", "embedding")


@named("""
SELECT vec_id, list_sum(list_transform([1, 17, 33, 49], lambda s: (sqrt(list_sum(list_transform(embedding[s : s + 15], lambda x: x::DOUBLE * x::DOUBLE)) / 16) >= 0.12)::INT::DOUBLE)) / 4 AS active
FROM embeddings
""")
def sliding_activity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", arrays.active_fraction(F.col("embedding"), 16, 0.12).alias("active"))


# ---- samples


@named("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('43|' || o_orderkey), o_orderkey LIMIT 100")
def deterministic_sample(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return sampling.sample_rows(orders, 100, 43, "o_orderkey")


@named("""
WITH p AS (SELECT s_nationkey, s_suppkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY md5(concat_ws('|', '7', s_nationkey, s_suppkey)), s_suppkey) - 1)::INT AS position FROM supplier)
SELECT *, CASE WHEN position < 26 THEN chr(65 + position) WHEN position < 702 THEN chr(65 + position // 26 - 1) || chr(65 + position % 26)
  ELSE chr(65 + (position - 702) // 676) || chr(65 + (position - 702) // 26 % 26) || chr(65 + (position - 702) % 26) END AS label FROM p
""")
def blinded_order(spark: SparkSession, d: str) -> DataFrame:
    suppliers = table(spark, d, "supplier").select("s_nationkey", "s_suppkey")
    return sampling.blinded(suppliers, "s_nationkey", "s_suppkey", 7)


@named("""
WITH t AS (SELECT o_orderpriority, o_custkey, o_orderkey, md5('7|' || o_orderkey) AS h FROM orders),
u AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY h, o_orderkey) AS turn FROM t)
SELECT o_orderpriority, o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY turn, h, o_orderkey))::INT AS rank FROM u QUALIFY rank <= 5
""")
def diverse_selection(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderpriority", "o_custkey", "o_orderkey")
    return sampling.distinct_songs_first(orders, "o_orderpriority", "o_custkey", 5, 7, "o_orderkey")


# ---- onsets, windows and samples


@named("""
WITH RECURSIVE p AS (
  SELECT vec_id, list_sort(list_transform(embedding[1:32], lambda x: x::DOUBLE)) AS refs,
    list_transform(list_sort(list_transform(embedding[33:64], lambda x: x::DOUBLE)), lambda x, i: {'at': x, 'i': i}) AS cands FROM embeddings),
s AS (
  SELECT vec_id, refs, cands AS rest, 1::BIGINT AS k, 0::BIGINT AS n FROM p
  UNION ALL
  SELECT vec_id, refs, CASE WHEN best.d <= 0.01 THEN list_filter(rest, lambda c: c.i <> best.i) ELSE rest END, k + 1, n + coalesce(best.d <= 0.01, false)::INT FROM (
    SELECT *, list_sort(list_transform(rest, lambda c: {'d': abs(c.at - refs[k]), 'i': c.i}))[1] AS best FROM s WHERE k <= 32))
SELECT vec_id, n AS matched, CASE WHEN n > 0 THEN 2.0::DOUBLE * (n / 32) * (n / 32) / (n / 32 + n / 32) ELSE 0.0 END::DOUBLE AS f1 FROM s WHERE k = 33
""")
def onset_match(spark: SparkSession, d: str) -> DataFrame:
    halves = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    matched = halves.select("vec_id", arrays.matched_onsets(F.col("a"), F.col("b"), 0.01).alias("matched"), F.size("a").alias("n_a"), F.size("b").alias("n_b"))
    return matched.select("vec_id", "matched", arrays.f1(F.col("matched"), F.col("n_a"), F.col("n_b")).alias("f1"))


@named("""
WITH RECURSIVE files AS (
  SELECT 'user/' || user_id || '/' || event_type AS path, list_sort(list(epoch_us(ts) / 1000000.0::DOUBLE)) AS onsets
  FROM events WHERE ts IS NOT NULL AND (event_type <> 'view' OR user_id % 2 = 0) GROUP BY 1),
made AS (SELECT DISTINCT 'user/' || user_id || '/' || event_type AS out_path, 'user/' || user_id || '/view' AS first, 'user/' || user_id || '/click' AS second
  FROM events WHERE event_type IN ('error', 'signup', 'purchase')),
p AS (SELECT out_path, coalesce(a.path, b.path) AS reference_path, coalesce(a.onsets, b.onsets) AS refs,
    list_transform(f.onsets, lambda x, i: {'at': x, 'i': i}) AS cands
  FROM made JOIN files f ON f.path = out_path LEFT JOIN files a ON a.path = first LEFT JOIN files b ON b.path = second),
s AS (
  SELECT out_path, cands AS rest, 1::BIGINT AS k, 0::BIGINT AS n FROM p
  UNION ALL
  SELECT out_path, CASE WHEN best.d <= 43200 THEN list_filter(rest, lambda c: c.i <> best.i) ELSE rest END, k + 1, n + coalesce(best.d <= 43200, false)::INT FROM (
    SELECT s.*, list_sort(list_transform(rest, lambda c: {'d': abs(c.at - refs[k]), 'i': c.i}))[1] AS best FROM s JOIN p USING (out_path) WHERE k <= len(refs))),
m AS (SELECT out_path, max(n) AS matched FROM s GROUP BY 1),
f AS (SELECT out_path, reference_path, matched, len(cands) - matched AS extra, len(refs) - matched AS missing, matched / len(cands) AS pr, matched / len(refs) AS re FROM p JOIN m USING (out_path))
SELECT out_path, reference_path, matched, extra, missing, CASE WHEN matched > 0 THEN 2.0::DOUBLE * pr * re / (pr + re) ELSE 0.0::DOUBLE END AS score,
  (CASE WHEN matched > 0 THEN 2.0::DOUBLE * pr * re / (pr + re) ELSE 0.0::DOUBLE END) >= 0.4 AS passed FROM f
""")
def scored_manifest(spark: SparkSession, d: str) -> DataFrame:
    events, at = table(spark, d, "events"), lambda kind: F.concat(F.lit("user/"), "user_id", F.lit("/"), kind)
    there = events.where("ts is not null and (event_type <> 'view' or user_id % 2 = 0)")
    onsets = there.groupBy(at(F.col("event_type")).alias("path")).agg(F.collect_list(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0).alias("onsets"))
    made = events.where("event_type in ('error', 'signup', 'purchase')").select(at(F.col("event_type")).alias("out_path"), "user_id").distinct()
    found = manifest.scored_manifest(made, onsets, [at(F.lit("view")), at(F.lit("click"))], 43_200.0, 0.4)
    return found.select("out_path", "reference_path", "matched", F.col("extra").cast("long"), F.col("missing").cast("long"), "score", "passed")


@named("""
WITH w AS (SELECT user_id, epoch_us(ts) AS s, value AS v FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
a AS (SELECT user_id, s FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, s) = 1),
b AS (SELECT w.user_id, w.s FROM w JOIN a ON w.user_id IS NOT DISTINCT FROM a.user_id WHERE abs(w.s - a.s) >= 86400000000
  QUALIFY row_number() OVER (PARTITION BY w.user_id ORDER BY w.v DESC, w.s) = 1),
c AS (SELECT w.user_id, w.s FROM w JOIN a ON w.user_id IS NOT DISTINCT FROM a.user_id JOIN b ON w.user_id IS NOT DISTINCT FROM b.user_id
  WHERE abs(w.s - a.s) >= 86400000000 AND abs(w.s - b.s) >= 86400000000 QUALIFY row_number() OVER (PARTITION BY w.user_id ORDER BY w.v DESC, w.s) = 1)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY s) - 1)::INT AS index, s AS start FROM (FROM a UNION ALL FROM b UNION ALL FROM c)
""")
def windows_apart(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), "value")
    return selection.best_apart(events, "user_id", "start", "value", 3, 86_400_000_000)


@named("""
WITH x AS (SELECT vec_id, k, last, s, e, unnest(range(s, e)) AS pos, embedding
  FROM embeddings, (VALUES (0, false, 0, 24), (1, false, 16, 40), (2, false, 32, 56), (3, true, 48, 64)) AS spans(k, last, s, e)),
y AS (SELECT vec_id, pos, embedding[pos + 1]::DOUBLE * (k + 1) AS v, least(CASE WHEN k > 0 AND pos - s < 8 THEN (pos - s) / 7 ELSE 1.0::DOUBLE END,
  CASE WHEN NOT last AND e - pos <= 8 THEN (e - 1 - pos) / 7 ELSE 1.0::DOUBLE END) AS w FROM x)
SELECT vec_id, pos, sum(v * w) / greatest(sum(w), 1e-8::DOUBLE) AS value FROM y GROUP BY ALL
""")
def chunk_stitch(spark: SparkSession, d: str) -> DataFrame:
    spans = F.posexplode(arrays.chunk_spans(F.size("embedding"), 24, 8))
    cut = table(spark, d, "embeddings").select("vec_id", "embedding", spans.alias("chunk", "span")).select("vec_id", "chunk", "embedding", "span.*")
    louder = F.transform(F.slice("embedding", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), lambda v: v.cast("double") * (F.col("chunk") + 1))
    chunks = cut.select("vec_id", "chunk", (F.col("end") == F.size("embedding")).alias("last"), "start", "end", louder.alias("samples"))
    stitched = samples.stitch(chunks, "vec_id", 8, block=20)
    return stitched.select("vec_id", "block", F.posexplode("value").alias("at", "value")).select("vec_id", (F.col("block") * 20 + F.col("at")).alias("pos"), "value")


@named("""
WITH y AS (SELECT vec_id, pos, embedding[pos + 1]::DOUBLE AS v, CASE WHEN pos < 20 THEN abs(embedding[pos + 1]::DOUBLE) ELSE 0.0 END >= pow(10, -1.0) AS active
  FROM (SELECT vec_id, embedding, unnest(range(64)) AS pos FROM embeddings)),
loud AS (SELECT vec_id, k FROM y, range(7) r(k) WHERE pos >= 8 * k AND pos < 8 * k + 16 GROUP BY ALL HAVING 20 * log10(max(abs(v)) + 1e-10) >= -20),
covered AS (SELECT DISTINCT y.vec_id, y.pos FROM y JOIN loud l ON l.vec_id = y.vec_id AND pos >= 8 * k AND pos < 8 * k + 16),
m AS (SELECT y.*, c.pos IS NOT NULL AND NOT active AND NOT bool_or(active) OVER (PARTITION BY y.vec_id ORDER BY y.pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS silent
  FROM y LEFT JOIN covered c USING (vec_id, pos)),
e AS (SELECT *, coalesce(lag(silent) OVER (PARTITION BY vec_id ORDER BY pos), false) AS before FROM m),
f AS (SELECT *, max(CASE WHEN silent AND NOT before THEN pos END) OVER r AS up, max(CASE WHEN before AND NOT silent THEN pos END) OVER r AS down
  FROM e WINDOW r AS (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT vec_id, pos, silent, CASE WHEN down IS NOT NULL THEN v * ((pos - down + 1) / 6) WHEN up IS NOT NULL THEN v * (1.0::DOUBLE - (pos - up + 1) / 6)
  WHEN silent THEN 0.0::DOUBLE ELSE v END AS value FROM f
""")
def silence_enforcement(spark: SparkSession, d: str) -> DataFrame:
    quiet_end = F.concat(F.slice("embedding", 1, 20), F.array_repeat(F.lit(0.0).cast("float"), 44))
    waves = table(spark, d, "embeddings").select("vec_id", quiet_end.alias("dry"), F.col("embedding").alias("wet"))
    cut = samples.blocks(waves, "vec_id", "dry", "wet", block=20)
    silent = samples.hallucinated(cut, "vec_id", "dry", "wet", 16, 8, -20.0, 4, 20)
    done = samples.enforce_silence(cut, silent, "vec_id", "wet", 6, 20).select("vec_id", "block", F.posexplode(F.arrays_zip("silent", "value")).alias("at", "s"))
    return done.select("vec_id", (F.col("block") * 20 + F.col("at")).alias("pos"), "s.silent", "s.value")


@named("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS category, md5('43|' || l_orderkey) AS key FROM lineitem),
c AS (SELECT category, key, l_orderkey, count(*) AS n FROM r WHERE category IN ('AF', 'AO', 'NF', 'NO', 'RF', 'RO') GROUP BY ALL),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY category ORDER BY key, l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
k AS (SELECT DISTINCT key, l_orderkey FROM b WHERE before < 50 UNION SELECT key, l_orderkey FROM (SELECT key, l_orderkey FROM r ORDER BY key, l_orderkey LIMIT 1)),
p AS (SELECT l_orderkey, (row_number() OVER (ORDER BY key, l_orderkey) - 1)::INT AS position FROM k QUALIFY position < 400)
SELECT position, l_orderkey, l_linenumber, category FROM r JOIN p USING (l_orderkey)
""")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("category"))
    return selection.fill_quotas(lines, "l_orderkey", "category", ("AF", "AO", "NF", "NO", "RF", "RO"), 50, 400, 43)


# ---- recipes and verification documents

CONDITION_IDS = ("basic", "basic_realify", "slakh", "slakh_realify", "ddsp_basic", "ddsp_basic_realify", "ddsp_slakh", "ddsp_slakh_realify", "other")


@named(f"""
WITH c AS (SELECT o_orderkey, ({list(CONDITION_IDS)})[(o_orderkey % {len(CONDITION_IDS)} + 1)::INT] AS condition FROM orders)
SELECT o_orderkey, condition, CASE WHEN condition <> 'other' THEN CASE WHEN condition LIKE 'ddsp%' THEN 'midi-ddsp' ELSE split_part(condition, '_', 1) END END AS method,
  CASE WHEN condition <> 'other' THEN suffix(condition, '_realify') END AS realify,
  CASE WHEN condition <> 'other' THEN CASE WHEN contains(condition, 'slakh') THEN 'slakh' ELSE 'basic' END END AS fallback FROM c
""")
def condition_expansion(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array(*(F.lit(c) for c in CONDITION_IDS))
    rows = table(spark, d, "orders").select("o_orderkey", F.get(ids, (F.col("o_orderkey") % len(CONDITION_IDS)).cast("int")).alias("condition"))
    parts = rows.withColumn("_p", recipe.condition_parts(F.col("condition")))
    return parts.select("o_orderkey", "condition", "_p.method", "_p.realify", "_p.fallback")


def _verified(spark: SparkSession, d: str) -> DataFrame:
    """A document for each order: one entry for each line status, its lines as stems."""
    flagged = F.col("l_quantity") > 25
    entry = (
        table(spark, d, "lineitem")
        .groupBy("l_orderkey", F.col("l_linestatus").alias("category"))
        .agg(
            F.array_sort(F.collect_set(F.when(flagged, F.col("l_returnflag")))).alias("approved"),
            F.max("l_returnflag").alias("winner_variant_id"),
            F.lit(False).alias("bypass_realify"),
            F.collect_list(F.struct(F.col("l_linenumber").alias("id"), (F.col("l_tax") > 0.04).alias("bypass_realify"))).alias("stems"),
        )
    )
    fields = ("category", "approved", "winner_variant_id", "bypass_realify", "stems")
    documents = entry.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("categories"))
    return verification.entries(documents, "l_orderkey")


@named("SELECT l_orderkey, l_linestatus AS category, max(l_returnflag) AS winner_variant_id FROM lineitem GROUP BY ALL HAVING max(l_returnflag) <> ''")
def verified_winners(spark: SparkSession, d: str) -> DataFrame:
    return verification.winners(_verified(spark, d), "l_orderkey")


@named("SELECT l_orderkey, l_linestatus AS category, list_sort(list(DISTINCT l_returnflag)) AS approved FROM lineitem WHERE l_quantity > 25 GROUP BY ALL")
def verified_shortlists(spark: SparkSession, d: str) -> DataFrame:
    return verification.shortlists(_verified(spark, d), "l_orderkey")


@named("""
SELECT l_orderkey, l_linestatus AS category, CASE count(*) FILTER (l_tax > 0.04) WHEN count(*) THEN 'all' WHEN 0 THEN 'none' ELSE 'part' END AS bypassed
FROM lineitem GROUP BY ALL
""")
def verified_bypass(spark: SparkSession, d: str) -> DataFrame:
    return verification.bypass(_verified(spark, d), "l_orderkey")


@named("""
WITH e AS (SELECT l_orderkey, l_linestatus AS category, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus)::INT - 1 AS position,
  coalesce(list(l_returnflag) FILTER (l_quantity > 25), []) AS approved, max(l_returnflag) AS winner FROM lineitem GROUP BY l_orderkey, l_linestatus)
SELECT l_orderkey, position, category || ': approve at least one variant' AS error FROM e WHERE len(approved) = 0
UNION ALL SELECT l_orderkey, position, category || ': winner must be among approved variants' FROM e WHERE NOT list_contains(approved, winner)
""")
def verification_errors(spark: SparkSession, d: str) -> DataFrame:
    return verification.errors(_verified(spark, d), "l_orderkey")


@named("""
SELECT l_orderkey, l_linenumber, CASE WHEN bool_and(l_tax > 0.01) OVER (PARTITION BY l_orderkey) THEN l_tax ELSE l_discount END AS scale FROM lineitem
""")
def persisted_or_derived(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("stored"), "l_discount")
    return selection.persisted_or_derived(lines, "l_orderkey", "stored", "l_discount").select("l_orderkey", "l_linenumber", "scale")
