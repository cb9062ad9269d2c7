"""Set operations, duplicates and splits."""

from pyspark.sql import functions as F

from ..operators import frames as fr
from ..operators import sets as S
from .aggregates import YEARLY_SQL, yearly
from .registry import PANEL_A, query


@query("set_union", """SELECT 'order' AS kind, o_custkey AS key FROM orders WHERE o_orderpriority = '1-URGENT'
 UNION ALL SELECT 'balance', c_custkey FROM customer WHERE c_acctbal < 0""")
def set_union(t):
    a = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.lit("order").alias("kind"), F.col("o_custkey").alias("key"))
    b = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("key"), F.lit("balance").alias("kind"))
    return a.unionByName(b)


METHODS_SQL = f"""{PANEL_A}, lng AS (SELECT 'a' AS method, key, date, CASE WHEN x > 10.5 THEN x END AS v, date < DATE '1995-06-01' AS warmup FROM pa
 UNION ALL SELECT 'b', key, date, CASE WHEN qty > 50 THEN x END, false FROM pa UNION ALL SELECT 'c', key, date, x, NULL FROM pa)"""


def methods(t):
    p = t.panel_a()
    mk = lambda m, v, w: p.select(F.lit(m).alias("method"), "key", "date", v.alias("v"), w.alias("warmup"))
    x = F.col("x")
    return (mk("a", F.when(x > 10.5, x), F.col("date") < F.lit("1995-06-01").cast("date"))
            .unionByName(mk("b", F.when(F.col("qty") > 50, x), F.lit(False)))
            .unionByName(mk("c", x, F.lit(None).cast("boolean"))))


@query("set_intersect_keys", f"""WITH {METHODS_SQL} SELECT key, date FROM lng WHERE v IS NOT NULL AND NOT coalesce(warmup, false)
 GROUP BY 1, 2 HAVING count(DISTINCT method) = 3""")
def set_intersect_keys(t):
    return S.common_sample(methods(t), "v", 3)


@query("set_diff", f"WITH {YEARLY_SQL} SELECT a.year AS year, a.company AS company FROM y a ANTI JOIN y b ON a.company = b.company AND a.year = b.year + 1")
def set_diff(t):
    y = yearly(t)
    return y.join(y.select((F.col("year") + 1).alias("year"), "company"), ["year", "company"], "left_anti")


@query("set_jaccard", f"""WITH {YEARLY_SQL}, u AS (SELECT a.year AS year, count(b.company) AS nboth, count(*) AS na FROM y a LEFT JOIN y b ON a.company = b.company AND b.year = a.year - 1 GROUP BY 1),
 c AS (SELECT year, count(*) AS n FROM y GROUP BY 1)
 SELECT u.year AS year, r6(nboth / (na + c.n - nboth)) AS jaccard FROM u JOIN c ON c.year = u.year - 1""")
def set_jaccard(t):
    return S.jaccard_with_previous(yearly(t))


@query("set_dedup_key", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def set_dedup_key(t):
    return fr.first_per(t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"],
                        ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("set_dedup_news", """SELECT doc_id, source FROM documents
 QUALIFY row_number() OVER (PARTITION BY lang, substr(lower(text), 1, 100) ORDER BY doc_id) = 1""")
def set_dedup_news(t):
    return S.dedup_prefix(t.documents, ["lang"], "text", ["doc_id"], ["source"])


@query("set_unique_assert", f"WITH {PANEL_A}, d AS (SELECT key, date, count(*) AS c FROM pa GROUP BY 1, 2) SELECT CAST(count_if(c > 1) AS BIGINT) AS duplicates, CAST(count(*) AS BIGINT) AS keys FROM d")
def set_unique_assert(t):
    return S.assert_unique(t.panel_a(), ["key", "date"])


@query("set_alt_halves", """WITH k AS (SELECT DISTINCT o_custkey AS key FROM orders), d AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos FROM k)
 SELECT key, CAST(pos % 2 AS INTEGER) AS half FROM d""")
def set_alt_halves(t):
    return S.alternating_halves(t.orders.select(F.col("o_custkey").alias("key")))


@query("set_holdout_entities", f"""WITH {PANEL_A} SELECT f.key AS fold, CAST(count_if(pa.key <> f.key) AS BIGINT) AS n_train, CAST(count_if(pa.key = f.key) AS BIGINT) AS n_test,
 r6(avg(CASE WHEN pa.key <> f.key THEN x END)) AS train_mean, r6(avg(CASE WHEN pa.key = f.key THEN x END)) AS test_mean
 FROM pa, (SELECT DISTINCT key FROM pa) f GROUP BY 1""")
def set_holdout_entities(t):
    return S.leave_one_out_means(t.panel_a(), "key", "x")
