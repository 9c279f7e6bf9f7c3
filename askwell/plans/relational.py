"""The relational patterns of generated SQL, over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askwell.operators.relational import global_rank, in_top, not_in, percentiles
from askwell.plans.inputs import table
from askwell.plans.registry import query


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


@query("top_customers", """
    SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey LIMIT 10""")
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten customers with the most revenue. Revenue is summed per order, then per customer key, and names
    join the ten rows left."""
    items, orders, customers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    per_order = items.groupBy("l_orderkey").agg(F.sum(revenue()).alias("r"))
    per_customer = (
        per_order.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
        .groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("r"), 4).alias("revenue"))
    )
    best = per_customer.orderBy(F.desc("revenue"), "c_custkey").limit(10)
    return (
        customers.select("c_custkey", "c_name").join(best, "c_custkey")
        .select("c_custkey", "c_name", "revenue").orderBy(F.desc("revenue"), "c_custkey").limit(10)
    )


@query("first_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def first_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").limit(10)


@query("date_range_filter", """
    SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'
      AND o_totalprice > 100000 AND o_orderstatus = 'O'""")
def date_range_filter(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("1997-01-01", "1997-12-31"))
    wanted = F.col("o_orderdate").between(start, end) & (F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "O")
    return orders.filter(wanted).select("o_orderkey", "o_totalprice", day("o_orderdate").alias("order_day"))


@query("in_list", """
    SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE n_name IN ('NATION_1', 'NATION_7', 'NATION_19') GROUP BY n_name""")
def in_list(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").filter(F.col("n_name").isin("NATION_1", "NATION_7", "NATION_19"))
    customers = table(spark, sf_dir, "customer").select("c_nationkey")
    joined = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))


@query("like_filter", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%' OR p_name LIKE '%bolt%'")
def like_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.filter(F.col("p_name").like("red%") | F.col("p_name").like("%bolt%")).select("p_partkey", "p_name")


@query("ilike_filter", """
    SELECT c_mktsegment, count(*) AS n FROM customer
    WHERE c_mktsegment ILIKE '%hold%' OR c_name ILIKE 'customer#%7' GROUP BY c_mktsegment""")
def ilike_filter(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    wanted = F.col("c_mktsegment").ilike("%hold%") | F.col("c_name").ilike("customer#%7")
    return customers.filter(wanted).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("ratio_of_sums", """
    SELECT l_returnflag, sum(l_quantity) AS quantity, count(*) AS items, round(avg(l_tax), 6) AS mean_tax,
           max(l_extendedprice) AS top_price,
           round(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0), 6) AS discount_rate
    FROM lineitem GROUP BY l_returnflag""")
def ratio_of_sums(spark, sf_dir):
    rate = F.try_divide(F.sum(F.col("l_extendedprice") * F.col("l_discount")), F.sum("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("items"), F.round(F.avg("l_tax"), 6).alias("mean_tax"),
        F.max("l_extendedprice").alias("top_price"), F.round(rate, 6).alias("discount_rate"),
    )


@query("global_totals", """
    SELECT count(*) AS items, sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS price,
           round(avg(l_discount), 6) AS mean_discount FROM lineitem""")
def global_totals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(
        F.count(F.lit(1)).alias("items"), F.sum("l_quantity").alias("quantity"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"), F.round(F.avg("l_discount"), 6).alias("mean_discount"),
    )


@query("group_by_alias", """
    SELECT CASE WHEN o_totalprice >= 250000 THEN 'large' ELSE 'small' END AS size, CAST(year(o_orderdate) AS INT) AS year,
           count(*) AS n FROM orders GROUP BY 1, 2""")
def group_by_alias(spark, sf_dir):
    size = F.when(F.col("o_totalprice") >= 250000, "large").otherwise("small").alias("size")
    return table(spark, sf_dir, "orders").groupBy(size, F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("having_filter", """
    SELECT l_suppkey, round(avg(l_extendedprice), 6) AS mean_price, count(*) AS n FROM lineitem
    GROUP BY l_suppkey HAVING avg(l_discount) > 0.05 AND count(*) > 10 ORDER BY mean_price DESC, l_suppkey""")
def having_filter(spark, sf_dir):
    groups = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.avg("l_extendedprice"), 6).alias("mean_price"), F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("d")
    )
    return groups.filter("d > 0.05 and n > 10").drop("d").orderBy(F.desc("mean_price"), "l_suppkey")


@query("count_distinct", """
    SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority""")
def count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"))


@query("distinct_values", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("conditional_share", """
    SELECT l_linestatus, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned,
           round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 100.0 / count(*), 4) AS returned_pct
    FROM lineitem GROUP BY l_linestatus""")
def conditional_share(spark, sf_dir):
    returned = F.count_if(F.col("l_returnflag") == "R")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        returned.alias("returned"), F.round(returned * 100.0 / F.count(F.lit(1)), 4).alias("returned_pct")
    )


@query("case_buckets", """
    SELECT CASE WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN 'closed, large'
                WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_totalprice > 300000 THEN 'large' ELSE 'other' END AS bucket,
           count(*) AS n, round(avg(o_totalprice), 6) AS mean_price FROM orders GROUP BY 1""")
def case_buckets(spark, sf_dir):
    closed, large = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 300000
    bucket = F.when(closed & large, "closed, large").when(closed, "closed").when(large, "large").otherwise("other")
    return table(spark, sf_dir, "orders").groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean_price")
    )


@query("join_roles", """
    SELECT s.n_name AS from_nation, c.n_name AS to_nation, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation s ON s_nationkey = s.n_nationkey
    JOIN nation c ON c_nationkey = c.n_nationkey GROUP BY 1, 2""")
def join_roles(spark, sf_dir):
    """Revenue by selling and buying nation: summed by the nations' keys, names joined last."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", revenue().alias("r"))
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    buyers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    sums = (
        items.join(sellers, "l_suppkey").join(orders.join(buyers, "c_custkey"), "l_orderkey")
        .groupBy("s_nationkey", "c_nationkey").agg(F.round(F.sum("r"), 4).alias("revenue"))
    )
    nation = table(spark, sf_dir, "nation")
    seller = nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("from_nation"))
    buyer = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("to_nation"))
    return sums.join(seller, "s_nationkey").join(buyer, "c_nationkey").select("from_nation", "to_nation", "revenue")


@query("join_where", """
    SELECT c_mktsegment, count(*) AS orders FROM orders, customer
    WHERE o_custkey = c_custkey AND c_acctbal < 0 GROUP BY c_mktsegment""")
def join_where(spark, sf_dir):
    """The join condition written in WHERE; Catalyst makes an equi-join of it."""
    return spark.sql(
        """SELECT c_mktsegment, count(*) AS orders FROM {orders} AS o, {customer} AS c
           WHERE o.o_custkey = c.c_custkey AND c.c_acctbal < 0 GROUP BY c_mktsegment""",
        orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"),
    )


@query("period_growth", """
    WITH a AS (SELECT o_custkey, sum(o_totalprice) AS x FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1),
         b AS (SELECT o_custkey, sum(o_totalprice) AS y FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1)
    SELECT a.o_custkey, round(x, 2) AS before, round(y, 2) AS after, round((y - x) / x * 100, 2) AS growth_pct
    FROM a JOIN b ON a.o_custkey = b.o_custkey""")
def period_growth(spark, sf_dir):
    """Two periods joined by key; both sides come from one scan and one grouping."""
    year = F.year("o_orderdate")
    both = (
        table(spark, sf_dir, "orders").filter(year.isin(1997, 1998)).groupBy("o_custkey")
        .agg(F.sum(F.when(year == 1997, F.col("o_totalprice"))).alias("x"), F.sum(F.when(year == 1998, F.col("o_totalprice"))).alias("y"))
        .filter("x is not null and y is not null")
    )
    return both.select(
        "o_custkey", F.round("x", 2).alias("before"), F.round("y", 2).alias("after"),
        F.round(F.try_divide(F.col("y") - F.col("x"), F.col("x")) * 100, 2).alias("growth_pct"),
    )


@query("join_star", """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, n_nationkey, n_name, n_regionkey, r_regionkey, r_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def join_star(spark, sf_dir):
    customers, nations, regions = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")
    )


@query("in_top_n", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (
      SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 5)""")
def in_top_n(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return in_top(orders, "o_custkey", [F.desc("n"), F.asc("o_custkey")], 5).select("o_orderkey", "o_custkey", "o_totalprice")


@query("not_in_subquery", """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def not_in_subquery(spark, sf_dir):
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select("o_custkey")
    return not_in(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", large, "o_custkey")


@query("share_of_total", """
    SELECT o_orderstatus, round(sum(o_totalprice) * 100 / (SELECT sum(o_totalprice) FROM orders), 4) AS pct,
           count(CASE WHEN o_totalprice > (SELECT avg(o_totalprice) FROM orders) THEN 1 END) AS above_mean
    FROM orders GROUP BY o_orderstatus""")
def share_of_total(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    total, mean = orders.agg(F.sum("o_totalprice")).scalar(), orders.agg(F.avg("o_totalprice")).scalar()
    marked = orders.withColumn("above", F.col("o_totalprice") > mean)
    sums = marked.groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("s"), F.count_if("above").alias("above_mean"))
    return sums.select("o_orderstatus", F.round(F.col("s") * 100 / total, 4).alias("pct"), "above_mean")


@query("cte_top_suppliers", """
    WITH revenue AS (SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS r FROM lineitem GROUP BY 1),
         good AS (SELECT l_suppkey, r FROM revenue WHERE r > (SELECT avg(r) FROM revenue))
    SELECT s_suppkey, s_name, round(r, 4) AS revenue FROM good JOIN supplier ON s_suppkey = l_suppkey""")
def cte_top_suppliers(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(revenue()).alias("r"))
    good = sums.filter(F.col("r") > sums.agg(F.avg("r")).scalar())
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return good.join(suppliers, F.col("s_suppkey") == F.col("l_suppkey")).select(
        "s_suppkey", "s_name", F.round("r", 4).alias("revenue")
    )


def _parties(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("party"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"))
    suppliers = table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("party"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    return customers.unionByName(suppliers)


_PARTIES = """SELECT 'customer' AS party, c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer
    UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier"""


@query("union_all_sources", _PARTIES)
def union_all_sources(spark, sf_dir):
    return _parties(spark, sf_dir)


@query("union_distinct", """
    SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal < 0
    UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000""")
def union_distinct(spark, sf_dir):
    owing = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("nationkey"))
    rich = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("nationkey"))
    return owing.union(rich).distinct()


@query("union_then_agg", f"""
    SELECT party, nationkey, count(*) AS n, round(sum(acctbal), 2) AS balance FROM ({_PARTIES}) GROUP BY 1, 2""")
def union_then_agg(spark, sf_dir):
    return _parties(spark, sf_dir).groupBy("party", "nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("acctbal"), 2).alias("balance")
    )


@query("yoy_growth", """
    WITH y AS (SELECT CAST(year(o_orderdate) AS INT) AS year, sum(o_totalprice) AS s FROM orders GROUP BY 1)
    SELECT year, round(s, 2) AS total, round((s - lag(s) OVER (ORDER BY year)) / lag(s) OVER (ORDER BY year) * 100, 4) AS growth_pct
    FROM y""")
def yoy_growth(spark, sf_dir):
    """Growth against the year before; the window sees one row per year."""
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("s"))
    lag = F.lag("s").over(Window.orderBy("year"))
    return years.select("year", F.round("s", 2).alias("total"), F.round((F.col("s") - lag) / lag * 100, 4).alias("growth_pct"))


@query("spearman", """
    WITH r AS (SELECT rank() OVER (ORDER BY p_retailprice) AS a, rank() OVER (ORDER BY p_size) AS b FROM part)
    SELECT round(corr(a, b), 6) AS rank_correlation FROM r""")
def spearman(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_retailprice", "p_size")
    a = global_rank(part, "p_retailprice", "a").drop("n")
    b = global_rank(part, "p_size", "b").drop("n")
    pairs = part.groupBy("p_retailprice", "p_size").agg(F.count(F.lit(1)).alias("n"))
    ranked = pairs.join(a, "p_retailprice").join(b, "p_size")
    n = F.col("n").cast("double")
    x, y = F.col("a").cast("double"), F.col("b").cast("double")
    mean_x, mean_y = (F.sum(n * v) / F.sum(n) for v in (x, y))
    means = ranked.agg(mean_x.alias("mx"), mean_y.alias("my"))
    dx, dy = x - means.select("mx").scalar(), y - means.select("my").scalar()
    parts = ranked.select((n * dx * dy).alias("xy"), (n * dx * dx).alias("xx"), (n * dy * dy).alias("yy"))
    return parts.agg(F.round(F.sum("xy") / F.sqrt(F.sum("xx") * F.sum("yy")), 6).alias("rank_correlation"))


@query("top3_per_group", """
    SELECT * REPLACE (CAST(place AS INT) AS place) FROM (SELECT p_brand, p_partkey, p_retailprice,
      rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS place FROM part) WHERE place <= 3""")
def top3_per_group(spark, sf_dir):
    place = F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice")))
    return (
        table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice").withColumn("place", place)
        .filter("place <= 3")
    )


@query("pct_of_total", """
    SELECT l_suppkey, round(sum(l_quantity), 2) AS quantity, round(sum(l_quantity) * 100 / sum(sum(l_quantity)) OVER (), 6) AS pct
    FROM lineitem GROUP BY l_suppkey""")
def pct_of_total(spark, sf_dir):
    """The sum over all groups is a scalar subquery, not a window over every group in one task."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    total = table(spark, sf_dir, "lineitem").agg(F.sum("l_quantity")).scalar()
    return sums.select("l_suppkey", F.round("q", 2).alias("quantity"), F.round(F.col("q") * 100 / total, 6).alias("pct"))


@query("zscore_outliers", """
    WITH s AS (SELECT o_custkey, sum(o_totalprice) AS x FROM orders GROUP BY 1),
         z AS (SELECT o_custkey, x, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS z FROM s)
    SELECT o_custkey, round(x, 2) AS total, round(z, 6) AS z FROM z WHERE abs(z) > 2""")
def zscore_outliers(spark, sf_dir):
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("x"))
    facts = sums.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    scored = sums.withColumn("z", (F.col("x") - facts.select("m").scalar()) / facts.select("s").scalar())
    return scored.filter(F.abs("z") > 2).select("o_custkey", F.round("x", 2).alias("total"), F.round("z", 6).alias("z"))


@query("percentiles", """
    SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95,
           round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY l_returnflag""")
def percentile_query(spark, sf_dir):
    found = percentiles(
        table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    )
    return found.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")])


@query("median_by_group", """
    SELECT o_orderpriority, round(median(o_totalprice), 4) AS median_price FROM orders GROUP BY o_orderpriority""")
def median_by_group(spark, sf_dir):
    found = percentiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"median_price": 0.5})
    return found.select("o_orderpriority", F.round("median_price", 4).alias("median_price"))


@query("correlations", """
    SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(stddev_samp(l_extendedprice), 4) AS sd,
           round(abs(avg(l_quantity) - 25), 6) AS off FROM lineitem GROUP BY l_returnflag""")
def correlations(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("c"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("sd"),
        F.round(F.abs(F.avg("l_quantity") - 25), 6).alias("off"),
    )


@query("substr_flags", """
    SELECT substr(c_name, 1, 8) AS kind, substr(c_name, 18, 1) AS last_digit, upper(c_mktsegment) AS segment, count(*) AS n
    FROM customer GROUP BY 1, 2, 3""")
def substr_flags(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(
        F.substring("c_name", 1, 8).alias("kind"), F.substring("c_name", 18, 1).alias("last_digit"),
        F.upper("c_mktsegment").alias("segment"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("by_year", """
    SELECT CAST(year(l_shipdate) AS INT) AS year, date_part('month', l_shipdate) AS month, count(*) AS n
    FROM lineitem GROUP BY 1, 2""")
def by_year(spark, sf_dir):
    month = F.date_part(F.lit("month"), "l_shipdate")
    return table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year"), month.cast("bigint").alias("month")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("by_quarter", """
    SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter_start, CAST(quarter(o_orderdate) AS INT) AS quarter,
           round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2""")
def by_quarter(spark, sf_dir):
    start = F.date_format(F.date_trunc("quarter", "o_orderdate"), "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").groupBy(start.alias("quarter_start"), F.quarter("o_orderdate").alias("quarter")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("by_weekday", """
    SELECT CAST(dayofweek(ts) + 1 AS INT) AS weekday, CASE dayofweek(ts) WHEN 0 THEN 'Sunday' WHEN 6 THEN 'Saturday' ELSE 'working day' END AS name,
           count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2""")
def by_weekday(spark, sf_dir):
    weekday = F.dayofweek("ts")
    name = F.when(weekday == 1, "Sunday").when(weekday == 7, "Saturday").otherwise("working day")
    return table(spark, sf_dir, "events").groupBy(weekday.alias("weekday"), name.alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value")
    )


AS_OF = "2024-01-30"


@query("last_30_days", f"""
    SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events
    WHERE ts >= DATE '{AS_OF}' - INTERVAL 30 DAY AND ts < DATE '{AS_OF}' GROUP BY user_id""")
def last_days(spark, sf_dir):
    end = F.lit(AS_OF).cast("date")
    wanted = (F.col("ts") >= F.date_sub(end, 30).cast("timestamp_ntz")) & (F.col("ts") < end.cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").filter(wanted).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query("daily_by_key", """
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total
    FROM events GROUP BY 1, 2 ORDER BY 1, 2""")
def daily_by_key(spark, sf_dir):
    return (
        table(spark, sf_dir, "events").groupBy(day("ts").alias("day"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).orderBy("day", "event_type")
    )
