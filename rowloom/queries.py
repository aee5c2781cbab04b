"""One query for each operator over the test tables, with the same question as SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowloom.operators.position import omitmap
from rowloom.plans.view import View
from rowloom.sources.tables import countview, iota, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}
KEYS["lineitem"] = "l_orderkey l_linenumber"  # not unique: for queries that don't ask for positions


def query(sql: str) -> Callable[[Callable], Callable]:
    """Registers a query under its function's name. It gets a function that opens a table as a view and returns a view or a frame."""

    def register(fn: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def table(name: str, *columns: str) -> View:
                v = read_table(spark, f"{sf_dir}/{name}.parquet", KEYS[name].split())
                return v.colmap(columns) if columns else v

            out = fn(table)
            return out.frame() if isinstance(out, View) else out

        QUERIES[fn.__name__] = run
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


# -- joins and nesting


@query("SELECT c.c_custkey AS custkey, c_name, o_orderkey, o_totalprice FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey")
def ijoin_customer_orders(t):
    return t("customer", "c_custkey", "c_name").rename("c_custkey", "custkey").ijoin(t("orders", "o_custkey", "o_orderkey", "o_totalprice").rename("o_custkey", "custkey"))


@query("SELECT c_custkey AS custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_counts(t):
    left, right = t("customer", "c_custkey").rename("c_custkey", "custkey"), t("orders", "o_custkey", "o_orderkey").rename("o_custkey", "custkey")
    return left.join(right, "orders").with_counts("n")


@query("SELECT c_custkey AS custkey, count(o_orderkey) AS n, coalesce(sum(o_orderkey), 0)::BIGINT AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_nested(t):
    left, right = t("customer", "c_custkey").rename("c_custkey", "custkey"), t("orders", "o_custkey", "o_orderkey").rename("o_custkey", "custkey")
    return left.join(right, "orders").frame().select("custkey", F.size("orders").cast("long").alias("n"), F.aggregate("orders", F.lit(0).cast("long"), lambda a, x: a + x["o_orderkey"]).alias("keys"))


@query("SELECT n_nationkey AS nationkey, n_name, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey")
def join_ungroup(t):
    return t("nation", "n_nationkey", "n_name").rename("n_nationkey", "nationkey").join(t("customer", "c_nationkey", "c_custkey").rename("c_nationkey", "nationkey"), "people").ungroup("people")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def product_small(t):
    return t("region", "r_name").product(t("nation", "n_name"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def group_counts(t):
    return t("events", "event_type", "event_id").group(["event_type"], "rows").with_counts("n")


@query("SELECT n_regionkey, count(*) AS n, sum(n_nationkey)::BIGINT AS keys, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def group_nested(t):
    rows = F.col("rows")
    return t("nation", "n_regionkey", "n_nationkey", "n_name").group(["n_regionkey"], "rows").frame().select("n_regionkey", F.size(rows).cast("long").alias("n"), F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + x["n_nationkey"]).alias("keys"), F.concat_ws(",", rows["n_name"]).alias("names"))


@query("SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS least, max(o_orderkey) AS most FROM orders GROUP BY 1")
def group_sum(t):
    return t("orders", "o_orderstatus", "o_totalprice", "o_orderkey").group_aggregate(["o_orderstatus"], total=F.round(F.sum("o_totalprice"), 2), least=F.min("o_orderkey"), most=F.max("o_orderkey"))


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def group_roundtrip(t):
    return t("nation", "n_regionkey", "n_nationkey", "n_name").group(["n_regionkey"], "rows").freeze().ungroup("rows")


@query("SELECT g.g AS g, count(*) AS n, min(n_nationkey) AS least FROM (SELECT n_nationkey, CASE WHEN row_number() OVER (ORDER BY n_nationkey) <= 10 THEN 0 ELSE 1 END AS g FROM nation) g GROUP BY 1")
def grouped_ends(t):
    n = t("nation", "n_nationkey").df.count()
    rows = F.col("rows")
    return t("nation", "n_nationkey").grouped([10, n], range(n), "rows").tag("g").frame().select(F.col("g").cast("int").alias("g"), F.size(rows).cast("long").alias("n"), F.array_min(F.transform(rows, lambda x: x["n_nationkey"])).alias("least"))


@query("SELECT k, row_number() OVER (ORDER BY b, s, p) - 1 AS at FROM (SELECT n_nationkey AS k, n_regionkey AS b, 0 AS s, n_nationkey AS p FROM nation WHERE n_regionkey < 4 UNION ALL SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1, 1, 0 FROM nation WHERE n_regionkey = 4)")
def blocked_nations(t):
    return t("nation", "n_regionkey", "n_nationkey").rename("n_nationkey", "k").sorton("n_regionkey", "k").group(["n_regionkey"], "rows").onecol("rows").blocked().tag("at")


# -- sets and frequencies


@query("SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2")
def freq_status(t):
    return t("orders", "o_orderstatus", "o_orderpriority").freq("n")


@query("SELECT DISTINCT p_brand FROM part")
def unique_brand(t):
    return t("part", "p_brand").unique()


@query("SELECT DISTINCT p_brand, p_size FROM part")
def project_brand(t):
    return t("part").project(["p_brand", "p_size"])


@query("SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def union_keep_dups(t):
    return t("orders", "o_custkey").rename("o_custkey", "k").union(t("customer", "c_custkey"))


@query("SELECT o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def except_keep_dups(t):
    from rowloom import OPERATORS

    return OPERATORS["except"](t("orders", "o_custkey"), t("customer").where("c_acctbal > 0").onecol("c_custkey"))


@query("SELECT o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def intersect_keep_dups(t):
    return t("orders", "o_custkey").intersect(t("customer").where("c_acctbal > 0").onecol("c_custkey"))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def concat_names(t):
    return t("nation", "n_name").rename("n_name", "name").concat(t("region", "r_name"))


_PLACED = "WITH c AS (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_custkey) - 1 AS index FROM customer), s AS (SELECT s_nationkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS index FROM supplier) "


@query(_PLACED + "SELECT index FROM c WHERE EXISTS (SELECT 1 FROM s WHERE s_nationkey = c_nationkey)")
def isectmap_rids(t):
    return t("customer", "c_nationkey").isectmap(t("supplier", "s_nationkey"))


@query(_PLACED + "SELECT index FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s_nationkey = c_nationkey AND s_nationkey < 10)")
def exceptmap_rids(t):
    return t("customer", "c_nationkey").exceptmap(t("supplier").where("s_nationkey < 10").onecol("s_nationkey"))


@query(_PLACED + "SELECT index FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE s_nationkey = c_nationkey AND c_custkey < 100)")
def unionmap_rids(t):
    return t("customer").where("c_custkey < 100").onecol("c_nationkey").unionmap(t("supplier", "s_nationkey"))


@query(_PLACED + "SELECT min(index) AS index FROM c GROUP BY c_nationkey")
def uniquemap_rids(t):
    return t("customer", "c_nationkey").uniquemap()


# -- expressions


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def where_pred(t):
    return t("orders").where("o_totalprice > 200000 AND o_orderstatus = 'O'").colmap(["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r % 7 = 3")
def where_row_number(t):
    return t("orders", "o_orderkey").where("`#` % 7 = 3")


@query("SELECT r AS index FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE o_totalprice > 300000")
def index_pred(t):
    return t("orders").index("o_totalprice > 300000")


@query("SELECT round(l_extendedprice * (1 - l_discount), 4) AS price FROM lineitem WHERE l_quantity > 45")
def compute_price(t):
    return t("lineitem").where("l_quantity > 45").compute("price", "round(l_extendedprice * (1 - l_discount), 4)")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, o_orderstatus FROM orders) WHERE o_orderstatus <> 'F'")
def pick_mask(t):
    return t("orders", "o_orderkey").pick(t("orders").compute("m", "cast(o_orderstatus <> 'F' as int)"))


# -- order and position


@query("SELECT p_brand, p_size, p_partkey, row_number() OVER (ORDER BY p_brand, p_size, p_partkey) - 1 AS at FROM part")
def sort_all(t):
    return t("part", "p_brand", "p_size", "p_partkey").sort().tag("at")


@query("SELECT c_mktsegment, c_acctbal, c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_nationkey DESC, c_custkey) - 1 AS at FROM customer")
def sorton_mixed(t):
    return t("customer").sorton("c_mktsegment", "-", "c_acctbal", "c_nationkey").colmap(["c_mktsegment", "c_acctbal", "c_custkey"]).tag("at")


@query("SELECT i AS index, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS at FROM (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer)")
def sortmap_nation(t):
    return t("customer", "c_nationkey").sortmap().tag("at")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def first_n(t):
    return t("orders", "o_orderkey", "o_totalprice").first(25)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS at FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 25)")
def last_n(t):
    return t("orders", "o_orderkey").last(25).tag("at")


_NATIONS = "WITH v AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS r, count(*) OVER () AS n FROM nation) "


@query(_NATIONS + "SELECT n_name, pos FROM range(60) x(pos) JOIN v ON r = pos % n")
def take_wrap(t):
    return t("nation", "n_name").take(60).tag("pos")


@query(_NATIONS + "SELECT n_name, pos FROM range(60) x(pos) JOIN v ON r = ((n - 1 - pos % n) % n + n) % n")
def take_back(t):
    return t("nation", "n_name").take(-60).tag("pos")


@query(_NATIONS + "SELECT n_name, pos FROM range(20) x(pos) JOIN v ON r = (3 + 7 * pos) % n")
def slice_step(t):
    return t("nation", "n_name").slice(3, 7, 20).tag("pos")


@query(_NATIONS + "SELECT n_name, pos FROM range(30) x(pos) JOIN v ON r = ((5 + 4 * (pos // 3)) % n + n) % n")
def step_wrap(t):
    return t("nation", "n_name").step(10, 5, 3, 4).tag("pos")


@query(_NATIONS + "SELECT n_name, n - 1 - r AS at FROM v")
def reverse_tag(t):
    return t("nation", "n_name").reverse().tag("at")


@query(_NATIONS + "SELECT n_name, k * n + r AS at FROM v, range(2) x(k)")
def repeat_2(t):
    return t("nation", "n_name").repeat(2).tag("at")


@query(_NATIONS + "SELECT n_name, r * 3 + k AS at FROM v, range(3) x(k)")
def spread_3(t):
    return t("nation", "n_name").spread(3).tag("at")


@query(_NATIONS + "SELECT n_name, pos FROM (VALUES (0, 4), (1, 2), (2, 4), (3, 0), (4, 2), (5, 24)) x(pos, s) JOIN v ON r = s")
def remap_list(t):
    return t("nation", "n_name").remap([4, 2, -2, 0, -3, 24]).tag("pos")


@query(_NATIONS + "SELECT r AS index FROM v WHERE r NOT IN (3, 1, 7)")
def omitmap_list(t):
    v = t("nation", "n_name")
    return omitmap(v.spark, [3, 1, 7, 3], v.size())


@query("SELECT n_name, s_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) USING (r)")
def pair_zip(t):
    return t("nation", "n_name").pair(t("supplier", "s_name"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS at FROM orders")
def tag_rows(t):
    return t("orders", "o_orderkey").tag("at")


@query("SELECT range AS i FROM range(10)")
def iota_ten(t):
    return iota(t("region").spark, 10, "i")


@query("SELECT 12::BIGINT AS n")
def countview_size(t):
    v = countview(t("region").spark, 12)
    return v.df.agg(F.count(F.lit(1)).alias("n"))


# -- aggregates


@query("SELECT max(l_extendedprice) AS most, min(l_extendedprice) AS least, round(sum(l_quantity), 2) AS total, max(l_shipdate) AS latest FROM lineitem")
def max_min_sum(t):
    return t("lineitem").group_aggregate([], most=F.max("l_extendedprice"), least=F.min("l_extendedprice"), total=F.round(F.sum("l_quantity"), 2), latest=F.max("l_shipdate"))


# -- columns and schema


@query("SELECT n_name AS a, n_nationkey AS b, n_name AS c FROM nation")
def colmap_dup(t):
    return t("nation").colmap(["n_name", 0, -2]).rename(0, "a", 1, "b", 2, "c")


@query("SELECT n_nationkey, n_regionkey FROM nation")
def colomit_cols(t):
    return t("nation").colomit(["n_name", "n_name"])


@query("SELECT n_nationkey AS n_name, n_name AS n_nationkey, n_regionkey FROM nation")
def rename_swap(t):
    return t("nation").rename("n_nationkey", "n_name", "n_name", "n_nationkey")


@query("SELECT n_name FROM nation")
def onecol(t):
    return t("nation").onecol("n_name")


@query("SELECT * FROM (VALUES ('n_nationkey', 'I', ''), ('n_name', 'S', ''), ('n_regionkey', 'I', '')) x(name, type, subv)")
def meta_rows(t):
    return t("nation").meta()


@query("SELECT * FROM (VALUES ('n_nationkey'), ('n_name'), ('n_regionkey')) x(name)")
def namecol_rows(t):
    return t("nation").namecol()


@query("SELECT count(*) AS n FROM nation WHERE false")
def clone_empty(t):
    return t("nation").clone().df.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT max(CASE r_regionkey WHEN 0 THEN v END) AS x0, max(CASE r_regionkey WHEN 1 THEN v END) AS x1, max(CASE r_regionkey WHEN 2 THEN v END) AS x2, max(CASE r_regionkey WHEN 3 THEN v END) AS x3, max(CASE r_regionkey WHEN 4 THEN v END) AS x4 FROM (SELECT r_regionkey, 0 AS p, r_regionkey::VARCHAR AS v FROM region UNION ALL SELECT r_regionkey, 1, r_name FROM region) GROUP BY p")
def transpose_small(t):
    return t("region").transpose()


# -- changes

_ROWS = "WITH v AS (SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) "


@query(_ROWS + "SELECT n_nationkey, CASE WHEN r = 3 THEN 'X' ELSE n_name END AS n_name, CASE WHEN r = 3 THEN 9 ELSE n_regionkey END AS n_regionkey FROM v")
def set_cell(t):
    return t("nation").set(3, "n_name", "X", "n_regionkey", 9)


@query(_ROWS + "SELECT n_nationkey, n_name, n_regionkey, CASE WHEN r < 2 THEN r ELSE r + 3 END AS at FROM v UNION ALL SELECT n_nationkey, n_name, n_regionkey, r - 8 FROM v WHERE r BETWEEN 10 AND 12")
def insert_rows(t):
    return t("nation").insert(2, t("nation").slice(10, 1, 3)).tag("at")


@query(_ROWS + "SELECT n_nationkey, n_name, n_regionkey FROM v WHERE r NOT BETWEEN 4 AND 8")
def delete_rows(t):
    return t("nation").delete(4, 5)


@query(_ROWS + "SELECT n_nationkey, n_name, n_regionkey, CASE WHEN r < 5 THEN r ELSE r - 3 END AS at FROM v WHERE r < 5 OR r >= 10 UNION ALL SELECT n_nationkey, n_name, n_regionkey, r + 5 FROM v WHERE r < 2")
def replace_rows(t):
    return t("nation").replace(5, 5, t("nation").first(2)).tag("at")


@query(_ROWS + "SELECT n_nationkey, n_name, n_regionkey, r AS at FROM v UNION ALL SELECT n_nationkey, n_name, n_regionkey, r + count(*) OVER () FROM v")
def append_rows(t):
    return t("nation").append(t("nation")).tag("at")


@query(_ROWS + "SELECT n_nationkey, CASE WHEN r = 6 THEN 'Y' ELSE n_name END AS n_name, n_regionkey, CASE WHEN r = 0 THEN 0 WHEN r >= 3 THEN r - 1 END AS at FROM v WHERE r NOT IN (1, 2) UNION ALL SELECT n_nationkey, n_name, n_regionkey, 1 FROM v WHERE r = 20")
def apply_changes(t):
    base = t("nation")
    edited = base.delete(1, 2).set(4, "n_name", "Y").insert(1, base.slice(20, 1, 1))
    return base.loadmods(edited.emitmods(base)).tag("at")


@query("SELECT * FROM (VALUES ('delete', 1), ('delete', 2), ('adjust', 6), ('insert', 1)) x(kind, pos)")
def emit_changes(t):
    base = t("nation")
    return base.delete(1, 2).set(4, "n_name", "Y").insert(1, base.slice(20, 1, 1)).emitmods(base).select("kind", F.col("at").cast("int").alias("pos"))


@query("SELECT r AS position, CASE WHEN r IN (1, 2) THEN 1 ELSE 0 END AS deleted FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation)")
def mutinfo_deleted(t):
    base = t("nation")
    return base.delete(1, 2).mutinfo(base)["deleted"].rename("flag", "deleted").tag("position")


# -- lists, lookups, selection


@query("WITH b AS (SELECT event_id, (event_type = 'click')::INT AS bit, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events), s AS (SELECT r, bit FROM (SELECT *, lag(bit) OVER (ORDER BY r) AS was FROM b) WHERE was IS NULL OR was <> bit) SELECT 0 AS at, bit::BIGINT AS run FROM s WHERE r = 0 UNION ALL SELECT row_number() OVER (ORDER BY r), coalesce(lead(r) OVER (ORDER BY r), (SELECT count(*) FROM b)) - r FROM s")
def bitruns_events(t):
    return t("events").compute("bit", "cast(event_type = 'click' as int)").bitruns("bit").tag("at")


@query("SELECT r AS at, n_regionkey AS k FROM (SELECT n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) WHERE r < 2 UNION ALL SELECT r, 0 FROM range(2, 5) x(r) UNION ALL SELECT r + 3, n_regionkey FROM (SELECT n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) WHERE r >= 2")
def resizecol_zeros(t):
    return t("nation", "n_regionkey").rename("n_regionkey", "k").resizecol(2, 3).tag("at")


@query("WITH v AS (SELECT c_nationkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer), f AS (SELECT k, row_number() OVER (ORDER BY min(r)) - 1 AS g FROM v GROUP BY k) SELECT r AS position, g AS \"group\", row_number() OVER (PARTITION BY g ORDER BY r) - 1 AS place FROM v JOIN f USING (k)")
def getinfo_groups(t):
    return t("customer", "c_nationkey").getinfo()


_PARTS = "WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS index FROM part) "


@query(_PARTS + "SELECT index FROM p WHERE p_name LIKE 'blue%' OR p_name LIKE '%widget' AND p_type LIKE '%M_' ")
def select_glob(t):
    return t("part").select([("glob", "p_name", "blue*")]).union(t("part").select([("glob", "p_name", "*wid[gh]et"), ("glob", "p_type", "*M?")])).unique()


@query(_PARTS + "SELECT index FROM p WHERE p_name ILIKE 'red%'")
def select_globnc(t):
    return t("part").select([("globnc", "p_name", "RED*")])


@query(_PARTS + "SELECT index FROM p WHERE p_type = 'PROMO' AND p_size = 10")
def select_exact(t):
    return t("part").select([("exact", "p_type", "PROMO"), ("exact", "p_size", 10)])


@query(_PARTS + "SELECT index, row_number() OVER (ORDER BY p_size, index) - 1 AS at FROM p WHERE p_type = 'PROMO' ORDER BY p_size, index LIMIT 10 OFFSET 3")
def select_first_count(t):
    return t("part").select([("exact", "p_type", "PROMO")], sort=["p_size"], first=3, count=10).tag("n").compute("at", "n + 3").pair(t("part").select([("exact", "p_type", "PROMO")], sort=["p_size"], first=3, count=10))


@query("SELECT index FROM (SELECT p_type, p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS index FROM part) WHERE regexp_matches(p_type, '\\bst', 'i') OR regexp_matches(p_brand, '\\bst', 'i')")
def select_keyword(t):
    return t("part").select([("keyword", ["p_type", "p_brand"], "st")])


@query("SELECT index, row_number() OVER (ORDER BY c_mktsegment DESC, index DESC) - 1 AS at FROM (SELECT c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS index FROM customer) ORDER BY c_mktsegment DESC, index DESC LIMIT 40 OFFSET 5")
def select_rsort(t):
    found = t("customer").select(rsort=["c_mktsegment"])
    return found.tag("at").where("at >= 5").first(40)


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN a.n_regionkey < b.n_regionkey OR a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name THEN -1 WHEN a.n_regionkey = b.n_regionkey AND a.n_name = b.n_name THEN 0 ELSE 1 END AS s FROM nation a, nation b")
def compare_rows(t):
    from rowloom.operators.sorting import sign

    both = t("nation", "n_regionkey", "n_name", "n_nationkey").product(t("nation", "n_regionkey", "n_name", "n_nationkey"))
    return both.df.select(F.col("c2").alias("a"), F.col("c5").alias("b"), sign([(F.col("c0"), F.col("c3")), (F.col("c1"), F.col("c4"))]).alias("s"))


# -- hashes: what counts is which values or rows have equal ones


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_regionkey = b.n_regionkey AS same FROM nation a, nation b")
def hashcol_pairs(t):
    hashes = t("nation", "n_regionkey").hashcol("n_regionkey").tag("k")
    return hashes.product(hashes).df.select(F.col("c1").alias("a"), F.col("c3").alias("b"), (F.col("c0") == F.col("c2")).alias("same"))


@query("SELECT min(r) AS least, count(*) AS n FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) GROUP BY c_nationkey, c_mktsegment")
def hash_rows(t):
    return t("customer", "c_nationkey", "c_mktsegment").hashview().tag("r").group_aggregate(["hash"], least=F.min("r"), n=F.count("r")).colomit(["hash"])


@query("SELECT a.n_nationkey AS row, a.n_regionkey = b.n_regionkey AS same FROM nation a JOIN nation b ON b.n_nationkey = 6 WHERE a.n_nationkey IN (1, 2)")
def rowhash_same(t):
    v = t("nation", "n_regionkey")
    return _values(t, "row int, same boolean", *((i, v.rowhash(i) == v.rowhash(6)) for i in (1, 2)))


@query("WITH v AS (SELECT c_nationkey AS k, c_mktsegment AS m, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) SELECT w AS wanted, min(v.r) AS found FROM v JOIN (SELECT k, m, r AS w FROM v WHERE r IN (50, 99)) USING (k, m) GROUP BY 1 UNION ALL SELECT -1, -1")
def hashfind_rows(t):
    v = t("customer", "c_nationkey", "c_mktsegment")
    none = t("nation").compute("k", "n_nationkey + 1000").first(1).pair(t("region", "r_name"))
    return _values(t, "wanted long, found long", *((i, v.hashfind(i, v)) for i in (50, 99)), (-1, none.hashfind(0, v)))


@query("WITH s AS (SELECT s_nationkey AS k, row_number() OVER (ORDER BY s_suppkey) - 1 AS r FROM supplier WHERE s_nationkey < 10), f AS (SELECT k, row_number() OVER (ORDER BY min(r)) - 1 AS g FROM s GROUP BY k), v AS (SELECT c_nationkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) SELECT r AS position, g AS \"group\", row_number() OVER (PARTITION BY g ORDER BY r) - 1 AS place FROM v JOIN f USING (k)")
def getinfo_two_views(t):
    return t("supplier").where("s_nationkey < 10").onecol("s_nationkey").getinfo(t("customer", "c_nationkey"))


@query("SELECT r AS found, (SELECT count(*) - 1 FROM region WHERE r_name <= 'ASIA') AS place, -1 AS none FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) WHERE n_name = 'NATION_7'")
def lookup_names(t):
    from rowloom.operators.lookup import strlookup

    v, names = t("nation"), t("region").sorton("r_name").getcol("r_name")
    return _values(t, "found long, place long, none long", (v.lookup("n_name", "NATION_7"), strlookup(v.spark, "ASIA", names), strlookup(v.spark, "asia", names)))


# -- values: comparisons, aggregates and lists that come to the driver


def _values(t, schema: str, *rows: tuple) -> DataFrame:
    return t("region").spark.createDataFrame(list(rows), schema)


@query("SELECT max(l_extendedprice) AS most, (SELECT max(n_name) FROM nation) AS last FROM lineitem")
def max_of_columns(t):
    return _values(t, "most double, last string", (t("lineitem").max("l_extendedprice"), t("nation").max("n_name")))


@query("SELECT min(l_extendedprice) AS least, (SELECT min(r_name) FROM region) AS first FROM lineitem")
def min_of_columns(t):
    return _values(t, "least double, first string", (t("lineitem").min("l_extendedprice"), t("region").min("r_name")))


@query("SELECT sum(o_custkey)::BIGINT AS keys, round(sum(o_totalprice), 1) AS total, 0::BIGINT AS nothing FROM orders")
def sum_of_columns(t):
    v = t("orders")
    return _values(t, "keys long, total double, nothing long", (v.sum("o_custkey"), round(v.sum("o_totalprice"), 1), v.clone().sum("o_custkey")))


@query("SELECT 0 AS same, sign(CASE WHEN n_name < 'NATION_2x' THEN -1 ELSE 1 END)::INT AS edited, -1 AS shorter, 1 AS longer, (SELECT CASE WHEN 'c_custkey' < 'o_orderkey' THEN -1 ELSE 1 END) AS other FROM nation WHERE n_nationkey = 3")
def compare_views(t):
    v = t("nation")
    other = t("customer", "c_custkey").compare(t("orders", "o_orderkey"))
    return _values(t, "same int, edited int, shorter int, longer int, other int", (v.compare(t("nation")), v.compare(v.set(3, "n_name", "NATION_2x")), v.first(5).compare(v), v.compare(v.first(5)), other))


@query("WITH v AS (SELECT c_mktsegment AS m, c_acctbal AS b, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer), n AS (SELECT * FROM (VALUES (3, 7), (7, 3), (5, 5), (10, 149)) x(i, j)) SELECT i, j, CASE WHEN p.m < q.m OR p.m = q.m AND p.b < q.b THEN -1 WHEN p.m = q.m AND p.b = q.b THEN 0 ELSE 1 END AS s, p.m = q.m AND p.b = q.b AS same FROM n JOIN v p ON p.r = i JOIN v q ON q.r = j")
def rowcmp_rows(t):
    v = t("customer", "c_mktsegment", "c_acctbal")
    return _values(t, "i int, j int, s int, same boolean", *((i, j, v.rowcmp(i, v, j), v.roweq(i, v, j)) for i, j in ((3, 7), (7, 3), (5, 5), (10, 149))))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS at, n_name AS name FROM nation")
def getcol_names(t):
    return _values(t, "at long, name string", *enumerate(t("nation").getcol("n_name")))


@query("SELECT r_regionkey AS k, r_name AS name FROM region")
def viewascol_region(t):
    return _values(t, "k int, name string", *zip(*t("region").viewascol()))


@query("SELECT n_nationkey * 2 AS x, row_number() OVER (ORDER BY n_nationkey) - 1 AS at FROM nation WHERE n_regionkey = 2")
def collect_values(t):
    return _values(t, "x int, at long", *((x, i) for i, x in enumerate(t("nation").where("n_regionkey = 2").collect("n_nationkey * 2"))))


@query("SELECT r AS at, n_name AS name FROM (SELECT n_name, n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) WHERE r >= 3 AND r < 20 AND (r - 3) % 2 = 0 AND n_regionkey <> 1")
def loop_rows(t):
    return _values(t, "at long, name string", *t("nation").loop(lambda row: (row["#"], row["n_name"]), where="n_regionkey <> 1", first=3, limit=20, step=2))


@query("SELECT (SELECT n_name FROM nation WHERE n_nationkey = 3) AS cell, count(*) AS rows, max(n_nationkey) AS last, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation")
def get_paths(t):
    v = t("nation")
    return _values(t, "cell string, rows long, last int, names string", (v.get(3, "n_name"), v.get("#"), v.get(-1, "n_nationkey"), ",".join(v.get("*", "n_name"))))


@query("SELECT r_regionkey AS k, length(r_name) AS n FROM region")
def lengths_of_names(t):
    return _values(t, "k int, n int", *enumerate(t("region").lengths("r_name")))


@query("SELECT n_regionkey AS k, count(*)::INT AS n FROM nation GROUP BY 1")
def lengths_of_nested(t):
    return _values(t, "k int, n int", *enumerate(t("nation").sorton("n_regionkey").group(["n_regionkey"], "rows").lengths("rows")))


@query("SELECT '  r_regionkey  r_name' || chr(10) || '  -----------  -----------' || string_agg(chr(10) || '  ' || lpad(r_regionkey::VARCHAR, 11, ' ') || '  ' || r_name, '' ORDER BY r_regionkey) AS text FROM region")
def dump_region(t):
    return _values(t, "text string", (t("region").dump(),))


@query("SELECT '<table><tr><th></th><th>r_name</th></tr>' || string_agg('<tr><td>' || r_regionkey || '</td><td>' || r_name || '</td></tr>', '' ORDER BY r_regionkey) || '</table>' AS text FROM region")
def html_region(t):
    return _values(t, "text string", (t("region", "r_name").html(),))


@query("WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT coalesce(n, 0) AS count, row_number() OVER (ORDER BY c_custkey) - 1 AS at FROM customer LEFT JOIN o ON o_custkey = c_custkey")
def counts_of_join(t):
    left, right = t("customer", "c_custkey").rename("c_custkey", "custkey"), t("orders", "o_custkey", "o_orderkey").rename("o_custkey", "custkey")
    return left.join(right, "orders").counts("orders").tag("at")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def countscol_nested(t):
    from rowloom.operators.nesting import countscol

    v = t("nation").group(["n_regionkey"], "rows").freeze()
    return v.df.select(F.col("c0").alias("n_regionkey"), countscol(F.col("c1"), v.kind("rows")).alias("n"))


# -- schemas and views from values


@query("SELECT 'n_nationkey,n_name,n_regionkey' AS names, 'I,S,I' AS types, 'ISI' AS structure, 'n_nationkey:I,n_name,n_regionkey:I' AS structdesc, (SELECT count(*) FROM nation) AS size, 3 AS width, 'int' AS type")
def schema_of_nation(t):
    from rowloom import OPERATORS

    v = t("nation")
    return _values(t, "names string, types string, structure string, structdesc string, size long, width int, type string", (",".join(v.names), ",".join(v.types()), v.structure(), v.structdesc(), v.size(), OPERATORS["width"](v), OPERATORS["type"](3)))


@query("SELECT true AS renamed, false AS fewer, true AS nested, false AS other")
def compat_views(t):
    v, nest = t("nation"), t("nation").group(["n_regionkey"], "rows")
    return _values(t, "renamed boolean, fewer boolean, nested boolean, other boolean", (v.compat(v.rename("n_name", "x")), v.compat(v.onecol(0)), nest.compat(nest.rename("rows", "y")), v.compat(t("region"))))


@query("SELECT * FROM (VALUES (0, 'r_regionkey', 'I', ''), (1, 'r_name', 'S', ''), (2, 'nations', 'V', 'n_nationkey:I,n_name')) x(pos, name, type, subv)")
def meta_nested(t):
    return t("region").rename("r_regionkey", "n_regionkey").join(t("nation"), "nations").rename(0, "r_regionkey").meta().tag("pos")


@query("SELECT * FROM (VALUES ('A', 'S', ''), ('B', 'I', ''), ('C', 'V', 'D:L,E')) x(name, type, nested)")
def mdesc_mdef(t):
    from rowloom.functions.schema import desc_of, mdef, mdesc

    text, data = mdesc("A,B:I,C[D:L,E]"), mdef(["A", "B:I", ("C", ["D:L", "E"])])
    return _values(t, "name string, type string, nested string", *((a[0], b[1], desc_of(a[2])) for a, b in zip(text, data) if a == b))


@query("SELECT * FROM (VALUES (0, 'a', 1), (1, 'b', -2)) x(pos, A, B)")
def def_rows(t):
    from rowloom.sources.tables import define

    return define(t("region").spark, "A,B:I", ["a", 1, "b", "-2"]).tag("pos")


@query("SELECT * FROM (VALUES (0, 'a', 1::BIGINT), (1, 'b', 2::BIGINT), (2, 'c', 3000000000)) x(pos, A, B)")
def data_columns(t):
    from rowloom.sources.tables import data

    return data(t("region").spark, "A,B:L", ["a", "b", "c"], [1, 2, 3_000_000_000]).tag("pos")


@query("SELECT * FROM (VALUES (0, 1), (1, 2), (2, -33)) x(pos, A)")
def coerce_list(t):
    from rowloom.sources.tables import coerce

    return coerce(t("region").spark, ["1", 2, "-33"], "I").colconv().tag("pos")


@query("SELECT * FROM (VALUES (0, 'a', 1.5::DOUBLE), (1, 'b', 2.0::DOUBLE)) x(pos, A, B)")
def asview_list(t):
    from rowloom.sources.tables import asview

    return asview(t("region").spark, ["a", 1.5, "b", 2], "A", "B:D").viewconv().tag("pos")


# -- saved, written and sent views


def _folder(v: View) -> str:
    """A new place in the shared folder for checkpoints."""
    v.freeze()
    return f"{v.spark.sparkContext.getCheckpointDir()}/{uuid4().hex}"


@query("SELECT c_custkey, c_name, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS at FROM customer")
def save_load(t):
    from rowloom.sources.tables import load

    v = t("customer", "c_custkey", "c_name", "c_acctbal").sorton("-", "c_acctbal")
    path = _folder(t("region"))
    v.save(path)
    return load(v.spark, path).tag("at")


@query("SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def open_two(t):
    from rowloom.sources.tables import open_views

    root = _folder(t("region"))
    t("region").rename("r_regionkey", "n_regionkey").save(f"{root}/region")
    t("nation").save(f"{root}/nation")
    views = open_views(t("region").spark, root, ["region", "nation"])
    return views["region"].ijoin(views["nation"]).colmap(["r_name", "n_name"])


@query("SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier) AS written FROM supplier")
def write_csv(t):
    v, path = t("supplier", "s_suppkey", "s_name"), _folder(t("region"))
    n = v.write(path, "csv", header="true")
    return v.spark.read.csv(path, header=True).select(F.col("s_suppkey").cast("long"), "s_name", F.lit(n).cast("long").alias("written"))


@query("SELECT n_nationkey, n_name, n_regionkey, row_number() OVER (ORDER BY n_name) - 1 AS at FROM nation")
def emit_receive(t):
    from rowloom.sources.tables import receive

    v = t("nation").sorton("n_name")
    return receive(v.spark, v.emit()).tag("at")


@query("SELECT 'd' || r_regionkey % 2 || '/' || r_name AS path, length(r_name)::INT AS size, r_name AS text FROM region")
def filetree_roundtrip(t):
    from rowloom.sources.filetree import files, tree

    found = t("region").frame().select(F.concat(F.lit("d"), (F.col("r_regionkey") % 2).cast("string"), F.lit("/"), F.col("r_name")).alias("path"), F.length("r_name").alias("size"), F.lit(0).alias("date"), F.col("r_name").cast("binary").alias("contents"))
    return files(tree(found)).select("path", "size", F.col("contents").cast("string").alias("text"))


@query("SELECT * FROM (VALUES (0::BIGINT, ''), (1, 'd0'), (2, 'd1')) x(dir, path)")
def filetree_directories(t):
    from rowloom.sources.filetree import directories, tree

    found = t("region").frame().select(F.concat(F.lit("d"), (F.col("r_regionkey") % 2).cast("string"), F.lit("/"), F.col("r_name")).alias("path"), F.length("r_name").alias("size"), F.lit(0).alias("date"), F.col("r_name").cast("binary").alias("contents"))
    return directories(tree(found))


# -- pipelines and names


@query("SELECT n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_nationkey DESC LIMIT 3")
def pipe_stages(t):
    return t("nation").pipe(("where", "n_regionkey = 2"), "reverse", ("first", 3), ("colmap", ["n_name"]))


@query("SELECT n_name FROM nation WHERE n_regionkey = 3 ORDER BY n_nationkey LIMIT 2")
def do_script(t):
    from rowloom.plans.registry import do

    return do(t("region"), ["# another view from here on", ("use", t("nation")), None, ("where", "n_regionkey = 3"), ("first", 2), ("colmap", ["n_name"])])


@query("SELECT * FROM (SELECT count(*) FILTER (WHERE n_regionkey = 3) || ' rows, 3 cols' AS shown FROM nation UNION ALL SELECT '2 rows, 3 cols')")
def debug_script(t):
    shown: list[str] = []
    t("nation").debug([("where", "n_regionkey = 3"), ("first", 2)], show=shown.append)
    return _values(t, "shown string", *((", ".join(x.split(", ")[:2]),) for x in shown))


@query("SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey % 2 = 0")
def vopdef_operator(t):
    from rowloom.plans.registry import operator

    operator(lambda v, column: v.where(f"{column} % 2 = 0"), name="evens")
    return t("nation").where("n_regionkey = 1").evens("n_nationkey").onecol("n_name")


@query("SELECT n_name, (SELECT n_name FROM nation WHERE n_nationkey = 4) AS cell, 'large' AS deps FROM nation WHERE n_nationkey > 20")
def named_views(t):
    from rowloom.plans.registry import Registry

    names = Registry()
    names.to("base", t("nation"))
    names.to("large", lambda: names.ref("base").where("n_nationkey > 20"))
    found, cell = names.ref("large"), names.resolve("base!4.n_name")
    return found.frame().select("n_name", F.lit(cell).alias("cell"), F.lit(",".join(names.deps("base"))).alias("deps"))


@query("SELECT n_name FROM nation WHERE n_regionkey = 0 ORDER BY n_nationkey LIMIT 4")
def bound_view(t):
    from rowloom.plans.registry import Registry

    return Registry().bind("nations", t("nation"))(("where", "n_regionkey = 0"), ("first", 4), ("colmap", ["n_name"]))


# -- lists of positions as views


@query("WITH v AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders), p AS (SELECT c_custkey AS f, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer WHERE c_nationkey = 3) SELECT o_orderkey, pos FROM p JOIN v ON r = f")
def remap_view(t):
    return t("orders", "o_orderkey").remap(t("customer").where("c_nationkey = 3").onecol("c_custkey")).tag("pos")


@query(_NATIONS + "SELECT n_name, pos FROM (VALUES (0, 2), (1, 2), (2, 0)) x(pos, s) JOIN v ON r = s")
def remapsub_list(t):
    return t("nation", "n_name").remapsub([4, 2, -1, 0, 24], 1, 3).tag("pos")


@query("WITH p AS (SELECT n_regionkey AS f, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation) SELECT r_name, k - 5 AS pos FROM p JOIN region ON r_regionkey = f WHERE k BETWEEN 5 AND 14")
def remapsub_view(t):
    return t("region", "r_name").remapsub(t("nation", "n_regionkey"), 5, 10).tag("pos")


@query("SELECT range AS index FROM range((SELECT count(*) FROM orders)) WHERE range NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def omitmap_view(t):
    orders = t("orders", "o_orderkey")
    return omitmap(orders.spark, t("customer").where("c_nationkey < 20").onecol("c_custkey"), orders.size())


@query("WITH e AS (SELECT n_regionkey, sum(count(*)) OVER (ORDER BY n_regionkey) AS hi, count(*) AS n FROM nation GROUP BY 1), p AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_name DESC) - 1 AS k FROM nation) SELECT n_regionkey::BIGINT AS g, n, sum(n_nationkey)::BIGINT AS keys FROM e JOIN p ON k >= hi - n AND k < hi GROUP BY ALL")
def grouped_views(t):
    """Ends and permutation come from views: running totals of the regions' sizes, nations in falling order of names."""
    sizes = t("nation").group(["n_regionkey"], "rows").with_counts("n").sorton("n_regionkey")
    w = sizes.numbered()
    before = w.df.select((F.col("_o0")).alias("_k"), F.col("c1").alias("_n"))
    ends = View.build(w.df.join(before, F.col("_k") <= F.col("_o0")).groupBy("_o0").agg(F.sum("_n").alias("hi")), [("hi", F.col("hi"))], [(F.col("_o0"), True)])
    index = View.build(t("nation", "n_name").numbered().df, [("index", F.col("_o0"))], [(F.col("c0"), False)])
    rows = F.col("rows")
    found = t("nation", "n_nationkey").grouped(ends, index, "rows").tag("g").frame()
    return found.select("g", F.size(rows).cast("long").alias("n"), F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + x["n_nationkey"]).alias("keys"))


@query("SELECT r AS at, n_regionkey AS k FROM (SELECT n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) WHERE r < 2 UNION ALL SELECT r - 3, n_regionkey FROM (SELECT n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) WHERE r >= 5")
def resizecol_shorter(t):
    return t("nation", "n_regionkey").rename("n_regionkey", "k").resizecol(2, -3).tag("at")


# -- the parts of a difference: rows 1 and 2 deleted, a cell of base row 6 set, base row 20 inserted again at 1


def _difference(t) -> dict[str, View]:
    base = t("nation")
    return base.delete(1, 2).set(4, "n_name", "Y").insert(1, base.slice(20, 1, 1)).mutinfo(base)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 20")
def mutinfo_inserted(t):
    return _difference(t)["inserted"]


@query("SELECT n_nationkey, 'Y' AS n_name, n_regionkey FROM nation WHERE n_nationkey = 6")
def mutinfo_adjusted(t):
    return _difference(t)["adjusted"]


@query("SELECT 0 AS n_nationkey, 1 AS n_name, 0 AS n_regionkey")
def mutinfo_used(t):
    return _difference(t)["used"]


@query("SELECT r AS at, (r = 6)::INT AS flag FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation)")
def mutinfo_changed(t):
    return _difference(t)["changed"].tag("at")


@query("SELECT r AS at, (r = 1)::INT AS flag FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) WHERE r < (SELECT count(*) - 1 FROM nation)")
def mutinfo_new(t):
    return _difference(t)["new"].tag("at")


@query("SELECT r AS at, CASE WHEN r = 0 THEN 0 WHEN r = 1 THEN -1 ELSE r + 1 END AS base FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) WHERE r < (SELECT count(*) - 1 FROM nation)")
def mutinfo_reverse(t):
    return _difference(t)["reverse"].tag("at")


@query("SELECT n_name, count(c_custkey) AS customers, round(sum(total), 2) AS total FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY n_name ORDER BY total DESC LIMIT 10")
def flagship(t):
    """Orders summed by customer before the joins, then by nation; the ten largest."""
    totals = t("orders", "o_custkey", "o_totalprice").rename("o_custkey", "custkey").group_aggregate(["custkey"], total=F.sum("o_totalprice"))
    people = t("customer", "c_custkey", "c_nationkey").rename("c_custkey", "custkey", "c_nationkey", "nationkey").ijoin(totals)
    named = people.ijoin(t("nation", "n_nationkey", "n_name").rename("n_nationkey", "nationkey"))
    return named.group_aggregate(["n_name"], customers=F.count("custkey"), total=F.round(F.sum("total"), 2)).sorton("-", "total").first(10)
