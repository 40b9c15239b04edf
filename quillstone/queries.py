"""Registered queries: the dialect over external Parquet tables and over declared tables.

Names begin with the operator and end with the rows of the inventory that they
show.  Every query goes through the parser, the analyzer and the builder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .errors import DialectError, UniqueKeyError
from .session import HELP, Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def external(spark: SparkSession, sf_dir: str) -> Session:
    """A session over the Parquet tables of a folder, and a warehouse of its own for declared ones."""
    root = f"{spark.conf.get('spark.sql.warehouse.dir')}/quillstone-queries/{uuid.uuid4().hex}"
    out = Session(spark, root)
    for name in TABLES:
        out.lazily(name, f"{sf_dir}/{name}.parquet")
    return out


#: name: (statement, its SQL where that differs)
SELECTS: dict[str, tuple[str, str | None]] = {
    "scan_S1_P1": ("SELECT n_name, n_regionkey FROM nation;", None),
    "scan_star_P2": ("SELECT * FROM region;", None),
    "scan_alias_P3_P4": ("SELECT n.n_name AS name, n.n_nationkey AS id FROM nation AS n WHERE n.n_regionkey = 1;", None),
    "scan_join_star_P2": ("SELECT * FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey;", None),
    "index_range_S2": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000;", None),
    "point_lookup_S3": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 33 AND l_linenumber = 1;", None),
    "skip_scan_S5": ("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_suppkey = 7;", None),
    "filter_eq_F1": ("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING';", None),
    "filter_ne_F2": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F';", None),
    "filter_range_F3": ("SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size <= 20;", None),
    "filter_float_F3_Q1": ("SELECT p_partkey, p_size FROM part WHERE p_size < 10.5;", None),
    "filter_null_F4": ("SELECT o_orderkey FROM orders WHERE o_custkey IS NULL;", None),
    "filter_not_null_F4": ("SELECT COUNT(*) AS n FROM orders WHERE o_custkey IS NOT NULL;", None),
    "filter_and_F5": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5 AND l_discount > 0.05 AND l_returnflag = 'R';", None),
    "filter_columns_F6": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber > l_quantity;", None),
    "filter_date_F3": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1996-03-01';", None),
    "filter_arith_F9": ("SELECT o_orderkey FROM orders WHERE o_totalprice >= (1000*2) AND o_orderstatus <> 'F';", None),
    "filter_arith_truncates_F9": ("SELECT p_partkey FROM part WHERE p_size = 7 / 2 + -1 * (2 - 4);", "SELECT p_partkey FROM part WHERE p_size = 5"),
    "join_cross_J1": ("SELECT r1.r_name AS a, n.n_name AS b FROM region r1, nation n;", None),
    "join_on_cross_J1": ("SELECT r_name, s_suppkey FROM region JOIN supplier WHERE s_suppkey < 5;", "SELECT r_name, s_suppkey FROM region, supplier WHERE s_suppkey < 5"),
    "join_equi_J2": ("SELECT c_name, n_name FROM customer, nation WHERE c_nationkey = n_nationkey;", None),
    "join_on_J3_F7": ("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 5000;", None),
    "join_theta_J4": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey < r_regionkey;", None),
    "join_theta_ne_J4": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey <> r_regionkey AND n_nationkey >= r_regionkey;", None),
    "join_multi_J5": ("SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_nationkey = s_nationkey AND c_acctbal < s_acctbal AND s_suppkey < 20;", None),
    "join_types_J11": ("SELECT p_partkey, n_name FROM part, nation WHERE p_retailprice > n_nationkey AND p_size = n_nationkey;", None),
    "join_text_J9": ("SELECT a.n_name AS x, b.n_nationkey AS y FROM nation a, nation b WHERE a.n_name = b.n_name;", None),
    "join_self_Q21": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey;", None),
    "join_3way_J8": ("SELECT c_name, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey;", None),
    "join_5way_J8": (
        "SELECT COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem, orders, customer, nation, region"
        " WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA';", None),
    "join_agg_A14": ("SELECT o_orderpriority, SUM(l_quantity) AS q, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority;", None),
    "low_stock_A3_A14": (
        "SELECT COUNT(DISTINCT l_partkey) AS low_stock FROM lineitem, part WHERE l_partkey = p_partkey AND p_size < 10 AND l_quantity < 5;", None),
    "agg_caption_P5": ("SELECT COUNT(*), MAX(p_size), MIN(p_name) FROM part;", 'SELECT COUNT(*) AS "COUNT(*)", MAX(p_size) AS "MAX(p_size)", MIN(p_name) AS "MIN(p_name)" FROM part'),
    "agg_count_A1_A12": ("SELECT COUNT(*) AS n FROM lineitem;", None),
    "agg_count_column_A2": ("SELECT COUNT(o_custkey) AS n FROM orders;", None),
    "agg_distinct_A3": ("SELECT COUNT(DISTINCT (l_suppkey)) AS n, COUNT(DISTINCT l_returnflag) AS f FROM lineitem;", "SELECT COUNT(DISTINCT l_suppkey) AS n, COUNT(DISTINCT l_returnflag) AS f FROM lineitem"),
    "agg_sum_A4": ("SELECT SUM(l_quantity) AS q, SUM(l_linenumber) AS k FROM lineitem;", "SELECT SUM(l_quantity) AS q, CAST(SUM(l_linenumber) AS BIGINT) AS k FROM lineitem"),
    "agg_avg_A5": ("SELECT AVG(l_quantity) AS q, AVG(l_linenumber) AS k FROM lineitem;", None),
    "agg_min_max_A6": ("SELECT MIN(o_orderdate) AS a, MAX(o_orderdate) AS b, MIN(o_orderstatus) AS c, MAX(o_totalprice) AS d FROM orders;", None),
    "agg_global_A7": (
        "SELECT COUNT(*) AS n, SUM(p_size) AS s, MIN(p_size) AS lo, MAX(p_size) AS hi FROM part WHERE p_size > 20;",
        "SELECT COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS s, MIN(p_size) AS lo, MAX(p_size) AS hi FROM part WHERE p_size > 20"),
    "agg_group_A8": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q, AVG(l_quantity) AS a FROM lineitem GROUP BY l_returnflag, l_linestatus;", None),
    "agg_group_only_A9": ("SELECT c_mktsegment, c_nationkey FROM customer GROUP BY c_mktsegment, c_nationkey;", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer"),
    "agg_min_first_A13": ("SELECT MIN(l_orderkey) AS k FROM lineitem WHERE l_orderkey > 1000;", None),
    "having_unselected_A10": ("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12;", None),
    "having_two_A10": ("SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey HAVING MAX(l_quantity) > AVG(l_quantity) AND MIN(l_quantity) = 1;", None),
    "having_key_A10": ("SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey HAVING n_regionkey >= 2 AND 3 < COUNT(*);", None),
    "having_global_A11": ("SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 10;", None),
    "sort_O1": ("SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name ASC;", None),
    "sort_alias_O2": ("SELECT c_custkey AS id, c_acctbal AS balance FROM customer ORDER BY balance DESC, id LIMIT 20;", None),
    "sort_hidden_O3": ("SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10;", None),
    "sort_aggregate_O4": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 15;", None),
    "limit_O5": ("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 7;", None),
    "offset_O6": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 25;", None),
    "topk_O7": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50;", None),
    "sort_one_key_O8": ("SELECT p_partkey FROM part WHERE p_size = 3 ORDER BY p_partkey DESC LIMIT 30;", None),
    "union_U1": (
        "SELECT * FROM (SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region) AS u;",
        "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region"),
    "union_order_U2": (
        "SELECT * FROM (SELECT c_nationkey AS k, c_mktsegment AS s FROM customer UNION SELECT s_nationkey, s_name FROM supplier) AS u ORDER BY u.k, s DESC;",
        "SELECT c_nationkey AS k, c_mktsegment AS s FROM customer UNION SELECT s_nationkey, s_name FROM supplier"),
    "union_types_U3": (
        "SELECT * FROM (SELECT p_size AS v FROM part UNION SELECT l_quantity FROM lineitem UNION SELECT n_nationkey FROM nation) AS u;",
        "SELECT CAST(p_size AS DOUBLE) AS v FROM part UNION SELECT l_quantity FROM lineitem UNION SELECT CAST(n_nationkey AS DOUBLE) FROM nation"),
    "union_groups_U1": (
        "SELECT * FROM (SELECT o_orderstatus AS s, COUNT(*) AS n FROM orders GROUP BY o_orderstatus UNION SELECT l_linestatus, COUNT(*) FROM lineitem GROUP BY l_linestatus) AS u;",
        "SELECT o_orderstatus AS s, COUNT(*) AS n FROM orders GROUP BY o_orderstatus UNION SELECT l_linestatus, COUNT(*) FROM lineitem GROUP BY l_linestatus"),
}


def _select(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: external(spark, sf_dir).execute(statement)


PART = "CREATE TABLE p (k INT, name CHAR(60), brand CHAR(20), size INT, price FLOAT);"


def _parts(spark: SparkSession, sf_dir: str) -> Session:
    """Declared table p, filled from part."""
    s = external(spark, sf_dir)
    s.execute(PART)
    s.ingest("p", s.execute("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part;"))
    return s


def _run(session: Session, *statements: str) -> DataFrame | None:
    out = None
    for x in statements:
        out = session.execute(x)
    return out


def _declared(*statements: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _run(_parts(spark, sf_dir), *statements)


P = "(SELECT CAST(p_partkey AS INT) AS k, p_name AS name, p_brand AS brand, p_size AS size, CAST(p_retailprice AS FLOAT) AS price FROM part) AS p"
ALL = "SELECT k, size, price FROM p;"

#: name: (what runs, its SQL)
DECLARED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "declared_scan_X1": (_declared("SELECT k, name, price FROM p WHERE size <= 5;"), f"SELECT k, name, price FROM {P} WHERE size <= 5"),
    "declared_literal_Q1": (_declared("SELECT k FROM p WHERE size < 10.9 AND size <> 4.2;"), f"SELECT k FROM {P} WHERE size < 10 AND size <> 4"),
    "declared_float_Q3": (_declared("SELECT k FROM p WHERE price >= 1200.1;"), f"SELECT k FROM {P} WHERE price >= CAST(1200.1 AS FLOAT)"),
    "declared_mixed_Q4": (_declared("SELECT k FROM p WHERE price < k;"), f"SELECT k FROM {P} WHERE CAST(price AS DOUBLE) < CAST(k AS DOUBLE)"),
    "declared_aggregates_Q5": (
        _declared("SELECT brand, COUNT(*) AS n, SUM(size) AS s, AVG(size) AS a, MIN(price) AS lo FROM p GROUP BY brand;"),
        f"SELECT brand, CAST(COUNT(*) AS INT) AS n, CAST(SUM(size) AS INT) AS s, CAST(AVG(size) AS FLOAT) AS a, MIN(price) AS lo FROM {P} GROUP BY brand"),
    "agg_empty_Q8": (
        _declared("SELECT COUNT(*) AS n, SUM(size) AS s, MIN(size) AS lo, MAX(k) AS hi, MIN(price) AS f, AVG(size) AS a, MAX(name) AS t FROM p WHERE k < 0;"),
        f"SELECT CAST(COUNT(*) AS INT) AS n, CASE WHEN COUNT(*) = 0 THEN 0 ELSE CAST(SUM(size) AS INT) END AS s, CASE WHEN COUNT(*) = 0 THEN 0 ELSE MIN(size) END AS lo,"
        f" CASE WHEN COUNT(*) = 0 THEN 0 ELSE MAX(k) END AS hi, MIN(price) AS f, CAST(AVG(size) AS FLOAT) AS a, MAX(name) AS t FROM {P} WHERE k < 0"),
    "agg_empty_group_Q9": (_declared("SELECT brand, COUNT(*) AS n FROM p WHERE k < 0 GROUP BY brand;"), f"SELECT brand, CAST(COUNT(*) AS INT) AS n FROM {P} WHERE k < 0 GROUP BY brand"),
    "dml_insert_S8_D1": (
        _declared("INSERT INTO p VALUES (-1, 'new', 'B', 3.9, 7);", "INSERT INTO p VALUES (-2, NULL, NULL, NULL, NULL);", ALL),
        f"SELECT k, size, price FROM {P} UNION ALL SELECT -1, 3, 7.0::FLOAT UNION ALL SELECT -2, NULL, NULL"),
    "dml_delete_D2": (_declared("DELETE FROM p WHERE size > 10 AND price < 1500.0;", ALL), f"SELECT k, size, price FROM {P} WHERE NOT (size > 10 AND price < CAST(1500 AS FLOAT))"),
    "dml_update_D3": (
        _declared("UPDATE p SET size = 99, price = NULL WHERE size = 7;", ALL),
        f"SELECT k, CASE WHEN size = 7 THEN 99 ELSE size END AS size, CASE WHEN size = 7 THEN NULL ELSE price END AS price FROM {P}"),
    "dml_copy_D4_D8": (_declared("UPDATE p SET size = k, k = size;", ALL), f"SELECT size AS k, k AS size, price FROM {P}"),
    "dml_arith_D5_D7": (
        _declared("UPDATE p SET size = size * 2.5, price = price / 4, k += 10 WHERE size < 30;", ALL),
        f"SELECT CASE WHEN size < 30 THEN k + 10 ELSE k END AS k, CASE WHEN size < 30 THEN CAST(trunc(size * 2.5::DOUBLE) AS INT) ELSE size END AS size,"
        f" CASE WHEN size < 30 THEN CAST(CAST(price AS DOUBLE) / 4 AS FLOAT) ELSE price END AS price FROM {P}"),
    "dml_chain_D6": (
        _declared("UPDATE p SET price = price + 16777216 - 16777216;", ALL),
        f"SELECT k, size, CAST(CAST(CAST(CAST(price AS DOUBLE) + 16777216 AS FLOAT) AS DOUBLE) - 16777216 AS FLOAT) AS price FROM {P}"),
    "dml_null_D9": (
        _declared("UPDATE p SET size = NULL WHERE k < 50;", "UPDATE p SET size = size + 1;", "SELECT size, COUNT(*) AS n, COUNT(size) AS m FROM p GROUP BY size;"),
        f"SELECT s AS size, CAST(COUNT(*) AS INT) AS n, CAST(COUNT(s) AS INT) AS m FROM (SELECT CASE WHEN k < 50 THEN NULL ELSE size + 1 END AS s FROM {P}) GROUP BY s"),
    "dml_noop_D13": (_declared("UPDATE p SET size = size WHERE k = 5;", ALL), f"SELECT k, size, price FROM {P}"),
    "ddl_index_X3_X4": (_declared("CREATE INDEX p (size, k);", "CREATE INDEX named ON p (k);", "DROP INDEX p (size, k);", "SELECT k FROM p WHERE k = 12;"), f"SELECT k FROM {P} WHERE k = 12"),
    "ddl_checkpoint_X7": (_declared("INSERT INTO p VALUES (-5, 'x', 'y', 1, 2);", "CREATE STATIC_CHECKPOINT;", "SELECT COUNT(*) AS n, MIN(k) AS k FROM p;"), f"SELECT CAST(COUNT(*) + 1 AS INT) AS n, -5 AS k FROM {P}"),
    "declared_union_Q17": (
        _declared("SELECT * FROM (SELECT size AS v FROM p UNION SELECT price FROM p UNION SELECT SUM(size) FROM p) AS u;"),
        f"SELECT CAST(size AS FLOAT) AS v FROM {P} UNION SELECT price FROM {P} UNION SELECT CAST(SUM(size) AS FLOAT) FROM {P}"),
    "declared_null_order_Q12": (
        _declared("INSERT INTO p VALUES (-7, NULL, NULL, NULL, NULL);", "SELECT k, size FROM p ORDER BY size DESC, k LIMIT 3;"),
        f"SELECT k, size FROM (SELECT k, size FROM {P} UNION ALL SELECT -7, NULL) ORDER BY size DESC NULLS FIRST, k LIMIT 3"),
    "txn_rollback_T1_X9": (_declared("BEGIN;", "DELETE FROM p WHERE size > 3;", "ROLLBACK;", ALL), f"SELECT k, size, price FROM {P}"),
    "txn_commit_T3_X8": (
        _declared("SET TRANSACTION ISOLATION LEVEL SNAPSHOT ISOLATION;", "BEGIN;", "DELETE FROM p WHERE size > 3;", "UPDATE p SET price = 1 WHERE size = 1;", "COMMIT;", ALL),
        f"SELECT k, size, CASE WHEN size = 1 THEN CAST(1 AS FLOAT) ELSE price END AS price FROM {P} WHERE size <= 3"),
    "txn_serializable_T4": (_declared("SET TRANSACTION ISOLATION LEVEL SERIALIZABLE;", "BEGIN;", "SELECT COUNT(*) FROM p;", "UPDATE p SET size = 0 WHERE k = 1;", "COMMIT;", ALL),
        f"SELECT k, CASE WHEN k = 1 THEN 0 ELSE size END AS size, price FROM {P}"),
}


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation, written as CSV with a shuffled header, loaded and read again."""
    s = external(spark, sf_dir)
    path = f"{s.house.root}/_csv".removeprefix("file:")
    s.execute("SELECT n_name, n_regionkey, n_nationkey FROM nation;").toDF("name", "region", "id").coalesce(1).write.option("header", True).csv(path)
    return _run(s, "CREATE TABLE n (id INT, name CHAR(25), region INT);", f"LOAD {path} INTO n;", "SELECT id, name, region FROM n;")


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = external(spark, sf_dir)
    s.prepare(1, "SELECT p_partkey, p_size FROM part WHERE p_size >= $1 AND p_brand <> $2 ORDER BY p_partkey LIMIT $3 OFFSET $4;", ("INT32", "CHAR", "INT32", "INT32"))
    return s.execute_prepared(1, (12.7, "Brand#11", 40, 3))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _parts(spark, sf_dir)
    s.prepare(1, "UPDATE p SET size = $1 WHERE k = $2;", ("INT32", "INT32"))
    s.prepare(2, "DELETE FROM p WHERE size > $1;", ("FLOAT32",))
    s.prepare(3, ALL)
    return s.execute_batch([(1, (3, 1)), (1, (4, 2)), (2, (5.5,)), (3, ())])[-1]


DECLARED |= {
    "load_csv_S7": (_csv, "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation"),
    "prepared_F11_O9_R2": (_prepared, "SELECT p_partkey, p_size FROM part WHERE p_size >= 12 AND p_brand <> 'Brand#11' ORDER BY p_partkey LIMIT 40 OFFSET 3"),
    "prepared_batch_R3_R4": (_batch, f"SELECT k, size, price FROM (SELECT k, CASE k WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE size END AS size, price FROM {P}) WHERE size <= 5"),
    "catalog_tables_S12": (lambda s, d: _parts(s, d).execute("DESC p;"), "SELECT * FROM (VALUES ('k', 'INT', 'NO'), ('name', 'STRING', 'NO'), ('brand', 'STRING', 'NO'), ('size', 'INT', 'NO'), ('price', 'FLOAT', 'NO')) AS t(\"Field\", \"Type\", \"Index\")"),
    "catalog_index_S12": (_declared("CREATE INDEX p (k);", "SHOW INDEX FROM p;"), "SELECT 'p' AS \"Tables\", 'unique' AS \"Type\", '(k)' AS \"Column\""),
    "explain_X6": (
        lambda s, d: external(s, d).execute("EXPLAIN ANALYZE SELECT c.c_name, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 2;"),
        "WITH j AS (SELECT count(*) AS n FROM customer, nation WHERE c_nationkey = n_nationkey AND n_regionkey = 2), c AS (SELECT count(*) AS n FROM customer), n AS (SELECT count(*) AS n FROM nation WHERE n_regionkey = 2)"
        " SELECT 'Project(columns=[c.c_name, n.n_name], rows=' || n || ')' AS plan FROM j UNION ALL SELECT chr(9) || 'Join(tables=[customer, nation], condition=[c.c_nationkey=n.n_nationkey], rows=' || n || ')' FROM j"
        " UNION ALL SELECT chr(9) || chr(9) || 'Project(columns=[c.c_name, c.c_nationkey], rows=' || n || ')' FROM c UNION ALL SELECT chr(9) || chr(9) || chr(9) || 'Scan(table=customer, type=SeqScan, rows=' || n || ')' FROM c"
        " UNION ALL SELECT chr(9) || chr(9) || 'Project(columns=[n.n_name, n.n_nationkey], rows=' || n || ')' FROM n UNION ALL SELECT chr(9) || chr(9) || chr(9) || 'Scan(table=nation, type=SeqScan, rows=' || n || ')' FROM n"),
}


def _refused(*statements: str, refused: str, error: type[DialectError]) -> Callable[[SparkSession, str], DataFrame]:
    """Declared table p after statements, of which one must fail with an error and change nothing."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = _parts(spark, sf_dir)
        _run(s, *statements)
        try:
            s.execute(refused)
        except error:
            return s.execute(ALL)
        raise AssertionError(f"{refused} was not refused")

    return run


def _two_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """READ COMMITTED: a transaction sees what another session has committed since it began."""
    s = _parts(spark, sf_dir)
    s.execute("BEGIN;")
    before = s.execute("SELECT COUNT(*) AS n FROM p;").first()["n"]
    Session(spark, s.house.root).execute("INSERT INTO p VALUES (-3, 'other', 'B', 1, 1);")
    out = s.execute("SELECT COUNT(*) AS n, MIN(k) AS lowest FROM p;")
    return out.selectExpr("n", "lowest", f"n - {before} AS added")


def _texts(name: str, values) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("('" + v.replace("'", "''") + "')" for v in values) + f') AS t("{name}")'


DECLARED |= {
    "join_widths_J9": (
        _declared("CREATE TABLE w (s CHAR(80), n INT);", "INSERT INTO w VALUES ('Brand#11', 1);", "INSERT INTO w VALUES ('Brand#12', 2);", "INSERT INTO w VALUES ('Brand', 3);", "SELECT p.k, w.n FROM p, w WHERE p.brand = w.s;"),
        f"SELECT k, n FROM {P} JOIN (VALUES ('Brand#11', 1), ('Brand#12', 2), ('Brand', 3)) AS w(s, n) ON brand = s"),
    "join_cross_types_J11": (
        _declared("CREATE TABLE f (x FLOAT);", "INSERT INTO f VALUES (3);", "INSERT INTO f VALUES (4.5);", "INSERT INTO f VALUES (7.0);", "SELECT p.k, f.x FROM p, f WHERE p.size = f.x;"),
        f"SELECT k, x FROM {P} JOIN (VALUES (CAST(3 AS FLOAT)), (CAST(4.5 AS FLOAT)), (CAST(7 AS FLOAT))) AS f(x) ON CAST(size AS DOUBLE) = CAST(x AS DOUBLE)"),
    "join_null_keys_J10": (
        _declared("INSERT INTO p VALUES (-1, NULL, NULL, NULL, NULL);", "CREATE TABLE z (size INT, t INT);", "INSERT INTO z VALUES (NULL, 1);", "INSERT INTO z VALUES (7, 2);", "SELECT p.k, z.t FROM p, z WHERE p.size = z.size;"),
        f"SELECT k, 2 AS t FROM {P} WHERE size = 7"),
    "union_nulls_U4": (
        _declared("INSERT INTO p VALUES (-1, NULL, NULL, NULL, NULL);", "INSERT INTO p VALUES (-2, NULL, NULL, NULL, NULL);", "SELECT * FROM (SELECT size AS v FROM p WHERE k < 0 UNION SELECT size FROM p) AS u;"),
        f"SELECT size AS v FROM {P} UNION SELECT NULL"),
    "unique_insert_D10": (_refused("CREATE INDEX p (k);", refused="INSERT INTO p VALUES (5, 'twice', 'B', 1, 1);", error=UniqueKeyError), f"SELECT k, size, price FROM {P}"),
    "unique_update_D10_D14": (_refused("CREATE INDEX p (k);", "UPDATE p SET price = 2 WHERE k = 4;", refused="UPDATE p SET k = 5, price = 1 WHERE k <= 4;", error=UniqueKeyError),
        f"SELECT k, size, CASE WHEN k = 4 THEN CAST(2 AS FLOAT) ELSE price END AS price FROM {P}"),
    "ddl_drop_X2_S12": (_declared("CREATE TABLE gone (a INT);", "CREATE TABLE stays (a INT);", "DROP TABLE gone;", "SHOW TABLES;"), _texts("Tables", ["p", "stays", *TABLES])),
    "txn_read_committed_T2": (_two_sessions, f"SELECT CAST(COUNT(*) + 1 AS INT) AS n, -3 AS lowest, 1 AS added FROM {P}"),
    "help_X5": (lambda s, d: external(s, d).execute("HELP;"), _texts("help", HELP)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _select(q) for k, (q, _) in SELECTS.items()} | {k: f for k, (f, _) in DECLARED.items()}


def oracle_sql() -> dict[str, str]:
    return {k: (sql or q.rstrip(";")) for k, (q, sql) in SELECTS.items()} | {k: sql for k, (_, sql) in DECLARED.items()}
