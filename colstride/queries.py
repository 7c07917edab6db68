"""The queries of the core library as the driver registers them, each with the SQL it is checked by.

Order and part keys are dense, so they serve as positions; lineitem positions come from row numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as O
from .functions import primitives as P
from .functions import uint64 as U
from .operators import codecs, formats, stats
from .operators.calc import bitmap
from .operators.kernels import GROUPS, GroupSimple, NullSuppression
from .plans import harness
from .plans import queries as plans
from .sources import generators
from .sources.columns import from_parquet, from_values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = " ".join(sql.split())
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    """(pos, v) of a whole-number expression over orders."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.expr(f"CAST({value} AS BIGINT)").alias("v"))


def parts(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.expr(f"CAST({value} AS BIGINT)").alias("v"))


for _op, _sign in {"lt": "<", "le": "<=", "eq": "=", "ne": "<>", "ge": ">=", "gt": ">"}.items():
    _name = {"lt": "less", "le": "lessequal", "eq": "equal", "ne": "not_equal", "ge": "greaterequal", "gt": "greater"}[_op]

    @query(f"select_{_op}", f"SELECT o_orderkey AS pos FROM orders WHERE o_custkey {_sign} 500")
    def _select(spark, sf_dir, name=_name):
        return O.select(orders(spark, sf_dir, "o_custkey"), name, 500)


@query("select_functor", "SELECT o_orderkey AS pos FROM orders WHERE o_custkey % 7 = 3")
def select_functor(spark, sf_dir):
    return O.select(orders(spark, sf_dir, "o_custkey"), lambda a, b: a % 7 == b, 3)


@query("select_row_index", "SELECT pos FROM (SELECT row_number() OVER () - 1 AS pos, l_quantity FROM lineitem) WHERE l_quantity > 49")
def select_row_index(spark, sf_dir):
    column = from_parquet(spark, f"{sf_dir}/lineitem.parquet", v="l_quantity")
    return O.select(column, "greater", 49)


@query("between", "SELECT p_partkey AS pos FROM part WHERE p_size >= 10 AND p_size < 20")
def between(spark, sf_dir):
    return O.between(parts(spark, sf_dir, "p_size"), 10, 20)


@query("between_closed", "SELECT p_partkey AS pos FROM part WHERE p_size BETWEEN 10 AND 20")
def between_closed(spark, sf_dir):
    return O.between(parts(spark, sf_dir, "p_size"), 10, 20, high_op="lessequal")


@query("select_conjunction", "SELECT o_orderkey AS pos FROM orders WHERE o_custkey < 500 AND o_totalprice > 200000")
def select_conjunction(spark, sf_dir):
    return O.select_all(table(spark, sf_dir, "orders"), F.col("o_custkey") < 500, F.col("o_totalprice") > 200000, pos="o_orderkey")


@query("select_disjunction", "SELECT o_orderkey AS pos FROM orders WHERE o_custkey < 100 OR o_totalprice > 400000")
def select_disjunction(spark, sf_dir):
    return O.select_any(table(spark, sf_dir, "orders"), F.col("o_custkey") < 100, F.col("o_totalprice") > 400000, pos="o_orderkey")


@query("project_positions", "SELECT o_orderkey AS pos, o_custkey AS v FROM orders WHERE o_totalprice > 300000")
def project_positions(spark, sf_dir):
    positions = O.select(orders(spark, sf_dir, "floor(o_totalprice * 100)"), "greater", 30000000)
    return O.project(orders(spark, sf_dir, "o_custkey"), positions)


@query("project_repeats", "SELECT c_custkey AS pos, o_custkey AS v FROM customer JOIN orders ON o_orderkey = c_custkey * 7 % 1000")
def project_repeats(spark, sf_dir):
    positions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), (F.col("c_custkey") * 7 % 1000).alias("pos"))
    return O.project(orders(spark, sf_dir, "o_custkey"), positions, order="n")


_SUM = "SELECT CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS v FROM lineitem WHERE l_linenumber = 3"


def _lines(spark, sf_dir):
    return from_parquet(spark, f"{sf_dir}/lineitem.parquet", l_linenumber="l_linenumber", qty=F.col("l_quantity").cast("long"))


@query("select_sum", _SUM)
def select_sum(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_quantity").cast("long").alias("qty"))
    return plans.select_sum(lines, "equal", 3, "l_linenumber", "qty")


@query("select_sum_positional", _SUM)
def select_sum_positional(spark, sf_dir):
    return plans.select_sum_positional(_lines(spark, sf_dir), "equal", 3, "l_linenumber", "qty")


@query("nested_loop_join", "SELECT c_custkey AS left_pos, s_suppkey AS right_pos FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def nested_loop_join(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_nationkey").alias("v"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_nationkey").alias("v"))
    return O.nested_loop_join(left, right)


@query("semi_join", "SELECT p_partkey AS pos FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def semi_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("v"))
    return O.left_semi_join(parts(spark, sf_dir, "p_partkey"), lines)


@query("semi_probe", "SELECT o_orderkey AS pos FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 9000)")
def semi_probe(spark, sf_dir):
    build = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("v"))
    return O.hash_semi_join(build, orders(spark, sf_dir, "o_custkey"))


@query(
    "hash_join_first_wins",
    "SELECT m.pos AS left_pos, c_custkey AS right_pos FROM customer JOIN (SELECT o_custkey, min(o_orderkey) AS pos FROM orders GROUP BY o_custkey) m ON m.o_custkey = c_custkey",
)
def hash_join_first_wins(spark, sf_dir):
    probe = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("v"))
    return O.hash_join(orders(spark, sf_dir, "o_custkey"), probe)


@query("equi_join_n1", "SELECT p_partkey AS left_pos, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey")
def equi_join_n1(spark, sf_dir):
    lines = from_parquet(spark, f"{sf_dir}/lineitem.parquet", v="l_partkey")
    return O.hash_join(parts(spark, sf_dir, "p_partkey"), lines).groupBy("left_pos").agg(F.count("*").alias("n"))


@query("agg_sum", "SELECT CAST(coalesce(sum(o_custkey), 0) AS BIGINT) AS v FROM orders")
def agg_sum(spark, sf_dir):
    return O.agg_sum(orders(spark, sf_dir, "o_custkey"))


@query("agg_sum_empty", "SELECT CAST(coalesce(sum(o_custkey), 0) AS BIGINT) AS v FROM orders WHERE o_custkey < 0")
def agg_sum_empty(spark, sf_dir):
    return O.agg_sum(orders(spark, sf_dir, "o_custkey").where("v < 0"))


@query("agg_sum_wrapping", "SELECT CAST(sum(CAST(o_orderkey AS HUGEINT) * 4611686018427387904) % 18446744073709551616 AS VARCHAR) AS v FROM orders")
def agg_sum_wrapping(spark, sf_dir):
    big = orders(spark, sf_dir, "o_orderkey").select("pos", (F.col("v").cast("decimal(12,0)") * F.lit("4611686018427387904").cast("decimal(19,0)")).alias("w"))
    return O.agg_sum(big.select("pos", U.wrap(F.col("w")).alias("v"))).select(F.col("v").cast("string").alias("v"))


_GROUPS = "SELECT o_custkey, min(o_orderkey) AS rep, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS gid FROM orders GROUP BY o_custkey"
_FINE = "SELECT o_custkey, o_orderstatus, min(o_orderkey) AS rep, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS gid FROM orders GROUP BY o_custkey, o_orderstatus"


@query("group_ids", f"SELECT o_orderkey AS pos, gid FROM orders JOIN ({_GROUPS}) USING (o_custkey)")
def group_ids(spark, sf_dir):
    return O.group(orders(spark, sf_dir, "o_custkey"))[0]


@query("group_extents", f"SELECT gid, rep FROM ({_GROUPS})")
def group_extents(spark, sf_dir):
    return O.group(orders(spark, sf_dir, "o_custkey"))[1]


def _refined(spark, sf_dir):
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("v"))
    return O.group_refine(O.group(orders(spark, sf_dir, "o_custkey"))[0], status, check=False)


@query("group_binary", f"SELECT o_orderkey AS pos, gid FROM orders JOIN ({_FINE}) USING (o_custkey, o_orderstatus)")
def group_binary(spark, sf_dir):
    return _refined(spark, sf_dir)[0]


@query("group_binary_extents", f"SELECT gid, rep FROM ({_FINE})")
def group_binary_extents(spark, sf_dir):
    return _refined(spark, sf_dir)[1]


@query(
    "agg_sum_grouped",
    f"SELECT gid, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS v FROM orders JOIN ({_GROUPS}) USING (o_custkey) GROUP BY gid",
)
def agg_sum_grouped(spark, sf_dir):
    ids, extents = O.group(orders(spark, sf_dir, "o_custkey"))
    return O.agg_sum_grouped(ids, orders(spark, sf_dir, "floor(o_totalprice)"), extents.count(), check=False)


@query(
    "agg_sum_grouped_gaps",
    "SELECT r.range AS gid, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS v FROM range(2000) r LEFT JOIN orders ON o_custkey * 3 = r.range GROUP BY r.range",
)
def agg_sum_grouped_gaps(spark, sf_dir):
    ids = orders(spark, sf_dir, "o_custkey * 3").select("pos", F.col("v").alias("gid"))
    return O.agg_sum_grouped(ids, orders(spark, sf_dir, "o_orderkey"), 2000, check=False)


@query("distinct_values", "SELECT min(o_orderkey) AS rep, o_custkey AS v FROM orders GROUP BY o_custkey")
def distinct_values(spark, sf_dir):
    return O.distinct_values(orders(spark, sf_dir, "o_custkey"))


@query(
    "example_query",
    """SELECT l_suppkey, l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem JOIN part ON l_partkey = p_partkey
       WHERE p_size > 40 GROUP BY l_suppkey, l_partkey HAVING sum(CAST(l_quantity AS BIGINT)) > 45""",
)
def example_query(spark, sf_dir):
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return plans.grouped_join_having(
        lines, part, F.col("l_partkey") == F.col("p_partkey"), F.col("p_size") > 40, ["l_suppkey", "l_partkey"], F.col("l_quantity").cast("long"), 45)


@query("intersect", "SELECT o_orderkey AS pos FROM orders WHERE o_custkey < 700 AND o_totalprice > 150000")
def intersect(spark, sf_dir):
    a = O.select(orders(spark, sf_dir, "o_custkey"), "less", 700)
    return O.intersect_sorted(a, O.select(orders(spark, sf_dir, "floor(o_totalprice * 100)"), "greater", 15000000))


@query("merge", "SELECT o_orderkey AS pos FROM orders WHERE o_custkey < 100 OR o_totalprice > 300000")
def merge(spark, sf_dir):
    a = O.select(orders(spark, sf_dir, "o_custkey"), "less", 100)
    return O.merge_sorted(a, O.select(orders(spark, sf_dir, "floor(o_totalprice * 100)"), "greater", 30000000))


def _wrapped(sql: str) -> str:
    return f"SELECT o_orderkey AS pos, CAST((({sql}) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616 AS VARCHAR) AS v FROM orders"


def pair(spark: SparkSession, sf_dir: str, a: str, b: str) -> DataFrame:
    """(pos, a, b) of two whole-number expressions over orders."""
    whole = lambda x, name: F.expr(f"CAST({x} AS BIGINT)").alias(name)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), whole(a, "a"), whole(b, "b"))


_CALC = {"add": "+", "sub": "-", "mul": "*"}
for _name, _sign in _CALC.items():

    @query(f"calc_{_name}", _wrapped(f"CAST(o_custkey AS HUGEINT) * 1000003 {_sign} CAST(o_orderkey AS HUGEINT) * 1000000007"))
    def _calc(spark, sf_dir, op=_name):
        return O.calc(pair(spark, sf_dir, "o_custkey * 1000003", "o_orderkey * 1000000007"), op, "a", "b").select("pos", F.col("v").cast("string").alias("v"))


@query("calc_add_positional", _wrapped("CAST(o_custkey AS HUGEINT) + CAST(o_orderkey AS HUGEINT)"))
def calc_add_positional(spark, sf_dir):
    """Two columns of their own, joined by position."""
    return O.calc_binary(orders(spark, sf_dir, "o_custkey"), orders(spark, sf_dir, "o_orderkey"), "add").select("pos", F.col("v").cast("string").alias("v"))


@query("calc_div", "SELECT o_orderkey AS pos, CAST(o_orderkey * 31 // (o_custkey + 1) AS VARCHAR) AS v FROM orders")
def calc_div(spark, sf_dir):
    return O.calc(pair(spark, sf_dir, "o_orderkey * 31", "o_custkey + 1"), "div", "a", "b").select("pos", F.col("v").cast("string").alias("v"))


@query("calc_mod", "SELECT o_orderkey AS pos, CAST(o_orderkey * 31 % (o_custkey + 1) AS VARCHAR) AS v FROM orders")
def calc_mod(spark, sf_dir):
    return O.calc(pair(spark, sf_dir, "o_orderkey * 31", "o_custkey + 1"), "mod", "a", "b").select("pos", F.col("v").cast("string").alias("v"))


@query("calc_min", "SELECT o_orderkey AS pos, least(o_orderkey, o_custkey) AS v FROM orders")
def calc_min(spark, sf_dir):
    return O.calc(pair(spark, sf_dir, "o_orderkey", "o_custkey"), "min", "a", "b")


@query("calc_inv", "SELECT o_orderkey AS pos, CAST((18446744073709551616 - CAST(o_custkey AS HUGEINT)) % 18446744073709551616 AS VARCHAR) AS v FROM orders")
def calc_inv(spark, sf_dir):
    return O.calc_unary(orders(spark, sf_dir, "o_custkey"), "inv").select("pos", F.col("v").cast("string").alias("v"))


@query("calc_unary_functor", "SELECT o_orderkey AS pos, o_custkey + 5 AS v FROM orders")
def calc_unary_functor(spark, sf_dir):
    return O.calc_unary(orders(spark, sf_dir, "o_custkey"), lambda x: x + 5)


@query("increment", "SELECT o_orderkey AS pos, o_custkey + 1 AS v FROM orders")
def increment(spark, sf_dir):
    return O.increment(orders(spark, sf_dir, "o_custkey"))


for _op, _sign in {"less": "<", "equal": "=", "greaterequal": ">="}.items():

    @query(f"compare_{_op}", f"SELECT o_orderkey AS pos, o_orderkey % 1500 {_sign} o_custkey AS v FROM orders")
    def _compare(spark, sf_dir, op=_op):
        return O.compare(pair(spark, sf_dir, "o_orderkey % 1500", "o_custkey"), op, "a", "b")


@query(
    "compare_bitmap",
    """SELECT o_orderkey // 32 AS word, CAST(sum(CASE WHEN o_orderkey < o_custkey THEN CAST(1 AS BIGINT) << CAST(o_orderkey % 32 AS INTEGER) ELSE 0 END) AS BIGINT) AS bits
       FROM orders GROUP BY 1""",
)
def compare_bitmap(spark, sf_dir):
    flags = O.compare_binary(orders(spark, sf_dir, "o_orderkey"), orders(spark, sf_dir, "o_custkey"), "less", check=False)
    # The upper half of each word stays empty, so the bits fit the signed type of the check.
    spread = flags.select((F.expr("pos div 32") * 64 + F.pmod("pos", F.lit(32))).alias("pos"), "v")
    return bitmap(spread)


@query("lane_primitives", """SELECT o_orderkey // 8 AS register, CAST(sum(o_custkey) AS BIGINT) AS hadd, bit_or(o_custkey) AS hor,
       CAST(count(*) FILTER (o_custkey < 700) AS BIGINT) AS matches FROM orders GROUP BY 1""")
def lane_primitives(spark, sf_dir):
    rows = orders(spark, sf_dir, "o_custkey").groupBy(F.expr("pos div 8").alias("register")).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("r"))
    lanes = F.col("r.v")
    mask = P.mask_of(F.transform(lanes, lambda x: x < 700))
    return rows.select("register", P.hadd(lanes).alias("hadd"), P.hor(lanes).alias("hor"), P.count_matches(mask).alias("matches"))


@query("bit_primitives", """SELECT o_orderkey AS pos, o_custkey & 255 AS band, o_custkey | 4096 AS bor, CASE WHEN o_orderkey % 70 >= 64 THEN 0 ELSE o_custkey >> CAST(o_orderkey % 70 AS INTEGER) END AS shr,
       CASE WHEN o_custkey = 0 THEN 64 ELSE 64 - length(bin(o_custkey)) END AS clz FROM orders""")
def bit_primitives(spark, sf_dir):
    v = F.col("v")
    return orders(spark, sf_dir, "o_custkey").select(
        "pos", P.LOGIC["bitwise_and"](v, F.lit(255).cast("long")).alias("band"), P.LOGIC["bitwise_or"](v, F.lit(4096).cast("long")).alias("bor"),
        U.shift_right(v, F.col("pos") % 70).alias("shr"), U.count_leading_zero(v).alias("clz"))


@query("bw_histogram", "SELECT CAST(length(bin(o_custkey)) AS BIGINT) AS width, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def bw_histogram(spark, sf_dir):
    return stats.histogram(orders(spark, sf_dir, "o_custkey"))


@query("max_bitwidth", "SELECT CAST(length(bin(bit_or(o_custkey))) AS BIGINT) AS width FROM orders")
def max_bitwidth(spark, sf_dir):
    return stats.max_bitwidth(orders(spark, sf_dir, "o_custkey"))


@query(
    "data_properties",
    """SELECT CAST(count(*) AS BIGINT) AS n, min(o_custkey) AS least, max(o_custkey) AS greatest, CAST(count(DISTINCT o_custkey) AS BIGINT) AS distinct_n,
       count(DISTINCT o_custkey) = count(*) AS is_unique,
       (SELECT count(*) = 0 FROM (SELECT o_custkey < lag(o_custkey) OVER (ORDER BY o_orderkey) AS bad FROM orders) WHERE bad) AS is_sorted FROM orders""",
)
def data_properties(spark, sf_dir):
    p = stats.data_properties(orders(spark, sf_dir, "o_custkey"))
    row = [(p.count, p.least, p.greatest, p.distinct, p.unique, p.sorted_ascending)]
    return spark.createDataFrame(row, "n long, least long, greatest long, distinct_n long, is_unique boolean, is_sorted boolean")


@query("is_sorted", "SELECT true AS key_sorted, (SELECT count(*) = 0 FROM (SELECT p_size < lag(p_size) OVER (ORDER BY p_partkey) AS bad FROM part) WHERE bad) AS size_sorted")
def is_sorted(spark, sf_dir):
    row = [(stats.is_sorted(parts(spark, sf_dir, "p_partkey")), stats.is_sorted(parts(spark, sf_dir, "p_size")))]
    return spark.createDataFrame(row, "key_sorted boolean, size_sorted boolean")


@query("byte_widths", "SELECT o_orderkey AS pos, CAST((length(bin(o_orderkey)) + 7) // 8 AS BIGINT) AS bytes, CAST(8 - (length(bin(o_orderkey)) + 7) // 8 AS BIGINT) AS zeros FROM orders")
def byte_widths(spark, sf_dir):
    return orders(spark, sf_dir, "o_orderkey").select("pos", U.bytewidth(F.col("v")).alias("bytes"), U.zero_bytes(F.col("v")).alias("zeros"))


@query("delta_encode", "SELECT o_orderkey AS pos, o_custkey - coalesce(lag(o_custkey, 4) OVER (PARTITION BY o_orderkey // 1024 ORDER BY o_orderkey), 0) AS v FROM orders")
def delta_encode(spark, sf_dir):
    return codecs.delta_encode(orders(spark, sf_dir, "o_custkey"), 1024, 4)


@query("delta_round_trip", "SELECT o_orderkey AS pos, o_custkey AS v FROM orders")
def delta_round_trip(spark, sf_dir):
    return codecs.delta_decode(codecs.delta_encode(orders(spark, sf_dir, "o_custkey"), 1024, 1), 1024, 1)


@query("for_encode", "SELECT o_orderkey AS pos, min(o_custkey) OVER (PARTITION BY o_orderkey // 1024) AS ref, o_custkey - min(o_custkey) OVER (PARTITION BY o_orderkey // 1024) AS v FROM orders")
def for_encode(spark, sf_dir):
    return codecs.for_encode(orders(spark, sf_dir, "o_custkey"), 1024)


@query(
    "rle_encode",
    """SELECT min(o_orderkey) AS pos, min(v) AS v, CAST(count(*) AS BIGINT) AS length FROM (
         SELECT o_orderkey, v, sum(CASE WHEN v = before THEN 0 ELSE 1 END) OVER (ORDER BY o_orderkey) AS run FROM (
           SELECT o_orderkey, o_custkey % 2 AS v, lag(o_custkey % 2) OVER (ORDER BY o_orderkey) AS before FROM orders)) GROUP BY run""",
)
def rle_encode(spark, sf_dir):
    return codecs.rle_encode(orders(spark, sf_dir, "o_custkey % 2"), ranges=1000)


@query("rle_round_trip", "SELECT o_orderkey AS pos, o_custkey % 2 AS v FROM orders")
def rle_round_trip(spark, sf_dir):
    return codecs.rle_decode(codecs.rle_encode(orders(spark, sf_dir, "o_custkey % 2"), ranges=4096))


@query(
    "dyn_vbp_sizes",
    """SELECT o_orderkey // 64 AS block, CAST(length(bin(bit_or(o_custkey))) AS BIGINT) AS width, CAST(count(*) AS BIGINT) AS n,
       CAST(length(bin(bit_or(o_custkey))) * count(*) AS BIGINT) AS bits FROM orders GROUP BY 1""",
)
def dyn_vbp_sizes(spark, sf_dir):
    return codecs.vbp_sizes(orders(spark, sf_dir, "o_custkey"), 64)


@query("k_wise_sizes", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum((length(bin(o_custkey)) + 7) // 8) + ceil(count(*) / 2.0) AS BIGINT) AS bytes FROM orders")
def k_wise_sizes(spark, sf_dir):
    return codecs.k_wise_sizes(orders(spark, sf_dir, "o_custkey"), 2)


_PLAIN = "SELECT o_orderkey AS pos, o_custkey AS v FROM orders"
for _name, _kernel in codecs.NAMES.items():

    @query(f"morph_{_name}", _PLAIN)
    def _morph(spark, sf_dir, kernel=_kernel):
        plain = codecs.NAMES["uncompressed"]
        pages = codecs.encode(orders(spark, sf_dir, "o_custkey"), plain)
        return codecs.decode(codecs.morph(pages, plain, kernel), kernel)


@query("morph_cascade", _PLAIN)
def morph_cascade(spark, sf_dir):
    from .operators.kernels import Delta, Reference

    kernel = Reference(Delta(GroupSimple(4), 4))
    return codecs.decode(codecs.encode(orders(spark, sf_dir, "o_custkey"), kernel), kernel)


@query("select_on_compressed", "SELECT o_orderkey AS pos FROM orders WHERE o_custkey < 500")
def select_on_compressed(spark, sf_dir):
    kernel = codecs.NAMES["dynamic_vbp"]
    return O.select(codecs.decode(codecs.encode(orders(spark, sf_dir, "o_custkey"), kernel), kernel), "less", 500)


@query("random_access", "SELECT o_orderkey AS pos, o_custkey AS v FROM orders WHERE o_totalprice > 400000")
def random_access(spark, sf_dir):
    kernel = NullSuppression()
    positions = O.select(orders(spark, sf_dir, "floor(o_totalprice * 100)"), "greater", 40000000)
    return codecs.read_at(codecs.encode(orders(spark, sf_dir, "o_custkey"), kernel), positions, kernel)


@query("blockwise_formats", _PLAIN)
def blockwise_formats(spark, sf_dir):
    return formats.decode_each(formats.encode_each(orders(spark, sf_dir, "o_custkey"), formats.exhaustive_choice()))


def _format_sizes() -> str:
    """SQL for the size of each page in every format and the choice among them: formulas over bit widths, and
    a walk from block to block for the formats whose blocks depend on the values."""
    fits = " ".join(f"WHEN list_max(w[place + 1 : place + {n}]) <= {64 // n} THEN {n}" for n in GROUPS)
    width = lambda x: f"CASE WHEN {x} < 0 THEN 64 ELSE length(bin({x})) END"
    return f"""
    WITH RECURSIVE v AS (SELECT o_orderkey // 2048 AS page, o_orderkey AS pos, o_custkey AS v FROM orders),
    d AS (SELECT *, v - coalesce(lag(v) OVER (PARTITION BY page ORDER BY pos), 0) AS delta, v - min(v) OVER (PARTITION BY page) AS ref FROM v),
    w AS (SELECT page, pos, 0 AS s, {width("v")} AS w FROM d UNION ALL SELECT page, pos, 1, {width("delta")} FROM d UNION ALL SELECT page, pos, 2, {width("ref")} FROM d),
    seqs AS (SELECT page, s, list(w ORDER BY pos) AS w, count(*) AS n, max(w) AS most FROM w GROUP BY page, s),
    packed AS (SELECT page, s, sum(1 + ceil(m * most / 8)) AS bytes FROM (SELECT page, s, pos % 2048 // 64 AS b, count(*) AS m, max(w) AS most FROM w GROUP BY 1, 2, 3) GROUP BY page, s),
    walk(page, s, place, blocks) AS (SELECT page, s, 0, 0 FROM seqs UNION ALL SELECT page, s, place + CASE {fits} END, blocks + 1 FROM walk JOIN seqs USING (page, s) WHERE place < n),
    simple AS (SELECT page, s, 8 + ceil(max(blocks) / 2) + 8 * max(blocks) AS bytes FROM walk GROUP BY page, s),
    sizes AS (
      SELECT page, CASE WHEN most < 64 THEN most ELSE 0 END AS code, CASE WHEN most < 64 THEN most * n // 8 ELSE 8 * n END AS bytes, 0 AS turn FROM seqs WHERE s = 0
      UNION ALL SELECT page, 65 + 2 * s, bytes + CASE WHEN s = 2 THEN 8 ELSE 0 END, 1 + 2 * s FROM packed
      UNION ALL SELECT page, 66 + 2 * s, bytes + CASE WHEN s = 2 THEN 8 ELSE 0 END, 2 + 2 * s FROM simple)
    SELECT page, n, code FROM (SELECT page, CAST(code AS BIGINT) AS code, row_number() OVER (PARTITION BY page ORDER BY bytes, turn) AS k FROM sizes)
      JOIN (SELECT page, CAST(n AS BIGINT) AS n FROM seqs WHERE s = 0) USING (page) WHERE k = 1"""


@query("format_choice", _format_sizes())
def format_choice(spark, sf_dir):
    return formats.choices(orders(spark, sf_dir, "o_custkey"), formats.exhaustive_choice())


@query("format_choice_static", "SELECT o_orderkey // 2048 AS page, CAST(count(*) AS BIGINT) AS n, CAST(65 AS BIGINT) AS code FROM orders GROUP BY 1")
def format_choice_static(spark, sf_dir):
    return formats.choices(orders(spark, sf_dir, "o_custkey"), formats.static_choice(65))


@query("sum_on_compressed", "SELECT CAST(sum(o_custkey) AS BIGINT) AS v FROM orders")
def sum_on_compressed(spark, sf_dir):
    kernel = codecs.NAMES["for"]
    pages = codecs.encode(orders(spark, sf_dir, "o_custkey"), kernel)
    return codecs.process_pages(
        pages, kernel, lambda s, v: s + int(v.sum()), 0, lambda df: df.agg(F.coalesce(F.sum("state"), F.lit(0)).cast("long").alias("v")), "state long")


@query("gen_sorted_unique", "SELECT range AS pos, 10 + 3 * range AS v FROM range(5000)")
def gen_sorted_unique(spark, sf_dir):
    return generators.sorted_unique(spark, 5000, 10, 3)


@query("gen_extraction", "SELECT CAST(800 AS BIGINT) AS n, CAST(800 AS BIGINT) AS distinct_n, true AS in_range, true AS ascending")
def gen_extraction(spark, sf_dir):
    column = generators.sorted_unique_extraction(spark, 800, 5000, 7)
    found = column.agg(F.count("*").alias("n"), F.count_distinct("v").alias("distinct_n"), (F.max("v") < 5000).alias("in_range"))
    return found.withColumn("ascending", F.lit(stats.is_sorted(column)))


@query("gen_uniform", "SELECT CAST(6000 AS BIGINT) AS n, true AS in_range, CAST(101 AS BIGINT) AS distinct_n")
def gen_uniform(spark, sf_dir):
    column = generators.with_distribution(spark, 6000, generators.uniform(100, 200, 3))
    return column.agg(F.count("*").alias("n"), ((F.min("v") >= 100) & (F.max("v") <= 200)).alias("in_range"), F.count_distinct("v").alias("distinct_n"))


@query("gen_rounded_normal", "SELECT CAST(3000 AS BIGINT) AS n, true AS in_range, true AS ascending")
def gen_rounded_normal(spark, sf_dir):
    column = generators.rounded_real(spark, 3000, "normal", (50, 20), 0, 100, 9, is_sorted=True)
    found = column.agg(F.count("*").alias("n"), ((F.min("v") >= 0) & (F.max("v") <= 100)).alias("in_range"))
    return found.withColumn("ascending", F.lit(stats.is_sorted(column)))


@query("gen_exact_number", "SELECT * FROM (VALUES (CAST(5 AS BIGINT), CAST(117 AS BIGINT)), (6, 2883)) t(v, n)")
def gen_exact_number(spark, sf_dir):
    return generators.exact_number(spark, 3000, 117, 5, 6, 2).groupBy("v").agg(F.count("*").alias("n"))


@query("gen_bitwidths", "SELECT * FROM (VALUES (CAST(3 AS BIGINT), CAST(1000 AS BIGINT)), (10, 2000), (41, 1000)) t(width, n)")
def gen_bitwidths(spark, sf_dir):
    weights = [0] * 64
    weights[2], weights[9], weights[40] = 1, 2, 1
    return stats.histogram(generators.with_bitwidths(spark, 4000, weights, 4))


@query("gen_outliers", "SELECT CAST(4000 AS BIGINT) AS n, true AS in_ranges, true AS share_fits")
def gen_outliers(spark, sf_dir):
    v = F.col("v")
    share = F.avg((v == 10).cast("double"))
    column = generators.with_outliers(spark, 4000, (10, 20), 0.3, (1000, 1010), 0.1, 8)
    return column.agg(F.count("*").alias("n"), F.bool_and(v.between(10, 20) | v.between(1000, 1010)).alias("in_ranges"), share.between(0.26, 0.34).alias("share_fits"))


@query("gen_mixture", "SELECT * FROM (VALUES (false, true), (true, true)) t(upper, share_fits)")
def gen_mixture(spark, sf_dir):
    value = generators.two_distributions(generators.two_values(1, 2, 0.5, 11), generators.uniform(1000, 1009, 2), 0.5, 3)
    column = generators.with_distribution(spark, 4000, value)
    return column.groupBy((F.col("v") >= 1000).alias("upper")).agg(F.count("*").between(1800, 2200).alias("share_fits"))


@query("variants_agree", "SELECT * FROM (VALUES ('fused', CAST(1 AS BIGINT)), ('positional', 1), ('on_compressed', 1)) t(name, status)")
def variants_agree(spark, sf_dir):
    """The same sum in three ways, run and compared by the harness."""
    kernel = codecs.NAMES["dynamic_vbp"]
    source = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("v"), F.col("o_custkey").alias("k"))
    plain = source.select("pos", "v")

    def compressed():
        again = codecs.decode(codecs.encode(plain, kernel), kernel)
        return O.agg_sum(again.where("v < 500"))

    found = harness.run_variants({
        "fused": lambda: plans.select_sum(source, "less", 500, "k", "v"),
        "positional": lambda: plans.select_sum_positional(source, "less", 500, "k", "v"),
        "on_compressed": compressed,
    })
    return spark.createDataFrame(list(found.items()), "name string, status long")


@query("select_packed", "SELECT o_orderkey AS pos FROM orders WHERE o_custkey = 500")
def select_packed(spark, sf_dir):
    return codecs.select_packed(codecs.encode(orders(spark, sf_dir, "o_custkey"), codecs.NAMES["static_vbp"]), 500)


@query("select_runs", "SELECT o_orderkey AS pos FROM orders WHERE o_custkey % 2 = 1")
def select_runs(spark, sf_dir):
    return codecs.rle_select(codecs.rle_encode(orders(spark, sf_dir, "o_custkey % 2")), F.col("v") == 1)


@query("sum_runs", "SELECT CAST(sum(o_custkey % 2) AS BIGINT) AS v FROM orders")
def sum_runs(spark, sf_dir):
    return codecs.rle_sum(codecs.rle_encode(orders(spark, sf_dir, "o_custkey % 2")))


#: Numbers below 1500 and, at two positions of three, numbers just below 2 ** 64, as patterns and for SQL.
_PATTERN = "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE -1 - o_custkey END"
_NUMBER = "(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS HUGEINT) ELSE 18446744073709551615 - CAST(o_custkey AS HUGEINT) END)"
_TOP = 1 << 64


def _unsigned(spark, sf_dir):
    return orders(spark, sf_dir, _PATTERN)


def _as_number(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, U.from_bits(F.col("v")).cast("string").alias("v"))


for _op, _sign, _bound in (("less", "<", 700), ("lessequal", "<=", _TOP - 700), ("equal", "=", _TOP - 501), ("not_equal", "<>", _TOP - 501), ("greaterequal", ">=", 700), ("greater", ">", _TOP - 700)):

    @query(f"select_unsigned_{_op}", f"SELECT o_orderkey AS pos FROM orders WHERE {_NUMBER} {_sign} {_bound}")
    def _select_unsigned(spark, sf_dir, op=_op, bound=_bound):
        return O.select(_unsigned(spark, sf_dir), op, bound)


@query("between_unsigned", f"SELECT o_orderkey AS pos FROM orders WHERE {_NUMBER} >= 1000 AND {_NUMBER} < {_TOP - 1000}")
def between_unsigned(spark, sf_dir):
    return O.between(_unsigned(spark, sf_dir), 1000, _TOP - 1000)


@query("min_unsigned", f"SELECT o_orderkey AS pos, CAST(least({_NUMBER}, CAST(o_orderkey AS HUGEINT)) AS VARCHAR) AS v FROM orders")
def min_unsigned(spark, sf_dir):
    return _as_number(O.calc(pair(spark, sf_dir, _PATTERN, "o_orderkey"), "min", "a", "b"), "pos")


@query("div_unsigned", f"SELECT o_orderkey AS pos, CAST({_NUMBER} // (o_custkey + 7) AS VARCHAR) AS v FROM orders")
def div_unsigned(spark, sf_dir):
    return O.calc(pair(spark, sf_dir, _PATTERN, "o_custkey + 7"), "div", "a", "b").select("pos", F.col("v").cast("string").alias("v"))


@query("sum_unsigned", f"SELECT CAST(sum({_NUMBER}) % {_TOP} AS VARCHAR) AS v FROM orders")
def sum_unsigned(spark, sf_dir):
    return _as_number(O.agg_sum(_unsigned(spark, sf_dir)))


@query("sum_grouped_unsigned", f"SELECT o_custkey AS gid, CAST(sum({_NUMBER}) % {_TOP} AS VARCHAR) AS v FROM orders GROUP BY 1")
def sum_grouped_unsigned(spark, sf_dir):
    groups = orders(spark, sf_dir, "o_custkey")
    n = groups.agg(F.max("v") + 1).first()[0]
    summed = O.agg_sum_grouped(groups.withColumnRenamed("v", "gid"), _unsigned(spark, sf_dir), n, check=False)
    return _as_number(summed.join(groups.select(F.col("v").alias("gid")).distinct(), "gid"), "gid")


@query("properties_unsigned", f"""SELECT CAST(min({_NUMBER}) AS VARCHAR) AS least, CAST(max({_NUMBER}) AS VARCHAR) AS greatest,
       (SELECT count(*) = 0 FROM (SELECT {_NUMBER} < lag({_NUMBER}) OVER (ORDER BY o_orderkey) AS bad FROM orders) WHERE bad) AS sorted, true AS halves_sorted FROM orders""")
def properties_unsigned(spark, sf_dir):
    found = stats.data_properties(_unsigned(spark, sf_dir))
    # Signed order would put the upper half first.
    halves = stats.is_sorted(orders(spark, sf_dir, "CASE WHEN o_orderkey < 5000 THEN o_orderkey ELSE -1 - (1000000000 - o_orderkey) END"))
    return spark.createDataFrame([(str(found.least), str(found.greatest), found.sorted_ascending, halves)], "least string, greatest string, sorted boolean, halves_sorted boolean")


@query("project_packed_positions", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_custkey AS v FROM orders WHERE o_totalprice > 300000")
def project_packed_positions(spark, sf_dir):
    """A position list that is kept packed between the selection and the projection."""
    positions = O.select(orders(spark, sf_dir, "floor(o_totalprice * 100)"), "greater", 30000000)
    return codecs.project_packed(orders(spark, sf_dir, "o_custkey"), codecs.pack_positions(positions))


for _name in ("static_vbp", "vbp_padding"):

    @query(f"random_access_{_name}", "SELECT o_orderkey AS pos, o_custkey AS v FROM orders WHERE o_totalprice > 400000")
    def _random_access(spark, sf_dir, kernel=codecs.NAMES[_name]):
        """Values read where they lie in a packed page."""
        positions = O.select(orders(spark, sf_dir, "floor(o_totalprice * 100)"), "greater", 40000000)
        return codecs.read_at(codecs.encode(orders(spark, sf_dir, "o_custkey"), kernel), positions, kernel)


@query("encoded_sizes", """SELECT o_orderkey // 2048 AS page, CAST(count(*) * 8 AS BIGINT) AS plain, CAST(1 + ceil(count(*) * length(bin(bit_or(o_custkey))) / 8.0) AS BIGINT) AS packed,
       CAST(sum((length(bin(o_custkey)) + 7) // 8) + ceil(count(*) / 2.0) AS BIGINT) AS k_wise FROM orders GROUP BY 1""")
def encoded_sizes(spark, sf_dir):
    """Bytes of real pages in three formats, against the formulas of their sizes."""
    column = orders(spark, sf_dir, "o_custkey")
    sizes = [codecs.encode(column, codecs.NAMES[f]).select("page", F.lit(name).alias("name"), F.octet_length("data").cast("long").alias("bytes"))
             for f, name in (("uncompressed", "plain"), ("static_vbp", "packed"), ("k_wise_ns", "k_wise"))]
    one = lambda name: F.max(F.when(F.col("name") == name, F.col("bytes"))).alias(name)
    return sizes[0].union(sizes[1]).union(sizes[2]).groupBy("page").agg(one("plain"), one("packed"), one("k_wise"))


@query("gen_bitwidths_whole_range", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(500 AS BIGINT)), (63, 1000), (64, 1500)) t(width, n)")
def gen_bitwidths_whole_range(spark, sf_dir):
    weights = [0] * 64
    weights[0], weights[62], weights[63] = 1, 2, 3
    return stats.histogram(generators.with_bitwidths(spark, 3000, weights, 4))


@query("literal_column", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(22 AS BIGINT)), (1, 44), (2, 11), (3, 22)) t(pos, v)")
def literal_column(spark, sf_dir):
    return from_values(spark, [22, 44, 11, 22])


@query("equality_check", "SELECT true AS same, true AS other_order, false AS other_value, false AS other_count")
def equality_check(spark, sf_dir):
    a = orders(spark, sf_dir, "o_custkey")
    row = [(harness.equal(a, a), harness.equal(a, a.orderBy(F.desc("v"))), harness.equal(a, orders(spark, sf_dir, "o_custkey + 1")), harness.equal(a, a.union(a)))]
    return spark.createDataFrame(row, "same boolean, other_order boolean, other_value boolean, other_count boolean")


@query("monitored_column", """SELECT 'custkey.count' AS name, CAST(count(*) AS VARCHAR) AS value FROM orders UNION ALL SELECT 'custkey.least', CAST(min(o_custkey) AS VARCHAR) FROM orders
       UNION ALL SELECT 'custkey.greatest', CAST(max(o_custkey) AS VARCHAR) FROM orders UNION ALL SELECT 'custkey.distinct', CAST(count(DISTINCT o_custkey) AS VARCHAR) FROM orders
       UNION ALL SELECT 'custkey.bits_' || length(bin(o_custkey)), CAST(count(*) AS VARCHAR) FROM orders GROUP BY length(bin(o_custkey))""")
def monitored_column(spark, sf_dir):
    monitor = harness.Monitor()
    monitor.column("custkey", orders(spark, sf_dir, "o_custkey"))
    return spark.createDataFrame([(r["name"], str(r["value"])) for r in monitor.rows if r["kind"] == "int"], "name string, value string")


@query("register_primitives", """SELECT o_orderkey // 4 AS register, max(o_custkey) FILTER (o_orderkey % 4 = 2) AS third, list(o_custkey ORDER BY (o_orderkey + 3) % 4) AS rotated,
       coalesce(list(o_custkey ORDER BY o_orderkey) FILTER (o_orderkey % 4 IN (0, 3)), []) AS stored, [7, 7, 7]::BIGINT[] AS ones, [5, 8, 11]::BIGINT[] AS steps FROM orders GROUP BY 1""")
def register_primitives(spark, sf_dir):
    rows = orders(spark, sf_dir, "o_custkey").groupBy(F.expr("pos div 4").alias("register")).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("r"))
    lanes, long = F.col("r.v"), lambda x: F.lit(x).cast("long")
    return rows.select("register", P.extract_value(lanes, 2).alias("third"), P.rotate(lanes).alias("rotated"), P.compressstore(lanes, long(0b1001)).alias("stored"),
                       P.set1(long(7), 3).alias("ones"), P.set_sequence(long(5), long(3), 3).alias("steps"))


@query("unique_estimate", "SELECT true AS key_first, (SELECT count(*) = count(DISTINCT o_custkey) FROM orders WHERE o_orderkey < 1000) AS cust_first")
def unique_estimate(spark, sf_dir):
    row = [(stats.is_unique_estimate(orders(spark, sf_dir, "o_orderkey")), stats.is_unique_estimate(orders(spark, sf_dir, "o_custkey")))]
    return spark.createDataFrame(row, "key_first boolean, cust_first boolean")


@query("select_bits_unsigned", "SELECT o_orderkey AS pos FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey < 700")
def select_bits_unsigned(spark, sf_dir):
    """An unsigned comparison of patterns, of which those with the top bit set are large."""
    bits = orders(spark, sf_dir, "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE -1 - o_custkey END")
    return O.select(bits, U.bits_less, 700)
