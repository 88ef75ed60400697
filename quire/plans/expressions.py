"""Calculator programs compiled to columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.postscript import compile_program
from quire.plans.registry import query, table


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _run(df: DataFrame, program: str, inputs: list[tuple[str, str]], names: list[str], keep: list[str]) -> DataFrame:
    out = compile_program(program, [(F.col(c), kind) for c, kind in inputs])
    return df.select(*keep, *(c.alias(n) for c, n in zip(out, names, strict=True)))


_KEY = ["l_orderkey", "l_linenumber"]
_KEY_SQL = "l_orderkey, l_linenumber"


@query(
    f"""SELECT {_KEY_SQL}, round(l_extendedprice * (1.0 - l_discount) * (1.0 + l_tax), 6) AS charged, CAST(l_quantity AS BIGINT) // 7 AS sevens,
    CAST(l_quantity AS BIGINT) % 7 AS rest, abs(-l_quantity) AS magnitude FROM lineitem"""
)
def ps_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic: a charge, integer division and remainder, absolute value."""
    program = """{ dup cvi 7 idiv 1 index cvi 7 mod   % price discount tax quantity sevens rest
        3 2 roll neg abs 6 3 roll               % sevens rest magnitude price discount tax
        1.0 add 3 1 roll 1.0 exch sub mul mul }"""
    out = _run(
        _lineitem(spark, sf_dir), program,
        [("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_quantity", "double")],
        ["sevens", "rest", "magnitude", "charged"], _KEY,
    )
    return out.withColumn("charged", F.round("charged", 6))


@query(
    f"""SELECT {_KEY_SQL}, l_discount < l_tax AS less, l_quantity > 25 AS many, abs(l_discount - l_tax) < 1e-6 AS same,
    l_linenumber <= 3 AS early FROM lineitem"""
)
def ps_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons; reals are equal within a tolerance."""
    program = "{ 3 le exch 25 gt 4 2 roll 2 copy lt 3 1 roll eq }"
    return _run(
        _lineitem(spark, sf_dir), program,
        [("l_discount", "double"), ("l_tax", "double"), ("l_quantity", "double"), ("l_linenumber", "int")],
        ["early", "many", "less", "same"], _KEY,
    )


@query(
    f"""SELECT {_KEY_SQL}, l_orderkey & 255 AS low, l_orderkey | 1 AS odd, xor(l_orderkey, 21845) AS flipped,
    ~l_orderkey AS inverse, l_orderkey << 3 AS up, l_orderkey >> 2 AS down FROM lineitem"""
)
def ps_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitwise operators on integers."""
    program = """{ dup 255 and exch dup 1 or exch dup 21845 xor exch dup not exch dup 3 bitshift exch -2 bitshift }"""
    return _run(_lineitem(spark, sf_dir), program, [("l_orderkey", "bigint")], ["low", "odd", "flipped", "inverse", "up", "down"], _KEY)


@query(
    f"""SELECT {_KEY_SQL}, l_suppkey AS a, l_orderkey AS b, l_suppkey AS c, l_partkey AS d, l_orderkey AS e, l_orderkey AS f FROM lineitem"""
)
def ps_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stack operators: they cost nothing at run time."""
    program = "{ 3 1 roll 2 index exch 3 copy pop pop dup }"
    out = _run(_lineitem(spark, sf_dir), program, [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint")], list("abcdef"), _KEY)
    return out


@query(
    f"""SELECT {_KEY_SQL}, CASE WHEN l_quantity > 40 THEN l_extendedprice * 0.9::DOUBLE ELSE CASE WHEN l_quantity > 20 THEN l_extendedprice * 0.95::DOUBLE ELSE l_extendedprice END END AS price
    FROM lineitem"""
)
def ps_cond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditionals become CASE expressions."""
    program = "{ dup 40 gt { pop 0.9 mul } { 20 gt { 0.95 mul } if } ifelse }"
    return _run(_lineitem(spark, sf_dir), program, [("l_extendedprice", "double"), ("l_quantity", "double")], ["price"], _KEY)


@query(
    """SELECT event_id, round(sin(radians(value)), 6) AS s, round(cos(radians(value)), 6) AS c, round(CASE WHEN value >= 0 THEN sqrt(value) END, 6) AS root,
    round(CASE WHEN value > 0 THEN ln(value) END, 6) AS natural, round(CASE WHEN value > 0 THEN log10(value) END, 6) AS decimal,
    floor(value + 0.5) AS rounded, floor(-value + 0.5) AS rounded_neg, trunc(-value) + 0.0 AS cut, ceil(value) AS up, round(degrees(atan(value / 3.0)), 6) AS angle FROM events"""
)
def ps_trig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigonometry in degrees, roots, logarithms and the language's own rounding."""
    program = """{ dup sin exch dup cos exch dup sqrt exch dup ln exch dup log exch dup round exch
        dup neg round exch dup neg truncate exch dup ceiling exch 3.0 atan }"""
    names = ["s", "c", "root", "natural", "decimal", "rounded", "rounded_neg", "cut", "up", "angle"]
    out = _run(table(spark, sf_dir, "events"), program, [("value", "double")], names, ["event_id"])
    return out.withColumns({n: F.round(n, 6) for n in ("s", "c", "root", "natural", "decimal", "angle")})


@query(
    """SELECT event_id, round(10 + power(least(greatest(value / 100.0, 0), 1), 2) * (200 - 10), 10) AS exponential,
    round(CASE WHEN least(greatest(value / 100.0, 0), 1) < 0.5 THEN least(greatest(value / 100.0, 0), 1) * 2 ELSE 2 - least(greatest(value / 100.0, 0), 1) * 2 END, 10) AS stitched FROM events"""
)
def interpolation_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential interpolation (type 2) and stitching (type 3) functions as expressions."""
    from quire.functions.interpolation import exponential, stitching

    x = F.col("value") / 100.0
    parts = [lambda t: exponential(t, 0.0, 1.0, 1), lambda t: exponential(t, 1.0, 0.0, 1)]
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(exponential(x, 10.0, 200.0, 2), 10).alias("exponential"),
        F.round(stitching(x, parts, [0.5], [(0.0, 1.0), (0.0, 1.0)]), 10).alias("stitched"),
    )
