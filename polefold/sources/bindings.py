"""Engine tables bound to the columns of generic test tables (see FIXTURES.md), for the queries.

``SQL`` has the same rules as common table expressions for the oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NX = NY = 16
NS, R, NJ, RINGS = 17, 30, 24, 3
OFFSET = 0.5


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _i(text: str):
    return F.expr(text).cast("int")


def coef(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem", "l_linenumber", "l_partkey", "l_quantity").groupBy(_i("l_linenumber - 1").alias("k"), _i("l_partkey % 256").alias("p")).agg(F.sum("l_quantity").alias("v"))


def data(spark: SparkSession, d: str) -> DataFrame:
    """data(a, y, j, b, mu): measured values and a prediction on the same keys."""
    rows = read(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_discount")
    keys = [_i("l_orderkey % 30").alias("a"), _i("l_suppkey % 17").alias("y"), _i("l_partkey % 24").alias("j")]
    return rows.groupBy(*keys).agg(F.sum("l_quantity").alias("b"), F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("mu"))


def with_noise(df: DataFrame) -> DataFrame:
    """w, g, bg by segment j."""
    j = F.col("j")
    return df.withColumns({"w": F.when(j % 7 == 0, 0.0).otherwise(1.0), "g": 0.5 + 0.25 * (j % 5), "bg": 0.125 * (j % 3)})


def components(spark: SparkSession, d: str) -> DataFrame:
    """component(c, a, y, j, v): data split by return flag."""
    rows = read(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_returnflag")
    return rows.groupBy(F.col("l_returnflag").alias("c"), _i("l_orderkey % 30").alias("a"), _i("l_suppkey % 17").alias("y"), _i("l_partkey % 24").alias("j")).agg(F.sum("l_quantity").alias("v"))


def orientations(spark: SparkSession, d: str) -> DataFrame:
    """orientation(k, q, sigma, ux, uy, uz): unit quaternions and unit directions from vectors' components."""
    rows = read(spark, d, "embeddings", "vec_id", "embedding", "label")
    e = [F.col("embedding")[i].cast("double") for i in range(7)]
    n = F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2] + e[3] * e[3])
    m = F.sqrt(e[4] * e[4] + e[5] * e[5] + e[6] * e[6])
    quats = [(e[i] / n).alias(f"q{c}") for i, c in enumerate("xyzw")]
    units = [(e[i + 4] / m).alias(f"u{c}") for i, c in enumerate("xyz")]
    return rows.select(F.col("vec_id").cast("int").alias("k"), *quats, *units, (0.07 + 0.01 * (F.col("label") % 3)).alias("sigma"), "label")


#: a cell of each part, by rules that read alike in Spark and other SQL; a third of the triclinic ones are rhombohedral
_EDGE = "3e0 + (p_partkey % 40) / 4e1"
_LONE = "(p_size % 7 = 6 AND p_partkey % 3 = 0)"
CELL_TEXT = {
    "id": "p_partkey",
    "system": "CASE p_size % 7 WHEN 0 THEN 'cubic' WHEN 1 THEN 'hexagonal' WHEN 2 THEN 'trigonal' WHEN 3 THEN 'tetragonal' WHEN 4 THEN 'orthorhombic' WHEN 5 THEN 'monoclinic' ELSE 'triclinic' END",
    "a": _EDGE,
    "b": f"CASE WHEN p_size % 7 < 4 OR {_LONE} THEN {_EDGE} ELSE {_EDGE} + 5e-1 END",
    "c": f"CASE WHEN p_size % 7 = 0 OR {_LONE} THEN {_EDGE} ELSE {_EDGE} + 125e-2 END",
    "alpha": f"CASE WHEN {_LONE} THEN 75e0 WHEN p_size % 7 = 6 THEN 80e0 + p_partkey % 5 ELSE 90e0 END",
    "beta": f"CASE WHEN {_LONE} THEN 75e0 WHEN p_size % 7 = 6 THEN 95e0 ELSE 90e0 END",
    "gamma": f"CASE WHEN {_LONE} THEN 75e0 WHEN p_size % 7 = 6 THEN 100e0 WHEN p_size % 7 = 5 THEN 95e0 + p_partkey % 10 WHEN p_size % 7 IN (1, 2) THEN 120e0 ELSE 90e0 END",
}
#: a cubic cell, an element and a displacement of each part
FCC_TEXT = {"id": "p_partkey", "a": "4e0 + (p_partkey % 20) / 1e2", "u": "5e-3 + (p_partkey % 10) / 1e3", "element": "CASE p_size % 4 WHEN 0 THEN 'Al' WHEN 1 THEN 'Cu' WHEN 2 THEN 'Ni' ELSE 'Fe' END"}
FACES = ((0.0, 0.0, 0.0), (0.0, 0.5, 0.5), (0.5, 0.0, 0.5), (0.5, 0.5, 0.0))
#: a scan's angles, one a supplier
SCAN_TEXT = {"a": "CAST(s_suppkey AS INT)", "theta": f"(s_acctbal + 1e3) / 11e3 * {math.pi!r}"}
#: h, k, l of each part
HKL_TEXT = {"h": "CAST(p_partkey % 7 - 3 AS INT)", "k": "CAST(p_size % 5 - 2 AS INT)", "l": "CAST(p_partkey % 11 - 5 AS INT)"}


def _named(texts: dict[str, str]) -> list[str]:
    return [f"{t} AS {n}" for n, t in texts.items()]


def cells(spark: SparkSession, d: str) -> DataFrame:
    """cell(id, system, a, b, c, alpha, beta, gamma), one a part."""
    return read(spark, d, "part", "p_partkey", "p_size").selectExpr(*_named(CELL_TEXT))


def fcc_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cubic cells with u and element, one a part."""
    rows = read(spark, d, "part", "p_partkey", "p_size").selectExpr(*_named(FCC_TEXT))
    a, right = F.col("a"), F.lit(90.0)
    return rows.withColumns({"system": F.lit("cubic"), "b": a, "c": a, "alpha": right, "beta": right, "gamma": right})


def face_sites(cells: DataFrame) -> DataFrame:
    """The four sites of a face-centred cell, with the other columns of ``cells``."""
    places = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(p, "xyz")]) for p in FACES])
    return cells.select("*", F.explode(places).alias("_p")).select("*", "_p.*").drop("_p")


def part_hkl(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part", "p_partkey", "p_size").selectExpr(*_named(CELL_TEXT), *_named(HKL_TEXT))


def scan(spark: SparkSession, d: str) -> DataFrame:
    """angle(a, theta), one a supplier."""
    return read(spark, d, "supplier", "s_suppkey", "s_acctbal").selectExpr(*_named(SCAN_TEXT))


def pf_data(spark: SparkSession, d: str) -> DataFrame:
    """pf(a, k, j, v) summed from the rows of data."""
    rows = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    return rows.groupBy(_i("l_orderkey % 30").alias("a"), _i("l_linenumber - 1").alias("k"), _i("l_partkey % 24").alias("j")).agg(F.sum("l_discount").alias("v")).where("v > 0")


def absorption(spark: SparkSession, d: str) -> DataFrame:
    """mu(p2, m) from the mean quantity at a pixel."""
    rows = read(spark, d, "lineitem", "l_partkey", "l_quantity")
    return rows.groupBy(_i("l_partkey % 256").alias("p2")).agg((F.avg("l_quantity") / 2000).alias("m"))


def pf_surrogate(spark: SparkSession) -> DataFrame:
    """pf(a, k, j, v): a sparse generated pole-figure table, 30 x 7 x 24 cells at most."""
    a, k, j = F.col("a"), F.col("k"), F.col("j")
    cells = spark.range(R * 7 * NJ).select(_i("id div 168").alias("a"), _i("(id div 24) % 7").alias("k"), _i("id % 24").alias("j"))
    return cells.withColumn("v", 1.0 / (1 + (5 * a + 3 * k + j) % 11)).where("v < 0.2")


def events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events", "event_id", "user_id", "event_type", "value", "props")


_ANGLES = f"SELECT a::INT AS a, (a + {OFFSET}) * pi() / {R} AS theta FROM range({R}) t(a)"
_GEO = f"""SELECT a, theta, cos(theta - pi() / 2) AS gx, sin(theta - pi() / 2) AS gy,
  ({NS} - 1) / 2.0 - cos(theta - pi() / 2) * ({NX} - 1) / 2.0 - sin(theta - pi() / 2) * ({NY} - 1) / 2.0 - {OFFSET} AS t0,
  greatest(abs(cos(theta - pi() / 2)), abs(sin(theta - pi() / 2))) AS big FROM angle"""

#: name -> (needed expressions, text)
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "coef": ((), "SELECT (l_linenumber - 1)::INT AS k, (l_partkey % 256)::INT AS p, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"),
    "dat": ((), "SELECT (l_orderkey % 30)::INT AS a, (l_suppkey % 17)::INT AS y, (l_partkey % 24)::INT AS j, sum(l_quantity) AS b, sum(l_quantity * (1 - l_discount)) AS mu FROM lineitem GROUP BY 1, 2, 3"),
    "noisy": (("dat",), "SELECT *, CASE WHEN j % 7 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS w, 0.5::DOUBLE + 0.25::DOUBLE * (j % 5) AS g, 0.125::DOUBLE * (j % 3) AS bg FROM dat"),
    "comp": ((), "SELECT l_returnflag AS c, (l_orderkey % 30)::INT AS a, (l_suppkey % 17)::INT AS y, (l_partkey % 24)::INT AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4"),
    "e7": ((), "SELECT vec_id::INT AS k, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(7)) + " FROM embeddings"),
    "orient": (("e7",), "SELECT k, e0/sqrt(e0*e0+e1*e1+e2*e2+e3*e3) AS qx, e1/sqrt(e0*e0+e1*e1+e2*e2+e3*e3) AS qy, e2/sqrt(e0*e0+e1*e1+e2*e2+e3*e3) AS qz, e3/sqrt(e0*e0+e1*e1+e2*e2+e3*e3) AS qw, "
     "e4/sqrt(e4*e4+e5*e5+e6*e6) AS ux, e5/sqrt(e4*e4+e5*e5+e6*e6) AS uy, e6/sqrt(e4*e4+e5*e5+e6*e6) AS uz, 0.07::DOUBLE + 0.01::DOUBLE * (label % 3) AS sigma, label FROM e7"),
    "angle": ((), _ANGLES),
    "cell": ((), f"SELECT {', '.join(_named(CELL_TEXT))} FROM part"),
    "fcc": ((), f"SELECT {', '.join(_named(FCC_TEXT))} FROM part"),
    "phkl": ((), f"SELECT {', '.join(_named(CELL_TEXT | HKL_TEXT))} FROM part"),
    "scan": ((), f"SELECT {', '.join(_named(SCAN_TEXT))} FROM supplier"),
    "scan_geo": (("scan",), _GEO.replace("FROM angle", "FROM scan")),
    "pfd": ((), "SELECT (l_orderkey % 30)::INT AS a, (l_linenumber - 1)::INT AS k, (l_partkey % 24)::INT AS j, sum(l_discount) AS v FROM lineitem GROUP BY 1, 2, 3 HAVING sum(l_discount) > 0"),
    "mu": ((), "SELECT (l_partkey % 256)::INT AS p2, avg(l_quantity) / 2000 AS m FROM lineitem GROUP BY 1"),
    "geo": (("angle",), _GEO),
    "radon": (
        ("geo",),
        f"""SELECT a, y, p, w FROM (
  SELECT a, y::INT AS y, p::INT AS p, least(greatest((1 + big) / 2 - abs(gx * (p % {NX}) + gy * (p // {NX}) + t0 - y), 0), least(1, big)) / big AS w
  FROM geo, range({NX * NY}) q(p), range({NS}) s(y)) WHERE w > 1e-9""",
    ),
    "pf": ((), f"SELECT * FROM (SELECT a::INT AS a, k::INT AS k, j::INT AS j, 1.0::DOUBLE / (1 + (5 * a + 3 * k + j) % 11) AS v FROM range({R}) x(a), range(7) z(k), range({NJ}) u(j)) WHERE v < 0.2"),
    "sino": (("coef", "radon"), "SELECT a, y, k, sum(v * w) AS v FROM coef JOIN radon USING (p) GROUP BY a, y, k"),
    "pred": (("sino", "pf"), "SELECT s.a, s.y, pf.j, sum(s.v * pf.v) AS v FROM sino s JOIN pf ON s.a = pf.a AND s.k = pf.k GROUP BY s.a, s.y, pf.j"),
}


def sql(final: str, *needs: str, **more: str) -> str:
    """A WITH query of the named expressions (and what they need), ``more`` in order, then ``final``."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in SQL[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    parts = [f"{n} AS ({SQL[n][1]})" for n in order] + [f"{n} AS ({t})" for n, t in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {final}" if parts else final


PI = math.pi
