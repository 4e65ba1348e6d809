"""Queries over cells, symmetry, reflection families and crystallographic texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r4
from ..sources import cif
from .registry import query

#: a family's name in SQL: what all its members share
_KEYS = {
    "cubic": "list_sort([abs(h), abs(k), abs(l)])",
    "hexagonal": "list_append(list_max([list_sort([h, k, -h - k]), list_sort([-h, -k, h + k])]), abs(l))",
    "trigonal": "list_min([[h, k, l], [k, -h - k, l], [-h - k, h, l], [k, h, -l], [h, -h - k, -l], [-h - k, k, -l], [-h, -k, -l], [-k, h + k, -l], [h + k, -h, -l], [-k, -h, l], [-h, h + k, l], [h + k, -k, l]])",
    "tetragonal": "list_append(list_sort([abs(h), abs(k)]), abs(l))",
    "orthorhombic": "[abs(h), abs(k), abs(l)]",
    "monoclinic": "list_append(list_max([[h, k], [-h, -k]]), abs(l))",
    "triclinic": "list_max([[h, k, l], [-h, -k, -l]])",
}


_LETTERS = {"P": "true", "I": "(h + k + l) % 2 = 0", "A": "(k + l) % 2 = 0", "B": "(h + l) % 2 = 0", "C": "(h + k) % 2 = 0", "F": "h % 2 = k % 2 AND k % 2 = l % 2", "R": "(k + l - h + 30) % 3 = 0"}


_CIF = """data_{s}
_cell_length_a {a}(2)
_cell_length_b ?
_cell_length_c 5.5
_cell_angle_gamma 120
_space_group_IT_number 3
_space_group_name_H-M_alt 'P 1 1 2'
loop_
_space_group_symop_operation_xyz
'x, y, z'
'-x, -y, z'
loop_
_atom_site_label
_atom_site_type_symbol
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
_atom_site_occupancy
_atom_site_U_iso_or_equiv
Al1 Al3+ {x} {y} 0.25(1) 0.5 .
O1 O 0.1 0.2 {x} . 0.03
loop_
_atom_site_aniso_label
_atom_site_aniso_U_11
_atom_site_aniso_U_22
_atom_site_aniso_U_33
Al1 0.01 0.02 0.03(1)
data_other
_cell_length_a 99
"""


def _cif_texts(spark, d):
    """One crystallographic text a supplier."""
    s = F.col("s_suppkey")
    whole, tenth = lambda c: c.cast("string"), lambda n: F.format_number((s % n) / n, 4)
    parts = {"s": whole(s), "a": F.format_number(3 + (s % 50) / 100, 2), "x": tenth(20), "y": tenth(4)}
    text = F.lit(_CIF)
    for name, value in parts.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return spark.read.parquet(f"{d}/supplier.parquet").select(whole(s).alias("path"), text.alias("value"))


@query("cif_cells", "SELECT s_suppkey::VARCHAR AS path, round(3 + (s_suppkey % 50) / 100, 4) AS a, round(3 + (s_suppkey % 50) / 100, 4) AS b, 5.5::DOUBLE AS c, 90.0::DOUBLE AS alpha, 120.0::DOUBLE AS gamma, 3 AS sg, 2 AS operations, 3 AS warnings FROM supplier")
def cif_cells(spark, d):
    got = cif.cells_of(_cif_texts(spark, d))
    return got.select("path", r4(F.col("a")).alias("a"), r4(F.col("b")).alias("b"), "c", "alpha", "gamma", "sg", F.size("operations").alias("operations"), F.size("warnings").alias("warnings"))


@query("cif_basis", """WITH own AS (SELECT s_suppkey::VARCHAR AS path, (s_suppkey % 20) / 20 AS x, (s_suppkey % 4) / 4 AS y FROM supplier),
site AS (SELECT path, 'Al1' AS label, 'Al' AS element, x, y, 0.25 AS z, 0.5 AS occ, 0.02 AS u FROM own UNION ALL SELECT path, 'O1', 'O', 0.1, 0.2, x, 1.0, 0.03 FROM own),
image AS (SELECT * FROM site UNION SELECT path, label, element, (1 - x) % 1, (1 - y) % 1, z, occ, u FROM site)
SELECT path, label, element, round(x, 4)::DOUBLE AS x, round(y, 4)::DOUBLE AS y, round(z, 4)::DOUBLE AS z, occ::DOUBLE AS occ, round(u, 4)::DOUBLE AS u FROM (SELECT DISTINCT path, label, element, round(x, 6) AS x, round(y, 6) AS y, z, occ, u FROM image)""")
def cif_basis(spark, d):
    got = cif.basis_of(_cif_texts(spark, d))
    return got.select("path", "label", "element", *[r4(F.col(c)).alias(c) for c in ("x", "y", "z")], "occ", r4(F.col("u")).alias("u"))
