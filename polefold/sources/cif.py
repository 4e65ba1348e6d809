"""Crystallographic text files as rows: one file is one row of text, parsed by a Python table function.

Only the first data block counts. ``parse`` works on one text; ``read_cif`` on files, in parallel.
Missing cell values default to a = 1, b = c = a and 90 degrees, and are named in ``warnings``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKENS = re.compile(r"'(?:[^']|'(?=\S))*'|\"(?:[^\"]|\"(?=\S))*\"|\S+")
_TERM = re.compile(r"([+-]?)\s*(\d+(?:\.\d+)?(?:/\d+)?|\.\d+)?\s*\*?\s*([xyz])?", re.I)
CELL = ("a", "b", "c", "alpha", "beta", "gamma")


def number(text: str | None) -> float | None:
    """A numeric value without its (uncertainty); None for ? and . and other text."""
    try:
        return float(re.sub(r"\(.*\)$", "", (text or "").strip()))
    except ValueError:
        return None


def unquote(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def operation(text: str) -> list[list[float]]:
    """Three rows of x, y, z factors and an offset from text such as ``-x+1/2, y, 2z``."""
    rows = []
    for part in unquote(text.strip()).lower().split(","):
        row = [0.0, 0.0, 0.0, 0.0]
        for sign, value, axis in _TERM.findall(part.replace(" ", "")):
            if value or axis:
                size = float(Fraction(value)) if value else 1.0
                row["xyz".index(axis) if axis else 3] += -size if sign == "-" else size
        rows.append(row)
    return rows


def _items(text: str) -> Iterator[str]:
    """Tokens, text blocks between semicolon lines as one token each."""
    block: list[str] | None = None
    for line in text.splitlines():
        if line.startswith(";"):
            if block is None:
                block = [line[1:]]
            else:
                yield "'" + "\n".join(block).strip() + "'"
                block = None
        elif block is not None:
            block.append(line)
        elif not line.lstrip().startswith("#"):
            for token in _TOKENS.findall(line):
                if token.startswith("#"):
                    break
                yield token


def read_block(text: str) -> tuple[dict[str, str], list[dict[str, list[str]]]]:
    """Key/value pairs and loops (column -> values) of the first data block."""
    values: dict[str, str] = {}
    loops: list[dict[str, list[str]]] = []
    tokens = list(_items(text))
    at, started = 0, False
    while at < len(tokens):
        token = tokens[at]
        low = token.lower()
        if low.startswith("data_"):
            if started:
                break
            started, at = True, at + 1
        elif low == "loop_":
            at += 1
            names = []
            while at < len(tokens) and tokens[at].startswith("_"):
                names.append(tokens[at].lower())
                at += 1
            cells = []
            while at < len(tokens) and not tokens[at].startswith("_") and tokens[at].lower() != "loop_" and not tokens[at].lower().startswith("data_"):
                cells.append(unquote(tokens[at]))
                at += 1
            if names:
                loops.append({n: cells[i :: len(names)] for i, n in enumerate(names)})
        elif token.startswith("_"):
            if at + 1 < len(tokens) and not tokens[at + 1].startswith("_"):
                values[low] = unquote(tokens[at + 1])
                at += 1
            at += 1
        else:
            at += 1
    return values, loops


def _near(p: tuple[float, ...], q: tuple[float, ...], tol: float) -> bool:
    return all(abs((a - b + 0.5) % 1 - 0.5) < tol for a, b in zip(p, q))


def expand(sites: list[dict], operations: list[str], tol: float = 0.01) -> list[dict]:
    """All images of the sites in the cell; images of one site within ``tol`` are one."""
    matrices = [operation(o) for o in operations] or [operation("x,y,z")]
    out = []
    for site in sites:
        seen: list[tuple[float, ...]] = []
        for m in matrices:
            p = tuple((r[0] * site["x"] + r[1] * site["y"] + r[2] * site["z"] + r[3]) % 1.0 for r in m)
            if not any(_near(p, q, tol) for q in seen):
                seen.append(p)
                out.append(site | {"x": p[0], "y": p[1], "z": p[2]})
    return out


def parse(text: str) -> dict:
    """cell, group (number, symbol), operations, basis (label, element, x, y, z, occ, u), warnings."""
    values, loops = read_block(text)
    warnings = []
    cell: dict[str, float] = {}
    for name in CELL:
        key = f"_cell_length_{name}" if len(name) == 1 else f"_cell_angle_{name}"
        got = number(values.get(key))
        if got is None:
            warnings.append(key)
            got = 90.0 if len(name) > 1 else cell.get("a", 1.0)
        cell[name] = got
    first = lambda *keys: next((values[k] for k in keys if k in values), None)
    group = number(first("_space_group_it_number", "_symmetry_int_tables_number"))
    symbol = first("_space_group_name_h-m_alt", "_symmetry_space_group_name_h-m", "_space_group_name_hall")
    operations, sites, aniso = [], [], {}
    for loop in loops:
        for key in ("_space_group_symop_operation_xyz", "_symmetry_equiv_pos_as_xyz"):
            operations += loop.get(key, [])
        if "_atom_site_aniso_label" in loop:
            for kind, scale in (("u", 1.0), ("b", 1 / (8 * math.pi**2))):
                parts = [loop.get(f"_atom_site_aniso_{kind}_{i}{i}") for i in (1, 2, 3)]
                if all(parts):
                    for label, *own in zip(loop["_atom_site_aniso_label"], *parts):
                        numbers = [number(x) for x in own]
                        if None not in numbers:
                            aniso[label] = scale * sum(numbers) / 3
    for loop in loops:
        if "_atom_site_fract_x" in loop:
            n = len(loop["_atom_site_fract_x"])
            column = lambda key: loop.get(key, [None] * n)  # noqa: E731,B023
            rows = zip(*(column(f"_atom_site_{k}") for k in ("label", "type_symbol", "fract_x", "fract_y", "fract_z", "occupancy", "u_iso_or_equiv", "b_iso_or_equiv")))
            for label, kind, x, y, z, occ, u, b in rows:
                place = [number(v) for v in (x, y, z)]
                if None in place:
                    continue
                name = re.match(r"[A-Za-z]{1,2}", kind or label or "X")
                iso = number(u) if number(u) is not None else (number(b) / (8 * math.pi**2) if number(b) is not None else aniso.get(label))
                sites.append({"label": label or "", "element": name[0].capitalize() if name else "X", "x": place[0], "y": place[1], "z": place[2], "occ": 1.0 if number(occ) is None else number(occ), "u": iso})
    if not operations and (group or symbol) and (group or 0) != 1:
        warnings.append("operations")  # a group is named but not listed: the basis is the asymmetric unit
    return {"cell": cell, "group": None if group is None else int(group), "symbol": symbol, "operations": operations, "basis": expand(sites, operations), "warnings": warnings}


BASIS = "path string, label string, element string, x double, y double, z double, occ double, u double"
CELLS = "path string, a double, b double, c double, alpha double, beta double, gamma double, sg int, symbol string, operations array<string>, warnings array<string>"


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def basis_of(texts: DataFrame) -> DataFrame:
    """The expanded sites of each text (path, value)."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{"path": p} | site for p, v in zip(part["path"], part["value"]) for site in parse(v)["basis"]]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BASIS.split(", ")])

    return texts.select("path", "value").mapInPandas(work, BASIS)


def cells_of(texts: DataFrame) -> DataFrame:
    """Cell, group and operations of each text (path, value)."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p, v in zip(part["path"], part["value"]):
                got = parse(v)
                rows.append({"path": p, **got["cell"], "sg": got["group"], "symbol": got["symbol"], "operations": got["operations"], "warnings": got["warnings"]})
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in CELLS.split(", ")])
            yield frame.astype({"sg": "Int32"})

    return texts.select("path", "value").mapInPandas(work, CELLS)


def read_basis(spark: SparkSession, path: str) -> DataFrame:
    return basis_of(_texts(spark, path))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return cells_of(_texts(spark, path))


def token_counts(texts: DataFrame) -> DataFrame:
    """Per line of ``value``: number of tokens (quoted ones whole) and of numeric tokens. Built-in functions only."""
    tokens = F.regexp_extract_all("value", F.lit(r"('[^']*'|\S+)"), F.lit(1))
    plain = F.transform(tokens, lambda t: F.regexp_replace(t, r"\([0-9]*\)$", ""))
    return texts.select("*", F.size(tokens).alias("n_tokens"), F.size(F.filter(plain, lambda t: t.rlike(r"^[+-]?[0-9]*\.?[0-9]+$"))).alias("n_numeric"))
