"""Lattices, reflections, structure factors and ring intensities."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEV_A = 12.39842  # fixed value: keV x Angstrom


def scattering_window(
    wavelength: float | None = None, energy: float | None = None, q: tuple[float, float] | None = None, two_theta: tuple[float, float] | None = None, listed: bool = False
) -> tuple[float, float, float | None]:
    """Smallest and largest q, and the wavelength if known, from what is given (Angstrom, keV, 1/Angstrom, rad).

    A wavelength goes before an energy, a window in q before one in two-theta; with an explicit list
    of reflections no window is needed.
    """
    lam = wavelength if wavelength is not None else KEV_A / energy if energy is not None else None
    if q is not None:
        return float(q[0]), float(q[1]), lam
    if two_theta is not None and lam is not None:
        low, high = (4 * math.pi / lam * math.sin(t / 2) for t in two_theta)
        return max(low, 0.0), high, lam
    if listed:
        return 0.0, math.inf, lam
    raise ValueError("a window in q, or a wavelength or energy with a window in two-theta, or listed reflections")


def lattice_matrix(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> np.ndarray:
    """Rows: a, b, c with the reciprocal a* along x, b* in the xy plane, c along z (degrees)."""
    if alpha == beta == gamma == 90:
        return np.diag([a, b, c]).astype(float)
    ca, cb, cg = (math.cos(math.radians(t)) for t in (alpha, beta, gamma))
    sa, sb = math.sin(math.radians(alpha)), math.sin(math.radians(beta))
    cgs = (ca * cb - cg) / (sa * sb)  # cosine of the reciprocal gamma
    return np.array([[a * sb * math.sqrt(1 - cgs * cgs), -a * sb * cgs, a * cb], [0.0, b * sa, b * ca], [0.0, 0.0, c]])


def reciprocal(rows: np.ndarray) -> np.ndarray:
    """Columns a*, b*, c*, with the factor 2 pi."""
    return 2 * math.pi * np.linalg.inv(rows)


def cell_volume(rows: np.ndarray) -> float:
    return abs(float(np.linalg.det(rows)))


def cell_of(rows: np.ndarray) -> tuple[float, ...]:
    n = [float(np.linalg.norm(r)) for r in rows]
    angle = lambda i, j: math.degrees(math.acos(float(rows[i] @ rows[j]) / (n[i] * n[j])))
    return (*n, angle(1, 2), angle(0, 2), angle(0, 1))


def lattice_rows(system: str, a: float, b: float | None = None, c: float | None = None, alpha: float = 90, beta: float = 90, gamma: float = 90) -> np.ndarray:
    """Rows: a along x, b in the xy plane, c; lengths and angles that the system fixes are filled in."""
    if system in ("cubic", "trigonal"):
        b = c = a
    elif system in ("tetragonal", "hexagonal"):
        b = a
    if system == "hexagonal":
        gamma = 120
    elif system == "trigonal":
        beta = gamma = alpha
    elif system in ("cubic", "tetragonal", "orthorhombic"):
        alpha = beta = gamma = 90
    if b is None or c is None:
        raise ValueError(f"{system} needs more lengths")
    ca, cb, cg = (0.0 if t == 90 else math.cos(math.radians(t)) for t in (alpha, beta, gamma))
    sg = math.sqrt(1 - cg * cg)
    height = math.sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg) / sg
    return np.array([[a, 0.0, 0.0], [b * cg, b * sg, 0.0], [c * cb, c * (ca - cb * cg) / sg, c * height]])


def crystal_system(a: float, b: float, c: float, al: float, be: float, ga: float, tol: float = 0.05) -> str:
    """System of a cell in its usual setting: the unique axis of a tetragonal cell is c, of a monoclinic one b."""
    same = lambda *v: max(v) - min(v) < tol
    right = same(al, 90) and same(be, 90) and same(ga, 90)
    if right:
        return "cubic" if same(a, b) and same(b, c) else "tetragonal" if same(a, b) else "orthorhombic"
    if same(a, b) and same(al, 90) and same(be, 90) and same(ga, 120):
        return "hexagonal"
    if same(a, b) and same(b, c) and same(al, be) and same(be, ga):
        return "trigonal"
    return "monoclinic" if same(al, 90) and same(ga, 90) else "triclinic"


def system_of_group(number: int) -> str:
    """Crystal system of a space group's number: the first system whose last number is not below it."""
    ends = {"triclinic": 2, "monoclinic": 15, "orthorhombic": 74, "tetragonal": 142, "trigonal": 167, "hexagonal": 194, "cubic": 230}
    if not 1 <= number <= 230:
        raise ValueError(f"no space group {number}")
    return next(system for system, last in ends.items() if number <= last)


def enumerate_hkl(spark: SparkSession, b: np.ndarray, q_min: float, q_max: float) -> DataFrame:
    """h, k, l, q of all reflections in the window, origin left out: three crossed ranges, pruned by q at once."""
    top = [math.ceil(q_max / float(np.linalg.norm(b[:, i]))) + 1 for i in range(3)]
    axes = [spark.range(-n, n + 1).select(F.col("id").cast("int").alias(c)) for n, c in zip(top, "hkl")]
    cells = axes[0].crossJoin(F.broadcast(axes[1])).crossJoin(F.broadcast(axes[2])).where("h <> 0 or k <> 0 or l <> 0")
    g = [sum(float(b[i, j]) * F.col(c) for j, c in enumerate("hkl")) for i in range(3)]
    return cells.withColumn("q", F.sqrt(g[0] * g[0] + g[1] * g[1] + g[2] * g[2])).where(F.col("q").between(q_min, q_max))


#: two operations on (h, k, l) from which the proper rotations of a system follow
_TURNS: dict[str, list[list[list[int]]]] = {
    "cubic": [[[0, -1, 0], [1, 0, 0], [0, 0, 1]], [[0, 0, 1], [1, 0, 0], [0, 1, 0]]],
    "hexagonal": [[[1, 1, 0], [-1, 0, 0], [0, 0, 1]], [[0, 1, 0], [1, 0, 0], [0, 0, -1]]],
    "trigonal": [[[0, 1, 0], [-1, -1, 0], [0, 0, 1]], [[0, 1, 0], [1, 0, 0], [0, 0, -1]]],
    "tetragonal": [[[0, -1, 0], [1, 0, 0], [0, 0, 1]], [[1, 0, 0], [0, -1, 0], [0, 0, -1]]],
    "orthorhombic": [[[1, 0, 0], [0, -1, 0], [0, 0, -1]], [[-1, 0, 0], [0, -1, 0], [0, 0, 1]]],
    "monoclinic": [[[-1, 0, 0], [0, -1, 0], [0, 0, 1]]],
    "triclinic": [],
}


def closed(generators: list[np.ndarray]) -> list[np.ndarray]:
    """All products of integer matrices that form a finite group."""
    found, fresh = {}, [np.eye(3, dtype=int)]
    while fresh:
        found |= {m.tobytes(): m for m in fresh}
        fresh = [p for p in (m @ g for m in fresh for g in generators) if p.tobytes() not in found]
        if len(found) > 192:
            raise ValueError("the operations do not form a point group")
    return list(found.values())


def integer_ops(system: str) -> list[np.ndarray]:
    """Operations of a crystal system on (h, k, l), with inversion."""
    return closed([np.array(m) for m in _TURNS[system]] + [-np.eye(3, dtype=int)])


def hkl_ops(rotations: list[np.ndarray]) -> list[np.ndarray]:
    """Operations on (h, k, l), with inversion, from the rotation parts of a group on fractional coordinates."""
    turned = [np.rint(np.linalg.inv(w).T).astype(int) for w in rotations]
    return closed([*turned, -np.eye(3, dtype=int)])


def laue_rotations(rotations: list[np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
    """Proper Cartesian rotations of a group given on fractional coordinates, in the frame of ``rows``."""
    out: dict[bytes, np.ndarray] = {}
    for w in rotations:
        turn = np.sign(np.linalg.det(w)) * (rows.T @ w @ np.linalg.inv(rows.T))
        left, _, right = np.linalg.svd(turn)
        if np.abs(turn - left @ right).max() > 1e-3:
            raise ValueError("the cell does not have the symmetry of the group")
        out.setdefault((np.round(left @ right, 6) + 0.0).tobytes(), left @ right)
    return list(out.values())


def families(hkl: DataFrame, ops: list[np.ndarray]) -> DataFrame:
    """h, k, l (smallest equivalent), mult, q of each family: a canonical key computed row by row, one aggregate."""
    images = [F.struct(*[sum(int(m[i, j]) * F.col(c) for j, c in enumerate("hkl")).cast("int").alias(n) for i, n in enumerate("hkl")]) for m in ops]
    keyed = hkl.withColumn("images", F.array_distinct(F.array(*images)))
    keyed = keyed.select(F.array_min("images").alias("f"), F.size("images").alias("mult"), "q")
    return keyed.groupBy("f").agg(F.max("mult").alias("mult"), F.min("q").alias("q")).select("f.h", "f.k", "f.l", "mult", "q")


def centering(letter: str, rhombohedral: bool = False) -> Column:
    """Selection rule of a lattice letter; on rhombohedral axes an R lattice has none."""
    h, k, l = F.col("h"), F.col("k"), F.col("l")
    even = lambda x: F.pmod(x, F.lit(2)) == 0
    rules = {
        "P": F.lit(True), "I": even(h + k + l), "A": even(k + l), "B": even(h + l), "C": even(h + k),
        "F": even(h + k) & even(k + l), "R": F.lit(True) if rhombohedral else F.pmod(-h + k + l, F.lit(3)) == 0,
    }
    if letter not in rules:
        raise ValueError(f"no lattice letter {letter!r}")
    return rules[letter]


def with_angles(reflections: DataFrame, wavelength: float) -> DataFrame:
    """d and two_theta; reflections that the wavelength cannot reach go."""
    s = F.col("q") * wavelength / (4 * math.pi)
    return reflections.where(s <= 1.0).withColumns({"d": 2 * math.pi / F.col("q"), "two_theta": 2 * F.asin(s)})


#: fixed values: four Gaussians and a constant of the X-ray form factors of neutral atoms
FORM_FACTORS = {
    "H": ((0.493002, 0.322912, 0.140191, 0.04081), (10.5109, 26.1257, 3.14236, 57.7997), 0.003038),
    "He": ((0.8734, 0.6309, 0.3112, 0.178), (9.1037, 3.3568, 22.9276, 0.9821), 0.0064),
    "Li": ((1.1282, 0.7508, 0.6175, 0.4653), (3.9546, 1.0524, 85.3905, 168.261), 0.0377),
    "Be": ((1.5919, 1.1278, 0.5391, 0.7029), (43.6427, 1.8623, 103.483, 0.542), 0.0385),
    "B": ((2.0545, 1.3326, 1.0979, 0.7068), (23.2185, 1.021, 60.3498, 0.1403), -0.1932),
    "C": ((2.31, 1.02, 1.5886, 0.865), (20.8439, 10.2075, 0.5687, 51.6512), 0.2156),
    "N": ((12.2126, 3.1322, 2.0125, 1.1663), (0.0057, 9.8933, 28.9975, 0.5826), -11.529),
    "O": ((3.0485, 2.2868, 1.5463, 0.867), (13.2771, 5.7011, 0.3239, 32.9089), 0.2508),
    "F": ((3.5392, 2.6412, 1.517, 1.0243), (10.2825, 4.2944, 0.2615, 26.1476), 0.2776),
    "Ne": ((3.9553, 3.1125, 1.4546, 1.1251), (8.4042, 3.4262, 0.2306, 21.7184), 0.3515),
    "Na": ((4.7626, 3.1736, 1.2674, 1.1128), (3.285, 8.8422, 0.3136, 129.424), 0.676),
    "Mg": ((5.4204, 2.1735, 1.2269, 2.3073), (2.8275, 79.2611, 0.3808, 7.1937), 0.8584),
    "Al": ((6.4202, 1.9002, 1.5936, 1.9646), (3.0387, 0.7426, 31.5472, 85.0886), 1.1151),
    "Si": ((6.2915, 3.0353, 1.9891, 1.541), (2.4386, 32.3337, 0.6785, 81.6937), 1.1407),
    "P": ((6.4345, 4.1791, 1.78, 1.4908), (1.9067, 27.157, 0.526, 68.1645), 1.1149),
    "S": ((6.9053, 5.2034, 1.4379, 1.5863), (1.4679, 22.2151, 0.2536, 56.172), 0.8669),
    "Cl": ((11.4604, 7.1964, 6.2556, 1.6455), (0.0104, 1.1662, 18.5194, 47.7784), -9.5574),
    "Ar": ((7.4845, 6.7723, 0.6539, 1.6442), (0.9072, 14.8407, 43.8983, 33.3929), 1.4445),
    "K": ((8.2186, 7.4398, 1.0519, 0.8659), (12.7949, 0.7748, 213.187, 41.6841), 1.4228),
    "Ca": ((8.6266, 7.3873, 1.5899, 1.0211), (10.4421, 0.6599, 85.7484, 178.437), 1.3751),
    "Sc": ((9.189, 7.3679, 1.6409, 1.468), (9.0213, 0.5729, 136.108, 51.3531), 1.3329),
    "Ti": ((9.7595, 7.3558, 1.6991, 1.9021), (7.8508, 0.5, 35.6338, 116.105), 1.2807),
    "V": ((10.2971, 7.3511, 2.0703, 2.0571), (6.8657, 0.4385, 26.8938, 102.478), 1.2199),
    "Cr": ((10.6406, 7.3537, 3.324, 1.4922), (6.1038, 0.392, 20.2626, 98.7399), 1.1832),
    "Mn": ((11.2819, 7.3573, 3.0193, 2.2441), (5.3409, 0.3432, 17.8674, 83.7543), 1.0896),
    "Fe": ((11.7695, 7.3573, 3.5222, 2.3045), (4.7611, 0.3072, 15.3535, 76.8805), 1.0369),
    "Co": ((12.2841, 7.3409, 4.0034, 2.3488), (4.2791, 0.2784, 13.5359, 71.1692), 1.0118),
    "Ni": ((12.8376, 7.292, 4.4438, 2.38), (3.8785, 0.2565, 12.1763, 66.3421), 1.0341),
    "Cu": ((13.338, 7.1676, 5.6158, 1.6735), (3.5828, 0.247, 11.3966, 64.8126), 1.191),
    "Zn": ((14.0743, 7.0318, 5.1652, 2.41), (3.2655, 0.2333, 10.3163, 58.7097), 1.3041),
    "Ga": ((15.2354, 6.7006, 4.3591, 2.9623), (3.0669, 0.2412, 10.7805, 61.4135), 1.7189),
    "Ge": ((16.0816, 6.3747, 3.7068, 3.683), (2.8509, 0.2516, 11.4468, 54.7625), 2.1313),
    "As": ((16.6723, 6.0701, 3.4313, 4.2779), (2.6345, 0.2647, 12.9479, 47.7972), 2.531),
    "Se": ((17.0006, 5.8196, 3.9731, 4.3543), (2.4098, 0.2726, 15.2372, 43.8163), 2.8409),
    "Br": ((17.1789, 5.2358, 5.6377, 3.9851), (2.1723, 16.5796, 0.2609, 41.4328), 2.9557),
    "Kr": ((17.3555, 6.7286, 5.5493, 3.5375), (1.9384, 16.5623, 0.2261, 39.3972), 2.825),
    "Rb": ((17.1784, 9.6435, 5.1399, 1.5292), (1.7888, 17.3151, 0.2748, 164.934), 3.4873),
    "Sr": ((17.5663, 9.8184, 5.422, 2.6694), (1.5564, 14.0988, 0.1664, 132.376), 2.5064),
    "Y": ((17.776, 10.2946, 5.72629, 3.26588), (1.4029, 12.8006, 0.125599, 104.354), 1.91213),
    "Zr": ((17.8765, 10.948, 5.41732, 3.65721), (1.27618, 11.916, 0.117622, 87.6627), 2.06929),
    "Nb": ((17.6142, 12.0144, 4.04183, 3.53346), (1.18865, 11.766, 0.204785, 69.7957), 3.75591),
    "Mo": ((3.7025, 17.2356, 12.8876, 3.7429), (0.2772, 1.0958, 11.004, 61.6584), 4.3875),
    "Tc": ((19.1301, 11.0948, 4.64901, 2.71263), (0.864132, 8.14487, 21.5707, 86.8472), 5.40428),
    "Ru": ((19.2674, 12.9182, 4.86337, 1.56756), (0.80852, 8.43467, 24.7997, 94.2928), 5.37874),
    "Rh": ((19.2957, 14.3501, 4.73425, 1.28918), (0.751536, 8.21758, 25.8749, 98.6062), 5.328),
    "Pd": ((19.3319, 15.5017, 5.29537, 0.605844), (0.698655, 7.98929, 25.2052, 76.8986), 5.26593),
    "Ag": ((19.2808, 16.6885, 4.8045, 1.0463), (0.6446, 7.4726, 24.6605, 99.8156), 5.179),
    "Cd": ((19.2214, 17.6444, 4.461, 1.6029), (0.5946, 6.9089, 24.7008, 87.4825), 5.0694),
    "In": ((19.1624, 18.5596, 4.2948, 2.0396), (0.5476, 6.3776, 25.8499, 92.8029), 4.9391),
    "Sn": ((19.1889, 19.1005, 4.4585, 2.4663), (5.8303, 0.5031, 26.8909, 83.9571), 4.7821),
    "Sb": ((19.6418, 19.0455, 5.0371, 2.6827), (5.3034, 0.4607, 27.9074, 75.2825), 4.5909),
    "Te": ((19.9644, 19.0138, 6.14487, 2.5239), (4.81742, 0.420885, 28.5284, 70.8403), 4.352),
    "I": ((20.1472, 18.9949, 7.5138, 2.2735), (4.347, 0.3814, 27.766, 66.8776), 4.0712),
    "Xe": ((20.2933, 19.0298, 8.9767, 1.99), (3.9282, 0.344, 26.4659, 64.2658), 3.7118),
    "Cs": ((20.3892, 19.1062, 10.662, 1.4953), (3.569, 0.3107, 24.3879, 213.904), 3.3352),
    "Ba": ((20.3361, 19.297, 10.888, 2.6959), (3.216, 0.2756, 20.2073, 167.202), 2.7731),
    "La": ((20.578, 19.599, 11.3727, 3.28719), (2.94817, 0.244475, 18.7726, 133.124), 2.14678),
    "Ce": ((21.1671, 19.7695, 11.8513, 3.33049), (2.81219, 0.226836, 17.6083, 127.113), 1.86264),
    "Pr": ((22.044, 19.6697, 12.3856, 2.82428), (2.77393, 0.222087, 16.7669, 143.644), 2.0583),
    "Nd": ((22.6845, 19.6847, 12.774, 2.85137), (2.66248, 0.210628, 15.885, 137.903), 1.98486),
    "Pm": ((23.3405, 19.6095, 13.1235, 2.87516), (2.5627, 0.202088, 15.1009, 132.721), 2.02876),
    "Sm": ((24.0042, 19.4258, 13.4396, 2.89604), (2.47274, 0.196451, 14.3996, 128.007), 2.20963),
    "Eu": ((24.6274, 19.0886, 13.7603, 2.9227), (2.3879, 0.1942, 13.7546, 123.174), 2.5745),
    "Gd": ((25.0709, 19.0798, 13.8518, 3.54545), (2.25341, 0.181951, 12.9331, 101.398), 2.4196),
    "Tb": ((25.8976, 18.2185, 14.3167, 2.95354), (2.24256, 0.196143, 12.6648, 115.362), 3.58324),
    "Dy": ((26.507, 17.6383, 14.5596, 2.96577), (2.1802, 0.202172, 12.1899, 111.874), 4.29728),
    "Ho": ((26.9049, 17.294, 14.5583, 3.63837), (2.07051, 0.19794, 11.4407, 92.6566), 4.56796),
    "Er": ((27.6563, 16.4285, 14.9779, 2.98233), (2.07356, 0.223545, 11.3604, 105.703), 5.92046),
    "Tm": ((28.1819, 15.8851, 15.1542, 2.98706), (2.02859, 0.238849, 10.9975, 102.961), 6.75621),
    "Yb": ((28.6641, 15.4345, 15.3087, 2.98963), (1.9889, 0.257119, 10.6647, 100.417), 7.56672),
    "Lu": ((28.9476, 15.2208, 15.1, 3.71601), (1.90182, 9.98519, 0.261033, 84.3298), 7.97628),
    "Hf": ((29.144, 15.1726, 14.7586, 4.30013), (1.83262, 9.5999, 0.275116, 72.029), 8.58154),
    "Ta": ((29.2024, 15.2293, 14.5135, 4.76492), (1.77333, 9.37046, 0.295977, 63.3644), 9.24354),
    "W": ((29.0818, 15.43, 14.4327, 5.11982), (1.72029, 9.2259, 0.321703, 57.056), 9.8875),
    "Re": ((28.7621, 15.7189, 14.5564, 5.44174), (1.67191, 9.09227, 0.3505, 52.0861), 10.472),
    "Os": ((28.1894, 16.155, 14.9305, 5.67589), (1.62903, 8.97948, 0.382661, 48.1647), 11.0005),
    "Ir": ((27.3049, 16.7296, 15.6115, 5.83377), (1.59279, 8.86553, 0.417916, 45.0011), 11.4722),
    "Pt": ((27.0059, 17.7639, 15.7131, 5.7837), (1.51293, 8.81174, 0.424593, 38.6103), 11.6883),
    "Au": ((16.8819, 18.5913, 25.5582, 5.86), (0.4611, 8.6216, 1.4826, 36.3956), 12.0658),
    "Hg": ((20.6809, 19.0417, 21.6575, 5.9676), (0.545, 8.4484, 1.5729, 38.3246), 12.6089),
    "Tl": ((27.5446, 19.1584, 15.538, 5.52593), (0.65515, 8.70751, 1.96347, 45.8149), 13.1746),
    "Pb": ((31.0617, 13.0637, 18.442, 5.9696), (0.6902, 2.3576, 8.618, 47.2579), 13.4118),
    "Bi": ((33.3689, 12.951, 16.5877, 6.4692), (0.704, 2.9238, 8.7937, 48.0093), 13.5782),
    "Po": ((34.6726, 15.4733, 13.1138, 7.02588), (0.700999, 3.55078, 9.55642, 47.0045), 13.677),
    "At": ((35.3163, 19.0211, 9.49887, 7.42518), (0.68587, 3.97458, 11.3824, 45.4715), 13.7108),
    "Rn": ((35.5631, 21.2816, 8.0037, 7.4433), (0.6631, 4.0691, 14.0422, 44.2473), 13.6905),
    "Fr": ((35.9299, 23.0547, 12.1439, 2.11253), (0.646453, 4.17619, 23.1052, 150.645), 13.7247),
    "Ra": ((35.763, 22.9064, 12.4739, 3.21097), (0.616341, 3.87135, 19.9887, 142.325), 13.6211),
    "Ac": ((35.6597, 23.1032, 12.5977, 4.08655), (0.589092, 3.65155, 18.599, 117.02), 13.5266),
    "Th": ((35.5645, 23.4219, 12.7473, 4.80703), (0.563359, 3.46204, 17.8309, 99.1722), 13.4314),
    "Pa": ((35.8847, 23.2948, 14.1891, 4.17287), (0.547751, 3.41519, 16.9235, 105.251), 13.4287),
    "U": ((36.0228, 23.4128, 14.9491, 4.188), (0.5293, 3.3253, 16.0927, 100.613), 13.3966),
    "Np": ((36.1874, 23.5964, 15.6402, 4.1855), (0.511929, 3.25396, 15.3622, 97.4908), 13.3573),
    "Pu": ((36.5254, 23.8083, 16.7707, 3.47947), (0.499384, 3.26371, 14.9455, 105.98), 13.3812),
    "Am": ((36.6706, 24.0992, 17.3415, 3.49331), (0.483629, 3.20647, 14.3136, 102.273), 13.3592),
    "Cm": ((36.6488, 24.4096, 17.399, 4.21665), (0.465154, 3.08997, 13.4346, 88.4834), 13.2887),
    "Bk": ((36.7881, 24.7736, 17.8919, 4.23284), (0.451018, 3.04619, 12.8946, 86.003), 13.2754),
    "Cf": ((36.9185, 25.1995, 18.3317, 4.24391), (0.437533, 3.00775, 12.4044, 83.7881), 13.2674),
}


def form_factor_table(spark: SparkSession) -> DataFrame:
    rows = [(e, list(a), list(b), c) for e, (a, b, c) in FORM_FACTORS.items()]
    return spark.createDataFrame(rows, "element string, fa array<double>, fb array<double>, fc double")


def form_factor(q: Column) -> Column:
    s2 = (q / (4 * math.pi)) * (q / (4 * math.pi))
    return sum((F.col("fa")[i] * F.exp(-F.col("fb")[i] * s2) for i in range(4)), F.col("fc"))


def with_elements(sites: DataFrame, table: DataFrame) -> DataFrame:
    """``sites`` with their form factors. Names ignore case, deuterium is hydrogen, an unknown element is an error."""
    name = F.initcap(F.trim("element"))
    named = sites.withColumn("element", F.when(name == "D", "H").otherwise(name))
    found = named.join(F.broadcast(table), "element", "left")
    known = F.when(F.col("fa").isNull(), F.raise_error(F.concat(F.lit("no form factor for element "), F.col("element")))).otherwise(F.col("fa"))
    return found.withColumn("fa", known)


def structure_factors(reflections: DataFrame, sites: DataFrame, table: DataFrame) -> DataFrame:
    """f2 per reflection. ``sites``: element, x, y, z, occ, u (null: no displacement): the basis, a small table.

    Columns ``f1`` and ``f2a`` of ``sites``, where there, are the anomalous terms f' and f''.
    """
    atoms = with_elements(sites, table)
    for name in ("f1", "f2a"):
        atoms = atoms.withColumn(name, F.coalesce(F.col(name), F.lit(0.0)) if name in atoms.columns else F.lit(0.0))
    both = reflections.crossJoin(F.broadcast(atoms))
    phase = 2 * math.pi * (F.col("h") * F.col("x") + F.col("k") * F.col("y") + F.col("l") * F.col("z"))
    weight = F.col("occ") * F.exp(-F.col("q") * F.col("q") * F.coalesce("u", F.lit(0.0)) / 2)
    real, imaginary = form_factor(F.col("q")) + F.col("f1"), F.col("f2a")
    keys = reflections.columns
    parts = both.groupBy(*keys).agg(
        F.sum(weight * (real * F.cos(phase) - imaginary * F.sin(phase))).alias("_re"), F.sum(weight * (real * F.sin(phase) + imaginary * F.cos(phase))).alias("_im")
    )
    return parts.select(*keys, (F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")).alias("f2"))


def steel_sites(spark: SparkSession) -> DataFrame:
    """Sites of an averaged austenitic steel (316L), a = 3.596 Angstrom."""
    places = ((0.0, 0.0, 0.0), (0.0, 0.5, 0.5), (0.5, 0.0, 0.5), (0.5, 0.5, 0.0))
    return spark.createDataFrame([(*p, 9.2, 0.0083) for p in places], "x double, y double, z double, b_coh double, u2 double")


def neutron_factors(reflections: DataFrame, sites: DataFrame) -> DataFrame:
    """f2 in barns. ``sites``: x, y, z, b_coh (fm), u2."""
    both = reflections.crossJoin(F.broadcast(sites))
    phase = 2 * math.pi * (F.col("h") * F.col("x") + F.col("k") * F.col("y") + F.col("l") * F.col("z"))
    weight = F.col("b_coh") * F.exp(-F.col("q") * F.col("q") * F.col("u2") / 2)
    keys = reflections.columns
    parts = both.groupBy(*keys).agg(F.sum(weight * F.cos(phase)).alias("_re"), F.sum(weight * F.sin(phase)).alias("_im"))
    return parts.select(*keys, (0.01 * (F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im"))).alias("f2"))


def present(reflections: DataFrame, share: float = 1e-8, cutoff: float = 0.0) -> DataFrame:
    """Without systematic absences; ``intensity`` is mult f2 in percent of the largest, at least ``cutoff`` of it."""
    top = reflections.agg(F.max("f2").alias("_f"), F.max(F.col("mult") * F.col("f2")).alias("_i"))
    both = reflections.crossJoin(F.broadcast(top)).where(F.col("f2") > share * F.col("_f"))
    return both.withColumn("intensity", 100 * F.col("mult") * F.col("f2") / F.col("_i")).where(F.col("intensity") >= 100 * cutoff).drop("_f", "_i")


def neutron_table(spark: SparkSession, b: np.ndarray, sites: DataFrame, lam_min: float, h_max: int, threshold: float = 1e-3) -> DataFrame:
    """h, k, l, gx, gy, gz (no 2 pi), d, f2 of reflections that the window and the threshold leave."""
    axes = [spark.range(-h_max, h_max + 1).select(F.col("id").cast("int").alias(c)) for c in "hkl"]
    cells = axes[0].crossJoin(F.broadcast(axes[1])).crossJoin(F.broadcast(axes[2])).where("h <> 0 or k <> 0 or l <> 0")
    g = [sum(float(b[i, j]) / (2 * math.pi) * F.col(c) for j, c in enumerate("hkl")) for i in range(3)]
    cells = cells.withColumns({n: x for n, x in zip(("gx", "gy", "gz"), g)})
    cells = cells.withColumn("d", 1 / F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz"))).where(2 * F.col("d") >= lam_min)
    return neutron_factors(cells.withColumn("q", 2 * math.pi / F.col("d")), sites).drop("q").where(F.col("f2") > threshold)


def intensity_factor(two_theta: Column, lorentz: str = "rotation", data: str = "counts", polarization: str | None = None) -> Column:
    theta, f = two_theta / 2, F.lit(1.0)
    if lorentz == "rotation":
        f = f / F.sin(theta)
    if data == "solid_angle_sum":
        f = f / F.pow(F.cos(two_theta), F.lit(3.0))
    elif data == "q_bin_mean":
        f = f / F.sin(theta)
    elif data == "two_theta_bin_mean":
        f = f / F.sin(two_theta)
    if polarization == "unpolarized":
        f = f * (1 + F.cos(two_theta) * F.cos(two_theta)) / 2
    return f


def within_angles(reflections: DataFrame, low: float, high: float) -> DataFrame:
    """Reflections whose two-theta (rad) lies in the window."""
    return reflections.where(F.col("two_theta").between(low, high))


def rings(reflections: DataFrame, rtol: float = 1e-6) -> DataFrame:
    """Ring number of every reflection: a gap in the sorted two-theta begins a new one (a small list)."""
    order = Window.partitionBy(F.lit(0)).orderBy("two_theta", "h", "k", "l")
    before = F.lag("two_theta").over(order)
    gap = F.when(before.isNull() | (F.abs(F.col("two_theta") - before) > rtol * before), 1).otherwise(0)
    return reflections.withColumn("_gap", gap).withColumn("r", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_gap")


def ring_scales(ringed: DataFrame, wavelength: float, volume: float, **model: str) -> DataFrame:
    """Per ring: intensity with all factors, and 1 / intensity with geometric mean 1."""
    i = F.col("mult") * F.col("f2") * intensity_factor(F.col("two_theta"), **model) * wavelength**3 / volume**2
    total = ringed.groupBy("r").agg(F.sum(i).alias("intensity"))
    mean = total.agg(F.avg(F.log(1 / F.col("intensity"))).alias("_m"))
    return total.crossJoin(F.broadcast(mean)).select("r", "intensity", (1 / F.col("intensity") / F.exp("_m")).alias("scale"))
