"""Pauling electronegativities and their assignment as weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..errors import InputError

_VALUES = (
    "H 2.20 Li 0.98 Be 1.57 B 2.04 C 2.55 N 3.04 O 3.44 F 3.98 Na 0.93 Mg 1.31 Al 1.61 Si 1.90 P 2.19 S 2.58 Cl 3.16 K 0.82 Ca 1.00 Sc 1.36 Ti 1.54 V 1.63 Cr 1.66 Mn 1.55 "
    "Fe 1.83 Co 1.88 Ni 1.91 Cu 1.90 Zn 1.65 Ga 1.81 Ge 2.01 As 2.18 Se 2.55 Br 2.96 Kr 3.00 Rb 0.82 Sr 0.95 Y 1.22 Zr 1.33 Nb 1.6 Mo 2.16 Tc 1.9 Ru 2.2 Rh 2.28 Pd 2.20 Ag 1.93 "
    "Cd 1.69 In 1.78 Sn 1.96 Sb 2.05 Te 2.1 I 2.66 Xe 2.6 Cs 0.79 Ba 0.89 La 1.10 Hf 1.3 Ta 1.5 W 2.36 Re 1.9 Os 2.2 Ir 2.20 Pt 2.28 Au 2.54 Hg 2.00 Tl 1.62 Pb 2.33 Bi 2.02"
).split()
ELECTRONEGATIVITY = dict(zip(_VALUES[::2], map(float, _VALUES[1::2])))
SYMBOLS = set(ELECTRONEGATIVITY) | set("He Ne Ar Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr D".split())


def element(name: str) -> str | None:
    """A symbol by the name itself, in title case, or by its first two letters or first letter."""
    letters = "".join(c for c in name.strip() if c.isalpha())
    for x in (name.strip(), letters.title(), letters[:2].title(), letters[:1].upper()):
        if x in SYMBOLS:
            return x
    return None


def assign_element_weights(points: DataFrame, overrides: dict[str, float] | None = None, attribute: str = "element") -> DataFrame:
    """points whose weight is the electronegativity of attrs[attribute]; an element without one is an error."""
    known = ELECTRONEGATIVITY | (overrides or {})
    table = points.sparkSession.createDataFrame(sorted(known.items()), "element string, value double")  # a hundred rows
    named = points.withColumn("element", F.col("attrs")[attribute]).join(F.broadcast(table), "element", "left")
    if bad := named.where("value is null").select("element").first():
        raise InputError(f"no electronegativity for element {bad.element}")
    return named.withColumn("weight", F.col("value")).select(*points.columns)
