import math

import numpy as np
import pytest

from cellweave.errors import InputError
from cellweave.sources import elements, molecules as M, readers, registry, tables  # noqa: F401


def pdb_line(n, name, element, x, occ="1.00", alt=" ", record="ATOM  ", res="ALA", chain="A", number=1):
    return f"{record}{n:5d} {name:<4}{alt}{res} {chain}{number:4d}    {x:8.3f}{0:8.3f}{0:8.3f}{occ:>6}{10:6.2f}          {element:>2}  "


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"coordinates": [[0, 1], [2, 3.5]], "ids": ["p", 7], "weights": [1, 2]}')
    rows = registry.read(spark, str(tmp_path / "a.json")).orderBy("row").collect()
    assert [(r.point_id, r.coords, r.weight) for r in rows] == [("p", [0.0, 1.0], 1.0), ("7", [2.0, 3.5], 2.0)]
    for bad in ('{"coordinates": [[NaN]]}', '{"coordinates": [[1]], "coordinates": [[2]]}', '{"points": [[1]], "coordinates": [[1]]}', '{"coordinates": [[true]]}', '{"coordinates": [[1]], "x": 1}', '{"coordinates": [[1], [1, 2]]}', '{"name": "x"}', '{"points": [[1], [2]], "ids": [1, 1]}'):
        with pytest.raises(InputError):
            M.parse_json(bad)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,y,z,weight,note\na,0,0,0,1.5,n\nb,1,2,3,2,m\n")
    rows = registry.read(spark, str(tmp_path / "a.csv")).orderBy("row").collect()
    assert [(r.point_id, r.coords, r.weight, r.attrs["note"]) for r in rows] == [("a", [0, 0, 0], 1.5, "n"), ("b", [1, 2, 3], 2.0, "m")]
    (tmp_path / "b.csv").write_text("x,y\n0,0\n")
    with pytest.raises(InputError):
        registry.read(spark, str(tmp_path / "b.csv"))


def test_xyz():
    assert M.parse_xyz("2\nnote\nC 0 0 0\nHe 1 2 3 q\n")[1] == ("1", [1.0, 2.0, 3.0], {"element": "He", "extra": "q"}, 1.0)
    with pytest.raises(InputError):
        M.parse_xyz("3\n\nC 0 0 0\n")


def test_pdb():
    text = "\n".join([pdb_line(1, " CA", "C", 1.5), pdb_line(2, "CA", "CA", 2.5, record="HETATM"), pdb_line(3, " CA", "", 3.5), pdb_line(4, "CA", "", 4.5)])
    assert [r[2]["element"] for r in M.parse_pdb(text)] == ["C", "Ca", "C", "Ca"]
    two = "MODEL        1\n" + text + "\nENDMDL\nMODEL        2\n" + pdb_line(9, " N", "N", 0) + "\nENDMDL\n"
    with pytest.raises(InputError):
        M.parse_pdb(two)
    assert len(M.parse_pdb(two, model=2)) == 1
    assert [M.formal_charge(x) for x in ("  ", "0", "2+", "1-", "-1")] == [None, 0, 2, -1, -1]
    with pytest.raises(InputError):
        M.formal_charge("x")


def test_pdbqt():
    line = f"{'ATOM  '}{1:5d}  N   ALA A{1:4d}    {1:8.3f}{2:8.3f}{3:8.3f}{1:6.2f}{0:6.2f}    {-0.35:6.3f} NA"
    assert M.parse_pdb(line, docking=True)[0][2] == {"record": "ATOM", "name": "N", "residue": "ALA", "chain": "A", "residue_number": "1", "occupancy": "1.00", "b_factor": "0.00", "partial_charge": "-0.350", "docking_type": "NA", "element": "N"}


def test_mol2():
    text = "@<TRIPOS>MOLECULE\nx\n2 1\n@<TRIPOS>ATOM\n1 C1 0 0 0 C.3 1 LIG 0.1\n2 O1 1 0 0 O.2 1 LIG -0.1\n@<TRIPOS>BOND\n1 1 2 2\n"
    assert [r[2]["element"] for r in M.parse_mol2(text)] == ["C", "O"]
    with pytest.raises(InputError):
        M.parse_mol2(text.replace("2 1\n@", "3 1\n@"))


def test_mol_and_sdf():
    v2 = "x\n\n\n  2  1  0  0  0  0  0  0  0  0999 V2000\n    0.0000    0.0000    0.0000 C   0  0\n    1.2000    0.0000    0.0000 N   0  3\n  1  2  1  0\nM  CHG  1   2   1\nM  END\n"
    rows = M.parse_mol(v2)
    assert rows[0][2]["bonds"] == "2:1" and rows[1][2]["formal_charge"] == "1"
    v3 = "x\n\n\n  0  0  0     0  0            999 V3000\nM  V30 BEGIN CTAB\nM  V30 COUNTS 2 1 0 0 0\nM  V30 BEGIN ATOM\nM  V30 1 C 0 0 0 0\nM  V30 2 O 1 0 -\nM  V30 0 0 CHG=-1\nM  V30 END ATOM\nM  V30 BEGIN BOND\nM  V30 1 2 1 2\nM  V30 END BOND\nM  V30 END CTAB\nM  END\n"
    assert M.parse_mol(v3)[1][2] == {"element": "O", "formal_charge": "-1"}
    assert len(M.parse_mol(v2 + "> <a>\n1\n\n$$$$\n", sdf=True)) == 2
    with pytest.raises(InputError):
        M.parse_mol(v2 + "$$$$\n" + v2, sdf=True)


def test_cif():
    text = "data_x\n_cell_length_a 2\n_cell.length_b 4\n_cell_length_c 6(1)\n_cell_angle_alpha 90\n_cell_angle_beta 90\n_cell_angle_gamma 90\nloop_\n_atom_site_label\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\n'Fe 1' Fe 0.5 0.5 0.5\nO1 O 0 0 1\n"
    rows = M.parse_cif(text)
    assert rows[0][0] == "Fe 1" and np.allclose([r[1] for r in rows], [[1, 2, 3], [0, 0, 6]])
    with pytest.raises(InputError):
        M.parse_cif(text + "extra\n")


def test_weights(spark):
    points = spark.createDataFrame([("c", "1", 0, [0.0], 1.0, {"element": "C"})], readers.SCHEMA)
    assert elements.assign_element_weights(points).first().weight == 2.55
    with pytest.raises(InputError):
        elements.assign_element_weights(points.withColumn("attrs", points.attrs), overrides=None, attribute="none")


def test_registry():
    assert {"csv", "json", "xyz", "pdb", "pdbqt", "mol2", "mol", "sdf", "cif"} <= set(registry.available_readers())
    with pytest.raises(InputError):
        registry.register_reader("csv", (".x",), lambda *a: None)


def test_tables(spark, tmp_path):
    value = {"a": (1, float("inf")), "b": np.array([[1.0, math.nan]]), "c": {1: 2}}
    back = tables.from_jsonable(tables.to_jsonable(value))
    assert back["a"] == (1, float("inf")) and np.isnan(back["b"][0, 1]) and back["c"] == {1: 2}
    tables.save_result({"t": spark.range(3)}, str(tmp_path / "r"), value)
    loaded, meta = tables.load_result(spark, str(tmp_path / "r"))
    assert loaded["t"].count() == 3 and meta["a"] == (1, float("inf"))
