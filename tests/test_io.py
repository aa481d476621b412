"""Readers and writers: round trips of simulated crosses, and small files of each text format."""

import pytest
from pyspark.sql import functions as F

from crossloom.operators import sim
from crossloom.sources import readers, writers


@pytest.fixture(scope="module")
def mice(spark):
    m = sim.sim_map(spark, [50.0, 30.0], 5, include_x=False, seed=11)
    c = sim.sim_cross(m, "f2", 25, [("1", 20.0, 1.0, 0.0)], missing=0.1, partial_missing=0.1, seed=12)
    return c.with_(pheno=c.pheno.select("ind", F.lit("weight").alias("trait"), F.round("y", 4).alias("y")))


def cells(cross):
    return sorted((r.ind, r.marker, r.g) for r in cross.geno.collect())


@pytest.mark.parametrize("format", ["csv", "csvr", "csvs", "tidy", "mm", "gary", "mapqtl", "qtlcart"])
def test_round_trip(spark, mice, tmp_path, format):
    c = mice
    p = lambda n: str(tmp_path / n)
    if format in ("csv", "csvr"):
        getattr(writers, f"write_{format}")(c, p("a"))
        back = readers.read_cross(spark, format, p("a"), crosstype="f2")
    elif format == "csvs":
        writers.write_csvs(c, p("g"), p("p"))
        back = readers.read_csvs(spark, p("g"), p("p"), crosstype="f2")
    elif format in ("tidy", "mapqtl"):
        getattr(writers, f"write_{format}")(c, p("g"), p("p"), p("m"))
        back = readers.READERS[format](spark, p("g"), p("p"), p("m"))
    elif format == "mm":
        writers.write_mm(c, p("r"), p("m"))
        back = readers.read_mm(spark, p("r"), p("m"))
    elif format == "gary":
        writers.write_gary(c, p("d"))
        back = readers.read_gary(spark, *(p(f"d/{n}") for n in ("geno.dat", "mnames.txt", "chrid.dat", "pheno.dat", "pnames.txt", "markerpos.txt")))
    else:
        writers.write_qtlcart(c, p("c"), p("m"))
        back = readers.read_qtlcart(spark, p("c"), p("m"))
    assert cells(back) == cells(c)
    a = {(r.ind, r.trait): r.y for r in back.pheno.where("trait = 'weight'").collect()}
    assert a == {(r.ind, r.trait): r.y for r in c.pheno.collect()}
    pos = {r.marker: r.pos for r in back.map.collect()}
    assert all(abs(pos[r.marker] - r.pos) < 1e-5 for r in c.map.collect())


def test_code_matrix(spark, tmp_path):
    for name, text in (("g", "1 2 0\n3 4 2\n"), ("m", "2\n2 0.1\nA1 A2\n1\nB1\n"), ("p", "y sex\n1.5 0\n- 1\n")):
        (tmp_path / name).write_text(text)
    c = readers.read_karl(spark, *(str(tmp_path / n) for n in "gmp"))
    assert cells(c) == [(1, "A1", 1), (1, "A2", 2), (2, "A1", 3), (2, "A2", 4), (2, "B1", 2)]
    assert [r.y for r in c.pheno.where("trait = 'y'").collect()] == [1.5]
    assert abs(c.map.where("marker = 'A2'").first().pos - 11.157) < 1e-3


def test_nested_text(spark, tmp_path):
    text = "{mmx\n0.2\n{pgy\n3\n1\n2\n3\n}pgy\n{trt\nw\n{tvl\n1.5 X 2.5\n}tvl\n}trt\n{chx\n1\n{lox\nM1\n1\nAHB\n}lox\n{lox\nM2\n1\nB-A\n}lox\n}chx\n}mmx\n"
    (tmp_path / "x").write_text(text)
    c = readers.read_qtx(spark, str(tmp_path / "x"))
    assert cells(c) == [(1, "M1", 1), (1, "M2", 3), (2, "M1", 2), (3, "M1", 3), (3, "M2", 1)]
    assert sorted((r.ind, r.y) for r in c.pheno.collect()) == [(1, 1.5), (3, 2.5)]


def test_four_way_codes():
    assert [readers.mq_code("<abxcd>", "{00}", g) for g in ("ac", "bc", "ad", "bd", "--")] == [1, 2, 3, 4, 0]
    assert readers.mq_code("<abxcd>", "{10}", "bc") == 1 and readers.mq_code("<lmxll>", "{0-}", "lm") == 6
    assert readers.mq_code("<nnxnp>", "{-0}", "nn") == 7 and readers.mq_code("<hkxhk>", "{00}", "hk") == 10


def test_multi_parent_masks(spark, tmp_path):
    (tmp_path / "r").write_text("id,M1,M2\n,1,1\n,0,5\na,1,2\nb,2,-\n")
    (tmp_path / "f").write_text("marker,A,B,C,D\nM1,1,2,2,1\nM2,1,2,NA,1\n")
    c = readers.read_mwril(spark, str(tmp_path / "r"), str(tmp_path / "f"), "ri4self")
    assert cells(c) == [(1, "M1", 9), (1, "M2", 6), (2, "M1", 6)]
    assert sorted(r.g for r in readers.restore_mwril(c, 2).collect()) == [0, 1, 1]


def test_qtab(mice):
    t = writers.qtab_tables(mice)
    assert t["locations"].count() == 10 and t["genotypes"].where(F.length("geno") > 0).count() == 25
