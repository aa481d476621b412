"""Projections, filters and metadata of a cross: plain DataFrame expressions, pushed down to the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossloom.model import Cross, ordered_chr


def match_chr(selection, names: list[str]) -> list[str]:
    """Chosen chromosomes in map order. A selection holds names, ``-name`` for all but these, or booleans."""
    if selection is None:
        return list(names)
    chosen = [selection] if isinstance(selection, (str, int)) and not isinstance(selection, bool) else list(selection)
    if chosen and all(isinstance(x, bool) for x in chosen):
        if len(chosen) != len(names):
            raise ValueError("as many booleans as chromosomes are needed")
        return [n for n, keep in zip(names, chosen, strict=True) if keep]
    text = [str(x) for x in chosen]
    minus = [x[1:] for x in text if x.startswith("-") and x not in names]
    if minus and len(minus) != len(text):
        raise ValueError("names with and without a minus can't be mixed")
    wanted = minus or text
    if unknown := [x for x in wanted if x not in names]:
        raise ValueError(f"unknown chromosomes: {unknown}")
    return [n for n in names if (n not in wanted) == bool(minus)]


def test_chr(selection: Iterable[str], names: list[str]) -> list[bool]:
    return [str(x).removeprefix("-") in names for x in selection]


def chr_names(cross: Cross) -> list[str]:
    return [r["chr"] for r in cross.map.select("chr").distinct().orderBy(*ordered_chr()).collect()]


def check_index(index: Iterable[int], size: int) -> bool:
    """Is it a valid row or column index: within range, and without mixed signs?"""
    index = list(index)
    return all(0 < abs(k) <= size for k in index) and not (any(k > 0 for k in index) and any(k < 0 for k in index))


def subset(cross: Cross, chr_=None, ind: DataFrame | Column | Iterable[int] | None = None) -> Cross:
    """Chromosomes by name, individuals by a condition on ``individual``, a table of ``ind``, or a few numbers."""
    if chr_ is not None:
        keep = match_chr(chr_, chr_names(cross))
        cross = cross.with_(geno=cross.geno.where(F.col("chr").isin(keep)), map=cross.map.where(F.col("chr").isin(keep)))
    if ind is not None:
        if isinstance(ind, Column):
            ind = cross.individual.where(ind).select("ind")
        elif not isinstance(ind, DataFrame):
            ind = cross.individual.where(F.col("ind").isin(list(ind))).select("ind")
        cross = cross.with_(**{k: getattr(cross, k).join(ind, "ind", "left_semi") for k in ("geno", "pheno", "individual")})
    return cross


def subset_rows(result: DataFrame, chr_=None, traits: Iterable[str] | None = None, reps: Iterable[int] | None = None) -> DataFrame:
    """Rows of a scan or of a permutation table, by chromosome (both axes of a pair scan), trait and replicate."""
    if chr_ is not None:
        axes = [c for c in ("chr", "chr1", "chr2") if c in result.columns]
        names = sorted({r[0] for a in axes for r in result.select(a).distinct().collect()})
        keep = match_chr(chr_, names)
        for a in axes:
            result = result.where(F.col(a).isin(keep))
    if traits is not None:
        result = result.where(F.col("trait").isin(list(traits)))
    if reps is not None:
        reps = list(reps)
        result = result.where(~F.col("rep").isin([-r for r in reps]) if reps and reps[0] < 0 else F.col("rep").isin(reps))
    return result


def pull_map(cross: Cross, chr_=None) -> DataFrame:
    m = cross.map if chr_ is None else cross.map.where(F.col("chr").isin(match_chr(chr_, chr_names(cross))))
    return m.select("chr", "marker", "pos")


def table_to_map(tab: DataFrame) -> DataFrame:
    """(chr, marker, pos) to a map with orders within chromosomes."""
    w = Window.partitionBy("chr").orderBy("pos", "marker")
    return tab.select("chr", F.when(F.col("chr") == "X", "X").otherwise("A").alias("chrtype"), "marker", F.row_number().over(w).cast("int").alias("ord"), "pos", F.lit(None).cast("double").alias("pos_male"))


def make_unique(df: DataFrame, col: str, *order: str) -> DataFrame:
    """Repeated names get .1, .2, ... after the first."""
    k = F.row_number().over(Window.partitionBy(col).orderBy(*(order or (col,)))) - 1
    return df.withColumn("_k", k).withColumn(col, F.when(F.col("_k") > 0, F.concat(F.col(col), F.lit("."), F.col("_k").cast("string"))).otherwise(F.col(col))).drop("_k")


def pull_geno(cross: Cross, markers: list[str]) -> DataFrame:
    """One row for each individual, a column for each of the named markers; null where missing."""
    wide = cross.geno.where(F.col("marker").isin(markers)).groupBy("ind").pivot("marker", markers).agg(F.first("g"))
    return cross.individual.select("ind").join(wide, "ind", "left")


def pull_pheno(cross: Cross, traits: Iterable[str]) -> DataFrame:
    traits = list(traits)
    return cross.individual.select("ind").join(cross.pheno.where(F.col("trait").isin(traits)).groupBy("ind").pivot("trait", traits).agg(F.first("y")), "ind", "left")


def pull_genoprob(prob: DataFrame, omit_first: bool = False) -> DataFrame:
    """ind, chr, locus, pos, genotype (from 1), p."""
    long = prob.select("ind", "chr", "locus", "pos", F.posexplode("p").alias("k", "p")).select("ind", "chr", "locus", "pos", (F.col("k") + 1).alias("genotype"), "p")
    return long.where("genotype > 1") if omit_first else long


def pull_draws(draws: DataFrame) -> DataFrame:
    return draws.select("ind", "chr", "locus", "pos", F.posexplode("g").alias("k", "g")).select("ind", "chr", "locus", "pos", (F.col("k") + 1).alias("draw"), "g")


def pull_rf(rf: DataFrame, what: str = "rf") -> DataFrame:
    """m1, m2, value for both orders of each pair."""
    one = rf.select("m1", "m2", F.col(what).alias("value"))
    return one.unionByName(one.select(F.col("m2").alias("m1"), F.col("m1").alias("m2"), "value"))


def pull_markers(cross: Cross, markers: DataFrame) -> Cross:
    names = markers.select("marker").distinct()
    return cross.with_(geno=cross.geno.join(names, "marker", "left_semi").select(cross.geno.columns), map=cross.map.join(names, "marker", "left_semi").select(cross.map.columns))


def marker_names(cross: Cross) -> DataFrame:
    return cross.map.select("chr", "ord", "marker")


def phe_names(cross: Cross) -> DataFrame:
    return cross.pheno.select("trait").distinct()


def sizes(cross: Cross) -> DataFrame:
    """n_ind, n_chr, tot_mar, n_phe: one row."""
    one = lambda df, c, name: df.agg(F.count_distinct(c).alias(name))
    a, b, c, d = cross.individual.agg(F.count(F.lit(1)).alias("n_ind")), one(cross.map, "chr", "n_chr"), cross.map.agg(F.count(F.lit(1)).alias("tot_mar")), one(cross.pheno, "trait", "n_phe")
    return a.join(b).join(c).join(d)


def n_mar(cross: Cross) -> DataFrame:
    return cross.map.groupBy("chr").agg(F.count(F.lit(1)).alias("n_mar"))


def n_typed(cross: Cross, what: str = "ind") -> DataFrame:
    """Typed and missing genotypes of each individual or marker, those without any included."""
    if what == "ind":
        total = cross.map.agg(F.count(F.lit(1)).alias("total"))
        got = cross.geno.groupBy("ind").agg(F.count("g").alias("typed"))
        base = cross.individual.select("ind").join(got, "ind", "left").join(F.broadcast(total))
        key = "ind"
    else:
        total = cross.individual.agg(F.count(F.lit(1)).alias("total"))
        got = cross.geno.groupBy("marker").agg(F.count("g").alias("typed"))
        base = cross.map.select("marker").join(got, "marker", "left").join(F.broadcast(total))
        key = "marker"
    typed = F.coalesce("typed", F.lit(0))
    return base.select(key, typed.alias("n_typed"), (F.col("total") - typed).alias("n_missing"))


def chr_len(map_: DataFrame) -> DataFrame:
    return map_.groupBy("chr").agg((F.max("pos") - F.min("pos")).alias("length"))


def _ordered(*extra: str) -> Window:
    return Window.partitionBy("chr").orderBy("ord", *extra)


def summary_map(map_: DataFrame) -> DataFrame:
    """chr (null: overall), n_mar, length, ave_spacing, max_spacing."""
    gaps = map_.withColumn("gap", F.col("pos") - F.lag("pos").over(_ordered()))
    per = gaps.groupBy("chr").agg(F.count(F.lit(1)).alias("n_mar"), (F.max("pos") - F.min("pos")).alias("length"), F.sum("gap").alias("s"), F.count("gap").alias("k"), F.max("gap").alias("max_spacing"))
    both = per.rollup("chr").agg(F.sum("n_mar").alias("n_mar"), F.sum("length").alias("length"), (F.sum("s") / F.sum("k")).alias("ave_spacing"), F.max("max_spacing").alias("max_spacing"))
    return both.select("chr", "n_mar", "length", "ave_spacing", "max_spacing")


def find_large_intervals(map_: DataFrame, least: float = 35) -> DataFrame:
    nxt = F.lead(F.struct("marker", "pos")).over(_ordered())
    return map_.withColumn("n", nxt).where(F.col("n.pos") - F.col("pos") >= least).select("chr", F.col("marker").alias("left_marker"), F.col("n.marker").alias("right_marker"), (F.col("n.pos") - F.col("pos")).alias("gap"))


def find_markerpos(cross: Cross, markers: DataFrame) -> DataFrame:
    return markers.select("marker").join(cross.map, "marker").select("marker", "chr", "pos")


def find_marker(cross: Cross, places: DataFrame) -> DataFrame:
    """(chr, pos) to the nearest marker; ties: the one with more typed genotypes, then the first name."""
    typed = cross.geno.groupBy("marker").agg(F.count("g").alias("typed"))
    m = cross.map.join(typed, "marker", "left").select(F.col("chr").alias("c"), "marker", F.col("pos").alias("mpos"), F.coalesce("typed", F.lit(0)).alias("typed"))
    best = F.min(F.struct(F.abs(F.col("mpos") - F.col("pos")).alias("d"), (-F.col("typed")).alias("t"), "marker"))
    return places.join(m, F.col("chr") == F.col("c")).groupBy("chr", "pos").agg(best.alias("b")).select("chr", "pos", F.col("b.marker").alias("marker"))


def find_flanking(map_: DataFrame, places: DataFrame) -> DataFrame:
    """Left, right and closest marker of each (chr, pos): as-of lookups without a range join."""
    m = map_.select("chr", "pos", "marker").withColumn("q", F.lit(False)).unionByName(places.select("chr", "pos", F.lit(None).cast("string").alias("marker"), F.lit(True).alias("q")))
    at = F.when(~F.col("q"), F.struct("pos", "marker"))
    up = Window.partitionBy("chr").orderBy("pos", "q").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("chr").orderBy(F.desc("pos"), "q").rowsBetween(Window.unboundedPreceding, 0)
    x = m.withColumns({"l": F.last(at, True).over(up), "r": F.last(at, True).over(down)}).where("q")
    close = F.when(F.col("r.pos").isNull() | (F.col("pos") - F.col("l.pos") <= F.col("r.pos") - F.col("pos")), F.col("l.marker")).otherwise(F.coalesce("r.marker", "l.marker"))
    return x.select("chr", "pos", F.col("l.marker").alias("left_marker"), F.col("r.marker").alias("right_marker"), close.alias("close_marker"))


def find_pseudomarker(loci: DataFrame, places: DataFrame) -> DataFrame:
    """Nearest locus of a grid (ties: the first). Loci and places are read once by position, each place with the loci next to it."""
    m = loci.where("chr IS NOT NULL AND pos IS NOT NULL").groupBy("chr", "pos").agg(F.min("locus").alias("locus"))
    both = m.select("chr", "pos", "locus", F.lit(False).alias("q")).unionByName(places.where("chr IS NOT NULL").select("chr", "pos", F.lit(None).cast("string").alias("locus"), F.lit(True).alias("q")).distinct())
    at = F.when(~F.col("q"), F.struct(F.col("pos").alias("lpos"), "locus"))
    upto = lambda *order: F.last(at, True).over(Window.partitionBy("chr").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    x = both.withColumns({"l": upto("pos", "q"), "r": upto(F.desc("pos"), "q")}).where("q")
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.lpos") - F.col("pos")).alias("d"), F.col(f"{c}.lpos").alias("lpos"), F.col(f"{c}.locus").alias("locus")))
    return x.withColumn("b", F.array_min(F.array(near("l"), near("r")))).where("b IS NOT NULL").select("chr", "pos", F.col("b.locus").alias("locus"), F.col("b.lpos").alias("locus_pos"))


def get_sex(raw: DataFrame, col: str = "sex") -> DataFrame:
    """Sex as 0 (female) or 1 (male), from 0/1, F/M or female/male."""
    x = F.lower(F.trim(F.col(col).cast("string")))
    return raw.withColumn(col, F.when(x.isin("0", "f", "female"), 0).when(x.isin("1", "m", "male"), 1))


def geno_names(crosstype: str, chrtype: str = "A", alleles: tuple[str, ...] = ("A", "B"), sex: int | None = None, pgm: int | None = None) -> list[str]:
    """Labels of genotypes."""
    a, b = alleles[0], alleles[1]
    if crosstype == "4way":
        a, b, c, d = alleles if len(alleles) > 3 else ("A", "B", "C", "D")
        return [a + c, b + c, a + d, b + d]
    if crosstype in ("riself", "risib", "dh"):
        return [a + a, b + b]
    if crosstype == "haploid":
        return [a, b]
    if crosstype.startswith(("ri4", "ri8", "bgmagic")):
        return [x * 2 for x in "ABCDEFGHIJKLMNOP"[: {"ri4": 4, "ri8": 8}.get(crosstype[:3], 16)]]
    if chrtype == "X":
        if sex == 1:
            return [a + "Y", b + "Y"]
        if crosstype == "bc":
            return [a + a, a + b]
        return [b + b, b + a] if pgm == 1 else [a + a, a + b]
    return [a + a, a + b] if crosstype == "bc" else [a + a, a + b, b + b]


def omit_x_chr(cross: Cross) -> Cross:
    keep = cross.map.where("chrtype <> 'X'")
    return cross.with_(map=keep, geno=cross.geno.join(keep.select("marker"), "marker", "left_semi").select(cross.geno.columns))


def summary_cross(cross: Cross) -> DataFrame:
    """check, value: counts, shares and the number of faults of each kind (0 in a valid cross)."""
    top = {"bc": 2, "f2": 5, "4way": 14, "riself": 2, "risib": 2, "dh": 2, "haploid": 2, "bcsft": 5}.get(cross.crosstype, 65535)
    m = cross.map.withColumn("back", F.col("pos") < F.lag("pos").over(_ordered()))
    faults = m.agg(F.coalesce(F.sum(F.col("back").cast("long")), F.lit(0)).alias("positions_out_of_order"), (F.count(F.lit(1)) - F.count_distinct("marker")).alias("repeated_markers"))
    g = cross.geno.agg(F.count("g").alias("typed"), F.sum((~F.col("g").between(1, top)).cast("long")).alias("codes_out_of_range"))
    one = sizes(cross).join(faults).join(g).withColumn("share_typed", F.col("typed") / (F.col("n_ind") * F.col("tot_mar")))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias("value")) for c in one.columns))).alias("x")).select("x.*")


def subset_map(map_: DataFrame, chr_) -> DataFrame:
    """Rows of a map, by a selection of chromosomes as in ``match_chr``."""
    names = [r["chr"] for r in map_.select("chr").distinct().orderBy(*ordered_chr()).collect()]
    return map_.where(F.col("chr").isin(match_chr(chr_, names)))


def get_id(cross: Cross) -> DataFrame:
    """ind, id: the id column, or the individual's number where there is none."""
    return cross.individual.select("ind", F.coalesce("id", F.col("ind").cast("string")).alias("id"))


def find_pheno(cross: Cross, traits: Iterable[str]) -> DataFrame:
    """trait, number: places (from 1, by name) of traits among all; null for unknown ones."""
    spark = cross.map.sparkSession
    number = phe_names(cross).withColumn("number", F.row_number().over(Window.orderBy("trait")))
    return spark.createDataFrame([(t,) for t in traits], "trait string").join(number, "trait", "left")


def find_marker_index(cross: Cross, markers: DataFrame) -> DataFrame:
    """marker, number: places (from 1) of markers in the whole map."""
    number = cross.map.withColumn("number", F.row_number().over(Window.orderBy(*ordered_chr(), "ord"))).select("marker", "number")
    return markers.select("marker").join(number, "marker", "left")


def locate_marker(map_: DataFrame, places: DataFrame, tol: float = 0.0) -> DataFrame:
    """chr, pos, marker: the marker at exactly a place (or within ``tol`` of it), null if there is none (ties: the first by order)."""
    m = map_.select(F.col("chr").alias("c"), F.col("pos").alias("p"), "ord", "marker")
    same = F.col("chr") == F.col("c")
    if tol > 0:  # they meet in the place's cell or next to it
        cell = lambda c: F.floor(F.col(c) / F.lit(float(tol)))
        m = m.withColumn("cell", F.explode(F.array(*(cell("p") + k for k in (-1, 0, 1)))))
        x = places.join(m, same & (cell("pos") == F.col("cell")) & (F.abs(F.col("pos") - F.col("p")) <= tol), "left")
    else:
        x = places.join(m, same & (F.col("pos") == F.col("p")), "left")
    return x.groupBy("chr", "pos").agg(F.min(F.when(F.col("marker").isNotNull(), F.struct("ord", "marker"))).alias("b")).select("chr", "pos", F.col("b.marker").alias("marker"))


def describe(table: DataFrame, digits: int = 3, most: int = 100) -> str:
    """A summary (of a scan, of permutations, of a model) as text: numbers rounded, columns aligned. Tables of over ``most`` rows, which summaries
    aren't, say how many are left out."""
    rows = table.limit(most + 1).collect()
    show = lambda v: "" if v is None else round_text(v, digits) if isinstance(v, float) else str(v)
    cells = [table.columns, *([show(v) for v in r] for r in rows[:most])]
    width = [max(len(r[k]) for r in cells) for k in range(len(table.columns))]
    lines = ["  ".join(v.rjust(w) for v, w in zip(r, width, strict=True)) for r in cells]
    return "\n".join(lines + ([f"({table.count() - most} more rows)"] if len(rows) > most else []))


def round_text(x: float, digits: int = 1) -> str:
    """A number with exactly so many digits after the point; no negative zero."""
    text = f"{x:.{digits}f}"
    return text[1:] if text.startswith("-") and not text.strip("-0.") else text
