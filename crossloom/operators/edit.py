"""Editing a cross: every operator returns a new one; data are changed by expressions, joins and windows only."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossloom.functions.maps import MAP_FUNCTIONS
from crossloom.model import Cross
from crossloom.operators.order import running_total

_G = ["ind", "chr", "marker", "ord", "g"]


def _map_order() -> Window:
    return Window.partitionBy("chr").orderBy("ord")


#: Markers that go along with every task. Beyond them they are joined, which sends all genotypes of a marker to one place.
MOST_MARKERS = 200_000


def _few(markers: DataFrame) -> bool:
    return markers.limit(MOST_MARKERS + 1).count() <= MOST_MARKERS


def renumber(cross: Cross) -> Cross:
    """Orders 1, 2, ... within each chromosome again, from positions and old orders."""
    w = Window.partitionBy("chr").orderBy("pos", "ord", "marker")
    m = cross.map.withColumn("ord", F.row_number().over(w).cast("int")).select(cross.map.columns)
    place = m.select("marker", "chr", "ord")
    return cross.with_(map=m, geno=cross.geno.drop("ord", "chr").join(F.broadcast(place) if _few(cross.map) else place, "marker").select(_G))


def null_markers(cross: Cross) -> DataFrame:
    """Markers without any typed genotype."""
    return cross.map.select("marker").join(cross.geno.where("g IS NOT NULL").select("marker").distinct(), "marker", "left_anti")


def drop_markers(cross: Cross, markers: DataFrame) -> Cross:
    return _without(cross, markers, _few(markers))


def _without(cross: Cross, markers: DataFrame, few: bool) -> Cross:
    names = markers.select("marker").distinct()
    names = F.broadcast(names) if few else names
    return cross.with_(geno=cross.geno.join(names, "marker", "left_anti").select(_G), map=cross.map.join(names, "marker", "left_anti").select(cross.map.columns))


def drop_null_markers(cross: Cross) -> Cross:
    return _without(cross, null_markers(cross), _few(cross.map))


def drop_dup_markers(cross: Cross) -> Cross:
    """A name on several places keeps its first place; its genotypes are merged, conflicts become missing."""
    first = Window.partitionBy("marker").orderBy("chr", "ord")
    m = cross.map.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    merged = cross.geno.where("g IS NOT NULL").groupBy("ind", "marker").agg(F.min("g").alias("g"), F.max("g").alias("h")).where("g = h").drop("h")
    return cross.with_(map=m, geno=merged.join(m.select("marker", "chr", "ord"), "marker").select(_G))


def find_dup_markers(cross: Cross, adjacent_only: bool = False) -> DataFrame:
    """marker, grp: markers with the same typed genotypes in all individuals (grp: their first marker).

    Each marker's genotypes are reduced to two order-free sums of hashes, so no pair of markers is compared."""
    g = cross.geno.where("g IS NOT NULL")
    pair = F.struct("ind", "g")
    mark = g.groupBy("chr", "marker", "ord").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(pair).cast("decimal(38,0)")).alias("a"), F.sum(F.hash(pair).cast("long")).alias("b"))
    if adjacent_only:
        w = _map_order()
        same = (F.col("n") == F.lag("n").over(w)) & (F.col("a") == F.lag("a").over(w)) & (F.col("b") == F.lag("b").over(w))
        run = mark.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
        by = Window.partitionBy("chr", "run")
    else:
        run, by = mark, Window.partitionBy("n", "a", "b")
    return run.withColumns({"grp": F.min("marker").over(by), "k": F.count(F.lit(1)).over(by)}).where("k > 1").select("marker", "grp")


def add_marker(cross: Cross, genotypes: DataFrame, marker: str, chr_: str, pos: float) -> Cross:
    """``genotypes``: ind, g."""
    row = cross.map.sparkSession.createDataFrame([(chr_, "X" if chr_ == "X" else "A", marker, 0, float(pos), None)], cross.map.schema)
    new = genotypes.select("ind", F.lit(chr_).alias("chr"), F.lit(marker).alias("marker"), F.lit(0).alias("ord"), F.col("g").cast("int").alias("g"))
    return renumber(cross.with_(map=cross.map.unionByName(row), geno=cross.geno.unionByName(new)))


def move_marker(cross: Cross, marker: str, chr_: str, pos: float | None = None) -> Cross:
    """To a place on a chromosome; without ``pos``: 10 cM beyond its end."""
    end = cross.map.where((F.col("chr") == chr_) & (F.col("marker") != marker)).agg(F.max("pos").alias("e"))
    own = F.col("marker") == marker
    m = cross.map.join(F.broadcast(end))
    m = m.withColumns({"pos": F.when(own, F.lit(pos) if pos is not None else F.coalesce(F.col("e") + 10, F.lit(0.0))).otherwise(F.col("pos")), "chr": F.when(own, chr_).otherwise(F.col("chr")), "chrtype": F.when(own, "X" if chr_ == "X" else "A").otherwise(F.col("chrtype"))})
    return renumber(cross.with_(map=m.select(cross.map.columns)))


def flip_order(cross: Cross, chrs: list[str]) -> Cross:
    """Reverse the order of markers; flipping twice changes nothing but the first position, which becomes 0 or stays."""
    whole = Window.partitionBy("chr")
    flip = F.col("chr").isin(chrs)
    m = cross.map.withColumns({
        "n": F.max("ord").over(whole), "lo": F.min("pos").over(whole), "hi": F.max("pos").over(whole), "lom": F.min("pos_male").over(whole), "him": F.max("pos_male").over(whole)})
    m = m.withColumns({"ord": F.when(flip, F.col("n") - F.col("ord") + 1).otherwise(F.col("ord")).cast("int"), "pos": F.when(flip, F.col("hi") + F.col("lo") - F.col("pos")).otherwise(F.col("pos")), "pos_male": F.when(flip, F.col("him") + F.col("lom") - F.col("pos_male")).otherwise(F.col("pos_male"))}).select(cross.map.columns)
    return cross.with_(map=m, geno=cross.geno.drop("ord").join(m.select("marker", "ord"), "marker").select(_G))


def switch_order(cross: Cross, chr_: str, order: list[int]) -> Cross:
    """New order of a chromosome's markers (old numbers, from 1). Positions stay in place; see ``est_map`` to estimate them."""
    spark = cross.map.sparkSession
    new = spark.createDataFrame([(chr_, int(o), k + 1) for k, o in enumerate(order)], "chr string, ord int, new int")
    pos = cross.map.select("chr", F.col("ord").alias("new"), F.col("pos").alias("npos"), F.col("pos_male").alias("nmale"))
    m = cross.map.join(new, ["chr", "ord"], "left").withColumn("ord", F.coalesce("new", "ord")).drop("new")
    m = m.join(pos, (m.chr == pos.chr) & (m.ord == pos.new)).select(m.chr, "chrtype", "marker", "ord", F.col("npos").alias("pos"), F.col("nmale").alias("pos_male"))
    return cross.with_(map=m, geno=cross.geno.drop("ord").join(m.select("marker", "ord"), "marker").select(_G))


def switch_codes(crosstype: str, how: str = "AB") -> dict[int, int]:
    """Genotype codes under an exchange of alleles."""
    if crosstype == "4way":
        pairs = {"AB": [(1, 2), (3, 4), (5, 6), (9, 10), (11, 12), (13, 14)], "CD": [(1, 3), (2, 4), (7, 8), (9, 10), (11, 13), (12, 14)]}
        if how == "ABCD":
            one, two = switch_codes("4way", "AB"), switch_codes("4way", "CD")
            return {k: two.get(one.get(k, k), one.get(k, k)) for k in range(1, 15)}
        if how == "parents":
            pairs["parents"] = [(2, 3), (5, 7), (6, 8), (12, 13)]
        return {a: b for x, y in pairs[how] for a, b in ((x, y), (y, x))}
    if crosstype in ("f2", "bcsft"):
        return {1: 3, 3: 1, 4: 5, 5: 4}
    return {1: 2, 2: 1}


def _recode(g: Column, table: dict[int, int]) -> Column:
    out = g
    for a, b in table.items():
        out = F.when(g == a, F.lit(b)).otherwise(out)
    return out


def switch_alleles(cross: Cross, markers: list[str], how: str = "AB") -> Cross:
    g = F.when(F.col("marker").isin(markers), _recode(F.col("g"), switch_codes(cross.crosstype, how))).otherwise(F.col("g"))
    return cross.with_(geno=cross.geno.withColumn("g", g.cast("int")))


def strip_partials(cross: Cross) -> Cross:
    """Partially informative codes become missing."""
    return cross.with_(geno=cross.geno.where(F.col("g") <= (4 if cross.crosstype == "4way" else 3)))


def jitter_map(map_: DataFrame, amount: float = 1e-6) -> DataFrame:
    k = F.row_number().over(_map_order()) - 1
    return map_.withColumns({"pos": F.col("pos") + amount * k, "pos_male": F.col("pos_male") + amount * k})


def rescale_map(map_: DataFrame, scale: float = 1e-6) -> DataFrame:
    return map_.withColumns({"pos": F.col("pos") * scale, "pos_male": F.col("pos_male") * scale})


def shift_map(map_: DataFrame, offset: float = 0.0) -> DataFrame:
    w = Window.partitionBy("chr")
    return map_.withColumns({"pos": F.col("pos") - F.min("pos").over(w) + offset, "pos_male": F.col("pos_male") - F.min("pos_male").over(w) + offset})


def convert_map(map_: DataFrame, old: str = "haldane", new: str = "kosambi") -> DataFrame:
    """Positions under another map function: each interval's recombination fraction stays."""
    gap = F.coalesce(F.col("pos") - F.lag("pos").over(_map_order()), F.lit(0.0))
    d = MAP_FUNCTIONS[new][1](MAP_FUNCTIONS[old][0](F.col("gap")))
    x = map_.withColumns({"gap": gap, "first": F.min("pos").over(Window.partitionBy("chr"))}).withColumn("d", F.when(F.col("gap") > 0, d).otherwise(0.0))
    return x.withColumn("pos", F.col("first") + F.sum("d").over(_map_order())).select(map_.columns)


def sex_averaged(map_: DataFrame) -> DataFrame:
    """The mean of female and male positions."""
    return map_.withColumns({"pos": F.coalesce((F.col("pos") + F.col("pos_male")) / 2, "pos"), "pos_male": F.lit(None).cast("double")})


def sex_specific(map_: DataFrame) -> DataFrame:
    return map_.withColumn("pos_male", F.coalesce("pos_male", "pos"))


def interp_positions(old: DataFrame, new: DataFrame, points: DataFrame, pos: str = "pos") -> DataFrame:
    """``points`` (chr, pos) with ``new_pos``: linear between shared markers, shifted beyond the ends.

    The interval of a point is found by window functions over points and markers together, not by a range join."""
    both = old.select("chr", "marker", F.col("pos").alias("o")).join(new.select("chr", "marker", F.col("pos").alias("n")), ["chr", "marker"])
    knots = both.groupBy("chr", "o").agg(F.min("n").alias("n"))
    cols = [c for c in points.columns if c != "chr"]
    x = knots.select("chr", F.col("o").alias("_at"), F.struct("o", "n").alias("_k"), *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in cols)).unionByName(
        points.select("chr", F.col(pos).alias("_at"), F.lit(None).cast("struct<o:double,n:double>").alias("_k"), *cols)
    )
    up = Window.partitionBy("chr").orderBy(F.col("_at"), F.col("_k").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("chr").orderBy(F.desc("_at"), F.col("_k").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    y = x.withColumns({"_l": F.last("_k", True).over(up), "_r": F.last("_k", True).over(down)}).where("_k IS NULL")
    inside = F.col("_l.n") + (F.col("_at") - F.col("_l.o")) / (F.col("_r.o") - F.col("_l.o")) * (F.col("_r.n") - F.col("_l.n"))
    new_pos = F.when(F.col("_l").isNull(), F.col("_r.n") + F.col("_at") - F.col("_r.o")).when(F.col("_r").isNull(), F.col("_l.n") + F.col("_at") - F.col("_l.o")).when(F.col("_l.o") == F.col("_r.o"), F.col("_l.n")).otherwise(inside)
    return y.select("chr", *cols, new_pos.alias("new_pos"))


def replace_map(cross: Cross, new: DataFrame) -> Cross:
    m = cross.map.drop("pos").join(new.select("marker", "pos"), "marker").select(cross.map.columns)
    return renumber(cross.with_(map=m))


def replace_map_scan(scan: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    return interp_positions(old, new, scan).withColumn("pos", F.col("new_pos")).drop("new_pos").select(scan.columns)


def reduce_to_grid(loci: DataFrame, step: float) -> DataFrame:
    """Rows of a prob or draws table at the locus nearest to each multiple of ``step`` from a chromosome's start."""
    at = loci.select("chr", "locus", "pos").distinct()
    w = Window.partitionBy("chr")
    at = at.withColumn("k", F.round((F.col("pos") - F.min("pos").over(w)) / step))
    near = at.withColumn("d", F.abs(F.col("pos") - F.min("pos").over(w) - F.col("k") * step))
    keep = near.groupBy("chr", "k").agg(F.min(F.struct("d", "pos", "locus")).alias("b")).select("chr", F.col("b.locus").alias("locus"))
    return loci.join(keep, ["chr", "locus"], "left_semi").select(loci.columns)


def transform_pheno(cross: Cross, trait: str, fn: Callable[[Column], Column] | None = None, vector: Callable[[pd.Series], pd.Series] | None = None) -> Cross:
    """A Column function (default: log), or a Python function of whole batches."""
    if vector is not None:
        new = F.pandas_udf(vector, "double")(F.col("y"))
    else:
        new = (fn or F.log)(F.col("y"))
    return cross.with_(pheno=cross.pheno.withColumn("y", F.when(F.col("trait") == trait, new).otherwise(F.col("y"))))


def nq_rank(cross: Cross, trait: str) -> Cross:
    """Normal quantiles of ranks (mean ranks for ties), with the trait's mean and standard deviation.

    Ranks come from counts of values below, over the distinct values' running sum; the bulk is one aggregate by value."""
    from crossloom.functions.stats import norm_quantile_udf

    own = cross.pheno.where((F.col("trait") == trait) & F.col("y").isNotNull())
    values = own.groupBy("y").agg(F.count(F.lit(1)).alias("k"))
    total = values.agg(F.sum("k").alias("n"))
    ranked = running_total(values, "y", "k", "upto").join(F.broadcast(total)).withColumn("rank", F.col("upto") - F.col("k") + (F.col("k") + 1) / 2)
    ranked = ranked.withColumn("z", norm_quantile_udf((F.col("rank") - 0.5) / F.col("n")))
    joined = own.join(ranked.select("y", "z"), "y")
    stats = joined.agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("s"), F.avg("z").alias("mz"), F.stddev_samp("z").alias("sz"))
    new = joined.join(F.broadcast(stats)).select("ind", "trait", ((F.col("z") - F.col("mz")) / F.col("sz") * F.col("s") + F.col("m")).alias("y"))
    return cross.with_(pheno=cross.pheno.where((F.col("trait") != trait) | F.col("y").isNull()).unionByName(new))


def clean_geno(cross: Cross, maxdist: float = 2.5, maxmark: int = 2) -> Cross:
    """Drop runs of at most ``maxmark`` typed markers that differ from equal genotypes on both sides less than ``maxdist`` cM apart."""
    g = cross.geno.join(cross.map.select("marker", "pos"), "marker")
    w = Window.partitionBy("ind", "chr").orderBy("ord")
    g = g.withColumn("new", F.coalesce((F.col("g") != F.lag("g").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    runs = g.groupBy("ind", "chr", "run").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.first("g").alias("rg"))
    r = Window.partitionBy("ind", "chr").orderBy("run")
    bad = runs.withColumns({"pg": F.lag("rg").over(r), "ng": F.lead("rg").over(r), "ph": F.lag("hi").over(r), "nl": F.lead("lo").over(r)})
    bad = bad.where((F.col("pg") == F.col("ng")) & (F.col("n") <= maxmark) & (F.col("nl") - F.col("ph") <= 2 * maxdist)).select("ind", "chr", "run")
    return cross.with_(geno=g.join(bad, ["ind", "chr", "run"], "left_anti").select(_G))


def simulate_missing(cross: Cross, percentage: float = 5, seed: int = 1) -> Cross:
    """Drop about so many percent of genotypes: which ones follows from a hash, so a second run drops the same."""
    u = F.pmod(F.xxhash64("ind", "marker", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return cross.with_(geno=cross.geno.where(u >= percentage / 100))


def convert_2_ril(cross: Cross, kind: str = "riself") -> Cross:
    """To inbred lines: the commoner of codes 3 and 2 is the second homozygote, other codes are missing; X as autosome."""
    votes = cross.geno.groupBy("marker").agg(F.sum((F.col("g") == 3).cast("int")).alias("n3"), F.sum((F.col("g") == 2).cast("int")).alias("n2"))
    total = votes.agg((F.sum("n3") >= F.sum("n2")).alias("use3"))
    second = F.when(F.col("use3"), 3).otherwise(2)
    g = cross.geno.join(F.broadcast(total)).where((F.col("g") == 1) | (F.col("g") == second)).withColumn("g", F.when(F.col("g") == 1, 1).otherwise(2).cast("int")).select(_G)
    return cross.with_(geno=g, map=cross.map.withColumn("chrtype", F.lit("A")), crosstype=kind)


def convert_2_bcsft(cross: Cross, bc_gen: int = 0, f_gen: int = 0) -> Cross:
    """To a cross of ``bc_gen`` backcrosses and ``f_gen`` selfings. Codes that it can't have (without selfing: all but 1 and 2) become missing."""
    if cross.crosstype not in ("bc", "f2", "bcsft"):
        raise ValueError(f"a cross of type {cross.crosstype} has no generations")
    if bc_gen + f_gen < 1:
        raise ValueError("generations are needed")
    return cross.with_(geno=cross.geno.where(F.col("g").between(1, 5 if f_gen else 2)), crosstype="bcsft", scheme=(bc_gen, f_gen))


def fix_x_geno(cross: Cross) -> Cross:
    """X genotypes to codes 1 and 2, by sex and direction of the cross; impossible ones become missing."""
    x = cross.map.where("chrtype = 'X'").select("marker")
    on_x = cross.geno.join(x, "marker", "left_semi").join(cross.individual.select("ind", "sex", "pgm"), "ind", "left")
    rest = cross.geno.join(x, "marker", "left_anti").select(_G)
    male = F.coalesce(F.col("sex"), F.lit(0)) == 1
    if cross.crosstype == "bc":
        new = F.when(male & F.col("g").isin(2, 3), 2).when(F.col("g").isin(1, 2) & ~(male & (F.col("g") == 2)), F.col("g"))
    else:
        back = F.coalesce(F.col("pgm"), F.lit(0)) == 1
        new = F.when(male, F.when(F.col("g") == 1, 1).when(F.col("g") == 3, 2)).when(back, F.when(F.col("g") == 3, 1).when(F.col("g") == 2, 2)).otherwise(F.when(F.col("g").isin(1, 2), F.col("g")))
    return cross.with_(geno=on_x.withColumn("g", new.cast("int")).where("g IS NOT NULL").select(_G).unionByName(rest))


def combine(*crosses: Cross) -> Cross:
    """Individuals of several crosses with the same map; numbers are offset, the cross is a trait of its own.

    bc and f2 give f2. Traits that one cross lacks are missing there."""
    kinds = {c.crosstype for c in crosses}
    crosstype = kinds.pop() if len(kinds) == 1 else "f2"
    parts = {"geno": [], "pheno": [], "individual": []}
    for k, c in enumerate(crosses):
        ind = F.col("ind") * len(crosses) + k
        for name, dfs in parts.items():
            dfs.append(getattr(c, name).withColumn("ind", ind))
        parts["pheno"].append(c.individual.select(ind.alias("ind"), F.lit("cross").alias("trait"), F.lit(float(k + 1)).alias("y")))
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]), allowMissingColumns=True)
    return crosses[0].with_(crosstype=crosstype, **{k: union(v) for k, v in parts.items()})


def complete_cases(cross: Cross, traits: list[str], covar: DataFrame | None = None) -> DataFrame:
    """ind of those with finite values of all traits and covariates (ind, name, value)."""
    ok = cross.pheno.where(F.col("trait").isin(traits) & F.col("y").isNotNull() & ~F.isnan("y")).groupBy("ind").agg(F.count_distinct("trait").alias("k")).where(F.col("k") == len(set(traits))).select("ind")
    if covar is not None:
        bad = covar.where(F.col("value").isNull() | F.isnan("value")).select("ind").distinct()
        ok = ok.join(bad, "ind", "left_anti").join(covar.select("ind").distinct(), "ind", "left_semi")
    return ok


def form_marker_covar(cross: Cross, loci: list[tuple[str, float]], error: float = 1e-4) -> DataFrame:
    """ind, name, value: probabilities of all genotypes but the first at the markers nearest to places (chr, pos), as covariates."""
    from crossloom.operators.hmm import calc_genoprob
    from crossloom.operators.meta import find_pseudomarker

    spark = cross.map.sparkSession
    places = spark.createDataFrame([(c, float(x)) for c, x in loci], "chr string, pos double")
    names = find_pseudomarker(cross.map.select("chr", F.col("marker").alias("locus"), "pos"), places).select("locus").distinct()
    p = calc_genoprob(cross, error=error).join(names, "locus", "left_semi")
    x = p.select("ind", "locus", F.posexplode("p").alias("k", "value")).where("k > 0")
    return x.select("ind", F.concat_ws(".", "locus", (F.col("k") + 1).cast("string")).alias("name"), "value")


def estimate_marker_lod(result: DataFrame) -> DataFrame:
    """Null LODs filled by linear interpolation between their neighbours on the chromosome."""
    at = F.when(F.col("lod").isNotNull(), F.struct("pos", "lod"))
    up = Window.partitionBy("chr").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("chr").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    x = result.withColumns({"_l": F.last(at, True).over(up), "_r": F.last(at, True).over(down)})
    mid = F.col("_l.lod") + (F.col("pos") - F.col("_l.pos")) / (F.col("_r.pos") - F.col("_l.pos")) * (F.col("_r.lod") - F.col("_l.lod"))
    return x.withColumn("lod", F.coalesce("lod", F.when(F.col("_l").isNull(), F.col("_r.lod")).when(F.col("_r").isNull(), F.col("_l.lod")).otherwise(mid))).drop("_l", "_r")


def extract_markers(result: DataFrame, pseudo: bool = False) -> DataFrame:
    is_grid = F.col("locus").rlike(r"\.loc")
    return result.where(is_grid if pseudo else ~is_grid)
