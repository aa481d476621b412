"""Writers of cross files. An individual's line is one expression over a map of its genotypes; header lines come first by a sort key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossloom.model import Cross
from crossloom.operators.meta import geno_names
from crossloom.operators.order import row_numbers
from crossloom.runtime import materialise

GENOTYPES = ("A", "H", "B", "D", "C")


def write_lines(lines: DataFrame, path: str) -> None:
    """``lines``: k (sort key), value. Written as one text file in a folder, in order."""
    lines.orderBy("k").coalesce(1).select("value").write.mode("overwrite").text(path)


def _map_rows(cross: Cross) -> list:
    return cross.map.orderBy(F.expr("try_cast(chr AS INT)").asc_nulls_last(), "chr", "ord").collect()


def _traits(cross: Cross) -> list[str]:
    return sorted(r["trait"] for r in cross.pheno.select("trait").distinct().collect())


def _show(x):
    text = x.cast("string")
    return F.regexp_replace(text, r"\.0$", "")


def lines_by_individual(cross: Cross, codes: dict[int, str], missing: str, sep: str) -> DataFrame:
    """ind, pheno, geno: texts with one value for each trait and marker, in order."""
    markers, traits = [r["marker"] for r in _map_rows(cross)], _traits(cross)
    g = cross.geno.where("g IS NOT NULL").groupBy("ind").agg(F.map_from_entries(F.collect_list(F.struct("marker", "g"))).alias("m"))
    p = cross.pheno.where("y IS NOT NULL").groupBy("ind").agg(F.map_from_entries(F.collect_list(F.struct("trait", "y"))).alias("p"))
    x = cross.individual.select("ind", "id", "sex", "pgm").join(g, "ind", "left").join(p, "ind", "left")
    code = F.create_map(*(v for k, c in codes.items() for v in (F.lit(k), F.lit(c))))
    geno = F.array_join(F.transform(F.array(*(F.lit(m) for m in markers)), lambda m: F.coalesce(F.try_element_at(code, F.try_element_at(F.col("m"), m)), F.lit(missing))), sep)
    pheno = F.array_join(F.transform(F.array(*(F.lit(t) for t in traits)), lambda t: F.coalesce(_show(F.try_element_at(F.col("p"), t)), F.lit(missing))), sep)
    return x.select("ind", "id", pheno.alias("pheno"), geno.alias("geno"))


def _codes(cross: Cross) -> dict[int, str]:
    if cross.crosstype in ("f2", "bcsft"):
        return dict(enumerate(GENOTYPES, 1))
    if cross.crosstype == "bc":
        return {1: "A", 2: "H"}
    if cross.crosstype in ("riself", "risib", "dh", "haploid"):
        return {1: "A", 2: "B"}
    return {k: str(k) for k in range(1, 15)}


def _head(cross: Cross, rows: list[str]) -> DataFrame:
    return cross.map.sparkSession.createDataFrame([(k - len(rows), x) for k, x in enumerate(rows)], "k long, value string")


def write_csv(cross: Cross, path: str) -> None:
    """Names, chromosomes, positions, then a line for each individual (its id is the last phenotype)."""
    m, t = _map_rows(cross), _traits(cross)
    blank = [""] * (len(t) + 1)
    head = [",".join([*t, "id", *(r["marker"] for r in m)]), ",".join([*blank, *(r["chr"] for r in m)]), ",".join([*blank, *(f"{r['pos']:.10g}" for r in m)])]
    body = lines_by_individual(cross, _codes(cross), "-", ",").select(F.col("ind").alias("k"), F.concat_ws(",", *(["pheno"] if t else []), "id", "geno").alias("value"))
    write_lines(_head(cross, head).unionByName(body.withColumn("k", F.col("k") + 1)), path)


def _rotated(cross: Cross) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids: one row of text; phenotypes: trait, text; genotypes: marker, text): values of all individuals in order, with commas. A line of a
    rotated file holds all individuals by definition; it is put together in Spark, a task for each line."""
    place = materialise(row_numbers(cross.individual.select("ind", "id"), "ind", "i"), "places")
    n = F.lit(place.count())
    ids = place.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda x: F.coalesce(x["id"], F.lit("-"))), ",").alias("text"))

    def row(df: DataFrame, key: str, value) -> DataFrame:
        x = df.join(place.select("ind", "i"), "ind").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", value.alias("v")))).alias("m"))
        full = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("-")))
        return x.select(key, F.array_join(full, ",").alias("text"))

    code = F.create_map(*(v for k, c in _codes(cross).items() for v in (F.lit(k), F.lit(c))))
    return ids, row(cross.pheno.where("y IS NOT NULL"), "trait", _show(F.col("y"))), row(cross.geno.where("g IS NOT NULL"), "marker", F.try_element_at(code, F.col("g")))


def _none():
    """As many missing values as there are ids, from the line of ids (commas within ids aren't allowed in these files)."""
    return F.regexp_replace("ids", "[^,]+", "-")


def write_csvr(cross: Cross, path: str) -> None:
    """The same, rotated: a row for each phenotype and marker."""
    spark = cross.map.sparkSession
    ids, p, g = _rotated(cross)
    order = spark.createDataFrame([(k, r["marker"], r["chr"], f"{r['pos']:.10g}") for k, r in enumerate(_map_rows(cross))], "k long, marker string, c string, pos string")
    p = p.select(F.lit(-1).cast("long").alias("k"), F.concat_ws(",", "trait", F.lit(""), F.lit(""), "text").alias("value"))
    g = order.join(g, "marker", "left").join(ids.select(F.col("text").alias("ids"))).select("k", F.concat_ws(",", "marker", "c", "pos", F.coalesce("text", _none())).alias("value"))
    write_lines(ids.select(F.lit(-2).cast("long").alias("k"), F.concat_ws(",", F.lit("id"), F.lit(""), F.lit(""), "text").alias("value")).unionByName(p).unionByName(g), path)


def write_csvs(cross: Cross, gen: str, phe: str) -> None:
    """Genotypes and phenotypes in two files that share the id."""
    m, t = _map_rows(cross), _traits(cross)
    body = lines_by_individual(cross, _codes(cross), "-", ",")
    head = [",".join(["id", *(r["marker"] for r in m)]), ",".join(["", *(r["chr"] for r in m)]), ",".join(["", *(f"{r['pos']:.10g}" for r in m)])]
    write_lines(_head(cross, head).unionByName(body.select((F.col("ind") + 1).alias("k"), F.concat_ws(",", "id", "geno").alias("value"))), gen)
    write_lines(_head(cross, [",".join([*t, "id"])]).unionByName(body.select((F.col("ind") + 1).alias("k"), F.concat_ws(",", "pheno", "id").alias("value"))), phe)


def write_tidy(cross: Cross, gen: str, phe: str, map_: str) -> None:
    """Genotypes by marker, phenotypes by name, and the map, each with a line of ids or names above."""
    spark = cross.map.sparkSession
    ids, p, g = _rotated(cross)
    head = lambda name: ids.select(F.lit(-1).cast("long").alias("k"), F.concat_ws(",", F.lit(name), "text").alias("value"))
    rows = _map_rows(cross)
    order = spark.createDataFrame([(k, r["marker"], ",".join([r["marker"], r["chr"], f"{r['pos']:.10g}"])) for k, r in enumerate(rows)], "k long, marker string, value string")
    full = order.drop("value").join(g, "marker").select("k", F.concat_ws(",", "marker", "text").alias("value"))
    write_lines(head("marker").unionByName(full), gen)
    write_lines(head("phenotype").unionByName(p.select(F.lit(0).cast("long").alias("k"), F.concat_ws(",", "trait", "text").alias("value"))), phe)
    write_lines(spark.createDataFrame([(-1, "marker,chr,pos")], "k long, value string").unionByName(order.select("k", "value")), map_)


def write_mm(cross: Cross, raw: str, map_: str) -> None:
    """MapMaker raw file and a plain map."""
    m, t = _map_rows(cross), _traits(cross)
    n = cross.individual.count()
    kind = {"f2": "f2 intercross", "bc": "f2 backcross", "riself": "ri self", "risib": "ri sib"}[cross.crosstype]
    code = F.create_map(*(v for k, c in _codes(cross).items() for v in (F.lit(k), F.lit(c.lower()))))
    full = cross.individual.select("ind").join(cross.map.select("marker", "chr", "ord")).join(cross.geno.select("ind", "marker", "g"), ["ind", "marker"], "left")
    ranks = {r["marker"]: k for k, r in enumerate(m)}
    rank = F.create_map(*(v for k, c in ranks.items() for v in (F.lit(k), F.lit(c))))
    line = full.groupBy("marker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ind", F.coalesce(F.try_element_at(code, F.col("g")), F.lit("-")).alias("c")))), lambda x: x["c"]), "").alias("v"))
    g = line.select(rank[F.col("marker")].cast("long").alias("k"), F.concat(F.lit("*"), "marker", F.lit(" "), "v").alias("value"))
    pf = cross.individual.select("ind").join(F.broadcast(cross.pheno.select("trait").distinct())).join(cross.pheno, ["ind", "trait"], "left")
    p = pf.groupBy("trait").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ind", F.coalesce(_show(F.col("y")), F.lit("-")).alias("c")))), lambda x: x["c"]), " ").alias("v")).select(F.lit(len(m)).cast("long").alias("k"), F.concat(F.lit("*"), "trait", F.lit(" "), "v").alias("value"))
    write_lines(_head(cross, [f"data type {kind}", f"{n} {len(m)} {len(t)}"]).unionByName(g).unionByName(p), raw)
    write_lines(_head(cross, [f"{r['chr']} {r['marker']} {r['pos']:.10g}" for r in m]), map_)


def write_gary(cross: Cross, folder: str) -> None:
    m, t = _map_rows(cross), _traits(cross)
    low = {k: str(k - 1) for k in range(1, 6)}
    body = lines_by_individual(cross, low, "9", " ")
    write_lines(body.select(F.col("ind").alias("k"), F.col("geno").alias("value")), f"{folder}/geno.dat")
    write_lines(lines_by_individual(cross, low, "-", " ").select(F.col("ind").alias("k"), F.col("pheno").alias("value")), f"{folder}/pheno.dat")
    for name, rows in (("mnames.txt", [r["marker"] for r in m]), ("chrid.dat", [r["chr"] for r in m]), ("pnames.txt", t), ("markerpos.txt", [f"{r['marker']} {r['pos']:.10g}" for r in m])):
        write_lines(_head(cross, rows), f"{folder}/{name}")


def write_mapqtl(cross: Cross, loc: str, map_: str, qua: str) -> None:
    m, t = _map_rows(cross), _traits(cross)
    pop = {"bc": "BC1", "f2": "F2", "riself": "RI", "risib": "RI", "dh": "DH", "haploid": "HAP"}[cross.crosstype]
    codes = {"bc": {1: "a", 2: "h"}, "f2": {1: "a", 2: "h", 3: "b", 4: "d", 5: "c"}}.get(cross.crosstype, {1: "a", 2: "b"})
    code = F.create_map(*(v for k, c in codes.items() for v in (F.lit(k), F.lit(c))))
    full = cross.individual.select("ind").join(cross.map.select("marker")).join(cross.geno.select("ind", "marker", "g"), ["ind", "marker"], "left")
    line = full.groupBy("marker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ind", F.coalesce(F.try_element_at(code, F.col("g")), F.lit("-")).alias("c")))), lambda x: x["c"]), " ").alias("v"))
    n = cross.individual.count()
    write_lines(_head(cross, ["name = cross", f"popt = {pop}", f"nloc = {len(m)}", f"nind = {n}"]).unionByName(line.select(F.lit(1).cast("long").alias("k"), F.concat_ws(" ", "marker", "v").alias("value"))), loc)
    rows, last = [], None
    for r in m:
        if r["chr"] != last:
            rows.append(f"group {r['chr']}")
            last = r["chr"]
        rows.append(f"{r['marker']} {r['pos']:.10g}")
    write_lines(_head(cross, rows), map_)
    body = lines_by_individual(cross, codes, "-", " ").select((F.col("ind") + 1).alias("k"), F.col("pheno").alias("value"))
    write_lines(_head(cross, [f"ntrt = {len(t)}", f"nind = {n}", "miss = -", " ".join(t)]).unionByName(body), qua)


def write_qtlcart(cross: Cross, cro: str, map_: str) -> None:
    m, t = _map_rows(cross), _traits(cross)
    chrs = list(dict.fromkeys(r["chr"] for r in m))
    by = {c: [r for r in m if r["chr"] == c] for c in chrs}
    rows = ["# 1 -filetype Rmap.out", "-f 1", "-u c", f"-c {len(chrs)}", f"-i {len(m)}"]
    for k in range(max(len(x) for x in by.values()) + 1):
        cells = []
        for c in chrs:
            x = by[c]
            cells.append(" " * 11 if k > len(x) else f"{0.0 if k == 0 or k == len(x) else x[k]['pos'] - x[k - 1]['pos']:11.7f}")
        rows.append(f"-l {k:6d} |" + "".join(cells))
    rows += [f"{i} {k} {r['marker']}" for i, c in enumerate(chrs, 1) for k, r in enumerate(by[c], 1)]
    write_lines(_head(cross, rows), map_)
    codes = {1: "2", 2: "1", 3: "0", 4: "12", 5: "10"} if cross.crosstype == "f2" else {1: "2", 2: "1"}
    kind = {"f2": "SF2", "bc": "B1", "riself": "RI1", "risib": "RI2"}[cross.crosstype]
    body = lines_by_individual(cross, codes, "-1", " ").join(lines_by_individual(cross, codes, ".", " ").select("ind", F.col("pheno").alias("p")), "ind")
    n = cross.individual.count()
    head = ["# 1 -filetype Rcross.out", f"-n {n}", f"-p {len(m)}", f"-cross {kind}", f"-traits {len(t)}", "-Names of the traits...", *(f" {k} {x}" for k, x in enumerate(t, 1)), "-s"]
    lines = body.select((F.col("ind") + 1).alias("k"), F.concat_ws(" ", F.col("ind").cast("string"), F.lit("1"), "geno", "p").alias("value"))
    write_lines(_head(cross, head).unionByName(lines).unionByName(cross.map.sparkSession.createDataFrame([(2**60, "-e")], "k long, value string")), cro)


def qtab_tables(cross: Cross) -> dict[str, DataFrame]:
    """symbols, locations, genotypes, phenotypes, founder as DataFrames."""
    spark = cross.map.sparkSession
    names = geno_names(cross.crosstype, "A", cross.alleles)
    return {
        "symbols": spark.createDataFrame([*((c, names[k - 1] if k <= len(names) else "partial") for k, c in _codes(cross).items()), ("-", "None")], "symbol string, genotype string"),
        "locations": cross.map.select("marker", "chr", "pos"),
        "genotypes": lines_by_individual(cross, _codes(cross), "-", "\t").select("id", "geno"),
        "phenotypes": lines_by_individual(cross, _codes(cross), "-", "\t").select("id", "pheno"),
        "founder": spark.createDataFrame([("cross", cross.crosstype), ("alleles", "/".join(cross.alleles))], "key string, value string"),
    }


def write_qtab(cross: Cross, folder: str) -> None:
    for name, df in qtab_tables(cross).items():
        df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(f"{folder}/{name}.qtab")


WRITERS = {"csv": write_csv, "csvr": write_csvr, "csvs": write_csvs, "tidy": write_tidy, "mm": write_mm, "gary": write_gary, "mapqtl": write_mapqtl, "qtlcart": write_qtlcart, "qtab": write_qtab}


def write_cross(cross: Cross, format: str, *paths: str) -> None:
    """Any format, with as many paths as it has files or folders."""
    WRITERS[format](cross, *paths)
