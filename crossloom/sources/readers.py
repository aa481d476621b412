"""Readers of cross files: csv family, tidy, code matrices, MapMaker, Cartographer, MapQTL, Map Manager, multi-parent lines.

Wide tables are read by Spark's csv reader and turned long by expressions. Free text formats are read whole (one file is one
experiment) and parsed once; genotypes become DataFrames from there."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossloom.functions.maps import np_imf
from crossloom.model import INDIVIDUAL, MAP, PHENO, Cross
from crossloom.operators.edit import fix_x_geno, renumber
from crossloom.operators.meta import get_sex
from crossloom.operators.order import row_numbers

NA = ("-", "NA", "")
GENOTYPES = ("A", "H", "B", "D", "C")


def number(c, dec: str = "."):
    """Column of text as a number, or null."""
    return F.expr(f"try_cast({c} AS DOUBLE)") if dec == "." else F.expr(f"try_cast(replace({c}, '{dec}', '.') AS DOUBLE)")


def infer_crosstype(top: int) -> str:
    return "bc" if top <= 2 else "f2" if top <= 5 else "4way"


def _code(c, genotypes, na):
    if genotypes is None:
        return F.expr(f"try_cast({c} AS INT)")
    out = F.lit(None).cast("int")
    for k, g in enumerate(genotypes, 1):
        out = F.when(F.col(c) == g, k).otherwise(out)
    return F.when(F.col(c).isin(*na), None).otherwise(out)


def _chr(c):
    name = F.regexp_replace(F.trim(c), "(?i)^chr(omosome)?[ ._]*", "")
    return F.when(name.isin("x", "X"), "X").otherwise(name)


def make_cross(spark: SparkSession, geno: DataFrame, pheno: DataFrame, map_rows: list, individual: DataFrame, crosstype: str | None = None, alleles=("A", "B")) -> Cross:
    """Names, types and orders put right: geno has ind, marker, g; map_rows are (chr, marker, pos)."""
    rows, last = [], {}
    for c, m, p in map_rows:
        c = re.sub(r"(?i)^chr(omosome)?[ ._]*", "", str(c).strip())
        c = "X" if c in "xX" and c else c
        p = last.get(c, -5.0) + 5.0 if p is None else float(p)
        last[c] = p
        rows.append((c, "X" if c == "X" else "A", m, len(rows), p, None))
    m = spark.createDataFrame(rows, MAP)
    if crosstype is None:
        top = geno.agg(F.max("g")).first()[0]
        crosstype = infer_crosstype(top or 1)
    base = geno.where("g IS NOT NULL").select("ind", F.lit("").alias("chr"), "marker", F.lit(0).alias("ord"), F.col("g").cast("int").alias("g"))
    cross = renumber(Cross(base, pheno, m, individual, crosstype, tuple(alleles)))
    return fix_x_geno(cross) if crosstype in ("bc", "f2") and any(r[1] == "X" for r in rows) else cross


def _individuals(wide: DataFrame, names: list[str]) -> DataFrame:
    """From a table with ind and one text column for each phenotype."""
    pick = lambda *options: next((n for n in names if n.lower() in options), None)
    col = lambda n: F.col(f"`{n}`") if n else F.lit(None).cast("string")
    raw = wide.select("ind", F.coalesce(col(pick("id")), F.col("ind").cast("string")).alias("id"), col(pick("sex")).alias("sex"), col(pick("pgm")).alias("pgm"), F.lit(None).cast("string").alias("strata"))
    return get_sex(raw).withColumn("pgm", F.expr("try_cast(pgm AS INT)"))


def _phenotypes(wide: DataFrame, names: list[str], na, dec: str = ".") -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("trait"), F.col(f"`{n}`").alias("t")) for n in names))).alias("x")
    x = wide.select("ind", each).select("ind", "x.trait", "x.t").where(~F.col("t").isin(*na))
    return x.select("ind", "trait", number("t", dec).alias("y")).where("y IS NOT NULL")


def _numbered(df: DataFrame, skip: int) -> DataFrame:
    """Rows after the first ``skip``, numbered from 1 in file order."""
    x = df.withColumn("_k", F.monotonically_increasing_id())
    return row_numbers(x, "_k", "ind").withColumn("ind", F.col("ind") + 1 - skip).where("ind > 0").drop("_k")


def read_csv(spark: SparkSession, path: str, na=NA, genotypes=GENOTYPES, rotate: bool = False, crosstype: str | None = None, sep: str = ",", dec: str = ".") -> Cross:
    """One table: phenotypes and markers are columns (rows, if rotated), with chromosomes and, where there are, positions below the names."""
    df = spark.read.csv(path, header=False, sep=sep, maxColumns=2_000_000)
    df = df.select(*(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in df.columns))
    if rotate:
        return _read_rotated(spark, df, na, genotypes, crosstype, dec)
    head = [list(r) for r in df.limit(3).collect()]
    names, chrs = head[0], head[1]
    n = next((k for k, c in enumerate(chrs) if c), len(chrs))
    has_pos = len(head) > 2 and not any(head[2][:n]) and n > 0
    pos = [float(x.replace(dec, ".")) if has_pos and x else None for x in head[2]] if has_pos else [None] * len(names)
    rows = _numbered(df, 3 if has_pos else 2)
    cols = df.columns
    wide = rows.select("ind", *(F.col(c).alias(names[k]) for k, c in enumerate(cols[:n])))
    cells = rows.select("ind", F.posexplode(F.array(*cols[n:])).alias("k", "t"))
    labels = F.array(*(F.lit(m) for m in names[n:]))
    geno = cells.select("ind", F.get(labels, F.col("k")).alias("marker"), _code("t", genotypes, na).alias("g"))
    return make_cross(spark, geno, _phenotypes(wide, names[:n], na, dec), [(chrs[k], names[k], pos[k]) for k in range(n, len(names))], _individuals(wide, names[:n]), crosstype)


def _read_rotated(spark, df, na, genotypes, crosstype, dec) -> Cross:
    cols = df.columns
    head = [list(r) for r in df.select(*cols[:3]).collect()]
    marker_rows = [r for r in head if r[1]]
    number_ = lambda x: re.fullmatch(r"[-+]?[0-9.]+(e[-+]?[0-9]+)?", x.replace(dec, "."), re.I)
    has_pos = all(number_(r[2]) for r in marker_rows) and any("." in r[2] or r[2] not in (genotypes or ()) for r in marker_rows)
    first = 3 if has_pos else 2
    cells = df.select(F.col(cols[0]).alias("name"), F.col(cols[1]).alias("c"), F.posexplode(F.array(*cols[first:])).alias("k", "t")).withColumn("ind", (F.col("k") + 1).cast("long"))
    names = [r[0] for r in head if not r[1]]
    wide = cells.where("c = ''").groupBy("ind").pivot("name", names).agg(F.first("t"))
    geno = cells.where("c <> ''").select("ind", F.col("name").alias("marker"), _code("t", genotypes, na).alias("g"))
    return make_cross(spark, geno, _phenotypes(wide, names, na, dec), [(r[1], r[0], float(r[2].replace(dec, ".")) if has_pos else None) for r in marker_rows], _individuals(wide, names), crosstype)


def read_csvs(spark: SparkSession, gen: str, phe: str, na=NA, genotypes=GENOTYPES, rotate: bool = False, crosstype: str | None = None) -> Cross:
    """Genotypes and phenotypes in two files that share an id column; ids found in one of them only are dropped."""
    g = read_csv(spark, gen, na, genotypes, rotate, crosstype)
    p = spark.read.csv(phe, header=not rotate)
    if rotate:
        cols = p.columns
        names = [r[0] for r in p.select(cols[0]).collect()]
        long = p.select(F.col(cols[0]).alias("name"), F.posexplode(F.array(*cols[1:])).alias("k", "t"))
        p = long.groupBy("k").pivot("name", names).agg(F.first("t")).drop("k")
    names = p.columns
    key = next(n for n in names if n.lower() == "id")
    ids = g.individual.select("ind", "id")
    wide = p.join(ids.withColumnRenamed("id", "_own"), F.trim(F.col(f"`{key}`")) == F.col("_own")).select("ind", *(F.coalesce(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")).alias(n) for n in names))
    keep = wide.select("ind")
    return g.with_(geno=g.geno.join(keep, "ind", "left_semi"), pheno=_phenotypes(wide, names, na), individual=_individuals(wide, names))


def read_tidy(spark: SparkSession, gen: str, phe: str, map_: str, na=NA, genotypes=GENOTYPES, crosstype: str | None = None) -> Cross:
    """Three tables: genotypes (rows are markers, columns are ids), phenotypes (rows are traits), map (marker, chr, pos). Only ids and
    markers that are in all of them stay."""
    g, p = spark.read.csv(gen, header=True), spark.read.csv(phe, header=True)
    m = [list(r) for r in spark.read.csv(map_, header=True).collect()]
    ids = [c for c in g.columns[1:] if c in p.columns]
    spark_ids = spark.createDataFrame([(k + 1, c) for k, c in enumerate(ids)], "ind long, id string")
    melt = lambda df: df.select(F.trim(F.col(f"`{df.columns[0]}`")).alias("name"), F.explode(F.array(*(F.struct(F.lit(k + 1).cast("long").alias("ind"), F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias("t")) for k, c in enumerate(ids)))).alias("x")).select("x.ind", "name", "x.t")
    markers = {r[0].strip() for r in m}
    geno = melt(g).where(F.col("name").isin(list(markers))).select("ind", F.col("name").alias("marker"), _code("t", genotypes, na).alias("g"))
    known = {r["name"] for r in geno.select(F.col("marker").alias("name")).distinct().collect()}
    long = melt(p)
    names = [r["name"] for r in long.select("name").distinct().collect()]
    wide = long.groupBy("ind").pivot("name", names).agg(F.first("t"))
    people = _individuals(wide, [n for n in names if n.lower() != "id"]).drop("id").join(spark_ids, "ind").select("ind", "id", "sex", "pgm", "strata")
    return make_cross(spark, geno, _phenotypes(wide, names, na), [(r[1], r[0].strip(), float(r[2])) for r in m if r[0].strip() in known], people, crosstype)


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _frames(spark: SparkSession, genotypes: dict[str, list[int]], traits: dict[str, list], ids: list | None = None):
    geno = spark.createDataFrame([(i + 1, m, int(g)) for m, gs in genotypes.items() for i, g in enumerate(gs) if g], "ind long, marker string, g int")
    n = max([len(x) for x in [*genotypes.values(), *traits.values()]], default=0)
    wide = {t.lower(): v for t, v in traits.items()}
    code = lambda v: None if v is None else 1 if str(v).lower() in ("1", "1.0", "m", "male") else 0
    people = spark.createDataFrame([(i + 1, str((ids or range(1, n + 1))[i]), code(wide["sex"][i]) if "sex" in wide else None, code(wide["pgm"][i]) if "pgm" in wide else None, None) for i in range(n)], INDIVIDUAL)
    pheno = spark.createDataFrame([(i + 1, t, float(v)) for t, vs in traits.items() for i, v in enumerate(vs) if isinstance(v, (int, float))], PHENO)
    return geno, pheno, people


def _value(x: str, na=NA) -> float | None:
    try:
        return None if x in na else float(x)
    except ValueError:
        return None


def read_karl(spark: SparkSession, gen: str, map_: str, phe: str) -> Cross:
    """Rows of codes; a map of recombination fractions; a table of phenotypes."""
    tokens = _text(spark, map_).split()
    rows, names, at = [], [], 1
    for c in range(1, int(tokens[0]) + 1):
        n = int(tokens[at])
        r = [float(x) for x in tokens[at + 1 : at + n]]
        own = tokens[at + n : at + 2 * n]
        at += 2 * n
        pos = 0.0
        for k, m in enumerate(own):
            pos += float(np_imf(r[k - 1], "haldane")) if k else 0.0
            rows.append((str(c), m, pos))
            names.append(m)
    g = [line.split() for line in _text(spark, gen).splitlines() if line.strip()]
    head, *lines = [line.split() for line in _text(spark, phe).splitlines() if line.strip()]
    geno, pheno, people = _frames(spark, {m: [int(x[k]) for x in g] for k, m in enumerate(names)}, {t: [_value(x[k]) for x in lines] for k, t in enumerate(head)})
    return make_cross(spark, geno, pheno, rows, people)


def read_gary(spark: SparkSession, gen: str, mnames: str, chrid: str, phe: str, pnames: str, pos: str | None = None, na=("9", *NA)) -> Cross:
    """Genotype matrix (0, 1, 2; 9 missing), marker names, chromosomes, phenotypes and their names, positions."""
    words = lambda p: _text(spark, p).split()
    names, chrs, traits = words(mnames), words(chrid), words(pnames)
    g = [x.split() for x in _text(spark, gen).splitlines() if x.strip()]
    p = [x.split() for x in _text(spark, phe).splitlines() if x.strip()]
    where = {}
    if pos:
        for x in _text(spark, pos).splitlines():
            if len(x.split()) >= 2:
                where[x.split()[0]] = float(x.split()[-1])
    geno, pheno, people = _frames(spark, {m: [0 if r[k] in na else int(r[k]) + 1 for r in g] for k, m in enumerate(names)}, {t: [_value(r[k]) for r in p] for k, t in enumerate(traits)})
    return make_cross(spark, geno, pheno, [(c, m, where.get(m)) for c, m in zip(chrs, names, strict=True)], people)


#: MapMaker's genotype letters for each kind of cross.
_MM = {"f2 intercross": ("f2", {"A": 1, "H": 2, "B": 3, "D": 4, "C": 5}), "f2 backcross": ("bc", {"A": 1, "H": 2}), "ri self": ("riself", {"A": 1, "B": 2}), "ri sib": ("risib", {"A": 1, "B": 2})}


def parse_mm(text: str) -> tuple[str, int, dict[str, list[int]], dict[str, list]]:
    """(cross type, individuals, genotypes, traits) of a raw file."""
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    kind = re.sub(r"(?i)^data type\s+", "", lines[0]).strip().lower()
    crosstype, letters = _MM[kind]
    first = lines[1].split()
    n_ind, n_mar, n_phe = (int(x) for x in first[:3])
    table = dict(letters)
    for pair in first[3:]:
        if "=" in pair:
            a, b = pair.split("=")
            if b.upper() in letters:
                table[a] = letters[b.upper()]
    lower = {k.lower(): v for k, v in table.items()}
    records: list[tuple[str, str]] = []
    for line in lines[2:]:
        if line.lstrip().startswith("*"):
            name, _, rest = line.strip()[1:].partition(" ")
            records.append((name.strip(), rest.strip()))
        elif records:
            records[-1] = (records[-1][0], records[-1][1] + " " + line.strip())
    geno = {name: [lower.get(c.lower(), 0) for c in data.replace(" ", "")] for name, data in records[:n_mar]}
    traits = {name: [_value(x) for x in data.split()] for name, data in records[n_mar : n_mar + n_phe]}
    return crosstype, n_ind, geno, traits


def parse_maps(text: str) -> list[tuple[str, str, float | None]]:
    """(chr, marker, cM) from a plain map (chr marker [cM] a line) or from a MapMaker ``.maps`` dump."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if not any("mapmaker" in x.lower() for x in lines[:2]):
        rows = [x.split() for x in lines]
        if rows and len(rows[0]) > 2 and _value(rows[0][2]) is None:
            rows = rows[1:]
        return [(r[0], r[1], float(r[2]) if len(r) > 2 else None) for r in rows]
    known = [x.split()[0][1:] for x in lines if re.match(r"\*\S+(\s+-?[\d.]+){4,}", x)]
    out: list = []
    at = next((k for k, x in enumerate(lines) if x.startswith("*Chromosomes:")), None)
    if at is None:
        return [("1", m, None) for m in known]
    k = at + 1
    for _ in range(int(lines[at].split()[1])):
        name = lines[k].split()[0].lstrip("*")
        n = int(lines[k + 1].split()[0])
        tokens: list[str] = []
        k += 2
        while k < len(lines) and not lines[k].startswith("*"):
            tokens += lines[k].split()
            k += 1
        index, r = tokens[:n], [float(x) for x in tokens[n : 2 * n - 1]]
        pos = 0.0
        for j, m in enumerate(index):
            pos += float(np_imf(min(abs(r[j - 1]), 0.4999), "haldane")) if j and j - 1 < len(r) else 0.0
            out.append((name, known[int(m)], pos))
        while k < len(lines) and not re.match(r"\*\S+\s*$|\*\S+ \d", lines[k]):
            k += 1
    return out


def read_mm(spark: SparkSession, raw: str, map_: str) -> Cross:
    crosstype, _, geno, traits = parse_mm(_text(spark, raw))
    g, p, people = _frames(spark, geno, traits)
    return make_cross(spark, g, p, [x for x in parse_maps(_text(spark, map_)) if x[1] in geno], people, crosstype)


def parse_qtlcart_map(text: str) -> list[tuple[str, str, float]]:
    """Intervals of each chromosome and names of its markers."""
    out_pos: dict[str, list[float]] = {}
    names: dict[tuple[int, int], str] = {}
    for line in text.splitlines():
        t = line.split()
        if t[:1] == ["-l"] and "|" in line:
            body = line.split("|", 1)[1]
            for c in range(0, (len(body) + 10) // 11):
                cell = body[c * 11 : (c + 1) * 11].strip()
                if cell:
                    out_pos.setdefault(str(c + 1), []).append(float(cell))
        elif t[:1] == ["-b"]:
            continue
        elif len(t) == 3 and t[0].isdigit() and t[1].isdigit():
            names[int(t[0]), int(t[1])] = t[2]
    out = []
    for c, gaps in out_pos.items():
        pos = 0.0
        for k in range(1, len(gaps)):
            pos += gaps[k - 1] if k > 1 else 0.0
            out.append((c, names.get((int(c), k), f"c{c}m{k}"), pos))
    return out


def read_qtlcart(spark: SparkSession, cro: str, map_: str) -> Cross:
    """QTL Cartographer ``.cro`` with its map."""
    text = _text(spark, cro)
    kind = re.search(r"-cross\s+(\S+)", text)
    crosstype = {"B1": "bc", "B2": "bc", "SF2": "f2", "RF2": "f2", "RI1": "riself", "RI2": "risib"}.get(kind[1] if kind else "SF2", "f2")
    rows = parse_qtlcart_map(_text(spark, map_))
    n_tr = int((re.search(r"-traits\s+(\d+)", text) or ["", "1"])[1])
    names = re.findall(r"^\s*\d+\s+(\S+)\s*$", text.split("-Names of the traits")[1].split("-")[0], re.M) if "-Names of the traits" in text else [f"trait{k + 1}" for k in range(n_tr)]
    body = re.split(r"^-s\s*$|^-s\b.*$", text, flags=re.M)[-1].split("-e")[0].split()
    m = len(rows)
    table = {"2": 1, "1": 2, "0": 3, "12": 4, "10": 5} if crosstype == "f2" else {"2": 1, "1": 2, "0": 2}
    geno, traits, at = {x[1]: [] for x in rows}, {n: [] for n in names[:n_tr]}, 0
    while at + 2 + m + n_tr <= len(body):
        for k, x in enumerate(rows):
            geno[x[1]].append(table.get(body[at + 2 + k], 0))
        for k, n in enumerate(traits):
            traits[n].append(_value(body[at + 2 + m + k], ("-", "NA", ".")))
        at += 2 + m + n_tr
    g, p, people = _frames(spark, geno, traits)
    return make_cross(spark, g, p, rows, people, crosstype)


#: MapQTL's population types and genotype codes; in a cross-pollinated population they follow from segregation and phase.
_MQ = {"bc1": ("bc", {"a": 1, "h": 2}), "f2": ("f2", {"a": 1, "h": 2, "b": 3, "d": 4, "c": 5}), "ri": ("riself", {"a": 1, "b": 2}), "dh": ("dh", {"a": 1, "b": 2}), "hap": ("haploid", {"a": 1, "b": 2})}


def mq_code(segregation: str, phase: str, g: str) -> int:
    """Four-way code of a genotype in a MapQTL cross: the first parent carries A/B, the second C/D, in the order of the phase."""
    first, second = segregation.strip("<>").split("x")
    flip1, flip2 = (phase + "00")[1:3] if phase.startswith("{") else "00"
    a, b = (first[1], first[0]) if flip1 == "1" else (first[0], first[1])
    c, d = (second[1], second[0]) if flip2 == "1" else (second[0], second[1])
    if "-" in g:
        have = [x for x in g if x != "-"]
        fits = [k + 1 for k, (x, y) in enumerate(((a, c), (b, c), (a, d), (b, d))) if all(h in (x, y) for h in have)] if have else []
    else:
        fits = [k + 1 for k, (x, y) in enumerate(((a, c), (b, c), (a, d), (b, d))) if sorted((x, y)) == sorted(g)]
    sets = {(1,): 1, (2,): 2, (3,): 3, (4,): 4, (1, 3): 5, (2, 4): 6, (1, 2): 7, (3, 4): 8, (1, 4): 9, (2, 3): 10, (2, 3, 4): 11, (1, 3, 4): 12, (1, 2, 4): 13, (1, 2, 3): 14}
    return sets.get(tuple(fits), 0)


def _mq_param(text: str, name: str) -> str | None:
    m = re.search(rf"^\s*{name}\s*=\s*(.+?)\s*$", text, re.M | re.I)
    return m[1] if m else None


def parse_mq_map(text: str) -> list[tuple[str, str, float]]:
    out, group = [], None
    for line in text.splitlines():
        t = line.split(";")[0].split()
        if t[:1] == ["group"]:
            group = t[1]
        elif len(t) >= 2 and group is not None:
            out.append((group, t[0], float(t[1])))
    return out


def read_mapqtl(spark: SparkSession, loc: str, map_: str, qua: str) -> Cross:
    text = re.sub(r";.*", "", _text(spark, loc))
    pop = _mq_param(text, "popt").lower()
    n = int(_mq_param(text, "nind"))
    rows = parse_mq_map(_text(spark, map_))
    wanted = {r[1] for r in rows}
    body = re.sub(r"^\s*\w+\s*=.*$", "", text, flags=re.M).split()
    geno, at = {}, 0
    crosstype, letters = _MQ.get(pop, ("4way", {}))
    while at < len(body):
        name, at = body[at], at + 1
        seg, phase = "", ""
        while at < len(body) and body[at][0] in "<{(":
            seg, phase = (body[at], phase) if body[at][0] == "<" else (seg, body[at] if body[at][0] == "{" else phase)
            at += 1
        cells = body[at : at + n]
        at += n
        if name in wanted:
            geno[name] = [mq_code(seg, phase, g) if crosstype == "4way" else letters.get(g.lower(), 0) for g in cells]
    q = re.sub(r";.*", "", _text(spark, qua))
    n_tr, miss = int(_mq_param(q, "ntrt")), (_mq_param(q, "miss") or "-").strip("\"'")
    words = re.sub(r"^\s*\w+\s*=.*$", "", q, flags=re.M).split()
    traits = {t: [_value(x, (miss, *NA)) for x in words[n_tr + k :: n_tr][:n]] for k, t in enumerate(words[:n_tr])}
    g, p, people = _frames(spark, geno, traits)
    return make_cross(spark, g, p, [r for r in rows if r[1] in geno], people, crosstype, ("A", "B", "C", "D") if crosstype == "4way" else ("A", "B"))


def parse_braces(text: str) -> list:
    """Nested lists of a Map Manager QTX file: ``{xxx`` opens, ``}xxx`` closes."""
    root: list = ["", []]
    stack = [root]
    for line in text.splitlines():
        if m := re.match(r"^\{(\w{3})\s*$", line):
            node: list = [m[1], []]
            stack[-1][1].append(node)
            stack.append(node)
        elif re.match(r"^\}\w{3}\s*$", line) and len(stack) > 1:
            stack.pop()
        else:
            stack[-1][1].append(line)
    return root[1]


def read_qtx(spark: SparkSession, path: str) -> Cross:
    """Map Manager QTX: chromosomes with loci, each with a line of letters; traits with values (X: missing)."""
    nodes = parse_braces(_text(spark, path))

    def find(items, tag):
        for x in items:
            if isinstance(x, list):
                if x[0] == tag:
                    yield x[1]
                else:
                    yield from find(x[1], tag)

    plain = lambda items: [x for x in items if isinstance(x, str)]
    geno, rows = {}, []
    letters = {"A": 1, "H": 2, "B": 3, "D": 4, "C": 5}
    n = int(plain(next(find(nodes, "pgy"), ["0"]))[0])
    for c in find(nodes, "chx"):
        name = plain(c)[0]
        for locus in find(c, "lox"):
            text = plain(locus)
            data = max((x.replace(" ", "") for x in text), key=len)
            geno[text[0].strip()] = [letters.get(ch.upper(), 0) for ch in data[:n]]
            rows.append((name, text[0].strip(), None))
    traits = {}
    for t in find(nodes, "trt"):
        values = " ".join(plain(next(find(t, "tvl"), []))).split()
        if len(values) >= n:
            traits[plain(t)[0].strip()] = [_value(x, ("X", *NA)) for x in values[:n]]
    g, p, people = _frames(spark, geno, traits)
    return make_cross(spark, g, p, rows, people)


def read_mwril(spark: SparkSession, ril: str, founders: str, kind: str = "ri8self", na=NA) -> Cross:
    """Multi-parent lines: genotypes become bit masks of the founders whose allele a line carries."""
    cross = read_csv(spark, ril, na, None, crosstype=kind)
    f = spark.read.csv(founders, header=True)
    marker, *names = f.columns
    long = f.select(F.trim(F.col(marker)).alias("marker"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.expr(f"try_cast(`{c}` AS INT)").alias("a")) for k, c in enumerate(names)))).alias("x")).select("marker", "x.k", "x.a")
    masks = long.where("a IS NOT NULL").groupBy("marker", "a").agg(F.sum(F.call_function("shiftleft", F.lit(1), F.col("k"))).cast("int").alias("m"))
    unknown = long.where("a IS NULL").groupBy("marker").agg(F.sum(F.call_function("shiftleft", F.lit(1), F.col("k"))).cast("int").alias("u"))
    g = cross.geno.join(masks, (cross.geno.marker == masks.marker) & (cross.geno.g == masks.a)).select(cross.geno["ind"], cross.geno["chr"], cross.geno["marker"], cross.geno["ord"], "m")
    g = g.join(unknown, "marker", "left").select("ind", "chr", "marker", "ord", (F.col("m") + F.coalesce("u", F.lit(0))).cast("int").alias("g"))
    return cross.with_(geno=g, founders={"names": names})


def restore_mwril(cross: Cross, founder: int = 1) -> DataFrame:
    """0/1: does a line's mask hold a founder?"""
    return cross.geno.withColumn("g", F.expr(f"shiftright(g, {founder - 1}) & 1"))


READERS = {"csv": read_csv, "csvr": lambda s, p, **o: read_csv(s, p, rotate=True, **o), "csvs": read_csvs, "csvsr": lambda s, g, p, **o: read_csvs(s, g, p, rotate=True, **o), "tidy": read_tidy, "mm": read_mm, "qtx": read_qtx, "qtlcart": read_qtlcart, "gary": read_gary, "karl": read_karl, "mapqtl": read_mapqtl}


def read_cross(spark: SparkSession, format: str, *paths: str, bc_gen: int = 0, f_gen: int = 0, **options) -> Cross:
    """Any format; with generations the result is a bcsft cross."""
    cross = READERS[format](spark, *paths, **options)
    from crossloom.operators.edit import convert_2_bcsft

    return convert_2_bcsft(cross, bc_gen, f_gen) if bc_gen or f_gen else cross
