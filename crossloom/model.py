"""A genetic cross as DataFrames, and the schemas of derived tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GENO = "ind long, chr string, marker string, ord int, g int"
PHENO = "ind long, trait string, y double"
MAP = "chr string, chrtype string, marker string, ord int, pos double, pos_male double"
INDIVIDUAL = "ind long, id string, sex int, pgm int, strata string"
PROB = "ind long, chr string, locus string, ord int, pos double, p array<double>"
SCANONE = "chr string, pos double, ord int, locus string, trait string, lod double"

#: Cross types.
CROSS_TYPES = ("bc", "f2", "4way", "riself", "risib", "dh", "haploid", "ri4self", "ri4sib", "ri8self", "ri8selfIRIP1", "ri8sib", "bcsft", "bgmagic16")


@dataclass(frozen=True)
class Cross:
    """Typed genotypes only (a missing genotype has no row), phenotypes in long form, a map, individuals.

    ``scheme`` holds the generations (backcrosses, selfings) of a bcsft cross; ``founders`` the order of founders of multi-parent lines."""

    geno: DataFrame
    pheno: DataFrame
    map: DataFrame
    individual: DataFrame
    crosstype: str = "f2"
    alleles: tuple[str, ...] = ("A", "B")
    scheme: tuple[int, int] = (0, 0)
    founders: dict = field(default_factory=dict)

    def with_(self, **changes) -> Cross:
        return replace(self, **changes)

    def __getitem__(self, key) -> Cross:
        """``cross[chr]`` or ``cross[chr, ind]``: see ``subset``."""
        from crossloom.operators.meta import subset

        chr_, ind = key if isinstance(key, tuple) else (key, None)
        return subset(self, chr_, ind)

    def __repr__(self) -> str:
        return f"Cross({self.crosstype}, alleles {'/'.join(self.alleles)})"


def n_genotypes(crosstype: str, chrtype: str = "A") -> int:
    """Count of hidden states."""
    if crosstype in ("bc", "riself", "risib", "dh", "haploid") or crosstype in ("f2", "bcsft") and chrtype == "X":
        return 2
    return {"f2": 3, "bcsft": 3, "4way": 4, "ri4self": 4, "ri4sib": 4, "ri8self": 8, "ri8sib": 8, "ri8selfIRIP1": 8, "bgmagic16": 16}[crosstype]


def ordered_chr(col: str = "chr"):
    """Sort keys of chromosome names: numbers by value, then other names."""
    return [F.expr(f"try_cast({col} AS INT)").asc_nulls_last(), F.col(col)]
