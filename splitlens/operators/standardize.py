"""Entity standardization within splits.

What needs a chemistry toolkit runs in one Arrow UDF, only if the toolkit can be imported; without it the chemical
cleaner is refused, never approximated. Deduplication and selection are plain plans for any entity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHEMISTRY = "entity string, inchi string, valid boolean, comment string, weight double, fp array<int>, frame array<int>, scaffold string"


def flag_duplicates(records: DataFrame, keys: tuple[str, ...] = ("entity", "inchi")) -> DataFrame:
    """``valid`` false and ``comment`` Duplicate on every row that repeats one of the keys within its split; the first
    in order stays. Null keys equal each other. A key's first row is found by an aggregation, which combines a hot key
    before it is shuffled, and joined back, where adaptive joins split one."""
    out, repeat = records, F.lit(False)
    for i, key in enumerate(k for k in keys if k in records.columns):
        own, split, first = f"__key{i}", f"__split{i}", f"__first{i}"
        firsts = records.groupBy(F.col("split").alias(split), F.col(key).alias(own)).agg(F.min("row_id").alias(first))
        out = out.join(firsts, (F.col("split") == F.col(split)) & F.col(key).eqNullSafe(F.col(own))).drop(own, split)
        repeat = repeat | (F.col("row_id") > F.col(first))
    out = out.withColumn("__repeat", repeat).drop(*[c for c in out.columns if c.startswith("__first")])
    valid = F.col("valid") if "valid" in records.columns else F.lit(True)
    comment = F.col("comment") if "comment" in records.columns else F.lit(None).cast("string")
    return out.withColumn("comment", F.when(F.col("__repeat"), "Duplicate").otherwise(comment)).withColumn("valid", valid & ~F.col("__repeat")).drop("__repeat")


def valid_only(records: DataFrame) -> DataFrame:
    """Valid rows, labels and all, fewest warnings first within a split."""
    if "valid" not in records.columns:
        return records
    return records.where("valid").orderBy("split", *(["n_warnings"] if "n_warnings" in records.columns else []), "row_id")


def _toolkit():
    try:
        from rdkit import Chem
        from rdkit.Chem import AllChem, rdMolDescriptors
        from rdkit.Chem.MolStandardize import rdMolStandardize
        from rdkit.Chem.Scaffolds import MurckoScaffold
    except ImportError as e:
        raise RuntimeError("the chemical cleaner needs RDKit, which isn't installed") from e
    return Chem, AllChem, rdMolDescriptors, rdMolStandardize, MurckoScaffold


def chemistry_columns(radius: int = 2, bits: int = 2048):
    """Arrow UDF from a structure line to ``CHEMISTRY``: standard form, keys, weight, fingerprints and scaffold."""

    @F.pandas_udf(CHEMISTRY)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chem, fingerprints, descriptors, standard, murcko = _toolkit()
        tautomers, uncharger = standard.TautomerEnumerator(), standard.Uncharger()

        def row(line):
            mol = chem.MolFromSmiles(line) if line is not None else None
            if mol is None:
                return (line, None, False, "unparsable", None, None, None, None)
            mol = tautomers.Canonicalize(uncharger.uncharge(standard.FragmentParent(standard.Cleanup(mol))))
            on = lambda m: sorted(fingerprints.GetMorganFingerprintAsBitVect(m, radius, nBits=bits).GetOnBits())
            try:
                frame = murcko.MakeScaffoldGeneric(mol)  # the whole molecule made generic
            except Exception:
                frame = murcko.GetScaffoldForMol(mol)
            return (chem.MolToSmiles(mol), chem.MolToInchi(mol), True, None, descriptors.CalcExactMolWt(mol), on(mol), on(frame), murcko.MurckoScaffoldSmiles(mol=mol))

        names = [x.split()[0] for x in CHEMISTRY.split(", ")]
        for lines in batches:
            yield pd.DataFrame([row(x) for x in lines], columns=names)

    return run


def scaffold(entity: Column) -> Column:
    """The scaffold of a structure line, null where it can't be read; needs the toolkit."""
    _toolkit()
    return chemistry_columns()(entity)["scaffold"]


def clean_molecules(records: DataFrame, radius: int = 2, bits: int = 2048) -> DataFrame:
    _toolkit()
    c = records.withColumn("__c", chemistry_columns(radius, bits)(F.col("entity"))).select(*[x for x in records.columns if x != "entity"], "__c.*")
    return flag_duplicates(c)


#: Cleaners by name; ``None`` keeps entities as they are. More can be registered.
CLEANERS: dict[str, Callable[[DataFrame], DataFrame] | None] = {"none": None, "null": None, "false": None, "molecules": clean_molecules, "duplicates": flag_duplicates}


def cleaner(name: str | None) -> Callable[[DataFrame], DataFrame] | None:
    key = str(name).strip().lower() if name is not None else "none"
    if key not in CLEANERS:
        raise ValueError(f"unknown cleaner: {name}")
    return CLEANERS[key]
