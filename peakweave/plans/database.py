"""Searches whose configuration, sequences and spectra lie in a database, and whose results go back there as normalised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masses import tokens
from ..sources.sinks import write_tables
from ..sources.tables import read_jdbc, spectra_from_tables
from .config import SearchConfig, parse
from .open_search import run
from .search import Results

#: Tables that a search reads, by what they hold; callers may name others, or queries.
TABLES = {"configuration": "configuration", "spectra": "spectrum", "peaks": "spectrum_peak", "proteins": "protein"}


def read_configuration(spark: SparkSession, url: str, table: str = TABLES["configuration"], **options: str) -> SearchConfig:
    """A configuration of a table (line_number, line)."""
    lines = read_jdbc(spark, url, table, **options).toDF(*["line_number", "line"]).orderBy("line_number").collect()
    return parse("\n".join(r["line"] for r in lines))


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def read_database(spark: SparkSession, url: str, tables: dict[str, str] | None = None, partitions: int = 8, **options: str) -> tuple[DataFrame, DataFrame]:
    """Spectra and proteins of a database, in the columns of read_spectra and read_fasta.

    spectrum: spectrum_id, run, scan, scan_title, peak_file, rt_start, rt_end, precursor_mz, precursor_intensity, precursor_charge;
    spectrum_peak: spectrum_id, mz, intensity; protein: protein_id, header, accession, sequence. The peaks are read by
    ranges of spectrum_id, by many tasks; the bounds are those of the spectra.
    """
    named = TABLES | (tables or {})
    table = lambda kind: _lower(read_jdbc(spark, url, named[kind], **options))
    spectra = table("spectra")
    low, high = spectra.agg(F.min("spectrum_id"), F.max("spectrum_id")).first()
    key = next(c for c in read_jdbc(spark, url, named["peaks"], **options).columns if c.lower() == "spectrum_id")
    peaks = _lower(read_jdbc(spark, url, named["peaks"], key, (int(low), int(high) + 1), partitions, **options)) if low is not None else table("peaks")
    spectra = spectra_from_tables(spectra, peaks).withColumns({"charge_alternatives": F.array().cast("array<int>"), "additional_mz": F.array().cast("array<double>")})
    proteins = table("proteins").select("protein_id", "header", "accession", tokens(F.col("sequence")).alias("residues"))
    return spectra, proteins


def result_tables(results: Results) -> dict[str, DataFrame]:
    """Results as normalised tables: peptide, has_protein, match, matched_peptide, score (a row per score) and matched_fragment."""
    peptides, matches = results.peptides, results.matches
    numbers = [c for c, t in matches.dtypes if t == "double"]
    of = lambda i, name: matches.where(f"{name}_id is not null").select("match_id", F.col(f"{name}_id").alias("peptide_id"), F.lit(i).alias("peptide_index"), F.col(f"link{i + 1}").cast("int").alias("link_site") if i < 2 else F.lit(None).cast("int").alias("link_site"))
    return {
        "peptide": peptides.select("peptide_id", "seq", "base_seq", "mass", "is_decoy"),
        "has_protein": peptides.select("peptide_id", F.inline("positions")).select("peptide_id", "protein_id", F.col("protein").alias("accession"), F.col("start").alias("start_at")),
        "spectrum_match": matches.select("match_id", "spectrum_id", F.col("hyp_charge").alias("charge"), "precursor", "linker", "linker_mass", "is_decoy", "match_rank", "match_score"),
        "matched_peptide": of(0, "alpha").union(of(1, "beta")).union(of(2, "gamma")),
        "match_value": matches.select("match_id", *numbers).unpivot(["match_id"], numbers, "name", "amount").where("amount is not null and not isnan(amount)"),
        "matched_fragment": results.matched.select("match_id", "peptide_index", "ion_type", F.col("n").alias("residues"), F.col("first").alias("first_residue"), F.col("last").alias("last_residue"), "loss_name", "loss_count", "is_crosslinked", "match_charge", "mz", "intensity", "error", "is_primary"),
    }


def search_database(spark: SparkSession, url: str, tables: dict[str, str] | None = None, write: bool = True, mode: str = "errorifexists", **options: str) -> Results:
    """Read configuration, spectra and proteins, run the search that the configuration asks for, and write result_tables() back."""
    config = read_configuration(spark, url, (TABLES | (tables or {}))["configuration"], **options)
    spectra, proteins = read_database(spark, url, tables, **options)
    found = run(spectra, proteins, config)
    if write:
        write_tables(result_tables(found), "", url, mode)
    return found
