"""Writers: match tables, annotated peaks, MGF, FASTA, normalised tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(c: Column, digits: int = 6) -> Column:
    """A double with at most `digits` decimals and no trailing zeros."""
    text = F.format_string(f"%.{digits}f", c)
    return F.when(c.isNull() | F.isnan(c), F.lit("")).otherwise(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def write_matches(matches: DataFrame, path: str, scores: list[str] | None = None, digits: int = 6) -> None:
    """Match table: gzip by .gz, tab separated for .tsv and .txt, else commas; doubles in plain notation."""
    bare = path.lower().removesuffix(".gz")
    columns = [f.name for f in matches.schema if f.name not in (scores or [])] + (scores or [])
    out = [number(F.col(c), digits).alias(c) if isinstance(matches.schema[c].dataType, T.DoubleType | T.FloatType) else F.col(c).cast("string").alias(c) for c in columns]
    writer = matches.select(*out).write.option("header", True).option("sep", "\t" if bare.endswith((".tsv", ".txt")) else ",")
    (writer.option("compression", "gzip") if path.lower().endswith(".gz") else writer).csv(path)


def write_annotated_peaks(matched: DataFrame, path: str, columns: list[str]) -> None:
    """One row per matched peak, tab separated."""
    matched.select(*columns).write.option("header", True).option("sep", "\t").csv(path)


def deisotoped_list(charged: DataFrame, matched: DataFrame) -> DataFrame:
    """Peaks of spectra after isotope series became one peak each, with what explains them: spectrum_id, match_id, mz, charge, intensity, explanations.

    charged: spectrum_id, mz, intensity, charge; matched: match_id, spectrum_id, mz, and the fragment's columns. Peaks that nothing
    explains stand once for each match of their spectrum, without an explanation; of several explanations the primary one is first.
    """
    name = F.concat(F.when(F.col("is_crosslinked"), F.lit("+")).otherwise(F.lit("")), "ion_type", F.col("n").cast("string"), "loss_name", F.lit("_p"), (F.col("peptide_index") + 1).cast("string"))
    told = matched.groupBy("match_id", "spectrum_id", "mz").agg(F.sort_array(F.collect_set(F.struct((~F.col("is_primary")).alias("later"), name.alias("name")))).alias("e"))
    every = charged.join(matched.select("match_id", "spectrum_id").distinct(), "spectrum_id")
    out = every.join(told, ["match_id", "spectrum_id", "mz"], "left")
    return out.select("spectrum_id", "match_id", "mz", "charge", "intensity", F.coalesce(F.array_join(F.transform("e", lambda x: x["name"]), ";"), F.lit("")).alias("explanations"))


def write_deisotoped_list(charged: DataFrame, matched: DataFrame, path: str, digits: int = 6) -> None:
    """deisotoped_list() as tab separated text."""
    out = deisotoped_list(charged, matched)
    write_annotated_peaks(out.withColumns({c: number(F.col(c), digits) for c in ("mz", "intensity")}), path, out.columns)


def mgf_block(title: Column, mz: Column, charge: Column, rt: Column, peaks: Column) -> Column:
    """One MGF block; peaks is an array of (mz, intensity)."""
    lines = F.transform(peaks, lambda p: F.concat_ws(" ", p["mz"].cast("string"), p["intensity"].cast("string")))
    charge_line = F.when(charge > 0, F.concat(F.lit("CHARGE="), charge.cast("string"), F.lit("+")))
    return F.concat_ws("\n", F.lit("BEGIN IONS"), F.concat(F.lit("TITLE="), title), F.concat(F.lit("PEPMASS="), mz.cast("string")), charge_line, F.concat(F.lit("RTINSECONDS="), rt.cast("string")), F.concat_ws("\n", lines), F.lit("END IONS"), F.lit(""))


def write_mgf(spectra: DataFrame, path: str, compress: bool = False) -> None:
    writer = spectra.select(mgf_block(F.col("scan_title"), F.col("precursor_mz"), F.col("precursor_charge"), F.col("rt_start"), F.col("peaks")).alias("value")).write
    (writer.option("compression", "gzip") if compress else writer).text(path)


def fasta_entry(header: Column, residues: Column, width: int = 100) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), F.rtrim(F.regexp_replace(F.array_join(residues, ""), f"(.{{{width}}})", "$1\n")))


def write_fasta(proteins: DataFrame, path: str) -> None:
    proteins.select(fasta_entry(F.col("header"), F.col("residues")).alias("value")).write.text(path)


def error_table(matched: DataFrame, digits: int = 2) -> DataFrame:
    """Histogram of fragment errors."""
    return matched.groupBy(F.round("error", digits).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def write_tables(tables: dict[str, DataFrame], path: str, url: str | None = None, mode: str = "errorifexists") -> None:
    """Normalised result tables (spectrum, spectrum_peak, peptide, protein, has_protein, fragment, spectrum_match, score ...) as Parquet, or by JDBC."""
    for name, df in tables.items():
        if url is None:
            df.write.mode(mode).parquet(f"{path}/{name}")
        else:
            df.write.mode(mode).jdbc(url, name)


def fan_out(df: DataFrame, sinks: list) -> None:
    """Several sinks over one computation: the frame is kept on disk while they run."""
    from pyspark import StorageLevel

    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        for sink in sinks:
            sink(held)
    finally:
        held.unpersist()


def spectral_library(matches: DataFrame) -> DataFrame:
    """Projection of matches for spectral-library builders: file, scan, charge, sequence, score."""
    return matches.select("peak_file", "scan", F.col("precursor_charge").alias("charge"), F.col("peptide_sequence").alias("sequence"), F.lit("UNKNOWN").alias("score-type"), F.col("match_score").alias("score"))
