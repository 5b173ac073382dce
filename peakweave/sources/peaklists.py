"""Readers of peak lists: MGF, APL and mzML text, plain, gzipped or in archives."""

from __future__ import annotations

import base64
import codecs
import gzip
import io
import shutil
import tarfile
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import IO
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = r"([0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?)"

# Forms of spectrum titles, tried in order; the groups of a pattern are named by role.
TITLES = (
    {"name": "MaxQuant", "pattern": r"RawFile:\s*(.+?)\s+FinneganScanNumber:\s+(\d+)", "run": 1, "scan": 2},
    {"name": "Andromeda", "pattern": r"RawFile: (\S+) Index: (\d+)", "run": 1, "scan": 2},
    {"name": "Mascot", "pattern": r"^\d+: (?:Scan|Sum of \d+ scans in range) (\d+) \(rt=([\d.]+)\).*\[(?:.*[/\\])?([^/\\]*)\]", "scan": 1, "rt": 2, "run": 3},
    {"name": "QEX", "pattern": r"^(.+?)\s+Spectrum\d+\s*scans: (\d+)", "run": 1, "scan": 2},
    {"name": "MassMatrix", "pattern": r"^File:(.*?)\s*Scans:(\d+)\s*RT:.+?Charge:(\d+)\+", "run": 1, "scan": 2, "charge": 3},
    {"name": "MSConvert", "pattern": r"^(.*)\.(\d+)\.\d+\.(\d*)(?:\s.*)?$", "run": 1, "scan": 2, "charge": 3},
    {"name": "OpenMS", "pattern": r"\s(?:scan|index)=(\d+)_(.*)$", "scan": 1, "run": 2},
    {"name": "run", "pattern": r"^([^\s.]*)", "run": 1},
    {"name": "scan", "pattern": r"scans?[:=\s]+(\d+)", "scan": 1},
    {"name": "number", "pattern": r"^[^\s.]*?(\d{3,10})", "scan": 1},
)


def first_match(text: Column, patterns: tuple[str, ...], group: int = 1) -> Column:
    """What the first pattern that matches captures, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns])


def of_title(title: Column, role: str, own: str | None = None) -> Column:
    """Run, scan, rt or charge that the first fitting form of a title states, as text; own: a pattern that is tried first."""
    found = [F.nullif(F.regexp_extract(title, f["pattern"], f[role]), F.lit("")) for f in TITLES if role in f]
    return F.coalesce(*([F.nullif(F.regexp_extract(title, own, 1), F.lit(""))] if own else []), *found)


def _key(block: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?im)^{name}[ \t]*=[ \t]*(.*)$", 1)), F.lit(""))


def _peaks(block: Column) -> Column:
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(rf"^\s*{_NUMBER}[\s;,]+{_NUMBER}"))
    return F.array_sort(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, rf"^\s*{_NUMBER}", 1).cast("double").alias("mz"), F.regexp_extract(x, rf"^\s*{_NUMBER}[\s;,]+{_NUMBER}", 2).cast("double").alias("intensity"))))


def _numbers(text: Column, signed: bool = True) -> Column:
    """Numbers in a text; unsigned ones may be parted by a hyphen (a range)."""
    pattern = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)" if signed else r"(\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), lambda x: x.cast("double"))


def parse_mgf(blocks: DataFrame, run_pattern: str | None = None, scan_pattern: str | None = None, block: str = "value", file: str = "peak_file") -> DataFrame:
    """Spectra of text blocks that end before END IONS."""
    b = F.substring_index(F.col(block), "BEGIN IONS", -1)
    title = _key(b, "TITLE")
    charges = F.transform(_numbers(_key(b, "CHARGE")), lambda x: x.cast("int"))
    rt = _numbers(_key(b, "RTINSECONDS"), signed=False)
    mass = _numbers(_key(b, "PEPMASS"))
    stated_rt = of_title(title, "rt").try_cast("double")
    return blocks.where(F.col(block).contains("BEGIN IONS")).select(
        F.col(file),
        title.alias("scan_title"),
        of_title(title, "run", run_pattern).alias("run"),
        F.coalesce(F.regexp_extract(_key(b, "SCANS"), r"(\d+)", 1).try_cast("int"), of_title(title, "scan", scan_pattern).try_cast("int")).alias("scan"),
        F.coalesce(F.get(rt, F.lit(0)), stated_rt).alias("rt_start"),
        F.coalesce(F.get(rt, F.lit(1)), F.get(rt, F.lit(0)), stated_rt).alias("rt_end"),
        F.get(mass, F.lit(0)).alias("precursor_mz"),
        F.get(mass, F.lit(1)).alias("precursor_intensity"),
        F.when(F.size(charges) == 1, charges[0]).when(F.size(charges) == 0, F.coalesce(of_title(title, "charge").cast("int"), F.lit(-1))).otherwise(-1).alias("precursor_charge"),
        F.when(F.size(charges) > 1, charges).otherwise(F.array().cast("array<int>")).alias("charge_alternatives"),
        _numbers(_key(b, "ADDITIONALMZ")).alias("additional_mz"),
        F.transform(_numbers(_key(b, "ADDITIONALCHARGES")), lambda x: x.cast("int")).alias("additional_charge"),
        F.transform(F.split(F.coalesce(_key(b, "XLPEPMASSES"), F.lit("")), r"\s*[;,]\s*"), lambda x: F.struct(F.get(_numbers(x), F.lit(0)).alias("mass"), F.coalesce(F.get(_numbers(x), F.lit(1)), F.lit(1.0)).alias("weight"))).alias("candidate_masses"),
        _peaks(b).alias("peaks"),
    ).withColumn("candidate_masses", F.filter("candidate_masses", lambda c: c["mass"].isNotNull()))


def read_mgf(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """MGF files (gzip by suffix), split at END IONS, so a plain large file is read by many tasks."""
    text = spark.read.option("lineSep", "END IONS").text(path).withColumn("peak_file", F.col("_metadata.file_path"))
    return parse_mgf(text, **options)


def read_apl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Andromeda peak lists: blocks from "peaklist start" to "peaklist end"."""
    return parse_apl(spark.read.option("lineSep", "peaklist end").text(path).withColumn("peak_file", F.col("_metadata.file_path")))


def parse_apl(text: DataFrame) -> DataFrame:
    """Spectra of text blocks that end before "peaklist end"."""
    b = F.substring_index("value", "peaklist start", -1)
    header = _key(b, "header")
    return text.where(F.col("value").contains("peaklist start")).select(
        "peak_file",
        header.alias("scan_title"),
        of_title(header, "run").alias("run"),
        of_title(header, "scan").try_cast("int").alias("scan"),
        F.nullif(F.regexp_extract(header, r"(?i)elution(?:time)?[:=\s]*([\d.]+)", 1), F.lit("")).cast("double").alias("rt_start"),
        _key(b, "mz").cast("double").alias("precursor_mz"),
        F.nullif(F.regexp_extract(header, r"(?i)intensity[:=\s]*([\d.eE+]+)", 1), F.lit("")).cast("double").alias("precursor_intensity"),
        F.coalesce(_key(b, "charge").cast("int"), F.lit(-1)).alias("precursor_charge"),
        _peaks(b).alias("peaks"),
    )


#: Accessions of the mzML vocabulary.
CV = {"level": "MS:1000511", "time": "MS:1000016", "mz": "MS:1000744", "charge": "MS:1000041", "intensity": "MS:1000042", "mz_array": "MS:1000514", "intensity_array": "MS:1000515", "zlib": "MS:1000574", "float64": "MS:1000523"}


def read_mzml(spark: SparkSession, path: str, level: int = 2) -> DataFrame:
    """Spectra of one MS level of mzML files; binary arrays are decoded in Arrow batches."""
    return parse_mzml(spark.read.option("lineSep", "</spectrum>").text(path).withColumn("peak_file", F.col("_metadata.file_path")), level)


def parse_mzml(blocks: DataFrame, level: int = 2) -> DataFrame:
    """Spectra of one MS level of text blocks that end before "</spectrum>"."""
    text = blocks.where(F.col("value").contains("<spectrum "))
    b = F.substring_index("value", "<spectrum ", -1)
    cv = lambda acc: F.nullif(F.regexp_extract(b, rf'accession="{acc}"[^>]*?value="([^"]*)"', 1), F.lit(""))
    arrays = F.filter(F.split(b, "<binaryDataArray "), lambda x: x.contains("<binary>"))
    pick = lambda acc: F.get(F.filter(arrays, lambda x: x.contains(CV[acc])), F.lit(0))
    rows = text.select("peak_file", F.regexp_extract(b, r'id="([^"]*)"', 1).alias("scan_title"), F.regexp_extract(b, r"scan=(\d+)", 1).cast("int").alias("scan"), cv(CV["level"]).cast("int").alias("level"), cv(CV["time"]).cast("double").alias("rt_start"), cv(CV["mz"]).cast("double").alias("precursor_mz"), cv(CV["intensity"]).cast("double").alias("precursor_intensity"), F.coalesce(cv(CV["charge"]).cast("int"), F.lit(-1)).alias("precursor_charge"), pick("mz_array").alias("__mz"), pick("intensity_array").alias("__int")).where(F.col("level") == level)

    def one(xml: str | None) -> np.ndarray:
        if not xml:
            return np.empty(0)
        body = base64.b64decode(xml.partition("<binary>")[2].partition("</binary>")[0])
        body = zlib.decompress(body) if CV["zlib"] in xml else body
        return np.frombuffer(body, np.float64 if CV["float64"] in xml else np.float32).astype(float)

    def decode(x: pd.Series) -> pd.Series:
        return x.map(one)

    array_of = F.pandas_udf(decode, "array<double>")
    rows = rows.withColumn("__m", array_of("__mz")).withColumn("__i", array_of("__int")).drop("__mz", "__int")
    return rows.withColumn("peaks", F.array_sort(F.arrays_zip(F.col("__m").alias("mz"), F.col("__i").alias("intensity")))).drop("__m", "__i", "level")


#: What ends a spectrum, by format.
_ENDS = {"mgf": "END IONS", "apl": "peaklist end", "mzml": "</spectrum>"}


_ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz")
_BATCH = 8 << 20  #: characters of blocks that are handed on at once


def _format(name: str) -> str:
    """Format of a file, by suffix; what has no suffix of its own is MGF."""
    low = name.lower()
    if low.endswith(_ARCHIVES):
        return "zip" if low.endswith(".zip") else "tar"
    bare = low.removesuffix(".gz")
    return "zip" if bare.endswith(".zip") else "apl" if bare.endswith(".apl") else "mzml" if bare.endswith(".mzml") else "mgf"


def _wanted(member: str, suffix: str) -> bool:
    junk = member.startswith("__MACOSX") or member.rpartition("/")[2].startswith(("._", ".DS_Store"))
    return not junk and (member.lower().endswith(suffix) or _format(member) in ("zip", "tar"))


def _members(z: zipfile.ZipFile, suffix: str) -> list[str]:
    return [i.filename for i in z.infolist() if not i.is_dir() and _wanted(i.filename, suffix)]


def _blocks(f: IO[bytes], name: str, suffix: str) -> Iterator[tuple[str, str, str]]:
    """Format, text and file of each block of an open file, in archives of archives too."""
    kind = _format(name)
    if kind == "tar":
        with tarfile.open(fileobj=f, mode="r|*") as t:  # read in one go, as a compressed archive has to be
            for info in t:
                if info.isfile() and _wanted(info.name, suffix):
                    yield from _blocks(t.extractfile(info), f"{name}!{info.name}", suffix)
        return
    with gzip.open(f) if name.lower().endswith(".gz") else f as plain:
        if kind == "zip":
            with tempfile.TemporaryFile() as copy:  # a zip is read from its end
                shutil.copyfileobj(plain, copy)
                with zipfile.ZipFile(copy) as inner:
                    for m in _members(inner, suffix):
                        yield from _blocks(inner.open(m), f"{name}!{m}", suffix)
            return
        if name.lower().endswith((".list", ".msmlist")):
            raise ValueError(f"{name} lists files, which an archive can't name")
        held, decode = "", codecs.getincrementaldecoder("utf-8")("replace").decode
        while data := plain.read(1 << 20):
            if "\0" in (more := decode(data)):
                raise ValueError(f"{name} is not a peak list")
            *whole, held = (held + more).split(_ENDS[kind])
            yield from ((kind, block, name) for block in whole)
        if held.strip():
            yield kind, held, name


def _frames(blocks: Iterator[tuple[str, str, str]]) -> Iterator[pd.DataFrame]:
    """Blocks in frames of about _BATCH characters."""
    rows, held = [], 0
    for row in blocks:
        rows.append(row)
        held += len(row[1])
        if held >= _BATCH:
            yield pd.DataFrame(rows, columns=["kind", "value", "peak_file"])
            rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=["kind", "value", "peak_file"])


def read_archive(spark: SparkSession, path: str | list[str], suffix: str = "", **options) -> DataFrame:
    """Spectra of the members of archives (zip; tar, plain or compressed) whose names end in suffix: by their own suffix APL, mzML, or archives again, else MGF.

    Each member of a zip is a row, and many tasks unpack them; a tar, and an archive in an archive, is one task's work, as it can only be
    read from its start. Blocks are unpacked once and stored in the shared folder for the parsers of the formats. Where only
    Spark can open the store, an archive is one task's input and held whole. A member that is no text, or a list, is an error.
    """
    from pyarrow import ArrowInvalid, fs

    from .tables import stored

    def opened(name: str):
        store, inner = fs.FileSystem.from_uri(quote(name, safe="/:@"))
        return store.open_input_file(inner)

    files = spark.read.format("binaryFile").load(path)
    try:
        fs.FileSystem.from_uri(quote((files.select("path").first() or [""])[0], safe="/:@"))
        seekable = True
    except ArrowInvalid:
        seekable = False

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["path"]:
                if _format(name) == "tar":
                    yield pd.DataFrame({"path": [name], "member": [""]})
                    continue
                with opened(name) as f, zipfile.ZipFile(f) as z:
                    yield pd.DataFrame({"path": name, "member": _members(z, suffix)})

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, what in zip(frame["path"], frame[frame.columns[1]], strict=True):
                with opened(name) if seekable else io.BytesIO(what) as f:
                    if _format(name) == "tar" or not seekable:
                        yield from _frames(_blocks(f, name, suffix))
                        continue
                    with zipfile.ZipFile(f) as z, z.open(what) as member:
                        yield from _frames(_blocks(member, f"{name}!{what}", suffix))

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = files.select("path").mapInPandas(listed, "path string, member string").repartition(parts) if seekable else files.select("path", "content")
    blocks = stored(rows.mapInPandas(unpack, "kind string, value string, peak_file string"), "archive-blocks")
    of = lambda kind: blocks.where(F.col("kind") == kind).drop("kind")
    out = parse_mgf(of("mgf"), **options).unionByName(parse_apl(of("apl")), allowMissingColumns=True)
    return out.unionByName(parse_mzml(of("mzml")), allowMissingColumns=True)


def read_spectra(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """By suffix: .list and .msmlist (a path per line), archives (.zip, .tar, .tar.gz and the like), .apl, .mzML, else MGF; .gz is transparent.

    A list, or a folder with a / at its end, is sorted by format, and each format's files are one reader's, so its plan doesn't grow with their number.
    """
    paths = [path] if isinstance(path, str) else list(path)
    readers = {"archive": read_archive, "mgf": read_mgf, "apl": lambda s, p, **_: read_apl(s, p), "mzml": lambda s, p, **_: read_mzml(s, p)}
    found: dict[str, list[str]] = {}
    while paths:
        p = paths.pop(0)
        if p.lower().endswith((".list", ".msmlist")):
            named = [r[0].strip() for r in spark.read.text(p).collect() if r[0].strip() and not r[0].startswith("#")]
            if not named:
                raise ValueError(f"{p} lists no files")
            paths += named
        elif p.endswith("/"):
            paths += _listed(spark, p)
        else:
            kind = _format(p)
            found.setdefault("archive" if kind in ("zip", "tar") else kind, []).append(p)
    if not found:
        raise ValueError(f"no files in {path}")
    parts = [readers[kind](spark, files if len(files) > 1 else files[0], **options) for kind, files in found.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """Files of a folder, in name order, those whose names begin with . or _ left out."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = [str(f.getPath().toString()) for f in hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop) if f.isFile()]
    return sorted(f for f in found if not f.rpartition("/")[2].startswith((".", "_")))


def numbered(spectra: DataFrame) -> DataFrame:
    """A spectrum_id from the spectrum's own columns, the same on every read."""
    return spectra.withColumn("spectrum_id", F.xxhash64("peak_file", "scan_title", "scan", "precursor_mz", "rt_start"))


def input_summary(spectra: DataFrame) -> DataFrame:
    """Number of spectra and heaviest precursor, also over unknown charges up to 7."""
    z = F.when(F.col("precursor_charge") > 0, F.col("precursor_charge")).otherwise(7)
    return spectra.agg(F.count(F.lit(1)).alias("spectra"), F.max((F.col("precursor_mz") - F.lit(1.00727646677)) * z).alias("max_mass"))
