"""Proteins to peptides: cleavage rules, missed cleavages, modifications, deduplication against decoys."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, islice, product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import bound
from ..functions.masses import WATER, residue_mass, weighable


@dataclass(frozen=True)
class Protease:
    """Cleavage rule: after the residues of `after` unless the next is in `unless_next`; before those of `before` unless the previous is in `unless_previous`."""

    after: tuple[str, ...] = ()
    unless_next: tuple[str, ...] = ()
    before: tuple[str, ...] = ()
    unless_previous: tuple[str, ...] = ()

    def cuts(self, residues: Column) -> Column:
        """0-based positions after which the sequence is cut (not the last)."""
        base = lambda c: F.substring(c, 1, 1)

        def is_cut(i: Column) -> Column:
            here, nxt = F.get(residues, i), F.get(residues, i + 1)
            rule = F.lit(False)
            if self.after:
                ok = here.isin(*self.after)  # a modified residue is another token and doesn't match
                rule = rule | (ok & ~base(nxt).isin(*self.unless_next) if self.unless_next else ok)
            if self.before:
                ok = nxt.isin(*self.before)
                rule = rule | (ok & ~base(here).isin(*self.unless_previous) if self.unless_previous else ok)
            return rule

        return F.when(F.size(residues) > 1, F.filter(F.sequence(F.lit(0), F.size(residues) - 2), is_cut)).otherwise(F.array().cast("array<int>"))


TRYPSIN = Protease(after=("K", "R"), unless_next=("P",))


def pieces(proteins: DataFrame, residues: str, protease: Protease, missed: int, most_mass: float | None = None, methionine_loss: bool = True, extra: dict[str, float] | None = None) -> DataFrame:
    """Peptides of each protein: its columns but residues, plus start (0-based), stop (exclusive), missed, n_term, c_term, peptide (array), mass.

    A peptide spans up to `missed` cut positions. With most_mass, heavy peptides are dropped; as masses
    are positive, that also drops every span around a piece that is too heavy by itself. A leading M may
    be lost: the peptides at the start are repeated without it. Residues without a mass drop their spans.
    The spans are built as arrays and exploded once, so a long protein isn't copied for each peptide.
    """
    others = [c for c in proteins.columns if c != residues]
    held = proteins.where(F.size(residues) > 0)

    def spans_of(r: Column, cuts: Column) -> Column:
        """Spans over cut positions; both are lambda variables, so residues and cuts are found once per protein."""
        n = F.size(cuts)
        lost = (F.get(r, F.lit(0)) == "M") if methionine_loss else F.lit(False)
        start_of = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1) + 1)
        stop_of = lambda i: F.when(i >= n, F.size(r)).otherwise(F.get(cuts, i) + 1)

        def span(start: Column, stop: Column, m: Column, first: Column) -> Column:
            return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), m.alias("missed"), first.alias("n_term"), (stop == F.size(r)).alias("c_term"), F.slice(r, start + 1, stop - start).alias("peptide"))

        def from_start(i: Column) -> Column:
            def to(m: Column) -> Column:
                start, stop = start_of(i), stop_of(i + m)
                whole = F.array(span(start, stop, m, start == 0))
                return F.when((start == 0) & lost & (stop > 1), F.concat(whole, F.array(span(F.lit(1), stop, m, F.lit(True))))).otherwise(whole)

            return F.flatten(F.transform(F.sequence(F.lit(0), F.least(F.lit(missed), n - i)), to))

        return F.flatten(F.transform(F.sequence(F.lit(0), n), from_start))

    def cut(r: Column) -> Column:
        # Residues without a mass are looked up once per protein; the mass itself is added up only where it is wanted.
        bad = F.filter(F.transform(r, lambda x, i: F.when(~weighable(x, extra), i)), lambda i: i.isNotNull())
        return F.struct(bound(protease.cuts(r), lambda cuts: spans_of(r, cuts)).alias("spans"), bad.alias("bad"))

    own = [F.col(f"`{c}`") for c in others]
    out = held.select(*own, bound(F.col(residues), cut).alias("__cut")).select(*own, F.col("__cut.bad").alias("__bad"), F.inline("__cut.spans"))
    whole = (F.size("__bad") == 0) | ~F.exists("__bad", lambda i: (i >= F.col("start")) & (i < F.col("stop")))
    out = out.where(whole).drop("__bad").withColumn("mass", F.aggregate("peptide", F.lit(WATER), lambda acc, x: acc + residue_mass(x, extra)))
    return out.where(F.col("mass") <= most_mass) if most_mass is not None else out


def unspecific(proteins: DataFrame, residues: str, shortest: int, longest: int, most_mass: float | None = None) -> DataFrame:
    """All substrings with a length in range."""
    r = F.col(residues)
    out = proteins.where(F.size(r) >= shortest).withColumn("start", F.explode(F.sequence(F.lit(0), F.size(r) - shortest)))
    out = out.withColumn("stop", F.explode(F.sequence(F.col("start") + shortest, F.least(F.col("start") + longest, F.size(r)))))
    out = out.withColumn("peptide", F.slice(r, F.col("start") + 1, F.col("stop") - F.col("start")))
    out = out.withColumn("mass", F.aggregate("peptide", F.lit(WATER), lambda acc, x: acc + residue_mass(x))).where(F.col("mass") < float("inf"))
    return out.where(F.col("mass") <= most_mass) if most_mass is not None else out


def undigested(proteins: DataFrame, residues: str) -> DataFrame:
    """Each protein as one peptide."""
    return pieces(proteins, residues, Protease(), 0, methionine_loss=False)


def multi_step(proteins: DataFrame, residues: str, steps: list[Protease], missed: int, mode: str = "consecutive", **options) -> DataFrame:
    """consecutive: digest the peptides of a step by the next. independent: union over steps. full: one digest that cuts by any rule."""
    if mode == "independent":
        out = pieces(proteins, residues, steps[0], missed, **options)
        for s in steps[1:]:
            out = out.unionByName(pieces(proteins, residues, s, missed, **options))
        return out.distinct()
    if mode == "full":
        every = Protease(sum((s.after for s in steps), ()), sum((s.unless_next for s in steps), ()), sum((s.before for s in steps), ()), sum((s.unless_previous for s in steps), ()))
        return pieces(proteins, residues, every, missed, **options)
    out = pieces(proteins, residues, steps[0], missed, **options)
    for s in steps[1:]:
        names = ["start", "stop", "missed", "n_term", "c_term", "peptide", "mass"]
        held = out.withColumnsRenamed({n: f"outer_{n}" for n in names})
        inner = pieces(held.withColumn("__peptide", F.col("outer_peptide")), "__peptide", s, missed, **(options | {"methionine_loss": False}))
        inner = inner.withColumn("start", F.col("outer_start") + F.col("start")).withColumn("stop", F.col("outer_start") + F.col("stop"))
        inner = inner.withColumn("n_term", F.col("outer_n_term") & F.col("n_term")).withColumn("c_term", F.col("outer_c_term") & F.col("c_term"))
        out = inner.drop(*[f"outer_{n}" for n in names])
    return out


def routed(peptides: DataFrame, crosslinkable: Column, shortest_linear: int = 4) -> DataFrame:
    """Mark the index of each peptide: "crosslinkable", "linear" (long enough), else null."""
    return peptides.withColumn("index", F.when(crosslinkable, F.lit("crosslinkable")).when(F.size("peptide") >= shortest_linear, F.lit("linear")))


def deduplicated(peptides: DataFrame, key: list[str], position: Column, decoy: str) -> tuple[DataFrame, DataFrame]:
    """(kept, discarded decoys): peptides merged by key with their positions collected; where a target exists, decoys are discarded."""
    merged = peptides.groupBy(*key).agg(
        F.min(F.col(decoy).cast("int")).cast("boolean").alias("is_decoy"),
        F.max(F.col(decoy).cast("int")).cast("boolean").alias("__any_decoy"),
        F.collect_set(F.when(~F.col(decoy), position)).alias("__target"),
        F.collect_set(F.when(F.col(decoy), position)).alias("__decoy"),
    )
    kept = merged.withColumn("positions", F.sort_array(F.when(F.col("is_decoy"), F.col("__decoy")).otherwise(F.col("__target"))))
    discarded = merged.where(~F.col("is_decoy") & F.col("__any_decoy")).select(*key, F.sort_array("__decoy").alias("positions"))
    return kept.drop("__target", "__decoy", "__any_decoy"), discarded


def readded_decoys(discarded: DataFrame, kept: DataFrame, peptide: str = "peptide", tries: int = 20) -> DataFrame:
    """Decoys that a target ousted, permuted until they are new: discarded with `peptide` replaced and `attempt`.

    The last residue stays, as the cleavage site. Of the permutations (drawn by hash, so reruns agree) the first that is no
    kept peptide counts; where two decoys draw the same, the smaller original has it. Peptides without a new
    permutation are left out.
    """
    from .decoys import shuffle

    body = F.slice(peptide, 1, F.size(peptide) - 1)
    turned = F.concat(F.reverse(shuffle(F.reverse(body), F.concat_ws(",", F.col(peptide), F.col("attempt").cast("string")))), F.slice(peptide, F.size(peptide), 1))
    drawn = discarded.where(F.size(peptide) > 2).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(tries)))).withColumn("__new", turned)
    fresh = drawn.join(kept.select(F.col(peptide).alias("__new")).distinct(), "__new", "left_anti")
    first = fresh.withColumn("__k", F.row_number().over(Window.partitionBy(peptide).orderBy("attempt"))).where("__k = 1")
    one = first.withColumn("__k", F.row_number().over(Window.partitionBy("__new").orderBy(peptide))).where("__k = 1").drop("__k")
    return one.select(*[F.col("__new").alias(c) if c == peptide else F.col(c) for c in discarded.columns], "attempt")


def unique_peptides(peptides: DataFrame, key: list[str], protein: str) -> DataFrame:
    """One row per peptide, with the number of its proteins."""
    return peptides.groupBy(*key).agg(F.count_distinct(protein).alias("proteins"))


def containing(peptides: DataFrame, residue: str, peptide: str = "peptide") -> DataFrame:
    """How many peptides there are, and how many of them hold a residue."""
    return peptides.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.array_contains(peptide, residue), 1)).alias("n_with"))


def cleaned(peptides: DataFrame, most_proteins: int = 10, shortest: int = 1, protein: str = "positions.protein_id") -> DataFrame:
    """Drop peptides of more than most_proteins proteins, and short ones."""
    return peptides.where((F.size(F.array_distinct(F.col(protein))) <= most_proteins) & (F.size("peptide") >= shortest))


@dataclass(frozen=True)
class Modification:
    symbol: str  #: token that replaces the residue, e.g. "Mox"
    residue: str  #: residue it applies to
    delta: float
    kind: str = "variable"  #: fixed, variable, linear (for peptides that aren't crosslinked) or known
    where: str = "any"  #: any, nterm, cterm (of the peptide), nterm_protein, cterm_protein


def fixed(residues: Column, mods: list[Modification]) -> Column:
    """Apply fixed modifications and labels to a residue array."""
    table = {m.residue: m.symbol for m in mods if m.kind == "fixed"}
    if not table:
        return residues
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(residues, lambda r: F.coalesce(F.element_at(names, r), r))


def modification_masses(mods: list[Modification], base: dict[str, float]) -> dict[str, float]:
    return {m.symbol: base[m.residue] + m.delta for m in mods}


def variable(peptides: DataFrame, mods: list[Modification], most_mods: int = 3, most_forms: int = 20, kinds: tuple[str, ...] = ("variable",)) -> DataFrame:
    """One row per modified form: columns of peptides with `peptide` replaced and mods (position -> symbol) added.

    Forms come in order of how many residues they change, then of position, so the limit of most_forms
    modified forms per peptide keeps the least modified ones. The unmodified form always stays.
    """
    chosen = [m for m in mods if m.kind in kinds]
    schema = peptides.drop("mods").schema.add("mods", T.MapType(T.IntegerType(), T.StringType()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                residues = list(row.peptide)
                n = len(residues)
                sites = []
                for i, r in enumerate(residues):
                    here = [
                        m.symbol
                        for m in chosen
                        if m.residue == r
                        and (m.where == "any" or m.where == "nterm" and i == 0 or m.where == "cterm" and i == n - 1 or m.where == "nterm_protein" and i == 0 and getattr(row, "n_term", False) or m.where == "cterm_protein" and i == n - 1 and getattr(row, "c_term", False))
                    ]
                    if here:
                        sites.append((i, here))
                changed = (
                    dict(zip([p for p, _ in places], symbols, strict=True))
                    for k in range(1, min(most_mods, len(sites)) + 1)
                    for places in combinations(sites, k)
                    for symbols in product(*[s for _, s in places])
                )
                forms = [{}, *islice(changed, most_forms)]
                for form in forms:
                    d = row._asdict() | {"peptide": [form.get(i, r) for i, r in enumerate(residues)], "mods": form}
                    rows.append(d)
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    return peptides.drop("mods").mapInPandas(run, schema)


def base_residues(residues: Column) -> Column:
    """Residue tokens without the alternatives that X(a|b) lists."""
    return F.transform(residues, lambda r: F.regexp_replace(r, r"\([^)]*\)$", ""))


def embedded_sites(residues: Column, known: list[str] | None = None) -> Column:
    """Residues written as X(a|b) with their alternatives: an array of (at, options), at from 0.

    An option is the token Xa, or X[12.3] for a mass of one's own, written [12.3] or name=[12.3]; X(a|) also lists the bare X. Tokens
    that are neither in `known` (if given) nor masses are left out.
    """
    def options(r: Column) -> Column:
        listed = F.split(F.regexp_extract(r, r"\(([^)]*)\)$", 1), r"\|")
        tokens_ = F.transform(listed, lambda m: F.concat(F.substring(r, 1, 1), F.trim(m)))
        return F.filter(tokens_, lambda t: t.isin(*known) | (F.length(t) == 1) | t.rlike(r"\[[-+]?[0-9.]+\]$")) if known is not None else tokens_

    every = F.transform(residues, lambda r, i: F.struct(i.alias("at"), F.when(r.rlike(r"^[A-Z]\([^)]+\)$"), options(r)).otherwise(F.array().cast("array<string>")).alias("options")))
    return F.filter(every, lambda s: F.size(s["options"]) > 0)


_FORMS = 4096  #: forms of a peptide that one row lists before they are opened


def embedded_forms(peptides: DataFrame, sites: str = "embedded", most_mods: int | None = 3, most_forms: int | None = 20) -> DataFrame:
    """peptides and their forms by the sites of the protein that lie in them: `peptide` replaced and `changes` (their number) added; sites is dropped.

    Forms come by how many sites they change, up to most_mods. A number of changes is taken whole, and no larger one once
    most_forms are reached, so what is made of a peptide is bounded by its sites and that limit. With None for both every form is
    made: it is numbered by its choices at the sites, and a peptide's numbers are opened in pieces, so no row holds all its forms.
    """
    if (most_mods is None) != (most_forms is None):
        raise ValueError("give most_mods and most_forms, or neither")
    form = "array<struct<at:int,token:string>>"
    none = F.array().cast(f"array<{form}>")

    def longer(shorter: Column, own: Column) -> Column:
        def extended(f: Column) -> Column:
            last = F.coalesce(F.get(F.transform(f, lambda c: c["at"]), F.size(f) - 1), F.lit(-1))
            later = F.filter(own, lambda s: s["at"] > last)
            return F.flatten(F.transform(later, lambda s: F.transform(s["options"], lambda o: F.concat(f, F.array(F.struct(s["at"].alias("at"), o.alias("token")))))))

        return F.flatten(F.transform(shorter, extended))

    def level(own: Column, done: Column, last: Column, k: int) -> Column:
        if k > most_mods:
            return done
        grown = F.when(F.size(done) < most_forms, longer(last, own)).otherwise(none)
        return bound(grown, lambda new: level(own, F.concat(done, new), new, k + 1))

    inside = F.filter(F.col(sites), lambda s: (s["at"] >= F.col("start")) & (s["at"] < F.col("stop")))
    own = F.transform(inside, lambda s: F.struct((s["at"] - F.col("start")).alias("at"), s["options"].alias("options")))
    if most_mods is None:
        ways = F.aggregate("__own", F.lit(1).cast("long"), lambda n, s: n * (F.size(s["options"]) + 1))
        out = peptides.withColumn("__own", own).withColumn("__ways", ways).withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__ways - 1) div {_FORMS}"))))
        out = out.withColumn("__k", F.explode(F.sequence(F.col("__piece") * _FORMS, F.least(F.col("__piece") * _FORMS + _FORMS - 1, F.col("__ways") - 1))))

        def chosen(acc: Column, s: Column) -> Column:
            size = F.size(s["options"]) + 1
            pick = (acc["k"] % size).cast("int")
            more = F.when(pick > 0, F.array(F.struct(s["at"].alias("at"), F.get(s["options"], pick - 1).alias("token")))).otherwise(F.array().cast(form))
            return F.struct(F.call_function("div", acc["k"], size).alias("k"), F.concat(acc["form"], more).alias("form"))

        start = F.struct(F.col("__k").alias("k"), F.array().cast(form).alias("form"))
        out = out.withColumn("__form", F.aggregate("__own", start, chosen, lambda acc: acc["form"])).drop("__own", "__ways", "__piece", "__k")
        return _changed(out, sites)
    empty = F.array(F.array().cast(form))
    forms = F.when(F.size(own) > 0, bound(own, lambda o: F.concat(empty, bound(longer(empty, o), lambda first: level(o, first, first, 2))))).otherwise(empty)
    return _changed(peptides.withColumn("__form", F.explode(forms)), sites)


def _changed(out: DataFrame, sites: str) -> DataFrame:
    """Rows with `peptide` as __form (at, token) says, `changes`, and neither __form nor sites."""
    changed = F.transform("peptide", lambda r, i: F.coalesce(F.get(F.transform(F.filter("__form", lambda c: c["at"] == i), lambda c: c["token"]), F.lit(0)), r))
    return out.withColumns({"peptide": changed, "changes": F.size("__form")}).drop("__form", sites)
