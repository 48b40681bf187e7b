"""Scalar rules as native columns: gates, flags, tiers, bands, parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """NaN becomes null; infinities stay."""
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def number(c: Column) -> Column:
    return clean(c.try_cast("double"))


def gate(loss: Column, hist: Column, shape: Column, ani: Column) -> Column:
    """none without an estimate; uniform_fallback where the partial estimates lie over 5 points apart; uniform for an infinite shape; else gamma."""
    return F.when(clean(ani).isNull(), "none").when(F.coalesce(F.abs(clean(loss) - clean(hist)) > 5, F.lit(False)), "uniform_fallback").when(shape == float("inf"), "uniform").otherwise("gamma")


def gated(gate_: Column, ani: Column, uniform: Column) -> Column:
    return F.when(gate_ == "none", None).when(gate_ == "uniform_fallback", uniform).otherwise(ani)


def flag(retention: Column, chi2: Column, breakpoints: Column, least_retention: float = 0.2, most_chi2: float = 20.0, most_breaks: int = 50) -> Column:
    """BELOW_DETECTION before INCONSISTENT before ok."""
    low = F.coalesce(clean(retention) < least_retention, F.lit(True))
    odd = F.coalesce(clean(chi2) > most_chi2, F.lit(False)) | F.coalesce(breakpoints > most_breaks, F.lit(False))
    return F.when(low, "BELOW_DETECTION").when(odd, "INCONSISTENT").otherwise("ok")


def quality_tier(completeness: Column, contamination: Column) -> Column:
    comp, cont = number(completeness), number(contamination)
    return F.when(comp.isNull() | cont.isNull(), "NA").when((comp > 90) & (cont < 5), "HQ").when((comp >= 50) & (cont < 10), "MQ").otherwise("LQ")


def band(c: Column, edges: list[float], right_closed: bool = False) -> Column:
    """Label of the band between edges: [low, high), or (low, high]; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:], strict=False):
        inside = (c > lo) & (c <= hi) if right_closed else (c >= lo) & (c < hi)
        out = F.when(inside, f"{lo:g}-{hi:g}").otherwise(out)
    return out


def pair_key(a: Column, b: Column) -> Column:
    """The same for a pair in either order."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def path_id(c: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.(fasta|fna|fa)(\.gz)?$", "")


def reverse_complement(c: Column) -> Column:
    return F.translate(F.reverse(c), "ACGT", "TGCA")


def canonical(c: Column) -> Column:
    """The lesser of a sequence and its reverse complement."""
    return F.least(c, reverse_complement(c))


def gc_fraction(c: Column) -> Column:
    return F.try_divide(F.length(c) - F.length(F.translate(c, "GC", "")), F.length(c))


def packed(c: Column) -> Column:
    """Up to 31 bases as two bits each, A 0 to T 3; null for other letters or lengths."""
    digits = F.translate(c, "ACGT", "0123")
    return F.when(c.rlike("^[ACGT]{1,31}$"), F.conv(digits, 4, 10).cast("long"))


def packed_distance(a: Column, b: Column) -> Column:
    """Differing bases of two packed tags of one length: the xor is folded to one bit a base first."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of two strings of one length."""
    return F.size(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: p["x"] != p["y"]))


def cigar_identity(cigar: Column, nmatch: Column, alen: Column, nm: Column) -> Column:
    """With = in the string: = over all of =XID; else with NM: (alen - NM) / alen; else nmatch / alen."""
    n, op = F.regexp_extract_all(cigar, F.lit(r"(\d+)([=XIDMNSHP])"), F.lit(1)), F.regexp_extract_all(cigar, F.lit(r"(\d+)([=XIDMNSHP])"), F.lit(2))
    pairs = F.arrays_zip(n.alias("n"), op.alias("o"))
    total = lambda ops: F.aggregate(F.filter(pairs, lambda p: p["o"].isin(*ops)), F.lit(0.0), lambda s, p: s + p["n"].cast("double"))
    return F.when(F.coalesce(F.instr(cigar, "=") > 0, F.lit(False)), F.try_divide(total("="), total("=XID"))).when(nm.isNotNull(), F.try_divide((alen - nm).cast("double"), alen.cast("double"))).otherwise(
        F.try_divide(nmatch.cast("double"), alen.cast("double"))
    )


def sketch_ani(c1: Column, c2: Column, k: int) -> Column:
    """1 + ln(sqrt(c1 * c2)) / k within 0 and 1; 0 where a containment is 0."""
    return F.when((c1 <= 0) | (c2 <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + F.log(F.sqrt(F.greatest(c1 * c2, F.lit(1e-300)))) / k)))


def debiased(ani: Column, af1: Column, af2: Column) -> Column:
    return ani + 0.02 * (1 - ani) * (1 - F.least(af1, af2))


def confidence(anchors: Column, af1: Column, af2: Column) -> Column:
    return (1 - F.exp(-anchors / 100.0)) * F.sqrt(F.least(af1, af2))


def n50(lengths: Column) -> Column:
    """The length at which the running sum of lengths, longest first, reaches half of the total."""
    down = F.reverse(F.array_sort(lengths))
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x)
    step = lambda a, x: F.struct((a["s"] + x).alias("s"), F.when((a["r"] == 0) & ((a["s"] + x) * 2 >= total), x).otherwise(a["r"]).alias("r"))
    return F.aggregate(down, F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("r")), step)["r"]


def quality_filter(df: DataFrame, completeness: Column, contamination: Column, keys: Sequence[str], least: float = 90, most: float = 5) -> DataFrame:
    """Rows that are complete and clean enough and have all keys."""
    return df.where((completeness > least) & (contamination < most)).dropna(subset=list(keys))


def window(c: Column, low: float, high: float) -> Column:
    """low <= c < high."""
    return (c >= low) & (c < high)


def bands_inclusive(c: Column, edges: list[float]) -> Column:
    """Labels of all bands [low, high], closed on both sides: a value on an inner edge is in two."""
    labels = [F.when((c >= lo) & (c <= hi), f"{lo:g}-{hi:g}") for lo, hi in zip(edges, edges[1:], strict=False)]
    return F.array_compact(F.array(*labels))


def floor_bin(c: Column, width: float) -> Column:
    return F.floor(c / width)


def truncated_bin(c: Column, low: float, width: float) -> Column:
    """Cut off towards zero, so the first bin below `low` has number 0 too."""
    return ((c - low) / width).cast("long")


def ratio(a: Column, b: Column, floor: float) -> Column:
    """a / b, where b counts as `floor` at least."""
    return a / F.greatest(b, F.lit(floor))


def as_percent(df: DataFrame, columns: dict[str, str], most: float = 1.5) -> DataFrame:
    """Columns under new names, times 100 where no value of the column is over `most`, that is where it holds fractions."""
    tops = df.agg(*[F.max(c).alias(f"_{c}") for c in columns])
    out = df.join(F.broadcast(tops))  # one row
    return out.select("*", *[F.when(F.col(f"_{c}") <= most, F.col(c) * 100).otherwise(F.col(c)).alias(n) for c, n in columns.items()]).drop(*[f"_{c}" for c in columns])


def fraction_tier(c: Column, strict: float = 0.5, low: float = 0.15) -> Column:
    """strict, low or verylow; no value is verylow."""
    return F.when(clean(c) >= strict, "strict").when(clean(c) >= low, "low").otherwise("verylow")


def lrt_gate(lrt: Column, critical: float = 3.841) -> Column:
    """Whether the second parameter is worth it by the likelihood ratio."""
    return lrt > critical


def bic_gate(lrt: Column, n: Column) -> Column:
    return lrt > F.log(n)


def logistic(c: Column, middle: float, scale: float) -> Column:
    return 1 / (1 + F.exp(-(c - middle) / scale))


def taxonomy(c: Column, names: Sequence[str]) -> dict[str, Column]:
    """The levels of a lineage d;p;c;...; levels that are missing or empty are null."""
    parts = F.split(c, ";")
    return {n: F.nullif(F.get(parts, F.lit(i)), F.lit("")) for i, n in enumerate(names)}


#: Names of the weights of a tag.
WEIGHTS = ("uniform", "synteny", "position", "gap")


def weight(strategy: Column, block_length: Column, position: Column, gap: Column) -> Column:
    """1; the root of the block's length; 1 + sin(position); or 1 less up to a half by the gap's size, at most 10."""
    return F.when(strategy == "synteny", F.sqrt(block_length)).when(strategy == "position", 1 + F.sin(position)).when(strategy == "gap", 1 - 0.5 * F.least(F.abs(gap), F.lit(10)) / 10).otherwise(F.lit(1.0))


def sdi(conserved: Column, matched: Column) -> Column:
    """The share of matched tags outside of conserved blocks."""
    return 1 - F.try_divide(conserved.cast("double"), matched.cast("double"))


def composite(ani: Column, sdi_: Column, structure: float = 0.3) -> Column:
    return ani * (1 - structure * sdi_)
