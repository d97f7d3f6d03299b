"""Number formats and labels of report cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(x: Column, digits: int = 1) -> Column:
    return F.when(x.isNull(), "").otherwise(F.concat(F.format_string(f"%.{digits}f", x * 100), F.lit("%")))


def thousands(x: Column) -> Column:
    return F.when(x.isNull(), "").otherwise(F.format_number(x.cast("double"), 0))


def fixed(x: Column, digits: int) -> Column:
    return F.when(x.isNull(), "").otherwise(F.format_string(f"%.{digits}f", x.cast("double")))


def scientific(x: Column, digits: int = 2) -> Column:
    """Mantissa and exponent, as 2.37e-6; the exponent has no padding."""
    power = F.floor(F.log10(F.abs(x)))
    return F.when(x.isNull(), "").when(x == 0, "0").otherwise(F.concat(F.format_string(f"%.{digits}f", x / F.pow(F.lit(10.0), power)), F.lit("e"), power.cast("string")))


def interval_cell(mean: Column, low: Column, high: Column, digits: int = 4) -> Column:
    """``mean [low, high]``; the mean alone where the interval has no width or is missing."""
    f = lambda x: F.format_string(f"%.{digits}f", x)
    return F.when(mean.isNull(), "").when(low.isNull() | (low == high), f(mean)).otherwise(F.concat(f(mean), F.lit(" ["), f(low), F.lit(", "), f(high), F.lit("]")))


def budget_label(budget: Column) -> Column:
    return F.when(budget % 1000 == 0, F.concat((budget / 1000).cast("long").cast("string"), F.lit("k"))).otherwise(budget.cast("string"))


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


# Names of levels of geography.
NATIONAL = ("country", "nation", "national", "us", "0100000us")
DISTRICT = ("congressional_district", "district", "cd")

# Methods in the order of reports, and their labels.
METHODS = (
    ("informed_l0_refit", "L0 + refit"), ("informed_l0", "L0"), ("informed_l1", "L1"), ("random_reweight", "Random + reweight"),
    ("dense_sample", "Dense, sampled"), ("dense", "Dense"),
)


def method_label(method: Column) -> Column:
    out = method
    for key, label in METHODS:
        out = F.when(method == key, label).otherwise(out)
    return out


def method_order(method: Column) -> Column:
    """Known methods in their order, others after them."""
    out = F.lit(len(METHODS))
    for k, (key, _) in enumerate(METHODS):
        out = F.when(method == key, k).otherwise(out)
    return out


def geography_level(metadata: Column) -> Column:
    """National, state, district, or the named level itself, from a target's metadata."""
    named = F.lower(F.trim(first_non_empty(metadata["ledger_geography_level"], metadata["geography_level"], metadata["geo_level"])))
    return F.when(named.isin(*NATIONAL), "national").when(named.isin(*DISTRICT), "district").when(named.isNotNull(), named).when(
        F.nullif(metadata["state_fips"], F.lit("")).isNotNull(), "state").otherwise("national")


def reporting_family(metadata: Column, name: Column) -> Column:
    """Family for reports: named, else the part of the record id (or name) before its first dot, else role, id or unknown."""
    record = metadata["ledger_source_record_id"]
    source = first_non_empty(record, name)
    return F.coalesce(
        first_non_empty(metadata["target_family"], metadata["family"]), F.when(source.contains("."), F.nullif(F.split_part(source, F.lit("."), F.lit(1)), F.lit(""))),
        first_non_empty(metadata["target_role"], record), F.lit("unknown"))


def loss_family(metadata: Column, name: Column) -> Column:
    """Family for loss weights: named, else the record id up to its first dot (or slash), else the name up to its first slash (or dot); an id without either is the family."""
    record = F.nullif(metadata["ledger_source_record_id"], F.lit(""))
    cut = lambda x, a, b: F.when(x.contains(a), F.split_part(x, F.lit(a), F.lit(1))).when(x.contains(b), F.split_part(x, F.lit(b), F.lit(1)))
    return F.coalesce(F.nullif(metadata["family"], F.lit("")), cut(record, ".", "/"), record, cut(name, "/", "."), F.lit("unspecified"))
