"""Resource quantities in milli-units, exact."""

from pyspark.sql import Column, functions as F

# Milli-units in one unit of each suffix.
_MILLI = {
    "n": "0.000001", "u": "0.001", "m": "1", "": "1000",
    "k": "1000000", "M": "1000000000", "G": "1000000000000", "T": "1000000000000000",
    "P": "1000000000000000000", "E": "1000000000000000000000",
    "Ki": "1024000", "Mi": "1048576000", "Gi": "1073741824000", "Ti": "1099511627776000",
    "Pi": "1125899906842624000", "Ei": "1152921504606846976000",
}
# Units whose milli-units times a number of six digits fit a machine word.
_SMALL = ("Gi", "G", "Mi", "M", "Ki", "k", "", "m")
_SHORT = "^[0-9]{1,6}(m|k|[KMG]i|[MG])?$"
_UNIT = "(n|u|m|k|[KMGTPE]i?)$"
_KIND = "decimal(38,6)"


def milli(col: Column) -> Column:
    """Milli-units with their parts, so that sums are exact; null for text that is no quantity or
    has more digits than any real amount. An exponent is written in place of a unit."""
    unit = F.regexp_extract(col, _UNIT, 1)
    number = F.left(col, F.length(col) - F.length(unit))
    plain = F.when(F.rlike(number, F.lit("^[-+.0-9eE]+$")), number)  # digits of other scripts are none
    scale = F.lit(None).cast("decimal(28,6)")
    for suffix, per_unit in _MILLI.items():
        scale = F.when(unit == suffix, F.lit(per_unit).cast("decimal(28,6)")).otherwise(scale)
    exact = F.try_multiply(plain.try_cast("decimal(24,9)"), scale).try_cast(_KIND)
    # Whole numbers of a few digits, nearly all there are, are multiplied as machine words.
    factor = F.lit(None).cast("bigint")
    for suffix in _SMALL:
        factor = F.when(unit == suffix, F.lit(int(_MILLI[suffix]))).otherwise(factor)
    short = F.rlike(col, F.lit(_SHORT))
    return F.when(short, (F.left(col, F.length(col) - F.length(unit)).try_cast("bigint") * factor).cast(_KIND)).otherwise(exact)
