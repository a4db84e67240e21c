"""Column functions for codes and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadflow.errors import PipelineError


def norm_code(code: Column, width: int) -> Column:
    """Digits padded to `width`; '', 'nan', 'None' and anything but digits (a trailing .0 aside) is null; longer codes raise."""
    digits = F.regexp_extract(F.trim(code.cast("string")), r"^([0-9]+)(?:\.0)?$", 1)
    return F.when(F.length(digits) > width, F.raise_error(F.concat(F.lit(f"code longer than {width}: "), digits)).cast("string")).when(digits != "", F.lpad(digits, width, "0"))


def compose_code(state: Column, unit: Column) -> Column:
    return F.concat(norm_code(state, 2), norm_code(unit, 3))


def canonical_state(state: Column) -> Column:
    """A wider numeric state field ("007", "7.0") as two digits; what is no number is null, a number that is not a whole one of 0 to 99 raises."""
    number = F.trim(state).try_cast("double")
    whole = (number == F.floor(number)) & number.between(0, 99)
    return F.when(number.isNotNull() & ~F.isnan(number), F.when(whole, F.lpad(number.cast("int").cast("string"), 2, "0")).otherwise(F.raise_error(F.concat(F.lit("not a state: "), state)).cast("string")))


def to_number(value: Column) -> Column:
    return F.trim(value).try_cast("double")


def state_of(code: Column) -> Column:
    return F.substring(code, 1, 2)


def level_sq_log(name: str) -> list[Column]:
    x, log = F.col(name), F.when(F.col(name) > 0, F.ln(name))
    return [x, (x * x).alias(f"{name}_sq"), log.alias(f"log_{name}"), (log * log).alias(f"log_{name}_sq")]


#: Units that convert by a factor and an offset: (from, to) to (factor, offset); fixed values.
CONVERSIONS = {("F", "C"): (1 / 1.8, -32 / 1.8), ("C", "F"): (1.8, 32.0), ("K", "F"): (1.8, -459.67), ("K", "C"): (1.0, -273.15), ("m", "mm"): (1000.0, 0.0), ("thousand", "one"): (1e3, 0.0), ("million", "one"): (1e6, 0.0)}


def unit_convert(value: Column, given: str, wanted: str) -> Column:
    if given == wanted:
        return value
    if (given, wanted) not in CONVERSIONS:
        raise PipelineError(f"no conversion from {given} to {wanted}")
    factor, offset = CONVERSIONS[given, wanted]
    return value * factor + offset


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def deflate_ppp(nominal: Column, deflator: Column, ppp: Column, is_base_year: Column) -> Column:
    """Nominal units at base-year prices over purchasing power; only the base year may lack a deflator."""
    factor = F.when(deflator.isNotNull(), deflator).when(is_base_year, F.lit(1.0)).otherwise(F.raise_error(F.lit("no deflator")).cast("double"))
    return nominal * factor / F.coalesce(ppp, F.raise_error(F.lit("no purchasing power parity")).cast("double"))


def non_negative(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def from_log1p(value: Column) -> Column:
    """A prediction in the space of log(1 + y) as a flow that is not below 0."""
    return non_negative(F.expm1(value))


def assert_code_valid(df: DataFrame, code: str, width: int = 5) -> DataFrame:
    """df, if the code is text of `width` characters in every row; one pass over the column."""
    if dict(df.dtypes)[code] != "string":
        raise PipelineError(f"{code} is not text")
    wrong = df.agg(F.count_if(F.col(code).isNull()).alias("nulls"), F.count_if(F.length(code) != width).alias("widths")).head()
    if wrong["nulls"] or wrong["widths"]:
        raise PipelineError(f"{code}: {wrong['nulls']} nulls, {wrong['widths']} not of {width} characters")
    return df


def rename_final(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """All renames in one place; a name that is not there, or would be there twice, raises."""
    lacking = sorted(names.keys() - set(df.columns))
    after = [names.get(c, c) for c in df.columns]
    if lacking or len(set(after)) < len(after):
        raise PipelineError(f"cannot rename: {lacking or 'two columns of one name'}")
    return df.withColumnsRenamed(names)


def suffix_columns(df: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keys else f"{c}{suffix}") for c in df.columns])


def stamp_constants(df: DataFrame, **values: object) -> DataFrame:
    """Provenance (source, vintage, period) as columns with one value."""
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def film_gate(df: DataFrame, parameters: DataFrame, role: str, columns: list[str]) -> DataFrame:
    """(1 + gamma) * x + beta on these columns; parameters has one row (role, column, gamma, beta) for each role and column."""
    wide = parameters.groupBy(role).agg(*[F.max(F.when(F.col("column") == c, F.col(p))).alias(f"_{p}_{c}") for c in columns for p in ("gamma", "beta")])
    gated = {c: (1 + F.coalesce(f"_gamma_{c}", F.lit(0.0))) * F.col(c) + F.coalesce(f"_beta_{c}", F.lit(0.0)) for c in columns}
    return df.join(F.broadcast(wide), role, "left").withColumns(gated).select(df.columns)
