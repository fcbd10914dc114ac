"""Number expressions.

Money is summed and divided as decimals, so results do not depend on the order in which partial sums meet
and a half cent always rounds the same way. Columns that arrive as doubles are widened to ``WIDE`` first.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDE = T.DecimalType(38, 10)

# A dividend and a divisor whose quotient keeps twelve digits behind the point.
_NUMERATOR = T.DecimalType(30, 14)
_DENOMINATOR = T.DecimalType(20, 10)

# Pairs of factors whose product is exact in ``PRODUCT``: many decimals on one side, many digits on the other, or eight and eight.
PRODUCT = T.DecimalType(38, 16)
_PLAIN = T.DecimalType(17, 4)
_FACTORS = (
    (T.DecimalType(20, 12), T.DecimalType(17, 4)),
    (T.DecimalType(17, 4), T.DecimalType(20, 12)),
    (T.DecimalType(18, 8), T.DecimalType(19, 8)),
)

# What Spark's own casts strip from both ends of a text: white space and control characters.
_BLANK = "".join(map(chr, [*range(0x21), 0x7F]))

# Plain decimal or scientific notation between blanks; keeps out NaN, Infinity and Java suffixes such as "5d".
_NUMERAL = r"^[\x00-\x20\x7F]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[\x00-\x20\x7F]*$"


def exact(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a decimal: unchanged when it is one, else widened; null beyond 28 digits before the point."""
    if isinstance(df.schema[name].dataType, T.DecimalType):
        return F.col(name)
    return F.col(name).try_cast(WIDE)


def bare(text: Column) -> Column:
    """Text without the blanks that a cast ignores: spaces, tabs, line ends and other control characters."""
    return F.btrim(text, F.lit(_BLANK))


def castable(text: Column) -> Column:
    """Text for a cast to a number, a date or a moment, which strips blanks itself, but not all of them the character 7F.

    ``bare`` looks its blanks up for every character, which costs more than the cast.
    """
    return F.when(text.contains("\x7f"), bare(text)).otherwise(text)


def to_number(text: Column) -> Column:
    """Text to double; anything that is not a numeral becomes null."""
    return F.when(text.rlike(_NUMERAL), castable(text).try_cast("double"))


def _kept(value: Column, kind: T.DecimalType) -> Column:
    """The value as ``kind`` if none of its fifteen leading digits is lost, else null.

    So 1 - 0.07, which a double holds as 0.9299999999999999, counts as 0.93.
    """
    cast, double = value.try_cast(kind), value.cast("double")
    return F.when(F.abs(cast.cast("double") - double) <= F.abs(double) * F.lit(1e-15), cast)


def _apart(value: Column) -> Column:
    """The value, computed outside the generated code and only where it is asked for: keeps rare cases out of the hot method."""
    return F.get(F.transform(F.array(F.lit(0)), lambda _: value), F.lit(0))


def exact_product(left: Column, right: Column) -> Column:
    """Product as ``PRODUCT`` with all its digits, or null where the factors have too many.

    Amounts with four decimals, as nearly all are, need one pair of decimals; the others are tried apart.
    """
    plain = (_kept(left, _PLAIN) * _kept(right, _PLAIN)).try_cast(PRODUCT)
    return F.coalesce(plain, _apart(F.coalesce(*[_kept(left, a) * _kept(right, b) for a, b in _FACTORS])))


def double_product(left: Column, right: Column) -> Column:
    return left.cast("double") * right.cast("double")


def product(left: Column, right: Column, digits: int, kind: T.DecimalType) -> Column:
    """Product rounded half up to ``digits``: exact where the digits allow, else that of the doubles; null beyond ``kind``."""
    return F.coalesce(
        F.round(exact_product(left, right), digits).try_cast(kind),
        _apart(F.round(double_product(left, right), digits).try_cast(kind)),
    )


def ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """Rounded quotient as double; null when either side is null or the denominator is zero.

    In decimals if both sides keep all their digits there, else in doubles.
    """
    in_decimals = F.try_divide(_kept(numerator, _NUMERATOR), _kept(denominator, _DENOMINATOR))
    in_doubles = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(F.round(in_decimals, digits).cast("double"), F.round(in_doubles, digits))


def percent_over(value: Column, base: Column, digits: int = 2) -> Column:
    """By how many percent ``value`` lies above ``base``; null without a base or with base zero."""
    return ratio((value - base) * F.lit(100), base, digits)
