"""Text expressions: pt-BR numerals, case rules, symbols and display labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from portfold.schemas import ASSETS_ABROAD, CLASS_STOCK, EXPOSURE_ABROAD, EXPOSURE_LOCAL


def decimal_from_ptbr(text: Column) -> Column:
    """Turn pt-BR numerals into plain ones, leaving other text as it is.

    Blank becomes null. With a comma present, dots are thousands marks and the comma is the decimal mark
    (``24.000,00`` -> ``24000.00``). Without a comma a dot already is the decimal mark, so ``7.000`` is
    seven. The rule looks at nothing but the comma, so it also rewrites names such as ``Tesouro, IPCA 2.0``.
    Only spaces are trimmed, not tabs.
    """
    plain = F.trim(text)
    dotted = F.replace(F.replace(plain, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(plain.contains(","), dotted).when(plain != "", plain)


def asset_case(asset: Column, asset_class: Column) -> Column:
    """Upper case for stocks (``asset_class`` already lower case), lower case for everything else."""
    return F.when(asset_class == CLASS_STOCK, F.upper(asset)).otherwise(F.lower(asset))


def exposure_of(asset: Column, abroad: tuple[str, ...] = ASSETS_ABROAD) -> Column:
    """Exposure label of an asset. Case matters, and null counts as local."""
    return F.when(asset.isin(*abroad), EXPOSURE_ABROAD).otherwise(EXPOSURE_LOCAL)


def quote_symbol(ticker: Column, suffix: str = ".SA") -> Column:
    """The symbol a ticker is quoted under: as it is when it names its market, else with ``suffix``."""
    return F.when(ticker.contains("."), ticker).otherwise(F.concat(ticker, F.lit(suffix)))


def brl(amount: Column) -> Column:
    """``1234.5`` -> ``R$ 1.234,50``. The amount may be a number or text with ``,`` or ``.`` as decimal mark."""
    number = F.translate(amount.cast("string"), ",", ".").try_cast("double")
    return F.concat(F.lit("R$ "), F.translate(F.format_number(number, 2), ",.", ".,"))


def titled_brl(title: Column, amount: Column) -> Column:
    """``XP - R$ 1.234,50``."""
    return F.concat(title, F.lit(" - "), brl(amount))


def amount_label(amount: Column) -> Column:
    """Chart label of an amount: ``R$1,234``."""
    return F.concat(F.lit("R$"), F.format_number(amount, 0))


def percent_label(percent: Column) -> Column:
    """Chart label of a percentage: ``12.34%``."""
    return F.concat(F.format_number(percent, 2), F.lit("%"))


def month_title(yyyymm: Column) -> Column:
    """``202603`` -> ``03/2026``."""
    return F.concat(F.substring(yyyymm, 5, 2), F.lit("/"), F.substring(yyyymm, 1, 4))
