"""The rules for numerals, symbols, amounts and changes as functions of SQL, for those who work in SQL alone.

They are SQL-defined, so Spark puts their bodies into the plan: no Python runs, and they cost what the columns of the other modules cost.
"""

from pyspark.sql import SparkSession

# Name and arguments, result, body. The bodies follow text.decimal_from_ptbr, numbers.to_number, text.quote_symbol, text.brl,
# numbers.percent_over and text.asset_case; the tests hold them against those.
FUNCTIONS = (
    ("ptbr_decimal(t STRING)", "STRING", """
        CASE WHEN contains(trim(t), ',') THEN replace(replace(trim(t), '.', ''), ',', '.') WHEN trim(t) <> '' THEN trim(t) END"""),
    ("lenient_number(t STRING)", "DOUBLE", r"""
        CASE WHEN rlike(t, '^[\\x00-\\x20\\x7F]*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[\\x00-\\x20\\x7F]*$')
             THEN try_cast(CASE WHEN contains(t, chr(127)) THEN regexp_replace(t, '^[\\x00-\\x20\\x7F]+|[\\x00-\\x20\\x7F]+$', '') ELSE t END AS DOUBLE) END"""),
    ("asset_name(asset STRING, asset_class STRING)", "STRING", "CASE WHEN lower(asset_class) = 'stock' THEN upper(asset) ELSE lower(asset) END"),
    ("market_symbol(ticker STRING)", "STRING", "CASE WHEN contains(ticker, '.') THEN ticker ELSE concat(ticker, '.SA') END"),
    ("brl(amount DOUBLE)", "STRING", "concat('R$ ', translate(format_number(amount, 2), ',.', '.,'))"),
    ("percent_over(amount DECIMAL(38,10), base DECIMAL(38,10))", "DOUBLE", """
        coalesce(CAST(round(try_divide(try_cast((amount - base) * 100 AS DECIMAL(30,14)), try_cast(base AS DECIMAL(20,10))), 2) AS DOUBLE),
                 round(try_divide(CAST(amount - base AS DOUBLE) * 100, CAST(base AS DOUBLE)), 2))"""),
)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session, until it ends. Returns their names."""
    for signature, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")
    return [signature.partition("(")[0] for signature, _, _ in FUNCTIONS]
