"""Table contracts and the fixed labels that appear as data values."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Labels that are part of the data.
ALL = "ALL"
SCOPE_HOME = "HOME"
SCOPE_INSTITUTION = "INSTITUICAO"
METRIC_TOTAL = "valor_total"
METRIC_ANNUAL = "valor_total_anual"
EXPOSURE_ABROAD = "internacional"
EXPOSURE_LOCAL = "nacional"
CLASS_STOCK = "stock"

# Month labels January to December (the last one really is "Dec").
MONTH_LABELS = ("Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dec")

# Listed assets that count as exposure abroad.
ASSETS_ABROAD = (
    "BERK34", "IVVB11", "AAPL34", "MSFT34", "NVDC34",
    "GOGL34", "AMZO34", "TSLA34", "META34", "MELI34",
)

# Money that has been rounded to cents. Sums of it are exact; wide enough for any line that is mistyped.
MONEY = T.DecimalType(38, 2)


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()
_DATE, _TS = T.DateType(), T.TimestampType()

FORM = _table(
    ("submitted_at", _S), ("as_of_date", _S), ("institution", _S), ("statement", _S), ("contribution", _S),
)

SNAPSHOT = _table(
    ("submitted_at", _TS), ("as_of_date", _DATE), ("year", _I), ("month_num", _I), ("month_label", _S),
    ("institution", _S), ("line", _S), ("asset_class", _S), ("asset", _S), ("quantity", _D),
    ("avg_price", _D), ("current_price", _D), ("market_value", MONEY), ("contribution", _D), ("exposure", _S),
)

QUOTES = T.StructType([
    T.StructField("price_date", _DATE, False),
    T.StructField("ticker", _S, False),
    T.StructField("close", _D, True),
    T.StructField("fetched_at", _TS, False),
])

PRICES = _table(
    ("price_date", _DATE), ("ticker", _S), ("close", _D), ("fetched_at", _TS), ("as_of_date", _DATE),
)

HOME_LINE = _table(
    ("as_of_date", _DATE), ("year", _I), ("month_label", _S), ("scope", _S), ("institution", _S),
    ("metric", _S), ("market_value", _D), ("pct_change", _D),
)

HOME_ANNUAL = _table(
    ("as_of_date", _DATE), ("year", _I), ("institution", _S), ("market_value", _D), ("scope", _S),
    ("metric", _S), ("pct_change", _D),
)

ALLOC_EXPOSURE = _table(("as_of_date", _DATE), ("exposure", _S), ("market_value", _D), ("institution", _S))
ALLOC_CLASS = _table(("as_of_date", _DATE), ("asset_class", _S), ("market_value", _D), ("institution", _S))

ASSET_LINE = _table(
    ("as_of_date", _DATE), ("year", _I), ("month_label", _S), ("institution", _S), ("asset", _S),
    ("market_value", _D), ("metric", _S), ("scope", _S), ("pct_change", _D),
)

ASSET_LABEL = _table(
    ("as_of_date", _DATE), ("year", _I), ("month_label", _S), ("institution", _S), ("asset", _S),
    ("quantity", _D), ("avg_price", _D), ("entry_cost", _D), ("current_price", _D), ("market_value", _D),
    ("pct_change", _D), ("metric", _S), ("scope", _S),
)

ASSET_ANNUAL = _table(
    ("as_of_date", _DATE), ("year", _I), ("institution", _S), ("asset", _S), ("market_value", _D),
    ("metric", _S), ("scope", _S), ("pct_change", _D),
)

# The report tables under the names they are stored by.
REPORTS = {
    "home_line": HOME_LINE,
    "home_latest": HOME_LINE,
    "home_annual": HOME_ANNUAL,
    "alloc_exposure": ALLOC_EXPOSURE,
    "alloc_class": ALLOC_CLASS,
    "asset_line": ASSET_LINE,
    "asset_label": ASSET_LABEL,
    "asset_annual": ASSET_ANNUAL,
}

# Our column name -> the header used in the Portuguese CSV files.
CSV_HEADERS = {
    "submitted_at": "timestamp",
    "as_of_date": "data_apuracao",
    "year": "ano",
    "month_num": "mes_num",
    "month_label": "mes",
    "institution": "instituicao_fin",
    "statement": "resumo",
    "line": "resumo",
    "asset_class": "tipo",
    "asset": "nome",
    "quantity": "qtd",
    "avg_price": "preco_medio",
    "current_price": "preco_atual",
    "market_value": "valor_total",
    "contribution": "aporte",
    "exposure": "exposicao",
    "pct_change": "variacao_percentual",
    "scope": "tipo_escopo",
    "metric": "nome_metrica",
    "entry_cost": "preco_entrada",
    "price_date": "data_preco",
    "fetched_at": "extracted_at",
}


def with_csv_headers(df: DataFrame) -> DataFrame:
    """The same rows under the Portuguese CSV headers."""
    return df.withColumnsRenamed({ours: theirs for ours, theirs in CSV_HEADERS.items() if ours in df.columns})


def require_columns(df: DataFrame, required: list[str], consumer: str) -> None:
    """Raise ``ValueError`` naming what ``consumer`` needs and ``df`` lacks. Reads metadata only."""
    have = df.columns
    lacking = [name for name in required if name not in set(have)]
    if lacking:
        raise ValueError(f"{consumer} needs columns {lacking}; the frame has {have}")
