"""DuckDB SQL for every registered query.

Written independently of the library: money is counted in whole cents, and quotients are rounded half up on
integers, so the expected values do not depend on floating point. Texts are built from the typed columns, so
parsing is checked against what was put into the text.
"""

from portfold.schemas import MONTH_LABELS

AS_OF = "date '2024-01-15'"
INSTITUTION = "BUILDING"

_LABELS = "[" + ", ".join(f"'{label}'" for label in MONTH_LABELS) + "]"


def _half_up(numerator: str, denominator: str, digits: int = 0) -> str:
    """Quotient of two integers, half away from zero at ``digits`` decimals; null for denominator zero."""
    n, d, scale = f"cast({numerator} as hugeint)", f"nullif(cast({denominator} as hugeint), 0)", 10**digits
    return f"(sign({n}) * sign({d}) * ((2 * abs({n}) * {scale} + abs({d})) // (2 * abs({d})))) / {scale}.0::double"


def _euros(cents: str) -> str:
    return f"({cents})::double / 100"


def _percent(now: str, before: str) -> str:
    return _half_up(f"100 * ({now} - {before})", before, 2)


def _calendar(day: str) -> str:
    return f"cast(year({day}) as integer) as year, {_LABELS}[month({day})] as month_label"


def _brl(amount: str) -> str:
    return f"'R$ ' || translate(format('{{:,.2f}}', {amount}), ',.', '.,')"


_LINES = """
    order_lines as (
        select *, cast(date_trunc('month', o_orderdate) as date) as month_start,
               cast(round(p_retailprice * 100) as bigint) as retail_cents,
               cast(round(l_extendedprice * 100) as bigint) as extended_cents,
               cast(l_quantity as bigint) as units
        from lineitem join orders on l_orderkey = o_orderkey
             join customer on o_custkey = c_custkey join part on l_partkey = p_partkey
    )"""

_POSITIONS = _LINES + f""",
    positions as (
        select month_start as as_of_date, {_calendar('month_start')}, c_mktsegment as institution,
               p_type as asset_class, p_brand as asset, units, extended_cents, retail_cents,
               retail_cents * units as cents, extended_cents * units as cost,
               case when p_brand in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5')
                    then 'internacional' else 'nacional' end as exposure,
               l_orderkey, l_linenumber, l_partkey, l_suppkey
        from order_lines
    )"""

_LOT_ORDER = """as_of_date desc, l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc,
                units desc, extended_cents desc"""

_CURRENT = _POSITIONS + f""",
    current_lots as (
        select * from positions
        qualify row_number() over (partition by institution, asset_class, asset order by {_LOT_ORDER}) = 1
    )"""

_HOME = _POSITIONS + """,
    home_totals as (
        select as_of_date, year, month_label, 'INSTITUICAO' as scope, institution, sum(cents) as cents
        from positions group by all
        union all
        select as_of_date, year, month_label, 'HOME', 'ALL', sum(cents) from positions group by 1, 2, 3
    )"""

_ASSETS = _POSITIONS + """,
    asset_totals as (
        select as_of_date, year, month_label, institution, asset, sum(cents) as cents
        from positions group by all
        union all
        select as_of_date, year, month_label, institution, 'ALL', sum(cents) from positions group by 1, 2, 3, 4
    )"""


def _change(keys: str, order: str = "as_of_date") -> str:
    """Percent change against the previous row."""
    before = f"lag(cents) over (partition by {keys} order by {order})"
    return f"{_percent('cents', before)} as pct_change"


def _newest(keys: str) -> str:
    return f"qualify row_number() over (partition by {keys} order by as_of_date desc) = 1"


_HOME_LINE = f"""
    select as_of_date, year, month_label, scope, institution, 'valor_total' as metric,
           {_euros('cents')} as market_value, {_change('institution')}
    from home_totals"""

_HOME_ANNUAL = f"""
    select as_of_date, year, institution, {_euros('cents')} as market_value, 'HOME' as scope,
           'valor_total_anual' as metric, {_change('institution')}
    from home_totals"""

_ASSET_LINE = f"""
    select as_of_date, year, month_label, institution, asset, {_euros('cents')} as market_value,
           'valor_total' as metric, 'INSTITUICAO' as scope, {_change('institution, asset')}
    from asset_totals"""

_ASSET_ANNUAL = f"""
    select as_of_date, year, institution, asset, {_euros('cents')} as market_value,
           'valor_total_anual' as metric, 'INSTITUICAO' as scope, {_change('institution, asset')}
    from asset_totals"""


def _allocation(dim: str) -> str:
    return f"""
    select as_of_date, {dim}, sum(cents) as cents, institution from current_lots group by all
    union all
    select as_of_date, {dim}, sum(cents), 'ALL' from current_lots group by 1, 2"""


def _allocated(dim: str) -> str:
    return (
        f"with {_CURRENT}, slices as ({_allocation(dim)}) "
        f"select as_of_date, {dim}, {_euros('cents')} as market_value, institution from slices"
    )


def _basis(source: str) -> str:
    return f"""
    select as_of_date, institution, asset, sum(units) as units, sum(cost) as cost, sum(cents) as cents
    from {source} group by all"""


_BASIS_COLUMNS = f"""
    b.units::double as quantity, {_half_up('b.cost', 'b.units')} / 100 as avg_price,
    {_euros('b.cost')} as entry_cost, {_half_up('b.cents', 'b.units')} / 100 as current_price"""


def _label(source: str, columns: str) -> str:
    """The newest asset totals with the cost basis of ``source``."""
    return f"""
    newest as (select * from asset_totals {_newest('institution, asset')}),
    basis as ({_basis(source)}),
    labels as (
        select n.as_of_date, n.year, n.month_label, n.institution, n.asset, {_BASIS_COLUMNS},
               {_euros('n.cents')} as market_value, {_percent('n.cents', 'b.cost')} as pct_change{columns}
        from newest n left join basis b
             on n.as_of_date = b.as_of_date and n.institution = b.institution and n.asset = b.asset
    )"""


_TAGS = ", 'valor_total' as metric, 'INSTITUICAO' as scope"

_LOT_COLUMNS = f"""
    select as_of_date, institution, asset_class, asset, exposure, units::double as quantity,
           {_euros('extended_cents')} as avg_price, {_euros('cents')} as market_value, l_orderkey, l_linenumber
    from current_lots"""

_TICKS = """
    ticks as (
        select 'T' || cast(user_id as varchar) as ticker, cast(ts as date) as price_date,
               case when event_type = 'error' then null when event_type = 'signup' then 0.0 else value end as close,
               ts as fetched_at, cast(ts as date) as as_of_date, event_id, event_type
        from events
    )"""

_HOLDINGS = """
    holdings as (
        select event_id as holding_id, 'T' || cast(user_id as varchar) as asset, cast(ts as date) as as_of_date,
               value as quantity, case when event_id % 3 = 0 then value end as current_price
        from events where event_type = 'purchase'
    )"""


def _attach(price_rows: str) -> str:
    return f"""
    with {_TICKS}, {_HOLDINGS}, prices as (select * from ticks where event_type = 'view' {price_rows})
    select h.holding_id, h.asset, h.as_of_date, h.quantity, coalesce(h.current_price, p.close) as current_price
    from holdings h left join prices p on h.asset = p.ticker and h.as_of_date = p.as_of_date"""


_MERGED = f"""
    with {_TICKS}
    select price_date, ticker, close, fetched_at, as_of_date from ticks where close > 0
    qualify row_number() over (partition by ticker, price_date order by fetched_at desc, close desc) = 1"""

# Form answers: two lines per order line, as typed columns and as text.
_STOCK = "case p_brand when 'Brand#1' then 'BERK34' when 'Brand#2' then 'ivvb11' when 'Brand#3' then 'AAPL34' else p_brand end"
_PTBR_EXTENDED = "translate(format('{:,.2f}', l_extendedprice), ',.', '.,')"
_PTBR_RETAIL = "translate(format('{:,.2f}', p_retailprice), ',.', '.,')"
_FORM = _LINES + f""",
    form_lines as (
        select *, 'Stock' as typed_class, {_STOCK} as typed_asset, units::double as quantity,
               l_extendedprice as avg_price, cast(null as double) as stated_price,
               'Stock  | ' || {_STOCK} || ' | ' || cast(units as varchar) || ' | ' || {_PTBR_EXTENDED} || ' | ' as line
        from order_lines
        union all
        select *, 'Renda Fixa', p_name, 1.0, p_retailprice, l_extendedprice,
               'Renda Fixa | ' || p_name || ' | 1 | ' || {_PTBR_RETAIL} || ' | ' || {_PTBR_EXTENDED}
        from order_lines
    )"""


def _snapshot(price_join: str, price: str) -> str:
    return f"""
    select cast(date_trunc('second', o_orderdate) as timestamp) as submitted_at, month_start as as_of_date,
           cast(year(month_start) as integer) as year, cast(month(month_start) as integer) as month_num,
           {_LABELS}[month(month_start)] as month_label, upper(c_mktsegment) as institution, line,
           lower(typed_class) as asset_class,
           case when typed_class = 'Stock' then upper(typed_asset) else lower(typed_asset) end as asset,
           quantity, avg_price, {price} as current_price,
           {_euros(f'cast(round({price} * 100) as bigint) * cast(quantity as bigint)')} as market_value,
           cast(l_linenumber as double) as contribution,
           case when typed_asset in ('BERK34', 'IVVB11', 'AAPL34', 'MSFT34', 'NVDC34', 'GOGL34', 'AMZO34', 'TSLA34',
                                     'META34', 'MELI34') then 'internacional' else 'nacional' end as exposure
    from form_lines {price_join}"""


_STOCK_QUOTES = f"""
    stock_quotes as (
        select month_start - cast(l_linenumber as integer) as price_date, upper({_STOCK}) as ticker,
               case when units = 13 then null when units = 7 then 0.0 else p_retailprice end as close,
               month_start + to_seconds(l_orderkey % 86400) as fetched_at, month_start as priced_on
        from order_lines
    ),
    history as (
        select * from stock_quotes where close > 0
        qualify row_number() over (partition by ticker, price_date order by fetched_at desc, close desc) = 1
    ),
    newest_quotes as (
        select * from history qualify row_number() over (partition by ticker, priced_on order by price_date desc) = 1
    )"""

_DOC_LINES = "doc_lines as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)"


def _pie(dim: str, institution: str, section: str) -> str:
    return f"""
    select '{section}' as section, cast(null as date) as day, {dim} as name, cast(null as varchar) as detail,
           {_euros('sum(cents)')} as value, {_half_up('100 * sum(cents)', 'sum(sum(cents)) over ()', 2)} as pct,
           cast(null as varchar) as label
    from ({_allocation(dim)}) where institution = '{institution}' group by {dim}"""


def _series(section: str, source: str, name: str, keys: str, where: str = "", label: str = "amount", last: bool = False) -> str:
    """The rows of a chart, labelled with the amount or the change, every one or the last of each series only."""
    shown = "'R$' || format('{:,.0f}', value)" if label == "amount" else "format('{:,.2f}', pct) || '%'"
    if last:
        shown = f"case when day = max(day) over (partition by name) then coalesce({shown}, '') else '' end"
    return f"""
    select '{section}', day, name, null, value, pct, {shown}
    from (select as_of_date as day, {name} as name, {_euros('cents')} as value, {_change(keys)[:-len(" as pct_change")]} as pct
          from {source} {where})"""


def _axes(source: str, keys: str, where: str = "") -> str:
    rows = f"(select {_euros('cents')} as v, {_change(keys)} from {source} {where})"
    pad = "case when max({0}) = min({0}) then 1 else (max({0}) - min({0})) * 0.15::double end"
    return f"""
    select 'line_axis', null, null, null, max(v) + {pad.format('v')}, 0.0::double, null from {rows}
    union all
    select 'line_change_axis', null, null, null, max(pct_change) + {pad.format('pct_change')},
           min(pct_change) - {pad.format('pct_change')}, null from {rows}"""


def _all_charts(source: str, name: str, keys: str, where: str = "") -> str:
    return " union all ".join([
        _series("line", source, name, keys, where, last=True), _series("line_change", source, name, keys, where, "change", True),
        _series("bars", source, name, keys, where), _series("bars_change", source, name, keys, where, "change"),
        _axes(source, keys, where),
    ])


_HOME_NEWEST = f"home_newest as (select * from home_totals {_newest('institution')})"

ORACLES: dict[str, str] = {
    "scan_bronze_csv": f"""
        with {_FORM}
        select strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') as submitted_at,
               strftime(month_start, '%d/%m/%Y') as as_of_date,
               upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as institution, line,
               cast(l_linenumber as varchar) as contribution
        from form_lines""",
    "scan_snapshot": f"with {_FORM} {_snapshot('', 'stated_price')}",
    "list_months": "select distinct strftime(o_orderdate, '%Y%m') as yyyymm from orders join lineitem on l_orderkey = o_orderkey",
    "read_month": f"with {_HOME}, line as ({_HOME_LINE}) select * from line where strftime(as_of_date, '%Y%m') = '199803'",
    "resolve_month": """
        with months as (select distinct strftime(o_orderdate, '%Y%m') as yyyymm from orders)
        select '199803' as asked, coalesce(max(yyyymm) filter (yyyymm = '199803'), max(yyyymm)) as yyyymm from months
        union all select '190001', coalesce(max(yyyymm) filter (yyyymm = '190001'), max(yyyymm)) from months
        union all select 'none', max(yyyymm) from months""",
    "price_window": f"""
        with {_TICKS} select event_id, ticker, price_date, close from ticks
        where price_date >= {AS_OF} - 7 and price_date < {AS_OF}""",
    "sql_latest_positions": f"with {_CURRENT} {_LOT_COLUMNS}",
    "sink_full_refresh": f"""
        with {_POSITIONS} select as_of_date, institution, {_euros('sum(cents)')} as market_value
        from positions group by as_of_date, institution""",
    "sink_month_overwrite": f"""
        with {_HOME}, line as ({_HOME_LINE})
        select as_of_date, year, month_label, scope, institution, metric,
               case when as_of_date < date '1998-01-01' then market_value * 2 else market_value end as market_value,
               pct_change,
               strftime(max(as_of_date) over (partition by as_of_date < date '1998-01-01'), '%Y%m') as yyyymm
        from line""",
    "run_label": f"with {_POSITIONS} select strftime(max(as_of_date), '%Y%m') as yyyymm from positions",
    "explode_lines": f"with {_DOC_LINES} select doc_id, line from doc_lines",
    "parse_statement": f"""
        with {_FORM}
        select strftime(month_start, '%d/%m/%Y') as as_of_date,
               upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as institution, typed_class as asset_class,
               typed_asset as asset, quantity, avg_price, stated_price as current_price
        from form_lines""",
    "normalize_decimal": f"""
        with {_DOC_LINES}, bare as (select doc_id, nullif(trim(line, ' '), '') as line from doc_lines)
        select doc_id, case when contains(line, ',') then replace(replace(line, '.', ''), ',', '.') else line end as plain
        from bare""",
    "lenient_casts": r"""
        with words as (
            select 'document' as source, unnest(regexp_split_to_array(text, '[ \n|]')) as word from documents
            union all select 'l_orderkey', cast(l_orderkey as varchar) from lineitem
            union all select 'l_extendedprice', cast(l_extendedprice as varchar) from lineitem
            union all select 'l_returnflag', l_returnflag from lineitem
        ),
        numbered as (
            select source, case when regexp_full_match(regexp_replace(word, '^[\x00-\x20\x7f]+|[\x00-\x20\x7f]+$', '', 'g'), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
                                then try_cast(regexp_replace(word, '^[\x00-\x20\x7f]+|[\x00-\x20\x7f]+$', '', 'g') as double) end as number
            from words
        )
        select source, count(*) as words, count(number) as numbers, min(number) as smallest, max(number) as largest
        from numbered group by source""",
    "parse_dates": """
        select o_orderkey,
               case when o_orderkey % 10 <> 0 then cast(o_orderdate as date) end as form_day,
               case when o_orderkey % 10 <> 0 then cast(date_trunc('second', o_orderdate) as timestamp) end as form_moment,
               case when o_orderkey % 10 = 0 then cast(o_orderdate as date) end as iso_day
        from orders""",
    "calendar_columns": f"""
        select o_orderkey, cast(o_orderdate as date) as as_of_date, {_calendar('o_orderdate')},
               cast(month(o_orderdate) as integer) as month_num from orders""",
    "conform_schema": """
        select cast(l_shipdate as date) as l_shipdate, l_orderkey, l_linenumber, cast(null as double) as l_returnflag,
               l_linestatus, cast(trunc(l_quantity) as integer) as l_quantity, l_extendedprice
        from lineitem""",
    "normalize_case": f"""
        with {_LINES}
        select l_orderkey, l_linenumber, case when l_returnflag = 'A' then 'stock' else lower(p_type) end as asset_class,
               upper(c_mktsegment) as institution,
               case when l_returnflag = 'A' then upper(p_brand) else lower(p_brand) end as asset
        from order_lines""",
    "classify_exposure": """
        select p_partkey, p_brand as asset,
               case when p_brand in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5')
                    then 'internacional' else 'nacional' end as exposure
        from part""",
    "symbol_suffix": """
        select p_partkey, p_brand || case when p_size % 5 = 0 then '.US' else '' end as ticker,
               p_brand || case when p_size % 5 = 0 then '.US' else '.SA' end as symbol
        from part""",
    "market_value": f"""
        select l_orderkey, l_linenumber, l_extendedprice as current_price, 1.0::double - l_discount as quantity,
               {_half_up('cast(round(l_extendedprice * 100) as bigint) * (100 - cast(round(l_discount * 100) as bigint))', '100')}
                   / 100 as market_value
        from lineitem""",
    "format_brl": f"""
        select o_orderkey, {_brl('o_totalprice')} as from_number, {_brl('o_totalprice')} as from_text,
               o_orderpriority || ' - ' || {_brl('o_totalprice')} as titled
        from orders""",
    "format_labels": f"""
        with {_HOME}, line as ({_HOME_LINE})
        select as_of_date, institution, 'R$' || format('{{:,.0f}}', market_value) as amount,
               case when pct_change is not null then format('{{:,.2f}}', pct_change) || '%' end as percent
        from line""",
    "format_month": """
        select o_orderkey, strftime(o_orderdate, '%Y%m') as yyyymm, strftime(o_orderdate, '%m/%Y') as title from orders""",
    "total_by_institution": f"""
        with {_HOME} select as_of_date, year, month_label, institution, {_euros('cents')} as market_value
        from home_totals where scope = 'INSTITUICAO'""",
    "total_all": f"""
        with {_HOME} select as_of_date, year, month_label, institution, {_euros('cents')} as market_value
        from home_totals where scope = 'HOME'""",
    "scoped_totals": f"""
        with {_HOME} select as_of_date, year, month_label, institution, {_euros('cents')} as market_value, scope
        from home_totals""",
    "scoped_totals_union": f"""
        with {_HOME} select as_of_date, year, month_label, institution, {_euros('cents')} as market_value
        from home_totals""",
    "total_by_asset": f"""
        with {_ASSETS} select as_of_date, year, month_label, institution, asset, {_euros('cents')} as market_value
        from asset_totals where asset <> 'ALL'""",
    "asset_scoped_totals": f"""
        with {_ASSETS} select as_of_date, year, month_label, institution, asset, {_euros('cents')} as market_value
        from asset_totals""",
    "annual_totals": f"""
        with {_HOME} select as_of_date, year, institution, {_euros('sum(cents)')} as market_value
        from home_totals group by as_of_date, year, institution""",
    "annual_totals_by_asset": f"""
        with {_ASSETS} select as_of_date, year, institution, asset, {_euros('sum(cents)')} as market_value
        from asset_totals group by as_of_date, year, institution, asset""",
    "allocation_by_exposure": _allocated("exposure"),
    "allocation_by_class": _allocated("asset_class"),
    "cost_basis": f"""
        with {_POSITIONS}, basis as ({_basis('positions')})
        select as_of_date, institution, asset, {_BASIS_COLUMNS} from basis b""",
    "asset_label": f"with {_ASSETS}, {_label('positions', '')} select * from labels",
    "pct_change_institution": f"""
        with {_HOME} select as_of_date, institution, {_euros('cents')} as market_value, {_change('institution')}
        from home_totals""",
    "pct_change_asset": f"""
        with {_ASSETS}
        select as_of_date, institution, asset, {_euros('cents')} as market_value, {_change('institution, asset')}
        from asset_totals""",
    "pct_change_annual": f"""
        with {_HOME}, yearly as (select * from home_totals {_newest('institution, year')})
        select as_of_date, year, institution, {_euros('cents')} as market_value, {_change('institution')} from yearly""",
    "pct_change_annual_asset": f"""
        with {_ASSETS}, yearly as (select * from asset_totals {_newest('institution, asset, year')})
        select as_of_date, year, institution, asset, {_euros('cents')} as market_value, {_change('institution, asset')}
        from yearly""",
    "latest_totals": f"""
        with {_HOME} select as_of_date, year, month_label, institution, {_euros('cents')} as market_value
        from home_totals {_newest('institution')}""",
    "latest_asset_totals": f"""
        with {_ASSETS} select as_of_date, year, month_label, institution, asset, {_euros('cents')} as market_value
        from asset_totals {_newest('institution, asset')}""",
    "current_positions": f"with {_CURRENT} {_LOT_COLUMNS}",
    "latest_valid_close": f"""
        with {_TICKS} select price_date, ticker, close, fetched_at, as_of_date from ticks where close > 0
        qualify row_number() over (partition by ticker order by price_date desc, fetched_at desc, event_id desc) = 1""",
    "series_last_label": f"""
        with {_HOME}
        select institution, as_of_date, {_euros('cents')} as market_value,
               case when as_of_date = max(as_of_date) over (partition by institution)
                    then 'R$' || format('{{:,.0f}}', {_euros('cents')}) else '' end as label
        from home_totals""",
    "allocation_share": f"""
        with {_CURRENT}, slices as (
            select institution, asset_class, sum(cents) as cents from ({_allocation('asset_class')}) group by all
        )
        select institution, asset_class, {_euros('cents')} as market_value,
               {_half_up('100 * cents', 'sum(cents) over (partition by institution)', 2)} as share_pct
        from slices""",
    "valid_closes": f"with {_TICKS} select event_id, ticker, price_date, close from ticks where close > 0",
    "tracked_tickers": "select distinct p_brand as ticker from lineitem join part on l_partkey = p_partkey where p_type = 'PROMO' and p_brand <> ''",
    "prices_for_tracked": f"""
        with {_TICKS}, {_HOLDINGS} select event_id, ticker, price_date, close from ticks
        where ticker in (select asset from holdings)""",
    "attach_price": _attach(
        "qualify row_number() over (partition by ticker, as_of_date order by price_date desc, fetched_at desc, close desc) = 1"
    ),
    "attach_price_fanout": _attach(""),
    "merge_prices": _MERGED,
    "price_history_store": _MERGED,
    "price_refresh": f"""
        with {_TICKS}, {_HOLDINGS} select price_date, ticker, close, fetched_at, {AS_OF} as as_of_date from ticks
        where close > 0 and price_date >= {AS_OF} - 7 and price_date < {AS_OF}
              and ticker in (select asset from holdings)
        qualify row_number() over (partition by ticker order by price_date desc, fetched_at desc, close desc) = 1""",
    "mart_snapshot": f"with {_FORM}, {_STOCK_QUOTES} " + _snapshot(
        f"left join newest_quotes q on typed_class = 'Stock' and q.ticker = upper({_STOCK}) and q.priced_on = month_start",
        "coalesce(stated_price, q.close)",
    ),
    "mart_home_line": f"with {_HOME} {_HOME_LINE}",
    "mart_home_latest": f"with {_HOME}, line as ({_HOME_LINE}) select * from line {_newest('institution')}",
    "mart_home_annual": f"with {_HOME} {_HOME_ANNUAL}",
    "mart_alloc_exposure": _allocated("exposure"),
    "mart_alloc_class": _allocated("asset_class"),
    "mart_asset_line": f"with {_ASSETS} {_ASSET_LINE}",
    "mart_asset_label": "",
    "mart_asset_annual": f"with {_ASSETS} {_ASSET_ANNUAL}",
    "page_home": "",
    "page_institution": "",
    "scope_rows": f"""
        with {_ASSETS}, line as ({_ASSET_LINE}) select * from line where institution = '{INSTITUTION}' and asset <> 'ALL'""",
    "holdings_table": "",
    "headline_total": f"""
        with {_HOME}, {_HOME_NEWEST}
        select {_euros('cents')} as market_value, {_brl(_euros('cents'))} as label from home_newest where scope = 'HOME'""",
    "axis_range": f"""
        with {_HOME}, line as ({_HOME_LINE})
        select 'amount' as kind, 0.0::double as axis_low,
               max(market_value) + case when max(market_value) = min(market_value) then 1
                   else (max(market_value) - min(market_value)) * 0.15::double end as axis_high
        from line
        union all
        select 'percent', min(pct_change) - case when max(pct_change) = min(pct_change) then 1
                   else (max(pct_change) - min(pct_change)) * 0.15::double end,
               max(pct_change) + case when max(pct_change) = min(pct_change) then 1
                   else (max(pct_change) - min(pct_change)) * 0.15::double end
        from line""",
    "series_names": f"with {_HOME} select distinct institution from home_totals where institution is not null",
}

_DIGITS = """
    digits as (
        select *, cast(l_orderkey * 7919 % 1000000000000 as hugeint) as price_units,
               cast(l_quantity as hugeint) * 10000000000 + l_linenumber as many
        from lineitem
    )"""

ORACLES["market_value_digits"] = f"""
    with {_DIGITS}
    select l_orderkey, l_linenumber,
           case when l_orderkey % 1009 = 0 then 1e30::double else price_units::double / 1e12::double end as current_price,
           many::double as quantity,
           case when l_orderkey % 1009 <> 0 then {_half_up('price_units * many', '10000000000')} / 100 end as market_value
    from digits"""

ORACLES["cost_basis_digits"] = f"""
    with {_DIGITS}, sums as (
        select l_returnflag, l_linestatus, sum(many) as many, sum(price_units * many) as cost,
               sum(cast(round(l_extendedprice * 100) as hugeint)) as cents
        from digits group by all
    )
    select l_returnflag, l_linestatus, many::double as quantity, {_half_up('cost', 'many * 1000000000000', 2)} as avg_price,
           {_half_up('cost', '10000000000')} / 100 as entry_cost, {_half_up('cents', 'many')} / 100 as current_price
    from sums"""

ORACLES["scan_snapshot_quoted"] = r"""
    select p_brand as institution,
           p_name || ' say "hi", ok \ or "no"' || chr(10) || 'second, line' || cast(p_size as varchar) as asset,
           cast(p_size as double) as quantity
    from part""".replace("\\\\", "\\")

ORACLES["attach_price_events"] = f"""
    with {_TICKS}, prices as (
        select * from ticks where close > 0
        qualify row_number() over (partition by ticker, as_of_date order by price_date desc, fetched_at desc, close desc) = 1
    ),
    held as (
        select event_id as holding_id, case when event_type <> 'login' then 'T' || cast(user_id as varchar) end as asset,
               cast(ts as date) as as_of_date, value as quantity, case when event_id % 3 = 0 then value end as current_price
        from events
    )
    select holding_id, asset, h.as_of_date, quantity, coalesce(current_price, p.close) as current_price
    from held h left join prices p on h.asset = p.ticker and h.as_of_date = p.as_of_date"""

ORACLES["sql_stored_tables"] = f"""
    with {_CURRENT}{_HOME.removeprefix(_POSITIONS)}, {_HOME_NEWEST}, slices as ({_allocation('asset_class')})
    select h.institution, h.as_of_date, {_euros('h.cents')} as market_value, s.asset_class, {_euros('s.cents')} as class_value
    from home_newest h join slices s on h.institution = s.institution and h.as_of_date = s.as_of_date"""

# Asset labels need the asset totals and the current lots together.
_ASSETS_AND_CURRENT = _CURRENT + _ASSETS.removeprefix(_POSITIONS)
_LABELLED = f"with {_ASSETS_AND_CURRENT}, {_label('current_lots', _TAGS)}"

ORACLES["mart_asset_label"] = f"{_LABELLED} select * from labels"
ORACLES["holdings_table"] = f"""
    {_LABELLED} select asset, quantity, avg_price, current_price, pct_change, market_value
    from labels where institution = '{INSTITUTION}' and asset <> 'ALL'"""

ORACLES["page_home"] = f"""
    with {_CURRENT}{_HOME.removeprefix(_POSITIONS)}, {_HOME_NEWEST}
    {_pie('asset_class', 'ALL', 'classes')}
    union all {_pie('exposure', 'ALL', 'exposures')}
    union all {_all_charts('home_totals', 'institution', 'institution')}
    union all
    select 'headline', null, null, null, {_euros('cents')}, null, {_brl(_euros('cents'))}
    from home_newest where scope = 'HOME'
    union all
    select 'buttons', null, institution, null, {_euros('cents')}, null,
           upper(institution[1]) || lower(institution[2:]) || ' - ' || {_brl(_euros('cents'))}
    from home_newest where institution in ('BUILDING', 'MACHINERY')"""

_MINE = f"where institution = '{INSTITUTION}'"
ORACLES["page_institution"] = f"""
    {_LABELLED}
    {_pie('asset_class', INSTITUTION, 'classes')}
    union all {_pie('exposure', INSTITUTION, 'exposures')}
    union all {_all_charts('asset_totals', 'asset', 'institution, asset', _MINE)}
    union all {_series('annual', 'asset_totals', 'asset', 'institution, asset', _MINE)}
    union all select 'headline', null, null, null, market_value, null, {_brl('market_value')}
    from labels {_MINE} and asset = 'ALL'
    union all select 'holdings', null, asset, null, market_value, pct_change, null
    from labels {_MINE} and asset <> 'ALL'"""

_EVENT_POSITIONS = """
    held as (
        select event_id as holding_id, case when event_id % 4 = 0 then 'fund' else 'stock' end as asset_class,
               case when event_type <> 'click' then 'T' || cast(user_id as varchar) end as asset,
               cast(ts as date) as as_of_date, value as quantity, case when event_id % 3 = 0 then value end as current_price
        from events
    )"""

ORACLES["attach_price_asof"] = f"""
    with {_TICKS}, {_EVENT_POSITIONS}, prices as (
        select * from ticks where event_type = 'view' and close > 0
        qualify row_number() over (partition by ticker, price_date order by fetched_at desc, close desc) = 1
    )
    select holding_id, asset_class, asset, h.as_of_date, quantity,
           coalesce(current_price, case when h.as_of_date - p.price_date <= 3 then p.close end) as current_price,
           case when current_price is null and h.as_of_date - p.price_date <= 3 then p.price_date end as price_date
    from held h asof left join prices p on h.asset = p.ticker and h.as_of_date >= p.price_date"""

_MISSING = f"""
    {_TICKS}, {_EVENT_POSITIONS}, needed as (
        select distinct asset as ticker, cast(as_of_date - cast(back as integer) as date) as price_date
        from held, range(1, 8) days(back) where asset_class = 'stock' and asset <> ''
    ), missing as (
        select ticker, price_date from needed where isodow(price_date) < 6
        except select ticker, price_date from ticks where event_type = 'view' and close > 0
    )"""

ORACLES["missing_prices"] = f"with {_MISSING} select * from missing"
ORACLES["price_fetch_plan"] = f"""
    with {_MISSING}, numbered as (
        select *, cast(floor((price_date - date '1970-01-05') / 7.0) * 5 as bigint) + isodow(price_date)
                  - row_number() over (partition by ticker order by price_date) as run
        from missing
    )
    select ticker, min(price_date) as first_day, max(price_date) as last_day, count(*) as days from numbered group by ticker, run"""

_PAID = "case l_orderkey % 5 when 0 then null when 1 then 0 else (l_orderkey % 1000) * 100 + 25 end"

ORACLES["contributions_by_exposure"] = f"""
    with {_POSITIONS}, parts as (
        select l_orderkey, as_of_date, institution, exposure, sum(cents) as worth, max({_PAID}) as paid from positions group by all
    ), shares as (
        select *, {_half_up('coalesce(paid, 0) * sum(worth) over so_far', 'sum(worth) over of_order')} as share
        from parts window of_order as (partition by l_orderkey, as_of_date, institution),
                          so_far as (partition by l_orderkey, as_of_date, institution order by exposure rows unbounded preceding)
    ), parted as (
        select *, share - lag(share, 1, 0) over (partition by l_orderkey, as_of_date, institution order by exposure) as part from shares
    ), scoped as (
        select as_of_date, institution, exposure, sum(part) as cents from parted group by all
        union all select as_of_date, 'ALL', exposure, sum(part) from parted group by 1, 2, 3
    )
    select as_of_date, institution, exposure, cents / 100 as contribution,
           sum(cents) over (partition by institution, exposure order by as_of_date) / 100 as to_date
    from scoped"""

ORACLES["time_weighted_return"] = f"""
    with {_POSITIONS}, answers as (
        select l_orderkey, as_of_date, institution, sum(cents) as cents, coalesce(max({_PAID}), 0) as paid from positions group by 1, 2, 3
    ), scoped as (
        select as_of_date, institution, sum(cents) as cents, sum(paid) as paid from answers group by 1, 2
        union all select as_of_date, 'ALL', sum(cents), sum(paid) from answers group by 1
    ), grown as (
        select *, cents - paid as kept, lag(cents) over (partition by institution order by as_of_date) as before from scoped
    )
    select as_of_date, institution, {_euros('cents')} as market_value, {_euros('paid')} as contribution,
           {_percent('kept', 'before')} as period_return,
           round((product(case when before <> 0 then kept::double / before::double else 1.0 end)
                  over (partition by institution order by as_of_date rows unbounded preceding) - 1) * 100, 4) as chained_return
    from grown"""

ORACLES["mart_home_ytd"] = f"""
    with {_HOME}, kept as (select * from home_totals where month(as_of_date) % 3 <> 1), based as (
        select *, coalesce(
            arg_max(cents, as_of_date) over (partition by institution order by year range between unbounded preceding and 1 preceding),
            arg_min(cents, as_of_date) over (partition by institution, year)) as base
        from kept
    )
    select as_of_date, year, month_label, scope, institution, {_euros('cents')} as market_value, {_euros('base')} as base_value,
           {_percent('cents', 'base')} as ytd_pct
    from based"""

ORACLES["scan_form_quarantine"] = r"""
    with answers as (
        select o_orderkey as k, strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') as moment, cast(o_orderkey // 1000 as bigint) as bucket from orders
    )
    select case when k % 7 = 0 or k % 11 = 0 then 'ragged' else 'fits' end as reason,
           case when k % 7 = 0 then k || ',only'
                when k % 11 = 0 then 'x,y,XP,"Stock | BERK34 | ' || k || ' | 1,50 |' || chr(10) || 'Fund ""A"" | X",1,' || k
                else moment || '#14/03/2026#XP#Stock | BERK34 | ' || k || ' | 1,50 |' || chr(10) || 'Fund "A" | X#' || k end as record
    from answers
    union all
    select 'ragged', '2,3,XP,"open in ""the"" middle,' || bucket || chr(10) || '9,9,9,9,9' from answers where bucket % 3 = 0 group by bucket
    union all
    select 'unclosed', '{"timestamp":"4","data_apuracao":"5","instituicao_fin":"NU","resumo":"answer","aporte":"open ' || bucket || '\n8,8,8,8,8\n"}'
    from answers where bucket % 3 = 1 group by bucket"""

_BEFORE_SPLIT = "as_of_date < date '1998-01-01'"
ORACLES["gated_refresh"] = f"""
    with {_POSITIONS}
    select attempt, published, rows, newest, worth
    from (values ('same', true), ('grown', false)) tried(attempt, published),
         (select count(*) as rows, max(as_of_date) as newest, {_euros('sum(cents)')} as worth from positions where {_BEFORE_SPLIT})"""

ORACLES["price_history_versions"] = f"""
    with {_TICKS}, read_by as (
        select 1 as version, * from ticks where close > 0 and event_type = 'view'
        union all select 2, * from ticks where close > 0
    )
    select price_date, ticker, close, fetched_at, as_of_date, version from read_by
    qualify row_number() over (partition by version, ticker, price_date order by fetched_at desc, close desc) = 1"""

ORACLES["incremental_reports"] = f"""
    with line as ({ORACLES['mart_home_line']}), classes as ({ORACLES['mart_alloc_class']}), labels as ({ORACLES['mart_asset_label']})
    select as_of_date, institution, scope as name, market_value, pct_change as detail from line
    union all select as_of_date, institution, asset_class, market_value, null from classes
    union all select as_of_date, institution, asset, market_value, entry_cost from labels"""

ORACLES["sql_functions"] = f"""
    with {_FORM}, {_STOCK_QUOTES}, priced as (
        select f.month_start as as_of_date, upper(c_mktsegment) as institution, lower(typed_class) as asset_class,
               case when typed_class = 'Stock' then upper(typed_asset) else lower(typed_asset) end as asset, quantity, avg_price,
               coalesce(stated_price, q.close) as current_price
        from form_lines f left join newest_quotes q on typed_class = 'Stock' and q.ticker = upper({_STOCK}) and q.priced_on = f.month_start
    )
    select as_of_date, institution, asset_class, asset, quantity, current_price,
           {_percent('cast(round(current_price * 100) as bigint)', 'cast(round(avg_price * 100) as bigint)')} as gain,
           {_brl(_euros('cast(round(current_price * 100) as bigint) * cast(quantity as bigint)'))} as worth
    from priced"""
