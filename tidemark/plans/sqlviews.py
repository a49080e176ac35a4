"""SQL statements of the logical inputs, used by the comparison queries."""

from __future__ import annotations

VIEWS: dict[str, tuple[str, str]] = {}


def view(name: str, needs: str, body: str) -> None:
    VIEWS[name] = (needs, body.strip())


def with_views(body: str, needs: str) -> str:
    """Prefix a query with the views it names and everything those need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for parent in VIEWS[name][0].split():
            visit(parent)
        order.append(name)

    for n in needs.split():
        visit(n)
    body = _plain_counts(body)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({_plain_counts(VIEWS[n][1])})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _plain_counts(text: str) -> str:
    """Write count_if(c) as a filtered count, whose type is BIGINT."""
    while "count_if(" in text:
        start = text.index("count_if(")
        depth, end = 1, start + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = text[:start] + "count(*) FILTER (WHERE " + text[start + len("count_if("):end - 1] + ")" + text[end:]
    return text


def r(expression: str, digits: int = 6) -> str:
    """Rounded double without a negative zero."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def draw(*parts: str) -> str:
    """The counter-based integer: first eight hex digits of the key's md5."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


def _bars(key: str, where: str = "") -> str:
    return f"""SELECT 'T' || {key} AS ticker, CAST(l_shipdate AS DATE) AS date,
      CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / sum(l_quantity) AS close,
      sum(l_quantity) AS volume
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey {where}
    GROUP BY 1, 2"""


view("bars", "", _bars("n_regionkey"))
view("nation_bars", "", _bars("n_nationkey"))
view("sessions", "", """SELECT CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS session, date
    FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)""")
view("dense", "bars sessions", """SELECT t.ticker, s.session, s.date, b.close, b.volume
    FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN sessions s
    LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = s.date""")
view("nation_dense", "nation_bars sessions", """SELECT t.ticker, s.session, s.date, b.close, b.volume
    FROM (SELECT DISTINCT ticker FROM nation_bars) t CROSS JOIN sessions s
    LEFT JOIN nation_bars b ON b.ticker = t.ticker AND b.date = s.date""")
view("moves", "dense", """SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY session) - 1 AS ret FROM dense""")
view("filings", "", """SELECT 'I' || n_regionkey AS issuer, 'T' || n_regionkey AS ticker, o_orderkey AS accession,
      CAST(o_orderdate AS DATE) AS filing_date, CAST(o_orderdate AS DATE) + 1 AS available_date,
      o_orderpriority AS category, o_totalprice AS amount
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
view("aligned", "filings sessions", """SELECT f.*, s.session, s.date AS session_date
    FROM filings f ASOF LEFT JOIN sessions s ON f.available_date <= s.date""")
view("filing_labels", "", """SELECT DISTINCT l_orderkey AS accession, p_brand AS label
    FROM lineitem JOIN part ON l_partkey = p_partkey""")
view("contracts", "", """SELECT concat_ws('-', 'C', CAST(p_partkey AS VARCHAR), side) AS contract,
      'T' || (p_partkey % 5) AS ticker, side AS contract_type,
      CAST(2000 AS DOUBLE) * (CAST(0.8 AS DOUBLE) + (p_retailprice - 900) / 250) AS strike,
      DATE '1995-01-06' + CAST(28 * (p_partkey % 92) AS INTEGER) AS expiry,
      CASE WHEN p_size = 50 THEN 10 ELSE 100 END AS shares,
      CASE p_type WHEN 'PROMO' THEN 'european' WHEN 'SMALL' THEN 'other' ELSE 'american' END AS style,
      p_size = 49 AS extra
    FROM part CROSS JOIN (VALUES ('call'), ('put')) v(side)""")
view("option_bars", "", f"""SELECT ticker, contract_type, date, close * CAST(0.05 AS DOUBLE) AS close, volume FROM (
    SELECT *, 'call' AS contract_type FROM ({_bars('n_regionkey', "WHERE l_returnflag = 'A'")})
    UNION ALL SELECT *, 'put' AS contract_type FROM ({_bars('n_regionkey', "WHERE l_returnflag = 'R'")}))""")
view("quotes", "", """SELECT 'T' || n_regionkey AS ticker, CASE WHEN l_returnflag = 'N' THEN 'stock' ELSE 'option' END AS leg,
      (CAST(CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS BIGINT) * 86400 + (l_orderkey * 7919) % 86400) * 1000000000 AS ts_ns,
      l_orderkey * 10 + l_linenumber AS sequence,
      l_extendedprice / l_quantity * (CASE WHEN l_returnflag = 'N' THEN CAST(1 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END)
        * (1 - l_discount / 2) AS bid,
      l_extendedprice / l_quantity * (CASE WHEN l_returnflag = 'N' THEN CAST(1 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END)
        * (1 + l_tax / 2) AS ask,
      l_quantity AS bid_size, 51 - l_quantity AS ask_size
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
view("contract_days", "", """SELECT 'C-' || l_partkey || '-' || CASE l_returnflag WHEN 'A' THEN 'call' ELSE 'put' END AS contract, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / sum(l_quantity) * 0.05::DOUBLE AS price, sum(l_quantity) AS volume,
      arg_max(struct_pack(bid := l_extendedprice / l_quantity * 0.05::DOUBLE * (1 - l_discount / 2), ask := l_extendedprice / l_quantity * 0.05::DOUBLE * (1 + l_tax / 2)), (l_orderkey, l_linenumber)) AS q
    FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2""")
view("dividends", "filings", """SELECT ticker, filing_date AS declared, filing_date + 10 AS ex_date, amount * 1e-5 AS cash,
      CASE WHEN accession % 17 = 0 THEN 'CAD' ELSE 'USD' END AS currency, accession
    FROM filings WHERE category = '5-LOW' AND amount > 480000""")
view("splits", "filings", """SELECT ticker, filing_date + 20 AS execution_date, CAST(2 + accession % 2 AS INTEGER) AS split_to, CASE WHEN accession % 7 = 0 THEN 0 WHEN accession % 5 = 0 THEN 7 WHEN accession % 3 = 0 THEN 2 ELSE 1 END AS split_from
    FROM filings WHERE category = '1-URGENT' QUALIFY row_number() OVER (PARTITION BY ticker, year(filing_date) ORDER BY amount DESC, accession DESC) = 1""")


def gram_name(i: int, j: int) -> str:
    return f"g_{min(i, j)}_{max(i, j)}"


def gram_sql(columns: list[str], keys: str, source: str, inside: str | None = None) -> str:
    """n and the products of columns around their means by key; `inside` is a column in whose groups the means are taken, and which is summed over."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    by = f"{keys}, {inside}" if inside else keys
    one = ", ".join(f"sum({columns[i]} * {columns[j]}) - sum({columns[i]}) * sum({columns[j]}) / count(*) AS {gram_name(i, j)}" for i, j in pairs)
    return f"SELECT {by}, count(*) AS n, {one} FROM {source} GROUP BY {by}"


def swept_sql(source: str, keys: str, size: int, controls: list[int]) -> str:
    """Gram products once the controls are taken out, step by step."""
    for k in controls:
        parts = ", ".join(f"{gram_name(i, j)} - {gram_name(i, k)} * {gram_name(j, k)} / {gram_name(k, k)} AS {gram_name(i, j)}" for i in range(size) for j in range(i, size) if k not in (i, j) and not (set(controls[:controls.index(k)]) & {i, j}))
        source = f"(SELECT {keys}, n, {parts} FROM {source})"
    return source
