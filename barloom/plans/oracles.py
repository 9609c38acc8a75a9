"""Independent SQL (DuckDB) for the market-data queries, over the same shared tables."""

from __future__ import annotations

# --- pieces -------------------------------------------------------------------------------------------------------------

LOCAL = "timezone('America/Chicago', timezone('UTC', {0}))"
UTC = "timezone('UTC', timezone('America/Chicago', {0}))"
HOLIDAYS = "('2024-01-01', '2024-01-15')"


def local(x: str) -> str:
    return LOCAL.format(x)


def at_minute(day: str, minute: str | int) -> str:
    return UTC.format(f"(CAST({day} AS TIMESTAMP) + to_minutes(CAST({minute} AS BIGINT)))")


def is_trading(day: str) -> str:
    return f"(isodow({day}) < 6 AND CAST({day} AS VARCHAR) NOT IN {HOLIDAYS})"


def minute_of(x: str) -> str:
    return f"(hour({local(x)}) * 60 + minute({local(x)}))"


def trade_date(x: str) -> str:
    day = f"CAST({local(x)} AS DATE)"
    named = f"(CASE WHEN {minute_of(x)} < 960 THEN {day} WHEN {minute_of(x)} >= 1020 THEN CAST({day} + INTERVAL 1 DAY AS DATE) END)"
    return f"(CASE WHEN {is_trading(named)} THEN {named} END)"


def session_open(day: str) -> str:
    return at_minute(f"({day} - INTERVAL 1 DAY)", 1020)


def ordinary_close(day: str) -> str:
    return at_minute(day, 960)


def expected(x: str, minutes: int) -> str:
    return f"coalesce({trade_date(x)} IS NOT NULL AND {x} + INTERVAL {minutes} MINUTE <= {ordinary_close(trade_date(x))}, false)"


TRADES = """trades AS (
  SELECT 'SIM' AS venue, CASE WHEN user_id % 2 = 0 THEN 'ES' ELSE 'NQ' END AS instrument,
         'CON.F.US.' || CASE WHEN user_id % 2 = 0 THEN 'EP' ELSE 'ENQ' END || '.' || CASE WHEN event_id % 30 >= day(ts) THEN 'H24' ELSE 'M24' END AS contract_id,
         CAST(ts AS TIMESTAMP) AS trade_time_utc, event_id AS sequence, CAST(floor(value * 4 + 0.5) / 4 AS DOUBLE) AS price,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS size,
         CASE WHEN event_type IN ('click', 'purchase') THEN 1 WHEN event_type IN ('view', 'error') THEN 2 ELSE 0 END AS direction,
         CASE WHEN event_id % 50 = 0 THEN ts + INTERVAL 60 MINUTE ELSE ts + INTERVAL 1 SECOND END AS recorded_at, event_type
  FROM events)"""


def bars(name: str = "bars", minutes: int = 60, contract: str = "", where: str = "") -> str:
    code = "'CON.F.US.' || CASE WHEN instrument = 'ES' THEN 'EP' ELSE 'ENQ' END || CASE WHEN bucket_start < TIMESTAMP '2024-01-16 22:00:00' THEN '.H24' ELSE '.M24' END"
    return f"""{name} AS (
  SELECT *, {contract.format(code=code) if contract else code} AS contract_id FROM (
    SELECT instrument, time_bucket(INTERVAL {minutes} MINUTE, trade_time_utc) AS bucket_start, first(price ORDER BY trade_time_utc, sequence) AS open, max(price) AS high, min(price) AS low,
           last(price ORDER BY trade_time_utc, sequence) AS close, CAST(sum(size) AS BIGINT) AS volume
    FROM trades GROUP BY ALL) {where})"""


BARS = f"{TRADES}, {bars()}"
UNKNOWN_CONTRACT = "CASE WHEN bucket_start >= TIMESTAMP '2024-01-10 03:00:00' AND bucket_start < TIMESTAMP '2024-01-10 06:00:00' THEN NULL ELSE {code} END"
UNKNOWN = f"{TRADES}, {bars('bars', contract=UNKNOWN_CONTRACT)}"
EPOCH_HOUR = "CAST(floor(epoch({0}) / 3600) AS BIGINT)"
GAPPY = f"{TRADES}, {bars('bars', where='WHERE ' + EPOCH_HOUR.format('bucket_start') + ' % 97 <> 0')}"


def runs(source: str = "bars", name: str = "runs", key: str = "instrument") -> str:
    """Rows with run_id and rn, the number of a row in its run."""
    return f"""{name}_0 AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN lag(contract_id) OVER w IS NOT DISTINCT FROM contract_id THEN 0 ELSE 1 END AS changed FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY bucket_start)),
{name}_1 AS (SELECT * EXCLUDE changed, CAST(sum(changed) OVER (PARTITION BY {key} ORDER BY bucket_start) AS BIGINT) AS run_id FROM {name}_0),
{name} AS (SELECT *, row_number() OVER (PARTITION BY {key}, run_id ORDER BY bucket_start) AS rn FROM {name}_1)"""


RUN = "instrument, run_id"


def smoothed(source: str, name: str, x: str, first: int, n: int, alpha: str, out: str = "y", key: str = RUN, at: str = "rn") -> str:
    """`out`: from row first + n - 1 on, the mean of the first n values and then out + alpha * (x - out)."""
    return f"""{name}_l AS (SELECT {key}, list({x} ORDER BY {at}) AS xs FROM {source} GROUP BY ALL),
{name} AS (SELECT s.*, CASE WHEN {at} >= {first + n - 1} THEN list_reduce(list_prepend(list_avg(xs[{first}:{first + n - 1}]), xs[{first + n}:{at}]), lambda a, b: a + ({alpha}) * (b - a)) END AS {out}
  FROM {source} s JOIN {name}_l USING ({key}))"""


RANGES = f"tr AS (SELECT *, CASE WHEN rn > 1 THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM runs WINDOW w AS (PARTITION BY {RUN} ORDER BY bucket_start))"


def _frame(n: int) -> str:
    return f"(PARTITION BY {RUN} ORDER BY bucket_start ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


TYPICAL = "(high + low + close) / 3"
DI = ", ".join(
    [
        RANGES,
        f"""dm AS (SELECT *, CASE WHEN rn > 1 THEN CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END END AS pdm, CASE WHEN rn > 1 THEN CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END END AS mdm
  FROM (SELECT *, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM tr WINDOW w AS (PARTITION BY {RUN} ORDER BY bucket_start)))""",
        smoothed("dm", "s1", "tr", 2, 14, "1.0 / 14", "st"),
        smoothed("s1", "s2", "pdm", 2, 14, "1.0 / 14", "sp"),
        smoothed("s2", "s3", "mdm", 2, 14, "1.0 / 14", "sm"),
        "di AS (SELECT *, CASE WHEN st <> 0 THEN 100 * sp / st END AS plus_di, CASE WHEN st <> 0 THEN 100 * sm / st END AS minus_di FROM s3)",
        "dx AS (SELECT *, CASE WHEN plus_di + minus_di <> 0 THEN 100 * abs(plus_di - minus_di) / (plus_di + minus_di) END AS dx FROM di)",
        f"isl AS (SELECT *, sum(CASE WHEN dx IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {RUN} ORDER BY bucket_start) AS island FROM dx)",
        f"num AS (SELECT *, row_number() OVER (PARTITION BY {RUN}, island ORDER BY bucket_start) AS k FROM isl WHERE dx IS NOT NULL)",
        smoothed("num", "ad", "dx", 1, 14, "1.0 / 14", "adx", f"{RUN}, island", "k"),
    ]
)
MACD = ", ".join(
    [
        smoothed("runs", "m1", "close", 1, 12, "2.0 / 13", "fast"),
        smoothed("m1", "m2", "close", 1, 26, "2.0 / 27", "slow"),
        "m3 AS (SELECT *, fast - slow AS line FROM m2)",
        smoothed("m3", "m4", "line", 26, 9, "2.0 / 10", "signal"),
    ]
)
#: CTEs and the expression of each indicator; the rows are those of the last CTE.
INDICATORS: dict[str, tuple[str, str, str]] = {
    "sma": ("", "runs", f"CASE WHEN rn >= 20 THEN avg(close) OVER {_frame(20)} END"),
    "ema": (smoothed("runs", "e", "close", 1, 20, "2.0 / 21"), "e", "y"),
    "macd": (MACD, "m4", "line"),
    "macd_signal": (MACD, "m4", "signal"),
    "macd_histogram": (MACD, "m4", "line - signal"),
    "bb_middle": ("", "runs", f"CASE WHEN rn >= 20 THEN avg(close) OVER {_frame(20)} END"),
    "bb_upper": ("", "runs", f"CASE WHEN rn >= 20 THEN avg(close) OVER {_frame(20)} + 2 * stddev_pop(close) OVER {_frame(20)} END"),
    "bb_lower": ("", "runs", f"CASE WHEN rn >= 20 THEN avg(close) OVER {_frame(20)} - 2 * stddev_pop(close) OVER {_frame(20)} END"),
    "atr": (f"{RANGES}, {smoothed('tr', 'a', 'tr', 2, 14, '1.0 / 14')}", "a", "y"),
    "rsi": (
        ", ".join(
            [
                f"g AS (SELECT *, CASE WHEN rn > 1 THEN greatest(close - lag(close) OVER w, 0) END AS gain, CASE WHEN rn > 1 THEN greatest(lag(close) OVER w - close, 0) END AS loss FROM runs WINDOW w AS (PARTITION BY {RUN} ORDER BY bucket_start))",
                smoothed("g", "r1", "gain", 2, 14, "1.0 / 14", "sg"),
                smoothed("r1", "r2", "loss", 2, 14, "1.0 / 14", "sl"),
            ]
        ),
        "r2",
        "CASE WHEN sg = 0 AND sl = 0 THEN 50.0 WHEN sl = 0 THEN 100.0 ELSE 100 * sg / (sg + sl) END",
    ),
    "plus_di": (DI, "dx", "plus_di"),
    "minus_di": (DI, "dx", "minus_di"),
    "adx": (DI, "ad", "adx"),
    "vwap": (
        f"v AS (SELECT *, {trade_date('bucket_start')} AS td FROM runs), v2 AS (SELECT *, sum({TYPICAL} * volume) OVER w AS pv, sum(volume) OVER w AS sv FROM v WINDOW w AS (PARTITION BY {RUN}, td ORDER BY bucket_start))",
        "v2",
        "CASE WHEN td IS NOT NULL AND sv > 0 THEN pv / sv END",
    ),
    "vwap_rolling": ("", "runs", f"CASE WHEN rn >= 20 AND sum(volume) OVER {_frame(20)} > 0 THEN sum({TYPICAL} * volume) OVER {_frame(20)} / sum(volume) OVER {_frame(20)} END"),
}
PERIODS = {"atr": 14, "rsi": 14, "adx": 14, "plus_di": 14, "minus_di": 14, "macd": 26, "macd_signal": 26, "macd_histogram": 26, "vwap": 1}


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(p for p in parts if p) + " "


def indicator(name: str, base: str = UNKNOWN) -> str:
    ctes, rows, value = INDICATORS[name]
    return with_(base, runs(), ctes) + f"SELECT * FROM (SELECT instrument, bucket_start, round({value}, 6) AS value FROM {rows}) WHERE value IS NOT NULL"


def nested(name: str) -> str:
    """The indicator over `runs` as a subquery that can stand beside others."""
    ctes, rows, value = INDICATORS[name]
    head = f"WITH {ctes} " if ctes else ""
    return f"(SELECT instrument, bucket_start, contract_id, '{name}' AS indicator, {PERIODS.get(name, 20)} AS period, value FROM ({head}SELECT instrument, bucket_start, contract_id, {value} AS value FROM {rows}) WHERE value IS NOT NULL)"


CATALOGUE = "cat AS (" + " UNION ALL ".join("SELECT * FROM " + nested(n) for n in INDICATORS) + ")"
PRODUCED = "made AS (SELECT instrument, bucket_start, indicator, period, round(value, 8) AS value FROM cat)"
HOUR = EPOCH_HOUR.format("bucket_start")
STORED = f"""stored AS (
  SELECT instrument, bucket_start, indicator, period, CASE WHEN {HOUR} % 13 = 0 THEN value + 1 ELSE value END AS value FROM made WHERE {HOUR} % 11 <> 0
  UNION ALL SELECT instrument, bucket_start, indicator, 99, value FROM made WHERE indicator = 'sma' AND {HOUR} % 50 = 0
  UNION ALL SELECT instrument, bucket_start + INTERVAL 30 MINUTE, indicator, period, value FROM made WHERE indicator = 'sma' AND {HOUR} % 60 = 0)"""
ALL_VALUES = ", ".join([BARS, runs(), CATALOGUE, PRODUCED, STORED])
AVERAGES = ", ".join(
    [
        BARS,
        runs(),
        f"made AS (SELECT instrument, bucket_start, indicator, period, round(value, 8) AS value FROM (SELECT * FROM {nested('sma')} UNION ALL SELECT * FROM {nested('vwap_rolling')}))",
        f"held AS (SELECT * FROM made UNION ALL SELECT instrument, bucket_start + INTERVAL 30 MINUTE, indicator, period, value FROM made WHERE indicator = 'sma' AND {HOUR} % 60 = 0)",
    ]
)
DAYS = f"days AS (SELECT CAST(unnest(generate_series((SELECT CAST(min(CAST({local('ts')} AS DATE)) - INTERVAL 8 DAY AS TIMESTAMP) FROM events), (SELECT CAST(max(CAST({local('ts')} AS DATE)) + INTERVAL 8 DAY AS TIMESTAMP) FROM events), INTERVAL 1 DAY)) AS DATE) AS d)"
SESSIONS = f"""sess AS (SELECT d AS trade_date, {session_open('d')} AS open_utc, {ordinary_close('d')} AS ordinary_close, CASE WHEN CAST(d AS VARCHAR) = '2024-01-12' THEN {at_minute('d', 720)} ELSE {ordinary_close('d')} END AS close_utc FROM days WHERE {is_trading('d')})"""
WINDOWS = f"""defs AS (SELECT * FROM (VALUES ('full', 1020, 960, 60), ('rth', 510, 900, 30), ('asia', 1020, 120, 30), ('europe', 120, 510, 30)) t(session, s, e, base)),
wins_0 AS (SELECT session, d AS trade_date, base, {at_minute("(d - to_days(CASE WHEN s >= 1020 THEN 1 ELSE 0 END))", 's')} AS start_utc, {at_minute("(d - to_days(CASE WHEN e >= 1020 THEN 1 ELSE 0 END))", 'e')} AS end_utc FROM days, defs WHERE {is_trading('d')}),
wins AS (SELECT * FROM wins_0 WHERE end_utc > start_utc AND {trade_date('start_utc')} = trade_date AND (end_utc = {ordinary_close('trade_date')} OR coalesce({trade_date('end_utc')} = trade_date, false)))"""
GRID = f"grid AS (SELECT * FROM (SELECT trade_date, unnest(generate_series(open_utc, ordinary_close - INTERVAL 60 MINUTE, INTERVAL 60 MINUTE)) AS bucket_start FROM sess) WHERE {expected('bucket_start', 60)} AND bucket_start >= (SELECT date_trunc('day', min(ts)) FROM events) AND bucket_start < (SELECT date_trunc('day', max(ts)) FROM events))"
GAPS = f"""hid AS (SELECT instrument, bucket_start, CASE WHEN hour(bucket_start) = 4 THEN NULL ELSE contract_id END AS contract_id FROM bars),
cand AS (SELECT DISTINCT * FROM (SELECT i.instrument, g.bucket_start FROM grid g, (SELECT DISTINCT instrument FROM bars) i UNION ALL SELECT instrument, bucket_start FROM hid WHERE contract_id IS NULL)),
mk AS (SELECT c.*, h.contract_id IS NOT NULL AS held FROM cand c LEFT JOIN hid h USING (instrument, bucket_start)),
isl AS (SELECT *, sum(CASE WHEN held THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY bucket_start) AS g FROM mk),
gaps AS (SELECT instrument, min(bucket_start) AS range_start, max(bucket_start) + INTERVAL 60 MINUTE AS range_end, count(*) AS buckets FROM isl WHERE NOT held GROUP BY instrument, g)"""
GAP_BASE = ", ".join([GAPPY, DAYS, SESSIONS, GRID, GAPS])
COVERAGE = """cov_0 AS (SELECT instrument, contract_id, min(trade_time_utc) AS range_start, max(trade_time_utc) + INTERVAL 1 SECOND AS range_end FROM trades WHERE CAST(trade_time_utc AS DATE) <> DATE '2024-01-20' GROUP BY instrument, contract_id, CAST(trade_time_utc AS DATE)),
cov AS (SELECT * FROM cov_0 UNION ALL SELECT instrument, contract_id, max(range_start), TIMESTAMP '9999-12-31 00:00:00' FROM cov_0 WHERE contract_id LIKE '%M24' GROUP BY ALL)"""
FOOTPRINT = """fp_0 AS (SELECT *, time_bucket(INTERVAL 60 MINUTE, trade_time_utc) AS bucket_start FROM trades WHERE direction IN (1, 2) AND size > 0),
fp AS (SELECT instrument, bucket_start, price, CAST(sum(CASE WHEN direction = 1 THEN size ELSE 0 END) AS BIGINT) AS buy_volume, CAST(sum(CASE WHEN direction = 2 THEN size ELSE 0 END) AS BIGINT) AS sell_volume
  FROM fp_0 WHERE (instrument, bucket_start) IN (SELECT (instrument, bucket_start) FROM (SELECT instrument, bucket_start FROM fp_0 GROUP BY ALL HAVING count(DISTINCT contract_id) = 1)) GROUP BY ALL)"""
FOOTPRINT = FOOTPRINT.replace("(instrument, bucket_start) IN (SELECT (instrument, bucket_start) FROM (SELECT instrument, bucket_start FROM fp_0 GROUP BY ALL HAVING count(DISTINCT contract_id) = 1))", "instrument || bucket_start IN (SELECT instrument || bucket_start FROM fp_0 GROUP BY ALL HAVING count(DISTINCT contract_id) = 1)")
LADDER = "lad AS (SELECT instrument, CAST(bucket_start AS DATE) AS day, price, CAST(sum(buy_volume + sell_volume) AS BIGINT) AS volume FROM fp GROUP BY ALL)"


def poc(source: str, key: str) -> str:
    return f"poc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY volume DESC, abs(price - mid), price) AS r FROM (SELECT *, (min(price) OVER (PARTITION BY {key}) + max(price) OVER (PARTITION BY {key})) / 2 AS mid FROM {source})) WHERE r = 1)"


def area(source: str, key: str) -> str:
    """The value area level by level, as a recursion on the numbers of the levels."""
    on = " AND ".join(f"a.{k.strip()} = x.{k.strip()}" for k in key.split(","))
    vol = lambda i: f"coalesce((SELECT x.volume FROM lv x WHERE {on} AND x.i = {i}), 0)"
    below, above = f"({vol('a.lo - 1')} + {vol('a.lo - 2')})", f"({vol('a.hi + 1')} + {vol('a.hi + 2')})"
    side = f"(a.hi = a.n OR (a.lo > 1 AND {below} >= {above}))"
    return f"""{poc(source, key)}, lv AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY price) AS i FROM {source}),
tot AS (SELECT {key}, sum(volume) AS total, count(*) AS n FROM {source} GROUP BY ALL),
ga AS (SELECT {key}, lv.i AS lo, lv.i AS hi, CAST(lv.volume AS HUGEINT) AS v, total, n, 0 AS step FROM poc JOIN lv USING ({key}, price) JOIN tot USING ({key})
  UNION ALL SELECT {', '.join('a.' + k.strip() for k in key.split(','))}, CASE WHEN {side} THEN greatest(a.lo - 2, 1) ELSE a.lo END, CASE WHEN {side} THEN a.hi ELSE least(a.hi + 2, a.n) END,
    a.v + CASE WHEN {side} THEN {below} ELSE {above} END, a.total, a.n, a.step + 1 FROM ga a WHERE a.v < 0.7 * a.total AND NOT (a.lo = 1 AND a.hi = a.n)),
va AS (SELECT {key}, poc.price AS poc, l.price AS val, h.price AS vah, CAST(v AS BIGINT) AS area_volume, CAST(total AS BIGINT) AS total_volume, n AS levels
  FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY step DESC) AS r FROM ga) g JOIN poc USING ({key}) JOIN lv l USING ({key}) JOIN lv h USING ({key}) WHERE g.r = 1 AND l.i = g.lo AND h.i = g.hi)"""


VOLUMES = f"vol AS (SELECT instrument, trade_date, contract_id, CAST(sum(size) AS BIGINT) AS volume FROM (SELECT *, {trade_date('trade_time_utc')} AS trade_date FROM trades WHERE size > 0) WHERE trade_date IS NOT NULL GROUP BY ALL)"
FRONT = """win AS (SELECT instrument, trade_date, CASE WHEN count(*) = 1 THEN min(contract_id) END AS winner FROM (SELECT *, max(volume) OVER (PARTITION BY instrument, trade_date) AS top FROM vol) WHERE volume = top GROUP BY ALL),
pre AS (SELECT *, last_value(winner IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM win),
front AS (SELECT instrument, max(trade_date) AS last_session, last(winner ORDER BY trade_date) AS active,
  max(CASE WHEN winner <> before THEN trade_date END) AS changed_on, arg_max(before, trade_date) FILTER (WHERE winner <> before) AS from_contract, arg_max(winner, trade_date) FILTER (WHERE winner <> before) AS to_contract FROM pre GROUP BY 1)"""
FLIP = f"""fl AS (SELECT t.instrument, f.changed_on, f.from_contract, f.to_contract, trade_time_utc, sum(CASE WHEN contract_id = to_contract THEN size ELSE -size END) AS lead
  FROM trades t JOIN front f USING (instrument) WHERE size > 0 AND {trade_date('trade_time_utc')} = changed_on AND contract_id IN (from_contract, to_contract) GROUP BY ALL),
flip AS (SELECT instrument, changed_on, from_contract, to_contract, min(CASE WHEN s > 0 THEN trade_time_utc END) AS flipped_at FROM (SELECT *, sum(lead) OVER (PARTITION BY instrument ORDER BY trade_time_utc) AS s FROM fl) GROUP BY ALL)"""
BY_CONTRACT = "byc AS (SELECT instrument, contract_id, time_bucket(INTERVAL 60 MINUTE, trade_time_utc) AS bucket_start, first(price ORDER BY trade_time_utc, sequence) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY trade_time_utc, sequence) AS close, CAST(sum(size) AS BIGINT) AS volume FROM trades GROUP BY ALL)"
DATED = f"dated AS (SELECT *, coalesce({trade_date('bucket_start')}, CAST(bucket_start AS DATE)) AS trade_date FROM byc)"
RECEIPTS = """rec AS (SELECT instrument, contract_id, day, n + CASE WHEN day(day) % 7 = 0 THEN 5 WHEN day(day) % 11 = 0 THEN -1 ELSE 0 END AS row_count,
  CASE WHEN day(day) % 11 = 0 OR day(day) % 3 = 0 THEN last + INTERVAL 60 MINUTE ELSE CAST(day + INTERVAL 1 DAY AS TIMESTAMP) END AS exported_at
  FROM (SELECT instrument, contract_id, CAST(trade_time_utc AS DATE) AS day, count(*) AS n, max(recorded_at) AS last FROM trades GROUP BY ALL) WHERE day <> DATE '2024-01-05'),
src AS (SELECT instrument, contract_id, CAST(trade_time_utc AS DATE) AS day, count(*) AS source_rows, max(recorded_at) AS last_recorded FROM trades GROUP BY ALL)"""
PLAN = """plan AS (SELECT instrument, contract_id, day, row_count, coalesce(source_rows, 0) AS source_rows,
  CASE WHEN coalesce(source_rows, 0) > 0 AND source_rows < row_count THEN 'delete' WHEN last_recorded > exported_at AND source_rows >= row_count THEN 'withdraw: late rows'
       WHEN coalesce(source_rows, 0) = row_count THEN 'delete' WHEN coalesce(source_rows, 0) = 0 THEN 'done' ELSE 'withdraw: count changed' END AS action, exported_at
  FROM rec LEFT JOIN src USING (instrument, contract_id, day))"""
CHANGED = "chg AS (SELECT * EXCLUDE (volume, contract_id), CASE WHEN hour(bucket_start) % 5 = 0 THEN volume + 1 ELSE volume END AS volume, CASE WHEN hour(bucket_start) = 7 THEN NULL ELSE contract_id END AS contract_id FROM bars WHERE hour(bucket_start) <> 3)"
MEMO = f"""memo AS (SELECT instrument, 'CON.F.US.' || CASE WHEN instrument = 'ES' THEN 'EP' ELSE 'ENQ' END || '.' || m AS contract_id, range_start, range_end, CASE WHEN m = 'M24' THEN range_end + INTERVAL 14400 MINUTE END AS expires_at
  FROM gaps, (VALUES ('H24'), ('M24')) t(m) WHERE m = 'H24' OR {EPOCH_HOUR.format('range_start')} % 2 = 0)"""


def session_bars(base: str, now: str, name: str = "sb") -> str:
    return f"""b30 AS (SELECT * FROM ({base.format(m=30)})), b60 AS (SELECT * FROM ({base.format(m=60)})),
{name}_g AS (SELECT w.session, w.trade_date, w.start_utc, w.end_utc, w.base, unnest(generate_series(start_utc, end_utc - to_minutes(base), to_minutes(base))) AS bucket_start FROM wins w
  WHERE end_utc > (SELECT min(ts) FROM events) AND start_utc <= (SELECT max(ts) FROM events)),
{name}_r AS (SELECT i.instrument, g.*, b.open, b.high, b.low, b.close, b.volume, b.contract_id, b.instrument IS NOT NULL AS there FROM {name}_g g, (SELECT DISTINCT instrument FROM trades) i
  LEFT JOIN (SELECT *, 30 AS base FROM b30 UNION ALL SELECT *, 60 FROM b60) b ON b.instrument = i.instrument AND b.base = g.base AND b.bucket_start = g.bucket_start
  WHERE (g.base = 60 AND {expected('g.bucket_start', 60)}) OR (g.base = 30 AND {expected('g.bucket_start', 30)})),
{name}_a AS (SELECT instrument, session, trade_date, start_utc, end_utc, base, count(*) AS expected, count(*) FILTER (WHERE there) AS held, first(open ORDER BY bucket_start) FILTER (WHERE there) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY bucket_start) FILTER (WHERE there) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(DISTINCT coalesce(contract_id, '?')) FILTER (WHERE there) AS contracts, max(contract_id) AS contract_id FROM {name}_r GROUP BY ALL),
{name} AS (SELECT *, CASE WHEN end_utc > TIMESTAMP '{now}' THEN 'NotClosed' WHEN held < expected THEN 'Incomplete' WHEN contracts > 1 THEN 'SpansRoll' WHEN contract_id IS NULL THEN 'ProvenanceUnknown' END AS absence FROM {name}_a)"""


def _bars_select(where: str = "") -> str:
    """Bars of {m} minutes as a select."""
    return bars("x", 0, where=where).split(" AS (", 1)[1].rsplit(")", 1)[0].replace("INTERVAL 0 MINUTE", "INTERVAL {m} MINUTE")


GAPPY_SELECT = _bars_select("WHERE " + HOUR + " % 97 <> 0")
WHOLE_SELECT = _bars_select()

# --- levels -------------------------------------------------------------------------------------------------------------

HEIKIN = f"hc AS (SELECT *, (open + high + low + close) / 4 AS ha_close FROM runs), hl AS (SELECT {RUN}, list(ha_close ORDER BY rn) AS xs, first((open + close) / 2 ORDER BY rn) AS seed FROM hc GROUP BY ALL), ho AS (SELECT hc.*, list_reduce(list_prepend(seed, xs[1:rn - 1]), lambda a, b: (a + b) / 2) AS ha_open FROM hc JOIN hl USING ({RUN}))"

#: The bars that levels are sought on: the newest run, with their average range.
LEVEL_BARS = ", ".join(
    [
        BARS,
        runs("bars", "seg"),
        "lb AS (SELECT instrument, bucket_start, open, high, low, close, volume, contract_id FROM seg WHERE run_id = (SELECT max(run_id) FROM seg s WHERE s.instrument = seg.instrument))",
        runs("lb", "runs"),
        RANGES,
        smoothed("tr", "scaled", "tr", 2, 14, "1.0 / 14", "atr"),
        "lc AS (SELECT instrument, last(close ORDER BY bucket_start) AS last_close FROM lb GROUP BY 1)",
    ]
)
SNAPSHOT_BARS = LEVEL_BARS.replace("FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY bucket_start)),\nseg_1", "FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY bucket_start DESC) <= 500) WINDOW w AS (PARTITION BY instrument ORDER BY bucket_start)),\nseg_1")
PIVOTS = """pv_0 AS (SELECT *, greatest(max(high) OVER (PARTITION BY instrument ORDER BY bucket_start ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), max(high) OVER (PARTITION BY instrument ORDER BY bucket_start ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS oh,
  least(min(low) OVER (PARTITION BY instrument ORDER BY bucket_start ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), min(low) OVER (PARTITION BY instrument ORDER BY bucket_start ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS ol, count(*) OVER (PARTITION BY instrument) AS n FROM scaled),
pv AS (SELECT instrument, bucket_start, atr, CASE WHEN high > oh THEN high ELSE low END AS price, CASE WHEN high > oh THEN 'Resistance' ELSE 'Support' END AS kind, CASE WHEN high > oh THEN high - oh ELSE ol - low END AS prominence
  FROM pv_0 WHERE rn > 5 AND rn <= n - 3 AND (high > oh OR low < ol))"""


def lines(name: str, source: str, price: str, kind: str, formed: str, scale: str, significance: str, period: str) -> str:
    return f"{name} AS (SELECT instrument, {price} - {scale} * 0.5 / 2 AS bottom, {price} + {scale} * 0.5 / 2 AS top, {kind} AS kind, {formed} AS formed_at, CAST(1 AS BIGINT) AS touches, {significance} AS significance, {period} AS period FROM {source} WHERE {scale} > 0 AND {significance} >= 0.1)"


ZONES = lines("zones", "pv", "price", "kind", "bucket_start", "atr", "prominence / atr", "CAST(NULL AS VARCHAR)")


def merged(source: str, name: str) -> str:
    return f"""{name}_0 AS (SELECT *, CASE WHEN bottom <= max(top) OVER (PARTITION BY instrument ORDER BY bottom, top ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {source}),
{name}_1 AS (SELECT *, sum(fresh) OVER (PARTITION BY instrument ORDER BY bottom, top ROWS UNBOUNDED PRECEDING) AS g FROM {name}_0),
{name} AS (SELECT instrument, min(bottom) AS bottom, max(top) AS top, first(kind ORDER BY significance DESC, formed_at, bottom, top, kind) AS kind, min(formed_at) AS formed_at, CAST(sum(touches) AS BIGINT) AS touches, max(significance) AS significance,
  first(period ORDER BY significance DESC, formed_at, bottom, top, kind) AS period FROM {name}_1 GROUP BY instrument, g)"""


def finished(source: str, name: str) -> str:
    return f"""{merged(source, name + '_m')},
{name}_w AS (SELECT m.* REPLACE (CASE WHEN top < last_close THEN 'Support' WHEN bottom > last_close THEN 'Resistance' ELSE kind END AS kind) FROM {name}_m m JOIN lc USING (instrument) WHERE (top - bottom) * 100 <= 400.0 * (top + bottom) / 2),
{name} AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY significance DESC, touches DESC, bottom, top, formed_at, kind) AS r FROM {name}_w) WHERE r <= 12)"""


ZONE_OUT = "SELECT instrument, round(bottom, 6) AS bottom, round(top, 6) AS top, round(significance, 6) AS significance, kind, formed_at, touches, period FROM "
PREVIOUS = f"CAST((SELECT max(d) FROM days WHERE {is_trading('d')} AND d < cur AND d >= cur - INTERVAL 14 DAY) AS DATE)"
PERIOD = ", ".join(
    [
        DAYS,
        f"dt AS (SELECT *, {trade_date('bucket_start')} AS td FROM scaled)",
        "cu AS (SELECT instrument, arg_max(td, bucket_start) FILTER (WHERE td IS NOT NULL) AS cur, min(bucket_start) AS first_at, max(bucket_start) AS last_at, last(close ORDER BY bucket_start) AS last_close FROM dt GROUP BY 1)",
        f"cv AS (SELECT *, {PREVIOUS} AS prev FROM cu)",
        f"""pp AS (SELECT * FROM (SELECT instrument, prev, cv.last_close, first(open ORDER BY bucket_start) AS o, max(high) AS h, min(low) AS l, last(close ORDER BY bucket_start) AS c, last(atr ORDER BY bucket_start) AS atr, max(bucket_start) AS formed_at, count(*) AS n
  FROM dt JOIN cv USING (instrument) WHERE td = prev AND first_at <= CASE WHEN {trade_date(session_open('prev'))} = prev THEN {session_open('prev')} END GROUP BY instrument, prev, cv.last_close) WHERE n >= 2)""",
    ]
)
_P3 = "((h + l + c) / 3)"
_W4 = "((h + l + 2 * c) / 4)"
_X = "(CASE WHEN c < o THEN h + 2 * l + c WHEN c > o THEN 2 * h + l + c ELSE h + l + 2 * c END)"
PIVOT_LINES = {
    "classic": [(f"l - 2 * (h - {_P3})", "S"), (f"{_P3} - (h - l)", "S"), (f"2 * {_P3} - h", "S"), (_P3, ""), (f"2 * {_P3} - l", "R"), (f"{_P3} + (h - l)", "R"), (f"h + 2 * ({_P3} - l)", "R")],
    "fibonacci": [(_P3, "")] + [(f"{_P3} {sign} {f} * (h - l)", kind) for f in (0.382, 0.618, 1.0) for sign, kind in (("-", "S"), ("+", "R"))],
    "camarilla": [(f"c {sign} 1.1 * (h - l) / {d}", kind) for d in (12, 6, 4, 2) for sign, kind in (("-", "S"), ("+", "R"))],
    "woodie": [(f"{_W4} - (h - l)", "S"), (f"2 * {_W4} - h", "S"), (_W4, ""), (f"2 * {_W4} - l", "R"), (f"{_W4} + (h - l)", "R")],
    "demark": [(f"{_X} / 2 - h", "S"), (f"{_X} / 4", ""), (f"{_X} / 2 - l", "R")],
}


def pivot(formula: str, name: str) -> str:
    kinds = {"S": "'Support'", "R": "'Resistance'"}
    parts = " UNION ALL ".join(f"SELECT pp.*, CAST({price} AS DOUBLE) AS price, {kinds.get(k, 'NULL')} AS seed FROM pp" for price, k in PIVOT_LINES[formula])
    made = lines(f"{name}_z", f"{name}_l", "price", "coalesce(seed, CASE WHEN price > last_close THEN 'Resistance' ELSE 'Support' END)", "formed_at", "atr", "(h - l) / atr", "CAST(prev AS VARCHAR)")
    return f"{name}_l AS ({parts}), {made}, {finished(name + '_z', name)}"


def _opened(day: str) -> str:
    return f"CASE WHEN {trade_date(session_open(day))} = {day} THEN {session_open(day)} END"


_MONDAY = "CAST(cur - to_days(CAST(isodow(cur) - 1 AS INTEGER)) AS DATE)"
SESSION_LEVELS = ", ".join(
    [
        f"cw AS (SELECT *, CAST({_MONDAY} - INTERVAL 7 DAY AS DATE) AS wk, {_opened('cur')} AS opened, {_opened('prev')} AS prev_open FROM cv)",
        f"cx AS (SELECT *, CAST((SELECT min(d) FROM days WHERE {is_trading('d')} AND d >= wk AND d <= wk + INTERVAL 6 DAY) AS DATE) AS wk_first FROM cw)",
        f"cy AS (SELECT *, {_opened('wk_first')} AS wk_open FROM cx)",
        f"""mem AS (SELECT dt.*, CAST(prev AS VARCHAR) AS period, true AS wc, cy.last_close AS lcl FROM dt JOIN cy USING (instrument) WHERE td = prev AND first_at <= prev_open
  UNION ALL SELECT dt.*, 'week:' || CAST(wk AS VARCHAR), true, cy.last_close FROM dt JOIN cy USING (instrument) WHERE td >= wk AND td <= wk + INTERVAL 6 DAY AND first_at <= wk_open
  UNION ALL SELECT dt.*, 'overnight', false, cy.last_close FROM dt JOIN cy USING (instrument) WHERE td = cur AND first_at <= opened AND CAST({local('last_at')} AS DATE) >= cur AND CAST({local('bucket_start')} AS DATE) < cur
  UNION ALL SELECT dt.*, 'initial-balance', false, cy.last_close FROM dt JOIN cy USING (instrument) WHERE td = cur AND first_at <= opened AND last_at >= opened + INTERVAL 60 MINUTE AND bucket_start >= opened AND bucket_start < opened + INTERVAL 60 MINUTE)""",
        """per AS (SELECT instrument, period, wc, lcl, max(high) - min(low) AS span, max(high) AS h, first(bucket_start ORDER BY high DESC, bucket_start) AS h_at, first(atr ORDER BY high DESC, bucket_start) AS h_atr,
  min(low) AS l, first(bucket_start ORDER BY low, bucket_start) AS l_at, first(atr ORDER BY low, bucket_start) AS l_atr, last(close ORDER BY bucket_start) AS c, max(bucket_start) AS c_at, last(atr ORDER BY bucket_start) AS c_atr FROM mem GROUP BY ALL)""",
        """ses_l AS (SELECT instrument, period, span, h AS price, 'Resistance' AS k, h_at AS f, h_atr AS atr FROM per UNION ALL SELECT instrument, period, span, l, 'Support', l_at, l_atr FROM per
  UNION ALL SELECT instrument, period, span, c, CASE WHEN c > lcl THEN 'Resistance' ELSE 'Support' END, c_at, c_atr FROM per WHERE wc)""",
        lines("ses_z", "ses_l", "price", "k", "f", "atr", "span / atr", "period"),
        finished("ses_z", "ses"),
    ]
)
PROFILE = ", ".join([FOOTPRINT, "ladv AS (SELECT instrument, price, CAST(sum(buy_volume + sell_volume) AS BIGINT) AS volume FROM fp WHERE bucket_start >= TIMESTAMP '2024-01-24' GROUP BY ALL)", area("ladv", "instrument"), "sc AS (SELECT instrument, last(atr ORDER BY bucket_start) AS atr, max(bucket_start) AS formed_at FROM scaled WHERE atr > 0 GROUP BY 1)"])


def volume_levels(kind: str, name: str) -> str:
    where = "price NOT IN (poc, vah, val)" if kind == "traded" else f"price = {kind}"
    seed = {"vah": "'Resistance'", "val": "'Support'"}.get(kind, "'Unknown'")
    period = "CAST(NULL AS VARCHAR)" if kind == "traded" else f"'{kind}'"
    rows = f"{name}_l AS (SELECT ladv.*, atr, formed_at, CASE WHEN total_volume = 0 THEN 0.0 ELSE CAST(volume * levels AS DOUBLE) / total_volume END AS s FROM ladv JOIN va USING (instrument) JOIN sc USING (instrument) WHERE {where})"
    return f"{rows}, {lines(name + '_z', name + '_l', 'price', seed, 'formed_at', 'atr', 's', period)}, {finished(name + '_z', name)}"


METHODS = {"swing": ("sw", "swing"), "session": ("ses", "session")} | {f"pivot-{f}": (f"p_{f}", "pivot") for f in PIVOT_LINES} | {f"volume-{k}": (f"v_{k}", "volume") for k in ("poc", "vah", "val", "traded")}
LEVEL_SET = ", ".join(
    [LEVEL_BARS, PIVOTS, ZONES, finished("zones", "sw"), PERIOD, SESSION_LEVELS]
    + [pivot(f, f"p_{f}") for f in PIVOT_LINES]
    + [PROFILE]
    + [volume_levels(k, f"v_{k}") for k in ("poc", "vah", "val", "traded")]
    + ["lset AS (" + " UNION ALL ".join(f"SELECT *, '{m}' AS method, '{family}' AS family FROM {cte}" for m, (cte, family) in METHODS.items()) + ")"]
)

# --- queries ------------------------------------------------------------------------------------------------------------

BAR = "instrument, bucket_start, open, high, low, close, volume, contract_id"
VALUE = "instrument, indicator, CAST(period AS BIGINT) AS period, bucket_start, round(value, 6) AS value"
RANK = "(2000 + TRY_CAST(regexp_extract(contract_id, '(?:^|\\.)[FGHJKMNQUVXZ]([0-9]{2})$', 1) AS INTEGER)) * 12 + instr('FGHJKMNQUVXZ', regexp_extract(contract_id, '(?:^|\\.)([FGHJKMNQUVXZ])[0-9]{2}$', 1))"
W_KEYS = f"pw AS (SELECT instrument, contract_id, trade_date, open_utc AS window_start, close_utc AS window_end FROM sess, (SELECT DISTINCT instrument, contract_id FROM cov))"
MAPPED_CHANGES = "chn AS (SELECT instrument, trade_time_utc AS t, CASE event_type WHEN 'signup' THEN 'connect' WHEN 'error' THEN 'drop' END AS kind, sequence FROM trades WHERE event_type IN ('signup', 'error')), nx AS (SELECT *, lead(kind) OVER w AS nk, lead(t) OVER w AS na FROM chn WINDOW w AS (PARTITION BY instrument ORDER BY t, sequence))"
TENURE = "tf AS (SELECT instrument, last(contract_id ORDER BY bucket_start) FILTER (WHERE contract_id IS NOT NULL OR true) AS front FROM bars GROUP BY 1), tn AS (SELECT b.instrument, front, coalesce(min(bucket_start) FILTER (WHERE contract_id = front AND bucket_start > coalesce(o, TIMESTAMP '1900-01-01')), TIMESTAMP '2024-01-24 00:00:00') AS tenure_start FROM bars b JOIN tf USING (instrument) LEFT JOIN (SELECT b.instrument, max(bucket_start) AS o FROM bars b JOIN tf USING (instrument) WHERE contract_id IS DISTINCT FROM front GROUP BY 1) x USING (instrument) GROUP BY b.instrument, front)"

ORACLES: dict[str, str] = {
    "bars_window": with_(BARS) + f"SELECT {BAR} FROM bars WHERE instrument = 'ES' AND bucket_start >= TIMESTAMP '2024-01-08' AND bucket_start < TIMESTAMP '2024-01-15'",
    "bars_latest_n": with_(BARS) + f"SELECT {BAR} FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY bucket_start DESC) AS r FROM bars) WHERE r <= 50",
    "trades_window": with_(TRADES) + "SELECT instrument, contract_id, trade_time_utc, sequence, price, size, direction FROM trades WHERE instrument = 'NQ' AND trade_time_utc >= TIMESTAMP '2024-01-10 06:00:00' AND trade_time_utc < TIMESTAMP '2024-01-12'",
    "tape_export": with_(TRADES) + "SELECT DISTINCT instrument, contract_id, CAST(trade_time_utc AS DATE) AS day, CAST(1 AS BIGINT) AS files FROM trades WHERE trade_time_utc < TIMESTAMP '2024-01-31'",
    "export_manifest": with_(TRADES) + "SELECT instrument, contract_id, CAST(trade_time_utc AS DATE) AS day, count(*) AS row_count, true AS hashed FROM trades WHERE trade_time_utc < TIMESTAMP '2024-01-31' GROUP BY ALL",
    "export_verify": with_(TRADES) + "SELECT instrument, contract_id, CAST(trade_time_utc AS DATE) AS day, count(*) AS source_rows, CAST(0 AS BIGINT) AS file_rows FROM trades WHERE CAST(trade_time_utc AS DATE) = DATE '2024-01-07' GROUP BY ALL",
    "export_pending_days": with_(TRADES, COVERAGE, FOOTPRINT, RECEIPTS)
    + """SELECT DISTINCT instrument, day FROM (SELECT instrument, CAST(trade_time_utc AS DATE) AS day FROM trades UNION ALL SELECT instrument, CAST(range_start AS DATE) FROM cov WHERE range_end < TIMESTAMP '9999-12-31' UNION ALL SELECT instrument, CAST(bucket_start AS DATE) FROM fp) x
  WHERE day < DATE '2024-01-31' AND NOT EXISTS (SELECT 1 FROM rec WHERE rec.instrument = x.instrument AND rec.day = x.day)""",
    "tape_import": with_(TRADES) + "SELECT instrument, contract_id, trade_time_utc, sequence, price, size FROM trades WHERE sequence % 3 = 0",
    "bars_upsert": with_(BARS, CHANGED)
    + "SELECT b.instrument, b.bucket_start, b.volume, b.contract_id, CASE WHEN c.instrument IS NULL THEN 'insert' ELSE 'update' END AS change FROM bars b LEFT JOIN chg c USING (instrument, bucket_start) WHERE c.instrument IS NULL OR b.volume <> c.volume OR b.contract_id IS DISTINCT FROM c.contract_id",
    "notes_append": """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'ES' WHEN doc_id % 3 = 1 THEN 'NQ' ELSE CASE WHEN upper(source) IN ('ES', 'NQ', 'MES', 'MNQ') THEN upper(source) END END AS instrument,
  CASE WHEN doc_id % 4 = 0 THEN 'note' ELSE lower(lang) END AS kind, CAST(length(trim(text, ' ')) AS BIGINT) AS text_length, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS recorded_at, sha256(trim(text, ' ')) AS content_hash FROM documents WHERE length(trim(text, ' ')) > 0""",
    "bucket_align": with_(TRADES)
    + """SELECT sequence, time_bucket(INTERVAL 60 MINUTE, trade_time_utc) AS hour, CASE WHEN time_bucket(INTERVAL 60 MINUTE, trade_time_utc) = trade_time_utc THEN trade_time_utc ELSE time_bucket(INTERVAL 60 MINUTE, trade_time_utc) + INTERVAL 60 MINUTE END AS hour_up,
  time_bucket(INTERVAL 660 MINUTE, trade_time_utc, TIMESTAMP '0001-01-01') AS eleven_hours, time_bucket(INTERVAL 5 MINUTE, trade_time_utc) AS five_minutes FROM trades""",
    "trade_date": with_(TRADES) + f"SELECT instrument, {trade_date('trade_time_utc')} AS trade_date, count(*) AS prints, CAST(sum(size) AS BIGINT) AS volume FROM trades GROUP BY ALL",
    "expected_bucket": with_(BARS) + f"SELECT instrument, bucket_start, {expected('bucket_start', 60)} AS expected FROM bars",
    "product_sessions": with_(DAYS, SESSIONS) + "SELECT trade_date, open_utc, close_utc FROM sess",
    "session_windows": with_(DAYS, WINDOWS) + "SELECT session, trade_date, start_utc, end_utc FROM wins",
    "session_trade_dates": with_(DAYS, WINDOWS) + "SELECT session, trade_date FROM wins WHERE start_utc >= TIMESTAMP '2024-01-10 09:00:00' AND end_utc <= TIMESTAMP '2024-01-19 12:00:00'",
    "session_state": with_(DAYS, SESSIONS, f"a AS (SELECT event_id AS sequence, CAST(ts AS TIMESTAMP) AS at_utc, {trade_date('ts')} AS td FROM events)", "b AS (SELECT a.*, s.close_utc AS c, coalesce(at_utc < s.close_utc, false) AS o FROM a LEFT JOIN sess s ON s.trade_date = td)")
    + f"""SELECT sequence, at_utc, o AS is_open, CASE WHEN o THEN td END AS trade_date, CASE WHEN o THEN c END AS close_utc, CASE WHEN o THEN CAST(floor(epoch(c - at_utc) / 60) AS BIGINT) END AS minutes_to_close,
  n.open_utc AS next_open_utc, CAST(CAST({local('at_utc')} AS DATE) AS VARCHAR) IN {HOLIDAYS} AS is_holiday FROM b ASOF LEFT JOIN sess n ON b.at_utc < n.open_utc""",
    "contract_candidates": with_(DAYS, SESSIONS)
    + "SELECT trade_date, CAST(p AS INTEGER) AS position, c || lpad(CAST(y % 100 AS VARCHAR), 2, '0') AS expiry FROM (SELECT trade_date, c, y, row_number() OVER (PARTITION BY trade_date ORDER BY y * 12 + m) AS p FROM sess, (VALUES ('H', 3), ('M', 6), ('U', 9), ('Z', 12)) t(c, m), (SELECT unnest(range(2020, 2030)) AS y) WHERE y * 12 + m >= year(trade_date) * 12 + month(trade_date)) WHERE p <= 3",
    "tick_money": with_(BARS)
    + "SELECT instrument, bucket_start, (close - open) / 0.25 AS ticks, (close - open) * pv AS money, floor(((open + close) / 2) / 0.25 + 0.5) * 0.25 AS middle, 0.25::DOUBLE * pv AS tick_value FROM (SELECT *, CASE WHEN instrument = 'ES' THEN 50.0::DOUBLE ELSE 20.0::DOUBLE END AS pv FROM bars)",
    "account_stage": "SELECT c_custkey AS account_id, CASE c_custkey % 6 WHEN 0 THEN 'practice' WHEN 1 THEN 'funded' WHEN 2 THEN 'evaluation' WHEN 3 THEN 'practice' WHEN 4 THEN 'evaluation' ELSE 'unknown' END AS stage FROM customer",
    "signed_positions": """SELECT position_id, side, size, CASE WHEN side = 'long' THEN size WHEN side = 'short' THEN -size WHEN size = 0 THEN 0 END AS signed, CASE WHEN side = 'flat' AND size <> 0 THEN 'unknown side' END AS error
  FROM (SELECT l_orderkey AS position_id, CASE l_orderkey % 4 WHEN 1 THEN 'short' WHEN 2 THEN 'flat' ELSE 'long' END AS side, CASE WHEN l_orderkey % 8 = 2 THEN 0 ELSE CAST(sum(l_quantity) AS BIGINT) END AS size FROM lineitem GROUP BY l_orderkey)""",
    "fills_window": """SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line, CAST(l_shipdate AS TIMESTAMP) AS created_at, CASE WHEN l_linestatus = 'O' THEN 'buy' WHEN l_returnflag = 'R' THEN 'sell' ELSE 'unknown' END AS side,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_tax AS DOUBLE) ELSE 0.0::DOUBLE END AS fees, l_returnflag = 'A' AS voided, CAST(l_extendedprice AS DOUBLE) AS pnl FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1996-01-01'""",
    "utc_day": with_(TRADES) + "SELECT CAST(trade_time_utc AS DATE) AS day, count(*) AS prints FROM trades WHERE CAST(trade_time_utc AS DATE) < DATE '2024-01-28' GROUP BY 1",
    "bar_gaps": with_(GAP_BASE) + "SELECT instrument, range_start, range_end, buckets FROM gaps",
    "bar_gap_ranges": with_(GAP_BASE) + "SELECT instrument, count(*) AS ranges, CAST(sum(buckets) AS BIGINT) AS buckets, min(range_start) AS first_start, max(range_end) AS last_end FROM gaps GROUP BY 1",
    "indicator_series": with_(AVERAGES) + "SELECT instrument, bucket_start, round(value, 6) AS value FROM held SEMI JOIN bars USING (instrument, bucket_start) WHERE indicator = 'sma'",
    "indicator_asof": with_(AVERAGES, "ok AS (SELECT h.*, b.contract_id FROM held h JOIN bars b USING (instrument, bucket_start))", "ask AS (SELECT sequence AS ask_id, instrument, CASE WHEN sequence % 2 = 0 THEN 'sma' ELSE 'vwap_rolling' END AS indicator, trade_time_utc AS t FROM trades)")
    + "SELECT ask_id, ask.instrument, ask.indicator, bucket_start, round(value, 6) AS value, contract_id FROM ask ASOF JOIN ok ON ask.instrument = ok.instrument AND ask.indicator = ok.indicator AND ask.t >= ok.bucket_start",
    "indicator_latest": with_(AVERAGES) + "SELECT instrument, indicator, period, bucket_start, round(value, 6) AS value, contract_id FROM (SELECT h.*, b.contract_id, row_number() OVER (PARTITION BY instrument, indicator ORDER BY bucket_start DESC) AS r FROM held h JOIN bars b USING (instrument, bucket_start) WHERE bucket_start <= TIMESTAMP '2024-01-25 12:00:00') WHERE r = 1",
    "session_bars": with_(TRADES, DAYS, WINDOWS, session_bars(GAPPY_SELECT, "2024-01-29 12:00:00"))
    + """SELECT instrument, session, trade_date, expected, CASE WHEN absence IS NULL THEN open END AS open, CASE WHEN absence IS NULL THEN high END AS high, CASE WHEN absence IS NULL THEN low END AS low, CASE WHEN absence IS NULL THEN close END AS close,
  CASE WHEN absence IS NULL THEN volume END AS volume, CASE WHEN absence IS NULL THEN contract_id END AS contract_id, absence, CASE WHEN absence = 'Incomplete' THEN expected - held END AS missing FROM sb""",
    "session_indicator_asof": with_(TRADES, DAYS, WINDOWS, session_bars(WHOLE_SELECT, "2024-01-31 00:00:00"), "ss AS (SELECT *, instrument || '/' || session AS k, start_utc AS bucket_start FROM sb WHERE absence IS NULL)", runs("ss", "runs", "k"))
    + "SELECT instrument, session, 'sma' AS indicator, 3 AS period, bucket_start, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY bucket_start DESC) AS r FROM (SELECT *, CASE WHEN rn >= 3 THEN avg(close) OVER (PARTITION BY k, run_id ORDER BY bucket_start ROWS 2 PRECEDING) END AS value FROM runs) WHERE value IS NOT NULL AND end_utc <= TIMESTAMP '2024-01-25 12:00:00') WHERE r = 1",
    "session_bars_upsert": with_(TRADES, DAYS, WINDOWS, session_bars(WHOLE_SELECT, "2024-01-31 00:00:00", "sn"), session_bars(GAPPY_SELECT, "2024-01-20 00:00:00", "so").replace("b30 AS", "b30x AS").replace("b60 AS", "b60x AS").replace("FROM b30 ", "FROM b30x ").replace("FROM b60)", "FROM b60x)"))
    + """SELECT instrument, session, change, count(*) AS rows FROM (SELECT coalesce(n.instrument, o.instrument) AS instrument, coalesce(n.session, o.session) AS session,
    CASE WHEN o.instrument IS NULL THEN 'insert' WHEN n.instrument IS NULL THEN 'delete' WHEN n.base <> CASE WHEN o.session = 'asia' THEN 15 ELSE o.base END OR n.open <> o.open OR n.high <> o.high OR n.low <> o.low OR n.close <> o.close OR n.volume <> o.volume OR n.contract_id <> o.contract_id THEN 'update' END AS change
  FROM (SELECT * FROM sn WHERE absence IS NULL) n FULL JOIN (SELECT * FROM so WHERE absence IS NULL) o ON n.instrument = o.instrument AND n.session = o.session AND n.trade_date = o.trade_date) WHERE change IS NOT NULL GROUP BY ALL""",
    "coverage_overlap": with_(TRADES, COVERAGE, DAYS, SESSIONS, W_KEYS) + "SELECT c.instrument, c.contract_id, trade_date, range_start, range_end FROM cov c JOIN pw w ON c.instrument = w.instrument AND c.contract_id = w.contract_id AND range_start < window_end AND range_end > window_start",
    "coverage_gaps": with_(TRADES, COVERAGE, DAYS, SESSIONS, W_KEYS, "cl AS (SELECT w.*, greatest(range_start, window_start) AS s, least(range_end, window_end) AS e FROM pw w JOIN cov c ON c.instrument = w.instrument AND c.contract_id = w.contract_id AND range_start < window_end AND range_end > window_start)", "pts AS (SELECT instrument, contract_id, window_start, window_end, s, e FROM cl UNION ALL SELECT instrument, contract_id, window_start, window_end, window_end, window_end FROM pw)", "prv AS (SELECT *, coalesce(max(e) OVER (PARTITION BY instrument, contract_id, window_start ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), window_start) AS p FROM pts)")
    + "SELECT instrument, contract_id, window_start, p AS gap_start, s AS gap_end FROM prv WHERE p < s",
    "interval_union": with_(TRADES, COVERAGE, "wd AS (SELECT instrument, contract_id, range_start, range_end + INTERVAL 90 MINUTE AS range_end FROM cov WHERE range_end < TIMESTAMP '2025-01-01')", "fr AS (SELECT *, CASE WHEN range_start <= max(range_end) OVER (PARTITION BY instrument, contract_id ORDER BY range_start, range_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM wd)")
    + "SELECT instrument, contract_id, min(range_start) AS range_start, max(range_end) AS range_end FROM (SELECT *, sum(f) OVER (PARTITION BY instrument, contract_id ORDER BY range_start, range_end ROWS UNBOUNDED PRECEDING) AS g FROM fr) GROUP BY instrument, contract_id, g",
    "covered_window": with_(TRADES, COVERAGE, "cl AS (SELECT instrument, contract_id, greatest(range_start, TIMESTAMP '2024-01-08 12:00:00') AS s, least(range_end, TIMESTAMP '2024-01-22') AS e FROM cov)", "ct AS (SELECT * FROM cl WHERE s < e)", "fc AS (SELECT instrument, first(contract_id ORDER BY e DESC, s DESC, contract_id) AS contract_id FROM ct GROUP BY 1)", "fr AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY instrument ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM ct SEMI JOIN fc USING (instrument, contract_id))", "un AS (SELECT instrument, contract_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY instrument ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM fr) GROUP BY instrument, contract_id, g)")
    + "SELECT instrument, contract_id, s AS range_start, e AS range_end, s > TIMESTAMP '2024-01-08 12:00:00' OR e < TIMESTAMP '2024-01-22' AS narrowed FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY s DESC) AS r FROM un) WHERE r = 1",
    "ranges_answered": with_(GAP_BASE, MEMO, f"sl AS (SELECT instrument, range_start AS slice_start, range_end AS slice_end, CASE WHEN {EPOCH_HOUR.format('range_start')} % 7 = 0 THEN [] WHEN {EPOCH_HOUR.format('range_start')} % 3 = 0 THEN ['H24'] ELSE ['H24', 'M24'] END AS c FROM gaps)")
    + "SELECT instrument, slice_start, slice_end, CAST(len(c) AS BIGINT) AS candidates, len(c) > 0 AND (SELECT count(DISTINCT contract_id) FROM memo m WHERE m.instrument = sl.instrument AND list_contains(c, right(m.contract_id, 3)) AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-25 12:00:00') AND range_start <= slice_start AND range_end >= slice_end) = len(c) AS answered FROM sl",
    "receipt_source_counts": with_(TRADES, RECEIPTS) + "SELECT instrument, contract_id, day, row_count, coalesce(source_rows, 0) AS source_rows, last_recorded FROM rec LEFT JOIN src USING (instrument, contract_id, day)",
    "receipts_missing": with_(TRADES, RECEIPTS) + "SELECT instrument, contract_id, day, source_rows FROM src WHERE day = DATE '2024-01-05'",
    "notes_unsearchable": "SELECT lang AS kind, count(*) AS notes FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY 1",
    "bars_overlapping_window": with_(BARS) + f"SELECT {BAR} FROM bars WHERE bucket_start < TIMESTAMP '2024-01-11 08:15:00' AND bucket_start + INTERVAL 60 MINUTE > TIMESTAMP '2024-01-10 03:30:00'",
    "contract_roll_seam": with_(BARS, VOLUMES, FRONT, FLIP, "near AS (SELECT b.* FROM bars b JOIN flip f USING (instrument) WHERE flipped_at IS NOT NULL AND bucket_start >= flipped_at - INTERVAL 2 DAY AND bucket_start <= least(flipped_at + INTERVAL 2 DAY, TIMESTAMP '2024-01-25 12:00:00'))", runs("near"))
    + "SELECT instrument, run_id, contract_id, min(bucket_start) AS first_bucket, max(bucket_start) AS last_bucket, count(*) AS bars FROM runs GROUP BY ALL",
    "notes_embedding_reuse": "SELECT d.doc_id AS id, g.from_id FROM documents d JOIN (SELECT trim(text, ' ') AS t, min(doc_id) AS from_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings) GROUP BY 1) g ON trim(d.text, ' ') = g.t WHERE d.doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "footprint": with_(TRADES, FOOTPRINT) + "SELECT instrument, bucket_start, price, buy_volume, sell_volume FROM fp",
    "volume_ladder": with_(TRADES, FOOTPRINT, LADDER) + "SELECT instrument, day, price, volume FROM lad",
    "point_of_control": with_(TRADES, FOOTPRINT, LADDER, poc("lad", "instrument, day")) + "SELECT instrument, day, price, volume FROM poc",
    "value_area": with_(TRADES, FOOTPRINT, LADDER, area("lad", "instrument, day")) + "SELECT instrument, day, poc, val, vah, area_volume, total_volume, levels FROM va",
    "session_contract_volume": with_(TRADES, VOLUMES) + "SELECT instrument, trade_date, contract_id, volume FROM vol",
    "volume_front": with_(TRADES, VOLUMES, FRONT) + "SELECT * FROM front",
    "front_flip_instant": with_(TRADES, VOLUMES, FRONT, FLIP) + "SELECT * FROM flip",
    "front_vs_gateway": with_(TRADES, VOLUMES, FRONT, "pk AS (SELECT instrument, last(contract_id ORDER BY trade_time_utc, sequence) AS picked FROM trades WHERE instrument <> 'NQ' GROUP BY 1)")
    + "SELECT coalesce(f.instrument, p.instrument) AS instrument, active, picked, coalesce(picked, active) AS used, coalesce(active = picked, false) AS agree, CASE WHEN active IS NULL AND picked IS NULL THEN 'none' WHEN active IS NULL THEN 'no tape front' WHEN picked IS NULL THEN 'no gateway pick' WHEN active = picked THEN 'agree' ELSE 'differ' END AS why FROM front f FULL JOIN pk p ON f.instrument = p.instrument",
    "historical_contract": with_(TRADES, BY_CONTRACT, DATED, f"st AS (SELECT instrument, td AS trade_date, max(contract_id) AS stored FROM (SELECT *, {trade_date('bucket_start')} AS td FROM byc) WHERE td IS NOT NULL AND day(td) % 4 = 0 GROUP BY ALL)", "vs AS (SELECT instrument, trade_date, contract_id, CAST(sum(volume) AS BIGINT) AS volume FROM dated GROUP BY ALL)")
    + f"SELECT instrument, trade_date, contract_id, volume, offered FROM (SELECT vs.*, count(*) OVER (PARTITION BY instrument, trade_date) AS offered, row_number() OVER (PARTITION BY instrument, trade_date ORDER BY coalesce(contract_id = stored, false) DESC, volume DESC, {RANK} NULLS LAST, contract_id) AS r FROM vs LEFT JOIN st USING (instrument, trade_date)) WHERE r = 1",
    "last_tick": with_(TRADES) + "SELECT instrument, contract_id, max(trade_time_utc) AS last_tick, count(*) AS prints FROM trades WHERE trade_time_utc >= TIMESTAMP '2024-01-05' AND trade_time_utc < TIMESTAMP '2024-01-20' GROUP BY ALL",
    "contract_coverage": with_(
        TRADES,
        bars("known"),
        bars("odd", contract=UNKNOWN_CONTRACT),
        "mix AS (SELECT instrument, 60 AS m, bucket_start, contract_id FROM known WHERE instrument = 'ES' UNION ALL SELECT instrument, 60, bucket_start, contract_id FROM odd WHERE instrument = 'NQ' UNION ALL SELECT instrument, 61, bucket_start, contract_id FROM odd WHERE bucket_start < TIMESTAMP '2024-01-12' UNION ALL SELECT instrument, 62, bucket_start, contract_id FROM known WHERE bucket_start < TIMESTAMP '2024-01-12')",
        "st AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(contract_id) OVER w IS DISTINCT FROM contract_id THEN 1 ELSE 0 END AS step FROM mix WINDOW w AS (PARTITION BY instrument, m ORDER BY bucket_start))",
    )
    + "SELECT instrument, m AS resolution_minutes, CAST(1 + sum(step) AS BIGINT) AS runs, count(DISTINCT contract_id) AS contracts, CASE WHEN count(DISTINCT contract_id) >= 2 THEN 'SpansRoll' WHEN count(*) > count(contract_id) OR sum(step) > 0 THEN 'Unknown' ELSE 'SingleContract' END AS span FROM st GROUP BY ALL",
    "available_range": with_(GAPPY) + "SELECT instrument, 60 AS resolution_minutes, min(bucket_start) AS first_bucket, max(bucket_start) AS last_bucket, count(*) AS bars FROM bars WHERE bucket_start >= TIMESTAMP '2024-01-09 05:00:00' GROUP BY 1",
    "tie_days": with_(TRADES, BY_CONTRACT, DATED, "vs AS (SELECT instrument, trade_date, contract_id, count(*) AS volume FROM dated GROUP BY ALL)")
    + "SELECT instrument, trade_date, count(*) AS leaders, max(volume) AS volume FROM (SELECT *, max(volume) OVER (PARTITION BY instrument, trade_date) AS top FROM vs) WHERE volume = top GROUP BY ALL HAVING count(*) > 1",
    "newest_per_indicator": with_(AVERAGES) + "SELECT instrument, indicator, period, max(bucket_start) AS newest FROM held GROUP BY ALL",
    "contract_cap_usage": f"SELECT user_id AS account_id, CASE WHEN {minute_of('ts')} >= 1020 THEN CAST(CAST({local('ts')} AS DATE) + INTERVAL 1 DAY AS DATE) ELSE CAST({local('ts')} AS DATE) END AS cap_day, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS contracts FROM events WHERE event_type = 'purchase' GROUP BY ALL",
    "contract_segments": with_(UNKNOWN, runs()) + "SELECT instrument, run_id, contract_id, min(bucket_start) AS first_bucket, max(bucket_start) AS last_bucket, count(*) AS bars FROM runs GROUP BY ALL",
    "newest_segment": with_(BARS, runs()) + f"SELECT {BAR} FROM runs WHERE run_id = (SELECT max(run_id) FROM runs r WHERE r.instrument = runs.instrument)",
    "indicator_catalogue": with_(BARS, runs(), CATALOGUE) + "SELECT instrument, bucket_start, indicator, CAST(period AS BIGINT) AS period, round(value, 6) AS value FROM cat",
    "heikin_ashi": with_(BARS, runs(), HEIKIN)
    + "SELECT instrument, bucket_start, round(ha_open, 6) AS ha_open, round(ha_close, 6) AS ha_close, round(greatest(ha_open, ha_close), 6) AS body_high, round(least(ha_open, ha_close), 6) AS body_low FROM ho",
    "swing_pivots": with_(BARS, runs(), "scaled AS (SELECT *, 1.0 AS atr FROM runs)", PIVOTS.replace("PARTITION BY instrument", f"PARTITION BY {RUN}")) + "SELECT instrument, bucket_start, price, kind, prominence FROM pv",
    "tenure_start": with_(UNKNOWN, TENURE) + "SELECT instrument, front, tenure_start FROM tn",
    "zones_from_pivots": with_(LEVEL_BARS, PIVOTS, ZONES) + ZONE_OUT + "zones",
    "merge_zones": with_(LEVEL_BARS, PIVOTS, ZONES, merged("zones", "mz")) + ZONE_OUT + "mz",
    "zone_width_cap": with_(LEVEL_BARS, PIVOTS, ZONES) + ZONE_OUT + "zones WHERE (top - bottom) * 100 <= 60.0 * (top + bottom) / 2",
    "relabel_zones": with_(LEVEL_BARS, PIVOTS, ZONES, "rl AS (SELECT z.* REPLACE (CASE WHEN top < last_close THEN 'Support' WHEN bottom > last_close THEN 'Resistance' ELSE kind END AS kind) FROM zones z JOIN lc USING (instrument))") + ZONE_OUT + "rl",
    "zone_level_cap": with_(LEVEL_BARS, PIVOTS, ZONES) + ZONE_OUT + "(SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY significance DESC, touches DESC, bottom, top, formed_at, kind) AS r FROM zones) WHERE r <= 12",
    "levels_swing_default": with_(LEVEL_BARS, HEIKIN.replace("FROM runs)", "FROM scaled)") + ", hb AS (SELECT * REPLACE (round(greatest(ha_open, ha_close), 8) AS high, round(least(ha_open, ha_close), 8) AS low) FROM ho)",
        PIVOTS.replace("FROM scaled", "FROM hb").replace("5 PRECEDING", "20 PRECEDING").replace("3 FOLLOWING", "15 FOLLOWING").replace("rn > 5", "rn > 20").replace("n - 3", "n - 15"), ZONES.replace(">= 0.1", ">= 0.0")) + ZONE_OUT + "zones",
    "level_extension": with_(LEVEL_BARS) + "SELECT instrument, 'round-number' AS method, 'round' AS family, CASE WHEN p - 0.25 > c THEN 'Resistance' ELSE 'Support' END AS kind, p - 0.25 AS bottom, p + 0.25 AS top, CAST(1 AS BIGINT) AS touches FROM (SELECT instrument, last_close AS c, CAST(ceil(last_close) AS DOUBLE) AS p FROM lc)",
    "indicator_extension": with_(UNKNOWN, runs()) + f"""SELECT instrument, bucket_start, 'range_mean' AS indicator, CAST(10 AS BIGINT) AS period, round(v, 6) AS value FROM (SELECT *, avg(high - low) OVER (PARTITION BY {RUN} ORDER BY bucket_start ROWS 9 PRECEDING) AS v FROM runs) WHERE rn >= 10
  UNION ALL SELECT instrument, bucket_start, 'sma', 20, round(v, 6) FROM (SELECT *, avg(close) OVER (PARTITION BY {RUN} ORDER BY bucket_start ROWS 19 PRECEDING) AS v FROM runs) WHERE rn >= 20""",
    "seeded_mean": with_(UNKNOWN, runs(), f"hx AS (SELECT *, min(CASE WHEN day(bucket_start) % 5 = 0 AND hour(bucket_start) = 13 AND rn > 7 THEN rn END) OVER (PARTITION BY {RUN}) AS stop FROM runs)", smoothed("hx", "e", "close", 3, 5, "2.0 / 6")) + "SELECT instrument, bucket_start, round(y, 6) AS value FROM e WHERE y IS NOT NULL AND (stop IS NULL OR rn < stop)",
    "coverage_export": with_(TRADES, COVERAGE) + "SELECT instrument, contract_id, CAST(range_start AS DATE) AS day, range_start, range_end, range_end AS recorded_at FROM cov WHERE year(range_end) < 9999 AND range_start < TIMESTAMP '2024-01-31'",
    "footprint_export": with_(TRADES, FOOTPRINT) + "SELECT instrument, CAST(bucket_start AS DATE) AS day, bucket_start, price, buy_volume, sell_volume, bucket_start + INTERVAL 60 MINUTE AS recorded_at FROM fp WHERE bucket_start < TIMESTAMP '2024-01-31'",
    "levels_swing": with_(LEVEL_BARS, PIVOTS, ZONES, finished("zones", "sw")) + ZONE_OUT + "sw",
    "levels_session": with_(LEVEL_BARS, PERIOD, SESSION_LEVELS) + ZONE_OUT + "ses",
    "level_set": with_(LEVEL_SET) + "SELECT instrument, method, kind, round(bottom, 6) AS bottom, round(top, 6) AS top, round(significance, 6) AS significance, touches FROM lset",
    "confluence": with_(LEVEL_SET, "cf_0 AS (SELECT *, CASE WHEN bottom <= max(top) OVER (PARTITION BY instrument ORDER BY bottom, top ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM lset)", "cf AS (SELECT *, sum(f) OVER (PARTITION BY instrument ORDER BY bottom, top ROWS UNBOUNDED PRECEDING) AS g FROM cf_0)", "mt AS (SELECT DISTINCT instrument, g, family, method, CASE method WHEN 'swing' THEN 2.0::DOUBLE WHEN 'volume-poc' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM cf)", "fm AS (SELECT instrument, g, family, max(w) AS w, count(*) AS m FROM mt GROUP BY ALL)", "sc2 AS (SELECT instrument, g, sum(w) AS score, CAST(sum(m) AS BIGINT) AS methods FROM fm GROUP BY ALL)")
    + "SELECT instrument, score, methods FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY score DESC, g) AS r FROM sc2) WHERE r = 1",
    "last_closed_sessions": with_(DAYS, WINDOWS) + "SELECT session, trade_date, start_utc, end_utc FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY trade_date DESC) AS r FROM wins WHERE end_utc <= TIMESTAMP '2024-01-25 12:00:00') WHERE r <= 5",
    "front_month_order": with_(TRADES, "c AS (SELECT instrument, contract_id, max(size) % 2 = 0 AS active FROM trades GROUP BY ALL)", "u AS (SELECT * FROM c UNION ALL SELECT instrument, contract_id || '?', false FROM c)") + f"SELECT instrument, contract_id, active, row_number() OVER (PARTITION BY instrument ORDER BY active DESC, {RANK} NULLS LAST, contract_id) AS position FROM u",
    "notes_semantic_topk": """WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT query_id, vec_id AS owner_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) AS s FROM q, embeddings)
SELECT query_id, rank, owner_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, owner_id) AS rank FROM p) WHERE rank <= 5""",
    "notes_text_search": "SELECT doc_id AS id, lang AS kind, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS recorded_at FROM documents WHERE text ILIKE '%the%' ORDER BY doc_id DESC LIMIT 20",
    "series_discovery": with_(AVERAGES) + "SELECT DISTINCT 'SIM' AS venue, instrument, CAST(60 AS BIGINT) AS resolution_minutes FROM (SELECT instrument FROM bars UNION ALL SELECT instrument FROM held UNION ALL SELECT instrument || '-old' FROM held WHERE indicator = 'sma')",
    "bars_dedupe": with_(BARS) + f"SELECT {BAR} FROM bars",
    "indicator_project": with_(ALL_VALUES) + f"SELECT {VALUE.replace('round(value', 'round(m.value')}, CASE WHEN s.value IS NULL THEN 'insert' ELSE 'update' END AS change FROM made m LEFT JOIN stored s USING (instrument, bucket_start, indicator, period) WHERE s.value IS NULL OR abs(m.value - s.value) > 5e-9",
    "indicator_reconcile": with_(ALL_VALUES) + f"SELECT {VALUE}, CASE WHEN NOT EXISTS (SELECT 1 FROM bars b WHERE b.instrument = x.instrument AND b.bucket_start = x.bucket_start) THEN 'orphaned' WHEN period = 99 THEN 'retired' ELSE 'unjustified' END AS reason FROM (SELECT * FROM stored ANTI JOIN made USING (instrument, bucket_start, indicator, period)) x",
    "indicator_completeness": with_(ALL_VALUES, "need AS (SELECT * FROM (VALUES ('atr', 14, 15), ('rsi', 14, 15), ('adx', 14, 28), ('plus_di', 14, 15), ('minus_di', 14, 15), ('sma', 20, 20), ('ema', 20, 20), ('macd', 26, 26), ('macd_signal', 26, 34), ('macd_histogram', 26, 34), ('vwap', 1, 1), ('bb_middle', 20, 20), ('bb_upper', 20, 20), ('bb_lower', 20, 20), ('vwap_rolling', 20, 20)) t(indicator, period, warmup))", "rk AS (SELECT instrument, bucket_start, row_number() OVER (PARTITION BY instrument ORDER BY bucket_start DESC) AS r FROM bars)", "nw AS (SELECT instrument, indicator, period, max(bucket_start) AS newest FROM stored WHERE indicator <> 'bb_upper' AND bucket_start < CASE WHEN indicator IN ('sma', 'rsi') THEN TIMESTAMP '2024-01-20' ELSE TIMESTAMP '2024-01-31' END GROUP BY ALL)")
    + "SELECT instrument, indicator, CAST(period AS BIGINT) AS period, rk.bucket_start AS due_from, newest, coalesce(newest < rk.bucket_start, true) AS missing FROM need JOIN rk ON r = warmup LEFT JOIN nw USING (instrument, indicator, period)",
    "indicator_rebuild": with_(ALL_VALUES, "c AS (SELECT instrument, count(*) AS changed FROM made m LEFT JOIN stored s USING (instrument, bucket_start, indicator, period) WHERE s.value IS NULL OR abs(m.value - s.value) > 5e-9 GROUP BY 1)", "g AS (SELECT instrument, count(*) AS removed FROM stored ANTI JOIN made USING (instrument, bucket_start, indicator, period) GROUP BY 1)") + "SELECT instrument, coalesce(changed, 0) AS changed, coalesce(removed, 0) AS removed FROM c FULL JOIN g USING (instrument)",
    "coverage_memo": with_(GAP_BASE, MEMO) + "SELECT * FROM (SELECT instrument, contract_id, range_start, least(range_end, TIMESTAMP '2024-01-20 06:30:00') AS range_end, CAST(NULL AS TIMESTAMP) AS expires_at FROM memo UNION ALL SELECT instrument, contract_id, greatest(range_start, TIMESTAMP '2024-01-20 06:30:00'), range_end, TIMESTAMP '2024-01-22 06:45:00' FROM memo) WHERE range_start < range_end",
    "retention_plan": with_(TRADES, RECEIPTS, PLAN) + "SELECT instrument, contract_id, day, row_count, source_rows, action FROM plan UNION ALL SELECT instrument, contract_id, day, NULL, source_rows, 'keep' FROM src WHERE day = DATE '2024-01-05'",
    "retention_apply": with_(TRADES, RECEIPTS, PLAN) + "SELECT t.instrument, t.contract_id, trade_time_utc, sequence, price, size FROM trades t LEFT JOIN (SELECT * FROM plan WHERE action = 'delete') p ON p.instrument = t.instrument AND p.contract_id = t.contract_id AND p.day = CAST(trade_time_utc AS DATE) WHERE p.day IS NULL OR recorded_at > exported_at",
    "late_rows": with_(TRADES, RECEIPTS) + "SELECT t.instrument, t.contract_id, day, count(*) AS late, max(recorded_at) AS last_recorded FROM trades t JOIN rec r ON r.instrument = t.instrument AND r.contract_id = t.contract_id AND r.day = CAST(trade_time_utc AS DATE) WHERE recorded_at > exported_at GROUP BY ALL",
    "late_rows_stream": with_(TRADES, "ld AS (SELECT *, CASE WHEN sequence % 50 = 0 THEN 2 ELSE least((day(trade_time_utc) - 1) // 10, 2) END AS l FROM trades)")
    + "SELECT instrument, contract_id, CAST(trade_time_utc AS DATE) AS day, count(*) AS late, min(trade_time_utc) AS first_at, max(l) AS last_batch FROM ld a WHERE CAST(trade_time_utc AS DATE) + INTERVAL 1 DAY + INTERVAL 10 MINUTE <= (SELECT max(b.trade_time_utc) FROM ld b WHERE b.instrument = a.instrument AND b.contract_id = a.contract_id AND b.l < a.l) GROUP BY ALL",
    "source_live_prints": with_(TRADES) + "SELECT instrument, contract_id, trade_time_utc, sequence, price, size, direction FROM trades",
    "stream_tape": with_(TRADES) + "SELECT instrument, contract_id, trade_time_utc, price, size, row_number() OVER (PARTITION BY instrument, contract_id ORDER BY trade_time_utc, sequence) AS sequence FROM trades WHERE sequence % 97 <> 0",
    "stream_coverage": with_(TRADES, MAPPED_CHANGES) + "SELECT instrument, t AS range_start, na AS range_end FROM nx WHERE kind = 'connect' AND nk = 'drop' AND t < na",
    "batch_coverage": with_(TRADES, MAPPED_CHANGES) + "SELECT instrument, t AS range_start, coalesce(na, TIMESTAMP '9999-12-31') AS range_end FROM nx WHERE kind = 'connect' AND (nk IS NULL OR nk = 'drop') AND t < coalesce(na, TIMESTAMP '9999-12-31')",
    "stream_print_gate": with_(TRADES, COVERAGE) + "SELECT instrument, contract_id, trade_time_utc, sequence, price, size FROM trades t WHERE EXISTS (SELECT 1 FROM cov c WHERE c.instrument = t.instrument AND c.contract_id = t.contract_id AND day(range_start) % 3 <> 0 AND range_start <= trade_time_utc AND range_end > trade_time_utc)",
    "stream_footprint": with_(TRADES, FOOTPRINT) + "SELECT instrument, bucket_start, price, buy_volume, sell_volume FROM fp WHERE bucket_start + INTERVAL 60 MINUTE <= (SELECT max(trade_time_utc) FROM fp_0) - INTERVAL 10 MINUTE",
    "footprint_project": with_(TRADES, FOOTPRINT, f"sf AS (SELECT instrument, bucket_start, price, CASE WHEN {HOUR} % 13 = 0 THEN buy_volume + 1 ELSE buy_volume END AS b, sell_volume AS s FROM fp WHERE {HOUR} % 11 <> 0 UNION ALL SELECT instrument, bucket_start, price + 1000, buy_volume, sell_volume FROM fp WHERE {HOUR} % 17 = 0)")
    + "SELECT coalesce(fp.instrument, sf.instrument) AS instrument, coalesce(fp.bucket_start, sf.bucket_start) AS bucket_start, coalesce(fp.price, sf.price) AS price, buy_volume, sell_volume, CASE WHEN sf.price IS NULL THEN 'insert' WHEN fp.price IS NULL THEN 'delete' ELSE 'update' END AS change FROM fp FULL JOIN sf ON fp.instrument = sf.instrument AND fp.bucket_start = sf.bucket_start AND fp.price = sf.price WHERE sf.price IS NULL OR fp.price IS NULL OR b <> buy_volume OR s <> sell_volume",
    "footprint_fresh": with_(TRADES, FOOTPRINT) + "SELECT DISTINCT instrument, instrument <> 'ES' AS fresh FROM fp",
}
ORACLES |= {name: indicator(name) for name in INDICATORS}
ORACLES |= {f"levels_pivot_{f}": with_(LEVEL_BARS, PERIOD, pivot(f, "pl")) + ZONE_OUT + "pl" for f in PIVOT_LINES}
ORACLES |= {f"levels_volume_{k}": with_(LEVEL_BARS, PROFILE, volume_levels(k, "vl")) + ZONE_OUT + "vl" for k in ("poc", "vah", "val", "traded")}

_FILE_ROWS = with_(TRADES) + "SELECT instrument, contract_id, CAST(trade_time_utc AS DATE) AS day, trade_time_utc, sequence, price, size, direction, recorded_at FROM trades WHERE trade_time_utc < TIMESTAMP '2024-01-31'"
QUOTES = f"""qe AS (SELECT contract_id, trade_time_utc, sequence, event_type <> 'purchase' AS book, struct_pack(bid := CASE WHEN event_type <> 'purchase' THEN price - 0.25 ELSE 0.0::DOUBLE END, ask := CASE WHEN event_type <> 'purchase' THEN price + 0.25 ELSE 0.0::DOUBLE END,
    last := CASE WHEN event_type = 'purchase' THEN price ELSE 0.0::DOUBLE END, volume := CASE WHEN event_type = 'purchase' THEN size ELSE 0 END, last_at := CASE WHEN event_type = 'purchase' THEN trade_time_utc END, volume_at := CASE WHEN event_type = 'purchase' THEN trade_time_utc END,
    quote_time_utc := CASE WHEN event_type <> 'purchase' THEN trade_time_utc END, received_at := trade_time_utc, trade_date := {trade_date('trade_time_utc')}, book := event_type <> 'purchase') AS q FROM trades WHERE event_type IN ('view', 'click', 'purchase')),
qs AS (SELECT contract_id, list(q ORDER BY trade_time_utc, sequence) AS l FROM qe SEMI JOIN (SELECT contract_id FROM qe WHERE book) USING (contract_id) WHERE trade_time_utc >= (SELECT min(trade_time_utc) FROM qe b WHERE b.book AND b.contract_id = qe.contract_id) GROUP BY 1)"""


def _carry(value: str, zero: str) -> str:
    at = f"{value}_at"
    taken = f"b.{value} <> 0 AND NOT coalesce(b.{at} < a.{at}, false)"
    kept = f"a.{value} <> 0 AND a.{at} IS NOT NULL AND a.trade_date IS NOT DISTINCT FROM b.trade_date AND abs(epoch(b.received_at) - epoch(a.{at})) <= 1800"
    return f"{value} := CASE WHEN {taken} THEN b.{value} WHEN {kept} THEN a.{value} ELSE {zero} END, {at} := CASE WHEN {taken} THEN b.{at} WHEN {kept} THEN a.{at} END"


def _fold() -> str:
    last, volume = _carry("last", "0.0::DOUBLE").split(", last_at := "), _carry("volume", "0").split(", volume_at := ")
    return f"list_reduce(l, lambda a, b: struct_pack(bid := CASE WHEN b.book THEN b.bid ELSE a.bid END, ask := CASE WHEN b.book THEN b.ask ELSE a.ask END, {last[0]}, {volume[0]}, last_at := {last[1]}, volume_at := {volume[1]}, quote_time_utc := greatest(a.quote_time_utc, b.quote_time_utc), received_at := b.received_at, trade_date := b.trade_date, book := true))"


LATEST = f"lq AS (SELECT contract_id, {', '.join('r.' + c + ' AS ' + c for c in ('bid', 'ask', 'last', 'volume', 'last_at', 'volume_at', 'quote_time_utc', 'received_at', 'trade_date'))} FROM (SELECT contract_id, {_fold()} AS r FROM qs))"
_LATEST = with_(TRADES, QUOTES, LATEST) + "SELECT * FROM lq"
SLICES = f"""{TENURE}, gp AS (SELECT instrument, front, tenure_start, s AS range_start, e AS range_end FROM tn, (VALUES (TIMESTAMP '2023-12-05 03:00:00', TIMESTAMP '2024-01-05'), (TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-18 06:00:00')) t(s, e)),
ed AS (SELECT instrument, front, range_start, least(range_end, tenure_start) AS e0, unnest(generate_series(date_trunc('day', range_start), date_trunc('day', least(range_end, tenure_start)) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d0 FROM gp WHERE range_start < tenure_start),
ee AS (SELECT *, CAST(d0 AS DATE) AS d FROM ed),
ds AS (SELECT *, greatest(range_start, {session_open('d')}) AS s, least(e0, {at_minute('d', 1020)}) AS e FROM ee),
cn AS (SELECT d, list(c || lpad(CAST(y % 100 AS VARCHAR), 2, '0') ORDER BY y * 12 + m)[1:2] AS x, min(y * 12 + m) AS nearest FROM (SELECT DISTINCT d FROM ds), (VALUES ('H', 3), ('M', 6), ('U', 9), ('Z', 12)) t(c, m), (SELECT unnest(range(2020, 2030)) AS y) WHERE y * 12 + m >= year(d) * 12 + month(d) GROUP BY d),
ct AS (SELECT instrument, front, range_start, nearest, min(s) AS slice_start, max(e) AS slice_end, any_value(x) AS x FROM ds JOIN cn USING (d) WHERE s < e GROUP BY ALL),
li AS (SELECT DISTINCT instrument, contract_id, right(contract_id, 3) AS expiry FROM trades),
wl AS (SELECT ct.*, unnest(x) AS expiry FROM ct),
sl AS (SELECT instrument, front, slice_start, slice_end, coalesce(string_agg(contract_id, ',' ORDER BY contract_id), any_value(front)) AS candidates, coalesce(string_agg(expiry, ',' ORDER BY expiry) FILTER (WHERE contract_id IS NULL), '') AS unresolved, CASE WHEN count(contract_id) = 0 THEN 2 WHEN count(contract_id) < count(*) THEN 1 ELSE 0 END AS rank
  FROM wl LEFT JOIN li USING (instrument, expiry) GROUP BY instrument, front, slice_start, slice_end
  UNION ALL SELECT instrument, front, greatest(range_start, tenure_start), range_end, front, '', 0 FROM gp WHERE range_end > tenure_start)"""
SLICES = SLICES.replace("any_value(front)", "front")
RESELECT = f"""vs AS (SELECT instrument, trade_date, contract_id, CAST(sum(volume) AS BIGINT) AS volume FROM dated GROUP BY ALL),
ch AS (SELECT instrument, trade_date, contract_id AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY instrument, trade_date ORDER BY volume DESC, {RANK} NULLS LAST, contract_id) AS r FROM vs) WHERE r = 1),
wn AS (SELECT d.* FROM dated d JOIN ch c ON d.instrument = c.instrument AND d.trade_date = c.trade_date AND d.contract_id = c.chosen),
rv AS (SELECT w.instrument, count(*) AS n FROM wn w LEFT JOIN bars b ON b.instrument = w.instrument AND b.bucket_start = w.bucket_start WHERE b.instrument IS NULL OR b.open <> w.open OR b.high <> w.high OR b.low <> w.low OR b.close <> w.close OR b.volume <> w.volume OR b.contract_id IS DISTINCT FROM w.contract_id GROUP BY 1),
sd AS (SELECT b.*, chosen, x.trade_date FROM (SELECT *, coalesce({trade_date('bucket_start')}, CAST(bucket_start AS DATE)) AS trade_date FROM bars) x JOIN ch USING (instrument, trade_date) JOIN bars b ON b.instrument = x.instrument AND b.bucket_start = x.bucket_start),
rm AS (SELECT * FROM sd WHERE contract_id IS DISTINCT FROM chosen AND NOT EXISTS (SELECT 1 FROM wn w WHERE w.instrument = sd.instrument AND w.bucket_start = sd.bucket_start)),
cd AS (SELECT DISTINCT m.* FROM memo m JOIN ch ON m.instrument = ch.instrument AND m.range_start < {ordinary_close('trade_date')} AND m.range_end > {session_open('trade_date')})"""
_RESELECT = (
    with_(UNKNOWN, GAP_BASE.replace(GAPPY + ", ", "").replace("FROM bars", "FROM gbars"), MEMO, BY_CONTRACT, DATED, RESELECT).replace("days AS (", bars("gbars", where="WHERE " + HOUR + " % 97 <> 0") + ", days AS (", 1)
    + """SELECT i.instrument, (SELECT count(*) FROM ch WHERE ch.instrument = i.instrument) AS dates, coalesce((SELECT n FROM rv WHERE rv.instrument = i.instrument), 0) AS revised,
  (SELECT count(*) FROM rm WHERE rm.instrument = i.instrument) AS removed, (SELECT count(*) FROM rm WHERE rm.instrument = i.instrument AND contract_id IS NULL) AS unattributed,
  (SELECT count(DISTINCT trade_date) FROM sd WHERE sd.instrument = i.instrument AND contract_id IS DISTINCT FROM chosen) AS dates_changed, (SELECT count(*) FROM cd WHERE cd.instrument = i.instrument) AS coverage_dropped FROM (SELECT DISTINCT instrument FROM trades) i"""
)
ORACLES |= {
    "tape_read_csv": _FILE_ROWS,
    "tape_read_parquet": _FILE_ROWS,
    "latest_quote": _LATEST,
    "latest_quote_stream": _LATEST,
    "latest_quote_upsert": _LATEST,
    "candidate_slices": with_(UNKNOWN, SLICES) + "SELECT instrument, slice_start, slice_end, candidates, unresolved FROM sl",
    "history_selection": with_(UNKNOWN, SLICES) + "SELECT instrument, CAST(max(rank) AS BIGINT) AS rank, array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN unresolved = '' THEN [] ELSE string_split(unresolved, ',') END)))), ',') AS unresolved, count(*) AS slices FROM sl GROUP BY 1",
    "reselect_bars": _RESELECT,
    "bucket_overhang": with_(BARS, DAYS, SESSIONS, f"st AS (SELECT m, unnest(generate_series(open_utc, ordinary_close - INTERVAL 1 MINUTE, to_minutes(m))) AS t FROM sess, (VALUES (30), (60), (240)) v(m))", f"gr AS (SELECT m, bool_or(NOT coalesce({trade_date('t')} IS NOT NULL AND t + to_minutes(m) <= {ordinary_close(trade_date('t'))}, false)) AS o FROM st GROUP BY 1)", f"ow AS (SELECT instrument, bool_or(NOT {expected('bucket_start', 60)}) AS o FROM bars GROUP BY 1)")
    + "SELECT m AS resolution_minutes, instrument, gr.o OR coalesce(ow.o, false) AS overhangs FROM gr LEFT JOIN ow ON m = 60",
    "series_guard": with_(UNKNOWN, "ar AS (SELECT *, CASE WHEN n % 50 = 0 THEN 2 * (n + 2) + 1 ELSE 2 * n END AS arrival FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY bucket_start) AS n FROM bars))", "pr AS (SELECT *, row_number() OVER w AS k, lag(bucket_start) OVER w AS pb, lag(contract_id) OVER w AS pc FROM ar WINDOW w AS (PARTITION BY instrument ORDER BY arrival))")
    + "SELECT instrument, arrival, bucket_start, 'not_ascending' AS violation FROM pr WHERE k > 1 AND bucket_start <= pb UNION ALL SELECT instrument, arrival, bucket_start, 'contract_change' FROM pr WHERE k > 1 AND contract_id IS DISTINCT FROM pc",
    "quote_read": with_(TRADES, QUOTES, LATEST, VOLUMES, FRONT, "mx AS (SELECT max(trade_time_utc) AS t FROM trades WHERE event_type IN ('view', 'click', 'purchase'))", f"md AS (SELECT t, {trade_date('t')} AS d FROM mx)")
    + """SELECT instrument, f.active AS contract_id, CASE WHEN f.active IS NULL THEN 'unknown_symbol' WHEN received_at IS NULL THEN 'missing' ELSE 'ok' END AS status, nullif(bid, 0) AS bid, nullif(ask, 0) AS ask,
  CASE WHEN last <> 0 AND abs(trunc(epoch(t) - epoch(last_at))) <= 1800 AND trade_date IS NOT DISTINCT FROM d THEN last END AS last, CASE WHEN volume <> 0 AND abs(trunc(epoch(t) - epoch(volume_at))) <= 1800 AND trade_date IS NOT DISTINCT FROM d THEN volume END AS volume,
  quote_time_utc, received_at, trunc(epoch(t) - epoch(received_at)) > 15 AS stale FROM front f LEFT JOIN lq ON lq.contract_id = f.active, md""",
}

_NOW = "TIMESTAMP '2024-01-24 18:00:00'"
ORACLES |= {
    "market_snapshot": with_(SNAPSHOT_BARS, PIVOTS, ZONES, finished("zones", "sw"), DAYS, SESSIONS, runs("bars", "whole"), "la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY bucket_start DESC) AS r, CASE WHEN rn >= 20 THEN avg(close) OVER (PARTITION BY instrument, run_id ORDER BY bucket_start ROWS 19 PRECEDING) END AS sma FROM whole) WHERE r = 1)", f"se AS (SELECT la.*, {trade_date('bucket_start')} AS td FROM la)")
    + """SELECT instrument, bucket_start, close, volume, coalesce(bucket_start < s.close_utc, false) AS is_open, CASE WHEN bucket_start < s.close_utc THEN td END AS trade_date, (SELECT min(open_utc) FROM sess n WHERE n.open_utc > bucket_start) AS next_open_utc,
  CAST(15 AS BIGINT) AS indicators, round(sma, 6) AS sma, (SELECT count(*) FROM sw WHERE sw.instrument = se.instrument) AS levels FROM se LEFT JOIN sess s ON s.trade_date = td""",
    "recorder_health": with_(TRADES, COVERAGE, DAYS, SESSIONS, f"tk AS (SELECT instrument, contract_id, max(trade_time_utc) AS last_tick FROM trades WHERE trade_time_utc >= TIMESTAMP '2024-01-20' AND trade_time_utc < {_NOW} GROUP BY ALL)", f"w AS (SELECT instrument, contract_id, open_utc AS a, least(close_utc, {_NOW}) AS b FROM tk, sess WHERE open_utc <= {_NOW} AND close_utc > {_NOW})", "pts AS (SELECT w.*, greatest(range_start, a) AS s, least(range_end, b) AS e FROM w JOIN cov c ON c.instrument = w.instrument AND c.contract_id = w.contract_id AND range_start < b AND range_end > a UNION ALL SELECT *, b, b FROM w)", "pv AS (SELECT *, coalesce(max(e) OVER (PARTITION BY instrument, contract_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) AS p FROM pts)", "gp AS (SELECT instrument, contract_id, count(*) AS gaps, CAST(sum(trunc(epoch(s) - epoch(p))) AS BIGINT) AS gap_seconds FROM pv WHERE p < s GROUP BY ALL)")
    + f"""SELECT instrument, contract_id, CASE WHEN instrument = 'ES' THEN 'listening' ELSE 'stopped' END AS state, last_tick, CAST(trunc(epoch({_NOW}) - epoch(last_tick)) AS BIGINT) AS tick_age_seconds, coalesce(gaps, 0) AS gaps, coalesce(gap_seconds, 0) AS gap_seconds,
  CASE WHEN instrument <> 'ES' THEN 'unavailable' WHEN coalesce(gaps, 0) > 0 THEN 'degraded' ELSE 'ok' END AS overall FROM tk LEFT JOIN gp USING (instrument, contract_id)""",
}
_SESSION_NOW = with_(TRADES, DAYS, WINDOWS, session_bars(WHOLE_SELECT, "2024-01-31 00:00:00", "sn"))
ORACLES |= {
    "bars_committed": with_(BARS) + f"SELECT {BAR} FROM bars",
    "session_bars_committed": _SESSION_NOW + "SELECT instrument, session, trade_date, start_utc, end_utc, CAST(base AS BIGINT) AS base_minutes, open, high, low, close, volume, contract_id FROM sn WHERE absence IS NULL",
    "indicators_committed": with_(ALL_VALUES) + f"SELECT {VALUE} FROM made",
    "retention_committed": ORACLES["retention_apply"],
    "reselection_committed": with_(UNKNOWN, BY_CONTRACT, DATED, RESELECT[: RESELECT.index("cd AS")].rstrip(",\n "))
    + """SELECT instrument, bucket_start, open, high, low, close, volume, contract_id FROM wn
  UNION ALL SELECT instrument, bucket_start, open, high, low, close, volume, contract_id FROM bars b WHERE NOT EXISTS (SELECT 1 FROM wn w WHERE w.instrument = b.instrument AND w.bucket_start = b.bucket_start)
    AND NOT EXISTS (SELECT 1 FROM rm WHERE rm.instrument = b.instrument AND rm.bucket_start = b.bucket_start)""",
}
ORACLES |= {"stream_gate_changing": ORACLES["stream_print_gate"], "latest_quote_state": _LATEST}


def covered(start: str, name: str) -> str:
    """Which instruments have tape in the window from `start` to February, and whether it is narrowed."""
    window = ORACLES["covered_window"].replace("2024-01-08 12:00:00", start).replace("2024-01-22", "2024-02-01")
    return f"{name} AS (SELECT instrument, narrowed FROM ({window}))"


_REASON = "CASE WHEN family = 'volume' THEN CASE WHEN narrowed IS NULL THEN 'no tape' WHEN narrowed THEN 'tape narrowed' END WHEN family IN ('session', 'pivot') AND overhangs THEN 'refused: buckets overhang a session close' END"
_ASKED = "asked AS (SELECT i.instrument, m.method, m.family, CASE m.method WHEN 'swing' THEN 2.0::DOUBLE WHEN 'volume-poc' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM (SELECT DISTINCT instrument FROM scaled) i, (VALUES " + ", ".join(f"('{m}', '{family}')" for m, (_, family) in METHODS.items()) + ") m(method, family))"
_OVERHANGS = f"bo AS (SELECT * FROM ({ORACLES['bucket_overhang']}))"


def _report(window: str, start: str) -> str:
    return f"SELECT a.instrument, CAST(60 AS BIGINT) AS resolution_minutes, TIMESTAMP '{start}' AS tape_from, a.method, family, weight, {_REASON} AS reason, coalesce(zn.n, 0) AS n FROM asked a LEFT JOIN {window} w USING (instrument) LEFT JOIN (SELECT instrument AS bi, overhangs FROM bo WHERE resolution_minutes = 60) b ON bi = a.instrument LEFT JOIN zn ON zn.instrument = a.instrument AND zn.method = a.method"


ORACLES |= {
    "level_methods": with_(LEVEL_SET, COVERAGE, covered("2024-01-24", "w1"), covered("2024-01-31 23:30:00", "w2"), _ASKED, _OVERHANGS, "zn AS (SELECT instrument, method, count(*) AS n FROM lset GROUP BY ALL)", f"rp AS ({_report('w1', '2024-01-24')} UNION ALL {_report('w2', '2024-01-31 23:30:00')})")
    + """SELECT instrument, resolution_minutes, tape_from, method, family, weight, CASE WHEN reason IS NULL THEN n ELSE 0 END AS zones, reason IS NULL AND n = 12 AS capped, coalesce(reason, CASE WHEN n = 0 THEN 'no levels' END) AS absence FROM rp
  UNION ALL SELECT DISTINCT instrument, CAST(240 AS BIGINT), TIMESTAMP '2024-01-24', method, family, 1.0::DOUBLE, CAST(0 AS BIGINT), false, 'refused: buckets overhang a session close' FROM trades, (VALUES ('session', 'session'), ('pivot-classic', 'pivot')) m(method, family) WHERE (SELECT bool_or(overhangs) FROM bo WHERE resolution_minutes = 240)""",
    "level_set_ordered": with_(LEVEL_SET, COVERAGE, covered("2024-01-24", "w1"), _ASKED, _OVERHANGS, f"rp AS ({_report('w1', '2024-01-24')})".replace("LEFT JOIN zn ON zn.instrument = a.instrument AND zn.method = a.method", "").replace("coalesce(zn.n, 0)", "0"))
    + "SELECT instrument, row_number() OVER (PARTITION BY instrument ORDER BY round((bottom + top) / 2, 8), round(bottom, 8), method) AS position, method, round((bottom + top) / 2, 6) AS midpoint FROM lset JOIN rp USING (instrument, method) WHERE reason IS NULL",
}


def _snapshot(minutes: int) -> dict[str, str]:
    """The tables of a snapshot at one bar size."""
    sized = lambda sql: sql.replace("INTERVAL 60 MINUTE, trade_time_utc", f"INTERVAL {minutes} MINUTE, trade_time_utc")
    look = sized(LEVEL_SET.replace(LEVEL_BARS, SNAPSHOT_BARS.replace("<= 500", "<= 200")))
    # the grid of bar sizes that are asked for, and the bars of this one
    step = f"st AS (SELECT unnest(generate_series(open_utc, ordinary_close - INTERVAL 1 MINUTE, to_minutes({minutes}))) AS t FROM sess)"
    grid = f"gr AS (SELECT bool_or(NOT coalesce({trade_date('t')} IS NOT NULL AND t + to_minutes({minutes}) <= {ordinary_close(trade_date('t'))}, false)) AS o FROM st)"
    newest = "nw AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY bucket_start DESC) <= 200)"
    over = f"ov AS (SELECT instrument, gr.o OR bool_or(NOT {expected('bucket_start', minutes)}) AS overhangs FROM nw, gr GROUP BY instrument, gr.o)"
    report = f"rp AS (SELECT a.instrument, a.method, family, weight, {_REASON} AS reason FROM asked a LEFT JOIN w1 USING (instrument) LEFT JOIN (SELECT instrument AS bi, overhangs FROM ov) b ON bi = a.instrument)"
    zones = with_(look, COVERAGE, covered("2024-01-24", "w1"), _ASKED, SESSIONS, step, grid, newest, over, report)
    window = "count(*) AS {0}bars, min(bucket_start) AS {0}first_bucket, array_to_string(list_sort(list(DISTINCT contract_id)), ',') AS {0}contracts, CASE WHEN count(DISTINCT contract_id) > 1 THEN 'SpansRoll' WHEN bool_or(contract_id IS NULL) THEN 'Unknown' ELSE 'SingleContract' END AS {0}span"
    at, m = "TIMESTAMP '2024-01-25 12:00:00'", f"CAST({minutes} AS BIGINT) AS resolution_minutes"
    shown = "sh AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY bucket_start DESC) <= 100)"
    return {
        "snapshot_bars": sized(with_(BARS)) + f"SELECT {m}, {BAR} FROM bars QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY bucket_start DESC) <= 100",
        "snapshot_readings": sized(with_(BARS, runs(), CATALOGUE, "lv AS (SELECT instrument, indicator, max(bucket_start) AS bucket_start FROM cat GROUP BY ALL)"))
        + f"SELECT i.instrument, {m}, CAST(n.period AS BIGINT) AS period, n.indicator, round(value, 6) AS value, c.bucket_start, contract_id FROM (SELECT DISTINCT instrument FROM bars) i CROSS JOIN (VALUES "
        + ", ".join(f"('{n}', {PERIODS.get(n, 20)})" for n in INDICATORS)
        + ") n(indicator, period) LEFT JOIN lv ON lv.instrument = i.instrument AND lv.indicator = n.indicator LEFT JOIN cat c ON c.instrument = i.instrument AND c.indicator = n.indicator AND c.bucket_start = lv.bucket_start",
        "snapshot_levels": zones
        + f"SELECT instrument, {m}, row_number() OVER (PARTITION BY instrument ORDER BY round((bottom + top) / 2, 8), round(bottom, 8), method) AS position, method, kind, round(bottom, 6) AS bottom, round(top, 6) AS top, round(significance, 6) AS significance, touches FROM lset JOIN rp USING (instrument, method) WHERE reason IS NULL",
        "snapshot_methods": zones
        + f"SELECT rp.instrument, {m}, rp.method, rp.family, weight, CASE WHEN reason IS NULL THEN coalesce(n, 0) ELSE 0 END AS zones, reason IS NULL AND coalesce(n, 0) = 12 AS capped, coalesce(reason, CASE WHEN n IS NULL THEN 'no levels' END) AS absence FROM rp LEFT JOIN (SELECT instrument AS zi, method AS zm, count(*) AS n FROM lset GROUP BY ALL) ON zi = instrument AND zm = rp.method",
        "snapshot_series": sized(with_(SNAPSHOT_BARS.replace("<= 500", "<= 200"), DAYS, SESSIONS, newest, shown, f"sv AS (SELECT instrument, {window.format('')}, max(bucket_start) AS last_bucket, last(close ORDER BY bucket_start) AS close, last(volume ORDER BY bucket_start) AS volume FROM sh GROUP BY 1)", f"lw AS (SELECT instrument, {window.format('level_')} FROM nw GROUP BY 1)", "dt AS (SELECT instrument, count(*) AS detected_over_bars FROM lb GROUP BY 1)"))
        + f"SELECT instrument, {m}, coalesce({at} < s.close_utc, false) AS is_open, CASE WHEN {at} < s.close_utc THEN s.trade_date END AS trade_date, (SELECT min(open_utc) FROM sess n WHERE n.open_utc > {at}) AS next_open_utc, sv.* EXCLUDE instrument, lw.* EXCLUDE instrument, detected_over_bars FROM sv JOIN lw USING (instrument) JOIN dt USING (instrument) LEFT JOIN sess s ON s.trade_date = {trade_date(at)}",
    }


for _name in _snapshot(5):
    ORACLES[_name] = " UNION ALL ".join(f"SELECT * FROM ({_snapshot(m)[_name]})" for m in (5, 60))
