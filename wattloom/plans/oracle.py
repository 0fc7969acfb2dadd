"""The registered queries in SQL, for comparison on the same tables with another engine."""

from wattloom.constants import BOOST_RATE, FEATURE_SPECS, PUBLISHED_THRESHOLDS, TARGET
from wattloom.operators import models as ml
from wattloom.operators.trees import LEAST_GAIN, POISSON

V12 = FEATURE_SPECS["v12"]


def r(x: str, digits: int = 6) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


def hash52(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5('{salt}:' || {key}), 1, 13))::BIGINT)::DOUBLE"


def uniform(key: str, salt: str) -> str:
    return f"({hash52(key, salt)} / 4503599627370496.0)"


def gaussian(key: str, salt: str) -> str:
    radius = f"sqrt(-2.0 * ln(({hash52(key, salt + ':r')} + 0.5) / 4503599627370496.0))"
    return f"({radius} * cos(2.0 * pi() * {uniform(key, salt + ':a')}))"


def exact_round(x: str, digits: int, ties: str) -> str:
    """Round the exact binary value: the product's lost part comes from a split at float precision."""
    s = f"1e{digits}"
    p, head = f"(({x}) * {s})", f"(({x})::FLOAT::DOUBLE)"
    lost = f"(({head} * {s} - {p}) + (({x}) - {head}) * {s})"
    f = f"floor({p})"
    tie = f"{lost} >= 0" if ties == "up" else f"({lost} > 0 OR ({lost} = 0 AND {f} % 2 <> 0))"
    up = f"({p} - {f} > 0.5 OR ({p} - {f} = 0.5 AND {tie}))"
    return f"(({f} + CASE WHEN {up} THEN 1 ELSE 0 END) / {s})"


_VIEWS = {
    "inventory": ([], """
        SELECT l_orderkey AS house_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
               l_shipdate,
               CASE p_type WHEN 'ECONOMY' THEN 'Fan' WHEN 'LARGE' THEN 'AirConditioner'
                    WHEN 'MEDIUM' THEN 'Refrigerator' WHEN 'PROMO' THEN 'Television'
                    WHEN 'SMALL' THEN 'Monitor' WHEN 'STANDARD' THEN 'MotorPump' END AS name,
               (p_size * 10)::DOUBLE AS power, (l_suppkey % 25)::DOUBLE AS hours,
               (l_linenumber - 1)::DOUBLE AS qty,
               CASE WHEN l_linenumber = 1 THEN 1.0::DOUBLE
                    ELSE (l_linenumber - 1)::DOUBLE END AS q
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "usage": (["inventory"], """
        SELECT house_id, name, hours * q AS usage FROM (
            SELECT *, row_number() OVER (PARTITION BY house_id, name ORDER BY l_linenumber DESC,
                l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_shipdate DESC) AS rn
            FROM inventory) WHERE rn = 1"""),
    "rollup": (["inventory"], f"""
        SELECT house_id, {r('sum(power * q)', 2)} AS total_appliance_power,
               sum(q) AS appliance_count,
               {r('sum(power * q) / sum(q)', 2)} AS avg_power_per_appliance
        FROM inventory GROUP BY house_id"""),
    "households": (["usage"], """
        SELECT o_orderkey AS record_id,
               CASE WHEN o_orderkey % 97 = 0 THEN '  ' ELSE ' ' || o_custkey END AS house_id,
               CASE WHEN o_orderkey % 10 = 1 THEN d || 'T10:20:30'
                    WHEN o_orderkey % 10 = 2 THEN d || ' 23:15:00+05:30'
                    WHEN o_orderkey % 10 = 3 THEN replace(d, '-', '')
                    WHEN o_orderkey % 10 = 4 THEN '  ' || d || ' '
                    WHEN o_orderkey % 10 = 5 THEN d || 'T01:02:03.250Z'
                    WHEN o_orderkey % 40 = 6 THEN substr(d, 1, 7)
                    WHEN o_orderkey % 40 = 7 THEN substr(d, 1, 5) || '13-05'
                    WHEN o_orderkey % 40 = 8 THEN 'yesterday' ELSE d END AS date,
               o_orderkey % 20 = 0 AND o_orderkey IN
                   (SELECT house_id FROM usage WHERE name = 'Fan') AS negative,
               o_totalprice / 1000 AS total_consumption_kwh
        FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
        WHERE o_orderkey IN (SELECT house_id FROM usage)"""),
    "checked": (["households"], r"""
        SELECT *, CASE WHEN trim(house_id) = '' THEN 'house_id is empty'
                       WHEN iso IS NULL THEN 'date is not ISO'
                       WHEN negative THEN 'usage values must be non-negative numbers' END AS reason
        FROM (
            SELECT *, CASE WHEN local IS NOT NULL
                           THEN strftime(local, '%Y-%m-%dT%H:%M:%S') || suffix END AS iso,
                   local - shift + fraction AS moment
            FROM (
                SELECT *,
                    CASE WHEN regexp_full_match(t, '\d{8}') THEN try_strptime(t, '%Y%m%d')
                         WHEN regexp_matches(t, '^\d{4}-\d{2}-\d{2}') THEN
                             try_cast(substr(replace(t, 'T', ' '), 1, 19) AS TIMESTAMP)
                    END AS local,
                    CASE WHEN t LIKE '%+05:30' THEN '+05:30'
                         WHEN t LIKE '%.250Z' THEN '.250000+00:00' ELSE '' END AS suffix,
                    CASE WHEN t LIKE '%+05:30' THEN INTERVAL '330 minutes'
                         ELSE INTERVAL '0 minutes' END AS shift,
                    CASE WHEN t LIKE '%.250Z' THEN INTERVAL '250 milliseconds'
                         ELSE INTERVAL '0 minutes' END AS fraction
                FROM (SELECT *, trim(date) AS t FROM households)))"""),
    "predictions": ([], """
        SELECT o_orderkey AS _id, o_custkey AS house_id, o_orderdate AS ts,
               o_totalprice / 1000 AS predicted_value_kwh,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'linear' WHEN '2-HIGH' THEN 'rf'
                    WHEN '3-MEDIUM' THEN 'gbt' ELSE 'unknown' END AS model
        FROM orders"""),
    "linked": (["predictions"], """
        SELECT *, lag(predicted_value_kwh) OVER (PARTITION BY house_id ORDER BY ts, _id)
                  AS last_kwh
        FROM predictions"""),
    "dashboard": (["predictions"], """
        SELECT _id, house_id,
               CASE WHEN _id % 3 = 0 THEN strftime(ts, '%Y-%m-%d')
                    WHEN _id % 3 = 1 THEN '' END AS date,
               CASE WHEN _id % 5 IN (0, 3) THEN NULL ELSE ts END AS ts,
               CASE WHEN _id % 4 = 0 THEN predicted_value_kwh END AS predicted_kwh,
               CASE WHEN _id % 4 = 1 OR _id % 8 = 0 THEN predicted_value_kwh + 1 END
                   AS total_consumption_kwh,
               CASE WHEN _id % 4 = 2 THEN predicted_value_kwh + 2 END AS estimated_kwh
        FROM predictions"""),
    "points": (["dashboard"], """
        SELECT _id, coalesce(nullif(date, ''), strftime(ts, '%Y-%m-%d'), '-') AS label,
               coalesce(predicted_kwh, total_consumption_kwh, estimated_kwh, 0.0::DOUBLE) AS kwh,
               coalesce(try_cast(nullif(date, '') AS TIMESTAMP), ts, TIMESTAMP '1970-01-01') AS moment
        FROM dashboard"""),
    "houses": ([], """
        SELECT c_custkey AS house_id, c_nationkey % 6 AS city_code, c_mktsegment AS company
        FROM customer"""),
    "solar": ([], """
        SELECT *, panel_watt * sun_hours * coalesce(efficiency, 0.75) AS panel FROM (
            SELECT p_partkey AS request_id, p_retailprice / 100 AS daily_kwh,
                   (p_size % 9)::DOUBLE AS sun_hours, (p_size * 10)::DOUBLE AS panel_watt,
                   CASE WHEN p_partkey % 3 <> 0 THEN 0.8::DOUBLE END AS efficiency FROM part)"""),
    "training": (["rollup"], f"""
        SELECT *, 0.0001 * total_appliance_power * "MonthlyHours" + 0.5 * "Month_num"
                  AS "{TARGET}",
               greatest(0.0::DOUBLE, "SolarGeneration_kWh" - "GridConsumption_kWh")
                  AS "EnergySold_kWh"
        FROM (
            SELECT house_id, total_appliance_power, appliance_count, avg_power_per_appliance,
                   (240 + 10 * (o_orderkey % 50))::DOUBLE AS "MonthlyHours",
                   (3 + o_custkey % 10)::DOUBLE AS "TariffRate",
                   0.0::DOUBLE AS consumption_per_hour,
                   (o_orderkey % 100)::DOUBLE AS "SolarGeneration_kWh",
                   o_totalprice / 1000 AS "GridConsumption_kWh",
                   month(o_orderdate)::DOUBLE AS "Month_num",
                   (c_nationkey % 6)::DOUBLE AS "City_code", code::DOUBLE AS "Company_code"
            FROM rollup JOIN orders ON house_id = o_orderkey
                 JOIN customer ON o_custkey = c_custkey
                 JOIN (SELECT segment, row_number() OVER (ORDER BY segment) - 1 AS code
                       FROM (SELECT DISTINCT c_mktsegment AS segment FROM customer))
                      ON segment = c_mktsegment)"""),
    "noisy": (["training"], f"""
        SELECT *, "{TARGET}" + 5.0 * {gaussian('house_id', 'noise42')} AS noisy_target
        FROM training"""),
    "forms": (["training"], """
        SELECT house_id AS row_id,
            CASE WHEN house_id % 5 = 0 THEN '' WHEN house_id % 17 = 0 THEN 'abc'
                 WHEN house_id % 19 = 0 THEN '-5' WHEN house_id % 23 = 0 THEN ' 900 '
                 ELSE "MonthlyHours"::VARCHAR END AS hours,
            CASE WHEN house_id % 29 = 0 THEN NULL ELSE "TariffRate"::VARCHAR END AS tariff,
            CASE WHEN house_id % 6 = 0 THEN '  ' ELSE "SolarGeneration_kWh"::VARCHAR END AS solar_,
            CASE WHEN house_id % 7 = 0 THEN '' WHEN house_id % 31 = 0 THEN '12,5'
                 ELSE "GridConsumption_kWh"::VARCHAR END AS grid,
            "EnergySold_kWh"::VARCHAR AS sold,
            CASE WHEN house_id % 3 = 0 THEN "GridConsumption_kWh"::VARCHAR ELSE '' END AS bill,
            (house_id % 4)::VARCHAR AS fan,
            CASE WHEN house_id % 2 = 0 THEN '1' ELSE '' END AS refrigerator,
            CASE WHEN house_id % 11 = 0 THEN '' WHEN house_id % 13 = 0 THEN '25'
                 ELSE (house_id % 3)::VARCHAR END AS ac,
            CASE WHEN house_id % 9 = 0 THEN 'two' ELSE '2' END AS television,
            CASE WHEN house_id % 8 = 0 THEN '750' ELSE '0' END AS pump,
            CASE WHEN house_id % 4 = 0 THEN '' ELSE total_appliance_power::VARCHAR END AS power,
            CASE WHEN house_id % 8 = 0 THEN total_appliance_power::VARCHAR ELSE '' END AS alias_,
            CASE WHEN house_id % 21 = 0 THEN '0' WHEN house_id % 22 = 0 THEN ''
                 ELSE appliance_count::VARCHAR END AS count_,
            CASE WHEN house_id % 10 = 0 THEN '' ELSE avg_power_per_appliance::VARCHAR END AS mean_,
            "Month_num"::VARCHAR AS month_,
            CASE WHEN house_id % 12 = 0 THEN '' ELSE "City_code"::INT::VARCHAR END AS city,
            "Company_code"::VARCHAR AS company
        FROM training"""),
    "requests": (["training"], """
        SELECT house_id, CASE house_id % 4 WHEN 0 THEN 'linear' WHEN 1 THEN 'rf'
                              WHEN 2 THEN 'gbt' ELSE 'unknown' END AS model,
               house_id % 15 = 0 AS short, house_id % 25 = 0 AND house_id % 15 <> 0 AS gap,
               house_id % 2 = 0 AS has_meta, total_appliance_power, "MonthlyHours", "Month_num"
        FROM training"""),
    "scored": (["training"], f"""
        SELECT house_id, model, CASE WHEN house_id % 50 = 0 THEN 0.0::DOUBLE ELSE label END AS y,
               CASE model WHEN 'a' THEN label * 1.01 WHEN 'b' THEN label + 3.0
                          ELSE 0.0::DOUBLE END AS prediction
        FROM (SELECT house_id, "{TARGET}" AS label FROM training),
             (VALUES ('a'), ('b'), ('c')) AS m(model)"""),
    "part_train": (["training"], f"""
        SELECT * FROM training WHERE {uniform('house_id', 'split42')} < 1.0 - 0.3"""),
    "stream_records": ([], """
        SELECT event_id AS record_id, value AS total_consumption_kwh,
               CASE WHEN event_id % 50 = 7 THEN '' ELSE user_id::VARCHAR END AS house_id,
               CASE WHEN event_id % 50 = 7 THEN 'house_id is empty'
                    WHEN event_id % 30 = 1 THEN 'date is not ISO'
                    WHEN event_id % 20 = 0 AND value > 0
                         THEN 'usage values must be non-negative numbers' ELSE '' END AS reason
        FROM events"""),
}


def _in_order(view: str, done: list[str]) -> None:
    for below in _VIEWS[view][0]:
        _in_order(below, done)
    if view not in done:
        done.append(view)


def _on(view: str, body: str) -> str:
    """``body`` with ``view`` and the views it needs in front of it."""
    needed: list[str] = []
    _in_order(view, needed)
    heads = ", ".join(f"{v} AS ({_VIEWS[v][1]})" for v in needed)
    return f"WITH {heads} {body}"


_METRICS = {
    "RMSE": "sqrt(avg((y - prediction) * (y - prediction)))",
    "MAE": "avg(abs(y - prediction))",
    "R2": "1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(y))",
    "MAPE_safe": "avg(CASE WHEN y <> 0 THEN abs((y - prediction) / y) END) * 100",
    "SMAPE": "avg(CASE WHEN abs(y) + abs(prediction) <> 0 THEN "
             "2 * abs(prediction - y) / (abs(y) + abs(prediction)) END) * 100",
}


def _metrics(names, digits: int = 6) -> str:
    return ", ".join(f'{r(_METRICS[n], digits)} AS "{n}"' for n in names)


def _quoted(names) -> str:
    return ", ".join(f'"{n}"' for n in names)


def _num(x: str) -> str:
    return f"TRY_CAST(trim({x}) AS DOUBLE)"


def _blank(x: str) -> str:
    return f"coalesce(trim({x}) = '', true)"


def _autofill(force: bool) -> str:
    def open_(x):
        return "true" if force else _blank(x)

    total = f"""CASE WHEN {open_('power')} AND NOT {_blank('mean_')} AND NOT {_blank('count_')}
                     AND coalesce({_num('mean_')} * {_num('count_')} > 0, false)
                THEN {r(f"{_num('mean_')} * {_num('count_')}", 2)} ELSE {_num('power')} END"""
    rate = f"(CASE WHEN {_blank('tariff')} THEN 0 ELSE {_num('tariff')} END)"
    cost = f"({_num('grid')} * {rate})"
    return _on("forms", f"""
        SELECT row_id, total AS total_appliance_power,
            CASE WHEN {open_('bill')} AND NOT {_blank('grid')} AND {cost} IS NOT NULL
                 THEN {r(cost, 2)} ELSE {_num('bill')} END AS "NetBill",
            CASE WHEN {open_('hours')} THEN
                      CASE WHEN coalesce({_num('ac')} > 0, false) THEN 300.0::DOUBLE
                           ELSE 240.0::DOUBLE END
                 ELSE {_num('hours')} END AS "MonthlyHours",
            CASE WHEN {open_('mean_')} AND coalesce({_num('count_')} > 0, false)
                 THEN {r(f"coalesce(total, 0) / {_num('count_')}", 2)}
                 ELSE {_num('mean_')} END AS avg_power_per_appliance
        FROM (SELECT *, {total} AS total FROM forms)""")


_BILL = f"""CASE WHEN {_blank('bill')}
    THEN {r(f"coalesce({_num('grid')}, 0) * coalesce({_num('tariff')}, 0)", 2)}
    ELSE coalesce({_num('bill')}, 0) END"""

_ALL_FIELDS = {
    "MonthlyHours": ("hours", True, 744),
    "TariffRate": ("tariff", True, 200),
    "SolarGeneration_kWh": ("solar_", False, 10000),
    "GridConsumption_kWh": ("grid", False, 20000),
    "EnergySold_kWh": ("sold", False, 20000),
    "NetBill": ("bill", False, 10000000),
    "Fan": ("fan", False, 100),
    "Refrigerator": ("refrigerator", False, 50),
    "AirConditioner": ("ac", False, 20),
    "Television": ("television", False, 20),
    "Monitor": ("'1.5'", False, 20),
    "MotorPump": ("pump", False, 10),
}


def _field(field: str) -> str:
    raw, required, high = _ALL_FIELDS[field]
    missing = ("'error'", "'value is missing'") if required else ("'ok'", "''")
    number = _num(raw)
    cases = [(_blank(raw), *missing), (f"{number} IS NULL", "'error'", "'not a number'"),
             (f"{number} < 0", "'error'", "'must be at least 0'"),
             (f"{number} > {high}", "'warning'", f"'seems high, at most {high} expected'")]
    status = " ".join(f"WHEN {c} THEN {s}" for c, s, _ in cases)
    message = " ".join(f"WHEN {c} THEN {m}" for c, _, m in cases)
    return (f"SELECT row_id, '{field}' AS field, CASE {status} ELSE 'ok' END AS status, "
            f"CASE {message} ELSE '' END AS message FROM forms")


def _is_error(field: str) -> str:
    raw, required, _ = _ALL_FIELDS[field]
    bad = f"(NOT {_blank(raw)} AND coalesce({_num(raw)} < 0, true))"
    return f"({_blank(raw)} OR {bad})" if required else bad


def _zero(x: str) -> str:
    return f"coalesce({_num(x)}, 0.0::DOUBLE)"


_VECTOR_V12 = {
    "total_appliance_power":
        f"CASE WHEN {_blank('power')} THEN {_zero('alias_')} ELSE {_zero('power')} END",
    "appliance_count": _zero("count_"),
    "avg_power_per_appliance": _zero("mean_"),
    "MonthlyHours": _zero("hours"),
    "TariffRate": _zero("tariff"),
    "consumption_per_hour": "0.0::DOUBLE",
    "SolarGeneration_kWh": _zero("solar_"),
    "GridConsumption_kWh": _zero("grid"),
    "EnergySold_kWh": _zero("sold"),
    "Month_num": _zero("month_"),
    "City_code": _zero("city"),
    "Company_code": _zero("company"),
}
_VECTOR_V16 = {
    "Fan": f"{_zero('fan')} * 70",
    "Refrigerator": f"{_zero('refrigerator')} * 150",
    "AirConditioner": f"{_zero('ac')} * 1200",
    "Television": f"{_zero('television')} * 100",
    "Monitor": "45.0::DOUBLE",
    "MotorPump": "CASE WHEN row_id % 8 = 0 THEN 750.0::DOUBLE ELSE 0.0::DOUBLE END",
    "MonthlyHours": _zero("hours"),
    "SolarGeneration_kWh": _zero("solar_"),
    "GridConsumption_kWh": _zero("grid"),
    "EnergySold_kWh": _zero("sold"),
    "TariffRate": _zero("tariff"),
    "NetBill": _BILL,
    "City_City_A": "(coalesce(city, '') NOT IN ('2', '3', '4'))::INT::DOUBLE",
    "City_City_B": "(city = '2')::INT::DOUBLE",
    "City_City_C": "(city = '3')::INT::DOUBLE",
    "City_City_D": "(city = '4')::INT::DOUBLE",
}


def _vector(features: dict[str, str]) -> str:
    return _on("forms", "SELECT row_id, " + ", ".join(
        f'{x} AS "{name}"' for name, x in features.items()) + " FROM forms")


_STATS = {
    f: (f'avg("{f}")', f'stddev_pop("{f}")') for f in V12
}
_GRID, _SOLAR = '"GridConsumption_kWh"', '"SolarGeneration_kWh"'
_CLIPPED = "greatest(noisy_target, 0.0::DOUBLE)"
_LIMITS = f"""
    SELECT quantile_cont({_GRID}, 0.95) AS grid_p95, quantile_cont({_GRID}, 0.99) AS grid_p99,
           min("MonthlyHours") AS monthly_min, max("MonthlyHours") AS monthly_max,
           quantile_cont(total_appliance_power, 0.99) AS total_power_p99 FROM training"""
_LIMIT_NAMES = ["grid_p95", "grid_p99", "monthly_min", "monthly_max", "total_power_p99"]
_ROUNDED_LIMITS = _on("training", "SELECT " + ", ".join(
    f"{r(n, 9)} AS {n}" for n in _LIMIT_NAMES) + f" FROM ({_LIMITS})")


def _describe(which: str, x: str) -> str:
    stats = {
        "mean": f"avg({x})", "std": f"stddev_samp({x})", "min": f"min({x})",
        "p25": f"quantile_cont({x}, 0.25)", "p50": f"quantile_cont({x}, 0.5)",
        "p75": f"quantile_cont({x}, 0.75)", "max": f"max({x})",
    }
    columns = ", ".join(f"{r(value, 9)} AS {name}" for name, value in stats.items())
    return f"SELECT '{which}' AS \"column\", count({x}) AS count, {columns} FROM noisy"


def _lookup_sql(column: str) -> str:
    return (f"(SELECT {column}, (row_number() OVER (ORDER BY {column}) - 1)::DOUBLE AS code "
            f"FROM (SELECT DISTINCT {column} FROM houses))")


_READINGS_DELTA = """
    SELECT event_id, house_id, kwh, last_kwh, kwh - last_kwh AS delta_kwh,
           CASE WHEN kwh >= last_kwh THEN 'up' WHEN kwh < last_kwh THEN 'down' END AS direction
    FROM (SELECT event_id, user_id AS house_id, value AS kwh,
                 lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_kwh
          FROM events)"""
_RECENT = """
    SELECT event_id, user_id AS house_id, value AS kwh FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
        FROM events) WHERE rn <= 30"""
_USABLE = " AND ".join(f"house_id % {k} <> 0" for k in (37, 41, 43, 47))


_XS = [f"x{i}" for i in range(len(V12))]
#: house_id, usable, is_train, y and the features of all training rows.
_BASE = f"""base AS MATERIALIZED (
            SELECT house_id, {_USABLE} AS usable,
                   {_USABLE} AND {uniform('house_id', 'split42')} < 1.0 - 0.3 AS is_train, {_CLIPPED} AS y,
                   {', '.join(f'"{f}" AS x{i}' for i, f in enumerate(V12))}
            FROM noisy)"""


def _least_squares() -> list[str]:
    """Least squares with all features by one residual regression after the other.

    Slopes come from the training part; ``line`` has (house_id, prediction) of all rows, ``tested`` also y,
    of the test part.
    """
    n, xs = len(V12), _XS
    steps = [
        f"""means AS MATERIALIZED (
            SELECT avg(y) AS my, {', '.join(f'avg({x}) AS m{x}' for x in xs)} FROM base WHERE is_train)""",
        f"""s0 AS MATERIALIZED (
            SELECT house_id, usable, is_train, y, y - my AS rest, {', '.join(f'{x} - m{x} AS {x}' for x in xs)}
            FROM base, means)""",
    ]
    for j in range(n):
        later = xs[j + 1:]
        sums = "".join(f", sum({xs[j]} * {x}) AS c{x}" for x in later)
        # A feature without variation of its own has no slope.
        slope = lambda c: f"CASE WHEN d > 1e-6 THEN {c} / d ELSE 0 END"
        steps += [
            f"""b{j} AS MATERIALIZED (
            SELECT sum({xs[j]} * {xs[j]}) AS d, sum({xs[j]} * rest) AS cy{sums} FROM s{j} WHERE is_train)""",
            f"""s{j + 1} AS MATERIALIZED (
            SELECT house_id, usable, is_train, y, rest - {slope('cy')} * {xs[j]} AS rest
                   {''.join(f', {x} - {slope("c" + x)} * {xs[j]} AS {x}' for x in later)}
            FROM s{j}, b{j})""",
        ]
    steps += [f"line AS (SELECT house_id, usable, is_train, y, y - rest AS prediction FROM s{n})",
              "tested AS (SELECT house_id, y, prediction FROM line WHERE usable AND NOT is_train)"]
    return steps


def _bins(settings) -> list[str]:
    """``binned``: the target in steps of 2^-16 and the bin of each feature, for all rows."""
    n, k = len(V12), settings.bins
    return [
        f"""wide AS (
            SELECT unnest(range({n})) AS f, unnest([{', '.join(f'{x} + 0.0::DOUBLE' for x in _XS)}]) AS v
            FROM base WHERE is_train)""",
        f"""cut AS (
            SELECT f, list(DISTINCT v ORDER BY v) AS c FROM (
                SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS rn, count(*) OVER (PARTITION BY f) AS n
                FROM wide) JOIN (SELECT unnest(range(1, {k})) AS k) ON rn = ceil(k / {k}::DOUBLE * n) GROUP BY f)""",
        f"""cuts AS (
            SELECT {', '.join(f'any_value(c) FILTER (f = {i}) AS c{i}' for i in range(n))} FROM cut)""",
        f"""binned AS MATERIALIZED (
            SELECT house_id, is_train, floor(y * 65536 + 0.5)::BIGINT AS y,
                   [{', '.join(f'len(list_filter(c{i}, lambda c: c < x{i}))' for i in range(n))}] AS bins
            FROM base, cuts)""",
    ]


def _best_splits(l2: str) -> str:
    return f"""run AS (
                    SELECT node, f, b, sum(s) OVER upto / 65536::DOUBLE AS gl, sum(h) OVER upto AS hl,
                           sum(s) OVER every / 65536::DOUBLE AS ga, sum(h) OVER every AS ha FROM cells
                    WINDOW upto AS (PARTITION BY node, f ORDER BY b), every AS (PARTITION BY node, f)),
                best AS (
                    SELECT node, arg_min({{'f': f, 'b': b, 'gain': gain, 'ha': ha}}, {{'k': -gain, 'f': f, 'b': b}}) AS s FROM (
                        SELECT *, gl * gl / (hl + {l2}) + (ga - gl) * (ga - gl) / (ha - hl + {l2})
                                  - ga * ga / (ha + {l2}) AS gain FROM run WHERE hl < ha)
                    WHERE gain > {LEAST_GAIN!r}::DOUBLE GROUP BY node)"""


def _boosting(settings) -> list[str]:
    """``boosted``: rows move down a level at a time; after the last level the next tree starts."""
    depth = settings.boost_depth
    return [f"""boosting(house_id, pred, node, t, level) USING KEY (house_id) AS (
            SELECT house_id, (SELECT sum(y)::DOUBLE / 65536::DOUBLE / count(*) FROM binned WHERE is_train), 1, 0, 0
            FROM binned
            UNION (
                WITH here AS (
                    SELECT g.*, is_train, bins,
                           floor((y / 65536::DOUBLE - pred) * 65536::DOUBLE + 0.5)::BIGINT AS r
                    FROM boosting g JOIN binned USING (house_id) WHERE t < {settings.rounds}),
                cells AS (
                    SELECT node, f, b, sum(r)::BIGINT AS s, count(*) AS h FROM (
                        SELECT node, unnest(range({len(V12)})) AS f, unnest(bins) AS b, r
                        FROM here WHERE is_train AND level < {depth}) GROUP BY node, f, b),
                {_best_splits('1.0::DOUBLE')},
                leaf AS (
                    SELECT node, {BOOST_RATE!r}::DOUBLE * (sum(r)::DOUBLE / 65536::DOUBLE)
                                 / (count(*) + 1.0::DOUBLE) AS value
                    FROM here WHERE is_train AND level = {depth} GROUP BY node)
                SELECT house_id, CASE WHEN level = {depth} THEN pred + value ELSE pred END,
                       CASE WHEN level = {depth} THEN 1
                            ELSE 2 * h.node + coalesce(bins[b.s.f + 1] > b.s.b, false)::INT END,
                       t + (level = {depth})::INT, CASE WHEN level = {depth} THEN 0 ELSE level + 1 END
                FROM here h LEFT JOIN best b ON b.node = h.node LEFT JOIN leaf l ON l.node = h.node))""",
            "boosted AS (SELECT house_id, pred AS prediction FROM boosting)"]


def _growing(settings, gains: bool = False) -> list[str]:
    """``growing``: all trees grow together, a level at a time; rows outside a sample have weight 0.

    With ``gains``, only rows of the samples go along, and each collects its share of the gains of its splits by feature.
    """
    u = uniform("t || ':' || house_id", f"bag{settings.seed}")
    weight = " + ".join(f"(u >= {bound!r}::DOUBLE)::INT" for bound in POISSON)
    n, head, start, step = len(V12), "", "", ""
    if gains:
        head, start = ", gains", f", list_value({', '.join(['0.0::DOUBLE'] * n)})"
        step = (", list_transform(gains, lambda v, i: CASE WHEN i = b.s.f + 1 THEN v + b.s.gain * w / b.s.ha ELSE v END)")
    return [
        f"""bag AS MATERIALIZED (
            SELECT * FROM (
                SELECT house_id, t, CASE WHEN is_train THEN {weight} ELSE 0 END AS w
                FROM (SELECT house_id, is_train, t, {u} AS u FROM binned, range({settings.trees}) AS r(t)))
            {'WHERE w > 0' if gains else ''})""",
        f"""growing(house_id, t, w, node, level{head}) USING KEY (house_id, t) AS (
            SELECT house_id, t, w, t, 0{start} FROM bag
            UNION (
                WITH here AS (
                    SELECT g.*, bins, y FROM growing g JOIN binned USING (house_id) WHERE level < {settings.tree_depth}),
                cells AS (
                    SELECT node, f, b, sum(w * y)::BIGINT AS s, sum(w)::BIGINT AS h FROM (
                        SELECT node, unnest(range({n})) AS f, unnest(bins) AS b, w, y FROM here WHERE w > 0)
                    GROUP BY node, f, b),
                {_best_splits('0.0::DOUBLE')}
                SELECT house_id, t, w, h.node + CASE WHEN b.s IS NULL THEN 0 ELSE {settings.trees}
                       * (1::BIGINT << level) * (1 + (bins[b.s.f + 1] > b.s.b)::BIGINT) END, level + 1{step}
                FROM here h LEFT JOIN best b ON b.node = h.node))""",
    ]


def _forest(settings) -> list[str]:
    """``forest``: the mean of the leaves that each row reaches."""
    return [
        *_growing(settings),
        """leaves AS (
            SELECT node, sum(w * y)::DOUBLE / 65536::DOUBLE / sum(w) AS value
            FROM growing JOIN binned USING (house_id) WHERE w > 0 GROUP BY node)""",
        "forest AS (SELECT house_id, avg(value) AS prediction FROM growing JOIN leaves USING (node) GROUP BY house_id)",
    ]


def _forest_importances(limit: int) -> str:
    """The forest's gains by feature, scaled to 1 in each tree and then over all."""
    names = ", ".join(f"'{f}'" for f in V12)
    settings = ml.Settings()
    steps = [_BASE, *_bins(settings), *_growing(settings, gains=True), """by_tree AS (
            SELECT t, f, sum(gain) AS gain FROM (
                SELECT t, unnest(range(len(gains))) AS f, unnest(gains) AS gain FROM growing) GROUP BY t, f)""",
             """shares AS (
            SELECT f, sum(share) AS share FROM (
                SELECT f, gain / nullif(sum(gain) OVER (PARTITION BY t), 0) AS share FROM by_tree) GROUP BY f)"""]
    return _on("noisy", f"""SELECT * FROM (WITH RECURSIVE {', '.join(steps)}
            SELECT ([{names}])[f + 1] AS feature, {r('share / sum(share) OVER ()')} AS importance FROM shares
            ORDER BY importance DESC, feature LIMIT {limit})""")


def _fitted(then: str) -> str:
    return _on("noisy", f"SELECT * FROM (WITH {', '.join([_BASE, *_least_squares()])} {then})")


_LINE = _fitted(f"SELECT house_id, {r('prediction', 1)} AS prediction FROM tested")
_MODELS = ["linear", "rf", "gbt"]


def _scored_by(models: list[str], then: str) -> str:
    """Fits the models on the training part; ``predicted`` has (house_id, usable, is_train, y, model, prediction)."""
    settings = ml.Settings()
    steps, parts = [_BASE], []
    if "linear" in models:
        steps += _least_squares()
    if set(models) - {"linear"}:
        steps += _bins(settings)
    if "gbt" in models:
        steps += _boosting(settings)
    if "rf" in models:
        steps += _forest(settings)
    for model, found in [("linear", "line"), ("rf", "forest"), ("gbt", "boosted")]:
        if model in models:
            parts.append(f"SELECT b.house_id, b.usable, b.is_train, b.y, '{model}' AS model, p.prediction "
                         f"FROM base b JOIN {found} p USING (house_id)")
    steps.append(f"predicted AS ({' UNION ALL '.join(parts)})")
    return _on("noisy", f"SELECT * FROM (WITH RECURSIVE {', '.join(steps)} {then})")


_COMPARED = f"CASE WHEN model = 'linear' THEN {r('prediction', 1)} ELSE {r('prediction', 5)} END AS prediction"


def _test_quality(models: list[str], digits: int) -> str:
    return _scored_by(models, f"""
        SELECT model, count(*) AS n, {_metrics(_METRICS, digits)}
        FROM predicted WHERE usable AND NOT is_train GROUP BY model""")


_NEEDED = "(daily_kwh * 1000.0)"
# The quotient of a whole number of panels, found from the exact remainder.
_PANELS = f"""round((({_NEEDED} + panel - 1) - (({_NEEDED} + panel - 1) % panel)) / panel)"""


def statements() -> dict[str, str]:
    training_columns = _quoted(["house_id", *V12, TARGET])
    part_of = f"CASE WHEN {uniform('house_id', 'split42')} < 1.0 - 0.3 THEN 'train' ELSE 'test' END"
    return {
        # sources and sinks
        "scan_training": _on("training", f"SELECT {training_columns} FROM training"),
        "select_features": _on(
            "training", f"SELECT {_quoted(['house_id', *V12])} FROM training"),
        "ingest_households": _on("checked", """
            SELECT record_id, trim(house_id) AS house_id, total_consumption_kwh,
                   coalesce(reason, '') AS reason, coalesce(iso, date) AS date,
                   CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome
            FROM checked"""),
        "household_by_id": _on("predictions", """
            SELECT _id, house_id, predicted_value_kwh FROM predictions WHERE house_id = 42"""),
        "households_by_ids": _on("predictions", """
            SELECT _id, house_id, predicted_value_kwh FROM predictions WHERE house_id IN
                (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD')"""),
        "append_prediction_log": _on("requests", """
            SELECT house_id::VARCHAR AS _id, house_id::VARCHAR AS house_id, model,
                   0.0001 * total_appliance_power * "MonthlyHours" + 0.5 * "Month_num"
                       AS predicted_value_kwh,
                   12::INTEGER AS n_features,
                   CASE WHEN has_meta THEN 'form' ELSE '' END AS source,
                   strftime(o_orderdate, '%Y-%m-%d') AS day
            FROM requests JOIN orders ON house_id = o_orderkey
            WHERE model <> 'unknown' AND NOT short AND NOT gap"""),
        "prediction_history": _on("predictions", """
            SELECT _id, house_id, model, predicted_value_kwh, strftime(ts, '%Y-%m-%d') AS day
            FROM predictions WHERE model = 'rf' ORDER BY ts DESC, _id DESC LIMIT 50"""),
        "write_metrics": _on("scored", f"""
            SELECT model, count(*) AS n, {_metrics(_METRICS)} FROM scored GROUP BY model"""),
        "write_thresholds": _ROUNDED_LIMITS,
        "available_models": "SELECT 'linear' AS model, 'Linear Regression' AS label",
        "clip_target": _on("training", f"""
            SELECT house_id, greatest("{TARGET}" - 20.0, 0.0::DOUBLE) AS "{TARGET}"
            FROM training"""),
        "add_noise": _on("noisy", f"""
            SELECT house_id, {r('noisy_target')} AS "{TARGET}" FROM noisy"""),
        "city_one_hot": _on("houses", """
            SELECT house_id, city_code, (city_code NOT IN (2, 3, 4))::INT::DOUBLE AS "City_City_A",
                   (city_code = 2)::INT::DOUBLE AS "City_City_B",
                   (city_code = 3)::INT::DOUBLE AS "City_City_C",
                   (city_code = 4)::INT::DOUBLE AS "City_City_D" FROM houses"""),
        "appliance_watts": _on("inventory", f"""
            SELECT house_id, name, mode, value,
                   CASE WHEN mode = 'power' THEN coalesce(value, 0)
                        ELSE {r('coalesce(value, 0) * each', 2)} END AS watts
            FROM (SELECT *, CASE name WHEN 'Fan' THEN 70 WHEN 'Refrigerator' THEN 150
                        WHEN 'AirConditioner' THEN 1200 WHEN 'Television' THEN 100
                        WHEN 'Monitor' THEN 30 WHEN 'MotorPump' THEN 500 ELSE 0 END AS each
                  FROM (SELECT house_id, CASE WHEN hours = 0 THEN 'Heater' ELSE name END AS name,
                               CASE WHEN house_id % 2 = 0 THEN 'power'
                                    WHEN house_id % 3 = 0 THEN 'count' END AS mode,
                               CASE WHEN house_id % 2 = 0 THEN power WHEN qty > 0 THEN qty END
                                   AS value
                        FROM inventory))"""),
        "net_bill": _on("forms", f"SELECT row_id, {_BILL} AS net_bill FROM forms"),
        "assemble_vector": _vector(_VECTOR_V12),
        "assemble_vector_v16": _vector(_VECTOR_V16),
        "autofill": _autofill(False),
        "autofill_force": _autofill(True),
        "solar_sizing": _on("solar", f"""
            SELECT request_id, daily_kwh, sun_hours, panel_watt, efficiency,
                   {_PANELS}::BIGINT AS panels_required,
                   {exact_round(f"(panel * {_PANELS} / 1000.0)", 4, "even")}
                       AS estimated_daily_generation_kwh,
                   {exact_round("panel", 2, "even")} AS panel_daily_wh
            FROM solar WHERE daily_kwh > 0 AND sun_hours > 0 AND panel_watt > 0 AND panel > 0"""),
        "solar_sizing_ceil": _on("solar", f"""
            SELECT request_id, daily_kwh, sun_hours, panel_watt, n::BIGINT AS panels_required,
                   {exact_round("(p * n / 1000.0)", 2, "up")} AS estimated_daily_generation_kwh
            FROM (SELECT *, ceil(daily_kwh * 1000 / p) AS n
                  FROM (SELECT *, panel_watt * sun_hours * 0.75 AS p FROM solar
                        WHERE daily_kwh > 0 AND sun_hours > 0))"""),
        "prediction_band": _on("predictions", """
            SELECT _id, CASE WHEN predicted_value_kwh <= 100 THEN 'green'
                             WHEN predicted_value_kwh > 500 THEN 'red' ELSE 'orange' END AS band
            FROM predictions"""),
        "gauge_pct": _on("linked", """
            SELECT _id, least(100.0::DOUBLE, floor(predicted_value_kwh / greatest(1.0::DOUBLE,
                   coalesce(nullif(last_kwh, 0), predicted_value_kwh)) * 50.0 + 10.0 + 0.5))
                   AS gauge_pct
            FROM linked"""),
        "residuals": _on("scored", """
            SELECT house_id, model, y, prediction, y - prediction AS residual FROM scored"""),
        "pred_vs_actual": _on("scored", """
            SELECT house_id, model, y, prediction,
                   min(least(y, prediction)) OVER (PARTITION BY model) AS diagonal_min,
                   max(greatest(y, prediction)) OVER (PARTITION BY model) AS diagonal_max
            FROM scored"""),
        "parse_record_date": _on("checked", """
            SELECT record_id, iso, moment::VARCHAR AS at_utc FROM checked"""),
        "month_num": _on("checked", """
            SELECT record_id, month(moment)::DOUBLE AS "Month_num" FROM checked
            WHERE reason IS NULL"""),
        "label_encode": _on("houses", f"""
            SELECT house_id, city_code, company, a.code AS "Company_code", b.code AS "City_index"
            FROM houses JOIN {_lookup_sql('company')} a USING (company)
                 JOIN {_lookup_sql('city_code')} b USING (city_code)"""),
        "scaler_stats": _on("part_train", " UNION ALL ".join(
            f"SELECT '{f}' AS feature, {r(m)} AS mean, {r(s)} AS std FROM part_train"
            for f, (m, s) in _STATS.items())),
        "standardize": _on("part_train", "SELECT house_id, " + ", ".join(
            r(f'("{f}" - m{i}) / CASE WHEN s{i} = 0 THEN 1 ELSE s{i} END') + f' AS "{f}"'
            for i, f in enumerate(V12)) + " FROM training, (SELECT " + ", ".join(
            f"{m} AS m{i}, {s} AS s{i}" for i, (m, s) in enumerate(_STATS.values()))
            + " FROM part_train)"),
        "chart_date": _on("points", "SELECT _id, label FROM points"),
        "first_present_kwh": _on("points", "SELECT _id, kwh FROM points"),
        "units_to_kwh": """
            SELECT event_id, value, unit, value * factor AS kwh,
                   CASE WHEN factor IS NULL THEN 'unknown unit' END AS reason
            FROM (SELECT *, CASE unit WHEN 'Wh' THEN 0.001::DOUBLE WHEN 'kWh' THEN 1.0::DOUBLE
                                      WHEN 'MWh' THEN 1000.0::DOUBLE END AS factor
                  FROM (SELECT event_id, value, CASE event_type WHEN 'view' THEN 'Wh'
                               WHEN 'click' THEN 'kWh' WHEN 'purchase' THEN 'MWh'
                               WHEN 'signup' THEN 'kWh' END AS unit FROM events))""",
        "clean_training": _on("training", f"""
            SELECT {training_columns} FROM training
            WHERE house_id % 37 <> 0 AND house_id % 41 <> 0 AND house_id % 43 <> 0
              AND house_id % 47 <> 0"""),
        "predicted_bill": _on("training", f"""
            SELECT house_id, {r(f'"{TARGET}" * "TariffRate"', 2)} AS predicted_bill
            FROM training"""),
        "solar_offset": _on("training", f"""
            SELECT house_id, CASE WHEN house_id % 9 <> 0
                   THEN least(100.0::DOUBLE, {_SOLAR} / {_GRID} * 100) END AS solar_offset_pct
            FROM training"""),
        "surplus_energy": _on("training", f"""
            SELECT house_id, greatest({_SOLAR} - {_GRID}, 0.0::DOUBLE) AS surplus_kwh,
                   greatest({_GRID} - {_SOLAR}, 0.0::DOUBLE) AS grid_need_kwh FROM training"""),
        "js_round2": _on("training", f"""
            SELECT house_id, {r(f'{_GRID} * "TariffRate" - 500.0', 2)} AS rounded
            FROM training"""),
        # validation
        "validate_household": _on("checked", """
            SELECT record_id, trim(house_id) AS house_id, reason FROM checked"""),
        "validate_solar": _on("solar", """
            SELECT request_id, CASE WHEN daily_kwh <= 0 OR sun_hours <= 0 OR panel_watt <= 0
                                    THEN 'inputs must be positive' END AS reason FROM solar"""),
        "validate_vector": _on("requests", """
            SELECT house_id, model, CASE WHEN model = 'unknown' THEN 'model not available'
                WHEN gap THEN 'feature is not a number'
                WHEN short THEN 'wrong number of features' END AS reason FROM requests"""),
        "validate_fields": _on("forms", " UNION ALL ".join(map(_field, _ALL_FIELDS))),
        "blocked_rows": _on("forms", "SELECT row_id FROM forms WHERE " + " OR ".join(
            _is_error(f) for f in _ALL_FIELDS)),
        "filter_model": _on("predictions", """
            SELECT _id, model, predicted_value_kwh FROM predictions WHERE model = 'linear'"""),
        "zero_target_rows": _on("noisy", f"""
            SELECT house_id, 0.0::DOUBLE AS "{TARGET}" FROM noisy WHERE {_CLIPPED} = 0"""),
        "outlier_flags": _on("training", f"""
            SELECT house_id, {_GRID} > grid_p95 AS grid_above_p95,
                   {_GRID} > grid_p99 AS grid_above_p99,
                   "MonthlyHours" < monthly_min OR "MonthlyHours" > monthly_max AS hours_outside,
                   total_appliance_power > total_power_p99 AS power_above_p99
            FROM training, ({_LIMITS})"""),
        "outlier_flags_published": _on("training", f"""
            SELECT house_id, {_GRID} > {PUBLISHED_THRESHOLDS['grid_p95']!r}::DOUBLE AS grid_above_p95,
                   {_GRID} > {PUBLISHED_THRESHOLDS['grid_p99']!r}::DOUBLE AS grid_above_p99,
                   "MonthlyHours" < {PUBLISHED_THRESHOLDS['monthly_min']!r}::DOUBLE
                       OR "MonthlyHours" > {PUBLISHED_THRESHOLDS['monthly_max']!r}::DOUBLE AS hours_outside,
                   total_appliance_power > {PUBLISHED_THRESHOLDS['total_power_p99']!r}::DOUBLE AS power_above_p99
            FROM training"""),
        "known_model_rows": _on("predictions", """
            SELECT _id, model FROM predictions WHERE model IN ('linear', 'rf', 'gbt')"""),
        "unknown_model_rows": _on("predictions", """
            SELECT _id, model FROM predictions WHERE model NOT IN ('linear', 'rf', 'gbt')"""),
        # aggregations
        "describe_target": _on("noisy", _describe("before", f'"{TARGET}"') + " UNION ALL "
                               + _describe("after", _CLIPPED)),
        "count_zero_target": _on("noisy", f"""
            SELECT count(*) FILTER (WHERE {_CLIPPED} = 0) AS zeros FROM noisy"""),
        "household_consumption": _on("inventory", """
            SELECT house_id, sum(power * hours * q) / 1000 AS daily_kwh,
                   sum(power * hours * q) / 1000 * 30 AS monthly_kwh
            FROM inventory GROUP BY house_id"""),
        "import_appliances": _on("rollup", "SELECT * FROM rollup"),
        "appliance_usage_map": _on("usage", "SELECT house_id, name, usage FROM usage"),
        "household_records": _on("usage", f"""
            SELECT house_id, strftime(o_orderdate, '%Y-%m-%d') AS date, total_consumption_kwh, name, usage
            FROM usage JOIN (SELECT house_id, {r('sum(power * hours * q) / 1000 * 30')} AS total_consumption_kwh
                             FROM inventory GROUP BY house_id) USING (house_id)
                 JOIN orders ON o_orderkey = house_id"""),
        "import_and_autofill": _on("rollup", "SELECT * FROM (" + _autofill(True).replace(
            "FROM forms", """FROM (SELECT f.* REPLACE (r.total_appliance_power::VARCHAR AS power,
                r.appliance_count::VARCHAR AS count_, r.avg_power_per_appliance::VARCHAR AS mean_)
                FROM forms f JOIN rollup r ON f.row_id = r.house_id)""") + ")"),
        "submit_form": _on("forms", "SELECT f.row_id, " + ", ".join(
            f'{x} AS "{name}"' for name, x in {
                **_VECTOR_V12,
                "total_appliance_power": f"coalesce(a.total_appliance_power, {_zero('alias_')})",
                "MonthlyHours": 'coalesce(a."MonthlyHours", 0.0::DOUBLE)',
                "avg_power_per_appliance": "coalesce(a.avg_power_per_appliance, 0.0::DOUBLE)",
            }.items()) + f""" FROM forms f JOIN ({_autofill(False)}) a USING (row_id)
            WHERE NOT ({" OR ".join(_is_error(f) for f in _ALL_FIELDS)})"""),
        "usage_by_appliance": _on("usage", """
            SELECT name, sum(usage) AS usage FROM usage GROUP BY name"""),
        "standby_energy": _on("inventory", """
            SELECT house_id, standby_kwh, daily_kwh,
                   CASE WHEN daily_kwh <> 0 THEN standby_kwh / daily_kwh END AS standby_share
            FROM (SELECT house_id, sum(power * hours * q) / 1000 AS daily_kwh,
                         sum(CASE WHEN name = 'Television' THEN power * hours * q
                                  ELSE 0 END) / 1000 AS standby_kwh
                  FROM inventory GROUP BY house_id)"""),
        "daily_total": _on("inventory", """
            SELECT sum(power * hours * q) / 1000 AS daily_kwh,
                   sum(power * hours * q) / 1000 * 30 AS monthly_kwh FROM inventory"""),
        **{key: _on("scored", f"SELECT model, {_metrics([name])} FROM scored GROUP BY model")
           for key, name in [("metric_rmse", "RMSE"), ("metric_mae", "MAE"), ("metric_r2", "R2"),
                             ("metric_mape_safe", "MAPE_safe"), ("metric_smape", "SMAPE")]},
        "eval_metrics": _on("scored", f"""
            SELECT model, count(*) AS n, {_metrics(_METRICS)} FROM scored GROUP BY model"""),
        "thresholds": _ROUNDED_LIMITS,
        "maintained_statistics": _on("training", " UNION ALL ".join(f"""
            SELECT '{c}' AS name, count("{c}") AS count, {r(f'avg("{c}")')} AS mean, {r(f'stddev_samp("{c}")')} AS std,
                   {r(f'stddev_pop("{c}")')} AS std_pop, min("{c}") AS min, max("{c}") AS max,
                   quantile_disc("{c}", 0.95) AS p95, quantile_disc("{c}", 0.99) AS p99 FROM training"""
                                                                for c in [*V12, TARGET])),
        "maintained_metrics": _on("scored", f"""
            SELECT model, count(*) AS n, {_metrics(_METRICS)} FROM scored GROUP BY model"""),
        "monthly_trend": _on("predictions", f"""
            SELECT strftime(ts, '%Y-%m') AS month, {r('sum(predicted_value_kwh)')} AS sum_kwh,
                   {r('avg(predicted_value_kwh)')} AS mean_kwh FROM predictions GROUP BY 1"""),
        # windows and order
        "recent_30": _RECENT,
        "delta_vs_last": _on("linked", """
            SELECT _id, house_id, predicted_value_kwh, last_kwh,
                   predicted_value_kwh - last_kwh AS delta_kwh,
                   CASE WHEN predicted_value_kwh >= last_kwh THEN 'up'
                        WHEN predicted_value_kwh < last_kwh THEN 'down' END AS direction
            FROM linked"""),
        "rank_models": _on("scored", f"""
            SELECT model, "MAPE_safe", "R2",
                   row_number() OVER (ORDER BY "MAPE_safe", "R2" DESC)::INTEGER AS rank
            FROM (SELECT model, {_metrics(['MAPE_safe', 'R2'])} FROM scored GROUP BY model)"""),
        "chart_series": _on("points", """
            SELECT row_number() OVER (ORDER BY moment, _id) AS position, _id, label, kwh
            FROM points"""),
        # models
        "train_test_split": _on("training", f"SELECT house_id, {part_of} AS part FROM training"),
        "train_test_split_exact": _on("training", f"""
            SELECT house_id, CASE WHEN rn <= n - ceil(n * 0.3) THEN 'train' ELSE 'test' END AS part
            FROM (SELECT house_id, count(*) OVER () AS n, row_number() OVER
                         (ORDER BY {hash52('house_id', 'split42')}) AS rn FROM training)"""),
        "linear_sql": _on("training", f"""
            SELECT {r(f'regr_slope("{TARGET}", total_appliance_power)')} AS slope,
                   {r(f'regr_intercept("{TARGET}", total_appliance_power)')} AS intercept,
                   {r(f'regr_r2("{TARGET}", total_appliance_power)')} AS r2, count(*) AS n
            FROM training"""),
        "fit_linear": _fitted(f"""
            SELECT 'linear' AS model, count(*) AS n, {_metrics(_METRICS, 3)}
            FROM tested"""),
        "fit_forest": _test_quality(["rf"], 6),
        "fit_boosted": _test_quality(["gbt"], 6),
        "evaluate_models": _test_quality(_MODELS, 3),
        "train_pipeline": _scored_by(_MODELS, f"""
            SELECT model, label, n, row_number() OVER (ORDER BY "MAPE_safe", "R2" DESC)::INTEGER AS rank
            FROM (SELECT model, count(*) AS n, {_metrics(['MAPE_safe', 'R2'], 9)}
                  FROM predicted WHERE usable AND NOT is_train GROUP BY model)
            JOIN (VALUES ('linear', 'Linear Regression'), ('rf', 'Random Forest'),
                ('gbt', 'Gradient-Boosted Trees')) AS k(model, label) USING (model)"""),
        "score_all_models": _scored_by(_MODELS, f"""
            SELECT house_id, model, {r('y')} AS y, {_COMPARED} FROM predicted WHERE usable AND NOT is_train"""),
        "score_requests": _fitted(f"""
            SELECT house_id::VARCHAR AS _id, house_id::VARCHAR AS house_id, model,
                   CASE WHEN model = 'linear' THEN {r('prediction', 1)} END AS linear_prediction,
                   12::INTEGER AS n_features, CASE WHEN house_id % 2 = 0 THEN 'form' ELSE '' END AS source
            FROM line JOIN (SELECT house_id, CASE house_id % 4 WHEN 0 THEN 'linear' WHEN 1 THEN 'rf'
                WHEN 2 THEN 'gbt' END AS model FROM line) USING (house_id)
            WHERE model IS NOT NULL AND house_id % 15 <> 0 AND house_id % 25 <> 0"""),
        "score_by_model": _scored_by(_MODELS, f"""
            SELECT house_id, model, {_COMPARED} FROM predicted
            WHERE model = CASE house_id % 4 WHEN 0 THEN 'linear' WHEN 1 THEN 'rf' WHEN 2 THEN 'gbt' END
                AND house_id % 15 <> 0 AND house_id % 25 <> 0"""),
        "stream_score_by_model": _scored_by(_MODELS, f"""
            SELECT house_id, model, CASE WHEN reason = '' THEN {_COMPARED.removesuffix(' AS prediction')} END AS prediction,
                   CASE WHEN reason = '' THEN 'accepted' ELSE 'rejected' END AS outcome, reason
            FROM (SELECT k.*, p.prediction FROM (
                SELECT house_id, model, CASE WHEN model = 'unknown' THEN 'model not available'
                    WHEN house_id % 25 = 0 AND house_id % 15 <> 0 THEN 'feature is not a number'
                    WHEN house_id % 15 = 0 THEN 'wrong number of features' ELSE '' END AS reason
                FROM (SELECT house_id, CASE house_id % 4 WHEN 0 THEN 'linear' WHEN 1 THEN 'rf'
                             WHEN 2 THEN 'gbt' ELSE 'unknown' END AS model FROM base)) k
                LEFT JOIN predicted p ON p.house_id = k.house_id AND p.model = k.model)"""),
        "top_feature_importances": _forest_importances(20),
        "predict_batch": _LINE,
        "save_load_models": _LINE,
        # streams
        "stream_ingest": _on("stream_records", """
            SELECT *, CASE WHEN reason = '' THEN 'accepted' ELSE 'rejected' END AS outcome
            FROM stream_records"""),
        "stream_score": _LINE,
        "stream_delta": _READINGS_DELTA,
        "stream_recent_30": _RECENT,
        "stream_usage_daily": f"""
            SELECT strftime(day, '%Y-%m-%d') AS day, event_type AS appliance,
                   {r('sum(value)')} AS kwh
            FROM (SELECT *, date_trunc('day', ts) AS day FROM events)
            WHERE day + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '1 day'
            GROUP BY 1, 2""",
    }
