"""DuckDB statements that give the expected rows of each query.

Every statement starts from the raw tables; ``stage`` strings chain common table
expressions up to the one a query needs.
"""

from __future__ import annotations

from tillroll.functions.bands import (CLOSENESS, LEVELS, LOWEST_CLOSENESS, LOWEST_LEVEL,
                                      ORDER_RANGES, PRICE_BANDS, range_names)
from tillroll.functions.stem import DOUBLE, FINAL, FOURTH_STEP, REGION, SECOND_REGION, SECOND_STEP, SHORT, SPECIAL, THIRD_STEP, VOWEL
from tillroll.operators.keywords import CLOUD_STOP, COLOURS

CUTOFF = "TIMESTAMP '2000-09-01 00:00:00'"
DAY = 86_400_000_000
LINE = '"InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"'
ORDER = ('"InvoiceDate", "InvoiceNo", "StockCode", "Description" NULLS FIRST, "Quantity", "UnitPrice", '
         '"CustomerID", "Country"')

STAGES: dict[str, str] = {}


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


STAGES["raw"] = """
  SELECT (CASE WHEN cancel THEN 'C' ELSE '' END) || CAST(o_orderkey AS VARCHAR) AS "InvoiceNo",
         (CASE WHEN p_size = 1 THEN 'D' ELSE '' END) || lpad(CAST(p_partkey % 64 AS VARCHAR), 5, '0') AS "StockCode",
         CASE WHEN p_size = 2 THEN 'Discount' ELSE upper(p_name || ' ' || p_type) END AS "Description",
         CAST(CASE WHEN cancel THEN -l_quantity ELSE l_quantity END AS INTEGER) AS "Quantity",
         l_shipdate AS "InvoiceDate",
         CAST(((CAST(round(p_retailprice * 100) AS BIGINT) * p_size + 5000) // 10000) / 100.0 AS DECIMAL(12,4)) AS "UnitPrice",
         CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS "CustomerID",
         n_name AS "Country"
  FROM (SELECT *, l_returnflag = 'R' AND l_linestatus = 'F' AS cancel FROM lineitem
        UNION ALL
        SELECT *, l_returnflag = 'R' AND l_linestatus = 'F' AS cancel FROM lineitem
        WHERE l_linenumber = 7 AND l_suppkey % 2 = 0) l
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
STAGES["known"] = 'SELECT * FROM raw WHERE "CustomerID" IS NOT NULL'
STAGES["clean"] = "SELECT DISTINCT * FROM known"
STAGES["train"] = f'SELECT * FROM clean WHERE "InvoiceDate" < {CUTOFF}'
STAGES["later"] = f'SELECT * FROM clean WHERE "InvoiceDate" >= {CUTOFF}'
STAGES["numbered"] = f"SELECT *, row_number() OVER (ORDER BY {ORDER}) AS rid FROM train"
STAGES["cx"] = """SELECT * FROM numbered WHERE "Quantity" <= 0 AND "Description" IS DISTINCT FROM 'Discount'"""
STAGES["pairs"] = """
  SELECT a.rid AS crid, -a."Quantity" AS need, b.rid AS orid, b."Quantity" AS oq,
         count(*) OVER (PARTITION BY a.rid) AS n
  FROM cx a JOIN numbered b ON a."CustomerID" = b."CustomerID" AND a."StockCode" = b."StockCode"
       AND b."InvoiceDate" < a."InvoiceDate" AND b."Quantity" > 0"""
STAGES["chosen"] = "SELECT crid, need, max(orid) AS orid FROM pairs WHERE n = 1 OR oq >= need GROUP BY crid, need"
STAGES["status"] = """
  SELECT c.*, CASE WHEN p.crid IS NULL THEN 'doubtful' WHEN h.crid IS NOT NULL THEN 'matched' ELSE 'remaining' END AS status
  FROM cx c LEFT JOIN (SELECT DISTINCT crid FROM pairs) p ON c.rid = p.crid LEFT JOIN chosen h ON c.rid = h.crid"""
STAGES["cancelled"] = "SELECT orid, arg_max(need, crid) AS units FROM chosen GROUP BY orid"
STAGES["cleaned"] = """
  SELECT n.*, coalesce(q.units, 0) AS "QuantityCanceled",
         n."UnitPrice" * (n."Quantity" - coalesce(q.units, 0)) AS "TotalPrice"
  FROM numbered n LEFT JOIN cancelled q ON n.rid = q.orid
  WHERE n.rid NOT IN (SELECT rid FROM status WHERE status <> 'remaining')"""
STAGES["allbaskets"] = """
  SELECT "CustomerID", "InvoiceNo", sum("TotalPrice") AS basket_price,
         make_timestamp(CAST(sum(epoch_us("InvoiceDate")) // count(*) AS BIGINT)) AS "InvoiceDate"
  FROM cleaned GROUP BY "CustomerID", "InvoiceNo\""""
STAGES["baskets"] = "SELECT * FROM allbaskets WHERE basket_price > 0"
STAGES["metrics"] = f"""
  SELECT "CustomerID",
         ((SELECT epoch_us(max("InvoiceDate")) FROM baskets) + {DAY} - epoch_us(max("InvoiceDate"))) // {DAY} AS "Recency",
         count(*) AS "Frequency", sum(basket_price) AS "MonetaryValue",
         (epoch_us(max("InvoiceDate")) - epoch_us(min("InvoiceDate"))) // {DAY} AS "Lenght",
         date_diff('day', CAST(max("InvoiceDate") AS DATE), (SELECT CAST(max("InvoiceDate") AS DATE) FROM baskets)) AS "LastPurchase",
         date_diff('day', CAST(min("InvoiceDate") AS DATE), (SELECT CAST(max("InvoiceDate") AS DATE) FROM baskets)) AS "FirstPurchase"
  FROM baskets GROUP BY "CustomerID\""""


def _iqr(prefix: str, start: str, attributes: list[str]) -> str:
    before = start
    for i, a in enumerate(attributes):
        x = f'CAST("{a}" AS DOUBLE)'
        q1, q3 = f"quantile_cont({x}, 0.25)", f"quantile_cont({x}, 0.75)"
        STAGES[f"{prefix}{i}"] = (
            f'SELECT * FROM {before} WHERE {x} BETWEEN (SELECT {q1} - 2 * ({q3} - {q1}) FROM {before}) '
            f'AND (SELECT {q3} + 2 * ({q3} - {q1}) FROM {before})')
        before = f"{prefix}{i}"
    return before


RFM_KEPT = _iqr("keptr", "metrics", ["Recency", "Frequency", "MonetaryValue"])
LENGTH_KEPT = _iqr("keptl", "metrics", ["CustomerID", "MonetaryValue", "Lenght", "LastPurchase", "FirstPurchase"])
STAGES["combined"] = (f'SELECT r."CustomerID", r."Recency", r."Frequency", r."MonetaryValue", l."Lenght" '
                      f'FROM {RFM_KEPT} r LEFT JOIN {LENGTH_KEPT} l ON r."CustomerID" = l."CustomerID"')


def _by_value(column: str, labels: list[int]) -> str:
    x = f'CAST("{column}" AS DOUBLE)'
    whens = " ".join(f"WHEN {x} <= (SELECT quantile_cont({x}, {k / 4}) FROM combined) THEN {label}"
                     for k, label in zip((1, 2, 3), labels))
    return f"CASE {whens} ELSE {labels[3]} END"


def _by_rank(column: str) -> str:
    place = f'row_number() OVER (ORDER BY "{column}" NULLS LAST, "CustomerID")'
    n = f'(SELECT count("{column}") FROM combined)'
    return (f'CASE WHEN "{column}" IS NOT NULL THEN least(4, greatest(1, '
            f'(({place} - 1) * 4 + {n} - 2) // ({n} - 1))) END')


STAGES["quartiles"] = (f'SELECT *, {_by_value("Recency", [4, 3, 2, 1])} AS "R", {_by_rank("Frequency")} AS "F", '
                       f'{_by_value("MonetaryValue", [1, 2, 3, 4])} AS "M", {_by_rank("Lenght")} AS "L" FROM combined')


def _labels(score: str, steps, lowest: str) -> str:
    whens = " ".join(f"WHEN {score} >= {least} THEN {quoted([name])}" for least, name in steps)
    return f"CASE {whens} ELSE {quoted([lowest])} END"


STAGES["scored"] = f"""
  SELECT *, {_labels('"RFML_Score"', LEVELS, LOWEST_LEVEL)} AS "RFML_Level",
         {_labels('"Proximidade_Marca_Score"', CLOSENESS, LOWEST_CLOSENESS)} AS "Proximidade_Marca"
  FROM (SELECT *, "R" + "F" AS "Proximidade_Marca_Score", "R" + "F" + "M" + coalesce("L", 0) AS "RFML_Score",
               CAST("R" AS VARCHAR) || CAST("F" AS VARCHAR) || CAST("M" AS VARCHAR)
               || coalesce(CAST("L" AS VARCHAR), 'nan') AS "RFML_Segment_Concat" FROM quartiles)"""


def stem_sql(word: str) -> str:
    """The root of a word by the published rules, with every step's word bound once."""
    ends = lambda w, suffix: f"ends_with({w}, '{suffix}')"
    like = lambda w, pattern: f"regexp_matches({w}, '{pattern}')"
    cut = lambda w, n: f"left({w}, length({w}) - {n})"
    inside = lambda region, n: f"length(s.w) - {n} >= s.{region}"
    w = "s.w"

    def cases(pairs: list[tuple[str, str]], other: str = w) -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"

    def bound(value: str, name: str, use: str) -> str:
        return f"list_transform([{value}], lambda {name}: {use})[1]"

    def replaced(rules: list[tuple[str, str, str, str]]) -> str:
        return cases([(ends(w, x), cases([(inside(r, len(x)) + (f" AND {like(cut(w, len(x)), before)}" if before else ""), f"{cut(w, len(x))} || '{new}'")]))
                      for x, new, r, before in rules])

    mended = cases([(like("t", "(?:at|bl|iz)$"), "t || 'e'"), (like("t", DOUBLE), cut("t", 1)), (f"{like('t', SHORT)} AND length(t) <= s.r1", "t || 'e'")], "t")
    steps = [
        cases([(ends(w, "sses"), cut(w, 2)), (f"{ends(w, 'ied')} OR {ends(w, 'ies')}", cases([("length(s.w) > 4", cut(w, 2))], cut(w, 1))),
               (f"{ends(w, 'us')} OR {ends(w, 'ss')}", w), (f"{ends(w, 's')} AND {like(w, VOWEL + '.+s$')}", cut(w, 1))]),
        cases([(ends(w, x), cases([(inside("r1", len(x)), cut(w, len(x) - 2))])) if x.startswith("ee") else
               (ends(w, x), cases([(like(cut(w, len(x)), VOWEL), bound(cut(w, len(x)), "t", mended))])) for x in ("eedly", "ingly", "edly", "eed", "ing", "ed")]),
        cases([(like(w, ".[^aeiouy][yY]$"), f"{cut(w, 1)} || 'i'")]),
        replaced([(x, new, "r1", before) for x, new, before in SECOND_STEP]),
        replaced([(x, new, r, "") for x, new, r in THIRD_STEP]),
        replaced([(x, "", "r2", before) for x, before in FOURTH_STEP]),
        cases([(f"{ends(w, 'e')} AND ({inside('r2', 1)} OR ({inside('r1', 1)} AND NOT {like(cut(w, 1), SHORT)}))", cut(w, 1)),
               (f"{ends(w, 'll')} AND {inside('r2', 1)}", cut(w, 1))])]
    region = lambda text, pattern: f"coalesce(nullif(length(regexp_extract({text}, '{pattern}')), 0), length({text}))"
    marked = f"regexp_replace(regexp_replace({word}, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g')"
    state = bound(marked, "m", bound(region("m", REGION), "r", f"{{'w': m, 'r1': r, 'r2': r + {region('substring(m, r + 1)', SECOND_REGION)}, 'over': false}}"))
    for number, step in enumerate(steps):
        over = f"s.over OR n IN ({quoted(FINAL)})" if number == 0 else "s.over"
        state = bound(state, "s", bound(f"CASE WHEN s.over THEN s.w ELSE {step} END", "n", f"{{'w': n, 'r1': s.r1, 'r2': s.r2, 'over': {over}}}"))
    special = "CASE {} {} END".format(word, " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPECIAL.items()))
    return f"coalesce({special}, CASE WHEN length({word}) <= 2 THEN {word} ELSE translate({state}.w, 'Y', 'y') END)"


def _words(source: str) -> str:
    return (f"SELECT text, unnest(string_split_regex(lower(text), '[^a-z0-9+/]+')) AS word FROM {source}")


def _inventory(words: str) -> str:
    return f"""
  SELECT root, string_agg(word, ',' ORDER BY word) AS words, arg_min(word, (length(word), word)) AS keyword,
         CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT word, {stem_sql('word')} AS root, count(*) AS n FROM {words} WHERE word <> '' GROUP BY word)
  GROUP BY root"""


STAGES["descriptions"] = 'SELECT DISTINCT "Description" AS text FROM train WHERE "Description" IS NOT NULL'
STAGES["words"] = _words("descriptions")
STAGES["inventory"] = _inventory("words")
STAGES["texts"] = "SELECT DISTINCT text FROM documents WHERE text IS NOT NULL"
STAGES["textwords"] = _words("texts")
STAGES["textinventory"] = _inventory("textwords")
STAGES["useful"] = (f"SELECT keyword, n FROM inventory WHERE keyword NOT IN ({quoted(COLOURS)}) "
                    "AND length(keyword) >= 3 AND n >= 13 AND NOT regexp_matches(keyword, '[+/]')")
STAGES["products"] = ('SELECT "Description", CAST(sum("UnitPrice") AS DOUBLE) / count(*) AS mean_price '
                      'FROM cleaned WHERE "Description" IS NOT NULL GROUP BY "Description"')
STAGES["hits"] = ('SELECT p."Description", k.keyword FROM products p '
                  'JOIN useful k ON contains(p."Description", upper(k.keyword))')
_BANDS = range_names(PRICE_BANDS, open_end=True)
STAGES["banded"] = ("SELECT *, CASE WHEN mean_price <= 1 THEN '0<.<1' "
                    + " ".join(f"WHEN mean_price <= {hi} THEN '{name}'" for name, hi in zip(_BANDS[1:], PRICE_BANDS[2:]))
                    + " ELSE '.>10' END AS band FROM products")
STAGES["assigned"] = 'SELECT "Description", CAST(length("Description") % 5 AS INTEGER) AS cluster FROM products'
_SPEND = ", ".join(f'CASE WHEN a.cluster = {i} THEN greatest(c."TotalPrice", 0) ELSE 0 END AS categ_{i}' for i in range(5))
STAGES["categorised"] = (f'SELECT c.*, a.cluster AS categ_product, {_SPEND} FROM cleaned c '
                         'LEFT JOIN assigned a ON c."Description" = a."Description"')
STAGES["catbaskets"] = ('SELECT "CustomerID", "InvoiceNo", sum("TotalPrice") AS basket_price, '
                        + ", ".join(f"sum(categ_{i}) AS categ_{i}" for i in range(5))
                        + ' FROM categorised GROUP BY "CustomerID", "InvoiceNo" HAVING sum("TotalPrice") > 0')
STAGES["stats"] = ('SELECT "CustomerID", CAST(min(basket_price) AS DOUBLE) AS "min", CAST(max(basket_price) AS DOUBLE) AS "max", '
                   'CAST(sum(basket_price) AS DOUBLE) / count(*) AS "mean", CAST(sum(basket_price) AS DOUBLE) AS "sum", '
                   + ", ".join(f"CAST(sum(categ_{i}) AS DOUBLE) * 100 / CAST(sum(basket_price) AS DOUBLE) AS categ_{i}" for i in range(5))
                   + ' FROM catbaskets GROUP BY "CustomerID"')
_KEPT = ["Recency", "Frequency", "MonetaryValue", "Lenght", "Proximidade_Marca_Score", "RFML_Score"]
_STATS = ["min", "max", "mean", "categ_0", "categ_1", "categ_2", "categ_3", "categ_4"]
FEATURES = _KEPT + _STATS
STAGES["features"] = ('SELECT s."CustomerID", s."RFML_Level", t."sum", '
                      + ", ".join(f'CAST(s."{c}" AS DOUBLE) AS "{c}"' for c in _KEPT) + ", "
                      + ", ".join(f't."{c}"' for c in _STATS)
                      + ', CAST(s."CustomerID" % 3 AS INTEGER) AS cluster '
                        'FROM scored s LEFT JOIN stats t ON s."CustomerID" = t."CustomerID"')
STAGES["points"] = "SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings"
STAGES["centers"] = "SELECT label, i, avg(CAST(v AS DOUBLE)) AS c FROM points GROUP BY label, i"
STAGES["placed"] = """
  SELECT vec_id, label, arg_min(center, (d, center)) AS prediction
  FROM (SELECT p.vec_id, p.label, c.label AS center, sum((p.v - c.c) * (p.v - c.c)) AS d
        FROM points p JOIN centers c ON p.i = c.i GROUP BY p.vec_id, p.label, c.label)
  GROUP BY vec_id, label"""
STAGES["confusion"] = "SELECT label, prediction, count(*) AS n FROM placed GROUP BY label, prediction"
STAGES["classes"] = """
  SELECT class, coalesce(hits / nullif(predicted, 0), 0) AS "precision", coalesce(hits / nullif(labelled, 0), 0) AS recall,
         labelled AS support, coalesce(2.0 * hits / nullif(predicted + labelled, 0), 0) AS f1
  FROM (SELECT class, sum(hits) AS hits, sum(labelled) AS labelled, sum(predicted) AS predicted
        FROM (SELECT label AS class, CASE WHEN label = prediction THEN n ELSE 0 END AS hits, n AS labelled, 0 AS predicted FROM confusion
              UNION ALL SELECT prediction, 0, 0, n FROM confusion) GROUP BY class)"""


def _needed(body: str) -> list[str]:
    """Stages a statement refers to, in order of definition."""
    import re

    wanted: set[str] = set()
    queue = [body]
    while queue:
        text = queue.pop()
        for name in STAGES:
            if name not in wanted and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                wanted.add(name)
                queue.append(STAGES[name])
    return [s for s in STAGES if s in wanted]


CASTS = {"i": 'CAST("{c}" AS BIGINT)', "s": '"{c}"', "d": 'round(CAST("{c}" AS DOUBLE), 6)',
         "t": "strftime(\"{c}\", '%Y-%m-%d %H:%M:%S.%f')", "b": '"{c}"'}


def out(columns: str, body: str) -> str:
    """``columns``: "name:type" pairs (i integer, d double, s string, t timestamp, b boolean)."""
    chosen = []
    for pair in columns.split():
        name, kind = pair.rsplit(":", 1)
        chosen.append(CASTS[kind].format(c=name) + f' AS "{name}"')
    stages = _needed(body)
    head = "WITH " + ",\n".join(f"{s} AS MATERIALIZED ({STAGES[s]})" for s in stages) + "\n" if stages else ""
    return f"{head}SELECT {', '.join(chosen)} FROM ({body}) AS result"


LINE_OUT = "InvoiceNo:s StockCode:s Description:s Quantity:i InvoiceDate:t UnitPrice:d CustomerID:i Country:s"
CLEANED_OUT = LINE_OUT + " QuantityCanceled:i TotalPrice:d"
METRIC_OUT = "CustomerID:i Recency:i Frequency:i MonetaryValue:d"
SCORED_OUT = (METRIC_OUT + " Lenght:i R:i F:i M:i L:i Proximidade_Marca_Score:i RFML_Segment_Concat:s "
              "RFML_Score:i RFML_Level:s Proximidade_Marca:s")
STATS_OUT = "CustomerID:i min:d max:d mean:d sum:d " + " ".join(f"categ_{i}:d" for i in range(5))


def _profile() -> str:
    types = {"InvoiceNo": "string", "StockCode": "string", "Description": "string", "Quantity": "int",
             "InvoiceDate": "timestamp_ntz", "UnitPrice": "decimal(12,4)", "CustomerID": "bigint", "Country": "string"}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS column_type, count(*) - count(\"{c}\") AS null_count, "
        f'(count(*) - count("{c}")) * 100.0 / count(*) AS null_pct FROM raw' for c, t in types.items())


def _constants() -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name FROM raw WHERE {test} HAVING count(DISTINCT \"{c}\") <= 1"
                              for c, test in [(c.strip().strip('"'), "true") for c in LINE.split(",")])


def _ranges() -> str:
    names = range_names(ORDER_RANGES, open_end=False)
    rows = " UNION ALL ".join(
        f"SELECT {i} AS position, '{n}' AS price_range, "
        f"(SELECT count(*) FROM baskets WHERE basket_price > {lo} AND basket_price < {hi}) AS n"
        for i, (n, lo, hi) in enumerate(zip(names, ORDER_RANGES, ORDER_RANGES[1:])))
    return f"SELECT *, n * 100.0 / sum(n) OVER () AS share_pct FROM ({rows})"


def _describe(columns: list[str], table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(x) AS \"count\", avg(x) AS \"mean\", stddev_samp(x) AS std, min(x) AS \"min\", "
        f'quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, max(x) AS "max" '
        f'FROM (SELECT CAST("{c}" AS DOUBLE) AS x FROM {table})' for c in columns)


def _boxes(table: str, value: str, group: str) -> str:
    x = f'CAST("{value}" AS DOUBLE)'
    return f"""
  SELECT t.box, q1, median, q3, count(*) AS n,
         min(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
         max(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high
  FROM (SELECT "{group}" AS box, {x} AS x FROM {table} WHERE "{value}" IS NOT NULL) t
  JOIN (SELECT "{group}" AS box, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS median,
               quantile_cont({x}, 0.75) AS q3 FROM {table} GROUP BY 1) e ON t.box IS NOT DISTINCT FROM e.box
  GROUP BY t.box, q1, median, q3"""


def _histogram(column: str) -> str:
    """Fifty bins, those without rows with 0."""
    return (f'SELECT b.bin, coalesce(n, 0) AS n FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(50)) b LEFT JOIN ('
            f'SELECT least(CAST(floor((CAST("{column}" AS DOUBLE) - lo) / ((hi - lo) / 50)) AS INTEGER), 49) AS bin, count(*) AS n FROM metrics, '
            f'(SELECT CAST(min("{column}") AS DOUBLE) AS lo, CAST(max("{column}") AS DOUBLE) AS hi FROM metrics) GROUP BY 1) h ON b.bin = h.bin')


def _density() -> str:
    """Gaussian kernels about 256 grid points, on values binned linearly."""
    return """
  SELECT g.range AS point, first_x + g.range * step AS x,
         coalesce((SELECT sum(w * exp(-0.5 * pow((spot - g.range) * step / h, 2))) FROM b WHERE abs(spot - g.range) <= ceil(6 * h / step)), 0) / (n * h * sqrt(2 * pi())) AS density
  FROM range(256) g, s"""


def _density_stages(column: str) -> str:
    return f"""
  v AS (SELECT CAST("{column}" AS DOUBLE) AS x FROM metrics WHERE "{column}" IS NOT NULL),
  t AS (SELECT count(*) AS n, min(x) AS low, max(x) AS high, stddev_samp(x) * pow(count(*), -0.2) AS h FROM v),
  s AS MATERIALIZED (SELECT n, h, low - 3 * h AS first_x, (high - low + 6 * h) / 255 AS step FROM t),
  p AS (SELECT (x - first_x) / step AS place FROM v, s),
  c AS (SELECT CAST(least(floor(place), 254) AS INTEGER) AS spot, place FROM p),
  b AS MATERIALIZED (SELECT spot, sum(w) AS w FROM (SELECT spot, 1 - (place - spot) AS w FROM c UNION ALL SELECT spot + 1, place - spot FROM c) GROUP BY spot)"""


def _with(stages: str, statement: str) -> str:
    """A statement with more stages after its own."""
    head, _, tail = statement.rpartition("\nSELECT ")
    return f"{head},{stages}\nSELECT {tail}"


SCORED_NUMBERS = ["Recency", "Frequency", "MonetaryValue", "Lenght", "R", "F", "M", "L", "Proximidade_Marca_Score", "RFML_Score"]


def _counterpart(skip: str, by: str) -> str:
    return (f'SELECT r.* FROM train r WHERE r."Quantity" < 0 {skip} AND NOT EXISTS (SELECT 1 FROM train o '
            f'WHERE o."CustomerID" = r."CustomerID" AND o."Quantity" = -r."Quantity" AND o."{by}" = r."{by}")')


_NOT_DISCOUNT = """AND r."Description" IS DISTINCT FROM 'Discount'"""
_COUNTS = "n:i"

EUCLIDEAN = """
      SELECT vec_id, label, CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette
      FROM (SELECT vec_id, label, max(size) FILTER (WHERE other = label) AS size,
                   max(total / nullif(size - 1, 0)) FILTER (WHERE other = label) AS a, min(total / size) FILTER (WHERE other <> label) AS b
            FROM (SELECT x.vec_id, x.label, y.label AS other, count(*) AS size,
                         sum(sqrt(list_sum(list_transform(list_zip(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) AS total
                  FROM embeddings x CROSS JOIN embeddings y GROUP BY x.vec_id, x.label, y.label)
            GROUP BY vec_id, label)"""
STANDARDISED = "SELECT * FROM (" + " UNION ALL ".join(f'SELECT "CustomerID", {i} AS position, ("{c}" - avg("{c}") OVER ()) / stddev_pop("{c}") OVER () AS value FROM features WHERE "Lenght" IS NOT NULL' for i, c in enumerate(FEATURES)) + ") WHERE value <> 0"



def _first_split(impurity: str) -> str:
    """Every gap between neighbouring values, from running counts of each class; ``impurity`` is SQL over the counts of a side, in ``of``."""
    return f"""
      SELECT feature, arg_min(threshold, struct_pack(i := impurity, t := threshold)) AS threshold, round(min(impurity), 8) AS impurity,
             arg_min(n_left, struct_pack(i := impurity, t := threshold)) AS n_left, any_value(n) AS n
      FROM (SELECT feature, value / 2 + above / 2 AS threshold, sum(below) AS n_left, sum(below) + sum(beyond) AS n,
                   round(({impurity.format(of="below")} + {impurity.format(of="beyond")}) / (sum(below) + sum(beyond)), 12) AS impurity
            FROM (SELECT v.feature, v.value, v.above, c.label, CAST(coalesce(max(r.so_far), 0) AS DOUBLE) AS below,
                         CAST(max(c.n) - coalesce(max(r.so_far), 0) AS DOUBLE) AS beyond
                  FROM (SELECT feature, value, lead(value) OVER (PARTITION BY feature ORDER BY value) AS above FROM (SELECT DISTINCT feature, value FROM cells)) v
                  JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) c ON v.above IS NOT NULL
                  LEFT JOIN (SELECT DISTINCT feature, label, value, count(*) OVER (PARTITION BY feature, label ORDER BY value) AS so_far FROM cells) r
                    ON r.feature = v.feature AND r.label = c.label AND r.value <= v.value
                  GROUP BY v.feature, v.value, v.above, c.label)
            GROUP BY feature, value, above)
      GROUP BY feature"""


STAGES["cells"] = """
  SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS value, generate_subscripts(embedding, 1) - 1 AS feature FROM embeddings
"""
FIRST_SPLIT = "feature:i threshold:d impurity:d n_left:i n:i"

STATEMENTS: dict[str, str] = {
    # exact thresholds of trees
    "best_splits_gini": out(FIRST_SPLIT, _first_split("(sum({of}) - sum({of} * {of}) / sum({of}))")),
    "best_splits_entropy": out(FIRST_SPLIT, _first_split("sum(CASE WHEN {of} > 0 THEN -{of} * log2({of}) ELSE 0 END) + sum({of}) * log2(sum({of}))")),
    "exact_tree_facts": out("impurity:s n:i right:i", """SELECT impurity, n, n AS "right" FROM (VALUES ('gini'), ('entropy')) v(impurity),
      (SELECT count(*) AS n FROM features WHERE "Lenght" IS NOT NULL)"""),
    # sources and inspection
    "invoice_lines": out(LINE_OUT, "SELECT * FROM raw"),
    "table_size": out("n_rows:i n_columns:i", "SELECT count(*) AS n_rows, 8 AS n_columns FROM raw"),
    "preview_by_customer": out(LINE_OUT, f'SELECT * FROM train ORDER BY "CustomerID", {ORDER} LIMIT 5'),
    "column_profile": out("column_name:s column_type:s null_count:i null_pct:d", _profile()),
    "constant_columns": out("column_name:s", _constants()),
    # cleaning
    "lines_with_customer": out(LINE_OUT, "SELECT * FROM known"),
    "duplicate_count": out("duplicates:i", "SELECT (SELECT count(*) FROM known) - (SELECT count(*) FROM clean) AS duplicates"),
    "duplicate_lines": out(LINE_OUT + " copy_no:i", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {LINE}) AS copy_no FROM known) WHERE copy_no > 1"),
    "deduplicated_lines": out(LINE_OUT, "SELECT * FROM clean"),
    "no_duplicates_left": out("duplicates:i", f"SELECT coalesce(sum(n - 1), 0) AS duplicates FROM (SELECT count(*) AS n FROM clean GROUP BY {LINE})"),
    "negative_prices": out(LINE_OUT, 'SELECT * FROM known WHERE "UnitPrice" < 0'),
    "training_lines": out(LINE_OUT, "SELECT * FROM train"),
    "later_lines": out(LINE_OUT, "SELECT * FROM later"),
    "date_ranges": out("part:s first_date:t last_date:t", 'SELECT \'train\' AS part, min("InvoiceDate") AS first_date, max("InvoiceDate") AS last_date FROM train UNION ALL SELECT \'later\', min("InvoiceDate"), max("InvoiceDate") FROM later'),
    "column_selection": out("CustomerID:i Quantity:i StockCode:s Description:s UnitPrice:d", 'SELECT "CustomerID", "Quantity", "StockCode", "Description", "UnitPrice" FROM train WHERE "Quantity" < 0'),
    "customer_lookup": out(LINE_OUT, 'SELECT * FROM train WHERE "CustomerID" = 7'),
    "renamed_columns": out("customer:i invoice:s products:i", 'SELECT "CustomerID" AS customer, "InvoiceNo" AS invoice, count("InvoiceDate") AS products FROM train GROUP BY ALL'),
    "orders_per_country": out("Country:s orders:i", 'SELECT "Country", count(*) AS orders FROM (SELECT DISTINCT "CustomerID", "InvoiceNo", "Country" FROM train) GROUP BY "Country"'),
    "distinct_totals": out("products:i transactions:i customers:i", 'SELECT count(DISTINCT "StockCode") AS products, count(DISTINCT "InvoiceNo") AS transactions, count(DISTINCT "CustomerID") AS customers FROM train'),
    "special_stock_codes": out("StockCode:s Description:s", f'SELECT "StockCode", arg_min("Description", rid) AS "Description" FROM cleaned WHERE regexp_matches("StockCode", \'^[a-zA-Z]+\') GROUP BY "StockCode"'),
    "distinct_descriptions": out("Description:s", 'SELECT DISTINCT "Description" FROM cleaned'),
    # cancellations
    "lines_per_basket": out("CustomerID:i InvoiceNo:s n_products:i order_canceled:i", 'SELECT "CustomerID", "InvoiceNo", count("InvoiceDate") AS n_products, CAST(contains("InvoiceNo", \'C\') AS INTEGER) AS order_canceled FROM train GROUP BY "CustomerID", "InvoiceNo"'),
    "cancelled_order_rate": out("canceled:i orders:i rate_pct:d", 'SELECT sum(c) AS canceled, count(*) AS orders, sum(c) * 100.0 / count(*) AS rate_pct FROM (SELECT CAST(contains("InvoiceNo", \'C\') AS INTEGER) AS c FROM train GROUP BY "CustomerID", "InvoiceNo")'),
    "returns_without_counterpart": out(LINE_OUT, _counterpart("", "Description")),
    "returns_without_counterpart_no_discount": out(LINE_OUT, _counterpart(_NOT_DISCOUNT, "Description")),
    "returns_without_counterpart_by_stock_code": out(LINE_OUT, _counterpart("", "StockCode")),
    "first_return_without_counterpart": out(LINE_OUT, _counterpart("", "Description") + f" ORDER BY {ORDER} LIMIT 1"),
    "cancel_matches": out(LINE_OUT + " status:s n_candidates:i order_invoice:s order_quantity:i order_date:t", 'SELECT s.*, coalesce(p.n, 0) AS n_candidates, o."InvoiceNo" AS order_invoice, o."Quantity" AS order_quantity, o."InvoiceDate" AS order_date FROM status s LEFT JOIN (SELECT crid, max(n) AS n FROM pairs GROUP BY crid) p ON s.rid = p.crid LEFT JOIN chosen h ON s.rid = h.crid LEFT JOIN numbered o ON h.orid = o.rid'),
    "cancel_census": out("status:s n:i", "SELECT status, count(*) AS n FROM status GROUP BY status"),
    "doubtful_cancels": out(LINE_OUT, "SELECT * FROM status WHERE status = 'doubtful'"),
    "matched_cancels": out(LINE_OUT, "SELECT * FROM status WHERE status = 'matched'"),
    "netted_lines": out(CLEANED_OUT, "SELECT * FROM cleaned"),
    "remaining_returns": out(CLEANED_OUT, "SELECT * FROM cleaned WHERE \"Quantity\" < 0 AND \"StockCode\" <> 'D'"),
    # baskets
    "baskets": out("CustomerID:i InvoiceNo:s basket_price:d InvoiceDate:t", "SELECT * FROM baskets"),
    "order_value_ranges": out("position:i price_range:s n:i share_pct:d", _ranges()),
    # metrics
    "customer_metrics": out(METRIC_OUT + " Lenght:i LastPurchase:i FirstPurchase:i", "SELECT * FROM metrics"),
    "recency_frequency_monetary": out(METRIC_OUT, "SELECT * FROM metrics"),
    "relationship_length": out("CustomerID:i basket_price:d Lenght:i LastPurchase:i FirstPurchase:i", 'SELECT *, "MonetaryValue" AS basket_price FROM metrics'),
    "snapshot_date": out("snapshot_date:t last_date:s", "SELECT max(\"InvoiceDate\") + INTERVAL 1 DAY AS snapshot_date, CAST(CAST(max(\"InvoiceDate\") AS DATE) AS VARCHAR) AS last_date FROM baskets"),
    "customer_reconciliation": out("CustomerID:i invoices:i last_date:t spend:d span_days:i", f'SELECT "CustomerID", count(DISTINCT "InvoiceNo") AS invoices, max("InvoiceDate") AS last_date, sum(basket_price) AS spend, (epoch_us(max("InvoiceDate")) - epoch_us(min("InvoiceDate"))) // {DAY} AS span_days FROM baskets GROUP BY "CustomerID"'),
    "line_reconciliation": out("CustomerID:i invoices:i n_lines:i spend:d first_line:t last_line:t " + " ".join(f"share_{i}:d" for i in range(5)), f"""
      SELECT "CustomerID", count(DISTINCT "InvoiceNo") AS invoices, count(*) AS n_lines, sum("TotalPrice") AS spend, min("InvoiceDate") AS first_line,
             max("InvoiceDate") AS last_line, {", ".join(f'CAST(sum(categ_{i}) AS DOUBLE) * 100 / CAST(sum("TotalPrice") AS DOUBLE) AS share_{i}' for i in range(5))}
      FROM (SELECT *, sum("TotalPrice") OVER (PARTITION BY "CustomerID", "InvoiceNo") AS total FROM categorised) WHERE total > 0 GROUP BY "CustomerID\""""),
    # outliers and distributions
    "rfm_without_outliers": out(METRIC_OUT, f"SELECT * FROM {RFM_KEPT}"),
    "length_without_outliers": out("CustomerID:i basket_price:d Lenght:i LastPurchase:i FirstPurchase:i", f'SELECT *, "MonetaryValue" AS basket_price FROM {LENGTH_KEPT}'),
    "metric_description": out("column_name:s count:i mean:d std:d min:d q1:d q2:d q3:d max:d", _describe(["Recency", "Frequency", "MonetaryValue"], "metrics")),
    "monetary_box": out("box:s n:i q1:d median:d q3:d whisker_low:d whisker_high:d", _boxes("(SELECT *, 'all' AS everyone FROM metrics)", "MonetaryValue", "everyone")),
    "recency_box_by_score": out("box:i n:i q1:d median:d q3:d whisker_low:d whisker_high:d", _boxes("scored", "Recency", "R")),
    "monetary_box_by_level": out("box:s n:i q1:d median:d q3:d whisker_low:d whisker_high:d", _boxes("scored", "MonetaryValue", "RFML_Level")),
    "monetary_histogram": out("bin:i n:i", _histogram("MonetaryValue")),
    "recency_histogram": out("bin:i n:i", _histogram("Recency")),
    "frequency_histogram": out("bin:i n:i", _histogram("Frequency")),
    "length_histogram": out("bin:i n:i", _histogram("Lenght")),
    "scored_description": out("column_name:s count:i mean:d std:d min:d q1:d q2:d q3:d max:d", _describe(SCORED_NUMBERS, "scored")),
    "monetary_box_by_level_and_closeness": out("box:s n:i q1:d median:d q3:d whisker_low:d whisker_high:d", _boxes("(SELECT *, \"RFML_Level\" || '|' || \"Proximidade_Marca\" AS both_names FROM scored)", "MonetaryValue", "both_names")),
    "invoice_lines_csv": out(LINE_OUT, "SELECT * FROM raw"),
    "cluster_profile_report": out("cluster:i sum:d size:i " + " ".join(f"{c}:d" for c in FEATURES), 'SELECT cluster, round_even(avg("sum"), 1) AS "sum", count(*) AS size, ' + ", ".join(f'round_even(avg("{c}"), 1) AS "{c}"' for c in FEATURES) + " FROM features GROUP BY cluster"),
    "row_euclidean_silhouettes": out("vec_id:i label:i silhouette:d", f"SELECT * FROM ({EUCLIDEAN})"),
    "embedding_silhouette": out("mean:d error:d sampled:i rows:i", f"SELECT avg(silhouette) AS mean, 0.0 AS error, count(*) AS sampled, count(*) AS rows FROM ({EUCLIDEAN})"),
    "ward_total": out("n:i total:d", f"SELECT count(DISTINCT \"CustomerID\") AS n, round(sum(value * value), 4) AS total FROM ({STANDARDISED})"),
    "cluster_cost_split": out("k:i n:i total:d", f"SELECT k, n, total FROM range(2, 10) r(k), (SELECT count(DISTINCT \"CustomerID\") AS n, round(sum(value * value), 4) AS total FROM ({STANDARDISED}))"),
    "period_totals_from_sketches": out("n_lines:i exact_transactions:i exact_products:i exact_customers:i transactions_near:b products_near:b customers_near:b", """
      SELECT count(*) AS n_lines, count(DISTINCT "InvoiceNo") AS exact_transactions, count(DISTINCT "StockCode") AS exact_products, count(DISTINCT "CustomerID") AS exact_customers,
             true AS transactions_near, true AS products_near, true AS customers_near FROM known WHERE "InvoiceDate" BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31 23:59:59'"""),
    # what must hold for any fit
    "hierarchical_counts": out("k:i clusters:i n:i", 'SELECT k, k AS clusters, (SELECT count(*) FROM features WHERE "Lenght" IS NOT NULL) AS n FROM (VALUES (2), (3), (5), (8)) v(k)'),
    "customer_cluster_facts": out("n:i clusters:i customers:i", 'SELECT count(*) AS n, 3 AS clusters, count(DISTINCT "CustomerID") AS customers FROM features WHERE "Lenght" IS NOT NULL'),
    "random_split_facts": out("n:i customers:i near_share:b", "SELECT count(*) AS n, count(*) AS customers, true AS near_share FROM metrics"),
    "component_facts": out("components:i total:d any_rise:b", f"SELECT {len(FEATURES)} AS components, 1.0 AS total, false AS any_rise"),
    "projection_facts": out("customers:i dimensions:i", 'SELECT count(DISTINCT "CustomerID") AS customers, 2 AS dimensions FROM features WHERE "Lenght" IS NOT NULL'),
    "sweep_facts": out("k:i cheaper:b", "SELECT k, true AS cheaper FROM range(1, 10) r(k)"),
    "classifier_facts": out("model:s all_labelled:b known_labels:b useful:b", "SELECT model, true AS all_labelled, true AS known_labels, true AS useful FROM (VALUES ('decision_tree'), ('random_forest'), ('adaboost'), ('svm'), ('svm_pairwise'), ('decision_tree_gini')) v(model)"),
    "product_cluster_facts": out("products:i clusters:i", 'SELECT count(DISTINCT "Description") AS products, 5 AS clusters FROM banded'),
    "customer_silhouette_facts": out("n:i same_mean:b", 'SELECT count(*) AS n, true AS same_mean FROM features WHERE "Lenght" IS NOT NULL'),
    "later_period_facts": out("once:b some:b named:b", "SELECT true AS once, true AS some, true AS named"),
    "frequent_customers_below_30": out(SCORED_OUT, 'SELECT * FROM scored WHERE "Frequency" < 30'),
    # scores
    "rfm_with_length": out(METRIC_OUT + " Lenght:i", "SELECT * FROM combined"),
    "quartile_by_value": out("CustomerID:i Recency:i R:i MonetaryValue:d M:i", "SELECT * FROM quartiles"),
    "quartile_by_rank": out("CustomerID:i Frequency:i F:i Lenght:i L:i", "SELECT * FROM quartiles"),
    "scored_customers": out(SCORED_OUT, "SELECT * FROM scored"),
    "score_counts": out("score:s value:i n:i", " UNION ALL ".join(f"SELECT '{c}' AS score, \"{c}\" AS value, count(*) AS n FROM scored GROUP BY \"{c}\"" for c in "RFML")),
    "segment_count": out("segments:i", 'SELECT count(DISTINCT "RFML_Segment_Concat") AS segments FROM scored'),
    "level_profile": out("RFML_Level:s RecencyMean:d FrequencyMean:d LenghtMean:d MonetaryMean:d Count:i", 'SELECT "RFML_Level", round_even(avg("Recency"), 1) AS "RecencyMean", round_even(avg("Frequency"), 1) AS "FrequencyMean", round_even(avg("Lenght"), 1) AS "LenghtMean", round_even(avg(CAST("MonetaryValue" AS DOUBLE)), 1) AS "MonetaryMean", count(*) AS "Count" FROM scored GROUP BY "RFML_Level"'),
    "level_by_closeness": out("RFML_Level:s leal:i fidelizacao:i regular:i novos:i", 'SELECT "RFML_Level", ' + ", ".join(f"count(*) FILTER (WHERE \"Proximidade_Marca\" = {quoted([v])}) AS {n}" for n, v in zip(("leal", "fidelizacao", "regular", "novos"), [v for _, v in CLOSENESS] + [LOWEST_CLOSENESS])) + ' FROM scored GROUP BY "RFML_Level"'),
    "level_frequencies": out("RFML_Level:s n:i share:d", 'SELECT "RFML_Level", count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM scored GROUP BY "RFML_Level"'),
    "customer_key_check": out("repeats:i", 'SELECT count(*) - count(DISTINCT "CustomerID") AS repeats FROM metrics'),
    # text and products
    "description_words": out("text:s word:s n:i", "SELECT text, word, count(*) AS n FROM words WHERE word <> '' GROUP BY text, word"),
    "words_without_stop_words": out("word:s n:i", "SELECT word, count(*) AS n FROM words WHERE word <> '' AND word NOT IN (SELECT lower(p_type) FROM part) GROUP BY word"),
    "keyword_inventory": out("root:s words:s keyword:s n:i", "SELECT * FROM inventory"),
    "document_keyword_inventory": out("root:s words:s keyword:s n:i", "SELECT * FROM textinventory"),
    "top_keywords": out("keyword:s n:i", "SELECT keyword, n FROM inventory ORDER BY n DESC, keyword LIMIT 125"),
    "useful_keywords": out("keyword:s n:i", "SELECT * FROM useful"),
    "product_keyword_hits": out("Description:s keyword:s", "SELECT * FROM hits"),
    "mean_product_prices": out("Description:s mean_price:d", "SELECT * FROM products"),
    "price_band_columns": out("Description:s " + " ".join(f"{b}:i" for b in _BANDS), 'SELECT "Description", ' + ", ".join(f"CAST(band = '{b}' AS INTEGER) AS \"{b}\"" for b in _BANDS) + " FROM banded"),
    "price_band_counts": out("band:s products:i", " UNION ALL ".join(f"SELECT '{b}' AS band, count(*) FILTER (WHERE band = '{b}') AS products FROM banded" for b in _BANDS)),
    "cluster_keywords": out("cluster:i keyword:s n:i position:i", f"SELECT * FROM (SELECT cluster, keyword, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, keyword) AS position FROM hits h JOIN assigned a ON h.\"Description\" = a.\"Description\" WHERE keyword NOT IN ({quoted(CLOUD_STOP)}) GROUP BY cluster, keyword) WHERE position <= 150"),
    "category_spend_per_line": out("InvoiceNo:s Description:s categ_product:i " + " ".join(f"categ_{i}:d" for i in range(5)), "SELECT * FROM categorised"),
    "category_baskets": out("CustomerID:i InvoiceNo:s basket_price:d " + " ".join(f"categ_{i}:d" for i in range(5)), "SELECT * FROM catbaskets"),
    "basket_statistics": out(STATS_OUT, "SELECT * FROM stats"),
    # features and clusters
    "customer_features": out("CustomerID:i RFML_Level:s " + " ".join(f"{c}:d" for c in FEATURES), "SELECT * FROM features"),
    "feature_scaling": out("feature:s mean:d std:d", " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(\"{c}\") AS mean, stddev_pop(\"{c}\") AS std FROM features WHERE \"Lenght\" IS NOT NULL" for c in FEATURES)),
    "cluster_profile": out("cluster:i sum:d size:i " + " ".join(f"{c}:d" for c in FEATURES), 'SELECT cluster, avg("sum") AS "sum", count(*) AS size, ' + ", ".join(f'avg("{c}") AS "{c}"' for c in FEATURES) + " FROM features GROUP BY cluster"),
    "cluster_drill_down": out("RFML_Score:d categ_1:d", 'SELECT avg("RFML_Score") AS "RFML_Score", avg(categ_1) AS categ_1 FROM features WHERE cluster = 2'),
    "segment_names": out("segment:s n:i share:d", "SELECT segment, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM features f JOIN (SELECT cluster, ['bronze', 'silver', 'gold'][row_number() OVER (ORDER BY avg(\"sum\"), cluster)] AS segment FROM features GROUP BY cluster) s ON f.cluster = s.cluster GROUP BY segment"),
    "single_cluster_cost": out("k:i wcss:d", "SELECT 1 AS k, sum((v - c) * (v - c)) AS wcss FROM points p JOIN (SELECT i, avg(CAST(v AS DOUBLE)) AS c FROM points GROUP BY i) m ON p.i = m.i"),
    "nearest_center": out("vec_id:i label:i prediction:i", "SELECT * FROM placed"),
    "row_silhouettes": out("vec_id:i label:i silhouette:d", """
      SELECT vec_id, label, CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette
      FROM (SELECT vec_id, label, max(size) FILTER (WHERE other = label) AS size,
                   max(total / nullif(size - 1, 0)) FILTER (WHERE other = label) AS a, min(total / size) FILTER (WHERE other <> label) AS b
            FROM (SELECT x.vec_id, x.label, y.label AS other, count(*) AS size,
                         sum(list_sum(list_transform(list_zip(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS total
                  FROM embeddings x CROSS JOIN embeddings y GROUP BY x.vec_id, x.label, y.label)
            GROUP BY vec_id, label)"""),
    "feature_vectors": out("CustomerID:i position:i value:d", "SELECT * FROM (" + " UNION ALL ".join(f'SELECT "CustomerID", {i} AS position, "{c}" AS value FROM features WHERE "Lenght" IS NOT NULL' for i, c in enumerate(FEATURES)) + ") WHERE value <> 0"),
    "standardised_features": out("CustomerID:i position:i value:d", "SELECT * FROM (" + " UNION ALL ".join(f'SELECT "CustomerID", {i} AS position, ("{c}" - avg("{c}") OVER ()) / stddev_pop("{c}") OVER () AS value FROM features WHERE "Lenght" IS NOT NULL' for i, c in enumerate(FEATURES)) + ") WHERE value <> 0"),
    "product_vectors": out("Description:s position:i value:d", f"""
      SELECT h."Description", k.position, 1.0 AS value FROM hits h
      JOIN (SELECT keyword, row_number() OVER (ORDER BY n DESC, keyword) - 1 AS position FROM useful) k ON h.keyword = k.keyword
      UNION ALL SELECT "Description", (SELECT count(*) FROM useful) + list_position([{quoted(_BANDS)}], band) - 1, 1.0 FROM banded"""),
    "balanced_classes": out("label:i synthetic:b n:i", """
      SELECT label, false AS synthetic, count(*) AS n FROM embeddings GROUP BY label
      UNION ALL SELECT label, true, most - n FROM (SELECT label, count(*) AS n, max(count(*)) OVER () AS most FROM embeddings GROUP BY label) WHERE most > n"""),
    # evaluation
    "confusion_table": out("label:i prediction:i n:i", "SELECT * FROM confusion"),
    "confusion_with_totals": out("prediction:s label:s n:i", "SELECT CASE WHEN grouping(prediction) = 1 THEN 'All' ELSE CAST(prediction AS VARCHAR) END AS prediction, CASE WHEN grouping(label) = 1 THEN 'All' ELSE CAST(label AS VARCHAR) END AS label, count(*) AS n FROM placed GROUP BY CUBE (prediction, label)"),
    "class_report": out("class:i precision:d recall:d f1:d support:i", "SELECT * FROM classes"),
    "classifier_scores": out("accuracy:d weighted_precision:d weighted_recall:d macro_f1:d macro_precision:d macro_recall:d", 'SELECT sum(recall * support) / sum(support) AS accuracy, sum("precision" * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall, avg(f1) AS macro_f1, avg("precision") AS macro_precision, avg(recall) AS macro_recall FROM classes'),
    "accuracy": out("accuracy:d", "SELECT avg(CAST(label = prediction AS INTEGER)) AS accuracy FROM placed"),
    "class_balance": out("quality:i n:i", "SELECT quality, count(*) AS n FROM labels GROUP BY quality"),
}

# the later window: the same statements over the other side of the cutoff
LATER = ["lines_per_basket", "cancelled_order_rate", "netted_lines", "baskets", "order_value_ranges", "customer_metrics",
         "rfm_without_outliers", "length_without_outliers", "metric_description", "mean_product_prices", "price_band_counts",
         "keyword_inventory", "customer_reconciliation", "line_reconciliation"]
STATEMENTS |= {f"later_{name}": STATEMENTS[name].replace(f'"InvoiceDate" < {CUTOFF}', f'"InvoiceDate" >= {CUTOFF}') for name in LATER}
STATEMENTS |= {f"{name}_density": _with(_density_stages(column), out("point:i x:d density:d", _density() + ", (SELECT 1 FROM metrics LIMIT 1) AS needed"))
               for name, column in (("recency", "Recency"), ("frequency", "Frequency"), ("monetary", "MonetaryValue"), ("length", "Lenght"))}
