"""Table discovery on messy sheets made from the customers, one sheet per nation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.similarity import COLUMN_SYNONYMS, match_synonyms
from gridloom.operators import discovery as D
from gridloom.operators import similar
from gridloom.operators.ordered import running_number
from gridloom.plans.registry import query

_FOOT = "Source: exported from the sales system, figures are preliminary"
_REMARK = "Asked to be called back after the next delivery, see letter"


def _sheet():
    return F.concat(F.lit("S"), F.col("c_nationkey").cast("string"))


def messy_sheets(load) -> DataFrame:
    """Title, blank line, header, data, repeated header, total, blank line and footnote."""
    return load.shared("messy_sheets", lambda: _messy(load))


def _messy(load) -> DataFrame:
    customers = load("customer").select("c_custkey", "c_nationkey", "c_name", "c_acctbal", "c_mktsegment")
    numbered = running_number(customers, ["c_nationkey"], [F.col("c_custkey")], "n")
    money = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    remark = F.when(F.col("c_custkey") % 40 == 0, _REMARK).otherwise("")
    data = numbered.select(
        _sheet().alias("sheet"), (F.col("n") + 3).alias("row_idx"),
        F.array("c_name", money, "c_mktsegment", F.lit(" "), remark).alias("cells"),
    )
    even = F.col("c_nationkey") % 2 == 0
    header = F.when(even, F.array(*map(F.lit, ("Clientes", "Saldo", "Categoria", "", "Notes")))).otherwise(
        F.array(*map(F.lit, ("Cliente ", "Balance", "Type", "", "Notes")))
    )
    per_sheet = customers.groupBy("c_nationkey").agg(
        F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(12,2)")).cast("string").alias("total")
    )
    row = lambda at, *cells: F.struct(at.cast("bigint").alias("row_idx"), F.array(*cells).alias("cells"))
    e, n = F.lit(""), F.col("n")
    frame = per_sheet.select(
        _sheet().alias("sheet"),
        F.explode(F.array(
            row(F.lit(1), F.concat(F.lit("Customers of nation "), "c_nationkey"), e, e, e, e),
            row(F.lit(2), e, e, e, e, e),
            F.struct(F.lit(3).cast("bigint").alias("row_idx"), header.alias("cells")),
            F.struct((n + 4).alias("row_idx"), header.alias("cells")),
            row(n + 5, F.lit("Total"), F.col("total"), e, e, e),
            row(n + 6, e, e, e, e, e),
            row(n + 7, F.lit(_FOOT), e, e, e, e),
        )).alias("r"),
    ).select("sheet", "r.*")
    return data.unionByName(frame)


_SHEETS_SQL = f"""
  d AS (SELECT 'S' || c_nationkey AS sheet, c_nationkey % 2 = 0 AS even, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 3 AS row_idx,
      c_custkey, c_name, c_acctbal, c_mktsegment FROM customer),
  s AS (SELECT 'S' || c_nationkey AS sheet, c_nationkey % 2 = 0 AS even, count(*) AS n FROM customer GROUP BY c_nationkey),
  kinds AS (SELECT sheet, row_idx, 'data' AS kind FROM d UNION ALL
      SELECT sheet, CASE WHEN pos < 4 THEN pos ELSE n + pos END, kind FROM s, (VALUES (1, 'title'), (2, 'blank'), (3, 'header'), (4, 'repeated_header'),
        (5, 'total'), (6, 'blank'), (7, 'footnote')) k(pos, kind))
"""


@query("classify_rows", f"WITH {_SHEETS_SQL} SELECT * FROM kinds")
def _(load):
    return D.classify_rows(messy_sheets(load)).select("sheet", "row_idx", "kind")


@query(
    "detect_header",
    f"""WITH {_SHEETS_SQL} SELECT sheet, 3 AS header_row, CASE WHEN even THEN 'Clientes|Saldo|Categoria||Notes' ELSE 'Cliente |Balance|Type||Notes' END AS header FROM s""",
)
def _(load):
    return D.detect_header(messy_sheets(load)).select("sheet", "header_row", F.array_join("header_cells", "|").alias("header"))


@query("detect_bounds", f"WITH {_SHEETS_SQL} SELECT sheet, 4 AS data_start, n + 3 AS data_end FROM s")
def _(load):
    return D.detect_bounds(D.classify_rows(messy_sheets(load)))


@query(
    "detect_noise_columns",
    f"""WITH {_SHEETS_SQL}, r AS (SELECT sheet, count(*) FILTER (c_custkey % 40 = 0) AS k, count(*) AS n FROM d GROUP BY 1)
        SELECT sheet, 4 AS col FROM s UNION ALL SELECT sheet, 5 FROM r WHERE k <= n * 0.2""",
)
def _(load):
    return D.detect_noise_columns(D.classify_rows(messy_sheets(load)))


@query("extract_range", f"WITH {_SHEETS_SQL} SELECT sheet, row_idx, c_name AS first_cell FROM d")
def _(load):
    kinds = D.classify_rows(messy_sheets(load))
    rows = D.extract_range(messy_sheets(load), D.detect_bounds(kinds), kinds.filter("kind <> 'data'"))
    return rows.select("sheet", "row_idx", F.col("cells")[0].alias("first_cell"))


@query("drop_blank_rows", f"WITH {_SHEETS_SQL} SELECT sheet, row_idx FROM kinds WHERE kind <> 'blank'")
def _(load):
    return D.drop_blank_rows(messy_sheets(load)).select("sheet", "row_idx")


@query(
    "drop_noise_columns",
    f"""WITH {_SHEETS_SQL}, r AS (SELECT sheet, count(*) FILTER (c_custkey % 40 = 0) <= count(*) * 0.2 AS noisy FROM d GROUP BY 1)
        SELECT sheet, row_idx, CASE WHEN noisy THEN 3 ELSE 4 END AS kept FROM kinds JOIN r USING (sheet)""",
)
def _(load):
    noise = D.detect_noise_columns(D.classify_rows(messy_sheets(load)))
    return D.drop_noise_columns(messy_sheets(load), noise).select("sheet", "row_idx", F.size("cells").alias("kept"))


@query(
    "promote_header",
    f"""WITH {_SHEETS_SQL} SELECT sheet, col, CASE WHEN even THEN a ELSE b END AS raw FROM s,
        (VALUES (1, 'Clientes', 'Cliente '), (2, 'Saldo', 'Balance'), (3, 'Categoria', 'Type'), (4, '', ''), (5, 'Notes', 'Notes')) h(col, a, b)""",
)
def _(load):
    return D.header_columns(D.detect_header(messy_sheets(load)))


@query(
    "extract_table",
    f"""WITH {_SHEETS_SQL} SELECT sheet AS _source_sheet, row_idx AS _source_row, c_name AS customer, c_acctbal::DECIMAL(12,2)::VARCHAR AS balance,
        c_mktsegment AS category FROM d""",
)
def _(load):
    return D.stack_records(D.extract_table(messy_sheets(load)), ["customer", "balance", "category"])


def _catalogue(load) -> DataFrame:
    """Parts as columns of their brand's sheet, some with names that have synonyms."""
    kind = F.col("p_size") % 10
    raw = (
        F.when(kind == 0, "Cliente").when(kind == 1, " Unit-Price").when(kind == 2, "#").when(kind == 3, "Clientes")
        .when(kind == 4, "CANTIDAD (u)").when(kind == 5, F.concat(F.col("p_name"), F.lit("!"))).otherwise(F.col("p_name"))
    )
    return load("part").select(F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("col"), raw.alias("raw"))


_NAMES_SQL = """n AS (SELECT p_brand AS sheet, p_partkey AS col, CASE p_size % 10 WHEN 0 THEN 'cliente' WHEN 1 THEN 'unit_price' WHEN 2 THEN 'unnamed' WHEN 3 THEN 'clientes'
    WHEN 4 THEN 'cantidad_u' ELSE replace(p_name, ' ', '_') END AS original,
    CASE p_size % 10 WHEN 0 THEN 'customer' WHEN 1 THEN 'price' WHEN 2 THEN 'unnamed' WHEN 3 THEN 'customer' WHEN 4 THEN 'quantity' ELSE replace(p_name, ' ', '_') END AS canonical FROM part)"""


@query(
    "normalize_columns",
    f"""WITH {_NAMES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sheet, canonical ORDER BY col) - 1 AS k FROM n)
        SELECT sheet, col, canonical || CASE WHEN k > 0 THEN '_' || k ELSE '' END AS name FROM r""",
)
def _(load):
    return D.normalize_columns(_catalogue(load)).select("sheet", "col", "name")


@query(
    "dedupe_suffix",
    """WITH r AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part)
       SELECT p_partkey, p_name || CASE WHEN k > 0 THEN '_' || k ELSE '' END AS name FROM r""",
)
def _(load):
    return D.dedupe_suffix(load("part").select("p_partkey", "p_name"), [], "p_partkey", "p_name", "name").select("p_partkey", "name")


@query(
    "canonical_schema",
    f"WITH {_NAMES_SQL} SELECT sheet, col, original, canonical, CASE WHEN canonical <> original THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence FROM n",
)
def _(load):
    return D.canonical_schema(_catalogue(load))


_KINDS = [*D.TYPE_LATTICE, "unknown"]
_ABOVE = ", ".join(f"('{t}', '{a}', {_KINDS.index(a)})" for t, above in D.TYPE_LATTICE.items() for a in above)
_KIND_SQL = "CASE (o_orderkey * 7 + o_custkey) % 23 % (1 + o_custkey % 9) " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_KINDS)) + " END"


@query(
    "common_types",
    f"""WITH c AS (SELECT o_custkey AS canonical, {_KIND_SQL} AS type FROM orders), above(type, t, place) AS (VALUES {_ABOVE}),
        n AS (SELECT canonical, count(*) AS sheets, count(DISTINCT CASE WHEN type <> 'unknown' THEN type END) AS kinds FROM c GROUP BY 1),
        fits AS (SELECT canonical, t, place FROM (SELECT DISTINCT canonical, type FROM c) JOIN above USING (type) JOIN n USING (canonical)
                 GROUP BY canonical, t, place, kinds HAVING count(*) = kinds)
        SELECT n.canonical, coalesce(arg_min(t, place), 'string') AS type, any_value(sheets) AS sheets, any_value(kinds) > 1 AS conflict
        FROM n LEFT JOIN fits USING (canonical) GROUP BY 1""",
)
def _(load):
    # Every customer's orders stand for the sheets of one canonical column, of up to nine types.
    key = (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 23 % (1 + F.col("o_custkey") % 9)
    kind = F.coalesce(*[F.when(key == i, F.lit(t)) for i, t in enumerate(_KINDS)])
    return D.common_types(load("orders").select(F.col("o_custkey").alias("canonical"), kind.alias("type")))


_SYNONYMS = ", ".join(
    f"({place}, {i}, '{canonical}', '{word}')"
    for place, (i, canonical, word) in enumerate((i, c, w) for c, ws in COLUMN_SYNONYMS.items() for i, w in enumerate([c, *ws]))
)
_LETTERS = sorted({ch for ws in COLUMN_SYNONYMS.values() for w in ws for ch in w})
_COMMON = " + ".join(
    f"least(length(word) - length(replace(word, '{ch}', '')), length(syn) - length(replace(syn, '{ch}', '')))" for ch in _LETTERS
)
# The common subsequence row by row: a cell is the largest so far of the one above and the one before it plus a match.
_FUZZY_SQL = f"""syns AS (SELECT * FROM (VALUES {_SYNONYMS}) t(place, own, canonical, syn)),
  words AS MATERIALIZED (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(lower(text), '[^\\pL\\pN_]+')) AS word FROM documents) WHERE word <> ''),
  exact AS (SELECT word, arg_min(canonical, place) AS canonical FROM words JOIN syns ON word = syn GROUP BY 1),
  near AS MATERIALIZED (SELECT word, place, canonical, syn, string_split(word, '') AS a, string_split(syn, '') AS b
    FROM words ANTI JOIN exact USING (word) JOIN syns ON own > 0 AND 200.0 * least(length(word), length(syn)) >= 80 * (length(word) + length(syn))
    WHERE 200.0 * ({_COMMON}) >= 80 * (length(word) + length(syn))),
  walk AS (
    SELECT word, place, 0 AS i, list_transform(range(len(a) + 1), lambda x: 0) AS row FROM near
    UNION ALL SELECT w.word, w.place, w.i + 1, list_prepend(0, list_transform(range(1, len(n.a) + 1), lambda j:
        list_max(list_transform(range(1, j + 1), lambda k: greatest(w.row[k + 1], w.row[k] + (n.a[k] = n.b[w.i + 1])::INT)))))
    FROM walk w JOIN near n USING (word, place) WHERE w.i < len(n.b)),
  scored AS (SELECT n.word, n.place, n.canonical, 200.0::DOUBLE * list_max(w.row) / (len(n.a) + len(n.b)) AS score FROM walk w JOIN near n USING (word, place) WHERE w.i = len(n.b))"""


_BEST_SQL = f"""WITH RECURSIVE {_FUZZY_SQL} SELECT word, canonical, 100.0::DOUBLE AS score, true AS exact FROM exact
        UNION ALL SELECT word, arg_min(canonical, (-score, place)), max(score), false FROM scored WHERE score >= 80 GROUP BY 1"""


@query("fuzzy_match_table", _BEST_SQL)
def _(load):
    # The same synonyms as a table, met through an index of grams.
    entries = [(i, own, c, w) for i, (c, ws) in enumerate(COLUMN_SYNONYMS.items()) for own, w in enumerate([c, *ws])]
    dictionary = load.spark.createDataFrame(entries, "position int, own int, canonical string, word string")
    names = load("documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("name"))
    return similar.match_dictionary(names, dictionary).withColumnRenamed("name", "word")


@query("fuzzy_match", _BEST_SQL)
def _(load):
    words = load("documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("word"))
    distinct = words.filter("word <> ''").distinct()
    matched = distinct.withColumn("m", match_synonyms()(F.col("word"))).filter("m.canonical IS NOT NULL")
    return matched.select("word", "m.canonical", "m.score", "m.exact")


@query(
    "source_row_number",
    "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS _source_row FROM orders",
)
def _(load):
    orders = load("orders").select("o_orderkey", "o_orderstatus")
    return running_number(orders, ["o_orderstatus"], [F.col("o_orderkey")], "_source_row", start=0)


@query(
    "stack_sheets",
    """SELECT 'customers' AS _source_sheet, row_number() OVER (ORDER BY c_custkey) - 1 AS _source_row, c_name AS name, c_acctbal AS balance, c_mktsegment AS category, NULL AS brand FROM customer
       UNION ALL SELECT 'suppliers', row_number() OVER (ORDER BY s_suppkey) - 1, s_name, s_acctbal, NULL, NULL FROM supplier
       UNION ALL SELECT 'parts', row_number() OVER (ORDER BY p_partkey) - 1, p_name, NULL, p_type, p_brand FROM part""",
)
def _(load):
    sheets = {
        "customers": load("customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("category")),
        "suppliers": load("supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        "parts": load("part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand")),
    }
    keys = {"customers": "c_custkey", "suppliers": "s_suppkey", "parts": "p_partkey"}
    return D.stack_sheets(sheets, {n: [F.col(k)] for n, k in keys.items()}).drop(*keys.values())


@query(
    "shared_columns",
    "SELECT p_name AS name FROM part WHERE p_brand = 'Brand#1' INTERSECT SELECT p_name FROM part WHERE p_brand = 'Brand#2'",
)
def _(load):
    names = lambda brand: load("part").filter(F.col("p_brand") == brand).select(F.col("p_name").alias("name"))
    return names("Brand#1").intersect(names("Brand#2"))


# Grouping of alike sheets is transitive; a test compares it with brute force.
_ALIKE_SQL = """cols AS (SELECT o_custkey AS sheet, o_orderpriority AS name, max(o_orderstatus) AS type FROM orders GROUP BY 1, 2),
  s AS (SELECT sheet, sha256('{"cols":[' || string_agg('{"name":"' || name || '","type":"' || type || '"}', ',' ORDER BY name, type) || ']}') AS sig,
          list(name ORDER BY name) AS names, list(name || ':' || type ORDER BY name) AS typed FROM cols GROUP BY 1),
  sigs AS MATERIALIZED (SELECT DISTINCT sig, names, typed FROM s),
  pairs AS (SELECT a.sig AS x, b.sig AS y, len(list_intersect(a.names, b.names)) AS shared, len(list_intersect(a.typed, b.typed)) AS same,
          len(a.names) AS na, len(b.names) AS nb FROM sigs a JOIN sigs b ON a.sig <> b.sig),
  alike AS MATERIALIZED (SELECT x, y FROM pairs WHERE abs(na - nb) <= 2 AND shared >= greatest(na, nb) * 0.5 AND same >= shared * 0.7),
  reach AS (SELECT sig AS x, sig AS y FROM sigs UNION SELECT r.x, a.y FROM reach r JOIN alike a ON a.x = r.y)"""


@query("sheet_clusters", f"WITH RECURSIVE {_ALIKE_SQL}, c AS (SELECT x AS sig, min(y) AS cluster FROM reach GROUP BY 1) SELECT sheet, cluster FROM s JOIN c USING (sig)")
def _(load):
    columns = load("orders").groupBy(F.col("o_custkey").alias("sheet"), F.col("o_orderpriority").alias("name")).agg(
        F.max("o_orderstatus").alias("type")
    )
    return D.sheet_clusters(columns)


@query(
    "head_rows",
    f"WITH {_SHEETS_SQL} SELECT sheet, row_idx FROM kinds WHERE row_idx <= 10",
)
def _(load):
    return messy_sheets(load).filter("row_idx <= 10").select("sheet", "row_idx")
