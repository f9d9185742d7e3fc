"""Workbook-cell graphs built from the order sheets, and graphs over parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.formulas import UNSUPPORTED_FUNCTIONS
from gridloom.operators import graph, grid, ordered
from gridloom.plans.cells import CELLS_SQL, ROLES_SQL, cells, edges, label_texts, roles
from gridloom.plans.registry import Loader, query
from gridloom.session import cut_lineage, discard, per_key


def _nodes(load: Loader):
    """Addresses alone: neither depth nor components need values and roles. They are read more than once."""
    return load.shared("cell_nodes", lambda: grid.with_missing_cells(cells(load).select("address", "sheet", "row", "col"), edges(load)).select("address"))


def _depths(load: Loader):
    return load.shared("cell_depths", lambda: graph.topological_depth(_nodes(load), edges(load)))


def _clusters(load: Loader):
    return load.shared("cell_clusters", lambda: graph.components(_nodes(load), edges(load)))


def _members(load: Loader):
    return roles(load).join(_clusters(load).hint("shuffle_merge"), "address")


@query("cell_references", f"WITH {CELLS_SQL} SELECT address, coalesce(value_type, 'blank') AS kind FROM full_cells")
def _(load):
    return grid.with_missing_cells(cells(load), edges(load)).select("address", F.col("value_type").alias("kind"))


@query("cell_roles", f"WITH {CELLS_SQL} SELECT address, role FROM base_roles")
def _(load):
    links = edges(load)
    formulas = cells(load).withColumn("formula", F.when(F.col("formula").isNotNull(), ""))
    return grid.cell_roles(grid.with_missing_cells(formulas, links, readers=True), links).select("address", "role")


@query("structural_cells", f"WITH {ROLES_SQL} SELECT address, value FROM roles WHERE role = 'structural'")
def _(load):
    return roles(load).filter("role = 'structural'").select("address", "value")


@query("label_cells", f"WITH {ROLES_SQL} SELECT address, trim(value) AS label, role FROM roles WHERE role IN ('label', 'structural')")
def _(load):
    return roles(load).filter("role IN ('label', 'structural')").select("address", F.trim("value").alias("label"), "role")


@query(
    "cell_groups",
    f"""WITH {ROLES_SQL}, heads AS (SELECT sheet, "row", max(trim(value)) AS label FROM roles WHERE role = 'structural' GROUP BY 1, 2),
        picked AS (SELECT r.sheet, r.address, r.role, max(h."row") AS hr, arg_max(h.label, h."row") AS label, r."row" AS rr
          FROM roles r LEFT JOIN heads h ON h.sheet = r.sheet AND h."row" <= r."row" WHERE r.role IN ('input', 'output') GROUP BY r.sheet, r.address, r.role, r."row")
        SELECT sheet || ' - ' || coalesce(label, 'General') || CASE role WHEN 'output' THEN ' Outputs' ELSE ' Inputs' END AS name, address
        FROM picked WHERE hr IS NULL OR hr < rr""",
)
def _(load):
    marked = roles(load)
    heads = (
        marked.filter("role = 'structural'").groupBy("sheet", "row").agg(F.max(F.trim("value")).alias("label"))
        .withColumn("kind", F.lit(0)).withColumn("head", F.struct("row", "label")).drop("label")
    )
    fields = marked.filter("role IN ('input', 'output')").select("sheet", "row", "address", "role", F.lit(1).alias("kind"))
    line = heads.unionByName(fields, allowMissingColumns=True)
    found = ordered.carry_last(line, ["sheet"], [F.col("row"), F.col("kind")], F.col("head"), "sec").filter("kind = 1")
    suffix = F.when(F.col("role") == "output", " Outputs").otherwise(" Inputs")
    return found.filter("sec IS NULL OR sec.row < row").select(
        F.concat("sheet", F.lit(" - "), F.coalesce("sec.label", F.lit("General")), suffix).alias("name"), "address"
    )


@query(
    "input_types",
    f"""WITH {CELLS_SQL} SELECT address, CASE WHEN value_type = 'number' AND number_format LIKE '%\\%%' ESCAPE '\\' THEN 'percentage'
        WHEN value_type = 'number' AND number_format LIKE '%$%' THEN 'currency' WHEN value_type = 'number' THEN 'number' ELSE 'text' END AS input_type
        FROM cells WHERE formula IS NULL""",
)
def _(load):
    return grid.input_types(cells(load).filter("formula IS NULL")).select("address", "input_type")


@query("edge_list", f"WITH {CELLS_SQL} SELECT source, target FROM edges")
def _(load):
    return grid.edge_list(cells(load)).select("source", "target")


@query(
    "node_degrees",
    f"""WITH {CELLS_SQL} SELECT address, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM full_cells
        LEFT JOIN (SELECT target, count(*) AS i FROM edges GROUP BY 1) ON target = address
        LEFT JOIN (SELECT source, count(*) AS o FROM edges GROUP BY 1) ON source = address""",
)
def _(load):
    return graph.node_degrees(_nodes(load), edges(load))


_DEPTH_SQL = f"""{CELLS_SQL},
  walk AS (SELECT address, 0 AS d FROM full_cells UNION SELECT e.target, w.d + 1 FROM walk w JOIN edges e ON e.source = w.address),
  depths AS (SELECT address, max(d) AS depth FROM walk GROUP BY 1)"""


@query("topological_depth", f"WITH RECURSIVE {_DEPTH_SQL} SELECT address, depth FROM depths")
def _(load):
    return _depths(load).select("address", "depth")


def _part_links(load):
    """Parts point at a coarser part; the nine coarsest point round in a circle and at part 0."""
    key = F.col("p_partkey")
    up = load("part").select(
        key.alias("s"),
        F.explode(F.when(key >= 10, F.array(F.floor(key / 10)))
                  .when(key >= 1, F.array(key % 9 + 1, F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))).alias("t"),
    )
    return up.select(F.col("s").cast("string").alias("source"), F.col("t").cast("string").alias("target"))


@query("cycle_nodes", "SELECT p_partkey::VARCHAR AS address FROM part WHERE p_partkey < 10")
def _(load):
    nodes = load("part").select(F.col("p_partkey").cast("string").alias("address"))
    return graph.cycle_nodes(nodes, graph.topological_depth(nodes, _part_links(load)))


# Order sheets of one customer meet in that customer's rate cell; everything else stands alone.
_CLUSTER_SQL = f"""{ROLES_SQL},
  linked AS (SELECT address, CASE WHEN sheet LIKE 'Cust%' THEN substr(sheet, 5)::BIGINT ELSE o_custkey END AS c FROM full_cells
      LEFT JOIN orders ON sheet = 'O' || o_orderkey SEMI JOIN (SELECT source AS address FROM edges UNION SELECT target FROM edges) ends USING (address)),
  clusters AS (SELECT address, min(address) OVER (PARTITION BY c) AS cluster FROM linked
      UNION ALL SELECT address, address FROM full_cells ANTI JOIN linked USING (address)),
  members AS (SELECT r.*, cluster FROM roles r JOIN clusters USING (address))"""


# A cell on a line that has no order line still belongs to its order's sum, so the SQL above may
# group by customer: every linked cell reaches D10 of its sheet and from there the customer's rate.
@query("connected_clusters", f"WITH {_CLUSTER_SQL} SELECT address, cluster FROM clusters")
def _(load):
    return _clusters(load)


@query(
    "cluster_summary",
    f"""WITH {_CLUSTER_SQL} SELECT cluster, count(*) AS nodes, count(*) FILTER (role = 'input') AS inputs,
        count(*) FILTER (role = 'output') AS outputs, count(*) FILTER (role NOT IN ('input', 'output')) AS others FROM members GROUP BY 1""",
)
def _(load):
    return graph.cluster_summary(_members(load))


def _count_sql(word: str) -> str:
    return f"((length(f) - length(replace(f, '{word}', ''))) // {len(word)})"


_SCORES = ", ".join(f"sum({' + '.join(_count_sql(w) for w in words)})::BIGINT AS {n}" for n, words in graph.PURPOSES)
_BEST = "greatest(" + ", ".join(n for n, _ in graph.PURPOSES) + ")"
_PURPOSE = " ".join(f"WHEN {n} = {_BEST} THEN '{n}'" for n, _ in graph.PURPOSES)


@query(
    "cluster_purpose",
    f"""WITH {_CLUSTER_SQL}, s AS (SELECT cluster, {_SCORES} FROM (SELECT cluster, upper(formula) AS f FROM members WHERE formula IS NOT NULL) GROUP BY 1)
        SELECT cluster, CASE WHEN {_BEST} = 0 THEN NULL {_PURPOSE} END AS purpose, {_BEST} AS hits FROM s""",
)
def _(load):
    return graph.cluster_purpose(_members(load))


_LABEL_SQL = """, l AS (SELECT *, CASE WHEN role IN ('label', 'structural') THEN trim(value) END AS text FROM members),
  labelled AS (SELECT address, cluster, role, coalesce(last_value(text IGNORE NULLS) OVER (PARTITION BY sheet, "row" ORDER BY col),
      last_value(text IGNORE NULLS) OVER (PARTITION BY sheet, col ORDER BY "row")) AS label FROM l)"""


def _cluster_names(load):
    labelled = load.shared("cell_labels", lambda: grid.nearest_label(label_texts(load)).select("address", "role", "label"))
    return graph.cluster_names(labelled.join(_clusters(load).hint("shuffle_merge"), "address"))


@query(
    "cluster_names",
    f"""WITH {_CLUSTER_SQL} {_LABEL_SQL}, c AS (SELECT *, trim(regexp_replace(label, '[^a-zA-Z0-9 _-]', '', 'g')) AS clean FROM labelled WHERE role IN ('input', 'output'))
        SELECT cluster, arg_min(lower(replace(clean, ' ', '_')), (CASE role WHEN 'output' THEN '0' ELSE '1' END) || address) AS name
        FROM c WHERE clean <> '' GROUP BY 1""",
)
def _(load):
    return _cluster_names(load)


@query(
    "unsupported_formulas",
    """SELECT l_orderkey, l_linenumber, unnest(CASE l_returnflag WHEN 'R' THEN ['INDIRECT'] WHEN 'N' THEN ['OFFSET', 'ADDRESS'] ELSE [] END) AS function
       FROM lineitem""",
)
def _(load):
    flag = F.col("l_returnflag")
    text = (
        F.when(flag == "R", "=INDIRECT(B1)").when(flag == "N", "=offset(A1,1,1)+ADDRESS (1,1)").otherwise("=SUM(A1:A2)+MYOFFSET(1)")
    )
    found = graph.unsupported(load("lineitem").withColumn("formula", text), "formula", UNSUPPORTED_FUNCTIONS)
    return found.select("l_orderkey", "l_linenumber", "function")


@query(
    "row_stats",
    f"""WITH {CELLS_SQL}, stats AS (SELECT sheet, "row", count(*) FILTER (trim(coalesce(value, '')) <> '' OR formula IS NOT NULL) AS non_empty,
          count(*) FILTER (formula IS NULL AND value_type = 'text') AS texts, count(*) FILTER (formula IS NULL AND value_type = 'number') AS numbers
          FROM cells GROUP BY 1, 2)
        SELECT *, max(non_empty) OVER (PARTITION BY sheet) AS widest FROM stats""",
)
def _(load):
    stats = grid.row_stats(cells(load))
    return stats.join(stats.groupBy("sheet").agg(F.max("non_empty").alias("widest")), "sheet")


@query(
    "sheet_links",
    f"""WITH {CELLS_SQL} SELECT split_part(source, '!', 1) AS from_group, split_part(target, '!', 1) AS to_group, count(*) AS weight FROM edges
        WHERE split_part(source, '!', 1) <> split_part(target, '!', 1) GROUP BY 1, 2""",
)
def _(load):
    return _sheet_links(load)


def _sheet_links(load):
    return graph.links(edges(load), F.substring_index("source", "!", 1), F.substring_index("target", "!", 1))


@query(
    "sheet_stats",
    f"""WITH {_CLUSTER_SQL}, k AS (SELECT sheet, cluster, count(*) FILTER (role = 'input') AS i, count(*) FILTER (role = 'output') AS o
          FROM members WHERE role IN ('input', 'output') GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY i + o DESC, cluster) AS n FROM k)
        SELECT sheet, sum(i)::BIGINT AS inputs, sum(o)::BIGINT AS outputs, max(cluster) FILTER (n = 1) AS primary_cluster FROM r GROUP BY 1""",
)
def _(load):
    return graph.sheet_stats(_members(load))


@query(
    "kpi_top5",
    f"""WITH RECURSIVE {_DEPTH_SQL}, i AS (SELECT target, count(*) AS n FROM edges GROUP BY 1)
        SELECT b.address, coalesce(n, 0) + depth AS score FROM base_roles b JOIN depths USING (address) LEFT JOIN i ON target = b.address
        WHERE role = 'output' ORDER BY score DESC, b.address LIMIT 5""",
)
def _(load):
    outputs = roles(load).filter("role = 'output'").select("address")
    scored = graph.node_degrees(outputs, edges(load)).join(_depths(load), "address")
    return scored.select("address", (F.col("in_degree") + F.col("depth")).alias("score")).orderBy(F.desc("score"), "address").limit(5)


@query(
    "cluster_order",
    f"""WITH RECURSIVE {_CLUSTER_SQL} {_LABEL_SQL},
        walk AS (SELECT address, 0 AS d FROM full_cells UNION SELECT e.target, w.d + 1 FROM walk w JOIN edges e ON e.source = w.address),
        deepest AS (SELECT cluster, max(d) AS depth FROM walk JOIN members USING (address) GROUP BY 1),
        clean AS (SELECT *, trim(regexp_replace(label, '[^a-zA-Z0-9 _-]', '', 'g')) AS clean FROM labelled WHERE role IN ('input', 'output')),
        named AS (SELECT cluster, arg_min(lower(replace(clean, ' ', '_')), (CASE role WHEN 'output' THEN '0' ELSE '1' END) || address) AS name FROM clean WHERE clean <> '' GROUP BY 1),
        c AS (SELECT cluster, count(*) FILTER (role = 'output') AS outputs FROM members GROUP BY 1)
        SELECT cluster, outputs, depth, name, row_number() OVER (ORDER BY outputs DESC, depth, coalesce(name, ''), cluster) AS place
        FROM c JOIN deepest USING (cluster) LEFT JOIN named USING (cluster)""",
)
def _(load):
    """Clusters with the most outputs first; among equals the shallower, then by name."""
    # Members and clusters are read more than once, the latter by the sample of their order too.
    members = cut_lineage(_members(load).select("address", "cluster", "role"), "members", codec="zstd")
    # One after the other, so that the shuffle files of the next find those of the last gone.
    sized = per_key(graph.cluster_summary(members).select("cluster", "outputs"))
    deepest = per_key(members.select("address", "cluster").join(_depths(load), "address").groupBy("cluster").agg(F.max("depth").alias("depth")))
    discard(members)
    named = per_key(_cluster_names(load))
    every = cut_lineage(sized.join(deepest, "cluster").join(named, "cluster", "left"), "ranked-clusters", codec="zstd")
    for part in (sized, deepest, named):
        discard(part)
    order = [-F.col("outputs"), F.col("depth"), F.coalesce("name", F.lit("")), F.col("cluster")]
    return ordered.running_number(every, [], order, "place")


@query(
    "top_clusters",
    f"""WITH {CELLS_SQL}, k AS (SELECT split_part(source, '!', 1) AS a, split_part(target, '!', 1) AS b, count(*) AS w FROM edges
          WHERE split_part(source, '!', 1) <> split_part(target, '!', 1) GROUP BY 1, 2)
        SELECT member, sum(w)::BIGINT AS weight FROM (SELECT a AS member, w FROM k UNION ALL SELECT b, w FROM k) GROUP BY 1 ORDER BY weight DESC, member LIMIT 4""",
)
def _(load):
    return graph.connection_weight(_sheet_links(load)).orderBy(F.desc("weight"), "member").limit(4)
