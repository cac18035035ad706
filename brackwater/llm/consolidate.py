"""Consolidating pairwise matches into groups: union-find on a two-dimensional grid.

Vertices are hashed into B blocks and every edge belongs to the cell (block of
one end, block of the other end); a cell with more edges than the bound is split
by a hash of the edge, so a hub's edges spread over as many parts as they need.
In each round every part runs a local union-find and leaves a star: each vertex
points to the smallest vertex that it reaches inside the part.  Then the
representatives that a vertex got in the parts of its row and column are
exchanged: the smallest becomes its parent, the others are linked to it, and
parents hand on what they got.  The rounds end when no vertex has two
representatives and no parent has a parent.

Parents with more children than a part may hold edges are few (at most edges /
bound); they are broadcast, all others are joined by key.  Every round is a
written table in the shared folder; the tables of the round before are deleted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.runtime import release, stored, table

#: Edges that one part of the grid may hold (twice as many where a hash spreads unevenly).
EDGES_PER_CELL = 400_000
#: The grid has at least this many blocks a side, however few edges there are.
LEAST_BLOCKS = 4


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = root(a), root(b)
            if ra < rb:
                parent[rb] = ra
            elif rb < ra:
                parent[ra] = rb
    members = list(parent)
    for at in range(0, len(members), 20_000):
        part = members[at : at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([root(x) for x in part], pa.string())], names=["v", "p"])


def grid_parts(links: DataFrame, edges_per_cell: int, edges: int | None = None) -> DataFrame:
    """The links (v, p) hashed into the parts of the grid, each part in one task; ``edges`` is their number, if known."""
    edges = links.count() if edges is None else edges
    blocks = max(LEAST_BLOCKS, math.ceil(math.sqrt(edges / edges_per_cell)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    celled = links.select("v", "p", (block("v") * blocks + block("p")).alias("cell"))
    if edges <= edges_per_cell:
        # No cell can hold more than all edges: none is split.
        return celled.repartitionById(blocks * blocks, "cell").select("v", "p")
    # One row for each cell: blocks * blocks rows, that is edges / edges_per_cell or 16.
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / edges_per_cell).cast("int").alias("splits"))
    split = F.pmod(F.xxhash64("v", "p", F.lit(7)), F.col("splits")).cast("int")
    starts, total = [], 0
    for row in sorted(sizes.collect(), key=lambda r: r.cell):
        starts.append((row.cell, total, row.splits))
        total += row.splits
    begin = links.sparkSession.createDataFrame(starts, "cell int, start int, splits int")
    placed = celled.join(F.broadcast(begin), "cell").select("v", "p", (F.col("start") + split).alias("part"))
    return placed.repartitionById(max(1, total), "part").select("v", "p")


def _lifted(drawn: DataFrame, above: DataFrame, edges: int, edges_per_cell: int) -> DataFrame:
    """``drawn`` (v, p) with ``up``, the representative of each parent; null where a parent has none."""
    if 2 * edges <= edges_per_cell:
        # A round draws at most two links for each edge: no parent can have more children than a part may hold.
        return drawn.join(above, "p", "left")
    hot = drawn.groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") > edges_per_cell).select("p")
    # A parent that is smallest in all its parts has no row in ``above`` and keeps its children.
    hot_above = hot.join(above, "p", "left")
    cold = drawn.join(F.broadcast(hot), "p", "left_anti").join(above, "p", "left")
    return cold.unionByName(drawn.join(F.broadcast(hot_above), "p").select("p", "v", "up"))


def connected_groups(edges: DataFrame, edges_per_cell: int = EDGES_PER_CELL) -> DataFrame:
    """(v, group_id) of every vertex of the edges (a, b); group_id is the smallest vertex of its component.

    Edges with a null end and edges of a vertex to itself are ignored; repeated
    edges and both directions count once; other columns are ignored; an empty
    table gives an empty result.
    """
    links = stored(
        edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("p"))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .distinct(),
        "links",
    )
    while True:
        count = links.count()
        stars = grid_parts(links, edges_per_cell, count).mapInArrow(_stars, "v string, p string")
        # A vertex has at most one representative for each part it occurs in.
        heads = stored(stars.groupBy("v").agg(F.min("p").alias("m"), F.collect_set("p").alias("reps")), "heads")
        moved = heads.select(F.explode("reps").alias("v"), F.col("m").alias("p")).filter(F.col("v") != F.col("p"))
        own = heads.select("v", F.col("m").alias("p")).filter(F.col("v") != F.col("p"))
        # A parent that got a smaller representative in another part hands it on, so chains shrink by half.
        above = heads.select(F.col("v").alias("p"), F.col("m").alias("up"))
        lifted = _lifted(own.unionByName(moved).distinct(), above, count, edges_per_cell)
        before, links = links, stored(lifted.select("v", F.coalesce("up", "p").alias("p")).filter("v <> p").distinct(), "links")
        release(before, heads)
        # Open while a vertex has two representatives or a parent has a parent.
        loose = links.groupBy("v").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("v").limit(1)
        parents = links.select(F.col("p").alias("v")).distinct().join(links.select("v"), "v", "left_semi").limit(1)
        if not loose.unionByName(parents).limit(1).count():
            break
    found = links.select("v", F.col("p").alias("group_id"))
    return found.unionByName(found.select(F.col("group_id").alias("v"), "group_id").distinct())


def _tidy(c) -> F.Column:
    return F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))


def incident_links(match_results: DataFrame, incidents: DataFrame) -> DataFrame:
    """Candidate links (a, b) with tidy ids: match rows that need no review and linked official alerts."""
    matches = match_results.filter(~F.coalesce("requires_review", F.lit(False))).select(
        _tidy(F.col("incident_id")).alias("a"), _tidy(F.col("matched_id")).alias("b")
    )
    linked = incidents.select(_tidy(F.col("incident_id")).alias("a"), F.explode("linked_official_alert_ids").alias("x")).select(
        "a", _tidy(F.col("x")).alias("b")
    )
    return matches.unionByName(linked).filter((F.col("a") != F.col("b"))).distinct()


def linked_record_groups(match_results: DataFrame, incidents: DataFrame, alerts: DataFrame) -> DataFrame:
    """(rec_id, group_id) of every record with a link to another record.

    Ids are compared ignoring case and outer white space; ids that name no row
    of incidents or alerts and links of a record to itself do not count.
    """
    links = incident_links(match_results, incidents)
    records = incidents.select(F.col("incident_id").alias("id")).unionByName(alerts.select(F.col("alert_id").alias("id")))
    ends = links.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    named = stored(
        records.select("id", _tidy(F.col("id")).alias("k")).join(ends, "k", "left_semi").groupBy("k").agg(F.min("id").alias("id")),
        "named",
    )
    left = named.select(F.col("k").alias("a"), F.col("id").alias("a_id"))
    right = named.select(F.col("k").alias("b"), F.col("id").alias("b_id"))
    edges = links.join(left, "a").join(right, "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return connected_groups(edges).select(F.col("v").alias("rec_id"), "group_id")


def p5_found(spark, sf_dir: str) -> DataFrame:
    return linked_record_groups(table(spark, sf_dir, "match_results"), table(spark, sf_dir, "incidents"), table(spark, sf_dir, "alerts"))


P5_SQL = """
WITH RECURSIVE recs AS (SELECT lower(trim(id)) AS k, min(id) AS id FROM (SELECT incident_id AS id FROM incidents UNION ALL SELECT alert_id FROM alerts) GROUP BY 1),
raw AS (SELECT lower(trim(incident_id, E' \\t\\n\\r')) AS a, lower(trim(matched_id, E' \\t\\n\\r')) AS b FROM match_results WHERE requires_review IS DISTINCT FROM true
  UNION SELECT lower(trim(incident_id)), lower(trim(x, E' \\t\\n\\r')) FROM (SELECT incident_id, unnest(linked_official_alert_ids) AS x FROM incidents)),
e AS (SELECT ra.id AS a, rb.id AS b FROM raw JOIN recs ra ON ra.k = raw.a JOIN recs rb ON rb.k = raw.b WHERE raw.a <> raw.b),
und AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS v, a AS r FROM und UNION SELECT reach.v, und.b FROM reach JOIN und ON und.a = reach.r)
SELECT v AS rec_id, min(r) AS group_id FROM reach GROUP BY v
"""
