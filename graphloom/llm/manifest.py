"""Merkle manifest of a dataset: every row's leaf, the roots above it, its proof, and whether a changed row still leads to the root.

Blocks of neighbouring leaves go to executors as Arrow tables, where DuckDB works out their levels; Spark combines the blocks' roots."""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import forget, materialise, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WAYS = "array<struct<before:string,after:string>>"


def leaf_of(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values end to end: '-' for null, else the number of UTF-8 bytes, ':' and the value (numbers in decimal)."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def positions(rows: DataFrame, group: str, *order: str) -> tuple[DataFrame, str]:
    """rows with pos, from 0 in the given order within their group (null is a group), and n, the group's rows; and the path that they were written to.

    One range partitioning; each partition numbers its own sorted rows, and counts by partition and group, of which there are as many
    as partitions and groups at most, move them up. Rows that are equal in all of group and order are told apart by where they came from, so that
    a third of all rows being alike still spreads over tasks; which of them comes first is left open."""
    ranged = rows.withColumn("_from", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_from").sortWithinPartitions(group, *order)
    ranged, path = materialise(ranged.drop("_from").withColumn("_at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_own"))
    counts = ranged.groupBy("_part", F.col(group).alias("_group")).agg(F.min("_own").alias("_first"), F.count("*").alias("_k"))
    earlier = F.sum("_k").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("_part").alias("_p"), "_group", (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_up"), F.sum("_k").over(Window.partitionBy("_group")).alias("n"))
    placed = ranged.join(counts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group")))
    return placed.select(*rows.columns, (F.col("_own") + F.col("_up")).alias("pos"), "n"), path


def climbed(nodes: DataFrame, fanout: int = 8) -> tuple[DataFrame, list[str]]:
    """(grp, pos, root, ways) of nodes (grp, pos, n, digest), n of which make up a group's lowest level; and the paths written to.

    ways: for each level from the bottom, the digests of the node's run before and after its ancestor, joined. Each level is one grouping of at most
    fanout rows, up to the root, and one join on the way down; levels shrink by fanout, so all of them together are little more than the first."""
    nodes, path = materialise(nodes.select("grp", "pos", "n", "digest"), "nodes")
    levels, paths = [], [path]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        digests = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        runs = nodes.groupBy("grp", "n", F.floor(F.col("pos") / fanout).alias("run")).agg(digests.alias("digests"))
        runs, path = materialise(runs, "runs")
        levels.append(runs)
        paths.append(path)
        digest = F.when(F.col("n") > 1, F.sha2(F.array_join("digests", "").cast("binary"), 256)).otherwise(F.col("digests")[0])
        nodes = runs.select("grp", F.col("run").alias("pos"), F.ceil(F.col("n") / fanout).alias("n"), digest.alias("digest"))
        most = -(-most // fanout)
    found = nodes.select("grp", "pos", F.col("digest").alias("root"), F.array().cast(_WAYS).alias("ways"))
    for runs in reversed(levels):
        above = found.select(F.col("grp").alias("_grp"), F.col("pos").alias("_pos"), "root", "ways")
        held = runs.join(above, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("run") == F.col("_pos"))).select("grp", "n", "run", "digests", "root", "ways", F.posexplode("digests").alias("at", "own"))
        joined = lambda a, b: F.array_join(F.slice("digests", a, b), "")
        way = F.struct(joined(F.lit(1), F.col("at")).alias("before"), joined(F.col("at") + 2, F.size("digests")).alias("after"))
        found = held.select("grp", (F.col("run") * fanout + F.col("at")).alias("pos"), "root", F.when(F.col("n") > 1, F.concat(F.array(way), "ways")).otherwise(F.col("ways")).alias("ways"))
    return found, paths


@cache
def _engine():
    """This worker's DuckDB: one thread, little memory, nothing on disk."""
    import duckdb

    return duckdb.connect(config={"threads": "1", "memory_limit": "512MB", "temp_directory": ""})


def _level_sql(levels: int, fanout: int) -> str:
    """Common table expressions n0..n<levels> (pos, d) and r1..r<levels> (run, r): each level's runs as ordered string_agg, and their sha256."""
    out = ["n0 AS (SELECT pos, lower(hex(leaf)) AS d FROM leaves)"]
    for k in range(1, levels + 1):
        out.append(f"r{k} AS MATERIALIZED (SELECT pos // {fanout} AS run, string_agg(d, '' ORDER BY pos) AS r FROM n{k - 1} GROUP BY run)")
        out.append(f"n{k} AS (SELECT run AS pos, sha256(r) AS d FROM r{k})")
    return "WITH " + ", ".join(out)


def height(n: int, fanout: int) -> int:
    """Levels of runs above n nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _block_root(fanout: int, levels: int):
    def run(key: tuple, leaves: pa.Table) -> pa.Table:
        con, n = _engine(), leaves.column("n")[0].as_py()
        k = min(levels, height(n, fanout))
        con.register("leaves", leaves)
        digest = con.execute(f"{_level_sql(k, fanout)} SELECT any_value(d) FROM n{k}").fetchall()[0][0]
        con.unregister("leaves")
        grp, block = leaves.column("grp").slice(0, 1), leaves.column("block").slice(0, 1)
        return pa.table({"grp": grp, "pos": block, "n": pa.array([max(1, -(-n // fanout**levels))], pa.int64()), "digest": pa.array([digest], pa.string())})

    return run


def _block_proofs(fanout: int, levels: int):
    def run(key: tuple, leaves: pa.Table, outer: pa.Table) -> pa.Table:
        con, n = _engine(), leaves.column("n")[0].as_py()
        k = min(levels, height(n, fanout))
        subroot, root, ways = (outer.column(c)[0].as_py() for c in ("subroot", "root", "ways"))
        con.register("leaves", leaves)
        steps = ["s0 AS (SELECT row, pos, lower(hex(coalesce(other, leaf))) AS cur, '' AS sib FROM (SELECT row_number() OVER () AS row, pos, leaf, other FROM leaves))"]
        for at in range(1, k + 1):
            before, after = f"substr(r, 1, 64 * (pos % {fanout}))", f"substr(r, 64 * (pos % {fanout}) + 65)"
            steps.append(f"s{at} AS (SELECT row, pos // {fanout} AS pos, sha256({before} || cur || {after}) AS cur, sib || {before} || {after} AS sib FROM s{at - 1} JOIN r{at} ON run = pos // {fanout})")
        cur, given = "cur", []
        for way in ways:  # the same for all leaves of the block
            cur = f"sha256(? || {cur} || ?)"
            given = [way["before"], *given, way["after"]]
        above = "".join(way["before"] + way["after"] for way in ways)
        sql = f"{_level_sql(k, fanout)}, {', '.join(steps)} SELECT {cur} AS folded, sha256(sib || ?) AS proof FROM s{k} ORDER BY row"
        got = con.sql(sql, params=[*given, above]).to_arrow_table()
        con.unregister("leaves")
        folded = got.column("folded").to_pylist()
        same = lambda x: pa.array([x] * len(folded), pa.string())
        hexed = pa.array([x.hex() for x in leaves.column("leaf").to_pylist()], pa.string())
        return pa.table({"id": leaves.column("id"), "leaf": hexed, "subroot": same(subroot), "root": same(root), "proof_sha256": got.column("proof"), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == root for x in folded], pa.bool_())})

    return run


def merkle_manifest(rows: DataFrame, columns: list[str], id_col: str, group_col: str, changed: dict[str, Column] | None = None, where: Column | None = None, fanout: int = 8, levels: int = 4) -> DataFrame:
    """id_col, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    A row's leaf is leaf_of() its columns. In each group (null is one) the leaves ascend by id, null first, then by leaf; every fanout
    neighbours become the digest of theirs, the last run being shorter, until one is left, the subroot; a lone leaf is its own. Subroots in
    order of their groups, null first, bytewise, lead to the root in the same way. The proof is the digest of all that stands beside a row's way
    up, level by level, left to right. Where the condition where holds, the row counts as changed: its leaf is made of the columns as changed has them,
    and folded_root is what that leaf and the original siblings lead to; elsewhere it is worked out in the same way from the row's own leaf.

    Leaves are made in one scan, so only digests move. They are numbered by ranges and dealt in aligned blocks of fanout ** levels; DuckDB
    works out a block's levels where it lies, first for its root, then, once Spark has combined the roots and handed every block the
    way from its root to the top, for its rows' proofs. A block is a task's unit, so neither a large group nor rows all alike gather
    anywhere. Repeated rows have equal leaves and places next to each other. Other columns are not read; no rows, no manifest."""
    spark, changed = rows.sparkSession, changed or {}
    given = lambda c: F.col(f"`{c}`")
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(False)
    leaf, other = leaf_of(*map(given, columns)), leaf_of(*[changed.get(c, given(c)) for c in columns])
    leaves = rows.select(given(group_col).cast("string").alias("grp"), given(id_col).alias("id"), F.unhex(leaf).alias("leaf"), F.when(hit, F.unhex(other)).alias("other"))
    placed, _ = positions(leaves, "grp", "id", "leaf")
    placed = placed.withColumn("block", F.floor(F.col("pos") / fanout**levels).cast("long"))
    roots = placed.groupBy("grp", "block").applyInArrow(_block_root(fanout, levels), "grp string, pos long, n long, digest string")
    inner, paths = climbed(roots, fanout)
    inner, path = materialise(inner, "inner")
    subroots, ranged = positions(inner.filter("pos = 0").select("grp", F.col("root").alias("digest"), F.lit("").alias("_all")), "_all", "grp")
    tops, more = climbed(subroots.select(F.col("grp").alias("name"), "_all", "pos", "n", "digest").select(F.col("_all").alias("grp"), "pos", "n", "digest"), fanout)
    tops = tops.select("pos", F.col("root").alias("top"), F.col("ways").alias("up")).join(subroots.select(F.col("grp").alias("_grp"), "pos"), "pos").drop("pos")
    outer = inner.join(tops, F.col("grp").eqNullSafe(F.col("_grp"))).select("grp", F.col("pos").alias("block"), F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("ways", "up").alias("ways"))
    outer, _ = materialise(outer, "outer")
    for done in (*paths, path, ranged, *more):
        forget(spark, done)
    kind = leaves.schema["id"].dataType.simpleString()
    found = placed.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInArrow(_block_proofs(fanout, levels), f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return found.withColumnRenamed("id", id_col)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents by lang, with texts lower-cased where 3 divides the row's crc32."""
    documents = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle_manifest(documents, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", {"text": F.translate("text", _UPPER, _LOWER)}, tampered)


def _oracle(levels: int = 10) -> str:
    """SQL of op12's rows for groups of up to 8 ** levels rows."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda text: f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    crc = "list_reduce(list_prepend(4294967295, range(0, 8 * length(doc_id::VARCHAR))), lambda c, i: CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, CAST(i // 8 + 1 AS INTEGER), 1))) ELSE c END) & 1 = 1 THEN xor((CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, CAST(i // 8 + 1 AS INTEGER), 1))) ELSE c END) >> 1, 3988292384) ELSE (CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, CAST(i // 8 + 1 AS INTEGER), 1))) ELSE c END) >> 1 END)"
    out = [
        f"l AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents)",
        "s0 AS (SELECT doc_id, coalesce('+' || lang, '') AS g, leaf, other AS cur, '' AS sib, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l)",
        "a0 AS (SELECT g, pos, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM s0)",
    ]

    def climb(nodes: str, rows: str, runs: str, group: str) -> tuple[str, str]:
        for k in range(levels):
            here, there = f"{nodes}{k}", f"{nodes}{k + 1}"
            out.append(f"{runs}{k + 1} AS (SELECT {group}, pos // 8 AS run, n, string_agg(d, '' ORDER BY pos) AS r FROM {here} GROUP BY {group}, run, n)")
            out.append(f"{there} AS (SELECT {group}, run AS pos, CASE WHEN n > 1 THEN sha256(r) ELSE r END AS d, CAST((n + 7) // 8 AS BIGINT) AS n FROM {runs}{k + 1})")
            before, after = "substr(r, 1, CAST(64 * (s.pos % 8) AS INTEGER))", "substr(r, CAST(64 * (s.pos % 8) + 65 AS INTEGER))"
            out.append(f"{rows}{k + 1} AS (SELECT s.* REPLACE (s.pos // 8 AS pos, CASE WHEN n > 1 THEN sha256({before} || cur || {after}) ELSE cur END AS cur, CASE WHEN n > 1 THEN sib || {before} || {after} ELSE sib END AS sib) FROM {rows}{k} s JOIN {runs}{k + 1} x ON s.{group} = x.{group} AND s.pos // 8 = x.run)")
        return f"{nodes}{levels}", f"{rows}{levels}"

    subs, rows = climb("a", "s", "ra", "g")
    out.append(f"sub AS (SELECT g, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM {subs})")
    out.append("b0 AS (SELECT 0 AS o, place AS pos, subroot AS d, n FROM sub)")
    out.append(f"t0 AS (SELECT doc_id, leaf, subroot, cur, sib, place AS pos, 0 AS o FROM {rows} s JOIN sub ON s.g = sub.g)")
    tops, rows = climb("b", "t", "rb", "o")
    out.append(f"f AS (SELECT doc_id, leaf, subroot, d AS root, sha256(sib) AS proof_sha256, coalesce(cur, d) AS folded_root FROM {rows}, (SELECT d FROM {tops}))")
    return "WITH " + ",\n".join(out) + "\nSELECT *, folded_root = root AS verified FROM f"


ORACLE_SQL = _oracle()
