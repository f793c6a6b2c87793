"""Merkle manifest of a dataset: a tree of digests for each group of rows and one over the groups, with proofs.

Leaves are hashed where the rows lie and stored; only digests travel from there. They are sorted by (tree, key) over a
range partitioning into runs and get their coordinate (tree, place) from the counts of the runs. The node store is
Parquet in partitions by level: each pass reads one level by blocks of fanout ** height neighbours and writes the
levels above it up to the block's root, so a table of any size takes log(rows) / log(block) passes and a task holds one
block. Proofs are read from the store the other way: nodes and claims meet by block of coordinates, merged in sorted
order, from the root's blocks down to the leaves'; what lies above a block is one string that its rows share.

Defined results: nulls are fields of their own (`-`); null groups are a tree, the first; leaves ascend by key, null
keys last, equal keys by their leaf digest; repeated rows are leaves each; empty texts have length 0; an empty table
gives an empty result. Columns besides the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, numbered, table

NODE = "tree string, idx long, n long, digest string, level int"
EACH = 20_000  # rows of a task that hashes or proves


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else byte count, colon, value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def build(leaves: DataFrame, rows: int, fanout: int = 2, height: int = 9) -> list[DataFrame]:
    """Node stores of all passes over leaves(tree, idx, n, digest); n counts the nodes of a tree on that level. Each store's lowest level is what the pass read."""
    block = fanout**height

    def climb(key: tuple, nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("idx")
        below, first, n, level = nodes["digest"].to_pylist(), key[1].as_py() * block, nodes["n"][0].as_py(), nodes["level"][0].as_py()
        found = [[], [], [], []]
        while True:
            for k, values in enumerate((range(first, first + len(below)), [n] * len(below), below, [level] * len(below))):
                found[k].extend(values)
            if n == 1 or level - nodes["level"][0].as_py() == height:
                break
            below = [digest("".join(below[a : a + fanout])) for a in range(0, len(below), fanout)]
            first, n, level = first // fanout, -(-n // fanout), level + 1
        return pa.table([pa.array([key[0].as_py()] * len(found[0]), pa.string()), pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.string()), pa.array(found[3], pa.int32())], names=["tree", "idx", "n", "digest", "level"])

    passes, base = [], leaves.select("tree", "idx", "n", "digest", F.lit(0).alias("level"))
    while rows:
        blocks = base.select("*", F.expr(f"idx div {block}").alias("block")).repartition(-(-rows // EACH), "tree", "block")
        done = blocks.groupBy("tree", "block").applyInArrow(climb, NODE)
        passes.append(materialize(done, "nodes", by="level"))
        base = passes[-1].where((F.col("level") == height * len(passes)) & (F.col("n") > 1))
        rows = base.count()
    return passes


def tops(passes: list[DataFrame]) -> DataFrame:
    """tree, digest of each tree's root."""
    found = [p.where("n = 1").select("tree", "digest", "level") for p in passes]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out.groupBy("tree").agg(F.max_by("digest", "level").alias("digest"))  # a lone leaf is its own root


def fold(claim: str, proof: str) -> str:
    """The root that a leaf's digest and its proof give. A proof has a step for each level, ended by /: the run's digests in order, with * for the node itself."""
    for step in proof.split("/")[:-1]:
        claim = digest(step.replace("*", claim))
    return claim


def plain(proof: str) -> str:
    return proof.replace("*", "").replace("/", "")


def prove(passes: list[DataFrame], entry: DataFrame, claims: DataFrame, fanout: int = 2, height: int = 9, finish: tuple | None = None) -> DataFrame:
    """Proofs of claims(tree, idx, n, ...) from the store.

    entry(tree, above) is what all proofs of a tree end with: free columns' text, a blank, and the steps above the tree.
    Returns tree, idx and proof (as entry has it) of each claim, or with finish = (function, schema) what that makes of
    (table of claims, list of proofs).
    """
    block, sides = fanout**height, []
    for p, store in enumerate(passes):
        nodes = store.where(F.col("level") < p * height + height)
        div = F.expr(f"idx div cast(pow({fanout}, {p * height + height} - level) as bigint)")
        sides.append(nodes.select("tree", div.alias("block"), "level", "idx", "n", "digest"))

    def extract(p: int, last: bool):
        base = p * height

        def run(key: tuple, nodes: pa.Table, claims: pa.Table) -> pa.Table:
            place, count, above = {}, {}, ""
            for level, idx, n, text in zip(*(nodes[c].to_pylist() for c in ("level", "idx", "n", "digest")), strict=True):
                if level < 0:
                    above = text
                else:
                    place[level, idx] = text
                    count[level] = n
            head, _, rest = above.partition(" ")
            proofs = []
            for idx in claims["idx"].to_pylist():
                steps = []
                for level in range(base, base + height):
                    n = count.get(level, 1)
                    if n == 1:
                        break
                    first = idx - idx % fanout
                    steps.extend("*" if j == idx else place[level, j] for j in range(first, min(first + fanout, n)))
                    steps.append("/")
                    idx //= fanout
                proofs.append(f"{head} {''.join(steps)}{rest}")
            if last and finish:
                return finish[0](claims, proofs)
            return pa.table([claims["tree"], claims["idx"], pa.array(proofs, pa.string())], names=["tree", "idx", "proof"])

        return run

    upper, old = None, None
    sizes = claims.groupBy("tree").agg(F.max("n").alias("size"))
    starts = entry.join(sizes, "tree")
    for p in reversed(range(len(passes))):
        unit = fanout ** (p * height)
        top = starts.where((F.col("size") <= unit * block) & (F.lit(p == 0) | (F.col("size") > unit)))
        above = top.select("tree", F.lit(0).cast("long").alias("block"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"), F.lit(1).cast("long").alias("n"), F.col("above").alias("digest"))
        if upper is not None:
            above = above.unionAll(upper.select("tree", F.col("idx").alias("block"), F.lit(-1), F.lit(0).cast("long"), F.lit(1).cast("long"), "proof"))
        asked = claims if p == 0 else passes[p].where((F.col("level") == p * height) & (F.col("n") > 1)).select(*(F.col(c).alias(c) for c in ("tree", "idx", "n")))
        asked = asked.withColumn("block", F.expr(f"idx div {block}"))
        tasks = -(-asked.count() // EACH) or 1
        nodes = sides[p].unionAll(above).repartition(tasks, "tree", "block").groupBy("tree", "block")
        out = nodes.cogroup(asked.repartition(tasks, "tree", "block").groupBy("tree", "block")).applyInArrow(extract(p, p == 0), finish[1] if finish and p == 0 else "tree string, idx long, proof string")
        if p == 0:
            return out
        old, upper = upper, materialize(out, "proofs")
        if old is not None:
            discard(old)
    raise ValueError("no pass: the table is empty")


RESULT = "doc_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "lang", claim: dict[str, Column] | None = None, fanout: int = 2, height: int = 9) -> DataFrame:
    """One row a leaf: its key, leaf, subroot, root, proof_sha256, and what a check of the claim gives: folded_root, verified.

    claim maps fields to the values that whoever presents a row claims; by default the row as it is.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    claimed = [(claim or {}).get(f, F.col(f)) for f in fields]
    own = leaf([F.col(f) for f in fields])
    hashed = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"), own.alias("digest"), (leaf(claimed) if claim else own).alias("claim"))
    hashed = materialize(hashed.withColumn("place", F.monotonically_increasing_id()), "leaves")
    rows = hashed.count()
    if not rows:
        return spark.createDataFrame([], RESULT.format(kind))
    claims = numbered(hashed, "tree", [F.col("doc_id").asc_nulls_last(), F.col("digest"), F.col("place")], rows)
    discard(hashed)
    passes = build(claims, rows, fanout, height)

    subroots = materialize(tops(passes).coalesce(-(-rows // EACH)).withColumnRenamed("tree", "name"), "subroots")
    trees = subroots.count()
    upper = numbered(subroots.withColumn("tree", F.lit("")), "tree", [F.col("name")], trees)
    crown = build(upper, trees, fanout, height)
    root = tops(crown).select("tree", F.concat("digest", F.lit(" ")).alias("above"))
    shape = "tree string, above string"

    def enter(claims: pa.Table, proofs: list[str]) -> pa.Table:
        """root,subroot and the steps from the subroot to the root."""
        above = [f"{r},{s} {steps}" for (r, _, steps), s in zip((p.partition(" ") for p in proofs), claims["digest"].to_pylist(), strict=True)]
        return pa.table([claims["name"], pa.array(above, pa.string())], names=["tree", "above"])

    entry = materialize(prove(crown, root, upper.select("tree", "idx", "n", "name", "digest"), fanout, height, (enter, shape)), "entries")

    def check(claims: pa.Table, proofs: list[str]) -> pa.Table:
        found = []
        for c, proof in zip(claims["claim"].to_pylist(), proofs, strict=True):
            head, _, steps = proof.partition(" ")
            root, _, subroot = head.partition(",")
            folded = fold(c, steps)
            found.append({"subroot": subroot, "root": root, "proof_sha256": digest(plain(steps)), "folded_root": folded, "verified": folded == root})
        kinds = pa.schema([("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
        out = pa.Table.from_pylist(found, schema=kinds)
        return out.add_column(0, "leaf", claims["digest"]).add_column(0, "doc_id", claims["doc_id"])

    return prove(passes, entry, claims.select("tree", "idx", "n", "doc_id", "digest", "claim"), fanout, height, (check, RESULT.format(kind)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each document; every seventh id by crc32 claims one character more than it has."""
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars").cast("decimal(38,0)") + 1).otherwise(F.col("n_chars").cast("decimal(38,0)"))
    return merkle_manifest(table(spark, sf_dir, "documents"), claim={"n_chars": more})
