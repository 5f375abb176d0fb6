"""Merkle manifest of a dataset as a persistent, path-copying tree.

Each source's rows are the leaves of one tree, in the order of their doc_id,
and the sources' roots are the leaves of the top tree. A node's children are
runs of three; a digest is the SHA-256 of its children's hex digests one after
the other. Trees are worked out in aligned blocks of 3**4 places: a block's
root is a place of the next tier, until a tree has one block.

A leaf that was tampered with makes a version: its ancestors are copied with
new digests, and the version shares all other nodes with the base tree. A
block is told the siblings above it, so a version's copies go on through the
upper tiers where its leaf is, and no task gathers the versions of a tree.

Cases: a null field is ``-``; equal rows are leaves of their own; rows that
share a doc_id are ordered by their leaf, a null doc_id comes first and is
never tampered with; a null source is a source of its own, before all others;
a lone leaf is its source's root, a lone source's root the root; texts are
hashed whole in the JVM, whatever their length; columns besides the five are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import tables
from strataloom.operators.numbering import ranked

FAN, HEIGHT = 3, 4
#: Blocks whose nodes, with their whole paths, are held by a task at once.
AT_ONCE = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    """Lowercase hex SHA-256."""
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    """A field as it is hashed: ``-`` for null, else its bytes' count, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(documents: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered), staged: ``tampered`` is the leaf without line feeds in its text, null where nobody tampers."""
    hashed = lambda text: F.sha2(F.concat(*(field(text if c == "text" else F.col(c)) for c in FIELDS)), 256)
    bad = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), hashed(F.col("text")).alias("leaf"), F.when(bad, hashed(F.translate("text", "\n", ""))).alias("tampered"))
    return tables.staged(rows, "leaves")


def grown(nodes: list[str], n: int) -> list[list[str]]:
    """The levels of one block, from its nodes up; n: the nodes of the whole tree at the block's tier."""
    levels = [nodes]
    while n > 1 and len(levels) <= HEIGHT:
        n, below = -(-n // FAN), levels[-1]
        levels.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return levels


def in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``AT_ONCE`` blocks at most: a batch of Spark's may have thousands, each with 81 paths of 1.5 KB and more."""
    for batch in batches:
        yield from (batch.slice(at, AT_ONCE) for at in range(0, batch.num_rows, AT_ONCE))


def siblings(levels: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """Level by level, the digests left and right of a node's own in its run."""
    for level in levels[:-1]:
        run = at - at % FAN
        yield "".join(level[run:at]), "".join(level[at + 1 : run + FAN])
        at //= FAN


def copied(own: str, path: list[tuple[str, str]]) -> list[str]:
    """The digests of a leaf's ancestors, from its parent to the root."""
    out = []
    for left, right in path:
        out.append(own := digest(f"{left}{own}{right}"))
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """Rows of (tree, place, n, digest, further columns) as blocks: (tree, block, n, nodes), nodes in order."""
    rest = [c for c in rows.columns if c not in ("tree", "place", "n")]
    held = rows.groupBy("tree", F.expr(f"place div {FAN**HEIGHT}").alias("block"), "n").agg(F.array_sort(F.collect_list(F.struct("place", *rest))).alias("nodes"))
    return held.select("tree", "block", "n", *(F.col(f"nodes.{c}").alias(c) for c in rest))


def roots(held: DataFrame) -> DataFrame:
    """(tree, place, n, digest): every block's root as a node of the next tier."""

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            found = [grown(nodes, n)[-1][0] for nodes, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.string())], names=["tree", "place", "n", "digest"])

    found = held.select("tree", "block", "n", "digest").mapInArrow(climb, "tree string, place long, n long, digest string")
    return found.withColumn("n", F.expr(f"(n + {FAN**HEIGHT - 1}) div {FAN**HEIGHT}"))


def tiers(rows: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The staged tiers of blocks above nodes of (tree, place, n, digest), and the trees' roots (tree, digest)."""
    found = []
    while True:
        held = tables.staged(blocks(rows), "blocks")
        most = held.agg(F.max("n")).first()[0] or 1
        found.append(held)
        rows = roots(held)
        if most <= FAN**HEIGHT:
            return found, tables.staged(rows.select("tree", "digest"), "roots")


def paths(held: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, place, top, lefts, rights) of the nodes of a tier; above: the same columns of the tier over it."""

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            out: list[tuple] = []
            for tree, block, n, nodes, top, lefts, rights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                levels = grown(nodes, n)
                for at in range(len(nodes)):
                    own = list(siblings(levels, at))
                    out.append((tree, block * FAN**HEIGHT + at, top, [x for x, _ in own] + lefts, [x for _, x in own] + rights))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["tree", "place", "top", "lefts", "rights"])

    return under(held.select("tree", "block", "n", "digest"), above).mapInArrow(descend, "tree string, place long, top string, lefts array<string>, rights array<string>")


def under(held: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks beside the path of their root."""
    above = above.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), "top", "lefts", "rights")
    return held.join(above, held["tree"].eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_place"))).drop("_tree", "_place")


def manifest(documents: DataFrame) -> DataFrame:
    """A row for each leaf: (doc_id, source, place, leaf, tampered, subroot, root, siblings, copies).

    ``siblings``: from the leaf's run to the root, the digests beside its own.
    ``copies``: the digests of its ancestors as they are once the tampered leaf,
    if there is one, has taken the leaf's place; the last is that version's root.
    """
    rows = ranked(leaves(documents), ["doc_id", "leaf"], ["source"], "place", "n")
    low, subroots = tiers(rows.select(F.col("source").alias("tree"), "place", "n", F.col("leaf").alias("digest"), "doc_id", "tampered"))
    named = tables.staged(ranked(subroots.withColumnRenamed("tree", "source"), ["source"], [], "place", "n"), "subroots")
    high, root = tiers(named.select(F.lit(None).cast("string").alias("tree"), "place", "n", "digest"))
    none = F.array().cast("array<string>")
    above = root.select("tree", F.lit(0).cast("long").alias("place"), F.col("digest").alias("top"), none.alias("lefts"), none.alias("rights"))
    for held in reversed(high):
        above = paths(held, above)
    above = above.join(named.select("source", "place", "digest"), "place")
    above = above.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("place"), F.concat("digest", "top").alias("top"), "lefts", "rights")
    for held in reversed(low[1:]):
        above = tables.staged(paths(held, above), "paths")

    def versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            out: list[tuple] = []
            for tree, block, n, nodes, docs, tampered, top, lefts, rights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                levels, upper = grown(nodes, n), list(zip(lefts, rights, strict=True))
                for at, (leaf, doc, bad) in enumerate(zip(nodes, docs, tampered, strict=True)):
                    path = [*siblings(levels, at), *upper]
                    out.append((doc, tree, block * FAN**HEIGHT + at, leaf, bad, top[:64], top[64:], "".join(a + b for a, b in path), copied(bad or leaf, path)))
            kinds = (pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 5, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    names = ["doc_id", "source", "place", "leaf", "tampered", "subroot", "root", "siblings", "copies"]
    held = low[0].select("tree", "block", "n", "digest", "doc_id", "tampered")
    return under(held, above).mapInArrow(versions, "doc_id long, source string, place long, leaf string, tampered string, subroot string, root string, siblings string, copies array<string>")


def version_nodes(found: DataFrame) -> DataFrame:
    """(doc_id, source, level, digest): what the version of each leaf that changed copies; all other nodes are shared with the base tree."""
    own = found.filter("tampered <> leaf").select("doc_id", "source", F.concat(F.array("tampered"), F.col("copies")).alias("nodes"))
    return own.select("doc_id", "source", F.posexplode("nodes").alias("level", "digest"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and the root of its tampered version, of every document."""
    found = manifest(tables.table(spark, sf_dir, "documents"))
    folded = F.coalesce(F.element_at("copies", -1), "tampered", "leaf")
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), F.when(F.size("copies") > 0, folded).otherwise(F.coalesce("tampered", "leaf")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = """
with recursive d as (
  select doc_id, source, row_number() over (order by doc_id nulls first, leaf) as row, leaf, bad
  from (
    select doc_id, source, sha256(head || case when text is null then '-' else strlen(text) || ':' || text end) as leaf,
           case when text is not null then sha256(head || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')) end as bad
    from (
      select doc_id, source, text,
             coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
             || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as head
      from documents))),
bits as (select row, cast(ascii(substr(s, cast(p as int), 1)) as bigint) as byte, p, length(s) as n
  from (select row, cast(doc_id as varchar) as s from d where doc_id is not null), unnest(range(1, length(s) + 1)) u(p)),
step as (select i, 0 as k, i as v from range(256) r(i)
  union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from step where k < 8),
crctable as (select i, v from step where k = 8),
crc as (
  select row, 0 as p, n, cast(4294967295 as bigint) as c from bits where p = 1
  union all
  select c.row, c.p + 1, c.n, xor(c.c >> 8, t.v)
  from crc c join bits b on b.row = c.row and b.p = c.p + 1 join crctable t on t.i = xor(c.c, b.byte) & 255),
l as (
  select d.row, doc_id, source, leaf, case when xor(c, 4294967295) % 2 = 0 then bad end as tampered,
         row_number() over (partition by source order by d.row) - 1 as place, count(*) over (partition by source) as n
  from d left join crc on crc.row = d.row and crc.p = crc.n),
low as (
  select source, 0 as level, place, leaf as digest, n from l
  union all
  select source, level + 1, place // 3, sha256(string_agg(digest, '' order by place)), (n + 2) // 3
  from low where n > 1 group by source, level, place // 3, n),
subroots as (
  select source, digest as subroot, level as height, row_number() over (order by source nulls first) - 1 as place, count(*) over () as n
  from low where n = 1),
high as (
  select 0 as level, place, subroot as digest, n from subroots
  union all
  select level + 1, place // 3, sha256(string_agg(digest, '' order by place)), (n + 2) // 3
  from high where n > 1 group by level, place // 3, n),
top as (select digest as root from high where n = 1),
nodes as (
  select coalesce('s' || source, 'n') as tree, level, place, digest from low where n > 1
  union all select 't', level, place, digest from high where n > 1),
beside as (
  select a.tree, a.level, a.place, coalesce(string_agg(b.digest, '' order by b.place) filter (where b.place < a.place), '') as lefts,
         coalesce(string_agg(b.digest, '' order by b.place) filter (where b.place > a.place), '') as rights
  from nodes a join nodes b on b.tree = a.tree and b.level = a.level and b.place // 3 = a.place // 3
  group by a.tree, a.level, a.place),
fold as (
  select l.row, coalesce('s' || l.source, 'n') as tree, s.height, s.place as after, 0 as level, l.place, coalesce(l.tampered, l.leaf) as digest, '' as proof
  from l join subroots s on s.source is not distinct from l.source
  union all
  select f.row, case when f.tree <> 't' and f.level = f.height then 't' else f.tree end, f.height, f.after,
         case when f.tree <> 't' and f.level = f.height then 0 else f.level + 1 end,
         case when f.tree <> 't' and f.level = f.height then f.after else f.place // 3 end,
         case when f.tree <> 't' and f.level = f.height then f.digest else sha256(b.lefts || f.digest || b.rights) end,
         case when f.tree <> 't' and f.level = f.height then f.proof else f.proof || b.lefts || b.rights end
  from fold f left join beside b on b.tree = f.tree and b.level = f.level and b.place = f.place
  where b.tree is not null or (f.tree <> 't' and f.level = f.height)),
done as (select * from fold where tree = 't' and level = (select max(level) from high))
select l.doc_id, l.leaf, s.subroot, top.root, sha256(done.proof) as proof_sha256, done.digest as folded_root, done.digest = top.root as verified
from l join done on done.row = l.row join subroots s on s.source is not distinct from l.source cross join top
"""
