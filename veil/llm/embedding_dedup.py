"""Near-duplicate embeddings (operator 11): random-hyperplane signs in several tables, exact cosine, connected components.

1. Equal vectors are one: a table of distinct vectors with their number of rows (``weight``).
2. Every distinct vector gets one key of ``bits`` signs in each of several tables, and ``SKETCH`` more signs in two numbers. The number of bits
   grows with the logarithm of the vectors, so that unlike vectors fill a bucket with about ``bucket`` of them; the number of tables
   follows from it so that a pair at the least cosine meets in none of them with probability ``miss`` at most.
   A key row has ids and sketches only, so its size does not depend on the length of the vectors.
3. Tight groups. In the first ``LEADING`` tables, a bucket with more than ``CROWDED`` x ``bucket`` vectors names a leader, the mean of its members near the
   smallest one. Vectors that meet a leader in any table and lie within half the allowed angle of it form its group (each
   vector in one group): any two of them are linked, by the triangle inequality, without being compared. So a large
   group of near copies costs a comparison a member.
4. Units (groups, and vectors in none) that share a bucket are compared: first by the sketches (unlike pairs mostly end there, in the
   join; a pair at the limit does with a probability of about 1e-7), then, once a pair, by the exact cosine of vectors or leaders. A pair with a group that the
   triangle inequality leaves open is settled between members, in blocks of ``BLOCK``; these return sums and one link.
5. ``components`` runs over links between vectors; a group links its members to the smallest one.

Cosines are in double precision on vectors scaled to length one. Null and zero vectors and those with null or non-finite
entries have no links. Vectors of different lengths are never linked. Rows are judged one by one, also if they share an id or have
none; the component of a vector whose reachable ids are all null is null, and it is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm.common import written
from veil.llm.components import components
from veil.llm.vectors import finite, list_array, matrices

SKETCH = 128
LEADING = 2
CROWDED = 4
BLOCK = 256
SLACK = 1e-7  # degrees; far above the rounding of an angle, far below what matters
HASHED = "id bigint, unit array<double>, keys array<bigint>, sa bigint, sb bigint"


def plan_tables(n: int, least: float, bucket: int, miss: float) -> tuple[int, int]:
    """Bits a table and number of tables for ``n`` distinct vectors."""
    bits = max(1, math.ceil(math.log2(max(n, 2) / bucket)))
    meet = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-meet)))


@lru_cache(maxsize=4)
def _planes(d: int, bits: int, tables: int) -> np.ndarray:
    """The hyperplanes' normals as columns: for the sketch, then table by table."""
    return np.random.default_rng([11, d]).standard_normal((SKETCH + bits * tables, d)).T.copy()


def _hashed(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """``vectors``: id, vector. Without zero vectors."""

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, wide = 1 << np.arange(bits, dtype=np.int64), np.uint64(1) << np.arange(64, dtype=np.uint64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, raw in matrices(batch.column(1)):
                for first in range(0, len(at) if raw.shape[1] else 0, 2048):
                    x = raw[first:first + 2048].astype(np.float64)
                    top = np.abs(x).max(axis=1)
                    some = top > 0
                    x = x[some] / top[some][:, None]
                    x /= np.sqrt((x * x).sum(axis=1))[:, None]
                    over = x @ _planes(x.shape[1], bits, tables) > 0
                    keys = over[:, SKETCH:].reshape(len(x), tables, bits) @ powers + (np.arange(tables, dtype=np.int64) << bits)[None, :]
                    sketch = [(over[:, s:s + 64] @ wide).view(np.int64) for s in (0, 64)]
                    yield pa.RecordBatch.from_pydict({"id": pa.array(ids[at[first:first + 2048]][some]), "unit": list_array(x), "keys": list_array(keys), "sa": pa.array(sketch[0]), "sb": pa.array(sketch[1])})

    return vectors.mapInArrow(signs, HASHED)


def _apart(l: str, r: str) -> Column:  # noqa: E741
    """Sketch signs that differ."""
    return F.bit_count(F.col(f"{l}.sa").bitwiseXOR(F.col(f"{r}.sa"))) + F.bit_count(F.col(f"{l}.sb").bitwiseXOR(F.col(f"{r}.sb")))


def _allowed(angle: Column) -> Column:
    """Most differing sketch signs of two vectors at ``angle`` degrees, but for about one pair in 10^7."""
    share = F.least(angle, F.lit(90.0)) / 180.0
    return share * SKETCH + 5.5 * F.sqrt(share * (1 - share) * SKETCH)


def _cosine(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _degrees(cosine: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def _groups(hashed: DataFrame, bits: int, tables: int, angle: float, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Members (id, leader, off: degrees from the leader), and leaders (leader, unit, sa, sb)."""
    lead = hashed.select("id", "unit", "sa", "sb", F.explode(F.slice("keys", 1, LEADING)).alias("key"))
    crowded = lead.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("sa", "sb"), "id").alias("p")).where(F.col("n") > crowd)
    near = lead.alias("l").join(crowded.select("key", "p.sa", "p.sb").alias("r"), F.col("l.key") == F.col("r.key")).where(_apart("l", "r") <= _allowed(F.lit(angle)))
    means = near.select("l.key", F.size("l.unit").alias("d"), F.posexplode("l.unit").alias("at", "v")).groupBy("key", "d", "at").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("votes"))
    # A bucket may hold vectors of several lengths; the leader has the length with most of them.
    whole = means.groupBy("key", "d").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("vector"), F.first("votes").alias("votes"))
    best = whole.groupBy("key").agg(F.max_by(F.struct("vector", "votes"), F.struct("votes", "d")).alias("b"))
    named = written(best.select(F.col("key").alias("id"), "b.vector", "b.votes"), "leaders")
    leaders = written(_hashed(named.select("id", "vector"), bits, tables).join(named.select("id", "votes"), "id"), "hashed-leaders")
    offers = hashed.select("id", "sa", "sb", F.explode("keys").alias("key")).alias("l").join(
        leaders.select(F.col("id").alias("leader"), "sa", "sb", F.explode("keys").alias("key")).alias("r"), F.col("l.key") == F.col("r.key")).where(
        _apart("l", "r") <= _allowed(F.lit(angle / 2))).select("l.id", "leader").distinct()
    judged = offers.join(leaders.select(F.col("id").alias("leader"), F.col("unit").alias("u"), "votes"), "leader").join(hashed.select("id", "unit"), "id").select(
        "id", "leader", "votes", _degrees(_cosine("unit", "u")).alias("off")).where(F.col("off") <= angle / 2 - SLACK)
    members = written(judged.groupBy("id").agg(F.max_by(F.struct("leader", "off"), F.struct("votes", -F.col("leader"))).alias("m")).select("id", "m.leader", "m.off"), "members")
    return members, leaders.select(F.col("id").alias("leader"), "unit", "sa", "sb")


def _settled(near: DataFrame, units: DataFrame, sides: DataFrame, least: float) -> DataFrame:
    """Members of unit pairs in blocks: ``id, linked`` (rows linked to it), and ``other`` where one link stands for a block pair."""
    blocks = units.select(F.col("u"), F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int").alias("blocks"))
    counted = near.join(blocks.toDF("a", "na"), "a").join(blocks.toDF("b", "nb"), "b")
    mine = F.pmod(F.xxhash64("id"), F.col("own")).cast("int")
    left = counted.select(F.col("a").alias("u"), "a", "b", F.col("na").alias("own"), F.col("nb").alias("others")).join(sides, "u").select(
        "a", "b", mine.alias("x"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("y"), F.lit(0).alias("side"), "id", "weight", "unit")
    right = counted.select(F.col("b").alias("u"), "a", "b", F.col("nb").alias("own"), F.col("na").alias("others")).join(sides, "u").select(
        "a", "b", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("x"), mine.alias("y"), F.lit(1).alias("side"), "id", "weight", "unit")
    dealt = left.unionByName(right).repartition("a", "b", "x", "y").sortWithinPartitions("a", "b", "x", "y", "side", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list) -> tuple[list, list, list]:
            one, two = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
            if not one or not two:
                return [], [], []
            hit = np.array([r[3] for r in one]) @ np.array([r[3] for r in two]).T >= least
            gains = [*(hit @ np.array([r[2] for r in two])), *(hit.T @ np.array([r[2] for r in one]))]
            ids, others = [r[1] for r in one + two], [None] * len(rows)
            # Links of this block pair, enough to connect what they connect: each member to the first one it meets.
            for i in np.flatnonzero(hit.any(axis=1)):
                others[i] = two[int(hit[i].argmax())][1]
            for j in np.flatnonzero(hit.any(axis=0)):
                others[len(one) + j] = one[int(hit[:, j].argmax())][1]
            some = [k for k, g in enumerate(gains) if g]
            return [ids[k] for k in some], [int(gains[k]) for k in some], [others[k] for k in some]

        def out(found: list[tuple[list, list, list]]) -> pa.RecordBatch:
            ids, linked, others = ([v for f in found for v in f[c]] for c in range(3))
            return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "linked": pa.array(linked, pa.int64()), "other": pa.array(others, pa.int64())})

        key, rows = None, []
        for batch in batches:
            found = []
            plain = [c.to_pylist() for c in batch.columns[:-1]]
            units_ = batch.column(7).values.to_numpy(zero_copy_only=False) if batch.num_rows else None
            edges = np.asarray(batch.column(7).offsets)
            for k, (a, b, x, y, side, id_, weight) in enumerate(zip(*plain)):
                if (a, b, x, y) != key:
                    found.append(done(rows))
                    key, rows = (a, b, x, y), []
                rows.append((side, id_, weight, units_[edges[k]:edges[k + 1]]))
            yield out(found)
        yield out([done(rows)])

    return dealt.mapInArrow(compare, "id bigint, linked bigint, other bigint")


def near_embeddings(vectors: DataFrame, least: float = 0.9, bucket: int = 16, miss: float = 1e-4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row; links have a cosine of at least ``least``, which is positive."""
    angle = math.degrees(math.acos(least))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    sound = finite(F.col("vector"))
    known = rows.where(sound).groupBy("vector").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first"))
    distinct = written(known.select(F.monotonically_increasing_id().alias("id"), "vector", "weight", "first"), "distinct-vectors")
    bits, tables = plan_tables(distinct.count(), least, bucket, miss)
    hashed = written(_hashed(distinct.select("id", "vector"), bits, tables), "hashed-vectors")
    members, leaders = _groups(hashed, bits, tables, angle, CROWDED * bucket)
    weights = distinct.select("id", "weight", "first")

    # A group's unit is its leader's key, below zero.
    units_of = hashed.select("id", "unit", "sa", "sb", "keys").join(members, "id", "left").withColumn("u", F.coalesce(-1 - F.col("leader"), F.col("id")))
    sides = units_of.join(weights, "id").select("u", "id", "weight", "first", "unit")
    grouped = sides.where("u < 0").groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("rows"), F.min_by("id", F.struct(F.coalesce("first", F.lit((1 << 63) - 1)), "id")).alias("head"))
    radii = members.groupBy("leader").agg((F.max("off") + SLACK).alias("radius"))
    group_units = written(grouped.join(leaders.join(radii, "leader").withColumn("u", -1 - F.col("leader")), "u").select("u", "n", "rows", "head", "radius", "unit", "sa", "sb"), "groups")

    keyed = units_of.select("u", "sa", "sb", F.explode("keys").alias("key"))
    singles = keyed.where("u >= 0").select("key", "u", "sa", "sb", F.lit(0.0).alias("radius"))
    groups = keyed.where("u < 0").select("key", "u").distinct().join(group_units.select("u", "sa", "sb", "radius"), "u").select("key", "u", "sa", "sb", "radius")
    entries = singles.unionByName(groups)
    met = entries.alias("l").join(entries.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.u") < F.col("r.u")) & (_apart("l", "r") <= _allowed(F.col("l.radius") + F.col("r.radius") + angle)))
    pairs = met.select(F.col("l.u").alias("a"), F.col("r.u").alias("b")).distinct()
    of = units_of.where("u >= 0").select("u", F.lit(0.0).alias("radius"), "unit").unionByName(group_units.select("u", "radius", "unit"))
    cosines = pairs.join(of.toDF("a", "ra", "ua"), "a").join(of.toDF("b", "rb", "ub"), "b").select("a", "b", "ra", "rb", _cosine("ua", "ub").alias("c"))
    reach = F.col("ra") + F.col("rb") + angle
    close = F.when(F.col("a") >= 0, F.col("c") >= least).otherwise(_degrees(F.col("c")) <= reach + SLACK)  # a is the smaller one: a group, if any of the two is
    near = written(cosines.where(close).select("a", "b"), "near-units")

    plain = near.where("a >= 0")
    ends = plain.select("a", "b").unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b")))
    direct = ends.join(weights.select(F.col("id").alias("b"), "weight"), "b").groupBy("a").agg(F.sum("weight").alias("linked")).select(F.col("a").alias("id"), "linked")
    sizes = group_units.select("u", "n").unionByName(units_of.where("u >= 0").select("u", F.lit(1).cast("long").alias("n")))
    settled = written(_settled(near.where("a < 0"), sizes, sides.select("u", "id", "weight", "unit"), least), "settled")
    within = sides.where("u < 0").join(group_units.select("u", "rows", "head"), "u").select("id", "head", (F.col("rows") - F.col("weight")).alias("linked"))
    counts = direct.unionByName(settled.select("id", "linked")).unionByName(within.select("id", "linked")).groupBy("id").agg(F.sum("linked").alias("linked"))
    links = plain.unionByName(settled.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))).unionByName(
        within.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")))
    parts = components(links)
    whole = distinct.join(parts, "id", "left").join(counts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    zero = F.forall("vector", lambda v: v == 0)
    found = whole.join(smallest, "component").select("vector", F.when(zero, 0).otherwise(F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id", zero.alias("zero"))
    out = rows.withColumn("vector", F.when(sound, F.col("vector"))).join(found, "vector", "left")
    alone = F.coalesce("zero", F.lit(True))
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
