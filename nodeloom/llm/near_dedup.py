"""Near-duplicate documents by HyperMinHash.

A document's set holds the hashes of its word shingles. Each of 256 buckets of the hash space keeps, for the least hash
in it, the count of leading zeros and ten bits of mantissa: 16 bits a bucket. Empty buckets borrow another's register for
banding, by a fixed random probe order. Six registers make a band, 42 bands a document; documents that share a band are
candidates. A pair's Jaccard similarity is estimated from equal registers, less the collisions that compressed registers
are expected to have, and promising pairs are confirmed on the full sets.

At similarity 0.8 a link is missed by all bands with probability (1 - 0.8**6)**42 = 3e-6, less above. A link is a matter
between different texts: documents with equal sets are one class, and a class is one node. A band's group is not turned
into pairs. Its members are compared with the group's leader, the member with most company (all bands agree on that
order, so a large group has few leaders). What a member lacks of its leader and has beyond it is its difference. For two
members x, y of a leader L, with w = percent * |beyond| + 100 * |lacking|,

    x and y are linked      exactly if  (100 + percent) * |difference x & difference y| >= w(x) + w(y) - (100 - percent) * |L|
    x and L are linked      exactly if  w(x) <= (100 - percent) * |L|

so two members that are linked, but not both with their leader, must have part of their differences in common. Those
pairs are found by an exact prefix filter over the differences, their rarest elements first, and only for members that
are still in different components; no link between components is lost, whatever the group's size. Sets are made for
documents with company only: a bitmap of at most 8 MB keeps most others from being read into sets.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; with fewer words than a shingle
the whole sequence is the one shingle; documents that share an id are one node (their texts' links are joined); repeated
rows come back as often as they occur; a null id is linked with nothing and kept; very long texts are read whole, in
memory proportional to the longest; further columns, whatever their names, are ignored by :func:`near_duplicates` and
pass through :func:`deduplicate`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodeloom.llm.common import U64, Scratch, chunks, in_bitmap, key_bitmap, mix, partitions, shingles, slot, texts_of, unused, words
from nodeloom.llm.components import components

Kernel = Callable[[bytes, bytes, bool], tuple | None]
BUCKETS, MANTISSA, ROWS, BANDS = 256, 10, 6, 42
_EMPTY = np.uint16(0xFFFF)
#: For every bucket the order in which an empty one asks others.
_PROBES = np.random.default_rng(11).integers(0, BUCKETS, (BUCKETS, 48))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Of sorted distinct hashes: per bucket leading zeros (6 bits) and mantissa (10 bits) of the least one."""
    out = np.full(BUCKETS, _EMPTY, np.uint16)
    top = (hashes >> U64(56)).astype(np.int64)
    held, first = np.unique(top, return_index=True)
    rest = (hashes[first] << U64(8)) | U64(0x80)
    zeros = (63 - np.floor(np.log2(rest.astype(np.float64)))).clip(0, 62).astype(np.uint64)
    mantissa = (rest << (zeros + U64(1))) >> U64(64 - MANTISSA)
    out[held] = ((zeros << U64(MANTISSA)) | mantissa).astype(np.uint16)
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """n x BANDS keys of n x BUCKETS registers."""
    full = regs.astype(np.uint32) | (np.arange(BUCKETS, dtype=np.uint32) << np.uint32(16))
    hole = regs == _EMPTY
    for t in range(_PROBES.shape[1]):
        if not hole.any():
            break
        row, col = np.nonzero(hole)
        ask = _PROBES[col, t]
        good = regs[row, ask] != _EMPTY
        full[row[good], col[good]] = regs[row[good], ask[good]].astype(np.uint32) | (ask[good].astype(np.uint32) << np.uint32(16))
        hole[row[good], col[good]] = False
    if hole.any():  # very few registers: take the next one held
        for r in np.unique(np.nonzero(hole)[0]):
            held = np.flatnonzero(regs[r] != _EMPTY)
            col = np.flatnonzero(hole[r])
            ask = held[np.searchsorted(held, col) % len(held)]
            full[r, col] = regs[r, ask].astype(np.uint32) | (ask.astype(np.uint32) << np.uint32(16))
    key = np.zeros((len(regs), BANDS), U64)
    for k in range(ROWS):
        key = mix(key ^ full[:, k : BANDS * ROWS : ROWS].astype(U64) + U64(k + 1))
    return mix(key ^ (np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15)))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of register rows, corrected for registers that agree by chance."""
    either = (a != _EMPTY) | (b != _EMPTY)
    equal = ((a == b) & (a != _EMPTY)).sum(axis=1)
    chance = 2.0**-MANTISSA / 3
    return (equal / np.maximum(either.sum(axis=1), 1) - chance) / (1 - chance)


def _per_document(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for i, j, part, at in chunks(*texts_of(column)):
        _, _, row, hashed = words(part, at)
        found, begin = shingles(hashed, row, j - i, size)
        for k in range(j - i):
            yield np.unique(found[begin[k] : begin[k + 1]])


_SIGNATURE = "doc_id long, n long, digest binary, regs binary"
_SIGNATURE_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("regs", pa.binary())])


def _digest(s: np.ndarray) -> bytes:
    return np.array([np.bitwise_xor.reduce(mix(s)), s.sum(dtype=U64), U64(len(s))], U64).tobytes()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (shingles), digest (of the set), regs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, regs = [], [], []
            for s in _per_document(b.column(1), size):
                n.append(len(s))
                digest.append(_digest(s) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], schema=_SIGNATURE_ARROW)

    return docs.mapInArrow(run, _SIGNATURE)


def _with_bands(reps: DataFrame) -> DataFrame:
    """(node, doc_id, digest, regs) with the keys of the bands."""
    schema = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("regs", pa.binary()), ("bands", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                keys = bands(np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint16).reshape(-1, BUCKETS))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([row.tobytes() for row in keys], pa.binary())], schema=schema)

    return reps.mapInArrow(run, "node long, doc_id long, digest binary, regs binary, bands binary")


def _band_rows(reps: DataFrame, wanted: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """(band, node), of all bands or of those in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4000):
                part = b.slice(k, 4000)
                keys = np.frombuffer(b"".join(part.column(1).to_pylist()), U64)
                node = np.repeat(part.column(0).to_numpy(), BANDS)
                if wanted is not None:
                    use = in_bitmap(wanted[0], (keys >> U64(64 - wanted[1])).astype(np.int64))
                    keys, node = keys[use], node[use]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(node)], names=["band", "node"])

    return reps.select("node", "bands").mapInArrow(run, "band long, node long")


def _sets(docs: DataFrame, size: int, wanted: np.ndarray) -> DataFrame:
    """(digest, set) of those documents (at, text) whose bit ``at`` is set."""
    schema = pa.schema([("digest", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1).filter(pa.array(in_bitmap(wanted, b.column(0).to_numpy())))
            for k in range(0, len(text), 200):
                found = [s for s in _per_document(text.slice(k, 200), size) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "digest binary, data binary")


#: A leader whose band groups add up to more rows than this has its members in several parts.
_PART = 1024
_BESIDE = [("lead", pa.int64()), ("node", pa.int64()), ("degree", pa.int64()), ("more", pa.bool_())]


def _routes(pairs: DataFrame) -> DataFrame:
    """Where the data of pairs (lead, node, degree, more) go: members to parts of their leader, leaders to each part."""
    members = pairs.withColumn("part", F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("degree") / _PART)).cast("long")))
    leaders = members.select("lead", "part").distinct().select("lead", F.col("lead").alias("node"), "part", F.lit(0).alias("role"), F.lit(0).cast("long").alias("degree"), F.lit(False).alias("more"))
    return leaders.unionByName(members.withColumn("role", F.lit(1)))


def _beside_leader(rows: DataFrame, kernel: Kernel, fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """``kernel(leader's data, member's data, more)`` for the members among routed rows; None gives no row.

    A task reads each part as a stream behind its leader and holds one leader and one batch of members at a time.
    """
    arrow = pa.schema(_BESIDE + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held = last = None
        for b in batches:
            out = []
            for lead, part, role, node, degree, more, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if role == 0:
                    at, held, last = (lead, part), data, None
                elif at == (lead, part) and node != last:  # a class that several rows belong to may come as often
                    last = node
                    if (row := kernel(held, data, more)) is not None:
                        out.append((lead, node, degree, more, *row))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(arrow.types)], schema=arrow)

    rows = rows.select("lead", "part", "role", "node", "degree", "more", "data").repartition(partitions(rows.sparkSession), "lead", "part")
    return rows.sortWithinPartitions("lead", "part", "role", "node").mapInArrow(run, f"lead long, node long, degree long, more boolean{schema}")


def _promises(threshold: float) -> Kernel:
    """Whether a pair's estimate comes within six standard errors of the threshold; members of larger bands stay anyway."""

    def kernel(held: bytes, data: bytes, more: bool) -> tuple | None:
        a, b = np.frombuffer(held, np.uint16)[None, :], np.frombuffer(data, np.uint16)[None, :]
        used = max(1, int(((a != _EMPTY) | (b != _EMPTY)).sum()))
        return () if more or estimate(a, b)[0] >= threshold - 6 * np.sqrt(threshold * (1 - threshold) / used) else None

    return kernel


def _differences(percent: int) -> Kernel:
    """(weight, limit, difference): the pair is linked if weight <= limit; the difference is empty where nothing asks for it."""

    def kernel(held: bytes, data: bytes, more: bool) -> tuple:
        lead, own = np.frombuffer(held, U64), np.frombuffer(data, U64)
        place = np.minimum(np.searchsorted(lead, own), len(lead) - 1)
        both = lead[place] == own
        lacking = np.ones(len(lead), bool)
        lacking[place[both]] = False
        weight = percent * int((~both).sum()) + 100 * int(lacking.sum())
        return weight, (100 - percent) * len(lead), np.concatenate([own[~both], lead[lacking]]).view(np.int64) if more else np.zeros(0, np.int64)

    return kernel


class NearDuplicates:
    """Links of ``docs`` and what follows from them."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> None:
        self.size, self.percent = size, percent
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.scratch = Scratch(docs.sparkSession)
        keep = self.scratch.keep
        self.signs = keep(signatures(self.docs, size), "signatures")
        filled = self.signs.where("n > 0 AND doc_id IS NOT NULL")
        # classes of equal sets; their numbers are written before they are used
        classes = filled.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("regs").alias("regs"))
        classes = keep(_with_bands(classes.select(F.monotonically_increasing_id().alias("node"), "doc_id", "digest", "regs")), "classes")
        self.classes = classes.select("node", "doc_id", "digest")
        several = keep(filled.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("doc_id"), "several")
        own = filled.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "digest").join(self.classes, "digest")
        #: links between the classes of an id's texts
        same = own.groupBy("id").agg(F.min("node").alias("a")).join(own.select("id", F.col("node").alias("b")), "id").where("a <> b").select("a", "b").distinct()
        pairs = self._pairs(classes)
        deltas = self._compare(pairs, classes)
        links = keep(deltas.where("weight <= limit").select(F.col("lead").alias("a"), F.col("node").alias("b")).unionByName(same).distinct(), "links")
        found = keep(components(links, scratch=self.scratch), "components")
        more = self._rest(deltas, found)
        if not more.isEmpty():
            found = keep(components(links.unionByName(more), scratch=self.scratch), "components")
        # the smallest id of a component, by way of its classes
        named = self.classes.join(found, "node", "left").select("digest", "doc_id", F.coalesce("component", "node").alias("component"))
        least = keep(named.groupBy("component").agg(F.min("doc_id").alias("least")), "least")
        self.groups = keep(named.join(least, "component").select("digest", F.col("least").alias("group")), "groups")
        kept = [t for t in self.scratch.paths.values() if t is self.signs or t is self.groups]
        self.scratch.drop(*[t for t in self.scratch.paths.values() if not any(t is x for x in kept)])

    def _pairs(self, classes: DataFrame) -> DataFrame:
        """(lead, node, degree, more): each member of a band's group with the group's leader; more: there are further members."""
        keep = self.scratch.keep
        shared = keep(_band_rows(classes).groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
        wanted = key_bitmap(shared.select("band"), shared.count())
        members = keep(_band_rows(classes, wanted).join(shared, "band"), "members")
        degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
        leads = keep(members.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", "node")).alias("lead")), "leads")
        stars = members.join(leads, "band").where("node <> lead.node")
        pairs = stars.groupBy(F.col("lead.node").alias("lead"), "node").agg(F.max("lead.degree").alias("degree"), (F.max("size") > 2).alias("more"))
        return keep(pairs, "pairs")

    def _compare(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """(lead, node, degree, more, weight, limit, difference) of the promising pairs, from the full sets."""
        keep = self.scratch.keep
        rows = _routes(pairs).join(classes.select("node", F.col("regs").alias("data")), "node")
        pairs = keep(_beside_leader(rows, _promises(self.percent / 100), [], ""), "promising")
        routes = keep(_routes(pairs).join(classes.select("node", "doc_id", "digest"), "node"), "routes")
        asked = routes.select(F.xxhash64("doc_id").alias("key")).distinct()
        wanted, bits = key_bitmap(asked, asked.count())
        sets = _sets(self.docs.where("doc_id IS NOT NULL").select(slot(F.xxhash64("doc_id"), bits).alias("at"), "text"), self.size, wanted)
        fields = [("weight", pa.int64()), ("limit", pa.int64()), ("difference", pa.list_(pa.int64()))]
        return keep(_beside_leader(routes.join(sets, "digest"), _differences(self.percent), fields, ", weight long, limit long, difference array<long>"), "differences")

    def _rest(self, deltas: DataFrame, found: DataFrame) -> DataFrame:
        """Links (a, b) of members of a leader that are in different components so far.

        A pair needs R = weight + weight' - limit, over 100 + percent, elements in common, so R bounds its place in either
        difference once elements are ordered by rarity and those that no second member has are left out. One of the two
        is not linked with the leader: R is at least (100 + percent) / 100 * (weight - limit) for that one.
        """
        keep, full = self.scratch.keep, 100 + self.percent
        members = keep(deltas.where("more").join(found, "node", "left").select("lead", "node", "weight", "limit", "difference", F.coalesce("component", "node").alias("c")), "members")
        apart = members.groupBy("lead").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.col("weight") > F.col("limit")).alias("open")).where("lo < hi AND open")
        members = keep(members.join(keep(apart.select("lead"), "apart"), "lead", "left_semi"), "apart-members")
        each = members.select("lead", "node", F.explode("difference").alias("h")).select("lead", "node", F.xxhash64("lead", "h").alias("key"))
        common = keep(each.groupBy("key").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "common")
        elements = keep(each.join(common, "key"), "elements")
        held = elements.groupBy("lead", "node").agg((F.count(F.lit(1)) * full).alias("held"))
        able = keep(members.drop("difference").join(held, ["lead", "node"]).withColumn("over", F.col("weight") - F.col("limit")), "able")
        # what the best partner could hold beyond its own weight; what the least open member asks for
        best = keep(able.groupBy("lead").agg(F.max(F.col("held") - F.col("weight")).alias("best")), "best")
        able = able.join(best, "lead").where("over <= 0 OR (over <= best AND over <= held)")
        asks = keep(able.where("over > 0").groupBy("lead").agg(F.min("over").alias("asks")), "asks")
        need = F.when(F.col("over") > 0, F.col("over") * full / 100).otherwise(F.col("weight") + F.col("asks"))
        able = keep(able.join(asks, "lead").withColumn("need", need).where("held >= need").select("lead", "node", "weight", "limit", "c", "held", "need"), "able")
        order = Window.partitionBy("lead", "node").orderBy("f", "key")
        probes = elements.join(able, ["lead", "node"]).withColumn("slack", F.col("held") - (F.row_number().over(order) - 1) * full).where("slack >= need")
        probes = keep(probes.select("key", "lead", "node", "weight", "limit", "c", "slack"), "probes")
        other = probes.select("key", *[F.col(x).alias(f"{x}2") for x in ("lead", "node", "weight", "c", "slack")])
        near = (F.col("lead") == F.col("lead2")) & (F.col("c") < F.col("c2")) & (F.least("slack", "slack2") >= F.col("weight") + F.col("weight2") - F.col("limit"))
        pairs = probes.join(other, "key").where(near).groupBy("lead", F.col("node").alias("a"), F.col("node2").alias("b")).agg(F.first(F.col("weight") + F.col("weight2") - F.col("limit")).alias("need"))
        pairs = keep(pairs, "rest-pairs")
        sets = members.select("lead", "node", "difference")
        rows = pairs.join(sets.withColumnsRenamed({"node": "a", "difference": "da"}), ["lead", "a"]).join(sets.withColumnsRenamed({"node": "b", "difference": "db"}), ["lead", "b"])
        return keep(rows.where(F.size(F.array_intersect("da", "db")) * full >= F.col("need")).select("a", "b").distinct(), "rest-links")

    def membership(self) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id, kept."""
        rows = self.signs.select("doc_id", "n", "digest").join(self.groups, "digest", "left")
        component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("group", "doc_id"))
        rows = rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    return NearDuplicates(docs, id_col, text_col, size, percent).membership()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, all columns as they were."""
    dropped = near_duplicates(docs, id_col, text_col, size, percent).where("NOT kept").select(F.col("doc_id").alias(name := unused(docs, "dropped"))).distinct()
    return docs.join(dropped, docs[id_col].cast("long") == dropped[name], "left_anti")


#: Of the operator with two words a shingle: all pairs that share a shingle, and what they reach.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(t) < 2 THEN t ELSE list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS h FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, u.y FROM r JOIN u ON u.x = r.other)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1) c ON c.doc_id = n.doc_id
"""
