"""Exact dedup over a cuckoo-filter index of live digests.

Two texts are equal when they are identical after all whitespace is deleted. Their SHA-256 digests go through an index
(:class:`CuckooIndex`): a cuckoo filter of 16-bit fingerprints whose slots run parallel to buckets of stored digests.
A fingerprint hit is verified against the digest stored in that bucket, entries can be deleted, and an overflow doubles
the table and refills it from the stored digests.

The job folds each input task's rows through an index of its own first, so a digest that a third of all rows share
leaves a task once; the folded entries are dealt out by digest and pass a second index. Only (digest, doc_id) rows meet
the result again, in a join that adaptive execution can split where a digest is hot.

Defined cases: null text counts as empty, and all texts without other characters are equal; of equal texts the one with
most code points stays, then the smallest doc_id, a null doc_id last; repeated rows are returned as often as they occur
with the same values, and :func:`deduplicate` keeps one row of those that agree in id and group and are equally long;
very long texts are hashed whole; an empty table gives an empty result; other columns, whatever their names, pass
through :func:`deduplicate` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import SPACES, no_nulls, partitions, unused


class CuckooIndex:
    """Cuckoo filter with buckets of stored keys. ``get``/``put``/``delete`` take 32-byte digests."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 256) -> None:
        self.buckets = 1 << max(1, (buckets - 1).bit_length())
        self.size = self.resizes = 0
        self._clear()

    def _clear(self) -> None:
        n = self.buckets * self.SLOTS
        self.prints = [0] * n  # the filter; 0 is free
        self.keys: list[bytes | None] = [None] * n  # bucketed content
        self.values: list[Any] = [None] * n

    def _places(self, key: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(key[:8], "little")
        mark = (h >> 48) or 1
        one = h & (self.buckets - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & (self.buckets - 1))

    def _slot(self, key: bytes) -> int:
        mark, one, two = self._places(key)
        for b in (one, two):
            for s in range(b * 4, b * 4 + 4):
                if self.prints[s] == mark and self.keys[s] == key:  # a hit counts only once the stored key agrees
                    return s
        return -1

    def __contains__(self, key: bytes) -> bool:
        return self._slot(key) >= 0

    def __len__(self) -> int:
        return self.size

    def get(self, key: bytes) -> Any:
        s = self._slot(key)
        return None if s < 0 else self.values[s]

    def put(self, key: bytes, value: Any) -> None:
        s = self._slot(key)
        if s >= 0:
            self.values[s] = value
            return
        self.size += 1
        while (left := self._insert(key, value)) is not None:
            key, value = left
            self._resize()

    def _insert(self, key: bytes, value: Any) -> tuple[bytes, Any] | None:
        """None, or the entry left over when the kicks ran out."""
        mark, one, two = self._places(key)
        for b in (one, two):
            for s in range(b * 4, b * 4 + 4):
                if not self.prints[s]:
                    self.prints[s], self.keys[s], self.values[s] = mark, key, value
                    return None
        b = two
        for kick in range(self.KICKS):
            s = b * 4 + (kick + mark) % 4
            mark, self.prints[s] = self.prints[s], mark
            key, self.keys[s] = self.keys[s], key
            value, self.values[s] = self.values[s], value
            b = self._other(b, mark)
            for s in range(b * 4, b * 4 + 4):
                if not self.prints[s]:
                    self.prints[s], self.keys[s], self.values[s] = mark, key, value
                    return None
        return key, value

    def _resize(self) -> None:
        """Twice the buckets, refilled from the stored keys."""
        held = list(self.items())
        while True:
            self.buckets *= 2
            self.resizes += 1
            self._clear()
            if all(self._insert(k, v) is None for k, v in held):
                return

    def delete(self, key: bytes) -> bool:
        s = self._slot(key)
        if s < 0:
            return False
        self.prints[s], self.keys[s], self.values[s] = 0, None, None
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, Any]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


_FOLDED = "digest binary, chars long, keep long, members long"
_SCHEMA = pa.schema([("digest", pa.binary()), ("chars", pa.int64()), ("keep", pa.int64()), ("members", pa.int64())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (digest, chars, keep, members) merged by digest: most characters, then the smallest id, null last."""
    index = CuckooIndex()
    for batch in batches:
        for digest, chars, keep, members in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            held = index.get(digest)
            if held is None:
                index.put(digest, (chars, keep, members))
            else:
                better = (-chars, keep is None, keep or 0) < (-held[0], held[1] is None, held[1] or 0)
                index.put(digest, ((chars, keep) if better else held[:2]) + (held[2] + members,))
    entries = list(index.items())
    for i in range(0, len(entries), 20_000):
        part = entries[i : i + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([k for k, _ in part], *([v[j] for _, v in part] for j in range(3))), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def normalized(text: F.Column) -> F.Column:
    return F.translate(text, SPACES, "")


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(normalized(no_nulls(text_col)), 256).alias("text_sha256"), F.char_length(no_nulls(text_col)).cast("long").alias("chars"))
    entries = rows.select(F.unhex("text_sha256").alias("digest"), "chars", F.col("doc_id").alias("keep"), F.lit(1).cast("long").alias("members")).mapInArrow(_fold, _FOLDED)
    groups = entries.repartition(partitions(docs.sparkSession), "digest").mapInArrow(_fold, _FOLDED)
    groups = groups.select(F.lower(F.hex("digest")).alias("text_sha256"), F.col("chars").alias("keep_chars"), F.col("keep").alias("keep_id"), F.col("members").alias("group_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return rows.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "chars")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return _groups(docs, id_col, text_col).drop("chars")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were; of rows that repeat both id and text one stays."""
    found = _groups(docs, id_col, text_col)
    own, sha, chars = (unused(docs, f"dedup_{x}") for x in ("id", "sha", "chars"))
    keys = docs.withColumns({own: F.col(id_col).cast("long"), sha: F.sha2(normalized(no_nulls(text_col)), 256), chars: F.char_length(no_nulls(text_col)).cast("long")})
    # a row that stays has, of its group, a length or an id that no dropped row has
    dropped = found.where("NOT kept").select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("s"), F.col("chars").alias("n"))
    out = keys.join(dropped, keys[own].eqNullSafe(dropped["i"]) & (keys[sha] == dropped["s"]) & (keys[chars] == dropped["n"]), "left_anti")
    repeated = found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("s"))
    if repeated.isEmpty():
        return out.drop(own, sha, chars)
    same = out[own].eqNullSafe(repeated["i"]) & (out[sha] == repeated["s"])
    again = out.join(repeated, same, "left_semi").dropDuplicates([own, sha])
    return out.join(repeated, same, "left_anti").unionByName(again).drop(own, sha, chars)


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(chars) OVER w AS keep_chars,
             count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND chars = keep_chars AS kept, text_sha256 FROM g
"""
