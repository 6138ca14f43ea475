"""Substring dedup: words in a window of fixed length that also starts earlier in the corpus are removed.

Plan. Documents meet in groups of a hashed id, of about GROUP_BYTES each. A group hashes all its windows, keeps the
earliest of each (so a window that copies hold by the thousand leaves a group once), and sends sorted hashes by range
of the hash. In each range a window's earliest document over all groups is found; the answer to a group is the list of
its windows that start earlier elsewhere. The group, hashed again from the same exchange, removes those and its own
later repeats.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ranks import with_ties
from ._spark import partitions
from ._text import text_buffers, window_hashes, window_starts, word_hashes

#: Characters of text per group, and windows per range of hashes, about.
GROUP_BYTES = 8_000_000
RANGE_WINDOWS = 2_000_000
_FIRST, _NULL_TIE = -(2**63), -(2**62)

_SENT = "range int, g int, n int, hashes binary, checks binary, docs binary"
_ANSWER = "g int, range int, earlier binary"
OUT = "doc_id long, n_words long, n_removed long, intervals array<struct<start:long,end:long>>, kept_text string"


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype)


def _pack_sorted(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers: the three high bytes, which repeat, compressed by column, then the rest as it is."""
    planes = x.astype(">u8").view(np.uint8).reshape(-1, 8)
    high = zstandard.compress(planes[:, :3].T.tobytes(), 1)
    return len(high).to_bytes(4, "little") + high + planes[:, 3:].tobytes()


def _unpack_sorted(data: bytes, n: int) -> np.ndarray:
    size = int.from_bytes(data[:4], "little")
    planes = np.empty((n, 8), np.uint8)
    planes[:, :3] = np.frombuffer(zstandard.decompress(data[4 : 4 + size]), np.uint8).reshape(3, n).T
    planes[:, 3:] = np.frombuffer(data, np.uint8, offset=4 + size).reshape(n, 5)
    return planes.reshape(-1).view(">u8").astype(np.uint64)


def _pack_small(x: np.ndarray) -> bytes:
    """Small unsigned numbers: the low bytes as they are, the others, of few values, compressed."""
    planes = x.view(np.uint8).reshape(-1, x.itemsize)
    high = zstandard.compress(planes[:, 1:].T.tobytes(), 1)
    return x.itemsize.to_bytes(1, "little") + len(high).to_bytes(4, "little") + high + planes[:, 0].tobytes()


def _unpack_small(data: bytes) -> np.ndarray:
    width, size = data[0], int.from_bytes(data[1:5], "little")
    low = np.frombuffer(data, np.uint8, offset=5 + size)
    planes = np.empty((len(low), width), np.uint8)
    planes[:, 0] = low
    planes[:, 1:] = np.frombuffer(zstandard.decompress(data[5 : 5 + size]), np.uint8).reshape(width - 1, len(low)).T
    return planes.reshape(-1).view(np.uint16 if width == 2 else np.uint32)


class _Group:
    """The windows of a group's documents, in order of id (null first), then tie."""

    def __init__(self, table: pa.Table, width: int):
        ids = table["doc_id"].combine_chunks()
        null = np.array(ids.is_null())
        ids = np.array(ids.fill_null(_FIRST), np.int64)
        ties = np.array(table["tie"].combine_chunks(), np.int64)
        ties[null] += _NULL_TIE  # before a document that has the least id of all
        texts = table["text"].combine_chunks().fill_null("")
        order = np.lexsort((ties, ids))
        self.ids, self.ties, self.null = ids[order], ties[order], null[order]
        self.texts = texts.take(pa.array(order))
        words, self.offsets = word_hashes(*text_buffers(self.texts))
        self.starts, self.doc = window_starts(self.offsets, width)
        hashes = window_hashes(words, width)[self.starts] if len(self.starts) else np.zeros(0, np.uint64)
        checks = window_hashes(words, width, 1)[self.starts] if len(self.starts) else np.zeros(0, np.uint64)
        self.checks = (checks >> np.uint64(48)).astype(np.uint16)
        order = np.argsort(hashes, kind="stable")  # windows stand in order, so of equal ones the earliest comes first
        if len(order):
            h, c = hashes[order], self.checks[order]
            if np.any((h[1:] == h[:-1]) & (c[1:] != c[:-1])):
                order = np.lexsort((np.arange(len(hashes)), self.checks, hashes))
                h, c = hashes[order], self.checks[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        else:
            h, c, new = hashes, self.checks, np.zeros(0, bool)
        self.hashes, self.distinct_checks, self.earliest = h[new], c[new], order[new]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1  # of each window, which of the distinct ones it is

    def ranges(self, n: int) -> np.ndarray:
        """Where each of n equal ranges of hashes begins among the distinct ones."""
        edges = np.array([(i << 64) // n for i in range(n)], np.uint64)
        return np.append(np.searchsorted(self.hashes, edges), len(self.hashes))


def _send(width: int, n_ranges: int):
    def send(table: pa.Table) -> pa.Table:
        group, rows = _Group(table, width), []
        g = table["g"][0].as_py()
        at = group.ranges(n_ranges)
        for r in np.flatnonzero(np.diff(at)):
            a, b = at[r], at[r + 1]
            doc = group.doc[group.earliest[a:b]]
            used, doc = np.unique(doc, return_inverse=True)
            small = np.uint16 if len(used) < 65536 else np.uint32
            ids = _pack(group.ids[used])
            ties = _pack(group.ties[used]) if group.ties[used].any() else b""
            docs = len(ids).to_bytes(4, "little") + len(ties).to_bytes(4, "little") + ids + ties + _pack_small(doc.astype(small))
            rows.append((int(r), g, int(b - a), _pack_sorted(group.hashes[a:b]), group.distinct_checks[a:b].tobytes(), docs))
        names = [x.split()[0] for x in _SENT.split(", ")]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({k: pa.array(list(v), t) for k, v, t in zip(names, columns, kinds, strict=True)})

    return send


def _answer(table: pa.Table) -> pa.Table:
    """For each group that sent windows of this range: which of them start in an earlier document of another group."""
    hashes, checks, ids, ties, sizes = [], [], [], [], []
    for row in table.select(["n", "hashes", "checks", "docs"]).to_pylist():
        hashes.append(_unpack_sorted(row["hashes"], row["n"]))
        checks.append(np.frombuffer(row["checks"], np.uint16))
        docs, size, more = row["docs"], int.from_bytes(row["docs"][:4], "little"), int.from_bytes(row["docs"][4:8], "little")
        own = _unpack_small(docs[8 + size + more :])
        ids.append(_unpack(docs[8 : 8 + size], np.int64)[own])
        ties.append(_unpack(docs[8 + size : 8 + size + more], np.int64)[own] if more else None)
        sizes.append(row["n"])
    h, c, d = np.concatenate(hashes), np.concatenate(checks), np.concatenate(ids)
    if any(t is not None for t in ties):  # documents of one id: the place among all documents stands for the id
        t = np.concatenate([np.zeros(n, np.int64) if t is None else t for t, n in zip(ties, sizes, strict=True)])
        order = np.lexsort((t, d))
        step = (d[order][1:] != d[order][:-1]) | (t[order][1:] != t[order][:-1])
        d[order] = np.concatenate([[0], np.cumsum(step)])
    order = np.argsort(h, kind="stable")
    x, y = h[order], c[order]
    if np.any((x[1:] == x[:-1]) & (y[1:] != y[:-1])):
        order = np.lexsort((c, h))
        x, y = h[order], c[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    least = np.minimum.reduceat(d[order], np.flatnonzero(new))
    earlier = np.zeros(len(h), bool)
    earlier[order] = d[order] > least[np.cumsum(new) - 1]
    rows, at = [], 0
    for g, r, n in zip(table["g"].to_pylist(), table["range"].to_pylist(), sizes, strict=True):
        found = np.flatnonzero(earlier[at : at + n]).astype(np.uint32)
        at += n
        if len(found):
            rows.append((g, r, _pack(np.diff(found, prepend=np.uint32(0)).astype(np.uint32))))
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    kinds = [pa.int32(), pa.int32(), pa.binary()]
    return pa.table({k: pa.array(list(v), t) for k, v, t in zip(("g", "range", "earlier"), columns, kinds, strict=True)})


def _remove(width: int, n_ranges: int):
    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        group = _Group(left, width)
        at = group.ranges(n_ranges)
        elsewhere = np.zeros(len(group.hashes), bool)
        for r, packed in zip(right["range"].to_pylist(), right["earlier"].to_pylist(), strict=True):
            elsewhere[at[r] + np.cumsum(_unpack(packed, np.uint32), dtype=np.int64)] = True
        gone = np.ones(len(group.starts), bool)
        gone[group.earliest] = False
        gone |= elsewhere[group.number]
        edge = np.zeros(group.offsets[-1] + 1, np.int64)
        np.add.at(edge, group.starts[gone], 1)
        np.add.at(edge, group.starts[gone] + width, -1)
        covered = np.cumsum(edge[:-1]) > 0
        rows = []
        for i, text in enumerate(group.texts):
            a, b = group.offsets[i], group.offsets[i + 1]
            out = covered[a:b]
            words = text.as_buffer().to_pybytes().split()
            n_removed = int(out.sum())
            spans = []
            if n_removed:
                step = np.flatnonzero(np.diff(out.astype(np.int8), prepend=0, append=0))
                spans = [{"start": int(x), "end": int(y)} for x, y in step.reshape(-1, 2)]
                words = compress(words, ~out)
            doc_id = None if group.null[i] else int(group.ids[i])
            rows.append((doc_id, int(b - a), n_removed, spans, b" ".join(words).decode()))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
        names = ("doc_id", "n_words", "n_removed", "intervals", "kept_text")
        return pa.table({k: pa.array(list(v), t) for k, v, t in zip(names, columns, kinds, strict=True)})

    return remove


def dedup_substrings(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, intervals (maximal, of word numbers, end exclusive), kept_text (words by one space).

    A word goes if a window of width words covers it whose words also start earlier: in a document of smaller id, or
    before in the same document. Windows are judged on the input. Windows count as equal if 80 bits of two Rabin-Karp
    hashes agree. Null texts are empty, texts under width words keep all, very long ones are one document like others; a
    null id comes before all others; rows of one id are documents of their own, in the order of with_ties(), and lie in
    different groups. Other columns don't matter, whatever their names; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = with_ties(docs, "doc_id")
    sizes = docs.agg(F.sum(F.octet_length("text"))).first()
    total = sizes[0] or 0
    spark = docs.sparkSession
    n_groups = max(1, -(-total // GROUP_BYTES))
    n_ranges = max(partitions(spark), -(-total // (6 * RANGE_WINDOWS)))
    grouped = docs.withColumn("g", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(n_groups)).cast("int"))
    sent = grouped.groupBy("g").applyInArrow(_send(width, n_ranges), _SENT)
    answers = sent.groupBy("range").applyInArrow(_answer, _ANSWER)
    return grouped.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_remove(width, n_ranges), OUT)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's words, removed words and the digest of the kept ones."""
    d = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM k),
gone AS (SELECT doc_id, list(DISTINCT p + o) AS ps FROM r, range(0, 20) AS o(o) WHERE n > 1 GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(coalesce(ps, []))::BIGINT AS n_removed,
    list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(coalesce(ps, []), x[2])) AS left_over
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(list_transform(left_over, lambda x: x[1]), ' '), '')) AS kept_sha256 FROM kept
"""
