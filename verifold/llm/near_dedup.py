"""Near-duplicate classes by BagMinHash over multisets of word shingles.

Signatures. A shingle of count c has a Poisson process for each dyadic interval of weight levels (0,1], (1,2], (2,4], ...
up to c. Its points come in order of time at a rate of m times the interval's width; each has a uniform component of
the signature and, in the last interval, a uniform level: points above c don't count. A component is the point of
least time of all shingles, so two multisets agree in it with the probability of their weighted Jaccard similarity.
Processes stop at the largest time in the signature so far, so a text costs about its shingles and m log m points.

Classes. Equal texts are one node. Bands of the signature put nodes into buckets. First the members of a bucket are
held against one leader, the member that meets most others, exactly, by the overlap of their multisets: that joins most
near copies. Then the members of buckets that still hold several classes meet in blocks of BLOCK by BLOCK, where all
pairs of different classes are compared, each in the first band that it shares, and only links that join classes leave
the block: no link that a band found is lost, and no pairs are emitted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Positional, cut, lean
from ._text import mix, text_buffers, window_hashes, window_starts, word_hashes

WIDTH = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 4
#: Members of a bucket that meet in one block.
BLOCK = 512


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The text index and hash of each shingle; a text of fewer words is one shingle, one without words has none."""
    words, offsets = word_hashes(*text_buffers(texts))
    starts, text = window_starts(offsets, width)
    full = window_hashes(words, width)
    hashes = full[starts] if len(starts) else np.zeros(0, np.uint64)
    counts = np.diff(offsets)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        folded = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            folded[has] = mix(folded[has] ^ words[offsets[short[has]] + k], k + 3)
        text, hashes = np.concatenate([text, short]), np.concatenate([hashes, folded])
    return text, hashes


def multiset(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (text, hash) and how often each occurs."""
    key = mix(hashes ^ mix(text.astype(np.uint64), 11), 12)
    order = np.argsort(key)
    sorted_key = key[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return text[order][first], hashes[order][first], np.diff(np.append(first, len(key)))


def signatures(text: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """The BagMinHash signature of each text: m numbers that name the winning points (0 where a text has no shingles)."""
    # one process for each dyadic interval up to the count
    top = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64)  # intervals besides (0, 1]
    owner = np.repeat(np.arange(len(counts)), top + 1)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    width = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0))
    below = np.where(level == 0, 0, width)
    share = np.minimum((counts[owner] - below) / width, 1.0)
    doc = text[owner]
    seed = mix(hashes[owner] ^ mix(level.astype(np.uint64), 21), 22)
    rate = width.astype(np.float64) * m
    time = np.zeros(len(owner))
    best = np.full(n_texts * m, np.inf)
    names = np.zeros(n_texts * m, np.uint64)
    limit = np.full(n_texts, np.inf)
    step = 0
    while len(owner):
        k = max(1, min(64, 200_000 // len(owner)))  # points of each process at once
        draw = mix(seed[:, None] ^ mix(np.arange(step, step + k, dtype=np.uint64), 23)[None, :], 24)
        gaps = -np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate[:, None]
        times = time[:, None] + np.cumsum(gaps, 1)
        other = mix(draw, 25)
        slot = doc[:, None] * m + ((other & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        counts_in = ((other >> np.uint64(32)).astype(np.float64) * 2.0**-32 < share[:, None]) & (times < limit[doc][:, None])
        slot, at, name = slot[counts_in], times[counts_in], draw[counts_in]
        np.minimum.at(best, slot, at)
        won = best[slot] == at
        names[slot[won]] = name[won]
        time = times[:, -1]
        live = np.unique(doc)
        limit[live] = best.reshape(n_texts, m)[live].max(1)
        go = time < limit[doc]
        doc, seed, rate, share, time, owner = doc[go], seed[go], rate[go], share[go], time[go], owner[go]
        step += k
    return names.reshape(n_texts, m)


def band_keys(names: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each signature, different for different bands."""
    key = np.zeros((len(names), bands), np.uint64) + mix(np.arange(bands, dtype=np.uint64), 31)[None, :]
    parts = names.reshape(len(names), bands, rows)
    for r in range(rows):
        key = mix(key ^ parts[:, :, r], 32 + r)
    return key


def _pieces(batch: pa.RecordBatch, column: str, limit: int = 1_000_000):
    """Slices of a batch with about so many bytes of text: what is computed on one takes some dozens of times that."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0))
    at = 0
    ends = np.cumsum(sizes)
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


_SIGNED = "doc_id long, node binary, n long, bands array<long>"


def _sign(width: int, bands: int, rows: int):
    def sign(batches):
        for batch in batches:
            for piece in _pieces(batch, "text"):
                text, hashes = shingles(piece["text"], width)
                n = np.bincount(text, minlength=piece.num_rows)
                names = signatures(*multiset(text, hashes), piece.num_rows, bands * rows)
                keys = band_keys(names, bands, rows).view(np.int64)
                has = n > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[has].ravel()))
                yield pa.RecordBatch.from_arrays([piece["doc_id"], piece["node"], pa.array(n.astype(np.int64)), lists], names=["doc_id", "node", "n", "bands"])

    return sign


_FEATURES = "node binary, n long, bands array<long>, grams binary"


def _features(width: int):
    """Adds the multiset of each text as sorted numbers: the k-th occurrence of a shingle has a number of its own."""

    def make(batches):
        for batch in batches:
            for piece in _pieces(batch, "text"):
                text, hashes, counts = multiset(*shingles(piece["text"], width))
                owner = np.repeat(np.arange(len(counts)), counts)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                grams = np.where(nth == 0, hashes[owner], mix(hashes[owner] ^ mix(nth.astype(np.uint64), 41), 42))
                order = np.lexsort((grams, text[owner]))
                grams, ends = grams[order], np.cumsum(np.bincount(text[owner], minlength=piece.num_rows))
                held = [g.tobytes() for g in np.split(grams, ends[:-1])] if piece.num_rows else []
                yield pa.RecordBatch.from_arrays([piece["node"], piece["n"], piece["bands"], pa.array(held, pa.binary())], names=["node", "n", "bands", "grams"])

    return make


def similarity_of(x: np.ndarray, y: np.ndarray) -> float:
    """The weighted Jaccard similarity of two multisets as _features() writes them."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def _verify(similarity: float):
    def verify(batches):
        for batch in batches:
            left = [np.frombuffer(g.as_buffer(), np.uint64) for g in batch["grams_a"]]
            right = [np.frombuffer(g.as_buffer(), np.uint64) for g in batch["grams_b"]]
            alike = pa.array([similarity_of(x, y) >= similarity for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(alike), batch["b"].filter(alike)], names=["a", "b"])

    return verify


def overlap_matrix(grams: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two of the sets share, by products of column blocks; numbers that only one set has don't count."""
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    _, column, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(grams), len(grams)), np.float32)
    for at in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        x = np.zeros((len(grams), 4096), np.float32)
        x[owner[a:b], column[a:b] - at] = 1
        out += x @ x.T
    return out


def links_in(rows: list[dict], similarity: float) -> list[tuple[bytes, bytes]]:
    """Links among the rows of one block or between those of two, as many as join their classes.

    A pair counts in the first band that it shares, between different classes so far, if its sizes allow the similarity.
    """
    n = np.array([r["n"] for r in rows])
    bands = np.array([r["bands"] for r in rows], np.int64)
    own = np.array([r["own"] for r in rows])
    _, label = np.unique(np.array([r["label"].hex() for r in rows]), return_inverse=True)
    open_pairs = np.triu(label[:, None] != label[None], 1)
    if rows[0]["bi"] != rows[0]["bj"]:
        open_pairs &= own[:, None] != own[None]
    open_pairs &= np.minimum(n[:, None], n[None]) >= similarity * np.maximum(n[:, None], n[None])
    for j in range(int(np.flatnonzero(bands[0] == rows[0]["key"])[0])):
        if not open_pairs.any():
            return []
        open_pairs &= bands[:, j][:, None] != bands[:, j][None]
    xs, ys = np.nonzero(open_pairs)
    if not len(xs):
        return []
    grams = [np.frombuffer(r["grams"], np.uint64) for r in rows]
    if len(xs) < 4 * len(rows):
        alike = np.array([similarity_of(grams[x], grams[y]) >= similarity for x, y in zip(xs, ys, strict=True)])
    else:
        both = overlap_matrix(grams)[xs, ys].astype(np.float64)
        alike = both >= similarity * (n[xs] + n[ys] - both)
    parent = np.arange(label.max() + 1)

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for x, y in zip(xs[alike], ys[alike], strict=True):
        a, b = top(label[x]), top(label[y])
        if a != b:
            parent[a] = b
            found.append(tuple(sorted((rows[x]["node"], rows[y]["node"]))))
    return found


def _link_blocks(similarity: float):
    """Over rows sorted by (key, bi, bj): the links of each such group; a group may go over several batches."""

    def link(batches):
        held: list[dict] = []
        group = None
        for batch in batches:
            found = []
            for first in range(0, batch.num_rows, 256):  # rows become Python objects a few at a time
                for row in batch.slice(first, 256).to_pylist():
                    at = (row["key"], row["bi"], row["bj"])
                    if at != group:
                        if len(held) > 1:
                            found += links_in(held, similarity)
                        held, group = [], at
                    held.append(row)
            yield _edges(found)
        yield _edges(links_in(held, similarity) if len(held) > 1 else [])

    return link


def _edges(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of each node of the written table edges (a, b).

    Labels spread along edges by minimum, then each label takes its own label, until nothing changes: the rounds grow
    with the logarithm of the longest path. Every round is written, so none depends on the lineage of earlier ones.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
    labels = cut(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("label")))
    while True:
        heard = both.join(labels, "node").select(F.col("to").alias("node"), "label")
        spread = heard.unionByName(labels).groupBy("node").agg(F.min("label").alias("new"))
        nxt = spread.join(labels.select(F.col("node").alias("new"), F.col("label").alias("further")), "new")
        nxt = cut(nxt.join(labels, "node").select("node", F.least("new", "further").alias("label"), (F.least("new", "further") != F.col("label")).alias("_moved")))
        labels = nxt.drop("_moved")
        if nxt.where("_moved").isEmpty():
            return labels


def _key(id_col: str) -> F.Column:
    """The id as a key that is never null."""
    return F.coalesce(F.col(id_col), F.lit(-(2**63))).alias("key")


def classes(
    docs: DataFrame,
    width: int = WIDTH,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, node (the digest of the text), class_id (the least doc_id of the class), class_node (the least node of the
    class) for every row.

    Rows of equal text are in one class, and so are rows whose multisets of width-word shingles have a weighted Jaccard
    similarity of at least similarity, and rows that such links join. A null text counts as empty; texts without words
    are only like each other if equal; texts of fewer than width words are one shingle. Null ids stay null; class_id is
    the least of the others, null if there is none. Rows that repeat, or share an id, each have their row; very long texts
    are read whole; other columns don't matter, whatever their names; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("node"), text.alias("text"))
    signed = cut(source.mapInArrow(lean(_sign(width, bands, rows)), _SIGNED))
    nodes = cut(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("bands").alias("bands")))

    band = nodes.select("node", "n", F.explode("bands").alias("key"))
    # sums that are joined back are written first: the join then reads two plain exchanges, whose hot keys Spark can split
    sizes = cut(band.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    member = cut(band.join(sizes, "key"))
    central = cut(member.groupBy("node").agg(F.sum("members").alias("central")))
    member = cut(member.join(central, "node"))  # key, node, n, members, central

    # one text per node, that of its least id: the id is part of the key, so the copies of a text are spread
    reps = nodes.select("node", _key("rep"), "n", "bands").join(central.select("node"), "node")
    once = source.select("node", _key("doc_id"), "text").dropDuplicates(["node", "key"])  # rows of one text and id leave a task once
    features = cut(once.join(reps, ["node", "key"]).select("node", "n", "bands", "text").mapInArrow(lean(_features(width)), _FEATURES))

    rank = F.struct("central", "node")
    leaders = cut(member.groupBy("key").agg(F.max(rank)["node"].alias("leader"), F.max_by("n", rank).alias("leader_n")))
    alike = F.least("n", "leader_n") >= similarity * F.greatest("n", "leader_n")  # no similarity exceeds the ratio of sizes
    pairs = member.join(leaders, "key").where((F.col("node") != F.col("leader")) & alike)
    pairs = cut(pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
    side = lambda x: features.select(F.col("node").alias(x), F.col("grams").alias(f"grams_{x}"))
    edges = cut(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "grams_a", "grams_b").mapInArrow(lean(_verify(similarity)), "a binary, b binary"))
    labels = components(edges)

    labelled = cut(member.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    split = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    split = cut(split.where("low <> high").select("key", blocks.alias("blocks")))
    live = labelled.join(split, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    live = live.select("key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "node", "label")
    dealt = live.join(features, "node").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    more = cut(dealt.mapInArrow(lean(_link_blocks(similarity)), "a binary, b binary").distinct())
    if not more.isEmpty():
        labels = components(cut(edges.unionByName(more)))

    members = cut(nodes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    least = cut(members.groupBy("label").agg(F.min("rep").alias("class_id")))
    named = members.join(least, "label").select("node", "class_id", F.col("label").alias("class_node"))
    return signed.select("doc_id", "node").join(named, "node").select("doc_id", "node", "class_id", "class_node")


def near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """doc_id, class_id of every row of docs: see classes() for what joins a class, its defined cases and the parameters."""
    return classes(docs, **params).select("doc_id", "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One row of docs per class: of its least id (null only if it has no other); if rows of that id differ in text, of
    the text of least digest; of rows that repeat both, any one.

    Null and empty texts are one class, of which one row stays; very long texts are compared whole; an empty table gives
    an empty result; docs' columns stay as they are, whatever their names.
    """
    p = Positional(docs)
    inner, text = p.name(id_col), p.name(text_col)
    found = classes(p.df, id_col=inner, text_col=text, **params)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), _key("doc_id"), "node"))
    kept = found.groupBy("class_node").agg(first.alias("first")).select("first.node", "first.key")
    node = F.unhex(F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")))
    rows = p.df.withColumn("node", node).withColumn("key", F.coalesce(F.col(inner).cast("long"), F.lit(-(2**63))))
    return p.restore(rows.dropDuplicates(["node", "key"]).join(kept, ["node", "key"], "left_semi"))


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, and whether it is the one to keep."""
    d = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return d.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
