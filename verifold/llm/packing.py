"""Packing documents into sequences: shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._ranks import ranked
from ._spark import cut, lean
from ._text import mix, text_buffers

#: Tokens of a full sequence, and the id that ends every document.
SEQUENCE = 1024
END_ID = 0
#: Distinct units whose ids a process remembers, bytes of text that are encoded at once, units that the tokenizer is
#: given as one text, and units that it is given at once: what it returns takes some hundred bytes an id.
MEMO = 600_000
CHUNK = 1_000_000
RUN = 500
CALL = 10_000
#: A random factor for each byte that a unit may hold, and for each place of one among its first.
_BYTES, _PLACES = np.split(np.random.default_rng(7).integers(0, 2**63, 256 + 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1), [256])
#: White space of any kind, and more: a character that may be in one part with white space beside it; and all others.
_WIDE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}"
_WHITE, _BLACK = f"[{_WIDE}]", f"[^{_WIDE}]"
#: A unit that ends in a letter (of those that any version of Unicode has) or digit, then ASCII signs.
_SIGNED = r"(?s)^(?P<stem>.*[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}])(?P<signs>[!-/:-@\[-`{-~]+)\z"

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_encoders: dict[tuple[str, str], Encoder] = {}


def vocabulary(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """Where the public byte-level BPE vocabulary lies, and the pattern by which its tokenizer splits texts."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.PATTERN


class Encoder:
    """The ids that the tokenizer of a vocabulary file gives, without special tokens of its own.

    A byte-level BPE tokenizer splits texts at its special tokens and by its pattern, then encodes each part alone. A
    space or line end with no white space beside it always begins a part, and so do signs after a letter or digit. Texts
    are cut there into units, each distinct unit of a batch is encoded once, and a text's ids are those of its units.
    Texts that hold a special token or other white space beside a space are split by the pattern instead; no lookahead of
    it is lost: parts match the same alternative alone as in their text. Units are kept for later batches, in flat arrays.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        ends = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.ends = regex.compile(f"({ends})") if ends else None
        self.parts = regex.compile(pattern).findall
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)  # a character of a token's name is a byte
        for token, i in vocab.items():
            self.bytes[i] = len(token)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread would keep memory of its own
        self.known, self.ids, self.lengths = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int32)
        self.keys, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes of known, and whose they are

    def split(self, text: str) -> list[str]:
        if self.ends is None or not any(x in text for x in self.special):
            return self.parts(text)
        found = self.ends.split(text)  # specials have odd places
        return list(chain.from_iterable([x] if i % 2 else self.parts(x) for i, x in enumerate(found)))

    def each(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, end to end, and how many each has."""
        all_ids, all_lengths = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for first in range(0, len(units), CALL):
            ids = [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(units[first : first + CALL], add_special_tokens=False)]
            all_lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            all_ids += ids
        return np.concatenate(all_ids), np.concatenate(all_lengths)

    def joined(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of units that each begin with lone white space: encoded many at a time, then told apart by their bytes."""
        all_ids, all_lengths = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for first in range(0, len(units), CALL):
            part = units.slice(first, CALL)
            found, sizes = part.to_pylist(), np.asarray(pc.binary_length(part)).astype(np.int64)
            at = range(0, len(found), RUN)
            made = self.tokenizer.encode_batch_fast(["".join(found[i : i + RUN]) for i in at], add_special_tokens=False)
            for i, run in zip(at, made, strict=True):
                ids, ends = np.array(run.ids, "<u4"), np.cumsum(sizes[i : i + RUN])
                reached = np.cumsum(self.bytes[np.minimum(ids, len(self.bytes) - 1)])
                last = np.minimum(np.searchsorted(reached, ends), len(ids) - 1)
                if len(ids) and last[-1] == len(ids) - 1 and (reached[last] == ends).all():
                    lengths = np.diff(last, prepend=-1)
                else:  # a vocabulary whose ids don't tell their bytes
                    ids, lengths = self.each(found[i : i + RUN])
                all_ids.append(ids)
                all_lengths.append(lengths)
        return np.concatenate(all_ids), np.concatenate(all_lengths)

    def remembered(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """joined() of units that are not known from earlier batches. Known ones are found by their hashes, then compared:
        a table of all of them would be made anew for each batch."""
        keys, at = _hashes(units), np.full(len(units), -1, np.int64)
        place = np.searchsorted(self.keys, keys)
        hit = np.flatnonzero(place < len(self.keys))
        hit = hit[self.keys[place[hit]] == keys[hit]]
        same = pc.equal(self.known.take(pa.array(self.order[place[hit]])), units.take(pa.array(hit)))
        hit = hit[np.asarray(same, dtype=bool)]
        at[hit] = self.order[place[hit]]
        new = np.flatnonzero(at < 0)
        at[new] = len(self.known) + np.arange(len(new))
        fresh = units.take(pa.array(new))
        made, sizes = self.joined(fresh)
        ids, lengths = np.concatenate([self.ids, made]), np.concatenate([self.lengths, sizes.astype(np.int32)])
        found, reach = _gathered(ids, lengths, at)
        if len(lengths) > MEMO:  # only this batch's
            order = np.argsort(keys)
            self.known, self.ids, self.lengths = units, found, np.diff(reach).astype(np.int32)
            self.keys, self.order = keys[order], order.astype(np.int32)
        elif len(new):
            by_key = np.argsort(keys[new])
            where = np.searchsorted(self.keys, keys[new][by_key])
            self.order = np.insert(self.order, where, at[new][by_key].astype(np.int32))
            self.keys = np.insert(self.keys, where, keys[new][by_key])
            self.known, self.ids, self.lengths = pa.concat_arrays([self.known, fresh]), ids, lengths
        return found, np.diff(reach)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not texts:
            return []
        plain, (none, space) = pa.array(texts, pa.large_string()), (pa.scalar(x, pa.large_string()) for x in ("", " "))
        odd = np.array(pc.match_substring_regex(plain, f" {_WHITE}|{_WHITE} "))
        odd |= np.fromiter((any(x in text for x in self.special) for text in texts), bool, len(texts))
        plain = pc.replace_substring_regex(pc.if_else(pa.array(odd), none, plain), f"({_BLACK})\n({_BLACK})", "\\1 \n\\2")
        lists = pc.split_pattern(plain, " ")
        offsets = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        code, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        firsts = names.take(pa.array(code[offsets[:-1] - offsets[0]])).to_pylist()
        # first units and the parts of odd texts are encoded as they are, other units with the space or line end before them
        split = [self.split(text) if o else [first] for text, o, first in zip(texts, odd, firsts, strict=True)]
        whole = pa.array(list(chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        names = pc.if_else(pc.starts_with(names, "\n"), names, pc.binary_join_element_wise(space, names, none))
        # signs that end a unit are parts of their own
        cuts = pc.extract_regex(names, _SIGNED)
        stems = pc.coalesce(pc.struct_field(cuts, "stem"), names).dictionary_encode()
        signs = pc.coalesce(pc.struct_field(cuts, "signs"), none).dictionary_encode()
        sides = self.remembered(stems.dictionary), self.each(signs.dictionary.to_pylist()), self.each(whole.dictionary.to_pylist())
        pool, lengths = (np.concatenate(x) for x in zip(*sides, strict=True))
        both = np.column_stack([np.asarray(stems.indices), np.asarray(signs.indices) + np.int64(len(stems.dictionary))]).ravel()
        made, reach = _gathered(pool, lengths, both)
        lengths = np.concatenate([np.diff(reach[::2]), lengths[len(lengths) - len(whole.dictionary) :]])
        pool = np.concatenate([made, pool[len(pool) - lengths[len(names) :].sum() :]])
        # in the order of the texts
        counts = np.fromiter(map(len, split), np.int64, len(split))
        bounds = np.concatenate([[0], np.cumsum(counts + np.diff(offsets) - 1)])
        is_whole = np.zeros(bounds[-1], bool)
        is_whole[np.repeat(bounds[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())] = True
        tails = np.ones(len(code), bool)
        tails[offsets[:-1] - offsets[0]] = False
        units = np.empty(bounds[-1], np.int64)
        units[~is_whole] = code[tails]
        units[is_whole] = np.asarray(whole.indices).astype(np.int64) + len(names)
        ids, reach = _gathered(pool, lengths, units)
        return [ids[a:b] for a, b in zip(reach[bounds[:-1]], reach[bounds[1:]], strict=True)]


def _hashes(units: pa.Array) -> np.ndarray:
    """A 64-bit hash of each unit; bytes beyond the first 63 count in any order."""
    data, offsets = text_buffers(units)
    place = np.minimum(np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets)), len(_PLACES) - 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * _PLACES[place], dtype=np.uint64)])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def _gathered(pool: np.ndarray, lengths: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units, end to end, and where each begins and the last ends; pool has those of unit 0, 1, ... end to end."""
    n = lengths[units]
    reach = np.concatenate([[0], np.cumsum(n)])
    return pool[np.repeat((np.cumsum(lengths) - lengths)[units] - reach[:-1], n) + np.arange(reach[-1])], reach


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a vocabulary file, made once a process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def shortest_pack_first(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """[(count, lengths)]: packing patterns and how often each is used, from a histogram {length: count}.

    Lengths go longest first, each into the packs that are shortest so far and have room; a pattern of which only part
    gets the length splits in two. Lengths that fit nowhere open new packs.
    """
    by_room: dict[int, list[list]] = {}  # room left: [count, lengths]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(by_room, default=0)
            if room < length:
                by_room.setdefault(size - length, []).append([left, (length,)])
                break
            packs = by_room[room]
            count, lengths = packs.pop()
            if not packs:
                del by_room[room]
            used = min(count, left)
            if count > used:
                by_room.setdefault(room, []).append([count - used, lengths])
            by_room.setdefault(room - length, []).append([used, (*lengths, length)])
            left -= used
    return sorted(((count, lengths) for packs in by_room.values() for count, lengths in packs), key=lambda x: (x[1], x[0]), reverse=True)


def slots_of(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For every place in a pattern: its length, the first rank among pieces of that length that goes there, the
    sequence of that piece and the offset in it. Sorted by length and rank; patterns are bounded by the length range."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, offset))
            used[length] = rank + count
            offset += length
        sequence += count
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), columns.T, strict=True))


def _chunks(batch: pa.RecordBatch):
    """Slices of a batch with about CHUNK bytes of text, or one row."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch["text"]), 0)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        yield batch.slice(at, end - at)
        at = end


def _tokenize(path: str, pattern: str, size: int):
    def pieces(batches):
        encode = encoder(path, pattern).encode
        for batch in batches:
            for chunk in _chunks(batch):
                docs, starts, lengths, crcs, totals = [], [], [], [], []
                texts = [x or "" for x in chunk["text"].to_pylist()]
                for doc_id, ids in zip(chunk["doc_id"].to_pylist(), encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for at in range(0, len(ids), size):
                        piece = ids[at : at + size]
                        docs.append(doc_id)
                        starts.append(at)
                        lengths.append(len(piece))
                        crcs.append(zlib.crc32(piece.tobytes()))
                        totals.append(len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (docs, starts, lengths, crcs, totals)], names=[x.split()[0] for x in _PIECES.split(", ")]
                )

    return pieces


def pack_documents(docs: DataFrame, size: int = SEQUENCE, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents and their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its tokens and END_ID; what exceeds size is cut into full sequences and a rest, so very long texts are
    many pieces. A null or empty text is END_ID alone; repeated rows and null ids are documents of their own; other
    columns don't matter, whatever their names; an empty table gives no pieces. The histogram of lengths (size entries at
    most) goes to the driver; pieces find their pattern by their rank among pieces of their length, where ties are
    broken by their place in the written table.
    """
    default, pattern = vocabulary()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = docs.mapInArrow(lean(_tokenize(vocabulary_path or default, pattern, size)), _PIECES)
    pieces = cut(pieces.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slots_of(shortest_pack_first(histogram, size))
    base = max(histogram.values(), default=0) + 1
    keys = slots["length"] * base + slots["rank"]

    @F.arrow_udf(T.StructType().add("sequence_id", "long").add("offset", "long"))
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = np.asarray(length), np.asarray(rank)
        k = np.searchsorted(keys, length * base + rank, "right") - 1
        sequence = slots["sequence"][k] + rank - slots["rank"][k]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(slots["offset"][k])], ["sequence_id", "offset"])

    n = sum(histogram.values())
    placed = ranked(pieces, ["length"], F.col("_salt"), ["doc_id", "start", "_salt"], "_rank", n).withColumn("_at", place("length", "_rank"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_at.sequence_id", "_at.offset")


def op7_pack_sequences(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
