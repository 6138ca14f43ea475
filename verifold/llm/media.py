"""Media columns: HTML becomes ordered text and media references, and digests resolve the references to stored payloads."""

from __future__ import annotations

import base64
import binascii
import hashlib
import zlib
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._markup import BLOCK_TAGS, attributes, closes_itself, events
from ._spark import Positional, cut

#: Samples in a row of a stored image.
WIDTH = 64
_STRINGS = ("kind", "text", "source", "digest", "caption")
PARTS = T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), *[T.StructField(x, T.StringType()) for x in _STRINGS]]))
_PARTS_ARROW = pa.list_(pa.struct([("position", pa.int32()), *[(x, pa.string()) for x in _STRINGS]]))
#: Sources of media references to the store are written as this scheme and the hex digest of the stored form.
SCHEME = "sha256:"
_MEDIA_TAGS = frozenset("img audio video source embed".split())


def _digest(source: str) -> str | None:
    """The digest that a source names, or that of the bytes that it holds; None if it is an address."""
    if source[: len(SCHEME)].lower() == SCHEME:
        return source[len(SCHEME) :].strip().lower()
    if source[:5].lower() == "data:" and "," in source:
        head, data = source[5:].split(",", 1)
        raw = unquote_to_bytes(data)
        if head.lower().endswith(";base64"):
            try:
                raw = base64.b64decode(raw + b"=" * (-len(raw) % 4))
            except (binascii.Error, ValueError):
                return None
        return hashlib.sha256(raw).hexdigest()
    return None


def _sources(tag: str, attrs: dict[str, str]) -> list[str]:
    """What an element refers to: its source (or the first of a set), and a video's poster."""
    source = attrs.get("src") or attrs.get("data-src") or next(iter((attrs.get("srcset") or "").split()), "").rstrip(",")
    return [x for x in (source, attrs.get("poster") if tag == "video" else None) if x]


def parse_parts(html: str | None) -> list[dict]:
    """The ordered parts of one page: text blocks, and media references with their captions.

    A caption is what the figcaption of the innermost figure around a reference says, or else its alt or title; one that
    never closes ends with its figure. What a figcaption says in a figure without media is text. Every reference has its
    source as written; digest is null where that is only an address.
    """
    parts: list[dict] = []
    said: list[str] = []
    figures: list[tuple[list[dict], list[str]]] = []  # open figures: their media, and what their captions say
    captions = 0  # open figcaptions of the innermost figure

    def flush() -> None:
        text = " ".join("".join(said).split())
        said.clear()
        if text:
            parts.append({"kind": "text", "text": text})

    def end_figure() -> None:
        nonlocal captions
        flush()
        media, caption = figures.pop()
        text = " ".join(" ".join(caption).split())
        captions = 0
        if text and media:
            for part in media:
                part["caption"] = text
        elif text:
            parts.append({"kind": "text", "text": text})

    for kind, tag, attrs in events(html or ""):
        if kind == "text":
            (figures[-1][1] if captions else said).append(tag)
            continue
        if tag in BLOCK_TAGS and not captions:
            flush()
        if captions and tag in BLOCK_TAGS:
            figures[-1][1].append(" ")
        if kind == "close":
            if tag == "figcaption":
                captions = 0
            elif tag == "figure" and figures:
                end_figure()
        elif tag == "figure" and not closes_itself(attrs):
            flush()
            captions = 0
            figures.append(([], []))
        elif tag == "figcaption" and figures:
            flush()
            captions = 1
        elif tag in _MEDIA_TAGS:
            named = attributes(attrs)
            for source in _sources(tag, named):
                if not captions:
                    flush()
                part = {"kind": "media", "source": source, "digest": _digest(source), "caption": named.get("alt") or named.get("title") or None}
                parts.append(part)
                if figures:
                    figures[-1][0].append(part)
    while figures:
        end_figure()
    flush()
    return [{"position": i, **part} for i, part in enumerate(parts)]


@F.arrow_udf(PARTS)
def _parts(pages: pa.Array) -> pa.Array:
    return pa.array([parse_parts(x.as_py()) for x in pages], _PARTS_ARROW)


def interleave(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with parts: position, kind (text or media), text, source, digest, caption, in order of the page.

    A null, empty or textless page has no parts; repeated rows get equal parts; very long pages take time linear in
    their length; an empty table gives an empty result; a column named parts is replaced, all others stay.
    """
    p = Positional(pages, ["parts"])
    return p.restore(p.df.withColumn("parts", _parts(p.col(html_col))))


def payload_of(text: F.Column) -> F.Column:
    """UTF-8 bytes and bytes 0 up to a positive multiple of WIDTH."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    pad = F.when(n == 0, F.lit(WIDTH)).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), pad)))


def stored_image(text: F.Column) -> F.Column:
    """The payload of a text as an 8-bit grey image (binary PGM), WIDTH samples a row: lossless, a header that also says
    how many bytes aren't padding, and the samples."""
    payload = payload_of(text)
    n = F.octet_length(F.coalesce(text, F.lit(""))).cast("string")
    rows = (F.octet_length(payload) / WIDTH).cast("long").cast("string")
    return F.concat(F.encode(F.concat(F.lit("P5\n#"), n, F.lit(f"\n{WIDTH} "), rows, F.lit("\n255\n")), "UTF-8"), payload)


def media_store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One stored image per distinct text: digest (of the stored form), media. Equal texts meet in one row,
    pre-aggregated, so that a text that a third of all rows hold is sent once by each task. A null text counts as empty,
    whose image is padding; an empty table gives an empty store; other columns don't matter."""
    made = docs.select(stored_image(F.col(text_col)).alias("media"))
    return made.groupBy(F.sha2("media", 256).alias("digest")).agg(F.first("media").alias("media"))


def read_image(media: bytes) -> tuple[bytes, int]:
    """The samples of a stored image, and how many of them aren't padding."""
    magic, said, size, top, samples = media.split(b"\n", 4)
    width, height = map(int, size.split())
    if magic != b"P5" or said[:1] != b"#" or top != b"255" or len(samples) != width * height:
        raise ValueError("not a stored image")
    return samples, int(said[1:])


def image_feature(samples: bytes) -> str:
    """An average hash of an 8 x 8 grid over the image (16 hex digits) and the mean sample in thousandths."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    by_column = rows.reshape(-1, 8, WIDTH // 8).sum(2, dtype=np.int64)
    edges = np.arange(8) * len(rows) // 8
    ends = np.maximum((np.arange(8) + 1) * len(rows) // 8, edges + 1)
    total = np.vstack([np.zeros((1, 8), np.int64), np.cumsum(by_column, 0)])
    grid = (total[ends] - total[edges]) / ((ends - edges)[:, None] * (WIDTH // 8))
    bits = int("".join("1" if x else "0" for x in (grid > grid.mean()).ravel()), 2)
    return f"{bits:016x}:{int(rows.sum(dtype=np.int64)) * 1000 // rows.size}"


RESOLVED = (
    "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
)
_FIGURES = [x.split()[0] for x in RESOLVED.split(", ")]


def _read(batches):
    for batch in batches:
        rows = {name: [] for name in _FIGURES}
        for digest, media in zip(batch["digest"].to_pylist(), batch["media"], strict=True):
            media = media.as_buffer().to_pybytes()
            samples, n = read_image(media)
            whole = hashlib.sha256(media).hexdigest()
            if whole != digest:
                raise ValueError(f"the image stored as {digest} has digest {whole}")
            made = (digest, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), whole, image_feature(samples))
            for column, value in zip(rows.values(), made, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_pydict(rows)


def read_store(store: DataFrame) -> DataFrame:
    """Reads every stored image back and holds it against its digest: figures and feature by digest. An image that isn't
    what its digest says is an error; a store without rows gives none; rows that repeat are read each."""
    return store.select("digest", "media").mapInArrow(_read, RESOLVED)


def references(pages: DataFrame, read: DataFrame, id_cols: list[str]) -> DataFrame:
    """One row per media part of interleave(pages): id_cols, position, ordinal (among media parts, from 0), source,
    caption, digest, and by digest what is read from the store.

    The join is left outer: a reference whose digest isn't stored, or that is an address, keeps its row, with nulls. Pages
    without media have no row. Repeated references and repeated pages each keep theirs.
    """
    p = Positional(pages)
    media = F.filter(p.col("parts"), lambda x: x["kind"] == "media")
    rows = p.df.select(*[p.col(c).alias(f"id{i}") for i, c in enumerate(id_cols)], F.posexplode(media).alias("ordinal", "_p"))
    refs = rows.select(*[f"id{i}" for i in range(len(id_cols))], "_p.position", "ordinal", "_p.source", "_p.caption", "_p.digest")
    names = [*id_cols, "position", "ordinal", "source", "caption", "digest", *_FIGURES[1:]]
    joined = refs.join(read, "digest", "left")
    return joined.select(*[f"id{i}" for i in range(len(id_cols))], *names[len(id_cols) :]).toDF(*names)


def resolve(pages: DataFrame, read: DataFrame) -> DataFrame:
    """interleave(pages) with resolved: parts in their order, where each media part has in media what is read from the
    store by its digest (null if nothing is stored). Texts don't move: only references meet the store, and go back by
    the number of their row in a written copy of pages. Null parts stay null; a column named resolved is replaced."""
    p = Positional(pages, ["resolved"])
    parts = p.name("parts")
    rows = cut(p.df.withColumn("_row", F.monotonically_increasing_id()))
    refs = references(rows.select("_row", F.col(parts).alias("parts")), read, ["_row"])
    found = refs.where(F.col("media_sha256").isNotNull()).select("_row", F.struct("position", F.struct("digest", *_FIGURES[1:]).alias("media")).alias("_at"))
    found = found.groupBy("_row").agg(F.map_from_entries(F.collect_list("_at")).alias("_media"))
    fields = lambda x: [x[f].alias(f) for f in ("position", *_STRINGS)]
    media = lambda x: F.try_element_at("_media", x["position"]).alias("media")
    joined = rows.join(found, "_row", "left").withColumn("resolved", F.transform(parts, lambda x: F.struct(*fields(x), media(x))))
    return p.restore(joined)


def _paragraphs(text: F.Column) -> F.Column:
    """The text as markup: a paragraph per line."""
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(reference))
    return F.concat(F.lit("<p>"), F.replace(text, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))


def as_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A page per document: its id, and html with the first line, a figure of its stored image, captioned with the id,
    the other lines, and the image once more with an alt text. Null texts count as empty, a null id is captioned so."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = F.substring_index(text, "\n", 1)
    rest = F.expr("substring(_text, length(_first) + 2)")
    source = F.concat(F.lit(f'<img src="{SCHEME}'), F.sha2(stored_image(text), 256))
    d = docs.select(F.col(id_col).alias(id_col), text.alias("_text"), first.alias("_first"), source.alias("_source"))
    caption = F.concat(F.lit("Document "), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    figure = F.concat(F.lit("<figure>"), "_source", F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    html = F.concat(_paragraphs(F.col("_first")), figure, _paragraphs(rest), "_source", F.lit('" alt="'), caption, F.lit(', again">'))
    return d.select(id_col, html.alias("html"))


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every document's payload, stored, referred to from between the document's lines, resolved by digest and read back.
    position and caption are those of the figure on the page; n_parts and n_texts count the page's parts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pages = interleave(as_pages(docs)).drop("html")
    texts = F.size(F.filter("parts", lambda x: x["kind"] == "text"))
    pages = pages.select("doc_id", "parts", F.size("parts").alias("n_parts"), texts.alias("n_texts"))
    rows = references(pages, read_store(media_store(docs)), ["doc_id", "n_parts", "n_texts"]).where("ordinal = 0")
    return rows.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_parts", "n_texts"
    )
