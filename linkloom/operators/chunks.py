"""Bodies that come in chunks: rows of key, chunk (its number) and bytes.  References are found without ever holding a body.

A task takes the chunks of its bodies in order and feeds them to a scanner, which holds back what it can't decide yet.  Bodies are
dealt to tasks by key; the chunks of one body are read one after the other, as its markup must be.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import url as U
from linkloom.functions.text import computed, let
from linkloom.operators.links import effective_base
from linkloom.operators.scan import CssScanner, HtmlScanner, nested
from linkloom.session import cut

_FIELDS = "link int, offset long, length long, role string, hint string, part int, at int, size int, ref string, descriptor string"
_ROWS = 4096


def split_bodies(rows: DataFrame, size: int | Column, body: str = "body") -> DataFrame:
    """rows with chunk and bytes of up to size bytes instead of the body; an empty body is one empty chunk, a null one none."""
    keep = [c for c in rows.columns if c != body]
    whole, step = F.encode(F.col(body), "UTF-8") if dict(rows.dtypes)[body] == "string" else F.col(body), (F.lit(size) if isinstance(size, int) else size).cast("int")
    last = F.floor(F.greatest(F.octet_length("_whole") - 1, F.lit(0)) / F.col("_step")).cast("int")
    given = rows.select(*keep, whole.alias("_whole"), step.alias("_step")).where("_whole is not null")
    dealt = given.select(*keep, "_whole", "_step", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return dealt.select(*keep, "chunk", F.substring("_whole", F.col("chunk") * F.col("_step") + 1, F.col("_step")).alias("bytes"))


class _Html:
    """The references of a page, numbered as in the whole page."""

    def __init__(self) -> None:
        self.scanner, self.links = HtmlScanner(), 0

    def feed(self, chunk: bytes, last: bool) -> list[tuple]:
        found = self.scanner.feed(chunk, last)
        rows = [r for k, x in enumerate(found, self.links) for r in nested(k, x, self.scanner.blocks.get(x[0]))]
        self.links += len(found)
        return [*rows, (-1, 0, 0, "document", "", 0, 0, 0, self.scanner.base, "")] if last else rows


class _Css:
    """The references of a style sheet, imports as css."""

    def __init__(self) -> None:
        self.scanner, self.links = CssScanner(), 0

    def feed(self, chunk: bytes, last: bool) -> list[tuple]:
        found = self.scanner.feed(chunk, last)
        self.links += len(found)
        return [(k, at, size, "asset", "css" if imported else "other", 0, 0, 0, ref, "") for k, (at, size, ref, imported) in enumerate(found, self.links - len(found))]


def chunk_references(chunks: DataFrame, key: str = "url", sheets: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """key, the columns to keep, and the references of each body, with their offsets and lengths in it, as a scan of the whole body gives them.

    chunks: key, chunk and bytes, and columns to keep, which have one value in all chunks of a body.  A page has one more row, of link -1 and
    the role document: its ref is the href of the page's base, or null.  Null bytes are empty ones; other columns are ignored.
    """
    make = _Css if sheets else _Html
    told = [key, *keep]
    kinds = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in told)
    names = [*told, *[x.split()[0] for x in _FIELDS.split(", ")]]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, scan, own, out = None, None, (), []

        def given(of: list[pa.DataType]) -> pa.RecordBatch:
            columns = zip(*out)
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (*of, *types))], names=names)
            out.clear()
            return made

        kinds_of = []
        for batch in batches:
            keys, parts, kinds_of = batch.column(0), batch.column(len(told)), batch.schema.types[: len(told)]
            for i in range(batch.num_rows):
                k = keys[i].as_py()
                if scan is None or k != body:
                    if scan is not None:
                        out += [(*own, *r) for r in scan.feed(b"", True)]
                    body, scan, own = k, make(), (k, *[batch.column(c)[i].as_py() for c in range(1, len(told))])
                out += [(*own, *r) for r in scan.feed(parts[i].as_py() or b"", False)]
                if len(out) >= _ROWS:
                    yield given(kinds_of)
        if scan is not None:
            out += [(*own, *r) for r in scan.feed(b"", True)]
        if out:
            yield given(kinds_of)

    ordered = chunks.select(*told, "chunk", "bytes").repartition(key).sortWithinPartitions(key, "chunk")
    return ordered.select(*told, "bytes").mapInArrow(run, f"{kinds}, {_FIELDS}")


def discover_chunks(chunks: DataFrame, sheets: bool = False, key: str = "url") -> DataFrame:
    """Edges of bodies in chunks: url, link, part, role, hint and target (parsed), as discover_html and discover_css give them for whole ones.

    chunks: url, chunk and bytes, and key where a URL has several bodies: it tells them apart, and edges have it too.
    References come out before a page's base is known, so they meet it by key.
    """
    told = list(dict.fromkeys([key, "url"]))
    found = chunk_references(chunks, key, sheets, told[1:])
    if not sheets:
        found = cut(found)  # read twice; light rows, where a second scan would read all bodies
    page = U.parse(F.col("url"))
    if sheets:
        based = computed(found, "_base", page)
    else:
        bases = found.where("link = -1").select(F.col(key).alias("_key"), F.col("ref").alias("_href"))
        met = found.where("link >= 0 and role != 'base'").join(bases, F.col(key).eqNullSafe(F.col("_key")))
        based = computed(met, "_base", effective_base(page, F.col("_href")))
    target = F.when(~U.is_non_fetchable(F.col("ref")), U.resolve(F.col("_base"), F.col("ref")))
    rows = computed(based, "target", let(target, lambda t: F.when(t.isNotNull() & U.is_http(t), t))).where("target is not null")
    role = F.when(F.col("role").isin("meta_refresh", "navigation"), "navigation").otherwise("asset")
    return rows.select(*told, "link", "part", role.alias("role"), "hint", "target")
