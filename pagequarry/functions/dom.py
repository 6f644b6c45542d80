"""Arrow steps over tables of pages: reading markup, normalising text.

Both are table functions (``mapInArrow``), not column functions: the optimizer copies a
column function into every expression and filter that uses its result, and would read the
markup several times over.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagequarry.functions.markup import PageReader
from pagequarry.schemas import DOM
from pagequarry.settings import ERROR_PARSE, NOISE_TAGS

#: Pages, and bytes of their markup, that a step works on together; a longer page stands alone.
PAGES_TOGETHER, BYTES_TOGETHER = 256, 1 << 20


def _parts(batches: Iterator[pa.RecordBatch], html: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, so that what a step holds for its pages does not grow with a batch."""
    for batch in batches:
        sizes = [0] * batch.num_rows
        if html is not None:
            sizes = pc.fill_null(pc.binary_length(batch.column(html)), 0).to_pylist()
        start = held = 0
        for k, size in enumerate(sizes):
            if k > start and (k - start >= PAGES_TOGETHER or held + size > BYTES_TOGETHER):
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def _dom_array(html: pa.Array, reader: Callable[[str], PageReader]) -> pa.Array:
    """Each page becomes part of flat value lists plus offsets: no per-node objects in Arrow."""
    pages: list[PageReader | None] = []
    errors: list[str | None] = []
    for value in html.to_pylist():
        page = error = None
        if value is not None:
            try:
                page = reader(value)
            except Exception as e:
                error = ERROR_PARSE % f"{type(e).__name__}: {e}"
        pages.append(page)
        errors.append(error)

    def column(attribute: str, kind: pa.DataType) -> pa.Array:
        return pa.array([v for page in pages if page for v in getattr(page, attribute)], kind)

    def per_page(attribute: str, values: pa.Array) -> pa.Array:
        offsets = [0]
        for page in pages:
            offsets.append(offsets[-1] + (len(getattr(page, attribute)) if page else 0))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    scopes = pa.StructArray.from_arrays(
        [column("scopes", pa.list_(pa.string())), column("scope_kinds", pa.string())],
        ["tags", "kind"],
    )
    elements = pa.StructArray.from_arrays(
        [
            column("tags", pa.string()),
            column("element_scopes", pa.int32()),
            column("firsts", pa.int32()),
            column("lasts", pa.int32()),
            column("hrefs", pa.string()),
        ],
        ["tag", "scope", "first", "last", "href"],
    )
    texts = pa.StructArray.from_arrays(
        [column("texts", pa.string()), column("text_scopes", pa.int32())], ["text", "scope"]
    )
    return pa.StructArray.from_arrays(
        [
            per_page("scopes", scopes),
            per_page("tags", elements),
            per_page("texts", texts),
            pa.array(errors, pa.string()),
        ],
        ["scopes", "elements", "texts", "error"],
    )


def page_dom(
    pages: DataFrame,
    html: str = "html",
    reader: Callable[[str], PageReader] | None = None,
    scope_tags: Sequence[str] | None = None,
) -> DataFrame:
    """``pages`` with ``dom`` (see ``schemas.DOM``) in place of the markup.

    The scopes of ``dom`` know the tags in ``scope_tags`` (the default noise tags if not
    given): give the noise tags that later steps will use.

    A page the reader fails on keeps its row, with the failure in ``dom.error`` and nothing
    else; other pages are not affected. Later steps never carry the markup.
    """
    reader = reader or partial(PageReader, scope_tags=list(scope_tags or NOISE_TAGS))
    kept = [f for f in pages.schema if f.name != html]
    names = [f.name for f in kept]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, html):
            dom = _dom_array(batch.column(html), reader)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), dom], [*names, "dom"]
            )

    return pages.mapInArrow(read, T.StructType([*kept, T.StructField("dom", DOM)]))


def _nfkc(texts: pa.Array) -> pa.Array:
    """NFKC form of a text (or text list) array. Only texts beyond ASCII reach Python."""
    if pa.types.is_list(texts.type):
        lengths = pc.fill_null(pc.list_value_length(texts), 0)
        ends = pc.cumulative_sum(lengths).cast(pa.int32())
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        return pa.ListArray.from_arrays(offsets, _nfkc(texts.flatten()), mask=texts.is_null())
    beyond = pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False)
    if not pc.any(beyond).as_py():
        return texts
    normal = [unicodedata.normalize("NFKC", t) for t in texts.filter(beyond).to_pylist()]
    return pc.replace_with_mask(texts, beyond, pa.array(normal, texts.type))


def normalize(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``table`` with the given text (or text list) columns in NFKC form.

    Spark has no such function, and the one of Arrow decomposes without composing.
    """
    names, chosen = table.columns, set(columns)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            arrays = [
                _nfkc(batch.column(n)) if n in chosen else batch.column(n) for n in names
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return table.mapInArrow(apply, table.schema)


def normalize_parts(table: DataFrame, struct: str, columns: Sequence[str]) -> DataFrame:
    """``table`` with the fields of a struct column as columns, those given in NFKC form.

    Handing over the struct whole keeps Spark from computing it once per field.
    """
    fields = table.schema[struct].dataType.fields
    kept = [f for f in table.schema if f.name != struct]
    names, chosen = [f.name for f in kept], set(columns)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            parts = dict(zip([f.name for f in fields], batch.column(struct).flatten()))
            arrays = [_nfkc(a) if n in chosen else a for n, a in parts.items()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *arrays], [*names, *parts]
            )

    return table.mapInArrow(apply, T.StructType([*kept, *fields]))
