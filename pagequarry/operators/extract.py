"""Extraction: HTML to title, content blocks and links, without a shuffle.

Python only reads the markup (``functions.dom``). What counts as noise, title, content or
link is decided here by expressions over the ``dom`` column, so the tag lists stay plain
arguments and one reading of the page serves every output. All of a page's work happens in
its own row: nothing is exploded and regrouped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import settings as S
from pagequarry.functions.dom import normalize, normalize_parts, page_dom
from pagequarry.functions.markup import TEXT_CONTAINERS, PageReader
from pagequarry.functions.text import collapse, sql_let, sql_strip, sql_text
from pagequarry.functions.urls import sql_resolve_all, url_domain


def _tags(chosen: Sequence[str] | None, default: list[str]) -> str:
    """Tag list as SQL text; an empty choice means the default."""
    return ", ".join(sql_text(tag) for tag in dict.fromkeys(chosen or default))


# -- SQL text over the column ``dom`` --------------------------------------------------


def _pruned(noise_tags: Sequence[str] | None, body: str) -> str:
    """``body`` over ``tree``: elements and text runs outside noise elements.

    Elements inside noise are dropped. Text runs keep their places, as elements refer to them
    by position; those inside noise lose their text.
    """
    noise = f"array({_tags(noise_tags, S.NOISE_TAGS)})"
    scopes = (
        "transform(dom.scopes, scope ->"
        f" named_struct('kept', NOT arrays_overlap(scope.tags, {noise}), 'kind', scope.kind))"
    )
    tree = (
        "named_struct('elements', filter(dom.elements, element -> get(kinds, element.scope).kept),"
        " 'texts', transform(dom.texts, run -> named_struct("
        "'text', CASE WHEN get(kinds, run.scope).kept THEN run.text END,"
        " 'kind', get(kinds, run.scope).kind)))"
    )
    return sql_let(sql_let(scopes, "kinds", tree), "tree", body)


def _runs(element: str) -> str:
    """Text runs an element can see: below it, not noise, and of its own kind."""
    containers = ", ".join(sql_text(tag) for tag in TEXT_CONTAINERS)
    own_kind = f"CASE WHEN {element}.tag IN ({containers}) THEN {element}.tag END"
    below = f"slice(tree.texts, {element}.first + 1, {element}.last - {element}.first)"
    seen = f"filter({below}, run -> run.text IS NOT NULL AND run.kind <=> {own_kind})"
    return f"transform({seen}, run -> run.text)"


def _title() -> str:
    """Text of the first title, else the first h1, else the first h2 that is not blank."""

    def of(tag: str) -> str:
        first = f"get(filter(tree.elements, element -> element.tag = '{tag}'), 0)"
        text = sql_let(first, "found", f"array_join({_runs('found')}, '')")
        return sql_let(text, "raw", f"CASE WHEN {sql_strip('raw')} != '' THEN raw END")

    return f"coalesce({', '.join(of(tag) for tag in S.TITLE_TAGS)}, '')"


def _blocks(content_tags: Sequence[str] | None) -> str:
    """Text of every content element in document order, its runs stripped and blank-joined."""
    chosen = _tags(content_tags, S.CONTENT_TAGS)
    elements = f"filter(tree.elements, element -> element.tag IN ({chosen}))"
    runs = f"transform({_runs('element')}, run -> {sql_strip('run')})"
    texts = f"transform({elements}, element -> array_join(filter({runs}, run -> run != ''), ' '))"
    return f"filter({texts}, block -> block != '')"


def _hrefs() -> str:
    """Link targets as written, first occurrences in document order."""
    anchors = "filter(tree.elements, element -> element.tag = 'a' AND element.href IS NOT NULL)"
    targets = f"transform({anchors}, element -> {sql_strip('element.href')})"
    skipped = " OR ".join(f"startswith(href, '{prefix}')" for prefix in S.SKIPPED_HREF_PREFIXES)
    return f"array_distinct(filter({targets}, href -> href != '' AND NOT ({skipped})))"


def sql_links(url: str, hrefs: str) -> str:
    """Absolute, valid, normalised links of targets on the page ``url``, each once."""
    known = f"filter({sql_resolve_all(url, hrefs)}, link -> link IS NOT NULL)"
    return f"coalesce(array_distinct({known}), {_NO_STRINGS})"


def _links(resolved: bool = True) -> str:
    return sql_links("url", _hrefs()) if resolved else f"coalesce({_hrefs()}, {_NO_STRINGS})"


_NO_STRINGS = "CAST(array() AS array<string>)"


def kept_text(noise_tags: Sequence[str] | None = None) -> Column:
    """All text of a page outside noise elements, as it stands; ``dom`` must know their tags."""
    return F.expr(_pruned(noise_tags, "array_join(transform(tree.texts, run -> run.text), '')"))


def noise_count(noise_tags: Sequence[str] | None = None) -> Column:
    """Elements taken out when the noise tags are removed one tag after the other.

    Nested elements of one tag all count; an element that went with an ancestor of an earlier
    tag does not.
    """
    noise = _tags(noise_tags, S.NOISE_TAGS)
    place = f"CAST(array_position(array({noise}), element.tag) AS int)"
    earlier = f"slice(array({noise}), 1, greatest({place} - 1, 0))"
    around = "get(dom.scopes, element.scope).tags"
    counted = f"element.tag IN ({noise}) AND NOT arrays_overlap({around}, {earlier})"
    return F.expr(f"coalesce(size(filter(dom.elements, element -> {counted})), 0)")


# -- tables ----------------------------------------------------------------------------


def _select(read: DataFrame, *outputs: Column) -> DataFrame:
    """``read`` (see ``page_dom``) with ``dom`` replaced by expressions over it."""
    return read.select(*[c for c in read.columns if c != "dom"], *outputs)


def page_titles(pages: DataFrame, noise_tags: Sequence[str] | None = None) -> DataFrame:
    """``title`` in place of ``html``."""
    title = F.expr(_pruned(noise_tags, _title())).alias("title")
    titled = normalize(_select(page_dom(pages, scope_tags=noise_tags), title), ["title"])
    return titled.withColumn("title", collapse(F.col("title")))


def page_blocks(
    pages: DataFrame,
    content_tags: Sequence[str] | None = None,
    noise_tags: Sequence[str] | None = None,
) -> DataFrame:
    """``blocks`` (cleaned content texts in document order) in place of ``html``."""
    blocks = F.expr(_pruned(noise_tags, _blocks(content_tags))).alias("blocks")
    found = normalize(_select(page_dom(pages, scope_tags=noise_tags), blocks), ["blocks"])
    return found.withColumn("blocks", _clean_blocks("blocks"))


def page_links(pages: DataFrame, noise_tags: Sequence[str] | None = None) -> DataFrame:
    """``links`` in place of ``html``; relative ones are resolved against ``url``."""
    read = page_dom(pages, scope_tags=noise_tags)
    return _select(read, F.expr(_pruned(noise_tags, _links())).alias("links"))


def links_by_domain(linked: DataFrame) -> DataFrame:
    """Links per target domain, those within a page's own site (``internal``) apart.

    ``linked`` has ``url`` and ``links`` in normal form, where the host stands between the
    second and third slash.
    """
    rows = linked.select(url_domain(F.col("url")).alias("own"), F.explode("links").alias("link"))
    domain = F.split_part("link", F.lit("/"), F.lit(3))
    split = rows.select(
        domain.alias("domain"), F.coalesce(domain == F.col("own"), F.lit(False)).alias("internal")
    )
    return split.groupBy("domain", "internal").agg(F.count("*").alias("n_links"))


def _clean_blocks(blocks: str) -> Column:
    return F.filter(F.transform(blocks, collapse), lambda b: b != "")


def extract(
    pages: DataFrame,
    content_tags: Sequence[str] | None = None,
    noise_tags: Sequence[str] | None = None,
    reader: Callable[[str], PageReader] | None = None,
    resolved: bool = True,
) -> DataFrame:
    """``title``, ``blocks``, ``links``, ``noise_removed`` and ``parse_error`` for ``html``.

    Without ``resolved`` links stay as they are written, to be resolved later (``sql_links``).

    One reading of the markup serves all of them. Two Arrow steps (read, normalise), no
    exchange. Pages without markup, or that could not be read, get empty outputs. Filter
    pages before this step: filters do not move below it.
    """
    parts = _pruned(
        noise_tags,
        f"named_struct('title', {_title()}, 'blocks', {_blocks(content_tags)}, 'links', {_links(resolved)})",
    )
    read = _select(
        page_dom(pages, reader=reader, scope_tags=noise_tags),
        F.expr(parts).alias("parts"),
        noise_count(noise_tags).alias("noise_removed"),
        F.col("dom.error").alias("parse_error"),
    )
    unpacked = normalize_parts(read, "parts", ["title", "blocks"])
    return unpacked.withColumns(
        {
            "title": collapse(F.col("title")),
            "blocks": F.coalesce(_clean_blocks("blocks"), F.expr(_NO_STRINGS)),
        }
    )


def metrics(parsed: DataFrame) -> DataFrame:
    """One row of totals over parsed pages (see ``parse``)."""
    return parsed.agg(
        F.count("*").alias("pages"),
        F.count_if("success").alias("parsed"),
        F.sum("noise_removed").alias("noise_removed"),
        F.sum("n_blocks").alias("blocks"),
        F.sum(F.length("content")).alias("content_chars"),
        F.sum(F.size("links")).alias("links"),
    )


def parse(
    fetched: DataFrame,
    content_tags: Sequence[str] | None = None,
    noise_tags: Sequence[str] | None = None,
    reader: Callable[[str], PageReader] | None = None,
) -> DataFrame:
    """Fill title, content and links of fetched pages (``url, html, success, error, …``).

    ``success`` is kept as fetched, except that a page without markup or one that could not
    be read turns into a failure with its own message. The markup is dropped.
    """
    no_html = F.coalesce(F.col("html") == "", F.lit(True))
    parsed = extract(fetched.withColumn("no_html", no_html), content_tags, noise_tags, reader)
    message = F.when(F.col("no_html"), F.lit(S.ERROR_NO_HTML)).otherwise(F.col("parse_error"))
    kept = [c for c in fetched.columns if c not in ("html", "success", "error")]
    return parsed.select(
        *kept,
        "title",
        F.array_join("blocks", "\n").alias("content"),
        "links",
        (F.col("success") & message.isNull()).alias("success"),
        F.coalesce(message, F.col("error")).alias("error"),
        F.size("blocks").alias("n_blocks"),
        "noise_removed",
    )
