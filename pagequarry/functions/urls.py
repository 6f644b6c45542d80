"""URL functions on columns, as expressions.

They give what Python's ``urllib.parse`` gives for the same text, including its treatment of
blanks, control characters, ``;parameters``, bracketed hosts and malformed input. Spark's own
``parse_url`` is not used: it follows ``java.net.URI`` and refuses URLs that browsers and
Python accept.

The expressions are written as SQL text, since they are used inside lambdas over the links of
a page. Plain URLs and paths, the great majority, are recognised by one pattern each and skip
the long way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry import settings as S
from pagequarry.functions.text import sql_let, sql_strip, sql_text

# scheme, host, path (with ;parameters), query, fragment — RFC 3986, appendix B
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
# a stripped URL that is canonical already, its path without parameters
_PLAIN_URL = rf"\A(?:{'|'.join(S.WEB_SCHEMES)})://[a-z0-9.\-]+/[^#;?\t\r\n]*\z"
# a stripped absolute path without parameters or dot segments, and not starting a host
_PLAIN_PATH = r"(?s)\A/(?![/.])(?:[^#;?\t\r\n/]|/(?!\.))*+\z"


def _ipv6_pattern() -> str:
    """Address pattern of RFC 3986, plus an optional zone."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    group = "[0-9A-Fa-f]{1,4}"
    tail = rf"(?:{group}:{group}|{octet}(?:\.{octet}){{3}})"
    forms = [f"(?:{group}:){{6}}{tail}", f"::(?:{group}:){{5}}{tail}"]
    for most in range(5):
        left = f"(?:(?:{group}:){{0,{most}}}{group})?"
        forms.append(f"{left}::(?:{group}:){{{4 - most}}}{tail}")
    forms.append(f"(?:(?:{group}:){{0,5}}{group})?::{group}")
    forms.append(f"(?:(?:{group}:){{0,6}}{group})?::")
    return f"(?:{'|'.join(forms)})(?:%[^%]+)?"


_BRACKETED = rf"(?s)^(?:v[a-fA-F0-9]+\.[^\n]+|{_ipv6_pattern()})\z"


# -- SQL text --------------------------------------------------------------------------


def _pattern(value: str) -> str:
    return f"r'{value}'"


def _group(x: str, n: int) -> str:
    return f"regexp_extract({x}, {_pattern(_PARTS)}, {n})"


def _split(url: str) -> str:
    """Struct of the parts of a URL; ``bad`` marks a host that makes the URL unreadable."""
    cleaned = f"translate(trim(LEADING {sql_text(S.C0_OR_SPACE)} FROM {url}), '\\t\\r\\n', '')"
    inside = rf"regexp_extract(host, r'(?s)^[^\[]*\[([^\]]*)', 1)"
    bad = (
        "contains(host, '[') != contains(host, ']')"
        f" OR (contains(host, '[') AND NOT {inside} RLIKE {_pattern(_BRACKETED)})"
        f" OR host RLIKE '[{S.UNSAFE_HOST_CHARS}]'"
    )
    parts = (
        f"named_struct('scheme', lower({_group('cleaned', 1)}), 'host', host,"
        f" 'path', {_group('cleaned', 3)}, 'query', {_group('cleaned', 4)},"
        f" 'fragment', {_group('cleaned', 5)}, 'bad', {bad})"
    )
    return sql_let(cleaned, "cleaned", sql_let(_group("cleaned", 2), "host", parts))


_WEB = ", ".join(f"'{s}'" for s in S.WEB_SCHEMES)


def _fetchable(p: str) -> str:
    return f"(NOT {p}.bad AND {p}.scheme IN ({_WEB}) AND {p}.host != '')"


def _decode(x: str) -> str:
    # a % that starts no escape stands for itself
    return f"url_decode(regexp_replace({x}, '%(?![0-9A-Fa-f]{{2}})', '%25'))"


def _encode(x: str) -> str:
    return f"replace(replace(url_encode({x}), '*', '%2A'), '%7E', '~')"


def _canonical_query(query: str) -> str:
    """Pairs with a value, decoded, sorted by name and value, encoded again."""
    fields = f"filter(split({query}, '&'), field -> field RLIKE r'(?s)=.')"
    name = _decode("substring_index(field, '=', 1)")
    value = _decode("regexp_replace(field, r'(?s)^[^=]*=', '')")
    pairs = f"transform({fields}, field -> named_struct('name', {name}, 'value', {value}))"
    written = f"pair -> concat({_encode('pair.name')}, '=', {_encode('pair.value')})"
    return f"array_join(transform(sort_array({pairs}), {written}), '&')"


def _prefixed(mark: str, x: str) -> str:
    return f"CASE WHEN {x} != '' THEN concat('{mark}', {x}) ELSE '' END"


def _normal(url: str) -> str:
    # parameters that are empty vanish with their mark
    path = r"regexp_replace(p.path, r'(?s)\A(.*/)?([^/;]*);\z', '$1$2')"
    query = f"CASE WHEN p.query != '' THEN {_canonical_query('p.query')} ELSE '' END"
    whole = (
        "concat(p.scheme, '://', lower(p.host),"
        f" CASE WHEN p.path = '' THEN '/' ELSE {path} END, {sql_let(query, 'q', _prefixed('?', 'q'))})"
    )
    long_way = sql_let(_split("stripped"), "p", f"CASE WHEN {_fetchable('p')} THEN {whole} END")
    return sql_let(
        sql_strip(url),
        "stripped",
        f"CASE WHEN stripped RLIKE {_pattern(_PLAIN_URL)} THEN stripped ELSE {long_way} END",
    )


def _merged_path(base: str, path: str) -> str:
    """Path of a reference against the base path, with ``.`` and ``..`` taken out."""
    # empty segments vanish when a path is merged, except at its ends
    merged = f"regexp_replace(concat(regexp_replace({base}, r'(?s)[^/]*\\z', ''), {path}), '/{{2,}}', '/')"
    whole = f"CASE WHEN startswith({path}, '/') THEN {path} ELSE {sql_let(merged, 'm', _rooted('m'))} END"
    climb = (
        "(done, segment) -> CASE"
        " WHEN segment = '..' THEN slice(done, 1, greatest(size(done) - 1, 0))"
        " WHEN segment = '.' THEN done ELSE concat(done, array(segment)) END"
    )
    walked = f"aggregate(split(whole, '/'), CAST(array() AS array<string>), {climb})"
    ended = r"CASE WHEN whole RLIKE r'(?:\A|/)\.\.?\z' THEN array('') ELSE CAST(array() AS array<string>) END"
    without_dots = sql_let(f"array_join(concat({walked}, {ended}), '/')", "w", _rooted("w"))
    return sql_let(
        whole,
        "whole",
        rf"CASE WHEN whole RLIKE r'(?:\A|/)\.\.?(?:/|\z)' THEN {without_dots} ELSE whole END",
    )


def _rooted(x: str) -> str:
    return f"CASE WHEN startswith({x}, '/') THEN {x} ELSE concat('/', {x}) END"


def _split_parameters(path: str) -> str:
    """Struct of the path and the ``;parameters`` of its last segment."""
    pattern = _pattern(r"(?s)\A((?:.*/)?[^/;]*)(?:;(.*))?\z")
    return (
        f"named_struct('path', regexp_extract({path}, {pattern}, 1),"
        f" 'parameters', regexp_extract({path}, {pattern}, 2))"
    )


def _base(url: str) -> str:
    """Struct of a base URL: its text, parts, path and parameters, and site if fetchable."""
    site = f"CASE WHEN {_fetchable('bp')} THEN concat(bp.scheme, '://', lower(bp.host)) END"
    struct = f"named_struct('text', {url}, 'parts', bp, 'own', {_split_parameters('bp.path')}, 'site', {site})"
    return sql_let(_split(url), "bp", struct)


def _joined(base: str, reference: str) -> str:
    """Absolute URL of a stripped, non-empty reference; null if there is none."""

    def absolute(host: str, path: str, parameters: str, query: str) -> str:
        return (
            f"CASE WHEN {host} != '' THEN concat({base}.parts.scheme, '://', {host}, {path},"
            f" {_prefixed(';', parameters)}, {query}, {_prefixed('#', 'r.fragment')}) END"
        )

    query = _prefixed("?", "r.query")
    base_query = f"CASE WHEN r.query != '' THEN {query} ELSE {_prefixed('?', f'{base}.parts.query')} END"
    other_host = absolute("r.host", "own.path", "own.parameters", query)
    same_page = absolute(
        f"{base}.parts.host", f"{base}.own.path", f"{base}.own.parameters", base_query
    )
    same_host = absolute(
        f"{base}.parts.host", _merged_path(f"{base}.own.path", "own.path"), "own.parameters", query
    )
    against = (
        f"CASE WHEN r.host != '' THEN {other_host}"
        f" WHEN own.path = '' AND own.parameters = '' THEN {same_page} ELSE {same_host} END"
    )
    return sql_let(
        _split(reference),
        "r",
        f"CASE WHEN r.bad OR {base}.parts.bad THEN NULL"
        f" WHEN (r.scheme != '' AND r.scheme != {base}.parts.scheme)"
        f" OR {base}.parts.scheme NOT IN ({_WEB}) THEN {reference}"
        f" ELSE {sql_let(_split_parameters('r.path'), 'own', against)} END",
    )


def _resolved(base: str, reference: str) -> str:
    whole = f"CASE WHEN ref = '' THEN {base}.text ELSE {_joined(base, 'ref')} END"
    stripped = sql_let(
        sql_strip(reference),
        "ref",
        f"CASE WHEN {base}.site IS NOT NULL AND ref RLIKE {_pattern(_PLAIN_PATH)}"
        f" THEN concat({base}.site, ref)"
        f" WHEN {base}.site IS NOT NULL AND ref RLIKE {_pattern(_PLAIN_URL)} THEN ref"
        f" ELSE {_normal(whole)} END",
    )
    return f"CASE WHEN {reference} != '' AND {base}.text != '' THEN {stripped} END"


def _apply(sql: str, value: Column) -> Column:
    """The SQL text, in which ``x`` stands for the value."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"x -> {sql}")), F.lit(0))


# -- functions -------------------------------------------------------------------------


def url_is_valid(url: Column) -> Column:
    """Does the URL, stripped, have a web scheme and a host? Never null, never fails."""
    return _apply(
        f"coalesce({sql_let(_split(sql_strip('x')), 'p', _fetchable('p'))}, false)", url
    )


def url_normalize(url: Column) -> Column:
    """Canonical form: lower-case scheme and host, a path, sorted query, no fragment."""
    return _apply(_normal("x"), url)


def _domain(x: str) -> str:
    given = sql_let(_split(x), "g", "lower(g.host)")
    return sql_let(_split(sql_strip(x)), "p", f"CASE WHEN {_fetchable('p')} THEN {given} END")


def url_domain(url: Column) -> Column:
    """Lower-case host with user and port, null for an invalid URL.

    The host is taken from the URL as given: blanks after it stay.
    """
    return _apply(_domain("x"), url)


def url_place(url: Column) -> Column:
    """Scheme in lower case and host as written (with user and port); null if the URL cannot be taken apart."""
    parts = "CASE WHEN NOT g.bad THEN named_struct('scheme', g.scheme, 'host', g.host) END"
    return _apply(sql_let(_split("x"), "g", parts), url)


def url_same_domain(left: Column, right: Column) -> Column:
    """Do both URLs have the same host? False if either has none."""
    same = sql_let(_domain("x.l"), "l", f"l != '' AND l = {_domain('x.r')}")
    return _apply(f"coalesce({same}, false)", F.struct(left.alias("l"), right.alias("r")))


def url_resolve(base_url: Column, reference: Column) -> Column:
    """Normalised absolute URL of ``reference`` found on ``base_url``; null if there is none.

    On a base that is no web URL only references with a web scheme of their own resolve.
    """
    pair = F.struct(base_url.alias("base"), reference.alias("reference"))
    return _apply(sql_let(_base("x.base"), "b", _resolved("b", "x.reference")), pair)


def sql_resolve_all(base_url: str, references: str) -> str:
    """Resolved references of an array; the base is read once."""
    each = f"transform({references}, reference -> {_resolved('b', 'reference')})"
    return sql_let(_base(base_url), "b", each)


def url_resolve_all(base_url: Column, references: Column) -> Column:
    """``url_resolve`` for an array of references."""
    pair = F.struct(base_url.alias("base"), references.alias("references"))
    return _apply(sql_resolve_all("x.base", "x.references"), pair)
