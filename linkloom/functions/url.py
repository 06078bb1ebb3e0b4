"""URL algebra as Column expressions.

A parsed URL is a struct of scheme, userinfo, host, port (0: the scheme's own), path, query, fragment and ipv6; query and
fragment are null where there is none, and the struct is null where the text is no URL.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import iends_with, let, split_on, to_lower, trim

_TYPE = "struct<scheme:string,userinfo:string,host:string,port:int,path:string,query:string,fragment:string,ipv6:boolean>"
_FIELDS = ("scheme", "userinfo", "host", "port", "path", "query", "fragment", "ipv6")
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"

# The schemes of references that are never fetched.
NOT_FETCHED = (
    "javascript:", "data:", "mailto:", "tel:", "sms:", "about:", "blob:", "chrome:", "file:", "ftp:",
    "ws:", "wss:", "magnet:", "intent:", "market:", "geo:", "callto:", "skype:", "viber:", "whatsapp:",
)
# Default ports.
PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}


def strip_whitespace(s: Column) -> Column:
    """Without tabs and line ends anywhere, and without white space at the ends."""
    return trim(F.translate(s, "\t\n\r", ""))


def default_port(scheme: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in PORTS.items() for x in (k, v)]), scheme), F.lit(0))


def effective_port(u: Column) -> Column:
    return F.when(u["port"] != 0, u["port"]).otherwise(default_port(u["scheme"]))


def is_http(u: Column) -> Column:
    return u["scheme"].isin("http", "https")


def _let(value: str, name: str, body: Callable[[str], str]) -> str:
    """SQL for body of value, worked out once: a lambda's variable stands for it, unless it is a mere name.

    Each nested lambda costs the analyser some rounds, of which it has a limited number, so what is cheap is not bound.
    """
    return body(value) if re.fullmatch(r"[\w.]+", value) else f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def _applied(value: Column, body: Callable[[str], str]) -> Column:
    """As let(), with the body as SQL: long expressions are handed to Spark as one text, not node by node."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"v -> {body('v')}")), 1)


def _low(s: str) -> str:
    return f"translate({s}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _named(**parts: str) -> str:
    return f"named_struct({', '.join(f"'{k}', {v}" for k, v in parts.items())})"


def _url(**parts: str) -> str:
    return f"cast({_named(**{k: parts[k] for k in _FIELDS})} AS {_TYPE})"


_PORT_OF = f"map({', '.join(f"'{k}', {v}" for k, v in PORTS.items())})"
_HTTP = "('http', 'https')"


def _dotless(path: str) -> str:
    """Without . and .. and empty segments; a slash at the end stays, or stands for a last . or .. ."""
    stack = (
        f"aggregate(split({path}, '/', -1), cast(array() AS array<string>), (done, part) -> "
        "CASE WHEN part = '..' THEN slice(done, 1, greatest(size(done) - 1, 0)) WHEN part IN ('.', '') THEN done ELSE concat(done, array(part)) END)"
    )
    rooted = f"startswith({path}, '/')"
    open_end = f"{path} RLIKE r'(^|/)\\.{{0,2}}$' AND {path} != ''"
    return _let(stack, "k", lambda k: f"concat(if({rooted}, '/', ''), array_join({k}, '/'), if({open_end} AND NOT ({rooted} AND size({k}) = 0), '/', ''))")


def remove_dot_segments(path: Column) -> Column:
    """As _dotless()."""
    return _applied(path, _dotless)


_AUTHORITY = "struct<userinfo:string,host:string,port:int,ipv6:boolean>"


def _authority(a: str) -> str:
    """userinfo, host, port and ipv6 of an authority; null where its port or brackets are wrong."""
    user = f"if(contains({a}, '@'), regexp_extract({a}, r'(?s)^(.*)@', 1), '')"

    def parts(host: str, port: str, six: str) -> str:
        return f"cast({_named(userinfo=user, host=_low(host), port=f'cast({port} AS int)', ipv6=six)} AS {_AUTHORITY})"

    def by_form(hp: str) -> str:
        six = r"r'(?s)^\[([^\]]+)\](?::([0-9]*).*)?$'"
        digits = f"regexp_replace(regexp_extract({hp}, {six}, 2), r'^0+(?=.)', '')"
        six_port = f"if({digits} = '', 0, pmod(cast(substring({digits}, -15, 15) AS bigint), 65536))"
        port = f"regexp_replace(regexp_extract({hp}, r':([0-9]+)$', 1), r'^0+(?=.)', '')"
        plain = (
            f"CASE WHEN endswith({hp}, ':') THEN {parts(f"regexp_replace({hp}, ':$', '')", '0', 'false')} WHEN {port} = '' THEN {parts(hp, '0', 'false')} "
            f"WHEN length({port}) <= 5 AND cast(substring({port}, 1, 5) AS int) <= 65535 THEN {parts(f"regexp_replace({hp}, r':[0-9]+$', '')", port, 'false')} END"
        )
        return f"if(startswith({hp}, '['), if({hp} RLIKE {six}, {parts(f'regexp_extract({hp}, {six}, 1)', six_port, 'true')}, null), {plain})"

    return _let(f"regexp_replace({a}, r'(?s)^.*@', '')", "hp", by_form)


def authority_parts(authority: Column) -> Column:
    """As _authority()."""
    return _applied(authority, _authority)


def _normal(url: str) -> str:
    """Lower-case scheme and host, no default port, a rooted dot-free path for http, no empty query."""

    def of(x: str) -> str:
        scheme = _low(f"{x}.scheme")
        rooted = f"if(startswith({x}.path, '/'), {x}.path, concat('/', {x}.path))"
        return f"if({x} IS NULL, null, " + _url(
            scheme=scheme, userinfo=f"{x}.userinfo", host=_low(f"{x}.host"), port=f"if({x}.port = coalesce(try_element_at({_PORT_OF}, {scheme}), 0), 0, {x}.port)",
            path=f"if({scheme} IN {_HTTP}, {_dotless(rooted)}, {x}.path)", query=f"nullif({x}.query, '')", fragment=f"{x}.fragment", ipv6=f"{x}.ipv6",
        ) + ")"

    return _let(url, "x", of)


def normalize(u: Column) -> Column:
    """As _normal()."""
    return _applied(u, _normal)


_ABSOLUTE = r"r'(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$'"
_RELATIVE = r"r'(?s)^(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$'"


def _after(s: str) -> str:
    """A query or fragment without its mark; null without a mark."""
    return f"if({s} != '', substring({s}, 2, {1 << 30}), null)"


def _parsed(t: str) -> str:
    """The normal form of an absolute URL, null for other texts."""
    scheme, slashes, path, query, fragment = (f"regexp_extract({t}, {_ABSOLUTE}, {k})" for k in range(1, 6))
    scheme = _low(scheme)
    none = f"cast({_named(userinfo="''", host="''", port='0', ipv6='false')} AS {_AUTHORITY})"
    where = f"if({slashes} = '', {none}, {_authority(f'substring({slashes}, 3, {1 << 30})')})"

    def made(w: str) -> str:
        url = _url(scheme=scheme, userinfo=f"{w}.userinfo", host=f"{w}.host", port=f"{w}.port", path=path, query=_after(query), fragment=_after(fragment), ipv6=f"{w}.ipv6")
        return f"if({w} IS NOT NULL AND NOT ({scheme} IN {_HTTP} AND {w}.host = ''), {url}, null)"

    return f"if({t} RLIKE r'{_SCHEME}', {_normal(_let(where, 'w', made))}, null)"


def parse(text: Column) -> Column:
    return _applied(strip_whitespace(text), _parsed)


def parsed(text: str) -> Column:
    """parse() of a constant, worked out now: a struct of literals, not an expression that each use would copy."""
    found = SparkSession.active().range(1).select(parse(F.lit(text)).alias("u")).first().u
    return F.lit(None).cast(_TYPE) if found is None else F.struct(*[F.lit(found[k]).alias(k) for k in _FIELDS]).cast(_TYPE)


def _resolved(r: str, b: str) -> str:
    slashes, path, query, fragment = (f"regexp_extract({r}, {_RELATIVE}, {k})" for k in range(1, 5))
    own = f"cast({_named(**{k: f'{b}.{k}' for k in ('userinfo', 'host', 'port', 'ipv6')})} AS {_AUTHORITY})"
    where = f"if({slashes} = '', {own}, {_authority(f'substring({slashes}, 3, {1 << 30})')})"
    folder = f"if(contains({b}.path, '/'), regexp_replace({b}.path, r'[^/]*$', ''), '/')"
    merged = f"CASE WHEN {slashes} != '' THEN if({path} = '', '/', {path}) WHEN {path} = '' THEN {b}.path WHEN startswith({path}, '/') THEN {path} ELSE concat({folder}, {path}) END"
    asked = f"if({slashes} = '' AND {path} = '' AND {query} = '', {b}.query, {_after(query)})"

    def made(w: str) -> str:
        url = _url(scheme=f"{b}.scheme", userinfo=f"{w}.userinfo", host=f"{w}.host", port=f"{w}.port", path=merged, query=asked, fragment=_after(fragment), ipv6=f"{w}.ipv6")
        return f"if({w} IS NOT NULL AND NOT ({b}.scheme IN {_HTTP} AND {w}.host = ''), {url}, null)"

    return f"if({r} RLIKE r'{_SCHEME}', {_parsed(r)}, if({b} IS NULL, null, {_normal(_let(where, 'w', made))}))"


def resolve(base: Column, reference: Column) -> Column:
    """A reference against a parsed base; null where it doesn't resolve."""
    return _applied(F.struct(strip_whitespace(reference).alias("r"), base.alias("b")), lambda v: _resolved(f"{v}.r", f"{v}.b"))


def authority(u: Column) -> Column:
    host = F.when(u["ipv6"], F.concat(F.lit("["), u["host"], F.lit("]"))).otherwise(u["host"])
    return F.when((u["port"] != 0) & (u["port"] != default_port(u["scheme"])), F.concat(host, F.lit(":"), u["port"].cast("string"))).otherwise(host)


def origin(u: Column) -> Column:
    return F.when(u["host"] == "", F.lit("")).otherwise(F.concat(u["scheme"], F.lit("://"), authority(u)))


def url_key(u: Column) -> Column:
    """The text without its fragment: what URLs are equal by."""

    def of(x: Column) -> Column:
        user = F.when(x["userinfo"] == "", F.lit("")).otherwise(F.concat(x["userinfo"], F.lit("@")))
        front = F.when(x["host"] == "", F.lit("")).otherwise(F.concat(F.lit("//"), user, authority(x)))
        query = F.when(x["query"].isNull(), F.lit("")).otherwise(F.concat(F.lit("?"), x["query"]))
        return F.concat(x["scheme"], F.lit(":"), front, x["path"], query)

    return let(u, of)


def to_text(u: Column) -> Column:
    return F.concat(url_key(u), F.when(u["fragment"].isNull(), F.lit("")).otherwise(F.concat(F.lit("#"), u["fragment"])))


def same_origin(a: Column, b: Column) -> Column:
    return (a["scheme"] == b["scheme"]) & (a["host"] == b["host"]) & (effective_port(a) == effective_port(b))


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or one a subdomain of the other."""
    dotted = lambda x: F.concat(F.lit("."), x)
    under = F.when(F.octet_length(a) > F.octet_length(b), iends_with(a, dotted(b))).otherwise(iends_with(b, dotted(a)))
    return (a == b) | ((a != "") & (b != "") & under)


def is_non_fetchable(reference: Column) -> Column:
    def of(r: Column) -> Column:
        return (r == "") | F.startswith(r, F.lit("#")) | F.exists(F.array(*[F.lit(p) for p in NOT_FETCHED]), lambda p: F.startswith(to_lower(r), p))

    return let(strip_whitespace(reference), of)


def is_private_host(host: Column) -> Column:
    """Names and addresses of the machine itself or of private networks; also names without a dot."""
    quad = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"

    def four(h: Column) -> Column:
        a, b, c, d = (F.coalesce(F.nullif(F.regexp_extract(h, quad, k), F.lit("")).cast("int"), F.lit(0)) for k in (1, 2, 3, 4))
        private = a.isin(127, 10, 0) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
        return F.when(h.rlike(quad), F.greatest(a, b, c, d) <= 255).otherwise(False) & private

    def named(h: Column) -> Column:
        local = (h == "localhost") | h.rlike(r"\.(localhost|local|internal|home\.arpa)$")
        return (h == "") | local | F.when(F.size(split_on(h, ".")) == 4, four(h)).otherwise(~F.contains(h, F.lit(".")))

    def of(h: Column) -> Column:
        own = h.isin("::1", "::") | h.rlike(r"^(fc|fd|fe[89ab])")
        mapped = F.contains(h, F.lit(".")) & let(F.substring_index(h, ":", -1), named)
        return F.when(F.contains(h, F.lit(":")), own | mapped).otherwise(named(h))

    return let(to_lower(trim(host)), of)


def normalise_target(text: Column) -> Column:
    """A target as a parsed http URL: a bare host gets https; null for other schemes."""

    def of(t: Column) -> Column:
        return let(parse(F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), t).otherwise(F.concat(F.lit("https://"), t))), lambda u: F.when(is_http(u), u))

    return let(trim(text), of)


def looks_like_url(text: Column) -> Column:
    return text.rlike(r"(?i)^https?://") | (F.contains(text, F.lit(".")) & ~F.contains(text, F.lit(" ")) & ~text.rlike(r"^[-./]"))
