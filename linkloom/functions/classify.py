"""Kinds of resources, from content types and extensions, and outcomes of responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.text import let, to_lower, trim

# Extension, content type, kind; the first extension of a content type is its usual one.
MIME = [
    (".html", "text/html", "html"), (".htm", "text/html", "html"), (".xhtml", "application/xhtml+xml", "html"),
    (".css", "text/css", "css"), (".js", "text/javascript", "js"), (".mjs", "text/javascript", "js"), (".cjs", "text/javascript", "js"),
    (".json", "application/json", "other"), (".map", "application/json", "other"), (".webmanifest", "application/manifest+json", "manifest"),
    (".xml", "application/xml", "other"), (".txt", "text/plain", "other"),
    (".svg", "image/svg+xml", "image"), (".png", "image/png", "image"), (".jpg", "image/jpeg", "image"), (".jpeg", "image/jpeg", "image"),
    (".gif", "image/gif", "image"), (".webp", "image/webp", "image"), (".avif", "image/avif", "image"), (".bmp", "image/bmp", "image"),
    (".ico", "image/x-icon", "image"), (".woff", "font/woff", "font"), (".woff2", "font/woff2", "font"), (".ttf", "font/ttf", "font"),
    (".otf", "font/otf", "font"), (".eot", "application/vnd.ms-fontobject", "font"),
    (".mp4", "video/mp4", "media"), (".webm", "video/webm", "media"), (".ogv", "video/ogg", "media"), (".mp3", "audio/mpeg", "media"),
    (".ogg", "audio/ogg", "media"), (".wav", "audio/wav", "media"), (".m4a", "audio/mp4", "media"), (".flac", "audio/flac", "media"),
    (".pdf", "application/pdf", "other"), (".zip", "application/zip", "other"), (".wasm", "application/wasm", "other"),
]
_TEXTUAL = (".json", ".txt", ".xml", ".map", ".webmanifest")
# Content types that are a kind by themselves.
_EXACT = {
    "text/html": "html", "application/xhtml+xml": "html", "text/css": "css",
    "text/javascript": "js", "application/javascript": "js", "application/x-javascript": "js", "text/ecmascript": "js", "application/ecmascript": "js",
    "application/manifest+json": "manifest",
    "application/font-woff": "font", "application/x-font-ttf": "font", "application/vnd.ms-fontobject": "font",
}
_ALIASES = {"application/javascript": ".js", "application/x-javascript": ".js", "image/jpg": ".jpg", "image/vnd.microsoft.icon": ".ico"}
# Phrases of statuses.
PHRASES = {
    400: "bad request", 401: "unauthorised", 403: "forbidden", 404: "not found", 408: "request timeout", 410: "gone",
    429: "rate limited", 500: "server error", 502: "bad gateway", 503: "service unavailable", 504: "gateway timeout",
}
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), key)


def essence(content_type: Column) -> Column:
    return to_lower(trim(F.substring_index(content_type, ";", 1)))


def _extension(extension: Column) -> Column:
    return let(to_lower(trim(extension)), lambda e: F.when((e == "") | F.startswith(e, F.lit(".")), e).otherwise(F.concat(F.lit("."), e)))


def kind_from_content_type(content_type: Column) -> Column:
    def of(e: Column) -> Column:
        prefix = F.when(e.rlike("^image/"), "image").when(e.rlike("^font/"), "font").when(e.rlike("^(video|audio)/"), "media")
        return F.coalesce(_lookup({k: v for k, v in _EXACT.items() if v != "font"}, e), prefix, _lookup(_EXACT, e), F.lit("other"))

    return let(essence(content_type), of)


def kind_from_extension(extension: Column) -> Column:
    return F.coalesce(_lookup({e: k for e, _, k in MIME}, _extension(extension)), F.lit("other"))


def extension_for_content_type(content_type: Column) -> Column:
    first = {t: e for e, t, _ in reversed(MIME)}
    return F.coalesce(_lookup(_ALIASES | first, essence(content_type)), F.lit(""))


def content_type_for_extension(extension: Column) -> Column:
    full = {e: t + ("; charset=utf-8" if k in ("html", "css", "js") or e in _TEXTUAL else "") for e, t, k in MIME}
    return F.coalesce(_lookup(full, _extension(extension)), F.lit("application/octet-stream"))


def url_extension(path: Column) -> Column:
    """The extension of a URL path's last segment, of at most eight characters with its dot; else empty."""
    return F.regexp_extract(path, r"(\.[^./]{0,7})$", 1)


def classify(content_type: Column, final_path: Column, role: Column) -> Column:
    """By content type, else by the final URL's extension, else html for navigation."""
    by_type = F.nullif(kind_from_content_type(content_type), F.lit("other"))
    by_extension = F.nullif(kind_from_extension(url_extension(final_path)), F.lit("other"))
    return F.coalesce(by_type, by_extension, F.when(role == "navigation", "html"), F.lit("other"))


def status_phrase(status: Column) -> Column:
    return F.coalesce(_lookup(PHRASES, status.cast("int")), F.concat(F.lit("http "), status.cast("string")))


def is_retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def backoff_ms(attempt: Column) -> Column:
    """The wait before retry number attempt: 250 ms, doubled each time, 8 s at most."""
    return F.least(F.lit(8000), 250 * F.pow(F.lit(2), F.least(attempt, F.lit(12)) - 1)).cast("long")


def outcome(status: Column, error: Column, truncated: Column) -> Column:
    """state and note of a response."""
    ok = status.between(200, 299)
    state = F.when(error != "", "failed").when(status == 304, "unchanged").when(~ok, "failed").when(truncated, "skipped").otherwise("done")
    note = F.when(error != "", error).when(status == 304, "").when(~ok, status_phrase(status)).when(truncated, "exceeds --max-file-size").otherwise("")
    return F.struct(state.alias("state"), note.alias("note"))
