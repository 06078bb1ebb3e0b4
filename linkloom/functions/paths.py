"""Deterministic local paths for URLs, and links between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import url as U
from linkloom.functions.text import let, percent_decode, percent_encode, short_hash, split_on, to_lower

# Device names that no component may have.
RESERVED = ("con", "prn", "aux", "nul", *(f"{d}{k}" for d in ("com", "lpt") for k in range(1, 10)))
LINK_SAFE = "!$()*+,;=:@-._~"
# The most bytes of a component and of the extension that a cut one keeps, of a path, and of the start of a longer one;
# the bytes of an extension in a file name, with its dot; the names of folders and files that URLs don't give.
COMPONENT_BYTES, KEPT_EXTENSION_BYTES, PATH_BYTES, START_BYTES, EXTENSION_BYTES = 180, 16, 200, 120, 12
INDEX_NAME, EXTERNAL_DIR, LONG_DIR = "index.html", "_external", "_long"


def _cut(s: Column, n: Column | int) -> Column:
    """The first n bytes; a code point cut in two becomes U+FFFD."""
    data = F.encode(s, "UTF-8")
    return F.make_valid_utf8(F.substring(data, F.lit(1), n if isinstance(n, Column) else F.lit(n)).cast("string"))


def sanitize_component(component: Column) -> Column:
    """A name that every common file system takes, and that climbs nowhere."""

    def cleaned(c: Column) -> Column:
        return F.when(c == ".", F.lit("_dot")).when(c == "..", F.lit("_dotdot")).otherwise(let(F.regexp_replace(c, r"[. ]+$", ""), lambda t: marked(c, t)))

    def marked(c: Column, t: Column) -> Column:
        return let(F.when(c == t, t).otherwise(F.concat(t, F.lit("_"))), safe)

    def safe(x: Column) -> Column:
        device = to_lower(F.substring_index(x, ".", 1)).isin(*RESERVED)
        return let(F.when(device, F.concat(F.lit("_"), x)).when(x == "", F.lit("_")).otherwise(x), short)

    def short(x: Column) -> Column:
        extension = F.regexp_extract(x, r"(\.[^.]*)$", 1)
        kept = F.when(F.octet_length(extension) <= KEPT_EXTENSION_BYTES, extension).otherwise(F.lit(""))
        return F.when(F.octet_length(x) > COMPONENT_BYTES, F.concat(_cut(x, F.lit(COMPONENT_BYTES) - F.octet_length(kept)), kept)).otherwise(x)

    return let(F.regexp_replace(component, r'[\x00-\x1F<>:"/\\|?*\x7F]', "_"), cleaned)


def _stem_and_extension(name: Column) -> tuple[Column, Column]:
    """Cut at the last dot, unless it leads or more than eleven bytes follow it."""
    tail = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    extension = F.when((tail != "") & (F.octet_length(tail) <= EXTENSION_BYTES), tail).otherwise(F.lit(""))
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension)), extension


def relative_path(u: Column, kind: Column, primary: Column, index_name: str = INDEX_NAME, external_dir: str = EXTERNAL_DIR) -> Column:
    """The path of a resource under the mirror's root."""
    return let(u, lambda v: _relative_path(v, kind, primary, index_name, external_dir))


def _relative_path(u: Column, kind: Column, primary: Column, index_name: str, external_dir: str) -> Column:
    host = F.concat(u["host"], F.when(u["port"] != 0, F.concat(F.lit("_"), u["port"].cast("string"))).otherwise(F.lit("")))
    host = F.when(u["scheme"] == "https", host).otherwise(F.concat(u["scheme"], F.lit("_"), host))
    foreign = F.coalesce(primary["host"] != "", F.lit(False)) & ~F.coalesce(U.same_origin(u, primary), F.lit(False))
    front = F.when(foreign, F.array(sanitize_component(F.lit(external_dir)), sanitize_component(host))).otherwise(F.array().cast("array<string>"))
    path = F.when(u["path"] == "", F.lit("/")).otherwise(u["path"])
    parts = F.transform(split_on(path, "/", keep_empty=False), lambda p: sanitize_component(percent_decode(p)))

    def named(all_parts: Column) -> Column:
        bare = F.endswith(path, F.lit("/")) | (F.size(all_parts) == 0)
        folders = F.when(bare, all_parts).otherwise(F.slice(all_parts, 1, F.size(all_parts) - 1))
        leaf = let(F.when(bare, F.lit(index_name)).otherwise(F.element_at(all_parts, -1)), file_name)
        return let(F.concat_ws("/", F.array_join(F.concat(folders, F.array(leaf)), "/")), lambda r: bounded(r, leaf))

    def file_name(name: Column) -> Column:
        stem, extension = _stem_and_extension(name)
        query = F.when(F.coalesce(u["query"], F.lit("")) != "", F.concat(F.lit("@"), short_hash(u["query"]))).otherwise(F.lit(""))
        html = to_lower(extension).rlike(r"\.(html|htm|xhtml)$")
        by_kind = F.when(kind == "css", ".css").when(kind == "js", ".js").when(kind == "manifest", ".webmanifest").otherwise("")
        tail = F.when((kind == "html") & ~html, F.concat(extension, F.lit(".html"))).when(extension == "", by_kind).otherwise(extension)
        return let(F.concat(stem, query), lambda s: sanitize_component(F.concat(F.when((s == "") & ~((kind == "html") & (extension != "") & ~html), F.lit("index")).otherwise(s), tail)))

    def bounded(relative: Column, leaf: Column) -> Column:
        _, extension = _stem_and_extension(leaf)
        start = let(_cut(relative, START_BYTES), lambda p: F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, r"(?s)/[^/]*$", "")).otherwise(p))
        return F.when(F.octet_length(relative) > PATH_BYTES, F.concat(start, F.lit(f"/{LONG_DIR}/"), short_hash(relative), extension)).otherwise(relative)

    return let(F.concat(front, parts), lambda p: F.when(u.isNotNull(), named(p)))


def relative_link(source: Column, target: Column) -> Column:
    """A link from one local path to another, percent-encoded."""

    def of(a: Column, b: Column) -> Column:
        dirs = F.greatest(F.size(a) - 1, F.lit(0))
        most = F.least(dirs, F.greatest(F.size(b) - 1, F.lit(0)))
        # How many leading folders are shared: up to the first place where they differ.
        differ = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: (k > most) | (F.get(a, k - 1) != F.get(b, k - 1)))
        return let(F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, most), lambda common: build(a, b, dirs, common))

    def build(a: Column, b: Column, dirs: Column, common: Column) -> Column:
        down = F.transform(F.slice(b, common + 1, F.greatest(F.size(b) - common, F.lit(0))), lambda p: percent_encode(p, LINK_SAFE))
        parts = F.concat(F.array_repeat(F.lit(".."), dirs - common), down)
        return F.when(F.size(parts) == 0, F.lit(".")).otherwise(F.array_join(parts, "/"))

    return let(split_on(source, "/", False), lambda a: let(split_on(target, "/", False), lambda b: of(a, b)))


def absolute_path(root: str, relative: Column) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.array_join(split_on(relative, "/", False), "/"))


def default_output_directory(u: Column) -> Column:
    """The folder that a mirror of a URL goes to: its host, with its port if it names one."""
    name = F.when(u["host"] == "", F.lit("mirror")).otherwise(u["host"])
    return sanitize_component(F.concat(name, F.when(u["port"] != 0, F.concat(F.lit("_"), u["port"].cast("string"))).otherwise(F.lit(""))))


def is_inside(root: Column, candidate: Column) -> Column:
    """Whether a path lies under a root, after . and .. are worked out."""
    clean = lambda p: F.regexp_replace(U.remove_dot_segments(p), "/$", "")
    return let(clean(root), lambda r: let(clean(candidate), lambda c: (c == r) | F.startswith(c, F.concat(r, F.lit("/")))))


def raw_copy_path(key: Column, kind: Column) -> Column:
    """Where the unrewritten body of a resource is kept."""
    extension = F.when(kind == "html", ".html").when(kind == "css", ".css").when(kind == "manifest", ".json").otherwise(".bin")
    return F.concat(F.lit(".mirror/raw/"), F.substring(F.sha2(F.encode(key, "UTF-8"), 256), 1, 32), extension)
