"""Scalar functions on URLs and text; all of them are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
# Schemes whose references resolve hierarchically.
_HIERARCHICAL = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "rtsp",
                 "rtsps", "rtspu", "prospero", "sftp", "svn", "svn+ssh", "ws", "wss"]


def is_url_valid(url: Column) -> Column:
    """Scheme and authority are both present; leading blanks do not count, half a bracket pair does."""
    bare = F.regexp_replace(url, r"^[\x00-\x20]+", "")
    authority = F.regexp_extract(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    paired = F.contains(authority, F.lit("[")) == F.contains(authority, F.lit("]"))
    return F.coalesce((authority != "") & paired, F.lit(False))


def ensure_scheme(url: Column) -> Column:
    has_one = F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))
    return F.when(has_one, url).otherwise(F.concat(F.lit("https://"), url))


def safe_filename(url: Column, strict: bool = False) -> Column:
    """URL without scheme, usable as a file name; ``strict`` also replaces colons."""
    bare = F.replace(F.replace(url, F.lit("https://")), F.lit("http://"))
    return F.translate(bare, "/:", "__") if strict else F.translate(bare, "/", "_")


def clean_text(text: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed, NULL becomes empty."""
    spaces = r"[\s\x1c-\x1f\x85\p{Z}]+"
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), spaces, " "))


def escape_html(line: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        line = F.replace(line, F.lit(raw), F.lit(safe))
    return line


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it by name in ``body``; keeps expression trees small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _url_parts(url: Column) -> Column:
    """The five parts of a URL reference; an absent part is the empty string."""
    rest = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?"
    patterns = {
        "netloc": rest + r"//([^/?#]*)",
        "path": rest + r"(?://[^/?#]*)?([^?#]*)",
        "query": r"^[^?#]*\?([^#]*)",
        "fragment": r"^[^#]*#([\s\S]*)",
    }
    scheme = F.lower(F.regexp_extract(url, _SCHEME, 1)).alias("scheme")
    return F.struct(scheme, *[F.regexp_extract(url, p, 1).alias(k) for k, p in patterns.items()])


def _resolve_path(base: Column, path: Column) -> Column:
    """Merge a relative path with the base path and remove dot segments."""
    base_dir = F.regexp_extract(base, r"^(.*/)?[^/]*$", 1)
    merged = F.when(F.startswith(path, F.lit("/")), path).otherwise(
        F.concat(F.coalesce(F.nullif(base_dir, F.lit("")), F.lit("/")), path)
    )
    return let(F.split(merged, "/"), lambda raw: _drop_dots(raw, path))


def _drop_dots(raw: Column, path: Column) -> Column:
    last = F.element_at(raw, -1)
    # inside a path joined to a base, empty segments collapse; in an absolute path they stay
    inner = F.slice(raw, 2, F.greatest(F.size(raw) - 2, F.lit(0)))
    inner = F.when(F.startswith(path, F.lit("/")), inner).otherwise(F.filter(inner, lambda s: s != ""))
    middle = F.concat(F.array(F.element_at(raw, 1)), inner)
    parts = F.when(F.size(raw) > 1, F.concat(middle, F.array(last))).otherwise(raw)
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        empty,
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))),
    )
    closing = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(empty)
    joined = F.array_join(F.concat(kept, closing), "/")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("/"))


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """Resolve a URL reference against a base URL (RFC 3986, as common URL libraries do)."""
    if base is None:
        return url
    resolved = let(_url_parts(url), lambda u: let(_url_parts(base), lambda b: _resolve(url, u, b)))
    return (
        F.when(F.coalesce(base, F.lit("")) == "", url)
        .when(F.coalesce(url, F.lit("")) == "", base)
        .otherwise(resolved)
    )


def _resolve(url: Column, u: Column, b: Column) -> Column:
    scheme = F.coalesce(F.nullif(u["scheme"], F.lit("")), b["scheme"])
    own = u["netloc"] != ""
    same_document = ~own & (u["path"] == "")
    target = F.struct(
        scheme.alias("scheme"),
        F.when(own, u["netloc"]).otherwise(b["netloc"]).alias("netloc"),
        F.when(own, u["path"])
        .when(same_document, b["path"])
        .otherwise(_resolve_path(b["path"], u["path"]))
        .alias("path"),
        F.when(same_document & (u["query"] == ""), b["query"]).otherwise(u["query"]).alias("query"),
        u["fragment"].alias("fragment"),
    )
    foreign = (scheme != b["scheme"]) | ~scheme.isin(_HIERARCHICAL)
    return F.when(foreign, url).otherwise(let(target, _compose))


def _compose(t: Column) -> Column:
    scheme, netloc, path, query = t["scheme"], t["netloc"], t["path"], t["query"]
    bare_authority = scheme.isin(_HIERARCHICAL[1:]) & ((path == "") | F.startswith(path, F.lit("/")))
    rooted = F.when((netloc != "") & (path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when((netloc != "") | bare_authority, F.concat(F.lit("//"), netloc)).otherwise(""),
        rooted.otherwise(path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(t["fragment"] != "", F.concat(F.lit("#"), t["fragment"])).otherwise(""),
    )
