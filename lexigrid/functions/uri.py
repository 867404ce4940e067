"""URI canonicalization and crawl predicates as Column functions; what can't be canonicalized is null."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

Step = Callable[[Column], Column]
#: The parts of a hierarchical URI: scheme, authority, path, query, fragment.
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
PORTS = {"http": "80", "https": "443"}


def _part(uri: Column, i: int) -> Column:
    return F.regexp_extract(uri, PARTS, i)


def scheme(uri: Column) -> Column:
    return F.lower(_part(uri, 1))


def authority(uri: Column) -> Column:
    return _part(uri, 2)


def host(uri: Column) -> Column:
    """The host, without user and port, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(authority(uri), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def path(uri: Column) -> Column:
    return _part(uri, 3)


def query(uri: Column) -> Column:
    return F.regexp_replace(_part(uri, 4), r"^\?", "")


def is_hierarchical(uri: Column) -> Column:
    """Whether it is an absolute URI with an authority or a path from the root (data: and mailto: aren't)."""
    return F.coalesce(uri.rlike(PARTS) & ((authority(uri) != "") | path(uri).startswith("/")), F.lit(False))


def build(uri: Column, *, scheme_: Column | None = None, authority_: Column | None = None, path_: Column | None = None, query_: Column | None = None, fragment_: Column | None = None) -> Column:
    """The URI with some parts replaced; query_ is without its question mark, an empty one is left out."""
    own = authority(uri) if authority_ is None else authority_
    mark = _part(uri, 4) if query_ is None else F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise("")
    parts = [_part(uri, 1) if scheme_ is None else scheme_, F.lit(":"), F.when(own != "", F.concat(F.lit("//"), own)).otherwise(""), path(uri) if path_ is None else path_, mark, _part(uri, 5) if fragment_ is None else fragment_]
    return F.when(uri.rlike(PARTS), F.concat(*parts))


def remove_fragment(uri: Column) -> Column:
    return F.regexp_replace(uri, "#.*$", "")


def lowercase_scheme_and_host(uri: Column) -> Column:
    user = F.regexp_extract(authority(uri), r"^([^@]*@)", 1)
    return build(uri, scheme_=scheme(uri), authority_=F.concat(user, F.lower(F.regexp_replace(authority(uri), r"^[^@]*@", ""))))


def remove_default_port(uri: Column) -> Column:
    default = reduce(lambda found, p: found | ((scheme(uri) == p[0]) & authority(uri).endswith(":" + p[1])), PORTS.items(), F.lit(False))
    return build(uri, authority_=F.when(default, F.regexp_replace(authority(uri), r":\d+$", "")).otherwise(authority(uri)))


def normalized_path(p: Column) -> Column:
    """Without `.` and empty segments, `..` taking the segment before it away; a slash at the end stays."""
    segments = F.split(p, "/")
    text = "array<string>"

    def push(stack: Column, s: Column) -> Column:
        above = (F.size(stack) > 0) & (F.element_at(stack, -1) != "..")
        up = F.when(above, F.slice(stack, F.lit(1), F.size(stack) - 1)).otherwise(F.concat(stack, F.array(s)))
        return F.when((s == "") | (s == "."), stack).when((s == "..") & (F.size(stack) > 0), up).when(s == "..", F.array(s)).otherwise(F.concat(stack, F.array(s)))

    kept = F.aggregate(segments, F.array().cast(text), push)
    slash = p.rlike(r"(^|/)(\.{1,2})?$") & (F.size(kept) > 0)
    return F.when(p == "", "").otherwise(F.concat(F.when(p.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"), F.when(slash, "/").otherwise("")))


def normalize_path(uri: Column) -> Column:
    return build(uri, path_=normalized_path(path(uri)))


def _parameters(uri: Column) -> Column:
    return F.filter(F.split(query(uri), "&"), lambda p: F.trim(p) != "")


def sort_query_parameters(uri: Column) -> Column:
    """Parameters in order of their text, repeated ones kept, blank ones dropped; no parameters: no question mark."""
    return build(uri, query_=F.array_join(F.array_sort(_parameters(uri)), "&"))


def drop_parameters(prefix: str) -> Step:
    """A step that drops the parameters that start with a prefix."""
    return lambda uri: build(uri, query_=F.array_join(F.filter(_parameters(uri), lambda p: ~p.startswith(prefix)), "&"))


def drop_trailing_index(uri: Column) -> Column:
    """A step that turns a path that ends in /index into its parent."""
    short = F.regexp_replace(path(uri), "/index$", "")
    return build(uri, path_=F.when(path(uri).endswith("/index"), F.when(short == "", "/").otherwise(short)).otherwise(path(uri)))


STEPS: tuple[Step, ...] = (remove_fragment, lowercase_scheme_and_host, remove_default_port, normalize_path, sort_query_parameters)


def applied(step: Step, value: Column) -> Column:
    """step(value), the value being worked out once however often the step refers to it.

    A chain of steps written into each other would grow by a power of the number of references.
    """
    return F.get(F.transform(F.array(value), step), F.lit(0))


def canonicalizer(*custom: Step) -> Step:
    """The default steps, then custom ones. Percent-escapes are never decoded or encoded anew, so it is idempotent."""
    return lambda uri: reduce(lambda u, step: applied(step, u), (*STEPS, *custom), F.when(is_hierarchical(uri), uri))


canonicalize = canonicalizer()


def normalize_uri(uri: Column) -> Column:
    """Trimmed, in lower case, without fragment, the path normalized; null if it isn't an absolute URI."""
    return applied(normalize_path, applied(lambda u: F.when(is_hierarchical(u), remove_fragment(F.lower(u))), F.trim(uri)))


def is_http(uri: Column) -> Column:
    return F.coalesce(scheme(uri).isin("http", "https"), F.lit(False))


def is_allowed(uri: Column, root: Column, *, allowed: Iterable[str] = (), same_domain: bool = True, external: bool = False) -> Column:
    """Whether the host passes the rules: in the allow list if there is one, the root's host if links must stay there."""
    found = host(uri) != ""
    if domains := sorted({d.lower() for d in allowed}):
        found &= host(uri).isin(domains)
    if same_domain or not external:
        found &= host(uri) == host(root)
    return F.coalesce(found, F.lit(False))


def is_disallowed_path(uri: Column, prefixes: Iterable[str] = ()) -> Column:
    return reduce(lambda found, p: found | path(uri).startswith(p), prefixes, F.lit(False))


def resolve(link: Column, base: Column) -> Column:
    """A link as an absolute URI against the page's; null if either can't be read."""
    link = F.trim(link)
    root = F.concat(_part(base, 1), F.lit("://"), authority(base))
    folder = F.when(path(base) == "", "/").otherwise(F.regexp_replace(path(base), "[^/]*$", ""))
    bare = F.regexp_extract(link, r"^([^?#]*)", 1)
    rest = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    own = F.when(path(base) == "", "/").otherwise(path(base))
    joined = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(is_hierarchical(link), applied(normalize_path, link)).otherwise(link))
        .when(link.startswith("//"), applied(normalize_path, F.concat(_part(base, 1), F.lit(":"), link)))
        .when(link.startswith("/"), F.concat(root, applied(normalized_path, bare), rest))
        .when(link.startswith("?") | link.startswith("#"), F.concat(root, own, F.when(link.startswith("#"), _part(base, 4)).otherwise(""), rest))
        .otherwise(F.concat(root, applied(normalized_path, F.concat(folder, bare)), rest))
    )
    return F.when(link == "", None).when(is_hierarchical(base), joined)
