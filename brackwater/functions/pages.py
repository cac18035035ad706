"""What the shape of an address tells: assets, listings, single notices."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from brackwater.functions import urls

#: Markers of static files in a path.
ASSET_MARKERS = (
    "/assets/", "/static/", "/files/", "/media/", "/css/", "/js/", "/image", "/icon", "/font", "/siteglobals/",
)
#: Last segments of listing pages, and the ending of generated ones.
INDEX_NAMES = ("index.html", "home.html", "home_node.html")
INDEX_ENDING = "_node.html"
#: Rows under one prefix that make a hub; the most points for a hub and for a cluster of notices.
HUB_LEAST, HUB_MOST, CLUSTER_LEAST, CLUSTER_MOST = 3, 12, 2, 8

ASSET_PATTERN = "|".join(re.escape(m) for m in ASSET_MARKERS)
LONG_ID, ID_LIKE = r"\d{4,}", r"\d{3,}|[a-zA-Z]{1,6}-\w*\d"


def slashed(u: Column) -> Column:
    """The path in lower case with a closing slash."""
    p = F.lower(urls.path(u))
    return F.when(F.endswith(p, F.lit("/")), p).otherwise(F.concat(p, F.lit("/")))


def asset(u: Column) -> Column:
    return slashed(u).rlike(ASSET_PATTERN)


def _last(parts: Column) -> Column:
    return F.when(F.size(parts) > 0, F.element_at(parts, -1))


def _index(name: Column) -> Column:
    return name.isin(*INDEX_NAMES) | F.endswith(name, F.lit(INDEX_ENDING))


def long_numeric(parts: Column) -> Column:
    """A segment holds four digits in a row."""
    return F.exists(parts, lambda x: x.rlike(LONG_ID))


def id_like(parts: Column) -> Column:
    """A segment, without its file ending, looks like a number or a mark of a notice."""
    return F.exists(parts, lambda x: F.regexp_replace(x, r"\.[^.]*$", "").rlike(ID_LIKE))


def detail(u: Column) -> Column:
    """One notice: by depth, number or mark."""
    parts, size = urls.path_parts(u), F.size(urls.path_parts(u))
    signs = [
        F.startswith(F.get(parts, F.lit(0)), F.lit("___")) & (size >= 3),
        (size >= 3) & id_like(parts),
        long_numeric(parts),
        F.endswith(_last(parts), F.lit(".html")) & (size >= 3),
        size >= 4,
    ]
    return F.coalesce((size >= 2) & ~asset(u) & ~_index(_last(parts)) & reduce(or_, signs), F.lit(False))


def listing(u: Column) -> Column:
    """An index or section root."""
    parts = urls.path_parts(u)
    shape = _index(_last(parts)) | ((F.size(parts) <= 2) & ~long_numeric(parts))
    return F.coalesce(~detail(u) & ~asset(u) & (F.size(parts) > 0) & shape, F.lit(False))


def probable_detail(u: Column) -> Column:
    """A notice by looser rules."""
    parts = urls.path_parts(u)
    loose = (F.size(parts) >= 2) & ~_index(_last(parts)) & ((F.size(parts) >= 3) | id_like(parts))
    return F.coalesce(detail(u) | (~listing(u) & ~asset(u) & loose), F.lit(False))


def prefix(parts: Column, n: int) -> Column:
    """The first ``n`` segments between slashes; null if there are fewer."""
    return F.when(F.size(parts) >= n, F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))


def path_start(u: Column, n: int) -> Column:
    """The first ``n`` segments of the path as written; blank if there are fewer."""
    return F.regexp_extract(slashed(u), "^((?:/[^/]+){%d}/)" % n, 1)


def under_prefix(u: Column, start: Column) -> Column:
    """The path equals the prefix or lies under it."""
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    return F.startswith(slashed(u), start) | (bare(start) == bare(F.lower(urls.path(u))))


def fragments(parts: Column) -> Column:
    """Path prefixes by which notices cluster, each once."""
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    between = lambda *c: F.concat(F.lit("/"), F.concat_ws("/", *c), F.lit("/"))
    portal = F.startswith(first, F.lit("___"))
    two = F.size(parts) >= 2
    found = F.array(
        F.when(portal, between(first)), F.when(portal & two, between(first, second)), F.when(portal & two, between(second)),
        F.when(two, between(first, second)), F.when(F.size(parts) >= 1, between(first)),
    )
    return F.array_distinct(F.array_compact(found))


def normalized_fragments(values: Column) -> Column:
    """Stated path fragments in lower case with an opening slash; addresses give their path, blanks go."""
    tidy = F.transform(values, lambda x: F.lower(F.trim(x)))
    tidy = F.filter(tidy, lambda x: x != "")
    tidy = F.transform(tidy, lambda x: F.when(x.rlike("^https?://"), urls.path(x)).otherwise(x))
    tidy = F.transform(tidy, lambda x: F.when(F.startswith(x, F.lit("/")), x).otherwise(F.concat(F.lit("/"), x)))
    return F.array_distinct(F.filter(tidy, lambda x: F.length(x) >= 2))


def listing_score(u: Column, hub: Column) -> Column:
    """Points of a link as a listing; ``hub`` are the points of :func:`brackwater.operators.links.hub_points`."""
    size = F.size(urls.path_parts(u))
    shape = F.when(detail(u), -10).when(listing(u), 8).when(size <= 2, 2).otherwise(0)
    root = F.when(F.lower(urls.path(u)).isin("", "/"), -1).otherwise(0)
    return F.when(asset(u), -20).otherwise(root + shape + F.when(size >= 4, -3).otherwise(0) + hub)


def detail_score(u: Column, cluster: Column) -> Column:
    """Points of a link as a notice; ``cluster`` are the points of its neighbours."""
    parts = urls.path_parts(u)
    shape = F.when(probable_detail(u), 20).when(listing(u), -8).otherwise(0)
    more = F.when(F.size(parts) >= 3, 3).otherwise(0) + F.when(id_like(parts), 4).otherwise(0) + F.when(F.lower(urls.path(u)).rlike(r"\d{3,}"), 2).otherwise(0)
    return F.when(asset(u), -20).otherwise(shape + more + cluster)
