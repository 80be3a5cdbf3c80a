"""URL expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that track or present a page without changing which page it is.
PRESENTATION_PARAMETERS = r"utm_\w+|ref|referrer|source|print|fbclid|gclid|share|session|sid|amp"
# Parameters at their default, which address the page itself.
DEFAULT_PARAMETERS = r"page=1|p=1|start=0|offset=0"


def canonical_page(url: Column) -> Column:
    """One text for all spellings of a page's address: no scheme, ``www.``, default port, fragment, tracking parameter,
    default page number, repeated or final slash; case folded; other parameters sorted. Null and blank urls give null."""
    u = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    u = F.regexp_replace(u, r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^[^/?]*", 0), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), "/+", "/"), r"/(index\.html?)?$", "")
    query = F.filter(
        F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(rf"^(({PRESENTATION_PARAMETERS})(=.*)?|{DEFAULT_PARAMETERS})$")
    )
    tail = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(F.lit(""))
    return F.when(F.length(F.trim(url)) > 0, F.concat(F.regexp_replace(host, r"\.$", ""), path, tail))
