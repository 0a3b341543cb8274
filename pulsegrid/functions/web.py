"""Request-path and client helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths kept as they are, the collapsed prefix, and the label of everything else.
KEPT_ROUTES = ("/health", "/metrics")
API_PREFIX = "/api/"
API_ROUTE = "/api/*"
OTHER_ROUTE = "/other"
# Client names when there is no identity, or an empty one.
NO_CLIENT, EMPTY_CLIENT = "anonymous", "unknown"


def normalise_route(path: Column) -> Column:
    """Collapse paths into a handful of labels."""
    return (
        F.when(path.isin(*KEPT_ROUTES), path)
        .when(path.startswith(API_PREFIX), F.lit(API_ROUTE))
        .otherwise(F.lit(OTHER_ROUTE)))


def client_or_default(client: Column, authenticated: Column | None = None) -> Column:
    """Requests outside authentication are ``anonymous``; an empty identity is ``unknown``."""
    known = F.lit(True) if authenticated is None else F.coalesce(authenticated, F.lit(False))
    named = F.when(F.coalesce(client, F.lit("")) == "", F.lit(EMPTY_CLIENT)).otherwise(client)
    return F.when(known, named).otherwise(F.lit(NO_CLIENT))


def url_path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def status_matches(status: Column, pattern: str) -> Column:
    """Label match on the whole status text, e.g. ``5..``."""
    return status.cast("string").rlike(f"^(?:{pattern})$")


def gated(path: Column) -> Column:
    """Whether the rate limiter looks at a path at all."""
    return ~path.isin(*KEPT_ROUTES)
