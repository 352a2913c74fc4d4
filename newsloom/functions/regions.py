"""Country name to news region."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The countries with a region of their own; all others are "global".
COUNTRY_REGION = {
    "united states": "north_america",
    "canada": "north_america",
    "mexico": "north_america",
    "united kingdom": "europe",
    "france": "europe",
    "germany": "europe",
    "china": "asia",
    "japan": "asia",
    "india": "asia",
    "australia": "oceania",
    "brazil": "south_america",
    "nigeria": "africa",
    "south africa": "africa",
    "egypt": "middle_east",
    "saudi arabia": "middle_east",
    "israel": "middle_east",
}
DEFAULT_REGION = "global"


def country_region(country: Column) -> Column:
    """A literal map inside the projection: no join, and it stays in generated code."""
    table = F.create_map(*[F.lit(x) for pair in COUNTRY_REGION.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(country)), F.lit(DEFAULT_REGION))
