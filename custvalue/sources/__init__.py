"""Input schemas, readers and writers."""

from custvalue.sources.readers import read_contacts, read_geo, read_transactions
from custvalue.sources.schemas import CONTACTS, GEO, TRANSACTIONS
from custvalue.sources.venues import venue_coordinates, venue_names
from custvalue.sources.writers import read_json, read_table, write_json, write_table

__all__ = [
    "CONTACTS",
    "GEO",
    "TRANSACTIONS",
    "read_contacts",
    "read_geo",
    "read_json",
    "read_table",
    "read_transactions",
    "venue_coordinates",
    "venue_names",
    "write_json",
    "write_table",
]
