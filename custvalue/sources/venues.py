"""Default coordinates of the known venues, for callers who bring no table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custvalue.sources.schemas import GEO

# Venue name, latitude, longitude (degrees, three decimals).
VENUES = (
    ("Brasserie Blanc Bath", 51.471, -2.244),
    ("Brasserie Blanc Beaconsfield", 51.606, -0.623),
    ("Brasserie Blanc Bournemouth", 50.715, -1.882),
    ("Brasserie Blanc Bristol", 51.457, -2.587),
    ("Brasserie Blanc Chancery Lane", 51.515, -0.111),
    ("Brasserie Blanc Cheltenham", 51.897, -2.08),
    ("Brasserie Blanc Chichester", 50.837, -0.773),
    ("Brasserie Blanc Hale Barns", 53.364, -2.297),
    ("Brasserie Blanc Knutsford", 53.305, -2.373),
    ("Brasserie Blanc Leeds", 53.793, -1.544),
    ("Brasserie Blanc Milton Keynes", 52.037, -0.762),
    ("Brasserie Blanc Oxford", 51.761, -1.267),
    ("Brasserie Blanc Portsmouth", 50.796, -1.103),
    ("Brasserie Blanc Southbank", 51.506, -0.114),
    ("Brasserie Blanc Threadneedle Street", 51.514, -0.086),
    ("Brasserie Blanc Tower of London", 51.512, -0.071),
    ("Brasserie Blanc Winchester", 51.065, -1.315),
    ("Fulham Reach", 51.488, -0.226),
    ("Reigate", 51.237, -0.206),
    ("The Barley Mow", 51.244, -0.005),
    ("The Black Horse - Reigate", 51.24, -0.22),
    ("The Black Horse - Thame", 51.747, -0.977),
    ("The Boot", 51.97, -0.855),
    ("The British Queen", 52.131, 0.246),
    ("The Cricketers", 51.03, -0.958),
    ("The Hare", 51.778, 0.382),
    ("The Highwayman", 52.238, -0.156),
    ("The Jobber's Rest", 51.558, 0.274),
    ("The Jolly Farmer", 51.655, -0.107),
    ("The King's Arms", 51.807, -0.492),
    ("The Kings Head", 51.47, -0.521),
    ("The March Hare", 51.278, -0.511),
    ("The Oaks", 51.67, -0.497),
    ("The Oakwood", 51.429, -0.935),
    ("The Queens Head", 51.385, -0.56),
    ("The Red Deer", 51.063, -0.326),
    ("The Sun Inn", 51.372, -0.468),
    ("The Victoria", 51.507, -0.945),
    ("The White Bear", 51.546, -0.025),
)

# Fixed value: the venue a report shows when none is asked for.
DEFAULT_LOCATION = "The Sun Inn"


def venue_coordinates(spark: SparkSession) -> DataFrame:
    """The known venues as a coordinates table."""
    return spark.createDataFrame(list(VENUES), GEO)


def venue_names(spark: SparkSession) -> DataFrame:
    """The names of the known venues; ``overview.locations`` lists those present in the data."""
    return venue_coordinates(spark).select(F.col("location"))
