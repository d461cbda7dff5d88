"""Locations, facilities and sections: fixed tables and a configuration reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtide.functions.text import normalize_key

# --- fixed values: (facility, location, name, floor, maximum capacity) ---------------
LOCATIONS = (
    (1186, 5761, "Nick Power House", 0, 140),
    (1186, 5764, "Nick Soderholm Family Aquatic Center", 0, 230),
    (1186, 5760, "Nick Level 1 Fitness", 1, 150),
    (1186, 7089, "Nick Courts 1 & 2", 1, 24),
    (1186, 5762, "Nick Level 2 Fitness", 2, 100),
    (1186, 5758, "Nick Level 3 Fitness", 3, 200),
    (1186, 7090, "Nick Courts 3-6", 3, 48),
    (1186, 5766, "Nick Courts 7 & 8", 3, 24),
    (1186, 5753, "Nick Racquetball Court 1", 4, 6),
    (1186, 5754, "Nick Racquetball Court 2", 4, 6),
    (1186, 5763, "Nick Track", 4, 100),
    (1656, 8718, "Bakke The Point", 1, 30),
    (1656, 8717, "Bakke Level 1 Fitness", 1, 130),
    (1656, 8720, "Bakke Courts 1&2", 1, 24),
    (1656, 8698, "Bakke Courts 5-8", 1, 48),
    (1656, 8716, "Bakke Cove Pool", 1, 116),
    (1656, 10550, "Bakke Sub Zero Ice Center", 1, 200),
    (1656, 8705, "Bakke Level 2 Fitness", 2, 65),
    (1656, 8712, "Bakke Esports Room", 2, 12),
    (1656, 8700, "Bakke Level 3 Fitness", 3, 246),
    (1656, 8714, "Bakke Courts 3&4", 3, 24),
    (1656, 8701, "Bakke Mount Mendota", 3, 39),
    (1656, 8699, "Bakke Level 4 Fitness", 4, 75),
    (1656, 8696, "Bakke Orbit", 4, 46),
    (1656, 8694, "Bakke Track", 4, 100),
    (1656, 8695, "Bakke Skybox Suites", 4, 18),
)
# Reports counts but has no place on a floor.
EXTRA_CAPACITY = ((1656, 8708, 27),)
FACILITY_NAMES = {1186: "Nicholas Recreation Center", 1656: "Bakke Recreation & Wellbeing Center"}
SECTIONS = (
    (1186, "fitness floors", "Fitness Floors", (5761, 5760, 5762, 5758)),
    (1186, "basketball courts", "Basketball Courts", (7089, 7090, 5766)),
    (1186, "racquetball courts", "Racquetball Courts", (5753, 5754)),
    (1186, "running track", "Running Track", (5763,)),
    (1186, "swimming pool", "Swimming Pool", (5764,)),
    (1656, "fitness floors", "Fitness Floors", (8718, 8717, 8705, 8700, 8699, 8696)),
    (1656, "basketball courts", "Basketball Courts", (8720, 8714, 8698)),
    (1656, "running track", "Running Track", (8694,)),
    (1656, "swimming pool", "Swimming Pool", (8716,)),
    (1656, "rock climbing", "Rock Climbing", (8701,)),
    (1656, "ice skating", "Ice Skating", (10550,)),
    (1656, "esports room", "Esports Room", (8712,)),
    (1656, "sports simulators", "Sports Simulators", (8695,)),
)
# -------------------------------------------------------------------------------------


def _text(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


def location_dimension(spark: SparkSession) -> DataFrame:
    """All 27 locations; small enough to be broadcast wherever it is joined."""
    rows = [f"({f}, {i}, {_text(n)}, {fl}, {c})" for f, i, n, fl, c in LOCATIONS]
    rows += [f"({f}, {i}, CAST(NULL AS STRING), CAST(NULL AS INT), {c})" for f, i, c in EXTRA_CAPACITY]
    return F.broadcast(spark.sql(
        "SELECT facility_id, CAST(location_id AS BIGINT) AS location_id, name, floor, max_capacity "
        f"FROM VALUES {', '.join(rows)} AS t(facility_id, location_id, name, floor, max_capacity)"
    ))


def section_dimension(spark: SparkSession) -> DataFrame:
    rows = [f"({f}, {_text(k)}, {_text(t)}, array({', '.join(map(str, ids))}))" for f, k, t, ids in SECTIONS]
    sections = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(facility_id, section_key, section_title, ids)")
    return F.broadcast(with_overall(sections))


def with_overall(sections: DataFrame) -> DataFrame:
    """One row per section and location, and per facility an ``overall`` of all of them."""
    exploded = sections.select(
        "facility_id", normalize_key(F.col("section_key")).alias("section_key"), "section_title",
        F.explode("ids").alias("location_id"),
    ).withColumn("location_id", F.col("location_id").cast("long")).filter("section_key <> '' AND location_id IS NOT NULL")
    overall = exploded.select("facility_id", F.lit("overall").alias("section_key"), F.lit("Entire Facility").alias("section_title"), "location_id")
    return exploded.unionByName(overall).dropDuplicates(["facility_id", "section_key", "location_id"])


SECTION_SCHEMA = (
    "facilities MAP<STRING, STRUCT<shortName: STRING, facilityName: STRING, "
    "sections: ARRAY<STRUCT<key: STRING, title: STRING, ids: ARRAY<STRING>>>>>"
)


def sections_of(documents: DataFrame) -> DataFrame:
    """Rows of a sections document already read with ``SECTION_SCHEMA``."""
    facilities = documents.select(F.explode("facilities").alias("_id", "_f")).withColumn("facility_id", F.col("_id").try_cast("int"))
    sections = facilities.filter("facility_id IS NOT NULL").select("facility_id", F.explode("_f.sections").alias("_s"))
    return with_overall(sections.select(
        "facility_id", F.col("_s.key").alias("section_key"), F.col("_s.title").alias("section_title"),
        F.filter(F.transform("_s.ids", lambda i: i.try_cast("long")), lambda i: i.isNotNull()).alias("ids"),
    ))


def read_section_dimension(spark: SparkSession, path: str) -> DataFrame:
    return sections_of(spark.read.schema(SECTION_SCHEMA).json(path, multiLine=True))


def facility_names(documents: DataFrame) -> DataFrame:
    """Short name, else the long one, else the number."""
    named = documents.select(F.explode("facilities").alias("_id", "_f"))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return named.select(
        F.col("_id").try_cast("int").alias("facility_id"),
        F.coalesce(some(F.col("_f.shortName")), some(F.col("_f.facilityName")), F.concat(F.lit("Facility "), "_id")).alias("facility_name"),
    ).filter("facility_id IS NOT NULL")
