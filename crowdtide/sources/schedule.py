"""Schedule documents and web pages as rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crowdtide.functions.markup import elements, single_spaced, tagged_elements, visible_text
from crowdtide.functions.text import NOTICE_CLOSURES, NOTICE_HOURS, is_challenge_page, names_columns, tells_hours

HEADING_CHARS = 140     # longer headings are running text
SCHEDULE_SCHEMA = """
    facilities ARRAY<STRUCT<facilityId: STRING, facilityName: STRING, status: STRING, sections:
        ARRAY<STRUCT<title: STRING, note: STRING, rows: ARRAY<STRUCT<label: STRING, hours: STRING>>>>>>
"""


def read_schedule_document(spark: SparkSession, path: str) -> DataFrame:
    return schedule_rules(spark.read.schema(SCHEDULE_SCHEMA).json(path, multiLine=True))


def schedule_rules(documents: DataFrame) -> DataFrame:
    """Section and row rules, in document order, of facilities that were read well."""
    facilities = documents.select(F.explode("facilities").alias("f")).filter(
        (F.lower(F.trim("f.status")) == "ok") & (F.size("f.sections") > 0) & F.col("f.facilityId").try_cast("long").isNotNull()
    )
    sections = facilities.select(
        F.col("f.facilityId").try_cast("long").alias("facility_id"), F.posexplode("f.sections").alias("section_idx", "s")
    )
    return sections.select(
        "facility_id", "section_idx", F.coalesce("s.title", F.lit("")).alias("section_title"), F.col("s.note").alias("note"),
        F.posexplode_outer("s.rows").alias("row_idx", "r"),
    ).select("facility_id", "section_idx", "section_title", "note", "row_idx", F.col("r.label").alias("label"), F.col("r.hours").alias("hours"))


ROWS = "array<struct<label:string,hours:string>>"
NOTICES = (("Seasonal Notice", NOTICE_HOURS), ("Maintenance Closures", NOTICE_CLOSURES))


def _hours_rows(table):
    """Rows of a table that give hours, as label and hours."""
    cells = F.transform(elements(table, "tr"), lambda row: F.transform(elements(row, "td|th"), visible_text))
    told = F.filter(cells, lambda row: (F.size(row) >= 2) & ~names_columns(row) & tells_hours(row))
    return F.transform(told, lambda row: F.struct(row[0].alias("label"), row[1].alias("hours")))


def _titles(marks, heading_chars: int):
    """Usable headings among a page's headings and tables, with their places."""
    placed = F.transform(marks, lambda mark, at: F.struct(at.alias("at"), mark.alias("mark")))
    headings = F.filter(placed, lambda m: ~F.regexp_like(m["mark"], F.lit("(?i)^<table")))
    titles = F.transform(headings, lambda m: F.struct(m["at"].alias("at"), visible_text(m["mark"]).alias("title")))
    return F.filter(titles, lambda t: F.length(t["title"]).between(1, heading_chars))


def extract_schedule(pages: DataFrame, heading_chars: int = HEADING_CHARS) -> DataFrame:
    """HTML pages -> sections with title, rows and note, plus page status and error.

    Works on whole pages, row by row inside the JVM.  Headings and tables are taken in page
    order; a table is titled by the page's first heading that speaks of hours, if that stands
    above it, else by the last heading above it.  Notices are looked for in the visible text.
    """
    page = F.coalesce("html", F.lit(""))
    marked = pages.select("page_id", tagged_elements(page, "table|h[2-5]").alias("_marks"))
    marked = marked.withColumn("_titles", _titles(F.col("_marks"), heading_chars))
    marked = marked.withColumn("_telling", F.try_element_at(F.filter("_titles", lambda t: F.regexp_like(F.lower(t["title"]), F.lit("hour|schedule|building"))), F.lit(1)))
    tables = marked.select("page_id", "_titles", "_telling", F.posexplode("_marks").alias("pos", "_mark")).filter(F.regexp_like("_mark", F.lit("(?i)^<table")))
    above = F.try_element_at(F.filter("_titles", lambda t: t["at"] < F.col("pos")), F.lit(-1))
    title = F.when(F.col("_telling.at") < F.col("pos"), F.col("_telling.title")).otherwise(above["title"])
    found = tables.withColumn("rows", _hours_rows(F.col("_mark"))).filter(F.size("rows") > 0).select(
        "page_id", F.lit(0).alias("part"), "pos", F.coalesce(title, F.lit("Hours")).alias("title"), "rows", F.lit(None).cast("string").alias("note")
    )
    shown = pages.select("page_id", visible_text(page).alias("_text"))
    for part, (name, pattern) in enumerate(NOTICES, 1):
        found = found.unionByName(shown.select(
            "page_id", F.lit(part).alias("part"), F.posexplode(F.regexp_extract_all("_text", F.lit(pattern), F.lit(1))).alias("pos", "note"),
            F.lit(name).alias("title"), F.array().cast(ROWS).alias("rows"),
        ))
    sections = first_of_equal_sections(found).select(
        "page_id", F.struct("part", "pos", "title", "rows", "note").alias("section")
    ).groupBy("page_id").agg(F.sort_array(F.collect_list("section")).alias("_sections"))  # sections of one page
    ordered = F.transform("_sections", lambda s: F.struct(s["title"].alias("title"), s["rows"].alias("rows"), s["note"].alias("note")))
    read_well = F.col("_sections").isNotNull() & ~F.col("is_challenge")
    empty = F.array().cast(f"array<struct<title:string,rows:{ROWS},note:string>>")
    return pages.select("page_id", "url", is_challenge_page(page).alias("is_challenge")).join(sections, "page_id", "left").select(
        "page_id", "url", F.when(read_well, "ok").otherwise("error").alias("status"),
        F.when(F.col("is_challenge"), "bot challenge").when(F.col("_sections").isNull(), "parsed 0 schedule sections").alias("error"),
        F.when(read_well, ordered).otherwise(empty).alias("sections"),
    )


def first_of_equal_sections(sections: DataFrame) -> DataFrame:
    """Sections of a page that agree in title, rows and note (spaces and case aside) are one: the first."""
    folded = lambda name: F.lower(single_spaced(F.coalesce(name, F.lit(""))))
    keyed = sections.withColumn("_key", F.concat_ws("\x1f", folded("title"), F.to_json("rows"), folded("note")))
    place = Window.partitionBy("page_id", "_key").orderBy("part", "pos")
    return keyed.withColumn("_place", F.row_number().over(place)).filter("_place = 1").drop("_key", "_place")
