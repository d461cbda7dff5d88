"""Keys, schedule phrases and HTML fragments as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdtide.functions.markup import single_spaced

# --- fixed values: names and patterns of the schedule texts --------------------
OVERALL_NAMES = ("overall", "entire facility", "facility", "all", "all sections", "whole gym")
DAY_NAMES = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
MONTH_SHORT = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAY_TOKEN = (
    r"mon(?:day)?|tue(?:s|sday)?|wed(?:nesday)?|thu(?:r|rs|rsday)?|"
    r"fri(?:day)?|sat(?:urday)?|sun(?:day)?"
)
DATE_LIKE = r"(\d{4}-\d{2}-\d{2})|(\d{1,2}/\d{1,2}(?:/\d{2,4})?)|([a-z]{3,9}\s+\d{1,2})"
AREA_WORDS = (
    "ice rink", "sub zero", "pool", "court", "track", "climbing", "esports", "simulator", "fitness", "room",
)
DAY_HINT = (
    r"(?i)\b(mon(day)?|tue(s|sday)?|wed(nesday)?|thu(r|rs|rsday)?|fri(day)?|"
    r"sat(urday)?|sun(day)?|daily|weekdays?|weekends?)\b"
)
DATE_HINT = (
    r"(?i)\b(date|dates|jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|jun(e)?|jul(y)?|"
    r"aug(ust)?|sep(t|tember)?|oct(ober)?|nov(ember)?|dec(ember)?|"
    r"\d{1,2}/\d{1,2}(/\d{2,4})?|\d{4}-\d{2}-\d{2})\b"
)
HOURS_HINT = r"(?i)(am|pm|closed|24\s*hours?|noon|midnight|\d{1,2}(:\d{2})?\s*(am|pm)?)"
NOTICE_HOURS = r"(?i)(check back later for [^.]+? hours\.)"
NOTICE_CLOSURES = r"(?i)(no scheduled maintenance closures at this time\.?)"
CHALLENGE_WORDS = (
    "please enable javascript", "checking your browser", "challenge-platform", "just a moment...", "cf-chl-",
)
MINUTES_PER_DAY = 1440
# -------------------------------------------------------------------------------


def normalize_key(value: Column) -> Column:
    return single_spaced(F.lower(F.coalesce(value, F.lit(""))))


def spaced_key(value: Column) -> Column:
    """Underscores count as spaces."""
    return single_spaced(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[_\s]+", " "))


def underscored_key(value: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(F.coalesce(value, F.lit("")))), r"\s+", "_")


def title_key(value: Column) -> Column:
    """Section titles may start with an emoji or a bullet."""
    return spaced_key(F.regexp_replace(F.coalesce(value, F.lit("")), r"^[^a-zA-Z0-9]+", ""))


def canonical_section(value: Column) -> Column:
    key = normalize_key(value)
    return F.when(key.isin(*OVERALL_NAMES), "overall").otherwise(key)


def schedule_text(value: Column) -> Column:
    """Lower case, plain dashes, single spaces."""
    return single_spaced(F.translate(F.lower(value), "–—", "--"))


def _group(value: Column, pattern: str, number: int) -> Column:
    """A group of the match, NULL when empty or without match."""
    return F.nullif(F.regexp_extract(value, pattern, number), F.lit(""))


def make_date(year: Column, month: Column, day: Column) -> Column:
    """NULL for days that do not exist."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), text.try_cast("date"))


def _month_number(name: Column) -> Column:
    pairs = [(n, i + 1) for names in (MONTH_NAMES, MONTH_SHORT) for i, n in enumerate(names)] + [("sept", 9)]
    table = F.create_map(*[F.lit(x) for pair in dict(pairs).items() for x in pair])
    return F.try_element_at(table, name)


def parse_date_token(token: Column, year: Column, month: Column | None = None, dialect: str = "wide") -> Column:
    """ISO, 'mon d[, y]', a bare day of a known month, and (wide only) 'm/d[/y]'.

    The token is normalised schedule text.
    """
    text = token
    iso = r"^(\d{4})-(\d{2})-(\d{2})$"
    named = r"^([a-z]+)\s+(\d{1,2})(?:,\s*(\d{4}))?$"
    out = F.when(
        text.rlike(iso),
        make_date(*[_group(text, iso, i).try_cast("int") for i in (1, 2, 3)]),
    )
    if dialect == "wide":
        slashed = r"^(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))?$"
        raw = _group(text, slashed, 3).try_cast("int")
        given = F.when(raw < 100, raw + 2000).otherwise(raw)
        out = out.when(
            text.rlike(slashed),
            make_date(F.coalesce(given, year), _group(text, slashed, 1).try_cast("int"), _group(text, slashed, 2).try_cast("int")),
        )
    out = out.when(
        text.rlike(named),
        make_date(
            F.coalesce(_group(text, named, 3).try_cast("int"), year),
            _month_number(F.regexp_extract(text, named, 1)), _group(text, named, 2).try_cast("int"),
        ),
    )
    if month is not None:
        out = out.when(text.rlike(r"^\d{1,2}$"), make_date(year, month, text.try_cast("int")))
    return out


def with_date_range(df: DataFrame, label: str, year: str, out: str, dialect: str = "wide") -> DataFrame:
    """Add struct(start, end, span) of 'a - b' or a single date; NULL when not a date.

    ``wide`` finds a date anywhere in the label; ``strict`` wants the whole label to
    be a date or a range.  An end before the start rolls over into the next year.
    The steps are columns of their own, so no step repeats the ones before it.
    """
    token = lambda t, y, m=None: parse_date_token(F.col(t), y, m, dialect)
    start, year_of = F.col("_start"), F.year("_start")
    df = df.withColumn("_text", schedule_text(F.col(label)))
    df = df.withColumn("_parts", F.filter(F.transform(F.split("_text", r"\s+-\s+"), lambda p: F.trim(p)), lambda p: p != ""))
    df = df.withColumns({"_first": F.try_element_at("_parts", F.lit(1)), "_last": F.try_element_at("_parts", F.lit(-1))})
    df = df.withColumn("_start", token("_first", F.col(year)))
    df = df.withColumns({
        "_near": token("_last", year_of, F.month("_start")), "_plain": token("_last", F.col(year)),
        "_rolled": token("_last", year_of + 1, F.month("_start")),
    })
    df = df.withColumn("_end", F.coalesce("_near", "_plain"))
    df = df.withColumn("_end", F.when(F.col("_end") < start, F.when(F.col("_rolled") >= start, F.col("_rolled"))).otherwise(F.col("_end")))
    df = df.withColumn("_span", F.date_diff("_end", "_start") + 1)
    fits = F.col("_text").rlike(DATE_LIKE) if dialect == "wide" else (F.size("_parts") <= 2)
    known = F.coalesce(fits & (F.col("_span") > 0), F.lit(False))
    df = df.withColumn(out, F.when(known, F.struct(start.alias("start"), F.col("_end").alias("end"), F.col("_span").alias("span"))))
    return df.drop("_text", "_parts", "_first", "_last", "_start", "_near", "_plain", "_rolled", "_end", "_span")


def _day_number(token: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, n in enumerate(DAY_NAMES) for x in (n[:3], i)])
    return F.try_element_at(table, F.substring(token, 1, 3))


def parse_weekday_set(label: Column, dialect: str = "wide") -> Column:
    """Sorted weekday numbers, Monday 0; NULL when the (normalised) label names no day."""
    text = label
    token = DAY_TOKEN if dialect == "wide" else "|".join(DAY_NAMES)
    edge = r"\b" if dialect == "wide" else ""
    ranged = rf"{edge}({token})\s*-\s*({token}){edge}"
    one = rf"{edge}({token}){edge}"
    start, end = _day_number(_group(text, ranged, 1)), _day_number(_group(text, ranged, 2))
    wrapped = F.transform(F.sequence(start, F.when(end < start, end + 7).otherwise(end)), lambda d: d % 7)
    listed = F.transform(F.regexp_extract_all(text, F.lit(one), F.lit(1)), _day_number)
    days = (
        F.when(text.contains("daily"), F.sequence(F.lit(0), F.lit(6)))
        .when(text.contains("weekdays"), F.sequence(F.lit(0), F.lit(4)))
        .when(text.contains("weekends"), F.array(F.lit(5), F.lit(6)))
        .when(text.rlike(ranged), F.array_sort(wrapped))
        .otherwise(F.array_sort(F.array_distinct(listed)))
    )
    return F.when(F.size(days) > 0, days)


def parse_clock(token: Column, is_end: bool) -> Column:
    """Minutes of day; midnight closes a window at 1440 and opens one at 0.

    The token is normalised schedule text without dots.
    """
    text = token
    shape = r"^(\d{1,2})(?::(\d{2}))?\s*(am|pm)?$"
    hour = _group(text, shape, 1).try_cast("int")
    minute = F.coalesce(_group(text, shape, 2).try_cast("int"), F.lit(0))
    half = F.regexp_extract(text, shape, 3)
    hour = F.when((half == "am") & (hour == 12), 0).when((half == "pm") & (hour < 12), hour + 12).otherwise(hour)
    sound = text.rlike(shape) & (minute <= 59) & ((hour < 24) | ((hour == 24) & (minute == 0)))
    return (
        F.when(text == "midnight", F.lit(MINUTES_PER_DAY if is_end else 0))
        .when(text == "noon", 720).when(sound, hour * 60 + minute)
    )


def with_hours_window(df: DataFrame, hours: str, out: str, dialect: str = "wide") -> DataFrame:
    """Add struct(start_min, end_min, is_closed); an end past midnight exceeds 1440."""
    df = df.withColumn("_text", schedule_text(F.col(hours)))
    dashed = F.filter(F.split("_text", r"\s*-\s*"), lambda p: p != "")
    df = df.withColumn("_parts", dashed)
    if dialect == "wide":
        worded = F.filter(F.transform(F.split("_text", " to ", 2), lambda p: F.trim(p)), lambda p: p != "")
        df = df.withColumn("_parts", F.when((F.size("_parts") != 2) & F.col("_text").contains(" to "), worded).otherwise(F.col("_parts")))
    undotted = lambda i: F.trim(F.replace(F.try_element_at("_parts", F.lit(i)), F.lit("."), F.lit("")))
    df = df.withColumns({"_from": undotted(1), "_to": undotted(2)})
    df = df.withColumns({"_s": parse_clock(F.col("_from"), False), "_e": parse_clock(F.col("_to"), True)})
    end = F.when(F.col("_e") <= F.col("_s"), F.col("_e") + MINUTES_PER_DAY).otherwise(F.col("_e"))
    window = lambda start, stop, closed: F.struct(
        start.cast("int").alias("start_min"), stop.cast("int").alias("end_min"), F.lit(closed).alias("is_closed")
    )
    text = F.col("_text")
    df = df.withColumn(
        out,
        F.when(text.contains("closed"), window(F.lit(0), F.lit(0), True))
        .when(text.contains("24 hours"), window(F.lit(0), F.lit(MINUTES_PER_DAY), False))
        .when((F.size("_parts") == 2) & F.col("_s").isNotNull() & F.col("_e").isNotNull(), window(F.col("_s"), end, False)),
    )
    return df.drop("_text", "_parts", "_from", "_to", "_s", "_e")


def is_facility_wide(title: Column) -> Column:
    text = schedule_text(title)
    area = text.rlike("|".join(AREA_WORDS))
    return F.when(text == "", False).when(text == "seasonal notice", False).when(
        text.contains("maintenance closures"), True
    ).otherwise(~area)


def open_at(window: Column, minute: Column) -> Column:
    """Overnight windows wrap around on the same day."""
    start, end = window["start_min"], window["end_min"]
    return ~window["is_closed"] & F.when(
        end > MINUTES_PER_DAY, (minute >= start) | (minute < end - MINUTES_PER_DAY)
    ).otherwise((minute >= start) & (minute < end))


def opens_at(window: Column, minute: Column) -> Column:
    return ~window["is_closed"] & (minute == window["start_min"])


def closes_at(window: Column, minute: Column) -> Column:
    """A window ending at 1440 closes in minute 0 of the same date."""
    return ~window["is_closed"] & (minute == window["end_min"] % MINUTES_PER_DAY)


PHASE_FEATURES = ("phase_open", "phase_progress", "phase_since_open", "phase_until_close", "phase_near_open", "phase_near_close")


def schedule_phase(window: Column, minute: Column) -> dict[str, Column]:
    """Six values of where a minute lies in its day's window; zeros outside."""
    start, end = window["start_min"], window["end_min"]
    at = F.when((end > MINUTES_PER_DAY) & (minute < start), minute + MINUTES_PER_DAY).otherwise(minute)
    known = F.coalesce(~window["is_closed"], F.lit(False))
    inside = known & (at >= start) & (at < end)
    closing = known & ~inside & closes_at(window, minute)
    share = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    since, until = (at - start).cast("double"), (end - at).cast("double")
    duration = F.greatest(F.lit(1.0), (end - start).cast("double"))
    values = {
        "phase_open": (F.lit(1.0), 0.0),
        "phase_progress": (share(since / duration), 1.0),
        "phase_since_open": (share(since / 720.0), 1.0),
        "phase_until_close": (share(until / 720.0), 0.0),
        "phase_near_open": ((since <= 60).cast("double"), 0.0),
        "phase_near_close": ((until <= 60).cast("double"), 1.0),
    }
    return {
        name: F.coalesce(F.when(inside, value).when(closing, F.lit(at_close)), F.lit(0.0))
        for name, (value, at_close) in values.items()
    }


def names_columns(row: Column) -> Column:
    """Does a row of cells only name its columns?  (days or dates beside hours, or hours beside time)"""
    label, hours = (F.lower(single_spaced(row[k])) for k in (0, 1))
    beside_hours = F.regexp_like(label, F.lit("^(day|date)s?$")) & F.contains(hours, F.lit("hour"))
    return beside_hours | ((label == "hours") & F.regexp_like(hours, F.lit("^(time)?$")))


def tells_hours(row: Column) -> Column:
    """Does a row of cells give a day or a date, and hours beside it?"""
    label, hours = (single_spaced(row[k]) for k in (0, 1))
    dated = F.regexp_like(label, F.lit(f"{DAY_HINT}|{DATE_HINT}"))
    return dated & F.regexp_like(hours, F.lit(HOURS_HINT))


def is_challenge_page(page: Column) -> Column:
    """A page that asks for a browser instead of showing its content."""
    return F.exists(F.array(*map(F.lit, CHALLENGE_WORDS)), lambda words: F.contains(F.lower(page), words))
