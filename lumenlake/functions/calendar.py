"""Calendar phrases to exclusive millisecond bounds.

A closed set: today, yesterday, N units ago, a day like 2024-05-01, 5 may 2024 or
may 5, 2024, a month and year (which stand for the month's first day), last
week/month/year, this year, last N units, before/after a year or a day phrase, and
"old". A day that no calendar has is ambiguous. Days, weeks
(from Monday), months and years follow the session time zone; ``now`` is a
timestamp Column, so every row may have its own clock. A phrase that goes back
further than ``EARLIEST`` has no bounds and is ambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions import rules as R


def drop_first(text: Column, pattern: str) -> Column:
    """Remove the first match only."""
    return F.regexp_replace(text, rf"(?s)^(.*?){R.words(pattern)}", "$1")


def to_english(text: Column) -> Column:
    """Calendar words of the other languages to English, by the ordered word map."""
    original = text
    for pattern, english in R.CALENDAR_WORDS:
        text = F.regexp_replace(text, R.words(pattern), english.replace("{", "$").replace("}", ""))
    return F.when(original.rlike(R.words(R.any_of((p, p) for p, _ in R.CALENDAR_WORDS))), text).otherwise(original)


def _millis(day: Column) -> Column:
    """Start of a day."""
    return F.unix_millis(day.cast("timestamp"))


def _amount(word: Column) -> Column:
    number = F.try_to_number(word, F.lit("999999999")).cast("int")
    for name, value in R.NUMBER_WORDS.items():
        number = F.when(word == name, F.lit(value)).otherwise(number)
    return number


# Days before this are out of reach; so are longer amounts, which keeps all later steps from overflowing.
EARLIEST = "1800-01-01"
LARGEST_AMOUNT = 99_999


def _back(day: Column, amount: Column, unit: Column) -> Column:
    """The day so many units earlier; null for larger amounts than ``LARGEST_AMOUNT``."""
    amount = F.when(amount <= LARGEST_AMOUNT, amount)
    months = F.when(unit.startswith("month"), 1).when(unit.startswith("year"), 12).otherwise(0)
    days = F.when(unit.startswith("day"), 1).when(unit.startswith("week"), 7).otherwise(0)
    return F.date_sub(F.add_months(day, -amount * months), amount * days)


def _day_of(phrase: Column, today: Column) -> Column:
    """The day a phrase names."""
    named = F.regexp_extract(phrase, f"({'|'.join(R.MONTHS)})", 1)
    month = F.array_position(F.array(*map(F.lit, R.MONTHS)), named)
    number = F.regexp_extract(phrase, r"\b(\d{1,2})\b", 1)
    parts = (F.regexp_extract(phrase, r"(\d{4})$", 1), month.cast("string"), F.when(number == "", "1").otherwise(number))
    pattern = rf"{R.AMOUNT}\s+{R.UNIT}\s+ago"
    amount = _amount(F.regexp_extract(phrase, pattern, 1))
    unit = F.regexp_extract(phrase, pattern, 2)
    return (
        F.when(phrase == "today", today)
        .when(phrase == "yesterday", F.date_sub(today, 1))
        .when(phrase.rlike(f"^{R.ISO_DAY}$"), F.try_to_date(phrase, "yyyy-MM-dd"))
        .when(named != "", F.try_to_date(F.concat_ws("-", *parts), "yyyy-M-d"))
        .otherwise(_back(today, amount, unit))
    )


def _year_before(now: Column) -> Column:
    """Same time a year earlier; 29 February becomes 1 March."""
    first = F.make_date(F.year(now) - 1, F.month(now), F.lit(1))
    day = F.date_add(first, F.dayofmonth(now) - 1)
    return _millis(day) + (F.unix_millis(now) - _millis(F.to_date(now)))


def calendar_range(df: DataFrame, text: str, now: str) -> DataFrame:
    """Add after_ms, before_ms (exclusive bounds), date_ambiguous and date_rest (text without the phrase).

    ``text`` must be folded. ``date_rest`` has the calendar words in English.
    """
    clock, today = F.col(now), F.to_date(F.col(now))
    t = F.col("_text")
    df = df.withColumn("_text", to_english(F.col(text)))
    df = df.withColumns(
        {
            "_year": F.regexp_extract(t, R.words(R.YEAR_BOUND), 2),
            "_side": F.regexp_extract(t, R.words(R.YEAR_BOUND), 1),
            "_period": F.regexp_extract(t, R.words(R.PERIOD), 1),
            "_rolling": t.rlike(R.words(R.ROLLING)),
            # Only the first rolling phrase turns into "N units ago".
            "_days": F.regexp_replace(t, rf"(?s)^(.*?){R.words(R.ROLLING)}", "$1$2 $3 ago"),
        }
    )
    df = df.withColumn("_phrases", F.regexp_extract_all("_days", F.lit(R.words(R.DAY_PHRASE)), 1))
    df = df.withColumns(
        {
            "_start": _day_of(F.get("_phrases", F.lit(0)), today),
            "_end": _day_of(F.get("_phrases", F.lit(1)), today),
            "_lead": F.regexp_extract("_days", rf"(?s)^(.*?){R.words(R.DAY_PHRASE)}", 1),
            "_old": t.rlike(R.words(R.OLD)),
        }
    )
    early = F.lit(EARLIEST).cast("date")
    df = df.withColumns({c: F.when(F.col(c) >= early, F.col(c)) for c in ("_start", "_end")})
    # The word counts only directly before the first phrase.
    prefix = F.regexp_extract("_lead", R.words(r"\b(before|after)\s*$"), 1)
    monday, month, year = (F.trunc(today, unit) for unit in ("week", "month", "year"))
    january = F.make_date(F.when(F.col("_year") != "", F.col("_year").cast("int")), F.lit(1), F.lit(1))
    kind = (
        F.when(F.col("_year") != "", F.concat_ws(" ", "_side", F.lit("year")))
        .when(F.col("_period") != "", F.col("_period"))
        .when((F.size("_phrases") > 0) & (prefix != ""), F.concat_ws(" ", prefix, F.lit("day")))
        .when((F.size("_phrases") > 0) & F.col("_rolling"), "rolling")
        .when(F.size("_phrases") > 2, "many")
        .when(F.size("_phrases") > 0, "days")
        .when(F.col("_old"), "old")
        .otherwise("none")
    )
    df = df.withColumn("_kind", kind)
    k = F.col("_kind")
    start = _millis(F.col("_start"))
    after = (
        F.when(k == "after year", _millis(F.add_months(january, 12)) - 1)
        .when(k == "last week", _millis(F.date_sub(monday, 7)) - 1)
        .when(k == "last month", _millis(F.add_months(month, -1)) - 1)
        .when(k == "last year", _millis(F.add_months(year, -12)) - 1)
        .when(k == "this year", _millis(year) - 1)
        .when(k == "after day", _millis(F.date_add("_start", 1)) - 1)
        .when(k.isin("rolling", "days"), start - 1)
    )
    before = (
        F.when(k == "before year", _millis(january))
        .when(k == "last week", _millis(monday))
        .when(k == "last month", _millis(month))
        .when(k == "last year", _millis(year))
        .when(k.isin("this year", "rolling"), F.unix_millis(clock) + 1)
        .when(k == "before day", start)
        .when(k == "days", _millis(F.date_add(F.coalesce("_end", "_start"), 1)))
        .when(k == "old", _year_before(clock))
    )
    unreached = k.isin("before day", "after day", "rolling", "days") & (
        F.col("_start").isNull() | ((k == "days") & (F.size("_phrases") > 1) & F.col("_end").isNull())
    )
    after, before = F.when(~unreached, after), F.when(~unreached, before)
    without_days = F.regexp_replace("_days", R.words(R.DAY_PHRASE), "")
    rest = (
        F.when(k.isin("before year", "after year"), drop_first(t, R.YEAR_BOUND))
        .when(k.isin("last week", "last month", "last year", "this year"), drop_first(t, R.PERIOD))
        .when(k == "before day", drop_first(without_days, r"\bbefore\b"))
        .when(k == "after day", drop_first(without_days, r"\bafter\b"))
        .when(k == "days", F.regexp_replace(without_days, R.words(R.RANGE_WORDS), ""))
        .when(k.isin("rolling", "many"), without_days)
        .when(k == "old", drop_first(t, R.OLD))
        .otherwise(F.col("_days"))
    )
    ambiguous = (k == "many") | unreached | ((k == "none") & F.col("_days").rlike(R.words(R.OPEN_DATE)))
    added = {"after_ms": after, "before_ms": before, "date_ambiguous": ambiguous, "date_rest": rest}
    df = df.withColumns(added)
    working = ("_text", "_year", "_side", "_period", "_rolling", "_days", "_phrases", "_start", "_end")
    return df.drop(*working, "_lead", "_old", "_kind")
