"""Dates in all their forms, on known texts."""

from pyspark.sql import functions as F

from quirelake.functions import date_ranges

CASES = {
    "1542-1620": (1542, 1620, False, "gregorian_range"), "882-942": (882, 942, False, "gregorian_range"), "1570?-1667": (1570, 1667, True, "gregorian_uncertain_range"), "?1270-?1340": (1270, 1340, True, "gregorian_uncertain_range"), "1661-": (1661, None, False, "gregorian_open"), "1650": (1650, 1650, False, "gregorian_single"), "[1650?]": (1650, 1650, True, "gregorian_single"),
    "המאה ה-17": (1601, 1700, True, "hebrew_century"), 'המאה הי"ז': (1601, 1700, True, "hebrew_century"), "המאה ה-16-17": (1501, 1700, True, "hebrew_century"), 'פעל במאה הי"ז': (1601, 1700, True, "hebrew_active"), "פעיל 1407": (1407, 1407, True, "hebrew_active"), "פעל במאה ה-16-17": (1501, 1700, True, "hebrew_active"),
    "1570 בערך-1643": (1570, 1643, True, "hebrew_approximate"), "בערך 1570-1643": (1570, 1643, True, "hebrew_approximate"), "נפטר 1628 בערך": (None, 1628, True, "hebrew_approximate"), "נפטר 1628": (None, 1628, False, "hebrew_approximate"), "נולד 1540": (1540, None, False, "hebrew_approximate"), "1570 בערך": (1570, 1570, True, "hebrew_approximate"),
    'ת"ן (1690).': (1690, 1690, False, "publication_hebrew_year"), "א'תתקס\"ג לשטרות (1652)": (1652, 1652, False, "seleucid_era"), "א'תתקס\"ג לשטרות": (1652, 1652, True, "seleucid_era"), "approximately 1490-approximately 1560": (1490, 1560, True, "english_approximate"), "ca. 1350": (1350, 1350, True, "english_approximate"), "c.1350": (1350, 1350, True, "english_approximate"),
    "16th-17th cent.": (1501, 1700, True, "english_century"), "17TH CENTURY": (1601, 1700, True, "english_century"), 'שס"ד': (1604, 1604, True, "standalone_hebrew_year"), "ת׳ג": (1643, 1643, True, "standalone_hebrew_year"), "א": (None, None, False, ""), "יב": (None, None, False, ""), "": (None, None, False, ""), " . ": (None, None, False, ""), "no date": (None, None, False, ""), "99-100": (None, None, False, ""), "50-2200": (None, None, False, ""),
}


def test_forms(spark):
    df = spark.createDataFrame([(s,) for s in [*CASES, None]], "s string")
    got = {r["s"]: tuple(r["d"]) for r in df.select("s", date_ranges.date_range(F.col("s")).alias("d")).collect()}
    assert {s: got[s] for s in CASES} == CASES and got[None] == (None, None, False, "")


def test_people_and_manuscripts(spark):
    cases = {"1542-1620": (1542, 1620, None), "נפטר 1628 בערך": (None, 1628, None), "המאה ה-17": (None, None, 1650), "1661-": (1661, None, None), "1650": (None, None, 1650), "": (None, None, None)}
    got = {r["s"]: tuple(r["y"]) for r in spark.createDataFrame([(s,) for s in cases], "s string").select("s", date_ranges.person_years(F.col("s")).alias("y")).collect()}
    assert got == cases
    rows = [(1500, "x", 1500), (50, "written 99, 1450 or 1460", 1450), (None, "fol. 12 of 5000", None), (None, None, None)]
    df = spark.createDataFrame(rows, "y int, s string, wanted int")
    assert all(r["y"] == r["wanted"] for r in df.select(date_ranges.manuscript_year(F.col("y"), F.col("s")).alias("y"), "wanted").collect())
    texts = spark.createDataFrame([('copied 16TH Century', "16th century"), ('כתב מאה ט""ז', 'מאה ט"ז'), ("x", None), (None, None)], "s string, wanted string")
    assert all(r["c"] == r["wanted"] for r in texts.select(date_ranges.century_text(F.col("s")).alias("c"), "wanted").collect())
