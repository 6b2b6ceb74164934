"""Small inputs of our own; expectations in the tests are derived from them by hand."""

# development per region and year as (month-day, DVS): AT21 ripens late in its second year and has
# two rows in one dekad whose order matters, SI03 starts a year later
GROWTH = {
    ("AT21", 2003): [("0105", 0), ("0215", 20), ("0322", 75), ("0503", 120), ("0722", 180),
                     ("0729", 202), ("0804", 202)],
    ("AT21", 2004): [("0109", 0), ("0228", 15), ("0411", 60), ("0607", 110), ("0818", 190),
                     ("0902", 200), ("0914", 203), ("1003", 203)],
    ("SI03", 2004): [("0120", 0), ("0301", 40), ("0512", 130), ("0620", 200), ("0625", 200)],
}

# precipitation and evapotranspiration on the same days of both years
DEKADAL_WATER = [("0108", 3.5, 0.4), ("0117", 0.6, 0.9), ("0126", 0.0, 1.3), ("0205", 2.4, 2.4),
                 ("0309", 5.25, 1.5)]

# day, PREC, ET0, TMAX, TMIN, TAVG, RAD: four, two and one day of three dekads
DAYS = [("0103", 0.0, 0.8, 3.5, -6.0, -1.5, 4200.0), ("0104", 4.5, 0.3, 1.0, -4.5, -2.0, 3100.0),
        ("0109", 7.25, 0.4, 6.5, 0.5, 3.0, 3500.0), ("0110", 1.25, 0.5, 4.0, -1.0, 2.5, 5200.0),
        ("0111", 0.0, 1.5, 9.0, 2.0, 5.0, 8000.0), ("0120", 0.5, 1.0, 12.5, 1.5, 6.0, 7000.0),
        ("0131", 2.0, 0.25, 2.5, -9.5, -3.0, 6000.0)]


def growth(spark):
    return spark.createDataFrame(
        [(2, r, f"{y}{d}", 0.0, v) for (r, y), days in GROWTH.items() for d, v in days],
        "CROP_ID int, IDREGION string, DATE string, POT_YB double, DVS long")


def dekadal_weather(spark):
    return spark.createDataFrame(
        [("AT21", f"{y}{d}", p, e) for y in (2003, 2004) for d, p, e in DEKADAL_WATER],
        "IDREGION string, DATE string, PREC double, ET0 double")


def daily_weather(spark):
    return spark.createDataFrame(
        [("AT21", f"{y}{d}", *v) for y in (2003, 2004) for d, *v in DAYS],
        "IDREGION string, DATE string, PREC double, ET0 double, TMAX double, TMIN double, "
        "TAVG double, RAD double")


# calendar rows: year -> [(DEKAD, DVS)], campaign dekads are 12 later
STAGES = {
    2003: [(8, 0), (9, 3), (12, 60), (14, 100), (17, 150), (20, 200), (21, 203)],
    2004: [(7, 0), (10, 2), (13, 99), (15, 105), (19, 199), (22, 201), (23, 201)],
}


def stages(spark):
    return spark.createDataFrame(
        [("AT21", y, d, y, d + 12, v) for y, ds in STAGES.items() for d, v in ds],
        "IDREGION string, FYEAR int, DEKAD int, CAMPAIGN_YEAR int, CAMPAIGN_DEKAD int, DVS long")


def yields(spark):
    """Three regions over 14 years: one complete, one with a gap, one short."""
    years = range(1990, 2004)
    data = [("AA11", y, 40 + 0.7 * i + (i * 7 % 5)) for i, y in enumerate(years)]
    data += [("AA12", y, 30 - 0.2 * i + (i * 11 % 7) / 2) for i, y in enumerate(years)
             if y not in (1995, 1996)]
    data += [("BB11", y, 55.0 + i * i / 9) for i, y in enumerate(years) if y >= 1998]
    return spark.createDataFrame(data, "IDREGION string, FYEAR int, YIELD double")
