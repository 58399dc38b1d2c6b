"""Row-level expressions. Each takes and returns ``Column`` and stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapgrid.params import (ACTION_MAP, ACTION_NONE, ACTION_REVIEW, BATCH_NEW, BATCH_ORIGINAL, FIELD_RESULTS,
                            BBox, Params)

EARTH_KM = 6371.0
EARTH_M = 6_371_000.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- validity --------------------------------------------------------------

def zero_origin(lat="lat_orig", lon="lon_orig") -> Column:
    return (_c(lat) == 0) | (_c(lon) == 0)


def in_bbox(box: BBox, lat="lat_orig", lon="lon_orig") -> Column:
    return _c(lat).between(box.lat_min, box.lat_max) & _c(lon).between(box.lon_min, box.lon_max)


def valid_origin(box: BBox, lat="lat_orig", lon="lon_orig") -> Column:
    return ~zero_origin(lat, lon) & in_bbox(box, lat, lon)


def valid_destination(lat="lat_dest", lon="lon_dest") -> Column:
    return (_c(lat) != 0) & _c(lat).between(-90, 90) & _c(lon).between(-180, 180)


# ---- time ------------------------------------------------------------------

def parse_ts_lenient(text) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` without a zone; anything else is null."""
    return F.try_to_timestamp(_c(text), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def iso_year(ts="ts") -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _c(ts)).cast("int")


def iso_week(ts="ts") -> Column:
    return F.weekofyear(_c(ts)).cast("int")


def day_of(ts="ts") -> Column:
    return F.to_date(_c(ts))


def hour_of(ts="ts") -> Column:
    return F.hour(_c(ts))


def weekday_of(ts="ts") -> Column:
    """1 = Monday … 7 = Sunday."""
    return F.weekday(_c(ts)) + 1


def monday_of(ts="ts") -> Column:
    return F.date_sub(F.to_date(_c(ts)), F.weekday(_c(ts)))


# ---- text ------------------------------------------------------------------

def repair_mojibake(text) -> Column:
    """UTF-8 text that was decoded as Latin-1 is restored; every other value is returned unchanged.

    ``encode`` and ``decode`` raise on text they cannot map, so both are reached only behind a guard.
    """
    s = _c(text)
    latin = F.regexp_like(s, F.lit("^[\\x00-\\xFF]*$"))
    raw = F.when(latin, F.encode(s, "ISO-8859-1"))
    good = F.is_valid_utf8(raw.cast("string"))
    return F.when(latin & good, F.decode(F.when(latin & good, raw), "UTF-8")).otherwise(s)


def batch_of_file(name) -> Column:
    """Export batch from the ``…_YYYY-WW.csv`` ending: week 18 of 2024 onwards is the new batch."""
    year = F.regexp_extract(_c(name), r"_(\d+)-(\d+)\.csv$", 1)
    week = F.regexp_extract(_c(name), r"_(\d+)-(\d+)\.csv$", 2)
    return F.when((year == "2024") & (week.try_cast("int") >= 18), BATCH_NEW).otherwise(BATCH_ORIGINAL)


# ---- distance --------------------------------------------------------------

def _haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    la1, lo1, la2, lo2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    a = (F.pow(F.sin((la2 - la1) / 2), 2.0) + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2.0))
    return 2 * radius * F.asin(F.sqrt(a))


def haversine_km(lat, lon, lat0: float, lon0: float) -> Column:
    return _haversine(F.lit(lat0), F.lit(lon0), _c(lat), _c(lon), EARTH_KM)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    return _haversine(_c(lat1), _c(lon1), _c(lat2), _c(lon2), EARTH_M)


# ---- zone expressions ------------------------------------------------------

def log1p_design(name: str) -> Column:
    """Population predictors enter as log(1 + x), the others as they are."""
    return F.log1p(F.col(name).cast("double")) if name.startswith("pop_") else F.col(name).cast("double")


def log_offset(population="population") -> Column:
    return F.log(_c(population).cast("double"))


def in_model_flag(p: Params, population="population") -> Column:
    return _c(population) >= p.pop_min


def population_class(p: Params, population="population") -> Column:
    pop = _c(population)
    return (F.when(pop >= p.pop_min, f"population >= {p.pop_min}")
            .when(pop > 0, f"1 <= population < {p.pop_min}").otherwise("population = 0"))


def coverage_flag(distance_m, limit_m: float) -> Column:
    return (_c(distance_m) <= limit_m).cast("tinyint")


def rate_per_1000(count, population) -> Column:
    return F.try_divide(_c(count), _c(population)) * 1000


def gap_pearson(obs, exp) -> Column:
    return (_c(obs) - _c(exp)) / F.sqrt(_c(exp))


def ratio_shrunk(obs, exp, c: float = 1.0) -> Column:
    return (_c(obs) + c) / (_c(exp) + c)


def unmet_demand(obs, exp) -> Column:
    return F.greatest(_c(exp) - _c(obs), F.lit(0.0))


def gap_metrics(obs, exp, c: float = 1.0) -> list[Column]:
    return [gap_pearson(obs, exp).alias("gap_pearson"), ratio_shrunk(obs, exp, c).alias("ratio_obs_exp"),
            unmet_demand(obs, exp).alias("unmet_demand")]


def per_observed_week(value, weeks) -> Column:
    return _c(value) / weeks


def cut_right_closed(x, cuts: list[float], labels: list[str]) -> Column:
    """Label of the interval ``(a, b]`` that holds ``x``; null stays null."""
    out = F.when(_c(x).isNull(), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels):
        out = out.when(_c(x) <= cut, label)
    return out.otherwise(labels[-1])


def log_bin(x, bins: int, lo, hi) -> Column:
    """Bin 1..bins on equal steps of log10(x) between lo and hi, the last bin closed on the right."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    pos = F.floor((F.log10(_c(x)) - lo) / (hi - lo) * bins) + 1
    return F.when((F.log10(_c(x)) >= lo) & (F.log10(_c(x)) <= hi), F.least(pos, F.lit(bins))).cast("int")


def priority_action(gap="gap_pearson", covered="covered") -> Column:
    below = F.coalesce(_c(gap) < 0, F.lit(False))
    return (F.when(below & (_c(covered) != 1), ACTION_MAP).when(below & (_c(covered) == 1), ACTION_REVIEW)
            .otherwise(ACTION_NONE))


def map_link(lat, lon) -> Column:
    return F.format_string("https://www.openstreetmap.org/?mlat=%.5f&mlon=%.5f#map=16/%.5f/%.5f",
                           _c(lat), _c(lon), _c(lat), _c(lon))


def field_template() -> list[Column]:
    return [F.lit(FIELD_RESULTS[-1]).alias("field_result"), F.lit("").alias("field_notes")]


def null_to_false(*signals: str) -> list[Column]:
    return [F.coalesce(F.col(s), F.lit(False)).alias(s) for s in signals]


def count_true(*signals: str) -> Column:
    total = F.lit(0)
    for s in signals:
        total = total + F.coalesce(F.col(s), F.lit(False)).cast("int")
    return total


def clamp(x, limit) -> Column:
    return F.greatest(F.least(_c(x), limit), -limit)


def value_when(flag, value) -> Column:
    """The value where the flag holds, otherwise null (a gap in a series, not a zero)."""
    return F.when(_c(flag), _c(value))


def round_all(df: DataFrame, digits: int) -> DataFrame:
    """Half-even rounding of every floating column."""
    return df.select(*[F.bround(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])
