"""Cleaning of names, dates, times and numbers in raw text, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about which club is meant.
STOPWORDS = (
    "fc ac as ss ssc us uc sc cf cfc bc acf afc ssd spa club calcio football futbol fbc sport sportiva associazione societa asd usd acr de del the a c r sv vfb vfl tsg rc ud cd sd rcd"
).split()
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīıłńňōőřśşšţťūůűźżžÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝĀĂĄĆČĎĒĘĚĞĪŁŃŇŌŐŘŚŞŠŢŤŪŮŰŹŻŽ"


def strip_accents(text: Column) -> Column:
    """Accented Latin letters without their accents, by one translation table."""
    plain = "".join("".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) if c not in "łŁı" else {"ł": "l", "Ł": "L", "ı": "i"}[c] for c in ACCENTED)
    return F.translate(text, ACCENTED, plain)


def tokens(name: Column) -> Column:
    """Words of a name: no accents, punctuation, stop words or numbers."""
    plain = F.regexp_replace(F.replace(F.lower(strip_accents(name)), F.lit("&"), F.lit(" ")), "[^a-z0-9 ]+", " ")
    return F.filter(F.split(F.trim(plain), " +"), lambda t: (t != "") & ~t.isin(STOPWORDS) & ~t.rlike("^[0-9]+$"))


def normal_name(name: Column) -> Column:
    return F.array_join(tokens(name), " ")


def slug(name: Column) -> Column:
    base = F.when(F.size(tokens(name)) > 0, normal_name(name)).otherwise(F.lower(strip_accents(name)))
    made = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", "unknown").otherwise(made)


def number(text: Column) -> Column:
    """A number or null."""
    return F.trim(text).try_cast("double")


def whole(text: Column) -> Column:
    """A whole number, halves to even, or null."""
    return F.bround(number(text)).cast("int")


def day(text: Column) -> Column:
    """dd/MM/yyyy or dd/MM/yy."""
    t = F.trim(text)
    return F.when(t.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.try_to_timestamp(t, F.lit("d/M/yyyy"))).when(t.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$"), F.try_to_timestamp(t, F.lit("d/M/yy"))).cast("date")


def to_utc(date: Column, clock: Column, zone: Column | str) -> Column:
    """UTC of a local date and HH:MM; null without a time."""
    local = F.try_to_timestamp(F.concat_ws(" ", date.cast("string"), F.when(clock.rlike("^[0-2][0-9]:[0-5][0-9]"), F.substring(clock, 1, 5))), F.lit("yyyy-MM-dd HH:mm"))
    return F.to_utc_timestamp(local, zone)


def next_midnight(date: Column, zone: Column | str) -> Column:
    return F.to_utc_timestamp(F.date_add(date, 1).cast("timestamp"), zone)


def season_start(date: Column, first_month: int = 7) -> Column:
    return F.year(date) - F.when(F.month(date) < first_month, 1).otherwise(0)


def season_label(start: Column, split: bool = True) -> Column:
    return F.concat_ws("-", start.cast("string"), (start + 1).cast("string")) if split else start.cast("string")


def weekly_collection(date: Column, kickoff: Column, zone: str = "Europe/London") -> Column:
    """When weekly prices were collected at the latest: Tuesday for Tuesday to Thursday, else the Friday before, 18:00,
    but half an hour before kickoff."""
    w = F.weekday(date)
    back = F.when(w.between(1, 3), w - 1).otherwise((w + 3) % 7)
    at = to_utc(F.date_sub(date, back), F.lit("18:00"), zone)
    return F.least(at, F.coalesce(kickoff - F.make_interval(mins=F.lit(30)), at))


def natural_key(*parts: str) -> Column:
    return F.concat_ws(":", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))


def has_key(text: Column, key: str) -> Column:
    """Whether a JSON object in text has the key, with whatever value; false for broken or missing text."""
    return F.coalesce(F.array_contains(F.json_object_keys(text), key), F.lit(False))
