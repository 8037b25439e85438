"""Durations and schedules (DTE-1, DTE-2, DTE-4 helpers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

# Windows time-zone ids used by schedules and the IANA zone of each (public CLDR table).
_ZONES = """
Dateline Standard Time = Etc/GMT+12
UTC-11 = Etc/GMT+11
Aleutian Standard Time = America/Adak
Hawaiian Standard Time = Pacific/Honolulu
Marquesas Standard Time = Pacific/Marquesas
Alaskan Standard Time = America/Anchorage
UTC-09 = Etc/GMT+9
Pacific Standard Time (Mexico) = America/Tijuana
UTC-08 = Etc/GMT+8
Pacific Standard Time = America/Los_Angeles
US Mountain Standard Time = America/Phoenix
Mountain Standard Time (Mexico) = America/Mazatlan
Mountain Standard Time = America/Denver
Yukon Standard Time = America/Whitehorse
Central America Standard Time = America/Guatemala
Central Standard Time = America/Chicago
Easter Island Standard Time = Pacific/Easter
Central Standard Time (Mexico) = America/Mexico_City
Canada Central Standard Time = America/Regina
SA Pacific Standard Time = America/Bogota
Eastern Standard Time (Mexico) = America/Cancun
Eastern Standard Time = America/New_York
Haiti Standard Time = America/Port-au-Prince
Cuba Standard Time = America/Havana
US Eastern Standard Time = America/Indiana/Indianapolis
Turks And Caicos Standard Time = America/Grand_Turk
Paraguay Standard Time = America/Asuncion
Atlantic Standard Time = America/Halifax
Venezuela Standard Time = America/Caracas
Central Brazilian Standard Time = America/Cuiaba
SA Western Standard Time = America/La_Paz
Pacific SA Standard Time = America/Santiago
Newfoundland Standard Time = America/St_Johns
Tocantins Standard Time = America/Araguaina
E. South America Standard Time = America/Sao_Paulo
SA Eastern Standard Time = America/Cayenne
Argentina Standard Time = America/Buenos_Aires
Greenland Standard Time = America/Godthab
Montevideo Standard Time = America/Montevideo
Magallanes Standard Time = America/Punta_Arenas
Saint Pierre Standard Time = America/Miquelon
Bahia Standard Time = America/Bahia
UTC-02 = Etc/GMT+2
Azores Standard Time = Atlantic/Azores
Cape Verde Standard Time = Atlantic/Cape_Verde
UTC = UTC
Coordinated Universal Time = UTC
GMT Standard Time = Europe/London
Greenwich Standard Time = Atlantic/Reykjavik
Sao Tome Standard Time = Africa/Sao_Tome
Morocco Standard Time = Africa/Casablanca
W. Europe Standard Time = Europe/Berlin
Central Europe Standard Time = Europe/Budapest
Romance Standard Time = Europe/Paris
Central European Standard Time = Europe/Warsaw
W. Central Africa Standard Time = Africa/Lagos
Jordan Standard Time = Asia/Amman
GTB Standard Time = Europe/Bucharest
Middle East Standard Time = Asia/Beirut
Egypt Standard Time = Africa/Cairo
E. Europe Standard Time = Europe/Chisinau
Syria Standard Time = Asia/Damascus
West Bank Standard Time = Asia/Hebron
South Africa Standard Time = Africa/Johannesburg
FLE Standard Time = Europe/Kiev
Israel Standard Time = Asia/Jerusalem
South Sudan Standard Time = Africa/Juba
Kaliningrad Standard Time = Europe/Kaliningrad
Sudan Standard Time = Africa/Khartoum
Libya Standard Time = Africa/Tripoli
Namibia Standard Time = Africa/Windhoek
Arabic Standard Time = Asia/Baghdad
Turkey Standard Time = Europe/Istanbul
Arab Standard Time = Asia/Riyadh
Belarus Standard Time = Europe/Minsk
Russian Standard Time = Europe/Moscow
E. Africa Standard Time = Africa/Nairobi
Volgograd Standard Time = Europe/Volgograd
Iran Standard Time = Asia/Tehran
Arabian Standard Time = Asia/Dubai
Astrakhan Standard Time = Europe/Astrakhan
Azerbaijan Standard Time = Asia/Baku
Russia Time Zone 3 = Europe/Samara
Mauritius Standard Time = Indian/Mauritius
Saratov Standard Time = Europe/Saratov
Georgian Standard Time = Asia/Tbilisi
Caucasus Standard Time = Asia/Yerevan
Afghanistan Standard Time = Asia/Kabul
West Asia Standard Time = Asia/Tashkent
Qyzylorda Standard Time = Asia/Qyzylorda
Ekaterinburg Standard Time = Asia/Yekaterinburg
Pakistan Standard Time = Asia/Karachi
India Standard Time = Asia/Kolkata
Sri Lanka Standard Time = Asia/Colombo
Nepal Standard Time = Asia/Kathmandu
Central Asia Standard Time = Asia/Bishkek
Bangladesh Standard Time = Asia/Dhaka
Omsk Standard Time = Asia/Omsk
Myanmar Standard Time = Asia/Rangoon
SE Asia Standard Time = Asia/Bangkok
Altai Standard Time = Asia/Barnaul
W. Mongolia Standard Time = Asia/Hovd
North Asia Standard Time = Asia/Krasnoyarsk
N. Central Asia Standard Time = Asia/Novosibirsk
Tomsk Standard Time = Asia/Tomsk
China Standard Time = Asia/Shanghai
North Asia East Standard Time = Asia/Irkutsk
Singapore Standard Time = Asia/Singapore
W. Australia Standard Time = Australia/Perth
Taipei Standard Time = Asia/Taipei
Ulaanbaatar Standard Time = Asia/Ulaanbaatar
North Korea Standard Time = Asia/Pyongyang
Aus Central W. Standard Time = Australia/Eucla
Transbaikal Standard Time = Asia/Chita
Tokyo Standard Time = Asia/Tokyo
Korea Standard Time = Asia/Seoul
Yakutsk Standard Time = Asia/Yakutsk
Cen. Australia Standard Time = Australia/Adelaide
AUS Central Standard Time = Australia/Darwin
E. Australia Standard Time = Australia/Brisbane
AUS Eastern Standard Time = Australia/Sydney
West Pacific Standard Time = Pacific/Port_Moresby
Tasmania Standard Time = Australia/Hobart
Vladivostok Standard Time = Asia/Vladivostok
Lord Howe Standard Time = Australia/Lord_Howe
Bougainville Standard Time = Pacific/Bougainville
Russia Time Zone 10 = Asia/Srednekolymsk
Magadan Standard Time = Asia/Magadan
Norfolk Standard Time = Pacific/Norfolk
Sakhalin Standard Time = Asia/Sakhalin
Central Pacific Standard Time = Pacific/Guadalcanal
Russia Time Zone 11 = Asia/Kamchatka
New Zealand Standard Time = Pacific/Auckland
UTC+12 = Etc/GMT-12
Fiji Standard Time = Pacific/Fiji
Chatham Islands Standard Time = Pacific/Chatham
UTC+13 = Etc/GMT-13
Tonga Standard Time = Pacific/Tongatapu
Samoa Standard Time = Pacific/Apia
Line Islands Standard Time = Pacific/Kiritimati
"""
WINDOWS_TO_IANA = dict(line.split(" = ") for line in _ZONES.strip().splitlines())


def known_zone(zone: Column) -> Column:
    """IANA zone of a Windows or IANA zone name; UTC for null, null for a name that no clock knows."""
    m = F.create_map(*[F.lit(x) for kv in WINDOWS_TO_IANA.items() for x in kv])
    z = F.coalesce(m[zone], zone, F.lit("UTC"))
    return F.when(F.concat(F.lit("2000-01-01 00:00:00 "), z).try_cast("timestamp").isNotNull(), z)


def duration_struct(ms: Column | str) -> Column:
    """Milliseconds to ``struct(days, hours, minutes, seconds, milliseconds)``."""
    m = _c(ms).cast("long")
    return F.when(m.isNotNull(), F.struct(
        (m / 86400000).cast("long").alias("days"),
        ((m % 86400000) / 3600000).cast("long").alias("hours"),
        ((m % 3600000) / 60000).cast("long").alias("minutes"),
        ((m % 60000) / 1000).cast("long").alias("seconds"),
        (m % 1000).alias("milliseconds"),
    ))


def format_duration(d: Column | str) -> Column:
    """``1d 2h 3m 4s``; null or zero parts left out; ms ignored; ``0s`` when
    nothing remains (DTE-1)."""
    s = _c(d)
    parts = [F.when(s[f] > 0, F.concat(s[f].cast("string"), F.lit(u)))
             for f, u in (("days", "d"), ("hours", "h"), ("minutes", "m"), ("seconds", "s"))]
    txt = F.concat_ws(" ", *parts)
    return F.when(txt == "", F.lit("0s")).otherwise(txt)


def millis_between(start: Column | str, end: Column | str) -> Column:
    """``end - start`` in ms; null when either side is missing (DTE-2)."""
    a, b = _c(start), _c(end)
    return F.floor((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1000).cast("long")


def session_durations(submitted: Column | str, start: Column | str, end: Column | str) -> Column:
    """Queued, running and total durations of a session (DTE-2)."""
    return F.struct(
        duration_struct(millis_between(submitted, start)).alias("queued"),
        duration_struct(millis_between(start, end)).alias("running"),
        duration_struct(millis_between(submitted, end)).alias("total"),
    )
