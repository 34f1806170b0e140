"""Fixed-offset local time for audit records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Hours from UTC, no daylight saving; any other name is +8.
OFFSET_HOURS = {
    "Asia/Shanghai": 8,
    "Asia/Tokyo": 9,
    "UTC": 0,
    "America/Los_Angeles": -8,
    "America/New_York": -5,
    "Europe/London": 0,
}
DEFAULT_OFFSET = 8


def audit_local_time(ts_utc: Column, tz_name: Column | str = "Asia/Shanghai") -> Column:
    """ISO text of a UTC wall-clock timestamp at the zone's fixed offset.

    As in ISO 8601 output of most libraries, the fraction is written with six
    digits and only when it is not zero.
    """
    zone = F.lit(tz_name) if isinstance(tz_name, str) else tz_name
    hours = F.lit(DEFAULT_OFFSET)
    for name, offset in OFFSET_HOURS.items():
        hours = F.when(zone == name, F.lit(offset)).otherwise(hours)
    # An instant is brought to UTC whatever the session's zone; a zoneless time is UTC already.
    instant = F.to_utc_timestamp(ts_utc.cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
    utc = F.when(F.typeof(ts_utc) == "timestamp", instant).otherwise(ts_utc.cast("timestamp_ntz"))
    local = utc + F.make_interval(hours=hours)
    # Plain text of a zoneless timestamp: no session time zone takes part.
    text = local.cast("string")
    whole = F.replace(F.substring(text, 1, 19), F.lit(" "), F.lit("T"))
    micros = F.substring(text, 21, 6)
    fraction = F.when(micros == "", F.lit("")).otherwise(
        F.concat(F.lit("."), F.rpad(micros, 6, "0"))
    )
    sign = F.when(hours < 0, F.lit("-")).otherwise(F.lit("+"))
    offset = F.concat(sign, F.lpad(F.abs(hours).cast("string"), 2, "0"), F.lit(":00"))
    return F.concat(whole, fraction, offset)
