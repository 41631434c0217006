from .scalars import (  # noqa: F401
    age_in_years,
    day_in_utc,
    pseudonym,
    seconds_between,
    surrogate_key,
    to_gbp,
    whole_days_between,
)
