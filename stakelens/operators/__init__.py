from .asof import asof_lookup, current_lookup, scd_periods  # noqa: F401
from .dedup import keep_first  # noqa: F401
from .durable import clear_scratch, durable, scratch_dir  # noqa: F401
from .ordered import lag, last_value, lead, ordered, running_max_before, running_sum  # noqa: F401
