from .events import event_stream, normalise, replay_slice, to_messages, unified_events  # noqa: F401
from .lens import Lens  # noqa: F401
from .raw import fx_rates, read_raw  # noqa: F401
