"""hygeia: Spark-native data-hygiene engine.

Rules are derived from a published masterlist, every execution record is
validated against them, nearest standard records are proposed for invalid
fields, review snapshots are kept, review decisions are applied in batches,
and reports are answered -- all as DataFrame -> DataFrame operators.
"""

from hygeia.session import get_session, sized_broadcast, checkpoint_dir

__all__ = ["get_session", "sized_broadcast", "checkpoint_dir"]
