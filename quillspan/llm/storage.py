"""Written tables in the folder that the driver and all executors share; see ``quillspan.storage``."""

from quillspan.storage import drop, passing, shared_dir, written

__all__ = ["drop", "passing", "shared_dir", "written"]
