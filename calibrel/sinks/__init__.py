"""Writers."""

from calibrel.sinks.files import (
    read_codes,
    write_calibration,
    write_codes,
    write_sharded,
    write_text,
)

__all__ = ["read_codes", "write_calibration", "write_codes", "write_sharded", "write_text"]
