from crease.sources.deliveries import (  # noqa: F401
    drop_unnamed, fixture_deliveries, read_table, reject_pointer_file, scan_deliveries,
)
