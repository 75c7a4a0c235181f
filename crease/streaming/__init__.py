from crease.streaming.weekly import start_weekly_monitor  # noqa: F401
