"""The library's operators put together for a sport's season: plays, schedules, rosters and reports in, point-in-time
feature tables out. Column names are those of the public play-by-play releases."""
