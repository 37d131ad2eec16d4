"""Files of other kinds as tables: subtitles, logs of model calls."""
