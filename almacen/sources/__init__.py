"""Raw feed, CSV scan and warehouse sinks."""
