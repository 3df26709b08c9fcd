"""Layout-aware document analytics expressed as Spark plans."""
