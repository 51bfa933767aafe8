"""lorekit: documentation and code intelligence, expressed as Spark plans."""
