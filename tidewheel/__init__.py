"""tidewheel: ordered dataflow, keyed lookup, stateful admission and codecs as Spark plans."""
