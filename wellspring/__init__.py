"""wellspring: subsurface-inventory analytics expressed as Spark DataFrame plans."""
