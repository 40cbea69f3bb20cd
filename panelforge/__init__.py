"""panelforge: entity x time panel analytics expressed as Spark DataFrame plans."""
