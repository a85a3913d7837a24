"""Files, connections and definition formats."""
