"""Set-based and tile-based grid operators: columns (r, c) in, columns (r, c) out."""
