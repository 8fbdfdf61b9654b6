"""Tables in, tables out: spaces, draws, distributions, slices, alignments."""
