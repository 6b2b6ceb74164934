"""DataFrame-in, DataFrame-out operators, one module per stage of the analysis."""
