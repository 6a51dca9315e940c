"""Query bindings of the operators to the driver's test tables, and their SQL oracles."""
