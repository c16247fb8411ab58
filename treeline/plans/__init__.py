"""Planning on the driver: hypergraphs, decompositions, costs. No data passes here."""
