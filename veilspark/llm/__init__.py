"""Training-data operators: mixing, counts, classifiers, fingerprints, archives, scans."""
