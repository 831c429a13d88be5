"""Operators on text corpora: decontamination, archives, personal data, rules, deduplication, packing, classifiers, shards."""
