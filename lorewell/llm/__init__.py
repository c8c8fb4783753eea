"""Training-data operators: chat formatting, licence scans, extraction, packing,
decontamination, similarity joins, language ID, token counts, binary output and
embedding near-dedup.  Nothing else in the library imports this subpackage."""
